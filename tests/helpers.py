"""Row builders and comparison for the tests."""

from datetime import datetime

from pyspark.sql import functions as F


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def frame(spark, spec_or_schema, *rows):
    """A DataFrame from tuples, or from dicts whose missing columns are NULL."""
    schema = getattr(spec_or_schema, "schema", spec_or_schema)
    data = [tuple(r.get(n) for n in schema.names) if isinstance(r, dict) else r for r in rows]
    return spark.createDataFrame(data, schema)


def rows(df, *columns):
    """Rows as sorted tuples, list columns sorted."""
    df = df.select(*columns) if columns else df
    lists = [f.name for f in df.schema.fields if f.dataType.simpleString().startswith("array")]
    df = df.withColumns({c: F.array_sort(c) for c in lists})
    plain = [tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect()]
    return sorted(plain, key=lambda r: tuple((v is not None, str(v)) for v in r))


def same(actual, expected):
    """Equal content in any order of rows, columns and list entries."""
    assert set(actual.columns) == set(expected.columns)
    assert rows(actual.select(*expected.columns)) == rows(expected)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
