import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
# names that the operators use inside
CLASHING = ("score", "node", "print", "row", "size", "copies", "n_entities", "key", "range", "leaf", "unit", "held_out")


def doc(doc_id, text, source="web"):
    return doc_id, text, "en", source, None if text is None else len(text)


@pytest.fixture
def awkward():
    """NULLs in every column, empty and very long texts, ties and repeated rows."""
    long_text = " ".join(f"word{i % 977}" for i in range(60_000))
    return [
        doc(1, "The quick brown fox jumps over the lazy dog near the old river bank."),
        doc(2, ""),
        doc(3, None),
        doc(4, long_text),
        doc(5, "The quick brown fox jumps over the lazy dog near the old river bank.", None),
        doc(6, " \t\n "),
        doc(6, " \t\n "),
        doc(None, "no id, one", "web"),
        doc(None, "no id, one", "web"),
        doc(None, None, None),
        (7, "only text", None, None, None),
        doc(8, "Ünïcode ΑΣ 日本語 😀 <|endoftext|> don't", "other"),
        doc(9, "x" * 30_000, "other"),
    ]


@pytest.fixture
def make_docs(spark):
    def make(rows, clashing=False):
        df = spark.createDataFrame(rows, DOCS)
        if clashing:
            from pyspark.sql import functions as F

            df = df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])
        return df

    return make
