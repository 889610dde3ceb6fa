"""Which tokens need a definition, and how defined tokens are refreshed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexlake.functions import fixed_values as fixed
from lexlake.functions.columns import is_defined, is_undefined
from lexlake.spec import BRONZE, SILVER, TableSpec, qualified


def defined_rows(silver: DataFrame) -> DataFrame:
    return silver.where(is_defined())


def undefined_rows(silver: DataFrame) -> DataFrame:
    return silver.where(is_undefined())


def request_states(updates: DataFrame, silver: DataFrame) -> DataFrame:
    """Tokens without a definition, each with why it is to be looked up: bronze columns and ``state``.

    ``new``: updated, not in silver. ``again``: updated, in silver without a definition. ``retry``: in silver without a
    definition and not updated, with its stored statistics and stamp. Silver is read once: one row per text is joined to
    the updates, and both lie bucketed on the text.
    """
    bare = F.when(is_undefined(), F.struct(*BRONZE.attributes))
    stored = silver.groupBy("text").agg(F.min(bare).alias("bare"), F.lit(True).alias("known"))
    new, old = qualified("new"), qualified("old")
    fresh = updates.select(*BRONZE.attributes, F.lit(True).alias("updated")).alias("new")
    joined = fresh.join(stored.alias("old"), new("text") == old("text"), "full_outer")
    wanted = joined.where(old("known").isNull() | old("bare").isNotNull())
    state = F.when(old("known").isNull(), "new").when(new("updated"), "again").otherwise("retry")
    pick = [F.when(new("updated"), new(c)).otherwise(F.col(f"old.bare.{c}")).alias(c) for c in BRONZE.attributes]
    return wanted.select(*pick, state.alias("state"))


def undefined_requests(updates: DataFrame, silver: DataFrame, retry: bool = True) -> DataFrame:
    """Every token to look up in this run: new, updated but undefined and, with ``retry``, undefined from before."""
    wanted = request_states(updates, silver)
    return (wanted if retry else wanted.where("state <> 'retry'")).drop("state")


def retry_requests(updates: DataFrame, silver: DataFrame) -> DataFrame:
    """Tokens without a definition that no update touches, with their stored statistics: bronze columns.

    Only undefined rows of silver are read past the scan.
    """
    bare = undefined_rows(silver).groupBy("text").agg(F.min(F.struct(*BRONZE.attributes)).alias("bare"))
    untouched = bare.join(updates.select("text"), "text", "left_anti")
    return untouched.select(*[F.col(f"bare.{c}").alias(c) for c in BRONZE.attributes])


def refresh_defined(updates: DataFrame, silver: DataFrame) -> DataFrame:
    """Fresh statistics for every stored definition of an updated token; enriched columns stay as stored."""
    new, old = qualified("new"), qualified("old")
    joined = updates.alias("new").join(defined_rows(silver).alias("old"), new("text") == old("text"), "inner")
    return joined.select(*SILVER.cols(SILVER.copied, new), *SILVER.cols(SILVER.enriched, old))


def fill_enrichment_defaults(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Replace NULL in the enriched columns by the "not found" value of the column's type."""
    filled = {}
    for field in spec.fields(spec.enriched):
        if isinstance(field.dataType, T.StringType):
            default = F.lit(fixed.MISSING_TEXT)
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StringType):
            default = F.array(F.lit(fixed.MISSING_TEXT))
        elif isinstance(field.dataType, T.DoubleType):
            default = F.lit(fixed.MISSING_NUMBER)
        else:
            raise NotImplementedError(f"no default for column {field.name} of type {field.dataType.simpleString()}")
        filled[field.name] = F.coalesce(F.col(field.name), default)
    return df.withColumns(filled)
