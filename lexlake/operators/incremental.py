"""High-water-mark filters: which source rows has the target not seen yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexlake.spec import UPDATED_AT


def max_value(df: DataFrame, column: str) -> int | None:
    """Largest non-NULL value (a timestamp as epoch microseconds), or None for an empty column.

    One partially aggregated row reaches the driver. The value goes back into the plan as a literal, so a filter on
    it is pushed into the scan and prunes partitions.
    """
    top = F.max(column)
    if isinstance(df.schema[column].dataType, T.TimestampType):
        top = F.unix_micros(top)
    return df.agg(top.alias("top")).first()["top"]


def new_by_max_key(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Source rows whose key exceeds the largest stored key; every row when the target is empty."""
    top = max_value(target, key)
    return source if top is None else source.where(F.col(key) > F.lit(top))


def newer_than(source: DataFrame, since: int | None, column: str = UPDATED_AT) -> DataFrame:
    """Source rows stamped strictly later than ``since`` (epoch microseconds); every row when that is None."""
    return source if since is None else source.where(F.col(column) > F.timestamp_micros(F.lit(since)))


def new_by_watermark(source: DataFrame, target: DataFrame, column: str = UPDATED_AT) -> DataFrame:
    """Source rows stamped strictly later than anything in the target; every row when the target is empty."""
    return newer_than(source, max_value(target, column), column)
