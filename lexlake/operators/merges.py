"""Keyed merges as pure ``(current, updates) -> next state`` functions.

Each is one equi-join on the key the table is bucketed on, so the stored side is not shuffled. The caller writes the
result as the table's next version; nothing is overwritten in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.functions.columns import is_undefined
from lexlake.spec import BRONZE, GOLDEN, SILVER, TableSpec, UPDATED_AT, qualified


def unique_by_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key. Rows that differ outside the key are settled by taking the smallest, on any run the same."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("kept")).select(*key, "kept.*").select(*df.columns)


def merge_accumulate(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Upsert token statistics: add up counts, widen the first/latest range, unite the books (new books first)."""
    old, new = qualified("old"), qualified("new")
    joined = current.alias("old").join(updates.alias("new"), BRONZE.key_matches("old", "new"), "full_outer")
    both = old("text").isNotNull() & new("text").isNotNull()
    merged = {
        "text": F.coalesce(new("text"), old("text")),
        "books": F.when(both, F.array_union(new("books"), old("books"))).otherwise(
            F.coalesce(new("books"), old("books"))
        ),
        "occurrences": F.when(both, new("occurrences") + old("occurrences")).otherwise(
            F.coalesce(new("occurrences"), old("occurrences"))
        ),
        "firstOccurrence": F.least(new("firstOccurrence"), old("firstOccurrence")),
        "latestOccurrence": F.greatest(new("latestOccurrence"), old("latestOccurrence")),
        UPDATED_AT: F.coalesce(new(UPDATED_AT), old(UPDATED_AT)),
    }
    return joined.select(*[merged[c].alias(c) for c in BRONZE.attributes])


def merge_replace(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Upsert whole rows on (text, normalizedText, definition), NULLs equal.

    A stored undefined row also gives way when its text is among the updates: it was queried again.
    """
    spec = SILVER
    same_row = (
        qualified("old")("normalizedText").eqNullSafe(qualified("new")("normalizedText"))
        & qualified("old")("definition").eqNullSafe(qualified("new")("definition"))
    )
    kept = current.alias("old").join(
        updates.select(*spec.pk).alias("new"),
        (qualified("old")("text") == qualified("new")("text"))
        & (same_row | is_undefined(qualified("old")("normalizedText"))),
        "left_anti",
    )
    return kept.select(*spec.attributes).unionByName(updates.select(*spec.attributes))


def merge_partial(current: DataFrame, updates: DataFrame, spec: TableSpec = GOLDEN) -> DataFrame:
    """Upsert on the key: a stored row takes the update's transformed columns and keeps its own enriched ones."""
    old, new = qualified("old"), qualified("new")
    stored = current.withColumn("_stored", F.lit(True)).alias("old")
    joined = stored.join(
        updates.withColumn("_updated", F.lit(True)).alias("new"), spec.key_matches("old", "new"), "full_outer"
    )

    def pick(column: str):
        if column in spec.enriched:
            value = F.when(F.col("_stored"), old(column)).otherwise(new(column))
        else:
            value = F.when(F.col("_updated"), new(column)).otherwise(old(column))
        return value.alias(column)

    return joined.select(*[pick(c) for c in spec.attributes])
