"""From defined tokens to one record per (normalizedText, definition)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.functions.columns import empty_strings, timestamp_lit
from lexlake.spec import GOLDEN, SILVER, UPDATED_AT, qualified

# definition attributes taken from the newest token of a record
LATEST = tuple(c for c in SILVER.enriched if c not in GOLDEN.pk)


def record_keys(silver: DataFrame) -> DataFrame:
    """The distinct records tokens belong to; a token whose key is partly NULL belongs to none."""
    return silver.select(*GOLDEN.pk).dropna().distinct()


def sibling_forms(silver: DataFrame, updated: DataFrame, broadcast: bool = False) -> DataFrame:
    """All tokens that share a record with an updated one, so its statistics can be recomputed in full.

    The updated keys are made distinct first, so a record with many updated forms is one row there. With ``broadcast``
    (for keys of a checked size) silver is not shuffled.
    """
    touched = record_keys(updated)
    if broadcast:
        touched = F.broadcast(touched)
    return silver.join(touched, list(GOLDEN.pk), "left_semi").select(*silver.columns)


def group_definitions(silver: DataFrame, since: int | None = None) -> DataFrame:
    """Forms, books, counts and range per record; the other attributes come whole from its newest token.

    The newest token wins even where its attribute is NULL; equally new tokens are settled by text, descending. With
    ``since`` (epoch microseconds) only records with a later token remain.

    Both aggregations combine on the map side. Books are made distinct per (record, book) before they are gathered,
    so a record with very many forms spreads over all tasks there and its forms' book lists are never held at once:
    what one task gathers is the record's own row.
    """
    key = list(GOLDEN.pk)
    stats = silver.groupBy(*key).agg(
        F.array_sort(F.collect_set("text")).alias("forms"),
        F.sum("occurrences").alias("occurrences"),
        F.min("firstOccurrence").alias("firstOccurrence"),
        F.max("latestOccurrence").alias("latestOccurrence"),
        F.max_by(F.struct(*LATEST), F.struct(UPDATED_AT, "text")).alias("newest"),
        F.unix_micros(F.max(UPDATED_AT)).alias("touchedAt"),
    )
    if since is not None:
        stats = stats.where(F.col("touchedAt") > since)
    books = (
        silver.select(*key, F.explode("books").alias("book"))
        .distinct()
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list("book")).alias("books"))
    )
    s, b = qualified("s"), qualified("b")
    joined = stats.alias("s").join(books.alias("b"), GOLDEN.key_matches("s", "b"), "left")
    columns = {
        **{c: s(c) for c in (*key, "forms", "occurrences", "firstOccurrence", "latestOccurrence")},
        "books": F.coalesce(b("books"), empty_strings()),
        **{c: F.col(f"s.newest.{c}") for c in LATEST},
    }
    return joined.select(*[columns[c].alias(c) for c in GOLDEN.attributes if c in columns])


def split_new_existing(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records golden lacks, and records it holds: these with fresh statistics and the stored enriched columns."""
    new = classified.where(~F.col("isStored")).drop("isStored", *GOLDEN.enriched)
    return new, classified.where("isStored").drop("isStored")


def classify(grouped: DataFrame, golden: DataFrame) -> DataFrame:
    """Left join to golden: a flag ``isStored`` and the stored enriched columns."""
    g, s = qualified("g"), qualified("stored")
    stored = golden.select(*GOLDEN.pk, *GOLDEN.enriched, F.lit(True).alias("hit")).alias("stored")
    joined = grouped.alias("g").join(stored, GOLDEN.key_matches("g", "stored"), "left")
    return joined.select(
        *[g(c) for c in grouped.columns],
        *GOLDEN.cols(GOLDEN.enriched, s),
        F.coalesce(s("hit"), F.lit(False)).alias("isStored"),
    )


def record_updates(existing: DataFrame, enriched_new: DataFrame, now: datetime) -> DataFrame:
    """One update set: existing records carry typed NULLs where the merge keeps the stored enrichment."""
    blanks = [F.lit(None).cast(f.dataType).alias(f.name) for f in GOLDEN.fields(GOLDEN.enriched)]
    refreshed = existing.select(*GOLDEN.pk, *GOLDEN.transformed, *blanks)
    updates = refreshed.unionByName(enriched_new.select(*GOLDEN.pk, *GOLDEN.transformed, *GOLDEN.enriched))
    return updates.withColumn(UPDATED_AT, timestamp_lit(now)).select(*GOLDEN.attributes)
