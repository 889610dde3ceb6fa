"""From reader marks to per-token statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.functions.columns import book_label, clean_token, epoch_to_timestamp, token_array
from lexlake.spec import MARK_JSON


def parse_highlights(marks: DataFrame) -> DataFrame:
    """Flatten the JSON of each mark; marks without a beginning are bookmarks and are dropped."""
    parsed = marks.withColumn("mark", F.from_json("val", MARK_JSON))
    return parsed.where(F.col("mark.begin").isNotNull()).select(
        "oid", F.col("mark.text").alias("text"), "title", "authors", "timeEdt"
    )


def tokens(highlights: DataFrame, strict: bool = False) -> DataFrame:
    """One row per token occurrence: (text, book, seenAt).

    Tokens of one character are dropped. Length is measured before trimming, as the reader's users expect ``" a"`` to
    survive; ``strict`` measures it after.
    """
    # label and time are made once per highlight, below the explode, not once per token
    labelled = highlights.select(
        token_array(F.col("text")).alias("tokens"),
        book_label(F.col("title"), F.col("authors")).alias("book"),
        epoch_to_timestamp(F.col("timeEdt")).alias("seenAt"),
    )
    pieces = labelled.select(F.explode("tokens").alias("token"), "book", "seenAt")
    kept = pieces.where(F.length("token") > 1).select(clean_token(F.col("token")).alias("text"), "book", "seenAt")
    return kept.where(F.length("text") > 1) if strict else kept


def tokens_by_text(highlights: DataFrame, strict: bool = False) -> DataFrame:
    """Books, occurrence count and first/latest sighting of every token.

    Two aggregations. The first, by (token, book), is a plain hash aggregate with map-side combine and spreads even a
    token found in every highlight over all tasks; the second sees only a token's distinct books.
    """
    per_book = (
        tokens(highlights, strict)
        .groupBy("text", "book")
        .agg(F.count(F.lit(1)).alias("n"), F.min("seenAt").alias("first"), F.max("seenAt").alias("latest"))
    )
    return per_book.groupBy("text").agg(
        F.array_sort(F.collect_list("book")).alias("books"),
        F.sum("n").alias("occurrences"),
        F.min("first").alias("firstOccurrence"),
        F.max("latest").alias("latestOccurrence"),
    )


def top_tokens(bronze: DataFrame, n: int | None = None) -> DataFrame:
    """Most highlighted tokens first; ``n`` makes it a top-n report."""
    ranked = bronze.orderBy(F.desc("occurrences"), "text")
    return ranked if n is None else ranked.limit(n)


def first_marks(marks: DataFrame, n: int) -> DataFrame:
    """The ``n`` marks with the lowest ids: replays a growing device database."""
    return marks.orderBy("oid").limit(n)
