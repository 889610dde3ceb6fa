"""When tokens that stayed undefined are asked for again."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.functions.columns import is_undefined, timestamp_lit
from lexlake.spec import RETRIES, UPDATED_AT


@dataclass(frozen=True)
class RetryPolicy:
    """The first wait, doubled with every attempt up to the longest."""

    first: timedelta = timedelta(days=1)
    longest: timedelta = timedelta(days=64)

    def wait(self, attempts: Column) -> Column:
        """Seconds to wait after so many attempts."""
        doubled = F.lit(float(self.first.total_seconds())) * F.pow(F.lit(2.0), F.least(attempts, F.lit(60)) - 1)
        return F.least(doubled, F.lit(float(self.longest.total_seconds()))).cast("long")


def due_tokens(undefined: DataFrame, schedule: DataFrame, now: datetime) -> DataFrame:
    """Undefined tokens whose next attempt is due at ``now``; those without a schedule are."""
    waiting = schedule.where(F.col("dueAt") > timestamp_lit(now)).select("text")
    return undefined.join(waiting, "text", "left_anti").select(*undefined.columns)


def rescheduled(outcome: DataFrame, schedule: DataFrame, now: datetime, policy: RetryPolicy) -> DataFrame:
    """Schedule rows that a run's looked-up and refreshed tokens change.

    A token that came back without a definition has one attempt more and a later date. One that is defined now, and was
    waiting, is left with no date, so that its attempts start anew if it ever becomes undefined again.
    """
    texts = outcome.groupBy("text").agg(F.bool_or(is_undefined()).alias("open"))
    stored = schedule.select(F.col("text").alias("of_text"), F.col("attempts").alias("before"), "dueAt")
    joined = texts.join(stored, F.col("text") == F.col("of_text"), "left")
    changed = joined.where(F.col("open") | F.col("dueAt").isNotNull())
    attempts = F.when(F.col("open"), F.coalesce("before", F.lit(0)) + 1).otherwise(0).cast("int")
    rows = changed.select("text", "open", attempts.alias("attempts"))
    due = timestamp_lit(now) + F.make_dt_interval(secs=policy.wait(F.col("attempts")))
    return rows.select(
        "text", "attempts", F.when(F.col("open"), due).alias("dueAt"), timestamp_lit(now).alias(UPDATED_AT)
    ).select(*RETRIES.attributes)


def merge_schedule(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates in place of the rows of their tokens."""
    kept = current.join(updates.select("text"), "text", "left_anti")
    return kept.select(*RETRIES.attributes).unionByName(updates.select(*RETRIES.attributes))
