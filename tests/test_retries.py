"""When undefined tokens are asked for again."""

from datetime import datetime, timedelta, timezone

import pytest
from helpers import frame, rows
from pyspark.sql import functions as F

from lexlake.operators.retries import RetryPolicy, due_tokens, rescheduled
from lexlake.plans.jobs import update_silver
from lexlake.sources.keyed_tables import KeyedTable
from lexlake.spec import BRONZE, RETRIES, SILVER

START = datetime(2034, 2, 1, tzinfo=timezone.utc)
POLICY = RetryPolicy(timedelta(hours=6), timedelta(hours=30))


def hours(n):
    return START + timedelta(hours=n)


def token(text, now):
    return dict(text=text, books=["b"], occurrences=1, firstOccurrence=START, latestOccurrence=START, updatedAt=now)


def open_tables(spark, folder):
    return KeyedTable(spark, SILVER, f"{folder}/silver", buckets=2), KeyedTable(spark, RETRIES, f"{folder}/retries", buckets=2)


def definer(known, asked):
    def define(tokens):
        asked.append(sorted(r.text for r in tokens.select("text").collect()))
        found = F.when(F.col("text").isin(list(known)), F.col("text"))
        values = {"normalizedText": found, "definition": F.concat(F.lit("what is "), found)}
        missing = [c for c in SILVER.enriched if c not in values]
        nothing = {c: F.lit(None).cast(SILVER.schema[c].dataType) for c in missing}
        return tokens.drop("updatedAt").withColumns({**values, **nothing})

    return define


def test_waits_double_up_to_the_longest(spark):
    waits = spark.range(1, 80).select(POLICY.wait(F.col("id").cast("int")).alias("w"))
    assert [r.w / 3600 for r in waits.collect()] == [6, 12, 24] + [30] * 76


def test_a_schedule_over_runs_and_restarts(spark, folder):
    asked, known = [], set()
    silver, schedule = open_tables(spark, folder)

    def run(at_hour, *texts):
        now = hours(at_hour)
        bronze = frame(spark, BRONZE, *[token(t, now) for t in texts])
        update_silver(bronze, silver, definer(known, asked), now, schedule=schedule, policy=POLICY)
        return asked[-1]

    assert run(0, "moss", "fern") == ["fern", "moss"]
    assert rows(schedule.snapshot(), "text", "attempts") == [("fern", 1), ("moss", 1)]
    assert run(5) == []
    assert run(6) == ["fern", "moss"]
    # twelve hours from now on; a token that an update touches is asked for at once
    assert run(10, "moss") == ["moss"]
    silver, schedule = open_tables(spark, folder)
    assert run(17) == []
    known.add("fern")
    assert run(18) == ["fern"]
    assert rows(schedule.snapshot(), "text", "attempts", "dueAt") == [
        ("fern", 0, None), ("moss", 3, hours(34).replace(tzinfo=None)),
    ]
    assert run(40) == ["moss"]
    assert run(41, "fern") == []


def test_tokens_without_a_schedule_are_due(spark):
    undefined = frame(spark, BRONZE, *[token(t, START) for t in ("a1", "a2", "a3", "a4")])
    times = (hours(-1), hours(0), hours(1), None)
    schedule = frame(spark, RETRIES, *[(f"a{n}", 1, at, START) for n, at in enumerate(times, 2)])
    assert rows(due_tokens(undefined, schedule, START), "text") == [("a1",), ("a2",), ("a3",)]


def test_empty_tables(spark):
    nothing = frame(spark, SILVER)
    assert rescheduled(nothing, frame(spark, RETRIES), START, POLICY).collect() == []
    with pytest.raises(Exception, match="attempts"):
        rescheduled(nothing, frame(spark, BRONZE), START, POLICY)
