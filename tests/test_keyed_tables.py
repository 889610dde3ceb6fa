"""Keyed tables: merges that touch a few buckets, the record of changes, and what survives a run that dies."""

import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from helpers import frame, plan, rows, same
from lexlake.functions.columns import to_micros
from lexlake.operators.incremental import newer_than
from lexlake.operators.merges import merge_accumulate, merge_replace
from lexlake.plans.jobs import update_golden
from lexlake.sources.keyed_tables import KeyedTable
from lexlake.spec import BRONZE, GOLDEN, SILVER, UPDATED_AT

DAY = [datetime(2031, 5, d, tzinfo=timezone.utc) for d in range(1, 29)]


def token(text, n=1, now=DAY[0], book="b"):
    seen = datetime(2030, 1, n % 28 + 1, tzinfo=timezone.utc)
    return {"text": text, "books": [book], "occurrences": n, "firstOccurrence": seen, "latestOccurrence": seen, UPDATED_AT: now}


def tokens(spark, texts, now, **fields):
    return frame(spark, BRONZE, *[token(t, now=now, **fields) for t in texts])


@pytest.fixture
def bronze(spark, folder):
    table = KeyedTable(spark, BRONZE, f"{folder}/bronze", buckets=8)
    table.merge(tokens(spark, [f"w{i}" for i in range(100)], DAY[0]), merge_accumulate, DAY[0])
    return table


def buckets_in(table, version):
    return sorted(n for n in os.listdir(f"{table.folder}/version={version}") if "=" in n)


def test_a_merge_writes_the_buckets_it_touches(spark, bronze):
    before = bronze.snapshot().collect()
    assert len(buckets_in(bronze, 1)) == 8
    update = tokens(spark, ["w7", "brand new"], DAY[1], n=5)
    touched = bronze.touched(update)
    bronze.merge(update, merge_accumulate, DAY[1])
    assert buckets_in(bronze, 2) == sorted(f"bucket={b}" for b in touched) and len(touched) <= 2
    # the whole merge in memory
    want = merge_accumulate(frame(spark, BRONZE, *[tuple(r) for r in before]), update)
    same(bronze.snapshot(), want)
    # and a second table of the session follows
    same(KeyedTable(spark, BRONZE, bronze.path, buckets=8).snapshot(), want)


def test_stored_rows_of_a_merge_are_pruned_and_not_shuffled(spark, bronze):
    update = tokens(spark, ["w7"], DAY[1])
    text = plan(merge_accumulate(bronze.snapshot(bronze.touched(update)), bronze.aligned(update)))
    assert text.count("Exchange hashpartitioning") == 1 and "PartitionFilters: [isnotnull(bucket" in text


def test_followers_read_the_changes_alone(spark, bronze):
    bronze.merge(tokens(spark, ["w1", "w2"], DAY[1]), merge_accumulate, DAY[1])
    fresh = bronze.changes_since(to_micros(DAY[0]))
    same(fresh, newer_than(bronze.snapshot(), to_micros(DAY[0])))
    text = plan(fresh)
    assert "PartitionFilters: [isnotnull(stamp" in text and "/changes]" in text
    assert bronze.changes_since(to_micros(DAY[1])).collect() == []
    assert bronze.changes_since(None).count() == 100
    # several merges, of which the second changes a row again
    bronze.merge(tokens(spark, ["w2", "w3"], DAY[2]), merge_accumulate, DAY[2])
    late = bronze.changes_since(to_micros(DAY[0]))
    same(late, newer_than(bronze.snapshot(), to_micros(DAY[0])))
    assert rows(late, "text", "occurrences") == [("w1", 2), ("w2", 3), ("w3", 2)]
    # who stopped before the record begins has to search
    same(bronze.changes_since(to_micros(DAY[0]) - 1), bronze.snapshot())


def test_a_record_of_bounded_length(spark, folder):
    table = KeyedTable(spark, BRONZE, f"{folder}/short", buckets=2, keep_changes=2)
    for day in range(6):
        table.merge(tokens(spark, [f"w{day}"], DAY[day]), merge_accumulate, DAY[day])
    for since in range(6):
        same(table.changes_since(to_micros(DAY[since])), newer_than(table.snapshot(), to_micros(DAY[since])))
    assert table.manifest().changes == [to_micros(d) for d in DAY[4:6]]
    # and one version back, for readers
    assert len(os.listdir(table.changes_folder)) == 3


def test_a_row_that_gave_way_is_no_change(spark, folder):
    silver = KeyedTable(spark, SILVER, f"{folder}/silver", buckets=4)

    def merge(day, *found):
        silver.merge(frame(spark, SILVER, *[{**token(t, now=DAY[day]), "normalizedText": n, "definition": d} for t, n, d in found]),
                     merge_replace, DAY[day])

    merge(0, ("other", "other", "d"))
    merge(1, ("oak", None, None))
    merge(2, ("oak", "oak", "a tree"))
    same(silver.changes_since(to_micros(DAY[0])), newer_than(silver.snapshot(), to_micros(DAY[0])))
    assert rows(silver.changes_since(to_micros(DAY[0])), "text", "definition") == [("oak", "a tree")]


def test_opening_reads_no_data(spark, bronze):
    spark.sparkContext.setJobGroup("opening", "opening")
    table = KeyedTable(spark, BRONZE, bronze.path)
    assert table.newest_stamp() == to_micros(DAY[0])
    table.changes_since(to_micros(DAY[0]))
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("opening")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_run_that_died(spark, bronze, monkeypatch):
    before = rows(bronze.snapshot())
    with monkeypatch.context() as patch:
        # after the data, before the manifest
        patch.setattr("lexlake.sources.keyed_tables.write_text", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            bronze.merge(tokens(spark, ["w1"], DAY[1]), merge_accumulate, DAY[1])
    assert rows(bronze.snapshot()) == before == rows(KeyedTable(spark, BRONZE, bronze.path).snapshot())
    with monkeypatch.context() as patch:
        # after the manifest, before the catalog
        patch.setattr(KeyedTable, "_point_to", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            bronze.merge(tokens(spark, ["w1"], DAY[2]), merge_accumulate, DAY[2])
    again = KeyedTable(spark, BRONZE, bronze.path)
    assert rows(again.snapshot().where("text = 'w1'"), "occurrences") == [(2,)]
    assert again.newest_stamp() == to_micros(DAY[2])
    again.merge(tokens(spark, ["w1"], DAY[3]), merge_accumulate, DAY[3])
    assert rows(again.snapshot().where("text = 'w1'"), "occurrences") == [(3,)]
    assert rows(again.changes_since(to_micros(DAY[2])), "text", "occurrences") == [("w1", 3)]


def test_folders_that_nobody_needs_go(spark, bronze):
    for day in range(1, 4):
        bronze.merge(tokens(spark, ["w1"], DAY[day]), merge_accumulate, DAY[day])
    (bucket,) = bronze.touched(tokens(spark, ["w1"], DAY[0]))
    # the first version still holds the other buckets, the second nothing
    assert f"bucket={bucket}" not in buckets_in(bronze, 1) and len(buckets_in(bronze, 1)) == 7
    assert sorted(n for n in os.listdir(bronze.folder) if n.startswith("version")) == ["version=1", "version=3", "version=4"]
    assert bronze.snapshot().count() == 100


def test_a_merge_without_rows_notes_its_time(spark, bronze):
    bronze.merge(frame(spark, BRONZE), merge_accumulate, DAY[1])
    assert bronze.newest_stamp() == to_micros(DAY[1]) and bronze.snapshot().count() == 100
    assert KeyedTable(spark, BRONZE, bronze.path).newest_stamp() == to_micros(DAY[1])


def test_replaced_tables_lose_buckets(spark, bronze):
    bronze.replace(tokens(spark, ["only"], DAY[5]))
    assert rows(bronze.snapshot(), "text") == [("only",)]
    assert bronze.newest_stamp() == to_micros(DAY[5])
    same(bronze.changes_since(to_micros(DAY[1])), bronze.snapshot())
    bronze.merge(tokens(spark, ["w50"], DAY[6]), merge_accumulate, DAY[6])
    assert rows(bronze.snapshot(), "text") == [("only",), ("w50",)]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_course_of_merges(spark, folder, seed):
    draw = random.Random(seed)
    table, want, seen = KeyedTable(spark, BRONZE, f"{folder}/any", buckets=4, keep_changes=2), {}, []
    for day in range(6):
        if draw.random() < 0.3:
            table = KeyedTable(spark, BRONZE, f"{folder}/any")
        texts = draw.sample([f"w{i}" for i in range(12)], draw.randint(0, 4))
        table.merge(tokens(spark, texts, DAY[day]), merge_accumulate, DAY[day])
        for t in texts:
            want[t] = (want.get(t, (0, None))[0] + 1, DAY[day].replace(tzinfo=None))
        seen.append(day)
        assert {r.text: (r.occurrences, r[UPDATED_AT]) for r in table.snapshot().collect()} == want
        since = DAY[draw.choice(seen)] - timedelta(seconds=1)
        changed = {r.text for r in table.changes_since(to_micros(since)).collect()}
        assert changed == {t for t, (_, at) in want.items() if at > since.replace(tzinfo=None)}


def test_a_follower_without_changes_keeps_up(spark, folder):
    """Silver's undefined tokens change in every run; golden has no row to change and still falls behind no record."""
    silver = KeyedTable(spark, SILVER, f"{folder}/silver", buckets=2, keep_changes=2)
    golden = KeyedTable(spark, GOLDEN, f"{folder}/golden", buckets=2)
    for day in range(5):
        silver.merge(frame(spark, SILVER, token("unknown", now=DAY[day])), merge_replace, DAY[day])
        assert update_golden(silver, golden, lambda df: df, lambda df: df, DAY[day]).collect() == []
        assert golden.newest_stamp() == to_micros(DAY[day])
    version = golden.manifest().version
    update_golden(silver, golden, lambda df: df, lambda df: df, DAY[9])
    assert golden.manifest().version == version
