import json
import os
from datetime import datetime, timedelta, timezone

import pytest
from helpers import at, frame, rows
from pyspark.sql import functions as F

from lexlake.functions import fixed_values as fixed
from lexlake.operators.enrichment import (
    DEFINITION_POLICY,
    ResponseTable,
    definer,
    remote_lookup,
    table_lookup,
    translator,
    usage_finder,
)
from lexlake.plans.lake import Lake
from lexlake.streaming.arrivals import update_on_arrival
from lexlake.sources.keyed_tables import KeyedTable
from lexlake.spec import BRONZE, MARKS, TEXT, schema

REQUESTS = schema(request=TEXT, response=TEXT)
ENTRIES = f"{fixed.DEFINITION_ENDPOINT}/"
DAY = [None, at("2020-01-01"), at("2020-01-02"), at("2020-01-03"), at("2020-01-04")]


def entry(word, part, definition, example=None):
    sense = {"definition": definition, "synonyms": [], "antonyms": ["a"]}
    if example:
        sense["example"] = example
    return {"word": word, "phonetic": "/x/", "meanings": [{"partOfSpeech": part, "definitions": [sense]}]}


DEFINITIONS = {
    "fern": json.dumps([entry("fern", "noun", "a plant"), entry("fern", "verb", "dip", "ex")]),
    "ferns": json.dumps([entry("fern", "noun", "a plant", "many ferns")]),
}
TRANSLATIONS = {
    "fern": json.dumps(
        [{"displaySource": "Fern", "translations": [{"displayTarget": "папоротник", "posTag": "NOUN", "prefixWord": ""}]}]
    )
}
USAGE = {
    "https://books.google.com/ngrams/json?content=fern_NOUN%3Aeng_2019&year_start=2015&year_end=2019": json.dumps(
        [{"ngram": "fern", "timeseries": [0.1, 0.3]}]
    )
}


def table(spark, answers, prefix=""):
    return table_lookup(frame(spark, REQUESTS, *[(prefix + k, v) for k, v in answers.items()]))


def open_lake(spark, folder, definitions=None, **settings):
    return Lake.at(
        spark,
        folder,
        definer(definitions or table(spark, DEFINITIONS, ENTRIES)),
        translator(table(spark, TRANSLATIONS)),
        usage_finder(table(spark, USAGE)),
        buckets=4,
        **settings,
    )


def marks(spark, *texts):
    data = [(n, json.dumps({"begin": "b", "text": t}), f"B{n}", "A", n) for n, t in enumerate(texts, 1)]
    return frame(spark, MARKS, *data)


def state(lake):
    return {
        "stage": rows(lake.stage.read()),
        "bronze": rows(lake.bronze.snapshot()),
        "silver": rows(lake.silver.snapshot().where("definition is not null")),
        "golden": rows(lake.golden.snapshot()),
        "vocabulary": rows(lake.vocabulary.read()),
        "worklist": rows(lake.worklist.read()),
    }


def test_three_runs(spark, folder):
    lake = open_lake(spark, folder)
    lake.update_all(marks(spark, "fern!zzz", "ferns"), DAY[1])
    first = state(lake)
    assert [r[0] for r in first["bronze"]] == ["fern", "ferns", "zzz"]
    assert rows(lake.golden.snapshot(), "definition", "forms", "translations", "usage", "occurrences") == [
        ("a plant", ("Fern", "fern", "ferns"), ("папоротник",), 0.2, 2),
        ("dip", ("Fern", "fern"), (), None, 1),
    ]
    assert rows(lake.worklist.read(), "text") == [("zzz",)]

    # the same marks again: only the retry of the undefined token is stamped anew
    lake.update_all(marks(spark, "fern!zzz", "ferns"), DAY[2])
    assert state(lake) == first
    assert rows(lake.silver.snapshot().where("definition is null"), "text", "updatedAt") == [("zzz", DAY[2])]

    # a new mark touches the records of its tokens and nothing else
    lake.update_all(marks(spark, "fern!zzz", "ferns", "Ferns, qqq"), DAY[3])
    assert rows(lake.bronze.snapshot(), "text", "occurrences", "updatedAt") == [
        ("fern", 1, DAY[1]),
        ("ferns", 2, DAY[3]),
        ("qqq", 1, DAY[3]),
        ("zzz", 1, DAY[1]),
    ]
    assert rows(lake.golden.snapshot(), "definition", "occurrences", "translations", "usage", "updatedAt") == [
        ("a plant", 3, ("папоротник",), 0.2, DAY[3]),
        ("dip", 1, (), None, DAY[1]),
    ]
    assert rows(lake.vocabulary.read(), "id", "definition", "occurrences", "usage") == [
        (1, "a plant", 3, "20.000000%"),
        (2, "dip", 1, ""),
    ]
    assert rows(lake.worklist.read(), "text") == [("qqq",), ("zzz",)]
    assert len(lake.vocabulary.versions()) == 3 and len(lake.worklist.versions()) == 1


def test_a_lake_is_found_again_after_its_catalog_is_lost(spark, folder):
    lake = open_lake(spark, folder)
    lake.update_all(marks(spark, "fern!zzz", "ferns"), DAY[1])
    before = state(lake)
    for t in (lake.stage, lake.bronze, lake.silver, lake.golden):
        spark.sql(f"DROP TABLE {t.full_name}")
    again = open_lake(spark, folder)
    assert state(again) == before
    again.update_internal(marks(spark, "fern!zzz", "ferns", "fern"), DAY[2])
    assert rows(again.bronze.snapshot().where("text = 'fern'"), "occurrences") == [(2,)]


def test_the_number_of_buckets_cannot_change(spark, folder):
    open_lake(spark, folder)
    table = KeyedTable(spark, BRONZE, f"{folder}/bronze", buckets=4)
    table.replace(table.snapshot())
    with pytest.raises(ValueError, match="holds a table with buckets=4, not buckets=8"):
        KeyedTable(spark, BRONZE, f"{folder}/bronze", buckets=8)


def test_an_unfinished_version_is_passed_over(spark, folder):
    table = KeyedTable(spark, BRONZE, f"{folder}/bronze", buckets=2)
    one = frame(spark, BRONZE, {"text": "a", "occurrences": 1})
    table.replace(one)
    os.makedirs(f"{table.folder}/version=2")
    assert rows(KeyedTable(spark, BRONZE, f"{folder}/bronze", buckets=2).snapshot(), "text") == [("a",)]
    for n in (2, 3, 4):
        table.replace(one.withColumn("occurrences", F.lit(n)))
    assert rows(table.snapshot(), "occurrences") == [(4,)]
    # the version before stays readable, older ones and the unfinished one are gone
    assert sorted(os.listdir(table.folder)) == ["version=4", "version=5"]


def test_a_run_must_be_later_than_the_one_before(spark, folder):
    lake = open_lake(spark, folder)
    lake.update_internal(marks(spark, "fern!zzz"), DAY[2])
    for moment in (DAY[1], DAY[2]):
        with pytest.raises(ValueError, match="not later"):
            lake.update_internal(marks(spark, "fern!zzz", "ferns"), moment)
    assert rows(lake.stage.read(), "text") == [("fern!zzz",)]


def test_user_edits_survive_the_next_publish(spark, folder):
    lake = open_lake(spark, folder)
    lake.update_all(marks(spark, "fern"), DAY[1])
    edited = lake.vocabulary.read().replace("noun", "plant word", "partOfSpeech").replace("new", "learned", "status")
    lake.vocabulary.publish(edited)
    lake.update_all(marks(spark, "fern", "ferns"), DAY[2])
    assert rows(lake.vocabulary.read().where("id = 1"), "status", "partOfSpeech", "occurrences", "forms") == [
        ("learned", "plant word", 2, "fern\n* Fern\n* ferns")
    ]


def test_tokens_found_late_leave_the_worklist(spark, folder):
    """A service that knows a word only from the second run on; answers are kept in a response table."""
    known = ResponseTable(spark, f"{folder}/responses")

    def service(answers):
        def connect(rate):
            return lambda request: (200, answers[request]) if request in answers else (404, None)

        return remote_lookup(known, connect, DEFINITION_POLICY)

    lake = open_lake(spark, f"{folder}/lake_late", service({}))
    lake.update_all(marks(spark, "fern"), DAY[1])
    assert rows(lake.worklist.read(), "text") == [("fern",)]
    lake.define = definer(service({f"{ENTRIES}fern": DEFINITIONS["fern"]}))
    lake.update_all(marks(spark, "fern"), DAY[2])
    assert rows(lake.worklist.read()) == []
    assert rows(lake.silver.snapshot(), "text", "definition") == [("fern", "a plant"), ("fern", "dip")]
    assert rows(known.read(), "request") == [(f"{ENTRIES}fern",)]


def test_a_parquet_stage_gives_the_same_vocabulary(spark, folder):
    lake = open_lake(spark, folder, stage_format="parquet", fill_missing=True)
    lake.update_all(marks(spark, "fern!zzz", "ferns"), DAY[1])
    assert rows(lake.golden.snapshot(), "definition", "occurrences") == [("a plant", 2), ("dip", 1)]
    assert rows(lake.worklist.read(), "text") == [("zzz",)]


def test_arriving_marks_update_the_lake(spark, folder):
    lake = open_lake(spark, f"{folder}/lake_stream")
    days = iter(DAY[1:])
    for texts in (("fern!zzz",), ("fern!zzz", "ferns")):
        marks(spark, *texts).where(f"oid = {len(texts)}").coalesce(1).write.mode("append").parquet(f"{folder}/arrivals")
        stream = spark.readStream.schema(MARKS.schema).parquet(f"{folder}/arrivals")
        update_on_arrival(stream, lake, f"{folder}/checkpoint", lambda: next(days)).awaitTermination(120)
    assert rows(lake.golden.snapshot(), "definition", "occurrences", "updatedAt") == [
        ("a plant", 2, DAY[2]),
        ("dip", 1, DAY[1]),
    ]


def test_marks_may_arrive_in_any_order(spark, folder):
    """Ids 5, then 3, then 4 and 6; an empty batch asks for nothing until the retry is due."""
    asked = []
    lake = open_lake(spark, f"{folder}/lake_late_marks")
    define = lake.define

    def counted(tokens):
        asked.append(sorted(r.text for r in tokens.select("text").collect()))
        return define(tokens)

    lake.define = counted
    days = iter([datetime(2020, 1, d, tzinfo=timezone.utc) for d in range(1, 9)])
    every = marks(spark, "one!", "two!", "three!", "four!", "fern!", "six!")
    for n, ids in enumerate(("5", "3", "4, 6")):
        every.where(f"oid IN ({ids})").coalesce(1).write.mode("append").parquet(f"{folder}/arrivals")
        if n == 0:
            stream = spark.readStream.schema(MARKS.schema).parquet(f"{folder}/arrivals")
        update_on_arrival(
            stream, lake, f"{folder}/checkpoint", lambda: next(days), retry_every=timedelta(days=100)
        ).awaitTermination(120)
    assert rows(lake.stage.read(), "oid") == [(3,), (4,), (5,), (6,)]
    assert rows(lake.bronze.snapshot(), "text") == [("fern",), ("four",), ("six",), ("three",)]
    assert asked[-1] == ["four", "six", "three"] or asked[-1] == ["four", "six"]


def test_jobs_leave_no_scratch_behind(spark, folder):
    work = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(work)) if os.path.exists(work) else set()
    open_lake(spark, folder).update_all(marks(spark, "fern!zzz", "ferns"), DAY[1])
    assert set(os.listdir(work)) == before
