import json

import duckdb
import pytest

from helpers import at, frame, plan, rows

from lexlake.operators.highlights import first_marks, parse_highlights
from lexlake.operators.incremental import max_value, new_by_max_key, new_by_watermark
from lexlake.plans.jobs import update_stage
from lexlake.sources.append_tables import CSV_OPTIONS, AppendTable
from lexlake.sources.marks import marks_query, read_marks, read_marks_csv
from lexlake.spec import BRONZE, MARKS, STAGE


def mark(oid, text, title="Emma", authors="Jane Austen", begin="p=1", **extra):
    body = {"text": text, **extra}
    if begin:
        body.update(begin=begin, end="p=2")
    return (oid, json.dumps(body), title, authors, oid * 10)


def test_bookmarks_are_dropped(spark):
    marks = frame(
        spark,
        MARKS,
        mark(1, "Bookmark", begin=None),
        mark(2, 'yacht."'),
        mark(3, "coroner", updated="2019-10-07T16:16:01Z", colour="red"),
        (4, "not json", "Emma", "Jane Austen", 40),
        (5, None, "Emma", "Jane Austen", 50),
    )
    assert rows(parse_highlights(marks), "oid", "text", "timeEdt") == [(2, 'yacht."', 20), (3, "coroner", 30)]


def test_a_bad_time_in_the_json_does_not_drop_the_highlight(spark):
    marks = frame(spark, MARKS, mark(1, "word", updated="yesterday"))
    assert rows(parse_highlights(marks), "text") == [("word",)]


def test_only_marks_above_the_largest_stored_id_are_added(spark, folder):
    stage = AppendTable(spark, STAGE, f"{folder}/stage")
    update_stage(frame(spark, MARKS, mark(8920, "coroner")), stage, at("2021-01-01T01:01:01"))
    more = frame(spark, MARKS, mark(7832, "yacht"), mark(8920, "coroner"), mark(19475, "prickle"))
    result = update_stage(more, stage, at("2021-01-01T01:01:02"))
    assert rows(result, "oid", "text", "updatedAt") == [
        (19475, "prickle", at("2021-01-01T01:01:02")),
        (8920, "coroner", at("2021-01-01T01:01:01")),
    ]


def test_a_run_without_highlights_adds_nothing(spark, folder):
    stage = AppendTable(spark, STAGE, f"{folder}/stage")
    result = update_stage(frame(spark, MARKS, mark(1, "Bookmark", begin=None)), stage, at("2021-01-01T00:00:00"))
    assert rows(result) == []
    assert stage.newest_stamp() is None


def test_text_survives_the_csv_table(spark, folder):
    stage = AppendTable(spark, STAGE, f"{folder}/stage")
    odd = ['line\nbreak, "quoted"', "  padded\t ", "back\\slash\\", "", "\\N?", "naïve — 漢字", 'ends with "']
    marks = [mark(n, text, title=f"The \n{text} book") for n, text in enumerate(odd)]
    result = update_stage(frame(spark, MARKS, *marks), stage, at("2021-01-01T00:00:00"))
    assert {r.oid: (r.text, r.title) for r in result.collect()} == {
        n: (text, f"The \n{text} book") for n, text in enumerate(odd)
    }
    nulls = frame(spark, MARKS, (99, mark(99, "x")[1], None, "", 1))
    again = update_stage(nulls, stage, at("2021-01-02T00:00:00")).where("oid = 99")
    assert rows(again, "title", "authors") == [(None, "")]


def test_partitions_on_disk_are_found_again(spark, folder):
    path = f"{folder}/stage"
    stage = AppendTable(spark, STAGE, path)
    update_stage(frame(spark, MARKS, mark(1, "a")), stage, at("2021-01-01T10:20:30.123456"))
    spark.sql(f"DROP TABLE {stage.full_name}")
    found = AppendTable(spark, STAGE, path)
    assert rows(found.read(), "oid", "updatedAt") == [(1, at("2021-01-01T10:20:30.123456"))]


def test_finding_the_largest_id_reads_the_newest_partition_only(spark, folder):
    stage = AppendTable(spark, STAGE, f"{folder}/stage")
    for day in (1, 2, 3):
        update_stage(frame(spark, MARKS, mark(day, "a")), stage, at(f"2021-01-0{day}T00:00:00"))
    files = stage.latest().inputFiles()
    assert len(files) == 1 and "2021-01-03" in files[0]
    assert max_value(stage.latest(), "oid") == 3


def test_filters_reach_the_scan(spark, folder):
    frame(spark, BRONZE, ("a", ["b"], 1, at("2020-01-01"), at("2020-01-01"), at("2020-01-01"))).write.parquet(
        f"{folder}/t"
    )
    stored = spark.read.parquet(f"{folder}/t")
    by_time = plan(new_by_watermark(stored, stored).select("text"))
    by_key = plan(new_by_max_key(stored, stored, "occurrences").select("text"))
    assert "PushedFilters: [IsNotNull(updatedAt), GreaterThan(updatedAt,2020-01-01" in by_time
    assert "ReadSchema: struct<text:string,updatedAt:timestamp>" in by_time
    assert "PushedFilters: [IsNotNull(occurrences), GreaterThan(occurrences,1)" in by_key


def test_everything_is_new_for_an_empty_target(spark):
    source = frame(spark, BRONZE, {"text": "a", "updatedAt": at("2020-01-01")}, {"text": "b"})
    empty = source.limit(0)
    assert rows(new_by_watermark(source, empty), "text") == [("a",), ("b",)]
    assert rows(new_by_max_key(source, empty, "occurrences"), "text") == [("a",), ("b",)]


def test_the_watermark_is_strict(spark):
    source = frame(spark, BRONZE, *[{"text": t, "updatedAt": at(f"2020-01-0{n}")} for n, t in enumerate("abc", 1)])
    assert rows(new_by_watermark(source, source.where("text <> 'c'")), "text") == [("c",)]


def test_marks_are_joined_to_the_book_of_their_item(spark):
    tags = spark.createDataFrame(
        [(1, 10, 104, "v1", 5), (2, 10, 105, "v2", 5), (3, 12, 104, "v3", 6), (4, 99, 104, "v4", 7)],
        "OID long, ItemID long, TagID int, Val string, TimeEdt long",
    )
    items = spark.createDataFrame([(10, 20), (12, 21), (20, None), (21, None)], "OID long, ParentID long")
    books = spark.createDataFrame([(20, "Emma", "Austen")], "OID long, Title string, Authors string")
    expected = [(1, "v1", "Emma", "Austen", 5)]
    assert rows(read_marks(tags, items, books)) == expected
    database = duckdb.connect()
    for name, df in (("Tags", tags), ("Items", items), ("Books", books)):
        database.register(name, df.toPandas())
    result = database.execute(marks_query())
    assert result.fetchall() == expected
    assert [c[0] for c in result.description] == list(MARKS.attributes)


def test_marks_from_csv_are_ordered_and_checked(spark, folder):
    marks = frame(spark, MARKS, mark(5, "five\nlines"), mark(3, "three"), mark(4, "four"))
    marks.write.options(**CSV_OPTIONS).csv(f"{folder}/marks")
    read = read_marks_csv(spark, f"{folder}/marks")
    assert [r.oid for r in read.collect()] == [3, 4, 5]
    assert rows(parse_highlights(first_marks(read, 2)), "text") == [("four",), ("three",)]


def test_a_name_taken_by_another_folder_is_refused(spark, folder):
    AppendTable(spark, STAGE, f"{folder}/a/lexlake_taken/stage")
    with pytest.raises(ValueError, match="exists at"):
        AppendTable(spark, STAGE, f"{folder}/b/lexlake_taken/stage")
