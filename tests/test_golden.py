import pytest
from helpers import at, frame, plan, rows, same
from pyspark.sql import functions as F

from lexlake.operators.merges import merge_partial
from lexlake.operators.publish import pair_states
from lexlake.operators.vocabulary import classify, group_definitions, record_updates, sibling_forms, split_new_existing
from lexlake.plans import jobs
from lexlake.plans.jobs import update_golden
from lexlake.sources.keyed_tables import KeyedTable
from lexlake.spec import GOLDEN, SILVER, VOCABULARY_SHEET

Y = {y: at(f"{y}-03-05T07:08:09") for y in range(1999, 2027)}


def form(text, definition, stamp, word="oak", pos="noun", seen=2000, n=1, book=None, phonetic="/əʊk/", examples=()):
    return dict(
        text=text,
        books=[book or f"{text} Book"],
        occurrences=n,
        firstOccurrence=Y[seen],
        latestOccurrence=Y[seen],
        updatedAt=Y[stamp],
        normalizedText=word,
        phonetic=phonetic,
        partOfSpeech=pos,
        definition=definition,
        examples=list(examples),
        synonyms=[],
        antonyms=[],
    )


def record(
    definition, stamp, forms, word="oak", pos="noun", n=1, first=2000, latest=2000, translations=("t",), usage=1.0
):
    return dict(
        normalizedText=word,
        partOfSpeech=pos,
        phonetic="/əʊk/",
        forms=list(forms),
        books=[f"{f} Book" for f in forms],
        occurrences=n,
        firstOccurrence=Y[first],
        latestOccurrence=Y[latest],
        definition=definition,
        examples=[],
        synonyms=[],
        antonyms=[],
        translations=None if translations is None else list(translations),
        usage=usage,
        updatedAt=Y[stamp],
    )


def translate(seen):
    def run(df):
        seen.extend(rows(df, "normalizedText", "definition"))
        return df.withColumn("translations", F.array(F.concat("normalizedText", F.lit(" translated"))))

    return run


def find_usage(df):
    assert "translations" in df.columns
    return df.withColumn("usage", F.lit(1.0))


def golden_with(spark, folder, *stored):
    table = KeyedTable(spark, GOLDEN, f"{folder}/golden", buckets=4)
    if stored:
        table.replace(frame(spark, GOLDEN, *stored))
    return table


def test_newest_form_gives_the_attributes_and_all_forms_the_statistics(spark):
    """By rule: attributes of the newest form, NULLs too; sums, ranges and sets over all forms of a record."""
    forms = [
        form("mills", "grinding house", 2024, word="mill", n=4, seen=2003, book="Grain"),
        form("Mill", "grinding house", 2026, word="mill", n=6, seen=2001, book="Water", examples=["by the mill"]),
        form("milled", "to grind", 2025, word="mill", pos="verb", n=3, seen=2004, book="Grain", examples=["milled flour"]),
        form("milling", "to grind", 2026, word="mill", pos=None, phonetic=None, n=5, seen=2002, book="Grain"),
        form("mill", "grinding house", 2020, word="miller", n=9, seen=2000, book="Names"),
    ]
    got = {(r.normalizedText, r.definition): r for r in group_definitions(frame(spark, SILVER, *forms)).collect()}
    assert set(got) == {(f["normalizedText"], f["definition"]) for f in forms}
    for key, record_ in got.items():
        mine = [f for f in forms if (f["normalizedText"], f["definition"]) == key]
        newest = max(mine, key=lambda f: f["updatedAt"])
        for column in ("partOfSpeech", "phonetic", "examples"):
            assert record_[column] == newest[column]
        assert record_.occurrences == sum(f["occurrences"] for f in mine)
        assert record_.firstOccurrence == min(f["firstOccurrence"] for f in mine)
        assert record_.latestOccurrence == max(f["latestOccurrence"] for f in mine)
        assert record_.forms == sorted(f["text"] for f in mine)
        assert record_.books == sorted({b for f in mine for b in f["books"]})


def test_equally_new_forms_are_settled_by_text(spark):
    data = [form("a", "d", 2020, pos="noun"), form("b", "d", 2020, pos=None), form("c", "d", 2019, pos="verb")]
    for part in (data, data[::-1]):
        assert rows(group_definitions(frame(spark, SILVER, *part)), "partOfSpeech") == [(None,)]


def test_first_run_groups_translates_and_inserts(spark, folder):
    """Two forms make one record; rows whose key is NULL in part, or as a whole, make none."""
    golden = golden_with(spark, folder)
    silver = frame(
        spark,
        SILVER,
        form("oaks", "a tree", 2020, seen=2001, n=3),
        form("oak", "a tree", 2022, seen=1999, n=4),
        form("acorn", "its fruit", 2021, word=None),
        {**form("bark", None, 2021), "definition": None},
        {**form("root", None, 2021, word=None), "definition": None},
    )
    seen = []
    result = update_golden(silver, golden, translate(seen), find_usage, Y[2023])
    assert seen == [("oak", "a tree")]
    expected = record("a tree", 2023, ["oak", "oaks"], n=7, first=1999, latest=2001, translations=["oak translated"])
    same(result, frame(spark, GOLDEN, expected))


@pytest.mark.parametrize("broadcast_limit", [0, 1 << 20])
def test_later_run_refreshes_statistics_and_keeps_enrichment(spark, folder, monkeypatch, broadcast_limit):
    """Both ways to find the touched records: broadcast keys, and grouping everything."""
    monkeypatch.setattr(jobs, "BROADCAST_LIMIT", broadcast_limit)
    untouched = record("quiet", 2022, ["calm"], word="calm", translations=["kept"])
    golden = golden_with(spark, folder, record("a tree", 2022, ["oak"], translations=["stored"], usage=0.5), untouched)
    silver = frame(
        spark,
        SILVER,
        form("oak", "a tree", 2021, seen=1999),
        form("oaks", "a tree", 2023, seen=2001),
        form("calm", "quiet", 2021, word="calm"),
        form("brisk", "quick", 2023, word="brisk"),
    )
    seen = []
    result = update_golden(silver, golden, translate(seen), find_usage, Y[2024])
    assert seen == [("brisk", "quick")]
    same(
        result,
        frame(
            spark,
            GOLDEN,
            record("a tree", 2024, ["oak", "oaks"], n=2, first=1999, latest=2001, translations=["stored"], usage=0.5),
            record("quick", 2024, ["brisk"], word="brisk", translations=["brisk translated"]),
            untouched,
        ),
    )


def test_nothing_changes_without_updates(spark, folder):
    golden = golden_with(spark, folder, record("a tree", 2022, ["oak"]))
    files = golden.snapshot().inputFiles()
    silver = frame(spark, SILVER, form("oak", "a tree", 2021))
    result = update_golden(silver, golden, translate([]), find_usage, Y[2024])
    same(result, frame(spark, GOLDEN, record("a tree", 2022, ["oak"])))
    assert golden.snapshot().inputFiles() == files


def test_sibling_forms_need_a_whole_key(spark):
    silver = frame(
        spark,
        SILVER,
        form("a", "d", 2020),
        form("b", "d", 2021),
        form("c", "e", 2020),
        form("n", None, 2021),
        form("m", "x", 2021, word=None),
    )
    updated = silver.where(F.col("updatedAt") > F.lit(Y[2020]))
    for broadcast in (False, True):
        assert rows(sibling_forms(silver, updated, broadcast), "text") == [("a",), ("b",)]


def test_split_keeps_stored_enrichment_beside_fresh_statistics(spark):
    grouped = group_definitions(frame(spark, SILVER, form("a", "d", 2020, n=5), form("b", "e", 2020)))
    golden = frame(spark, GOLDEN, record("d", 2019, ["old"], translations=["kept"], usage=0.5))
    new, existing = split_new_existing(classify(grouped, golden))
    assert rows(new, "definition", "forms") == [("e", ("b",))]
    kept = rows(existing, "definition", "forms", "occurrences", "translations", "usage")
    assert kept == [("d", ("a",), 5, ("kept",), 0.5)]
    enriched = new.withColumns({"translations": F.array(F.lit("n")), "usage": F.lit(0.1)})
    updates = record_updates(existing, enriched, Y[2024])
    assert updates.schema.simpleString() == frame(spark, GOLDEN).schema.simpleString()
    assert rows(updates, "definition", "translations", "usage") == [("d", None, None), ("e", ("n",), 0.1)]


def test_partial_merge(spark):
    current = frame(spark, GOLDEN, record("d", 2019, ["a"], translations=["kept"]), record("quiet", 2019, ["q"]))
    updates = frame(
        spark,
        GOLDEN,
        record("d", 2020, ["a", "b"], n=9, pos=None, translations=None, usage=None),
        record("new", 2020, ["n"], usage=0.3),
    )
    same(
        merge_partial(current, updates),
        frame(
            spark,
            GOLDEN,
            record("d", 2020, ["a", "b"], n=9, pos=None, translations=["kept"]),
            record("new", 2020, ["n"], usage=0.3),
            record("quiet", 2019, ["q"]),
        ),
    )
    same(merge_partial(current, updates.limit(0)), current)


def test_the_stored_records_are_not_shuffled(spark, folder):
    golden = golden_with(spark, folder, record("a tree", 2022, ["oak"]))
    updates = frame(spark, GOLDEN, record("a tree", 2023, ["oak"]))
    grouped = updates.drop("translations", "usage", "updatedAt")
    published = spark.createDataFrame([], VOCABULARY_SHEET.schema).union(
        spark.range(1).select(*[F.lit("1").cast(f.dataType) for f in VOCABULARY_SHEET.schema.fields])
    )
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = plan(merge_partial(golden.snapshot(), golden.aligned(updates)))
        classified = plan(classify(golden.aligned(grouped), golden.snapshot()))
        paired = plan(pair_states(golden.aligned(published), golden.snapshot()).where("p.id > 0 or g.occurrences > 0"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    for text in (merged, classified):
        assert "Bucketed: true" in text
        assert text.count("Exchange") == text.count("REPARTITION_BY_NUM") == 1
    # rows with and without a whole key are read apart; only the sheet's move
    assert "Bucketed: true" in paired and paired.count("Exchange") == paired.count("REPARTITION_BY_NUM")


def test_grouping_combines_before_it_shuffles_and_uses_no_window(spark):
    text = plan(group_definitions(frame(spark, SILVER, form("a", "d", 2020))))
    assert "Window" not in text
    assert "partial_collect_set" in text and "partial_max_by" in text and "partial_collect_list" in text


def test_a_record_with_a_third_of_all_forms(spark):
    silver = spark.range(30_000).selectExpr(
        "concat('form', id) AS text",
        "array(concat('Book', id % 20), 'Shared') AS books",
        "1 AS occurrences",
        "timestamp_seconds(id) AS firstOccurrence",
        "timestamp_seconds(id) AS latestOccurrence",
        "timestamp_seconds(id) AS updatedAt",
        "CASE WHEN id % 3 = 0 THEN 'the' ELSE concat('word', id) END AS normalizedText",
        "CAST(NULL AS string) AS phonetic",
        "CASE WHEN id = 29997 THEN 'newest' END AS partOfSpeech",
        "'d' AS definition",
        "array('e') AS examples",
        "array('s') AS synonyms",
        "array('a') AS antonyms",
    )
    hot = group_definitions(silver).where("normalizedText = 'the'").first()
    assert len(hot["forms"]) == 10_000 == hot["occurrences"]
    assert len(hot["books"]) == 21 and hot["partOfSpeech"] == "newest"
