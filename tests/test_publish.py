import os
import random
import time

import pytest
from helpers import at, frame, plan, rows, same
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lexlake.functions import fixed_values as fixed
from lexlake.functions.columns import merge_cell, usage_percent
from lexlake.operators.ids import assign_ids
from lexlake.operators.publish import ARRAY_CELLS, by_id, grown_rows, pair_states, reconcile
from lexlake.operators.sheets import InvalidSheetError, read_sheet
from lexlake.operators.worklist import contained_texts, render_worklist, unpublished
from lexlake.plans.jobs import publish_csv, update_vocabulary, update_worklist
from lexlake.session import written
from lexlake.sources.append_tables import SnapshotTable
from lexlake.sources.sheet_store import SheetStore, read_csv_sheet
from lexlake.spec import (
    DOUBLE,
    GOLDEN,
    INT,
    LONG,
    SILVER,
    TEXT,
    TEXTS,
    TIME,
    VOCABULARY_CSV,
    VOCABULARY_SHEET,
    WORKLIST_SHEET,
    TableSpec,
    schema,
)

SEP = "\n* "


def golden_record(word, definition, first, latest=None, pos="noun", forms=(), books=(), n=1, usage=1.0, **lists):
    return dict(
        normalizedText=word,
        definition=definition,
        partOfSpeech=pos,
        phonetic=f"/{word}/" if pos else None,
        forms=list(forms),
        books=list(books),
        occurrences=n,
        firstOccurrence=at(first),
        latestOccurrence=at(latest or first),
        examples=lists.get("examples", []),
        synonyms=lists.get("synonyms", []),
        antonyms=lists.get("antonyms", []),
        translations=lists.get("translations", []),
        usage=usage,
        updatedAt=at("2010-01-01"),
    )


def sheet_row(id, word, definition, **cells):
    row = dict.fromkeys(VOCABULARY_SHEET.attributes, "")
    return {**row, "id": id, "status": "new", "normalizedText": word, "definition": definition, "occurrences": 1, **cells}


HERON = golden_record(
    "heron",
    "wading bird",
    "2027-04-02T10:20:30",
    "2029-08-09T11:12:13",
    forms=["Heron", "herons", "heron's"],
    books=["Fens", "Marshes"],
    n=14,
    examples=["a heron stood in the reeds", "herons nest in trees"],
    synonyms=["egret"],
    translations=["цапля"],
)
TERSE = golden_record(
    "terse", "short in words", "2028-01-31T00:00:09", pos="adjective", forms=["terse"], books=["Letters"], usage=0.125,
    antonyms=["wordy", "long-winded"],
)


def test_first_publish_numbers_by_first_occurrence(spark):
    """Golden's columns become cells: lists joined, times and shares written out, user cells empty."""
    published = reconcile(frame(spark, VOCABULARY_SHEET), frame(spark, GOLDEN, TERSE, HERON), " / ")
    heron, terse = sorted(published.collect(), key=lambda r: r.id)
    assert (heron.id, heron.normalizedText, terse.id, terse.normalizedText) == (1, "heron", 2, "terse")
    for row, record in ((heron, HERON), (terse, TERSE)):
        for cell, column in ARRAY_CELLS.items():
            assert row[cell] == " / ".join(record[column])
        for time in ("firstOccurrence", "latestOccurrence"):
            assert row[time] == record[time].strftime("%Y-%m-%d %H:%M:%S")
        for same_cell in ("definition", "partOfSpeech", "phonetic", "occurrences"):
            assert row[same_cell] == record[same_cell]
        assert (row.status, row.tags, row.notes) == ("new", "", "")
    assert (heron.usage, terse.usage) == ("100.000000%", "12.500000%")


def test_user_edits_win_and_lists_unite(spark):
    """Row 3 has every text cell edited, row 5 blanks, row 8 is unknown to golden; three records are new."""
    edited = sheet_row(
        3, "heron", "wading bird", status="known well", partOfSpeech="a bird", phonetic="", forms="grey heron",
        sources=f"Marshes{SEP}a walk", examples="seen today", usage="often", occurrences=2, tags="fens; birds",
        notes="look for nests", firstOccurrence="some day",
    )
    blank = sheet_row(5, "give in", "to yield", partOfSpeech="phrase", forms="give in", firstOccurrence="  ", occurrences=6)
    unknown = sheet_row(8, "mine", "by hand", sources="my own", occurrences=11)
    golden = frame(
        spark,
        GOLDEN,
        golden_record("third", "newest", "2031-01-01"),
        HERON,
        TERSE,
        golden_record("give in", "to yield", "2026-05-05T05:05:05", pos=None, forms=["gave in", "give in"], usage=None),
        golden_record("first", "oldest", "2025-01-01"),
    )
    result = {r.id: r for r in reconcile(frame(spark, VOCABULARY_SHEET, blank, unknown, edited), golden).collect()}
    assert {i: r.normalizedText for i, r in result.items()} == {
        3: "heron", 5: "give in", 8: "mine", 9: "first", 10: "terse", 11: "third",
    }
    heron, give_in, mine = (result[i] for i in (3, 5, 8))
    # text cells are the user's, empty ones too; counts and times are golden's; lists are the user's entries and what they lack
    for cell in ("status", "partOfSpeech", "phonetic", "usage", "tags", "notes"):
        assert heron[cell] == edited[cell]
    assert (heron.occurrences, heron.firstOccurrence) == (14, "2027-04-02 10:20:30")
    assert heron.sources.split(SEP) == ["Marshes", "a walk", "Fens"]
    assert heron.forms.split(SEP) == ["grey heron", "Heron", "herons", "heron's"]
    assert heron.examples.split(SEP) == ["seen today", *HERON["examples"]]
    assert (heron.synonyms, heron.translations) == ("egret", "цапля")
    assert (give_in.partOfSpeech, give_in.forms.split(SEP)) == ("phrase", ["give in", "gave in"])
    assert (give_in.occurrences, give_in.firstOccurrence, give_in.usage) == (1, "2026-05-05 05:05:05", "")
    assert mine.asDict() == {**unknown, "id": 8}


def test_rows_without_a_whole_key_match_nothing_and_stay(spark):
    published = frame(spark, VOCABULARY_SHEET, sheet_row(1, "a", "d"), sheet_row(2, None, "d"))
    golden = frame(spark, GOLDEN, golden_record("a", "d", "2000-01-01"), golden_record(None, "d", "2000-01-01"))
    pairs = pair_states(published, golden).select(F.col("p.id"), F.col("g.occurrences"))
    assert rows(pairs) == [(None, 1), (1, 1), (2, None)]


def test_cells(spark):
    df = frame(spark, schema(p=TEXT, g=TEXTS), ("", ["a"]), (None, None), (f"b{SEP}a{SEP}b", ["a", "c"]))
    merged = [r[0] for r in df.select(merge_cell(F.col("p"), F.col("g"))).collect()]
    assert merged == ["a", "", f"b{SEP}a{SEP}c"]
    kept = [r[0] for r in df.select(merge_cell(F.col("p"), F.col("g"), keep_empty=True)).collect()]
    assert kept == [f"{SEP}a", "", f"b{SEP}a{SEP}c"]
    dotted = frame(spark, schema(p=TEXT, g=TEXTS), ("x.y", ["z"]))
    assert dotted.select(merge_cell(F.col("p"), F.col("g"), ".")).first()[0] == "x.y.z"
    numbers = frame(spark, schema(u=DOUBLE), (1234.5,), (0.25,), (None,))
    assert rows(numbers.select(usage_percent(F.col("u")))) == [(None,), ("123,450.000000%",), ("25.000000%",)]


def test_ids_are_consecutive_in_order_over_many_partitions(spark):
    values = random.Random(7).sample(range(100_000), 5_000)
    df = spark.createDataFrame([(v // 1000, v) for v in values], "k long, v long").repartition(16)
    numbered = assign_ids(df, [F.col("k"), F.col("v")], offset=10)
    assert [r.v for r in numbered.orderBy("id").collect()] == sorted(values)
    assert rows(numbered.agg(F.min("id"), F.max("id"), F.count_distinct("id"))) == [(11, 5010, 5000)]
    assert rows(assign_ids(df.limit(0), [F.col("v")])) == []


def test_ids_when_a_third_of_the_rows_tie(spark):
    df = spark.range(9_000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k", "id AS v").repartition(12)
    numbered = assign_ids(df, [F.col("k"), F.col("v")])
    order = sorted(((0 if v % 3 == 0 else v), v) for v in range(9_000))
    assert [r.v for r in numbered.orderBy("id").collect()] == [v for _, v in order]
    assert "SinglePartition" not in plan(numbered)


# ---- sheets -------------------------------------------------------------------------------------------------------

SMALL = TableSpec("small", schema(id=INT, name=TEXT, seen=TIME, note=TEXT), pk=("id",))


def cells(spark, *data):
    return frame(spark, schema(cells=TEXTS), *[(list(d),) for d in data])


def test_short_rows_are_padded_and_cells_typed(spark):
    sheet = cells(spark, ("1", "a", "2020-01-02 03:04:05", "n"), ("2", None, "2020-01-02 00:00:00"))
    assert rows(read_sheet(sheet, ["id", "name", "seen", "note"], SMALL)) == [
        (1, "a", at("2020-01-02T03:04:05"), "n"),
        (2, "", at("2020-01-02"), ""),
    ]


def test_a_wrong_layout_raises(spark):
    with pytest.raises(InvalidSheetError, match="id, name does not match"):
        read_sheet(cells(spark, ("1",)), ["id", "name"], SMALL)
    header = ["id", "name", "seen", "note"]
    with pytest.raises(Exception, match="row has 5 cells"):
        read_sheet(cells(spark, ("1", "a", "2020-01-01 00:00:00", "n", "x")), header, SMALL).collect()
    with pytest.raises(Exception, match="column id is not of type int: 'one'"):
        read_sheet(cells(spark, ("one", "a", "2020-01-01 00:00:00")), header, SMALL).collect()


def test_a_sheet_edited_elsewhere(spark, folder):
    def sheet(name, *lines):
        os.makedirs(f"{folder}/{name}")
        with open(f"{folder}/{name}/part.csv", "w") as f:
            f.write("\n".join(lines) + "\n")
        return read_csv_sheet(spark, f"{folder}/{name}", WORKLIST_SHEET)

    header = "text,books,occurrences,firstOccurrence,latestOccurrence"
    assert rows(sheet("short", header, "a,b,3", '"two\nlines",,4,x,y')) == [
        ("a", "b", 3, "", ""),
        ("two\nlines", "", 4, "x", "y"),
    ]
    with pytest.raises(Exception, match="row has 6 cells"):
        sheet("wide", header, "a,b,3,x,y,z").collect()
    for name, line, n in (("gap", "a,b,1,x,y,,EXTRA", 7), ("one_more", "a,b,1,x,y,EXTRA", 6), ("blank", "a,b,1,x,y,,", 7)):
        with pytest.raises(Exception, match=f"row has {n} cells"):
            sheet(name, header, line).collect()
    with pytest.raises(Exception, match="column occurrences is not of type bigint"):
        sheet("untyped", header, "a,b,many,x,y").collect()
    with pytest.raises(InvalidSheetError, match="word, books"):
        sheet("renamed", header.replace("text", "word"), "a,b,3,x,y")


def test_every_file_of_a_sheet_has_its_header_checked(spark, folder):
    os.makedirs(f"{folder}/two")
    header = "text,books,occurrences,firstOccurrence,latestOccurrence"
    with open(f"{folder}/two/part-0.csv", "w") as f:
        f.write(f"{header}\na,b,3,x,y\n")
    with open(f"{folder}/two/part-1.csv", "w") as f:
        f.write(f"{header}\nc,d,4,x,y\n")
    assert rows(read_csv_sheet(spark, f"{folder}/two", WORKLIST_SHEET), "text") == [("a",), ("c",)]
    with open(f"{folder}/two/part-2.csv", "w") as f:
        f.write("books,text,occurrences,firstOccurrence,latestOccurrence\nd,c,4,x,y\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv_sheet(spark, f"{folder}/two", WORKLIST_SHEET).collect()


def test_quoted_cells_count_as_one(spark, folder):
    """Short rows, whose cells are counted in the raw text: commas, quotes and line breaks inside cells."""
    os.makedirs(f"{folder}/quoted")
    with open(f"{folder}/quoted/part.csv", "w") as f:
        f.write('text,books,occurrences,firstOccurrence,latestOccurrence\n"a, b","c,\nd, e, f, g",7\n"x","y \\"z\\", w",8\n')
    found = rows(read_csv_sheet(spark, f"{folder}/quoted", WORKLIST_SHEET), "text", "books", "occurrences")
    assert found == [("a, b", "c,\nd, e, f, g", 7), ("x", 'y "z", w', 8)]


def worklist_row(text, forms_hint=""):
    return dict(text=text, books=forms_hint, occurrences=1, firstOccurrence="x", latestOccurrence="y")


def test_publishing_keeps_backups_and_replaces_the_sheet(spark, folder):
    store = SheetStore(spark, WORKLIST_SHEET, f"{folder}/sheet", keep=2)
    assert rows(store.read()) == []
    for n in range(5):
        store.publish(frame(spark, WORKLIST_SHEET, worklist_row(f"text {n}")))
    assert rows(store.read(), "text") == [("text 4",)]
    assert [rows(store.read(v), "text")[0][0] for v in store.versions()] == ["text 2", "text 3", "text 4"]
    none = SheetStore(spark, WORKLIST_SHEET, f"{folder}/bare", keep=0)
    for n in range(3):
        none.publish(frame(spark, WORKLIST_SHEET, worklist_row(f"text {n}")))
    assert len(none.versions()) == 1
    with pytest.raises(ValueError):
        SheetStore(spark, WORKLIST_SHEET, f"{folder}/x", keep=-1)


def test_an_unfinished_write_does_not_count(spark, folder):
    store = SheetStore(spark, WORKLIST_SHEET, f"{folder}/sheet")
    store.publish(frame(spark, WORKLIST_SHEET, worklist_row("good")))
    broken = F.raise_error(F.lit("broken")).cast("string")
    failing = frame(spark, WORKLIST_SHEET, worklist_row("bad")).withColumn("text", broken)
    with pytest.raises(Exception, match="broken"):
        store.publish(failing)
    os.makedirs(f"{folder}/sheet/version=7")
    assert rows(store.read(), "text") == [("good",)]
    store.publish(frame(spark, WORKLIST_SHEET, worklist_row("better")))
    assert rows(store.read(), "text") == [("better",)]


def test_cells_survive_the_sheet(spark, folder):
    store = SheetStore(spark, WORKLIST_SHEET, f"{folder}/sheet")
    odd = [' lead', 'q"uote', "two\nlines", "", None, "comma, here", "back\\"]
    data = [worklist_row(f"t{n}", value) for n, value in enumerate(odd)]
    published = store.publish(frame(spark, WORKLIST_SHEET, *data))
    assert [r.books for r in published.orderBy("text").collect()] == [v or "" for v in odd]


def test_publishing_the_vocabulary_twice_changes_nothing(spark, folder):
    store = SheetStore(spark, VOCABULARY_SHEET, f"{folder}/vocabulary")
    golden = frame(spark, GOLDEN, HERON, TERSE)
    first = rows(update_vocabulary(golden, store))
    assert [r[0] for r in first] == [1, 2]
    assert rows(update_vocabulary(golden, store)) == first
    assert grown_rows(store.read(1), store.read(2)) == 0
    assert [r.id for r in store.read().collect()] == [1, 2]


def test_sheets_are_stored_compressed_and_read_beside_plain_ones(spark, folder):
    published = frame(spark, VOCABULARY_SHEET, *[sheet_row(i, f"w{i}", "wrapped\nline, \"quoted\"") for i in range(1, 400)])
    packed = SheetStore(spark, VOCABULARY_SHEET, f"{folder}/sheet")
    same(packed.publish(published), published)
    plain = SheetStore(spark, VOCABULARY_SHEET, f"{folder}/sheet", compression="none")
    same(plain.publish(published), packed.read(1))
    size = [sum(os.path.getsize(f"{at_}/{f}") for at_, _, fs in os.walk(f"{folder}/sheet/version={v}") for f in fs) for v in (1, 2)]
    assert 2 * size[0] < size[1]
    table = SnapshotTable(spark, VOCABULARY_CSV, f"{folder}/packed", compression="gzip")
    publish_csv(frame(spark, GOLDEN, TERSE, HERON), table, at("2031-03-01"))
    assert publish_csv(frame(spark, GOLDEN, TERSE, HERON), table, at("2031-03-02")).count() == 2
    files = [f for _, _, names in os.walk(f"{folder}/packed") for f in names if ".csv" in f and not f.startswith(".")]
    assert files and all(f.endswith(".csv.gz") for f in files)


def test_what_is_written_leaves_no_shuffle_files(spark, folder):
    """Also where the query was put together long before; a setting of the caller's comes back."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {f for f in manager.getAllFiles().mkString("|").split("|") if "/shuffle_" in f}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting)
    counts = spark.range(10_000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count()
    before = shuffled()
    stored = written(counts, "counts")
    store = SheetStore(spark, WORKLIST_SHEET, f"{folder}/sheet")
    store.publish(frame(spark, WORKLIST_SHEET, worklist_row("a"), worklist_row("b")).orderBy("text"))
    end = time.monotonic() + 10
    while (left := shuffled() - before) and time.monotonic() < end:
        time.sleep(0.2)
    assert not left and stored.count() == 7
    assert spark.conf.get(setting) == was


def test_snapshots_keep_their_history_in_one_file_each(spark, folder):
    spec = TableSpec("snaps", schema(id=LONG, updatedAt=TIME), pk=("id",))
    table = SnapshotTable(spark, spec, f"{folder}/snaps", output_files=1)
    assert rows(table.snapshot()) == []
    table.write(spark.range(1000).repartition(10), at("2020-01-01"))
    assert table.write(spark.range(500).repartition(10), at("2021-01-01")).count() == 500
    assert table.history().count() == 1500
    parts = [f for _, _, files in os.walk(f"{folder}/snaps") for f in files if f.endswith(".csv")]
    assert len(parts) == 2


def test_csv_snapshots_keep_edits_and_use_one_file_each(spark, folder):
    """The newest snapshot is the sheet that golden is merged into; CSV cells use their own separator."""
    table = SnapshotTable(spark, VOCABULARY_CSV, f"{folder}/published", output_files=1)

    def stored(*args, **cells):
        return {k: v for k, v in sheet_row(*args, **cells).items() if k not in ("tags", "notes")}

    table.write(frame(spark, VOCABULARY_CSV, stored(1, "stale", "an older snapshot")), at("2031-01-01"))
    own = stored(4, "heron", "wading bird", status="known well", sources="a walk, Fens", partOfSpeech="a bird")
    table.write(frame(spark, VOCABULARY_CSV, own, stored(6, "mine", "by hand")), at("2031-02-01"))
    result = publish_csv(frame(spark, GOLDEN, TERSE, HERON).repartition(3), table, at("2031-03-01"))
    assert rows(result, "id", "status", "partOfSpeech", "sources", "antonyms", "usage", "updatedAt") == [
        (4, "known well", "a bird", "a walk, Fens, Marshes", "", "", at("2031-03-01")),
        (6, "new", "", "", "", "", at("2031-03-01")),
        (7, "new", "adjective", "Letters", "wordy, long-winded", "12.500000%", at("2031-03-01")),
    ]
    assert table.history().count() == 6
    files = [f for _, _, names in os.walk(f"{folder}/published") for f in names if f.endswith(".csv")]
    assert len(files) == 3


# ---- worklist -----------------------------------------------------------------------------------------------------


def undefined(text, *books, day=7, **more):
    seen = at(f"2033-06-{day:02}T04:05:06")
    stats = dict(books=list(books), occurrences=day, firstOccurrence=seen, latestOccurrence=seen, updatedAt=seen)
    return {"text": text, **stats, **more}


def test_the_worklist_lists_unpublished_undefined_tokens(spark, folder):
    missing = fixed.MISSING_TEXT
    silver = frame(
        spark,
        SILVER,
        undefined("glim", "Atlas", "Botany"),
        undefined("grot", "Atlas", day=9),
        # inside a form of another word
        undefined("rot", "Atlas"),
        undefined("not found", "Cellar", normalizedText=missing, definition=missing),
        undefined("known", "Cellar", normalizedText="known", definition="that is known"),
    )
    published = spark.createDataFrame([("trot,trots",), ("over and out",)], "forms string")
    store = SheetStore(spark, WORKLIST_SHEET, f"{folder}/worklist", keep=0)
    expected = [
        ("glim", "Atlas, Botany", 7, "2033-06-07 04:05:06", "2033-06-07 04:05:06"),
        ("grot", "Atlas", 9, "2033-06-09 04:05:06", "2033-06-09 04:05:06"),
        ("not found", "Cellar", 7, "2033-06-07 04:05:06", "2033-06-07 04:05:06"),
    ]
    assert rows(update_worklist(silver, published, store)) == expected
    assert rows(update_worklist(silver, published, store)) == expected
    assert len(store.versions()) == 1


def test_line_breaks_in_tokens_and_forms(spark):
    silver = frame(spark, SILVER, undefined("x\ny", "Atlas"), undefined("left\nright", "Atlas"))
    published = spark.createDataFrame([("xy,x\nyz,x y",), ("left right,leftright",), (None,)], "forms string")
    assert rows(unpublished(render_worklist(silver), published), "text") == [("left\nright",)]


def test_whole_forms_only(spark):
    work = frame(spark, WORKLIST_SHEET, worklist_row("die"), worklist_row("die hard"), worklist_row("hard"))
    published = spark.createDataFrame([(f"die hard{SEP}diehard",), ("hard",)], "forms string")
    assert rows(unpublished(work, published, "form"), "text") == [("die",)]
    assert rows(unpublished(work, published, "substring"), "text") == []
    with pytest.raises(ValueError, match="match must be"):
        unpublished(work, published, "fuzzy")


@pytest.mark.parametrize("broadcast_limit", [0, 1 << 20])
def test_substring_search_against_brute_force(spark, monkeypatch, broadcast_limit):
    from lexlake.operators import worklist

    monkeypatch.setattr(worklist, "BROADCAST_LIMIT", broadcast_limit)
    rng = random.Random(11)

    def word(low, high):
        return "".join(rng.choice("abé\n* ") for _ in range(rng.randint(low, high)))

    texts = list({word(0, 14) for _ in range(400)} | {"a" * 40, "ab" * 20})
    cell_texts = [word(0, 120) for _ in range(60)] + ["", "a" * 100, "x" + "ab" * 60 + "x", "a" * 100]
    expected = sorted((t,) for t in texts if any(t in c for c in cell_texts))
    assert 50 < len(expected) < len(texts)
    found = contained_texts(
        spark.createDataFrame([(t,) for t in [*texts, None]], "text string"),
        spark.createDataFrame([(c,) for c in [*cell_texts, None]], "cell string"),
    )
    assert sorted((r.text,) for r in found.collect()) == expected
    text = plan(found)
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_substrings_are_filtered_before_many_texts_meet_them(spark, monkeypatch):
    """Texts too many to broadcast, which all begin alike: their beginnings are broadcast, and few other substrings shuffled."""
    from lexlake.operators import worklist

    texts = spark.range(3_000).selectExpr("concat('all begin so ', id) AS text")
    cell = spark.range(3_000).selectExpr("concat('x all begin so ', id + 1500, ' y') AS cell")
    filtered, maybe_wanted = [], worklist.maybe_wanted
    monkeypatch.setattr(worklist, "BROADCAST_LIMIT", 10_000)
    monkeypatch.setattr(worklist, "maybe_wanted", lambda grams, *of: filtered.append(grams.columns) or maybe_wanted(grams, *of))
    found = contained_texts(texts, cell)
    # places are not, but whole substrings
    assert filtered == [["gram"]]
    # 150 to 159 lie inside 1500 and so on, 15 to 44 and 1 to 4 as well
    numbers = {n for n in range(3_000) if any(str(m).startswith(str(n)) for m in range(1_500, 4_500))}
    assert {r.text for r in found.collect()} == {f"all begin so {n}" for n in numbers}


def test_substring_search_in_a_very_long_cell(spark):
    """Two million characters in one cell, texts at its ends and over the borders of its chunks."""
    body = "".join("abcdefgh "[(i * i + i // 7) % 9] for i in range(2_000_000))
    cell = f"first words {body[:1000]}over the border{body[1000:]} last words"
    wanted = ["first words", "over the border", "last words", "no such words", body[500_000:503_000], "last words!"]
    found = contained_texts(frame(spark, schema(text=TEXT), *[(w,) for w in wanted]), frame(spark, schema(cell=TEXT), (cell,)))
    assert rows(found) == sorted((w,) for w in wanted if w in cell)


def test_substring_search_with_nothing_to_find_or_search(spark):
    texts = spark.createDataFrame([("abc",), ("a longer text",)], "text string")
    cells_ = spark.createDataFrame([("abcd",)], "cell string")
    assert rows(contained_texts(texts, cells_)) == [("abc",)]
    assert rows(contained_texts(texts.limit(0), cells_)) == []
    assert rows(contained_texts(texts, cells_.limit(0))) == []


def test_publish_is_observed_and_sorts_new_rows_alone(spark, folder):
    def record(word, n):
        seen = at(f"2030-01-{n:02}")
        return {"normalizedText": word, "definition": "d", "forms": [word], "books": [], "occurrences": n,
                "firstOccurrence": seen, "latestOccurrence": seen}

    store = SheetStore(spark, VOCABULARY_SHEET, f"{folder}/observed")
    first, second = Observation(), Observation()
    update_vocabulary(frame(spark, GOLDEN, *[record(f"w{i}", i) for i in range(1, 6)]), store, counts=first)
    assert first.get == {"inserted": 5, "changed": 0, "kept": 0}
    later = [record("w2", 9), record("w3", 3), record("new", 7), record("newer", 8)]
    after = update_vocabulary(frame(spark, GOLDEN, *later), store, counts=second)
    assert second.get == {"inserted": 2, "changed": 1, "kept": 4}
    assert rows(after, "id", "normalizedText")[-2:] == [(6, "new"), (7, "newer")]
    text = plan(reconcile(store.read(), frame(spark, GOLDEN, *later)))
    assert "rangepartitioning" not in text and "Sort" in text


@pytest.mark.parametrize("ids", [range(1, 30_001), [*range(-5, 0), *range(7, 9_000)], [1, 10**12, 5, 10**15], []])
def test_rows_by_id(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(5)
    ordered = by_id(df, min(ids, default=1), max(ids, default=0), len(ids))
    assert [r.id for r in ordered.collect()] == sorted(ids)


@pytest.mark.parametrize("n", [3, 60_000])
def test_the_gram_filter_passes_what_is_wanted_and_little_else(spark, n):
    from lexlake.operators.worklist import gram_filter, maybe_wanted

    wanted = spark.range(n).selectExpr("concat('w', id) AS gram")
    others = spark.range(100_000).selectExpr("concat('other ', id) AS gram")
    passed = gram_filter(wanted, n)
    assert maybe_wanted(wanted, *passed).count() == n
    assert maybe_wanted(others, *passed).count() < 3_000
    text = plan(maybe_wanted(others, *passed))
    assert text.count("BroadcastHashJoin") == 2 and "Exchange hashpartitioning" not in text
