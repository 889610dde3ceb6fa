from helpers import at, frame, plan, rows

from lexlake.operators.highlights import tokens, tokens_by_text, top_tokens
from lexlake.operators.merges import merge_accumulate
from lexlake.plans.jobs import update_bronze
from lexlake.sources.keyed_tables import KeyedTable
from lexlake.spec import BRONZE, STAGE

FIRST, SECOND = at("2020-01-01T01:01:01"), at("2021-01-01T01:01:01")


def highlight(oid, text, book, seconds, stamp):
    return (oid, text, f"Book{book}", f"Author{book}", seconds, stamp)


def label(*numbers):
    return tuple(f"`Book{n}` BY `Author{n}`" for n in numbers)


def epoch(seconds):
    return at(f"1970-01-01T00:00:0{seconds}")


def test_counts_beyond_32_bits_add_up(spark):
    many = dict(text="t", books=["b"], occurrences=2_000_000_000, firstOccurrence=FIRST, latestOccurrence=FIRST, updatedAt=FIRST)
    merged = merge_accumulate(frame(spark, BRONZE, many), frame(spark, BRONZE, many))
    assert rows(merged, "occurrences") == [(4_000_000_000,)]


def test_the_book_label_is_made_once_per_highlight(spark):
    highlights = frame(spark, STAGE, dict(oid=1, text="a!b", title="t", authors="x", timeEdt=1))
    lines = plan(tokens(highlights)).split("\n")
    at = {name: next(i for i, line in enumerate(lines) if name in line) for name in ("Generate", "format_string")}
    assert at["format_string"] > at["Generate"]  # below it


def test_punctuation_splits_and_single_characters_drop(spark):
    """Runs of separators, a token twice in one highlight, other cases of letters, tokens of one letter."""
    stage = frame(
        spark,
        STAGE,
        highlight(11, "river;bank (mud)", 5, 4, FIRST),
        highlight(12, "Mud... RIVER? mud!", 6, 7, FIRST),
        highlight(13, "x;y;z", 5, 9, FIRST),
    )
    assert rows(tokens_by_text(stage)) == [
        ("bank", label(5), 1, epoch(4), epoch(4)),
        ("mud", label(5, 6), 3, epoch(4), epoch(7)),
        ("river", label(5, 6), 2, epoch(4), epoch(7)),
    ]


def test_phrases_hyphens_and_inner_blanks_stay(spark):
    stage = frame(spark, STAGE, highlight(1, "well-known fact; line\nbreak", 1, 1, FIRST))
    assert rows(tokens_by_text(stage), "text") == [("line\nbreak",), ("well-known fact",)]


def test_length_is_measured_before_trimming_unless_strict(spark):
    stage = frame(spark, STAGE, highlight(1, " a,  ,bb", 1, 1, FIRST))
    assert rows(tokens_by_text(stage), "text") == [("",), ("a",), ("bb",)]
    assert rows(tokens_by_text(stage, strict=True), "text") == [("bb",)]


def test_missing_title_and_author_print_as_null(spark):
    stage = frame(spark, STAGE, (1, "word", None, None, 1, FIRST))
    assert rows(tokens_by_text(stage), "books") == [(("`null` BY `null`",),)]


def test_merge_adds_up_and_widens(spark, folder):
    """A later run meets a stored token in a known book with an earlier time, and a new token."""
    bronze = KeyedTable(spark, BRONZE, f"{folder}/bronze", buckets=4)
    stored = [highlight(21, "salt", 4, 5, at("2019-09-09")), highlight(22, "pepper! salt", 6, 3, at("2019-09-09"))]
    update_bronze(frame(spark, STAGE, *stored), bronze, FIRST)
    fresh = [highlight(23, "Salt?", 4, 1, SECOND), highlight(24, "thyme", 4, 8, SECOND)]
    result = update_bronze(frame(spark, STAGE, *stored, *fresh), bronze, SECOND)
    assert rows(result) == [
        ("pepper", label(6), 1, epoch(3), epoch(3), FIRST),
        ("salt", label(4, 6), 3, epoch(1), epoch(5), SECOND),
        ("thyme", label(4), 1, epoch(8), epoch(8), SECOND),
    ]


def test_older_highlights_are_skipped_and_nothing_is_rewritten(spark, folder):
    bronze = KeyedTable(spark, BRONZE, f"{folder}/bronze", buckets=4)
    stage = frame(spark, STAGE, highlight(31, "cumin; cumin", 7, 2, at("2019-09-09")))
    update_bronze(stage, bronze, FIRST)
    files = bronze.snapshot().inputFiles()
    assert rows(update_bronze(stage, bronze, SECOND)) == [("cumin", label(7), 2, epoch(2), epoch(2), FIRST)]
    assert bronze.snapshot().inputFiles() == files


def test_new_books_come_before_stored_ones(spark):
    def state(books, stamp):
        return frame(spark, BRONZE, ("a", books, 1, epoch(1), epoch(2), stamp))

    merged = merge_accumulate(state(["b", "c"], FIRST), state(["d", "c"], SECOND))
    assert merged.first()["books"] == ["d", "c", "b"]


def test_the_stored_side_of_a_merge_is_not_shuffled(spark, folder):
    bronze = KeyedTable(spark, BRONZE, f"{folder}/bronze", buckets=4)
    stage = frame(spark, STAGE, highlight(1, "one!two", 1, 1, FIRST))
    update_bronze(stage, bronze, FIRST)
    current = bronze.snapshot()
    updates = frame(spark, BRONZE, {"text": "two", "books": ["b"], "occurrences": 1, "updatedAt": SECOND})
    merged = plan(merge_accumulate(current, bronze.aligned(updates)))
    assert "Bucketed: true" in merged
    # the only exchange is the one that lines the updates up with the buckets
    assert merged.count("Exchange") == merged.count("REPARTITION_BY_NUM") == 1
    assert len(current.inputFiles()) <= 4


def test_counting_tokens_combines_before_each_shuffle(spark):
    stage = frame(spark, STAGE, highlight(1, "one", 1, 1, FIRST))
    text = plan(tokens_by_text(stage))
    assert text.count("Exchange hashpartitioning") == 2
    assert "partial_count" in text and "partial_sum" in text and "partial_collect_list" in text


def test_a_token_in_a_third_of_all_rows(spark):
    stage = spark.range(30_000).selectExpr(
        "id AS oid",
        "CASE WHEN id % 3 = 0 THEN 'the' ELSE concat('word', id) END AS text",
        "concat('Book', id % 50) AS title",
        "'A' AS authors",
        "id AS timeEdt",
    )
    hot = tokens_by_text(stage).where("text = 'the'").first()
    assert hot["occurrences"] == 10_000 and len(hot["books"]) == 50
    assert tokens_by_text(stage).count() == 20_001


def test_top_tokens(spark):
    stats = frame(spark, BRONZE, *[{"text": t, "occurrences": n} for t, n in (("a", 1), ("b", 3), ("c", 3), ("d", 2))])
    assert [r.text for r in top_tokens(stats, 3).collect()] == ["b", "c", "d"]
    assert [r.text for r in top_tokens(stats).collect()] == ["b", "c", "d", "a"]
