import json
import os
import random
import time

import pytest
from helpers import frame, plan, rows
from pyspark.sql import functions as F

from lexlake.functions import fixed_values as fixed
from lexlake.functions.columns import usage_query, usage_request
from lexlake.operators.enrichment import (
    DEFINITION_POLICY,
    TLS_FAILURE,
    TRANSLATION_POLICY,
    USAGE_POLICY,
    EnrichmentError,
    ResponseTable,
    accepted_values,
    classify_responses,
    remote_lookup,
    send,
    table_lookup,
    task_rate,
    translator,
    usage_finder,
)
from lexlake.operators.responses import flatten_definitions
from lexlake.operators.translations import attach_translations, map_tags
from lexlake.spec import INT, LONG, TEXT, TEXTS, schema

RECORDS = schema(normalizedText=TEXT, partOfSpeech=TEXT, forms=TEXTS, definition=TEXT)
REQUESTS = schema(request=TEXT, response=TEXT)
TRIES = schema(attempt=INT, status=INT, body=TEXT)


def response(display, *found):
    """found: (target, tag) or (target, tag, prefix)"""
    translations = [
        {"normalizedTarget": t[0], "displayTarget": t[0], "posTag": t[1], "confidence": 0.4, "prefixWord": (*t, "")[2]}
        for t in found
    ]
    return json.dumps([{"normalizedSource": "x", "displaySource": display, "translations": translations}])


def translated(spark, records, responses, match="contains"):
    lookup = table_lookup(frame(spark, REQUESTS, *responses.items()))
    return rows(translator(lookup, match)(frame(spark, RECORDS, *records)), "definition", "forms", "translations")


# ---- translations -------------------------------------------------------------------------------------------------


def by_rule(records, responses, match):
    """What the rules give, record by record: (definition, forms, translations)."""

    def fits(part, tag):
        names = fixed.TRANSLATION_TAGS.get(tag, ())
        return part is not None and (part in names if match == "exact" else any(part in name for name in names))

    def shown(target, prefix=""):
        return f"{target} ({prefix})" if prefix else target

    out = []
    for word, part, forms, definition in records:
        display, found = responses.get(word, (None, []))
        parts = {p for w, p, *_ in records if w == word}
        mine = {shown(t, *rest) for t, tag, *rest in found if fits(part, tag) or not any(fits(p, tag) for p in parts)}
        out.append((definition, tuple(sorted({*forms, display} - {None})), tuple(sorted(mine))))
    return sorted(out)


@pytest.mark.parametrize("match", ["contains", "exact"])
@pytest.mark.parametrize("seed", [3, 4, 5])
def test_translations_by_rule(spark, seed, match):
    """Words with several meanings, parts of speech and answers, drawn at random."""
    draw = random.Random(seed)
    parts = [*fixed.PARTS_OF_SPEECH, None]
    tags = [*fixed.TRANSLATION_TAGS, "SYMBOL", None]
    records, responses = [], {}
    for n in range(25):
        word = f"word{n}"
        few = draw.sample(parts, 3)
        for meaning in range(draw.randint(1, 4)):
            records.append((word, draw.choice(few), draw.sample([word, f"{word}s", word.upper()], 2), f"{word}, meaning {meaning}"))
        if draw.random() < 0.9:
            found = [(f"target {i}", draw.choice(tags), draw.choice(["", "a", "to"])) for i in range(draw.randint(0, 5))]
            responses[word] = (draw.choice([word, word.title()]), found)
    answers = {word: response(display, *found) for word, (display, found) in responses.items()}
    assert translated(spark, records, answers, match) == by_rule(records, responses, match)


def test_an_empty_answer(spark):
    records = [("moss", "noun", ["moss"], "a plant"), ("fern", None, ["Fern"], "another")]
    assert translated(spark, records, {"moss": "[]"}) == [("a plant", ("moss",), ()), ("another", ("Fern",), ())]


def test_unknown_ways_to_match(spark):
    with pytest.raises(ValueError, match="match must be"):
        translated(spark, [("moss", "noun", ["moss"], "a plant")], {"moss": response("moss", ("x", "NOUN"))}, "fuzzy")


def test_every_tag_stands_for_known_parts_of_speech(spark):
    assert {p for parts in fixed.TRANSLATION_TAGS.values() for p in parts} <= set(fixed.PARTS_OF_SPEECH)
    assert set(fixed.USAGE_TAGS) == set(fixed.PARTS_OF_SPEECH)
    tags = frame(spark, schema(posTag=TEXT), ("NOUN",), ("XYZ",), (None,))
    assert rows(map_tags(tags)) == [(None,), ("XYZ",), ("noun,number",)]


def test_linking_pairs_nothing_and_needs_no_window(spark):
    """Many definitions times many translations of one text: the join sees parts of speech, not definitions."""
    records = spark.range(2000).selectExpr(
        "concat('hot', id % 1) AS normalizedText",
        "CASE WHEN id % 2 = 0 THEN 'noun' END AS partOfSpeech",
        "array('hot') AS forms",
        "concat('d', id) AS definition",
    )
    parsed = spark.range(1000).selectExpr(
        "concat('hot', id % 1) AS normalizedText",
        "'Hot' AS displaySource",
        "concat('t', id) AS displayTarget",
        "CASE WHEN id % 10 = 0 THEN 'XYZ' ELSE 'NOUN' END AS posTag",
        "'' AS prefixWord",
    )
    linked = attach_translations(records, parsed)
    sizes = linked.groupBy("partOfSpeech").agg(F.min(F.size("translations")), F.max(F.size("translations")), F.count("*"))
    assert rows(sizes) == [(None, 100, 100, 1000), ("noun", 1000, 1000, 1000)]
    text = plan(linked)
    assert "Window" not in text and "NestedLoop" not in text and "Cartesian" not in text


# ---- usage --------------------------------------------------------------------------------------------------------


def usages(spark, records, responses):
    columns = schema(normalizedText=TEXT, partOfSpeech=TEXT, occurrences=INT)
    lookup = table_lookup(frame(spark, REQUESTS, *responses.items()))
    found = usage_finder(lookup)(frame(spark, columns, *records)).withColumn("usage", F.round("usage", 6))
    return rows(found, "normalizedText", "partOfSpeech", "occurrences", "usage")


def url(content):
    return f"https://books.google.com/ngrams/json?content={content}%3Aeng_2019&year_start=2015&year_end=2019"


def series(*points):
    return json.dumps([{"ngram": "n", "parent": "", "type": "NGRAM", "timeseries": list(p)} for p in points])


def test_usage_is_the_mean_of_all_points(spark):
    responses = {
        url("duck_NOUN"): series((0.1, 0.2, 0.3, 0.4)),
        url("duck_VERB"): series((0.01, 0.02, 0.03, 0.04)),
        url("Bank+of+*"): series((0.1, 0.2, 0.3, 0.4), (0.5, 0.6, 0.7, 0.8)),
        url("qsl"): "[]",
    }
    records = [
        ("duck", "noun", 1),
        ("duck", "noun", 2),
        ("duck", "verb", 3),
        ("Bank of *", None, 4),
        ("qsl", "abbreviation", 5),
        ("unheard", "noun", 6),
    ]
    assert usages(spark, records, responses) == [
        ("Bank of *", None, 4, 0.45),
        ("duck", "noun", 1, 0.25),
        ("duck", "noun", 2, 0.25),
        ("duck", "verb", 3, 0.025),
        ("qsl", "abbreviation", 5, None),
        ("unheard", "noun", 6, None),
    ]


def test_usage_keys(spark):
    df = frame(spark, schema(t=TEXT, p=TEXT), ("give way", None), ("MY", "abbreviation"), ("up", "infinitive marker"))
    keys = rows(df.select(usage_query(F.col("t"), F.col("p"))))
    assert keys == [("MY:eng_2019",), ("give way:eng_2019",), ("up_PRT:eng_2019",)]
    built = rows(df.select(usage_request(F.col("t"), F.col("p"), "eng_2012", 1990, 2000)))
    assert built[1] == ("https://books.google.com/ngrams/json?content=give+way%3Aeng_2012&year_start=1990&year_end=2000",)


# ---- policies -----------------------------------------------------------------------------------------------------


def outcomes(spark, policy, *tries):
    decided = classify_responses(frame(spark, TRIES, *tries), policy)
    return [(r.outcome, r.value) for r in decided.collect()], [r.reason for r in decided.collect()]


def test_definition_policy(spark):
    tries = [(1, 200, "b"), (9, 429, ""), (1, 404, "x"), (2, TLS_FAILURE, None), (3, TLS_FAILURE, None), (1, 500, "oops")]
    result, reasons = outcomes(spark, DEFINITION_POLICY, *tries)
    assert result == [("value", "b"), ("retry", None), ("value", ""), ("retry", None), ("fail", None), ("fail", None)]
    assert "`3` attempts" in reasons[4] and "`500`" in reasons[5] and "`oops`" in reasons[5]


def test_translation_policy(spark):
    def error(code):
        return json.dumps({"error": {"code": code, "message": "busy"}})

    result, reasons = outcomes(
        spark,
        TRANSLATION_POLICY,
        (1, 200, "b"),
        (3, 503, error(503000)),
        (1, 500, error(500000)),
        (4, 301, error(503000)),
        (1, 404, error(403001)),
        (1, 503, " "),
        (1, 503, None),
        (1, 301, "gone to another address"),
    )
    assert [o for o, _ in result] == ["value", "retry", "retry", "fail", "fail", "fail", "fail", "fail"]
    assert "`503000`" in reasons[3] and "`busy`" in reasons[3] and "`3` retries" in reasons[3]
    assert "`403001`" in reasons[4]
    assert "empty body" in reasons[5] and "empty body" in reasons[6]
    assert "`gone to another address`" in reasons[7]


def test_usage_policy(spark):
    result, _ = outcomes(spark, USAGE_POLICY, (1, 200, "[]"), (50, 429, ""), (1, 404, ""), (1, 503, ""))
    assert [o for o, _ in result] == ["value", "retry", "fail", "fail"]


def test_reading_a_failed_answer_raises(spark):
    tries = frame(spark, schema(request=TEXT, attempt=INT, status=INT, body=TEXT), ("a", 1, 200, "b"), ("c", 1, 429, ""))
    assert rows(accepted_values(classify_responses(tries, USAGE_POLICY))) == [("a", "b")]
    broken = tries.unionByName(tries.limit(1).withColumn("status", F.lit(500)))
    with pytest.raises(Exception, match="unexpected status `500`"):
        accepted_values(classify_responses(broken, USAGE_POLICY)).collect()


# ---- the lookup loop ----------------------------------------------------------------------------------------------


def logged_service(folder, answer):
    """A service whose calls are written down, one file each, as they happen in other processes."""

    def connect(rate):
        def fetch(request):
            n = len([f for f in os.listdir(folder) if f.startswith(f"{request}#")])
            open(f"{folder}/{request}#{n}", "w").close()
            return answer(request, n + 1)

        return fetch

    return connect


def asked(spark, *requests):
    return frame(spark, schema(n=LONG, request=TEXT), *enumerate(requests))


def test_one_call_per_distinct_request_and_none_for_known_ones(spark, folder):
    os.mkdir(f"{folder}/calls")
    table = ResponseTable(spark, f"{folder}/responses")
    table.append(frame(spark, REQUESTS, ("known", "old")))
    connect = logged_service(f"{folder}/calls", lambda request, n: (200, request.upper()))
    lookup = remote_lookup(table, connect, USAGE_POLICY, sleep=None)
    rows_in = asked(spark, "a", "b", "a", "known")
    expected = [(0, "a", "A"), (1, "b", "B"), (2, "a", "A"), (3, "known", "old")]
    assert rows(lookup(rows_in)) == expected
    assert rows(lookup(rows_in)) == expected
    assert sorted(os.listdir(f"{folder}/calls")) == ["a#0", "b#0"]


def test_retries_pause_and_only_resend_what_is_open(spark, folder):
    os.mkdir(f"{folder}/calls")
    pauses = []
    connect = logged_service(
        f"{folder}/calls", lambda request, n: (429, "") if request == "busy" and n < 3 else (200, "ok")
    )
    lookup = remote_lookup(ResponseTable(spark, f"{folder}/r"), connect, DEFINITION_POLICY, sleep=pauses.append)
    assert rows(lookup(asked(spark, "busy", "free")), "request", "response") == [("busy", "ok"), ("free", "ok")]
    assert pauses == [300, 300]
    assert sorted(os.listdir(f"{folder}/calls")) == ["busy#0", "busy#1", "busy#2", "free#0"]


def test_a_failure_stops_the_run_but_answers_are_kept(spark, folder):
    os.mkdir(f"{folder}/calls")
    table = ResponseTable(spark, f"{folder}/r")
    connect = logged_service(
        f"{folder}/calls", lambda request, n: (500, "boom") if request == "bad" and n == 1 else (200, "ok")
    )
    lookup = remote_lookup(table, connect, DEFINITION_POLICY, sleep=None)
    with pytest.raises(EnrichmentError, match="`bad`.*`500`.*`boom`"):
        lookup(asked(spark, "good", "bad"))
    assert rows(table.read()) == [("good", "ok")]
    assert rows(lookup(asked(spark, "good", "bad")), "request", "response") == [("bad", "ok"), ("good", "ok")]
    assert sorted(os.listdir(f"{folder}/calls")) == ["bad#0", "bad#1", "good#0"]


def test_translations_give_up_after_three_retries(spark, folder):
    os.mkdir(f"{folder}/calls")
    body = json.dumps({"error": {"code": 503000, "message": "unavailable"}})
    pauses = []
    connect = logged_service(f"{folder}/calls", lambda request, n: (503, body))
    lookup = remote_lookup(ResponseTable(spark, f"{folder}/r"), connect, TRANSLATION_POLICY, sleep=pauses.append)
    with pytest.raises(EnrichmentError, match="`3` retries"):
        lookup(asked(spark, "a"))
    assert pauses == [60, 60, 60] and len(os.listdir(f"{folder}/calls")) == 4


def test_a_text_not_found_is_asked_again_next_time(spark, folder):
    os.mkdir(f"{folder}/calls")
    connect = logged_service(f"{folder}/calls", lambda request, n: (404, None) if n == 1 else (200, "found"))
    lookup = remote_lookup(ResponseTable(spark, f"{folder}/r"), connect, DEFINITION_POLICY, sleep=None)
    assert rows(lookup(asked(spark, "a")), "response") == [("",)]
    assert rows(lookup(asked(spark, "a")), "response") == [("found",)]


def test_a_limit_stops_the_task(spark, folder):
    """A service that limits after two answers per task and round: at most one call more than that before the pause."""
    os.mkdir(f"{folder}/calls")
    pauses = []

    def connect(rate):
        state = {"n": 0}

        def fetch(request):
            state["n"] += 1
            open(f"{folder}/calls/{request}#{len(pauses)}-{len(os.listdir(f'{folder}/calls'))}", "w").close()
            return (429, "") if state["n"] > 2 else (200, "ok")

        return fetch

    lookup = remote_lookup(
        ResponseTable(spark, f"{folder}/r"), connect, DEFINITION_POLICY, partitions=2, sleep=pauses.append
    )
    found = lookup(asked(spark, *[f"w{n}" for n in range(12)]))
    assert {r.response for r in found.collect()} == {"ok"}
    calls = len(os.listdir(f"{folder}/calls"))
    assert calls <= 12 + 2 * len(pauses) and len(pauses) >= 2


def test_an_error_in_a_call_keeps_the_answers_before_it(spark, folder):
    os.mkdir(f"{folder}/calls")

    def answer(request, n):
        if request == "w5" and n == 1:
            raise ConnectionError("line is dead")
        return 200, "ok"

    table = ResponseTable(spark, f"{folder}/r")
    lookup = remote_lookup(
        table, logged_service(f"{folder}/calls", answer), DEFINITION_POLICY, partitions=1, sleep=None
    )
    requests = asked(spark, *[f"w{n}" for n in range(12)])
    with pytest.raises(EnrichmentError, match="w5.*line is dead"):
        lookup(requests)
    before = len(os.listdir(f"{folder}/calls"))
    assert table.read().count() == before - 1
    assert {r.response for r in lookup(requests).collect()} == {"ok"}
    assert len(os.listdir(f"{folder}/calls")) == 13


def test_a_round_ends_after_its_seconds(spark):
    def connect(rate):
        def fetch(request):
            time.sleep(0.2)
            return 200, "ok"

        return fetch

    sent = send(asked(spark, *"abcdef"), connect, partitions=1, seconds=0.3)
    statuses = [r.status for r in sent.collect()]
    assert 0 < statuses.count(200) < 6 and statuses.count(200) + statuses.count(None) == 6


def test_the_rate_is_shared_between_tasks(spark):
    assert task_rate(None, 4, 8) is None
    assert task_rate(1.6, 4, 8) == task_rate(1.6, 8, 2) == 0.2

    def connect(rate):
        return lambda request: (200, str(rate))

    requests = asked(spark, "a").select("request")
    assert rows(send(requests, connect, 800.0, partitions=4), "body") == [("100.0",)]
    assert rows(send(requests, connect), "body") == [("None",)]


def test_a_request_in_a_third_of_all_rows(spark):
    df = spark.range(30_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('r', id) END AS request")
    responses = frame(spark, REQUESTS, ("hot", "yes"))
    found = table_lookup(responses)(df)
    assert found.where("response = 'yes'").count() == 10_000 and found.count() == 30_000


def test_looking_up_does_not_shuffle_the_stored_answers(spark, folder):
    table = ResponseTable(spark, f"{folder}/responses", buckets=4)
    table.append(frame(spark, REQUESTS, *[(f"r{n}", "x") for n in range(50)]))
    table.append(frame(spark, REQUESTS, ("r50", "x")))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(table_lookup(table.read())(table.aligned(asked(spark, "r1", "r50", "new"))))
        assert "Bucketed: true" in text
        assert text.count("Exchange") == text.count("REPARTITION_BY_NUM") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    found = table_lookup(table.read())(asked(spark, "r1", "r50", "new"))
    assert rows(found, "request", "response") == [("new", ""), ("r1", "x"), ("r50", "x")]


def test_definitions_are_flattened_level_by_level(spark):
    """A level that is empty or missing leaves one row, with what the levels above it say."""
    one = {"definition": "d1", "example": "e1", "synonyms": ["s"], "antonyms": []}
    answers = {
        "nothing": None,
        "text": "no JSON",
        "empty": "[]",
        "bare": json.dumps([{"word": "w", "phonetic": "p"}]),
        "no meanings": json.dumps([{"word": "w", "meanings": []}]),
        "no senses": json.dumps([{"word": "w", "meanings": [{"partOfSpeech": "noun", "definitions": []}]}]),
        "two": json.dumps(
            [
                {"word": "w", "meanings": [{"partOfSpeech": "noun", "definitions": [one, {"definition": "d2"}]}, {"partOfSpeech": "verb"}]},
                {"word": "v"},
            ]
        ),
    }
    df = frame(spark, schema(text=TEXT, books=TEXTS, response=TEXT), *[(t, [t], a) for t, a in answers.items()])
    flat = flatten_definitions(df)
    assert flat.columns[:2] == ["text", "books"] and plan(flat).count("Generate") == 1
    blank = (None,) * 3
    assert rows(flat.drop("books", "phonetic")) == rows(
        frame(
            spark,
            schema(text=TEXT, normalizedText=TEXT, partOfSpeech=TEXT, definition=TEXT, examples=TEXTS, synonyms=TEXTS, antonyms=TEXTS),
            *[(t, None, None, None, *blank) for t in ("nothing", "text", "empty")],
            *[(t, "w", None, None, *blank) for t in ("bare", "no meanings")],
            ("no senses", "w", "noun", None, *blank),
            ("two", "w", "noun", "d1", ["e1"], ["s"], []),
            ("two", "w", "noun", "d2", [], None, None),
            ("two", "w", "verb", None, *blank),
            ("two", "v", None, None, *blank),
        )
    )
