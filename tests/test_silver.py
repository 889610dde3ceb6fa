import json

import pytest
from helpers import at, frame, plan, rows, same
from pyspark.sql import functions as F

from lexlake.functions.columns import definition_request, is_defined, is_undefined
from lexlake.operators.definitions import fill_enrichment_defaults, undefined_requests
from lexlake.operators.enrichment import definer, table_lookup
from lexlake.operators.merges import merge_replace, unique_by_key
from lexlake.operators.responses import flatten_definitions
from lexlake.plans.jobs import update_silver
from lexlake.sources.keyed_tables import KeyedTable
from lexlake.spec import BRONZE, GOLDEN, INT, SILVER, TEXT, TEXTS, TableSpec, schema

T1, T2, T4, T5, NOW = (at(f"1999-01-0{d}T01:01:01") for d in (1, 2, 4, 5, 9))

SENSES = {
    "give way": dict(normalizedText="give way", definition="make room", examples=["at a crossing"], synonyms=[], antonyms=[]),
    "weasel": dict(
        normalizedText="weasel",
        phonetic="ˈwiːzl",
        partOfSpeech="noun",
        definition="a small hunter",
        examples=["a den"],
        synonyms=["stoat", "...", "ermine"],
        antonyms=["rabbit"],
    ),
    "sullen": dict(
        normalizedText="sullen",
        phonetic="ˈsʌlən",
        partOfSpeech="adjective",
        definition="gloomy",
        examples=["a sky"],
        synonyms=["dour"],
        antonyms=["cheery"],
    ),
    None: {},
}


def token(text, stamp, n=1, books=("b",), first=T1, latest=T1):
    return dict(text=text, books=list(books), occurrences=n, firstOccurrence=first, latestOccurrence=latest, updatedAt=stamp)


def defined(text, stamp, sense, **stats):
    return {**token(text, stamp, **stats), **SENSES[sense]}


def recording(definitions, seen):
    """A definer that notes what it is asked and answers from a dict of senses."""

    def define(tokens):
        seen.extend(rows(tokens, "text", "occurrences", "updatedAt"))
        spark = tokens.sparkSession
        known = [{"text": t, **s} for t, senses in definitions.items() for s in senses]
        answers = frame(spark, SILVER, *known).select("text", *SILVER.enriched)
        return tokens.drop("updatedAt").join(answers, "text", "left")

    return define


def silver_with(spark, folder, *stored):
    table = KeyedTable(spark, SILVER, f"{folder}/silver", buckets=4)
    table.replace(frame(spark, SILVER, *stored))
    return table


def test_defined_tokens_are_refreshed_without_a_request(spark, folder):
    silver = silver_with(
        spark,
        folder,
        defined("give way", T1, "give way"),
        defined("give way", T1, "weasel"),
        defined("weasel", T1, "weasel"),
        defined("sullen", T1, "sullen"),
    )
    bronze = frame(
        spark,
        BRONZE,
        token("give way", T4, n=2, first=T2, latest=T4),
        token("weasel", T1),
        token("sullen", T4, n=3, books=("b", "b2")),
    )
    seen = []
    result = update_silver(bronze, silver, recording({}, seen), NOW)
    assert seen == []
    same(
        result,
        frame(
            spark,
            SILVER,
            defined("give way", NOW, "give way", n=2, first=T2, latest=T4),
            defined("give way", NOW, "weasel", n=2, first=T2, latest=T4),
            defined("weasel", T1, "weasel"),
            defined("sullen", NOW, "sullen", n=3, books=("b", "b2")),
        ),
    )


def test_new_updated_and_waiting_tokens_are_looked_up(spark, folder):
    stored = [
        defined("give way", T4, "give way"),
        defined("give way", T4, "weasel"),
        defined("sullen", T4, "sullen"),
        defined("zzyx", T4, None),
        defined("waiting", T4, None),
    ]
    silver = silver_with(spark, folder, *stored)
    bronze = frame(
        spark,
        BRONZE,
        token("zzyx", T5, n=2),
        token("weasel", T5, n=3, books=("b", "b2")),
        token("give way", T1),
        token("sullen", T5, n=2),
        token("waiting", T1),
    )
    found = dict(normalizedText="waiting", definition="found late", examples=[], synonyms=[], antonyms=[])
    seen = []
    define = recording({"weasel": [SENSES["weasel"]], "waiting": [found]}, seen)
    result = update_silver(bronze, silver, define, NOW)
    # the waiting token carries its stored stamp
    assert seen == [("waiting", 1, T4), ("weasel", 3, T5), ("zzyx", 2, T5)]
    same(
        result,
        frame(
            spark,
            SILVER,
            *stored[:2],
            defined("sullen", NOW, "sullen", n=2),
            defined("weasel", NOW, "weasel", n=3, books=("b", "b2")),
            defined("zzyx", NOW, None, n=2),
            {**token("waiting", NOW), **found},
        ),
    )
    assert len(result.inputFiles()) <= 2 * 4  # kept and updated rows of each bucket


def test_filling_defaults_on_request(spark, folder):
    silver = silver_with(spark, folder)
    result = update_silver(frame(spark, BRONZE, token("x", T1)), silver, recording({}, []), NOW, fill_missing=True)
    missing = "!ENRICHMENT NOT FOUND!"
    assert rows(result, *SILVER.enriched) == [(missing, missing, missing, missing, (missing,), (missing,), (missing,))]
    # a filled row counts as undefined and gives way once there is a definition
    again = update_silver(
        frame(spark, BRONZE, token("x", T1)), silver, recording({"x": [SENSES["sullen"]]}, []), T1, fill_missing=True
    )
    assert rows(again, "text", "definition") == [("x", "gloomy")]


def test_a_repeated_definition_is_stored_once(spark, folder):
    silver = silver_with(spark, folder)
    twice = [SENSES["sullen"], {**SENSES["sullen"], "partOfSpeech": "noun"}]
    result = update_silver(frame(spark, BRONZE, token("p", T1)), silver, recording({"p": twice}, []), NOW)
    assert rows(result, "text", "partOfSpeech") == [("p", "adjective")]


def test_defined_and_undefined_are_complements(spark):
    df = spark.createDataFrame([("a",), (None,), ("!ENRICHMENT NOT FOUND!",)], "normalizedText string")
    assert rows(df.select(is_defined(), is_undefined())) == [(False, True), (False, True), (True, False)]


def test_merge_replaces_null_keys_too(spark):
    current = frame(spark, SILVER, defined("a", T1, None), defined("b", T1, None), defined("c", T1, "sullen"))
    updates = frame(spark, SILVER, defined("a", NOW, None), defined("b", NOW, "sullen"), defined("c", NOW, "weasel"))
    assert rows(merge_replace(current, updates), "text", "definition", "updatedAt") == [
        ("a", None, NOW),
        ("b", "gloomy", NOW),
        ("c", "a small hunter", NOW),
        ("c", "gloomy", T1),
    ]


def test_unique_by_key_does_not_depend_on_row_order(spark):
    spec = schema(k=TEXT, v=INT, l=TEXTS)
    data = [("a", 2, ["x"]), ("a", None, ["y"]), (None, 1, None), (None, 1, [])]
    for part in (data, data[::-1]):
        assert rows(unique_by_key(frame(spark, spec, *part), ["k"])) == [(None, 1, None), ("a", None, ("y",))]


def test_an_unknown_type_has_no_default(spark):
    spec = TableSpec("t", schema(k=TEXT, n=INT), pk=("k",), enriched=("n",))
    with pytest.raises(NotImplementedError, match="n of type int"):
        fill_enrichment_defaults(frame(spark, spec, ("a", None)), spec)


def test_defaults_by_type(spark):
    golden = frame(spark, GOLDEN, {"normalizedText": "a"}, {"normalizedText": "b", "translations": [], "usage": 0.5})
    filled = fill_enrichment_defaults(golden, GOLDEN)
    assert rows(filled, "normalizedText", "translations", "usage") == [
        ("a", ("!ENRICHMENT NOT FOUND!",), -1.0),
        ("b", (), 0.5),
    ]


def test_joins_on_the_shared_bucket_column_need_no_shuffle(spark, folder):
    silver = silver_with(spark, folder, defined("a", T1, None))
    bronze = KeyedTable(spark, BRONZE, f"{folder}/bronze", buckets=4)
    bronze.replace(frame(spark, BRONZE, token("a", T2), token("b", T2)))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(undefined_requests(bronze.snapshot(), silver.snapshot()))
        assert "Exchange" not in text
        assert text.count("FileScan") == 2  # silver once, bronze once
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


# ---- responses ----------------------------------------------------------------------------------------------------


def flattened(spark, response):
    df = frame(spark, schema(text=TEXT, response=TEXT), ("t", response))
    return rows(flatten_definitions(df))


@pytest.mark.parametrize("response", ["", None, "not json", "[]"])
def test_no_definition_is_one_row_of_nulls(spark, response):
    assert flattened(spark, response) == [("t", None, None, None, None, None, None, None)]


def test_origins_meanings_and_definitions_are_flattened(spark):
    response = json.dumps(
        [
            {
                "word": "give way",
                "phonetics": [{}],
                "meanings": [{"definitions": [{"definition": "slow", "example": "e", "synonyms": [], "antonyms": []}]}],
            },
            {
                "word": "weasel",
                "phonetic": "/d/",
                "origin": "ignored",
                "meanings": [
                    {
                        "partOfSpeech": "noun",
                        "definitions": [
                            {"definition": "d1", "synonyms": ["s", "..."], "antonyms": ["a"]},
                            {"definition": "d2", "example": "e2", "synonyms": [], "antonyms": []},
                        ],
                    },
                    {"partOfSpeech": "verb", "definitions": []},
                ],
            },
        ]
    )
    assert flattened(spark, response) == [
        ("t", "give way", None, None, "slow", ("e",), (), ()),
        ("t", "weasel", "/d/", "noun", "d1", (), ("...", "s"), ("a",)),
        ("t", "weasel", "/d/", "noun", "d2", ("e2",), (), ()),
        ("t", "weasel", "/d/", "verb", None, None, None, None),
    ]


def test_definer_keeps_the_statistics_and_drops_the_stamp(spark):
    tokens = frame(spark, BRONZE, token("a b", T1, n=7))
    responses = tokens.select(
        definition_request(F.col("text")).alias("request"),
        F.lit('[{"word": "w", "meanings": [{"definitions": [{"definition": "d"}]}]}]').alias("response"),
    )
    assert responses.first()["request"].endswith("/entries/en/a+b")
    result = definer(table_lookup(responses))(tokens)
    assert rows(result, "text", "occurrences", "normalizedText", "definition", "examples", "synonyms") == [
        ("a b", 7, "w", "d", (), None)
    ]
    assert "updatedAt" not in result.columns
