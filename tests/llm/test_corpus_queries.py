"""The registered queries at the smallest scale, and the pipeline against what its stages promise."""

import itertools
import re

import duckdb
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from lexlake.llm import rule_ensemble, surrogates
from lexlake.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: "vec_id n_links component_id kept",
    2: "doc_id fingerprint component_id",
    3: "doc_id text n_entities",
    4: "doc_id held_out score predicted",
    5: "doc_id held_out n_tokens n_known train_tokens base_score score",
    6: "doc_id start n_tokens ids_crc32",
    7: "doc_id held_out score predicted",
    8: "doc_id n_tokens ids_sha256 decoded_sha256",
    9: "doc_id size source_size target taken",
    10: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    11: "page_id url text n_chars",
    12: "lang rank phrase a l r n score",
    13: "word form root n n_near form_n",
}
# one row per row of a table; queries not listed return rows of their own
TABLES = {n: "documents" for n in range(2, 11)} | {1: "embeddings", 11: "pages"}


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry_points.queries())
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agreed_columns_and_rows(spark, name):
    number = int(re.match(r"op(\d+)_", name)[1])
    df = QUERIES[name](spark, SF)
    assert set(COLUMNS[number].split()) <= set(df.columns)
    if number in TABLES:
        assert df.count() == spark.read.parquet(f"{SF}/{TABLES[number]}.parquet").count()


def test_phrases_against_their_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = QUERIES["op12_stripes"](spark, SF)
    want = con.execute(ORACLES["op12_stripes"]).fetchall()
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)


def kept_of_near_copies(rows):
    """The smallest id of each group that pairs of rows with a Jaccard similarity of 0.8 or more connect."""

    def shingles(text):
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))}

    sets = {doc_id: shingles(text) for doc_id, text in rows}
    group = {doc_id: doc_id for doc_id in sets}

    def root(at):
        return at if group[at] == at else root(group[at])

    for a, b in itertools.combinations(sets, 2):
        shared = len(sets[a] & sets[b])
        if sets[a] == sets[b] or (shared and 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared)):
            low, high = sorted((root(a), root(b)))
            group[high] = low
    return sorted(at for at in sets if root(at) == at)


def test_the_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "private_data", "mix", "encode"]
    good = stages["quality"](spark, docs, SF)
    assert good.columns == docs.columns
    scored = rule_ensemble.scores(docs, rule_ensemble.learn(docs, labels))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in scored.where("predicted = 1").collect()}
    single = stages["near_duplicates"](spark, good, SF)
    want = kept_of_near_copies((r.doc_id, r.text) for r in good.collect())
    assert sorted(r.doc_id for r in single.collect()) == want and len(want) < good.count()
    clean = stages["private_data"](spark, single, SF)
    assert clean.columns == docs.columns
    before = {r.doc_id: r.text for r in single.collect()}
    for row in clean.collect():
        assert (row.text == before[row.doc_id]) == (not surrogates.find(before[row.doc_id]))
        assert row.n_chars == len(row.text)
    mixed = stages["mix"](spark, clean, SF)
    assert mixed.columns == docs.columns
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(copies.values()) <= {1, 2}
    assert stages["encode"](spark, mixed, SF).count() == sum(copies.values())
    assert corpus_pipeline.run(spark, SF).count() == sum(copies.values())


def test_stages_take_awkward_rows(spark, make_docs, awkward):
    docs = make_docs(awkward, True)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        if name != "encode":
            assert out.columns == docs.columns
        assert stage(spark, make_docs([]), SF).collect() == []
        assert rows or name == "mix"
