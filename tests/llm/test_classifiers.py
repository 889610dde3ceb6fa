"""Quality rules and weakly supervised toxicity: held-out accuracy, and rows that are awkward."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexlake.llm import rule_ensemble, weak_toxicity
from lexlake.llm.labelled import logistic_weights, sigmoid

SF = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 4000")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return docs, labels


def outcome(scores, labels, label):
    rows = scores.join(labels, "doc_id").where("held_out").select(label, "score", "predicted").collect()
    truth = np.array([r[0] for r in rows])
    return truth, np.array([r.score for r in rows]), np.array([r.predicted for r in rows])


def test_quality_on_held_out_documents(tables):
    docs, labels = tables
    model = rule_ensemble.learn(docs, labels)
    assert 0 < len(model.rules) < 150
    truth, score, predicted = outcome(rule_ensemble.scores(docs, model), labels, "quality")
    assert (predicted == truth).mean() > 0.97
    assert predicted[truth == 1].mean() > 0.99
    assert ((score >= 0) & (score <= 1)).all()


def test_the_column_is_the_model(spark, tables):
    docs, labels = tables
    model = rule_ensemble.learn(docs.where("doc_id < 1500"), labels)
    texts = docs.where("doc_id < 60")
    by_id = {r.doc_id: r.score for r in rule_ensemble.scores(texts, model).collect()}
    for row in texts.collect():
        own = model.score(np.array([rule_ensemble.statistics(row.text)]))[0]
        assert by_id[row.doc_id] == pytest.approx(own, abs=1e-9)


def test_held_out_labels_are_never_read(tables):
    docs, labels = tables
    few = docs.where("doc_id < 1500")
    turned = labels.withColumn(
        "quality",
        F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")),
    )
    assert rule_ensemble.learn(few, labels) == rule_ensemble.learn(few, turned)


def test_toxicity_on_held_out_documents(tables):
    docs, labels = tables
    model = weak_toxicity.learn(docs, labels)
    truth, score, predicted = outcome(weak_toxicity.scores(docs, model), labels, "toxic")
    assert predicted[truth == 1].mean() > 0.8
    assert predicted[truth == 0].mean() < 0.02
    assert ((score >= 0) & (score <= 1)).all()


def test_the_label_model_finds_good_and_repeated_voters():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    sure = np.where(rng.random(4000) < 0.9, truth, ~truth).astype(int) * 2 - 1
    weak = np.where(rng.random(4000) < 0.6, truth, ~truth).astype(int) * 2 - 1
    other = np.where(rng.random(4000) < 0.85, truth, ~truth).astype(int) * 2 - 1
    model = weak_toxicity.fit_label_model(np.stack([sure, other, weak, weak, weak], axis=1).astype(np.int8), 0.3)
    assert model.weight[2:].max() < 0.5 < model.weight[:2].min()
    right = model.table[:, 2, 1]
    assert right[0] > right[2] and right[1] > right[2]
    assert ((model.posterior(np.stack([sure, other, weak, weak, weak], axis=1)) > 0.5) == truth).mean() > 0.88


def test_logistic_weights_with_and_without_penalty():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 6))
    y = (rng.random(3000) < sigmoid(1 + 2 * x[:, 0] - x[:, 1])).astype(float)
    intercept, free = logistic_weights(x, y)
    assert intercept == pytest.approx(1, abs=0.2) and free[0] == pytest.approx(2, abs=0.3)
    _, sparse = logistic_weights(x, y, lasso=0.02)
    assert (sparse[2:] == 0).all() and sparse[0] > 0


@pytest.mark.parametrize("module", [rule_ensemble, weak_toxicity])
def test_awkward_rows(spark, make_docs, awkward, module):
    docs = make_docs(awkward, True)
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, None, None), (None, 0, 1), (4, 0, 1), (7, 1, 0), (99, 0, 1), (4, 0, 1), (8, 0, 0)], LABELS
    )
    model = module.learn(docs, labels)
    rows = module.scores(docs, model).collect()
    assert len(rows) == len(awkward)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD) for r in rows)
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1  # empty and NULL
    assert module.scores(make_docs([]), model).collect() == []
    untaught = module.learn(make_docs([]), labels.limit(0))
    assert {r.score for r in module.scores(docs, untaught).collect()} == {0.5}


def test_good_documents_keep_their_columns(spark, make_docs, awkward):
    docs = make_docs(awkward, True)
    labels = spark.createDataFrame([], LABELS)
    kept = rule_ensemble.good_documents(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == len(awkward)
