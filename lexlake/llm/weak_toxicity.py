"""Toxicity by weak supervision.

Lexicons of words and word stems are learned from a bounded sample of labelled documents. Many voters, each a part of a
lexicon or a pattern, say toxic, clean or nothing about a document. A generative model estimates from the votes how
often each voter is right and which voters repeat one another, and gives each document a posterior probability. A linear
classifier is trained on the posteriors and scores all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.llm.common import in_fold, texts
from lexlake.llm.labelled import label_sample, logistic_weights, sigmoid
from lexlake.session import written

# the fold that is never learned from, and the score from which a document counts as toxic
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
# labelled documents learned from at most
SAMPLE_ROWS = 20_000
# stems are the first letters of a word; parts that each lexicon is cut into by precision, one voter each
STEMS = (4, 5, 6, 7, 8)
PARTS = 4
# places in toxic documents that a lexicon entry must have, their least number per document, and how much more often than in clean ones
LEAST_DOCUMENTS, LEAST_SHARE, LEAST_RATIO = 5, 0.02, 20.0

_LETTERS = re.compile(r"[^\W\d_]+")
_CAPITAL = re.compile(r"[A-Z]+")


def document_words(text: str | None) -> tuple[Counter, int]:
    found = _LETTERS.findall((text or "").lower())
    return Counter(found), len(found)


def units(words: set[str] | Counter) -> set[str]:
    """Whole words, written with a blank behind them, and stems of longer words."""
    out = {w + " " for w in words}
    for k in STEMS:
        out.update({w[:k] for w in words if len(w) > k})
    return out


def unit_places(text: str | None) -> set[tuple[str, int]]:
    """Units of a text, each with a hash of the word before it."""
    found = _LETTERS.findall((text or "").lower())
    pairs = set(zip(found, ["", *found[:-1]], strict=True))
    return {(u, crc32(before.encode())) for w, before in pairs for u in units({w})}


@dataclass
class Lexicon:
    """Entries, the most telling first; whole words make up the first `PARTS` voters, stems the others."""

    entries: list[str]
    part_of: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        whole = [e for e in self.entries if e.endswith(" ")]
        stems = [e for e in self.entries if not e.endswith(" ")]
        for first, group in ((0, whole), (PARTS, stems)):
            self.part_of.update({e: first + i * PARTS // len(group) for i, e in enumerate(group)})
        self.words = {e[:-1] for e in whole}
        self.sizes = sorted({len(e) for e in stems}, reverse=True)
        self.heads = {e[: STEMS[0]] for e in stems}

    def hits(self, words: Counter) -> list[str]:
        """The entry that each distinct word matches: itself, or its longest stem."""
        out = [w + " " for w in self.words if w in words]
        head, part_of = STEMS[0], self.part_of
        for w in [w for w in words if w[:head] in self.heads and w not in self.words]:
            for k in self.sizes:
                if len(w) > k and w[:k] in part_of:
                    out.append(w[:k])
                    break
        return out


# signals of a document: distinct words that match each lexicon voter, then the patterns
SIGNALS = (
    *[f"words_{i}" for i in range(PARTS)],
    *[f"stems_{i}" for i in range(PARTS)],
    "hits",
    "hits_per_100",
    "shouted",
    "exclaimed",
    "log_words",
)


def signals(text: str | None, lexicon: Lexicon) -> list[float]:
    """The numbers in `SIGNALS` of a whole text; all zero for NULL and empty."""
    counts, n = document_words(text)
    hits = lexicon.hits(counts)
    by_voter = [0.0] * (2 * PARTS)
    for h in hits:
        by_voter[lexicon.part_of[h]] += 1
    text = text or ""
    letters = max(len(text), 1)
    return [
        *by_voter,
        float(len(hits)),
        100.0 * len(hits) / max(n, 1),
        1 - len(_CAPITAL.sub("", text)) / letters,
        text.count("!") / letters,
        float(np.log1p(n)),
    ]


def votes(x: np.ndarray) -> np.ndarray:
    """1 (toxic), -1 (clean) or 0 (nothing) of each voter for each document's signals."""
    at = {s: i for i, s in enumerate(SIGNALS)}
    out = [x[:, i] > 0 for i in range(2 * PARTS)]
    out += [x[:, PARTS + i] >= least for i in range(PARTS) for least in (2, 3)]
    out += [x[:, at["hits"]] >= least for least in (2, 3, 4)]
    out += [x[:, at["hits_per_100"]] >= least for least in (0.1, 0.3)]
    out += [x[:, at["shouted"]] > 0.5, x[:, at["exclaimed"]] > 0.05]
    clean = [x[:, at["hits"]] == 0, x[:, :PARTS].sum(axis=1) == 0, x[:, at["hits"]] <= 1]
    return np.stack([*[v.astype(np.int8) for v in out], *[-v.astype(np.int8) for v in clean]], axis=1)


@dataclass
class LabelModel:
    """Voters that speak independently given the truth, up to pairs that repeat each other.

    ``table[j, v, y]`` is the probability that voter j says v (clean, nothing, toxic) of a document of class y. A voter
    counts with the weight 1 / (1 + sum of its correlations with others given the class), so that voters that say the
    same thing count about once.
    """

    prior: float
    table: np.ndarray
    weight: np.ndarray
    correlation: np.ndarray

    def posterior(self, said: np.ndarray) -> np.ndarray:
        log = np.log(self.table)
        margin = np.log(self.prior / (1 - self.prior)) * np.ones(len(said))
        for j in range(said.shape[1]):
            margin += self.weight[j] * (log[j, said[:, j] + 1, 1] - log[j, said[:, j] + 1, 0])
        return sigmoid(margin)


def fit_label_model(said: np.ndarray, prior: float, rounds: int = 30) -> LabelModel:
    """Expectation maximisation from the majority vote; correlations are estimated half-way and held from then on."""
    n, k = said.shape
    prior = float(np.clip(prior, 0.01, 0.99))
    model = LabelModel(prior, np.full((k, 3, 2), 1 / 3), np.ones(k), np.zeros((k, k)))
    # voters that say the same of nearly all documents share one vote from the start
    same = np.stack([(said == said[:, [j]]).mean(axis=0) for j in range(k)]) if n else np.eye(k)
    model.weight = 1 / (same > 0.999).sum(axis=1)
    belief = sigmoid(2.0 * (said @ model.weight) + np.log(prior / (1 - prior)))
    for step in range(rounds):
        for y, mass in ((0, 1 - belief), (1, belief)):
            for v in (-1, 0, 1):
                model.table[:, v + 1, y] = ((said == v) * mass[:, None]).sum(axis=0) + 0.1
        model.table /= model.table.sum(axis=1, keepdims=True)
        if step == rounds // 2:
            within = np.zeros((k, k))
            for mass in (1 - belief, belief):
                centred = said - (said * mass[:, None]).sum(axis=0) / max(mass.sum(), 1e-9)
                cov = (centred * mass[:, None]).T @ centred
                spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                within += np.abs(cov / np.outer(spread, spread)) * mass.sum() / max(n, 1)
            np.fill_diagonal(within, 0)
            model.correlation = np.where(within > 0.05, within, 0)
            model.weight = 1 / (1 + model.correlation.sum(axis=1))
        belief = model.posterior(said)
    return model


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    intercept: float
    weights: np.ndarray
    label_model: LabelModel | None

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.intercept + _inputs(x) @ self.weights)


def _inputs(x: np.ndarray) -> np.ndarray:
    """Inputs of the linear classifier: signals on a log scale."""
    return np.log1p(np.maximum(x, 0))


def learn_lexicon(sample: DataFrame, entries: int = 4_000) -> Lexicon:
    """Words and stems that toxic documents of the sample hold far more often than clean ones.

    Counts of documents are aggregated by Spark over the sample, which is bounded; so are the entries.
    """

    def places(keep: set[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = {p for text in texts(batch) for p in unit_places(text) if keep is None or p[0] in keep}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([u for u, _ in found], pa.string()), pa.array([b for _, b in found], pa.int64())],
                    names=["unit", "before"],
                )

        return run

    def counted(rows: DataFrame, keep: set[str] | None) -> DataFrame:
        found = rows.mapInArrow(places(keep), "unit string, before long")
        return found.groupBy("unit").agg(F.count_distinct("before").alias("n"))

    # copies of one text count once, or every word of a text copied often would look like a mark of its class; and a
    # unit counts once per word before it, as near copies repeat that too
    sample = sample.dropDuplicates(["text", "target"])
    toxic, clean = sample.where("target = 1").select("text"), sample.where("target = 0").select("text")
    sizes = {r["target"]: r["n"] for r in sample.groupBy("target").agg(F.count(F.lit(1)).alias("n")).collect()}
    # a unit must have several places in toxic documents; the most frequent ones bound what is looked for in clean documents
    least = max(LEAST_DOCUMENTS, LEAST_SHARE * sizes.get(1, 0))
    often = counted(toxic, None).where(F.col("n") >= least).orderBy(F.desc("n"), "unit").limit(20 * entries)
    in_toxic = {r["unit"]: r["n"] for r in often.collect()}
    in_clean = {r["unit"]: r["n"] for r in counted(clean, set(in_toxic)).collect()} if in_toxic else {}
    n1, n0 = max(sizes.get(1, 0), 1), max(sizes.get(0, 0), 1)
    ratio = {u: (n / n1) / ((in_clean.get(u, 0) + 1) / n0) for u, n in in_toxic.items()}
    good = {u for u in ratio if ratio[u] >= LEAST_RATIO}
    # of nested entries keep the longest that says as much, and no longer one that adds nothing to its stem
    spent: set[str] = set()
    for u in sorted(good, key=len):
        for k in STEMS:
            stem = u[:k]
            if len(u) > k and stem in good:
                if in_toxic[u] >= 0.9 * in_toxic[stem]:
                    spent.add(stem)
                elif ratio[stem] >= 0.3 * ratio[u] and stem not in spent:
                    spent.add(u)
    best = sorted(good - spent, key=lambda u: (-ratio[u], u))
    return Lexicon(best[:entries])


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """A model from a bounded sample of labelled documents; labels, language, source and id are no inputs."""
    sample = written(label_sample(docs, labels, "toxic", FOLDS, HELD_OUT, rows, seed=7), "toxicity-sample")
    lexicon = learn_lexicon(sample)
    found = _with_signals(sample, lexicon, "doc_id", "target").orderBy("doc_id", *SIGNALS).toPandas()
    x, gold = found[list(SIGNALS)].to_numpy(np.float64), found["target"].to_numpy(np.float64)
    if not len(x) or not lexicon.entries:
        share = (gold.sum() + 0.5) / (len(gold) + 1) if len(gold) else 0.5
        return ToxicityModel(lexicon, float(np.log(share / (1 - share))), np.zeros(len(SIGNALS)), None)
    said = votes(x)
    model = fit_label_model(said, gold.mean())
    intercept, weights = logistic_weights(_inputs(x), model.posterior(said), ridge=1e-4, steps=1500)
    return ToxicityModel(lexicon, intercept, weights, model)


def _with_signals(docs: DataFrame, lexicon: Lexicon, *keep: str) -> DataFrame:
    columns = [*keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([signals(t, lexicon) for t in texts(batch)], dtype=np.float64).reshape(-1, len(SIGNALS))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], *[pa.array(x[:, i].copy()) for i in range(len(SIGNALS))]],
                names=[*columns, *SIGNALS],
            )

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields]
    return docs.select(*keep, "text").mapInArrow(run, ", ".join([*kept, *[f"{s} double" for s in SIGNALS]]))


def scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs`` (doc_id, text).

    Every text is scored whole; NULL and empty texts have all signals zero. Rows without an id are scored and never held
    out. Repeated rows get equal scores.
    """
    total = F.lit(model.intercept)
    for name, weight in zip(SIGNALS, model.weights, strict=True):
        total = total + F.log1p(F.greatest(F.col(name), F.lit(0.0))) * F.lit(float(weight))
    scored = _with_signals(docs, model.lexicon, "doc_id").select(
        "doc_id", (F.lit(1.0) / (F.lit(1.0) + F.exp(-total))).alias("score")
    )
    return scored.select(
        "doc_id",
        in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
