"""Quality classifier: a sparse ensemble of rules over text statistics.

Small trees are boosted on the statistics of labelled documents. Every path from a root to a node is a rule, a
conjunction of bounds on statistics. A logistic fit with a lasso penalty keeps few of the rules, and those are compiled
into one Spark column expression over the statistics' columns.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.llm.common import in_fold, texts
from lexlake.llm.labelled import label_sample, logistic_weights, sigmoid

# the fold that is never learned from, and the score from which a document counts as good
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
# labelled documents learned from at most
SAMPLE_ROWS = 20_000

_SYMBOLS = b"#$%&*|@^~<>{}[]\\=+_"
STATISTICS = (
    "log_bytes",
    "log_words",
    "mean_word",
    "distinct_words",
    "top_word",
    "same_as_before",
    "short_words",
    "closed_words",
    "symbol_words",
    "upper",
    "digits",
    "symbols",
    "pipes",
    "exclamations",
    "punctuation",
    "blanks",
    "beyond_ascii",
    "log_lines",
    "repeated_lines",
    "longest_line",
)


def _class(members: bytes) -> np.ndarray:
    mask = np.zeros(256)
    mask[list(members)] = 1
    return mask


_CLASSES = np.stack(
    [
        _class(bytes(range(65, 91))),
        _class(b"0123456789"),
        _class(_SYMBOLS),
        _class(b"|"),
        _class(b"!"),
        _class(b".,;:!?'\"()-"),
        _class(b" \t\r\n\x0b\x0c"),
        _class(bytes(range(128, 256))),
    ],
    axis=1,
)


def statistics(text: str | None) -> list[float]:
    """The numbers in `STATISTICS` of a whole text; all zero for NULL and empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(STATISTICS)
    shares = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES) / len(raw)
    found = raw.split()
    n = max(len(found), 1)
    counts = Counter(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    lines = raw.split(b"\n")
    return [
        float(np.log1p(len(raw))),
        float(np.log1p(len(found))),
        float(lengths.mean()) if len(found) else 0.0,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(bytes.__eq__, found, found[1:])) / n,
        float((lengths <= 3).sum()) / n,
        sum(c for w, c in counts.items() if w[-1] in b".,;:!?") / n,
        sum(c for w, c in counts.items() if w[-1] in _SYMBOLS or w[0] in _SYMBOLS) / n,
        *map(float, shares),
        float(np.log1p(len(lines))),
        1 - len(set(lines)) / len(lines),
        max(map(len, lines)) / len(raw),
    ]


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and the statistics of each row's text, in the order of rows."""
    columns = [*keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(t) for t in texts(batch)], dtype=np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], *[pa.array(rows[:, i].copy()) for i in range(len(STATISTICS))]],
                names=[*columns, *STATISTICS],
            )

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields]
    return docs.select(*keep, "text").mapInArrow(run, ", ".join([*kept, *[f"{s} double" for s in STATISTICS]]))


# a bound: statistic, whether values up to the threshold hold, threshold
Bound = tuple[int, bool, float]
Rule = tuple[Bound, ...]


@dataclass(frozen=True)
class RuleModel:
    """Rules with their weights; the score is the logistic function of their sum."""

    intercept: float
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]

    def column(self) -> Column:
        """The score as a Spark column over the statistics' columns."""
        terms = [F.lit(self.intercept)]
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = reduce(
                Column.__and__,
                [
                    F.col(STATISTICS[s]) <= F.lit(limit) if below else F.col(STATISTICS[s]) > F.lit(limit)
                    for s, below, limit in rule
                ],
            )
            terms.append(F.when(holds, F.lit(weight)).otherwise(F.lit(0.0)))
        while len(terms) > 1:  # added up in pairs, so that the expression stays flat
            terms = [a + b for a, b in zip(terms[::2], terms[1::2], strict=False)] + terms[len(terms) & ~1 :]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-terms[0]))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total += weight * holds(rule, x)
        return sigmoid(total)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for s, below, limit in rule:
        out &= (x[:, s] <= limit) if below else (x[:, s] > limit)
    return out


def _grow(x: np.ndarray, slope: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], path: Rule, depth: int, leaf: int):
    """One tree on the slopes: (rules of all its nodes, leaves as (rows, value))."""
    value = slope[rows].mean()
    if depth == 0 or len(rows) < 2 * leaf:
        return [], [(rows, value)]
    best, choice = 1e-9, None
    total, n = slope[rows].sum(), len(rows)
    for s, limits in enumerate(cuts):
        if not len(limits):
            continue
        bins = np.searchsorted(limits, x[rows, s])  # x <= limits[b] goes to bin b or lower
        count = np.cumsum(np.bincount(bins, minlength=len(limits) + 1))[:-1]
        below = np.cumsum(np.bincount(bins, weights=slope[rows], minlength=len(limits) + 1))[:-1]
        fits = (count >= leaf) & (n - count >= leaf)
        if not fits.any():
            continue
        gain = np.where(
            fits, below**2 / np.maximum(count, 1) + (total - below) ** 2 / np.maximum(n - count, 1) - total**2 / n, -1
        )
        at = int(gain.argmax())
        if gain[at] > best:
            best, choice = gain[at], (s, float(limits[at]))
    if choice is None:
        return [], [(rows, value)]
    s, limit = choice
    rules, leaves = [], []
    low = x[rows, s] <= limit
    for below, part in ((True, rows[low]), (False, rows[~low])):
        rule = (*path, (s, below, limit))
        more, ends = _grow(x, slope, part, cuts, rule, depth - 1, leaf)
        rules += [rule, *more]
        leaves += ends
    return rules, leaves


def fit_rules(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.15,
    lasso: float = 2e-3,
    seed: int = 4,
    limits: int = 48,
) -> RuleModel:
    """Boost trees on half of the rows each, take their rules, and weigh the rules by lasso logistic regression.

    Without rows the score is 0.5 everywhere, with one class the smoothed share of that class.
    """
    n = len(y)
    prior = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(prior / (1 - prior)))
    if n < 4 or y.min() == y.max():
        return RuleModel(base, (), ())
    rng = np.random.default_rng(seed)
    cuts = []
    for s in range(x.shape[1]):
        points = np.unique(np.quantile(x[:, s], np.linspace(0, 1, limits + 1)[1:-1]))
        cuts.append(points[points < x[:, s].max()])
    leaf = max(2, n // 400)
    margin = np.full(n, base)
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = sigmoid(margin)
        rows = np.sort(rng.permutation(n)[: max(n // 2, 2)])
        found, leaves = _grow(x, y - p, rows, cuts, (), depth, leaf)
        rules.update(dict.fromkeys(_shortened(r) for r in found))
        if not found:
            continue
        # the step is applied to all rows through the leaves' rules
        for rule, value in _leaf_rules(found, leaves, x, rows):
            margin[holds(rule, x)] += rate * 4 * value
    kept = list(rules)
    if not kept:
        return RuleModel(base, (), ())
    design = np.stack([holds(r, x) for r in kept], axis=1).astype(np.float64)
    share = design.mean(axis=0)
    use = (share > 0) & (share < 1)
    kept, design = [r for r, ok in zip(kept, use, strict=True) if ok], design[:, use]
    scale = np.sqrt(share[use] * (1 - share[use])) ** 0.5
    intercept, weights = logistic_weights(design / scale, y, lasso=lasso, steps=400)
    weights = weights / scale
    live = [i for i in np.argsort(-np.abs(weights)) if abs(weights[i]) > 1e-6]
    return RuleModel(intercept, tuple(kept[i] for i in live), tuple(float(weights[i]) for i in live))


def _shortened(rule: Rule) -> Rule:
    """The rule with one bound per statistic and side, in a fixed order."""
    tight: dict[tuple[int, bool], float] = {}
    for s, below, limit in rule:
        now = tight.get((s, below))
        tight[s, below] = limit if now is None else (min(now, limit) if below else max(now, limit))
    return tuple((s, below, limit) for (s, below), limit in sorted(tight.items()))


def _leaf_rules(found: list[Rule], leaves, x: np.ndarray, rows: np.ndarray):
    """Rules that no other rule of the tree extends, with the value of the leaf they lead to."""
    inner = {r[:-1] for r in found}
    ends = [r for r in found if r not in inner]
    for rule, (_, value) in zip(ends, leaves, strict=True):
        yield rule, value


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> RuleModel:
    """A model from a bounded sample of labelled documents; labels, language, source and id are no inputs."""
    sample = label_sample(docs, labels, "quality", FOLDS, HELD_OUT, rows, seed=4)
    found = with_statistics(sample, "doc_id", "target").orderBy("doc_id", *STATISTICS).toPandas()
    return fit_rules(found[list(STATISTICS)].to_numpy(np.float64), found["target"].to_numpy(np.float64))


def scores(docs: DataFrame, model: RuleModel) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs`` (doc_id, text).

    Every text is scored whole; NULL and empty texts have all statistics zero. Rows without an id are scored and never
    held out. Repeated rows get equal scores.
    """
    scored = with_statistics(docs, "doc_id").select("doc_id", model.column().alias("score"))
    return scored.select(
        "doc_id",
        in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns; no shuffle."""
    model = learn(docs, labels)
    named = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    packed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()], F.col("text"))
    kept = with_statistics(packed, *named.values()).where(model.column() >= THRESHOLD)
    return kept.select(*[F.col(n).alias(c) for c, n in named.items()])
