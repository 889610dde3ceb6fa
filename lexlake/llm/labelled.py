"""Bounded samples of labelled documents, and the solver for logistic weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.llm.common import in_fold


def label_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int, seed: int
) -> DataFrame:
    """doc_id, text, target of at most ``rows`` labelled documents outside the held-out fold.

    A document with several labels has their majority, 1 on a tie; NULL labels and ids don't count. The sample is the
    rows with the smallest hash of the id, so it does not depend on how the tables are cut. It is bounded by ``rows``
    and so may be broadcast; of ``docs`` only what matches goes on.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.where(~in_fold(F.col("doc_id"), folds, held_out))
    voted = known.groupBy(F.col("doc_id").alias("label_id")).agg(
        (F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("target")
    )
    chosen = voted.orderBy(F.xxhash64(F.lit(seed), "label_id"), "label_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).drop("label_id")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def logistic_weights(
    x: np.ndarray, y: np.ndarray, lasso: float = 0.0, ridge: float = 0.0, steps: int = 400
) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic fit by accelerated proximal gradient; ``y`` may hold probabilities."""
    n, k = x.shape
    design = np.hstack([np.ones((n, 1)), x])
    bound = np.linalg.norm(design, 2) ** 2 / (4 * n) + ridge if n else 1.0
    w = np.zeros(k + 1)
    share = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    w[0] = np.log(share / (1 - share))
    ahead, pace = w.copy(), 1.0
    for _ in range(steps):
        slope = design.T @ (sigmoid(design @ ahead) - y) / max(n, 1)
        slope[1:] += ridge * ahead[1:]
        new = ahead - slope / bound
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - lasso / bound, 0)
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = new + (pace - 1) / faster * (new - w)
        w, pace = new, faster
    return float(w[0]), w[1:]
