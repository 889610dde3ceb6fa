"""Linked groups: forests of links inside a task, and components of a whole graph."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.session import written


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what ``left``-``right`` connect, at most one per node: (node, smallest node it reaches)."""
    if not len(left):
        return left, right
    nodes, flat = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = flat[: len(left)], flat[len(left) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        # hook both ends and their present labels, then shorten the chains
        for ends in (a, b, before[a], before[b]):
            np.minimum.at(label, ends, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(before, label):
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def components(links: DataFrame, label: str) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: longs); root is the smallest node of the node's component.

    Alternating large and small stars: each node hands its larger neighbours to its smallest one, then its smaller
    neighbours, until every component is a star. Only minima are gathered per node, which combine before the shuffle, so
    a node with very many links is no burden; the join back may be split where it is skewed. Every round is written to
    the shared folder. Self links and repeated links do no harm; an empty table gives an empty one.
    """
    a, b = F.col("a"), F.col("b")
    edges = links.where(a != b).select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct()
    edges = written(edges, f"{label}-links")
    state = _state(edges)
    while state[0]:
        both = edges.select(F.col("high").alias("u"), F.col("low").alias("v")).unionByName(
            edges.select(F.col("low").alias("u"), F.col("high").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("centre"), F.least("u", "m").alias("m")
        )
        large = (
            both.where("v > u")
            .join(least, F.col("u") == F.col("centre"))
            .where("v != m")
            .select(F.col("v").alias("high"), F.col("m").alias("low"))
            .distinct()
        )
        smallest = large.groupBy("high").agg(F.min("low").alias("m")).select(F.col("high").alias("centre"), "m")
        small = (
            large.join(smallest, F.col("high") == F.col("centre"))
            .where("low != m")
            .select(F.col("low").alias("high"), F.col("m").alias("low"))
            .unionByName(smallest.select(F.col("centre").alias("high"), F.col("m").alias("low")))
            .distinct()
        )
        edges = written(small, f"{label}-stars")
        now = _state(edges)
        if now == state:
            break
        state = now
    stars = edges.select(F.col("high").alias("node"), F.col("low").alias("root"))
    return stars.unionByName(edges.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())
