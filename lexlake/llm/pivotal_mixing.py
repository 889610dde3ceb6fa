"""Mixing sources to target weights by pivotal dependent rounding.

Every document gets a fractional number of copies, its source's target divided by its source's words. Whole copies are
taken at once. The fraction left is rounded by pivotal sampling: two documents meet, words are moved from one to the
other at random until one of them has a whole number of copies, and the other goes on to meet the next. The words
of a source stay the same in every step, so that what is taken misses the target by less than one document.

A source is cut into leaves of bounded size by a hash of the document, so a source with a third of all rows is spread
over many tasks. A leaf leaves at most one document open; open documents meet in a tree, `FAN_IN` leaves at a time.
All draws come from hashes of the rows, so that reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexlake.llm.common import WORD
from lexlake.session import written

# weights that the sources take in turn, the share of all words to take, and the most copies of a document
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
# documents rounded in one group, and open documents that meet in one group of the tree
LEAF_ROWS = 1_000
FAN_IN = 1_000

_NEAR = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES
) -> DataFrame:
    """One row per source of ``sized`` (source, size): source, n_rows, source_size, target.

    Sources take the weights in turn, in code point order with NULL last. A target is weight x level, or ``most`` times
    the source's words where that is less; the level is the one at which targets add up to the share asked for. It is
    found without iterating: with sources sorted by the level at which they are full, the level follows from running
    sums. The windows run over one row per source.
    """
    totals = sized.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("size").cast("long").alias("source_size")
    )
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    turn = (F.row_number().over(in_order) - 1) % len(weights) + 1
    ranked = totals.withColumn("weight", F.element_at(cycle, turn.cast("int")))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.col("source_size") * float(most)
    ranked = ranked.withColumn("cap", cap).withColumn("full_at", F.col("cap") / F.col("weight"))
    by_level = Window.orderBy(F.col("full_at"), F.col("source").asc_nulls_first())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    asked = F.sum("source_size").over(everything) * float(share)
    level = (asked - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    ranked = ranked.withColumn("level_here", level)
    # the first source that is not full at its level settles the level; those after it give lower ones
    settled = F.max(F.when(F.col("level_here") <= F.col("full_at"), F.col("level_here"))).over(everything)
    ranked = ranked.withColumn("level", settled)
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap")))
    return ranked.select("source", "n_rows", "source_size", target.alias("target"))


def settle(size: np.ndarray, fraction: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int, float]:
    """Round fractions of copies in order; (0 or 1 per row, position left open or -1, its fraction).

    Moving w words from one row to the other keeps their total; either direction is drawn with the probability that
    keeps each row's expected copies.
    """
    up = np.zeros(len(size), dtype=np.int64)
    held, share = -1, 0.0
    for i, (own, p, u) in enumerate(zip(size.tolist(), fraction.tolist(), draw.tolist(), strict=True)):
        if p <= _NEAR or p >= 1 - _NEAR:
            up[i] = p > 0.5
            continue
        if held < 0:
            held, share = i, p
            continue
        other = float(size[held])
        rise = min((1 - share) * other, p * own)
        fall = min(share * other, (1 - p) * own)
        if u * (rise + fall) < fall:
            share, p = share + rise / other, p - rise / own
        else:
            share, p = share - fall / other, p + fall / own
        if p <= _NEAR or p >= 1 - _NEAR:
            up[i] = p > 0.5
        if share <= _NEAR or share >= 1 - _NEAR:
            up[held] = share > 0.5
            held = -1
        if held < 0 and _NEAR < p < 1 - _NEAR:
            held, share = i, p
    return up, held, share


def _round_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["item_id", "item_hash", "size", "draw"], na_position="last").reset_index(drop=True)
    up, held, share = settle(pdf["size"].to_numpy(), pdf["fraction"].to_numpy(), pdf["draw"].to_numpy())
    pdf["up"] = up
    pdf["open"] = False
    if held >= 0:
        pdf.loc[held, "open"] = True
        pdf.loc[held, "fraction"] = share
    return pdf


_ITEM = (
    "source string, leaf long, item_id long, item_hash long, size long, source_size long, target double, whole long, "
    "fraction double, draw double"
)


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_COPIES,
    seed: int = 9,
    leaf_rows: int = LEAF_ROWS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, item_hash, source, size, source_size, target, copies.

    A NULL or empty text has size 0 and takes part as any other document; its copies are drawn by themselves, as they
    move no words. NULL sources form one source. Rows without an id and repeated rows are documents of their own. An
    empty table gives no rows. ``item_hash`` is the hash of the text, NULL for a NULL text.
    """
    sized = docs.select(
        F.col("doc_id").cast("long").alias("item_id"),
        F.xxhash64("text").alias("item_hash"),
        F.col("source"),
        word_count(F.col("text")).alias("size"),
    )
    sized = written(sized, "mix-sizes")
    targets = source_targets(sized, weights, share, most)
    leaves = F.ceil(F.col("n_rows") / float(leaf_rows)).cast("long")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    per_source = targets.select(
        F.col("source").alias("of_source"), "source_size", "target", leaves.alias("leaves"), expected.alias("expected")
    )
    uniform = F.pmod(F.xxhash64(F.lit(seed), "item_id", "item_hash", "size"), F.lit(1 << 52)) / float(1 << 52)
    # sources are few beside their rows: the join's other side is one aggregated row per source
    items = (
        sized.join(per_source, F.col("source").eqNullSafe(F.col("of_source")))
        .withColumn("leaf", F.pmod(F.xxhash64(F.lit(seed + 1), "item_id", "item_hash"), F.col("leaves")))
        .withColumn("whole", F.least(F.floor("expected"), F.lit(most)).cast("long"))
        .withColumn("fraction", F.col("expected") - F.col("whole"))
        .withColumn("draw", uniform)
        .select(*[c.split()[0] for c in _ITEM.split(", ")])
    )
    alone = F.col("size") == 0
    drawn = items.where(alone).withColumn("up", (F.col("draw") < F.col("fraction")).cast("long"))
    rounded = written(
        items.where(~alone)
        .groupBy("source", "leaf")
        .applyInPandas(_round_group, f"{_ITEM}, up long, open boolean"),
        "mix-leaves",
    )
    settled = _meet(rounded, fan_in)
    closed = rounded.where(~F.col("open"))
    last = (
        rounded.where("open")
        .drop("up")
        .join(
            settled.select(
                F.col("source").alias("s_source"), F.col("leaf").alias("s_leaf"), F.col("up").cast("long").alias("up")
            ),
            F.col("source").eqNullSafe(F.col("s_source")) & (F.col("leaf") == F.col("s_leaf")),
        )
    )
    columns = ["item_id", "item_hash", "source", "size", "source_size", "target", "whole", "up"]
    every = closed.select(*columns).unionByName(last.select(*columns)).unionByName(drawn.select(*columns))
    return every.select(
        F.col("item_id").alias("doc_id"),
        "item_hash",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("whole") + F.col("up")).alias("copies"),
    )


def _meet(rounded: DataFrame, fan_in: int) -> DataFrame:
    """Settle the one open document that each leaf may leave, level by level: source, leaf, up."""
    level = rounded.where("open").select(*[c.split()[0] for c in _ITEM.split(", ")]).withColumn("node", F.col("leaf"))
    schema = f"{_ITEM}, node long, up long, open boolean"
    done: DataFrame | None = None
    while True:
        level = level.withColumn("node", F.floor(F.col("node") / fan_in).cast("long"))
        met = written(level.groupBy("source", "node").applyInPandas(_round_group, schema), "mix-tree")
        top = (met.agg(F.max("node").alias("n")).first()["n"] or 0) == 0
        # at the top one document per source is still open: its own draw settles it
        up = F.when(F.col("open"), (F.col("draw") < F.col("fraction")).cast("long")).otherwise(F.col("up"))
        found = (met if top else met.where(~F.col("open"))).select("source", "leaf", up.alias("up"))
        done = found if done is None else done.unionByName(found)
        if top:
            return done
        level = met.where("open").drop("up", "open")


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``.

    Copies are decided on ids, text hashes and sizes; whole rows are shuffled once, to meet their decision. Rows that
    agree in id, text and source share their copies out among themselves.
    """
    decided = (
        mix(docs, **settings)
        .groupBy("doc_id", "item_hash", "source")
        .agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
        .select(
            F.col("doc_id").alias("m_id"),
            F.col("item_hash").alias("m_hash"),
            F.col("source").alias("m_source"),
            "copies",
            "rows",
        )
    )
    whole = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("r_id"),
        F.xxhash64("text").alias("r_hash"),
        F.col("source").alias("r_source"),
    )
    joined = whole.join(
        decided,
        F.col("r_id").eqNullSafe(F.col("m_id"))
        & F.col("r_hash").eqNullSafe(F.col("m_hash"))
        & F.col("r_source").eqNullSafe(F.col("m_source")),
    )
    # rows that agree: the first `copies % rows` of them take one more than the others
    same = Window.partitionBy("r_id", "r_hash", "r_source").orderBy(F.lit(0))
    rank = F.when(F.col("rows") == 1, F.lit(1)).otherwise(F.row_number().over(same))
    extra = (rank <= F.col("copies") % F.col("rows")).cast("long")
    times = F.when(F.col("rows") == 1, F.col("copies")).otherwise(F.floor(F.col("copies") / F.col("rows")) + extra)
    return (
        joined.withColumn("times", times.cast("int"))
        .where("times > 0")
        .select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
        .select("row.*")
    )
