"""SimHash near-dedup by anchor-point covering.

The anchors are the words of a covering code over 64 bits: the direct sum of two binary Golay codes of length 23 and of
the trivial code on the other 18 bits. The Golay code is perfect: each word of 23 bits is within 3 bits of just one code
word. A fingerprint's home is the anchor next to it. A fingerprint that differs from another in at most 3 bits is within
3 + t bits of the other's home in one block and 3 + s in the other, with t + s at most 3; so every fingerprint is
replicated to all anchors within these radii, and homes are compared with replicas anchor by anchor. No link is lost.

Equal fingerprints are one fingerprint throughout, and an anchor with very many is cut into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.llm.common import texts, words
from lexlake.llm.links import components, forest
from lexlake.session import written

SEED = 42
SHINGLE = 3
DISTANCE = 3
# fingerprints at home in one anchor that are compared in one block
BLOCK = 4_096
# replicas dealt to one task, about
TASK_ROWS = 1_000_000

_N, _RADIUS = 23, 3
# generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
_GOLAY = 0b110001110101


def fingerprint(text: str | None) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes; zero without words."""
    found = words(text)
    if not found:
        return 0
    if len(found) < SHINGLE:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(found, found[1:], found[2:], strict=False))
    n = max(len(found) - SHINGLE + 1, 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.dtype("<u8"), n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and print (the fingerprint as a signed long) per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t) for t in texts(batch)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(prints)], names=[*keep, "print"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields]
    return docs.select(*keep, "text").mapInArrow(run, ", ".join([*kept, "print long"]))


def syndrome(word: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the generator: zero for code words."""
    rest = word.astype(np.int64)
    for bit in range(_N - 1, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (_GOLAY << (bit - 11)), rest)
    return rest


@cache
def offsets() -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """How far each syndrome's words are from the code (0 to 3), and per excess the differences to anchors.

    The second part holds for excess t = 0..3 arrays (start, difference): the differences of weight up to 3 for t = 0,
    and of weight 3 + t beyond, that lead from a word with syndrome s to code words are difference[start[s]:start[s+1]].
    """
    by_excess: list[list[np.ndarray]] = [[] for _ in range(DISTANCE + 1)]
    for weight in range(_RADIUS + DISTANCE + 1):
        found = np.array([sum(1 << b for b in bits) for bits in combinations(range(_N), weight)], dtype=np.int64)
        by_excess[max(weight - _RADIUS, 0)].append(found)
    out = []
    for parts in by_excess:
        differences = np.concatenate(parts)
        marks = syndrome(differences)
        order = np.argsort(marks, kind="stable")
        out.append((np.searchsorted(marks[order], np.arange(2049)), differences[order]))
    near = np.bitwise_count(out[0][1][out[0][0][:-1]].astype(np.uint64))
    return near, out


def _spread(marks: np.ndarray, excess: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, difference) of every anchor at the given excess of words with these syndromes."""
    start, differences = offsets()[1][excess]
    count = start[marks + 1] - start[marks]
    row = np.repeat(np.arange(len(marks)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start[marks], count)
    return row, differences[at]


def home(words_: np.ndarray) -> np.ndarray:
    """Names of the anchors next to 23-bit words."""
    start, differences = offsets()[1][0]
    return (words_ ^ differences[start[syndrome(words_)]]) >> 11


_MASK = np.uint64((1 << _N) - 1)


def blocks_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two blocks of 23 bits of each fingerprint."""
    value = prints.view(np.uint64)
    return (value & _MASK).astype(np.int64), (value >> np.uint64(_N) & _MASK).astype(np.int64)


def first_anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, name) of the anchors in the first block that each fingerprint goes to.

    A code word is named by its upper 12 bits, which tell it from all others.
    """
    first, _ = blocks_of(prints)
    found = [_spread(syndrome(first), t) for t in range(DISTANCE + 1)]
    row = np.concatenate([r for r, _ in found])
    return row, (first[row] ^ np.concatenate([c for _, c in found])) >> 11


def excess_of(prints: np.ndarray, names: np.ndarray) -> np.ndarray:
    """How far each fingerprint's first block is from an anchor, beyond the covering radius."""
    word = names << 11
    word = word ^ syndrome(word)
    far = np.bitwise_count((blocks_of(prints)[0] ^ word).astype(np.uint64)).astype(np.int64)
    return np.maximum(far - _RADIUS, 0)


def second_anchors(prints: np.ndarray, excess: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, name, home) of the anchors in the second block, within what the first block has left of the radius."""
    _, second = blocks_of(prints)
    marks = syndrome(second)
    rows, names, homes = [], [], []
    for s in range(DISTANCE + 1):
        of = np.flatnonzero(excess <= DISTANCE - s)
        row, change = _spread(marks[of], s)
        rows.append(of[row])
        names.append((second[of[row]] ^ change) >> 11)
        homes.append((excess[of[row]] == 0) & (s == 0))
    return np.concatenate(rows), np.concatenate(names), np.concatenate(homes)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("print").to_numpy(zero_copy_only=False).astype(np.int64)
        for at in range(0, len(prints), 4096):
            part = prints[at : at + 4096]
            row, name = first_anchors(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(name.astype(np.int32)), pa.array(part[row])], names=["anchor", "print"]
            )


def _homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("print").to_numpy(zero_copy_only=False).astype(np.int64)
        name = [home(word) for word in blocks_of(prints)]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in name], names=["anchor", "second"])


def matches(unit: np.ndarray, prints: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between homes and replicas of the same unit; rows are sorted by unit."""
    at_home = np.flatnonzero(home)
    units, values = unit[at_home], prints[at_home]
    away = np.flatnonzero(~home)
    low, high = np.searchsorted(units, unit[away], "left"), np.searchsorted(units, unit[away], "right")
    # homes meet each other too: each is a replica for those after it
    low = np.concatenate([low, np.arange(1, len(at_home) + 1)])
    high = np.concatenate([high, np.searchsorted(units, units, "right")])
    others = np.concatenate([prints[away], values])
    some = high > low
    low, high, others = low[some], high[some], others[some]
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    ends = np.cumsum(high - low)
    begin = 0
    while begin < len(low):  # a bounded number of comparisons at a time
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + 2_000_000, "right")))
        count = (high - low)[begin:end]
        mine = np.repeat(others[begin:end], count)
        at = np.arange(len(mine)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[begin:end], count)
        theirs = values[at]
        near = np.bitwise_count((mine ^ theirs).view(np.uint64)) <= DISTANCE
        a, b = forest(mine[near], theirs[near])
        left.append(a)
        right.append(b)
        begin = end
    return forest(np.concatenate(left), np.concatenate(right))


# what a row stands for in its unit: all its anchors, its home only, or all its anchors but as a replica at home too
_BOTH, _AT_HOME, _AWAY = 0, 1, 2


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links found among rows (anchor, print and, where anchors are split, block, cell, role) sorted by unit."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def compared(parts: list[tuple[np.ndarray, ...]], last: bool):
        unit, prints, role = (np.concatenate(x) for x in zip(*parts, strict=True))
        cut = len(unit) if last else int(np.searchsorted(unit, unit[-1], "left"))
        excess = excess_of(prints[:cut], unit[:cut] >> 40)
        row, second, home = second_anchors(prints[:cut], excess)
        use = np.where(role[row] == _AT_HOME, home, True)
        home = home & (role[row] != _AWAY)
        row, second, home = row[use], second[use], home[use]
        # units of the whole anchor: the row's unit is below 2^52, a second block's name below 2^12
        order = np.lexsort((second, unit[row]))
        row, second, home = row[order], second[order], home[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (unit[row[1:]] != unit[row[:-1]]) | (second[1:] != second[:-1])
        a, b = matches(np.cumsum(new), prints[row], home)
        return (unit[cut:], prints[cut:], role[cut:]), pa.RecordBatch.from_arrays(
            [pa.array(a), pa.array(b)], names=["a", "b"]
        )

    for batch in batches:
        columns = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.schema.names}
        unit = columns["anchor"] << 40
        if "block" in columns:
            unit |= columns["block"] << 20 | columns["cell"]
        held.append((unit, columns["print"], columns.get("role", np.zeros(len(unit), np.int64))))
        size += len(unit)
        if size >= 200_000:
            rest, found = compared(held, last=False)
            held, size = [rest], len(rest[0])
            yield found
    if size:
        yield compared(held, last=True)[1]


def near_links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all fingerprints of ``prints`` (print: distinct longs) at `DISTANCE` bits or fewer.

    Rows are dealt out by the anchor of the first block only; those of the second block are found in the task.
    """
    spark = prints.sparkSession
    n = prints.count()
    # 71 anchors of the first block for each fingerprint on average; tasks grow with the input
    cores = spark.sparkContext.defaultParallelism
    tasks = max(cores * 2, n * 71 // TASK_ROWS)
    spread = prints.repartition(max(cores, n * 71 // TASK_ROWS))
    replicas = spread.mapInArrow(_replicate, "anchor int, print long")
    crowds = spread.mapInArrow(_homes, "anchor int, second int").groupBy("anchor", "second").agg(F.count(F.lit(1)).alias("n"))
    hot = (
        crowds.where(F.col("n") > block)
        .groupBy("anchor")
        .agg(F.ceil(F.max("n") / float(block)).cast("int").alias("blocks"))
    )
    hot = written(hot, "simhash-hot")
    if hot.isEmpty():
        dealt = replicas.repartition(tasks, "anchor").sortWithinPartitions("anchor")
        return dealt.mapInArrow(_compare, "a long, b long")
    # a crowded anchor becomes blocks x blocks units: homes of one block against replicas of one cell
    joined = replicas.join(hot, "anchor", "left")
    plain = joined.where(F.col("blocks").isNull()).select(
        "anchor", F.lit(0).alias("block"), F.lit(0).alias("cell"), F.lit(_BOTH).alias("role"), "print"
    )
    crowded = joined.where(F.col("blocks").isNotNull()).withColumn(
        "own", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    )
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    crowded = crowded.select("anchor", "print", "own", every)
    homes = crowded.select(
        "anchor", F.col("own").alias("block"), F.col("other").alias("cell"), F.lit(_AT_HOME).alias("role"), "print"
    )
    away = crowded.select(
        "anchor", F.col("other").alias("block"), F.col("own").alias("cell"), F.lit(_AWAY).alias("role"), "print"
    )
    units = plain.unionByName(homes).unionByName(away)
    dealt = units.repartition(tasks, "anchor", "block", "cell").sortWithinPartitions("anchor", "block", "cell")
    return dealt.mapInArrow(_compare, "a long, b long")


def with_groups(docs: DataFrame, *keep: str) -> DataFrame:
    """print, first_id, component_id, group_id per distinct fingerprint, besides the rows' own (keep, print).

    Returns the rows (``keep`` columns, print) joined with the component of their fingerprint.
    """
    rows = written(fingerprints(docs, *keep), "simhash-prints")
    classes = written(rows.groupBy("print").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    roots = components(near_links(classes.select("print")), "simhash")
    found = classes.join(roots, F.col("print") == F.col("node"), "left").select(
        "print", "first_id", F.coalesce("root", "print").alias("group_id")
    )
    smallest = found.groupBy("group_id").agg(F.min("first_id").alias("component_id"))
    groups = found.join(smallest, "group_id").select(F.col("print").alias("class_print"), "group_id", "component_id")
    return rows.join(groups, F.col("print") == F.col("class_print")).drop("class_print")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id per row of ``docs`` (doc_id, text).

    component_id is the smallest id that links of `DISTANCE` bits or fewer reach. Texts without words, NULL included, have
    fingerprint zero and link like any other. Rows without an id take part; a group of nothing else has a NULL
    component_id. Repeated rows give repeated rows; an empty table gives none.
    """
    grouped = with_groups(docs.select("doc_id", "text"), "doc_id")
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` per group of near duplicates, with the columns of ``docs``: the one with the smallest id.

    Rows without an id come last, then the smaller hash of the text decides; of rows that still agree one stays. Groups
    are those of `near_copies`: five-word shingles, similarity 0.8, found by longer fingerprints in the cells of many anchor
    sets. They are formed on ids and hashes, and on the texts of candidates; whole rows are shuffled once more, to meet the
    decision.
    """
    from lexlake.llm import near_copies  # which is built on this module

    keyed = docs.select("doc_id", "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"))
    rows = near_copies.with_groups(keyed)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    first = rows.groupBy("group_id").agg(F.min(order).alias("first"))
    # how many rows share the first one's id and text, to tell whether any are to be dropped among themselves
    copies = rows.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    chosen = (
        first.select("first.doc_id", "first.text_hash")
        .join(
            copies.select(F.col("doc_id").alias("c_id"), F.col("text_hash").alias("c_hash"), "rows"),
            F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_hash") == F.col("c_hash")),
        )
        .select("c_id", "c_hash", "rows")
    )
    chosen = written(chosen, "simhash-chosen")
    whole = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.col("doc_id").alias("r_id"),
        F.coalesce(F.xxhash64("text"), F.lit(0)).alias("r_hash"),
    )
    kept = whole.join(chosen, F.col("r_id").eqNullSafe(F.col("c_id")) & (F.col("r_hash") == F.col("c_hash")))
    single = kept.where("rows = 1").select("row.*")
    repeated = kept.where("rows > 1").groupBy("c_id", "c_hash").agg(F.first("row").alias("row")).select("row.*")
    return single.unionByName(repeated)
