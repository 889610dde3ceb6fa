"""SimHash near-dedup by anchor points at a wider radius: five-word shingles, a Jaccard similarity of 0.8 or more.

At a similarity of 0.8 some 15% of a SimHash fingerprint's bits differ, more than one covering code of 64 bits can bridge.
So a set has a sketch of 512 such bits, and there are many anchor sets, each over 23 bits drawn from these (binary Golay
code) and, in large tables, some further ones taken as they are. In each a sketch goes to its home, the anchor next to it,
and sketches that are at home together are compared. Anchor sets are added until sketches that differ in `DIFFERENT` of
their bits, more than the similarity asked for needs, meet with probability `MEET`; their number grows with the table.

Sketches that meet within `FAR` of 128 bits and `FAR_HELD` of 256 are candidates, which are then compared by their whole sets.
By the first alone unrelated sketches pass one time in 60,000, which in a large table is often enough to connect very many of
its documents; by both they hardly ever do. Texts of candidates are fetched once: documents that candidates connect meet in
one task. Equal sets are one throughout, and a set is compared
with a group until it links, so a large group of near copies takes about one comparison for each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.llm.common import texts, words
from lexlake.llm.links import components, forest
from lexlake.llm.simhash_anchors import home
from lexlake.session import written

SHINGLE = 5
SIMILARITY = 0.8
# 64-bit words of a sketch, and those of them that are compared first, in at most so many bits
WORDS, COMPARED, FAR = 8, 2, 40
# words that are sent along, these first, and the bits that may differ in all of them
HELD, FAR_HELD = 4, 76
# share of bits that may differ, how often such sketches meet, and how often they share a home in one Golay code
MEET, DIFFERENT, SHARED_HOME = 0.995, 0.17, 0.0945
# sketches that one anchor has, and links that a task merges, about
CROWD, LINKS = 256, 2_000_000

_SEED = 42
_DRAW = 23
_SALTS = np.random.default_rng(_SEED).integers(0, 1 << 63, WORDS, dtype=np.uint64)[:, None]
_LANES = np.uint64(0x0101010101010101)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text of fewer words is one shingle, one without words none."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    n = max(len(found) - SHINGLE + 1, 1)
    shingles = map(b" ".join, zip(*(found[i:] for i in range(SHINGLE)), strict=False)) if n > 1 else [b" ".join(found)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(_SEED)), np.uint64, n))


def sketch(hashes: np.ndarray) -> bytes:
    """SimHash of a set: bits set in over half of its members' mixed hashes; in just half, as in the least member's."""
    n = len(hashes)
    ones = np.zeros((WORDS, 8, 8), np.int64)
    least = np.zeros(WORDS, np.uint64)
    for at in range(0, n, 255 * 64):
        h = hashes[at : at + 255 * 64] ^ _SALTS
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        if not at:
            least = h[:, 0].copy()
        # each byte of a word counts one of its bits, for up to 255 members
        starts = np.arange(0, h.shape[1], 255)
        for bit in range(8):
            lanes = np.add.reduceat(h >> np.uint64(bit) & _LANES, starts, axis=1).astype("<u8")
            ones[:, :, bit] += lanes.view(np.uint8).reshape(WORDS, -1, 8).sum(axis=1, dtype=np.int64)
    own = np.unpackbits(least.astype("<u8").view(np.uint8), bitorder="little").astype(bool)
    twice = 2 * ones.ravel()
    return np.packbits((twice > n) | ((twice == n) & own), bitorder="little").tobytes()


def anchor_sets(n: int) -> np.ndarray:
    """Places of the sketch's bits, a row per anchor set, for a table of n sketches: 23 for the code, then plain ones."""
    plain = max(0, math.ceil(math.log2(max(n, 1) / (CROWD << 12))))
    together = SHARED_HOME * (1 - DIFFERENT) ** plain
    wanted = math.ceil(math.log(1 - MEET) / math.log(1 - together))
    rng = np.random.default_rng(_SEED)
    each = 64 * WORDS // (_DRAW + plain)
    drawn = [rng.permutation(64 * WORDS)[: each * (_DRAW + plain)] for _ in range(-(-wanted // each))]
    return np.concatenate(drawn).reshape(-1, _DRAW + plain)[:wanted]


def units(sketches: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The unit (anchor set, plain bits, home) that each sketch, a row of bytes, goes to in each anchor set."""
    bits = np.unpackbits(sketches, axis=1, bitorder="little").T.astype(np.int64)
    word, plain = np.zeros((2, len(places), len(sketches)), np.int64)
    for k in range(places.shape[1]):
        if k < _DRAW:
            word |= bits[places[:, k]] << k
        else:
            plain |= bits[places[:, k]] << (k - _DRAW)
    return np.arange(len(places))[:, None] << 48 | plain << 12 | home(word)


def far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ between the compared words, which the last axis holds."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words that are sent along, which the last axis holds, differ in so few bits that their sets may be similar."""
    return (far(a[..., :COMPARED], b[..., :COMPARED]) <= FAR) & (far(a, b) <= FAR_HELD)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have the similarity asked for."""
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= SIMILARITY * (len(a) + len(b) - shared)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, found = [], []
        for text in texts(batch):
            hashes = shingle_set(text)
            keys.append(xxhash.xxh128_digest(hashes.tobytes(), _SEED))
            found.append(sketch(hashes) if len(hashes) else None)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("text_hash"),
                pa.array(keys, pa.binary()),
                pa.array(found, pa.binary()),
            ],
            names=["doc_id", "text_hash", "set_key", "sketch"],
        )


def _held(sketches: list[bytes]) -> np.ndarray:
    """The words of sketches that are sent along, a row each."""
    return np.frombuffer(b"".join(sketches), "<u8").reshape(-1, WORDS)[:, :HELD]


_PRINT = [f"word{k}" for k in range(HELD)]


def _dealt(places: np.ndarray):
    """Rows (unit, node, and words that are sent along) for each sketch and anchor set of rows (node, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_numpy().astype(np.int64)
            found = batch.column("sketch").to_pylist()
            for at in range(0, len(found), 2_000):
                some = found[at : at + 2_000]
                raw = np.frombuffer(b"".join(some), np.uint8).reshape(len(some), -1)
                words_ = np.tile(_held(some).view(np.int64), (len(places), 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(units(raw, places).ravel()),
                        pa.array(np.tile(nodes[at : at + 2_000], len(places))),
                        *[pa.array(words_[:, k].copy()) for k in range(HELD)],
                    ],
                    names=["unit", "node", *_PRINT],
                )

    return run


def _crowded(prints: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect all sketches of one crowded anchor that are near each other.

    Those near one sketch are linked through it, so among themselves they need no comparison.
    """
    left, right, rest = [], [], np.arange(len(prints))
    while len(rest) > 1:
        near = close(prints[rest[0]], prints[rest])
        members, rest = rest[near], rest[~near]
        left.append(members)
        right.append(np.full(len(members), members[0]))
        step = max(1, 1_000_000 // max(len(rest), 1))
        for at in range(1, len(members), step):
            a, b = np.nonzero(close(prints[members[at : at + step], None], prints[None, rest]))
            a, b = forest(members[at : at + step][a], rest[b])
            left.append(a)
            right.append(b)
    return left, right


def met(unit: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between places of rows, sorted by unit, that connect all near sketches of one unit."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    begin = np.concatenate([[0], np.flatnonzero(np.diff(unit)) + 1])
    size = np.diff(np.concatenate([begin, [len(unit)]]))
    for low, n in zip(begin[size > 4 * CROWD].tolist(), size[size > 4 * CROWD].tolist(), strict=True):
        a, b = _crowded(prints[low : low + n])
        left += [x + low for x in a]
        right += [x + low for x in b]
    some = size <= 4 * CROWD
    high = np.repeat((begin + size)[some], size[some])
    own = np.flatnonzero(np.repeat(some, size))
    ends = np.cumsum(high - own - 1)
    columns = np.ascontiguousarray(prints.T[:COMPARED])
    at = 0
    while at < len(own):  # a bounded number of comparisons at a time
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 500_000, "right")))
        count = (high - own - 1)[at:end]
        mine = np.repeat(own[at:end], count)
        other = np.arange(len(mine)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(own[at:end] + 1, count)
        near = np.flatnonzero(sum(np.bitwise_count(np.take(c, mine) ^ np.take(c, other)) for c in columns) <= FAR)
        mine, other = mine[near], other[near]
        near = far(prints[mine], prints[other]) <= FAR_HELD
        left.append(mine[near])
        right.append(other[near])
        at = end
    return np.concatenate(left), np.concatenate(right)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows (unit, node, and words that are sent along) sorted by unit."""
    held: list[np.ndarray] = []
    size = 0

    def told(rows: np.ndarray) -> pa.RecordBatch:
        a, b = met(rows[0], rows[2:].T.copy().view(np.uint64))
        a, b = forest(rows[1][a], rows[1][b])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy() for c in ("unit", "node", *_PRINT)]))
        size += batch.num_rows
        if size >= 200_000:
            rows = np.concatenate(held, axis=1)
            cut = int(np.searchsorted(rows[0], rows[0, -1], "left"))
            if cut:
                yield told(rows[:, :cut])
            held, size = [rows[:, cut:]], rows.shape[1] - cut
    if size:
        yield told(np.concatenate(held, axis=1))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect what the rows (a, b) of a task connect, one per node at most."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        size += batch.num_rows
        if size >= LINKS:
            held = [forest(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            size = 0
    if held:
        a, b = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def candidates(classes: DataFrame) -> DataFrame:
    """Links (a, b) that connect all rows of ``classes`` (node, sketch) whose sketches meet."""
    n = classes.count()
    places = anchor_sets(n)
    cores = classes.sparkSession.sparkContext.defaultParallelism
    rows = n * len(places)
    spread = classes.repartition(max(cores, rows // 5_000_000))
    dealt = spread.mapInArrow(_dealt(places), ", ".join(f"{c} long" for c in ("unit", "node", *_PRINT)))
    dealt = dealt.repartition(max(2 * cores, rows // 1_000_000), "unit").sortWithinPartitions("unit")
    links = written(dealt.mapInArrow(_met, "a long, b long"), "copies-met")
    # copies meet in many anchor sets, each time through another one; a task keeps one link per sketch of all it reads
    return links.coalesce(max(1, links.count() // LINKS)).mapInArrow(_merged, "a long, b long")


def _linked(nodes: list[int], sets: list[np.ndarray], prints: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that connect all candidates that are similar."""
    label = np.arange(len(nodes))
    left, right = [], []
    for at in range(1, len(nodes)):
        near = np.flatnonzero(close(prints[at], prints[:at]))
        of = label[near]
        for group in np.unique(of).tolist():
            other = next((b for b in near[of == group].tolist() if similar(sets[at], sets[b])), None)
            if other is not None:
                left.append(nodes[at])
                right.append(nodes[other])
                label[label == label[at]] = group
    return left, right


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows (root, node, sketch, text) sorted by root."""
    now, nodes, sets, keys = None, [], [], []

    def told() -> pa.RecordBatch:
        a, b = _linked(nodes, sets, _held(keys))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        for root, node, own, text in zip(
            batch.column("root").to_pylist(),
            batch.column("node").to_pylist(),
            batch.column("sketch").to_pylist(),
            texts(batch),
            strict=True,
        ):
            if root != now and nodes:
                yield told()
                nodes, sets, keys = [], [], []
            now = root
            nodes.append(node)
            sets.append(shingle_set(text))
            keys.append(own)
    if nodes:
        yield told()


def with_groups(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, group_id per row of ``docs`` (doc_id, text, text_hash); near copies share a group."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed = docs.mapInArrow(_signed, f"doc_id {id_type}, text_hash long, set_key binary, sketch binary")
    rows = written(signed, "copies-rows")
    classes = rows.groupBy("set_key").agg(F.min(F.struct("text_hash", "sketch")).alias("first"))
    classes = written(
        classes.select("set_key", "first.text_hash", "first.sketch").withColumn("node", F.monotonically_increasing_id()),
        "copies-classes",
    )
    met_links = candidates(classes.where(F.col("sketch").isNotNull()).select("node", "sketch"))
    together = components(met_links, "copies-candidates")
    live = written(classes.select("node", "text_hash", "sketch").join(together, "node"), "copies-live")
    fetched = docs.select("text_hash", "text").join(live, "text_hash").groupBy("node").agg(
        F.first(F.struct("root", "sketch", "text")).alias("row")
    )
    dealt = fetched.select("row.root", "node", "row.sketch", "row.text").repartition("root").sortWithinPartitions("root")
    links = written(dealt.mapInArrow(_verified, "a long, b long"), "copies-links")
    roots = components(links, "copies").withColumnRenamed("node", "linked")
    groups = classes.join(roots, F.col("node") == F.col("linked"), "left").select(
        "set_key", F.coalesce("root", "node").alias("group_id")
    )
    return rows.select("doc_id", "text_hash", "set_key").join(groups, "set_key").drop("set_key")
