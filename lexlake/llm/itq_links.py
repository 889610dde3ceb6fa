"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

Rotations are learned that turn vectors into balanced binary codes which keep angles: starting from the principal axes,
rotate so that the signs fit the vectors best, and cut each bit at its median. A code is the bits of several rotations.
It is cut into chunks, one hash table per chunk; two vectors are candidates if they agree in a chunk and their codes
differ in few bits. Candidates are then compared by cosine on the original vectors, in double precision.

Codes keep the angles of centred vectors, and vectors with much in common lie at larger angles there. So how often the bits of
vectors at the cosine asked for agree is measured, on vectors of the sample and partners made for them. Chunks are as wide
as the number of vectors asks for, so that a table's buckets stay small, or narrower where that is less work; there are as
many tables as it takes for two vectors at the cosine asked for to meet with probability `MEET`. Equal vectors are one vector throughout;
crowded buckets are cut into blocks; a pair is counted in the first table in which it meets, and no pair leaves its task:
what leaves are counts per vector and a forest of links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.llm.links import components, forest
from lexlake.session import written

COSINE = 0.9
# the probability with which two vectors at the cosine asked for should meet in a table
MEET = 0.99
# vectors that the rotations are learned from at most, per length of vector
SAMPLE_ROWS = 5_000
# vectors of a bucket that are compared in one block
BLOCK = 2_048
# bits by which candidates are told apart before their vectors are fetched
SKETCH_BITS = 128


# bits that agreement is measured on, pairs it is measured on at least, and what comparing two sketches costs of a row dealt
MEASURED_BITS = 1_024
MEASURED_PAIRS = 4_000
COMPARED = 1 / 64


def _tables(agree: np.ndarray, width: int) -> int:
    """Tables in which pairs whose bits agree that often meet in a chunk with probability `MEET` on average."""
    miss = 1 - np.minimum(agree, 1 - 1e-9) ** width
    low, high = 0, 1
    while 1 - (miss**high).mean() < MEET:
        low, high = high, high * 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if 1 - (miss**middle).mean() < MEET else (low, middle)
    return high


def table_plan(n: int, cosine: float = COSINE, measured: list[np.ndarray] | None = None) -> tuple[int, int]:
    """(bits of a chunk, tables) for so many vectors.

    ``measured`` holds arrays of how often the bits of pairs at the cosine agree; the pairs of each are to meet, and those of
    random planes.
    """
    widest = min(max(math.ceil(math.log2(max(n, 2))), 8), 30)
    every = [np.array([1 - math.acos(cosine) / math.pi]), *(measured or [])]

    def plan(width: int) -> int:
        return max(_tables(agree, width) for agree in every)

    nominal = _tables(every[0], widest)
    if plan(widest) <= 2 * nominal:
        return widest, plan(widest)
    width = min(range(8, widest + 1), key=lambda w: plan(w) * (1 + n / 2**w * COMPARED))
    return width, plan(width)


def sketch_limit(cosine: float = COSINE, measured: list[np.ndarray] | None = None) -> int:
    """Bits of the sketch in which vectors at the cosine asked for may differ, with 3.5 standard deviations to spare."""
    differ = math.acos(cosine) / math.pi
    limits = [SKETCH_BITS * differ + 3.5 * math.sqrt(SKETCH_BITS * differ * (1 - differ))]
    for agree in measured or []:
        # what pairs differ in besides what chance does to a sketch
        mean = 1 - agree.mean()
        spread = SKETCH_BITS * mean * (1 - mean) + (SKETCH_BITS * agree.std()) ** 2
        limits.append(SKETCH_BITS * mean + 3.5 * math.sqrt(spread))
    return min(math.ceil(max(limits)), SKETCH_BITS)


def partners(unit: np.ndarray, mean: np.ndarray, cosine: float, seed: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit vectors at the cosine: partners apart in any direction, and partners spread as the vectors are.

    The latter turn a vector, about the mean, towards another one as far as the cosine allows.
    """
    rng = np.random.default_rng([seed, unit.shape[1]])
    first = np.concatenate([unit] * -(-MEASURED_PAIRS // len(unit)))
    away = rng.standard_normal(first.shape)
    away -= (away * first).sum(axis=1, keepdims=True) * first
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    found = [(first, cosine * first + math.sqrt(1 - cosine**2) * away)]
    own, other = first - mean, first[rng.permutation(len(first))] - mean

    def turned(angle: np.ndarray) -> np.ndarray:
        vectors = mean + np.cos(angle)[:, None] * own + np.sin(angle)[:, None] * other
        return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)

    low, high = np.zeros(len(first)), np.full(len(first), math.pi / 2)
    apart = (turned(high) * first).sum(axis=1) < cosine
    for _ in range(40):
        middle = (low + high) / 2
        near = (turned(middle) * first).sum(axis=1) >= cosine
        low, high = np.where(near, middle, low), np.where(near, high, middle)
    if apart.any():
        found.append((first[apart], turned(low)[apart]))
    return found


def agreement(unit: np.ndarray, cosine: float = COSINE) -> list[np.ndarray]:
    """How often the bits of pairs at the cosine agree, for each way to make partners; nothing for random planes."""
    length = unit.shape[1]
    leaders = _leaders(unit)
    if len(leaders) <= length:
        return []
    model = learn_rotations(unit, length, MEASURED_BITS)
    pairs = partners(leaders, model.mean, cosine)
    return [(model.bits(a) == model.bits(b)).mean(axis=1) for a, b in pairs]


@dataclass
class Rotations:
    """For vectors of one length: bit j of a code is (v - mean) @ axes[:, j] > cut[j]."""

    mean: np.ndarray
    axes: np.ndarray
    cut: np.ndarray

    def bits(self, unit: np.ndarray) -> np.ndarray:
        return (unit - self.mean) @ self.axes > self.cut


def learn_rotations(sample: np.ndarray, length: int, bits: int, rounds: int = 12, seed: int = 1) -> Rotations:
    """Iterative quantisation on a sample of unit vectors, once per ``length`` bits wanted.

    Of near copies in the sample only the first counts, or a large group of them would draw the centre and the cuts to
    itself and be cut apart. With fewer vectors than they are long the codes are those of random planes.
    """
    rng = np.random.default_rng([seed, length])
    sample = _leaders(sample)
    if len(sample) <= length:
        sample = sample[:0]
    mean = sample.mean(axis=0) if len(sample) else np.zeros(length)
    centred = sample - mean
    _, _, axes = np.linalg.svd(centred.T @ centred) if len(sample) else (0, 0, np.eye(length))
    projected = centred @ axes.T
    parts = []
    for _ in range(-(-bits // length)):
        turn = np.linalg.qr(rng.standard_normal((length, length)))[0]
        for _ in range(rounds if len(sample) else 0):
            signs = np.where(projected @ turn >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(projected.T @ signs)
            turn = left @ right
        parts.append(axes.T @ turn)
    every = np.hstack(parts)[:, :bits]
    cut = np.median(centred @ every, axis=0) if len(sample) else np.zeros(bits)
    return Rotations(mean, every, cut)


def _leaders(unit: np.ndarray, cosine: float = COSINE) -> np.ndarray:
    """The vectors that are not close to one before them."""
    keep = np.ones(len(unit), dtype=bool)
    for at in range(len(unit)):
        if keep[at]:
            keep[at + 1 :] &= unit[at + 1 :] @ unit[at] < cosine
    return unit[keep]


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _units(column, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, unit vectors) of the binary vectors in a column, by length."""
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        raw = b"".join([column[int(i)].as_buffer().to_pybytes() for i in at])
        yield at, _unit(np.frombuffer(raw, "<f8").reshape(-1, length))


def with_codes(classes: DataFrame, models: dict[int, Rotations], width: int, tables: int) -> DataFrame:
    """node, vector -> node, length, sketch_1, sketch_2, chunks (one integer per table)."""
    weights = 1 << np.arange(width, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            chunks = np.zeros((len(lengths), tables), dtype=np.int32)
            sketch = np.zeros((len(lengths), 2), dtype=np.int64)
            for at, unit in _units(column, lengths):
                length = unit.shape[1]
                model = models.get(length) or learn_rotations(np.empty((0, length)), length, _bits(width, tables))
                bits = model.bits(unit)
                chunks[at] = bits[:, : width * tables].reshape(len(at), tables, width) @ weights
                packed = np.packbits(bits[:, :SKETCH_BITS], axis=1, bitorder="little")
                sketch[at] = np.ascontiguousarray(packed).view("<i8")
            offsets = pa.array(np.arange(len(lengths) + 1, dtype=np.int32) * tables)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("node", "length", "copies", "vector")],
                    pa.array(sketch[:, 0].copy()),
                    pa.array(sketch[:, 1].copy()),
                    pa.ListArray.from_arrays(offsets, pa.array(chunks.ravel())),
                ],
                names=["node", "length", "copies", "vector", "sketch_1", "sketch_2", "chunks"],
            )

    schema = "node long, length int, copies long, vector binary, sketch_1 long, sketch_2 long, chunks array<int>"
    return classes.select("node", "length", "copies", "vector").mapInArrow(run, schema)


def _bits(width: int, tables: int) -> int:
    return max(width * tables, SKETCH_BITS)


_UNIT = ["length", "place", "chunk"]


def in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows of buckets (`_UNIT`, node) with low, high, own: the units in which a bucket's blocks meet in pairs."""
    counts = rows.groupBy(*_UNIT).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    crowded = written(counts.withColumn("blocks", F.ceil(F.col("n") / float(block)).cast("int")).drop("n"), "itq-crowded")
    if crowded.isEmpty():
        return rows.withColumns({"low": F.lit(0), "high": F.lit(0), "own": F.lit(0)})
    joined = rows.join(crowded, _UNIT, "left")
    own = F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int")
    joined = joined.withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    return (
        joined.withColumn("other", other)
        .withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
        .drop("other", "blocks")
    )


def _dealt(units: DataFrame) -> DataFrame:
    keys = [*_UNIT, "low", "high"]
    return units.repartition(*keys).sortWithinPartitions(*keys)


def _chunks_of_units(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """(unit number of each row, rows) for whole units, some ``rows`` rows at a time; units lie together."""
    held: list[pa.RecordBatch] = []
    size = 0

    def numbered(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        for c in (*_UNIT, "low", "high"):
            values = table.column(c).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.cumsum(new)

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held)
        unit = numbered(table)
        cut = int(np.searchsorted(unit, unit[-1], "left"))
        if cut:
            yield unit[:cut], table.slice(0, cut)
            rest = table.slice(cut).combine_chunks()
            held, size = rest.to_batches(), rest.num_rows
    if size:
        table = pa.Table.from_batches(held)
        yield numbered(table), table


def _pairs(unit: np.ndarray, table: pa.Table, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs to compare: within a block, or across the two blocks of a unit; ``most`` or so at a time."""
    own, low, high = (table.column(c).to_numpy() for c in ("own", "low", "high"))
    end = np.searchsorted(unit, unit, "right")
    count = end - np.arange(len(unit)) - 1
    ends = np.cumsum(count)
    begin = 0
    while begin < len(unit):
        done = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, done + most, "right")))
        some = count[begin:stop]
        first = np.repeat(np.arange(begin, stop), some)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(some) - some, some)
        use = (own[first] != own[second]) | (low[first] == high[first])
        yield first[use], second[use]
        begin = stop


def _live(limit: int):
    """Rows of buckets that have a candidate: those whose sketch is near another's in the same unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, table in _chunks_of_units(batches, 100_000):
            sketch = [table.column(c).to_numpy().view(np.uint64) for c in ("sketch_1", "sketch_2")]
            live = np.zeros(len(unit), dtype=bool)
            for a, b in _pairs(unit, table, 1_000_000):
                differ = sum(np.bitwise_count(s[a] ^ s[b]).astype(np.int16) for s in sketch)
                near = differ <= limit
                live[a[near]] = True
                live[b[near]] = True
            found = table.select([*_UNIT, "node"]).filter(pa.array(live)).combine_chunks()
            yield from found.to_batches()

    return run


def _linked(cosine: float):
    """Counts of links per node, and a forest of the links, among candidates that meet for the first time here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, table in _chunks_of_units(batches, 20_000):
            table = table.combine_chunks()
            node, copies, place = (table.column(c).to_numpy() for c in ("node", "copies", "place"))
            codes = np.array(table.column("chunks").to_pylist(), dtype=np.int32)
            lengths = table.column("length").to_numpy()
            column = table.column("vector").chunk(0)
            unit_vectors: dict[int, np.ndarray] = {}
            where = np.zeros(len(unit), dtype=np.int64)
            for at, vectors in _units(column, lengths):
                unit_vectors[vectors.shape[1]] = vectors
                where[at] = np.arange(len(at))
            links = np.zeros(len(unit), dtype=np.int64)
            left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for a, b in _pairs(unit, table, 100_000):
                met = (codes[a] == codes[b]).argmax(axis=1) == place[a]
                a, b = a[met], b[met]
                near = np.zeros(len(a), dtype=bool)
                for length, vectors in unit_vectors.items():
                    of = lengths[a] == length
                    near[of] = np.einsum("ij,ij->i", vectors[where[a[of]]], vectors[where[b[of]]]) >= cosine
                a, b = a[near], b[near]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                tree = forest(node[a], node[b])
                left.append(tree[0])
                right.append(tree[1])
            tree = forest(np.concatenate(left), np.concatenate(right))
            some = links > 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([node[some], tree[0]])),
                    pa.array(np.concatenate([links[some], np.zeros(len(tree[0]), np.int64)])),
                    pa.array(np.concatenate([node[some], tree[1]])),
                ],
                names=["node", "links", "other"],
            )

    return run


def linked_vectors(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept per row of ``vectors`` (vec_id, embedding: array of numbers).

    Vectors link if their cosine is at least ``cosine``. Vectors that are NULL, empty or zero, or hold a NULL or a
    number that is not finite, and rows without an id link with nothing and are their own component; vectors of different
    lengths don't link. Equal vectors link with one another. n_links counts rows; component_id is the smallest vec_id that
    links reach, the row's own included; kept marks rows whose id is their component's. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    values = F.col("embedding").cast("array<double>")
    finite = F.forall(
        values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    ) & F.exists(values, lambda x: x != 0)
    # negative zero is zero, so that equal vectors are equal byte by byte
    plain = F.transform(values, lambda x: x + F.lit(0.0))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.coalesce(finite, F.lit(False)) & F.col("vec_id").isNotNull(), plain).alias("values"),
    )
    classes = (
        rows.where(F.col("values").isNotNull())
        .groupBy("values")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    classes = written(classes, "itq-classes")
    n = classes.count()
    sample = _sample(classes)
    measured = [agree for unit in sample.values() for agree in agreement(unit, cosine)]
    width, tables = table_plan(n, cosine, measured)
    models = {length: learn_rotations(unit, length, _bits(width, tables)) for length, unit in sample.items()}
    coded = written(
        with_codes(_as_binary(classes), models, width, tables),
        "itq-codes",
    )
    buckets = coded.select(
        "node", "length", "sketch_1", "sketch_2", F.posexplode("chunks").alias("place", "chunk")
    )
    live = (
        _dealt(in_blocks(buckets, block))
        .mapInArrow(_live(sketch_limit(cosine, measured)), "length int, place int, chunk int, node long")
        .distinct()
    )
    live = written(live, "itq-live")
    fetched = live.join(coded.select("node", "copies", "vector", "chunks"), "node")
    found = written(
        _dealt(in_blocks(fetched, block)).mapInArrow(_linked(cosine), "node long, links long, other long"), "itq-links"
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node != other").select(F.col("node").alias("a"), F.col("other").alias("b")), "itq")
    named = (
        classes.select("values", "node", "copies", "first_id")
        .join(links, "node", "left")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    first = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    per_class = named.join(first, "root").select(
        F.col("values").alias("of_values"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        "component_id",
    )
    linked = rows.where(F.col("values").isNotNull()).join(per_class, F.col("values") == F.col("of_values"))
    alone = rows.where(F.col("values").isNull()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    every = linked.select("vec_id", "n_links", "component_id").unionByName(alone)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _as_binary(classes: DataFrame) -> DataFrame:
    """Vectors as little-endian doubles, so that they travel as one value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("values")
            flat = column.flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes()
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(lengths.astype(np.int64) * 8)])
            vectors = [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"),
                    pa.array(lengths.astype(np.int32)),
                    batch.column("copies"),
                    pa.array(vectors, pa.binary()),
                ],
                names=["node", "length", "copies", "vector"],
            )

    return classes.select("node", "copies", "values").mapInArrow(
        run, "node long, length int, copies long, vector binary"
    )


def _sample(classes: DataFrame, rows: int = SAMPLE_ROWS) -> dict[int, np.ndarray]:
    """At most ``rows`` unit vectors to learn rotations from, those with the smallest hash; by length of vector."""
    sample = classes.orderBy(F.xxhash64(F.lit(1), "values"), "node").limit(rows).select("node", "values").collect()
    by_length: dict[int, list] = {}
    for row in sorted(sample, key=lambda r: r["values"]):
        by_length.setdefault(len(row["values"]), []).append(row["values"])
    return {k: _unit(np.array(v)) for k, v in by_length.items()}
