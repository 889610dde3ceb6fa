"""Language model scoring by online logistic context mixing.

A text is a row of tokens, and a token is a row of bits: its path in a Huffman tree over the vocabulary. Each bit is
predicted in several contexts (none, the word before, the two words before, the last common word) from counts kept in
hashed tables. A mixer adds up the predictions in the logistic domain; its weights are chosen by how much the contexts have
seen, and learned online, bit by bit in order. The sum is refined by a map from what is predicted to what happens, adapted
the same way. Words outside the vocabulary are escaped and spelled in bytes, whose bits are predicted in the same manner
from the letters before. What every bit costs adds up to the bits of the text.

Texts are taken apart once: documents are dealt out by their hash, and chunks of them are written as numbered words, which
counting, learning and scoring read.

Counts are gathered over all training documents: tasks count into tables of fixed size, and the tables' blocks are added
up in a shuffle, so what is gathered grows with the input and the model does not. Weights and maps are learned on all
training documents too: each chunk is gone over online, from counts less the bit itself, and what the chunks have taught is
averaged by how many bits each has seen in a state. What repeats within a chunk, a word in its context or some letters, is
worked out once and counts as often as it occurs.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count, groupby, islice
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.llm.common import fold, in_fold
from lexlake.session import written

FOLDS, HELD_OUT = 7, 2
# words of the vocabulary, the most frequent ones, and how often they must occur; all others are spelled, so that there is
# spelling to learn from in a small corpus too
VOCABULARY = 1 << 17
LEAST_COUNT = 3
# slots of a hashed table, as a power of two, for words and for letters
WORD_BITS, LETTER_BITS = 21, 19
# bytes of the texts that are dealt to one task, and of those that make a chunk, about; a mixer learns from one chunk
DEAL_BYTES, CHUNK_BYTES = 24 << 20, 6 << 20
# distinct spelled words that one task's mixer learns from, about; tasks grow with the corpus
LEARN_SPELLED = 200_000
# the words that tell language and genre as a context
COMMON = 64
# spelled words a task holds before it sends them
REMEMBERED = 200_000

_BLOCK = 4096
# tokens, or grams of letters, that are worked on together, so that their decisions stay in the processor's cache
_TOGETHER = 4_000
# slots a task holds before it counts them
_HELD = 1_000_000
_SLICE = 64 * 2 * _BLOCK
# words that are spelled, dealt out by their hash
_SPELLED, _SPELLED_PARTS, _SPELLED_TOGETHER = -1, 4096, 50_000
_END, _ESCAPE, _SAME = 0, 1, 2
_FIRST_WORD = 3


def hashes(found: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; the end of a text has the hash of a blank, which no word is."""
    return pd.util.hash_array(np.array(found, dtype=object), categorize=False).view(np.int64)


_END_HASH = int(hashes([b" "])[0])


# ---- chunks of documents ----


def _taken_apart(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(words of each text, distinct words, place of every word among these); words are what ``common.words`` finds."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    ids, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    # blanks at the ends of a text leave empty words
    empty = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
    if empty >= 0:
        kept = ids != empty
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kept], minlength=len(sizes))
        ids = ids[kept]
        ids = ids - (ids > empty)
        distinct = pa.concat_arrays([distinct.slice(0, empty), distinct.slice(empty + 1)])
    return sizes, distinct.cast(pa.large_binary() if pa.types.is_large_string(distinct.type) else pa.binary()), ids


@dataclass
class Chunk:
    """Words of some documents: their distinct words, and which of these follow each other in each document."""

    sizes: np.ndarray
    words: list[bytes]
    ids: np.ndarray

    @classmethod
    def of(cls, sizes: list[int], distinct: bytes, ids: bytes) -> Chunk:
        expand = zstandard.ZstdDecompressor().decompress
        planes = np.frombuffer(expand(ids), np.uint8).reshape(4, -1)
        joined = expand(distinct)
        return cls(
            np.array(sizes, np.int64),
            joined.split(b" ") if joined else [],
            np.ascontiguousarray(planes.T).view("<i4").ravel(),
        )


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of documents that follow each other, of about `CHUNK_BYTES`, all to be learned from or none."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        if not len(batch):
            continue
        text, training = batch.column("text"), batch.column("training")
        size = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        number = np.cumsum(size) // CHUNK_BYTES
        other = np.diff(training.to_numpy(zero_copy_only=False).astype(np.int8)) != 0
        cuts = [0, *(np.flatnonzero((np.diff(number) > 0) | other) + 1).tolist(), len(batch)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            sizes, distinct, ids = _taken_apart(text.slice(low, high - low))
            planes = ids.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    training.slice(low, 1),
                    pa.ListArray.from_arrays(pa.array([0, high - low], pa.int32()), batch.column("doc_id").slice(low, high - low)),
                    pa.array([sizes.tolist()], pa.list_(pa.int64())),
                    pa.array([squeeze(b" ".join(distinct.to_pylist()))], pa.binary()),
                    pa.array([squeeze(planes)], pa.binary()),
                ],
                names=["training", "doc_id", "sizes", "words", "ids"],
            )


def chunks(docs: DataFrame) -> DataFrame:
    """(training, doc_id, sizes, words, ids): the documents, dealt out by their hash and taken apart.

    What a chunk holds does not depend on the layout of ``docs``.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    by_hash = F.xxhash64("doc_id", "text")
    training = F.coalesce(fold(F.col("doc_id"), FOLDS) != HELD_OUT, F.lit(True))
    dealt = docs.select("doc_id", "text", training.alias("training"), by_hash.alias("h"))
    dealt = dealt.repartition(max(1, size // DEAL_BYTES), "h").sortWithinPartitions("training", "h")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"training boolean, doc_id array<{id_type}>, sizes array<long>, words binary, ids binary"
    return written(dealt.select("training", "doc_id", "text").mapInArrow(_chunked, schema), "lm-chunks")


def read_chunks(batch: pa.RecordBatch) -> Iterator[Chunk]:
    for i in range(len(batch)):
        yield Chunk.of(*(batch.column(c)[i].as_py() for c in ("sizes", "words", "ids")))


def word_counts(chunked: DataFrame) -> DataFrame:
    """(word, n) over the documents of ``chunked``; word is a hash, and each text has one end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in read_chunks(batch):
                n = np.bincount(chunk.ids, minlength=len(chunk.words))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(hashes(chunk.words), _END_HASH)), pa.array(np.append(n, len(chunk.sizes)))],
                    names=["word", "n"],
                )

    found = chunked.select("sizes", "words", "ids").mapInArrow(run, "word long, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


# ---- codes ----


@dataclass
class Code:
    """Paths of symbols in a binary tree: symbol s passes node[start[s]:start[s+1]], taking bit[...] there."""

    start: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    ones: np.ndarray
    zeros: np.ndarray

    def __post_init__(self):
        # of each decision of a path, so that the decisions of a symbol lie side by side: the keyed node and, in the bits
        # behind it, the prediction without context
        base = np.rint(np.clip(stretch(self.zeros, self.ones), -_CLIP, _CLIP) * 16).astype(np.int64) + _BASE
        self.told = keyed(scattered(np.arange(len(self.ones) + 1), 100)[self.node], self.bit, WORD_BITS)
        self.told |= base.astype(np.uint32)[self.node]

    @classmethod
    def huffman(cls, counts: np.ndarray) -> Code:
        n = len(counts)
        heap = [(float(c), s) for s, c in enumerate(counts.tolist())]
        heapq.heapify(heap)
        parent, side = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.uint8)
        zeros, ones = np.zeros(n), np.zeros(n)
        for k in range(n - 1):
            (c0, a), (c1, b) = heapq.heappop(heap), heapq.heappop(heap)
            parent[a] = parent[b] = n + k
            side[b] = 1
            zeros[k], ones[k] = c0, c1
            heapq.heappush(heap, (c0 + c1, n + k))
        paths, at = [], np.arange(n)
        live = np.ones(n, dtype=bool) if n > 1 else np.zeros(n, dtype=bool)
        symbol = np.arange(n)[live]
        at = at[live]
        depth = 0
        while len(symbol):
            paths.append((symbol, parent[at] - n, side[at], np.full(len(symbol), depth)))
            at = parent[at]
            up = at != 2 * n - 2
            symbol, at, depth = symbol[up], at[up], depth + 1
        symbol, node, bit, height = (np.concatenate(x) for x in zip(*paths, strict=True))
        order = np.lexsort((-height, symbol))
        start = np.searchsorted(symbol[order], np.arange(n + 1))
        return cls(start, node[order].astype(np.int32), bit[order], ones, zeros)

    def entries(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of decisions of each symbol, place among the decisions of all paths of every decision)."""
        low = self.start[symbols]
        sizes = self.start[symbols + 1] - low
        ends = np.cumsum(sizes)
        at = np.repeat(low - (ends - sizes), sizes)
        at += np.arange(len(at))
        return sizes, at

    def decisions(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of decisions of each symbol, keyed node, bit, prediction without context of every decision)."""
        sizes, at = self.entries(symbols)
        node = picked(self.told, at)
        base = (node & np.uint32(2 * _BASE - 1)).astype(np.float32)
        base -= _BASE
        base /= 16
        return sizes, node, node >> np.uint32(31 - WORD_BITS) & np.uint32(1), base

    def steps(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in ``symbols``, node, bit) of every decision of the symbols."""
        sizes, at = self.entries(symbols)
        return np.repeat(np.arange(len(symbols)), sizes), self.node[at], self.bit[at]


def scattered(values: np.ndarray, order: int) -> np.ndarray:
    """32 well-mixed bits of nodes or contexts; different for each order of context."""
    h = values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (order + 1) % (1 << 64))
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((h ^ h >> np.uint64(31)) >> np.uint64(32)).astype(np.uint32)


def picked(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """values[at] for places that are known to exist."""
    return np.take(values, at, mode="clip")


def trimmed(values: np.ndarray, bits: int) -> np.ndarray:
    """Scattered nodes or contexts of which only the bits that choose a slot are left."""
    return values >> np.uint32(32 - bits) << np.uint32(32 - bits)


def keyed(node: np.ndarray, bit: np.ndarray, bits: int) -> np.ndarray:
    """Trimmed nodes with the bit that is taken there behind them."""
    return trimmed(node, bits) | bit.astype(np.uint32) << np.uint32(31 - bits)


def slots(node: np.ndarray, context: np.ndarray, bits: int) -> np.ndarray:
    """Slots of decisions in a hashed table, from the keyed node and the trimmed context."""
    return ((node ^ context) >> np.uint32(32 - bits)).astype(np.int64)


def cells(node: np.ndarray, context: np.ndarray, bits: int) -> np.ndarray:
    """Cells of decisions in a hashed table, which has two in each slot: for zeros and for ones."""
    return ((node ^ context) >> np.uint32(31 - bits)).astype(np.int64)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) * 1_000_003 + b.astype(np.int64) + 1


# ---- the two streams of decisions ----


class Vocabulary:
    """Symbols of words by their hash, with their training counts."""

    def __init__(self, numbers: np.ndarray, counts: np.ndarray, others: float):
        self.numbers, self.counts = numbers, counts  # sorted by hash, END not among them
        self.others = others
        self.index = pd.Index(numbers)

    def code(self, ends: float) -> Code:
        total = ends + self.others + float(self.counts.sum())
        first = [max(ends, 0.5), max(self.others, 0.5), max(0.01 * total, 0.5)]
        return Code.huffman(np.concatenate([first, np.maximum(self.counts, 0.5)]))

    def symbols(self, found: np.ndarray) -> np.ndarray:
        """Symbol of each hash: END, a word's, or ESCAPE."""
        at = self.index.get_indexer(found)
        return np.where(found == _END_HASH, _END, np.where(at >= 0, at + _FIRST_WORD, _ESCAPE))


def word_contexts(symbols: np.ndarray, begins: np.ndarray, common: np.ndarray) -> list[np.ndarray]:
    """Trimmed contexts of every token: the word before, the two before, and the last common word.

    Nothing reaches over the end of a text, so some texts are worked on at a time.
    """
    first = np.flatnonzero(np.diff(begins // (4 * _TOGETHER), prepend=-1))
    cuts = [*begins[first].tolist(), len(symbols)]
    found = []
    for k, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        own = begins[first[k] : first[k + 1] if k + 1 < len(first) else None]
        found.append(_contexts(symbols[low:high], own - low, common))
    return [np.concatenate(c) for c in zip(*found, strict=True)]


def _contexts(symbols: np.ndarray, begins: np.ndarray, common: np.ndarray) -> list[np.ndarray]:
    n = len(symbols)
    at = np.arange(n)
    before = np.concatenate([[-1], symbols[:-1]])
    before[begins] = -1
    second = np.concatenate([[-1, -1], symbols[:-2]])[:n] if n > 1 else np.full(n, -1)
    second[begins] = -1
    after = begins + 1
    second[after[after < n]] = -1
    known = np.zeros(n, dtype=bool)
    known[1:] = common[symbols[:-1]]
    known[begins] = True
    last = np.maximum.accumulate(np.where(known, at, 0))
    found = [before + 1, _mixed(before, second), np.where(last == 0, 0, before[last] + 1)]
    return [trimmed(scattered(c, order), WORD_BITS) for order, c in enumerate(found)]


WORD_ORDERS, LETTER_ORDERS = 3, 5

_LEVELS = np.arange(7, -1, -1)
# of each byte: the eight bits that tell it, and its keyed nodes, whose paths are the bits before
_LETTER_BIT = (np.arange(256)[:, None] >> _LEVELS & 1).astype(np.uint8)
_LETTER_KEYED = keyed(
    scattered(np.arange(256), 101)[(np.arange(256)[:, None] | 256) >> (_LEVELS + 1)], _LETTER_BIT, LETTER_BITS
)


def letter_grams(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(grams, where each word begins) of the words one after the other, each with a blank at its end.

    A gram is a byte and, below it, the five before it in the word: the last one first, each plus one, zero for none.
    """
    raw = np.frombuffer(b" ".join(found) + b" ", np.uint8).astype(np.int64)
    ends = np.flatnonzero(raw == 32)
    first = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(first, ends + 1 - first)
    grams = raw << 9 * LETTER_ORDERS
    for order in range(1, LETTER_ORDERS + 1):
        grams[order:] |= np.where(place[order:] >= order, raw[:-order] + 1, 0) << 9 * (LETTER_ORDERS - order)
    return grams, first


def letter_contexts(grams: np.ndarray) -> list[np.ndarray]:
    """Trimmed contexts of grams: one letter before, two, and so on."""
    history = grams & (1 << 9 * LETTER_ORDERS) - 1
    found = [history >> 9 * (LETTER_ORDERS - order) for order in range(1, LETTER_ORDERS + 1)]
    return [trimmed(scattered(c, order), LETTER_BITS) for order, c in enumerate(found)]


def letter_steps(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(keyed node, bit, trimmed contexts) of all decisions that tell the bytes of grams: eight for each."""
    byte = grams >> 9 * LETTER_ORDERS
    return _LETTER_KEYED[byte].ravel(), _LETTER_BIT[byte].ravel(), [np.repeat(c, 8) for c in letter_contexts(grams)]


# ---- tables and mixers ----


class Tables:
    """Counts of zeros and ones in the slots of each context's table."""

    def __init__(self, orders: int, bits: int):
        self.orders, self.bits = orders, bits
        self.counts = np.zeros((orders, 2 << bits), dtype=np.uint32)

    def take(self, order: int, place: int, packed: bytes) -> None:
        """Set a block from its packed counts."""
        at, counts = unpacked(packed)
        self.counts[order, place * 2 * _BLOCK : (place + 1) * 2 * _BLOCK][at] = np.minimum(counts, (1 << 32) - 1)


def packed(at: np.ndarray, counts: np.ndarray) -> bytes:
    """Counts that are not zero and their places in a block, in as many bytes as the largest count needs."""
    width = next(w for w in (1, 2, 4, 8) if not int(counts.max(initial=0)) >> 8 * w)
    raw = at.astype("<u2").tobytes() + counts.astype(f"<u{width}").tobytes()
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(raw)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    width = data[0]
    raw = zstandard.ZstdDecompressor().decompress(data[1:])
    n = len(raw) // (2 + width)
    return np.frombuffer(raw, "<u2", n), np.frombuffer(raw, f"<u{width}", n, 2 * n).astype(np.int64)


def runs(values: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often they occur; values are sorted, and each counts ``times``."""
    first = np.flatnonzero(np.concatenate([[len(values) > 0], values[1:] != values[:-1]])[: len(values)])
    if times is None:
        return values[first], np.diff(np.append(first, len(values)))
    return values[first], np.add.reduceat(times, first) if len(first) else times


class Gathered:
    """What a task counts. Cells are held until there are many, so a task with few decisions makes no whole tables."""

    def __init__(self, orders: int, bits: int):
        self.orders, self.bits = orders, bits
        self._held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(orders)]
        self._size = 0
        self._whole: np.ndarray | None = None

    def add(self, order: int, places: np.ndarray, times: np.ndarray) -> None:
        """Count decisions by their cells, each so many times."""
        if self._whole is None:
            self._held[order].append((places.astype(np.uint32), times.astype(np.uint32)))
            self._size += len(places)
            if self._size >= _HELD:
                self._settle()
        else:
            np.add.at(self._whole[order], places, times.astype(np.uint32))

    def _settle(self) -> None:
        self._whole = np.zeros((self.orders, 2 << self.bits), dtype=np.uint32)
        for order, held in enumerate(self._held):
            for places, times in held:
                np.add.at(self._whole[order], places, times)
            held.clear()

    def rows(self, name: int) -> Iterator[tuple[int, int, bytes]]:
        """(part, place, counts) of each block with counts; parts are numbered from ``name`` on."""
        for order, held in enumerate(self._held):
            if self._whole is not None:
                # some blocks at a time, as places take more room than counts
                for at in range(0, 2 << self.bits, _SLICE):
                    some = self._whole[order, at : at + _SLICE]
                    places = np.flatnonzero(some)
                    yield from _blocks(name + order, places + at, some[places])
            elif held:
                places, times = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                sort = np.argsort(places, kind="stable")
                yield from _blocks(name + order, *runs(places[sort], times[sort].astype(np.int64)))


def _blocks(part: int, places: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    block, within = np.divmod(places, 2 * _BLOCK)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]]).tolist()
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        if high > low:
            yield part, int(block[low]), packed(within[low:high], counts[low:high])


def stretch(zeros: np.ndarray, ones: np.ndarray, least: float = 0.4) -> np.ndarray:
    return np.log((ones + least) / (zeros + least)).astype(np.float32)


def confidence(total: np.ndarray) -> np.ndarray:
    """0 to 3: nothing seen, a little, some, much."""
    return (total >= 1).astype(np.uint8) + (total >= 4) + (total >= 32)


_CLIP = 7.9
_MAP = 33
_STEPS = 1024
# predictions without context are told in sixteenths, after this has been added
_BASE = 128


@dataclass
class Mixer:
    """Weights for each state of confidence of two contexts, and the map that refines the mixed prediction.

    ``met`` counts the decisions of each state, and ``moved`` those that each cell of the map has learned from.
    """

    weights: np.ndarray
    refine: np.ndarray
    met: np.ndarray
    moved: np.ndarray
    seen: int = 0

    @classmethod
    def new(cls, inputs: int) -> Mixer:
        grid = np.linspace(-8, 8, _MAP)
        refine = np.tile(1 / (1 + np.exp(-grid)), (16, 1))
        weights = np.full((16, inputs + 1), 0.3, np.float64)
        return cls(weights, refine, np.zeros(16, np.int64), np.zeros((16, _MAP), np.int64))

    def state(self) -> tuple[np.ndarray, np.ndarray]:
        """All that has been learned as one row of values, and how many decisions each value is learned from."""
        inputs = self.weights.shape[1]
        return (
            np.concatenate([self.weights.ravel(), self.refine.ravel()]),
            np.concatenate([np.repeat(self.met, inputs), self.moved.ravel()]),
        )

    def put(self, place: int, value: float, n: int) -> None:
        """Set one value of the state, which was learned from n decisions."""
        if place >= self.weights.size:
            self.refine.ravel()[place - self.weights.size] = value
            self.moved.ravel()[place - self.weights.size] = n
            return
        self.weights.ravel()[place] = value
        if place % self.weights.shape[1] == 0:  # all inputs of a state meet the same decisions
            self.met[place // self.weights.shape[1]] = n
            self.seen += n

    def _refined(self, mixed: np.ndarray, gate: np.ndarray) -> np.ndarray:
        place = (np.clip(mixed, -7.999, 7.999) + 8) * ((_MAP - 1) / 16)
        low = place.astype(np.int64)
        share = place - low
        mapped = self.refine[gate, low] * (1 - share) + self.refine[gate, low + 1] * share
        plain = 1 / (1 + np.exp(-np.clip(mixed, -12, 12)))
        return np.clip(0.5 * (mapped + plain), 1e-5, 1 - 1e-5)

    def costs(self) -> np.ndarray:
        """log10 of the refined probability of a zero and of a one, by gate and mixed prediction in steps of 1/64."""
        grid = np.linspace(-8, 8, _STEPS + 1)
        p = np.stack([self._refined(grid, np.full(len(grid), gate)) for gate in range(16)])
        return np.log10(np.stack([1 - p, p], axis=2)).astype(np.float32).ravel()

    def learn(self, inputs: np.ndarray, gate: np.ndarray, bit: np.ndarray, times: np.ndarray | None = None) -> None:
        """Online: predict some decisions, then move weights and map towards what came; slower as more has been seen.

        Decisions count as often as ``times`` says, once without it.
        """
        at = 0
        while at < len(bit):
            early = self.seen < 1_000_000
            step = 2048 if early else 16_384
            x, g, y = inputs[:, at : at + step], gate[at : at + step], bit[at : at + step]
            n = None if times is None else times[at : at + step]
            at += step
            weights = self.weights.T.astype(np.float32)
            mixed = x[0] * picked(weights[0], g)
            for j in range(1, len(x)):
                mixed += x[j] * picked(weights[j], g)
            miss = y - 1 / (1 + np.exp(-np.clip(mixed, -12, 12)))
            if n is not None:
                miss *= n
            np.clip(mixed, -8, 8, out=mixed)
            mixed *= (_MAP - 1) / 16
            mixed += (_MAP - 1) / 2 + 0.5
            place = mixed.astype(np.int64)
            place *= 2
            place += g * (2 * _MAP)
            place += y
            told = np.bincount(place, weights=n, minlength=2 * 16 * _MAP).astype(np.int64).reshape(16, _MAP, 2)
            n, up = told.sum(axis=2), told[:, :, 1]
            met = n.sum(axis=1)
            self.met += met
            self.seen += int(met.sum())
            rate = 0.02 if self.seen < 200_000 else 0.006 if early else 0.002 * step / 2048
            slope = np.stack([np.bincount(g, weights=miss * one, minlength=16) for one in x], axis=1)
            self.weights += rate * 10 * slope / np.maximum(met, 64)[:, None]
            if self.seen > 100_000:
                self.moved += n
                pace = n / (n + 200.0)
                self.refine += pace * (up / np.maximum(n, 1) - self.refine)


@dataclass
class Model:
    """All that scoring needs; its size does not depend on the corpus."""

    vocabulary: Vocabulary
    code: Code
    common: np.ndarray
    packed_words: np.ndarray
    packed_letters: np.ndarray
    word_mixer: Mixer
    letter_mixer: Mixer
    total: int
    distinct: int


def _packed(counts: np.ndarray) -> np.ndarray:
    """Prediction and confidence of each slot in a byte."""
    out = np.empty((len(counts), counts.shape[1] // 2), np.int8)
    for order, row in enumerate(counts):
        for at in range(0, len(row), _SLICE):
            some = row[at : at + _SLICE].astype(np.float32)
            out[order, at // 2 : (at + _SLICE) // 2] = _short(some[0::2], some[1::2])
    return out


def _short(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Predictions in quarters and, in the lowest two bits, confidences."""
    value = np.clip(stretch(zeros, ones), -7.75, 7.75)
    return np.rint(value * 4).astype(np.int8) * np.int8(4) + confidence(zeros + ones).astype(np.int8)


def bit_costs(
    mixer: Mixer, table: np.ndarray, base: np.ndarray | None, packed: np.ndarray, node, contexts, bit, bits: int
) -> np.ndarray:
    """log10 of the probability of each decision's bit; ``base`` is the prediction without context of each decision."""
    found = [picked(packed[order], slots(node, context, bits)) for order, context in enumerate(contexts)]
    gate = _gates(found, base)
    weights = mixer.weights.T.astype(np.float32)
    mixed = picked(weights[-1] * np.float32(0.3), gate)
    for order, value in enumerate(found):
        mixed += (value >> 2) * picked(weights[order] / 4, gate)
    if base is not None:
        mixed += base * picked(weights[len(found)], gate)
    np.clip(mixed, -8, 8, out=mixed)
    mixed *= _STEPS / 16
    mixed += _STEPS / 2 + 0.5
    gate *= _STEPS + 1
    gate += mixed.astype(np.int64)
    gate *= 2
    gate += bit
    return picked(table, gate)


def _gates(found: list[np.ndarray], base: np.ndarray | None) -> np.ndarray:
    """State of confidence of two contexts: the shorter of words, or the longest and the third but last of letters."""
    first, second = (found[0], found[1]) if base is not None else (found[-1], found[-3])
    return ((first & 3) * 4 + (second & 3)).astype(np.int64)


# a pair of counts that large is not told from one without the bit, and may be scaled down
_LARGE = 1 << 15


def fitted(counts: np.ndarray) -> np.ndarray:
    """Pairs of counts, scaled down together where they pass 16 bits."""
    out = np.empty(counts.shape, np.uint16)
    for order, row in enumerate(counts):
        for at in range(0, len(row), _SLICE):
            pairs = row[at : at + _SLICE].reshape(-1, 2).astype(np.int64)
            over = np.maximum(np.ceil(np.log2(pairs.max(axis=1) + 1)) - 16, 0).astype(np.int64)
            out[order, at : at + _SLICE] = (pairs >> over[:, None]).ravel()
    return out


def left_out(pairs: np.ndarray) -> np.ndarray:
    """Prediction and confidence for a decision that has been counted in each cell, from counts that lack it."""
    out = np.empty(pairs.shape, np.int8)
    for order, row in enumerate(pairs):
        for at in range(0, len(row), _SLICE):
            zeros, ones = row[at : at + _SLICE : 2].astype(np.float32), row[at + 1 : at + _SLICE : 2].astype(np.float32)
            small = (zeros < _LARGE) & (ones < _LARGE)
            out[order, at : at + _SLICE : 2] = _short(np.maximum(zeros - small, 0), ones)
            out[order, at + 1 : at + _SLICE : 2] = _short(zeros, np.maximum(ones - small, 0))
    return out


def _inputs(base, table: np.ndarray, node, contexts, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of the mixer for decisions, a row per input, from counts that lack the decision itself, and the gates."""
    found = [picked(table[order], cells(node, context, bits)) for order, context in enumerate(contexts)]
    out = np.empty((len(found) + (base is not None) + 1, len(node)), np.float32)
    for row, value in zip(out, found, strict=False):
        np.multiply(value >> 2, np.float32(1 / 4), out=row)
    if base is not None:
        out[-2] = base
    out[-1] = 0.3
    return out, _gates(found, base)


# ---- streams of documents ----


@dataclass
class Stream:
    """Tokens of some documents: places among their distinct words, the last for the end, symbols, coded symbols, and the
    distinct words outside the vocabulary by their places."""

    sizes: np.ndarray
    begins: np.ndarray
    own: np.ndarray
    symbols: np.ndarray
    coded: np.ndarray
    words: list[bytes]
    numbers: np.ndarray

    @property
    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    @property
    def spelled(self) -> list[bytes]:
        """The words that are spelled, in order."""
        return [self.words[i] for i in self.own[self.coded == _ESCAPE].tolist()]

    def spelled_places(self) -> np.ndarray:
        """Places of the distinct words that are spelled."""
        marked = np.zeros(len(self.numbers), dtype=bool)
        marked[self.own[self.coded == _ESCAPE]] = True
        return np.flatnonzero(marked)


class Reader:
    """Turns words of documents into streams."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def stream(self, chunk: Chunk) -> Stream:
        numbers = np.append(hashes(chunk.words), _END_HASH)
        sizes = chunk.sizes + 1
        ends = np.cumsum(sizes) - 1
        begins = ends + 1 - sizes
        own = np.full(len(chunk.ids) + len(sizes), len(chunk.words), np.int64)
        inside = np.ones(len(own), dtype=bool)
        inside[ends] = False
        own[inside] = chunk.ids
        symbols = self.vocabulary.symbols(numbers)[own]
        same = np.zeros(len(own), dtype=bool)
        same[1:] = own[1:] == own[:-1]
        same[begins] = False
        return Stream(sizes, begins, own, symbols, np.where(same, _SAME, symbols), chunk.words, numbers)

    def read(self, found: list[list[bytes]]) -> Stream:
        """The stream of documents that are rows of words."""
        known: defaultdict[bytes, int] = defaultdict(count().__next__)
        ids = np.array([known[w] for w in chain.from_iterable(found)], dtype=np.int64)
        return self.stream(Chunk(np.array([len(ws) for ws in found], dtype=np.int64), list(known), ids))


def _parts(n: int) -> Iterator[tuple[int, int]]:
    for at in range(0, n, _TOGETHER):
        yield at, min(at + _TOGETHER, n)


_ROWS = "part int, place int, counts binary"
Row = tuple[int, int, bytes]


def _sent(rows: Iterator[Row]) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, 256)):
        part, place, data = zip(*some, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(place, pa.int32()), pa.array(data, pa.binary())],
            names=["part", "place", "counts"],
        )


def _spelled_rows(spelled: set[bytes]) -> Iterator[Row]:
    dealt: defaultdict[int, list[bytes]] = defaultdict(list)
    for word in spelled:
        dealt[crc32(word) % _SPELLED_PARTS].append(word)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for place, some in dealt.items():
        yield _SPELLED, place, squeeze(b"\n".join(some))


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one block, or of one part of the spelled words, made one; they come sorted."""
    expand = zstandard.ZstdDecompressor().decompress

    def rows() -> Iterator[Row]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("part", "place", "counts")), strict=True)

    def whole() -> Iterator[Row]:
        for (part, place), some in groupby(rows(), lambda r: r[:2]):
            if part == _SPELLED:
                yield from _spelled_rows({w for *_, data in some for w in expand(data).split(b"\n")})
                continue
            total = np.zeros(2 * _BLOCK, dtype=np.int64)
            for *_, data in some:
                at, counts = unpacked(data)
                total[at] += counts
            at = np.flatnonzero(total)
            yield part, place, packed(at, total[at])

    yield from _sent(whole())


def _summed(rows: DataFrame) -> DataFrame:
    return rows.repartition("part", "place").sortWithinPartitions("part", "place").mapInArrow(_added, _ROWS)


def _count_words(by_word: Gathered, code: Code, symbols: np.ndarray, contexts: list[np.ndarray]) -> None:
    """Count the decisions of symbols in their contexts; those of a symbol in one context are counted together."""
    for order, context in enumerate(contexts):
        pairs, times = runs(np.sort(context.astype(np.uint64) << np.uint64(32) | symbols.astype(np.uint64)))
        own, coded = (pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32).astype(np.int64)
        for low, high in _parts(len(pairs)):
            sizes, entry = code.entries(coded[low:high])
            places = cells(picked(code.told, entry), np.repeat(own[low:high], sizes), WORD_BITS)
            by_word.add(order, places, np.repeat(times[low:high], sizes))


def _count_letters(by_letter: Gathered, found: list[bytes]) -> None:
    """Count the decisions that spell words; those of a letter after the same letters are counted together."""
    grams, times = runs(np.sort(letter_grams(found)[0]))
    for order in range(LETTER_ORDERS, 0, -1):
        own, n = runs(grams >> 9 * (LETTER_ORDERS - order), times)
        for low, high in _parts(len(own)):
            node, _, contexts = letter_steps(own[low:high] << 9 * (LETTER_ORDERS - order))
            by_letter.add(order - 1, cells(node, contexts[order - 1], LETTER_BITS), np.repeat(n[low:high], 8))


def _spelled_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """Spelled words of some rows at a time, in the order of their rows."""
    expand = zstandard.ZstdDecompressor().decompress
    held: list[bytes] = []
    for batch in batches:
        for data in batch.column("counts").to_pylist():
            held += sorted(expand(data).split(b"\n"))
            if len(held) >= _SPELLED_TOGETHER:
                yield held
                held = []
    if held:
        yield held


def table_counts(
    chunked: DataFrame, vocabulary: Vocabulary, code: Code, common: np.ndarray
) -> tuple[DataFrame, DataFrame]:
    """(part, place, counts): the tables' blocks, added up over all documents of ``chunked``; and all distinct spelled
    words.

    Letters are counted once per distinct word that is spelled, however many tasks meet it.
    """
    shared = chunked.sparkSession.sparkContext.broadcast((vocabulary, code, common))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_vocabulary, own_code, own_common = shared.value
        reader, by_word = Reader(own_vocabulary), Gathered(WORD_ORDERS, WORD_BITS)
        spelled: set[bytes] = set()
        for batch in batches:
            for chunk in read_chunks(batch):
                stream = reader.stream(chunk)
                _count_words(by_word, own_code, stream.coded, word_contexts(stream.symbols, stream.begins, own_common))
                spelled.update(map(chunk.words.__getitem__, stream.spelled_places().tolist()))
                if len(spelled) > REMEMBERED:
                    yield from _sent(_spelled_rows(spelled))
                    spelled.clear()
        yield from _sent(_spelled_rows(spelled))
        yield from _sent(by_word.rows(0))

    def count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_letter = Gathered(LETTER_ORDERS, LETTER_BITS)
        for some in _spelled_lists(batches):
            _count_letters(by_letter, some)
        yield from _sent(by_letter.rows(WORD_ORDERS))

    gathered = written(_summed(chunked.select("sizes", "words", "ids").mapInArrow(count_words, _ROWS)), "lm-gathered")
    is_spelled = F.col("part") == _SPELLED
    spelled = gathered.where(is_spelled)
    letters = _summed(spelled.mapInArrow(count_letters, _ROWS))
    return gathered.where(~is_spelled).unionByName(letters), spelled.select("place", "counts")


# places after the point of what tasks have learned; sums of whole numbers don't depend on their order
_POINT = 1 << 20
_LEARNED = "mixer int, place int, total long, n long"


def _told(number: int, mixer: Mixer) -> pa.RecordBatch:
    values, n = mixer.state()
    of = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(of), number, np.int32)),
            pa.array(of.astype(np.int32)),
            pa.array(np.rint(values[of] * _POINT).astype(np.int64) * n[of]),
            pa.array(n[of]),
        ],
        names=["mixer", "place", "total", "n"],
    )


def learned_mixers(
    chunked: DataFrame, spelled: DataFrame, types: int, vocabulary, code, common, of_words: np.ndarray, of_letters: np.ndarray
) -> tuple[Mixer, Mixer]:
    """The mixers of words and letters, learned from all documents of ``chunked`` and all ``spelled`` words.

    Chunks, and rows of spelled words, are dealt out by hashes, so what is learned does not depend on the layout of the input.
    """
    context = chunked.sparkSession.sparkContext
    shared_words = context.broadcast((vocabulary, code, common, of_words))
    shared_letters = context.broadcast(of_letters)

    def learn_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_vocabulary, own_code, own_common, table = shared_words.value
        reader = Reader(own_vocabulary)
        for batch in batches:
            for chunk in read_chunks(batch):
                stream, mixer = reader.stream(chunk), Mixer.new(WORD_ORDERS + 1)
                contexts = word_contexts(stream.symbols, stream.begins, own_common)
                for low, high in _parts(len(stream.coded)):
                    sizes, node, bit, base = own_code.decisions(stream.coded[low:high])
                    own = [np.repeat(c[low:high], sizes) for c in contexts]
                    mixer.learn(*_inputs(base, table, node, own, WORD_BITS), bit)
                yield _told(0, mixer)

    def learn_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, mixer = shared_letters.value, Mixer.new(LETTER_ORDERS)
        for some in _spelled_lists(batches):
            grams, times = runs(np.sort(letter_grams(some)[0]))
            mingled = np.argsort(scattered(grams, 102), kind="stable")
            for low, high in _parts(len(grams)):
                now = mingled[low:high]
                node, bit, own = letter_steps(grams[now])
                mixer.learn(*_inputs(None, table, node, own, LETTER_BITS), bit, np.repeat(times[now], 8))
        yield _told(1, mixer)

    told = chunked.select("sizes", "words", "ids").mapInArrow(learn_words, _LEARNED)
    dealt = spelled.repartition(max(1, types // LEARN_SPELLED), "place").sortWithinPartitions("place")
    told = told.unionByName(dealt.mapInArrow(learn_letters, _LEARNED))
    # as many rows as the mixers have values
    sums = told.groupBy("mixer", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    mixers = Mixer.new(WORD_ORDERS + 1), Mixer.new(LETTER_ORDERS)
    for row in sums.collect():
        mixers[row["mixer"]].put(row["place"], float(row["total"] / row["n"]) / _POINT, row["n"])
    shared_words.destroy()
    shared_letters.destroy()
    return mixers


def learn(docs: DataFrame, rows: int | None = None) -> tuple[Model, DataFrame]:
    """The model of the training documents, and their word counts.

    All documents are counted; the mixers learn from all of them too, unless the caller bounds their ``rows``.
    """
    first = None
    if rows is not None:
        training = docs.where(F.coalesce(fold(F.col("doc_id"), FOLDS) != HELD_OUT, F.lit(True)))
        first = chunks(training.orderBy(F.xxhash64(F.lit(5), "doc_id"), F.xxhash64("text")).limit(rows))
    return learned(chunks(docs), first)


def learned(chunked: DataFrame, for_mixers: DataFrame | None = None) -> tuple[Model, DataFrame]:
    """The model of the chunks to be learned from, and their word counts."""
    training = chunked.where("training")
    counts = written(word_counts(training), "lm-words")
    sums = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = sums["n"] or 0, sums["v"]
    listed = counts.where((F.col("word") != _END_HASH) & (F.col("n") >= LEAST_COUNT))
    top = listed.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    ends = counts.where(F.col("word") == _END_HASH).agg(F.sum("n").alias("n")).first()["n"] or 0
    top = sorted((r["word"], r["n"]) for r in top)
    numbers = np.array([w for w, _ in top], dtype=np.int64)
    often = np.array([n for _, n in top], dtype=np.float64)
    vocabulary = Vocabulary(numbers, often, float(total - ends - often.sum()))
    code = vocabulary.code(float(ends))
    common = np.zeros(len(numbers) + _FIRST_WORD, dtype=bool)
    common[np.argsort(-often, kind="stable")[:COMMON] + _FIRST_WORD] = True
    word_tables, letter_tables = Tables(WORD_ORDERS, WORD_BITS), Tables(LETTER_ORDERS, LETTER_BITS)
    # the tables have a fixed size, and so has what comes here
    blocks, spelled = table_counts(training, vocabulary, code, common)
    for row in blocks.toLocalIterator():
        of_words = row["part"] < WORD_ORDERS
        tables, order = (word_tables, row["part"]) if of_words else (letter_tables, row["part"] - WORD_ORDERS)
        tables.take(order, row["place"], bytes(row["counts"]))
    packed_words, words_left_out = _packed(word_tables.counts), left_out(fitted(word_tables.counts))
    packed_letters, letters_left_out = _packed(letter_tables.counts), left_out(fitted(letter_tables.counts))
    del word_tables, letter_tables
    types = max(distinct - len(numbers), 0)
    word_mixer, letter_mixer = learned_mixers(
        training if for_mixers is None else for_mixers,
        spelled,
        types,
        vocabulary,
        code,
        common,
        words_left_out,
        letters_left_out,
    )
    model = Model(
        vocabulary,
        code,
        common,
        packed_words,
        packed_letters,
        word_mixer,
        letter_mixer,
        int(total),
        int(distinct),
    )
    return model, counts


class Scorer:
    def __init__(self, model: Model):
        self.model, self.reader = model, Reader(model.vocabulary)
        self._word_costs, self._letter_costs = model.word_mixer.costs(), model.letter_mixer.costs()

    def spelling(self, found: list[bytes]) -> np.ndarray:
        """log10 of the probability of each word's letters."""
        if not found:
            return np.empty(0)
        m = self.model
        grams, first = letter_grams(found)
        distinct, which = np.unique(grams, return_inverse=True)
        costs = np.empty(len(distinct))
        for low, high in _parts(len(distinct)):
            node, bit, contexts = letter_steps(distinct[low:high])
            cost = bit_costs(m.letter_mixer, self._letter_costs, None, m.packed_letters, node, contexts, bit, LETTER_BITS)
            costs[low:high] = cost.reshape(-1, 8).sum(axis=1, dtype=np.float64)
        return np.add.reduceat(costs[which], first)

    def score(self, chunk: Chunk) -> tuple[Stream, np.ndarray]:
        """The chunk's stream, and log10 of each document's probability."""
        m = self.model
        stream = self.reader.stream(chunk)
        contexts = word_contexts(stream.symbols, stream.begins, m.common)
        per_token = np.zeros(len(stream.coded))
        for low, high in _parts(len(stream.coded)):
            sizes, node, bit, base = m.code.decisions(stream.coded[low:high])
            own = [np.repeat(c[low:high], sizes) for c in contexts]
            cost = bit_costs(m.word_mixer, self._word_costs, base, m.packed_words, node, own, bit, WORD_BITS)
            per_token[low:high] = np.add.reduceat(cost, np.cumsum(sizes) - sizes, dtype=np.float64)
        places = stream.spelled_places()
        spelling = np.zeros(len(stream.numbers))
        spelling[places] = self.spelling([chunk.words[i] for i in places.tolist()])
        escaped = stream.coded == _ESCAPE
        per_token[escaped] += spelling[stream.own[escaped]]
        return stream, np.bincount(stream.document, weights=per_token, minlength=len(stream.sizes))


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte per row of ``docs``.

    The model learns from the documents outside the held-out fold and scores all of them whole; NULL and empty texts are
    one end. Rows without an id are learned from and not held out. ``score`` is log10 of the probability of the row of
    words (A-Z in lower case) and the end; bits_per_byte divides it by the bytes of the words with one blank each.
    Repeated rows get equal scores; without training documents all words are spelled by an untrained model.
    """
    chunked = chunks(docs.select("doc_id", "text"))
    model, counts = learned(chunked)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    norm = float(model.total + (model.distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        m = shared.value
        ends = m.total - m.vocabulary.others - m.vocabulary.counts.sum()
        often = np.concatenate([[ends, 0, 0], m.vocabulary.counts])
        base_of = np.log10((often + 1) / norm)
        for batch in batches:
            for chunk, ids in zip(read_chunks(batch), batch.column("doc_id"), strict=True):
                stream, total = scorer.score(chunk)
                document, size = stream.document, len(stream.sizes)
                listed = stream.symbols != _ESCAPE
                known = np.bincount(document, weights=listed & (often[stream.symbols] > 0), minlength=size)
                base = np.bincount(document, weights=np.where(listed, base_of[stream.symbols], 0.0), minlength=size)
                letters = np.array([*map(len, chunk.words), 0]) + 1
                offsets = np.concatenate([[0], np.cumsum(np.bincount(document[~listed], minlength=size))])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.values,
                        pa.array(stream.sizes),
                        pa.array(known.astype(np.int64)),
                        pa.array(base),
                        pa.array(total),
                        pa.array(np.bincount(document, weights=letters[stream.own], minlength=size).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(stream.numbers[stream.own[~listed]])),
                    ],
                    names=["doc_id", "n_tokens", "listed", "base", "score", "letters", "rare"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    scored = chunked.select("doc_id", "sizes", "words", "ids").mapInArrow(
        run,
        f"doc_id {id_type}, n_tokens long, listed long, base double, score double, letters long, rare array<long>",
    )
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    # words outside the vocabulary meet their counts in a join
    rare = scored.select("row", F.explode("rare").alias("rare_word"))
    met = rare.join(counts, F.col("rare_word") == F.col("word"), "left").groupBy("row").agg(
        F.sum(F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(norm))).alias("rare_base"), F.count("n").alias("rare_known")
    )
    joined = scored.drop("rare").join(met, "row", "left")
    return joined.select(
        "doc_id",
        in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"),
        "n_tokens",
        (F.col("listed") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        "score",
        (-F.col("score") * float(np.log2(10)) / F.col("letters")).alias("bits_per_byte"),
    )
