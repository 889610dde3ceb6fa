"""Token ids in wavelet matrix files, one per shard.

A shard holds the ids of consecutive documents as a wavelet matrix: one bit plane per bit of an id, from the highest on,
where each plane lists the ids in the order that the planes above have sorted them into. With counts of ones before each
block of a plane, one can read any id, count an id's occurrences and find them without unpacking the rest.
A file holds the planes, their rank counts, the documents' ids and where each begins.

File format: `MAGIC`, a little-endian length, a JSON header, then zstd-compressed sections of the lengths that the header
names. Planes are compressed in frames, and a query expands only those frames that it needs.
"""

from __future__ import annotations

import io
import json
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import count, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexlake.llm.common import texts
from lexlake.session import new_work_path, written

MAGIC = b"WMTX0002"
END = 1
# ids in a shard, about: a shard is closed at the end of the document that reaches it
SHARD_IDS = 4_000_000
# bits of a plane that have a rank count, and bytes of one that are compressed together
_BLOCK = 512
_FRAME = 1 << 16
# bytes of text whose unknown pieces are handed to the library together, and pieces in one call
TOGETHER, IN_CALL = 4_000_000, 4096
# distinct pieces of text whose ids a task remembers
PIECES = 1_500_000
PIECE_MARK = "<|startoftext|>"
# what is cut off behind a word of letters: it neither is a letter, digit or blank nor begins a contraction
_BEHIND = ".,;:!?#$%&*|"


class Frames:
    """A plane in compressed frames of `_FRAME` bytes, of which the one last asked for is kept expanded."""

    def __init__(self, frames: list[bytes]):
        self._frames = frames
        self._at, self._open = -1, np.empty(0, np.uint8)

    def _frame(self, number: int) -> np.ndarray:
        if number != self._at:
            expanded = zstandard.ZstdDecompressor().decompress(self._frames[number])
            self._at, self._open = number, np.frombuffer(expanded, np.uint8)
        return self._open

    def __getitem__(self, at: int | slice) -> np.uint8 | np.ndarray:
        """A byte, or bytes of one block, which never lies in two frames."""
        first = at.start if isinstance(at, slice) else at
        if isinstance(at, slice):
            if at.start >= at.stop:
                return np.empty(0, np.uint8)
            return self._frame(first // _FRAME)[first % _FRAME : (at.stop - 1) % _FRAME + 1]
        return self._frame(first // _FRAME)[first % _FRAME]

    def whole(self) -> np.ndarray:
        expand = zstandard.ZstdDecompressor().decompress
        return np.frombuffer(b"".join(map(expand, self._frames)), np.uint8)


class WaveletMatrix:
    """A sequence of non-negative integers that answers access, rank, count and select from bit planes.

    ``blocks`` are the ones before each block of each plane, and in all of it; they are counted where they aren't given.
    """

    def __init__(self, planes: list[np.ndarray] | list[Frames], n: int, blocks: list[np.ndarray] | None = None):
        self.n, self.bits, self.planes = n, len(planes), planes
        self.blocks = [self._counted(plane) for plane in planes] if blocks is None else blocks
        self.zeros = [n - int(b[-1]) for b in self.blocks]

    def _counted(self, plane: np.ndarray) -> np.ndarray:
        padded = np.zeros(-(-self.n // _BLOCK) * _BLOCK // 8 or 1, dtype=np.uint8)
        padded[: len(plane)] = plane
        ones = np.bitwise_count(padded).reshape(-1, min(_BLOCK // 8, len(padded))).sum(axis=1, dtype=np.int64)
        return np.concatenate([[0], np.cumsum(ones)])

    @classmethod
    def of(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, now = [], np.array(ids)
        sorted_ = np.empty_like(now)
        for level in range(bits - 1, -1, -1):
            set_ = (now & now.dtype.type(1 << level)) != 0
            planes.append(np.packbits(set_, bitorder="little"))
            zeros = len(now) - int(np.count_nonzero(set_))
            np.compress(~set_, now, out=sorted_[:zeros])
            np.compress(set_, now, out=sorted_[zeros:])
            now, sorted_ = sorted_, now
        return cls(planes, len(ids))

    def _ones(self, level: int, at: int) -> int:
        """Ones among the first ``at`` bits of a plane."""
        block = at // _BLOCK
        plane, byte = self.planes[level], at >> 3
        count = int(self.blocks[level][block]) + int(np.bitwise_count(plane[block * _BLOCK // 8 : byte]).sum())
        return count + (int(plane[byte] & ((1 << (at & 7)) - 1)).bit_count() if at & 7 else 0)

    def access(self, at: int) -> int:
        value = 0
        for level in range(self.bits):
            bit = int(self.planes[level][at >> 3]) >> (at & 7) & 1
            ones = self._ones(level, at)
            at = self.zeros[level] + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, low: int, high: int) -> tuple[int, int]:
        """Where a value's occurrences among positions low..high-1 stand below the last plane."""
        for level in range(self.bits):
            low_ones, high_ones = self._ones(level, low), self._ones(level, high)
            if value >> (self.bits - 1 - level) & 1:
                low, high = self.zeros[level] + low_ones, self.zeros[level] + high_ones
            else:
                low, high = low - low_ones, high - high_ones
        return low, high

    def rank(self, value: int, at: int) -> int:
        """Occurrences of a value before a position."""
        return self.count(value, 0, at)

    def count(self, value: int, low: int = 0, high: int | None = None) -> int:
        if value >> self.bits:
            return 0
        low, high = self._range(value, low, self.n if high is None else high)
        return high - low

    def select(self, value: int, k: int) -> int:
        """Position of the k-th occurrence of a value, counted from 0."""
        if not 0 <= k < self.count(value):
            raise IndexError("the value does not occur so often")
        at = self._range(value, 0, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - level) & 1
            wanted = at - self.zeros[level] if bit else at  # the bit's wanted-th occurrence in this plane
            low, high = 0, self.n
            while high - low > 1:
                middle = (low + high) // 2
                ones = self._ones(level, middle)
                if (ones if bit else middle - ones) <= wanted:
                    low = middle
                else:
                    high = middle
            at = low
        return at

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    def all(self) -> np.ndarray:
        """All values: from the last plane up, each plane tells which values of the one below belong where."""
        values = np.zeros(self.n, dtype=np.uint32 if self.bits > 16 else np.uint16)
        for level in range(self.bits - 1, -1, -1):
            plane = self.planes[level]
            plane = plane.whole() if isinstance(plane, Frames) else plane
            ones = np.unpackbits(plane, count=self.n, bitorder="little").astype(bool)
            above = np.empty_like(values)
            values[self.zeros[level] :] |= values.dtype.type(1 << (self.bits - 1 - level))
            np.place(above, ~ones, values[: self.zeros[level]])
            np.place(above, ones, values[self.zeros[level] :])
            values = above
        return values.astype(np.uint32)


def pack(ids: np.ndarray, doc_ids: list[int | None], starts: np.ndarray, bits: int) -> bytes:
    """One shard's file."""
    matrix = WaveletMatrix.of(ids.astype(np.uint16 if bits <= 16 else np.uint32), bits)
    known = np.array([i is not None for i in doc_ids], dtype=np.uint8)
    numbers = np.array([0 if i is None else i for i in doc_ids], dtype="<i8")
    squeeze = zstandard.ZstdCompressor(level=1).compress
    sections = [squeeze(x.tobytes()) for x in (numbers, known, starts.astype("<i8"))]
    # ones in each block: a block has 512 bits
    sections += [squeeze(np.diff(b).astype("<u2").tobytes()) for b in matrix.blocks]
    raw = [plane.tobytes() for plane in matrix.planes]
    sections += [squeeze(plane[at : at + _FRAME]) for plane in raw for at in range(0, len(plane), _FRAME)]
    header = json.dumps(
        {"n": len(ids), "bits": bits, "docs": len(doc_ids), "sections": [len(s) for s in sections]}
    ).encode()
    return MAGIC + len(header).to_bytes(8, "little") + header + b"".join(sections)


def unpack(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """The matrix of a shard's file, its documents' ids, and where each document begins. Planes stay compressed."""
    file = io.BytesIO(data)
    if file.read(8) != MAGIC:
        raise ValueError("not a wavelet matrix file")
    header = json.loads(file.read(int.from_bytes(file.read(8), "little")))
    bits = header["bits"]
    sections = [file.read(n) for n in header["sections"]]
    expand = zstandard.ZstdDecompressor().decompress
    raw = [expand(s) for s in sections[: 3 + bits]]
    numbers, known, starts = (np.frombuffer(x, t) for x, t in zip(raw, ("<i8", np.uint8, "<i8"), strict=False))
    blocks = [np.concatenate([[0], np.cumsum(np.frombuffer(x, "<u2"), dtype=np.int64)]) for x in raw[3:]]
    frames = sections[3 + bits :]
    each = len(frames) // bits
    planes = [Frames(frames[at : at + each]) for at in range(0, each * bits, each)] if each else [Frames([])] * bits
    doc_ids = [int(i) if k else None for i, k in zip(numbers, known, strict=True)]
    return WaveletMatrix(planes, header["n"], blocks), doc_ids, starts


class PieceEncoder:
    """Ids of whole texts by the tokenizers library, which sees each distinct piece between ASCII white space once.

    Unknown pieces are handed over many at a time. A piece of letters is one word to the library, and so ends with the one
    token of its that ends a word; punctuation behind it is a word of its own. Other pieces get a special token between
    them to tell their ids apart.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._mark = self._tokenizer.token_to_id(PIECE_MARK)
        self.bits = int(self._tokenizer.get_vocab_size() - 1).bit_length()
        suffix = json.loads(self._tokenizer.to_str())["model"]["end_of_word_suffix"]
        self._ends = np.zeros(self._tokenizer.get_vocab_size(), dtype=bool)
        for token, number in self._tokenizer.get_vocab().items():
            self._ends[number] = token.endswith(suffix)
        self._forget()

    def _forget(self) -> None:
        # pieces are numbered as they come; piece i has the ids from _begin[i] to _begin[i + 1] in _flat
        self._numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        self._flat, self._begin = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def _library(self, text: str) -> np.ndarray:
        # encode_batch_fast leaves out what only offsets need
        [found] = self._tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found.ids, dtype="<u4")

    def _ids_of(self, pieces: list[bytes]) -> list[bytes]:
        # pieces hold no line feed, and one never belongs to a damaged letter
        found = b"\n".join(pieces).decode("utf-8", "replace").split("\n")
        out = [b""] * len(found)
        cut, stems, tails, others = [], [], [], []
        for at, text in enumerate(found):
            word = text.rstrip(_BEHIND)
            # the library takes some letters apart first
            if word.isalpha() and (
                word.isascii() or (word.lower().isalpha() and unicodedata.normalize("NFC", word).isalpha())
            ):
                cut.append(at)
                stems.append(word)
                tails.append(text[len(word) :])
            else:
                others.append(at)
        words: dict[str, bytes] = dict.fromkeys(stems)
        listed = list(words)
        for at in range(0, len(listed), IN_CALL):
            some = listed[at : at + IN_CALL]
            self._share(some, words, " ".join(some), self._ends, keep=1)
        behind = {tail: self._library(tail).tobytes() for tail in set(tails)}
        for at, word, tail in zip(cut, stems, tails, strict=True):
            out[at] = words[word] + behind[tail]
        mark = np.zeros(len(self._ends), dtype=bool)
        mark[self._mark] = True
        for low in range(0, len(others), IN_CALL):
            at = others[low : low + IN_CALL]
            some = [found[i] for i in at]
            shared: dict[str, bytes] = {}
            if any("<|" in text for text in some):
                shared.update((text, self._library(text).tobytes()) for text in some)
            else:
                self._share(some, shared, PIECE_MARK.join([*some, ""]), mark, keep=0)
            for i, text in zip(at, some, strict=True):
                out[i] = shared[text]
        return out

    def _share(self, parts: list[str], into: dict[str, bytes], joined: str, ends: np.ndarray, keep: int) -> None:
        """Share the ids of a joined text out among its parts: each ends with a marked id, which it may keep."""
        ids = self._library(joined)
        last = np.flatnonzero(ends[ids])
        if len(last) != len(parts):
            # the library sees other parts than were joined, so it gets them one by one
            into.update((part, self._library(part).tobytes()) for part in parts)
            return
        first = np.concatenate([[0], last[:-1] + 1])
        raw = ids.tobytes()
        for part, low, high in zip(parts, (4 * first).tolist(), (4 * (last + keep)).tolist(), strict=True):
            into[part] = raw[low:high]

    def encode_all(self, found: Iterable[str | None]) -> Iterator[np.ndarray]:
        held: list[list[bytes]] = []
        size = 0
        for text in found:
            raw = (text or "").encode("utf-8", "surrogatepass")
            # the vocabulary is in lower case; marks of special tokens are told apart by case
            held.append((raw if b"<|" in raw else raw.lower()).split())
            size += len(raw)
            if size >= TOGETHER:
                yield from self._encoded(held)
                held, size = [], 0
        yield from self._encoded(held)

    def _encoded(self, held: list[list[bytes]]) -> Iterator[np.ndarray]:
        if len(self._numbers) > PIECES:
            self._forget()
        before = len(self._numbers)
        number = self._numbers.__getitem__
        numbers = [np.fromiter(map(number, pieces), np.int64, len(pieces)) for pieces in held]
        fresh = list(islice(self._numbers, before, None))
        if fresh:
            found = self._ids_of(fresh)
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
            self._flat = np.concatenate([self._flat, np.frombuffer(b"".join(found), "<u4")])
            self._begin = np.concatenate([self._begin, self._begin[-1] + np.cumsum(sizes)])
        for own in numbers:
            begin = self._begin[own]
            sizes = self._begin[own + 1] - begin
            ends = np.cumsum(sizes)
            yield self._flat[np.repeat(begin - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


@cache
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _store(folder: str, name: str, data: bytes) -> None:
    """Write a file to the shared folder under a name of its own, then give it its final name in one step."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder) if "://" in folder or ":" in folder.split("/")[0] else (
        fs.LocalFileSystem(),
        folder,
    )
    system.create_dir(path, recursive=True)
    attempt = f"{path}/_{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(attempt) as out:
        out.write(data)
    try:
        system.move(attempt, f"{path}/{name}")
    except OSError:
        # a task that runs again finds the file, which has the same content
        if system.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
            raise
        system.delete_file(attempt)


def write_shards(docs: DataFrame, vocabulary: str, folder: str, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode every text of ``docs``, end it with `END`, and write shards in ascending doc_id order.

    Returns the manifest: partition, shard, file, n_ids. Rows are dealt out by ranges of ids, so a shard's documents are
    consecutive; rows without an id come first, rows of one id in the order of their text's hash. A task that runs again
    writes the same files again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        coder, parts, doc_ids, starts, held, shard = encoder(vocabulary), [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"part-{partition:06d}-{shard:06d}.wm"
            _store(folder, name, pack(np.concatenate(parts), doc_ids, np.array(starts), coder.bits))
            return pa.RecordBatch.from_arrays(
                [pa.array([partition], pa.int32()), pa.array([shard], pa.int32()), pa.array([name]), pa.array([held])],
                names=["partition", "shard", "file", "n_ids"],
            )

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coder.encode_all(texts(batch)), strict=True):
                starts.append(held)
                doc_ids.append(doc_id)
                parts.append(np.append(ids, np.uint32(END)).astype(np.uint16 if coder.bits <= 16 else np.uint32))
                held += len(ids) + 1
                if held >= shard_ids:
                    yield close()
                    parts, doc_ids, starts, held, shard = [], [], [], 0, shard + 1
        if doc_ids:
            yield close()

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    return ordered.mapInArrow(run, "partition int, shard int, file string, n_ids long")


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shards, read from the files.

    start counts the ids of all shards before, one row per shard being summed, and of the documents before in the shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path"), batch.column("content"), strict=True):
                matrix, doc_ids, starts = unpack(data.as_buffer().to_pybytes())
                ids = matrix.all().astype("<u4")
                if matrix.count(END) != np.count_nonzero(ids == END):
                    raise ValueError(f"rank counts of {path} do not fit its planes")
                ends = np.append(starts[1:], matrix.n)
                sums = [crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                file = path.as_py().rsplit("/", 1)[-1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file] * len(doc_ids), pa.string()),
                        pa.array(doc_ids, pa.int64()),
                        pa.array(starts.astype(np.int64)),
                        pa.array((ends - starts).astype(np.int64)),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["file", "doc_id", "start_here", "n_tokens", "ids_crc32"],
                )

    before = Window.orderBy("partition", "shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.select(
        F.col("file").alias("of_file"), F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base")
    )
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.wm").load(folder).select("path", "content")
    found = files.mapInArrow(run, "file string, doc_id long, start_here long, n_tokens long, ids_crc32 long")
    return found.join(bases, F.col("file") == F.col("of_file")).select(
        "doc_id", (F.col("base") + F.col("start_here")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_files(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write all of ``docs`` as shards to the shared folder and read them back, see `write_shards`, `read_shards`.

    NULL and empty texts hold the end id only. An empty table writes no file and gives no rows.
    """
    spark = docs.sparkSession
    folder = new_work_path(spark, "wavelet-shards")
    manifest = written(write_shards(docs, vocabulary, folder), "wavelet-manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_shards(spark, folder, manifest)
