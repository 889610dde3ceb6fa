"""Phrases whose words occur together more often than apart, counted by stripes.

A stripe is the associative counter of one prefix, a word: how often each next word follows it, and each pair of next words.
The empty prefix has a stripe too, in which all words follow. Tasks count a block of words at a time and send one row per
prefix; the rows of a prefix meet once and are added up element by element. What they hold then answers everything: the
empty prefix has the words and their number, the stripe of a word has its phrases of two words, which are the totals of
prefixes of two, and their extensions; the largest extension tells whether a longer phrase covers a shorter one.

A prefix may hold a large share of all words. Stripes of the empty prefix, and of words that a sample of documents shows to
be frequent, are cut by a hash of what follows, so that no task meets one of them whole. The sample decides on the cut
alone: counts are exact whatever it says. Stripes are added up row by row in a hash aggregate, which may spill.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexlake.llm.common import texts
from lexlake.session import written

LEAST_COUNT = 10
# a phrase goes when a longer one has at least this share of its occurrences, in percent
COVERED = 50
TOP = 2000
NO_LANGUAGE = "und"
# words counted before their stripes are sent; three word numbers of a block must fit 64 bits
BLOCK = 1_200_000
# documents of the sample, the share of its words that makes a prefix frequent, and the parts of such a stripe
SAMPLE_ROWS, FREQUENT, PARTS = 20_000, 4096, 64
ROOT_PARTS = 1024

_BREAKS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b".........")
# what follows is one text with a line for each, as no word holds a line feed
_STRIPES = "lang string, first string, part int, following string, n array<long>"


class _Block:
    """Words of some documents as numbers, by language; 0 stands for a break."""

    def __init__(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        self.numbers[b"."]
        self.found: defaultdict[str, list[tuple[np.ndarray, int]]] = defaultdict(list)
        self.size = 0

    def add(self, lang: str, words: list[bytes], ahead: list[bytes]) -> None:
        """Count from ``words`` on; phrases may go on into the two words ``ahead``."""
        numbers = np.zeros(len(words) + 2, np.int64)
        seen = [*words, *ahead]
        numbers[: len(seen)] = np.fromiter(map(self.numbers.__getitem__, seen), np.int64, len(seen))
        self.found[lang].append((numbers, len(words)))
        self.size += len(words)

    def stripes(self, frequent: set[tuple[str, str]], root_only: bool = False) -> Iterator[pa.RecordBatch]:
        names = pa.array([w.decode("utf-8", "surrogatepass") for w in self.numbers], pa.string())
        hashes = np.fromiter(map(zlib.crc32, self.numbers), np.int64, len(self.numbers))
        for lang, parts in self.found.items():
            first, second, third = (np.concatenate([n[i : i + size] for n, size in parts]) for i in range(3))
            yield _root(lang, first, hashes, names)
            whole = (first != 0) & (second != 0)
            if whole.any() and not root_only:
                cut = np.zeros(len(names), bool)
                cut[[self.numbers[_bytes(w)] for own, w in frequent if own == lang and _bytes(w) in self.numbers]] = True
                yield _extensions(lang, first[whole], second[whole], third[whole], cut, hashes, names)


def _bytes(word: str) -> bytes:
    return word.encode("utf-8", "surrogatepass")


def _root(lang: str, numbers: np.ndarray, hashes: np.ndarray, names: pa.Array) -> pa.RecordBatch:
    """The stripes of the empty prefix, which all words follow; under the empty text the number of words."""
    counts = np.bincount(numbers)
    counts[0] = 0
    seen = np.flatnonzero(counts)
    part = np.append(hashes[seen] % ROOT_PARTS, 0)
    following = pa.concat_arrays([names.take(pa.array(seen)), pa.array([""], pa.string())])
    order = np.argsort(part, kind="stable")
    return _rows(lang, None, part[order], following.take(pa.array(order)), np.append(counts[seen], counts.sum())[order], names)


def _extensions(
    lang: str, first: np.ndarray, second: np.ndarray, third: np.ndarray, cut: np.ndarray, hashes: np.ndarray, names: pa.Array
) -> pa.RecordBatch:
    """The stripes of words: next words, and pairs of next words. Those of words marked in ``cut`` come in parts."""
    base = np.uint64(len(names))
    keys = (first.astype(np.uint64) * base + second.astype(np.uint64)) * base + third.astype(np.uint64)
    keys, counts = np.unique(keys, return_counts=True)
    pairs, third = np.divmod(keys, base)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(pairs)) + 1])
    totals = np.add.reduceat(counts, starts)
    # what a break follows counts in the pair only
    goes_on = third != 0
    third = third[goes_on].astype(np.int64)
    first, second = (x.astype(np.int64) for x in np.divmod(np.concatenate([pairs[goes_on], pairs[starts]]), base))
    ahead = names.take(pa.array(second))
    longer = pc.binary_join_element_wise(ahead[: len(third)], names.take(pa.array(third)), " ")
    following = pa.concat_arrays([longer, ahead[len(third) :]])
    mixed = hashes[second] * 31
    mixed[: len(third)] += hashes[third]
    part = np.where(cut[first], mixed % PARTS, 0)
    order = np.lexsort((second, part, first))
    counts = np.concatenate([counts[goes_on], totals])[order]
    return _rows(lang, first[order], part[order], following.take(pa.array(order)), counts, names)


def _rows(
    lang: str, first: np.ndarray | None, part: np.ndarray, following: pa.Array, counts: np.ndarray, names: pa.Array
) -> pa.RecordBatch:
    """One row per prefix and part of entries sorted by them; None is the empty prefix."""
    changes = np.diff(part) != 0
    if first is not None:
        changes |= np.diff(first) != 0
    starts = np.concatenate([[0], np.flatnonzero(changes) + 1])
    offsets = pa.array(np.append(starts, len(part)).astype(np.int32))
    prefix = pa.array([""] * len(starts), pa.string()) if first is None else names.take(pa.array(first[starts]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([lang] * len(starts), pa.string()),
            prefix,
            pa.array(part[starts].astype(np.int32)),
            pc.binary_join(pa.ListArray.from_arrays(offsets, following), "\n"),
            pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64))),
        ],
        names=["lang", "first", "part", "following", "n"],
    )


def task_stripes(
    docs: DataFrame, frequent: set[tuple[str, str]], size: int = BLOCK, root_only: bool = False
) -> DataFrame:
    """Stripes of blocks of the documents (lang, text) of each task; a very long text is counted in several blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang, text in zip(langs, texts(batch), strict=True):
                words = _bytes(text or "").lower().translate(_BREAKS).replace(b".", b" . ").split()
                for start in range(0, len(words), size):
                    end = start + size
                    block.add(NO_LANGUAGE if lang is None else lang, words[start:end], words[end : end + 2])
                    if block.size >= size:
                        yield from block.stripes(frequent, root_only)
                        block = _Block()
        if block.size:
            yield from block.stripes(frequent, root_only)

    return docs.select("lang", "text").mapInArrow(run, _STRIPES)


def entries(stripes: DataFrame) -> DataFrame:
    """One row per entry: (lang, first, part, next, n)."""
    zipped = F.arrays_zip(F.split("following", "\n").alias("next"), F.col("n").alias("n"))
    return stripes.select("lang", "first", "part", F.inline(zipped).alias("next", "n"))


def frequent_words(docs: DataFrame) -> set[tuple[str, str]]:
    """Words that are a `FREQUENT`-th of the words of a sample of documents or more, so at most `FREQUENT`."""
    rows = docs.count()
    sample = docs if rows <= SAMPLE_ROWS else docs.sample(SAMPLE_ROWS / rows, 1)
    sums = entries(task_stripes(sample, set(), root_only=True)).groupBy("lang", "next").agg(F.sum("n").alias("n"))
    counts = written(sums, "stripes-sample")
    words = counts.where("next = ''").agg(F.sum("n").alias("n")).first()["n"] or 0
    often = counts.where((F.col("next") != "") & (F.col("n") * FREQUENT >= words))
    return {(r["lang"], r["next"]) for r in often.collect()}


def merged_stripes(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """(lang, first, next, n): entries of all stripes that reach ``least_count``; the number of words whatever it is.

    Rows of a prefix and part are shuffled as they are; adding them up needs no further exchange.
    """
    stripes = task_stripes(docs, frequent_words(docs)).repartition("lang", "first", "part")
    sums = entries(stripes).groupBy("lang", "first", "part", "next").agg(F.sum("n").alias("n"))
    return sums.where((F.col("n") >= least_count) | (F.col("next") == "")).drop("part")


def _cut(left: Column, right: Column, a: Column) -> Column:
    """floor(1000000 a a / (left right)) in decimals of 38 digits: exact for counts below 10^15."""
    exact = [c.cast("decimal(19,0)") for c in (a, left, right)]
    scaled = (exact[0] * exact[0] * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")
    return F.call_function("div", scaled, (exact[1] * exact[2]).cast("decimal(38,0)"))


def collocations(
    docs: DataFrame, least_count: int = LEAST_COUNT, covered: int = COVERED, top: int = TOP
) -> DataFrame:
    """The ``top`` phrases of two or three words of each language of ``docs`` (lang, text), best first.

    lang, rank, phrase, a (its occurrences), l and r (those of the two parts of its lowest-scoring cut), n (words of the
    language), score. A phrase that a longer one with ``covered`` percent of its occurrences contains is left out. Equal
    scores are ranked by a, then by the phrase's bytes. A NULL lang is `und`, NULL and empty texts have no words, repeated
    rows count as often as they come; an empty table has no phrases; other columns are not looked at.
    """
    table = written(merged_stripes(docs, least_count), "stripes-merged")
    root, phrases = table.where("first = ''"), table.where("first != ''")
    sizes = root.where("next = ''").groupBy("lang").agg(F.sum("n").alias("n"))
    words = root.where("next != ''").select("lang", F.col("next").alias("word"), "n")
    of_two = F.instr("next", " ") == 0
    twos = phrases.where(of_two).select("lang", "first", F.col("next").alias("second"), F.col("n").alias("a"))
    ahead = [F.substring_index("next", " ", i).alias(c) for i, c in ((1, "second"), (-1, "third"))]
    threes = phrases.where(~of_two).select("lang", "first", *ahead, F.col("n").alias("a"))

    def with_count(df: DataFrame, column: str, name: str) -> DataFrame:
        right = words.select(F.col("lang").alias("w_lang"), F.col("word"), F.col("n").alias(name))
        return df.join(right, (df["lang"] == right["w_lang"]) & (df[column] == right["word"])).drop("w_lang", "word")

    def with_pair(df: DataFrame, first: str, second: str, name: str) -> DataFrame:
        right = twos.select(
            F.col("lang").alias("p_lang"), F.col("first").alias("p_first"), F.col("second").alias("p_second"), F.col("a").alias(name)
        )
        same = (df["lang"] == right["p_lang"]) & (df[first] == right["p_first"]) & (df[second] == right["p_second"])
        return df.join(right, same).drop("p_lang", "p_first", "p_second")

    # the largest extension on either side
    either = [threes.select("lang", F.col(x).alias("x"), F.col(y).alias("y"), "a") for x, y in (("first", "second"), ("second", "third"))]
    largest = either[0].unionByName(either[1]).groupBy("lang", "x", "y").agg(F.max("a").alias("longer"))
    largest = largest.withColumnRenamed("lang", "x_lang")
    same = (twos["lang"] == F.col("x_lang")) & (twos["first"] == F.col("x")) & (twos["second"] == F.col("y"))
    free = twos.join(largest, same, "left")
    free = free.where(F.coalesce(F.col("longer") * 100 < F.col("a") * covered, F.lit(True)))
    two = with_count(with_count(free.select("lang", "first", "second", "a"), "first", "l"), "second", "r")
    two = two.select("lang", F.concat_ws(" ", "first", "second").alias("phrase"), "a", "l", "r", _cut(F.col("l"), F.col("r"), F.col("a")).alias("score"))
    three = with_count(with_count(threes, "first", "l1"), "third", "r2")
    three = with_pair(with_pair(three, "first", "second", "l2"), "second", "third", "r1")
    a = F.col("a")
    early, late = _cut(F.col("l1"), F.col("r1"), a), _cut(F.col("l2"), F.col("r2"), a)
    three = three.select(
        "lang", F.concat_ws(" ", "first", "second", "third").alias("phrase"), "a", "l1", "r1", "l2", "r2",
        early.alias("early"), late.alias("late"),
    )
    first_cut = F.col("early") <= F.col("late")
    three = three.select(
        "lang", "phrase", "a", F.when(first_cut, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(first_cut, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("early", "late").alias("score"),
    )
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # leaders of parts of a language first, so that no task ranks all its phrases
    found = two.unionByName(three).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    leaders = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    ranked = leaders.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    ranked = ranked.join(sizes.withColumnRenamed("lang", "size_lang"), F.col("lang") == F.col("size_lang"))
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
