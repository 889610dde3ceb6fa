"""Tokens that still need a manual definition and are not published in any form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.functions import fixed_values as fixed
from lexlake.functions.columns import sheet_time, split_cell
from lexlake.operators.definitions import undefined_rows
from lexlake.session import BROADCAST_LIMIT, byte_size, written
from lexlake.spec import WORKLIST_SHEET

# Texts up to this length are compared whole; a longer one is found by its first characters.
ANCHOR_LENGTH = 8
# Start positions per piece when cells are cut: bounds the array one row holds, however long its cell is. Cells are cut in
# two steps, as Spark finds a position in a string by walking to it: one pass cuts a cell into chunks, and only a chunk
# is walked.
POSITIONS_PER_PIECE = 32
CHUNK_LENGTH = 1024
# bits of the filter of wanted grams: so many per gram, within these bounds. The upper one keeps its table, of a row for 64
# bits, small enough to broadcast; with very many grams it lets most others pass, and they are shuffled as without it.
FILTER_BITS_PER_GRAM, FILTER_BITS = 16, (1 << 16, 1 << 24)


def render_worklist(silver: DataFrame) -> DataFrame:
    rows = undefined_rows(silver)
    return rows.select(
        "text",
        F.array_join("books", fixed.WORKLIST_SEPARATOR).alias("books"),
        "occurrences",
        sheet_time(F.col("firstOccurrence")).alias("firstOccurrence"),
        sheet_time(F.col("latestOccurrence")).alias("latestOccurrence"),
    ).select(*WORKLIST_SHEET.attributes)


def _chunks(cells: DataFrame, length: int, overlap: int) -> DataFrame:
    """(cell_id, chunk, text, own): every cell in chunks of ``length`` characters and the first ``overlap`` of the next.

    ``own`` is the chunk's length without the overlap. One pass over the cell, whatever its length; ``overlap`` must not
    exceed ``length``.
    """
    parts = F.regexp_extract_all("cell", F.lit(f"(?s).{{1,{length}}}"), F.lit(0))
    parts = F.when(F.length("cell") == 0, F.array(F.lit(""))).otherwise(parts)
    cut = cells.select("cell_id", parts.alias("parts"))

    def whole(part, at):
        after = F.substr(F.coalesce(F.get("parts", at + 1), F.lit("")), F.lit(1), F.lit(overlap))
        return F.struct(F.concat(part, after).alias("text"), F.length(part).alias("own"))

    chunks = cut.select("cell_id", F.posexplode(F.transform("parts", whole)).alias("chunk", "c"))
    return chunks.select("cell_id", "chunk", "c.text", "c.own")


def _grams(cells: DataFrame, lengths: list[int]) -> DataFrame:
    """(cell_id, position, gram) for every position of every cell and every wanted gram length.

    At the end of a cell the grams come out shorter; they occur in the cell all the same.
    """
    width = F.lit(POSITIONS_PER_PIECE + max(lengths) - 1)
    starts = F.sequence(F.lit(0), F.greatest(F.col("own") - 1, F.lit(0)), F.lit(POSITIONS_PER_PIECE))
    pieces = _chunks(cells, CHUNK_LENGTH, max(lengths)).select(
        "cell_id",
        "chunk",
        "own",
        F.explode(
            F.transform(starts, lambda s: F.named_struct(F.lit("start"), s, F.lit("text"), F.substr("text", s + 1, width)))
        ).alias("piece"),
    )
    last = F.greatest(F.lit(1), F.least(F.lit(POSITIONS_PER_PIECE), F.col("own") - F.col("piece.start")))
    places = pieces.select("cell_id", "chunk", "piece", F.explode(F.sequence(F.lit(1), last)).alias("at"))
    grams = F.array(*[F.substr("piece.text", "at", F.lit(n)) for n in lengths])
    position = F.col("chunk").cast("long") * CHUNK_LENGTH + F.col("piece.start") + F.col("at")
    return places.select("cell_id", position.alias("position"), F.explode(grams).alias("gram"))


def _filter_places(gram: str, bits: int) -> list[Column]:
    """The two bits of a gram."""
    return [F.pmod(F.xxhash64(F.lit(seed), F.col(gram)), F.lit(bits)) for seed in (1, 2)]


def gram_filter(grams: DataFrame, n: int) -> tuple[DataFrame, int]:
    """A Bloom filter of about ``n`` distinct ``gram`` values: (word, mask) for each 64 bits of which some are set.

    Every task sets the bits of its own grams; the words are united on the way to one row each.
    """
    bits = FILTER_BITS[0]
    while bits < min(FILTER_BITS_PER_GRAM * n, FILTER_BITS[1]):
        bits *= 2
    placed = grams.select(F.explode(F.array(*_filter_places("gram", bits))).alias("place"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))
    words = placed.groupBy(F.floor(F.col("place") / 64).alias("word")).agg(F.bit_or(mask).alias("mask"))
    return written(words, "gram-filter"), bits


def maybe_wanted(grams: DataFrame, words: DataFrame, bits: int) -> DataFrame:
    """Rows of ``grams`` whose ``gram`` may be in the filter: all that are, and few others."""
    for number, place in enumerate(_filter_places("gram", bits)):
        word, mask = f"_word{number}", f"_mask{number}"
        renamed = F.broadcast(words.select(F.col("word").alias(word), F.col("mask").alias(mask)))
        is_set = F.getbit(F.col(mask), (place % 64).cast("int")) == 1
        grams = grams.join(renamed, (F.floor(place / 64) == F.col(word)) & is_set, "left_semi")
    return grams


def contained_texts(texts: DataFrame, cells: DataFrame) -> DataFrame:
    """The distinct ``text`` values that occur anywhere inside some ``cell``.

    Substring search as equi-joins; no text is ever paired with a cell it does not occur in. Short texts are joined
    with the cells' grams of their length. A longer text is looked up by its first characters; each place found emits
    one substring per distinct length of the texts that start so, and these are compared whole. What is emitted grows
    with the cells' characters and not with texts x cells, even if very many texts share their beginning.

    Where the texts are few (their size is measured) they are broadcast and only the hits are shuffled; otherwise both sides
    are shuffled, after a filter of bounded size has dropped nearly all grams that no text begins with and nearly all
    substrings that are no text. What texts begin with is measured by itself, as it is broadcast more often.
    """
    wanted = written(texts.select("text").where(F.col("text").isNotNull()).distinct(), "wanted-texts")
    cells = (
        cells.select("cell").where(F.col("cell").isNotNull()).distinct().withColumn("cell_id", F.xxhash64("cell"))
    )
    size = F.length("text")
    # at most ANCHOR_LENGTH + 2 numbers
    sizes = wanted.select(F.least(size, F.lit(ANCHOR_LENGTH + 1)).alias("n")).distinct().collect()
    lengths = sorted(r["n"] for r in sizes)
    short = [n for n in lengths if n <= ANCHOR_LENGTH]

    def is_few(side: DataFrame) -> bool:
        return byte_size(side) <= BROADCAST_LIMIT

    def small(side: DataFrame, few: bool) -> DataFrame:
        return F.broadcast(side) if few else side

    def maybe(grams: DataFrame, texts: DataFrame, few: bool) -> DataFrame:
        return grams if few else maybe_wanted(grams, *gram_filter(texts.select(F.col(texts.columns[0]).alias("gram")), texts.count()))

    found = []
    if short:
        texts = wanted.where(size <= ANCHOR_LENGTH)
        few = is_few(texts)
        grams = maybe(_grams(cells, short), texts, few).select(F.col("gram").alias("text"))
        grams = grams if few else grams.distinct()
        found.append(grams.join(small(texts, few), "text", "left_semi"))
    if len(lengths) > len(short):
        texts = wanted.where(size > ANCHOR_LENGTH)
        few = is_few(texts)
        begins = F.substr("text", F.lit(1), F.lit(ANCHOR_LENGTH)).alias("gram")
        anchors = written(texts.groupBy(begins).agg(F.collect_set(size).alias("lengths")), "wanted-anchors")
        few_anchors = is_few(anchors)
        longest = wanted.agg(F.max(size).alias("n")).first()["n"]
        reach = max(longest, CHUNK_LENGTH)
        # a place is looked at in the chunk it begins in, which reaches as far as the longest text
        places = maybe(_grams(cells, [ANCHOR_LENGTH]), anchors, few_anchors).join(small(anchors, few_anchors), "gram")
        places = places.select(
            "cell_id",
            F.floor((F.col("position") - 1) / reach).cast("int").alias("chunk"),
            ((F.col("position") - 1) % reach + 1).cast("int").alias("begin"),
            "lengths",
        )
        # a cell_id shared by two cells only adds substrings of a cell that is published as well
        fitting = F.filter("lengths", lambda n: F.col("begin") + n - 1 <= F.length("chunk_text"))
        reached = _chunks(cells, reach, reach).select("cell_id", "chunk", F.col("text").alias("chunk_text"))
        whole = places.join(reached, ["cell_id", "chunk"]).select(
            F.explode(F.transform(fitting, lambda n: F.substr("chunk_text", F.col("begin"), n))).alias("gram")
        )
        whole = maybe(whole, texts, few).select(F.col("gram").alias("text"))
        whole = whole if few else whole.distinct()
        found.append(whole.join(small(texts, few), "text", "left_semi"))
    return reduce(DataFrame.union, found, wanted.limit(0)).distinct()


def unpublished(
    worklist: DataFrame,
    published: DataFrame,
    match: str = "substring",
    separator: str = fixed.CELL_SEPARATOR,
) -> DataFrame:
    """Worklist rows whose text is not among the published forms.

    ``substring`` hides a text that occurs anywhere inside a ``forms`` cell, ``form`` only one that is a whole entry.
    """
    if match == "substring":
        hidden = contained_texts(worklist, published.select(F.col("forms").alias("cell")))
    elif match == "form":
        hidden = published.select(F.explode(split_cell(F.col("forms"), separator)).alias("text")).distinct()
    else:
        raise ValueError(f"match must be 'substring' or 'form', not {match!r}")
    return worklist.join(hidden, "text", "left_anti").select(*worklist.columns)
