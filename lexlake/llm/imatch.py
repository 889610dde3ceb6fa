"""I-Match document fingerprints, in DataFrame functions only.

A document's terms whose document frequency lies within a band are kept, sorted and hashed; not once, but for several
random subsets of the lexicon, so that a small change leaves some of the hashes as they are. The subsets come in families,
each a chain of ever smaller subsets, so that long and short documents alike have subsets that hold few of their terms.

The lexicon is a bitmap over hash buckets of terms, of a size that does not depend on the corpus; a term is in the lexicon
if the document frequency of its bucket is within the band. Frequencies are counted over all documents and combine before
the shuffle. Documents without a term in the band are fingerprinted by all their terms.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexlake.llm.common import WORD

# the band: shares of all documents between which a term's document frequency lies, and the least number of documents
LEAST_SHARE, MOST_SHARE, LEAST_DOCUMENTS = 5e-4, 0.05, 2
# buckets of terms, a power of two; families of lexicon subsets; a subset of level k holds one term in 2^k
BUCKET_BITS = 22
FAMILIES = 10
LEVELS = (2, 4, 6, 8, 10)
# documents between two boundaries of the document order, about
RANGE_ROWS = 4_000

_FIRST = -(1 << 63)
_FAMILY_BITS = max(LEVELS)
# families that fit into the bits of a term's hash above those of its bucket; the others use a second hash of the term
_ON_FIRST = (64 - BUCKET_BITS) // _FAMILY_BITS


def term_hashes(text: Column) -> Column:
    """Distinct terms of a text as 64-bit hashes: its words in lower case."""
    found = F.split(F.lower(text), WORD.replace("^", ""))
    return F.array_distinct(F.transform(F.filter(found, lambda w: w != ""), lambda w: F.xxhash64(w)))


def _bucket(term: Column) -> Column:
    return term.bitwiseAND(F.lit((1 << BUCKET_BITS) - 1))


def lexicon(docs: DataFrame) -> str:
    """The bitmap of term buckets within the band, as a JSON list of 64-bit integers: 2^BUCKET_BITS bits in all."""
    terms = docs.select(F.explode(term_hashes(F.col("text"))).alias("term"))
    counted = terms.groupBy(_bucket(F.col("term")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    total = docs.select(F.lit(1)).count()
    low = max(LEAST_DOCUMENTS, LEAST_SHARE * total)
    high = max(low, MOST_SHARE * total)
    within = counted.where((F.col("n") >= low) & (F.col("n") <= high))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bucket").bitwiseAND(F.lit(63)).cast("int"))
    rows = within.groupBy(F.shiftright("bucket", 6).alias("place")).agg(F.bit_or(bit).alias("bits")).collect()
    words = [0] * (1 << (BUCKET_BITS - 6))
    for row in rows:
        words[row["place"]] = row["bits"]
    return json.dumps(words, separators=(",", ":"))


def _kept_terms(terms: Column, bitmap: str) -> Column:
    """Those of the terms that are in the lexicon."""
    bits = F.from_json(F.lit(bitmap), T.ArrayType(T.LongType()))  # folded into one constant by the optimizer

    def within(term: Column) -> Column:
        place = F.shiftright(_bucket(term), 6).cast("int") + 1
        return F.bit_get(F.element_at(bits, place), term.bitwiseAND(F.lit(63)).cast("int")) == 1

    return F.filter(terms, within)


def _subset(terms: str, family: int, level: int) -> Column:
    """The terms whose bits for a family begin with ``level`` zeros."""
    lowest = BUCKET_BITS + _FAMILY_BITS * family if family < _ON_FIRST else _FAMILY_BITS * (family - _ON_FIRST)
    mask = F.lit(((1 << level) - 1) << lowest)
    return F.filter(terms, lambda term: term.bitwiseAND(mask) == 0)


def with_parts(df: DataFrame, text: str, bitmap: str, name: str) -> DataFrame:
    """``df`` with an array ``name`` of the hashes of the text's lexicon subsets, NULL where a subset has none of its
    terms. Each step is a projection of its own, so that no array is made twice."""
    every, kept, again = f"{name}_all", f"{name}_kept", f"{name}_again"
    columns = df.columns
    df = df.withColumn(every, term_hashes(F.col(text)))
    df = df.withColumn(kept, F.sort_array(_kept_terms(F.col(every), bitmap)))
    df = df.withColumn(kept, F.when(F.size(kept) > 0, F.col(kept)).otherwise(F.sort_array(every)))
    df = df.withColumn(again, F.sort_array(F.transform(kept, lambda term: F.xxhash64(term))))
    subsets: dict[tuple[int, int], Column] = {}
    for level_at, level in enumerate(LEVELS):
        step = {}
        for family in range(FAMILIES):
            first = kept if family < _ON_FIRST else again
            above = first if level_at == 0 else f"{name}_{family}_{LEVELS[level_at - 1]}"
            step[f"{name}_{family}_{level}"] = _subset(above, family, level)
        df = df.withColumns(step)
        subsets |= {(family, level): F.col(f"{name}_{family}_{level}") for family in range(FAMILIES)}
    parts = [
        F.when(F.size(subset) > 0, F.xxhash64(F.lit(family), F.lit(level), subset))
        for (family, level), subset in sorted(subsets.items())
    ]
    # the first part stands for all kept terms, for texts with so few that no subset holds any
    whole = F.when(F.size(kept) > 0, F.xxhash64(F.col(kept)))
    return df.withColumn(name, F.array(whole, *parts)).select(*columns, name)


def _text_of(parts: Column) -> Column:
    """The fingerprint: eight hex digits per part, dashes for a part without terms."""
    return F.array_join(
        F.transform(parts, lambda p: F.coalesce(F.lower(F.substring(F.lpad(F.hex(p), 16, "0"), 1, 8)), F.lit("-" * 8))), ""
    )


def likeness(left: Column, right: Column) -> Column:
    """Share of the families that agree, each in the smallest of its subsets that either side has terms of.

    Where no family has any, 1 if the texts' terms are the same, else 0.
    """
    agree, known = F.lit(0), F.lit(0)
    for family in range(FAMILIES):
        equal = F.lit(None).cast("int")
        for place in range(1 + family * len(LEVELS), 1 + (family + 1) * len(LEVELS)):  # from large to small subsets
            a, b = F.get(left, F.lit(place)), F.get(right, F.lit(place))
            equal = F.when(a.isNotNull() | b.isNotNull(), a.eqNullSafe(b).cast("int")).otherwise(equal)
        agree = agree + F.coalesce(equal, F.lit(0))
        known = known + equal.isNotNull().cast("int")
    whole = F.get(left, F.lit(0)).eqNullSafe(F.get(right, F.lit(0))).cast("double")
    return F.when(known == 0, whole).otherwise(agree / known)


def with_next(df: DataFrame, keys: DataFrame, next_of: dict[str, str]) -> DataFrame:
    """Columns of the row that follows in ascending (key, tie) order; the first follows the last.

    Rows are dealt out by ranges of keys, with boundaries taken from the keys themselves. The first rows of a range also go
    to the range before it as guests, so that every range knows what follows its last row. ``keys`` has the keys alone.
    """
    summary = keys.agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low")).first()
    ranges = max(1, -(-summary["n"] // RANGE_ROWS))
    bounds = [summary["low"]] if summary["n"] else [0]
    if ranges > 1:
        points = [i / ranges for i in range(1, ranges)]
        found = keys.agg(F.percentile_approx("key", points, min(100 * ranges, 1_000_000)).alias("p")).first()["p"]
        bounds = sorted({*bounds, *found})
    # the range of a key is the number of boundaries up to it, less one, found by halving
    limits = F.from_json(F.lit(json.dumps(bounds)), T.ArrayType(T.LongType()))
    at = F.lit(0)
    step = 1 << (len(bounds) - 1).bit_length() >> 1
    out = df
    name = "range"
    out = out.withColumn(name, at)
    while step:
        probe = F.col(name) + step
        out = out.withColumn(
            name,
            F.when((probe < len(bounds)) & (F.get(limits, probe) <= F.col("key")), probe).otherwise(F.col(name)),
        )
        step >>= 1
    first = F.get(limits, F.col(name)) == F.col("key")
    own = F.struct(F.col(name).alias("range"), F.lit(False).alias("guest"))
    before = F.struct(F.pmod(F.col(name) - 1, F.lit(len(bounds))).alias("range"), F.lit(True).alias("guest"))
    out = out.withColumn("place", F.explode(F.when(first, F.array(own, before)).otherwise(F.array(own))))
    out = out.withColumn(name, F.col("place.range")).withColumn("guest", F.col("place.guest")).drop("place")
    follows = Window.partitionBy(name).orderBy("guest", "key", "tie")
    out = out.withColumns({new: F.lead(old).over(follows) for old, new in next_of.items()})
    return out.where(~F.col("guest")).drop("guest", name)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row of ``docs``.

    A NULL text counts as empty. Documents follow one another in ascending doc_id order, rows without an id first, rows of
    one id in the order of their text's hash; the first follows the last, and a single row follows itself. The edited text
    has the row's last floor(n/2) characters replaced by as many from the start of the next row's text, or all it has.
    Equal texts have equal fingerprints; a text without words has one of dashes, alike only to its kind.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bitmap = lexicon(docs)
    keyed = docs.withColumns(
        {"key": F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)), "tie": F.xxhash64("text")}
    )
    # the texts' own fingerprints are made before the shuffle and travel with them
    own = with_parts(keyed, "text", bitmap, "parts")
    chained = with_next(own, keyed.select("key"), {"text": "next_text", "parts": "next_parts"})
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.char_length("text") - half),
        F.substring(F.col("next_text"), F.lit(1), half),
    )
    edited_rows = chained.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        edited.alias("edited"),
        "parts",
        "next_parts",
    )
    done = with_parts(edited_rows, "edited", bitmap, "edited_parts")
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        _text_of(F.col("parts")).alias("fingerprint"),
        _text_of(F.col("edited_parts")).alias("edited_fingerprint"),
        likeness(F.col("parts"), F.col("edited_parts")).alias("near_edited"),
        likeness(F.col("parts"), F.col("next_parts")).alias("near_next"),
    )
