"""Spelling variants: words that differ by one inserted, deleted or replaced letter, found on a distributed trie.

The trie is a table of edges (node, letter) -> child. A walk is a row (word, position, node, edits). Walks without an edit
are the word's own path; at each node a walk may take its one edit, replacing the next letter by another edge's or leaving
it out, and then has to follow its own letters. Level by level the walks are joined with the edges; one that arrives at an
end with one edit has found a near word.

Three choices keep the frontier small and lose nothing:

* There is one trie per word length. A replacement walks the trie of the word's own length, a deletion that of the next
  shorter one; insertions are deletions seen from the other word.
* Either the edit lies in a word's second half, and the first half is shared, or it lies in the first half, and the second
  is. So walks start at the node of half the word, in a trie of words and in one of reversed words; no walk spreads out at
  the crowded nodes near a root.
* An edge below which there is one word only names it. A walk that takes it ends there: its edited word is that word or none.

Nodes are 64-bit hashes of (direction, length, prefix). Equal hashes of different prefixes would only let walks live longer,
as an end is accepted when the words are equal letter by letter. After the edit a walk also takes edges of 8 and 64 letters
where its word goes on that far, so that long words with long common parts need few rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.session import written

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 6, 5
# a form occurs this many times as often as its variant
FORM_RATIO = 5
# runs whose crc32 this divides lose a letter
DAMAGED = 199
STRIDES = (64, 8, 1)

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def damaged_runs(docs: DataFrame) -> DataFrame:
    """(word): the runs of letters of all texts in lower case, some with a letter left out as their hash tells.

    A NULL text has no runs, a NULL doc_id is hashed as no digits.
    """
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(doc_id.alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), 0)).alias("run"))
    runs = runs.select("id", F.translate("run", _UPPER, _UPPER.lower()).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    return runs.select(F.when(h % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word"))


def counted_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough; counted on the map side first."""
    runs = damaged_runs(docs).where(F.char_length("word") >= least_length)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _part(text: str, start: Column, length: Column) -> Column:
    """``length`` letters from position ``start``, counted from 0."""
    return F.substring(F.col(text), (start + 1).cast("int"), length.cast("int"))


def _node(length: Column, prefix: Column) -> Column:
    return F.xxhash64("backward", length.cast("int"), prefix)


def _both_ways(words: DataFrame) -> DataFrame:
    """Every word as it is and reversed: (backward, word, n, length, half); ``half`` letters are left as they are.

    A direction in which no other word shares the half is left out, so that lone words, long ones above all, cost no walk.
    """
    length = F.char_length("word")
    forward = words.select(F.lit(False).alias("backward"), "word", "n", length.alias("length"))
    backward = words.select(F.lit(True).alias("backward"), F.reverse("word").alias("word"), "n", length.alias("length"))
    both = forward.unionByName(backward).withColumn("half", _half(F.col("length")))
    # where the word's own walks start, and where those of a word one letter longer would meet it
    starts = [_node(n, _part("word", F.lit(0), _half(n))) for n in (F.col("length"), F.col("length") + 1)]
    both = both.withColumn("starts", F.array(*starts))
    shared = both.select(F.explode("starts").alias("start")).groupBy("start").agg(F.count(F.lit(1)).alias("words"))
    shared = shared.where("words > 1").select("start")
    meeting = both.select("backward", "word", F.explode("starts").alias("start")).join(shared, "start", "left_semi")
    return both.drop("starts").join(meeting.select("backward", "word").distinct(), ["backward", "word"], "left_semi")


def _half(length: Column) -> Column:
    shared = F.floor(length / 2)
    return F.when(F.col("backward"), length - shared).otherwise(shared).cast("int")


def trie_edges(both: DataFrame) -> DataFrame:
    """(node, letters, child, words, only, only_n): edges of the halves that walks can reach, by strides of letters.

    ``only`` is the one word below an edge, where there is one. An empty label ends a word.
    """

    def by(stride: int) -> DataFrame:
        at = F.sequence(F.col("half"), F.col("length") - (0 if stride == 1 else stride))
        enough = F.lit(True) if stride == 1 else F.col("length") - F.col("half") >= stride
        steps = both.where(enough).select("*", F.explode(at).alias("at"))
        end = F.least(F.col("at") + stride, F.col("length"))
        return steps.select(
            _node(F.col("length"), _part("word", F.lit(0), F.col("at"))).alias("node"),
            _part("word", F.col("at"), F.lit(stride)).alias("letters"),
            _node(F.col("length"), _part("word", F.lit(0), end)).alias("child"),
            "word",
            "n",
        )

    steps = reduce(DataFrame.unionByName, [by(s) for s in STRIDES])
    edges = steps.groupBy("node", "letters").agg(
        F.min("child").alias("child"),
        F.count(F.lit(1)).alias("words"),
        F.min("word").alias("only"),
        F.min("n").alias("only_n"),
    )
    single = F.col("words") == 1
    return edges.select(
        "node", "letters", "child", "words", *[F.when(single, F.col(c)).alias(c) for c in ("only", "only_n")]
    )


def _first_edits(both: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Walks that have just taken their edit: (replacements, already on an edge; deletions, still at a node)."""
    own = both.select("*", F.explode(F.sequence(F.col("half"), F.col("length") - 1)).alias("at"))
    before = _part("word", F.lit(0), F.col("at"))
    after = _part("word", F.col("at") + 1, F.col("length"))
    paths = own.select(
        "backward", "word", "n", "length", _part("word", F.col("at"), F.lit(1)).alias("letter"),
        before.alias("before"), after.alias("after"), "at",
        _node(F.col("length"), before).alias("place"),
    )
    letters = edges.where(F.char_length("letters") == 1)
    # the other word replaces the other way round, so one of the two is enough
    replaced = paths.join(letters, (F.col("place") == F.col("node")) & (F.col("letters") > F.col("letter"))).select(
        "backward", "word", F.col("n").alias("word_n"), F.concat("before", "letters", "after").alias("edited"),
        (F.col("at") + 1).alias("at"), "child", "words", "only", "only_n",
    )
    deleted = own.select(
        "backward", "word", F.col("n").alias("word_n"), F.concat(before, after).alias("edited"), "at",
        _node(F.col("length") - 1, before).alias("place"),
    )
    return replaced, deleted


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) for every ordered pair of distinct words that one edit turns into each other.

    ``words`` holds distinct words and their counts. Each round is written to the shared folder.
    """
    both = written(_both_ways(words), "spelling-words")
    edges = written(trie_edges(both), "spelling-edges")
    taken, waiting = _first_edits(both, edges)
    found = []
    while True:
        taken = written(taken, "spelling-walks")
        ends = F.col("only") == F.col("edited")
        found.append(taken.where(ends).select("backward", "word", "word_n", F.col("only").alias("near"), "only_n"))
        going = taken.where("words > 1").select("backward", "word", "word_n", "edited", "at", F.col("child").alias("place"))
        walks = going if waiting is None else going.unionByName(waiting)
        if waiting is None and walks.isEmpty():
            break
        taken, waiting = _next_level(walks, edges), None
    pairs = reduce(DataFrame.unionByName, found)
    shown = [F.when(F.col("backward"), F.reverse(c)).otherwise(F.col(c)).alias(c) for c in ("word", "near")]
    pairs = pairs.select(shown[0], F.col("word_n").alias("n"), shown[1], F.col("only_n").alias("near_n"))
    other = pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.unionByName(other).distinct()


def _next_level(walks: DataFrame, edges: DataFrame) -> DataFrame:
    """Walks after the longest stride that their words leave room for; those without such an edge end."""
    left = F.char_length("edited") - F.col("at")
    stride = reduce(lambda other, s: F.when(left >= s, F.lit(s)).otherwise(other), reversed(STRIDES[:-1]), F.lit(1))
    step = walks.withColumn("label", _part("edited", F.col("at"), stride))
    return step.join(edges, (F.col("place") == F.col("node")) & (F.col("label") == F.col("letters"))).select(
        "backward", "word", "word_n", "edited", (F.col("at") + F.char_length("letters")).alias("at"),
        "child", "words", "only", "only_n",
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) by following (word, form) to the end; every step doubles the way gone. Counts rise, so it ends."""
    reached = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = reached.select(F.col("word").alias("from"), F.col("root").alias("further"))
        step = reached.join(onward, F.col("root") == F.col("from"), "left").withColumn("moved", F.col("further").isNotNull())
        step = written(step.select("word", F.coalesce("further", "root").alias("root"), "moved"), "spelling-roots")
        reached = step.select("word", "root")
        if step.where("moved").isEmpty():
            return reached


def spelling_variants(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = FORM_RATIO
) -> DataFrame:
    """One row per word of ``docs`` (doc_id, text): word, form, root, n, n_near, form_n.

    A word's form is its most frequent near word (ties: first in code-point order) if that is at least ``ratio`` times as
    frequent; its root is the last of the forms that follow from it. Texts that are NULL, empty or without letters give
    nothing, repeated rows count as often as they come, an empty table gives no row, other columns are not looked at.
    """
    words = written(counted_words(docs, least_length, least_count), "spelling-counted")
    near = near_pairs(words)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    per_word = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    found = words.join(per_word, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"),
    )
    often = F.col("form_n") >= ratio * F.col("n")
    found = found.withColumns({c: F.when(often, F.col(c)) for c in ("form", "form_n")})
    found = written(found, "spelling-forms")
    roots = _roots(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
