"""Phrases against a count of every contiguous run of words."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexlake.llm import stripes
from tests.llm.conftest import doc


def pieces(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", lower)]


def expected(rows, least=10, top=2000):
    found = {}
    for lang, text in rows:
        counts = found.setdefault("und" if lang is None else lang, [Counter(), Counter(), Counter()])
        for words in pieces(text):
            for size in (1, 2, 3):
                counts[size - 1].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in found.items():
        f = {k: v for c in counts for k, v in c.items()}
        candidates = {k: v for k, v in f.items() if len(k) > 1 and v >= least}
        ranked = []
        for k, a in candidates.items():
            longer = [v for p, v in candidates.items() if len(p) > len(k) and k in (p[:2], p[1:])]
            if any(100 * v >= 50 * a for v in longer):
                continue
            score, _, l, r = min((1_000_000 * a * a // (f[k[:i]] * f[k[i:]]), i, f[k[:i]], f[k[i:]]) for i in range(1, len(k)))
            ranked.append((-score, -a, " ".join(k).encode(), l, r))
        n = sum(counts[0].values())
        for rank, (score, a, phrase, l, r) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


SENTENCES = [
    ("the cat sat on the mat, the cat sat. New York is new york", "en"),
    ("On the mat the cat sat! on the\tmat", "en"),
    ("le chat est sur le tapis; le chat est là", "fr"),
    ("a a a a a a", "en"),
    ("naïve Über naïve Über ÜBER", None),
    ("x y z x y z", "und"),
    ("one two\nthree four one two three", ""),
]


def rows_of(copies=7):
    return [(i % 9, text, lang, "web", len(text)) for i in range(copies) for text, lang in SENTENCES]


@pytest.mark.parametrize("clashing", [False, True])
def test_small_corpus(spark, make_docs, awkward, clashing):
    rows = rows_of() + [(r[0], r[1], r[2], r[3], r[4]) for r in awkward * 3]
    got = found(stripes.collocations(make_docs(rows, clashing)))
    assert got == expected((r[2], r[1]) for r in rows)
    assert {r[0] for r in got} >= {"en", "fr", "und", ""}
    assert found(stripes.collocations(make_docs(rows, clashing), least_count=4, top=3)) == expected(((r[2], r[1]) for r in rows), 4, 3)


def test_no_phrases(spark, make_docs):
    assert stripes.collocations(make_docs([])).collect() == []
    assert stripes.collocations(make_docs([doc(1, None), doc(2, ""), doc(3, "..."), doc(4, "once only")])).collect() == []


def test_cuts_and_blocks_change_nothing(spark, make_docs):
    docs = make_docs(rows_of(3)).repartition(2)

    def sums(frequent, size):
        rows = stripes.task_stripes(docs, frequent, size)
        entries = stripes.entries(rows)
        parts = entries.agg(F.max(F.when(F.col("first") != "", F.col("part")))).first()[0]
        added = entries.groupBy("lang", "first", "next").agg(F.sum("n").alias("n"))
        return {tuple(r) for r in added.collect()}, parts

    plain, no_parts = sums(set(), stripes.BLOCK)
    cut, parts = sums({("en", "a"), ("en", "the"), ("fr", "absent")}, 5)
    assert plain == cut and no_parts == 0 and parts > 0
    assert {("en", "the", "cat", 9), ("en", "the", "cat sat", 9)} <= plain


def test_a_stripe_crosses_the_shuffle_once(spark, make_docs):
    plan = stripes.merged_stripes(make_docs(rows_of(1)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
