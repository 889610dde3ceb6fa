"""Spelling variants against a brute-force search of all pairs of words."""

import re
import zlib
from collections import Counter, defaultdict

import pytest

from lexlake.llm import spelling_trie
from tests.llm.conftest import doc

SF = "/root/testdata/sf0.001"


def expected(docs, length=6, count=5):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= length and n >= count}
    near = defaultdict(set)
    cut = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            cut[i, shorter].add(w)
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in cut.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 5 * n:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = expected((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert found(spelling_trie.spelling_variants(docs)) == want
    assert any(form for form, *_ in want.values())


# every place of an edit, letters that repeat, chains of forms, long words that share long parts
WORDS = {
    "letter": 1000, "leter": 5, "lettar": 190, "lattar": 36, "lattare": 5, "letters": 125, "xetter": 24, "ettter": 5,
    "banana": 30, "bananaa": 6, "banaana": 6, "bbanana": 6, "ananab": 6, "bananas": 6, "banan": 99, "canana": 6,
    "àéîõüÿ": 25, "àéîõü": 5, "aéîõüÿ": 5, "ÀÉÎÕÜŸ": 9, "same11": 9, "aaaaaa": 7, "aaaaaaa": 7, "aaaaaaaa": 40,
    "q" * 300: 50, "q" * 299: 7, "q" * 150 + "z" + "q" * 149: 6, "z" + "q" * 299: 6, "q" * 299 + "z": 6,
    "q" * 301: 6, "q" * 302: 5,
}


def test_kinds_of_edits(spark, make_docs):
    rows = [doc(i % 7, f"{w} {w.upper()}" if i % 2 else f"{w}, {w}!") for w, n in WORDS.items() for i in range((n + 1) // 2)]
    docs = make_docs(rows, True)
    want = expected((r[0], r[1]) for r in rows)
    got = found(spelling_trie.spelling_variants(docs))
    assert got == want
    assert got["lattare"][1] == "letter" and got["q" * 302][3] == 1 and got["àéîõüÿ"][3] == 1


def test_many_words_below_one_node(spark, make_docs):
    letters = "abcdefghijklmnopqrst"
    many = [f"common{a}{b}" for a in letters for b in letters]
    rows = [doc(k, " ".join(many)) for k in range(6)]
    want = expected((r[0], r[1]) for r in rows)
    assert found(spelling_trie.spelling_variants(make_docs(rows))) == want


@pytest.mark.parametrize("clashing", [False, True])
def test_awkward_rows(spark, make_docs, awkward, clashing):
    rows = awkward * 5
    docs = make_docs(rows, clashing)
    assert found(spelling_trie.spelling_variants(docs)) == expected((r[0], r[1]) for r in rows)
    assert spelling_trie.spelling_variants(make_docs([], clashing)).collect() == []
    nothing = [doc(1, None), doc(2, "") , doc(3, "12 34")]
    assert spelling_trie.spelling_variants(make_docs(nothing, clashing)).collect() == []
