"""SimHash by anchor covering and components against brute force."""

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lexlake.llm import near_copies
from lexlake.llm import simhash_anchors as sim
from lexlake.llm.links import components, forest


def brute_components(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_forest_joins_what_links_join():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 300, 260), rng.integers(0, 300, 260)
    left, right = forest(a, b)
    want = brute_components(zip(a.tolist(), b.tolist()))
    assert {x: r for x, r in want.items() if x != r} == dict(zip(left.tolist(), right.tolist()))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(1000, i) for i in range(900, 960)] + [(5, 5), (7, 6)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "t").collect()}
    want = brute_components((a, b) for a, b in links)
    assert found == want


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "t").collect() == []


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            found += [word] if word else []
            word = ""
        else:
            word += c
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(max(len(found) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", None, " \n", "One", "one two", "a b c", "a B c d a b c", "é É x y\x1cz w"])
def test_fingerprint(text):
    assert sim.fingerprint(text) == plain_fingerprint(text)


def test_pairs_within_the_distance_meet_at_a_home():
    rng = np.random.default_rng(3)
    for _ in range(100):
        f = int(rng.integers(0, 1 << 63))
        g = f
        for b in rng.choice(64, 3, replace=False):
            g ^= 1 << int(b)
        prints = np.array([f, g], dtype=np.uint64).view(np.int64)
        row, name = sim.first_anchors(prints)
        excess = sim.excess_of(prints[row], name)
        at, second, home = sim.second_anchors(prints[row], excess)
        places = list(zip(row[at].tolist(), name[at].tolist(), second.tolist(), home.tolist()))
        homes = {(a, b) for r, a, b, h in places if r == 0 and h}
        assert len(homes) == 1
        assert homes <= {(a, b) for r, a, b, _ in places if r == 1}


@pytest.mark.parametrize("block", [4096, 5])
def test_groups_equal_brute_force(spark, block):
    rng = np.random.default_rng(0)
    prints = set(rng.integers(0, 1 << 63, 20).tolist())
    for base in list(prints)[:6]:
        for _ in range(30):
            near = base
            for b in rng.choice(63, rng.integers(0, 6), replace=False):
                near ^= 1 << int(b)
            prints.add(near)
    prints = sorted(prints)
    pairs = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 3]
    df = spark.createDataFrame([(p,) for p in prints], "print long")
    found = {r.node: r.root for r in components(sim.near_links(df, block), "t").collect()}
    assert found == brute_components(pairs)


def test_near_duplicates_of_awkward_rows(make_docs, awkward):
    rows = [(r.doc_id, r.fingerprint, r.component_id) for r in sim.near_duplicates(make_docs(awkward, True)).collect()]
    assert sorted(r[0] for r in rows if r[0]) == sorted(r[0] for r in awkward if r[0])
    assert len(rows) == len(awkward)
    by_id = {r[0]: r for r in rows if r[0] is not None}
    assert by_id[1][1] == by_id[5][1] == f"{plain_fingerprint(awkward[0][1]):016x}"
    assert by_id[5][2] == 1
    # texts without words share fingerprint zero; 2 is the smallest id among them
    assert {by_id[i][1:] for i in (2, 3, 6)} == {("0" * 16, 2)}
    assert {r[2] for r in rows if r[0] is None and r[1] != "0" * 16} == {None}
    assert sim.near_duplicates(make_docs([])).collect() == []


def test_one_row_of_each_group_stays(make_docs, awkward):
    docs = make_docs(awkward, True)
    kept = sim.representatives(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 2, 4, 7, 8, 9]
    assert [r.text for r in rows if r.doc_id is None] == ["no id, one"]
    assert all(r.print == "own print" for r in rows)
    assert sim.representatives(make_docs([])).collect() == []


def test_repeated_rows_leave_one(make_docs):
    rows = sim.representatives(make_docs([(6, "same text here", "en", "a", 1)] * 5)).collect()
    assert len(rows) == 1


def edited(rng, found, edits):
    out = list(found)
    for at in rng.choice(len(out), edits, replace=False):
        out[at] = f"new{rng.integers(1 << 40)}"
    return out


def test_near_copies_meet_at_similarity_08(make_docs):
    rng = np.random.default_rng(7)
    rows, similar = [], []
    for i, (length, edits) in enumerate([(100, 2), (300, 6), (1000, 20), (100, 6)] * 30):
        found = [f"w{rng.integers(1 << 40)}" for _ in range(length)]
        texts = [" ".join(found), " ".join(edited(rng, found, edits))]
        rows += [(2 * i + k, text, "en", "a", len(text)) for k, text in enumerate(texts)]
        a, b = ({tuple(t.split()[j : j + 5]) for j in range(length - 4)} for t in texts)
        similar.append(len(a & b) / len(a | b) >= 0.8)
    kept = {r.doc_id for r in sim.representatives(make_docs(rows)).collect()}
    dropped = [2 * i + 1 not in kept for i in range(len(similar))]
    assert all(2 * i in kept for i in range(len(similar)))
    assert sum(similar) >= 60 and not all(similar)
    assert not any(d and not s for d, s in zip(dropped, similar, strict=True))
    assert sum(dropped) >= 0.97 * sum(similar)


def test_a_large_group_of_near_copies_leaves_one(make_docs):
    rng = np.random.default_rng(8)
    found = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(edited(rng, found, 1)), "en", "a", 1) for i in range(300)]
    assert [r.doc_id for r in sim.representatives(make_docs(rows)).collect()] == [0]


def test_near_copies_are_found_by_anchors(make_docs, monkeypatch):
    rng = np.random.default_rng(9)
    found = [f"w{rng.integers(1 << 40)}" for _ in range(200)]
    docs = make_docs([(i, " ".join(edited(rng, found, i)), "en", "a", 1) for i in range(3)])
    assert [r.doc_id for r in sim.representatives(docs).collect()] == [0]
    # without anchors nothing meets
    monkeypatch.setattr(near_copies, "anchor_sets", lambda n: np.empty((0, 23), np.int64))
    assert sorted(r.doc_id for r in sim.representatives(docs).collect()) == [0, 1, 2]


def test_merged_links_are_one_per_node(monkeypatch):
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 500, 3_000), rng.integers(0, 20, 3_000)
    batches = [pa.RecordBatch.from_arrays([pa.array(a[i::7]), pa.array(b[i::7])], names=["a", "b"]) for i in range(7)]
    want = brute_components(zip(a.tolist(), b.tolist()))
    for links in (near_copies.LINKS, 100):
        monkeypatch.setattr(near_copies, "LINKS", links)
        [got] = near_copies._merged(iter(batches))
        pairs = list(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True))
        assert len({x for x, _ in pairs}) == len(pairs) and all(want[x] == y for x, y in pairs)
        assert {x for x, _ in pairs} == {x for x, y in want.items() if x != y}


def test_sketches_are_majorities_of_bits():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 300, 20_000):
        hashes = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        mixed = hashes[:, None] ^ near_copies._SALTS.T
        mixed = (mixed ^ mixed >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ mixed >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        mixed = (mixed ^ mixed >> np.uint64(31)).astype("<u8")
        bits = np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").astype(int)
        ones = 2 * bits.sum(axis=0)
        want = (ones > n) | ((ones == n) & (bits[0] == 1))
        assert near_copies.sketch(hashes) == np.packbits(want, bitorder="little").tobytes()


def test_sketches_at_a_home_meet_if_near(monkeypatch):
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << 63, (40, near_copies.COMPARED), dtype=np.uint64)
    prints = np.repeat(prints, 3, axis=0) ^ (np.uint64(1) << rng.integers(0, 64, (120, 2), dtype=np.uint64))
    unit = np.sort(rng.integers(0, 4, 120))
    near = near_copies.far(prints[:, None], prints[None]) <= near_copies.FAR
    a, b = np.nonzero(near & (unit[:, None] == unit[None]))
    want = sorted(zip(*(x.tolist() for x in forest(a, b)), strict=True))
    for crowd in (near_copies.CROWD, 1):
        monkeypatch.setattr(near_copies, "CROWD", crowd)
        got = forest(*near_copies.met(unit, prints))
        assert sorted(zip(*(x.tolist() for x in got), strict=True)) == want
    assert len(near_copies.anchor_sets(1 << 24)[0]) == 23 + 12 and len(near_copies.anchor_sets(10)[0]) == 23


def test_unrelated_sketches_are_no_candidates():
    """Sketches of unrelated sets that share a home often agree in most of 128 bits by chance; near ones are found."""
    rng = np.random.default_rng(8)
    raw = rng.integers(0, 256, (20_000, 8 * near_copies.WORDS), dtype=np.uint8)
    raw[-1] = raw[5]
    raw[-1, :10] ^= 4
    rows = pa.RecordBatch.from_pydict({"node": np.arange(len(raw)), "sketch": [r.tobytes() for r in raw]})
    dealt = pa.Table.from_batches(near_copies._dealt(near_copies.anchor_sets(len(raw)))(iter([rows]))).sort_by("unit")
    links = pa.Table.from_batches(near_copies._met(iter(dealt.combine_chunks().to_batches())))
    assert set(zip(*(links[c].to_pylist() for c in "ab"), strict=True)) == {(len(raw) - 1, 5)}
