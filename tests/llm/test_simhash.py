import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pagemill.llm import simhash
from pagemill.llm.common import numbered


def plain_print(text):
    """The fingerprint of one text, word by word."""
    found = Counter(w for w in re.split(r"[\W_]+", text.lower()) if w)
    ones = np.zeros(simhash.BITS, int)
    for w, n in found.items():
        raw = b"".join(xxhash.xxh3_128_digest(w, s) for s in range(simhash.BITS // 128))
        ones += n.bit_length() * min(len(w), simhash.LETTERS) * np.unpackbits(np.frombuffer(raw, np.uint8))
    return (2 * ones > sum(n.bit_length() * min(len(w), simhash.LETTERS) for w, n in found.items())) if found else None


def groups(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in parent if find(x) != x}


def brute(texts):
    prints = {i: p for i, t in texts.items() if t is not None and (p := plain_print(t)) is not None}
    ids = sorted(prints)
    m = np.array([prints[i] for i in ids]).astype(int)
    far = m @ (1 - m).T
    far = far + far.T
    return {(ids[a], ids[b]): int(far[a, b]) for a in range(len(ids)) for b in range(a + 1, len(ids)) if far[a, b] <= simhash.DISTANCE}


def test_fingerprints_equal_plain_ones():
    texts = ["the cat sat on the mat", "A a a", "", None, "...", "naïve Ünicode 漢字 words 12", " ".join(f"w{i % 30000} the" for i in range(90_000))]
    got, full = simhash.fingerprints(pa.array(texts))
    for t, row, f in zip(texts, got, full):
        want = plain_print(t or "")
        assert f == (want is not None)
        if f:
            assert (np.unpackbits(row.view(np.uint8)) == want).all()


def edited(rng, words, rate, vocabulary):
    return [rng.choice(vocabulary) if rng.random() < rate else w for w in words]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(6000)]
    texts, i = {}, 0
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 300))]
        for rate in (0, 0, 0.02, 0.05, 0.08):
            texts[i] = " ".join(edited(rng, base, rate, vocabulary))
            i += 1
    for _ in range(300):
        texts[i] = " ".join(rng.choice(vocabulary) for _ in range(100))
        i += 1
    return texts


def found_links(make_docs, texts):
    """Links between the documents that are the first of their fingerprint, and those documents."""
    docs = make_docs([(i, t, "x", "y") for i, t in texts.items()])
    nodes = numbered(simhash.prints(docs).groupBy(*simhash._F).agg(F.min("id").alias("id")), "nodes")
    name = {r.node: r.id for r in nodes.collect()}
    return [tuple(sorted((name[r.a], name[r.b]))) for r in simhash.near_links(nodes).collect()], set(name.values())


@pytest.mark.parametrize("part", [simhash.PART, 2])
def test_links_against_brute_force(spark, make_docs, corpus, monkeypatch, part):
    """With runs of one key whole, and cut into parts."""
    monkeypatch.setattr(simhash, "PART", part)
    links, firsts = found_links(make_docs, corpus)
    want = {p: d for p, d in brute(corpus).items() if firsts.issuperset(p)}
    assert set(links) <= set(want)
    root = groups(links)
    joined = {p for p in want if root.get(p[0], p[0]) == root.get(p[1], p[1])}
    assert {p for p, d in want.items() if d <= 26} <= joined
    assert len(joined) >= 0.98 * len(want)


def flipped(rng, row, k):
    bits = np.unpackbits(row.view(np.uint8))
    bits[rng.choice(simhash.BITS, k, replace=False)] ^= 1
    return np.packbits(bits).view(np.int64)


def test_recall_of_lone_pairs_near_the_limit(spark):
    """Pairs without a third fingerprint that could join them, by distance: as many as the counts in the docstring say."""
    rng, rows, at = np.random.default_rng(6), [], {}
    for k in (20, 26, 32, 36, 40, 41):
        for _ in range(300):
            one = rng.integers(-(2**63), 2**63, simhash.BITS // 64, dtype=np.int64)
            at[len(rows)] = k
            rows += [[len(rows), *one.tolist()], [len(rows) + 1, *flipped(rng, one, k).tolist()]]
    nodes = spark.createDataFrame(rows, ["node", *simhash._F])
    links = {(r.a, r.b) for r in simhash.near_links(nodes).collect()}
    assert links <= {(i, i + 1) for i in at}
    share = {k: sum(at[a] == k for a, _ in links) / 300 for k in set(at.values())}
    assert share[20] == share[26] == 1 and share[32] >= 0.97 and share[36] >= 0.9 and share[40] >= 0.75 and share[41] == 0


def lone_pairs(rng, far, times):
    """Pairs (2 i, 2 i + 1) of fingerprints at each distance of ``far``, ``times`` of each, as rows, and their distances."""
    rows, at = [], {}
    for k in far:
        for _ in range(times):
            one = rng.integers(-(2**63), 2**63, simhash.BITS // 64, dtype=np.int64)
            at[len(rows)] = k
            rows += [[len(rows), *one.tolist()], [len(rows) + 1, *flipped(rng, one, k).tolist()]]
    return rows, at


@pytest.mark.parametrize(("wide", "cell"), [(simhash.WIDE, simhash.CELL), (0, simhash.CELL), (simhash.WIDE, 900), (0, 900)])
def test_no_pair_up_to_the_limit_is_left_out(spark, monkeypatch, wide, cell):
    """By segments at distance 1 and at 2, with whole tables and with cells of leading bits."""
    monkeypatch.setattr(simhash, "WIDE", wide)
    monkeypatch.setattr(simhash, "CELL", cell)
    rows, at = lone_pairs(np.random.default_rng(7), range(27, 43), 100)
    links = {(r.a, r.b) for r in simhash.near_links(spark.createDataFrame(rows, ["node", *simhash._F])).collect()}
    assert links == {(i, i + 1) for i, k in at.items() if k <= simhash.DISTANCE}


def test_a_pair_is_found_however_its_bits_lie(spark):
    """Bits that differ all in one place, evenly spread, or as many in each segment as there can be."""
    rng, rows = np.random.default_rng(8), []
    for places in (range(40), range(216, 256), range(0, 240, 6), [*range(0, 256, 13), *range(1, 256, 13)], range(108, 148)):
        one = rng.integers(-(2**63), 2**63, simhash.BITS // 64, dtype=np.int64)
        bits = np.unpackbits(one.view(np.uint8), bitorder="little")
        bits[list(places)[:40]] ^= 1
        rows += [[len(rows), *one.tolist()], [len(rows) + 1, *np.packbits(bits, bitorder="little").view(np.int64).tolist()]]
    links = {(r.a, r.b) for r in simhash.near_links(spark.createDataFrame(rows, ["node", *simhash._F])).collect()}
    assert links == {(i, i + 1) for i in range(0, len(rows), 2)}


def test_a_crowded_bucket_is_searched_whole(spark):
    """Fingerprints that all share a segment and more, with pairs among them and none else near."""
    rng = np.random.default_rng(9)
    rows, at = lone_pairs(rng, [38, 40], 600)
    shared = rng.integers(0, 2**40)
    for row in rows:
        row[1] = row[1] >> 40 << 40 | int(shared)
    prints = np.array([row[1:] for row in rows]).view(np.uint64)
    far = {i: int(np.bitwise_count(prints[i] ^ prints[i + 1]).sum()) for i in at}
    assert max(far.values()) <= simhash.DISTANCE
    links = {(r.a, r.b) for r in simhash.near_links(spark.createDataFrame(rows, ["node", *simhash._F])).collect()}
    assert links == {(i, i + 1) for i in at}


def test_a_large_group_makes_few_links(spark, make_docs):
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = {i: " ".join(edited(rng, base, 0.03, ["other", "words", "here", "now"])) for i in range(400)}
    links, firsts = found_links(make_docs, texts)
    assert len(groups(links)) >= len(firsts) - 5 and len(links) < 400 * 4
    tree = simhash._tree(np.arange(4), np.array([[0], [1], [3], [2**40 - 1]], np.uint64), 1)
    assert sorted(zip(np.concatenate(tree[0]).tolist(), np.concatenate(tree[1]).tolist())) == [(0, 1), (1, 2)]


@pytest.mark.parametrize("part", [simhash.PART, 7])
def test_links_are_counted_exactly(spark, make_docs, corpus, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    degree = Counter(i for p in brute(corpus) for i in p)
    got = {r.doc_id: r.n_links for r in simhash.duplicates(make_docs([(i, t, "x", "y") for i, t in corpus.items()])).collect()}
    assert all(n <= degree[i] for i, n in got.items()) and sum(got[i] == degree[i] for i in got) >= 0.98 * len(got)


def test_duplicates_group_copies_and_leave_others(spark, make_docs, corpus):
    got = {r.doc_id: r.duplicate_of for r in simhash.duplicates(make_docs([(i, t, "x", "y") for i, t in corpus.items()])).collect()}
    want = groups(brute(corpus))
    assert len(set(got.items()) & set(want.items())) >= 0.98 * len(want)
    assert all(d < 300 and d // 5 == r // 5 for d, r in got.items())


def test_odd_rows(spark, odd_docs, no_docs):
    got = {tuple(r) for r in simhash.duplicates(odd_docs).collect()}
    assert got == {(9, -3, 1), (5, 4, 1)}
    kept = sorted(simhash.keep_one(odd_docs).select("doc_id").collect(), key=str)
    assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, [1, 1, 2, 3, None, None, 4, 6, 7, 7, 8, -3]))
    assert simhash.keep_one(odd_docs).columns == odd_docs.columns
    assert simhash.duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0


def test_one_id_with_two_texts_links_their_groups(spark, make_docs):
    a, b = " ".join(f"alpha{i}" for i in range(50)), " ".join(f"beta{i}" for i in range(50))
    got = simhash.duplicates(make_docs([(1, a, "x", "y"), (2, a, "x", "y"), (2, b, "x", "y"), (3, b, "x", "y")])).collect()
    assert {tuple(r) for r in got} == {(2, 1, 2), (3, 1, 1)}


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pairs = brute(texts)
    want, degree = groups(pairs), Counter(i for p in pairs for i in p)
    got = {r.doc_id: (r.duplicate_of, r.n_links) for r in simhash.query(spark, sf).collect()}
    assert len(set(got) ^ set(want)) <= 0.01 * len(want)
    assert sum(got.get(i) == (r, degree[i]) for i, r in want.items()) >= 0.99 * len(want)


def test_links_and_groups_equal_those_of_brute_force(spark, make_docs, corpus):
    """Every document, group and number of links, on texts edited so much that many pairs lie near the limit."""
    rng = random.Random(12)
    vocabulary = sorted({w for t in corpus.values() for w in t.split()})
    texts = dict(enumerate(corpus.values()))
    for _ in range(150):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 200))]
        for rate in (0, 0.1):
            texts[len(texts)] = " ".join(edited(rng, base, rate, vocabulary))
    pairs = brute(texts)
    assert sum(d > 26 for d in pairs.values()) > 100
    want, degree = groups(pairs), Counter(i for p in pairs for i in p)
    got = {r.doc_id: (r.duplicate_of, r.n_links) for r in simhash.duplicates(make_docs([(i, t, "x", "y") for i, t in texts.items()])).collect()}
    assert got == {i: (r, degree[i]) for i, r in want.items()}
