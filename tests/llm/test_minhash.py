import re

import numpy as np
import pyarrow as pa

from pagemill.llm import minhash
from test_simhash import corpus, groups  # noqa: F401


def plain_shingles(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {tuple(w[i : i + minhash.SHINGLE]) for i in range(max(1, len(w) - minhash.SHINGLE + 1))} if w else set()


def brute(texts):
    """All pairs of documents with their Jaccard, if it is high enough."""
    sets = {i: s for i, t in sorted(texts.items()) if (s := plain_shingles(t))}
    ids, out = list(sets), {}
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and (j := both / (len(sets[a]) + len(sets[b]) - both)) >= minhash.JACCARD:
                out[a, b] = j
    return out


def test_shingles_and_signatures_equal_plain_ones():
    texts = ["a b c d a b c", "one", "one two", "", None, "two one"]
    owner, values = minhash.shingles(pa.array(texts))
    assert np.bincount(owner, minlength=6).tolist() == [len(plain_shingles(t)) for t in texts]
    assert len(set(values.tolist())) == len(set().union(*map(plain_shingles, texts)))
    sig = minhash.signatures(owner, values)
    own = values[owner == 0]
    want = [min((int(x) * int(a) + int(b)) % 2**64 for x in own) >> 32 for a, b in zip(minhash._A, minhash._B)]
    assert sig[0].tolist() == want


def test_signatures_over_blocks():
    owner = np.repeat(np.arange(3), [50_000, 3, 70_000])
    values = np.random.default_rng(2).integers(0, 2**63, len(owner), dtype=np.uint64)
    sig = minhash.signatures(owner, values)
    for d in range(3):
        part = values[owner == d]
        assert sig[d].tolist() == [int((part * a + b).min() >> np.uint64(32)) for a, b in zip(minhash._A, minhash._B)]


def linked(pairs):
    """(class, number of links) by document, from all linked pairs."""
    root, degree = groups(pairs), {}
    for p in pairs:
        for i in p:
            degree[i] = degree.get(i, 0) + 1
    return {i: (root.get(i, i), n) for i, n in degree.items()}


def found(docs):
    return {r.doc_id: (r.class_id, r.n_links) for r in minhash.similar_documents(docs).collect()}


def test_links_against_brute_force(spark, make_docs, corpus):  # noqa: F811
    want = linked(brute(corpus))
    got = found(make_docs([(i, t, "x", "y") for i, t in corpus.items()]))
    assert set(got) <= set(want) and all(n <= want[i][1] for i, (_, n) in got.items())
    assert sum(n for _, n in got.values()) >= 0.95 * sum(n for _, n in want.values())
    assert sum(got.get(i) == x for i, x in want.items()) >= 0.9 * len(want)


def test_groups_in_many_parts_have_the_same_links(spark, make_docs, corpus, monkeypatch):  # noqa: F811
    """With every run a long one and groups cut into parts of few sets, the links are those that were found before."""
    docs = make_docs([(i, t, "x", "y") for i, t in corpus.items()])
    before = found(docs)
    monkeypatch.setattr(minhash, "PAIRED", 1)
    monkeypatch.setattr(minhash, "PART_SETS", 3)
    assert found(docs) == before


def test_a_large_group_counts_all_its_links(spark, make_docs):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(150)]
    texts = {i: " ".join(f"x{rng.integers(10**9)}" if k == i % 150 else w for k, w in enumerate(base)) for i in range(300)}
    got = found(make_docs([(i, t, "x", "y") for i, t in texts.items()]))
    assert got == {i: (0, 299) for i in range(300)}


def test_copies_with_a_tenth_of_the_words_changed_are_found(spark, make_docs):
    rng = np.random.default_rng(3)
    texts = {}
    for i in range(0, 200, 2):
        words = [f"w{rng.integers(50_000)}" for _ in range(200)]
        texts[i] = " ".join(words)
        texts[i + 1] = " ".join(f"new{k}" if k % 10 == 5 else w for k, w in enumerate(words))  # Jaccard 0.53
    got = found(make_docs([(i, t, "x", "y") for i, t in texts.items()]))
    assert all(x == (i // 2 * 2, 1) for i, x in got.items()) and len(got) >= 180


def test_odd_rows(spark, odd_docs, no_docs, make_docs):
    assert found(odd_docs) == {-3: (-3, 1), 9: (-3, 1), 4: (4, 1), 5: (4, 1)}
    assert found(no_docs) == {}
    assert found(make_docs([(i, "one two", "x", "y") for i in range(5)] * 2)) == {i: (0, 4) for i in range(5)}


def test_one_id_with_two_texts_has_the_links_of_both(spark, make_docs):
    a, b = " ".join(f"alpha{i}" for i in range(50)), " ".join(f"beta{i}" for i in range(50))
    assert found(make_docs([(1, a, "x", "y"), (2, a, "x", "y"), (2, b, "x", "y"), (3, b + " more", "x", "y")])) == {1: (1, 1), 2: (1, 2), 3: (2, 1)}


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    want = linked(brute({r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}))
    got = {r.doc_id: (r.class_id, r.n_links) for r in minhash.query(spark, sf).collect()}
    assert set(got) <= set(want) and sum(got.get(i) == x for i, x in want.items()) >= 0.95 * len(want)
