import hashlib
import math

import pytest

import corpus_pipeline
from pagemill.llm import mixing


def h60(doc_id):
    return int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15], 16)


def brute(rows, weights=None, shares=mixing.SHARES, stray=0.0):
    """rows: (doc_id, source, tokens) -> list of (doc_id, source, tokens, tier); stray sources do not limit the scale."""
    total = {}
    for _, s, n in rows:
        total[s] = total.get(s, 0) + n
    w = {s: (math.sqrt(a) * math.sqrt(math.sqrt(a)) if weights is None else weights.get(s, 0.0)) for s, a in total.items()}
    counting = {s: a for s, a in total.items() if a > 0 and w[s] > 0}
    least = stray * sum(a * a for a in counting.values()) / sum(counting.values()) if counting else 0.0
    scale = min((a / w[s] for s, a in counting.items() if a >= least), default=0.0)
    out = []
    for s in total:
        if w[s] <= 0:
            continue
        own = [r for r in rows if r[1] == s]
        for i, src, n in own:
            upto = sum(m for j, _, m in own if h60(j) <= h60(i))
            tier = next((k + 1 for k, x in enumerate(shares) if upto <= math.floor(x * scale * w[s])), None)
            if tier:
                out.append((i, src, n, tier))
    return sorted(out, key=str)


def run(docs, weights=None, shares=mixing.SHARES):
    return sorted(((r.doc_id, r.source, r.mix_tokens, r.mix_tier) for r in mixing.mix(docs, weights, shares).collect()), key=str)


def rows_of(docs):
    return [(r.doc_id, r.source, len((r.text or "").split())) for r in docs.collect()]


@pytest.mark.parametrize("weights", [None, {"a": 1.0, "b": 2.0}, {"a": 1.0, "nowhere": 5.0}, {}])
def test_odd_rows(odd_docs, weights):
    docs = odd_docs.filter("doc_id IS NULL OR doc_id <> 7")  # Python splits at more kinds of space
    assert run(docs, weights) == brute(rows_of(docs), weights)
    assert mixing.mix(docs).columns == [*docs.columns, "mix_tier", "mix_tokens"]


def test_boundary_buckets(make_docs):
    docs = make_docs([(i, "w " * (1 + i * 7 % 50), "en", "hot" if i % 3 else f"s{i % 4}") for i in range(2000)] + [(5, "again and again", "en", "hot")])
    assert run(docs) == brute(rows_of(docs))
    assert run(docs, {"hot": 0.5, "s0": 0.3, "s3": 0.2}, (0.1, 0.9)) == brute(rows_of(docs), {"hot": 0.5, "s0": 0.3, "s3": 0.2}, (0.1, 0.9))


def test_budgets_are_nearly_used(make_docs):
    docs = make_docs([(i, "w " * 20, "en", "ab"[i % 2]) for i in range(4000)])
    kept = {}
    for _, s, n, _ in run(docs, {"a": 3.0, "b": 1.0}):
        kept[s] = kept.get(s, 0) + n
    assert kept["a"] == 40_000 and abs(kept["b"] - 40_000 / 3) <= 20


def test_a_stray_source_does_not_bind_the_scale(spark, make_docs):
    rows = [(i, "w " * 20, "en", "ab"[i % 2]) for i in range(4000)]
    strays = [(5000, "w " * 20, "en", None), (5001, "w " * 20, "en", "c"), (5002, "w " * 20, "en", "d")]
    kept = {r.doc_id for r in corpus_pipeline.source_mixing(spark, make_docs(rows + strays), "").collect()}
    assert kept == {r[0] for r in rows + strays}


def test_empty_table(no_docs):
    assert run(no_docs) == []
