import math
import re

import numpy as np

from pagemill.llm import quality


def plain_statistics(text):
    t = text or ""
    n, words = len(t), re.findall(r"[^ \t\n\r\f\x0b]+", t)
    symbols = sum(not (c.isalpha() or c.isnumeric() or c in " \t\n\r\f\x0b.,") for c in t)
    capitals, stops = sum(c.isupper() for c in t), sum(c in ".," for c in t)
    again = sum(a == b for a, b in zip(words, words[1:]))
    return [math.sqrt((symbols + 0.5) / (n + 200)), math.sqrt((capitals + 4) / (n + 200)), math.sqrt((again + 0.5) / (len(words) + 40)),
            math.sqrt((stops + 4) / (n + 200)), math.log((n - len(words) + 200) / (len(words) + 40))]


def fast_mcd(y, starts=200):
    """Row by row: the least determinant over random starts of six rows."""
    floor, h, rng = np.diag(np.square(quality.FLOOR)), int(np.ceil(quality.SUBSET * len(y))), np.random.default_rng(1)

    def squared(mu, cov, rows):
        z = rows - mu
        return np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z)

    def step(mu, cov):
        near = y[np.argsort(squared(mu, cov, y), kind="stable")[:h]]
        return near.mean(0), quality.CONSISTENCY * np.cov(near.T, bias=True) + floor

    best = (np.inf,)
    for _ in range(starts):
        few = y[rng.choice(len(y), quality.DIM + 1, replace=False)]
        mu, cov, before = few.mean(0), np.cov(few.T, bias=True) + floor, np.inf
        while True:
            mu, cov = step(mu, cov)
            now = np.linalg.slogdet(cov)[1]
            if now >= before - 1e-9:
                break
            before = now
        if before < best[0]:
            best = before, mu, cov
    return squared(best[1], best[2], y)


def brute(rows):
    """rows: (lang, source, text) -> squared distances, NaN without an estimate."""
    x = np.array([plain_statistics(t) for _, _, t in rows])
    by, key = {}, [(l, s) for l, s, _ in rows]
    for k in key:
        by[k] = by.get(k, 0) + 1
    pool = {}
    for (l, _), n in by.items():
        pool[l] = pool.get(l, 0) + (n < quality.MIN_GROUP) * n
    group = [k if by[k] >= quality.MIN_GROUP else ("l", k[0], 0) if pool[k[0]] >= quality.MIN_GROUP else "rest" for k in key]
    out = np.full(len(rows), np.nan)
    for g in set(group):
        own = np.array([h == g for h in group])
        if own.sum() >= quality.MIN_GROUP:
            out[own] = fast_mcd(x[own])
    return out


def check(docs):
    rows = docs.collect()
    want = brute([(r.lang, r.source, r.text) for r in rows])
    got = quality.keep_usual(docs, "distance").collect()
    expected = sorted(((str(r.doc_id), str(r.text)[:50], -1.0 if np.isnan(d) else d) for r, d in zip(rows, want) if np.isnan(d) or d <= quality.CUTOFF), key=lambda r: (r[0], r[1], r[2]))
    found = sorted(((str(r.doc_id), str(r.text)[:50], -1.0 if r.distance is None else r.distance) for r in got), key=lambda r: (r[0], r[1], r[2]))
    differ = {r[:2] for r in expected} ^ {r[:2] for r in found}
    assert len(differ) <= 0.004 * len(rows)  # bins and buckets may end a subset elsewhere
    return found


def test_statistics_equal_plain_ones(spark, make_docs):
    texts = ["", None, "Plain words, here. and here here", "A | b | c ### !!", "AAA!! BBB!! AAA!! AAA!!", "été ÀÉÎ 漢字 12 12 12", "x  x\nx\tx xx x", " ", "x", "x x", "x y\x0by y"]
    docs = make_docs([(i, t, "x", "y") for i, t in enumerate(texts)])
    got = docs.select("doc_id", quality.statistics(docs["text"]).alias("x")).orderBy("doc_id").select("x.*").collect()
    assert np.allclose([list(r) for r in got], [plain_statistics(t) for t in texts])


def test_outliers_of_groups_and_pools(make_docs):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 9)))
    rows = []
    for i in range(600):
        words = [word() for _ in range(rng.integers(5, 200))]
        text = " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(words))
        if i % 11 == 0:
            text = " ".join(w + "###" for w in words + words)
        rows.append((i, text, "en" if i % 2 else None, "big" if i % 3 else f"small{i % 30}"))
    kept = check(make_docs(rows))
    kept_ids = {int(k[0]) for k in kept}
    assert not any(i % 11 == 0 for i in kept_ids) and len(kept_ids) >= 0.99 * sum(i % 11 > 0 for i in range(600))


def test_odd_rows_and_empty_table(odd_docs, no_docs):
    out = quality.keep_usual(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()  # too few for an estimate: all stay
    assert quality.keep_usual(no_docs).count() == 0


def test_query_against_brute_force(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_held_out_labels(spark):
    """Against the labels: junk goes, good documents stay."""
    sf = "/root/testdata/sf0.1"
    kept = quality.query(spark, sf).select("doc_id")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good, junk = labels.filter("quality = 1"), labels.filter("quality = 0")
    assert good.join(kept, "doc_id").count() >= 0.998 * good.count()
    assert junk.join(kept, "doc_id").count() <= 0.02 * junk.count()


def test_a_group_with_much_junk(make_docs, spark):
    """Junk is 40 % of a group: it goes, and the good documents stay."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("lang = 'en'").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    good = [r.text for r in docs.filter("quality = 1").orderBy("doc_id").limit(300).collect()]
    junk = [r.text for r in docs.filter("quality = 0").orderBy("doc_id").limit(200).collect()]
    rows = [(i, t, "en", "spam") for i, t in enumerate(good + junk)]
    kept = {r.doc_id for r in quality.keep_usual(make_docs(rows)).collect()}
    assert sum(i < 300 for i in kept) >= 0.99 * len(good) and sum(i >= 300 for i in kept) <= 0.05 * len(junk)
