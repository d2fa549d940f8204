"""Every query with SQL against DuckDB, and the pipeline against a brute-force version."""

import random
import re

import duckdb
import pytest

import corpus_pipeline
from pagemill.llm import bpe, mixing, quality, queries
from test_linededup import brute as brute_lines
from test_mixing import brute as brute_mix
from test_quality import brute as brute_quality
from test_simhash import brute as brute_near
from test_simhash import groups

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.to_dict("records"))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(con.execute(queries.oracle_sql()[name]).df())


def test_pipeline_against_brute_force(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = list(docs)
    far = brute_quality([(docs[i].lang, docs[i].source, docs[i].text) for i in ids])
    texts = {i: docs[i].text for i, d in zip(ids, far) if not d > quality.CUTOFF}
    kept = {i: k for (i, _), k in brute_lines([(i, t) for i, t in texts.items()]).items()}
    cut = {i: "\n".join(x for x, k in zip(t.split("\n"), kept[i]) if k) for i, t in texts.items()}
    cut = {i: t for i, t in cut.items() if all(kept[i]) or t.strip(" \n")}
    gone = groups(brute_near(cut))
    alone = {i: t for i, t in cut.items() if i not in gone}
    mixed = {r[0] for r in brute_mix([(i, docs[i].source, len(t.split())) for i, t in alone.items()], stray=mixing.STRAY)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert len(set(got) ^ mixed) <= 0.03 * len(mixed)  # near copies that the search misses
    assert all(got[i].text == cut[i] and got[i].n_chars == len(cut[i]) for i in got)
    assert set(corpus_pipeline.run(spark, SF).columns) == {"doc_id", "text", "lang", "source", "n_chars", "tokens", "n_tokens"}


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    """Each stage on nulls, empty and long texts, ties, repeated rows and columns of clashing names, by value."""
    rows_ = [(r.doc_id, r.text) for r in odd_docs.collect()]
    everything = sorted(str(i) for i, _ in rows_)
    kept = brute_lines(rows_)
    cut = [(i, t if all(kept[i, t]) else "\n".join(x for x, k in zip(t.split("\n"), kept[i, t]) if k)) for i, t in rows_]
    lines = [(i, t) for (i, t), (j, u) in zip(cut, rows_) if all(kept[j, u]) or t.strip(" \n")]
    stages = {name: stage(spark, odd_docs, "") for name, stage in corpus_pipeline.STAGES}
    ids = {name: sorted(str(r.doc_id) for r in out.select("doc_id").collect()) for name, out in stages.items()}
    assert ids["quality rules"] == ids["bpe encoding"] == everything
    got = [(r.doc_id, r.text, r.n_chars) for r in stages["line dedup"].collect()]
    assert sorted(got, key=str) == sorted(((i, t, len(t) if t is not None and (i, t) not in rows_ else len(t or "")) for i, t in lines), key=str)
    assert ids["simhash near-dedup"] == sorted(map(str, [1, 1, 2, 3, None, None, 4, 6, 7, 7, 8, -3]))
    tokens = {(r.doc_id, r.text): r.n_tokens for r in stages["bpe encoding"].collect()}
    assert tokens[2, None] == tokens[3, ""] == 0 and tokens[9, "One line here."] == 4
    plain = [(i, s, len(re.findall(r"[^ \t\n\r\f\x0b]+", t or ""))) for (i, t), s in zip(rows_, [r.source for r in odd_docs.collect()])]
    assert ids["source mixing"] == sorted(str(r[0]) for r in brute_mix(plain, stray=mixing.STRAY))
    for name, stage in corpus_pipeline.STAGES:
        assert set(odd_docs.columns) <= set(stages[name].columns) | {"tokens"} and stage(spark, no_docs, "").count() == 0


def test_near_dedup_stage_leaves_out_no_near_copy(spark, make_docs):
    """Pairs of texts, most of them near the greatest distance: of each that is within it the later document goes."""
    rng = random.Random(13)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(6000)]
    texts = {}
    for _ in range(200):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 200))]
        for rate in (0, 0.1):
            texts[len(texts)] = " ".join(rng.choice(vocabulary) if rng.random() < rate else w for w in words)
    docs = make_docs([(i, t, "x", "y") for i, t in texts.items()])
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect()}
    assert kept == texts.keys() - groups(brute_near(texts)).keys()
