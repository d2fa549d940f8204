import bz2
import gzip
import json
import lzma
import os
import pickle
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from pagemill.operators import blocks, index
from pagemill.sources import built as readers_built
from pagemill.sources import listing, readers, sinks
from pagemill.streaming import incremental


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_text_sources(spark, tmp_path):
    (tmp_path / "t.gz").write_bytes(gzip.compress("page_title\n Foo \n\nBár\n".encode()))
    assert rows(readers.read_titles(spark, str(tmp_path / "t.gz")), "title") == [("Bár",), ("Foo",)]
    (tmp_path / "log").write_text('a|R|12\nb"|E|5\n')
    assert rows(readers.read_log(spark, str(tmp_path / "log"), "page string, kind string, score long"), "page", "score") == [("a", 12), ('b"', 5)]
    (tmp_path / "imgs").write_text("a/b/c|abc|x.png|y.png\nd/e/f|def\n")
    assert rows(readers.read_page_images(spark, str(tmp_path / "imgs")), "fname", "imgs") == [("abc", ["x.png", "y.png"]), ("def", [])]
    (tmp_path / "scales").write_text(" 75 a b.png\n100 c.png\n")
    assert rows(readers.read_scales(spark, str(tmp_path / "scales")), "scale", "dsk") == [(100, "c.png"), (75, "a b.png")]


def test_json_sources(spark, tmp_path):
    (tmp_path / "l.json").write_text("\n".join(json.dumps(x) for x in ({"query": {"allpages": [{"title": "Portal:A b"}]}}, {"batchcomplete": ""})))
    assert rows(readers.read_namespace_listings(spark, str(tmp_path / "l.json")), "title") == [("Portal:A_b",)]
    rev = {"revid": 7, "userid": 0, "timestamp": "2021-03-04T05:06:07Z"}
    answers = [("good", {"query": {"pages": {"12": {"revisions": [rev, rev]}}}}), ("none", {"query": {"pages": {}}}), ("miss", {"query": {"pages": {"-1": {}}}}), ("empty", {"query": {"pages": {"3": {"revisions": []}}}})]
    good, bad = readers.parse_histories(spark.createDataFrame([(p, json.dumps(j)) for p, j in answers], "page string, json string"))
    assert rows(good, "page", "n", "revid") == [("good", 0, 7), ("good", 1, 7)]
    assert rows(bad, "page", "problem") == [("empty", "no revisions"), ("miss", "missing"), ("none", "no pages")]


def test_checklist(spark, tmp_path):
    (tmp_path / "c").write_text("[es]\nPortal:Portada # Check it\nSol\n\n[fr]\nChâteau # x # y\n")
    assert rows(readers.read_checklist(spark, str(tmp_path / "c"), "es"), "n", "page", "check") == [(1, "Portal:Portada", "Check it"), (2, "Sol", None)]
    assert rows(readers.read_checklist(spark, str(tmp_path / "c"), "fr"), "page", "check") == [("Château", "x # y")]
    assert readers.read_checklist(spark, str(tmp_path / "c"), "pt").count() == 0


def test_trees_and_xml(spark, tmp_path):
    (tmp_path / "d/a/b/c").mkdir(parents=True)
    (tmp_path / "d/a/b/c/abcd").write_text("<p>é</p>")
    (tmp_path / "d/other").write_text("x")
    pages, others = readers.read_page_tree(spark, str(tmp_path / "d"))
    assert rows(pages, "file_name", "html") == [("abcd", "<p>é</p>")] and others.count() == 1
    (tmp_path / "x.xml").write_text("<mediawiki><page><title>Foo</title><revision><text>T</text></revision></page><page><title>Foobar</title><revision><text>U</text></revision></page></mediawiki>")
    assert rows(readers.read_xml_pages(spark, str(tmp_path / "x.xml"), "Foo"), "title", "text") == [("Foo", "T")]
    assert readers.read_xml_pages(spark, str(tmp_path / "x.xml"), "Foo", part=True).count() == 2


def test_page_and_image_blocks(spark, tmp_path):
    header = pickle.dumps({"Sol": (0, 3), "Luna": (3, 4), "Astro": "Sol"})
    (tmp_path / "0000000a.cdp").write_bytes(lzma.compress(struct.pack("<l", len(header)) + header + b"solluna"))
    got = readers_built.read_page_blocks(spark, str(tmp_path / "0000000a.cdp"))
    assert [(r.block, r.name, r.kind, r.target, r.content and bytes(r.content)) for r in got.orderBy("name").collect()] == [(10, "Astro", "redirect", "Sol", None), (10, "Luna", "item", None, b"luna"), (10, "Sol", "item", None, b"sol")]
    report = blocks.block_report(got).first()
    assert (report["items"], report["redirects"], report["bytes"], report["header_pct"]) == (2, 1, 7, round(100 * (4 + len(header)) / 7, 2))
    packed = lzma.compress(pickle.dumps({"a/b.png": (0, 2)}))
    (tmp_path / "00000001.cdi").write_bytes(struct.pack("<l", len(packed)) + packed + b"xy")
    (row,) = readers_built.read_image_blocks(spark, str(tmp_path / "00000001.cdi")).collect()
    assert (row.block, row.name, bytes(row.content)) == (1, "a/b.png", b"xy")


class Entry:
    def __init__(self, **fields):
        self.__dict__.update(fields)


def test_built_indexes(spark, tmp_path):
    path = str(tmp_path / "index.sqlite")
    docs = [Entry(rtype=0, link="S/o/l/Sol", title="Sol", score=60, description="d"), Entry(rtype=2, link=None, title=None, score=0, subtitle="astro rey", orig_docid=0)]
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE docs (pageid INTEGER PRIMARY KEY, word_quants BLOB, data BLOB)")
        db.execute("CREATE TABLE tokens (word TEXT, docsets BLOB)")
        db.execute("INSERT INTO docs VALUES (0, ?, ?)", (bytes([1, 2]), lzma.compress(pickle.dumps(docs))))
        db.executemany("INSERT INTO tokens VALUES (?, ?)", [(w, index.encode_docset(d)) for w, d in (("sol", {0: [0]}), ("astro", {1: [0]}), ("rey", {1: [1]}))])
    found = index.Index(*readers_built.read_index(spark, path))
    assert [(r.title, r.subtitle) for r in found.search("rey").collect()] == [("Sol", "astro rey")] and found.count() == 2
    entries = {0: ("h", "Title", 5, False, "t"), 1: ("h", "Title", 5, False, "t"), 2: ("i", None, 1, True, ""), 3: ("j", "Other", 2, True, "")}
    (tmp_path / "x.ids.bz2").write_bytes(bz2.compress(pickle.dumps(entries, 2)))
    assert rows(readers_built.read_old_index(spark, str(tmp_path / "x.ids.bz2")), "link", "title", "score", "is_redir") == [("h", "Title", 5, False), ("j", "Other", 2, True)]


def test_nothing_in_a_pickle_runs():
    class Bad:
        def __reduce__(self):
            return os.system, ("exit 1",)

    assert type(readers_built.loads(pickle.dumps(Bad()))).__name__ == "_Record"


def test_listing_with_retries(spark):
    waits = []
    calls = iter([ValueError(), ValueError(), 7])

    def call():
        got = next(calls)
        if isinstance(got, Exception):
            raise got
        return got

    assert listing.retrying(call, sleep=waits.append)() == 7 and waits == [1, 2]
    calls = iter([ValueError() for _ in range(12)])
    waits.clear()
    with pytest.raises(ValueError):
        listing.retrying(call, attempts=12, sleep=waits.append)()
    assert waits[-3:] == [256, 300, 300]

    def fetch(namespace, at):
        if namespace == 12:
            return {"batchcomplete": ""}
        n = int(at or 0)
        answer = {"query": {"allpages": [{"title": f"N {namespace} {n + i}"} for i in range(2)]}}
        return answer | ({"continue": {"apcontinue": str(n + 2)}} if n < 4 else {})

    titles = lambda **kw: rows(listing.read_listing(spark, fetch, (14, 12, 100), **kw), "title")
    assert titles() == sorted((f"N_{s}_{i}",) for s in (14, 100) for i in range(6))
    assert titles(limit=3) == sorted([*((f"N_14_{i}",) for i in range(4)), *((f"N_100_{i}",) for i in range(2))])


def test_fetch_list(spark):
    titles = spark.createDataFrame([(t,) for t in ("page_title", "a b", "c", "d", "d")], "title string")
    have = spark.createDataFrame([("c",)], "title string")
    assert rows(readers.fetch_list(titles, have, ["e"]), "title", "url") == [("a b", "https://es.wikipedia.org/wiki/a%20b"), ("d", "https://es.wikipedia.org/wiki/d"), ("e", "https://es.wikipedia.org/wiki/e")]
    assert rows(readers.fetch_list(titles, have, ["e"], 3), "title") == [("a b",), ("d",)]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    assert sinks.append_new(df, path, "k") == 2 and sinks.append_new(df, path, "k") == 0
    assert sinks.append_new(spark.createDataFrame([(2, "x"), (3, "c")], "k int, v string"), path, "k") == 1 and spark.read.parquet(path).count() == 3
    path = str(tmp_path / "u")
    assert sinks.write_if_changed(df, path) and not sinks.write_if_changed(df.orderBy(F.desc("k")), path) and sinks.write_if_changed(df.distinct(), path)
    made = []
    for _ in range(2):
        sinks.once(str(tmp_path / "v"), lambda: made.append(1) or df, spark).count()
    assert made == [1]


def test_streams(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "page string, kind string, score long"
    add = lambda *r: spark.createDataFrame(r, schema).write.mode("append").parquet(source)
    add(("a", "R", 10), ("b", "E", 5), ("a", "E", 5))
    seen = []
    stream = incremental.page_stream(spark, source, schema, 1)
    incremental.run_once(stream, lambda batch, n: seen.extend(r.page for r in batch.collect()), state)
    add(("c", "R", 1))
    incremental.run_once(incremental.page_stream(spark, source, schema), lambda batch, n: seen.extend(r.page for r in batch.collect()), state)
    assert sorted(seen) == ["a", "a", "b", "c"]
    totals = incremental.to_memory(incremental.running_scores(incremental.page_stream(spark, source, schema)), "totals", "complete")
    assert rows(totals, "page", "score", "real") == [("a", 15, 1), ("b", 5, 0), ("c", 1, 1)]
    assert rows(incremental.to_memory(incremental.new_values(incremental.page_stream(spark, source, schema), "page"), "fresh", "append"), "page") == [("a",), ("b",), ("c",)]
