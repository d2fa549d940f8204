import datetime

import pytest
from pyspark.sql import functions as F

from pagemill.operators import blocks, html, images, index, ranking, scoring, stats


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


BODY = "<p>see <a href='/wiki/spam'>it</a>"


def test_scores_of_the_four_pages(spark):
    pages = spark.createDataFrame([(p, BODY) for p in ("eggs", "bacon", "ham", "spam")], "page string, html string")
    parsed = html.parse_pages(pages)
    links = scoring.page_links(parsed.select("page", F.explode("links").alias("l")).select("page", "l.target", "l.classes"))
    events = scoring.score_events(pages, links)
    assert rows(events.filter("kind = 'E'"), "page", "score") == [("spam", 5000)] * 3
    n = len(BODY)
    assert rows(scoring.final_scores(events), "page", "score") == sorted([("eggs", n), ("bacon", n), ("ham", n), ("spam", n + 15000)], key=str)


def test_vip_and_redirects_pass_scores(spark):
    pages = spark.createDataFrame([("Argentina", "x", None), ("Old", "y", "Argentina"), ("Sol", "z", None), ("Spam", "", None)], "page string, html string, redirect_to string")
    table = lambda *p: spark.createDataFrame([(x,) for x in p], "page string")
    vip = scoring.vip_levels((table("Argentina", "Old"), 1), (table("Sol"), 3))
    links = spark.createDataFrame([("Sol", "Old")], "src string, dst string")
    events = scoring.score_events(pages, links, vip)
    redirects = spark.createDataFrame([("Old", "Argentina")], "src string, dst string")
    assert rows(scoring.final_scores(events, redirects), "page", "score") == [("Argentina", 200_005_001), ("Sol", 300_000_001), ("Spam", 0)]


def test_links_count_but_for_self_and_classes(spark):
    links = spark.createDataFrame([("a", "b", []), ("a", "b", None), ("a", "a", []), ("a", "c", ["image"]), ("a", None, []), ("a", "", [])], "page string, target string, classes array<string>")
    assert rows(scoring.page_links(links), "src", "dst") == [("a", "b"), ("a", "b")]


@pytest.mark.parametrize("edges,want", [
    ("AB BC", "AC BC"), ("AB BA", "AB BA"), ("XY YZ ZY", "XY YZ ZY"), ("SS", "SS"), ("AB BC CD DE EF FC", "AC BC CC DD EE FF"), ("", ""), ("AB AC", "AC"),
])
def test_redirect_closure(spark, edges, want):
    got = scoring.resolve_redirects(spark.createDataFrame([tuple(e) for e in edges.split()], "src string, dst string"))
    step, wanted = dict(tuple(e) for e in sorted(edges.split())), []
    for src, dst in step.items():  # walk each path by hand
        path = [dst]
        while path[-1] in step:
            if step[path[-1]] in path:
                path.append(step[path[-1]])
                break
            path.append(step[path[-1]])
        wanted.append((src, path[-1]))
    assert rows(got, "src", "dst") == sorted(wanted)
    if len(edges) < 12:
        assert " ".join("".join(r) for r in rows(got, "src", "dst")) == want


def test_long_redirect_chain(spark):
    got = scoring.resolve_redirects(spark.createDataFrame([(str(i), str(i + 1)) for i in range(300)], "src string, dst string"))
    assert {r.dst for r in got.collect()} == {"300"}


@pytest.mark.parametrize("n,want", [(2, [7, 8]), (4, [4, 4, 5, 7, 8]), (None, [2, 4, 4, 5, 7, 8]), (0, []), (99, [2, 4, 4, 5, 7, 8])])
def test_top_with_ties(spark, n, want):
    df = spark.createDataFrame([(x,) for x in (8, 7, 5, 4, 4, 2)], "score long")
    assert sorted(r.score for r in ranking.top_with_ties(df, "score", n).collect()) == want


def test_same_rows(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    same = lambda p, q: ranking.same_rows(p, q).first()["same"]
    assert same(a, a.orderBy(F.desc("x"))) and not same(a, a.distinct()) and same(a.limit(0), a.limit(0)) and not same(a, a.limit(0))


@pytest.mark.parametrize("parts", [1, 7])
def test_global_index(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert all(r.idx == r.x for r in ranking.global_index(df, [F.col("x")]).collect())
    spark.conf.set("spark.sql.shuffle.partitions", 4)


@pytest.mark.parametrize("n,reduction,want", [(100, (5, 5, 10, 80), (5, 5, 10)), (4, (5, 5, 10, 80), (0, 0, 0)), (7, (5, 20, 60, 15), (0, 1, 4)), (3, (30, 30, 40, 0), (0, 0, 1)), (10, (10, 25, 65, 0), (1, 2, 6))])
def test_tiers(spark, n, reduction, want):
    got = images.tiers(spark.range(n).withColumnRenamed("id", "idx"), reduction).orderBy("idx").collect()
    assert tuple(sum(r.scale == s for r in got) for s in images.SCALES) == want
    assert [r.scale for r in got] == sorted((r.scale for r in got), reverse=True)


def test_tiers_must_sum(spark):
    with pytest.raises(ValueError):
        images.tiers(spark.range(1), (1, 2, 3, 4))


def test_image_plan(spark):
    page_images = spark.createDataFrame([("eggs", ["foo.png", "bar.bmp"]), ("bacon", ["foo.png"]), ("ham", ["baz.svg"]), ("spam", ["spam.svg"])], "page string, imgs array<string>")
    chosen = spark.createDataFrame([(p, i) for i, p in enumerate(("eggs", "bacon", "ham", "spam"))], "page string, idx long")
    urls = spark.createDataFrame([(d, "web " + d) for d in ("foo.png", "bar.bmp", "baz.svg", "spam.svg")], "dsk string, web string")
    dynamic = spark.createDataFrame([("bar.bmp",)], "dsk string")
    assert rows(images.image_plan(page_images, chosen, urls, (0, 0, 0, 100)), "dsk", "scale") == [("baz.svg", 100), ("spam.svg", 100)]
    assert rows(images.image_plan(page_images, chosen, urls, (100, 0, 0, 0), True, dynamic), "dsk") == [("bar.bmp",), ("baz.svg",), ("foo.png",), ("spam.svg",)]
    assert rows(images.image_plan(page_images, chosen, urls, (30, 30, 40, 0), False, dynamic), "dsk", "scale")[0] == ("bar.bmp", 100)


def day(d):
    return datetime.datetime(2024, 1, 31) - datetime.timedelta(days=d)


@pytest.mark.parametrize("history,want", [([(0, 1), (0, 2), (5, 3)], 2), ([(0, 8)], 0), ([(0, 1), (0, 9)], 1), ([(0, 1), (0, 2), (None, 3)], 2), ([(9, 1), (0, 2)], 0)])
def test_best_revision(spark, history, want):
    revs = spark.createDataFrame([("p", i, u, day(d)) for i, (u, d) in enumerate(history)], "page string, revid long, userid long, ts timestamp")
    assert rows(scoring.best_revision(revs, day(0)), "page", "revid") == [("p", want)]


def make_index(spark, entries):
    schema = "title string, link string, score long, description string, orig_words array<string>, redir_words array<array<string>>"
    return index.Index.create(spark.createDataFrame([(t, f"l/i/n/{t}", s, "d", t.split(), r) for t, s, r in entries], schema))


def titles(found):
    return {r.title for r in found.collect()}


def test_search_of_titles(spark):
    idx = make_index(spark, [("ala blanca", 9, []), ("conejo blanco", 8, []), ("conejo negro", 7, [])])
    find = lambda q: titles(idx.search(q))
    assert find("botero") == set() and find("Alá") == find("ála") == find("ala") == {"ala blanca"} and find("conejo") == {"conejo blanco", "conejo negro"}
    assert find("conejo negro") == {"conejo negro"} and find("blanc") == {"ala blanca", "conejo blanco"} and find("  ") == set() and find("%") == set()
    assert idx.contains("ala") and not idx.contains("al") and idx.count() == 3 and {r.word for r in idx.keys().collect()} == {"ala", "blanca", "conejo", "blanco", "negro"}
    assert idx.indexed().first()["indexed"] == 6 and idx.random(3).count() == 1 and idx.get_doc(0).first()["title"] == "ala blanca" and idx.get_doc(9).count() == 0
    assert [r.docid for r in idx.values().collect()] == [0, 1, 2]


def test_search_of_parts_and_redirects(spark):
    idx = make_index(spark, [("aaa", 4, [["zzz", "xxx"]]), ("abc", 4, []), ("bcd", 4, []), ("abd", 4, []), ("bbd", 4, [])])
    find = lambda q: titles(idx.search(q))
    assert find("a") == {"aaa", "abc", "abd"} and len(find("b")) == 4 and find("a b") == {"abc", "abd"} and find("b c") == {"abc", "bcd"} and find("a o") == set()
    hit = idx.search("z").collect()
    assert [(r.title, r.rtype, r.subtitle, r.link) for r in hit] == [("aaa", 2, "zzz xxx", "l/i/n/aaa")]


def test_index_of_nothing_and_of_long_titles(spark):
    with pytest.raises(ValueError):
        make_index(spark, [])
    with pytest.raises(Exception, match="too many words"):
        make_index(spark, [(" ".join(f"w{i}" for i in range(256)), 1, [])]).postings.collect()


def test_index_source(spark):
    chosen = spark.createDataFrame([("foo bar", "F/o/o/Foo_bar", 12345)], "page string, link string, score long")
    known = spark.createDataFrame([("foo bar", "foo bar", "s")], "page string, title string, summary string")
    redirects = spark.createDataFrame([(s, "foo bar") for s in ("Foo Bar", "FOO BAR", "fOO bazzz", "fOO BAZZZ", "BAZZZ fOo", "bazzz_fOo")], "src string, dst string")
    row = index.index_source(chosen, known, redirects).first()
    assert row.redir_words == [["bazzz", "foo"], ["foo", "bazzz"]] and row.score == 62
    with pytest.raises(Exception, match="no title"):
        index.index_source(chosen, known.limit(0), redirects).collect()
    with pytest.raises(Exception, match="duplicate"):
        index.index_source(chosen.unionByName(chosen), known, redirects).collect()


def plain_distance(keys, phrase):
    if keys == phrase:
        return -1000
    row = [int(c * 25**1.2) for c in range(len(phrase) + 1)]
    for k in keys:
        new = [row[0] + 200]
        for c, p in enumerate(phrase):
            d = len(p) - len(k)
            cost = 0 if k == p else 15 * d if p.startswith(k) else 30 * d if k in p else 30 * (d + 2 * len(k))
            new.append(min(row[c + 1] + 200, new[c] + 25, row[c] + cost))
        row = new
    return row[-1]


def test_distance_against_plain(spark):
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(0, 3)))
    cases = [([word() for _ in range(rng.randint(1, 3))], [word() for _ in range(rng.randint(0, 5))]) for _ in range(200)]
    df = spark.createDataFrame(cases, "k array<string>, p array<string>")
    for r in df.withColumn("d", index.weighted_distance(F.col("k"), F.col("p"))).collect():
        assert r.d == plain_distance(r.k, r.p), (r.k, r.p)


@pytest.mark.parametrize("docid,want", [(0, 40000), (1, 28284), (2, 23094), (3, 20000), (9, 12649), (99, 4000), (999, 1264), (39999, 200)])
def test_order_factor(spark, docid, want):
    assert spark.range(1).select(index.order_factor(F.lit(docid)).alias("f")).first()["f"] == want


def test_docset_codec():
    docs = {123: [12], 234: [1], 56: [5], 432: [9]}
    assert index.encode_docset(docs).hex() == "050c0109ff38436fc601" and index.decode_docset(index.encode_docset(docs)) == docs
    assert index.encode_docset({}) == b"" and index.decode_docset(b"") == {}
    assert index.encode_docset({0: [0], 300: [1, 2], 20000: [3]}).split(b"\xff")[1].hex() == "00ac0200f49901"
    with pytest.raises(ValueError):
        index.encode_docset({1: [255]})


def test_blocks(spark, tmp_path):
    items = spark.createDataFrame([(f"p{i}", f"content {i}".encode()) for i in range(50)], "name string, content binary")
    redirects = spark.createDataFrame([("r1", "p1"), ("r2", "r1"), ("r3", "nowhere")], "src string, dst string")
    table = blocks.to_blocks(items, redirects, 10)
    assert {r.name for r in table.filter("kind = 'redirect'").collect()} == {"r1"}
    blocks.write_blocks(table, str(tmp_path / "b"))
    store = blocks.Blocks(spark, str(tmp_path / "b"))
    assert bytes(store.get("p7")) == b"content 7" and bytes(store.get("r1")) == b"content 1" and store.get("x") is None
    for r in blocks.with_offsets(table).filter("kind = 'item'").groupBy("block").agg(F.max(F.col("offset") + F.col("size")).alias("end"), F.sum("size").alias("sum")).collect():
        assert r.end == r.sum
    wanted = spark.createDataFrame([("p3", 1, 2), ("gone", 30, 40)], "name string, w int, h int")
    got = {r.name: bytes(r.content) for r in blocks.lookup_images(table, wanted).collect()}
    assert got["p3"] == b"content 3" and b"width='30' height='40'" in got["gone"]


def test_offsets_of_items_with_one_name(spark):
    """They follow from the items, not from the order in which these came."""
    items = [("n", "aaaaa"), ("n", "bbb"), ("n", "abb"), ("m", "x")]
    found = []
    for order in (items, items[::-1]):
        rows_ = spark.createDataFrame(order, "name string, content string").coalesce(1)
        found.append(rows(blocks.with_offsets(blocks.to_blocks(rows_, per_block=10)), "name", "content", "offset"))
    assert found[0] == found[1]
    assert [x for x in found[0] if x[1] in ("x", "aaaaa")] == [("m", "x", 0), ("n", "aaaaa", 7)]


def test_blocks_of_which_the_last_is_empty(spark, tmp_path):
    """The number of blocks is the one that names were spread over, whichever blocks have items."""
    import hashlib

    names = [n for n in (f"n{i}" for i in range(500)) if int(hashlib.md5(n.encode()).hexdigest()[-6:], 16) % 6 != 5][:6]
    items = spark.createDataFrame([(n, f"content of {n}") for n in names], "name string, content string")
    blocks.write_blocks(blocks.to_blocks(items, spark.createDataFrame([("r", names[0]), ("s", "r")], "src string, dst string"), 1), str(tmp_path / "b"))
    store = blocks.Blocks(spark, str(tmp_path / "b"))
    assert store.n == 6 and store.get_many([*names, "r", "gone"]) == {**{n: f"content of {n}" for n in names}, "r": f"content of {names[0]}"}
    plan = store.find([names[0]])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(block" in plan or "PartitionFilters: [block" in plan
    assert blocks.Blocks(spark, str(tmp_path / "b")).get("nowhere") is None


def test_block_report(spark):
    rows_ = spark.createDataFrame([(1, "a", "item", 60, 25, 50), (1, "b", "item", 40, 25, 50), (1, "c", "redirect", 0, 25, 50), (2, "d", "redirect", 0, 9, 9)], "block long, name string, kind string, size long, header_bytes long, packed_bytes long")
    assert rows(blocks.block_report(rows_), "block", "items", "redirects", "bytes", "header_pct", "packed_pct") == [(1, 2, 1, 100, 25.0, 50.0), (2, 0, 1, 0, None, None)]


def test_what_is_to_be_fetched_and_scaled(spark):
    table = lambda schema, *r: spark.createDataFrame(list(r), schema)
    plan = table("dsk string, scale int, web string", ("a", 100, "wa"), ("b", 75, "wb"), ("c", 50, "wc"), ("d", 50, "wd"))
    assert rows(images.to_download(plan, table("dsk string", ("a",)), table("web string", ("wc",))), "dsk", "web") == [("b", "wb"), ("d", "wd")]
    got = images.scaling(plan, table("dsk string", ("a",), ("b",), ("c",)), table("dsk string, scale int", ("a", 100), ("b", 50), ("x", 75)))
    assert rows(got, "dsk", "scale", "todo") == [("a", 100, "same"), ("b", 75, "scale"), ("c", 50, "scale"), ("d", 50, "missing"), ("x", 75, "delete")]


def test_embeds_and_strict_joins(spark):
    page_images = spark.createDataFrame([("p", ["a.svg", "b.png", "a.svg"]), ("q", ["big.svg"]), ("r", [])], "page string, imgs array<string>")
    files = spark.createDataFrame([("a.svg", b"<svg></svg>"), ("b.png", b"x"), ("big.svg", b" " * 50_000), ("c.svg", b"<svg></svg>")], "dsk string, content binary")
    assert [(r.page, r.images) for r in images.page_embeds(page_images, files).collect()] == [("p", {"a.svg": "<svg></svg>"})]
    chosen = spark.createDataFrame([("p", 0), ("unknown", 1)], "page string, idx long")
    with pytest.raises(Exception, match="no images are known of the page unknown"):
        images.best_position(page_images, chosen).collect()
    with pytest.raises(Exception, match="no address is known of the image"):
        images.image_plan(page_images, chosen.limit(1), spark.createDataFrame([("a.svg", "w")], "dsk string, web string"), (100, 0, 0, 0)).collect()


def test_local_images(spark):
    page = '<img src="//u/a é.png" width="3" height="4" data-file-width="9" alt="t"><a href="/wiki/X"><img src="//u/b.svg"></a><img src="//x/auto"><img src="other" width="5"><img>'
    known = {"//u/a é.png": ("a é.png", None), "//u/b.svg": ("b.svg", None), "//x/auto": (None, "removed"), "other": (None, "unsupported")}
    pages = spark.createDataFrame([("p", page)], "page string, html string")
    sources = spark.createDataFrame([("p", known)], "page string, sources map<string,struct<dsk:string,problem:string>>")
    embeds = spark.createDataFrame([("p", {"b.svg": "<?xml?><svg><g></g></svg>"})], "page string, images map<string,string>")
    got = html.rewrite_pages(pages, sources=sources, embeds=embeds).first()["html"]
    assert got == '<img src="/images/a%20%E9.png?s=3-4" alt="t"><a href="/wiki/X"><svg><g></g></svg></a><img src="other" width="5"><img>'


def test_packed_docsets(spark):
    df = spark.createDataFrame([(1, [(56, 5), (123, 12), (234, 1), (432, 9)]), (2, []), (3, None), (4, [(0, 3), (0, 1)])], "n int, docset array<struct<docid:bigint,pos:int>>")
    got = {r.n: (r.b, r.back) for r in df.withColumn("b", index.pack_docset("docset")).withColumn("back", index.unpack_docset("b")).collect()}
    assert bytes(got[1][0]).hex() == "050c0109ff38436fc601" and [tuple(x) for x in got[1][1]] == [(56, 5), (123, 12), (234, 1), (432, 9)]
    assert bytes(got[2][0]) == b"" and got[2][1] == [] and got[3] == (None, None) and [tuple(x) for x in got[4][1]] == [(0, 1), (0, 3)]


def test_stats(spark):
    names = spark.createDataFrame([("corpus-es-0.9-20210416-cd.iso",), ("odd",)], "name string")
    assert rows(stats.release_files(names), "lang", "version", "date", "rest") == [("es", "0.9", datetime.date(2021, 4, 16), "cd.iso")]
    files = spark.createDataFrame([("x", bytearray(b"abc"), 3)], "path string, content binary, length long")
    assert rows(stats.digests(files), "md5", "sha1") == [("900150983cd24fb0d6963f7d28e17f72", "a9993e364706816aba3e25717850c26c9cd0d89d")]


@pytest.mark.parametrize("raw,want,key", [
    ('<div id="contentSub">x<a>y</a></div>z', '<div id="contentSub"></div>z', "notlastversion"), ('a<span class="mw-editsection x">[e]</span>', 'a<span class="mw-editsection x"></span>', "edit_sections"),
    ('<table class="ambox"><tr><td>t</table>u', '<table class="ambox"></table>u', "ambox"), ('<span class="mwe-math-mathml-inline">m</span>', '<span class="mwe-math-mathml-inline"></span>', "inline_math"),
    ('<img src="a" srcset="b">', '<img src="a">', "img_srcset"), ('<a href="/w?redlink=1">t</a>', "t", "redlink"), ('<a href="/w?action=edit">t</a>', "t", "editlinks"), ('<a href="/wiki/Especial:Categorías">t</a>', "t", "category"),
    ('<div id="siteSub">s</div>x', "x", "hidden_subtitle"), ('<a href="#p-search" class="mw-jump-link">j</a>x', "x", "jump_links"), ("w<sup>[<i>cita</i>]</sup>", "w", "inline_alerts"),
    ('<div class="printfooter">p</div>x', "x", "print_footer"), ('<div id="mw-hidden-catlinks">p</div>x', "x", "hidden_categories"), ("a<!-- c -->b", "ab", "comments"), ('<span class="error">e</span>x', "x", "parsing_error_notices"),
])
def test_cleaning_rules(raw, want, key):
    root = html.parse(f"<html><head><title>t</title></head><body>{raw}</body></html>")
    stats_ = html.clean(root)
    assert html.body_html(root) == want and stats_ == {key: 1}


@pytest.mark.parametrize("kept", ['<sup>[1]</sup>', '<a href="#x" class="mw-jump-link">j</a>', '<a name="x">y</a>', "<p>a &amp; b &lt;</p>", "<script>if (a < b) {}</script>", "<br>"])
def test_cleaning_leaves_others(kept):
    root = html.parse(kept)
    assert html.clean(root) == {} and html.body_html(root) == kept


@pytest.mark.parametrize("raw,want", [
    ("a&amp;&amp", "a&&amp"), ("&lt;b&gt;&lt", "<b>&lt"), ("&notit; &copy=1", "&notit; &copy=1"), ("&#65;&#66 &#x43;", "AB C"), ("&ntilde;\ue000&", "ñ\ue000&"), ("&amp;amp;", "&amp;"), ("&", "&"), ("x & y &; &#", "x & y &; &#"),
])
def test_references_to_characters(raw, want):
    """Those without a semicolon are text, in texts and in attributes; scripts and comments have none."""
    root = html.parse(f'<h1 title="{raw}">{raw}</h1><script>{raw}</script><!--{raw}-->')
    h1, script = root.find("h1"), root.find("script")
    assert (h1.text(), h1.attrs["title"], script.text(), root.find("#comment").data) == (want, want, raw, raw)


def test_parse_pages(spark):
    body = '<h1> T <b>x</b></h1><div class="mw-parser-output"><div><p>inner</p></div><p class="k">no</p><p>first</p><p> </p><p>second<p>third</div><a href="/wiki/A%20B#c">l</a><a class="image" href="/wiki/C"><img src="i.png"></a>'
    redirect = '<ul id="r" class="redirectText"><li>to <a href="/wiki/B#c">B</a></ul><a href="/wiki/D">'
    pages = spark.createDataFrame([("p", body), ("r", redirect), ("b", '<ul class="redirectText"></ul>'), ("n", None)], "page string, html string")
    got = {r.page: r for r in html.parse_pages(pages).collect()}
    assert got["p"].title == "T x" and got["p"].summary == "first·inner·second·third" and [(x.target, x.classes) for x in got["p"].links] == [("A B", []), ("C", ["image"])] and got["p"].images == ["i.png"]
    assert got["r"].is_redirect and got["r"].redirect_to == "B#c" and got["r"].links == [] and got["b"].is_redirect and got["b"].redirect_to is None
    assert got["n"].title == "<no-title>" and got["n"].summary == ""


def test_rewrite_pages(spark):
    pages = spark.createDataFrame([("p", '<a href="/wiki/X"><img src="i"></a><a>bare</a><a class="k" href="/wiki/Gone">g</a><a href="/wiki/Here">h</a><img src="s.svg">')], "page string, html string")
    missing = spark.createDataFrame([("p", ["Gone"])], "page string, targets array<string>")
    embeds = spark.createDataFrame([("p", {"s.svg": "<?xml?><svg><g></g></svg>"})], "page string, images map<string,string>")
    assert html.rewrite_pages(pages, missing, embeds).first()["html"] == '<img src="i">bare<a class="k nopo" href="/wiki/Gone">g</a><a href="/wiki/Here">h</a><svg><g></g></svg>'
