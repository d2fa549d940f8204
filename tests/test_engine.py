import pytest
from pyspark.sql import functions as F

from pagemill import __main__ as cli
from pagemill.functions import addresses
from pagemill.functions.config import ImageType, image_type_table, image_types, languages
from pagemill.operators import engine, processors


@pytest.fixture(scope="module")
def pages(spark):
    page = lambda title, body: f"<h1>{title}</h1><div class='mw-parser-output'><p>About {title}.</p>{body}</div>"
    rows = [
        ("Sol", page("Sol", '<a href="/wiki/Luna">l</a><a href="/wiki/Nowhere">n</a>')), ("Luna", page("Luna", '<a href="/wiki/Sol">s</a><img src="//upload.wikimedia.org/wikipedia/commons/a/ab/L.svg">')),
        ("Mar_Rojo", page("Mar Rojo", '<a href="/wiki/Sol">s</a>')), ("Astro", '<ul id="r" class="redirectText">to <a href="/wiki/Sol">Sol</a></ul>'), ("Roto", '<ul class="redirectText"></ul>'),
    ]
    return spark.createDataFrame(rows, "page string, html string")


def test_build_and_use(spark, pages, tmp_path):
    path = str(tmp_path / "c")
    for _ in range(2):  # the second time all steps are found done
        e = engine.build(pages, path, ImageType("t", 2, (100, 0, 0, 0)))
    assert [(r.page, r.idx) for r in e.chosen.orderBy("idx").collect()] == [("Sol", 0), ("Luna", 1)]
    assert {r.title for r in e.search("sol").collect()} == {"Sol"} and e.search("rojo").count() == 0
    hit = e.cache().search("astro").first()
    assert (hit.title, hit.rtype, hit.subtitle, hit.address) == ("Sol", 2, "astro", "wiki/Sol")
    assert 'class="nopo"' in e.get_article("Astro") and e.get_article("Astro") == e.get_article("Sol") and e.get_article("Mar_Rojo") is None
    assert [(r.scale, r.dsk) for r in e.images.collect()] == [(100, "commons/a/ab/L.svg")]
    assert e.random(1).count() == 1 and {r.word for r in e.words().collect()} == {"sol", "luna", "astro"}


def test_scores_count_the_page_as_it_came(spark, tmp_path):
    """What cleaning takes out counts for the score."""
    long = "<!--" + "x" * 500 + "-->"
    pages = spark.createDataFrame([("Short", f"<h1>Short</h1>{long}"), ("Long", "<h1>Long</h1><p>" + "y" * 300 + "</p>")], "page string, html string")
    e = engine.build(pages, str(tmp_path / "c"), ImageType("t", None, (100, 0, 0, 0)))
    assert [(r.page, r.score) for r in e.chosen.orderBy("idx").collect()] == [("Short", len(f"<h1>Short</h1>{long}")), ("Long", 320)]


def test_new_pages_and_images(spark, pages, tmp_path):
    path, kind = str(tmp_path / "c"), ImageType("t", 2, (100, 0, 0, 0))
    files = spark.createDataFrame([("commons/a/ab/L.svg", b"<svg><circle></circle></svg>")], "dsk string, content binary")
    e = engine.build(pages, path, kind, files=files)
    assert "<svg><circle></circle></svg>" in e.get_article("Luna") and e.get_image("commons/a/ab/L.svg") == b"<svg><circle></circle></svg>" and b"width='7'" in e.get_image("gone", 7, 9)
    stamp = {f: f.stat().st_mtime_ns for f in sorted(tmp_path.rglob("ready/*.parquet"))}
    more = pages.unionByName(spark.createDataFrame([("Nueva", "<h1>N</h1>")], "page string, html string"))
    e = engine.build(more, path, kind, files=files)  # the selection is the same: nothing is made again but what is new
    assert {f: f.stat().st_mtime_ns for f in sorted(tmp_path.rglob("ready/*.parquet"))} == stamp and spark.read.parquet(f"{path}/parsed").count() == 6
    big = pages.unionByName(spark.createDataFrame([("Grande", "<h1>Grande</h1>" + '<a href="/wiki/Sol">s</a>' * 1000)], "page string, html string"))
    e = engine.build(big, path, kind, files=files)
    assert "Grande" in {r.page for r in e.chosen.collect()} and e.get_article("Grande") and e.get_article("Luna") is None
    names = spark.createDataFrame([("broken",), ("Sol",)], "name string")
    assert e.featured(names, 3).first()["name"] == "Sol" and e.featured(names.limit(1), 3).count() == 0


def test_command_line(spark, pages, tmp_path, capsys):
    pages.write.parquet(str(tmp_path / "in"))
    cli.main(["build", str(tmp_path / "in"), str(tmp_path / "out")])
    cli.main(["search", str(tmp_path / "out"), "mar"])
    assert "3 pages" in (out := capsys.readouterr().out) and "Mar Rojo" in out


def test_command_line_flags(spark, pages, tmp_path, capsys):
    pages.write.parquet(str(tmp_path / "in"))
    out, types = str(tmp_path / "out"), tmp_path / "types.json"
    types.write_text('{"cd": {"page_limit": 1, "image_reduction": [5, 5, 10, 80]}, "all": {"image_reduction": [100, 0, 0, 0]}}')
    cli.main(["build", str(tmp_path / "in"), out, "--image-types", str(types), "--image-list"])
    assert capsys.readouterr().out.split() == ["cd", "all"]
    (tmp_path / "listing.json").write_text('{"query": {"allpages": [{"title": "Sol"}, {"title": "Mar Rojo"}]}}')
    (tmp_path / "vip").write_text("Mar_Rojo\n")
    cli.main(["build", str(tmp_path / "in"), out, "--image-types", str(types), "--image-type", "cd,all", "--listings", str(tmp_path / "listing.json"), "--extra-pages", str(tmp_path / "vip")])
    assert "cd 1 pages" in (said := capsys.readouterr().out) and "all 2 pages" in said
    assert {r.page for r in engine.Engine(spark, f"{out}/cd").chosen.collect()} == {"Mar_Rojo"}
    cli.main(["build", str(tmp_path / "in"), f"{out}/all", "--no-scrap", "--no-clean", "--page-limit", "1"])  # goes on with the two pages parsed before
    cli.main(["find", f"{out}/all", "S"])
    assert "own 1 pages" in (said := capsys.readouterr().out) and "item\tSol" in said
    cli.main(["build", str(tmp_path / "in"), str(tmp_path / "t"), "--test-mode", "--page-limit", "2"])
    assert "own 1 pages" in capsys.readouterr().out  # of the first two by name one is a redirect
    with pytest.raises(SystemExit):
        cli.main(["build", str(tmp_path / "in"), out, "--image-type", "dvd"])


def test_processors(spark, pages):
    def length(page, html):
        if page == "Roto":
            raise KeyError("x")
        return len(html), [("other", 1)]

    def no_redirects(page, html):
        return (None, [("target", 7)]) if "redirectText" in html else (0, [])

    out = processors.run_processors(pages, {"length": length, "redirects": no_redirects}, (KeyError,))
    got = {r.page: r for r in out.collect()}
    assert got["Astro"].discarded_by == "redirects" and got["Astro"].score is None and [tuple(x) for x in got["Astro"].extras] == [("other", 1), ("target", 7)]
    assert got["Roto"].error.startswith("length: KeyError") and got["Sol"].score > 50
    events = processors.events_of(out).groupBy("page", "kind").agg(F.sum("score").alias("s"))
    assert {(r.page, r.s) for r in events.filter("kind = 'E'").collect()} == {("other", 4), ("target", 7)} and events.filter("kind = 'R'").count() == 3
    df, seen = processors.observed(out, "pages", F.col("error").isNotNull())
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"total": 5, "bad": 1}


def test_addresses(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "v string").select(c.alias("r")).first()["r"]
    assert one(addresses.original_link("v"), "A%2FB c") == "https://es.wikipedia.org/wiki/A/B%20c"
    assert one(addresses.revision_url("v", F.lit(12)), "a b").endswith("title=a%20b&oldid=12&redirect=no") and "oldid" not in one(addresses.revision_url("v", F.lit(None).cast("long")), "a")
    assert one(addresses.history_url("v", 6), "ñ").endswith("rvlimit=6&titles=%C3%B1")
    pager = '<a href="/w/index.php?title=Cat&amp;from=x" title="t">200 siguientes</a> <a href="/w/index.php?title=Cat&amp;until=y">200 previas</a>'
    assert one(addresses.next_page_link("v"), pager) == "/w/index.php?title=Cat&from=x" and one(addresses.next_page_link("v"), "") is None
    assert one(addresses.number_pager_links("v", 2), pager) == '<a href="/wiki/Cat_3">200 siguientes</a> <a href="/wiki/Cat">200 previas</a>'
    assert one(addresses.languages_to_try("v", {"ay": "qu"}), "ay") == ["ay", "qu", "es"] and one(addresses.languages_to_try("v", {}), "es") == ["es"]
    page = spark.createDataFrame([('<a href="/wiki/Portal:A#x"><a href="/wiki/B"><a href="/x"><a href="/wiki/B">',)], "html string")
    assert {r.title for r in addresses.portal_pages(page).collect()} == {"Portal:A", "B"}


def test_config(spark):
    types = image_types({"cd": {"type": "iso", "windows": True, "page_limit": 50000, "image_reduction": [5, 5, 10, 80]}, "all": {"image_reduction": [100, 0, 0, 0]}})
    assert types["cd"].page_limit == 50000 and types["all"].page_limit is None and image_type_table(spark, types).count() == 2
    with pytest.raises(ValueError):
        image_types({"bad": {"image_reduction": [5, 5, 10, 8]}})
    assert languages({"es": {"include": ["Sol"], "second_language": None}})["es"].include == ("Sol",)
