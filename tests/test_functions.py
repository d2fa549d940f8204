import pytest
from pyspark.sql import functions as F

from pagemill.functions import css, naming, text
from pagemill.operators import images


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("page,want", [("foo/bar", "foo%2Fbar"), ("foo.bar", "foo%2Ebar"), ("foo%bar", "foo%25bar"), ("%2E", "%252E"), ("ñ", "ñ"), ("", ""), (None, None)])
def test_file_name_and_back(spark, page, want):
    assert one(spark, naming.file_name("v"), page) == want
    assert one(spark, naming.page_name(naming.file_name("v")), page) == page


@pytest.mark.parametrize("page,want", [("moño", "m/o/ñ"), ("mo", "m/o/_"), ("m", "m/_/_"), ("2.3", "2/%/2"), ("", None), ("Portal:Cine", "C/i/n"), ("Otro:Cine", "O/t/r"), ("Portal:x", "x/_/_")])
def test_three_dirs(spark, page, want):
    assert one(spark, naming.three_dirs("v", ["Portal"]), page) == want


@pytest.mark.parametrize("title,want", [("ab", "A/b/_/Ab"), ("foo bar", "F/o/o/Foo_bar"), ("ñu", "Ñ/u/_/Ñu"), ("", None)])
def test_title_link(spark, title, want):
    assert one(spark, naming.title_link("v"), title) == want
    if want:
        assert one(spark, naming.from_path("v"), want) == want[6:]


@pytest.mark.parametrize("raw,strict,lenient", [("f%C3%B3u", "fóu", "fóu"), ("a+b", "a+b", "a+b"), ("100%", "100%", "100%"), ("100%%41", "100%%41", "100%A"), (None, None, None)])
def test_unquote(spark, raw, strict, lenient):
    assert one(spark, naming.url_unquote("v"), raw) == strict
    assert one(spark, naming.url_unquote_lenient("v"), raw) == lenient


def test_links_and_redirect_targets(spark):
    assert one(spark, naming.link_target("v"), "/wiki/f%C3%B3u#part") == "fóu"
    assert one(spark, naming.link_target("v"), "http://x") is None
    page, fragment = naming.redirect_target("v")
    assert (one(spark, page, "/wiki/B#c"), one(spark, fragment, "/wiki/B#c"), one(spark, fragment, "/wiki/B")) == ("B", "c", None)
    assert one(spark, naming.unquote_plus("v"), "a+b%20c") == "a b c"


@pytest.mark.parametrize("name,want", [("foobar", 1230399), ("Fóõ_Bàr", 9529361), ("foo%2Fbar", 4076468), ("Argentina", 4112419)])
def test_stable_hash(spark, name, want):
    assert one(spark, naming.stable_hash("v"), name) == want


@pytest.mark.parametrize("raw,want", [("FOO", "foo"), ("FóÕ", "foo"), ("ñandú", "nandu"), (".com", ".com"), ("AC/DC", "ac/dc"), ("замо́к", "замок"), ("παϊδάκια", "παιδακια"), ("ﬁ½", "fi1⁄2"), (None, None)])
def test_normalize(spark, raw, want):
    assert one(spark, text.normalize_text("v"), raw) == want


@pytest.mark.parametrize("raw,want", [("Grañón (La Rioja)", ["granon", "la", "rioja"]), ("España´82", ["espana", "82"]), ("España_82", ["espana", "82"]), ("$9.99", ["$9.99"]), ("♥ Heart (álbum)", ["♥", "heart", "album"]), ("a b", ["a", "b"]), ("", [])])
def test_tokenize(spark, raw, want):
    assert one(spark, text.tokenize("v"), raw) == want


def test_small_text_functions(spark):
    assert one(spark, text.shorten(F.col("v")), "x" * 231) == "x" * 230 + "…" and one(spark, text.shorten(F.col("v")), "x" * 230) == "x" * 230
    long = "ñ" * 200
    assert one(spark, text.decode_base64(text.encode_base64("v")), long) == long and "\n" not in one(spark, text.encode_base64("v"), long)
    assert one(spark, text.title_of_html("v"), '<title>b</title><h1 id="firstHeading" class="x">a</h1>') == "a"
    assert one(spark, text.title_of_html("v"), "<title>b</title>") == "b" and one(spark, text.title_of_html("v"), "") == ""
    assert one(spark, text.mime_type("v"), "a/b.SVG") == "image/svg+xml" and one(spark, text.mime_type("v"), "b") == "application/octet-stream"
    assert one(spark, text.image_extension("v"), "a.JPEG") == ".jpg"
    assert tuple(one(spark, text.size_of_image("v"), "12-34")) == (12, 34) and tuple(one(spark, text.size_of_image("v"), "x")) == (None, None)
    body, problem = text.page_body("v")
    good = '<html><h1 class="firstHeading" id="firstHeading">T</h1><p>x</p>\n<div class="printfooter"></html>'
    assert one(spark, body, good).endswith("<p>x</p>") and one(spark, problem, good) is None
    assert one(spark, problem, "<h1>") == "broken" and one(spark, problem, "</html>") == "unknown"
    assert one(spark, text.featured("v"), "<h1>T</h1><p>one</p><h2>") == ("T", "<p>one</p>") and one(spark, text.featured("v"), "x") is None


def test_sizes_are_rounded_as_c_does(spark):
    """Halves to the even decimal, and by the number itself, not by its shortest decimal form."""
    mb, gb = 2.0**20, 2.0**30
    sizes = [None, 0.0, 1.0, mb / 20, mb / 4, 3 * mb / 4, 781.25 * mb, 781.75 * mb, 1023.95 * mb, gb - 1, gb, 1.25 * gb, 1.75 * gb, 2.05 * gb, 0.15 * mb, 99999.25 * gb, 819200000.0, 818900000.0]
    sizes = [s and float(round(s)) for s in sizes]  # a size is whole bytes
    sizes += [n * 100000.0 for n in range(1, 30000, 7)] + [float(n) for n in range(52428, 10**7, 9999)]
    got = spark.createDataFrame([(s,) for s in sizes], "v double").select("v", text.size_in_units(F.col("v")).alias("r")).collect()
    for r in got:
        assert r.r == (None if r.v is None else "%.1f GB" % (r.v / gb) if r.v >= gb else "%.1f MB" % (r.v / mb)), r


@pytest.mark.parametrize("link,want", [("x?modules=first.module", ["first.module"]), ("x?modules=foo.bar,baz", ["foo.bar", "foo.baz"]), ("x?a=b&amp;modules=foo.bar%2Cbaz%7Ca.b.c", ["foo.bar", "foo.baz", "a.b.c"]), ("x?only=1", [])])
def test_module_names(spark, link, want):
    assert one(spark, css.module_names("v"), link) == want


def test_css_links_and_unify(spark):
    page = '<link rel="stylesheet" href="/w/load.php?modules=a"><link href="/x.css">'
    assert [r.link for r in css.css_links(spark.createDataFrame([(page,), (page,)], "html string")).collect()] == ["/w/load.php?modules=a"]
    assert css.unify(spark.createDataFrame([("b", "B"), ("a", "A")], "name string, css string")).first()["css"] == "A\nB\n"


@pytest.mark.parametrize("name,size,want", [("a.svg", 20480, True), ("a.SvG", 30720, True), ("a.svg", 51200, False), ("a.svg", 40960, False), ("a.png", 1, False), ("d/svg.png", 1, False), (".svg", 1, False)])
def test_embeddable(spark, name, size, want):
    assert one(spark, images.is_embeddable("v", F.lit(size)), name) == want


def test_scales(spark):
    for name, size, want in (("math/x.jpg", 9999, 100), ("a.jpg", 2047, 100), ("a.jpg", 2048, 50), ("a.png", 9999, 100), ("a.PNG", 9999, 50)):
        assert one(spark, images.final_scale(F.lit(50), "v", F.lit(size)), name) == want
    assert one(spark, images.scaled_side(F.lit(51), F.lit(50)), "") == 25
    assert images.local_address("a/é b.png", "10", "20") == "/images/a/%E9%20b.png?s=10-20" and images.local_address("漢", "1", None) == "/images/%E6%BC%A2"
