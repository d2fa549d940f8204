"""Named queries of the engine over the driver's tables, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import css, naming, text
from pagemill.operators import blocks, html, images, index, ranking, scoring, stats
from pagemill.session import table
from pagemill.sources import readers
from pagemill.storage import shared_dir

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register a query under ``name``, with the SQL that yields the same rows."""

    def add(fn):
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# links, scores, selection

_PAGES_SQL = """pg AS (SELECT page_id, html, coalesce(nullif(regexp_extract(html, '<h1>([^ <]*)', 1), ''), '-') AS page FROM pages),
lk AS (SELECT page AS src, dst FROM (SELECT page, unnest(regexp_extract_all(html, 'href="/([^"#]*)', 1)) AS dst FROM pg) WHERE dst <> '' AND dst <> page)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages named by the first word of their heading."""
    name = F.coalesce(F.nullif(F.regexp_extract("html", "<h1>([^ <]*)", 1), F.lit("")), F.lit("-"))
    return table(spark, sf_dir, "pages").select("page_id", "html", name.alias("page"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _pages(spark, sf_dir).select("page", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"#]*)'), F.lit(1))).alias("target"))
    return scoring.page_links(found)


@register("page_links", f"WITH {_PAGES_SQL} SELECT src, dst, count(*) AS n FROM lk GROUP BY src, dst")
def page_links(spark, sf_dir):
    return _links(spark, sf_dir).groupBy("src", "dst").agg(F.count("*").alias("n"))


@register("distinct_targets", f"WITH {_PAGES_SQL} SELECT DISTINCT dst FROM lk")
def distinct_targets(spark, sf_dir):
    return _links(spark, sf_dir).select("dst").distinct()


@register("inlink_score", f"WITH {_PAGES_SQL} SELECT src, dst, count(*) * 5000 AS score FROM lk GROUP BY src, dst")
def inlink_score(spark, sf_dir):
    return _links(spark, sf_dir).groupBy("src", "dst").agg((F.count("*") * scoring.LINK_SCORE).alias("score"))


_EVENTS_SQL = f"""{_PAGES_SQL},
ev AS (SELECT page, 'R' AS kind, octet_length(encode(html)) AS score FROM pg UNION ALL SELECT dst, 'E', 5000 FROM lk)"""


@register("score_events", f"WITH {_EVENTS_SQL} SELECT page, kind, count(*) AS n, sum(score)::BIGINT AS score FROM ev GROUP BY page, kind")
def score_events(spark, sf_dir):
    events = scoring.score_events(_pages(spark, sf_dir), _links(spark, sf_dir))
    return events.groupBy("page", "kind").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


@register("page_score", f"WITH {_EVENTS_SQL} SELECT page, sum(score)::BIGINT AS score FROM ev GROUP BY page HAVING bool_or(kind = 'R')")
def page_score(spark, sf_dir):
    return scoring.final_scores(scoring.score_events(_pages(spark, sf_dir), _links(spark, sf_dir)))


@register(
    "top_pages_by_score",
    f"WITH {_EVENTS_SQL}, s AS (SELECT page, sum(score)::BIGINT AS score FROM ev GROUP BY page HAVING bool_or(kind = 'R')) SELECT page, score FROM (SELECT *, rank() OVER (ORDER BY score DESC) AS r FROM s) WHERE r <= 10",
)
def top_pages_by_score(spark, sf_dir):
    """The flagship: links and sizes to scores, the ten best pages with ties."""
    return ranking.top_with_ties(page_score(spark, sf_dir), "score", 10)


@register(
    "vip_boost",
    """WITH v AS (SELECT doc_id, max(level) AS level FROM (SELECT doc_id, 1 AS level FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 3 FROM labels WHERE toxic = 1) GROUP BY doc_id)
SELECT doc_id, n_chars + coalesce(level, 0) * 100000000 AS score FROM documents LEFT JOIN v USING (doc_id)""",
)
def vip_boost(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "page")
    vip = scoring.vip_levels((labels.filter("quality = 1"), 1), (labels.filter("toxic = 1"), 3)).withColumnRenamed("page", "doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return docs.join(vip, "doc_id", "left").select("doc_id", (F.col("n_chars") + F.coalesce("level", F.lit(0)) * scoring.VIP_SCORE).alias("score"))


@register("top_n_ties", "SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, rank() OVER (ORDER BY n_chars DESC) AS r FROM documents) WHERE r <= 50")
def top_n_ties(spark, sf_dir):
    return ranking.top_with_ties(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", 50)


_CLOSURE_SQL = """e AS (SELECT n_nationkey::VARCHAR AS src, CASE WHEN n_nationkey % 3 = 0 THEN n_regionkey ELSE n_nationkey // 2 END::VARCHAR AS dst FROM nation),
c AS (SELECT src, dst AS cur, [dst] AS path, false AS done FROM e UNION ALL
      SELECT c.src, e.dst, list_append(path, e.dst), list_contains(path, e.dst) FROM c JOIN e ON c.cur = e.src WHERE NOT done),
r AS (SELECT src, cur AS dst FROM c WHERE done OR NOT EXISTS (SELECT 1 FROM e WHERE e.src = c.cur))"""


def _edges(spark, sf_dir):
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.cast("string").alias("src"), F.when(k % 3 == 0, F.col("n_regionkey")).otherwise(F.floor(k / 2)).cast("string").alias("dst"))


@register("redirect_closure", f"WITH RECURSIVE {_CLOSURE_SQL} SELECT src, dst FROM r")
def redirect_closure(spark, sf_dir):
    return scoring.resolve_redirects(_edges(spark, sf_dir))


@register(
    "redirect_transfer",
    f"WITH RECURSIVE {_CLOSURE_SQL}, s AS (SELECT c_nationkey::VARCHAR AS page, sum(c_custkey)::BIGINT AS score FROM customer GROUP BY 1) SELECT dst AS page, sum(score)::BIGINT AS score FROM s JOIN r ON page = src GROUP BY dst",
)
def redirect_transfer(spark, sf_dir):
    scores = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("src")).agg(F.sum("c_custkey").alias("score"))
    moved = scores.join(scoring.resolve_redirects(_edges(spark, sf_dir)), "src")
    return moved.groupBy(F.col("dst").alias("page")).agg(F.sum("score").alias("score"))


@register("same_selection", "SELECT true AS same UNION ALL SELECT false")
def same_selection(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    one = ranking.same_rows(docs, docs.repartition(3, "n_chars"))
    return one.unionByName(ranking.same_rows(docs, docs.unionByName(ranking.top_with_ties(docs, "n_chars", 1))))


@register(
    "missing_links",
    f"WITH {_PAGES_SQL}, ch AS (SELECT DISTINCT page FROM pg WHERE length(page) > 4) SELECT src, dst, count(*) AS n FROM lk WHERE dst NOT IN (SELECT page FROM ch) AND dst NOT IN (SELECT lower(page) FROM ch) GROUP BY src, dst",
)
def missing_links(spark, sf_dir):
    """Links to pages that are not chosen, where the lower-case name of a chosen page redirects to it."""
    chosen = _pages(spark, sf_dir).select("page").filter("length(page) > 4").distinct()
    redirects = chosen.select(F.lower("page").alias("src"), F.col("page").alias("dst")).filter("src <> dst")
    return scoring.missing_links(_links(spark, sf_dir), chosen, redirects).groupBy("src", "dst").agg(F.count("*").alias("n"))


@register(
    "title_union",
    "SELECT title, count(*) AS n FROM (SELECT url AS title FROM pages UNION ALL SELECT p_name FROM part UNION ALL SELECT n_name FROM nation UNION ALL SELECT 'Portal:Start') GROUP BY title",
)
def title_union(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select(F.col(c).alias("title")) for t, c in (("pages", "url"), ("part", "p_name"), ("nation", "n_name"))]
    all_ = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(spark.createDataFrame([("Portal:Start",)], "title string"))
    return all_.groupBy("title").agg(F.count("*").alias("n"))


@register("anti_processed", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_processed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@register("semi_existing", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_existing(spark, sf_dir):
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(good, "doc_id", "left_semi")


@register(
    "fetch_list",
    "SELECT title, 'https://es.wikipedia.org/wiki/' || replace(title, ' ', '%20') AS url, title AS file_name FROM (SELECT DISTINCT p_name AS title FROM part UNION SELECT 'Start') WHERE title NOT IN (SELECT p_name FROM part WHERE p_size > 25)",
)
def fetch_list(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumnRenamed("p_name", "title")
    return readers.fetch_list(part, part.filter("p_size > 25"), ["Start"])


# text, index, search

_TOKENS_SQL = "tk AS (SELECT p_partkey, p_name, p_retailprice, p_size, list_filter(regexp_split_to_array(regexp_replace(lower(strip_accents(p_name)), '[_()]', ' ', 'g'), '\\s+'), lambda w: w <> '') AS words FROM part)"
_SOURCE_SQL = f"""{_TOKENS_SQL},
src AS (SELECT p_name AS title, p_partkey::VARCHAR AS link, 50 + (p_retailprice * 1000)::BIGINT // 1000 AS score, 'of size ' || p_size AS description, words FROM tk),
redir AS (SELECT title, link, score, description, list_reverse(words) AS words FROM src WHERE len(words) > 1 AND list_reverse(words) <> words),
d AS (SELECT *, row_number() OVER (ORDER BY score DESC, title, link, is_redir, words) - 1 AS docid FROM (SELECT *, 0 AS is_redir FROM src UNION ALL SELECT *, 1 FROM redir)),
po AS (SELECT docid, unnest(words) AS word, unnest(range(len(words)))::INTEGER AS pos FROM d),
own AS (SELECT title AS pt, link AS pl, docid AS parent FROM d WHERE is_redir = 0)"""


def _source(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part")
    rows = part.select(
        F.col("p_name").alias("title"), F.col("p_partkey").cast("string").alias("link"),
        (50 + F.floor(F.round(F.col("p_retailprice") * 1000) / 1000)).cast("long").alias("score"),
        F.concat(F.lit("of size "), F.col("p_size").cast("string")).alias("description"), text.tokenize("p_name").alias("orig_words"),
    )
    back = F.reverse("orig_words")
    return rows.withColumn("redir_words", F.when(back != F.col("orig_words"), F.array(back)).otherwise(F.array().cast("array<array<string>>")))


@register("normalize_text", "SELECT doc_id, md5(lower(strip_accents(text))) AS digest FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_text("text").cast("binary")).alias("digest"))


@register("tokens", f"WITH {_TOKENS_SQL} SELECT p_partkey, unnest(words) AS word FROM tk")
def tokens(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(text.tokenize("p_name")).alias("word"))


@register("index_docids", f"WITH {_SOURCE_SQL} SELECT docid, CASE WHEN is_redir = 1 THEN 2 ELSE 0 END AS rtype, len(words) AS n_words, CASE WHEN is_redir = 1 THEN parent END AS orig_docid FROM d JOIN own ON title = pt AND link = pl")
def index_docids(spark, sf_dir):
    return index.Index.create(_source(spark, sf_dir)).docs.select("docid", "rtype", "n_words", "orig_docid")


@register("index_docs_resolved", f"WITH {_SOURCE_SQL} SELECT docid, link, title, score, description, CASE WHEN is_redir = 1 THEN array_to_string(words, ' ') ELSE '' END AS subtitle FROM d")
def index_docs_resolved(spark, sf_dir):
    return index.resolve(index.Index.create(_source(spark, sf_dir)).docs).select("docid", "link", "title", "score", "description", "subtitle")


@register("index_postings", f"WITH {_SOURCE_SQL} SELECT word, docid, pos FROM po")
def index_postings(spark, sf_dir):
    return index.Index.create(_source(spark, sf_dir)).postings


@register("index_keys", f"WITH {_SOURCE_SQL} SELECT DISTINCT word FROM po")
def index_keys(spark, sf_dir):
    return index.Index.create(_source(spark, sf_dir)).keys()


@register("index_items", f"WITH {_SOURCE_SQL} SELECT word, string_agg(docid || ':' || pos, ' ' ORDER BY docid, pos) AS docset FROM po GROUP BY word")
def index_items(spark, sf_dir):
    items = index.Index.create(_source(spark, sf_dir)).items()
    return items.select("word", F.array_join(F.transform("docset", lambda p: F.concat(p["docid"].cast("string"), F.lit(":"), p["pos"].cast("string"))), " ").alias("docset"))


@register("index_size", f"WITH {_SOURCE_SQL} SELECT (SELECT count(*) FROM d) AS n_docs, (SELECT count(*) FROM (SELECT DISTINCT word, docid FROM po)) AS indexed")
def index_size(spark, sf_dir):
    built = index.Index.create(_source(spark, sf_dir))
    return built.docs.agg(F.count("*").alias("n_docs")).crossJoin(built.indexed())  # one row each


@register("delta_encode", f"WITH {_SOURCE_SQL} SELECT word, docid, docid - lag(docid, 1, 0) OVER (PARTITION BY word ORDER BY docid) AS delta FROM (SELECT DISTINCT word, docid FROM po)")
def delta_encode(spark, sf_dir):
    return index.docid_deltas(index.Index.create(_source(spark, sf_dir)).postings)


@register("doc_pages", f"WITH {_SOURCE_SQL} SELECT docid, docid // 512 AS page, docid % 512 AS slot FROM d")
def doc_pages(spark, sf_dir):
    docs = index.Index.create(_source(spark, sf_dir)).docs
    return docs.select("docid", F.floor(F.col("docid") / 512).alias("page"), F.pmod("docid", F.lit(512)).alias("slot"))


_KEYS = ("re", "a")
_MATCH_SQL = f"""{_SOURCE_SQL}, k AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{k}')" for i, k in enumerate(_KEYS))}) v(key_idx, key)),
h AS (SELECT DISTINCT docid, pos, word, key FROM po JOIN k ON contains(word, key)),
m AS (SELECT docid FROM h GROUP BY docid HAVING count(DISTINCT key) = {len(_KEYS)})"""


@register("search_and", f"WITH {_MATCH_SQL} SELECT docid, count(DISTINCT (pos, word)) AS n_hits FROM h WHERE docid IN (SELECT docid FROM m) GROUP BY docid")
def search_and(spark, sf_dir):
    postings = index.Index.create(_source(spark, sf_dir)).postings
    keys = spark.createDataFrame(list(enumerate(_KEYS)), "key_idx int, key string")
    return index.matching_docs(postings, keys).select("docid", F.size("hits").cast("long").alias("n_hits"))


_DISTANCE_SQL = """dp AS (SELECT docid, phrase, len(phrase) AS n, 0 AS step, []::BIGINT[] AS cells FROM ph UNION ALL
  SELECT docid, phrase, n, step + 1, list_append(cells, CASE WHEN step <= n THEN floor(step * pow(25, 1.2))::BIGINT WHEN step % (n + 1) = 0 THEN 200 * (step // (n + 1))
    ELSE least(cells[step - n] + 200, cells[step] + 25, cells[step - n - 1] + (SELECT CASE WHEN key = p THEN 0 WHEN starts_with(p, key) THEN 15 * (length(p) - length(key))
      WHEN contains(p, key) THEN 30 * (length(p) - length(key)) ELSE 30 * (length(p) + length(key)) END FROM (SELECT keys[step // (n + 1)] AS key, phrase[step % (n + 1)] AS p))) END)
  FROM dp, kl WHERE step < (n + 1) * (len(keys) + 1))"""


@register(
    "search_ranked",
    f"""WITH RECURSIVE {_MATCH_SQL}, kl AS (SELECT list(key ORDER BY key_idx) AS keys FROM k),
w AS (SELECT docid, pos, max(word) AS word FROM h GROUP BY docid, pos),
ph AS (SELECT d.docid, list(coalesce(word, '') ORDER BY i) AS phrase FROM (SELECT docid, unnest(range(len(words))) AS i FROM d WHERE docid IN (SELECT docid FROM m)) d LEFT JOIN w ON d.docid = w.docid AND i = w.pos GROUP BY d.docid),
{_DISTANCE_SQL},
ranked AS (SELECT docid, link, title, floor(40000 * pow(docid + 1, -0.5))::BIGINT - CASE WHEN phrase = keys THEN -1000 ELSE cells[-1] END AS rank FROM (SELECT dp.*, keys FROM dp, kl) JOIN d USING (docid) WHERE step = (n + 1) * (len(keys) + 1))
SELECT docid, link, title, rank FROM ranked QUALIFY row_number() OVER (PARTITION BY link ORDER BY rank DESC, docid DESC) = 1 ORDER BY rank DESC, docid DESC LIMIT 500""",
)
def search_ranked(spark, sf_dir):
    found = index.Index.create(_source(spark, sf_dir)).search(" ".join(_KEYS))
    return found.select("docid", "link", "title", F.col("rank").cast("long").alias("rank"))


_CASES = (
    (1, ("ala",), ("ala",)), (2, ("ala",), ("ala", "")), (3, ("conejo",), ("conejo", "")), (4, ("conejo",), ("", "conejo")), (5, ("blanc",), ("", "blanca")),
    (6, ("anc",), ("", "blanca")), (7, ("conejo", "negro"), ("conejo", "negro")), (8, ("negro", "conejo"), ("conejo", "negro")), (9, ("a", "b"), ("abc",)), (10, ("b", "c"), ("bcd",)),
)


@register("weighted_distance", "SELECT * FROM (VALUES (1, -1000), (2, 25), (3, 25), (4, 47), (5, 62), (6, 115), (7, -1000), (8, 225), (9, 230), (10, 230)) v(n, distance)")
def weighted_distance(spark, sf_dir):
    rows = spark.createDataFrame([(n, list(k), list(p)) for n, k, p in _CASES], "n int, keys array<string>, phrase array<string>")
    return rows.select("n", index.weighted_distance(F.col("keys"), F.col("phrase")).alias("distance"))


@register("order_factor", "SELECT p_partkey, floor(40000 * pow(p_partkey + 1, -0.5))::INTEGER AS factor FROM part")
def order_factor(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", index.order_factor(F.col("p_partkey")).alias("factor"))


@register(
    "redirect_words",
    f"WITH {_TOKENS_SQL} SELECT p_size AS page, string_agg(w, '|' ORDER BY w) AS words FROM (SELECT DISTINCT p_size::VARCHAR AS p_size, array_to_string(words, ' ') AS w FROM tk) GROUP BY p_size",
)
def redirect_words(spark, sf_dir):
    redirects = table(spark, sf_dir, "part").select(F.upper("p_name").alias("src"), F.concat(F.col("p_size").cast("string"), F.lit("#part")).alias("dst"))
    out = index.redirect_words(redirects)
    return out.select("page", F.array_join(F.array_sort(F.transform("redir_words", lambda w: F.array_join(w, " "))), "|").alias("words"))


@register("random_doc")
def random_doc(spark, sf_dir):
    return index.Index.create(_source(spark, sf_dir)).random(7)


@register("dedup_latest_per_link", "SELECT lang, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id DESC) = 1")
def dedup_latest_per_link(spark, sf_dir):
    best = table(spark, sf_dir, "documents").groupBy("lang").agg(F.max(F.struct("n_chars", "doc_id")).alias("b"))
    return best.select("lang", "b.doc_id", "b.n_chars")


# names, addresses


@register(
    "name_quoting",
    """WITH n AS (SELECT url AS page, replace(replace(replace(url, '%', '%25'), '.', '%2E'), '/', '%2F') AS f FROM pages)
SELECT page, f AS file_name, substr(f, 1, 1) || '/' || substr(f, 2, 1) || '/' || substr(f, 3, 1) AS dir3, page AS back FROM n""",
)
def name_quoting(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        F.col("url").alias("page"), naming.file_name("url").alias("file_name"), naming.three_dirs("url").alias("dir3"), naming.page_name(naming.file_name("url")).alias("back")
    )


@register(
    "three_dirs",
    "SELECT * FROM (VALUES ('moño', 'm/o/ñ', 'moño'), ('mo', 'm/o/_', 'mo'), ('m', 'm/_/_', 'm'), ('2.3', '2/%/2', '2%2E3'), ('AC/DC', 'A/C/%', 'AC%2FDC'), ('Portal:Cine', 'C/i/n', 'Portal:Cine'), ('Foo:Bar', 'F/o/o', 'Foo:Bar')) v(page, dir3, file_name)",
)
def three_dirs(spark, sf_dir):
    rows = spark.createDataFrame([(p,) for p in ("moño", "mo", "m", "2.3", "AC/DC", "Portal:Cine", "Foo:Bar")], "page string")
    return rows.select("page", naming.three_dirs("page", ["Portal", "Anexo"]).alias("dir3"), naming.file_name("page").alias("file_name"))


@register("title_links", "SELECT p_partkey, upper(substr(t, 1, 1)) || '/' || substr(t, 2, 1) || '/' || substr(t, 3, 1) || '/' || upper(substr(t, 1, 1)) || substr(t, 2) AS link FROM (SELECT p_partkey, replace(p_name, ' ', '_') AS t FROM part)")
def title_links(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", naming.title_link("p_name").alias("link"))


@register("url_unquote", "SELECT page_id, url_decode(replace(u, '+', '%2B')) AS decoded FROM (SELECT page_id, replace(replace(url, '/', '%2F'), 'e', '%65') || '+' AS u FROM pages)")
def url_unquote(spark, sf_dir):
    quoted = F.concat(F.replace(F.replace("url", F.lit("/"), F.lit("%2F")), F.lit("e"), F.lit("%65")), F.lit("+"))
    return table(spark, sf_dir, "pages").select("page_id", naming.url_unquote(quoted).alias("decoded"))


@register("stable_hash", "SELECT * FROM (VALUES ('foobar', 1230399, 9), ('Fóõ_Bàr', 9529361, 23), ('foo%2Fbar', 4076468, 32), ('Argentina', 4112419, 31)) v(name, hash, block)")
def stable_hash(spark, sf_dir):
    rows = spark.createDataFrame([(n,) for n in ("foobar", "Fóõ_Bàr", "foo%2Fbar", "Argentina")], "name string")
    return rows.select("name", naming.stable_hash("name").cast("int").alias("hash"), naming.block_of("name", 42).cast("int").alias("block"))


@register("link_targets", """WITH l AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
SELECT href, CASE WHEN starts_with(href, '/') THEN split_part(substr(href, 2), '#', 1) END AS target FROM l""")
def link_targets(spark, sf_dir):
    hrefs = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).distinct()
    return hrefs.select("href", naming.link_target("href", "/").alias("target"))


_UPLOAD, _REST = "//upload.wikimedia.org", "/api/rest_v1"
_IMAGES = (
    f"{_UPLOAD}/wikipedia/commons/thumb/a/aa/Foo.jpg/250px-Foo.jpg", f"{_UPLOAD}/wikipedia/commons/a/aa/Foo.jpg", f"{_UPLOAD}/wikipedia/commons/x/y",
    "//bits.wikimedia.org/static-1.22abc9x/skins/common/images/zoom-clip.png", f"{_UPLOAD}/wikipedia/es/a/b.png", f"{_UPLOAD}/math/1/2.png",
    "/w/extensions/Map/icon-9.png", f"https://wikimedia.org{_REST}/media/math/render/svg/abc", f"{_REST}/page/graph/png/x.png", "//x.org/Special:CentralAutoLogin/start", "//x.org/y.png", f"{_UPLOAD}/a?b",
)


@register(
    "image_url_map",
    """SELECT * FROM (VALUES
 (0, 'commons/thumb/a/aa/250px-Foo.jpg', 'http:', NULL), (1, 'commons/a/aa/Foo.jpg', 'http:', NULL), (2, NULL, NULL, 'format'), (3, 'mmon/images/zoom-clip.png', 'http:', NULL), (4, 'a/b.png', 'http:', NULL),
 (5, 'math/1/2.png', 'http:', NULL), (6, 'extensions/Map/icon-9.png', 'https', NULL), (7, 'math/render/svg/abc.svg', 'https', NULL), (8, 'graph/png/x.png', 'https', NULL),
 (9, NULL, NULL, 'removed'), (10, NULL, NULL, 'unsupported'), (11, NULL, NULL, 'query')) v(n, dsk, web, problem)""",
)
def image_url_map(spark, sf_dir):
    rows = spark.createDataFrame(list(enumerate(_IMAGES)), "n int, src string").select("n", images.image_paths("src").alias("p"))
    return rows.select("n", "p.dsk", F.substring("p.web", 1, 5).alias("web"), "p.problem")


_CSS = ("/w/load.php?debug=false&amp;modules=first.module&amp;only=styles", "/w/load.php?modules=first.module|second.module&only=styles", "/w/load.php?modules=foo.bar%2Cbaz%7Ca.b.c", "/w/load.php?only=styles")


@register("css_modules", "SELECT * FROM (VALUES ('first.module'), ('second.module'), ('foo.bar'), ('foo.baz'), ('a.b.c')) v(name)")
def css_modules(spark, sf_dir):
    return css.modules(spark.createDataFrame([(x,) for x in _CSS], "link string")).select("name")


@register("css_media", """SELECT * FROM (VALUES ('//a.org/x%20y.png?12', 'http://a.org/x%20y.png?12', 'x y.png'), ('"/static/é.gif"', 'https://w.org/static/é.gif', '.gif'), ('z/b.svg', 'z/b.svg', 'b.svg')) v(raw, url, name)""")
def css_media(spark, sf_dir):
    sheets = spark.createDataFrame([("m", 'a{b:url(//a.org/x%20y.png?12)} c{d:url("/static/é.gif")}'), ("n", "e{f:url(z/b.svg) url(z/b.svg)} g{h:url(http://ns)}")], "name string, css string")
    return css.media(sheets, "https://w.org/", ("http://ns",))


@register("css_retarget", """SELECT * FROM (VALUES ('m', 'a{b:url(/css/images/x.png)} c{d:url()}'), ('n', 'plain'), ('o', 'url(http://ns)')) v(name, css)""")
def css_retarget(spark, sf_dir):
    sheets = spark.createDataFrame([("m", "a{b:url(//a.org/x.png)} c{d:url(none)}"), ("n", "plain"), ("o", "url(http://ns)")], "name string, css string")
    local = spark.createDataFrame([("//a.org/x.png", "x.png")], "raw string, name string")
    return css.retarget(sheets, local, ("http://ns",))


# images, blocks, statistics


@register(
    "image_tiers",
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN idx < n * 5 // 100 THEN 100 WHEN idx < n * 5 // 100 + n * 20 // 100 THEN 75 ELSE 50 END AS scale FROM r WHERE idx < n * 5 // 100 + n * 20 // 100 + n * 60 // 100""",
)
def image_tiers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return images.tiers(ranking.global_index(docs, [F.desc("n_chars"), F.col("doc_id")]), (5, 20, 60, 15)).select("doc_id", "scale")


_PLAN_SQL = """ch AS (SELECT page_id, html, row_number() OVER (ORDER BY length(html) DESC, page_id) - 1 AS idx FROM pages),
im AS (SELECT DISTINCT idx, lower(unnest(regexp_extract_all(html, 'href="/([^"#]*)', 1))) || CASE WHEN page_id % 10 = 0 THEN '.svg' ELSE '.png' END AS dsk FROM ch),
be AS (SELECT dsk, min(idx) AS prio FROM im GROUP BY dsk)"""


def _chosen_images(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, sf_dir, "pages")
    chosen = ranking.global_index(pages.select(F.col("page_id").alias("page"), F.length("html").alias("n")), [F.desc("n"), F.col("page")]).select("page", "idx")
    ending = F.when(F.col("page_id") % 10 == 0, ".svg").otherwise(".png")
    found = F.regexp_extract_all("html", F.lit('href="/([^"#]*)'), F.lit(1))
    return chosen, pages.select(F.col("page_id").alias("page"), F.transform(found, lambda x: F.concat(F.lower(x), ending)).alias("imgs"))


@register("image_best_page", f"WITH {_PLAN_SQL} SELECT dsk, prio FROM be")
def image_best_page(spark, sf_dir):
    chosen, found = _chosen_images(spark, sf_dir)
    return images.best_position(found, chosen)


@register(
    "image_plan",
    f"""WITH {_PLAN_SQL}, o AS (SELECT dsk, row_number() OVER (ORDER BY prio, dsk) - 1 AS i, count(*) OVER () AS n FROM be WHERE dsk NOT LIKE '_%.svg')
SELECT scale, dsk, 'http://x/' || dsk AS web FROM (SELECT dsk, CASE WHEN i < n * 10 // 100 THEN 100 WHEN i < n * 10 // 100 + n * 25 // 100 THEN 75 WHEN i < n * 10 // 100 + n * 25 // 100 + n * 65 // 100 THEN 50 END AS scale FROM o
 UNION ALL SELECT dsk, 100 FROM be WHERE dsk LIKE '_%.svg') WHERE scale IS NOT NULL""",
)
def image_plan(spark, sf_dir):
    chosen, found = _chosen_images(spark, sf_dir)
    urls = found.select(F.explode("imgs").alias("dsk")).distinct().withColumn("web", F.concat(F.lit("http://x/"), "dsk"))
    return images.image_plan(found, chosen, urls, (10, 25, 65, 0))


@register(
    "scale_override",
    """WITH f AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'math/' ELSE 'img/' END || doc_id || CASE doc_id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' ELSE '.GIF' END AS dsk, n_chars FROM documents)
SELECT scale, ext, count(*) AS n FROM (SELECT CASE WHEN dsk LIKE 'math%' OR n_chars < 2048 OR dsk LIKE '%.png' OR dsk LIKE '%.gif' THEN 100 ELSE 50 END AS scale, lower(right(dsk, 4)) AS ext FROM f) GROUP BY scale, ext""",
)
def scale_override(spark, sf_dir):
    i = F.col("doc_id")
    dsk = F.concat(F.when(i % 7 == 0, "math/").otherwise("img/"), i.cast("string"), F.when(i % 3 == 0, ".png").when(i % 3 == 1, ".jpg").otherwise(".GIF"))
    rows = table(spark, sf_dir, "documents").select(dsk.alias("dsk"), "n_chars", F.lit(50).alias("scale"))
    final = rows.select(images.final_scale("scale", "dsk", "n_chars").alias("scale"), text.image_extension("dsk").alias("ext"))
    return final.groupBy("scale", "ext").agg(F.count("*").alias("n"))


_BLOCK_SQL = """b AS (SELECT url AS name, octet_length(encode(html)) AS size, ('0x' || right(md5(url), 6))::BIGINT % (SELECT greatest(1, (count(*) + 19) // 20) FROM pages) AS block, html FROM pages)"""


def _blocks(spark, sf_dir) -> DataFrame:
    items = table(spark, sf_dir, "pages").select(F.col("url").alias("name"), F.col("html").alias("content"))
    redirects = items.select(F.concat(F.lit("r:"), "name").alias("src"), F.col("name").alias("dst"))
    return blocks.to_blocks(items, redirects, 20)


@register("block_hash", f"WITH {_BLOCK_SQL} SELECT block, count(*) AS items, sum(size)::BIGINT AS bytes FROM b GROUP BY block")
def block_hash(spark, sf_dir):
    return blocks.block_stats(_blocks(spark, sf_dir).filter("kind = 'item'")).select("block", "items", "bytes")


@register("block_offsets", f"WITH {_BLOCK_SQL} SELECT block, name, size, (coalesce(sum(size) OVER (PARTITION BY block ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS \"offset\" FROM b")
def block_offsets(spark, sf_dir):
    return blocks.with_offsets(_blocks(spark, sf_dir).filter("kind = 'item'")).select("block", "name", "size", "offset")


@register("block_lookup", "SELECT 'r:' || url AS name, md5(html) AS digest FROM pages UNION ALL SELECT 'nowhere', NULL")
def block_lookup(spark, sf_dir):
    names = table(spark, sf_dir, "pages").select(F.concat(F.lit("r:"), "url").alias("name")).unionByName(spark.createDataFrame([("nowhere",)], "name string"))
    return blocks.lookup(_blocks(spark, sf_dir), names).select("name", F.md5("content").alias("digest"))


@register(
    "revision_choice",
    """WITH r AS (SELECT user_id AS page, event_id AS revid, event_type = 'signup' AS reg, ts, coalesce(lag(ts) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC), TIMESTAMP '2030-01-01') AS until,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT page, coalesce(arg_min(revid, rn) FILTER (WHERE reg OR ts + INTERVAL 7 DAYS < until), arg_max(revid, rn)) AS revid FROM r GROUP BY page""",
)
def revision_choice(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("revid"), (F.col("event_type") == "signup").cast("int").alias("userid"), "ts")
    return scoring.best_revision(rows, "2030-01-01 00:00:00")


@register(
    "prefix_stats",
    "WITH f AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'None' ELSE source END AS root, n_chars AS size FROM documents) SELECT root, count(*) AS n, 100 * count(*) / (SELECT count(*) FROM f) AS n_pct, sum(size)::BIGINT AS bytes, 100 * sum(size)::BIGINT / (SELECT sum(size)::BIGINT FROM f) AS bytes_pct FROM f GROUP BY root HAVING sum(size) >= 100000",
)
def prefix_stats(spark, sf_dir):
    name = F.when(F.col("doc_id") % 5 == 0, F.col("source")).otherwise(F.concat("source", F.lit("~"), F.col("doc_id").cast("string")))
    return stats.prefix_stats(table(spark, sf_dir, "documents").select(name.alias("name"), F.col("n_chars").alias("size")), 100_000)


@register(
    "pivot_formats",
    "SELECT * FROM (SELECT user_id, max(value) FILTER (WHERE event_type = 'click') AS click, max(value) FILTER (WHERE event_type = 'view') AS view, max(value) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY user_id) WHERE click IS NOT NULL AND view IS NOT NULL AND purchase IS NOT NULL",
)
def pivot_formats(spark, sf_dir):
    best = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    return stats.pivot_required(best, "user_id", "event_type", "value", ["click", "view", "purchase"])


@register("disk_blocks", "SELECT count(*) AS files, sum((octet_length(encode(html)) + 511) // 512 * 512)::BIGINT AS bytes FROM pages")
def disk_blocks(spark, sf_dir):
    return table(spark, sf_dir, "pages").agg(F.count("*").alias("files"), F.sum(stats.disk_blocks(F.octet_length("html"))).alias("bytes"))


@register("checklist_numbering", "SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id)::INTEGER AS number, count(*) OVER (PARTITION BY lang) AS total FROM documents")
def checklist_numbering(spark, sf_dir):
    return stats.numbered(table(spark, sf_dir, "documents").select("lang", "doc_id"), "doc_id", "lang").withColumn("number", F.col("number").cast("int"))


@register("completion", "SELECT count(*) FILTER (WHERE quality = 1) * 100 // count(*) AS pct FROM labels")
def completion(spark, sf_dir):
    return stats.completion(table(spark, sf_dir, "labels"), F.col("quality") == 1)


@register("included_share", "SELECT * FROM (VALUES ('cd', 20), ('dvd', 85), ('all', 100)) v(name, share)")
def included_share(spark, sf_dir):
    rows = spark.createDataFrame([("cd", [5, 5, 10, 80]), ("dvd", [5, 20, 60, 15]), ("all", [100, 0, 0, 0])], "name string, r array<int>")
    return rows.select("name", stats.included_share(F.col("r")).alias("share"))


@register("cross_templates", "SELECT r_name, lang FROM region CROSS JOIN (SELECT DISTINCT lang FROM documents)")
def cross_templates(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_name").crossJoin(table(spark, sf_dir, "documents").select("lang").distinct())  # a region and language each


@register("round_robin", "SELECT doc_id, doc_id % (SELECT count(*) FROM labels) AS turn FROM documents")
def round_robin(spark, sf_dir):
    total = table(spark, sf_dir, "labels").agg(F.count("*").alias("total"))
    return table(spark, sf_dir, "documents").select("doc_id").crossJoin(total).select("doc_id", ranking.cycle(F.col("doc_id"), F.col("total")).alias("turn"))


# HTML


@register("page_titles", "SELECT page_id, coalesce(nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), ''), '') AS title FROM pages")
def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.title_of_html("html").alias("title"))


def _parsed(spark, sf_dir) -> DataFrame:
    return html.parse_pages(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("page"), "html"), "/")


@register(
    "page_headings",
    "SELECT page_id::VARCHAR AS page, trim(replace(replace(replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS title FROM pages",
)
def page_headings(spark, sf_dir):
    return _parsed(spark, sf_dir).select("page", "title")


@register("page_parse_links", """SELECT page_id::VARCHAR AS page, len(list_filter(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1), lambda x: starts_with(x, '/')))::INTEGER AS n_links FROM pages""")
def page_parse_links(spark, sf_dir):
    return _parsed(spark, sf_dir).select("page", F.size("links").alias("n_links"))


@register("page_comments", "SELECT page_id::VARCHAR AS page, len(regexp_extract_all(html, '(?s)<!--.*?-->'))::INTEGER AS comments FROM pages")
def page_comments(spark, sf_dir):
    return _parsed(spark, sf_dir).select("page", F.coalesce(F.col("stats")["comments"], F.lit(0)).alias("comments"))


@register("page_clean")
def page_clean(spark, sf_dir):
    return _parsed(spark, sf_dir).select("page", "clean_html", "summary", "is_redirect")


@register("page_rewrite")
def page_rewrite(spark, sf_dir):
    """Cleaned pages with links to pages that aren't chosen marked."""
    pages = _pages(spark, sf_dir)
    named = pages.select(F.col("page_id").cast("string").alias("page"), "html")
    missing = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("page"), F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"#]*)'), F.lit(1))).alias("targets"))
    return html.rewrite_pages(named, missing, prefix="/")


# streaming


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table events as a stream of its files, be it a folder of them or one file."""
    rows, path = table(spark, sf_dir, "events"), f"{sf_dir}/events.parquet"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    stream = spark.readStream.schema(rows.schema)
    return stream.parquet(path) if folder else stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _drain(stream: DataFrame, mode: str) -> DataFrame:
    """All that the stream gives, written to the shared folder batch by batch; of a key's updates the last counts."""
    spark = stream.sparkSession
    out = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/rows/batch_id={n}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("batch_id")


@register("stream_running_totals", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def stream_running_totals(spark, sf_dir):
    """Running counts in update mode; the last update of each user."""
    rows = _drain(_events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n")), "update")
    return rows.groupBy("user_id").agg(F.max_by("n", "batch").alias("n"))


@register("stream_distinct", "SELECT DISTINCT event_type FROM events")
def stream_distinct(spark, sf_dir):
    return _drain(_events(spark, sf_dir).select("event_type").dropDuplicates(["event_type"]), "append").select("event_type")




from pagemill.plans import further  # noqa: E402, F401  registers more of them
