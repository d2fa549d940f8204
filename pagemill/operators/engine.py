"""A built corpus: search, articles, images, random pages. And the build itself, from pages to index and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.config import ImageType
from pagemill.functions.naming import page_path
from pagemill.operators import blocks, html, images, index, ranking, scoring
from pagemill.sources.sinks import append_new, exists, once, write_if_changed
from pagemill.storage import materialise

#: Images in a block; pages are blocks.PER_BLOCK to one.
IMAGES_PER_BLOCK = 100


def build(
    pages: DataFrame, path: str, kind: ImageType, vip: DataFrame | None = None, prefix: str = "/wiki/", namespaces: list[str] | None = None,
    files: DataFrame | None = None, site: str = "https://es.wikipedia.org", parse: bool = True,
) -> "Engine":
    """Parse, score, choose and index ``pages`` (page, html) into the folder ``path``.

    What is there is resumed: pages that were parsed before are not parsed again (``parse=False`` takes in no new ones),
    and where the selection comes out the same, with its redirects, index, pages, blocks and image plan stay. ``files``
    (dsk, content) are images at hand: small drawings among them are put into the pages, all are stored in blocks.
    """
    spark = pages.sparkSession
    if parse or not exists(spark, f"{path}/parsed"):
        append_new(pages, f"{path}/parsed", "page", lambda new: html.parse_pages(new, prefix))
    parsed = spark.read.parquet(f"{path}/parsed")
    # a broken redirect, one without a target, is no page and leads nowhere
    redirects = parsed.filter("is_redirect AND redirect_to IS NOT NULL").select(F.col("page").alias("src"), F.substring_index("redirect_to", "#", 1).alias("dst"))
    links = scoring.page_links(parsed.select("page", F.explode("links").alias("l")).select("page", "l.target", "l.classes"))
    bodies = parsed.filter("NOT is_redirect OR redirect_to IS NOT NULL").select("page", "size", F.substring_index("redirect_to", "#", 1).alias("redirect_to"))
    scores = scoring.final_scores(scoring.score_events(bodies, links, vip), redirects)
    best = ranking.top_with_ties(scores, "score", kind.page_limit)
    selection = ranking.global_index(best, [F.desc("score"), F.col("page")]).withColumn("link", page_path("page", namespaces))
    changed = write_if_changed(selection, f"{path}/chosen")
    chosen = spark.read.parquet(f"{path}/chosen")
    moved = materialise(scoring.kept_redirects(scoring.resolve_redirects(redirects), chosen), "redirects")
    changed |= write_if_changed(moved, f"{path}/redirects")
    resolved = spark.read.parquet(f"{path}/redirects")

    def step(name: str, make) -> DataFrame:
        """A finished step stays if the selection is the one it was made for."""
        if changed:
            make().write.mode("overwrite").parquet(f"{path}/{name}")
        return once(f"{path}/{name}", make, spark)

    own = parsed.join(chosen.select("page"), "page", "left_semi")
    each = own.select("page", F.transform(F.array_distinct("images"), lambda s: F.struct(s.alias("src"), images.image_paths(s, site).alias("i"))).alias("found"))
    good = F.filter("found", lambda f: f["i"]["problem"].isNull())
    page_images = each.select("page", F.transform(good, lambda f: f["i"]["dsk"]).alias("imgs"), F.transform(good, lambda f: f["i"]).alias("paths"))

    def ready_pages() -> DataFrame:
        targets = own.select(F.col("page").alias("src"), F.explode("links").alias("l")).select("src", F.col("l.target").alias("dst"))
        gone = scoring.missing_links(targets, chosen, redirects).groupBy(F.col("src").alias("page")).agg(F.collect_set("dst").alias("targets"))
        place = lambda f: F.struct(f["src"].alias("key"), F.struct(f["i"]["dsk"].alias("dsk"), f["i"]["problem"].alias("problem")).alias("value"))
        sources = each.select("page", F.map_from_entries(F.transform("found", place)).alias("sources"))
        embeds = images.page_embeds(page_images, files) if files is not None else None
        return html.rewrite_pages(own.select("page", F.col("clean_html").alias("html")), gone, embeds, prefix, sources)

    ready = step("ready", ready_pages)
    named = ready.select(F.col("page").alias("name"), F.col("html").alias("content"))
    step("blocks", lambda: blocks.to_blocks(named, resolved, names=chosen.select(F.col("page").alias("name"))).repartition("block").sortWithinPartitions("name"))

    def plan() -> DataFrame:
        urls = page_images.select(F.explode("paths").alias("i")).groupBy("i.dsk").agg(F.min("i.web").alias("web"))
        return images.image_plan(page_images, chosen, urls, kind.image_reduction)

    step("images", plan)
    if files is not None:
        stored = files.select(F.col("dsk").alias("name"), "content")
        once(f"{path}/image_blocks", lambda: blocks.to_blocks(stored, per_block=IMAGES_PER_BLOCK).repartition("block").sortWithinPartitions("name"), spark)
    built = None

    def part(name: str) -> DataFrame:
        nonlocal built
        built = built or index.Index.create(index.index_source(chosen.select("page", "link", "score"), parsed.select("page", "title", "summary"), resolved))
        return getattr(built, name)

    step("index/docs", lambda: part("docs"))
    step("index/postings", lambda: part("postings").repartitionByRange("word").sortWithinPartitions("word", "docid"))
    step("index/words", lambda: spark.read.parquet(f"{path}/index/postings").select("word").distinct())
    return Engine(spark, path)


class Engine:
    """Reads what ``build`` wrote."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.index = index.Index.read(spark, f"{path}/index")
        self.blocks, self.images = blocks.Blocks(spark, f"{path}/blocks"), spark.read.parquet(f"{path}/images")
        self.image_blocks = blocks.Blocks(spark, f"{path}/image_blocks") if exists(spark, f"{path}/image_blocks") else None
        self.chosen = spark.read.parquet(f"{path}/chosen")

    def cache(self) -> "Engine":
        """Keep the index in memory, for many searches."""
        for table in (self.index.docs, self.index.postings, self.index.words):
            table.cache()
        return self

    def search(self, text: str, limit: int = index.MAX_RESULTS) -> DataFrame:
        """Results, best first, with the address of each page."""
        return self.index.search(text, limit).withColumn("address", index.result_link("link"))

    def get_articles(self, names: list[str]) -> DataFrame:
        """(name, content) of some names or redirects; null for what there isn't. Only their blocks are read."""
        found = self.blocks.get_many(names)
        return self.spark.createDataFrame([(n, found.get(n)) for n in dict.fromkeys(names)], "name string, content string")

    def get_article(self, name: str) -> str | None:
        """The page of a name or redirect; None if there is none."""
        return self.blocks.get(name)

    def get_image(self, dsk: str, width: int | None = None, height: int | None = None) -> bytes:
        """An image, or an empty drawing of its size."""
        content = self.image_blocks.get(dsk) if self.image_blocks else None
        return blocks.placeholder(width, height) if content is None else bytes(content)

    def featured(self, names: DataFrame, seed: int) -> DataFrame:
        """(name, content) of one of the names (name), all that there is equally likely; broken ones are passed over."""
        found = blocks.lookup(self.blocks.table, names).filter("content IS NOT NULL")
        return ranking.random_rows(found, 1, seed)

    def random(self, seed: int) -> DataFrame:
        return self.index.random(seed)

    def words(self) -> DataFrame:
        return self.index.keys()
