"""Readers of the text, JSON, XML and directory formats that the pipeline takes in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions.naming import file_name


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """(title) of a dump of titles, one in a line, gzipped or not; blank lines and the heading page_title are left out."""
    return spark.read.text(path).select(F.trim("value").alias("title")).filter("title NOT IN ('', 'page_title')")


def read_log(spark: SparkSession, path: str, schema: str, sep: str = "|") -> DataFrame:
    """A log of a fixed number of columns."""
    return spark.read.csv(path, sep=sep, quote="", schema=schema)


def read_page_images(spark: SparkSession, path: str) -> DataFrame:
    """(dir3, fname, imgs) of lines dir3|fname|image|image..."""
    parts = F.split("value", r"\|", -1)
    return spark.read.text(path).select(parts[0].alias("dir3"), parts[1].alias("fname"), F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))).alias("imgs"))


def read_scales(spark: SparkSession, path: str) -> DataFrame:
    """(scale, dsk) of lines of a number and a path."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    return spark.read.text(path).select(parts[0].cast("int").alias("scale"), parts[1].alias("dsk"))


def read_namespace_listings(spark: SparkSession, path: str) -> DataFrame:
    """(title) of saved answers of a paged listing; an answer without pages gives none."""
    schema = "query struct<allpages array<struct<title string>>>"
    return spark.read.schema(schema).json(path).select(F.explode("query.allpages.title").alias("title")).select(F.replace("title", F.lit(" "), F.lit("_")).alias("title"))


def parse_histories(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(revisions, errors) of answers (page, json): rows (page, n, revid, userid, ts), and (page, problem) of those without."""
    schema = "query struct<pages map<string, struct<revisions array<struct<revid bigint, userid bigint, timestamp timestamp>>>>>"
    rows = answers.select("page", F.from_json("json", schema)["query"]["pages"].alias("pages"))
    one = rows.select("page", F.get(F.map_keys("pages"), F.lit(0)).alias("id"), F.get(F.map_values("pages"), F.lit(0))["revisions"].alias("revs"))
    problem = F.when(F.col("id").isNull(), "no pages").when(F.col("id") == "-1", "missing").when(F.coalesce(F.size("revs"), F.lit(-1)) < 1, "no revisions")
    one = one.withColumn("problem", problem)
    good = one.filter("problem IS NULL").select("page", F.posexplode("revs").alias("n", "r"))
    return good.select("page", "n", "r.revid", "r.userid", F.col("r.timestamp").alias("ts")), one.filter("problem IS NOT NULL").select("page", "problem")


def read_checklist(spark: SparkSession, path: str, language: str) -> DataFrame:
    """(n, page, check) of the section [language] of a checklist, numbered from 1 as they stand; the check is null if not given.

    A checklist is a small file that a person wrote: it is read as one value.
    """
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("i", "line"))
    line = F.trim("line")
    section = F.nullif(F.regexp_extract(line, r"^\[(.+)\]$", 1), F.lit(""))
    order = Window.partitionBy(F.lit(0)).orderBy("i")
    rows = text.withColumn("section", F.last(section, True).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter((line != "") & section.isNull() & (F.col("section") == language))
    check = F.when(F.contains(line, F.lit("#")), F.trim(F.regexp_extract(line, r"#(.*)$", 1)))
    return rows.select(F.row_number().over(order).cast("int").alias("n"), F.trim(F.substring_index(line, "#", 1)).alias("page"), check.alias("check"))


def read_page_tree(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pages, others) of a tree a/b/c/file: (page file name, html), and the paths that stand elsewhere."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    right = F.rlike("path", F.lit(r"/[^/]/[^/]/[^/]/[^/]+$"))
    pages = files.filter(right).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), F.col("content").cast("string").alias("html"))
    return pages, files.filter(~right).select("path")


def read_xml_pages(spark: SparkSession, path: str, title: str | None = None, part: bool = False) -> DataFrame:
    """(title, text) of a pages dump in XML; of one title, or of all that contain it."""
    schema = "title string, revision struct<text string>"
    rows = spark.read.schema(schema).xml(path, rowTag="page").select("title", F.col("revision.text").alias("text"))
    return rows if title is None else rows.filter(F.contains("title", F.lit(title)) if part else F.col("title") == title)


def fetch_list(titles: DataFrame, have: DataFrame, include: list[str] = (), limit: int | None = None, site: str = "https://es.wikipedia.org") -> DataFrame:
    """(title, url) still to be fetched: titles and those to include, once each, less those at hand (title); a limit of n gives n - 1."""
    spark = titles.sparkSession
    rows = titles.select("title")
    if include:
        rows = rows.unionByName(spark.createDataFrame([(t,) for t in include], "title string"))
    rows = rows.filter("title <> 'page_title'").distinct().join(have.select("title"), "title", "left_anti")
    if limit is not None:
        rows = rows.orderBy("title").limit(max(0, limit - 1))
    quoted = F.replace(F.url_encode("title"), F.lit("+"), F.lit("%20"))
    return rows.select("title", F.concat(F.lit(site + "/wiki/"), quoted).alias("url"), file_name("title").alias("file_name"))


def list_releases(spark: SparkSession, path: str) -> DataFrame:
    """(name, length) of the files of a folder."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", "content")


def read_css_links(spark: SparkSession, path: str) -> DataFrame:
    """(link) of a file of addresses of style sheets, one in a line; blank ones are left out."""
    return spark.read.text(path).select(F.trim("value").alias("link")).filter("link <> ''")
