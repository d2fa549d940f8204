"""Counts, sizes and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def disk_blocks(size: Column) -> Column:
    """Bytes rounded up to whole blocks of 512."""
    return (F.ceil(size / 512) * 512).cast("long")


def prefix_stats(files: DataFrame, least: int = 1_048_576) -> DataFrame:
    """(root, n, n_pct, bytes, bytes_pct) of files (name, size) by what stands before ~, of roots of ``least`` bytes or more."""
    root = F.when(F.contains("name", F.lit("~")), F.substring_index("name", "~", 1)).otherwise("None")
    sums = files.groupBy(root.alias("root")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    whole = sums.agg(F.sum("n").alias("tn"), F.sum("bytes").alias("tb"))
    out = sums.crossJoin(F.broadcast(whole))  # one row
    return out.filter(F.col("bytes") >= least).select("root", "n", (100 * F.col("n") / F.col("tn")).alias("n_pct"), "bytes", (100 * F.col("bytes") / F.col("tb")).alias("bytes_pct"))


def pivot_required(files: DataFrame, key: str, kind: str, value: str, kinds: list[str]) -> DataFrame:
    """A column for each kind; keys that lack one are left out."""
    wide = files.groupBy(key).pivot(kind, kinds).agg(F.first(value))
    return wide.dropna(subset=kinds)


def release_files(names: DataFrame) -> DataFrame:
    """(lang, version, date, rest) of file names base-lang-version-date-rest."""
    p = lambda i: F.regexp_extract("name", r"^[^-]+-([^-]+)-([^-]+)-([^-]+)-(.+)$", i)
    return names.select("name", p(1).alias("lang"), p(2).alias("version"), F.to_date(p(3), "yyyyMMdd").alias("date"), p(4).alias("rest")).filter("lang <> ''")


def one_release(names: DataFrame) -> DataFrame:
    """(lang, version, date, rest) of the files of one release; files of several languages, versions or dates are an error."""
    rows = release_files(names)
    kinds = rows.agg(F.count_distinct("lang", "version", "date").alias("__pm_kinds"))
    mixed = F.raise_error(F.lit("files of several releases")).cast("string")
    return rows.crossJoin(F.broadcast(kinds)).select(F.when(F.col("__pm_kinds") > 1, mixed).otherwise(F.col("lang")).alias("lang"), "version", "date", "rest")  # one row


def formats_of(files: DataFrame, types: DataFrame) -> DataFrame:
    """(lang, format, size, pages, share), smallest file first: release files (lang, format, size) with what their image
    type (lang, format, page_limit, image_reduction) includes. A file of an unknown type is left out."""
    share = included_share(F.col("image_reduction"))
    return files.join(types, ["lang", "format"]).select("lang", "format", "size", F.col("page_limit").alias("pages"), share.alias("share")).orderBy("size", "lang", "format")


def numbered(rows: DataFrame, order: str, partition: str) -> DataFrame:
    """Rows numbered from 1 within their part, with its total."""
    part = Window.partitionBy(partition)
    return rows.withColumn("number", F.row_number().over(part.orderBy(order))).withColumn("total", F.count("*").over(part))


def completion(rows: DataFrame, done: Column) -> DataFrame:
    """One row (pct): whole per cent of rows that are done."""
    return rows.agg(F.floor(F.count_if(done) * 100 / F.count("*")).cast("long").alias("pct"))


def included_share(reduction: Column) -> Column:
    return F.aggregate(F.slice(reduction, 1, 3), F.lit(0), lambda a, x: a + x)


def digests(files: DataFrame) -> DataFrame:
    """(path, length, md5, sha1) of binary files."""
    return files.select("path", "length", F.md5("content").alias("md5"), F.sha1("content").alias("sha1"))
