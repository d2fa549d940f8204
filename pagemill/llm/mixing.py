"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.storage import materialise

#: Nested budgets, as shares of the largest mixture that repeats no document.
SHARES = (0.25, 0.5, 1.0)
#: A source is stray if it has less than this share of the tokens of a usual one (the mean size, weighted by tokens).
STRAY = 0.01
#: Level-one buckets of a source: the top bits of a 60-bit hash.
BUCKET_BITS = 16


def token_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r\\f\\x0B]+")), F.lit(0)).cast("long")


def hash60(doc_id: Column) -> Column:
    """60 bits of the MD5 of the decimal doc_id; a null hashes as the empty string."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def thresholds(docs: DataFrame, weights: dict[str, float] | None = None, shares: tuple[float, ...] = SHARES, stray: float = 0.0) -> DataFrame:
    """Hash limits by source: rows (__pm_src, __pm_t1 .. __pm_tk); document h is in budget j iff h <= t_j.

    The token budget of a source is share * scale * weight, where scale is the largest that no source exceeds
    (sources without tokens or with weight 0 don't limit it, nor do those with less than ``stray`` of the tokens of a
    usual source: they run short of their budgets and are used up whole). ``weights`` maps a source to its target weight;
    sources that it doesn't name get weight 0 and are dropped. Without it the weight of a source is the 3/4 power
    of its tokens, which evens out a hot source. A limit is the largest hash of the source up to which, all
    documents of equal hash together, the tokens stay within the budget; -1 if there is none.

    One pass sums tokens by source and bucket. Only documents of the bucket in which a budget ends are read by
    their full hash; nothing is sorted but those and the bucket sums.
    """
    rows = docs.select(F.col("source").alias("s"), hash60(F.col("doc_id")).alias("h"), token_count(F.col("text")).alias("n"))
    rows = materialise(rows, "mix")  # a few bytes a document; each text is read once
    shift = 60 - BUCKET_BITS
    buckets = rows.groupBy("s", F.shiftright("h", shift).alias("k")).agg(F.sum("n").alias("n"), F.max("h").alias("hmax"))
    buckets = materialise(buckets, "buckets")
    sums = buckets.groupBy("s").agg(F.sum("n").cast("double").alias("a"))
    if weights is None:
        sums = sums.withColumn("w", F.sqrt("a") * F.sqrt(F.sqrt("a")))
    else:
        pairs = sums.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "s string, w double")
        sums = sums.join(pairs, "s", "left").fillna(0.0, ["w"])
    counts = (F.col("a") > 0) & (F.col("w") > 0)
    usual = sums.filter(counts).agg((F.sum(F.col("a") * F.col("a")) / F.sum("a")).alias("usual"))
    limiting = sums.filter(counts).crossJoin(usual).filter(F.col("a") >= F.lit(float(stray)) * F.col("usual"))  # usual is one row
    scale = limiting.agg(F.min(F.col("a") / F.col("w")).alias("scale"))
    budgets = sums.crossJoin(scale).select(  # scale is one row
        F.col("s").alias("bs"), F.col("w").alias("bw"),
        F.posexplode(F.array(*[F.floor(F.lit(float(x)) * F.coalesce("scale", F.lit(0.0)) * F.col("w")) for x in shares])).alias("j", "budget"),
    )
    budgets = materialise(budgets, "budgets")
    running = Window.partitionBy("s").orderBy("k")
    run = buckets.withColumn("upto", F.sum("n").over(running)).withColumn("before", F.col("upto") - F.col("n"))
    run = run.join(budgets, F.col("s").eqNullSafe(F.col("bs")))
    whole = run.filter((F.col("upto") <= F.col("budget")) & (F.col("bw") > 0)).groupBy("s", "j").agg(F.max("hmax").alias("t"))
    edge = run.filter((F.col("upto") > F.col("budget")) & (F.col("before") <= F.col("budget")) & (F.col("bw") > 0)).select(
        F.col("s").alias("es"), F.col("k").alias("ek"), "j", "budget", "before"
    )
    edge = materialise(edge, "edge")  # one bucket for each source and budget
    inside = rows.join(edge, F.col("s").eqNullSafe(F.col("es")) & (F.shiftright("h", shift) == F.col("ek")))
    fine = inside.groupBy("s", "j", "h", "budget", "before").agg(F.sum("n").alias("n"))
    fine = fine.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("s", "j").orderBy("h")))
    part = fine.filter("upto <= budget").groupBy("s", "j").agg(F.max("h").alias("t"))
    ends = whole.unionByName(part).groupBy("s", "j").agg(F.max("t").alias("t"))
    columns = [F.coalesce(F.max(F.when(F.col("j") == i, F.col("t"))), F.lit(-1)).alias(f"__pm_t{i + 1}") for i in range(len(shares))]
    return materialise(ends.groupBy(F.col("s").alias("__pm_src")).agg(*columns), "thresholds")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, shares: tuple[float, ...] = SHARES, stray: float = 0.0) -> DataFrame:
    """The documents of the largest budget, with ``mix_tier`` (1: in the smallest budget too) and ``mix_tokens``.

    Documents are filtered against the limits of ``thresholds``, which are joined by source: broadcast while
    their written table is below the session's threshold, else shuffled. Cases: a null source is a source of its
    own; a null or empty text has 0 tokens, a very long one counts whole and stays or goes whole; a null doc_id has one
    fixed hash; repeated rows and rows of equal doc_id share a hash (a tie), so they stay or go together; an empty table
    gives an empty result. Other columns pass through; those named mix_tier or mix_tokens are replaced.
    """
    limits = thresholds(docs, weights, shares, stray)
    docs = docs.drop("mix_tier", "mix_tokens")
    kept = docs.withColumn("__pm_h", hash60(F.col("doc_id"))).join(limits, F.col("source").eqNullSafe(F.col("__pm_src")))
    kept = kept.filter(F.col("__pm_h") <= F.col(f"__pm_t{len(shares)}"))
    tier = F.coalesce(*[F.when(F.col("__pm_h") <= F.col(f"__pm_t{i + 1}"), F.lit(i + 1)) for i in range(len(shares))])
    return kept.select(*[docs[c] for c in docs.columns], tier.alias("mix_tier"), token_count(docs["text"]).alias("mix_tokens"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs, stray=STRAY).select("doc_id", "source", "mix_tokens", "mix_tier")


SQL = """
WITH d AS (
  SELECT doc_id, source, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h,
         coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')), 0)::BIGINT AS mix_tokens FROM documents),
s AS (SELECT source AS bs, sum(mix_tokens)::DOUBLE AS a, sqrt(sum(mix_tokens)::DOUBLE) * sqrt(sqrt(sum(mix_tokens)::DOUBLE)) AS w FROM d GROUP BY source),
b AS (SELECT bs, w, (SELECT min(a / w) FROM s WHERE a > 0 AND w > 0 AND a >= 0.01::DOUBLE * (SELECT sum(a * a) / sum(a) FROM s WHERE a > 0 AND w > 0)) AS scale FROM s),
r AS (SELECT *, sum(mix_tokens) OVER (PARTITION BY source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto FROM d),
t AS (SELECT doc_id, source, mix_tokens, CASE WHEN upto <= floor(0.25::DOUBLE * scale * w) THEN 1
        WHEN upto <= floor(0.5::DOUBLE * scale * w) THEN 2 WHEN upto <= floor(1.0::DOUBLE * scale * w) THEN 3 END AS mix_tier
      FROM r JOIN b ON source IS NOT DISTINCT FROM bs WHERE w > 0)
SELECT doc_id, source, mix_tokens, mix_tier FROM t WHERE mix_tier IS NOT NULL
"""
