"""Total orders without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.storage import materialise


def global_index(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """``df`` with the position (from 0) of each row in a total order.

    The rows are range-partitioned and sorted; only the number of rows in each range meets in one place. Give an
    order without ties, or equal rows share out their positions arbitrarily.
    """
    local = materialise(df.orderBy(*order).withColumn("__pm_id", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__pm_id", 33)
    sizes = local.groupBy(part.alias("__pm_part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__pm_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialise(sizes.select("__pm_part", before.alias("__pm_before")), "offsets")
    placed = local.withColumn("__pm_part", part).join(offsets, "__pm_part")
    return placed.withColumn(name, F.col("__pm_before") + F.col("__pm_id").bitwiseAND(F.lit(2**33 - 1))).select(*df.columns, name)


def top_with_ties(df: DataFrame, score: str, n: int | None) -> DataFrame:
    """The n rows of highest score and all that equal the last of them; all rows if n is None, none if it is 0.

    The n-th score is found by a distributed top-n and joined back as one row.
    """
    if n is None:
        return df
    if n <= 0:
        return df.limit(0)
    last = df.select(score).orderBy(F.desc_nulls_last(score)).limit(n).agg(F.min(score).alias("__pm_least"))
    return df.join(F.broadcast(last), F.col(score) >= F.col("__pm_least")).drop("__pm_least")  # last is one row


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (same): whether the two have equal rows, repeated ones counted."""
    columns = a.columns
    counts = a.withColumn("__pm_w", F.lit(1)).unionByName(b.withColumn("__pm_w", F.lit(-1))).groupBy(*columns).agg(F.sum("__pm_w").alias("w"))
    return counts.agg((F.coalesce(F.max(F.abs("w")), F.lit(0)) == 0).alias("same"))


def random_rows(df: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows, all equally likely."""
    return df.orderBy(F.rand(seed)).limit(n)


def cycle(n: Column, total: Column) -> Column:
    """Round robin: the place of turn n among ``total``."""
    return F.pmod(n, total)


def random_there(wanted: DataFrame, there: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n of the wanted rows, all that are also there (by ``key``) equally likely: broken ones are passed over, not drawn."""
    return random_rows(wanted.join(there.select(key).distinct(), key, "left_semi"), n, seed)


def picked(df: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """The rows whose column matches one of the patterns: a hand-picked sample."""
    return df.filter(F.rlike(column, F.lit("|".join(f"(?:{p})" for p in patterns)))) if patterns else df.limit(0)
