"""Documents in hash-partitioned blocks, looked up by name."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions.naming import block_of
from pagemill.operators.scoring import resolve_redirects

PER_BLOCK = 2000


def to_blocks(items: DataFrame, redirects: DataFrame | None = None, per_block: int = PER_BLOCK, drop_lonely: bool = False, names: DataFrame | None = None) -> DataFrame:
    """(block, blocks, name, kind, target, content, size) of items (name, content) and redirects (src, dst) to them.

    The number of blocks follows from the number of items and stands in each row. ``names`` (name) are the items' names
    where those are cheaper to have than the items, which are then computed once. Redirects may stand in a block without
    items; ``drop_lonely`` drops those.
    """
    names = items.select("name") if names is None else names.select("name")
    n = max(1, -(-names.count() // per_block))
    of = F.lit(n).cast("long").alias("blocks")
    real = items.select(block_of("name", n).alias("block"), of, "name", F.lit("item").alias("kind"), F.lit(None).cast("string").alias("target"), "content", F.octet_length("content").cast("long").alias("size"))
    if redirects is None:
        return real
    moved = redirects.join(names.withColumnRenamed("name", "dst"), "dst", "left_semi")
    moved = moved.select(block_of("src", n).alias("block"), of, F.col("src").alias("name"), F.lit("redirect").alias("kind"), F.col("dst").alias("target"), F.lit(None).cast(items.schema["content"].dataType).alias("content"), F.lit(0).cast("long").alias("size"))
    if drop_lonely:
        moved = moved.join(names.select(block_of("name", n).alias("block")).distinct(), "block", "left_semi")
    return real.unionByName(moved)


def with_offsets(blocks: DataFrame) -> DataFrame:
    """The blocks with the offset of each item in its block, in order of name; of one name the smaller comes first, then by
    what is in it, so that the offsets don't depend on how the rows came."""
    before = Window.partitionBy("block").orderBy("name", "size", F.xxhash64("content")).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))


def write_blocks(blocks: DataFrame, path: str) -> None:
    blocks.repartition("block").sortWithinPartitions("block", "name").write.partitionBy("block").parquet(path)


def block_stats(blocks: DataFrame) -> DataFrame:
    """(block, items, redirects, bytes)."""
    item = F.col("kind") == "item"
    return blocks.groupBy("block").agg(F.count_if(item).alias("items"), F.count_if(~item).alias("redirects"), F.sum("size").alias("bytes"))


def block_report(blocks: DataFrame, header: str = "header_bytes", packed: str = "packed_bytes") -> DataFrame:
    """(block, items, redirects, bytes, header_pct, packed_pct): what a block's header, and all of it as it is stored, come
    to in per cent of its items. ``header`` and ``packed`` are columns with the sizes, the same in all rows of a block."""
    sizes = blocks.groupBy("block").agg(F.first(header).alias("h"), F.first(packed).alias("p"))
    out = block_stats(blocks).join(sizes, "block")
    pct = lambda c: F.when(F.col("bytes") > 0, F.round(100.0 * F.col(c) / F.col("bytes"), 2))
    return out.select("block", "items", "redirects", "bytes", pct("h").alias("header_pct"), pct("p").alias("packed_pct"))


class Blocks:
    """Lookup by name in written blocks: only the folders of the names' blocks are read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, spark.read.parquet(path)
        first = self.table.select("blocks").first()
        self.n = int(first["blocks"]) if first else 1

    def find(self, names: list[str]) -> DataFrame:
        """The rows of some names (a list that a person or a request gave), redirects as they stand."""
        where = sorted({int(hashlib.md5(n.encode()).hexdigest()[-6:], 16) % self.n for n in names})
        return self.table.filter(F.col("block").isin(where) & F.col("name").isin(list(names)))

    def get_many(self, names: list[str]) -> dict:
        """The contents of the names that there are, through redirects; one look into the blocks for each hop."""
        ends, out = {n: n for n in names}, {}
        seen: set[str] = set()
        while wanted := {e for n, e in ends.items() if n not in out and e not in seen}:
            seen |= wanted
            rows = {r["name"]: r for r in self.find(sorted(wanted)).select("name", "kind", "target", "content").collect()}
            for name, end in ends.items():
                if (row := rows.get(end)) is None:
                    continue
                if row["kind"] == "item":
                    out[name] = row["content"]
                else:
                    ends[name] = row["target"]
        for name, end in ends.items():  # what another name had found before
            if name not in out and end in out:
                out[name] = out[end]
        return out

    def get(self, name: str):
        """The content of a name, through redirects; None if there is none."""
        return self.get_many([name]).get(name)


def lookup(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """(name, content) of many names at once, redirects resolved; names not found have a null content."""
    ends = resolve_redirects(blocks.filter("kind = 'redirect'").select(F.col("name").alias("src"), F.col("target").alias("dst")))
    wanted = names.select("name").distinct().join(ends, F.col("name") == F.col("src"), "left").select("name", F.coalesce("dst", "name").alias("to"))
    return wanted.join(blocks.filter("kind = 'item'").select(F.col("name").alias("to"), "content"), "to", "left").select("name", "content")


PLACEHOLDER = "<svg xmlns='http://www.w3.org/2000/svg' width='%s' height='%s'><rect width='100%%' height='100%%' fill='none' stroke='gray'/></svg>"


def placeholder(width: str | int | None = None, height: str | int | None = None) -> bytes:
    """An empty drawing of a size, for an image that isn't there."""
    return (PLACEHOLDER % (width or 100, height or 100)).encode()


def lookup_images(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, content) of wanted (name, w, h): the image, or an empty drawing of its size."""
    found = lookup(blocks, wanted)
    drawn = F.format_string(PLACEHOLDER, F.coalesce(F.col("w").cast("string"), F.lit("100")), F.coalesce(F.col("h").cast("string"), F.lit("100")))
    return wanted.join(found, "name", "left").select("name", F.coalesce("content", drawn.cast(blocks.schema["content"].dataType)).alias("content"))
