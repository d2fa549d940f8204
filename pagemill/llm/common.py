"""What several operators share: word hashing over Arrow batches and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.storage import materialise
from pagemill.workers import PIECE_CHARS, give_back, pieces  # noqa: F401  for the operators


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Lower-cased words (runs of letters and digits) of each text, in order.

    Returns the number of words of each text, the code of each word, and the distinct words. A null has no words.
    """
    split = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pN]+")
    flat, lengths = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False)
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lengths)), lengths)[full]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    counts = np.bincount(owner, minlength=len(lengths)).astype(np.int64)
    return counts, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def word_hashes(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each distinct word, equal on every machine."""
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w, seed) for w in distinct.to_pylist()), dtype=np.uint64, count=len(distinct))


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (sizes[i] of them) for all i, end to end."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (a bijection) on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def count_per_owner(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, value) pairs in order of owner and value, and how often each occurs."""
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    heads = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])]) if len(owner) else np.zeros(0, np.int64)
    return owner[heads], values[heads], np.diff(np.r_[heads, len(owner)])


def unique_per_owner(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return count_per_owner(owner, values)[:2]


def runs(batches: Iterator[pa.RecordBatch], of: Callable, most: int = 2**62) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, bool]]:
    """Sorted rows, cut between runs of equal keys: (columns, where each run begins, its size, whether the runs are whole).

    ``of`` gives the key columns of some columns. A run of more than ``most`` rows is never held: it comes by itself,
    in pieces that are marked as not whole.
    """
    held: list[list[np.ndarray]] = []
    size, last = 0, None

    def single():
        nonlocal held
        columns, held = [np.concatenate(x) for x in zip(*held)], []
        return columns, np.zeros(1, np.int64), np.array([len(columns[0])])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        keys = of(columns)
        new = np.zeros(n, bool)
        for i, k in enumerate(keys):
            new[1:] |= k[1:] != k[:-1]
            new[0] |= last is None or k[0] != last[i]
        heads = np.flatnonzero(new)
        last = [k[-1] for k in keys]
        first = heads[0] if len(heads) else n
        if first:  # the run before goes on
            held.append([c[:first] for c in columns])
            size += first
            if size > most:
                yield *single(), False
        if not len(heads):
            continue
        if held:
            yield *single(), True
        sizes = np.diff(heads)
        for long in np.flatnonzero(sizes > most):
            yield [c[heads[long] : heads[long + 1]] for c in columns], np.zeros(1, np.int64), sizes[long : long + 1], False
        if len(sizes):
            take = np.repeat(sizes <= most, sizes)
            sizes = sizes[sizes <= most]
            if len(sizes):
                yield [c[first : heads[-1]][take] for c in columns], np.cumsum(sizes) - sizes, sizes, True
        held, size = [[c[heads[-1] :] for c in columns]], n - heads[-1]
        if size > most:
            yield *single(), False
    if held:
        yield *single(), True


def pairs_within(heads: np.ndarray, sizes: np.ndarray, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j of rows of one run, about ``most`` at a time."""
    n = int(sizes.sum())
    follow = np.repeat(heads + sizes, sizes) - np.arange(n) - 1
    ends = np.cumsum(follow)
    cuts = np.searchsorted(ends, np.arange(most, (ends[-1] if n else 0) + most, most), side="left") + 1
    a = 0
    for b in np.minimum(cuts, n):
        if b > a:
            i = np.repeat(np.arange(a, b), follow[a:b])
            if len(i):
                yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(follow[a:b]) - follow[a:b], follow[a:b])
            a = b


def in_cells(members: DataFrame, group: str, parts: Column | str) -> DataFrame:
    """Rows of groups that are split into ``parts`` parts each, once for every pair of parts: adds cell_i, cell_j, part.

    In the cell (i, j) the rows of part i meet those of part j, and in (i, i) each other, so that all pairs of a group
    meet just once and no task sees more than two parts. A row occurs as often as its group has parts.
    """
    parts = F.col(parts) if isinstance(parts, str) else parts
    part = F.pmod(F.xxhash64("node"), parts).cast("int")
    rows = members.withColumn("part", part).withColumn("__pm_other", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))
    return rows.withColumns({"cell_i": F.least("part", "__pm_other"), "cell_j": F.greatest("part", "__pm_other")}).drop("__pm_other")


def numbered(table: DataFrame, label: str) -> DataFrame:
    """``table``, written, with a column node: its rows numbered from 0 without gaps."""
    mask = 2**33 - 1  # monotonically_increasing_id has the row of the partition in its lower 33 bits
    rows = materialise(table.withColumns({"__pm_p": F.spark_partition_id(), "__pm_i": F.monotonically_increasing_id()}), label)
    counts = rows.groupBy("__pm_p").agg(F.count("*").alias("__pm_n"))  # a row for each task
    before = counts.select("__pm_p", (F.sum("__pm_n").over(Window.orderBy("__pm_p")) - F.col("__pm_n")).alias("__pm_before"))
    node = F.col("__pm_before") + F.col("__pm_i").bitwiseAND(F.lit(mask))
    return materialise(rows.join(before, "__pm_p").withColumn("node", node).drop("__pm_p", "__pm_i", "__pm_before"), label)


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): rows (id, root) with the least id of each component.

    Alternating large-star and small-star rounds (Kiveris et al., 2014), each a shuffle of the edges alone, written
    to shared storage; the number of rounds grows with the logarithm of the largest diameter.
    """
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    stamp = None
    for _ in range(max_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u <> v")
            .distinct()
        )
        now = materialise(small, "stars")
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if found == stamp:
            break
        stamp = found
    else:
        raise RuntimeError("connected components did not settle")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)


#: A written table is broadcast if the sizes of its rows come to no more bytes than this; else its join shuffles.
BROADCAST_BYTES = 48_000_000


def small(table: DataFrame, row_bytes: int | Column) -> DataFrame:
    """``table`` (a written one, so that measuring it is cheap), hinted for broadcast if it is checked to be small."""
    size = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    return F.broadcast(table) if (table.agg(F.sum(size.cast("double"))).first()[0] or 0) <= BROADCAST_BYTES else table
