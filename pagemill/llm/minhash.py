"""Document fingerprints: MinHash signatures, banded join, verified Jaccard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import components, give_back, in_cells, mix64, numbered, pairs_within, pieces, runs, small, unique_per_owner, word_hashes, words
from pagemill.storage import materialise

#: Words in a shingle; a shorter text is one shingle.
SHINGLE = 3
BANDS, ROWS = 48, 3
#: Bands in which two documents must agree to be compared, and the least Jaccard of a result. One changed word breaks
#: SHINGLE shingles, so two texts that differ in 12 % of their words have a Jaccard of 0.5.
AGREE, JACCARD = 3, 0.5
#: Up to so many sets under one band make pairs; of a longer run each one is only tied to the first, and the pairs are
#: found where the group is compared. Both ways compare every pair that agrees in AGREE bands.
PAIRED = 32
#: Sets in a part of a group, and shingles in it; two parts are compared by one task at a time.
PART_SETS, PART_SHINGLES = 1024, 600_000
_rng = np.random.default_rng(20240607)
#: The permutations x -> a * x + b of 64-bit integers (a odd), of which the upper bits count.
_A = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts (uint64), by owner. Texts without words have none."""
    counts, codes, distinct = words(texts)
    h = word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    size = np.repeat(counts, counts)
    value = np.zeros(len(h), np.uint64)
    for k in range(SHINGLE):
        inside = place + k < size  # a text of fewer words is hashed as far as it goes
        value = mix64(value * np.uint64(3) + np.where(inside, np.roll(h, -k), np.uint64(k + 1)))
    whole = (place + SHINGLE <= size) | (place == 0)
    return unique_per_owner(owner[whole], value[whole])


def signatures(owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The least value of every permutation over each owner's shingles: owners x (BANDS * ROWS), uint32."""
    heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    out = np.full((len(heads), len(_A)), np.uint64(2**64 - 1))
    step = 32768  # shingles at a time, so that they stay in the cache
    first = np.searchsorted(heads, np.arange(0, len(values), step), side="right") - 1
    for n, a in enumerate(range(0, len(values), step)):
        part = values[a : a + step]
        inner = heads[(heads > a) & (heads < a + step)] - a
        cuts = np.r_[0, inner]
        own = first[n] + np.arange(len(cuts))
        for k in range(len(_A)):
            out[own, k] = np.minimum(out[own, k], np.minimum.reduceat(part * _A[k] + _B[k], cuts))
    return (out >> np.uint64(32)).astype(np.uint32)


def _digests(owner: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each owner's set of shingles, as two int64."""
    heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    out = np.zeros((2, n), np.uint64)
    if len(heads):
        for k, salt in enumerate((0, 0x9E3779B97F4A7C15)):
            out[k, owner[heads]] = np.add.reduceat(mix64(values ^ np.uint64(salt)), heads)
    return out[0].view(np.int64), out[1].view(np.int64)


def _band_keys(owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A hash for each band of each owner's signature (owners x BANDS); the lower six bits are the number of the band."""
    sig = signatures(owner, values).astype(np.uint64).reshape(-1, BANDS, ROWS)
    key = np.zeros(sig.shape[:2], np.uint64)
    for r in range(ROWS):
        key = mix64(key * np.uint64(3) + sig[:, :, r] + np.uint64(1))
    return (key << np.uint64(6)) | np.arange(BANDS, dtype=np.uint64)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document with words: its shingles' digest, which equal sets share, and a hash for each band."""
    for whole in batches:
        for batch in pieces(whole):
            owner, values = shingles(batch.column(1))
            if not len(owner):
                continue
            key = _band_keys(owner, values)
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            size = np.diff(np.r_[heads, len(owner)])
            d1, d2 = (d[owner[heads]] for d in _digests(owner, values, batch.num_rows))
            bands = pa.FixedSizeListArray.from_arrays(pa.array(key.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
            ids = batch.column(0).take(pa.array(owner[heads]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(d1), pa.array(d2), pa.array(size.astype(np.int32)), bands], names=["id", "d1", "d2", "n", "bands"])
        give_back()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, n) from rows (key, node) sorted by both: n is in how many keys a pair met, or null for one that only
    ties a set of a long run to the run's first one."""
    first = None
    for (key, node), heads, sizes, whole in runs(batches, lambda c: [c[0]], PAIRED):
        new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]  # else it is a document that is there twice
        key, node = key[new], node[new]
        if whole:
            heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[heads, len(key)])
            met = [(node[i], node[j]) for i, j in pairs_within(heads, sizes)]
            if met:
                a, b = (np.concatenate(x) for x in zip(*met))
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(np.diff(np.r_[at, len(a)]))], names=["a", "b", "n"])
        else:
            if first is None or first[0] != key[0]:
                first = key[0], node[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), first[1])), pa.array(node), pa.nulls(len(node), pa.int64())], names=["a", "b", "n"])


_MEMBER = ["node", "root", "parts", "copies"]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles and bands (lists of long) of the texts whose digest is the wanted one."""
    for whole in batches:
        for batch in pieces(whole, 0):
            owner, values = shingles(batch.column(0))
            counts = np.bincount(owner, minlength=batch.num_rows)
            d = _digests(owner, values, batch.num_rows)
            want = [batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)]
            right = (d[0] == want[0]) & (d[1] == want[1])
            take = right[owner]
            owner, values = owner[take], values[take]
            if not len(owner):
                continue
            keys = _band_keys(owner, values).view(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts[right])].astype(np.int32)), pa.array(values.view(np.int64)))]
            lists.append(pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64())))
            rest = [batch.column(3 + i).filter(pa.array(right)) for i in range(len(_MEMBER))]
            yield pa.RecordBatch.from_arrays([*rest, *lists], names=[*_MEMBER, "s", "bands"])
        give_back()


def _jaccards(lists: pa.ListArray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact Jaccard of pairs of sets, in order of ``left``: the members of one are marked, those of its partners counted."""
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    heads = np.flatnonzero(np.r_[True, left[1:] != left[:-1]])
    marked = np.zeros(codes.max() + 1, np.int64)
    jaccard = np.empty(len(left))
    for at, end in zip(heads, [*heads[1:], len(left)]):
        own = codes[starts[left[at]] : starts[left[at]] + sizes[left[at]]]
        marked[own] = 1
        for lo in range(at, end, 2000):  # partners at a time
            other = right[lo : min(end, lo + 2000)]
            n = sizes[other]
            ends = np.cumsum(n)
            inside = marked[codes[np.arange(ends[-1]) + np.repeat(starts[other] - (ends - n), n)]]
            both = np.add.reduceat(inside, ends - n)
            jaccard[lo : lo + len(other)] = both / (len(own) + n - both)
        marked[own] = 0
    return jaccard


def _compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Links of some whole cells (sorted rows): for each set with links (a, null, documents linked), and for those that
    it takes to join what is linked (a, b, null)."""
    change = np.r_[True, np.zeros(table.num_rows - 1, bool)]
    for c in ("root", "cell_i", "cell_j"):
        change[1:] |= np.diff(table[c].to_numpy()) != 0
    keep = change | np.r_[True, np.diff(table["node"].to_numpy()) != 0]  # else it is a document that is there twice
    table, change = table.filter(pa.array(keep)), change[keep]
    node, part, copies = (table[c].to_numpy() for c in ("node", "part", "copies"))
    across = table["cell_i"].to_numpy() != table["cell_j"].to_numpy()
    bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    heads = np.flatnonzero(change)
    met = []
    for i, j in pairs_within(heads, np.diff(np.r_[heads, len(node)])):
        fit = ~across[i] | (part[i] != part[j])
        i, j = i[fit], j[fit]
        for lo in range(0, len(i), 20_000):
            x, y = i[lo : lo + 20_000], j[lo : lo + 20_000]
            agree = (bands[x] == bands[y]).sum(1) >= AGREE
            met.append((x[agree], y[agree]))
    left, right = (np.concatenate(x) for x in zip(*met)) if met else (np.zeros(0, np.int64),) * 2
    if not len(left):
        return
    near = _jaccards(table["s"].combine_chunks(), left, right) >= JACCARD
    left, right = left[near], right[near]
    degree = np.bincount(left, copies[right], len(node)) + np.bincount(right, copies[left], len(node))
    has = np.flatnonzero(degree)
    above = np.arange(len(node))

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    ties = []
    for x, y in zip(left.tolist(), right.tolist()):
        u, v = top(x), top(y)
        if u != v:
            above[v] = u
            ties.append((x, y))
    a, b = (np.array(x, np.int64) for x in zip(*ties)) if ties else (np.zeros(0, np.int64),) * 2
    none = lambda k: pa.nulls(k, pa.int64())
    columns = [[pa.array(node[has]), none(len(has)), pa.array(degree[has].astype(np.int64))], [pa.array(node[a]), pa.array(node[b]), none(len(a))]]
    for x in columns:
        yield pa.RecordBatch.from_arrays(x, names=["a", "b", "n"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell and node, compared cell by cell, several small cells at a time."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = [batch.column(i).to_numpy() for i in range(3)]
        cuts = np.zeros(batch.num_rows, bool)
        for i, c in enumerate(cell):
            cuts[1:] |= c[1:] != c[:-1]
            cuts[0] |= last is not None and c[0] != last[i]
        last = [c[-1] for c in cell]
        at = 0
        for cut in [*np.flatnonzero(cuts), batch.num_rows]:
            part = batch.slice(at, cut - at)
            if cut > at:
                held.append(part)
                size += part.num_rows
            if cut < batch.num_rows and size >= PART_SETS:
                yield from _compare(pa.Table.from_batches(held))
                held, size = [], 0
            at = cut
    if held:
        yield from _compare(pa.Table.from_batches(held))


def similar_documents(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, class_id, n_links) for each document that is linked to another one: Jaccard JACCARD or more.

    class_id is the least doc_id of those that links join, n_links the number of documents linked to this one. Documents
    of equal shingle sets are one node, which counts for all of them. Signatures of BANDS x ROWS minima are cut into
    bands, and nodes that agree in AGREE bands (0.95 of those at Jaccard 0.5 do, 0.99 at 0.6) are compared exactly.
    Bands are joined by sorting; nodes that met are grouped, and each group is compared in cells of two parts, each of
    about PART_SETS sets or PART_SHINGLES shingles, so neither a task nor the result grows with the square of a group.

    Cases: documents with a null doc_id or no word (null and empty texts) are similar to none; a text of one or two
    words is one shingle; a very long text is one set of all its shingles, a part by itself if need be; repeated rows
    are one document; a doc_id with several texts has the links of all of them and the least of their classes; ties do
    not occur, as a link is symmetric; columns other than doc_id and text are not read, so their names can't clash; an
    empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").alias("id"), "text").filter("id IS NOT NULL AND text IS NOT NULL")
    found = texts.mapInArrow(_bands, "id long, d1 long, d2 long, n int, bands array<long>")
    found = materialise(found, "signatures")
    of = found.groupBy("id", "d1", "d2").agg(F.max("n").alias("n"))
    nodes = numbered(of.groupBy("d1", "d2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.max("n").alias("n")), "sets")
    chosen = found.join(nodes.select("id", "d1", "d2", "node"), ["id", "d1", "d2"])
    keys = chosen.select(F.explode("bands").alias("key"), "node").repartition("key").sortWithinPartitions("key", "node")
    met = materialise(keys.mapInArrow(_meet, "a long, b long, n long"), "met")
    pairs = met.filter("n IS NOT NULL AND a <> b").groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= AGREE)
    roots = materialise(components(pairs.select("a", "b").unionByName(met.filter("n IS NULL").select("a", "b"))), "roots")
    members = nodes.join(roots.withColumnRenamed("id", "node"), "node")
    parts = members.groupBy("root").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / PART_SETS), F.ceil(F.sum("n") / PART_SHINGLES)).cast("int").alias("parts"))
    members = materialise(members.join(parts, "root").select("id", "d1", "d2", "node", "root", "parts", "copies"), "members")
    wanted = texts.join(small(members, 48), "id").select("text", "d1", "d2", "node", "root", "parts", "copies")
    sets = wanted.mapInArrow(_sets, "node long, root long, parts int, copies long, s array<long>, bands array<long>")
    cells = in_cells(sets, "root", "parts").select("root", "cell_i", "cell_j", "node", "part", "copies", "s", "bands")
    cells = cells.repartition("root", "cell_i", "cell_j").sortWithinPartitions("root", "cell_i", "cell_j", "node")
    links = materialise(cells.mapInArrow(_cells, "a long, b long, n long"), "links")
    linked = links.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    tops = components(links.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("id", "node")
    placed = nodes.join(linked.withColumnRenamed("n", "links"), "node", "left").join(tops, "node", "left").filter("links IS NOT NULL OR copies > 1")
    count = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    placed = materialise(placed.select("d1", "d2", "id", F.coalesce("root", "node").alias("top"), count.alias("n_links")), "placed")
    classes = placed.groupBy("top").agg(F.min("id").alias("class_id"))
    out = of.join(placed.join(classes, "top").select("d1", "d2", "class_id", "n_links"), ["d1", "d2"])
    return out.groupBy(F.col("id").alias("doc_id")).agg(F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links"))


def query(spark, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
