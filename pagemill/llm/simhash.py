"""SimHash near-dedup by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import components, count_per_owner, give_back, in_cells, numbered, pairs_within, pieces, runs, small, spread, words
from pagemill.storage import materialise

#: A fingerprint has BITS bits, cut into SEGMENTS segments; fingerprints that share one are linked first.
BITS, SEGMENTS = 256, 9
#: A word weighs as many times more as it has letters, up to so many: short words are mostly those that unrelated
#: texts share, which would bring their fingerprints together (the mean distance is 119 with it, 100 without).
LETTERS = 4
#: Greatest distance of two near copies.
DISTANCE = 40
#: Rows of one key, or fingerprints of one group, that are compared by one task at a time; larger ones are cut into parts.
PART = 2048
#: Fingerprints, up to WIDE of them, are searched by segments that differ in at most one bit, more by fewer, wider segments
#: that differ in at most two: these compare fewer pairs but look into more buckets.
WIDE = 2**21
#: A table of more fingerprints than this is cut by leading bits of the segment, so that a task sees about two times as many.
CELL = 2**20
#: Cells are compared by no more tasks than these; beyond, a task has several, one after the other.
MOST_TASKS = 4096
_F = [f"f{i}" for i in range(BITS // 64)]
#: So many pairs are compared by one numpy call.
_BLOCK = 2**15


def _bits(distinct: pa.Array) -> np.ndarray:
    """BITS random bits of each word as sixteen-bit lanes of 64-bit integers: BITS / 4 of them a word."""
    h = xxhash.xxh3_128_digest
    raw = b"".join(h(w, seed) for w in distinct.to_pylist() for seed in range(BITS // 128))
    bits = np.unpackbits(np.frombuffer(raw, np.uint8)).astype(np.uint16)
    return bits.view(np.uint64).reshape(-1, BITS // 4)


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (n x BITS / 64, int64) and whether a text has any word, without which it has none.

    A word weighs one more than the whole binary logarithm of how often the text has it, times its letters up to
    LETTERS. A bit is set if words of more than half of the weight have it set.
    """
    counts, codes, distinct = words(texts)
    n = len(counts)
    owner, codes, times = count_per_owner(np.repeat(np.arange(n), counts), codes)
    letters = np.minimum(pc.utf8_length(distinct).to_numpy(zero_copy_only=False), LETTERS).astype(np.int64)
    weight = np.frexp(times)[1] * letters[codes]
    ones = np.zeros((n, BITS), np.int64)
    if len(owner):
        table = _bits(distinct)
        block = np.cumsum(weight) // 60_000  # no more than a lane of sixteen bits can count
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(owner)]
        for a, b in zip(cuts, cuts[1:]):
            own, part = owner[a:b], table[codes[a:b]]
            part *= weight[a:b, None].astype(np.uint64)
            heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            ones[own[heads]] += np.add.reduceat(part, heads, axis=0).view(np.uint16).reshape(len(heads), BITS)
    total = np.bincount(owner, weights=weight, minlength=n)
    packed = np.packbits(2 * ones > total[:, None], axis=1)
    return packed.view(np.int64), total > 0


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole):
            prints, full = fingerprints(batch.column(1))
            ids = batch.column(0).filter(pa.array(full))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(prints[full, i]) for i in range(len(_F))]], names=["id", *_F])
        give_back()


def prints(docs: DataFrame) -> DataFrame:
    """Rows (id, f0..f3); documents without doc_id or without a word have none."""
    rows = docs.select(F.col("doc_id").alias("id"), "text").filter("id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(_print_batches, "id long, " + ", ".join(f"{c} long" for c in _F))


def _cuts(segments: int) -> list[tuple[int, int]]:
    """Where each of so many segments of about one width begins, and its width."""
    widths = [BITS // segments + (i < BITS % segments) for i in range(segments)]
    return [(sum(widths[:i]), width) for i, width in enumerate(widths)]


def _window(prints: np.ndarray, at: int, width: int) -> np.ndarray:
    """``width`` bits, 64 at most, from bit ``at`` on of the fingerprints (n x BITS / 64, uint64), as a ring."""
    word, shift = divmod(at, 64)
    value = prints[:, word] >> np.uint64(shift)
    if shift + width > 64:
        value |= prints[:, (word + 1) % len(_F)] << np.uint64(64 - shift)
    return value & np.uint64(2**width - 1)


def _matrix(columns: list) -> np.ndarray:
    return np.stack(columns, axis=1).view(np.uint64)


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under the value of each of its segments: (key, node, f0..f3) from (node, f0..f3)."""
    for batch in batches:
        prints = _matrix([batch.column(i + 1).to_numpy() for i in range(len(_F))])
        for i, (at, width) in enumerate(_cuts(SEGMENTS)):
            key = _window(prints, at, width).astype(np.int64) | i << 32
            yield pa.RecordBatch.from_arrays([pa.array(key), *batch.columns], names=["key", "node", *_F])


_FOUND = "a long, b long, key long"


def _rows(**columns) -> pa.RecordBatch:
    """A batch of _FOUND: a pair (a, b), or a fingerprint b of a run that is still to be compared in parts."""
    n = len(columns["b"])
    arrays = [pa.array(columns[c]) if c in columns else pa.nulls(n, pa.int64()) for c in ("a", "b", "key")]
    return pa.RecordBatch.from_arrays(arrays, names=["a", "b", "key"])


def _tree(ids: np.ndarray, prints: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges of breadth-first trees over the fingerprints that are linked by steps of at most ``distance``."""
    ends: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    left, front = np.arange(len(ids)), []
    while len(left):
        if not front:
            front, left = [left[0]], left[1:]
        at = front.pop()
        near = np.bitwise_count(prints[left] ^ prints[at]).sum(1) <= distance
        found, left = left[near], left[~near]
        front.extend(found)
        ends[0].append(np.full(len(found), ids[at]))
        ends[1].append(ids[found])
    return ends


class _Forest:
    """Links between near fingerprints, run by run; one whose ends earlier ones already join is left out."""

    def __init__(self, distance: int):
        self.distance, self.above = distance, {}

    def _top(self, x: int) -> int:
        above = self.above
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    def add(self, ids: np.ndarray, prints: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """All near pairs of the short runs, and spanning trees of the long ones, that join what was apart."""
        few = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= 16), sizes))
        short = sizes[(sizes > 1) & (sizes <= 16)]
        a, b = [], []
        for i, j in pairs_within(np.cumsum(short) - short, short):
            i, j = few[i], few[j]
            near = np.bitwise_count(prints[i] ^ prints[j]).sum(1) <= self.distance
            a.append(ids[i[near]])
            b.append(ids[j[near]])
        for k in np.flatnonzero(sizes > 16):
            own = slice(heads[k], heads[k] + sizes[k])
            more = _tree(ids[own], prints[own], self.distance)
            a, b = a + more[0], b + more[1]
        if not a:
            return
        ends = np.unique(np.sort(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=1), axis=0)
        new = []
        for x, y in ends.tolist():
            u, v = self._top(x), self._top(y)
            if u != v:
                self.above[v] = u
                new.append((x, y))
        if new:
            a, b = (np.array(c, np.int64) for c in zip(*new))
            yield _rows(a=a, b=b)


def _link(distance: int, keys: int):
    """Links from rows (keys, node, f0..f3), sorted by the first ``keys`` columns, the last of which is given back with
    the fingerprints of runs that are longer than PART."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest(distance)
        for columns, heads, sizes, whole in runs(batches, lambda c: c[:keys], PART if keys == 1 else 2**62):
            if whole:
                yield from forest.add(columns[keys], _matrix(columns[keys + 1 :]), heads, sizes)
            else:
                yield _rows(b=columns[keys], key=columns[0])

    return run


def _degrees(distance: int):
    """(node, n): documents within ``distance`` of it, from rows (root, cell_i, cell_j, part, node, copies, f0..f3)
    sorted by the first three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, heads, sizes, _ in runs(batches, lambda c: c[:3]):
            (_, cell_i, cell_j, part, node, copies), prints = columns[:6], _matrix(columns[6:])
            degree = np.zeros(len(node))
            for i, j in pairs_within(heads, sizes):
                fit = (cell_i[i] == cell_j[i]) | (part[i] != part[j])
                i, j = i[fit], j[fit]
                near = np.bitwise_count(prints[i] ^ prints[j]).sum(1) <= distance
                i, j = i[near], j[near]
                degree += np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
            has = degree > 0
            yield pa.RecordBatch.from_arrays([pa.array(node[has]), pa.array(degree[has].astype(np.int64))], names=["node", "n"])

    return run


_CELL = ("root", "cell_i", "cell_j")


def _in_parts(rows: DataFrame, nodes: DataFrame, distance: int) -> DataFrame:
    """Links among the rows (root, node) of each root, found in cells of two parts."""
    sizes = rows.groupBy("root").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    cells = in_cells(rows.join(sizes, "root"), "root", "parts").join(nodes, "node").select(*_CELL, "node", *_F)
    sorted_cells = cells.repartition(*_CELL).sortWithinPartitions(*_CELL)
    return sorted_cells.mapInArrow(_link(distance, 3), _FOUND).select("a", "b")


class _Search:
    """Finds all pairs at most ``distance`` apart among n fingerprints, in cells that are compared by themselves.

    There are just so many segments that in each such pair some differ in at most ``radius`` bits. More than that: read as a
    ring from a certain one of those on, each run of segments differs in no more than its share of ``distance``, by the
    number of segments (cycle lemma). So pairs whose segments are that near are compared by one word from there on, and what
    is left of them by all. A cell is a segment and two values of its first ``lead`` bits (which differ in at most ``radius``).
    """

    def __init__(self, distance: int, n: int):
        self.distance, self.radius = distance, 1 if n <= WIDE else 2
        self.cuts = _cuts(min(distance // (self.radius + 1) + 1, BITS))
        #: A bucket is named by no more bits of a segment than leave it some tens of fingerprints.
        self.most = max(n.bit_length() - 6, 1)
        self.lead = min(max((n - 1) // CELL, 0).bit_length(), self.most, *(w for _, w in self.cuts))
        leads = range(2**self.lead)
        near = [x for x in leads if x.bit_count() <= self.radius]
        self.pairs = [(a, a ^ x) for a in leads for x in near if a <= a ^ x]
        number = {p: i for i, p in enumerate(self.pairs)}
        #: By the first bits of a segment, the cells that a fingerprint is in.
        self.places = np.array([[number[min(a, a ^ x), max(a, a ^ x)] for x in near] for a in leads], np.int32)
        self.cells = len(self.cuts) * len(self.pairs)

    def key(self, prints: np.ndarray, segment: int) -> tuple[np.ndarray, int]:
        """Its bucket by a segment, and how many bits that has."""
        at, width = self.cuts[segment]
        bits = min(width, self.most)
        return _window(prints, at, bits).astype(np.int64), bits

    def place(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each fingerprint in each of its cells: (cell, node, comp, f0..f3) from (node, comp, f0..f3)."""
        for batch in batches:
            prints = _matrix([batch.column(i + 2).to_numpy() for i in range(len(_F))])
            for segment in range(len(self.cuts)):
                key, bits = self.key(prints, segment)
                places = self.places[key >> bits - self.lead] + np.int32(segment * len(self.pairs))
                for cell in places.T:
                    yield pa.RecordBatch.from_arrays([pa.array(cell), *batch.columns], names=["cell", "node", "comp", *_F])

    def links(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links between different components from rows of ``place``, sorted by cell."""
        for columns, heads, sizes, _ in runs(batches, lambda c: c[:1]):
            for a, n in zip(heads, sizes):
                cell, node, comp, *prints = (c[a : a + n] for c in columns)
                yield from self._cell(int(cell[0]), node, comp, _matrix(prints))
            del columns, cell, node, comp, prints
            give_back()

    def _cell(self, cell: int, node: np.ndarray, comp: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        segment, pair = divmod(cell, len(self.pairs))
        one, two = self.pairs[pair]
        key, bits = self.key(prints, segment)
        order = np.argsort(key, kind="stable")
        key, node, comp, prints = key[order], node[order], comp[order], prints[order]
        starts = np.searchsorted(key, np.arange(2**bits + 1))
        flips = [0, *(1 << i for i in range(bits))]
        flips = np.unique([x ^ y for x in flips for y in (flips if self.radius == 2 else [0])])
        flips = flips[(flips >> bits - self.lead) == one ^ two]
        at, run, length = self.cuts[segment][0], 0, 0
        while run < len(self.cuts) and length + self.cuts[(segment + run) % len(self.cuts)][1] <= 64:
            length, run = length + self.cuts[(segment + run) % len(self.cuts)][1], run + 1
        share = max(run, 1) * self.distance // len(self.cuts)  # of a segment wider than a word, its first 64 bits
        words = _window(prints, at, length or 64)
        top = np.arange(len(node))  # a forest over the rows; rows of one component have one root from the first
        _, first, which = np.unique(comp, return_index=True, return_inverse=True)
        top[comp > 0] = first[which][comp > 0]
        buckets = np.unique(key)
        for bucket in buckets[buckets >> bits - self.lead == one].tolist():
            others = bucket ^ flips
            others = others[others >= bucket] if one == two else others
            begin, size = starts[others], starts[others + 1] - starts[others]
            meet = spread(begin[size > 0], size[size > 0])
            if not len(meet):
                continue
            against = words[meet]
            most = max(_BLOCK // len(meet), 1)
            for a in range(starts[bucket], starts[bucket + 1], most):
                rows = words[a : min(a + most, starts[bucket + 1]), None]
                hit = np.flatnonzero(np.bitwise_count(rows ^ against) <= share)
                if len(hit):
                    i, j = np.divmod(hit, len(meet))
                    yield from self._joined(i + a, meet[j], top, node, prints)

    def _joined(self, i: np.ndarray, j: np.ndarray, top: np.ndarray, node: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of pairs of rows those that are near and join two trees, which ``top`` then has as one."""
        u, v = _root(top, i), _root(top, j)
        i, j = i[u != v], j[u != v]
        near = np.bitwise_count(prints[i] ^ prints[j]).sum(1) <= self.distance
        i, j = i[near], j[near]
        while len(i):
            u, v = _root(top, i), _root(top, j)
            apart = u != v
            i, j, u, v = i[apart], j[apart], u[apart], v[apart]
            below, take = np.unique(np.maximum(u, v), return_index=True)
            top[below] = np.minimum(u, v)[take]  # each root under a lesser one: no rings
            if len(take):
                ends = np.sort(np.stack([node[i[take]], node[j[take]]], axis=1), axis=1)
                yield _rows(a=ends[:, 0], b=ends[:, 1])


def _root(top: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The root of each row's tree; the rows are hung below it."""
    root = top[rows]
    while len(further := np.flatnonzero(top[root] != root)):
        root[further] = top[root[further]]
    top[rows] = root
    return root


def near_links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b), a < b, of rows (node, f0..f3) with fingerprints at most ``distance`` apart, as many as it takes to
    join all that are linked by such pairs into groups. ``nodes`` is a written table with distinct nodes and fingerprints.

    First fingerprints that share one of SEGMENTS segments are compared; what they link are components, and nearly all of a
    large group of near copies is one. Then all pairs of different components are searched (``_Search``): no pair is left
    out, by distance or by the size of a bucket. Pairs that are compared grow with the square of the fingerprints: about
    0.14 of all by segments at distance 1, 0.03 by segments at distance 2. Runs of one shared segment beyond PART rows
    are compared in parts of PART.
    """
    nodes = nodes.select("node", *_F)
    prints = ", ".join(f"{c} long" for c in _F)
    exact = nodes.mapInArrow(_exact, f"key long, node long, {prints}")
    exact = exact.repartition("key").sortWithinPartitions("key")
    first = materialise(exact.mapInArrow(_link(distance, 1), _FOUND), "exact")
    long = _in_parts(first.filter("a IS NULL").select(F.col("key").alias("root"), F.col("b").alias("node")), nodes, distance)
    first = materialise(first.filter("a IS NOT NULL").select("a", "b").unionByName(long).distinct(), "exact_links")
    roots = materialise(components(first).select(F.col("id").alias("node"), (F.col("root") + 1).alias("comp")), "comps")
    placed = nodes.join(small(roots, 16), "node", "left").select("node", F.coalesce("comp", F.lit(0)).alias("comp"), *_F)
    search = _Search(distance, nodes.count())
    cells = placed.mapInArrow(search.place, f"cell int, node long, comp long, {prints}")
    cells = cells.repartitionById(min(search.cells, MOST_TASKS), F.col("cell")).sortWithinPartitions("cell")
    met = materialise(cells.mapInArrow(search.links, _FOUND).select("a", "b"), "met")
    return first.unionByName(met.distinct())


def _placed(docs: DataFrame, distance: int) -> tuple[DataFrame, DataFrame]:
    """Two written tables: (id, node, root) for each document and text, (node, copies, f0..f3) for each fingerprint."""
    found = materialise(prints(docs).distinct(), "prints")
    nodes = numbered(found.groupBy(*_F).agg(F.count("*").alias("copies")), "nodes")
    named = materialise(found.join(nodes, _F).select("id", "node"), "named")
    least = named.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("most")).filter("a <> most")
    same = named.join(least, "id").select("a", F.col("node").alias("b")).filter("a <> b")  # one doc_id with several texts
    roots = components(near_links(nodes, distance).unionByName(same))
    placed = named.join(roots.withColumnRenamed("id", "node"), "node", "left").select("id", "node", F.coalesce("root", "node").alias("root"))
    return materialise(placed, "placed"), nodes


def _copies(placed: DataFrame) -> DataFrame:
    """Rows (id, node, root, first) of the documents that are not the first, by doc_id, of their group."""
    firsts = placed.groupBy("root").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first <> last")
    return placed.join(firsts.select("root", "first"), "root").filter("id <> first")


def duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Rows (doc_id, duplicate_of, n_links): every document that is a near copy, with the least doc_id of its group and
    the number of documents within ``distance`` of it.

    A group is a component of the pairs within ``distance``; documents of one fingerprint are one node of it, so
    groups of exact copies cost no pairs. Links are counted exactly: all fingerprints of a group are compared, in cells
    of two parts. Cases: documents with a null doc_id, or without any word (null and empty texts among them), are copies
    of nothing; a very long text has one fingerprint of all its words; repeated rows are one document; rows of one doc_id
    with other texts link the groups of both, and its links are those of all its texts; ties do not occur, as a
    distance is symmetric; columns other than doc_id and text are not read, so their names can't clash; an empty table
    gives no rows.
    """
    placed, nodes = _placed(docs, distance)
    copies = materialise(_copies(placed), "copies")
    grouped = placed.join(placed.groupBy("root").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x <> y").select("root"), "root", "left_semi")
    members = grouped.select("node", "root").distinct()
    members = members.join(members.groupBy("root").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "root")
    cells = in_cells(members.join(nodes, "node"), "root", "parts").select(*_CELL, "part", "node", "copies", *_F)
    degrees = cells.repartition(*_CELL).sortWithinPartitions(*_CELL).mapInArrow(_degrees(distance), "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    out = copies.join(nodes.select("node", "copies"), "node").join(degrees, "node", "left")
    links = F.sum(F.coalesce("n", F.lit(0)) + F.col("copies") - 1)
    return out.groupBy(F.col("id").alias("doc_id"), F.col("first").alias("duplicate_of")).agg(links.alias("n_links"))


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The documents but for near copies of a document of lesser doc_id; one of each group stays, with all its rows.

    Cases as in ``duplicates``; documents without doc_id or without a word stay, and all columns pass through.
    """
    gone = materialise(_copies(_placed(docs, distance)[0]).select(F.col("id").alias("__pm_gone")).distinct(), "gone")
    return docs.join(small(gone, 16), docs["doc_id"] == F.col("__pm_gone"), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return duplicates(docs)
