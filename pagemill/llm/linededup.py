"""Exact line dedup over the corpus: the first occurrence of a line stays, as run-length compressed bitmaps."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import give_back, small
from pagemill.storage import materialise

#: Stands for a null doc_id inside this module; a document of this very id counts as one of null id.
NO_ID = -(2**63)
_MARKS = "kind int, h1 long, h2 long, d long, k long, pos int"


def _keys() -> list[Column]:
    """A document is its doc_id and 60 bits of the MD5 of its text."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return [F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long").alias("k")]


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream one sorted range: kind 0 for a line seen before, 1 and 2 for the first line of the first and last run.

    A run of equal hashes may have begun in the range before, so the first line of the first run is settled later.
    """
    names = ["h1", "h2", "d", "k", "pos"]
    first, last, seen = None, None, False  # last: the first line of the current run
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)]
        n = len(cols[0])
        new = np.ones(n, bool)
        new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
        if seen and (cols[0][0], cols[1][0]) == last[:2]:
            new[0] = False
        starts = np.flatnonzero(new)
        at = np.searchsorted(starts, np.arange(n), side="right") - 1  # -1: the run of the batch before
        same = np.ones(n, bool)  # the very line that opened the run, from a repeated row
        for j in (2, 3, 4):
            opener = np.where(at >= 0, cols[j][starts[np.maximum(at, 0)]] if len(starts) else 0, last[j] if seen else 0)
            same &= cols[j] == opener
        if not seen:
            first, seen = tuple(int(c[0]) for c in cols), True
        if len(starts):
            last = tuple(int(c[starts[-1]]) for c in cols)
        drop = np.flatnonzero(~new & ~same)
        if len(drop):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(drop), np.int32))] + [pa.array(c[drop]) for c in cols[:4]] + [pa.array(cols[4][drop].astype(np.int32))], names=["kind", *names]
            )
    if seen:
        ends = [(1, *first), (2, *last)]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ends), types)], names=["kind", *names])


def dropped_lines(docs: DataFrame) -> DataFrame:
    """Rows (d, k, pos) of the lines to drop: equal, but for spaces at either end, to a line earlier in the corpus.

    Earlier is by doc_id (null first), digest of the text, position. Blank lines are never dropped. Lines travel as
    128-bit hashes, range-partitioned by hash, document and position: a line that very many documents share is
    spread over as many ranges as it needs, and the few lines at the range ends are settled in a second step. The text is
    read once; a very long line is one hash like any other, and a text of very many lines as many short rows.
    """
    d, k = _keys()
    own = docs.select(d, k, "text")  # below the generator: beside it, the digest of the text would be made anew for each line
    lines = own.select("d", "k", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    line = F.trim("line")
    hashed = lines.filter(line != "").select(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("pagemill"), line).alias("h2"), "d", "k", "pos")
    hashed = materialise(hashed, "lines")  # ranges are found by a look at the rows, which would split and hash all texts again
    ranged = hashed.repartitionByRange("h1", "h2", "d", "k", "pos").sortWithinPartitions("h1", "h2", "d", "k", "pos")
    marks = materialise(ranged.mapInArrow(_mark, _MARKS), "marks")  # positions of repeated lines alone
    by_hash = Window.partitionBy("e", "h1", "h2")
    start = F.min(F.when(F.col("kind") > 0, F.struct("d", "k", "pos")))
    # only the two lines of each range end meet in the window; the others are partitioned by their document
    ends = F.col("kind") > 0
    late = marks.filter(ends).withColumn("e", F.lit(1)).withColumn("start", start.over(by_hash)).filter((F.col("kind") == 1) & (F.struct("d", "k", "pos") != F.col("start")))
    return marks.filter(~ends).select("d", "k", "pos").unionByName(late.select("d", "k", "pos"))


@F.pandas_udf(T.StringType())
def _runs(n_lines: pd.Series, dropped: pd.Series) -> pd.Series:
    out = []
    for n, gone in zip(n_lines, dropped):
        if gone is None or not len(gone):
            out.append(str(n) if n else "")
            continue
        keep = np.ones(n, bool)
        keep[np.asarray(gone, np.int64)] = False
        cuts = np.flatnonzero(np.diff(keep)) + 1
        runs = np.diff(np.r_[0, cuts, n])
        out.append(("" if keep[0] else "0,") + ",".join(map(str, runs)))
    return pd.Series(out)


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """One row for each document: (doc_id, __pm_k, n_lines, n_kept, keep_runs), no text.

    keep_runs is the bitmap of kept lines, compressed to the lengths of its runs, kept and dropped in turn, the
    first one of kept lines: "3,1,5" keeps three lines, drops one, keeps five. Cases: a null text has no lines and
    an empty bitmap, an empty text one blank line; a very long text has the runs of all its lines; rows of equal doc_id
    and text are one document, rows of equal doc_id and other text are documents of their own (__pm_k tells them apart),
    and their ties are settled by the digest of the text; a null doc_id comes first and stays null; columns other than
    doc_id and text are not read, so their names can't clash; an empty table gives no rows.
    """
    d, k = _keys()
    count = F.coalesce(F.regexp_count("text", F.lit("\n")) + 1, F.lit(0)).cast("long")
    sizes = docs.select(d, k, count.alias("n"), F.lit(None).cast("int").alias("pos"))
    gone = dropped_lines(docs).select("d", "k", F.lit(None).cast("long").alias("n"), "pos")
    grouped = sizes.unionByName(gone).groupBy("d", "k").agg(F.max("n").alias("n"), F.collect_set("pos").alias("p"))
    return grouped.select(
        F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"), F.col("k").alias("__pm_k"), F.col("n").alias("n_lines"),
        (F.col("n") - F.size("p")).alias("n_kept"), _runs(F.col("n"), F.col("p")).alias("keep_runs"),
    )


@F.arrow_udf(T.StringType())
def _without(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """The texts without the lines at the positions ``gone``, in one pass over each; null for a null text."""
    out: list[str | None] = [None] * len(texts)
    for i in np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False)):
        lines = texts[i].as_py().split("\n")
        keep = np.ones(len(lines), bool)
        keep[gone[i].values.to_numpy()] = False
        out[i] = "\n".join(compress(lines, keep))
    give_back()
    return pa.array(out, pa.string())


_once = _without.asNondeterministic()


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents without their dropped lines; one of which no line but blank ones is left goes.

    Documents without dropped lines pass unchanged (blank and null texts among them). The column n_chars, if there
    is one, becomes the length of a text that lost lines; all other columns pass through. Only the positions of dropped lines
    are joined to the texts, and only texts that lose lines are taken apart. Other cases as in ``keep_bitmaps``.
    """
    d, k = _keys()
    gone = dropped_lines(docs).groupBy(F.col("d").alias("__pm_gd"), F.col("k").alias("__pm_gk")).agg(F.array_sort(F.collect_set("pos")).alias("__pm_gone"))
    gone = small(materialise(gone, "gone"), 64 + 4 * F.size("__pm_gone"))
    rows = docs.withColumns({"__pm_d": d, "__pm_k": k})
    joined = rows.join(gone, (F.col("__pm_d") == F.col("__pm_gd")) & (F.col("__pm_k") == F.col("__pm_gk")), "left")
    cut = F.when(F.col("__pm_gone").isNotNull(), F.col("text"))
    # named nondeterministic, which it isn't: else the filter would have it run twice, in a second worker that then lives on beside the first
    joined = joined.withColumn("__pm_text", F.coalesce(_once(cut, F.col("__pm_gone")), F.col("text")))
    joined = joined.filter(F.col("__pm_gone").isNull() | (F.trim(F.translate("__pm_text", "\n", " ")) != ""))
    fresh = F.when(F.col("__pm_gone").isNotNull(), F.length("__pm_text").cast("long"))
    new = {"text": F.col("__pm_text"), "n_chars": F.coalesce(fresh, F.col("n_chars"))}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return keep_bitmaps(docs).drop("__pm_k")


SQL = """
WITH d AS (SELECT DISTINCT doc_id, text, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS k FROM documents),
l AS (SELECT doc_id, k, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d WHERE text IS NOT NULL),
m AS (SELECT doc_id, k, pos, trim(line) = '' OR row_number() OVER (PARTITION BY trim(line) ORDER BY doc_id NULLS FIRST, k, pos) = 1 AS keep FROM l),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, k, keep ORDER BY pos) AS island FROM m),
r AS (SELECT doc_id, k, keep, min(pos) AS start, count(*) AS n FROM g GROUP BY doc_id, k, keep, island),
s AS (SELECT doc_id, k, sum(n)::BIGINT AS n_lines, (sum(n) FILTER (WHERE keep))::BIGINT AS n_kept,
        CASE WHEN arg_min(keep, start) THEN '' ELSE '0,' END || string_agg(n::VARCHAR, ',' ORDER BY start) AS keep_runs FROM r GROUP BY doc_id, k)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_kept, 0)::BIGINT AS n_kept, coalesce(keep_runs, '') AS keep_runs
FROM d LEFT JOIN s ON d.doc_id IS NOT DISTINCT FROM s.doc_id AND d.k = s.k
"""
