"""Plug-in processors of pages: each gives a score, may discard the page, and may score others."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.workers import by_pieces

#: page, html -> (score or None to discard the page, [(other page, score)])
Processor = Callable[[str, str], tuple[int | None, list[tuple[str, int]]]]

_OUT = T.StructType([
    T.StructField("page", T.StringType()), T.StructField("score", T.LongType()), T.StructField("discarded_by", T.StringType()), T.StructField("error", T.StringType()),
    T.StructField("extras", T.ArrayType(T.StructType([T.StructField("page", T.StringType()), T.StructField("score", T.LongType())]))),
])
_OUT_ARROW = pa.schema([
    ("page", pa.string()), ("score", pa.int64()), ("discarded_by", pa.string()), ("error", pa.string()),
    ("extras", pa.list_(pa.struct([("page", pa.string()), ("score", pa.int64())]))),
])


def run_processors(pages: DataFrame, processors: dict[str, Processor], known_errors: tuple[type[Exception], ...] = ()) -> DataFrame:
    """(page, score, discarded_by, error, extras) of pages (page, html), each run through the processors in order.

    A processor that gives None discards the page: later ones don't see it, what was given to others before stays.
    A known error is kept as the row's error; any other fails the job.
    """

    def one(page: str, html: str) -> tuple:
        total, extras = 0, []
        for name, process in processors.items():
            try:
                score, others = process(page, html or "")
            except known_errors as e:
                return page, None, None, f"{name}: {type(e).__name__}: {e}", [{"page": p, "score": s} for p, s in extras]
            extras += others
            if score is None:
                return page, None, name, None, [{"page": p, "score": s} for p, s in extras]
            total += score
        return page, total, None, None, [{"page": p, "score": s} for p, s in extras]

    return pages.select("page", "html").mapInArrow(lambda batches: by_pieces(batches, one, _OUT_ARROW), _OUT)


def events_of(processed: DataFrame) -> DataFrame:
    """(page, kind, score): R rows of the pages that were kept, E rows of all that were given to others."""
    real = processed.filter("score IS NOT NULL").select("page", F.lit("R").alias("kind"), "score")
    extra = processed.select(F.explode("extras").alias("e")).select("e.page", F.lit("E").alias("kind"), "e.score")
    return real.unionByName(extra)


def sum_stats(parsed: DataFrame, column: str = "stats") -> DataFrame:
    """(stat, n): the counters of all pages together."""
    return parsed.select(F.explode(column).alias("stat", "n")).groupBy("stat").agg(F.sum("n").alias("n"))


def observed(df: DataFrame, name: str, bad) -> tuple[DataFrame, object]:
    """``df`` that counts its rows and its bad ones as it runs, and where to read the counts afterwards."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("bad")), seen
