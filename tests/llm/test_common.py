import random

import numpy as np
import pyarrow as pa
import pytest

from pagemill.llm import common
from pagemill.storage import materialise


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 50)], [(5, 5)], [], [(1, 2), (2, 1), (1, 2)], [(-7, 3), (3, 9), (100, 101)],
    [(random.Random(k).randrange(300), random.Random(k + 999).randrange(300)) for k in range(200)],
])
def test_components(spark, edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.id, r.root) for r in got) == sorted((x, find(x)) for x in parent)


def test_words():
    counts, codes, distinct = common.words(pa.array(["The cat, the  dog_7!", None, "", "Ünï"]))
    assert counts.tolist() == [5, 0, 0, 1] and [distinct[int(c)].as_py() for c in codes] == ["the", "cat", "the", "dog", "7", "ünï"]


def test_pieces_cover_all():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["x" * n if n is not None else None for n in (0, common.PIECE_CHARS * 2, None, 5, common.PIECE_CHARS)])], names=["i", "t"])
    parts = list(common.pieces(batch))
    assert np.concatenate([p.column(0).to_numpy() for p in parts]).tolist() == [0, 1, 2, 3, 4] and len(parts) > 1
    assert list(common.pieces(batch.slice(0, 0))) == []


def test_small_is_measured(spark):
    table = materialise(spark.range(10).selectExpr("id", "array_repeat(id, 3) AS a"))
    assert "broadcast" in common.small(table, 8)._jdf.queryExecution().toString().lower()
    assert "broadcast" not in common.small(table, common.BROADCAST_BYTES)._jdf.queryExecution().toString().lower()
