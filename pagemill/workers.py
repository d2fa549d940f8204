"""Memory of Python workers: batches cut into pieces by their text, freed memory given back."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Arrow batches are cut into pieces of about so many characters, so that long texts don't add up.
PIECE_CHARS = 1_500_000
#: The C library's call that gives freed memory back to the system, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Give freed memory of Arrow, numpy and Python back to the system: a worker lives on between tasks and stages, and what
    it keeps adds up with the executor's own memory."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def pieces(batch: pa.RecordBatch, text_at: int = 1):
    """Slices of ``batch``, each of about PIECE_CHARS characters of text; one very long text is a slice by itself."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    block = (np.cumsum(sizes, dtype=np.int64) - sizes) // PIECE_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(int(a), int(b - a))


def by_pieces(batches: Iterator[pa.RecordBatch], one: Callable, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row ``one(*row)`` for each row of the batches, whose second column is the text. A piece's rows are written and
    freed before the next piece, so what a worker holds goes by the piece (or the longest text), not by the batch."""
    for batch in batches:
        for piece in pieces(batch):
            rows = [one(*row) for row in zip(*(c.to_pylist() for c in piece.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            del rows, piece
            gc.collect()  # trees of nodes are circular
            give_back()
