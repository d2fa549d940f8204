"""Python workers hold a piece of a batch, not all that is made of it."""

import pyarrow as pa

from pagemill import workers
from pagemill.functions import text


def test_rows_are_made_piece_by_piece():
    n, half = 6, workers.PIECE_CHARS // 2
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(n)]), pa.array([*["x" * half] * (n - 1), None])], names=["page", "html"])
    seen = []
    schema = pa.schema([("page", pa.string()), ("size", pa.int64()), ("stats", pa.map_(pa.string(), pa.int32()))])
    out = workers.by_pieces(iter([batch, batch.slice(0, 0)]), lambda page, html: seen.append(page) or (page, len(html or ""), [("k", 1)]), schema)
    first = next(out)
    assert 0 < first.num_rows < n and len(seen) == first.num_rows
    rest = list(out)
    assert [p for b in (first, *rest) for p in b.column("page").to_pylist()] == [str(i) for i in range(n)]
    assert rest[-1].schema == schema and rest[-1].column("size").to_pylist()[-1] == 0


def test_texts_are_normalised_piece_by_piece(monkeypatch):
    parts = []

    def pieces(*args):
        for piece in workers.pieces(*args):
            parts.append(piece.num_rows)
            yield piece

    monkeypatch.setattr(text, "pieces", pieces)
    long = "Á" * workers.PIECE_CHARS
    got = text.normalize_text.func(pa.array([long, None, "É", long, ""]))
    assert got.to_pylist() == ["a" * len(long), None, "e", "a" * len(long), ""] and len(parts) > 1
    assert text.normalize_text.func(pa.array([], pa.string())).to_pylist() == []
