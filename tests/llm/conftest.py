import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tokens string, h long, pos string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns that clash with names the operators use."""

    def make(rows):
        return spark.createDataFrame([(i, t, lang, src, len(t or ""), "own", 7, "own") for i, t, lang, src in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000)) + "."
    rows = [
        (1, "One line here.\nand another one, with words.\n\nlast", "en", "a"), (1, "One line here.\nand another one, with words.\n\nlast", "en", "a"),
        (2, None, "en", "a"), (3, "", "en", None), (None, "A text of no document at all.", None, "b"), (None, None, None, None),
        (4, long, "fr", "b"), (5, long, "fr", "b"), (6, "\n\n\n", "de", "b"), (7, "İstanbul   naïve ﬁ 漢字 🎉🎉 é", "tr", "c"),
        (7, "the same id, another text", "tr", "c"), (8, "!!! ??? ...", "en", "a"), (9, "One line here.", "en", "a"), (-3, "  One line here.  ", "en", "a"),
    ]
    return make_docs(rows)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
