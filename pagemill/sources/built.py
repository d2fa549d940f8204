"""Readers of finished artefacts in their binary forms: blocks of pages and of images, an index in SQLite, an older index.

Their parts are pickled. They are read without running anything in them: whatever class a pickle names becomes a plain
record of its fields.
"""

from __future__ import annotations

import bz2
import io
import lzma
import os
import pickle
import re
import sqlite3
import struct
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.index import decode_docset

BLOCK = "block long, name string, kind string, target string, content binary, size long, header_bytes long, packed_bytes long"
DOC = "docid long, rtype int, link string, title string, score long, description string, subtitle string, orig_docid long, n_words int"
#: Documents of one row of the SQLite index.
PAGE_DOCS = 512


class _Record:
    def __init__(self, *_):
        pass

    def __setstate__(self, state) -> None:
        for part in state if isinstance(state, tuple) else (state,):
            self.__dict__.update(part or {})


class _Unpickler(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        return _Record


def loads(data: bytes):
    """A pickle as plain values and records."""
    return _Unpickler(io.BytesIO(data), encoding="latin1").load()


def _files(spark: SparkSession, path: str, schema: str, rows: Callable[[str, bytes], Iterator[tuple]]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, content in zip(files["path"], files["content"]):
                yield pd.DataFrame(list(rows(name, content)), columns=names).astype(object)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def _number(name: str) -> int:
    return int(re.search(r"([0-9a-f]+)\.\w+$", name)[1], 16)


def _items(name: str, header: dict, body: bytes, header_bytes: int, packed: int) -> Iterator[tuple]:
    for key, at in header.items():
        if isinstance(at, str):
            yield _number(name), key, "redirect", at, None, 0, header_bytes, packed
        else:
            yield _number(name), key, "item", None, body[at[0] : at[0] + at[1]], at[1], header_bytes, packed


def read_page_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of pages: one LZMA stream of the header's length (four bytes), the header, and the pages end to end."""

    def rows(name: str, content: bytes) -> Iterator[tuple]:
        data = lzma.decompress(content)
        (size,) = struct.unpack("<l", data[:4])
        yield from _items(name, loads(data[4 : 4 + size]), data[4 + size :], 4 + size, len(content))

    return _files(spark, path, BLOCK, rows)


def read_image_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of images: the length of the header (four bytes), the header packed by LZMA, and the images as they are."""

    def rows(name: str, content: bytes) -> Iterator[tuple]:
        (size,) = struct.unpack("<l", content[:4])
        yield from _items(name, loads(lzma.decompress(content[4 : 4 + size])), content[4 + size :], 4 + size, len(content))

    return _files(spark, path, BLOCK, rows)


def _opened(content: bytes, query: str) -> Iterator[tuple]:
    with tempfile.TemporaryDirectory() as folder:  # the library opens files only; nothing is kept there
        at = os.path.join(folder, "index")
        with open(at, "wb") as f:
            f.write(content)
        with sqlite3.connect(f"file:{at}?mode=ro", uri=True) as db:
            yield from db.execute(query)


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(docs, postings) of an index in SQLite, in the form of ``Index``: rows of 512 packed documents, and packed docsets by word."""

    def docs(_: str, content: bytes) -> Iterator[tuple]:
        for page, quants, data in _opened(content, "SELECT pageid, word_quants, data FROM docs ORDER BY pageid"):
            for i, entry in enumerate(loads(lzma.decompress(data))):
                field = entry.__dict__.get
                yield page * PAGE_DOCS + i, field("rtype"), field("link"), field("title"), field("score"), field("description"), field("subtitle") or "", field("orig_docid"), quants[i]

    def postings(_: str, content: bytes) -> Iterator[tuple]:
        for word, data in _opened(content, "SELECT word, docsets FROM tokens"):
            for docid, places in decode_docset(data).items():
                for pos in places:
                    yield word, docid, pos

    return _files(spark, path, DOC, docs), _files(spark, path, "word string, docid long, pos int", postings)


def read_old_index(spark: SparkSession, path: str) -> DataFrame:
    """(link, title, score, is_redir, text) of an older index, a pickled table packed by bzip2: entries without a title and repeated ones left out."""

    def rows(_: str, content: bytes) -> Iterator[tuple]:
        for link, title, score, redir, text in loads(bz2.decompress(content)).values():
            yield link, title, score, bool(redir), text

    found = _files(spark, path, "link string, title string, score long, is_redir boolean, text string", rows)
    return found.filter("title IS NOT NULL AND title <> ''").distinct()


def urls_without_page(urls: DataFrame, blocks: DataFrame, prefix: str = "/wiki/") -> DataFrame:
    """(url) of those asked for (url) whose name no block has: a check of coverage."""
    from pagemill.functions.naming import link_target

    return urls.select("url", link_target("url", prefix).alias("name")).join(blocks.select("name"), "name", "left_anti").select("url")


def find_in_blocks(blocks: DataFrame, part: str) -> DataFrame:
    """(block, name, kind, target, size) of the rows whose name has ``part`` in it."""
    return blocks.filter(F.contains("name", F.lit(part))).select("block", "name", "kind", "target", "size")
