"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read by the next.

All stages keep all columns, null or not, of the documents they keep, and names of theirs can't clash with those of a
stage; an empty table gives an empty one; texts of any length are treated whole. What else becomes of nulls, empty texts,
ties and repeated rows stands with each stage, and in full with its operator.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import bpe, linededup, mixing, quality, simhash
from pagemill.storage import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that are outliers of their language and source go.

    A null language or source is one of its own, a null or empty text counts as one without a character; repeated rows
    and ties are judged alike; groups too small for an estimate stay whole.
    """
    return quality.keep_usual(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: lines that an earlier document has are cut out; documents left without a line go.

    Earlier is by doc_id, null first, then by digest of the text, which settles ties; repeated rows are one document and
    all stay or all are cut alike; null, empty and blank texts stay; n_chars follows the text.
    """
    return linededup.drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each group of near copies stays, the one of least doc_id, with all its rows.

    Documents without doc_id or without a word (null and empty texts) are copies of nothing and stay; a doc_id with several
    texts links the groups of all of them.
    """
    return simhash.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: sources are cut to the largest mixture of the target weights.

    A source of less than ``mixing.STRAY`` of the tokens of a usual one does not limit the others and is used up whole. A null
    source is one of its own; null and empty texts have 0 tokens; rows of one doc_id share a hash, so they stay or
    go together, as do ties; a null doc_id has one fixed hash.
    """
    return mixing.mix(docs, stray=mixing.STRAY).select(*docs.columns)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the columns of documents, with tokens and n_tokens.

    A null text has null tokens, an empty one none, 0 in number; every row, repeated or not, has its own; columns of those
    two names are replaced.
    """
    return bpe.encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("source mixing", source_mixing),
    ("bpe encoding", bpe_encode),
]

#: Quality rules, near-dedup and encoding are no SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, through Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    return docs
