"""The registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import bpe, licenses, linededup, minhash, mixing, quality, secrets, simhash, urlfilter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": licenses.query,
        "op2_source_mixing": mixing.query,
        "op3_document_fingerprints": minhash.query,
        "op4_line_dedup": linededup.query,
        "op5_warc_archive": warc.query,
        "op6_url_filter": urlfilter.query,
        "op7_secret_scan": secrets.query,
        "op8_quality_outliers": quality.query,
        "op9_bpe": bpe.query,
        "op10_simhash_near_dedup": simhash.query,
    }


def oracle_sql() -> dict[str, str]:
    """Operators 3, 8, 9 and 10 are no SQL; their tests hold them against brute force, tiktoken or a round trip."""
    return {
        "op1_license_scan": licenses.sql(),
        "op2_source_mixing": mixing.SQL,
        "op4_line_dedup": linededup.SQL,
        "op5_warc_archive": warc.SQL,
        "op6_url_filter": urlfilter.sql(),
        "op7_secret_scan": secrets.sql(),
    }
