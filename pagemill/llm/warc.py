"""A content-addressed archive of WARC records."""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = "record_id string, header binary, payload binary"


def records_of_pages(pages: DataFrame) -> DataFrame:
    """One record (record_id, header, payload) for each row of ``pages``: a WARC/1.0 resource record, exact to the byte.

    A null url or page_id leaves its header line out; a null html makes a payload of no bytes.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    end = F.lit("\r\n")
    name = F.sha2(F.concat_ws("|", F.col("page_id").cast("string"), F.col("url")), 256)
    uuid = F.concat_ws("-", *[F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    lines = [
        F.lit("WARC/1.0"), F.lit("WARC-Type: resource"), F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), uuid, F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")), F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.octet_length(payload).cast("string")),
    ]
    header = F.concat(F.concat_ws("\r\n", *lines), end, end).cast("binary")
    return pages.select(F.col("page_id").cast("string").alias("record_id"), header.alias("header"), payload.alias("payload"))


def _header(source: BinaryIO) -> bytes:
    """The next header with its blank line; nothing at the end. Blank lines before it belong to the record before."""
    line = source.readline()
    while line == b"\r\n":
        line = source.readline()
    out = [line]
    while line not in (b"\r\n", b""):
        line = source.readline()
        out.append(line)
    if out[0] and line == b"":
        raise ValueError("header is cut short")
    return b"".join(out)


def parse(source: BinaryIO) -> Iterator[tuple[bytes, bytes]]:
    """(header with its blank line, payload) of the records of a WARC file as a stream; one record is held at a time.

    A record without a valid Content-Length, or cut short, is an error.
    """
    while header := _header(source):
        fields = dict(line.split(b":", 1) for line in header.split(b"\r\n")[1:] if b":" in line)
        size = int({k.strip().lower(): v for k, v in fields.items()}[b"content-length"])
        payload = source.read(size)
        if len(payload) < size:
            raise ValueError("record is cut short")
        yield header, payload


#: Bytes of payload that a reader hands on at a time.
_BATCH = 16_000_000


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files at ``path``, gzipped by record or not; record_id is the file and the number in it.

    A file is one task's work. It is read as a stream from the file system that its path names, and handed on in batches
    of about 16 MB, so a task holds no more than those or one record. Hadoop lists the files but doesn't read them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for names in batches:
            for name in names["path"]:
                system, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
                with system.open_input_stream(at, compression=None) as raw:
                    buffered = io.BufferedReader(raw, 1 << 20)
                    source = gzip.GzipFile(fileobj=buffered) if buffered.peek(2)[:2] == b"\x1f\x8b" else buffered
                    rows, size = [], 0
                    for i, (header, payload) in enumerate(parse(source)):
                        rows.append((f"{name}#{i}", header, payload))
                        size += len(payload)
                        if size > _BATCH:
                            yield pd.DataFrame(rows, columns=["record_id", "header", "payload"])
                            rows, size = [], 0
                    yield pd.DataFrame(rows, columns=["record_id", "header", "payload"])

    return files.mapInPandas(run, RECORDS)


def digest(payload: Column) -> Column:
    return F.sha2(payload, 256)


def archive(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads): headers (record_id, header, digest) for each record, payloads (digest, payload, size) once.

    The digest is verified: rows of one SHA-256 must agree in length and in a second digest (MD5), else the job
    fails rather than store one payload for another. Cases: a null payload is stored as no bytes; repeated rows keep
    a header each; a null header or record_id stays null; a very long payload is one value like any other; payloads of
    equal bytes (ties) are one; further columns are left out, so their names can't clash; an empty table gives two empty ones.
    """
    payload = F.coalesce("payload", F.lit(b""))
    rows = records.select("record_id", "header", payload.alias("payload"), digest(payload).alias("digest"))
    headers = rows.select("record_id", "header", "digest")
    same = (F.min(F.length("payload")) == F.max(F.length("payload"))) & (F.min(F.md5("payload")) == F.max(F.md5("payload")))
    stored = rows.groupBy("digest").agg(F.first("payload").alias("payload"), same.alias("same"))
    checked = F.when(F.col("same"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads of one SHA-256")).cast("binary"))
    return headers, stored.select("digest", checked.alias("payload"), F.length("payload").alias("size"))


def reconstruct(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """(record_id, digest, record): the original bytes, header then payload then the blank lines between records.

    A payload that no longer has its digest fails the job, and so does a record whose payload is missing.
    """
    joined = headers.join(payloads.withColumn("__pm_there", F.lit(True)), "digest", "left")
    sound = F.col("__pm_there").isNotNull() & (digest(F.col("payload")) == F.col("digest"))
    payload = F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload missing or damaged: "), F.col("digest"))).cast("binary"))
    record = F.concat(F.coalesce("header", F.lit(b"")), payload, F.lit(b"\r\n\r\n"))
    return joined.select("record_id", "digest", record.alias("record"))


def write_archive(records: DataFrame, path: str) -> None:
    headers, payloads = archive(records)
    payloads.write.parquet(f"{path}/payloads")
    headers.write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return reconstruct(spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads"))


def query(spark, sf_dir: str) -> DataFrame:
    """Archives all pages and rebuilds their records from the two tables; the record is returned as text."""
    records = records_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    rebuilt = reconstruct(*archive(records))
    return rebuilt.select("record_id", "digest", F.col("record").cast("string").alias("record"))


SQL = """
WITH p AS (SELECT *, sha256(concat_ws('|', page_id::VARCHAR, url)) AS u, coalesce(html, '') AS body FROM pages)
SELECT page_id::VARCHAR AS record_id, sha256(body) AS digest,
  concat_ws(chr(13) || chr(10), 'WARC/1.0', 'WARC-Type: resource',
    'WARC-Record-ID: <urn:uuid:' || concat_ws('-', substr(u, 1, 8), substr(u, 9, 4), substr(u, 13, 4), substr(u, 17, 4), substr(u, 21, 12)) || '>',
    'WARC-Target-URI: ' || url, 'X-Page-ID: ' || page_id::VARCHAR, 'Content-Type: text/html; charset=utf-8',
    'Content-Length: ' || octet_length(encode(body))::VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || body || chr(13) || chr(10) || chr(13) || chr(10) AS record
FROM p
"""
