"""Normalisation and tokenisation of titles, and small text functions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.workers import give_back, pieces


def plain(text: str) -> str:
    """Compatibility-decomposed, without combining marks, lower case letter by letter."""
    if text.isascii():
        return text.lower()
    return "".join(c.lower() for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@F.arrow_udf(T.StringType())
def normalize_text(text: pa.Array) -> pa.Array:
    """``plain`` over Arrow batches, piece by piece; a null stays null."""
    batch = pa.RecordBatch.from_arrays([text], ["text"])
    found = [pa.array([None if s is None else plain(s) for s in piece.column(0).to_pylist()], pa.string()) for piece in pieces(batch, 0)]
    out = pa.concat_arrays(found) if found else pa.array([], pa.string())
    del found
    give_back()
    return out


def split_words(normal: Column | str) -> Column:
    """Words of a normalised text: _ ( ) and Unicode white space part them."""
    spaced = F.regexp_replace(normal, "[_()]", " ")
    return F.filter(F.split(spaced, r"(?U)\s+"), lambda w: w != "")


def tokenize(title: Column | str) -> Column:
    return split_words(normalize_text(title))


def shorten(text: Column, most: int = 230) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def encode_base64(text: Column | str) -> Column:
    """Base64 of the UTF-8 bytes, on one line."""
    return F.regexp_replace(F.base64(F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary")), r"[\r\n]", "")


def decode_base64(text: Column | str) -> Column:
    return F.unbase64(text).cast("string")


def date_of(text: Column | str) -> Column:
    return F.to_date(text, "yyyyMMdd")


def _tenths(value: Column) -> Column:
    """A number rounded to one decimal as it stands in memory, halves to the even one; Java's %.1f would take them up."""
    whole = F.floor(value)
    return whole + F.rint((value - whole) * 10) / 10  # what is behind the point is exact, its tenfold for whole bytes too


def size_in_units(size: Column) -> Column:
    """Whole bytes as MB or GB with one decimal; a null stays null."""
    gb = size / F.lit(1024.0**3)
    return F.when(gb >= 1, F.format_string("%.1f GB", _tenths(gb))).when(gb < 1, F.format_string("%.1f MB", _tenths(size / F.lit(1024.0**2))))


def size_of_image(param: Column | str) -> Column:
    """STRUCT<w, h> of a parameter w-h; null parts where they aren't numbers."""
    return F.struct(F.split_part(param, F.lit("-"), F.lit(1)).try_cast("int").alias("w"), F.split_part(param, F.lit("-"), F.lit(2)).try_cast("int").alias("h"))


def mime_type(name: Column | str) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    known = {"css": "text/css", "gif": "image/gif", "html": "text/html", "jpeg": "image/jpeg", "jpg": "image/jpeg", "js": "text/javascript", "png": "image/png", "svg": "image/svg+xml"}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[ext], F.lit("application/octet-stream"))


def image_extension(name: Column | str) -> Column:
    return F.replace(F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1)), F.lit(".jpeg"), F.lit(".jpg"))


def title_of_html(html: Column | str) -> Column:
    """The text of the heading #firstHeading, else of <title>, else an empty text."""
    heading = F.regexp_extract(html, r'(?s)<h1[^>]*id="firstHeading"[^>]*>(.*?)</h1>', 1)
    title = F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)
    return F.coalesce(F.nullif(heading, F.lit("")), F.nullif(title, F.lit("")), F.lit(""))


def page_body(html: Column | str) -> tuple[Column, Column]:
    """(body, problem): from the heading to the print footer; the problem is null, broken or unknown."""
    html = F.col(html) if isinstance(html, str) else html
    pattern = r'(?s)(<h1\b[^>]*\bid="firstHeading"[^>]*>.+?</h1>)(.+?)\s*<div\b[^>]*\bclass="printfooter"'
    head, rest = F.regexp_extract(html, pattern, 1), F.regexp_extract(html, pattern, 2)
    problem = F.when(~F.contains(html, F.lit("</html>")), "broken").when(head == "", "unknown")
    return F.when(problem.isNull(), F.concat_ws("\n", head, rest)), problem


def featured(html: Column | str) -> Column:
    """STRUCT<title, text>: the heading and the paragraphs before the contents, a subheading or a block."""
    pattern = r"(?s)<h1[^>]*>(.*?)</h1>.*?(<p>.*?</p>)\s*(?:<table id=\"toc\"|<h2|<div)"
    title = F.regexp_extract(html, pattern, 1)
    return F.when(title != "", F.struct(title.alias("title"), F.regexp_extract(html, pattern, 2).alias("text")))
