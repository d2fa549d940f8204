"""Names, file names, links and hashes of pages, as Column expressions."""

from __future__ import annotations

from urllib.parse import quote as _quote
from urllib.parse import unquote as _unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def file_name(page: Column | str) -> Column:
    """The page name with %, . and / as %25, %2E and %2F. Reversible."""
    out = F.replace(_col(page), F.lit("%"), F.lit("%25"))
    out = F.replace(out, F.lit("."), F.lit("%2E"))
    return F.replace(out, F.lit("/"), F.lit("%2F"))


def url_unquote(text: Column | str) -> Column:
    """Percent-decoding that keeps + and leaves a text with a bad escape as it is. Stays in the JVM."""
    text = _col(text)
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


@F.pandas_udf(T.StringType())
def url_unquote_lenient(text: pd.Series) -> pd.Series:
    """Percent-decoding that decodes the good escapes of a text and keeps the bad ones."""
    return text.map(lambda s: None if s is None else _unquote(s))


@F.pandas_udf(T.StringType())
def url_quote(text: pd.Series) -> pd.Series:
    """Percent-encoding of all but letters, digits, _.-~ and /."""
    return text.map(lambda s: None if s is None else _quote(s))


def unquote_plus(text: Column | str) -> Column:
    """A form value: + is a space, then percent-decoding; as it is if an escape is bad."""
    return F.coalesce(F.try_url_decode(_col(text)), F.replace(_col(text), F.lit("+"), F.lit(" ")))


def page_name(file: Column | str) -> Column:
    """The inverse of file_name."""
    return url_unquote(file)


def three_dirs(page: Column | str, namespaces: list[str] | None = None) -> Column:
    """The directory a/b/c of a page: the first three characters of its file name, _ for each missing one.

    A namespace of the list before the first colon doesn't count. Null for an empty page.
    """
    name = file_name(page)
    if namespaces:
        cut = F.substring_index(name, ":", 1)
        known = F.contains(name, F.lit(":")) & cut.isin(*namespaces)
        name = F.when(known, F.substring(name, F.instr(name, ":") + 1, F.length(name))).otherwise(name)
    part = [F.substring(name, i, 1) for i in (1, 2, 3)]
    dirs = F.concat_ws("/", *[F.when(p == "", F.lit("_")).otherwise(p) for p in part])
    return F.when(F.length(_col(page)) > 0, dirs)


def page_path(page: Column | str, namespaces: list[str] | None = None) -> Column:
    """Directory and file name joined by a slash."""
    return F.concat(three_dirs(page, namespaces), F.lit("/"), file_name(page))


def from_path(path: Column | str) -> Column:
    """The page of a path: decoded, without its three directories."""
    return F.substring(url_unquote(path), 7, 2**31 - 1)


def title_link(title: Column | str, namespaces: list[str] | None = None) -> Column:
    """The path of the page a title is of: blanks as _, first letter in upper case."""
    t = F.replace(_col(title), F.lit(" "), F.lit("_"))
    return page_path(F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 2**31 - 1)), namespaces)


def stable_hash(text: Column | str) -> Column:
    """The last 24 bits of the MD5."""
    return F.conv(F.substring(F.md5(_col(text).cast("binary")), -6, 6), 16, 10).cast("long")


def block_of(name: Column | str, blocks: int | Column) -> Column:
    return F.pmod(stable_hash(name), F.lit(blocks) if isinstance(blocks, int) else blocks)


def link_target(href: Column | str, prefix: str = "/wiki/") -> Column:
    """The page a link leads to: without prefix and fragment, decoded. Null for other links."""
    href = _col(href)
    bare = F.substring_index(F.substring(href, len(prefix) + 1, 2**31 - 1), "#", 1)
    return F.when(F.startswith(href, F.lit(prefix)), url_unquote(bare))


def redirect_target(href: Column | str, prefix: str = "/wiki/") -> tuple[Column, Column]:
    """(page, fragment) of a redirect's link; the fragment is null if there is none."""
    href = _col(href)
    rest = url_unquote(F.substring(href, len(prefix) + 1, 2**31 - 1))
    fragment = F.when(F.contains(rest, F.lit("#")), F.substring(rest, F.instr(rest, "#") + 1, F.length(rest)))
    return F.substring_index(rest, "#", 1), fragment


def is_category(name: Column | str, word: str = "Categoría") -> Column:
    """Whether a page lists the members of a category, by its name."""
    return F.contains(_col(name), F.lit(word))
