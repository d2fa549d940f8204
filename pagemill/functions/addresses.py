"""Addresses of pages, histories and revisions; pager links; language fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.naming import link_target, url_unquote


def _quoted(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def original_link(path: Column | str, base: str = "https://es.wikipedia.org/") -> Column:
    """The address of a page at its origin."""
    return F.concat(F.lit(base + "wiki/"), _quoted(url_unquote(path)))


def history_url(page: Column | str, limit: int, base: str = "https://es.wikipedia.org/") -> Column:
    """Where to ask for the newest ``limit`` revisions of a page."""
    head = f"{base}w/api.php?format=json&action=query&prop=revisions&rvprop=ids|timestamp|userid&rvlimit={limit}&titles="
    return F.concat(F.lit(head), _quoted(F.col(page) if isinstance(page, str) else page))


def revision_url(page: Column | str, revid: Column | str, base: str = "https://es.wikipedia.org/") -> Column:
    """A revision of a page; without a revision the page, redirects not followed."""
    title = _quoted(F.col(page) if isinstance(page, str) else page)
    revid = F.col(revid) if isinstance(revid, str) else revid
    old = F.concat(F.lit("&oldid="), revid.cast("string"))
    return F.concat(F.lit(base + "w/index.php?title="), title, F.coalesce(old, F.lit("")), F.lit("&redirect=no"))


def next_page_link(html: Column | str, label: str = "200 siguientes") -> Column:
    """The address of the next part of a long category; null on the last."""
    found = F.regexp_extract(html, rf'<a href="([^"]+)"[^>]*>{label}</a>', 1)
    return F.when(found != "", F.replace(found, F.lit("&amp;"), F.lit("&")))


def number_pager_links(html: Column | str, part: int, following: str = "200 siguientes", previous: str = "200 previas") -> Column:
    """Links to the following and previous parts of a category as local pages: name_n, and the bare name for the first."""
    def to(text: Column | str, label: str, n: int) -> Column:
        suffix = "" if n <= 1 else f"_{n}"
        return F.regexp_replace(text, rf'<a href="/w/index\.php\?title=([^&"]+)[^>]*>{label}</a>', f'<a href="/wiki/$1{suffix}">{label}</a>')

    return to(to(html, following, part + 1), previous, part - 1)


def portal_pages(page: DataFrame, html: str = "html", prefix: str = "/wiki/") -> DataFrame:
    """Distinct (title) of all pages that one page (or a few) links to."""
    hrefs = page.select(F.explode(F.regexp_extract_all(html, F.lit(r'href="([^"]+)"'), F.lit(1))).alias("href"))
    return hrefs.select(link_target("href", prefix).alias("title")).filter("title <> ''").distinct()


def languages_to_try(language: Column | str, second: dict[str, str], last: str = "es") -> Column:
    """The languages in which to look for a text: its own, the second one of it, the last resort."""
    own = F.col(language) if isinstance(language, str) else language
    pairs = [F.lit(x) for kv in second.items() for x in kv]
    other = F.create_map(*pairs)[own] if pairs else F.lit(None).cast("string")
    return F.array_distinct(F.array_compact(F.array(own, other, F.lit(last))))
