"""Style sheets: links to modules, module names, media in url(...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.naming import unquote_plus, url_unquote

_LINK = r'<link[^>]*href="([^"]*/w/load\.php\?[^"]*)"'
_URL = r"url\(([^)]+)\)"


def css_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Distinct links to style modules in all pages."""
    return pages.select(F.explode(F.regexp_extract_all(html, F.lit(_LINK), F.lit(1))).alias("link")).distinct()


def module_names(link: Column | str) -> Column:
    """The modules a link asks for: ``a.b,c|d`` is a.b, a.c and d."""
    plain = F.replace(link if isinstance(link, Column) else F.col(link), F.lit("&amp;"), F.lit("&"))
    value = unquote_plus(F.regexp_extract(plain, r"[?&]modules=([^&#]*)", 1))

    def expand(group: Column) -> Column:
        names = F.split(group, ",")
        parent = F.regexp_extract(names[0], r"^(.*)\.[^.]*$", 1)
        return F.transform(names, lambda n, i: F.when(i == 0, n).otherwise(F.concat(parent, F.lit("."), n)))

    return F.array_distinct(F.filter(F.flatten(F.transform(F.split(value, r"\|"), expand)), lambda n: n != ""))


def modules(links: DataFrame) -> DataFrame:
    """Distinct module names over all links, with the address of each."""
    names = links.select(F.explode(module_names("link")).alias("name")).distinct()
    return names.withColumn("query", module_query("name"))


def module_query(name: Column | str, params: tuple[tuple[str, str], ...] = (("only", "styles"), ("skin", "vector"))) -> Column:
    rest = "".join(f"&{k}={v}" for k, v in params)
    return F.concat(F.lit("modules="), F.url_encode(name), F.lit(rest))


def resource_name(url: Column | str) -> Column:
    """A safe file name: last part of the address, decoded, ASCII only, without a query."""
    last = F.regexp_extract(url, r"([^/]*)$", 1)
    return F.substring_index(F.regexp_replace(url_unquote(last), r"[^\x00-\x7F]", ""), "?", 1)


def media(sheets: DataFrame, base: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(raw, url, name) of each distinct medium that the sheets (column css) name, addresses made absolute."""
    raw = sheets.select(F.explode(F.regexp_extract_all("css", F.lit(_URL), F.lit(1))).alias("raw")).distinct()
    bare = F.regexp_replace("raw", '^"+|"+$', "")
    url = F.when(F.startswith(bare, F.lit("//")), F.concat(F.lit("http:"), bare)).when(F.startswith(bare, F.lit("/")), F.concat(F.lit(base.rstrip("/")), bare)).otherwise(bare)
    return raw.filter(~bare.isin(*keep) if keep else F.lit(True)).select("raw", url.alias("url"), resource_name(url).alias("name"))


def retarget(sheets: DataFrame, local: DataFrame, keep: tuple[str, ...] = (), folder: str = "/css/images/") -> DataFrame:
    """The sheets (name, css) with url(...) leading to local media (raw, name), to nothing if not local, unless kept.

    A sheet is cut at its url(...) places, those are looked up by a join, and it is put together again.
    """
    cut = sheets.withColumn("parts", F.split("css", r"url\([^)]+\)", -1)).withColumn("urls", F.regexp_extract_all("css", F.lit(_URL), F.lit(1)))
    places = cut.select("name", F.posexplode_outer("urls").alias("pos", "raw"))
    known = local.select("raw", F.concat(F.lit(folder), "name").alias("to"))
    new = F.when(F.col("raw").isin(*keep), F.col("raw")).otherwise(F.coalesce("to", F.lit(""))) if keep else F.coalesce("to", F.lit(""))
    joined = places.join(known, "raw", "left").select("name", F.struct("pos", new.alias("url")).alias("u"))
    back = joined.groupBy("name").agg(F.transform(F.array_sort(F.collect_list("u")), lambda u: F.concat(F.lit("url("), u["url"], F.lit(")"))).alias("to"))
    whole = F.array_join(F.zip_with("parts", "to", lambda p, u: F.concat(F.coalesce(p, F.lit("")), F.coalesce(u, F.lit("")))), "")
    return cut.join(back, "name").select("name", F.when(F.size("urls") > 0, whole).otherwise(F.col("css")).alias("css"))


def unify(sheets: DataFrame) -> DataFrame:
    """All sheets (name, css) as one, in order of name. The result is one value: meant for style sheets, which are small."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("name", "css"))), lambda s: F.concat(s["css"], F.lit("\n")))
    return sheets.agg(F.array_join(listed, "").alias("css"))
