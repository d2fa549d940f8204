"""Links, scores, redirects and the choice of pages."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.storage import materialise

LINK_SCORE = 5000
VIP_SCORE = 100_000_000


def page_links(links: DataFrame, drop_classes: tuple[str, ...] = ("image", "internal")) -> DataFrame:
    """(src, dst) of links (page, target, classes): links with a target, of no dropped class, not to the page itself. Repeated links count."""
    kept = links.filter(F.col("target").isNotNull() & (F.col("target") != ""))
    if "classes" in links.columns:
        kept = kept.filter(~F.arrays_overlap(F.coalesce("classes", F.array().cast("array<string>")), F.array(*[F.lit(c) for c in drop_classes])))
    return kept.filter("page <> target").select(F.col("page").alias("src"), F.col("target").alias("dst"))


def vip_levels(*sources: tuple[DataFrame, int]) -> DataFrame:
    """(page, level) from tables of pages and their level; a page keeps its highest."""
    tables = [df.select("page").withColumn("level", F.lit(level)) for df, level in sources]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("page").agg(F.max("level").alias("level"))


def score_events(pages: DataFrame, links: DataFrame, vip: DataFrame | None = None) -> DataFrame:
    """(page, kind, score): one R row for each page that is no redirect (bytes of html plus VIP score), E rows for links
    and for redirects that are VIP. ``pages`` has page, html or its size in bytes, and, if there are redirects, redirect_to."""
    redirect = F.col("redirect_to").isNotNull() if "redirect_to" in pages.columns else F.lit(False)
    base = pages.withColumn("__pm_redirect", redirect)
    if vip is not None:
        base = base.join(vip.select("page", "level"), "page", "left")
    level = F.coalesce("level", F.lit(0)) if vip is not None else F.lit(0)
    real = base.filter(~F.col("__pm_redirect")).select("page", F.lit("R").alias("kind"), (level * VIP_SCORE + (F.col("size") if "size" in pages.columns else F.octet_length("html"))).cast("long").alias("score"))
    extra = links.select(F.col("dst").alias("page"), F.lit("E").alias("kind"), F.lit(LINK_SCORE).cast("long").alias("score"))
    out = real.unionByName(extra)
    if vip is not None and "redirect_to" in pages.columns:
        passed = base.filter(F.col("__pm_redirect") & (level > 0)).select(F.col("redirect_to").alias("page"), F.lit("E").alias("kind"), F.lit(VIP_SCORE).cast("long").alias("score"))
        out = out.unionByName(passed)
    return out


def _hop(pointers: DataFrame) -> DataFrame:
    """Each pointer followed twice."""
    on = pointers.select(F.col("n").alias("p"), F.col("p").alias("q"))
    return pointers.join(on, "p", "left").select("n", F.coalesce("q", "p").alias("p"))


def resolve_redirects(redirects: DataFrame) -> DataFrame:
    """(src, dst): where each redirect leads in the end.

    The path from a redirect's target is followed to its end, or to the first page met twice where it runs into a
    cycle. One of several redirects of a source counts, the last in order of target. By pointer doubling: the
    number of rounds is the logarithm of the longest chain, each a join of the edges alone.
    """
    edges = materialise(redirects.groupBy("src").agg(F.max("dst").alias("dst")), "redirects")
    step = edges.select(F.col("src").alias("n"), F.col("dst").alias("p"))
    now, size = step, edges.count()
    for _ in range(max(1, math.ceil(math.log2(size + 1)))):  # afterwards what points to a source points into a cycle
        now = materialise(_hop(now), "hops")
        if not now.join(edges.select(F.col("src").alias("p")), "p", "left_semi").take(1):
            break
    cycle = materialise(now.join(edges.select(F.col("src").alias("p")), "p", "left_semi").select("p").distinct(), "cycle")
    tails = step.join(cycle.select(F.col("p").alias("n")), "n", "left_anti")  # pages of a cycle point to themselves
    now = tails
    for _ in range(max(1, math.ceil(math.log2(size + 1)))):
        now = materialise(_hop(now), "hops")
        if not now.join(tails.select(F.col("n").alias("p")), "p", "left_semi").take(1):
            break
    ends = now.select(F.col("n").alias("dst"), F.col("p").alias("end"))
    return edges.join(ends, "dst", "left").select("src", F.coalesce("end", "dst").alias("dst"))


def final_scores(events: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(page, score) of the pages that have an R row: the sum of their events and of those of what redirects to them."""
    sums = events.groupBy("page").agg(F.sum("score").alias("score"), F.bool_or(F.col("kind") == "R").alias("real"))
    if redirects is None:
        return sums.filter("real").select("page", "score")
    ends = resolve_redirects(redirects)
    moved = sums.join(ends, sums["page"] == ends["src"], "left").select(F.coalesce("dst", "page").alias("page"), "score", (F.col("real") & F.col("dst").isNull()).alias("real"))
    real = sums.filter("real").select("page").join(ends.select(F.col("src").alias("page")), "page", "left_semi").withColumns({"score": F.lit(0).cast("long"), "real": F.lit(True)})
    total = moved.unionByName(real).groupBy("page").agg(F.sum("score").alias("score"), F.bool_or("real").alias("real"))
    return total.filter("real").select("page", "score")


def kept_redirects(redirects: DataFrame, chosen: DataFrame) -> DataFrame:
    """The redirects (src, dst, with a fragment or without) that lead to a chosen page."""
    return redirects.withColumn("__pm_p", F.substring_index("dst", "#", 1)).join(chosen.select(F.col("page").alias("__pm_p")), "__pm_p", "left_semi").drop("__pm_p")


def missing_links(links: DataFrame, chosen: DataFrame, redirects: DataFrame) -> DataFrame:
    """The links (src, dst) to pages that are neither chosen nor a redirect to a chosen page."""
    reach = kept_redirects(resolve_redirects(redirects), chosen).select(F.col("src").alias("dst"))
    there = chosen.select(F.col("page").alias("dst")).unionByName(reach).distinct()
    return links.join(there, "dst", "left_anti").select("src", "dst")


def best_revision(revisions: DataFrame, now, days: int = 7) -> DataFrame:
    """(page, revid) of the revision to trust of (page, revid, userid, ts).

    From the newest: the first by a registered user, or that stood for more than ``days`` before the next one (the
    newest, until ``now``); if there is none, the oldest.
    """
    newest = Window.partitionBy("page").orderBy(F.desc("ts"), F.desc("revid"))
    rows = revisions.withColumn("next", F.lag("ts", 1).over(newest)).withColumn("rn", F.row_number().over(newest))
    until = F.coalesce("next", F.lit(now).cast("timestamp"))
    good = (F.coalesce("userid", F.lit(0)) != 0) | (F.col("ts") + F.expr(f"INTERVAL {days} DAYS") < until)
    pick = F.coalesce(F.min_by("revid", F.when(good, F.col("rn"))), F.max_by("revid", "rn"))
    return rows.groupBy("page").agg(pick.alias("revid"))
