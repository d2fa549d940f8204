"""Images: addresses, ranking by best page, scale tiers."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.ranking import global_index

EMBED_LIMIT = 40_960
SCALES = (100, 75, 50)


def image_paths(src: Column | str, site: str = "https://es.wikipedia.org") -> Column:
    """STRUCT<dsk, web, problem> of an image address: path on disk, address to fetch, why it can't be used."""
    src = F.col(src) if isinstance(src, str) else src
    language = site.removeprefix("https://").split(".")[0]
    upload, rest = "//upload.wikimedia.org/", "/api/rest_v1/"
    commons, local = f"{upload}wikipedia/commons/", f"{upload}wikipedia/{language}/"
    parts = F.split(F.substring(src, len(commons) - len("commons/") + 1, 2**31 - 1), "/")
    shortened = F.array_join(F.concat(F.slice(parts, 1, 4), F.slice(parts, 6, 1)), "/")
    is_ = lambda p: F.startswith(src, F.lit(p))
    cut = lambda n: F.substring(src, n + 1, 2**31 - 1)
    dsk = (
        F.when(is_(commons), F.when(F.size(parts) == 6, shortened).when(F.size(parts) == 4, F.array_join(parts, "/")))
        .when(is_("//bits.wikimedia.org/"), cut(46)).when(is_(local), cut(len(local))).when(is_(upload), cut(23))
        .when(is_("/w/extensions/"), cut(3)).when(is_(f"https://wikimedia.org{rest}media/"), cut(40)).when(is_(f"{rest}page/"), cut(18))
    )
    dsk = F.when(F.contains(dsk, F.lit("/render/svg/")) & ~F.endswith(F.lower(dsk), F.lit(".svg")), F.concat(dsk, F.lit(".svg"))).otherwise(dsk)
    web = F.when(is_("/w/extensions/") | is_(f"{rest}page/"), F.concat(F.lit(site), src)).when(is_("https://"), src).otherwise(F.concat(F.lit("http:"), src))
    problem = F.when(is_(commons) & ~F.size(parts).isin(4, 6), "format").when(dsk.isNull() & F.contains(src, F.lit("Special:CentralAutoLogin")), "removed").when(dsk.isNull(), "unsupported").when(F.contains(dsk, F.lit("?")), "query")
    return F.struct(F.when(problem.isNull(), dsk).alias("dsk"), F.when(problem.isNull(), web).alias("web"), problem.alias("problem"))


IMAGES_PREFIX = "/images/"


def local_address(dsk: str, width: str | None = None, height: str | None = None) -> str:
    """The address an image is served at, with its size if both sides are known; the path as bytes of Latin-1 if it has such."""
    try:
        path = quote(dsk.encode("latin-1"))
    except UnicodeEncodeError:
        path = quote(dsk)
    return IMAGES_PREFIX + path + (f"?s={width}-{height}" if width and height else "")


def is_required(dsk: Column | str) -> Column:
    return F.rlike(F.lower(dsk), F.lit(r"[^/]\.svg$"))


def is_embeddable(dsk: Column | str, size: Column | str) -> Column:
    return is_required(dsk) & ((F.col(size) if isinstance(size, str) else size) < EMBED_LIMIT)


def final_scale(scale: Column | str, dsk: Column | str, size: Column | str) -> Column:
    """The scale, but 100 for formulas, files below 2048 bytes, and .png or .gif."""
    full = F.startswith(dsk, F.lit("math")) | ((F.col(size) if isinstance(size, str) else size) < 2048) | F.rlike(dsk, F.lit(r"\.(png|gif)$"))
    return F.when(full, F.lit(100)).otherwise(F.col(scale) if isinstance(scale, str) else scale)


def scaled_side(side: Column, scale: Column) -> Column:
    return F.floor(side * scale / 100).cast("int")


def tiers(ranked: DataFrame, reduction: tuple[int, int, int, int], position: str = "idx", total: Column | None = None) -> DataFrame:
    """The first share reduction[0] % of the rows at scale 100, the next two at 75 and 50, the rest left out.

    Each share is rounded down by itself. ``position`` counts from 0; the number of rows is counted if not given.
    """
    if sum(reduction) != 100:
        raise ValueError("the reductions must sum to 100")
    if total is None:
        counted = ranked.agg(F.count("*").alias("__pm_total"))
        ranked, total = ranked.crossJoin(F.broadcast(counted)), F.col("__pm_total")  # one row
    ends, up = [], F.lit(0)
    for share in reduction[:3]:
        up = up + F.floor(total * share / 100)
        ends.append(up)
    scale = F.coalesce(*[F.when(F.col(position) < end, F.lit(s)) for end, s in zip(ends, SCALES)])
    return ranked.withColumn("scale", scale).filter("scale IS NOT NULL").drop("__pm_total")


def best_position(page_images: DataFrame, chosen: DataFrame) -> DataFrame:
    """(dsk, prio): the place in the selection of the best chosen page that has the image. ``page_images``: page, imgs;
    ``chosen``: page, idx. A chosen page that has no row of images, be it an empty one, is an error."""
    known = page_images.select("page", "imgs", F.lit(True).alias("__pm_there"))
    gone = F.raise_error(F.concat(F.lit("no images are known of the page "), F.col("page").cast("string"))).cast("array<string>")
    imgs = F.when(F.col("__pm_there").isNull(), gone).otherwise(F.col("imgs"))
    each = chosen.join(known, "page", "left").select(F.explode(imgs).alias("dsk"), "idx")
    return each.groupBy("dsk").agg(F.min("idx").alias("prio"))


def image_plan(page_images: DataFrame, chosen: DataFrame, urls: DataFrame, reduction: tuple[int, int, int, int], keep_required: bool = True, dynamic: DataFrame | None = None) -> DataFrame:
    """(scale, dsk, web): required images (if kept) at 100, the others cut into tiers by their best page; dynamic ones (dsk)
    come first. An image without an address in ``urls`` (dsk, web) is an error."""
    best = best_position(page_images, chosen)
    if dynamic is not None:
        best = best.unionByName(dynamic.select("dsk", F.lit(-1).cast("long").alias("prio"))).groupBy("dsk").agg(F.min("prio").alias("prio"))
    required = is_required("dsk") if keep_required else F.lit(False)
    optional = global_index(best.filter(~required), [F.col("prio"), F.col("dsk")])
    planned = tiers(optional, reduction).select("scale", "dsk")
    if keep_required:
        planned = best.filter(required).select(F.lit(100).alias("scale"), "dsk").unionByName(planned)
    gone = F.raise_error(F.concat(F.lit("no address is known of the image "), "dsk")).cast("string")
    found = planned.join(urls.select("dsk", "web"), "dsk", "left")
    return found.select("scale", "dsk", F.when(F.col("web").isNull(), gone).otherwise(F.col("web")).alias("web"))


def to_download(plan: DataFrame, have: DataFrame, errors: DataFrame) -> DataFrame:
    """(dsk, web) still to be fetched of a plan: those not at hand (dsk) and whose address is not among the errors (web)."""
    return plan.select("dsk", "web").distinct().join(have.select("dsk"), "dsk", "left_anti").join(errors.select("web"), "web", "left_anti").select("dsk", "web")


def scaling(plan: DataFrame, on_disk: DataFrame, before: DataFrame) -> DataFrame:
    """(dsk, scale, todo) of a plan (dsk, scale), the images on disk (dsk) and those scaled before (dsk, scale).

    todo is scale; same for an image that stands at this scale already; missing for one that is not on disk; and delete for
    one that was scaled before and is planned no more (with its old scale).
    """
    now = plan.select("dsk", "scale").distinct().join(on_disk.select("dsk", F.lit(True).alias("there")).distinct(), "dsk", "left")
    now = now.join(before.select("dsk", F.col("scale").alias("old")), "dsk", "left")
    todo = F.when(F.col("there").isNull(), "missing").when(F.col("old") == F.col("scale"), "same").otherwise("scale")
    gone = before.join(plan.select("dsk"), "dsk", "left_anti").select("dsk", "scale", F.lit("delete").alias("todo"))
    return now.select("dsk", "scale", todo.alias("todo")).unionByName(gone)


def page_embeds(page_images: DataFrame, files: DataFrame) -> DataFrame:
    """(page, images: map of path to svg) of the images of each page (page, imgs) that are embeddable among files (dsk, content)."""
    small = files.filter(is_embeddable("dsk", F.octet_length("content"))).select("dsk", F.col("content").cast("string").alias("svg"))
    found = page_images.select("page", F.explode(F.array_distinct("imgs")).alias("dsk")).join(small, "dsk")
    return found.groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("dsk", "svg"))).alias("images"))
