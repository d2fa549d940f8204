"""Command line: build a corpus from a Parquet table of pages (page, html), or search one."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import functions as F

from pagemill.functions.config import ImageType, image_types
from pagemill.operators.engine import Engine, build
from pagemill.operators.scoring import vip_levels
from pagemill.session import get_session
from pagemill.sources.built import find_in_blocks
from pagemill.sources.readers import read_namespace_listings, read_titles
from pagemill.sources.sinks import append_new, once, remove

TEST_PAGES = 1000


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="pagemill", description=__doc__)
    parser.add_argument("--master")
    todo = parser.add_subparsers(dest="todo", required=True)
    b = todo.add_parser("build", help="a corpus below a folder, one for each image type")
    b.add_argument("pages", help="Parquet table (page, html)")
    b.add_argument("path", help="folder of the corpus")
    b.add_argument("--page-limit", type=int, help="pages to choose, or to work on in test mode")
    b.add_argument("--image-reduction", type=int, nargs=4, default=(100, 0, 0, 0))
    b.add_argument("--image-types", help="JSON file of the image types of a language")
    b.add_argument("--image-type", help="names of image types to build, with commas between them")
    b.add_argument("--image-list", action="store_true", help="show the image types and stop")
    b.add_argument("--listings", help="saved answers of a listing; their titles are kept below the folder")
    b.add_argument("--no-lists", action="store_true", help="don't read the listings again")
    b.add_argument("--no-scrap", action="store_true", help="take in no new pages: go on with those that were parsed")
    b.add_argument("--no-clean", action="store_true", help="keep what earlier runs made, to resume them")
    b.add_argument("--extra-pages", help="file with titles of pages that must be in, one in a line")
    b.add_argument("--more-pages", help="a further table of pages")
    b.add_argument("--vip", nargs="*", default=[], metavar="LEVEL=FILE", help="titles of pages to be preferred")
    b.add_argument("--namespaces", nargs="*", help="namespaces that stand in names")
    b.add_argument("--files", help="Parquet table of images at hand (dsk, content)")
    b.add_argument("--prefix", default="/wiki/")
    b.add_argument("--test-mode", action="store_true", help=f"only the first pages by name, {TEST_PAGES} if no limit is given")
    s = todo.add_parser("search")
    s.add_argument("path")
    s.add_argument("text")
    s.add_argument("--limit", type=int, default=20)
    f = todo.add_parser("find", help="names in the blocks of a corpus")
    f.add_argument("path")
    f.add_argument("part")
    return parser


def _build(spark, args) -> None:
    known = image_types(json.loads(Path(args.image_types).read_text())) if args.image_types else {}
    if args.image_list:
        print(*known, sep="\n")
        return
    names = args.image_type.split(",") if args.image_type else []
    if unknown := [n for n in names if n not in known]:
        raise SystemExit(f"unknown image types: {', '.join(unknown)}")
    kinds = [known[n] for n in names] or [ImageType("own", None if args.test_mode else args.page_limit, tuple(args.image_reduction))]
    pages = spark.read.parquet(args.pages).select("page", "html")
    if args.more_pages:
        pages = pages.unionByName(spark.read.parquet(args.more_pages).select("page", "html"))
    if args.test_mode:
        pages = pages.orderBy("page").limit(args.page_limit or TEST_PAGES)
    vip = [(read_titles(spark, path).select(F.col("title").alias("page")), int(level)) for level, _, path in (v.partition("=") for v in args.vip)]
    if args.extra_pages:
        vip.append((read_titles(spark, args.extra_pages).select(F.col("title").alias("page")), 10))
    if args.listings:
        titles = f"{args.path}/titles"
        if not args.no_lists:
            append_new(read_namespace_listings(spark, args.listings), titles, "title")
        pages = pages.join(once(titles, lambda: read_namespace_listings(spark, args.listings).distinct(), spark).select(F.col("title").alias("page")), "page", "left_semi")
    files = spark.read.parquet(args.files) if args.files else None
    for kind in kinds:
        path = f"{args.path}/{kind.name}" if names else args.path
        if not args.no_clean:  # what was parsed stays for a run that takes in no new pages
            for made in ("chosen", "redirects", "ready", "blocks", "images", "image_blocks", "index", *([] if args.no_scrap else ["parsed"])):
                remove(spark, f"{path}/{made}")
        engine = build(pages, path, kind, vip_levels(*vip) if vip else None, args.prefix, args.namespaces, files, parse=not args.no_scrap)
        print(kind.name, engine.chosen.agg(F.count("*")).first()[0], "pages")


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = get_session(args.master)
    if args.todo == "build":
        _build(spark, args)
    elif args.todo == "find":
        for row in find_in_blocks(Engine(spark, args.path).blocks.table, args.part).orderBy("name").collect():
            print(row["block"], row["kind"], row["name"], row["target"] or "", sep="\t")
    else:
        for row in Engine(spark, args.path).search(args.text, args.limit).collect():
            print(row["rank"], row["title"], row["address"], sep="\t")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
