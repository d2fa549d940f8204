"""Pages: one parse of the HTML, the cleaning rules, titles, summaries, links and images."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape, unescape
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.text import shorten
from pagemill.operators.images import local_address
from pagemill.workers import by_pieces

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
#: A new one of these ends an open one.
_ENDS = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Node:
    """An element, or a text or comment (name #text or #comment)."""

    __slots__ = ("name", "attrs", "children", "parent", "data")

    def __init__(self, name: str, attrs: dict | None = None, data: str = ""):
        self.name, self.attrs, self.children, self.parent, self.data = name, attrs or {}, [], None, data

    def add(self, child: "Node") -> "Node":
        child.parent = self
        self.children.append(child)
        return child

    def walk(self) -> Iterator["Node"]:
        stack = list(reversed(self.children))
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def find_all(self, name: str, **want) -> list["Node"]:
        return [n for n in self.walk() if n.name == name and n.matches(**want)]

    def find(self, name: str, **want) -> "Node | None":
        return next((n for n in self.walk() if n.name == name and n.matches(**want)), None)

    def matches(self, id: str | None = None, cls: str | None = None) -> bool:
        return (id is None or self.attrs.get("id") == id) and (cls is None or cls in self.classes)

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def replace(self, nodes: list["Node"]) -> None:
        parent = self.parent
        if parent is None:
            return
        at = next(i for i, c in enumerate(parent.children) if c is self)
        for n in nodes:
            n.parent = parent
        parent.children[at : at + 1] = nodes
        self.parent = None

    def unwrap(self) -> None:
        self.replace(self.children)

    def text(self) -> str:
        return "".join(n.data for n in self.walk() if n.name == "#text")

    def html(self) -> str:
        out: list[str] = []
        stack: list = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.name == "#text":
                out.append(node.data if node.parent is not None and node.parent.name in RAW else escape(node.data, quote=False))
            elif node.name == "#comment":
                out.append(f"<!--{node.data}-->")
            elif node.name == "#root":
                stack.extend(reversed(node.children))
            else:
                attrs = "".join(f" {k}" if v is None else f' {k}="{escape(v)}"' for k, v in node.attrs.items())
                out.append(f"<{node.name}{attrs}>")
                if node.name not in VOID:
                    stack.append(f"</{node.name}>")
                    stack.extend(reversed(node.children))
        return "".join(out)


_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;)")


def resolve(text: str) -> str:
    """A text with its references to characters resolved. One by name that has no semicolon is text, as to libxml2 (the
    reference's parser); ``html.unescape`` would resolve some, and the beginnings of others."""
    return _REFERENCE.sub(lambda m: unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text) if "&" in text else text


class _Builder(HTMLParser):
    """``amp`` stands for & in what it is fed, so that references reach ``resolve`` as they are."""

    def __init__(self, amp: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")
        self.amp = amp

    def attributes(self, attrs) -> dict:
        return {k.replace(self.amp, "&"): v if v is None else resolve(v.replace(self.amp, "&")) for k, v in attrs}

    def handle_starttag(self, tag, attrs):
        tag = tag.replace(self.amp, "&")
        ends = _ENDS.get(tag, set()) | ({"p"} if tag in _BLOCKS else set())
        if self.at.name in ends:
            self.at = self.at.parent
        node = self.at.add(Node(tag, self.attributes(attrs)))
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.add(Node(tag.replace(self.amp, "&"), self.attributes(attrs)))

    def handle_endtag(self, tag):
        tag, node = tag.replace(self.amp, "&"), self.at
        while node is not None and node.name != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        data = data.replace(self.amp, "&")
        self.at.add(Node("#text", data=data if self.cdata_elem else resolve(data)))

    def handle_comment(self, data):
        self.at.add(Node("#comment", data=data.replace(self.amp, "&")))


def parse(html: str) -> Node:
    """A tree for any text: unclosed elements end with their parent, stray end tags are dropped."""
    amp = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in html) if "&" in html else "&"
    builder = _Builder(amp)
    builder.feed(html.replace("&", amp))
    builder.close()
    return builder.root


def _clear(node: Node) -> None:
    node.children = []


#: (statistic, element, id, class, only the first, what to do)
RULES = (
    ("notlastversion", "div", "contentSub", None, True, _clear),
    ("edit_sections", "span", None, "mw-editsection", False, _clear),
    ("ambox", "table", None, "ambox", False, _clear),
    ("inline_math", "span", None, "mwe-math-mathml-inline", False, _clear),
    ("img_srcset", "img", "", "", False, None),
    ("links", "a", "", "", False, None),
    ("hidden_subtitle", "div", "siteSub", None, True, Node.remove),
    ("jump_links", "a", None, "mw-jump-link", False, None),
    ("inline_alerts", "sup", None, None, False, None),
    ("print_footer", "div", None, "printfooter", True, Node.remove),
    ("hidden_categories", "div", "mw-hidden-catlinks", None, False, Node.remove),
    ("comments", "#comment", None, None, False, Node.remove),
    ("parsing_error_notices", "span", None, "error", False, Node.remove),
)
UNWRAP = (("redlink", "redlink"), ("action=edit", "editlinks"), ("Especial:Categor", "category"))
JUMPS = frozenset(("#p-search", "#mw-head", "#searchInput", "#mw-sidebar-button"))


def clean(root: Node) -> dict[str, int]:
    """Apply the cleaning rules to a tree, in their order; how often each did something."""
    stats: dict[str, int] = {}

    def count(key: str) -> None:
        stats[key] = stats.get(key, 0) + 1

    for key, name, id_, cls, first, act in RULES:
        nodes = root.find_all(name, id=id_ or None, cls=cls or None)
        for node in nodes[:1] if first else nodes:
            if key == "img_srcset":
                if "srcset" in node.attrs:
                    del node.attrs["srcset"]
                    count(key)
            elif key == "links":
                kind = next((k for part, k in UNWRAP if part in (node.attrs.get("href") or "")), None)
                if kind:
                    node.unwrap()
                    count(kind)
            elif key == "jump_links":
                if node.attrs.get("href") in JUMPS:
                    node.remove()
                    count(key)
            elif key == "inline_alerts":
                kids = node.children
                if len(kids) > 1 and kids[0].name == "#text" and kids[0].data == "[" and kids[1].name == "i":
                    node.remove()
                    count(key)
            else:
                act(node)
                count(key)
    return stats


def summary_parts(root: Node) -> list[str]:
    """Texts of the paragraphs without class in the main part: the first direct one, then all others that differ from it."""
    main = root.find("div", cls="mw-parser-output")
    if main is None:
        return []
    plain = [p for p in main.find_all("p") if not p.attrs.get("class")]
    first = next((p for p in main.children if p.name == "p" and not p.attrs.get("class")), None)
    same = first.html() if first is not None else None
    texts = ([first.text()] if first is not None else []) + [p.text() for p in plain if first is None or p.html() != same]
    return [t.strip() for t in texts if t.strip()]


def body_html(root: Node) -> str:
    """The page without its html and body tags and without its head."""
    for head in root.find_all("head"):
        head.remove()
    for name in ("html", "body"):
        for node in root.find_all(name):
            node.unwrap()
    return root.html()


_LINK = T.StructType([T.StructField("target", T.StringType()), T.StructField("classes", T.ArrayType(T.StringType()))])
PARSED = T.StructType([
    T.StructField("page", T.StringType()), T.StructField("clean_html", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("redirect_to", T.StringType()), T.StructField("is_redirect", T.BooleanType()),
    T.StructField("links", T.ArrayType(_LINK)), T.StructField("images", T.ArrayType(T.StringType())), T.StructField("stats", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("size", T.LongType()),
])


_PARSED_ARROW = pa.schema([
    ("page", pa.string()), ("clean_html", pa.string()), ("title", pa.string()), ("texts", pa.list_(pa.string())), ("redirect_to", pa.string()), ("is_redirect", pa.bool_()),
    ("links", pa.list_(pa.struct([("target", pa.string()), ("classes", pa.list_(pa.string()))]))), ("images", pa.list_(pa.string())), ("stats", pa.map_(pa.string(), pa.int32())),
    ("size", pa.int64()),
])


def _target(href: str, prefix: str) -> str | None:
    return unquote(href[len(prefix) :].split("#")[0]) if href.startswith(prefix) else None


def parse_pages(pages: DataFrame, prefix: str = "/wiki/") -> DataFrame:
    """``pages`` (page, html) parsed once for all that follow: cleaned HTML, title, summary, redirect, links, images,
    statistics, and the size of the page in bytes as it came.

    A redirect has no links. A page with a redirect mark and no link in it is a broken redirect: is_redirect without a target.
    """

    def one(page: str, html: str | None) -> tuple:
        root = parse(html or "")
        stats = clean(root)
        mark = root.find("ul", cls="redirectText")
        to = mark.find("a") if mark is not None else None
        heading = root.find("h1")
        links = [] if mark is not None else [
            {"target": t, "classes": a.classes} for a in root.find_all("a") if (t := _target(a.attrs.get("href") or "", prefix)) is not None
        ]
        images = [i.attrs.get("src") for i in root.find_all("img") if i.attrs.get("src")]
        redirect = unquote((to.attrs.get("href") or "")[len(prefix) :]) if to is not None else None
        title, texts = heading.text().strip() if heading is not None else "<no-title>", summary_parts(root)
        return page, body_html(root), title, texts, redirect, mark is not None, links, images, list(stats.items()), len((html or "").encode())

    parsed = pages.select("page", "html").mapInArrow(lambda batches: by_pieces(batches, one, _PARSED_ARROW), PARSED)
    return parsed.withColumn("summary", shorten(F.array_join("texts", "·"))).drop("texts")


def local_images(root: Node, sources: dict[str, dict], inline: dict[str, str]) -> None:
    """Let the images of a tree point to where they are served from.

    ``sources`` has dsk and problem (as ``images.image_paths`` gives them) by address. An image whose problem is removed
    goes; one with a path gets the local address, with its size in it instead of in attributes; if its path is one of
    ``inline``, the drawing takes its place. Images of other problems stay as they are.
    """
    for image in root.find_all("img"):
        source = sources.get(image.attrs.get("src") or "") or {}
        if source.get("problem") == "removed":
            image.remove()
        elif dsk := source.get("dsk"):
            width, height = image.attrs.pop("width", None), image.attrs.pop("height", None)
            image.attrs["src"] = local_address(dsk, width, height)
            image.attrs.pop("data-file-height", None)
            image.attrs.pop("data-file-width", None)
        drawing = first_svg(inline.get(source.get("dsk") or "") or inline.get(image.attrs.get("src") or ""))
        if drawing is not None:
            image.replace([drawing])


def first_svg(text: str | None) -> Node | None:
    """The first drawing of an SVG file."""
    return parse(text).find("svg") if text else None


def rewrite_pages(pages: DataFrame, missing: DataFrame | None = None, embeds: DataFrame | None = None, prefix: str = "/wiki/", sources: DataFrame | None = None) -> DataFrame:
    """(page, html) with links around images and links without target unwrapped, links to missing pages (page, targets)
    marked with the class nopo, images of ``embeds`` (page, images: map of path or address to svg) put in place, and all
    others of ``sources`` (page, sources: map of address to struct of dsk and problem) pointing to where they are served."""
    rows = pages.select("page", "html")
    rows = rows.join(missing.select("page", "targets"), "page", "left") if missing is not None else rows.withColumn("targets", F.array().cast("array<string>"))
    rows = rows.join(embeds.select("page", "images"), "page", "left") if embeds is not None else rows.withColumn("images", F.create_map().cast("map<string,string>"))
    kind = "map<string,struct<dsk:string,problem:string>>"
    rows = rows.join(sources.select("page", F.col("sources").cast(kind).alias("sources")), "page", "left") if sources is not None else rows.withColumn("sources", F.create_map().cast(kind))

    def one(page: str, html: str | None, targets, inline, known) -> tuple[str, str]:
        root, gone = parse(html or ""), set() if targets is None else set(targets)
        local_images(root, {} if known is None else dict(known), {} if inline is None else dict(inline))
        for a in root.find_all("a"):
            image = a.find("img")
            if image is not None:
                a.replace([image])
            elif not a.attrs.get("href"):
                a.unwrap()
            elif _target(a.attrs["href"], prefix) in gone:
                a.attrs["class"] = " ".join([*a.classes, "nopo"])
        return page, body_html(root)

    schema = pa.schema([("page", pa.string()), ("html", pa.string())])
    rows = rows.select("page", "html", "targets", "images", "sources")
    return rows.mapInArrow(lambda batches: by_pieces(batches, one, schema), "page string, html string")
