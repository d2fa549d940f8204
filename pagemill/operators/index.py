"""A positional inverted index over titles and redirects, and its search."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.naming import from_path, title_link
from pagemill.functions.text import normalize_text, split_words
from pagemill.operators.ranking import global_index
from pagemill.storage import materialise

MAX_RESULTS = 500
MAX_POSITION = 254
SAME, DELETE, INSERT = -1000, 200, 25


def redirect_words(redirects: DataFrame) -> DataFrame:
    """(page, redir_words): the distinct word arrays of the redirects (src, dst) that lead to each page, fragments cut."""
    rows = redirects.select(F.substring_index("dst", "#", 1).alias("page"), split_words(normalize_text("src")).alias("words"))
    return rows.groupBy("page").agg(F.array_sort(F.collect_set("words")).alias("redir_words"))


def index_source(chosen: DataFrame, titles: DataFrame, redirects: DataFrame) -> DataFrame:
    """Rows to index (title, link, score, description, orig_words, redir_words) of chosen (page, link, score), titles
    (page, title, summary) and redirects (src, dst). A chosen page without a title, or one entered twice, is an error."""
    t = titles.select("page", "title", "summary", split_words(normalize_text("title")).alias("orig_words"))
    rows = chosen.join(t, "page", "left").join(redirect_words(redirects), "page", "left")
    title = F.when(F.col("orig_words").isNull(), F.raise_error(F.concat(F.lit("no title for "), "page")).cast("string")).otherwise(F.col("title"))
    words = F.filter(F.coalesce("redir_words", F.array().cast("array<array<string>>")), lambda w: w != F.col("orig_words"))
    out = rows.select(title.alias("title"), "link", (50 + F.floor(F.col("score") / 1000)).cast("long").alias("score"), F.col("summary").alias("description"), "orig_words", words.alias("redir_words"))
    many = F.count("*").over(Window.partitionBy("title", "link")) > 1
    return out.withColumn("title", F.when(many, F.raise_error(F.concat(F.lit("duplicate document: "), "title")).cast("string")).otherwise(F.col("title")))


class Index:
    """docs: (docid, rtype, link, title, score, description, subtitle, orig_docid, n_words); postings: (word, docid, pos).

    rtype is 0 for a document, 1 for one whose link follows from its title, 2 for a redirect. Ids count from 0 by
    score, highest first; the redirects of a document follow it.
    """

    def __init__(self, docs: DataFrame, postings: DataFrame, words: DataFrame | None = None):
        self.docs, self.postings = docs, postings
        self.words = postings.select("word").distinct() if words is None else words

    @classmethod
    def create(cls, source: DataFrame) -> "Index":
        """Index rows (title, link, score, description, orig_words, redir_words). An empty source is an error, and so is a word beyond position 254."""
        if source.isEmpty():
            raise ValueError("nothing to index")
        own = source.select("title", "link", "score", "description", F.lit(0).alias("is_redir"), F.col("orig_words").alias("words"))
        redir = source.select("title", "link", "score", "description", F.lit(1).alias("is_redir"), F.explode("redir_words").alias("words"))
        order = [F.desc("score"), F.col("title"), F.col("link"), F.col("is_redir"), F.col("words")]
        rows = global_index(own.unionByName(redir), order, "docid")
        rows = materialise(rows.withColumn("n_words", F.size("words")), "docs")
        parents = rows.filter("is_redir = 0").select(F.col("title").alias("pt"), F.col("link").alias("pl"), F.col("docid").alias("parent"))
        docs = rows.join(parents, F.col("title").eqNullSafe(F.col("pt")) & F.col("link").eqNullSafe(F.col("pl")))
        redirect = F.col("is_redir") == 1
        docs = docs.select(
            "docid", F.when(redirect, 2).when(F.col("link") == title_link("title"), 1).otherwise(0).alias("rtype"),
            F.when(~redirect, F.col("link")).alias("link"), F.when(~redirect, F.col("title")).alias("title"),
            F.when(redirect, F.lit(0)).otherwise(F.col("score")).cast("long").alias("score"), F.when(~redirect, F.col("description")).alias("description"),
            F.when(redirect, F.array_join("words", " ")).otherwise("").alias("subtitle"), F.when(redirect, F.col("parent")).alias("orig_docid"), "n_words",
        )
        return cls(docs, postings_of(rows, "docid", "words"))

    def write(self, path: str, buckets: int = 64) -> None:
        """All tables as Parquet; postings sorted by word, so that a word's row groups can be skipped to; the words once each."""
        self.docs.write.parquet(f"{path}/docs")
        self.postings.repartitionByRange(buckets, "word").sortWithinPartitions("word", "docid", "pos").write.parquet(f"{path}/postings")
        self.words.write.parquet(f"{path}/words")

    @classmethod
    def read(cls, spark, path: str) -> "Index":
        return cls(*(spark.read.parquet(f"{path}/{t}") for t in ("docs", "postings", "words")))

    def keys(self) -> DataFrame:
        return self.words

    def items(self) -> DataFrame:
        """(word, docset): the sorted (docid, pos) of each word. A very common word makes a large value; prefer ``postings``."""
        return self.postings.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("docid", "pos"))).alias("docset"))

    def values(self) -> DataFrame:
        return self.docs.orderBy("docid")

    def count(self) -> int:
        return self.docs.count()

    def indexed(self) -> DataFrame:
        """One row: how many distinct pairs of word and document there are."""
        return self.postings.select("word", "docid").distinct().agg(F.count("*").alias("indexed"))

    def contains(self, word: str) -> bool:
        return bool(self.postings.filter(F.col("word") == word).take(1))

    def random(self, seed: int) -> DataFrame:
        """One document, all equally likely, redirects included."""
        n = self.docs.agg(F.count("*").alias("n")).select(F.floor(F.rand(seed) * F.col("n")).alias("docid"))
        return resolve(self.docs, self.docs.join(F.broadcast(materialise(n, "pick")), "docid"))  # one row

    def get_doc(self, docid: int) -> DataFrame:
        """The document of an id, a redirect with the data of its original; no row if there is none."""
        return resolve(self.docs, self.docs.filter(F.col("docid") == docid))

    def search(self, text: str, limit: int = MAX_RESULTS) -> DataFrame:
        return search(self.docs, self.postings, text, limit, self.words)


def postings_of(rows: DataFrame, docid: str, words: str) -> DataFrame:
    pos = F.when(F.col("pos") > MAX_POSITION, F.raise_error(F.lit("a title has too many words")).cast("int")).otherwise(F.col("pos"))
    return rows.select(docid, F.posexplode(words).alias("pos", "word")).select("word", F.col(docid).alias("docid"), pos.alias("pos"))


def resolve(docs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Redirects get link, title, score and description of their original; rtype and subtitle are their own. Of some
    ``wanted`` rows of docs, which are few, only the originals are looked up."""
    original = docs.select(F.col("docid").alias("od"), *[F.col(c).alias(f"o_{c}") for c in ("link", "title", "score", "description")])
    if wanted is not None:
        original = original.join(wanted.select(F.col("orig_docid").alias("od")).distinct(), "od", "left_semi")
    rows = (wanted if wanted is not None else docs).join(original, F.col("orig_docid") == F.col("od"), "left")
    pick = [F.when(F.col("rtype") == 2, F.col(f"o_{c}")).otherwise(F.col(c)).alias(c) for c in ("link", "title", "score", "description")]
    return rows.select("docid", "rtype", *pick, "subtitle", "n_words")


def weighted_distance(keys: Column, phrase: Column) -> Column:
    """Edit distance of word arrays: dropping a key costs 200, an extra word 25, a replacement by how the key is part of the word.

    Equal arrays are at -1000. The first row of the table is floor(c * 25 ** 1.2). A fold over the keys, each a fold
    over the phrase, so that it stays in the JVM.
    """
    n = F.size(phrase)
    first = F.transform(F.sequence(F.lit(0), n), lambda c: F.floor(c * F.pow(F.lit(float(INSERT)), F.lit(1.2))).cast("int"))

    def cost(k: Column, p: Column) -> Column:
        diff = F.length(p) - F.length(k)
        return F.when(k == p, 0).when(F.startswith(p, k), 15 * diff).when(F.contains(p, k), 30 * diff).otherwise(30 * (diff + 2 * F.length(k)))

    def next_row(row: Column, k: Column) -> Column:
        def cell(made: Column, c: Column) -> Column:
            best = F.least(F.get(row, c) + DELETE, F.get(made, c - 1) + INSERT, F.get(row, c - 1) + cost(k, F.get(phrase, c - 1)))
            return F.array_append(made, best)

        steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, F.array((F.get(row, F.lit(0)) + DELETE).cast("int")), cell)

    return F.when(keys == phrase, F.lit(SAME)).otherwise(F.element_at(F.aggregate(keys, first, next_row), -1))


def order_factor(docid: Column) -> Column:
    return F.floor(40000 * F.pow(docid + 1, F.lit(-0.5))).cast("int")


#: Words in a query, beyond which it is refused: each one is compared with the whole vocabulary.
MOST_KEYS = 1000


def matching_docs(postings: DataFrame, keys: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(docid, hits) of documents that have all keys (key_idx, key), each inside some word; hits: (pos, word) of the words found.

    Keys are few (a query's words, MOST_KEYS at most in ``search``), so each word of the vocabulary ``words`` is compared
    with all; then the postings of those found are read.
    """
    keys = F.broadcast(keys)  # the words of one query
    total = keys.agg(F.count_distinct("key").alias("n_keys"))
    vocabulary = postings.select("word").distinct() if words is None else words
    words = vocabulary.join(keys, F.contains(F.col("word"), F.col("key"))).select("word", "key")
    hits = postings.join(words, "word")
    grouped = hits.groupBy("docid").agg(F.count_distinct("key").alias("n"), F.collect_set(F.struct("pos", "word")).alias("hits"))
    return grouped.join(F.broadcast(total), F.col("n") == F.col("n_keys")).select("docid", "hits")


def search(docs: DataFrame, postings: DataFrame, text: str, limit: int = MAX_RESULTS, vocabulary: DataFrame | None = None) -> DataFrame:
    """(docid, rtype, link, title, score, description, subtitle, rank), best first, one row for each link.

    A document is found if every word of the query is part of one of its words. Its rank is the order factor of
    its id less the weighted distance between the query and its words, those not found being empty. A query
    without words finds nothing.
    """
    spark = docs.sparkSession
    from pagemill.functions.text import plain

    words = plain(text).split()
    columns = ["docid", "rtype", "link", "title", "score", "description", "subtitle"]
    if not words:
        return resolve(docs).select(*columns, F.lit(0).alias("rank")).limit(0)
    if len(words) > MOST_KEYS:
        raise ValueError(f"a query has {MOST_KEYS} words at most")
    keys = spark.createDataFrame(list(enumerate(words)), "key_idx int, key string")
    hits = matching_docs(postings, keys, vocabulary)
    rows = docs.join(hits, "docid")  # only what was found is resolved
    found = resolve(docs, rows.drop("hits")).join(hits, "docid")
    places = F.map_from_entries("hits")
    phrase = F.transform(F.sequence(F.lit(0), F.col("n_words") - 1), lambda i: F.coalesce(F.get(F.map_values(F.map_filter(places, lambda k, v: k == i)), F.lit(0)), F.lit("")))
    ranked = found.withColumn("rank", order_factor(F.col("docid")) - weighted_distance(F.array(*[F.lit(w) for w in words]), phrase))
    best = F.row_number().over(Window.partitionBy("link").orderBy(F.desc("rank"), F.desc("docid")))
    return ranked.withColumn("__pm_r", best).filter("__pm_r = 1").orderBy(F.desc("rank"), F.desc("docid")).limit(limit).select(*columns, "rank")


def result_link(link: Column | str) -> Column:
    """The address of a result's page."""
    return F.concat(F.lit("wiki/"), F.replace(F.url_encode(from_path(link)), F.lit("+"), F.lit("%20")))


def docid_deltas(postings: DataFrame) -> DataFrame:
    """(word, docid, delta): the step from the document before among those of a word."""
    rows = postings.select("word", "docid").distinct()
    return rows.withColumn("delta", F.col("docid") - F.lag("docid", 1, 0).over(Window.partitionBy("word").orderBy("docid")))


def encode_docset(docset: dict[int, list[int]]) -> bytes:
    """Positions one byte each, 0xFF, then the steps between document ids as 7-bit numbers, low part first."""
    pairs = sorted((d, p) for d, ps in docset.items() for p in ps)
    if not pairs:
        return b""
    if any(not 0 <= p <= MAX_POSITION for _, p in pairs):
        raise ValueError("position out of range")
    out, last = bytearray(p for _, p in pairs), 0
    out.append(0xFF)
    for doc, _ in pairs:
        step, last = doc - last, doc
        while step > 127:
            out.append(step & 127 | 128)
            step >>= 7
        out.append(step)
    return bytes(out)


@F.pandas_udf(T.BinaryType())
def pack_docset(docsets: pd.Series) -> pd.Series:
    """Column form of ``encode_docset`` for arrays of (docid, pos)."""

    def one(docset) -> bytes:
        by_doc: dict[int, list[int]] = {}
        for p in docset:
            by_doc.setdefault(int(p["docid"]), []).append(int(p["pos"]))
        return encode_docset(by_doc)

    return docsets.map(one, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("docid", T.LongType()), T.StructField("pos", T.IntegerType())])))
def unpack_docset(packed: pd.Series) -> pd.Series:
    """Column form of ``decode_docset``: sorted arrays of (docid, pos)."""
    return packed.map(lambda b: [{"docid": d, "pos": p} for d, ps in sorted(decode_docset(bytes(b)).items()) for p in sorted(ps)], na_action="ignore")


def decode_docset(data: bytes) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    if not data:
        return out
    cut = data.index(0xFF)
    doc = value = shift = at = 0
    for b in data[cut + 1 :]:
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            doc += value
            out.setdefault(doc, []).append(data[at])
            at, value, shift = at + 1, 0, 0
    return out
