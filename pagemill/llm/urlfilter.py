"""URL filters: rules indexed by their rarest literal token."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.common import BROADCAST_BYTES, small
from pagemill.storage import materialise

#: Rules: ||host^ anchors at a host, | at an end of the URL, * is any run, ^ a separator or the end; @@ allows.
RULES: tuple[str, ...] = (
    "||cheap-pills.example.com^", "||free-bets.example.com^", "||spam-farm.example.com^", "||spam-farm.", "||example.net/fr/",
    "*page=2&ref=*", "/en/1*", "ref=x|", "|http://m.", "|http://blog.*/de/", "-pills.", "free-*.com/es^", "||*.example.org^*page=", "/fr/*9?",
    "://theron.", "||theror.example.com^", "utm_source=", "/login|", "casino", "||tracker.", "*&sid=*", "@@||free-bets.example.com/en/1", "@@||m.ththre.",
)


def regex_of(rule: str) -> str:
    """The rule as a regular expression (for a search) that Java and RE2 read alike."""
    body = rule.removeprefix("@@")
    head = tail = ""
    if body.startswith("||"):
        head, body = r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        head, body = "^", body[1:]
    if body.endswith("|"):
        tail, body = "$", body[:-1]
    out = "".join({"*": ".*", "^": "(?:[^a-z0-9_.%-]|$)"}.get(c) or re.sub(r"([^a-z0-9_])", r"\\\1", c) for c in body)
    return head + out + tail


def tokens_of(rule: str) -> list[str]:
    """Literal tokens that every URL matching the rule has as whole tokens: runs of letters and digits that no
    wildcard or open end of the pattern touches."""
    body = rule.removeprefix("@@")
    fixed_start, fixed_end = body.startswith("|"), body.endswith("|")
    body = body.lstrip("|")
    body = body[:-1] if fixed_end else body
    found = []
    for m in re.finditer(r"[a-z0-9]+", body):
        left = body[m.start() - 1] != "*" if m.start() else fixed_start
        right = body[m.end()] != "*" if m.end() < len(body) else fixed_end
        if left and right:
            found.append(m.group())
    return found


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    lower = [r.lower() for r in rules]
    rows = [(i, r, regex_of(r), r.startswith("@@"), sorted(set(tokens_of(r)))) for i, r in enumerate(lower)]
    return spark.createDataFrame(rows, "rule_id int, rule string, regex string, allows boolean, tokens array<string>")


def matches(pages: DataFrame, rules=RULES) -> DataFrame:
    """Rows (page_id, url, rule_id, rule, allows) for every rule that matches the lower-cased URL.

    How many URLs hold each token of a rule is counted over all URLs; a rule is entered in the index under its
    rarest one (ties: the first in order). The distinct tokens of a URL fetch their rules, and only these run. Rules
    without a whole literal token are fetched by every URL. The index is broadcast if checked to be small. Cases: a
    null URL matches nothing; an empty URL has no tokens and only meets rules without; a very long URL fetches by all its
    tokens and is matched whole; a null page_id stays; every repeated row gives its own rows; columns other than page_id
    and url are not read, so their names can't clash; without rules or pages there are no rows.
    """
    spark = pages.sparkSession
    table = rules_table(spark, rules)
    urls = pages.filter("url IS NOT NULL").select("page_id", "url", F.lower("url").alias("u"))
    split = F.filter(F.array_distinct(F.split("u", "[^a-z0-9]+")), lambda t: t != "")
    each = urls.select("page_id", "url", "u", F.explode(F.concat(split, F.array(F.lit("")))).alias("token"))
    wanted = table.select("rule_id", F.explode("tokens").alias("token"))
    named = {t for r in rules for t in tokens_of(r.lower())}
    known = wanted.select("token").distinct()
    few = sum(64 + len(t) for t in named) <= BROADCAST_BYTES
    seen = each.join(F.broadcast(known) if few else known, "token", "left_semi")
    seen = seen.groupBy("token").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("rule_id").orderBy(F.coalesce("n", F.lit(0)), "token"))
    rarest = wanted.join(seen, "token", "left").withColumn("r", rank).filter("r = 1").select("rule_id", "token")
    index = table.join(rarest, "rule_id", "left").select("rule_id", "rule", "regex", "allows", F.coalesce("token", F.lit("")).alias("token"))
    index = small(materialise(index, "rules"), 64 + F.length("rule") + F.length("regex") + F.length("token"))
    return each.join(index, "token").filter(F.rlike("u", "regex")).select("page_id", "url", "rule_id", "rule", "allows")


def blocked(pages: DataFrame, rules=RULES) -> DataFrame:
    """Distinct (page_id, url) that some rule blocks and none allows."""
    found = matches(pages, rules).groupBy("page_id", "url").agg(F.bool_or("allows").alias("allowed"))
    return found.filter(~F.col("allowed")).select("page_id", "url")


def query(spark, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def sql(rules=RULES) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {q(r.lower())}, {q(regex_of(r.lower()))}, {str(r.startswith('@@')).lower()})" for i, r in enumerate(rules))
    return f"""
SELECT page_id, url, rule_id, rule, allows FROM pages JOIN (VALUES {values}) v(rule_id, rule, regex, allows) ON regexp_matches(lower(url), regex)
"""
