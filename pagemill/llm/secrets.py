"""Secret scans: in how many repositories and owners does a candidate occur?"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.storage import materialise

#: (kind, pattern, what every match has one of); the first group of a pattern is the secret. Java and RE2 read them alike.
#: Patterns that begin with (?i) ignore case; what their matches have one of is then in lower case.
KINDS: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("aws_access_key", r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b", ("AKIA", "ASIA")),
    ("github_token", r"\b(gh[pousr]_[0-9A-Za-z]{36})\b", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    ("slack_token", r"\b(xox[abprs]-[0-9A-Za-z-]{10,})\b", ("xox",)),
    ("google_key", r"\b(AIza[0-9A-Za-z_-]{35})\b", ("AIza",)),
    ("jwt", r"\b(eyJ[0-9A-Za-z_-]{10,}\.eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,})", ("eyJ",)),
    ("private_key", r"(-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----[0-9A-Za-z+/=\s]{20,}-----END)", ("PRIVATE KEY",)),
    ("assigned", r"(?i)(?:token|secret|password|passwd|api_key|apikey|access_key)[\"']?[ \t]*[=:][ \t]*[\"']?([0-9A-Za-z_+/=.-]{8,})", ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key")),
)
#: Owners from which a candidate counts as widely copied, and the least number of different characters of a live one.
WIDE_OWNERS, LEAST_DISTINCT = 3, 6
_PLACEHOLDER = "(?i)example|placeholder|changeme|your|xxxx|0000|1234|dummy|sample|redacted"


def candidates(docs: DataFrame, repo: str = "lang", owner: str = "source") -> DataFrame:
    """Rows (doc_id, repo, owner, kind, secret) for every occurrence; a repository belongs to its owner."""

    def of_kind(kind: str, pattern: str, literals: tuple[str, ...]):
        within = F.lower("text") if pattern.startswith("(?i)") else F.col("text")
        some = functools.reduce(operator.or_, [F.contains(within, F.lit(x)) for x in literals])  # far cheaper than the pattern
        matches = F.when(some, F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).otherwise(F.array().cast("array<string>"))
        return F.transform(matches, lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("secret")))

    found = [of_kind(*kind) for kind in KINDS]
    rows = docs.select("doc_id", F.col(repo).alias("repo"), F.col(owner).alias("owner"), "text").filter("text IS NOT NULL")
    return rows.select("doc_id", "repo", "owner", F.explode(F.concat(*found)).alias("f")).select("doc_id", "repo", "owner", "f.kind", "f.secret")


def scan(docs: DataFrame, repo: str = "lang", owner: str = "source") -> DataFrame:
    """Rows (doc_id, kind, secret_hash, n, repos, owners, docs, verdict) by document and candidate.

    n counts its occurrences in the document; repos (owner and repository together), owners and docs count over the
    whole corpus in how many different ones it occurs. The verdict is example for a candidate of WIDE_OWNERS owners
    or more or one that looks like a placeholder, live for any other of a single owner with LEAST_DISTINCT different
    characters or more, else shared. Secrets leave the scan as SHA-256 only. Counting is by two nested groupings, so
    a candidate that millions of documents copy is first summed where it is read. Cases: null and empty texts have
    no candidates; a very long text is searched whole, and a candidate of any length is taken whole; a null owner,
    repository or doc_id counts as one value; repeated rows add to n; a text that two kinds match (a tie) gives a row of
    each kind; columns other than the four named are not read, so their names can't clash; an empty table gives no rows.
    """
    rows = candidates(docs, repo, owner).withColumn("secret_hash", F.sha2("secret", 256))
    fake = F.col("secret").rlike(_PLACEHOLDER) | (F.size(F.array_distinct(F.split("secret", ""))) < LEAST_DISTINCT)
    slim = rows.groupBy("secret_hash", "kind", "owner", "repo", "doc_id").agg(F.count("*").alias("n"), F.bool_or(fake).alias("fake"))
    slim = materialise(slim, "candidates")
    by_repo = slim.groupBy("secret_hash", "owner", "repo").agg(F.bool_or("fake").alias("fake"))
    by_owner = by_repo.groupBy("secret_hash", "owner").agg(F.count("*").alias("repos"), F.bool_or("fake").alias("fake"))
    spread = by_owner.groupBy("secret_hash").agg(F.sum("repos").alias("repos"), F.count("*").alias("owners"), F.bool_or("fake").alias("fake"))
    by_doc = slim.groupBy("secret_hash", "kind", "doc_id").agg(F.sum("n").alias("n"))
    docs_of = by_doc.select("secret_hash", "doc_id").distinct().groupBy("secret_hash").agg(F.count("*").alias("docs"))
    verdict = F.when((F.col("owners") >= WIDE_OWNERS) | F.col("fake"), "example").when(F.col("owners") == 1, "live").otherwise("shared")
    stats = materialise(spread.join(docs_of, "secret_hash").select("secret_hash", "repos", "owners", "docs", verdict.alias("verdict")), "spread")
    return by_doc.join(stats, "secret_hash").select("doc_id", "kind", "secret_hash", "n", "repos", "owners", "docs", "verdict")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text"))


def sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    parts = " UNION ALL ".join(f"SELECT doc_id, lang, source, {q(k)} AS kind, unnest(regexp_extract_all(text, {q(p)}, 1)) AS secret FROM documents" for k, p, _ in KINDS)
    return f"""
WITH c AS ({parts}),
h AS (SELECT *, sha256(secret) AS secret_hash, regexp_matches(secret, {q(_PLACEHOLDER)}) OR len(list_distinct(string_split(secret, ''))) < {LEAST_DISTINCT} AS fake FROM c),
s AS (SELECT secret_hash, count(DISTINCT (source, lang)) AS repos, count(DISTINCT coalesce(source, chr(0))) AS owners,
        count(DISTINCT coalesce(doc_id::VARCHAR, '')) AS docs, bool_or(fake) AS fake FROM h GROUP BY secret_hash),
g AS (SELECT doc_id, kind, secret_hash, count(*) AS n FROM h GROUP BY doc_id, kind, secret_hash)
SELECT doc_id, kind, secret_hash, n, repos, owners, docs,
  CASE WHEN owners >= {WIDE_OWNERS} OR fake THEN 'example' WHEN owners = 1 THEN 'live' ELSE 'shared' END AS verdict
FROM g JOIN s USING (secret_hash)
"""
