"""Quality rules: robust multivariate outliers by minimum covariance determinant, per language and source."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import give_back, pieces, spread
from pagemill.storage import materialise

#: Least standard deviation of each statistic: differences below it never count as unusual.
FLOOR = (0.025, 0.03, 0.05, 0.02, 0.05)
DIM = len(FLOOR)
#: Share of a group in the subset that the determinant is minimised over, so junk up to half of a group can't move it,
#: and the factor that makes the covariance of such a subset consistent for normal data (h / P(chi2_7 <= chi2_5 quantile of h)).
SUBSET, CONSISTENCY = 0.5, 1.9122
#: Random starts besides that of the group's and that of its language's medians; the best of all that go on.
STARTS, BEST = 30, 5
#: The estimate has settled when a C-step lowers the logarithm of the determinant by less than SETTLED. It never rises, so
#: the steps end; after MOST_STEPS the job fails rather than give an estimate that has not settled.
SETTLED, MOST_STEPS = 1e-3, 60
#: Chi-square quantile 1 - 1e-6 with 5 degrees of freedom.
CUTOFF = 35.889
#: Ten documents a statistic, below which a covariance is not estimated: smaller groups are pooled by language, and such
#: pools below it together; in a remainder below it nothing is rejected.
MIN_GROUP = 50
_LOW = [(i, j) for i in range(DIM) for j in range(i + 1)]
_PARAMS = [f"m{i}" for i in range(DIM)] + [f"w{i}_{j}" for i, j in _LOW]
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\f\x0b")] = True


def _counts(texts: pa.Array) -> np.ndarray:
    """Of each text (n x 6): characters, symbols, capitals, full stops and commas, words, words that repeat the one before.
    Words are runs of characters other than ASCII white space."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    up_to = lambda flags: np.r_[0, np.cumsum(flags)]
    within = lambda flags: np.diff(up_to(flags)[offsets])
    out = np.zeros((len(texts), 6))
    out[:, 0] = within((data & 0xC0) != 0x80)
    out[:, 1] = pc.count_substring_regex(texts, r"[^\p{L}\p{N}\s\v.,]").to_numpy(zero_copy_only=False)
    out[:, 2] = pc.count_substring_regex(texts, r"\p{Lu}").to_numpy(zero_copy_only=False)
    out[:, 3] = within((data == ord(".")) | (data == ord(",")))
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    opening = offsets[:-1][np.diff(offsets) > 0]
    begins[opening] = solid[opening]  # a text's first word doesn't go on from the text before
    ends[opening[1:] - 1] = solid[opening[1:] - 1]
    starts, sizes = np.flatnonzero(begins), np.flatnonzero(ends) + 1 - np.flatnonzero(begins)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    out[:, 4] = np.bincount(owner, minlength=len(texts))
    like = np.flatnonzero((sizes[1:] == sizes[:-1]) & (owner[1:] == owner[:-1]))
    same = data[spread(starts[like], sizes[like])] == data[spread(starts[like + 1], sizes[like])]
    if len(like):
        all_same = np.logical_and.reduceat(same, np.cumsum(sizes[like]) - sizes[like])
        out[:, 5] = np.bincount(owner[like[all_same]], minlength=len(texts))
    return out


def plain_statistics(texts: pa.Array) -> np.ndarray:
    """Five transformed statistics (n x 5): square roots of the densities of symbols, capitals, repeated words and full
    stops or commas, and the logarithm of the mean word length. Constants pull very short texts to usual values."""
    n, symbols, capitals, stops, words, again = _counts(texts).T
    columns = [np.sqrt((symbols + 0.5) / (n + 200)), np.sqrt((capitals + 4) / (n + 200)), np.sqrt((again + 0.5) / (words + 40))]
    return np.stack([*columns, np.sqrt((stops + 4) / (n + 200)), np.log((n - words + 200) / (words + 40))], axis=1)


_STRUCT = T.StructType([T.StructField(f"x{i}", T.DoubleType(), False) for i in range(DIM)])


@F.arrow_udf(_STRUCT)
def _statistics(texts: pa.Array) -> pa.Array:
    parts = [plain_statistics(b.column(0)) for b in pieces(pa.RecordBatch.from_arrays([texts], names=["text"]), 0)]
    x = np.concatenate(parts) if parts else np.zeros((0, DIM))
    give_back()
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x[:, i])) for i in range(DIM)], names=[f"x{i}" for i in range(DIM)])


def statistics(text: Column) -> Column:
    """A struct of the five statistics x0 .. x4; a null text counts as an empty one."""
    return _statistics(text)


def _distance(x: list[Column], prefix: str = "") -> Column:
    """Squared Mahalanobis distance of the statistics from the joined estimate."""
    z = [x[i] - F.col(f"{prefix}m{i}") for i in range(DIM)]
    total = F.lit(0.0)
    for i in range(DIM):
        part = F.lit(0.0)
        for j in range(i + 1):
            part = part + F.col(f"{prefix}w{i}_{j}") * z[j]
        total = total + part * part
    return total


def whiten(cov: np.ndarray) -> np.ndarray:
    return np.linalg.inv(np.linalg.cholesky(cov))


def _row(key: str, mu: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
    w = whiten(cov)
    return pd.DataFrame([[key, *mu, *[w[i, j] for i, j in _LOW], False]], columns=["g", *_PARAMS, "settled"])


def _moments(n: np.ndarray, sums: np.ndarray, products: np.ndarray, order: np.ndarray, need: float, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the first ``need`` documents of the summed-up bins, in the given order; of the bin in which
    they end, the share that it takes."""
    upto = np.cumsum(n[order])
    weight = np.zeros(len(n))
    weight[order] = np.clip((need - (upto - n[order])) / n[order], 0, 1)
    mean = weight @ sums / need
    cov = np.empty((DIM, DIM))
    low = weight @ products / need
    for k, (i, j) in enumerate(_LOW):
        cov[i, j] = cov[j, i] = low[k] - mean[i] * mean[j]
    return mean, factor * cov + np.diag(np.square(FLOOR))


def _log_det(cov: np.ndarray) -> float:
    return float(np.linalg.slogdet(cov)[1])


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    """The least determinant over many starts, on the bins of one group; all of its documents count."""
    pdf = pdf.sort_values([f"b{i}" for i in range(DIM)])
    r, n = pdf.iloc[0], pdf["n"].to_numpy(float)
    sums, products = pdf[[f"s{i}" for i in range(DIM)]].to_numpy(float), pdf[[f"p{i}_{j}" for i, j in _LOW]].to_numpy(float)
    centres, need = sums / n[:, None], SUBSET * n.sum()  # from the group's medians

    def step(mu: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = (centres - mu) @ whiten(cov).T
        return _moments(n, sums, products, np.argsort((z * z).sum(1), kind="stable"), need, CONSISTENCY)

    starts = [(np.zeros(DIM), np.diag([r[f"q{i}"] ** 2 for i in range(DIM)]))]
    starts.append((np.array([r[f"lc{i}"] - r[f"c{i}"] for i in range(DIM)]), np.diag([r[f"lq{i}"] ** 2 for i in range(DIM)])))
    rng = np.random.default_rng(20240607)
    for _ in range(STARTS):
        few = centres[rng.choice(len(n), min(DIM + 1, len(n)), replace=False, p=n / n.sum())]
        starts.append((few.mean(0), np.cov(few.T, bias=True) + np.diag(np.square(FLOOR))))
    tried = []
    for mu, cov in starts:
        for _ in range(2):
            mu, cov = step(mu, cov)
        tried.append((_log_det(cov), mu, cov))
    best = None
    for _, mu, cov in sorted(tried, key=lambda t: t[0])[:BEST]:
        now = np.inf
        while _log_det(cov) < now - SETTLED:
            now, kept = _log_det(cov), (mu, cov)
            mu, cov = step(mu, cov)
        if best is None or now < best[0]:
            best = now, *kept
    return _row(r["g"], best[1] + np.array([r[f"c{i}"] for i in range(DIM)]), best[2])


def _c_step(pdf: pd.DataFrame) -> pd.DataFrame:
    """The next estimate of a group from sums by distance bucket, or the same one if the determinant gets no less."""
    pdf = pdf.sort_values("b")
    r, n = pdf.iloc[0], pdf["n"].to_numpy(float)
    sums, products = pdf[[f"s{i}" for i in range(DIM)]].to_numpy(float), pdf[[f"p{i}_{j}" for i, j in _LOW]].to_numpy(float)
    mean, cov = _moments(n, sums, products, np.arange(len(n)), SUBSET * n.sum(), CONSISTENCY)
    before = -2 * float(sum(np.log(r[f"w{i}_{i}"]) for i in range(DIM)))
    if _log_det(cov) >= before - SETTLED:
        return pd.DataFrame([[r["g"], *[r[c] for c in _PARAMS], True]], columns=["g", *_PARAMS, "settled"])
    return _row(r["g"], np.array([r[f"m{i}"] for i in range(DIM)]) + mean, cov)


_SCHEMA = "g string, " + ", ".join(f"{c} double" for c in _PARAMS) + ", settled boolean"
_X = [f"x{i}" for i in range(DIM)]


def _sums(prefix: str) -> list[Column]:
    """Numbers, sums and products of the statistics as they differ from the columns of ``prefix``."""
    z = [F.col(f"x{i}") - F.col(f"{prefix}{i}") for i in range(DIM)]
    return [F.count("*").alias("n"), *[F.sum(z[i]).alias(f"s{i}") for i in range(DIM)], *[F.sum(z[i] * z[j]).alias(f"p{i}_{j}") for i, j in _LOW]]


def _quartiles(rows: DataFrame, by: str, centre: str, scale: str) -> DataFrame:
    q = rows.groupBy(by).agg(*[F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(DIM)])
    centres = [F.col(f"q{i}")[1].alias(f"{centre}{i}") for i in range(DIM)]
    return q.select(by, *centres, *[F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOOR[i])).alias(f"{scale}{i}") for i in range(DIM)])


def estimates(docs: DataFrame) -> DataFrame:
    """Robust centre and whitening matrix for each (lang, source): columns __pm_l, __pm_s and those of the estimate.

    Every document counts at every step. The documents of a group are summed up in bins of its robust scale, at most
    11 a statistic, and on these bins the least determinant is sought from many starts: the medians of the group, those of
    its language, and STARTS random ones. From there C-steps go on over the documents themselves: moments are summed by
    group and distance bucket, and the buckets nearest to the centre that hold SUBSET of the group give the next estimate,
    until no determinant gets less. What is joined back has a row for each group.
    """
    x = F.col("__pm_x")
    rows = docs.select(F.col("lang").alias("l"), F.col("source").alias("s"), statistics(docs["text"]).alias("__pm_x"))
    rows = materialise(rows.select("l", "s", *[x[f"x{i}"].alias(f"x{i}") for i in range(DIM)]), "statistics")
    counts = rows.groupBy("l", "s").agg(F.count("*").alias("n"))
    small = F.col("n") < MIN_GROUP
    pool = F.sum(F.when(small, F.col("n"))).over(Window.partitionBy("l"))
    key = F.when(~small, F.concat(F.lit("g"), F.to_json(F.struct("l", "s")))).when(pool >= MIN_GROUP, F.concat(F.lit("l"), F.to_json(F.struct("l")))).otherwise("rest")
    groups = counts.withColumn("g", key)
    groups = groups.withColumn("size", F.sum("n").over(Window.partitionBy("g"))).filter(F.col("size") >= MIN_GROUP)
    groups = materialise(groups.select(F.col("l").alias("gl"), F.col("s").alias("gs"), "g"), "groups")
    keyed = rows.join(groups, F.col("l").eqNullSafe(F.col("gl")) & F.col("s").eqNullSafe(F.col("gs"))).select("g", *_X)
    of_language = _quartiles(rows.withColumn("l", F.to_json(F.struct("l"))), "l", "lc", "lq")
    language = groups.groupBy("g").agg(F.min(F.to_json(F.struct(F.col("gl").alias("l")))).alias("l"))
    start = materialise(_quartiles(keyed, "g", "c", "q").join(language, "g").join(of_language, "l").drop("l"), "start")
    bins = [F.greatest(F.lit(-5), F.least(F.lit(5), F.round((F.col(f"x{i}") - F.col(f"c{i}")) / F.col(f"q{i}")))).cast("int").alias(f"b{i}") for i in range(DIM)]
    summed = keyed.join(start.select("g", *[f"{a}{i}" for a in "cq" for i in range(DIM)]), "g").groupBy("g", *bins).agg(*_sums("c"))
    now = materialise(summed.join(start, "g").groupBy("g").applyInPandas(_search, _SCHEMA), "search")

    for _ in range(MOST_STEPS):
        at = keyed.join(now.filter("NOT settled").drop("settled"), "g").withColumn("b", F.floor(16 * F.log1p(_distance([F.col(c) for c in _X]))).cast("int"))
        moments = at.groupBy("g", "b").agg(*_sums("m"), *[F.first(c).alias(c) for c in _PARAMS])
        stepped = moments.groupBy("g").applyInPandas(_c_step, _SCHEMA)
        now = materialise(now.filter("settled").unionByName(stepped), "estimate")
        if not now.filter("NOT settled").head(1):
            break
    else:
        raise RuntimeError("the determinants did not settle")
    out = groups.join(now, "g").select(F.col("gl").alias("__pm_l"), F.col("gs").alias("__pm_s"), *[F.col(c).alias(f"__pm_{c}") for c in _PARAMS])
    return materialise(out, "estimates")


def keep_usual(docs: DataFrame, distance: str | None = None) -> DataFrame:
    """The documents whose squared distance from their group's robust centre is at most CUTOFF.

    The statistics are computed again beside the text, so that no text is shuffled. ``distance`` names a column to
    add (replacing one of that name). Cases: null languages and sources form groups of their own; a null or empty
    text counts as one without any character, a very long one like any other; small groups are pooled as MIN_GROUP says,
    and documents of groups without an estimate are kept, with a null distance; repeated rows are judged alike and each
    counts; documents at equal distances (ties) enter a subset together, by the share that it takes of their bucket;
    columns of any other name pass through; an empty table gives none.
    """
    near = docs.join(estimates(docs), docs["lang"].eqNullSafe(F.col("__pm_l")) & docs["source"].eqNullSafe(F.col("__pm_s")), "left")
    near = near.withColumn("__pm_x", statistics(docs["text"]))
    near = near.withColumn("__pm_d", _distance([F.col(f"__pm_x.x{i}") for i in range(DIM)], "__pm_"))
    kept = near.filter(F.coalesce(F.col("__pm_d") <= CUTOFF, F.lit(True)))
    columns = [docs[c] for c in docs.columns if c != distance]
    return kept.select(*columns, *([F.col("__pm_d").alias(distance)] if distance else []))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    return keep_usual(docs, "distance").drop("text")
