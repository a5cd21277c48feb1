"""Document quality by a classifier and the record of the site, combined by empirical Bayes.

Evidence. Two logistic models are fitted on the labelled rows: quality on surface features
of a text, toxicity on the words that the labels show to be toxic (those whose log-odds are
large against their standard error) beside the same features. At most `sample` labelled
rows are used, those with the smallest hash of their id; corpus statistics cover all rows.

Sites. A document's host is its source, its path the source and the language. Mean evidence
by host is shrunk toward the corpus mean, and by path toward its host's posterior, each by
(n * mean + k * above) / (n + k). k is the ratio of the variance within to that between
groups, by moments over all groups; no variance between them means k without end, and the
level says nothing. So a sparse site takes the prior of what stands above it. A document's
log-odds are its own plus what its path's posterior departs from the corpus mean.

Verdict. A document stays if its quality is at least `least` and its toxicity below `most`.
Null or empty texts have no evidence for either: their quality is that of the features.
A null source or language is a host or path of its own. Rows of an equal (also null) id
each have a row. Labels of one class only, or none, give every text that class's evidence
(or quality 1 and toxicity 0).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.common import map_rows, write_stage

WORD = re.compile(r"\w+")
FEATURES = 11
EDGE = 1e-6


def features(text: str, toxic: dict[str, float]) -> list[float]:
    """Surface features of a whole text, and its evidence from toxic words."""
    words = text.split()
    n = max(1, len(words))
    distinct = set(words)
    tail = sum(not w[-1].isalnum() and w[-1] not in ".,;:!?)\"'" or w[-2:] in ("!!", "??") for w in words)
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    signs = sum(not WORD.search(w) for w in words)
    same = sum(a == b for a, b in zip(words, words[1:]))
    lines = text.split("\n")
    hits = [toxic[x] for x in {x.lower() for w in distinct for x in WORD.findall(w)} if x in toxic] if toxic else []
    return [1.0, np.log(n), len(distinct) / n, len(distinct) / n * np.log(n), tail / n, upper / n, signs / n, same / n,
            1 - len(set(lines)) / len(lines), float(sum(hits)), float(bool(hits))]


def featured(docs: DataFrame, toxic: dict[str, float]) -> DataFrame:
    """doc_id, host, lang and x, the features."""
    def run(batch):
        x = np.array([features(t or "", toxic) for t in batch.column(3).to_pylist()]).reshape(-1)
        return pa.table({"doc_id": batch.column(0), "host": batch.column(1), "lang": batch.column(2),
                         "x": pa.ListArray.from_arrays(np.arange(0, len(x) + 1, FEATURES, dtype=np.int32), pa.array(x))})
    return map_rows(docs, run, "doc_id long, host string, lang string, x array<double>")


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights by Newton steps, with a ridge; a single class gives a constant."""
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else 0.0
        return w
    scale = np.maximum(x.std(axis=0), 1e-9)
    scale[0] = 1
    z = x / scale
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def toxic_words(labelled: DataFrame, words: int = 2000, z: float = 4.0) -> dict[str, float]:
    """Words whose document frequency among toxic rows is significantly higher: their log-odds, at most `words`."""
    n = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return {}
    each = labelled.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), 1))).alias("w"))
    counts = each.groupBy("w").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where("a >= 3")
    odds = F.log((F.col("a") + 0.5) / (n1 - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (n0 - F.col("b") + 0.5))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    found = counts.select("w", odds.alias("odds"), (odds / error).alias("z")).where((F.col("z") > z) & (F.col("odds") > 2))
    return {r["w"]: r["odds"] for r in found.orderBy(F.desc("z"), "w").limit(words).collect()}


def evidence(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """doc_id, host, lang, quality, toxicity: what the classifier says of each row of `docs` alone."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("host"), "lang", "text")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"),
                          F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id IS NOT NULL AND quality IN (0, 1) AND toxic IN (0, 1)").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    labelled = write_stage(own.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labelled")
    toxic = toxic_words(labelled)
    rows = featured(labelled.select("doc_id", "host", "lang", "text"), toxic).join(labelled.select("doc_id", "quality", "toxic"), "doc_id")
    rows = rows.dropDuplicates(["doc_id"]).select("doc_id", "x", "quality", "toxic").toPandas().sort_values("doc_id")
    x = np.array(rows["x"].tolist()).reshape(-1, FEATURES)
    if len(rows):
        good, bad = fit(x, rows["quality"].to_numpy(float)), fit(x, rows["toxic"].to_numpy(float))
    else:
        good, bad = np.zeros(FEATURES), np.zeros(FEATURES)
        good[0], bad[0] = 30.0, -30.0

    def score(weights):
        return 1 / (1 + F.exp(-sum((F.col("x")[i] * float(w) for i, w in enumerate(weights)), F.lit(0.0))))
    return featured(own, toxic).select("doc_id", "host", "lang", score(good).alias("quality"), score(bad).alias("toxicity"))


def moments(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """`by`, n, m, v: rows, mean and variance of `value` of each group."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_pop(value), F.lit(0.0)).alias("v"))


def together(groups: DataFrame, by: list[str]) -> DataFrame:
    """Moments of coarser groups from those of finer ones."""
    n = F.sum("n")
    mean = F.sum(F.col("n") * F.col("m")) / n
    square = F.sum(F.col("n") * (F.col("v") + F.col("m") * F.col("m"))) / n
    return groups.groupBy(*by).agg(n.alias("n"), mean.alias("m"), F.greatest(F.lit(0.0), square - mean * mean).alias("v"))


def shrunk(groups: DataFrame, out: str) -> DataFrame:
    """Groups (n, m, v, up) with `out`, the posterior of their mean m, shrunk toward up; the moments go."""
    s = groups.agg(F.sum("n").alias("all"), F.count("*").alias("g"), F.sum(F.col("n") * F.col("v")).alias("within"),
                   F.sum(F.col("n") * F.pow(F.col("m") - F.col("up"), 2)).alias("between"), F.sum(F.col("n") * F.col("n")).alias("sq")).first()
    total, g = s["all"] or 0, s["g"] or 0
    inside = (s["within"] or 0.0) / max(1, total - g)
    spread = ((s["between"] or 0.0) - (g - 1) * inside) / max(1e-9, total - (s["sq"] or 0) / max(1, total))
    post = F.col("up") if spread <= 0 else (F.col("n") * F.col("m") + (inside / spread) * F.col("up")) / (F.col("n") + inside / spread)
    return groups.withColumn(out, post).drop("n", "m", "v", "up")


def logit(c) -> F.Column:
    c = F.least(F.greatest(c, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.log(c / (1 - c))


def judged(docs: DataFrame, labels: DataFrame, least: float = 0.5, most: float = 0.5, sample: int = 20_000) -> DataFrame:
    """doc_id, host, lang, the evidence, posteriors by host and path, p_quality, p_toxic and keep, for each row of `docs`."""
    rows = write_stage(evidence(docs, labels, sample), "evidence").fillna("", ["host", "lang"])
    means = rows.agg(F.avg("quality").alias("quality"), F.avg("toxicity").alias("toxicity")).first()
    out = rows
    for value, name in (("quality", "p_quality"), ("toxicity", "p_toxic")):
        mean = F.lit(float(means[value] if means[value] is not None else 0.5))
        paths = write_stage(moments(rows, ["host", "lang"], value), "paths")
        host = shrunk(together(paths, ["host"]).withColumn("up", mean), f"{value}_host")
        path = shrunk(paths.join(host, "host").withColumn("up", F.col(f"{value}_host")), f"{value}_path")
        out = out.join(write_stage(path, "path-posteriors"), ["host", "lang"])
        out = out.withColumn(name, 1 / (1 + F.exp(-(logit(F.col(value)) + logit(F.col(f"{value}_path")) - logit(mean)))))
    keep = (F.col("p_quality") >= least) & (F.col("p_toxic") < most)
    return out.select("doc_id", "host", "lang", "quality", "toxicity", "quality_host", "quality_path", "toxicity_host", "toxicity_path",
                      "p_quality", "p_toxic", keep.alias("keep"))
