"""Comparison between runs: similar clusters, recurrence, anomaly differences, score trend, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulseframe.functions import duration_text, fmt
from pulseframe.operators.similarity import tokens
from pulseframe.operators.skew import split_keys

RECURRENCE = 0.6


# ------------------------------------------------------------------ similar clusters
def recent_clusters(clusters: DataFrame, runs: DataFrame, run_id: str, since: Column | None = None) -> DataFrame:
    """History one run may compare with: the clusters of recorded runs, except those that
    looked at the same window (reruns are not recurrences); from `since` on, if given.

    clusters: run_id, cluster_id, signature, created_at.
    """
    me = runs.where(F.col("run_id") == run_id).select("window_end")
    same = runs.join(me, "window_end", "left_semi").select("run_id")
    h = clusters.join(runs.select("run_id"), "run_id", "left_semi").join(same, "run_id", "left_anti").where(F.col("run_id") != run_id)
    return h if since is None else h.where(F.col("created_at") >= since)


def jaccard_matches(
    clusters: DataFrame, history: DataFrame, runs: DataFrame, k: int | None, earlier_only: bool = True,
) -> DataFrame:
    """Signature similarity of each cluster to clusters of other windows, best k per cluster.

    Exact, over shared tokens only. Both sides: run_id, cluster_id, signature. Pairs without a
    common token are never formed; a frequent token makes many, so its rows are split by their
    number and pair counts combine map-side. What only asks for similar pairs uses
    similarity.recurring(), which forms no others.
    """
    w = runs.select("run_id", "window_end")

    def token_rows(df, p):
        t = tokens(F.col("signature"))
        return df.join(w, "run_id").select(
            F.col("run_id").alias(f"{p}_run"), F.col("cluster_id").alias(f"{p}_cluster"), F.col("window_end").alias(f"{p}_end"),
            F.size(t).alias(f"{p}_n"), F.explode(t).alias("token"))

    a, b = split_keys(token_rows(clusters, "a"), token_rows(history, "b"), ["token"], ["b_run", "b_cluster"])
    apart = (F.col("b_end") < F.col("a_end")) if earlier_only else (F.col("b_end") != F.col("a_end"))
    pairs = a.join(b, ["token", "_part"]).where((F.col("a_run") != F.col("b_run")) & apart).groupBy(
        "a_run", "a_cluster", "b_run", "b_cluster").agg(
        F.count("*").alias("common"), F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"))
    sim = pairs.withColumn("similarity", F.col("common") / (F.col("a_n") + F.col("b_n") - F.col("common")))
    out = sim.select(F.col("a_run").alias("run_id"), F.col("a_cluster").alias("cluster_id"), F.col("b_run").alias("match_run"),
                     F.col("b_cluster").alias("match_cluster"), "similarity")
    if k is None:
        return out
    best = W.partitionBy("run_id", "cluster_id").orderBy(F.desc("similarity"), "match_run", "match_cluster")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def recurrence(clusters: DataFrame, matches: DataFrame, threshold: float = RECURRENCE) -> DataFrame:
    best = matches.groupBy("run_id", "cluster_id").agg(F.max("similarity").alias("best"))
    return clusters.select("run_id", "cluster_id").join(best, ["run_id", "cluster_id"], "left").select(
        "run_id", "cluster_id", (F.coalesce("best", F.lit(0.0)) >= threshold).alias("is_recurring"))


# ------------------------------------------------------------------ run against run
def previous_run(runs: DataFrame, per_scenario: bool = False) -> DataFrame:
    """Each run with the one started just before it, of any or of the same scenario.

    runs: run_id, scenario_id, started_at. Runs are inspections, one short row each.
    """
    w = W.partitionBy(*(["scenario_id"] if per_scenario else [])).orderBy("started_at", "run_id")
    return runs.withColumn("prev_run_id", F.lag("run_id").over(w))


def run_diff(anomalies: DataFrame, pairs: DataFrame, include_suppressed: bool = True) -> DataFrame:
    """New, persistent and recovered anomalies of each (run_id, prev_run_id), by one full join."""
    if not include_suppressed:
        anomalies = anomalies.where(~F.col("is_suppressed"))
    a = anomalies.select("run_id", "anomaly_id").distinct()
    p = pairs.where("prev_run_id IS NOT NULL").select("run_id", "prev_run_id")
    now = a.join(p, "run_id").select("run_id", "anomaly_id", F.lit(True).alias("_now"))
    before = a.withColumnRenamed("run_id", "prev_run_id").join(p, "prev_run_id").select("run_id", "anomaly_id", F.lit(True).alias("_before"))
    j = now.join(before, ["run_id", "anomaly_id"], "full_outer")
    state = F.when(F.col("_before").isNull(), "new").when(F.col("_now").isNull(), "recovered").otherwise("persistent")
    return j.select("run_id", "anomaly_id", state.alias("state"))


def diff_sets(anomalies: DataFrame, run_id: str, prev_run_id: str) -> dict[str, DataFrame]:
    """The same for one pair of runs, as set operations."""
    now = anomalies.where(F.col("run_id") == run_id).select("anomaly_id").distinct()
    before = anomalies.where(F.col("run_id") == prev_run_id).select("anomaly_id").distinct()
    return {"new": now.exceptAll(before), "recovered": before.exceptAll(now), "persistent": now.intersect(before)}


def score_trend(runs: DataFrame, scores: DataFrame, per_scenario: bool = False) -> DataFrame:
    """Change of the total score against the previous run; within one point counts as flat."""
    r = previous_run(runs, per_scenario)
    s = scores.select("run_id", "total")
    j = r.join(s, "run_id", "left").join(s.select(F.col("run_id").alias("prev_run_id"), F.col("total").alias("prev_total")), "prev_run_id", "left")
    d = F.round(F.coalesce("total", F.lit(0.0)) - F.coalesce("prev_total", F.lit(0.0)), 1)
    return j.where("prev_run_id IS NOT NULL").select(
        "run_id", "prev_run_id", d.alias("delta"), F.when(d > 1.0, "up").when(d < -1.0, "down").otherwise("flat").alias("trend"))


def score_history(runs: DataFrame, scores: DataFrame, limit: int) -> DataFrame:
    """Latest scored runs, oldest first. `limit` is the length of the trend shown."""
    j = runs.join(scores.where("total IS NOT NULL").select("run_id", "total"), "run_id")
    return j.orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit).orderBy("started_at", "run_id")


def latest_runs(runs: DataFrame, n: int) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)


def run_status(stages: DataFrame) -> DataFrame:
    """failed / partial / succeeded per run from its stage rows (run_id, stage, status)."""
    s = stages.groupBy("run_id").agg(
        F.bool_or(F.col("status") == "failed").alias("f"), F.bool_or(F.col("status") == "succeeded").alias("s"),
        F.bool_or(F.col("status") == "degraded").alias("d"))
    return s.select("run_id", F.when(F.col("f") & ~F.col("s"), "failed").when(F.col("f") | F.col("d"), "partial").otherwise("succeeded").alias("status"))


# ------------------------------------------------------------------ report and alert datasets
def report_payload(runs: DataFrame, scores: DataFrame, counts: DataFrame, clusters: DataFrame, diff: DataFrame) -> DataFrame:
    """One JSON overview per run, from one small aggregate per section."""
    c = clusters.groupBy("run_id").agg(F.count("*").alias("clusters"), F.min_by("signature", "rank").alias("top_signature"))
    d = diff.groupBy("run_id").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("new", "recovered", "persistent")])
    j = runs.select("run_id").join(scores, "run_id", "left").join(counts, "run_id", "left").join(c, "run_id", "left").join(d, "run_id", "left")
    body = F.struct("total", "grade", "p1", "p2", "p3", "p4", F.coalesce("clusters", F.lit(0)).alias("clusters"), "top_signature",
                    *[F.coalesce(s, F.lit(0)).alias(s) for s in ("new", "recovered", "persistent")])
    return j.select("run_id", F.to_json(body).alias("payload"))


def alert_payload(anomalies: DataFrame, scores: DataFrame, conclusions: DataFrame, lines: int, max_level: int = 2) -> DataFrame:
    """Alert text of each run with urgent active anomalies: how many there are, the worst `lines` of them, the leading cause."""
    urgent = anomalies.where(~F.col("is_suppressed") & (F.col("level") <= max_level))
    w = W.partitionBy("run_id").orderBy("level", F.desc("deviation_score"), "anomaly_id")
    top = urgent.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= lines)
    line = F.concat(
        F.lit("P"), F.col("level").cast("string"), F.lit(" "), F.concat_ws("/", "service", "instance"), F.lit(" "), F.col("metric"),
        F.lit(" "), fmt("observed"), F.lit(" (baseline "), fmt("baseline_value"), F.lit("), "),
        duration_text("duration_min"))
    body = top.groupBy("run_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", line.alias("t")))), lambda x: x["t"]).alias("lines"))
    count = urgent.groupBy("run_id").agg(F.count("*").alias("urgent"))
    cause = conclusions.groupBy("run_id").agg(F.min_by("category", "cluster_id").alias("cause"))
    j = body.join(count, "run_id").join(scores.select("run_id", "total", "grade"), "run_id", "left").join(cause, "run_id", "left")
    title = F.concat(F.lit("score "), fmt("total", 1), F.lit(" ("), F.coalesce("grade", F.lit("-")), F.lit(")"))
    return j.select("run_id", "urgent", title.alias("title"), F.array_join("lines", "\n").alias("text"), F.coalesce("cause", F.lit("unknown")).alias("cause"))
