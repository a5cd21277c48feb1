"""Findings -> anomalies: merge, blast radius, re-score, suppress, rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulseframe.operators.levels import deviation_score_sql

DEDUP = ["run_id", "rule_id", "service", "instance", "metric"]


def merge_findings(findings: DataFrame) -> DataFrame:
    """One anomaly per dedup key: the worst finding, widened by the others' extremes.

    A grouped aggregate with map-side combine, so repeated findings of one key never meet in
    one place unreduced.
    """
    rest = [c for c in findings.columns if c not in DEDUP]
    m = findings.groupBy(*DEDUP).agg(
        F.min_by(F.struct(*rest), F.struct("level", -F.col("deviation_score"), "first_seen")).alias("h"),
        F.count("*").alias("merged_count"), F.max("duration_min").alias("_dur"), F.max("amplitude").alias("_amp"),
        F.max_by("observed", F.struct("deviation_score", -F.col("level"))).alias("_obs"),
        F.min("first_seen").alias("_first"), F.max("last_seen").alias("_last"))
    out = m.select(*DEDUP, "h.*", "merged_count", "_dur", "_amp", "_obs", "_first", "_last")
    return (
        out.withColumn("duration_min", F.col("_dur")).withColumn("amplitude", F.col("_amp"))
        .withColumn("observed", F.col("_obs")).withColumn("first_seen", F.col("_first")).withColumn("last_seen", F.col("_last"))
        .withColumn("anomaly_id", F.concat_ws("|", "rule_id", "service", "instance", "metric"))
        .drop("_dur", "_amp", "_obs", "_first", "_last")
    )


def affected_ratio(merged: DataFrame, services: DataFrame) -> DataFrame:
    """Share of a service's declared instances hit by the same rule, at most 1."""
    hit = merged.groupBy("run_id", "rule_id", "service").agg(F.countDistinct("instance").alias("_hit"))
    total = services.select("service", F.greatest(F.lit(1), F.col("instance_count")).alias("_total"))
    out = merged.drop("affected_ratio").join(hit, ["run_id", "rule_id", "service"]).join(total, "service", "left")
    return out.withColumn("affected_ratio", F.least(
        F.lit(1.0), F.col("_hit") / F.coalesce("_total", F.lit(1)))).drop("_hit", "_total")


def rescore(anomalies: DataFrame, services: DataFrame) -> DataFrame:
    """Deviation score with the final blast radius; unknown services count as half critical."""
    crit = services.select("service", F.col("criticality").alias("_crit"))
    return anomalies.join(crit, "service", "left").withColumn("deviation_score", F.expr(deviation_score_sql(
        "amplitude", "duration_min", "affected_ratio", "coalesce(_crit, 0.5D)"))).drop("_crit")


def suppress(anomalies: DataFrame) -> DataFrame:
    """Milder anomalies on the same (service, instance, metric) yield to the worst one.

    After merging, a partition of this window holds at most one row per rule.
    """
    w = W.partitionBy("run_id", "service", "instance", "metric").orderBy("level", F.desc("deviation_score"), "anomaly_id")
    head = F.first(F.struct("level", "anomaly_id")).over(w)
    sup = F.col("level") > F.col("_head.level")
    return anomalies.withColumn("_head", head).withColumn("is_suppressed", sup).withColumn(
        "suppressed_by", F.when(sup, F.col("_head.anomaly_id"))).drop("_head")


def aggregate(findings: DataFrame, services: DataFrame) -> DataFrame:
    return suppress(rescore(affected_ratio(merge_findings(findings), services), services))


def top_anomalies(anomalies: DataFrame, k: int) -> DataFrame:
    """The k worst of each run. row_number <= k prunes within each task before the shuffle."""
    w = W.partitionBy("run_id").orderBy("level", F.desc("deviation_score"), "anomaly_id")
    return anomalies.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def level_counts(active: DataFrame, runs: DataFrame) -> DataFrame:
    """Counts per level, zero-filled, and the highest level of each run."""
    c = active.groupBy("run_id").agg(
        *[F.count_if(F.col("level") == i).alias(f"p{i}") for i in (1, 2, 3, 4)], F.min("level").alias("highest_level"))
    out = runs.select("run_id").join(c, "run_id", "left")
    return out.select("run_id", *[F.coalesce(f"p{i}", F.lit(0)).alias(f"p{i}") for i in (1, 2, 3, 4)], "highest_level")
