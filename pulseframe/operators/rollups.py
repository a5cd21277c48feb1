"""Per-service and per-group statistics from the same rows, healthy services included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.functions import fmt

NO_LEVEL = 99  # sorts services without anomalies last


def service_stats(active: DataFrame, clusters: DataFrame, runs: DataFrame, services: DataFrame) -> DataFrame:
    """One row per run and declared service."""
    key = ["run_id", "service"]
    worst = F.min_by(F.struct("metric", "observed", "baseline_value", "level"),
                     F.struct("level", -F.col("deviation_score"), "anomaly_id"))
    a = active.groupBy(*key).agg(
        F.count("*").alias("anomaly_count"), F.min("level").alias("max_level"),
        F.array_sort(F.collect_set("rule_id")).alias("rules"), worst.alias("worst"))
    declared = services.select("service", F.explode("instances").alias("instance"))
    inst = active.select(*key, "instance").join(declared, ["service", "instance"], "left_semi").groupBy(*key).agg(
        F.countDistinct("instance").alias("affected_instances"))
    roots = clusters.groupBy("run_id", F.col("primary.service").alias("service")).agg(
        F.array_sort(F.collect_set("cluster_id")).alias("root_cause_of"))
    inside = clusters.select("run_id", "cluster_id", F.explode("services").alias("service")).groupBy(*key).agg(
        F.array_sort(F.collect_set("cluster_id")).alias("in_clusters"))
    out = runs.select("run_id").crossJoin(services.select(
        "service", F.coalesce("grp", F.lit("default")).alias("grp"), "tier", "owner", "criticality",
        F.col("instance_count").alias("total_instances")))
    for side in (a, inst, roots, inside):
        out = out.join(side, key, "left")
    none = F.array().cast("array<string>")
    summary = F.when(F.col("worst").isNotNull(), F.concat(
        F.lit("observed "), fmt("worst.observed"),
        F.when(F.col("worst.baseline_value").isNotNull(), F.concat(F.lit(", baseline "), fmt("worst.baseline_value"))
               ).otherwise(F.lit("")),
        F.lit(" (P"), F.col("worst.level").cast("string"), F.lit(")")))
    return out.select(
        *key, "grp", "tier", "owner", "criticality", F.coalesce("anomaly_count", F.lit(0)).alias("anomaly_count"), "max_level",
        F.coalesce("affected_instances", F.lit(0)).alias("affected_instances"), "total_instances",
        F.try_divide(F.coalesce("affected_instances", F.lit(0)).cast("double"), F.col("total_instances")).alias("affected_ratio"),
        F.coalesce("rules", none).alias("rules"), F.col("worst.metric").alias("worst_metric"), summary.alias("worst_summary"),
        F.coalesce("root_cause_of", none).alias("root_cause_of"), F.coalesce("in_clusters", none).alias("in_clusters"))


def _sums():
    return [
        F.count("*").alias("service_count"), F.count_if(F.col("anomaly_count") > 0).alias("affected_services"),
        F.sum("anomaly_count").alias("anomaly_count"), F.min("max_level").alias("max_level"),
        F.sum("affected_instances").alias("affected_instances"), F.sum("total_instances").alias("total_instances"),
        F.sum(F.size("root_cause_of")).alias("root_cause_count")]


def group_stats(stats: DataFrame) -> DataFrame:
    return stats.groupBy("run_id", "grp").agg(*_sums())


def grouping_sets(stats: DataFrame) -> DataFrame:
    """Service, group and run level in one pass over the same rows, so their totals agree."""
    g = stats.groupingSets(
        [[F.col("run_id"), F.col("grp"), F.col("service")], [F.col("run_id"), F.col("grp")], [F.col("run_id")]],
        F.col("run_id"), F.col("grp"), F.col("service"))
    return g.agg(F.grouping_id().alias("level_of_detail"), *_sums())


def ordered(stats: DataFrame, name: str = "service") -> DataFrame:
    return stats.orderBy(F.coalesce("max_level", F.lit(NO_LEVEL)), F.desc("anomaly_count"), name, "run_id")
