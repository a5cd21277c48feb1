"""One wide fact row per series and window: observed value against baseline, line and objective."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.operators import baseline as B
from pulseframe.policy import Policy
from pulseframe.schemas import RKEY


def with_thresholds(df: DataFrame, policy: Policy) -> DataFrame:
    """Add red_min/red_max: a service's own line replaces the metric's default as a whole.

    default_max stays available for scaling rule levels.
    """
    spark = df.sparkSession
    over = policy.threshold_override_dim(spark).withColumn("_has", F.lit(True))
    out = df.join(policy.threshold_defaults(spark), "metric", "left").join(over, ["service", "metric"], "left")
    has = F.coalesce("_has", F.lit(False))
    return out.withColumn("red_min", F.when(has, F.col("over_min")).otherwise(F.col("default_min"))).withColumn(
        "red_max", F.when(has, F.col("over_max")).otherwise(F.col("default_max"))).drop("over_min", "over_max", "_has", "default_min")


def with_slo(df: DataFrame, policy: Policy) -> DataFrame:
    """Add `slo`: default objective per metric, overridden per service and field."""
    spark = df.sparkSession
    out = df.join(policy.slo_default_dim(spark), "metric", "left").join(
        policy.slo_override_dim(spark), ["service", "metric"], "left")
    return out.withColumn("slo", F.coalesce("over_slo", "default_slo")).drop("over_slo", "default_slo")


def reference_value() -> Column:
    """Median of a dynamic baseline, else the red line of the metric's bad direction."""
    return F.when((F.col("mode") == "dynamic") & F.col("median").isNotNull(), F.col("median")).otherwise(
        F.when(F.col("hib"), F.col("red_min")).otherwise(F.col("red_max")))


def series_base(windowed: DataFrame, base: DataFrame, policy: Policy) -> DataFrame:
    """Window series joined to baselines and policy, restricted to declared instances.

    Both large inputs are already partitioned by (run, series), so their join needs no
    further exchange; the policy sides are literal tables.
    """
    spark = windowed.sparkSession
    b = base.select(*RKEY, "mode", "sample_size", "median", "scale", "stdev", "hour_median")
    out = (
        windowed.withColumnsRenamed({"stdev": "win_stdev", "mean": "win_mean"}).join(b, RKEY, "left")
        .join(policy.series_dim(spark), ["service", "metric"])
        .join(policy.declared_instances(spark), ["service", "instance"], "left_semi")
    )
    out = out.withColumns({"mode": F.coalesce("mode", F.lit("static_fallback")), "sample_size": F.coalesce("sample_size", F.lit(0))})
    return out.withColumns({
        "baseline_value": reference_value(),
        "baseline_confidence": B.confidence(F.col("mode"), F.col("sample_size")),
        "window_minutes": F.expr("(unix_seconds(window_end) - unix_seconds(window_start)) / 60D")})


def add_observed(df: DataFrame, observed: Column) -> DataFrame:
    """Everything that depends on the observed value. A reference of 0 counts as absent: then
    deviation is 0 and the multiplier 1."""
    has, centre = "coalesce(baseline_value, 0D) <> 0", "coalesce(hour_median, median)"
    spread = "CASE WHEN coalesce(scale, 0D) > 0 THEN scale ELSE stdev END"
    return df.withColumn("observed", observed).withColumns({name: F.expr(text) for name, text in {
        "deviation_pct": f"CASE WHEN {has} THEN coalesce(try_divide(observed - {centre}, abs({centre})), 0D) * 100D ELSE 0D END",
        "z_score": f"CASE WHEN {has} THEN coalesce(try_divide(observed - {centre}, {spread}), 0D) ELSE 0D END",
        "drop_points": f"CASE WHEN {has} THEN greatest(0D, baseline_value - observed) ELSE 0D END",
        "rise_points": f"CASE WHEN {has} THEN greatest(0D, observed - baseline_value) ELSE 0D END",
        "down_pct": f"CASE WHEN {has} THEN greatest(0D, try_divide(baseline_value - observed, abs(baseline_value)) * 100D) ELSE 0D END",
        "multiplier": f"CASE WHEN {has} THEN try_divide(observed, baseline_value) ELSE 1D END",
        "threshold": "coalesce(CASE WHEN hib THEN red_min ELSE red_max END, 0D)",
        "below_slo": "coalesce(CASE WHEN hib THEN observed < slo ELSE observed > slo END, false)",
    }.items()})


def series_facts(windowed: DataFrame, base: DataFrame, policy: Policy) -> DataFrame:
    """Facts with the metric's own bad direction as the observed value."""
    return add_observed(
        series_base(windowed, base, policy), F.when(F.col("hib"), F.col("vmin")).otherwise(F.col("vmax")))
