"""Per-series statistics, all from one grouped pass.

Works on clean points: a group is one series in one window, at most one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulseframe.functions import safe_ratio, seconds


def moments(points: DataFrame, keys: list[str]) -> DataFrame:
    stdev = F.coalesce(F.stddev_pop("value"), F.lit(0.0))
    out = points.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"),
        F.when(F.count("*") > 1, stdev).otherwise(F.lit(0.0)).alias("stdev"))
    return out.withColumn("cv", safe_ratio(F.col("stdev"), F.abs("mean")))


def percentiles(points: DataFrame, keys: list[str], qs=(0.5, 0.95, 0.99)) -> DataFrame:
    """Exact, linearly interpolated percentiles."""
    return points.groupBy(*keys).agg(
        *[F.percentile("value", F.lit(q)).alias(f"p{round(q * 100)}") for q in qs])


def trailing(points: DataFrame, length_seconds: int, block_seconds: int | None = None) -> DataFrame:
    """Each point with the count, mean and maximum of its own trailing window (ts - length, ts] of its series.

    A series is cut into time blocks, so a long or busy one spreads over many tasks; a block also gets the points
    before it that its windows reach back to.
    """
    block = max(block_seconds or 7 * 86_400, length_seconds)
    t = seconds(F.col("ts"))
    own = F.floor(t / block)
    p = points.withColumn("_t", t).withColumn("_own", own).withColumn(
        "_b", F.explode(F.sequence(own, F.floor((t + F.lit(length_seconds - 1)) / block))))
    w = W.partitionBy("service", "instance", "metric", "_b").orderBy("_t").rangeBetween(-(length_seconds - 1), 0)
    out = p.withColumns({"n": F.count("*").over(w), "mean": F.avg("value").over(w), "vmax": F.max("value").over(w)})
    return out.where(F.col("_b") == F.col("_own")).drop("_t", "_own", "_b")


def worst(points: DataFrame, keys: list[str], catalog: DataFrame) -> DataFrame:
    """Worst value in the metric's bad direction, with the plain extremes for two-sided metrics."""
    out = points.groupBy(*keys).agg(F.min("value").alias("vmin"), F.max("value").alias("vmax"))
    return out.join(catalog.select("metric", "hib"), "metric").withColumn(
        "worst", F.when(F.col("hib"), F.col("vmin")).otherwise(F.col("vmax"))).drop("hib")


def first_last(points: DataFrame, keys: list[str]) -> DataFrame:
    return points.groupBy(*keys).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min_by("value", "ts").alias("first_value"), F.max_by("value", "ts").alias("last_value"))


def trend(points: DataFrame, keys: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """Least-squares slope per minute with t statistic and R2, slope as % of median per hour,
    and the stable/rising/falling label.

    `carry` names columns that are constant within a group. regr_r2 is 1 on constant values, so R2 and t come from the sums of squares with guards.
    """
    x = points.withColumn("_x", seconds(F.col("ts")) / 60.0)
    a = x.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_sxx("value", "_x").alias("sxx"), F.regr_syy("value", "_x").alias("syy"),
        F.regr_sxy("value", "_x").alias("sxy"), F.percentile("value", F.lit(0.5)).alias("median"),
        (F.max("value") - F.min("value")).alias("span"), F.max_by("value", "ts").alias("latest"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), *[F.first(c).alias(c) for c in carry])
    ok = (F.col("n") >= 3) & (F.col("sxx") > 0)
    # sxy^2/sxx and syy differ by rounding only on an exact line: below 1e-12 of syy is zero
    sse = F.greatest(F.lit(0.0), F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")))
    a = a.withColumn("slope", F.when(ok, F.try_divide(F.col("sxy"), F.col("sxx"))).otherwise(0.0))
    a = a.withColumn("_sse", F.when(sse <= F.col("syy") * 1e-12, 0.0).otherwise(sse))
    se = F.sqrt(F.try_divide(F.try_divide(F.col("_sse"), F.col("n") - 2), F.col("sxx")))
    t = (
        F.when(~ok, 0.0)
        .when((F.col("_sse") == 0) & (F.col("slope") != 0), F.lit(float("inf")))
        .when(F.col("_sse") == 0, 0.0)
        .otherwise(safe_ratio(F.col("slope"), se)))
    r2 = F.when(~ok | (F.col("syy") == 0), 0.0).otherwise(
        F.greatest(F.lit(0.0), 1.0 - F.try_divide(F.col("_sse"), F.col("syy"))))
    pct = F.when(F.coalesce("median", F.lit(0.0)) == 0, 0.0).otherwise(
        F.try_divide(F.col("slope") * 60.0, F.abs("median")) * 100.0)
    label = (
        F.when((F.col("span") == 0) | (F.abs("slope") * 5 < F.col("span") * 0.2), "stable")
        .when(F.col("slope") > 0, "rising").otherwise("falling"))
    return a.withColumn("t_stat", t).withColumn("r2", r2).withColumn("slope_pct", pct).withColumn(
        "trend", label).select(*keys, "n", "slope", "t_stat", "r2", "slope_pct", "median", "trend", "latest", "first_ts", "last_ts", *carry)


def step_minutes(points: DataFrame, keys: list[str]) -> DataFrame:
    """Sampling step: lower median of the positive deltas, at least one minute."""
    w = W.partitionBy(*keys).orderBy("ts")
    d = points.withColumn("_d", seconds(F.col("ts")) - seconds(F.lag("ts").over(w)))
    return d.groupBy(*keys).agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN _d > 0 THEN _d END)").alias("_m")
    ).select(*keys, F.greatest(F.lit(1.0), F.coalesce(F.col("_m") / 60.0, F.lit(1.0))).alias("step_minutes"))


def digest(points: DataFrame, keys: list[str], decimals: int | None = 3) -> DataFrame:
    """Compact summary of each series: counts, extremes, percentiles, ends, trend label.

    Slope here is regr_slope: it needs no sum-of-squares guard for a label.
    """
    x = seconds(F.col("ts")) / 60.0
    a = points.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.min("value").alias("_min"), F.percentile("value", F.lit(0.5)).alias("_p50"),
        F.percentile("value", F.lit(0.95)).alias("_p95"), F.max("value").alias("_max"), F.avg("value").alias("_mean"),
        F.min_by("value", "ts").alias("_first"), F.max_by("value", "ts").alias("_last"),
        F.coalesce(F.regr_slope("value", x), F.lit(0.0)).alias("_slope"))
    slope = F.when(F.col("samples") < 3, 0.0).otherwise(F.col("_slope"))
    span = F.col("_max") - F.col("_min")
    label = (
        F.when((span == 0) | (F.abs(slope) * 5 < span * 0.2), "stable")
        .when(slope > 0, "rising").otherwise("falling"))
    names = ("min", "p50", "p95", "max", "mean", "first", "last")
    cols = [(F.col(f"_{c}") if decimals is None else F.round(f"_{c}", decimals)).alias(c) for c in names]
    return a.select(*keys, "samples", *cols, label.alias("trend"))


def window_series(points: DataFrame, keys: list[str]) -> DataFrame:
    """Everything rules need of a series in its window, plus its ordered samples, in one shuffle.

    `samples` holds at most one element per bucket of the window.
    """
    w = W.partitionBy(*keys).orderBy("ts")
    d = points.withColumn("_d", seconds(F.col("ts")) - seconds(F.lag("ts").over(w)))
    extra = [F.first(c).alias(c) for c in ("window_start", "window_end") if c in points.columns]
    out = d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("value").alias("vmin"), F.max("value").alias("vmax"),
        F.avg("value").alias("mean"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("stdev"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max_by("value", "ts").alias("latest"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN _d > 0 THEN _d END)").alias("_m"),
        F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("samples"), *extra)
    return (
        out.withColumn("step_minutes", F.greatest(F.lit(1.0), F.coalesce(F.col("_m") / 60.0, F.lit(1.0))))
        .withColumn("cv", F.round(safe_ratio(F.col("stdev"), F.abs("mean")), 4)).drop("_m")
    )
