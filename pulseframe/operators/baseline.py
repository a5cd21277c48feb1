"""Robust baselines from an archive, with same-hour-of-week samples preferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions import hour_of_day, hour_of_week, safe_ratio
from pulseframe.operators.windows import assign_windows
from pulseframe.policy import Policy
from pulseframe.schemas import RKEY

# fixed values: MAD to deviation factor, relative floor of the scale, samples for an hour profile
MAD_SCALE = 1.4826
RELATIVE_FLOOR = 0.008
PROFILE_MIN = 3


def archive_samples(archive: DataFrame, windows: DataFrame, policy: Policy) -> DataFrame:
    """Archive points per run in [archive_start, archive_end), flagged `in_slot` when their hour
    of week is within one hour of the window end's."""
    # the join only needs time buckets about as long as the archive range, see assign_windows
    s = assign_windows(archive, windows, "archive_start", "archive_end", bucket_seconds=7 * 86_400)
    diff = F.pmod(hour_of_week(F.col("ts"), policy.tz) - hour_of_week(F.col("window_end"), policy.tz) + 1, F.lit(168))
    return s.select(
        *RKEY, "ts", "value", (diff <= 2).alias("in_slot"), hour_of_day(F.col("ts"), policy.tz).alias("hour"),
        hour_of_day(F.col("window_end"), policy.tz).alias("anchor_hour"))


def fallback_choice(samples: DataFrame, min_samples: int) -> DataFrame:
    """Which samples a baseline may use: the slot's, all, or too few for either (static)."""
    a = samples.groupBy(*RKEY).agg(F.count_if("in_slot").alias("n_slot"), F.count("*").alias("n_all"))
    choice = (
        F.when(F.col("n_slot") >= min_samples, "slot").when(F.col("n_all") >= min_samples, "all").otherwise("static"))
    return a.withColumn("choice", choice)


def hour_profile(samples: DataFrame) -> DataFrame:
    """Median per hour of day where at least three samples exist."""
    return samples.groupBy(*RKEY, "hour").agg(
        F.count("*").alias("n"), F.percentile("value", F.lit(0.5)).alias("hour_median")).where(F.col("n") >= PROFILE_MIN)


def baselines(archive: DataFrame, windows: DataFrame, policy: Policy, min_samples: int | None = None) -> DataFrame:
    """One row per (run, series) in the archive.

    One exchange on the series key. A group is one series' archive range, at most
    (archive range / step) samples after cleaning, so its values are gathered once as plain
    arrays and sorted; every order statistic is then an index into an array, where separate
    percentile aggregates would each build a map of the values. What needs no order is
    aggregated as it comes; only the deviations from the median are computed per element.
    """
    min_samples = policy.baseline_min_samples if min_samples is None else min_samples
    s = archive_samples(archive, windows, policy)
    slot, v = F.when(F.col("in_slot"), F.col("value")), F.col("value")
    # the hash leads the grouping key: the sort behind the aggregate then compares one long, not four strings
    a = s.withColumn("_k", F.xxhash64(*RKEY)).groupBy("_k", *RKEY).agg(
        F.count("*").alias("n_all"), F.count_if("in_slot").alias("n_slot"), F.collect_list(v).alias("_all"), F.collect_list(slot).alias("_slot"),
        F.collect_list(F.when(F.col("hour") == F.col("anchor_hour"), v)).alias("_hour"), F.avg(v).alias("_ma"), F.avg(slot).alias("_ms"),
        F.stddev_pop(v).alias("_sa"), F.stddev_pop(slot).alias("_ss"))
    own = f"n_slot >= {min_samples}"
    a = a.selectExpr(*RKEY, "n_all", "n_slot", f"sort_array(IF({own}, _slot, _all)) AS _v", "sort_array(_hour) AS _h",
                     f"IF({own}, _ms, _ma) AS mean", f"IF({own}, _ss, _sa) AS stdev")
    a = a.withColumns({"sample_size": F.expr("bigint(size(_v))"), "median": F.expr(_quantile("_v", 0.5))})
    a = a.withColumn("_d", F.expr("sort_array(transform(_v, v -> abs(v - median)))"))
    a = a.withColumn("mad", F.expr(_quantile("_d", 0.5)))
    a = a.withColumn("scale", F.expr(f"greatest(mad * {MAD_SCALE}D, abs(median) * {RELATIVE_FLOOR}D)"))
    dynamic = f"sample_size >= {min_samples} AND scale > 0"
    values = {
        "median": "median", "mad": "mad", "scale": "scale", "mean": "mean", "p50": "median", "p95": _quantile("_v", 0.95),
        "p99": _quantile("_v", 0.99), "min": "element_at(_v, 1)", "max": "element_at(_v, -1)", "stdev": "stdev"}
    return a.selectExpr(
        *RKEY, "n_slot", "n_all", "sample_size", f"IF({dynamic}, 'dynamic', 'static_fallback') AS mode",
        *[f"IF({dynamic}, {v}, NULL) AS {c}" for c, v in values.items()],
        f"IF({dynamic} AND size(_h) >= {PROFILE_MIN}, {_quantile('_h', 0.5)}, NULL) AS hour_median")


def _quantile(arr: str, q: float) -> str:
    """Linearly interpolated quantile of a sorted, non-empty array, as SQL."""
    pos = f"((size({arr}) - 1) * {q}D)"
    lo, hi = f"element_at({arr}, int(floor({pos})) + 1)", f"element_at({arr}, int(ceil({pos})) + 1)"
    return f"IF(size({arr}) = 0, NULL, {lo} + ({hi} - {lo}) * ({pos} - floor({pos})))"


def confidence(mode: Column, n: Column) -> Column:
    return (
        F.when(F.coalesce(mode, F.lit("")) != "dynamic", "low").when(n >= 200, "high").when(n >= 60, "medium").otherwise("low"))


def is_usable() -> Column:
    return (F.col("mode") == "dynamic") & (F.col("sample_size") >= 30) & (F.col("scale") > 0)


def bands(base: DataFrame, k: float = 4.0) -> DataFrame:
    """Upper and lower band; red lines where no dynamic baseline exists.

    Expects `red_min` and `red_max` columns.
    """
    dyn = F.col("median").isNotNull() & (F.col("scale") > 0)
    return base.withColumn("upper", F.when(dyn, F.col("median") + k * F.col("scale")).otherwise(F.col("red_max"))).withColumn(
        "lower", F.when(dyn, F.col("median") - k * F.col("scale")).otherwise(F.col("red_min")))


def centre() -> Column:
    """Reference of z and deviation: the anchor hour's median where known, else the median."""
    return F.coalesce(F.col("hour_median"), F.col("median"))


def robust_z(value: Column) -> Column:
    den = F.when(F.coalesce("scale", F.lit(0.0)) > 0, F.col("scale")).otherwise(F.col("stdev"))
    return safe_ratio(value - centre(), den)


def deviation_pct(value: Column) -> Column:
    return safe_ratio(value - centre(), F.abs(centre())) * 100.0


def collect(base: DataFrame, runs: DataFrame, instances: DataFrame, catalog: DataFrame) -> DataFrame:
    """A row for every run x declared instance x metric; series without archive are static.

    The product is the declared key set itself: runs x instances x the fixed metric list.
    """
    keys = runs.select("run_id").crossJoin(instances.select("service", "instance")).crossJoin(catalog.select("metric"))
    return keys.join(base, RKEY, "left").withColumn("mode", F.coalesce("mode", F.lit("static_fallback"))).withColumn(
        "sample_size", F.coalesce("sample_size", F.lit(0)))


def coverage(collected: DataFrame) -> DataFrame:
    """Share of dynamic baselines per run; under one half the baseline stage counts as degraded."""
    c = collected.groupBy("run_id").agg(
        F.count("*").alias("series"), F.avg((F.col("mode") == "dynamic").cast("double")).alias("dynamic_ratio"))
    return c.withColumn("degraded", F.col("dynamic_ratio") < 0.5)
