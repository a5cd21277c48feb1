"""Unit conversion, validity, bucket alignment, gap filling and data-quality reports.

Raw samples may be skewed to any degree; everything before `merge_buckets` is either a
projection or an aggregate with map-side combine. After it a series holds at most one row
per bucket, so the per-series windows below work on (time range / g) rows at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulseframe.functions import bucket, seconds
from pulseframe.policy import Policy
from pulseframe.schemas import KEY


def convert_units(samples: DataFrame, policy: Policy) -> DataFrame:
    """Bring `value` to the catalogue unit; `unit_unknown` marks units without a conversion.

    `unit` is the declared unit of the sample's series; empty or NULL means the catalogue's.
    """
    spark = samples.sparkSession
    cat = policy.catalog(spark).select("metric", F.col("unit").alias("cat_unit"), "lo", "hi")
    fac = policy.unit_factors(spark).select("src_unit", F.col("unit").alias("cat_unit"), "factor")
    declared = F.when(F.coalesce("unit", F.lit("")) == "", F.col("cat_unit")).otherwise(F.col("unit"))
    out = (
        samples.join(cat, "metric").withColumn("src_unit", declared)
        .join(fac, ["src_unit", "cat_unit"], "left")
        .withColumn("unit_unknown", (F.col("src_unit") != F.col("cat_unit")) & F.col("factor").isNull())
        .withColumn("value", F.when(F.col("src_unit") == F.col("cat_unit"), F.col("value"))
                    .otherwise(F.col("value") * F.coalesce("factor", F.lit(1.0))))
    )
    return out.drop("unit", "factor").withColumnRenamed("cat_unit", "unit")


def is_valid() -> Column:
    """Neither missing, NaN nor outside [lo, hi]; NaN first, because NaN sorts above every number."""
    v = F.col("value")
    return v.isNotNull() & ~F.isnan(v) & (v >= F.col("lo")) & (v <= F.col("hi"))


def range_filter(converted: DataFrame) -> DataFrame:
    """Drop invalid samples; they are never clamped."""
    return converted.where(is_valid())


def sample_issues(converted: DataFrame) -> DataFrame:
    """One row per sample with an unknown unit, and one per sample outside its valid range."""
    reason = F.array_compact(F.array(
        F.when(F.col("unit_unknown"), F.lit("unknown_unit")),
        F.when(~is_valid(), F.lit("invalid_value"))))
    return converted.withColumn("reason", F.explode(reason)).select(
        *KEY, F.lit("out_of_range").alias("kind"), "reason", "ts", "value")


def merge_buckets(samples: DataFrame, g: int, how: str = "mean", order: tuple[str, ...] = ()) -> DataFrame:
    """One value per (series, bucket). `how` is mean, max or last; last means the greatest
    (ts, *order), so pass an arrival column to break ties."""
    agg = {
        "mean": F.avg("value"),
        "max": F.max("value"),
        "last": F.max_by("value", F.struct("ts", *order)),
    }[how]
    return (
        samples.withColumn("bucket_ts", bucket(F.col("ts"), g))
        .groupBy(*KEY, "bucket_ts").agg(agg.alias("value"))
        .withColumnRenamed("bucket_ts", "ts")
    )


def gaps(points: DataFrame, g: int) -> DataFrame:
    """Points with the next sample of their series and the number of buckets missing before it."""
    w = W.partitionBy(*KEY).orderBy("ts")
    return points.select(
        *KEY, "ts", "value",
        F.lead("ts").over(w).alias("next_ts"), F.lead("value").over(w).alias("next_value"),
    ).withColumn("missing", F.coalesce(
        F.floor((seconds(F.col("next_ts")) - seconds(F.col("ts"))) / g) - 1, F.lit(0)).cast("long"))


def interpolate(gapped: DataFrame, g: int, max_gap: int) -> DataFrame:
    """Fill gaps of at most `max_gap` buckets linearly between their neighbours.

    A row emits itself plus its fill-ins (at most max_gap), so nothing is joined or shuffled.
    """
    t0, t1 = seconds(F.col("ts")), seconds(F.col("next_ts"))
    fill = F.when((F.col("missing") > 0) & (F.col("missing") <= max_gap),
                  F.sequence(t0, t1 - g, F.lit(g).cast("long"))).otherwise(F.array(t0))
    t = F.col("_t")
    value = F.when(t == t0, F.col("value")).otherwise(
        F.col("value") + (F.col("next_value") - F.col("value")) * ((t - t0) / (t1 - t0)))
    return gapped.withColumn("_t", F.explode(fill)).select(
        *KEY, F.timestamp_seconds(t).alias("ts"), F.round(value, 6).alias("value"),
        (t != t0).alias("is_interpolated"))


def gap_issues(gapped: DataFrame, g: int, max_gap: int) -> DataFrame:
    """Gaps too long to fill, from the first missing bucket to the next sample."""
    return gapped.where(F.col("missing") > max_gap).select(
        *KEY, F.lit("missing").alias("kind"), "missing",
        F.timestamp_seconds(seconds(F.col("ts")) + g).alias("gap_from"), F.col("next_ts").alias("gap_to"))


def clip(points: DataFrame, g: int, start: Column | None = None, end: Column | None = None) -> DataFrame:
    if start is not None:
        points = points.where(F.col("ts") >= bucket(start, g))
    if end is not None:
        points = points.where(F.col("ts") < bucket(end, g))
    return points


def clean(samples: DataFrame, policy: Policy, how: str = "mean", order: tuple[str, ...] = ()) -> DataFrame:
    """Raw samples -> aligned, valid, gap-filled points with an `is_interpolated` flag."""
    if "unit" not in samples.columns:
        samples = samples.withColumn("unit", F.lit(None).cast("string"))
    g = policy.granularity_seconds
    merged = merge_buckets(range_filter(convert_units(samples, policy)), g, how, order)
    return interpolate(gaps(merged, g), g, policy.max_gap_buckets)


def clean_stats(samples: DataFrame, policy: Policy, how: str = "mean", order: tuple[str, ...] = ()) -> DataFrame:
    """Raw, kept, interpolated and dropped counts per series that kept at least one sample.

    Raw samples collapse to one row per (series, bucket) with their counts first; the rest
    runs over buckets, partitioned by series throughout.
    """
    if "unit" not in samples.columns:
        samples = samples.withColumn("unit", F.lit(None).cast("string"))
    g = policy.granularity_seconds
    conv = convert_units(samples, policy).withColumn("_b", seconds(bucket(F.col("ts"), g)))
    per_bucket = conv.groupBy(*KEY, "_b").agg(
        F.count("*").alias("raw"), F.count_if(~is_valid()).alias("dropped"))
    w = W.partitionBy(*KEY).orderBy("_b")
    held = F.col("raw") > F.col("dropped")
    prev = F.last(F.when(held, F.col("_b")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    missing = ((F.col("_b") - prev) / g - 1).cast("long")
    filled = F.when(held & (missing > 0) & (missing <= policy.max_gap_buckets), missing).otherwise(0)
    return (
        per_bucket.withColumn("_filled", filled)
        .groupBy(*KEY).agg(
            F.sum("raw").alias("raw_points"),
            (F.count_if(held) + F.sum("_filled")).alias("kept_points"),
            F.sum("_filled").alias("interpolated"),
            F.sum("dropped").alias("dropped_out_of_range"),
            F.count_if(held).alias("_held"))
        .where("_held > 0").drop("_held")
    )


def max_gap(points: DataFrame) -> DataFrame:
    """Longest run of missing buckets, with the step inferred as the upper median delta."""
    w = W.partitionBy(*KEY).orderBy("ts")
    d = points.withColumn("_d", seconds(F.lead("ts").over(w)) - seconds(F.col("ts")))
    per = d.groupBy(*KEY).agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _d DESC)").alias("_step"), F.max("_d").alias("_max"))
    # floor(d/step)-1 grows with d, so the largest delta gives the largest gap
    gap = F.floor(F.col("_max") / F.col("_step")) - 1
    return per.select(*KEY, F.greatest(F.lit(0), F.coalesce(gap, F.lit(0))).cast("long").alias("max_gap_buckets"))


def observed_window(points: DataFrame) -> DataFrame:
    return points.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def issue_counts(sample_issue_rows: DataFrame, gap_issue_rows: DataFrame) -> DataFrame:
    kinds = sample_issue_rows.select("kind").unionByName(gap_issue_rows.select("kind"))
    return kinds.groupBy("kind").agg(F.count("*").alias("issues"))


def quality_report(points: DataFrame, issues: DataFrame, g: int, expected_buckets: Column | None = None) -> DataFrame:
    """Expected and kept points, missing and interpolated ratios, confidence, in one row.

    `points` are clean points with `is_interpolated`; `issues` has columns (kind, issues).
    Without `expected_buckets` the observed window counts, both ends included.
    """
    per_series = points.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.count_if("is_interpolated").alias("ni"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    total = per_series.agg(
        F.count("*").alias("series"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_points"),
        F.coalesce(F.sum("ni"), F.lit(0)).alias("interpolated"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    buckets = expected_buckets if expected_buckets is not None else (
        F.floor((seconds(F.col("t1")) - seconds(F.col("t0"))) / g) + 1)
    n_issues = issues.agg(F.coalesce(F.sum("issues"), F.lit(0)).cast("long").alias("issue_count"))
    rep = total.crossJoin(n_issues).withColumn(
        "expected_points", (F.col("series") * F.greatest(F.lit(1), F.coalesce(buckets, F.lit(0)))).cast("long"))
    missing = F.coalesce(F.try_divide(
        F.greatest(F.lit(0), F.col("expected_points") - F.col("total_points")).cast("double"),
        F.col("expected_points")), F.lit(0.0))
    rep = rep.withColumn("missing_ratio", F.least(F.lit(1.0), missing)).withColumn(
        "interpolated_ratio", F.least(F.lit(1.0), F.col("interpolated") / F.greatest(F.lit(1), F.col("total_points"))))
    grade = (
        F.when((F.col("missing_ratio") > 0.15) | (F.col("issue_count") > 40), "low")
        .when((F.col("missing_ratio") > 0.03) | (F.col("issue_count") > 10), "medium")
        .otherwise("high"))
    return rep.select("series", "total_points", "expected_points", "missing_ratio", "interpolated_ratio",
                      "issue_count", grade.alias("confidence"))


def derive_error_count(points: DataFrame) -> DataFrame:
    """error_count = qps * (100 - success_rate) / 100 * 60 wherever both are present."""
    both = points.where(F.col("metric").isin("qps", "success_rate")).groupBy("service", "instance", "ts").agg(
        F.max(F.when(F.col("metric") == "qps", F.col("value"))).alias("qps"),
        F.max(F.when(F.col("metric") == "success_rate", F.col("value"))).alias("sr"))
    value = F.greatest(F.lit(0.0), F.col("qps") * (100.0 - F.col("sr")) / 100.0 * 60.0)
    return both.where("qps IS NOT NULL AND sr IS NOT NULL").select(
        "service", "instance", F.lit("error_count").alias("metric"), "ts", value.alias("value"))
