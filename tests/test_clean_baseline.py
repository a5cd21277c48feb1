"""Cleaning and baselines on hand-made series."""

import pytest
from pyspark.sql import functions as F

from pulseframe.operators import baseline as B
from pulseframe.operators import clean as C
from tests.helpers import END, points, rows, small_policy, window

POL = small_policy()


def cleaned(spark, series, unit=None, **kw):
    return C.clean(points(spark, *series).withColumn("unit", F.lit(unit).cast("string")), kw.pop("policy", POL), **kw)


def test_out_of_range_is_dropped_not_clamped(spark):
    s = [rows("success_rate", [99.9] * 20 + [103.7] + [99.9] * 9)]
    conv = C.convert_units(points(spark, *s).withColumn("unit", F.lit("%")), POL)
    assert C.range_filter(conv).count() == 29
    assert C.sample_issues(conv).count() == 1


def test_units(spark):
    assert {r.value for r in cleaned(spark, [rows("latency_p99", [3.0] * 10)], "s").collect()} == {3000.0}
    assert {r.value for r in cleaned(spark, [rows("success_rate", [0.5] * 5)], "ratio").collect()} == {50.0}
    conv = C.convert_units(points(spark, rows("latency_p99", [3.0] * 4)).withColumn("unit", F.lit("parsec")), POL)
    assert [r.reason for r in C.sample_issues(conv).collect()] == ["unknown_unit"] * 4
    assert {r.value for r in conv.collect()} == {3.0}


def test_nan_is_invalid(spark):
    p = points(spark, rows("cpu_usage", [5.0] * 5)).withColumn("value", F.when(F.col("value") == 5.0, F.lit(float("nan"))))
    assert C.range_filter(C.convert_units(p.withColumn("unit", F.lit("%")), POL)).count() == 0


def test_short_gap_is_filled_linearly(spark):
    v = [float(i) if i < 5 or i > 6 else None for i in range(12)]
    got = cleaned(spark, [rows("qps", v)]).orderBy("ts").collect()
    assert [r.value for r in got] == [float(i) for i in range(12)]
    assert sum(r.is_interpolated for r in got) == 2


def test_long_gap_stays(spark):
    from dataclasses import replace
    v = [float(i) if i < 4 or i > 8 else None for i in range(12)]
    pol = replace(POL, max_gap_buckets=1)
    assert cleaned(spark, [rows("qps", v)], policy=pol).count() == 7
    issue, = C.gap_issues(C.gaps(points(spark, rows("qps", v)), 60), 60, 1).collect()
    assert issue.missing == 5 and issue.kind == "missing"


def test_duplicates_merge(spark):
    p = points(spark, rows("qps", [10.0] * 6, step=1, end=END), rows("qps", [40.0], step=1, end=END - 7))
    m = {how: C.merge_buckets(p, 60, how).collect()[0].value for how in ("mean", "max", "last")}
    assert m == {"mean": pytest.approx(100 / 7), "max": 40.0, "last": 10.0}


def test_stats_count_every_sample_once(spark):
    v = [99.9] * 5 + [None] * 2 + [99.9] * 3 + [130.0]
    p = points(spark, rows("success_rate", v)).withColumn("unit", F.lit("%"))
    r, = C.clean_stats(p, POL).collect()
    assert (r.raw_points, r.kept_points, r.interpolated, r.dropped_out_of_range) == (9, 10, 2, 1)
    assert r.kept_points == C.clean(p, POL).count()


def test_order_and_layout_do_not_matter(spark):
    v = [float((i * 37) % 50) if i % 9 else None for i in range(200)]
    p = points(spark, rows("qps", v)).withColumn("unit", F.lit(None).cast("string"))
    a = sorted(map(tuple, C.clean(p, POL).collect()))
    b = sorted(map(tuple, C.clean(p.repartition(7, "value").sortWithinPartitions("value"), POL).collect()))
    assert a == b


def test_hot_series_is_reduced_before_the_shuffle(spark):
    """A series with most raw rows leaves at most one row per bucket and map task."""
    hot = spark.range(0, 90_000, 1, 6).select(
        F.lit("order-svc").alias("service"), F.when(F.col("id") % 3 == 0, "order-svc-0").otherwise("order-svc-1").alias("instance"),
        F.lit("qps").alias("metric"), F.timestamp_seconds(F.lit(END) - F.col("id") % 600).alias("ts"), F.lit(1.0).alias("value"))
    plan = C.merge_buckets(hot, 60)._jdf.queryExecution().executedPlan().toString()
    assert "partial_avg" in plan
    assert C.merge_buckets(hot, 60).count() == 11 + 10


# ------------------------------------------------------------------ baselines
def base(spark, values, step=300, **kw):
    p = points(spark, rows("latency_p99", values, step=step))
    return B.baselines(p, window(spark), kw.pop("policy", POL), kw.pop("min_samples", None)).collect()[0]


def test_mad_resists_outliers(spark):
    b = base(spark, [100 + i % 5 for i in range(190)] + [3000] * 10)
    assert abs(b["median"] - 102) <= 1 and b["mode"] == "dynamic"
    assert b["median"] + 4 * b["scale"] < 200


def test_scale_floor_and_constant_zero(spark):
    assert base(spark, [500.0] * 50)["scale"] == pytest.approx(4.0)
    zero = base(spark, [0.0] * 50)
    assert zero["mode"] == "static_fallback" and zero["median"] is None


def test_short_archive_is_static(spark):
    b = base(spark, [100.0 + i for i in range(10)])
    assert b["mode"] == "static_fallback" and b["sample_size"] == 10


def test_slot_is_preferred_when_long_enough(spark):
    # 14 days of 5-minute samples: the anchor's three hour slots of the week hold 36 samples per week
    values = [1000.0 if ((END - (4032 - i) * 300) // 3600 - (END // 3600) + 1) % 168 <= 2 else 10.0 for i in range(4032)]
    b = base(spark, values)
    assert b["n_slot"] >= 60 and b["n_all"] > 4000 and b["median"] == 1000.0


def test_z_and_deviation_signs(spark):
    b = spark.createDataFrame([(100.0, 5.0, 5.0, None)], "median double, scale double, stdev double, hour_median double")
    r = b.select(B.robust_z(F.lit(90.0)).alias("z"), B.deviation_pct(F.lit(90.0)).alias("d")).first()
    assert r.z == -2.0 and r.d == -10.0
    r = b.withColumn("hour_median", F.lit(80.0)).select(B.deviation_pct(F.lit(90.0)).alias("d")).first()
    assert r.d == 12.5


def test_confidence_steps(spark):
    df = spark.createDataFrame([("dynamic", 200), ("dynamic", 60), ("dynamic", 30), ("static_fallback", 500)], "mode string, n int")
    assert [r[0] for r in df.select(B.confidence(F.col("mode"), F.col("n"))).collect()] == ["high", "medium", "low", "low"]
