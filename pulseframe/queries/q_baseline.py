"""Robust seasonal baselines."""

from pyspark.sql import functions as F

from pulseframe.functions import seconds
from pulseframe.operators import baseline as B
from pulseframe.operators.facts import with_thresholds
from pulseframe.queries import fixtures as X
from pulseframe.queries.q_stats import RK, window_points
from pulseframe.queries.registry import query, rnd, view
from pulseframe.schemas import RKEY

SLOT_MIN = 3

view("arch", f"""
SELECT w.run_id, p.*, ((p.t // 3600 + 72) % 168 - (w.we // 3600 + 72) % 168 + 1 + 336) % 168 <= 2 AS in_slot,
  p.t // 3600 % 24 AS hr, w.we // 3600 % 24 AS anchor
FROM points p JOIN windows w ON p.t >= w.a0 AND p.t < w.a1""")
view("arch_n", f"""
SELECT {RK}, count(*) FILTER (in_slot) AS n_slot, count(*) AS n_all, quantile_cont(value, 0.5) FILTER (hr = anchor) AS hm,
  count(*) FILTER (hr = anchor) AS nh FROM arch GROUP BY ALL""")


def _base_sql(min_samples):
    return f"""
SELECT {RK}, n_slot, n_all, n AS sample_size, CASE WHEN dyn THEN 'dynamic' ELSE 'static_fallback' END AS mode,
  CASE WHEN dyn THEN med END AS median, CASE WHEN dyn THEN mad END AS mad, CASE WHEN dyn THEN sc END AS scale,
  CASE WHEN dyn THEN mean END AS mean, CASE WHEN dyn THEN sd END AS stdev, CASE WHEN dyn THEN q95 END AS p95,
  CASE WHEN dyn THEN q99 END AS p99, CASE WHEN dyn THEN lo END AS min, CASE WHEN dyn THEN hi END AS max,
  CASE WHEN dyn AND nh >= 3 THEN hm END AS hour_median
FROM (SELECT *, n >= {min_samples} AND sc > 0 AS dyn FROM (
  SELECT *, greatest(1.4826 * mad, 0.008 * abs(med)) AS sc FROM (
    SELECT {RK}, any_value(n_slot) AS n_slot, any_value(n_all) AS n_all, any_value(hm) AS hm, any_value(nh) AS nh, count(*) AS n,
      any_value(med) AS med, quantile_cont(abs(value - med), 0.5) AS mad, avg(value) AS mean, stddev_pop(value) AS sd,
      quantile_cont(value, 0.95) AS q95, quantile_cont(value, 0.99) AS q99, min(value) AS lo, max(value) AS hi
    FROM (SELECT a.*, c.n_slot, c.n_all, c.hm, c.nh, quantile_cont(a.value, 0.5) OVER (PARTITION BY {', '.join('a.' + k for k in RK.split(', '))}) AS med
          FROM arch a JOIN arch_n c USING ({RK}) WHERE c.n_slot < {min_samples} OR a.in_slot) GROUP BY ALL)))"""


view("base", _base_sql(30))
view("base_slot", _base_sql(SLOT_MIN))


def archive(spark, d):
    return X.metric_points(spark, d)


def base(spark, d, min_samples=None):
    return B.baselines(archive(spark, d), X.windows(spark), X.policy(), min_samples)


def _r(c, n=4):
    return rnd(c, n).alias(c)


@query("baseline_slot_samples", f"SELECT {RK}, t AS ts_s, value FROM arch WHERE in_slot")
def baseline_slot_samples(spark, d):
    s = B.archive_samples(archive(spark, d), X.windows(spark), X.policy()).where("in_slot")
    return s.select(*RKEY, seconds(F.col("ts")).alias("ts_s"), "value")


@query("baseline_fallback_choice", f"""
SELECT {RK}, CAST(n_slot AS BIGINT) AS n_slot, CAST(n_all AS BIGINT) AS n_all,
  CASE WHEN n_slot >= {SLOT_MIN} THEN 'slot' WHEN n_all >= {SLOT_MIN} THEN 'all' ELSE 'static' END AS choice FROM arch_n""")
def baseline_fallback_choice(spark, d):
    return B.fallback_choice(B.archive_samples(archive(spark, d), X.windows(spark), X.policy()), SLOT_MIN)


_ROBUST = "CAST(sample_size AS BIGINT) AS sample_size, mode, " + ", ".join(
    f"rnd({c}, 4) AS {c}" for c in ("median", "mad", "scale", "mean", "stdev", "p95", "p99", "min", "max"))


def _robust(b):
    return b.select(*RKEY, "sample_size", "mode", *[_r(c) for c in ("median", "mad", "scale", "mean", "stdev", "p95", "p99", "min", "max")])


@query("baseline_robust", f"SELECT {RK}, {_ROBUST} FROM base")
def baseline_robust(spark, d):
    return _robust(base(spark, d))


@query("baseline_robust_slot", f"SELECT {RK}, {_ROBUST} FROM base_slot")
def baseline_robust_slot(spark, d):
    return _robust(base(spark, d, SLOT_MIN))


@query("baseline_hour_profile", f"""
SELECT {RK}, CAST(hr AS INT) AS hour, CAST(count(*) AS BIGINT) AS n, rnd(quantile_cont(value, 0.5), 4) AS hour_median
FROM arch GROUP BY ALL HAVING count(*) >= 3""")
def baseline_hour_profile(spark, d):
    h = B.hour_profile(B.archive_samples(archive(spark, d), X.windows(spark), X.policy()))
    return h.select(*RKEY, "hour", "n", _r("hour_median"))


view("thr", """
SELECT m.metric, s.service, CASE WHEN o.service IS NOT NULL THEN o.omin ELSE d.dmin END AS red_min,
  CASE WHEN o.service IS NOT NULL THEN o.omax ELSE d.dmax END AS red_max, d.dmax AS default_max
FROM cat m CROSS JOIN svc s LEFT JOIN thr_default d ON d.metric = m.metric
LEFT JOIN thr_over o ON o.metric = m.metric AND o.service = s.service""")
view("slo_t", """
SELECT m.metric, s.service, coalesce(o.oslo, d.dslo) AS slo FROM cat m CROSS JOIN svc s LEFT JOIN slo_default d ON d.metric = m.metric
LEFT JOIN slo_over o ON o.metric = m.metric AND o.service = s.service""")


@query("baseline_bands", f"""
SELECT {RK}, rnd(CASE WHEN median IS NOT NULL AND scale > 0 THEN median + 4 * scale ELSE red_max END, 4) AS upper,
  rnd(CASE WHEN median IS NOT NULL AND scale > 0 THEN median - 4 * scale ELSE red_min END, 4) AS lower
FROM base JOIN thr USING (metric, service)""")
def baseline_bands(spark, d):
    p = X.policy()
    b = B.bands(with_thresholds(base(spark, d), p), p.band_k)
    return b.select(*RKEY, _r("upper"), _r("lower"))


@query("baseline_confidence", f"""
SELECT {RK}, CASE WHEN mode <> 'dynamic' THEN 'low' WHEN sample_size >= 200 THEN 'high' WHEN sample_size >= 60 THEN 'medium' ELSE 'low' END AS confidence,
  mode = 'dynamic' AND sample_size >= 30 AND scale > 0 AS usable FROM base""")
def baseline_confidence(spark, d):
    return base(spark, d).select(*RKEY, B.confidence(F.col("mode"), F.col("sample_size")).alias("confidence"),
                                 F.coalesce(B.is_usable(), F.lit(False)).alias("usable"))


@query("robust_z", f"""
SELECT {RK}, t AS ts_s, rnd(coalesce((value - coalesce(hour_median, median)) / coalesce(nullif(scale, 0), nullif(stdev, 0)), 0), 4) AS z
FROM wp LEFT JOIN base USING ({RK})""")
def robust_z(spark, d):
    j = window_points(spark, d).join(base(spark, d), RKEY, "left")
    return j.select(*RKEY, seconds(F.col("ts")).alias("ts_s"), rnd(B.robust_z(F.col("value")), 4).alias("z"))


@query("deviation_pct", f"""
SELECT {RK}, t AS ts_s, rnd(coalesce((value - c) / nullif(abs(c), 0) * 100, 0), 4) AS deviation_pct
FROM (SELECT *, coalesce(hour_median, median) AS c FROM wp LEFT JOIN base USING ({RK}))""")
def deviation_pct(spark, d):
    j = window_points(spark, d).join(base(spark, d), RKEY, "left")
    return j.select(*RKEY, seconds(F.col("ts")).alias("ts_s"), rnd(B.deviation_pct(F.col("value")), 4).alias("deviation_pct"))


view("base_all", f"""
SELECT w.run_id, i.service, i.instance, c.metric, coalesce(b.mode, 'static_fallback') AS mode, coalesce(b.sample_size, 0) AS sample_size
FROM windows w CROSS JOIN inst i CROSS JOIN cat c
LEFT JOIN base b ON b.run_id = w.run_id AND b.service = i.service AND b.instance = i.instance AND b.metric = c.metric""")


def _collected(spark, d):
    p = X.policy()
    inst = p.service_dim(spark).select("service", F.explode("instances").alias("instance"))
    return B.collect(base(spark, d), X.windows(spark), inst, p.catalog(spark))


@query("baseline_collect", f"SELECT {RK}, mode, CAST(sample_size AS BIGINT) AS sample_size FROM base_all")
def baseline_collect(spark, d):
    return _collected(spark, d).select(*RKEY, "mode", F.col("sample_size").cast("long").alias("sample_size"))


@query("baseline_coverage", """
SELECT run_id, CAST(count(*) AS BIGINT) AS series, rnd(avg(CASE WHEN mode = 'dynamic' THEN 1.0 ELSE 0.0 END), 6) AS dynamic_ratio,
  avg(CASE WHEN mode = 'dynamic' THEN 1.0 ELSE 0.0 END) < 0.5 AS degraded FROM base_all GROUP BY run_id""")
def baseline_coverage(spark, d):
    return B.coverage(_collected(spark, d)).withColumn("dynamic_ratio", rnd("dynamic_ratio", 6))
