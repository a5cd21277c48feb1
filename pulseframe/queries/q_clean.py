"""Projection, filtering and cleaning."""

from pyspark.sql import functions as F

from pulseframe.functions import seconds
from pulseframe.operators import clean as C
from pulseframe.operators.windows import bucket_spine
from pulseframe.queries import fixtures as X
from pulseframe.queries.registry import query, rnd, view

K = ["service", "instance", "metric"]
G = X.G


def _s(name="ts", alias="ts_s"):
    return seconds(F.col(name)).alias(alias)


view("conv", """
SELECT s.service, s.instance, s.metric, s.t, s.seq, c.lo, c.hi, coalesce(nullif(s.unit, ''), c.unit) AS src_unit, c.unit,
  f.factor IS NULL AND coalesce(nullif(s.unit, ''), c.unit) <> c.unit AS unit_unknown,
  s.value * coalesce(f.factor, 1) AS value
FROM raw_samples s JOIN cat c USING (metric)
LEFT JOIN unit_factor f ON f.src = coalesce(nullif(s.unit, ''), c.unit) AND f.dst = c.unit""")
view("conv_ok", "SELECT *, NOT isnan(value) AND value BETWEEN lo AND hi AS valid FROM conv")
view("clean_mean", f"""
SELECT service, instance, metric, t // {G} * {G} AS t, avg(value) AS value FROM conv_ok WHERE valid GROUP BY ALL""")
view("gap", f"""
SELECT *, coalesce((nt - t) // {G} - 1, 0) AS missing FROM (
  SELECT *, lead(t) OVER w AS nt, lead(value) OVER w AS nv FROM sparse WINDOW w AS (PARTITION BY service, instance, metric ORDER BY t))""")
view("filled", f"""
SELECT service, instance, metric, t, round(value, 6) AS value, FALSE AS interpolated FROM gap
UNION ALL SELECT service, instance, metric, x, round(value + (nv - value) * ((x - t) / CAST(nt - t AS DOUBLE)), 6), TRUE
FROM (SELECT *, unnest(generate_series(t + {G}, nt - {G}, {G})) AS x FROM gap WHERE missing BETWEEN 1 AND 3)""")
view("clean_gap", f"""
SELECT *, coalesce((nt - t) // {G} - 1, 0) AS missing FROM (
  SELECT *, lead(t) OVER w AS nt, lead(value) OVER w AS nv FROM clean_mean WINDOW w AS (PARTITION BY service, instance, metric ORDER BY t))""")
view("clean_points", f"""
SELECT service, instance, metric, t, round(value, 6) AS value, FALSE AS interpolated FROM clean_gap
UNION ALL SELECT service, instance, metric, x, round(value + (nv - value) * ((x - t) / CAST(nt - t AS DOUBLE)), 6), TRUE
FROM (SELECT *, unnest(generate_series(t + {G}, nt - {G}, {G})) AS x FROM clean_gap WHERE missing BETWEEN 1 AND 3)""")


def _conv(spark, d):
    return C.convert_units(X.raw_samples(spark, d), X.policy())


@query("unit_convert", """
SELECT service, instance, metric, seq, src_unit, unit, unit_unknown, CASE WHEN isnan(value) THEN NULL ELSE rnd(value, 4) END AS value FROM conv""")
def unit_convert(spark, d):
    v = F.when(~F.isnan("value"), rnd("value", 4))
    return _conv(spark, d).select(*K, "seq", "src_unit", "unit", "unit_unknown", v.alias("value"))


@query("unit_issues", """
SELECT metric, src_unit, 'out_of_range' AS kind, CAST(count(*) AS BIGINT) AS issues FROM conv WHERE unit_unknown GROUP BY ALL""")
def unit_issues(spark, d):
    return _conv(spark, d).where("unit_unknown").groupBy("metric", "src_unit").agg(F.count("*").alias("issues")).withColumn(
        "kind", F.lit("out_of_range"))


@query("range_filter", "SELECT service, instance, metric, seq, rnd(value, 4) AS value FROM conv_ok WHERE valid")
def range_filter(spark, d):
    return C.range_filter(_conv(spark, d)).select(*K, "seq", rnd("value", 4).alias("value"))


@query("range_issues", """
SELECT service, instance, metric, reason, CAST(count(*) AS BIGINT) AS issues FROM (
  SELECT *, 'unknown_unit' AS reason FROM conv_ok WHERE unit_unknown UNION ALL
  SELECT *, 'invalid_value' FROM conv_ok WHERE NOT valid) GROUP BY ALL""")
def range_issues(spark, d):
    return C.sample_issues(_conv(spark, d)).groupBy(*K, "reason").agg(F.count("*").alias("issues"))


@query("bucket_align", f"SELECT event_id, t // {G} * {G} AS bucket_s FROM ev")
def bucket_align(spark, d):
    return X.events(spark, d).select("event_id", seconds(C.bucket(F.col("ts"), G)).alias("bucket_s"))


def _merge(how, expr):
    @query(f"bucket_merge_{how}", f"""
SELECT service, instance, metric, t // {G} * {G} AS ts_s, rnd({expr}, 4) AS value FROM conv_ok WHERE valid GROUP BY ALL""")
    def q(spark, d):
        m = C.merge_buckets(C.range_filter(_conv(spark, d)), G, how, ("seq",))
        return m.select(*K, _s(), rnd("value", 4).alias("value"))
    return q


_merge("mean", "avg(value)")
_merge("max", "max(value)")
_merge("last", "arg_max(value, (t, seq))")


@query("gap_detect", """
SELECT service, instance, metric, t AS ts_s, nt AS next_s, missing FROM gap WHERE missing > 0""")
def gap_detect(spark, d):
    return C.gaps(X.sparse_points(spark, d), G).where("missing > 0").select(*K, _s(), _s("next_ts", "next_s"), "missing")


@query("gap_interpolate", "SELECT service, instance, metric, t AS ts_s, rnd(value, 4) AS value, interpolated FROM filled")
def gap_interpolate(spark, d):
    p = C.interpolate(C.gaps(X.sparse_points(spark, d), G), G, 3)
    return p.select(*K, _s(), rnd("value", 4).alias("value"), F.col("is_interpolated").alias("interpolated"))


@query("gap_issues", f"""
SELECT service, instance, metric, missing, t + {G} AS from_s, nt AS to_s FROM gap WHERE missing > 3""")
def gap_issues(spark, d):
    g = C.gap_issues(C.gaps(X.sparse_points(spark, d), G), G, 3)
    return g.select(*K, "missing", _s("gap_from", "from_s"), _s("gap_to", "to_s"))


@query("clean", "SELECT service, instance, metric, t AS ts_s, rnd(value, 4) AS value, interpolated FROM clean_points")
def clean(spark, d):
    p = C.clean(X.raw_samples(spark, d), X.policy(), "mean")
    return p.select(*K, _s(), rnd("value", 4).alias("value"), F.col("is_interpolated").alias("interpolated"))


@query("clean_clipped", f"""
SELECT service, instance, metric, t AS ts_s, rnd(value, 4) AS value FROM clean_points
WHERE t >= {X.DAY0 + 10 * X.DAY} AND t < {X.DAY0 + 12 * X.DAY}""")
def clean_clipped(spark, d):
    p = C.clip(C.clean(X.raw_samples(spark, d), X.policy(), "mean"), G, F.timestamp_seconds(F.lit(X.DAY0 + 10 * X.DAY + 99)),
               F.timestamp_seconds(F.lit(X.DAY0 + 12 * X.DAY + 99)))
    return p.select(*K, _s(), rnd("value", 4).alias("value"))


@query("clean_stats", """
WITH raw AS (SELECT service, instance, metric, count(*) AS n, count(*) FILTER (NOT valid) AS bad FROM conv_ok GROUP BY ALL),
k AS (SELECT service, instance, metric, count(*) AS kept, count(*) FILTER (interpolated) AS ip FROM clean_points GROUP BY ALL)
SELECT service, instance, metric, CAST(n AS BIGINT) AS raw_points, CAST(kept AS BIGINT) AS kept_points, CAST(ip AS BIGINT) AS interpolated,
  CAST(bad AS BIGINT) AS dropped_out_of_range FROM raw JOIN k USING (service, instance, metric)""")
def clean_stats(spark, d):
    return C.clean_stats(X.raw_samples(spark, d), X.policy())


@query("max_gap", """
WITH dl AS (SELECT service, instance, metric, nt - t AS d FROM gap WHERE nt IS NOT NULL),
l AS (SELECT service, instance, metric, list_sort(list(d)) AS a FROM dl GROUP BY ALL),
k AS (SELECT DISTINCT service, instance, metric FROM sparse)
SELECT service, instance, metric, CAST(coalesce(greatest(0, a[len(a)] // a[len(a) // 2 + 1] - 1), 0) AS BIGINT) AS max_gap_buckets
FROM k LEFT JOIN l USING (service, instance, metric)""")
def max_gap(spark, d):
    return C.max_gap(X.sparse_points(spark, d))


def _issues(spark, d):
    p = X.sparse_points(spark, d)
    return C.issue_counts(C.sample_issues(_conv(spark, d)), C.gap_issues(C.gaps(p, G), G, 3))


@query("quality_issue_counts", """
SELECT kind, CAST(count(*) AS BIGINT) AS issues FROM (
  SELECT 'out_of_range' AS kind FROM conv_ok WHERE unit_unknown UNION ALL SELECT 'out_of_range' FROM conv_ok WHERE NOT valid
  UNION ALL SELECT 'missing' FROM gap WHERE missing > 3) GROUP BY kind""")
def quality_issue_counts(spark, d):
    return _issues(spark, d)


@query("quality_report", f"""
WITH s AS (SELECT count(DISTINCT (service, instance, metric)) AS series, count(*) AS total, count(*) FILTER (interpolated) AS ip,
  (max(t) - min(t)) // {G} + 1 AS buckets FROM filled),
i AS (SELECT count(*) AS issue_count FROM gap WHERE missing > 3),
r AS (SELECT CAST(series AS BIGINT) AS series, CAST(total AS BIGINT) AS total_points, CAST(series * buckets AS BIGINT) AS expected_points,
  rnd(greatest(0, series * buckets - total) / CAST(series * buckets AS DOUBLE), 6) AS missing_ratio,
  rnd(ip / CAST(total AS DOUBLE), 6) AS interpolated_ratio, CAST(issue_count AS BIGINT) AS issue_count FROM s, i)
SELECT *, CASE WHEN missing_ratio > 0.15 OR issue_count > 40 THEN 'low' WHEN missing_ratio > 0.03 OR issue_count > 10 THEN 'medium' ELSE 'high' END AS confidence FROM r""")
def quality_report(spark, d):
    gapped = C.gaps(X.sparse_points(spark, d), G)
    p = C.interpolate(gapped, G, 3)
    issues = C.gap_issues(gapped, G, 3).groupBy("kind").agg(F.count("*").alias("issues"))
    r = C.quality_report(p, issues, G)
    return r.withColumn("missing_ratio", rnd("missing_ratio", 6)).withColumn("interpolated_ratio", rnd("interpolated_ratio", 6))


@query("bucket_spine", f"SELECT run_id, unnest(generate_series(ws, we - 1, {G})) AS ts_s, (SELECT CAST(count(*) AS BIGINT) FROM points) AS points FROM windows")
def bucket_spine_q(spark, d):
    n = X.metric_points(spark, d).agg(F.count("*").alias("points"))
    return bucket_spine(X.windows(spark), G).select("run_id", _s()).crossJoin(n)


@query("observed_window", "SELECT min(t) AS first_s, max(t) AS last_s FROM sparse")
def observed_window(spark, d):
    return C.observed_window(X.sparse_points(spark, d)).select(_s("first_ts", "first_s"), _s("last_ts", "last_s"))


@query("derived_error_count", """
SELECT q.service, q.instance, q.t AS ts_s, rnd(greatest(0, q.value * (100 - s.value) / 100 * 60), 4) AS value
FROM points q JOIN points s ON q.service = s.service AND q.instance = s.instance AND q.t = s.t AND q.metric = 'qps' AND s.metric = 'success_rate'""")
def derived_error_count(spark, d):
    return C.derive_error_count(X.metric_points(spark, d)).select("service", "instance", _s(), rnd("value", 4).alias("value"))
