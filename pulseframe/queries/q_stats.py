"""Series statistics, one row per run and series."""

from pyspark.sql import functions as F

from pulseframe.functions import seconds
from pulseframe.operators import stats as S
from pulseframe.operators.windows import assign_windows, sliding_windows
from pulseframe.queries import fixtures as X
from pulseframe.queries.registry import query, rnd, view
from pulseframe.schemas import RKEY

RK = "run_id, service, instance, metric"
view("wp", """
SELECT w.run_id, w.ws, w.we, p.* FROM points p JOIN windows w ON p.t >= w.ws AND p.t < w.we""")
view("sparse_wp", """
SELECT w.run_id, w.ws, w.we, p.* FROM sparse p JOIN windows w ON p.t >= w.ws AND p.t < w.we""")


def window_points(spark, d):
    w = X.windows(spark).select("run_id", "window_start", "window_end")
    return assign_windows(X.metric_points(spark, d), w)


def _r(c, n=4):
    return rnd(c, n).alias(c)


@query("window_points", f"SELECT {RK}, t AS ts_s, value FROM wp")
def window_points_q(spark, d):
    return window_points(spark, d).select(*RKEY, seconds(F.col("ts")).alias("ts_s"), "value")


@query("sliding_windows", """
WITH g AS (SELECT *, unnest([t // 172800 * 172800 - 172800, t // 172800 * 172800]) AS a FROM points)
SELECT concat('run-', a + 345600) AS run_id, service, instance, metric, CAST(count(*) AS BIGINT) AS n, max(value) AS vmax
FROM g WHERE t >= a AND t < a + 345600 GROUP BY ALL""")
def sliding_windows_q(spark, d):
    p = sliding_windows(X.metric_points(spark, d), "4 days", "2 days")
    return p.groupBy("run_id", "service", "instance", "metric").agg(F.count("*").alias("n"), F.max("value").alias("vmax"))


@query("series_moments", f"""
SELECT {RK}, CAST(count(*) AS BIGINT) AS n, rnd(avg(value), 4) AS mean, rnd(CASE WHEN count(*) > 1 THEN stddev_pop(value) ELSE 0 END, 4) AS stdev,
  rnd(CASE WHEN avg(value) = 0 THEN 0 ELSE stddev_pop(value) / abs(avg(value)) END, 4) AS cv FROM wp GROUP BY ALL""")
def series_moments(spark, d):
    return S.moments(window_points(spark, d), RKEY).select(*RKEY, "n", _r("mean"), _r("stdev"), _r("cv"))


@query("series_percentiles", f"""
SELECT {RK}, rnd(quantile_cont(value, 0.5), 4) AS p50, rnd(quantile_cont(value, 0.95), 4) AS p95, rnd(quantile_cont(value, 0.99), 4) AS p99
FROM wp GROUP BY ALL""")
def series_percentiles(spark, d):
    return S.percentiles(window_points(spark, d), RKEY).select(*RKEY, _r("p50"), _r("p95"), _r("p99"))


@query("series_worst", f"""
SELECT *, CASE WHEN metric = 'success_rate' THEN vmin ELSE vmax END AS worst FROM (
  SELECT {RK}, min(value) AS vmin, max(value) AS vmax FROM wp GROUP BY ALL)""")
def series_worst(spark, d):
    return S.worst(window_points(spark, d), RKEY, X.policy().catalog(spark))


@query("series_first_last", f"""
SELECT {RK}, min(t) AS first_s, max(t) AS last_s, arg_min(value, t) AS first_value, arg_max(value, t) AS last_value FROM wp GROUP BY ALL""")
def series_first_last(spark, d):
    f = S.first_last(window_points(spark, d), RKEY)
    return f.select(*RKEY, seconds(F.col("first_ts")).alias("first_s"), seconds(F.col("last_ts")).alias("last_s"), "first_value", "last_value")


view("trend", f"""
SELECT *, CASE WHEN NOT ok THEN 0 WHEN sse = 0 AND slope <> 0 THEN 'inf'::DOUBLE WHEN sse = 0 THEN 0
    ELSE slope / sqrt(sse / (n - 2) / sxx) END AS t_stat,
  CASE WHEN NOT ok OR syy = 0 THEN 0 ELSE greatest(0, 1 - sse / syy) END AS r2,
  CASE WHEN median = 0 THEN 0 ELSE slope * 60 / abs(median) * 100 END AS slope_pct,
  CASE WHEN span = 0 OR abs(slope) * 5 < span * 0.2 THEN 'stable' WHEN slope > 0 THEN 'rising' ELSE 'falling' END AS trend
FROM (SELECT *, CASE WHEN e <= syy * 1e-12 THEN 0 ELSE e END AS sse, CASE WHEN ok THEN sxy / sxx ELSE 0 END AS slope FROM (
  SELECT *, n >= 3 AND sxx > 0 AS ok, greatest(0, syy - sxy * sxy / nullif(sxx, 0)) AS e FROM (
    SELECT {RK}, count(*) AS n, sum((x - mx) * (x - mx)) AS sxx, sum((value - my) * (value - my)) AS syy,
      sum((x - mx) * (value - my)) AS sxy, quantile_cont(value, 0.5) AS median, max(value) - min(value) AS span
    FROM (SELECT *, (t - ws) / 60.0::DOUBLE AS x, avg((t - ws) / 60.0::DOUBLE) OVER w AS mx, avg(value) OVER w AS my FROM wp
          WINDOW w AS (PARTITION BY {RK})) GROUP BY ALL)))""")


@query("series_slope", f"SELECT {RK}, rnd(slope * 1000, 4) AS slope_milli FROM trend")
def series_slope(spark, d):
    return S.trend(window_points(spark, d), RKEY).select(*RKEY, rnd(F.col("slope") * 1000, 4).alias("slope_milli"))


@query("series_trend", f"SELECT {RK}, CAST(n AS BIGINT) AS n, rnd(t_stat, 4) AS t_stat, rnd(r2, 4) AS r2 FROM trend")
def series_trend(spark, d):
    return S.trend(window_points(spark, d), RKEY).select(*RKEY, "n", _r("t_stat"), _r("r2"))


@query("series_slope_pct", f"SELECT {RK}, rnd(slope_pct, 5) AS slope_pct FROM trend")
def series_slope_pct(spark, d):
    return S.trend(window_points(spark, d), RKEY).select(*RKEY, _r("slope_pct", 5))


@query("series_trend_label", f"SELECT {RK}, trend FROM trend")
def series_trend_label(spark, d):
    return S.trend(window_points(spark, d), RKEY).select(*RKEY, "trend")


view("dig", f"""
SELECT a.*, t.trend FROM (
  SELECT {RK}, CAST(count(*) AS BIGINT) AS samples, rnd(min(value), 3) AS min, rnd(quantile_cont(value, 0.5), 3) AS p50,
    rnd(quantile_cont(value, 0.95), 3) AS p95, rnd(max(value), 3) AS max, rnd(avg(value), 3) AS mean,
    rnd(arg_min(value, t), 3) AS first, rnd(arg_max(value, t), 3) AS last FROM wp GROUP BY ALL) a JOIN trend t USING ({RK})""")


_DIG = ("min", "p50", "p95", "max", "mean", "first", "last")


@query("series_digest", f"SELECT {RK}, samples, trend, " + ", ".join(f"{c} AS {c}" for c in _DIG) + " FROM dig")
def series_digest(spark, d):
    return S.digest(window_points(spark, d), RKEY, decimals=None).select(*RKEY, "samples", "trend", *[_r(c, 3) for c in _DIG])


@query("series_step", f"""
WITH l AS (SELECT {RK}, t - lag(t) OVER (PARTITION BY {RK} ORDER BY t) AS dt FROM sparse_wp),
a AS (SELECT {RK}, list_sort(list(dt) FILTER (dt > 0)) AS ds FROM l GROUP BY ALL)
SELECT {RK}, CASE WHEN ds IS NULL OR len(ds) = 0 THEN 1 ELSE greatest(1, ds[(len(ds) - 1) // 2 + 1] / 60.0::DOUBLE) END AS step_minutes FROM a""")
def series_step(spark, d):
    w = X.windows(spark).select("run_id", "window_start", "window_end")
    return S.step_minutes(assign_windows(X.sparse_points(spark, d), w), RKEY)


@query("trailing_stats", """
SELECT service, instance, metric, t AS ts_s, CAST(count(*) OVER w AS BIGINT) AS n, rnd(avg(value) OVER w, 4) AS mean, max(value) OVER w AS vmax FROM points
WINDOW w AS (PARTITION BY service, instance, metric ORDER BY t RANGE BETWEEN 172799 PRECEDING AND CURRENT ROW)""")
def trailing_stats(spark, d):
    t = S.trailing(X.metric_points(spark, d), 172_800)
    return t.select("service", "instance", "metric", seconds(F.col("ts")).alias("ts_s"), "n", rnd("mean").alias("mean"), "vmax")
