"""Scans, sources and sinks."""

from pyspark.sql import functions as F

from pulseframe.functions import run_id_text, duration_text, hour_of_week, seconds
from pulseframe.queries import fixtures as X
from pulseframe.queries.registry import query, rnd
from pulseframe.sources import changes as C
from pulseframe.sources import points as P
from pulseframe.sources import series_files as S
from pulseframe.sources import sinks
from pulseframe.streaming.operators import fresh_path

T0, T1 = X.DAY0 + 10 * X.DAY, X.DAY0 + 20 * X.DAY


def _ts(epoch):
    return F.timestamp_seconds(F.lit(epoch))


def _compact(spark, d):
    return S.compact_series(X.sparse_points(spark, d), X.G)


def _datasets(spark, d):
    """Points of both derivations as two datasets."""
    a = X.metric_points(spark, d).withColumn("dataset_id", F.lit("wide"))
    return a.unionByName(X.sparse_points(spark, d).withColumn("dataset_id", F.lit("sparse")))


DATASETS = "(SELECT 'wide' AS dataset_id, * FROM points UNION ALL SELECT 'sparse', * FROM sparse)"


@query("series_explode", f"""
SELECT service, instance, metric, t AS ts_s, rnd(value, 4) AS value FROM sparse WHERE t >= {T0 + 7} AND t < {T1 + 7}""")
def series_explode(spark, d):
    p = S.explode_series(_compact(spark, d), _ts(T0 + 7), _ts(T1 + 7))
    return p.select("service", "instance", "metric", seconds(F.col("ts")).alias("ts_s"), rnd("value").alias("value"))


@query("series_file_scan", f"""
SELECT dataset_id, service, instance, metric, t AS ts_s, rnd(value, 4) AS value FROM {DATASETS} WHERE t >= {T0 + 7} AND t < {T1 + 7}""")
def series_file_scan(spark, d):
    """Both datasets landed as JSON documents, read back in pieces, cut to a range."""
    path = fresh_path(spark, "series-files")
    series = S.compact_series(_datasets(spark, d), X.G, ("dataset_id",))
    S.write_series_files(series.withColumn("scenario_id", F.lit("S0")), path)
    p = S.explode_series(S.read_series_records(spark, path), _ts(T0 + 7), _ts(T1 + 7))
    return p.select("dataset_id", "service", "instance", "metric", seconds(F.col("ts")).alias("ts_s"), rnd("value").alias("value"))


@query("series_compact", f"""
WITH b AS (SELECT service, instance, metric, min(t) AS t0, max(t) AS t1 FROM sparse GROUP BY ALL),
s AS (SELECT service, instance, metric, t0, unnest(generate_series(t0, t1, {X.G})) AS t FROM b)
SELECT s.service, s.instance, s.metric, s.t0 AS start_epoch, CAST(count(*) AS BIGINT) AS n_buckets,
  CAST(count(p.value) AS BIGINT) AS n_values,
  string_agg(coalesce(printf('%.3f', rnd(p.value, 3)), 'x'), ',' ORDER BY s.t) AS packed
FROM s LEFT JOIN sparse p ON p.service = s.service AND p.instance = s.instance AND p.metric = s.metric AND p.t = s.t
GROUP BY ALL""")
def series_compact(spark, d):
    c = _compact(spark, d)
    txt = F.transform("values", lambda v: F.when(v.isNull(), "x").otherwise(F.format_string("%.3f", rnd(v, 3))))
    return c.select("service", "instance", "metric", "start_epoch", F.size("values").cast("long").alias("n_buckets"),
                    F.size(F.filter("values", lambda v: v.isNotNull())).cast("long").alias("n_values"),
                    F.array_join(txt, ",").alias("packed"))


@query("series_slice", f"""
WITH b AS (SELECT service, instance, metric, min(t) AS t0, max(t) AS t1 FROM sparse GROUP BY ALL),
c AS (SELECT service, instance, metric, greatest(t0, t0 + ({T0 + 7} - t0) // {X.G} * {X.G}) AS s, t1 FROM b),
e AS (SELECT *, s + greatest(0, ({T1 + 7} - s) // {X.G}) * {X.G} AS stop FROM c)
SELECT e.service, e.instance, e.metric, e.s AS start_epoch,
  CAST(greatest(0, (least(stop, t1 + {X.G}) - s) // {X.G}) AS BIGINT) AS n_buckets,
  CAST(count(p.value) AS BIGINT) AS n_values, rnd(sum(p.value), 4) AS total
FROM e LEFT JOIN sparse p ON p.service = e.service AND p.instance = e.instance AND p.metric = e.metric AND p.t >= e.s AND p.t < e.stop
GROUP BY ALL""")
def series_slice(spark, d):
    s = S.slice_series(_compact(spark, d), _ts(T0 + 7), _ts(T1 + 7))
    total = F.aggregate("values", F.lit(None).cast("double"), lambda a, v: F.when(v.isNull(), a).otherwise(F.coalesce(a, F.lit(0.0)) + v))
    return s.select("service", "instance", "metric", "start_epoch", F.size("values").cast("long").alias("n_buckets"),
                    F.size(F.filter("values", lambda v: v.isNotNull())).cast("long").alias("n_values"),
                    rnd(total).alias("total"))


@query("series_query", f"""
SELECT instance, metric, t AS ts_s, value FROM points WHERE service = 'svc-1' AND instance IN ('svc-1-0', 'svc-1-1')
  AND metric IN ('qps', 'cpu_usage') AND t >= {T0} AND t < {T1}""")
def series_query(spark, d):
    p = P.select_points(X.metric_points(spark, d), "svc-1", ["svc-1-0", "svc-1-1"], ["qps", "cpu_usage"], _ts(T0), _ts(T1))
    return p.select("instance", "metric", seconds(F.col("ts")).alias("ts_s"), "value")


@query("series_range_scan", f"""
SELECT service, instance, metric, t AS ts_s, value FROM points WHERE t >= {T0} AND t < {T1}""")
def series_range_scan(spark, d):
    p = P.select_points(X.metric_points(spark, d), start=_ts(T0), end=_ts(T1))
    return p.select("service", "instance", "metric", seconds(F.col("ts")).alias("ts_s"), "value")


@query("service_series", "SELECT instance, t AS ts_s, value FROM points WHERE service = 'svc-2' AND metric = 'latency_p95'")
def service_series(spark, d):
    p = P.service_series(X.metric_points(spark, d), "svc-2", "latency_p95")
    return p.select("instance", seconds(F.col("ts")).alias("ts_s"), "value")


@query("declared_unit", """
SELECT s.service, s.instance, s.metric, coalesce(nullif(s.unit, ''), c.unit) AS unit, CAST(count(*) AS BIGINT) AS samples
FROM raw_samples s LEFT JOIN cat c USING (metric) GROUP BY ALL""")
def declared_unit(spark, d):
    s = S.with_declared_unit(X.raw_samples(spark, d), X.policy().catalog(spark))
    return s.groupBy("service", "instance", "metric", "unit").agg(F.count("*").alias("samples"))


@query("dataset_manifest", f"""
SELECT dataset_id, CAST(count(DISTINCT (service, instance, metric)) AS BIGINT) AS series, CAST(count(*) AS BIGINT) AS points,
  min(t) AS start_s, max(t) AS end_s FROM {DATASETS} GROUP BY dataset_id""")
def dataset_manifest(spark, d):
    return P.manifest(_datasets(spark, d)).select(
        "dataset_id", "series", "points", seconds(F.col("start_ts")).alias("start_s"), seconds(F.col("end_ts")).alias("end_s"))


@query("dataset_counts", f"""
SELECT dataset_id, CAST(count(*) AS BIGINT) AS points, CAST(count(DISTINCT (service, instance)) AS BIGINT) AS instances
FROM {DATASETS} GROUP BY dataset_id""")
def dataset_counts(spark, d):
    return P.dataset_counts(_datasets(spark, d))


@query("dataset_fingerprint", f"""
SELECT dataset_id, CAST(count(*) AS BIGINT) AS points, min(t) AS start_s, max(t) AS end_s, TRUE AS stable FROM {DATASETS} GROUP BY dataset_id""")
def dataset_fingerprint(spark, d):
    p = _datasets(spark, d)
    # the hashes are engine-specific: show that other values change them, and that rows that stand twice do not cancel
    other = P.fingerprint(p.withColumn("value", F.col("value") + 1)).select("dataset_id", F.col("value_hash").alias("_h"))
    twice = P.fingerprint(p.unionByName(p)).select("dataset_id", F.col("value_sum").alias("_s"))
    return P.fingerprint(p).join(other, "dataset_id").join(twice, "dataset_id").select(
        "dataset_id", "points", seconds(F.col("start_ts")).alias("start_s"), seconds(F.col("end_ts")).alias("end_s"),
        ((F.col("value_hash") != F.col("_h")) & (F.col("_s") == 2 * F.col("value_sum"))).alias("stable"))


@query("store_totals", """
SELECT 'runs' AS item, CAST(count(*) AS BIGINT) AS rows FROM windows
UNION ALL SELECT 'anomalies', CAST(count(*) AS BIGINT) FROM chg UNION ALL SELECT 'points', CAST(count(*) AS BIGINT) FROM points""")
def store_totals(spark, d):
    return P.store_totals(X.windows(spark), X.changes(spark, d), X.metric_points(spark, d))


@query("collection_range", """
SELECT w.run_id, w.we - 336 * 3600 AS from_s, w.we AS to_s, CAST(count(p.value) AS BIGINT) AS points
FROM windows w LEFT JOIN points p ON p.t >= w.we - 336 * 3600 AND p.t < w.we GROUP BY ALL""")
def collection_range(spark, d):
    from pulseframe.operators.windows import assign_windows
    r = P.collection_range(X.policy(), X.windows(spark), 7 * X.DAY)
    n = assign_windows(X.metric_points(spark, d), r, "collect_start", "collect_end").groupBy("run_id").agg(F.count("*").alias("points"))
    return r.join(n, "run_id", "left").select(
        "run_id", seconds(F.col("collect_start")).alias("from_s"), seconds(F.col("collect_end")).alias("to_s"),
        F.coalesce("points", F.lit(0)).alias("points"))


@query("change_events", """
WITH spec AS (SELECT change_id, service, -CAST(k AS BIGINT) * 15 AS m FROM chg JOIN (SELECT event_id, k FROM ev) e ON concat('CHG-', e.event_id) = change_id)
SELECT w.run_id, s.change_id, s.service, w.we + s.m * 60 AS ts_s FROM spec s, windows w""")
def change_events(spark, d):
    spec = X.events(spark, d).where("event_type = 'signup'").select(
        F.concat(F.lit("CHG-"), "event_id").alias("change_id"), "service", (F.col("k") * -15.0).alias("minutes_before_end"))
    return C.change_events(spec, X.windows(spark)).select("run_id", "change_id", "service", seconds(F.col("ts")).alias("ts_s"))


@query("changes_visible", """
SELECT w.run_id, c.change_id, c.service, c.t AS ts_s FROM windows w JOIN chg c
  ON c.t >= w.we - 86400 AND c.t < w.we AND (c.scenario_id IS NULL OR c.scenario_id = w.scenario_id)""")
def changes_visible(spark, d):
    return C.visible_per_run(X.changes(spark, d), X.windows(spark)).select(
        "run_id", "change_id", "service", seconds(F.col("ts")).alias("ts_s"))


@query("changes_in_scenario", f"""
SELECT change_id, service, t AS ts_s FROM chg WHERE (scenario_id IS NULL OR scenario_id = 'A') AND t >= {T0} AND t < {T1}""")
def changes_in_scenario(spark, d):
    return C.visible(X.changes(spark, d), "A", _ts(T0), _ts(T1)).select("change_id", "service", seconds(F.col("ts")).alias("ts_s"))


@query("duration_text", """
WITH g AS (SELECT DISTINCT CAST(round(value * k, 2) AS DOUBLE) AS minutes FROM ev)
SELECT minutes, CASE WHEN minutes < 1 THEN concat(CAST(floor(minutes * 60) AS BIGINT), 's')
  WHEN minutes < 60 THEN printf('%.0fmin', round(minutes, 0)) WHEN minutes < 1440 THEN printf('%.1fh', round(minutes / 60, 1))
  ELSE printf('%.1fd', round(minutes / 1440, 1)) END AS text FROM g""")
def duration_text_q(spark, d):
    g = X.events(spark, d).select(F.round(F.col("value") * F.col("k"), 2).alias("minutes")).distinct()
    return g.select("minutes", duration_text("minutes").alias("text"))


@query("hour_of_week", """
SELECT CAST((isodow(make_timestamp(t * 1000000)) - 1) * 24 + hour(make_timestamp(t * 1000000)) AS INT) AS slot,
  CAST(count(*) AS BIGINT) AS events FROM ev GROUP BY ALL""")
def hour_of_week_q(spark, d):
    return X.events(spark, d).groupBy(hour_of_week(F.col("ts")).alias("slot")).agg(F.count("*").alias("events"))


@query("run_id_text", """
SELECT event_id, concat('run-', strftime(make_timestamp((t + 8 * 3600) * 1000000), '%Y%m%d-%H%M%S'),
  CASE WHEN event_id % 2 = 0 THEN concat('-', event_type) ELSE '' END) AS run_id FROM ev""")
def run_id_text_q(spark, d):
    scen = F.when(F.col("event_id") % 2 == 0, F.col("event_type"))
    return X.events(spark, d).select("event_id", run_id_text(F.col("ts"), scen, "Asia/Shanghai").alias("run_id"))


# ------------------------------------------------------------------ tables that are written, rewritten and read back
@query("replace_dataset", f"""
SELECT dataset_id, CAST(count(*) AS BIGINT) AS points, min(t) AS start_s, max(t) AS end_s, rnd(sum(value), 3) AS total
FROM {DATASETS} WHERE dataset_id = 'wide' OR t < {T1} GROUP BY dataset_id""")
def replace_dataset(spark, d):
    """The second write of one dataset has fewer dates than the first."""
    path, p = fresh_path(spark, "replaced"), _datasets(spark, d)
    P.write_points(p, path)
    P.write_points(p.where((F.col("dataset_id") == "sparse") & (F.col("ts") < _ts(T1))), path)
    return P.read_points(spark, path).groupBy("dataset_id").agg(
        F.count("*").alias("points"), seconds(F.min("ts")).alias("start_s"), seconds(F.max("ts")).alias("end_s"), rnd(F.sum("value"), 3).alias("total"))


@query("write_if_changed", f"""
SELECT dataset_id, dataset_id = 'sparse' AS written, rnd(sum(value + CASE WHEN dataset_id = 'sparse' THEN 1 ELSE 0 END), 3) AS total
FROM {DATASETS} GROUP BY dataset_id""")
def write_if_changed(spark, d):
    """Of two stored datasets one comes again with other values: only that one is written."""
    path, p = fresh_path(spark, "if-changed"), _datasets(spark, d)
    P.write_points_if_changed(p, path, exists=False)
    again = p.withColumn("value", F.col("value") + F.when(F.col("dataset_id") == "sparse", 1.0).otherwise(0.0))
    written = P.write_points_if_changed(again, path, exists=True).withColumn("_w", F.lit(True))
    total = P.read_points(spark, path).groupBy("dataset_id").agg(rnd(F.sum("value"), 3).alias("total"))
    return total.join(written, "dataset_id", "left").select("dataset_id", F.coalesce("_w", F.lit(False)).alias("written"), "total")


@query("replace_run_outputs", """
SELECT w.run_id, c.change_id FROM windows w JOIN chg c
  ON c.t >= w.we - 86400 AND c.t < w.we AND (c.scenario_id IS NULL OR c.scenario_id = w.scenario_id) WHERE w.run_id <> 'run-3'""")
def replace_run_outputs(spark, d):
    """A rerun of one run finds nothing: its earlier rows go, the other runs stay."""
    path = fresh_path(spark, "run-outputs")
    rows = C.visible_per_run(X.changes(spark, d), X.windows(spark)).select("run_id", "change_id")
    sinks.write_run_outputs(rows, path)
    sinks.write_run_outputs(rows.limit(0), path, X.windows(spark).where("run_id = 'run-3'"))
    return spark.read.parquet(path).select("run_id", "change_id")


@query("window_scan", """
SELECT strftime(make_timestamp(t // 86400 * 86400::BIGINT * 1000000), '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS points FROM points
WHERE t >= (SELECT min(ws) FROM windows WHERE run_id IN ('run-1', 'run-4')) AND t < (SELECT max(we) FROM windows WHERE run_id IN ('run-1', 'run-4'))
  AND EXISTS (SELECT 1 FROM windows w WHERE run_id IN ('run-1', 'run-4') AND t // 86400 >= ws // 86400 AND t // 86400 <= we // 86400) GROUP BY 1""")
def window_scan(spark, d):
    """Points stored by day, read for the first and the last window only."""
    path = fresh_path(spark, "stored")
    X.metric_points(spark, d).withColumn("date", F.to_date("ts")).write.partitionBy("date").parquet(path)
    w = X.windows(spark).where("run_id IN ('run-1', 'run-4')")
    p = P.scan_windows(spark.read.parquet(path), w, F.col("window_start"), F.col("window_end"))
    return p.groupBy(F.date_format("date", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("points"))


@query("distinct_sketch", """
SELECT event_type, CAST(count(DISTINCT user_id) AS BIGINT) AS exact, CAST(count(*) AS BIGINT) AS points, TRUE AS within FROM events
WHERE CAST(ts AS DATE) < (SELECT max(CAST(ts AS DATE)) FROM events) GROUP BY event_type""")
def distinct_sketch(spark, d):
    """Users per event type over all days but the last, from stored day sketches, beside the exact number."""
    e = X.load(spark, d, "events").withColumn("date", F.to_date("ts"))
    path = fresh_path(spark, "sketches")
    P.day_sketches(e, F.col("user_id"), ("date", "event_type")).write.parquet(path)
    last = e.agg(F.max("date")).first()[0]
    s = P.distinct_of(spark.read.parquet(path).where(F.col("date") < F.lit(last)), ("event_type",))
    exact = e.where(F.col("date") < F.lit(last)).groupBy("event_type").agg(F.countDistinct("user_id").alias("exact"))
    return s.join(exact, "event_type").select("event_type", "exact", "points", (F.abs(F.col("about") - F.col("exact")) <= 0.02 * F.col("exact")).alias("within"))


@query("alert_files", f"""
SELECT service AS run_id, concat(metric, ' ', CAST(count(*) AS BIGINT)) AS text FROM points WHERE metric = 'qps' AND service <> 'svc-0' GROUP BY service, metric
UNION ALL SELECT service, concat(metric, ' ', CAST(count(*) AS BIGINT)) FROM points WHERE metric = 'cpu_usage' AND service = 'svc-4' GROUP BY service, metric""")
def alert_files(spark, d):
    """Alerts of every service, written again for two of them: one has another alert, the other none any more."""
    n = X.metric_points(spark, d).where("metric IN ('qps', 'cpu_usage')").groupBy("service", "metric").agg(F.count("*").alias("n"))
    a = n.select(F.col("service").alias("run_id"), F.concat_ws(" ", "metric", F.col("n").cast("string")).alias("text"))
    path = fresh_path(spark, "alerts")
    sinks.write_alerts(a.where("text LIKE 'qps%'"), path)
    again = a.where("run_id = 'svc-4'")
    sinks.write_alerts(again, path, a.where("run_id IN ('svc-0', 'svc-4')").select("run_id"))
    return spark.read.schema("text string, run_id string").json(path).select("run_id", "text")
