"""Streaming operators run to completion over the landed points, compared with batch SQL."""

from pyspark.sql import functions as F

from pulseframe.functions import bucket, seconds
from pulseframe.operators import baseline as B
from pulseframe.queries import fixtures as X
from pulseframe.queries.registry import query, rnd
from pulseframe.schemas import KEY, METRIC_POINTS
from pulseframe.session import write_stage
from pulseframe.streaming import operators as ST

LATE = "6 hours"
GAP = "12 hours 1 second"  # a sample exactly 12 hours later belongs to the session, in streams and batches
BREACH = "metric = 'success_rate' AND value < 78.7"


def landed(spark, d, df=None, beyond=None):
    """Points landed as several Parquet files in the order of time, read as a stream file by file; then the mark of the end."""
    path = ST.fresh_path(spark, "landed")
    df = X.metric_points(spark, d) if df is None else df
    t = df.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(seconds(F.col("a")), seconds(F.col("b"))).first()
    third = F.floor((seconds(F.col("ts")) - t[0]) * 3 / (t[1] - t[0] + 1))
    for i in range(3):
        df.where(third == i).coalesce(1).write.mode("append").parquet(path)
    if beyond:
        ST.land_end(df, path, beyond)
    return spark.readStream.schema(METRIC_POINTS).option("maxFilesPerTrigger", 1).parquet(path)


def samples(spark, d):
    e = X.events(spark, d)
    return e.select("service", "instance", F.col("event_type").alias("metric"), "ts", "value")


def _s(c, a):
    return seconds(F.col(c)).alias(a)


@query("stream_bucket_merge", f"""
SELECT service, instance, event_type AS metric, t // {X.G} * {X.G} AS ts_s, rnd(avg(value), 4) AS value FROM ev GROUP BY ALL""")
def stream_bucket_merge(spark, d):
    stream = landed(spark, d, samples(spark, d), "1 day")
    out = ST.run_available(ST.merge_buckets(stream, X.G, LATE), ST.fresh_path(spark, "merged"))
    return out.select(*KEY, _s("ts", "ts_s"), rnd("value").alias("value"))


@query("stream_sliding", f"""
WITH g AS (SELECT *, unnest([t // 172800 * 172800 - 172800, t // 172800 * 172800]) AS a FROM points)
SELECT service, instance, metric, a AS start_s, CAST(count(*) AS BIGINT) AS n, min(value) AS vmin, max(value) AS vmax, rnd(avg(value), 4) AS mean
FROM g WHERE t >= a AND t < a + 345600 GROUP BY ALL""")
def stream_sliding(spark, d):
    stream = landed(spark, d, beyond="5 days")
    out = ST.run_available(ST.sliding_inspection(stream, "4 days", "2 days", LATE), ST.fresh_path(spark, "sliding"))
    return out.select(
        *KEY, _s("window_start", "start_s"), "n", "vmin", "vmax", rnd("mean").alias("mean"))


@query("stream_dedup", f"SELECT DISTINCT service, instance, event_type AS metric, t // {X.G} * {X.G} AS ts_s FROM ev")
def stream_dedup(spark, d):
    s = ST.drop_duplicates(landed(spark, d, samples(spark, d)), X.G, LATE)
    return ST.run_available(s, ST.fresh_path(spark, "dedup")).select(*KEY, _s("bucket_ts", "ts_s"))


@query("stream_breach_runs", """
WITH p AS (SELECT *, value < 78.7 AS hit, row_number() OVER (PARTITION BY instance ORDER BY t) AS rn FROM points WHERE metric = 'success_rate'),
i AS (SELECT service, instance, metric, count(*) AS n, min(t) AS t0 FROM (SELECT *, rn - row_number() OVER (PARTITION BY instance ORDER BY t) AS isl FROM p WHERE hit) GROUP BY service, instance, metric, isl),
b AS (SELECT service, instance, metric, max(n) AS n, arg_max(t0, (n, -t0)) AS t0 FROM i GROUP BY ALL)
SELECT service, instance, metric, CAST(c.k AS BIGINT) AS samples, CAST(coalesce(b.n, 0) AS BIGINT) AS longest, b.t0 AS start_s
FROM (SELECT service, instance, metric, count(*) AS k FROM p GROUP BY ALL) c LEFT JOIN b USING (service, instance, metric)""")
def stream_breach_runs(spark, d):
    p = landed(spark, d).where("metric = 'success_rate'")
    s = ST.breach_runs(p, F.col("value") < 78.7, LATE).withColumn("part", F.col("metric"))
    out = ST.upsert_available(s, ST.fresh_path(spark, "runs"), "part", KEY)
    return out.select(*KEY, "samples", "longest", _s("run_start", "start_s"))


@query("stream_sessions", f"""
WITH p AS (SELECT *, t - lag(t) OVER (PARTITION BY instance ORDER BY t) AS dt FROM points WHERE {BREACH}),
s AS (SELECT *, sum(CASE WHEN dt IS NULL OR dt > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY instance ORDER BY t) AS sid FROM p)
SELECT service, instance, metric, min(t) AS start_s, max(t) + 43201 AS end_s, CAST(count(*) AS BIGINT) AS samples, min(value) AS vmin
FROM s GROUP BY service, instance, metric, sid""")
def stream_sessions(spark, d):
    stream = landed(spark, d, beyond="1 day")
    out = ST.run_available(ST.breach_sessions(stream, F.expr(BREACH), GAP, LATE), ST.fresh_path(spark, "sessions"))
    return out.select(
        *KEY, _s("session_start", "start_s"), _s("session_end", "end_s"), "samples", "vmin")


@query("stream_baseline_join", """
SELECT service, instance, metric, t AS ts_s, rnd(coalesce((p.value - b.median) / b.scale, 0), 4) AS z
FROM points p LEFT JOIN (SELECT * FROM base WHERE run_id = 'run-4') b USING (service, instance, metric)""")
def stream_baseline_join(spark, d):
    """Static baselines of the last window, sink replaced per day with foreachBatch."""
    pts = X.metric_points(spark, d)
    base = write_stage(B.baselines(pts, X.windows(spark).where("run_id = 'run-4'"), X.policy()), "baselines")
    s = ST.with_baseline(landed(spark, d, pts), base).withColumn("day", F.date_format(bucket(F.col("ts"), 86400), "yyyyMMdd"))
    out = ST.upsert_available(s, ST.fresh_path(spark, "scored"), "day", [*KEY, "ts"])
    return out.select(*KEY, _s("ts", "ts_s"), rnd("z").alias("z"))
