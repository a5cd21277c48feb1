"""Files in, tables out, and streams over several micro-batches."""

import json

import numpy as np

from pyspark.sql import functions as F

from pulseframe.schemas import KEY, METRIC_POINTS
from pulseframe.sources import points as P
from pulseframe.sources import series_files as SF
from pulseframe.sources import sinks
from pulseframe.streaming import operators as ST
from tests.helpers import END, points, rows


def test_series_file_round_trip(spark, tmp_path):
    doc = {"dataset_id": "d1", "scenario_id": "S0", "scenario_name": "x", "step_seconds": 60, "start_epoch": 600, "end_epoch": 840,
           "generated_at": "", "expected_root_cause": "none", "series": [
               {"service": "a", "instance": "a-0", "metric": "qps", "unit": "", "start_epoch": 600, "step_seconds": 60, "values": [1.0, None, 3.0, 4.0]}]}
    (tmp_path / "d1.json").write_text(json.dumps(doc, indent=1))
    s = SF.read_series_files(spark, str(tmp_path))
    p = SF.explode_series(s)
    assert [(r.ts.timestamp(), r.value) for r in p.orderBy("ts").collect()] == [(600, 1.0), (720, 3.0), (780, 4.0)]
    cut = SF.explode_series(s, F.timestamp_seconds(F.lit(700)), F.timestamp_seconds(F.lit(780)))
    assert [r.value for r in cut.collect()] == [3.0]
    off = SF.explode_series(s, F.timestamp_seconds(F.lit(661)), F.timestamp_seconds(F.lit(750)))
    assert [r.value for r in off.collect()] == [3.0]
    assert SF.compact_series(p, 60).first()["values"] == [1.0, None, 3.0, 4.0]
    early = SF.slice_series(s, F.timestamp_seconds(F.lit(0)), F.timestamp_seconds(F.lit(100))).first()
    assert early["values"] == [] and early.start_epoch == 600


def test_a_large_series_file_is_read_by_many_tasks(spark, tmp_path):
    """Every layout gives what reading whole files gives: braces in names, nested objects, the header behind, no series."""
    def one(i, **more):
        return {"service": f"s{i}", "instance": f"s{i}-0", "metric": "qps", "unit": "", "start_epoch": 600, "step_seconds": 60,
                "values": [float(i), None, 0.5]} | more
    docs = {"large": {"dataset_id": "large", "scenario_id": "S0", "series": [one(i) for i in range(500)]},
            "behind": {"series": [one(1), one(2, unit=None)], "scenario_id": "S1", "dataset_id": "behind"},
            "single": {"dataset_id": "single", "series": [one(1)]}, "none": {"dataset_id": "none", "series": []},
            "braces": {"dataset_id": "braces", "series": [one(1, service="a},{b"), one(2, service='"{'), one(3, instance="}")]},
            "nested": {"dataset_id": "nested", "series": [one(1, labels={"values": "x"}), one(2), one(3, labels={})]},
            "nested-last": {"dataset_id": "n2", "series": [{**one(1), "more": {"service": "wrong"}}]},
            "meta": {"meta": {"dataset_id": "wrong"}, "dataset_id": "meta", "series": [one(1)]}}
    for i, (name, doc) in enumerate(docs.items()):
        (tmp_path / f"{name} {i}.json").write_text(json.dumps(doc, indent=i % 3 or None))
    key = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = sorted(map(repr, SF.read_series_files(spark, str(tmp_path)).collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = SF.read_series_records(spark, str(tmp_path))
        assert sorted(map(repr, got.collect())) == want and len(want) == 500 + 2 + 1 + 3 + 3 + 1 + 1
        large = spark.read.option("lineSep", "}").text(str(tmp_path / "large 0.json"))
        assert large.rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", key)
    assert SF.read_series_records(spark, str(tmp_path / "none*")).count() == 0


def test_points_table_is_replaced_per_dataset_and_prunes(spark, tmp_path):
    path = str(tmp_path / "points")
    a = points(spark, rows("qps", [1.0] * 10)).withColumn("dataset_id", F.lit("a"))
    b = points(spark, rows("qps", [2.0] * 5)).withColumn("dataset_id", F.lit("b"))
    P.write_points(a.unionByName(b), path)
    later = b.withColumn("ts", F.col("ts") + F.expr("INTERVAL 3 DAYS"))
    P.write_points(b.unionByName(later), path)
    P.write_points(b.limit(3), path)  # fewer dates than before
    counts = {r.dataset_id: r.points for r in P.manifest(spark.read.parquet(path)).collect()}
    assert counts == {"a": 10, "b": 3}
    plan = P.read_points(spark, path, datasets=["a"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "dataset_id" in plan.split("PartitionFilters")[1][:80]


def test_a_rerun_without_rows_leaves_none(spark, tmp_path):
    path = str(tmp_path / "runs")
    df = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, x int")
    sinks.write_run_outputs(df, path)
    sinks.write_run_outputs(df.limit(0), path, df.where("run_id = 'r1'"))
    assert [r.run_id for r in spark.read.parquet(path).collect()] == ["r2"]


def test_doubled_rows_do_not_cancel_in_the_fingerprint(spark):
    a = points(spark, rows("qps", [1.0, 2.0])).withColumn("dataset_id", F.lit("a"))
    b = points(spark, rows("qps", [5.0, 7.0])).withColumn("dataset_id", F.lit("a"))
    assert P.changed_datasets(a.unionByName(a), b.unionByName(b)).count() == 1


def test_an_upsert_keeps_other_series(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def go():
        s = spark.readStream.schema(METRIC_POINTS).parquet(src)
        return ST.upsert_available(s.withColumn("part", F.lit("p")), out, "part", [*KEY, "ts"])

    _land(points(spark, rows("qps", [1.0], end=END)), src)
    go()
    _land(points(spark, rows("cpu_usage", [2.0], end=END)), src)
    assert {r.metric for r in go().collect()} == {"qps", "cpu_usage"}


def test_write_if_changed_sees_values(spark, tmp_path):
    path = str(tmp_path / "points")
    a = points(spark, rows("qps", [1.0, 2.0, 3.0])).withColumn("dataset_id", F.lit("a"))
    assert P.write_points_if_changed(a, path, exists=False).count() == 1
    assert P.write_points_if_changed(a, path, exists=True).count() == 0
    same_shape = a.withColumn("value", F.when(F.col("value") == 2.0, 5.0).otherwise(F.col("value")))
    assert P.write_points_if_changed(same_shape, path, exists=True).count() == 1
    assert sorted(r.value for r in spark.read.parquet(path).collect()) == [1.0, 3.0, 5.0]


def test_alert_sink(spark, tmp_path):
    a = spark.createDataFrame([("r1", "t", "x"), ("r2", "t", "y")], "run_id string, title string, text string")
    sinks.write_alerts(a, str(tmp_path / "alerts"))
    sinks.write_alerts(a.where("run_id = 'r2'").withColumn("text", F.lit("z")), str(tmp_path / "alerts"))
    assert {(r.run_id, r.text) for r in spark.read.json(str(tmp_path / "alerts")).collect()} == {("r1", "x"), ("r2", "z")}


def _land(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def test_breach_runs_carry_over_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = points(spark, rows("cpu_usage", [1, 9, 9], end=END))
    second = points(spark, rows("cpu_usage", [9, 9, 1, 9], end=END + 240))

    def go():
        s = spark.readStream.schema(METRIC_POINTS).parquet(src)
        df = ST.breach_runs(s, F.col("value") > 5).withColumn("part", F.col("metric"))
        return ST.upsert_available(df, out, "part", KEY).first()

    _land(first, src)
    assert go().longest == 2
    _land(second, src)
    r = go()  # restarts from the stored state
    assert (r.samples, r.longest, r.run_start.timestamp()) == (7, 4, END - 120)


def test_a_late_sample_takes_its_own_place_in_a_run(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def go(**options):
        s = spark.readStream.schema(METRIC_POINTS).parquet(src)
        df = ST.breach_runs(s, F.col("value") > 5, "5 minutes", **options).withColumn("part", F.col("metric"))
        return ST.upsert_available(df, out, "part", KEY).first()

    _land(points(spark, rows("cpu_usage", [9], end=END - 120), rows("cpu_usage", [9], end=END)), src)
    assert go().longest == 2
    _land(points(spark, rows("cpu_usage", [1], end=END - 60)), src)  # calm, between the two
    assert (go().samples, go().longest) == (3, 1)


def test_an_idle_series_leaves_the_state(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def go():
        s = spark.readStream.schema(METRIC_POINTS).parquet(src)
        return {r.metric: r for r in ST.upsert_available(
            ST.breach_runs(s, F.col("value") > 5, "1 minute", 1).withColumn("part", F.col("metric")), out, "part", KEY).collect()}

    _land(points(spark, rows("cpu_usage", [9, 9], end=END)), src)
    assert go()["cpu_usage"].longest == 2
    _land(points(spark, rows("qps", [9], end=END + 4 * 3600)), src)
    go()
    _land(points(spark, rows("cpu_usage", [9], end=END + 4 * 3600 + 60)), src)
    assert (go()["cpu_usage"].samples, go()["cpu_usage"].longest) == (1, 1)


def test_runs_over_parts_equal_runs_over_all():
    rng = np.random.default_rng(4)
    for _ in range(200):
        hit = rng.random(30) < 0.7
        ts = np.arange(30) * 60
        whole = ST.longest_breach((0, 0, 0, 0, 0), ts, hit)
        cut = int(rng.integers(0, 31))
        assert ST.longest_breach(ST.longest_breach((0, 0, 0, 0, 0), ts[:cut], hit[:cut]), ts[cut:], hit[cut:]) == whole
        best, cur = (0, 0), 0
        for t, h in zip(ts, hit):
            cur = cur + 1 if h else 0
            if cur > best[0]:
                best = (cur, t - (cur - 1) * 60)
        assert (whole[0], whole[3], whole[4]) == (30, *best)


def test_the_end_mark_closes_all_windows_in_the_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    pts = points(spark, rows("qps", [1.0, 2.0, 3.0, 4.0], end=END))
    _land(pts, src)
    ST.land_end(pts, src, "1 hour")
    stream = spark.readStream.schema(METRIC_POINTS).option("maxFilesPerTrigger", 1).parquet(src)
    got = ST.run_available(ST.merge_buckets(stream, 60, "2 minutes"), str(tmp_path / "out"))
    assert got.count() == 4 and got.where("service IS NULL").count() == 0


def test_late_samples_within_the_watermark_count(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def go():
        return ST.run_available(ST.merge_buckets(spark.readStream.schema(METRIC_POINTS).parquet(src), 60, "2 minutes"), out)

    base = END - END % 60
    _land(points(spark, rows("qps", [10.0], end=base + 60), rows("qps", [1.0], end=base + 180)), src)
    assert go().count() == 0
    _land(points(spark, rows("qps", [20.0], end=base + 70, step=60)), src)  # late, but inside the bound
    _land(points(spark, rows("qps", [1.0], end=base + 600)), src)
    got = {int(r.ts.timestamp()): r.value for r in go().collect()}
    assert got[base] == 15.0


def test_same_windows_many_or_one_at_a_time(spark):
    from pulseframe.plans.inspect import inspect
    from pulseframe.queries import fixtures as X
    d = "/root/testdata/sf0.001"
    pts = X.metric_points(spark, d)
    cols = ["run_id", "anomaly_id", "level", "deviation_score", "is_suppressed"]
    w = X.windows(spark)
    both = inspect(pts, pts, w.where("run_id IN ('run-2', 'run-3')"), X.policy()).anomalies.select(cols).collect()
    one = []
    for r in ("run-2", "run-3"):
        one += inspect(pts.repartition(5, "value"), pts, w.where(F.col("run_id") == r), X.policy()).anomalies.select(cols).collect()
    assert sorted(map(tuple, both)) == sorted(map(tuple, one)) and both
