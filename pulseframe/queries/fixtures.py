"""Metric points, windows, dirty samples, changes and graphs derived from the driver's tables.

Every frame is an aggregate or projection of a whole table, so it grows with it. The SQL
twins of the same derivations are registered as views at the bottom.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.functions import bucket
from pulseframe.policy import METRICS, SLO_FIELD, UNIT_FACTORS, Level, Policy, Rule, Service, POINTWISE, _f, RULES, SCORE_RULES
from pulseframe.queries.registry import values_sql, view
from pulseframe.session import literal_table

G = 21_600  # six-hour buckets
STEP = 360  # the same in minutes
DAY0 = 1_704_067_200  # 2024-01-01, where the event table starts
DAY = 86_400


def _rule(rule_id: str, params: dict, *levels: tuple[int, dict]) -> Rule:
    shipped = next(r for r in RULES if r.rule_id == rule_id)
    texts = {lv.level: lv.reason for lv in shipped.levels}
    return Rule(rule_id, shipped.name, shipped.dimension, shipped.kind, {**shipped.params, **params},
                [Level(lv, when, texts.get(lv, "")) for lv, when in levels])


def policy() -> Policy:
    """A policy in the scale of the fixture: buckets of six hours, windows of a week."""
    base = Policy(
        services=[
            Service("svc-0", ["svc-0-0", "svc-0-1"], ["svc-1", "svc-2"], "front", "entry", criticality=1.0, owner="team-a",
                    slo={"latency_p99_ms": 380.5, "latency_p95_ms": 210.5}),
            Service("svc-1", ["svc-1-0", "svc-1-1"], ["svc-3"], "front", "core", criticality=0.9, owner="team-a"),
            Service("svc-2", ["svc-2-0", "svc-2-1"], ["svc-3"], "back", "core", criticality=0.8, owner="team-b",
                    slo={"success_rate": 77.3}),
            Service("svc-3", ["svc-3-0", "svc-3-1"], ["svc-4"], "back", "core", criticality=0.6),
            # svc-4-1 reports but is not declared
            Service("svc-4", ["svc-4-0"], [], "default", "external", True, 0.5),
        ],
        thresholds={
            "success_rate": {"min": 75.1}, "business_error_rate": {"max": 9.7}, "latency_p95": {"max": 190.3},
            "latency_p99": {"max": 300.7}, "cpu_usage": {"max": 61.3}, "mem_usage": {"max": 47.3}, "conn_usage": {"max": 99.1},
        },
        threshold_overrides={
            "svc-0": {"latency_p99": {"max": 260.3}, "latency_p95": {"max": 150.7}},
            "svc-3": {"latency_p99": {"max": 330.1}},
            "svc-4": {"conn_usage": {"max": 95.7}, "cpu_usage": {"max": 64.9}},
        },
        slo={"success_rate": 78.7, "latency_p99_ms": 300.7, "latency_p95_ms": 180.5, "business_error_rate": 8.3},
        granularity_seconds=G,
    )
    d = STEP
    return base.with_rules(
        _rule("BIZ-01", {}, (1, {"drop_points": 38.3, "duration_minutes": 2 * d}), (2, {"drop_points": 35.3, "duration_minutes": d}),
              (3, {"drop_points": 17.7}), (4, {"below_slo": True, "duration_minutes": 2 * d})),
        _rule("BIZ-02", {}, (1, {"rise_points": 22.3, "duration_minutes": 2 * d}), (2, {"rise_points": 20.3}),
              (3, {"rise_points": 9.1}), (4, {"rise_points": 3.3})),
        _rule("BIZ-03", {}, (1, {"multiplier": 2.43, "duration_minutes": d}), (2, {"multiplier": 2.03}),
              (3, {"multiplier": 1.83}), (4, {"z_score": 2.03})),
        _rule("BIZ-04", {}, (1, {"down_pct": 75.3, "duration_minutes": d}), (2, {"down_pct": 62.3}),
              (3, {"down_pct": 50.3}), (4, {"z_score": 1.53})),
        _rule("BIZ-05", {}, (1, {"multiplier": 3.97, "min_absolute": 6.0}), (2, {"multiplier": 3.47, "min_absolute": 5.0}),
              (3, {"multiplier": 2.97, "min_absolute": 4.0}), (4, {"multiplier": 1.47, "min_absolute": 2.0})),
        _rule("BIZ-06", {}, (1, {"deviation_pct": 80.3}), (2, {"deviation_pct": 70.3}), (3, {"deviation_pct": 50.3}),
              (4, {"deviation_pct": 5.3})),
        _rule("PERF-01", {}, (1, {"value": 400.7, "duration_minutes": 2 * d}), (2, {"value": 350.7, "duration_minutes": d}),
              (3, {"value": 280.7}), (4, {"value": 230.7})),
        _rule("PERF-02", {}, (1, {"value": 250.7, "duration_minutes": 2 * d}), (2, {"value": 240.7}),
              (3, {"value": 210.7}), (4, {"value": 160.7})),
        _rule("PERF-03", {}, (1, {"cv": 0.6017, "value": 250.3}), (2, {"cv": 0.5003, "value": 250.3}), (3, {"cv": 0.4517}),
              (4, {"cv": 0.1501})),
        _rule("PERF-04", {}, (1, {"ratio": 12.3, "ratio_rise_pct": 210.3}), (2, {"ratio": 9.3, "ratio_rise_pct": 175.3}),
              (3, {"ratio": 6.1, "ratio_rise_pct": 130.3}), (4, {"ratio": 4.9})),
        _rule("PERF-05", {"min_t_stat": 1.203, "min_r2": 0.0303}, (1, {"slope_pct_per_hour": 0.3503}),
              (2, {"slope_pct_per_hour": 0.2503}), (3, {"slope_pct_per_hour": 0.1503}), (4, {"slope_pct_per_hour": 0.0303})),
        _rule("RES-01", {}, (1, {"value": 72.3, "duration_minutes": d}), (2, {"value": 68.3}), (3, {"value": 64.3}),
              (4, {"z_score": 1.03})),
        _rule("RES-02", {}, (1, {"value": 64.3, "duration_minutes": d}), (2, {"value": 58.3}), (3, {"value": 52.3}),
              (4, {"z_score": 1.03})),
        _rule("RES-03", {"lookback_hours": 336, "min_t_stat": 1.203, "min_r2": 0.0203},
              (1, {"slope_pct_per_hour": 0.1903, "value": 25.3}), (2, {"slope_pct_per_hour": 0.1303, "value": 10.3}),
              (3, {"slope_pct_per_hour": 0.0703}), (4, {"slope_pct_per_hour": 0.0203})),
        _rule("RES-04", {}, (1, {"value": 98.3, "duration_minutes": 3 * d}), (2, {"value": 97.3, "duration_minutes": 2 * d}),
              (3, {"value": 98.7}), (4, {"z_score": 0.33})),
        _rule("RES-05", {}, (2, {"ratio": 1.2503, "value": 20.3}), (3, {"ratio": 1.1503}), (4, {"ratio": 1.0703})),
    )


# ------------------------------------------------------------------ frames
def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their zoneless timestamps read as UTC, whatever the session zone is."""
    e = load(spark, sf_dir, "events")
    utc = F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())
    return e.select(
        "event_id", utc.alias("ts"), "event_type", "value",
        F.concat(F.lit("svc-"), F.col("user_id") % 5).alias("service"),
        F.concat(F.lit("svc-"), F.col("user_id") % 5, F.lit("-"), F.expr("(user_id div 5) % 2")).alias("instance"),
        F.get_json_object("props", "$.k").cast("double").alias("k"))


def metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten metrics per instance and bucket from one grouped pass over the events.

    The exact percentiles keep one counter per distinct value (values are cents up to 490, k
    is 0..99) and combine map-side, so a hot bucket ships at most some 49,000 counters per
    task instead of its rows.
    """
    n = F.count("*").cast("double")
    wide = events(spark, sf_dir).groupBy("service", "instance", bucket(F.col("ts"), G).alias("ts")).agg(
        n.alias("qps"),
        F.count_if(F.col("event_type") == "error").cast("double").alias("error_count"),
        (100.0 * (1 - F.count_if(F.col("event_type") == "error") / n)).alias("success_rate"),
        (100.0 * F.count_if(F.col("k") >= 95) / n).alias("business_error_rate"),
        F.percentile("value", F.lit(0.5)).alias("latency_p50"), F.percentile("value", F.lit(0.95)).alias("latency_p95"),
        F.percentile("value", F.lit(0.99)).alias("latency_p99"),
        F.avg("k").alias("cpu_usage"), F.percentile("k", F.lit(0.25)).alias("mem_usage"), F.max("k").alias("conn_usage"))
    ids = ["service", "instance", "ts"]
    return wide.unpivot(ids, list(METRICS), "metric", "value").withColumn("value", F.round("value", 6)).select(
        "service", "instance", "metric", "ts", "value")


def sparse_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean event value per instance, event type and bucket: has short and long gaps."""
    return events(spark, sf_dir).groupBy(
        "service", "instance", F.col("event_type").alias("metric"), bucket(F.col("ts"), G).alias("ts")
    ).agg(F.avg("value").alias("value"))


def raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four raw samples per event, with wrong units, values out of range and NaN among them."""
    e = events(spark, sf_dir)
    unit = (
        F.when(F.col("event_type") == "view", "s").when(F.col("event_type") == "purchase", "us")
        .when(F.col("event_type") == "signup", "fortnight").when(F.col("event_type") == "error", "").otherwise("ms"))
    def sample(metric, value, unit):
        return F.struct(F.lit(metric).alias("metric"), value.alias("value"), unit.alias("unit"))

    k = F.col("k")
    rows = F.array(
        sample("latency_p99", F.col("value"), unit), sample("cpu_usage", k * 1.05, F.lit("%")),
        sample("success_rate", k / 100.0, F.lit("ratio")),
        sample("conn_usage", F.when(k == 13, F.lit(float("nan"))).otherwise(k - 3.0), F.lit(None).cast("string")))
    return e.select("service", "instance", "ts", F.col("event_id").alias("seq"), F.inline(rows))


def windows(spark: SparkSession) -> DataFrame:
    """Four weekly inspections, each with the three weeks before it as its archive."""
    rows = _window_rows()
    df = literal_table(
        spark, [("run_id", "string"), ("scenario_id", "string"), ("ws", "long"), ("we", "long"), ("a0", "long"), ("a1", "long")], rows)
    ts = {"window_start": "ws", "window_end": "we", "archive_start": "a0", "archive_end": "a1"}
    return df.select("run_id", "scenario_id", *[F.timestamp_seconds(c).alias(n) for n, c in ts.items()])


def _window_rows():
    out = []
    for i in range(4):
        ws = DAY0 + (2 + 7 * i) * DAY
        out.append((f"run-{i + 1}", "A" if i % 2 == 0 else "B", ws, ws + 7 * DAY, ws - 21 * DAY, ws))
    return out


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-up events as change events; one in three is a background change, visible to all."""
    e = events(spark, sf_dir).where(F.col("event_type") == "signup")
    scen = F.when(F.col("event_id") % 3 == 0, None).when(F.col("event_id") % 3 == 1, "A").otherwise("B")
    kind = F.when(F.col("k") < 50, "release").otherwise("config")
    return e.select(F.concat(F.lit("CHG-"), "event_id").alias("change_id"), scen.alias("scenario_id"), "ts", "service", kind.alias("type"))


def edges_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dependency tree over all parts: each part depends on the one at half its key."""
    p = load(spark, sf_dir, "part").where("p_partkey > 1")
    return p.select(_node(F.col("p_partkey")).alias("src"), _node(F.expr("p_partkey div 2")).alias("dst"))


def edges_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a second dependency at a third of the key: several paths per pair."""
    p = load(spark, sf_dir, "part").where("p_partkey > 2")
    return edges_big(spark, sf_dir).unionByName(
        p.select(_node(F.col("p_partkey")).alias("src"), _node(F.expr("p_partkey div 3")).alias("dst"))).distinct()


def _node(c):
    return F.concat(F.lit("n"), c.cast("string"))


# ------------------------------------------------------------------ SQL twins
_POL = policy()

view("ev", """
SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_type, value,
  concat('svc-', user_id % 5) AS service, concat('svc-', user_id % 5, '-', (user_id // 5) % 2) AS instance,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
FROM events""")
view("wide", f"""
SELECT service, instance, t // {G} * {G} AS t, CAST(count(*) AS DOUBLE) AS qps,
  CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) AS error_count,
  CAST(100 AS DOUBLE) * (1 - count(*) FILTER (event_type = 'error') / CAST(count(*) AS DOUBLE)) AS success_rate,
  CAST(100 AS DOUBLE) * count(*) FILTER (k >= 95) / CAST(count(*) AS DOUBLE) AS business_error_rate,
  quantile_cont(value, 0.5) AS latency_p50, quantile_cont(value, 0.95) AS latency_p95, quantile_cont(value, 0.99) AS latency_p99,
  avg(k) AS cpu_usage, quantile_cont(k, 0.25) AS mem_usage, max(k) AS conn_usage
FROM ev GROUP BY ALL""")
view("points", """
SELECT service, instance, metric, t, round(value, 6) AS value FROM (
  UNPIVOT wide ON qps, success_rate, error_count, business_error_rate, latency_p50, latency_p95, latency_p99, cpu_usage,
    mem_usage, conn_usage INTO NAME metric VALUE value)""")
view("sparse", f"""
SELECT service, instance, event_type AS metric, t // {G} * {G} AS t, avg(value) AS value
FROM ev GROUP BY ALL""")
view("raw_samples", """
SELECT service, instance, t, event_id AS seq, 'latency_p99' AS metric, value,
  CASE event_type WHEN 'view' THEN 's' WHEN 'purchase' THEN 'us' WHEN 'signup' THEN 'fortnight' WHEN 'error' THEN '' ELSE 'ms' END AS unit
FROM ev
UNION ALL SELECT service, instance, t, event_id, 'cpu_usage', k * CAST(1.05 AS DOUBLE), '%' FROM ev
UNION ALL SELECT service, instance, t, event_id, 'success_rate', k / 100.0, 'ratio' FROM ev
UNION ALL SELECT service, instance, t, event_id, 'conn_usage', CASE WHEN k = 13 THEN 'nan'::DOUBLE ELSE k - 3 END, NULL FROM ev""")
view("cat", values_sql(["metric", "unit", "label", "hib", "lo", "hi"], [(m, *v) for m, v in METRICS.items()],
                       {"lo": "DOUBLE", "hi": "DOUBLE"}))
view("unit_factor", values_sql(["src", "dst", "factor"], UNIT_FACTORS, {"factor": "DOUBLE"}))
view("windows", values_sql(["run_id", "scenario_id", "ws", "we", "a0", "a1"], _window_rows()))
view("svc", values_sql(
    ["service", "grp", "tier", "external", "criticality", "owner", "instances", "depends_on", "instance_count"],
    [(s.name, s.group, s.tier, s.external, s.criticality, s.owner or "unassigned", s.instances, s.depends_on, len(s.instances))
     for s in _POL.services], {"criticality": "DOUBLE", "depends_on": "VARCHAR[]", "instances": "VARCHAR[]"}))
view("inst", "SELECT service, grp, criticality, owner, instance_count, unnest(instances) AS instance FROM svc")
view("thr_default", values_sql(["metric", "dmin", "dmax"], [(m, t.get("min"), t.get("max")) for m, t in _POL.thresholds.items()],
                               {"dmin": "DOUBLE", "dmax": "DOUBLE"}))
view("thr_over", values_sql(
    ["service", "metric", "omin", "omax"],
    [(s, m, t.get("min"), t.get("max")) for s, ms in _POL.threshold_overrides.items() for m, t in ms.items()],
    {"omin": "DOUBLE", "omax": "DOUBLE"}))
view("slo_default", values_sql(["metric", "dslo"], [(m, _POL.slo[f]) for m, f in SLO_FIELD.items()], {"dslo": "DOUBLE"}))
view("slo_over", values_sql(
    ["service", "metric", "oslo"],
    [(s.name, m, s.slo[f]) for s in _POL.services for m, f in SLO_FIELD.items() if f in s.slo], {"oslo": "DOUBLE"}))
view("rules", values_sql(["rule_id", "dimension"], [(r.rule_id, r.dimension) for r in _POL.rules]))
_AMP = [*POINTWISE, "cv"]
_LEVEL_COLS = (["rule_id", "metric", "direction", "min_samples", "level", "t_below_slo", "t_min_absolute", "t_duration"]
               + [f"t_{k}" for k in _AMP] + [f"{s}_{k}" for k in _AMP for s in ("lo", "hi")])
view("rule_levels", values_sql(
    _LEVEL_COLS,
    [(r.rule_id, r.params["metric"], r.params.get("direction"), int(r.params.get("min_samples", 3)), lv.level,
      lv.when.get("below_slo"), _f(lv.when.get("min_absolute")), _f(lv.when.get("duration_minutes", 0)),
      *(_f(lv.when.get(k)) for k in _AMP), *(b for k in _AMP for b in r.bounds(k)))
     for r in _POL.rules if r.kind == "generic" for lv in r.levels],
    {c: "DOUBLE" for c in _LEVEL_COLS if c.startswith(("t_", "lo_", "hi_")) and c != "t_below_slo"}))
view("score_part", values_sql(["rule_id", "part"], [(r, p) for p, rs in SCORE_RULES.items() for r in rs]))
view("chg", """
SELECT concat('CHG-', event_id) AS change_id, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'A' ELSE 'B' END AS scenario_id,
  t, service, CASE WHEN k < 50 THEN 'release' ELSE 'config' END AS type
FROM ev WHERE event_type = 'signup'""")
view("edges_big", """
SELECT concat('n', p_partkey) AS src, concat('n', p_partkey // 2) AS dst FROM part WHERE p_partkey > 1""")
view("edges_dag", """
SELECT * FROM edges_big UNION SELECT concat('n', p_partkey), concat('n', p_partkey // 3) FROM part WHERE p_partkey > 2""")
