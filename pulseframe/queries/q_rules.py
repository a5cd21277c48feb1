"""The sixteen rules."""

from pyspark.sql import functions as F

from pulseframe.functions import seconds
from pulseframe.operators import rules as R
from pulseframe.operators.windows import assign_windows
from pulseframe.queries import fixtures as X
from pulseframe.queries.q_facts import _SCORE, _amp_value, inputs
from pulseframe.queries.q_stats import RK
from pulseframe.queries.registry import query, rnd, view

POL = X.policy()
COLS = "run_id, rule_id, service, instance, metric, level, observed, baseline_value, deviation_pct, z_score, amplitude, duration_min, first_seen, last_seen, mode, confidence, instance_count, criticality"


def _case(rule, facts):
    """SQL CASE over a rule's levels; signed keys by size."""
    out = []
    for lv in rule.levels:
        conds = []
        for k, t in lv.when.items():
            v = facts[k]
            if k in ("deviation_pct", "slope_pct_per_hour"):
                v = f"abs({v})"
            conds.append(f"{v} >= {float(t)!r}")
        out.append(f"WHEN {' AND '.join(conds)} THEN {lv.level}")
    return "CASE " + " ".join(out) + " END"


# ------------------------------------------------------------------ long tail
_r4 = POL.rule("PERF-04")
_lo1, _hi1 = _r4.bounds("ratio")
_lo2, _hi2 = _r4.bounds("ratio_rise_pct")
view("perf04", f"""
SELECT run_id, 'PERF-04' AS rule_id, service, instance, 'latency_p99' AS metric, {_case(_r4, {"ratio": "observed", "ratio_rise_pct": "deviation_pct"})} AS level,
  observed, baseline_value, deviation_pct, 0.0::DOUBLE AS z_score,
  round(greatest({_amp_value('observed', _lo1, _hi1)}, {_amp_value('abs(deviation_pct)', _lo2, _hi2)}), 4) AS amplitude,
  window_min AS duration_min, first_seen, last_seen, mode, confidence, instance_count, criticality
FROM (SELECT *, (observed - baseline_value) / baseline_value * 100 AS deviation_pct FROM (
  SELECT a.run_id, a.service, a.instance, max(x.value / y.value) AS observed, any_value(a.median / b.median) AS baseline_value,
    min(x.t) AS first_seen, max(x.t) AS last_seen, any_value(a.window_min) AS window_min, any_value(a.mode) AS mode,
    any_value(CASE WHEN a.sample_size >= 200 THEN 'high' WHEN a.sample_size >= 60 THEN 'medium' ELSE 'low' END) AS confidence,
    any_value(a.instance_count) AS instance_count, any_value(a.criticality) AS criticality
  FROM facts0 a JOIN facts0 b ON a.run_id = b.run_id AND a.instance = b.instance AND a.metric = 'latency_p99' AND b.metric = 'latency_p50'
  JOIN wp x ON x.run_id = a.run_id AND x.instance = a.instance AND x.metric = 'latency_p99'
  JOIN wp y ON y.run_id = a.run_id AND y.instance = a.instance AND y.metric = 'latency_p50' AND y.t = x.t AND y.value > 0
  WHERE a.n >= 3 AND b.n >= 3 AND a.mode = 'dynamic' AND b.mode = 'dynamic' AND b.median > 0 GROUP BY ALL)) WHERE level IS NOT NULL""")


# ------------------------------------------------------------------ trends
def _trend_views(rule_id, name):
    r = POL.rule(rule_id)
    p = r.params
    m = p["metric"]
    hours = p.get("lookback_hours")
    start = "w.ws" if hours is None else f"w.we - {int(hours * 3600)}"
    dur = "(we - ws) / CAST(60 AS DOUBLE)" if hours is None else f"CAST({hours * 60} AS DOUBLE)"
    lo, hi = r.bounds("slope_pct_per_hour")
    view(f"{name}_t", f"""
SELECT *, CASE WHEN sse = 0 THEN CASE WHEN slope = 0 THEN 0 ELSE 'inf'::DOUBLE END ELSE slope / sqrt(sse / (n - 2) / sxx) END AS t_stat,
  CASE WHEN syy = 0 THEN 0 ELSE greatest(0, 1 - sse / syy) END AS r2, CASE WHEN median = 0 THEN 0 ELSE slope * 60 / abs(median) * 100 END AS slope_pct
FROM (SELECT *, sxy / sxx AS slope, greatest(0, syy - sxy * sxy / sxx) AS sse FROM (
  SELECT run_id, service, instance, metric, any_value(ws) AS ws, any_value(we) AS we, count(*) AS n, sum((x - mx) * (x - mx)) AS sxx,
    sum((value - my) * (value - my)) AS syy, sum((x - mx) * (value - my)) AS sxy, quantile_cont(value, 0.5) AS median,
    arg_max(value, t) AS observed, min(t) AS first_seen, max(t) AS last_seen
  FROM (SELECT *, (t - ws) / CAST(60 AS DOUBLE) AS x, avg((t - ws) / CAST(60 AS DOUBLE)) OVER k AS mx, avg(value) OVER k AS my
        FROM (SELECT w.run_id, w.ws, w.we, p.* FROM points p JOIN windows w ON p.t >= {start} AND p.t < w.we WHERE p.metric = '{m}')
        WINDOW k AS (PARTITION BY {RK})) GROUP BY ALL HAVING count(*) >= {max(3, int(p.get('min_samples', 10)))}))""")
    view(name, f"""
SELECT t.run_id, '{rule_id}' AS rule_id, service, instance, t.metric, {_case(r, {"slope_pct_per_hour": "slope_pct", "value": "observed"})} AS level,
  observed, t.median AS baseline_value, CASE WHEN t.median = 0 THEN 0 ELSE (observed - t.median) / abs(t.median) * 100 END AS deviation_pct,
  0.0::DOUBLE AS z_score, round({_amp_value('abs(slope_pct)', lo, hi)}, 4) AS amplitude, {dur} AS duration_min, first_seen, last_seen,
  coalesce(b.mode, 'static_fallback') AS mode, CASE WHEN b.mode IS NULL OR b.mode <> 'dynamic' THEN 'low' WHEN b.sample_size >= 200 THEN 'high'
    WHEN b.sample_size >= 60 THEN 'medium' ELSE 'low' END AS confidence, i.instance_count, i.criticality
FROM {name}_t t JOIN inst i USING (service, instance) LEFT JOIN base b USING ({RK})
WHERE abs(t_stat) >= {p.get('min_t_stat', 3.0)!r} AND r2 >= {p.get('min_r2', 0.0)!r} AND level IS NOT NULL""")


_trend_views("PERF-05", "perf05")
_trend_views("RES-03", "res03")

# ------------------------------------------------------------------ skew
_r5 = POL.rule("RES-05")
_slo, _shi = _r5.bounds("ratio")
_metrics = ", ".join(f"'{m}'" for m in _r5.params["metrics"])
view("res05", f"""
SELECT run_id, 'RES-05' AS rule_id, service, instance, metric, {_case(_r5, {"ratio": "ratio", "value": "observed"})} AS level, observed, baseline_value,
  (ratio - 1) * 100 AS deviation_pct, 0.0::DOUBLE AS z_score, round({_amp_value('ratio', _slo, _shi)}, 4) AS amplitude, window_min AS duration_min,
  first_t AS first_seen, last_t AS last_seen, mode, confidence, instance_count, criticality
FROM (SELECT *, observed / baseline_value AS ratio FROM (
  SELECT * EXCLUDE (baseline_value), vmax AS observed, quantile_cont(vmax, 0.5) OVER (PARTITION BY run_id, service, metric) AS baseline_value,
    count(*) OVER (PARTITION BY run_id, service, metric) AS k, row_number() OVER (PARTITION BY run_id, service, metric ORDER BY vmax DESC, instance) AS rn,
    CASE WHEN mode <> 'dynamic' THEN 'low' WHEN sample_size >= 200 THEN 'high' WHEN sample_size >= 60 THEN 'medium' ELSE 'low' END AS confidence
  FROM facts0 WHERE metric IN ({_metrics}))
  WHERE rn = 1 AND k >= 2 AND instance_count >= 2 AND baseline_value > 0)
WHERE ratio >= {max(_slo, 1.05)!r} AND level IS NOT NULL""")

# ------------------------------------------------------------------ chains
view("svc_edges", "SELECT service AS src, unnest(depends_on) AS dst FROM svc")
view("walk", """
SELECT service AS head, service AS node, [service] AS path FROM svc
UNION ALL SELECT w.head, e.dst, list_append(w.path, e.dst) FROM walk w JOIN svc_edges e ON e.src = w.node WHERE NOT list_contains(w.path, e.dst)""")
view("leaf_walk", "SELECT head, path, array_to_string(path, ' -> ') AS txt FROM walk WHERE node NOT IN (SELECT src FROM svc_edges)")
view("svc_level", """
SELECT run_id, service, t, avg(value) AS value FROM (
  SELECT w.run_id, w.service, w.t, w.value, w.instance, count(DISTINCT w.instance) OVER (PARTITION BY w.run_id, w.service) AS k
  FROM wp w JOIN inst i USING (service, instance) WHERE w.metric = 'success_rate') GROUP BY run_id, service, t, k HAVING count(*) = k""")
_r6 = POL.rule("BIZ-06")
_clo, _chi = _r6.bounds("deviation_pct")
view("chain", """
SELECT run_id, head, arg_min(txt, (observed, txt)) AS txt, min(observed) AS observed, arg_min(baseline_value, (observed, txt)) AS baseline_value,
  arg_min(weakest, (observed, txt)) AS weakest, arg_min(t0, (observed, txt)) AS first_seen, arg_min(t1, (observed, txt)) AS last_seen,
  arg_min(samples, (observed, txt)) AS samples FROM (
  SELECT c.run_id, c.head, c.txt, min(c.h) * 100 AS observed, min(c.t) AS t0, max(c.t) AS t1, count(*) AS samples, any_value(nb.b) AS baseline_value, any_value(nb.weakest) AS weakest
  FROM (SELECT s.run_id, l.head, l.txt, s.t, product(s.value / 100) AS h FROM leaf_walk l, svc_level s
        WHERE list_contains(l.path, s.service) AND len(l.path) >= 2 GROUP BY s.run_id, l.head, l.txt, s.t, len(l.path) HAVING count(*) = len(l.path)) c
  JOIN (SELECT r.run_id, l.head, l.txt, product(coalesce(b.m, 100) / 100) * 100 AS b, arg_min(nm.service, (nm.m, list_position(l.path, nm.service))) AS weakest
        FROM leaf_walk l JOIN (SELECT run_id, service, avg(value) AS m FROM svc_level GROUP BY ALL) nm ON list_contains(l.path, nm.service)
        JOIN windows r ON r.run_id = nm.run_id
        LEFT JOIN (SELECT run_id, service, avg(median) AS m FROM base JOIN inst USING (service, instance) WHERE metric = 'success_rate' GROUP BY ALL) b
          ON b.run_id = nm.run_id AND b.service = nm.service GROUP BY r.run_id, l.head, l.txt) nb
  ON nb.run_id = c.run_id AND nb.head = c.head AND nb.txt = c.txt GROUP BY c.run_id, c.head, c.txt) GROUP BY run_id, head""")
view("biz06", f"""
SELECT run_id, 'BIZ-06' AS rule_id, head AS service, weakest AS instance, 'success_rate' AS metric, {_case(_r6, {"deviation_pct": "deviation_pct"})} AS level,
  observed, baseline_value, deviation_pct, 0.0::DOUBLE AS z_score, round({_amp_value('abs(deviation_pct)', _clo, _chi)}, 4) AS amplitude, duration_min,
  first_seen, last_seen, 'static_fallback' AS mode, 'low' AS confidence, instance_count, criticality
FROM (SELECT c.*, (observed - baseline_value) / baseline_value * 100 AS deviation_pct, s.instance_count, s.criticality, (w.we - w.ws) / CAST(60 AS DOUBLE) AS duration_min
      FROM chain c JOIN svc s ON s.service = c.head JOIN windows w USING (run_id)) WHERE level IS NOT NULL""")

view("findings0", f"SELECT {COLS} FROM generic_findings " + " ".join(
    f"UNION ALL SELECT {COLS} FROM {v}" for v in ("perf04", "perf05", "res03", "res05", "biz06")))
view("findings", f"""
SELECT f.*, r.dimension, 1.0 / greatest(1, instance_count) AS affected_ratio,
  round(1e-9 + {_SCORE.format(blast='1.0 / greatest(1, instance_count)', crit='criticality')}, 4) AS deviation_score
FROM findings0 f JOIN rules r USING (rule_id)""")

_OUT_SQL = """run_id, service, instance, metric, level, duration_min, mode, confidence, first_seen AS first_s, last_seen AS last_s,
  rnd(observed, 4) AS observed, rnd(baseline_value, 4) AS baseline_value, rnd(deviation_pct, 3) AS deviation_pct, rnd(z_score, 3) AS z_score,
  rnd(amplitude, 3) AS amplitude, deviation_score"""


def out(f, *extra):
    return f.select(
        *extra, "run_id", "service", "instance", "metric", "level", "duration_min", F.col("baseline_mode").alias("mode"),
        F.col("baseline_confidence").alias("confidence"), seconds(F.col("first_seen")).alias("first_s"),
        seconds(F.col("last_seen")).alias("last_s"), rnd("observed").alias("observed"), rnd("baseline_value").alias("baseline_value"),
        rnd("deviation_pct", 3).alias("deviation_pct"), rnd("z_score", 3).alias("z_score"), rnd("amplitude", 3).alias("amplitude"),
        "deviation_score")


def _register(rule):
    key = "rule_" + rule.rule_id.lower().replace("-", "")

    @query(key, f"SELECT {_OUT_SQL} FROM findings WHERE rule_id = '{rule.rule_id}'")
    def q(spark, d):
        i = inputs(spark, d)
        return out(R.findings(i, rule.rule_id))
    return q


for _rule in POL.rules:
    _register(_rule)


@query("service_level_series", "SELECT run_id, service, t AS ts_s, rnd(value, 4) AS value FROM svc_level")
def service_level_series(spark, d):
    p = X.policy()
    declared = p.service_dim(spark).select("service", F.explode("instances").alias("instance"))
    pts = assign_windows(X.metric_points(spark, d).where("metric = 'success_rate'").join(declared, ["service", "instance"], "left_semi"),
                         X.windows(spark).select("run_id", "window_start", "window_end"))
    return R.service_level(pts).select("run_id", "service", seconds(F.col("ts")).alias("ts_s"), rnd("value").alias("value"))


@query("chain_health", "SELECT run_id, head, txt AS path, weakest, CAST(samples AS BIGINT) AS samples, rnd(observed, 4) AS observed, rnd(baseline_value, 4) AS baseline_value FROM chain")
def chain_health(spark, d):
    c = R.chain_health(inputs(spark, d), "success_rate", 2)
    return c.select("run_id", "head", F.col("path_text").alias("path"), "weakest", "samples", rnd("observed").alias("observed"),
                    rnd("baseline_value").alias("baseline_value"))


@query("saturation_forecast", """
SELECT run_id, service, instance, rnd(observed, 4) AS observed, rnd(CASE WHEN slope_pct > 0 AND observed < 95 AND observed <> 0 AND h > 0 AND h <= 240 THEN h END, 3) AS hours
FROM (SELECT *, (95 - observed) / nullif(observed * slope_pct / 100, 0) AS h FROM res03_t)""")
def saturation_forecast(spark, d):
    p = X.policy().rule("RES-03").params
    t = R.trend_series(X.metric_points(spark, d), X.windows(spark), p["metric"], p["lookback_hours"] * 60.0).where(F.col("n") >= p["min_samples"])
    return t.select("run_id", "service", "instance", rnd("observed").alias("observed"),
                    rnd(R.forecast_hours(F.col("observed"), F.col("slope_pct")), 3).alias("hours"))


def findings(spark, d):
    """All rules from one staged copy of the clean points."""
    return inspection(spark, d).findings


def inspection(spark, d):
    from pulseframe.plans.inspect import inspect
    p = X.metric_points(spark, d)
    return inspect(p, p, X.windows(spark), X.policy())


@query("all_findings", f"SELECT rule_id, dimension, {_OUT_SQL} FROM findings")
def all_findings(spark, d):
    return out(findings(spark, d), "rule_id", "dimension")


@query("rule_hits", """
SELECT w.run_id, r.rule_id, CAST(count(f.level) AS BIGINT) AS hits FROM windows w CROSS JOIN rules r
LEFT JOIN findings f ON f.run_id = w.run_id AND f.rule_id = r.rule_id GROUP BY ALL""")
def rule_hits(spark, d):
    return R.rule_hits(findings(spark, d), X.windows(spark), X.policy())
