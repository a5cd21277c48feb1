"""Facts, level matching, amplitudes, scores and reason texts."""

from pyspark.sql import functions as F

from pulseframe.functions import seconds
from pulseframe.operators import facts as FA
from pulseframe.operators import levels as L
from pulseframe.operators import stats
from pulseframe.operators.rules import Inputs, finish, generic_hits, rule_facts
from pulseframe.operators import graph as G
from pulseframe.policy import LEVEL_BAND, POINTWISE
from pulseframe.queries import fixtures as X
from pulseframe.operators.baseline import baselines
from pulseframe.operators.windows import assign_windows
from pulseframe.queries import q_baseline  # noqa: F401 - registers the views used below
from pulseframe.queries.q_stats import RK, window_points
from pulseframe.queries.registry import query, rnd, values_sql, view
from pulseframe.schemas import RKEY

view("wser", f"""
SELECT {RK}, any_value(ws) AS ws, any_value(we) AS we, count(*) AS n, min(value) AS vmin, max(value) AS vmax, avg(value) AS wmean,
  round(CASE WHEN avg(value) = 0 THEN 0 ELSE stddev_pop(value) / abs(avg(value)) END, 4) AS cv,
  min(t) AS first_t, max(t) AS last_t, arg_max(value, t) AS latest,
  greatest(1, coalesce(list_sort(list(dt) FILTER (dt > 0))[(count(dt) FILTER (dt > 0) - 1) // 2 + 1] / CAST(60 AS DOUBLE), 1)) AS step_min
FROM (SELECT *, t - lag(t) OVER (PARTITION BY {RK} ORDER BY t) AS dt FROM wp) GROUP BY ALL""")
view("facts0", f"""
SELECT s.*, (we - ws) / CAST(60 AS DOUBLE) AS window_min, coalesce(b.mode, 'static_fallback') AS mode, coalesce(b.sample_size, 0) AS sample_size,
  b.median, b.scale, b.stdev AS bstdev, coalesce(b.hour_median, b.median) AS centre, c.hib, c.unit, c.label, i.criticality, i.instance_count,
  t.red_min, t.red_max, t.default_max, sl.slo,
  CASE WHEN b.mode = 'dynamic' THEN b.median WHEN c.hib THEN t.red_min ELSE t.red_max END AS baseline_value
FROM wser s LEFT JOIN base b USING ({RK}) JOIN cat c USING (metric) JOIN inst i USING (service, instance)
JOIN thr t USING (metric, service) JOIN slo_t sl USING (metric, service)""")


def _observed(src, obs):
    """SQL for everything that depends on the observed value."""
    return f"""
SELECT *, CASE WHEN NOT has OR coalesce(centre, 0) = 0 THEN 0 ELSE (observed - centre) / abs(centre) * 100 END AS deviation_pct,
  CASE WHEN NOT has OR centre IS NULL THEN 0 ELSE coalesce((observed - centre) / coalesce(nullif(scale, 0), nullif(bstdev, 0)), 0) END AS z_score,
  CASE WHEN has THEN greatest(0, baseline_value - observed) ELSE 0 END AS drop_points,
  CASE WHEN has THEN greatest(0, observed - baseline_value) ELSE 0 END AS rise_points,
  CASE WHEN has THEN greatest(0, (baseline_value - observed) / abs(baseline_value) * 100) ELSE 0 END AS down_pct,
  CASE WHEN has THEN observed / baseline_value ELSE 1 END AS multiplier,
  coalesce(CASE WHEN hib THEN red_min ELSE red_max END, 0) AS threshold,
  coalesce(CASE WHEN hib THEN observed < slo ELSE observed > slo END, FALSE) AS below_slo
FROM (SELECT *, {obs} AS observed, coalesce(baseline_value, 0) <> 0 AS has FROM {src})"""


view("facts", _observed("facts0", "CASE WHEN hib THEN vmin ELSE vmax END"))


def inputs(spark, d):
    """Rule inputs over the fixture; only the chain rule writes stages."""
    p = X.policy()
    points = X.metric_points(spark, d)
    w = X.windows(spark)
    windowed = stats.window_series(assign_windows(points, w.select("run_id", "window_start", "window_end")), RKEY)
    return Inputs(windowed, baselines(points, w, p), points, w, None, p)


def _facts(spark, d):
    i = inputs(spark, d)
    return FA.series_facts(i.windowed, i.base, i.policy)


_FACT = ["observed", "baseline_value", "deviation_pct", "z_score", "scale", "drop_points", "rise_points", "down_pct", "multiplier", "threshold", "slo", "cv"]


@query("series_facts", f"SELECT {RK}, mode, below_slo, CAST(n AS BIGINT) AS n, " + ", ".join(f"rnd({c}, 4) AS {c}" for c in _FACT) + " FROM facts")
def series_facts(spark, d):
    return _facts(spark, d).select(*RKEY, "mode", "below_slo", "n", *[rnd(c).alias(c) for c in _FACT])


@query("threshold_lookup", "SELECT service, metric, red_min, red_max, CAST(count(p.value) AS BIGINT) AS points FROM thr LEFT JOIN points p USING (service, metric) GROUP BY ALL")
def threshold_lookup(spark, d):
    p = X.policy()
    n = X.metric_points(spark, d).groupBy("service", "metric").agg(F.count("*").alias("points"))
    keys = p.service_dim(spark).select("service").crossJoin(p.catalog(spark).select("metric"))
    return FA.with_thresholds(keys, p).join(n, ["service", "metric"], "left").select(
        "service", "metric", "red_min", "red_max", F.coalesce("points", F.lit(0)).alias("points"))


@query("slo_lookup", """
SELECT service, metric, slo, CAST(count(*) FILTER (CASE WHEN metric = 'success_rate' THEN p.value < slo ELSE p.value > slo END) AS BIGINT) AS violations
FROM slo_t JOIN points p USING (service, metric) WHERE slo IS NOT NULL GROUP BY ALL""")
def slo_lookup(spark, d):
    p = X.policy()
    j = FA.with_slo(X.metric_points(spark, d), p).where("slo IS NOT NULL").join(p.service_dim(spark).select("service"), "service", "left_semi")
    bad = F.when(F.col("metric") == "success_rate", F.col("value") < F.col("slo")).otherwise(F.col("value") > F.col("slo"))
    return j.groupBy("service", "metric", "slo").agg(F.count_if(bad).alias("violations"))


# ------------------------------------------------------------------ runs
view("slo_hits", f"""
SELECT {RK}, p.t, CASE WHEN f.metric = 'success_rate' THEN p.value < f.slo ELSE p.value > f.slo END AS hit,
  row_number() OVER (PARTITION BY {RK} ORDER BY p.t) AS rn FROM wp p JOIN facts0 f USING ({RK}) WHERE f.slo IS NOT NULL""")
_ISL = """
SELECT {keys}, arg_max(n, (n, -t0)) AS n, arg_max(t0, (n, -t0)) AS t0, arg_max(t1, (n, -t0)) AS t1 FROM (
  SELECT {keys}, count(*) AS n, min(t) AS t0, max(t) AS t1 FROM (
    SELECT *, rn - row_number() OVER (PARTITION BY {keys} ORDER BY t) AS isl FROM {src} WHERE hit) GROUP BY {keys}, isl) GROUP BY ALL"""
view("slo_runs", _ISL.format(keys=RK, src="slo_hits"))


@query("longest_run", f"SELECT {RK}, CAST(n AS BIGINT) AS n, t0 AS start_s, t1 AS end_s FROM slo_runs")
def longest_run(spark, d):
    p = FA.with_slo(window_points(spark, d), X.policy()).join(
        G.instances(X.policy().service_dim(spark)), ["service", "instance"], "left_semi")
    bad = F.when(F.col("metric") == "success_rate", F.col("value") < F.col("slo")).otherwise(F.col("value") > F.col("slo"))
    r = L.run_islands(p, RKEY, bad)
    return r.select(*RKEY, "n", seconds(F.col("run_start")).alias("start_s"), seconds(F.col("run_end")).alias("end_s"))


@query("longest_run_array", f"SELECT {RK}, CAST(n AS BIGINT) AS n, t0 AS start_s FROM slo_runs")
def longest_run_array(spark, d):
    """The same from the ordered sample arrays, as the rules do it."""
    f = inputs(spark, d).facts.where("slo IS NOT NULL")
    r = L.longest_run("samples", "CASE WHEN hib THEN p.value < slo ELSE p.value > slo END")
    return f.select(*RKEY, r.alias("r")).where("r.n > 0").select(
        *RKEY, F.col("r.n").cast("long").alias("n"), seconds(F.col("r.start")).alias("start_s"))


# ------------------------------------------------------------------ levels
_SCALED = "CASE WHEN abs(k - 1) < 1e-9 THEN {0} ELSE round({0} * k, 4) END AS {0}"
view("rule_facts0", f"""
SELECT * REPLACE ({", ".join(_SCALED.format(c) for c in ("t_value", "lo_value", "hi_value"))}) FROM (
  SELECT f.*, l.* EXCLUDE (metric), CASE WHEN NOT hib AND red_max IS NOT NULL AND coalesce(default_max, 0) <> 0 THEN red_max / default_max ELSE 1 END AS k
  FROM facts0 f JOIN rule_levels l USING (metric))""")
view("rule_facts", _observed("rule_facts0", """CASE direction WHEN 'down' THEN vmin WHEN 'up' THEN vmax
  ELSE CASE WHEN hib THEN vmin ELSE vmax END END"""))


def _signed(v, t):
    return f"CASE direction WHEN 'up' THEN {v} >= {t} WHEN 'down' THEN -({v}) >= {t} ELSE abs({v}) >= {t} END"


def _hit_sql():
    return f"""(t_value IS NULL OR p.value >= t_value) AND (t_drop_points IS NULL OR coalesce(baseline_value, 0) - p.value >= t_drop_points)
 AND (t_rise_points IS NULL OR p.value - coalesce(baseline_value, 0) >= t_rise_points)
 AND (t_multiplier IS NULL OR NOT has OR p.value / baseline_value >= t_multiplier)
 AND (t_down_pct IS NULL OR NOT has OR (baseline_value - p.value) / abs(baseline_value) * 100 >= t_down_pct)
 AND (t_z_score IS NULL OR coalesce(scale, 0) = 0 OR {_signed("(p.value - coalesce(baseline_value, 0)) / scale", "t_z_score")})
 AND (NOT coalesce(t_below_slo, FALSE) OR CASE WHEN hib THEN p.value < slo ELSE p.value > slo END)"""


def _used_sql(slo):
    return f"""t_value IS NOT NULL OR t_drop_points IS NOT NULL OR t_rise_points IS NOT NULL OR (t_multiplier IS NOT NULL AND has)
 OR (t_down_pct IS NOT NULL AND has) OR (t_z_score IS NOT NULL AND coalesce(scale, 0) <> 0)""" + (
        " OR (coalesce(t_below_slo, FALSE) AND coalesce(slo, 0) <> 0)" if slo else "")


for _sfx, _slo in (("", True), ("_window", False)):
    view(f"cand{_sfx}", f"""
SELECT *, {_used_sql(_slo)} AS used FROM rule_facts WHERE n >= min_samples AND (t_value IS NULL OR observed >= t_value)
 AND (t_drop_points IS NULL OR drop_points >= t_drop_points) AND (t_rise_points IS NULL OR rise_points >= t_rise_points)
 AND (t_multiplier IS NULL OR multiplier >= t_multiplier) AND (t_cv IS NULL OR cv >= t_cv)
 AND (t_down_pct IS NULL OR abs(down_pct) >= t_down_pct) AND (t_z_score IS NULL OR {_signed("z_score", "t_z_score")})
 AND (t_min_absolute IS NULL OR observed >= t_min_absolute) AND (t_below_slo IS NULL OR below_slo = t_below_slo)""")
    view(f"hits{_sfx}", f"""
SELECT {", ".join("c." + k for k in RK.split(", "))}, c.rule_id, c.level, p.t, {_hit_sql()} AS hit,
  row_number() OVER (PARTITION BY {", ".join("c." + k for k in RK.split(", "))}, c.rule_id, c.level ORDER BY p.t) AS rn
FROM cand{_sfx} c JOIN wp p USING ({RK}) WHERE c.used""")
    view(f"runs{_sfx}", _ISL.format(keys=f"{RK}, rule_id, level", src=f"hits{_sfx}"))
    view(f"matched{_sfx}", f"""
SELECT * FROM (
  SELECT c.*, CASE WHEN c.used THEN coalesce(r.n, 0) * c.step_min ELSE c.window_min END AS duration_min, coalesce(r.t0, c.first_t) AS first_seen,
    c.last_t AS last_seen FROM cand{_sfx} c LEFT JOIN runs{_sfx} r USING ({RK}, rule_id, level))
WHERE duration_min + 1e-9 >= coalesce(t_duration, 0)
QUALIFY row_number() OVER (PARTITION BY {RK}, rule_id ORDER BY level) = 1""")


def _amp_value(v, lo, hi):
    return f"""CASE WHEN {hi} <= {lo} THEN CASE WHEN {v} < {hi} OR {hi} <= 0 THEN 0 ELSE least(1, greatest(0, 0.2 + 0.8 * least(1, ({v} - {hi}) / abs({hi})))) END
 ELSE least(1, greatest(0, ({v} - {lo}) / ({hi} - {lo}))) END"""


view("band", values_sql(["level", "blo", "bhi"], [(k, a, b) for k, (a, b) in LEVEL_BAND.items()], {"blo": "DOUBLE", "bhi": "DOUBLE"}))
_AMP_PARTS = [
    f"CASE WHEN t_{k} IS NOT NULL THEN {_amp_value(f'abs({o})', f'lo_{k}', f'hi_{k}')} END"
    for k in (*POINTWISE, "cv") for o in ["observed" if k == "value" else k]]
view("generic_findings", f"""
SELECT run_id, rule_id, service, instance, metric, level, observed, baseline_value, deviation_pct, z_score, duration_min, first_seen, last_seen, mode,
  CASE WHEN mode <> 'dynamic' THEN 'low' WHEN sample_size >= 200 THEN 'high' WHEN sample_size >= 60 THEN 'medium' ELSE 'low' END AS confidence,
  instance_count, criticality, round(blo + (bhi - blo) * least(1, greatest(0, coalesce(raw, CAST(0.5 AS DOUBLE)))), 4) AS amplitude
FROM (SELECT *, greatest({", ".join(_AMP_PARTS)}, CASE WHEN mode = 'dynamic' THEN least(1, greatest(0, (abs(z_score) - 3) / 9)) END) AS raw FROM matched)
JOIN band USING (level)""")


@query("level_match", f"""
SELECT {RK}, rule_id, level, duration_min, first_seen AS first_s FROM matched""")
def level_match(spark, d):
    m = L.match_levels(rule_facts(inputs(spark, d)))
    return m.select(*RKEY, "rule_id", "level", "duration_min", seconds(F.col("first_seen")).alias("first_s"))


@query("level_match_window_slo", f"""
SELECT {RK}, rule_id, level, duration_min, first_seen AS first_s FROM matched_window""")
def level_match_window_slo(spark, d):
    """With the objective condition gated by the window's length instead of its own run."""
    m = L.match_levels(rule_facts(inputs(spark, d)), slo_pointwise=False)
    return m.select(*RKEY, "rule_id", "level", "duration_min", seconds(F.col("first_seen")).alias("first_s"))


@query("level_scaling", f"SELECT DISTINCT service, instance, rule_id, level, t_value, lo_value, hi_value FROM rule_facts WHERE t_value IS NOT NULL")
def level_scaling(spark, d):
    f = rule_facts(inputs(spark, d)).where("t_value IS NOT NULL")
    return f.select("service", "instance", "rule_id", "level", "t_value", "lo_value", "hi_value").distinct()


@query("condition_eval", f"""
SELECT {RK}, rule_id, level FROM cand""")
def condition_eval(spark, d):
    f = rule_facts(inputs(spark, d)).where((F.col("n") >= F.col("min_samples")) & L.conditions_hold())
    return f.select(*RKEY, "rule_id", "level")


@query("amplitude", f"""
SELECT {RK}, rule_id, level, rnd({_amp_value('abs(observed)', 'lo_value', 'hi_value')}, 4) AS amplitude,
  rnd(least(1, greatest(0, (abs(z_score) - 3) / 9)), 4) AS z_amplitude FROM matched WHERE t_value IS NOT NULL""")
def amplitude(spark, d):
    m = L.match_levels(rule_facts(inputs(spark, d))).where("t_value IS NOT NULL")
    a = L.amplitude_from_value("abs(observed)", "lo_value", "hi_value")
    return m.select(*RKEY, "rule_id", "level", rnd(a).alias("amplitude"), rnd(L.amplitude_from_z(F.col("z_score"))).alias("z_amplitude"))


@query("amplitude_banded", f"SELECT {RK}, rule_id, level, rnd(amplitude, 3) AS amplitude FROM generic_findings")
def amplitude_banded(spark, d):
    m = L.match_levels(rule_facts(inputs(spark, d)))
    return m.select(*RKEY, "rule_id", "level", rnd(L.generic_amplitude(), 3).alias("amplitude"))


_SCORE = """least(1, greatest(0, 0.55 * least(1, greatest(0, amplitude)) + 0.20 * least(1, greatest(0, duration_min) / 15)
  + 0.15 * least(1, greatest(0, {blast})) + 0.10 * least(1, greatest(0, {crit}))))"""


@query("deviation_score", f"""
SELECT {RK}, rule_id, round(1e-9 + {_SCORE.format(blast='1.0 / greatest(1, instance_count)', crit='criticality')}, 4) AS deviation_score FROM generic_findings""")
def deviation_score(spark, d):
    return finish(generic_hits(inputs(spark, d))).select(*RKEY, "rule_id", "deviation_score")


def _fmt(c, n=2):
    return f"CASE WHEN {c} = floor({c}) AND abs({c}) < 1e9 THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE printf('%.{n}f', round({c}, {n})) END"


def _val(c):
    return (f"CASE unit WHEN 'ms' THEN printf('%.0fms', round({c}, 0)) WHEN '%' THEN printf('%.2f%%', round({c}, 2)) "
            f"WHEN 'req/s' THEN printf('%.1f', round({c}, 1)) WHEN 'count' THEN printf('%.0f', round({c}, 0)) ELSE printf('%.2f', round({c}, 2)) END")


_TEMPLATES = values_sql(["rule_id", "level", "template"], [
    (r.rule_id, lv.level, lv.reason) for r in X.policy().rules if r.kind == "generic" for lv in r.levels])


@query("reason_text", f"""
WITH tpl AS ({_TEMPLATES}),
o AS (SELECT m.*, template FROM matched m JOIN tpl USING (rule_id, level) WHERE rule_id IN ('BIZ-05', 'RES-04', 'PERF-03'))
SELECT {RK}, rule_id, replace(replace(replace(replace(replace(replace(template, '{{observed}}', {_val('observed')}),
  '{{baseline}}', {_val('coalesce(baseline_value, 0)')}), '{{multiplier}}', {_fmt('multiplier')}), '{{cv}}', {_fmt('cv')}),
  '{{threshold}}', {_fmt('round(threshold, 0)', 0)}), '{{duration}}', {_fmt('round(duration_min, 0)', 0)}) AS reason FROM o""")
def reason_text(spark, d):
    f = finish(generic_hits(inputs(spark, d), ["BIZ-05", "RES-04", "PERF-03"]))
    return f.select(*RKEY, "rule_id", "reason")
