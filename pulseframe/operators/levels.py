"""Level matching: conditions, run lengths, amplitudes, scores and reason texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulseframe.functions import clamp01, fmt_sql, metric_text_sql, render
from pulseframe.policy import LEVEL_BAND, POINTWISE, Rule

# fixed values: weights of the deviation score and its duration saturation in minutes
SCORE_AMPLITUDE, SCORE_DURATION, SCORE_BLAST, SCORE_CRITICALITY = 0.55, 0.20, 0.15, 0.10
DURATION_SATURATION = 15.0


# ------------------------------------------------------------------ run lengths
def longest_run(samples: str, hit: str) -> Column:
    """Longest stretch of adjacent samples that satisfy `hit`, as struct(n, start).

    `samples` names the ordered array<struct<ts, value>> of one series in one window; `hit` is
    SQL over a sample `p`. The earliest of equally long stretches wins. Adjacent means
    adjacent samples, whatever buckets are missing between them.
    """
    # evaluate the predicate once per sample, then count over (ts, hit)
    return F.expr(f"""
        aggregate(
          transform({samples}, p -> struct(p.ts AS ts, coalesce({hit}, false) AS hit)),
          struct(0 AS cur, CAST(NULL AS TIMESTAMP) AS cur_start, 0 AS best, CAST(NULL AS TIMESTAMP) AS best_start),
          (a, p) -> struct(
            CASE WHEN p.hit THEN a.cur + 1 ELSE 0 END AS cur,
            CASE WHEN a.cur = 0 THEN p.ts ELSE a.cur_start END AS cur_start,
            CASE WHEN p.hit AND a.cur >= a.best THEN a.cur + 1 ELSE a.best END AS best,
            CASE WHEN p.hit AND a.cur >= a.best THEN CASE WHEN a.cur = 0 THEN p.ts ELSE a.cur_start END
                 ELSE a.best_start END AS best_start),
          a -> struct(a.best AS n, a.best_start AS start))""")


def run_islands(points: DataFrame, keys: list[str], hit: Column) -> DataFrame:
    """The same as rows, for series too long to hold as an array: gaps and islands.

    Returns the longest run of each key with its first and last sample; keys without a hit
    are absent.
    """
    w = W.partitionBy(*keys).orderBy("ts")
    p = points.withColumn("_rn", F.row_number().over(w)).withColumn("_hit", F.coalesce(hit, F.lit(False)))
    # the hit's rank is counted in the same sort, so one exchange serves both
    p = p.withColumn("_hn", F.sum(F.col("_hit").cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    isl = p.where("_hit").groupBy(*keys, (F.col("_rn") - F.col("_hn")).alias("_island")).agg(
        F.count("*").alias("n"), F.min("ts").alias("run_start"), F.max("ts").alias("run_end"))
    best = F.max_by(F.struct("n", "run_start", "run_end"), F.struct(F.col("n"), -F.unix_seconds("run_start")))
    return isl.groupBy(*keys).agg(best.alias("r")).select(*keys, "r.n", "r.run_start", "r.run_end")


# ------------------------------------------------------------------ generic matching
def scale_value_levels(df: DataFrame) -> DataFrame:
    """Scale the `value` thresholds and bounds of rule levels by service line / default line;
    not where the metric is better high or has no line."""
    ok = "NOT hib AND red_max IS NOT NULL AND coalesce(default_max, 0D) <> 0"
    df = df.withColumn("level_scale", F.expr(f"CASE WHEN {ok} THEN try_divide(red_max, default_max) ELSE 1D END"))
    return df.withColumns({
        c: F.expr(f"CASE WHEN abs(level_scale - 1D) < 1e-9 THEN {c} ELSE round({c} * level_scale, 4) END")
        for c in ("t_value", "lo_value", "hi_value")})


def _signed(value: str, target: str) -> str:
    """abs(value) >= target, but with the rule's direction where it has one."""
    return (f"CASE direction WHEN 'up' THEN {value} >= {target} WHEN 'down' THEN -({value}) >= {target} "
            f"ELSE abs({value}) >= {target} END")


def conditions_hold() -> Column:
    """All window-level conditions of a level; a key the level does not use is NULL and passes."""
    tests = {
        "value": "observed >= t_value",
        "drop_points": "drop_points >= t_drop_points",
        "rise_points": "rise_points >= t_rise_points",
        "multiplier": "multiplier >= t_multiplier",
        "cv": "cv >= t_cv",
        "down_pct": "abs(down_pct) >= t_down_pct",
        "deviation_pct": "abs(deviation_pct) >= t_deviation_pct",
        "z_score": _signed("z_score", "t_z_score"),
        "min_absolute": "observed >= t_min_absolute",
        "below_slo": "below_slo = t_below_slo",
    }
    return F.expr(" AND ".join(f"(t_{k} IS NULL OR coalesce({c}, false))" for k, c in tests.items()))


def sample_hit(v: str, slo_pointwise: bool = True) -> tuple[str, str]:
    """(predicate on one sample `v`, whether the level has any sample-wise condition), as SQL.

    Uses the slot median, not the hour profile, as the centre. Conditions that cannot be
    evaluated (reference or scale of 0) do not take part.
    """
    ref, has_ref = "coalesce(baseline_value, 0D)", "coalesce(baseline_value, 0D) <> 0"
    checks = [
        ("t_value IS NOT NULL", f"{v} >= t_value"),
        ("t_drop_points IS NOT NULL", f"{ref} - {v} >= t_drop_points"),
        ("t_rise_points IS NOT NULL", f"{v} - {ref} >= t_rise_points"),
        (f"t_multiplier IS NOT NULL AND {has_ref}", f"try_divide({v}, {ref}) >= t_multiplier"),
        (f"t_down_pct IS NOT NULL AND {has_ref}", f"try_divide({ref} - {v}, abs({ref})) * 100D >= t_down_pct"),
        (f"t_deviation_pct IS NOT NULL AND {has_ref}", f"try_divide(abs({v} - {ref}), abs({ref})) * 100D >= t_deviation_pct"),
        ("t_z_score IS NOT NULL AND coalesce(scale, 0D) <> 0", _signed(f"try_divide({v} - {ref}, scale)", "t_z_score")),
    ]
    if slo_pointwise:
        checks.append(("coalesce(t_below_slo, false) AND coalesce(slo, 0D) <> 0",
                       f"CASE WHEN hib THEN {v} < slo ELSE {v} > slo END"))
    hit = " AND ".join(f"(NOT ({active}) OR coalesce({cond}, false))" for active, cond in checks)
    return hit, " OR ".join(f"({active})" for active, _ in checks)


def match_levels(facts: DataFrame, slo_pointwise: bool = True) -> DataFrame:
    """First level P1..P4 whose conditions all hold for long enough; one row per (run, series, rule).

    `facts` carries one row per candidate level. Levels whose window-level conditions fail
    are filtered before any run is counted. Still partitioned by series, so picking the
    first level needs no exchange.
    """
    cand = facts.where((F.col("n") >= F.col("min_samples")) & conditions_hold())
    hit, used = sample_hit("p.value", slo_pointwise)
    cand = cand.withColumn("_used", F.expr(used))
    cand = cand.withColumn("_run", F.when(F.col("_used"), longest_run("samples", hit)))
    cand = cand.withColumns({
        "duration_min": F.expr("CASE WHEN _used THEN _run.n * step_minutes ELSE window_minutes END"),
        "first_seen": F.expr("coalesce(_run.start, first_ts)")})
    cand = cand.where(F.col("duration_min") + 1e-9 >= F.coalesce("t_duration", F.lit(0.0))).drop("samples", "_run", "_used")
    keys = ["run_id", "service", "instance", "metric", "rule_id"]
    rest = [c for c in cand.columns if c not in keys]
    best = cand.groupBy(*keys).agg(F.min_by(F.struct(*rest), "level").alias("r"))
    return best.select(*keys, "r.*")


# ------------------------------------------------------------------ amplitude and score
def amplitude_sql(v: str, warn: str, critical: str) -> str:
    """Linear from the mildest to the strictest threshold. With a single threshold: 0.2 on
    the line, 1 at twice the line."""
    return f"""CASE WHEN {critical} <= {warn} THEN
        CASE WHEN {v} < {critical} OR {critical} <= 0 THEN 0D
          ELSE greatest(0D, least(1D, 0.2D + 0.8D * least(1D, try_divide({v} - {critical}, abs({critical}))))) END
        ELSE greatest(0D, least(1D, try_divide({v} - {warn}, {critical} - {warn}))) END"""


def amplitude_from_value(v: str, warn: float | str, critical: float | str) -> Column:
    """`amplitude_sql` as a column; bounds are column names or numbers."""
    bound = [b if isinstance(b, str) else f"{float(b)!r}D" for b in (warn, critical)]
    return F.expr(amplitude_sql(v, *bound))


def amplitude_from_z(z: Column) -> Column:
    return clamp01((F.abs(z) - 3.0) / 9.0)


def banded(raw: str, level: str = "level") -> Column:
    """Press a 0..1 amplitude into its level's range, so level decides before amplitude."""
    lo = " ".join(f"WHEN {lv} THEN {a!r}D" for lv, (a, _) in LEVEL_BAND.items())
    span = " ".join(f"WHEN {lv} THEN {b!r}D - {a!r}D" for lv, (a, b) in LEVEL_BAND.items())
    return F.expr(f"round(CASE {level} {lo} END + (CASE {level} {span} END) * greatest(0D, least(1D, {raw})), 4)")


def generic_amplitude() -> Column:
    """Largest exceedance over the matched level's own conditions and, with a dynamic baseline, z."""
    parts = []
    for k in (*POINTWISE, "cv"):
        v = f"abs({'observed' if k == 'value' else k})"
        parts.append(f"CASE WHEN t_{k} IS NOT NULL THEN {amplitude_sql(v, f'lo_{k}', f'hi_{k}')} END")
    parts.append("CASE WHEN mode = 'dynamic' THEN greatest(0D, least(1D, (abs(z_score) - 3D) / 9D)) END")
    return banded(f"coalesce(greatest({', '.join(parts)}), 0.5D)")


def deviation_score_sql(amplitude: str, duration: str, blast: str, criticality: str) -> str:
    """0..1 severity; amplitudes have four decimals, so exact halves are common: 1e-9 keeps the
    last bit of the sum from deciding them."""
    def c01(x):
        return f"greatest(0D, least(1D, {x}))"

    s = (f"{SCORE_AMPLITUDE}D * {c01(amplitude)} + {SCORE_DURATION}D * least(1D, greatest(0D, {duration}) / {DURATION_SATURATION}D) "
         f"+ {SCORE_BLAST}D * {c01(blast)} + {SCORE_CRITICALITY}D * {c01(criticality)}")
    return f"round({c01(s)} + 1e-9, 4)"


def match_row_levels(rule: Rule, facts: dict[str, str]) -> str:
    """First matching level of a rule whose conditions are plain columns, as an SQL CASE.

    Signed keys compare by absolute value; a NULL fact never matches.
    """
    whens = []
    for lv in rule.levels:
        conds = []
        for key, target in lv.when.items():
            v = facts[key]
            if key in ("deviation_pct", "z_score", "down_pct", "slope_pct_per_hour"):
                v = f"abs({v})"
            conds.append(f"{v} >= {float(target)!r}D")
        whens.append(f"WHEN {' AND '.join(conds)} THEN {lv.level}")
    return f"CASE {' '.join(whens)} END"


def reason_template(rule: Rule) -> str:
    """The reason template of a row's level, as an SQL CASE."""
    def text(t):
        return t.replace("\\", "\\\\").replace("'", "\\'")

    return "CASE level " + " ".join(f"WHEN {lv.level} THEN '{text(lv.reason)}'" for lv in rule.levels) + " ELSE '' END"


# ------------------------------------------------------------------ texts
def reason() -> Column:
    """Fill the reason template from a rule hit's columns."""
    def num(c, default=0):
        return f"coalesce({c}, {float(default)!r}D)"

    return render("template", {
        "service": "service", "instance": "coalesce(instance, service)", "metric": "label",
        "observed": metric_text_sql("observed", "unit"), "baseline": metric_text_sql(num("baseline_value"), "unit"),
        "observed_raw": fmt_sql("observed"), "baseline_raw": fmt_sql(num("baseline_value")),
        "deviation": fmt_sql("abs(deviation_pct)"), "deviation_signed": fmt_sql("deviation_pct"),
        "drop": fmt_sql(num("drop_points")), "rise": fmt_sql(num("rise_points")), "z": fmt_sql("abs(z_score)", 1),
        "ratio": fmt_sql(num("ratio", 1)), "multiplier": fmt_sql(num("multiplier", 1)),
        "samples": fmt_sql(f"double({num('samples')})", 0), "cv": fmt_sql(num("cv")), "slope": fmt_sql(f"abs({num('slope_pct')})", 1),
        "duration": fmt_sql("round(duration_min, 0)", 0), "threshold": fmt_sql(f"round({num('threshold')}, 0)", 0),
        "slo": metric_text_sql(num("slo"), "unit"), "path": "path", "forecast": "forecast",
    })
