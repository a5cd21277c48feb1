"""The sixteen rules as five DataFrame plans.

The eleven single-metric rules share one plan: facts join the rule-level table on metric.
The others need a second metric, a longer lookback, sibling instances or dependency paths.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.operators import levels as L
from pulseframe.operators import stats
from pulseframe.operators.baseline import confidence
from pulseframe.operators.facts import add_observed, series_base
from pulseframe.operators.graph import edges
from pulseframe.operators.paths import Condensed, condense, path_rows, worst_paths
from pulseframe.operators.windows import assign_windows
from pulseframe.policy import Policy, Rule
from pulseframe.schemas import FINDING_COLS, RKEY
from pulseframe.session import write_stage

#: instance ratios under this are ordinary noise (fixed value)
SKEW_FLOOR = 1.05
#: usage level a growth forecast runs to, and how many hours ahead it is worth stating (fixed values)
FORECAST_LIMIT, FORECAST_HOURS = 95.0, 240.0


class Inputs:
    """What a rule may read: lazy DataFrames, built once and shared by all rules of a run.

    windowed   window_series() of the points inside each inspection window
    base       baselines()
    points     clean points, for rules with their own lookback
    windows    run_id, window_start, window_end, ...
    paths      head, path_id, pos, node of dependency paths; None to find each head's worst path in the graph
    facts      series_base() of the first two, where it has been written already
    graph      condense() of the policy's dependencies, where it is at hand
    """

    def __init__(self, windowed: DataFrame, base: DataFrame, points: DataFrame, windows: DataFrame,
                 paths: DataFrame | None, policy: Policy, facts: DataFrame | None = None, graph: Condensed | None = None):
        self.windowed, self.base, self.points = windowed, base, points
        self.windows, self.paths, self.policy, self.graph = windows, paths, policy, graph
        self.facts = series_base(windowed, base, policy) if facts is None else facts


#: what every rule reports of a hit, with the SQL type of columns a rule may leave out
HIT_COLS = {
    "run_id": "string", "rule_id": "string", "dimension": "string", "service": "string", "instance": "string", "metric": "string",
    "level": "int", "observed": "double", "baseline_value": "double", "deviation_pct": "double", "z_score": "double",
    "amplitude": "double", "duration_min": "double", "first_seen": "timestamp", "last_seen": "timestamp", "mode": "string",
    "baseline_confidence": "string", "instance_count": "int", "criticality": "double", "owner": "string", "template": "string",
    "label": "string", "unit": "string", "samples": "bigint", "drop_points": "double", "rise_points": "double",
    "multiplier": "double", "cv": "double", "ratio": "double", "slope_pct": "double", "threshold": "double", "slo": "double",
    "path": "string", "forecast": "string", "details": "map<string,string>",
}


def _hits(df: DataFrame, rule: Rule | None = None, details: str | None = None, **columns: str) -> DataFrame:
    """Bring a rule's rows to HIT_COLS: given SQL first, then same-named columns, then NULL."""
    if rule is not None:
        columns = {"rule_id": f"'{rule.rule_id}'", "dimension": f"'{rule.dimension}'", "template": L.reason_template(rule),
                   "z_score": "0D", **columns}
    if details:
        columns["details"] = f"map({details})"
    have = set(df.columns)
    return df.selectExpr(*[
        f"CAST({columns.get(c) or (c if c in have else 'NULL')} AS {t}) AS {c}" for c, t in HIT_COLS.items()])


def finish(hits: DataFrame) -> DataFrame:
    """Hits of any rules -> findings: blast radius of one instance, score, reason, evidence."""
    out = hits.withColumns({"amplitude": F.round("amplitude", 4), "affected_ratio": F.expr("1D / greatest(1, instance_count)")})
    evidence = ("map_concat(map('owner', owner, 'instance_count', string(instance_count), 'samples', string(samples)), "
                "coalesce(details, map()))")
    return out.withColumns({
        "deviation_score": F.expr(L.deviation_score_sql("amplitude", "duration_min", "affected_ratio", "criticality")),
        "baseline_mode": F.col("mode"), "reason": L.reason(), "evidence": F.expr(evidence)}).select(*FINDING_COLS)


# ------------------------------------------------------------------ generic rules
def rule_facts(inputs: Inputs, rule_ids: list[str] | None = None) -> DataFrame:
    """One row per (run, series, rule, level) with observed value in the rule's direction."""
    lv = inputs.policy.generic_levels(inputs.facts.sparkSession, rule_ids)
    df = inputs.facts.join(lv, "metric")
    observed = (
        F.when(F.col("direction") == "down", F.col("vmin")).when(F.col("direction") == "up", F.col("vmax"))
        .when(F.col("hib"), F.col("vmin")).otherwise(F.col("vmax")))
    return L.scale_value_levels(add_observed(df, observed))


def generic_hits(inputs: Inputs, rule_ids: list[str] | None = None, slo_pointwise: bool = True) -> DataFrame:
    m = L.match_levels(rule_facts(inputs, rule_ids), slo_pointwise)
    return _hits(m.withColumn("amplitude", L.generic_amplitude()), last_seen="last_ts", template="reason_template", samples="n")


# ------------------------------------------------------------------ long tail
def long_tail(inputs: Inputs, rule: Rule) -> DataFrame:
    """Largest P99/P50 at equal timestamps against the ratio of the two baseline medians.

    Both series of an instance meet by one grouped pass over (run, instance, ts), then one
    over (run, instance). z is 0: the baseline is in ms, the observed value a ratio.
    """
    num, den = rule.params["numerator"], rule.params["denominator"]
    f = inputs.facts.where(F.col("metric").isin(num, den))
    side = F.col("metric") == num
    keys = ["run_id", "service", "instance"]

    def pick(cond, name):
        return F.max(F.when(cond, F.col(name)))

    per = f.groupBy(*keys).agg(
        F.max(F.when(side, F.col("samples"))).alias("top"), F.max(F.when(~side, F.col("samples"))).alias("bottom"),
        pick(side, "median").alias("_mt"), pick(~side, "median").alias("_mb"),
        pick(side, "mode").alias("mode"), pick(~side, "mode").alias("_mode_b"),
        pick(side, "baseline_confidence").alias("baseline_confidence"),
        F.max("window_minutes").alias("window_minutes"), F.max("instance_count").alias("instance_count"),
        F.max("criticality").alias("criticality"), F.max("owner").alias("owner"), pick(side, "label").alias("label"))
    per = per.where(
        (F.size("top") >= 3) & (F.size("bottom") >= 3) & (F.col("mode") == "dynamic") & (F.col("_mode_b") == "dynamic")
        & (F.col("_mb") > 0))
    # both arrays are ordered by ts and bounded by the window's buckets: meet them through a map
    low = F.map_from_entries(F.filter("bottom", lambda p: p["value"] > 0))
    ratios = F.filter(
        F.transform("top", lambda p: F.struct(p["ts"].alias("ts"), F.try_divide(
            p["value"], F.try_element_at(F.col("_low"), p["ts"])).alias("value"))),
        lambda p: p["value"].isNotNull())
    per = per.withColumn("_low", low).withColumn("ratios", ratios).where(F.size("ratios") > 0)
    per = per.withColumns({
        "observed": F.array_max(F.transform("ratios", lambda p: p["value"])), "baseline_value": F.expr("try_divide(_mt, _mb)")})
    per = per.where("baseline_value > 0").withColumn("deviation_pct", F.expr("(observed - baseline_value) / baseline_value * 100D"))
    per = per.withColumn("level", F.expr(L.match_row_levels(rule, {
        "ratio": "observed", "value": "observed", "ratio_rise_pct": "deviation_pct", "deviation_pct": "deviation_pct"})))
    parts = [L.amplitude_sql(f"abs({c})", f"{lo!r}D", f"{hi!r}D")
             for key, c in (("ratio", "observed"), ("ratio_rise_pct", "deviation_pct"))
             for lo, hi in [rule.bounds(key)] if lo is not None]
    amplitude = f"greatest({', '.join(parts)})" if len(parts) > 1 else (parts or ["0.3D"])[0]
    return _hits(
        per.where("level IS NOT NULL"), rule, f"'numerator', '{num}', 'denominator', '{den}'", metric=f"'{num}'",
        amplitude=amplitude, duration_min="window_minutes", first_seen="element_at(ratios, 1).ts",
        last_seen="element_at(ratios, -1).ts", label=f"'{num}/{den}'", unit="'x'", ratio="observed",
        threshold="baseline_value", samples="size(ratios)")


# ------------------------------------------------------------------ trends
def trend_series(points: DataFrame, windows: DataFrame, metric: str, lookback_minutes: float | None) -> DataFrame:
    """Trend statistics per run over the window or a longer lookback that ends with it."""
    p = points.where(F.col("metric") == metric)
    start = F.col("window_start") if lookback_minutes is None else F.timestamp_seconds(
        F.unix_seconds("window_end") - int(lookback_minutes * 60))
    p = assign_windows(p, windows.select("run_id", "window_start", "window_end"), start, "window_end")
    return stats.trend(p, RKEY, carry=("window_start", "window_end")).withColumnsRenamed(
        {"latest": "observed", "first_ts": "first_seen", "last_ts": "last_seen"})


def forecast_hours(observed: Column, slope_pct: Column) -> Column:
    """Hours until usage reaches its limit at this rate; NULL if falling, there already or too far off."""
    h = F.try_divide(FORECAST_LIMIT - observed, observed * slope_pct / 100.0)
    return F.when((slope_pct > 0) & (observed < FORECAST_LIMIT) & (observed != 0) & (h > 0) & (h <= FORECAST_HOURS), h)


def trend_rule(inputs: Inputs, rule: Rule, direction: str | None = None) -> DataFrame:
    """Significant slope, relative to the median, beyond a level's rate.

    Rates compare by size; `direction='up'` keeps rising series only. The signed rate is in
    the evidence either way.
    """
    p = rule.params
    hours = p.get("lookback_hours")
    minutes = None if hours is None else float(hours) * 60.0
    spark = inputs.points.sparkSession
    t = trend_series(inputs.points, inputs.windows, p["metric"], minutes)
    t = t.where((F.col("n") >= int(p.get("min_samples", 10))) & (F.abs("t_stat") >= float(p.get("min_t_stat", 3.0)))
                & (F.col("r2") >= float(p.get("min_r2", 0.0))))
    if direction == "up":
        t = t.where("slope_pct > 0")
    t = t.withColumn("level", F.expr(L.match_row_levels(rule, {
        "slope_pct_per_hour": "slope_pct", "value": "observed", "deviation_pct": "slope_pct"}))).where("level IS NOT NULL")
    dim = inputs.policy.series_dim(spark).select("service", "metric", "label", "unit", "criticality", "owner", "instance_count")
    b = inputs.base.where(F.col("metric") == p["metric"]).select(*RKEY, "mode", "sample_size")
    t = t.join(dim, ["service", "metric"]).join(
        inputs.policy.declared_instances(spark), ["service", "instance"], "left_semi").join(b, RKEY, "left")
    usage = p["metric"] in ("mem_usage", "cpu_usage", "conn_usage")
    t = t.withColumns({
        "mode": F.coalesce("mode", F.lit("static_fallback")),
        "hours": forecast_hours(F.col("observed"), F.col("slope_pct")) if usage else F.lit(None).cast("double")})
    t = t.withColumn("baseline_confidence", confidence(F.col("mode"), F.coalesce("sample_size", F.lit(0))))
    lo, hi = rule.bounds("slope_pct_per_hour")
    length = f"{minutes!r}D" if minutes is not None else "(unix_seconds(window_end) - unix_seconds(window_start)) / 60D"
    forecast = (f"CASE WHEN slope_pct <= 0 THEN 'falling at the current rate' WHEN hours IS NULL THEN '' "
                f"ELSE format_string('about %.1fh until {FORECAST_LIMIT:.0f}%%', round(hours, 1)) END")
    return _hits(
        t, rule, "'trend_t_stat', string(round(t_stat, 2)), 'trend_r2', string(round(r2, 4)), "
                 "'slope_pct_per_hour', string(round(slope_pct, 4))",
        baseline_value="median", deviation_pct="coalesce(try_divide(observed - median, abs(median)), 0D) * 100D",
        amplitude=L.amplitude_sql("abs(slope_pct)", f"{float(lo or 0)!r}D", f"{float(hi or lo or 1)!r}D"),
        duration_min=length, forecast=forecast, threshold="median", samples="n")


# ------------------------------------------------------------------ instance skew
def instance_skew(inputs: Inputs, rule: Rule) -> DataFrame:
    """Worst instance of a service against the median of its instances' worst values."""
    metrics, need = rule.params["metrics"], max(2, int(rule.params.get("min_instances", 2)))
    f = inputs.facts.where(F.col("metric").isin(*metrics)).withColumn(
        "_worst", F.when(F.col("hib"), F.col("vmin")).otherwise(F.col("vmax")))
    keys = ["run_id", "service", "metric"]
    kept = ["instance", "_worst", "first_ts", "last_ts", "n", "window_minutes", "mode", "baseline_confidence",
            "instance_count", "criticality", "owner", "label", "unit"]
    # ties go to the smallest instance name
    per = f.groupBy(*keys).agg(
        F.count("*").alias("instances"), F.percentile("_worst", F.lit(0.5)).alias("baseline_value"),
        F.max("_worst").alias("_top"),
        F.min_by(F.struct(*kept), F.struct(-F.col("_worst"), F.col("instance"))).alias("r"))
    per = per.where((F.col("instances") >= need) & (F.col("baseline_value") > 0)).select(
        *keys, "instances", "baseline_value", "r.*").withColumn("observed", F.col("_worst"))
    ratio = F.try_divide(F.col("observed"), F.col("baseline_value"))
    floor = max(rule.bounds("ratio")[0] or SKEW_FLOOR, SKEW_FLOOR)
    per = per.withColumn("ratio", ratio).where((F.col("ratio") >= floor) & (F.col("instance_count") >= need))
    per = per.withColumn("deviation_pct", F.expr("(ratio - 1D) * 100D")).withColumn("level", F.expr(L.match_row_levels(rule, {
        "ratio": "ratio", "value": "observed", "deviation_pct": "deviation_pct"}))).where("level IS NOT NULL")
    lo, hi = rule.bounds("ratio")
    return _hits(
        per, rule, "'instances', string(instances), 'median_of_service', string(round(baseline_value, 2))",
        amplitude=L.amplitude_sql("ratio", f"{lo!r}D", f"{hi!r}D"), duration_min="window_minutes", first_seen="first_ts",
        last_seen="last_ts", threshold="baseline_value", samples="n")


# ------------------------------------------------------------------ dependency chains
def service_level(windowed_points: DataFrame) -> DataFrame:
    """Mean over a service's instances at timestamps where all of its reporting instances report.

    Instances without any sample in the window do not count. Pre-aggregates per (run,
    service, ts); the instance count per (run, service) is a small join.
    """
    per_ts = windowed_points.groupBy("run_id", "service", "ts").agg(F.count("*").alias("k"), F.avg("value").alias("value"))
    total = windowed_points.groupBy("run_id", "service").agg(F.countDistinct("instance").alias("instances"))
    return per_ts.join(total, ["run_id", "service"]).where(F.col("k") == F.col("instances")).select(
        "run_id", "service", "ts", "value", "instances")


def chain_health(inputs: Inputs, metric: str, min_length: int) -> DataFrame:
    """Worst path of every head: product of the nodes' success shares at the worst timestamp.

    The path with the lowest health wins (smallest path text on ties); the weakest node is
    the one with the lowest window mean, earliest on the path on ties. Paths are found layer by
    layer; where `inputs.paths` lists paths, each of them is followed instead.
    """
    spark = inputs.points.sparkSession
    declared = inputs.policy.declared_instances(spark)
    pts = assign_windows(
        inputs.points.where(F.col("metric") == metric).join(declared, ["service", "instance"], "left_semi"),
        inputs.windows.select("run_id", "window_start", "window_end"))
    svc, found = service_level(pts), []
    if inputs.paths is None:
        svc, found = write_stage(svc, "service-level"), ["run_id"]
        services = inputs.policy.service_dim(spark)
        e = edges(services)
        graph = inputs.graph or condense(e, services.select(F.col("service").alias("node")))
        listed = path_rows(worst_paths(graph, e, svc.withColumn("share", F.col("value") / 100.0), found, min_length), found)
    else:
        listed = inputs.paths
    means = svc.groupBy("run_id", "service").agg(F.avg("value").alias("node_mean"))
    base = inputs.base.where(F.col("metric") == metric).join(declared, ["service", "instance"], "left_semi").groupBy(
        "run_id", "service").agg(F.avg("median").alias("node_base"))
    paths = listed.select(*found, "head", "path_id", "pos", F.col("node").alias("service"), "path_len", "path_text").where(
        F.col("path_len") >= min_length)
    curve = paths.join(svc, [*found, "service"]).groupBy("run_id", "head", "path_id", "path_len", "path_text", "ts").agg(
        F.count("*").alias("k"), F.product(F.col("value") / 100.0).alias("health")).where(F.col("k") == F.col("path_len"))
    worst = curve.groupBy("run_id", "head", "path_id", "path_len", "path_text").agg(
        (F.min("health") * 100.0).alias("observed"), F.count("*").alias("samples"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    nodes = (
        paths.join(means, [*found, "service"]).join(base, ["run_id", "service"], "left")
        .groupBy("run_id", "head", "path_id").agg(
            (F.product(F.coalesce("node_base", F.lit(100.0)) / 100.0) * 100.0).alias("baseline_value"),
            F.min_by("service", F.struct("node_mean", "pos")).alias("weakest")))
    both = worst.join(nodes, ["run_id", "head", "path_id"])
    kept = [c for c in both.columns if c not in ("run_id", "head")]
    return both.groupBy("run_id", "head").agg(
        F.min_by(F.struct(*kept), F.struct("observed", "path_text")).alias("r")).select("run_id", "head", "r.*")


def chain_rule(inputs: Inputs, rule: Rule) -> DataFrame:
    metric = rule.params.get("health_metric", "success_rate")
    spark = inputs.points.sparkSession
    c = chain_health(inputs, metric, int(rule.params.get("min_path_length", 2)))
    c = c.withColumn("deviation_pct", F.expr("coalesce(try_divide(observed - baseline_value, baseline_value), 0D) * 100D"))
    c = c.withColumn("level", F.expr(L.match_row_levels(rule, {"deviation_pct": "deviation_pct", "value": "observed"})))
    lo, hi = rule.bounds("deviation_pct")
    dim = inputs.policy.service_dim(spark).select(F.col("service").alias("head"), "criticality", "owner", "instance_count")
    w = inputs.windows.selectExpr("run_id", "(unix_seconds(window_end) - unix_seconds(window_start)) / 60D AS duration_min")
    c = c.where("level IS NOT NULL").join(dim, "head").join(w, "run_id")
    return _hits(
        c, rule, "'chain', path_text, 'hop_count', string(path_len), 'weakest_node', weakest", service="head",
        instance="weakest", metric=f"'{metric}'", mode="'static_fallback'", baseline_confidence="'low'",
        amplitude=L.amplitude_sql("abs(deviation_pct)", f"{float(lo or 0)!r}D", f"{float(hi or 1)!r}D"),
        label="'chain health'", unit="'%'", path="path_text", threshold="baseline_value")


# ------------------------------------------------------------------ registry
RULE_KINDS: dict[str, Callable[[Inputs, Rule], DataFrame]] = {
    "long_tail": long_tail,
    "trend": trend_rule,
    "skew": instance_skew,
    "chain": chain_rule,
}


def findings(inputs: Inputs, rule_id: str) -> DataFrame:
    """Findings of one rule."""
    rule = inputs.policy.rule(rule_id)
    return finish(generic_hits(inputs, [rule_id]) if rule.kind == "generic" else RULE_KINDS[rule.kind](inputs, rule))


def all_findings(inputs: Inputs) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Findings of every rule of the policy, and the rules that could not be planned.

    A rule that fails to analyse is reported and left out; the others still run. New rule
    kinds register in RULE_KINDS and return HIT_COLS.
    """
    parts, failed = [generic_hits(inputs)], []
    for rule in inputs.policy.rules:
        if rule.kind == "generic":
            continue
        try:
            parts.append(RULE_KINDS[rule.kind](inputs, rule))
        except Exception as exc:  # noqa: BLE001 - one bad rule must not stop the rest
            failed.append((rule.rule_id, f"{type(exc).__name__}: {exc}"))
    return finish(reduce(DataFrame.unionByName, parts)), failed


def rule_hits(findings: DataFrame, runs: DataFrame, policy: Policy) -> DataFrame:
    """Findings per run and rule, zero for silent rules."""
    rules = policy.rules_dim(findings.sparkSession).select("rule_id")
    counts = findings.groupBy("run_id", "rule_id").agg(F.count("*").alias("hits"))
    return runs.select("run_id").crossJoin(rules).join(counts, ["run_id", "rule_id"], "left").withColumn(
        "hits", F.coalesce("hits", F.lit(0)))
