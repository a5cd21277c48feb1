"""Inspection policy: metric catalogue, rule levels, thresholds, objectives, score weights.

A policy is at most a few hundred rows of configuration. It lives on the driver and enters
the plans as literal tables, so the optimizer knows each one's size.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from pulseframe.session import literal_table, write_stage

# ---- fixed values: metric catalogue (unit, label, higher is better, valid low, valid high) ----
METRICS = {
    "qps": ("req/s", "QPS", False, 0.0, 5_000_000.0),
    "success_rate": ("%", "success rate", True, 0.0, 100.0),
    "error_count": ("count", "error count", False, 0.0, 1e9),
    "business_error_rate": ("%", "business error rate", False, 0.0, 100.0),
    "latency_p50": ("ms", "P50 latency", False, 0.0, 3_600_000.0),
    "latency_p95": ("ms", "P95 latency", False, 0.0, 3_600_000.0),
    "latency_p99": ("ms", "P99 latency", False, 0.0, 3_600_000.0),
    "cpu_usage": ("%", "CPU usage", False, 0.0, 100.0),
    "mem_usage": ("%", "memory usage", False, 0.0, 100.0),
    "conn_usage": ("%", "connection pool usage", False, 0.0, 100.0),
}

# ---- fixed values: unit conversions (from, to, factor) ----
UNIT_FACTORS = [
    ("s", "ms", 1000.0),
    ("second", "ms", 1000.0),
    ("us", "ms", 0.001),
    ("µs", "ms", 0.001),
    ("ratio", "%", 100.0),
    ("fraction", "%", 100.0),
    ("req/min", "req/s", 1 / 60.0),
]

# ---- fixed values: objective field of a metric ----
SLO_FIELD = {
    "success_rate": "success_rate",
    "business_error_rate": "business_error_rate",
    "latency_p95": "latency_p95_ms",
    "latency_p99": "latency_p99_ms",
}

# ---- fixed values: default red lines and objectives ----
DEFAULT_THRESHOLDS = {
    "success_rate": {"min": 99.0},
    "business_error_rate": {"max": 1.0},
    "latency_p95": {"max": 300.0},
    "latency_p99": {"max": 800.0},
    "cpu_usage": {"max": 85.0},
    "mem_usage": {"max": 85.0},
    "conn_usage": {"max": 90.0},
}
DEFAULT_SLO = {"success_rate": 99.9, "latency_p99_ms": 800.0, "latency_p95_ms": 300.0, "business_error_rate": 1.0}

# ---- fixed values: amplitude range of each level, cluster level score, dimension affinity ----
LEVEL_BAND = {1: (0.75, 1.00), 2: (0.55, 0.84), 3: (0.35, 0.64), 4: (0.15, 0.40)}
LEVEL_SCORE = {1: 1.0, 2: 0.70, 3: 0.45, 4: 0.20}
AFFINITY = {"resource": 1.00, "performance": 0.70, "business": 0.30, "link": 0.20}

# ---- fixed values: rules behind each score part, part weights, score caps ----
SCORE_RULES = {
    "availability": ["BIZ-01", "BIZ-02", "BIZ-06"],
    "performance": ["PERF-01", "PERF-02", "PERF-03", "PERF-04", "PERF-05"],
    "resource": ["RES-01", "RES-02", "RES-03", "RES-04"],
    "stability": ["BIZ-03", "BIZ-04", "BIZ-05", "RES-05"],
}
SCORE_WEIGHTS = {"availability": 40.0, "performance": 25.0, "resource": 20.0, "stability": 15.0}
SCORE_CAPS = [("has_p1", 60.0), ("p1_on_critical", 45.0), ("p1_count_ge:2", 55.0)]

# ---- fixed values: cause categories ----
CATEGORIES = [
    "traffic_fluctuation", "resource_bottleneck", "code_defect", "dependency_failure",
    "change_induced", "capacity_config", "unknown",
]

#: condition keys that can be tested sample by sample
POINTWISE = ("value", "deviation_pct", "z_score", "drop_points", "rise_points", "down_pct", "multiplier")
#: every numeric condition key a level may use
CONDITION_KEYS = POINTWISE + (
    "cv", "ratio", "ratio_rise_pct", "slope_pct_per_hour", "min_absolute", "duration_minutes")


@dataclass(frozen=True)
class Level:
    level: int
    when: dict[str, Any]
    reason: str = ""


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    dimension: str
    kind: str  # generic | chain | long_tail | trend | skew
    params: dict[str, Any]
    levels: list[Level]

    def bounds(self, key: str) -> tuple[float | None, float | None]:
        """Mildest and strictest threshold of one condition key over the levels."""
        values = [float(lv.when[key]) for lv in self.levels if key in lv.when]
        return (min(values), max(values)) if values else (None, None)


@dataclass(frozen=True)
class Service:
    name: str
    instances: list[str]
    depends_on: list[str] = field(default_factory=list)
    group: str = "default"
    tier: str | None = None
    external: bool = False
    criticality: float = 0.5
    owner: str | None = None
    slo: dict[str, float] = field(default_factory=dict)


#: what a condition says in a reason, by its key
CONDITION_TEXTS = {
    "drop_points": "{drop} points lower than the usual {baseline}",
    "rise_points": "{rise} points higher than the usual {baseline}",
    "multiplier": "{multiplier} times the usual {baseline}",
    "down_pct": "{deviation}% less than the usual {baseline}",
    "deviation_pct": "{deviation}% less than the usual {baseline}",
    "value": "limit {threshold}",
    "cv": "varies by {cv} of its mean",
    "ratio": "ratio {ratio}",
    "slope_pct_per_hour": "changes by {slope}% an hour",
    "z_score": "outside its usual range around {baseline}",
    "below_slo": "objective {slo}",
    "duration_minutes": "lasting {duration} min",
}


def _levels(name: str, subject: str, *rows) -> list[Level]:
    """Levels whose reasons are put together from the rule's name, its subject and its conditions.

    A text before the levels (a forecast) takes the place of the limit.
    """
    texts = dict(CONDITION_TEXTS)
    if rows and isinstance(rows[0], str):
        texts["value"], rows = rows[0], rows[1:]
    return [Level(level, when, "; ".join([f"{name}: {subject}", *(texts[k] for k in when if k in texts)])) for level, when in rows]


# ---- fixed values: the sixteen rules and their level thresholds ----
RULES = [
    Rule("BIZ-01", "success rate drop", "business", "generic", {"metric": "success_rate", "min_samples": 5}, _levels("success rate drop", "{observed}",
        (1, {"drop_points": 5.0, "duration_minutes": 3}),
        (2, {"drop_points": 2.0, "duration_minutes": 2}),
        (3, {"drop_points": 0.5}),
        (4, {"below_slo": True, "duration_minutes": 2}))),
    Rule("BIZ-02", "business error rate rise", "business", "generic", {"metric": "business_error_rate"}, _levels("business error rate rise", "{observed}",
        (1, {"rise_points": 8.0, "duration_minutes": 3}),
        (2, {"rise_points": 3.0, "duration_minutes": 2}),
        (3, {"rise_points": 1.0}),
        (4, {"rise_points": 0.5}))),
    Rule("BIZ-03", "traffic surge", "business", "generic", {"metric": "qps", "direction": "up"}, _levels("traffic surge", "{observed}",
        (1, {"multiplier": 5.0, "duration_minutes": 5}),
        (2, {"multiplier": 3.0, "duration_minutes": 3}),
        (3, {"multiplier": 2.0}),
        (4, {"z_score": 4.0}))),
    Rule("BIZ-04", "traffic drop", "business", "generic", {"metric": "qps", "direction": "down"}, _levels("traffic drop", "{observed}",
        (1, {"down_pct": 80.0, "duration_minutes": 3}),
        (2, {"down_pct": 50.0, "duration_minutes": 2}),
        (3, {"down_pct": 30.0}),
        (4, {"z_score": 4.0}))),
    Rule("BIZ-05", "error surge", "business", "generic", {"metric": "error_count"}, _levels("error surge", "{observed}",
        (1, {"multiplier": 10.0, "min_absolute": 500.0}),
        (2, {"multiplier": 5.0, "min_absolute": 200.0}),
        (3, {"multiplier": 3.0, "min_absolute": 50.0}),
        (4, {"multiplier": 2.0, "min_absolute": 20.0}))),
    Rule("BIZ-06", "dependency chain health", "link", "chain", {"health_metric": "success_rate", "min_path_length": 2}, _levels("dependency chain health", "{path} at {observed}, weakest {instance}",
        (1, {"deviation_pct": 7.0}),
        (2, {"deviation_pct": 3.0}),
        (3, {"deviation_pct": 1.0}),
        (4, {"deviation_pct": 0.3}))),
    Rule("PERF-01", "P99 latency over limit", "performance", "generic", {"metric": "latency_p99"}, _levels("P99 latency over limit", "{observed}",
        (1, {"value": 3000.0, "duration_minutes": 3}),
        (2, {"value": 1500.0, "duration_minutes": 2}),
        (3, {"value": 800.0}),
        (4, {"value": 760.0}))),
    Rule("PERF-02", "P95 latency over limit", "performance", "generic", {"metric": "latency_p95"}, _levels("P95 latency over limit", "{observed}",
        (1, {"value": 1000.0, "duration_minutes": 3}),
        (2, {"value": 500.0, "duration_minutes": 2}),
        (3, {"value": 300.0}),
        (4, {"value": 285.0}))),
    Rule("PERF-03", "latency jitter", "performance", "generic", {"metric": "latency_p99", "min_samples": 5}, _levels("latency jitter", "{observed}",
        (1, {"cv": 1.0, "value": 800.0}),
        (2, {"cv": 0.6, "value": 500.0}),
        (3, {"cv": 0.4}),
        (4, {"cv": 0.25}))),
    Rule("PERF-04", "long tail", "performance", "long_tail", {"numerator": "latency_p99", "denominator": "latency_p50"}, _levels("long tail", "{observed}",
        (1, {"ratio": 20.0, "ratio_rise_pct": 200.0}),
        (2, {"ratio": 12.0, "ratio_rise_pct": 100.0}),
        (3, {"ratio": 8.0, "ratio_rise_pct": 50.0}),
        (4, {"ratio": 6.0}))),
    Rule("PERF-05", "latency trend", "performance", "trend", {"metric": "latency_p99", "min_samples": 8, "min_t_stat": 3.0, "min_r2": 0.5}, _levels("latency trend", "{observed}",
        (1, {"slope_pct_per_hour": 60.0}),
        (2, {"slope_pct_per_hour": 30.0}),
        (3, {"slope_pct_per_hour": 15.0}),
        (4, {"slope_pct_per_hour": 8.0}))),
    Rule("RES-01", "CPU high", "resource", "generic", {"metric": "cpu_usage"}, _levels("CPU high", "{observed}",
        (1, {"value": 95.0, "duration_minutes": 5}),
        (2, {"value": 90.0, "duration_minutes": 3}),
        (3, {"value": 85.0}),
        (4, {"z_score": 4.0}))),
    Rule("RES-02", "memory high", "resource", "generic", {"metric": "mem_usage"}, _levels("memory high", "{observed}",
        (1, {"value": 95.0, "duration_minutes": 5}),
        (2, {"value": 90.0, "duration_minutes": 3}),
        (3, {"value": 85.0}),
        (4, {"z_score": 4.0}))),
    Rule("RES-03", "memory growth", "resource", "trend", {"metric": "mem_usage", "lookback_hours": 24, "min_samples": 20, "min_t_stat": 3.0, "min_r2": 0.6}, _levels("memory growth", "{observed}", "{forecast}",
        (1, {"slope_pct_per_hour": 3.0, "value": 80.0}),
        (2, {"slope_pct_per_hour": 1.5, "value": 70.0}),
        (3, {"slope_pct_per_hour": 0.8}),
        (4, {"slope_pct_per_hour": 0.4}))),
    Rule("RES-04", "connections exhausted", "resource", "generic", {"metric": "conn_usage"}, _levels("connections exhausted", "{observed}",
        (1, {"value": 95.0, "duration_minutes": 3}),
        (2, {"value": 90.0, "duration_minutes": 2}),
        (3, {"value": 80.0}),
        (4, {"z_score": 4.0}))),
    Rule("RES-05", "instance skew", "resource", "skew", {"metrics": ["cpu_usage", "mem_usage", "conn_usage", "latency_p99"], "min_instances": 2}, _levels("instance skew", "{metric} of {instance} at {observed}",
        (2, {"ratio": 3.0, "value": 80.0}),
        (3, {"ratio": 1.8}),
        (4, {"ratio": 1.5}))),
]


@dataclass(frozen=True)
class Policy:
    services: list[Service]
    rules: list[Rule] = field(default_factory=lambda: list(RULES))
    thresholds: dict[str, dict[str, float]] = field(default_factory=lambda: dict(DEFAULT_THRESHOLDS))
    threshold_overrides: dict[str, dict[str, dict[str, float]]] = field(default_factory=dict)
    slo: dict[str, float] = field(default_factory=lambda: dict(DEFAULT_SLO))
    tz: str = "UTC"
    granularity_seconds: int = 60
    max_gap_buckets: int = 3
    baseline_min_samples: int = 30
    band_k: float = 4.0
    adjust_limit: float = 5.0

    def __post_init__(self):
        problems = self.problems()
        if problems:
            raise ValueError("; ".join(problems))

    def problems(self) -> list[str]:
        """Configuration mistakes that would otherwise make a rule silently never fire."""
        out = []
        for r in self.rules:
            for lv in r.levels:
                for key in lv.when:
                    if key not in CONDITION_KEYS and key != "below_slo":
                        out.append(f"rule {r.rule_id} P{lv.level}: unknown condition {key}")
            if [lv.level for lv in r.levels] != sorted(lv.level for lv in r.levels):
                out.append(f"rule {r.rule_id}: levels must run from P1 to P4")
        known = {s.name for s in self.services}
        out += [f"service {s.name} depends on unknown {d}" for s in self.services for d in s.depends_on if d not in known]
        return out

    def rule(self, rule_id: str) -> Rule:
        return next(r for r in self.rules if r.rule_id == rule_id)

    def with_rules(self, *rules: Rule) -> "Policy":
        new = {r.rule_id: r for r in rules}
        return replace(self, rules=[new.get(r.rule_id, r) for r in self.rules])

    def max_lookback_seconds(self, window_seconds: int) -> int:
        """How far before a window's end any rule reads: bounds the range a scan must cover."""
        hours = [float(r.params.get("lookback_hours", 0)) for r in self.rules]
        return int(max([window_seconds, *(h * 3600 for h in hours)]))

    # ---------------------------------------------------------------- literal tables
    def catalog(self, spark: SparkSession) -> DataFrame:
        return literal_table(
            spark,
            [("metric", "string"), ("unit", "string"), ("label", "string"), ("hib", "boolean"), ("lo", "double"), ("hi", "double")],
            [(m, *v) for m, v in METRICS.items()])

    def unit_factors(self, spark: SparkSession) -> DataFrame:
        return literal_table(spark, [("src_unit", "string"), ("unit", "string"), ("factor", "double")], UNIT_FACTORS)

    def service_dim(self, spark: SparkSession) -> DataFrame:
        return literal_table(
            spark,
            [("service", "string"), ("grp", "string"), ("tier", "string"), ("external", "boolean"), ("criticality", "double"),
             ("owner", "string"), ("instances", "array<string>"), ("depends_on", "array<string>"), ("instance_count", "int")],
            [(s.name, s.group, s.tier, s.external, float(s.criticality), s.owner or "unassigned", s.instances, s.depends_on,
              len(s.instances)) for s in self.services])

    def threshold_defaults(self, spark: SparkSession) -> DataFrame:
        return literal_table(
            spark, [("metric", "string"), ("default_min", "double"), ("default_max", "double")],
            [(m, _f(t.get("min")), _f(t.get("max"))) for m, t in self.thresholds.items()])

    def threshold_override_dim(self, spark: SparkSession) -> DataFrame:
        return literal_table(
            spark, [("service", "string"), ("metric", "string"), ("over_min", "double"), ("over_max", "double")],
            [(s, m, _f(t.get("min")), _f(t.get("max"))) for s, ms in self.threshold_overrides.items() for m, t in ms.items()])

    def slo_default_dim(self, spark: SparkSession) -> DataFrame:
        return literal_table(
            spark, [("metric", "string"), ("default_slo", "double")],
            [(m, float(self.slo[f])) for m, f in SLO_FIELD.items() if f in self.slo])

    def slo_override_dim(self, spark: SparkSession) -> DataFrame:
        return literal_table(
            spark, [("service", "string"), ("metric", "string"), ("over_slo", "double")],
            [(s.name, m, float(s.slo[f])) for s in self.services for m, f in SLO_FIELD.items() if f in s.slo])

    def rules_dim(self, spark: SparkSession) -> DataFrame:
        return literal_table(
            spark, [("rule_id", "string"), ("rule_name", "string"), ("dimension", "string")],
            [(r.rule_id, r.name, r.dimension) for r in self.rules])

    def declared_instances(self, spark: SparkSession) -> DataFrame:
        """(service, instance) of the topology."""
        return self.service_dim(spark).selectExpr("service", "explode(instances) AS instance")

    def series_dim(self, spark: SparkSession) -> DataFrame:
        """Everything the policy says about a (service, metric), resolved once on the driver.

        It is written to the stage folder, so joins are planned by its true size.
        """
        cols = [("service", "string"), ("metric", "string"), ("unit", "string"), ("label", "string"), ("hib", "boolean"),
                ("red_min", "double"), ("red_max", "double"), ("default_max", "double"), ("slo", "double"),
                ("criticality", "double"), ("owner", "string"), ("instance_count", "int")]
        rows = []
        for s in self.services:
            for m, (unit, label, hib, _, _) in METRICS.items():
                default = self.thresholds.get(m, {})
                line = self.threshold_overrides.get(s.name, {}).get(m, default)
                objective = {**self.slo, **s.slo}.get(SLO_FIELD.get(m))
                rows.append((s.name, m, unit, label, hib, _f(line.get("min")), _f(line.get("max")), _f(default.get("max")),
                             _f(objective), float(s.criticality), s.owner or "unassigned", len(s.instances)))
        return write_stage(spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in cols)), "series-policy")

    def generic_levels(self, spark: SparkSession, rule_ids: list[str] | None = None) -> DataFrame:
        """One row per level of each generic rule, with a nullable column per condition key
        and the mildest/strictest threshold of every key that feeds the amplitude."""
        amp_keys = [*POINTWISE, "cv"]
        cols = [("rule_id", "string"), ("dimension", "string"), ("metric", "string"), ("direction", "string"),
                ("min_samples", "int"), ("level", "int"), ("reason_template", "string"),
                ("t_below_slo", "boolean"), ("t_min_absolute", "double"), ("t_duration", "double")]
        cols += [(f"t_{k}", "double") for k in amp_keys]
        cols += [(f"{side}_{k}", "double") for k in amp_keys for side in ("lo", "hi")]
        rows = []
        for r in self.rules:
            if r.kind != "generic" or (rule_ids and r.rule_id not in rule_ids):
                continue
            for lv in r.levels:
                rows.append((
                    r.rule_id, r.dimension, r.params["metric"], r.params.get("direction"), int(r.params.get("min_samples", 3)),
                    lv.level, lv.reason, lv.when.get("below_slo"), _f(lv.when.get("min_absolute")),
                    _f(lv.when.get("duration_minutes", 0)),
                    *(_f(lv.when.get(k)) for k in amp_keys),
                    *(b for k in amp_keys for b in r.bounds(k))))
        return literal_table(spark, cols, rows)

    def score_dim(self, spark: SparkSession) -> DataFrame:
        return literal_table(spark, [("part", "string"), ("weight", "double")], list(SCORE_WEIGHTS.items()))

    def score_rule_dim(self, spark: SparkSession) -> DataFrame:
        return literal_table(
            spark, [("rule_id", "string"), ("part", "string")],
            [(r, p) for p, rs in SCORE_RULES.items() for r in rs])


def _f(v):
    return None if v is None else float(v)


def default_policy() -> Policy:
    """A small example: a shop front over a cart, a ledger and a stock database."""
    return Policy(
        services=[
            Service("front", ["front-0", "front-1"], ["cart", "ledger"], "shop", "entry", criticality=1.0, slo={"latency_p99_ms": 450.0}),
            Service("cart", ["cart-0", "cart-1"], ["stock-db"], "shop", "core", criticality=0.9),
            Service("ledger", ["ledger-0"], [], "money", "core", criticality=1.0),
            Service("stock-db", ["stock-db-0"], [], "outside", "external", True, 0.7),
        ],
        threshold_overrides={"front": {"latency_p99": {"max": 450.0}}, "stock-db": {"conn_usage": {"max": 88.0}}},
    )
