"""Rules on hand-made series."""

import math
import random

import pytest

from pulseframe.operators import rules as R
from pulseframe.operators.stats import trend
from pulseframe.policy import Level, Policy, Rule, Service
from tests.helpers import baseline, inputs, points, rows, small_policy


def run(spark, rule, series, base, **kw):
    return R.findings(inputs(spark, points(spark, *series), base, **kw), rule).collect()


def test_sustained_drop_is_p1(spark):
    v = [99.97] * 10 + [92.0] * 10 + [99.97] * 10
    f, = run(spark, "BIZ-01", [rows("success_rate", v)], baseline(spark, ("success_rate", 99.97)))
    assert f.level == 1 and f.duration_min == 10 and f.observed == 92.0
    assert "7.97 points" in f.reason and "92.00%" in f.reason


def test_transient_dip_is_not_severe(spark):
    v = [99.97] * 14 + [90.0] + [99.97] * 15
    f = run(spark, "BIZ-01", [rows("success_rate", v)], baseline(spark, ("success_rate", 99.97)))
    assert [x.level for x in f] == [3]


def test_traffic_drop_uses_the_minimum(spark):
    v = [1000.0] * 8 + [250.0] * 16 + [1000.0] * 6
    s, b = [rows("qps", v)], baseline(spark, ("qps", 1000.0, 50.0))
    f, = run(spark, "BIZ-04", s, b)
    assert f.level == 2 and f.observed == 250.0 and f.duration_min == 16
    assert run(spark, "BIZ-03", s, b) == []  # a drop is no surge, whatever its z


def test_surge_is_not_a_drop(spark):
    v = [1000.0] * 10 + [3500.0] * 20
    s, b = [rows("qps", v)], baseline(spark, ("qps", 1000.0, 50.0))
    f, = run(spark, "BIZ-03", s, b)
    assert f.level == 2
    assert run(spark, "BIZ-04", s, b) == []


def test_error_surge_needs_multiple_and_size(spark):
    b = baseline(spark, ("error_count", 100.0, 5.0))
    assert run(spark, "BIZ-05", [rows("error_count", [1200.0] * 10)], b)[0].level == 1
    small = baseline(spark, ("error_count", 1.0, 0.1))
    assert run(spark, "BIZ-05", [rows("error_count", [15.0] * 10)], small) == []


def test_slo_needs_its_own_two_minutes(spark):
    b = baseline(spark, ("success_rate", 99.95))
    one = [99.97] * 20 + [99.85] + [99.97] * 9
    two = [99.97] * 20 + [99.85] * 2 + [99.97] * 8
    assert run(spark, "BIZ-01", [rows("success_rate", one)], b) == []
    assert run(spark, "BIZ-01", [rows("success_rate", two)], b)[0].level == 4


def test_run_that_starts_at_the_last_sample(spark):
    f, = run(spark, "RES-01", [rows("cpu_usage", [50.0] * 29 + [86.0])], baseline(spark, ("cpu_usage", 50.0, 20.0)))
    assert f.level == 3 and f.first_seen == f.last_seen and f.duration_min == 1


def test_noise_is_no_trend_but_growth_is(spark):
    rnd = random.Random(7)
    noise = [200 + rnd.gauss(0, 12) for _ in range(30)]
    grow = [200 + 4 * i + rnd.gauss(0, 6) for i in range(30)]
    b = baseline(spark, ("latency_p99", 200.0, 10.0))
    assert run(spark, "PERF-05", [rows("latency_p99", noise)], b) == []
    f, = run(spark, "PERF-05", [rows("latency_p99", grow)], b)
    assert f.level == 1 and float(f.evidence["slope_pct_per_hour"]) > 60


def test_falling_series_only_without_direction(spark):
    v = [400 - 5 * i for i in range(30)]
    i = inputs(spark, points(spark, rows("latency_p99", v)), baseline(spark, ("latency_p99", 300.0, 10.0)))
    rule = i.policy.rule("PERF-05")
    assert R.trend_rule(i, rule).count() == 1
    assert R.trend_rule(i, rule, direction="up").count() == 0


def test_leak_forecast(spark):
    v = [40 + i * 54 / 60 for i in range(61)]
    f, = run(spark, "RES-03", [rows("mem_usage", v, step=1380)], baseline(spark, ("mem_usage", 45.0, 1.0)))
    assert f.level in (1, 2, 3) and f.duration_min == 1440
    assert f.level == 3 or "until 95%" in f.reason


def test_skew_names_the_hot_instance(spark):
    s = [rows("cpu_usage", [v] * 30, instance=f"order-svc-{i}") for i, v in enumerate((40.0, 96.0, 40.0))]
    b = baseline(spark, *[("cpu_usage", 40.0, 5.0, f"order-svc-{i}") for i in range(3)])
    f, = run(spark, "RES-05", s, b)
    assert f.instance == "order-svc-1" and f.level == 3 and f.baseline_value == 40.0


def test_levels_scale_with_the_service_line(spark):
    base = baseline(spark, ("latency_p99", 300.0, 50.0))
    s = [rows("latency_p99", [700.0] * 30)]
    assert run(spark, "PERF-01", s, base) == []
    strict = small_policy(threshold_overrides={"order-svc": {"latency_p99": {"max": 500.0}}})
    assert run(spark, "PERF-01", s, base, policy=strict)[0].level == 3


def test_static_fallback_without_baseline(spark):
    empty = baseline(spark, ("latency_p99", 1.0)).where("false")
    f, = run(spark, "PERF-01", [rows("latency_p99", [2500.0] * 10)], empty)
    assert f.level == 2 and f.baseline_mode == "static_fallback" and f.baseline_value == 800.0


def test_too_few_samples(spark):
    assert run(spark, "BIZ-01", [rows("success_rate", [99.0, 95.0])], baseline(spark, ("success_rate", 99.97))) == []


def test_long_tail_needs_both_sides(spark):
    s = [rows("latency_p99", [200.0] * 29 + [1000.0]), rows("latency_p50", [40.0] * 30)]
    b = baseline(spark, ("latency_p99", 200.0, 10.0), ("latency_p50", 40.0, 2.0))
    f, = run(spark, "PERF-04", s, b)
    assert f.level == 1 and f.observed == 25.0 and f.baseline_value == 5.0 and f.z_score == 0.0
    assert run(spark, "PERF-04", s, b.where("metric = 'latency_p99'")) == []


def test_chain_takes_the_worst_path_and_weakest_node(spark):
    pol = small_policy(services=[
        Service("gw", ["gw-0"], ["good", "bad"]), Service("good", ["good-0"]), Service("bad", ["bad-0"])])
    s = [rows("success_rate", [100.0] * 30, "gw", "gw-0"), rows("success_rate", [100.0] * 30, "good", "good-0"),
         rows("success_rate", [100.0] * 29 + [90.0], "bad", "bad-0")]
    b = baseline(spark, *[("success_rate", 100.0, None, f"{n}-0", n) for n in ("gw", "good", "bad")])
    f, = run(spark, "BIZ-06", s, b, policy=pol)
    assert f.service == "gw" and f.instance == "bad" and abs(f.observed - 90.0) < 1e-9 and f.level == 1
    assert f.evidence["chain"] == "gw -> bad"


def test_one_broken_rule_does_not_stop_the_rest(spark):
    pol = small_policy()
    i = inputs(spark, points(spark, rows("cpu_usage", [97.0] * 30)), baseline(spark, ("cpu_usage", 40.0, 1.0)), policy=pol)
    broken = Rule("X-01", "broken", "business", "no-such-kind", {}, [Level(1, {"value": 1.0})])
    i.policy = Policy(services=pol.services, rules=[*pol.rules, broken])
    df, failed = R.all_findings(i)
    assert [r for r, _ in failed] == ["X-01"]
    assert {r.rule_id for r in df.collect()} >= {"RES-01"}


def test_constant_and_exact_lines(spark):
    p = points(spark, rows("qps", [5.0] * 10), rows("cpu_usage", [float(i) for i in range(10)]))
    t = {r.metric: r for r in trend(p, ["service", "instance", "metric"]).collect()}
    assert t["qps"].slope == 0 and t["qps"].r2 == 0 and t["qps"].t_stat == 0
    assert math.isinf(t["cpu_usage"].t_stat) and t["cpu_usage"].r2 == 1.0


def test_policy_mistakes_are_caught():
    with pytest.raises(ValueError, match="unknown condition"):
        Policy(services=[], rules=[Rule("A", "a", "business", "generic", {"metric": "qps"}, [Level(1, {"valu": 1})])])
    with pytest.raises(ValueError, match="depends on unknown"):
        Policy(services=[Service("a", [], ["b"])])
