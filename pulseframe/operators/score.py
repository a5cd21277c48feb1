"""Explainable 0..100 stability score of each run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.policy import SCORE_CAPS, Policy

# fixed values: share of severity against reach, budget multiple that counts as fully lost
AMPLITUDE_SHARE = 0.7
BUDGET_FAILURE_RATIO = 10.0
CRITICAL = 0.9


def error_budget(active: DataFrame, policy: Policy) -> DataFrame:
    """Actual error rate over the objective's allowance, for anomalies on availability metrics."""
    spark = active.sparkSession
    d = policy.slo
    dim = policy.service_dim(spark).select("service")
    over = policy.slo_override_dim(spark)

    def of(metric, name):
        return dim.join(over.where(F.col("metric") == metric), "service", "left").select(
            "service", F.coalesce("over_slo", F.lit(float(d[metric]))).alias(name))

    slo = of("success_rate", "_sr").join(of("business_error_rate", "_be"), "service")
    a = active.join(slo, "service", "left")
    sr, be = F.coalesce("_sr", F.lit(float(d["success_rate"]))), F.coalesce("_be", F.lit(float(d["business_error_rate"])))
    tiny = F.lit(1e-6)
    ratio = (
        F.when(F.col("metric") == "business_error_rate",
               F.greatest(F.lit(0.0), F.col("observed") / F.greatest(tiny, be)))
        .when(F.col("metric") == "success_rate",
              F.greatest(F.lit(0.0), 100.0 - F.col("observed")) / F.greatest(tiny, 100.0 - sr))
        .otherwise(F.lit(0.0)))
    return a.withColumn("budget_ratio", ratio).drop("_sr", "_be")


def breakdown(active: DataFrame, runs: DataFrame, policy: Policy) -> DataFrame:
    """Deduction and remaining score per run and part; parts without anomalies stay full."""
    spark = active.sparkSession
    total_instances = max(1, sum(len(s.instances) for s in policy.services))
    a = error_budget(active, policy).join(policy.score_rule_dim(spark), "rule_id")
    per = a.groupBy("run_id", "part").agg(
        F.count("*").alias("anomalies"), F.max("budget_ratio").alias("budget_ratio"), F.max("amplitude").alias("amplitude"),
        F.countDistinct("instance").alias("instances"))
    out = runs.select("run_id").crossJoin(policy.score_dim(spark)).join(per, ["run_id", "part"], "left")
    scope = F.least(F.lit(1.0), F.coalesce("instances", F.lit(0)) / float(total_instances))
    share = F.when(
        F.col("part") == "availability",
        F.least(F.lit(1.0), F.coalesce("budget_ratio", F.lit(0.0)) / BUDGET_FAILURE_RATIO),
    ).otherwise(AMPLITUDE_SHARE * F.coalesce("amplitude", F.lit(0.0)) + (1 - AMPLITUDE_SHARE) * scope)
    ded = F.when(F.coalesce("anomalies", F.lit(0)) == 0, 0.0).otherwise(F.round(F.col("weight") * share, 1))
    return out.withColumn("deduction", ded).withColumn("score", F.round(F.col("weight") - F.col("deduction"), 1)).select(
        "run_id", "part", "weight", F.coalesce("anomalies", F.lit(0)).alias("anomalies"),
        F.coalesce("instances", F.lit(0)).alias("instances"), "deduction", "score")


def caps(active: DataFrame, runs: DataFrame, policy: Policy) -> DataFrame:
    """Strictest applicable cap of each run, NULL without one."""
    crit = policy.service_dim(active.sparkSession).select("service", "criticality")
    f = active.where("level = 1").join(crit, "service", "left").groupBy("run_id").agg(
        F.count("*").alias("p1"), F.max(F.coalesce("criticality", F.lit(0.5))).alias("crit"))
    out = runs.select("run_id").join(f, "run_id", "left")
    p1 = F.coalesce("p1", F.lit(0))
    facts = {"has_p1": p1 > 0, "p1_on_critical": F.coalesce("crit", F.lit(0.0)) >= CRITICAL}
    limits: list[Column] = []
    for cond, limit in SCORE_CAPS:
        name, _, n = cond.partition(":")
        hit = p1 >= float(n) if n else facts[name]
        limits.append(F.when(hit, F.lit(limit)))
    return out.select("run_id", p1.alias("p1_count"), F.least(*limits).alias("cap"))


def totals(parts: DataFrame, active: DataFrame, runs: DataFrame, policy: Policy, adjust: DataFrame | None = None) -> DataFrame:
    """Capped total with a bounded outside adjustment (run_id, adjust), and its grade."""
    rule = parts.groupBy("run_id").agg(F.round(F.sum("score"), 1).alias("rule_score"))
    out = rule.join(caps(active, runs, policy), "run_id")
    if adjust is None:
        out = out.withColumn("adjust", F.lit(0.0))
    else:
        out = out.join(adjust, "run_id", "left").withColumn("adjust", F.coalesce("adjust", F.lit(0.0)))
    lim = F.lit(policy.adjust_limit)
    out = out.withColumn("adjust", F.greatest(-lim, F.least(lim, F.col("adjust"))))
    capped = F.least("rule_score", F.coalesce("cap", F.col("rule_score")))
    out = out.withColumn("was_capped", capped < F.col("rule_score")).withColumn("total", F.round(
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), capped + F.col("adjust"))), 1))
    return out.withColumn("grade", grade(F.col("total"))).select(
        "run_id", "rule_score", "adjust", "cap", "was_capped", "total", "grade")


def grade(total: Column) -> Column:
    return (
        F.when(total >= 90, "A").when(total >= 80, "B").when(total >= 70, "C").when(total >= 60, "D").otherwise("E"))
