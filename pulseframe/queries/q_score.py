"""Stability scores."""

from pyspark.sql import functions as F

from pulseframe.operators import score as S
from pulseframe.policy import SCORE_WEIGHTS
from pulseframe.queries import fixtures as X
from pulseframe.queries.q_rules import inspection
from pulseframe.queries.registry import query, rnd, values_sql, view

_TOTAL = sum(len(s.instances) for s in X.policy().services)
view("part_dim", values_sql(["part", "weight"], list(SCORE_WEIGHTS.items()), {"weight": "DOUBLE"}))
view("budget", """
SELECT a.*, CASE a.metric WHEN 'business_error_rate' THEN greatest(0, a.observed / greatest(1e-6, be.slo))
  WHEN 'success_rate' THEN greatest(0, 100 - a.observed) / greatest(1e-6, 100 - sr.slo) ELSE 0 END AS budget_ratio
FROM active a JOIN slo_t be ON be.service = a.service AND be.metric = 'business_error_rate' JOIN slo_t sr ON sr.service = a.service AND sr.metric = 'success_rate'""")
view("parts", f"""
SELECT run_id, part, weight, anomalies, instances, deduction, round(weight - deduction, 1) AS score FROM (
  SELECT *, CASE WHEN anomalies = 0 THEN 0 ELSE round(weight * CASE part WHEN 'availability' THEN least(1, br / 10)
    ELSE 0.7 * amp + (1 - 0.7::DOUBLE) * least(1, instances / CAST({_TOTAL} AS DOUBLE)) END, 1) END AS deduction
  FROM (SELECT w.run_id, p.part, p.weight, count(b.anomaly_id) AS anomalies, count(DISTINCT b.instance) AS instances, max(b.budget_ratio) AS br, max(b.amplitude) AS amp
        FROM windows w CROSS JOIN part_dim p LEFT JOIN (SELECT b.*, part FROM budget b JOIN score_part USING (rule_id)) b ON b.run_id = w.run_id AND b.part = p.part GROUP BY ALL))""")
view("caps", """
SELECT w.run_id, count(a.anomaly_id) AS p1_count, least(CASE WHEN count(a.anomaly_id) > 0 THEN 60.0::DOUBLE END,
  CASE WHEN coalesce(max(a.criticality), 0) >= 0.9 THEN 45.0::DOUBLE END, CASE WHEN count(a.anomaly_id) >= 2 THEN 55.0::DOUBLE END) AS cap
FROM windows w LEFT JOIN (SELECT * FROM active WHERE level = 1) a USING (run_id) GROUP BY w.run_id""")
view("adj", "SELECT run_id, CAST(sum(CASE WHEN level = 4 THEN 1 ELSE -1 END) AS DOUBLE) AS adjust FROM active GROUP BY run_id")


def _totals_sql(adjust):
    return f"""
SELECT *, CASE WHEN total >= 90 THEN 'A' WHEN total >= 80 THEN 'B' WHEN total >= 70 THEN 'C' WHEN total >= 60 THEN 'D' ELSE 'E' END AS grade FROM (
  SELECT run_id, rule_score, adjust, cap, capped < rule_score AS was_capped, round(greatest(0, least(100, capped + adjust)), 1) AS total FROM (
    SELECT r.run_id, rule_score, cap, least(rule_score, coalesce(cap, rule_score)) AS capped, greatest(-5, least(5, {adjust})) AS adjust
    FROM (SELECT run_id, round(sum(score), 1) AS rule_score FROM parts GROUP BY run_id) r JOIN caps USING (run_id) LEFT JOIN adj a USING (run_id)))"""


view("totals", _totals_sql("0.0::DOUBLE"))
view("totals_adj", _totals_sql("coalesce(a.adjust, 0.0::DOUBLE)"))


@query("error_budget", "SELECT run_id, anomaly_id, rnd(budget_ratio, 4) AS budget_ratio FROM budget WHERE rule_id IN ('BIZ-01', 'BIZ-02', 'BIZ-06')")
def error_budget(spark, d):
    a = inspection(spark, d).active.where(F.col("rule_id").isin("BIZ-01", "BIZ-02", "BIZ-06"))
    return S.error_budget(a, X.policy()).select("run_id", "anomaly_id", rnd("budget_ratio").alias("budget_ratio"))


def _parts(spark, d):
    return S.breakdown(inspection(spark, d).active, X.windows(spark), X.policy())


_PART_SQL = "SELECT run_id, part, weight, CAST(anomalies AS BIGINT) AS anomalies, CAST(instances AS BIGINT) AS instances, deduction, score FROM parts"


@query("score_availability", _PART_SQL + " WHERE part = 'availability'")
def score_availability(spark, d):
    return _parts(spark, d).where("part = 'availability'")


@query("score_dimensions", _PART_SQL)
def score_dimensions(spark, d):
    return _parts(spark, d)


@query("score_caps", "SELECT run_id, CAST(p1_count AS BIGINT) AS p1_count, cap FROM caps")
def score_caps(spark, d):
    return S.caps(inspection(spark, d).active, X.windows(spark), X.policy())


@query("score_total", "SELECT run_id, rule_score, adjust, cap, was_capped, total, grade FROM totals_adj")
def score_total(spark, d):
    """With an outside adjustment of plus or minus a few points per run."""
    i = inspection(spark, d)
    adj = i.active.groupBy("run_id").agg(F.sum(F.when(F.col("level") == 4, 1.0).otherwise(-1.0)).alias("adjust"))
    return S.totals(S.breakdown(i.active, i.windows, i.policy), i.active, i.windows, i.policy, adj)


@query("score_grade", """
WITH g AS (SELECT DISTINCT CAST(user_id % 101 AS DOUBLE) AS total FROM events)
SELECT total, CASE WHEN total >= 90 THEN 'A' WHEN total >= 80 THEN 'B' WHEN total >= 70 THEN 'C' WHEN total >= 60 THEN 'D' ELSE 'E' END AS grade FROM g""")
def score_grade(spark, d):
    g = X.load(spark, d, "events").select((F.col("user_id") % 101).cast("double").alias("total")).distinct()
    return g.withColumn("grade", S.grade(F.col("total")))
