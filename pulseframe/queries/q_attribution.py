"""Change correlation, cause attribution and checks on outside conclusions."""

from pyspark.sql import functions as F

from pulseframe.operators import attribution as AT
from pulseframe.operators import clusters as CL
from pulseframe.operators import stats as S
from pulseframe.queries import fixtures as X
from pulseframe.queries.q_rules import inspection
from pulseframe.queries.q_stats import RK
from pulseframe.queries.registry import query, rnd, values_sql, view
from pulseframe.schemas import RKEY
from pulseframe.sources.changes import visible_per_run

HOURS = 168

view("vis", f"""
SELECT w.run_id, c.* FROM windows w JOIN chg c ON c.t >= w.we - {HOURS * 3600} AND c.t <= w.we
  AND (c.scenario_id IS NULL OR c.scenario_id = w.scenario_id)""")
view("rec", """
SELECT run_id, cluster_id, arg_min(change_id, (dt, change_id)) AS change_id, min(dt) / CAST(60 AS DOUBLE) AS minutes_before FROM (
  SELECT c.run_id, c.cluster_id, v.change_id, c.pfirst - v.t AS dt FROM clus c JOIN vis v ON v.run_id = c.run_id AND list_contains(c.services, v.service)
  WHERE c.pfirst - v.t BETWEEN 0 AND 1800) GROUP BY ALL""")
view("playbook", values_sql(["category", "playbook"], list(AT.PLAYBOOK.items())))
view("attr", """
SELECT *, CASE WHEN category = 'unknown' THEN CAST(0.25 AS DOUBLE) ELSE round(least(0.9, CASE WHEN category = 'change_induced' THEN 0.85::DOUBLE ELSE 0.55::DOUBLE END
    + CASE WHEN size >= 3 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN pmode = 'dynamic' THEN 0.05::DOUBLE ELSE 0 END), 2) END AS confidence FROM (
  SELECT c.*, r.change_id, r.minutes_before, CASE WHEN r.change_id IS NOT NULL THEN 'change_induced' WHEN pr IN ('BIZ-03', 'BIZ-04') THEN 'traffic_fluctuation'
    WHEN pr = 'RES-04' AND (list_contains(rules, 'PERF-01') OR list_contains(rules, 'PERF-02')) THEN CASE WHEN len(downstream) > 0 THEN 'dependency_failure' ELSE 'resource_bottleneck' END
    WHEN pr IN ('RES-01', 'RES-02', 'RES-04') THEN 'resource_bottleneck' WHEN pr = 'RES-03' THEN 'code_defect' WHEN pr = 'RES-05' THEN 'capacity_config'
    WHEN pr = 'BIZ-02' THEN 'code_defect' WHEN pdim = 'performance' THEN 'resource_bottleneck' ELSE 'unknown' END AS category
  FROM clus_h c LEFT JOIN rec r USING (run_id, cluster_id))""")


def visible(spark, d):
    return visible_per_run(X.changes(spark, d), X.windows(spark), HOURS)


def conclusions(spark, d, i):
    return AT.attribute(i.clusters, visible(spark, d), i.services)


@query("asof_change", """
SELECT event_id, change_id, minutes_before FROM (
  SELECT e.event_id, arg_min(c.change_id, (e.t - c.t, c.change_id)) AS change_id, rnd(min(e.t - c.t) / CAST(60 AS DOUBLE), 4) AS minutes_before
  FROM ev e JOIN chg c ON c.service = e.service AND e.t - c.t BETWEEN 0 AND 1800 WHERE e.event_type = 'error' GROUP BY e.event_id)""")
def asof_change(spark, d):
    """Nearest change within half an hour before every error event."""
    o = X.events(spark, d).where("event_type = 'error'").select("event_id", "service", F.col("ts").alias("onset"))
    return AT.asof_change(o, X.changes(spark, d), ["event_id"]).select("event_id", "change_id", rnd("minutes_before").alias("minutes_before"))


@query("changes_near", """
SELECT w.run_id, c.change_id, rnd((w.we - c.t) / CAST(60 AS DOUBLE), 4) AS minutes_before FROM windows w JOIN chg c ON abs(w.we - c.t) <= 7200""")
def changes_near(spark, d):
    a = X.windows(spark).select("run_id", F.col("window_end").alias("ts_anchor"))
    return AT.changes_near(a, X.changes(spark, d), ["run_id"]).select("run_id", "change_id", rnd("minutes_before").alias("minutes_before"))


@query("change_distance", """
SELECT v.run_id, v.change_id, rnd(round((f.e - v.t) / CAST(60 AS DOUBLE), 1), 1) AS minutes_before, round((f.e - v.t) / CAST(60 AS DOUBLE), 1) BETWEEN 0 AND 30 AS within_window
FROM vis v JOIN (SELECT run_id, min(pfirst) AS e FROM clus GROUP BY run_id) f USING (run_id)
WHERE EXISTS (SELECT 1 FROM clus c WHERE c.run_id = v.run_id AND list_contains(c.services, v.service))""")
def change_distance(spark, d):
    c = AT.change_distance(visible(spark, d), inspection(spark, d).clusters)
    return c.select("run_id", "change_id", rnd("minutes_before", 1).alias("minutes_before"), "within_window")


@query("attribute_category", "SELECT run_id, cluster_id, category, ps AS root_cause_service, change_id, rnd(minutes_before, 4) AS minutes_before FROM attr")
def attribute_category(spark, d):
    return conclusions(spark, d, inspection(spark, d)).select(
        "run_id", "cluster_id", "category", "root_cause_service", "change_id", rnd("minutes_before").alias("minutes_before"))


@query("attribution_confidence", "SELECT run_id, cluster_id, category, confidence FROM attr")
def attribution_confidence(spark, d):
    return conclusions(spark, d, inspection(spark, d)).select("run_id", "cluster_id", "category", "confidence")


_HOT = "This peak used nearly all there is: plan 30% more for the next"


@query("suggestions", f"""
SELECT run_id, cluster_id, concat(CASE category WHEN 'dependency_failure' THEN concat('See which dependency of ', ps, ' answers slowly or not at all')
  WHEN 'resource_bottleneck' THEN concat('Move load away from ', pi, ', and see if it recovers') WHEN 'change_induced' THEN concat('Undo the last change to ', ps)
  WHEN 'code_defect' THEN concat('List the failing calls of ', ps) WHEN 'traffic_fluctuation' THEN 'Measure how much of the load can be served'
  WHEN 'capacity_config' THEN concat('Line up the instances of ', ps) ELSE 'Record more signals and look again' END, ' | ',
  CASE WHEN category = 'traffic_fluctuation' AND (list_contains(rules, 'RES-01') OR list_contains(rules, 'RES-02') OR list_contains(rules, 'RES-04')) THEN '{_HOT} | ' ELSE '' END,
  playbook, ' | Watch from now on: ', pm) AS suggestions,
  CASE WHEN len(services) = 1 THEN concat(ps, ': ', pm, ' only, no spread')
    ELSE concat(len(services), ' services (', array_to_string(list_filter(services, lambda x: x <> ps), ', '), '), ', size, ' signals') END AS impact
FROM attr JOIN playbook USING (category)""")
def suggestions(spark, d):
    c = conclusions(spark, d, inspection(spark, d))
    return c.select("run_id", "cluster_id", F.array_join("suggestions", " | ").alias("suggestions"), "impact")


@query("run_summary", """
WITH w AS (SELECT run_id, count(*) AS n, arg_min(ps, cluster_id) AS s, arg_min(pm, cluster_id) AS m, arg_min(max_level, cluster_id) AS l, arg_min(len(services), cluster_id) AS k,
  array_to_string(list_sort(list(DISTINCT category)), ', ') AS cats, bool_or(category = 'change_induced') AS ch, bool_or(max_level = 1) AS p1 FROM attr GROUP BY run_id)
SELECT r.run_id, CAST(coalesce(n, 0) AS BIGINT) AS clusters, CASE WHEN n IS NULL THEN 'stable' ELSE 'degrading' END AS direction,
  CASE WHEN n IS NULL THEN 'No anomaly over its limits' ELSE concat(n, ' root-cause groups, worst ', s, ' ', m, ' (P', l, '), spread over ', k, ' services; ', cats) END AS summary,
  CAST(CASE WHEN n IS NULL THEN 0 ELSE 2 + CASE WHEN ch THEN 1 ELSE 0 END + CASE WHEN p1 THEN 1 ELSE 0 END END AS INT) AS advice_count
FROM windows r LEFT JOIN w USING (run_id)""")
def run_summary(spark, d):
    i = inspection(spark, d)
    s = AT.run_summary(i.clusters, conclusions(spark, d, i), X.windows(spark))
    return s.select("run_id", "clusters", "direction", "summary", F.size("advice").alias("advice_count"))


@query("evidence_bundle", f"""
SELECT run_id, cluster_id, CAST(item AS INT) AS item, anomaly_id, level, samples, p50, trend FROM (
  SELECT g.*, c.cluster_id, row_number() OVER (PARTITION BY g.run_id, c.cluster_id ORDER BY (g.anomaly_id = c.pid) DESC, g.level, g.deviation_score DESC, g.anomaly_id) AS item
  FROM grp0 g JOIN clus c USING (run_id, cluster_key)) x LEFT JOIN (SELECT {RK}, samples, rnd(p50, 2) AS p50, trend FROM dig) d USING ({RK})""")
def evidence_bundle(spark, d):
    from pulseframe.operators.windows import assign_windows
    i = inspection(spark, d)
    w = X.windows(spark).select("run_id", "window_start", "window_end")
    dig = S.digest(assign_windows(i.clean, w), RKEY)
    e = AT.evidence_bundle(i.members, dig)
    g = F.from_json("series", "samples long, p50 double, trend string")
    return e.withColumn("s", g).select("run_id", "cluster_id", "item", "anomaly_id", "level", "s.samples", rnd("s.p50", 2).alias("p50"), "s.trend")


# ------------------------------------------------------------------ outside conclusions
view("proposed", """
SELECT run_id, CASE WHEN run_id = 'run-4' THEN 'CLUS-99' ELSE cluster_id END AS cluster_id, CASE WHEN run_id = 'run-1' THEN 'cosmic_rays' ELSE 'resource_bottleneck' END AS category,
  CASE WHEN run_id = 'run-3' THEN 'svc-77' ELSE ps END AS root_cause_service, CAST(0.8 AS DOUBLE) AS confidence,
  CASE run_id WHEN 'run-2' THEN ['made-up:1'] WHEN 'run-3' THEN [concat(pr, ':', ps, '/', pi, '/', pm), 'made-up:2'] ELSE [concat(pr, ':', ps, '/', pi, '/', pm)] END AS evidence_ids
FROM clus""")
view("guarded", """
SELECT p.run_id, p.cluster_id, CASE WHEN category = 'cosmic_rays' THEN 'unknown' ELSE category END AS category, CASE WHEN root_cause_service = 'svc-77' THEN NULL ELSE root_cause_service END AS root_cause_service,
  CASE WHEN p.run_id = 'run-2' THEN CAST(0.4 AS DOUBLE) ELSE confidence END AS confidence, array_to_string(list_filter(evidence_ids, lambda x: NOT starts_with(x, 'made-up')), ',') AS evidence_ids,
  CASE p.run_id WHEN 'run-1' THEN 'category' WHEN 'run-2' THEN 'evidence,confidence' WHEN 'run-3' THEN 'evidence,service' ELSE '' END AS repairs
FROM proposed p SEMI JOIN clus c ON c.run_id = p.run_id AND c.cluster_id = p.cluster_id""")


def _proposed(i):
    r = F.col("run_id")
    p = F.col("primary")
    eid = F.concat(p["rule_id"], F.lit(":"), F.concat_ws("/", p["service"], p["instance"], p["metric"]))
    ids = F.when(r == "run-2", F.array(F.lit("made-up:1"))).when(r == "run-3", F.array(eid, F.lit("made-up:2"))).otherwise(F.array(eid))
    return i.clusters.select(
        "run_id", F.when(r == "run-4", "CLUS-99").otherwise(F.col("cluster_id")).alias("cluster_id"),
        F.when(r == "run-1", "cosmic_rays").otherwise("resource_bottleneck").alias("category"),
        F.when(r == "run-3", "svc-77").otherwise(p["service"]).alias("root_cause_service"), F.lit(0.8).alias("confidence"), ids.alias("evidence_ids"))


def _guarded(i):
    return AT.guard(_proposed(i), i.clusters, CL.evidence(i.members))


@query("guard_findings", "SELECT * FROM guarded")
def guard_findings(spark, d):
    g = _guarded(inspection(spark, d))
    return g.withColumn("evidence_ids", F.array_join("evidence_ids", ",")).withColumn("repairs", F.array_join("repairs", ","))


@query("backfill_findings", """
SELECT run_id, cluster_id, category, root_cause_service, confidence, 'outside' AS source FROM guarded
UNION ALL SELECT run_id, cluster_id, category, ps, confidence, 'rules' FROM attr a WHERE NOT EXISTS (SELECT 1 FROM guarded g WHERE g.run_id = a.run_id AND g.cluster_id = a.cluster_id)""")
def backfill_findings(spark, d):
    i = inspection(spark, d)
    return AT.backfill(_guarded(i), conclusions(spark, d, i))
