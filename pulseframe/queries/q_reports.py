"""Report sections, run comparison with recurring anomalies, full alerts, stored reports."""

from pyspark.sql import functions as F

from pulseframe.functions import seconds
from pulseframe.operators import attribution as AT
from pulseframe.operators import baseline as B
from pulseframe.operators import graph as G
from pulseframe.operators import history as H
from pulseframe.operators import reports as RP
from pulseframe.operators import rules as R
from pulseframe.operators import similarity as S
from pulseframe.operators.windows import assign_windows
from pulseframe.policy import METRICS
from pulseframe.queries import fixtures as X
from pulseframe.queries.q_attribution import visible
from pulseframe.queries.q_facts import _fmt
from pulseframe.queries.q_history import _dur, runs
from pulseframe.queries.q_rules import inspection
from pulseframe.queries.registry import query, rnd, view
from pulseframe.streaming.operators import fresh_path

view("csig_tok", "SELECT run_id, cluster_id, unnest(string_split(signature, '&')) AS tok, len(string_split(signature, '&')) AS n FROM clus")
view("crecur", """
SELECT c.run_id, c.cluster_id, coalesce(max(s.sim), 0) >= 0.6 AS is_recurring FROM clus c LEFT JOIN (
  SELECT a.run_id, a.cluster_id, count(*) / CAST(any_value(a.n) + any_value(b.n) - count(*) AS DOUBLE) AS sim
  FROM csig_tok a JOIN csig_tok b ON a.tok = b.tok JOIN windows wa ON wa.run_id = a.run_id JOIN windows wb ON wb.run_id = b.run_id AND wb.we < wa.we
  GROUP BY a.run_id, a.cluster_id, b.run_id, b.cluster_id) s ON s.run_id = c.run_id AND s.cluster_id = c.cluster_id GROUP BY ALL""")
view("mem", "SELECT g.*, c.cluster_id, g.anomaly_id = c.pid AS is_primary FROM grp0 g JOIN clus c USING (run_id, cluster_key)")
view("cmp_items", """
SELECT x.run_id, p.prev_any AS prev_run_id, x.state, x.anomaly_id, concat('[P', a.level, '] ', a.service, '/', a.instance, ' ', a.metric) AS item FROM (
  SELECT run_id, anomaly_id, state FROM diff UNION ALL SELECT DISTINCT m.run_id, m.anomaly_id, 'recurring' FROM mem m JOIN crecur r USING (run_id, cluster_id) WHERE r.is_recurring) x
JOIN prev p ON p.run_id = x.run_id AND p.prev_any IS NOT NULL
JOIN anomalies a ON a.anomaly_id = x.anomaly_id AND a.run_id = CASE WHEN x.state = 'recovered' THEN p.prev_any ELSE x.run_id END""")
view("cause_rows", f"""
SELECT t.run_id, t.cluster_id, t.max_level, t.size, t.ps, t.pm, array_to_string(t.services, ', ') AS services, CASE WHEN len(t.path) > 0 THEN array_to_string(t.path, ' -> ') ELSE t.ps END AS path,
  t.hypothesis, t.category, t.confidence, concat(CASE t.hypothesis
    WHEN 'traffic' THEN concat(len(t.services), ' services changed traffic alike; entry traffic suspected, starting at ', t.ps)
    WHEN 'single_service' THEN concat(t.ps, ': ', t.pm, ' abnormal on ', CASE WHEN i.k > 1 THEN 'several instances' ELSE t.pi END, ', no spread upstream')
    WHEN 'propagating' THEN concat(t.ps, ': ', t.pm, ' spreads upstream to ', array_to_string(t.upstream, ', '))
    ELSE concat(len(t.services), ' services abnormal together, ', t.ps, ' deviates most') END,
    CASE WHEN t.change_id IS NULL THEN '' ELSE concat('; ', {_fmt('t.minutes_before', 1)}, ' minutes after change ', t.change_id) END) AS cause
FROM attr t JOIN (SELECT run_id, cluster_id, count(DISTINCT instance) AS k FROM mem GROUP BY ALL) i USING (run_id, cluster_id)""")
_NOW = """CASE category WHEN 'dependency_failure' THEN concat('See which dependency of ', ps, ' answers slowly or not at all')
  WHEN 'resource_bottleneck' THEN concat('Move load away from ', pi, ', and see if it recovers') WHEN 'change_induced' THEN concat('Undo the last change to ', ps)
  WHEN 'code_defect' THEN concat('List the failing calls of ', ps) WHEN 'traffic_fluctuation' THEN 'Measure how much of the load can be served'
  WHEN 'capacity_config' THEN concat('Line up the instances of ', ps) ELSE 'Record more signals and look again' END"""
_HOT = f"""CASE WHEN category = 'traffic_fluctuation' AND (list_contains(rules, 'RES-01') OR list_contains(rules, 'RES-02') OR list_contains(rules, 'RES-04'))
  THEN 'This peak used nearly all there is: plan {AT.PEAK_RESERVE} more for the next' END"""
view("suggested", f"""
SELECT run_id, CASE WHEN k = 0 THEN 'now' ELSE 'soon' END AS horizon, cluster_id, category, CAST(k AS INT) AS position, l[k + 1] AS suggestion FROM (
  SELECT *, unnest(range(len(l))) AS k FROM (SELECT run_id, cluster_id, category, list_filter([{_NOW}, {_HOT}, playbook, concat('Watch from now on: ', pm)], lambda x: x IS NOT NULL) AS l
  FROM attr JOIN playbook USING (category)))""")
view("long_run", """
SELECT run_id, list_filter(['plan with the limits that were met here', 'write down what helped against the commonest cause',
  CASE WHEN bool_or(category = 'change_induced') THEN 'look at the figures right after each release, and make undoing it easy' END,
  CASE WHEN min(max_level) = 1 THEN 'let core services live through the loss of a dependency' END], lambda x: x IS NOT NULL) AS l FROM attr GROUP BY run_id""")


def recurrence(spark, i):
    s = i.clusters.select("run_id", "cluster_id", "signature")
    return S.recurring(s, s, i.windows, H.RECURRENCE)


def conclusions(spark, d, i):
    return AT.attribute(i.clusters, visible(spark, d), i.services)


def items(spark, i):
    return RP.comparison_items(i.anomalies, runs(spark), RP.recurring_anomalies(i.members, recurrence(spark, i)))


@query("report_anomalies", f"""
SELECT run_id, CASE WHEN is_suppressed THEN 'suppressed' ELSE 'active' END AS state, anomaly_id, level, rnd(observed, 4) AS observed, {_dur('duration_min')} AS lasted,
  first_seen AS first_s, suppressed_by FROM anomalies""")
def report_anomalies(spark, d):
    return RP.anomaly_rows(inspection(spark, d).anomalies).select(
        "run_id", "state", "anomaly_id", "level", rnd("observed").alias("observed"), "lasted", seconds(F.col("first_seen")).alias("first_s"), "suppressed_by")


@query("report_clusters", "SELECT run_id, cluster_id, max_level, CAST(size AS BIGINT) AS size, ps AS service, services, path, cause, category, confidence FROM cause_rows")
def report_clusters(spark, d):
    i = inspection(spark, d)
    return RP.cluster_rows(i.clusters, conclusions(spark, d, i)).select(
        "run_id", "cluster_id", "max_level", "size", "service", "services", "path", "cause", "category", "confidence")


@query("comparison_items", "SELECT run_id, prev_run_id, state, anomaly_id, item FROM cmp_items")
def comparison_items(spark, d):
    return items(spark, inspection(spark, d))


@query("comparison_summary", """
SELECT run_id, prev_run_id, delta, trend, CAST(new AS BIGINT) AS new, CAST(recovered AS BIGINT) AS recovered, CAST(persistent AS BIGINT) AS persistent, CAST(recurring AS BIGINT) AS recurring,
  concat(CASE trend WHEN 'up' THEN 'score up by ' WHEN 'down' THEN 'score down by ' ELSE 'score about the same, changed by ' END, printf('%.1f', abs(delta)), '; ', new, ' new, ', recovered, ' recovered, ',
    persistent, ' still there', CASE WHEN recurring > 0 THEN concat('; ', recurring, ' came back, so the last remedy did not hold') WHEN persistent > 0 THEN '; see whether somebody follows what is still there' ELSE '' END) AS summary
FROM (SELECT p.run_id, p.prev_any AS prev_run_id, round(a.total - b.total, 1) AS delta, CASE WHEN round(a.total - b.total, 1) > 1 THEN 'up' WHEN round(a.total - b.total, 1) < -1 THEN 'down' ELSE 'flat' END AS trend,
  (SELECT count(*) FROM cmp_items i WHERE i.run_id = p.run_id AND i.state = 'new') AS new, (SELECT count(*) FROM cmp_items i WHERE i.run_id = p.run_id AND i.state = 'recovered') AS recovered,
  (SELECT count(*) FROM cmp_items i WHERE i.run_id = p.run_id AND i.state = 'persistent') AS persistent, (SELECT count(*) FROM cmp_items i WHERE i.run_id = p.run_id AND i.state = 'recurring') AS recurring
  FROM prev p JOIN totals a ON a.run_id = p.run_id JOIN totals b ON b.run_id = p.prev_any)""")
def comparison_summary(spark, d):
    i = inspection(spark, d)
    return RP.comparison_summary(items(spark, i), runs(spark), i.score).drop("prev_started_at")


@query("report_suggestions", """
SELECT run_id, horizon, cluster_id, category, position, suggestion FROM suggested
UNION ALL SELECT run_id, 'long run', NULL, NULL, CAST(k AS INT), l[k + 1] FROM (SELECT *, unnest(range(len(l))) AS k FROM long_run)""")
def report_suggestions(spark, d):
    i = inspection(spark, d)
    c = conclusions(spark, d, i)
    return RP.suggestion_rows(c, AT.run_summary(i.clusters, c, X.windows(spark)))


@query("report_trend", f"""
WITH sig AS (SELECT run_id, concat(service, ' ', metric) AS s, min((NOT is_primary, level, -deviation_score, anomaly_id)) AS o FROM mem WHERE cluster_id = 'CLUS-01' GROUP BY ALL),
top3 AS (SELECT run_id, string_agg(s, ', ' ORDER BY i) AS names FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY o, s) AS i FROM sig) WHERE i <= {RP.REASON_LABELS} GROUP BY run_id)
SELECT w.run_id, CASE WHEN n.k IS NULL THEN 'stable' ELSE 'degrading' END AS direction,
  CASE WHEN n.k IS NULL THEN 'nothing beyond its limits' ELSE concat(n.k, ' root-cause groups are open, about ', t.names) END AS reasoning, CASE WHEN n.k IS NOT NULL THEN '{RP.FORECAST}' END AS forecast
FROM windows w LEFT JOIN (SELECT run_id, count(*) AS k FROM clus GROUP BY run_id) n USING (run_id) LEFT JOIN top3 t USING (run_id)""")
def report_trend(spark, d):
    i = inspection(spark, d)
    return RP.trend_judgement(i.clusters, i.members, X.windows(spark))


def appendix(spark, d, i):
    w = X.windows(spark)
    inst = G.instances(i.services)
    declared = i.clean.join(inst, ["service", "instance"], "left_semi")
    quality = RP.window_quality(assign_windows(declared, w.select("run_id", "window_start", "window_end")), w, inst, len(METRICS), X.G)
    cov = B.coverage(B.collect(i.baselines, w, inst, i.policy.catalog(spark)))
    return RP.appendix_rows(quality, R.rule_hits(i.findings, w, i.policy), cov, visible(spark, d))


@query("report_appendix", f"""
WITH q AS (SELECT w.run_id, (SELECT count(*) FROM points p JOIN inst i USING (service, instance) WHERE p.t >= w.ws AND p.t < w.we) AS points,
  (SELECT count(*) FROM inst) * (SELECT count(*) FROM cat) * CAST(ceil((w.we - w.ws) / {X.G}.0) AS BIGINT) AS expected FROM windows w)
SELECT run_id, 'data' AS topic, 'points' AS name, CAST(points AS VARCHAR) AS value FROM q
UNION ALL SELECT run_id, 'data', 'missing %', printf('%.2f', round(100.0::DOUBLE * (1 - least(1.0::DOUBLE, points / CAST(expected AS DOUBLE))), 2)) FROM q
UNION ALL SELECT run_id, 'data', 'confidence', CASE WHEN points / CAST(expected AS DOUBLE) >= 0.95 THEN 'high' WHEN points / CAST(expected AS DOUBLE) >= 0.8 THEN 'medium' ELSE 'low' END FROM q
UNION ALL SELECT run_id, 'rule', rule_id, CAST(count(*) AS VARCHAR) FROM findings GROUP BY run_id, rule_id
UNION ALL SELECT run_id, 'baseline', 'dynamic %', printf('%.0f', round(100 * avg(CASE WHEN mode = 'dynamic' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 0)) FROM base_all GROUP BY run_id
UNION ALL SELECT run_id, 'change', change_id, concat(service, ' ', type) FROM vis WHERE t < (SELECT we FROM windows w WHERE w.run_id = vis.run_id)""")
def report_appendix(spark, d):
    return appendix(spark, d, inspection(spark, d))


@query("alert_messages", f"""
WITH u AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY level, deviation_score DESC, anomaly_id) AS i FROM active WHERE level <= 2),
l AS (SELECT run_id, string_agg(concat('P', level, ' ', service, '/', instance, ' ', metric, ' ', {_fmt('observed')}, ' (baseline ', coalesce({_fmt('baseline_value')}, '-'), '), ', {_dur('duration_min')}), chr(10) ORDER BY i) AS text FROM u WHERE i <= 10 GROUP BY run_id),
n AS (SELECT run_id, CAST(count(*) AS BIGINT) AS urgent FROM u GROUP BY run_id),
q AS (SELECT run_id, cluster_id, category, CASE WHEN length(cause) <= 120 THEN cause ELSE concat(rtrim(cause[1:117]), '...') END AS cause FROM cause_rows WHERE cluster_id = 'CLUS-01'),
a AS (SELECT run_id, CASE WHEN length(suggestion) <= 120 THEN suggestion ELSE concat(rtrim(suggestion[1:117]), '...') END AS act FROM suggested WHERE horizon = 'now' AND cluster_id = 'CLUS-01')
SELECT l.run_id, concat('score ', {_fmt('t.total', 1)}, ' (', t.grade, ')') AS title, concat_ws(chr(10), concat('run: ', l.run_id),
  concat('window: ', strftime(make_timestamp(w.ws::BIGINT * 1000000), '%Y-%m-%d %H:%M'), ' to ', strftime(make_timestamp(w.we::BIGINT * 1000000), '%Y-%m-%d %H:%M')), l.text,
  CASE WHEN n.urgent > 10 THEN concat('and ', n.urgent - 10, ' more') END, concat('cause: ', q.category, ', ', q.cause), concat('first: ', a.act)) AS text
FROM l JOIN n USING (run_id) JOIN totals t USING (run_id) JOIN windows w USING (run_id) LEFT JOIN q USING (run_id) LEFT JOIN a USING (run_id)""")
def alert_messages(spark, d):
    i = inspection(spark, d)
    c = conclusions(spark, d, i)
    s = RP.suggestion_rows(c, AT.run_summary(i.clusters, c, X.windows(spark)))
    return RP.alert_messages(i.anomalies, i.score, X.windows(spark), RP.cluster_rows(i.clusters, c), s)


def stored(spark, d):
    """The report of all runs, stored and read back."""
    i = inspection(spark, d)
    c = conclusions(spark, d, i)
    worst = [F.col("state"), F.col("level"), F.desc("deviation_score"), F.col("anomaly_id")]
    doc = RP.document({
        "anomalies": (RP.anomaly_rows(i.anomalies), worst),
        "clusters": (RP.cluster_rows(i.clusters, c), [F.col("rank")]),
        "suggestions": (RP.suggestion_rows(c, AT.run_summary(i.clusters, c, X.windows(spark))), [F.col("horizon"), F.col("cluster_id"), F.col("position")]),
        "trend": (RP.trend_judgement(i.clusters, i.members, X.windows(spark)), [F.col("direction")])})
    path = fresh_path(spark, "reports")
    RP.store_report(doc, path, X.windows(spark))
    return spark.read.schema(doc.schema).parquet(path)


@query("report_lookup", """
SELECT 'anomalies' AS section, CAST(row_number() OVER (ORDER BY is_suppressed, level, deviation_score DESC, anomaly_id) AS INT) AS position, anomaly_id AS key FROM anomalies WHERE run_id = 'run-3'
UNION ALL SELECT 'clusters', CAST(row_number() OVER (ORDER BY cluster_id) AS INT), cluster_id FROM clus WHERE run_id = 'run-3'""")
def report_lookup(spark, d):
    """Anomalies and clusters of one run from the stored report, in the report's order."""
    rows = RP.of_run(stored(spark, d).where("section IN ('anomalies', 'clusters')"), "run-3", "section", "position")
    return rows.select("section", "position", F.coalesce(F.get_json_object("body", "$.anomaly_id"), F.get_json_object("body", "$.cluster_id")).alias("key"))
