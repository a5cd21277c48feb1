"""Similar clusters, recurrence, run differences, report datasets and labelled evaluation."""

from pyspark.sql import functions as F

from pulseframe.functions import seconds
from pulseframe.operators import anomalies as A
from pulseframe.operators import attribution as AT
from pulseframe.operators import evaluate as EV
from pulseframe.operators import history as H
from pulseframe.operators import similarity as S
from pulseframe.operators import stats as ST
from pulseframe.operators.windows import assign_windows
from pulseframe.queries import fixtures as X
from pulseframe.queries import q_score  # noqa: F401 - registers the score views used below
from pulseframe.queries.q_attribution import conclusions, visible
from pulseframe.queries.q_facts import _fmt
from pulseframe.queries.q_rules import inspection
from pulseframe.queries.q_stats import RK
from pulseframe.queries.registry import query, rnd, values_sql, view
from pulseframe.schemas import RKEY
from pulseframe.session import literal_table

view("sigs", """
SELECT a.run_id, a.instance AS cluster_id, array_to_string(list_sort(list(DISTINCT concat(a.rule_id, '.', a.metric))), '&') AS signature, any_value(w.we) AS created
FROM active a JOIN windows w USING (run_id) GROUP BY a.run_id, a.instance""")
view("sig_tok", "SELECT run_id, cluster_id, unnest(string_split(signature, '&')) AS tok, len(string_split(signature, '&')) AS n FROM sigs")
view("sim", """
SELECT a.run_id, a.cluster_id, b.run_id AS match_run, b.cluster_id AS match_cluster, count(*) / CAST(any_value(a.n) + any_value(b.n) - count(*) AS DOUBLE) AS similarity
FROM sig_tok a JOIN sig_tok b ON a.tok = b.tok JOIN windows wa ON wa.run_id = a.run_id JOIN windows wb ON wb.run_id = b.run_id AND wb.we < wa.we
GROUP BY a.run_id, a.cluster_id, b.run_id, b.cluster_id""")
view("recur", """
SELECT s.run_id, s.cluster_id, coalesce(m.best, 0) >= 0.6 AS is_recurring FROM sigs s LEFT JOIN (SELECT run_id, cluster_id, max(similarity) AS best FROM sim GROUP BY ALL) m USING (run_id, cluster_id)""")


def signatures(i):
    """One small cluster per run and instance, so there are enough to compare."""
    tok = F.concat_ws(".", "rule_id", "metric")
    s = i.active.groupBy("run_id", F.col("instance").alias("cluster_id")).agg(
        F.array_join(F.array_sort(F.collect_set(tok)), "&").alias("signature"))
    return s.join(i.windows.select("run_id", F.col("window_end").alias("created_at")), "run_id")


def runs(spark):
    return X.windows(spark).withColumn("started_at", F.col("window_end"))


@query("jaccard_matches", """
SELECT run_id, cluster_id, match_run, match_cluster, rnd(similarity, 6) AS similarity, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, cluster_id ORDER BY similarity DESC, match_run, match_cluster) AS rank FROM sim) WHERE rank <= 3""")
def jaccard_matches(spark, d):
    s = signatures(inspection(spark, d))
    return H.jaccard_matches(s, s, X.windows(spark), k=3).withColumn("similarity", rnd("similarity", 6))


@query("recurrence", "SELECT * FROM recur")
def recurrence(spark, d):
    s = signatures(inspection(spark, d))
    return S.recurring(s, s, X.windows(spark), H.RECURRENCE)


@query("sync_recurrence", """
SELECT run_id, cluster_id, is_recurring, (run_id = 'run-2') <> is_recurring AS corrected FROM recur""")
def sync_recurrence(spark, d):
    s = signatures(inspection(spark, d))
    claimed = s.select("run_id", "cluster_id", (F.col("run_id") == "run-2").alias("is_recurring"))
    rec = S.recurring(s, s, X.windows(spark), H.RECURRENCE)
    return AT.sync_recurrence(claimed, rec).select("run_id", "cluster_id", "is_recurring", "corrected")


@query("recent_clusters", """
SELECT run_id, cluster_id, signature FROM sigs WHERE run_id <> 'run-4'""")
def recent_clusters(spark, d):
    """With a rerun of the same window and clusters without a run in the history: neither counts."""
    s = signatures(inspection(spark, d))
    r = runs(spark).select("run_id", "window_end")
    rerun = r.where("run_id = 'run-4'").withColumn("run_id", F.lit("rerun-4"))
    h = s.unionByName(s.where("run_id = 'run-4'").withColumn("run_id", F.lit("rerun-4"))).unionByName(
        s.where("run_id = 'run-1'").withColumn("run_id", F.lit("ghost")))
    return H.recent_clusters(h, r.unionByName(rerun), "run-4").select("run_id", "cluster_id", "signature")


# ------------------------------------------------------------------ runs
view("prev", """
SELECT run_id, scenario_id, we, lag(run_id) OVER (ORDER BY we) AS prev_any, lag(run_id) OVER (PARTITION BY scenario_id ORDER BY we) AS prev_same FROM windows""")
view("diff", """
SELECT coalesce(n.run_id, o.run_id) AS run_id, coalesce(n.anomaly_id, o.anomaly_id) AS anomaly_id, CASE WHEN o.anomaly_id IS NULL THEN 'new' WHEN n.anomaly_id IS NULL THEN 'recovered' ELSE 'persistent' END AS state
FROM (SELECT a.run_id, a.anomaly_id FROM anomalies a JOIN prev USING (run_id) WHERE prev_any IS NOT NULL) n
FULL JOIN (SELECT p.run_id, a.anomaly_id FROM anomalies a JOIN prev p ON p.prev_any = a.run_id) o ON o.run_id = n.run_id AND o.anomaly_id = n.anomaly_id""")


@query("previous_run", """
SELECT run_id, prev_any, prev_same, CAST((SELECT count(*) FROM points p WHERE p.t >= w.we - 604800 AND p.t < w.we) AS BIGINT) AS points FROM prev w""")
def previous_run(spark, d):
    from pulseframe.operators.windows import assign_windows
    a = H.previous_run(runs(spark)).select("run_id", F.col("prev_run_id").alias("prev_any"))
    b = H.previous_run(runs(spark), per_scenario=True).select("run_id", F.col("prev_run_id").alias("prev_same"))
    n = assign_windows(X.metric_points(spark, d), X.windows(spark)).groupBy("run_id").agg(F.count("*").alias("points"))
    return a.join(b, "run_id").join(n, "run_id")


@query("run_diff", "SELECT run_id, anomaly_id, state FROM diff")
def run_diff(spark, d):
    return H.run_diff(inspection(spark, d).anomalies, H.previous_run(runs(spark)))


def _diff(state):
    @query(f"diff_{state}", f"SELECT anomaly_id FROM diff WHERE run_id = 'run-4' AND state = '{state}'")
    def q(spark, d):
        return H.diff_sets(inspection(spark, d).anomalies, "run-4", "run-3")[state]
    return q


for _state in ("new", "recovered", "persistent"):
    _diff(_state)


@query("score_trend", """
SELECT p.run_id, p.prev_any AS prev_run_id, round(a.total - b.total, 1) AS delta, CASE WHEN round(a.total - b.total, 1) > 1 THEN 'up' WHEN round(a.total - b.total, 1) < -1 THEN 'down' ELSE 'flat' END AS trend
FROM prev p JOIN totals a ON a.run_id = p.run_id JOIN totals b ON b.run_id = p.prev_any""")
def score_trend(spark, d):
    return H.score_trend(runs(spark), inspection(spark, d).score)


@query("score_history", "SELECT run_id, total, we AS started_s FROM windows JOIN totals USING (run_id) ORDER BY we DESC LIMIT 3")
def score_history(spark, d):
    return H.score_history(runs(spark), inspection(spark, d).score, 3).select("run_id", "total", seconds(F.col("started_at")).alias("started_s"))


@query("latest_runs", """
SELECT run_id, scenario_id, we AS started_s, CAST((SELECT count(*) FROM active a WHERE a.run_id = w.run_id) AS BIGINT) AS anomalies FROM windows w ORDER BY we DESC LIMIT 2""")
def latest_runs(spark, d):
    n = inspection(spark, d).active.groupBy("run_id").agg(F.count("*").alias("anomalies"))
    return H.latest_runs(runs(spark).join(n, "run_id", "left"), 2).select(
        "run_id", "scenario_id", seconds(F.col("started_at")).alias("started_s"), F.coalesce("anomalies", F.lit(0)).alias("anomalies"))


@query("run_status", """
SELECT concat('u', user_id) AS run_id, CASE WHEN bool_or(event_type = 'error') AND NOT bool_or(event_type IN ('click', 'view')) THEN 'failed'
  WHEN bool_or(event_type = 'error') OR bool_or(event_type = 'signup') THEN 'partial' ELSE 'succeeded' END AS status FROM events GROUP BY user_id""")
def run_status(spark, d):
    """Each user's events as the stages of a run."""
    s = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "degraded").when(
        F.col("event_type").isin("click", "view"), "succeeded").otherwise("skipped")
    stages = X.load(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("run_id"), F.col("event_type").alias("stage"), s.alias("status"))
    return H.run_status(stages)


# ------------------------------------------------------------------ reports and alerts
@query("report_payload", """
WITH d AS (SELECT run_id, count(*) FILTER (state = 'new') AS new, count(*) FILTER (state = 'recovered') AS recovered, count(*) FILTER (state = 'persistent') AS persistent FROM diff GROUP BY run_id),
c AS (SELECT run_id, count(*) AS clusters, arg_min(signature, cluster_id) AS sig FROM clus GROUP BY run_id)
SELECT w.run_id, t.total, t.grade, CAST((SELECT count(*) FROM active a WHERE a.run_id = w.run_id AND a.level = 1) AS BIGINT) AS p1, CAST(coalesce(c.clusters, 0) AS BIGINT) AS clusters, c.sig AS top_signature,
  CAST(coalesce(d.new, 0) AS BIGINT) AS new, CAST(coalesce(d.recovered, 0) AS BIGINT) AS recovered, CAST(coalesce(d.persistent, 0) AS BIGINT) AS persistent
FROM windows w JOIN totals t USING (run_id) LEFT JOIN c USING (run_id) LEFT JOIN d USING (run_id)""")
def report_payload(spark, d):
    i = inspection(spark, d)
    diff = H.run_diff(i.anomalies, H.previous_run(runs(spark)))
    r = H.report_payload(X.windows(spark), i.score, A.level_counts(i.active, X.windows(spark)), i.clusters, diff)
    schema = "total double, grade string, p1 long, clusters long, top_signature string, new long, recovered long, persistent long"
    return r.select("run_id", F.from_json("payload", schema).alias("p")).select("run_id", "p.*")


def _dur(c):
    return f"CASE WHEN {c} < 1 THEN concat(CAST(floor({c} * 60) AS BIGINT), 's') WHEN {c} < 60 THEN printf('%.0fmin', round({c}, 0)) WHEN {c} < 1440 THEN printf('%.1fh', round({c} / 60, 1)) ELSE printf('%.1fd', round({c} / 1440, 1)) END"


@query("alert_payload", f"""
WITH u AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY level, deviation_score DESC, anomaly_id) AS i FROM active WHERE level <= 2),
l AS (SELECT run_id, string_agg(concat('P', level, ' ', service, '/', instance, ' ', metric, ' ', {_fmt('observed')}, ' (baseline ', coalesce({_fmt('baseline_value')}, '-'), '), ', {_dur('duration_min')}), chr(10) ORDER BY i) AS text FROM u WHERE i <= 10 GROUP BY run_id),
n AS (SELECT run_id, CAST(count(*) AS BIGINT) AS urgent FROM u GROUP BY run_id)
SELECT l.run_id, n.urgent, concat('score ', {_fmt('t.total', 1)}, ' (', t.grade, ')') AS title, l.text, coalesce(c.cause, 'unknown') AS cause
FROM l JOIN n USING (run_id) JOIN totals t USING (run_id) LEFT JOIN (SELECT run_id, arg_min(category, cluster_id) AS cause FROM attr GROUP BY run_id) c USING (run_id)""")
def alert_payload(spark, d):
    i = inspection(spark, d)
    return H.alert_payload(i.anomalies, i.score, conclusions(spark, d, i), lines=10)


# ------------------------------------------------------------------ labelled evaluation
LABELS = [("run-1", ["resource_bottleneck"], 1, False), ("run-2", ["change_induced", "traffic_fluctuation"], 1, False),
          ("run-3", ["code_defect"], 2, False), ("run-4", ["none"], 0, True)]
view("labels_", values_sql(["run_id", "causes", "lvl", "clean"], LABELS))
view("outcome", """
SELECT run_id, clean AS expect_clean, FALSE AS failed, CASE WHEN clean THEN quiet ELSE coalesce(list_has_any(causes, actual), FALSE) END AS cause_hit,
  CASE WHEN clean THEN quiet ELSE coalesce(top = lvl, FALSE) END AS level_hit, clean AND NOT quiet AS false_positive FROM (
  SELECT l.*, r.actual, r.top, coalesce(p.k, 0) = 0 AS quiet FROM labels_ l LEFT JOIN (SELECT run_id, list(category) AS actual, min(max_level) AS top FROM attr GROUP BY run_id) r USING (run_id)
  LEFT JOIN (SELECT run_id, count(*) AS k FROM active WHERE level <= 2 GROUP BY run_id) p USING (run_id))""")


def _outcomes(spark, d):
    i = inspection(spark, d)
    labels = literal_table(spark, [("run_id", "string"), ("expected_causes", "array<string>"), ("expected_level", "int"), ("expect_clean", "boolean")], LABELS)
    causes = conclusions(spark, d, i).groupBy("run_id").agg(F.collect_set("category").alias("causes"))
    top = i.clusters.groupBy("run_id").agg(F.min("max_level").alias("top_level"))
    res = A.level_counts(i.active, X.windows(spark)).join(causes, "run_id", "left").join(top, "run_id", "left")
    return EV.outcomes(labels, res.withColumn("degraded", F.lit(False)).withColumn("error", F.lit(None).cast("string")))


@query("eval_outcomes", "SELECT run_id, expect_clean, failed, cause_hit, level_hit, false_positive FROM outcome")
def eval_outcomes(spark, d):
    return _outcomes(spark, d).drop("degraded")


@query("eval_summary", """
SELECT CAST(count(*) AS BIGINT) AS graded, avg(cause_hit::INT) AS cause_accuracy, avg(level_hit::INT) AS level_accuracy,
  avg(false_positive::INT) FILTER (expect_clean) AS false_positive_rate, CAST(0 AS DOUBLE) AS degraded_ratio FROM outcome""")
def eval_summary(spark, d):
    return EV.summary(_outcomes(spark, d))


@query("evidence_document", f"""
WITH mem AS (SELECT g.*, c.cluster_id, c.pid, c.pfirst FROM grp0 g JOIN clus c USING (run_id, cluster_key)),
dist AS (SELECT v.run_id, v.change_id, rnd(round((f.e - v.t) / CAST(60 AS DOUBLE), 1), 1) AS m
  FROM vis v JOIN (SELECT run_id, min(pfirst) AS e FROM clus GROUP BY run_id) f USING (run_id)
  WHERE EXISTS (SELECT 1 FROM clus c WHERE c.run_id = v.run_id AND list_contains(c.services, v.service)))
SELECT run_id, cluster_id, 'temporal' AS section, 1 AS item, CAST(min(pfirst) AS VARCHAR) AS name, CAST(count(DISTINCT instance) AS DOUBLE) AS amount,
  true AS told FROM mem GROUP BY run_id, cluster_id
UNION ALL SELECT m.run_id, cluster_id, 'evidence', CAST(row_number() OVER (PARTITION BY m.run_id, cluster_id ORDER BY (anomaly_id = pid) DESC, level, deviation_score DESC, anomaly_id) AS INT),
  anomaly_id, rnd(d.p50, 2), true FROM mem m LEFT JOIN dig d USING ({RK})
UNION ALL SELECT run_id, cluster_id, 'history', CAST(rank AS INT), match_run || '/' || match_cluster, rnd(similarity, 6), true FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, cluster_id ORDER BY similarity DESC, match_run, match_cluster) AS rank FROM sim) WHERE rank <= 3
UNION ALL SELECT run_id, NULL, 'change', CAST(row_number() OVER (PARTITION BY run_id ORDER BY m, change_id) AS INT), change_id, m, true FROM dist""")
def evidence_document(spark, d):
    """Each section's rows; `told` says that an evidence item has its reason."""
    i = inspection(spark, d)
    dig = ST.digest(assign_windows(i.clean, X.windows(spark).select("run_id", "window_start", "window_end")), RKEY)
    sig = signatures(i)
    e = AT.evidence_document(i.clusters, i.members, dig, visible(spark, d), H.jaccard_matches(sig, sig, X.windows(spark), k=3))
    b = F.from_json("body", "first_seen long, affected_instances double, anomaly_id string, reason string, series struct<p50 double>, match_run string, "
                            "match_cluster string, similarity double, change_id string, minutes_before double")
    e = e.withColumn("b", b)
    is_ = {s: F.col("section") == s for s in ("temporal", "evidence", "history", "change")}
    name = F.when(is_["temporal"], F.col("b.first_seen").cast("string")).when(is_["evidence"], F.col("b.anomaly_id")).when(
        is_["history"], F.concat_ws("/", "b.match_run", "b.match_cluster")).otherwise(F.col("b.change_id"))
    amount = F.when(is_["temporal"], F.col("b.affected_instances")).when(is_["evidence"], rnd("b.series.p50", 2)).when(
        is_["history"], rnd("b.similarity", 6)).otherwise(rnd("b.minutes_before", 1))
    told = ~is_["evidence"] | (F.length(F.coalesce("b.reason", F.lit(""))) > 0)
    return e.select("run_id", "cluster_id", "section", "item", name.alias("name"), amount.alias("amount"), told.alias("told"))
