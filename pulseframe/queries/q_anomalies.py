"""Merging, suppression, ranking, root-cause groups and rollups."""

from pyspark.sql import functions as F

from pulseframe.functions import seconds
from pulseframe.operators import anomalies as A
from pulseframe.operators import clusters as CL
from pulseframe.operators import rollups as RU
from pulseframe.policy import AFFINITY, LEVEL_SCORE
from pulseframe.queries import fixtures as X
from pulseframe.queries.q_facts import _SCORE, _fmt
from pulseframe.queries.q_rules import findings, inspection
from pulseframe.queries.registry import query, rnd, values_sql, view

DEDUP = "run_id, rule_id, service, instance, metric"

view("dup_findings", """
SELECT run_id, rule_id, service, instance, metric, level, observed, amplitude, duration_min, first_seen, last_seen, deviation_score FROM findings
UNION ALL SELECT run_id, rule_id, service, instance, metric, least(4, level + 1), observed * 1.5, amplitude / 2, duration_min * 2, first_seen - 21600,
  last_seen + 21600, round(deviation_score - 0.05, 4) FROM findings""")
view("anomalies", f"""
SELECT *, level > first_value(level) OVER w AS is_suppressed,
  CASE WHEN level > first_value(level) OVER w THEN first_value(anomaly_id) OVER w END AS suppressed_by
FROM (SELECT * EXCLUDE (deviation_score), round(1e-9 + {_SCORE.format(blast='affected_ratio', crit='criticality')}, 4) AS deviation_score FROM (
  SELECT f.* EXCLUDE (affected_ratio, criticality), s.criticality, concat_ws('|', f.rule_id, f.service, f.instance, f.metric) AS anomaly_id,
    least(1, h.hit / CAST(greatest(1, s.instance_count) AS DOUBLE)) AS affected_ratio
  FROM findings f JOIN svc s ON s.service = f.service
  JOIN (SELECT run_id, rule_id, service, count(DISTINCT instance) AS hit FROM findings GROUP BY ALL) h
    ON h.run_id = f.run_id AND h.rule_id = f.rule_id AND h.service = f.service))
WINDOW w AS (PARTITION BY run_id, service, instance, metric ORDER BY level, deviation_score DESC, anomaly_id)""")
view("active", "SELECT * FROM anomalies WHERE NOT is_suppressed")


@query("merge_findings", f"""
SELECT {DEDUP}, min(level) AS level, CAST(count(*) AS BIGINT) AS merged_count, max(duration_min) AS duration_min, rnd(max(amplitude), 3) AS amplitude,
  rnd(arg_max(observed, (deviation_score, -level)), 4) AS observed, min(first_seen) AS first_s, max(last_seen) AS last_s FROM dup_findings GROUP BY ALL""")
def merge_findings(spark, d):
    f = findings(spark, d)
    six = F.expr("INTERVAL 6 HOURS")
    worse = (
        f.withColumn("level", F.least(F.lit(4), F.col("level") + 1)).withColumn("observed", F.col("observed") * 1.5)
        .withColumn("amplitude", F.col("amplitude") / 2).withColumn("duration_min", F.col("duration_min") * 2)
        .withColumn("first_seen", F.col("first_seen") - six).withColumn("last_seen", F.col("last_seen") + six)
        .withColumn("deviation_score", F.round(F.col("deviation_score") - 0.05, 4)))
    m = A.merge_findings(f.unionByName(worse))
    return m.select(*A.DEDUP, "level", "merged_count", "duration_min", rnd("amplitude", 3).alias("amplitude"), rnd("observed").alias("observed"),
                    seconds(F.col("first_seen")).alias("first_s"), seconds(F.col("last_seen")).alias("last_s"))


@query("affected_ratio", f"SELECT {DEDUP}, rnd(affected_ratio, 4) AS affected_ratio FROM anomalies")
def affected_ratio(spark, d):
    a = A.affected_ratio(A.merge_findings(findings(spark, d)), X.policy().service_dim(spark))
    return a.select(*A.DEDUP, rnd("affected_ratio").alias("affected_ratio"))


@query("rescore", f"SELECT {DEDUP}, deviation_score FROM anomalies")
def rescore(spark, d):
    return inspection(spark, d).anomalies.select(*A.DEDUP, "deviation_score")


@query("suppress", "SELECT run_id, anomaly_id, level, is_suppressed, suppressed_by FROM anomalies")
def suppress(spark, d):
    return inspection(spark, d).anomalies.select("run_id", "anomaly_id", "level", "is_suppressed", "suppressed_by")


TOP = """SELECT run_id, CAST(rank AS INT) AS rank, anomaly_id, level, deviation_score FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY level, deviation_score DESC, anomaly_id) AS rank FROM {src}) WHERE rank <= {k}"""


@query("top_anomalies", TOP.format(src="active", k=10))
def top_anomalies(spark, d):
    return A.top_anomalies(inspection(spark, d).active, 10).select("run_id", "rank", "anomaly_id", "level", "deviation_score")


@query("flagship", TOP.format(src="active", k=5))
def flagship(spark, d):
    """Raw events to the five worst anomalies of every inspection: the whole chain in one job."""
    return A.top_anomalies(inspection(spark, d).active, 5).select("run_id", "rank", "anomaly_id", "level", "deviation_score")


@query("level_counts", """
SELECT w.run_id, CAST(count(*) FILTER (level = 1) AS BIGINT) AS p1, CAST(count(*) FILTER (level = 2) AS BIGINT) AS p2,
  CAST(count(*) FILTER (level = 3) AS BIGINT) AS p3, CAST(count(*) FILTER (level = 4) AS BIGINT) AS p4, min(level) AS highest_level
FROM windows w LEFT JOIN active a USING (run_id) GROUP BY w.run_id""")
def level_counts(spark, d):
    return A.level_counts(inspection(spark, d).active, X.windows(spark))


# ------------------------------------------------------------------ clusters
view("clo", """
SELECT head AS src, node AS dst, min(len(path)) - 1 AS hops, arg_min(path, (len(path), path)) AS path FROM walk WHERE len(path) > 1 GROUP BY ALL""")
view("svc_reach", """
SELECT service AS a, service AS b FROM svc UNION
SELECT r.a, CASE WHEN e.src = r.b THEN e.dst ELSE e.src END FROM svc_reach r JOIN svc_edges e ON e.src = r.b OR e.dst = r.b""")
view("comp", "SELECT a AS service, min(b) AS component FROM svc_reach GROUP BY a")
view("grp0", "SELECT a.*, component AS cluster_key FROM active a JOIN comp USING (service)")
view("aff_svc", "SELECT DISTINCT run_id, cluster_key, service FROM grp0")
view("depth", """
SELECT a.run_id, a.cluster_key, a.service, CASE WHEN n.n < 2 THEN 0.5 ELSE coalesce(b.k, 0) / CAST(n.n - 1 AS DOUBLE) END AS depth
FROM aff_svc a JOIN (SELECT run_id, cluster_key, count(*) AS n FROM aff_svc GROUP BY ALL) n USING (run_id, cluster_key)
LEFT JOIN (SELECT a.run_id, a.cluster_key, a.service, count(*) AS k FROM aff_svc a JOIN clo c ON c.src = a.service
  JOIN aff_svc b ON b.run_id = a.run_id AND b.cluster_key = a.cluster_key AND b.service = c.dst AND b.service <> a.service GROUP BY ALL) b
  USING (run_id, cluster_key, service)""")
view("aff_dim", values_sql(["dimension", "aff"], list(AFFINITY.items()), {"aff": "DOUBLE"}))
view("lvl_dim", values_sql(["level", "ls"], list(LEVEL_SCORE.items()), {"ls": "DOUBLE"}))
view("cause", """
SELECT *, 0.40 * aff + 0.25 * ls + 0.20 * CASE WHEN aff >= 0.6 THEN 1 - depth ELSE depth END
  + 0.15 * (1 - (first_seen - e) / greatest(1.0::DOUBLE, l - e)) AS cause_score
FROM (SELECT *, min(first_seen) OVER w AS e, max(first_seen) OVER w AS l FROM (
  SELECT g.*, bool_or(rule_id IN ('BIZ-03', 'BIZ-04')) OVER c AS has_vol, bool_or(rule_id <> 'BIZ-06') OVER c AS has_other FROM grp0 g WINDOW c AS (PARTITION BY run_id, cluster_key))
  WHERE CASE WHEN has_vol THEN rule_id IN ('BIZ-03', 'BIZ-04') WHEN has_other THEN rule_id <> 'BIZ-06' ELSE TRUE END
  WINDOW w AS (PARTITION BY run_id, cluster_key))
JOIN depth USING (run_id, cluster_key, service) JOIN aff_dim USING (dimension) JOIN lvl_dim USING (level)""")
view("prim", """
SELECT * FROM cause QUALIFY row_number() OVER (PARTITION BY run_id, cluster_key ORDER BY level, round(cause_score, 9) DESC, anomaly_id) = 1""")
view("clus0", """
SELECT g.run_id, g.cluster_key, min(g.level) AS max_level, count(*) AS size, list_sort(list(DISTINCT g.service)) AS services,
  list_sort(list(DISTINCT g.rule_id)) AS rules, array_to_string(list_sort(list(DISTINCT concat(g.service, '.', g.metric))), '&') AS signature,
  any_value(p.anomaly_id) AS pid, any_value(p.service) AS ps, any_value(p.metric) AS pm, any_value(p.rule_id) AS pr, any_value(p.dimension) AS pdim,
  any_value(p.instance) AS pi, any_value(p.deviation_score) AS pscore, any_value(p.first_seen) AS pfirst, any_value(p.mode) AS pmode,
  any_value(p.cause_score) AS cause_score, any_value(p.level) AS plevel, any_value(p.observed) AS pobs, any_value(p.baseline_value) AS pbase
FROM grp0 g JOIN prim p USING (run_id, cluster_key) GROUP BY ALL""")
view("clus", """
SELECT c.*, printf('CLUS-%02d', row_number() OVER (PARTITION BY run_id ORDER BY max_level, pscore DESC, pid)) AS cluster_id,
  coalesce(CASE WHEN len(dn.path) > 1 THEN dn.path ELSE up.path END, [ps]) AS full_path,
  list_sort(coalesce(list_intersect(services, (SELECT list(src) FROM clo WHERE dst = ps)), [])) AS upstream,
  list_sort(coalesce(list_intersect(services, (SELECT list(dst) FROM clo WHERE src = ps)), [])) AS downstream
FROM clus0 c
LEFT JOIN (SELECT head, arg_min(path, (-len(path), path)) AS path FROM walk GROUP BY head) dn ON dn.head = ps
LEFT JOIN (SELECT dst, arg_min(path, (-hops, path)) AS path FROM clo GROUP BY dst) up ON up.dst = ps""")
view("clus_h", """
SELECT *, list_filter(full_path, lambda x: list_contains(services, x)) AS path,
  CASE WHEN len(list_filter(rules, lambda r: r NOT IN ('BIZ-03', 'BIZ-04'))) = 0 THEN 'traffic' WHEN len(services) = 1 THEN 'single_service'
    WHEN len(upstream) > 0 THEN 'propagating' ELSE 'co_occurring' END AS hypothesis FROM clus""")


@query("anomaly_clusters", "SELECT run_id, anomaly_id, cluster_key FROM grp0")
def anomaly_clusters(spark, d):
    i = inspection(spark, d)
    return CL.group(i.active, i.edges, i.services).select("run_id", "anomaly_id", "cluster_key")


@query("anomaly_clusters_induced", """
WITH RECURSIVE hot AS (SELECT DISTINCT run_id, service FROM active WHERE level = 1 AND rule_id <> 'BIZ-06'),
reach AS (SELECT run_id, service AS a, service AS b FROM hot UNION
  SELECT r.run_id, r.a, h.service FROM reach r JOIN svc_edges e ON e.src = r.b OR e.dst = r.b
  JOIN hot h ON h.run_id = r.run_id AND h.service = CASE WHEN e.src = r.b THEN e.dst ELSE e.src END)
SELECT a.run_id, a.anomaly_id, k.cluster_key FROM active a JOIN (SELECT run_id, service, concat(run_id, '/', m) AS cluster_key FROM (SELECT run_id, a AS service, min(b) AS m FROM reach GROUP BY run_id, a)) k
  USING (run_id, service) WHERE a.level = 1 AND a.rule_id <> 'BIZ-06'""".replace("WITH RECURSIVE", "WITH"))
def anomaly_clusters_induced(spark, d):
    """Components of the affected services only."""
    i = inspection(spark, d)
    hot = i.active.where("level = 1 AND rule_id <> 'BIZ-06'")
    return CL.group(hot, i.edges.withColumn("hops", F.lit(1)), i.services, induced=True).select("run_id", "anomaly_id", "cluster_key")


@query("root_cause_pick", """
SELECT run_id, anomaly_id, rnd(depth, 4) AS depth, rnd(cause_score, 5) AS cause_score, anomaly_id IN (SELECT p.anomaly_id FROM prim p WHERE p.run_id = c.run_id) AS is_primary FROM cause c""")
def root_cause_pick(spark, d):
    i = inspection(spark, d)
    s = CL.root_cause_scores(CL.group(i.active, i.edges, i.services), i.related)
    pick = i.grouped.select("run_id", "anomaly_id", "is_primary")
    return s.join(pick, ["run_id", "anomaly_id"]).select(
        "run_id", "anomaly_id", rnd("depth").alias("depth"), rnd("cause_score", 5).alias("cause_score"), "is_primary")


@query("depth_norm", "SELECT run_id, cluster_key, service, rnd(depth, 4) AS depth FROM depth")
def depth_norm(spark, d):
    from pulseframe.operators.graph import depth_share
    i = inspection(spark, d)
    aff = CL.group(i.active, i.edges, i.services).select(*CL.CKEY, "service").distinct()
    return depth_share(aff, i.related, CL.CKEY).select(*CL.CKEY, "service", rnd("depth").alias("depth"))


@query("clusters", """
SELECT run_id, cluster_id, pid AS primary_id, max_level, CAST(size AS BIGINT) AS size, array_to_string(services, ',') AS services FROM clus""")
def clusters(spark, d):
    return inspection(spark, d).clusters.select(
        "run_id", "cluster_id", F.col("primary.anomaly_id").alias("primary_id"), "max_level", "size", F.array_join("services", ",").alias("services"))


@query("cluster_hypothesis", "SELECT run_id, cluster_id, hypothesis, array_to_string(upstream, ',') AS upstream FROM clus_h")
def cluster_hypothesis(spark, d):
    return inspection(spark, d).clusters.select("run_id", "cluster_id", "hypothesis", F.array_join("upstream", ",").alias("upstream"))


@query("cluster_signature", "SELECT run_id, cluster_id, signature FROM clus")
def cluster_signature(spark, d):
    return inspection(spark, d).clusters.select("run_id", "cluster_id", "signature")


@query("propagation_path", "SELECT run_id, cluster_id, CASE WHEN len(path) > 0 THEN array_to_string(path, ' -> ') ELSE ps END AS path FROM clus_h")
def propagation_path(spark, d):
    return inspection(spark, d).clusters.select("run_id", "cluster_id", F.array_join("path", " -> ").alias("path"))


@query("affected_downstream", "SELECT run_id, cluster_id, ps AS service, array_to_string(downstream, ',') AS downstream FROM clus")
def affected_downstream(spark, d):
    return inspection(spark, d).clusters.select(
        "run_id", "cluster_id", F.col("primary.service").alias("service"), F.array_join("downstream", ",").alias("downstream"))


@query("evidence_ids", """
SELECT g.run_id, c.cluster_id, concat(g.rule_id, ':', g.service, '/', g.instance, '/', g.metric) AS evidence_id, g.anomaly_id = c.pid AS is_primary
FROM grp0 g JOIN clus c USING (run_id, cluster_key)""")
def evidence_ids(spark, d):
    return CL.evidence(inspection(spark, d).members).select("run_id", "cluster_id", "evidence_id", "is_primary")


# ------------------------------------------------------------------ rollups
view("svc_stats", """
SELECT w.run_id, s.service, s.grp, count(a.anomaly_id) AS anomaly_count, min(a.level) AS max_level,
  count(DISTINCT CASE WHEN list_contains(s.instances, a.instance) THEN a.instance END) AS affected_instances, s.instance_count AS total_instances,
  array_to_string(list_sort(list(DISTINCT a.rule_id) FILTER (a.rule_id IS NOT NULL)), ',') AS rules,
  arg_min(a.metric, (a.level, -a.deviation_score, a.anomaly_id)) AS worst_metric, arg_min(a.observed, (a.level, -a.deviation_score, a.anomaly_id)) AS wobs,
  arg_min(a.baseline_value, (a.level, -a.deviation_score, a.anomaly_id)) AS wbase
FROM windows w CROSS JOIN svc s LEFT JOIN active a ON a.run_id = w.run_id AND a.service = s.service GROUP BY w.run_id, s.service, s.grp, s.instances, s.instance_count""")
view("svc_stats2", """
SELECT s.*, (SELECT array_to_string(list_sort(list(c.cluster_id)), ',') FROM clus c WHERE c.run_id = s.run_id AND c.ps = s.service) AS root_cause_of,
  (SELECT count(*) FROM clus c WHERE c.run_id = s.run_id AND c.ps = s.service) AS roots,
  (SELECT array_to_string(list_sort(list(c.cluster_id)), ',') FROM clus c WHERE c.run_id = s.run_id AND list_contains(c.services, s.service)) AS in_clusters
FROM svc_stats s""")
_ROLL = """CAST(count(*) AS BIGINT) AS service_count, CAST(count(*) FILTER (anomaly_count > 0) AS BIGINT) AS affected_services, CAST(sum(anomaly_count) AS BIGINT) AS anomaly_count,
  min(max_level) AS max_level, CAST(sum(affected_instances) AS BIGINT) AS affected_instances, CAST(sum(total_instances) AS BIGINT) AS total_instances,
  CAST(sum(roots) AS BIGINT) AS root_cause_count"""


@query("service_stats", f"""
SELECT run_id, service, grp, CAST(anomaly_count AS BIGINT) AS anomaly_count, max_level, CAST(affected_instances AS BIGINT) AS affected_instances, total_instances,
  rnd(affected_instances / CAST(total_instances AS DOUBLE), 4) AS affected_ratio, coalesce(rules, '') AS rules, worst_metric,
  concat('observed ', {_fmt('wobs')}, CASE WHEN wbase IS NULL THEN '' ELSE concat(', baseline ', {_fmt('wbase')}) END, ' (P', max_level, ')') AS worst_summary,
  coalesce(root_cause_of, '') AS root_cause_of, coalesce(in_clusters, '') AS in_clusters FROM svc_stats2""")
def service_stats(spark, d):
    s = inspection(spark, d).service_stats
    return s.select("run_id", "service", "grp", "anomaly_count", "max_level", "affected_instances", "total_instances",
                    rnd("affected_ratio").alias("affected_ratio"), F.array_join("rules", ",").alias("rules"), "worst_metric", "worst_summary",
                    F.array_join("root_cause_of", ",").alias("root_cause_of"), F.array_join("in_clusters", ",").alias("in_clusters"))


def _longs(df, *keys):
    cols = ["service_count", "affected_services", "anomaly_count", "affected_instances", "total_instances", "root_cause_count"]
    return df.select(*keys, "max_level", *[F.col(c).cast("long").alias(c) for c in cols])


@query("group_stats", f"SELECT run_id, grp, {_ROLL} FROM svc_stats2 GROUP BY run_id, grp")
def group_stats(spark, d):
    return _longs(RU.group_stats(inspection(spark, d).service_stats), "run_id", "grp")


@query("stats_grouping_sets", f"""
SELECT run_id, grp, service, CAST(grouping(grp) * 2 + grouping(service) AS BIGINT) AS level_of_detail, {_ROLL} FROM svc_stats2
GROUP BY GROUPING SETS ((run_id, grp, service), (run_id, grp), (run_id))""")
def stats_grouping_sets(spark, d):
    g = RU.grouping_sets(inspection(spark, d).service_stats)
    return _longs(g.withColumn("level_of_detail", F.col("level_of_detail").cast("long")), "run_id", "grp", "service", "level_of_detail")


@query("stats_ordered", """
SELECT run_id, service, CAST(row_number() OVER (PARTITION BY run_id ORDER BY coalesce(max_level, 99), anomaly_count DESC, service) AS INT) AS position FROM svc_stats""")
def stats_ordered(spark, d):
    from pyspark.sql import Window as W
    s = RU.ordered(inspection(spark, d).service_stats)
    w = W.partitionBy("run_id").orderBy(F.coalesce("max_level", F.lit(RU.NO_LEVEL)), F.desc("anomaly_count"), "service")
    return s.select("run_id", "service", F.row_number().over(w).alias("position"))
