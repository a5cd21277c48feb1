"""Group anomalies over the dependency graph and pick each group's root cause.

A group may hold a large share of all anomalies, so nothing here windows over a group or
collects its rows: flags, extremes and the winner are grouped aggregates joined back.
Collected sets hold service names, service.metric tokens and rule ids, all bounded by the
topology.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulseframe.operators import graph as G
from pulseframe.policy import AFFINITY, LEVEL_SCORE

VOLUME_RULES = ("BIZ-03", "BIZ-04")
CHAIN_RULE = "BIZ-06"
# fixed values: root-cause score weights, and the affinity from which a signal counts as a bottleneck
W_AFFINITY, W_LEVEL, W_DIRECTION, W_EARLIEST = 0.40, 0.25, 0.20, 0.15
CAUSAL_THRESHOLD = 0.6
CKEY = ["run_id", "cluster_key"]


def _lookup(col: str, table: dict, default: float):
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(F.col(col) == k, F.lit(v)).otherwise(out)
    return out


def group(active: DataFrame, closure: DataFrame, services: DataFrame, induced: bool = False) -> DataFrame:
    """Add `cluster_key`: the topology component of the service, or the anomaly itself if its
    service is not in the topology.

    By default components span the whole topology; `induced` keeps only dependencies between
    services affected in the same run.
    """
    # all related pairs rather than direct edges: labels then settle in two rounds
    e = closure.select("src", "dst")
    nodes = services.select(F.col("service").alias("node"))
    if induced:
        e = closure.where("hops = 1").select("src", "dst")
        hit = active.select("run_id", "service").distinct().join(services.select("service"), "service", "left_semi")
        node = F.concat_ws("/", "run_id", "service")
        src = e.join(hit.withColumnRenamed("service", "src"), "src")
        both = src.join(hit.withColumnRenamed("service", "dst"), ["run_id", "dst"])
        e = both.select(F.concat_ws("/", "run_id", "src").alias("src"), F.concat_ws("/", "run_id", "dst").alias("dst"))
        comp = G.components(e, hit.select(node.alias("node")))
        out = active.withColumn("_node", node).join(comp.withColumnRenamed("node", "_node"), "_node", "left").drop("_node")
    else:
        comp = G.components(e, nodes)
        out = active.join(comp.withColumnRenamed("node", "service"), "service", "left")
    return out.withColumn("cluster_key", F.coalesce("component", F.concat(F.lit("#"), "anomaly_id"))).drop("component")


def candidates(grouped: DataFrame) -> DataFrame:
    """Flag who may be the root cause: traffic rules if any fired, else all but the chain rule,
    which only summarises others, else all."""
    vol, chain = F.col("rule_id").isin(*VOLUME_RULES), F.col("rule_id") == CHAIN_RULE
    flags = grouped.groupBy(*CKEY).agg(F.bool_or(vol).alias("_vol"), F.bool_or(~chain).alias("_other"))
    ok = F.when(F.col("_vol"), vol).when(F.col("_other"), ~chain).otherwise(F.lit(True))
    return grouped.join(flags, CKEY).withColumn("is_candidate", ok).drop("_vol", "_other")


def root_cause_scores(grouped: DataFrame, closure: DataFrame) -> DataFrame:
    """Candidates with `depth` and `cause_score` from affinity, level, direction and onset order."""
    c = candidates(grouped)
    onset = c.where("is_candidate").groupBy(*CKEY).agg(F.min("first_seen").alias("_e"), F.max("first_seen").alias("_l"))
    depth = G.depth_share(grouped.select(*CKEY, "service").distinct(), closure, CKEY)
    s = c.where("is_candidate").join(onset, CKEY).join(depth, [*CKEY, "service"])
    span = F.greatest(F.lit(1.0), (F.unix_seconds("_l") - F.unix_seconds("_e")).cast("double"))
    early = 1.0 - (F.unix_seconds("first_seen") - F.unix_seconds("_e")) / span
    aff = _lookup("dimension", AFFINITY, 0.3)
    # bottlenecks spread upstream, so deeper is likelier; symptoms start at the entry
    direction = F.when(aff >= CAUSAL_THRESHOLD, 1.0 - F.col("depth")).otherwise(F.col("depth"))
    total = W_AFFINITY * aff + W_LEVEL * _lookup("level", LEVEL_SCORE, 0.0) + W_DIRECTION * direction + W_EARLIEST * early
    return s.withColumn("cause_score", total).drop("_e", "_l", "is_candidate")


def assign(active: DataFrame, closure: DataFrame, services: DataFrame, induced: bool = False, edges: DataFrame | None = None) -> DataFrame:
    """Active anomalies with `cluster_key` and `is_primary`: severity first, then the weighted score.

    `closure` needs the pairs of affected services only, where `edges` has the topology's dependencies.
    """
    grouped = group(active, closure if edges is None else edges.withColumn("hops", F.lit(1)), services, induced)
    best = root_cause_scores(grouped, closure).groupBy(*CKEY).agg(F.min_by(
        F.struct("anomaly_id", "cause_score"), F.struct("level", -F.round("cause_score", 9), "anomaly_id")).alias("b"))
    best = best.select(*CKEY, F.col("b.anomaly_id").alias("_pid"), F.col("b.cause_score").alias("cause_score"))
    return grouped.join(best, CKEY).withColumn("is_primary", F.col("anomaly_id") == F.col("_pid")).drop("_pid")


def clusters(grouped: DataFrame, closure: DataFrame, walks: DataFrame) -> DataFrame:
    """One row per cluster, numbered per run by severity, with path, signature and hypothesis.

    `walks` (head, path) holds a longest path of each service at least; `closure` the related
    pairs of the affected services.
    """
    p = F.when(F.col("is_primary"), F.struct(
        "anomaly_id", "rule_id", "dimension", "service", "instance", "metric", "level", "observed", "baseline_value",
        "deviation_score", "first_seen", "duration_min", "baseline_mode", "reason", "cause_score"))
    c = grouped.groupBy(*CKEY).agg(
        F.max_by(p, "is_primary").alias("primary"), F.min("level").alias("max_level"), F.count("*").alias("size"),
        F.array_sort(F.collect_set("service")).alias("services"), F.array_sort(F.collect_set("rule_id")).alias("rules"),
        F.array_join(F.array_sort(F.collect_set(F.concat_ws(".", "service", "metric"))), "&").alias("signature"),
        F.countDistinct("instance").alias("instances"))
    service = F.col("primary.service")
    down = walks.groupBy(F.col("head").alias("_o")).agg(F.min_by("path", F.struct(-F.size("path"), "path")).alias("_down"))
    up = closure.groupBy(F.col("dst").alias("_o")).agg(F.min_by("path", F.struct(-F.col("hops"), "path")).alias("_up"))
    hit = grouped.select("service").distinct()
    near = closure.join(hit.withColumnRenamed("service", "src"), "src", "left_semi").join(hit.withColumnRenamed("service", "dst"), "dst", "left_semi")
    ends = F.explode(F.array(F.struct(F.col("dst").alias("o"), F.col("src").alias("up"), F.lit(None).cast("string").alias("down")),
                             F.struct(F.col("src").alias("o"), F.lit(None).cast("string").alias("up"), F.col("dst").alias("down"))))
    kin = near.select(ends.alias("e")).groupBy(F.col("e.o").alias("_o")).agg(
        F.collect_set("e.up").alias("_anc"), F.collect_set("e.down").alias("_desc"))
    c = c.withColumn("_o", service)
    for side in (down, up, kin):
        c = c.join(side, "_o", "left")
    empty = F.array().cast("array<string>")
    long = F.when(F.size(F.coalesce("_down", empty)) > 1, F.col("_down")).otherwise(F.coalesce("_up", F.array(service)))
    hit = F.filter(F.coalesce("_path", F.array(service)), lambda x: F.array_contains(F.col("services"), x))
    c = c.withColumn("_path", long).withColumn("path", F.when(F.size(hit) > 0, hit).otherwise(F.array(service)))
    c = c.withColumn("upstream", F.array_sort(F.array_intersect("services", F.coalesce("_anc", empty)))).withColumn(
        "downstream", F.array_sort(F.array_remove(F.array_intersect("services", F.coalesce("_desc", empty)), service)))
    c = c.withColumn("hypothesis", hypothesis())
    w = W.partitionBy("run_id").orderBy("max_level", F.desc("primary.deviation_score"), "primary.anomaly_id")
    rank = F.row_number().over(w)
    return c.withColumn("rank", rank).withColumn("cluster_id", F.format_string("CLUS-%02d", F.col("rank"))).drop(
        "_o", "_down", "_up", "_anc", "_desc", "_path")


def hypothesis():
    """traffic / single_service / propagating / co_occurring."""
    return (
        F.when(F.forall("rules", lambda r: r.isin(*VOLUME_RULES)), "traffic")
        .when(F.size("services") == 1, "single_service")
        .when(F.size("upstream") > 0, "propagating").otherwise("co_occurring"))


def hypothesis_text():
    s, m = F.col("primary.service"), F.col("primary.metric")
    n = F.size("services").cast("string")
    return (
        F.when(F.col("hypothesis") == "traffic", F.concat(
            n, F.lit(" services changed traffic alike; entry traffic suspected, starting at "), s))
        .when(F.col("hypothesis") == "single_service", F.concat(
            s, F.lit(": "), m, F.lit(" abnormal on "),
            F.when(F.col("instances") > 1, F.lit("several instances")).otherwise(F.col("primary.instance")),
            F.lit(", no spread upstream")))
        .when(F.col("hypothesis") == "propagating", F.concat(
            s, F.lit(": "), m, F.lit(" spreads upstream to "), F.array_join("upstream", ", ")))
        .otherwise(F.concat(n, F.lit(" services abnormal together, "), s, F.lit(" deviates most"))))


def members(grouped: DataFrame, clusters_: DataFrame) -> DataFrame:
    """Anomalies with their cluster id."""
    return grouped.join(clusters_.select(*CKEY, "cluster_id", F.col("rank").alias("cluster_rank")), CKEY)


def evidence(members_: DataFrame) -> DataFrame:
    """Evidence ids of each cluster as rows, primary flagged; each anomaly appears once."""
    eid = F.concat(F.col("rule_id"), F.lit(":"), F.concat_ws("/", "service", "instance", "metric"))
    return members_.select("run_id", "cluster_id", eid.alias("evidence_id"), "is_primary", "level", "deviation_score").distinct()
