"""Sections of an inspection report, each a DataFrame of rows keyed by run.

A section has one row an item, so no run's items are collected into one row, whatever their number. `document` turns
sections into one table of (run_id, section, position, body), which is stored by run and looked up by run.
Positions rank rows by the section's own order; ties end in a key, so reports are reproducible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulseframe.functions import duration_text, fmt
from pulseframe.operators import clusters as CL
from pulseframe.operators import history as H
from pulseframe.sources.points import replace_keys

#: lines of an alert, labels of a trend's reasoning, length of quoted sentences (fixed values)
ALERT_LINES, REASON_LABELS, QUOTED = 10, 3, 120
FORECAST = "unless it is handled in this window, it will spread further up the dependencies"


def label(level: str = "level") -> Column:
    """[P1] service/instance metric"""
    return F.concat(F.lit("[P"), F.col(level).cast("string"), F.lit("] "), F.concat_ws("/", "service", "instance"), F.lit(" "), F.col("metric"))


# ------------------------------------------------------------------ anomalies and clusters of runs
def anomaly_rows(anomalies: DataFrame) -> DataFrame:
    """Every anomaly of every run, active or suppressed, with what a reader sees of it."""
    return anomalies.select(
        "run_id", F.when(F.col("is_suppressed"), "suppressed").otherwise("active").alias("state"), "anomaly_id", "level", "service", "instance", "metric",
        "observed", "baseline_value", "deviation_pct", duration_text("duration_min").alias("lasted"), "first_seen", "deviation_score", "reason", "suppressed_by")


def cluster_rows(clusters: DataFrame, conclusions: DataFrame) -> DataFrame:
    """Every cluster with its conclusion, a sentence on the cause and the path it spread on."""
    c = clusters.withColumn("cause", CL.hypothesis_text()).select(
        "run_id", "cluster_id", "rank", "max_level", "size", F.col("primary.service").alias("service"), F.col("primary.metric").alias("metric"),
        F.array_join("services", ", ").alias("services"), F.array_join("path", " -> ").alias("path"), "hypothesis", "cause")
    r = conclusions.select("run_id", "cluster_id", "category", "confidence", "change_id", "minutes_before", "is_recurring", "owner", "impact")
    after = F.when(F.col("change_id").isNotNull(), F.concat(F.lit("; "), fmt("minutes_before", 1), F.lit(" minutes after change "), F.col("change_id")))
    return c.join(r, ["run_id", "cluster_id"], "left").withColumn("cause", F.concat("cause", F.coalesce(after, F.lit(""))))


def of_run(rows: DataFrame, run_id: str, *order: str) -> DataFrame:
    """The rows of one run, the worst first: a stored table needs only that run's partition."""
    return rows.where(F.col("run_id") == run_id).orderBy(*order)


# ------------------------------------------------------------------ comparison
def recurring_anomalies(members: DataFrame, recurrence: DataFrame) -> DataFrame:
    """Anomalies whose cluster came back: run_id, anomaly_id."""
    hit = recurrence.where("is_recurring").select("run_id", "cluster_id")
    return members.join(hit, ["run_id", "cluster_id"], "left_semi").select("run_id", "anomaly_id").distinct()


def comparison_items(anomalies: DataFrame, runs: DataFrame, recurring: DataFrame) -> DataFrame:
    """run_id, prev_run_id, state (new, persistent, recovered or recurring), anomaly_id, item: what changed since the run before.

    An anomaly that came back is listed as recurring beside being new or persistent.
    """
    pairs = H.previous_run(runs).where("prev_run_id IS NOT NULL").select("run_id", "prev_run_id")
    diff = H.run_diff(anomalies, pairs)
    again = recurring.join(pairs.select("run_id"), "run_id", "left_semi").select("run_id", "anomaly_id", F.lit("recurring").alias("state"))
    states = diff.select("run_id", "anomaly_id", "state").unionByName(again).join(pairs, "run_id")
    at = F.when(F.col("state") == "recovered", F.col("prev_run_id")).otherwise(F.col("run_id"))
    text = anomalies.select(F.col("run_id").alias("_at"), "anomaly_id", label().alias("item")).groupBy("_at", "anomaly_id").agg(F.min("item").alias("item"))
    return states.withColumn("_at", at).join(text, ["_at", "anomaly_id"]).select("run_id", "prev_run_id", "state", "anomaly_id", "item")


def comparison_summary(items: DataFrame, runs: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per run that has a predecessor: score change, trend, sizes of the four sets, and a sentence."""
    states = ("new", "recovered", "persistent", "recurring")
    n = items.groupBy("run_id").agg(*[F.count_if(F.col("state") == s).alias(s) for s in states])
    j = H.score_trend(runs, scores).join(n, "run_id", "left").fillna(0, list(states))
    j = j.join(runs.select(F.col("run_id").alias("prev_run_id"), F.col("started_at").alias("prev_started_at")), "prev_run_id", "left")
    size = F.format_string("%.1f", F.abs("delta"))
    head = F.when(F.col("trend") == "up", F.concat(F.lit("score up by "), size)).when(
        F.col("trend") == "down", F.concat(F.lit("score down by "), size)).otherwise(F.concat(F.lit("score about the same, changed by "), size))
    body = F.concat(F.lit("; "), F.col("new").cast("string"), F.lit(" new, "), F.col("recovered").cast("string"), F.lit(" recovered, "),
                    F.col("persistent").cast("string"), F.lit(" still there"))
    tail = F.when(F.col("recurring") > 0, F.concat(F.lit("; "), F.col("recurring").cast("string"), F.lit(" came back, so the last remedy did not hold"))).when(
        F.col("persistent") > 0, F.lit("; see whether somebody follows what is still there")).otherwise(F.lit(""))
    return j.select("run_id", "prev_run_id", "prev_started_at", "delta", "trend", *states, F.concat(head, body, tail).alias("summary"))


# ------------------------------------------------------------------ advice and trend
def suggestion_rows(conclusions: DataFrame, summary: DataFrame) -> DataFrame:
    """What to do now (a cluster's first suggestion), soon (its others) and in the long run (the run's advice)."""
    each = conclusions.select("run_id", "cluster_id", "category", F.posexplode("suggestions").alias("_i", "suggestion"))
    own = each.select("run_id", F.when(F.col("_i") == 0, "now").otherwise("soon").alias("horizon"), "cluster_id", "category",
                      F.col("_i").alias("position"), "suggestion")
    late = summary.select("run_id", F.lit("long run").alias("horizon"), F.lit(None).cast("string").alias("cluster_id"),
                          F.lit(None).cast("string").alias("category"), F.posexplode("advice").alias("position", "suggestion"))
    return own.unionByName(late)


def trend_judgement(clusters: DataFrame, members: DataFrame, runs: DataFrame) -> DataFrame:
    """Direction of each run, why, and what comes next: the open groups, and the worst one's first three signals."""
    order = F.struct(~F.col("is_primary"), F.col("level"), -F.col("deviation_score"), F.col("anomaly_id"))
    signal = members.where("cluster_rank = 1").groupBy("run_id", F.concat_ws(" ", "service", "metric").alias("signal")).agg(F.min(order).alias("_o"))
    w = W.partitionBy("run_id").orderBy("_o", "signal")
    top = signal.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= REASON_LABELS)
    named = top.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "signal"))), lambda x: x["signal"]), ", ").alias("names"))
    n = clusters.groupBy("run_id").agg(F.count("*").alias("open"))
    j = runs.select("run_id").join(n, "run_id", "left").join(named, "run_id", "left")
    calm = F.col("open").isNull()
    return j.select(
        "run_id", F.when(calm, "stable").otherwise("degrading").alias("direction"),
        F.when(calm, "nothing beyond its limits").otherwise(F.concat(
            F.col("open").cast("string"), F.lit(" root-cause groups are open, about "), "names")).alias("reasoning"),
        F.when(~calm, F.lit(FORECAST)).alias("forecast"))


# ------------------------------------------------------------------ appendix
def appendix_rows(quality: DataFrame, rule_hits: DataFrame, coverage: DataFrame, changes: DataFrame) -> DataFrame:
    """run_id, topic, name, value: data quality, hits of each rule that fired, baseline coverage and visible changes.

    quality: run_id, points, expected, confidence; the others as their operators return them.
    """
    def rows(df, topic, name, value):
        return df.select("run_id", F.lit(topic).alias("topic"), name.cast("string").alias("name"), value.cast("string").alias("value"))
    missing = F.round(100.0 * (1 - F.least(F.lit(1.0), F.try_divide(F.col("points"), F.col("expected")))), 2)
    parts = [
        rows(quality, "data", F.lit("points"), F.col("points")), rows(quality, "data", F.lit("missing %"), F.format_string("%.2f", missing)),
        rows(quality, "data", F.lit("confidence"), F.col("confidence")), rows(rule_hits.where("hits > 0"), "rule", F.col("rule_id"), F.col("hits")),
        rows(coverage, "baseline", F.lit("dynamic %"), F.format_string("%.0f", F.round(F.col("dynamic_ratio") * 100, 0))),
        rows(changes, "change", F.col("change_id"), F.concat_ws(" ", "service", "type"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def window_quality(points: DataFrame, windows: DataFrame, instances: DataFrame, metrics: int, step_seconds: int) -> DataFrame:
    """run_id, points, expected (declared instances x metrics x buckets of the window), confidence, from windowed points."""
    have = points.groupBy("run_id").agg(F.count("*").alias("points"))
    n = instances.agg((F.count("*") * metrics).alias("series"))
    span = F.unix_seconds("window_end") - F.unix_seconds("window_start")
    # one row on the right: the number of declared series
    out = windows.join(have, "run_id", "left").crossJoin(n).select(
        "run_id", F.coalesce("points", F.lit(0)).alias("points"), (F.col("series") * F.ceil(span / step_seconds)).alias("expected"))
    share = F.try_divide(F.col("points"), F.col("expected"))
    return out.withColumn("confidence", F.when(share >= 0.95, "high").when(share >= 0.8, "medium").otherwise("low"))


# ------------------------------------------------------------------ alert and document
def quoted(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(c) <= QUOTED, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, QUOTED - 3)), F.lit("...")))


def alert_messages(anomalies: DataFrame, scores: DataFrame, windows: DataFrame, causes: DataFrame, suggestions: DataFrame, max_level: int = 2) -> DataFrame:
    """The whole alert of each run with urgent active anomalies: score, window, the worst lines, cause and first action.

    causes: cluster_rows(); suggestions: suggestion_rows().
    """
    short = H.alert_payload(anomalies, scores, causes.select("run_id", "cluster_id", "category"), ALERT_LINES, max_level)
    first = causes.where("rank = 1").select("run_id", F.concat(F.lit("cause: "), "category", F.lit(", "), quoted("cause")).alias("_cause"), "cluster_id")
    act = suggestions.where("horizon = 'now'").select("run_id", "cluster_id", F.concat(F.lit("first: "), quoted("suggestion")).alias("_act"))
    first = first.join(act, ["run_id", "cluster_id"], "left").drop("cluster_id")
    span = F.concat(F.lit("window: "), F.date_format("window_start", "yyyy-MM-dd HH:mm"), F.lit(" to "), F.date_format("window_end", "yyyy-MM-dd HH:mm"))
    j = short.join(windows.select("run_id", span.alias("_span")), "run_id").join(first, "run_id", "left")
    rest = F.col("urgent") - ALERT_LINES
    more = F.when(rest > 0, F.concat(F.lit("and "), rest.cast("string"), F.lit(" more")))
    return j.select("run_id", "title", F.concat_ws("\n", F.concat(F.lit("run: "), "run_id"), "_span", "text", more, "_cause", "_act").alias("text"))


def document(sections: dict[str, tuple[DataFrame, list[Column]]]) -> DataFrame:
    """run_id, section, position, body (JSON) of all rows of the sections, given with the order of their rows.

    Rows are ranked within a run and section by one window; the table is what a report stores.
    """
    out = None
    for name, (rows, order) in sections.items():
        body = F.to_json(F.struct(*[c for c in rows.columns if c != "run_id"]))
        w = W.partitionBy("run_id").orderBy(*order)
        part = rows.select("run_id", F.lit(name).alias("section"), F.row_number().over(w).alias("position"), body.alias("body"))
        out = part if out is None else out.unionByName(part)
    return out


def store_report(doc: DataFrame, path: str, runs: DataFrame) -> None:
    """Replace the stored reports of `runs`; one without rows leaves none."""
    replace_keys(doc, path, ("run_id",), runs)
