"""Literal series and baselines for single-operator tests."""

from pyspark.sql import functions as F

from pulseframe.operators import graph as G
from pulseframe.operators import stats
from pulseframe.operators.rules import Inputs
from pulseframe.operators.windows import assign_windows
from pulseframe.policy import Policy, Service
from pulseframe.schemas import RKEY
from pulseframe.session import literal_table

END = 1_790_000_040  # a whole minute
STEP = 60


def small_policy(**kw):
    services = kw.pop("services", None) or [
        Service("order-svc", ["order-svc-0", "order-svc-1", "order-svc-2"], ["bank"], "trade", criticality=1.0),
        Service("bank", ["bank-0"], [], "external", external=True, criticality=0.5),
    ]
    return Policy(services=services, **kw)


def rows(metric, values, service="order-svc", instance="order-svc-0", step=STEP, end=END):
    start = end - len(values) * step
    return [(service, instance, metric, start + i * step, None if v is None else float(v)) for i, v in enumerate(values)]


def points(spark, *series):
    data = [r for s in series for r in s if r[4] is not None]
    df = literal_table(spark, [("service", "string"), ("instance", "string"), ("metric", "string"), ("t", "long"), ("value", "double")], data)
    return df.withColumn("ts", F.timestamp_seconds("t")).drop("t").select("service", "instance", "metric", "ts", "value")


def window(spark, minutes=30, end=END, archive_days=14, run_id="r1"):
    w = literal_table(spark, [("run_id", "string"), ("scenario_id", "string"), ("ws", "long"), ("we", "long"), ("a0", "long"), ("a1", "long")],
                      [(run_id, None, end - minutes * 60, end, end - archive_days * 86400, end)])
    return w.select("run_id", "scenario_id", *[F.timestamp_seconds(c).alias(n) for n, c in (
        ("window_start", "ws"), ("window_end", "we"), ("archive_start", "a0"), ("archive_end", "a1"))])


def baseline(spark, *items):
    """items: (metric, median[, scale[, instance[, service]]]); scale defaults to its relative floor."""
    data = []
    for it in items:
        metric, med = it[0], float(it[1])
        scale = float(it[2]) if len(it) > 2 and it[2] is not None else abs(med) * 0.008
        instance = it[3] if len(it) > 3 else "order-svc-0"
        service = it[4] if len(it) > 4 else "order-svc"
        data.append(("r1", service, instance, metric, "dynamic", 200, med, scale, scale))
    cols = [(c, "string") for c in ("run_id", "service", "instance", "metric", "mode")] + [
        ("sample_size", "long"), ("median", "double"), ("scale", "double"), ("stdev", "double")]
    return literal_table(spark, cols, data).withColumn("hour_median", F.lit(None).cast("double"))


def inputs(spark, pts, base, policy=None, minutes=30):
    policy = policy or small_policy()
    w = window(spark, minutes)
    svc = policy.service_dim(spark)
    e = G.edges(svc)
    paths = G.leaf_walks(G.walks(e, svc.select(F.col("service").alias("node"))), e)
    windowed = stats.window_series(assign_windows(pts, w.select("run_id", "window_start", "window_end")), RKEY)
    return Inputs(windowed, base, pts, w, paths, policy)
