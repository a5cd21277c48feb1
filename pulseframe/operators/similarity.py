"""Set-similarity join of short token lists, for signatures that a whole archive of runs shares.

Tokens are ordered by how many sets hold them, rare ones first. Two sets of Jaccard similarity t or more must share
one of their first n - ceil(t n) + 1 tokens, so only these prefixes are joined; lengths and positions rule out most
of what meets there, and each pair is verified once, at its first common token. Frequent tokens stand last and are
joined only by sets that hold little else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.session import write_stage

#: Guards a product like 0.6 * 5 against rounding up.
EPSILON = 1e-9


def tokens(signature: Column) -> Column:
    """The distinct parts of a signature."""
    return F.array_distinct(F.filter(F.split(signature, "&"), lambda x: x != ""))


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """a, b, similarity of all pairs of different `sets` (id, tokens) with Jaccard similarity `threshold` or more, both ways.

    Ids are distinct and tokens distinct within a set; empty sets resemble nothing.
    """
    s = sets.where(F.size("tokens") > 0).select("id", "tokens")
    df = s.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    each = s.select("id", F.explode("tokens").alias("t")).join(df, "t")
    ranked = each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "t"))), lambda x: x["t"]).alias("ts"))
    ranked = write_stage(ranked.withColumn("n", F.size("ts")), "ranked-sets")
    prefix = F.expr(f"slice(ts, 1, n - int(ceil({threshold!r}D * n - {EPSILON})) + 1)")
    probe = ranked.select("id", "ts", "n", F.posexplode(prefix).alias("pos", "t"))
    x, y = probe.alias("x"), probe.alias("y")
    met = x.join(y, F.col("x.t") == F.col("y.t")).where(
        (F.col("x.id") < F.col("y.id")) & (F.col("y.n") >= threshold * F.col("x.n") - EPSILON) & (F.col("x.n") >= threshold * F.col("y.n") - EPSILON))
    # what is left of both after this token bounds what they can share, if it is the first common one
    need = threshold / (1 + threshold) * (F.col("x.n") + F.col("y.n")) - EPSILON
    met = met.where(F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) >= need)
    common = F.array_intersect("x.ts", "y.ts")
    met = met.where(common[0] == F.col("x.t"))
    k = F.size(common)
    pairs = met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), (k / (F.col("x.n") + F.col("y.n") - k)).alias("similarity")).where(
        F.col("similarity") >= threshold)
    pairs = write_stage(pairs, "similar-sets")
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))


def recurring(clusters: DataFrame, history: DataFrame, runs: DataFrame, threshold: float, earlier_only: bool = True) -> DataFrame:
    """Whether a cluster resembles one of an earlier window (or of any other): run_id, cluster_id, is_recurring.

    Clusters of equal signature are one set, with the first and last window it was seen in, so a signature that
    returns in every run costs one row here however often it does.
    """
    w = runs.select("run_id", "window_end")
    past = history.join(w, "run_id").groupBy("signature").agg(F.min("window_end").alias("first"), F.max("window_end").alias("last"))
    now = clusters.join(w, "run_id", "left").select("run_id", "cluster_id", "signature", "window_end")
    sets = past.select("signature").unionByName(now.select("signature")).where("signature IS NOT NULL").distinct()
    sets = write_stage(sets.select(F.col("signature").alias("id"), F.array_sort(tokens(F.col("signature"))).alias("tokens")), "signatures")
    # signatures of the same tokens in another order or number are equal sets
    one = write_stage(sets.groupBy("tokens").agg(F.min("id").alias("set"), F.collect_list("id").alias("ids")), "token-sets")
    members = one.select("set", F.explode("ids").alias("signature"))
    seen = past.join(members, "signature").groupBy("set").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    like = similar_sets(one.select(F.col("set").alias("id"), "tokens"), threshold).select("a", "b").unionByName(
        one.where(F.size("tokens") > 0).select(F.col("set").alias("a"), F.col("set").alias("b")))
    span = like.join(seen.withColumnRenamed("set", "b"), "b").groupBy(F.col("a").alias("set")).agg(
        F.min("first").alias("first"), F.max("last").alias("last"))
    out = now.join(members, "signature", "left").join(span, "set", "left")
    apart = F.col("first") < F.col("window_end")
    if not earlier_only:
        apart = apart | (F.col("last") > F.col("window_end"))
    return out.select("run_id", "cluster_id", F.coalesce(apart, F.lit(False)).alias("is_recurring"))
