"""Best paths of a dependency graph, layer by layer, without listing paths.

`condense` deals nodes into layers from the leaves up, so that a node's dependencies lie in lower layers and each
layer needs one join. Nodes that depend on each other form a group and are dealt together; only inside such a
group are simple paths listed (`segments`), as a cheapest simple path through a cycle has no shorter description.
A path from a node is then a segment, a dependency that leaves the group, and a path from there on. Work grows
with edges, not with paths: a ladder of 40 layers has 2^40 of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.operators import graph as G
from pulseframe.session import Rounds, write_stage

ARROW = " -> "


@dataclass
class Condensed:
    """nodes     node, layer, path (a longest simple path from it, the smallest of equal length)
    segments  node, seg (simple path inside the node's group), last, layer
    exits     src, dst: dependencies between groups
    cyclic    whether any group has several nodes
    depth     number of layers
    """
    nodes: DataFrame
    segments: DataFrame
    exits: DataFrame
    cyclic: bool
    depth: int


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def longest(path: str, by: str = "node"):
    """Longest path, the smallest of equal length."""
    return F.min_by(path, F.struct(-F.size(path), F.col(path)))


def condense(e: DataFrame, nodes: DataFrame | None = None) -> Condensed:
    """Layers, segments and longest paths of the graph of `e` and of single `nodes` (column node)."""
    inner = write_stage(e.select("src", "dst").where("src <> dst").distinct(), "inner-edges")
    every = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node")))
    if nodes is not None:
        every = every.unionByName(nodes.select("node"))
    every = write_stage(every.distinct(), "nodes")
    total, have = every.count(), 0
    done, grouped = Rounds(e.sparkSession, "layers"), []
    while have < total:
        if done.n:
            known = done.all().select("node", "path")
            out = inner.join(known.select(F.col("node").alias("src")), "src", "left_anti").join(
                known.withColumnRenamed("node", "dst"), "dst", "left")
            out = out.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("deps"), F.count("path").alias("got"), longest("path").alias("best"))
            ready = out.where("deps = got").select("node", F.lit(done.n).alias("layer"), F.concat(F.array("node"), "best").alias("path"))
        else:
            ready = every.join(inner.select(F.col("src").alias("node")), "node", "left_anti").select(
                "node", F.lit(0).alias("layer"), F.array("node").alias("path"))
        done.add(ready)
        if not done.added:
            lowest, own = cyclic_layer(every, inner, known if done.n > 1 else None, done.n)
            grouped.append(own)
            done.add(lowest)
        have += done.added
    if not done.n:
        done.add(every.select("node", F.lit(0).alias("layer"), F.array("node").alias("path")))
    layers = done.all()
    single = layers.join(union(grouped).select("node"), "node", "left_anti") if grouped else layers
    segments = [single.select("node", F.array("node").alias("seg"), F.col("node").alias("last"), "layer")]
    exits = inner
    if grouped:
        pairs = union([g.select(F.col("node").alias("src"), F.col("last").alias("dst")).distinct() for g in grouped])
        exits = write_stage(inner.join(pairs, ["src", "dst"], "left_anti"), "exits")
    return Condensed(layers, union(segments + grouped), exits, bool(grouped), done.n)


def cyclic_layer(every: DataFrame, inner: DataFrame, known: DataFrame | None, layer: int) -> tuple[DataFrame, DataFrame]:
    """The lowest groups among nodes that are all on, or above, a cycle: (their nodes with longest paths, their segments)."""
    rest, core = every, inner
    if known is not None:
        names = known.select("node")
        rest = every.join(names, "node", "left_anti")
        core = inner.join(names.withColumnRenamed("node", "dst"), "dst", "left_anti").join(names.withColumnRenamed("node", "src"), "src", "left_anti")
    reach = G.closure(core).select("src", "dst")
    mutual = reach.join(reach.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"])
    own = mutual.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m"))
    group = write_stage(rest.join(own, "node", "left").select("node", F.least("node", F.coalesce("m", "node")).alias("grp")), "groups")
    left = core.join(group.select(F.col("node").alias("src"), F.col("grp").alias("gs")), "src").join(
        group.select(F.col("node").alias("dst"), F.col("grp").alias("gd")), "dst")
    lowest = group.join(left.where("gs <> gd").select(F.col("gs").alias("grp")), "grp", "left_anti")
    inside = write_stage(left.where("gs = gd").select("src", "dst").join(lowest.select(F.col("node").alias("src")), "src", "left_semi"), "inside")
    grown = Rounds(every.sparkSession, "segments")
    open_ = grown.add(lowest.select("node", F.array("node").alias("seg"), F.col("node").alias("last")))
    while grown.added:
        nxt = open_.join(inside.select(F.col("src").alias("last"), "dst"), "last").where(~F.array_contains("seg", F.col("dst")))
        open_ = grown.add(nxt.select("node", F.concat("seg", F.array("dst")).alias("seg"), F.col("dst").alias("last")))
    segments = grown.all().withColumn("layer", F.lit(layer))
    onward = segments.select("node", "seg")
    if known is not None:
        exits = inner.select(F.col("src").alias("last"), "dst").join(known.withColumnRenamed("node", "dst"), "dst")
        onward = onward.unionByName(segments.join(exits, "last").select("node", F.concat("seg", "path").alias("seg")))
    ready = onward.groupBy("node").agg(longest("seg").alias("path")).select("node", F.lit(layer).alias("layer"), "path")
    return ready, segments


def longest_paths(e: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """A longest simple path from every node, the smallest of equal length: head, path."""
    return condense(e, nodes).nodes.select(F.col("node").alias("head"), "path")


def worst_paths(c: Condensed, e: DataFrame, values: DataFrame, keys: list[str], min_length: int = 2) -> DataFrame:
    """Per `keys` and head the path to a node without dependencies whose product of shares is least at any time.

    values: *keys, service, ts, share. Only times at which all nodes of a path have a share count. Of equal
    products the path of the smallest text wins. Returns *keys, head, path. One state row a node, time and path
    length (capped at min_length) holds the least product with its path, and the smallest path of all, which is
    the answer wherever a share of zero makes all products equal.
    """
    at = [*keys, "ts"]
    values = write_stage(values.select(*at, F.col("service").alias("node"), "share"), "shares")
    leaf = c.segments.select(F.col("last").alias("node")).distinct().join(e.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
    if c.cyclic:
        each = c.segments.select("node", "seg", "last", "layer", F.explode("seg").alias("_n"))
        curve = each.join(values.withColumnRenamed("node", "_n"), "_n").groupBy("node", "seg", "last", "layer", *at).agg(
            F.count("*").alias("k"), F.product("share").alias("share")).where(F.col("k") == F.size("seg")).drop("k")
        curve = write_stage(curve, "segment-shares")
    else:
        curve = c.segments.join(values, "node")
    text = F.array_join("path", ARROW)
    states = Rounds(values.sparkSession, "path-states")
    for layer in range(c.depth):
        own = curve.where(F.col("layer") == layer)
        ends = own.join(leaf.withColumnRenamed("node", "last"), "last", "left_semi").select(
            "node", *at, F.least(F.size("seg"), F.lit(min_length)).alias("length"), F.col("share").alias("health"),
            F.col("seg").alias("path"), F.col("seg").alias("first"))
        if layer:
            below = states.all().select(F.col("node").alias("dst"), *at, F.col("length").alias("_l"), F.col("best.health").alias("_h"),
                                         F.col("best.path").alias("_p"), F.col("first.path").alias("_f"))
            on = own.join(c.exits.select(F.col("src").alias("last"), "dst"), "last").join(below, ["dst", *at])
            on = on.select("node", *at, F.least(F.size("seg") + F.col("_l"), F.lit(min_length)).alias("length"), (F.col("share") * F.col("_h")).alias("health"),
                           F.concat("seg", F.when(F.col("share") == 0, F.col("_f")).otherwise(F.col("_p"))).alias("path"),
                           F.concat("seg", "_f").alias("first"))
            ends = ends.unionByName(on)
        state = ends.groupBy("node", *at, "length").agg(
            F.min(F.struct("health", text.alias("text"), "path")).alias("best"),
            F.min(F.struct(F.array_join("first", ARROW).alias("text"), F.col("first").alias("path"))).alias("first"))
        states.add(state)
    every = states.all().where(F.col("length") >= min_length)
    return every.groupBy(*keys, F.col("node").alias("head")).agg(F.min("best").alias("b")).select(*keys, "head", F.col("b.path").alias("path"))


def path_rows(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Paths as one row a node: *keys, head, path_text, path_id, path_len, pos, node."""
    text = F.array_join("path", ARROW)
    return paths.select(*keys, "head", text.alias("path_text"), F.xxhash64("head", text).alias("path_id"), F.size("path").alias("path_len"),
                        F.posexplode("path").alias("pos", "node"))


def reach(e: DataFrame, sources: DataFrame, upstream: bool = False) -> DataFrame:
    """What `sources` (column node) depend on, or with `upstream` what depends on them: src, dst, hops, path.

    Breadth first from the sources alone: a pair of source and node enters the frontier once, with its smallest
    shortest path in the direction of dependencies. Sources reach no other pairs, so the output grows with them,
    not with all pairs of the graph.
    """
    near, far = ("dst", "src") if upstream else ("src", "dst")
    e = e.select(F.col(near).alias("at"), F.col(far).alias("to")).where("at <> to").distinct()
    seen = Rounds(e.sparkSession, "reached")
    frontier = seen.add(sources.select(F.col("node").alias("source"), F.col("node").alias("at"), F.array("node").alias("path")).distinct())
    while seen.added:
        longer = F.concat(F.array("to"), "path") if upstream else F.concat("path", F.array("to"))
        nxt = frontier.join(e, "at").select("source", F.col("to").alias("at"), longer.alias("path")).where("source <> at")
        old = seen.all().select("source", "at")
        nxt = nxt.groupBy("source", "at").agg(F.min("path").alias("path")).join(old, ["source", "at"], "left_anti")
        frontier = seen.add(nxt)
    pairs = seen.all().where("source <> at")
    ends = (F.col("at"), F.col("source")) if upstream else (F.col("source"), F.col("at"))
    return pairs.select(ends[0].alias("src"), ends[1].alias("dst"), (F.size("path") - 1).alias("hops"), "path")
