"""Dependency-graph operators. An edge (src, dst) says src depends on dst.

`walks` enumerates simple paths with one recursive query and suits service topologies; Spark
stops it with an error, not a partial result, beyond its row limit. The others are loops of
joins for graphs of any size, with every round written to the shared stage folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.session import Rounds, write_stage

#: rows up to which the loops leave Spark free to broadcast a side; it goes by the size of files, which are compressed
FEW = 200_000
#: rows of candidate and known pairs that one job of a closure shuffles at most, unless a single source has more
MANY = 1 << 26
#: of a candidate pair's code, below its hops
RANK_BITS = 32


def edges(services: DataFrame) -> DataFrame:
    return services.select(F.col("service").alias("src"), F.explode("depends_on").alias("dst"))


def neighbors(e: DataFrame) -> DataFrame:
    """Direct downstream and upstream of every node."""
    down = e.select(F.col("src").alias("node"), F.lit("downstream").alias("side"), F.col("dst").alias("neighbor"))
    return down.unionByName(e.select(F.col("dst").alias("node"), F.lit("upstream").alias("side"), F.col("src").alias("neighbor")))


def walks(e: DataFrame, heads: DataFrame) -> DataFrame:
    """All simple paths from each head (column `node`), the head alone included: head, node, path."""
    return e.sparkSession.sql("""
        WITH RECURSIVE walk(head, node, path) AS (
          SELECT node, node, array(node) FROM {heads}
          UNION ALL
          SELECT w.head, e.dst, concat(w.path, array(e.dst)) FROM walk w JOIN {e} e ON e.src = w.node
          WHERE NOT array_contains(w.path, e.dst))
        SELECT head, node, path FROM walk""", e=e, heads=heads)


def walk_closure(w: DataFrame) -> DataFrame:
    """(src, dst, hops, path) of every reachable pair, from walks; ties take the smallest path."""
    return w.where(F.size("path") > 1).groupBy(F.col("head").alias("src"), F.col("node").alias("dst")).agg(
        (F.min(F.size("path")) - 1).cast("int").alias("hops"),
        F.min_by("path", F.struct(F.size("path"), "path")).alias("path"))


def leaf_walks(w: DataFrame, e: DataFrame) -> DataFrame:
    """Walks that end in a node without dependencies, one row per node on them."""
    leaves = w.join(e.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
    text = F.array_join("path", " -> ")
    return leaves.select(
        "head", text.alias("path_text"), F.xxhash64("head", text).alias("path_id"), F.size("path").alias("path_len"),
        F.posexplode("path").alias("pos", "node"))


def closure(e: DataFrame, with_paths: bool = False) -> DataFrame:
    """Reachable pairs with their fewest hops, by doubling: a round that starts with all pairs up to r hops adds those up to 2r.

    Such a pair has a node at exactly r hops on each of its shortest paths, so only the pairs of exactly r hops are
    joined with the known ones, not all with all. Pairs are written once, in the round that finds them. log2(depth)
    rounds; one whose join makes many rows takes the sources in slices, so that its shuffles do not grow with the table.
    With `with_paths` each pair carries its smallest shortest path: it begins with the smallest path to its node at r
    hops, so candidates carry the rank of that beginning and paths are put together for the pairs that are new.
    """
    spark = e.sparkSession
    known = Rounds(spark, "closure", lean=True)
    first = e.select("src", "dst").distinct().select("src", "dst", F.lit(1).alias("hops"))
    if with_paths:
        rank = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
        first = first.repartition("src").select("*", F.array("src", "dst").alias("path"), rank.alias("rank"))
    known.add(first)
    reach, begun, pairs = 1, 0, known.added
    while not (left := known.all(begun).where(F.col("hops") == reach)).isEmpty():
        begun = known.n
        helpers = [Rounds(spark, f"closure-{x}", lean=True) for x in ("mids", "onward", "ends", "dealt")]
        middle, onward, ends, dealt = helpers
        left = left.select("src", F.col("dst").alias("mid"), *(["rank", "path"] if with_paths else []))
        mids = middle.add(left.groupBy("mid").agg(F.count("*").alias("n")))
        right, old = known.all().withColumnRenamed("src", "mid"), known.all().select("src", "dst")
        right = onward.add(right.join(mids if middle.added <= FEW else mids.hint("merge"), "mid"))
        few = onward.added <= FEW
        last = ends.add(right.select(F.col("dst").alias("end")).distinct())
        if ends.added <= FEW:
            old = old.join(last, F.col("dst").eqNullSafe(F.col("end")), "left_semi")
        rows = pairs * (onward.added + 1)
        if rows > MANY:
            rows = pairs + (right.agg(F.sum("n")).first()[0] or 0)
        slices = rows // MANY + 1
        if slices > 1:
            left, old = dealt.deal(left, "src", slices), dealt.deal(old, "src", slices)
        for k in range(slices):
            some, seen = (df.where(F.col("slice") == k).drop("slice") if slices > 1 else df for df in (left, old))
            # by source, a task meets all middles of a pair and sends it on once
            start = some.drop("path").repartition("src") if few else some.drop("path").hint("merge")
            step = start.join(right.select("mid", "dst", (F.col("hops") + reach).alias("hops")), "mid")
            if with_paths:
                known.add(_new_paths(seen, step if few else step.repartition("src"), some, right if few else right.hint("merge")))
            else:
                both = seen.withColumn("hops", F.lit(0)).unionByName(step.select("src", "dst", "hops"))
                known.add(both.groupBy("src", "dst").agg(F.min("hops").alias("hops")).where("hops > 0"))
            pairs += known.added
        for done in helpers:
            done.drop()
        reach *= 2
    return known.all().drop("rank")


def _new_paths(seen: DataFrame, step: DataFrame, heads: DataFrame, tails: DataFrame) -> DataFrame:
    """The pairs of `step` that are not in `seen`: src, dst, hops, path, rank (among a source's paths of as many hops).

    step: src, dst, hops, rank (of the head); heads: src, mid, rank, path; tails: mid, dst, path, rank. Everything up to
    the tails stays in the partitions by source. Paths of equal hops are ordered by their head, then by their tail.
    """
    code = F.shiftleft(F.col("hops").cast("long"), RANK_BITS).bitwiseOR(F.col("rank"))
    both = seen.select("src", "dst", F.lit(0).cast("long").alias("code")).repartition("src").unionByName(step.select("src", "dst", code.alias("code")))
    code = F.col("code")
    new = both.groupBy("src", "dst").agg(F.min("code").alias("code")).where("code > 0").select(
        "src", "dst", F.shiftright(code, RANK_BITS).cast("int").alias("hops"), code.bitwiseAND(F.lit((1 << RANK_BITS) - 1)).cast("int").alias("head"))
    # a head is the first row of its source and rank; a join by source would need an exchange for null sources
    heads = heads.select("src", F.col("mid").alias("dst"), F.lit(0).alias("hops"), F.col("rank").alias("head"), "path").repartition("src")
    own = Window.partitionBy("src", "head").orderBy("hops").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = new.unionByName(heads, allowMissingColumns=True).select(
        "src", "dst", "hops", "head", F.first("dst").over(own).alias("_mid"), F.first("path").over(own).alias("path")).where("hops > 0")
    tails = tails.select("mid", F.col("dst").alias("_dst"), F.slice("path", 2, F.size("path")).alias("_path"), F.col("rank").alias("tail"))
    new = new.join(tails, (F.col("_mid") == F.col("mid")) & F.col("dst").eqNullSafe(F.col("_dst"))).select(
        "src", "dst", "hops", F.concat("path", "_path").alias("path"), "head", "tail")
    rank = F.row_number().over(Window.partitionBy("src", "hops").orderBy("head", "tail"))
    return new.select("src", "dst", "hops", "path", rank.alias("rank"))


def hop_distance(e: DataFrame, sources: DataFrame, decay: float = 0.8) -> DataFrame:
    """Fewest hops from every upstream node to its nearest source, and decay^hops.

    Breadth-first against the edges. `sources` has a column `node`; each round touches only
    the frontier, and a node enters it once.
    """
    frontier = write_stage(sources.select("node").distinct().withColumn("hops", F.lit(0)), "bfs")
    seen = frontier
    while True:
        nxt = frontier.join(e, frontier["node"] == e["dst"]).select(
            F.col("src").alias("node"), (F.col("hops") + 1).alias("hops")).distinct()
        frontier = write_stage(nxt.join(seen.select("node"), "node", "left_anti"), "bfs")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("hops > 0").withColumn("weight", F.pow(F.lit(decay), F.col("hops")))


def components(e: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Weakly connected components, labelled by their smallest node: node, component.

    Each round takes the smallest of a node's own label, its neighbours' labels and its
    label's own label; the last halves long chains. Messages combine map-side, so a hub does
    not pile up.
    """
    both = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(
        e.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    all_nodes = both.select(F.col("a").alias("node"))
    if nodes is not None:
        all_nodes = all_nodes.unionByName(nodes.select("node"))
    rounds = Rounds(e.sparkSession, "components")
    labels = rounds.add(all_nodes.distinct().withColumn("component", F.col("node")))
    many = rounds.added > FEW
    while True:
        if many:  # the labels' files are small, but each round would send all of them through the driver
            labels = labels.hint("merge")
        msg = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("component").alias("m"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("j"))
        new = labels.join(msg, "node", "left").join(jump, "component").select(
            "node", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component"), "j").alias("component"))
        new = rounds.add(new)
        labels = new.select("node", "component")
        if new.where("old <> component").isEmpty():
            return labels


def leaf_paths(e: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Every simple path from every node to a node without dependencies: head, path.

    From the leaves up: the end of such a path is one itself, so each round puts one more node before the paths of the
    round before, all that is written is result, and no path is begun that reaches no leaf.
    """
    spark = e.sparkSession
    links, paths = Rounds(spark, "path-edges"), Rounds(spark, "paths")
    e = links.add(e.select("src", F.col("dst").alias("head")))
    inner = e.select(F.col("src").alias("head")).distinct()
    nodes = e.select(F.col("src").alias("head")).unionByName(e.select("head")).distinct()
    new = paths.add(nodes.join(inner if links.added <= FEW else inner.hint("merge"), "head", "left_anti").select("head", F.array("head").alias("path")))
    for _ in range(max_rounds):
        if not paths.added:
            return paths.all()
        few = min(paths.added, links.added) <= FEW
        nxt = (new if few else new.hint("merge")).join(e, "head").where(~F.array_contains("path", F.col("src")))
        new = paths.add(nxt.select(F.col("src").alias("head"), F.concat(F.array("src"), "path").alias("path")))
    raise RuntimeError("paths longer than max_rounds")


def blast_radius(c: DataFrame) -> DataFrame:
    """Upstream services that a failing node (dst of a closure) can pull down."""
    return c.select(F.col("dst").alias("service"), F.col("src").alias("affected"), "hops")


def depth_share(affected: DataFrame, c: DataFrame, by: list[str]) -> DataFrame:
    """How far upstream each affected service is: the share of the other affected services
    below it; 0.5 where it is the only one.

    `affected` holds distinct (*by, service). Driven by closure pairs, not by pairs of the group.
    """
    pairs = affected.join(c.select(F.col("src").alias("service"), "dst"), "service").where("service <> dst").join(
        affected.withColumnRenamed("service", "dst"), [*by, "dst"], "left_semi")
    below = pairs.groupBy(*by, "service").agg(F.count("*").alias("below"))
    size = affected.groupBy(*by).agg(F.count("*").alias("services"))
    out = affected.join(size, by).join(below, [*by, "service"], "left")
    share = F.when(F.col("services") < 2, F.lit(0.5)).otherwise(
        F.coalesce("below", F.lit(0)) / F.greatest(F.lit(1), F.col("services") - 1))
    return out.select(*by, "service", share.alias("depth"))


def group_members(services: DataFrame) -> DataFrame:
    """Member services per group; services without one belong to `default`."""
    return services.withColumn("grp", F.coalesce("grp", F.lit("default"))).groupBy("grp").agg(
        F.count("*").alias("services"), F.array_sort(F.collect_set("service")).alias("members"))


def instances(services: DataFrame, include_external: bool = True) -> DataFrame:
    df = services if include_external else services.where(~F.coalesce("external", F.lit(False)))
    return df.select("service", F.explode("instances").alias("instance"))
