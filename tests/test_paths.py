"""Layered path operators against listed paths."""

import random
import re
import time
from math import prod

import pytest
from pyspark.sql import functions as F

from pulseframe.operators import graph as G
from pulseframe.operators import paths as P

DAG = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("b", "e"), ("x", "d")]
CYCLES = [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("b", "g"), ("g", "g"), ("h", "i"), ("i", "h"), ("c", "a")]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def listed(pairs, nodes=()):
    """Every simple path from every node."""
    out = {}
    for s, d in pairs:
        out.setdefault(s, set()).add(d)
    names = {n for p in pairs for n in p} | set(nodes)

    def walk(path):
        yield path
        for n in sorted(out.get(path[-1], ())):
            if n not in path:
                yield from walk(path + [n])
    return names, {n: list(walk([n])) for n in names}, {n for n in names if n not in out}


@pytest.mark.parametrize("pairs", [DAG, CYCLES])
def test_longest_paths(spark, pairs):
    names, walks, _ = listed(pairs, ["alone"])
    got = {r.head: r.path for r in P.longest_paths(edges(spark, pairs), spark.createDataFrame([("alone",)], "node string")).collect()}
    assert got == {n: min(walks[n], key=lambda p: (-len(p), p)) for n in names}


@pytest.mark.parametrize("pairs, least", [(DAG, 2), (CYCLES, 1), (CYCLES, 4)])
def test_worst_paths(spark, pairs, least):
    rng = random.Random(len(pairs) + least)
    names, walks, leaves = listed(pairs, ["alone"])
    # eighths multiply exactly; zero, one and missing shares make ties and gaps
    share = {(n, t): rng.choice([0.0, 0.125, 0.5, 0.5, 0.75, 1.0, 1.0]) for n in names for t in range(6) if rng.random() < 0.9}
    rows = [("r", n, t, v) for (n, t), v in share.items()]
    e = edges(spark, pairs)
    c = P.condense(e, spark.createDataFrame([("alone",)], "node string"))
    got = {r.head: r.path for r in P.worst_paths(
        c, e, spark.createDataFrame(rows, "run_id string, service string, ts int, share double"), ["run_id"], least).collect()}
    want = {}
    for n in names:
        found = []
        for p in walks[n]:
            if p[-1] in leaves and len(p) >= least:
                for t in range(6):
                    if all((x, t) in share for x in p):
                        v = 1.0
                        for x in p:
                            v *= share[x, t]
                        found.append((v, " -> ".join(p), p))
        if found:
            want[n] = min(found)[2]
    assert got == want


def test_a_ladder_of_forty_layers(spark):
    """2^40 paths: listing them would not end."""
    pairs = [(f"{s}{i:02d}", f"{t}{i + 1:02d}") for i in range(40) for s in "ab" for t in "ab"]
    e = edges(spark, pairs)
    c = P.condense(e)
    assert c.depth == 41 and not c.cyclic
    top = c.nodes.where("node = 'b00'").first().path
    assert top == ["b00"] + [f"a{i:02d}" for i in range(1, 41)]
    values = c.nodes.select(F.lit("r").alias("run_id"), F.col("node").alias("service"), F.lit(0).alias("ts"),
                            F.when(F.col("node").isin("b07", "b31"), 0.5).otherwise(1.0).alias("share"))
    worst = P.worst_paths(c, e, values, ["run_id"]).where("head = 'a00'").first().path
    assert worst == [f"{'b' if i in (7, 31) else 'a'}{i:02d}" for i in range(41)]


@pytest.mark.parametrize("pairs", [DAG, CYCLES])
def test_reach_from_some_nodes_equals_the_closure(spark, pairs):
    e = edges(spark, pairs)
    full = {(r.src, r.dst): (r.hops, r.path) for r in G.closure(e.where("src <> dst"), with_paths=True).collect() if r.src != r.dst}
    hit = ["b", "d", "nowhere"]
    sources = spark.createDataFrame([(n,) for n in hit], "node string")
    down = {(r.src, r.dst): (r.hops, r.path) for r in P.reach(e, sources).collect()}
    up = {(r.src, r.dst): (r.hops, r.path) for r in P.reach(e, sources, upstream=True).collect()}
    assert down == {k: v for k, v in full.items() if k[0] in hit} and up == {k: v for k, v in full.items() if k[1] in hit}


def test_empty_graphs(spark):
    none = edges(spark, [])
    assert P.longest_paths(none).count() == 0 and P.reach(none, spark.createDataFrame([], "node string")).count() == 0


def smallest_shortest(pairs):
    out = {}
    for s, d in pairs:
        out.setdefault(s, []).append(d)
    want = {}
    for s in out:
        front = [[s]]
        while front:
            longer = sorted(([*p, d] for p in front for d in out.get(p[-1], ()) if p[-1] is not None or len(p) == 1), key=str)
            front = []
            for p in longer:
                if (s, p[-1]) not in want:
                    want[s, p[-1]] = p
                    front.append(p)
    return want


def spied(monkeypatch, few):
    """The loops with `few` rows as their bound: (plans, rows) that they write, each by the name of the stage."""
    plans, rows, add = [], {}, G.Rounds.add

    def spy(self, df):
        name = self.path.rsplit("/", 1)[1][:-33]
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = add(self, df)
        rows[name] = rows.get(name, 0) + self.added
        return out
    monkeypatch.setattr(G, "FEW", few)
    monkeypatch.setattr(G.Rounds, "add", spy)
    return plans, rows


@pytest.mark.parametrize("few", [200_000, 0])
def test_closure_writes_each_pair_once(spark, monkeypatch, few):
    """Loops, cycles and null ends included; with many rows no side is broadcast."""
    plans, rows = spied(monkeypatch, few)
    pairs = [*[(f"n{i}", f"n{i + 1}") for i in range(6)], ("n2", "n1"), ("n1", "n1"), ("n0", "n10"), ("n10", "n2"), (None, "n0"), ("n3", None)]
    want = smallest_shortest(pairs)
    got = G.closure(edges(spark, pairs), with_paths=True).collect()
    assert {(r.src, r.dst): r.path for r in got} == want and len(got) == rows["closure"] == len(want)
    rows.clear()
    assert {(r.src, r.dst, r.hops) for r in G.closure(edges(spark, pairs)).collect()} == {(*k, len(p) - 1) for k, p in want.items()}
    assert rows["closure"] == len(want) and (few or not any("Broadcast" in p for p in plans))


@pytest.mark.parametrize("few", [200_000, 0])
@pytest.mark.parametrize("with_paths", [True, False])
def test_closure_cuts_a_large_round_by_source(spark, monkeypatch, few, with_paths):
    """Rounds whose join passes the bound write slices that share no source; nulls, loops and ties come out the same."""
    spied(monkeypatch, few)
    monkeypatch.setattr(G, "MANY", 40)
    slices, add = [], G.Rounds.add

    def spy(self, df):
        out = add(self, df)
        if self.path.rsplit("/", 1)[1][:-33] == "closure":
            slices.append([r.src for r in out.select("src").distinct().collect()])
        return out
    monkeypatch.setattr(G.Rounds, "add", spy)
    pairs = [*[(f"{s}{i}", f"{t}{i + 1}") for i in range(6) for s in "ab" for t in "ab"], ("a3", "a1"), ("a1", "a1"), (None, "b0"), ("b3", None)]
    want = smallest_shortest(pairs)
    got = G.closure(edges(spark, pairs), with_paths=with_paths).collect()
    assert {(r.src, r.dst): r.hops for r in got} == {k: len(p) - 1 for k, p in want.items()} and len(got) == len(want)
    if with_paths:
        assert {(r.src, r.dst): r.path for r in got} == want
    rounds = 1 + max(len(p) - 1 for p in want.values()).bit_length()
    assert len(slices) > rounds and sum(map(len, slices)) <= rounds * len({s for s, _ in pairs})


def test_closure_leaves_nothing_but_its_pairs_on_disk(spark, monkeypatch, tmp_path):
    """Helper stages go with their round and shuffle files with their job; they do not stay until the driver's JVM collects them."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: set(re.findall(r"shuffle_\d+_\d+", disk.getAllFiles().mkString(" ")))
    monkeypatch.setattr("pulseframe.session.stage_root", lambda spark: str(tmp_path))
    before, key = shuffles(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    pairs = G.closure(edges(spark, [(f"n{i}", f"n{i + 1}") for i in range(9)]), with_paths=True)
    stages, end = {p.name[:-33] for p in tmp_path.iterdir()}, time.time() + 20
    while shuffles() - before and time.time() < end:
        time.sleep(0.2)
    assert stages == {"closure"} and not shuffles() - before and spark.conf.get(key) == was
    assert pairs.count() == 45


@pytest.mark.parametrize("few", [200_000, 0])
def test_leaf_paths_writes_only_paths_to_leaves(spark, monkeypatch, few):
    plans, rows = spied(monkeypatch, few)
    pairs = [*CYCLES, *DAG, ("a", "b"), (None, "a"), ("a", None)]
    _, walks, leaves = listed([p for p in pairs if None not in p])
    each = {tuple(p) for ps in walks.values() for p in ps if p[-1] in leaves}
    # repeated edges repeat their paths; a null end is a node without dependencies
    want = sorted(p for p in each for _ in range(prod(pairs.count(x) for x in zip(p, p[1:]))))
    got = G.leaf_paths(edges(spark, pairs)).collect()
    assert sorted(tuple(r.path) for r in got if r.head) == want and [r.path for r in got if not r.head] == [[None]]
    assert all(r.head == r.path[0] for r in got)
    assert rows["paths"] == len(got) and (few or not any("Broadcast" in p for p in plans))


@pytest.mark.parametrize("few", [200_000, 0])
def test_components_without_broadcasts(spark, monkeypatch, few):
    plans, _ = spied(monkeypatch, few)
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(9)] + [("x", "y"), ("y", "x"), ("z", "z")]
    got = {r.node: r.component for r in G.components(edges(spark, pairs), spark.createDataFrame([("lone",)], "node string")).collect()}
    assert got == {**{f"n{i}": "n0" for i in range(10)}, "x": "x", "y": "x", "z": "z", "lone": "lone"}
    assert few or not any("Broadcast" in p for p in plans)
