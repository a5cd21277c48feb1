"""Neighbours by recall, the quality classifier by held-out labels, and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.llm import neighbours, quality
from tests.llm.conftest import text


def plain_neighbours(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    return {i: sorted(((-float((v * w).sum()), j) for j, w in ok if j != i))[:k] for i, v in ok if i % every == 0}


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(8, 16))
    v = np.concatenate([c + 0.1 * rng.normal(size=(150, 16)) for c in centre] + [rng.normal(size=(300, 16))])
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(2000, [0.0] * 16), (2001, None), (2002, [1.0, None] + [0.0] * 14), (2003, [float("nan")] * 16), (None, [1.0] * 16), (2004, [1.0])]
    rows += [(3000 + i, v[0].tolist()) for i in range(60)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(neighbours.search(df, k=10, block=128).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    want = plain_neighbours([r for r in rows if r[0] != 2004], 10, 20)
    assert set(got) == set(want) and all(len(x) == 10 and x == sorted(x) for x in got.values())
    hits = sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    assert neighbours.search(df.limit(0)).count() == 0
    few = neighbours.search(df.where("vec_id < 5")).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]


def test_neighbours_in_a_large_group_of_equal_vectors(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(1500, 16))
    v[rng.permutation(1500)[:700]] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got = {}
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=10, block=64).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    want = plain_neighbours(rows, 10, 20)
    grouped = [q for q in want if (v[q] == v[0]).all()]
    assert len(grouped) > 20 and all([j for _, j in sorted(got[q])] == [j for _, j in want[q]] for q in grouped)


@pytest.mark.parametrize("element", ["float", "double"])
def test_recall_of_the_curves_alone(spark, element):
    """Vectors without any clusters, blocks far smaller than the table, nothing compared with all."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(4000, 24)).astype(np.float32)
    rows = [(i, x.tolist(), 1, i) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{element}>, curve int, query_id long")
    found = neighbours.search(df, k=10)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    want = plain_neighbours([r[:2] for r in rows], 10, 20)
    assert sum(len(set(got[q]) & {j for _, j in want[q]}) for q in want) >= 0.9 * 10 * len(want)
    assert all(abs(s - float(v[q].astype(float) @ v[j].astype(float))) < 1e-9 for q in want for j, s in got[q].items())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_hilbert_keys_are_a_path():
    side = 1 << 3
    points = np.array([(a, b) for a in range(side) for b in range(side)])
    order = points[np.argsort(neighbours.hilbert_keys(points, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def labelled_rows(n=600):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        junk, toxic = rng.random() < 0.2, rng.random() < 0.15
        t = text(rng, rng.randint(20, 200))
        if junk:
            t = " ".join(w + rng.choice(["###", "!!", "%%%"]) for w in t.split())
        if toxic:
            w = t.split()
            w[len(w) // 2] = rng.choice(["vilewordone", "vilewordtwo"])
            t = " ".join(w)
        docs.append((i, t, "en", f"s{rng.randint(0, 5)}", len(t)))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled_rows()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int")
    keep = {r.doc_id: r.keep for r in quality.judged(d, known).collect()}
    assert len(keep) == len(docs)
    right = sum(keep[i] == (q == 1 and t == 0) for i, q, t in labels[400:])
    assert right >= 0.97 * 200
    assert all(keep[i] for i, q, t in labels[400:] if q == 1 and t == 0)


def test_sparse_sites_shrink_to_what_is_above(spark):
    rng = random.Random(1)
    rows = [("a", 0.9 + 0.05 * rng.random(), 0.5) for _ in range(200)] + [("b", 0.1 + 0.05 * rng.random(), 0.5) for _ in range(200)] + [("c", 0.95, 0.5)]
    df = spark.createDataFrame([(h, h + str(i % 3), p) for i, (h, p, _) in enumerate(rows)], "host string, path string, p double")
    fine = quality.moments(df, ["host", "path"], "p")
    groups = quality.together(fine, ["host"]).withColumn("up", F.lit(0.5))
    same = {r.host: (r.n, round(r.m, 9), round(r.v, 9)) for r in quality.moments(df, ["host"], "p").collect()}
    assert {r.host: (r.n, round(r.m, 9), round(r.v, 9)) for r in groups.collect()} == same
    got = {r.host: r.m2 for r in quality.shrunk(groups, "m2").collect()}
    assert abs(got["a"] - 0.925) < 0.01 and abs(got["b"] - 0.125) < 0.01 and 0.5 < got["c"] <= 0.95


def test_quality_of_odd_rows(spark, docs, rows, empty):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    assert quality.judged(docs, labels).count() == len(rows)
    none = labels.limit(0)
    assert quality.judged(docs, none).where("NOT keep").count() == 0
    assert quality.judged(empty, none).count() == 0


def test_pipeline_stages(spark, docs, rows, empty, tmp_path):
    import corpus_pipeline as C
    labelled, labels = labelled_rows(200)
    d = docs.unionByName(spark.createDataFrame([(i + 1000, *r) for i, *r in labelled], "doc_id long, text string, lang string, source string, n_chars long"),
                         allowMissingColumns=True)
    sf = str(tmp_path)
    spark.createDataFrame([(i + 1000, q, t) for i, q, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    item = next(t for i, t, *_ in labelled if dict((a, (q, x)) for a, q, x in labels)[i] == (1, 0))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    left = d
    for i, (name, stage) in enumerate(C.STAGES):
        stage(spark, left, sf).write.parquet(f"{sf}/{i}")
        got = spark.read.parquet(f"{sf}/{i}")
        if i < len(C.STAGES) - 1:
            assert got.columns == left.columns, name
        assert got.count() <= left.count()
        left = got
    texts = [r.text for r in left.collect()]
    assert item not in texts and texts and left.where("NOT lossless").count() == 0
    for name, stage in C.STAGES:
        assert stage(spark, empty, sf).count() == 0, name
