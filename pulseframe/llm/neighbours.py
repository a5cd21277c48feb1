"""Approximate nearest neighbours by inner product, over shifted space-filling curves.

Each of CURVES orderings projects the vectors on a few random directions, shifts and
quantises them, and sorts them by their Hilbert key. Spark range-partitions the keys; the
ordering is cut into blocks, and a query meets the vectors of its own block and of the
nearer neighbouring one. The candidates of all orderings merge and are ranked by their
exact inner product. Longer vectors are lifted onto a sphere by one more coordinate
(queries by zero), so that near on the curve means a large inner product.

A block holds 12 times the square root of the number of vectors, one rule at every size: a
query meets 24 sqrt(n) of them on each curve, so the work grows with n^1.5 and not with n^2.
The answers come from the curves. Two cases are left to a comparison with all vectors, in
blocks: a query beside vectors of one key of which it met only a part (equal vectors share
a key in every ordering, and only that comparison finds the smallest ids of them), and, if
`confirmed` is given, a query of whose k neighbours less than that share was met by two
orderings or more.

Vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, nor does a null id. Rows of equal id count as one candidate of
the larger score. Ties go to the smaller id. An empty table, or one without usable
vectors, gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulseframe.llm.common import sorted_groups, write_stage

CURVES, DIMS, BITS = 12, 7, 9
PAIRS = "curve int, query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v of the vectors that take part; single precision stays as it is, all else is double."""
    v = F.col(vec_col)
    if vectors.select(v).schema[0].dataType.simpleString() != "array<float>":
        v = F.transform(v, lambda x: x.cast("double"))
    df = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return df.where(fine & F.exists("v", lambda x: x != 0))


def hilbert_keys(x: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer points, a row each (Skilling's transposed form)."""
    x = x.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[:, i] & q) != 0
            t = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(high, p, t)
            x[:, i] ^= t
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def matrix(column, dim: int) -> np.ndarray:
    """Rows of an Arrow list column as a matrix."""
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return chunk.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64, copy=False)


def best(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """For each query the k best vectors but those of its own id: (query row, vector row, score).

    The matrix product only selects, with a margin; scores are sums in one fixed order, so
    that equal vectors have equal scores wherever they stand.
    """
    rough = queries @ vectors.T
    rows, cols, scores = [], [], []
    for i in range(len(queries)):
        s = np.where(ids == own[i], -np.inf, rough[i])
        at = np.arange(len(s)) if len(s) <= k else np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k] - 1e-9 * (1 + np.abs(s[np.isfinite(s)]).max(initial=0)))
        at = at[np.isfinite(s[at])]
        exact = (vectors[at] * queries[i]).sum(axis=1)
        top = np.lexsort((ids[at], -exact))[:k]
        rows.append(np.full(len(top), i))
        cols.append(at[top])
        scores.append(exact[top])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


def search(vectors: DataFrame, every: int = 20, k: int = 20, block: int | None = None, confirmed: float | None = None, seed: int = 7,
           id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the `k` nearest found of each row whose id `every` divides."""
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base = usable(vectors, id_col, vec_col)
    most = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if most is None:
        return none
    dim = most["d"]
    base = write_stage(base.where(F.size("v") == dim), "vectors")
    kind = base.schema["v"].dataType.simpleString()
    longest, total = base.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), F.count("*")).first()
    top, block = float(longest), block or math.ceil(12 * math.sqrt(total))

    def order(batches):
        rng = np.random.default_rng(seed)
        turn = rng.normal(size=(CURVES, dim + 1, DIMS)) / np.sqrt(top)
        shift = rng.uniform(0, 1, size=(CURVES, DIMS))
        for b in batches:
            v, ids = matrix(b.column(1), dim), b.column(0).to_numpy()
            lift = np.sqrt(np.maximum(0, top - (v * v).sum(axis=1)))
            for query in (False, True):
                on = np.flatnonzero(ids % every == 0) if query else np.arange(len(ids))
                if not len(on):
                    continue
                full = np.concatenate([v[on], (np.zeros(len(on)) if query else lift[on])[:, None]], axis=1)
                for c in range(CURVES):
                    # A projection of a unit vector is about normal: its distribution function spreads it evenly.
                    even = 1 / (1 + np.exp(-1.702 * (full @ turn[c])))
                    cell = ((even / 2 + shift[c] / 2) * (1 << BITS)).astype(np.int64).clip(0, (1 << BITS) - 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(on), c), pa.int32()), pa.array(hilbert_keys(cell, BITS)), pa.array(np.full(len(on), query)),
                         pa.array(ids[on]), b.column(1).take(pa.array(on))], ["curve", "key", "query", "vec_id", "v"])

    keyed = base.mapInArrow(order, f"curve int, key long, query boolean, vec_id long, v {kind}")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["curve", "key", F.xxhash64("curve", "vec_id"), "query"]

    def place(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            q = b.column(2).to_numpy(zero_copy_only=False)
            pos = at + np.cumsum(~q) - 1  # queries stand at the last vector before them
            at += int((~q).sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(q), part), pa.int32()), pa.array(pos)],
                                             ["curve", "key", "query", "vec_id", "v", "part", "pos"])
    placed = keyed.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(
        place, f"curve int, key long, query boolean, vec_id long, v {kind}, part int, pos long")
    placed = write_stage(placed, "curves")
    # A row for each partition of the ordering: running sums over them are small.
    sizes = placed.where("NOT query").groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    ranked = placed.join(before, "part", "left").withColumn("at", F.coalesce("before", F.lit(0)) + F.col("pos"))
    b = F.floor(F.col("at") / block)
    side = F.when(F.col("at") % block < block // 2, b - 1).otherwise(b + 1)
    # A key's vectors that reach over an edge between blocks; runs of half a block are met by the queries in them.
    runs = ranked.where("NOT query").groupBy("curve", "key").agg(
        F.count("*").alias("n"), F.floor(F.min("at") / block).alias("a"), F.floor(F.max("at") / block).alias("z")).where((F.col("n") > block // 2) & F.expr("a < z"))
    edges = write_stage(runs.select(F.explode(F.sequence(F.col("a") + 1, F.col("z"))).alias("edge")).distinct(), "edges")
    asked = ranked.where("query").select(F.col("vec_id").alias("query_id"), F.explode(F.array(F.least(b, side), F.least(b, side) + 2)).alias("edge"))
    past = write_stage(asked.join(edges, "edge", "left_semi").select("query_id").distinct(), "past-blocks")
    ranked = ranked.withColumn("block", F.explode(F.when(F.col("query"), F.array(b, side)).otherwise(F.array(b))))

    def meet(t: pa.Table) -> pa.Table:
        out = []
        blocks, q, ids, curve = (t[c].to_numpy() for c in ("block", "query", "vec_id", "curve"))
        v = matrix(t["v"], dim)
        edges = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1], [True])))
        for s, e in zip(edges[:-1], edges[1:]):
            qs, vs = s + np.flatnonzero(q[s:e]), s + np.flatnonzero(~q[s:e])
            for at in range(0, len(qs), 512):
                own = qs[at:at + 512]
                if len(vs):
                    i, j, score = best(v[own], ids[own], v[vs], ids[vs], k)
                    out.append((curve[own][i], ids[own][i], ids[vs][j], score))
        cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0)] * 4
        return pa.table([pa.array(c, p) for c, p in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.float64()))],
                        names=["curve", "query_id", "vec_id", "score"])
    met = write_stage(sorted_groups(ranked.select("block", "curve", "query", "vec_id", "v"), ["block"], meet, PAIRS, rows=4 * block), "met")
    found = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.countDistinct("curve").alias("curves"))
    first = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = write_stage(found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k), "found")
    found, open_ = found.select("query_id", "rank", "vec_id", "score", "curves"), past
    if confirmed is not None:
        twice = found.groupBy("query_id").agg(F.sum((F.col("curves") > 1).cast("int")).alias("twice"))
        open_ = write_stage(open_.unionByName(twice.where(F.col("twice") < confirmed * k).select("query_id")).distinct(), "open")
    found = found.drop("curves")
    if open_.isEmpty():
        return found
    asked = base.join(open_.withColumnRenamed("query_id", "vec_id"), "vec_id", "left_semi")
    rest = scanned(base, asked, dim, k).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return found.join(open_, "query_id", "left_anti").unionByName(rest.select("query_id", "rank", "vec_id", "score"))


def packed(vectors: DataFrame, dim: int, rows: int) -> DataFrame:
    """ids, vs: blocks of up to `rows` vectors as binary."""
    def run(batches):
        for b in batches:
            ids, v = b.column(0).to_numpy(), matrix(b.column(1), dim)
            for at in range(0, len(ids), rows):
                yield pa.RecordBatch.from_arrays([pa.array([ids[at:at + rows].tobytes()]), pa.array([v[at:at + rows].tobytes()])], ["ids", "vs"])
    return vectors.select("vec_id", "v").mapInArrow(run, "ids binary, vs binary")


def scanned(vectors: DataFrame, queries: DataFrame, dim: int, k: int, rows: int = 4096) -> DataFrame:
    """query_id, vec_id, score of the `k` best of every block of `vectors` for each of `queries`."""
    blocks = write_stage(packed(vectors, dim, rows).select(F.monotonically_increasing_id().alias("b"), "ids", "vs"), "blocks")
    asked = packed(queries, dim, rows // 4).select(F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs"))
    # Every block of queries goes to every block of vectors: the numbers of blocks, not of rows, multiply.
    pairs = asked.join(blocks.select("b").withColumn("all", F.lit(1)), F.lit(True)).join(blocks, "b")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                own, ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                i, j, score = best(np.frombuffer(r["q_vs"]).reshape(-1, dim), own, np.frombuffer(r["vs"]).reshape(-1, dim), ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(ids[j]), pa.array(score)], ["query_id", "vec_id", "score"])
    return pairs.select("q_ids", "q_vs", "ids", "vs").mapInArrow(run, "query_id long, vec_id long, score double").groupBy(
        "query_id", "vec_id").agg(F.max("score").alias("score"))
