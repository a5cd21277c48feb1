"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.session import write_stage

__all__ = ["table", "write_stage", "map_rows", "sorted_groups", "utf8_texts", "components"]


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces_of(batch: pa.RecordBatch, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `size` bytes, a row at least: what numpy holds at a time stays small."""
    rows = max(1, int(batch.num_rows * size / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def per_process(key: tuple, make: Callable[[], object]) -> object:
    """What `make` gives, once a worker process: its later tasks find it again.

    Functions travel by value, so their modules' globals begin anew in each task; an imported module's attribute stays.
    """
    held = pa.__dict__.setdefault("_held_by_process", {})
    if key not in held:
        held[key] = make()
    return held[key]


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.Table], schema: str) -> DataFrame:
    """Apply `fn` to the rows of `df`, a few megabytes at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch):
                yield from fn(piece).to_batches()
    return df.mapInArrow(run, schema)


def utf8_texts(column) -> Iterator[bytes]:
    """The UTF-8 bytes of each text of an Arrow column, b"" for null."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def sorted_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.Table], schema: str, rows: int = 200_000) -> DataFrame:
    """Deal `df` by `keys`, sort each partition by them and give `fn` tables of whole groups.

    A table ends at a group's end once it has `rows` rows, so memory is bounded by that many
    rows and the largest group; callers split larger groups by a further key column first.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):
            held.append(batch)
            n += batch.num_rows
            if n < rows:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            cut = last_group(t, keys)
            if cut:
                yield from fn(t.slice(0, cut)).to_batches()
                t = t.slice(cut)
            held = t.combine_chunks().to_batches()
            n = t.num_rows
        if held:
            yield from fn(pa.Table.from_batches(held).combine_chunks()).to_batches()
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def last_group(t: pa.Table, keys: list[str]) -> int:
    """Where the last group of a table sorted by `keys` begins."""
    differs = np.zeros(t.num_rows, bool)
    for k in keys:
        col = t[k].to_numpy()
        differs |= col != col[-1]
    return int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): node, root (the smallest node reachable).

    Alternating large-star and small-star steps. Minima combine map-side, each round is
    written to the shared folder, and the joins are between written tables so that a
    hub's rows can be split. Nodes without an edge have no row. An edge of a node with
    itself is ignored. Stops when a round changes nothing.
    """
    e = write_stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = write_stage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "large")
        large = write_stage(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        low = write_stage(large.groupBy("a").agg(F.min("b").alias("m")), "small")
        e = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))).distinct()
        e = write_stage(e, "small-star")
