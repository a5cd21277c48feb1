"""Structured Streaming twins of the batch operators. Each takes a streaming (or batch) DataFrame of points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulseframe.functions import bucket
from pulseframe.schemas import KEY
from pulseframe.session import stage_root, write_stage


def is_end() -> Column:
    """The mark of the input's end, see land_end()."""
    return F.col("service").isNull()


def merge_buckets(points: DataFrame, g: int, late: str) -> DataFrame:
    """One mean per series and bucket; buckets close once the watermark has passed them."""
    return points.withWatermark("ts", late).groupBy(F.window("ts", f"{g} seconds").alias("w"), *KEY).agg(
        F.avg("value").alias("value")).select(*KEY, F.col("w.start").alias("ts"), "value")


def sliding_inspection(points: DataFrame, length: str, slide: str, late: str) -> DataFrame:
    """Window statistics of every series over overlapping inspection windows."""
    return points.withWatermark("ts", late).groupBy(F.window("ts", length, slide).alias("w"), *KEY).agg(
        F.count("*").alias("n"), F.min("value").alias("vmin"), F.max("value").alias("vmax"),
        F.avg("value").alias("mean")).select(*KEY, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                                             "n", "vmin", "vmax", "mean")


def drop_duplicates(points: DataFrame, g: int, late: str) -> DataFrame:
    """Repeated samples of one series and bucket are dropped while the watermark remembers them."""
    p = points.where(~is_end()).withColumn("bucket_ts", bucket(F.col("ts"), g)).withWatermark("ts", late)
    return p.dropDuplicatesWithinWatermark([*KEY, "bucket_ts"])


def breach_sessions(points: DataFrame, breach: Column, gap: str, late: str) -> DataFrame:
    """Stretches of breaching samples no further apart than `gap`. The mark of the input's end passes, to move the watermark."""
    return points.where(breach | is_end()).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), *KEY).agg(
        F.count("*").alias("samples"), F.min("value").alias("vmin"), F.max("value").alias("vmax")).select(
        *KEY, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "samples", "vmin", "vmax")


def with_baseline(points: DataFrame, baselines: DataFrame) -> DataFrame:
    """Stream-static join: robust z of each sample against a stored baseline (*KEY, median, scale)."""
    b = baselines.select(*KEY, "median", "scale")
    return points.join(b, KEY, "left").withColumn(
        "z", F.coalesce(F.try_divide(F.col("value") - F.col("median"), F.col("scale")), F.lit(0.0)))


# ------------------------------------------------------------------ stateful run length
RUN_SCHEMA = "service string, instance string, metric string, samples long, longest long, run_start timestamp"
RUN_STATE = "samples long, cur long, cur_start long, best long, best_start long, open_ts array<long>, open_hit array<boolean>"


def longest_breach(closed: tuple, ts: np.ndarray, hit: np.ndarray) -> tuple:
    """(samples, cur, cur_start, best, best_start) of a series after the samples at `ts`, in the order of time."""
    seen, cur, cur_start, best, best_start = closed
    if not len(ts):
        return closed
    # a run begins at a breach after a calm sample; the one in progress goes on if the first sample breaches
    begins = hit & ~np.concatenate(([cur > 0], hit[:-1]))
    starts = np.concatenate(([cur_start], ts[begins]))
    sizes = np.bincount(np.cumsum(begins)[hit], minlength=len(starts))
    sizes[0] += cur
    top = int(np.argmax(sizes))
    if sizes[top] > best:
        best, best_start = int(sizes[top]), int(starts[top])
    last = (int(sizes[-1]), int(starts[-1])) if hit[-1] else (0, 0)
    return seen + len(ts), *last, best, best_start


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, idle_ms: int) -> Iterator[pd.DataFrame]:
    """Samples up to the watermark are final and join the run; later ones wait in the state, as others may still come before them."""
    if state.hasTimedOut:
        state.remove()
        return
    *closed, open_ts, open_hit = state.get if state.exists else (0, 0, 0, 0, 0, [], [])
    rows = pd.concat(list(batches))
    ts = np.concatenate((np.array(open_ts, np.int64), rows["ts"].astype("datetime64[us]").astype(np.int64).to_numpy() // 1_000_000))
    hit = np.concatenate((np.array(open_hit, bool), rows["breach"].fillna(False).to_numpy(bool)))
    order = np.argsort(ts, kind="stable")
    ts, hit = ts[order], hit[order]
    final = int(np.searchsorted(ts * 1000, state.getCurrentWatermarkMs()))
    closed = longest_breach(tuple(closed), ts[:final], hit[:final])
    state.update((*closed, ts[final:].tolist(), hit[final:].tolist()))
    state.setTimeoutTimestamp(max(int(ts[-1]) * 1000, state.getCurrentWatermarkMs()) + idle_ms)
    seen, _, _, best, best_start = longest_breach(closed, ts[final:], hit[final:])
    start = pd.Timestamp(best_start, unit="s") if best else pd.NaT
    yield pd.DataFrame({"service": [key[0]], "instance": [key[1]], "metric": [key[2]], "samples": [seen], "longest": [best],
                        "run_start": pd.Series([start], dtype="datetime64[ns]")})


def breach_runs(points: DataFrame, breach: Column, late: str = "1 hour", idle_hours: float = 24 * 14) -> DataFrame:
    """Longest run of breaching samples per series, updated with every micro-batch.

    Samples take their place by their own time, in whatever batch they come, unless they are later than `late`.
    The state of a series holds its counters and the samples younger than that; it goes once the series has been
    silent for `idle_hours`, after which the series starts anew. A breach that is null counts as calm.
    """
    p = points.where(~is_end()).select(*KEY, "ts", breach.alias("breach")).withWatermark("ts", late)
    idle_ms = int(idle_hours * 3_600_000)

    def advance(key, batches, state):
        yield from _advance(key, batches, state, idle_ms)
    return p.groupBy(*KEY).applyInPandasWithState(advance, RUN_SCHEMA, RUN_STATE, "update", GroupStateTimeout.EventTimeTimeout)


# ------------------------------------------------------------------ running
def run_available(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process everything that has arrived, into Parquet under `path`, and read it back."""
    q = (df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{path}/_progress")
         .trigger(availableNow=True).start(f"{path}/data"))
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/data")


def land_end(points: DataFrame, path: str, beyond: str) -> None:
    """Land the mark of the input's end beside landed points: one row without a service, `beyond` after the last sample.

    It moves the watermark past every window of the samples, so the stream itself closes and emits them; its own
    window stays open. `beyond` must exceed the longest window or session gap and the lateness together.
    """
    end = points.agg((F.max("ts") + F.expr(f"INTERVAL {beyond}")).alias("ts")).where("ts IS NOT NULL")
    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in points.schema}
    end.select(*[F.col("ts") if c == "ts" else v for c, v in empty.items()]).coalesce(1).write.mode("append").parquet(path)


def upsert_available(df: DataFrame, path: str, by: str, keys: list[str]) -> DataFrame:
    """Process everything that has arrived with foreachBatch: rows of a batch replace the
    stored rows of equal `keys`, the others stay. Only the partitions `by` that a batch
    touches are read and written, and a repeated batch leaves the same table."""
    from pulseframe.sources.points import replace_partitions

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = write_stage(batch, "batch")
        try:
            stored = spark.read.schema(df.schema).parquet(f"{path}/data")
        except AnalysisException:  # the first batch
            stored = batch.limit(0)
        touched = stored.join(batch.select(by).distinct(), by, "left_semi").select(*batch.columns)
        merged = write_stage(touched.join(batch.select(*keys).distinct(), keys, "left_anti").unionByName(batch), "merged")
        replace_partitions(merged, f"{path}/data", (by,))

    q = (df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/_progress")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/data")


def fresh_path(spark, name: str) -> str:
    import uuid
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
