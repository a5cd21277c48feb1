"""Attach inspection windows to points, many windows per job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400


def assign_windows(
    points: DataFrame,
    windows: DataFrame,
    start: Column | str = "window_start",
    end: Column | str = "window_end",
    bucket_seconds: int = DAY,
    salt: int = 8,
) -> DataFrame:
    """Points joined to every window [start, end) that holds them, with all window columns.

    A bare range condition would plan a nested loop, so both sides carry a time bucket as
    an equi key. `salt` spreads one busy bucket over several tasks by series hash when the
    join shuffles; the windows side, one short row per window, is what gets repeated.
    Whether it broadcasts is left to Catalyst, which knows the size of either side.
    """
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    w = (
        windows.withColumn("_start", start).withColumn("_end", end)
        .withColumn("_bucket", F.explode(F.sequence(
            F.floor(F.unix_seconds("_start") / bucket_seconds),
            F.floor((F.unix_seconds("_end") - 1) / bucket_seconds))))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    )
    p = points.withColumn("_bucket", F.floor(F.unix_seconds("ts") / bucket_seconds)).withColumn(
        "_salt", F.pmod(F.xxhash64("service", "instance", "metric", "ts"), F.lit(salt)).cast("int"))
    joined = p.join(w, ["_bucket", "_salt"]).where((F.col("ts") >= F.col("_start")) & (F.col("ts") < F.col("_end")))
    return joined.drop("_bucket", "_salt", "_start", "_end")


def sliding_windows(points: DataFrame, length: str, slide: str) -> DataFrame:
    """Regular inspection windows without any join: each point lands in length/slide of them."""
    w = F.window("ts", length, slide)
    return points.withColumn("_w", w).select(
        F.concat(F.lit("run-"), F.unix_seconds("_w.end").cast("string")).alias("run_id"),
        F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *points.columns)


def bucket_spine(windows: DataFrame, g: int) -> DataFrame:
    """Every bucket start of every window."""
    s, e = F.unix_seconds("window_start"), F.unix_seconds("window_end")
    first = s - F.pmod(s, F.lit(g))
    spine = windows.where(e > first).select("run_id", F.explode(F.sequence(first, e - 1, F.lit(g).cast("long"))).alias("_s"))
    return spine.select("run_id", F.timestamp_seconds("_s").alias("ts"))
