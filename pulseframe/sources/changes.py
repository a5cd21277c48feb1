"""Change events: relative times made absolute, and which changes a run may see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.operators.skew import split_keys


def change_events(specs: DataFrame, windows: DataFrame) -> DataFrame:
    """Specs with `minutes_before_end` (negative = before) placed on each window's end.

    `specs` is configuration; the product with the windows is the result itself.
    """
    ts = F.timestamp_seconds(F.unix_seconds("window_end") + F.round(F.col("minutes_before_end") * 60).cast("long"))
    return specs.crossJoin(windows.select("run_id", "window_end")).withColumn("ts", ts).drop("minutes_before_end", "window_end")


def visible(changes: DataFrame, scenario: str | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Changes in [start, end); with a scenario, its own and the background ones, else all."""
    if scenario:
        changes = changes.where(F.col("scenario_id").isNull() | (F.col("scenario_id") == scenario))
    if start is not None:
        changes = changes.where(F.col("ts") >= start)
    if end is not None:
        changes = changes.where(F.col("ts") < end)
    return changes


def visible_per_run(changes: DataFrame, windows: DataFrame, hours: int = 24) -> DataFrame:
    """Changes of the last `hours` before each window's end that the run's scenario may see.

    Joined on an hours-long time bucket, split by its number of changes, so no nested loop is
    planned and no bucket lands in one task whole.
    """
    span = hours * 3600
    w = windows.select("run_id", F.col("scenario_id").alias("_scenario"), "window_end").withColumn(
        "_b", F.explode(F.sequence(F.floor((F.unix_seconds("window_end") - span) / span), F.floor(F.unix_seconds("window_end") / span))))
    c = changes.withColumn("_b", F.floor(F.unix_seconds("ts") / span))
    w, c = split_keys(w, c, ["_b"], [n for n in ("change_id", "service", "ts") if n in changes.columns])
    j = c.join(w, ["_b", "_part"]).where(
        (F.col("ts") >= F.timestamp_seconds(F.unix_seconds("window_end") - span)) & (F.col("ts") < F.col("window_end")))
    mine = F.col("_scenario").isNull() | F.col("scenario_id").isNull() | (F.col("scenario_id") == F.col("_scenario"))
    return j.where(mine).drop("_b", "_part", "_scenario", "window_end")
