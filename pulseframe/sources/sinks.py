"""Result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pulseframe.session import write_stage
from pulseframe.sources.points import replace_keys


def write_run_outputs(df: DataFrame, path: str, runs: DataFrame | None = None) -> None:
    """Replace the rows of `runs` (run_id), else of the runs present in `df`; other runs stay untouched.

    A rerun without rows leaves none if it is named in `runs`.
    """
    replace_keys(df, path, ("run_id",), df if runs is None else runs)


def write_alerts(alerts: DataFrame, path: str, runs: DataFrame | None = None) -> None:
    """Alert payloads as JSON lines, one folder per run. Of `runs` (run_id), those that have no alert any more lose their folder."""
    alerts = write_stage(alerts, "alerts")
    alerts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(path)
    if runs is None:
        return
    quiet = runs.select("run_id").distinct().join(alerts.select("run_id").distinct(), "run_id", "left_anti").collect()
    spark = alerts.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = folder(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for r in quiet:
        fs.delete(folder(f"{path}/run_id={r.run_id}"), True)
