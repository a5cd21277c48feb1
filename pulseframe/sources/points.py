"""The stored metric points: scans, summaries and replace-by-key writes.

Stored layout: Parquet, partitioned by dataset_id and date. Filters on either prune whole
folders, and the ts range reaches the row groups.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.policy import Policy
from pulseframe.schemas import KEY
from pulseframe.session import write_stage


def read_points(
    spark: SparkSession,
    path: str,
    datasets: list[str] | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    df = spark.read.parquet(path)
    if datasets:
        df = df.where(F.col("dataset_id").isin(datasets))
    if start is not None:
        df = df.where((F.col("date") >= F.lit(start.date())) & (F.col("ts") >= F.lit(start)))
    if end is not None:
        df = df.where((F.col("date") <= F.lit(end.date())) & (F.col("ts") < F.lit(end)))
    return df


def select_points(
    points: DataFrame,
    service: str | None = None,
    instances: list[str] | None = None,
    metrics: list[str] | None = None,
    start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """Filters only, all of which reach the scan."""
    if service:
        points = points.where(F.col("service") == service)
    if instances:
        points = points.where(F.col("instance").isin(instances))
    if metrics:
        points = points.where(F.col("metric").isin(metrics))
    if start is not None:
        points = points.where(F.col("ts") >= start)
    if end is not None:
        points = points.where(F.col("ts") < end)
    return points


def service_series(points: DataFrame, service: str, metric: str) -> DataFrame:
    """All instances of a service for one metric."""
    return select_points(points, service, metrics=[metric])


def collection_range(policy: Policy, windows: DataFrame, window_seconds: int) -> DataFrame:
    """Per window the range a scan must cover so that every rule has its lookback."""
    span = policy.max_lookback_seconds(window_seconds)
    return windows.select(
        "run_id", F.timestamp_seconds(F.unix_seconds("window_end") - span).alias("collect_start"),
        F.col("window_end").alias("collect_end"))


def scan_windows(points: DataFrame, windows: DataFrame, start: Column, end: Column) -> DataFrame:
    """The points that windows with the range [start, end) can need, and no other days.

    The outermost range is a literal filter, which reaches partitions and row groups; one row comes to the driver
    for it. Where points are stored by `date`, a semi join with the days of all ranges prunes the folders between
    distant windows as well, at run time.
    """
    w = windows.select(start.alias("_a"), end.alias("_z"))
    lo, hi = w.agg(F.min("_a").cast("long"), F.max("_z").cast("long")).first()
    if lo is None:
        return points.limit(0)
    points = points.where((F.col("ts") >= F.timestamp_seconds(F.lit(lo))) & (F.col("ts") < F.timestamp_seconds(F.lit(hi))))
    if "date" not in points.columns:
        return points
    days = w.select(F.explode(F.sequence(F.to_date("_a"), F.to_date("_z"))).alias("date")).distinct()
    return points.join(days.where(F.col("date") >= F.to_date(F.timestamp_seconds(F.lit(lo)))), "date", "left_semi")


def manifest(points: DataFrame) -> DataFrame:
    """Series, points and time range per dataset: series first, so one hot dataset combines map-side."""
    per = points.groupBy("dataset_id", *KEY).agg(F.count("*").alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    return per.groupBy("dataset_id").agg(
        F.count("*").alias("series"), F.sum("n").alias("points"), F.min("t0").alias("start_ts"), F.max("t1").alias("end_ts"))


def dataset_counts(points: DataFrame) -> DataFrame:
    per = points.groupBy("dataset_id", "service", "instance").agg(F.count("*").alias("n"))
    return per.groupBy("dataset_id").agg(F.sum("n").alias("points"), F.count("*").alias("instances"))


def day_sketches(points: DataFrame, what: Column, keys: tuple[str, ...] = ("date",), precision: int = 16) -> DataFrame:
    """A mergeable sketch of the distinct values of `what` per day (or other keys): stored once, merged for any set of days."""
    return points.groupBy(*keys).agg(F.hll_sketch_agg(what, precision).alias("sketch"), F.count("*").alias("points"))


def distinct_of(sketches: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """About how many distinct values the sketches hold together (standard error 0.4 %), without a look at the points."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about"), F.sum("points").alias("points"))


def fingerprint(points: DataFrame, keys: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    """Count, range and order-independent hashes of all values, per dataset: equal rows cancel in the xor but not in the sum."""
    row = F.xxhash64(*KEY, "ts", "value")
    return points.groupBy(*keys).agg(
        F.count("*").alias("points"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
        F.bit_xor(row).alias("value_hash"), F.sum(row.cast("decimal(38,0)")).alias("value_sum"))


def changed_datasets(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Datasets of `new` whose fingerprint differs from the stored one, or that are not stored."""
    cols = ["dataset_id", "points", "start_ts", "end_ts", "value_hash", "value_sum"]
    return fingerprint(new).select(*cols).exceptAll(fingerprint(stored).select(*cols)).select("dataset_id")


def store_totals(runs: DataFrame, anomalies: DataFrame, points: DataFrame) -> DataFrame:
    def one(name, df):
        return df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("item"), "rows")
    return one("runs", runs).unionByName(one("anomalies", anomalies)).unionByName(one("points", points))


def replace_partitions(df: DataFrame, path: str, by: tuple[str, ...]) -> None:
    """Replace exactly the partitions present in `df`.

    The option is set on this write, so it holds whatever the session default. Rows are
    rebalanced by partition: Spark splits a hot one by its size and joins small ones.
    """
    (df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*by).parquet(path))


def replace_keys(df: DataFrame, path: str, by: tuple[str, ...], keys: DataFrame) -> None:
    """Replace all that is stored under `keys` (values of by[0]) by `df`, which has no other keys.

    Partitions of these keys that `df` does not fill are removed after the write, so a
    dataset of fewer dates or a run without rows leaves nothing old behind. Only the names
    of such folders reach the driver. `df` is computed once, before the table changes under it.
    """
    spark, df = df.sparkSession, write_stage(df, "replacement")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stale = []
    if fs.exists(at):
        stored = spark.read.parquet(path).select(*by).distinct().join(keys.select(by[0]).distinct(), by[0], "left_semi")
        stale = stored.join(df.select(*by).distinct(), list(by), "left_anti").select(*[F.col(c).cast("string") for c in by]).collect()
    replace_partitions(df, path, by)
    for row in stale:
        folder = "/".join(f"{c}={v}" for c, v in zip(by, row))
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}"), True)


def write_points(points: DataFrame, path: str, datasets: DataFrame | None = None) -> None:
    """Replace whole datasets: those of `datasets`, else those present in `points`."""
    points = points.withColumn("date", F.to_date("ts"))
    replace_keys(points, path, ("dataset_id", "date"), points if datasets is None else datasets)


def write_points_if_changed(points: DataFrame, path: str, exists: bool) -> DataFrame:
    """Write only the datasets whose content changed; returns them."""
    spark = points.sparkSession
    if not exists:
        write_points(points, path)
        return points.select("dataset_id").distinct()
    # decided and written down before the table changes under it
    todo = write_stage(changed_datasets(points, spark.read.parquet(path).select(*points.columns)), "changed")
    if not todo.isEmpty():
        write_points(points.join(todo, "dataset_id", "left_semi"), path, todo)
    return todo
