"""Session settings the operators rely on, and the shared stage folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def stage_root(spark: SparkSession) -> str:
    """Folder for written stages: the cluster's spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder of its own; on a
    cluster a machine-local folder would be lost with its executor, so that is an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="pulseframe-stages-"))
    return sc.getCheckpointDir().rstrip("/")


def write_stage(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back; `compression` is the files' codec, the session's for None.

    Cuts the lineage with a file that survives executor loss, stays column-prunable, and
    gives Catalyst a true size to choose joins by.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Writes in this block delete their shuffle files as they end, not when the driver's JVM collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


class Rounds:
    """A stage that a loop adds to: one folder with a subfolder a round, read as a single table.

    A plan over all rounds so far stays as small as one over the first, however many there are. With `lean` the files
    are zstd and a round's shuffle files go when it is written.
    """

    def __init__(self, spark: SparkSession, name: str, lean: bool = False):
        self.spark, self.path, self.n, self.schema = spark, f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}", 0, None
        self.added, self.lean = 0, lean

    def add(self, df: DataFrame) -> DataFrame:
        """Write `df` as the next round and read it back; `added` is its number of rows, counted on the way."""
        self.schema = df.schema
        path = f"{self.path}/round={self.n}"
        seen = Observation()
        with shuffles_dropped(self.spark) if self.lean else nullcontext():
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path, compression="zstd" if self.lean else None)
        self.n, self.added = self.n + 1, seen.get["rows"]
        return self.spark.read.schema(df.schema).parquet(path)

    def deal(self, df: DataFrame, by: str, slices: int) -> DataFrame:
        """Write `df` as the next round, dealt by a hash of `by`; a filter on the added column `slice` reads that slice only."""
        path = f"{self.path}/round={self.n}"
        df = df.withColumn("slice", F.pmod(F.xxhash64(by), F.lit(slices)).cast("int"))
        with shuffles_dropped(self.spark) if self.lean else nullcontext():
            df.write.partitionBy("slice").parquet(path, compression="zstd" if self.lean else None)
        self.n += 1
        return self.spark.read.schema(df.schema).parquet(path)

    def all(self, since: int = 0) -> DataFrame:
        """The rows of all rounds from number `since` on; at least one must have been added."""
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/round={k}" for k in range(since, self.n)])

    def drop(self) -> None:
        """Delete the files of all rounds."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def literal_table(spark: SparkSession, columns: list[tuple[str, str]], rows: list[tuple]) -> DataFrame:
    """A small table of literal rows as a LocalRelation, whose exact size the optimizer knows."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (int, float)):
            return f"{v!r}D" if isinstance(v, float) else str(v)
        if isinstance(v, (list, tuple)):
            return "array(" + ", ".join(lit(x) for x in v) + ")"
        return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"

    names = ", ".join(f"c{i}" for i in range(len(columns)))
    casts = ", ".join(f"CAST(c{i} AS {typ}) AS {name}" for i, (name, typ) in enumerate(columns))
    body = rows or [tuple(None for _ in columns)]
    values = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in body)
    df = spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})")
    return df if rows else df.where("false")
