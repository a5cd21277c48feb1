"""Series files: one JSON document per dataset, one value array per series, null = missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.functions import seconds
from pulseframe.schemas import KEY, SERIES_FILE
from pulseframe.session import write_stage


def read_series_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per series of every file. A file is read by one task; `read_series_records` divides large files."""
    docs = spark.read.schema(SERIES_FILE).option("multiLine", True).json(path)
    return docs.select("dataset_id", "scenario_id", F.inline("series"))


def read_series_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per series of every file, as `read_series_files` gives them; a large file is read by many tasks.

    Files are cut at closing braces, each of which ends a series or its document. A first pass
    puts the text around the series of each file together again, one row a file. A file in which
    a brace does anything else (inside a string, or of a nested object) does not give a document
    that way and is read whole, as is one without series.
    """
    series = SERIES_FILE["series"].dataType.elementType
    body = F.concat(F.lit("{"), F.substring_index("value", "{", -1), F.lit("}"))
    head = F.expr("left(value, length(value) - length(substring_index(value, '{', -1)) - 1)")
    cut = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    cut = cut.where(F.trim(F.translate("value", "\t\r\n", "   ")) != "").withColumn("opens", F.contains("value", F.lit("{")))
    checked = T.StructType([*series.fields, T.StructField("_broken", T.StringType())])
    parsed = F.from_json(body, checked, {"columnNameOfCorruptRecord": "_broken"})
    around = F.when(~F.col("opens"), F.col("value")).when(~head.rlike(r"^\s*,\s*$"), head)
    files = cut.select("file", "opens", around.alias("around"), F.when(F.col("opens"), parsed["_broken"].isNotNull()).alias("broken"))
    files = files.groupBy("file").agg(
        F.count_if(F.col("opens") & F.col("around").isNotNull()).alias("heads"), F.count_if(~F.col("opens")).alias("tails"),
        F.count_if("broken").alias("broken"), F.max(F.when(F.col("opens"), F.col("around"))).alias("head"),
        F.max(F.when(~F.col("opens"), F.col("around"))).alias("tail"))
    document = F.from_json(F.concat("head", "tail", F.lit("}")), "dataset_id string, scenario_id string, series array<string>, _broken string",
                           {"columnNameOfCorruptRecord": "_broken"})
    files = files.withColumn("doc", document)
    regular = F.expr("heads = 1 AND tails = 1 AND broken = 0") & F.expr("doc._broken IS NULL AND size(doc.series) = 0")
    files = write_stage(files.select("file", F.coalesce(regular, F.lit(False)).alias("regular"), "doc.dataset_id", "doc.scenario_id"), "series-files")
    one = F.from_json(body, series)
    out = cut.where("opens").join(files.where("regular"), "file").select("dataset_id", "scenario_id", one.alias("s")).select(
        "dataset_id", "scenario_id", "s.*")
    # Names of files only, which the driver's list of files holds anyway; as literals they leave the other files unread.
    odd = [x["file"] for x in files.where("NOT regular").select("file").collect()]
    if not odd:
        return out
    whole = spark.read.schema(SERIES_FILE).option("multiLine", True).json(path).where(F.col("_metadata.file_path").isin(odd))
    return out.unionByName(whole.select("dataset_id", "scenario_id", F.inline("series")))


def write_series_files(series: DataFrame, path: str) -> None:
    """Land series (dataset_id, scenario_id, then a series' columns) as one JSON document a dataset, a line a series."""
    own = F.to_json(F.struct(*[c for c in series.columns if c not in ("dataset_id", "scenario_id")]))
    w = W.partitionBy("dataset_id").orderBy(*KEY)
    head = F.regexp_replace(F.to_json(F.struct("dataset_id", "scenario_id", F.array().cast("array<string>").alias("series"))), r"\]\}$", "")
    first, last = F.row_number().over(w) == 1, F.lead(F.lit(1)).over(w).isNull()
    lines = series.select(F.col("dataset_id").alias("dataset"), F.concat(
        F.when(first, head).otherwise(","), own, F.when(last, "]}").otherwise("")).alias("value"))
    lines.write.partitionBy("dataset").text(path)


def explode_series(series: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Compact series -> points in [start, end); null buckets are skipped.

    Arrays are cut to the buckets that meet the range before they are exploded; of the
    first and last bucket the exact bounds decide.
    """
    last = None if end is None else F.timestamp_seconds(seconds(end) + F.col("step_seconds") - 1)
    series = slice_series(series, start, last)
    carry = [c for c in series.columns if c not in ("values", "start_epoch", "step_seconds")]
    p = series.select(*carry, "start_epoch", "step_seconds", F.posexplode("values").alias("_pos", "value"))
    return p.where("value IS NOT NULL").withColumn(
        "ts", F.timestamp_seconds(F.col("start_epoch") + F.col("_pos") * F.col("step_seconds"))
    ).where((F.lit(True) if start is None else F.col("ts") >= start) & (F.lit(True) if end is None else F.col("ts") < end)
            ).drop("start_epoch", "step_seconds", "_pos")


def slice_series(series: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Cut value arrays to [start, end) on their own bucket grid, moving start_epoch along."""
    step = F.col("step_seconds")
    if start is not None:
        off = F.greatest(F.lit(0), F.floor((seconds(start) - F.col("start_epoch")) / step)).cast("int")
        series = series.withColumn("_off", off).withColumn(
            "values", F.slice("values", F.col("_off") + 1, F.greatest(F.lit(0), F.size("values") - F.col("_off")))
        ).withColumn("start_epoch", F.col("start_epoch") + F.col("_off") * step).drop("_off")
    if end is not None:
        n = F.greatest(F.lit(0), F.floor((seconds(end) - F.col("start_epoch")) / step)).cast("int")
        series = series.withColumn("values", F.slice("values", F.lit(1), n))
    return series


def compact_series(points: DataFrame, g: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Points -> one array per series from its first to its last bucket, missing buckets as null.

    Each sample brings the nulls that follow it, so no bucket spine is joined. The array is
    the format itself: one element per bucket of the series' range.
    """
    keys = [*extra, *KEY]
    w = W.partitionBy(*keys).orderBy("ts")
    missing = F.coalesce(F.floor((seconds(F.lead("ts").over(w)) - seconds(F.col("ts"))) / g) - 1, F.lit(0)).cast("int")
    part = F.concat(F.array("value"), F.array_repeat(F.lit(None).cast("double"), missing))
    s = points.withColumn("_part", part).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("ts", "_part"))).alias("_parts"), F.min("ts").alias("_t0"))
    return s.select(*keys, seconds(F.col("_t0")).alias("start_epoch"), F.lit(g).cast("long").alias("step_seconds"),
                    F.flatten(F.transform("_parts", lambda p: p["_part"])).alias("values"))


def with_declared_unit(series: DataFrame, catalog: DataFrame) -> DataFrame:
    """Unit of each series: its own, else the catalogue's."""
    own = F.col("unit") if "unit" in series.columns else F.lit(None).cast("string")
    return series.withColumn("_own", own).drop("unit").join(
        catalog.select("metric", F.col("unit").alias("_cat")), "metric", "left"
    ).withColumn("unit", F.when(F.coalesce("_own", F.lit("")) == "", F.col("_cat")).otherwise(F.col("_own"))).drop("_own", "_cat")
