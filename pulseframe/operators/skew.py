"""Equi joins whose keys differ widely in rows: each key is split by its own size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a join task gets at most, about.
KEY_ROWS = 100_000


def split_keys(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], rows: int = KEY_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column _part, to be joined on (*keys, _part).

    A key of the right side is cut into as many parts as `rows` goes into its number of rows, by a hash of `by`;
    left rows of that key repeat once a part, of any other key they stay one. Keys of one side only are dropped.
    """
    parts = right.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(rows)).cast("int").alias("_parts"))
    cut = right.join(parts, keys).withColumn("_part", F.pmod(F.xxhash64(*by), F.col("_parts")).cast("int")).drop("_parts")
    repeated = left.join(parts, keys).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return repeated, cut
