"""Labelled evaluation of inspections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outcomes(labels: DataFrame, results: DataFrame) -> DataFrame:
    """Cause and level hits per labelled run.

    labels: run_id, expected_causes (array), expected_level, expect_clean.
    results: run_id, causes (array), top_level, p1, p2, degraded, error.
    A clean scenario is right when no P1 or P2 shows; a P4 with a conclusion is no false alarm.
    """
    j = labels.join(results, "run_id", "left")
    quiet = (F.coalesce("p1", F.lit(0)) == 0) & (F.coalesce("p2", F.lit(0)) == 0)
    level = F.when(F.col("expect_clean"), quiet).otherwise(F.coalesce(F.col("top_level") == F.col("expected_level"), F.lit(False)))
    cause = F.when(F.col("expect_clean"), level).otherwise(
        F.coalesce(F.arrays_overlap("expected_causes", "causes"), F.lit(False)))
    return j.select("run_id", "expect_clean", F.coalesce("degraded", F.lit(False)).alias("degraded"),
                    (F.col("error").isNotNull()).alias("failed"), cause.alias("cause_hit"), level.alias("level_hit"),
                    (F.col("expect_clean") & ~level).alias("false_positive"))


def summary(o: DataFrame) -> DataFrame:
    """Accuracies over runs without error, false-positive rate over the clean ones."""
    graded = ~F.col("failed")

    def rate(flag, cond):
        return F.coalesce(F.avg(F.when(cond, F.col(flag).cast("double"))), F.lit(0.0))

    return o.agg(
        F.count_if(graded).alias("graded"), rate("cause_hit", graded).alias("cause_accuracy"),
        rate("level_hit", graded).alias("level_accuracy"), rate("false_positive", graded & F.col("expect_clean")).alias("false_positive_rate"),
        rate("degraded", graded).alias("degraded_ratio"))
