"""Key lists and explicit schemas shared by all operators."""

from pyspark.sql import types as T

KEY = ["service", "instance", "metric"]
RKEY = ["run_id", *KEY]

#: long-format metric point, the input of nearly everything
METRIC_POINTS = T.StructType([
    T.StructField("service", T.StringType()),
    T.StructField("instance", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("value", T.DoubleType()),
])

#: one landed series file: a dataset with one value array per series
SERIES_FILE = T.StructType([
    T.StructField("dataset_id", T.StringType()),
    T.StructField("scenario_id", T.StringType()),
    T.StructField("scenario_name", T.StringType()),
    T.StructField("step_seconds", T.LongType()),
    T.StructField("start_epoch", T.LongType()),
    T.StructField("end_epoch", T.LongType()),
    T.StructField("generated_at", T.StringType()),
    T.StructField("expected_root_cause", T.StringType()),
    T.StructField("series", T.ArrayType(T.StructType([
        T.StructField("service", T.StringType()),
        T.StructField("instance", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("start_epoch", T.LongType()),
        T.StructField("step_seconds", T.LongType()),
        T.StructField("values", T.ArrayType(T.DoubleType())),
    ]))),
])

#: columns every rule emits, in this order
FINDING_COLS = [
    "run_id", "rule_id", "dimension", "service", "instance", "metric", "level",
    "observed", "baseline_value", "deviation_pct", "z_score", "amplitude",
    "affected_ratio", "duration_min", "deviation_score", "first_seen", "last_seen",
    "baseline_mode", "baseline_confidence", "reason", "evidence",
]
