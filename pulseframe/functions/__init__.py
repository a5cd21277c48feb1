from pulseframe.functions.numeric import clamp01, safe_ratio
from pulseframe.functions.text import duration_text, fmt, fmt_sql, metric_text_sql, render, run_id_text
from pulseframe.functions.timefn import bucket, hour_of_day, hour_of_week, seconds

__all__ = [
    "bucket", "clamp01", "duration_text", "fmt", "fmt_sql", "hour_of_day", "hour_of_week", "metric_text_sql",
    "render", "run_id_text", "safe_ratio", "seconds",
]
