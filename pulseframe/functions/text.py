"""Number and template formatting as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fixed(c: str, digits: int) -> str:
    return f"format_string('%.{digits}f', round({c}, {digits}))"


def fmt_sql(c: str, digits: int = 2) -> str:
    """SQL of `fmt` for the double expression `c`."""
    return (f"CASE WHEN {c} IS NULL OR isnan({c}) OR abs({c}) = double('infinity') THEN '-' "
            f"WHEN {c} = floor({c}) AND abs({c}) < 1e9 THEN string(bigint({c})) ELSE {_fixed(c, digits)} END")


def fmt(c: str, digits: int = 2) -> Column:
    """Whole numbers without decimals, others with `digits`; missing or infinite as '-'."""
    return F.expr(fmt_sql(f"double({c})", digits))


def metric_text_sql(c: str, unit: str) -> str:
    """Value with the decimals and suffix of its unit."""
    return (f"CASE WHEN {c} IS NULL OR isnan({c}) THEN '-' WHEN {unit} = 'ms' THEN concat({_fixed(c, 0)}, 'ms') "
            f"WHEN {unit} = '%' THEN concat({_fixed(c, 2)}, '%') WHEN {unit} = 'req/s' THEN {_fixed(c, 1)} "
            f"WHEN {unit} = 'count' THEN {_fixed(c, 0)} ELSE {_fixed(c, 2)} END")


def render(template: str, values: dict[str, str]) -> Column:
    """Fill {name} placeholders of a template column with SQL texts; names without a value stay.

    Only formatted numbers and identifiers are filled in, none of which holds a brace, so
    one replacement can never create another placeholder.
    """
    out = template
    for name, value in values.items():
        out = f"replace({out}, '{{{name}}}', coalesce({value}, ''))"
    return F.expr(out)


def duration_text(minutes: str) -> Column:
    return F.expr(
        f"CASE WHEN {minutes} < 1 THEN concat(string(floor({minutes} * 60)), 's') "
        f"WHEN {minutes} < 60 THEN concat({_fixed(minutes, 0)}, 'min') "
        f"WHEN {minutes} < 1440 THEN concat({_fixed(f'{minutes} / 60', 1)}, 'h') "
        f"ELSE concat({_fixed(f'{minutes} / 1440', 1)}, 'd') END")


def run_id_text(ts: Column, scenario: Column, tz: str = "UTC") -> Column:
    """run-yyyyMMdd-HHmmss[-scenario] in local time of `tz`."""
    # shift to local wall-clock, then format it in the session zone, undoing that zone's own shift
    local = F.to_utc_timestamp(F.from_utc_timestamp(ts, tz), F.current_timezone())
    base = F.concat(F.lit("run-"), F.date_format(local, "yyyyMMdd-HHmmss"))
    return F.when(F.coalesce(scenario, F.lit("")) == "", base).otherwise(F.concat(base, F.lit("-"), scenario))
