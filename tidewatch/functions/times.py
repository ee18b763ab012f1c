"""Time buckets, windows and their printed forms."""

from pyspark.sql import Column, functions as F

MICRO = 1
MILLI = 1000
SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE


def bucket_minute(ts: Column) -> Column:
    return F.date_trunc("minute", ts)


def bucket_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def floor_div(value: Column, step: int) -> Column:
    """Whole-number division rounding down, also below zero."""
    return F.call_function("div", value - F.pmod(value, F.lit(step)), F.lit(step))


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def duration_text(micros: int) -> str:
    """A duration as `1h0m0s`, `1m0s`, `1.5s`, `500ms` or `20µs`."""
    def number(value: int, unit: int) -> str:
        whole, rest = divmod(value, unit)
        digits = len(str(unit)) - 1
        return str(whole) + (f".{rest:0{digits}d}".rstrip("0") if rest else "")

    if micros == 0:
        return "0s"
    sign, left = ("-", -micros) if micros < 0 else ("", micros)
    if left < MILLI:
        return f"{sign}{left}µs"
    if left < SECOND:
        return f"{sign}{number(left, MILLI)}ms"
    hours, left = divmod(left, HOUR)
    minutes, left = divmod(left, MINUTE)
    text = f"{number(left, SECOND)}s"
    if hours or minutes:
        text = f"{minutes}m{text}"
    if hours:
        text = f"{hours}h{text}"
    return sign + text
