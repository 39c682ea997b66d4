"""Column functions: guarded arithmetic, times, labels, parameters and the flat triangle's index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import COIN_SUFFIX, COIN_SUFFIXES

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"
WEEKDAYS = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]


def safe_div(a: Column, b: Column, guard: Column, default: float | None = 0.0) -> Column:
    """a / b where ``guard`` holds; ANSI division never sees the other rows."""
    return F.when(guard, a / F.when(guard, b)).otherwise(F.lit(default))


def rounded(x: Column, digits: int = 6) -> Column:
    """Half-up rounding without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def finite(x: Column) -> Column:
    """``x``, or null where it is NaN or infinite: null is the only missing value."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def decimal_of(x: Column, precision: int = 18, scale: int = 8) -> Column:
    """Decimal of a vendor's string; null where it is none."""
    return x.try_cast(f"decimal({precision},{scale})")


def trunc_ntz(unit: str, t: Column) -> Column:
    """Start of the period, without a zone."""
    return F.date_trunc(unit, t).cast("timestamp_ntz")


def hours(n: int | Column) -> Column:
    """An interval of ``n`` hours."""
    return F.make_dt_interval(hours=n if isinstance(n, Column) else F.lit(n))


def at(t: str | Column) -> Column:
    return t if isinstance(t, Column) else F.lit(t).cast("timestamp_ntz")


def ms_of(x: Column) -> Column:
    """Epoch milliseconds of a time given in seconds or milliseconds."""
    return F.when(x < 10**12, x * 1000).otherwise(x).cast("bigint")


def floor_minute_ms(ms: Column) -> Column:
    return (F.floor(ms / 60_000) * 60_000).cast("bigint")


def close_ms(open_ms: Column) -> Column:
    """The last millisecond of the minute."""
    return open_ms + 59_999


def step_index(t: Column, start: Column, step_seconds: int) -> Column:
    """Steps from ``start`` to ``t``, rounded down."""
    seconds = F.unix_timestamp(t.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))
    return F.floor(seconds / step_seconds).cast("bigint")


def cadence_floor(t: Column, minutes: int) -> Column:
    """The last boundary of a cadence of ``minutes`` at or before ``t``."""
    s = F.unix_timestamp(t.cast("timestamp"))
    return F.timestamp_seconds(F.floor(s / (60 * minutes)) * (60 * minutes))


def parse_day(text: Column) -> Column:
    """Times given as ``DD MMM YYYY`` with or without ``HH:MM``; null for anything else."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("dd MMM yyyy HH:mm")), F.try_to_timestamp(text, F.lit("dd MMM yyyy")))


def partition_hour(t: Column) -> Column:
    return F.date_format(t, "yyyyMMddHH")


def day_of_week(t: Column) -> Column:
    """0 is Sunday."""
    return (F.dayofweek(t) - 1).cast("bigint")


def period_label(kind: str, period: Column) -> Column:
    if kind == "day":
        return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), (period + 1).cast("int"))
    return F.concat(F.lpad(period.cast("string"), 2, "0"), F.lit(":00"))


def pair_label(a: Column, b: Column) -> Column:
    return F.concat_ws("-", a, b)


def clean_params(raw: Column, drop: Column | None = None) -> Column:
    """A comma-separated parameter as a list: trimmed, without empty ones and repeats, in order."""
    parts = F.transform(F.split(raw, ","), lambda x: F.trim(x))
    parts = F.array_distinct(F.filter(parts, lambda x: x != ""))
    return F.filter(parts, lambda x: x != drop) if drop is not None else parts


def triangle_index(i: Column, j: Column, n: Column) -> Column:
    """Place of the pair (i, j), i <> j, in the row-major strict upper triangle of an n by n matrix."""
    a, b = F.least(i, j), F.greatest(i, j)
    place = a * n - F.floor(a * (a + 1) / 2) + b - a - 1
    return F.when(i != j, place.cast("bigint"))


def stream_position(entry_id: Column) -> Column:
    """A stream entry's id ``ms-seq`` as a struct that compares in stream order."""
    parts = F.split(entry_id, "-")
    return F.struct(F.element_at(parts, 1).cast("bigint").alias("ms"), F.coalesce(F.try_element_at(parts, F.lit(2)).cast("bigint"), F.lit(0)).alias("seq"))


def coin_symbol(coin: Column, suffix: str) -> Column:
    """An exchange's symbol for a coin of the market-cap list."""
    return F.concat(F.upper(coin), F.lit(suffix))


def exchange_symbol(coin: Column, exchange: str | Column) -> Column:
    """The symbol of a coin on an exchange, each with its own suffix."""
    if isinstance(exchange, str):
        return coin_symbol(coin, COIN_SUFFIXES.get(exchange, COIN_SUFFIX))
    known = F.create_map(*[F.lit(x) for pair in COIN_SUFFIXES.items() for x in pair])
    return F.concat(F.upper(coin), F.coalesce(F.try_element_at(known, exchange), F.lit(COIN_SUFFIX)))


def perspective(base: Column, s1: Column, s2: Column) -> Column:
    """The other side of a pair, seen from ``base``."""
    return F.when(s1 == base, s2).otherwise(s1)
