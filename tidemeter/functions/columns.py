"""Scalar column functions: parsing, clocks, calendar keys, filters, hashing and small formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``.

    Array functions evaluate what they refer to again for every element, so intermediate arrays and
    sums inside them need a name.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


# --- station field "(code) name" ---------------------------------------------------------------

def _before_close(field: Column) -> Column:
    return F.trim(F.replace(F.split_part(field, F.lit(")"), F.lit(1)), F.lit("("), F.lit("")))


def station_code(field: Column | str) -> Column:
    """Code of ``"(code) name"``; null unless both brackets are present."""
    f = _col(field)
    return F.when(f.contains("(") & f.contains(")"), _before_close(f))


def station_name(field: Column | str) -> Column:
    """Name of ``"(code) name"``: the text between the first and the second ``)``."""
    f = _col(field)
    return F.when(f.contains("(") & f.contains(")"), F.trim(F.split_part(f, F.lit(")"), F.lit(2))))


def station_code_lenient(field: Column | str) -> Column:
    """Code when only the opening bracket is guaranteed."""
    f = _col(field)
    return F.when(f.contains("("), _before_close(f))


def station_matches(field: Column | str, code: str) -> Column:
    """Case-insensitive regular-expression match anywhere in the raw field."""
    return _col(field).rlike(f"(?i){code}")


# --- clocks ------------------------------------------------------------------------------------

def join_date_time(date: Column | str, time: Column | str) -> Column:
    return F.to_timestamp(F.concat_ws(" ", _col(date), _col(time)))


def floor_minutes(ts: Column | str, minutes: int) -> Column:
    """Start of the fixed window of ``minutes`` that holds ``ts``."""
    s = F.unix_seconds(_col(ts))
    return F.timestamp_seconds(s - F.pmod(s, F.lit(minutes * 60)))


def ceil_minutes(ts: Column | str, minutes: int) -> Column:
    """Smallest window boundary not before ``ts``."""
    width = minutes * 60 * MICROS
    us = F.unix_micros(_col(ts))
    return F.timestamp_micros(us + F.pmod(-us, F.lit(width)))


def hhmm(ts: Column | str) -> Column:
    """Clock time as the integer HHMM (04:00 is 400)."""
    return F.hour(_col(ts)) * 100 + F.minute(_col(ts))


def hhmm_to_minutes(time: Column | str) -> Column:
    t = _col(time)
    return (F.floor(t / 100) * 60 + t % 100).cast("int")


def minutes_to_hhmm(minutes: Column | str) -> Column:
    m = _col(minutes)
    return (F.floor(m / 60) * 100 + m % 60).cast("int")


def minute_of_day(ts: Column | str) -> Column:
    return F.hour(_col(ts)) * 60 + F.minute(_col(ts))


def second_of_day(ts: Column | str) -> Column:
    return minute_of_day(ts) * 60 + F.second(_col(ts))


def fractional_minute(ts: Column | str) -> Column:
    """Minutes since midnight, down to the microsecond."""
    return F.pmod(F.unix_micros(_col(ts)), F.lit(86_400 * MICROS)) / F.lit(60.0 * MICROS)


def seconds_between(later: Column | str, earlier: Column | str) -> Column:
    return (F.unix_micros(_col(later)) - F.unix_micros(_col(earlier))) / F.lit(float(MICROS))


def in_hours(time: Column | str, start: int = 400, end: int = 2300) -> Column:
    """Operating hours on an HHMM integer, both ends included."""
    return _col(time).between(start, end)


def week_of_month(date: Column | str) -> Column:
    d = _col(date)
    return F.ceil((F.dayofmonth(d) + F.weekday(F.trunc(d, "month"))) / 7).cast("int")


def calendar_keys(ts: Column | str) -> list[Column]:
    """Calendar fields of a window start; Monday is day 0."""
    t = _col(ts)
    return [
        F.year(t).alias("year"),
        F.month(t).alias("month"),
        F.dayofmonth(t).alias("day"),
        F.weekday(t).alias("day_of_week"),
        hhmm(t).alias("time"),
    ]


def on_date(ts: Column | str, date: str) -> Column:
    """Calendar-day equality written as a range, so that it reaches the file scan."""
    t = _col(ts)
    day = F.to_timestamp_ntz(F.lit(f"{date} 00:00:00"))
    return (t >= day) & (t < day + F.make_dt_interval(F.lit(1)))


def date_of(year: Column | str, month: Column | str, day: Column | str) -> Column:
    return F.make_date(_col(year), _col(month), _col(day))


def between_dates(year: str, month: str, day: str, start: str | None, end: str | None) -> Column:
    """Inclusive date range over separate year, month and day columns."""
    d = date_of(year, month, day)
    keep = F.lit(True)
    if start:
        keep = keep & (d >= F.lit(start).cast("date")) & (F.col(year) >= int(start[:4]))
    if end:
        keep = keep & (d <= F.lit(end).cast("date")) & (F.col(year) <= int(end[:4]))
    return keep


# --- hashing: stable under repartitioning ------------------------------------------------------

def unit_hash(*parts: Column | str, seed: int = 42) -> Column:
    """Uniform number in [0, 1) from the row key and a seed, never from row position."""
    digest = F.md5(F.concat_ws("|", *[_col(p).cast("string") for p in parts], F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") / F.lit(float(2**48))


def jitter(ts: Column | str, *key: Column | str, width_s: float = 1.0, seed: int = 42) -> Column:
    """Timestamp moved forward by up to ``width_s`` seconds."""
    shift = F.floor(unit_hash(*key, seed=seed) * F.lit(width_s * MICROS))
    return F.timestamp_micros(F.unix_micros(_col(ts)) + shift)


# --- small formulas ----------------------------------------------------------------------------

OVERDISPERSED = 1.2
UNDERDISPERSED = 0.8


def dispersion_verdict(ratio: Column | str) -> Column:
    r = _col(ratio)
    return (
        F.when(r > OVERDISPERSED, "overdispersed")
        .when(r < UNDERDISPERSED, "underdispersed")
        .when(r.isNotNull(), "adequate")
    )


def exponential_pit(x: Column | str) -> Column:
    return 1 - F.exp(-_col(x))


def nb_p_from_r(r: Column | str, mean: Column | str) -> Column:
    """Success probability of a negative binomial with size ``r`` (at least 1e-6)."""
    size = F.greatest(_col(r), F.lit(1e-6))
    return size / (size + _col(mean))


def nb_variance(mean: Column | str, k: Column | str) -> Column:
    return _col(mean) + _col(k) * _col(mean) * _col(mean)


def nb_p_from_k(mean: Column | str, k: Column | str) -> Column:
    return _col(mean) / nb_variance(mean, k)


def nb_r_from_k(mean: Column | str, k: Column | str) -> Column:
    m = _col(mean)
    return m * m / (nb_variance(mean, k) - m)
