"""Session time: local clocks with daylight saving, trade dates, segments, calendar arithmetic. Instants are UTC as timestamp_ntz."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import SESSION, SessionSpec

MONTH_CODES = {3: "H", 6: "M", 9: "U", 12: "Z"}


def utc(ts: Column) -> Column:
    """A timestamp_ntz in UTC, whatever the session's time zone."""
    return ts.cast("timestamp_ntz")


def parsed(text: Column) -> Column:
    """An ISO-8601 text with Z or an offset as UTC; null without one or if it isn't a time."""
    zoned = text.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    return F.when(zoned, F.to_utc_timestamp(F.try_to_timestamp(text), F.current_timezone())).cast("timestamp_ntz")


def local(ts: Column, zone: str = SESSION.zone) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def local_minute(ts: Column, spec: SessionSpec = SESSION) -> Column:
    return minute_of_day(local(ts, spec.zone))


def session_date(ts: Column, spec: SessionSpec = SESSION) -> Column:
    """The trade date: the local date, and the next one from the evening's open on."""
    at = local(ts, spec.zone)
    return F.date_add(F.to_date(at), F.when(minute_of_day(at) >= spec.open_minute, 1).otherwise(0))


def is_rth(ts: Column, spec: SessionSpec = SESSION) -> Column:
    m = local_minute(ts, spec)
    return (m >= spec.rth_open) & (m < spec.rth_close)


def scheduled_minute(ts: Column, spec: SessionSpec = SESSION) -> Column:
    """Minutes since the session's scheduled open."""
    return F.pmod(local_minute(ts, spec) - spec.open_minute, F.lit(1440))


def rth_minute(ts: Column, spec: SessionSpec = SESSION) -> Column:
    """Minutes since the regular open; negative in the night before it."""
    return scheduled_minute(ts, spec) - (spec.rth_open - spec.open_minute) % 1440


def segment(rth: Column) -> Column:
    return (
        F.when(rth < 0, "overnight").when(rth < 30, "rth_opening").when(rth < 150, "rth_morning").when(rth < 390, "rth_afternoon").otherwise("post_rth")
    )


def utc_offset_minutes(ts: Column, zone: str = SESSION.zone) -> Column:
    return F.timestamp_diff("MINUTE", ts, local(ts, zone))


def iso_local(ts: Column, zone: str = SESSION.zone) -> Column:
    """The local time as text with its offset."""
    off = utc_offset_minutes(ts, zone)
    sign = F.when(off < 0, "-").otherwise("+")
    return F.concat(F.date_format(local(ts, zone), "yyyy-MM-dd'T'HH:mm:ss"), sign, F.format_string("%02d:%02d", F.floor(F.abs(off) / 60).cast("int"), (F.abs(off) % 60).cast("int")))


def clock_label(scope: Column, minute: Column, spec: SessionSpec = SESSION) -> Column:
    """HH:MM of a minute after the scope's open."""
    at = F.pmod(F.when(scope == "RTH", F.lit(spec.rth_open)).otherwise(F.lit(spec.open_minute)) + minute, F.lit(1440))
    return F.format_string("%02d:%02d", F.floor(at / 60).cast("int"), (at % 60).cast("int"))


def split_label(day: Column, splits) -> Column:
    """The name of the first range (name, first, last) that holds the day; else outside_research."""
    out = F.lit("outside_research")
    for name, first, last in reversed(splits):
        out = F.when(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")), name).otherwise(out)
    return out


def third_friday(day: Column) -> Column:
    first = F.trunc(day, "month")
    return F.date_add(F.next_day(F.date_sub(first, 1), "Fri"), 14)


def next_weekday(day: Column) -> Column:
    """The next day from Monday to Friday."""
    return F.date_add(day, F.when(F.weekday(day) == 4, 3).when(F.weekday(day) == 5, 2).otherwise(1))


def business_days_before(day: Column, n: int) -> Column:
    """n weekdays before a day; holidays aren't known here."""
    weeks, rest = divmod(n, 5)
    # from a weekend day as many lie before as from the Monday after it
    start = F.when(F.weekday(day) >= 5, F.date_add(day, 7 - F.weekday(day))).otherwise(day)
    back = F.when(F.weekday(start) < rest, rest + 2).otherwise(rest)
    return F.date_sub(start, back + 7 * weeks)


def contract_symbol(product: Column, expiry: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for pair in MONTH_CODES.items() for x in pair])
    return F.concat(product, F.try_element_at(codes, F.month(expiry)), (F.year(expiry) % 10).cast("string"))
