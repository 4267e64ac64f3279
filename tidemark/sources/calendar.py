"""The trading calendar as a table: weekdays without holidays, early and special closes, and each session's minutes."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import SESSION, SessionSpec

#: Years that the rules below are known to hold for.
YEARS = range(2021, 2027)
#: Closes that follow no rule (minute of the local day). On these Good Fridays the market opened for the monthly employment report.
REPORT_FRIDAYS = {"2021-04-02": 555, "2023-04-07": 555, "2026-04-03": 555}
SPECIAL = {"2025-01-09": (570, "CME_SER_9499R_national_day_of_mourning")}
EARLY_CLOSE, EVE_CLOSE = 780, 795


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th such weekday of a month, from its end if n is negative."""
    days = [d for i in range(31) if (d := date(year, month, 1) + timedelta(i)).month == month and d.weekday() == weekday]
    return days[n - 1 if n > 0 else n]


def _easter(year: int) -> date:
    """Easter Sunday: the first Sunday after the full moon of the Gregorian lunar calendar on or after 21 March."""
    century, golden = year // 100, year % 19
    epact = (14 + 11 * golden - century * 3 // 4 + (5 + 8 * century) // 25) % 30
    epact += 1 if epact == 0 or (epact == 1 and golden > 10) else 0
    moon = date(year, 4, 19) - timedelta(epact)
    return moon + timedelta(6 - moon.weekday() if moon.weekday() < 6 else 7)


def _observed(day: date) -> date:
    """A holiday of the weekend stands on the Friday before or the Monday after."""
    return day + timedelta({5: -1, 6: 1}.get(day.weekday(), 0))


def holidays_of(year: int) -> list[str]:
    """Days without a session: New Year's Day (not moved to the old year), Good Friday but for the listed ones, Christmas."""
    new_year = date(year, 1, 1)
    out = [_easter(year) - timedelta(2), _observed(date(year, 12, 25))]
    if new_year.weekday() != 5:
        out.append(_observed(new_year))
    return sorted(str(d) for d in out if str(d) not in REPORT_FRIDAYS)


def early_closes_of(year: int) -> dict[str, int]:
    """Closes before the usual one: federal holidays, the days around two of them, and the listed Fridays."""
    july, juneteenth = _observed(date(year, 7, 4)), _observed(date(year, 6, 19))
    thanks = _nth(year, 11, 3, 4)
    out = {d: EARLY_CLOSE for d in (_nth(year, 1, 0, 3), _nth(year, 2, 0, 3), _nth(year, 5, 0, -1), july, _nth(year, 9, 0, 1), thanks)}
    if year >= 2022:
        out[juneteenth] = EARLY_CLOSE
    eves = [thanks + timedelta(1), date(year, 12, 24)] + ([date(year, 7, 3)] if july == date(year, 7, 4) else [])
    out |= {d: EVE_CLOSE for d in eves if d.weekday() < 5 and d not in out and d != _observed(date(year, 12, 25))}
    return {str(d): m for d, m in sorted(out.items())} | {d: m for d, m in REPORT_FRIDAYS.items() if d.startswith(str(year))}


def schedule(spark: SparkSession, first: date, last: date, spec: SessionSpec = SESSION, holidays=None, early=None, special=None) -> DataFrame:
    """One row for each expected session: session_date, open_utc, close_utc, rth_open_utc, expected_minutes, expected_rth_minutes, is_early_close, override, note.

    Years that the rules aren't known to hold for fail unless holidays are given: a session is never assumed to be a full one.
    """
    years = range(first.year, last.year + 1)
    if holidays is None:
        if missing := [y for y in years if y not in YEARS]:
            raise ValueError(f"no calendar for {missing}")
        holidays = [d for y in years for d in holidays_of(y)]
        early = {d: m for y in years for d, m in early_closes_of(y).items()} if early is None else early
    early = early or {}
    special = SPECIAL if special is None else special
    closes = {**{d: (m, False, None) for d, m in early.items()}, **{d: (m, True, n) for d, (m, n) in special.items()}}
    days = spark.sql("SELECT explode(sequence(DATE'%s', DATE'%s')) AS session_date" % (first, last)).where(F.weekday("session_date") < 5)
    if holidays:
        days = days.where(~F.col("session_date").cast("string").isin(list(holidays)))
    known = spark.createDataFrame([(d, *x) for d, x in closes.items()] or [("1900-01-01", 0, False, None)], "d string, close_minute int, override boolean, note string")
    out = days.join(F.broadcast(known), F.col("session_date").cast("string") == F.col("d"), "left")
    close = F.coalesce("close_minute", F.lit(spec.close_minute))
    midnight = F.col("session_date").cast("timestamp_ntz")
    instant = lambda at: F.convert_timezone(F.lit(spec.zone), F.lit("UTC"), at)
    rth_close = F.least(close, F.lit(spec.rth_close))
    return out.select(
        "session_date", instant(F.timestamp_add("MINUTE", F.lit(spec.open_minute - 1440), midnight)).alias("open_utc"), instant(F.timestamp_add("MINUTE", close, midnight)).alias("close_utc"),
        instant(F.timestamp_add("MINUTE", F.lit(spec.rth_open), midnight)).alias("rth_open_utc"), (close - spec.open_minute + 1440).alias("expected_minutes"),
        F.greatest(F.lit(0), rth_close - spec.rth_open).alias("expected_rth_minutes"), F.col("close_minute").isNotNull().alias("is_early_close"), F.coalesce("override", F.lit(False)).alias("override"), "note",
    )


def expected_bars(sessions: DataFrame, minutes: int = 1) -> DataFrame:
    """session_date, ts: the start of each bar from a session's open to before its close."""
    step = F.expr(f"INTERVAL '{minutes}' MINUTE")
    return sessions.select("session_date", F.explode(F.sequence("open_utc", F.col("close_utc") - step, step)).alias("ts"))
