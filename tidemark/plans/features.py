"""The full feature tables on the calendar, and their checks."""

from __future__ import annotations

from calendar import monthrange
from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F

from tidemark.config import WINDOWS
from tidemark.operators import catalog
from tidemark.operators import feature_tables as ft
from tidemark.operators import quality as ql
from tidemark.sources import calendar

from .base import Catalogue, all_bars, bars

C = Catalogue()
#: The windows in quarter-hour bars.
QUARTERS = replace(WINDOWS, opening=(15, 30, 60), lags=(1, 2, 4), vol=(4, 8), ranges=(4,), regime_long=5, regime_short=2)


def _months(every):
    """The first and last day of the months that the bars' sessions may be in; January 2024 without bars."""
    # a session starts on the evening before its day
    first, last = every.agg(F.min("ts").cast("date"), F.max(F.col("ts") + F.expr("INTERVAL 1 DAY")).cast("date")).first()
    first, last = first or date(2024, 1, 1), last or date(2024, 1, 31)
    return first.replace(day=1), last.replace(day=monthrange(last.year, last.month)[1])


def _sessions(spark, d):
    every = all_bars(spark, d)
    schedule = calendar.schedule(spark, *_months(every))
    records = ql.session_records(calendar.expected_bars(schedule, 15), every)
    usable = records.select("session_date", (F.col("missing_rth_bars") < 3).alias("usable"))
    return ft.session_table(bars(spark, d), schedule, usable, 15, QUARTERS)


@C.add()
def session_feature_table(spark, d):
    return _sessions(spark, d)


@C.add()
def bar_feature_table(spark, d):
    return ft.bar_table(bars(spark, d), _sessions(spark, d), 15, QUARTERS)


#: No feature may be there before it is known, so the counts are fixed.
NONE_EARLY = ", ".join(f"0::BIGINT AS early_{k}" for k in sorted(catalog.families(catalog.features(QUARTERS))))


@C.add(f"SELECT {NONE_EARLY}")
def point_in_time(spark, d):
    from tidemark.operators import bar_features as bf

    table = ft.bar_table(bars(spark, d), _sessions(spark, d), 15, QUARTERS)
    return bf.violations(table, catalog.families(catalog.features(QUARTERS)), "bar_available_at_utc").drop("rows")
