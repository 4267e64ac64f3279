from __future__ import annotations

import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import clock, numbers

from .conftest import rows


@pytest.mark.parametrize(("df", "t"), [(1, 12.706205), (9, 2.262157), (30, 2.042272), (120, 1.979930)])
def test_t_quantile(df, t):
    assert numbers.t_quantile(0.975, df) == pytest.approx(t, abs=1e-6)
    assert numbers.t_quantile(0.025, df) == pytest.approx(-t, abs=1e-6)


def test_t_expansion_meets_table(spark):
    got = spark.range(1).select(numbers.t_beyond(F.lit(2001))).first()[0]
    assert got == pytest.approx(numbers.t_quantile(0.975, 2001), abs=1e-9)


def test_wilson_edges(spark):
    df = spark.createDataFrame([(0, 10), (10, 10), (5, 10), (0, 0)], "k int, n int")
    low, high = numbers.wilson(F.col("k"), F.col("n"))
    got = df.select(low.alias("a"), high.alias("b")).collect()
    assert got[0]["a"] == pytest.approx(0.0, abs=1e-12) and 0 < got[0]["b"] < 0.35
    assert got[1]["b"] == 1.0 and 0.65 < got[1]["a"] < 1
    assert got[2]["a"] == pytest.approx(0.2366, abs=1e-4) and got[2]["b"] == pytest.approx(0.7634, abs=1e-4)
    assert got[3]["a"] is None


def test_t_interval_needs_two(spark):
    df = spark.createDataFrame([(1.0, None, 1), (1.0, 2.0, 10), (1.0, 2.0, 5000)], "m double, s double, n int")
    got = numbers.with_t_interval(df, "m", "s", "n").orderBy("n").collect()
    assert got[0]["t_low"] is None
    assert got[1]["t_high"] == pytest.approx(1 + 2.262157 * 2 / math.sqrt(10), abs=1e-5)
    assert got[2]["t_high"] == pytest.approx(1 + numbers.t_quantile(0.975, 4999) * 2 / math.sqrt(5000), abs=1e-9)


def test_guarded_numbers(spark):
    df = spark.createDataFrame([(1.0, 0.0), (float("nan"), 1.0), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(numbers.change(F.col("a"), F.col("b"))).collect()] == [None, None, 0.5]
    labels = spark.createDataFrame([(0.75,), (1.25,), (1.0,), (None,)], "x double").select(numbers.regime(F.col("x"), 0.75, 1.25))
    assert [r[0] for r in labels.collect()] == ["low", "high", "normal", None]


def test_daylight_saving(spark):
    """In March the clocks change: the same UTC hour is another local one, and another offset."""
    df = spark.createDataFrame([(datetime(2024, 3, 8, 14, 30),), (datetime(2024, 3, 11, 13, 30),), (datetime(2024, 3, 10, 22, 0),), (datetime(2024, 11, 4, 23, 0),)], "ts timestamp_ntz")
    ts = F.col("ts")
    got = df.select(clock.is_rth(ts), clock.rth_minute(ts), clock.utc_offset_minutes(ts), clock.session_date(ts), clock.iso_local(ts)).collect()
    assert tuple(got[0])[:3] == (True, 0, -300) and tuple(got[1])[:3] == (True, 0, -240)
    assert got[2][3] == date(2024, 3, 11) and got[2][4] == "2024-03-10T18:00:00-04:00"
    assert got[3][3] == date(2024, 11, 5)


def test_calendar_arithmetic(spark):
    df = spark.createDataFrame([(date(2024, 3, 15),), (date(2024, 6, 1),), (date(2024, 6, 10),)], "d date")
    got = df.select(clock.third_friday(F.col("d")), clock.business_days_before(F.col("d"), 5), clock.next_weekday(F.col("d"))).collect()
    assert tuple(got[0]) == (date(2024, 3, 15), date(2024, 3, 8), date(2024, 3, 18))
    assert tuple(got[1]) == (date(2024, 6, 21), date(2024, 5, 27), date(2024, 6, 3))
    assert tuple(got[2]) == (date(2024, 6, 21), date(2024, 6, 3), date(2024, 6, 11))


def test_business_days_against_a_walk(spark):
    from datetime import timedelta

    days = [date(2024, 1, 1) + timedelta(i) for i in range(30)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    for n in (1, 3, 5, 8):
        for r in df.select("d", clock.business_days_before(F.col("d"), n).alias("b")).collect():
            x, left = r["d"], n
            while left:
                x -= timedelta(1)
                left -= x.weekday() < 5
            assert r["b"] == x, (r["d"], n)


def test_parse_and_labels(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05-05:00",), ("2024-01-02T03:04:05",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(clock.parsed(F.col("s"))).collect()] == [datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 8, 4, 5), None, None, None]
    two = spark.createDataFrame([("RTH", 0), ("ETH", 0), ("ETH", 420)], "s string, m int").select(clock.clock_label(F.col("s"), F.col("m")))
    assert [r[0] for r in two.collect()] == ["09:30", "18:00", "01:00"]
    assert rows(spark.range(1).select(clock.contract_symbol(F.lit("ES"), F.lit(date(2025, 3, 21))))) == [("ESH5",)]
