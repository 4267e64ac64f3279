"""What the queries share: canonical inputs out of the driver's tables, the same in SQL, and output conventions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import adapters
from tidemark.sources.readers import table

EVENTS = ("event_id", "ts", "value")


def events(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "events", (*EVENTS, *more))


def bars(spark: SparkSession, d: str, minutes: int = 15) -> DataFrame:
    return adapters.session_bars(events(spark, d), minutes)


def all_bars(spark: SparkSession, d: str, minutes: int = 15) -> DataFrame:
    return adapters.labelled(adapters.bars_from_events(events(spark, d), minutes))


def daily(spark: SparkSession, d: str, by: str | None = None) -> DataFrame:
    columns = ("o_orderkey", "o_orderdate", "o_totalprice", *([by] if by else []))
    return adapters.sessions_from_orders(table(spark, d, "orders", columns), by)


def neat(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, dates and times as text, integers as long: what two engines write alike."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif kind == "date":
            c = c.cast("string")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


class Catalogue:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None):
        def keep(f):
            key = name or f.__name__
            self.queries[key] = lambda spark, d: neat(f(spark, d))
            if sql is not None:
                self.sql[key] = sql
            return f

        return keep


def bars_sql(minutes: int = 15, by: str | None = None) -> str:
    """CTEs: raw_bars, all_bars (labelled) and bars (those inside a session)."""
    k, part = (f"{by}, ", f"{by}, ts") if by else ("", "ts")
    return f"""
ticks AS (SELECT {k}event_id, ts AS tick_at, time_bucket(INTERVAL '{minutes} minutes', ts) AS ts, value FROM events WHERE value IS NOT NULL AND ts IS NOT NULL),
marked AS (SELECT *, coalesce(value >= lag(value) OVER (PARTITION BY {part} ORDER BY tick_at, event_id), true) AS up, CAST(round(value * 100) AS BIGINT) AS vol FROM ticks),
raw_bars AS (
  SELECT {k}ts, first(value ORDER BY tick_at, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY tick_at, event_id) AS close,
    coalesce(sum(vol) FILTER (WHERE up), 0)::BIGINT AS up_volume, coalesce(sum(vol) FILTER (WHERE NOT up), 0)::BIGINT AS down_volume,
    count(*) FILTER (WHERE up) AS up_ticks, count(*) FILTER (WHERE NOT up) AS down_ticks, sum(vol)::BIGINT AS total_volume, count(*) AS total_ticks
  FROM marked GROUP BY {part}),
local_bars AS (SELECT *, timezone('America/New_York', timezone('UTC', ts)) AS lt FROM raw_bars),
minute_bars AS (SELECT *, hour(lt) * 60 + minute(lt) AS m FROM local_bars),
all_bars AS (
  SELECT * EXCLUDE (lt, m), CAST(lt AS DATE) + CASE WHEN m >= 1080 THEN 1 ELSE 0 END AS session_date, (m + 360) % 1440 AS clock, (m + 360) % 1440 - 930 AS rth_minute, m >= 570 AND m < 960 AS is_rth
  FROM minute_bars),
bars AS (SELECT * FROM all_bars WHERE clock < 1380 AND isodow(session_date) < 6)"""


def daily_sql(by: str | None = None) -> str:
    k = f"{by}, " if by else ""
    return f"""
daily AS (
  SELECT {k}CAST(o_orderdate AS DATE) AS session_date, first(o_totalprice ORDER BY o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
    last(o_totalprice ORDER BY o_orderkey) AS close, count(*) AS volume, isodow(CAST(o_orderdate AS DATE)) < 6 AS expected, isodow(CAST(o_orderdate AS DATE)) < 6 AS usable
  FROM orders GROUP BY ALL)"""


def r(expression: str, name: str | None = None) -> str:
    """A rounded double."""
    return f"round(CAST({expression} AS DOUBLE), 6) + 0.0 AS {name or expression}"


def t(expression: str, name: str | None = None) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S') AS {name or expression}"


def s(expression: str, name: str | None = None) -> str:
    return f"CAST({expression} AS VARCHAR) AS {name or expression}"


def b(expression: str, name: str | None = None) -> str:
    return f"CAST({expression} AS BIGINT) AS {name or expression}"
