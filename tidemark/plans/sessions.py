"""Daily sessions out of orders: the chain of prior sessions, regimes, calendar parts, and general scans."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import clock, numbers
from tidemark.operators import session_features as sf
from tidemark.sources.readers import guarded, table

from .base import Catalogue, b, daily, daily_sql, events, r, s

C = Catalogue()
DAILY = daily_sql()
BY = daily_sql("o_orderpriority")


@C.add(f"WITH {DAILY} SELECT {s('session_date')}, {r('open')}, {r('high')}, {r('low')}, {r('close')}, volume, expected, usable FROM daily")
def daily_sessions(spark, d):
    return daily(spark, d)


def _prior_sql(source: str, part: str) -> str:
    cells = ", ".join(f"CASE WHEN pv THEN lag({c}) OVER w END AS prior_{c}" for c in ("open", "high", "low", "close", "volume"))
    return f"q AS (SELECT *, coalesce(lag(usable) OVER v AND lag(expected) OVER v, false) AS pv FROM {source} WINDOW v AS ({part} ORDER BY session_date)), pr AS (SELECT *, {cells} FROM q WINDOW w AS ({part} ORDER BY session_date))"


PRIOR = f"{r('prior_open')}, {r('prior_high')}, {r('prior_low')}, {r('prior_close')}, {b('coalesce(prior_volume, 0)', 'prior_volume')}, {r('prior_high - prior_low', 'prior_range')}, {r('prior_close / nullif(prior_open, 0) - 1', 'prior_return')}"


@C.add(f"WITH {DAILY}, {_prior_sql('daily', '')} SELECT {s('session_date')}, pv AS prior_valid, {PRIOR} FROM pr")
def prior_session(spark, d):
    got = sf.prior_session(daily(spark, d))
    return got.select("session_date", "prior_valid", *[f"prior_{c}" for c in ("open", "high", "low", "close", "volume", "range", "return")]).fillna(0, ["prior_volume"])


@C.add(f"WITH {BY}, {_prior_sql('daily', 'PARTITION BY o_orderpriority')} SELECT o_orderpriority, {s('session_date')}, pv AS prior_valid, {PRIOR} FROM pr")
def prior_session_by_series(spark, d):
    """The same for several series at once; each is ordered by itself."""
    got = sf.prior_session(daily(spark, d, "o_orderpriority"), by=("o_orderpriority",))
    return got.select("o_orderpriority", "session_date", "prior_valid", *[f"prior_{c}" for c in ("open", "high", "low", "close", "volume", "range", "return")]).fillna(0, ["prior_volume"])


def _daily_usable(spark, d):
    """Every day counts as a session, but for the 13th of a month, which isn't usable."""
    return daily(spark, d).withColumns({"expected": F.lit(True), "usable": F.dayofmonth("session_date") != 13})


REGIME = f"""{DAILY}, u AS (SELECT session_date, high, low, close, volume, day(session_date) <> 13 AS usable FROM daily),
v AS (SELECT *, CASE WHEN usable THEN high - low END AS rg, CASE WHEN usable THEN volume::DOUBLE END AS vo FROM u),
x AS (SELECT *, CASE WHEN count(rg) OVER l = 20 THEN avg(rg) OVER l END AS range_mean, CASE WHEN count(rg) OVER l = 20 THEN stddev_samp(rg) OVER l END AS range_std, CASE WHEN count(vo) OVER l = 20 THEN avg(vo) OVER l END AS volume_mean,
  CASE WHEN sum(usable::INT) OVER k = 6 THEN lag(close, 1) OVER o / nullif(lag(close, 6) OVER o, 0) - 1 END AS short_return, lag(rg) OVER o AS prg, lag(vo) OVER o AS pvo
  FROM v WINDOW o AS (ORDER BY session_date), l AS (ORDER BY session_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), k AS (ORDER BY session_date ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, prg / nullif(range_mean, 0) AS vr, pvo / nullif(volume_mean, 0) AS qr, usable AND range_mean IS NOT NULL AND volume_mean IS NOT NULL AND short_return IS NOT NULL AS ok FROM x)"""


def _if(c: str, name: str) -> str:
    return r(f"CASE WHEN ok THEN {c} END", name)


def _label(c: str, name: str) -> str:
    return f"CASE WHEN ok THEN CASE WHEN {c} <= 0.75 THEN 'low' WHEN {c} >= 1.25 THEN 'high' WHEN {c} IS NOT NULL THEN 'normal' END END AS {name}"


@C.add(f"WITH {REGIME} SELECT {s('session_date')}, ok AS regime_valid, {_if('range_mean', 'range_mean')}, {_if('range_std', 'range_std')}, {_if('volume_mean', 'volume_mean')}, {_if('short_return', 'short_return')}, {_if('vr', 'volatility_ratio')}, {_if('qr', 'volume_ratio')}, CASE WHEN ok THEN CASE WHEN short_return <= -0.005 THEN 'down' WHEN short_return >= 0.005 THEN 'up' ELSE 'flat' END END AS trend_regime, {_label('vr', 'volatility_regime')}, {_label('qr', 'volume_regime')} FROM y")
def lagged_regimes(spark, d):
    got = sf.lagged_regimes(_daily_usable(spark, d))
    return got.select("session_date", "regime_valid", "range_mean", "range_std", "volume_mean", "short_return", "volatility_ratio", "volume_ratio", "trend_regime", "volatility_regime", "volume_regime")


@C.add(f"WITH {DAILY} SELECT {s('session_date')}, year(session_date) AS calendar_year, quarter(session_date) AS calendar_quarter, month(session_date) AS calendar_month, weekofyear(session_date) AS calendar_iso_week, isodow(session_date) - 1 AS calendar_weekday FROM daily")
def calendar_parts(spark, d):
    return sf.calendar_parts(daily(spark, d).select("session_date"))


@C.add(f"WITH {DAILY}, w AS (SELECT session_date FROM daily WHERE expected), m AS (SELECT date_trunc('month', session_date) AS m, max(session_date) AS l FROM w GROUP BY 1) SELECT {s('session_date')}, session_date = l AS is_month_end FROM w JOIN m ON date_trunc('month', session_date) = m")
def month_end_sessions(spark, d):
    return sf.month_end(daily(spark, d).where("expected").select("session_date"))


SPLITS = [("development", "1995-01-01", "1998-12-31"), ("validation", "1999-01-01", "2000-03-31"), ("final_test", "2000-04-01", "2001-12-31")]
SPLIT = "CASE WHEN session_date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' THEN 'development' WHEN session_date BETWEEN DATE '1999-01-01' AND DATE '2000-03-31' THEN 'validation' WHEN session_date BETWEEN DATE '2000-04-01' AND DATE '2001-12-31' THEN 'final_test' ELSE 'outside_research' END"


@C.add(f"WITH {DAILY} SELECT {SPLIT} AS split, count(*) AS sessions, count(*) FILTER (WHERE usable) AS usable_sessions, sum(volume)::BIGINT AS volume, {s('min(session_date)', 'first_session')}, {s('max(session_date)', 'last_session')} FROM daily GROUP BY 1")
def split_counts(spark, d):
    got = daily(spark, d).withColumn("split", clock.split_label(F.col("session_date"), SPLITS))
    return got.groupBy("split").agg(F.count("*").alias("sessions"), F.count_if("usable").alias("usable_sessions"), F.sum("volume").alias("volume"), F.min("session_date").alias("first_session"), F.max("session_date").alias("last_session"))


@C.add(f"WITH {DAILY} SELECT {SPLIT} AS split, {s('session_date')}, {r('close')} FROM daily WHERE session_date BETWEEN DATE '1995-01-01' AND DATE '2000-03-31'")
def guarded_load(spark, d):
    """The analysis loader: only named, unlocked splits and columns."""
    rows = daily(spark, d).withColumn("split", clock.split_label(F.col("session_date"), SPLITS))
    return guarded(rows, ["development", "validation", "development"], [x[0] for x in SPLITS], "final_test", columns=["split", "session_date", "close"], order="session_date")


@C.add("SELECT o_orderstatus, count(*) AS orders, count(DISTINCT o_custkey) AS customers, count(DISTINCT CASE WHEN o_totalprice > 250000 THEN o_custkey END) AS large_customers, arg_max(o_orderkey, o_totalprice * 1e9 - o_orderkey) AS top_order FROM orders GROUP BY o_orderstatus")
def order_profile(spark, d):
    o = table(spark, d, "orders", ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"))
    return o.groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers"), F.countDistinct(F.when(F.col("o_totalprice") > 250000, F.col("o_custkey"))).alias("large_customers"), F.max_by("o_orderkey", F.col("o_totalprice") * 1e9 - F.col("o_orderkey")).alias("top_order"))


@C.add("SELECT json_extract_string(props, '$.k')::BIGINT % 10 AS bucket, count(*) AS events, round(sum(CAST(value AS DECIMAL(18, 2)))::DOUBLE, 6) + 0.0 AS total FROM events GROUP BY 1")
def props_json(spark, d):
    """Fields out of JSON text; sums are exact decimals."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return events(spark, d, "props").groupBy((k % 10).alias("bucket")).agg(F.count("*").alias("events"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


@C.add("SELECT sha256(event_id::VARCHAR || '|' || event_type) AS content_id, substr(sha256(event_type || '|' || CAST(ts AS DATE)::VARCHAR), 1, 20) AS request_id, event_id FROM events")
def identities(spark, d):
    e = events(spark, d, "event_type")
    return e.select(F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type"), 256).alias("content_id"), F.substring(F.sha2(F.concat_ws("|", "event_type", F.to_date("ts").cast("string")), 256), 1, 20).alias("request_id"), "event_id")


@C.add("SELECT n_name, r_name, count(*) AS orders, round(sum(CAST(o_totalprice AS DECIMAL(18, 2)))::DOUBLE, 6) + 0.0 AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def revenue_by_nation(spark, d):
    """Many-to-one joins: orders are summed by customer before they meet the dimensions, so only sums go through the joins."""
    o = table(spark, d, "orders", ("o_custkey", "o_totalprice")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    c = table(spark, d, "customer", ("c_custkey", "c_nationkey"))
    places = table(spark, d, "nation", ("n_nationkey", "n_name", "n_regionkey")).join(table(spark, d, "region", ("r_regionkey", "r_name")), F.col("n_regionkey") == F.col("r_regionkey"))
    got = o.join(c, "c_custkey").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return got.groupBy("n_name", "r_name").agg(F.sum("n").alias("orders"), F.sum("v").cast("double").alias("revenue"))


@C.add("SELECT l_returnflag, l_linestatus, count(*) AS lines, round(sum(CAST(l_quantity AS DECIMAL(18, 2)))::DOUBLE, 6) + 0.0 AS quantity, round(sum(CAST(l_extendedprice AS DECIMAL(18, 2)) * (1 - CAST(l_discount AS DECIMAL(18, 2))))::DOUBLE, 6) + 0.0 AS net FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-06-30' GROUP BY ALL")
def line_summary(spark, d):
    rows = table(spark, d, "lineitem", ("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")).where(F.col("l_shipdate") <= F.lit("2000-06-30").cast("timestamp_ntz"))
    dec = lambda c: F.col(c).cast("decimal(18,2)")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("lines"), F.sum(dec("l_quantity")).cast("double").alias("quantity"), F.sum(dec("l_extendedprice") * (1 - dec("l_discount"))).cast("double").alias("net"))


@C.add("SELECT o_orderkey, o_custkey, rk FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders) WHERE rk <= 3")
def top_orders(spark, d):
    at = W.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, d, "orders", ("o_orderkey", "o_custkey", "o_totalprice")).withColumn("rk", F.row_number().over(at)).where("rk <= 3").select("o_orderkey", "o_custkey", "rk")


@C.add("SELECT session_date::VARCHAR AS session_date, kind FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS session_date, 'union' AS kind FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') UNION ALL (SELECT CAST(o_orderdate AS DATE), 'both' FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT CAST(o_orderdate AS DATE), 'both' FROM orders WHERE o_orderpriority = '5-LOW') UNION ALL (SELECT CAST(o_orderdate AS DATE), 'first_only' FROM orders WHERE o_orderpriority = '1-URGENT' EXCEPT SELECT CAST(o_orderdate AS DATE), 'first_only' FROM orders WHERE o_orderpriority = '5-LOW'))")
def set_operations(spark, d):
    days = table(spark, d, "orders", ("o_orderdate", "o_orderpriority")).select(F.to_date("o_orderdate").alias("session_date"), "o_orderpriority")
    a, z = (days.where(F.col("o_orderpriority") == p).select("session_date") for p in ("1-URGENT", "5-LOW"))
    kinds = {"union": a.union(z).distinct(), "both": a.intersect(z), "first_only": a.subtract(z)}
    first, *rest = [x.withColumn("kind", F.lit(k)) for k, x in kinds.items()]
    for x in rest:
        first = first.unionByName(x)
    return first


@C.add("SELECT o_orderkey, round(o_totalprice / nullif(o_custkey % 3, 0) - 1, 6) + 0.0 AS guarded, CASE WHEN o_totalprice / 200000 <= 0.75 THEN 'low' WHEN o_totalprice / 200000 >= 1.25 THEN 'high' ELSE 'normal' END AS regime, concat_ws('|', CASE WHEN o_custkey % 2 = 0 THEN 'even' END, CASE WHEN o_custkey % 3 = 0 THEN 'third' END) AS codes FROM orders")
def guarded_numbers(spark, d):
    o = table(spark, d, "orders", ("o_orderkey", "o_custkey", "o_totalprice"))
    p = F.col("o_totalprice")
    return o.select("o_orderkey", numbers.change(p, F.col("o_custkey") % 3).alias("guarded"), numbers.regime(p / 200000, 0.75, 1.25).alias("regime"), numbers.codes(even=F.col("o_custkey") % 2 == 0, third=F.col("o_custkey") % 3 == 0).alias("codes"))
