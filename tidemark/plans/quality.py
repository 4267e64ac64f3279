"""Validity, duplicates, the calendar, gaps, and contract rolls."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidemark.functions import clock, numbers
from tidemark.operators import quality as ql
from tidemark.operators import rolls
from tidemark.sources import calendar
from tidemark.sources.readers import table

from .base import Catalogue, all_bars, bars_sql, events, r, s, t

C = Catalogue()
BARS15 = bars_sql(15)
FIRST, LAST = date(2024, 1, 1), date(2024, 1, 31)


def _raw(spark, d):
    """Bars with faults of all kinds, out of line items."""
    p, q = F.col("l_extendedprice"), F.col("l_quantity")
    rows = table(spark, d, "lineitem", ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"))
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        F.when(q == 7, None).when(q == 8, F.expr("l_shipdate + INTERVAL 30 SECONDS")).otherwise(F.col("l_shipdate")).cast("timestamp_ntz").alias("ts"),
        F.when(q == 9, "n/a").otherwise((F.floor(p) / 4).cast("string")).alias("open"), (F.floor(p) / 4 + F.col("l_discount") * 100 - 1).alias("high"), (F.floor(p) / 4 - F.col("l_tax") * 100).alias("low"),
        F.when(q == 10, -1.0).otherwise(F.floor(p) / 4).alias("close"), (q - 2).alias("up_volume"), F.lit(1).alias("down_volume"), F.lit(1).alias("up_ticks"), (q - 1.5).alias("down_ticks"),
    )


RAW = """raw AS (
  SELECT l_orderkey * 10 + l_linenumber AS row_id, CASE WHEN l_quantity = 7 THEN NULL WHEN l_quantity = 8 THEN l_shipdate + INTERVAL 30 SECONDS ELSE l_shipdate END AS ts, l_quantity = 9 AS nan,
    CASE WHEN l_quantity = 9 THEN NULL ELSE floor(l_extendedprice) / 4 END AS open, floor(l_extendedprice) / 4 + l_discount * 100 - 1 AS high, floor(l_extendedprice) / 4 - l_tax * 100 AS low,
    CASE WHEN l_quantity = 10 THEN -1.0 ELSE floor(l_extendedprice) / 4 END AS close, l_quantity - 2 AS up, l_quantity - 1.5 AS dt FROM lineitem),
chk AS (
  SELECT row_id, concat_ws('|', CASE WHEN ts IS NULL THEN 'invalid_timestamp' END, CASE WHEN date_trunc('minute', ts) <> ts THEN 'non_minute_timestamp' END, CASE WHEN nan THEN 'non_numeric' END,
    CASE WHEN coalesce(open <= 0, false) OR high <= 0 OR low <= 0 OR close <= 0 THEN 'non_positive_price' END,
    CASE WHEN high < greatest(open, high, low, close) OR low > least(open, high, low, close) THEN 'invalid_ohlc_order' END, CASE WHEN up < 0 THEN 'negative_volume' END, CASE WHEN dt < 0 THEN 'negative_ticks' END,
    CASE WHEN coalesce(abs(open / 0.25 - round(open / 0.25)) > 1e-8, false) OR abs(high / 0.25 - round(high / 0.25)) > 1e-8 OR abs(low / 0.25 - round(low / 0.25)) > 1e-8 OR abs(close / 0.25 - round(close / 0.25)) > 1e-8 THEN 'off_tick_price' END) AS issue_codes FROM raw)"""


@C.add(f"WITH {RAW} SELECT row_id, issue_codes, issue_codes = '' AS row_valid FROM chk")
def row_validity(spark, d):
    return ql.checked(_raw(spark, d)).select("row_id", "issue_codes", "row_valid")


GRAVE = "CASE i " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ql.GRAVITY.items()) + " END"


@C.add(f"""WITH {RAW}, e AS (SELECT row_id, unnest(string_split(issue_codes, '|')) AS i FROM chk WHERE issue_codes <> '')
SELECT i AS issue, count(*) AS rows, array_to_string(list_sort(list(row_id))[1:3], '|') AS sample_rows, {GRAVE} AS severity FROM e GROUP BY i""")
def issue_summary(spark, d):
    got = ql.issue_summary(ql.checked(_raw(spark, d)), "row_id")
    return got.withColumn("sample_rows", F.array_join(F.col("sample_rows").cast("array<string>"), "|"))


@C.add("SELECT n_name, CASE WHEN n_regionkey IN (1, 2) THEN CASE WHEN n_regionkey = 2 THEN 'high' ELSE 'low' END ELSE 'none' END AS severity FROM nation")
def severity_lattice(spark, d):
    a = F.when(F.col("n_regionkey") >= 1, F.when(F.col("n_regionkey") <= 2, "low"))
    return table(spark, d, "nation").select("n_name", numbers.max_severity(a, F.when(F.col("n_regionkey") == 2, "high")).alias("severity"))


def _twice(spark, d):
    """Events again with copies: every fifth an exact one, every seventh another value."""
    e = events(spark, d, "event_type").withColumn("request", F.lit("a"))
    exact, other = e.where("event_id % 5 = 0"), e.where("event_id % 7 = 0").withColumn("value", F.col("value") + 1)
    return e.unionByName(exact.withColumn("request", F.lit("b"))).unionByName(other.withColumn("request", F.lit("c")))


TWICE = "tw AS (SELECT event_id, ts, value, event_type, 'a' AS request FROM events UNION ALL SELECT event_id, ts, value, event_type, 'b' FROM events WHERE event_id % 5 = 0 UNION ALL SELECT event_id, ts, value + 1, event_type, 'c' FROM events WHERE event_id % 7 = 0)"


@C.add(f"WITH {TWICE}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type, event_id ORDER BY request DESC) AS k FROM tw) SELECT event_id, event_type, request, {r('value')} FROM n WHERE k = 1")
def dedup_first(spark, d):
    return ql.first_of(_twice(spark, d), ["event_type", "event_id"], [F.col("request").desc()]).select("event_id", "event_type", "request", "value")


@C.add(f"WITH {TWICE}, g AS (SELECT event_id, count(*) AS rows, count(DISTINCT value) AS signatures FROM tw GROUP BY event_id HAVING count(*) > 1) SELECT event_id, rows, signatures, CASE WHEN signatures = 1 THEN rows - 1 ELSE 0 END AS exact_removed, signatures > 1 AS conflicting FROM g")
def duplicate_audit(spark, d):
    return ql.duplicates(_twice(spark, d), ["event_id"], ["ts", "value", "event_type"])


@C.add(f"WITH {TWICE}, g AS (SELECT *, ts < lag(ts) OVER (PARTITION BY event_type ORDER BY (event_id * 7919) % 10007, event_id, request) AS back FROM tw) SELECT event_type, count(*) AS rows, count(ts) - count(DISTINCT ts) AS duplicate_timestamps, count(*) FILTER (WHERE back) AS out_of_order FROM g GROUP BY event_type")
def timestamp_diagnostics(spark, d):
    rows = _twice(spark, d).withColumn("place", F.struct(F.col("event_id") * 7919 % 10007, "event_id", "request"))
    return ql.timestamp_diagnostics(rows, "event_type", "place")


def _expected(spark):
    return calendar.expected_bars(calendar.schedule(spark, FIRST, LAST), 15)


CAL = """days AS (SELECT CAST(range AS DATE) AS session_date FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01', INTERVAL 1 DAY)),
cal AS (SELECT session_date, CASE WHEN session_date = DATE '2024-01-15' THEN 780 ELSE 1020 END AS cm FROM days WHERE isodow(session_date) < 6 AND session_date <> DATE '2024-01-01'),
sch AS (SELECT session_date, CAST(session_date AS TIMESTAMP) - INTERVAL 1 HOUR AS open_utc, CAST(session_date AS TIMESTAMP) + to_minutes(cm + 300) AS close_utc, CAST(session_date AS TIMESTAMP) + INTERVAL 870 MINUTES AS rth_open_utc, cm + 360 AS expected_minutes, least(cm, 960) - 570 AS expected_rth_minutes, cm = 780 AS is_early_close FROM cal),
exb AS (SELECT session_date, unnest(generate_series(open_utc, close_utc - INTERVAL 15 MINUTES, INTERVAL 15 MINUTES)) AS ts FROM sch)"""


@C.add(f"WITH {CAL} SELECT {s('session_date')}, {t('open_utc')}, {t('close_utc')}, {t('rth_open_utc')}, expected_minutes::BIGINT AS expected_minutes, expected_rth_minutes::BIGINT AS expected_rth_minutes, is_early_close, false AS override FROM sch")
def calendar_sessions(spark, d):
    return calendar.schedule(spark, FIRST, LAST).drop("note")


@C.add(f"WITH {CAL} SELECT session_date::VARCHAR AS session_date, count(*) AS bars, {t('min(ts)', 'first_ts')}, {t('max(ts)', 'last_ts')} FROM exb GROUP BY session_date")
def expected_grid(spark, d):
    return _expected(spark).groupBy("session_date").agg(F.count("*").alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@C.add(f"WITH {BARS15}, {CAL} SELECT {s('session_date')}, {t('ts')} FROM exb WHERE ts NOT IN (SELECT ts FROM all_bars)")
def missing_bars(spark, d):
    return ql.missing(_expected(spark), all_bars(spark, d)).select("session_date", "ts")


@C.add(f"WITH {BARS15}, {CAL} SELECT {s('session_date')}, {t('ts')} FROM all_bars WHERE ts NOT IN (SELECT ts FROM exb)")
def unexpected_bars(spark, d):
    return ql.unexpected(_expected(spark), all_bars(spark, d)).select("session_date", "ts")


GAPS = f"""{BARS15}, {CAL}, mis AS (SELECT * FROM exb WHERE ts NOT IN (SELECT ts FROM all_bars)),
isl AS (SELECT *, ts - to_minutes(CAST(15 * row_number() OVER (PARTITION BY session_date ORDER BY ts) AS BIGINT)) AS g FROM mis),
gr AS (SELECT session_date, min(ts) AS start_utc, max(ts) AS end_utc, count(*) * 15 AS minutes, bool_or(hour(ts - INTERVAL 5 HOURS) * 60 + minute(ts) BETWEEN 570 AND 959) AS rth_overlap FROM isl GROUP BY session_date, g)"""


@C.add(f"WITH {GAPS} SELECT {s('session_date')}, {t('start_utc')}, {t('end_utc')}, minutes::BIGINT AS minutes, rth_overlap FROM gr")
def gap_runs(spark, d):
    return ql.runs(ql.missing(_expected(spark), all_bars(spark, d)), 15)


@C.add(f"WITH {GAPS} SELECT {s('session_date')}, {t('start_utc')}, minutes::BIGINT AS minutes, CASE WHEN session_date = DATE '2024-01-02' THEN 'first_research_date' WHEN session_date = DATE '2024-01-17' THEN 'roll_date' WHEN session_date = DATE '2024-01-15' THEN 'early_close' ELSE 'unexplained' END AS classification FROM gr")
def gap_classification(spark, d):
    early = F.col("session_date") == F.lit(date(2024, 1, 15))
    return ql.classified(ql.runs(ql.missing(_expected(spark), all_bars(spark, d)), 15), F.lit(date(2024, 1, 2)), ["2024-01-17"], early).select("session_date", "start_utc", "minutes", "classification")


ROLL_DAYS = ("2024-01-17",)
SPLITS = [("development", date(2024, 1, 1), date(2024, 1, 12)), ("validation", date(2024, 1, 15), date(2024, 1, 24))]


def _records(spark, d):
    """All reasons have a session: contracts change within two, values are invalid on another, events stand twice with other values on two more."""
    own = all_bars(spark, d)
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    symbol = F.when(F.col("ts") < at("2024-01-11 15:00:00"), "XXH4").when(F.col("ts") < at("2024-01-22 15:00:00"), "XXM4").otherwise("XXU4")
    invalid = own.where("session_date = DATE'2024-01-09' AND clock BETWEEN 600 AND 660").select("session_date")
    copies = ql.duplicates(_twice(spark, d), ["event_id"], ["ts", "value", "event_type"]).join(events(spark, d).select("event_id", "ts"), "event_id")
    copies = copies.withColumn("session_date", F.to_date("ts")).where("session_date BETWEEN DATE'2024-01-23' AND DATE'2024-01-25' AND (NOT conflicting OR day(session_date) < 25)")
    sessions = calendar.schedule(spark, FIRST, LAST)
    seen = own.withColumn("symbol", symbol).where("session_date != DATE'2024-01-26'")
    return ql.session_records(calendar.expected_bars(sessions, 15), seen, invalid, ROLL_DAYS, sessions, copies, 15, SPLITS)


REC = f"""{BARS15}, {CAL}, {TWICE}, ob AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-11 15:00:00' THEN 'XXH4' WHEN ts < TIMESTAMP '2024-01-22 15:00:00' THEN 'XXM4' ELSE 'XXU4' END AS symbol FROM all_bars WHERE session_date <> DATE '2024-01-26'),
mis AS (SELECT * FROM exb WHERE ts NOT IN (SELECT ts FROM ob)), unx AS (SELECT * FROM ob WHERE ts NOT IN (SELECT ts FROM exb)),
due AS (SELECT session_date, count(*) AS expected_bars FROM exb GROUP BY 1),
mv AS (SELECT *, symbol <> lag(symbol) OVER (PARTITION BY session_date ORDER BY ts) AS moved FROM ob),
seen AS (SELECT session_date, count(*) AS observed_rows, count(DISTINCT symbol) AS symbol_count, string_agg(DISTINCT symbol, '|' ORDER BY symbol) AS symbols, count(*) FILTER (WHERE moved) AS contract_transitions FROM mv GROUP BY 1),
gone AS (SELECT session_date, count(*) AS missing_bars, count(*) FILTER (WHERE hour(ts - INTERVAL 5 HOURS) * 60 + minute(ts) BETWEEN 570 AND 959) AS missing_rth_bars, min(ts) AS first_missing_utc, max(ts) AS last_missing_utc FROM mis GROUP BY 1),
isl AS (SELECT session_date, ts - to_minutes(CAST(15 * row_number() OVER (PARTITION BY session_date ORDER BY ts) AS BIGINT)) AS g FROM mis), lr AS (SELECT session_date, max(c) * 15 AS largest FROM (SELECT session_date, count(*) AS c FROM isl GROUP BY session_date, g) GROUP BY 1),
ex AS (SELECT session_date, count(DISTINCT ts) AS unexpected_bars FROM unx GROUP BY 1),
inv AS (SELECT session_date, count(*) AS invalid_rows FROM all_bars WHERE session_date = DATE '2024-01-09' AND clock BETWEEN 600 AND 660 GROUP BY 1),
dk AS (SELECT event_id, CAST(min(ts) AS DATE) AS session_date, count(*) AS k, count(DISTINCT value) AS v FROM tw GROUP BY event_id HAVING count(*) > 1),
dup AS (SELECT session_date, sum(CASE WHEN v = 1 THEN k - 1 ELSE 0 END) AS exact_removed, count(*) FILTER (WHERE v > 1) AS conflicting FROM dk WHERE session_date BETWEEN DATE '2024-01-23' AND DATE '2024-01-25' AND (v = 1 OR day(session_date) < 25) GROUP BY 1),
rec0 AS (SELECT session_date, coalesce(expected_bars, 0) AS expected_bars, coalesce(observed_rows, 0) AS observed_rows, coalesce(missing_bars, 0) AS missing_bars, coalesce(missing_rth_bars, 0) AS missing_rth_bars, coalesce(unexpected_bars, 0) AS unexpected_bars, expected_bars IS NOT NULL AS expected_session,
    coalesce(symbol_count, 0) AS symbol_count, symbols, coalesce(contract_transitions, 0) AS contract_transitions, coalesce(invalid_rows, 0) AS invalid_rows, coalesce(exact_removed, 0) AS exact_removed, coalesce(conflicting, 0) AS conflicting, first_missing_utc, last_missing_utc, coalesce(largest, 0) AS largest
  FROM due FULL JOIN seen USING (session_date) LEFT JOIN gone USING (session_date) LEFT JOIN ex USING (session_date) LEFT JOIN inv USING (session_date) LEFT JOIN dup USING (session_date) LEFT JOIN lr USING (session_date)),
rec1 AS (SELECT *, concat_ws('|', CASE WHEN missing_bars > 0 THEN 'missing_expected_minutes' END, CASE WHEN expected_session AND unexpected_bars > 0 THEN 'timestamps_outside_expected_session' END, CASE WHEN NOT expected_session THEN 'observed_noncalendar_session' END,
    CASE WHEN invalid_rows > 0 THEN 'invalid_bar_values' END, CASE WHEN conflicting > 0 THEN 'conflicting_duplicate_bars' END, CASE WHEN symbol_count > 1 OR contract_transitions > 0 THEN 'multiple_contracts_within_session' END, CASE WHEN session_date = DATE '2024-01-17' THEN 'roll_boundary_session' END) AS exclusion_reasons FROM rec0),
rec AS (SELECT *, CASE WHEN exclusion_reasons <> '' THEN 'excluded' WHEN exact_removed > 0 THEN 'corrected' ELSE 'pass' END AS quality_status,
    CASE WHEN (missing_bars > 0 AND missing_bars = expected_bars) OR invalid_rows > 0 OR conflicting > 0 THEN 'critical' WHEN exclusion_reasons <> '' THEN 'high' WHEN exact_removed > 0 THEN 'low' ELSE 'none' END AS severity FROM rec1)"""
RECORD = [
    "session_date", "expected_session", "expected_bars", "observed_rows", "missing_bars", "missing_rth_bars", "unexpected_bars", "invalid_rows", "exact_duplicate_rows_removed", "conflicting_duplicate_keys", "symbol_count",
    "symbols", "contract_transitions", "first_missing_utc", "last_missing_utc", "largest_missing_run_minutes", "exclusion_reasons", "quality_status", "session_usable", "severity", "split", "is_early_close", "calendar_override",
]


@C.add(f"""WITH {REC} SELECT {s('session_date')}, expected_session, expected_bars, observed_rows, missing_bars, missing_rth_bars, unexpected_bars, invalid_rows, exact_removed::BIGINT AS exact_duplicate_rows_removed, conflicting AS conflicting_duplicate_keys, symbol_count, symbols, contract_transitions,
 {t('first_missing_utc')}, {t('last_missing_utc')}, largest::BIGINT AS largest_missing_run_minutes, exclusion_reasons, quality_status, exclusion_reasons = '' AS session_usable, severity,
 CASE WHEN session_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-12' THEN 'development' WHEN session_date BETWEEN DATE '2024-01-15' AND DATE '2024-01-24' THEN 'validation' ELSE 'outside_research' END AS split, session_date = DATE '2024-01-15' AS is_early_close, false AS calendar_override FROM rec""")
def session_quality(spark, d):
    return _records(spark, d).select(*RECORD)


@C.add(f"WITH {REC} SELECT unnest(string_split(exclusion_reasons, '|')) AS reason, count(*) AS sessions FROM rec WHERE exclusion_reasons <> '' GROUP BY 1")
def exclusion_reasons(spark, d):
    return _records(spark, d).where("exclusion_reasons != ''").select(F.explode(F.split("exclusion_reasons", r"\|")).alias("reason")).groupBy("reason").agg(F.count("*").alias("sessions"))


@C.add(f"""WITH {REC} SELECT count(*) AS sessions, count(*) FILTER (WHERE exclusion_reasons = '') AS usable_sessions, count(*) FILTER (WHERE exclusion_reasons <> '') AS excluded_sessions, sum(observed_rows)::BIGINT AS observed_rows, sum(missing_bars)::BIGINT AS missing_bars,
 count(*) FILTER (WHERE severity = 'high') AS high_severity, count(*) FILTER (WHERE severity = 'critical') AS critical_severity FROM rec""")
def quality_summary(spark, d):
    return ql.quality_summary(_records(spark, d))


@C.add("""WITH days AS (SELECT CAST(range AS DATE) AS session_date FROM range(TIMESTAMP '2026-01-01', TIMESTAMP '2027-01-01', INTERVAL 1 DAY)),
early(d, m) AS (VALUES (DATE '2026-01-19', 780), (DATE '2026-02-16', 780), (DATE '2026-04-03', 555), (DATE '2026-05-25', 780), (DATE '2026-06-19', 780), (DATE '2026-07-03', 780), (DATE '2026-09-07', 780), (DATE '2026-11-26', 780), (DATE '2026-11-27', 795), (DATE '2026-12-24', 795)),
c AS (SELECT session_date, coalesce(m, 1020) AS cm FROM days LEFT JOIN early ON d = session_date WHERE isodow(session_date) < 6 AND session_date NOT IN (DATE '2026-01-01', DATE '2026-12-25'))
SELECT session_date::VARCHAR AS session_date, strftime(timezone('UTC', timezone('America/New_York', CAST(session_date AS TIMESTAMP) - INTERVAL 6 HOURS)), '%Y-%m-%d %H:%M:%S') AS open_utc, strftime(timezone('UTC', timezone('America/New_York', CAST(session_date AS TIMESTAMP) + to_minutes(cm))), '%Y-%m-%d %H:%M:%S') AS close_utc,
 (cm + 360)::BIGINT AS expected_minutes, greatest(0, least(cm, 960) - 570)::BIGINT AS expected_rth_minutes, cm <> 1020 AS is_early_close FROM c""")
def calendar_year(spark, d):
    """A year with daylight saving, holidays of the weekend, and early closes."""
    return calendar.schedule(spark, date(2026, 1, 1), date(2026, 12, 31)).select("session_date", "open_utc", "close_utc", "expected_minutes", "expected_rth_minutes", "is_early_close")


@C.add("""WITH e AS (SELECT CAST(ts AS DATE) AS session_date, event_type, ts, event_id, event_type <> lag(event_type) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS mv FROM events),
f AS (SELECT session_date, event_type, min(ts) AS f FROM e GROUP BY ALL), g AS (SELECT session_date, count(*) FILTER (WHERE mv) AS k FROM e GROUP BY 1)
SELECT session_date::VARCHAR AS session_date, string_agg(event_type, '|' ORDER BY f.f) AS symbols, count(*) AS symbol_count, any_value(k) AS contract_transitions FROM f JOIN g USING (session_date) GROUP BY session_date""")
def session_symbols(spark, d):
    return ql.symbols_by_session(events(spark, d, "event_type").withColumn("session_date", F.to_date("ts")), "event_type", "ts", "event_id")


@C.add("""WITH m AS (SELECT CAST(o_orderdate AS DATE) AS d, o_orderpriority AS p FROM orders), t AS (SELECT DISTINCT d FROM m WHERE p = '1-URGENT'), u AS (SELECT DISTINCT d FROM m WHERE p = '5-LOW')
SELECT coalesce(t.d, u.d)::VARCHAR AS day, CASE WHEN u.d IS NULL THEN 'missing' ELSE 'extra' END AS difference FROM t FULL JOIN u ON t.d = u.d WHERE t.d IS NULL OR u.d IS NULL""")
def set_differences(spark, d):
    days = table(spark, d, "orders", ("o_orderdate", "o_orderpriority")).select(F.to_date("o_orderdate").alias("day"), "o_orderpriority")
    return ql.key_differences(days.where("o_orderpriority = '1-URGENT'"), days.where("o_orderpriority = '5-LOW'"), "day")


@C.add("""WITH e AS (SELECT y, m, make_date(y, m, 1) + CAST((12 - isodow(make_date(y, m, 1))) % 7 + 14 AS INT) AS expiry FROM range(1995, 2002) t(y), (VALUES (3), (6), (9), (12)) v(m)),
i AS (SELECT 'XX' || CASE m WHEN 3 THEN 'H' WHEN 6 THEN 'M' WHEN 9 THEN 'U' ELSE 'Z' END || (y % 10) AS symbol, expiry, expiry - 7 AS planned_roll FROM e WHERE expiry - 7 >= DATE '1995-02-01' AND expiry <= DATE '2000-12-31' + 120)
SELECT symbol, expiry::VARCHAR AS expiry, planned_roll::VARCHAR AS planned_roll, lead(symbol) OVER (ORDER BY expiry) AS next_symbol FROM i""")
def contract_inventory(spark, d):
    return _contracts(spark)


def _contracts(spark):
    return rolls.inventory(spark, "XX", date(1995, 2, 1), date(2000, 12, 31))


INV = """ce AS (SELECT y, m, make_date(y, m, 1) + CAST((12 - isodow(make_date(y, m, 1))) % 7 + 14 AS INT) AS expiry FROM range(1995, 2002) t(y), (VALUES (3), (6), (9), (12)) v(m)),
inv AS (SELECT symbol, expiry, expiry - 7 AS planned_roll, lead(symbol) OVER (ORDER BY expiry) AS next_symbol FROM (SELECT 'XX' || CASE m WHEN 3 THEN 'H' WHEN 6 THEN 'M' WHEN 9 THEN 'U' ELSE 'Z' END || (y % 10) AS symbol, expiry FROM ce WHERE expiry - 7 >= DATE '1995-02-01' AND expiry <= DATE '2000-12-31' + 120))"""


@C.add(f"WITH {INV}, w AS (SELECT symbol, next_symbol, expiry - 35 AS a, expiry AS z FROM inv WHERE next_symbol IS NOT NULL) SELECT symbol AS pair, 'front' AS role, symbol AS request_symbol, a::VARCHAR AS first_day, z::VARCHAR AS last_day FROM w UNION ALL SELECT symbol, 'next', next_symbol, a::VARCHAR, z::VARCHAR FROM w")
def roll_windows(spark, d):
    return rolls.roll_windows(_contracts(spark))


CHUNK = f"""{INV}, ck AS (SELECT symbol, expiry - 35 AS first_day, expiry AS last_day, unnest(generate_series(CAST(expiry - 35 AS TIMESTAMP), CAST(expiry AS TIMESTAMP), INTERVAL 7 DAYS))::DATE AS chunk_start FROM inv),
cx AS (SELECT *, least(chunk_start + 6, last_day) AS chunk_end FROM ck), cr AS (SELECT *, substr(sha256(symbol || '|' || chunk_start::VARCHAR || '|' || chunk_end::VARCHAR), 1, 20) AS request_id FROM cx)"""


def _chunks(spark):
    return rolls.chunks(_contracts(spark).select("symbol", F.date_sub("expiry", 35).alias("first_day"), F.col("expiry").alias("last_day")))


@C.add(f"WITH {CHUNK} SELECT symbol, first_day::VARCHAR AS first_day, last_day::VARCHAR AS last_day, chunk_start::VARCHAR AS chunk_start, chunk_end::VARCHAR AS chunk_end, request_id FROM cr")
def request_chunks(spark, d):
    return _chunks(spark)


@C.add(f"WITH {CHUNK} SELECT request_id FROM cr WHERE NOT (symbol LIKE '%H%' OR symbol LIKE '%M%')")
def work_remaining(spark, d):
    done = _chunks(spark).select("request_id", F.when(F.col("symbol").contains("H"), "success").when(F.col("symbol").contains("M"), "cached_verified").otherwise("failed").alias("status"))
    return rolls.remaining(_chunks(spark), done).select("request_id")


def _volumes(spark, d):
    """Daily counts of two priorities as the volumes of the front and the next contract."""
    rows = table(spark, d, "orders", ("o_orderdate", "o_orderpriority")).withColumn("day", F.to_date("o_orderdate"))
    of = lambda p: F.nullif(F.count_if(F.col("o_orderpriority") == p), F.lit(0))
    days = rows.groupBy("day").agg(of("1-URGENT").alias("front_volume"), of("2-HIGH").alias("next_volume"))
    pairs = _contracts(spark).where("next_symbol IS NOT NULL").select(F.col("symbol").alias("pair"), "expiry", "planned_roll")
    windows = F.broadcast(pairs.select("pair", F.date_sub("expiry", 35).alias("a"), F.col("expiry").alias("z")))
    return days.join(windows, F.col("day").between(F.col("a"), F.col("z"))).select("pair", "day", "front_volume", "next_volume"), pairs


DAYS = f"""{INV}, dv AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS f, count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS n FROM orders GROUP BY 1),
pv AS (SELECT symbol AS pair, day, f, n FROM inv JOIN dv ON day BETWEEN expiry - 35 AND expiry WHERE next_symbol IS NOT NULL)"""


@C.add(f"WITH {DAYS} SELECT pair, day::VARCHAR AS day, f AS front_volume, n AS next_volume FROM pv WHERE f > 0 AND n > 0")
def contract_volumes(spark, d):
    return _volumes(spark, d)[0].where("front_volume IS NOT NULL AND next_volume IS NOT NULL")


@C.add(f"""WITH {DAYS}, c AS (SELECT pv.*, n > f AS more FROM pv JOIN inv ON inv.symbol = pair WHERE f > 0 AND n > 0 AND day < expiry),
k AS (SELECT *, more AND lag(more) OVER (PARTITION BY pair ORDER BY day) AS two FROM c), g AS (SELECT pair, min(day) FILTER (WHERE two) AS confirmed FROM k GROUP BY pair)
SELECT symbol AS pair, expiry::VARCHAR AS expiry, planned_roll::VARCHAR AS planned_roll, confirmed::VARCHAR AS confirmed, coalesce(confirmed + CASE isodow(confirmed) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END, planned_roll)::VARCHAR AS roll_day, CASE WHEN confirmed IS NULL THEN 'planned' ELSE 'volume' END AS method FROM inv LEFT JOIN g ON pair = symbol WHERE next_symbol IS NOT NULL""")
def roll_decisions(spark, d):
    return rolls.decisions(*_volumes(spark, d))


@C.add(f"""WITH {BARS15}, c AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-11 15:00:00' THEN 'XXH4' WHEN ts < TIMESTAMP '2024-01-22 02:00:00' THEN 'XXM4' ELSE 'XXU4' END AS symbol FROM bars),
l AS (SELECT *, lag(symbol) OVER w AS ps, lag(close) OVER w AS pc FROM c WINDOW w AS (ORDER BY ts)) SELECT 'XX' AS product, {s('session_date')}, {t('ts')}, ps AS previous_symbol, symbol, {r('open - pc', 'gap')} FROM l WHERE symbol <> ps""")
def roll_boundaries(spark, d):
    from .base import bars

    rows = bars(spark, d).withColumn("product", F.lit("XX"))
    symbol = F.when(F.col("ts") < F.lit("2024-01-11 15:00:00").cast("timestamp_ntz"), "XXH4").when(F.col("ts") < F.lit("2024-01-22 02:00:00").cast("timestamp_ntz"), "XXM4").otherwise("XXU4")
    return rolls.boundaries(rows.withColumn("symbol", symbol))


@C.add("""WITH o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) SELECT d::VARCHAR AS day, (date_trunc('month', d)::DATE + CAST((12 - isodow(date_trunc('month', d)::DATE)) % 7 + 14 AS INT))::VARCHAR AS third_friday,
 (d + CASE isodow(d) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END)::VARCHAR AS next_weekday,
 (SELECT x FROM (SELECT (d - CAST(i AS INT)) AS x, row_number() OVER (ORDER BY i) AS k FROM range(1, 12) t(i) WHERE isodow(d - CAST(i AS INT)) < 6) WHERE k = 3)::VARCHAR AS three_before FROM o""")
def calendar_arithmetic(spark, d):
    days = table(spark, d, "orders", ("o_orderdate",)).select(F.to_date("o_orderdate").alias("day")).distinct()
    day = F.col("day")
    return days.select("day", clock.third_friday(day).alias("third_friday"), clock.next_weekday(day).alias("next_weekday"), clock.business_days_before(day, 3).alias("three_before"))
