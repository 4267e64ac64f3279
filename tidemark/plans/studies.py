"""Event studies and their inference."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.config import INFERENCE
from tidemark.operators import bar_features as bf
from tidemark.operators import events as ev
from tidemark.operators import inference as nf
from tidemark.operators import outcomes as oc
from tidemark.sources.readers import table

from .base import Catalogue, b, bars, r, s
from .market import BARS15, FWD, PRIOR, _outcomes, _sessions

C = Catalogue()
ANCHORS = [60, 300, 600, 960]
HHMM = "lpad((({m} + 1080) // 60 % 24)::VARCHAR, 2, '0') || lpad((({m} + 1080) % 60)::VARCHAR, 2, '0')"
FIXED = f"""{FWD}, fx AS (SELECT 'fixed__' || {HHMM.format(m='clock_minute')} || '_' || {HHMM.format(m='(clock_minute + 120)')} AS hypothesis_id, session_date, clock_minute AS entry_minute, 1 AS direction, return_bps, return_bps AS effect_bps FROM o WHERE scope = 'ETH' AND clock_minute IN (60, 300, 600, 960) AND horizon_minutes = 120)"""


def _fixed(spark, d):
    return ev.fixed_clock(_outcomes(spark, d).where("scope = 'ETH'"), "fixed", ANCHORS, 120, "ETH")


@C.add(f"WITH {FIXED} SELECT hypothesis_id, {s('session_date')}, {b('entry_minute')}, {b('direction')}, {r('return_bps')}, {r('effect_bps')} FROM fx")
def fixed_clock_events(spark, d):
    return _fixed(spark, d)


DIR = f"""{FWD}, sg AS (SELECT session_date, first(open ORDER BY ts) AS a, last(close ORDER BY ts) AS z, count(*) AS n FROM bars WHERE clock < 240 GROUP BY session_date),
dr AS (SELECT 'early__' || horizon_minutes || 'm' AS hypothesis_id, session_date, clock_minute AS entry_minute, CAST(sign(z / a - 1) AS INT) AS direction, return_bps, sign(z / a - 1) * return_bps AS effect_bps FROM o JOIN sg USING (session_date)
 WHERE scope = 'ETH' AND clock_minute = 240 AND horizon_minutes IN (60, 120) AND n = 4 AND abs((z / a - 1) * 1e4) >= 10 AND z <> a)"""


def _directional(spark, d):
    """The direction of a session's first four hours, taken at the fifth."""
    early = bars(spark, d, 60).where("clock < 240").groupBy("session_date").agg(F.min_by("open", "ts").alias("a"), F.max_by("close", "ts").alias("z"), F.count("*").alias("n"))
    signal = early.select("session_date", (F.col("z") / F.col("a") - 1).alias("signal"), (F.col("n") == 4).alias("valid"))
    return ev.directional(_outcomes(spark, d).where("scope = 'ETH'"), signal, "early", 240, [60, 120], 10.0)


@C.add(f"WITH {DIR} SELECT hypothesis_id, {s('session_date')}, {b('entry_minute')}, {b('direction')}, {r('return_bps')}, {r('effect_bps')} FROM dr")
def directional_events(spark, d):
    return _directional(spark, d)


BREAK = f"""{BARS15}, {PRIOR}, rb AS (SELECT * FROM j WHERE is_rth),
bk AS (SELECT session_date, ts, rth_minute, CASE WHEN close > o_high THEN 1 WHEN close < o_low THEN -1 END AS direction, o_high, o_low, lead(open) OVER w AS entry, lead(rth_minute) OVER w AS nx, lead(rth_minute, 4) OVER w AS lst, lead(close, 4) OVER w AS ext, max(high) OVER f AS hi, min(low) OVER f AS lo FROM rb
  WINDOW w AS (PARTITION BY session_date ORDER BY ts), f AS (PARTITION BY session_date ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)),
f1 AS (SELECT *, row_number() OVER (PARTITION BY session_date ORDER BY ts) AS k FROM bk WHERE direction IS NOT NULL AND o_high IS NOT NULL AND o_low IS NOT NULL AND rth_minute BETWEEN 30 AND 240)"""


def _breaks(spark, d):
    own = bf.with_sessions(bars(spark, d).where("is_rth"), _sessions(spark, d))
    return ev.first_break(own, "opening_30_high", "opening_30_low", 15, 60, (30, 240))


@C.add(f"WITH {BREAK} SELECT {s('session_date')}, {b('rth_minute', 'trigger_minute')}, {b('nx', 'entry_minute')}, {b('direction')}, {r('(ext / entry - 1) * 1e4', 'return_bps')}, {r('direction * (ext / entry - 1) * 1e4', 'effect_bps')}, {r('(hi / entry - 1) * 1e4', 'mfe_bps')}, {r('(lo / entry - 1) * 1e4', 'mae_bps')} FROM f1 WHERE k = 1 AND nx = rth_minute + 15 AND lst = rth_minute + 60 AND entry > 0")
def first_range_break(spark, d):
    return _breaks(spark, d)


@C.add(f"WITH {FIXED} SELECT hypothesis_id, year(session_date) AS calendar_year, count(*) AS n, {r('avg(effect_bps)', 'mean_bps')}, {r('quantile_cont(effect_bps, 0.5)', 'median_bps')}, {r('avg((effect_bps > 0)::INT)', 'positive_rate')} FROM fx GROUP BY ALL")
def year_stability(spark, d):
    return ev.year_stability(_fixed(spark, d))


DIFF = "avg(effect_bps) FILTER (WHERE state = 'high') - avg(effect_bps) FILTER (WHERE state = 'low')"


def _activity(spark, d):
    """Quarter-hour bars of regular hours, with the range of the last two as their volatility."""
    return bf.rolling_range(bars(spark, d).where("is_rth"), (2,)).withColumnRenamed("rolling_range_2", "vol")


ACT = f"{BARS15}, av AS (SELECT *, CASE WHEN count(*) OVER w = 2 THEN max(high) OVER w - min(low) OVER w END AS vol FROM bars WHERE is_rth WINDOW w AS (PARTITION BY session_date ORDER BY ts ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))"
LAG = f"{ACT}, lq AS (SELECT *, count(vol) OVER h AS hist, CASE WHEN count(vol) OVER h >= 5 THEN quantile_cont(vol, 0.2) OVER h END AS q_low, CASE WHEN count(vol) OVER h >= 5 THEN quantile_cont(vol, 0.8) OVER h END AS q_high FROM av WINDOW h AS (PARTITION BY rth_minute ORDER BY session_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))"


@C.add(f"WITH {LAG} SELECT {s('session_date')}, {b('rth_minute')}, {r('vol')}, {b('hist', 'vol_history')}, {r('q_low')}, {r('q_high')} FROM lq")
def lagged_quantile(spark, d):
    return ev.lagged_quantiles(_activity(spark, d), "vol", "rth_minute", {"q_low": 0.2, "q_high": 0.8}, 10, 5).select("session_date", "rth_minute", "vol", "vol_history", "q_low", "q_high")


def _states(spark, d, horizon=30):
    return ev.volatility_states(_activity(spark, d), "vol", 15, list(range(60, 331, 30)), horizon, history=10, least=5)


STATE = f"""{ACT}, tg AS (SELECT *, rth_minute + 15 AS entry_minute FROM av WHERE (rth_minute + 15) IN ({', '.join(map(str, range(60, 331, 30)))})),
tq AS (SELECT *, CASE WHEN count(vol) OVER h >= 5 THEN quantile_cont(vol, 0.2) OVER h END AS q_low, CASE WHEN count(vol) OVER h >= 5 THEN quantile_cont(vol, 0.8) OVER h END AS q_high FROM tg WINDOW h AS (PARTITION BY rth_minute ORDER BY session_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
fw AS (SELECT session_date, rth_minute AS e, open, count(*) OVER g AS n, max(high) OVER g AS hi, min(low) OVER g AS lo FROM av WINDOW g AS (PARTITION BY session_date ORDER BY rth_minute RANGE BETWEEN CURRENT ROW AND 15 FOLLOWING)),
st AS (SELECT tq.session_date, entry_minute, CASE WHEN vol <= q_low THEN 'low' WHEN vol >= q_high THEN 'high' END AS state, vol AS value, q_low, q_high, (hi - lo) / fw.open * 1e4 AS effect_bps FROM tq JOIN fw ON fw.session_date = tq.session_date AND e = entry_minute WHERE n = 2 AND lo > 0 AND (vol <= q_low OR vol >= q_high))"""


@C.add(f"WITH {STATE} SELECT {s('session_date')}, {b('entry_minute')}, state, {r('value')}, {r('q_low')}, {r('q_high')}, {r('effect_bps')} FROM st")
def volatility_states(spark, d):
    return _states(spark, d)


@C.add(f"WITH {STATE} SELECT state, count(*) AS n, count(DISTINCT session_date) AS sessions, {r('avg(effect_bps)', 'mean_bps')}, {r('quantile_cont(effect_bps, 0.5)', 'median_bps')} FROM st GROUP BY state")
def range_by_state(spark, d):
    return ev.state_ranges(_states(spark, d))


@C.add(f"WITH {STATE} SELECT {b('entry_minute')}, count(*) FILTER (WHERE state = 'high') AS n_high, count(*) FILTER (WHERE state = 'low') AS n_low, {r(DIFF, 'difference_bps')} FROM st GROUP BY entry_minute")
def state_contrast(spark, d):
    return ev.state_contrast(_states(spark, d), ["entry_minute"])


PRESS = f"""{BARS15}, pz AS (SELECT *, CASE WHEN count(*) OVER w = 3 THEN sum(up_volume + down_volume) OVER w END AS activity, CASE WHEN count(*) OVER w = 3 THEN sum(up_volume - down_volume) OVER w END AS net FROM bars WHERE is_rth WINDOW w AS (PARTITION BY session_date ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
pp AS (SELECT *, CASE WHEN activity > 0 THEN net::DOUBLE / activity END AS pressure FROM pz)"""


@C.add(f"WITH {PRESS} SELECT {s('session_date')}, {b('rth_minute')}, {r('activity')}, {r('pressure')} FROM pp")
def pressure_trailing(spark, d):
    return ev.pressure(bars(spark, d).where("is_rth"), 3).select("session_date", "rth_minute", F.col("activity").cast("double").alias("activity"), "pressure")


BURST = f"""{PRESS}, pf AS (SELECT *, count(*) OVER g AS n, last(close) OVER g AS lc, min(low) OVER g AS ml FROM pp WINDOW g AS (PARTITION BY session_date ORDER BY rth_minute RANGE BETWEEN CURRENT ROW AND 15 FOLLOWING)),
pe AS (SELECT *, CASE WHEN n = 2 AND ml > 0 THEN (lc / open - 1) * 1e4 END AS fr FROM pf), pn AS (SELECT *, lead(rth_minute) OVER w AS nx, lead(fr) OVER w AS fwd FROM pe WINDOW w AS (PARTITION BY session_date ORDER BY ts)),
pq AS (SELECT *, CASE WHEN count(pressure) OVER h >= 5 THEN quantile_cont(abs(pressure), 0.6) OVER h END AS q_pressure, CASE WHEN count(activity) OVER h >= 5 THEN quantile_cont(activity::DOUBLE, 0.3) OVER h END AS q_activity FROM pn WHERE rth_minute BETWEEN 30 AND 330 WINDOW h AS (PARTITION BY rth_minute ORDER BY session_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
p1 AS (SELECT *, row_number() OVER (PARTITION BY session_date ORDER BY ts) AS k FROM pq WHERE abs(pressure) >= q_pressure AND activity >= q_activity AND pressure <> 0)"""


def _bursts(spark, d):
    return ev.first_bursts(bars(spark, d).where("is_rth"), 15, 30, (30, 330), 3, history=10, least=5, pressure_q=0.6, activity_q=0.3)


@C.add(f"WITH {BURST} SELECT {s('session_date')}, {b('rth_minute', 'trigger_minute')}, {b('nx', 'entry_minute')}, {b('sign(pressure)', 'direction')}, {r('pressure')}, {r('q_pressure')}, {r('activity')}, {r('q_activity')}, {r('fwd', 'return_bps')}, {r('sign(pressure) * fwd', 'effect_bps')} FROM p1 WHERE k = 1 AND nx = rth_minute + 15 AND fwd IS NOT NULL")
def first_pressure_burst(spark, d):
    return _bursts(spark, d).withColumn("activity", F.col("activity").cast("double"))


#: The registered tests: 13, 2, 2 and 4 of the first wave, 2 and 2 of the second. Fixed values.
FAMILIES = [
    {"family": "rth_fixed_clock_30m", "kind": "fixed_clock", "anchors": list(range(0, 361, 30)), "horizons": [30]},
    {"family": "overnight_gap_response", "kind": "directional", "anchor": 0, "horizons": [30, 60], "threshold": 10.0},
    {"family": "opening_30_response", "kind": "directional", "anchor": 30, "horizons": [30, 60], "threshold": 10.0},
    {"family": "reference_level_break_response", "kind": "range_break", "references": ["prior_rth_range", "overnight_range"], "horizons": [15, 30]},
]
FAMILIES_V2 = [
    {"family": "volatility_state_transition", "kind": "volatility_state", "horizons": [15, 30]}, {"family": "signed_pressure_burst", "kind": "pressure", "horizons": [5, 15]},
]


@C.add("""WITH c AS (SELECT range AS m FROM range(0, 361, 30)), l AS (SELECT m, lpad(((m + 570) // 60)::VARCHAR, 2, '0') || lpad(((m + 570) % 60)::VARCHAR, 2, '0') AS a, lpad(((m + 600) // 60)::VARCHAR, 2, '0') || lpad(((m + 600) % 60)::VARCHAR, 2, '0') AS z FROM c),
x AS (SELECT 'rth_fixed_clock_30m' AS family_id, 'rth_fixed_clock_30m__' || a || '_' || z AS hypothesis_id, 'sign_flip' AS "null", 30 AS horizon, a[1:2] || ':' || a[3:4] AS entry_label FROM l
 UNION ALL SELECT f, f || '__' || h || 'm', 'direction', h, e FROM (VALUES ('overnight_gap_response', '09:30'), ('opening_30_response', '10:00')) f(f, e), (VALUES (30), (60)) h(h)
 UNION ALL SELECT 'reference_level_break_response', 'reference_level_break_response__' || r || '__' || h || 'm', 'direction', h, NULL FROM (VALUES ('prior_rth_range'), ('overnight_range')) r(r), (VALUES (15), (30)) h(h)
 UNION ALL SELECT 'volatility_state_transition', 'volatility_state_transition__' || h || 'm', 'state', h, NULL FROM (VALUES (15), (30)) h(h)
 UNION ALL SELECT 'signed_pressure_burst', 'signed_pressure_burst__' || h || 'm', 'direction', h, NULL FROM (VALUES (5), (15)) h(h))
SELECT hypothesis_id, family_id, "null", horizon::BIGINT AS horizon, entry_label FROM x""")
def hypothesis_registry(spark, d):
    got = ev.labels(ev.hypotheses(spark, FAMILIES + FAMILIES_V2))
    return got.select("hypothesis_id", "family_id", "null", "horizon", "entry_label")


def _tests(spark, d):
    """A deterministic stand-in for p values: each nation's share of large balances."""
    c = table(spark, d, "customer", ("c_nationkey", "c_acctbal")).groupBy("c_nationkey").agg(F.avg((F.col("c_acctbal") > 9000).cast("double")).alias("p0"))
    got = c.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return got.select(F.col("n_name").alias("hypothesis_id"), F.col("n_regionkey").cast("string").alias("family_id"), F.when(F.col("n_nationkey") % 7 == 3, None).otherwise(F.col("p0") * F.col("p0")).alias("p_value"))


TESTS = "ts0 AS (SELECT n_name AS hypothesis_id, n_regionkey::VARCHAR AS family_id, CASE WHEN n_nationkey % 7 = 3 THEN NULL ELSE avg((c_acctbal > 9000)::INT) * avg((c_acctbal > 9000)::INT) END AS p_value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, n_regionkey, n_nationkey)"


def _bh_sql(part: str) -> str:
    return f"""bh0 AS (SELECT *, p_value * count(p_value) OVER ({part}) / row_number() OVER ({part} ORDER BY p_value NULLS LAST, hypothesis_id) AS raw FROM ts0),
bh AS (SELECT *, CASE WHEN p_value IS NOT NULL THEN least(1.0, min(raw) OVER ({part} ORDER BY p_value NULLS LAST, hypothesis_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS q_value FROM bh0)"""


@C.add(f"WITH {TESTS}, {_bh_sql('PARTITION BY family_id')} SELECT hypothesis_id, family_id, {r('p_value')}, {r('q_value')}, coalesce(q_value <= 0.05, false) AS bh_reject FROM bh")
def bh_adjust(spark, d):
    return nf.benjamini_hochberg(_tests(spark, d), family=["family_id"])


@C.add(f"WITH {TESTS}, {_bh_sql('')} SELECT hypothesis_id, family_id, {r('p_value')}, {r('q_value')}, coalesce(q_value <= 0.05, false) AS bh_reject FROM bh")
def bh_cumulative(spark, d):
    return nf.benjamini_hochberg(_tests(spark, d))


@C.add(f"WITH {TESTS}, {_bh_sql('PARTITION BY family_id')} SELECT hypothesis_id, {r('q_value')}, row_number() OVER (ORDER BY q_value NULLS LAST, p_value NULLS LAST, hypothesis_id) AS place FROM bh")
def ledger_rank(spark, d):
    return nf.ranked(nf.benjamini_hochberg(_tests(spark, d), family=["family_id"])).select("hypothesis_id", "q_value", "place")


@C.add(f"WITH {TESTS}, {_bh_sql('PARTITION BY family_id')} SELECT family_id, count(*) AS tests, count(*) FILTER (WHERE q_value <= 0.05) AS rejected, {r('min(p_value)', 'min_p')}, {r('min(q_value)', 'min_q')} FROM bh GROUP BY family_id")
def family_summary(spark, d):
    return ev.family_summary(nf.benjamini_hochberg(_tests(spark, d), family=["family_id"]).withColumn("n", F.lit(1))).drop("min_n", "max_n")


#: For the given tables, which hold a month: fewer replicates, events and sessions than the defaults ask for.
SMALL = replace(INFERENCE, replicates=1000, min_sample=10, history=10, min_history=5)


def _results(spark, d):
    """Deterministic results of both waves: counts and intervals out of the customers of each nation."""
    p = F.when(F.col("n_nationkey") % 7 == 3, None).otherwise(F.col("share") * F.col("share") / 4)
    c = table(spark, d, "customer", ("c_nationkey", "c_acctbal")).groupBy("c_nationkey")
    c = c.agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("m"), F.avg((F.col("c_acctbal") > 9000).cast("double")).alias("share"))
    c = c.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    way = F.when(F.col("n_nationkey") % 3 == 0, -1).otherwise(1)
    wide = F.when(F.col("n_nationkey") % 5 == 4, F.lit(1e6)).otherwise(F.lit(1.0))
    return c.select(
        F.col("n_name").alias("hypothesis_id"), F.col("n_regionkey").cast("string").alias("family_id"), F.when(F.col("n_nationkey") % 2 == 0, "sign_flip").otherwise("direction").alias("null"),
        F.col("n"), (F.col("n") - 1).alias("clusters"), F.lit(1).cast("long").alias("years"), (way * F.col("m")).alias("mean_bps"), (way * F.col("m") - wide).alias("boot_low"), (way * F.col("m") + wide).alias("boot_high"),
        p.alias("sign_flip_p"), (p / 2).alias("direction_p"),
    )


RESULTS = """rs AS (
  SELECT n_name AS hypothesis_id, n_regionkey::VARCHAR AS family_id, count(*) AS n, count(*) - 1 AS clusters, CASE WHEN n_nationkey % 3 = 0 THEN -1 ELSE 1 END * avg(c_acctbal) AS mean_bps,
    CASE WHEN n_nationkey % 5 = 4 THEN 1e6 ELSE 1.0 END AS wide,
    CASE WHEN n_nationkey % 7 = 3 THEN NULL ELSE avg((c_acctbal > 9000)::INT) * avg((c_acctbal > 9000)::INT) / 4 / CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 2 END END AS p_value, n_nationkey
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, n_regionkey, n_nationkey),
"""


def _q_sql(source: str, out: str, part: str = "", value: str = "p_value") -> str:
    """q values by the step-up rule: for each test the least of p * m / rank over it and all greater ones."""
    return f"""{out}_r AS (SELECT *, {value} * count({value}) OVER ({part}) / row_number() OVER ({part} ORDER BY {value} NULLS LAST, hypothesis_id) AS {out}_raw FROM {source}),
{out} AS (SELECT *, CASE WHEN {value} IS NOT NULL THEN least(1.0, min({out}_raw) OVER ({part} ORDER BY {value} NULLS LAST, hypothesis_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS {out}_q FROM {out}_r)"""


DECIDED = "CASE WHEN NOT enough THEN 'insufficient_sample' WHEN advances THEN 'advances_to_phase7' ELSE 'does_not_advance' END AS result"


@C.add(f"""WITH {RESULTS}{_q_sql('rs', 'fam', 'PARTITION BY family_id')}, e AS (SELECT *, n >= 60 AS enough, coalesce(fam_q <= 0.05, false) AND n >= 60 AS bh_reject, (mean_bps - wide > 0 OR mean_bps + wide < 0) AND n >= 60 AS ci_excludes_zero FROM fam),
a AS (SELECT *, bh_reject AND ci_excludes_zero AS advances FROM e)
SELECT hypothesis_id, {r('p_value')}, {r('fam_q', 'q_value')}, enough AS sample_sufficient, bh_reject, ci_excludes_zero, advances, {DECIDED} FROM a""")
def ledger_decisions(spark, d):
    own = _results(spark, d)
    got = nf.ledger(own.select("hypothesis_id", "family_id", "null"), own.drop("family_id", "null"), replace(SMALL, min_sample=60))
    return got.select("hypothesis_id", "p_value", "q_value", "sample_sufficient", "bh_reject", "ci_excludes_zero", "advances", "result")


@C.add(f"""WITH {RESULTS}v2 AS (SELECT 'v2_' || hypothesis_id AS hypothesis_id, family_id, n, clusters, mean_bps, wide, n_nationkey % 2 = 0 AS arms, n // 2 AS n_high, n - n // 2 AS n_low, CASE WHEN n_nationkey % 7 = 3 THEN NULL ELSE p_value / 3 END AS p_value FROM rs),
{_q_sql('v2', 'fam', 'PARTITION BY family_id')}, both_w AS (SELECT hypothesis_id, p_value FROM rs UNION ALL SELECT hypothesis_id, p_value FROM v2), {_q_sql('both_w', 'cum')},
e AS (SELECT fam.*, cum_q, n >= 20 AND clusters >= 20 AND (NOT arms OR (n_high >= 20 AND n_low >= 20)) AS enough FROM fam JOIN cum USING (hypothesis_id)),
g AS (SELECT *, coalesce(fam_q <= 0.05, false) AND enough AS bh_reject, coalesce(cum_q <= 0.05, false) AND enough AS cumulative_reject, (mean_bps - wide > 0 OR mean_bps + wide < 0) AND enough AS ci_excludes_zero FROM e),
a AS (SELECT *, bh_reject AND cumulative_reject AND ci_excludes_zero AS advances FROM g)
SELECT hypothesis_id, {r('fam_q', 'q_value')}, {r('cum_q', 'cumulative_q')}, enough AS sample_sufficient, bh_reject, cumulative_reject, ci_excludes_zero, advances, {DECIDED} FROM a""")
def ledger_decisions_v2(spark, d):
    own = _results(spark, d).withColumn("p_value", nf.p_by_null())
    wave = own.withColumn("hypothesis_id", F.concat(F.lit("v2_"), "hypothesis_id")).withColumn("p_value", F.col("p_value") / 3)
    arms = wave.where(F.col("null") == "sign_flip").withColumns({"n_high": F.floor(F.col("n") / 2).cast("long"), "difference_bps": F.col("mean_bps")}).withColumn("n_low", F.col("n") - F.col("n_high"))
    one = wave.where(F.col("null") == "direction").withColumn("direction_p", F.col("p_value"))
    got = nf.ledger_v2(wave.select("hypothesis_id", "family_id"), arms, one, own, replace(SMALL, min_sample=20))
    return got.select("hypothesis_id", "q_value", "cumulative_q", "sample_sufficient", "bh_reject", "cumulative_reject", "ci_excludes_zero", "advances", "result")


EVENT = ["hypothesis_id", "session_date", "entry_minute", "direction", "return_bps", "effect_bps"]


def _all_events(spark, d):
    """The events of the 21 tests of the first wave, on quarter-hour bars of regular hours."""
    own = bars(spark, d)
    rth = own.where("is_rth")
    ahead = oc.forward(rth, (30, 60), 15, 30, "rth_minute")
    night = own.where("rth_minute < 0").groupBy("session_date").agg(F.max("high").alias("overnight_high"), F.min("low").alias("overnight_low"), F.count("*").alias("night_bars"))
    opening = rth.where("rth_minute < 30").groupBy("session_date").agg(F.min_by("open", "ts").alias("rth_open"), F.max_by("close", "ts").alias("close_30"), F.count("*").alias("bars_30"))
    day = _sessions(spark, d).join(night, "session_date", "left").join(opening, "session_date", "left")
    gap = day.select("session_date", (F.col("rth_open") / F.col("prior_rth_close") - 1).alias("signal"), F.col("prior_valid").alias("valid"))
    first = day.select("session_date", (F.col("close_30") / F.col("rth_open") - 1).alias("signal"), (F.col("bars_30") == 2).alias("valid"))
    found = [
        ev.fixed_clock(ahead, "rth_fixed_clock_30m", FAMILIES[0]["anchors"], 30), ev.directional(ahead, gap, "overnight_gap_response", 0, [30, 60], 10.0),
        ev.directional(ahead, first, "opening_30_response", 30, [30, 60], 10.0),
    ]
    levels = bf.with_sessions(rth, day.select("session_date", "prior_rth_high", "prior_rth_low", "overnight_high", "overnight_low"))
    for name, upper, lower in (("prior_rth_range", "prior_rth_high", "prior_rth_low"), ("overnight_range", "overnight_high", "overnight_low")):
        for h in (15, 30):
            broken = ev.first_break(levels, upper, lower, 15, h, (0, 240))
            found.append(broken.withColumn("hypothesis_id", F.lit(f"reference_level_break_response__{name}__{h}m")))
    return ev.union([x.select(*EVENT) for x in found])


@C.add()
def resampled_tests(spark, d):
    """Bootstrap intervals, sign flips and permuted directions: seeded draws, which SQL has not."""
    return nf.resampled(_all_events(spark, d), SMALL)


@C.add()
def v1_ledger(spark, d):
    return nf.ledger(ev.hypotheses(spark, FAMILIES), nf.resampled(_all_events(spark, d), SMALL), SMALL)


def _contrasts(spark, d):
    every = [_states(spark, d, h).withColumn("hypothesis_id", F.lit(f"volatility_state_transition__{h}m")) for h in (15, 30)]
    return nf.contrasted(ev.union(every), SMALL)


def _responses(spark, d):
    """The first bursts of five-minute bars and what follows them."""
    rth = bars(spark, d, 5).where("is_rth")
    every = [ev.first_bursts(rth, 5, h, (30, 330), 1, history=10, least=5).withColumn("hypothesis_id", F.lit(f"signed_pressure_burst__{h}m")) for h in (5, 15)]
    return nf.resampled(ev.union([x.select(*EVENT) for x in every]), SMALL, SMALL.seed_v2)


@C.add()
def cluster_contrast(spark, d):
    return _contrasts(spark, d)


@C.add(f"""WITH {STATE}, o AS (SELECT 'volatility_state_transition__30m' AS hypothesis_id, * FROM st)
SELECT hypothesis_id, count(DISTINCT session_date) AS clusters, count(*) FILTER (WHERE state = 'high') AS n_high, count(*) FILTER (WHERE state = 'low') AS n_low, {r(DIFF, 'difference_bps')} FROM o GROUP BY hypothesis_id""")
def observed_contrast(spark, d):
    """What `cluster_contrast` observes, without its draws."""
    own = _states(spark, d).withColumn("hypothesis_id", F.lit("volatility_state_transition__30m"))
    return nf.contrasted(own, SMALL).select("hypothesis_id", "clusters", "n_high", "n_low", "difference_bps")


@C.add()
def v2_ledger(spark, d):
    before = nf.ledger(ev.hypotheses(spark, FAMILIES), nf.resampled(_all_events(spark, d), SMALL), SMALL)
    return nf.ledger_v2(ev.hypotheses(spark, FAMILIES_V2), _contrasts(spark, d), _responses(spark, d), before, SMALL)
