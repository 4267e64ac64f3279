from __future__ import annotations

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import WINDOWS
from tidemark.functions import clock
from tidemark.operators import bar_features as bf
from tidemark.operators import catalog, events, outcomes, quality, rolls
from tidemark.operators import inference as nf
from tidemark.operators import session_features as sf
from tidemark.sources import adapters, calendar
from tidemark.sources.readers import guarded

from .conftest import rows

OPEN = datetime(2024, 1, 8, 14, 30)  # 09:30 in New York


def bars(spark, prices, start=OPEN, skip=(), day=0):
    """One-minute bars whose open and close are the given price and the next one's."""
    out = []
    for i, p in enumerate(prices):
        if i in skip:
            continue
        nxt = prices[i + 1] if i + 1 < len(prices) else p
        out.append((start + timedelta(days=day, minutes=i), float(p), float(max(p, nxt) + 1), float(min(p, nxt) - 1), float(nxt), 10 + i, 5, 15 + i))
    df = spark.createDataFrame(out, "ts timestamp_ntz, open double, high double, low double, close double, up_volume long, down_volume long, total_volume long")
    return adapters.labelled(df)


def test_forward_outcome_by_hand(spark):
    got = outcomes.forward(bars(spark, [100, 101, 102, 103, 104, 105]), (5,), 1, None, "rth_minute").orderBy("clock_minute").collect()
    assert len(got) == 2
    assert (got[0]["return_points"], got[0]["mfe_points"], got[0]["mae_points"]) == (5.0, 6.0, -1.0)


def test_forward_window_over_a_gap_is_dropped(spark):
    got = outcomes.forward(bars(spark, list(range(100, 110)), skip=(4,)), (5,), 1, None, "rth_minute")
    assert [r["clock_minute"] for r in got.orderBy("clock_minute").collect()] == [5]


def test_contiguous_forward_needs_every_minute(spark):
    got = events.contiguous_forward(bars(spark, list(range(100, 110)), skip=(4,)), 1, 3).where("fwd_return_bps IS NOT NULL")
    assert [r["rth_minute"] for r in got.orderBy("ts").collect()] == [0, 1, 5, 6, 7]


def test_prior_session_is_not_skipped(spark):
    days = spark.createDataFrame([(date(2024, 1, d), 1.0 * d, 2.0 * d, 0.5 * d, 1.5 * d, d, True, d != 3) for d in (2, 3, 4, 5)], "session_date date, open double, high double, low double, close double, volume int, expected boolean, usable boolean")
    got = {r["session_date"].day: r["prior_close"] for r in sf.prior_session(days).collect()}
    assert got == {2: None, 3: 3.0, 4: None, 5: 6.0}


def test_volatility_begins_at_the_nth_bar(spark):
    own = bf.rolling_range(bf.realized_vol(bf.returns(bars(spark, [100, 101, 99, 102, 103, 101]), (1,)), (3,)), (3,)).orderBy("ts").collect()
    assert [r["realized_vol_3"] is None for r in own] == [True, True, True, False, False, False]
    assert [r["rolling_range_3"] is None for r in own] == [True, True, False, False, False, False]
    closes = np.array([101, 99, 102, 103, 101, 101.0])
    assert own[3]["realized_vol_3"] == pytest.approx(np.std(np.diff(np.log(closes[:4])), ddof=1))


def test_features_do_not_see_the_future(spark):
    a = bf.so_far(bf.rolling_range(bf.realized_vol(bf.returns(bars(spark, [100, 101, 99, 102, 103, 101, 90, 80]), (1, 2)), (3,)), (3,))).orderBy("ts").limit(5)
    z = bf.so_far(bf.rolling_range(bf.realized_vol(bf.returns(bars(spark, [100, 101, 99, 102, 103, 101, 120, 130]), (1, 2)), (3,)), (3,))).orderBy("ts").limit(5)
    assert rows(a) == rows(z)


def test_lagged_quantile_against_numpy_and_perturbation(spark):
    rng = np.random.default_rng(1)
    x = [None if i % 11 == 5 else float(v) for i, v in enumerate(rng.normal(size=80))]
    frame = lambda v: spark.createDataFrame([(date(2024, 1, 1) + timedelta(i), 7, y) for i, y in enumerate(v)], "session_date date, m int, v double")
    got = events.lagged_quantiles(frame(x), "v", "m", {"q": 0.2}, 60, 40).orderBy("session_date").collect()
    for i, r in enumerate(got):
        history = [y for y in x[max(0, i - 60) : i] if y is not None]
        assert r["v_history"] == len(history)
        assert (r["q"] is None) == (len(history) < 40)
        if r["q"] is not None:
            assert r["q"] == pytest.approx(np.quantile(history, 0.2), abs=1e-12)
    later = events.lagged_quantiles(frame(x[:60] + [99.0] * 20), "v", "m", {"q": 0.2}, 60, 40).orderBy("session_date").collect()
    assert [r["q"] for r in got[:61]] == [r["q"] for r in later[:61]]


def test_first_break_enters_on_the_next_bar(spark):
    df = bars(spark, [100, 100, 100, 105, 106, 107, 108, 109]).withColumns({"hi": F.lit(102.0), "lo": F.lit(98.0)})
    got = events.first_break(df, "hi", "lo", 1, 3, (0, 100)).collect()
    assert [(r["trigger_minute"], r["entry_minute"], r["direction"]) for r in got] == [(2, 3, 1)]
    assert got[0]["return_bps"] == pytest.approx((108 / 105 - 1) * 1e4)


def test_first_break_is_not_searched_again(spark):
    df = bars(spark, [100, 100, 100, 105, 106, 107, 108, 109], skip=(3,)).withColumns({"hi": F.lit(102.0), "lo": F.lit(98.0)})
    assert events.first_break(df, "hi", "lo", 1, 3, (0, 100)).count() == 0
    unknown = df.withColumn("hi", F.when(F.col("rth_minute") > 3, F.col("hi")))
    assert [r["trigger_minute"] for r in events.first_break(unknown, "hi", "lo", 1, 2, (0, 100)).collect()] == [4]


def test_extremes_are_the_first(spark):
    got = outcomes.extremes(bars(spark, [100, 104, 100, 104, 96, 96]), "rth_minute").first()
    assert (got["high_minute"], got["low_minute"], got["high_first"]) == (0, 3, True)
    bins = outcomes.turning_bins(outcomes.extremes(bars(spark, [100, 104, 100, 104, 96, 96]), "rth_minute"), 2, 6).where("extreme = 'high'")
    assert bins.agg(F.sum("share")).first()[0] == 1.0 and bins.count() == 3


def test_agreement_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", -1.0), ("c", 0.0), ("unavailable", 5.0)], "cut_value string, mean_bps double").withColumns({"scope": F.lit("ETH"), "cut_type": F.lit("x")})
    got = outcomes.agreement(df, ["scope"]).first()
    assert (got["majority_sign"], got["groups"]) == ("tie", 3) and got["majority_share"] == pytest.approx(1 / 3)


def test_benjamini_hochberg_golden(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.20), ("e", None)], "hypothesis_id string, p_value double")
    got = {r["hypothesis_id"]: (r["q_value"], r["bh_reject"]) for r in nf.benjamini_hochberg(df).collect()}
    want = {"a": 0.04, "b": 0.04 * 4 / 3, "c": 0.04 * 4 / 3, "d": 0.2}
    assert all(got[k][0] == pytest.approx(v) for k, v in want.items()) and got["e"] == (None, False)
    assert [got[k][1] for k in "abcd"] == [True, False, False, False]
    with pytest.raises(Exception, match="from 0 to 1"):
        nf.benjamini_hochberg(spark.createDataFrame([("a", 1.5)], "hypothesis_id string, p_value double")).collect()


def test_resampling_is_seeded_and_right():
    x = np.random.default_rng(3).normal(0.5, 1, 200)
    a = nf.bootstrap_interval(x, 0.95, 2000, 7)
    assert a == nf.bootstrap_interval(x, 0.95, 2000, 7) and a[0] < x.mean() < a[1]
    se = x.std(ddof=1) / np.sqrt(200)
    assert a[0] == pytest.approx(x.mean() - 1.96 * se, abs=0.03)
    assert nf.sign_flip_p(x, 2000, 1) < 0.01 and nf.sign_flip_p(x - x.mean(), 2000, 1) > 0.9
    assert nf.p_value(5, np.zeros(99)) == 0.01
    r, d = np.array([1.0, 2, -1, -2] * 20), np.array([1, 1, -1, -1] * 20)
    assert nf.direction_p(r, d, 999, 1) == 0.001
    assert nf.stratified_p(np.arange(40.0), np.arange(40) % 2 == 0, np.arange(40) // 2, 999, 1) < 0.01
    assert nf.bootstrap_interval(np.array([1.0]), 0.95, 10, 1) == (None, None)


def test_cluster_difference_from_sums():
    rng = np.random.default_rng(5)
    n = rng.integers(1, 4, (60, 2)).astype(float)
    s = np.column_stack((n[:, 0] * 2, n[:, 1] * 1.0)) + rng.normal(0, 0.1, (60, 2))
    observed, low, high = nf.cluster_difference(s, n, 0.95, 2000, 9)
    assert observed == pytest.approx(s[:, 0].sum() / n[:, 0].sum() - s[:, 1].sum() / n[:, 1].sum()) and low < observed < high


def test_resampled_does_not_depend_on_layout(spark):
    data = [(f"h{i % 2}", date(2024, 1, 1) + timedelta(i), 5, 1 if i % 3 else -1, float(i % 7) - 3, float(i % 5) - 2) for i in range(60)]
    df = spark.createDataFrame(data, "hypothesis_id string, session_date date, entry_minute int, direction int, return_bps double, effect_bps double")
    small = nf.Inference(replicates=200)
    assert rows(nf.resampled(df, small)) == rows(nf.resampled(df.repartition(7), small)) == rows(nf.resampled(df.orderBy(F.col("session_date").desc()), small))


def test_hypotheses(spark):
    from tidemark.plans import studies

    got = [r["hypothesis_id"] for r in events.hypotheses(spark, studies.FAMILIES).collect()]
    assert len(got) == 21 == len(set(got)) and {"rth_fixed_clock_30m__0930_1000", "rth_fixed_clock_30m__1530_1600", "reference_level_break_response__overnight_range__15m"} <= set(got)
    assert events.hypotheses(spark, studies.FAMILIES_V2).count() == 4
    with pytest.raises(ValueError):
        events.hypotheses(spark, [studies.FAMILIES[1]] * 2)


RESULT = "hypothesis_id string, n long, clusters long, years long, mean_bps double, boot_low double, boot_high double, sign_flip_p double, direction_p double"


def test_ledger_keeps_insufficient_tests(spark):
    tests = events.hypotheses(spark, [{"family": "f", "kind": "fixed_clock", "anchors": [0, 30, 60, 90], "horizons": [30]}, {"family": "g", "kind": "directional", "horizons": [30]}])
    res = [("f__0930_1000", 200, 90, 1, 1.0, 0.5, 1.5, 0.001, 0.9), ("f__1000_1030", 10, 9, 1, 1.0, 0.5, 1.5, 0.001, 0.9), ("f__1030_1100", 200, 90, 1, -1.0, -1.5, -0.5, 0.001, 0.9), ("g__30m", 200, 90, 1, 1.0, -0.5, 1.5, 0.9, 0.001)]
    got = {r["hypothesis_id"]: r for r in nf.ledger(tests, spark.createDataFrame(res, RESULT)).collect()}
    assert len(got) == 5 and got["f__0930_1000"]["advances"] and got["f__0930_1000"]["q_value"] == pytest.approx(0.001)
    assert got["f__1030_1100"]["result"] == "advances_to_phase7"  # wholly below zero
    assert got["f__1000_1030"]["result"] == "insufficient_sample" and not got["f__1000_1030"]["bh_reject"] and got["f__1100_1130"]["q_value"] is None
    assert got["g__30m"]["p_value"] == 0.001 and got["g__30m"]["bh_reject"] and got["g__30m"]["result"] == "does_not_advance"


def test_second_wave(spark):
    small = nf.Inference(min_sample=20)
    tests = events.hypotheses(spark, [{"family": "v", "kind": "volatility_state", "horizons": [15, 30]}, {"family": "p", "kind": "pressure", "horizons": [5, 15]}])
    arms = spark.createDataFrame([("v__15m", 40, 25, 25, 2.0, 1.0, 3.0, 0.001), ("v__30m", 40, 45, 5, 2.0, 1.0, 3.0, 0.001)], "hypothesis_id string, clusters long, n_high long, n_low long, difference_bps double, boot_low double, boot_high double, p_value double")
    one = spark.createDataFrame([("p__5m", 30, 30, 1, -1.0, -2.0, -0.5, 0.5, 0.002), ("p__15m", 30, 30, 1, 1.0, -2.0, 0.5, 0.5, 0.002)], RESULT)
    before = spark.createDataFrame([(f"o{i}", 0.1 + 0.04 * i) for i in range(21)], "hypothesis_id string, p_value double")
    got = {r["hypothesis_id"]: r for r in nf.ledger_v2(tests, arms, one, before, small).collect()}
    assert got["v__15m"]["advances"] and got["v__30m"]["result"] == "insufficient_sample" and not got["v__30m"]["cumulative_reject"]
    assert got["p__5m"]["advances"] and got["p__15m"]["result"] == "does_not_advance" and got["p__5m"]["cumulative_q"] == pytest.approx(0.002 * 25 / 4)


def test_calendar(spark):
    got = {str(r["session_date"]): r for r in calendar.schedule(spark, date(2024, 12, 23), date(2025, 1, 10)).collect()}
    assert "2024-12-25" not in got and "2025-01-01" not in got and "2024-12-28" not in got
    assert (got["2024-12-24"]["expected_minutes"], got["2025-01-09"]["expected_minutes"], got["2024-12-23"]["expected_minutes"]) == (1155, 930, 1380)
    assert got["2025-01-09"]["override"] and got["2024-12-24"]["is_early_close"]
    far = {str(r["session_date"]): r for r in calendar.schedule(spark, date(2026, 1, 1), date(2026, 12, 31)).collect()}
    assert (far["2026-01-05"]["open_utc"].hour, far["2026-07-06"]["open_utc"].hour, far["2026-07-03"]["expected_minutes"]) == (23, 22, 1140) and far["2026-07-03"]["is_early_close"]
    assert [str(calendar._easter(y)) for y in (1999, 2000, 2019, 2024, 2038)] == ["1999-04-04", "2000-04-23", "2019-04-21", "2024-03-31", "2038-04-25"]
    with pytest.raises(ValueError, match="no calendar"):
        calendar.schedule(spark, date(1990, 1, 1), date(1990, 2, 1))
    summer = calendar.schedule(spark, date(2024, 7, 8), date(2024, 7, 8)).first()
    assert summer["open_utc"] == datetime(2024, 7, 7, 22, 0) and summer["close_utc"] == datetime(2024, 7, 8, 21, 0)


def test_gaps_and_records(spark):
    day = calendar.schedule(spark, date(2024, 1, 8), date(2024, 1, 9))
    expected = calendar.expected_bars(day, 60)
    seen = expected.where("ts NOT IN (timestamp_ntz'2024-01-08 03:00:00', timestamp_ntz'2024-01-08 04:00:00', timestamp_ntz'2024-01-08 15:00:00')")
    gaps = quality.runs(quality.missing(expected, seen), 60).orderBy("start_utc").collect()
    assert [(r["minutes"], r["rth_overlap"]) for r in gaps] == [(120, False), (60, True)]
    rec = {str(r["session_date"]): r for r in quality.session_records(expected, seen.unionAll(seen.limit(0)), roll_days=("2024-01-09",)).collect()}
    assert rec["2024-01-08"]["exclusion_reasons"] == "missing_expected_minutes" and rec["2024-01-08"]["severity"] == "high"
    assert rec["2024-01-09"]["exclusion_reasons"] == "roll_boundary_session"
    copies = spark.createDataFrame([(date(2024, 1, 8), 1, False), (date(2024, 1, 9), 0, True)], "session_date date, exact_removed long, conflicting boolean")
    both = {str(r["session_date"]): r for r in quality.session_records(expected, expected, copies=copies, sessions=day, minutes=60).collect()}
    assert (both["2024-01-08"]["quality_status"], both["2024-01-08"]["severity"]) == ("corrected", "low")
    assert (both["2024-01-09"]["quality_status"], both["2024-01-09"]["severity"], both["2024-01-09"]["session_usable"]) == ("excluded", "critical", False)
    assert both["2024-01-08"]["expected_open_et"].startswith("2024-01-07T18:00:00-05:00")
    nothing = {str(r["session_date"]): r["severity"] for r in quality.session_records(expected, seen.where("session_date = DATE'2024-01-08'")).collect()}
    assert nothing == {"2024-01-08": "high", "2024-01-09": "critical"}
    back = expected.withColumn("symbol", F.when(F.hour("ts") == 5, "B").otherwise("A"))
    moved = quality.session_records(expected, back).first()
    assert moved["contract_transitions"] == 2 and moved["symbols"] == "A|B" and moved["exclusion_reasons"] == "multiple_contracts_within_session"
    twice = quality.session_records(expected, expected.unionAll(expected.where("hour(ts) = 5")))
    assert {r["quality_status"] for r in twice.collect()} == {"corrected"}


def test_roll_needs_a_confirmed_streak(spark):
    days = [date(2024, 3, 4) + timedelta(i) for i in range(5)]
    volumes = spark.createDataFrame([("A", d, 10, n) for d, n in zip(days, (11, 9, 12, 13, 1), strict=True)], "pair string, day date, front_volume int, next_volume int")
    pairs = spark.createDataFrame([("A", date(2024, 3, 15), date(2024, 3, 8)), ("B", date(2024, 6, 21), date(2024, 6, 14))], "pair string, expiry date, planned_roll date")
    got = {r["pair"]: r for r in rolls.decisions(volumes, pairs).collect()}
    assert got["A"]["confirmed"] == days[3] and got["A"]["roll_day"] == date(2024, 3, 8)
    assert got["B"]["roll_day"] == date(2024, 6, 14) and got["B"]["method"] == "planned"


def test_inventory_and_chunks(spark):
    got = rolls.inventory(spark, "ES", date(2024, 1, 1), date(2024, 12, 31))
    assert [r["symbol"] for r in got.orderBy("expiry").collect()] == ["ESH4", "ESM4", "ESU4", "ESZ4", "ESH5"]
    parts = rolls.chunks(spark.createDataFrame([("ESH4", date(2024, 1, 1), date(2024, 1, 17))], "symbol string, first_day date, last_day date"))
    assert [(r["chunk_end"] - r["chunk_start"]).days for r in parts.orderBy("chunk_start").collect()] == [6, 6, 2]
    assert parts.select("request_id").distinct().count() == 3


def test_guards(spark):
    df = spark.createDataFrame([("development", 1), ("final_test", 2)], "split string, timestamp_utc int")
    assert rows(guarded(df, ["development"], ["development", "final_test"], "final_test")) == [("development", 1)]
    with pytest.raises(PermissionError):
        guarded(df, ["final_test"], ["development", "final_test"], "final_test")
    for bad in ([], ["x"]):
        with pytest.raises(ValueError):
            guarded(df, bad, ["development", "final_test"], "final_test")
    with pytest.raises(ValueError):
        guarded(df, ["development"], ["development"], "final_test", columns=["a; b"])
    assert guarded(df, ["final_test"], ["development", "final_test"], "final_test", unlocked=True).count() == 1


def test_feature_contracts():
    specs = catalog.features(WINDOWS)
    assert len(specs) == 101 and not catalog.problems(specs)
    sizes = {f: sum(s.family == f for s in specs) for f in catalog.AVAILABLE}
    assert sizes == {"calendar": 9, "prior_session": 15, "overnight": 10, "opening": 32, "level": 12, "volatility": 14, "regime": 9}
    with pytest.raises(ValueError, match="looks ahead"):
        catalog.check([*specs, catalog.Feature("x", "level", "double", "t", "s", True)])
    assert catalog.problems([*specs, specs[0]])


def test_leak_is_found(spark):
    df = bars(spark, [100, 101, 102]).withColumns({"known": F.col("rth_minute") + 5, "bar_available_at": F.col("rth_minute") + 1, "f": F.lit(1.0)})
    assert bf.violations(df, {"known": ["f"]}).first()["early_known"] == 3
    assert bf.violations(bf.gated(df, {"known": ["f"]}), {"known": ["f"]}).first()["early_known"] == 0


def test_validity_codes(spark):
    cols = "ts timestamp_ntz, open string, high double, low double, close double, up_volume long, down_volume long, up_ticks long, down_ticks long"
    good = (datetime(2024, 1, 1, 1), "10.25", 11.0, 9.0, 10.5, 1, 1, 1, 1)
    df = spark.createDataFrame([good, (None, *good[1:]), (good[0], "x", *good[2:]), (good[0], "10.3", 10.0, *good[3:]), (good[0], *good[1:5], -1, 1, 1, -2), (good[0], "10.25", float("nan"), *good[3:])], cols)
    got = [r["issue_codes"] for r in quality.checked(df).collect()]
    assert got == ["", "invalid_timestamp", "non_numeric", "invalid_ohlc_order|off_tick_price", "negative_volume|negative_ticks", "non_numeric"]


def test_pressure(spark):
    got = events.pressure(bars(spark, [100, 101, 102, 103]), 3).orderBy("ts").collect()
    assert got[1]["pressure"] is None and got[2]["pressure"] == pytest.approx((33 - 15) / 48)


def test_summary_of_a_complete_grid(spark):
    """Sessions without gaps: a cell for each anchor and horizon, with as many outcomes as there are sessions."""
    one = None
    for day in range(3):
        b = bars(spark, [100 + (i * 7 + day) % 5 for i in range(30)], day=day)
        one = b if one is None else one.unionByName(b)
    got = outcomes.summary(outcomes.forward(one, (1, 5, 15), 1, 5, "rth_minute"), ["clock_minute", "horizon_minutes"])
    assert got.count() == 6 + 6 + 4 and got.select("n").distinct().collect()[0][0] == 3
    assert got.where("wilson_low < 0 OR wilson_high > 1 OR t_low > mean_bps").count() == 0
    assert clock.segment(F.lit(0)) is not None
