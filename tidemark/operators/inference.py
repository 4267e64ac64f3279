"""Inference by resampling with fixed seeds, false-discovery control, and the ledgers of hypotheses."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import INFERENCE, Inference

#: Replicates that are drawn at once, in numbers, so that a group's memory doesn't grow with them.
AT_ONCE = 4_000_000


def seed_of(base: int, name: str, purpose: str) -> int:
    """The first eight bytes of a hash of what the draw is for."""
    return int.from_bytes(hashlib.sha256(f"{base}|{name}|{purpose}".encode()).digest()[:8], "big")


def _draws(n: int, replicates: int):
    """How many replicates of n numbers fit into one draw."""
    size = max(1, AT_ONCE // max(1, n))
    return [min(size, replicates - i) for i in range(0, replicates, size)]


def bootstrap_interval(values: np.ndarray, level: float, replicates: int, seed: int) -> tuple[float | None, float | None]:
    """The percentile interval of the mean over samples with replacement."""
    x = np.asarray(values, float)
    x = x[np.isfinite(x)]
    if len(x) < 2:
        return None, None
    rng = np.random.default_rng(seed)
    means = np.concatenate([x[rng.integers(0, len(x), (k, len(x)))].mean(1) for k in _draws(len(x), replicates)])
    low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
    return float(low), float(high)


def p_value(observed: float, null: np.ndarray, alternative: str = "two_sided") -> float:
    """The share of the null at least as extreme, the observation itself counted."""
    if alternative == "two_sided":
        hits = (np.abs(null) >= abs(observed) - 1e-12).sum()
    elif alternative == "greater":
        hits = (null >= observed - 1e-12).sum()
    elif alternative == "less":
        hits = (null <= observed + 1e-12).sum()
    else:
        raise ValueError(alternative)
    return float((hits + 1) / (len(null) + 1))


def sign_flip_p(values: np.ndarray, replicates: int, seed: int, alternative: str = "two_sided") -> float | None:
    x = np.asarray(values, float)
    x = x[np.isfinite(x)]
    if not len(x):
        return None
    rng = np.random.default_rng(seed)
    null = np.concatenate([(rng.integers(0, 2, (k, len(x))) * 2 - 1) @ x / len(x) for k in _draws(len(x), replicates)])
    return p_value(x.mean(), null, alternative)


def direction_p(returns: np.ndarray, directions: np.ndarray, replicates: int, seed: int, alternative: str = "two_sided") -> float | None:
    """Permutes the directions among the returns; rows without one are left out."""
    r, d = np.asarray(returns, float), np.sign(np.asarray(directions, float))
    keep = np.isfinite(r) & (d != 0) & np.isfinite(d)
    r, d = r[keep], d[keep]
    if not len(r):
        return None
    rng = np.random.default_rng(seed)
    null = np.concatenate([rng.permuted(np.tile(d, (k, 1)), axis=1) @ r / len(r) for k in _draws(len(r), replicates)])
    return p_value((r * d).mean(), null, alternative)


def cluster_difference(sums: np.ndarray, counts: np.ndarray, level: float, replicates: int, seed: int) -> tuple[float | None, float | None, float | None]:
    """The difference of two arms' means and its interval, from each cluster's sums and counts by arm (columns: first and second arm).

    Clusters are drawn with replacement; a draw without one of the arms is left out. These sums are all that a resampled mean
    needs, so rows are aggregated before they come here.
    """
    total = counts.sum(0)
    if len(sums) < 2 or (total == 0).any():
        return None, None, None
    rng = np.random.default_rng(seed)
    found = []
    for k in _draws(len(sums), replicates):
        at = rng.integers(0, len(sums), (k, len(sums)))
        s, n = sums[at].sum(1), counts[at].sum(1)
        fine = (n > 0).all(1)
        found.append(s[fine, 0] / n[fine, 0] - s[fine, 1] / n[fine, 1])
    draws = np.concatenate(found)
    observed = float(sums[:, 0].sum() / total[0] - sums[:, 1].sum() / total[1])
    if not len(draws):
        return observed, None, None
    low, high = np.quantile(draws, [(1 - level) / 2, (1 + level) / 2])
    return observed, float(low), float(high)


def stratified_p(values: np.ndarray, first_arm: np.ndarray, strata: np.ndarray, replicates: int, seed: int, alternative: str = "two_sided") -> float | None:
    """Permutes the arms' labels inside each stratum."""
    x, g = np.asarray(values, float), np.asarray(first_arm, bool)
    if not g.any() or g.all():
        return None
    order = np.argsort(strata, kind="stable")
    x, g, s = x[order], g[order], np.asarray(strata)[order]
    cuts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))).tolist() + [len(s)]
    rng = np.random.default_rng(seed)
    n1, n0 = g.sum(), (~g).sum()
    null = []
    for k in _draws(len(x), replicates):
        own = np.zeros(k)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own += rng.permuted(np.tile(g[a:b], (k, 1)), axis=1) @ x[a:b]
        null.append(own / n1 - (x.sum() - own) / n0)
    return p_value(x[g].mean() - x[~g].mean(), np.concatenate(null), alternative)


RESAMPLED = (
    "hypothesis_id string, n long, clusters long, mean_bps double, median_bps double, sd_bps double, positive_rate double, years long, first_session string, last_session string, "
    "boot_low double, boot_high double, sign_flip_p double, direction_p double"
)


def resampled(events: DataFrame, settings: Inference = INFERENCE, base: int | None = None, replicates: int | None = None) -> DataFrame:
    """events (hypothesis_id, session_date, entry_minute, direction, return_bps, effect_bps): for each hypothesis its moments and sessions, a bootstrap interval of the mean, and p
    by sign flips of the effects and by directions permuted among the returns. Which p counts is the hypothesis's null (`ledger`).

    A group is one hypothesis's events, at most a few per session; rows are sorted inside, so that draws don't depend on the layout.
    """
    seed, k, level = base or settings.seed, replicates or settings.replicates, 0.95

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["session_date", "entry_minute", "effect_bps"], kind="stable")
        x, name, day = rows["effect_bps"].to_numpy(float), key[0], rows["session_date"]
        low, high = bootstrap_interval(x, level, k, seed_of(seed, name, "bootstrap"))
        flip = sign_flip_p(x, k, seed_of(seed, name, "sign_flip"))
        turn = direction_p(rows["return_bps"].to_numpy(float), rows["direction"].to_numpy(float), k, seed_of(seed, name, "direction"))
        spread = float(np.std(x, ddof=1)) if len(x) > 1 else None
        own = (name, len(x), day.nunique(), float(np.mean(x)), float(np.median(x)), spread, float(np.mean(x > 0)), day.str[:4].nunique(), day.min(), day.max(), low, high, flip, turn)
        return pd.DataFrame([own], columns=[c.split()[0] for c in RESAMPLED.split(", ")])

    slim = events.select("hypothesis_id", F.col("session_date").cast("string").alias("session_date"), "entry_minute", "direction", "return_bps", "effect_bps")
    return slim.groupBy("hypothesis_id").applyInPandas(run, RESAMPLED)


def contrasted(events: DataFrame, settings: Inference = INFERENCE, replicates: int | None = None) -> DataFrame:
    """events (hypothesis_id, session_date, entry_minute, state, effect_bps): the difference high - low with a cluster bootstrap by session, and p by labels permuted within entry clocks."""
    seed, k = settings.seed_v2, replicates or settings.replicates
    arm = lambda s, c: F.sum(F.when(F.col("state") == s, c).otherwise(0.0))
    clusters = events.groupBy("hypothesis_id", F.col("session_date").cast("string").alias("session_date")).agg(*[arm(s, c).alias(n) for n, s, c in (("s1", "high", F.col("effect_bps")), ("s0", "low", F.col("effect_bps")), ("n1", "high", F.lit(1.0)), ("n0", "low", F.lit(1.0)))])

    def boot(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("session_date")
        got = cluster_difference(rows[["s1", "s0"]].to_numpy(), rows[["n1", "n0"]].to_numpy(), 0.95, k, seed_of(seed, key[0], "cluster"))
        return pd.DataFrame([(key[0], len(rows), int(rows["n1"].sum()), int(rows["n0"].sum()), *got)], columns=["hypothesis_id", "clusters", "n_high", "n_low", "difference_bps", "boot_low", "boot_high"])

    def permute(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["session_date", "entry_minute"], kind="stable")
        p = stratified_p(rows["effect_bps"].to_numpy(), (rows["state"] == "high").to_numpy(), rows["entry_minute"].to_numpy(), k, seed_of(seed, key[0], "strata"))
        return pd.DataFrame([(key[0], p)], columns=["hypothesis_id", "p_value"])

    a = clusters.groupBy("hypothesis_id").applyInPandas(boot, "hypothesis_id string, clusters long, n_high long, n_low long, difference_bps double, boot_low double, boot_high double")
    slim = events.select("hypothesis_id", F.col("session_date").cast("string").alias("session_date"), "entry_minute", "state", "effect_bps")
    return a.join(slim.groupBy("hypothesis_id").applyInPandas(permute, "hypothesis_id string, p_value double"), "hypothesis_id")


def benjamini_hochberg(tests: DataFrame, p: str = "p_value", family: list[str] | None = None, alpha: float = INFERENCE.alpha, q: str = "q_value", reject: str = "bh_reject", tie: str = "hypothesis_id") -> DataFrame:
    """q values by the step-up rule within each family (all tests, without one): the least p * m / rank from here up, at most 1. A null p has no q and doesn't count."""
    bad = F.raise_error(F.lit("p values must be from 0 to 1"))
    value = F.when(F.col(p).isNull() | F.isnan(p), None).when((F.col(p) < 0) | (F.col(p) > 1), bad.cast("double")).otherwise(F.col(p))
    own = tests.withColumn("_p", value)
    every = W.partitionBy(*(family or []))
    up = every.orderBy(F.col("_p").asc_nulls_last(), tie)
    own = own.withColumns({"_m": F.count("_p").over(every), "_rank": F.row_number().over(up)})
    own = own.withColumn("_raw", F.when(F.col("_p").isNotNull(), F.col("_p") * F.col("_m") / F.col("_rank")))
    least = F.min("_raw").over(up.rowsBetween(0, W.unboundedFollowing))
    own = own.withColumn(q, F.when(F.col("_p").isNotNull(), F.least(F.lit(1.0), least)))
    return own.withColumn(reject, F.coalesce(F.col(q) <= alpha, F.lit(False))).drop("_p", "_m", "_rank", "_raw")


def decided(got: DataFrame, enough: Column, settings: Inference = INFERENCE, also: Column | None = None) -> DataFrame:
    """Tests with results (family_id, p_value, boot_low, boot_high) -> q_value within families, sample_sufficient, bh_reject, ci_excludes_zero, advances, result.

    A test without a sufficient sample still counts among its family's p values, but isn't rejected. One goes on if it is rejected, its interval lies wholly
    above or wholly below zero, and `also` holds. Results are labelled by fixed values.
    """
    got = benjamini_hochberg(got, "p_value", ["family_id"], settings.alpha).withColumn("sample_sufficient", F.coalesce(enough, F.lit(False)))
    away = F.coalesce((F.col("boot_low") > 0) | (F.col("boot_high") < 0), F.lit(False))
    got = got.withColumns({"bh_reject": F.col("bh_reject") & F.col("sample_sufficient"), "ci_excludes_zero": away & F.col("sample_sufficient")})
    got = got.withColumn("advances", F.col("bh_reject") & F.col("ci_excludes_zero") & (F.lit(True) if also is None else F.coalesce(also, F.lit(False))))
    label = F.when(~F.col("sample_sufficient"), "insufficient_sample").when(F.col("advances"), "advances_to_phase7").otherwise("does_not_advance")
    return got.withColumn("result", label)


def p_by_null() -> Column:
    """The p value that a hypothesis's null calls for."""
    return F.when(F.col("null") == "sign_flip", F.col("sign_flip_p")).otherwise(F.col("direction_p"))


def ledger(tests: DataFrame, results: DataFrame, settings: Inference = INFERENCE) -> DataFrame:
    """Every registered test with its result, those without events too."""
    got = tests.join(results, "hypothesis_id", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n", "clusters", "years")})
    return decided(got.withColumn("p_value", p_by_null()), F.col("n") >= settings.min_sample, settings)


def ledger_v2(tests: DataFrame, contrasts: DataFrame, responses: DataFrame, before: DataFrame, settings: Inference = INFERENCE) -> DataFrame:
    """The second wave: contrasts of two arms (`contrasted`) and responses with a direction (`resampled`), q values within families, and over both waves together.

    A sample is sufficient by its observations and its sessions, and, only where there are arms, by each of them. To go on, a test must be rejected in its family and over both
    waves, and its interval must leave out zero.
    """
    least = settings.min_sample
    arms = contrasts.select(
        "hypothesis_id", (F.col("n_high") + F.col("n_low")).alias("n"), "clusters", "n_high", "n_low", F.col("difference_bps").alias("mean_bps"), "boot_low", "boot_high", "p_value",
        ((F.col("n_high") >= least) & (F.col("n_low") >= least)).alias("arms_sufficient"),
    )
    zero = F.lit(0).cast("long")
    one = responses.select("hypothesis_id", "n", "clusters", zero.alias("n_high"), zero.alias("n_low"), "mean_bps", "boot_low", "boot_high", F.col("direction_p").alias("p_value"), F.lit(True).alias("arms_sufficient"))
    got = tests.join(arms.unionByName(one), "hypothesis_id", "left")
    got = got.withColumns({c: F.coalesce(c, zero) for c in ("n", "clusters", "n_high", "n_low")}).withColumn("arms_sufficient", F.coalesce("arms_sufficient", F.lit(False)))
    both = before.select("hypothesis_id", "p_value").withColumn("wave", F.lit("v1")).unionByName(got.select("hypothesis_id", "p_value").withColumn("wave", F.lit("v2")))
    every = benjamini_hochberg(both, "p_value", None, settings.alpha, "cumulative_q", "cumulative_reject").where("wave = 'v2'").drop("wave", "p_value")
    enough = (F.col("n") >= least) & (F.col("clusters") >= least) & F.col("arms_sufficient")
    got = got.join(every, "hypothesis_id").withColumn("cumulative_reject", F.col("cumulative_reject") & F.coalesce(enough, F.lit(False)))
    return decided(got, enough, settings, F.col("cumulative_reject"))


def ranked(ledger_rows: DataFrame) -> DataFrame:
    """Tests in the order of a report: q, then p, then name, with their place. A ledger has one row for each registered test."""
    at = W.orderBy(F.col("q_value").asc_nulls_last(), F.col("p_value").asc_nulls_last(), "hypothesis_id")
    return ledger_rows.withColumn("place", F.row_number().over(at))
