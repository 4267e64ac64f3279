"""Guarded arithmetic, labels and interval formulas as columns."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def known(x: Column) -> Column:
    """NaN and infinities as null: a missing number is always null here."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or the result isn't finite."""
    return known(F.try_divide(a.cast("double"), b.cast("double")))


def change(a: Column, b: Column) -> Column:
    return ratio(a, b) - 1


def bps(a: Column, b: Column) -> Column:
    return change(a, b) * 1e4


def regime(x: Column, low: float, high: float) -> Column:
    """low and high include their bounds; null stays null."""
    return F.when(x <= low, "low").when(x >= high, "high").when(x.isNotNull(), "normal")


def trend(x: Column, by: float) -> Column:
    return F.when(x <= -by, "down").when(x >= by, "up").when(x.isNotNull(), "flat")


SEVERITY = ("none", "low", "medium", "high", "critical")


def max_severity(*labels: Column) -> Column:
    """The gravest of labels; unknown ones and nulls count as none."""
    order = F.create_map(*[F.lit(x) for i, s in enumerate(SEVERITY) for x in (s, i)])
    places = [F.coalesce(F.try_element_at(order, c), F.lit(0)) for c in labels]
    return F.element_at(F.array(*map(F.lit, SEVERITY)), (F.greatest(*places, F.lit(0)) + 1).cast("int"))


def codes(**flags: Column) -> Column:
    """The names of the flags that hold, joined by a bar."""
    return F.concat_ws("|", *[F.when(c, name) for name, c in flags.items()])


def wilson(k: Column, n: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Wilson's interval of a share, within 0 and 1; null if n is 0."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    n = F.when(n > 0, n.cast("double"))
    p = k / n
    mid = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return F.when(n > 0, F.greatest(F.lit(0.0), (mid - half) / scale)), F.when(n > 0, F.least(F.lit(1.0), (mid + half) / scale))


def _beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    f = d
    for m in range(1, 400):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + t * d or tiny)
            c = 1 + t / c or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def _terms(z: float) -> tuple[float, ...]:
    """What the t quantile differs by from the normal one, by powers of one over the degrees of freedom."""
    return (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384


@lru_cache(maxsize=20_000)
def t_quantile(p: float, df: int) -> float:
    """The quantile of Student's t: Newton's steps from the expansion for many degrees, bisection on the incomplete beta function for few."""
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 2.0
    tail = lambda t: 0.5 * _beta(df / 2, 0.5, df / (df + t * t))
    if df >= 30 and p > 0.9:
        z = NormalDist().inv_cdf(p)
        scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        t = z + sum(c / df ** (i + 1) for i, c in enumerate(_terms(z)))
        for _ in range(3):
            t += (tail(t) - (1 - p)) / (scale * (1 + t * t / df) ** (-(df + 1) / 2))
        return t
    while tail(high) > 1 - p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) > 1 - p else (low, mid)
        if high - low < 1e-14 * high:
            break
    return (low + high) / 2


T_TABLE = 2000


def t_table(spark: SparkSession, level: float = 0.95, most: int = T_TABLE):
    """(df, t_crit) for degrees up to `most`; beyond, t_beyond is exact to ten digits."""
    return spark.createDataFrame([(i, t_quantile(0.5 + level / 2, i)) for i in range(1, most + 1)], "df int, t_crit double")


def t_beyond(df: Column, level: float = 0.95) -> Column:
    """The expansion of the t quantile around the normal one, for many degrees of freedom."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    return F.lit(z) + sum((F.lit(c) / F.pow(df.cast("double"), F.lit(float(i + 1))) for i, c in enumerate(_terms(z))), F.lit(0.0))


def with_t_interval(df, mean: str, sd: str, n: str, level: float = 0.95):
    """df with t_low and t_high; null where n < 2. Only the table of T_TABLE rows is broadcast."""
    table = F.broadcast(t_table(df.sparkSession, level).withColumnRenamed("df", "_df"))
    out = df.join(table, (F.col(n) - 1).cast("int") == F.col("_df"), "left")
    crit = F.when(F.col(n) >= 2, F.coalesce("t_crit", t_beyond(F.col(n) - 1, level)))
    half = crit * F.col(sd) / F.sqrt(F.col(n).cast("double"))
    return out.withColumn("t_low", F.col(mean) - half).withColumn("t_high", F.col(mean) + half).drop("_df", "t_crit")
