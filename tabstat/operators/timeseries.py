"""Series under an explicit order: autocorrelation, unit roots, seasonality, order detection.

Sums over the series are distributed; the recursions run on at most a few dozen
numbers on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstat.functions.vectors import with_mid_ranks
from tabstat.plans import dist
from tabstat.plans.gram import moments, solve
from tabstat.plans.ordered import lagged, number
from tabstat.plans.shared import write_table

_Z = 1.96


def series(df: DataFrame, value: str, order_by: Sequence[str]) -> DataFrame:
    """(t, y) with t = 0, 1, ... Null values are left out."""
    keys = [f"_o{i}" for i in range(len(order_by))]
    return number(df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("y"), *(F.col(c).alias(k) for c, k in zip(order_by, keys, strict=True))), keys, "t").select("t", "y")


def difference(s: DataFrame, lag: int = 1) -> DataFrame:
    """y(t) - y(t - lag), numbered from 0 again."""
    before = s.select((F.col("t") + lag).alias("t"), F.col("y").alias("_b"))
    return s.join(before, "t").select((F.col("t") - lag).alias("t"), (F.col("y") - F.col("_b")).alias("y"))


def acf(s: DataFrame, lags: int) -> DataFrame:
    """(lag, rho), lag = 0..lags: biased autocorrelation."""
    m = s.agg(F.avg("y")).first()[0] or 0.0
    pairs = lagged(s.select("t", (F.col("y") - m).alias("y")), "t", lags, ["y"])
    cov = pairs.groupBy("lag").agg(F.sum(F.col("y") * F.col("y_lag")).alias("c"))
    zero = cov.where("lag = 0").select(F.col("c").alias("c0"))
    return cov.join(F.broadcast(zero)).select("lag", (F.col("c") / F.col("c0")).alias("rho"))


def _rho(s: DataFrame, lags: int) -> np.ndarray:
    out = np.zeros(lags + 1)
    for r in acf(s, lags).collect():
        out[r.lag] = r.rho
    return out


def partial(rho: np.ndarray) -> np.ndarray:
    """Partial autocorrelations of lags 1.. from autocorrelations of lags 0.. (Durbin-Levinson)."""
    out = np.zeros(len(rho) - 1)
    phi = np.zeros(0)
    for k in range(1, len(rho)):
        below = 1 - (phi @ rho[1:k] if k > 1 else 0.0)
        top = rho[k] - (phi @ rho[k - 1 : 0 : -1] if k > 1 else 0.0)
        last = top / below if below else 0.0
        phi = np.append(phi - last * phi[::-1], last)
        out[k - 1] = last
    return out


def acf_order(s: DataFrame) -> int:
    """q: lags before the first insignificant one."""
    n = s.count()
    lags = min(40, n // 4)
    rho = _rho(s, lags)
    return next((k - 1 for k in range(1, lags + 1) if abs(rho[k]) <= _Z / math.sqrt(n)), 0)


def pacf_order(s: DataFrame) -> int:
    """p: the last of the consecutive significant partial lags; lag 1 itself may be insignificant."""
    n = s.count()
    lags = min(40, n // 4)
    if lags < 1:
        return 0
    phi = np.abs(partial(_rho(s, lags))) > _Z / math.sqrt(n)
    order = 0
    for k in range(1, lags + 1):
        if phi[k - 1]:
            order = k
        elif k > 1:
            break
    return order


def seasonal_acf_order(s: DataFrame, period: int) -> int:
    """Q: seasonal lags before the first insignificant one."""
    n = s.count()
    lags = min(40, n // 4) // period
    if period < 1 or lags < 1:
        return 0
    rho = _rho(s, lags * period)[::period]
    return next((k - 1 for k in range(1, lags + 1) if abs(rho[k]) <= _Z / math.sqrt(n)), 0)


def seasonal_pacf_order(s: DataFrame, period: int) -> int:
    """P: as pacf_order on the lags period, 2 period, ..."""
    n = s.count()
    lags = min(40, n // 4) // period if period else 0
    if lags < 1:
        return 0
    phi = np.abs(partial(_rho(s, lags * period)[::period])) > _Z / math.sqrt(n)
    order = 0
    for k in range(1, lags + 1):
        if phi[k - 1]:
            order = k
        elif k > 1:
            break
    return order


def acf_period(s: DataFrame) -> int:
    """The first local maximum of the autocorrelation at lag 4 or later that is significant; 0 if none."""
    n = s.count()
    lags = min(40, n // 2)
    rho = _rho(s, lags)
    return next((k for k in range(4, lags) if rho[k] > rho[k - 1] and rho[k] > rho[k + 1] and abs(rho[k]) > _Z / math.sqrt(n)), 0)


def detrend(s: DataFrame) -> DataFrame:
    """y less its least-squares line on t."""
    r = s.agg(F.regr_slope("y", F.col("t").cast("double")).alias("b"), F.regr_intercept("y", F.col("t").cast("double")).alias("a")).first()
    return s.select("t", (F.col("y") - F.lit(r.a or 0.0) - F.lit(r.b or 0.0) * F.col("t")).alias("y"))


def periodogram(s: DataFrame, n: int | None = None) -> DataFrame:
    """(k, power) of the frequencies 1..n/2-1: squared size of the Fourier sums.

    Every row meets every frequency in its task, in blocks, and sums are added up:
    the work is n squared / 2, as the sums are defined.
    """
    n = s.count() if n is None else n
    half = max(1, n // 2)
    import pandas as pd

    def sums(batches):
        k = np.arange(1, half)
        re, im = np.zeros(len(k)), np.zeros(len(k))
        for b in batches:
            t, y = b["t"].to_numpy(), b["y"].to_numpy()
            for low in range(0, len(k), 256):
                angle = 2 * np.pi * (np.outer(k[low : low + 256], t) % n) / n
                re[low : low + 256] += np.cos(angle) @ y
                im[low : low + 256] -= np.sin(angle) @ y
        yield pd.DataFrame({"k": k, "re": re, "im": im})

    return s.mapInPandas(sums, "k bigint, re double, im double").groupBy("k").agg((F.pow(F.sum("re"), F.lit(2.0)) + F.pow(F.sum("im"), F.lit(2.0))).alias("power"))


def fourier_period(s: DataFrame) -> int:
    """n / k rounded, of the frequency k with most power; 0 for fewer than 4 values."""
    n = s.count()
    if n < 4:
        return 0
    best = periodogram(s, n).agg(F.max_by("k", F.struct("power", -F.col("k")))).first()[0]
    return int(n / best + 0.5)


def kruskal_wallis(s: DataFrame, period: int) -> tuple[float, float]:
    """(H, p value) of the groups t mod period; (0, 1) for a period below 2."""
    n = s.count()
    if period < 2 or n <= period:
        return 0.0, 1.0
    sums = with_mid_ranks(s, "y").groupBy((F.col("t") % period).alias("g")).agg(F.sum("rank").alias("r"), F.count("*").alias("n"))
    h = sums.agg(F.sum(F.col("r") * F.col("r") / F.col("n"))).first()[0] * 12 / (n * (n + 1)) - 3 * (n + 1)
    return float(h), dist.chi2_p_value(float(h), period - 1)


def critical_value(n: int) -> float:
    """5 % value of the unit root test for n values."""
    return -2.8621 - 2.738 / n - 3.394 / n**2


def adf(s: DataFrame) -> float:
    """t statistic of y(t-1) in a regression of differences on it, a trend, a constant and lagged differences."""
    n = s.count()
    lags = int(12 * (n / 100) ** 0.25)
    if n < lags + 8:
        raise ValueError("series is too short")
    d = s.join(s.select((F.col("t") + 1).alias("t"), F.col("y").alias("_b")), "t").select("t", (F.col("y") - F.col("_b")).alias("d"), F.col("_b").alias("level"))
    wide = d
    if lags:
        pairs = lagged(d.select("t", "d"), "t", lags, ["d"]).where("lag > 0").groupBy("t").pivot("lag", list(range(1, lags + 1))).agg(F.first("d_lag"))
        wide = d.join(pairs, "t")
    names = ["t", "level", *(str(k) for k in range(1, lags + 1))]
    g = moments(wide, [*(F.col(f"`{c}`") for c in names), F.col("d")], [*names, "d"])
    k = len(names)
    inverse = solve(g.centred[:k, :k], np.eye(k))
    beta = inverse @ g.centred[:k, k]
    rss = g.centred[k, k] - beta @ g.centred[:k, k]
    sigma2 = rss / (g.n - k - 1)
    return float(beta[1] / math.sqrt(sigma2 * inverse[1, 1]))


def detect_arima(s: DataFrame, most: int = 2) -> tuple[int, int, int]:
    """(p, d, q); (-2, -2, -2) if still not stationary after ``most`` differences."""
    for d in range(most + 1):
        if adf(s) < critical_value(s.count()):
            return pacf_order(s), d, acf_order(s)
        s = write_table(difference(s))
    return -2, -2, -2


def detect_sarima(s: DataFrame) -> dict[str, int | bool]:
    """p, d, q, P, D, Q, s and whether the series is seasonal."""
    flat = write_table(detrend(s))
    period = acf_period(flat)
    seasonal = period > 1 and kruskal_wallis(flat, period)[1] < 0.05
    if not seasonal:
        p, d, q = detect_arima(s)
        return {"p": p, "d": d, "q": q, "P": 0, "D": 0, "Q": 0, "s": 0, "seasonal": False}
    refined = fourier_period(flat)
    if 1 < refined <= s.count() // 2:
        period = refined
    big_d = 0
    if adf(s) >= critical_value(s.count()):
        s, big_d = write_table(difference(s, period)), 1
        if adf(s) >= critical_value(s.count()):
            big_d = 2
    p, d, q = detect_arima(s)
    return {"p": p, "d": d, "q": q, "P": seasonal_pacf_order(s, period), "D": big_d, "Q": seasonal_acf_order(s, period), "s": period, "seasonal": True}
