"""Linear association models with cluster-robust (CR1) errors.

Data are only ever aggregated: sums of cross products and per-cluster scores.  The
driver holds K x K matrices for a handful of predictors.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# --- Student t ---------------------------------------------------------------------------


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_fraction(b, a, 1 - x)
    front = math.exp(
        a * math.log(x) + b * math.log1p(-x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
    ) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d, c = 1 / (1 + num * d), 1 + num / c
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t for p >= 0.5, by bisection."""
    cdf = lambda t: 1 - 0.5 * _beta_fraction(df / 2, 0.5, df / (df + t * t))
    lo, hi = 0.0, 1.0
    while cdf(hi) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
        if hi - lo < 1e-13 * hi:
            break
    return (lo + hi) / 2


def t_quantile_column(df_col: Column, p: float = 0.975) -> Column:
    """Quantile per row, for aggregated rows only."""

    @F.pandas_udf("double")
    def quantile(d: pd.Series) -> pd.Series:
        known = {v: t_quantile(p, v) for v in d.dropna().unique() if v > 0}
        return d.map(known).astype(float)

    return quantile(df_col.cast("double"))


# --- one predictor, many groups -----------------------------------------------------------


def ols_cr1(df: DataFrame, by: Sequence[str], y: str, x: str, cluster: str, interval: bool = True) -> DataFrame:
    """y ~ 1 + x per group: slope, intercept, fit, CR1 error and t(G - 1) interval.

    Centring x and y first makes the slope's variance the sum over clusters of the
    squared score on the centred predictor.
    """
    by = list(by)
    data = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("__x"), F.col(y).alias("__y"), F.col(cluster).alias("__g"))
    first = data.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.mean("__x").alias("__mx"),
        F.mean("__y").alias("__my"),
        (F.var_pop("__x") * F.count(F.lit(1))).alias("__sxx"),
        (F.covar_pop("__x", "__y") * F.count(F.lit(1))).alias("__sxy"),
        (F.var_pop("__y") * F.count(F.lit(1))).alias("__syy"),
        (F.min("__x") < F.max("__x")).alias("__varies"),
    )
    per = data.groupBy(*by, "__g").agg(
        F.count(F.lit(1)).alias("__n"), F.mean("__x").alias("__ax"), F.mean("__y").alias("__ay"),
        F.var_pop("__x").alias("__vx"), F.var_pop("__y").alias("__vy"), F.covar_pop("__x", "__y").alias("__cv"),
    )
    # rows are never joined: only one row per group and cluster meets its group's means
    if by:
        on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in by])
        j = per.join(first.withColumnsRenamed({k: f"__k_{k}" for k in by}), on).drop(*[f"__k_{k}" for k in by])
    else:
        j = first.join(per, F.lit(True), "left")  # one row on the left
    dx, dy = F.col("__ax") - F.col("__mx"), F.col("__ay") - F.col("__my")
    xx, xy, yy = (F.col("__n") * (F.col(v) + d) for v, d in (("__vx", dx * dx), ("__cv", dx * dy), ("__vy", dy * dy)))
    b = F.col("__sxy") / F.nullif(F.col("__sxx"), F.lit(0.0))
    whole = [F.first(c).alias(c) for c in ("n", "__mx", "__my", "__sxx", "__sxy", "__syy", "__varies")]
    out = j.groupBy(*by).agg(
        *whole, F.count("__n").alias("cluster_count"), F.sum((xy - b * xx) * (xy - b * xx)).alias("__meat"), F.sum(yy - 2 * b * xy + b * b * xx).alias("__rss")
    )
    fit = (F.col("n") >= 3) & F.col("__varies")
    g, n = F.col("cluster_count"), F.col("n")
    slope = F.when(fit, F.col("__sxy") / F.col("__sxx"))
    factor = g / (g - 1) * (n - 1) / (n - 2)
    se = F.when(fit & (g >= 2), F.sqrt(F.col("__meat") * factor) / F.col("__sxx"))
    out = out.select(
        *by,
        "n",
        "cluster_count",
        slope.alias("slope"),
        (F.col("__my") - slope * F.col("__mx")).alias("intercept"),
        F.when(fit & (F.col("__syy") > 0), 1 - F.col("__rss") / F.col("__syy")).alias("r_squared"),
        se.alias("cluster_se"),
        F.when(~fit, "insufficient_or_constant_x").when(g < 2, "insufficient_match_clusters").otherwise("ok").alias("regression_status"),
    )
    if interval:
        margin = t_quantile_column(g - 1) * F.col("cluster_se")
        out = out.withColumn("__m", margin).withColumns(
            {"ci_low": F.col("slope") - F.col("__m"), "ci_high": F.col("slope") + F.col("__m")}
        ).drop("__m")
    return out


# --- several predictors -------------------------------------------------------------------


def _sums(pairs: Sequence[tuple[Column, Column]], names: str) -> list[Column]:
    return [F.sum(a * b).alias(f"{names}{i}") for i, (a, b) in enumerate(pairs)]


def _triangle(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _symmetric(values: Sequence[float], k: int) -> np.ndarray:
    out = np.zeros((k, k))
    for v, (i, j) in zip(values, _triangle(k)):
        out[i, j] = out[j, i] = v or 0.0
    return out


def _meat(scored: DataFrame, score: list[Column], cluster: str) -> tuple[np.ndarray, int]:
    """Sum of outer products of cluster scores, aggregated twice on the cluster."""
    k = len(score)
    per = scored.groupBy(cluster).agg(*[F.sum(s).alias(f"s{i}") for i, s in enumerate(score)])
    row = per.agg(
        F.count(F.lit(1)).alias("g"), *_sums([(F.col(f"s{i}"), F.col(f"s{j}")) for i, j in _triangle(k)], "m")
    ).first()
    return _symmetric([row[f"m{i}"] for i in range(k * (k + 1) // 2)], k), row["g"]


def ols_cr1_multi(df: DataFrame, y: str, xs: Sequence[str], cluster: str) -> dict:
    """y ~ 1 + xs with CR1 covariance; a rank-deficient design gives a null fit."""
    need = [y, *xs]
    data = df.dropna(subset=[*need, cluster]).select(*[F.col(c).cast("double").alias(c) for c in need], cluster)
    k = len(xs) + 1
    means = data.agg(F.count(F.lit(1)).alias("n"), F.mean(y).alias("m"), *[F.mean(c).alias(f"m{i}") for i, c in enumerate(xs)]).first()
    n, result = means["n"], {"terms": ["intercept", *xs], "n": means["n"], "status": "insufficient_data"}
    if n <= k:
        return result
    design = [F.lit(1.0), *[F.col(c) - means[f"m{i}"] for i, c in enumerate(xs)]]
    yc = F.col(y) - means["m"]
    row = data.agg(
        *_sums([(design[i], design[j]) for i, j in _triangle(k)], "x"), *_sums([(d, yc) for d in design], "y"), F.sum(yc * yc).alias("t")
    ).first()
    xtx = _symmetric([row[f"x{i}"] for i in range(k * (k + 1) // 2)], k)
    scale = np.sqrt(np.diag(xtx))
    if np.any(scale == 0) or np.linalg.matrix_rank(xtx / np.outer(scale, scale), hermitian=True, tol=1e-10) < k:
        return result | {"status": "rank_deficient"}
    beta = np.linalg.solve(xtx, [row[f"y{i}"] for i in range(k)])
    e = yc - sum((float(b) * d for b, d in zip(beta, design)), F.lit(0.0))
    rss = data.agg(F.sum(e * e).alias("r")).first()["r"]
    meat, g = _meat(data, [e * d for d in design], cluster)
    # undo the centring: only the intercept changes
    shift = np.eye(k)
    shift[0, 1:] = [-means[f"m{i}"] for i in range(k - 1)]
    beta_raw = shift @ beta
    beta_raw[0] += means["m"]
    result |= {
        "status": "ok" if g >= 2 else "insufficient_match_clusters",
        "parameters": beta_raw,
        "cluster_count": g,
        "r_squared": 1 - rss / row["t"] if row["t"] else None,
    }
    if g >= 2:
        bread = np.linalg.inv(xtx)
        cov = shift @ (bread @ meat @ bread * g / (g - 1) * (n - 1) / (n - k)) @ shift.T
        se = np.sqrt(np.clip(np.diag(cov), 0, None))
        margin = t_quantile(0.975, g - 1) * se
        result |= {"covariance": cov, "se": se, "ci_low": beta_raw - margin, "ci_high": beta_raw + margin}
    return result
