"""Logistic association models with cluster-robust (CR1) errors, many at a time.

The rows of all models are stacked once, each with its model's number and its predictors as an array. A Newton step is
one aggregation by model: the number of jobs is that of the slowest model's steps, whatever the number of models. The
driver holds a K x K matrix for each.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.operators.models import t_quantile
from strideframe.sources.stage import durable

#: fixed values: what makes a fit unusable
LIMITS = {"logit": 25.0, "least_spread": 1e-12, "least_rank": 1e-10, "least_reciprocal_condition": 1e-10, "least_information": 1e-8}
#: Scale-free distance from the optimum (Newton decrement per row) at which a fit stops, and at which it counts as settled.
GOAL, SETTLED = 1e-24, 1e-16
#: Times that a step is halved before a fit is given up.
HALVINGS = 8

_FIELDS = (
    "coefficient", "cluster_se", "coefficient_ci_low", "coefficient_ci_high", "odds_ratio", "odds_ratio_1sd", "or_1sd_ci_low",
    "or_1sd_ci_high", "log_likelihood", "mcfadden_r2", "max_score", "information_condition",
)


@dataclass(frozen=True)
class Model:
    """outcome ~ 1 + terms over the rows that meet ``where``; the first term is the one reported on its own."""

    outcome: str
    terms: Mapping[str, str | Column]
    where: Column | None = None
    reporting_sd: float | None = None

    def columns(self) -> list[Column]:
        return [(F.col(c) if isinstance(c, str) else c).cast("double") for c in self.terms.values()]


@dataclass
class _State:
    """Where a model's fit stands: the last point that improved it, and the one that is tried next."""

    names: list[str]
    n: int
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    value: float = math.inf
    grad: np.ndarray = field(default_factory=lambda: np.zeros(0))
    hess: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    separated: bool = False
    steps: int = 0
    move: np.ndarray | None = None
    halved: int = 0

    def decrement(self) -> float:
        """Squared length of the Newton step in the metric of the information, per row."""
        try:
            return float(self.grad @ np.linalg.solve(self.hess, self.grad)) / self.n
        except np.linalg.LinAlgError:
            return math.inf

    def next(self, most: int) -> None:
        """Choose the next step, or none if the fit is at its end."""
        self.move, self.halved = None, 0
        if self.steps < most and np.abs(self.beta).max() <= LIMITS["logit"] and self.decrement() > GOAL:
            try:
                self.move = np.linalg.solve(self.hess, self.grad)
            except np.linalg.LinAlgError:
                pass

    def trial(self) -> np.ndarray:
        return self.beta - self.move / 2**self.halved

    def take(self, found: tuple, most: int) -> None:
        """Go on from a trial that doesn't raise the loss beyond rounding; halve the step otherwise."""
        value = found[0]
        slack = 8 * np.finfo(float).eps * max(1.0, abs(self.value)) * max(1.0, math.sqrt(self.n))
        if np.isfinite(value) and value <= self.value + slack:
            self.beta, self.steps = self.trial(), self.steps + 1
            self.value, self.grad, self.hess, self.separated = found
            self.next(most)
        elif self.halved + 1 < HALVINGS:
            self.halved += 1
        else:
            self.move = None

    def usable(self) -> bool:
        """A settled optimum, away from separation, whose information is well conditioned whatever the scales."""
        own = np.diag(self.hess)
        if not np.isfinite(self.beta).all() or self.separated or np.abs(self.beta).max() > LIMITS["logit"]:
            return False
        if own.min() < LIMITS["least_information"] or self.decrement() > SETTLED:
            return False
        eigen = np.linalg.eigvalsh(self.hess / np.sqrt(np.outer(own, own)))
        return eigen[0] >= LIMITS["least_reciprocal_condition"] * eigen[-1]


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _matrix(row, name: str, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    for i, j in _pairs(k):
        out[i, j] = out[j, i] = row[f"{name}{i}_{j}"] or 0.0
    return out


def _stack(df: DataFrame, models: Sequence[Model], cluster: str) -> DataFrame:
    """``model, y, g, x`` of every row for each model that it is complete and finite for."""
    rows = []
    for k, m in enumerate(models):
        xs = m.columns()
        ok = F.col(m.outcome).isNotNull() & F.col(cluster).isNotNull()
        for x in xs:
            ok = ok & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        if m.where is not None:
            ok = ok & m.where
        rows.append(F.when(F.coalesce(ok, F.lit(False)), F.struct(F.lit(k).alias("model"), F.col(m.outcome).cast("double").alias("y"), F.array(*xs).alias("x"))))
    return df.select(F.col(cluster).alias("g"), F.explode(F.array_compact(F.array(*rows))).alias("r")).select("r.model", "r.y", "g", "r.x")


def _known(rows: DataFrame, width: int) -> dict[int, dict]:
    """Counts, clusters, means and deviations by model."""
    per = rows.groupBy("model", "g").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"), F.count_if((F.col("y") != 0) & (F.col("y") != 1)).alias("bad"))
    counts = per.groupBy("model").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.count(F.lit(1)).alias("g"), F.count_if(F.col("p") > 0).alias("pg"), F.sum("bad").alias("bad"))
    x = [F.get("x", F.lit(i)) for i in range(width)]
    moments = rows.groupBy("model").agg(*[F.mean(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(x)])
    return {r["model"]: r.asDict() for r in counts.join(moments, "model").collect()}


def _at(rows: DataFrame, points: dict[int, np.ndarray], width: int) -> DataFrame:
    """``model, y, g``, each standardised predictor (``z0`` is 1) and the linear predictor ``e``, for the models of ``points``."""
    given = rows.sparkSession.createDataFrame([(k, [float(v) for v in b]) for k, b in points.items()], "model int, beta array<double>")
    joined = rows.join(F.broadcast(given), "model")  # one row a model
    e = F.aggregate(F.zip_with("z", "beta", lambda z, b: z * b), F.lit(0.0), lambda a, v: a + v)
    return joined.select("model", "y", "g", e.alias("e"), *[F.get("z", F.lit(i)).alias(f"z{i}") for i in range(width)])


def _evaluate(rows: DataFrame, points: dict[int, np.ndarray], width: int) -> dict[int, tuple]:
    """Loss, gradient, information and perfect separation of each model at its point: one job."""
    e, y = F.col("e"), F.col("y")
    work = _at(rows, points, width).withColumn("p", 1 / (1 + F.exp(-e)))
    work = work.withColumns({"u": F.col("p") - y, "w": F.col("p") * (1 - F.col("p"))})
    loss = F.greatest(e, F.lit(0.0)) + F.log1p(F.exp(-F.abs(e))) - y * e
    found = work.groupBy("model").agg(
        F.sum(loss).alias("f"),
        F.count_if((e > 0) != (y == 1)).alias("miss"),
        *[F.sum(F.col("u") * F.col(f"z{i}")).alias(f"g{i}") for i in range(width)],
        *[F.sum(F.col("w") * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"h{i}_{j}") for i, j in _pairs(width)],
    )
    out = {}
    for r in found.collect():
        k = len(points[r["model"]])
        out[r["model"]] = (r["f"], np.array([r[f"g{i}"] for i in range(k)]), _matrix(r, "h", k), r["miss"] == 0)
    return out


def _cluster_scores(rows: DataFrame, points: dict[int, np.ndarray], width: int) -> dict[int, np.ndarray]:
    """Sums of outer products of cluster scores by model."""
    u = F.col("y") - 1 / (1 + F.exp(-F.col("e")))
    per = _at(rows, points, width).groupBy("model", "g").agg(*[F.sum(u * F.col(f"z{i}")).alias(f"s{i}") for i in range(width)])
    total = per.groupBy("model").agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i, j in _pairs(width)])
    return {r["model"]: _matrix(r, "m", len(points[r["model"]])) for r in total.collect()}


def _per_unit(beta: np.ndarray, cov: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and covariance for predictors as they were given; the intercept takes up their means."""
    unit = np.r_[1.0, scale]
    b, c = beta / unit, cov / np.outer(unit, unit)
    b[0] -= mean @ b[1:]
    shared = c[0, 1:] - mean @ c[1:, 1:]
    c[0, 0] += mean @ c[1:, 1:] @ mean - 2 * mean @ c[0, 1:]
    c[0, 1:] = c[1:, 0] = shared
    return b, c


def fit_logits(df: DataFrame, models: Sequence[Model], cluster: str, max_iter: int = 50) -> list[dict]:
    """Unpenalised logistic fits on standardised predictors with CR1 covariance, one result per model in their order.

    The first term is reported per unit and per ``reporting_sd`` (its own deviation if null); parameters and covariance of
    all terms on the original scale are returned for contrasts. Rows that are null or not finite in a model's columns
    take no part in it. An outcome other than 0 and 1 is an error; what can't be fitted has its ``model_status`` and nulls.
    """
    if not models:
        return []
    width = max(len(m.terms) for m in models)
    stacked = _stack(df, models, cluster)
    known = _known(stacked, width)
    results, states = [], {}
    for k, m in enumerate(models):
        b = known.get(k) or {"n": 0, "p": 0.0, "g": 0, "pg": 0, "bad": 0} | {f"{c}{i}": None for c in "ms" for i in range(width)}
        n, pos, size = b["n"], b["p"], len(m.terms) + 1
        results.append(
            {
                "terms": ["intercept", *m.terms], "n": n, "positive_n": int(pos), "cluster_count": b["g"], "positive_clusters": b["pg"],
                "outcome_prevalence": pos / n if n else None, "predictor_sd": b["s0"] if m.reporting_sd is None else m.reporting_sd,
                "iterations": 0, "model_status": "insufficient_data", **dict.fromkeys(_FIELDS),
            }
        )
        if n <= size or b["g"] < 2 or pos in (0, n):
            continue
        if b["bad"]:
            raise ValueError("logistic response must be 0 or 1")
        mean, scale = (np.array([b[f"{c}{i}"] or 0.0 for i in range(size - 1)]) for c in "ms")
        if np.any(scale <= LIMITS["least_spread"] * np.maximum(1, np.abs(mean))):
            results[k]["model_status"] = "constant_predictor"
            continue
        states[k] = _State(list(m.terms), n, mean, scale, np.r_[math.log(pos / (n - pos)), np.zeros(size - 1)])
    if not states:
        return results
    shape = df.sparkSession.createDataFrame([(k, s.mean.tolist(), s.scale.tolist()) for k, s in states.items()], "model int, m array<double>, s array<double>")
    z = F.concat(F.array(F.lit(1.0)), F.zip_with(F.zip_with("x", "m", lambda x, m: x - m), "s", lambda x, s: x / s))
    rows = durable(stacked.join(F.broadcast(shape), "model").select("model", "y", "g", z.alias("z")))  # one row a model
    width += 1
    for k, found in _evaluate(rows, {k: s.beta for k, s in states.items()}, width).items():
        s, p = states[k], results[k]["outcome_prevalence"]
        s.value, s.grad, s.hess, s.separated = found
        # at equal probabilities the information is the predictors' correlations
        if np.linalg.eigvalsh(s.hess / (s.n * p * (1 - p)))[0] <= LIMITS["least_rank"]:
            results[k]["model_status"] = "rank_deficient"
            continue
        s.next(max_iter)
    states = {k: s for k, s in states.items() if results[k]["model_status"] != "rank_deficient"}
    while tried := {k: s.trial() for k, s in states.items() if s.move is not None}:
        for k, found in _evaluate(rows, tried, width).items():
            states[k].take(found, max_iter)
    for k, s in states.items():
        results[k] |= {"max_score": float(np.abs(s.grad).max()), "information_condition": float(np.linalg.cond(s.hess)), "iterations": s.steps, "model_status": "ok" if s.usable() else "unstable_or_separated"}
    fitted = {k: s for k, s in states.items() if results[k]["model_status"] == "ok"}
    meats = _cluster_scores(rows, {k: s.beta for k, s in fitted.items()}, width) if fitted else {}
    for k, s in fitted.items():
        results[k] |= _report(results[k], s, meats[k])
    return results


def _report(known: dict, s: _State, meat: np.ndarray) -> dict:
    n, g, pos, sd = known["n"], known["cluster_count"], known["positive_n"], known["predictor_sd"]
    bread = np.linalg.inv(s.hess)
    b, cov = _per_unit(s.beta, bread @ meat @ bread * (g / (g - 1)) * ((n - 1) / (n - len(s.beta))), s.mean, s.scale)
    coef, se = float(b[1]), math.sqrt(max(0.0, float(cov[1, 1])))
    low, high = (coef + sign * t_quantile(0.975, g - 1) * se for sign in (-1, 1))
    null = pos * math.log(pos / n) + (n - pos) * math.log1p(-pos / n)
    return {
        "coefficient": coef, "cluster_se": se, "coefficient_ci_low": low, "coefficient_ci_high": high, "odds_ratio": math.exp(coef),
        "odds_ratio_1sd": math.exp(coef * sd), "or_1sd_ci_low": math.exp(low * sd), "or_1sd_ci_high": math.exp(high * sd),
        "log_likelihood": -s.value, "mcfadden_r2": 1 + s.value / null, "parameters": b, "covariance": cov,
    }


def logit_cr1(df: DataFrame, outcome: str, predictor: str, controls: Sequence[str], cluster: str, reporting_sd: float | None = None, max_iter: int = 50) -> dict:
    """One fit of ``fit_logits``."""
    return fit_logits(df, [Model(outcome, {c: c for c in (predictor, *controls)}, reporting_sd=reporting_sd)], cluster, max_iter)[0]


def linear_contrast(fit: dict, weights: dict[str, float]) -> dict:
    """Estimate, error, odds ratio and interval of a weighted sum of coefficients."""
    if fit.get("parameters") is None or fit.get("covariance") is None:
        return dict.fromkeys(("estimate", "se", "odds_ratio", "or_ci_low", "or_ci_high"))
    v = np.array([weights.get(t, 0.0) for t in fit["terms"]])
    est = float(v @ fit["parameters"])
    se = math.sqrt(max(0.0, float(v @ fit["covariance"] @ v)))
    margin = t_quantile(0.975, fit["cluster_count"] - 1) * se
    return {
        "estimate": est, "se": se, "odds_ratio": math.exp(est), "or_ci_low": math.exp(est - margin), "or_ci_high": math.exp(est + margin),
    }


LOGIT_SCHEMA = (
    "n bigint, positive_n bigint, cluster_count bigint, positive_clusters bigint, outcome_prevalence double, predictor_sd double, "
    + ", ".join(f"{f} double" for f in _FIELDS)
    + ", iterations int, model_status string"
)


def fits_table(spark: SparkSession, labels: str, rows: Sequence[tuple[tuple, dict]]) -> DataFrame:
    """Label columns followed by the reported fields of each fit."""
    names = [c.strip().split(" ")[0] for c in LOGIT_SCHEMA.split(",")]
    num = lambda v: float(v) if isinstance(v, np.floating) else v
    return spark.createDataFrame([(*lab, *[num(fit.get(c)) for c in names]) for lab, fit in rows], f"{labels}, {LOGIT_SCHEMA}")
