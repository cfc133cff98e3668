"""Starting-context moderation: tertiles inside thirds and interaction models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.operators.logistic import Model, fit_logits, linear_contrast, logit_cr1
from strideframe.operators.quantiles import exact_quantiles
from strideframe.operators.windows import prediction


def attach_start_geometry(data: DataFrame, anchors: DataFrame, event_col: str, columns: Sequence[str]) -> DataFrame:
    """Geometry of the starting anchor, null where unavailable; ``start_missing`` marks no identity."""
    a = anchors.select(
        F.col("match_id").alias("__m"), F.col("event_id").alias("__e"), *[F.when(F.col(f"{c}_available"), F.col(c)).alias(f"start_{c}") for c in columns]
    )
    j = data.join(a, (F.col("match_id") == F.col("__m")) & (F.col(event_col) == F.col("__e")), "left")
    return j.withColumn("start_missing", F.col("__e").isNull()).drop("__m", "__e")


def fit_cutpoints(data: DataFrame, column: str, small: bool, third: str = "starting_third") -> DataFrame:
    """Tertile cuts inside each third, pooled over actions."""
    ok = data.where(F.col(column).isNotNull() & (F.col(third) != "outside_pitch"))
    n = ok.groupBy(third).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("raw_min"), F.max(column).alias("raw_max"))
    q = exact_quantiles(ok, [third], column, {"lower_cut": 1 / 3, "upper_cut": 2 / 3}, small)
    return n.join(q, third).withColumn("tied", F.col("lower_cut") >= F.col("upper_cut"))


def assign_contexts(data: DataFrame, cuts: DataFrame, column: str, name: str = "context", third: str = "starting_third") -> DataFrame:
    """1 + (above lower) + (above upper); equal values stay together, unavailable is null."""
    c = cuts.select(F.col(third).alias("__t"), "lower_cut", "upper_cut")
    j = data.join(F.broadcast(c), F.col(third) == F.col("__t"), "left")  # one row per third
    v = F.col(column)
    code = 1 + (v > F.col("lower_cut")).cast("int") + (v > F.col("upper_cut")).cast("int")
    label = F.when(code == 1, "low").when(code == 2, "middle").when(code == 3, "high")
    return j.withColumns({name: code, f"{name}_label": label}).drop("__t", "lower_cut", "upper_cut")


def context_description(data: DataFrame, by: Sequence[str], response: str, horizon: str, small: bool) -> DataFrame:
    """Cell counts, medians and rates."""
    x = F.col(f"future_xg_{horizon}")
    out = data.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("match_id").alias("matches"),
        F.sum(f"box_entry_within_{horizon}").alias("positive_n"),
        F.mean(f"box_entry_within_{horizon}").alias("box_entry_rate"),
        F.mean(f"shot_within_{horizon}").alias("shot_rate"),
        F.count(response).alias("response_n"),
        F.mean(response).alias("response_mean"),
        F.mean(x).alias("mean_future_xg"),
    )
    q = exact_quantiles(data, list(by), response, {"response_median": 0.5}, small)
    q = q.select(*[F.col(c).alias(f"__{c}") for c in by], "response_median")
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return out.join(q, on, "left").drop(*[f"__{c}" for c in by])


INTERACTION_SCHEMA = (
    "label string, record string, term string, context int, n bigint, status string, estimate double, se double, odds_ratio double, "
    "or_ci_low double, or_ci_high double, displacement_sd double, probability double, probability_ci_low double, probability_ci_high double"
)


def _row(label, record, term, context, fit, c=None, sd=None, p=(None, None, None)):
    c = c or linear_contrast({}, {})
    return (label, record, term, context, fit["n"], fit["model_status"], c["estimate"], c["se"], c["odds_ratio"], c["or_ci_low"], c["or_ci_high"], sd, *p)


def context_interaction_logits(data: DataFrame, response: str, target: str, controls: Sequence[str], groups: dict[str, tuple[Column, dict[str, float], float]]) -> list[tuple]:
    """Outcome on displacement per SD by tertile, with controls; slopes and predictions per context.

    groups: label -> (rows, medians of the controls, SD of the response); the models of all groups are fitted together.
    """
    models, second = [], {2: F.col("context") == 2, 3: F.col("context") == 3}
    for mask, _, sd in groups.values():
        step = F.col(response) / sd
        terms = {"per_sd": step, **{f"context_T{k}": m.cast("double") for k, m in second.items()}, **{f"per_sd_x_T{k}": step * m.cast("double") for k, m in second.items()}}
        models.append(Model(target, terms | {c: c for c in controls}, mask & F.col("context").isNotNull()))
    rows, named = [], ["per_sd", "context_T2", "context_T3", "per_sd_x_T2", "per_sd_x_T3"]
    for (label, (_, medians, _)), fit in zip(groups.items(), fit_logits(data, models, "match_id"), strict=True):
        ok = fit["model_status"] == "ok"
        rows += [_row(label, "coefficient", t, None, fit, linear_contrast(fit, {t: 1.0}) if ok else None) for t in named]
        for k in (1, 2, 3):
            slope = {"per_sd": 1.0} | ({f"per_sd_x_T{k}": 1.0} if k > 1 else {})
            rows.append(_row(label, "context_slope", None, k, fit, linear_contrast(fit, slope) if ok else None))
            for step in (-1.0, 0.0, 1.0) if ok else ():
                at = {"per_sd": step, **medians} | ({f"context_T{k}": 1.0, f"per_sd_x_T{k}": step} if k > 1 else {})
                rows.append(_row(label, "prediction", None, k, fit, None, step, prediction(fit, at)))
    return rows


def motif_context_logit(win: DataFrame, target: str, controls: Sequence[str], label: str) -> list[tuple]:
    """Outcome on motif by tertile interactions for two-action windows, with contrasts."""
    d = win.where("window_length = 2").dropna(subset=["context", target, *controls])
    motifs, terms = ("PC", "CP", "CC"), []
    for m in motifs:
        d = d.withColumn(f"motif_{m}", (F.col("action_type_motif") == m).cast("double"))
        terms.append(f"motif_{m}")
    for k in (2, 3):
        d = d.withColumn(f"context_T{k}", (F.col("context") == k).cast("double"))
        terms.append(f"context_T{k}")
        for m in motifs:
            d = d.withColumn(f"{m}_x_T{k}", F.col(f"motif_{m}") * F.col(f"context_T{k}"))
            terms.append(f"{m}_x_T{k}")
    fit = logit_cr1(d, target, terms[0], [*terms[1:], *controls], "match_id")
    ok = fit["model_status"] == "ok"
    rows = [_row(label, "coefficient", t, None, fit, linear_contrast(fit, {t: 1.0}) if ok else None) for t in terms]
    for k in (1, 2, 3) if ok else ():
        for name in (*motifs, "PC_vs_CP"):
            w = {}
            for m, sign in (("PC", 1.0), ("CP", -1.0)) if name == "PC_vs_CP" else ((name, 1.0),):
                w[f"motif_{m}"] = sign
                if k > 1:
                    w[f"{m}_x_T{k}"] = sign
            rows.append(_row(label, "contrast", name, k, fit, linear_contrast(fit, w)))
    return rows
