"""Overlapping k-action windows over consecutive anchors, motifs and their outcomes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product
from operator import and_

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.functions import points as P
from strideframe.operators.events import starting_third
from strideframe.operators.logistic import Model, fit_logits, linear_contrast
from strideframe.operators.models import ols_cr1_multi, t_quantile
from strideframe.operators.ordered import Lane, Shift, scan
from strideframe.operators.quantiles import distribution, exact_quantiles

ALPHABET = {"action": "PC", "direction": "FR"}


def motif_labels(k: int, system: str = "action") -> list[str]:
    """Every label of length k, so that absent motifs appear."""
    return ["".join(p) for p in product(ALPHABET[system], repeat=k)]


def windows(anchors: DataFrame, eligible: DataFrame, lane: Lane, ks: Sequence[int], own: int, responses: Sequence[str]) -> DataFrame:
    """All chains of k + 1 consecutive anchors with the first failing reason.

    anchors: anchor_order, member_order, seconds_from_previous, intervening_events and
    the responses; eligible: one row per eligible FROM event.  Nothing is skipped: a
    chain is the anchor and its next k neighbours, read with ``lead``.
    """
    a = eligible.select(
        F.col("match_id").alias("__m"),
        F.col("from_event_id").alias("__e"),
        F.col("action_type").alias("__type"),
        F.col("action_delta_x").alias("__dx"),
        F.col("action_start_x").alias("__sx"),
        F.col("action_end_x").alias("__ex"),
    )
    j = anchors.join(a, (F.col("match_id") == F.col("__m")) & (F.col("event_id") == F.col("__e")), "left")
    reason = (
        F.when(F.col("event_team_id") != own, "opponent_from_anchor")
        .when(~F.col("event_type").isin("Pass", "Carry"), "non_pass_carry_from_anchor")
        .when(F.col("__e").isNull(), "not_eligible_progression")
    )
    values = [
        F.struct(F.when(F.col(f"{r}_available"), F.col(r)).alias("v"), F.col(f"{r}_status").alias("s"), F.col(f"{r}_available").alias("ok")).alias(r)
        for r in responses
    ]
    flags = ["frame_oob", "frame_oob_unknown", "frame_coincident", "frame_coincident_unknown"]
    state = F.struct(
        F.col("event_id").alias("id"),
        F.col("event_index").alias("idx"),
        F.col("t_us").alias("t"),
        F.col("event_type").alias("type"),
        F.col("event_team_id").alias("team"),
        F.col("member_order").alias("m"),
        F.col("seconds_from_previous").alias("gap"),
        F.col("intervening_events").alias("between"),
        reason.alias("reason"),
        F.substring("__type", 1, 1).alias("letter"),
        F.col("__dx").alias("dx"),
        F.col("__sx").alias("sx"),
        F.col("__ex").alias("ex"),
        *flags,
        *values,
    )
    rows = j.select(*lane.keys, *[o for o in lane.order if o not in lane.keys], "anchor_order", state.alias("s0"))
    rows = scan(rows, lane, {f"s{i}": Shift("s0", -i) for i in range(1, max(ks) + 1)})
    chains = [
        F.when(
            F.col(f"s{k}").isNotNull(), F.struct(F.lit(k).alias("window_length"), F.array(*[F.col(f"s{i}") for i in range(k + 1)]).alias("states"))
        )
        for k in ks
    ]
    out = rows.select(*lane.keys, "anchor_order", F.inline(F.array_compact(F.array(*chains))))
    legs = "slice(states, 1, window_length)"
    failed = f"element_at(filter(transform({legs}, s -> s.reason), r -> r IS NOT NULL), 1)"
    return out.withColumn(
        "selection_reason", F.expr(f"CASE WHEN exists({legs}, s -> s.reason IS NOT NULL) THEN {failed} ELSE 'eligible' END")
    )


def window_audit(chains: DataFrame) -> DataFrame:
    """The denominator of chains split by reason."""
    return chains.groupBy("window_length", "selection_reason").agg(F.count(F.lit(1)).alias("n"))


def window_rows(chains: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Motif, direction, progression and gaps of each eligible window."""
    w = chains.where("selection_reason = 'eligible'")
    legs, ends = "slice(states, 1, window_length)", "slice(states, 2, window_length)"
    dx, gaps = f"transform({legs}, s -> s.dx)", f"transform({ends}, s -> s.gap)"
    add = lambda a: f"aggregate({a}, 0.0D, (t, v) -> t + v)"
    first, last = "element_at(states, 1)", "element_at(states, -1)"
    cols = {
        "window_id": f"concat_ws(':', {', '.join(keys)}, concat('k', window_length), concat('a', anchor_order))",
        "action_type_motif": f"array_join(transform({legs}, s -> s.letter), '')",
        "direction_profile": f"array_join(transform({dx}, v -> CASE WHEN v > 0 THEN 'F' ELSE 'R' END), '')",
        "carry_action_count": f"size(filter({legs}, s -> s.letter = 'C'))",
        "total_progression": add(dx),
        "total_positive_progression": add(f"transform({dx}, v -> greatest(v, 0D))"),
        "total_nonpositive_magnitude": add(f"transform({dx}, v -> greatest(-v, 0D))"),
        "first_action_start_x": f"{first}.sx",
        "final_action_end_x": f"element_at({legs}, -1).ex",
        "net_action_progression": f"element_at({legs}, -1).ex - {first}.sx",
        "duration_seconds": f"({last}.t - {first}.t) / 1e6D",
        "maximum_leg_gap": f"array_max({gaps})",
        "mean_leg_gap": P.mean(gaps),
        "median_leg_gap": P.median(f"sort_array({gaps})"),
        "intervening_event_count": f"aggregate({ends}, 0L, (t, s) -> t + s.between)",
        "event_span_steps": f"{last}.m - {first}.m",
        "terminal_event_id": f"{last}.id",
        "terminal_event_type": f"{last}.type",
        "terminal_event_team_id": f"{last}.team",
        "start_event_id": f"{first}.id",
        **{f"any_{f}": f"exists(states, s -> s.{f})" for f in ("frame_oob", "frame_oob_unknown", "frame_coincident", "frame_coincident_unknown")},
    }
    out = w.withColumns({n: F.expr(e) for n, e in cols.items()})
    return out.withColumn("starting_third", starting_third("first_action_start_x"))


def window_geometry(win: DataFrame, responses: Sequence[str]) -> DataFrame:
    """Start, end, net, observed range and per-leg change of each response.

    Membership never depends on availability; a missing end gives a status instead.
    """
    cols = {}
    for r in responses:
        s, e = f"element_at(states, 1).{r}", f"element_at(states, -1).{r}"
        seen = f"filter(transform(states, s -> s.{r}.v), v -> v IS NOT NULL)"
        cols[f"start_{r}"], cols[f"end_{r}"] = f"{s}.v", f"{e}.v"
        cols[f"net_{r}"] = f"{e}.v - {s}.v"
        cols[f"net_{r}_status"] = (
            f"CASE WHEN {s}.ok AND {e}.ok THEN 'ok' WHEN NOT {s}.ok AND NOT {e}.ok THEN 'both_endpoints_unavailable' "
            f"WHEN NOT {s}.ok THEN 'start_endpoint_unavailable' ELSE 'end_endpoint_unavailable' END"
        )
        cols[f"observed_{r}_count"] = f"size({seen})"
        cols[f"observed_{r}_min"], cols[f"observed_{r}_max"] = f"array_min({seen})", f"array_max({seen})"
        cols[f"observed_{r}_range"] = f"array_max({seen}) - array_min({seen})"
        cols[f"observed_{r}_status"] = (
            f"CASE WHEN size({seen}) = size(states) THEN 'complete' WHEN size({seen}) > 0 THEN 'partial_available_states' ELSE 'unavailable' END"
        )
        if r.endswith("centroid_x"):
            cols[f"maximum_{r}_advance"] = f"CASE WHEN {s}.ok THEN greatest(0D, array_max({seen}) - {s}.v) END"
            cols[f"maximum_{r}_reversal"] = f"CASE WHEN {s}.ok THEN greatest(0D, {s}.v - array_min({seen})) END"
        for i in (1, 2, 3):
            cols[f"leg_{i}_delta_{r}"] = (
                f"CASE WHEN window_length >= {i} THEN get(states, {i}).{r}.v - get(states, {i - 1}).{r}.v END"
            )
    return win.withColumns({n: F.expr(e) for n, e in cols.items()})


def window_scopes(gaps: dict[str, float], own: int) -> dict[str, Column]:
    none = lambda f: ~F.col(f"any_frame_{f}") & ~F.col(f"any_frame_{f}_unknown")
    return {
        "all": F.lit(True),
        **{n: F.col("maximum_leg_gap") <= s for n, s in gaps.items()},
        "terminal_own": F.col("terminal_event_team_id") == own,
        "exclude_oob": none("oob"),
        "exclude_coincidence": none("coincident"),
    }


def label_table(spark: SparkSession, system: str, ks: Sequence[int] = (2, 3)) -> DataFrame:
    return spark.createDataFrame([(k, m) for k in ks for m in motif_labels(k, system)], "window_length int, motif string")


def motif_summary(scoped: DataFrame, system: str, session: Sequence[str], values: Sequence[str], small: bool) -> DataFrame:
    """N, matches, sessions, share, and for each value its count, quartiles and their distance, per motif and scope; absent motifs have N = 0."""
    field = "action_type_motif" if system == "action" else "direction_profile"
    data = scoped.withColumn("motif", F.col(field))
    by = ["window_length", "scope", "motif"]
    per = data.groupBy(*by, *session).agg(F.count(F.lit(1)).alias("w"))
    agg = per.groupBy(*by).agg(
        F.sum("w").alias("n"), F.count(F.lit(1)).alias("sessions"), F.count_distinct("match_id").alias("matches")
    )
    total = agg.groupBy("window_length", "scope").agg(F.sum("n").alias("scope_windows"))
    grid = total.join(F.broadcast(label_table(scoped.sparkSession, system)), "window_length")  # 2^k labels
    out = grid.join(agg, by, "left")
    # all values in one pass: a row a window and value that is there, quartiles by value name, one row a motif again
    pairs = F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("v")) for v in values])
    long = data.select(*by, F.inline(pairs)).where("v IS NOT NULL")
    spread = exact_quantiles(long, [*by, "name"], "v", {"q25": 0.25, "median": 0.5, "q75": 0.75}, small)
    spread = spread.join(long.groupBy(*by, "name").agg(F.count(F.lit(1)).alias("known")), [*by, "name"])
    mine = lambda v, c: F.max(F.when(F.col("name") == v, F.col(c)))
    wide = spread.groupBy(*by).agg(*[mine(v, c).alias(f"{v}_{c}") for v in values for c in ("known", "q25", "median", "q75")])
    out = out.join(wide, by, "left").withColumns({f"{v}_known": F.coalesce(f"{v}_known", F.lit(0)) for v in values})
    out = out.withColumns({f"{v}_iqr": F.col(f"{v}_q75") - F.col(f"{v}_q25") for v in values})
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n", "sessions", "matches")}
    return out.withColumns(zero).withColumn("share_of_windows", F.round(F.col("n") / F.col("scope_windows"), 6))


def motif_sensitivity(summary: DataFrame, value: str) -> DataFrame:
    """Each scope's median against the whole sample."""
    base = summary.where("scope = 'all'").select("window_length", "motif", F.col("n").alias("primary_n"), F.col(f"{value}_median").alias("primary_median"))
    j = summary.where("scope <> 'all'").join(base, ["window_length", "motif"])
    return j.select(
        "window_length",
        "motif",
        "scope",
        "n",
        "primary_n",
        (F.col(f"{value}_median") - F.col("primary_median")).alias("median_difference"),
        (F.signum(f"{value}_median") == F.signum("primary_median")).alias("sign_preserved"),
    )


def motif_support(win: DataFrame, session: Sequence[str], small: bool) -> DataFrame:
    """Windows per represented match, and sessions, per motif."""
    by = ["window_length", F.col("action_type_motif").alias("motif")]
    per = win.groupBy(*by, "match_id").agg(F.count(F.lit(1)).alias("w"))
    agg = per.groupBy("window_length", "motif").agg(
        F.sum("w").alias("n"), F.count(F.lit(1)).alias("matches"), F.min("w").alias("min_per_match"), F.max("w").alias("max_per_match")
    )
    med = exact_quantiles(per, ["window_length", "motif"], "w", {"median_per_match": 0.5}, small)
    sess = win.select(*by, *session).distinct().groupBy("window_length", "motif").agg(F.count(F.lit(1)).alias("sessions"))
    out = label_table(win.sparkSession, "action")
    for part in (agg, med, sess):
        out = out.join(part, ["window_length", "motif"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "matches", "sessions")})


def adjusted_contrasts(win: DataFrame, k: int, response: str) -> DataFrame:
    """Three nested linear models with motif dummies; the first present motif is the reference."""
    data = win.where((F.col("window_length") == k) & F.col(response).isNotNull())
    have = {r["action_type_motif"]: r["n"] for r in data.groupBy("action_type_motif").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 2^k rows
    present = [m for m in motif_labels(k) if m in have]
    schema = "model string, term string, reference_motif string, motif_n bigint, coefficient double, cluster_se double, ci_low double, ci_high double, r_squared double, n bigint, status string"
    rows = []
    dummies = [f"motif_{m}" for m in present[1:]]
    coded = data.withColumns({f"motif_{m}": (F.col("action_type_motif") == m).cast("double") for m in present[1:]})
    designs = {
        "progression_only": ["total_progression"],
        "progression_plus_motif": ["total_progression", *dummies],
        "progression_motif_start_x": ["total_progression", *dummies, "first_action_start_x"],
    }
    for model, xs in designs.items() if present else ():
        fit = ols_cr1_multi(coded, response, xs, "match_id")
        for i, term in enumerate(fit["terms"]):
            pick = lambda key: float(fit[key][i]) if fit.get(key) is not None else None  # noqa: B023, E731
            rows.append((model, term, present[0], have.get(term[6:]) if term.startswith("motif_") else None, pick("parameters"), pick("se"),
                         pick("ci_low"), pick("ci_high"), fit.get("r_squared"), fit["n"], fit["status"]))
    return win.sparkSession.createDataFrame(rows, schema)


def join_terminal_outcomes(win: DataFrame, outcomes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Outcome labels of the terminal anchor; ``outcome_missing`` marks an absent identity."""
    o = outcomes.select(F.col("match_id").alias("__m"), F.col("event_id").alias("__e"), *columns)
    j = win.join(o, (F.col("match_id") == F.col("__m")) & (F.col("terminal_event_id") == F.col("__e")), "left")
    return j.withColumn("outcome_missing", F.col("__e").isNull()).drop("__m", "__e")


def exact_mean(x: Column) -> Column:
    """Mean whose sum doesn't depend on the order of rows: values count to twelve decimals."""
    return F.sum(x.cast("decimal(38,12)")).cast("double") / F.count(x)


def effectiveness_description(win: DataFrame, by: Sequence[str], horizon: str, small: bool) -> DataFrame:
    """Raw outcome rates per group."""
    x = F.col(f"future_xg_{horizon}")
    out = win.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("match_id").alias("matches"),
        F.sum(f"box_entry_within_{horizon}").alias("box_entry_n"),
        F.mean(f"box_entry_within_{horizon}").alias("box_entry_rate"),
        F.sum(f"shot_within_{horizon}").alias("shot_n"),
        F.mean(f"shot_within_{horizon}").alias("shot_rate"),
        exact_mean(x).alias("mean_future_xg"),
        F.mean((x > 0).cast("int")).alias("proportion_positive_xg"),
        exact_mean(F.when(x > 0, x)).alias("mean_positive_xg"),
        F.count_if(x.isNull()).alias("missing_xg_n"),
    )
    q = exact_quantiles(win, by, "total_progression", {"median_total_progression": 0.5}, small)
    return out.join(q, list(by), "left")


CONTROLS = ("total_progression", "first_action_start_x", "duration_seconds")
MODEL_SCHEMA = (
    "scope string, target string, motif string, motif_n bigint, motif_positive_n bigint, model_n bigint, status string, coefficient double, "
    "cluster_se double, odds_ratio double, or_ci_low double, or_ci_high double, predicted_probability double, probability_ci_low double, "
    "probability_ci_high double, mcfadden_r2 double, delta_mcfadden_r2 double"
)


def _expit(v: float) -> float:
    return 1 / (1 + math.exp(-v)) if v >= 0 else math.exp(v) / (1 + math.exp(v))


def prediction(fit: dict, point: dict[str, float]) -> tuple[float, float, float]:
    """Probability and interval at a point given per term (intercept included)."""
    v = np.array([1.0 if t == "intercept" else point.get(t, 0.0) for t in fit["terms"]])
    eta = float(v @ fit["parameters"])
    margin = t_quantile(0.975, fit["cluster_count"] - 1) * math.sqrt(max(0.0, float(v @ fit["covariance"] @ v)))
    return _expit(eta), _expit(eta - margin), _expit(eta + margin)


def motif_logits(win: DataFrame, k: int, requests: Sequence[tuple[str, str, Column | None]], medians: dict[str, float], extra: Sequence[str] = ()) -> list[tuple]:
    """Motif contrasts and predicted probabilities for each (scope, target, mask); cells with a single outcome are left out.

    Rows follow MODEL_SCHEMA: one per motif, and PC against CP for two actions. The cells of all requests are one
    aggregation by motif, and all their models are fitted together.
    """
    controls, labels = [*CONTROLS, *extra], motif_labels(k)
    whole = [c.isNotNull() & ~F.isnan(c) for c in (F.col(x).cast("double") for x in controls)]
    masks = []
    for _, target, mask in requests:
        keep = reduce(and_, [*whole, F.col("window_length") == k, F.col(target).isNotNull()])
        masks.append(F.coalesce(keep if mask is None else keep & mask, F.lit(False)))
    counts = win.groupBy(F.col("action_type_motif").alias("m")).agg(
        *[F.count_if(m).alias(f"n{i}") for i, m in enumerate(masks)], *[F.sum(F.when(m, F.col(t))).alias(f"p{i}") for i, (m, (_, t, _)) in enumerate(zip(masks, requests, strict=True))]
    )
    table = {r["m"]: r for r in counts.collect()}  # 2^k rows
    cells = [{m: (r[f"n{i}"], r[f"p{i}"]) for m, r in table.items() if r[f"n{i}"]} for i in range(len(requests))]
    pure = [[m for m, (n, p) in c.items() if p in (0, n)] for c in cells]
    used = [[m for m in labels if m in c and m not in gone] for c, gone in zip(cells, pure, strict=True)]
    models, place = [], []
    for i, (scope, target, _) in enumerate(requests):
        at = [None, None]
        if labels[0] in used[i]:
            where = masks[i] & F.col("action_type_motif").isin(used[i])
            dummies = {f"motif_{m}": (F.col("action_type_motif") == m).cast("double") for m in used[i] if m != labels[0]}
            plain = {c: c for c in controls}
            at[0] = len(models)
            models.append(Model(target, dummies | plain, where))
            if scope == "all":
                at[1] = len(models)
                models.append(Model(target, plain, where))
        place.append(at)
    fits = fit_logits(win, models, "match_id")
    none, rows = linear_contrast({}, {}), []
    for i, (scope, target, _) in enumerate(requests):
        fit = {"model_status": "reference_missing_or_separated", "n": sum(cells[i][m][0] for m in used[i]), "terms": []} if place[i][0] is None else fits[place[i][0]]
        done, gain = fit["model_status"] == "ok", None
        if done and place[i][1] is not None and (base := fits[place[i][1]]["mcfadden_r2"]) is not None:
            gain = fit["mcfadden_r2"] - base
        spread = lambda c: (c["estimate"], c["se"], c["odds_ratio"], c["or_ci_low"], c["or_ci_high"])
        for m in labels:
            n, p = cells[i].get(m, (0, 0))
            status = "separated_motif_cell" if m in pure[i] else "absent_motif" if not n else fit["model_status"]
            mark = {} if m == labels[0] else {f"motif_{m}": 1.0}
            c, seen = (linear_contrast(fit, mark), prediction(fit, {**mark, **medians})) if status == "ok" else (none, (None, None, None))
            rows.append((scope, target, m, n, int(p), fit["n"], status, *spread(c), *seen, fit.get("mcfadden_r2"), gain))
        if k == 2:
            can = done and {"motif_PC", "motif_CP"} <= set(fit["terms"])
            c = linear_contrast(fit, {"motif_PC": 1.0, "motif_CP": -1.0}) if can else none
            rows.append((scope, target, "PC_vs_CP", None, None, fit["n"], "ok" if can else "contrast_not_estimable", *spread(c), None, None, None, fit.get("mcfadden_r2"), gain))
    return rows


def motif_logit(win: DataFrame, k: int, target: str, medians: dict[str, float], scope: str = "all", extra: Sequence[str] = ()) -> list[tuple]:
    """One request of ``motif_logits`` over all rows."""
    return motif_logits(win, k, [(scope, target, None)], medians, extra)


def effectiveness_analyze(win: DataFrame, scopes: dict[str, Column], horizons: Sequence[str], main: str, small: bool) -> DataFrame:
    """The list of motif models: main horizon, other horizons, and every scope, fitted together."""
    pairs = win.where("window_length = 2")
    med = exact_quantiles(pairs.select(F.lit(1).alias("o"), *CONTROLS), ["o"], CONTROLS[0], {CONTROLS[0]: 0.5}, small)
    for c in CONTROLS[1:]:
        med = med.join(exact_quantiles(pairs.select(F.lit(1).alias("o"), c), ["o"], c, {c: 0.5}, small), "o")
    first = med.first()
    medians = {c: first[c] for c in CONTROLS} if first else {}
    requests = [("all", f"box_entry_within_{h}", None) for h in horizons]
    requests += [(name, f"box_entry_within_{main}", mask) for name, mask in scopes.items() if name != "all"]
    requests.append(("all", f"shot_within_{main}", None))
    return win.sparkSession.createDataFrame(motif_logits(win, 2, requests, medians), MODEL_SCHEMA)


def window_sample_tables(win: DataFrame, response: str, small: bool) -> DataFrame:
    """Per-length sample profile with duration and gap quantiles."""
    out = win.groupBy("window_length").agg(
        F.count(F.lit(1)).alias("eligible_windows"),
        F.count_distinct("match_id").alias("matches"),
        F.count_if(F.col(response).isNotNull()).alias("endpoint_n"),
        F.count_if(F.col("intervening_event_count") == 0).alias("zero_intervening"),
    )
    d = distribution(win, ["window_length"], "duration_seconds", small, {"duration_q25": 0.25, "duration_median": 0.5, "duration_q75": 0.75, "duration_p90": 0.9})
    d = d.select("window_length", "duration_q25", "duration_median", "duration_q75", "duration_p90", F.col("max").alias("duration_max"))
    g = exact_quantiles(win, ["window_length"], "maximum_leg_gap", {"gap_median": 0.5, "gap_p95": 0.95}, small)
    return out.join(d, "window_length").join(g, "window_length")


def motif_third_counts(win: DataFrame) -> DataFrame:
    """Motif by starting third with the share inside the third."""
    c = win.groupBy("window_length", F.col("action_type_motif").alias("motif"), "starting_third").agg(F.count(F.lit(1)).alias("n"))
    t = c.groupBy("window_length", "starting_third").agg(F.sum("n").alias("__t"))
    return c.join(t, ["window_length", "starting_third"]).select(
        "window_length", "motif", "starting_third", "n", F.round(100 * F.col("n") / F.col("__t"), 6).alias("share_within_third_pct")
    )


def motif_direction_crosstab(win: DataFrame, k: int) -> DataFrame:
    return win.where(F.col("window_length") == k).groupBy(F.col("action_type_motif").alias("motif")).pivot(
        "direction_profile", motif_labels(k, "direction")
    ).count().na.fill(0)


def between_group_reduction(win: DataFrame, response: str) -> DataFrame:
    """Weighted variance of motif means before and after removing the progression fit."""
    ok = win.where(F.col(response).isNotNull()).withColumns({"__y": F.col(response), "__x": F.col("total_progression")})
    fit = ok.groupBy("window_length").agg(
        F.mean("__x").alias("mx"), F.mean("__y").alias("my"), (F.covar_pop("__x", "__y") / F.nullif(F.var_pop("__x"), F.lit(0.0))).alias("b")
    )
    cell = ok.groupBy("window_length", "action_type_motif").agg(F.count(F.lit(1)).alias("n"), F.mean("__x").alias("cx"), F.mean("__y").alias("cy"))
    j = cell.join(F.broadcast(fit), "window_length")  # one row per window length
    raw = F.col("cy") - F.col("my")
    res = raw - F.col("b") * (F.col("cx") - F.col("mx"))
    out = j.groupBy("window_length").agg(
        (F.sum(raw * raw * F.col("n")) / F.sum("n")).alias("raw_variance"), (F.sum(res * res * F.col("n")) / F.sum("n")).alias("residual_variance")
    )
    return out.withColumn("reduction_pct", 100 * (1 - F.col("residual_variance") / F.col("raw_variance")))


def typical_example(win: DataFrame, by: Sequence[str], keep: Column, support: str, values: Sequence[str], tie: Sequence[str], small: bool) -> DataFrame:
    """Per group, the supported window closest to the group's medians, in units of its IQR."""
    by = list(by)
    j = win
    for v in values:
        q = exact_quantiles(win, by, v, {f"__{v}_a": 0.25, f"__{v}_m": 0.5, f"__{v}_b": 0.75}, small)
        j = j.join(q, by)
    cand = j.where(keep)
    cand = cand.join(exact_quantiles(cand, by, support, {"__s": 0.5}, small), by).where(F.col(support) >= F.col("__s"))
    score = F.lit(0.0)
    for v in values:
        iqr = F.col(f"__{v}_b") - F.col(f"__{v}_a")
        score = score + F.when(iqr > 0, F.abs(F.col(v) - F.col(f"__{v}_m")) / iqr).otherwise(0.0)
    cand = cand.withColumn("distance", F.round(score, 9))
    return cand.groupBy(*by).agg(F.min(F.struct("distance", *tie)).alias("r")).select(*by, "r.*")
