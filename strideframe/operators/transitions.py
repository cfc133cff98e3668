"""Anchors with snapshot geometry, consecutive transitions, and single-action change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.functions import points as P
from strideframe.operators.events import starting_third
from strideframe.operators.models import ols_cr1
from strideframe.operators.ordered import Lane, Scan, Shift, scan, shift
from strideframe.operators.quantiles import LADDER, distribution, exact_quantiles, spearman

SIDES = ("all", "own", "opp")


def event_context(stream: DataFrame) -> DataFrame:
    """Outcome-free projection of the stream; outcome columns never reach geometry."""
    return stream.select(*[c for c in stream.columns if c not in ("xg", "is_shot", "is_goal", "pass_outcome")])


def wide_geometry(geometry: DataFrame, frame: str, metrics: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Variant rows to one row per snapshot: goalkeepers excluded, plus included counts."""
    aggs = [F.first(c).alias(c) for c in carry]
    for s in ("all_visible", "teammate_true", "teammate_false"):
        at = (F.col("selected_subset") == s) & (F.col("goalkeeper_policy") == "excluded")
        inc = (F.col("selected_subset") == s) & (F.col("goalkeeper_policy") == "included")
        for m in (*metrics, "n_valid_points_used"):
            aggs.append(F.max(F.when(at, F.col(m))).alias(f"{s}__{m}"))
        for m in metrics:
            aggs.append(F.max(F.when(at, F.col(f"{m}_status"))).alias(f"{s}__{m}_status"))
        aggs.append(F.max(F.when(inc, F.col("n_valid_points_used"))).alias(f"{s}__keeper_included"))
    return geometry.groupBy(frame).agg(*aggs)


def attach_geometry(anchors: DataFrame, wide: DataFrame, frame: str, metrics: Sequence[str], own: int, length: float = 120.0, width: float = 80.0) -> DataFrame:
    """Map flags to sides, rotate centroids of other-team events, and mark availability.

    A value is available when its status is ok and the actor is single or absent.
    """
    j = anchors.join(wide, frame, "left")
    mine = F.col("event_team_id") == own
    pick = lambda side, m: (
        F.col(f"all_visible__{m}")
        if side == "all"
        else F.when(mine == F.lit(side == "own"), F.col(f"teammate_true__{m}")).otherwise(F.col(f"teammate_false__{m}"))
    )
    cols = {}
    for side in SIDES:
        for m in metrics:
            v = pick(side, m)
            if m in ("centroid_x", "centroid_y"):
                v = F.when(mine, v).otherwise((length if m == "centroid_x" else width) - v)
            status = pick(side, f"{m}_status")
            cols[f"{side}_{m}"] = v
            cols[f"{side}_{m}_status"] = status
            cols[f"{side}_{m}_available"] = F.coalesce((status == "ok") & F.col("actor_status").isin("single", "none"), F.lit(False))
        cols[f"{side}_n"] = pick(side, "n_valid_points_used")
        cols[f"{side}_n_keeper_included"] = pick(side, "keeper_included")
    out = j.withColumns(cols)
    return out.drop(*[c for c in wide.columns if "__" in c])


def anchor_order(anchors: DataFrame, lane: Lane) -> DataFrame:
    """Place of each anchor in its session, neighbours, and distance from the previous one.

    ``member_order`` is the event's place among all session members.
    """
    out = scan(
        anchors,
        lane,
        {
            "anchor_order": Scan("count", "1"),
            "previous_anchor_id": Shift("event_id"),
            "__t": Shift("t_us"),
            "__m": Shift("member_order"),
            "next_anchor_id": Shift("event_id", -1),
        },
    )
    out = out.withColumns(
        {
            "seconds_from_previous": (F.col("t_us") - F.col("__t")) / 1e6,
            "events_from_previous": F.col("member_order") - F.col("__m"),
            "intervening_events": F.col("member_order") - F.col("__m") - 1,
        }
    )
    return out.drop("__t", "__m")


def transitions(anchors: DataFrame, lane: Lane, responses: Sequence[str], support: Sequence[str]) -> DataFrame:
    """Consecutive anchors as FROM and TO with the change of each response, or why there is none."""
    carried = ["event_id", "event_index", "event_type", "event_team_id", "anchor_order", *support]
    specs = {f"from_{c}": c for c in carried}
    for r in responses:
        specs |= {f"__{r}": r, f"__{r}_ok": f"{r}_available"}
    out = shift(anchors, lane, specs).where("from_event_id IS NOT NULL")
    cols = [*lane.keys, *[f"from_{c}" for c in carried], *[F.col(c).alias(f"to_{c}") for c in carried]]
    cols += ["seconds_from_previous", "events_from_previous", "intervening_events"]
    for r in responses:
        was, now = F.coalesce(f"__{r}_ok", F.lit(False)), F.coalesce(f"{r}_available", F.lit(False))
        both = was & now & F.col(r).isNotNull() & F.col(f"__{r}").isNotNull()
        cols.append(F.when(both, F.col(r) - F.col(f"__{r}")).alias(f"delta_{r}"))
        cols.append(
            F.when(both, "ok")
            .when(~was & ~now, "both_endpoints_unavailable")
            .when(~was, "from_endpoint_unavailable")
            .when(~now, "to_endpoint_unavailable")
            .otherwise("endpoint_value_missing")
            .alias(f"delta_{r}_status")
        )
    return out.select(*cols)


def spell_readiness(sessions: DataFrame, anchors: DataFrame, keys: Sequence[str], own: int, available: Sequence[str], small: bool) -> DataFrame:
    """Anchor support per session; sessions without anchors stay."""
    keys, at = list(keys), F.col("anchor_order")
    a = anchors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("anchor_count"),
        F.count_if(F.col("event_team_id") == own).alias("own_anchor_count"),
        F.max("seconds_from_previous").alias("max_gap"),
        F.min_by("event_id", at).alias("first_anchor_id"),
        F.max_by("event_id", at).alias("last_anchor_id"),
        *[F.count_if(f"{c}_available").alias(f"{c}_available_count") for c in available],
    )
    q = exact_quantiles(anchors, keys, "seconds_from_previous", {"median_gap": 0.5, "p90_gap": 0.9}, small)
    out = sessions.join(a, keys, "left").join(q, keys, "left")
    counts = ["anchor_count", "own_anchor_count", *[f"{c}_available_count" for c in available]]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    return out.withColumns(
        {
            "transition_count": F.greatest(F.col("anchor_count") - 1, F.lit(0)),
            "anchor_proportion": F.col("anchor_count") / F.col("event_count"),
            "has_3_plus": F.col("anchor_count") >= 3,
        }
    )


def interval_reconcile(before: DataFrame, after: DataFrame, membership: DataFrame, session: str) -> DataFrame:
    """Anchor pairs lost between two segmentations, by cause, and pairs that are new.

    before/after: match_id, from_event_id, to_event_id; membership: match_id, event_id, session.
    """
    key = ["match_id", "from_event_id", "to_event_id"]
    m = lambda e: membership.select("match_id", F.col("event_id").alias(f"{e}_event_id"), F.col(session).alias(f"__{e}"))
    gone = before.select(*key).join(after.select(*key), key, "left_anti")
    gone = gone.join(m("from"), ["match_id", "from_event_id"], "left").join(m("to"), ["match_id", "to_event_id"], "left")
    cause = (
        F.when(F.col("__from").isNull() | F.col("__to").isNull(), "missing_endpoint")
        .when(F.col("__from") != F.col("__to"), "different_session")
        .otherwise("unexplained")
    )
    new = after.select(*key).join(before.select(*key), key, "left_anti").select(F.lit("new_pair").alias("cause"))
    return gone.select(cause.alias("cause")).unionByName(new).groupBy("cause").agg(F.count(F.lit(1)).alias("pairs"))


def availability_tables(anchors: DataFrame, names: Sequence[str]) -> DataFrame:
    """Status counts and available share per response."""
    rows = anchors.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("response"), F.col(f"{n}_status").alias("status"), F.col(f"{n}_available").alias("ok")) for n in names]))
    )
    per = rows.groupBy("response", "status", "ok").agg(F.count(F.lit(1)).alias("anchors"))
    total = per.groupBy("response").agg(F.sum("anchors").alias("__t"))
    return per.join(F.broadcast(total), "response").select(  # one row per response name
        "response", "status", F.col("ok").alias("available"), "anchors", F.round(100 * F.col("anchors") / F.col("__t"), 6).alias("percentage")
    )


def action_inventory(stream: DataFrame, state: DataFrame) -> DataFrame:
    """One status per event: vector problems, failed pass, restart, relocation, or eligible.

    stream: action vector columns; state: ``measurement_state`` rows keyed by match and event.
    """
    s = state.select(
        F.col("match_id").alias("__m"), F.col("event_id").alias("__e"), F.col("restart").alias("__restart"), F.col("eligible").alias("__eligible")
    )
    j = stream.join(s, (F.col("match_id") == F.col("__m")) & (F.col("event_id") == F.col("__e")), "left")
    status = (
        F.when(~F.col("action_candidate"), "not_own_pass_carry")
        .when(~F.col("safe_action"), F.col("action_status"))
        .when(F.col("__e").isNull(), "failed_or_unknown_pass_endpoint")
        .when(F.col("__restart"), "inherited_restart_context")
        .when(~F.col("__eligible"), "inherited_relocation_affected")
        .otherwise("eligible")
    )
    safe = F.col("safe_action")
    return j.select(
        "match_id",
        "event_id",
        status.alias("action_status"),
        F.when(safe, F.col("start_x")).alias("action_start_x"),
        F.when(safe, F.col("end_x")).alias("action_end_x"),
        F.when(safe, F.col("end_x") - F.col("start_x")).alias("action_delta_x"),
    )


def select_transitions(trans: DataFrame, anchors: DataFrame, actions: DataFrame, session: Sequence[str], own: int) -> DataFrame:
    """First failing reason per transition; ``eligible`` rows are the analysis sample."""
    side = lambda e: anchors.select(
        F.col("match_id").alias(f"__{e}m"),
        F.col("event_id").alias(f"__{e}i"),
        F.struct(*session).alias(f"__{e}s"),
        F.col("period").alias(f"__{e}p"),
        F.col("anchor_order").alias(f"__{e}o"),
        F.col("semantics_status").alias(f"__{e}v"),
        F.col("orientation_status").alias(f"__{e}r"),
    )
    act = actions.select(F.col("match_id").alias("__am"), F.col("event_id").alias("__ai"), "action_status", "action_start_x", "action_end_x", "action_delta_x")
    j = trans
    for e in ("from", "to"):
        j = j.join(side(e), (F.col("match_id") == F.col(f"__{e}m")) & (F.col(f"{e}_event_id") == F.col(f"__{e}i")), "left")
    j = j.join(act, (F.col("match_id") == F.col("__am")) & (F.col("from_event_id") == F.col("__ai")), "left")
    here = F.struct(*session)
    sure = lambda c: F.coalesce(c, F.lit(False))  # noqa: E731  an unknown gate fails
    finite = F.lit(True)
    for c in ("action_start_x", "action_end_x", "action_delta_x"):
        finite &= F.expr(P.finite(c))
    reason = (
        F.when(F.col("__fromi").isNull() | F.col("__toi").isNull(), "missing_exact_anchor")
        .when(~sure((F.col("__froms") == F.col("__tos")) & (here == F.col("__froms"))), "cross_session")
        .when(~sure(F.col("__fromp") == F.col("__top")), "cross_period")
        .when(~sure(F.col("__too") == F.col("__fromo") + 1), "not_next_trusted_anchor")
        .when(~sure(F.col("from_event_team_id") == own), "opponent_from_anchor")
        .when(~sure(F.col("from_event_type").isin("Pass", "Carry")), "not_pass_carry_from_anchor")
        .when(~sure((F.col("__fromv") == "validated") & (F.col("__tov") == "validated")), "unsupported_semantics")
        .when(~sure((F.col("__fromr") == "identity_explicit") & F.col("__tor").isin("identity_explicit", "rotated_180")), "invalid_orientation")
        .when(F.col("action_status").isNull(), "missing_exact_action")
        .when(F.col("action_status") != "eligible", F.col("action_status"))
        .when(~sure(finite), "invalid_progression_vector")
        .otherwise("eligible")
    )
    out = j.withColumns({"selection_reason": reason, "action_type": F.col("from_event_type"), "starting_third": starting_third("action_start_x")})
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def scope_masks(gaps: dict[str, float], own: int, gap: str = "seconds_from_previous") -> dict[str, Column]:
    """Named subsets; unknown anomaly flags count as anomalies."""
    flags = lambda f: [F.col(f"{e}_frame_{f}{u}") for e in ("from", "to") for u in ("", "_unknown")]
    none = lambda f: ~(flags(f)[0] | flags(f)[1] | flags(f)[2] | flags(f)[3])
    return {
        "all": F.lit(True),
        **{n: F.col(gap) <= s for n, s in gaps.items()},
        "to_own": F.col("to_event_team_id") == own,
        "exclude_oob": none("oob"),
        "exclude_coincidence": none("coincident"),
    }


def in_scopes(df: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """Each row once per scope it belongs to."""
    return df.select("*", F.explode(F.array_compact(F.array(*[F.when(m, F.lit(n)) for n, m in masks.items()]))).alias("scope"))


def response_rows(df: DataFrame, keep: Sequence[str], responses: Sequence[str]) -> DataFrame:
    packed = F.array(*[F.struct(F.lit(r).alias("response"), F.col(f"delta_{r}").alias("y"), F.col(f"delta_{r}_status").alias("status")) for r in responses])
    return df.select(*keep, F.inline(packed))


def metric_statistics(rows: DataFrame, by: Sequence[str], x: str, y: str, cluster: str, small: bool, interval: bool = False) -> DataFrame:
    """N, missing N, distributions of x and y, both correlations and the clustered slope."""
    by = list(by)
    ok = rows.where(F.col("status") == "ok")
    base = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("eligible_n"), F.count_if(F.col("status") != "ok").alias("missing_n")
    )
    qs = {k: LADDER[k] for k in ("p25", "median", "p75", "p90", "p95")}
    for c, p in ((x, "x"), (y, "y")):
        d = distribution(ok, by, c, small, qs).select(*by, *[F.col(s).alias(f"{p}_{s}") for s in (*qs, "min", "max")])
        base = base.join(d, by, "left")
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y)) & (F.count(F.lit(1)) >= 3)
    pear = ok.groupBy(*by).agg(F.when(varies, F.corr(x, y)).alias("pearson_r"))
    rho = spearman(ok, by, x, y, small).select(*by, F.when(F.col("n") >= 3, F.col("rho")).alias("spearman_rho"))
    fit = ols_cr1(ok, by, y, x, cluster, interval)
    return base.join(pear, by, "left").join(rho, by, "left").join(fit, by, "left")


def sensitivity(stats: DataFrame, by: Sequence[str], scope: str = "scope") -> DataFrame:
    """Every scope against the same group's ``all`` scope."""
    by = list(by)
    main = stats.where(F.col(scope) == "all").select(
        *by, F.col("n").alias("primary_n"), F.col("slope").alias("primary_slope"), F.col("spearman_rho").alias("primary_rho")
    )
    j = stats.where(F.col(scope) != "all").join(main, by)
    return j.withColumns(
        {
            "slope_difference": F.col("slope") - F.col("primary_slope"),
            "rho_difference": F.col("spearman_rho") - F.col("primary_rho"),
            "slope_sign_preserved": F.signum("slope") == F.signum("primary_slope"),
        }
    )


def decile_profile(df: DataFrame, by: Sequence[str], x: str, responses: Sequence[str], k: int, small: bool) -> DataFrame:
    """Responses by quantile bin of x; edges are cut once per group and shared by all responses."""
    from strideframe.operators.quality import bin_column

    binned = bin_column(df, x, k, small, "bin", by, prefix="D")
    rows = response_rows(binned, [*by, x, "bin"], responses).where("status = 'ok'")
    key = [*by, "response", "bin"]
    d = distribution(rows, key, "y", small, {"y_p25": 0.25, "y_median": 0.5, "y_p75": 0.75}).drop("std", "min", "max")
    return d.join(exact_quantiles(rows, key, x, {"x_median": 0.5}, small), key)


def sample_audit(selected: DataFrame) -> DataFrame:
    """How many transitions each reason decided, overall and by action type."""
    return selected.groupBy("selection_reason", "from_event_type").agg(F.count(F.lit(1)).alias("n"))


def per_cluster_spearman(rows: DataFrame, by: Sequence[str], cluster: str, x: str, y: str, small: bool) -> DataFrame:
    """Spearman per cluster, then its spread and the share above zero."""
    by = list(by)
    rho = spearman(rows, [*by, cluster], x, y, small).where("rho IS NOT NULL")
    out = rho.groupBy(*by).agg(
        F.count(F.lit(1)).alias("clusters"), F.min("rho").alias("min_rho"), F.max("rho").alias("max_rho"),
        F.mean((F.col("rho") > 0).cast("int")).alias("share_positive"),
    )
    return out.join(exact_quantiles(rho, by, "rho", {"median_rho": 0.5}, small), by)


