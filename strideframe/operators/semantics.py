"""Team and orientation semantics of snapshots: ordered gates, labels and rotation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.functions import points as P
from strideframe.operators.quantiles import distribution
from strideframe.sources.stage import stored

#: fixed values
CORE = ("Shot", "Pass", "Carry", "Pressure")
VALIDATED = "validated"


def codec_alignment(ax: str, ay: str, bx: str, by: str) -> str:
    """Exact equality as supplied, or after 32-bit encoding; not a distance tolerance."""
    enc = lambda v: f"CAST(CAST({v} AS FLOAT) AS DOUBLE)"
    known = " AND ".join(P.finite(v) for v in (ax, ay, bx, by))
    return (
        f"CASE WHEN NOT ({known}) THEN 'unavailable' WHEN {ax} = {bx} AND {ay} = {by} THEN 'exact_supplied' "
        f"WHEN {enc(ax)} = {bx} AND {enc(ay)} = {by} THEN 'exact_float32' ELSE 'not_exact' END"
    )


def team_context(own: int) -> dict[str, Column]:
    """Agreement of event and possession team inside the match, and the attacking context."""
    in_match = lambda t: f"({t} IN (home_team_id, away_team_id))"
    valid = f"(home_team_id IS NOT NULL AND away_team_id IS NOT NULL AND home_team_id <> away_team_id AND {own} IN (home_team_id, away_team_id))"
    agreement = (
        "CASE WHEN event_team_id IS NULL AND possession_team_id IS NULL THEN 'missing_both' "
        "WHEN event_team_id IS NULL THEN 'missing_event_team' WHEN possession_team_id IS NULL THEN 'missing_possession_team' "
        f"WHEN NOT coalesce({valid} AND {in_match('event_team_id')} AND {in_match('possession_team_id')}, false) THEN 'invalid_match_team' "
        "WHEN event_team_id = possession_team_id THEN 'same' ELSE 'different' END"
    )
    context = (
        f"CASE WHEN ({agreement}) NOT IN ('same', 'different') THEN 'ambiguous_possession_context' "
        f"WHEN possession_team_id = {own} AND event_team_id <> {own} THEN 'opponent_event_in_own_possession' "
        f"WHEN possession_team_id = {own} THEN 'own_event_in_own_possession' "
        f"WHEN event_team_id = {own} THEN 'own_event_in_opponent_possession' ELSE 'opponent_possession_context' END"
    )
    return {"team_agreement": F.expr(agreement), "attacking_context": F.expr(context)}


def event_frame_profile(df: DataFrame) -> DataFrame:
    """Per event: actor flags, point tallies, actor encoding and goalkeeper mean x by flag."""
    v = f"filter(points, p -> {P.valid('p')})"
    df = df.withColumn("__v", F.expr(v)).withColumn("__a", F.expr("filter(__v, p -> p.actor <=> true)"))
    n = lambda c: F.expr(f"size(filter(__v, p -> {c}))")
    cols = {
        "point_records": F.expr("size(__v)"),
        "invalid_point_records": F.expr("size(points) - size(__v)"),
        "teammate_true_records": n("p.teammate <=> true"),
        "teammate_false_records": n("p.teammate <=> false"),
        "unknown_teammate_records": n("p.teammate IS NULL"),
        "unknown_keeper_records": n("p.keeper IS NULL"),
        "unknown_actor_records": n("p.actor IS NULL"),
        "actor_records": F.expr("size(__a)"),
        "actor_teammate_true": F.expr("size(filter(__a, p -> p.teammate <=> true))"),
        "actor_teammate_false": F.expr("size(filter(__a, p -> p.teammate <=> false))"),
        "actor_codec": F.expr(
            "CASE WHEN size(__a) = 1 THEN " + codec_alignment("loc_x", "loc_y", "__a[0].x", "__a[0].y") + " ELSE 'unavailable' END"
        ),
    }
    for flag in ("true", "false"):
        xs = f"transform(filter(__v, p -> p.keeper <=> true AND p.teammate <=> {flag}), p -> p.x)"
        cols[f"keeper_{flag}_count"] = F.expr(f"size({xs})")
        cols[f"keeper_{flag}_mean_x"] = F.expr(f"CASE WHEN size({xs}) > 0 THEN {P.mean(xs)} END")
    return df.withColumns(cols).drop("__v", "__a")


def frame_semantics(profile: DataFrame, own: int, revision: str) -> DataFrame:
    """First failing gate, in a fixed order, else validated.

    Needs the profile columns plus source_revision, link, home/away ids, event team
    and type and ``label_conflict`` (null when not audited).
    """
    gates = [
        (f"NOT (source_revision <=> '{revision}')", "unsupported_source_revision"),
        ("NOT (link <=> 'unique')", "invalid_event_frame_join"),
        (
            f"NOT coalesce(home_team_id <> away_team_id AND {own} IN (home_team_id, away_team_id) "
            "AND event_team_id IN (home_team_id, away_team_id), false)",
            "invalid_match_team",
        ),
        (f"NOT coalesce(event_type IN {CORE}, false)", "unsupported_event_type"),
        ("label_conflict IS NULL", "related_team_audit_unresolved"),
        ("label_conflict", "related_team_label_conflict"),
        (
            "points IS NULL OR invalid_point_records > 0 OR unknown_actor_records > 0 OR actor_records <> 1",
            "actor_status_unresolved",
        ),
        ("actor_teammate_true <> 1", "actor_team_flag_unresolved"),
        ("unknown_teammate_records > 0 OR unknown_keeper_records > 0", "point_flags_unresolved"),
        ("actor_codec NOT IN ('exact_supplied', 'exact_float32')", "actor_encoding_unresolved"),
    ]
    chain = " ".join(f"WHEN {c} THEN '{r}'" for c, r in gates)
    return profile.withColumn("semantics_status", F.expr(f"CASE {chain} ELSE '{VALIDATED}' END"))


def point_team_label(own: int, teammate: str = "teammate") -> str:
    """Side of a point in validated scope: own, opponent or unresolved."""
    return (
        f"CASE WHEN NOT (semantics_status <=> '{VALIDATED}') OR event_team_id IS NULL OR {teammate} IS NULL THEN 'unresolved' "
        f"WHEN {teammate} = (event_team_id = {own}) THEN 'own' ELSE 'opponent' END"
    )


def normalize_point(x: str, y: str, target: int, length: float = 120.0, width: float = 80.0) -> dict[str, Column]:
    """Identity when the event's team is the target, else half-turn; null where unsupported."""
    status = (
        f"CASE WHEN NOT ({P.finite(x)} AND {P.finite(y)}) THEN 'invalid_location' "
        f"WHEN NOT (semantics_status <=> '{VALIDATED}') OR event_team_id IS NULL THEN 'unsupported' "
        f"WHEN event_team_id = {target} THEN 'identity_explicit' ELSE 'rotated_180' END"
    )
    turn = lambda v, full: (
        f"CASE ({status}) WHEN 'identity_explicit' THEN {v} WHEN 'rotated_180' THEN {full!r}D - {v} END"
    )
    return {
        "orientation_status": F.expr(status),
        "x_attacking": F.expr(turn(x, length)),
        "y_attacking": F.expr(turn(y, width)),
    }


def normalization_check(df: DataFrame, target: int, length: float = 120.0, width: float = 80.0) -> DataFrame:
    """Points rotated and rotated back: how many, and the largest error, per snapshot."""
    same = f"event_team_id = {target}"
    err = lambda v, full: f"abs(p.{v} - CASE WHEN {same} THEN p.{v} ELSE {full!r}D - ({full!r}D - p.{v}) END)"
    errors = f"transform(filter(points, p -> {P.valid('p')}), p -> greatest({err('x', length)}, {err('y', width)}))"
    ok = f"semantics_status = '{VALIDATED}'"
    return df.withColumns(
        {
            "locations_checked": F.expr(f"CASE WHEN {ok} THEN size({errors}) ELSE 0 END"),
            "max_roundtrip_error": F.expr(f"CASE WHEN {ok} THEN array_max({errors}) END"),
        }
    )


def crosscheck_nearest(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """For each independent reference point: nearest snapshot points and flag agreement."""
    per_ref = (
        "transform(filter(refs, r -> r.x IS NOT NULL AND r.y IS NOT NULL AND r.teammate IS NOT NULL), r -> "
        + P.let(
            "ds",
            f"transform(filter(points, p -> {P.valid('p')}), p -> named_struct('d', hypot(r.x - p.x, r.y - p.y), 't', p.teammate))",
            P.let(
                "near",
                P.let("m", "array_min(transform(ds, q -> q.d))", "filter(ds, q -> q.d = m)"),
                "named_struct('ref', r.i, 'nearest_distance', array_min(transform(near, q -> q.d)), 'unique_nearest', size(near) = 1, "
                "'flags_agree', forall(near, q -> q.t <=> r.teammate))",
            ),
        )
        + ")"
    )
    some = f"exists(points, p -> {P.valid('p')})"
    return df.where(F.expr(some)).select(*keep, F.expr(f"inline({per_ref})"))


def contingency(df: DataFrame, by: Sequence[str], sums: dict[str, Column] | None = None) -> DataFrame:
    """Counts per combination, null groups kept."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("frames"), *[c.alias(n) for n, c in (sums or {}).items()])


def anchor_metrics(df: DataFrame, by: Sequence[str], metrics: Sequence[str], small: bool) -> DataFrame:
    """Distribution of several columns per group, with counts past midfield."""
    if not small:
        df = stored(df.select(*by, *metrics))  # read for the moments and for the quantiles
    rows = df.select(
        *by, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    )
    extra = {"events": F.count(F.lit(1)), "above_midfield": F.count_if(F.col("value") > 60)}
    qs = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    return distribution(rows, [*by, "metric"], "value", small, qs, extra).drop("std")


def stratum_first(df: DataFrame, rules: dict[str, str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """First row, in ``order``, of every named stratum (rules give a label or null)."""
    labels = F.array_compact(F.array(*[F.expr(f"CASE WHEN {c} THEN {n} END") for n, c in rules.items()]))
    rows = df.select(F.explode(labels).alias("rule"), F.struct(*order, *[k for k in keep if k not in order]).alias("r"))
    return rows.groupBy("rule").agg(F.min("r").alias("r")).select("rule", "r.*")
