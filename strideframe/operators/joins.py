"""Identity joins with explicit cardinality, and what they leave behind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.functions import points as P
from strideframe.operators.expectations import ContractError, duplicate_keys


def identifier(col: str) -> Column:
    """Blank identifiers are no identifiers and never join."""
    return F.when(F.trim(F.col(col)) != "", F.col(col))


def link_frames(frames: DataFrame, events: DataFrame, metadata: Sequence[str]) -> DataFrame:
    """Match-local link of each frame: unique, ambiguous or unmatched.

    Every frame row stays once.  Event metadata is attached only to a unique link,
    because ids are counted before the join.
    """
    counted = (
        events.withColumn("__id", identifier("id"))
        .where("__id IS NOT NULL")
        .groupBy(F.col("match_id").alias("__m"), "__id")
        .agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*metadata)).alias("__e"))
    )
    copies = (
        frames.withColumn("__f", identifier("event_uuid"))
        .where("__f IS NOT NULL")
        .groupBy(F.col("match_id").alias("__fm"), "__f")
        .agg(F.count(F.lit(1)).alias("__copies"))
    )
    uid = identifier("event_uuid")
    out = (
        frames.withColumn("__u", uid)
        .join(counted, (F.col("match_id") == F.col("__m")) & (F.col("__u") == F.col("__id")), "left")
        .join(copies, (F.col("match_id") == F.col("__fm")) & (F.col("__u") == F.col("__f")), "left")
    )
    n = F.coalesce("__n", F.lit(0))
    return out.select(
        *frames.columns,
        n.alias("matching_event_records"),
        F.coalesce("__copies", F.lit(0)).alias("frame_uuid_records"),
        F.when(n == 1, "unique").when(n > 1, "ambiguous").otherwise("unmatched").alias("event_link_status"),
        *[F.when(n == 1, F.col(f"__e.{c}")).alias(c) for c in metadata],
    )


def coverage_flag(events: DataFrame, frames: DataFrame) -> DataFrame:
    """Whether a frame exists for the event's identifier in its match."""
    keys = (
        frames.select(F.col("match_id").alias("__m"), identifier("event_uuid").alias("__u"))
        .where("__u IS NOT NULL")
        .distinct()
    )
    on = (F.col("match_id") == F.col("__m")) & (identifier("id") == F.col("__u"))
    return events.join(keys, on, "left").select(*events.columns, F.col("__u").isNotNull().alias("has_360_frame"))


def exact_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "outer",
    validate: str | None = None,
    check: Sequence[str] = (),
    tolerance: dict[str, float] | None = None,
) -> DataFrame:
    """Join with a ``_merge`` indicator and null-safe comparison of context columns.

    ``validate`` is one_to_one, one_to_many or many_to_one and raises on repeated
    keys; each checked column ``c`` yields ``c_equal`` (floats within a tolerance).
    """
    sides = {"one_to_one": "lr", "one_to_many": "l", "many_to_one": "r", None: ""}[validate]
    for side, df in (("l", left), ("r", right)):
        if side in sides and duplicate_keys(df, on).limit(1).count():
            raise ContractError(f"{validate} join has repeated keys on the {'left' if side == 'l' else 'right'}")
    tol = tolerance or {}
    r = right.select(
        *[F.col(k).alias(f"__k_{k}") for k in on],
        *[F.col(c).alias(f"__r_{c}") for c in check],
        *[c for c in right.columns if c not in on and c not in check],
        F.lit(True).alias("__right"),
    )
    cond = F.lit(True)
    for k in on:
        cond = cond & (F.col(k) == F.col(f"__k_{k}"))
    j = left.withColumn("__left", F.lit(True)).join(r, cond, how)
    merge = (
        F.when(F.col("__left") & F.col("__right"), "both").when(F.col("__left"), "left_only").otherwise("right_only")
    )
    equal = {
        f"{c}_equal": (F.abs(F.col(c) - F.col(f"__r_{c}")) <= tol[c]) if c in tol else F.col(c).eqNullSafe(F.col(f"__r_{c}"))
        for c in check
    }
    kept = [c for c in left.columns if c not in on]
    extra = [c for c in right.columns if c not in on and c not in check]
    return j.select(
        *[F.coalesce(k, f"__k_{k}").alias(k) for k in on],
        *kept,
        *extra,
        *[e.alias(n) for n, e in equal.items()],
        merge.alias("_merge"),
    )


def reconcile_join(joined: DataFrame, check: Sequence[str]) -> DataFrame:
    """Counts of matched and unmatched rows and of context mismatches."""
    both = F.col("_merge") == "both"
    return joined.agg(
        *[F.count_if(F.col("_merge") == m).alias(m) for m in ("both", "left_only", "right_only")],
        *[F.count_if(both & ~F.coalesce(F.col(f"{c}_equal"), F.lit(False))).alias(f"{c}_mismatch") for c in check],
    )


def anti_join_report(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Identities missing on either side."""
    a, b = left.select(*on).distinct(), right.select(*on).distinct()
    missing = a.join(b, list(on), "left_anti").withColumn("side", F.lit("missing_right"))
    extra = b.join(a, list(on), "left_anti").withColumn("side", F.lit("missing_left"))
    return missing.unionByName(extra)


def cloud(points: str, flip: str | None = None, flags: bool = False) -> str:
    """Order-free form of a snapshot: sorted (x, y, keeper[, teammate]) of valid points."""
    flag = ""
    if flags:
        t = f"CASE WHEN {flip} THEN NOT p.teammate ELSE p.teammate END" if flip else "p.teammate"
        flag = f", 'teammate', {t}"
    return (
        f"sort_array(transform(filter({points}, p -> {P.valid('p')}), "
        f"p -> named_struct('x', p.x, 'y', p.y, 'keeper', p.keeper{flag})))"
    )


def related_edges(events: DataFrame, frames: DataFrame) -> DataFrame:
    """Directed provider links between events with frames, with snapshot comparison.

    events: event_id, event_type, event_team_id, related_events; frames: event_uuid,
    points.  Labels are expected to agree for one team and to be opposite for two.
    """
    fr = lambda t: frames.select(F.col("event_uuid").alias(f"__{t}"), F.col("points").alias(f"{t}_points"))
    other = events.select(
        F.col("event_id").alias("related_event_id"),
        F.col("event_type").alias("related_event_type"),
        F.col("event_team_id").alias("__team"),
    )
    edges = (
        events.select("event_id", "event_type", "event_team_id", F.explode(F.array_distinct("related_events")).alias("related_event_id"))
        .join(other, "related_event_id")
        .join(fr("own"), F.col("event_id") == F.col("__own"))
        .join(fr("other"), F.col("related_event_id") == F.col("__other"), "left")
    )
    same = F.col("event_team_id").eqNullSafe(F.col("__team"))
    edges = edges.withColumn("same_event_team", same)
    a, b = cloud("own_points"), cloud("other_points")
    edges = edges.withColumn("equal_native_cloud", F.coalesce(F.expr(f"size({a}) > 0 AND {a} = {b}"), F.lit(False)))
    la, lb = cloud("own_points", flags=True), cloud("other_points", "NOT same_event_team", True)
    edges = edges.withColumn(
        "expected_team_labels_agree", F.col("equal_native_cloud") & F.coalesce(F.expr(f"{la} = {lb}"), F.lit(False))
    )
    return edges.select(
        "event_id",
        "related_event_id",
        "event_type",
        "related_event_type",
        "same_event_team",
        F.col("__other").isNotNull().alias("related_has_frame"),
        "equal_native_cloud",
        "expected_team_labels_agree",
        (F.col("equal_native_cloud") & ~F.col("expected_team_labels_agree")).alias("label_conflict"),
    )


def conflict_endpoints(edges: DataFrame) -> DataFrame:
    """Both ends of every conflicting edge, once."""
    bad = edges.where("label_conflict")
    return bad.select(F.explode(F.array("event_id", "related_event_id")).alias("event_id")).distinct()


def lineup_membership(events: DataFrame, lineups: DataFrame) -> DataFrame:
    """True or false when the player is known, null otherwise."""
    keys = ["match_id", "event_team_id", "player_id"]
    listed = lineups.select(*keys).distinct().withColumn("__in", F.lit(True))
    return events.join(listed, keys, "left").select(
        *events.columns, F.when(F.col("player_id").isNotNull(), F.coalesce("__in", F.lit(False))).alias("in_lineup")
    )
