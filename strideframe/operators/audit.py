"""Data-quality audit of events and their snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.functions import points as P
from strideframe.operators.joins import identifier
from strideframe.operators.quantiles import distribution, exact_quantiles


def _n(cond: str) -> Column:
    return F.expr(f"CASE WHEN points IS NOT NULL THEN size(filter(points, p -> {cond})) END")


def frame_observability(frames: DataFrame) -> DataFrame:
    """Flag counts per snapshot; an absent container has unknown counts, an empty one zeros."""
    return frames.withColumns(
        {
            "freeze_frame_missing": F.col("points").isNull(),
            "freeze_frame_empty": F.expr("CASE WHEN points IS NOT NULL THEN size(points) = 0 END"),
            "visible_players": _n("true"),
            "teammate_true": _n("p.teammate <=> true"),
            "teammate_false": _n("p.teammate <=> false"),
            "teammate_unknown": _n("p.teammate IS NULL"),
            "keepers": _n("p.keeper <=> true"),
            "actors": _n("p.actor <=> true"),
            "valid_locations": _n(P.valid("p")),
        }
    )


def actor_distance(df: DataFrame, length: float = 120.0, width: float = 80.0) -> DataFrame:
    """Distance from the event to its single actor, as supplied and mirrored.

    Needs ``points``, ``loc_x``, ``loc_y`` and ``link`` (the event link status).
    """
    df = df.withColumn("__a", F.expr("filter(points, p -> p.actor <=> true)"))
    df = df.withColumn("__p", F.expr("CASE WHEN size(__a) = 1 THEN __a[0] END"))
    df = df.withColumn(
        "actor_reason",
        F.expr(
            "CASE WHEN points IS NULL THEN 'freeze_frame unavailable' WHEN size(__a) <> 1 THEN 'actor count is not one' "
            f"WHEN NOT {P.valid('__p')} THEN 'actor location unavailable or invalid' "
            "WHEN link <> 'unique' THEN 'event link missing or ambiguous' "
            f"WHEN NOT ({P.finite('loc_x')} AND {P.finite('loc_y')}) THEN 'event location unavailable or invalid' "
            "ELSE 'measurable' END"
        ),
    )
    ok = F.col("actor_reason") == "measurable"
    df = df.withColumns(
        {
            "direct_distance": F.when(ok, F.expr("hypot(loc_x - __p.x, loc_y - __p.y)")),
            "mirrored_distance": F.when(
                ok, F.expr(f"hypot({length!r}D - loc_x - __p.x, {width!r}D - loc_y - __p.y)")
            ),
        }
    )
    return df.withColumn(
        "comparison",
        F.expr(
            "CASE WHEN direct_distance < mirrored_distance THEN 'direct_closer' "
            "WHEN mirrored_distance < direct_distance THEN 'mirrored_closer' ELSE 'equal_or_indeterminate' END"
        ),
    ).drop("__a", "__p")


def match_inventory(events: DataFrame, frames: DataFrame) -> DataFrame:
    """Totals, identifiers, duplicates and link outcomes per match.

    Ids are first counted per (match, id), so a match of any size aggregates in two steps.
    """
    def counts(df: DataFrame, id_col: str, prefix: str) -> DataFrame:
        per = df.groupBy("match_id", identifier(id_col).alias("__id")).agg(F.count(F.lit(1)).alias("n"))
        known = F.col("__id").isNotNull()
        return per.groupBy("match_id").agg(
            F.sum("n").alias(f"total_{prefix}"),
            F.count("__id").alias(f"unique_{prefix}_ids"),
            F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias(f"{prefix}_missing_id"),
            F.coalesce(F.sum(F.when(known, F.col("n") - 1)), F.lit(0)).alias(f"duplicate_{prefix}_ids"),
            F.count_if(known & (F.col("n") > 1)).alias(f"duplicate_{prefix}_groups"),
        )

    ev = events.groupBy("match_id", identifier("id").alias("__id")).agg(F.count(F.lit(1)).alias("e"))
    fr = frames.groupBy("match_id", identifier("event_uuid").alias("__id")).agg(F.count(F.lit(1)).alias("f"))
    both = ev.join(fr, ["match_id", "__id"], "full").groupBy("match_id").agg(
        F.coalesce(F.sum(F.when(F.col("f").isNotNull(), F.col("e"))), F.lit(0)).alias("matched_events"),
        F.coalesce(F.sum(F.when(F.col("e").isNull(), F.col("f"))), F.lit(0)).alias("orphan_frames"),
        F.coalesce(F.sum(F.when(F.col("e") > 1, F.col("f"))), F.lit(0)).alias("ambiguous_frames"),
    )
    table = counts(events, "id", "event").join(counts(frames, "event_uuid", "frame"), "match_id", "left")
    return table.join(both, "match_id", "left").withColumn(
        "events_without_frames", F.col("total_event") - F.col("matched_events")
    )


DIST = {"q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95, "q99": 0.99}


def distance_stats(measured: DataFrame, by: Sequence[str], small: bool) -> DataFrame:
    """Direct-distance distribution of measurable pairs; groups without any are omitted."""
    ok = measured.where("direct_distance IS NOT NULL")
    return distribution(ok, list(by), "direct_distance", small, DIST).drop("std", "min")


def hypothesis_shares(measured: DataFrame, by: Sequence[str], small: bool) -> DataFrame:
    """How often each coordinate hypothesis is closer, with medians and p95 of both."""
    ok = measured.where("direct_distance IS NOT NULL AND mirrored_distance IS NOT NULL")
    labels = ("direct_closer", "mirrored_closer", "equal_or_indeterminate")
    out = ok.groupBy(*by).agg(
        F.count(F.lit(1)).alias("measurable_pairs"),
        *[(100 * F.mean((F.col("comparison") == c).cast("int"))).alias(f"percent_{c}") for c in labels],
    )
    for c in ("direct", "mirrored"):
        q = exact_quantiles(ok, list(by), f"{c}_distance", {f"median_{c}": 0.5, f"p95_{c}": 0.95}, small)
        out = out.join(q, list(by))
    return out


def scopes(df: DataFrame, dims: dict[str, str]) -> DataFrame:
    """Each row once per alternative scope: (scope, group)."""
    packed = [F.struct(F.lit("all").alias("scope"), F.lit("all").alias("group"))]
    packed += [F.struct(F.lit(s).alias("scope"), F.expr(f"CAST({e} AS STRING)").alias("group")) for s, e in dims.items()]
    return df.select("*", F.inline(F.array(*packed)))


def attrition(events: DataFrame, frames: DataFrame, dims: dict[str, str], small: bool) -> DataFrame:
    """Coverage counts per scope, event and frame criteria counted on their own rows.

    events: has_360_frame; frames: visible_players, valid_locations, polygon_status,
    actor_reason, direct_distance, event_link_status, frame_uuid_records.
    """
    e = scopes(events, dims).groupBy("scope", "group").agg(
        F.count(F.lit(1)).alias("all_events"),
        F.count_if("has_360_frame").alias("events_with_frame"),
        F.count_if(~F.col("has_360_frame")).alias("events_without_frame"),
    )
    link = F.expr("event_link_status = 'unique' AND frame_uuid_records = 1")
    full, area = F.expr("coalesce(visible_players > 0, false)"), F.expr("polygon_status = 'valid'")
    actor, points = F.expr("actor_reason = 'measurable'"), F.expr("coalesce(valid_locations = visible_players, false)")
    rows = scopes(frames, dims)
    f = rows.groupBy("scope", "group").agg(
        F.count(F.lit(1)).alias("all_frames"),
        F.count_if(full).alias("frames_nonempty"),
        F.count_if(area).alias("frames_valid_area"),
        F.count_if(actor).alias("frames_actor_measurable"),
        *[F.count_if(F.col("polygon_status") == s).alias(f"frames_{s}_area") for s in ("missing", "malformed", "invalid")],
        F.count_if(link).alias("frames_unique_link"),
        F.count_if(link & full).alias("frames_unique_nonempty"),
        F.count_if(link & full & area).alias("frames_unique_nonempty_valid_area"),
        F.count_if(link & full & area & actor & points).alias("frames_joint_checks"),
        F.mean("direct_distance").alias("distance_mean"),
        F.max("direct_distance").alias("distance_max"),
    )
    q = exact_quantiles(rows, ["scope", "group"], "direct_distance", {"distance_median": 0.5}, small)
    q = q.select(F.col("scope").alias("__qs"), F.col("group").alias("__qg"), "distance_median")
    f = f.withColumnsRenamed({"scope": "__fs", "group": "__fg"})
    f = f.join(q, F.col("__fs").eqNullSafe(F.col("__qs")) & F.col("__fg").eqNullSafe(F.col("__qg")), "left").drop("__qs", "__qg")
    keys = F.col("scope").eqNullSafe(F.col("__fs")) & F.col("group").eqNullSafe(F.col("__fg"))
    counts = [c for c in (*e.columns[2:], *f.columns[2:]) if not c.startswith("distance")]
    return e.join(f, keys, "full").select(
        F.coalesce("scope", "__fs").alias("scope"),
        F.coalesce("group", "__fg").alias("group"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        "distance_mean",
        "distance_max",
        "distance_median",
    )


def top_discrepancies(measured: DataFrame, n: int, tie: Sequence[str]) -> DataFrame:
    """Largest measured distances; ties by ``tie``.  Top-k is taken per task, then merged."""
    return measured.where("direct_distance IS NOT NULL").orderBy(F.desc("direct_distance"), *tie).limit(n)


def multiple_actor_frames(frames: DataFrame) -> DataFrame:
    """Snapshots with more than one actor; every location kept as JSON."""
    df = frames.withColumn("__a", F.expr("filter(points, p -> p.actor <=> true)")).where("size(__a) > 1")
    return df.withColumns(
        {
            "actor_count": F.expr("size(__a)"),
            "actor_locations": F.expr("to_json(transform(__a, p -> array(round(p.x, 6), round(p.y, 6))))"),
        }
    ).drop("__a", "points")


def load_status_inventory(matches: DataFrame, events: DataFrame, frames: DataFrame) -> DataFrame:
    """Loaded or missing per match; counts of an absent resource are null, never zero."""
    e = events.groupBy("match_id").agg(F.count(F.lit(1)).alias("events"))
    f = frames.groupBy("match_id").agg(F.count(F.lit(1)).alias("original_frames"))
    out = matches.select("match_id").join(e, "match_id", "left").join(f, "match_id", "left")
    return out.select(
        "match_id",
        "events",
        "original_frames",
        (6 * F.col("original_frames")).alias("variant_rows"),
        F.when(F.col("original_frames").isNull(), "missing").otherwise("loaded").alias("frames_load_status"),
    )
