"""Review sampling: timelines, criteria, candidate moments and their context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.operators.ordered import Lane, Scan, Shift, islands, scan, shift

KINDS = {"positive": "delta_x > 0", "negative": "delta_x < 0", "nonpositive": "delta_x <= 0"}


def complete_timeline(stream: DataFrame, lane: Lane) -> DataFrame:
    """Every event with prior gap, running peak so far, run lengths so far, and the next peak.

    Spatial state exists only on safe actions; the peak columns say what is known
    up to and including the row.
    """
    safe = "safe_action"
    top = f"CASE WHEN {safe} THEN greatest(start_x, end_x) END"
    s = scan(stream, lane, {"event_position": Scan("count", "1"), "__t": Shift("t_us"), "__old": Scan("max", top, exclusive=True), "peak_x": Scan("max", top)})
    s = s.withColumns({"event_position": F.col("event_position") - 1, "prior_gap_seconds": (F.col("t_us") - F.col("__t")) / 1e6})
    s = s.withColumn("__head", F.expr(f"{safe} AND (__old IS NULL OR greatest(start_x, end_x) >= __old)"))
    mark = "CASE WHEN __head THEN named_struct('i', event_index, 't', t_us, 'p', event_position, 'x', greatest(start_x, end_x)) END"
    s = scan(
        s,
        lane,
        {
            "peak": Scan("last", mark),
            "next_peak": Scan("last", mark, backward=True, exclusive=True),
            "top_after": Scan("max", top, backward=True, exclusive=True),
        },
    )
    actions = s.where(safe).select(*lane.keys, *lane.order, "delta_x")
    for kind, cond in KINDS.items():
        actions = islands(actions.withColumn("__c", F.expr(cond)), lane, "NOT __c", f"__i_{kind}")
        actions = scan(actions, lane.by(*lane.keys, f"__i_{kind}"), {f"{kind}_run_length": Scan("sum", "CAST(__c AS INT)")})
    runs = actions.select(
        *[F.col(k).alias(f"__k_{k}") for k in lane.keys], F.col("event_index").alias("__ei"), *[f"{k}_run_length" for k in KINDS]
    )
    on = F.col("event_index") == F.col("__ei")
    for k in lane.keys:
        on = on & (F.col(k) == F.col(f"__k_{k}"))
    out = s.join(runs, on, "left")
    out = out.withColumns(
        {
            "next_peak": F.when(F.col("peak_x").isNotNull(), F.col("next_peak")),
            "retreat_from_peak": F.when(F.col(safe), F.col("peak_x") - F.col("end_x")),
            **{f"{k}_run_length": F.when(F.col(f"{k}_run_length") > 0, F.col(f"{k}_run_length")) for k in KINDS},
        }
    )
    return out.drop("__t", "__old", "__head", "__ei", *[f"__k_{k}" for k in lane.keys])


def local_peak_count(path: DataFrame, lane: Lane) -> DataFrame:
    """Strict interior peaks per group once equal neighbours are collapsed."""
    order = lane.ordered(*lane.order, "vertex_no")
    moved = shift(path, order, {"__p": "x"}).where("__p IS NULL OR __p <> x")
    looked = scan(moved, order, {"__l": Shift("x"), "__r": Shift("x", -1)})
    peak = F.coalesce((F.col("x") > F.col("__l")) & (F.col("x") > F.col("__r")), F.lit(False))
    return looked.groupBy(*lane.keys).agg(F.count_if(peak).alias("local_peaks"))


def category_flags(possessions: DataFrame, recoveries: DataFrame, timeline: DataFrame, peaks: DataFrame, keys: Sequence[str], own: int, unit_us: int) -> DataFrame:
    """Boolean sampling criteria per group; ``unit_us`` is the length of one time unit."""
    keys, sec = list(keys), unit_us / 1e6
    got, band = F.col("recovered"), F.col("retreat_size").between(20, 40)
    r = recoveries.groupBy(*keys).agg(
        F.bool_or(got & (F.col("seconds_to_recover") <= 3 * sec)).alias("immediate_observed_recovery"),
        F.bool_or(got & (F.col("seconds_to_recover") > 15 * sec)).alias("delayed_observed_recovery"),
        F.bool_or(~got).alias("unrecovered_observation"),
        F.bool_or("new_peak_reached").alias("retreat_then_renewed_progression"),
        F.bool_or(band & (F.col("previous_peak_x") >= 100)).alias("advanced_origin_retreat"),
        F.bool_or(band & (F.col("previous_peak_x") <= 60)).alias("deeper_origin_retreat"),
    )
    mine = (F.col("event_team_id") == own) & F.col("event_type").isin("Pass", "Carry")
    t = timeline.groupBy(*keys).agg(
        F.min_by(F.coalesce("pass_type", F.lit("")), F.when(mine, F.col("event_index"))).alias("__first"),
        F.bool_or(F.coalesce(F.col("pass_type") == "Throw-in", F.lit(False))).alias("throw_in_restart"),
        F.bool_or("is_out").alias("out_context"),
        F.bool_or(F.col("event_type") == "Shot").alias("shot_context"),
        F.min(F.when((F.col("event_type") == "Shot") & (F.col("event_team_id") == own), F.col("event_index"))).alias("__shot"),
        F.max(F.when(mine, F.col("event_index"))).alias("__last"),
        F.bool_or(F.col("validated_anchor") & (F.col("event_team_id") != own) & (F.col("event_type") == "Pressure")).alias("opponent_pressure_anchor"),
    )
    j = possessions.join(r, keys, "left").join(t, keys, "left").join(peaks, keys, "left")
    dur = F.col("duration_us") / unit_us
    c = F.col
    flags = {
        "nearly_monotonic": (c("positive_action_count") >= 2) & (c("maximum_retreat") <= 5),
        "one_small_backward": (c("negative_action_count") == 1) & (c("maximum_single_backward") <= 5) & (c("cumulative_forward_x") >= 30),
        "large_single_backward": c("maximum_single_backward") >= 20,
        "single_without_extended_run": (c("maximum_single_backward") >= 20) & (c("maximum_negative_run") == 1),
        "gradual_multi_action": (c("maximum_negative_run") >= 3) & (c("cumulative_backward_x") >= 15) & (c("maximum_single_backward") < 20),
        "high_backward_without_large_action": (c("cumulative_backward_x") >= 40) & (c("maximum_single_backward") < 20),
        **{n: c(n) for n in r.columns if n not in keys},
        "corner_started": c("__first") == "Corner",
        "free_kick_started": c("__first") == "Free Kick",
        **{n: c(n) for n in ("throw_in_restart", "out_context", "shot_context", "opponent_pressure_anchor")},
        "shot_then_same_parent_actions": c("__last") > c("__shot"),
        "multiple_local_peaks_long": (dur > 60) & (c("local_peaks") >= 3),
        "very_long": dur > 120,
        "dense_anchors": c("anchor_count") >= 50,
        "short_fast": (dur > 0) & (dur <= 10) & (c("net_x") / dur >= 3),
        "sparse_anchors": c("anchor_count") <= 1,
        "circulation_for_review": c("maximum_retreat").between(5, 25) & (c("positive_action_count") >= 2) & (c("negative_action_count") >= 2) & (dur <= 60),
    }
    return j.select(*keys, *[F.coalesce(e, F.lit(False)).alias(n) for n, e in flags.items()])


def select_cases(pool: DataFrame, categories: Sequence[str], keys: Sequence[str], prior: Column, limit: int) -> DataFrame:
    """First group of each category, prior cases first, filled up to ``limit``; more required groups than that is an error.

    Only one key per category and ``limit`` keys for the fill leave the aggregation.
    """
    keys = list(keys)
    rank = F.struct((~prior).alias("later"), *keys)
    firsts = pool.agg(*[F.min(F.when(F.col(c), rank)).alias(c) for c in categories])
    hit = firsts.select(F.explode(F.array_compact(F.array(*[F.col(c) for c in categories]))).alias("r")).select("r.*").distinct()
    if (required := hit.count()) > limit:
        raise ValueError(f"{required} required cases, limit {limit}")
    fill = pool.select((~prior).alias("later"), *keys).orderBy("later", *keys).limit(limit)
    both = hit.withColumn("w", F.lit(0)).unionByName(fill.withColumn("w", F.lit(1)))
    best = both.groupBy("later", *keys).agg(F.min("w").alias("w")).orderBy("w", "later", *keys).limit(limit)
    tagged = best.select(*keys).join(pool, keys)
    reason = F.array_join(F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in categories])), ";")
    return tagged.select(*keys, reason.alias("selection_reason"))


def candidate_moments(timeline: DataFrame, keys: Sequence[str], criteria: dict[str, Column], every: Column, every_reason: str) -> DataFrame:
    """First event meeting each criterion, and all events of literal context, deduplicated by event."""
    keys, at = list(keys), F.col("event_index")
    g = timeline.groupBy(*keys).agg(*[F.min(F.when(c, at)).alias(f"c{i}") for i, c in enumerate(criteria.values())])
    hits = F.array(*[F.struct(F.col(f"c{i}").alias("event_index"), F.lit(n).alias("reason")) for i, n in enumerate(criteria)])
    first = g.select(*keys, F.inline(hits)).where("event_index IS NOT NULL")
    literal = timeline.where(every).select(*keys, "event_index", F.lit(every_reason).alias("reason"))
    return first.unionByName(literal).groupBy(*keys, "event_index").agg(
        F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("candidate_reason")
    )


def candidate_measures(candidates: DataFrame, timeline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Known peak, retreat, and first later recovery at each candidate."""
    on = [*keys, "event_index"]
    j = candidates.join(timeline, on)
    below = F.coalesce(F.col("retreat_from_peak") > 0, F.lit(False))
    nxt = F.col("next_peak")
    return j.select(
        *on,
        "candidate_reason",
        F.col("peak_x").alias("prior_peak_x"),
        "retreat_from_peak",
        ((F.col("t_us") - F.col("peak.t")) / 1e6).alias("seconds_since_peak"),
        (F.col("event_position") - F.col("peak.p")).alias("events_since_peak"),
        F.when(below, nxt.isNotNull()).alias("observed_recovery"),
        F.when(below, (nxt.getField("t") - F.col("t_us")) / 1e6).alias("seconds_to_recovery"),
        F.when(below, nxt.getField("p") - F.col("event_position")).alias("events_to_recovery"),
        F.when(below, F.coalesce(F.col("top_after") > F.col("peak_x"), F.lit(False))).alias("new_peak_afterward"),
        "negative_run_length",
        "nonpositive_run_length",
    )


def context_slice(candidates: DataFrame, timeline: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Rows from n before to n after each candidate, by dense position: a plain equi join."""
    keys = list(keys)
    spot = candidates.join(timeline.select(*keys, "event_index", "event_position"), [*keys, "event_index"])
    wanted = spot.select(
        *keys, F.col("event_index").alias("candidate_event_index"), F.col("event_position").alias("__c"),
        F.explode(F.sequence(F.lit(-n), F.lit(n))).alias("context_offset"),
    ).withColumn("event_position", F.col("__c") + F.col("context_offset"))
    return wanted.join(timeline, [*keys, "event_position"]).drop("__c")


def panel_selection(candidates: DataFrame, case: Sequence[str], group: str, best: Sequence[Column], limit: int) -> DataFrame:
    """Best candidate per case, then round-robin over groups; no task passes on more than ``limit`` cases of a group."""
    case = list(case)
    rank = F.struct(*[b.alias(f"b{i}") for i, b in enumerate(best)])
    one = candidates.groupBy(*case, group).agg(F.min(F.struct(rank.alias("r"), "event_index")).alias("z")).select(*case, group, F.col("z.event_index").alias("event_index"))
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*case)).cast("bigint")
    placed = one.withColumn("within_group", turn).where(F.col("within_group") <= limit)
    return placed.orderBy("within_group", group, *case).limit(limit)


def snapshot_points(events: DataFrame, own: int, keep: Sequence[str], length: float = 120.0, width: float = 80.0) -> DataFrame:
    """Points of chosen events, normalised to the attacking side, with side labels."""
    from strideframe.operators.semantics import normalize_point, point_team_label

    rows = events.select(*keep, "event_team_id", "semantics_status", F.inline("points"))
    cols = normalize_point("x", "y", own, length, width)
    return rows.withColumns({**cols, "side": F.expr(point_team_label(own))})


def manifest_rollup(timeline: DataFrame, keys: Sequence[str]) -> DataFrame:
    return timeline.groupBy(*keys).agg(
        F.count_if(F.col("event_type") == "Shot").alias("shot_count"),
        F.count_if("is_out").alias("out_event_count"),
        F.array_join(F.array_sort(F.collect_set("pass_type")), ";").alias("restart_context"),
    )


def category_coverage(pool: DataFrame, selected: DataFrame, categories: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Pool and selected counts per category and the chosen keys (bounded by the case limit)."""
    def rows(df: DataFrame) -> DataFrame:
        tags = F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in categories]))
        return df.select(*keys, F.explode(tags).alias("category"))

    a = rows(pool).groupBy("category").agg(F.count(F.lit(1)).alias("pool_count"))
    chosen = selected.select(*keys).join(pool, list(keys))
    b = rows(chosen).groupBy("category").agg(
        F.count(F.lit(1)).alias("selected_count"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("-", *keys))), ";").alias("case_ids")
    )
    names = pool.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    out = names.join(a, "category", "left").join(b, "category", "left")
    return out.withColumns({"pool_count": F.coalesce("pool_count", F.lit(0)), "selected_count": F.coalesce("selected_count", F.lit(0)), "case_ids": F.coalesce("case_ids", F.lit(""))})
