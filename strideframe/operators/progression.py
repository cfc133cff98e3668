"""Progression of own actions along x: vectors, runs, drawdown, recovery and state.

Streams carry start/end coordinates already normalised to the attacking side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.functions import points as P
from strideframe.operators.ordered import Lane, Scan, Shift, islands, number, scan, shift
from strideframe.operators.quantiles import distribution
from strideframe.operators.sequences import long_rows

#: fixed values: displacement and depth bins, half-open with open ends
DX_EDGES = (-20, -10, 0, 10, 20)
DX_LABELS = ("dx < -20", "[-20,-10)", "[-10,0)", "[0,10)", "[10,20)", "dx >= 20")
DEPTH_EDGES = (0, 30, 60, 80, 100, 120)
DEPTH_LABELS = ("below 0", "[0,30)", "[30,60)", "[60,80)", "[80,100)", "[100,120)", "120 or above")
RETREAT_SWEEP = (5, 10, 15, 20, 25, 30, 40)


def action_vector(events: DataFrame, own: int) -> DataFrame:
    """Displacement of own passes and carries; ``safe`` needs a validated snapshot and both ends."""
    fine = lambda c: F.expr(P.finite(c))
    candidate = (F.col("event_team_id") == own) & F.col("event_type").isin("Pass", "Carry")
    ends = fine("start_x") & fine("start_y") & fine("end_x") & fine("end_y")
    safe = candidate & F.col("validated_anchor") & ends
    dx, dy = F.col("end_x") - F.col("start_x"), F.col("end_y") - F.col("start_y")
    return events.withColumns(
        {
            "safe_action": F.coalesce(safe, F.lit(False)),
            "action_candidate": F.coalesce(candidate, F.lit(False)),
            "explicit_vector_available": F.coalesce(candidate & ends, F.lit(False)),
            "action_status": F.when(safe, "safe_validated_frame_vector")
            .when(~candidate, "not_own_pass_carry")
            .when(~F.col("validated_anchor"), "unsupported_or_unlinked_frame")
            .otherwise("missing_or_invalid_endpoint"),
            "delta_x": F.when(safe, dx),
            "delta_y": F.when(safe, dy),
            "euclidean": F.when(safe, F.hypot(dx, dy)),
        }
    )


def next_event_context(stream: DataFrame, match_lane: Lane, group_lane: Lane) -> DataFrame:
    """One row per signal of an event, and one for each group's final record, with the next event."""
    looked = shift(
        stream,
        match_lane,
        {"next_event_type": "event_type", "next_event_team_id": "event_team_id", "next_possession_team_id": "possession_team_id"},
        -1,
    )
    looked = shift(looked, group_lane, {"__after": "event_index"}, -1)
    final = F.when(F.col("__after").isNull(), F.array(F.lit("provider_group_final_record"))).otherwise(
        F.array().cast("array<string>")
    )
    return looked.withColumn("signal", F.explode(F.concat("signals", final))).drop("__after", "signals")


def action_path(actions: DataFrame, lane: Lane) -> DataFrame:
    """Start and end vertices in order with running peak and retreat below it."""
    vertices = F.array(
        F.struct(F.lit(0).alias("vertex_no"), F.lit("start").alias("vertex"), F.col("start_x").alias("x")),
        F.struct(F.lit(1).alias("vertex_no"), F.lit("end").alias("vertex"), F.col("end_x").alias("x")),
    )
    rows = actions.select("*", F.inline(vertices))
    rows = scan(rows, lane.ordered(*lane.order, "vertex_no"), {"running_peak_x": Scan("max", "x")})
    return rows.withColumn("retreat_from_peak", F.col("running_peak_x") - F.col("x"))


def sign_runs(actions: DataFrame, lane: Lane) -> DataFrame:
    """Maximal runs of positive, negative and non-positive displacement in action order.

    A non-positive run needs at least one strictly negative action.
    """
    kinds = F.array(
        *[
            F.struct(F.lit(k).alias("run_kind"), F.expr(c).alias("__in"))
            for k, c in (("positive", "delta_x > 0"), ("negative", "delta_x < 0"), ("nonpositive", "delta_x <= 0"))
        ]
    )
    by_kind = lane.by(*lane.keys, "run_kind")
    rows = shift(actions.select("*", F.inline(kinds)), by_kind, {"__was": "__in"})
    rows = islands(rows, by_kind, "__in AND NOT coalesce(__was, false)", "__run").where("__in")
    at, size = F.col("event_index"), F.abs("delta_x")
    runs = rows.groupBy(*lane.keys, "run_kind", "__run").agg(
        F.min(at).alias("first_event_index"),
        F.max(at).alias("last_event_index"),
        F.count(F.lit(1)).alias("action_count"),
        F.count_if(F.col("delta_x") < 0).alias("negative_action_count"),
        F.sum(size).alias("cumulative_x"),
        F.max(size).alias("maximum_single"),
        ((F.max_by("t_us", at) - F.min_by("t_us", at)) / 1e6).alias("span_seconds"),
        F.min_by("start_x", at).alias("start_x"),
        F.max_by("end_x", at).alias("end_x"),
        (F.max("event_position") - F.min("event_position") + 1 - F.count(F.lit(1))).alias("intervening_events"),
    )
    return runs.where("run_kind <> 'nonpositive' OR negative_action_count > 0").drop("__run")


def recovery_inventory(path: DataFrame, lane: Lane) -> DataFrame:
    """Excursions below the running peak, recovered at the next vertex at or above it.

    A vertex at or above every earlier one heads an island; the rest of the island
    is the excursion; the next head recovers it, otherwise it is censored.
    """
    order = lane.ordered(*lane.order, "vertex_no")
    rows = scan(path, order, {"__before": Scan("max", "x", exclusive=True)})
    rows = rows.withColumn("__head", F.col("__before").isNull() | (F.col("x") >= F.col("__before")))
    rows = islands(rows, order, "__head", "__island")
    point = F.struct("x", "event_index", "event_position", "t_us")
    at = F.struct("event_index", "vertex_no")
    below = ~F.col("__head")
    parts = rows.groupBy(*lane.keys, "__island").agg(
        F.min_by(point, F.when(F.col("__head"), at)).alias("peak"),
        F.min_by(point, F.when(below, at)).alias("onset"),
        F.min_by(point, F.when(below, F.struct("x", at))).alias("trough"),
        F.max_by(point, at).alias("last"),
    )
    big = Lane(lane.keys, ("__island",), "CAST(floor(__island / 100000) AS BIGINT)" if lane.block else None)
    parts = scan(parts, big, {"next": Shift("peak", -1), "top_after": Scan("max", "peak.x", backward=True, exclusive=True)})
    got = F.col("next").isNotNull()
    seen = F.when(got, F.col("next")).otherwise(F.col("last"))
    wait = lambda a, b: (a.getField("t_us") - b.getField("t_us")) / 1e6
    peak, trough = F.col("peak"), F.col("trough")
    return parts.where("onset IS NOT NULL").select(
        *lane.keys,
        F.col("peak.event_index").alias("peak_event_index"),
        F.col("onset.event_index").alias("onset_event_index"),
        F.col("trough.event_index").alias("trough_event_index"),
        seen.getField("event_index").alias("last_observed_event_index"),
        F.col("peak.x").alias("previous_peak_x"),
        F.col("trough.x").alias("trough_x"),
        (F.col("peak.x") - F.col("trough.x")).alias("retreat_size"),
        got.alias("recovered"),
        F.coalesce(F.col("top_after") > F.col("peak.x"), F.lit(False)).alias("new_peak_reached"),
        F.when(got, wait(seen, peak)).alias("seconds_to_recover"),
        F.when(got, seen.getField("event_position") - F.col("peak.event_position")).alias("events_to_recover"),
        wait(seen, peak).alias("followup_seconds"),
        wait(trough, peak).alias("seconds_peak_to_trough"),
        F.when(got, wait(seen, trough)).alias("seconds_trough_to_recovery"),
    )


def possession_progression(
    possessions: DataFrame, actions: DataFrame, path: DataFrame, runs: DataFrame, recoveries: DataFrame, lane: Lane
) -> DataFrame:
    """One row per group; counts of absent parts are 0, measures stay null."""
    keys, at = list(lane.keys), F.col("event_index")
    stepped = shift(actions, lane, {"__end": "end_x"})
    fwd, back = F.greatest("delta_x", F.lit(0.0)), F.greatest(-F.col("delta_x"), F.lit(0.0))
    a = stepped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("safe_action_count"),
        F.min_by("start_x", at).alias("first_x"),
        F.max_by("end_x", at).alias("last_x"),
        F.sum(fwd).alias("cumulative_forward_x"),
        F.sum(back).alias("cumulative_backward_x"),
        F.max(back).alias("maximum_single_backward"),
        F.count_if(F.col("delta_x") > 0).alias("positive_action_count"),
        F.count_if(F.col("delta_x") < 0).alias("negative_action_count"),
        F.count_if(F.col("delta_x") == 0).alias("zero_action_count"),
        F.coalesce(F.sum(F.col("start_x") - F.col("__end")), F.lit(0.0)).alias("inter_action_jump_sum"),
    )
    a = a.withColumns(
        {
            "net_x": F.col("last_x") - F.col("first_x"),
            "forward_to_backward_ratio": F.col("cumulative_forward_x") / F.nullif(F.col("cumulative_backward_x"), F.lit(0.0)),
        }
    )
    v = path.groupBy(*keys).agg(
        F.max("x").alias("max_x"), F.min("x").alias("min_x"), F.max("retreat_from_peak").alias("maximum_retreat")
    )
    kinds = ("positive", "negative", "nonpositive")
    r = runs.groupBy(*keys).agg(
        *[F.max(F.when(F.col("run_kind") == k, F.col("action_count"))).alias(f"maximum_{k}_run") for k in kinds]
    )
    c = recoveries.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("excursion_count"), F.count_if("recovered").alias("recovery_count")
    )
    out = possessions
    for part in (a, v, r, c):
        out = out.join(part, keys, "left")
    zero = ["safe_action_count", *[f"maximum_{k}_run" for k in kinds], "excursion_count", "recovery_count"]
    return out.withColumns({z: F.coalesce(z, F.lit(0)) for z in zero})


def layer_gaps(stream: DataFrame, layers: dict[str, str], lane: Lane) -> DataFrame:
    """Elapsed seconds between neighbours of a group, separately for several filtered layers."""
    tags = F.array_compact(F.array(*[F.expr(f"CASE WHEN {c} THEN '{n}' END") for n, c in layers.items()]))
    rows = stream.select(*lane.keys, *lane.order, "t_us", F.explode(tags).alias("layer"))
    rows = shift(rows, lane.by(*lane.keys, "layer"), {"__t": "t_us"})
    return rows.where("__t IS NOT NULL").select(
        *lane.keys, "layer", *lane.order, ((F.col("t_us") - F.col("__t")) / 1e6).alias("elapsed_seconds")
    )


def half_open_bin(col: str, edges: Sequence[float]) -> Column:
    """0 below the first edge, then one more per edge reached."""
    return sum(((F.col(col) >= e).cast("int") for e in edges), F.lit(0))


def displacement_bins(actions: DataFrame) -> DataFrame:
    """Counts per action type and displacement bin; bins without actions stay."""
    coded = actions.withColumn("bin", half_open_bin("delta_x", DX_EDGES))
    counts = coded.groupBy("event_type", "bin").agg(F.count(F.lit(1)).alias("n"))
    per_type = counts.groupBy("event_type").agg(F.sum("n").alias("__t"))
    grid = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(x).alias("displacement_bin")) for i, x in enumerate(DX_LABELS)])
    full = per_type.select("*", F.inline(grid)).join(counts, ["event_type", "bin"], "left")
    n = F.coalesce("n", F.lit(0))
    return full.select("event_type", "displacement_bin", n.alias("n"), F.round(100 * n / F.col("__t"), 6).alias("percentage"))


def field_position_summary(actions: DataFrame, small: bool) -> DataFrame:
    """Displacement by starting band; empty bands stay."""
    coded = actions.withColumn("band", half_open_bin("start_x", DEPTH_EDGES))
    extra = {
        "backward": F.count_if(F.col("delta_x") < 0),
        **{f"backward_at_least_{n}": F.count_if(F.col("delta_x") <= -n) for n in (5, 15, 30)},
    }
    d = distribution(coded, ["band"], "delta_x", small, {"median": 0.5, "p90": 0.9}, extra)
    labels = actions.sparkSession.createDataFrame(list(enumerate(DEPTH_LABELS)), "band int, starting_x_band string")
    counts = ["count", *extra]
    return labels.join(d, "band", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts}).drop("band", "std")


def threshold_inventory(possessions: DataFrame, levels: Sequence[float]) -> DataFrame:
    """Groups whose largest retreat reaches each level, among all and among measurable ones."""
    r, ok = F.col("maximum_retreat"), F.col("safe_action_count") > 0
    one = possessions.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(ok).alias("m"),
        *[F.count_if(r >= x).alias(f"c{i}") for i, x in enumerate(levels)],
    )
    return long_rows(
        one,
        [
            {
                "retreat_at_least": F.lit(float(x)),
                "possessions": F.col(f"c{i}"),
                "pct_all": F.round(100 * F.col(f"c{i}") / F.col("n"), 6),
                "pct_measurable": F.round(100 * F.col(f"c{i}") / F.nullif(F.col("m"), F.lit(0)), 6),
            }
            for i, x in enumerate(levels)
        ],
    )


def depth_inventory(path: DataFrame, keys: Sequence[str], depths: Sequence[float], small: bool) -> DataFrame:
    """Largest retreat of each group once a depth has been reached, per depth."""
    tags = F.array(*[F.lit(float(d)) for d in depths])
    rows = path.select(*keys, "running_peak_x", "retreat_from_peak", F.explode(tags).alias("depth"))
    per = rows.where("running_peak_x >= depth").groupBy("depth", *keys).agg(F.max("retreat_from_peak").alias("v"))
    return distribution(per, ["depth"], "v", small, {"median": 0.5, "p90": 0.9}).drop("std")


def duration_landmarks(possessions: DataFrame, limits_us: Sequence[int]) -> DataFrame:
    one = possessions.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("duration_us") > x).alias(f"c{i}") for i, x in enumerate(limits_us)]
    )
    return long_rows(
        one,
        [
            {
                "duration_above_us": F.lit(x).cast("bigint"),
                "possessions": F.col(f"c{i}"),
                "percentage": F.round(100 * F.col(f"c{i}") / F.col("n"), 6),
            }
            for i, x in enumerate(limits_us)
        ],
    )


def signal_sets(parts: dict[str, tuple[DataFrame, dict[str, str]]], keys: Sequence[str]) -> DataFrame:
    """Distinct (signal, setting, key): which groups satisfy each named condition."""
    out = None
    for signal, (df, settings) in parts.items():
        tags = F.array_compact(F.array(*[F.expr(f"CASE WHEN {c} THEN '{s}' END") for s, c in settings.items()]))
        rows = df.select(F.lit(signal).alias("signal"), F.explode(tags).alias("setting"), *keys).distinct()
        out = rows if out is None else out.unionByName(rows)
    return out


def signal_counts(sets: DataFrame) -> DataFrame:
    return sets.groupBy("signal", "setting").agg(F.count(F.lit(1)).alias("possession_count"))


def signal_overlap(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups satisfying both and either of two conditions from different families.

    A group contributes at most the square of the fixed number of settings.
    """
    tag = F.struct("signal", "setting")
    per = sets.groupBy(*keys).agg(F.array_sort(F.collect_set(tag)).alias("s"))
    pairs = per.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a.signal < b.signal")
    both = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("both_possessions"))
    n = signal_counts(sets)
    left = n.select(F.struct("signal", "setting").alias("a"), F.col("possession_count").alias("na"))
    right = n.select(F.struct("signal", "setting").alias("b"), F.col("possession_count").alias("nb"))
    grid = left.crossJoin(F.broadcast(right)).where("a.signal < b.signal")  # one row per setting on each side
    out = grid.join(both, ["a", "b"], "left").withColumn("both_possessions", F.coalesce("both_possessions", F.lit(0)))
    return out.select(
        F.col("a.signal").alias("signal_a"),
        F.col("a.setting").alias("setting_a"),
        F.col("b.signal").alias("signal_b"),
        F.col("b.setting").alias("setting_b"),
        "both_possessions",
        (F.col("na") + F.col("nb") - F.col("both_possessions")).alias("either_possessions"),
    )


def termination_inventory(signals: DataFrame) -> DataFrame:
    """Signal by type, team and what follows; null groups kept."""
    by = ["signal", "event_type", "event_team_id", "next_event_type", "next_possession_team_id"]
    per = signals.groupBy(*by, "match_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*by).agg(F.sum("n").alias("event_count"), F.count(F.lit(1)).alias("match_count"))


def extreme_ranks(possessions: DataFrame, measures: Sequence[str], keys: Sequence[str], top: int) -> DataFrame:
    """Groups in the top of any measure, with all their ranks; each top list is fixed size."""
    lists = None
    for m in measures:
        best = possessions.select(*keys, F.col(m).alias("v")).orderBy(F.desc_nulls_last("v"), *keys).limit(top)
        lane = Lane(("measure",), ("neg", *keys))
        rows = number(best.withColumns({"measure": F.lit(m), "neg": -F.col("v").cast("double")}).where("v IS NOT NULL"), lane, "rank")
        lists = rows if lists is None else lists.unionByName(rows)
    reason = F.concat_ws(":rank_", "measure", F.col("rank").cast("string"))
    return lists.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(reason)), ";").alias("ranking_reasons"))


def condition_picks(possessions: DataFrame, conditions: dict[str, Column], keys: Sequence[str], each: int) -> DataFrame:
    """First groups, in key order, for every condition; reasons joined per group."""
    out = None
    for name, cond in conditions.items():
        rows = possessions.where(cond).select(*keys).orderBy(*keys).limit(each).withColumn("reason", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("reason")), ";").alias("selection_reasons"))


def anchor_displacement(anchors: DataFrame, lane: Lane, x: str, small: bool) -> DataFrame:
    """Coordinate change between consecutive anchors by type and team pair."""
    rows = shift(
        anchors, lane, {"previous_anchor_type": "event_type", "previous_event_team_id": "event_team_id", "__x": x}
    ).where("previous_anchor_type IS NOT NULL")
    rows = rows.withColumn("v", F.col(x) - F.col("__x"))
    by = ["previous_anchor_type", "event_type", "previous_event_team_id", "event_team_id"]
    return distribution(rows, by, "v", small, {"median": 0.5, "p90": 0.9})


def measurement_state(stream: DataFrame, lane: Lane) -> DataFrame:
    """Trusted-action state of each safe, non-failed action inside its session.

    stream: safe_action, failed, trigger, restart (booleans), start_x, end_x.
    ``affected`` is raised when an action starts behind the previous end after a
    relocation trigger, and lowered when a vertex reaches the running peak.
    """
    s = scan(
        stream,
        lane,
        {
            "__trig": Scan("sum", "CAST(trigger AS INT)"),
            "__cut": Scan(
                "sum", "CAST(failed OR (safe_action AND NOT failed AND (restart OR end_x > start_x)) AS INT)"
            ),
            "__res": Scan("sum", "CAST(safe_action AND NOT failed AND restart AS INT)"),
        },
    ).where("safe_action AND NOT failed")
    s = s.withColumn("__v", F.expr("CASE WHEN restart THEN end_x ELSE greatest(start_x, end_x) END"))
    s = s.withColumn("dx", F.col("end_x") - F.col("start_x"))
    s = scan(s, lane, {"__old": Scan("max", "__v", exclusive=True), "__pe": Shift("end_x"), "__pt": Shift("__trig")})
    s = s.withColumn(
        "__step",
        F.expr(
            "CASE WHEN __old IS NULL OR __v >= __old THEN false "
            "WHEN start_x < __pe - 1e-9D AND __trig <> coalesce(__pt, 0) THEN true END"
        ),
    )
    s = scan(s, lane, {"relocation_affected": Scan("last", "__step")})
    runs = lane.by(*lane.keys, "__cut")
    s = scan(s, runs, {"nonpositive_run": Scan("sum", "CAST(dx <= 0 AND NOT restart AS INT)")})
    back = "CASE WHEN NOT restart THEN greatest(-dx, 0D) END"
    since = lane.by(*lane.keys, "__res")
    s = scan(s, since, {"__b1": Shift(back), "__b2": Shift(back, 2)})
    s = s.withColumn("recent_backward", F.expr(f"CASE WHEN restart THEN NULL ELSE greatest({back}, __b1, __b2) END"))
    s = s.withColumns(
        {
            "eligible": F.expr("NOT restart AND NOT coalesce(relocation_affected, false)"),
            "forward_peak": F.expr("dx > 0 AND (__old IS NULL OR end_x > __old)"),
            "retreat": F.expr("greatest(0D, greatest(coalesce(__old, __v), __v) - end_x)"),
            "peak": F.expr("greatest(coalesce(__old, __v), __v)"),
            "at_peak": F.expr("__old IS NULL OR __v >= __old"),
            "inter_action_dx": F.expr("start_x - __pe"),
        }
    )
    return s.drop("__trig", "__cut", "__res", "__v", "__old", "__pe", "__pt", "__step", "__b1", "__b2")


def quality_summary(stream: DataFrame, possessions: DataFrame) -> DataFrame:
    """One row of counters, out-of-bounds actions and zero denominators included."""
    out = lambda x, y: ~(F.col(x).between(0, 120) & F.col(y).between(0, 80))
    safe = F.col("safe_action")
    a = stream.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if("action_candidate").alias("action_candidates"),
        F.count_if("explicit_vector_available").alias("explicit_vectors"),
        F.count_if(safe).alias("safe_actions"),
        F.count_if(safe & (out("start_x", "start_y") | out("end_x", "end_y"))).alias("safe_actions_out_of_bounds"),
        F.count_if(F.col("action_candidate") & ~F.col("explicit_vector_available")).alias("missing_endpoints"),
    )
    p = possessions.agg(
        F.count(F.lit(1)).alias("possessions"),
        F.count_if(F.col("safe_action_count") == 0).alias("possessions_without_safe_action"),
        F.count_if((F.col("safe_action_count") > 0) & (F.col("cumulative_backward_x") == 0)).alias("zero_backward_denominator"),
    )
    return a.crossJoin(p)
