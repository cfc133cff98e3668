"""Reviewed episodes: intervals from a boundary ledger, membership, measures, rule replay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.operators.expectations import require_none
from strideframe.operators.ordered import Lane, Scan, scan, shift
from strideframe.operators.progression import measurement_state
from strideframe.sources.stage import durable

#: fixed values
CLOSERS = ("TERMINAL", "REVIEW_DEFERRED")
HARD = ("OPPONENT_CONTROL", "TERMINAL")
VERSIONS = ("v0.1", "v0.2", "v0.3")


def episode_map(parents: DataFrame, ledger: DataFrame, lane_block: str | None = None) -> DataFrame:
    """Contiguous episodes between reviewed boundaries of each case.

    parents: case_id, first_event, last_event; ledger: case_id, boundary_id,
    boundary_type, onset (or onset_lower), resume, precision.  A closing boundary
    starts nothing; an interval that ends before it starts is no episode.
    """
    out = ledger.where(F.col("boundary_type").endswith("EXCLUDE")).select("case_id").distinct()
    cut = F.coalesce("onset", "onset_lower")
    rows = parents.select(
        "case_id",
        F.lit(-1).cast("bigint").alias("cut"),
        F.lit("").alias("boundary_id"),
        F.col("first_event").alias("start"),
        F.lit("PARENT_START").alias("start_reason"),
        F.lit("").alias("kind"),
        F.lit(True).alias("state_valid"),
    ).unionByName(
        ledger.select(
            "case_id",
            cut.alias("cut"),
            "boundary_id",
            F.when(~F.col("boundary_type").isin(*CLOSERS), F.col("resume")).alias("start"),
            F.when(F.col("boundary_type") == "CLEAR_RESET", "CLEAR_RESET").otherwise("HARD_BOUNDARY_REGAIN").alias("start_reason"),
            F.col("boundary_type").alias("kind"),
            (F.coalesce("precision", F.lit("")) != "unresolved_onset").alias("state_valid"),
        )
    )
    lane = Lane(("case_id",), ("cut", "boundary_id"), lane_block)
    rows = rows.join(out, "case_id", "left_anti")
    rows = shift(rows, lane, {"__cut": "cut", "__kind": "kind", "__id": "boundary_id"}, -1)
    rows = rows.join(parents.select("case_id", "last_event"), "case_id")
    rows = rows.withColumns(
        {
            "end": F.coalesce(F.col("__cut") - 1, F.col("last_event")),
            "end_reason": F.coalesce("__kind", F.lit("PARENT_OBSERVATION_END")),
            "end_boundary_id": F.coalesce("__id", F.lit("")),
        }
    ).where("start IS NOT NULL AND end >= start")
    rows = scan(rows, lane, {"n": Scan("count", "1")})
    return rows.select(
        "case_id",
        F.format_string("%s_E%02d", "case_id", "n").alias("episode_id"),
        F.col("start").alias("episode_start"),
        F.col("end").alias("episode_end"),
        "start_reason",
        "end_reason",
        F.col("boundary_id").alias("start_boundary_id"),
        "end_boundary_id",
        "state_valid",
    )


def _require_apart(intervals: DataFrame, lo: str, hi: str, lane: Lane) -> None:
    """Intervals of a case must not overlap."""
    rows = intervals.select("case_id", F.col(lo).alias("event_index"), F.col(hi).alias("__hi"))
    rows = scan(rows, lane.by("case_id").ordered("event_index", "__hi"), {"__before": Scan("max", "__hi", exclusive=True)})
    require_none(rows, {"overlapping_intervals": F.col("__before") >= F.col("event_index")})


def assign_membership(events: DataFrame, episodes: DataFrame, lane: Lane) -> DataFrame:
    """Episode of every event by an as-of look-back at episode starts; no event-by-episode pairs. Overlaps are an error."""
    _require_apart(episodes, "episode_start", "episode_end", lane)
    mark = F.struct("episode_id", "episode_start", "episode_end", "start_reason", "end_reason", "state_valid")
    e = events.withColumns({"__rank": F.lit(1), "__ep": F.lit(None)})
    starts = episodes.select("case_id", F.col("episode_start").alias("event_index"), F.lit(0).alias("__rank"), mark.alias("__ep"))
    rows = e.drop("__ep").unionByName(starts, allowMissingColumns=True)
    rows = scan(rows, lane.by("case_id").ordered("event_index", "__rank"), {"__at": Scan("last", "__ep")}).where("__rank = 1")
    inside = F.coalesce(F.col("event_index") <= F.col("__at.episode_end"), F.lit(False))
    out = rows.select(*events.columns, *[F.when(inside, F.col(f"__at.{c}")).alias(c) for c in ("episode_id", "episode_start", "episode_end", "start_reason", "end_reason", "state_valid")])
    out = scan(out, lane.by("case_id", "episode_id"), {"__t0": Scan("first", "t_us")})
    status = F.when(F.col("episode_id").isNull(), "boundary_or_unresolved_context").when(F.col("state_valid"), "reviewed_episode_context").otherwise("provisional_episode_context")
    return out.withColumns(
        {"episode_elapsed_seconds": F.when(F.col("episode_id").isNotNull(), (F.col("t_us") - F.col("__t0")) / 1e6), "membership_status": status}
    ).drop("__t0")


def episode_progression(members: DataFrame, lane: Lane) -> DataFrame:
    """Trusted-action measures inside each episode with later recovery or censoring.

    members: the columns of ``measurement_state`` plus episode and event position.
    The next row that reaches the running peak is the recovery of every row below it.
    """
    s = members.where("episode_id IS NOT NULL")
    ends = s.groupBy(*lane.keys).agg(F.max("event_index").alias("__last"), F.max("t_us").alias("__last_t"))
    m = measurement_state(s, lane)
    here = "CASE WHEN at_peak THEN named_struct('t', t_us, 'p', event_position) END"
    m = scan(
        m,
        lane,
        {
            "__pk": Scan("last", here),
            "__nx": Scan("last", here, backward=True, exclusive=True),
            "__top": Scan("max", "CASE WHEN restart THEN end_x ELSE greatest(start_x, end_x) END", backward=True, exclusive=True),
        },
    ).join(ends, list(lane.keys))
    got, up = F.col("__nx").isNotNull(), F.col("retreat") == 0
    return m.withColumns(
        {
            "seconds_since_peak": (F.col("t_us") - F.col("__pk.t")) / 1e6,
            "events_since_peak": F.col("event_position") - F.col("__pk.p"),
            "new_peak_afterward": F.col("__top") > F.col("peak"),
            "recovery_status": F.when(up, "not_applicable_at_peak").when(got, "observed_equal_or_higher_peak").otherwise("censored_at_episode_observation_end"),
            "seconds_to_recovery": F.when(~up & got, (F.col("__nx.t") - F.col("t_us")) / 1e6),
            "events_to_recovery": F.when(~up & got, F.col("__nx.p") - F.col("event_position")),
            "censor_event": F.when(~up & ~got, F.col("__last")),
            "followup_seconds": F.when(~up & ~got, (F.col("__last_t") - F.col("t_us")) / 1e6),
        }
    ).drop("__pk", "__nx", "__top", "__last", "__last_t")


def role_assignment(candidates: DataFrame, intervals: DataFrame, lane: Lane) -> DataFrame:
    """Role of each candidate from the reviewed interval it falls in.

    intervals: case_id, lo, hi, role; an as-of look-back decides, so overlaps are an error.
    """
    _require_apart(intervals, "lo", "hi", lane)
    starts = intervals.select("case_id", F.col("lo").alias("event_index"), F.lit(0).alias("__r"), F.struct("hi", "role").alias("__iv"))
    rows = candidates.withColumn("__r", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    rows = scan(rows, lane.by("case_id").ordered("event_index", "__r"), {"__at": Scan("last", "__iv")}).where("__r = 1")
    role = F.when(F.col("event_index") <= F.col("__at.hi"), F.col("__at.role")).otherwise("continuation_context")
    return rows.select(*candidates.columns, role.alias("candidate_role"))


def compare_diagnostics(old: DataFrame, new: DataFrame, keys: Sequence[str], metrics: Sequence[str], tol: float = 1e-9) -> DataFrame:
    """Long comparison per metric: unchanged, value_changed, availability_changed, both_missing."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics])))

    j = long(old, "old_value").join(long(new, "new_value"), [*keys, "metric"], "full")
    a, b = F.col("old_value"), F.col("new_value")
    state = (
        F.when(a.isNull() & b.isNull(), "both_missing")
        .when(a.isNull() | b.isNull(), "availability_changed")
        .when(F.abs(a - b) <= tol, "unchanged")
        .otherwise("value_changed")
    )
    return j.withColumn("comparison", state)


def episode_summary(members: DataFrame, measures: DataFrame) -> DataFrame:
    """Events, trusted actions, largest retreat and recoveries per episode."""
    keys = ["case_id", "episode_id"]
    a = members.where("episode_id IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("event_count"))
    b = measures.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trusted_actions"),
        F.max("retreat").alias("maximum_retreat"),
        F.count_if(F.col("recovery_status") == "observed_equal_or_higher_peak").alias("recovered_rows"),
        F.count_if(F.col("recovery_status") == "censored_at_episode_observation_end").alias("censored_rows"),
    )
    out = a.join(b, keys, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("trusted_actions", "recovered_rows", "censored_rows")})


def cut_at_hard(stream: DataFrame, hard: DataFrame, lane: Lane) -> DataFrame:
    """Rows of each case between hard boundaries, with ``part`` (0 before the first boundary) and ``part_end``.

    hard: case_id, onset, resume; a boundary counts if the case has an event at its onset. Rows from an onset up to its
    resume are left out, to the end if resume is null; of boundaries with one onset the latest resume holds.
    ``part_end`` is the onset that ends the part, null in the last part. Empty ledgers leave one part.
    """
    marks = hard.where("onset IS NOT NULL").groupBy("case_id", F.col("onset").alias("event_index")).agg(
        F.max(F.coalesce("resume", F.lit(2**63 - 1))).alias("__resume")
    )
    rows = scan(
        stream.join(marks, ["case_id", "event_index"], "left"),
        lane.by("case_id"),
        {
            "part": Scan("count", "__resume"),
            "__until": Scan("last", "__resume"),
            "part_end": Scan("min", "CASE WHEN __resume IS NOT NULL THEN event_index END", backward=True, exclusive=True),
        },
    )
    return rows.where("__until IS NULL OR event_index >= __until").drop("__resume", "__until")


def in_masks(spans: DataFrame, masks: DataFrame, lane: Lane, first: str, last: str) -> DataFrame:
    """``spans`` with ``masked``: whether some mask (case_id, lo, hi) overlaps first..last.

    That is so if the largest ``hi`` of the masks that begin by ``last`` reaches ``first``: one running maximum, no pairs.
    """
    rows = spans.withColumns({"__at": F.col(last).cast("bigint"), "__r": F.lit(1), "__hi": F.lit(None).cast("bigint")})
    starts = masks.select("case_id", F.col("lo").cast("bigint").alias("__at"), F.lit(0).alias("__r"), F.col("hi").cast("bigint").alias("__hi"))
    rows = rows.unionByName(starts, allowMissingColumns=True)
    block = "CAST(floor(__at / 100000) AS BIGINT)" if lane.block else None
    rows = scan(rows, Lane(("case_id",), ("__at", "__r"), block), {"__reach": Scan("max", "__hi")}).where("__r = 1")
    return rows.select(*spans.columns, F.coalesce(F.col("__reach") >= F.col(first), F.lit(False)).alias("masked"))


def _first_warning(live: DataFrame, lane: Lane, warn: float, confirm: float, slow: float) -> DataFrame:
    """The next warning of every group of ``lane`` after its ``decided`` event and how it ends; one row per group that has one."""
    m = scan(measurement_state(live, lane), lane, {"__peak_t": Scan("last", "CASE WHEN at_peak THEN t_us END")})
    m = m.where("decided IS NULL OR event_index > decided")
    wakes = "CASE mode WHEN 'ACTIVE' THEN true WHEN 'DISARMED' THEN dx > 0 ELSE forward_peak AND (version = 'v0.1' OR end_x >= rearm) END"
    m = scan(m, lane, {"__awake": Scan("max", f"{wakes} AND (mode = 'ACTIVE' OR NOT coalesce(relocation_affected, false))")})
    m = m.where("eligible AND NOT masked")
    opens = f"__awake AND retreat >= {warn} AND (version <> 'v0.3' OR dx <= 0)"
    mark = "named_struct('onset', event_index, 'peak', peak, 'peak_t', __peak_t, 'retreat', retreat, 'mask_at', mask_at)"
    m = scan(m, lane, {"w": Scan("first", f"CASE WHEN {opens} THEN {mark} END")}).where("w.onset IS NOT NULL AND event_index < coalesce(w.mask_at, event_index + 1)")
    m = scan(m, lane, {"__low": Scan("min", "CASE WHEN version = 'v0.3' THEN least(start_x, end_x) ELSE end_x END")})
    m = m.withColumns(
        {
            "deep": F.expr("greatest(w.retreat, w.peak - __low)"),
            "gap": F.expr("greatest(0D, w.peak - end_x)"),
            "age": F.expr("(t_us - w.peak_t) / 1e6"),
        }
    )
    # the last version decides at the first forward step after the onset, earlier ones at every step from the onset on
    how = F.expr(
        f"""CASE WHEN version = 'v0.3' THEN CASE WHEN dx > 0 AND event_index > w.onset THEN if(deep >= {confirm} OR age >= {slow}, 'CONFIRMED', 'CANCELLED') END
        WHEN dx > 0 AND gap < {warn} THEN 'CANCELLED'
        WHEN (gap >= {confirm} OR recent_backward >= {warn}) AND (age >= {slow} OR nonpositive_run >= 2) THEN 'CONFIRMED' END"""
    )
    m = m.withColumn("how", how)
    ends = m.groupBy(*lane.keys).agg(
        F.min_by(F.struct("event_index", "how", "deep"), F.when(F.col("how").isNotNull(), F.col("event_index"))).alias("c"),
        F.min_by(F.struct("w", "part_end", "last_event", "base"), "event_index").alias("o"),
        F.max("deep").alias("deepest"),
    )
    resolution = (
        F.when(F.col("c.how").isNotNull(), F.col("c.how"))
        .when(F.col("o.w.mask_at").isNotNull(), "CENSORED_REVIEW_MASK")
        .when(F.col("o.part_end").isNotNull(), "SUPERSEDED_HARD_BOUNDARY")
        .otherwise("CENSORED_PARENT_END")
    )
    return ends.select(
        *lane.keys,
        F.col("o.w.onset").alias("onset"),
        F.coalesce("c.event_index", "o.w.mask_at", "o.part_end", "o.last_event").alias("end_event"),
        resolution.alias("resolution"),
        F.col("o.w.peak").alias("peak"),
        F.coalesce("c.deep", "deepest").alias("maximum_retreat"),
        F.col("o.base").alias("base"),
    )


def drawdown_detector(stream: DataFrame, lane: Lane, versions: Sequence[str] = VERSIONS, warn: float = 10.0, confirm: float = 20.0, slow: float = 5.0) -> DataFrame:
    """Warnings of deep retreat and how each ended: ``version``, the lane's keys, onset, end_event, resolution, peak, maximum_retreat.

    stream: the columns of ``measurement_state``, t_us, ``part_end`` (see ``cut_at_hard``) and ``masked``, which counts in
    v0.3 only. A confirmation measures anew from its onset and decides on what follows it. So each round takes the next
    warning of all groups at once, by running aggregates since the group's last decision; groups whose warning was
    confirmed, cancelled or masked go on, with the rows that they still need. There are as many rounds as the group with
    most warnings has. Null ``masked`` counts as false; groups without trusted actions give no rows.
    """
    if unknown := set(versions) - set(VERSIONS):
        raise ValueError(f"unknown versions {sorted(unknown)}")
    rows = stream.withColumn("version", F.explode(F.array(*map(F.lit, versions))))
    rows = rows.withColumn("masked", (F.col("version") == "v0.3") & F.coalesce("masked", F.lit(False)))
    lane = lane.by("version", *lane.keys)
    rows = scan(
        rows,
        lane,
        {
            "mask_at": Scan("min", "CASE WHEN masked THEN event_index END", backward=True, exclusive=True),
            "last_event": Scan("max", "event_index", backward=True),
        },
    )
    needed = ["event_index", "t_us", "safe_action", "failed", "trigger", "restart", "start_x", "end_x", "masked", "part_end", "mask_at", "last_event"]
    rows = rows.select(*lane.keys, *needed)
    nothing = F.lit(None).cast("bigint")
    live = rows.withColumns({"base": nothing, "decided": nothing, "rearm": F.lit(None).cast("double"), "mode": F.when(F.col("version") == "v0.3", "ACTIVE").otherwise("DISARMED")})
    out = None
    while True:
        live = durable(live)
        found = durable(_first_warning(live, lane, warn, confirm, slow))
        out = found if out is None else out.unionByName(found)
        again = F.col("resolution") == "CONFIRMED"
        state = found.where(again | F.col("resolution").isin("CANCELLED", "CENSORED_REVIEW_MASK")).select(
            *lane.keys,
            F.when(again, F.col("onset")).otherwise(F.col("base")).alias("base"),
            F.col("end_event").alias("decided"),
            F.when(again, F.col("peak")).alias("rearm"),
            F.when(again, "REBUILD").otherwise("ACTIVE").alias("mode"),
        )
        if state.isEmpty():
            return out.drop("base")
        live = live.drop("base", "decided", "rearm", "mode").join(state, list(lane.keys)).where("base IS NULL OR event_index >= base")
