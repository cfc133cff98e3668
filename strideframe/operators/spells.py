"""Evidence-based segmentation of possessions into control spells.

The sequential rules are stated as windows: a run of control cues by one team
either establishes control or not, whoever had it before; the owner before a run
is therefore the team of the last establishing run, and no state machine is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.operators.matching import match_nearest
from strideframe.operators.ordered import Lane, Scan, Shift, islands, scan, shift

#: fixed values
ADMIN = ("Starting XI", "Half Start", "Half End", "Substitution", "Tactical Shift", "Player On", "Player Off")
ATTACK = ("Pass", "Carry", "Shot", "Dribble")
STOPPAGES = ("Offside", "Injury Stoppage", "Referee Ball-Drop", "Half End")
HELD = ("Collected", "Keeper Sweeper", "Saved To Post", "Smother")


def dead_reason() -> Column:
    """Ball out > stoppage > foul without advantage > offside pass, else null."""
    has = lambda s: F.array_contains("signals", s)
    return (
        F.when(has("out:true") | has("pass.outcome:Out"), "BALL_OUT")
        .when(F.col("event_type").isin(*STOPPAGES), "STOPPAGE")
        .when(F.col("event_type").isin("Foul Won", "Foul Committed") & ~F.col("advantage"), "FOUL_STOPPAGE")
        .when(has("pass.outcome:Pass Offside"), "STOPPAGE")
    )


def control_evidence() -> dict[str, Column]:
    """Whether a row is a control cue, and whether it shows distribution by itself."""
    t = F.col("event_type")
    none_of = lambda p: ~F.exists("signals", lambda s: s.startswith(p))
    complete = none_of("pass.outcome:")
    cue = (
        F.when(t == "Ball Recovery", ~F.col("recovery_failure"))
        .when(t == "Interception", F.array_contains("signals", "interception.outcome:Won"))
        .when(t == "Pass", complete)
        .when(t == "Carry", F.lit(True))
        .when(t == "Ball Receipt*", none_of("ball_receipt.outcome:"))
        .when(t == "Dribble", F.col("dribble_outcome") == "Complete")
        .when(t == "Goal Keeper", F.col("keeper_type").isin(*HELD))
        .otherwise(F.lit(False))
    )
    return {"cue": cue, "distribution": (t == "Pass") & complete}


def evidence(stream: DataFrame) -> DataFrame:
    return stream.withColumns({"dead": dead_reason(), **control_evidence()})


def control_runs(rows: DataFrame, lane: Lane, own: int) -> DataFrame:
    """One row per run of cues: onset, confirmation, owner before, and what became of it."""
    rows = rows.withColumn("__reset", F.col("dead").isNotNull() | F.col("restart_type").isNotNull())
    rows = scan(
        rows,
        lane,
        {"__seg": Scan("sum", "CAST(__reset AS INT)"), "__later": Scan("sum", "CAST(__reset AS INT)", backward=True, exclusive=True)},
    )
    cues = rows.where("cue AND NOT __reset")
    cues = shift(cues, lane, {"__t": "event_team_id", "__s": "__seg"})
    cues = islands(cues, lane, "__t IS NULL OR __t <> event_team_id OR __s <> __seg", "run")
    in_run = lane.by(*lane.keys, "run")
    cues = scan(
        cues,
        in_run,
        {"__n": Scan("count", "1"), "__act": Scan("max", "event_type IN ('Carry', 'Pass', 'Dribble')")},
    )
    ok = F.col("distribution") | ((F.col("__n") >= 2) & F.col("__act"))
    at = F.col("event_index")
    runs = cues.groupBy(*lane.keys, "run").agg(
        F.min("event_team_id").alias("team"),
        F.min("__seg").alias("seg"),
        F.min(at).alias("onset"),
        F.min(F.when(ok, at)).alias("confirmation"),
        F.min("__later").alias("__later"),
    )
    order = Lane((*lane.keys, "seg"), ("run",), "CAST(floor(run / 100000) AS BIGINT)" if lane.block else None)
    runs = scan(runs, order, {"owner": Scan("last", "CASE WHEN confirmation IS NOT NULL THEN team END", exclusive=True), "__next": Shift("team", -1)})
    owner = F.coalesce("owner", F.lit(own))
    foreign = F.col("team") != owner
    followed = F.when(F.col("__next").isNull(), F.coalesce("__later", F.lit(0)) == 0).otherwise(F.col("__next") == owner)
    return runs.select(
        *lane.keys,
        "team",
        "onset",
        "confirmation",
        (foreign & F.col("confirmation").isNotNull()).alias("is_change"),
        (foreign & F.col("confirmation").isNull() & followed).alias("is_uncertain"),
    )


def control_changes(stream: DataFrame, lane: Lane, own: int) -> DataFrame:
    """Confirmed ownership changes and unconfirmed cues."""
    return control_runs(evidence(stream), lane, own).where("is_change OR is_uncertain")


def with_changes(stream: DataFrame, lane: Lane, own: int) -> DataFrame:
    rows = evidence(stream)
    runs = control_runs(rows, lane, own).where("is_change OR is_uncertain")
    runs = runs.select(
        *[F.col(k).alias(f"__k_{k}") for k in lane.keys],
        F.col("onset").alias("__onset"),
        F.when(F.col("is_change"), F.col("team")).alias("change_team"),
        F.when(F.col("is_change"), F.col("confirmation")).alias("confirmation"),
        "is_uncertain",
    )
    on = F.col("event_index") == F.col("__onset")
    for k in lane.keys:
        on = on & (F.col(k) == F.col(f"__k_{k}"))
    return rows.join(runs, on, "left").drop("__onset", *[f"__k_{k}" for k in lane.keys])


def terminal_shots(rows: DataFrame, lane: Lane, own: int) -> DataFrame:
    """Flag own shots with no later own attacking action before dead ball or opponent control."""
    stop = f"(dead IS NOT NULL OR coalesce(change_team <> {own}, false))"
    attack = f"(event_team_id = {own} AND event_type IN {ATTACK} AND NOT {stop})"
    rows = scan(
        rows,
        lane,
        {
            "__stop": Scan("last", f"CASE WHEN {stop} THEN event_index END", backward=True, exclusive=True),
            "__att": Scan("last", f"CASE WHEN {attack} THEN event_index END", backward=True, exclusive=True),
        },
    )
    shot = F.expr(f"event_type = 'Shot' AND event_team_id = {own}")
    free = F.col("__att").isNull() | F.coalesce(F.col("__stop") < F.col("__att"), F.lit(False))
    return rows.withColumn("terminal_shot", shot & free).drop("__stop", "__att")


def segment(stream: DataFrame, lane: Lane, own: int) -> DataFrame:
    """Membership of every event: spell number and id, order, boundaries and status."""
    rows = terminal_shots(with_changes(stream, lane, own), lane, own)
    keys = list(lane.keys)
    parents = rows.groupBy(*keys).agg(
        F.bool_or(F.expr(f"event_team_id = {own} AND event_type IN {ATTACK}")).alias("__attacks"),
        F.bool_and(F.col("event_type").isin(*ADMIN)).alias("__admin"),
        F.min(F.when(~F.col("event_type").isin(*ADMIN), F.col("event_index"))).alias("__first"),
    )
    rows = rows.join(parents, keys)
    closing = F.when(F.col("terminal_shot"), "TERMINAL_SHOT").otherwise(F.col("dead"))
    restart = closing.isNull() & F.col("restart_type").isNotNull() & (F.col("event_team_id") == own)
    lost = closing.isNull() & ~restart & (F.col("change_team") != own)
    regain = closing.isNull() & ~restart & (F.col("change_team") == own)
    rows = rows.withColumns(
        {
            "__closing": closing,
            "__restart": restart,
            "__lost": F.coalesce(lost, F.lit(False)),
            "__regain": F.coalesce(regain, F.lit(False)),
        }
    )
    rows = scan(rows, lane, {"__dead_before": Scan("max", "__closing IS NOT NULL", exclusive=True)})
    opens = (F.col("event_index") == F.col("__first")) & ~F.coalesce("__dead_before", F.lit(False))
    flag = (
        F.when(F.col("__closing").isNotNull() | F.col("__lost"), 0)
        .when(F.col("__restart") | F.col("__regain") | opens, 1)
    )
    rows = scan(rows.withColumn("__flag", flag), lane, {"__in": Scan("last", "__flag"), "__was": Scan("last", "__flag", exclusive=True)})
    live = F.col("__attacks") & (F.coalesce("__in", F.lit(0)) == 1)
    rows = rows.withColumn("__live", live)
    starts = "__live AND (__restart OR coalesce(__was, 0) <> 1)"
    rows = islands(rows, lane, starts, "__no")
    rows = rows.withColumn("spell_number", F.when(F.col("__live"), F.col("__no").cast("bigint")))
    ended = F.col("__attacks") & (F.col("__was").isNull() | (F.col("__was") == 1))
    reason = (
        F.when(F.col("__closing").isNotNull() & ended, F.col("__closing"))
        .when(F.col("__attacks") & F.col("__restart") & (F.col("__was") == 1), "RESTART")
        .when(F.col("__lost") & ended, "OPPONENT_CONTROL")
    )
    rows = rows.withColumn("boundary_reason", reason)
    named = "coalesce(spell_number, -1)"
    rows = scan(rows, lane, {"__nn": Shift(named, -1), "__nr": Shift("coalesce(boundary_reason, '')", -1), "__pn": Shift(named)})
    member = F.col("spell_number").isNotNull()
    status = (
        F.when(~F.col("__attacks"), F.when(F.col("__admin"), "administrative_no_spell").otherwise("insufficient_context_no_spell"))
        .when(F.col("__closing").isNotNull(), "dead_or_terminal_context")
        .when(member, "control_spell_context")
        .otherwise("outside_control")
    )
    first = member & (F.coalesce("__pn", F.lit(-1)) != F.col("spell_number"))
    last = member & (F.coalesce("__nn", F.lit(-1)) != F.col("spell_number"))
    start_reason = (
        F.when(F.col("__restart") & (F.col("spell_number") == 1), "OPENING_RESTART")
        .when(F.col("__restart"), "RESTART")
        .when(F.col("__regain"), "OWN_REGAIN")
        .otherwise("PROVIDER_PARENT_START")
    )
    rows = rows.withColumns(
        {
            "spell_id": F.when(member, F.concat_ws("-", "match_id", F.concat(F.lit("p"), "period"), F.concat(F.lit("pp"), "possession_id"), F.concat(F.lit("s"), "spell_number"))),
            "boundary_before": first,
            "boundary_after": last,
            "membership_status": status,
            "unconfirmed_control_cue": F.col("__attacks") & F.coalesce("is_uncertain", F.lit(False)),
            "start_reason": F.when(first, start_reason),
            "end_reason": F.when(last, F.when(F.coalesce("__nr", F.lit("")) == "", "PROVIDER_PARENT_END").otherwise(F.col("__nr"))),
        }
    )
    rows = number_members(rows, lane)
    return rows.drop(*[c for c in rows.columns if c.startswith("__")], "is_uncertain", "cue", "distribution", "dead")


def number_members(rows: DataFrame, lane: Lane) -> DataFrame:
    placed = scan(
        rows, lane.by(*lane.keys, "spell_number"), {"spell_event_order": Scan("count", "1")}
    )
    return placed.withColumn("spell_event_order", F.when(F.col("spell_number").isNotNull(), F.col("spell_event_order")))


def spell_summary(members: DataFrame, keys: Sequence[str], own: int) -> DataFrame:
    at = F.col("event_index")
    return (
        members.where("spell_number IS NOT NULL")
        .groupBy(*keys, "spell_number", "spell_id")
        .agg(
            F.min(at).alias("start_event"),
            F.max(at).alias("end_event"),
            ((F.max_by("t_us", at) - F.min_by("t_us", at)) / 1e6).alias("duration_seconds"),
            F.count(F.lit(1)).alias("event_count"),
            F.count_if(F.col("event_team_id") == own).alias("own_event_count"),
            F.count_if(F.col("event_team_id") != own).alias("opponent_event_count"),
            F.max("start_reason").alias("start_reason"),
            F.max("end_reason").alias("end_reason"),
        )
    )


def boundary_table(members: DataFrame, lane: Lane) -> DataFrame:
    """Boundaries in order with confirmation and, after opponent control, the regain."""
    kept = members.where("boundary_reason IS NOT NULL OR boundary_before")
    kept = scan(
        kept,
        lane,
        {"__next": Scan("last", "CASE WHEN boundary_before THEN named_struct('i', event_index, 'r', start_reason) END", backward=True, exclusive=True)},
    ).where("boundary_reason IS NOT NULL")
    lost = F.col("boundary_reason") == "OPPONENT_CONTROL"
    restart = F.col("boundary_reason") == "RESTART"
    return kept.select(
        *lane.keys,
        F.col("event_index").alias("onset_event"),
        F.when(lost, F.col("confirmation")).otherwise(F.col("event_index")).alias("confirmation_event"),
        F.when(restart, F.col("event_index"))
        .when(lost & (F.col("__next.r") == "OWN_REGAIN"), F.col("__next.i"))
        .alias("resume_event"),
        F.when(lost | restart, F.col("boundary_reason")).otherwise("TERMINAL").alias("boundary_type"),
        F.col("boundary_reason").alias("reason"),
    )


def boundary_match(predicted: DataFrame, truth: DataFrame, lane: Lane, case: str = "case_id") -> DataFrame:
    """Score predicted boundaries against truth of the same family, one to one.

    Truths take, in order of onset, the nearest unused prediction of their family;
    ties go to the earlier one.  Same onset and resume is a MATCH, otherwise EARLY
    or LATE by onset; a truth without a prediction is MISSED, unused predictions are
    EXTRA.  Both sides: case, family, onset, resume.  ``lane`` tells whether a case
    fits a task; its block is read from ``at``, the onset.
    """
    lane = lane.by(case, "family")
    resume = F.coalesce(F.col("resume").cast("bigint"), F.lit(-1)).alias("tie")
    same = [case, "family", F.col("onset").alias("at"), resume, F.lit(None).cast("string").alias("id")]
    none = F.lit(None).cast("bigint")
    out = match_nearest(truth.select(*same, none.alias("lower"), none.alias("upper")), predicted.select(*same, none.alias("reach")), lane)
    t, p = F.col("seeker"), F.col("partner")
    label = (
        F.when(t.isNull(), "EXTRA")
        .when(p.isNull(), "MISSED")
        .when((p["at"] == t["at"]) & (p["tie"] == t["tie"]), "MATCH")
        .when(p["at"] < t["at"], "EARLY")
        .otherwise("LATE")
    )
    return out.select(case, "family", t["at"].alias("truth_onset"), p["at"].alias("predicted_onset"), label.alias("result"))
