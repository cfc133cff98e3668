"""Review sampling, episodes, rule replay, label statistics and season tables."""

from pyspark.sql import functions as F

from strideframe.operators import episodes as P
from strideframe.operators import labels as B
from strideframe.operators import progression as R
from strideframe.operators import review as V
from strideframe.operators.ordered import neighbours, number
from strideframe.plans.fixtures import EV, HOUR_US, KEY, OWN, OWN_EV, RICH, RPT, TALLY, EF, sql
from strideframe.plans.q_audit import SEM, semantic
from strideframe.plans.q_progression import FULL, path, possessions, recoveries, state_stream
from strideframe.plans.registry import query
from strideframe.sources import readers
from strideframe.sources.stage import durable

K = ", ".join(KEY)
W = f"(PARTITION BY {K} ORDER BY event_index)"


def rd(df, r=6):
    return df.withColumns({c: F.round(c, r) for c, t in df.dtypes if t == "double"})


def stream(fx):
    return R.action_vector(fx.rich.where(F.col("possession_team_id") == OWN), OWN)


def timeline(fx):
    return V.complete_timeline(stream(fx), fx.lane(*KEY))


TL = f"""t0 AS (SELECT *, ROW_NUMBER() OVER {W} - 1 AS event_position, event_team_id = {OWN} AND event_type IN ('Pass', 'Carry') AND validated_anchor AND end_x IS NOT NULL AS safe,
   (t_us - LAG(t_us) OVER {W}) / 1e6 AS prior_gap_seconds FROM rich WHERE possession_team_id = {OWN}),
 t1 AS (SELECT *, CASE WHEN safe THEN GREATEST(start_x, end_x) END AS v, CASE WHEN safe THEN end_x - start_x END AS dx FROM t0),
 t2 AS (SELECT *, MAX(v) OVER {W} AS peak_x FROM t1),
 t3 AS (SELECT a.*, (SELECT MIN(b.event_index) FROM t2 b WHERE b.match_id = a.match_id AND b.period = a.period AND b.possession_id = a.possession_id AND b.event_index > a.event_index AND b.v >= a.peak_x) AS next_i,
   (SELECT MAX(b.event_index) FROM t2 b WHERE b.match_id = a.match_id AND b.period = a.period AND b.possession_id = a.possession_id AND b.event_index <= a.event_index AND b.v = a.peak_x) AS peak_i FROM t2 a),
 rl AS (SELECT event_id, COUNT(*) FILTER (dx < 0) OVER (PARTITION BY {K}, n1 ORDER BY event_index) AS neg, COUNT(*) FILTER (dx <= 0) OVER (PARTITION BY {K}, n2 ORDER BY event_index) AS nonpos FROM (
   SELECT *, COUNT(*) FILTER (NOT dx < 0) OVER w AS n1, COUNT(*) FILTER (NOT dx <= 0) OVER w AS n2 FROM t1 WHERE safe WINDOW w AS {W})),
 tl AS (SELECT t3.*, CASE WHEN safe THEN peak_x - end_x END AS retreat_from_peak, NULLIF(neg, 0) AS negative_run_length, NULLIF(nonpos, 0) AS nonpositive_run_length FROM t3 LEFT JOIN rl USING (event_id))"""
_B = (EV, RICH)


@query(
    "rev1_complete_timeline",
    sql(f"{TL} SELECT event_id, event_position, prior_gap_seconds, peak_x, retreat_from_peak, peak_i, next_i, negative_run_length, nonpositive_run_length FROM tl", *_B),
)
def rev1(fx):
    return timeline(fx).select(
        "event_id", "event_position", "prior_gap_seconds", "peak_x", "retreat_from_peak", F.col("peak.i").alias("peak_i"),
        F.col("next_peak.i").alias("next_i"), "negative_run_length", "nonpositive_run_length",
    )


@query(
    "rev2_local_peak_count",
    sql(
        f"""{FULL}, m AS (SELECT * FROM (SELECT *, LAG(x) OVER (PARTITION BY {K} ORDER BY event_index, vertex_no) AS p FROM path) WHERE p IS NULL OR p <> x),
 l AS (SELECT *, LAG(x) OVER w AS a, LEAD(x) OVER w AS b FROM m WINDOW w AS (PARTITION BY {K} ORDER BY event_index, vertex_no)) SELECT {K}, COUNT(*) FILTER (x > a AND x > b) AS local_peaks FROM l GROUP BY {K}""",
        EV, OWN_EV,
    ),
)
def rev2(fx):
    return V.local_peak_count(path(fx), fx.lane(*KEY))


#: Names of the sampling criteria.
_CATS = ["nearly_monotonic", "one_small_backward", "large_single_backward", "single_without_extended_run", "gradual_multi_action",
         "high_backward_without_large_action", "immediate_observed_recovery", "delayed_observed_recovery", "unrecovered_observation",
         "retreat_then_renewed_progression", "advanced_origin_retreat", "deeper_origin_retreat", "corner_started", "free_kick_started",
         "throw_in_restart", "out_context", "shot_context", "opponent_pressure_anchor", "shot_then_same_parent_actions",
         "multiple_local_peaks_long", "very_long", "dense_anchors", "short_fast", "sparse_anchors", "circulation_for_review"]


def flags(fx):
    return V.category_flags(possessions(fx), recoveries(fx), stream(fx), V.local_peak_count(path(fx), fx.lane(*KEY)), KEY, OWN, HOUR_US)


_HOURS = "(duration_us / 3600000000)"
_MINE = f"(event_team_id = {OWN} AND event_type IN ('Pass', 'Carry'))"
#: The criteria and their thresholds.
_CRITERIA = {
    "nearly_monotonic": "positive_action_count >= 2 AND maximum_retreat <= 5",
    "one_small_backward": "negative_action_count = 1 AND maximum_single_backward <= 5 AND cumulative_forward_x >= 30",
    "large_single_backward": "maximum_single_backward >= 20",
    "single_without_extended_run": "maximum_single_backward >= 20 AND maximum_negative_run = 1",
    "gradual_multi_action": "maximum_negative_run >= 3 AND cumulative_backward_x >= 15 AND maximum_single_backward < 20",
    "high_backward_without_large_action": "cumulative_backward_x >= 40 AND maximum_single_backward < 20",
    "corner_started": "first_pass = 'Corner'",
    "free_kick_started": "first_pass = 'Free Kick'",
    "shot_then_same_parent_actions": "last_action > first_shot",
    "multiple_local_peaks_long": f"{_HOURS} > 60 AND local_peaks >= 3",
    "very_long": f"{_HOURS} > 120",
    "dense_anchors": "anchor_count >= 50",
    "short_fast": f"{_HOURS} > 0 AND {_HOURS} <= 10 AND net_x / NULLIF({_HOURS}, 0) >= 3",
    "sparse_anchors": "anchor_count <= 1",
    "circulation_for_review": f"maximum_retreat BETWEEN 5 AND 25 AND positive_action_count >= 2 AND negative_action_count >= 2 AND {_HOURS} <= 60",
}
FLG = f"""{FULL}, rf AS (SELECT {K}, BOOL_OR(NOT recovered) AS unrecovered_observation, BOOL_OR(new_peak_reached) AS retreat_then_renewed_progression,
  BOOL_OR(recovered AND seconds_to_recover <= 3 * 3600) AS immediate_observed_recovery, BOOL_OR(recovered AND seconds_to_recover > 15 * 3600) AS delayed_observed_recovery,
  BOOL_OR(retreat_size BETWEEN 20 AND 40 AND previous_peak_x >= 100) AS advanced_origin_retreat, BOOL_OR(retreat_size BETWEEN 20 AND 40 AND previous_peak_x <= 60) AS deeper_origin_retreat FROM rec GROUP BY {K}),
 tf AS (SELECT {K}, BOOL_OR(pass_type = 'Throw-in') AS throw_in_restart, BOOL_OR(is_out) AS out_context, BOOL_OR(event_type = 'Shot') AS shot_context,
  BOOL_OR(validated_anchor AND event_team_id <> {OWN} AND event_type = 'Pressure') AS opponent_pressure_anchor,
  arg_min(COALESCE(pass_type, ''), event_index) FILTER ({_MINE}) AS first_pass, MAX(event_index) FILTER ({_MINE}) AS last_action,
  MIN(event_index) FILTER (event_type = 'Shot' AND event_team_id = {OWN}) AS first_shot FROM rich WHERE possession_team_id = {OWN} GROUP BY {K}),
 lm AS (SELECT * FROM (SELECT *, LAG(x) OVER (PARTITION BY {K} ORDER BY event_index, vertex_no) AS before FROM path) WHERE before IS NULL OR before <> x),
 ll AS (SELECT *, LAG(x) OVER u AS xa, LEAD(x) OVER u AS xb FROM lm WINDOW u AS (PARTITION BY {K} ORDER BY event_index, vertex_no)),
 lp AS (SELECT {K}, COUNT(*) FILTER (x > xa AND x > xb) AS local_peaks FROM ll GROUP BY {K}),
 fg AS (SELECT {K}, {", ".join(f"COALESCE({_CRITERIA.get(c, c)}, FALSE) AS {c}" for c in _CATS)}
  FROM pp LEFT JOIN rf USING ({K}) LEFT JOIN tf USING ({K}) LEFT JOIN lp USING ({K}))"""
_BF = (EV, RICH, OWN_EV)


@query("rev3_category_flags", sql(f"{FLG} SELECT * FROM fg", *_BF))
def rev3(fx):
    return flags(fx).select(*KEY, *_CATS)


#: possessions of an earlier review, which come first; the size of a review
PRIOR, CASES = "possession_id % 5 = 0", 28
CHO = f"""{FLG}, oc AS (SELECT *, ROW_NUMBER() OVER (ORDER BY NOT ({PRIOR}), {K}) AS rk FROM fg),
 hc AS ({" UNION ALL ".join(f"SELECT MIN(rk) AS rk FROM oc WHERE {c}" for c in _CATS)}), wc AS (SELECT rk, 0 AS w FROM hc WHERE rk IS NOT NULL UNION ALL SELECT rk, 1 FROM oc),
 bc AS (SELECT rk, MIN(w) AS w FROM wc GROUP BY rk ORDER BY MIN(w), rk LIMIT {CASES}), ch AS (SELECT oc.* FROM bc JOIN oc USING (rk))"""


def chosen(pool):
    return V.select_cases(pool, _CATS, KEY, F.expr(PRIOR), CASES)


@query(
    "rev4_select_cases",
    sql(
        f"""{CHO} SELECT {K}, concat_ws(';', {", ".join(f"CASE WHEN {c} THEN '{c}' END" for c in _CATS)}) AS selection_reason FROM ch""",
        *_BF,
    ),
)
def rev4(fx):
    return chosen(durable(flags(fx)))


def criteria():
    c = {}
    for n in (5, 15, 30, 40):
        c[f"single_negative>={n}"] = F.col("delta_x") <= -n
        c[f"peak_retreat>={n}"] = F.col("retreat_from_peak") >= n
    for n in (2, 3):
        c[f"negative_run>={n}"] = F.col("negative_run_length") >= n
        c[f"nonpositive_run>={n}"] = F.col("nonpositive_run_length") >= n
    c["first_negative"] = F.col("delta_x") < 0
    for h in (1, 3):
        c[f"gap>{h}h"] = F.col("prior_gap_seconds") > h * 3600
    return c


_CRIT = {
    **{f"single_negative>={n}": f"dx <= -{n}" for n in (5, 15, 30, 40)}, **{f"peak_retreat>={n}": f"retreat_from_peak >= {n}" for n in (5, 15, 30, 40)},
    **{f"{k}_run>={n}": f"{k}_run_length >= {n}" for k in ("negative", "nonpositive") for n in (2, 3)}, "first_negative": "dx < 0",
    **{f"gap>{h}h": f"prior_gap_seconds > {h * 3600}" for h in (1, 3)},
}
LIT = "event_type IN ('Shot', 'Foul Won', 'Offside') OR is_out OR pass_type IN ('Corner', 'Throw-in')"
MOM = f"""{TL}, mo AS ({" UNION ALL ".join(f"SELECT {K}, MIN(event_index) AS event_index, '{n}' AS reason FROM tl WHERE {c} GROUP BY {K}" for n, c in _CRIT.items())}
  UNION ALL SELECT {K}, event_index, 'literal context' FROM tl WHERE {LIT}),
 cm AS (SELECT {K}, event_index, string_agg(DISTINCT reason, '; ' ORDER BY reason) AS candidate_reason FROM mo GROUP BY {K}, event_index)"""


def moments(fx, t):
    return V.candidate_moments(t, KEY, criteria(), F.coalesce(F.expr(LIT), F.lit(False)), "literal context")


@query("rev5_candidate_moments", sql(f"{MOM} SELECT * FROM cm", *_B))
def rev5(fx):
    return moments(fx, timeline(fx))


@query(
    "rev6_candidate_measures",
    sql(
        f"""{MOM} SELECT {K}, event_index, tl.peak_x AS prior_peak_x, tl.retreat_from_peak, (tl.t_us - p.t_us) / 1e6 AS seconds_since_peak, tl.event_position - p.event_position AS events_since_peak,
 CASE WHEN tl.retreat_from_peak > 0 THEN n.event_index IS NOT NULL END AS observed_recovery, CASE WHEN tl.retreat_from_peak > 0 THEN (n.t_us - tl.t_us) / 1e6 END AS seconds_to_recovery,
 CASE WHEN tl.retreat_from_peak > 0 THEN EXISTS (SELECT 1 FROM tl z WHERE z.match_id = tl.match_id AND z.period = tl.period AND z.possession_id = tl.possession_id AND z.event_index > tl.event_index AND z.v > tl.peak_x) END AS new_peak_afterward
 FROM cm JOIN tl USING ({K}, event_index) LEFT JOIN tl p ON p.match_id = tl.match_id AND p.event_index = tl.peak_i LEFT JOIN tl n ON n.match_id = tl.match_id AND n.event_index = tl.next_i""".replace(
            f"SELECT {K}, event_index, tl.peak_x", "SELECT cm.match_id, cm.period, cm.possession_id, cm.possession_team_id, cm.event_index, tl.peak_x"
        ),
        *_B,
    ),
)
def rev6(fx):
    t = durable(timeline(fx))
    return V.candidate_measures(moments(fx, t), t, KEY).drop("candidate_reason", "events_to_recovery", "negative_run_length", "nonpositive_run_length")


@query(
    "rev7_anchor_neighbors",
    sql(
        f"""SELECT event_id, MAX(CASE WHEN validated_anchor THEN event_index END) OVER (PARTITION BY {K} ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_anchor,
 CASE WHEN validated_anchor THEN event_index END AS at_anchor, MIN(CASE WHEN validated_anchor THEN event_index END) OVER (PARTITION BY {K} ORDER BY event_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after_anchor FROM own""",
        EV, OWN_EV,
    ),
)
def rev7(fx):
    out = neighbours(fx.own, fx.lane(*KEY), "validated_anchor", "event_index", "before_anchor", "after_anchor")
    return out.select("event_id", "before_anchor", F.when(F.col("validated_anchor"), F.col("event_index")).alias("at_anchor"), "after_anchor")


@query(
    "rev8_context_slice",
    sql(
        f"""{MOM} SELECT cm.match_id, cm.event_index AS candidate_event_index, x.event_index, x.event_position - c.event_position AS context_offset FROM cm JOIN tl c USING ({K}, event_index)
 JOIN tl x ON x.match_id = cm.match_id AND x.period = cm.period AND x.possession_id = cm.possession_id AND abs(x.event_position - c.event_position) <= 3""",
        *_B,
    ),
)
def rev8(fx):
    t = durable(timeline(fx))
    return V.context_slice(moments(fx, t), t, KEY, 3).select("match_id", "candidate_event_index", "event_index", "context_offset")


@query(
    "rev9_panel_selection",
    sql(
        f"""{MOM}, b AS (SELECT {K}, event_index, possession_id % 4 AS grp, ROW_NUMBER() OVER (PARTITION BY {K} ORDER BY NOT (tl.event_type = 'Shot'), -COALESCE(retreat_from_peak, -1e9), event_index) AS rn
  FROM cm JOIN tl USING ({K}, event_index)), o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY grp ORDER BY {K}) AS within_group FROM b WHERE rn = 1)
 SELECT match_id, possession_id, event_index, within_group FROM o ORDER BY within_group, grp, {K} LIMIT 15""",
        *_B,
    ),
)
def rev9(fx):
    t = durable(timeline(fx))
    c = moments(fx, t).join(t, [*KEY, "event_index"]).withColumn("grp", F.col("possession_id") % 4)
    best = [F.col("event_type") != "Shot", -F.coalesce("retreat_from_peak", F.lit(-1e9))]
    return V.panel_selection(c, KEY, "grp", best, 15).select("match_id", "possession_id", "event_index", "within_group")


@query(
    "rev10_snapshot_points",
    sql(
        f"""{CHO}, {SEM}, z AS (SELECT sm.event_id, sm.event_team_id, i, x, y, teammate FROM sm JOIN pt ON pt.frame_id = sm.event_id % (SELECT COUNT(*) FROM embeddings) WHERE semantics_status = 'validated' AND (sm.match_id, sm.period, sm.possession_id, sm.possession_team_id) IN (SELECT ({K}) FROM ch))
 SELECT event_id, i, CASE WHEN event_team_id = {OWN} THEN 'identity_explicit' ELSE 'rotated_180' END AS orientation_status, CASE WHEN event_team_id = {OWN} THEN x ELSE 120 - x END AS x_attacking,
  CASE WHEN event_team_id = {OWN} THEN y ELSE 80 - y END AS y_attacking, CASE WHEN teammate = (event_team_id = {OWN}) THEN 'own' ELSE 'opponent' END AS side FROM z""",
        *_BF, RPT, TALLY, EF,
    ),
)
def rev10(fx):
    cases_ = F.broadcast(chosen(durable(flags(fx))).select(*KEY))  # CASES rows
    # the cases' events, CASES * POSSESSION rows at most, go to the snapshots; the others' points are never joined
    events = F.broadcast(fx.ev.join(cases_, list(KEY), "left_semi"))
    picked = semantic(fx, events).where("semantics_status = 'validated'")
    return V.snapshot_points(picked, OWN, ["event_id"]).select("event_id", "i", "orientation_status", "x_attacking", "y_attacking", "side")


@query(
    "rev11_manifest_rollup",
    sql(
        f"""SELECT {K}, COUNT(*) FILTER (event_type = 'Shot') AS shot_count, COUNT(*) FILTER (is_out) AS out_event_count, COALESCE(string_agg(DISTINCT pass_type, ';' ORDER BY pass_type), '') AS restart_context
 FROM rich WHERE possession_team_id = {OWN} GROUP BY {K}""",
        *_B,
    ),
)
def rev11(fx):
    return V.manifest_rollup(stream(fx), KEY)


@query(
    "rev11_category_coverage",
    sql(
        f"""{CHO}, s AS (SELECT * FROM ch) {" UNION ALL ".join(f"SELECT '{c}' AS category, (SELECT COUNT(*) FROM fg WHERE {c}) AS pool_count, (SELECT COUNT(*) FROM s WHERE {c}) AS selected_count" for c in _CATS)}""",
        *_BF,
    ),
)
def rev11b(fx):
    pool = durable(flags(fx))
    return V.category_coverage(pool, chosen(pool), _CATS, KEY).drop("case_ids")


# --- episodes and replay -------------------------------------------------------------------

CASE = "concat_ws('-', match_id, period, possession_id)"


def case_lane(fx, *keys):
    return fx.lane(*keys)


def cases(fx):
    s = state_stream(fx).withColumn("case_id", F.expr(CASE))
    return number(s, fx.lane("case_id"), "event_position", start=0)


def ledger(fx):
    s = cases(fx)
    first = s.groupBy("case_id").agg(F.min("event_index").alias("f"))
    return s.join(first, "case_id").where("k % 13 IN (5, 6, 7) AND event_index > f + 1").selectExpr(
        "case_id",
        "concat('B', event_id) AS boundary_id",
        "CASE k % 13 WHEN 5 THEN 'TERMINAL' WHEN 6 THEN 'CLEAR_RESET' ELSE 'OPPONENT_CONTROL' END AS boundary_type",
        "CASE WHEN k % 13 = 6 AND k % 2 = 0 THEN NULL ELSE event_index END AS onset",
        "CASE WHEN k % 13 = 6 AND k % 2 = 0 THEN event_index - 1 END AS onset_lower",
        "CASE k % 13 WHEN 6 THEN event_index WHEN 7 THEN event_index + 2 END AS resume",
        "CASE WHEN k % 13 = 6 AND k % 2 = 0 THEN 'unresolved_onset' ELSE 'exact' END AS precision",
    )


def episodes(fx):
    parents = cases(fx).groupBy("case_id").agg(F.min("event_index").alias("first_event"), F.max("event_index").alias("last_event"))
    return P.episode_map(parents, ledger(fx), fx.lane("case_id", at="cut").block)


EPI = f"""cs AS (SELECT *, match_id || '-' || period || '-' || possession_id AS case_id, ROW_NUMBER() OVER {W} - 1 AS event_position FROM rich WHERE possession_team_id = {OWN}),
 pa AS (SELECT case_id, MIN(event_index) AS f, MAX(event_index) AS l FROM cs GROUP BY case_id),
 lg AS (SELECT case_id, -1::BIGINT AS cut, '' AS bid, f AS start, 'PARENT_START' AS start_reason, '' AS kind, TRUE AS ok FROM pa
  UNION ALL SELECT case_id, CASE WHEN k % 13 = 6 AND k % 2 = 0 THEN event_index - 1 ELSE event_index END, 'B' || event_id, CASE k % 13 WHEN 6 THEN event_index WHEN 7 THEN event_index + 2 END,
   CASE WHEN k % 13 = 6 THEN 'CLEAR_RESET' ELSE 'HARD_BOUNDARY_REGAIN' END, CASE k % 13 WHEN 5 THEN 'TERMINAL' WHEN 6 THEN 'CLEAR_RESET' ELSE 'OPPONENT_CONTROL' END, NOT (k % 13 = 6 AND k % 2 = 0)
   FROM cs JOIN pa USING (case_id) WHERE k % 13 IN (5, 6, 7) AND event_index > f + 1),
 ln AS (SELECT lg.*, l, LEAD(cut) OVER w AS nc, LEAD(kind) OVER w AS nk, LEAD(bid) OVER w AS nb FROM lg JOIN pa USING (case_id) WINDOW w AS (PARTITION BY case_id ORDER BY cut, bid)),
 ep AS (SELECT case_id, start AS episode_start, COALESCE(nc - 1, l) AS episode_end, start_reason, COALESCE(nk, 'PARENT_OBSERVATION_END') AS end_reason, bid AS start_boundary_id, COALESCE(nb, '') AS end_boundary_id, ok AS state_valid,
   case_id || '_E' || lpad((ROW_NUMBER() OVER (PARTITION BY case_id ORDER BY cut, bid))::VARCHAR, 2, '0') AS episode_id FROM ln WHERE start IS NOT NULL AND COALESCE(nc - 1, l) >= start),
 em AS (SELECT cs.*, e.episode_id, e.episode_start, e.state_valid, CASE WHEN e.episode_id IS NULL THEN 'boundary_or_unresolved_context' WHEN e.state_valid THEN 'reviewed_episode_context' ELSE 'provisional_episode_context' END AS membership_status
  FROM cs LEFT JOIN ep e ON e.case_id = cs.case_id AND cs.event_index BETWEEN e.episode_start AND e.episode_end)"""


@query("epi1_episode_map", sql(f"{EPI} SELECT * FROM ep", *_B))
def epi1(fx):
    return episodes(fx)


def members(fx):
    return P.assign_membership(cases(fx), episodes(fx), case_lane(fx, "case_id"))


@query(
    "epi2_assign_membership",
    sql(f"{EPI} SELECT event_id, episode_id, membership_status, CASE WHEN episode_id IS NOT NULL THEN (t_us - MIN(t_us) OVER (PARTITION BY case_id, episode_id)) / 1e6 END AS episode_elapsed_seconds FROM em", *_B),
)
def epi2(fx):
    return members(fx).select("event_id", "episode_id", "membership_status", "episode_elapsed_seconds")


#: candidate moments with the columns of their events
CND = f"{MOM}, {EPI}, cd AS (SELECT * FROM cs WHERE (match_id, event_index) IN (SELECT (match_id, event_index) FROM cm))"


def candidates(fx):
    found = moments(fx, durable(timeline(fx))).select("match_id", "event_index")
    return cases(fx).join(found, ["match_id", "event_index"], "left_semi")


def measures(fx, m=None):
    return P.episode_progression(members(fx) if m is None else m, case_lane(fx, "case_id", "episode_id"))


EPM = f"""{EPI}, r0 AS (SELECT *, event_type = 'Pass' AND pass_outcome IS NOT NULL AS failed, pass_type IS NOT NULL AS restart, CASE WHEN pass_type IS NOT NULL THEN end_x ELSE GREATEST(start_x, end_x) END AS v
   FROM em WHERE episode_id IS NOT NULL),
 r1 AS (SELECT *, MAX(v) OVER (PARTITION BY episode_id ORDER BY event_index) AS peak FROM r0 WHERE event_team_id = {OWN} AND event_type IN ('Pass', 'Carry') AND validated_anchor AND end_x IS NOT NULL AND NOT failed),
 r2 AS (SELECT a.*, GREATEST(0, peak - end_x) AS retreat, (SELECT arg_min(b.t_us, b.event_index) FROM r1 b WHERE b.episode_id = a.episode_id AND b.event_index > a.event_index AND b.v >= a.peak) AS nt,
   (SELECT MAX(b.event_index) FROM r0 b WHERE b.episode_id = a.episode_id) AS li, (SELECT MAX(b.v) FROM r1 b WHERE b.episode_id = a.episode_id AND b.event_index > a.event_index) AS top FROM r1 a)"""


@query(
    "epi3_episode_progression",
    sql(
        f"""{EPM} SELECT event_id, peak, retreat, top > peak AS new_peak_afterward, CASE WHEN retreat = 0 THEN 'not_applicable_at_peak' WHEN nt IS NOT NULL THEN 'observed_equal_or_higher_peak' ELSE 'censored_at_episode_observation_end' END AS recovery_status,
 CASE WHEN retreat > 0 THEN (nt - t_us) / 1e6 END AS seconds_to_recovery, CASE WHEN retreat > 0 AND nt IS NULL THEN li END AS censor_event FROM r2""",
        *_B,
    ),
)
def epi3(fx):
    return measures(fx).select("event_id", "peak", "retreat", "new_peak_afterward", "recovery_status", "seconds_to_recovery", "censor_event")


@query(
    "epi4_role_assignment",
    sql(
        f"""{CND} SELECT event_id, CASE WHEN e.start_reason IS NULL THEN 'continuation_context' WHEN e.start_reason = 'CLEAR_RESET' THEN 'reset_warning' ELSE 'ordinary_context' END AS candidate_role
 FROM cd LEFT JOIN ep e ON e.case_id = cd.case_id AND cd.event_index BETWEEN e.episode_start AND e.episode_end""",
        *_B,
    ),
)
def epi4(fx):
    iv = episodes(fx).selectExpr(
        "case_id", "episode_start AS lo", "episode_end AS hi", "CASE WHEN start_reason = 'CLEAR_RESET' THEN 'reset_warning' ELSE 'ordinary_context' END AS role"
    )
    return P.role_assignment(candidates(fx).select("case_id", "event_id", "event_index"), iv, case_lane(fx, "case_id")).select("event_id", "candidate_role")


@query(
    "epi5_compare_diagnostics",
    sql(
        f"""{EPM}, o AS (SELECT *, MAX(v) OVER (PARTITION BY case_id ORDER BY event_index) AS op FROM (SELECT *, CASE WHEN pass_type IS NOT NULL THEN end_x ELSE GREATEST(start_x, end_x) END AS v FROM cs
   WHERE event_team_id = {OWN} AND event_type IN ('Pass', 'Carry') AND validated_anchor AND end_x IS NOT NULL AND NOT (event_type = 'Pass' AND pass_outcome IS NOT NULL))),
 j AS (SELECT o.op AS a, r2.peak AS b, GREATEST(0, o.op - o.end_x) AS c, r2.retreat AS d FROM o FULL JOIN r2 ON o.event_id = r2.event_id),
 u AS (SELECT 'peak' AS metric, a, b FROM j UNION ALL SELECT 'retreat', c, d FROM j)
 SELECT metric, CASE WHEN a IS NULL OR b IS NULL THEN 'availability_changed' WHEN ABS(a - b) <= 1e-9 THEN 'unchanged' ELSE 'value_changed' END AS comparison, COUNT(*) AS n FROM u GROUP BY ALL""",
        *_B,
    ),
)
def epi5(fx):
    old = R.measurement_state(cases(fx), fx.lane("case_id")).select("event_id", "peak", "retreat")
    new = measures(fx).select("event_id", "peak", "retreat")
    c = P.compare_diagnostics(old, new, ["event_id"], ["peak", "retreat"])
    return c.groupBy("metric", "comparison").agg(F.count(F.lit(1)).alias("n"))


@query(
    "epi6_episode_summary",
    sql(
        f"""{EPM}, a AS (SELECT case_id, episode_id, COUNT(*) AS event_count FROM em WHERE episode_id IS NOT NULL GROUP BY ALL), b AS (SELECT episode_id, COUNT(*) AS trusted_actions, MAX(retreat) AS maximum_retreat,
  COUNT(*) FILTER (retreat > 0 AND nt IS NOT NULL) AS recovered_rows, COUNT(*) FILTER (retreat > 0 AND nt IS NULL) AS censored_rows FROM r2 GROUP BY ALL)
 SELECT a.*, COALESCE(trusted_actions, 0) AS trusted_actions, maximum_retreat, COALESCE(recovered_rows, 0) AS recovered_rows, COALESCE(censored_rows, 0) AS censored_rows FROM a LEFT JOIN b USING (episode_id)""",
        *_B,
    ),
)
def epi6(fx):
    m = durable(members(fx))
    return P.episode_summary(m, measures(fx, m))


def masks(fx):
    return ledger(fx).where("boundary_type = 'CLEAR_RESET' AND onset IS NULL").selectExpr("case_id", "onset_lower AS lo", "resume AS hi")


def replayed(fx, versions):
    hard = ledger(fx).where(F.col("boundary_type").isin(*P.HARD))
    lane = case_lane(fx, "case_id", "part")
    s = P.in_masks(P.cut_at_hard(cases(fx), hard, lane), masks(fx), lane, "event_index", "event_index")
    return P.drawdown_detector(s, lane, versions, slow=5 * 3600.0)


@query("rpl1_drawdown_detector")
def rpl1(fx):
    return replayed(fx, P.VERSIONS)


# --- labels --------------------------------------------------------------------------------

METRICS = ["l_quantity", "l_extendedprice", "tax"]


def cohort(fx):
    return fx.table("lineitem").selectExpr(
        "l_returnflag AS label", "l_quantity", "l_extendedprice", "CASE WHEN l_linenumber % 5 <> 0 THEN l_tax END AS tax",
        "CASE WHEN l_linestatus = 'O' THEN 'LOCKED' ELSE 'OPEN' END AS lock_status",
        "CASE l_linenumber % 7 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS threshold_safe",
        "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_partkey % 13 = 0 END AS peak_contaminated",
        "CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_suppkey % 3 = 1 END AS observed_recovery",
        "CASE WHEN l_quantity > 25 THEN l_quantity - 25 ELSE 0 END AS retreat",
    )


COH = """co AS (SELECT l_returnflag AS label, l_quantity, l_extendedprice, CASE WHEN l_linenumber % 5 <> 0 THEN l_tax END AS tax, CASE WHEN l_linestatus = 'O' THEN 'LOCKED' ELSE 'OPEN' END AS lock_status,
 CASE l_linenumber % 7 WHEN 0 THEN NULL WHEN 1 THEN FALSE ELSE TRUE END AS threshold_safe, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_partkey % 13 = 0 END AS peak_contaminated,
 CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_suppkey % 3 = 1 END AS observed_recovery, CASE WHEN l_quantity > 25 THEN l_quantity - 25 ELSE 0 END AS retreat FROM lineitem)"""
_REC = "CASE WHEN observed_recovery THEN 'observed' WHEN NOT observed_recovery THEN 'not_observed_censored' WHEN retreat = 0 THEN 'not_applicable_at_peak' ELSE 'unavailable' END"


@query(
    "lbl1_cohort_prepare",
    sql(
        f"""p AS (SELECT label, concat_ws(';', CASE WHEN NOT COALESCE(threshold_safe, FALSE) THEN 'threshold_safe_not_true' END, CASE WHEN label NOT IN ('A', 'R') THEN 'not_a_review_label' END,
  CASE WHEN lock_status <> 'LOCKED' THEN 'not_locked' END, CASE WHEN COALESCE(peak_contaminated, TRUE) THEN 'contaminated_or_unknown_peak' END) AS exclusion_reasons, {_REC} AS recovery_status FROM co)
 SELECT label, exclusion_reasons, recovery_status, exclusion_reasons = '' AS primary_included, COUNT(*) AS n FROM p GROUP BY ALL""",
        COH,
    ),
)
def lbl1(fx):
    p = B.cohort_prepare(cohort(fx), ["A", "R"]).withColumn("exclusion_reasons", F.array_join("exclusion_reasons", ";"))
    return p.groupBy("label", "exclusion_reasons", "recovery_status", "primary_included").agg(F.count(F.lit(1)).alias("n"))


_L = " UNION ALL ".join(f"SELECT label, '{m}' AS metric, {m} AS v FROM co" for m in METRICS)


@query(
    "lbl2_class_descriptives",
    sql(
        f"""u AS ({_L}) SELECT label, metric, COUNT(*) AS total_count, COUNT(v) AS count, ROUND(AVG(v), 4) AS mean, ROUND(STDDEV_SAMP(v), 4) AS std, ROUND(MIN(v), 4) AS min, ROUND(MAX(v), 4) AS max,
 {", ".join(f"ROUND(QUANTILE_CONT(v, {q}), 4) AS {n}" for n, q in (("p10", .1), ("p25", .25), ("p50", .5), ("p75", .75), ("p90", .9)))} FROM u GROUP BY ALL""",
        COH,
    ),
)
def lbl2(fx):
    return rd(B.class_descriptives(cohort(fx), METRICS, fx.small_lines(3)), 4)


_BQ = ", ".join(f"QUANTILE_CONT(v, {lo}) AS {b}_lo, QUANTILE_CONT(v, {hi}) AS {b}_hi" for b, (lo, hi) in B.BANDS.items())


@query(
    "lbl2_class_overlap",
    sql(
        f"""u AS ({_L}), q AS (SELECT label, metric, {_BQ} FROM u GROUP BY ALL), z AS ({" UNION ALL ".join(f"SELECT label, metric, '{b}' AS interval, {b}_lo AS lo, {b}_hi AS hi FROM q" for b in B.BANDS)})
 SELECT a.metric, a.interval, a.label AS class_a, b.label AS class_b, GREATEST(a.lo, b.lo) <= LEAST(a.hi, b.hi) AS overlaps, CASE WHEN GREATEST(a.lo, b.lo) <= LEAST(a.hi, b.hi) THEN ROUND(GREATEST(a.lo, b.lo), 4) END AS overlap_low,
  CASE WHEN GREATEST(a.lo, b.lo) <= LEAST(a.hi, b.hi) THEN ROUND(LEAST(a.hi, b.hi), 4) END AS overlap_high, ROUND(GREATEST(0, LEAST(a.hi, b.hi) - GREATEST(a.lo, b.lo)), 4) AS overlap_width
 FROM z a JOIN z b ON a.metric = b.metric AND a.interval = b.interval AND a.label < b.label""",
        COH,
    ),
)
def lbl2b(fx):
    return rd(B.class_overlap(cohort(fx), METRICS, fx.small_lines(3)), 4)


SWEEP = {
    "quantity>=30": [("l_quantity", ">=", 30)],
    "tax>=0.05": [("tax", ">=", 0.05)],
    "quantity>=30&tax>=0.05": [("l_quantity", ">=", 30), ("tax", ">=", 0.05)],
    "price<=20000": [("l_extendedprice", "<=", 20000)],
}


@query(
    "lbl3_threshold_sweep",
    sql(
        " UNION ALL ".join(
            f"SELECT label, '{n}' AS diagnostic, COUNT(*) AS total, COUNT(*) FILTER ({' AND '.join(f'{m} IS NOT NULL' for m, _, _ in c)}) AS evaluable, "
            f"COUNT(*) FILTER ({' AND '.join(f'{m} {o} {v}' for m, o, v in c)}) AS matched, COUNT(*) FILTER ({' AND '.join(f'{m} IS NOT NULL' for m, _, _ in c)}) - COUNT(*) FILTER ({' AND '.join(f'{m} {o} {v}' for m, o, v in c)}) AS not_matched, "
            f"COUNT(*) - COUNT(*) FILTER ({' AND '.join(f'{m} IS NOT NULL' for m, _, _ in c)}) AS missing FROM co GROUP BY label"
            for n, c in SWEEP.items()
        ),
        COH,
    ),
)
def lbl3(fx):
    return B.threshold_sweep(cohort(fx), SWEEP)


_PAIRS = [(a, b) for i, a in enumerate(METRICS) for b in METRICS[i + 1 :]]


@query(
    "lbl4_rank_correlations",
    sql(
        f"""p AS ({" UNION ALL ".join(f"SELECT label, '{a}' AS metric_a, '{b}' AS metric_b, {a} AS x, {b} AS y FROM co WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in _PAIRS)}),
 r AS (SELECT *, RANK() OVER (PARTITION BY label, metric_a, metric_b ORDER BY x) + (COUNT(*) OVER (PARTITION BY label, metric_a, metric_b, x) - 1) / 2.0 AS rx,
  RANK() OVER (PARTITION BY label, metric_a, metric_b ORDER BY y) + (COUNT(*) OVER (PARTITION BY label, metric_a, metric_b, y) - 1) / 2.0 AS ry FROM p)
 SELECT label, metric_a, metric_b, COUNT(*) AS n, ROUND(CORR(rx, ry), 6) AS rho FROM r GROUP BY ALL""",
        COH,
    ),
)
def lbl4(fx):
    return rd(B.rank_correlations(cohort(fx), METRICS, fx.small_lines(3)))


@query(
    "lbl5_recovery_table",
    sql(f"p AS (SELECT label, {_REC} AS recovery_status, l_extendedprice AS v FROM co) SELECT label, recovery_status, COUNT(*) AS n, ROUND(MEDIAN(v), 4) AS median_value FROM p GROUP BY ALL", COH),
)
def lbl5(fx):
    return rd(B.recovery_table(B.cohort_prepare(cohort(fx), ["A", "R"]), "l_extendedprice", fx.small_lines()), 4)


@query(
    "lbl6_warning_groups",
    sql(
        f"""{CND}, c AS (SELECT cd.case_id, event_id, event_index, k % 4 AS wg, CASE WHEN e.start_reason = 'CLEAR_RESET' THEN 'reset_warning' ELSE 'probe' END AS role
  FROM cd LEFT JOIN ep e ON e.case_id = cd.case_id AND cd.event_index BETWEEN e.episode_start AND e.episode_end)
 SELECT case_id, wg, COUNT(*) FILTER (role = 'reset_warning') AS warnings, COUNT(*) FILTER (role <> 'reset_warning') AS probes, arg_min(event_id, event_index) FILTER (role = 'reset_warning') AS first_warning,
  arg_max(event_id, event_index) FILTER (role = 'reset_warning') AS last_warning FROM c GROUP BY ALL""",
        *_B,
    ),
)
def lbl6(fx):
    iv = episodes(fx).selectExpr("case_id", "episode_start AS lo", "episode_end AS hi", "CASE WHEN start_reason = 'CLEAR_RESET' THEN 'reset_warning' ELSE 'ordinary_context' END AS role")
    c = candidates(fx).selectExpr("case_id", "event_id AS candidate_id", "event_index", "k % 4 AS wg")
    roles = P.role_assignment(c, iv, case_lane(fx, "case_id")).withColumnRenamed("candidate_role", "role")
    return B.warning_groups(roles, ["case_id", "wg"])


# --- season description and tables ---------------------------------------------------------


@query(
    "eda1_pass_completion",
    sql("SELECT event_team_id, COUNT(*) AS passes, ROUND(100.0 * AVG((pass_outcome IS NULL)::INT), 6) AS completion_pct FROM ev WHERE event_type = 'Pass' GROUP BY ALL", EV),
)
def eda1(fx):
    return rd(B.pass_completion(fx.ev, ["event_team_id"]))


@query(
    "eda2_top_passers",
    sql("SELECT k, COUNT(*) AS passes, ROUND(100.0 * AVG((pass_outcome IS NULL)::INT), 6) AS completion_pct FROM ev WHERE event_type = 'Pass' GROUP BY ALL ORDER BY passes DESC, k LIMIT 10", EV),
)
def eda2(fx):
    return rd(B.top_passers(fx.ev, "k", 10))


@query(
    "eda3_match_results",
    sql(
        f"""g AS (SELECT match_id, COUNT(*) AS events, COUNT(*) FILTER (event_type = 'Shot' AND k % 9 = 0 AND event_team_id = {OWN}) AS goals_for,
  COUNT(*) FILTER (event_type = 'Shot' AND k % 9 = 0 AND event_team_id <> {OWN}) AS goals_against FROM ev GROUP BY ALL)
 SELECT *, CASE WHEN goals_for > goals_against THEN 'W' WHEN goals_for < goals_against THEN 'L' ELSE 'D' END AS result FROM g""",
        EV,
    ),
)
def eda3(fx):
    return B.match_results(fx.ev.withColumn("is_goal", F.expr("event_type = 'Shot' AND k % 9 = 0")), OWN)


#: lineups of both teams but for one match, snapshots of all matches but two
SEASON = f"""ms AS (SELECT DISTINCT match_id FROM ev), lu AS (SELECT match_id, CASE t WHEN 0 THEN {OWN} ELSE match_id + 1 END AS team_id FROM ms, (VALUES (0), (1)) v(t) WHERE NOT (match_id = 7 AND t = 1)),
 fr AS (SELECT match_id FROM ev WHERE linked AND match_id NOT IN (3, 8)),
 sn AS (SELECT match_id, (SELECT COUNT(*) FROM ev e WHERE e.match_id = ms.match_id) AS event_count, (SELECT COUNT(DISTINCT team_id) FROM lu l WHERE l.match_id = ms.match_id) AS lineup_team_count,
   (SELECT COUNT(*) FROM fr f WHERE f.match_id = ms.match_id) AS frame_count FROM ms)"""


def season(fx):
    ms = fx.ev.select("match_id").distinct()
    teams = ms.select("match_id", F.explode(F.array(F.lit(OWN), F.col("match_id") + 1)).alias("team_id")).where(~((F.col("match_id") == 7) & (F.col("team_id") == 8)))
    return B.season_inventory(ms, fx.ev, teams, fx.ev.where("linked AND match_id NOT IN (3, 8)"))


@query("eda3_season_inventory", sql(f"{SEASON} SELECT * FROM sn", EV))
def eda3b(fx):
    return season(fx)


_SN = ("event_count", "lineup_team_count", "frame_count")


@query(
    "eda3_season_profile",
    sql(
        f"""{SEASON}, l AS ({" UNION ALL ".join(f"SELECT '{n}' AS measure, {n}::DOUBLE AS v FROM sn" for n in _SN)})
 SELECT measure, COUNT(v) AS count, ROUND(AVG(v), 6) AS mean, ROUND(STDDEV_SAMP(v), 6) AS std, MIN(v) AS min, MAX(v) AS max, SUM(v) AS total, COUNT(*) FILTER (v = 0) AS zeros,
  ROUND(QUANTILE_CONT(v, 0.25), 6) AS p25, ROUND(MEDIAN(v), 6) AS median, ROUND(QUANTILE_CONT(v, 0.75), 6) AS p75 FROM l GROUP BY measure""",
        EV,
    ),
)
def eda3c(fx):
    return rd(B.season_profile(season(fx), fx.small))


@query("src2_read_table", sql("SELECT event_id, user_id FROM events", "one AS (SELECT 1)"))
def src2(fx):
    return readers.read_table(fx.spark, f"{fx.dir}/events.parquet", ["event_id", "user_id"])


@query("snk2_verify_rerun", sql("SELECT 0 AS only_first, 0 AS only_second", "one AS (SELECT 1)"))
def snk2(fx):
    a = fx.own.select("event_id", "event_index", "event_type", "t_us")
    return readers.verify_rerun(a, a.repartition(7, "event_id"))


@query(
    "snk2_verify_changed",
    sql(
        """a AS (SELECT event_id, event_index, event_type, t_us FROM own), b0 AS (SELECT event_id, event_index, CASE WHEN event_id % 211 = 3 THEN 'changed' ELSE event_type END AS event_type, t_us FROM a WHERE event_id % 223 <> 4),
 b AS (SELECT * FROM b0 UNION ALL SELECT * FROM b0 WHERE event_id % 227 = 5)
 SELECT (SELECT COUNT(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_first, (SELECT COUNT(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_second""",
        EV,
        OWN_EV,
    ),
)
def snk2c(fx):
    """A copy with changed, lost and repeated rows."""
    a = fx.own.select("event_id", "event_index", "event_type", "t_us")
    b = a.where("event_id % 223 <> 4").withColumn("event_type", F.expr("CASE WHEN event_id % 211 = 3 THEN 'changed' ELSE event_type END"))
    return readers.verify_rerun(a, b.unionByName(b.where("event_id % 227 = 5")))


@query("snk2_table_fingerprint")
def snk2b(fx):
    return readers.table_fingerprint(fx.ev)
