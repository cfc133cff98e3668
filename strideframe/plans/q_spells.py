"""Control-spell segmentation queries; the SQL replays ownership one event at a time."""

from pyspark.sql import functions as F

from strideframe.operators import events as E
from strideframe.operators import spells as C
from strideframe.operators.ordered import lane_for
from strideframe.plans.fixtures import EV, KEY, OWN, RICH, sql
from strideframe.plans.registry import query

K = ", ".join(KEY)
P3 = ("match_id", "period", "possession_id")
ON = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in P3)

E0 = f"""e0 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {K} ORDER BY event_index) AS rn,
   CASE WHEN pass_type IN ('Corner', 'Throw-in') THEN pass_type END AS restart_type,
   CASE WHEN is_out OR pass_outcome = 'Out' THEN 'BALL_OUT' WHEN event_type = 'Offside' THEN 'STOPPAGE'
    WHEN event_type = 'Foul Won' AND NOT advantage THEN 'FOUL_STOPPAGE' END AS dead,
   CASE event_type WHEN 'Ball Recovery' THEN NOT recovery_failure WHEN 'Interception' THEN interception_outcome = 'Won'
    WHEN 'Pass' THEN pass_outcome IS NULL WHEN 'Carry' THEN TRUE WHEN 'Ball Receipt*' THEN receipt_outcome IS NULL
    WHEN 'Dribble' THEN dribble_outcome = 'Complete' WHEN 'Goal Keeper' THEN keeper_type = 'Collected' ELSE FALSE END AS cue,
   event_type = 'Pass' AND pass_outcome IS NULL AS distribution FROM sg WHERE possession_team_id = {OWN})"""
FOLD = f"""fold AS (
  SELECT DISTINCT {K}, 0::BIGINT AS rn, {OWN} AS owner, NULL::INT AS pteam, NULL::BIGINT AS pend, 0 AS n, FALSE AS act,
   NULL::BIGINT AS c_on, NULL::BIGINT AS c_cf, NULL::INT AS c_tm, NULL::BIGINT AS unc FROM e0
  UNION ALL
  SELECT f.match_id, f.period, f.possession_id, f.possession_team_id, e.rn,
   CASE WHEN rs THEN {OWN} WHEN NOT e.cue OR e.event_team_id = f.owner THEN f.owner WHEN fire THEN e.event_team_id ELSE f.owner END,
   CASE WHEN rs THEN NULL WHEN NOT e.cue THEN f.pteam WHEN e.event_team_id = f.owner OR fire THEN NULL ELSE e.event_team_id END,
   CASE WHEN rs THEN NULL WHEN NOT e.cue THEN f.pend WHEN e.event_team_id = f.owner OR fire THEN NULL ELSE np END,
   CASE WHEN rs THEN 0 WHEN NOT e.cue THEN f.n WHEN e.event_team_id = f.owner OR fire THEN 0 ELSE nn END,
   CASE WHEN rs THEN FALSE WHEN NOT e.cue THEN f.act WHEN e.event_team_id = f.owner OR fire THEN FALSE ELSE na END,
   CASE WHEN NOT rs AND e.cue AND e.event_team_id <> f.owner AND fire THEN np END,
   CASE WHEN NOT rs AND e.cue AND e.event_team_id <> f.owner AND fire THEN e.event_index END,
   CASE WHEN NOT rs AND e.cue AND e.event_team_id <> f.owner AND fire THEN e.event_team_id END,
   CASE WHEN NOT rs AND e.cue AND e.event_team_id = f.owner AND f.pteam IS NOT NULL THEN f.pend END
  FROM fold f JOIN e0 e ON {ON('e', 'f')} AND e.rn = f.rn + 1,
   LATERAL (SELECT e.dead IS NOT NULL OR e.restart_type IS NOT NULL AS rs, f.pteam IS NOT DISTINCT FROM e.event_team_id AS sm) s,
   LATERAL (SELECT CASE WHEN sm THEN f.pend ELSE e.event_index END AS np, CASE WHEN sm THEN f.n + 1 ELSE 1 END AS nn,
     (sm AND f.act) OR e.event_type IN ('Carry', 'Pass', 'Dribble') AS na) t,
   LATERAL (SELECT e.distribution OR (nn >= 2 AND na) AS fire) u),
 chg AS (SELECT match_id, period, possession_id, c_on AS onset, c_cf AS confirmation, c_tm AS team FROM fold WHERE c_on IS NOT NULL),
 unc AS (SELECT match_id, period, possession_id, unc AS onset FROM fold WHERE unc IS NOT NULL
  UNION ALL SELECT match_id, period, possession_id, pend FROM (SELECT *, MAX(rn) OVER (PARTITION BY match_id, period, possession_id) AS mx FROM fold)
   WHERE rn = mx AND pteam IS NOT NULL)"""
SEG = f"""{E0}, {FOLD},
 s0 AS (SELECT e.*, c.confirmation, c.team AS change_team FROM e0 e LEFT JOIN chg c ON {ON('e', 'c')} AND e.event_index = c.onset),
 s1 AS (SELECT a.*, event_type = 'Shot' AND event_team_id = {OWN} AND NOT EXISTS (
   SELECT 1 FROM s0 b WHERE {ON('a', 'b')} AND b.event_index > a.event_index AND b.event_team_id = {OWN} AND b.event_type IN ('Pass', 'Carry', 'Shot', 'Dribble')
    AND b.dead IS NULL AND COALESCE(b.change_team = {OWN}, TRUE) AND NOT EXISTS (SELECT 1 FROM s0 d WHERE {ON('d', 'b')} AND d.event_index > a.event_index
     AND d.event_index < b.event_index AND (d.dead IS NOT NULL OR d.change_team <> {OWN}))) AS terminal_shot FROM s0 a),
 s2 AS (SELECT *, BOOL_OR(event_team_id = {OWN} AND event_type IN ('Pass', 'Carry', 'Shot', 'Dribble')) OVER p AS attacks,
   BOOL_AND(event_type = 'Substitution') OVER p AS alladmin, MIN(event_index) FILTER (event_type <> 'Substitution') OVER p AS first_i,
   CASE WHEN terminal_shot THEN 'TERMINAL_SHOT' ELSE dead END AS closing FROM s1 WINDOW p AS (PARTITION BY {K})),
 s3 AS (SELECT *, closing IS NULL AND restart_type IS NOT NULL AND event_team_id = {OWN} AS rst,
   COUNT(*) FILTER (closing IS NOT NULL) OVER (PARTITION BY {K} ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS db FROM s2),
 s4 AS (SELECT *, COALESCE(closing IS NULL AND NOT rst AND change_team <> {OWN}, FALSE) AS lost, COALESCE(closing IS NULL AND NOT rst AND change_team = {OWN}, FALSE) AS regain FROM s3),
 s5 AS (SELECT *, CASE WHEN closing IS NOT NULL OR lost THEN 0 WHEN rst OR regain OR (event_index = first_i AND db = 0) THEN 1 END AS flag FROM s4),
 s6 AS (SELECT *, LAST_VALUE(flag IGNORE NULLS) OVER (PARTITION BY {K} ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cur,
   LAST_VALUE(flag IGNORE NULLS) OVER (PARTITION BY {K} ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM s5),
 s7 AS (SELECT *, attacks AND COALESCE(cur, 0) = 1 AS live, COUNT(*) FILTER (attacks AND COALESCE(cur, 0) = 1 AND (rst OR COALESCE(was, 0) <> 1)) OVER (PARTITION BY {K} ORDER BY event_index) AS no FROM s6),
 s8 AS (SELECT *, CASE WHEN live THEN no END AS spell_number,
   CASE WHEN closing IS NOT NULL AND attacks AND COALESCE(was, 1) = 1 THEN closing WHEN attacks AND rst AND was = 1 THEN 'RESTART'
    WHEN lost AND attacks AND COALESCE(was, 1) = 1 THEN 'OPPONENT_CONTROL' END AS boundary_reason FROM s7),
 seg AS (SELECT *, CASE WHEN live THEN match_id || '-p' || period || '-pp' || possession_id || '-s' || no END AS spell_id,
   CASE WHEN live THEN ROW_NUMBER() OVER (PARTITION BY {K}, spell_number ORDER BY event_index) END AS spell_event_order,
   live AND COALESCE(LAG(spell_number) OVER w, -1) <> no AS boundary_before, live AND COALESCE(LEAD(spell_number) OVER w, -1) <> no AS boundary_after,
   CASE WHEN NOT attacks THEN CASE WHEN alladmin THEN 'administrative_no_spell' ELSE 'insufficient_context_no_spell' END
    WHEN closing IS NOT NULL THEN 'dead_or_terminal_context' WHEN live THEN 'control_spell_context' ELSE 'outside_control' END AS membership_status,
   LEAD(boundary_reason) OVER w AS nr FROM s8 WINDOW w AS (PARTITION BY {K} ORDER BY event_index)),
 seg2 AS (SELECT *, CASE WHEN boundary_before THEN CASE WHEN rst AND no = 1 THEN 'OPENING_RESTART' WHEN rst THEN 'RESTART' WHEN regain THEN 'OWN_REGAIN' ELSE 'PROVIDER_PARENT_START' END END AS start_reason,
   CASE WHEN boundary_after THEN COALESCE(nr, 'PROVIDER_PARENT_END') END AS end_reason FROM seg)"""
_B = (EV, RICH)


def at_lane(fx):
    """Lane over boundaries by their place in the event stream."""
    return lane_for(fx.n_events, (), ("at",), "CAST(floor(at / 100000) AS BIGINT)")


def stream(fx):
    return E.match_stream_context(fx.rich, OWN)


def members(fx):
    return C.segment(stream(fx), fx.lane(*KEY), OWN)


@query("spl1_dead_reason", sql(f"{E0} SELECT event_id, dead AS dead_reason FROM e0", *_B))
def spl1(fx):
    return stream(fx).select("event_id", C.dead_reason().alias("dead_reason"))


@query("spl2_control_evidence", sql(f"{E0} SELECT event_id, cue, distribution FROM e0", *_B))
def spl2(fx):
    return stream(fx).select("event_id", *[c.alias(n) for n, c in C.control_evidence().items()])


@query(
    "spl3_control_changes",
    sql(
        f"""{E0}, {FOLD} SELECT match_id, period, possession_id, onset, confirmation, team, TRUE AS is_change FROM chg
 UNION ALL SELECT match_id, period, possession_id, onset, NULL, NULL, FALSE FROM unc""",
        *_B,
    ),
)
def spl3(fx):
    out = C.control_changes(stream(fx), fx.lane(*KEY), OWN)
    changed = F.col("is_change")
    return out.select(
        *P3, "onset", F.when(changed, F.col("confirmation")).alias("confirmation"), F.when(changed, F.col("team")).alias("team"), "is_change"
    )


@query("spl4_terminal_shots", sql(f"{SEG} SELECT event_id FROM s1 WHERE terminal_shot", *_B))
def spl4(fx):
    lane = fx.lane(*KEY)
    return C.terminal_shots(C.with_changes(stream(fx), lane, OWN), lane, OWN).where("terminal_shot").select("event_id")


_MEM = [
    "event_id", "spell_number", "spell_id", "spell_event_order", "boundary_before", "boundary_after", "boundary_reason",
    "membership_status",
]


@query(
    "spl5_segment",
    sql(
        f"""{SEG} SELECT {', '.join(_MEM)}, attacks AND EXISTS (SELECT 1 FROM unc WHERE {ON('unc', 'seg2')} AND unc.onset = seg2.event_index)
 AS unconfirmed_control_cue FROM seg2""",
        *_B,
    ),
)
def spl5(fx):
    return members(fx).select(*_MEM, "unconfirmed_control_cue")


@query(
    "spl6_spell_summary",
    sql(
        f"""{SEG} SELECT {K}, spell_number, spell_id, MIN(event_index) AS start_event, MAX(event_index) AS end_event,
 (MAX(t_us) - MIN(t_us)) / 1e6 AS duration_seconds, COUNT(*) AS event_count, COUNT(*) FILTER (event_team_id = {OWN}) AS own_event_count,
 COUNT(*) FILTER (event_team_id <> {OWN}) AS opponent_event_count, MAX(start_reason) AS start_reason, MAX(end_reason) AS end_reason
 FROM seg2 WHERE live GROUP BY {K}, spell_number, spell_id""",
        *_B,
    ),
)
def spl6(fx):
    return C.spell_summary(members(fx), KEY, OWN)


BND = f"""bd AS (SELECT {K}, event_index AS onset_event, CASE WHEN boundary_reason = 'OPPONENT_CONTROL' THEN confirmation ELSE event_index END AS confirmation_event,
  CASE WHEN boundary_reason = 'RESTART' THEN event_index WHEN boundary_reason = 'OPPONENT_CONTROL' THEN (
   SELECT CASE WHEN arg_min(n.start_reason, n.event_index) = 'OWN_REGAIN' THEN MIN(n.event_index) END FROM seg2 n WHERE {ON('n', 'seg2')} AND n.boundary_before AND n.event_index > seg2.event_index) END AS resume_event,
  CASE WHEN boundary_reason IN ('OPPONENT_CONTROL', 'RESTART') THEN boundary_reason ELSE 'TERMINAL' END AS boundary_type, boundary_reason AS reason
  FROM seg2 WHERE boundary_reason IS NOT NULL)"""


@query("spl6_boundary_table", sql(f"{SEG}, {BND} SELECT * FROM bd", *_B))
def spl6b(fx):
    return C.boundary_table(members(fx), fx.lane(*KEY))


@query(
    "spl7_no_spell_status",
    sql(f"{SEG} SELECT membership_status, COUNT(*) AS events, COUNT(DISTINCT ({K})) AS parents FROM seg2 GROUP BY membership_status", *_B),
)
def spl7(fx):
    per = members(fx).groupBy("membership_status", *KEY).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("membership_status").agg(F.sum("n").alias("events"), F.count(F.lit(1)).alias("parents"))


#: One truth after the other takes from the list of free predictions.
MATCHED = """pr AS (SELECT case_id, family, onset, COALESCE(resume, -1) AS resume FROM predicted),
 tr AS (SELECT case_id, family, onset, COALESCE(resume, -1) AS resume FROM truth),
 ids AS (SELECT DISTINCT case_id, family FROM (SELECT case_id, family FROM pr UNION ALL SELECT case_id, family FROM tr)),
 lists AS (SELECT case_id, family,
   COALESCE((SELECT list({'onset': onset, 'resume': resume} ORDER BY onset, resume) FROM tr t WHERE t.case_id = ids.case_id AND t.family = ids.family), []) AS want,
   COALESCE((SELECT list({'onset': onset, 'resume': resume, 'i': i} ORDER BY i) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY case_id, family ORDER BY onset, resume) AS i FROM pr) p
     WHERE p.case_id = ids.case_id AND p.family = ids.family), []) AS have FROM ids),
 picks AS (SELECT case_id, family, 0 AS n, want, have AS free, NULL::BIGINT AS truth_onset, NULL::BIGINT AS truth_resume, NULL::BIGINT AS predicted_onset, NULL::BIGINT AS predicted_resume FROM lists
  UNION ALL SELECT case_id, family, n + 1, want, list_filter(free, lambda p: b.i IS NULL OR p.i <> b.i), want[n + 1].onset, want[n + 1].resume, b.onset, b.resume FROM (
   SELECT *, list_sort(list_transform(free, lambda p: {'gap': abs(p.onset - want[n + 1].onset), 'onset': p.onset, 'resume': p.resume, 'i': p.i}))[1] AS b FROM picks WHERE n < len(want))),
 matched AS (SELECT case_id, family, truth_onset, predicted_onset, CASE WHEN predicted_onset IS NULL THEN 'MISSED' WHEN predicted_onset = truth_onset AND predicted_resume = truth_resume THEN 'MATCH'
   WHEN predicted_onset < truth_onset THEN 'EARLY' ELSE 'LATE' END AS result FROM picks WHERE n > 0
  UNION ALL SELECT case_id, family, NULL, p.onset, 'EXTRA' FROM (SELECT case_id, family, unnest(free) AS p FROM picks WHERE n = len(want)))"""


@query(
    "spl8_boundary_match",
    sql(
        f"""{SEG}, {BND}, predicted AS (SELECT match_id || '-' || period || '-' || possession_id AS case_id, boundary_type AS family, onset_event AS onset, resume_event AS resume FROM bd),
 truth AS (SELECT case_id, family, onset + CASE onset % 5 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS onset, resume FROM predicted WHERE onset % 7 <> 0), {MATCHED} SELECT * FROM matched""",
        *_B,
    ),
)
def spl8(fx):
    """Predicted boundaries against a shifted and thinned copy of themselves."""
    b = C.boundary_table(members(fx), fx.lane(*KEY)).selectExpr(
        "concat_ws('-', match_id, period, possession_id) AS case_id", "boundary_type AS family", "onset_event AS onset", "resume_event AS resume"
    )
    truth = b.where("onset % 7 <> 0").withColumn("onset", F.expr("onset + CASE onset % 5 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END"))
    return C.boundary_match(b, truth, at_lane(fx))
