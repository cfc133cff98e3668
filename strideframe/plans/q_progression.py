"""Progression queries and the event projections they build on."""

from pyspark.sql import functions as F

from strideframe.operators import events as E
from strideframe.operators import progression as R
from strideframe.operators import sequences as S
from strideframe.operators.ordered import number
from strideframe.plans.fixtures import EV, HOUR_US, KEY, MATCHES, OWN, OWN_EV, RICH, sql
from strideframe.plans.q_sequences import POSS
from strideframe.plans.registry import query

K = ", ".join(KEY)
W = f"(PARTITION BY {K} ORDER BY event_index)"

ACT = f"""pos AS (SELECT *, ROW_NUMBER() OVER {W} - 1 AS event_position FROM own),
 act AS (SELECT *, end_x - start_x AS delta_x FROM pos WHERE event_team_id = {OWN} AND event_type IN ('Pass', 'Carry') AND validated_anchor AND end_x IS NOT NULL)"""
PATH = f"""{ACT}, pv AS (SELECT *, 0 AS vertex_no, start_x AS x FROM act UNION ALL SELECT *, 1, end_x FROM act),
 path AS (SELECT *, MAX(x) OVER (PARTITION BY {K} ORDER BY event_index, vertex_no) AS running_peak_x FROM pv)"""
RUNS = f"""rk AS (SELECT *, 'positive' AS run_kind, delta_x > 0 AS p FROM act UNION ALL SELECT *, 'negative', delta_x < 0 FROM act
  UNION ALL SELECT *, 'nonpositive', delta_x <= 0 FROM act),
 rl AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {K}, run_kind ORDER BY event_index)
   - ROW_NUMBER() OVER (PARTITION BY {K}, run_kind, p ORDER BY event_index) AS isl FROM rk),
 runs AS (SELECT {K}, run_kind, MIN(event_index) AS first_event_index, MAX(event_index) AS last_event_index, COUNT(*) AS action_count,
  COUNT(*) FILTER (delta_x < 0) AS negative_action_count, SUM(ABS(delta_x)) AS cumulative_x, MAX(ABS(delta_x)) AS maximum_single,
  (arg_max(t_us, event_index) - arg_min(t_us, event_index)) / 1e6 AS span_seconds, arg_min(start_x, event_index) AS start_x,
  arg_max(end_x, event_index) AS end_x, MAX(event_position) - MIN(event_position) + 1 - COUNT(*) AS intervening_events
  FROM rl WHERE p GROUP BY {K}, run_kind, isl HAVING run_kind <> 'nonpositive' OR COUNT(*) FILTER (delta_x < 0) > 0)"""
#: recovery by correlated search for the next vertex at or above the peak
REC = f"""vx AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {K} ORDER BY event_index, vertex_no) AS rn,
   MAX(x) OVER (PARTITION BY {K} ORDER BY event_index, vertex_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mb FROM path),
 hd AS (SELECT *, mb IS NULL OR x >= mb AS head, COUNT(*) FILTER (mb IS NULL OR x >= mb) OVER (PARTITION BY {K} ORDER BY rn) AS isl FROM vx),
 hx AS (SELECT {K}, rn, isl, x AS hx, event_index AS hi, event_position AS hp, t_us AS ht FROM hd WHERE head),
 bl AS (SELECT {K}, isl, MIN(rn) AS orn, arg_min(event_index, rn) AS oi, MIN(x) AS tx, MAX(rn) AS lrn, arg_max(event_index, rn) AS li,
   arg_max(t_us, rn) AS lt FROM hd WHERE NOT head GROUP BY ALL),
 tr AS (SELECT hd.match_id, hd.period, hd.possession_id, hd.isl, arg_min(event_index, rn) AS ti, arg_min(t_us, rn) AS tt
   FROM hd JOIN bl ON hd.match_id = bl.match_id AND hd.period = bl.period AND hd.possession_id = bl.possession_id AND hd.isl = bl.isl
   WHERE NOT head AND x = tx GROUP BY ALL),
 rec AS (SELECT b.match_id, b.period, b.possession_id, b.possession_team_id, h.hi AS peak_event_index, b.oi AS onset_event_index, t.ti AS trough_event_index,
   COALESCE(n.hi, b.li) AS last_observed_event_index, h.hx AS previous_peak_x, b.tx AS trough_x, h.hx - b.tx AS retreat_size,
   n.hi IS NOT NULL AS recovered, EXISTS (SELECT 1 FROM hx z WHERE z.match_id = b.match_id AND z.period = b.period AND z.possession_id = b.possession_id
     AND z.isl > b.isl AND z.hx > h.hx) AS new_peak_reached,
   (n.ht - h.ht) / 1e6 AS seconds_to_recover, n.hp - h.hp AS events_to_recover, (COALESCE(n.ht, b.lt) - h.ht) / 1e6 AS followup_seconds,
   (t.tt - h.ht) / 1e6 AS seconds_peak_to_trough, (n.ht - t.tt) / 1e6 AS seconds_trough_to_recovery
  FROM bl b JOIN hx h ON h.match_id = b.match_id AND h.period = b.period AND h.possession_id = b.possession_id AND h.isl = b.isl
  JOIN tr t ON t.match_id = b.match_id AND t.period = b.period AND t.possession_id = b.possession_id AND t.isl = b.isl
  LEFT JOIN hx n ON n.match_id = b.match_id AND n.period = b.period AND n.possession_id = b.possession_id AND n.isl = b.isl + 1)"""
_B = (EV, OWN_EV)


def r6(df, *cols, r=6):
    return df.withColumns({c: F.round(c, r) for c in cols})


def stream(fx):
    return number(R.action_vector(fx.own, OWN), fx.lane(*KEY), "event_position", start=0)


def actions(fx):
    return stream(fx).where("safe_action")


def path(fx):
    return R.action_path(actions(fx), fx.lane(*KEY))


def runs(fx):
    return R.sign_runs(actions(fx), fx.lane(*KEY))


def recoveries(fx):
    return R.recovery_inventory(path(fx), fx.lane(*KEY))


def possessions(fx):
    p = S.possession_inventory(fx.own, KEY, OWN)
    return R.possession_progression(p, actions(fx), path(fx), runs(fx), recoveries(fx), fx.lane(*KEY))


@query(
    "prg1_action_vector",
    sql(
        f"""a AS (SELECT *, event_team_id = {OWN} AND event_type IN ('Pass', 'Carry') AS c FROM own)
 SELECT event_id, c AND validated_anchor AND end_x IS NOT NULL AS safe_action, c AS action_candidate, c AND end_x IS NOT NULL AS explicit_vector_available,
  CASE WHEN c AND validated_anchor AND end_x IS NOT NULL THEN 'safe_validated_frame_vector' WHEN NOT c THEN 'not_own_pass_carry'
   WHEN NOT validated_anchor THEN 'unsupported_or_unlinked_frame' ELSE 'missing_or_invalid_endpoint' END AS action_status,
  CASE WHEN c AND validated_anchor THEN end_x - start_x END AS delta_x, CASE WHEN c AND validated_anchor THEN end_y - start_y END AS delta_y,
  ROUND(CASE WHEN c AND validated_anchor THEN sqrt((end_x - start_x)**2 + (end_y - start_y)**2) END, 6) AS euclidean FROM a""",
        *_B,
    ),
)
def prg1(fx):
    cols = ["safe_action", "action_candidate", "explicit_vector_available", "action_status", "delta_x", "delta_y", "euclidean"]
    return r6(R.action_vector(fx.own, OWN).select("event_id", *cols), "euclidean")


def signals(fx):
    s = fx.rich.withColumn("signals", E.provider_signals())
    rows = R.next_event_context(s, fx.lane("match_id"), fx.lane(*KEY)).where(F.col("possession_team_id") == OWN)
    return rows


SIG = f"""nx AS (SELECT *, LEAD(event_type) OVER m AS next_event_type, LEAD(event_team_id) OVER m AS next_event_team_id,
   LEAD(possession_team_id) OVER m AS next_possession_team_id, event_index = MAX(event_index) OVER (PARTITION BY {K}) AS fin
   FROM sg WINDOW m AS (PARTITION BY match_id ORDER BY event_index)),
 sgn AS (SELECT {K}, event_id, event_index, event_type, event_team_id, next_event_type, next_event_team_id, next_possession_team_id,
   unnest(list_concat(signals, CASE WHEN fin THEN ['provider_group_final_record'] ELSE [] END)) AS signal FROM nx WHERE possession_team_id = {OWN})"""


@query("prg2_next_event_context", sql(f"{SIG} SELECT * FROM sgn", EV, RICH))
def prg2(fx):
    return signals(fx).select(
        *KEY, "event_id", "event_index", "event_type", "event_team_id", "next_event_type", "next_event_team_id",
        "next_possession_team_id", "signal",
    )


@query(
    "prg3_action_path",
    sql(f"{PATH} SELECT {K}, event_index, vertex_no, x, running_peak_x, running_peak_x - x AS retreat_from_peak FROM path", *_B),
)
def prg3(fx):
    return path(fx).select(*KEY, "event_index", "vertex_no", "x", "running_peak_x", "retreat_from_peak")


@query(
    "prg4_sign_runs",
    sql(f"{ACT}, {RUNS} SELECT * REPLACE (ROUND(cumulative_x, 6) AS cumulative_x, ROUND(maximum_single, 6) AS maximum_single) FROM runs", *_B),
)
def prg4(fx):
    return r6(runs(fx), "cumulative_x", "maximum_single")


@query("prg5_recovery_inventory", sql(f"{PATH}, {REC} SELECT * FROM rec", *_B))
def prg5(fx):
    return recoveries(fx)


PP = f"""jp AS (SELECT *, start_x - LAG(end_x) OVER {W} AS jump FROM act),
 a AS (SELECT {K}, COUNT(*) AS safe_action_count, arg_min(start_x, event_index) AS first_x, arg_max(end_x, event_index) AS last_x,
  SUM(GREATEST(delta_x, 0)) AS cumulative_forward_x, SUM(GREATEST(-delta_x, 0)) AS cumulative_backward_x, MAX(GREATEST(-delta_x, 0)) AS maximum_single_backward,
  COUNT(*) FILTER (delta_x > 0) AS positive_action_count, COUNT(*) FILTER (delta_x < 0) AS negative_action_count,
  COUNT(*) FILTER (delta_x = 0) AS zero_action_count, COALESCE(SUM(jump), 0) AS inter_action_jump_sum FROM jp GROUP BY {K}),
 v AS (SELECT {K}, MAX(x) AS max_x, MIN(x) AS min_x, MAX(running_peak_x - x) AS maximum_retreat FROM path GROUP BY {K}),
 rm AS (SELECT {K}, MAX(action_count) FILTER (run_kind = 'positive') AS maximum_positive_run, MAX(action_count) FILTER (run_kind = 'negative') AS maximum_negative_run,
  MAX(action_count) FILTER (run_kind = 'nonpositive') AS maximum_nonpositive_run FROM runs GROUP BY {K}),
 rc AS (SELECT {K}, COUNT(*) AS excursion_count, COUNT(*) FILTER (recovered) AS recovery_count FROM rec GROUP BY {K}),
 pp AS (SELECT poss.*, COALESCE(safe_action_count, 0) AS safe_action_count, first_x, last_x, cumulative_forward_x, cumulative_backward_x,
  maximum_single_backward, positive_action_count, negative_action_count, zero_action_count, inter_action_jump_sum, last_x - first_x AS net_x,
  cumulative_forward_x / NULLIF(cumulative_backward_x, 0) AS forward_to_backward_ratio, max_x, min_x, maximum_retreat,
  COALESCE(maximum_positive_run, 0) AS maximum_positive_run, COALESCE(maximum_negative_run, 0) AS maximum_negative_run,
  COALESCE(maximum_nonpositive_run, 0) AS maximum_nonpositive_run, COALESCE(excursion_count, 0) AS excursion_count, COALESCE(recovery_count, 0) AS recovery_count
  FROM poss LEFT JOIN a USING ({K}) LEFT JOIN v USING ({K}) LEFT JOIN rm USING ({K}) LEFT JOIN rc USING ({K}))"""
FULL = f"{POSS}, {PATH}, {RUNS}, {REC}, {PP}"
_PPC = [
    "safe_action_count", "first_x", "last_x", "cumulative_forward_x", "cumulative_backward_x", "maximum_single_backward",
    "positive_action_count", "negative_action_count", "zero_action_count", "inter_action_jump_sum", "net_x",
    "forward_to_backward_ratio", "max_x", "min_x", "maximum_retreat", "maximum_positive_run", "maximum_negative_run",
    "maximum_nonpositive_run", "excursion_count", "recovery_count",
]


@query(
    "prg6_possession_progression",
    sql(f"{FULL} SELECT {K}, total_event_count, {', '.join(f'ROUND({c}, 6) AS {c}' for c in _PPC)} FROM pp", *_B),
)
def prg6(fx):
    return r6(possessions(fx).select(*KEY, "total_event_count", *_PPC), *_PPC)


LAYERS = {"full_events": "true", "safe_actions": "safe_action", "validated_anchors": "validated_anchor"}


@query(
    "prg7_layer_gaps",
    sql(
        f"""{ACT}, ly AS (SELECT 'full_events' AS layer, {K}, event_index, t_us FROM own UNION ALL SELECT 'safe_actions', {K}, event_index, t_us FROM act
  UNION ALL SELECT 'validated_anchors', {K}, event_index, t_us FROM own WHERE validated_anchor),
 g AS (SELECT layer, (t_us - LAG(t_us) OVER (PARTITION BY layer, {K} ORDER BY event_index)) / 1e6 AS e FROM ly)
 SELECT layer, COUNT(e) AS count, ROUND(AVG(e), 4) AS mean, ROUND(MIN(e), 4) AS min, ROUND(MAX(e), 4) AS max, ROUND(MEDIAN(e), 4) AS median,
  ROUND(QUANTILE_CONT(e, 0.9), 4) AS p90, ROUND(QUANTILE_CONT(e, 0.99), 4) AS p99, COUNT(*) FILTER (e > 3600) AS above FROM g WHERE e IS NOT NULL GROUP BY layer""",
        *_B,
    ),
)
def prg7(fx):
    from strideframe.operators.quantiles import distribution

    gaps = R.layer_gaps(R.action_vector(fx.own, OWN), LAYERS, fx.lane(*KEY))
    d = distribution(
        gaps, ["layer"], "elapsed_seconds", fx.small, {"median": 0.5, "p90": 0.9, "p99": 0.99},
        {"above": F.count_if(F.col("elapsed_seconds") > 3600)},
    ).drop("std")
    return r6(d, "mean", "min", "max", "median", "p90", "p99", r=4)


@query(
    "prg8_displacement_bins",
    sql(
        f"""{ACT}, b AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(R.DX_LABELS))}) t(bin, displacement_bin)),
 c AS (SELECT event_type, (delta_x >= -20)::INT + (delta_x >= -10)::INT + (delta_x >= 0)::INT + (delta_x >= 10)::INT + (delta_x >= 20)::INT AS bin, COUNT(*) AS n FROM act GROUP BY ALL),
 t AS (SELECT event_type, SUM(n) AS t FROM c GROUP BY event_type)
 SELECT event_type, displacement_bin, COALESCE(n, 0) AS n, ROUND(100.0 * COALESCE(n, 0) / t, 6) AS percentage FROM t CROSS JOIN b LEFT JOIN c USING (event_type, bin)""",
        *_B,
    ),
)
def prg8a(fx):
    return R.displacement_bins(actions(fx))


@query(
    "prg8_field_position_summary",
    sql(
        f"""{ACT}, b AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(R.DEPTH_LABELS))}) t(band, starting_x_band)),
 c AS (SELECT *, (start_x >= 0)::INT + (start_x >= 30)::INT + (start_x >= 60)::INT + (start_x >= 80)::INT + (start_x >= 100)::INT + (start_x >= 120)::INT AS band FROM act)
 SELECT starting_x_band, COUNT(delta_x) AS count, ROUND(AVG(delta_x), 6) AS mean, MIN(delta_x) AS min, MAX(delta_x) AS max, ROUND(MEDIAN(delta_x), 6) AS median,
  ROUND(QUANTILE_CONT(delta_x, 0.9), 6) AS p90, COUNT(*) FILTER (delta_x < 0) AS backward, COUNT(*) FILTER (delta_x <= -5) AS backward_at_least_5,
  COUNT(*) FILTER (delta_x <= -15) AS backward_at_least_15, COUNT(*) FILTER (delta_x <= -30) AS backward_at_least_30
 FROM b LEFT JOIN c USING (band) GROUP BY starting_x_band""",
        *_B,
    ),
)
def prg8b(fx):
    return r6(R.field_position_summary(actions(fx), fx.small), "mean", "median", "p90")


@query(
    "prg9_threshold_inventory",
    sql(
        FULL
        + " "
        + " UNION ALL ".join(
            f"SELECT {x}::DOUBLE AS retreat_at_least, COUNT(*) FILTER (maximum_retreat >= {x}) AS possessions, "
            f"ROUND(100.0 * COUNT(*) FILTER (maximum_retreat >= {x}) / COUNT(*), 6) AS pct_all, "
            f"ROUND(100.0 * COUNT(*) FILTER (maximum_retreat >= {x}) / COUNT(*) FILTER (safe_action_count > 0), 6) AS pct_measurable FROM pp"
            for x in R.RETREAT_SWEEP
        ),
        *_B,
    ),
)
def prg9a(fx):
    v = path(fx).groupBy(*KEY).agg(F.max("retreat_from_peak").alias("maximum_retreat"), F.count(F.lit(1)).alias("safe_action_count"))
    p = fx.own.select(*KEY).distinct().join(v, list(KEY), "left").withColumn("safe_action_count", F.coalesce("safe_action_count", F.lit(0)))
    return R.threshold_inventory(p, R.RETREAT_SWEEP)


@query(
    "prg9_depth_inventory",
    sql(
        f"""{PATH}, d AS (SELECT depth, {K}, MAX(running_peak_x - x) AS v FROM path, (VALUES (30.0::DOUBLE), (60), (80), (100)) t(depth) WHERE running_peak_x >= depth GROUP BY ALL)
 SELECT depth, COUNT(*) AS count, ROUND(AVG(v), 6) AS mean, ROUND(MIN(v), 6) AS min, ROUND(MAX(v), 6) AS max, ROUND(MEDIAN(v), 6) AS median, ROUND(QUANTILE_CONT(v, 0.9), 6) AS p90 FROM d GROUP BY depth""",
        *_B,
    ),
)
def prg9b(fx):
    return r6(R.depth_inventory(path(fx), KEY, (30, 60, 80, 100), fx.small), "mean", "min", "max", "median", "p90")


_LM = [h * HOUR_US for h in (6, 12, 24, 48)]


@query(
    "prg9_duration_landmarks",
    sql(
        POSS
        + " "
        + " UNION ALL ".join(
            f"SELECT {x} AS duration_above_us, COUNT(*) FILTER (duration_us > {x}) AS possessions, "
            f"ROUND(100.0 * COUNT(*) FILTER (duration_us > {x}) / COUNT(*), 6) AS percentage FROM poss"
            for x in _LM
        ),
        *_B,
    ),
)
def prg9c(fx):
    return R.duration_landmarks(S.possession_inventory(fx.own, KEY, OWN), _LM)


def sets(fx):
    a, p, r = actions(fx), path(fx), runs(fx)
    rec = recoveries(fx)
    return R.signal_sets(
        {
            "single_backward_action": (a, {str(n): f"delta_x <= -{n}" for n in R.RETREAT_SWEEP}),
            "cumulative_retreat_from_peak": (p, {str(n): f"retreat_from_peak >= {n}" for n in R.RETREAT_SWEEP}),
            "negative_run_actions": (r.where("run_kind = 'negative'"), {str(n): f"action_count >= {n}" for n in (2, 3, 4, 5)}),
            "observed_recovery": (rec.where("recovered"), {"any": "true", "slow": "seconds_to_recover > 7200"}),
        },
        KEY,
    )


SETS = f"""{PATH}, {RUNS}, {REC}, st AS (
 SELECT DISTINCT 'single_backward_action' AS signal, n::VARCHAR AS setting, {K} FROM act, (VALUES {", ".join(f"({n})" for n in R.RETREAT_SWEEP)}) t(n) WHERE delta_x <= -n
 UNION ALL SELECT DISTINCT 'cumulative_retreat_from_peak', n::VARCHAR, {K} FROM path, (VALUES {", ".join(f"({n})" for n in R.RETREAT_SWEEP)}) t(n) WHERE running_peak_x - x >= n
 UNION ALL SELECT DISTINCT 'negative_run_actions', n::VARCHAR, {K} FROM runs, (VALUES (2), (3), (4), (5)) t(n) WHERE run_kind = 'negative' AND action_count >= n
 UNION ALL SELECT DISTINCT 'observed_recovery', 'any', {K} FROM rec WHERE recovered
 UNION ALL SELECT DISTINCT 'observed_recovery', 'slow', {K} FROM rec WHERE recovered AND seconds_to_recover > 7200)"""


@query("prg10_signal_sets", sql(f"{SETS} SELECT signal, setting, COUNT(*) AS possession_count FROM st GROUP BY ALL", *_B))
def prg10(fx):
    return R.signal_counts(sets(fx))


@query(
    "prg11_signal_overlap",
    sql(
        f"""{SETS}, n AS (SELECT signal, setting, COUNT(*) AS c FROM st GROUP BY ALL),
 b AS (SELECT x.signal AS sa, x.setting AS ta, y.signal AS sb, y.setting AS tb, COUNT(*) AS c FROM st x JOIN st y ON x.match_id = y.match_id AND x.period = y.period
  AND x.possession_id = y.possession_id AND x.signal < y.signal GROUP BY ALL)
 SELECT x.signal AS signal_a, x.setting AS setting_a, y.signal AS signal_b, y.setting AS setting_b, COALESCE(b.c, 0) AS both_possessions,
  x.c + y.c - COALESCE(b.c, 0) AS either_possessions FROM n x JOIN n y ON x.signal < y.signal LEFT JOIN b ON sa = x.signal AND ta = x.setting AND sb = y.signal AND tb = y.setting""",
        *_B,
    ),
)
def prg11(fx):
    return R.signal_overlap(sets(fx), KEY)


@query(
    "prg12_termination_inventory",
    sql(
        f"""{SIG} SELECT signal, event_type, event_team_id, next_event_type, next_possession_team_id, COUNT(*) AS event_count, COUNT(DISTINCT match_id) AS match_count
 FROM sgn GROUP BY ALL""",
        EV, RICH,
    ),
)
def prg12(fx):
    return R.termination_inventory(signals(fx))


_M4 = ("duration_us", "total_event_count", "anchor_count", "maximum_retreat")


@query(
    "prg13_extreme_ranks",
    sql(
        f"""{POSS}, {PATH}, q AS (SELECT poss.*, maximum_retreat FROM poss LEFT JOIN (SELECT {K}, MAX(running_peak_x - x) AS maximum_retreat FROM path GROUP BY {K}) USING ({K})),
 t AS ({" UNION ALL ".join(f"SELECT {K}, '{m}' AS m, ROW_NUMBER() OVER (ORDER BY {m} DESC NULLS LAST, {K}) AS rk FROM q" for m in _M4)})
 SELECT {K}, string_agg(m || ':rank_' || rk, ';' ORDER BY m || ':rank_' || rk) AS ranking_reasons FROM t WHERE rk <= 20 GROUP BY {K}""",
        *_B,
    ),
)
def prg13(fx):
    v = path(fx).groupBy(*KEY).agg(F.max("retreat_from_peak").alias("maximum_retreat"))
    p = S.possession_inventory(fx.own, KEY, OWN).join(v, list(KEY), "left")
    return R.extreme_ranks(p, _M4, KEY, 20)


@query(
    "prg13_condition_picks",
    sql(
        f"""{POSS}, c AS ({" UNION ALL ".join(f"(SELECT {K}, '{n}' AS reason FROM poss WHERE {w} ORDER BY {K} LIMIT 2)" for n, w in
 (("shot_context", "has_shot"), ("sparse_anchors", "anchor_count <= 12"), ("many_anchors", "anchor_count >= 16")))})
 SELECT {K}, string_agg(reason, ';' ORDER BY reason) AS selection_reasons FROM c GROUP BY {K}""",
        *_B,
    ),
)
def prg13b(fx):
    conds = {
        "shot_context": F.col("has_shot"),
        "sparse_anchors": F.col("anchor_count") <= 12,
        "many_anchors": F.col("anchor_count") >= 16,
    }
    return R.condition_picks(S.possession_inventory(fx.own, KEY, OWN), conds, KEY, 2)


@query(
    "prg14_anchor_displacement",
    sql(
        f"""z AS (SELECT *, LAG(event_type) OVER w AS previous_anchor_type, LAG(event_team_id) OVER w AS previous_event_team_id, start_x - LAG(start_x) OVER w AS v
  FROM own WHERE validated_anchor WINDOW w AS {W})
 SELECT previous_anchor_type, event_type, previous_event_team_id, event_team_id, COUNT(v) AS count, ROUND(AVG(v), 6) AS mean, ROUND(STDDEV_SAMP(v), 6) AS std,
  ROUND(MIN(v), 6) AS min, ROUND(MAX(v), 6) AS max, ROUND(MEDIAN(v), 6) AS median, ROUND(QUANTILE_CONT(v, 0.9), 6) AS p90 FROM z WHERE previous_anchor_type IS NOT NULL GROUP BY ALL""",
        *_B,
    ),
)
def prg14(fx):
    d = R.anchor_displacement(fx.own.where("validated_anchor"), fx.lane(*KEY), "start_x", fx.small)
    return r6(d, "mean", "std", "min", "max", "median", "p90")


def state_stream(fx):
    s = R.action_vector(fx.rich.where(F.col("possession_team_id") == OWN), OWN)
    failed = (F.col("event_type") == "Pass") & F.col("pass_outcome").isNotNull()
    return s.withColumns(
        {
            "failed": failed,
            "restart": F.col("pass_type").isNotNull(),
            "trigger": failed
            | F.col("event_type").isin("Clearance", "Miscontrol", "Dispossessed", "Ball Recovery")
            | F.coalesce(F.col("receipt_outcome") == "Incomplete", F.lit(False)),
        }
    )


def state(fx):
    return R.measurement_state(state_stream(fx), fx.lane(*KEY))


STATE = f"""q0 AS (SELECT *, event_team_id = {OWN} AND event_type IN ('Pass', 'Carry') AND validated_anchor AND end_x IS NOT NULL AS safe,
   event_type = 'Pass' AND pass_outcome IS NOT NULL AS failed, pass_type IS NOT NULL AS restart,
   (event_type = 'Pass' AND pass_outcome IS NOT NULL) OR event_type IN ('Clearance', 'Miscontrol', 'Dispossessed', 'Ball Recovery')
    OR COALESCE(receipt_outcome = 'Incomplete', FALSE) AS trg FROM rich WHERE possession_team_id = {OWN}),
 q1 AS (SELECT *, COUNT(*) FILTER (trg) OVER w AS ct, COUNT(*) FILTER (failed OR (safe AND (restart OR end_x > start_x))) OVER w AS cut,
   COUNT(*) FILTER (safe AND NOT failed AND restart) OVER w AS res FROM q0 WINDOW w AS {W}),
 q2 AS (SELECT *, end_x - start_x AS dx, CASE WHEN restart THEN end_x ELSE GREATEST(start_x, end_x) END AS v FROM q1 WHERE safe AND NOT failed),
 q3 AS (SELECT *, MAX(v) OVER (PARTITION BY {K} ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old,
   LAG(end_x) OVER w AS pe, COALESCE(LAG(ct) OVER w, 0) AS pc FROM q2 WINDOW w AS {W}),
 q4 AS (SELECT *, CASE WHEN old IS NULL OR v >= old THEN FALSE WHEN start_x < pe - 1e-9 AND ct <> pc THEN TRUE END AS step FROM q3),
 stt AS (SELECT *, LAST_VALUE(step IGNORE NULLS) OVER (PARTITION BY {K} ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS affected,
   COUNT(*) FILTER (dx <= 0 AND NOT restart) OVER (PARTITION BY {K}, cut ORDER BY event_index) AS nonpositive_run,
   CASE WHEN NOT restart THEN MAX(CASE WHEN NOT restart THEN GREATEST(-dx, 0) END) OVER (PARTITION BY {K}, res ORDER BY event_index ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS recent_backward
   FROM q4)"""


@query(
    "prg15_measurement_state",
    sql(
        f"""{STATE} SELECT event_id, dx, restart, COALESCE(affected, FALSE) AS relocation_affected, NOT restart AND NOT COALESCE(affected, FALSE) AS eligible,
 dx > 0 AND (old IS NULL OR end_x > old) AS forward_peak, GREATEST(0, GREATEST(COALESCE(old, v), v) - end_x) AS retreat, nonpositive_run, recent_backward FROM stt""",
        EV, RICH,
    ),
)
def prg15(fx):
    return state(fx).select(
        "event_id", "dx", "restart", F.coalesce("relocation_affected", F.lit(False)).alias("relocation_affected"), "eligible",
        "forward_peak", "retreat", "nonpositive_run", "recent_backward",
    )


@query(
    "prg16_quality_summary",
    sql(
        f"""{FULL}, c AS (SELECT *, event_team_id = {OWN} AND event_type IN ('Pass', 'Carry') AS c FROM own)
 SELECT (SELECT COUNT(*) FROM own) AS events, (SELECT COUNT(*) FROM c WHERE c) AS action_candidates, (SELECT COUNT(*) FROM c WHERE c AND end_x IS NOT NULL) AS explicit_vectors,
  (SELECT COUNT(*) FROM act) AS safe_actions, (SELECT COUNT(*) FROM act WHERE NOT (start_x BETWEEN 0 AND 120 AND start_y BETWEEN 0 AND 80)
    OR NOT (end_x BETWEEN 0 AND 120 AND end_y BETWEEN 0 AND 80)) AS safe_actions_out_of_bounds,
  (SELECT COUNT(*) FROM c WHERE c AND end_x IS NULL) AS missing_endpoints, (SELECT COUNT(*) FROM pp) AS possessions,
  (SELECT COUNT(*) FROM pp WHERE safe_action_count = 0) AS possessions_without_safe_action,
  (SELECT COUNT(*) FROM pp WHERE safe_action_count > 0 AND cumulative_backward_x = 0) AS zero_backward_denominator""",
        *_B,
    ),
)
def prg16(fx):
    return R.quality_summary(R.action_vector(fx.own, OWN), possessions(fx))


# --- projections -------------------------------------------------------------------------


@query(
    "prj1_normalize_events",
    sql("SELECT event_id, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS props_k FROM events", "one AS (SELECT 1)"),
)
def prj1(fx):
    nested = fx.table("events").select("event_id", "user_id", "event_type", "value", F.from_json("props", "k int").alias("props"))
    return E.normalize_events(nested)


@query(
    "prj2_team_match_context",
    sql(
        f"""SELECT match_id, match_date, CASE WHEN home_team_id = {OWN} THEN away_team_id WHEN away_team_id = {OWN} THEN home_team_id END AS opponent_id,
 CASE WHEN home_team_id = {OWN} THEN 'Home' WHEN away_team_id = {OWN} THEN 'Away' END AS venue FROM matches""",
        EV, MATCHES,
    ),
)
def prj2(fx):
    return E.team_match_context(fx.matches, OWN).select("match_id", "match_date", "opponent_id", "venue")


@query(
    "prj3_team_event_dataset",
    sql(
        f"""SELECT event_id, match_id, match_date, CASE WHEN home_team_id = {OWN} THEN away_team_id ELSE home_team_id END AS opponent_id,
 CASE WHEN home_team_id = {OWN} THEN 'Home' ELSE 'Away' END AS venue FROM ev JOIN matches USING (match_id)
 WHERE event_team_id = {OWN} AND event_type = 'Pass' AND {OWN} IN (home_team_id, away_team_id)""",
        EV, MATCHES,
    ),
)
def prj3(fx):
    return E.team_event_dataset(fx.ev, fx.matches, OWN, "Pass").select("event_id", "match_id", "match_date", "opponent_id", "venue")


@query("prj4_provider_signals", sql("SELECT event_id, array_to_string(signals, ';') AS signals FROM sg", EV, RICH))
def prj4(fx):
    return fx.rich.select("event_id", F.array_join(E.provider_signals(), ";").alias("signals"))


@query(
    "prj6_valid_point",
    sql(
        """SELECT event_id, end_x IS NOT NULL AS valid_end, COALESCE(end_x >= 102 AND end_y BETWEEN 18 AND 62, FALSE) AS end_in_box,
 COALESCE(end_x BETWEEN 0 AND 120 AND end_y BETWEEN 0 AND 80, FALSE) AS end_on_pitch FROM ev""",
        EV,
    ),
)
def prj6(fx):
    from strideframe.operators.outcomes import inside_box, on_pitch

    return fx.ev.withColumn("p", F.array("end_x", "end_y")).selectExpr(
        "event_id",
        f"{E.valid_point('p')} AS valid_end",
        f"coalesce({inside_box('end_x', 'end_y')}, false) AS end_in_box",
        f"coalesce({on_pitch('end_x', 'end_y')}, false) AS end_on_pitch",
    )


@query(
    "prj7_zone_label",
    sql(
        """SELECT event_id, CASE WHEN end_x >= 0 AND end_x < 40 THEN 'defensive_third' WHEN end_x >= 40 AND end_x < 80 THEN 'middle_third'
 WHEN end_x BETWEEN 80 AND 120 THEN 'attacking_third' ELSE 'outside_pitch' END AS third,
 CASE WHEN end_y >= 0 AND end_y < 26.67 THEN 'left' WHEN end_y >= 26.67 AND end_y < 53.33 THEN 'centre' WHEN end_y >= 53.33 AND end_y < 80 THEN 'right' END AS lane FROM ev""",
        EV,
    ),
)
def prj7(fx):
    return fx.ev.select(
        "event_id",
        E.starting_third("end_x").alias("third"),
        E.zone_label("end_y", (0, 26.67, 53.33, 80), ("left", "centre", "right")).alias("lane"),
    )


@query(
    "prj8_safe_endpoint",
    sql(
        """SELECT event_id, CASE WHEN event_type IN ('Pass', 'Carry') AND k % 9 <> 4 THEN end_x END AS end_x_safe,
 CASE WHEN event_type IN ('Pass', 'Carry') AND k % 9 <> 4 AND end_x IS NOT NULL THEN end_y END AS end_y_safe FROM ev""",
        EV,
    ),
)
def prj8(fx):
    shaped = "CASE k % 9 WHEN 4 THEN array(end_x) WHEN 5 THEN array(end_x, end_y, 1.0D) ELSE array(end_x, end_y) END"
    nested = fx.ev.selectExpr(
        "event_id",
        f"CASE WHEN event_type = 'Pass' THEN {shaped} END AS pass_end",
        f"CASE WHEN event_type = 'Carry' THEN {shaped} END AS carry_end",
    )
    return nested.select("event_id", *[c.alias(n) for n, c in E.safe_endpoint(["pass_end", "carry_end"]).items()])


@query(
    "prj9_match_stream_context",
    sql(
        f"""SELECT event_id, event_type, array_to_string(signals, ';') AS signals, CASE WHEN pass_type IN ('Corner', 'Throw-in') THEN pass_type END AS restart_type,
 advantage, COALESCE(keeper_type, '') AS keeper_type, recovery_failure, COALESCE(dribble_outcome, '') AS dribble_outcome FROM sg WHERE possession_team_id = {OWN}""",
        EV, RICH,
    ),
)
def prj9(fx):
    return E.match_stream_context(fx.rich, OWN).select(
        "event_id", "event_type", F.array_join("signals", ";").alias("signals"), "restart_type", "advantage", "keeper_type",
        "recovery_failure", "dribble_outcome",
    )
