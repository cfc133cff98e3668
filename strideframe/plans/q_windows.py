"""k-action windows, motifs, effectiveness and starting-context queries."""

from pyspark.sql import functions as F

from strideframe.operators import contexts as X
from strideframe.operators import windows as N
from strideframe.operators.quality import bin_column
from strideframe.operators.quantiles import exact_quantiles
from strideframe.plans.fixtures import OWN, sql
from strideframe.plans.q_outcomes import HORIZONS, LABELS, SESSION, labels
from strideframe.plans.q_transitions import (
    BASE, GAPS, JOINED, MAIN, RESP, SEL, W, _OUT, _XG, anchors, edges_sql, joined, lane, rd,
)
from strideframe.operators import transitions as T
from strideframe.plans.q_transitions import actions, transitions
from strideframe.plans.registry import query
from strideframe.sources.stage import durable

S = ", ".join(SESSION)


def chains(fx):
    a = anchors(fx)
    sel = T.select_transitions(transitions(fx, a), a, actions(fx), SESSION, OWN).where("selection_reason = 'eligible'")
    return N.windows(a, sel, lane(fx), (2, 3), OWN, RESP)


def wins(fx):
    return N.window_geometry(N.window_rows(chains(fx), SESSION), RESP)


_PICK = ["match_id", "period", "possession_id", "window_id", "window_length", "action_type_motif", "direction_profile", "carry_action_count",
         "total_progression", "first_action_start_x", "duration_seconds", "maximum_leg_gap", "intervening_event_count", "starting_third",
         "start_event_id", "terminal_event_id", "terminal_event_team_id", "any_frame_oob", "any_frame_oob_unknown", "any_frame_coincident",
         "any_frame_coincident_unknown", "observed_opp_centroid_x_status", *[f"net_{r}" for r in RESP], *[f"leg_{i}_delta_{RESP[0]}" for i in (1, 2, 3)]]


def stored(fx):
    """The window table, written once: several aggregations read it."""
    return durable(wins(fx).select(*_PICK))


_RN = lambda r: f"CASE WHEN {r}_available THEN {r} END"
_STATE = "struct_pack(id := event_id, t := t_us, type := event_type, team := event_team_id, m := member_order, gap := seconds_from_previous, bt := intervening_events, reason := reason, letter := letter, dx := dx, sx := sx, ex := ex, fo := frame_oob, fou := frame_oob_unknown, fc := frame_coincident, fcu := frame_coincident_unknown, " + ", ".join(f"{r} := {_RN(r)}" for r in RESP) + ")"
CHAIN = f"""{SEL}, aw AS (SELECT anc.*, CASE WHEN anc.event_team_id <> {OWN} THEN 'opponent_from_anchor' WHEN anc.event_type NOT IN ('Pass', 'Carry') THEN 'non_pass_carry_from_anchor'
   WHEN el.from_event_id IS NULL THEN 'not_eligible_progression' END AS reason, el.action_type[1] AS letter, el.action_delta_x AS dx, el.action_start_x AS sx, el.action_end_x AS ex
   FROM anc LEFT JOIN el ON el.from_event_id = anc.event_id),
 sw AS (SELECT {S}, anchor_order, event_index, {_STATE} AS s0 FROM aw),
 lw AS (SELECT *, LEAD(s0, 1) OVER w AS s1, LEAD(s0, 2) OVER w AS s2, LEAD(s0, 3) OVER w AS s3 FROM sw WINDOW w AS {W}),
 ch AS (SELECT {S}, anchor_order, 2 AS window_length, [s0, s1, s2] AS st, s2 AS fin, COALESCE(s0.reason, s1.reason, 'eligible') AS selection_reason FROM lw WHERE s2 IS NOT NULL
  UNION ALL SELECT {S}, anchor_order, 3, [s0, s1, s2, s3], s3, COALESCE(s0.reason, s1.reason, s2.reason, 'eligible') FROM lw WHERE s3 IS NOT NULL),
 wi AS (SELECT {S}, anchor_order, window_length, st, match_id || ':' || period || ':' || possession_id || ':k' || window_length || ':a' || anchor_order AS window_id,
   list_reduce(list_transform(st[1:window_length], lambda z: z.letter), lambda a, b: a || b) AS action_type_motif,
   list_reduce(list_transform(st[1:window_length], lambda z: CASE WHEN z.dx > 0 THEN 'F' ELSE 'R' END), lambda a, b: a || b) AS direction_profile,
   len(list_filter(st[1:window_length], lambda z: z.letter = 'C')) AS carry_action_count, list_sum(list_transform(st[1:window_length], lambda z: z.dx)) AS total_progression,
   list_sum(list_transform(st[1:window_length], lambda z: GREATEST(z.dx, 0))) AS total_positive_progression, list_sum(list_transform(st[1:window_length], lambda z: GREATEST(-z.dx, 0))) AS total_nonpositive_magnitude,
   st[1].sx AS first_action_start_x, st[window_length].ex AS final_action_end_x, st[window_length].ex - st[1].sx AS net_action_progression, (fin.t - st[1].t) / 1e6 AS duration_seconds,
   list_max(list_transform(st[2:], lambda z: z.gap)) AS maximum_leg_gap, list_avg(list_transform(st[2:], lambda z: z.gap)) AS mean_leg_gap, list_median(list_transform(st[2:], lambda z: z.gap)) AS median_leg_gap,
   list_sum(list_transform(st[2:], lambda z: z.bt)) AS intervening_event_count, fin.m - st[1].m AS event_span_steps, st[1].id AS start_event_id, fin.id AS terminal_event_id, fin.team AS terminal_event_team_id,
   list_bool_or(list_transform(st, lambda z: z.fo)) AS any_frame_oob, list_bool_or(list_transform(st, lambda z: z.fou)) AS any_frame_oob_unknown,
   list_bool_or(list_transform(st, lambda z: z.fc)) AS any_frame_coincident, list_bool_or(list_transform(st, lambda z: z.fcu)) AS any_frame_coincident_unknown,
   {", ".join(f"st[1].{r} AS start_{r}, fin.{r} AS end_{r}, fin.{r} - st[1].{r} AS net_{r}, list_min(list_transform(st, lambda z: z.{r})) AS min_{r}, list_max(list_transform(st, lambda z: z.{r})) AS max_{r}, list_count(list_transform(st, lambda z: z.{r})) AS cnt_{r}" for r in RESP)}
  FROM ch WHERE selection_reason = 'eligible'),
 wn AS (SELECT *, CASE WHEN first_action_start_x >= 0 AND first_action_start_x < 40 THEN 'defensive_third' WHEN first_action_start_x >= 40 AND first_action_start_x < 80 THEN 'middle_third'
   WHEN first_action_start_x BETWEEN 80 AND 120 THEN 'attacking_third' ELSE 'outside_pitch' END AS starting_third FROM wi)"""
_R = lambda cols: ", ".join(f"ROUND({c}, 6) AS {c}" for c in cols)


@query("mot1_windows", sql(f"{CHAIN} SELECT window_length, selection_reason, COUNT(*) AS n FROM ch GROUP BY ALL", *BASE))
def mot1(fx):
    return N.window_audit(chains(fx))


_ROW = ["total_progression", "total_positive_progression", "total_nonpositive_magnitude", "first_action_start_x", "final_action_end_x",
        "net_action_progression", "duration_seconds", "maximum_leg_gap"]
#: halves of a microsecond would round either way, so means are compared doubled
_TWICE = ["mean_leg_gap", "median_leg_gap"]
_ROWI = ["window_id", "action_type_motif", "direction_profile", "carry_action_count", "intervening_event_count", "event_span_steps",
         "terminal_event_id", "terminal_event_team_id", "any_frame_oob", "any_frame_coincident", "starting_third"]


@query("mot2_window_row", sql(f"{CHAIN} SELECT {', '.join(_ROWI)}, {_R(_ROW)}, {', '.join(f'ROUND(2 * {c}, 6) AS {c}_x2' for c in _TWICE)} FROM wn", *BASE))
def mot2(fx):
    w = N.window_rows(chains(fx), SESSION)
    return rd(w.select(*_ROWI, *_ROW, *[(2 * F.col(c)).alias(f"{c}_x2") for c in _TWICE]))


_G = RESP[0]


@query(
    "mot3_window_geometry",
    sql(
        f"""{CHAIN} SELECT window_id, {", ".join(f"ROUND(start_{r}, 6) AS start_{r}, ROUND(end_{r}, 6) AS end_{r}, ROUND(net_{r}, 6) AS net_{r}, ROUND(max_{r} - min_{r}, 6) AS observed_{r}_range, cnt_{r} AS observed_{r}_count, CASE WHEN cnt_{r} = len(st) THEN 'complete' WHEN cnt_{r} > 0 THEN 'partial_available_states' ELSE 'unavailable' END AS observed_{r}_status" for r in RESP)},
 ROUND(GREATEST(0, max_{_G} - CASE WHEN start_{_G} IS NULL THEN NULL ELSE start_{_G} END), 6) AS advance_raw, ROUND(st[2].{_G} - st[1].{_G}, 6) AS leg_1_delta_{_G}, ROUND(st[3].{_G} - st[2].{_G}, 6) AS leg_2_delta_{_G} FROM wn""".replace(
            f"ROUND(GREATEST(0, max_{_G} - CASE WHEN start_{_G} IS NULL THEN NULL ELSE start_{_G} END), 6) AS advance_raw",
            f"CASE WHEN start_{_G} IS NOT NULL THEN ROUND(GREATEST(0, max_{_G} - start_{_G}), 6) END AS maximum_{_G}_advance, CASE WHEN start_{_G} IS NOT NULL THEN ROUND(GREATEST(0, start_{_G} - min_{_G}), 6) END AS maximum_{_G}_reversal",
        ),
        *BASE,
    ),
)
def mot3(fx):
    cols = [c for r in RESP for c in (f"start_{r}", f"end_{r}", f"net_{r}", f"observed_{r}_range", f"observed_{r}_count", f"observed_{r}_status")]
    extra = [f"maximum_{_G}_advance", f"maximum_{_G}_reversal", f"leg_1_delta_{_G}", f"leg_2_delta_{_G}"]
    return rd(wins(fx).select("window_id", *cols, *extra))


_WM = {
    "all": "TRUE", "gap_le_5": "maximum_leg_gap <= 18000", "gap_le_3": "maximum_leg_gap <= 10800", "terminal_own": f"terminal_event_team_id = {OWN}",
    "exclude_oob": "NOT any_frame_oob AND NOT any_frame_oob_unknown", "exclude_coincidence": "NOT any_frame_coincident AND NOT any_frame_coincident_unknown",
}
WSC = "ws AS (" + " UNION ALL ".join(f"SELECT *, '{n}' AS scope FROM wn WHERE {c}" for n, c in _WM.items()) + ")"


def scopes():
    return N.window_scopes(GAPS, OWN)


def scoped(fx):
    return T.in_scopes(stored(fx), scopes())


@query("mot4_window_scope", sql(f"{CHAIN}, {WSC} SELECT scope, window_length, COUNT(*) AS n FROM ws GROUP BY ALL", *BASE))
def mot4(fx):
    return T.in_scopes(wins(fx).select(*_PICK), scopes()).groupBy("scope", "window_length").agg(F.count(F.lit(1)).alias("n"))


LAB = "lb AS (SELECT 2 AS window_length, a || b AS motif FROM (VALUES ('P'), ('C')) x(a), (VALUES ('P'), ('C')) y(b) UNION ALL SELECT 3, a || b || c FROM (VALUES ('P'), ('C')) x(a), (VALUES ('P'), ('C')) y(b), (VALUES ('P'), ('C')) z(c))"


@query("mot5_motif_labels", sql(f"{CHAIN}, {LAB} SELECT lb.*, COUNT(wn.window_id) AS n FROM lb LEFT JOIN wn ON wn.window_length = lb.window_length AND action_type_motif = motif GROUP BY ALL", *BASE))
def mot5(fx):
    w = wins(fx).groupBy("window_length", F.col("action_type_motif").alias("motif")).agg(F.count(F.lit(1)).alias("n"))
    out = N.label_table(fx.spark, "action").join(w, ["window_length", "motif"], "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0)))


#: what motifs are described by: progress, duration, net change of each response, change of the first response leg by leg
_SV = ("total_progression", "net_opp_centroid_x", "duration_seconds", *[f"net_{r}" for r in RESP[1:]], *[f"leg_{i}_delta_{RESP[0]}" for i in (1, 2, 3)])
_LEGS = ", ".join(f"CASE WHEN window_length >= {i} THEN st[{i + 1}].{RESP[0]} - st[{i}].{RESP[0]} END AS leg_{i}_delta_{RESP[0]}" for i in (1, 2, 3))
SUMM = f"""{CHAIN}, {WSC.replace("SELECT *, '", f"SELECT *, {_LEGS}, '")}, {LAB}, tt AS (SELECT scope, window_length, COUNT(*) AS scope_windows FROM ws GROUP BY ALL),
 sm AS (SELECT t.window_length, t.scope, motif, scope_windows, COUNT(window_id) AS n, COUNT(DISTINCT CASE WHEN window_id IS NOT NULL THEN (match_id, period, possession_id) END) AS sessions,
   COUNT(DISTINCT match_id) AS matches, {", ".join(f"COUNT({v}) AS {v}_known" for v in _SV)}, {", ".join(f"QUANTILE_CONT({v}, {q}) AS {v}_{n}" for v in _SV for n, q in (("q25", .25), ("median", .5), ("q75", .75)))}
  FROM tt t JOIN lb USING (window_length) LEFT JOIN ws ON ws.window_length = t.window_length AND ws.scope = t.scope AND action_type_motif = motif GROUP BY ALL)"""


@query(
    "mot6_motif_summary",
    sql(
        f"""{SUMM} SELECT window_length, scope, motif, scope_windows, n, sessions, matches, ROUND(n / scope_windows, 6) AS share_of_windows,
 {", ".join(f"{v}_known, ROUND({v}_q75 - {v}_q25, 6) AS {v}_iqr" for v in _SV)}, {", ".join(f"ROUND({v}_{n}, 6) AS {v}_{n}" for v in _SV for n in ("q25", "median", "q75"))} FROM sm""",
        *BASE,
    ),
)
def mot6(fx):
    return rd(N.motif_summary(scoped(fx), "action", SESSION, _SV, fx.small))


@query("mot7_adjusted_contrasts")
def mot7(fx):
    return N.adjusted_contrasts(stored(fx), 2, "net_opp_centroid_x")


@query(
    "mot8_motif_sensitivity",
    sql(
        f"""{SUMM} SELECT a.window_length, a.motif, a.scope, a.n, b.n AS primary_n, ROUND(a.net_opp_centroid_x_median - b.net_opp_centroid_x_median, 6) AS median_difference,
 SIGN(a.net_opp_centroid_x_median) = SIGN(b.net_opp_centroid_x_median) AS sign_preserved FROM sm a JOIN sm b ON a.window_length = b.window_length AND a.motif = b.motif AND b.scope = 'all' WHERE a.scope <> 'all'""",
        *BASE,
    ),
)
def mot8(fx):
    return rd(N.motif_sensitivity(N.motif_summary(scoped(fx), "action", SESSION, _SV[1:2], fx.small), _SV[1]))


@query(
    "mot8_motif_support",
    sql(
        f"""{CHAIN}, {LAB}, c AS (SELECT window_length, action_type_motif AS motif, match_id, COUNT(*) AS w FROM wn GROUP BY ALL),
 a AS (SELECT window_length, motif, SUM(w) AS n, COUNT(*) AS matches, MIN(w) AS min_per_match, MAX(w) AS max_per_match, MEDIAN(w) AS median_per_match FROM c GROUP BY ALL),
 s AS (SELECT window_length, action_type_motif AS motif, COUNT(DISTINCT ({S})) AS sessions FROM wn GROUP BY ALL)
 SELECT lb.*, COALESCE(n, 0) AS n, COALESCE(matches, 0) AS matches, min_per_match, max_per_match, median_per_match, COALESCE(sessions, 0) AS sessions FROM lb LEFT JOIN a USING (window_length, motif) LEFT JOIN s USING (window_length, motif)""",
        *BASE,
    ),
)
def mot8b(fx):
    return N.motif_support(stored(fx), SESSION, fx.small)


def terminal(fx):
    return N.join_terminal_outcomes(wins(fx).select(*_PICK), labels(fx), _OUT)


TERM = f"{CHAIN}, {LABELS}, te AS (SELECT wn.*, lab.event_id IS NULL AS outcome_missing, {', '.join('lab.' + c for c in _OUT)} FROM wn LEFT JOIN lab ON lab.event_id = wn.terminal_event_id)"


@query(
    "mot9_join_terminal_outcomes",
    sql(f"{TERM} SELECT window_id, terminal_event_id, outcome_missing, {', '.join(f'ROUND({c}, 6) AS {c}' if c in _XG else c for c in _OUT)} FROM te", *BASE),
)
def mot9(fx):
    return rd(terminal(fx).select("window_id", "terminal_event_id", "outcome_missing", *_OUT))


_X = f"future_xg_{MAIN}"


@query(
    "mot10_effectiveness_description",
    sql(
        f"""{TERM}, d AS (SELECT 'motif' AS grp, action_type_motif AS value, * FROM te UNION ALL SELECT 'direction', direction_profile, * FROM te UNION ALL SELECT 'third', starting_third, * FROM te
  UNION ALL SELECT 'carries', carry_action_count::VARCHAR, * FROM te)
 SELECT window_length, grp AS grouping, value, COUNT(*) AS n, COUNT(DISTINCT match_id) AS matches, SUM(box_entry_within_{MAIN}) AS box_entry_n, ROUND(AVG(box_entry_within_{MAIN}), 10) AS box_entry_rate,
  SUM(shot_within_{MAIN}) AS shot_n, ROUND(AVG(shot_within_{MAIN}), 10) AS shot_rate, ROUND(SUM({_X}::DECIMAL(38, 12))::DOUBLE / COUNT({_X}), 10) AS mean_future_xg,
  ROUND(AVG(CASE WHEN {_X} > 0 THEN 1 WHEN {_X} IS NOT NULL THEN 0 END), 10) AS proportion_positive_xg, ROUND(SUM({_X}::DECIMAL(38, 12)) FILTER ({_X} > 0)::DOUBLE / COUNT(*) FILTER ({_X} > 0), 10) AS mean_positive_xg,
  COUNT(*) FILTER ({_X} IS NULL) AS missing_xg_n, ROUND(MEDIAN(total_progression), 10) AS median_total_progression FROM d GROUP BY ALL""",
        *BASE,
    ),
)
def mot10(fx):
    g = F.array(*[
        F.struct(F.lit(n).alias("grouping"), F.col(c).cast("string").alias("value"))
        for n, c in (("motif", "action_type_motif"), ("direction", "direction_profile"), ("third", "starting_third"), ("carries", "carry_action_count"))
    ])
    rows = durable(terminal(fx)).select("*", F.inline(g))
    return rd(N.effectiveness_description(rows, ["window_length", "grouping", "value"], MAIN, fx.small), 10)


@query("mot11_motif_logit")
def mot11(fx):
    t = durable(terminal(fx))
    q = [exact_quantiles(t.where("window_length = 2"), [], c, {c: 0.5}, fx.small) for c in N.CONTROLS]
    m = q[0].crossJoin(q[1]).crossJoin(q[2]).first()
    return fx.spark.createDataFrame(N.motif_logit(t, 2, f"box_entry_within_{MAIN}", m.asDict()), N.MODEL_SCHEMA)


@query("mot12_effectiveness_analyze")
def mot12(fx):
    return N.effectiveness_analyze(durable(terminal(fx)), scopes(), list(HORIZONS), MAIN, fx.small)


@query(
    "mot13_window_sample_tables",
    sql(
        f"""{CHAIN} SELECT window_length, COUNT(*) AS eligible_windows, COUNT(DISTINCT match_id) AS matches, COUNT(net_opp_centroid_x) AS endpoint_n, COUNT(*) FILTER (intervening_event_count = 0) AS zero_intervening,
 ROUND(QUANTILE_CONT(duration_seconds, 0.25), 4) AS duration_q25, ROUND(MEDIAN(duration_seconds), 4) AS duration_median, ROUND(QUANTILE_CONT(duration_seconds, 0.75), 4) AS duration_q75,
 ROUND(QUANTILE_CONT(duration_seconds, 0.9), 4) AS duration_p90, ROUND(MAX(duration_seconds), 4) AS duration_max, ROUND(MEDIAN(maximum_leg_gap), 4) AS gap_median, ROUND(QUANTILE_CONT(maximum_leg_gap, 0.95), 4) AS gap_p95
 FROM wn GROUP BY window_length""",
        *BASE,
    ),
)
def mot13(fx):
    return rd(N.window_sample_tables(stored(fx), "net_opp_centroid_x", fx.small), 4)


@query(
    "mot13_motif_third_counts",
    sql(
        f"""{CHAIN}, c AS (SELECT window_length, action_type_motif AS motif, starting_third, COUNT(*) AS n FROM wn GROUP BY ALL)
 SELECT *, ROUND(100.0 * n / SUM(n) OVER (PARTITION BY window_length, starting_third), 6) AS share_within_third_pct FROM c""",
        *BASE,
    ),
)
def mot13b(fx):
    return N.motif_third_counts(wins(fx))


@query(
    "mot13_motif_direction_crosstab",
    sql(f"{CHAIN} SELECT action_type_motif AS motif, {', '.join(f'''COUNT(*) FILTER (direction_profile = '{d}') AS {d}''' for d in ('FF', 'FR', 'RF', 'RR'))} FROM wn WHERE window_length = 2 GROUP BY ALL", *BASE),
)
def mot13c(fx):
    return N.motif_direction_crosstab(wins(fx), 2)


@query(
    "mot14_between_group_reduction",
    sql(
        f"""{CHAIN}, o AS (SELECT window_length, action_type_motif AS m, total_progression AS x, net_opp_centroid_x AS y FROM wn WHERE net_opp_centroid_x IS NOT NULL),
 f AS (SELECT window_length, AVG(x) AS mx, AVG(y) AS my, COVAR_POP(x, y) / VAR_POP(x) AS b FROM o GROUP BY ALL), c AS (SELECT window_length, m, COUNT(*) AS n, AVG(x) AS cx, AVG(y) AS cy FROM o GROUP BY ALL),
 r AS (SELECT window_length, SUM((cy - my)**2 * n) / SUM(n) AS a, SUM((cy - my - b * (cx - mx))**2 * n) / SUM(n) AS z FROM c JOIN f USING (window_length) GROUP BY ALL)
 SELECT window_length, ROUND(a, 6) AS raw_variance, ROUND(z, 6) AS residual_variance, ROUND(100 * (1 - z / a), 6) AS reduction_pct FROM r""",
        *BASE,
    ),
)
def mot14(fx):
    return rd(N.between_group_reduction(stored(fx), "net_opp_centroid_x"))


@query(
    "mot15_typical_example",
    sql(
        f"""{CHAIN}, q AS (SELECT window_length, action_type_motif, {", ".join(f"QUANTILE_CONT({v}, {p}) AS {v}_{n}" for v in _SV for n, p in (("a", .25), ("m", .5), ("b", .75)))} FROM wn GROUP BY ALL),
 k AS (SELECT wn.*, {", ".join(f"{v}_a, {v}_m, {v}_b" for v in _SV)} FROM wn JOIN q USING (window_length, action_type_motif) WHERE maximum_leg_gap <= 18000 AND NOT any_frame_coincident AND NOT any_frame_coincident_unknown AND cnt_opp_centroid_x = len(st)),
 s AS (SELECT window_length, action_type_motif, MEDIAN(duration_seconds) AS sup FROM k GROUP BY ALL),
 z AS (SELECT k.*, ROUND({" + ".join(f"CASE WHEN {v}_b > {v}_a THEN ABS({v} - {v}_m) / ({v}_b - {v}_a) ELSE 0 END" for v in _SV)}, 9) AS distance FROM k JOIN s USING (window_length, action_type_motif) WHERE duration_seconds >= sup)
 SELECT window_length, action_type_motif, distance, window_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY window_length, action_type_motif ORDER BY distance, window_id) AS rn FROM z) WHERE rn = 1""",
        *BASE,
    ),
)
def mot15(fx):
    sc = scopes()
    keep = sc["gap_le_5"] & sc["exclude_coincidence"] & (F.col("observed_opp_centroid_x_status") == "complete")
    return N.typical_example(stored(fx), ["window_length", "action_type_motif"], keep, "duration_seconds", _SV, ["window_id"], fx.small)


# --- starting context ----------------------------------------------------------------------

COL = "opp_centroid_x"
RS = "delta_opp_centroid_x"


def started(fx):
    out = X.attach_start_geometry(joined(fx), anchors(fx), "from_event_id", [COL])
    return out.withColumn(f"start_{COL}", F.round(f"start_{COL}", 9))


def contexts(fx):
    s = durable(started(fx))
    return X.assign_contexts(s, X.fit_cutpoints(s, f"start_{COL}", fx.small), f"start_{COL}")


START = f"""{JOINED}, sg0 AS (SELECT jo.*, ROUND(CASE WHEN anc.{COL}_available THEN anc.{COL} END, 9) AS start_{COL}, anc.event_id IS NULL AS start_missing FROM jo LEFT JOIN anc ON anc.event_id = jo.from_event_id),
 cp AS (SELECT starting_third, COUNT(*) AS n, MIN(start_{COL}) AS raw_min, MAX(start_{COL}) AS raw_max, QUANTILE_CONT(start_{COL}, 1/3) AS lower_cut, QUANTILE_CONT(start_{COL}, 2/3) AS upper_cut FROM sg0
  WHERE start_{COL} IS NOT NULL AND starting_third <> 'outside_pitch' GROUP BY ALL),
 cx AS (SELECT sg0.*, 1 + (start_{COL} > lower_cut)::INT + (start_{COL} > upper_cut)::INT AS context FROM sg0 LEFT JOIN cp USING (starting_third))"""


@query("ctx1_attach_start_geometry", sql(f"{START} SELECT from_event_id, ROUND(start_{COL}, 6) AS start_{COL}, start_missing FROM sg0", *BASE))
def ctx1(fx):
    return rd(started(fx).select("from_event_id", f"start_{COL}", "start_missing"))


@query("ctx2_fit_cutpoints", sql(f"{START} SELECT starting_third, n, {_R(['raw_min', 'raw_max', 'lower_cut', 'upper_cut'])}, lower_cut >= upper_cut AS tied FROM cp", *BASE))
def ctx2(fx):
    return rd(X.fit_cutpoints(durable(started(fx)), f"start_{COL}", fx.small))


@query("ctx3_assign_contexts", sql(f"{START} SELECT from_event_id, context, CASE context WHEN 1 THEN 'low' WHEN 2 THEN 'middle' WHEN 3 THEN 'high' END AS context_label FROM cx", *BASE))
def ctx3(fx):
    return contexts(fx).select("from_event_id", "context", "context_label")


def motif_contexts(fx):
    s = durable(started(fx).select("starting_third", f"start_{COL}"))
    w = X.attach_start_geometry(terminal(fx).where("window_length = 2"), anchors(fx), "start_event_id", [COL])
    w = w.withColumn(f"start_{COL}", F.round(f"start_{COL}", 9))
    return X.assign_contexts(w, X.fit_cutpoints(s, f"start_{COL}", fx.small), f"start_{COL}")


@query(
    "ctx4_construct_motifs",
    sql(
        f"""{START}, {CHAIN.split(SEL + ", ", 1)[1]} SELECT window_id, action_type_motif, 1 + (v > lower_cut)::INT + (v > upper_cut)::INT AS context FROM (
 SELECT wn.*, ROUND(CASE WHEN anc.{COL}_available THEN anc.{COL} END, 9) AS v FROM wn JOIN anc ON anc.event_id = wn.start_event_id WHERE window_length = 2) LEFT JOIN cp USING (starting_third)""",
        *BASE,
    ),
)
def ctx4(fx):
    return motif_contexts(fx).select("window_id", "action_type_motif", "context")


@query(
    "ctx5_context_description",
    sql(
        f"""{START}, v AS (SELECT action_type, {edges_sql('ROUND(' + RS + ', 9)', 4)} AS e FROM cx WHERE {RS} IS NOT NULL GROUP BY ALL),
 q AS (SELECT cx.*, ROUND({RS}, 9) AS d, CASE WHEN {RS} IS NULL THEN 'unavailable' ELSE 'Q' || GREATEST(1, len(list_filter(e, lambda z: z < ROUND({RS}, 9)))) END AS quartile FROM cx JOIN v USING (action_type))
 SELECT action_type, context, quartile, COUNT(*) AS n, COUNT(DISTINCT match_id) AS matches, SUM(box_entry_within_{MAIN}) AS positive_n, ROUND(AVG(box_entry_within_{MAIN}), 6) AS box_entry_rate,
  ROUND(AVG(shot_within_{MAIN}), 6) AS shot_rate, COUNT(d) AS response_n, ROUND(AVG(d), 6) AS response_mean, ROUND(AVG({_X}), 6) AS mean_future_xg, ROUND(MEDIAN(d), 6) AS response_median FROM q GROUP BY ALL""",
        *BASE,
    ),
)
def ctx5(fx):
    c = contexts(fx).withColumn("d", F.round(RS, 9))
    c = durable(bin_column(c, "d", 4, fx.small, "quartile", ["action_type"]))
    return rd(X.context_description(c, ["action_type", "context", "quartile"], "d", MAIN, fx.small))


@query("ctx6_context_interaction_logit")
def ctx6(fx):
    controls = ["action_start_x", "action_delta_x", "seconds_from_previous"]
    c = durable(contexts(fx).select("match_id", "action_type", "context", RS, f"box_entry_within_{MAIN}", *controls))
    by = ["action_type"]
    found = c.groupBy(*by).agg(F.stddev_samp(RS).alias("sd"))
    for x in controls:
        found = found.join(exact_quantiles(c, by, x, {x: 0.5}, fx.small), by)
    known = {r["action_type"]: r for r in found.collect()}  # one row an action type
    groups = {a: (F.col("action_type") == a, {x: known[a][x] for x in controls}, known[a]["sd"]) for a in ("Pass", "Carry") if a in known}
    return fx.spark.createDataFrame(X.context_interaction_logits(c, RS, f"box_entry_within_{MAIN}", controls, groups), X.INTERACTION_SCHEMA)


@query("ctx7_motif_context_logit")
def ctx7(fx):
    # only what the model takes is stored: the fit goes through these rows again and again
    target = f"box_entry_within_{MAIN}"
    w = durable(motif_contexts(fx).select("match_id", "window_length", "action_type_motif", "context", target, *N.CONTROLS))
    return fx.spark.createDataFrame(X.motif_context_logit(w, target, list(N.CONTROLS), "k2"), X.INTERACTION_SCHEMA)
