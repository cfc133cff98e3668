"""Anchors, transitions, single-action change and association models."""

from pyspark.sql import functions as F

from strideframe.operators import eligibility as L
from strideframe.operators import logistic as LG
from strideframe.operators import models as MD
from strideframe.operators import points as G
from strideframe.operators import progression as R
from strideframe.operators import transitions as T
from strideframe.operators.joins import exact_join, reconcile_join
from strideframe.operators.ordered import number
from strideframe.operators.quality import bin_column
from strideframe.operators.quantiles import exact_quantiles
from strideframe.plans.fixtures import EV, OWN, OWN_EV, RICH, RPT, VAR, sql
from strideframe.plans.q_outcomes import HORIZONS, LABELS, SESSION, labels
from strideframe.plans.q_progression import STATE, state, state_stream
from strideframe.plans.q_points import _ACTOR, POLY
from strideframe.plans.q_quality import framed
from strideframe.plans.registry import query
from strideframe.sources.stage import durable

MET = ("point_count", "centroid_x", "width", "hull_area")
RESP = ("opp_centroid_x", "opp_width", "own_centroid_x", "opp_point_count")
FLAGS = ("frame_oob", "frame_oob_unknown", "frame_coincident", "frame_coincident_unknown")
S = ", ".join(SESSION)
W = f"(PARTITION BY {S} ORDER BY event_index)"
GAPS = {"gap_le_5": 5 * 3600.0, "gap_le_3": 3 * 3600.0}
MAIN = "6h"


def lane(fx):
    return fx.lane(*SESSION)


def members(fx):
    return number(T.event_context(fx.own), lane(fx), "member_order")


def anchors(fx):
    """Trusted anchors of own possessions with side-mapped geometry and order."""
    g = L.prepare(G.frame_geometry(framed(fx)), ["frame_id"])
    wide = T.wide_geometry(g, "frame_id", MET, ["visible_area_fraction", "actor_status", *FLAGS])
    a = members(fx).where("validated_anchor").withColumns(
        {
            "frame_id": F.col("event_id") % fx.n_frames,
            "semantics_status": F.expr("CASE WHEN k % 37 = 36 THEN 'unsupported' ELSE 'validated' END"),
            "orientation_status": F.expr(
                f"CASE WHEN k % 41 = 40 THEN 'unsupported' WHEN event_team_id = {OWN} THEN 'identity_explicit' ELSE 'rotated_180' END"
            ),
        }
    )
    return T.anchor_order(T.attach_geometry(a, wide, "frame_id", MET, OWN), lane(fx))


def transitions(fx, a=None):
    return T.transitions(anchors(fx) if a is None else a, lane(fx), RESP, FLAGS)


def actions(fx):
    return T.action_inventory(state_stream(fx), state(fx))


def chosen(fx):
    a = anchors(fx)
    return T.select_transitions(transitions(fx, a), a, actions(fx), SESSION, OWN)


def eligible(fx):
    return chosen(fx).where("selection_reason = 'eligible'")


def _side(side, m):
    if side == "all":
        return f"g.all_{m}"
    t, f = ("t", "f") if side == "own" else ("f", "t")
    return f"CASE WHEN event_team_id = {OWN} THEN g.{t}_{m} ELSE g.{f}_{m} END"


def _value(side, m):
    v = _side(side, m)
    return f"CASE WHEN event_team_id = {OWN} THEN ({v}) ELSE 120 - ({v}) END" if m == "centroid_x" else v


_WIDE = ", ".join(
    f"MAX({m}) FILTER (selected_subset = '{s}' AND goalkeeper_policy = 'excluded') AS {p}_{m}"
    for s, p in (("all_visible", "all"), ("teammate_true", "t"), ("teammate_false", "f"))
    for m in (*MET, "n_valid_points_used")
)
ANCH = f"""{POLY}, {_ACTOR}, gw AS (SELECT frame_id, {_WIDE}, BOOL_OR(available) AS av,
   COALESCE(MAX(n_out_of_bounds_points) FILTER (selected_subset = 'all_visible' AND goalkeeper_policy = 'included') > 0, FALSE) AS frame_oob, NOT BOOL_OR(available) AS frame_oob_unknown,
   COALESCE(MAX(n_coincident_records) FILTER (selected_subset = 'all_visible' AND goalkeeper_policy = 'included') > 0, FALSE) AS frame_coincident, NOT BOOL_OR(available) AS frame_coincident_unknown
   FROM geo GROUP BY frame_id),
 mem AS (SELECT *, ROW_NUMBER() OVER {W} AS member_order FROM own),
 an0 AS (SELECT m.*, CASE WHEN k % 37 = 36 THEN 'unsupported' ELSE 'validated' END AS semantics_status,
   CASE WHEN k % 41 = 40 THEN 'unsupported' WHEN event_team_id = {OWN} THEN 'identity_explicit' ELSE 'rotated_180' END AS orientation_status,
   frame_oob, frame_oob_unknown, frame_coincident, frame_coincident_unknown, actor_status, ROUND(area_inside_pitch / 9600, 9) AS visible_area_fraction,
   {", ".join(f"{_value(s, m)} AS {s}_{m}" for s in T.SIDES for m in MET)}, {", ".join(f"{_side(s, 'n_valid_points_used')} AS {s}_n" for s in T.SIDES)}
  FROM mem m JOIN gw g ON g.frame_id = event_id % (SELECT COUNT(*) FROM embeddings) JOIN ac ON ac.frame_id = g.frame_id JOIN pg ON pg.frame_id = g.frame_id WHERE validated_anchor),
 anc AS (SELECT *, {", ".join(f"{s}_{m} IS NOT NULL AND actor_status IN ('single', 'none') AS {s}_{m}_available" for s in T.SIDES for m in MET)},
   ROW_NUMBER() OVER w AS anchor_order, LAG(event_id) OVER w AS previous_anchor_id, LEAD(event_id) OVER w AS next_anchor_id,
   (t_us - LAG(t_us) OVER w) / 1e6 AS seconds_from_previous, member_order - LAG(member_order) OVER w AS events_from_previous,
   member_order - LAG(member_order) OVER w - 1 AS intervening_events FROM an0 WINDOW w AS {W})"""
TRANS = f"""{ANCH}, tr AS (SELECT {S}, event_id AS to_event_id, event_index AS to_event_index, event_type AS to_event_type, event_team_id AS to_event_team_id, anchor_order AS to_anchor_order,
   LAG(event_id) OVER w AS from_event_id, LAG(event_index) OVER w AS from_event_index, LAG(event_type) OVER w AS from_event_type, LAG(event_team_id) OVER w AS from_event_team_id,
   {", ".join(f"{f} AS to_{f}, LAG({f}) OVER w AS from_{f}" for f in FLAGS)}, semantics_status AS tv, LAG(semantics_status) OVER w AS fv, orientation_status AS tro, LAG(orientation_status) OVER w AS fro,
   seconds_from_previous, events_from_previous, intervening_events,
   {", ".join(f"CASE WHEN {r}_available AND LAG({r}_available) OVER w THEN {r} - LAG({r}) OVER w END AS delta_{r}, CASE WHEN {r}_available AND LAG({r}_available) OVER w THEN 'ok' WHEN NOT {r}_available AND NOT LAG({r}_available) OVER w THEN 'both_endpoints_unavailable' WHEN {r}_available THEN 'from_endpoint_unavailable' ELSE 'to_endpoint_unavailable' END AS delta_{r}_status" for r in RESP)}
  FROM anc WINDOW w AS {W}), trn AS (SELECT * FROM tr WHERE from_event_id IS NOT NULL)"""
ACTI = f"""{STATE}, ai AS (SELECT q.match_id, q.event_id, CASE WHEN NOT (q.event_team_id = {OWN} AND q.event_type IN ('Pass', 'Carry')) THEN 'not_own_pass_carry'
   WHEN NOT q.safe THEN CASE WHEN NOT q.validated_anchor THEN 'unsupported_or_unlinked_frame' ELSE 'missing_or_invalid_endpoint' END
   WHEN s.event_id IS NULL THEN 'failed_or_unknown_pass_endpoint' WHEN s.restart THEN 'inherited_restart_context' WHEN COALESCE(s.affected, FALSE) THEN 'inherited_relocation_affected'
   ELSE 'eligible' END AS action_status, CASE WHEN q.safe THEN q.start_x END AS action_start_x, CASE WHEN q.safe THEN q.end_x END AS action_end_x,
   CASE WHEN q.safe THEN q.end_x - q.start_x END AS action_delta_x FROM q0 q LEFT JOIN stt s ON s.event_id = q.event_id)"""
SEL = f"""{TRANS}, {ACTI}, sel AS (SELECT trn.*, from_event_type AS action_type, action_status, action_start_x, action_end_x, action_delta_x,
   CASE WHEN action_start_x >= 0 AND action_start_x < 40 THEN 'defensive_third' WHEN action_start_x >= 40 AND action_start_x < 80 THEN 'middle_third'
    WHEN action_start_x BETWEEN 80 AND 120 THEN 'attacking_third' ELSE 'outside_pitch' END AS starting_third,
   CASE WHEN from_event_team_id <> {OWN} THEN 'opponent_from_anchor' WHEN from_event_type NOT IN ('Pass', 'Carry') THEN 'not_pass_carry_from_anchor'
    WHEN fv <> 'validated' OR tv <> 'validated' THEN 'unsupported_semantics' WHEN fro <> 'identity_explicit' OR tro = 'unsupported' THEN 'invalid_orientation'
    WHEN action_status <> 'eligible' THEN action_status ELSE 'eligible' END AS selection_reason FROM trn LEFT JOIN ai ON ai.event_id = trn.from_event_id),
 el AS (SELECT * FROM sel WHERE selection_reason = 'eligible')"""
BASE = (EV, RICH, OWN_EV, RPT, VAR)


def rd(df, r=6):
    return df.withColumns({c: F.round(c, r) for c, t in df.dtypes if t == "double"})


# --- spatial-state sequences ---------------------------------------------------------------


@query("sps1_event_context", sql(f"SELECT {S}, event_id, event_index, event_type, member_order FROM (SELECT *, ROW_NUMBER() OVER {W} AS member_order FROM own)", EV, OWN_EV))
def sps1(fx):
    return members(fx).select(*SESSION, "event_id", "event_index", "event_type", "member_order")


@query(
    "sps2_attach_membership",
    sql(
        """SELECT (SELECT COUNT(*) FROM own WHERE k % 50 <> 49) AS both, (SELECT COUNT(*) FROM own WHERE k % 50 = 49) AS left_only, 0 AS right_only,
 0 AS event_type_mismatch, (SELECT COUNT(*) FROM own WHERE k % 50 = 48) AS seconds_mismatch""",
        EV, OWN_EV,
    ),
)
def sps2(fx):
    left = fx.own.selectExpr("match_id", "event_index", "event_type", "t_us / 1e6D AS seconds")
    right = fx.own.where("k % 50 <> 49").selectExpr(
        "match_id", "event_index", "event_type", "t_us / 1e6D + CASE WHEN k % 50 = 48 THEN 1D ELSE 0D END AS seconds"
    )
    check = ["event_type", "seconds"]
    j = exact_join(left, right, ["match_id", "event_index"], validate="one_to_one", check=check, tolerance={"seconds": 1e-9})
    return reconcile_join(j, check)


_A3 = [f"{s}_{m}" for s in T.SIDES for m in MET]


@query(
    "sps3_attach_geometry",
    sql(
        f"{ANCH} SELECT event_id, {', '.join(f'ROUND({c}, 6) AS {c}, {c}_available' for c in _A3)}, {', '.join(f'{s}_n' for s in T.SIDES)} FROM anc",
        EV, OWN_EV, RPT, VAR,
    ),
)
def sps3(fx):
    return rd(anchors(fx).select("event_id", *_A3, *[f"{c}_available" for c in _A3], *[f"{s}_n" for s in T.SIDES]))


_A4 = ["event_id", "anchor_order", "previous_anchor_id", "next_anchor_id", "seconds_from_previous", "events_from_previous", "intervening_events"]


@query("sps4_anchor_order", sql(f"{ANCH} SELECT {', '.join(_A4)} FROM anc", EV, OWN_EV, RPT, VAR))
def sps4(fx):
    a = members(fx).where("validated_anchor")
    return T.anchor_order(a, lane(fx)).select(*_A4)


_T5 = ["from_event_id", "to_event_id", "seconds_from_previous", "events_from_previous", *[f"delta_{r}_status" for r in RESP]]


@query(
    "sps5_transitions",
    sql(f"{TRANS} SELECT {', '.join(_T5)}, {', '.join(f'ROUND(delta_{r}, 6) AS delta_{r}' for r in RESP)} FROM trn", EV, OWN_EV, RPT, VAR),
)
def sps5(fx):
    return rd(transitions(fx).select(*_T5, *[f"delta_{r}" for r in RESP]))


@query(
    "sps6_spell_readiness",
    sql(
        f"""{ANCH}, s AS (SELECT {S}, COUNT(*) AS event_count FROM own GROUP BY {S}),
 a AS (SELECT {S}, COUNT(*) AS anchor_count, COUNT(*) FILTER (event_team_id = {OWN}) AS own_anchor_count, MAX(seconds_from_previous) AS max_gap, arg_min(event_id, anchor_order) AS first_anchor_id,
  arg_max(event_id, anchor_order) AS last_anchor_id, COUNT(*) FILTER (opp_centroid_x_available) AS opp_centroid_x_available_count, MEDIAN(seconds_from_previous) AS median_gap,
  QUANTILE_CONT(seconds_from_previous, 0.9) AS p90_gap FROM anc GROUP BY {S})
 SELECT s.*, COALESCE(anchor_count, 0) AS anchor_count, COALESCE(own_anchor_count, 0) AS own_anchor_count, ROUND(max_gap, 4) AS max_gap, first_anchor_id, last_anchor_id,
  COALESCE(opp_centroid_x_available_count, 0) AS opp_centroid_x_available_count, ROUND(median_gap, 4) AS median_gap, ROUND(p90_gap, 4) AS p90_gap,
  GREATEST(COALESCE(anchor_count, 0) - 1, 0) AS transition_count, ROUND(COALESCE(anchor_count, 0) / event_count, 4) AS anchor_proportion, COALESCE(anchor_count, 0) >= 3 AS has_3_plus
 FROM s LEFT JOIN a USING ({S})""",
        EV, OWN_EV, RPT, VAR,
    ),
)
def sps6(fx):
    sessions = fx.own.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("event_count"))
    return rd(T.spell_readiness(sessions, anchors(fx), SESSION, OWN, ["opp_centroid_x"], fx.small), 4)


@query(
    "sps7_interval_reconcile",
    sql(
        f"""a AS (SELECT match_id, period, possession_id, event_id, event_index, CASE WHEN k % 29 <> 28 THEN event_index // 12 END AS sub FROM own WHERE validated_anchor),
 b AS (SELECT match_id, LAG(event_id) OVER {W} AS f, event_id AS t FROM a), c AS (SELECT match_id, LAG(event_id) OVER (PARTITION BY {S}, sub ORDER BY event_index) AS f, event_id AS t FROM a WHERE sub IS NOT NULL),
 g AS (SELECT b.* FROM b WHERE f IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c WHERE c.f = b.f AND c.t = b.t)),
 n AS (SELECT c.* FROM c WHERE f IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b WHERE c.f = b.f AND c.t = b.t))
 SELECT CASE WHEN x.sub IS NULL OR y.sub IS NULL THEN 'missing_endpoint' WHEN x.sub <> y.sub THEN 'different_session' ELSE 'unexplained' END AS cause, COUNT(*) AS pairs
 FROM g JOIN a x ON x.event_id = g.f JOIN a y ON y.event_id = g.t GROUP BY 1 UNION ALL SELECT 'new_pair', COUNT(*) FROM n HAVING COUNT(*) > 0""",
        EV, OWN_EV,
    ),
)
def sps7(fx):
    from strideframe.operators.ordered import shift

    a = fx.own.where("validated_anchor").withColumn("sub", F.expr("CASE WHEN k % 29 <> 28 THEN CAST(floor(event_index / 12) AS BIGINT) END"))
    pair = lambda df, ln: shift(df, ln, {"from_event_id": "event_id"}).where("from_event_id IS NOT NULL").withColumn("to_event_id", F.col("event_id"))
    return T.interval_reconcile(pair(a, lane(fx)), pair(a.where("sub IS NOT NULL"), fx.lane(*SESSION, "sub")), a, "sub")


@query(
    "sps8_availability_tables",
    sql(
        f"""{ANCH}, u AS ({" UNION ALL ".join(f"SELECT '{s}_{m}' AS response, {s}_{m} IS NOT NULL AS has, {s}_{m}_available AS available FROM anc" for s in ("own", "opp") for m in ("centroid_x", "hull_area"))}),
 c AS (SELECT response, has, available, COUNT(*) AS anchors FROM u GROUP BY response, has, available)
 SELECT *, ROUND(100.0 * anchors / SUM(anchors) OVER (PARTITION BY response), 3) AS percentage FROM c""",
        EV, OWN_EV, RPT, VAR,
    ),
)
def sps8(fx):
    t = T.availability_tables(anchors(fx), [f"{s}_{m}" for s in ("own", "opp") for m in ("centroid_x", "hull_area")])
    g = t.groupBy("response", (F.col("status") == "ok").alias("has"), "available").agg(F.sum("anchors").alias("anchors"), F.sum("percentage").alias("percentage"))
    return rd(g, 3)


# --- single-action change ------------------------------------------------------------------


@query("mod1_action_inventory", sql(f"{ACTI} SELECT event_id, action_status, action_start_x, action_end_x, action_delta_x FROM ai", EV, RICH))
def mod1(fx):
    return actions(fx).drop("match_id")


@query(
    "mod2_select_transitions",
    sql(f"{SEL} SELECT from_event_id, to_event_id, selection_reason, action_delta_x, starting_third FROM sel", *BASE),
)
def mod2(fx):
    return chosen(fx).select("from_event_id", "to_event_id", "selection_reason", "action_delta_x", "starting_third")


_NOF = lambda f: f"NOT (from_frame_{f} OR from_frame_{f}_unknown OR to_frame_{f} OR to_frame_{f}_unknown)"
_MASK = {
    "all": "TRUE", "gap_le_5": "seconds_from_previous <= 18000", "gap_le_3": "seconds_from_previous <= 10800",
    "to_own": f"to_event_team_id = {OWN}", "exclude_oob": _NOF("oob"), "exclude_coincidence": _NOF("coincident"),
}
SCOPED = "sc AS (" + " UNION ALL ".join(f"SELECT *, '{n}' AS scope FROM el WHERE {c}" for n, c in _MASK.items()) + ")"


@query("mod3_scope_mask", sql(f"{SEL}, {SCOPED} SELECT scope, action_type, COUNT(*) AS n FROM sc GROUP BY ALL", *BASE))
def mod3(fx):
    return T.in_scopes(eligible(fx), T.scope_masks(GAPS, OWN)).groupBy("scope", "action_type").agg(F.count(F.lit(1)).alias("n"))


LINE = """li AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS y, l_quantity AS x, o_custkey AS g FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(
    "mod4_ols_cr1",
    sql(
        f"""{LINE}, m AS (SELECT l_returnflag, l_linestatus, COUNT(*) AS n, AVG(x) AS mx, AVG(y) AS my, regr_slope(y, x) AS b, regr_r2(y, x) AS r2, regr_sxx(y, x) AS sxx FROM li GROUP BY ALL),
 s AS (SELECT l_returnflag, l_linestatus, g, SUM((y - my - b * (x - mx)) * (x - mx)) AS s FROM li JOIN m USING (l_returnflag, l_linestatus) GROUP BY ALL),
 c AS (SELECT l_returnflag, l_linestatus, COUNT(*) AS cg, SUM(s * s) AS meat FROM s GROUP BY ALL)
 SELECT l_returnflag, l_linestatus, n, cg AS cluster_count, ROUND(b, 6) AS slope, ROUND(my - b * mx, 4) AS intercept, ROUND(r2, 6) AS r_squared,
  ROUND(sqrt(meat * cg / (cg - 1) * (n - 1) / (n - 2)) / sxx, 6) AS cluster_se, 'ok' AS regression_status FROM m JOIN c USING (l_returnflag, l_linestatus)""",
        "one AS (SELECT 1)",
    ),
)
def mod4(fx):
    li = fx.table("lineitem").join(fx.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = MD.ols_cr1(li, ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_quantity", "o_custkey", interval=False)
    return out.withColumns({"slope": F.round("slope", 6), "intercept": F.round("intercept", 4), "r_squared": F.round("r_squared", 6), "cluster_se": F.round("cluster_se", 6)})


@query(
    "mod5_ols_cr1_multi",
    sql(
        """li AS (SELECT l_extendedprice AS y, l_quantity AS a, l_discount AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 s AS (SELECT COUNT(*) AS n, AVG(y) AS my, AVG(a) AS ma, AVG(b) AS mb, VAR_POP(a) AS saa, VAR_POP(b) AS sbb, COVAR_POP(a, b) AS sab, COVAR_POP(a, y) AS say, COVAR_POP(b, y) AS sby FROM li),
 c AS (SELECT *, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS ba, (saa * sby - sab * say) / (saa * sbb - sab * sab) AS bb FROM s)
 SELECT 'intercept' AS term, ROUND(my - ba * ma - bb * mb, 3) AS coefficient, n FROM c UNION ALL SELECT 'l_quantity', ROUND(ba, 3), n FROM c UNION ALL SELECT 'l_discount', ROUND(bb, 3), n FROM c""",
        "one AS (SELECT 1)",
    ),
)
def mod5(fx):
    li = fx.table("lineitem").join(fx.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    fit = MD.ols_cr1_multi(li, "l_extendedprice", ["l_quantity", "l_discount"], "o_custkey")
    return fx.spark.createDataFrame(
        [(t, round(float(b), 3), fit["n"]) for t, b in zip(fit["terms"], fit["parameters"])], "term string, coefficient double, n bigint"
    )


def resp_rows(df, keep):
    return T.response_rows(df, [*keep, "action_delta_x", "match_id"], RESP)


LONGR = "lr AS (" + " UNION ALL ".join(f"SELECT *, '{r}' AS response, delta_{r} AS y, delta_{r}_status AS status FROM sc" for r in RESP) + ")"


def stat_sql(src, by):
    d = lambda c, p: ", ".join([f"QUANTILE_CONT({c}, {q}) AS {p}_{n}" for n, q in (("p25", .25), ("median", .5), ("p75", .75), ("p90", .9), ("p95", .95))] + [f"MIN({c}) AS {p}_min", f"MAX({c}) AS {p}_max"])
    on = " AND ".join(f"a.{b} = b.{b}" for b in by.split(", "))
    return f"""e0_ AS (SELECT {by}, COUNT(*) AS eligible_n, COUNT(*) FILTER (status <> 'ok') AS missing_n FROM {src} GROUP BY ALL),
 k_ AS (SELECT *, action_delta_x AS x FROM {src} WHERE status = 'ok'),
 rx_ AS (SELECT *, RANK() OVER (PARTITION BY {by} ORDER BY x) + (COUNT(*) OVER (PARTITION BY {by}, x) - 1) / 2.0 AS rx, RANK() OVER (PARTITION BY {by} ORDER BY y) + (COUNT(*) OVER (PARTITION BY {by}, y) - 1) / 2.0 AS ry FROM k_),
 m_ AS (SELECT {by}, COUNT(*) AS n, {d('x', 'x')}, {d('y', 'y')}, CASE WHEN COUNT(*) >= 3 AND MIN(x) < MAX(x) AND MIN(y) < MAX(y) THEN CORR(x, y) END AS pearson_r, CASE WHEN COUNT(*) >= 3 AND MIN(x) < MAX(x) AND MIN(y) < MAX(y) THEN CORR(rx, ry) END AS spearman_rho,
   AVG(x) AS mx, AVG(y) AS my, CASE WHEN COUNT(*) >= 3 AND MIN(x) < MAX(x) THEN COVAR_POP(x, y) / VAR_POP(x) END AS slope, VAR_POP(x) * COUNT(*) AS sxx FROM rx_ GROUP BY ALL),
 sc_ AS (SELECT a.{by.replace(', ', ', a.')}, match_id, SUM((y - my - slope * (x - mx)) * (x - mx)) AS s FROM k_ a JOIN m_ b ON {on} GROUP BY ALL),
 c_ AS (SELECT {by}, COUNT(*) AS cluster_count, SUM(s * s) AS meat FROM sc_ GROUP BY {by}),
 ms AS (SELECT e0_.*, m_.* EXCLUDE ({by}, mx, my, sxx), my - slope * mx AS intercept, cluster_count,
   CASE WHEN cluster_count >= 2 AND slope IS NOT NULL THEN sqrt(meat * cluster_count / (cluster_count - 1) * (n - 1) / (n - 2)) / sxx END AS cluster_se FROM e0_ LEFT JOIN m_ USING ({by}) LEFT JOIN c_ USING ({by}))"""


_STATC = ["x_p25", "x_median", "x_p75", "x_p90", "x_p95", "x_min", "x_max", "y_p25", "y_median", "y_p75", "y_p90", "y_p95", "y_min", "y_max",
          "pearson_r", "spearman_rho", "slope", "intercept", "cluster_se"]
_STATR = ", ".join(f"ROUND({c}, 5) AS {c}" for c in _STATC)


def stats(fx, keep, df):
    """Many consumers read the long rows, so they are stored once."""
    return T.metric_statistics(durable(resp_rows(df, keep)), [*keep, "response"], "action_delta_x", "y", "match_id", fx.small).drop("r_squared", "regression_status")


@query(
    "mod6_metric_statistics",
    sql(f"{SEL}, {SCOPED}, {LONGR}, l1 AS (SELECT * FROM lr WHERE scope = 'all'), {stat_sql('l1', 'action_type, response')} SELECT action_type, response, eligible_n, missing_n, n, cluster_count, {_STATR} FROM ms", *BASE),
)
def mod6(fx):
    return rd(stats(fx, ["action_type"], eligible(fx)), 5)


@query(
    "mod7_association_summary",
    sql(
        f"""{SEL}, {SCOPED}, {LONGR}, {stat_sql('lr', 'action_type, scope, response')}
 SELECT a.action_type, a.response, a.scope, a.n, b.n AS primary_n, ROUND(a.slope, 5) AS slope, ROUND(a.slope - b.slope, 5) AS slope_difference, ROUND(a.spearman_rho - b.spearman_rho, 5) AS rho_difference,
  SIGN(a.slope) = SIGN(b.slope) AS slope_sign_preserved FROM ms a JOIN ms b ON a.action_type = b.action_type AND a.response = b.response AND b.scope = 'all' WHERE a.scope <> 'all'""",
        *BASE,
    ),
)
def mod7(fx):
    st = durable(stats(fx, ["action_type", "scope"], T.in_scopes(eligible(fx), T.scope_masks(GAPS, OWN))))
    out = T.sensitivity(st, ["action_type", "response"])
    return rd(out.select("action_type", "response", "scope", "n", "primary_n", "slope", "slope_difference", "rho_difference", "slope_sign_preserved"), 5)


@query(
    "mod7_starting_thirds",
    sql(f"{SEL}, {SCOPED}, {LONGR}, l1 AS (SELECT * FROM lr WHERE scope = 'all'), {stat_sql('l1', 'action_type, starting_third, response')} SELECT action_type, starting_third, response, eligible_n, missing_n, n, cluster_count, {_STATR} FROM ms", *BASE),
)
def mod7b(fx):
    return rd(stats(fx, ["action_type", "starting_third"], eligible(fx)), 5)


def edges_sql(col, k):
    return "list_sort(list_distinct([" + ", ".join(f"QUANTILE_CONT({col}, {i / k})" for i in range(k + 1)) + "]))"


@query(
    "mod7_deciles",
    sql(
        f"""{SEL}, {SCOPED}, {LONGR}, e AS (SELECT action_type, {edges_sql('action_delta_x', 10)} AS e FROM el GROUP BY ALL),
 b AS (SELECT lr.*, 'D' || GREATEST(1, len(list_filter(e, lambda z: z < action_delta_x))) AS bin FROM lr JOIN e USING (action_type) WHERE scope = 'all' AND status = 'ok')
 SELECT action_type, response, bin, COUNT(*) AS count, ROUND(AVG(y), 5) AS mean, ROUND(QUANTILE_CONT(y, 0.25), 5) AS y_p25, ROUND(MEDIAN(y), 5) AS y_median, ROUND(QUANTILE_CONT(y, 0.75), 5) AS y_p75,
  ROUND(MEDIAN(action_delta_x), 5) AS x_median FROM b GROUP BY ALL""",
        *BASE,
    ),
)
def mod7c(fx):
    return rd(T.decile_profile(durable(eligible(fx)), ["action_type"], "action_delta_x", RESP, 10, fx.small), 5)


@query("mod8_sample_audit", sql(f"{SEL} SELECT selection_reason, from_event_type, COUNT(*) AS n FROM sel GROUP BY ALL", *BASE))
def mod8(fx):
    return T.sample_audit(chosen(fx))


_OUT = ["reference_is_box_entry", "reference_is_shot", *[f"{f}_{h}" for h in HORIZONS for f in ("box_entry_within", "shot_within", "future_xg")]]


def joined(fx):
    """Eligible transitions with the outcome labels of their TO anchor."""
    o = labels(fx).select(F.col("match_id").alias("__m"), F.col("event_id").alias("__e"), *_OUT)
    return eligible(fx).join(o, (F.col("match_id") == F.col("__m")) & (F.col("to_event_id") == F.col("__e")), "left").drop("__m", "__e")


JOINED = f"{SEL}, {LABELS}, jo AS (SELECT el.*, {', '.join('lab.' + c for c in _OUT)} FROM el LEFT JOIN lab ON lab.event_id = el.to_event_id)"
_XG = [f"future_xg_{h}" for h in HORIZONS]


@query(
    "mod9_join_to_outcomes",
    sql(f"{JOINED} SELECT from_event_id, to_event_id, {', '.join(f'ROUND({c}, 6) AS {c}' if c in _XG else c for c in _OUT)} FROM jo", *BASE),
)
def mod9(fx):
    return rd(joined(fx).select("from_event_id", "to_event_id", *_OUT))


_DESC = f"""COUNT(*) AS n, COUNT(DISTINCT match_id) AS match_count, SUM(box_entry_within_{MAIN}) AS box_entry_positive, ROUND(AVG(box_entry_within_{MAIN}), 6) AS box_entry_rate,
 SUM(shot_within_{MAIN}) AS shot_positive, ROUND(AVG(shot_within_{MAIN}), 6) AS shot_rate, ROUND(AVG(future_xg_{MAIN}), 6) AS mean_future_xg, COUNT(*) FILTER (future_xg_{MAIN} IS NULL) AS missing_xg"""


def describe():
    x = F.col(f"future_xg_{MAIN}")
    return [
        F.count(F.lit(1)).alias("n"), F.count_distinct("match_id").alias("match_count"),
        F.sum(f"box_entry_within_{MAIN}").alias("box_entry_positive"), F.round(F.mean(f"box_entry_within_{MAIN}"), 6).alias("box_entry_rate"),
        F.sum(f"shot_within_{MAIN}").alias("shot_positive"), F.round(F.mean(f"shot_within_{MAIN}"), 6).alias("shot_rate"),
        F.round(F.mean(x), 6).alias("mean_future_xg"), F.count_if(x.isNull()).alias("missing_xg"),
    ]


@query(
    "mod10_quartile_profile",
    sql(
        f"""{JOINED}, v AS (SELECT *, ROUND(delta_opp_centroid_x, 9) AS d FROM jo WHERE delta_opp_centroid_x IS NOT NULL), e AS (SELECT action_type, {edges_sql('d', 4)} AS e FROM v GROUP BY ALL),
 q AS (SELECT v.*, 'Q' || GREATEST(1, len(list_filter(e, lambda z: z < d))) AS quartile FROM v JOIN e USING (action_type)),
 s AS (SELECT 'all' AS scope, * FROM q UNION ALL SELECT 'exclude_immediate', * FROM q WHERE reference_is_shot = 0)
 SELECT scope, action_type, quartile, ROUND(MEDIAN(d), 6) AS median_change, {_DESC} FROM s GROUP BY ALL""",
        *BASE,
    ),
)
def mod10(fx):
    v = durable(joined(fx).where("delta_opp_centroid_x IS NOT NULL")).withColumn("d", F.round("delta_opp_centroid_x", 9))
    q = bin_column(v, "d", 4, fx.small, "quartile", ["action_type"])
    s = q.select("*", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("reference_is_shot") == 0, F.lit("exclude_immediate"))))).alias("scope"))
    by = ["scope", "action_type", "quartile"]
    return s.groupBy(*by).agg(*describe()).join(rd(exact_quantiles(s, by, "d", {"median_change": 0.5}, fx.small)), by)


@query("mod11_logit_cr1")
def mod11(fx):
    """Return flag on quantity, discount and tax over all line items, clustered by customer."""
    li = fx.table("lineitem").join(fx.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "CAST(l_returnflag = 'R' AS INT) AS returned", "l_quantity", "l_discount", "l_tax", "o_custkey"
    )
    fit = LG.logit_cr1(li, "returned", "l_quantity", ["l_discount", "l_tax"], "o_custkey")
    return LG.fits_table(fx.spark, "model string", [(("returned",), fit)])


CONTROLS = ["action_delta_x", "action_start_x", "seconds_from_previous"]


def danger_fits(data, scopes):
    """Labels and fits of every danger model; all are fitted together."""
    sds = data.groupBy("action_type").agg(*[F.stddev_samp(f"delta_{r}").alias(r) for r in RESP])
    sds = {r["action_type"]: r for r in sds.collect()}  # one row an action type
    labels, models = [], []
    for action in ("Pass", "Carry"):
        own = F.col("action_type") == action
        entry, shot = f"box_entry_within_{MAIN}", f"shot_within_{MAIN}"
        specs = [(r, entry, "all", CONTROLS, own) for r in RESP]
        specs += [(RESP[0], entry, "unadjusted", [], own), (RESP[0], shot, "all", CONTROLS, own)]
        specs += [(RESP[0], f"box_entry_within_{h}", "all", CONTROLS, own) for h in HORIZONS if h != MAIN]
        specs += [(RESP[0], entry, n, CONTROLS, own & m) for n, m in scopes.items() if n != "all"]
        specs += [(RESP[0], entry, "exclude_immediate", CONTROLS, own & (F.col("reference_is_box_entry") == 0))]
        specs += [(RESP[0], entry, "visible_count_adjustment", [*CONTROLS, "delta_opp_point_count"], own)]
        for r, target, scope, controls, where in specs:
            labels.append((action, r, target, scope))
            models.append(LG.Model(target, {c: c for c in (f"delta_{r}", *controls)}, where, sds[action][r] if action in sds else None))
    return list(zip(labels, LG.fit_logits(data, models, "match_id"), strict=True))


@query("mod12_danger_models")
def mod12(fx):
    data = durable(joined(fx).select("match_id", "action_type", "to_event_team_id", *CONTROLS, *[f"delta_{r}" for r in RESP], *_OUT, *[f"{e}_{f}" for e in ("from", "to") for f in FLAGS]))
    return LG.fits_table(fx.spark, "action_type string, spatial_metric string, target string, scope string", danger_fits(data, T.scope_masks(GAPS, OWN)))


@query("mod13_linear_contrast")
def mod13(fx):
    li = fx.table("lineitem").join(fx.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "CAST(l_returnflag = 'R' AS INT) AS returned", "l_quantity / 10 AS q", "l_discount * 10 AS d", "o_custkey"
    )
    fit = LG.logit_cr1(li, "returned", "q", ["d"], "o_custkey")
    c = LG.linear_contrast(fit, {"q": 1.0, "d": -1.0})
    return fx.spark.createDataFrame([("q_vs_d", *c.values())], "contrast string, " + ", ".join(f"{k} double" for k in c))


@query(
    "mod14_per_cluster_spearman",
    sql(
        f"""{SEL}, k AS (SELECT action_type, match_id, action_delta_x AS x, delta_opp_centroid_x AS y FROM el WHERE delta_opp_centroid_x IS NOT NULL),
 r AS (SELECT *, RANK() OVER (PARTITION BY action_type, match_id ORDER BY x) + (COUNT(*) OVER (PARTITION BY action_type, match_id, x) - 1) / 2.0 AS rx,
  RANK() OVER (PARTITION BY action_type, match_id ORDER BY y) + (COUNT(*) OVER (PARTITION BY action_type, match_id, y) - 1) / 2.0 AS ry FROM k),
 c AS (SELECT action_type, match_id, CASE WHEN MIN(x) < MAX(x) AND MIN(y) < MAX(y) THEN CORR(rx, ry) END AS rho FROM r GROUP BY ALL)
 SELECT action_type, COUNT(rho) AS clusters, ROUND(MIN(rho), 6) AS min_rho, ROUND(MAX(rho), 6) AS max_rho, ROUND(AVG((rho > 0)::INT), 6) AS share_positive, ROUND(MEDIAN(rho), 6) AS median_rho
 FROM c WHERE rho IS NOT NULL GROUP BY ALL""",
        *BASE,
    ),
)
def mod14(fx):
    return rd(T.per_cluster_spearman(durable(eligible(fx).select("action_type", "match_id", "action_delta_x", "delta_opp_centroid_x")), ["action_type"], "match_id", "action_delta_x", "delta_opp_centroid_x", fx.small))


@query(
    "mod15_population_tables",
    sql(f"{JOINED} SELECT 'all' AS population, {_DESC}, SUM(reference_is_box_entry) AS immediate_entries, SUM(reference_is_shot) AS immediate_shots FROM jo "
        f"UNION ALL SELECT action_type, {_DESC}, SUM(reference_is_box_entry), SUM(reference_is_shot) FROM jo GROUP BY action_type", *BASE),
)
def mod15(fx):
    rows = joined(fx).select("*", F.explode(F.array(F.lit("all"), F.col("action_type"))).alias("population"))
    return rows.groupBy("population").agg(*describe(), F.sum("reference_is_box_entry").alias("immediate_entries"), F.sum("reference_is_shot").alias("immediate_shots"))
