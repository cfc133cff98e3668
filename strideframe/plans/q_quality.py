"""Observation-quality and eligibility queries."""

from pyspark.sql import functions as F

from strideframe.functions import points as P
from strideframe.operators import eligibility as L
from strideframe.operators import points as G
from strideframe.operators import polygons as PG
from strideframe.operators import quality as Q
from strideframe.plans.fixtures import GEO_METRICS, LONG, RPT, VAR, sql
from strideframe.plans.q_points import _ACTOR, POLY
from strideframe.plans.registry import query
from strideframe.sources.stage import durable

V = "selected_subset, goalkeeper_policy"
_B = (RPT, VAR)


def r6(df, *cols, r=6):
    return df.withColumns({c: F.round(c, r) for c in cols})


def doubles(df, r=6):
    return df.withColumns({c: F.round(c, r) for c, t in df.dtypes if t == "double"})


def clean_points(fx, *keep):
    return fx.rough.select("frame_id", *keep, F.inline(F.expr(f"filter(points, p -> {P.valid('p')})")))


_EXC = """ex AS (SELECT frame_id, match_id, event_type, i, x, y, teammate, keeper, actor, GREATEST(0, -x, x - 120) AS x_excess, GREATEST(0, -y, y - 80) AS y_excess,
 (x < 0)::INT + (x > 120)::INT + (y < 0)::INT + (y > 80)::INT AS sides_violated,
 sqrt(GREATEST(0, -x, x - 120)**2 + GREATEST(0, -y, y - 80)**2) AS pitch_distance FROM pt WHERE x IS NOT NULL)"""


@query(
    "qlt1_excursion",
    sql(
        f"""{_EXC} SELECT frame_id, i, x < 0 AS "left", x > 120 AS "right", y < 0 AS bottom, y > 80 AS top, sides_violated, ROUND(x_excess, 6) AS x_excess,
 ROUND(y_excess, 6) AS y_excess, ROUND(pitch_distance, 6) AS pitch_distance FROM ex""",
        RPT,
    ),
)
def qlt1(fx):
    out = Q.excursion(clean_points(fx)).drop("x", "y", "teammate", "keeper", "actor")
    return r6(out, "x_excess", "y_excess", "pitch_distance")


_SC = [("population", "'all'"), ("match_id", "match_id"), ("event_type", "event_type"), ("sides_violated", "sides_violated"), ("teammate", "teammate")]
_MS = ("pitch_distance", "x_excess", "y_excess")


@query(
    "qlt2_oob_summary",
    sql(
        f"""{_EXC}, sc AS ({" UNION ALL ".join(f"SELECT '{s}' AS scope, CAST({e} AS VARCHAR) AS value, * FROM ex WHERE sides_violated > 0" for s, e in _SC)}),
 fr2 AS (SELECT scope, value, COUNT(DISTINCT frame_id) AS affected_frames, COUNT(DISTINCT match_id) AS affected_matches FROM sc GROUP BY ALL),
 lg AS ({" UNION ALL ".join(f"SELECT scope, value, '{m}' AS measure, {m} AS v FROM sc" for m in _MS)})
 SELECT lg.scope, lg.value, measure, COUNT(v) AS count, ROUND(AVG(v), 6) AS mean, ROUND(MIN(v), 6) AS min, ROUND(MAX(v), 6) AS max, ROUND(MEDIAN(v), 6) AS median,
  ROUND(QUANTILE_CONT(v, 0.9), 6) AS p90, ROUND(QUANTILE_CONT(v, 0.99), 6) AS p99, ANY_VALUE(affected_frames) AS affected_frames, ANY_VALUE(affected_matches) AS affected_matches
 FROM lg JOIN fr2 ON lg.scope = fr2.scope AND lg.value IS NOT DISTINCT FROM fr2.value GROUP BY lg.scope, lg.value, measure""",
        RPT,
    ),
)
def qlt2(fx):
    pts = Q.excursion(clean_points(fx, "match_id", "event_type"))
    return doubles(Q.oob_summary(pts, dict(_SC[1:]), _MS, ["frame_id"], fx.small_frames))


@query(
    "qlt3_coincident_groups",
    sql(
        """SELECT frame_id, ROUND(x, 6) AS x, ROUND(y, 6) AS y, COUNT(*) AS group_size, COUNT(*) - 1 AS excess_records,
 COUNT(*) FILTER (teammate) AS teammate_true_count, COUNT(*) FILTER (NOT teammate) AS teammate_false_count, COUNT(*) FILTER (teammate IS NULL) AS teammate_unknown_count,
 COUNT(*) FILTER (keeper) AS keeper_true_count, COUNT(*) FILTER (NOT keeper) AS keeper_false_count, COUNT(*) FILTER (keeper IS NULL) AS keeper_unknown_count,
 COUNT(*) FILTER (actor) AS actor_true_count, COUNT(*) FILTER (NOT actor) AS actor_false_count, COUNT(*) FILTER (actor IS NULL) AS actor_unknown_count
 FROM pt WHERE x IS NOT NULL GROUP BY frame_id, pt.x, pt.y HAVING COUNT(*) > 1""",
        RPT,
    ),
)
def qlt3(fx):
    return r6(Q.coincident_groups(clean_points(fx), ["frame_id"]), "x", "y")


@query(
    "qlt4_multiplicity_impact",
    sql(
        """cg AS (SELECT frame_id, selected_subset, goalkeeper_policy, x, y FROM vp GROUP BY ALL HAVING COUNT(*) > 1),
 ad AS (SELECT frame_id, selected_subset, goalkeeper_policy, -1 AS i, x, y FROM cg),
 pp AS (SELECT v.frame_id, v.selected_subset, v.goalkeeper_policy, v.i, v.x, v.y FROM vp v SEMI JOIN cg USING (frame_id, selected_subset, goalkeeper_policy) UNION ALL SELECT * FROM ad),
 s1 AS (SELECT frame_id, selected_subset, goalkeeper_policy, COUNT(*)::DOUBLE AS point_count, AVG(x) AS centroid_x, AVG(y) AS centroid_y FROM pp GROUP BY ALL),
 s2 AS (SELECT p.frame_id, p.selected_subset, p.goalkeeper_policy, AVG(sqrt((p.x-q.x)**2+(p.y-q.y)**2)) AS mean_pair_distance, MEDIAN(sqrt((p.x-q.x)**2+(p.y-q.y)**2)) AS median_pair_distance
   FROM pp p JOIN pp q ON p.frame_id = q.frame_id AND p.selected_subset = q.selected_subset AND p.goalkeeper_policy = q.goalkeeper_policy AND p.i < q.i GROUP BY ALL),
 z AS (SELECT geo.frame_id, geo.selected_subset, geo.goalkeeper_policy, metric, CASE metric WHEN 'point_count' THEN geo.point_count WHEN 'centroid_x' THEN geo.centroid_x
    WHEN 'centroid_y' THEN geo.centroid_y WHEN 'mean_pair_distance' THEN geo.mean_pair_distance ELSE geo.median_pair_distance END AS original,
   CASE metric WHEN 'point_count' THEN s1.point_count WHEN 'centroid_x' THEN s1.centroid_x WHEN 'centroid_y' THEN s1.centroid_y
    WHEN 'mean_pair_distance' THEN s2.mean_pair_distance ELSE s2.median_pair_distance END AS changed
  FROM s1 JOIN geo USING (frame_id, selected_subset, goalkeeper_policy) LEFT JOIN s2 USING (frame_id, selected_subset, goalkeeper_policy),
   (VALUES ('point_count'), ('centroid_x'), ('centroid_y'), ('mean_pair_distance'), ('median_pair_distance')) m(metric))
 SELECT frame_id, selected_subset, goalkeeper_policy, metric, ROUND(original, 6) AS original, ROUND(changed, 6) AS one_extra_record, ROUND(changed - original, 6) AS delta FROM z""",
        *_B,
    ),
)
def qlt4(fx):
    out = Q.multiplicity_impact(G.point_variants(fx.rough), ["frame_id", *G.VARIANT])
    out = out.where(F.col("metric").isin("point_count", "centroid_x", "centroid_y", "mean_pair_distance", "median_pair_distance"))
    out = out.select("frame_id", *G.VARIANT, "metric", "original", "one_extra_record", "delta")
    return r6(out, "original", "one_extra_record", "delta")


def framed(fx):
    """Snapshots with polygon measures, actor status and link status."""
    f = PG.polygon_inspect(fx.rough, "visible_area")
    return f.withColumns(
        {
            "actor_status": F.expr(G.actor_status()),
            # equal areas must tie exactly, whatever the clipping order
            "visible_area_fraction": F.round("visible_area_fraction", 9),
            "event_join_status": F.expr("CASE WHEN frame_id % 10 = 9 THEN 'ambiguous' ELSE 'unique' END"),
        }
    ).drop("__edges", "visible_area")


def geometry(fx):
    return L.prepare(G.frame_geometry(framed(fx)), ["frame_id"])


CTX = ["frame_id", "match_id", "event_type", "n_valid_points_used", "visible_area_fraction", "n_out_of_bounds_points",
       "n_coincident_records", "frame_oob", "frame_coincident", "frame_oob_unknown", "frame_coincident_unknown", "actor_status", "event_join_status"]


def rows(fx):
    return G.metric_rows(geometry(fx), [*CTX, *G.VARIANT])


PREP = f"""{LONG}, {POLY}, {_ACTOR}, fl AS (SELECT frame_id, COALESCE(n_out_of_bounds_points > 0, FALSE) AS frame_oob, COALESCE(n_coincident_records > 0, FALSE) AS frame_coincident,
  n_out_of_bounds_points IS NULL AS frame_oob_unknown, n_coincident_records IS NULL AS frame_coincident_unknown FROM geo WHERE selected_subset = 'all_visible' AND goalkeeper_policy = 'included'),
 fa AS (SELECT frame_id, ROUND(area_inside_pitch / 9600, 9) AS visible_area_fraction FROM pg),
 pr AS (SELECT gl.*, fl.* EXCLUDE (frame_id), fa.visible_area_fraction, ac.actor_status, CASE WHEN frame_id % 10 = 9 THEN 'ambiguous' ELSE 'unique' END AS event_join_status
  FROM gl JOIN fl USING (frame_id) JOIN fa USING (frame_id) JOIN ac USING (frame_id))"""


def qedges(col, k, src):
    return "list_sort(list_distinct([" + ", ".join(f"QUANTILE_CONT({col}, {i / k})" for i in range(k + 1)) + "]))"


@query(
    "qlt5_quantile_bins",
    sql(
        f"""{POLY}, f AS (SELECT frame_id, ROUND(area_inside_pitch / 9600, 9) AS v FROM pg), e AS (SELECT {qedges('v', 5, 'f')} AS e FROM f)
 SELECT frame_id, CASE WHEN v IS NULL THEN 'unavailable' ELSE 'B' || GREATEST(1, len(list_filter(e, lambda z: z < v))) END AS area_bin FROM f, e""",
        RPT,
    ),
)
def qlt5(fx):
    return Q.bin_column(framed(fx).select("frame_id", "visible_area_fraction"), "visible_area_fraction", 5, fx.small_frames, "area_bin", prefix="B").select("frame_id", "area_bin")


@query(
    "qlt6_metric_by_bin",
    sql(
        f"""{PREP}, w AS (SELECT * FROM pr WHERE metric IN ('width', 'depth')), e AS (SELECT {V}, metric, {qedges('n_valid_points_used', 5, 'w')} AS e FROM w GROUP BY ALL),
 b AS (SELECT w.*, CASE WHEN n_valid_points_used IS NULL THEN 'unavailable' ELSE 'Q' || GREATEST(1, len(list_filter(e, lambda z: z < n_valid_points_used))) END AS bin FROM w JOIN e USING ({V}, metric))
 SELECT {V}, metric, bin, COUNT(*) AS n_rows, COUNT(value) AS count, ROUND(AVG(value), 6) AS mean, ROUND(STDDEV_SAMP(value), 6) AS std, ROUND(MIN(value), 6) AS min, ROUND(MAX(value), 6) AS max,
  ROUND(QUANTILE_CONT(value, 0.25), 6) AS p25, ROUND(MEDIAN(value), 6) AS median, ROUND(QUANTILE_CONT(value, 0.75), 6) AS p75 FROM b GROUP BY ALL""",
        *_B,
    ),
)
def qlt6(fx):
    r = rows(fx).where("metric IN ('width', 'depth')")
    return doubles(Q.metric_by_bin(r, [*G.VARIANT, "metric"], "n_valid_points_used", 5, fx.small_frames))


_MAJOR = "('width', 'depth', 'hull_area', 'mean_pair_distance', 'mean_nearest_distance')"


@query(
    "qlt7_tail_profile",
    sql(
        f"""{PREP}, w AS (SELECT * FROM pr WHERE metric IN {_MAJOR} AND value IS NOT NULL),
 c AS (SELECT {V}, metric, QUANTILE_CONT(value, 0.01) AS lo, QUANTILE_CONT(value, 0.99) AS hi FROM w GROUP BY ALL),
 t AS (SELECT w.*, 'lower_1_percent' AS tail FROM w JOIN c USING ({V}, metric) WHERE value <= lo UNION ALL SELECT w.*, 'upper_1_percent' FROM w JOIN c USING ({V}, metric) WHERE value >= hi
  UNION ALL SELECT w.*, 'all_defined' FROM w)
 SELECT {V}, metric, tail, COUNT(*) AS n_rows, ROUND(AVG((n_out_of_bounds_points > 0)::INT), 6) AS out_of_bounds_fraction, ROUND(AVG((n_coincident_records > 0)::INT), 6) AS coincident_fraction,
  ROUND(MEDIAN(value), 6) AS value_median, ROUND(MEDIAN(n_valid_points_used), 6) AS n_valid_points_used_median, ROUND(MEDIAN(visible_area_fraction), 6) AS visible_area_fraction_median FROM t GROUP BY ALL""",
        *_B,
    ),
)
def qlt7(fx):
    r = rows(fx).where(f"metric IN {_MAJOR}")
    shares = {"out_of_bounds": F.col("n_out_of_bounds_points") > 0, "coincident": F.col("n_coincident_records") > 0}
    return doubles(Q.tail_profile(r, [*G.VARIANT, "metric"], ["n_valid_points_used", "visible_area_fraction"], shares, fx.small_frames))


@query(
    "qlt8_extreme_rows",
    sql(
        f"""{LONG}, w AS (SELECT *, ROUND(value, 6) AS rv FROM gl WHERE value IS NOT NULL AND metric IN {_MAJOR}),
 r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {V}, metric ORDER BY rv, frame_id) AS a, ROW_NUMBER() OVER (PARTITION BY {V}, metric ORDER BY rv DESC, frame_id) AS b FROM w)
 SELECT {V}, metric, 'minimum' AS tail, rv AS value, frame_id FROM r WHERE a = 1 UNION ALL SELECT {V}, metric, 'maximum', rv, frame_id FROM r WHERE b = 1""",
        *_B,
    ),
)
def qlt8(fx):
    r = r6(G.metric_rows(G.frame_geometry(fx.rough), ["frame_id", *G.VARIANT]).where(f"metric IN {_MAJOR}"), "value")
    return Q.extreme_rows(r, [*G.VARIANT, "metric"], ["frame_id"])


RULES = {
    "largest_excursion_count": ("n_out_of_bounds_points > 0", "-n_out_of_bounds_points"),
    "lowest_coverage": ("true", "visible_area_fraction"),
    "highest_coverage": ("true", "-visible_area_fraction"),
    "low_count": ("true", "n_valid_points_used"),
    "high_count": ("true", "-n_valid_points_used"),
    "multiple_actor": ("actor_status = 'multiple'", "frame_id"),
    "coincident_example": ("n_coincident_records > 0", "frame_id"),
}


@query(
    "qlt9_representatives",
    sql(
        f"""{POLY}, {_ACTOR}, b AS (SELECT geo.*, ROUND(area_inside_pitch / 9600, 9) AS visible_area_fraction, actor_status FROM geo JOIN pg USING (frame_id) JOIN ac USING (frame_id)
   WHERE selected_subset = 'all_visible' AND goalkeeper_policy = 'included'),
 s AS ({" UNION ALL ".join(f"SELECT '{n}' AS selection_rule, ({e})::DOUBLE AS score, frame_id FROM b WHERE {c} AND ({e}) IS NOT NULL" for n, (c, e) in RULES.items())})
 SELECT selection_rule, score, frame_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY selection_rule ORDER BY score, frame_id) AS rn FROM s) WHERE rn = 1""",
        *_B,
    ),
)
def qlt9(fx):
    g = G.support_counts(G.point_variants(framed(fx))).where("selected_subset = 'all_visible' AND goalkeeper_policy = 'included'")
    return Q.representatives(g, RULES, ["frame_id"])


@query(
    "qlt10_count_coverage_support",
    sql(
        f"""{PREP}, e AS (SELECT {qedges('visible_area_fraction', 5, 'fa')} AS e FROM fa),
 b AS (SELECT pr.*, CASE WHEN visible_area_fraction IS NULL THEN 'unavailable' ELSE 'B' || GREATEST(1, len(list_filter(e, lambda z: z < visible_area_fraction))) END AS area_bin FROM pr, e)
 SELECT {V}, n_valid_points_used, area_bin, metric, COUNT(DISTINCT frame_id) AS frames, COUNT(DISTINCT match_id) AS matches, COUNT(value) AS defined, ROUND(MEDIAN(value), 6) AS median FROM b GROUP BY ALL""",
        *_B,
    ),
)
def qlt10(fx):
    return r6(Q.count_coverage_support(geometry(fx), framed(fx).select("visible_area_fraction"), 5, fx.small_frames), "median")


# --- eligibility grid --------------------------------------------------------------------


@query(
    "cal1_prepare",
    sql(f"{PREP} SELECT DISTINCT frame_id, {V}, frame_oob, frame_coincident, frame_oob_unknown, frame_coincident_unknown FROM pr", *_B),
)
def cal1(fx):
    g = L.prepare(G.support_counts(G.point_variants(fx.rough)), ["frame_id"])
    return g.select("frame_id", *G.VARIANT, "frame_oob", "frame_coincident", "frame_oob_unknown", "frame_coincident_unknown")


THR = f"""nr AS (SELECT {V}, n_valid_points_used AS n, ROW_NUMBER() OVER (PARTITION BY {V} ORDER BY n_valid_points_used) AS rn, COUNT(*) OVER (PARTITION BY {V}) AS c
   FROM geo WHERE n_valid_points_used IS NOT NULL),
 th AS (SELECT {V}, 'count' AS variable, q AS quantile, MAX(n)::DOUBLE AS threshold FROM nr, (VALUES (5), (25), (50), (75)) t(q) WHERE rn = CEIL(q / 100.0 * (c - 1)) + 1 GROUP BY ALL
  UNION ALL SELECT 'all', 'both', 'area', q, QUANTILE_CONT(visible_area_fraction, 0.2) FROM fa, (VALUES (20)) t(q) GROUP BY q
  UNION ALL SELECT 'all', 'both', 'area', q, QUANTILE_CONT(visible_area_fraction, 0.4) FROM fa, (VALUES (40)) t(q) GROUP BY q
  UNION ALL SELECT 'all', 'both', 'area', q, QUANTILE_CONT(visible_area_fraction, 0.6) FROM fa, (VALUES (60)) t(q) GROUP BY q
  UNION ALL SELECT 'all', 'both', 'area', q, QUANTILE_CONT(visible_area_fraction, 0.8) FROM fa, (VALUES (80)) t(q) GROUP BY q)"""
_MUL = ", ".join(f"'{m}'" for m in L.MULTIPLICITY)
_OBM = ", ".join(f"'{m}'" for m in L.OOB_METRICS)
#: fixed values: the reviewed candidates
CANDIDATES = [
    ("A", "A", "A", 0, None, None, "none", False, False),
    ("B_q05", "B", "A", 1, 5, None, "none", False, False),
    ("B_q25", "B", "A", 2, 25, None, "none", False, False),
    ("B_q50", "B", "A", 3, 50, None, "none", False, False),
    ("B_q75", "B", "A", 4, 75, None, "none", False, False),
    ("C_q20", "C", "A", 5, None, 20, "none", False, False),
    ("C_q40", "C", "A", 6, None, 40, "none", False, False),
    ("C_q60", "C", "A", 7, None, 60, "none", False, False),
    ("C_q80", "C", "A", 8, None, 80, "none", False, False),
    ("D_primary", "D", "D_primary", 9, None, None, "none", True, False),
    ("D_sensitivity", "D", "D_primary", 10, None, None, "metric", True, True),
    ("E_q25_q20", "E", "D_primary", 11, 25, 20, "all", True, False),
    ("E_q50_q40", "E", "D_primary", 12, 50, 40, "all", True, False),
    ("OOB_A", "OOB", "A", 13, None, None, "none", False, False),
    ("OOB_B_primary", "OOB", "A", 14, None, None, "none", False, False),
    ("OOB_B_sensitivity", "OOB", "OOB_B_primary", 15, None, None, "oob", False, False),
    ("OOB_C_primary", "OOB", "A", 16, None, None, "none", False, False),
    ("OOB_C_sensitivity", "OOB", "OOB_C_primary", 17, None, None, "metric_oob", False, False),
    ("coincidence_sensitivity", "coincidence", "A", 18, None, None, "coincidence", False, False),
    ("actor_unique", "actor", "A", 19, None, None, "unique_actor", False, False),
]
_CAND_TYPES = (
    "candidate string, family string, paired_primary string, position int, count_quantile int, area_quantile int, "
    "anomaly_policy string, actor_clear boolean, metric_count boolean"
)


def candidates(fx):
    return fx.spark.createDataFrame(CANDIDATES, _CAND_TYPES)


_CAND = ", ".join(
    "(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).upper() for x in row) + ")" for row in CANDIDATES
)
RULE = f"""cd AS (SELECT * FROM (VALUES {_CAND}) t(candidate, family, paired_primary, position, cq, aq, pol, actor_clear, mc)),
 ru AS (SELECT candidate, family, paired_primary, position, m.metric, v.{V.replace(", ", ", v.")},
   CASE WHEN mc THEN CASE m.metric WHEN 'hull_area' THEN 25 WHEN 'mean_nearest_distance' THEN 5 END ELSE cq END AS count_quantile, aq AS area_quantile,
   pol IN ('oob', 'all') OR (pol IN ('metric', 'metric_oob') AND m.metric IN ({_OBM})) AS exclude_oob,
   pol = 'all' OR (pol IN ('metric', 'coincidence') AND m.metric IN ({_MUL})) AS exclude_coincidence, actor_clear, pol = 'unique_actor' AS unique_actor
  FROM cd, (SELECT DISTINCT metric FROM gl) m, variant v),
 rr AS (SELECT ru.*, n.threshold AS minimum_n, a.threshold AS minimum_area FROM ru
  LEFT JOIN th n ON n.variable = 'count' AND n.quantile = ru.count_quantile AND n.selected_subset = ru.selected_subset AND n.goalkeeper_policy = ru.goalkeeper_policy
  LEFT JOIN th a ON a.variable = 'area' AND a.quantile = ru.area_quantile)"""
JUDGE = f"""{PREP}, {THR}, {RULE}, jd AS (SELECT pr.*, rr.candidate, family, paired_primary, position, status = 'ok' AND (minimum_n IS NULL OR COALESCE(n_valid_points_used >= minimum_n, FALSE))
  AND (minimum_area IS NULL OR COALESCE(visible_area_fraction >= minimum_area, FALSE)) AND NOT (exclude_oob AND (frame_oob OR frame_oob_unknown))
  AND NOT (exclude_coincidence AND (frame_coincident OR frame_coincident_unknown)) AND (NOT actor_clear OR actor_status IN ('single', 'none'))
  AND (NOT unique_actor OR (actor_status = 'single' AND event_join_status = 'unique')) AS eligible FROM pr JOIN rr USING ({V}, metric))"""
BY = f"{V}, metric, candidate"


def grid(fx):
    columns = dict.fromkeys([*CTX, *G.VARIANT, *G.METRICS, *[f"{m}_status" for m in G.METRICS]])
    return L.Grid(durable(geometry(fx).select(*columns)), CTX, framed(fx).select("visible_area_fraction"), candidates(fx), fx.small_frames)


@query("cal2_empirical_thresholds", sql(f"{PREP}, {THR} SELECT {V}, variable, quantile, ROUND(threshold, 6) AS threshold FROM th", *_B))
def cal2(fx):
    return r6(grid(fx).thresholds, "threshold")


_RC = ["candidate", "metric", "selected_subset", "goalkeeper_policy", "exclude_oob", "exclude_coincidence", "actor_clear", "unique_actor", "minimum_n", "minimum_area"]


@query("cal3_candidate_rules", sql(f"{PREP}, {THR}, {RULE} SELECT * REPLACE (ROUND(minimum_area, 6) AS minimum_area) FROM (SELECT {', '.join(_RC)} FROM rr)", *_B))
def cal3(fx):
    return r6(grid(fx).rules.select(*_RC), "minimum_area")


@query("cal4_eligibility", sql(f"{JUDGE} SELECT {BY}, COUNT(*) AS n_rows, COUNT(*) FILTER (eligible) AS eligible, SUM(frame_id) FILTER (eligible)::BIGINT AS id_sum FROM jd GROUP BY ALL", *_B))
def cal4(fx):
    """Counts by mask first, then per candidate."""
    of = grid(fx)
    counts = of.masked.groupBy(*G.VARIANT, "metric", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("frame_id").alias("ids"))
    e = F.col("eligible")
    return L.by_candidate(counts, of.candidates).groupBy(*L.BY).agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(e, F.col("n"))), F.lit(0)).alias("eligible"), F.sum(F.when(e, F.col("ids"))).alias("id_sum")
    )


@query(
    "cal5_retention",
    sql(
        f"""{JUDGE}, m AS (SELECT {BY}, match_id, COUNT(*) AS p, COUNT(*) FILTER (status = 'ok') AS d, COUNT(*) FILTER (eligible) AS e FROM jd GROUP BY ALL)
 SELECT {BY}, SUM(p) AS population_frames, SUM(d) AS defined_frames, SUM(e) AS eligible_frames, COUNT(*) FILTER (e < p) AS affected_matches, COUNT(*) FILTER (e < d) AS filter_affected_matches,
  COUNT(*) FILTER (e > 0) AS retained_matches, MIN(e) AS minimum_retained_per_match, MEDIAN(e) AS median_retained_per_match, ROUND(100.0 * SUM(e) / SUM(p), 6) AS eligible_percent FROM m GROUP BY ALL""",
        *_B,
    ),
)
def cal5(fx):
    return r6(grid(fx).retention(), "eligible_percent")


@query(
    "cal6_composition",
    sql(
        f"""{JUDGE}, g AS (SELECT {BY}, event_type AS value, COUNT(*) AS population_frames, COUNT(*) FILTER (status = 'ok') AS defined_frames, COUNT(*) FILTER (eligible) AS eligible_frames FROM jd GROUP BY ALL),
 s AS (SELECT *, SUM(defined_frames) OVER w AS sd, SUM(eligible_frames) OVER w AS se FROM g WINDOW w AS (PARTITION BY {BY}))
 SELECT {BY}, value, population_frames, defined_frames, eligible_frames, ROUND(100.0 * eligible_frames / population_frames, 6) AS retained_percent, ROUND(defined_frames / NULLIF(sd, 0), 6) AS full_share,
  ROUND(eligible_frames / NULLIF(se, 0), 6) AS retained_share, ROUND(100 * (eligible_frames / NULLIF(se, 0) - defined_frames / NULLIF(sd, 0)), 6) AS share_change_pp FROM s""",
        *_B,
    ),
)
def cal6(fx):
    return doubles(grid(fx).composition("event_type"))


def _st(p, cond):
    q = {"median": 0.5, "p05": 0.05, "p25": 0.25, "p75": 0.75, "p95": 0.95}
    out = [f"COUNT(value) FILTER ({cond}) AS {p}_count", f"AVG(value) FILTER ({cond}) AS {p}_mean", f"STDDEV_SAMP(value) FILTER ({cond}) AS {p}_std"]
    return ", ".join(out + [f"QUANTILE_CONT(value, {v}) FILTER ({cond}) AS {p}_{n}" for n, v in q.items()])


EFF = f"""{JUDGE}, ef AS (SELECT {BY}, {_st('full', "status = 'ok'")}, {_st('retained', 'eligible')} FROM jd GROUP BY ALL)"""


@query(
    "cal7_compare_distributions",
    sql(
        f"""{EFF} SELECT {BY}, full_count, retained_count, {", ".join(f"ROUND(full_{s}, 4) AS full_{s}, ROUND(retained_{s}, 4) AS retained_{s}, ROUND(retained_{s} - full_{s}, 4) AS delta_{s}, "
 f"ROUND((retained_{s} - full_{s}) / NULLIF(ABS(full_{s}), 0), 4) AS relative_delta_{s}" for s in L.STATS)} FROM ef""",
        *_B,
    ),
)
def cal7(fx):
    return doubles(grid(fx).effects, 4)


@query(
    "cal8_threshold_stability",
    sql(
        f"""{EFF}, c AS (SELECT ef.*, f.family, f.position FROM ef JOIN (SELECT candidate, family, position FROM cd WHERE family IN ('B', 'C', 'E')
   UNION ALL SELECT 'A', x, 0 FROM (VALUES ('B'), ('C'), ('E')) t(x)) f USING (candidate)),
 l AS (SELECT *, LAG(candidate) OVER w AS previous_candidate, LAG(retained_count) OVER w AS pn, {", ".join(f"LAG(retained_{s}) OVER w AS p_{s}" for s in L.STATS)} FROM c
  WINDOW w AS (PARTITION BY {V}, metric, family ORDER BY position))
 SELECT {V}, metric, family, previous_candidate, candidate, pn - retained_count AS successive_removed, {", ".join(f"ROUND(retained_{s} - p_{s}, 4) AS successive_delta_{s}, "
 f"ROUND((retained_{s} - p_{s}) / NULLIF(ABS(p_{s}), 0), 4) AS successive_relative_{s}" for s in L.STATS)} FROM l WHERE previous_candidate IS NOT NULL""",
        *_B,
    ),
)
def cal8(fx):
    return doubles(grid(fx).stability(), 4)


@query(
    "cal9_paired_primary_join",
    sql(
        f"""{EFF}, c AS (SELECT ef.*, cd.paired_primary FROM ef JOIN cd USING (candidate))
 SELECT a.selected_subset, a.goalkeeper_policy, a.metric, a.candidate, a.paired_primary, a.retained_count, b.retained_count AS primary_count,
  {", ".join(f"ROUND(a.retained_{s} - b.retained_{s}, 4) AS delta_from_primary_{s}" for s in L.STATS)}
 FROM c a JOIN ef b ON a.selected_subset = b.selected_subset AND a.goalkeeper_policy = b.goalkeeper_policy AND a.metric = b.metric AND a.paired_primary = b.candidate""",
        *_B,
    ),
)
def cal9(fx):
    return doubles(grid(fx).paired(), 4)


@query(
    "cal10_evaluate_grid",
    sql(
        f"""{EFF} SELECT {BY}, retained_count, full_count, ROUND(retained_mean, 4) AS retained_mean, ROUND(retained_median, 4) AS retained_median,
 ROUND(100.0 * retained_count / NULLIF(full_count, 0), 4) AS retained_of_defined FROM ef""",
        *_B,
    ),
)
def cal10(fx):
    e = grid(fx).effects.select(
        *L.BY, "retained_count", "full_count", "retained_mean", "retained_median",
        (100 * F.col("retained_count") / F.nullif(F.col("full_count"), F.lit(0))).alias("retained_of_defined"),
    )
    return doubles(e, 4)
