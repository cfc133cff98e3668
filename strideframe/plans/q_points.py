"""Snapshot geometry and polygon queries."""

from pyspark.sql import functions as F

from strideframe.functions import points as P
from strideframe.operators import points as G
from strideframe.operators import polygons as PG
from strideframe.plans.fixtures import GEO_METRICS, LONG, RPT, VAR, _status_sql, sql
from strideframe.plans.registry import query

FV = ["frame_id", *G.VARIANT]
V = "frame_id, selected_subset, goalkeeper_policy"
COUNTS = [
    "n_valid_points_used", "n_unique_points", "n_coincident_records", "n_out_of_bounds_points",
    "n_keeper_true_before_filter", "n_keeper_unknown_before_filter", "n_keeper_true_excluded", "n_keeper_unknown_excluded",
]


def variants(fx):
    return G.support_counts(G.point_variants(fx.rough))


def geometry(fx):
    return G.frame_geometry(fx.rough)


def rows(fx, keep=()):
    return G.metric_rows(geometry(fx), [*FV, *keep])


def r6(df, *cols, r=6):
    return df.withColumns({c: F.round(c, r) for c in cols})


@query("geo1_point_variants", sql(f"SELECT {V}, n_valid_points_used FROM geo", RPT, VAR))
def geo1(fx):
    return variants(fx).select(*FV, "n_valid_points_used")


def _metric_query(name, metrics):
    cols = ", ".join(f"ROUND({m}, 6) AS {m}, {_status_sql(m)} AS {m}_status" for m in metrics)

    @query(name, sql(f"SELECT {V}, {cols} FROM geo", RPT, VAR))
    def run(fx):
        g = geometry(fx).select(*FV, *[c for m in metrics for c in (m, f"{m}_status")])
        return r6(g, *metrics)


_metric_query("geo2_centroid_extent", GEO_METRICS[:5])
_metric_query("geo3_pairwise_spacing", GEO_METRICS[6:8])
_metric_query("geo4_nearest_neighbour_mean", GEO_METRICS[8:])
_metric_query("geo5_convex_hull_area", GEO_METRICS[5:6])


@query("geo6_support_counts", sql(f"SELECT {V}, {', '.join(COUNTS)} FROM geo", RPT, VAR))
def geo6(fx):
    return variants(fx).select(*FV, *COUNTS)


_ACTOR = """ac AS (SELECT fr.frame_id, CASE WHEN NOT available THEN 'unknown' WHEN a >= 2 THEN 'multiple'
 WHEN bad > 0 THEN 'unknown' WHEN a = 1 THEN 'single' ELSE 'none' END AS actor_status FROM fr LEFT JOIN
 (SELECT frame_id, COUNT(*) FILTER (actor) AS a, COUNT(*) FILTER (actor IS NULL OR x IS NULL) AS bad FROM pt GROUP BY frame_id)
 USING (frame_id))"""


@query("geo7_actor_status", sql(f"{_ACTOR} SELECT * FROM ac", RPT))
def geo7(fx):
    return fx.rough.select("frame_id", F.expr(G.actor_status()).alias("actor_status"))


FLAGS = f"""{_ACTOR}, pf AS (SELECT frame_id, COUNT(*) FILTER (x IS NULL) AS bad, COUNT(*) FILTER (teammate IS NULL) AS ut,
  COUNT(*) FILTER (keeper IS NULL) AS uk FROM pt GROUP BY frame_id),
 fl AS (SELECT {V}, list_sort(list_filter([
  CASE WHEN NOT available THEN 'frame_unavailable' END, CASE WHEN bad > 0 THEN 'partial_invalid_input' END,
  CASE WHEN ut > 0 THEN 'unknown_teammate' END, CASE WHEN uk > 0 THEN 'unknown_keeper' END,
  CASE WHEN actor_status = 'multiple' THEN 'multiple_actor' END, CASE WHEN actor_status = 'unknown' THEN 'actor_status_unknown' END,
  CASE WHEN n_coincident_records > 0 THEN 'coincident_records' END,
  CASE WHEN n_out_of_bounds_points > 0 THEN 'out_of_bounds_points' END], lambda z: z IS NOT NULL)) AS flags
 FROM geo LEFT JOIN pf USING (frame_id) LEFT JOIN ac USING (frame_id))"""


@query("geo8_measurement_flags", sql(f"{FLAGS} SELECT {V}, array_to_string(flags, '|') AS measurement_flags FROM fl", RPT, VAR))
def geo8(fx):
    return G.measurement_flags(variants(fx)).select(*FV, F.array_join("measurement_flags", "|").alias("measurement_flags"))


@query("geo9_validate_variants", sql("SELECT COUNT(*) AS frames, 0 AS bad_frames FROM embeddings", RPT))
def geo9(fx):
    return G.validate_variants(G.point_variants(fx.rough), ["frame_id"])


_D = """COUNT(*) AS n_rows, COUNT(value) AS available, COUNT(*) - COUNT(value) AS na,
 ROUND(100.0 * (COUNT(*) - COUNT(value)) / COUNT(*), 6) AS na_percent, ROUND(AVG(value), 6) AS mean, ROUND(STDDEV_SAMP(value), 6) AS std,
 ROUND(MIN(value), 6) AS min, ROUND(MAX(value), 6) AS max, """ + ", ".join(
    f"ROUND(QUANTILE_CONT(value, {q}), 6) AS {n}" for n, q in G.QS.items()
)
_DC = ["na_percent", "mean", "std", "min", "max", *G.QS]


@query(
    "geo10_geometry_distributions",
    sql(f"{LONG} SELECT selected_subset, goalkeeper_policy, metric, {_D} FROM gl GROUP BY ALL", RPT, VAR),
)
def geo10(fx):
    return r6(G.geometry_distributions(rows(fx), [*G.VARIANT, "metric"], fx.small_frames), *_DC)


@query(
    "geo11_status_counts",
    sql(f"{LONG} SELECT selected_subset, goalkeeper_policy, metric, status, COUNT(*) AS n_rows FROM gl GROUP BY ALL", RPT, VAR),
)
def geo11(fx):
    return G.status_counts(rows(fx), [*G.VARIANT, "metric"])


@query(
    "geo12_shared_histogram",
    sql(
        f"""{LONG}, e AS (SELECT metric, MIN(value) AS lo, MAX(value) AS hi FROM gl GROUP BY metric),
 c AS (SELECT selected_subset, goalkeeper_policy, metric, LEAST(FLOOR((value - lo) / (hi - lo) * 30), 29) AS bin, COUNT(*) AS n
  FROM gl JOIN e USING (metric) WHERE value IS NOT NULL GROUP BY ALL),
 g AS (SELECT DISTINCT selected_subset, goalkeeper_policy, metric, lo, hi, range AS bin FROM gl JOIN e USING (metric), range(30))
 SELECT selected_subset, goalkeeper_policy, metric, bin::INT AS bin, ROUND(lo + (hi - lo) * bin / 30, 6) AS bin_left, COALESCE(n, 0) AS n_rows
 FROM g LEFT JOIN c USING (selected_subset, goalkeeper_policy, metric, bin)""",
        RPT,
        VAR,
    ),
)
def geo12(fx):
    return r6(G.shared_histogram(rows(fx), G.VARIANT), "bin_left")


@query(
    "geo13_by_point_count",
    sql(f"{LONG} SELECT selected_subset, goalkeeper_policy, n_valid_points_used, metric, {_D} FROM gl GROUP BY ALL", RPT, VAR),
)
def geo13(fx):
    r = rows(fx, ["n_valid_points_used"])
    return r6(G.geometry_distributions(r, [*G.VARIANT, "n_valid_points_used", "metric"], fx.small_frames), *_DC)


DELTA = f"""{LONG}, dl AS (SELECT frame_id, selected_subset, metric,
  MAX(value) FILTER (goalkeeper_policy = 'excluded') - MAX(value) FILTER (goalkeeper_policy = 'included') AS value,
  MAX(n_keeper_true_excluded) FILTER (goalkeeper_policy = 'excluded') AS kr,
  MAX(n_keeper_unknown_excluded) FILTER (goalkeeper_policy = 'excluded') AS ur FROM gl GROUP BY ALL)"""


@query(
    "geo14_paired_policy_delta",
    sql(
        f"""{DELTA}, s AS (SELECT *, 'all_pairs' AS scope FROM dl UNION ALL SELECT *, 'records_removed' FROM dl WHERE kr + ur > 0)
 SELECT selected_subset, scope, metric, COUNT(*) AS n_rows, COUNT(value) AS available, COUNT(*) FILTER (kr > 0) AS pairs_with_keeper_removal,
  COUNT(*) FILTER (ur > 0) AS pairs_with_unknown_removal, COUNT(*) FILTER (ABS(value) > 1e-9) AS changed_pairs,
  ROUND(AVG(ABS(value)), 6) AS mean_absolute_delta, ROUND(AVG(value), 6) AS mean, ROUND(MIN(value), 6) AS min, ROUND(MAX(value), 6) AS max,
  ROUND(MEDIAN(value), 6) AS median FROM s GROUP BY ALL""",
        RPT,
        VAR,
    ),
)
def geo14(fx):
    d = G.paired_policy_delta(geometry(fx), ["frame_id"])
    # last-digit noise of the two summation orders is not a change
    d = d.withColumn("delta", F.when(F.abs("delta") > 1e-9, F.col("delta")).otherwise(F.col("delta") * 0))
    out = G.policy_sensitivity(d, fx.small_frames).drop("std", "p05", "p25", "p75", "p95")
    return r6(out, "mean_absolute_delta", "mean", "min", "max", "median")


@query(
    "geo15_flag_inventory",
    sql(
        f"""{FLAGS} SELECT flag, COUNT(*) AS variant_rows, COUNT(DISTINCT frame_id) AS original_frames
 FROM (SELECT frame_id, unnest(flags) AS flag FROM fl) GROUP BY flag""",
        RPT,
        VAR,
    ),
)
def geo15(fx):
    return G.flag_inventory(G.measurement_flags(variants(fx)), ["frame_id"])


# --- polygons ----------------------------------------------------------------------------

_PHI = "(CASE WHEN {u} < 0 THEN 0 WHEN {u} > 120 THEN 120 * {u} - 7200 ELSE {u} * {u} / 2 END)"
_phi = lambda u: _PHI.format(u=f"({u})")
#: trapezoid area on the pitch in closed form: integrate the clamped right minus the clamped left side
_INSIDE = (
    f"(({_phi('x0 + 40')} - {_phi('x0 + 30')}) / 0.125 - ({_phi('x0 - 40')} - {_phi('x0 - 30')}) / -0.125)"
)
POLY = f"""pg AS (SELECT frame_id, polygon_status, CASE WHEN polygon_status = 'valid' THEN 5600.0 END AS polygon_area,
 CASE WHEN polygon_status = 'valid' THEN {_INSIDE} END AS area_inside_pitch,
 CASE WHEN polygon_status = 'valid' THEN x0 - 40 < 0 OR x0 + 40 > 120 END AS extends_outside_pitch FROM fr)"""


def inspected(fx):
    return PG.polygon_inspect(fx.rough, "visible_area")


@query(
    "pol1_polygon_inspect",
    sql(
        f"{POLY} SELECT frame_id, polygon_status, CASE polygon_status WHEN 'valid' THEN 4 WHEN 'invalid' THEN 4 END AS vertex_count FROM pg",
        RPT,
    ),
)
def pol1(fx):
    return inspected(fx).select("frame_id", "polygon_status", "vertex_count")


@query("pol2_polygon_area", sql(f"{POLY} SELECT frame_id, polygon_area FROM pg", RPT))
def pol2(fx):
    return r6(inspected(fx).select("frame_id", "polygon_area"), "polygon_area")


@query(
    "pol3_clip_area",
    sql(
        f"""{POLY} SELECT frame_id, ROUND(area_inside_pitch, 6) AS area_inside_pitch, extends_outside_pitch,
 ROUND(area_inside_pitch / 9600, 6) AS visible_area_fraction, ROUND(polygon_area - area_inside_pitch, 6) AS area_outside_pitch,
 ROUND((polygon_area - area_inside_pitch) / polygon_area, 6) AS fraction_outside_pitch FROM pg""",
        RPT,
    ),
)
def pol3(fx):
    cols = ["area_inside_pitch", "visible_area_fraction", "area_outside_pitch", "fraction_outside_pitch"]
    return r6(inspected(fx).select("frame_id", "extends_outside_pitch", *cols), *cols)


def related(fx):
    clean = inspected(fx).withColumn("points", F.expr(f"filter(points, p -> {P.valid('p')})"))
    return PG.point_relations(clean)


_SEG = """eg AS (SELECT frame_id, unnest([{'ax': x0-30, 'ay': 0.0, 'bx': x0+30, 'by': 0.0}, {'ax': x0+30, 'ay': 0.0, 'bx': x0+40, 'by': 80.0},
  {'ax': x0+40, 'ay': 80.0, 'bx': x0-40, 'by': 80.0}, {'ax': x0-40, 'ay': 80.0, 'bx': x0-30, 'by': 0.0}]) AS e FROM fr WHERE polygon_status = 'valid'),
 ds AS (SELECT frame_id, i, x, y, GREATEST(0.0, LEAST(1.0, ((x-e.ax)*(e.bx-e.ax) + (y-e.ay)*(e.by-e.ay)) /
   ((e.bx-e.ax)**2 + (e.by-e.ay)**2))) AS t, e FROM pt JOIN eg USING (frame_id) WHERE x IS NOT NULL),
 rel AS (SELECT frame_id, i, x, y, MIN(sqrt((x-e.ax-t*(e.bx-e.ax))**2 + (y-e.ay-t*(e.by-e.ay))**2)) AS dist FROM ds GROUP BY ALL),
 rp AS (SELECT pt.frame_id, pt.i, pt.x, pt.y, polygon_status, dist, CASE WHEN polygon_status <> 'valid' THEN 'unavailable'
   WHEN dist = 0 THEN 'boundary' WHEN pt.y > 0 AND pt.y < 80 AND pt.x > x0 - 30 - pt.y / 8 AND pt.x < x0 + 30 + pt.y / 8 THEN 'inside'
   ELSE 'outside' END AS relation FROM pt JOIN fr USING (frame_id) LEFT JOIN rel USING (frame_id, i) WHERE pt.x IS NOT NULL)"""


@query(
    "pol4_point_in_polygon",
    sql(f"{_SEG} SELECT frame_id, i, relation, ROUND(dist, 6) AS edge_distance FROM rp", RPT),
)
def pol4(fx):
    out = related(fx).select("frame_id", F.inline("points")).select("frame_id", "i", "relation", "edge_distance")
    return r6(out, "edge_distance")


_EXT = ", ".join(
    f"ROUND(MIN(dist) FILTER ({a} = {o}{a}), 6) AS {n}_edge_distance, COUNT(*) FILTER ({a} = {o}{a}) AS {n}_tied_records"
    for n, a, o in (("min_x", "x", "n"), ("max_x", "x", "m"), ("min_y", "y", "n"), ("max_y", "y", "m"))
)


@query(
    "pol5_edge_distances",
    sql(
        f"""{_SEG}, z AS (SELECT rp.*, MIN(x) OVER w AS nx, MAX(x) OVER w AS mx, MIN(y) OVER w AS ny, MAX(y) OVER w AS my
  FROM rp WINDOW w AS (PARTITION BY frame_id)),
 a AS (SELECT frame_id, COUNT(*) AS n, ROUND(MIN(dist), 6) AS minimum_edge_distance, ROUND(MEDIAN(dist), 6) AS median_edge_distance,
  COUNT(*) FILTER (relation = 'outside') AS outside_count, {_EXT} FROM z WHERE polygon_status = 'valid' GROUP BY frame_id)
 SELECT fr.frame_id, CASE WHEN NOT available THEN 'empty_points' WHEN polygon_status <> 'valid' THEN 'polygon_unavailable' ELSE 'ok' END AS edge_status,
  a.* EXCLUDE (frame_id, n) FROM fr LEFT JOIN a USING (frame_id)""",
        RPT,
    ),
)
def pol5(fx):
    e = PG.edge_distances(related(fx)).drop(
        "match_id", "event_type", "points", "x0", "visible_area", "vertex_count", "polygon_status", "polygon_area",
        "area_inside_pitch", "extends_outside_pitch", "visible_area_fraction", "area_outside_pitch",
        "fraction_outside_pitch", "__edges",
    )
    return r6(e, *[c for c in e.columns if c.endswith("_distance")])


@query(
    "pol5_tied_extremes",
    sql(
        f"""{_SEG}, z AS (SELECT frame_id, i, dist, relation, x, y, MIN(x) OVER w AS nx, MAX(x) OVER w AS mx, MIN(y) OVER w AS ny, MAX(y) OVER w AS my
  FROM rp WHERE polygon_status = 'valid' WINDOW w AS (PARTITION BY frame_id)),
 t AS (SELECT frame_id, 'min_x' AS extreme, i, dist, relation FROM z WHERE x = nx UNION ALL SELECT frame_id, 'max_x', i, dist, relation FROM z WHERE x = mx
  UNION ALL SELECT frame_id, 'min_y', i, dist, relation FROM z WHERE y = ny UNION ALL SELECT frame_id, 'max_y', i, dist, relation FROM z WHERE y = my),
 c AS (SELECT *, COUNT(*) OVER (PARTITION BY frame_id, extreme) AS n FROM t)
 SELECT frame_id, extreme, i, ROUND(dist, 6) AS edge_distance, relation FROM c WHERE n > 1""",
        RPT,
    ),
)
def pol5b(fx):
    return r6(PG.tied_extremes(related(fx), ["frame_id"]), "edge_distance")
