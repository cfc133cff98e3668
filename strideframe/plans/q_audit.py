"""Identity joins, audit and semantics queries."""

from pyspark.sql import functions as F

from strideframe.operators import audit as A
from strideframe.operators import joins as J
from strideframe.operators import polygons as PG
from strideframe.operators import semantics as M
from strideframe.plans.fixtures import EF, EV, MATCHES, OWN, RAW, RPT, TALLY, sql
from strideframe.plans.registry import query

META = ["event_type", "event_team_id", "loc_x", "loc_y"]
LINK_COLS = ["match_id", "frame_ordinal", "matching_event_records", "frame_uuid_records", "event_link_status", "event_type", "event_team_id"]


def linked(fx):
    return J.link_frames(fx.raw_frames, fx.raw_ids, META)


@query("jon1_link_frames", sql(f"SELECT {', '.join(LINK_COLS)} FROM lk", EV, RAW))
def jon1(fx):
    return linked(fx).select(*LINK_COLS)


@query(
    "jon2_coverage_flag",
    sql(
        """SELECT event_id, id IS NOT NULL AND EXISTS (SELECT 1 FROM afr WHERE afr.match_id = aev.match_id AND afr.event_uuid = aev.id)
 AS has_360_frame FROM aev""",
        EV,
        RAW,
    ),
)
def jon2(fx):
    return J.coverage_flag(fx.raw_ids.select("match_id", "event_id", "id"), fx.raw_frames).select("event_id", "has_360_frame")


_TWO = """l AS (SELECT match_id, event_index, event_type, t_us / 1e6 AS seconds FROM ev WHERE k % 7 <> 0),
 r AS (SELECT match_id, event_index, CASE WHEN k % 13 = 0 THEN 'changed' ELSE event_type END AS event_type,
  t_us / 1e6 + CASE WHEN k % 17 = 0 THEN 0.5 ELSE 0 END AS seconds FROM ev WHERE k % 5 <> 0)"""


@query(
    "jon3_exact_join",
    sql(
        f"""{_TWO}, j AS (SELECT l.match_id AS lm, r.match_id AS rm, l.event_type AS le, r.event_type AS re, l.seconds AS ls, r.seconds AS rs
  FROM l FULL JOIN r ON l.match_id = r.match_id AND l.event_index = r.event_index)
 SELECT COUNT(*) FILTER (lm IS NOT NULL AND rm IS NOT NULL) AS both, COUNT(*) FILTER (rm IS NULL) AS left_only,
  COUNT(*) FILTER (lm IS NULL) AS right_only, COUNT(*) FILTER (le <> re) AS event_type_mismatch,
  COUNT(*) FILTER (ABS(ls - rs) > 1e-9) AS seconds_mismatch FROM j""",
        EV,
    ),
)
def jon3(fx):
    left = fx.ev.where("k % 7 <> 0").selectExpr("match_id", "event_index", "event_type", "t_us / 1e6D AS seconds")
    right = fx.ev.where("k % 5 <> 0").selectExpr(
        "match_id",
        "event_index",
        "CASE WHEN k % 13 = 0 THEN 'changed' ELSE event_type END AS event_type",
        "t_us / 1e6D + CASE WHEN k % 17 = 0 THEN 0.5D ELSE 0D END AS seconds",
    )
    check = ["event_type", "seconds"]
    joined = J.exact_join(left, right, ["match_id", "event_index"], check=check, tolerance={"seconds": 1e-9})
    return J.reconcile_join(joined, check)


@query(
    "jon4_anti_join_report",
    sql(
        f"""{_TWO} SELECT match_id, event_index, 'missing_right' AS side FROM l ANTI JOIN r USING (match_id, event_index)
 UNION ALL SELECT match_id, event_index, 'missing_left' FROM r ANTI JOIN l USING (match_id, event_index)""",
        EV,
    ),
)
def jon4(fx):
    return J.anti_join_report(fx.ev.where("k % 7 <> 0"), fx.ev.where("k % 5 <> 0"), ["match_id", "event_index"])


def edges(fx):
    n = fx.n_frames
    ef = fx.event_frames
    events = fx.ev.withColumn(
        "related_events",
        F.expr(
            f"CASE WHEN k % 5 = 0 THEN array(event_id + {n}, event_id + 1, event_id + {n}) WHEN k % 5 = 1 THEN array(event_id + 1) ELSE array() END"
        ),
    )
    return J.related_edges(events, ef.select(F.col("event_id").alias("event_uuid"), "points"))


EDGES = """re AS (SELECT event_id, event_id + (SELECT COUNT(*) FROM embeddings) AS rid FROM ev WHERE k % 5 = 0
  UNION SELECT event_id, event_id + 1 FROM ev WHERE k % 5 <= 1),
 ed AS (SELECT a.event_id, b.event_id AS related_event_id, a.event_type, b.event_type AS related_event_type,
  a.event_team_id = b.event_team_id AS same_event_team, fb.event_id IS NOT NULL AS related_has_frame,
  COALESCE(fa.n_ok > 0 AND fb.n_ok > 0 AND fa.event_id % (SELECT COUNT(*) FROM embeddings) = fb.event_id % (SELECT COUNT(*) FROM embeddings), FALSE)
   AS equal_native_cloud
  FROM re JOIN ev a USING (event_id) JOIN ev b ON b.event_id = re.rid JOIN ef fa ON fa.event_id = a.event_id
  LEFT JOIN ef fb ON fb.event_id = b.event_id),
 ed2 AS (SELECT *, equal_native_cloud AND same_event_team AS expected_team_labels_agree,
  equal_native_cloud AND NOT same_event_team AS label_conflict FROM ed)"""


@query("jon5_related_edges", sql(f"{EDGES} SELECT * FROM ed2", EV, RPT, TALLY, EF))
def jon5(fx):
    return edges(fx)


@query(
    "jon6_conflict_endpoints",
    sql(
        f"{EDGES} SELECT event_id FROM ed2 WHERE label_conflict UNION SELECT related_event_id FROM ed2 WHERE label_conflict",
        EV, RPT, TALLY, EF,
    ),
)
def jon6(fx):
    return J.conflict_endpoints(edges(fx))


@query(
    "jon7_lineup_membership",
    sql(
        """SELECT event_id, CASE WHEN k % 10 <> 0 THEN EXISTS (SELECT 1 FROM ev l WHERE l.k % 3 <> 0 AND l.match_id = ev.match_id
 AND l.event_team_id = ev.event_team_id AND l.k = ev.k) END AS in_lineup FROM ev""",
        EV,
    ),
)
def jon7(fx):
    lineups = fx.ev.where("k % 3 <> 0").selectExpr("match_id", "event_team_id", "k AS player_id")
    events = fx.ev.selectExpr("match_id", "event_id", "event_team_id", "CASE WHEN k % 10 <> 0 THEN k END AS player_id")
    return J.lineup_membership(events, lineups).select("event_id", "in_lineup")


@query(
    "aud1_match_inventory",
    sql(
        """ec AS (SELECT match_id, id, COUNT(*) AS n FROM aev GROUP BY ALL), fc AS (SELECT match_id, event_uuid AS id, COUNT(*) AS n FROM afr GROUP BY ALL),
 a AS (SELECT match_id, SUM(n) AS total_event, COUNT(id) AS unique_event_ids, COALESCE(SUM(n) FILTER (id IS NULL), 0) AS event_missing_id,
  COALESCE(SUM(n - 1) FILTER (id IS NOT NULL), 0) AS duplicate_event_ids, COUNT(*) FILTER (id IS NOT NULL AND n > 1) AS duplicate_event_groups FROM ec GROUP BY match_id),
 b AS (SELECT match_id, SUM(n) AS total_frame, COUNT(id) AS unique_frame_ids, COALESCE(SUM(n) FILTER (id IS NULL), 0) AS frame_missing_id,
  COALESCE(SUM(n - 1) FILTER (id IS NOT NULL), 0) AS duplicate_frame_ids, COUNT(*) FILTER (id IS NOT NULL AND n > 1) AS duplicate_frame_groups FROM fc GROUP BY match_id),
 m AS (SELECT match_id, COUNT(*) AS matched_events FROM aev SEMI JOIN afr ON aev.match_id = afr.match_id AND aev.id = afr.event_uuid GROUP BY match_id),
 o AS (SELECT match_id, COUNT(*) FILTER (matching_event_records = 0) AS orphan_frames, COUNT(*) FILTER (matching_event_records > 1) AS ambiguous_frames
  FROM lk GROUP BY match_id)
 SELECT a.*, b.* EXCLUDE (match_id), COALESCE(matched_events, 0) AS matched_events, COALESCE(orphan_frames, 0) AS orphan_frames,
  COALESCE(ambiguous_frames, 0) AS ambiguous_frames, total_event - COALESCE(matched_events, 0) AS events_without_frames
 FROM a LEFT JOIN b USING (match_id) LEFT JOIN m USING (match_id) LEFT JOIN o USING (match_id)""",
        EV,
        RAW,
    ),
)
def aud1(fx):
    return A.match_inventory(fx.raw_ids, fx.raw_frames)


def measured(fx):
    return A.actor_distance(fx.event_frames)


MEAS = """ms AS (SELECT ef.*, CASE WHEN NOT available THEN 'freeze_frame unavailable' WHEN actors_all <> 1 THEN 'actor count is not one'
   WHEN ax IS NULL THEN 'actor location unavailable or invalid' WHEN link <> 'unique' THEN 'event link missing or ambiguous'
   WHEN loc_x IS NULL OR loc_y IS NULL THEN 'event location unavailable or invalid' ELSE 'measurable' END AS actor_reason FROM ef),
 md AS (SELECT *, CASE WHEN actor_reason = 'measurable' THEN sqrt((loc_x - ax)**2 + (loc_y - ay)**2) END AS direct_distance,
  CASE WHEN actor_reason = 'measurable' THEN sqrt((120 - loc_x - ax)**2 + (80 - loc_y - ay)**2) END AS mirrored_distance FROM ms),
 mm AS (SELECT *, CASE WHEN direct_distance < mirrored_distance THEN 'direct_closer' WHEN mirrored_distance < direct_distance THEN 'mirrored_closer'
   ELSE 'equal_or_indeterminate' END AS comparison FROM md)"""
_B = (EV, RPT, TALLY, EF)


def rnd(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(
    "aud2_actor_distance",
    sql(
        f"{MEAS} SELECT event_id, actor_reason, ROUND(direct_distance, 6) AS direct_distance, ROUND(mirrored_distance, 6) AS mirrored_distance, comparison FROM mm",
        *_B,
    ),
)
def aud2(fx):
    return rnd(
        measured(fx).select("event_id", "actor_reason", "direct_distance", "mirrored_distance", "comparison"),
        "direct_distance", "mirrored_distance",
    )


@query(
    "aud3_frame_observability",
    sql(
        """SELECT fr.frame_id, NOT available AS freeze_frame_missing, CASE WHEN available THEN FALSE END AS freeze_frame_empty,
 n_all AS visible_players, t_all AS teammate_true, f_all AS teammate_false, u_all AS teammate_unknown, keepers, actors_all AS actors, n_ok AS valid_locations
 FROM fr LEFT JOIN pc USING (frame_id)""",
        RPT,
        TALLY,
    ),
)
def aud3(fx):
    return A.frame_observability(fx.rough).drop("match_id", "event_type", "points", "x0", "visible_area")


_Q = ", ".join(f"ROUND(QUANTILE_CONT(direct_distance, {q}), 6) AS {n}" for n, q in A.DIST.items())


@query(
    "aud4_distance_stats",
    sql(
        f"""{MEAS} SELECT event_type, COUNT(*) AS count, ROUND(AVG(direct_distance), 6) AS mean, ROUND(MAX(direct_distance), 6) AS max, {_Q}
 FROM mm WHERE direct_distance IS NOT NULL GROUP BY event_type""",
        *_B,
    ),
)
def aud4(fx):
    return rnd(A.distance_stats(measured(fx), ["event_type"], fx.small), "mean", "max", *A.DIST)


_P = ", ".join(
    f"ROUND(100.0 * AVG(CASE WHEN comparison = '{c}' THEN 1 ELSE 0 END), 6) AS percent_{c}"
    for c in ("direct_closer", "mirrored_closer", "equal_or_indeterminate")
)


@query(
    "aud5_hypothesis_shares",
    sql(
        f"""{MEAS} SELECT event_type, COUNT(*) AS measurable_pairs, {_P}, ROUND(MEDIAN(direct_distance), 6) AS median_direct,
 ROUND(QUANTILE_CONT(direct_distance, 0.95), 6) AS p95_direct, ROUND(MEDIAN(mirrored_distance), 6) AS median_mirrored,
 ROUND(QUANTILE_CONT(mirrored_distance, 0.95), 6) AS p95_mirrored FROM mm WHERE direct_distance IS NOT NULL GROUP BY event_type""",
        *_B,
    ),
)
def aud5(fx):
    out = A.hypothesis_shares(measured(fx), ["event_type"], fx.small)
    return rnd(out, *[c for c in out.columns if c[:3] in ("per", "med", "p95")])


def frame_audit(fx):
    f = linked(fx).withColumnRenamed("event_link_status", "link")
    f = PG.polygon_inspect(A.actor_distance(A.frame_observability(f)), "visible_area")
    return f.withColumnRenamed("link", "event_link_status")


DIMS = {"match_id": "match_id", "event_type": "event_type", "event_team": "event_team_id"}
_F = {
    "all_frames": "TRUE",
    "frames_nonempty": "COALESCE(n_all, 0) > 0",
    "frames_valid_area": "polygon_status = 'valid'",
    "frames_actor_measurable": "actor_reason = 'measurable'",
    "frames_missing_area": "polygon_status = 'missing'",
    "frames_malformed_area": "polygon_status = 'malformed'",
    "frames_invalid_area": "polygon_status = 'invalid'",
    "frames_unique_link": "u",
    "frames_unique_nonempty": "u AND n_all > 0",
    "frames_unique_nonempty_valid_area": "u AND n_all > 0 AND polygon_status = 'valid'",
    "frames_joint_checks": "u AND n_all > 0 AND polygon_status = 'valid' AND actor_reason = 'measurable' AND n_ok = n_all",
}


@query(
    "aud6_attrition",
    sql(
        f"""ff AS (SELECT lk.*, fr.available, fr.polygon_status, pc.* EXCLUDE (frame_id), event_link_status = 'unique' AND frame_uuid_records = 1 AS u,
  CASE WHEN NOT available THEN 'freeze_frame unavailable' WHEN actors_all <> 1 THEN 'x' WHEN ax IS NULL THEN 'x' WHEN event_link_status <> 'unique' THEN 'x'
   WHEN loc_x IS NULL THEN 'x' ELSE 'measurable' END AS actor_reason FROM lk JOIN fr USING (frame_id) LEFT JOIN pc USING (frame_id)),
 fd AS (SELECT *, CASE WHEN actor_reason = 'measurable' THEN sqrt((loc_x - ax)**2 + (loc_y - ay)**2) END AS dd FROM ff),
 fs AS ({" UNION ALL ".join(f"SELECT '{s}' AS scope, CAST({e} AS VARCHAR) AS grp, * FROM fd" for s, e in [("all", "'all'"), ("match_id", "match_id"), ("event_type", "event_type"), ("event_team", "event_team_id")])}),
 fa AS (SELECT scope, grp, {", ".join(f"COUNT(*) FILTER ({c}) AS {n}" for n, c in _F.items())}, ROUND(AVG(dd), 6) AS distance_mean,
  ROUND(MAX(dd), 6) AS distance_max, ROUND(MEDIAN(dd), 6) AS distance_median FROM fs GROUP BY scope, grp),
 ee AS (SELECT aev.*, id IS NOT NULL AND EXISTS (SELECT 1 FROM afr WHERE afr.match_id = aev.match_id AND afr.event_uuid = aev.id) AS h FROM aev),
 es AS ({" UNION ALL ".join(f"SELECT '{s}' AS scope, CAST({e} AS VARCHAR) AS grp, h FROM ee" for s, e in [("all", "'all'"), ("match_id", "match_id"), ("event_type", "event_type"), ("event_team", "event_team_id")])}),
 ea AS (SELECT scope, grp, COUNT(*) AS all_events, COUNT(*) FILTER (h) AS events_with_frame, COUNT(*) FILTER (NOT h) AS events_without_frame FROM es GROUP BY scope, grp)
 SELECT COALESCE(ea.scope, fa.scope) AS scope, COALESCE(ea.grp, fa.grp) AS "group",
  {", ".join(f"COALESCE({c}, 0) AS {c}" for c in ("all_events", "events_with_frame", "events_without_frame", *_F))},
  distance_mean, distance_max, distance_median
 FROM ea FULL JOIN fa ON ea.scope = fa.scope AND ea.grp IS NOT DISTINCT FROM fa.grp""",
        EV, RPT, TALLY, RAW,
    ),
)
def aud6(fx):
    events = J.coverage_flag(fx.raw_ids, fx.raw_frames)
    return rnd(A.attrition(events, frame_audit(fx), DIMS, fx.small), "distance_mean", "distance_max", "distance_median")


@query(
    "aud7_top_discrepancies",
    sql(
        f"{MEAS} SELECT event_id, ROUND(direct_distance, 6) AS direct_distance FROM mm WHERE direct_distance IS NOT NULL ORDER BY mm.direct_distance DESC, event_id LIMIT 10",
        *_B,
    ),
)
def aud7(fx):
    return rnd(A.top_discrepancies(measured(fx), 10, ["event_id"]).select("event_id", "direct_distance"), "direct_distance")


@query(
    "aud8_multiple_actor_frames",
    sql(
        """SELECT pt.frame_id, match_id, event_type, COUNT(*) AS actor_count, SUM(CASE WHEN x IS NULL THEN 1 ELSE 0 END) AS missing_locations FROM pt
 WHERE actor GROUP BY ALL HAVING COUNT(*) > 1""",
        RPT,
    ),
)
def aud8(fx):
    out = A.multiple_actor_frames(fx.rough)
    gone = F.size(F.filter(F.from_json("actor_locations", "array<array<double>>"), lambda p: p[0].isNull()))
    return out.select("frame_id", "match_id", "event_type", "actor_count", gone.alias("missing_locations"))


@query(
    "src3_load_status_inventory",
    sql(
        """e AS (SELECT match_id, COUNT(*) AS events FROM ev GROUP BY ALL), f AS (SELECT match_id, COUNT(*) AS original_frames FROM afr WHERE match_id <> 7 GROUP BY ALL)
 SELECT m.match_id, events, original_frames, 6 * original_frames AS variant_rows,
  CASE WHEN original_frames IS NULL THEN 'missing' ELSE 'loaded' END AS frames_load_status
 FROM matches m LEFT JOIN e USING (match_id) LEFT JOIN f USING (match_id)""",
        EV, MATCHES, RAW,
    ),
)
def src3(fx):
    return A.load_status_inventory(fx.matches, fx.ev, fx.raw_frames.where("match_id <> 7"))


# --- semantics ---------------------------------------------------------------------------

_CODEC = """pair AS (SELECT vec_id, ax, ay, CASE vec_id % 4 WHEN 0 THEN ax WHEN 1 THEN CAST(CAST(ax AS FLOAT) AS DOUBLE) WHEN 2 THEN ax + 1 END AS bx,
  CASE vec_id % 4 WHEN 1 THEN CAST(CAST(ay AS FLOAT) AS DOUBLE) ELSE ay END AS b2y FROM
  (SELECT vec_id, 60.0E0 + 160.0E0 * CAST({e0} AS DOUBLE) AS ax, 40.0E0 + 110.0E0 * CAST({e1} AS DOUBLE) AS ay FROM embeddings) q)"""


@query(
    "sem1_codec_alignment",
    sql(
        _CODEC.format(e0="list_extract(embedding, 1)", e1="list_extract(embedding, 2)")
        + """ SELECT vec_id, CASE WHEN bx IS NULL THEN 'unavailable' WHEN ax = bx AND ay = b2y THEN 'exact_supplied'
 WHEN CAST(CAST(ax AS FLOAT) AS DOUBLE) = bx AND CAST(CAST(ay AS FLOAT) AS DOUBLE) = b2y THEN 'exact_float32' ELSE 'not_exact' END AS alignment FROM pair""",
        "one AS (SELECT 1)",
    ),
)
def sem1(fx):
    p = fx.table("embeddings").selectExpr(
        "vec_id", "60.0D + 160.0D * CAST(embedding[0] AS DOUBLE) AS ax", "40.0D + 110.0D * CAST(embedding[1] AS DOUBLE) AS ay"
    ).selectExpr(
        "*",
        "CASE vec_id % 4 WHEN 0 THEN ax WHEN 1 THEN CAST(CAST(ax AS FLOAT) AS DOUBLE) WHEN 2 THEN ax + 1 END AS bx",
        "CASE vec_id % 4 WHEN 1 THEN CAST(CAST(ay AS FLOAT) AS DOUBLE) ELSE ay END AS by",
    )
    return p.select("vec_id", F.expr(M.codec_alignment("ax", "ay", "bx", "by")).alias("alignment"))


def semantic(fx, events=None):
    """Semantics of the linked events' snapshots: of all, or of some ``events`` of the stream."""
    return M.frame_semantics(M.event_frame_profile(fx.event_frames if events is None else fx.frames_of(events)), OWN, "r1")


_COD = """CASE WHEN a_ok = 1 THEN CASE WHEN loc_x IS NULL OR loc_y IS NULL THEN 'unavailable' WHEN loc_x = ax AND loc_y = ay THEN 'exact_supplied'
 WHEN CAST(CAST(loc_x AS FLOAT) AS DOUBLE) = ax AND CAST(CAST(loc_y AS FLOAT) AS DOUBLE) = ay THEN 'exact_float32' ELSE 'not_exact' END ELSE 'unavailable' END"""
SEM = f"""sm AS (SELECT *, {_COD} AS actor_codec, CASE WHEN source_revision <> 'r1' THEN 'unsupported_source_revision'
  WHEN link <> 'unique' THEN 'invalid_event_frame_join' WHEN match_id = 11 THEN 'invalid_match_team'
  WHEN event_type NOT IN ('Shot', 'Pass', 'Carry', 'Pressure') THEN 'unsupported_event_type'
  WHEN label_conflict IS NULL THEN 'related_team_audit_unresolved' WHEN label_conflict THEN 'related_team_label_conflict'
  WHEN NOT available OR bad > 0 OR ua_ok > 0 OR a_ok <> 1 THEN 'actor_status_unresolved'
  WHEN at_ok <> 1 THEN 'actor_team_flag_unresolved' WHEN u_ok > 0 OR uk_ok > 0 THEN 'point_flags_unresolved'
  WHEN ({_COD}) NOT IN ('exact_supplied', 'exact_float32') THEN 'actor_encoding_unresolved' ELSE 'validated' END AS semantics_status FROM ef)"""


@query("sem2_frame_semantics", sql(f"{SEM} SELECT event_id, semantics_status FROM sm", *_B))
def sem2(fx):
    return semantic(fx).select("event_id", "semantics_status")


@query(
    "sem3_point_team_label",
    sql(
        f"""{SEM} SELECT event_id, i, CASE WHEN teammate IS NULL THEN 'unresolved' WHEN teammate = (event_team_id = {OWN}) THEN 'own' ELSE 'opponent' END AS side
 FROM sm JOIN pt ON pt.frame_id = event_id % (SELECT COUNT(*) FROM embeddings) WHERE semantics_status = 'validated'""",
        *_B,
    ),
)
def sem3(fx):
    pts = semantic(fx).where("semantics_status = 'validated'").select("event_id", "event_team_id", "semantics_status", F.inline("points"))
    return pts.select("event_id", "i", F.expr(M.point_team_label(OWN)).alias("side"))


_OR = f"""CASE WHEN loc_x IS NULL OR loc_y IS NULL THEN 'invalid_location' WHEN semantics_status <> 'validated' THEN 'unsupported'
 WHEN event_team_id = {OWN} THEN 'identity_explicit' ELSE 'rotated_180' END"""


@query(
    "sem4_normalize_point",
    sql(
        f"""{SEM} SELECT event_id, {_OR} AS orientation_status, CASE ({_OR}) WHEN 'identity_explicit' THEN loc_x WHEN 'rotated_180' THEN 120 - loc_x END AS x_attacking,
 CASE ({_OR}) WHEN 'identity_explicit' THEN loc_y WHEN 'rotated_180' THEN 80 - loc_y END AS y_attacking FROM sm""",
        *_B,
    ),
)
def sem4(fx):
    return semantic(fx).select("event_id", *[c.alias(n) for n, c in M.normalize_point("loc_x", "loc_y", OWN).items()])


@query(
    "sem5_normalization_check",
    sql(
        f"""{SEM} SELECT event_id, CASE WHEN semantics_status = 'validated' THEN n_ok ELSE 0 END AS locations_checked,
 CASE WHEN semantics_status = 'validated' THEN 0.0 END AS max_roundtrip_error FROM sm""",
        *_B,
    ),
)
def sem5(fx):
    return rnd(
        M.normalization_check(semantic(fx), OWN).select("event_id", "locations_checked", "max_roundtrip_error"), "max_roundtrip_error"
    )


@query(
    "sem6_crosscheck_nearest",
    sql(
        """ref AS (SELECT frame_id, i AS ref, x + 0.5 * (i % 4) AS x, y, teammate FROM pt WHERE i % 3 = 0 AND x IS NOT NULL AND teammate IS NOT NULL),
 d AS (SELECT r.frame_id, r.ref, r.teammate AS rt, p.teammate AS pt, sqrt((r.x - p.x)**2 + (r.y - p.y)**2) AS d FROM ref r JOIN pt p USING (frame_id) WHERE p.x IS NOT NULL),
 m AS (SELECT *, MIN(d) OVER (PARTITION BY frame_id, ref) AS md FROM d)
 SELECT frame_id, ref, ROUND(MIN(d), 6) AS nearest_distance, COUNT(*) = 1 AS unique_nearest, BOOL_AND(COALESCE(pt = rt, FALSE)) AS flags_agree
 FROM m WHERE d = md GROUP BY frame_id, ref""",
        RPT,
    ),
)
def sem6(fx):
    df = fx.rough.withColumn(
        "refs",
        F.expr("transform(filter(points, p -> p.i % 3 = 0), p -> named_struct('i', p.i, 'x', p.x + 0.5D * (p.i % 4), 'y', p.y, 'teammate', p.teammate))"),
    )
    return rnd(M.crosscheck_nearest(df, ["frame_id"]), "nearest_distance")


_CTX = f"""tc AS (SELECT *, CASE WHEN match_id = 11 THEN 'invalid_match_team' WHEN event_team_id = possession_team_id THEN 'same' ELSE 'different' END AS team_agreement FROM ef),
 td AS (SELECT *, CASE WHEN team_agreement NOT IN ('same', 'different') THEN 'ambiguous_possession_context'
  WHEN possession_team_id = {OWN} AND event_team_id <> {OWN} THEN 'opponent_event_in_own_possession'
  WHEN possession_team_id = {OWN} THEN 'own_event_in_own_possession' WHEN event_team_id = {OWN} THEN 'own_event_in_opponent_possession'
  ELSE 'opponent_possession_context' END AS attacking_context FROM tc)"""


@query("prj5_team_context", sql(f"{_CTX} SELECT event_id, team_agreement, attacking_context FROM td", *_B))
def prj5(fx):
    return fx.event_frames.select("event_id", *[c.alias(n) for n, c in M.team_context(OWN).items()])


@query(
    "sem7_semantic_summaries",
    sql(
        f"""{SEM}, dm AS (SELECT *, CASE WHEN a_ok = 1 AND loc_x IS NOT NULL AND loc_y IS NOT NULL THEN sqrt((loc_x-ax)**2 + (loc_y-ay)**2) END AS dd,
  CASE WHEN a_ok = 1 AND loc_x IS NOT NULL AND loc_y IS NOT NULL THEN sqrt((120-loc_x-ax)**2 + (80-loc_y-ay)**2) END AS mm FROM sm)
 SELECT event_type, semantics_status, actor_codec, COUNT(*) AS frames, COALESCE(SUM(n_ok), 0)::BIGINT AS point_records, COALESCE(SUM(t_ok), 0)::BIGINT AS teammate_true_records,
  COALESCE(SUM(f_ok), 0)::BIGINT AS teammate_false_records, COUNT(*) FILTER (event_team_id = possession_team_id) AS same_team_frames
 FROM dm GROUP BY ALL""",
        *_B,
    ),
)
def sem7(fx):
    sums = {
        c: F.coalesce(F.sum(c), F.lit(0)) for c in ("point_records", "teammate_true_records", "teammate_false_records")
    }
    sums["same_team_frames"] = F.count_if(F.col("event_team_id") == F.col("possession_team_id"))
    return M.contingency(semantic(fx), ["event_type", "semantics_status", "actor_codec"], sums)


_ANC = ["loc_x", "end_x", "delta_x", "keeper_true_mean_x", "keeper_false_mean_x"]


@query(
    "sem7_anchor_metrics",
    sql(
        f"""z AS (SELECT match_id, event_team_id, period, event_type, loc_x, end_x, end_x - loc_x AS delta_x, kt_x AS keeper_true_mean_x, kf_x AS keeper_false_mean_x FROM ef),
 u AS ({" UNION ALL ".join(f"SELECT match_id, event_team_id, period, event_type, '{m}' AS metric, {m} AS v FROM z" for m in _ANC)})
 SELECT match_id, event_team_id, period, event_type, metric, COUNT(*) AS events, COUNT(v) AS count, ROUND(AVG(v), 6) AS mean, ROUND(MIN(v), 6) AS min,
  ROUND(MAX(v), 6) AS max, {", ".join(f"ROUND(QUANTILE_CONT(v, {q}), 6) AS {n}" for n, q in (("p05", .05), ("p25", .25), ("p50", .5), ("p75", .75), ("p95", .95)))},
  COUNT(*) FILTER (v > 60) AS above_midfield FROM u GROUP BY ALL""",
        *_B,
    ),
)
def sem7b(fx):
    df = M.event_frame_profile(fx.event_frames).withColumn("delta_x", F.expr("end_x - loc_x"))
    out = M.anchor_metrics(df, ["match_id", "event_team_id", "period", "event_type"], _ANC, fx.small)
    return rnd(out, "mean", "min", "max", "p05", "p25", "p50", "p75", "p95")


STRATA = {
    "concat(event_type, '_period', period)": "event_type IN ('Shot', 'Pass', 'Carry')",
    "concat('other_', event_type)": "event_type IN ('Pressure', 'Ball Recovery')",
    "'label_conflict'": "label_conflict",
}


@query(
    "sem8_stratum_first",
    sql(
        """r AS (SELECT event_type || '_period' || period AS rule, match_id, event_index, event_id FROM ef WHERE event_type IN ('Shot', 'Pass', 'Carry')
  UNION ALL SELECT 'other_' || event_type, match_id, event_index, event_id FROM ef WHERE event_type IN ('Pressure', 'Ball Recovery')
  UNION ALL SELECT 'label_conflict', match_id, event_index, event_id FROM ef WHERE label_conflict)
 SELECT rule, match_id, event_index, event_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY rule ORDER BY match_id, event_index, event_id) AS rn FROM r) WHERE rn = 1""",
        *_B,
    ),
)
def sem8(fx):
    return M.stratum_first(fx.event_frames, STRATA, ["match_id", "event_index", "event_id"], [])


_PRO = {
    "point_records": "n_ok", "invalid_point_records": "bad", "teammate_true_records": "t_ok", "teammate_false_records": "f_ok",
    "unknown_teammate_records": "u_ok", "actor_records": "a_ok", "actor_teammate_true": "at_ok", "actor_teammate_false": "af_ok",
    "keeper_true_count": "kt_n", "keeper_false_count": "kf_n",
}


@query(
    "sem9_event_frame_profile",
    sql(
        f"""SELECT event_id, {", ".join(f"{v} AS {n}" for n, v in _PRO.items())}, CASE WHEN available THEN {_COD} ELSE 'unavailable' END AS actor_codec,
 ROUND(kt_x, 6) AS keeper_true_mean_x, ROUND(kf_x, 6) AS keeper_false_mean_x FROM ef""",
        *_B,
    ),
)
def sem9(fx):
    out = M.event_frame_profile(fx.event_frames).select("event_id", *_PRO, "actor_codec", "keeper_true_mean_x", "keeper_false_mean_x")
    return rnd(out, "keeper_true_mean_x", "keeper_false_mean_x")
