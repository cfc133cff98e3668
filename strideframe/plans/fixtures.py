"""Bindings of the operators' inputs to the given tables, in Spark and in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.operators.ordered import GROUP_LIMIT, Lane, lane_for, number
from strideframe.sources.stage import stored

OWN, OTHER = 904, 10
KEY = ("match_id", "period", "possession_id", "possession_team_id")
HOUR_US = 3_600_000_000
#: events of a possession
POSSESSION = 24


class Fixture:
    """Input tables of one data directory.

    Row counts come from Parquet footers; they bound every group and so decide
    between plain and blocked windows (see ``operators.ordered``).
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def n_events(self) -> int:
        return self.table("events").count()

    @cached_property
    def n_frames(self) -> int:
        return self.table("embeddings").count()

    @cached_property
    def n_lines(self) -> int:
        return self.table("lineitem").count()

    @property
    def small(self) -> bool:
        """Every group of an event-grained table fits one task."""
        return self.n_events * 6 <= GROUP_LIMIT

    @property
    def small_frames(self) -> bool:
        return self.n_frames * 6 * 9 <= GROUP_LIMIT

    def small_lines(self, times: int = 1) -> bool:
        """The line items, ``times`` over, fit one task."""
        return self.n_lines * times <= GROUP_LIMIT

    def lane(self, *keys: str, order: tuple[str, ...] = ("event_index",), at: str = "event_index") -> Lane:
        """Lane over events; blocks are runs of 100,000 consecutive event numbers.

        A possession, and a case, is a run of ``POSSESSION`` event numbers of a match: that bounds its rows, however many
        events there are. A stream may hold a few rows for an event (marks, versions, candidates).
        """
        rows = 10 * POSSESSION if {"possession_id", "case_id"} & set(keys) else self.n_events
        return lane_for(rows, keys, order, f"CAST(floor({at} / 100000) AS BIGINT)")

    def time_lane(self, *keys: str, order: tuple[str, ...] = ("t_us", "event_id")) -> Lane:
        """Lane ordered by time; blocks are one-minute slices."""
        return lane_for(self.n_events, keys, order, "CAST(floor(t_us / 60000000) AS BIGINT)")

    @cached_property
    def ev(self) -> DataFrame:
        """Ordered event stream: 12 matches, possessions of 24 consecutive events."""
        k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
        base = self.table("events").select(
            "event_id",
            F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"),
            F.when(F.dayofmonth("ts") <= 15, 1).otherwise(2).alias("period"),
            (F.col("user_id") % 12).cast("int").alias("match_id"),
            "value",
            k.alias("k"),
            F.expr(
                "CASE event_type WHEN 'view' THEN 'Pass' WHEN 'click' THEN 'Carry' WHEN 'purchase' THEN 'Shot' "
                "WHEN 'error' THEN 'Pressure' ELSE 'Ball Recovery' END"
            ).alias("event_type"),
        )
        lane = self.time_lane("match_id")
        numbered = number(base, lane, "event_index")
        if lane.block:
            # most queries read the stream many times, each time other columns
            numbered = stored(numbered)
        ordered = numbered.withColumn("possession_id", F.expr(f"CAST(floor((event_index - 1) / {POSSESSION}.0) AS BIGINT)"))
        return ordered.selectExpr(
            "match_id",
            "period",
            "possession_id",
            f"CASE WHEN possession_id % 4 = 3 THEN {OTHER} ELSE {OWN} END AS possession_team_id",
            "event_id",
            "event_index",
            "t_us",
            "event_type",
            f"CASE WHEN (event_id * 7 + k) % 5 = 0 THEN {OTHER} ELSE {OWN} END AS event_team_id",
            "k",
            "value % 120.0D AS start_x",
            "(value * 3.0D) % 80.0D AS start_y",
            "CASE WHEN k % 19 <> 0 THEN value % 120.0D + (k - 50) * 0.5D END AS end_x",
            "CASE WHEN k % 19 <> 0 THEN (value * 3.0D) % 80.0D + (k % 21 - 10) * 0.5D END AS end_y",
            "CASE WHEN event_type = 'Pass' AND k % 7 = 0 THEN 'Incomplete' END AS pass_outcome",
            "CASE WHEN event_type = 'Shot' AND k % 17 <> 0 THEN value / 500.0D END AS xg",
            "(event_type <> 'Ball Recovery' AND k % 10 < 8) AS validated_anchor",
            "k % 10 <> 9 AS linked",
        )

    @cached_property
    def rich(self) -> DataFrame:
        """The stream with more event types and provider context, from the same columns."""
        return self.ev.selectExpr(
            "* EXCEPT (event_type)",
            "CASE WHEN event_type = 'Pressure' THEN CASE k % 6 WHEN 0 THEN 'Interception' WHEN 1 THEN 'Ball Receipt*' "
            "WHEN 2 THEN 'Dribble' WHEN 3 THEN 'Clearance' WHEN 4 THEN 'Miscontrol' ELSE 'Pressure' END "
            "WHEN event_type = 'Ball Recovery' THEN CASE k % 8 WHEN 7 THEN 'Foul Won' WHEN 6 THEN 'Offside' "
            "WHEN 5 THEN 'Goal Keeper' WHEN 4 THEN 'Substitution' ELSE 'Ball Recovery' END ELSE event_type END AS event_type",
            "CASE WHEN event_type = 'Pass' AND k % 11 = 0 THEN CASE k % 3 WHEN 0 THEN 'Corner' WHEN 1 THEN 'Throw-in' "
            "ELSE 'Recovery' END END AS pass_type",
            "k % 13 = 0 AS is_out",
            "k % 17 = 3 AS counterpress",
            "k % 2 = 0 AS advantage",
        ).selectExpr(
            "*",
            "CASE WHEN event_type = 'Interception' THEN CASE WHEN k % 4 = 0 THEN 'Won' ELSE 'Lost' END END AS interception_outcome",
            "CASE WHEN event_type = 'Ball Receipt*' AND k % 7 = 2 THEN 'Incomplete' END AS receipt_outcome",
            "CAST(NULL AS STRING) AS duel_outcome",
            "CASE WHEN event_type = 'Goal Keeper' THEN CASE WHEN k % 3 = 0 THEN 'Collected' ELSE 'Saved' END END AS keeper_type",
            "event_type = 'Ball Recovery' AND k % 5 = 0 AS recovery_failure",
            "CASE WHEN event_type = 'Dribble' THEN CASE WHEN k % 4 = 0 THEN 'Complete' ELSE 'Incomplete' END END AS dribble_outcome",
        )

    @cached_property
    def own(self) -> DataFrame:
        """Own possessions only; each is one spell."""
        return self.ev.where(F.col("possession_team_id") == OWN)

    @cached_property
    def frames(self) -> DataFrame:
        """One row per snapshot; the points stay an array, so nothing is shuffled."""
        return self.table("embeddings").selectExpr(
            "vec_id AS frame_id",
            "label",
            "transform(sequence(0, CAST(size(embedding) DIV 2 AS INT) - 1), i -> named_struct("
            "'i', i, "
            "'x', 60.0D + 160.0D * CAST(embedding[2 * i] AS DOUBLE), "
            "'y', 40.0D + 110.0D * CAST(embedding[2 * i + 1] AS DOUBLE), "
            "'teammate', (i + label) % 2 = 0, 'keeper', (i = 0 OR i = 1), 'actor', i = 2)) AS points",
        )

    @cached_property
    def rough(self) -> DataFrame:
        """Snapshots with the defects real data has: null flags, missing coordinates,
        coincident records, second actors, absent containers and broken polygons."""
        x = "60.0D + 160.0D * CAST(embedding[2 * ({j})] AS DOUBLE)"
        y = "40.0D + 110.0D * CAST(embedding[2 * ({j}) + 1] AS DOUBLE)"
        j = "CASE WHEN i = 5 AND vec_id % 9 = 0 THEN 4 ELSE i END"
        x0 = x.format(j=2)
        return self.table("embeddings").selectExpr(
            "vec_id AS frame_id",
            "CAST(vec_id % 12 AS INT) AS match_id",
            "CASE label % 4 WHEN 0 THEN 'Pass' WHEN 1 THEN 'Carry' WHEN 2 THEN 'Shot' ELSE 'Pressure' END AS event_type",
            "CASE WHEN vec_id % 37 = 5 THEN NULL ELSE transform(sequence(0, CAST(size(embedding) DIV 2 AS INT) - 1), i -> named_struct("
            f"'i', i, 'x', CASE WHEN vec_id % 8 NOT IN (1, 2) OR (vec_id * 3 + i) % 31 <> 0 THEN {x.format(j=j)} END, "
            f"'y', {y.format(j=j)}, "
            "'teammate', CASE WHEN vec_id % 8 NOT IN (2, 3) OR (vec_id + i) % 23 <> 0 THEN (i + label) % 2 = 0 END, "
            "'keeper', CASE WHEN vec_id % 8 <> 3 OR (vec_id + i) % 17 <> 0 THEN (i = 0 OR i = 1) END, "
            "'actor', CASE WHEN vec_id % 8 <> 5 OR (vec_id + i) % 29 <> 0 THEN (i = 2 OR (i = 6 AND vec_id % 13 = 0)) END)) END AS points",
            f"{x0} AS x0",
        ).withColumn(
            "visible_area",
            F.expr(
                "CASE frame_id % 11 WHEN 0 THEN NULL "
                "WHEN 1 THEN array(x0 - 30, 0.0D, x0 + 30, 0.0D, x0 + 40, 80.0D, x0 - 40) "
                "WHEN 2 THEN array(x0 - 30, 0.0D, x0 + 30, 0.0D, x0 - 40, 80.0D, x0 + 40, 80.0D) "
                "WHEN 3 THEN array(x0 - 30, 0.0D, x0 + 30, 0.0D) "
                "ELSE array(x0 - 30, 0.0D, x0 + 30, 0.0D, x0 + 40, 80.0D, x0 - 40, 80.0D) END"
            ),
        )

    @cached_property
    def matches(self) -> DataFrame:
        """Two teams per match; one match has neither of ours."""
        return self.ev.select("match_id").distinct().selectExpr(
            "match_id",
            "date_add(DATE'2024-01-01', match_id) AS match_date",
            f"CASE WHEN match_id = 11 THEN {OTHER} WHEN match_id % 2 = 0 THEN {OWN} ELSE {OTHER} END AS home_team_id",
            f"CASE WHEN match_id = 11 THEN 20 WHEN match_id % 2 = 0 THEN {OTHER} ELSE {OWN} END AS away_team_id",
        )

    @cached_property
    def event_frames(self) -> DataFrame:
        """Every linked event with the snapshot it points to; one snapshot serves many events."""
        return self.frames_of(self.ev)

    def frames_of(self, events: DataFrame) -> DataFrame:
        """``event_frames`` of some events of the stream; a row depends on its own event only."""
        rough = self.rough.drop("match_id", "event_type")
        joined = events.where("linked").withColumn("frame_id", F.col("event_id") % self.n_frames).join(rough, "frame_id")
        home = f"CASE WHEN match_id = 11 THEN {OTHER} WHEN match_id % 2 = 0 THEN {OWN} ELSE {OTHER} END"
        away = f"CASE WHEN match_id = 11 THEN 20 WHEN match_id % 2 = 0 THEN {OTHER} ELSE {OWN} END"
        at = "CASE WHEN k % 23 <> 0 THEN CASE WHEN k % 4 = 0 AND points IS NOT NULL THEN points[2].{c} ELSE start_{c} END END"
        return joined.selectExpr(
            "*",
            f"{at.format(c='x')} AS loc_x",
            f"{at.format(c='y')} AS loc_y",
            "CASE WHEN k % 31 = 30 THEN 'old' ELSE 'r1' END AS source_revision",
            "CASE WHEN event_id % 50 = 7 THEN 'ambiguous' ELSE 'unique' END AS link",
            f"{home} AS home_team_id",
            f"{away} AS away_team_id",
            "CASE WHEN k % 37 <> 36 THEN k % 29 = 28 END AS label_conflict",
        )

    @cached_property
    def raw_ids(self) -> DataFrame:
        """Events under provider ids: some blank, some repeated."""
        return self.ev.selectExpr(
            "*",
            "CASE WHEN event_id % 53 = 11 THEN ' ' WHEN event_id % 50 = 7 THEN CAST(event_id - 1 AS STRING) "
            "ELSE CAST(event_id AS STRING) END AS id",
            "start_x AS loc_x",
            "start_y AS loc_y",
        )

    @cached_property
    def raw_frames(self) -> DataFrame:
        """Frames under provider ids: blank, orphan and repeated ones included."""
        rough = self.rough.drop("match_id", "event_type")
        return (
            self.ev.where("linked")
            .selectExpr(
                "match_id",
                "event_id AS frame_ordinal",
                "CASE WHEN event_id % 41 = 3 THEN ' ' WHEN event_id % 43 = 5 THEN concat('orphan-', event_id) "
                "WHEN event_id % 47 = 9 THEN CAST(event_id - 1 AS STRING) ELSE CAST(event_id AS STRING) END AS event_uuid",
                f"event_id % {self.n_frames} AS frame_id",
            )
            .join(rough, "frame_id")
        )


EV = f"""ev AS (
 WITH b AS (
  SELECT event_id, epoch_us(ts) AS t_us, CASE WHEN day(ts) <= 15 THEN 1 ELSE 2 END AS period,
   CAST(user_id % 12 AS INT) AS match_id, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
   CASE event_type WHEN 'view' THEN 'Pass' WHEN 'click' THEN 'Carry' WHEN 'purchase' THEN 'Shot'
    WHEN 'error' THEN 'Pressure' ELSE 'Ball Recovery' END AS etype FROM events),
 o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY t_us, event_id) AS event_index FROM b),
 p AS (SELECT *, CAST(FLOOR((event_index - 1) / 24.0) AS BIGINT) AS possession_id FROM o)
 SELECT match_id, period, possession_id, CASE WHEN possession_id % 4 = 3 THEN {OTHER} ELSE {OWN} END AS possession_team_id,
  event_id, event_index, t_us, etype AS event_type,
  CASE WHEN (event_id * 7 + k) % 5 = 0 THEN {OTHER} ELSE {OWN} END AS event_team_id, k,
  value % 120.0 AS start_x, (value * 3.0) % 80.0 AS start_y,
  CASE WHEN k % 19 <> 0 THEN value % 120.0 + (k - 50) * 0.5 END AS end_x,
  CASE WHEN k % 19 <> 0 THEN (value * 3.0) % 80.0 + (k % 21 - 10) * 0.5 END AS end_y,
  CASE WHEN etype = 'Pass' AND k % 7 = 0 THEN 'Incomplete' END AS pass_outcome,
  CASE WHEN etype = 'Shot' AND k % 17 <> 0 THEN value / 500.0 END AS xg,
  (etype <> 'Ball Recovery' AND k % 10 < 8) AS validated_anchor, k % 10 <> 9 AS linked FROM p)"""

RICH = """rich AS (SELECT *, CASE WHEN event_type = 'Interception' THEN CASE WHEN k % 4 = 0 THEN 'Won' ELSE 'Lost' END END AS interception_outcome,
  CASE WHEN event_type = 'Ball Receipt*' AND k % 7 = 2 THEN 'Incomplete' END AS receipt_outcome,
  CASE WHEN event_type = 'Goal Keeper' THEN CASE WHEN k % 3 = 0 THEN 'Collected' ELSE 'Saved' END END AS keeper_type,
  event_type = 'Ball Recovery' AND k % 5 = 0 AS recovery_failure,
  CASE WHEN event_type = 'Dribble' THEN CASE WHEN k % 4 = 0 THEN 'Complete' ELSE 'Incomplete' END END AS dribble_outcome
 FROM (SELECT * REPLACE (CASE WHEN event_type = 'Pressure' THEN CASE k % 6 WHEN 0 THEN 'Interception' WHEN 1 THEN 'Ball Receipt*'
   WHEN 2 THEN 'Dribble' WHEN 3 THEN 'Clearance' WHEN 4 THEN 'Miscontrol' ELSE 'Pressure' END
   WHEN event_type = 'Ball Recovery' THEN CASE k % 8 WHEN 7 THEN 'Foul Won' WHEN 6 THEN 'Offside' WHEN 5 THEN 'Goal Keeper'
   WHEN 4 THEN 'Substitution' ELSE 'Ball Recovery' END ELSE event_type END AS event_type),
   CASE WHEN event_type = 'Pass' AND k % 11 = 0 THEN CASE k % 3 WHEN 0 THEN 'Corner' WHEN 1 THEN 'Throw-in' ELSE 'Recovery' END END AS pass_type,
   k % 13 = 0 AS is_out, k % 17 = 3 AS counterpress, k % 2 = 0 AS advantage FROM ev)),
 sg AS (SELECT *, list_filter([CASE WHEN event_type IN ('Shot', 'Foul Won', 'Foul Committed', 'Offside', 'Injury Stoppage', 'Referee Ball-Drop',
   'Half End', 'Half Start', 'Dispossessed', 'Miscontrol', 'Interception', 'Ball Recovery', 'Duel', 'Block', 'Clearance') THEN 'type:' || event_type END,
   CASE WHEN is_out THEN 'out:true' END, CASE WHEN counterpress THEN 'counterpress:true' END,
   'pass.outcome:' || pass_outcome, 'interception.outcome:' || interception_outcome, 'ball_receipt.outcome:' || receipt_outcome,
   'pass.type:' || pass_type], lambda z: z IS NOT NULL) AS signals FROM rich)"""

OWN_EV = f"own AS (SELECT * FROM ev WHERE possession_team_id = {OWN})"

PT = """pt AS (
 SELECT vec_id AS frame_id, label, i, 60.0E0 + 160.0E0 * CAST(list_extract(embedding, 2*i+1) AS DOUBLE) AS x,
  40.0E0 + 110.0E0 * CAST(list_extract(embedding, 2*i+2) AS DOUBLE) AS y,
  (i + label) % 2 = 0 AS teammate, (i = 0 OR i = 1) AS keeper, i = 2 AS actor
 FROM embeddings CROSS JOIN (SELECT CAST(range AS INT) AS i FROM range(32)) AS n WHERE 2 * i + 1 < len(embedding))"""

RPT = """pt AS (
 SELECT vec_id AS frame_id, CAST(vec_id % 12 AS INT) AS match_id,
  CASE label % 4 WHEN 0 THEN 'Pass' WHEN 1 THEN 'Carry' WHEN 2 THEN 'Shot' ELSE 'Pressure' END AS event_type, label, i,
  CASE WHEN vec_id % 8 NOT IN (1, 2) OR (vec_id * 3 + i) % 31 <> 0 THEN 60.0E0 + 160.0E0 * CAST(list_extract(embedding, 2*j+1) AS DOUBLE) END AS x,
  40.0E0 + 110.0E0 * CAST(list_extract(embedding, 2*j+2) AS DOUBLE) AS y,
  CASE WHEN vec_id % 8 NOT IN (2, 3) OR (vec_id + i) % 23 <> 0 THEN (i + label) % 2 = 0 END AS teammate,
  CASE WHEN vec_id % 8 <> 3 OR (vec_id + i) % 17 <> 0 THEN (i = 0 OR i = 1) END AS keeper,
  CASE WHEN vec_id % 8 <> 5 OR (vec_id + i) % 29 <> 0 THEN (i = 2 OR (i = 6 AND vec_id % 13 = 0)) END AS actor
 FROM (SELECT *, CASE WHEN i = 5 AND vec_id % 9 = 0 THEN 4 ELSE i END AS j FROM embeddings
  CROSS JOIN (SELECT CAST(range AS INT) AS i FROM range(32)) AS n) WHERE 2 * i + 1 < len(embedding) AND vec_id % 37 <> 5),
 fr AS (SELECT vec_id AS frame_id, CAST(vec_id % 12 AS INT) AS match_id,
  CASE label % 4 WHEN 0 THEN 'Pass' WHEN 1 THEN 'Carry' WHEN 2 THEN 'Shot' ELSE 'Pressure' END AS event_type,
  vec_id % 37 <> 5 AS available, 60.0E0 + 160.0E0 * CAST(list_extract(embedding, 5) AS DOUBLE) AS x0,
  CASE vec_id % 11 WHEN 0 THEN 'missing' WHEN 1 THEN 'malformed' WHEN 2 THEN 'invalid' WHEN 3 THEN 'malformed' ELSE 'valid' END
   AS polygon_status FROM embeddings)"""

VAR = """variant AS (
 SELECT * FROM (VALUES ('all_visible'), ('teammate_true'), ('teammate_false')) s(selected_subset),
  (VALUES ('included'), ('excluded')) g(goalkeeper_policy)),
 vp AS (SELECT v.selected_subset, v.goalkeeper_policy, pt.* FROM pt, variant v
  WHERE x IS NOT NULL AND (v.selected_subset = 'all_visible' OR teammate = (v.selected_subset = 'teammate_true'))
   AND (v.goalkeeper_policy = 'included' OR NOT keeper)),
 fv AS (SELECT fr.*, v.* FROM fr, variant v),
 b1 AS (SELECT frame_id, selected_subset, goalkeeper_policy, COUNT(*) AS n, COUNT(DISTINCT (x, y)) AS u,
   AVG(x) AS cx, AVG(y) AS cy, MAX(y) - MIN(y) AS w, MAX(x) - MIN(x) AS d,
   COUNT(*) FILTER (NOT (x BETWEEN 0 AND 120 AND y BETWEEN 0 AND 80)) AS oob FROM vp GROUP BY ALL),
 b2 AS (SELECT p.frame_id, p.selected_subset, p.goalkeeper_policy, AVG(sqrt((p.x-q.x)**2 + (p.y-q.y)**2)) AS mp,
   MEDIAN(sqrt((p.x-q.x)**2 + (p.y-q.y)**2)) AS md FROM vp p JOIN vp q
   ON p.frame_id = q.frame_id AND p.selected_subset = q.selected_subset AND p.goalkeeper_policy = q.goalkeeper_policy AND p.i < q.i
   GROUP BY ALL),
 b3 AS (SELECT frame_id, selected_subset, goalkeeper_policy, AVG(m) AS nn FROM (
   SELECT p.frame_id, p.selected_subset, p.goalkeeper_policy, p.i, MIN(sqrt((p.x-q.x)**2 + (p.y-q.y)**2)) AS m FROM vp p JOIN vp q
   ON p.frame_id = q.frame_id AND p.selected_subset = q.selected_subset AND p.goalkeeper_policy = q.goalkeeper_policy AND p.i <> q.i
   GROUP BY ALL) GROUP BY ALL),
 vu AS (SELECT DISTINCT frame_id, selected_subset, goalkeeper_policy, x, y FROM vp),
 b4 AS (SELECT frame_id, selected_subset, goalkeeper_policy, SUM(px*qy - qx*py) / 2 AS hull FROM (
   SELECT p.frame_id, p.selected_subset, p.goalkeeper_policy, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy,
    MIN((q.x-p.x)*(r.y-p.y) - (q.y-p.y)*(r.x-p.x)) AS side FROM vu p
   JOIN vu q ON p.frame_id = q.frame_id AND p.selected_subset = q.selected_subset AND p.goalkeeper_policy = q.goalkeeper_policy
    AND (p.x <> q.x OR p.y <> q.y)
   JOIN vu r ON p.frame_id = r.frame_id AND p.selected_subset = r.selected_subset AND p.goalkeeper_policy = r.goalkeeper_policy
    AND (p.x <> r.x OR p.y <> r.y) AND (q.x <> r.x OR q.y <> r.y)
   GROUP BY ALL) WHERE side > 0 GROUP BY ALL),
 ke AS (SELECT frame_id, s.selected_subset, COUNT(*) FILTER (keeper) AS kt, COUNT(*) FILTER (keeper IS NULL) AS ku FROM pt,
   (VALUES ('all_visible'), ('teammate_true'), ('teammate_false')) s(selected_subset)
   WHERE x IS NOT NULL AND (s.selected_subset = 'all_visible' OR teammate = (s.selected_subset = 'teammate_true')) GROUP BY ALL),
 geo AS (SELECT fv.frame_id, fv.match_id, fv.event_type, fv.available, fv.x0, fv.polygon_status, fv.selected_subset, fv.goalkeeper_policy,
   CASE WHEN available THEN COALESCE(n, 0) END AS n_valid_points_used, CASE WHEN available THEN COALESCE(u, 0) END AS n_unique_points,
   CASE WHEN available THEN COALESCE(n - u, 0) END AS n_coincident_records,
   CASE WHEN available THEN COALESCE(oob, 0) END AS n_out_of_bounds_points,
   CASE WHEN available THEN COALESCE(kt, 0) END AS n_keeper_true_before_filter,
   CASE WHEN available THEN COALESCE(ku, 0) END AS n_keeper_unknown_before_filter,
   CASE WHEN available THEN CASE WHEN fv.goalkeeper_policy = 'excluded' THEN COALESCE(kt, 0) ELSE 0 END END AS n_keeper_true_excluded,
   CASE WHEN available THEN CASE WHEN fv.goalkeeper_policy = 'excluded' THEN COALESCE(ku, 0) ELSE 0 END END AS n_keeper_unknown_excluded,
   CASE WHEN available THEN COALESCE(n, 0)::DOUBLE END AS point_count, cx AS centroid_x, cy AS centroid_y, w AS width, d AS depth,
   hull AS hull_area, mp AS mean_pair_distance, md AS median_pair_distance, nn AS mean_nearest_distance
  FROM fv LEFT JOIN b1 USING (frame_id, selected_subset, goalkeeper_policy) LEFT JOIN b2 USING (frame_id, selected_subset, goalkeeper_policy)
   LEFT JOIN b3 USING (frame_id, selected_subset, goalkeeper_policy) LEFT JOIN b4 USING (frame_id, selected_subset, goalkeeper_policy)
   LEFT JOIN ke USING (frame_id, selected_subset))"""

GEO_METRICS = (
    "point_count", "centroid_x", "centroid_y", "width", "depth", "hull_area",
    "mean_pair_distance", "median_pair_distance", "mean_nearest_distance",
)


def _status_sql(m: str) -> str:
    if m == "point_count":
        tail = "'ok'"
    elif m in ("centroid_x", "centroid_y", "width", "depth"):
        tail = "CASE WHEN n_valid_points_used = 0 THEN 'empty_points' ELSE 'ok' END"
    elif m == "hull_area":
        tail = (
            "CASE WHEN n_valid_points_used < 3 THEN 'insufficient_points' "
            "WHEN n_unique_points < 3 THEN 'insufficient_unique_points' ELSE 'ok' END"
        )
    else:
        tail = "CASE WHEN n_valid_points_used < 2 THEN 'insufficient_points' ELSE 'ok' END"
    return f"CASE WHEN NOT available THEN 'frame_unavailable' ELSE {tail} END"


MATCHES = f"""matches AS (SELECT DISTINCT match_id, DATE '2024-01-01' + match_id AS match_date,
  CASE WHEN match_id = 11 THEN {OTHER} WHEN match_id % 2 = 0 THEN {OWN} ELSE {OTHER} END AS home_team_id,
  CASE WHEN match_id = 11 THEN 20 WHEN match_id % 2 = 0 THEN {OTHER} ELSE {OWN} END AS away_team_id FROM ev)"""

#: per-snapshot tallies over ``pt``
TALLY = """pc AS (SELECT frame_id, COUNT(*) AS n_all, COUNT(x) AS n_ok, COUNT(*) FILTER (x IS NULL) AS bad,
  COUNT(*) FILTER (teammate) AS t_all, COUNT(*) FILTER (NOT teammate) AS f_all, COUNT(*) FILTER (teammate IS NULL) AS u_all,
  COUNT(*) FILTER (keeper) AS keepers, COUNT(*) FILTER (actor) AS actors_all,
  COUNT(*) FILTER (teammate AND x IS NOT NULL) AS t_ok, COUNT(*) FILTER (NOT teammate AND x IS NOT NULL) AS f_ok,
  COUNT(*) FILTER (teammate IS NULL AND x IS NOT NULL) AS u_ok, COUNT(*) FILTER (keeper IS NULL AND x IS NOT NULL) AS uk_ok,
  COUNT(*) FILTER (actor IS NULL AND x IS NOT NULL) AS ua_ok, COUNT(*) FILTER (actor AND x IS NOT NULL) AS a_ok,
  COUNT(*) FILTER (actor AND teammate AND x IS NOT NULL) AS at_ok, COUNT(*) FILTER (actor AND NOT teammate AND x IS NOT NULL) AS af_ok,
  MAX(x) FILTER (actor) AS ax, MAX(y) FILTER (actor AND x IS NOT NULL) AS ay,
  COUNT(*) FILTER (keeper AND teammate AND x IS NOT NULL) AS kt_n, AVG(x) FILTER (keeper AND teammate) AS kt_x,
  COUNT(*) FILTER (keeper AND NOT teammate AND x IS NOT NULL) AS kf_n, AVG(x) FILTER (keeper AND NOT teammate) AS kf_x
  FROM pt GROUP BY frame_id)"""

EF = f"""ef AS (SELECT e.*, fr.available, fr.polygon_status, fr.x0, pc.* EXCLUDE (frame_id),
  CASE WHEN k % 23 <> 0 THEN CASE WHEN k % 4 = 0 AND available THEN a2.x ELSE start_x END END AS loc_x,
  CASE WHEN k % 23 <> 0 THEN CASE WHEN k % 4 = 0 AND available THEN a2.y ELSE start_y END END AS loc_y,
  CASE WHEN k % 31 = 30 THEN 'old' ELSE 'r1' END AS source_revision,
  CASE WHEN event_id % 50 = 7 THEN 'ambiguous' ELSE 'unique' END AS link,
  CASE WHEN e.match_id = 11 THEN {OTHER} WHEN e.match_id % 2 = 0 THEN {OWN} ELSE {OTHER} END AS home_team_id,
  CASE WHEN e.match_id = 11 THEN 20 WHEN e.match_id % 2 = 0 THEN {OTHER} ELSE {OWN} END AS away_team_id,
  CASE WHEN k % 37 <> 36 THEN k % 29 = 28 END AS label_conflict
 FROM (SELECT *, event_id % (SELECT COUNT(*) FROM embeddings) AS frame_id FROM ev WHERE linked) e
 JOIN fr USING (frame_id) LEFT JOIN pc USING (frame_id) LEFT JOIN (SELECT frame_id, x, y FROM pt WHERE i = 2) a2 USING (frame_id))"""

RAW = """aev AS (SELECT *, start_x AS loc_x, start_y AS loc_y, CASE WHEN event_id % 53 = 11 THEN NULL
   WHEN event_id % 50 = 7 THEN CAST(event_id - 1 AS VARCHAR) ELSE CAST(event_id AS VARCHAR) END AS id FROM ev),
 afr AS (SELECT match_id, event_id AS frame_ordinal, event_id % (SELECT COUNT(*) FROM embeddings) AS frame_id,
   CASE WHEN event_id % 41 = 3 THEN NULL WHEN event_id % 43 = 5 THEN 'orphan-' || event_id
   WHEN event_id % 47 = 9 THEN CAST(event_id - 1 AS VARCHAR) ELSE CAST(event_id AS VARCHAR) END AS event_uuid FROM ev WHERE linked),
 ecn AS (SELECT match_id, id, COUNT(*) AS n, ANY_VALUE(event_type) AS event_type, ANY_VALUE(event_team_id) AS event_team_id,
   ANY_VALUE(loc_x) AS loc_x, ANY_VALUE(loc_y) AS loc_y FROM aev WHERE id IS NOT NULL GROUP BY ALL),
 fcn AS (SELECT match_id, event_uuid, COUNT(*) AS n FROM afr WHERE event_uuid IS NOT NULL GROUP BY ALL),
 lk AS (SELECT f.*, COALESCE(e.n, 0) AS matching_event_records, COALESCE(c.n, 0) AS frame_uuid_records,
   CASE WHEN e.n = 1 THEN 'unique' WHEN e.n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS event_link_status,
   CASE WHEN e.n = 1 THEN e.event_type END AS event_type, CASE WHEN e.n = 1 THEN e.event_team_id END AS event_team_id,
   CASE WHEN e.n = 1 THEN e.loc_x END AS loc_x, CASE WHEN e.n = 1 THEN e.loc_y END AS loc_y
  FROM afr f LEFT JOIN ecn e ON f.match_id = e.match_id AND f.event_uuid = e.id
   LEFT JOIN fcn c ON f.match_id = c.match_id AND f.event_uuid = c.event_uuid)"""

#: long form of ``geo``: one row per variant and metric
LONG = "gl AS (" + " UNION ALL ".join(
    f"SELECT * EXCLUDE ({', '.join(GEO_METRICS)}), '{m}' AS metric, {m} AS value, {_status_sql(m)} AS status FROM geo"
    for m in GEO_METRICS
) + ")"


def sql(body: str, *bases: str) -> str:
    """Prefix the shared views; ``body`` is a SELECT or further CTEs and a SELECT."""
    body = body.strip()
    head = "WITH RECURSIVE " + ", ".join(bases)
    return f"{head} {body}" if body.upper().startswith("SELECT") else f"{head}, {body}"
