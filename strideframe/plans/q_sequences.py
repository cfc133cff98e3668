"""Possession, anchor and gap queries over the event stream."""

from pyspark.sql import functions as F

from strideframe.operators import expectations as X
from strideframe.operators import sequences as S
from strideframe.operators.quantiles import exact_quantiles
from strideframe.plans.fixtures import EV, HOUR_US, KEY, OWN, OWN_EV, sql
from strideframe.plans.registry import query
from strideframe.sources.stage import durable

K = ", ".join(KEY)

POSS = f"""poss AS (SELECT {K}, MIN(event_index) AS first_event_index, MAX(event_index) AS last_event_index,
 arg_max(t_us, event_index) - arg_min(t_us, event_index) AS duration_us, COUNT(*) AS total_event_count,
 COUNT(*) FILTER (linked) AS linked_count, COUNT(*) FILTER (validated_anchor) AS anchor_count,
 MIN(t_us) FILTER (validated_anchor) AS first_anchor_us, MAX(t_us) FILTER (validated_anchor) AS last_anchor_us,
 COUNT(*) FILTER (validated_anchor AND event_type = 'Pass') AS anchor_count_pass,
 COUNT(*) FILTER (validated_anchor AND event_type = 'Carry') AS anchor_count_carry,
 COUNT(*) FILTER (validated_anchor AND event_type = 'Pressure') AS anchor_count_pressure,
 COUNT(*) FILTER (validated_anchor AND event_type = 'Shot') AS anchor_count_shot,
 COUNT(*) FILTER (validated_anchor AND event_team_id <> {OWN}) AS opponent_anchor_count,
 COUNT(*) FILTER (event_type = 'Shot' AND event_team_id = {OWN}) AS own_shot_count,
 COUNT(*) FILTER (event_type = 'Shot' AND event_team_id <> {OWN}) AS opponent_shot_count,
 COUNT(*) FILTER (event_type = 'Shot') > 0 AS has_shot,
 arg_max(event_type, event_index) AS final_event_type,
 arg_max(event_type, event_index) = 'Shot' AS ends_in_shot
 FROM own GROUP BY {K})"""

GAPS = f"""anc AS (SELECT * FROM own WHERE validated_anchor),
 g0 AS (SELECT *, LAG(event_index) OVER w AS pi, LAG(t_us) OVER w AS pt, LAG(event_type) OVER w AS pty,
  LAG(event_team_id) OVER w AS pte FROM anc WINDOW w AS (PARTITION BY {K} ORDER BY event_index)),
 gaps AS (SELECT {K}, pi AS previous_event_index, event_index AS next_event_index, event_index - pi AS event_index_gap,
  event_index - pi - 1 AS intervening_event_count, (t_us - pt) / 1e6 AS elapsed_seconds, pty AS previous_anchor_type,
  event_type AS next_anchor_type, pte AS previous_event_team_id, event_team_id AS next_event_team_id
  FROM g0 WHERE pi IS NOT NULL)"""


def poss(fx):
    return S.possession_inventory(fx.own, KEY, OWN)


def gaps(fx):
    return S.anchor_gaps(fx.own, fx.lane(*KEY))


def frames_of(fx):
    """One frame record per linked event, as a separate table keyed by event id."""
    return fx.ev.where("linked").selectExpr(
        "match_id",
        "event_id AS event_uuid",
        "CASE WHEN validated_anchor THEN 'validated' ELSE 'unsupported_type' END AS semantics_status",
    )


@query(
    "seq1_event_inventory",
    sql(
        f"""SELECT {K}, event_id, event_index, event_type, event_team_id, linked AS linked_360,
 CASE WHEN NOT linked THEN 'no_360_frame' WHEN validated_anchor THEN 'validated' ELSE 'unsupported_type' END AS semantics_status,
 linked AND validated_anchor AS is_anchor, event_type = 'Shot' AS is_shot,
 ROW_NUMBER() OVER (PARTITION BY {K} ORDER BY event_index) - 1 AS event_position FROM ev""",
        EV,
    ),
)
def seq1(fx):
    out = S.event_inventory(fx.ev, frames_of(fx), fx.lane(*KEY))
    return out.select(
        *KEY, "event_id", "event_index", "event_type", "event_team_id", "linked_360", "semantics_status",
        "is_anchor", "is_shot", "event_position",
    )


@query(
    "seq2_possession_inventory",
    sql(
        POSS
        + """ SELECT *, last_anchor_us - first_anchor_us AS anchor_span_us, linked_count - anchor_count AS unsupported_count,
 CASE WHEN linked_count > 0 THEN ROUND(anchor_count / linked_count, 6) END AS proportion_validated FROM poss""",
        EV,
        OWN_EV,
    ),
)
def seq2(fx):
    return poss(fx).withColumn("proportion_validated", F.round("proportion_validated", 6))


@query("seq3_anchor_gaps", sql(GAPS + " SELECT * FROM gaps", EV, OWN_EV))
def seq3(fx):
    return gaps(fx)


_LEVEL_SQL = " UNION ALL ".join(
    f"SELECT '{p}' AS population, '{'zero' if n == 0 else f'>={n}'}' AS anchor_requirement, "
    f"COUNT(*) FILTER (anchor_count {'= 0' if n == 0 else f'>= {n}'}) AS possession_count, COUNT(*) AS denominator, "
    f"ROUND(100.0 * COUNT(*) FILTER (anchor_count {'= 0' if n == 0 else f'>= {n}'}) / NULLIF(COUNT(*), 0), 6) AS percentage "
    f"FROM poss WHERE {w}"
    for p, w in (("all", "TRUE"), ("shot_containing", "has_shot"))
    for n in (0, *S.LEVELS)
)


@query("seq4_coverage_levels", sql(f"{POSS} {_LEVEL_SQL}", EV, OWN_EV))
def seq4(fx):
    return S.coverage_levels(poss(fx), {"all": F.lit(True), "shot_containing": F.col("has_shot")})


TUPLES = [(n, h * HOUR_US) for n in (2, 3) for h in (2, 6, 12, 24)]
ANY = [(3, 12 * HOUR_US), (4, 12 * HOUR_US), (3, 24 * HOUR_US)]
_TUPLE_SQL = " UNION ALL ".join(
    [
        f"SELECT 'consecutive_anchor_tuples' AS unit, {n} AS states, {s} AS window_us, "
        f"COUNT(*) FILTER (t_us - t{n} <= {s}) AS count FROM tt"
        for n, s in TUPLES
    ]
    + [
        f"SELECT 'possessions_with_any_tuple', {n}, {s}, COUNT(DISTINCT ({K})) FILTER (t_us - t{n} <= {s}) FROM tt"
        for n, s in ANY
    ]
)


@query(
    "seq5_temporal_tuples",
    sql(
        f"""tt AS (SELECT *, LAG(t_us, 1) OVER w AS t2, LAG(t_us, 2) OVER w AS t3, LAG(t_us, 3) OVER w AS t4
 FROM own WHERE validated_anchor WINDOW w AS (PARTITION BY {K} ORDER BY event_index)) {_TUPLE_SQL}""",
        EV,
        OWN_EV,
    ),
)
def seq5(fx):
    return S.temporal_tuples(fx.own, fx.lane(*KEY), TUPLES, ANY)


LIMITS = [600.0, 3600.0, 21600.0, 43200.0]


@query(
    "seq6_gap_thresholds",
    sql(
        GAPS
        + " "
        + " UNION ALL ".join(
            f"SELECT {s}::DOUBLE AS seconds, COUNT(*) FILTER (elapsed_seconds <= {s}) AS interval_count, COUNT(*) AS denominator, "
            f"ROUND(100.0 * COUNT(*) FILTER (elapsed_seconds <= {s}) / COUNT(*), 6) AS percentage FROM gaps"
            for s in LIMITS
        ),
        EV,
        OWN_EV,
    ),
)
def seq6a(fx):
    return S.gap_thresholds(gaps(fx), "elapsed_seconds", LIMITS)


def dist_sql(v, r=6):
    q = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
    return (
        f"COUNT({v}) AS count, ROUND(AVG({v}), {r}) AS mean, ROUND(STDDEV_SAMP({v}), {r}) AS std, "
        f"ROUND(MIN({v}), {r}) AS min, ROUND(MAX({v}), {r}) AS max, "
        + ", ".join(f"ROUND(QUANTILE_CONT({v}, {p}), {r}) AS {n}" for n, p in q.items())
    )


def rounded(df, r=6, skip=("count",)):
    return df.withColumns({c: F.round(c, r) for c, t in df.dtypes if t in ("double", "float") and c not in skip})


@query(
    "seq6_distributions",
    sql(
        f"""{GAPS}, m AS (SELECT 'anchor_time_gap_seconds' AS measure, elapsed_seconds AS v FROM gaps
 UNION ALL SELECT 'event_index_gap', event_index_gap::DOUBLE FROM gaps
 UNION ALL SELECT 'intervening_events', intervening_event_count::DOUBLE FROM gaps)
 SELECT measure, {dist_sql('v', 4)} FROM m GROUP BY measure""",
        EV,
        OWN_EV,
    ),
)
def seq6b(fx):
    return rounded(
        S.measure_distributions(
            gaps(fx),
            {
                "anchor_time_gap_seconds": "elapsed_seconds",
                "event_index_gap": "event_index_gap",
                "intervening_events": "intervening_event_count",
            },
            fx.small,
        ),
        4,
    )


_COVER = "COUNT(*) AS possession_count, ROUND(AVG(anchor_count), 6) AS mean_anchors, " + ", ".join(
    f"ROUND(100.0 * AVG(CASE WHEN anchor_count >= {n} THEN 1 ELSE 0 END), 6) AS pct_ge_{n}_anchors" for n in S.LEVELS
)


@query(
    "seq7_match_coverage",
    sql(
        f"""{POSS}, {GAPS}, c AS (SELECT match_id, {_COVER}, MEDIAN(anchor_count) AS median_anchors,
  ROUND(SUM(anchor_count) / NULLIF(SUM(linked_count), 0), 6) AS proportion_validated FROM poss GROUP BY match_id),
 q AS (SELECT match_id, ROUND(QUANTILE_CONT(elapsed_seconds, 0.5), 4) AS median_anchor_gap_seconds,
  ROUND(QUANTILE_CONT(elapsed_seconds, 0.9), 4) AS p90_anchor_gap_seconds FROM gaps GROUP BY match_id)
 SELECT c.*, median_anchor_gap_seconds, p90_anchor_gap_seconds,
  RANK() OVER (ORDER BY pct_ge_3_anchors) AS rank_ascending FROM c LEFT JOIN q USING (match_id)""",
        EV,
        OWN_EV,
    ),
)
def seq7(fx):
    out = S.match_coverage(poss(fx), gaps(fx), 3, fx.small)
    return out.withColumns({c: F.round(c, 4) for c in ("median_anchor_gap_seconds", "p90_anchor_gap_seconds")})


@query(
    "seq8_duration_bins",
    sql(
        f"""{POSS}, b AS (SELECT * FROM (VALUES (0, '[0,5)', 0, 5), (1, '[5,15)', 5, 15), (2, '[15,30)', 15, 30),
  (3, '[30,60)', 30, 60), (4, '[60,infinity)', 60, 1000000000)) t(bin, duration_bin, lo, hi))
 SELECT bin, duration_bin, COUNT(event_cnt) AS possession_count, {_COVER.split(", ", 1)[1]}, MEDIAN(event_cnt) AS median_events
 FROM b LEFT JOIN (SELECT *, total_event_count AS event_cnt FROM poss) p
  ON duration_us >= lo * 3600000000 AND duration_us < hi * 3600000000 GROUP BY bin, duration_bin""".replace(
            "CASE WHEN anchor_count >=", "CASE WHEN anchor_count IS NULL THEN NULL WHEN anchor_count >="
        ),
        EV,
        OWN_EV,
    ),
)
def seq8(fx):
    return S.duration_bins(poss(fx), S.DURATION_EDGES, HOUR_US, fx.small)


_COMP = f"""COUNT(*) AS anchor_count, COUNT(DISTINCT ({K})) AS possessions_containing, COUNT(DISTINCT match_id) AS match_count,
 ROUND(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS percentage_of_anchors FROM own WHERE validated_anchor"""


@query("seq9_composition", sql(f"SELECT event_type, {_COMP} GROUP BY event_type", EV, OWN_EV))
def seq9a(fx):
    return S.composition(fx.own.where("validated_anchor"), KEY, ["event_type"])


@query(
    "seq9_type_transitions",
    sql(
        f"""{GAPS} SELECT previous_anchor_type, next_anchor_type, COUNT(*) AS interval_count,
 ROUND(MEDIAN(elapsed_seconds), 4) AS median_gap_seconds, COUNT(DISTINCT match_id) AS match_count,
 ROUND(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS percentage_of_intervals
 FROM gaps GROUP BY previous_anchor_type, next_anchor_type""",
        EV,
        OWN_EV,
    ),
)
def seq9b(fx):
    return S.type_transitions(gaps(fx), fx.small).withColumn("median_gap_seconds", F.round("median_gap_seconds", 4))


@query("seq9_team_composition", sql(f"SELECT event_team_id, event_type, {_COMP} GROUP BY event_team_id, event_type", EV, OWN_EV))
def seq9c(fx):
    return S.composition(fx.own.where("validated_anchor"), KEY, ["event_team_id", "event_type"])


@query(
    "seq10_sequence_candidates",
    sql(
        POSS
        + " "
        + " UNION ALL ".join(
            f"SELECT {n} AS states, COUNT(*) FILTER (anchor_count >= {n}) AS capable_possessions, "
            f"CAST(SUM(GREATEST(anchor_count - {n} + 1, 0)) AS BIGINT) AS consecutive_tuples, "
            f"CAST(COALESCE(SUM(anchor_count) FILTER (anchor_count >= {n}), 0) AS BIGINT) AS states_in_capable FROM poss"
            for n in (2, 3, 4, 5, 6, 8)
        ),
        EV,
        OWN_EV,
    ),
)
def seq10(fx):
    return S.sequence_candidates(poss(fx), (2, 3, 4, 5, 6, 8))


#: condition of each rule over a possession and the limits
_RULES = {
    "maximum_anchor_count": "anchor_count = top",
    "zero_anchors": "anchor_count = 0",
    "one_anchor": "anchor_count = 1",
    "two_anchors": "anchor_count = 2",
    "moderate_anchor_count": "anchor_count BETWEEN n25 AND n75 AND anchor_count >= 3",
    "high_anchor_count": "anchor_count >= n95",
    "shot_containing": "has_shot",
    "opponent_anchor": "opponent_anchor_count > 0",
    "long_sparse": "duration_us >= d75 AND rate <= r25",
    "short_dense": "duration_us <= d25 AND rate >= r75",
}
_KEYS = ", ".join(KEY)
_PICKS = ", ".join(
    f"pk{i} AS (SELECT '{rule}' AS selection_rule, {_KEYS} FROM pl WHERE COALESCE({cond}, FALSE)"
    + "".join(f" AND ({_KEYS}) NOT IN (SELECT ({_KEYS}) FROM pk{j})" for j in range(i))
    + f" ORDER BY {_KEYS} LIMIT 1)"
    for i, (rule, cond) in enumerate(_RULES.items())
)


@query(
    "seq11_representative_possessions",
    sql(
        f"""{POSS}, pq AS (SELECT *, anchor_count / NULLIF(duration_us, 0) AS rate FROM poss),
 li AS (SELECT MAX(anchor_count) AS top, QUANTILE_CONT(anchor_count, 0.25) AS n25, QUANTILE_CONT(anchor_count, 0.75) AS n75, QUANTILE_CONT(anchor_count, 0.95) AS n95, QUANTILE_CONT(duration_us, 0.25) AS d25,
   QUANTILE_CONT(duration_us, 0.75) AS d75, QUANTILE_CONT(rate, 0.25) AS r25, QUANTILE_CONT(rate, 0.75) AS r75 FROM pq),
 pl AS (SELECT * FROM pq, li), {_PICKS}, ch AS ({" UNION ALL ".join(f"SELECT * FROM pk{i}" for i in range(len(_RULES)))})
 SELECT selection_rule, {_KEYS}, event_index, t_us, event_type, event_team_id, CASE WHEN validated_anchor THEN 'validated' WHEN linked THEN 'unsupported' ELSE 'no_360_frame' END AS spatial_status FROM own JOIN ch USING ({_KEYS})""",
        EV,
        OWN_EV,
    ),
)
def seq11(fx):
    p = durable(poss(fx).withColumn("rate", F.col("anchor_count") / F.nullif(F.col("duration_us"), F.lit(0))))
    quant = exact_quantiles(p, [], "anchor_count", {"n25": 0.25, "n75": 0.75, "n95": 0.95}, fx.small)
    dur = exact_quantiles(p, [], "duration_us", {"d25": 0.25, "d75": 0.75}, fx.small)
    rate = exact_quantiles(p, [], "rate", {"r25": 0.25, "r75": 0.75}, fx.small)
    lim = quant.crossJoin(dur).crossJoin(rate).crossJoin(p.agg(F.max("anchor_count").alias("top"))).first().asDict()
    limits = p.withColumns({name: F.lit(value) for name, value in lim.items()})
    picks = S.representative_possessions(limits, {rule: F.expr(cond) for rule, cond in _RULES.items()}, KEY)
    chosen = fx.spark.createDataFrame(
        [(x["selection_rule"], *[x[k] for k in KEY]) for x in picks],
        "selection_rule string, match_id int, period int, possession_id bigint, possession_team_id int",
    )
    return (
        fx.own.join(F.broadcast(chosen), list(KEY))
        .withColumn("spatial_status", F.expr("CASE WHEN validated_anchor THEN 'validated' WHEN linked THEN 'unsupported' ELSE 'no_360_frame' END"))
        .select("selection_rule", *KEY, "event_index", "t_us", "event_type", "event_team_id", "spatial_status")
    )


@query(
    "seq12_reconcile_totals",
    sql(
        f"""{POSS} SELECT name, observed, expected, observed = expected AS ok FROM (
 SELECT 'events' AS name, (SELECT COUNT(*) FROM own)::DOUBLE AS observed, (SELECT SUM(total_event_count) FROM poss)::DOUBLE AS expected
 UNION ALL SELECT 'anchors', (SELECT COUNT(*) FROM own WHERE validated_anchor)::DOUBLE, 0.0)""",
        EV,
        OWN_EV,
    ),
)
def seq12(fx):
    # the total is declared by another table, which loses events if possessions do
    events = poss(fx).agg(F.sum("total_event_count")).first()[0] or 0
    return X.reconcile(
        fx.own,
        {"events": F.count(F.lit(1)), "anchors": F.count_if("validated_anchor")},
        {"events": events, "anchors": 0},
    )


@query(
    "seq13_ecdf",
    sql(
        f"""{GAPS} SELECT elapsed_seconds, COUNT(*) AS n,
 ROUND(SUM(COUNT(*)) OVER (ORDER BY elapsed_seconds) / (SELECT COUNT(*) FROM gaps), 6) AS fraction FROM gaps GROUP BY elapsed_seconds""",
        EV,
        OWN_EV,
    ),
)
def seq13(fx):
    return S.ecdf(gaps(fx), "elapsed_seconds", fx.small).withColumn("fraction", F.round("fraction", 6))


@query(
    "jon8_stream_integrity",
    sql(
        f"""l AS (SELECT *, LAG(period) OVER w AS pp, LAG(t_us) OVER w AS pt, LAG(possession_id) OVER w AS po
  FROM ev WINDOW w AS (PARTITION BY match_id ORDER BY event_index)),
 r AS (SELECT {K}, COUNT(*) FILTER (po IS NULL OR po <> possession_id OR pp <> period) AS runs FROM l GROUP BY {K})
 SELECT (SELECT COUNT(*) FILTER (period < pp) FROM l) AS reversed_period,
  (SELECT COUNT(*) FILTER (period = pp AND t_us < pt) FROM l) AS reversed_clock,
  (SELECT COUNT(*) FILTER (event_type IS NULL OR event_team_id IS NULL) FROM l) AS missing_annotation,
  (SELECT COUNT(*) FROM r WHERE runs > 1) AS noncontiguous,
  (SELECT COUNT(*) FROM (SELECT 1 FROM ev GROUP BY match_id, event_index HAVING COUNT(*) > 1)) AS duplicate_index,
  (SELECT COUNT(*) FROM (SELECT 1 FROM ev GROUP BY match_id, period, possession_id
    HAVING MIN(possession_team_id) <> MAX(possession_team_id))) AS conflicting_owner""",
        EV,
    ),
)
def jon8(fx):
    return S.stream_integrity(fx.ev, fx.lane("match_id"), KEY)
