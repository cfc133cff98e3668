"""Forward-horizon outcome queries."""

from pyspark.sql import functions as F

from strideframe.operators import outcomes as O
from strideframe.plans.fixtures import EV, HOUR_US, KEY, OWN, OWN_EV, POSSESSION, sql
from strideframe.plans.registry import query

SESSION = ("match_id", "period", "possession_id")
HORIZONS = {"2h": 2 * HOUR_US, "6h": 6 * HOUR_US, "12h": 12 * HOUR_US}
K = ", ".join(SESSION)

_ENTRY = f"""(event_team_id = {OWN} AND event_type IN ('Pass', 'Carry') AND pass_outcome IS NULL
 AND start_x BETWEEN 0 AND 120 AND start_y BETWEEN 0 AND 80 AND end_x BETWEEN 0 AND 120 AND end_y BETWEEN 0 AND 80
 AND NOT (start_x >= 102 AND start_y BETWEEN 18 AND 62) AND (end_x >= 102 AND end_y BETWEEN 18 AND 62))"""

OUTC = f"""outc AS (SELECT {K}, event_id, event_index, t_us,
  CASE WHEN event_type = 'Shot' THEN 'shot' ELSE 'box_entry' END AS outcome_type,
  CASE WHEN event_type <> 'Shot' THEN start_x END AS start_x, CASE WHEN event_type <> 'Shot' THEN start_y END AS start_y,
  CASE WHEN event_type <> 'Shot' THEN end_x END AS end_x, CASE WHEN event_type <> 'Shot' THEN end_y END AS end_y,
  CASE WHEN event_type = 'Shot' AND xg BETWEEN 0 AND 1 THEN xg END AS shot_xg
 FROM own WHERE (event_team_id = {OWN} AND event_type = 'Shot') OR coalesce({_ENTRY}, FALSE))"""


def _labels_sql(outcomes="outc", pairs="pr", labels="lab"):
    pair = f"""{pairs} AS (SELECT a.{', a.'.join(SESSION)}, a.event_id, a.event_index, a.t_us, o.event_id AS oid, o.event_index AS oi,
  o.t_us - a.t_us AS el, o.outcome_type AS ot, o.shot_xg AS xg
  FROM (SELECT * FROM own WHERE validated_anchor) a LEFT JOIN {outcomes} o
   ON a.match_id = o.match_id AND a.period = o.period AND a.possession_id = o.possession_id AND o.event_index >= a.event_index)"""
    cols = [
        "COUNT(*) FILTER (oid = event_id AND ot = 'box_entry') AS reference_is_box_entry",
        "COUNT(*) FILTER (oid = event_id AND ot = 'shot') AS reference_is_shot",
        "MAX(xg) FILTER (oid = event_id AND ot = 'shot') AS reference_shot_xg",
    ]
    for label in ("box_entry", "shot"):
        cols.append(f"arg_min(el, oi) FILTER (ot = '{label}') / 1e6 AS seconds_to_next_{label}")
        cols.append(f"arg_min(oid, oi) FILTER (ot = '{label}') AS next_{label}_event_id")
    cols.append("list_extract(list(xg ORDER BY oi) FILTER (ot = 'shot'), 1) AS next_shot_xg")
    for h, us in HORIZONS.items():
        for label in ("box_entry", "shot"):
            cols.append(f"CAST(COALESCE(BOOL_OR(ot = '{label}' AND el <= {us}), FALSE) AS INT) AS {label}_within_{h}")
        cols.append(
            f"CASE WHEN COUNT(*) FILTER (ot = 'shot' AND el <= {us} AND xg IS NULL) = 0 "
            f"THEN COALESCE(SUM(xg) FILTER (ot = 'shot' AND el <= {us}), 0) END AS future_xg_{h}"
        )
    for label in ("box_entry", "shot"):
        cols.append(f"CAST(COALESCE(BOOL_OR(ot = '{label}'), FALSE) AS INT) AS {label}_before_session_end")
    cols.append(
        "CASE WHEN COUNT(*) FILTER (ot = 'shot' AND xg IS NULL) = 0 THEN COALESCE(SUM(xg) FILTER (ot = 'shot'), 0) END AS future_xg_rest"
    )
    return f"{pair}, {labels} AS (SELECT {K}, event_id, event_index, t_us, {', '.join(cols)} FROM {pairs} GROUP BY {K}, event_id, event_index, t_us)"


LABELS = f"{OUTC}, {_labels_sql()}"
XG = [f"future_xg_{h}" for h in (*HORIZONS, "rest")]


def outcomes(fx):
    return O.outcome_events(fx.own, OWN, SESSION)


def labels(fx, own=None):
    own = fx.own if own is None else own
    # a session is a possession, so its probes and outcomes are few, however many events there are
    return O.anchor_outcomes(
        own.where("validated_anchor"), O.outcome_events(own, OWN, SESSION), SESSION, HORIZONS, 10 * POSSESSION
    )


@query(
    "out1_box_entry",
    sql(f"SELECT event_id, coalesce({_ENTRY}, FALSE) AS is_box_entry FROM ev", EV),
)
def out1(fx):
    return fx.ev.select("event_id", O.box_entry(OWN).alias("is_box_entry"))


@query("out2_outcome_events", sql(OUTC + " SELECT * FROM outc", EV, OWN_EV))
def out2(fx):
    return outcomes(fx)


@query(
    "out3_anchor_outcomes",
    sql(
        f"{LABELS} SELECT * REPLACE ({', '.join(f'ROUND({c}, 6) AS {c}' for c in XG)}) FROM lab",
        EV,
        OWN_EV,
    ),
)
def out3(fx):
    return labels(fx).withColumns({c: F.round(c, 6) for c in XG})


@query(
    "out4_validate_nesting",
    sql(
        f"{LABELS} SELECT COUNT(*) AS anchors, 0 AS box_entry_violations, 0 AS shot_violations, 0 AS future_xg_violations FROM lab",
        EV,
        OWN_EV,
    ),
)
def out4(fx):
    return O.nesting_violations(labels(fx), [*HORIZONS, "rest"])


#: the faults that are put into the labels: flipped, raised and emptied values, a lost and a repeated row
_PLANTED = {
    "box_entry_within_2h": "CASE WHEN event_id % 97 = 0 THEN 1 - box_entry_within_2h ELSE box_entry_within_2h END",
    "future_xg_6h": "CASE WHEN event_id % 89 = 1 THEN future_xg_6h + 1 ELSE future_xg_6h END",
    "next_shot_event_id": "CASE WHEN event_id % 83 <> 4 THEN next_shot_event_id END",
    "shot_before_session_end": "CASE WHEN event_id % 79 = 5 THEN 0 ELSE shot_before_session_end END",
}
_FAMILY = {f: [*[f"{f}_within_{h}" for h in HORIZONS], f"{f}_before_session_end"] for f in ("box_entry", "shot")} | {"future_xg": XG}
_NEST = " UNION ALL ".join(
    f"SELECT {K}, event_id, 'nesting of {f}', NULL, NULL FROM pl1 WHERE {' OR '.join(f'{a} > {b} + 1e-12' for i, a in enumerate(c) for b in c[i + 1 :])}" for f, c in _FAMILY.items()
)


@query(
    "out4_validate_outcomes",
    sql(
        f"""{LABELS}, pl1 AS (SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in _PLANTED.items())}) FROM lab WHERE event_id % 101 <> 2),
 fault AS (SELECT {K}, event_id, 'missing' AS problem, NULL::DOUBLE AS labelled, NULL::DOUBLE AS expected FROM lab WHERE event_id % 101 = 2
  UNION ALL SELECT {K}, event_id, 'repeated', 2, 1 FROM pl1 WHERE event_id % 103 = 3
  UNION ALL {_NEST}
  UNION ALL {" UNION ALL ".join(f"SELECT {K}, event_id, '{c}', p.{c}, l.{c} FROM pl1 p JOIN lab l USING ({K}, event_id) WHERE p.{c} IS DISTINCT FROM l.{c}" for c in _PLANTED)})
 SELECT * REPLACE (ROUND(labelled, 6) AS labelled, ROUND(expected, 6) AS expected) FROM fault""",
        EV,
        OWN_EV,
    ),
)
def out4b(fx):
    """Labels with planted faults against the second formulation: these faults are reported and no others."""
    found = labels(fx).withColumns({c: F.expr(e) for c, e in _PLANTED.items()}).where("event_id % 101 <> 2")
    found = found.unionByName(found.where("event_id % 103 = 3"))
    out = O.validate_outcomes(found, fx.own.where("validated_anchor"), outcomes(fx), SESSION, HORIZONS)
    return out.withColumns({c: F.round(c, 6) for c in ("labelled", "expected")})


_SUMMARY = " UNION ALL ".join(
    f"""SELECT '{h}' AS horizon, COUNT(*) AS anchor_count, SUM(box_entry_{s}) AS box_entry_positive,
 ROUND(AVG(box_entry_{s}), 6) AS box_entry_prevalence, SUM(shot_{s}) AS shot_positive, ROUND(AVG(shot_{s}), 6) AS shot_prevalence,
 ROUND(AVG(future_xg_{h}), 6) AS mean_future_xg,
 ROUND(AVG(CASE WHEN future_xg_{h} > 0 THEN 1 WHEN future_xg_{h} IS NOT NULL THEN 0 END), 6) AS proportion_positive,
 COUNT(*) FILTER (future_xg_{h} IS NULL) AS missing_xg, ROUND(MEDIAN(future_xg_{h}), 6) AS median_future_xg FROM lab"""
    for h, s in [*((h, f"within_{h}") for h in HORIZONS), ("rest", "before_session_end")]
)


@query("out5_outcome_summary", sql(f"{LABELS} {_SUMMARY}", EV, OWN_EV))
def out5(fx):
    return O.outcome_summary(labels(fx), [*HORIZONS, "rest"], fx.small)


@query("out6_boundary_probe", sql("SELECT 0 AS changed_labels, COUNT(*) AS anchors FROM own WHERE validated_anchor", EV, OWN_EV))
def out6(fx):
    """Labels must not move when outcomes are injected into the following session."""
    base = labels(fx)
    injected = outcomes(fx).withColumns(
        {"possession_id": F.col("possession_id") + 1, "event_id": -F.col("event_id") - 1, "shot_xg": F.lit(1.0)}
    ).where("possession_id % 4 = 3")
    again = O.anchor_outcomes(
        fx.own.where("validated_anchor"),
        outcomes(fx).unionByName(injected),
        SESSION,
        HORIZONS,
        10 * POSSESSION,
    )
    return O.compare_labels(base, again)


_ROUNDED = f"* REPLACE ({', '.join(f'ROUND({c}, 9) AS {c}' for c in [*XG, 'next_shot_xg', 'reference_shot_xg'])})"


@query(
    "out6_boundary_leak",
    sql(
        f"""{LABELS}, outc2 AS (SELECT * REPLACE (CASE WHEN outcome_type = 'shot' AND event_id % 5 = 0 THEN 0.75 ELSE shot_xg END AS shot_xg) FROM outc), {_labels_sql("outc2", "pr2", "lab2")}
 SELECT (SELECT COUNT(*) FROM (SELECT {_ROUNDED} FROM lab EXCEPT ALL SELECT {_ROUNDED} FROM lab2)) AS changed_labels, (SELECT COUNT(*) FROM lab) AS anchors""",
        EV,
        OWN_EV,
    ),
)
def out6b(fx):
    """The same probe with shots of the anchors' own sessions valued anew: these labels must move."""
    other = F.when((F.col("outcome_type") == "shot") & (F.col("event_id") % 5 == 0), 0.75).otherwise(F.col("shot_xg"))
    again = O.anchor_outcomes(fx.own.where("validated_anchor"), outcomes(fx).withColumn("shot_xg", other), SESSION, HORIZONS, 10 * POSSESSION)
    even = {c: F.round(c, 9) for c in [*XG, "next_shot_xg", "reference_shot_xg"]}
    return O.compare_labels(labels(fx).withColumns(even), again.withColumns(even))


@query(
    "out7_check_inputs",
    sql(
        f"""d AS (SELECT event_id FROM own GROUP BY match_id, event_id HAVING COUNT(*) > 1),
 s AS (SELECT match_id, possession_id FROM own GROUP BY match_id, possession_id HAVING COUNT(DISTINCT period) > 1),
 c AS (SELECT t_us < LAG(t_us) OVER (PARTITION BY {K} ORDER BY event_index) AS back FROM own)
 SELECT (SELECT COUNT(*) FROM d) AS duplicate_ids, (SELECT COUNT(*) FROM s) AS crossing_sessions,
  (SELECT COUNT(*) FROM c WHERE back) AS reversed_clock""",
        EV,
        OWN_EV,
    ),
)
def out7(fx):
    return O.check_inputs(fx.own, ["match_id", "possession_id"], fx.lane(*SESSION))
