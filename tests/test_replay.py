"""Drawdown warnings: resolutions, hard boundaries, masks, order and blocks."""

import pytest

from strideframe.operators.episodes import cut_at_hard, drawdown_detector, in_masks
from strideframe.operators.ordered import Lane

LANE = Lane(("case_id", "part"), ("event_index",))
COLS = "case_id string, event_index long, t_us long, safe_action boolean, failed boolean, trigger boolean, restart boolean, start_x double, end_x double"


def stream(spark, moves, case="a"):
    """One event a second for every (start, end) of a case."""
    return spark.createDataFrame([(case, i, i * 1_000_000, True, False, False, False, float(s), float(e)) for i, (s, e) in enumerate(moves)], COLS)


def replay(spark, df, hard=(), masks=(), lane=LANE, versions=("v0.3",)):
    cut = cut_at_hard(df, spark.createDataFrame(list(hard), "case_id string, onset long, resume long"), lane)
    cut = in_masks(cut, spark.createDataFrame(list(masks), "case_id string, lo long, hi long"), lane, "event_index", "event_index")
    rows = drawdown_detector(cut, lane, versions).collect()
    return sorted((r.version, r.case_id, r.part, r.onset, r.end_event, r.resolution, r.peak, r.maximum_retreat) for r in rows)


#: moves of a case, its hard boundaries and masks, and the expected part, onset, end and resolution
CASES = [
    ([(50, 60), (60, 45), (45, 47)], [], [], [(0, 1, 2, "CANCELLED")]),
    ([(50, 60), (60, 38), (38, 40)], [], [], [(0, 1, 2, "CONFIRMED")]),
    # five seconds after the peak a shallow retreat is confirmed too
    ([(50, 60), (59, 49), (49, 48), (48, 47), (47, 46), (46, 47)], [], [], [(0, 1, 5, "CONFIRMED")]),
    # a start on the peak counts as reaching it again
    ([(50, 60), (60, 49), (49, 48), (48, 47), (47, 46), (46, 47)], [], [], [(0, 1, 5, "CANCELLED")]),
    ([(50, 60), (60, 45)], [], [], [(0, 1, 1, "CENSORED_PARENT_END")]),
    # after a confirmation only a new high over the old peak wakes the detector
    ([(50, 60), (60, 38), (38, 40), (40, 20), (20, 21), (60, 62), (62, 50)], [], [], [(0, 1, 2, "CONFIRMED"), (0, 6, 6, "CENSORED_PARENT_END")]),
    ([(50, 60), (60, 55)], [], [], []),
    ([(50, 60), (60, 45), (45, 45), (90, 91), (20, 30), (30, 15)], [(2, 4)], [], [(0, 1, 2, "SUPERSEDED_HARD_BOUNDARY"), (1, 5, 5, "CENSORED_PARENT_END")]),
    ([(50, 60), (60, 45), (45, 45), (90, 91), (20, 30), (30, 15)], [(2, None)], [], [(0, 1, 2, "SUPERSEDED_HARD_BOUNDARY")]),
    ([(50, 60), (60, 45), (45, 44), (44, 47), (47, 30), (30, 31)], [], [(2, 3)], [(0, 1, 2, "CENSORED_REVIEW_MASK"), (0, 4, 5, "CONFIRMED")]),
]


def test_resolutions(spark):
    df, hard, masks, expected = None, [], [], []
    for i, (moves, cuts, hidden, found) in enumerate(CASES):
        name = f"c{i:02d}"
        one = stream(spark, moves, name)
        df = one if df is None else df.unionByName(one)
        hard += [(name, *x) for x in cuts]
        masks += [(name, *x) for x in hidden]
        expected += [(name, *x) for x in found]
    assert [r[1:6] for r in replay(spark, df, hard, masks)] == expected


def test_masks_overlap_spans(spark):
    spans = spark.createDataFrame([("a", 1, 3), ("a", 4, 9), ("a", 11, 12), ("b", 5, 5)], "case_id string, f long, l long")
    masks = spark.createDataFrame([("a", 9, 10), ("a", 3, 3), ("a", 0, 0)], "case_id string, lo long, hi long")
    got = {(r.case_id, r.f): r.masked for r in in_masks(spans, masks, LANE, "f", "l").collect()}
    assert got == {("a", 1): True, ("a", 4): True, ("a", 11): False, ("b", 5): False}


def test_empty_and_unknown(spark):
    assert replay(spark, stream(spark, []).limit(0)) == []
    with pytest.raises(ValueError):
        replay(spark, stream(spark, [(1, 2)]), versions=("v9",))


def test_rows_in_any_order_and_blocks_give_the_same(spark):
    blocked = Lane(LANE.keys, LANE.order, "CAST(floor(event_index / 2) AS BIGINT)")
    moves, (cut,) = CASES[8][0], CASES[8][1]
    df = stream(spark, CASES[4][0], "a").unionByName(stream(spark, moves, "b")).orderBy("start_x")
    assert [r[1:6] for r in replay(spark, df, [("b", *cut)], lane=blocked)] == [("a", *CASES[4][3][0]), ("b", *CASES[8][3][0])]
