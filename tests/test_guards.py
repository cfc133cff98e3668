"""Unknown gates, overlaps and limits."""

import pytest
from pyspark.sql import functions as F

from strideframe.operators.episodes import assign_membership, role_assignment
from strideframe.operators.expectations import ContractError
from strideframe.operators.ordered import Lane
from strideframe.operators.progression import action_vector
from strideframe.operators.review import select_cases
from strideframe.operators.semantics import normalize_point, point_team_label
from strideframe.operators.transitions import select_transitions


def test_unknown_status_or_team_is_unresolved(spark):
    df = spark.createDataFrame([(None, 904, True), ("validated", None, True), ("validated", 904, True)], "semantics_status string, event_team_id int, teammate boolean")
    df = df.withColumns({"x": F.lit(1.0), "y": F.lit(2.0)})
    rows = df.withColumns({**normalize_point("x", "y", 904), "side": F.expr(point_team_label(904))}).collect()
    assert sorted((r.side, r.orientation_status, r.x_attacking) for r in rows if r.side == "unresolved") == [("unresolved", "unsupported", None)] * 2
    assert [(r.side, r.x_attacking) for r in rows if r.side != "unresolved"] == [("own", 1.0)]


def test_infinite_endpoint_is_not_safe(spark):
    df = spark.createDataFrame([(904, "Pass", 1.0, 1.0, float("inf"), 1.0, True)], "event_team_id int, event_type string, start_x double, start_y double, end_x double, end_y double, validated_anchor boolean")
    row = action_vector(df, 904).first()
    assert not row.safe_action and row.action_status == "missing_or_invalid_endpoint" and row.delta_x is None


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({}, "eligible"),
        ({"to_semantics_status": None}, "unsupported_semantics"),
        ({"from_orientation_status": None}, "invalid_orientation"),
        ({"to_period": 2}, "cross_period"),
        ({"from_event_team_id": None}, "opponent_from_anchor"),
        ({"from_event_type": None}, "not_pass_carry_from_anchor"),
        ({"action_delta_x": float("inf")}, "invalid_progression_vector"),
        ({"action_delta_x": None}, "invalid_progression_vector"),
    ],
)
def test_first_failing_gate(spark, change, reason):
    good = {"semantics_status": "validated", "orientation_status": "identity_explicit", "period": 1}
    anchor = lambda e, k: (1, f"e{k}", 7, k, *(change.get(f"{e}_{c}", v) for c, v in good.items()))
    anchors = spark.createDataFrame([anchor("from", 1), anchor("to", 2)], "match_id int, event_id string, spell int, anchor_order int, semantics_status string, orientation_status string, period int")
    trans = spark.createDataFrame([(1, 7, "e1", "e2", change.get("from_event_team_id", 904), change.get("from_event_type", "Pass"))], "match_id int, spell int, from_event_id string, to_event_id string, from_event_team_id int, from_event_type string")
    actions = spark.createDataFrame([(1, "e1", "eligible", 10.0, 20.0, change.get("action_delta_x", 10.0))], "match_id int, event_id string, action_status string, action_start_x double, action_end_x double, action_delta_x double")
    assert select_transitions(trans, anchors, actions, ["spell"], 904).first().selection_reason == reason


def test_overlapping_intervals_are_refused(spark):
    lane = Lane(("case_id",), ("event_index",))
    events = spark.createDataFrame([("a", 5, 0)], "case_id string, event_index long, t_us long")
    ep = "case_id string, episode_id string, episode_start long, episode_end long, start_reason string, end_reason string, state_valid boolean"
    apart = spark.createDataFrame([("a", "1", 1, 5, "", "", True), ("a", "2", 6, 9, "", "", True)], ep)
    assert assign_membership(events, apart, lane).first().episode_id == "1"
    with pytest.raises(ContractError):
        assign_membership(events, spark.createDataFrame([("a", "1", 1, 10, "", "", True), ("a", "2", 4, 6, "", "", True)], ep), lane)
    with pytest.raises(ContractError):
        role_assignment(events, spark.createDataFrame([("a", 1, 6, "r"), ("a", 6, 8, "s")], "case_id string, lo long, hi long, role string"), lane)


def test_required_cases_over_the_limit_are_an_error(spark):
    pool = spark.createDataFrame([(1, True, False, False), (2, False, True, False), (3, False, False, True)], "k int, a boolean, b boolean, c boolean")
    assert select_cases(pool, ["a", "b", "c"], ["k"], F.lit(False), 3).count() == 3
    with pytest.raises(ValueError, match="required"):
        select_cases(pool, ["a", "b", "c"], ["k"], F.lit(False), 2)


def test_outcome_labels_take_plain_windows_at_any_size(spark, monkeypatch):
    """sessions are possessions, so no number of events may turn their labels to blocks, which store every probe."""
    from strideframe.operators import ordered
    from strideframe.plans.fixtures import Fixture
    from strideframe.plans.q_outcomes import labels

    fx = Fixture(spark, "/root/testdata/sf0.001")
    want = labels(fx).count()
    fx.n_events = 36_000_000
    monkeypatch.setattr(ordered, "durable", lambda df: pytest.fail("a session's labels went in blocks"))
    assert labels(fx).count() == want
