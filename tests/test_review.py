"""Review queries on the given tables."""

import pytest
from pyspark.sql import functions as F

from strideframe.plans.fixtures import Fixture
from strideframe.plans.q_audit import semantic
from strideframe.plans.q_review import rev10

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_the_cases_events_meet_their_snapshots(no_broadcast):
    """Whatever the size, no other event's points are shuffled or joined; some events have the semantics they have among all."""
    fx = Fixture(no_broadcast, SMALL)
    plan = rev10(fx)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(frame_id" not in plan
    some = "match_id = 3 AND possession_id = 0"
    cols = ["event_id", "semantics_status", F.size("points").alias("n")]
    got, want = semantic(fx, fx.ev.where(some)).select(*cols), semantic(fx).where(some).select(*cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
