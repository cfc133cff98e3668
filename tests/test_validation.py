"""Second formulations: labels against a range join, faults that must be reported, models fitted together and alone."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.operators import excursions as X
from strideframe.operators import logistic as L
from strideframe.operators.outcomes import anchor_outcomes, reconstruct_outcomes, validate_outcomes

SESSION, HORIZONS = ["match_id"], {"1s": 1_000_000, "5s": 5_000_000}


def session(spark, seed, n=150):
    r, t, events = random.Random(seed), 0, []
    for i in range(n):
        t += r.choice([0, 300_000, 2_000_000, 9_000_000])
        events.append((i % 2, i, i, t, r.choice(["shot", "box_entry", None, None]), r.choice([None, 0.25, 0.5])))
    events = spark.createDataFrame(events, "match_id int, event_id long, event_index long, t_us long, outcome_type string, shot_xg double")
    shots = F.when(F.col("outcome_type") == "shot", F.col("shot_xg"))
    return events, events.where("outcome_type IS NOT NULL").withColumn("shot_xg", shots)


def test_the_two_formulations_agree(spark):
    for seed in range(3):
        anchors, outcomes = session(spark, seed)
        labels = anchor_outcomes(anchors, outcomes, SESSION, HORIZONS, 1000)
        assert validate_outcomes(labels, anchors, outcomes, SESSION, HORIZONS).collect() == []
        again = reconstruct_outcomes(anchors, outcomes, SESSION, HORIZONS)
        assert sorted(again.columns) == sorted(labels.columns)


def test_a_planted_fault_is_reported(spark):
    anchors, outcomes = session(spark, 9)
    labels = anchor_outcomes(anchors, outcomes, SESSION, HORIZONS, 1000)
    one = F.col("event_id") == 7
    for column, value in (("shot_within_1s", 1 - F.col("shot_within_1s")), ("future_xg_5s", F.coalesce("future_xg_5s", F.lit(0.0)) + 1e-9), ("next_shot_event_id", F.lit(-1))):
        found = validate_outcomes(labels.withColumn(column, F.when(one, value).otherwise(F.col(column))), anchors, outcomes, SESSION, HORIZONS).collect()
        assert {(r.event_id, r.problem) for r in found if not r.problem.startswith("nesting")} == {(7, column)}
    found = validate_outcomes(labels.where(~one).unionByName(labels.where("event_id = 8")).unionByName(labels.where("event_id = 9").withColumn("event_id", F.lit(999).cast("bigint"))), anchors, outcomes, SESSION, HORIZONS)
    assert sorted((r.event_id, r.problem) for r in found.collect()) == [(7, "missing"), (8, "repeated"), (999, "extra")]


def test_models_together_equal_models_alone(spark):
    r = np.random.default_rng(4)
    x, z = r.normal(size=400), r.normal(3, 9, 400)
    y = (r.random(400) < 1 / (1 + np.exp(-0.4 - 0.9 * x + 0.05 * z))).astype(int)
    df = spark.createDataFrame([(int(a), float(b), float(c), i % 23, bool(i % 3)) for i, (a, b, c) in enumerate(zip(y, x, z))], "y int, x double, z double, g int, third boolean")
    models = [
        L.Model("y", {"x": "x"}),
        L.Model("y", {"x": "x", "z": "z"}, reporting_sd=2.0),
        L.Model("y", {"z": "z", "both": F.col("x") * F.col("z")}, F.col("third")),
        L.Model("y", {"x": "x", "twice": F.col("x") * 2}),
        L.Model("y", {"one": F.lit(1.0)}),
        L.Model("y", {"x": "x"}, F.col("x") > 1e6),
        L.Model("y", {"same": F.col("y").cast("double")}),
    ]
    fits = L.fit_logits(df, models, "g")
    assert [f["model_status"] for f in fits] == ["ok"] * 3 + ["rank_deficient", "constant_predictor", "insufficient_data", "unstable_or_separated"]
    for m, f in zip(models[:3], fits[:3]):
        alone = L.fit_logits(df, [m], "g")[0]
        assert alone["coefficient"] == pytest.approx(f["coefficient"], rel=1e-9) and alone["cluster_se"] == pytest.approx(f["cluster_se"], rel=1e-9)
    # plain numpy: scores vanish at the coefficients, and the covariance is the sandwich of the raw design
    design = np.column_stack([np.ones(400), x, z])
    b = np.array(fits[1]["parameters"])
    p = 1 / (1 + np.exp(-design @ b))
    assert np.abs(design.T @ (p - y)).max() < 1e-8
    bread = np.linalg.inv((design * (p * (1 - p))[:, None]).T @ design)
    scores = np.zeros((23, 3))
    np.add.at(scores, np.arange(400) % 23, design * (y - p)[:, None])
    cov = bread @ scores.T @ scores @ bread * 23 / 22 * 399 / 397
    assert np.allclose(fits[1]["covariance"], cov, rtol=1e-6)
    assert L.fit_logits(df, [], "g") == []
    with pytest.raises(ValueError):
        L.fit_logits(df.withColumn("y", F.col("y") * 2), models[:1], "g")


def test_samples_and_spans(spark):
    events = spark.createDataFrame([("a", i) for i in range(0, 1000, 7)], "case_id string, event_index long")
    spans = spark.createDataFrame([("a", "s1", 0, 20), ("a", "s2", 14, 600), ("b", "s3", 0, 999), ("a", "s4", 9, 8)], "case_id string, span string, lo long, hi long")
    got = {(r.span, r.event_index) for r in X.in_spans(events, spans).collect()}
    assert got == {(s, i) for s, lo, hi in (("s1", 0, 20), ("s2", 14, 600)) for i in range(0, 1000, 7) if lo <= i <= hi}
    shape = "human_label string, lock_status string, episode_id string, state_valid boolean, retreat double, opening_restart boolean, relocation_affected boolean, seconds_to_recovery double, recovery_status string"
    rows = [("A", "LOCKED", "e", True, 1.0, None, False, 2.0, "x"), ("A", "OPEN", "e", True, 1.0, False, False, 9.0, "x"), ("B", "PARTIAL_LOCK", "e", True, 0.0, False, None, None, "not_applicable_at_peak"), (None, None, None, None, None, True, True, None, None)]
    s = X.sample_readiness(spark.createDataFrame(rows, shape), ["A", "B", "C"])
    assert sorted(r.exclusion_reason for r in s.collect()) == sorted(["", X.REASONS[0], "", ";".join([*X.REASONS[:2], *X.REASONS[3:]])])
    got = {r.human_label: (r.candidate_count, r.observed_time_count, r.at_peak_count, r.conditional_mean_recovery_seconds) for r in X.recovery_summary(s, ["A", "B", "C"], True).collect()}
    assert got == {"A": (1, 1, 0, 2.0), "B": (1, 0, 1, None), "C": (0, 0, 0, None)}
