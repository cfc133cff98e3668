"""Rank correlations against plain average ranks, and what they store."""

import math
import random

import pytest

from strideframe.operators import labels, ordered
from strideframe.operators.labels import rank_correlations

METRICS = ["a", "b", "c", "d"]


def plain(rows):
    out = []
    for label in {r[0] for r in rows}:
        for i in range(4):
            for j in range(i + 1, 4):
                both = [(r[i + 1], r[j + 1]) for r in rows if r[0] == label and r[i + 1] is not None and r[j + 1] is not None]
                if not both:
                    continue
                rank = lambda vs: [sum(w < v for w in vs) - sum(w > v for w in vs) for v in vs]
                x, y = (rank([p[k] for p in both]) for k in (0, 1))
                xx, yy = sum(u * u for u in x), sum(v * v for v in y)
                rho = sum(u * v for u, v in zip(x, y)) / math.sqrt(xx * yy) if xx and yy else None
                out.append((label, METRICS[i], METRICS[j], len(both), rho and round(rho, 9)))
    return sorted(out, key=str)


def rows():
    """Two labels and none; ``d`` has many values, ``b`` few and one that most rows have, ``c`` one value in label y; -0.0 is 0.0."""
    r, out = random.Random(4), []
    for k in range(260):
        label = (None, "x", "y")[k % 3]
        c = 5.0 if label == "y" else float(r.randrange(30))
        out.append((label, r.choice([None, -0.0, 0.0, 1.0, float(r.randrange(60))]), r.choice([0.0, 0.0, 0.0, 2.0, 7.0, None]), c if k % 4 else None, r.random() if label or k % 2 else None))
    return [*out, ("z", 1.0, None, None, 2.0), ("z", None, 3.0, None, None)]


@pytest.mark.parametrize(("small", "limit", "sent"), [(True, 10**6, 10**6), (False, 10**6, 10**6), (False, 0, 10**6), (False, 0, 0)])
def test_rank_correlations_equal_plain_ranks(spark, monkeypatch, small, limit, sent):
    monkeypatch.setattr(ordered, "GROUP_LIMIT", limit)
    monkeypatch.setattr(labels, "RANKS_SENT", sent)
    df = spark.createDataFrame(rows(), "label string, " + ", ".join(f"{m} double" for m in METRICS))
    got = rank_correlations(df, METRICS, small)
    assert got.dtypes == [("label", "string"), ("metric_a", "string"), ("metric_b", "string"), ("n", "bigint"), ("rho", "double")]
    assert sorted(((*r[:4], r.rho and round(r.rho, 9)) for r in got.collect()), key=str) == plain(rows())


def test_rank_correlations_store_values_not_rows(spark, monkeypatch):
    """2,000 rows that all differ, of 20 values a metric: what is stored grows with the values."""
    sizes, stored = [], getattr(labels, "stored", None)
    monkeypatch.setattr(ordered, "GROUP_LIMIT", 0)
    monkeypatch.setattr(labels, "stored", lambda df: sizes.append((out := stored(df)).count()) or out, raising=False)
    df = spark.createDataFrame([("x", float(k % 20), float(k // 20 % 20), float(k // 400)) for k in range(2000)], "label string, a double, b double, c double")
    monkeypatch.setattr(type(df), "checkpoint", lambda self, eager=True: pytest.fail("rows were checkpointed"))
    assert {r.n for r in rank_correlations(df, ["a", "b", "c"], False).collect()} == {2000}
    assert max(sizes) == 20
