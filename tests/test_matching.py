"""Nearest free partners in order: against plain rescans of all that is free, with bounds, ties, hot groups and odd rows."""

import random

import pytest

from strideframe.operators.matching import match_nearest
from strideframe.operators.ordered import Lane
from strideframe.operators.spells import boundary_match

SEEK = "g string, at long, tie long, id string, lower long, upper long"
PART = "g string, at long, tie long, id string, reach long"


def plain(seekers, partners):
    """Every seeker looks at all that is free."""
    free, out = sorted(partners, key=lambda p: (p[1], p[2], p[3])), []
    for s in sorted(seekers, key=lambda s: (s[1], s[2], s[3])):
        ok = [p for p in free if (p[1] <= s[1] and (s[4] is None or p[4] is None or p[4] >= s[4])) or (p[1] > s[1] and (s[5] is None or p[1] <= s[5]))]
        best = min(ok, key=lambda p: (abs(p[1] - s[1]), p[1], p[2], p[3]), default=None)
        if best:
            free.remove(best)
        out.append((s[0], s[3], best and best[3]))
    return out + [(p[0], None, p[3]) for p in free]


def cases(seed, groups, bounded):
    r = random.Random(seed)
    seekers, partners = [], []
    for g in range(groups):
        width = r.choice([3, 12, 60])
        mine = sorted((r.randrange(width), r.randrange(3)) for _ in range(r.randrange(14)))
        floor = 0
        for n, (at, tie) in enumerate(mine):
            floor = max(floor, at - r.randrange(6))
            seekers.append((f"g{g}", at, tie, f"s{n:02d}", floor if bounded else None, at + r.randrange(6) if bounded else None))
        reach = 0
        for n, (at, tie) in enumerate(sorted((r.randrange(width), r.randrange(3)) for _ in range(r.randrange(14)))):
            reach = max(reach, at + r.randrange(3))
            partners.append((f"g{g}", at, tie, f"p{n:02d}", reach if bounded else None))
    return seekers, partners


def run(spark, seekers, partners, block=None):
    out = match_nearest(spark.createDataFrame(seekers, SEEK), spark.createDataFrame(partners, PART), Lane(("g",), ("at",), block))
    return sorted(((r.g, r.seeker and r.seeker.id, r.partner and r.partner.id) for r in out.collect()), key=str)


@pytest.mark.parametrize("bounded", [False, True])
@pytest.mark.parametrize("block", [None, "CAST(floor(at / 4) AS BIGINT)"])
def test_equals_a_rescan_of_all_that_is_free(spark, bounded, block):
    seekers, partners = cases(7, 120, bounded)
    if bounded:  # several partners at one place must share a reach, as the last one's counts for the place
        last = {(g, at): max(x[4] for x in partners if x[:2] == (g, at)) for g, at, *_ in partners}
        partners = [(*x[:4], last[x[:2]]) for x in partners]
    want = []
    for g in sorted({x[0] for x in seekers + partners}):
        want += plain([x for x in seekers if x[0] == g], [x for x in partners if x[0] == g])
    assert run(spark, seekers, partners, block) == sorted(want, key=str)


def test_a_long_group_is_cut_into_parts(spark):
    seekers = [("a", 10 * i + i % 3, 0, f"s{i:05d}", None, None) for i in range(3000)]
    partners = [("a", 10 * i, 0, f"p{i:05d}", None) for i in range(3000) if i % 7]
    assert run(spark, seekers, partners) == sorted(plain(seekers, partners), key=str)


def test_odd_rows(spark):
    seekers = [("a", None, 0, "s0", None, None), (None, 5, 0, "s1", None, None), ("b", 1, 0, "s2", None, None), ("c", 4, 0, "s3", None, None), ("c", 4, 0, "s3", None, None)]
    partners = [("a", None, 0, "p0", None), (None, 9, 0, "p1", None), ("d", 1, 0, "p2", None), ("c", 4, 0, "p3", None)]
    assert run(spark, seekers, partners) == sorted([("a", "s0", None), ("a", None, "p0"), (None, "s1", "p1"), ("b", "s2", None), ("d", None, "p2"), ("c", "s3", "p3"), ("c", "s3", None)], key=str)
    assert run(spark, [], partners[3:]) == [("c", None, "p3")]
    assert run(spark, [], []) == []


def test_boundary_labels(spark):
    shape = "case_id string, family string, onset long, resume long"
    truth = [("a", "X", 10, 12), ("a", "X", 20, None), ("a", "X", 30, 31), ("a", "Y", 5, None)]
    predicted = [("a", "X", 10, 12), ("a", "X", 19, None), ("a", "X", 33, 31), ("a", "Z", 1, None)]
    out = boundary_match(spark.createDataFrame(predicted, shape), spark.createDataFrame(truth, shape), Lane((), ("at",)))
    got = sorted(((r.family, r.truth_onset, r.predicted_onset, r.result) for r in out.collect()), key=str)
    assert got == [("X", 10, 10, "MATCH"), ("X", 20, 19, "EARLY"), ("X", 30, 33, "LATE"), ("Y", 5, None, "MISSED"), ("Z", None, 1, "EXTRA")]
