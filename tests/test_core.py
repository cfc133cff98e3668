"""Large-group paths, closed forms and hand cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.functions import points as P
from strideframe.operators import logistic as L
from strideframe.operators import models as M
from strideframe.operators.ordered import Lane, Scan, Shift, number, scan, shift
from strideframe.operators.outcomes import anchor_outcomes
from strideframe.operators.quantiles import average_ranks, exact_quantiles, tuple_blocks
from strideframe.operators.sequences import anchor_gaps, stream_integrity
from strideframe.plans.fixtures import Fixture


def _rows(spark, n=60):
    rnd = random.Random(3)
    return spark.createDataFrame(
        [(g, i, rnd.choice([None, *range(9)])) for g in "ab" for i in range(n if g == "a" else 7)], "g string, i bigint, v int"
    )


def _same(a, b):
    cols = sorted(a.columns)
    assert sorted(map(tuple, a.select(cols).collect()), key=str) == sorted(map(tuple, b.select(cols).collect()), key=str)


def test_blocked_scans_equal_plain_windows(spark):
    df = _rows(spark)
    specs = {
        f"{fn}{b:d}{e:d}": Scan(fn, "v", backward=b, exclusive=e)
        for fn in ("sum", "count", "min", "max", "last", "first") for b in (False, True) for e in (False, True)
    }
    plain, cut = Lane(("g",), ("i",)), Lane(("g",), ("i",), "CAST(floor(i / 4) AS BIGINT)")
    _same(scan(df, plain, specs), scan(df, cut, specs))
    _same(number(df, plain, "n"), number(df, cut, "n"))
    for k in (1, 2, -1, -3):
        _same(shift(df, plain, {"p": "v", "q": "i"}, k), shift(df, cut, {"p": "v", "q": "i"}, k))


def test_scans_and_shifts_share_a_pass(spark, monkeypatch):
    """One store a call, and shifts that reach over several short or missing blocks."""
    from strideframe.operators import ordered

    df = _rows(spark).where("i % 11 < 6 OR g = 'b'").withColumn("s", F.struct("i", "v"))
    specs = {f"k{k}": Shift("s", k) for k in (-9, -4, -1, 1, 3, 8)} | {"n": Scan("count", "1"), "old": Scan("last", "v", exclusive=True)}
    stores, durable = [], ordered.durable
    monkeypatch.setattr(ordered, "durable", lambda df: stores.append(1) or durable(df))
    for width in (1, 3, 100):
        stores.clear()
        _same(scan(df, Lane(("g",), ("i",)), specs), scan(df, Lane(("g",), ("i",), f"CAST(floor(i / {width}) AS BIGINT)"), specs))
        assert len(stores) == 1


def test_exact_quantiles_and_ranks(spark):
    df = _rows(spark).where("v IS NOT NULL")
    qs = {"a": 0.05, "m": 0.5, "z": 0.9}
    _same(exact_quantiles(df, ["g"], "v", qs, True), exact_quantiles(df, ["g"], "v", qs, False))
    _same(average_ranks(df, ["g"], "v", "r", True), average_ranks(df, ["g"], "v", "r", False))


def test_hull_hand_cases(spark):
    def area(pts):
        arr = "array(" + ", ".join(f"named_struct('x', {x}D, 'y', {y}D)" for x, y in pts) + ")"
        return spark.sql(f"SELECT {P.hull_area(arr)} AS a").first()["a"]

    assert area([(0, 0), (4, 0), (4, 3), (0, 3), (2, 1)]) == 12
    assert area([(0, 0), (2, 0), (4, 0), (0, 3)]) == 6
    assert area([(0, 0), (1, 1), (2, 2)]) == 0


def test_student_t():
    assert abs(M.t_quantile(0.975, 33) - 2.0345) < 1e-4
    assert abs(M.t_quantile(0.975, 1) - 12.7062) < 1e-3


def test_logit_matches_closed_form(spark):
    rows = [(y, x, c) for x, (p, n) in {0: (10, 40), 1: (25, 15)}.items() for y, m in ((1, p), (0, n)) for c in range(5) for _ in range(m // 5)]
    df = spark.createDataFrame(rows, "y int, x int, g int")
    fit = L.logit_cr1(df, "y", "x", [], "g")
    assert fit["model_status"] == "ok"
    assert abs(fit["coefficient"] - math.log((25 / 15) / (10 / 40))) < 1e-6
    assert L.logit_cr1(df.withColumn("x", F.lit(1)), "y", "x", [], "g")["model_status"] == "constant_predictor"
    assert L.logit_cr1(df.withColumn("y", F.col("x")), "y", "x", [], "g")["model_status"] == "unstable_or_separated"


def test_ols_forms_agree(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=80)
    rows = [(float(a), float(2 * a + b), int(i % 8)) for i, (a, b) in enumerate(zip(x, rnd.normal(size=80)))]
    df = spark.createDataFrame(rows, "x double, y double, g int")
    one = M.ols_cr1(df, [], "y", "x", "g").first()
    many = M.ols_cr1_multi(df, "y", ["x"], "g")
    assert abs(one["slope"] - many["parameters"][1]) < 1e-10
    assert abs(one["cluster_se"] - many["se"][1]) < 1e-10
    assert abs(one["ci_low"] - many["ci_low"][1]) < 1e-8


def test_outcome_edges(spark):
    ref = spark.createDataFrame([(1, 10, 5, 100)], "s int, event_id bigint, event_index bigint, t_us bigint")
    out = spark.createDataFrame(
        [(1, 9, 4, 100, "shot", 0.5), (1, 11, 6, 150, "shot", 0.25), (1, 12, 7, 151, "shot", None)],
        "s int, event_id bigint, event_index bigint, t_us bigint, outcome_type string, shot_xg double",
    )
    for rows in (1, None):
        r = anchor_outcomes(ref, out, ["s"], {"h": 50}, rows, block_us=20).first()
        assert r["shot_within_h"] == 1 and r["future_xg_h"] == 0.25  # edge in, same-time earlier event out
        assert r["future_xg_rest"] is None and r["next_shot_event_id"] == 11


def _stream(spark):
    rows = [(1, 1, i // 6, 904, i, i, 10 * i, "Pass", 904, i % 3 != 1) for i in range(24)]
    return spark.createDataFrame(
        rows, "match_id int, period int, possession_id bigint, possession_team_id int, event_id bigint, event_index bigint, t_us bigint, event_type string, event_team_id int, validated_anchor boolean"
    )


def test_anchor_gaps_in_blocks_count_all_events(spark):
    """The place of an event is a column of the caller, beside the scan's own numbering."""
    keys = ("match_id", "period", "possession_id", "possession_team_id")
    plain, cut = Lane(keys, ("event_index",)), Lane(keys, ("event_index",), "CAST(floor(event_index / 4) AS BIGINT)")
    _same(anchor_gaps(_stream(spark), plain), anchor_gaps(_stream(spark), cut))
    assert {r.intervening_event_count for r in anchor_gaps(_stream(spark), cut).collect()} == {0, 1}


def test_stream_integrity_in_blocks(spark):
    keys = ("match_id", "period", "possession_id", "possession_team_id")
    plain, cut = Lane(("match_id",), ("event_index",)), Lane(("match_id",), ("event_index",), "CAST(floor(event_index / 4) AS BIGINT)")
    _same(stream_integrity(_stream(spark), plain, keys), stream_integrity(_stream(spark), cut, keys))


def test_names_of_a_scan_are_reserved(spark):
    with pytest.raises(ValueError, match="reserved"):
        scan(_rows(spark).withColumn("__scan_pos", F.lit(1)), Lane(("g",), ("i",)), {"n": Scan("count", "1")})


def test_possession_groups_are_bounded_by_construction(spark):
    """Windows over possessions and cases stay plain however many events there are; a match is cut into blocks."""
    fx = Fixture(spark, "/none")
    fx.n_events = 10**9
    assert fx.lane("match_id", "possession_id").block is None and fx.lane("case_id", "version").block is None
    assert fx.lane("match_id").block and fx.time_lane("match_id").block


def test_frequent_values_are_cut_by_the_next_column(spark):
    """A tenth of the rows has one tax and a fifth has none; no block holds so many, and blocks keep the order."""
    rows = [(float(i % 10) if i % 5 else None, float(i % 7), float(i)) for i in range(4000)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    at = df.withColumn("b", F.expr(tuple_blocks(df, ["x", "y", "z"])))
    got = [r.b for r in at.orderBy("x", "y", "z").collect()]
    assert got == sorted(got)
    assert max(r["count"] for r in at.groupBy("b").count().collect()) < 4000 / 50


def test_quantiles_beyond_the_bound_read_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "g string, v double").coalesce(1)
    out = exact_quantiles(df.mapInArrow(count, df.schema), ["g"], "v", {"m": 0.5}, False)
    assert sorted(map(tuple, out.collect()), key=str) == [("a", 2.0), ("b", None)]
    out.collect()
    assert seen.value == 3
