"""Forward-horizon outcome labels without emitting anchor-outcome pairs.

Anchors, outcomes and one probe per (anchor, horizon), placed at the horizon's
edge, are merged into one ordered stream per session.  Running sums give what
lies before the anchor and up to the edge; their difference is the horizon.
Work is linear in the rows whatever the session size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.operators.ordered import Lane, Scan, lane_for, scan

_SCALE = "DECIMAL(38, 18)"


def inside_box(x: str, y: str) -> str:
    return f"({x} >= 102 AND {y} BETWEEN 18 AND 62)"


def on_pitch(x: str, y: str) -> str:
    return f"({x} BETWEEN 0 AND 120 AND {y} BETWEEN 0 AND 80)"


def box_entry(own_team: int) -> Column:
    """Completed own pass or carry from outside the box to inside it, both ends on the pitch."""
    return F.coalesce(
        F.expr(
            f"event_team_id = {own_team} AND event_type IN ('Pass', 'Carry') AND pass_outcome IS NULL "
            f"AND {on_pitch('start_x', 'start_y')} AND {on_pitch('end_x', 'end_y')} "
            f"AND NOT {inside_box('start_x', 'start_y')} AND {inside_box('end_x', 'end_y')}"
        ),
        F.lit(False),
    )


def outcome_events(events: DataFrame, own_team: int, session: Sequence[str]) -> DataFrame:
    """Own shots and box entries; a shot value outside [0, 1] is no value."""
    shot = (F.col("event_team_id") == own_team) & (F.col("event_type") == "Shot")
    kept = events.withColumn("is_shot", shot).withColumn("is_entry", box_entry(own_team)).where("is_shot OR is_entry")
    entry = F.col("is_entry")
    return kept.select(
        *session,
        "event_id",
        "event_index",
        "t_us",
        F.when(F.col("is_shot"), "shot").otherwise("box_entry").alias("outcome_type"),
        *[F.when(entry, F.col(c)).alias(c) for c in ("start_x", "start_y", "end_x", "end_y")],
        F.when(F.col("is_shot") & F.col("xg").between(0, 1), F.col("xg")).alias("shot_xg"),
    )


def anchor_outcomes(
    anchors: DataFrame,
    outcomes: DataFrame,
    session: Sequence[str],
    horizons: dict[str, int],
    rows: int | None,
    block_us: int = 60_000_000,
) -> DataFrame:
    """Labels per anchor: next entry and shot, any within each horizon, value sums.

    The anchor itself and the horizon's edge are included; only outcomes at or
    after the anchor's index count.  A missing value voids the sum; no shot gives 0.
    """
    session = list(session)
    big = (1 << 62) - 1
    a = anchors.select(
        *session,
        F.col("event_id").alias("ref"),
        F.col("event_index").alias("ref_index"),
        F.col("t_us").alias("ref_us"),
    )
    none = {"otype": "string", "oid": "bigint", "xg": "double"}
    steps = F.array(
        F.struct(F.lit("at").alias("kind"), F.lit(0).cast("bigint").alias("ahead"), F.lit(0).alias("rank")),
        *[
            F.struct(F.lit(h).alias("kind"), F.lit(us).cast("bigint").alias("ahead"), F.lit(2).alias("rank"))
            for h, us in horizons.items()
        ],
    )
    probes = a.select("*", F.inline(steps)).select(
        *session,
        "ref",
        "ref_index",
        "ref_us",
        "kind",
        (F.col("ref_us") + F.col("ahead")).alias("t"),
        F.when(F.col("rank") == 0, F.col("ref_index")).otherwise(F.lit(big)).alias("idx"),
        "rank",
        *[F.lit(None).cast(t).alias(n) for n, t in none.items()],
    )
    o = outcomes.select(
        *session,
        *[F.lit(None).cast("bigint").alias(n) for n in ("ref", "ref_index", "ref_us")],
        F.lit("outcome").alias("kind"),
        F.col("t_us").alias("t"),
        F.col("event_index").alias("idx"),
        F.lit(1).alias("rank"),
        F.col("outcome_type").alias("otype"),
        F.col("event_id").alias("oid"),
        F.col("shot_xg").alias("xg"),
    )
    lane = lane_for(rows, session, ("t", "idx", "rank", "ref"), f"CAST(floor(t / {block_us}) AS BIGINT)")
    exact = f"CASE WHEN otype = 'shot' THEN CAST(coalesce(xg, 0) AS {_SCALE}) END"
    gone = "CASE WHEN otype = 'shot' AND xg IS NULL THEN 1 ELSE 0 END"
    nxt = "CASE WHEN otype = '{0}' THEN named_struct('id', oid, 't', t, 'xg', xg) END"
    run = scan(
        probes.unionByName(o),
        lane,
        {
            "xg_to": Scan("sum", exact),
            "gone_to": Scan("sum", gone),
            "xg_rest": Scan("sum", exact, backward=True),
            "gone_rest": Scan("sum", gone, backward=True),
            "entry": Scan("last", nxt.format("box_entry"), backward=True),
            "shot": Scan("last", nxt.format("shot"), backward=True),
        },
    ).where("kind <> 'outcome'")
    at = F.col("kind") == "at"
    per = run.groupBy(*session, "ref", "ref_index", "ref_us").agg(
        *[F.max(F.when(at, F.col(c))).alias(c) for c in ("entry", "shot", "xg_rest", "gone_rest")],
        *[
            F.max(F.when(F.col("kind") == k, F.coalesce(F.col(c), F.lit(0)))).alias(f"{c}_{k}")
            for k in ("at", *horizons)
            for c in ("xg_to", "gone_to")
        ],
    )
    wait = lambda n: F.col(f"{n}.t") - F.col("ref_us")
    labels = {
        "reference_is_box_entry": (F.col("entry.id") == F.col("ref")),
        "reference_is_shot": (F.col("shot.id") == F.col("ref")),
    }
    out = [F.coalesce(c.cast("int"), F.lit(0)).alias(n) for n, c in labels.items()]
    out.append(F.when(F.col("shot.id") == F.col("ref"), F.col("shot.xg")).alias("reference_shot_xg"))
    for n, label in (("entry", "box_entry"), ("shot", "shot")):
        out.append((wait(n) / 1e6).alias(f"seconds_to_next_{label}"))
        out.append(F.col(f"{n}.id").alias(f"next_{label}_event_id"))
    out.append(F.col("shot.xg").alias("next_shot_xg"))
    for h, us in horizons.items():
        for n, label in (("entry", "box_entry"), ("shot", "shot")):
            out.append(F.coalesce((wait(n) <= us).cast("int"), F.lit(0)).alias(f"{label}_within_{h}"))
        value = (F.col(f"xg_to_{h}") - F.col("xg_to_at")).cast("double")
        out.append(F.when(F.col(f"gone_to_{h}") == F.col("gone_to_at"), value).alias(f"future_xg_{h}"))
    for n, label in (("entry", "box_entry"), ("shot", "shot")):
        out.append(F.col(n).isNotNull().cast("int").alias(f"{label}_before_session_end"))
    rest = F.coalesce(F.col("xg_rest"), F.lit(0)).cast("double")
    out.append(F.when(F.col("gone_rest") == 0, rest).alias("future_xg_rest"))
    return per.select(
        *session, F.col("ref").alias("event_id"), F.col("ref_index").alias("event_index"), F.col("ref_us").alias("t_us"), *out
    )


def outcome_summary(labels: DataFrame, horizons: Sequence[str], small: bool, keys: Sequence[str] = ()) -> DataFrame:
    """Counts, prevalence and value statistics per horizon."""
    from strideframe.operators.quantiles import exact_quantiles

    rows = [
        F.struct(
            F.lit(h).alias("horizon"),
            F.col(f"box_entry_{'before_session_end' if h == 'rest' else 'within_' + h}").alias("b"),
            F.col(f"shot_{'before_session_end' if h == 'rest' else 'within_' + h}").alias("s"),
            F.col(f"future_xg_{h}").alias("x"),
        )
        for h in horizons
    ]
    long = labels.select(*keys, F.inline(F.array(*rows)))
    agg = long.groupBy(*keys, "horizon").agg(
        F.count(F.lit(1)).alias("anchor_count"),
        F.sum("b").alias("box_entry_positive"),
        F.round(F.mean("b"), 6).alias("box_entry_prevalence"),
        F.sum("s").alias("shot_positive"),
        F.round(F.mean("s"), 6).alias("shot_prevalence"),
        F.round(F.mean("x"), 6).alias("mean_future_xg"),
        F.round(F.mean((F.col("x") > 0).cast("int")), 6).alias("proportion_positive"),
        F.count_if(F.col("x").isNull()).alias("missing_xg"),
    )
    med = exact_quantiles(long, [*keys, "horizon"], "x", {"median_future_xg": 0.5}, small)
    return agg.join(med, [*keys, "horizon"], "left").withColumn("median_future_xg", F.round("median_future_xg", 6))


def nesting_violations(labels: DataFrame, horizons: Sequence[str]) -> DataFrame:
    """Rows where a shorter horizon exceeds a longer one, per family."""
    bad = {"box_entry": F.lit(False), "shot": F.lit(False), "future_xg": F.lit(False)}
    name = lambda f, h: (
        f"future_xg_{h}" if f == "future_xg" else f"{f}_before_session_end" if h == "rest" else f"{f}_within_{h}"
    )
    for i, a in enumerate(horizons):
        for b in horizons[i + 1 :]:
            for f in bad:
                tol = 1e-12 if f == "future_xg" else 0
                bad[f] = bad[f] | F.coalesce(F.col(name(f, a)) > F.col(name(f, b)) + tol, F.lit(False))
    return labels.agg(
        F.count(F.lit(1)).alias("anchors"), *[F.count_if(c).alias(f"{f}_violations") for f, c in bad.items()]
    )


def reconstruct_outcomes(anchors: DataFrame, outcomes: DataFrame, session: Sequence[str], horizons: dict[str, int]) -> DataFrame:
    """The labels of ``anchor_outcomes`` by another route: a range join over time buckets.

    A bucket is as wide as the longest horizon, so an anchor meets the outcomes of its own bucket and the next by
    equality; later buckets count by their totals only, summed from the far end. Pairs are bounded by what lies in two
    buckets, not by the session. Columns are those of ``anchor_outcomes``.
    """
    session, width = list(session), max(horizons.values())
    bucket = lambda t: F.floor(F.col(t) / width).cast("bigint")
    a = anchors.select(*session, "event_id", "event_index", "t_us", bucket("t_us").alias("__b"))
    o = outcomes.select(
        *session,
        bucket("t_us").alias("__ob"),
        F.struct(F.col("event_index").alias("i"), F.col("event_id").alias("id"), F.col("t_us").alias("t"), F.col("shot_xg").alias("xg")).alias("__o"),
        (F.col("outcome_type") == "shot").alias("__shot"),
    )
    shot, entry = F.col("__shot"), ~F.col("__shot")
    exact = F.coalesce(F.col("__o.xg"), F.lit(0)).cast(_SCALE)
    gone = shot & F.col("__o.xg").isNull()

    near = a.withColumn("__ob", F.explode(F.array(F.col("__b"), F.col("__b") + 1)))
    pairs = near.join(o, [*session, "__ob"]).where(F.col("__o.i") >= F.col("event_index"))
    wait = F.col("__o.t") - F.col("t_us")
    key = [*session, "event_id", "event_index", "t_us", "__b"]
    met = pairs.groupBy(*key).agg(
        *[F.max(entry & (wait <= us)).alias(f"__e_{h}") for h, us in horizons.items()],
        *[F.max(shot & (wait <= us)).alias(f"__s_{h}") for h, us in horizons.items()],
        *[F.sum(F.when(shot & (wait <= us), exact)).alias(f"__x_{h}") for h, us in horizons.items()],
        *[F.count_if(gone & (wait <= us)).alias(f"__g_{h}") for h, us in horizons.items()],
        F.sum(F.when(shot, exact)).alias("__x"),
        F.count_if(gone).alias("__g"),
        F.min(F.when(entry, F.col("__o"))).alias("__e"),
        F.min(F.when(shot, F.col("__o"))).alias("__s"),
    )
    totals = o.groupBy(*session, F.col("__ob").alias("__at")).agg(
        F.sum(F.when(shot, exact)).alias("x"), F.count_if(gone).alias("g"), F.min(F.when(entry, F.col("__o"))).alias("e"), F.min(F.when(shot, F.col("__o"))).alias("s")
    )
    marks = a.select(*session, (F.col("__b") + 1).alias("__at")).distinct().withColumn("__mark", F.lit(True))
    after = Window.partitionBy(*session).orderBy("__at").rangeBetween(1, Window.unboundedFollowing)
    later = totals.unionByName(marks, allowMissingColumns=True).select(
        *session, (F.col("__at") - 1).alias("__b"), "__mark", F.sum("x").over(after).alias("__lx"), F.sum("g").over(after).alias("__lg"), F.min("e").over(after).alias("__le"), F.min("s").over(after).alias("__ls")
    )
    rows = a.join(met, key, "left").join(later.where("__mark").drop("__mark"), [*session, "__b"], "left")
    nxt = {"box_entry": F.coalesce("__e", "__le"), "shot": F.coalesce("__s", "__ls")}
    zero = F.lit(0)
    out = [F.coalesce((nxt[n]["id"] == F.col("event_id")).cast("int"), zero).alias(f"reference_is_{n}") for n in nxt]
    out.append(F.when(nxt["shot"]["id"] == F.col("event_id"), nxt["shot"]["xg"]).alias("reference_shot_xg"))
    for n, first in nxt.items():
        out += [((first["t"] - F.col("t_us")) / 1e6).alias(f"seconds_to_next_{n}"), first["id"].alias(f"next_{n}_event_id")]
        out.append(first.isNotNull().cast("int").alias(f"{n}_before_session_end"))
    out.append(nxt["shot"]["xg"].alias("next_shot_xg"))
    for h in horizons:
        out += [F.coalesce(F.col(f"__e_{h}").cast("int"), zero).alias(f"box_entry_within_{h}"), F.coalesce(F.col(f"__s_{h}").cast("int"), zero).alias(f"shot_within_{h}")]
        out.append(F.when(F.coalesce(f"__g_{h}", zero) == 0, F.coalesce(f"__x_{h}", zero).cast("double")).alias(f"future_xg_{h}"))
    rest = F.coalesce("__x", zero).cast(_SCALE) + F.coalesce("__lx", zero).cast(_SCALE)
    out.append(F.when(F.coalesce("__g", zero) + F.coalesce("__lg", zero) == 0, rest.cast("double")).alias("future_xg_rest"))
    return rows.select(*session, "event_id", "event_index", "t_us", *out)


def validate_outcomes(labels: DataFrame, anchors: DataFrame, outcomes: DataFrame, session: Sequence[str], horizons: dict[str, int], tol: float = 1e-12) -> DataFrame:
    """One row per fault of a label table: ``session, event_id, problem, labelled, expected``; none if it is right.

    Problems: ``missing`` and ``extra`` anchors, ``repeated`` rows (how many), ``nesting of`` a family where a shorter
    horizon exceeds a longer one, and each column that differs from ``reconstruct_outcomes`` by more than ``tol``, or is
    null on one side only.
    """
    key = [*session, "event_id"]
    value, none = lambda c: F.col(c).cast("double"), F.lit(None).cast("double")
    expected = reconstruct_outcomes(anchors, outcomes, session, horizons)
    columns = [c for c in expected.columns if c not in (*key, "event_index", "t_us")]
    one = labels.groupBy(*key).agg(*[F.first(c).alias(c) for c in columns], F.count(F.lit(1)).alias("__rows"))
    want = expected.select(*[F.col(k).alias(f"__{k}") for k in key], *[F.col(c).alias(f"__w_{c}") for c in columns])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    both = one.join(want, on, "full")
    have, due = F.col("__rows").isNotNull(), F.col("__event_id").isNotNull()

    def fault(when: Column, problem: str, labelled: Column = none, want: Column = none) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(problem).alias("problem"), labelled.alias("labelled"), want.alias("expected")))

    faults = [fault(due & ~have, "missing"), fault(have & ~due, "extra"), fault(F.col("__rows") > 1, "repeated", value("__rows"), F.lit(1.0))]
    family = {"box_entry": "box_entry_within_{}", "shot": "shot_within_{}", "future_xg": "future_xg_{}"}
    ordered = sorted(horizons, key=horizons.get)
    for f, pattern in family.items():
        steps = [*[pattern.format(h) for h in ordered], "future_xg_rest" if f == "future_xg" else f"{f}_before_session_end"]
        broken = [value(x) > value(y) + tol for k, x in enumerate(steps) for y in steps[k + 1 :]]
        faults.append(fault(F.greatest(*[F.coalesce(b, F.lit(False)) for b in broken]) & have, f"nesting of {f}"))
    for c in columns:
        x, y = value(c), value(f"__w_{c}")
        faults.append(fault(have & due & ((x.isNull() != y.isNull()) | (F.abs(x - y) > tol)), c, x, y))
    names = [F.coalesce(k, f"__{k}").alias(k) for k in key]
    return both.select(*names, F.inline(F.array_compact(F.array(*faults))))


def compare_labels(base: DataFrame, again: DataFrame) -> DataFrame:
    """How many label rows differ between two runs over the same anchors."""
    changed = base.exceptAll(again.select(*base.columns)).agg(F.count(F.lit(1)).alias("changed_labels"))
    return changed.crossJoin(base.agg(F.count(F.lit(1)).alias("anchors")))


def check_inputs(events: DataFrame, session: Sequence[str], lane: Lane) -> DataFrame:
    """Duplicate ids, sessions that cross a period and clocks that run backwards."""
    from strideframe.operators.ordered import shift

    dup = events.groupBy("match_id", "event_id").count().agg(F.count_if(F.col("count") > 1).alias("duplicate_ids"))
    cross = (
        events.groupBy(*session)
        .agg(F.min("period").alias("a"), F.max("period").alias("b"))
        .agg(F.count_if(F.col("a") != F.col("b")).alias("crossing_sessions"))
    )
    clock = shift(events, lane, {"__t": "t_us"}).agg(F.count_if(F.col("t_us") < F.col("__t")).alias("reversed_clock"))
    return dup.crossJoin(cross).crossJoin(clock)
