"""Quality of observation: excursions, coincidence, counterfactuals, bins and tails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.functions import points as P
from strideframe.operators.points import METRICS, VARIANT, measure, metric_rows
from strideframe.operators.quantiles import bin_code, distribution, exact_quantiles, quantile_edges
from strideframe.sources.stage import stored

SIDES = {"left": "x < 0", "right": "x > {l}", "bottom": "y < 0", "top": "y > {w}"}
FULL_LADDER = {f"p{q:02d}": q / 100 for q in (1, 5, 10, 25, 50, 75, 90, 95, 99)}


def excursion(points: DataFrame, length: float = 120.0, width: float = 80.0) -> DataFrame:
    """Sides violated, excess along each axis and distance to the rectangle, per point."""
    sides = {s: F.expr(c.format(l=f"{length!r}D", w=f"{width!r}D")) for s, c in SIDES.items()}
    out = points.withColumns(sides)
    return out.withColumns(
        {
            "sides_violated": sum((F.col(s).cast("int") for s in SIDES), F.lit(0)),
            "x_excess": F.greatest(F.lit(0.0), -F.col("x"), F.col("x") - length),
            "y_excess": F.greatest(F.lit(0.0), -F.col("y"), F.col("y") - width),
        }
    ).withColumn("pitch_distance", F.hypot("x_excess", "y_excess"))


def oob_summary(points: DataFrame, dims: dict[str, str], measures: Sequence[str], frame: Sequence[str], small: bool) -> DataFrame:
    """Long summary of out-of-bounds points over many alternative scopes."""
    scopes = [F.struct(F.lit("population").alias("scope"), F.lit("all").alias("value"))]
    scopes += [F.struct(F.lit(s).alias("scope"), F.expr(f"CAST({e} AS STRING)").alias("value")) for s, e in dims.items()]
    rows = points.where("sides_violated > 0").select("*", F.inline(F.array(*scopes)))
    frames = (
        rows.groupBy("scope", "value", *frame)
        .agg(F.first("match_id").alias("m"))
        .groupBy("scope", "value")
        .agg(F.count(F.lit(1)).alias("affected_frames"), F.count_distinct("m").alias("affected_matches"))
    )
    long = rows.select(
        "scope", "value", F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in measures]))
    )
    stats = distribution(long, ["scope", "value", "measure"], "v", small, {"median": 0.5, "p90": 0.9, "p99": 0.99})
    frames = frames.select(F.col("scope").alias("__s"), F.col("value").alias("__v"), "affected_frames", "affected_matches")
    on = F.col("scope").eqNullSafe(F.col("__s")) & F.col("value").eqNullSafe(F.col("__v"))
    return stats.join(frames, on).drop("__s", "__v", "std")


def coincident_groups(points: DataFrame, frame: Sequence[str]) -> DataFrame:
    """Exactly equal coordinates held by several records, with flag tallies."""
    flags = ("teammate", "keeper", "actor")
    tally = {f"{f}_{v}_count": F.count_if(F.col(f) == (v == "true")) for f in flags for v in ("true", "false")}
    tally |= {f"{f}_unknown_count": F.count_if(F.col(f).isNull()) for f in flags}
    g = points.groupBy(*frame, "x", "y").agg(F.count(F.lit(1)).alias("group_size"), *[c.alias(n) for n, c in tally.items()])
    return g.where("group_size > 1").withColumn("excess_records", F.col("group_size") - 1)


def multiplicity_impact(variants: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add one copy of every coincident point, recompute all measures, and compare.

    ``variants`` holds the selected points in ``pts``; each coincident group of a row
    becomes one perturbed row, measured with the same expressions.
    """
    groups = P.let(
        "ps",
        "pts",
        "filter(array_distinct(transform(ps, p -> named_struct('x', p.x, 'y', p.y))), "
        "u -> size(filter(ps, p -> p.x = u.x AND p.y = u.y)) > 1)",
    )
    hit = variants.withColumn("__g", F.expr(groups)).where("size(__g) > 0")
    both = hit.select(*keys, "pts", F.posexplode("__g").alias("group_index", "__u"))
    copy = P.let("u", "__u", "slice(filter(pts, p -> p.x = u.x AND p.y = u.y), 1, 1)")
    both = both.select(
        *keys,
        "group_index",
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("extra"), F.col("pts").alias("pts")),
                F.struct(F.lit(1).alias("extra"), F.expr(f"concat(pts, {copy})").alias("pts")),
            )
        ),
    )
    rows = metric_rows(measure(both), [*keys, "group_index", "extra"])
    pick = lambda c, e: F.max(F.when(F.col("extra") == e, F.col(c)))
    out = rows.groupBy(*keys, "group_index", "metric").agg(
        pick("value", 0).alias("original"),
        pick("value", 1).alias("one_extra_record"),
        pick("status", 0).alias("original_status"),
        pick("status", 1).alias("perturbed_status"),
    )
    return out.withColumn("delta", F.col("one_extra_record") - F.col("original"))


def bin_column(df: DataFrame, col: str, k: int, small: bool, name: str, keys: Sequence[str] = (), prefix: str = "Q") -> DataFrame:
    """Label rows with the quantile bin of ``col``; null is ``unavailable``.

    The edges are one short array per group and are joined on the group.
    """
    edges = quantile_edges(df, list(keys), col, k, small, "__edges")
    if keys:
        edges = edges.select(*[F.col(c).alias(f"__k_{c}") for c in keys], "__edges")
        on = F.lit(True)
        for c in keys:
            on = on & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
        df = df.join(edges, on, "left").drop(*[f"__k_{c}" for c in keys])
    else:
        df = df.crossJoin(F.broadcast(edges))  # exactly one row
    code = bin_code(col, "__edges")
    label = F.coalesce(F.concat(F.lit(prefix), code.cast("string")), F.lit("unavailable"))
    return df.withColumn(name, label).drop("__edges")


def metric_by_bin(rows: DataFrame, by: Sequence[str], edge: str, k: int, small: bool) -> DataFrame:
    """Metric statistics per quantile bin of another column, bins cut per group."""
    if not small:
        rows = stored(rows.select(*dict.fromkeys([*by, edge, "value"])))  # read for the edges, the moments and the quantiles
    binned = bin_column(rows, edge, k, small, "bin", by)
    return distribution(binned, [*by, "bin"], "value", small, {"p25": 0.25, "median": 0.5, "p75": 0.75}, {"n_rows": F.count(F.lit(1))})


def tail_profile(rows: DataFrame, by: Sequence[str], medians: Sequence[str], shares: dict[str, Column], small: bool) -> DataFrame:
    """Rows in the lower and upper percent of each metric, and all, with medians and flag shares."""
    ok = rows.where("value IS NOT NULL")
    if not small:
        # read once for the cuts and once for each column below
        flags = {f"__{n}": c for n, c in shares.items()}
        ok = stored(ok.select(*by, "value", *medians, *[c.alias(n) for n, c in flags.items()]))
        shares = {n: F.col(f"__{n}") for n in shares}
    cut = exact_quantiles(ok, list(by), "value", {"lo": 0.01, "hi": 0.99}, small)
    j = ok.join(cut, list(by))
    tails = F.array_compact(
        F.array(
            F.when(F.col("value") <= F.col("lo"), F.lit("lower_1_percent")),
            F.when(F.col("value") >= F.col("hi"), F.lit("upper_1_percent")),
            F.lit("all_defined"),
        )
    )
    t = j.withColumn("tail", F.explode(tails))
    out = t.groupBy(*by, "tail").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.mean(c.cast("int")).alias(f"{n}_fraction") for n, c in shares.items()]
    )
    for m in ("value", *medians):
        out = out.join(exact_quantiles(t, [*by, "tail"], m, {f"{m}_median": 0.5}, small), [*by, "tail"], "left")
    return out


def extreme_rows(rows: DataFrame, by: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Smallest and largest row of each metric; ties by the lowest key."""
    ok = rows.where("value IS NOT NULL")
    one = F.struct(*tie)
    lo = F.min(F.struct("value", one.alias("k")))
    hi = F.min(F.struct((-F.col("value")).alias("value"), one.alias("k")))
    g = ok.groupBy(*by).agg(lo.alias("lo"), hi.alias("hi"))
    both = F.array(
        F.struct(F.lit("minimum").alias("tail"), F.col("lo.value").alias("value"), F.col("lo.k").alias("k")),
        F.struct(F.lit("maximum").alias("tail"), (-F.col("hi.value")).alias("value"), F.col("hi.k").alias("k")),
    )
    return g.select(*by, F.inline(both)).select(*by, "tail", "value", "k.*")


def representatives(df: DataFrame, rules: dict[str, tuple[str, str]], key: Sequence[str]) -> DataFrame:
    """One row per rule: (condition, score), smallest score first, ties by key.

    All rules are resolved in a single aggregation.
    """
    packed = F.struct(*key)
    aggs = [
        F.min(F.when(F.expr(cond) & F.expr(score).isNotNull(), F.struct(F.expr(score).cast("double").alias("score"), packed.alias("k")))).alias(f"r{i}")
        for i, (cond, score) in enumerate(rules.values())
    ]
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("selection_rule"), F.col(f"r{i}.score").alias("score"), F.col(f"r{i}.k").alias("k"))
            for i, n in enumerate(rules)
        ]
    )
    return df.agg(*aggs).select(F.inline(rows)).where("k IS NOT NULL").select("selection_rule", "score", "k.*")


def count_coverage_support(geometry: DataFrame, frames: DataFrame, bins: int, small: bool) -> DataFrame:
    """Joint strata of point count and coverage bin with support of every metric.

    Edges come from the snapshots, each weighted once.
    """
    edges = quantile_edges(frames, [], "visible_area_fraction", bins, small, "__edges")
    labelled = geometry.crossJoin(F.broadcast(edges)).withColumn(  # exactly one row
        "area_bin",
        F.coalesce(F.concat(F.lit("B"), bin_code("visible_area_fraction", "__edges").cast("string")), F.lit("unavailable")),
    )
    by = [*VARIANT, "n_valid_points_used", "area_bin"]
    if not small:
        labelled = stored(labelled.select(*by, "match_id", *METRICS, *[f"{m}_status" for m in METRICS]))
    base = labelled.groupBy(*by).agg(F.count(F.lit(1)).alias("frames"), F.count_distinct("match_id").alias("matches"))
    rows = metric_rows(labelled, by)
    med = distribution(rows, [*by, "metric"], "value", small, {"median": 0.5}).select(
        *[F.col(c).alias(f"__{c}") for c in by], "metric", F.col("count").alias("defined"), "median"
    )
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return base.join(med, on).drop(*[f"__{c}" for c in by])


