"""Per-snapshot point-cloud measures.

A snapshot row holds ``points``: array<struct<i, x, y, teammate, keeper, actor>>.
A null array is an unavailable container, an empty one is known to be empty.
All measures stay inside the row: no shuffle, no join, no Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.functions import points as P
from strideframe.operators.quantiles import distribution

#: fixed values
SUBSETS = ("all_visible", "teammate_true", "teammate_false")
POLICIES = ("included", "excluded")
METRICS = (
    "point_count",
    "centroid_x",
    "centroid_y",
    "width",
    "depth",
    "hull_area",
    "mean_pair_distance",
    "median_pair_distance",
    "mean_nearest_distance",
)
VARIANT = ["selected_subset", "goalkeeper_policy"]


def actor_status(points: str = "points") -> str:
    """multiple > unknown > single > none."""
    actors = f"size(filter({points}, p -> p.actor <=> true))"
    unsure = f"exists({points}, p -> p.actor IS NULL OR NOT {P.valid('p')})"
    return (
        f"CASE WHEN {points} IS NULL THEN 'unknown' WHEN {actors} >= 2 THEN 'multiple' "
        f"WHEN {unsure} THEN 'unknown' WHEN {actors} = 1 THEN 'single' ELSE 'none' END"
    )


def point_variants(frames: DataFrame) -> DataFrame:
    """Six rows per snapshot: three subsets, goalkeepers in or out, empty ones kept."""
    six = ", ".join(f"named_struct('selected_subset', '{s}', 'goalkeeper_policy', '{g}')" for s in SUBSETS for g in POLICIES)
    chosen = (
        f"filter(points, p -> {P.valid('p')} AND (selected_subset = 'all_visible' "
        "OR (p.teammate <=> (selected_subset = 'teammate_true'))))"
    )
    return (
        frames.select("*", F.expr(f"inline(array({six}))"))
        .withColumn("__chosen", F.expr(chosen))
        .withColumn(
            "pts", F.expr("filter(__chosen, p -> goalkeeper_policy = 'included' OR (p.keeper <=> false))")
        )
    )


def _count(arr: str, cond: str = "true") -> Column:
    return F.expr(f"CASE WHEN {arr} IS NOT NULL THEN size(filter({arr}, p -> {cond})) END")


def support_counts(variants: DataFrame, length: float = 120.0, width: float = 80.0) -> DataFrame:
    """Records used, distinct, coincident, out of bounds, and goalkeepers before the filter."""
    excluded = F.col("goalkeeper_policy") == "excluded"
    out = variants.withColumns(
        {
            "n_valid_points_used": _count("pts"),
            "n_unique_points": F.expr(f"CASE WHEN pts IS NOT NULL THEN size({P.distinct_xy('pts')}) END"),
            "n_out_of_bounds_points": _count(
                "pts", f"NOT (p.x BETWEEN 0 AND {length!r}D AND p.y BETWEEN 0 AND {width!r}D)"
            ),
            "n_keeper_true_before_filter": _count("__chosen", "p.keeper <=> true"),
            "n_keeper_unknown_before_filter": _count("__chosen", "p.keeper IS NULL"),
        }
    )
    dropped = {
        f"n_keeper_{s}_excluded": F.when(F.col("pts").isNotNull(), F.when(excluded, F.col(f"n_keeper_{s}_before_filter")).otherwise(0))
        for s in ("true", "unknown")
    }
    return out.withColumns(
        {"n_coincident_records": F.col("n_valid_points_used") - F.col("n_unique_points"), **dropped}
    )


def measure(variants: DataFrame) -> DataFrame:
    """Nine measures with a status each; a value is null unless its status is ``ok``."""
    n = "size(pts)"
    wide = variants.withColumns(
        {
            "__u": F.expr(P.distinct_xy("pts")),
            "__d": F.expr(f"sort_array({P.pair_distances('pts')})"),
        }
    )
    raw = {
        "point_count": f"CAST({n} AS DOUBLE)",
        "centroid_x": f"CASE WHEN {n} > 0 THEN {P.total('pts', 'x')} / {n} END",
        "centroid_y": f"CASE WHEN {n} > 0 THEN {P.total('pts', 'y')} / {n} END",
        "width": f"CASE WHEN {n} > 0 THEN {P.spread('pts', 'y')} END",
        "depth": f"CASE WHEN {n} > 0 THEN {P.spread('pts', 'x')} END",
        "hull_area": f"CASE WHEN size(__u) >= 3 THEN {P.hull_area('__u')} END",
        "mean_pair_distance": f"CASE WHEN {n} > 1 THEN {P.mean('__d')} END",
        "median_pair_distance": f"CASE WHEN {n} > 1 THEN {P.median('__d')} END",
        "mean_nearest_distance": f"CASE WHEN {n} > 1 THEN {P.mean(P.nearest_distances('pts'))} END",
    }
    wide = wide.withColumns({m: F.expr(e) for m, e in raw.items()})
    spoiled = f"exists(__d, d -> NOT {P.finite('d')})"
    status = {"point_count": "'ok'"}
    for m in ("centroid_x", "centroid_y"):
        status[m] = (
            f"CASE WHEN {n} = 0 THEN 'empty_points' WHEN {P.finite('centroid_x')} AND {P.finite('centroid_y')} "
            "THEN 'ok' ELSE 'numeric_error' END"
        )
    for m in ("width", "depth"):
        status[m] = f"CASE WHEN {n} = 0 THEN 'empty_points' WHEN {P.finite(m)} THEN 'ok' ELSE 'numeric_error' END"
    status["hull_area"] = (
        f"CASE WHEN {n} < 3 THEN 'insufficient_points' WHEN size(__u) < 3 THEN 'insufficient_unique_points' "
        f"WHEN NOT {P.finite('hull_area')} THEN 'numeric_error' WHEN hull_area = 0 THEN 'degenerate_hull' ELSE 'ok' END"
    )
    for m in METRICS[6:]:
        status[m] = f"CASE WHEN {n} < 2 THEN 'insufficient_points' WHEN {spoiled} THEN 'numeric_error' ELSE 'ok' END"
    wide = wide.withColumns(
        {f"{m}_status": F.expr(f"CASE WHEN pts IS NULL THEN 'frame_unavailable' ELSE {e} END") for m, e in status.items()}
    )
    return wide.withColumns({m: F.when(F.col(f"{m}_status") == "ok", F.col(m)) for m in METRICS}).drop("__u", "__d")


def frame_geometry(frames: DataFrame) -> DataFrame:
    """Variant rows with support counts and measures; raw points dropped."""
    return measure(support_counts(point_variants(frames))).drop("points", "pts", "__chosen")


def measurement_flags(variants: DataFrame) -> DataFrame:
    """Sorted set of anomaly flags per variant row (needs support counts and ``points``)."""
    spoiled = f"exists(points, p -> NOT {P.valid('p')})"
    flag = lambda cond, name: F.when(F.expr(cond), F.lit(name))
    flags = F.array_compact(
        F.array(
            flag("points IS NULL", "frame_unavailable"),
            flag(spoiled, "partial_invalid_input"),
            flag("exists(points, p -> p.teammate IS NULL)", "unknown_teammate"),
            flag("exists(points, p -> p.keeper IS NULL)", "unknown_keeper"),
            flag(f"({actor_status()}) = 'multiple'", "multiple_actor"),
            flag(f"({actor_status()}) = 'unknown'", "actor_status_unknown"),
            flag("n_coincident_records > 0", "coincident_records"),
            flag("n_out_of_bounds_points > 0", "out_of_bounds_points"),
        )
    )
    return variants.withColumn("measurement_flags", F.array_sort(F.array_distinct(flags)))


def validate_variants(variants: DataFrame, frame: Sequence[str]) -> DataFrame:
    """Snapshots that do not have exactly the six distinct variants."""
    per = variants.groupBy(*frame).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(*[F.col(v) for v in VARIANT]).alias("n_variants")
    )
    return per.agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(F.expr("n_rows <> 6 OR n_variants <> 6")).alias("bad_frames")
    )


def metric_rows(geometry: DataFrame, keep: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row per variant and metric: (keep, metric, value, status)."""
    packed = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.col(f"{m}_status").alias("status")
            )
            for m in metrics
        ]
    )
    return geometry.select(*keep, F.inline(packed))


QS = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def geometry_distributions(rows: DataFrame, by: Sequence[str], small: bool) -> DataFrame:
    """Rows, availability and distribution of each metric per group (null groups kept)."""
    extra = {"n_rows": F.count(F.lit(1)), "na": F.count_if(F.col("value").isNull())}
    out = distribution(rows, list(by), "value", small, QS, extra)
    return out.withColumn("na_percent", 100 * F.col("na") / F.col("n_rows")).withColumnRenamed("count", "available")


def status_counts(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("n_rows"))


def shared_histogram(rows: DataFrame, by: Sequence[str], bins: int = 30) -> DataFrame:
    """Counts over ``bins`` equal bins shared by all groups of a metric; empty bins kept."""
    edges = rows.groupBy("metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo IS NOT NULL")
    edges = edges.select(
        "metric",
        F.expr("CASE WHEN lo = hi THEN lo - 0.5D ELSE lo END").alias("lo"),
        F.expr("CASE WHEN lo = hi THEN hi + 0.5D ELSE hi END").alias("hi"),
    )
    coded = (
        rows.join(F.broadcast(edges), "metric")  # one row per metric name
        .withColumn("bin", F.expr(f"CASE WHEN value IS NOT NULL THEN least(floor((value - lo) / (hi - lo) * {bins}), {bins - 1}) END"))
        .groupBy(*by, "metric", "lo", "hi", "bin")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    grid = coded.select(*by, "metric", "lo", "hi").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    counted = coded.where("bin IS NOT NULL").drop("lo", "hi")
    return grid.join(counted, [*by, "metric", "bin"], "left").select(
        *by,
        "metric",
        F.col("bin").cast("int").alias("bin"),
        (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / bins).alias("bin_left"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
    )


def paired_policy_delta(geometry: DataFrame, frame: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """Excluded minus included, per snapshot, subset and metric."""
    rows = metric_rows(
        geometry, [*frame, *VARIANT, "n_keeper_true_excluded", "n_keeper_unknown_excluded"], metrics
    )
    out = F.col("goalkeeper_policy") == "excluded"
    return rows.groupBy(*frame, "selected_subset", "metric").agg(
        (F.max(F.when(out, F.col("value"))) - F.max(F.when(~out, F.col("value")))).alias("delta"),
        F.max(F.when(out, F.col("n_keeper_true_excluded"))).alias("keepers_removed"),
        F.max(F.when(out, F.col("n_keeper_unknown_excluded"))).alias("unknown_removed"),
    )


def policy_sensitivity(deltas: DataFrame, small: bool) -> DataFrame:
    """Distribution of the paired change, for all pairs and for pairs that lost a record."""
    scopes = F.array(
        F.struct(F.lit("all_pairs").alias("scope"), F.lit(True).alias("member")),
        F.struct(
            F.lit("records_removed").alias("scope"),
            ((F.col("keepers_removed") + F.col("unknown_removed")) > 0).alias("member"),
        ),
    )
    rows = deltas.select("*", F.inline(scopes)).where("member").withColumnRenamed("delta", "value")
    extra = {
        "n_rows": F.count(F.lit(1)),
        "pairs_with_keeper_removal": F.count_if(F.col("keepers_removed") > 0),
        "pairs_with_unknown_removal": F.count_if(F.col("unknown_removed") > 0),
        "changed_pairs": F.count_if(F.col("value") != 0),
        "mean_absolute_delta": F.mean(F.abs("value")),
    }
    out = distribution(rows, ["selected_subset", "scope", "metric"], "value", small, QS, extra)
    return out.withColumnRenamed("count", "available")


def flag_inventory(flagged: DataFrame, frame: Sequence[str]) -> DataFrame:
    """Variant rows and distinct snapshots per flag."""
    rows = flagged.select(*frame, F.explode("measurement_flags").alias("flag"))
    per = rows.groupBy("flag", *frame).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("flag").agg(F.sum("n").alias("variant_rows"), F.count(F.lit(1)).alias("original_frames"))
