"""Visible-area polygons: inspection, clipping and point relations, all inside the row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.functions import points as P


def polygon_inspect(df: DataFrame, flat: str, length: float = 120.0, width: float = 80.0) -> DataFrame:
    """Status, vertex count, area and the part on the pitch rectangle.

    Missing is a null array; fewer than six values, an odd number or a non-finite
    value is malformed; a ring that crosses itself or has no area is invalid.
    """
    ok = f"(size({flat}) >= 6 AND size({flat}) % 2 = 0 AND forall({flat}, v -> {P.finite('v')}))"
    # A closing vertex equal to the first is not a further corner.
    r = P.ring(flat)
    df = df.withColumn("__r", F.expr(f"CASE WHEN {ok} THEN {r} END"))
    df = df.withColumn(
        "__ring", F.expr("CASE WHEN element_at(__r, 1) = element_at(__r, -1) THEN slice(__r, 1, size(__r) - 1) ELSE __r END")
    ).withColumn("__edges", F.expr(P.ring_edges("__ring")))
    df = df.withColumns(
        {
            "vertex_count": F.expr("size(__r)"),
            "__area": F.expr(P.shoelace("__ring")),
            "__simple": F.expr(f"size(__ring) >= 3 AND {P.simple_ring('__edges')}"),
        }
    )
    df = df.withColumn(
        "polygon_status",
        F.expr(
            f"CASE WHEN {flat} IS NULL THEN 'missing' WHEN __r IS NULL THEN 'malformed' "
            "WHEN NOT __simple OR __area <= 0 THEN 'invalid' ELSE 'valid' END"
        ),
    )
    valid = F.col("polygon_status") == "valid"
    df = df.withColumn("__clip", F.when(valid, F.col("__ring")))
    for field, limit, above in (("x", 0.0, True), ("x", length, False), ("y", 0.0, True), ("y", width, False)):
        df = df.withColumn("__clip", F.expr(P.clip("__clip", field, limit, above)))
    df = df.withColumns(
        {
            "polygon_area": F.when(valid, F.col("__area")),
            "area_inside_pitch": F.when(valid, F.expr(f"CASE WHEN size(__clip) < 3 THEN 0.0D ELSE {P.shoelace('__clip')} END")),
            "extends_outside_pitch": F.when(
                valid,
                F.expr(f"exists(__ring, p -> p.x < 0 OR p.x > {length!r}D OR p.y < 0 OR p.y > {width!r}D)"),
            ),
        }
    )
    df = df.withColumns(
        {
            "visible_area_fraction": F.col("area_inside_pitch") / (length * width),
            "area_outside_pitch": F.col("polygon_area") - F.col("area_inside_pitch"),
            "fraction_outside_pitch": (F.col("polygon_area") - F.col("area_inside_pitch")) / F.col("polygon_area"),
        }
    )
    return df.withColumn("__edges", F.when(valid, F.col("__edges"))).drop("__r", "__ring", "__area", "__simple", "__clip")


def point_relations(df: DataFrame, points: str = "points") -> DataFrame:
    """Replace ``points`` by the same structs with polygon relation and boundary distance.

    Needs the ``__edges`` left by :func:`polygon_inspect`; without a valid polygon
    the relation is ``unavailable`` and the distance null.
    """
    one = (
        f"transform(array({P.boundary_distance('p', 'g')}), d -> named_struct("
        "'i', p.i, 'x', p.x, 'y', p.y, 'teammate', p.teammate, 'keeper', p.keeper, 'actor', p.actor, "
        "'relation', CASE WHEN g IS NULL THEN 'unavailable' WHEN d = 0 THEN 'boundary' "
        f"WHEN {P.ray_inside('p', 'g')} THEN 'inside' ELSE 'outside' END, 'edge_distance', d))[0]"
    )
    related = P.let("g", "__edges", f"transform({points}, p -> {one})")
    return df.withColumn(points, F.expr(related))


def edge_distances(df: DataFrame, points: str = "points") -> DataFrame:
    """Distance to the boundary at each extreme (closest of ties), over all points, and ties."""
    ext = {
        "min_x": ("x", "array_min"),
        "max_x": ("x", "array_max"),
        "min_y": ("y", "array_min"),
        "max_y": ("y", "array_max"),
    }
    usable = F.expr(f"size({points}) > 0 AND __edges IS NOT NULL")
    cols = {
        "edge_status": F.expr(
            f"CASE WHEN coalesce(size({points}), 0) = 0 THEN 'empty_points' WHEN __edges IS NULL THEN 'polygon_unavailable' ELSE 'ok' END"
        ),
        "minimum_edge_distance": F.when(usable, F.expr(f"array_min(transform({points}, p -> p.edge_distance))")),
        "median_edge_distance": F.when(
            usable, F.expr(P.median(f"sort_array(transform({points}, p -> p.edge_distance))"))
        ),
        "outside_count": F.when(usable, F.expr(f"size(filter({points}, p -> p.relation = 'outside'))")),
    }
    for name, (axis, op) in ext.items():
        at = f"filter({points}, p -> p.{axis} = {op}(transform({points}, q -> q.{axis})))"
        cols[f"{name}_edge_distance"] = F.when(usable, F.expr(f"array_min(transform({at}, p -> p.edge_distance))"))
        cols[f"{name}_tied_records"] = F.when(usable, F.expr(f"size({at})"))
    return df.withColumns(cols)


def tied_extremes(df: DataFrame, keys: list[str], points: str = "points") -> DataFrame:
    """Every record that shares an extreme with another one."""
    rows = []
    for name, axis, op in (("min_x", "x", "min"), ("max_x", "x", "max"), ("min_y", "y", "min"), ("max_y", "y", "max")):
        at = P.let("v", f"array_{op}(transform(s, q -> q.{axis}))", f"filter(s, p -> p.{axis} = v)")
        shared = (
            f"transform(a, p -> named_struct('extreme', '{name}', 'i', p.i, 'edge_distance', p.edge_distance, "
            "'relation', p.relation))"
        )
        rows.append(f"transform(filter(array({at}), a -> size(a) > 1), a -> {shared})")
    packed = P.let("s", points, f"flatten(concat({', '.join(rows)}))")
    return df.where("__edges IS NOT NULL").select(*keys, F.expr(f"inline({packed})"))
