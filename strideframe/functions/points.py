"""SQL expressions over arrays of points kept inside one row.

A snapshot is one row, so these never shuffle and stay on the JVM.
"""

from __future__ import annotations


def let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` in ``body``, also inside lambdas."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def finite(v: str) -> str:
    return f"({v} IS NOT NULL AND NOT isnan({v}) AND abs({v}) < double('infinity'))"


def valid(p: str) -> str:
    return f"({finite(p + '.x')} AND {finite(p + '.y')})"


def total(arr: str, field: str) -> str:
    return f"aggregate({arr}, 0.0D, (a, p) -> a + p.{field})"


def spread(arr: str, field: str) -> str:
    return let("vs", f"transform({arr}, p -> p.{field})", "array_max(vs) - array_min(vs)")


def pair_distances(arr: str) -> str:
    """Distances over unordered pairs, repeats kept."""
    return let(
        "ps",
        arr,
        "flatten(transform(ps, (p, i) -> transform("
        "slice(ps, i + 2, greatest(size(ps) - i - 1, 0)), q -> hypot(p.x - q.x, p.y - q.y))))",
    )


def nearest_distances(arr: str) -> str:
    """Distance of every record to its closest other record."""
    return let(
        "ps",
        arr,
        "transform(ps, (p, i) -> array_min(transform(filter(ps, (q, j) -> j <> i), q -> hypot(p.x - q.x, p.y - q.y))))",
    )


def mean(arr: str) -> str:
    return let("ms", arr, "aggregate(ms, 0.0D, (a, v) -> a + v) / size(ms)")


def median(sorted_arr: str) -> str:
    n = f"size({sorted_arr})"
    return (
        f"((element_at({sorted_arr}, CAST(floor(({n} + 1) / 2) AS INT)) + "
        f"element_at({sorted_arr}, CAST(floor(({n} + 2) / 2) AS INT))) / 2)"
    )


def distinct_xy(arr: str) -> str:
    return f"array_distinct(transform({arr}, p -> named_struct('x', p.x, 'y', p.y)))"


def turn(a: str, b: str, c: str) -> str:
    """Twice the signed area of triangle a, b, c."""
    return f"(({b}.x - {a}.x) * ({c}.y - {a}.y) - ({b}.y - {a}.y) * ({c}.x - {a}.x))"


def reach(a: str, b: str) -> str:
    return f"(({b}.x - {a}.x) * ({b}.x - {a}.x) + ({b}.y - {a}.y) * ({b}.y - {a}.y))"


def hull_area(u: str) -> str:
    """Area of the convex hull of distinct points by walking the boundary once.

    Each step takes the point with every other point on its left, so the work is
    at most (points squared) within the row.
    """
    step = (
        f"aggregate(us, CAST(NULL AS STRUCT<x: DOUBLE, y: DOUBLE>), (b, c) -> CASE "
        f"WHEN c = s.cur THEN b WHEN b IS NULL THEN c "
        f"WHEN {turn('s.cur', 'b', 'c')} < 0 THEN c "
        f"WHEN {turn('s.cur', 'b', 'c')} = 0 AND {reach('s.cur', 'c')} > {reach('s.cur', 'b')} THEN c ELSE b END)"
    )
    move = let("n", step, f"named_struct('cur', n, 'area', s.area + {turn('st', 's.cur', 'n')}, 'done', n = st)")
    walk = (
        "aggregate(sequence(1, size(us)), named_struct('cur', st, 'area', 0.0D, 'done', false), "
        f"(s, k) -> CASE WHEN s.done THEN s ELSE {move} END, s -> abs(s.area) / 2)"
    )
    return let("us", u, let("st", "array_min(us)", walk))


# --- flat polygons [x0, y0, x1, y1, ...] -------------------------------------------------


def ring(flat: str) -> str:
    """Vertices of a flat polygon."""
    return let(
        "fl",
        flat,
        "transform(sequence(1, CAST(floor(size(fl) / 2) AS INT)), "
        "k -> named_struct('x', element_at(fl, 2 * k - 1), 'y', element_at(fl, 2 * k)))",
    )


def ring_edges(r: str) -> str:
    return let(
        "rg",
        r,
        "transform(rg, (p, i) -> named_struct('i', i, 'a', p, 'b', element_at(rg, CAST((i + 1) % size(rg) AS INT) + 1)))",
    )


def shoelace(r: str) -> str:
    return f"(abs(aggregate({ring_edges(r)}, 0.0D, (t, e) -> t + e.a.x * e.b.y - e.b.x * e.a.y)) / 2)"


def _meets(e: str, f: str) -> str:
    """Closed segments share a point."""
    t1, t2 = turn(f"{e}.a", f"{e}.b", f"{f}.a"), turn(f"{e}.a", f"{e}.b", f"{f}.b")
    t3, t4 = turn(f"{f}.a", f"{f}.b", f"{e}.a"), turn(f"{f}.a", f"{f}.b", f"{e}.b")
    boxes = " AND ".join(
        f"greatest(least({e}.a.{c}, {e}.b.{c}), least({f}.a.{c}, {f}.b.{c})) <= "
        f"least(greatest({e}.a.{c}, {e}.b.{c}), greatest({f}.a.{c}, {f}.b.{c}))"
        for c in "xy"
    )
    return f"(sign({t1}) * sign({t2}) <= 0 AND sign({t3}) * sign({t4}) <= 0 AND {boxes})"


def simple_ring(edges: str) -> str:
    """No two non-adjacent edges meet and no edge doubles back on the one before."""
    far = "(f.i - e.i) > 1 AND NOT (e.i = 0 AND f.i = size(eg) - 1)"
    back = (
        f"(f.i = e.i + 1 OR (e.i = size(eg) - 1 AND f.i = 0)) AND {turn('e.a', 'e.b', 'f.b')} = 0 AND "
        f"((e.b.x - e.a.x) * (f.b.x - f.a.x) + (e.b.y - e.a.y) * (f.b.y - f.a.y)) < 0"
    )
    cross = f"NOT exists(eg, e -> exists(eg, f -> ({far} AND {_meets('e', 'f')}) OR ({back})))"
    return let("eg", edges, cross)


def clip(r: str, field: str, limit: float, keep_above: bool) -> str:
    """Clip a ring against one axis-parallel half plane."""
    other = "y" if field == "x" else "x"
    inside = lambda p: f"{p}.{field} {'>=' if keep_above else '<='} {limit!r}D"
    at = f"e.a.{other} + ({limit!r}D - e.a.{field}) / (e.b.{field} - e.a.{field}) * (e.b.{other} - e.a.{other})"
    cut = f"named_struct('{field}', {limit!r}D, '{other}', {at})"
    if field == "y":
        cut = f"named_struct('x', {at}, 'y', {limit!r}D)"
    return (
        f"flatten(transform({ring_edges(r)}, e -> CASE "
        f"WHEN {inside('e.a')} AND {inside('e.b')} THEN array(e.b) "
        f"WHEN {inside('e.a')} THEN array({cut}) "
        f"WHEN {inside('e.b')} THEN array({cut}, e.b) "
        f"ELSE CAST(array() AS ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>) END))"
    )


def segment_distance(p: str, e: str) -> str:
    dx, dy = f"({e}.b.x - {e}.a.x)", f"({e}.b.y - {e}.a.y)"
    dot = f"(({p}.x - {e}.a.x) * {dx} + ({p}.y - {e}.a.y) * {dy})"
    t = f"coalesce(greatest(0.0D, least(1.0D, {dot} / nullif({dx} * {dx} + {dy} * {dy}, 0.0D))), 0.0D)"
    return f"hypot({p}.x - {e}.a.x - {t} * {dx}, {p}.y - {e}.a.y - {t} * {dy})"


def boundary_distance(p: str, edges: str) -> str:
    return f"array_min(transform({edges}, e -> {segment_distance(p, 'e')}))"


def ray_inside(p: str, edges: str) -> str:
    """Even-odd rule."""
    hit = (
        f"((e.a.y > {p}.y) <> (e.b.y > {p}.y)) AND "
        f"{p}.x < (e.b.x - e.a.x) * ({p}.y - e.a.y) / (e.b.y - e.a.y) + e.a.x"
    )
    return f"(size(filter({edges}, e -> {hit})) % 2 = 1)"
