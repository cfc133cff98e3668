"""Ordered computations inside groups that stay balanced when one group is huge.

A :class:`Lane` names the group keys and a total order inside each group.  When
the caller can prove that groups are small (``block is None``) every function is
a plain window.  Otherwise ``block`` is an SQL expression, monotone in the order,
that cuts each group into pieces: windows then run inside (keys, block), one
summary row per block is aggregated map-side, and only those summaries are
windowed per key before being joined back.  No task ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.sources.stage import durable

#: Largest group that may be handed to a single task.
GROUP_LIMIT = 4_000_000

#: names of a scan's own columns all begin so; no caller's column may
_OWN = "__scan_"
_BLK = "__scan_block"


@dataclass(frozen=True)
class Lane:
    keys: tuple[str, ...]
    order: tuple[str, ...]
    block: str | None = None

    def by(self, *keys: str) -> "Lane":
        return replace(self, keys=tuple(keys))

    def ordered(self, *order: str) -> "Lane":
        return replace(self, order=tuple(order))


def lane_for(rows: int | None, keys: Iterable[str], order: Iterable[str], block: str) -> Lane:
    """Plain windows when ``rows`` (an upper bound for any group) is small."""
    small = rows is not None and rows <= GROUP_LIMIT
    return Lane(tuple(keys), tuple(order), None if small else block)


@dataclass(frozen=True)
class Scan:
    """Running aggregate: ``fn`` in sum, count, min, max, last, first.

    ``last`` is the most recent non-null value in the direction of travel.
    """

    fn: str
    expr: str
    backward: bool = False
    exclusive: bool = False


@dataclass(frozen=True)
class Shift:
    """The value ``k`` rows back (``k`` < 0: ahead), null where there is no such row."""

    expr: str
    k: int = 1


def _fold(fn: str, c: Column) -> Column:
    if fn == "last":
        return F.last(c, ignorenulls=True)
    if fn == "first":
        return F.first(c, ignorenulls=True)
    return getattr(F, fn)(c)


def _window(keys: Iterable[str], order: Iterable[str], scan: Scan) -> Window:
    cols = [F.col(o).desc() if scan.backward else F.col(o).asc() for o in order]
    end = -1 if scan.exclusive else 0
    return Window.partitionBy(*keys).orderBy(*cols).rowsBetween(Window.unboundedPreceding, end)


def _block_value(scan: Scan, order: tuple[str, ...]) -> Column:
    c = F.expr(scan.expr)
    if scan.fn not in ("last", "first"):
        return _fold(scan.fn, c)
    position = F.when(c.isNotNull(), F.struct(*order))
    latest = (scan.fn == "last") != scan.backward
    return F.max_by(c, position) if latest else F.min_by(c, position)


def _combine(fn: str, inside: Column, carried: Column) -> Column:
    if fn == "count":
        return F.coalesce(inside, F.lit(0)) + F.coalesce(carried, F.lit(0))
    if fn == "sum":
        return F.coalesce(inside + carried, inside, carried)
    if fn == "min":
        return F.least(inside, carried)
    if fn == "max":
        return F.greatest(inside, carried)
    return F.coalesce(inside, carried) if fn == "last" else F.coalesce(carried, inside)


def _inside(s: Scan | Shift, keys: Iterable[str], order: tuple[str, ...]) -> Column:
    if isinstance(s, Shift):
        return F.lag(F.expr(s.expr), s.k).over(Window.partitionBy(*keys).orderBy(*order))
    return _fold(s.fn, F.expr(s.expr)).over(_window(keys, order, s))


def _ends(s: Shift, order: tuple[str, ...]) -> Column:
    """The rows of a block that its neighbours may ask for, in order: the last or the first ``k``."""
    near = F.col("__scan_rev" if s.k > 0 else "__scan_pos") <= abs(s.k)
    return F.array_sort(F.collect_list(F.when(near, F.struct(*order, F.expr(s.expr).alias("__scan_v")))))


def _carry(name: str, s: Scan | Shift, lane: Lane) -> Column:
    """A block's summary merged over the blocks before it (after it, where the scan runs backward or the shift looks ahead)."""
    c = F.col(f"__scan_b_{name}")
    if isinstance(s, Scan):
        return _fold("sum" if s.fn == "count" else s.fn, c).over(_window(lane.keys, [_BLK], replace(s, exclusive=True)))
    # a block has a row at least, so as many blocks as rows are enough
    reach = (-s.k, -1) if s.k > 0 else (1, -s.k)
    return F.flatten(F.collect_list(c).over(Window.partitionBy(*lane.keys).orderBy(_BLK).rowsBetween(*reach)))


def _join(name: str, s: Scan | Shift) -> Column:
    inside, carried = F.col(name), F.col(f"__scan_c_{name}")
    if isinstance(s, Scan):
        return _combine(s.fn, inside, carried)
    # the k-th row back lies outside if the row's place in its block is k at most
    place = F.col("__scan_pos" if s.k > 0 else "__scan_rev")
    from_end = place - 1 - s.k if s.k > 0 else 1 - s.k - place
    return F.when(place > abs(s.k), inside).otherwise(F.try_element_at(carried, F.when(place <= abs(s.k), from_end.cast("int")).otherwise(1))["__scan_v"])


def scan(df: DataFrame, lane: Lane, specs: dict[str, Scan | Shift], kept: bool = False) -> DataFrame:
    """Add one column per spec, a running aggregate or a shifted value; all of one call share a pass and, in blocks, a store.

    A block's summary holds what the blocks beside it need of every spec: a count, a sum, an extreme, the latest value, or
    the last (first) k rows. Summaries merge in order of the blocks, whatever the number of specs. ``kept``: the rows are
    stored already, as they are.
    """
    if taken := [c for c in (*df.columns, *specs) if c.startswith(_OWN)]:
        raise ValueError(f"names that begin with {_OWN} are reserved: {taken}")
    if lane.block is None:
        return df.withColumns({n: _inside(s, lane.keys, lane.order) for n, s in specs.items()})
    # stored once: the rows are read twice below, and chained scans would otherwise
    # double the plan each time
    cut = df.withColumn(_BLK, F.expr(lane.block))
    cut = cut if kept else durable(cut)
    keys = [*lane.keys, _BLK]
    shifts = [s for s in specs.values() if isinstance(s, Shift)]
    if shifts:
        w = Window.partitionBy(*keys)
        cut = cut.withColumns({"__scan_pos": F.row_number().over(w.orderBy(*lane.order)), "__scan_rev": F.row_number().over(w.orderBy(*[F.col(o).desc() for o in lane.order]))})
    inside = cut.withColumns({n: _inside(s, keys, lane.order) for n, s in specs.items()})
    parts = cut.groupBy(*keys).agg(
        *[(_ends(s, lane.order) if isinstance(s, Shift) else _block_value(s, lane.order)).alias(f"__scan_b_{n}") for n, s in specs.items()]
    )
    carried = parts.select(*[F.col(k).alias(f"__scan_k_{k}") for k in keys], *[_carry(n, s, lane).alias(f"__scan_c_{n}") for n, s in specs.items()])
    on = [F.col(k).eqNullSafe(F.col(f"__scan_k_{k}")) for k in keys]
    out = inside.join(carried, on, "left")
    return out.select(*[c for c in df.columns if c not in specs], *[_join(n, s).alias(n) for n, s in specs.items()])


def number(df: DataFrame, lane: Lane, name: str, start: int = 1) -> DataFrame:
    """Dense position inside the group, from ``start``."""
    if lane.block is None:
        w = Window.partitionBy(*lane.keys).orderBy(*lane.order)
        return df.withColumn(name, (F.row_number().over(w) + F.lit(start - 1)).cast("bigint"))
    out = scan(df, lane, {name: Scan("count", "1")})
    return out.withColumn(name, (F.col(name) + F.lit(start - 1)).cast("bigint"))


def shift(df: DataFrame, lane: Lane, specs: dict[str, str], k: int = 1) -> DataFrame:
    """``k`` > 0 looks back (lag), ``k`` < 0 looks ahead (lead)."""
    return scan(df, lane, {n: Shift(e, k) for n, e in specs.items()})


def islands(df: DataFrame, lane: Lane, head: str, name: str) -> DataFrame:
    """Running count of rows where ``head`` holds: the island number."""
    return scan(df, lane, {name: Scan("sum", f"CAST(coalesce({head}, false) AS INT)")})


def neighbours(df: DataFrame, lane: Lane, when: str, value: str, before: str, after: str) -> DataFrame:
    """Previous and next ``value`` among rows where ``when`` holds (as-of both ways)."""
    e = f"CASE WHEN {when} THEN {value} END"
    return scan(df, lane, {before: Scan("last", e, exclusive=True), after: Scan("last", e, backward=True, exclusive=True)})
