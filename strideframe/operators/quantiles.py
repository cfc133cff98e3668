"""Exact quantiles, quantile edges and average ranks.

When the caller proves that a group fits one task the built-in ``percentile`` is
used.  Otherwise values are first collapsed to (group, value, count) with
map-side combine, cumulative counts come from a blocked scan over the values,
and the one or two order statistics per quantile are picked from them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.operators.ordered import Lane, Scan, scan
from strideframe.sources.stage import durable, stored


def pct(col: str | Column, q: float) -> Column:
    return F.percentile(F.col(col) if isinstance(col, str) else col, F.lit(q))


def value_blocks(df: DataFrame, col: str, pieces: int = 256) -> str:
    """Monotone block expression with about equal row counts per block.

    The edges are one fixed-size array, whatever the data size.
    """
    qs = [i / pieces for i in range(1, pieces)]
    edges = df.agg(F.percentile_approx(col, qs, 10 * pieces).alias("e")).first()["e"] or []
    lit = ", ".join(f"{e!r}D" for e in sorted(set(map(float, edges))))
    return f"size(filter(array({lit}), e -> e < {col}))" if lit else "0"


def tuple_blocks(df: DataFrame, cols: Sequence[str], pieces: int = 256, inner: int = 64) -> str:
    """As ``value_blocks`` over the order of several columns: a value too frequent for one block is cut by the next column.

    A frequent value is an edge, and an edge (or null) is a block of its own, so cutting it further keeps the order.
    """
    cols = cols[:3]
    cuts = [inner if i else pieces for i in range(len(cols))]
    found = df.agg(*[F.percentile_approx(c, [j / n for j in range(1, n)], 10 * n) for c, n in zip(cols, cuts)]).first()
    expr = "0"
    for i in reversed(range(len(cols))):
        c, lit = f"`{cols[i]}`", ", ".join(f"{e!r}D" for e in sorted(set(map(float, found[i] or []))))
        if not lit:
            place, alone = f"if({c} IS NULL, 0, 1)", f"{c} IS NULL"
        else:
            place = f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 + 2 * size(filter(array({lit}), e -> e < {c})) + if(array_contains(array({lit}), {c}), 1, 0) END"
            alone = f"({c} IS NULL OR array_contains(array({lit}), {c}))"
        expr = f"CAST({place} AS BIGINT) * {1024 ** (2 - i)} + CASE WHEN {alone} THEN {expr} ELSE 0 END"
    return expr


def value_counts(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("n"))


def cumulative_counts(df: DataFrame, keys: Sequence[str], col: str, small: bool) -> DataFrame:
    """(keys, value, n, n_before, n_total): one row per distinct value."""
    if small:
        return _cumulate(value_counts(df, keys, col), keys, col, None)
    counts = stored(value_counts(df, keys, col))
    return _cumulate(counts, keys, col, value_blocks(counts, col))


def _cumulate(counts: DataFrame, keys: Sequence[str], col: str, block: str | None) -> DataFrame:
    lane = Lane(tuple(keys), (col,), block)
    out = scan(counts, lane, {"n_before": Scan("sum", "n", exclusive=True), "n_after": Scan("sum", "n", backward=True)})
    return out.withColumn("n_before", F.coalesce("n_before", F.lit(0))).withColumn(
        "n_total", F.col("n_before") + F.col("n_after")
    ).drop("n_after")


def exact_quantiles(df: DataFrame, keys: Sequence[str], col: str, qs: dict[str, float], small: bool) -> DataFrame:
    """Linear interpolation; one row per group, one column per entry of ``qs``.

    Beyond the bound ``df`` is read once, for its counts; groups without values are among them. The result, a row per
    group, is stored, so whatever reads it again does not count again.
    """
    if small:
        return df.groupBy(*keys).agg(*[pct(col, q).alias(n) for n, q in qs.items()])
    every = stored(df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("n")))
    counts = every.where(F.col(col).isNotNull())
    cum = _cumulate(counts, keys, col, value_blocks(counts, col))
    picks = []
    for n, q in qs.items():
        pos = F.lit(q) * (F.col("n_total") - 1)
        for tag, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))
            picks.append(F.max(F.when(hit, F.col(col))).alias(f"__{n}_{tag}"))
    got = cum.groupBy(*keys).agg(F.max("n_total").alias("__n"), *picks)
    cols = []
    for n, q in qs.items():
        pos = F.lit(q) * (F.col("__n") - 1)
        lo, hi = F.col(f"__{n}_lo"), F.col(f"__{n}_hi")
        cols.append((lo + (pos - F.floor(pos)) * (hi - lo)).alias(n))
    if not keys:
        return durable(got.select(*cols))
    groups = every.select(*keys).distinct()
    got = got.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *cols)
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return durable(groups.join(got, on, "left").select(*keys, *qs))


def higher_quantiles(df: DataFrame, keys: Sequence[str], col: str, qs: dict[str, float], small: bool) -> DataFrame:
    """Order statistic at or above the linear position."""
    cum = cumulative_counts(df, keys, col, small)
    hits = {}
    for n, q in qs.items():
        rank = F.ceil(F.lit(q) * (F.col("n_total") - 1))
        hits[n] = (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))
    return cum.groupBy(*keys).agg(*[F.max(F.when(h, F.col(col))).alias(n) for n, h in hits.items()])


def bin_code(value: str, edges: str) -> Column:
    """Right-closed bin over an ascending edge array, minimum included, ties together.

    Null value gives null; a single edge gives one bin.
    """
    return F.expr(
        f"CASE WHEN {value} IS NULL OR size({edges}) = 0 THEN NULL "
        f"ELSE greatest(1, size(filter({edges}, e -> e < {value}))) END"
    )


def quantile_edges(df: DataFrame, keys: Sequence[str], col: str, k: int, small: bool, name: str = "edges") -> DataFrame:
    """Distinct ``k``-quantile edges (k + 1 at most) per group."""
    qs = {f"__q{i}": i / k for i in range(k + 1)}
    got = exact_quantiles(df, keys, col, qs, small)
    return got.select(*keys, F.array_distinct(F.array(*[F.col(q) for q in qs])).alias(name))


def average_ranks(df: DataFrame, keys: Sequence[str], col: str, name: str, small: bool) -> DataFrame:
    """Average rank of tied values per group, joined back on the value."""
    cum = cumulative_counts(df, keys, col, small)
    ranks = cum.select(
        *[F.col(k).alias(f"__k_{k}") for k in (*keys, col)],
        (F.col("n_before") + (F.col("n") + 1) / 2).alias(name),
    )
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in (*keys, col)]
    return df.join(ranks, on, "left").drop(*[f"__k_{k}" for k in (*keys, col)])


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, small: bool) -> DataFrame:
    """Spearman correlation with average ranks; null where either side is constant."""
    data = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    ranked = average_ranks(average_ranks(data, keys, x, "__rx", small), keys, y, "__ry", small)
    rho = F.when((F.min("__rx") < F.max("__rx")) & (F.min("__ry") < F.max("__ry")), F.corr("__rx", "__ry"))
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), rho.alias("rho"))


#: name -> quantile, the usual summary ladder
LADDER = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


def distribution(
    df: DataFrame,
    keys: Sequence[str],
    col: str,
    small: bool,
    qs: dict[str, float] = LADDER,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quantiles of ``col`` per group."""
    aggs = [
        F.count(col).alias("count"),
        F.mean(col).alias("mean"),
        F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
        *[e.alias(n) for n, e in (extra or {}).items()],
    ]
    if small:
        return df.groupBy(*keys).agg(*aggs, *[pct(col, q).alias(n) for n, q in qs.items()])
    base = df.groupBy(*keys).agg(*aggs)
    got = exact_quantiles(df, keys, col, qs, small=False)
    if not keys:
        return base.crossJoin(got)
    got = got.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *qs)
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return base.join(got, on, "left").drop(*[f"__k_{k}" for k in keys])


def min_ranks(df: DataFrame, keys: Sequence[str], col: str, name: str, small: bool) -> DataFrame:
    """Rank of each value, ties sharing the lowest (1 + rows strictly below)."""
    cum = cumulative_counts(df, keys, col, small)
    ranks = cum.select(
        *[F.col(k).alias(f"__k_{k}") for k in (*keys, col)], (F.col("n_before") + 1).cast("bigint").alias(name)
    )
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in (*keys, col)]
    return df.join(ranks, on, "left").drop(*[f"__k_{k}" for k in (*keys, col)])
