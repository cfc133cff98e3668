"""Contract checks that return DataFrames of counts rather than raising per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A declared data contract does not hold."""


def violations(df: DataFrame, rules: dict[str, Column | str]) -> DataFrame:
    """One row, one count per rule of the rows that break it."""
    return df.agg(
        *[F.count_if(F.expr(r) if isinstance(r, str) else r).cast("bigint").alias(n) for n, r in rules.items()]
    )


def require_none(df: DataFrame, rules: dict[str, Column | str]) -> DataFrame:
    """Raise when any rule is broken; one distributed aggregate, one row returned."""
    row = violations(df, rules).first().asDict()
    bad = {k: v for k, v in row.items() if v}
    if bad:
        raise ContractError(f"contract broken: {bad}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def reconcile(df: DataFrame, measures: dict[str, Column], expected: dict[str, float]) -> DataFrame:
    """(name, observed, expected, ok) for each declared total."""
    one = df.agg(*[m.cast("double").alias(n) for n, m in measures.items()])
    packed = F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.col(n).alias("observed"), F.lit(float(expected[n])).alias("expected"))
            for n in measures
        ]
    )
    return one.select(F.inline(packed)).withColumn("ok", F.col("observed").eqNullSafe(F.col("expected")))
