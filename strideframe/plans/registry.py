"""Named queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from strideframe.plans.fixtures import Fixture

PLANS: dict[str, Callable[[Fixture], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        if name in PLANS:
            raise KeyError(f"query {name} registered twice")
        PLANS[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return wrap
