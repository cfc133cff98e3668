"""Match, event, snapshot and line-up files, and re-reads of derived tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.operators.expectations import require_none

POINT = "struct<location: array<double>, teammate: boolean, keeper: boolean, actor: boolean>"
_NAMED = "struct<id: bigint, name: string>"
_DONE = f"outcome: {_NAMED}"
_ACTION = f"struct<end_location: array<double>, {_DONE}, type: {_NAMED}>"

#: declared schemas; unknown fields are ignored, absent sub-objects are null structs
SCHEMAS = {
    "matches": "match_id bigint, match_date string, match_week int, home_team struct<home_team_id: bigint, home_team_name: string>, "
    "away_team struct<away_team_id: bigint, away_team_name: string>",
    "events": f"id string, `index` bigint, period int, timestamp string, possession bigint, type {_NAMED}, team {_NAMED}, possession_team {_NAMED}, "
    f"player {_NAMED}, location array<double>, related_events array<string>, out boolean, counterpress boolean, pass {_ACTION}, "
    f"carry struct<end_location: array<double>>, shot struct<end_location: array<double>, statsbomb_xg: double, {_DONE}, freeze_frame: array<{POINT}>>, "
    f"duel struct<{_DONE}>, interception struct<{_DONE}>, ball_receipt struct<{_DONE}>, dribble struct<{_DONE}>, goalkeeper struct<type: {_NAMED}>, "
    "ball_recovery struct<recovery_failure: boolean>, foul_won struct<advantage: boolean>, foul_committed struct<advantage: boolean>",
    "frames": f"event_uuid string, freeze_frame array<{POINT}>, visible_area array<double>",
    "lineups": f"team_id bigint, team_name string, lineup array<struct<player_id: bigint, player_name: string>>",
}


def read_records(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """One JSON array file per match; ``match_id`` comes from the file name.

    Each file is one array, so a file is the unit of work and records keep their
    place in it as ``ordinal``.
    """
    schema = SCHEMAS[kind]
    raw = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("__f"), F.from_json("value", f"array<struct<{_colon(schema)}>>").alias("__a")
    )
    rows = raw.select("__f", F.posexplode("__a").alias("ordinal", "r"))
    if kind == "matches":
        return rows.select("r.*", "ordinal")
    return rows.select(F.regexp_extract("__f", r"([0-9]+)\.json$", 1).cast("bigint").alias("match_id"), "ordinal", "r.*")


def _colon(schema: str) -> str:
    """Top-level ``name type`` pairs as struct fields ``name: type``."""
    out, depth, part = [], 0, ""
    for ch in schema + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            name, kind = part.strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            part = ""
        else:
            part += ch
    return ", ".join(out)


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, "matches", path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, "events", path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, "frames", path)


def read_lineups(spark: SparkSession, path: str) -> DataFrame:
    rows = read_records(spark, "lineups", path)
    return rows.select("match_id", "team_id", F.explode("lineup").alias("p")).select("match_id", "team_id", "p.player_id", "p.player_name")


def period_micros(timestamp: str) -> str:
    """``HH:MM:SS.mmm`` to microseconds, exactly."""
    part = lambda i: f"CAST(split({timestamp}, ':')[{i}] AS DECIMAL(20, 6))"
    return f"CAST(({part(0)} * 3600 + {part(1)} * 60 + {part(2)}) * 1000000 AS BIGINT)"


def frame_points(frames: DataFrame) -> DataFrame:
    """Provider snapshots in the layout of the point operators."""
    return frames.withColumn(
        "points",
        F.expr(
            "transform(freeze_frame, (p, i) -> named_struct('i', i, 'x', CASE WHEN size(p.location) = 2 THEN p.location[0] END, "
            "'y', CASE WHEN size(p.location) = 2 THEN p.location[1] END, 'teammate', p.teammate, 'keeper', p.keeper, 'actor', p.actor))"
        ),
    )


def read_table(spark: SparkSession, path: str, columns: Sequence[str], revision: str | None = None, column: str = "revision") -> DataFrame:
    """Column-pruned re-read; a mixed or unknown revision is refused."""
    df = spark.read.parquet(path)
    if revision is not None:
        require_none(df, {"foreign_revision": ~F.col(column).eqNullSafe(F.lit(revision))})
    return df.select(*columns)


def write_tables(tables: dict[str, DataFrame], folder: str, revision: str, column: str = "revision") -> None:
    """One Parquet table per name with its revision; existing output is never replaced."""
    for name, df in tables.items():
        df.withColumn(column, F.lit(revision)).write.mode("errorifexists").parquet(f"{folder}/{name}")


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content fingerprint: rows and the exact sum of row hashes."""
    cols = sorted(df.columns)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(F.xxhash64(*cols).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("content"),
    )


def verify_rerun(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks."""
    b = b.select(*a.columns)
    n = lambda x, y, name: x.exceptAll(y).agg(F.count(F.lit(1)).alias(name))
    return n(a, b, "only_first").crossJoin(n(b, a, "only_second"))
