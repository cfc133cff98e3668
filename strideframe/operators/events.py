"""Flattening, match context and per-event projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideframe.functions import points as P
from strideframe.operators.expectations import require_none

#: fixed values: event types that are a signal by themselves, and restart pass types
SIGNAL_TYPES = (
    "Shot", "Foul Won", "Foul Committed", "Offside", "Injury Stoppage", "Referee Ball-Drop", "Half End", "Half Start",
    "Dispossessed", "Miscontrol", "Interception", "Ball Recovery", "Duel", "Block", "Clearance",
)
RESTARTS = ("Kick Off", "Goal Kick", "Free Kick", "Corner", "Throw-in")
THIRDS = ((0, 40, "defensive_third"), (40, 80, "middle_third"), (80, 120, "attacking_third"))


def normalize_events(df: DataFrame, sep: str = "_") -> DataFrame:
    """Flatten nested structs to ``a_b`` columns; arrays and scalars are kept."""

    def leaves(schema: T.StructType, path: tuple[str, ...]) -> list[tuple[str, ...]]:
        out = []
        for f in schema.fields:
            here = (*path, f.name)
            out += leaves(f.dataType, here) if isinstance(f.dataType, T.StructType) else [here]
        return out

    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)) for path in leaves(df.schema, ())])


def team_match_context(matches: DataFrame, team: int, strict: bool = False) -> DataFrame:
    """Opponent and venue of ``team``; ``strict`` raises when a match has it on neither side."""
    home, away = F.col("home_team_id") == team, F.col("away_team_id") == team
    out = matches.withColumns(
        {
            "opponent_id": F.when(home, F.col("away_team_id")).when(away, F.col("home_team_id")),
            "venue": F.when(home, "Home").when(away, "Away"),
        }
    )
    return require_none(out, {"matches_without_team": "venue IS NULL"}) if strict else out


def team_event_dataset(events: DataFrame, matches: DataFrame, team: int, event_type: str | None = None) -> DataFrame:
    """A team's events, of one type if given, with date, opponent and venue of the match."""
    kept = events.where(F.col("event_team_id") == team)
    if event_type is not None:
        kept = kept.where(F.col("event_type") == event_type)
    ctx = team_match_context(matches, team).where("venue IS NOT NULL").select("match_id", "match_date", "opponent_id", "venue")
    return kept.join(ctx, "match_id")


def provider_signals(
    type_col: str = "event_type",
    out: str = "is_out",
    counterpress: str = "counterpress",
    outcomes: dict[str, str] | None = None,
    pass_type: str = "pass_type",
) -> Column:
    """Literal provider signals of an event, in a fixed order."""
    outcomes = outcomes or {
        "pass": "pass_outcome",
        "duel": "duel_outcome",
        "interception": "interception_outcome",
        "ball_receipt": "receipt_outcome",
    }
    tag = lambda prefix, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(prefix), F.col(c)))
    return F.array_compact(
        F.array(
            F.when(F.col(type_col).isin(*SIGNAL_TYPES), F.concat(F.lit("type:"), F.col(type_col))),
            F.when(F.col(out), F.lit("out:true")),
            F.when(F.col(counterpress), F.lit("counterpress:true")),
            *[tag(f"{p}.outcome:", c) for p, c in outcomes.items()],
            tag("pass.type:", pass_type),
        )
    )


def valid_point(arr: str) -> str:
    """Two finite numbers."""
    return f"(size({arr}) = 2 AND {P.finite(arr + '[0]')} AND {P.finite(arr + '[1]')})"


def starting_third(x: str) -> Column:
    """[0,40), [40,80), [80,120], else outside_pitch."""
    chain = " ".join(
        f"WHEN {x} >= {lo} AND {x} {'<=' if hi == 120 else '<'} {hi} THEN '{name}'" for lo, hi, name in THIRDS
    )
    return F.expr(f"CASE {chain} ELSE 'outside_pitch' END")


def zone_label(x: str, edges: Sequence[float], names: Sequence[str]) -> Column:
    """Half-open zones between consecutive edges; outside gives null."""
    chain = " ".join(f"WHEN {x} >= {a} AND {x} < {b} THEN '{n}'" for a, b, n in zip(edges, edges[1:], names))
    return F.expr(f"CASE {chain} END")


def safe_endpoint(ends: Sequence[str]) -> dict[str, Column]:
    """First non-null end array; two or three coordinates accepted, the first two used."""
    e = F.coalesce(*[F.col(c) for c in ends])
    two = F.when(F.size(e).isin(2, 3), F.slice(e, 1, 2))
    ok = F.when(F.size(two) == 2, (two[0].isNotNull() & ~F.isnan(two[0]) & two[1].isNotNull() & ~F.isnan(two[1])))
    return {"end_x_safe": F.when(ok, two[0]), "end_y_safe": F.when(ok, two[1])}


def match_stream_context(events: DataFrame, own: int) -> DataFrame:
    """Rows of own possessions with the control context used by segmentation."""
    return events.where(F.col("possession_team_id") == own).select(
        "match_id",
        "period",
        "possession_id",
        "possession_team_id",
        "event_id",
        "event_index",
        "t_us",
        "event_type",
        "event_team_id",
        provider_signals().alias("signals"),
        F.when(F.col("pass_type").isin(*RESTARTS), F.col("pass_type")).alias("restart_type"),
        F.coalesce("advantage", F.lit(False)).alias("advantage"),
        F.coalesce("keeper_type", F.lit("")).alias("keeper_type"),
        F.coalesce("recovery_failure", F.lit(False)).alias("recovery_failure"),
        F.coalesce("dribble_outcome", F.lit("")).alias("dribble_outcome"),
    )
