"""Possessions, anchors and gaps of an ordered event stream.

Streams carry ``event_index`` (order), ``t_us`` (period-local microseconds),
``event_type``, ``event_team_id`` and the flags ``linked`` and
``validated_anchor``; group keys and lanes are arguments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.operators.ordered import Lane, Shift, number, scan, shift
from strideframe.operators.quantiles import cumulative_counts, distribution, exact_quantiles, min_ranks

#: fixed values: event types reported by name and coverage levels
CORE_TYPES = ("Pass", "Carry", "Pressure", "Shot")
LEVELS = (1, 2, 3, 4, 5, 6, 8, 10)
DURATION_EDGES = (0, 5, 15, 30, 60)


def event_inventory(events: DataFrame, frames: DataFrame, lane: Lane) -> DataFrame:
    """Attach the frame status of each event and its 0-based place in the group.

    ``frames``: (match_id, event_uuid, semantics_status), one row per event at most.
    """
    f = frames.select(F.col("match_id").alias("__m"), F.col("event_uuid"), "semantics_status")
    joined = events.join(f, (F.col("match_id") == F.col("__m")) & (F.col("event_id") == F.col("event_uuid")), "left")
    flagged = joined.select(
        *events.columns,
        F.col("event_uuid").isNotNull().alias("linked_360"),
        F.coalesce("semantics_status", F.lit("no_360_frame")).alias("semantics_status"),
        F.coalesce(F.col("semantics_status") == "validated", F.lit(False)).alias("is_anchor"),
        (F.col("event_type") == "Shot").alias("is_shot"),
    )
    return number(flagged, lane, "event_position", start=0)


def possession_inventory(stream: DataFrame, keys: Sequence[str], own_team: int) -> DataFrame:
    """One row per group, groups without anchors included."""
    anchor, own = F.col("validated_anchor"), F.col("event_team_id") == own_team
    shot = F.col("event_type") == "Shot"
    at = F.col("event_index")
    n = lambda c: F.count_if(c).cast("bigint")
    agg = stream.groupBy(*keys).agg(
        F.min(at).alias("first_event_index"),
        F.max(at).alias("last_event_index"),
        (F.max_by("t_us", at) - F.min_by("t_us", at)).alias("duration_us"),
        F.count(F.lit(1)).alias("total_event_count"),
        n(F.col("linked")).alias("linked_count"),
        n(anchor).alias("anchor_count"),
        F.min_by("t_us", F.when(anchor, at)).alias("first_anchor_us"),
        F.max_by("t_us", F.when(anchor, at)).alias("last_anchor_us"),
        *[n(anchor & (F.col("event_type") == t)).alias(f"anchor_count_{t.lower()}") for t in CORE_TYPES],
        n(anchor & ~own).alias("opponent_anchor_count"),
        n(shot & own).alias("own_shot_count"),
        n(shot & ~own).alias("opponent_shot_count"),
        F.max_by("event_type", at).alias("final_event_type"),
    )
    return agg.withColumns(
        {
            "anchor_span_us": F.col("last_anchor_us") - F.col("first_anchor_us"),
            "unsupported_count": F.col("linked_count") - F.col("anchor_count"),
            "proportion_validated": F.when(F.col("linked_count") > 0, F.col("anchor_count") / F.col("linked_count")),
            "has_shot": (F.col("own_shot_count") + F.col("opponent_shot_count")) > 0,
            "ends_in_shot": F.col("final_event_type") == "Shot",
        }
    )


def anchor_gaps(stream: DataFrame, lane: Lane) -> DataFrame:
    """Consecutive anchors of a group; every event between them is counted."""
    placed = number(stream, lane, "__pos")
    anchors = placed.where("validated_anchor")
    back = shift(
        anchors,
        lane,
        {
            "previous_event_index": "event_index",
            "__ppos": "__pos",
            "__pt": "t_us",
            "previous_anchor_type": "event_type",
            "previous_event_team_id": "event_team_id",
        },
    ).where("previous_event_index IS NOT NULL")
    return back.select(
        *lane.keys,
        "previous_event_index",
        F.col("event_index").alias("next_event_index"),
        (F.col("event_index") - F.col("previous_event_index")).alias("event_index_gap"),
        (F.col("__pos") - F.col("__ppos") - 1).alias("intervening_event_count"),
        ((F.col("t_us") - F.col("__pt")) / 1e6).alias("elapsed_seconds"),
        "previous_anchor_type",
        F.col("event_type").alias("next_anchor_type"),
        "previous_event_team_id",
        F.col("event_team_id").alias("next_event_team_id"),
    )


def long_rows(one_row: DataFrame, rows: list[dict[str, Column]]) -> DataFrame:
    """Turn the columns of a one-row aggregate into labelled rows."""
    return one_row.select(F.inline(F.array(*[F.struct(*[c.alias(n) for n, c in r.items()]) for r in rows])))


def coverage_levels(
    possessions: DataFrame, populations: dict[str, Column], levels: Sequence[int] = LEVELS
) -> DataFrame:
    """Groups with no anchor and with at least n anchors, per population."""
    count = F.col("anchor_count")
    aggs, rows = [], []
    for i, (label, member) in enumerate(populations.items()):
        aggs.append(F.count_if(member).alias(f"d{i}"))
        for n in (0, *levels):
            hit = (count == 0) if n == 0 else (count >= n)
            aggs.append(F.count_if(member & hit).alias(f"c{i}_{n}"))
            rows.append(
                {
                    "population": F.lit(label),
                    "anchor_requirement": F.lit("zero" if n == 0 else f">={n}"),
                    "possession_count": F.col(f"c{i}_{n}"),
                    "denominator": F.col(f"d{i}"),
                    "percentage": F.when(F.col(f"d{i}") > 0, F.round(100 * F.col(f"c{i}_{n}") / F.col(f"d{i}"), 6)),
                }
            )
    return long_rows(possessions.agg(*aggs), rows)


def temporal_tuples(
    stream: DataFrame, lane: Lane, tuples: Sequence[tuple[int, int]], any_of: Sequence[tuple[int, int]]
) -> DataFrame:
    """Overlapping runs of n consecutive anchors spanning at most s microseconds."""
    anchors = stream.where("validated_anchor").select(*lane.keys, *{*lane.order, "event_index", "t_us"})
    anchors = scan(anchors, lane, {f"__t{n}": Shift("t_us", n - 1) for n in sorted({n for n, _ in (*tuples, *any_of)})})
    within = lambda n, s: F.coalesce((F.col("t_us") - F.col(f"__t{n}")) <= s, F.lit(False))
    per_group = anchors.groupBy(*lane.keys).agg(
        *[F.count_if(within(n, s)).alias(f"c{n}_{s}") for n, s in tuples],
        *[F.max(within(n, s)).alias(f"a{n}_{s}") for n, s in any_of],
    )
    total = per_group.agg(
        *[F.coalesce(F.sum(f"c{n}_{s}"), F.lit(0)).alias(f"c{n}_{s}") for n, s in tuples],
        *[F.count_if(F.col(f"a{n}_{s}")).alias(f"a{n}_{s}") for n, s in any_of],
    )
    row = lambda unit, n, s, c: {
        "unit": F.lit(unit),
        "states": F.lit(n),
        "window_us": F.lit(s).cast("bigint"),
        "count": F.col(c).cast("bigint"),
    }
    return long_rows(
        total,
        [row("consecutive_anchor_tuples", n, s, f"c{n}_{s}") for n, s in tuples]
        + [row("possessions_with_any_tuple", n, s, f"a{n}_{s}") for n, s in any_of],
    )


def gap_thresholds(gaps: DataFrame, col: str, limits: Sequence[float]) -> DataFrame:
    """Share of values at or below each limit."""
    one = gaps.agg(F.count(F.lit(1)).alias("d"), *[F.count_if(F.col(col) <= s).alias(f"c{i}") for i, s in enumerate(limits)])
    return long_rows(
        one,
        [
            {
                "seconds": F.lit(float(s)),
                "interval_count": F.col(f"c{i}"),
                "denominator": F.col("d"),
                "percentage": F.when(F.col("d") > 0, F.round(100 * F.col(f"c{i}") / F.col("d"), 6)),
            }
            for i, s in enumerate(limits)
        ],
    )


def measure_distributions(df: DataFrame, measures: dict[str, str], small: bool) -> DataFrame:
    """Distribution of several columns at once, one row per measure."""
    long = df.select(
        F.inline(
            F.array(*[F.struct(F.lit(n).alias("measure"), F.expr(e).cast("double").alias("value")) for n, e in measures.items()])
        )
    )
    return distribution(long, ["measure"], "value", small)


def coverage(levels: Sequence[int] = LEVELS) -> list[Column]:
    """Aggregates describing how many anchors the groups hold."""
    c = F.col("anchor_count")
    return [
        F.count(F.lit(1)).alias("possession_count"),
        F.round(F.mean(c), 6).alias("mean_anchors"),
        *[F.round(100 * F.mean((c >= n).cast("int")), 6).alias(f"pct_ge_{n}_anchors") for n in levels],
    ]


def match_coverage(possessions: DataFrame, gaps: DataFrame, level: int, small: bool) -> DataFrame:
    """Coverage and gap quantiles per match, ranked ascending by share with ``level`` anchors."""
    cover = possessions.groupBy("match_id").agg(
        *coverage(),
        F.round(F.sum("anchor_count") / F.nullif(F.sum("linked_count"), F.lit(0)), 6).alias("proportion_validated"),
    )
    counts = exact_quantiles(possessions, ["match_id"], "anchor_count", {"median_anchors": 0.5}, small)
    quant = exact_quantiles(
        gaps, ["match_id"], "elapsed_seconds", {"median_anchor_gap_seconds": 0.5, "p90_anchor_gap_seconds": 0.9}, small
    )
    table = cover.join(counts, "match_id", "left").join(quant, "match_id", "left")
    return min_ranks(table, [], f"pct_ge_{level}_anchors", "rank_ascending", small)


def duration_bins(possessions: DataFrame, edges: Sequence[int], unit_us: int, small: bool) -> DataFrame:
    """Half-open duration bins; the last is open ended and empty bins stay."""
    spark = possessions.sparkSession
    labels = [
        (i, f"[{lo},{edges[i + 1] if i + 1 < len(edges) else 'infinity'})") for i, lo in enumerate(edges)
    ]
    table = spark.createDataFrame(labels, "bin int, duration_bin string")
    code = F.lit(None).cast("int")
    for i, lo in enumerate(edges):
        code = F.when(F.col("duration_us") >= lo * unit_us, i).otherwise(code)
    coded = possessions.withColumn("bin", code)
    agg = coded.groupBy("bin").agg(*coverage())
    med = exact_quantiles(coded, ["bin"], "total_event_count", {"median_events": 0.5}, small)
    out = table.join(agg, "bin", "left").join(med, "bin", "left")
    return out.withColumn("possession_count", F.coalesce("possession_count", F.lit(0)))


def composition(anchors: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Anchors, groups and matches per label with the share of all anchors."""
    per_group = anchors.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("n"))
    per_match = per_group.groupBy(*by, "match_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"))
    out = per_match.groupBy(*by).agg(
        F.sum("n").alias("anchor_count"),
        F.sum("g").alias("possessions_containing"),
        F.count(F.lit(1)).alias("match_count"),
    )
    total = out.agg(F.sum("anchor_count").alias("__t"))
    return out.crossJoin(F.broadcast(total)).select(
        *by,
        "anchor_count",
        "possessions_containing",
        "match_count",
        F.round(100 * F.col("anchor_count") / F.col("__t"), 6).alias("percentage_of_anchors"),
    )


def type_transitions(gaps: DataFrame, small: bool) -> DataFrame:
    """Type-to-type matrix of consecutive anchors."""
    by = ["previous_anchor_type", "next_anchor_type"]
    agg = gaps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("interval_count"), F.count_distinct("match_id").alias("match_count")
    )
    med = exact_quantiles(gaps, by, "elapsed_seconds", {"median_gap_seconds": 0.5}, small)
    total = agg.agg(F.sum("interval_count").alias("__t"))
    return (
        agg.join(med, by)
        .crossJoin(F.broadcast(total))
        .withColumn("percentage_of_intervals", F.round(100 * F.col("interval_count") / F.col("__t"), 6))
        .drop("__t")
    )


def sequence_candidates(possessions: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """Groups able to hold n states and the consecutive n-tuples they offer."""
    c = F.col("anchor_count")
    one = possessions.agg(
        *[F.count_if(c >= n).alias(f"p{n}") for n in lengths],
        *[F.sum(F.greatest(c - n + 1, F.lit(0))).alias(f"t{n}") for n in lengths],
        *[F.coalesce(F.sum(F.when(c >= n, c)), F.lit(0)).alias(f"a{n}") for n in lengths],
    )
    return long_rows(
        one,
        [
            {
                "states": F.lit(n),
                "capable_possessions": F.col(f"p{n}"),
                "consecutive_tuples": F.col(f"t{n}").cast("bigint"),
                "states_in_capable": F.col(f"a{n}").cast("bigint"),
            }
            for n in lengths
        ],
    )


def representative_possessions(possessions: DataFrame, rules: dict[str, Column], keys: Sequence[str]) -> list[dict]:
    """Greedy disjoint picks: the first unused group, in key order, for each rule.

    With R rules at most R - 1 groups are already used, so the first R candidates of every rule decide the outcome. One
    pass ranks the candidates of all rules, with all but R of a rule dropped before the shuffle; R * R keys reach the driver.
    """
    met = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(rule)) for rule, cond in rules.items()]))
    tagged = possessions.select(*keys, F.explode(met).alias("rule"))
    place = F.row_number().over(Window.partitionBy("rule").orderBy(*keys))
    first = tagged.withColumn("__n", place).where(F.col("__n") <= len(rules)).drop("__n")
    options: dict[str, list[tuple]] = {}
    for r in first.orderBy("rule", *keys).collect():
        options.setdefault(r["rule"], []).append(tuple(r[k] for k in keys))
    used, picks = set(), []
    for rule in rules:
        free = next((o for o in options.get(rule, []) if o not in used), None)
        if free is not None:
            used.add(free)
            picks.append({"selection_rule": rule, **dict(zip(keys, free, strict=True))})
    return picks


def ecdf(df: DataFrame, col: str, small: bool) -> DataFrame:
    """Distinct values with the fraction of rows at or below each."""
    cum = cumulative_counts(df, [], col, small)
    return cum.select(col, "n", ((F.col("n_before") + F.col("n")) / F.col("n_total")).alias("fraction"))


def stream_integrity(stream: DataFrame, lane: Lane, keys: Sequence[str]) -> DataFrame:
    """Counts of order, clock, ownership and contiguity violations of a match stream."""
    looked = shift(stream, lane, {"__p": "period", "__t": "t_us", **{f"__k_{k}": k for k in keys}})
    changed = F.lit(False)
    for k in keys:
        changed = changed | ~F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    runs = looked.withColumn("__new", changed.cast("int"))
    ordering = runs.agg(
        F.count_if(F.col("period") < F.col("__p")).alias("reversed_period"),
        F.count_if((F.col("period") == F.col("__p")) & (F.col("t_us") < F.col("__t"))).alias("reversed_clock"),
        F.count_if(F.col("event_type").isNull() | F.col("event_team_id").isNull()).alias("missing_annotation"),
    )
    reuse = runs.groupBy(*keys).agg(F.sum("__new").alias("runs")).agg(F.count_if(F.col("runs") > 1).alias("noncontiguous"))
    dup = stream.groupBy(*lane.keys, "event_index").count().agg(F.count_if(F.col("count") > 1).alias("duplicate_index"))
    team = (
        stream.groupBy("match_id", "period", "possession_id")
        .agg(F.min("possession_team_id").alias("a"), F.max("possession_team_id").alias("b"))
        .agg(F.count_if(F.col("a") != F.col("b")).alias("conflicting_owner"))
    )
    return ordering.crossJoin(reuse).crossJoin(dup).crossJoin(team)


