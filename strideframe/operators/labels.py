"""Statistics of labelled cohorts and a few descriptive season tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.operators import ordered
from strideframe.operators.ordered import Lane, Scan, scan
from strideframe.operators.quantiles import distribution, exact_quantiles, value_blocks
from strideframe.sources.stage import stored

#: Ranks of at most so many values are sent to all tasks.
RANKS_SENT = 100_000
BANDS = {"range": (0.0, 1.0), "p10_p90": (0.1, 0.9), "iqr": (0.25, 0.75)}


def cohort_prepare(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Exclusion reasons and recovery status; missing values stay unknown.

    df: label, lock_status, threshold_safe, peak_contaminated, observed_recovery, retreat.
    """
    unsure = lambda c, good: F.coalesce(F.col(c) == good, F.lit(False))
    why = F.array_compact(
        F.array(
            F.when(~unsure("threshold_safe", True), "threshold_safe_not_true"),
            F.when(~F.coalesce(F.col("label").isin(*labels), F.lit(False)), "not_a_review_label"),
            F.when(~unsure("lock_status", "LOCKED"), "not_locked"),
            F.when(~unsure("peak_contaminated", False), "contaminated_or_unknown_peak"),
        )
    )
    status = (
        F.when(F.col("observed_recovery"), "observed")
        .when(~F.col("observed_recovery"), "not_observed_censored")
        .when(F.col("retreat") == 0, "not_applicable_at_peak")
        .otherwise("unavailable")
    )
    return df.withColumns({"exclusion_reasons": why, "primary_included": F.size(why) == 0, "recovery_status": status})


def metric_long(df: DataFrame, keep: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.select(*keep, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))


def class_descriptives(df: DataFrame, metrics: Sequence[str], small: bool) -> DataFrame:
    qs = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    return distribution(metric_long(df, ["label"], metrics), ["label", "metric"], "value", small, qs, {"total_count": F.count(F.lit(1))})


def class_overlap(df: DataFrame, metrics: Sequence[str], small: bool) -> DataFrame:
    """Overlap of each pair of labels, by range, p10-p90 and quartiles."""
    rows = metric_long(df, ["label"], metrics)
    qs = {f"{b}_{s}": q for b, (lo, hi) in BANDS.items() for s, q in (("lo", lo), ("hi", hi))}
    q = exact_quantiles(rows, ["label", "metric"], "value", qs, small)
    band = F.array(*[F.struct(F.lit(b).alias("interval"), F.col(f"{b}_lo").alias("lo"), F.col(f"{b}_hi").alias("hi")) for b in BANDS])
    q = q.select("label", "metric", F.inline(band))
    a = q.select("metric", "interval", F.col("label").alias("class_a"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    b = q.select("metric", "interval", F.col("label").alias("class_b"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    j = a.join(b, ["metric", "interval"]).where("class_a < class_b")
    lo, hi = F.greatest("a_lo", "b_lo"), F.least("a_hi", "b_hi")
    known = F.col("a_lo").isNotNull() & F.col("b_lo").isNotNull()
    return j.select(
        "metric", "interval", "class_a", "class_b",
        F.when(known, lo <= hi).alias("overlaps"),
        F.when(known & (lo <= hi), lo).alias("overlap_low"),
        F.when(known & (lo <= hi), hi).alias("overlap_high"),
        F.when(known, F.greatest(F.lit(0.0), hi - lo)).alias("overlap_width"),
    )


def threshold_sweep(df: DataFrame, rules: dict[str, list[tuple[str, str, float]]]) -> DataFrame:
    """Evaluable, matched and missing counts per rule and label; missing is unknown, not false."""
    aggs, packed = [], []
    for i, (name, conds) in enumerate(rules.items()):
        known, hit = F.lit(True), F.lit(True)
        for metric, op, v in conds:
            known = known & F.col(metric).isNotNull()
            hit = hit & ((F.col(metric) >= v) if op == ">=" else (F.col(metric) <= v))
        aggs += [F.count_if(known).alias(f"k{i}"), F.count_if(known & hit).alias(f"h{i}")]
        packed.append(F.struct(F.lit(name).alias("diagnostic"), F.col(f"k{i}").alias("evaluable"), F.col(f"h{i}").alias("matched")))
    g = df.groupBy("label").agg(F.count(F.lit(1)).alias("total"), *aggs)
    out = g.select("label", "total", F.inline(F.array(*packed)))
    return out.withColumns({"not_matched": F.col("evaluable") - F.col("matched"), "missing": F.col("total") - F.col("evaluable")})


def _pair_sums(values: DataFrame, x: str, block: str | None, others: Sequence[int], summed: Sequence[int]) -> DataFrame:
    """``label, part`` with the rows of ``others`` known, their squared ranks of ``x`` and, of ``summed``, products with those.

    A rank is one within the block plus one of the block, and the former times rows sum to 0 in a block, so blocks are
    summed first and no row meets what lies before its block.
    """
    n, t = ({i: F.col(f"__{s}{i}") for i in others} for s in "nt")
    inside, across = Window.partitionBy("label", "__block"), Window.partitionBy("label")
    rank = lambda n, w, by: (2 * F.coalesce(F.sum(n).over(w.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + n - F.sum(n).over(w)).cast("double")
    ranked = values.withColumn("__block", F.expr(block or "0")).withColumns({f"__c{i}": rank(n[i], inside, x) for i in others})
    aggs = []
    for i in others:
        c = F.col(f"__c{i}")
        aggs += [F.sum(n[i]).alias(f"__n{i}"), F.sum(n[i] * c * c).alias(f"__own{i}")]
        aggs += [F.sum(t[i]).alias(f"__t{i}"), F.sum(t[i] * c).alias(f"__both{i}")] if i in summed else []
    blocks = ranked.groupBy("label", "__block").agg(*aggs).withColumns({f"__c{i}": rank(n[i], across, "__block") for i in others})
    parts = []
    for i in others:
        c = F.col(f"__c{i}")
        both = F.col(f"__both{i}") + t[i] * c if i in summed else F.lit(None).cast("double")
        parts.append(F.struct(F.lit(i).alias("other"), n[i].alias("n"), (F.col(f"__own{i}") + n[i] * c * c).alias("own"), both.alias("both")))
    return blocks.select("label", F.inline(F.array(*parts)))


def rank_correlations(df: DataFrame, metrics: Sequence[str], small: bool) -> DataFrame:
    """Spearman of every metric pair per label, over the rows that have both: ``label, metric_a, metric_b, n, rho``.

    A value's average rank, doubled and centred, is the number of values below it less the number above, counted beside
    every other metric among the rows that have it too. Of a pair only the metric with fewer values sends its ranks to
    the rows; the other one is a table of its values, with row counts and the sums of those ranks, and takes its own
    there. So each metric is one aggregation by its values, and rows are neither stored nor sorted; only ranks of more
    than RANKS_SENT values meet them by a shuffle, after which they are stored. ``rho`` is null where either side is constant.
    """
    metrics, found = list(metrics), []
    rows = df.select("label", *[F.col(m).cast("double").alias(m) for m in metrics])
    order = list(range(len(metrics)))
    if not small:
        sizes = rows.agg(*[F.approx_count_distinct(m) for m in metrics]).first()
        order.sort(key=lambda i: sizes[i])
    for place, j in enumerate(order):
        x, fewer, more = metrics[j], order[:place], order[place + 1 :]
        counts = [F.count(metrics[i]).alias(f"__n{i}") for i in (*fewer, *more)]
        sums = [F.sum(f"__c{i}_{j}").alias(f"__t{i}") for i in fewer]
        values = stored(rows.where(F.col(x).isNotNull()).groupBy("label", x).agg(*counts, *sums))
        n_values = None if small else values.count()
        block = None if small or n_values <= ordered.GROUP_LIMIT else value_blocks(values, f"`{x}`")
        names, first = F.array(*map(F.lit, metrics)), F.col("other") > j
        pair = [names[F.least("other", F.lit(j))].alias("metric_a"), names[F.greatest("other", F.lit(j))].alias("metric_b")]
        own = [F.when(first, F.col("own")).alias("xx"), F.when(~first, F.col("own")).alias("yy")]
        once = F.when(F.col("other").isin(fewer), F.col("n")).alias("n")
        found.append(_pair_sums(values, x, block, [*fewer, *more], fewer).select("label", *pair, once, F.col("both").alias("xy"), *own))
        if more:
            lane = Lane(("label",), (x,), block)
            sides = {f"__{s}{i}": Scan("sum", f"__n{i}", backward=s == "a", exclusive=True) for s in "ba" for i in more}
            ranks = [(F.coalesce(f"__b{i}", F.lit(0)) - F.coalesce(f"__a{i}", F.lit(0))).cast("double").alias(f"__c{j}_{i}") for i in more]
            ranked = scan(values, lane, sides, kept=True).select(F.col("label").alias("__label"), F.col(x).alias("__x"), *ranks)
            sent = not small and n_values <= RANKS_SENT
            rows = rows.join(F.broadcast(ranked) if sent else ranked, F.col("label").eqNullSafe(F.col("__label")) & (F.col(x) == F.col("__x")), "left").drop("__label", "__x")
            if not (small or sent):
                rows = stored(rows)
    rho = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))
    sums = [F.sum(c).alias(c) for c in ("n", "xy", "xx", "yy")]
    return reduce(DataFrame.unionByName, found).groupBy("label", "metric_a", "metric_b").agg(*sums).where("n > 0").select("label", "metric_a", "metric_b", "n", rho.alias("rho"))


def recovery_table(df: DataFrame, value: str, small: bool) -> DataFrame:
    by = ["label", "recovery_status"]
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return n.join(exact_quantiles(df, by, value, {"median_value": 0.5}, small), by)


def warning_groups(roles: DataFrame, group: Sequence[str]) -> DataFrame:
    """First and last representative of each grouped warning, probes counted apart."""
    at = F.col("event_index")
    warn = F.col("role") == "reset_warning"
    return roles.groupBy(*group).agg(
        F.count_if(warn).alias("warnings"),
        F.count_if(~warn).alias("probes"),
        F.min_by("candidate_id", F.when(warn, at)).alias("first_warning"),
        F.max_by("candidate_id", F.when(warn, at)).alias("last_warning"),
    )


# --- season description --------------------------------------------------------------------


def pass_completion(events: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """No outcome means completed."""
    p = events.where(F.col("event_type") == "Pass")
    return p.groupBy(*by).agg(F.count(F.lit(1)).alias("passes"), (100 * F.mean(F.col("pass_outcome").isNull().cast("int"))).alias("completion_pct"))


def top_passers(events: DataFrame, player: str, n: int) -> DataFrame:
    return pass_completion(events, [player]).orderBy(F.desc("passes"), player).limit(n)


def season_inventory(matches: DataFrame, events: DataFrame, lineups: DataFrame, frames: DataFrame) -> DataFrame:
    """Events, teams with a lineup and snapshots of every match; a match without rows in a table counts 0 there.

    All four have match_id, lineups also team_id. Each table is counted by match before the join.
    """
    count = lambda df, name, n: df.groupBy("match_id").agg(n.alias(name))
    out = matches.select("match_id").distinct()
    one = F.count(F.lit(1))
    for df, name, n in ((events, "event_count", one), (lineups, "lineup_team_count", F.count_distinct("team_id")), (frames, "frame_count", one)):
        out = out.join(count(df, name, n), "match_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def season_profile(inventory: DataFrame, small: bool) -> DataFrame:
    """``measure, count, total, mean, std, min, p25, median, p75, max, zeros`` of each count over the matches."""
    names = [c for c in inventory.columns if c != "match_id"]
    long = inventory.select(F.inline(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("v")) for n in names])))
    extra = {"total": F.sum("v"), "zeros": F.count_if(F.col("v") == 0)}
    return distribution(long, ["measure"], "v", small, {"p25": 0.25, "median": 0.5, "p75": 0.75}, extra)


def match_results(events: DataFrame, own: int) -> DataFrame:
    """Win, draw or loss by counted goals of each side, and per-match counts."""
    goal = F.col("is_goal")
    g = events.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(goal & (F.col("event_team_id") == own)).alias("goals_for"),
        F.count_if(goal & (F.col("event_team_id") != own)).alias("goals_against"),
    )
    f, a = F.col("goals_for"), F.col("goals_against")
    return g.withColumn("result", F.when(f > a, "W").when(f < a, "L").otherwise("D"))
