"""Replayed warnings against a reviewed ledger: what can't be scored, pairs, classes, counts per case."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.operators.episodes import HARD
from strideframe.operators.expectations import require_none
from strideframe.operators.matching import match_nearest
from strideframe.operators.ordered import Lane, Scan, islands, scan
from strideframe.sources.stage import durable

#: fixed values: why a stretch of a case isn't scored
REASONS = ("deferred review tail", "partial case structure", "provisional episode start", "unknown reset onset", "unresolved warning outcome")
#: fixed values: classes of warnings and of ledger rows
UNSCORED, MISMATCH = "UNSCORED_AMBIGUOUS", "HARD_BOUNDARY_MISMATCH"


def ambiguity_intervals(parents: DataFrame, ledger: DataFrame, episodes: DataFrame, candidates: DataFrame, partial: DataFrame) -> DataFrame:
    """``case_id, lo, hi, reason``: stretches of a case whose review is open.

    parents: case_id, first_event, last_event; ledger: case_id, boundary_type, onset, onset_lower, confirmation; episodes:
    case_id, episode_start, episode_end, state_valid; candidates: case_id, candidate_event, candidate_role,
    warning_resolution, episode_end; partial: case_id. A case in ``partial`` is open from end to end and has no other
    stretch. Stretches may overlap; one without both ends is none.
    """
    part = partial.select("case_id").distinct()
    whole = parents.join(part, "case_id", "left_semi").select("case_id", F.col("first_event").alias("lo"), F.col("last_event").alias("hi"), F.lit(REASONS[1]).alias("reason"))
    late = ledger.where("boundary_type = 'REVIEW_DEFERRED'").join(parents, "case_id").select("case_id", F.col("onset").alias("lo"), F.col("last_event").alias("hi"), F.lit(REASONS[0]).alias("reason"))
    unknown = ledger.where("boundary_type = 'CLEAR_RESET' AND onset IS NULL").select("case_id", F.col("onset_lower").alias("lo"), F.col("confirmation").alias("hi"), F.lit(REASONS[3]).alias("reason"))
    shaky = episodes.where("NOT state_valid").select("case_id", F.col("episode_start").alias("lo"), F.col("episode_end").alias("hi"), F.lit(REASONS[2]).alias("reason"))
    open_ = candidates.where("warning_resolution = 'not_confirmed_in_available_review' AND candidate_role = 'reset_warning'")
    open_ = open_.select("case_id", F.col("candidate_event").alias("lo"), F.col("episode_end").alias("hi"), F.lit(REASONS[4]).alias("reason"))
    rest = late.unionByName(unknown).unionByName(shaky).unionByName(open_).join(part, "case_id", "left_anti")
    return whole.unionByName(rest).where("lo IS NOT NULL AND hi IS NOT NULL")


def coalesce_intervals(intervals: DataFrame, lane: Lane) -> DataFrame:
    """``case_id, lo, hi, reasons``: islands of intervals that share an event, with their reasons in order.

    An interval opens an island if it begins beyond all that began before it: one running maximum.
    """
    lane = Lane(("case_id",), ("lo", "hi", "reason"), "CAST(floor(lo / 100000) AS BIGINT)" if lane.block else None)
    rows = scan(intervals, lane, {"__before": Scan("max", "hi", exclusive=True)})
    rows = islands(rows, lane, "__before IS NULL OR lo > __before", "__island")
    out = rows.groupBy("case_id", "__island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    return out.select("case_id", "lo", "hi", F.concat_ws("; ", "reasons").alias("reasons"))


def beside(points: DataFrame, at: str, marks: DataFrame, lane: Lane, specs: dict[str, Scan], strict: bool = False) -> DataFrame:
    """``points`` with running aggregates over the ``marks`` (case_id, at, ...) of their case up to, or ``strict``ly before, ``at``."""
    rows = points.withColumns({"__at": F.col(at).cast("bigint"), "__r": F.lit(1)})
    marks = marks.withColumns({"__at": F.col("at").cast("bigint"), "__r": F.lit(2 if strict else 0)}).drop("at")
    block = "CAST(floor(__at / 100000) AS BIGINT)" if lane.block else None
    rows = scan(rows.unionByName(marks, allowMissingColumns=True), Lane(("case_id",), ("__at", "__r"), block), specs)
    return rows.where("__r = 1").select(*points.columns, *specs)


def with_ambiguity(spans: DataFrame, intervals: DataFrame, lane: Lane, first: str, last: str) -> DataFrame:
    """``spans`` with ``ambiguity``: the reasons of the intervals that overlap first..last, in order; empty if there are none.

    Of the intervals of a reason that begin by ``last`` the farthest end decides: one running maximum a reason, no pairs.
    """
    marks = intervals.select("case_id", F.col("lo").alias("at"), F.col("hi").cast("bigint").alias("__hi"), F.col("reason").alias("__why"))
    names = {f"__m{k}": why for k, why in enumerate(REASONS)}
    rows = beside(spans, last, marks, lane, {n: Scan("max", f"CASE WHEN __why = '{why}' THEN __hi END") for n, why in names.items()})
    hit = [F.when(F.col(n) >= F.col(first), F.lit(why)) for n, why in names.items()]
    return rows.select(*spans.columns, F.concat_ws("; ", *hit).alias("ambiguity"))


def _split(pair: Column, at: Column) -> Column:
    return F.when(pair == at, "MATCH").when(pair < at, "EARLY_SPLIT").otherwise("LATE_SPLIT")


def score_predictions(
    warnings: DataFrame, starts: DataFrame, parents: DataFrame, ledger: DataFrame, candidates: DataFrame, intervals: DataFrame, partial: DataFrame, lane: Lane, versions: Sequence[str]
) -> DataFrame:
    """One row per reviewed boundary or exclusion, per warning and per stretch that isn't scored, with its ``classification``.

    warnings: version, case_id, onset, end_event, resolution (as ``drawdown_detector`` gives them; those of a case and
    version follow each other); starts: case_id, event_index of the events at which a case goes on after a hard
    boundary (the first of each ``part`` of ``cut_at_hard``) and ``kind`` 'REGAIN', and of hard boundaries seen in the
    stream with 'HARD'; ledger: case_id, boundary_id, boundary_type, onset, confirmation, resume, last_reset_sample;
    candidates: also human_label. Returned: version, case_id, kind, classification, reviewed_id, reviewed_onset,
    predicted_onset, predicted_end, resolution, reviewed_samples, explanation.

    HARD_BOUNDARY: the stream has the onset and goes on at the resume. NO_EPISODE: an excluded case has no warning.
    REVIEWED_RESET: in order of onset, each takes the nearest free confirmed and unambiguous warning between the same
    hard boundaries, whose onset is by the last reset sample and whose confirmation is after the last sample before the
    reset that was reviewed as continuing. PREDICTED_WARNING: by its pair, else extra; cancelled ones over a reviewed
    onset are missed resets, else right; those without a decision are false warnings. REVIEW_SCOPE: coalesced intervals.
    A reset without last_reset_sample is missed; one whose last sample is before its onset is an error.
    """
    every = F.explode(F.array(*map(F.lit, versions))).alias("version")
    out_of = partial.select("case_id").distinct().withColumn("__partial", F.lit(True))
    hard = ledger.where(F.col("boundary_type").isin(*HARD) & F.col("onset").isNotNull())
    gates = durable(hard.select("case_id", F.col("onset").alias("at"), F.lit(1).alias("__gate")))
    count = {"segment": Scan("count", "__gate")}

    w = with_ambiguity(warnings.select("version", "case_id", "onset", "end_event", "resolution"), intervals, lane, "onset", "end_event")
    w = durable(beside(w, "onset", gates, lane, count))

    resets = ledger.where("boundary_type = 'CLEAR_RESET'").join(out_of, "case_id", "left").join(parents.select("case_id", "first_event"), "case_id", "left")
    going = candidates.where("human_label = 'CONTINUE' AND candidate_role = 'normal_active_episode_sample'")
    resets = beside(resets, "onset", going.select("case_id", F.col("candidate_event").alias("at"), F.col("candidate_event").alias("__sample")), lane, {"__last": Scan("last", "__sample")}, strict=True)
    resets = durable(beside(resets, "onset", gates, lane, count))
    scored = resets.where("onset IS NOT NULL AND __partial IS NULL")
    require_none(scored, {"last_sample_before_onset": F.col("last_reset_sample") < F.col("onset")})

    keys = ("version", "case_id", "segment")
    zero = F.lit(0).alias("tie")
    seekers = scored.where("last_reset_sample IS NOT NULL").select(
        every, "case_id", "segment", F.col("onset").alias("at"), zero, F.col("boundary_id").alias("id"), F.coalesce(F.col("__last") + 1, "first_event").alias("lower"), F.col("last_reset_sample").alias("upper")
    )
    partners = w.where("resolution = 'CONFIRMED' AND ambiguity = ''").select(*keys, F.col("onset").alias("at"), zero, F.lit("").alias("id"), F.col("end_event").alias("reach"))
    block = "CAST(floor(at / 100000) AS BIGINT)" if lane.block else None
    pairs = durable(match_nearest(seekers, partners, Lane(keys, ("at",), block)).where("seeker IS NOT NULL AND partner IS NOT NULL"))
    s, p = F.col("seeker"), F.col("partner")

    columns = ["version", "case_id", "kind", "classification", "reviewed_id", "reviewed_onset", "predicted_onset", "predicted_end", "resolution", "reviewed_samples", "explanation"]

    def rows(df: DataFrame, kind: str, classification: Column, explanation: Column | str, **more: Column) -> DataFrame:
        number, text = F.lit(None).cast("bigint"), F.lit(None).cast("string")
        have = {"reviewed_id": text, "reviewed_onset": number, "predicted_onset": number, "predicted_end": number, "resolution": text, "reviewed_samples": number} | more
        why = F.lit(explanation) if isinstance(explanation, str) else explanation
        return df.select("version", "case_id", F.lit(kind).alias("kind"), classification.alias("classification"), *[c.cast("bigint" if n not in ("reviewed_id", "resolution") else "string").alias(n) for n, c in have.items()], why.alias("explanation")).select(*columns)

    # hard boundaries were handed to the replay; what is compared is that they came through
    seen = {k: starts.where(F.col("kind") == k).select("case_id", F.col("event_index").alias(at)).distinct().withColumn(f"__{k}", F.lit(True)) for k, at in (("HARD", "onset"), ("REGAIN", "resume"))}
    h = hard.join(seen["HARD"], ["case_id", "onset"], "left").join(seen["REGAIN"], ["case_id", "resume"], "left").join(out_of, "case_id", "left").select("*", every)
    kept = F.col("__HARD").isNotNull() & (F.col("resume").isNull() | F.col("__REGAIN").isNotNull())
    found = rows(
        h,
        "HARD_BOUNDARY",
        F.when(F.col("__partial"), UNSCORED).when(kept, "MATCH").otherwise(MISMATCH),
        "reviewed hard boundary passed through",
        reviewed_id=F.col("boundary_id"),
        reviewed_onset=F.col("onset"),
        predicted_onset=F.when(F.col("__HARD"), F.col("onset")),
    )
    barred = ledger.where(F.col("boundary_type").endswith("EXCLUDE")).select("*", every)
    warned = w.select("version", "case_id").distinct().withColumn("__warned", F.lit(True))
    found = found.unionByName(
        rows(barred.join(warned, ["version", "case_id"], "left"), "NO_EPISODE", F.when(F.col("__warned"), MISMATCH).otherwise("MATCH"), "reviewed exclusion: no predicted episode", reviewed_id=F.col("boundary_id"))
    )
    # ids may repeat, so pairs come back by place
    taken = pairs.select(*keys, s["at"].alias("onset"), s["id"].alias("boundary_id"), p["at"].alias("__pair")).groupBy(*keys, "onset", "boundary_id").agg(F.min("__pair").alias("__pair"))
    r = resets.select("*", every).join(taken, [*keys, "onset", "boundary_id"], "left")
    blurred = F.col("onset").isNull() | F.coalesce("__partial", F.lit(False))
    found = found.unionByName(
        rows(
            r,
            "REVIEWED_RESET",
            F.when(blurred, UNSCORED).when(F.col("__pair").isNull(), "MISSED_RESET").otherwise(_split(F.col("__pair"), F.col("onset"))),
            F.when(blurred, "reviewed onset unresolved; no inferred target").when(F.col("__pair").isNull(), "no scored confirmation aligned with the reviewed excursion").otherwise("nearest predicted onset"),
            reviewed_id=F.col("boundary_id"),
            reviewed_onset=F.col("onset"),
            predicted_onset=F.when(~blurred, F.col("__pair")),
        )
    )
    back = pairs.groupBy(*keys, p["at"].alias("onset")).agg(F.min(F.struct(s["at"].alias("at"), s["id"].alias("id"))).alias("__of"))
    onsets = resets.where("onset IS NOT NULL").select("case_id", F.col("onset").alias("at"), F.col("onset").alias("__reset"))
    retained = candidates.where("warning_resolution = 'cancelled_or_retained_continue'").select("case_id", F.col("candidate_event").alias("at"), F.lit(1).alias("__one"))
    v = beside(w, "end_event", onsets, lane, {"__reset": Scan("max", "__reset")})
    v = beside(v, "end_event", retained, lane, {"__by_end": Scan("count", "__one")})
    v = beside(v, "onset", retained, lane, {"__by_onset": Scan("count", "__one")}, strict=True).join(back, [*keys, "onset"], "left")
    how, over = F.col("resolution"), F.coalesce(F.col("__reset") >= F.col("onset"), F.lit(False))
    open_, extra = F.col("ambiguity") != "", F.col("__of").isNull()
    found = found.unionByName(
        rows(
            v,
            "PREDICTED_WARNING",
            F.when(open_, UNSCORED)
            .when((how == "CONFIRMED") & extra, "EXTRA_RESET")
            .when(how == "CONFIRMED", _split(F.col("onset"), F.col("__of.at")))
            .when((how == "CANCELLED") & over, "MISSED_RESET")
            .when(how == "CANCELLED", "CORRECT_WARNING_CANCEL")
            .otherwise("FALSE_WARNING_ONLY"),
            F.when(open_, F.col("ambiguity"))
            .when(how == "CONFIRMED", "confirmed before any cancellation")
            .when((how == "CANCELLED") & over, "cancelled at a reviewed reset onset")
            .when(how == "CANCELLED", "cancelled by a trusted forward action")
            .otherwise("unresolved until a hard boundary or the end; no split"),
            reviewed_id=F.col("__of.id"),
            reviewed_onset=F.col("__of.at"),
            predicted_onset=F.col("onset"),
            predicted_end=F.col("end_event"),
            resolution=how,
            reviewed_samples=F.coalesce("__by_end", F.lit(0)) - F.coalesce("__by_onset", F.lit(0)),
        )
    )
    scope = coalesce_intervals(intervals, lane).select("*", every)
    return found.unionByName(rows(scope, "REVIEW_SCOPE", F.lit(UNSCORED), F.format_string("%d-%d: %s", "lo", "hi", "reasons"), reviewed_onset=F.col("lo"), predicted_end=F.col("hi")))


def case_counts(details: DataFrame, parents: DataFrame, ledger: DataFrame, versions: Sequence[str]) -> DataFrame:
    """Counts of a case and version over the rows of ``score_predictions``; every case of ``parents`` has a row per version.

    ``predicted_episode_count`` is one for the parent, unless it is excluded, one for each resume after a hard boundary and
    one for each confirmed warning.
    """
    kind, label, how = F.col("kind"), F.col("classification"), F.col("resolution")
    warning, reset = kind == "PREDICTED_WARNING", kind == "REVIEWED_RESET"
    wanted = {
        "reviewed_scored_resets": reset & F.col("reviewed_onset").isNotNull(),
        "matched_resets": reset & (label == "MATCH"),
        "early_splits": reset & (label == "EARLY_SPLIT"),
        "late_splits": reset & (label == "LATE_SPLIT"),
        "missed_resets": reset & (label == "MISSED_RESET"),
        "extra_final_splits": warning & (label == "EXTRA_RESET"),
        "warning_count": warning,
        "predicted_confirmation_count": warning & (how == "CONFIRMED"),
        "predicted_cancellation_count": warning & (how == "CANCELLED"),
        "terminated_before_pivot": warning & ~how.isin("CONFIRMED", "CANCELLED"),
        "warning_only_false_positives": warning & (label == "FALSE_WARNING_ONLY"),
        "correctly_cancelled_warnings": warning & (label == "CORRECT_WARNING_CANCEL"),
        "hard_boundary_mismatches": label == MISMATCH,
        "unscored_warnings": warning & (label == UNSCORED),
        "review_scopes": kind == "REVIEW_SCOPE",
    }
    counts = details.groupBy("version", "case_id").agg(*[F.count_if(c).alias(n) for n, c in wanted.items()])
    begun = ledger.groupBy("case_id").agg(
        F.count_if(F.col("boundary_type").isin(*HARD) & F.col("resume").isNotNull()).alias("__resumes"), F.max(F.col("boundary_type").endswith("EXCLUDE")).alias("__barred")
    )
    base = parents.select("case_id", F.explode(F.array(*map(F.lit, versions))).alias("version")).join(begun, "case_id", "left").join(counts, ["version", "case_id"], "left")
    base = base.withColumns({n: F.coalesce(n, F.lit(0)) for n in wanted})
    episodes = F.when(F.coalesce("__barred", F.lit(False)), 0).otherwise(1) + F.coalesce("__resumes", F.lit(0)) + F.col("predicted_confirmation_count")
    return base.select("version", "case_id", *[n for n in wanted if n != "review_scopes"], episodes.alias("predicted_episode_count"), (F.col("review_scopes") > 0).alias("unscored_ambiguous_case"))
