"""Reset excursions measured under two interval systems, readiness of reviewed samples, recovery by label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.operators.episodes import episode_progression
from strideframe.operators.ordered import Lane, Scan
from strideframe.operators.replay_score import beside
from strideframe.sources.stage import durable

METRICS = ("peak", "retreat", "seconds_since_peak", "events_since_peak")
#: Event numbers that share a bucket of the span join.
_WIDTH = 256
#: fixed values: why a sample isn't ready
REASONS = (
    "no_locked_reset_review_label",
    "no_reviewed_episode_membership",
    "unresolved_episode_start_or_partial_case_structure",
    "no_trusted_current_progression_measurement",
    "opening_restart_not_reset_evidence",
    "drawdown_includes_contest_relocation",
)
#: fixed values: locks that count as reviewed
LOCKS = ("LOCKED", "PARTIAL_LOCK")


def in_spans(events: DataFrame, spans: DataFrame) -> DataFrame:
    """Each event once for each span of its case (case_id, span, lo, hi, ...) that holds it.

    Spans are cut at fixed event numbers and met by (case, bucket), so a pair is formed only near its span.
    """
    bucket = lambda c: F.floor(F.col(c) / _WIDTH).cast("bigint")
    cut = spans.where("lo <= hi").withColumn("__bucket", F.explode(F.sequence(bucket("lo"), bucket("hi"))))
    met = events.withColumn("__bucket", bucket("event_index")).join(cut, ["case_id", "__bucket"])
    return met.where("event_index BETWEEN lo AND hi").drop("__bucket", "lo", "hi")


def excursion_table(members: DataFrame, measures: DataFrame, ledger: DataFrame, candidates: DataFrame, lane: Lane, metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row per reviewed reset with its measures after the split and as if nothing had been split.

    members: ``assign_membership``'s rows with the columns of ``measurement_state`` and event_position; measures:
    ``episode_progression`` of them; ledger: case_id, boundary_id, boundary_type, onset, onset_lower, confirmation,
    last_reset_sample, precision; candidates: case_id, candidate_event.

    ``confirmation_episode_*`` are the measures of the sample at the confirmation in its own episode. The same event is
    measured from the start of the last episode before the onset's lower bound on, through whatever lies between
    (``confirmation_unsplit_reference_*``, a counterfactual), and the onset at the end of the episode before it
    (``onset_pre_split_*``, only where that episode has a peak and a valid start). Both are spans of the one stream and are
    measured together. What can't be measured is null; without an earlier episode there is no reference.
    """
    resets = ledger.where("boundary_type = 'CLEAR_RESET'").withColumn("__lower", F.coalesce("onset_lower", "onset"))
    placed = members.where("episode_id IS NOT NULL").select("case_id", F.col("event_index").alias("at"), F.struct("episode_id", "state_valid").alias("__ep"))
    resets = beside(resets, "__lower", placed, lane, {"__ref": Scan("last", "__ep")}, strict=True)
    resets = durable(beside(resets, "onset", placed, lane, {"__prior": Scan("last", "__ep")}, strict=True))
    begun = durable(members.where("episode_id IS NOT NULL").groupBy("case_id", "episode_id").agg(F.min("event_index").alias("__first"), F.min("state_valid").alias("__valid")))

    def spans(kind: str, episode: str, hi: str) -> DataFrame:
        start = begun.select(F.col("case_id").alias("__case"), F.col("episode_id").alias("__of"), "__first")
        rows = resets.where(F.col(f"{episode}.episode_id").isNotNull() & F.col(hi).isNotNull())
        rows = rows.join(start, (F.col("case_id") == F.col("__case")) & (F.col(f"{episode}.episode_id") == F.col("__of")))
        return rows.select(
            "case_id", F.concat(F.lit(kind), "boundary_id").alias("span"), F.col("__first").alias("lo"), F.col(hi).alias("hi"), F.lit(kind).alias("__kind"), "__of", F.col(hi).alias("__end")
        )

    both = spans("U:", "__ref", "confirmation").unionByName(spans("P:", "__prior", "onset"))
    rows = in_spans(members, both)
    # before a split only the earlier episode's own events count, and the onset
    rows = rows.where((F.col("__kind") == "U:") | (F.col("episode_id") == F.col("__of")) | (F.col("event_index") == F.col("__end")))
    rows = rows.withColumns({"__own": F.col("episode_id"), "episode_id": F.col("span")})
    m = durable(episode_progression(rows, lane.by("case_id", "episode_id")))
    at_end = m.where("event_index = __end").select("case_id", "span", *[F.col(c).alias(f"__m_{c}") for c in metrics])
    peaks = m.where("event_index < __end").groupBy("case_id", "span").agg(F.max("peak").alias("__before"))
    at_end = at_end.join(peaks, ["case_id", "span"], "left")

    def taken(kind: str, prefix: str) -> DataFrame:
        of = at_end.where(F.col("span").startswith(kind))
        return of.select("case_id", F.substring("span", 3, 1 << 20).alias("boundary_id"), *[F.col(f"__m_{c}").alias(prefix + c) for c in metrics], F.col("__before").alias(f"{prefix}_before"))

    samples = candidates.groupBy("case_id", "candidate_event").agg(F.count(F.lit(1)).alias("n"))
    here = lambda name, n: samples.select("case_id", F.col("candidate_event").alias(name), F.col("n").alias(n))
    own = measures.select("case_id", F.col("event_index").alias("confirmation"), *[F.col(c).alias(f"confirmation_episode_{c}") for c in metrics])
    clock = members.select("case_id", "event_index", "t_us")
    times = lambda name: clock.select("case_id", F.col("event_index").alias(name), F.col("t_us").alias(f"__t_{name}"))
    out = resets.join(here("onset", "onset_samples"), ["case_id", "onset"], "left").join(here("confirmation", "confirmation_samples"), ["case_id", "confirmation"], "left")
    out = out.join(own, ["case_id", "confirmation"], "left").join(times("onset"), ["case_id", "onset"], "left").join(times("confirmation"), ["case_id", "confirmation"], "left")
    out = out.join(taken("U:", "confirmation_unsplit_reference_").drop("confirmation_unsplit_reference__before"), ["case_id", "boundary_id"], "left")
    out = out.join(taken("P:", "onset_pre_split_"), ["case_id", "boundary_id"], "left")
    valid = begun.select(F.col("case_id").alias("__case"), F.col("episode_id").alias("__pe"), "__valid")
    out = out.join(valid, (F.col("case_id") == F.col("__case")) & (F.col("__prior.episode_id") == F.col("__pe")), "left")
    known, prior = F.col("onset").isNotNull(), F.col("__prior.episode_id").isNotNull()
    peak = F.col("onset_pre_split__before")
    usable = F.col("onset_pre_split_peak").isNotNull() & peak.isNotNull() & F.coalesce("__valid", F.lit(False))
    sampled = F.col("confirmation_samples").isNotNull()
    return out.select(
        "case_id",
        F.col("boundary_id").alias("reset_excursion_id"),
        F.col("onset").alias("onset_event"),
        "onset_lower",
        F.col("confirmation").alias("confirmation_event"),
        "last_reset_sample",
        F.col("precision").alias("onset_precision"),
        F.when(known, "encoded_at_review_candidate_resolution").otherwise("unresolved").alias("onset_status"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("onset_samples", "confirmation_samples")],
        *[F.when(sampled, F.col(f"confirmation_episode_{c}")).alias(f"confirmation_episode_{c}") for c in metrics],
        F.when(F.col("__ref.episode_id").isNotNull(), "counterfactual_no_reset_until_confirmation_not_calibration_ready").alias("confirmation_unsplit_reference_status"),
        *[f"confirmation_unsplit_reference_{c}" for c in metrics],
        F.when(known & prior, usable).alias("onset_pre_split_available"),
        *[F.when(known & prior & usable, F.col(f"onset_pre_split_{c}")).alias(f"onset_pre_split_{c}") for c in metrics],
        F.when(known & prior, F.when(usable, "censored_at_final_reset_split").otherwise("unavailable_prior_observed_peak")).alias("onset_pre_split_recovery_status"),
        F.when(known, F.col("__prior.episode_id")).alias("onset_reference_episode_id"),
        F.when(known & prior & F.col("onset_pre_split_peak").isNotNull(), peak).alias("onset_prior_established_peak_x"),
        F.when(known & prior, (F.col("__t_confirmation") - F.col("__t_onset")) / 1e6).alias("onset_time_to_confirmation"),
    )


def sample_readiness(samples: DataFrame, labels: Sequence[str]) -> DataFrame:
    """``samples`` with ``exclusion_reason`` (those that hold, in order, joined by ';') and ``ready`` where there is none.

    samples: human_label, lock_status, episode_id, state_valid, retreat, opening_restart, relocation_affected; nulls are
    no label, no membership, no measure, and no evidence of a restart or relocation.
    """
    member = F.col("episode_id").isNotNull()
    rules: list[Column] = [
        ~F.coalesce(F.col("human_label").isin(*labels) & F.col("lock_status").isin(*LOCKS), F.lit(False)),
        ~member,
        member & ~F.coalesce("state_valid", F.lit(False)),
        F.col("retreat").isNull(),
        F.coalesce("opening_restart", F.lit(False)),
        F.coalesce("relocation_affected", F.lit(False)),
    ]
    why = F.concat_ws(";", *[F.when(rule, F.lit(name)) for rule, name in zip(rules, REASONS, strict=True)])
    return samples.withColumn("exclusion_reason", why).withColumn("ready", F.col("exclusion_reason") == "")


def recovery_summary(samples: DataFrame, labels: Sequence[str], small: bool) -> DataFrame:
    """Recovery of the ready samples of each label; a label without samples has a row of zeros.

    samples: human_label, ready, seconds_to_recovery, recovery_status. Mean and median are over observed times alone.
    """
    from strideframe.operators.quantiles import exact_quantiles

    group = samples.where("ready").select("human_label", "seconds_to_recovery", "recovery_status")
    t, how = F.col("seconds_to_recovery"), F.col("recovery_status")
    counts = group.groupBy("human_label").agg(
        F.count(F.lit(1)).alias("candidate_count"),
        F.count(t).alias("observed_time_count"),
        F.count_if(t.isNull()).alias("missing_time_count"),
        F.mean(t).alias("conditional_mean_recovery_seconds"),
        F.count_if(how == "censored_at_episode_observation_end").alias("censored_count"),
        F.count_if(how == "not_applicable_at_peak").alias("at_peak_count"),
    )
    medians = exact_quantiles(group, ["human_label"], "seconds_to_recovery", {"conditional_median_recovery_seconds": 0.5}, small)
    out = samples.sparkSession.createDataFrame([(x,) for x in labels], "human_label string").join(counts, "human_label", "left").join(medians, "human_label", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("candidate_count", "observed_time_count", "missing_time_count", "censored_count", "at_peak_count")})
