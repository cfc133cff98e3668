"""Scoring of replayed warnings; the SQL compares every warning with every interval, boundary and sample of its case."""

from pyspark.sql import functions as F

from strideframe.operators import episodes as P
from strideframe.operators import excursions as X
from strideframe.operators import replay_score as S
from strideframe.plans.fixtures import EV, OWN, RICH, sql
from strideframe.plans.q_review import EPI, EPM, case_lane, cases, episodes, members, replayed
from strideframe.plans.registry import query
from strideframe.sources.stage import durable

VERSIONS = ("v0.1", "v0.3")
_BOUNDARY = "CASE k % 13 WHEN 5 THEN 'TERMINAL' WHEN 6 THEN 'CLEAR_RESET' ELSE 'OPPONENT_CONTROL' END"
_LATE = "k % 13 = 6 AND k % 2 = 0"


def parents(fx):
    return cases(fx).groupBy("case_id").agg(F.min("event_index").alias("first_event"), F.max("event_index").alias("last_event"))


def reviewed(fx):
    """The ledger with confirmations, last samples, exclusions and deferred ends."""
    s = cases(fx).join(parents(fx), "case_id")
    none = "CAST(NULL AS BIGINT)"
    base = s.where("k % 13 IN (5, 6, 7) AND event_index > first_event + 1").selectExpr(
        "case_id",
        "concat('B', event_id) AS boundary_id",
        f"{_BOUNDARY} AS boundary_type",
        f"CASE WHEN {_LATE} THEN NULL ELSE event_index END AS onset",
        f"CASE WHEN {_LATE} THEN event_index - 1 END AS onset_lower",
        "event_index + 1 AS confirmation",
        "CASE k % 13 WHEN 6 THEN event_index WHEN 7 THEN event_index + 2 END AS resume",
        "CASE WHEN event_id % 17 <> 0 THEN event_index + 3 END AS last_reset_sample",
    )
    barred = s.where("event_index = first_event AND possession_id % 10 = 8").selectExpr(
        "case_id", "concat('X', event_id)", "'ADMIN_EXCLUDE'", none, none, none, none, none
    )
    late = s.where("event_index = last_event AND possession_id % 9 = 4").selectExpr("case_id", "concat('D', event_id)", "'REVIEW_DEFERRED'", "event_index", none, none, none, none)
    return base.union(barred).union(late)


def samples(fx):
    return members(fx).where("k % 2 = 0").selectExpr(
        "case_id",
        "event_index AS candidate_event",
        "CASE WHEN k % 3 = 0 THEN 'CONTINUE' ELSE 'RESET' END AS human_label",
        "CASE WHEN k % 5 = 0 THEN 'reset_warning' WHEN k % 5 < 3 THEN 'normal_active_episode_sample' ELSE 'ordinary_context' END AS candidate_role",
        "CASE k % 7 WHEN 0 THEN 'cancelled_or_retained_continue' WHEN 1 THEN 'not_confirmed_in_available_review' ELSE 'confirmed' END AS warning_resolution",
        "episode_end",
    )


def ruled(fx):
    """Warnings by a plain rule, each open until the next of its version."""
    s = cases(fx).where("k % 6 IN (1, 3)").withColumn("version", F.expr("CASE k % 6 WHEN 1 THEN 'v0.3' ELSE 'v0.1' END"))
    lane = case_lane(fx, "case_id", "version")
    s = P.shift(s, lane, {"__next": "event_index"}, -1).join(parents(fx), "case_id")
    return s.selectExpr(
        "version", "case_id", "event_index AS onset", "coalesce(__next - 1, last_event) AS end_event",
        "CASE CAST(floor(k / 6) AS INT) % 3 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'CANCELLED' ELSE 'CENSORED_PARENT_END' END AS resolution",
    )


def scored(fx, warnings, versions):
    """Details of a replay, with its parents and ledger."""
    lane = case_lane(fx, "case_id")
    led, par, cand = durable(reviewed(fx)), durable(parents(fx)), durable(samples(fx))
    partial = cases(fx).where("possession_id % 16 = 5").select("case_id")
    hard = led.where(F.col("boundary_type").isin(*P.HARD))
    # one event in 29 is missing from the stream, so some boundaries don't come through
    stream = cases(fx).where("event_id % 29 <> 0")
    cut = P.cut_at_hard(stream, hard, lane).where("part > 0").groupBy("case_id", "part").agg(F.min("event_index").alias("event_index"))
    seen = hard.select("case_id", F.col("onset").alias("event_index")).join(stream.select("case_id", "event_index"), ["case_id", "event_index"], "left_semi")
    starts = cut.select("case_id", "event_index", F.lit("REGAIN").alias("kind")).unionByName(seen.withColumn("kind", F.lit("HARD")))
    open_ = durable(S.ambiguity_intervals(par, led, episodes(fx), cand, partial))
    return S.score_predictions(warnings, starts, par, led, cand, open_, partial, lane, versions), par, led


SCORE = f"""{EPI},
 lg2 AS (SELECT case_id, 'B' || event_id AS boundary_id, {_BOUNDARY} AS boundary_type, CASE WHEN {_LATE} THEN NULL ELSE event_index END AS onset, CASE WHEN {_LATE} THEN event_index - 1 END AS onset_lower,
   event_index + 1 AS confirmation, CASE k % 13 WHEN 6 THEN event_index WHEN 7 THEN event_index + 2 END AS resume, CASE WHEN event_id % 17 <> 0 THEN event_index + 3 END AS last_reset_sample
   FROM cs JOIN pa USING (case_id) WHERE k % 13 IN (5, 6, 7) AND event_index > f + 1
  UNION ALL SELECT case_id, 'X' || event_id, 'ADMIN_EXCLUDE', NULL, NULL, NULL, NULL, NULL FROM cs JOIN pa USING (case_id) WHERE event_index = f AND possession_id % 10 = 8
  UNION ALL SELECT case_id, 'D' || event_id, 'REVIEW_DEFERRED', event_index, NULL, NULL, NULL, NULL FROM cs JOIN pa USING (case_id) WHERE event_index = l AND possession_id % 9 = 4),
 hd AS (SELECT * FROM lg2 WHERE boundary_type IN ('OPPONENT_CONTROL', 'TERMINAL')),
 ca AS (SELECT em.case_id, event_index AS candidate_event, CASE WHEN k % 3 = 0 THEN 'CONTINUE' ELSE 'RESET' END AS human_label,
   CASE WHEN k % 5 = 0 THEN 'reset_warning' WHEN k % 5 < 3 THEN 'normal_active_episode_sample' ELSE 'ordinary_context' END AS candidate_role,
   CASE k % 7 WHEN 0 THEN 'cancelled_or_retained_continue' WHEN 1 THEN 'not_confirmed_in_available_review' ELSE 'confirmed' END AS warning_resolution, ep.episode_end
   FROM em LEFT JOIN ep USING (episode_id) WHERE k % 2 = 0),
 pt AS (SELECT DISTINCT case_id FROM cs WHERE possession_id % 16 = 5),
 iv AS (SELECT case_id, f AS lo, l AS hi, 'partial case structure' AS why FROM pa JOIN pt USING (case_id)
  UNION ALL SELECT * FROM (SELECT case_id, onset AS lo, l AS hi, 'deferred review tail' AS why FROM lg2 JOIN pa USING (case_id) WHERE boundary_type = 'REVIEW_DEFERRED'
   UNION ALL SELECT case_id, onset_lower, confirmation, 'unknown reset onset' FROM lg2 WHERE boundary_type = 'CLEAR_RESET' AND onset IS NULL
   UNION ALL SELECT case_id, episode_start, episode_end, 'provisional episode start' FROM ep WHERE NOT state_valid
   UNION ALL SELECT case_id, candidate_event, episode_end, 'unresolved warning outcome' FROM ca WHERE warning_resolution = 'not_confirmed_in_available_review' AND candidate_role = 'reset_warning' AND episode_end IS NOT NULL) x
   WHERE case_id NOT IN (SELECT case_id FROM pt)),
 w0 AS (SELECT case_id, CASE k % 6 WHEN 1 THEN 'v0.3' ELSE 'v0.1' END AS version, event_index AS onset, k FROM cs WHERE k % 6 IN (1, 3)),
 wn AS (SELECT version, case_id, onset, COALESCE(LEAD(onset) OVER (PARTITION BY case_id, version ORDER BY onset) - 1, l) AS end_event,
   CASE CAST(floor(k / 6) AS INT) % 3 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'CANCELLED' ELSE 'CENSORED_PARENT_END' END AS resolution FROM w0 JOIN pa USING (case_id)),
 wa AS (SELECT *, (SELECT COUNT(*) FROM hd WHERE hd.case_id = wn.case_id AND hd.onset <= wn.onset) AS segment,
   COALESCE((SELECT string_agg(DISTINCT why, '; ' ORDER BY why) FROM iv WHERE iv.case_id = wn.case_id AND lo <= end_event AND hi >= wn.onset), '') AS ambiguity FROM wn),
 vs AS (SELECT unnest(['v0.1', 'v0.3']) AS version),
 rs AS (SELECT r.*, case_id IN (SELECT case_id FROM pt) AS part, (SELECT COUNT(*) FROM hd WHERE hd.case_id = r.case_id AND hd.onset <= r.onset) AS segment,
   COALESCE((SELECT MAX(candidate_event) FROM ca WHERE ca.case_id = r.case_id AND human_label = 'CONTINUE' AND candidate_role = 'normal_active_episode_sample' AND candidate_event < r.onset) + 1, f) AS lower
   FROM lg2 r JOIN pa USING (case_id) WHERE boundary_type = 'CLEAR_RESET'),
 sk AS (SELECT version, case_id, segment, list({{'onset': onset, 'id': boundary_id, 'lower': lower, 'upper': last_reset_sample}} ORDER BY onset) AS want FROM rs, vs
   WHERE onset IS NOT NULL AND NOT part AND last_reset_sample IS NOT NULL GROUP BY ALL),
 pn AS (SELECT version, case_id, segment, list({{'onset': onset, 'reach': end_event}} ORDER BY onset) AS have FROM wa WHERE resolution = 'CONFIRMED' AND ambiguity = '' GROUP BY ALL),
 picks AS (SELECT version, case_id, segment, 0 AS n, want, COALESCE(have, []) AS free, NULL::BIGINT AS onset, NULL::VARCHAR AS id, NULL::BIGINT AS pair FROM sk LEFT JOIN pn USING (version, case_id, segment)
  UNION ALL SELECT version, case_id, segment, n + 1, want, list_filter(free, lambda p: b.onset IS NULL OR p.onset <> b.onset), t.onset, t.id, b.onset FROM (
   SELECT *, want[n + 1] AS t, list_sort(list_transform(list_filter(free, lambda p: p.onset <= want[n + 1].upper AND p.reach >= want[n + 1].lower), lambda p: {{'gap': abs(p.onset - want[n + 1].onset), 'onset': p.onset}}))[1] AS b
   FROM picks WHERE n < len(want))),
 pr AS (SELECT version, case_id, onset, id, pair FROM picks WHERE pair IS NOT NULL),
 thin AS (SELECT * FROM cs WHERE event_id % 29 <> 0),
 c1 AS (SELECT t.case_id, t.event_index, COUNT(h.onset) OVER w AS part, LAST_VALUE(CASE WHEN h.onset IS NOT NULL THEN COALESCE(h.resume, 9223372036854775807) END IGNORE NULLS) OVER w AS until
   FROM thin t LEFT JOIN hd h ON h.case_id = t.case_id AND h.onset = t.event_index WINDOW w AS (PARTITION BY t.case_id ORDER BY t.event_index)),
 rg AS (SELECT case_id, MIN(event_index) AS event_index FROM c1 WHERE part > 0 AND event_index >= until GROUP BY case_id, part),
 h1 AS (SELECT h.*, version, EXISTS (SELECT 1 FROM thin t WHERE t.case_id = h.case_id AND t.event_index = h.onset) AS seen, h.resume IS NULL OR EXISTS (SELECT 1 FROM rg WHERE rg.case_id = h.case_id AND rg.event_index = h.resume) AS back,
   case_id IN (SELECT case_id FROM pt) AS part FROM hd h, vs),
 isl AS (SELECT case_id, lo, hi, why, SUM(head) OVER (PARTITION BY case_id ORDER BY lo, hi, why) AS g FROM (
   SELECT *, CASE WHEN COALESCE(lo > MAX(hi) OVER (PARTITION BY case_id ORDER BY lo, hi, why ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) THEN 1 ELSE 0 END AS head FROM iv)),
 co AS (SELECT case_id, MIN(lo) AS lo, MAX(hi) AS hi, string_agg(DISTINCT why, '; ' ORDER BY why) AS reasons FROM isl GROUP BY case_id, g),
 details AS (
  SELECT version, case_id, 'HARD_BOUNDARY' AS kind, CASE WHEN part THEN 'UNSCORED_AMBIGUOUS' WHEN seen AND back THEN 'MATCH' ELSE 'HARD_BOUNDARY_MISMATCH' END AS classification, boundary_id AS reviewed_id, onset AS reviewed_onset,
   CASE WHEN seen THEN onset END AS predicted_onset, NULL::BIGINT AS predicted_end, NULL::VARCHAR AS resolution, NULL::BIGINT AS reviewed_samples, 'reviewed hard boundary passed through' AS explanation FROM h1
  UNION ALL SELECT version, case_id, 'NO_EPISODE', CASE WHEN EXISTS (SELECT 1 FROM wn w WHERE w.case_id = g.case_id AND w.version = vs.version) THEN 'HARD_BOUNDARY_MISMATCH' ELSE 'MATCH' END, boundary_id, NULL, NULL, NULL, NULL, NULL,
   'reviewed exclusion: no predicted episode' FROM lg2 g, vs WHERE boundary_type LIKE '%EXCLUDE'
  UNION ALL SELECT vs.version, rs.case_id, 'REVIEWED_RESET', CASE WHEN rs.onset IS NULL OR part THEN 'UNSCORED_AMBIGUOUS' WHEN pair IS NULL THEN 'MISSED_RESET' WHEN pair = rs.onset THEN 'MATCH' WHEN pair < rs.onset THEN 'EARLY_SPLIT' ELSE 'LATE_SPLIT' END,
   boundary_id, rs.onset, pair, NULL, NULL, NULL, CASE WHEN rs.onset IS NULL OR part THEN 'reviewed onset unresolved; no inferred target' WHEN pair IS NULL THEN 'no scored confirmation aligned with the reviewed excursion' ELSE 'nearest predicted onset' END
   FROM rs CROSS JOIN vs LEFT JOIN pr ON pr.version = vs.version AND pr.case_id = rs.case_id AND pr.id = rs.boundary_id
  UNION ALL SELECT a.version, a.case_id, 'PREDICTED_WARNING', CASE WHEN ambiguity <> '' THEN 'UNSCORED_AMBIGUOUS' WHEN resolution = 'CONFIRMED' AND id IS NULL THEN 'EXTRA_RESET' WHEN resolution = 'CONFIRMED' AND a.onset = pr.onset THEN 'MATCH'
   WHEN resolution = 'CONFIRMED' AND a.onset < pr.onset THEN 'EARLY_SPLIT' WHEN resolution = 'CONFIRMED' THEN 'LATE_SPLIT' WHEN resolution = 'CANCELLED' AND over THEN 'MISSED_RESET' WHEN resolution = 'CANCELLED' THEN 'CORRECT_WARNING_CANCEL' ELSE 'FALSE_WARNING_ONLY' END,
   id, pr.onset, a.onset, end_event, resolution, (SELECT COUNT(*) FROM ca WHERE ca.case_id = a.case_id AND warning_resolution = 'cancelled_or_retained_continue' AND candidate_event BETWEEN a.onset AND a.end_event),
   CASE WHEN ambiguity <> '' THEN ambiguity WHEN resolution = 'CONFIRMED' THEN 'confirmed before any cancellation' WHEN resolution = 'CANCELLED' AND over THEN 'cancelled at a reviewed reset onset'
    WHEN resolution = 'CANCELLED' THEN 'cancelled by a trusted forward action' ELSE 'unresolved until a hard boundary or the end; no split' END
   FROM (SELECT *, EXISTS (SELECT 1 FROM rs WHERE rs.case_id = wa.case_id AND rs.onset BETWEEN wa.onset AND wa.end_event) AS over FROM wa) a LEFT JOIN pr ON pr.version = a.version AND pr.case_id = a.case_id AND pr.pair = a.onset
  UNION ALL SELECT version, case_id, 'REVIEW_SCOPE', 'UNSCORED_AMBIGUOUS', NULL, lo, NULL, hi, NULL, NULL, lo || '-' || hi || ': ' || reasons FROM co, vs)"""

COUNTS = """SELECT version, case_id, COUNT(d.kind) FILTER (kind = 'REVIEWED_RESET' AND reviewed_onset IS NOT NULL) AS reviewed_scored_resets, COUNT(*) FILTER (kind = 'REVIEWED_RESET' AND classification = 'MATCH') AS matched_resets,
 COUNT(*) FILTER (kind = 'REVIEWED_RESET' AND classification = 'EARLY_SPLIT') AS early_splits, COUNT(*) FILTER (kind = 'REVIEWED_RESET' AND classification = 'LATE_SPLIT') AS late_splits,
 COUNT(*) FILTER (kind = 'REVIEWED_RESET' AND classification = 'MISSED_RESET') AS missed_resets, COUNT(*) FILTER (kind = 'PREDICTED_WARNING' AND classification = 'EXTRA_RESET') AS extra_final_splits,
 COUNT(*) FILTER (kind = 'PREDICTED_WARNING') AS warning_count, COUNT(*) FILTER (resolution = 'CONFIRMED') AS predicted_confirmation_count, COUNT(*) FILTER (resolution = 'CANCELLED') AS predicted_cancellation_count,
 COUNT(*) FILTER (kind = 'PREDICTED_WARNING' AND resolution NOT IN ('CONFIRMED', 'CANCELLED')) AS terminated_before_pivot, COUNT(*) FILTER (classification = 'FALSE_WARNING_ONLY') AS warning_only_false_positives,
 COUNT(*) FILTER (classification = 'CORRECT_WARNING_CANCEL') AS correctly_cancelled_warnings, COUNT(*) FILTER (classification = 'HARD_BOUNDARY_MISMATCH') AS hard_boundary_mismatches,
 COUNT(*) FILTER (kind = 'PREDICTED_WARNING' AND classification = 'UNSCORED_AMBIGUOUS') AS unscored_warnings,
 CASE WHEN EXISTS (SELECT 1 FROM lg2 g WHERE g.case_id = pa.case_id AND boundary_type LIKE '%EXCLUDE') THEN 0 ELSE 1 END + (SELECT COUNT(*) FROM hd WHERE hd.case_id = pa.case_id AND resume IS NOT NULL)
  + COUNT(*) FILTER (resolution = 'CONFIRMED') AS predicted_episode_count, COUNT(*) FILTER (kind = 'REVIEW_SCOPE') > 0 AS unscored_ambiguous_case
 FROM pa CROSS JOIN vs LEFT JOIN details d USING (version, case_id) GROUP BY version, case_id"""
_B = (EV, RICH)


@query("rpl2_score_predictions", sql(f"{SCORE} SELECT * FROM details", *_B))
def rpl2(fx):
    return scored(fx, ruled(fx), VERSIONS)[0]


@query("rpl2_case_counts", sql(f"{SCORE} {COUNTS}", *_B))
def rpl2b(fx):
    details, par, led = scored(fx, ruled(fx), VERSIONS)
    return S.case_counts(details, par, led, VERSIONS)


@query("rpl2_replay_counts")
def rpl2c(fx):
    """The replay's own warnings, scored and counted per case."""
    found = replayed(fx, P.VERSIONS)
    details, par, led = scored(fx, found, P.VERSIONS)
    return S.case_counts(details, par, led, P.VERSIONS)


# --- excursions, readiness, recovery ---------------------------------------------------------

LABELS = ("CONTINUE", "RESET", "UNCERTAIN")
_EXM = ("peak", "retreat")
_LOCK = "CASE k % 11 WHEN 0 THEN NULL WHEN 1 THEN 'OPEN' WHEN 2 THEN 'PARTIAL_LOCK' ELSE 'LOCKED' END"
#: trusted actions of the whole case, and what the running peak of a span takes from each
TRUST = f"""tr AS (SELECT *, CASE WHEN pass_type IS NOT NULL THEN end_x ELSE GREATEST(start_x, end_x) END AS v, event_team_id = {OWN} AND event_type IN ('Pass', 'Carry') AND validated_anchor AND end_x IS NOT NULL
   AND NOT (event_type = 'Pass' AND pass_outcome IS NOT NULL) AS ok FROM em)"""
EXC = f"""{SCORE}, {TRUST},
 x0 AS (SELECT g.*, CASE WHEN onset IS NULL THEN 'unresolved_onset' ELSE 'exact' END AS precision, COALESCE(onset_lower, onset) AS lower FROM lg2 g WHERE boundary_type = 'CLEAR_RESET'),
 x1 AS (SELECT x0.*, (SELECT arg_max(episode_id, event_index) FROM em WHERE em.case_id = x0.case_id AND event_index < lower AND episode_id IS NOT NULL) AS ref,
   (SELECT arg_max(episode_id, event_index) FROM em WHERE em.case_id = x0.case_id AND event_index < onset AND episode_id IS NOT NULL) AS prior FROM x0),
 x2 AS (SELECT x1.*, (SELECT MIN(event_index) FROM em WHERE em.case_id = x1.case_id AND episode_id = ref) AS rs0, (SELECT BOOL_AND(state_valid) FROM em WHERE em.case_id = x1.case_id AND episode_id = prior) AS pv FROM x1),
 x3 AS (SELECT x2.*, c.end_x AS ce, c.t_us AS ct, COALESCE(c.ok, FALSE) AS cok, c.episode_id AS cep, o.end_x AS oe, o.v AS ov, o.t_us AS ot, COALESCE(o.ok, FALSE) AS ook,
   (SELECT MAX(v) FROM tr t WHERE ok AND t.case_id = x2.case_id AND t.event_index BETWEEN rs0 AND confirmation) AS up, (SELECT MAX(v) FROM tr t WHERE ok AND t.case_id = x2.case_id AND episode_id = prior AND t.event_index < onset) AS pb,
   (SELECT MAX(v) FROM tr t WHERE ok AND t.case_id = x2.case_id AND t.episode_id = c.episode_id AND t.event_index <= confirmation) AS cp,
   (SELECT COUNT(*) FROM ca WHERE ca.case_id = x2.case_id AND candidate_event = onset) AS os, (SELECT COUNT(*) FROM ca WHERE ca.case_id = x2.case_id AND candidate_event = confirmation) AS cs
   FROM x2 LEFT JOIN tr c ON c.case_id = x2.case_id AND c.event_index = confirmation LEFT JOIN tr o ON o.case_id = x2.case_id AND o.event_index = onset)"""


@query(
    "epi6_excursion_table",
    sql(
        f"""{EXC} SELECT case_id, boundary_id AS reset_excursion_id, onset AS onset_event, onset_lower, confirmation AS confirmation_event, last_reset_sample, precision AS onset_precision,
 CASE WHEN onset IS NULL THEN 'unresolved' ELSE 'encoded_at_review_candidate_resolution' END AS onset_status, os AS onset_samples, cs AS confirmation_samples,
 CASE WHEN cs > 0 AND cok AND cep IS NOT NULL THEN cp END AS confirmation_episode_peak, CASE WHEN cs > 0 AND cok AND cep IS NOT NULL THEN GREATEST(0, cp - ce) END AS confirmation_episode_retreat,
 CASE WHEN ref IS NOT NULL THEN 'counterfactual_no_reset_until_confirmation_not_calibration_ready' END AS confirmation_unsplit_reference_status,
 CASE WHEN ref IS NOT NULL AND cok THEN up END AS confirmation_unsplit_reference_peak, CASE WHEN ref IS NOT NULL AND cok THEN GREATEST(0, up - ce) END AS confirmation_unsplit_reference_retreat,
 CASE WHEN onset IS NOT NULL AND prior IS NOT NULL THEN ook AND pb IS NOT NULL AND pv END AS onset_pre_split_available,
 CASE WHEN ook AND pb IS NOT NULL AND pv THEN GREATEST(pb, ov) END AS onset_pre_split_peak, CASE WHEN ook AND pb IS NOT NULL AND pv THEN GREATEST(0, GREATEST(pb, ov) - oe) END AS onset_pre_split_retreat,
 CASE WHEN onset IS NOT NULL AND prior IS NOT NULL THEN CASE WHEN ook AND pb IS NOT NULL AND pv THEN 'censored_at_final_reset_split' ELSE 'unavailable_prior_observed_peak' END END AS onset_pre_split_recovery_status,
 prior AS onset_reference_episode_id, CASE WHEN prior IS NOT NULL AND ook THEN pb END AS onset_prior_established_peak_x, CASE WHEN prior IS NOT NULL THEN (ct - ot) / 1e6 END AS onset_time_to_confirmation FROM x3""",
        *_B,
    ),
)
def epi6b(fx):
    lane = case_lane(fx, "case_id")
    m = durable(members(fx))
    led = reviewed(fx).withColumn("precision", F.when(F.col("onset").isNull(), "unresolved_onset").otherwise("exact"))
    own = P.episode_progression(m, case_lane(fx, "case_id", "episode_id"))
    return X.excursion_table(m, own, led, samples(fx), lane, _EXM)


READY = f"""{EPM}, sa AS (SELECT em.case_id, em.event_id, em.episode_id, em.state_valid, CASE WHEN em.k % 3 = 0 THEN 'CONTINUE' ELSE 'RESET' END AS human_label, {_LOCK.replace('k %', 'em.k %')} AS lock_status, em.pass_type IS NOT NULL AND em.k % 5 = 0 AS opening_restart,
   em.k % 9 = 4 AS relocation_affected, r2.retreat, CASE WHEN r2.retreat > 0 THEN (nt - r2.t_us) / 1e6 END AS seconds, CASE WHEN r2.retreat = 0 THEN 'not_applicable_at_peak' WHEN nt IS NOT NULL THEN 'observed_equal_or_higher_peak' WHEN r2.event_id IS NOT NULL THEN 'censored_at_episode_observation_end' END AS how
   FROM em LEFT JOIN r2 ON r2.event_id = em.event_id WHERE em.k % 2 = 0),
 sr AS (SELECT *, concat_ws(';', CASE WHEN NOT COALESCE(human_label IN ('CONTINUE', 'RESET', 'UNCERTAIN') AND lock_status IN ('LOCKED', 'PARTIAL_LOCK'), FALSE) THEN 'no_locked_reset_review_label' END,
   CASE WHEN episode_id IS NULL THEN 'no_reviewed_episode_membership' END, CASE WHEN episode_id IS NOT NULL AND NOT COALESCE(state_valid, FALSE) THEN 'unresolved_episode_start_or_partial_case_structure' END,
   CASE WHEN retreat IS NULL THEN 'no_trusted_current_progression_measurement' END, CASE WHEN opening_restart THEN 'opening_restart_not_reset_evidence' END, CASE WHEN relocation_affected THEN 'drawdown_includes_contest_relocation' END) AS exclusion_reason FROM sa)"""


def ready(fx):
    m = durable(members(fx))
    own = P.episode_progression(m, case_lane(fx, "case_id", "episode_id")).select("event_id", "retreat", "seconds_to_recovery", "recovery_status")
    s = m.where("k % 2 = 0").selectExpr(
        "case_id", "event_id", "episode_id", "state_valid", "CASE WHEN k % 3 = 0 THEN 'CONTINUE' ELSE 'RESET' END AS human_label", f"{_LOCK} AS lock_status",
        "pass_type IS NOT NULL AND k % 5 = 0 AS opening_restart", "k % 9 = 4 AS relocation_affected",
    )
    return X.sample_readiness(s.join(own, "event_id", "left"), LABELS)


@query("epi4_sample_readiness", sql(f"{READY} SELECT event_id, human_label, lock_status, exclusion_reason, exclusion_reason = '' AS ready FROM sr", *_B))
def epi4b(fx):
    return ready(fx).select("event_id", "human_label", "lock_status", "exclusion_reason", "ready")


@query(
    "epi6_recovery_summary",
    sql(
        f"""{READY} SELECT l.human_label, COUNT(sr.event_id) AS candidate_count, COUNT(seconds) AS observed_time_count, COUNT(sr.event_id) - COUNT(seconds) AS missing_time_count, ROUND(AVG(seconds), 6) AS conditional_mean_recovery_seconds,
 ROUND(MEDIAN(seconds), 6) AS conditional_median_recovery_seconds, COUNT(*) FILTER (how = 'censored_at_episode_observation_end') AS censored_count, COUNT(*) FILTER (how = 'not_applicable_at_peak') AS at_peak_count
 FROM (VALUES {', '.join(f"('{x}')" for x in LABELS)}) l(human_label) LEFT JOIN sr ON sr.human_label = l.human_label AND exclusion_reason = '' GROUP BY l.human_label""",
        *_B,
    ),
)
def epi6c(fx):
    out = X.recovery_summary(ready(fx), LABELS, fx.small)
    return out.withColumns({c: F.round(c, 6) for c in ("conditional_mean_recovery_seconds", "conditional_median_recovery_seconds")})
