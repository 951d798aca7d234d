"""Audits by renamed and reordered batches, and folds over attempt logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions.hashing import audit_token

from .order import ranked, running

# Limits of an attempt log.
ATTEMPTS, INFRASTRUCTURE_FAILURES = 3, 3


def audit_map(episodes: DataFrame, secret: bytes, id_domain: str = "id-cycle", order_domain: str = "order") -> DataFrame:
    """(original_id, audit_id, audit_pos) of rows (episode_id, pos).

    By the first token each row takes its successor's id around the circle, so no row keeps its own
    unless it is alone; the second token shuffles the order, turned by one if that changes nothing.
    """
    if len(secret) < 16:
        raise ValueError("the secret has fewer than 16 bytes")
    held = episodes.select("episode_id", "pos")
    held = held.withColumn("id_token", audit_token(secret, id_domain, F.col("pos"), F.col("episode_id")))
    held = held.withColumn("order_token", audit_token(secret, order_domain, F.col("pos"), F.col("episode_id")))
    r = ranked(held, ["id_token", "pos"])
    n = r.count()
    onward = r.select(F.pmod(F.col("rank") - 1 + n, F.lit(max(n, 1))).alias("rank"), F.col("episode_id").alias("audit_id"))
    named = r.join(onward, "rank").select("episode_id", "pos", "audit_id", "order_token")
    placed = ranked(ranked(named, ["pos"], "place"), ["order_token", "pos"], "audit_pos")
    same = placed.filter(F.col("audit_pos") != F.col("place")).isEmpty()
    if same and n > 1:
        placed = placed.withColumn("audit_pos", F.pmod(F.col("audit_pos") - 1 + n, F.lit(n)))
    return placed.select(F.col("episode_id").alias("original_id"), "audit_id", "audit_pos")


def audit_mismatches(mapping: DataFrame, official: DataFrame, audit: DataFrame) -> DataFrame:
    """Decisions (episode_id, model_id) that differ between a batch and its renamed copy."""
    a = official.select(F.col("episode_id").alias("original_id"), F.col("model_id").alias("official_model"))
    b = audit.select(F.col("episode_id").alias("audit_id"), F.col("model_id").alias("audit_model"))
    return mapping.join(a, "original_id").join(b, "audit_id").filter("official_model <> audit_model").select("original_id", "audit_id", "official_model", "audit_model")


def numbered(log: DataFrame, key: str, order: list[str], counted: tuple[str, ...]) -> DataFrame:
    """Sequence and attempt number of every log row; an attempt number grows after rows of the counted kinds.  A log may span any number of tasks."""
    counts = F.when(F.col("kind").isin(*counted), 1).otherwise(0)
    held = running(log, [key], order, {"seq": F.lit(1), "attempt": counts})
    return held.withColumn("attempt", (F.col("attempt") - counts + 1).cast("bigint"))


def retry_outcomes(log: DataFrame, key: str) -> DataFrame:
    """Folds each log of (seq, kind, cleanup_pending) to the state in which its run stops.

    The first valid attempt is selected; a fairness violation disqualifies and is no attempt;
    infrastructure failures count apart and stop the run at the limit or when clean-up is pending; as
    many failed attempts as the limit give zero.  Whether a row stops its run depends on it and on the
    counts up to it alone, so running sums, which split over tasks, and the least stopping row of each
    key, which is aggregated before it is shuffled, are the fold.
    """
    kind, infra = F.col("kind"), F.col("kind") == "infrastructure_failure"
    counted = {"_attempts": F.when(kind.isin("valid", "execution_failure"), 1).otherwise(0), "_failures": F.when(infra, 1).otherwise(0)}
    held = running(log.select(key, "seq", "kind", "cleanup_pending"), [key], ["seq"], counted)
    stopped = infra & ((F.col("_failures") >= INFRASTRUCTURE_FAILURES) | F.col("cleanup_pending"))
    state = F.when(kind == "valid", "valid").when(kind == "fairness_violation", "disqualified").when(stopped, "infrastructure_unavailable")
    state = state.when(F.col("_attempts") >= ATTEMPTS, "tier_score_zero")
    stop = F.struct("seq", state.alias("state"), F.col("_attempts").alias("attempts"), F.col("_failures").alias("infrastructure"), F.when(kind == "valid", F.col("seq")).alias("selected"))
    found = held.groupBy(key).agg(F.min(F.when(state.isNotNull(), stop)).alias("s"), F.max("_attempts").alias("a"), F.max("_failures").alias("i"))
    return found.select(
        key, F.coalesce("s.state", F.lit("running")).alias("state"), F.coalesce("s.attempts", "a").alias("attempts"), F.coalesce("s.infrastructure", "i").alias("infrastructure"), F.col("s.selected").alias("selected_seq")
    )


def audit_status(invalid: Column, mismatches: Column, failures: Column) -> Column:
    """passed, review_required or inconclusive_infrastructure."""
    return F.when(failures >= INFRASTRUCTURE_FAILURES, "inconclusive_infrastructure").when(invalid | (mismatches > 0), "review_required").otherwise("passed")


def attempt_reason(kind: Column, cleanup_pending: Column, timed_out: Column, terminated: Column, code: Column) -> Column:
    """Reason code of a logged attempt; the codes are fixed values."""
    return (
        F.when(kind == "valid", "valid_submission").when(kind == "fairness_violation", "fairness_review_required").when(cleanup_pending, "operator_cleanup_pending")
        .when(kind == "infrastructure_failure", "operator_infrastructure_failure").when(timed_out, "wall_time_limit_exceeded").when(terminated, "operator_limit_terminated")
        .when(F.coalesce(code, F.lit(0)) != 0, "participant_nonzero_exit").otherwise("submission_validation_failure")
    )


def tier_status(retry: Column, audit: Column) -> Column:
    """The status of a tier from its retry state and audit status (null if there was no audit)."""
    failed = F.when(retry.isin("infrastructure_unavailable", "disqualified", "tier_score_zero"), retry)
    return (
        failed.when(audit == "review_required", "review_required").when(audit == "inconclusive_infrastructure", "audit_inconclusive_infrastructure")
        .when(audit.isNull(), "audit_skipped").otherwise("valid")
    )


# Exit code of each status.
EXIT_CODES = {"valid": 0, "tier_score_zero": 0, "disqualified": 0, "infrastructure_unavailable": 4, "audit_inconclusive_infrastructure": 4, "review_required": 5, "audit_skipped": 5}


def exit_code(status: Column) -> Column:
    return F.coalesce(*[F.when(status == s, F.lit(c)) for s, c in EXIT_CODES.items()])
