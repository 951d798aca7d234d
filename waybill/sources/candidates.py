"""Submissions with equal scores, and the report of their measured latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.operators import stats

from .documents import failed

# Wire form and grammars of the candidates, runs before and in a measurement.
CANDIDATES = "struct<schema_version: int, candidates: array<struct<submission_id: string, commit_sha: string, image: string, image_size_evidence: string>>>"
CANDIDATE_KEYS = ("commit_sha", "image", "image_size_evidence", "submission_id")
SUBMISSION_ID, COMMIT = r"\A[A-Za-z0-9][A-Za-z0-9._-]{0,127}\z", r"\A(?:[0-9a-f]{40}|[0-9a-f]{64})\z"
MOST_BYTES, WARM_UPS = 1 << 20, 1


def candidate_problems(docs: DataFrame) -> DataFrame:
    """(path, rule) of candidate documents (path, text): size, keys, types, two candidates or more, ids, commits."""
    v = docs.withColumn("v", F.try_parse_json("text"))
    bad = v.filter("v IS NULL").select("path", F.lit("json").alias("rule"))
    each = F.try_variant_get("v", "$.candidates", "array<variant>")
    version = F.try_variant_get("v", "$.schema_version", "variant")
    rows = F.from_json("text", CANDIDATES)["candidates"]
    ids = F.transform(rows, lambda r: r["submission_id"])
    rules = {
        "bytes": F.octet_length("text") <= MOST_BYTES, "keys": F.array_sort(F.json_object_keys("text")) == F.array(F.lit("candidates"), F.lit("schema_version")),
        "schema_version": (F.schema_of_variant(version) == "BIGINT") & (version.cast("string") == "1"), "candidate_keys": F.forall(each, lambda e: F.array_sort(F.json_object_keys(F.to_json(e))) == F.array(*map(F.lit, CANDIDATE_KEYS))),
        "count": F.size(each) >= 2, "unique": F.size(F.array_distinct(ids)) == F.size(ids), "submission_id": F.forall(ids, lambda i: F.regexp_like(i, F.lit(SUBMISSION_ID))),
        "commit_sha": F.forall(rows, lambda r: F.regexp_like(r["commit_sha"], F.lit(COMMIT))),
    }
    return bad.unionByName(v.filter("v IS NOT NULL").select("path", F.explode(failed(rules)).alias("rule")))


def candidates(docs: DataFrame) -> DataFrame:
    """(path, submission_id, commit_sha, image, image_size_evidence) of candidate documents."""
    return docs.select("path", F.explode(F.from_json("text", CANDIDATES)["candidates"]).alias("c")).select("path", "c.*")


def latency_report(candidates: DataFrame, log: DataFrame, resolution: int, tiers: list[str]) -> DataFrame:
    """One row for each candidate: medians by tier, discarded runs, total, comparison time, rank.

    log: (submission_id, tier, kind, elapsed_ns).  Infrastructure failures are counted and left out,
    failed runs count as the time limit; a candidate without five good runs in every tier has no rank.
    """
    medians = stats.tier_medians(stats.settled(log))
    gone = log.groupBy("submission_id", "tier").agg(F.count_if(F.col("kind") == "infrastructure_failure").alias("n"))
    by_tier = gone.join(medians, ["submission_id", "tier"], "left").groupBy("submission_id").agg(
        *[F.max(F.when(F.col("tier") == t, F.col("median_ns"))).alias(f"{t}_ns") for t in tiers], F.sum("n").cast("bigint").alias("discarded")
    )
    total = sum((F.col(f"{t}_ns") for t in tiers[1:]), F.col(f"{tiers[0]}_ns"))
    held = candidates.join(by_tier, "submission_id", "left").withColumn("total_ns", total).withColumn("discarded", F.coalesce("discarded", F.lit(0).cast("bigint")))
    placed = stats.ranking(held.filter("total_ns IS NOT NULL").select("submission_id", "total_ns"), resolution).drop("total_ns")
    return held.join(placed, "submission_id", "left")
