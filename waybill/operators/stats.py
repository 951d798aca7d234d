"""Latency and repetition statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions.exact import timer_round
from waybill.operators.order import medians, ranked

# Measured runs per tier, and the time in ns that a failed run counts.
RUNS, FAILED_NS = 5, 90_000_000_000


def settled(log: DataFrame) -> DataFrame:
    """Measured runs: failures take the limit, infrastructure failures are left out."""
    kept = log.filter("kind <> 'infrastructure_failure'")
    return kept.withColumn("elapsed_ns", F.when(F.col("kind") == "execution_failure", F.lit(FAILED_NS)).otherwise(F.col("elapsed_ns")))


def tier_medians(runs: DataFrame, runs_per_tier: int = RUNS) -> DataFrame:
    """Integer median of each submission and tier; groups without exactly that many non-negative runs give null."""
    held = medians(runs, ["submission_id", "tier"], "elapsed_ns")
    groups = runs.groupBy("submission_id", "tier").agg(F.count("*").alias("rows"))
    good = (F.col("rows") == runs_per_tier) & (F.col("n") == runs_per_tier) & (F.col("least") >= 0)
    return groups.join(held, ["submission_id", "tier"], "left").select("submission_id", "tier", F.when(good, F.col("low")).alias("median_ns"))


def ranking(totals: DataFrame, resolution: int) -> DataFrame:
    """Competition rank (1, 1, 3) of rows (submission_id, total_ns) by the time rounded to the timer's resolution."""
    held = totals.withColumn("comparison_ns", timer_round(F.col("total_ns"), F.lit(resolution).cast("bigint")))
    placed = ranked(held, ["comparison_ns", "submission_id"], "_place")
    first = placed.groupBy(F.col("comparison_ns").alias("_ns")).agg((F.min("_place") + 1).cast("bigint").alias("rank"))
    return placed.join(first, F.col("comparison_ns").eqNullSafe(F.col("_ns"))).select(*held.columns, "rank")


def rotated(candidates: DataFrame, turns: int) -> DataFrame:
    """The order of the candidates in every turn, each turn starting one later."""
    held = ranked(candidates, ["submission_id"], "_i")
    n = max(held.count(), 1)
    held = held.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    return held.withColumn("place", F.pmod(F.col("_i") - F.col("turn"), F.lit(n)).cast("bigint")).select("turn", "place", "submission_id")


def repetition_stats(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Least, middle and largest value; the middle of an even number is the mean of two."""
    held = medians(runs, keys, value).withColumn("median", (F.col("low") + F.col("high")) / 2)
    groups = runs.groupBy(*keys).agg(F.count("*").alias("rows"))
    same = [groups[k].eqNullSafe(held[k]) for k in keys]
    return groups.join(held, same, "left").select(*[groups[k] for k in keys], "least", "median", "most", F.col("rows").alias("n"))


def determinism(runs: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Whether all repetitions have the same digest."""
    return runs.groupBy(*keys).agg((F.count_distinct(digest) == 1).alias("deterministic"), F.count("*").alias("n"))
