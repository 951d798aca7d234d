"""Constraint checks: every rule is a query that returns the violating rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.functions.exact import is_decimal

from .order import ranked

# Wire grammars.
SHA256 = r"\A[0-9a-f]{64}\z"
COMMIT = r"\A[0-9a-f]{40}\z"
DIGEST = r"\Asha256:[0-9a-f]{64}\z"
ROLES = ("system", "user", "assistant")


class Violation(ValueError):
    """Raised by ``require`` with the first violating rows."""


def require(violations: DataFrame, rule: str, show: int = 5) -> None:
    found = violations.limit(show).collect()
    if found:
        raise Violation(f"{rule}: {[r.asDict() for r in found]}")


def duplicates(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return frame.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def unsorted(frame: DataFrame, value: str, position: str) -> DataFrame:
    """Rows whose value is not above that of the row before, by position; neighbours meet by a join on the rank."""
    r = ranked(frame.select(position, value), [position])
    before = r.select((F.col("rank") + 1).alias("rank"), F.col(value).alias("previous"))
    return r.join(before, "rank").filter(F.col("previous") >= F.col(value)).select(position, "previous", value)


def missing(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected keys that are not there; swap the arguments for extra keys."""
    return expected.select(*keys).distinct().join(actual.select(*keys), list(keys), "left_anti")


def matrix_gaps(episodes: DataFrame, models: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Pairs of episode and model without an outcome, and outcomes outside the matrix; models are a few rows."""
    full = episodes.select("episode_id").crossJoin(F.broadcast(models.select("model_id")))
    keys = ["episode_id", "model_id"]
    gone = missing(full, outcomes, keys).withColumn("problem", F.lit("missing"))
    return gone.unionByName(missing(outcomes, full, keys).withColumn("problem", F.lit("extra")))


def coverage(episodes: DataFrame, decisions: DataFrame) -> DataFrame:
    gone = missing(episodes, decisions, ["episode_id"]).withColumn("problem", F.lit("missing"))
    return gone.unionByName(missing(decisions, episodes, ["episode_id"]).withColumn("problem", F.lit("extra")))


def not_exactly_one(frame: DataFrame, a: str, b: str) -> DataFrame:
    return frame.filter(F.col(a).isNotNull() == F.col(b).isNotNull())


def outside(frame: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    return frame.filter(F.col(column).isNull() | ~F.col(column).isin(*allowed))


def bad_decimals(frame: DataFrame, column: str, low: str | None = None, high: str | None = None) -> DataFrame:
    """Rows whose text is no exact decimal, or out of bounds."""
    x, good = F.col(column).try_cast("decimal(38,30)"), is_decimal(F.col(column))
    if low is not None:
        good &= F.coalesce(x >= F.lit(low).cast("decimal(38,30)"), F.lit(True))
    if high is not None:
        good &= F.coalesce(x <= F.lit(high).cast("decimal(38,30)"), F.lit(False))
    return frame.filter(~good)


def bad_pattern(frame: DataFrame, column: str, pattern: str) -> DataFrame:
    return frame.filter(~F.coalesce(F.regexp_like(F.col(column), F.lit(pattern)), F.lit(False)))


def key_sets(keys: Column, required: Sequence[str], optional: Sequence[str] = ()) -> tuple[Column, Column]:
    """Sorted missing and extra keys of an array of keys."""
    need, known = F.array(*map(F.lit, required)), F.array(*map(F.lit, [*required, *optional]))
    return F.array_sort(F.array_except(need, keys)), F.array_sort(F.array_except(keys, known))


def differing_headers(headers: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Header columns with more than one value over all documents."""
    sets = headers.agg(*[F.collect_set(c).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.array_sort(F.transform(c, lambda v: v.cast("string"))).alias("found")) for c in columns])
    return sets.select(F.inline(rows)).filter(F.size("found") != 1)


def tier_problems(submissions: DataFrame, tiers: Sequence[str]) -> DataFrame:
    """Tiers without exactly one submission, known or not."""
    spark = submissions.sparkSession
    known = spark.createDataFrame([(t,) for t in tiers], "tier string")
    count = submissions.groupBy("tier").agg(F.count("*").alias("n"))
    held = known.withColumn("known", F.lit(True)).join(count, "tier", "full")
    return held.filter(F.col("known").isNull() | (F.coalesce("n", F.lit(0)) != 1)).select("tier", F.coalesce("n", F.lit(0)).alias("n"))


def wrong_count(frame: DataFrame, expected: int) -> DataFrame:
    return frame.agg(F.count("*").alias("n")).filter(F.col("n") != expected)


def unsafe_paths(frame: DataFrame, column: str) -> DataFrame:
    """Paths that are absolute, climb with ``..``, or have no part besides empty ones and ``.``."""
    path = F.col(column)
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    return frame.filter(F.coalesce(F.startswith(path, F.lit("/")) | (F.size(parts) == 0) | F.array_contains(parts, ".."), F.lit(True)))


def unsafe_urls(frame: DataFrame, column: str) -> DataFrame:
    """URLs that are not absolute https URLs with a host."""
    return frame.filter(~F.coalesce(F.regexp_like(F.col(column), F.lit(r"\A(?i:https)://[^/?#]+")), F.lit(False)))


# Parts of image references.
NAMED_IMAGE = r"\A(.+)@sha256:[0-9a-f]{64}\z"
REPOSITORY_PART = r"\A[a-z0-9]+(?:(?:[._]|__|[-]+)[a-z0-9]+)*\z"
REGISTRY = r"\A(?:localhost|[a-z0-9]+(?:[.-][a-z0-9]+)*)(?::[0-9]+)?\z"
LONGEST_IMAGE = 336


def bad_images(frame: DataFrame, column: str) -> DataFrame:
    """Image references that are neither a local image id nor registry/repository@sha256:digest."""
    image = F.col(column)
    parts = F.split(F.regexp_extract(image, NAMED_IMAGE, 1), "/")
    head = F.get(parts, F.lit(0))
    has_registry = (F.size(parts) > 1) & (F.contains(head, F.lit(".")) | F.contains(head, F.lit(":")) | (head == "localhost"))
    names = F.when(has_registry, F.slice(parts, 2, F.size(parts))).otherwise(parts)
    named = F.regexp_like(image, F.lit(NAMED_IMAGE)) & (F.length(image) <= LONGEST_IMAGE) & (~has_registry | F.regexp_like(head, F.lit(REGISTRY)))
    named &= F.forall(names, lambda p: F.regexp_like(p, F.lit(REPOSITORY_PART)))
    return frame.filter(~F.coalesce(named | F.regexp_like(image, F.lit(DIGEST)), F.lit(False)))


def nonzero_events(frame: DataFrame, column: str) -> DataFrame:
    """Rows with a counter map that has a value other than zero."""
    return frame.filter(~F.coalesce(F.forall(F.map_values(column), lambda v: v == 0), F.lit(False)))


def rule_violations(frame: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row for each row and named rule that does not hold; rules come from a table of expressions."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return frame.withColumn("rule", F.explode(failed))


def latest(frame: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key, as a map load with repeated keys would keep it."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return frame.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
