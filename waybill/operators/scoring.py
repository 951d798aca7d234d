"""Exact cost, budget and quality of routing decisions.

Costs are integers of 10**-``places`` of the cost unit, as many places as the finest rate needs (nine
or more, so nano-units for rates with three decimals per million tokens); sums are exact and
independent of order.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.functions.exact import quotient


@dataclass(frozen=True)
class Rates:
    fixed: str
    input: str
    output: str


@dataclass(frozen=True)
class Policy:
    """Models in order, the light one first, and tiers with (budget multiplier, weight)."""

    models: dict[str, Rates]
    tiers: dict[str, tuple[str, str]]
    light: str
    token_unit: int = 1_000_000
    warning: str = "0.95"
    policy_id: str = "public"
    cost_unit: str = "credit"
    context_limit: int = 32768
    schema_version: int = 1


#: Public rates per million tokens, budget multipliers and weights.
PUBLIC = Policy(
    models={"light": Rates("0", "1", "4"), "middle": Rates("0", "2.127", "8.509"), "think": Rates("0", "6.565", "26.260")},
    tiers={"fast": ("1.25", "0.4"), "balanced": ("2.0", "0.3"), "premium": ("4.0", "0.3")},
    light="light",
)


#: Most decimal places of a cost; sums of 10**20 units then still fit 38 digits.
MOST_PLACES = 18


def nano(value: str, unit: int = 1, places: int = 9) -> int:
    """A rate per token in units of 10**-places; rates that are no whole number of them are rejected."""
    exact = Fraction(value) * 10**places / unit
    if exact.denominator != 1:
        raise ValueError(f"{value} per {unit} is no whole number of units of 10**-{places}")
    return int(exact)


def places(policy: Policy = PUBLIC) -> int:
    """Decimal places that hold all costs of a policy exactly."""
    rates = [Fraction(r.fixed) for r in policy.models.values()] + [Fraction(x) / policy.token_unit for r in policy.models.values() for x in (r.input, r.output)]
    for n in range(9, MOST_PLACES + 1):
        if all((r * 10**n).denominator == 1 for r in rates):
            return n
    raise ValueError(f"a rate needs more than {MOST_PLACES} decimal places")


def rates(spark: SparkSession, policy: Policy = PUBLIC) -> DataFrame:
    n = places(policy)
    rows = [(m, i, *(Decimal(nano(x, u, n)) for x, u in ((r.fixed, 1), (r.input, policy.token_unit), (r.output, policy.token_unit)))) for i, (m, r) in enumerate(policy.models.items())]
    held = spark.createDataFrame(rows, "model_id string, model_no int, fixed_nano decimal(38,0), input_nano decimal(38,0), output_nano decimal(38,0)")
    kind = "bigint" if n == 9 else "decimal(18,0)"
    return held.select("model_id", "model_no", *[F.col(c).cast(kind).alias(c) for c in ("fixed_nano", "input_nano", "output_nano")])


def tiers(spark: SparkSession, policy: Policy = PUBLIC) -> DataFrame:
    """Multipliers in 10**-15, weights and the warning limit in the same way, so comparisons are exact."""
    rows = [(t, int(Decimal(m) * 10**15), int(Decimal(w) * 10**6), int(Decimal(m) * Decimal(policy.warning) * 10**15)) for t, (m, w) in policy.tiers.items()]
    return spark.createDataFrame(rows, "tier string, multiplier_e15 bigint, weight_e6 bigint, warning_e15 bigint")


def costed(outcomes: DataFrame, rates: DataFrame) -> DataFrame:
    """Outcomes with the exact cost of each; the rates are a few rows."""
    cost = F.col("fixed_nano") + F.col("input_tokens") * F.col("input_nano") + F.col("output_tokens") * F.col("output_nano")
    return outcomes.join(F.broadcast(rates), "model_id").withColumn("cost_nano", cost.cast("decimal(24,0)"))


def by_episode(costed: DataFrame) -> DataFrame:
    """One row per episode with its outcomes, one for each model; one shuffle serves the decision and the baseline."""
    fields = ("model_id", "cost_nano", "score", "num_generations", "input_tokens", "output_tokens")
    return costed.groupBy("episode_id").agg(F.collect_list(F.struct(*fields)).alias("outcomes"))


def _of(model: Column) -> Column:
    return F.get(F.filter("outcomes", lambda o: o["model_id"] == model), F.lit(0))


def tier_totals(decisions: DataFrame, outcomes: DataFrame, policy: Policy = PUBLIC) -> DataFrame:
    """Sums of each tier over decisions (tier, episode_id, model_id); ``n_missing`` decisions lack an outcome, theirs or the light one."""
    spark = decisions.sparkSession
    held = by_episode(costed(outcomes, rates(spark, policy)))
    chosen = decisions.groupBy("episode_id").agg(F.collect_list(F.struct("tier", "model_id")).alias("chosen"))
    joined = chosen.join(held, "episode_id", "left").select(F.explode("chosen").alias("c"), "outcomes")
    joined = joined.select("c.tier", "c.model_id", "outcomes").select("tier", "model_id", _of(F.col("model_id")).alias("own"), _of(F.lit(policy.light)).alias("light"))
    return joined.groupBy("tier").agg(
        F.count("*").alias("n_episodes"),
        F.count_if(F.col("own").isNull() | F.col("light").isNull()).alias("n_missing"),
        F.sum("own.cost_nano").alias("total_nano"),
        F.sum("light.cost_nano").alias("light_nano"),
        F.sum("own.score").alias("quality"),
        F.sum("own.num_generations").alias("n_generations"),
        F.sum("own.input_tokens").alias("n_input"),
        F.sum("own.output_tokens").alias("n_output"),
        *[F.count_if(F.col("model_id") == m).alias(f"n_{m}") for m in policy.models],
    )


def tier_scores(decisions: DataFrame, outcomes: DataFrame, policy: Policy = PUBLIC) -> DataFrame:
    """The report of each tier: ratio and scores in 10**-12 rounded half to even, budget gate inclusive.

    quality is DECIMAL with the scale of ``score``; scores count thousandths of 10**-12 exactly before rounding.
    A tier with a missing outcome or a light cost of 0 has no result: its flags, ratio and scores are null.
    """
    t = tier_totals(decisions, outcomes, policy).join(F.broadcast(tiers(decisions.sparkSession, policy)), "tier")
    scale = F.lit(10**15).cast("decimal(16,0)")
    t = t.withColumn("complete", (F.col("n_missing") == 0) & (F.col("light_nano") > 0))
    for c in ("total_nano", "light_nano", "quality"):
        t = t.withColumn(c, F.when(F.col("complete"), F.col(c)))
    total, light = F.col("total_nano").cast("decimal(21,0)"), F.col("light_nano").cast("decimal(21,0)")
    e6 = (F.col("quality") * 1_000_000).cast("decimal(24,0)")
    t = t.withColumn("passed", total * scale <= light * F.col("multiplier_e15").cast("decimal(16,0)"))
    t = t.withColumn("near_budget", total * scale >= light * F.col("warning_e15").cast("decimal(16,0)"))
    t = t.withColumn("ratio_e12", quotient(total, light))
    t = t.withColumn("quality_e12", quotient(e6, F.col("n_episodes") * 1_000_000))
    t = t.withColumn("points_e6", F.when(F.col("passed"), e6).when(~F.col("passed"), F.lit(0).cast("decimal(24,0)")))
    return t.withColumn("score_e12", F.when(F.col("passed"), F.col("quality_e12")).when(~F.col("passed"), F.lit(0).cast("decimal(38,0)")))


def final_score(scores: DataFrame, policy: Policy = PUBLIC) -> DataFrame:
    """Weighted points of the tiers over the number of episodes, from exact points and not from rounded scores.

    Null unless there is one complete result for each tier, all over the same number of episodes.
    """
    weighted = F.sum((F.col("points_e6") * F.col("weight_e6")).cast("decimal(24,0)"))
    sizes = F.count_distinct("n_episodes").alias("sizes")
    held = scores.agg(weighted.alias("points_e12"), F.max("n_episodes").alias("n"), sizes, F.count("*").alias("n_tiers"), F.sort_array(F.collect_set("tier")).alias("tiers"), F.bool_and("complete").alias("complete"))
    good = F.col("complete") & (F.col("sizes") == 1) & (F.col("n_tiers") == len(policy.tiers)) & (F.col("tiers") == F.array(*map(F.lit, sorted(policy.tiers))))
    held = held.withColumn("points_e12", F.when(good, F.col("points_e12")))
    return held.select("points_e12", quotient(F.col("points_e12"), F.col("n") * F.lit(10**12).cast("decimal(13,0)")).alias("score_e12"), "n", "n_tiers")
