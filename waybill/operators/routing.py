"""Routers: fixed rules, budgeted groups, Lagrangian selection."""

from __future__ import annotations

import math
from decimal import Decimal, localcontext
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.functions.exact import quotient
from waybill.functions.text import complexity, priority, with_features
from waybill.sources.shared import written

from . import curve
from .scoring import PUBLIC, Policy

# Least complexity for an upgrade by tier; least priority by tier; safety ratios.
RULES = {"fast": 3, "balanced": 2}
LEAST_PRIORITY = {"fast": 5, "balanced": 2, "premium": 0}
BUDGET_SAFETY = "0.85"
FILL_SAFETY = 0.65


def constant_route(episodes: DataFrame, tiers: list[str], model: str) -> DataFrame:
    return episodes.select("episode_id", F.explode(F.array(*map(F.lit, tiers))).alias("tier"), F.lit(model).alias("model_id"))


def rule_route(episodes: DataFrame, light: str = "light", middle: str = "middle") -> DataFrame:
    """One decision per episode and tier from complexity; row-local, so it also runs on a stream."""
    held = with_features(episodes).withColumn("complexity", complexity())

    def choice(least: int) -> Column:
        return F.when((F.col("complexity") >= least) & ~F.col("long_context"), middle).otherwise(light)

    options = [F.struct(F.lit(t).alias("tier"), choice(n).alias("model_id")) for t, n in RULES.items()]
    options.append(F.struct(F.lit("premium").alias("tier"), F.lit(middle).alias("model_id")))
    return held.select("episode_id", F.inline(F.array(*options)))


def multipliers(policy: Policy = PUBLIC) -> dict[str, Decimal]:
    """The larger of the input and output rate against the light model's; needs a policy without fixed costs."""
    light = policy.models[policy.light]
    if any(Decimal(r.fixed) for r in policy.models.values()):
        raise ValueError("the policy has fixed costs")
    if min(Decimal(light.input), Decimal(light.output)) <= 0:
        raise ValueError("the light model's rates are not positive")
    return {m: max(Decimal(r.input) / Decimal(light.input), Decimal(r.output) / Decimal(light.output)) for m, r in policy.models.items()}


def exact_multiplier(policy: Policy, model: str) -> Fraction:
    light, r = policy.models[policy.light], policy.models[model]
    return max(Fraction(r.input) / Fraction(light.input), Fraction(r.output) / Fraction(light.output))


def multiplier_columns(rates: DataFrame, models: list[str], light: str) -> list[Column]:
    """The multiplier of each model, times 10**12 and half to even, of rows of exact rates <model>_input and <model>_output; null if a rate of the light model is not positive."""
    unit = lambda c: (rates[c] * 10_000).cast("decimal(24,0)")
    good = (rates[f"{light}_input"] > 0) & (rates[f"{light}_output"] > 0)
    each = lambda m: F.greatest(*[quotient(unit(f"{m}_{k}"), F.when(good, unit(f"{light}_{k}"))) for k in ("input", "output")])
    return [F.when(good, each(m)).cast("bigint").alias(m) for m in models]


def priority_groups(episodes: DataFrame) -> DataFrame:
    """Number of episodes and content weight of each priority."""
    held = with_features(episodes).withColumn("priority", priority())
    return held.groupBy("priority").agg(F.count("*").alias("n"), F.sum(F.greatest(F.lit(1), F.col("n_chars")).cast("bigint")).alias("weight"))


def budget_route(episodes: DataFrame, target: str = "middle", policy: Policy = PUBLIC) -> DataFrame:
    """Whole priority groups are upgraded, highest first, while the budget holds; a group that does not fit is skipped.

    The batch barrier sees one row per priority; costs are exact in parts of a character's light cost.
    """
    spark, up = episodes.sparkSession, multipliers(policy)
    if target not in up:
        raise ValueError(f"unknown model {target}")
    # one unit for all quotients: a common denominator of the multiplier's difference and the caps
    gap = exact_multiplier(policy, target) - exact_multiplier(policy, policy.light)
    limits = {t: Fraction(m) * Fraction(BUDGET_SAFETY) for t, (m, _) in policy.tiers.items()}
    unit = math.lcm(gap.denominator, *(x.denominator for x in limits.values()))
    if unit > 10**12:
        raise ValueError("the policy's rates have no common denominator up to 10**12")
    step = int(gap * unit)
    caps = [(t, int(limits[t] * unit), LEAST_PRIORITY[t]) for t, (m, _) in policy.tiers.items()]
    tiers = spark.createDataFrame(caps, "tier string, cap bigint, least int")
    held = with_features(episodes).withColumn("priority", priority()).select("episode_id", "priority", F.greatest(F.lit(1), F.col("n_chars")).cast("bigint").alias("weight"))
    held = written(held, "priorities")
    groups = held.groupBy("priority").agg(F.sum("weight").alias("weight"))
    all_groups = groups.agg(F.sum("weight").cast("decimal(30,0)").alias("total"), F.sort_array(F.collect_list(F.struct("priority", "weight")), asc=False).alias("groups"))

    def fold(acc: Column, g: Column) -> Column:
        delta = g["weight"].cast("decimal(30,0)") * step
        fits = (g["priority"] >= F.col("least")) & (delta > 0) & (acc["cost"] + delta <= F.col("total") * F.col("cap"))
        return F.when(fits, F.struct((acc["cost"] + delta).cast("decimal(38,0)").alias("cost"), F.concat(acc["taken"], F.array(g["priority"])).alias("taken"))).otherwise(acc)

    start = F.struct((F.col("total") * unit).cast("decimal(38,0)").alias("cost"), F.array().cast("array<int>").alias("taken"))
    taken = all_groups.crossJoin(F.broadcast(tiers)).select("tier", F.aggregate("groups", start, fold)["taken"].alias("taken"))
    return held.crossJoin(F.broadcast(taken)).select("episode_id", "tier", F.when(F.array_contains("taken", F.col("priority")), target).otherwise(policy.light).alias("model_id"))


def best_model(values: list[Column], names: list[str]) -> Column:
    """The name of the largest value; the earlier one on ties."""
    options = F.array(*[F.struct(v.alias("value"), F.lit(-i).alias("order"), F.lit(n).alias("model_id")) for i, (v, n) in enumerate(zip(values, names, strict=True))])
    return F.array_max(options)["model_id"]


def clamped_scores(scores: list[Column], log_costs: list[Column]) -> tuple[list[Column], list[Column]]:
    """Scores into [0, 1]; costs from clamped logs, each at least a hair above the cheaper model's."""
    scores = [F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)) for s in scores]
    costs = [F.exp(F.least(F.lit(50.0), F.greatest(F.lit(-50.0), c))) for c in log_costs]
    for i in range(1, len(costs)):
        costs[i] = F.greatest(costs[i], costs[i - 1] * (1.0 + 1e-12))
    return scores, costs


def penalised(models: list[str], penalty: float, light_total: float) -> Column:
    return best_model([F.col(f"score_{m}") - F.lit(penalty) * F.col(f"cost_{m}") / F.lit(light_total) for m in models], models)


def _cost_of(models: list[str], choice: Column) -> Column:
    return F.coalesce(*[F.when(choice == m, F.col(f"cost_{m}")) for m in models])


def total(predictions: DataFrame, *columns: Column) -> list[Decimal]:
    """Sums that do not depend on the order of the rows; 0 for an empty batch."""
    kind = curve.sum_type(predictions, columns)
    row = predictions.agg(*[F.sum(curve.exact(c, kind)).cast(kind) for c in columns]).first()
    return [x if x is not None else Decimal(0) for x in row]


def cap_of(light: Decimal, multiplier: float, safety: float) -> Decimal:
    with localcontext(prec=curve.DIGITS):
        return light * max(Decimal(1), Decimal(repr(float(multiplier))) * Decimal(repr(float(safety))))


def penalties(predictions: DataFrame, models: list[str], budgets: dict[str, tuple[float, float]], sums: dict[str, list[Column]] | None = None) -> tuple[Decimal, dict[str, dict]]:
    """The light total, and for each budget (multiplier, safety) the least penalty ``at`` that fits, with the batch's sums under it."""
    (light,) = total(predictions, F.col(f"cost_{models[0]}"))
    if not light:
        return light, {}
    values = {"cost": [F.col(f"cost_{m}") for m in models], **(sums or {})}
    kind = curve.sum_type(predictions, [c for v in values.values() for c in v])
    steps = curve.Curve(curve.chosen_steps(predictions, models, float(light), values, kind), list(values), kind)
    return light, steps.first_fitting({k: cap_of(light, m, s) for k, (m, s) in budgets.items()})


def lagrangian_route(predictions: DataFrame, models: list[str], multiplier: float, safety: float) -> DataFrame:
    """One model per row of score_<model> and cost_<model>, best score less penalised cost, within a budget of the batch.

    Adds model_id; costs grow from model to model.  The penalty is the least that fits; all rows take
    the first model if none does.
    """
    light, found = penalties(predictions, models, {"b": (multiplier, safety)})
    return predictions.withColumn("model_id", curve.choice(models, float(light), found["b"]["at"]) if found else F.lit(models[0]))


def filled_route(routed: DataFrame, models: list[str], multiplier: float, safety: float = FILL_SAFETY) -> DataFrame:
    """Rows at the first model move to the second while the gain exceeds the penalised cost and the budget holds."""
    if not 0 < safety <= 1:
        raise ValueError("the safety ratio is not in (0, 1]")
    first, second = models[0], models[1]
    light, now = total(routed, F.col(f"cost_{first}"), _cost_of(models, F.col("model_id")))
    if not light:
        return routed
    more = F.col(f"cost_{second}") - F.col(f"cost_{first}")
    gain = F.col(f"score_{second}") - F.col(f"score_{first}")
    # a move that costs nothing is worth any penalty if it gains, and none if it does not
    until = F.when(more > 0, gain * F.lit(float(light)) / more).when(gain > 0, F.lit(curve.FOREVER)).otherwise(F.lit(0.0))
    kind = curve.sum_type(routed, [F.col(f"cost_{m}") for m in models])
    movable = (F.col("model_id") == first) & (until > 0)
    entries = F.array(F.struct(F.lit(0.0).alias("at"), curve.exact(more, kind).alias("cost")), F.struct(until.alias("at"), curve.exact(-more, kind).alias("cost")))
    steps = routed.filter(movable).select(F.inline(entries)).unionByName(routed.sparkSession.createDataFrame([(0.0, now)], f"at double, cost {kind}"))
    found = curve.Curve(steps, ["cost"], kind).first_fitting({"b": max(now, cap_of(light, multiplier, safety))})
    return routed.withColumn("model_id", F.when(movable & (until > F.lit(found["b"]["at"])), second).otherwise(F.col("model_id")))


def first_in_order(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group; grids and candidates, so groups are small."""
    return frame.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
