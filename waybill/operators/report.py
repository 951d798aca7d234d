"""Scored reports with their guards, and the canonical form of a policy."""

from __future__ import annotations

import hashlib
import json
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions.exact import decimal_text, scaled_text
from waybill.sources.shared import written

from . import checks, scoring
from .scoring import PUBLIC, Policy

# Names and constants of the reports.
TIER_REPORT, FINAL_REPORT = "prompt-only-routing-tier-score", "prompt-only-routing-final-score"
DECIMAL_PLACES, ROUNDING = 12, "ROUND_HALF_EVEN"
HEADER = ("schema_version", "challenge_id", "split")


def plain(value: str) -> str:
    """A decimal in fixed notation without trailing zeros."""
    x = Decimal(value)
    text = format(x, "f")
    return "0" if x == 0 else text.rstrip("0").rstrip(".") if "." in text else text


def policy_document(policy: Policy = PUBLIC) -> dict:
    """The canonical form of a policy: all fields, defaults written out, numbers as plain decimals."""
    return {
        "schema_version": policy.schema_version, "policy_id": policy.policy_id, "cost_unit": policy.cost_unit, "token_unit": policy.token_unit, "context_limit_tokens": policy.context_limit, "light_model_id": policy.light,
        "models": {m: {"fixed_cost": plain(r.fixed), "input_token_rate": plain(r.input), "output_token_rate": plain(r.output)} for m, r in policy.models.items()},
        "tiers": {t: {"budget_multiplier": plain(m), "weight": plain(w)} for t, (m, w) in policy.tiers.items()}, "budget_warning_ratio": plain(policy.warning),
    }


def policy_sha256(policy: Policy = PUBLIC) -> str:
    text = json.dumps(policy_document(policy), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def policy_texts(policies: DataFrame, policy: Policy = PUBLIC) -> Column:
    """The canonical text of the policy of each row: ``policy`` with the row's policy_id and exact rates <model>_input and <model>_output."""
    d = policy_document(policy)
    lit = lambda x: F.struct(*[lit(v).alias(k) for k, v in sorted(x.items())]) if isinstance(x, dict) else F.lit(x)

    def model(m: str) -> Column:
        return F.struct(F.lit(d["models"][m]["fixed_cost"]).alias("fixed_cost"), *[decimal_text(policies[f"{m}_{k}"]).alias(f"{k}_token_rate") for k in ("input", "output")])

    fields = {k: lit(v) for k, v in d.items()} | {"policy_id": policies["policy_id"], "models": F.struct(*[model(m).alias(m) for m in sorted(d["models"])])}
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def header_mismatches(headers: DataFrame, policy: Policy = PUBLIC) -> DataFrame:
    """(columns of headers, field) for every field that differs among the structs inputs, outcomes and submission of a row; ``wanted``: the tier that the submission must be for, or null."""
    h = F.col
    rules = {"policy.schema_version": h("inputs.schema_version") == policy.schema_version}
    rules |= {f"{kind}.{k}": h(f"{kind}.{k}").eqNullSafe(h(f"inputs.{k}")) for kind in ("outcomes", "submission") for k in HEADER}
    rules |= {"submission.policy_id": h("submission.policy_id").eqNullSafe(F.lit(policy.policy_id)), "submission.tier": h("wanted").isNull() | h("submission.tier").eqNullSafe(h("wanted"))}
    return checks.rule_violations(headers, rules).withColumnRenamed("rule", "field")


def header_problems(inputs: dict, outcomes: dict, submissions: list[dict], policy: Policy = PUBLIC, tier: str | None = None) -> list[str]:
    """Fields of a few one-row headers that differ; with ``tier`` the submissions must be for it."""
    found = [] if inputs["schema_version"] == policy.schema_version else ["policy.schema_version"]
    found += [f"outcomes.{k}" for k in HEADER if outcomes[k] != inputs[k]]
    for s in submissions:
        found += [f"submission.{k}" for k in HEADER if s[k] != inputs[k]]
        found += ["submission.policy_id"] * (s["policy_id"] != policy.policy_id) + ["submission.tier"] * (tier is not None and s["tier"] != tier)
    return found


def guarded(episodes: DataFrame, outcomes: DataFrame, decisions: DataFrame, policy: Policy = PUBLIC, headers: tuple[dict, dict, list[dict]] | None = None) -> DataFrame:
    """Raises unless there is one submission for each tier that covers all episodes once, and a whole outcome matrix.

    headers: those of the input, the outcomes and the submissions, which then must agree with each other and with the policy.
    Returns the decisions, written once, so that what is scored is what was checked.
    """
    if headers is not None and (found := header_problems(*headers, policy)):
        raise checks.Violation(f"the headers agree: {sorted(set(found))}")
    spark = episodes.sparkSession
    decisions, outcomes = written(decisions, "decisions"), written(outcomes.select("episode_id", "model_id"), "pairs")
    models = spark.createDataFrame([(m,) for m in policy.models], "model_id string")
    tiers = spark.createDataFrame([(t,) for t in policy.tiers], "tier string")
    checks.require(checks.tier_problems(decisions.select("tier").distinct(), list(policy.tiers)), "one submission for each tier")
    checks.require(checks.matrix_gaps(episodes, models, outcomes), "the outcome matrix is complete")
    wanted = episodes.select("episode_id").crossJoin(F.broadcast(tiers))
    keys = ["episode_id", "tier"]
    checks.require(checks.missing(wanted, decisions, keys).unionByName(checks.missing(decisions, wanted, keys)), "decisions cover the episodes")
    checks.require(checks.duplicates(decisions, keys), "one decision for each episode")
    checks.require(checks.duplicates(outcomes, ["episode_id", "model_id"]), "one outcome for each episode and model")
    return decisions


def tier_reports(decisions: DataFrame, outcomes: DataFrame, header: dict, policy: Policy = PUBLIC, scores: DataFrame | None = None) -> DataFrame:
    """The report of each tier in 28 fields; numbers that must be exact are text.  scores: the tiers' scores, if they are at hand."""
    n = scoring.places(policy)
    t = scoring.tier_scores(decisions, outcomes, policy) if scores is None else scores
    text = [F.struct(F.lit(k).alias("tier"), F.lit(plain(m)).alias("multiplier")) for k, (m, _) in policy.tiers.items()]
    t = t.withColumn("multiplier", F.filter(F.array(*text), lambda x: x["tier"] == F.col("tier"))[0]["multiplier"])
    limit = F.col("light_nano").cast("decimal(22,0)") * F.col("multiplier_e15").cast("decimal(16,0)")

    def whole(c: str) -> Column:
        return F.col(c).cast("bigint").alias(c)

    t = t.withColumnsRenamed({"n_episodes": "num_episodes", "n_generations": "selected_generations", "n_input": "selected_input_tokens", "n_output": "selected_output_tokens"})
    counts = F.struct(*[F.col(f"n_{m}").cast("bigint").alias(m) for m in policy.models])
    return t.select(
        F.lit(header["schema_version"]).cast("bigint").alias("schema_version"), F.lit(TIER_REPORT).alias("report_type"), F.lit(header["challenge_id"]).alias("challenge_id"), F.lit(policy.policy_id).alias("policy_id"),
        F.lit(policy_sha256(policy)).alias("policy_sha256"), F.lit(header["split"]).alias("split"), "tier", whole("num_episodes"), counts.alias("model_counts"), whole("selected_generations"), whole("selected_input_tokens"),
        whole("selected_output_tokens"), F.lit(policy.cost_unit).alias("cost_unit"), F.lit(policy.token_unit).cast("bigint").alias("token_unit"), scaled_text(F.col("light_nano"), n).alias("light_baseline_cost"),
        F.col("multiplier").alias("budget_multiplier"), scaled_text(limit, n + 15).alias("budget_limit"), scaled_text(F.col("total_nano"), n).alias("total_cost"), scaled_text(F.col("ratio_e12")).alias("budget_ratio"),
        F.col("passed").alias("budget_passed"), "near_budget", F.lit(DECIMAL_PLACES).cast("bigint").alias("score_decimal_places"), F.lit(ROUNDING).alias("score_rounding"),
        scaled_text((F.col("quality") * 1_000_000).cast("decimal(24,0)"), 6).alias("quality_points_total"), scaled_text(F.col("quality_e12")).alias("quality_score"), scaled_text(F.col("points_e6"), 6).alias("tier_points_total"),
        scaled_text(F.col("score_e12")).alias("tier_score"), (~F.col("passed")).alias("over_budget_zero_applied"),
    )


def final_report(decisions: DataFrame, outcomes: DataFrame, header: dict, policy: Policy = PUBLIC) -> DataFrame:
    """The report over all tiers, with the tier reports inside; a few rows."""
    scores = written(scoring.tier_scores(decisions, outcomes, policy), "scores")
    final = scoring.final_score(scores, policy)
    tiers = tier_reports(decisions, outcomes, header, policy, scores).agg(F.array_sort(F.collect_list(F.struct("tier", F.struct("*").alias("report")))).alias("tiers"))
    weights = F.struct(*[F.lit(plain(policy.tiers[t][1])).alias(t) for t in sorted(policy.tiers)])
    return final.crossJoin(tiers).select(
        F.lit(header["schema_version"]).cast("bigint").alias("schema_version"), F.lit(FINAL_REPORT).alias("report_type"), F.lit(header["challenge_id"]).alias("challenge_id"), F.lit(policy.policy_id).alias("policy_id"),
        F.lit(policy_sha256(policy)).alias("policy_sha256"), F.lit(header["split"]).alias("split"), F.map_from_entries("tiers").alias("tiers"), weights.alias("tier_weights"), F.lit(DECIMAL_PLACES).cast("bigint").alias("score_decimal_places"),
        F.lit(ROUNDING).alias("score_rounding"), scaled_text(F.col("points_e12")).alias("final_weighted_points_total"), scaled_text(F.col("score_e12")).alias("final_score"),
    )


def one_tier(decisions: DataFrame, outcomes: DataFrame, header: dict, tier: str, policy: Policy = PUBLIC) -> DataFrame:
    """The report of one tier alone; the other tiers don't bear on it."""
    return tier_reports(decisions.filter(F.col("tier") == tier), outcomes, header, policy)
