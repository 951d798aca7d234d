"""The learned router: linear heads over hashed features, trained out of fold, with its document form."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.sources.shared import written

from . import checks, curve, learn, report, routing, scoring

# The document's kind and versions, names of the dense features, hash scheme.
HASH = "fnv1a64-signed-word-1-2"
VERSION = 1
DENSE_NAMES = ("log_character_count", "log_word_count", "log_sentence_count", "log_message_count", "hangul_ratio", "log_code_marker_count", "log_math_marker_count", "numeric_density", "long_context", "log_reasoning_marker_count", "formal_reasoning", "program_analysis", "log_multi_constraint_count", "simple_transform")
DENSE = len(DENSE_NAMES)
KEYS = (
    "artifact_type", "schema_version", "feature_version", "hash_algorithm", "hash_bins", "dense_feature_names", "model_ids", "policy_id", "policy_sha256",
    "feature_mean", "feature_scale", "score_heads", "log_cost_heads", "tier_safety_ratios", "training_summary",
)
KIND = "waybill-linear-router"


@dataclass(frozen=True)
class Router:
    """Heads: one column of coefficients for the score of each model, then one for each log cost."""

    bins: int
    models: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    coefficients: np.ndarray
    intercepts: np.ndarray
    safety: dict[str, float]
    policy_sha256: str
    summary: dict
    policy_id: str = scoring.PUBLIC.policy_id

    def document(self) -> dict:
        m = len(self.models)

        def head(k: int) -> dict:
            return {"intercept": float(self.intercepts[k]), "coefficients": [float(c) for c in self.coefficients[:, k]]}

        return {
            "artifact_type": KIND, "schema_version": VERSION, "feature_version": VERSION, "hash_algorithm": HASH, "hash_bins": self.bins, "dense_feature_names": list(DENSE_NAMES), "model_ids": list(self.models),
            "policy_id": self.policy_id, "policy_sha256": self.policy_sha256, "feature_mean": [float(x) for x in self.mean], "feature_scale": [float(x) for x in self.scale],
            "score_heads": {x: head(i) for i, x in enumerate(self.models)}, "log_cost_heads": {x: head(m + i) for i, x in enumerate(self.models)},
            "tier_safety_ratios": dict(self.safety), "training_summary": dict(self.summary),
        }


def parsed(document: dict, tiers: tuple[str, ...]) -> Router:
    """A router from its document; unknown or missing keys, wrong lengths and numbers that are not finite are errors."""

    def need(ok: bool, what: str) -> None:
        if not ok:
            raise ValueError(f"router document: {what}")

    def vector(x: object, n: int, what: str) -> np.ndarray:
        need(isinstance(x, list) and len(x) == n and all(type(v) in (int, float) and math.isfinite(v) for v in x), what)
        return np.array(x, float)

    need(isinstance(document, dict) and set(document) == set(KEYS), "keys")
    need(document["artifact_type"] == KIND and document["schema_version"] == VERSION and document["feature_version"] == VERSION, "versions")
    need(type(document["schema_version"]) is int and document["hash_algorithm"] == HASH and document["dense_feature_names"] == list(DENSE_NAMES), "features")
    need(isinstance(document["policy_id"], str) and document["policy_id"] != "", "policy_id")
    learn.check_bins(document["hash_bins"])
    n, models = DENSE + document["hash_bins"], tuple(document["model_ids"])
    mean, scale = vector(document["feature_mean"], n, "feature_mean"), vector(document["feature_scale"], n, "feature_scale")
    need(bool((scale > 0).all()), "feature_scale is not positive")
    columns, intercepts = [], []
    for kind in ("score_heads", "log_cost_heads"):
        need(set(document[kind]) == set(models), kind)
        for m in models:
            h = document[kind][m]
            need(set(h) == {"intercept", "coefficients"}, kind)
            columns.append(vector(h["coefficients"], n, kind))
            intercepts.append(vector([h["intercept"]], 1, kind)[0])
    safety = document["tier_safety_ratios"]
    need(set(safety) == set(tiers) and all(0 < s <= 1 for s in safety.values()), "tier_safety_ratios")
    need(re.fullmatch("[0-9a-f]{64}", document["policy_sha256"]) is not None, "policy_sha256")
    return Router(document["hash_bins"], models, mean, scale, np.stack(columns, 1), np.array(intercepts), dict(safety), document["policy_sha256"], dict(document["training_summary"]), document["policy_id"])


def predictions(vectors: DataFrame, heads: dict[int, tuple], models: tuple[str, ...], *more: str) -> DataFrame:
    """score_<model> and cost_<model> of rows (episode_id, fold, at, value), each by the heads of its fold; clamped and in order of cost.

    Means and scales are folded into the heads, so a row costs its own entries and no dense row is built, however many
    folds there are.  ``more`` columns of the rows travel along.
    """
    m, folds = len(models), sorted(heads)
    slopes = {f: ((coef / scale[:, None]), intercept - mean @ (coef / scale[:, None])) for f, (mean, scale, coef, intercept) in heads.items()}
    width = len(slopes[folds[0]][0])
    shared = vectors.sparkSession.sparkContext.broadcast((np.concatenate([slopes[f][0] for f in folds]).T.copy(), np.stack([slopes[f][1] for f in folds])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slope, base = shared.value
        for batch in batches:
            fold = batch.column(1).to_numpy()
            if unknown := set(np.unique(fold).tolist()) - set(folds):
                raise KeyError(f"no heads for folds {sorted(unknown)}")
            which = np.searchsorted(folds, fold)
            size = pc.list_value_length(batch.column(2)).to_numpy()
            row, at, value = np.repeat(np.arange(len(fold)), size), batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            place = np.repeat(which * width, size) + at
            out = np.stack([np.bincount(row, value * slope[t][place], len(fold)) for t in range(2 * m)], 1) + base[which]
            out[:, :m] = np.clip(out[:, :m], 0, 1)
            out[:, m:] = np.exp(np.clip(out[:, m:], -50, 50))
            for i in range(1, m):
                out[:, m + i] = np.maximum(out[:, m + i], out[:, m + i - 1] * (1 + 1e-12))
            names = ["episode_id", *(f"score_{x}" for x in models), *(f"cost_{x}" for x in models), *more]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[:, i]) for i in range(2 * m)), *batch.columns[4:]], names)

    held = vectors.select("episode_id", F.col("fold").cast("int"), "at", "value", *more)
    kept = [f"`{c}` {held.schema[c].dataType.simpleString()}" for c in more]
    schema = ", ".join(["episode_id string", *(f"`score_{x}` double" for x in models), *(f"`cost_{x}` double" for x in models), *kept])
    return held.mapInArrow(run, schema)


def learned_route(episodes: DataFrame, router: Router, policy: scoring.Policy = scoring.PUBLIC, vectors: DataFrame | None = None) -> DataFrame:
    """(episode_id, tier, model_id): Lagrangian selection for each tier; in the widest tier unused budget goes to the second model.

    The penalties of all tiers come from one pass over the predictions.  vectors: the feature vectors
    of the episodes, if they are at hand.
    """
    vectors = (learn.sparse_vectors(episodes, router.bins) if vectors is None else vectors).withColumn("fold", F.lit(0))
    models = list(router.models)
    held = written(predictions(vectors, {0: (router.mean, router.scale, router.coefficients, router.intercepts)}, router.models), "predictions")
    widest = max(policy.tiers, key=lambda t: float(policy.tiers[t][0]))
    light, found = routing.penalties(held, models, {t: (float(m), router.safety[t]) for t, (m, _) in policy.tiers.items()})
    out = None
    for tier, (multiplier, _) in policy.tiers.items():
        routed = held.withColumn("model_id", curve.choice(models, float(light), found[tier]["at"]) if found else F.lit(models[0]))
        if tier == widest:
            routed = routing.filled_route(routed, models, float(multiplier))
        part = routed.select("episode_id", F.lit(tier).alias("tier"), "model_id")
        out = part if out is None else out.unionByName(part)
    return out


def ratio(a: Decimal, b: Decimal) -> Decimal:
    """a / b to twelve places, half to even."""
    with localcontext(prec=curve.DIGITS):
        return (a / b).quantize(Decimal("1e-12"))


def candidates(held: DataFrame, models: list[str], policy: scoring.Policy, wanted: dict[str, list[float]]) -> dict[str, list[dict]]:
    """How every safety ratio of every tier does by the true scores and costs; one pass for all of them.

    held: score_, cost_ (predicted), true_score_ and true_cost_ of each model.
    """
    sums = {"true_score": [F.col(f"true_score_{m}") for m in models], "true_cost": [F.col(f"true_cost_{m}") for m in models]}
    (n, true_light, *of_light) = (*routing.total(held, F.lit(1.0), F.col(f"true_cost_{models[models.index(policy.light)]}"), *[s[0] for s in sums.values()]),)
    budgets = {f"{t}|{i}": (float(policy.tiers[t][0]), s) for t, ratios in wanted.items() for i, s in enumerate(ratios)}
    light, found = routing.penalties(held, models, budgets, sums)
    out: dict[str, list[dict]] = {}
    for tier, ratios in wanted.items():
        for i, s in enumerate(ratios):
            r = found.get(f"{tier}|{i}", {"cost": light, "true_score": of_light[0], "true_cost": of_light[1]})
            with localcontext(prec=curve.DIGITS):
                passed = r["true_cost"] <= true_light * Decimal(policy.tiers[tier][0])
            out.setdefault(tier, []).append({
                "safety": s, "predicted_ratio": float(r["cost"] / light) if light else 1.0, "ratio": ratio(r["true_cost"], true_light), "passed": passed, "score": ratio(r["true_score"], n) if passed else Decimal(0),
            })
    return out


def best(found: list[dict]) -> dict | None:
    """The candidate with the best score, then the lower ratio, then the lower safety; the first on ties."""
    return max(found, key=lambda c: (c["score"], -c["ratio"], -c["safety"]), default=None)


def chosen_safety(held: DataFrame, models: list[str], policy: scoring.Policy, size: int, only_passing: bool = False) -> dict[str, dict]:
    """The best safety ratio of each tier over the whole grid; with ``only_passing`` a tier without a passing one is an error."""
    grids = {t: learn.safety_candidates(float(m), size) for t, (m, _) in policy.tiers.items()}
    found = {t: best([c for c in cs if c["passed"] or not only_passing]) for t, cs in candidates(held, models, policy, grids).items()}
    if missing := [t for t, c in found.items() if c is None]:
        raise RuntimeError(f"no safety ratio keeps the budget of {missing}")
    return found


def validated_safety(held: DataFrame, models: list[str], policy: scoring.Policy, initial: dict[str, float], size: int) -> dict[str, dict]:
    """For each tier the largest passing ratio among the initial one and those of the grid below it."""
    wanted = {t: sorted({initial[t], *(s for s in learn.safety_candidates(float(m), size) if s <= initial[t])}, reverse=True) for t, (m, _) in policy.tiers.items()}
    out = {}
    for tier, cs in candidates(held, models, policy, wanted).items():
        out[tier] = next((c for c in cs if c["passed"]), None)
        if out[tier] is None:
            raise RuntimeError(f"no safety ratio keeps the budget of {tier}")
    return out


def targets(outcomes: DataFrame, policy: scoring.Policy) -> DataFrame:
    """Scores and costs of each episode side by side, for the models in their order; an episode without all of them is an error."""
    models = list(policy.models)
    paid = scoring.costed(outcomes, scoring.rates(outcomes.sparkSession, policy))
    return paid.groupBy("episode_id").pivot("model_id", models).agg(F.first(F.col("score").cast("double")).alias("s"), F.first(F.col("cost_nano").cast("double")).alias("c"))


def report_of(found: dict[str, dict]) -> dict:
    return {t: {k: str(v) if isinstance(v, Decimal) else v for k, v in c.items()} for t, c in found.items()}


def train(
    episodes: DataFrame, outcomes: DataFrame, policy_sha256: str, bins: int = 256, folds: int = 5, alphas: tuple[float, ...] = learn.ALPHAS, grid_size: int = 121, policy: scoring.Policy = scoring.PUBLIC,
    validation: tuple[DataFrame | None, DataFrame | None] = (None, None), vectors: DataFrame | None = None,
) -> Router:
    """Fits the heads; the penalty by out-of-fold error, each tier's safety ratio by the true score of out-of-fold choices.

    The ratios are then checked with the fitted heads, and, given validation episodes and outcomes,
    set anew on these.  episodes: (episode_id, pos, text); outcomes: (episode_id, model_id, score,
    input_tokens, output_tokens, ...); vectors: the feature vectors of the episodes, if they are at hand.
    """
    models, m = list(policy.models), len(policy.models)
    learn.check_bins(bins)
    folds = learn.checked_arguments(episodes.count(), folds, alphas, grid_size, validation)
    spark = episodes.sparkSession
    checks.require(checks.matrix_gaps(episodes, spark.createDataFrame([(x,) for x in models], "model_id string"), outcomes), "the outcome matrix is complete")
    n = learn.DENSE_FEATURES + bins

    def rows_of(episodes: DataFrame, outcomes: DataFrame, held: DataFrame | None = None) -> DataFrame:
        columns = F.array(*[F.col(f"{x}_s") for x in models], *[F.ln(F.greatest(F.col(f"{x}_c"), F.lit(1.0))) for x in models])
        held = learn.sparse_vectors(episodes, bins) if held is None else held
        vectors = held.join(episodes.select("episode_id", F.pmod("pos", F.lit(folds)).alias("fold")), "episode_id")
        return written(vectors.join(targets(outcomes, policy), "episode_id").withColumn("targets", columns), "rows")

    def with_truth(rows: DataFrame, heads: dict[int, tuple]) -> DataFrame:
        truth = {f"true_{kind}_{x}": F.col(f"{x}_{kind[0]}") for kind in ("score", "cost") for x in models}
        return written(predictions(rows.withColumns(truth), heads, tuple(models), *truth), "predicted")

    rows = rows_of(episodes, outcomes, vectors)
    moments = learn.Moments(rows, n, 2 * m, folds)
    total = moments[None]
    alpha, objective = learn.selected_alpha(moments, n, m, alphas)
    heads = {f: learn.ridge(total - x, n, alpha) for f, x in ((f, moments[f]) for f in range(folds)) if 0 < x[0, 0] < total[0, 0]}
    out_of_fold = chosen_safety(with_truth(rows, heads), models, policy, grid_size)
    mean, scale, coef, intercept = learn.fitted(rows, total, n, alpha)
    fitted = dict.fromkeys(range(folds), (mean, scale, coef, intercept))
    checked = validated_safety(with_truth(rows, fitted), models, policy, {t: c["safety"] for t, c in out_of_fold.items()}, grid_size)
    summary = {"rows": int(total[0, 0]), "folds": folds, "alpha": alpha, "objectives": {f"{a:.12g}": o for a, o in objective.items()}, "out_of_fold": report_of(out_of_fold), "fitted": report_of(checked)}
    if validation[0] is not None:
        checked = chosen_safety(with_truth(rows_of(*validation), fitted), models, policy, grid_size, only_passing=True)
        summary["validation"] = report_of(checked)
    safety = {t: c["safety"] for t, c in checked.items()}
    return Router(bins, tuple(models), mean, scale, coef, intercept, safety, policy_sha256, json.loads(json.dumps(summary)), policy.policy_id)


def self_check(router: Router, episodes: DataFrame, outcomes: DataFrame, header: dict, policy: scoring.Policy = scoring.PUBLIC) -> DataFrame:
    """The report of a router on episodes with known outcomes; the router's policy digest must be the policy's."""
    if (router.policy_id, router.policy_sha256) != (policy.policy_id, report.policy_sha256(policy)):
        raise ValueError("the router was trained for another policy")
    decisions = written(learned_route(episodes, router, policy), "decisions")
    report.guarded(episodes, outcomes, decisions, policy)
    return report.tier_reports(decisions, outcomes, header, policy)
