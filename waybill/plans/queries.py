"""The engine's operators on the driver tables.

Documents are episodes; outcomes are integer functions of the document and model, so that any
engine computes the same ones; events are latency measurements and attempt logs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.functions import exact, hashing, text
from waybill.operators import audit, checks, learn, learned, materialise, report, routing, scoring, stats
from waybill.operators.order import ranked
from waybill.sources.shared import spread, written

MODELS = ("light", "middle", "think")
TIERS = ("fast", "balanced", "premium")
SECRET = b"waybill audit secret"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def episodes(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").cast("string").alias("episode_id"), F.col("doc_id").alias("pos"), "text")


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    models = spark.createDataFrame(list(enumerate(MODELS)), "m bigint, model_id string")
    held = docs.crossJoin(F.broadcast(models))
    tokens = F.greatest(F.lit(1), F.floor(F.col("n_chars") / 4)).cast("bigint")
    quarters = F.least(F.lit(4), 2 * F.coalesce("quality", F.lit(0)) + (F.col("doc_id") + F.col("m")) % 3)
    return held.select(
        F.col("doc_id").cast("string").alias("episode_id"), "model_id", (quarters * 25).cast("decimal(10,0)").alias("hundredths"), (quarters.cast("decimal(4,2)") * F.lit("0.25").cast("decimal(3,2)")).cast("decimal(10,2)").alias("score"),
        (1 + F.col("doc_id") % 3).alias("num_generations"), tokens.alias("input_tokens"), ((50 + (F.col("doc_id") * 7 + F.col("m") * 13) % 200) * (F.col("m") + 1)).alias("output_tokens"),
    )


def decisions(spark: SparkSession, d: str) -> DataFrame:
    return routing.rule_route(episodes(spark, d))


def score_tiers(spark: SparkSession, d: str) -> DataFrame:
    s = scoring.tier_scores(decisions(spark, d), outcomes(spark, d))
    big = ["n_episodes", "total_nano", "light_nano", "n_generations", "n_input", "n_output", "n_light", "n_middle", "n_think", "ratio_e12", "quality_e12", "score_e12", "points_e6"]
    return s.select("tier", *[F.col(c).cast("bigint").alias(c) for c in big], "passed", "near_budget")


def score_final(spark: SparkSession, d: str) -> DataFrame:
    s = scoring.final_score(scoring.tier_scores(decisions(spark, d), outcomes(spark, d)))
    return s.select(F.col("points_e12").cast("bigint").alias("points_e12"), F.col("score_e12").cast("bigint").alias("score_e12"), exact.scaled_text(F.col("score_e12")).alias("score_text"), "n", "n_tiers")


def outcome_cost(spark: SparkSession, d: str) -> DataFrame:
    return scoring.costed(outcomes(spark, d), scoring.rates(spark)).select("episode_id", "model_id", F.col("cost_nano").cast("bigint").alias("cost_nano"))


def model_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = decisions(spark, d).groupBy("tier", "model_id").agg(F.count("*").alias("n"))
    full = spark.createDataFrame([(t, m) for t in TIERS for m in MODELS], "tier string, model_id string")
    return full.join(counts, ["tier", "model_id"], "left").select("tier", "model_id", F.coalesce("n", F.lit(0)).alias("n"))


def line_cost(spark: SparkSession, d: str) -> DataFrame:
    """Costs at volume: quantities and prices as token counts, by order status."""
    rates = {r["model_id"]: r for r in scoring.rates(spark).collect()}
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").cast("bigint").alias("i"), F.floor("l_extendedprice").cast("bigint").alias("o"))
    joined = lines.join(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    cost = {m: (F.col("i") * r["input_nano"] + F.col("o") * r["output_nano"]).cast("decimal(24,0)") for m, r in rates.items()}
    return joined.groupBy("o_orderstatus").agg(F.count("*").alias("n"), *[F.sum(c).cast("bigint").alias(f"{m}_nano") for m, c in cost.items()])


def features(spark: SparkSession, d: str) -> DataFrame:
    held = text.with_features(episodes(spark, d)).withColumn("complexity", text.complexity())
    ints = ["n_chars", "n_messages", "n_words", "n_sentences", "n_code", "n_maths", "n_reasoning", "complexity"]
    return held.select("episode_id", *[F.col(c).cast("bigint").alias(c) for c in ints], "hangul_ratio", "numeric_density", "long_context")


def rule_route(spark: SparkSession, d: str) -> DataFrame:
    return decisions(spark, d)


def constant_route(spark: SparkSession, d: str) -> DataFrame:
    return routing.constant_route(episodes(spark, d), list(TIERS), "light")


def conversations(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    return turns.select(F.col("conv_id").cast("string").alias("episode_id"), F.lit(None).cast("string").alias("prompt"), "messages")


def messages_text(spark: SparkSession, d: str) -> DataFrame:
    e = conversations(spark, d)
    joined = text.episode_text(F.col("prompt"), F.col("messages"))
    return e.select("episode_id", joined.alias("text"), F.size("messages").cast("bigint").alias("n_messages"))


def messages_route(spark: SparkSession, d: str) -> DataFrame:
    return routing.rule_route(messages_text(spark, d).withColumn("n_messages", F.col("n_messages").cast("int")))


def message_roles(spark: SparkSession, d: str) -> DataFrame:
    bad = checks.outside(table(spark, d, "conversations"), "role", ["user", "assistant"])
    return bad.groupBy("role").agg(F.count("*").alias("n"))


def priority_groups(spark: SparkSession, d: str) -> DataFrame:
    return routing.priority_groups(episodes(spark, d)).select(F.col("priority").cast("bigint").alias("priority"), "n", "weight")


def budget_route(spark: SparkSession, d: str) -> DataFrame:
    return routing.budget_route(episodes(spark, d)).groupBy("tier", "model_id").agg(F.count("*").alias("n"))


def partial(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes with gaps and strangers, for the checks."""
    o = outcomes(spark, d).select("episode_id", "model_id")
    kept = o.filter(F.pmod(F.col("episode_id").cast("bigint"), F.lit(17)) != 3)
    return kept.union(spark.createDataFrame([("no such episode", "light"), ("0", "unknown")], "episode_id string, model_id string"))


def outcome_matrix_gaps(spark: SparkSession, d: str) -> DataFrame:
    models = spark.createDataFrame([(m,) for m in MODELS], "model_id string")
    return checks.matrix_gaps(episodes(spark, d), models, partial(spark, d))


def decision_coverage(spark: SparkSession, d: str) -> DataFrame:
    return checks.coverage(episodes(spark, d), partial(spark, d).filter("model_id = 'light'"))


def duplicate_texts(spark: SparkSession, d: str) -> DataFrame:
    return checks.duplicates(table(spark, d, "documents").select(F.sha2("text", 256).alias("sha256")), ["sha256"])


def unsorted_ids(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"))
    return checks.unsorted(held, "id", "doc_id")


def xor_violations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("prompt"), F.when(F.col("doc_id") % 7 == 0, F.col("source")).alias("messages"))
    return checks.not_exactly_one(e, "prompt", "messages")


def bad_decimals(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    value = F.element_at(F.array(*map(F.lit, ["0", "0.5", "1", "00.5", ".5", "1e-1", "-0", "1.", "0.25\n", "2", "0.1234567890123456789012345678901"])), (n % 11 + 1).cast("int"))
    return checks.bad_decimals(table(spark, d, "documents").select("doc_id", value.alias("score")), "score", "0", "1").select("doc_id", F.hex("score").alias("score_hex"))


def unsafe_urls(spark: SparkSession, d: str) -> DataFrame:
    return checks.unsafe_urls(table(spark, d, "pages").select("page_id", "url"), "url")


def rule_table(spark: SparkSession, d: str) -> DataFrame:
    rules = {"short": F.col("n_chars") >= 100, "language": F.col("lang").isin("en", "fr", "de"), "source": F.regexp_like("source", F.lit(r"\Asrc[0-9]\z"))}
    return checks.rule_violations(table(spark, d, "documents"), rules).select("doc_id", "rule")


def targets_pivot(spark: SparkSession, d: str) -> DataFrame:
    return outcomes(spark, d).groupBy("episode_id").pivot("model_id", list(MODELS)).agg(F.first("output_tokens"))


def halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = episodes(spark, d).select("episode_id", "pos", F.sha2("text", 256).alias("prompt"))
    n = e.count() // 2
    return e.filter(F.col("pos") < n), e.filter(F.col("pos") >= n).withColumn("pos", F.col("pos") - n)


def union_splits(spark: SparkSession, d: str) -> DataFrame:
    return materialise.union_in_order(*halves(spark, d))


def base_plus_fetched(spark: SparkSession, d: str) -> DataFrame:
    return ranked(materialise.base_and_fetched(*halves(spark, d)), ["episode_id"], "place").select("episode_id", "place")


def set_difference(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "documents").select((F.col("doc_id") * 3).alias("k")), table(spark, d, "events").select((F.col("event_id") * 5).alias("k"))
    left, right = checks.missing(a, b, ["k"]), checks.missing(b, a, ["k"])
    return left.withColumn("side", F.lit("left")).unionByName(right.withColumn("side", F.lit("right")))


def selection_join(spark: SparkSession, d: str) -> DataFrame:
    bench = table(spark, d, "benchmark").select(F.col("item_id"), F.col("text").alias("problem"))
    picks = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 50).alias("item_id"))
    hashes = bench.select("item_id", F.sha2(F.when(F.col("item_id") % 9 == 0, F.concat("problem", F.lit("x"))).otherwise(F.col("problem")), 256).alias("prompt_sha256"))
    held = materialise.selected_problems(picks.join(hashes, "item_id", "left"), bench, ["item_id"])
    return held.groupBy("status").agg(F.count("*").alias("n"))


def sample_tables(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select((F.col("p_size") % 5).alias("regime"), F.col("p_partkey").alias("pos"), F.col("p_partkey").cast("string").alias("sample_id"), F.col("p_name").alias("problem"), F.col("p_brand").alias("answer"))
    return materialise.table_bytes(rows, ["regime"]).select(F.col("regime").cast("bigint").alias("regime"), "sha256", "valid", F.length("content").cast("bigint").alias("n_chars"))


def manifest(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("path"), F.sha2("html", 256).alias("sha256"))
    return materialise.manifest_hash(files)


def generation_seeds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", hashing.generation_seed(F.lit(220302), F.col("p_brand"), F.col("p_partkey")).alias("seed"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Five measured runs of each submission and tier."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.floor(F.abs(F.col("value")) * 1000).cast("bigint").alias("elapsed_ns"))
    held = e.select("event_id", F.concat(F.lit("s"), F.floor(F.col("event_id") / 15).cast("string")).alias("submission_id"), F.element_at(F.array(*map(F.lit, TIERS)), (F.floor(F.col("event_id") / 5) % 3 + 1).cast("int")).alias("tier"), "event_type", "elapsed_ns")
    kind = F.when(F.col("event_type") == "error", "execution_failure").otherwise("ok")
    return held.withColumn("kind", kind)


def latency_medians(spark: SparkSession, d: str) -> DataFrame:
    return stats.tier_medians(stats.settled(runs(spark, d)))


def tiebreak_rank(spark: SparkSession, d: str) -> DataFrame:
    totals = latency_medians(spark, d).groupBy("submission_id").agg(F.sum("median_ns").alias("total_ns"))
    return stats.ranking(totals, 1000)


def rotation(spark: SparkSession, d: str) -> DataFrame:
    return stats.rotated(table(spark, d, "nation").select(F.col("n_name").alias("submission_id")), 5)


def repetitions(spark: SparkSession, d: str) -> DataFrame:
    return stats.repetition_stats(table(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("bigint")), ["l_returnflag", "l_linestatus"], "q").select("l_returnflag", "l_linestatus", "least", F.col("median").cast("double").alias("median"), "most", "n")


def determinism(spark: SparkSession, d: str) -> DataFrame:
    return stats.determinism(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus")


def audit_mapping(spark: SparkSession, d: str) -> DataFrame:
    return audit.audit_map(episodes(spark, d), SECRET)


def audit_mismatches(spark: SparkSession, d: str) -> DataFrame:
    mapping = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("original_id"), F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("audit_id"))
    official = decisions(spark, d).filter("tier = 'balanced'")
    changed = F.when(F.col("episode_id").cast("bigint") % 10 == 4, "think").otherwise(F.col("model_id"))
    return audit.audit_mismatches(mapping, official, official.select(F.concat(F.lit("a"), "episode_id").alias("episode_id"), changed.alias("model_id")))


def attempt_log(spark: SparkSession, d: str) -> DataFrame:
    kinds = ["execution_failure", "infrastructure_failure", "execution_failure", "valid", "infrastructure_failure", "fairness_violation"]
    e = table(spark, d, "events")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") * 7 % 11 % 6 + 1).cast("int"))
    return e.select("user_id", "ts", "event_id", kind.alias("kind"), (F.col("event_id") % 29 == 0).alias("cleanup_pending"))


def attempt_numbers(spark: SparkSession, d: str) -> DataFrame:
    return audit.numbered(attempt_log(spark, d), "user_id", ["ts", "event_id"], ("execution_failure", "valid")).select("event_id", "seq", "attempt")


def retry_fold(spark: SparkSession, d: str) -> DataFrame:
    log = audit.numbered(attempt_log(spark, d), "user_id", ["ts", "event_id"], ("execution_failure",))
    return audit.retry_outcomes(log, "user_id")


def whole_log_numbers(spark: SparkSession, d: str) -> DataFrame:
    """All events as the log of one run, which many tasks share: sequence and attempt numbers."""
    log = attempt_log(spark, d).withColumn("run", F.lit("all"))
    return audit.numbered(log, "run", ["ts", "event_id"], ("execution_failure", "valid")).select("event_id", "seq", "attempt")


def whole_log_fold(spark: SparkSession, d: str) -> DataFrame:
    """All events as the logs of three runs, most of whose rows decide nothing; the first run never stops."""
    n = F.col("event_id")
    kind = F.when((n % 3 == 0) | (n % 1009 > 0), "pending").otherwise(F.col("kind"))
    log = attempt_log(spark, d).withColumns({"run": F.concat(F.lit("r"), (n % 3).cast("string")), "kind": kind, "cleanup_pending": F.lit(False)})
    return audit.retry_outcomes(audit.numbered(log, "run", ["ts", "event_id"], ("execution_failure",)), "run")


def price_median(spark: SparkSession, d: str) -> DataFrame:
    """The middle of all line prices, one group, in cents."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return stats.medians(table(spark, d, "lineitem").select(cents.alias("cents")), [], "cents")


def tier_status(spark: SparkSession, d: str) -> DataFrame:
    audited = F.element_at(F.array(*map(F.lit, ["passed", "review_required", "inconclusive_infrastructure"])), (F.col("user_id") % 4 + 1).cast("int"))
    held = retry_fold(spark, d).filter("state <> 'running'").withColumn("audit", F.when(F.col("user_id") % 4 < 3, audited))
    held = held.withColumn("status", audit.tier_status(F.col("state"), F.col("audit")))
    return held.groupBy("state", "audit", "status").agg(F.count("*").alias("n")).withColumn("exit_code", audit.exit_code(F.col("status")).cast("bigint"))


def attempt_reasons(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    reason = audit.attempt_reason(F.col("kind"), F.col("cleanup_pending"), n % 5 == 0, n % 7 == 0, F.when(n % 3 > 0, n % 3 - 1))
    return attempt_log(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def term_bins(spark: SparkSession, d: str) -> DataFrame:
    return learn.term_counts(episodes(spark, d), 256).select("episode_id", F.col("bin").cast("bigint").alias("bin"), "value")


def token_lists(spark: SparkSession, d: str) -> DataFrame:
    e = episodes(spark, d).select("episode_id", text.tokens(F.col("text")).alias("t"))
    return e.select("episode_id", F.size("t").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("sha256"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Feature vectors with 256 bins in millionths, as the hash of their numbers."""
    width = learn.DENSE_FEATURES + 256
    held = learn.dense_rows(learn.sparse_vectors(episodes(spark, d), 256), width)
    millionths = F.transform("features", lambda x: F.round(x * 1_000_000).cast("bigint"))
    return held.select("episode_id", F.size("features").cast("bigint").alias("n_features"), F.sha2(F.array_join(F.transform(millionths, lambda x: x.cast("string")), ","), 256).alias("sha256"))


def _fixed(column: Column) -> Column:
    return F.round(column * 1_000_000).cast("bigint")


def linear_scores(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    width = len(e.select("embedding").first()[0])
    heads = [(0.1 * k, [((i * 7 + k * 3) % 11 - 5) / 16 for i in range(width)]) for k in range(3)]
    mean, scale = [i % 5 / 8 for i in range(width)], [1 + i % 3 / 2 for i in range(width)]
    values = learn.linear_heads(F.col("embedding"), mean, scale, heads)
    return e.select("vec_id", *[_fixed(v).alias(f"score_{m}") for m, v in zip(MODELS, values, strict=True)])


def argmax_model(spark: SparkSession, d: str) -> DataFrame:
    s = linear_scores(spark, d)
    return s.select("vec_id", routing.best_model([F.col(f"score_{m}") for m in MODELS], list(MODELS)).alias("model_id"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    score = [((n * (37 + 11 * i) % 101 + 20 * i) / 160.0).alias(f"score_{m}") for i, m in enumerate(MODELS)]
    cost = [((n % 13 + 8) * (1.0 + 1.25 * i) / 8.0).alias(f"cost_{m}") for i, m in enumerate(MODELS)]
    return table(spark, d, "documents").select("doc_id", *score, *cost)


def penalised_choice(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).select("doc_id", routing.penalised(list(MODELS), 64.0, 1024.0).alias("model_id"))


def distinct_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Predictions without ties between rows; costs are exact in binary."""
    n = F.col("doc_id")
    score = [((n * (37 + 11 * i) % 101 + 20 * i) / 160.0 + (n * 7919 + i * 104729) % 1048576 / 17179869184.0).alias(f"score_{m}") for i, m in enumerate(MODELS)]
    cost = [((n % 13 + 8) * (1.0 + 1.25 * i) / 8.0).alias(f"cost_{m}") for i, m in enumerate(MODELS)]
    truth = [((n * (31 + 6 * i) % 5) / 4.0).alias(f"true_score_{m}") for i, m in enumerate(MODELS)] + [((n % 11 + 8) * (1.0 + 1.25 * i) / 8.0).alias(f"true_cost_{m}") for i, m in enumerate(MODELS)]
    return table(spark, d, "documents").select("doc_id", *score, *cost, *truth)


def lagrangian_select(spark: SparkSession, d: str) -> DataFrame:
    return routing.lagrangian_route(distinct_predictions(spark, d), list(MODELS), 2.0, 0.9).select("doc_id", "model_id")


def filled_select(spark: SparkSession, d: str) -> DataFrame:
    routed = routing.lagrangian_route(distinct_predictions(spark, d), list(MODELS), 1.2, 0.9)
    return routing.filled_route(routed, list(MODELS), 4.0).select("doc_id", "model_id")


def training_rows(spark: SparkSession, d: str, folds: int = 5) -> tuple[DataFrame, int]:
    """Embeddings as features; three scores and three log costs that depend on them."""
    e = table(spark, d, "embeddings")
    width = len(e.select("embedding").first()[0])
    x = F.transform("embedding", lambda v: v.cast("double"))
    t = [F.get(x, F.lit(i)) * (1 + i % 3) + F.get(x, F.lit(i + 6)) + F.col("label") / 10 for i in range(6)]
    return e.select(F.pmod("vec_id", F.lit(folds)).alias("fold"), x.alias("features"), F.array(*t).alias("targets")), width


def ridge_alpha(spark: SparkSession, d: str) -> DataFrame:
    rows, width = training_rows(spark, d)
    _, objective = learn.selected_alpha(learn.moments(rows, width, 6, 5), width, 3)
    return spark.createDataFrame([(a, o) for a, o in objective.items()], "alpha double, objective double")


def ridge_fit(spark: SparkSession, d: str) -> DataFrame:
    rows, width = training_rows(spark, d)
    folds = learn.moments(rows, width, 6, 5)
    mean, scale, coef, intercept = learn.ridge(sum(m for _, m in folds), width, 1.0)
    return spark.createDataFrame([(t, float(intercept[t]), [float(c) for c in coef[:, t]]) for t in range(6)], "target bigint, intercept double, coefficients array<double>")


def ridge_pair(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold objective of every penalty, and the heads it gives over all rows, for two features and two targets; in millionths."""
    rows, _ = training_rows(spark, d)
    rows = rows.select("fold", F.slice("features", 1, 2).alias("features"), F.array(F.get("targets", F.lit(0)), F.get("targets", F.lit(3))).alias("targets"))
    folds = learn.moments(rows, 2, 2, 5)
    _, objective = learn.selected_alpha(folds, 2, 1)
    out = []
    for alpha, value in objective.items():
        _, _, coef, intercept = learn.ridge(sum(m for _, m in folds), 2, alpha)
        out.append((alpha, *(round(float(x) * 1e6) for x in (value, intercept[0], coef[0, 0], coef[1, 0], coef[0, 1], coef[1, 1]))))
    return spark.createDataFrame(out, "alpha double, objective bigint, intercept bigint, score_1 bigint, score_2 bigint, cost_1 bigint, cost_2 bigint")


def ridge_wide(spark: SparkSession, d: str) -> DataFrame:
    """Heads for the scores and log costs of the documents over 16,384 bins: intercept, and sums of the coefficients by size and by place."""
    models = list(scoring.PUBLIC.models)
    n = learn.DENSE_FEATURES + learn.MOST_BINS
    targets = learned.targets(outcomes(spark, d), scoring.PUBLIC)
    columns = F.array(*[F.col(f"{x}_s") for x in models], *[F.ln(F.greatest(F.col(f"{x}_c"), F.lit(1.0))) for x in models])
    rows = learn.sparse_vectors(episodes(spark, d), learn.MOST_BINS).join(targets, "episode_id")
    rows = written(rows.select(F.lit(0).alias("fold"), "at", "value", columns.alias("targets")), "rows")
    if rows.count() > learn.MOST_DUAL:
        _, _, coef, intercept = learn.ridge_tiled(rows, n, 2 * len(models), 1.0)
    else:
        _, _, coef, intercept = learn.fitted_dual(rows, n, 1.0)
    out = [(t, float(intercept[t]), float(np.abs(coef[:, t]).sum()), float(coef[:, t] @ np.arange(n))) for t in range(2 * len(models))]
    return spark.createDataFrame(out, "target bigint, intercept double, size double, moment double")


def safety_rows(spark: SparkSession, found: dict[str, dict]) -> DataFrame:
    rows = [(t, round(c["safety"] * 1e9), int(c["score"].scaleb(12)), int(c["ratio"].scaleb(12)), c["passed"]) for t, c in found.items()]
    return spark.createDataFrame(rows, "tier string, safety_e9 bigint, score_e12 bigint, ratio_e12 bigint, passed boolean")


def safety_selection(spark: SparkSession, d: str) -> DataFrame:
    """For each tier the safety ratio, of 121, whose selection scores best within the budget."""
    return safety_rows(spark, learned.chosen_safety(distinct_predictions(spark, d), list(MODELS), scoring.PUBLIC, 121))


def safety_validation(spark: SparkSession, d: str) -> DataFrame:
    """For each tier the largest passing ratio up to 0.95."""
    return safety_rows(spark, learned.validated_safety(distinct_predictions(spark, d), list(MODELS), scoring.PUBLIC, dict.fromkeys(TIERS, 0.95), 121))


def safety_calibration(spark: SparkSession, d: str) -> DataFrame:
    """For each tier the best of the passing ratios."""
    return safety_rows(spark, learned.chosen_safety(distinct_predictions(spark, d), list(MODELS), scoring.PUBLIC, 121, only_passing=True))


def learned_route(spark: SparkSession, d: str) -> DataFrame:
    """Trained on the documents and their outcomes with 256 bins and the whole grid, then applied to them."""
    e = episodes(spark, d)
    vectors = written(learn.sparse_vectors(e, 256), "vectors")
    router = learned.train(e, outcomes(spark, d), report.policy_sha256(), vectors=vectors)
    return learned.learned_route(e, learned.parsed(router.document(), tuple(scoring.PUBLIC.tiers)), vectors=vectors).groupBy("tier", "model_id").agg(F.count("*").alias("n"))


HANGUL = ("증명 하라. 증명하라 유도 분석", "Prove x^2 + 2*x + 1 = 0", "Summarize and list only", "```python\ndef f(x):\n    return x;\n```", "big-O 시간  복잡도 must exactly", "plain words")


def hangul_markers(spark: SparkSession, d: str) -> DataFrame:
    """Keyword rules on the documents, each behind one of six prompts with keywords that the documents never hold."""
    prompt = F.element_at(F.array(*map(F.lit, HANGUL)), (F.col("doc_id") % len(HANGUL) + 1).cast("int"))
    e = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("episode_id"), F.concat(prompt, F.lit("\n"), "text").alias("text"))
    held = text.with_features(spread(e))
    return held.select("episode_id", *[F.col(c).cast("bigint").alias(c) for c in ("n_words", "n_code", "n_maths", "n_reasoning")], F.round(F.col("hangul_ratio") * 1_000_000).cast("bigint").alias("hangul_e6"))
