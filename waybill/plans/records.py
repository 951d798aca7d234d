"""Queries over attempts, measurements, reports and generated samples, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.functions import exact
from waybill.operators import audit, checks, generate, records, report, routing, stats
from waybill.sources import candidates, documents

from .inputs import HEADER
from .oracle import _FEATURES, _FOLD, _LOG, _OUTCOMES, _RUNS, _TIERS, _with
from .queries import TIERS, attempt_log, decisions, episodes, outcomes, runs, table

_POLICY = report.policy_document()
MODELS = list(_POLICY["models"])


def policies(spark: SparkSession, d: str) -> DataFrame:
    """A policy for each part: the light model costs as much as the part, the others more by its size."""
    price, size = F.col("p_retailprice").cast("decimal(10,2)"), F.col("p_size").cast("decimal(10,2)")
    rates = {"light_input": price, "light_output": price * 4, "middle_input": price + size, "middle_output": price * 4 + size * 9, "think_input": price * 6 + size, "think_output": price * 7}
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("policy_id"), *[v.cast("decimal(14,4)").alias(k) for k, v in rates.items()])


def policy_digest(spark: SparkSession, d: str) -> DataFrame:
    """The hash of the canonical form of each part's policy."""
    held = policies(spark, d)
    return held.select("p_partkey", F.sha2(report.policy_texts(held), 256).alias("sha256"))


def score_report(spark: SparkSession, d: str) -> DataFrame:
    """The 28 fields of every tier's report, after all guards."""
    chosen, true = decisions(spark, d), outcomes(spark, d)
    submission = {**HEADER, "policy_id": report.PUBLIC.policy_id}
    chosen = report.guarded(episodes(spark, d), true, chosen, headers=(HEADER, HEADER, [{**submission, "tier": t} for t in TIERS]))
    held = report.tier_reports(chosen, true, HEADER)
    return held.select(*[c for c in held.columns if c != "model_counts"], *[F.col(f"model_counts.{m}").alias(f"n_{m}") for m in MODELS])


def score_final_report(spark: SparkSession, d: str) -> DataFrame:
    held = report.final_report(decisions(spark, d), outcomes(spark, d), HEADER)
    points = F.array_sort(F.transform(F.map_entries("tiers"), lambda e: F.concat_ws(" ", e["key"], e["value"]["tier_points_total"], e["value"]["tier_score"])))
    return held.select("schema_version", "report_type", "challenge_id", "policy_id", "policy_sha256", "split", "score_decimal_places", "score_rounding", "final_weighted_points_total", "final_score", F.array_join(points, ";").alias("tiers"), F.to_json("tier_weights").alias("tier_weights"))


def one_tier_report(spark: SparkSession, d: str) -> DataFrame:
    return report.one_tier(decisions(spark, d), outcomes(spark, d), HEADER, "balanced").select("tier", "num_episodes", "budget_ratio", "budget_passed", "tier_score")


def header_problems(spark: SparkSession, d: str) -> DataFrame:
    """Fields that differ among the headers of each order's input, outcomes and submission, which follow its status, priority and clerk."""
    version, c = F.lit(1), F.col
    inputs = F.struct(F.when(c("o_orderkey") % 50 == 0, 2).otherwise(version).alias("schema_version"), F.lit("c").alias("challenge_id"), F.lit("O").alias("split"))
    outcomes_ = F.struct(version.alias("schema_version"), F.lit("c").alias("challenge_id"), c("o_orderstatus").alias("split"))
    submission = F.struct(version.alias("schema_version"), F.substring("o_orderpriority", 1, 1).alias("challenge_id"), F.lit("O").alias("split"), F.when(c("o_custkey") % 3 > 0, "public").alias("policy_id"), c("o_orderpriority").alias("tier"))
    held = table(spark, d, "orders").select("o_orderkey", inputs.alias("inputs"), outcomes_.alias("outcomes"), submission.alias("submission"), F.when(c("o_orderkey") % 2 == 0, "1-URGENT").alias("wanted"))
    return report.header_mismatches(held).select("o_orderkey", "field")


def candidate_rows(spark: SparkSession, d: str) -> DataFrame:
    """Candidates read from a document of the submissions that the runs name, with one that has no runs."""
    ids = runs(spark, d).select("submission_id").distinct().unionByName(spark.createDataFrame([("none",)], "submission_id string"))
    row = F.struct("submission_id", F.repeat(F.lit("a"), F.lit(40)).alias("commit_sha"), F.concat(F.lit("r/i@"), "submission_id").alias("image"), F.lit("e.json").alias("image_size_evidence"))
    docs = ids.withColumn("part", F.pmod(F.xxhash64("submission_id"), F.lit(16))).groupBy("part").agg(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.collect_list(row).alias("candidates"))).alias("text"))
    return candidates.candidates(docs.select(F.col("part").cast("string").alias("path"), "text")).drop("path")


def latency_report(spark: SparkSession, d: str) -> DataFrame:
    """One row for each candidate, read from documents, with medians, discards, total and rank; every seventh measurement is repeated after an infrastructure failure."""
    log = runs(spark, d).select("event_id", "submission_id", "tier", "kind", "elapsed_ns")
    lost = log.filter(F.col("event_id") % 7 == 0).withColumn("kind", F.lit("infrastructure_failure")).withColumn("elapsed_ns", F.lit(1).cast("bigint"))
    return candidates.latency_report(candidate_rows(spark, d), log.unionByName(lost), 1000, list(TIERS)).drop("commit_sha", "image_size_evidence")


def warm_up_order(spark: SparkSession, d: str) -> DataFrame:
    """The order of submissions in each turn, as a rank by time and then id would list them."""
    return stats.rotated(table(spark, d, "supplier").select(F.col("s_name").alias("submission_id")), 3)


def logged(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    log = attempt_log(spark, d)
    return log.select(
        "*", (n % 5 == 0).alias("timed_out"), (n % 7 == 0).alias("operator_terminated"), F.when(n % 3 > 0, n % 3 - 1).alias("returncode"), F.concat(F.lit("ö"), n.cast("string")).alias("stdout"),
        F.when(n % 4 > 0, F.repeat(F.lit("e"), (n % 9).cast("int"))).alias("stderr"),
    )


def attempt_records(spark: SparkSession, d: str) -> DataFrame:
    return records.attempt_records(logged(spark, d)).select("event_id", "reason_code", "stdout_bytes", "stdout_sha256", "stderr_bytes", "stderr_sha256")


def execution_records(spark: SparkSession, d: str) -> DataFrame:
    """One record for each user's log, with an audit for three in four users."""
    log = audit.numbered(logged(spark, d), "user_id", ["ts", "event_id"], ("execution_failure", "valid"))
    user = F.col("user_id")
    audits = log.select("user_id").distinct().filter(user % 4 < 3).select(user, audit.audit_status(user % 4 == 1, F.lit(0), F.when(user % 4 == 2, 3).otherwise(0)).alias("audit"))
    held = records.execution_records(log, "user_id", audits)
    return held.select("user_id", "status", "exit_code", "attempts", "infrastructure", F.sha2("history", 256).alias("history_sha256"))


def check_records(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    kind = F.when(n % 6 == 0, "execution_failure").otherwise("valid")
    rows = table(spark, d, "events").select("event_id", "user_id", kind.alias("kind"), F.when(n % 4 > 0, n * 1_000_000).alias("elapsed_ns"), F.concat(F.repeat(F.lit("a"), (n % 5000).cast("int")), n.cast("string")).alias("stderr"))
    return records.result_records(rows, 90)


def check_tails(spark: SparkSession, d: str) -> DataFrame:
    return check_records(spark, d).select("event_id", "passed", "elapsed_seconds", F.sha2("stderr_tail", 256).alias("tail_sha256"))


def check_report(spark: SparkSession, d: str) -> DataFrame:
    return records.check_report(check_records(spark, d), ["user_id"])


def measured(spark: SparkSession, d: str) -> DataFrame:
    """Repetitions of each order's lines, every third one without counters of a control group."""
    q, n = F.col("l_quantity").cast("bigint"), F.col("l_linenumber").cast("bigint")
    group = F.struct(*[(q * (i + 1)).alias(c) for i, c in enumerate(records.GROUP_MAXIMA)])
    run = F.struct(
        (q / 4).alias("elapsed_seconds"), (n / 8).alias("cpu_seconds"), (q * 10).alias("max_rss_bytes"), n.alias("processes"), (n + 1).alias("threads"), (q + n).alias("output_bytes"), F.when(n % 3 > 0, group).alias("control_group")
    )
    return table(spark, d, "lineitem").select("l_orderkey", run.alias("r")).groupBy("l_orderkey").agg(F.collect_list("r").alias("repetitions"))


def repetition_summary(spark: SparkSession, d: str) -> DataFrame:
    return records.repetition_summary(measured(spark, d), ["l_orderkey"])


def overall_maxima(spark: SparkSession, d: str) -> DataFrame:
    return records.overall_maxima(measured(spark, d))


def invalid_results(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey")
    held = table(spark, d, "orders").select(n, F.when(n % 5 > 0, n % 7 > 0).alias("deterministic"), (n % 3 > 0).alias("invariant"))
    return records.invalid_results(held).select("o_orderkey")


def size_texts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey").cast("bigint")
    size = F.when(n % 4 == 0, n * (1 << 30)).when(n % 4 == 1, n * (1 << 20)).when(n % 4 == 2, n)
    held = table(spark, d, "part").select("p_partkey", size.alias("n"))
    return held.select("p_partkey", records.human_bytes(F.col("n")).alias("plain"), records.human_limit(F.col("n")).alias("limit"), records.container_size(F.col("n")).alias("container"))


def bounded_logs(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut to 60 and to 5 bytes, with and without room for the mark."""
    rows = table(spark, d, "documents").select("doc_id", records.bounded_log(F.col("text"), 60).alias("a"), records.bounded_log(F.col("text"), 5).alias("b"))
    return rows.select("doc_id", F.sha2("a", 256).alias("marked_sha256"), F.octet_length("a").cast("bigint").alias("n_marked"), F.col("b").alias("short"))


def policy_limits(spark: SparkSession, d: str) -> DataFrame:
    """The numbers of each part's policy as rows of names and plain decimals."""
    held = policies(spark, d)
    return documents.flattened_rows(held.select("p_partkey", F.get_json_object(report.policy_texts(held), "$.models").alias("text")), "p_partkey", "text")


def float_sums(spark: SparkSession, d: str) -> DataFrame:
    """Sums of doubles over a wide range of magnitudes, as text of the exact double."""
    value = F.floor(F.col("l_extendedprice") * 8) * F.pow(F.lit(2.0), F.col("l_linenumber") * 6 - 40)
    rows = table(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_quantity") % 2 == 0, value).otherwise(-value).alias("v"))
    return records.exact_sums(rows, ["l_returnflag"], "v")


def generated_samples(spark: SparkSession, d: str) -> DataFrame:
    """A sample of seven modules for each supplier, with numbers up to that of the parts: seeds by name, lengths bounded by drawing again, repeated questions drawn with the next seed."""
    n, most = table(spark, d, "supplier").count(), table(spark, d, "part").agg(F.max("p_partkey")).first()[0]
    return generate.samples(spark, "easy", generate.demo_modules(int(most or 20)), n)


def clamped_heads(spark: SparkSession, d: str) -> DataFrame:
    """Scores clamped to [0, 1] in thousandths; logs of costs clamped to 50 and put in order, in millionths."""
    n = F.col("doc_id")
    held = table(spark, d, "documents").select("doc_id", *[((n * (7 + i) % 301 - 100) / 100.0).alias(f"s{i}") for i in range(3)], *[((n * (3 + 2 * i) % 161 - 80) / 1.0).alias(f"c{i}") for i in range(3)])
    scores, costs = routing.clamped_scores([F.col(f"s{i}") for i in range(3)], [F.col(f"c{i}") for i in range(3)])
    return held.select("doc_id", *[F.round(x * 1000).cast("bigint").alias(f"score_{i}") for i, x in enumerate(scores)], *[F.round(F.ln(x) * 1_000_000).cast("bigint").alias(f"cost_{i}") for i, x in enumerate(costs)])


def decimal_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", exact.decimal_text(F.col("p_retailprice").cast("decimal(14,4)")).alias("text"))


def model_multipliers(spark: SparkSession, d: str) -> DataFrame:
    """What each part's policy says of the models' costs against the light one's, times 10**12."""
    held = policies(spark, d)
    return held.select("p_partkey", *routing.multiplier_columns(held, MODELS, report.PUBLIC.light))


def tier_problems(spark: SparkSession, d: str) -> DataFrame:
    """Submissions by order status: two known tiers, one of them far too often, one missing, one unknown."""
    orders = table(spark, d, "orders").select(F.when(F.col("o_orderkey") == 1, "fast").when(F.col("o_orderstatus") == "O", "balanced").otherwise("slow").alias("tier"))
    return checks.tier_problems(orders, list(TIERS))


_IMAGES = ["reg.io/a/b§", "localhost:5000/a§", "a/b__c-d.e§", "a:latest", "A/b§", "a//b§", "reg.io:x/a§", "sha256:" + "0" * 64, "a_§", "a..b§"]
_GOOD_IMAGES = (0, 1, 2, 7)


def bad_images(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    image = F.element_at(F.array(*[F.lit(i.replace("§", "@sha256:" + "0" * 64)) for i in _IMAGES]), (n % len(_IMAGES) + 1).cast("int"))
    return checks.bad_images(table(spark, d, "documents").select("doc_id", image.alias("image")), "image").select("doc_id")


_PATHS = ["a/b", "/a", "a/../b", "a//b", "./.", "..", "a/./b", ""]
_SAFE_PATHS = (0, 3, 6)


def unsafe_paths(spark: SparkSession, d: str) -> DataFrame:
    path = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("doc_id") % len(_PATHS) + 1).cast("int"))
    return checks.unsafe_paths(table(spark, d, "documents").select("doc_id", path.alias("path")), "path").select("doc_id")


def nonzero_events(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose counters (line number by line) hold another number than zero; an order without lines counts too."""
    n = F.col("l_linenumber")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", n).agg(F.max(F.when(F.col("l_quantity") > 45, 1).otherwise(0)).alias("event"))
    counters = lines.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct(n, "event"))).alias("events"))
    held = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")).join(counters, "l_orderkey", "left")
    return checks.nonzero_events(held, "events").select("l_orderkey")


def split_folds(spark: SparkSession, d: str) -> DataFrame:
    """Rows and mean text length of each of five folds by position."""
    e = episodes(spark, d).select(F.pmod("pos", F.lit(5)).alias("fold"), F.length("text").alias("n"))
    return e.groupBy("fold").agg(F.count("*").alias("n"), F.sum("n").alias("n_chars"))


QUERIES = {
    f.__name__: f
    for f in (
        policy_digest, score_report, score_final_report, one_tier_report, header_problems, latency_report, warm_up_order, attempt_records, execution_records, check_tails, check_report, repetition_summary, overall_maxima, invalid_results,
        size_texts, bounded_logs, policy_limits, float_sums, generated_samples, clamped_heads, decimal_texts, model_multipliers, tier_problems, bad_images, unsafe_paths, nonzero_events, split_folds,
    )
}


def _text(units: str, places: int) -> str:
    """SQL for a count of units of 10**-places as plain decimal text."""
    return f"CASE WHEN {units} = 0 THEN '0' ELSE regexp_replace((({units})::HUGEINT // 1{'0' * places}::HUGEINT)::VARCHAR || '.' || lpad((({units})::HUGEINT % 1{'0' * places}::HUGEINT)::VARCHAR, {places}, '0'), '\\.?0+$', '') END"


_LOGGED = """
logged AS (
  SELECT *, event_id % 5 = 0 AS timed_out, event_id % 7 = 0 AS terminated, CASE WHEN event_id % 3 > 0 THEN event_id % 3 - 1 END AS returncode, 'ö' || event_id AS stdout, CASE WHEN event_id % 4 > 0 THEN repeat('e', event_id % 9) ELSE '' END AS stderr FROM log),
recorded AS (
  SELECT *, CASE WHEN kind = 'valid' THEN 'valid_submission' WHEN kind = 'fairness_violation' THEN 'fairness_review_required' WHEN cleanup_pending THEN 'operator_cleanup_pending' WHEN kind = 'infrastructure_failure' THEN 'operator_infrastructure_failure'
    WHEN timed_out THEN 'wall_time_limit_exceeded' WHEN terminated THEN 'operator_limit_terminated' WHEN coalesce(returncode, 0) <> 0 THEN 'participant_nonzero_exit' ELSE 'submission_validation_failure' END AS reason_code,
    strlen(stdout) AS stdout_bytes, sha256(stdout) AS stdout_sha256, strlen(stderr) AS stderr_bytes, sha256(stderr) AS stderr_sha256 FROM logged)"""

_HEAD = f"1::BIGINT AS schema_version, '{{kind}}' AS report_type, 'c' AS challenge_id, 'public' AS policy_id, '{report.policy_sha256()}' AS policy_sha256, 'train' AS split, 12::BIGINT AS score_decimal_places, 'ROUND_HALF_EVEN' AS score_rounding"
_POLICIES = """WITH p AS (
  SELECT p_partkey, price::DECIMAL(14,4) AS light_input, (price * 4)::DECIMAL(14,4) AS light_output, (price + size)::DECIMAL(14,4) AS middle_input, (price * 4 + size * 9)::DECIMAL(14,4) AS middle_output, (price * 6 + size)::DECIMAL(14,4) AS think_input,
    (price * 7)::DECIMAL(14,4) AS think_output FROM (SELECT p_partkey, p_retailprice::DECIMAL(10,2) AS price, p_size::DECIMAL(10,2) AS size FROM part))"""


def _rate(column: str) -> str:
    return f"regexp_replace({column}::VARCHAR, '\\.?0+$', '')"


def _half_even(n: str, d: str) -> str:
    n, d = f"(({n} * 10000)::HUGEINT * 1000000000000)", f"({d} * 10000)::HUGEINT"
    return f"({n} // {d} + (2 * ({n} % {d}) > {d} OR (2 * ({n} % {d}) = {d} AND {n} // {d} % 2 = 1))::INT)"


_POLICY_TEXT = (
    """'{"budget_warning_ratio":"0.95","context_limit_tokens":32768,"cost_unit":"credit","light_model_id":"light","models":{' || """
    + " || ',' || ".join(f"""'"{m}":{{"fixed_cost":"0","input_token_rate":"' || {_rate(f'{m}_input')} || '","output_token_rate":"' || {_rate(f'{m}_output')} || '"}}'""" for m in sorted(MODELS))
    + """ || '},"policy_id":"p' || p_partkey || '","schema_version":1,"tiers":{"balanced":{"budget_multiplier":"2","weight":"0.3"},"fast":{"budget_multiplier":"1.25","weight":"0.4"},"premium":{"budget_multiplier":"4","weight":"0.3"}},"token_unit":1000000}'"""
)
_PASSED = "CASE WHEN passed THEN {} ELSE 0 END"

SQL = {
    "policy_digest": _POLICIES + f" SELECT p_partkey, sha256({_POLICY_TEXT}) AS sha256 FROM p",
    "score_report": _with(_OUTCOMES, _FEATURES, _TIERS) + f"""
SELECT {_HEAD.format(kind=report.TIER_REPORT)}, tier, n_episodes AS num_episodes, n_light, n_middle, n_think, n_generations::BIGINT AS selected_generations, n_input::BIGINT AS selected_input_tokens, n_output::BIGINT AS selected_output_tokens,
  'credit' AS cost_unit, 1000000::BIGINT AS token_unit, {_text('light_nano', 9)} AS light_baseline_cost, CASE tier WHEN 'fast' THEN '1.25' WHEN 'balanced' THEN '2' ELSE '4' END AS budget_multiplier, {_text('light_nano * multiplier', 11)} AS budget_limit,
  {_text('total_nano', 9)} AS total_cost, {_text('ratio_e12', 12)} AS budget_ratio, passed AS budget_passed, near_budget, {_text('hundredths', 2)} AS quality_points_total, {_text('quality_e12', 12)} AS quality_score,
  {_text(_PASSED.format('hundredths'), 2)} AS tier_points_total, {_text(_PASSED.format('quality_e12'), 12)} AS tier_score, NOT passed AS over_budget_zero_applied FROM rounded""",
    "score_final_report": _with(_OUTCOMES, _FEATURES, _TIERS) + f""",
w AS (SELECT sum({_PASSED.format('hundredths')} * 10000 * weight * 100000)::HUGEINT AS p, max(n_episodes) AS n,
  string_agg(tier || ' ' || {_text(_PASSED.format('hundredths'), 2)} || ' ' || {_text(_PASSED.format('quality_e12'), 12)}, ';' ORDER BY tier) AS tiers FROM rounded),
f AS (SELECT *, p // n + (2 * (p % n) > n OR (2 * (p % n) = n AND p // n % 2 = 1))::INT AS s FROM w)
SELECT {_HEAD.format(kind=report.FINAL_REPORT)}, {_text('p', 12)} AS final_weighted_points_total, {_text('s', 12)} AS final_score, tiers, '{{"balanced":"0.3","fast":"0.4","premium":"0.3"}}' AS tier_weights FROM f""",
    "one_tier_report": _with(_OUTCOMES, _FEATURES, _TIERS) + f"""
SELECT tier, n_episodes AS num_episodes, {_text('ratio_e12', 12)} AS budget_ratio, passed AS budget_passed, {_text(_PASSED.format('quality_e12'), 12)} AS tier_score FROM rounded WHERE tier = 'balanced'""",
    "header_problems": """
WITH o AS (SELECT o_orderkey, o_orderkey % 50 = 0 AS two, o_orderstatus, o_orderpriority, coalesce(o_custkey % 3 > 0, false) AS public FROM orders)
SELECT o_orderkey, unnest(list_filter([CASE WHEN two THEN 'policy.schema_version' END, CASE WHEN two THEN 'outcomes.schema_version' END, CASE WHEN o_orderstatus <> 'O' THEN 'outcomes.split' END, CASE WHEN two THEN 'submission.schema_version' END,
  'submission.challenge_id', CASE WHEN NOT public THEN 'submission.policy_id' END, CASE WHEN o_orderkey % 2 = 0 AND o_orderpriority <> '1-URGENT' THEN 'submission.tier' END], lambda x: x IS NOT NULL)) AS field FROM o""",
    "latency_report": _with(_RUNS) + """,
lost AS (SELECT submission_id, count(*) FILTER (event_id % 7 = 0) AS discarded FROM runs GROUP BY 1),
t AS (
  SELECT submission_id, max(median_ns) FILTER (tier = 'fast') AS fast_ns, max(median_ns) FILTER (tier = 'balanced') AS balanced_ns, max(median_ns) FILTER (tier = 'premium') AS premium_ns FROM medians GROUP BY 1),
s AS (SELECT *, fast_ns + balanced_ns + premium_ns AS total_ns, (fast_ns + balanced_ns + premium_ns + 500) // 1000 * 1000 AS comparison_ns FROM t JOIN lost USING (submission_id))
SELECT submission_id, 'r/i@' || submission_id AS image, fast_ns, balanced_ns, premium_ns, discarded, total_ns, comparison_ns, CASE WHEN total_ns IS NOT NULL THEN rank() OVER (ORDER BY comparison_ns NULLS LAST) END AS rank FROM s
UNION ALL SELECT 'none', 'r/i@none', NULL, NULL, NULL, 0, NULL, NULL, NULL""",
    "warm_up_order": """
SELECT turn::INT AS turn, ((i - turn + n) % n)::BIGINT AS place, s_name AS submission_id FROM (SELECT s_name, row_number() OVER (ORDER BY s_name) - 1 AS i, count(*) OVER () AS n FROM supplier) CROSS JOIN range(3) t(turn)""",
    "attempt_records": _with(_LOG, _LOGGED) + " SELECT event_id, reason_code, stdout_bytes, stdout_sha256, stderr_bytes, stderr_sha256 FROM recorded",
    "execution_records": _with(_LOG, _LOGGED, _FOLD) + """,
numbered AS (
  SELECT *, row_number() OVER w AS seq, 1 + coalesce(sum((kind IN ('execution_failure', 'valid'))::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS attempt FROM recorded WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
history AS (
  SELECT user_id, sha256('[' || string_agg(format('{{"seq":{},"attempt":{},"kind":"{}","reason_code":"{}","stdout_bytes":{},"stdout_sha256":"{}"}}', seq, attempt, kind, reason_code, stdout_bytes, stdout_sha256), ',' ORDER BY seq) || ']') AS history_sha256 FROM numbered GROUP BY 1),
s AS (
  SELECT *, CASE WHEN state IN ('infrastructure_unavailable', 'disqualified', 'tier_score_zero') THEN state WHEN user_id % 4 = 1 THEN 'review_required' WHEN user_id % 4 = 2 THEN 'audit_inconclusive_infrastructure' WHEN user_id % 4 = 3 THEN 'audit_skipped' ELSE 'valid' END AS status FROM folded)
SELECT user_id, status, CASE WHEN status IN ('infrastructure_unavailable', 'audit_inconclusive_infrastructure') THEN 4 WHEN status IN ('review_required', 'audit_skipped') THEN 5 ELSE 0 END::BIGINT AS exit_code, attempts, infrastructure, history_sha256
FROM s JOIN history USING (user_id)""",
    "check_tails": """
WITH e AS (SELECT event_id, repeat('a', event_id % 5000) || event_id AS t FROM events)
SELECT event_id, event_id % 6 > 0 AS passed, CASE WHEN event_id % 4 > 0 THEN event_id * 1000000 / 1000000000 END AS elapsed_seconds, sha256(CASE WHEN length(t) > 4096 THEN right(t, 4096) ELSE t END) AS tail_sha256 FROM e""",
    "check_report": """
SELECT user_id, bool_and(event_id % 6 > 0) AS passed, max(CASE WHEN event_id % 4 > 0 THEN event_id * 1000000 / 1000000000 END) AS elapsed_seconds_max, count(*) AS n FROM events GROUP BY 1""",
    "repetition_summary": """
WITH l AS (SELECT l_orderkey, l_quantity::BIGINT AS q, l_linenumber::BIGINT AS n FROM lineitem)
SELECT l_orderkey, min(q / 4) AS elapsed_seconds_min, median(q / 4) AS elapsed_seconds_median, max(q / 4) AS elapsed_seconds_max, min(n / 8) AS cpu_seconds_min, median(n / 8) AS cpu_seconds_median, max(n / 8) AS cpu_seconds_max, max(q * 10) AS max_rss_bytes_max,
  max(n) AS processes_max, max(n + 1) AS threads_max, max(q + n) AS output_bytes_max, max(q) FILTER (n % 3 > 0) AS group_cpu_usage_usec_max, max(q * 2) FILTER (n % 3 > 0) AS group_nr_throttled_max, max(q * 3) FILTER (n % 3 > 0) AS group_throttled_usec_max,
  max(q * 4) FILTER (n % 3 > 0) AS group_memory_peak_bytes_max, max(q * 5) FILTER (n % 3 > 0) AS group_pids_peak_max FROM l GROUP BY 1""",
    "overall_maxima": "SELECT max(l_quantity::BIGINT / 4) AS elapsed_seconds, max(l_quantity::BIGINT * 10) AS max_rss_bytes, max(l_quantity::BIGINT + l_linenumber) AS output_bytes FROM lineitem",
    "invalid_results": "SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 3 = 0",
    "size_texts": """
WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_partkey * 1073741824 WHEN 1 THEN p_partkey * 1048576 WHEN 2 THEN p_partkey END AS n FROM part),
t AS (SELECT *, coalesce(printf('%.2f', n / 1048576) || ' MiB', 'not measured') AS plain FROM p)
SELECT p_partkey, plain, CASE WHEN n >= 1073741824 AND n % 1073741824 = 0 THEN printf('%.2f', n / 1073741824) || ' GiB' ELSE plain END AS "limit",
  CASE WHEN n % 1073741824 = 0 THEN n // 1073741824 || 'g' WHEN n % 1048576 = 0 THEN n // 1048576 || 'm' ELSE CAST(n AS VARCHAR) END AS container FROM t""",
    "policy_limits": _POLICIES + " SELECT p_partkey, unnest([" + ", ".join(f"'{m}__{n}'" for m in sorted(MODELS) for n in ("fixed_cost", "input_token_rate", "output_token_rate")) + "]) AS name, unnest(["
    + ", ".join(f"'0', {_rate(f'{m}_input')}, {_rate(f'{m}_output')}" for m in sorted(MODELS)) + "]) AS value FROM p",
    "clamped_heads": """
WITH v AS (SELECT doc_id, [least(1, greatest(0, (doc_id * (7 + i) % 301 - 100) / 100)) for i in range(3)] AS s, [least(50, greatest(-50, doc_id * (3 + 2 * i) % 161 - 80))::DOUBLE for i in range(3)] AS c FROM documents)
SELECT doc_id, round(s[1] * 1000)::BIGINT AS score_0, round(s[2] * 1000)::BIGINT AS score_1, round(s[3] * 1000)::BIGINT AS score_2, round(c[1] * 1e6)::BIGINT AS cost_0, round(greatest(c[1], c[2]) * 1e6)::BIGINT AS cost_1, round(greatest(c[1], c[2], c[3]) * 1e6)::BIGINT AS cost_2 FROM v""",
    "decimal_texts": r"SELECT p_partkey, regexp_replace(CAST(p_retailprice AS DECIMAL(14,4))::VARCHAR, '\.?0+$', '') AS text FROM part",
    "model_multipliers": _POLICIES + " SELECT p_partkey, " + ", ".join(f"greatest({_half_even(f'{m}_input', 'light_input')}, {_half_even(f'{m}_output', 'light_output')})::BIGINT AS {m}" for m in MODELS) + " FROM p",
    "tier_problems": """
WITH t AS (SELECT CASE WHEN o_orderkey = 1 THEN 'fast' WHEN o_orderstatus = 'O' THEN 'balanced' ELSE 'slow' END AS tier FROM orders), c AS (SELECT tier, count(*) AS n FROM t GROUP BY 1)
SELECT coalesce(k.tier, c.tier) AS tier, coalesce(n, 0) AS n FROM (VALUES ('fast'), ('balanced'), ('premium')) k(tier) FULL JOIN c USING (tier) WHERE k.tier IS NULL OR coalesce(n, 0) <> 1""",
    "bad_images": f"SELECT doc_id FROM documents WHERE doc_id % {len(_IMAGES)} NOT IN {_GOOD_IMAGES}",
    "unsafe_paths": f"SELECT doc_id FROM documents WHERE doc_id % {len(_PATHS)} NOT IN {_SAFE_PATHS}",
    "nonzero_events": """
SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
    "split_folds": "SELECT doc_id % 5 AS fold, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY 1",
    "float_sums": """
SELECT l_returnflag, (sum(CASE WHEN l_quantity % 2 = 0 THEN 1 ELSE -1 END * floor(l_extendedprice * 8)::HUGEINT * (2 ** (l_linenumber * 6))::HUGEINT)::DOUBLE / 1099511627776::DOUBLE) AS sum FROM lineitem GROUP BY 1""",
}


def _cut(text: str, n: int) -> str:
    """SQL for the longest head of whole characters within n bytes."""
    return f"array_to_string(list_transform(list_filter(range(1, {n} + 1), lambda i: i <= length({text}) AND strlen(left({text}, i)) <= {n}), lambda i: substr({text}, i, 1)), '')"


_MARK = records.CUT_MARK.replace("\n", "' || chr(10) || '")
SQL["bounded_logs"] = f"""
WITH d AS (SELECT doc_id, text, {_cut('text', 60 - len(records.CUT_MARK.encode()))} AS head, {_cut('text', 5)} AS five FROM documents),
m AS (SELECT *, CASE WHEN strlen(text) <= 60 THEN text ELSE head || '{_MARK}' END AS a FROM d)
SELECT doc_id, sha256(a) AS marked_sha256, strlen(a) AS n_marked, CASE WHEN strlen(text) <= 5 THEN text ELSE five END AS short FROM m"""
