"""Routing, scoring and their surroundings: goldens, independent computations, plans, SQL."""

from __future__ import annotations

import hashlib
import hmac
import json
import math
import random
import re
from collections import Counter
from decimal import ROUND_HALF_EVEN, Decimal, localcontext

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waybill.functions import exact, hashing, text
from waybill.operators import audit, checks, learn, learned, materialise, routing, scoring, stats
from waybill.operators.order import ranked
from waybill.plans import queries
from waybill.plans.catalog import QUERIES, SQL
from waybill.sources import documents

D = "/root/testdata/sf0.001"
EDGES = [
    "증명 하라. 증명하라 유도 분석", "x;\rdef f", "combining accent áb", "c² ½ ①", "\x1c\x1d a b　c", "PROVE ſelect K Only", "٣٤ 12 😀", "a ; b;\u0085", "스택　추적", "big-O bigoh", "",
    "Prove x^2 + 2*x + 1 = 0", "```python\ndef f(x):\n  return x;\n```", "Summarize exactly at least this list", "must only", "a" * 9000,
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(EDGES)], "episode_id string, text string")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    got, want = QUERIES[name](spark, D), con.sql(SQL[name])
    names = sorted(got.columns)
    assert sorted(want.columns) == names
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == Counter(want.select(*[duckdb.ColumnExpression(n) for n in names]).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, D).count() > 0


def test_features_equal_python(spark, edges):
    code = re.compile(r"```|(?:^|\s)(?:def|class|function|SELECT|FROM|import|#include)\b|[{};]\s*$", re.I | re.M)
    reasoning = re.compile(r"\b(?:prove|derive|reason|analyze|explain why|algorithm|complexity|증명|유도|추론|분석|알고리즘|복잡도)\b", re.I)
    got = {r["episode_id"]: r for r in text.with_features(edges).collect()}
    for i, t in enumerate(EDGES):
        r, solid = got[str(i)], max(1, sum(not c.isspace() for c in t))
        assert (r["n_chars"], r["n_code"], r["n_reasoning"]) == (len(t), len(code.findall(t)), len(reasoning.findall(t))), t
        assert r["numeric_density"] == len(re.findall(r"\d", t)) / solid and r["hangul_ratio"] == len(re.findall("[가-힣]", t)) / solid
        assert r["n_words"] == len(re.findall("[A-Za-z가-힣]+", t)) and r["n_sentences"] == max(1, len(re.findall("[.!?。！？]", t)))


def test_tokens_equal_python(edges):
    token = re.compile(r"[A-Za-z]+|[가-힣]+|\d+|[^\w\s]")
    for r in edges.select("text", text.tokens(F.col("text")).alias("t"), text.hashed_terms(text.tokens(F.col("text"))).alias("h")).collect():
        want = ["<number>" if x.isdecimal() else x.casefold() for x in token.findall(r["text"])]
        assert r["t"] == want and r["h"] == [f"w1:{x}" for x in want] + [f"w2:{a}\x1f{b}" for a, b in zip(want, want[1:])]


def test_complexity_and_rules(spark):
    messages = "hello\nhow are you\n```python\nprint(1)\n```"
    e = spark.createDataFrame([("1", "오늘 날씨 어때?", 1), ("2", "Prove x^2 + 2*x + 1 = (x + 1)^2.", 1), ("3", messages, 3)], "episode_id string, text string, n_messages int")
    got = {(r["episode_id"], r["tier"]): r["model_id"] for r in routing.rule_route(e).collect()}
    assert [got[i, "fast"] for i in "123"] == ["light", "middle", "middle"] and [got[i, "balanced"] for i in "123"] == ["light", "middle", "middle"]
    assert {got[i, "premium"] for i in "123"} == {"middle"}


def test_exact_quotient(spark):
    pairs = [(1, 3), (2, 3), (1, 8), (1234567890125, 10**13), (1234567890135, 10**13), (10**20, 7), (0, 5), (5, 5), (3, 2 * 10**12), (1, 2 * 10**12), (10**19 - 1, 3)]
    held = spark.createDataFrame([(Decimal(a), Decimal(b)) for a, b in pairs], "n decimal(24,0), d decimal(24,0)")
    got = [(int(r["q"]), r["s"]) for r in held.select(exact.quotient(F.col("n"), F.col("d")).alias("q"), exact.scaled_text(exact.quotient(F.col("n"), F.col("d"))).alias("s")).collect()]
    with localcontext() as c:
        c.prec = 160
        for (a, b), (q, s) in zip(pairs, got):
            want = (Decimal(a) / b).quantize(Decimal(10) ** -12, ROUND_HALF_EVEN)
            assert q == int(want * 10**12) and Decimal(s) == want and not s.endswith(".")


def test_decimal_grammar(spark):
    good, bad = ["0", "0.5", "12.30", "1" * 40, "0." + "1" * 30], ["0\n", "00.5", ".5", "1e-1", "-1", "1.", "1" * 41, "0." + "1" * 31, "", "1_0", None]
    held = spark.createDataFrame([(x,) for x in good + bad], "s string")
    assert [r[0] for r in held.select(exact.is_decimal(F.col("s"))).collect()] == [True] * len(good) + [False] * len(bad)
    assert [r[0] for r in spark.sql("SELECT CAST(x AS DECIMAL(10,4)) AS x FROM VALUES (1.5), (0), (10), (0.0010) t(x)").select(exact.decimal_text(F.col("x"))).collect()] == ["1.5", "0", "10", "0.001"]


def scores_of(spark, model, policy):
    out = [("e1", "light", "0.5", 1, 100, 20), ("e1", "middle", "0.7", 1, 100, 20), ("e2", "light", "0.5", 1, 100, 20), ("e2", "middle", "0.7", 1, 100, 20)]
    outcomes = spark.createDataFrame([(*r[:2], Decimal(r[2]), *r[3:]) for r in out], "episode_id string, model_id string, score decimal(10,2), num_generations bigint, input_tokens bigint, output_tokens bigint")
    decisions = spark.createDataFrame([(t, e, model) for t in policy.tiers for e in ("e1", "e2")], "tier string, episode_id string, model_id string")
    return scoring.tier_scores(decisions, outcomes, policy)


def test_budget_boundary_is_inclusive(spark):
    models = {"light": scoring.Rates("0", "1", "0"), "middle": scoring.Rates("0", "1.25", "0")}
    tight = scoring.Policy(models, {"fast": ("1.25", "0.4"), "balanced": ("1.249999999999999", "0.3"), "premium": ("4.0", "0.3")}, "light")
    got = {r["tier"]: r for r in scores_of(spark, "middle", tight).collect()}
    assert got["fast"]["passed"] and not got["balanced"]["passed"] and got["balanced"]["near_budget"] and not got["premium"]["near_budget"]
    assert got["fast"]["ratio_e12"] == 1_250_000_000_000 and got["balanced"]["score_e12"] == 0 and got["fast"]["quality_e12"] == 700_000_000_000
    final = scoring.final_score(scores_of(spark, "middle", tight)).first()
    assert final["score_e12"] == 490_000_000_000


def test_all_light(spark):
    got = scores_of(spark, "light", scoring.PUBLIC).collect()
    assert {(r["ratio_e12"], r["quality_e12"], r["passed"], r["n_light"]) for r in got} == {(10**12, 5 * 10**11, True, 2)}


def test_policy_arithmetic():
    assert scoring.nano("2.127", 10**6) == 2127
    with pytest.raises(ValueError):
        scoring.nano("0.0001", 10**6)
    assert routing.multipliers()["middle"] == Decimal("2.12725")
    text = json.dumps({"schema_version": 1, "policy_id": "p", "cost_unit": "c", "context_limit_tokens": 9, "light_model_id": "a", "models": {"a": {"input_token_rate": "1", "output_token_rate": "4"}}, "tiers": {"fast": {"budget_multiplier": "1.25", "weight": "0.9"}}})
    with pytest.raises(ValueError):
        documents.policy(text)
    assert documents.policy(text.replace('"0.9"', '"1"')).models["a"].fixed == "0"
    assert documents.digest({"b": 1, "a": "é"}) == hashlib.sha256('{"a":"é","b":1}'.encode()).hexdigest()
    for bad in ('{"a":1,"a":2}', '{"a":NaN}'):
        with pytest.raises(ValueError):
            documents.loads(bad)
    fine = scoring.Policy({"light": scoring.Rates("0.00000000001", "0.0001", "4")}, {"fast": ("1.25", "1")}, "light")
    assert scoring.places() == 9 and scoring.places(fine) == 11 and scoring.nano("0.0001", 10**6, 11) == 10
    with pytest.raises(ValueError):
        scoring.places(scoring.Policy({"light": scoring.Rates("0", "0.0000000000001", "4")}, {"fast": ("1.25", "1")}, "light"))


def test_budget_groups_skip_and_go_on(spark):
    # priorities 5 (weight 500+), 2 and 0: a group that does not fit is skipped and a later one still taken
    hard = "Prove and derive the theorem: x = 1 + 2. Traceback? " * 12
    e = spark.createDataFrame([("a", hard), ("b", "x = 1 + 2"), ("c", "plain words here")], "episode_id string, text string")
    got = {(r["episode_id"], r["tier"]): r["model_id"] for r in routing.budget_route(e).collect()}
    assert got["a", "fast"] == "light" and got["a", "premium"] == "middle"
    weights = {"a": len(hard), "b": 9, "c": 16}
    for tier, (m, _) in scoring.PUBLIC.tiers.items():
        cost = sum(w * (Decimal("2.12725") if got[k, tier] == "middle" else 1) for k, w in weights.items())
        assert cost <= sum(weights.values()) * Decimal(m) * Decimal("0.85") or all(got[k, tier] == "light" for k in weights)


def test_lagrangian_selection_against_a_scan(spark):
    r = np.random.default_rng(3)
    score, cost = r.random((200, 3)), np.sort(r.random((200, 3)) + 0.1, 1)
    rows = [(i, *map(float, score[i]), *map(float, cost[i])) for i in range(200)]
    held = spark.createDataFrame(rows, "id int, score_light double, score_middle double, score_think double, cost_light double, cost_middle double, cost_think double")
    names = ["light", "middle", "think"]
    got = {r["id"]: names.index(r["model_id"]) for r in routing.lagrangian_route(held, names, 1.6, 0.95).collect()}
    light = math.fsum(cost[:, 0])
    cap = light * 1.6 * 0.95

    def choose(p):
        return np.argmax(score - p * cost / light, 1)

    low, high = 0.0, 1.0
    while cost[np.arange(200), choose(high)].sum() > cap:
        low, high = high, high * 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (low, middle) if cost[np.arange(200), choose(middle)].sum() <= cap else (middle, high)
    assert [got[i] for i in range(200)] == choose(high).tolist()


def test_fill_golden(spark):
    rows = [(m, 0.1, 0.8, 0.9, 1.0, 2.0, 3.0) for m in ("light", "middle", "think")]
    held = spark.createDataFrame(rows, "model_id string, score_light double, score_middle double, score_think double, cost_light double, cost_middle double, cost_think double")
    got = [r["model_id"] for r in routing.filled_route(held, ["light", "middle", "think"], 4.0).collect()]
    assert sorted(got) == ["middle", "middle", "think"]
    with pytest.raises(ValueError):
        routing.filled_route(held, ["light", "middle", "think"], 4.0, 0.0)


def test_ties_take_the_earlier_model(spark):
    held = spark.sql("SELECT 1.0D AS a, 1.0D AS b, 0.5D AS c").select(routing.best_model([F.col("a"), F.col("b"), F.col("c")], ["x", "y", "z"]))
    assert held.first()[0] == "x"


def test_hashes_equal_python(spark):
    def fnv(s):
        h = 14695981039346656037
        for b in s.encode():
            h = (h ^ b) * 1099511628211 % 2**64
        return h

    words = ["", "a", "w1:the", "한글", "😀x", "w2:a\x1fb"]
    held = spark.createDataFrame([(w,) for w in words], "s string")
    for r in held.select("s", hashing.fnv1a(F.col("s")).alias("h"), hashing.signed_bin(F.col("s"), 64).alias("b"), hashing.audit_token(b"k", "d", F.lit(7), F.col("s")).alias("t"), hashing.generation_seed(F.lit(1), F.col("s")).alias("g")).collect():
        h = fnv(r["s"])
        assert r["h"]["high"] << 32 | r["h"]["low"] == h and (r["b"]["bin"], r["b"]["sign"]) == (h % 64, -1 if h >> 63 else 1)
        assert r["t"] == hmac.new(b"k", b"d" + (7).to_bytes(8, "big") + b"\0" + r["s"].encode(), "sha256").hexdigest()
        assert r["g"] == int.from_bytes(hashlib.sha256(("1\0" + r["s"]).encode()).digest()[:4], "big")
    with pytest.raises(ValueError):
        hashing.hmac_sha256(b"x" * 65, F.lit(b""))


def test_vectors_have_unit_bins(spark, edges):
    held = learn.sparse_vectors(edges, 32)
    for r in held.withColumn("features", learn.dense_form(F.col("at"), F.col("value"), 46)).collect():
        assert len(r["features"]) == 46 and r["at"] == sorted(set(r["at"])) and r["at"][:14] == list(range(14))
        assert all(r["features"][i] == v for i, v in zip(r["at"], r["value"], strict=True))
        norm = sum(x * x for x in r["features"][14:])
        assert abs(norm - 1) < 1e-9 or norm == 0
    with pytest.raises(ValueError):
        learn.check_bins(48)


def test_tiles_equal_the_whole_matrix(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(90, 40)) * (r.random((90, 40)) < 0.3)
    x[:, 7], x[11] = 0, 0
    y = r.normal(size=(90, 3))
    dense = [(i % 4, x[i].tolist(), y[i].tolist()) for i in range(90)]
    sparse = [(i % 4, np.flatnonzero(x[i]).tolist(), x[i][x[i] != 0].tolist(), y[i].tolist()) for i in range(90)]
    z = np.concatenate([np.ones((90, 1)), x, y], 1)
    frames = spark.createDataFrame(dense, "fold int, features array<double>, targets array<double>"), spark.createDataFrame(sparse, "fold int, at array<int>, value array<double>, targets array<double>")
    for frame in frames:
        for tile in (64, 44, 16, 7):
            held = learn.Moments(frame.repartition(3), 40, 3, 5, tile)
            for f in range(4):
                own = z[np.arange(90) % 4 == f]
                assert np.allclose(held[f], own.T @ own)
            assert not held[4].any() and np.allclose(held[None], z.T @ z)
    one, other = learn.fitted_dual(frames[1], 40, 3.0), learn.ridge(z.T @ z, 40, 3.0)
    assert all(np.allclose(a, b) for a, b in zip(one, other, strict=True))


def test_wide_bins_equal_numpy(spark):
    """16,384 bins: products in tiles, heads by the dual form, predictions from sparse rows."""
    r = random.Random(8)
    words = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    e = spark.createDataFrame([(str(i), " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(120)], "episode_id string, text string")
    n = 14 + 16384
    rows = learn.sparse_vectors(e, 16384).select("episode_id", F.pmod(F.col("episode_id").cast("int"), F.lit(2)).alias("fold"), "at", "value", F.array(F.size("at").cast("double"), F.col("episode_id").cast("double")).alias("targets")).cache()
    held = rows.collect()
    x, y = np.zeros((120, n)), np.array([h["targets"] for h in held])
    for i, h in enumerate(held):
        x[i, h["at"]] = h["value"]
    mean, scale, coef, intercept = learn.fitted_dual(rows, n, 2.0)
    s = x.std(0)
    s[s < 1e-12] = 1
    z = (x - x.mean(0)) / s
    want = z.T @ np.linalg.solve(z @ z.T + 2 * np.eye(120), y - y.mean(0))
    assert np.allclose(coef, want) and np.allclose(scale, s)
    tiles = learn.tiled_moments(learn.sparse_rows(rows, n), n + 3, 2048)
    full = np.concatenate([np.ones((120, 1)), x, y], 1)
    for t in tiles.filter("i = j or j = 8").collect():
        own = full[[h["fold"] == t["fold"] for h in held]]
        a, b = own[:, t["i"] * 2048 : (t["i"] + 1) * 2048], own[:, t["j"] * 2048 : (t["j"] + 1) * 2048]
        assert np.allclose(np.frombuffer(t["tile"]), (a.T @ b).ravel())
    got = {p["episode_id"]: (p["score_a"], p["cost_a"]) for p in learned.predictions(rows.withColumn("fold", F.lit(0)), {0: (mean, scale, coef / 100, intercept / 100)}, ("a",)).collect()}
    line = (x - mean) / scale @ coef / 100 + intercept / 100
    for i, h in enumerate(held):
        assert np.allclose(got[h["episode_id"]], (np.clip(line[i, 0], 0, 1), np.exp(np.clip(line[i, 1], -50, 50))))


def test_ridge_equals_numpy(spark):
    r = np.random.default_rng(1)
    x, w = r.normal(size=(120, 5)), r.normal(size=(5, 2))
    x[:, 4] = 3.0
    y = x @ w + r.normal(size=(120, 2)) * 0.1
    held = spark.createDataFrame([(i % 4, x[i].tolist(), y[i].tolist()) for i in range(120)], "fold int, features array<double>, targets array<double>").repartition(3)
    folds = learn.moments(held, 5, 2, 4)
    mean, scale, coef, intercept = learn.ridge(sum(m for _, m in folds), 5, 2.0)
    s = x.std(0)
    s[s < 1e-12] = 1
    z = (x - x.mean(0)) / s
    want = np.linalg.solve(z.T @ z + 2.0 * np.eye(5), z.T @ (y - y.mean(0)))
    assert np.allclose(coef[:4], want[:4]) and np.allclose(intercept, y.mean(0)) and np.allclose(scale[:4], s[:4])
    _, objective = learn.selected_alpha(folds, 5, 1, (1.0, 10.0))
    error = np.zeros(2)
    for f in range(4):
        own = np.arange(120) % 4 == f
        m, sc, c, b = learn.ridge(sum(folds[k][1] for k in range(4) if k != f), 5, 1.0)
        error += (((x[own] - m) / sc @ c + b - y[own]) ** 2).sum(0) / 120
    assert abs(objective[1.0] - (error[0] + 0.05 * error[1])) < 1e-9
    assert learn.safety_grid(0.5, 3) == [0.5, 0.75, 1.0]


def test_router_document_round_trip():
    from waybill.operators import learned

    n = 14 + 16
    router = learned.Router(16, ("a", "b"), np.zeros(n), np.ones(n), np.arange(n * 4.0).reshape(n, 4), np.arange(4.0), {"fast": 0.9}, "0" * 64, {"rows": 3})
    document = json.loads(json.dumps(router.document()))
    again = learned.parsed(document, ("fast",))
    assert np.array_equal(again.coefficients, router.coefficients) and again.document() == document
    for change in ({"hash_bins": 24}, {"more": 1}, {"schema_version": True}, {"feature_scale": [0.0] * n}, {"feature_mean": [math.inf] * n}, {"tier_safety_ratios": {"fast": 0}}, {"policy_sha256": "x"}):
        with pytest.raises(ValueError):
            learned.parsed({**document, **change}, ("fast",))


def test_latency_rank_and_median(spark):
    runs = spark.createDataFrame([("a", "fast", v, "ok") for v in (5, 1, 3, 2, 4)] + [("b", "fast", v, "ok") for v in (1, 2, 3)], "submission_id string, tier string, elapsed_ns bigint, kind string")
    assert {(r["submission_id"], r["median_ns"]) for r in stats.tier_medians(runs).collect()} == {("a", 3), ("b", None)}
    totals = spark.createDataFrame([("c", 111), ("a", 102), ("b", 104)], "submission_id string, total_ns bigint")
    assert [(r["submission_id"], r["comparison_ns"], r["rank"]) for r in stats.ranking(totals, 10).orderBy("rank", "submission_id").collect()] == [("a", 100, 1), ("b", 100, 1), ("c", 110, 3)]
    assert ["".join(r["submission_id"] for r in stats.rotated(totals.select("submission_id"), 3).filter(f"turn = {t}").orderBy("place").collect()) for t in range(3)] == ["abc", "bca", "cab"]
    failed = spark.createDataFrame([("execution_failure", 1), ("infrastructure_failure", 2), ("ok", 3)], "kind string, elapsed_ns bigint")
    assert sorted(r["elapsed_ns"] for r in stats.settled(failed).collect()) == [3, 90_000_000_000]


def test_latency_reads_all_events(spark):
    runs = {}
    for e in spark.read.parquet(f"{D}/events.parquet").select("event_id", "event_type", "value").collect():
        key = (f"s{e['event_id'] // 15}", ("fast", "balanced", "premium")[e["event_id"] // 5 % 3])
        runs.setdefault(key, []).append(90_000_000_000 if e["event_type"] == "error" else math.floor(abs(e["value"]) * 1000))
    want = {k: sorted(v)[2] if len(v) == 5 else None for k, v in runs.items()}
    assert sum(map(len, runs.values())) == 1000 and {(r["submission_id"], r["tier"]): r["median_ns"] for r in QUERIES["latency_medians"](spark, D).collect()} == want
    totals: dict = {}
    for (s, _), v in want.items():
        totals[s] = (totals.get(s, 0) or 0) + v if v is not None else totals.get(s)
    rounded = {s: None if v is None else (v + 500) // 1000 * 1000 for s, v in totals.items()}
    rank = {s: 1 + sum((b is None, b or 0) != (v is None, v or 0) and (b is None or (v is not None and b < v)) for b in rounded.values()) for s, v in rounded.items()}
    assert {r["submission_id"]: r["rank"] for r in QUERIES["tiebreak_rank"](spark, D).collect()} == rank


@pytest.mark.parametrize(
    ("kinds", "want"),
    [
        (["execution_failure", "valid"], ("valid", 2, 0, 2)),
        (["execution_failure"] * 3 + ["valid"], ("tier_score_zero", 3, 0, None)),
        (["fairness_violation", "valid"], ("disqualified", 0, 0, None)),
        (["infrastructure_failure"] * 3, ("infrastructure_unavailable", 0, 3, None)),
        (["infrastructure_failure", "execution_failure", "valid"], ("valid", 2, 1, 3)),
        (["execution_failure"], ("running", 1, 0, None)),
    ],
)
def test_retry_fold(spark, kinds, want):
    log = spark.createDataFrame([("r", i + 1, k, False) for i, k in enumerate(kinds)], "run string, seq bigint, kind string, cleanup_pending boolean")
    r = audit.retry_outcomes(log, "run").first()
    assert (r["state"], r["attempts"], r["infrastructure"], r["selected_seq"]) == want


def test_clean_up_pending_stops(spark):
    log = spark.createDataFrame([("r", 1, "infrastructure_failure", True), ("r", 2, "valid", False)], "run string, seq bigint, kind string, cleanup_pending boolean")
    assert audit.retry_outcomes(log, "run").first()["state"] == "infrastructure_unavailable"


def test_derangement(spark):
    for n in (1, 2, 3, 40):
        e = spark.createDataFrame([(f"e{i}", i) for i in range(n)], "episode_id string, pos bigint")
        got = audit.audit_map(e, b"a secret of 16 bytes").collect()
        assert sorted(r["audit_id"] for r in got) == sorted(r["original_id"] for r in got) and sorted(r["audit_pos"] for r in got) == list(range(n))
        assert n == 1 or all(r["audit_id"] != r["original_id"] for r in got)


def test_rank_over_partitions(spark):
    held = spark.range(1000).withColumn("k", F.sha2(F.col("id").cast("string"), 256)).repartition(7)
    got = {r["k"]: r["rank"] for r in ranked(held, ["k"]).collect()}
    assert [got[k] for k in sorted(got)] == list(range(1000))


def test_materialise(spark):
    a = spark.createDataFrame([("train-1", 0)], "episode_id string, pos bigint")
    b = spark.createDataFrame([("dev-1", 0)], "episode_id string, pos bigint")
    assert [r["episode_id"] for r in materialise.union_in_order(a, b).orderBy("pos").collect()] == ["train-1", "dev-1"]
    rows = spark.createDataFrame([("x", 1, "id-1", "one", "1"), ("x", 2, "id-2", "two", "2"), ("y", 1, "id", "tab\there", "3")], "regime string, pos bigint, sample_id string, problem string, answer string")
    got = {r["regime"]: r for r in materialise.table_bytes(rows, ["regime"]).collect()}
    assert got["x"]["content"] == "id-1\tone\t1\nid-2\ttwo\t2" and got["x"]["valid"] and not got["y"]["valid"]
    assert documents.flattened({"b": {"x": 1}, "a": 2}) == {"a": 2, "b__x": 1}


def test_strict_documents(spark):
    good = {"schema_version": 1, "challenge_id": "c", "split": "s", "episodes": [{"episode_id": "a", "prompt": "p"}, {"episode_id": "b", "messages": [{"role": "user", "content": "x"}]}]}

    def broken(**changes):
        return json.dumps({**good, **changes})

    cases = {
        "good": json.dumps(good), "twice": '{"schema_version":1,"schema_version":1}', "nan": '{"a":NaN}', "unknown": broken(more=1), "bool": broken(schema_version=True), "float": broken(schema_version=1.0),
        "empty": broken(episodes=[]), "both": broken(episodes=[{"episode_id": "a", "prompt": "p", "messages": []}]), "role": broken(episodes=[{"episode_id": "a", "messages": [{"role": "robot", "content": "x"}]}]),
        "same": broken(episodes=[{"episode_id": "a", "prompt": "p"}, {"episode_id": "a", "prompt": "q"}]), "null": broken(split=None),
    }
    docs = spark.createDataFrame(list(cases.items()), "path string, text string")
    got = {}
    for r in documents.problems(docs, "input").collect():
        got.setdefault(r["path"], set()).add(r["rule"])
    assert "good" not in got
    want = {"twice": "json", "nan": "json", "unknown": "unknown_keys", "bool": "schema_version", "float": "schema_version", "empty": "episodes", "both": "prompt_or_messages", "role": "messages", "same": "repeated_episode", "null": "split"}
    assert {k: v in got.get(k, set()) for k, v in want.items()} == dict.fromkeys(want, True)
    e = documents.episodes(docs.filter("path = 'good'")).orderBy("pos").collect()
    assert [(r["episode_id"], r["prompt"]) for r in e] == [("a", "p"), ("b", None)] and e[1]["messages"][0]["role"] == "user"
    out = json.dumps({"schema_version": 1, "challenge_id": "c", "split": "s", "episodes": [{"episode_id": "a", "models": {"m": {"score": "0.25", "num_generations": 1, "input_tokens": 2, "output_tokens": 3}}}]})
    r = documents.outcomes(spark.createDataFrame([("o", out)], "path string, text string")).first()
    assert (r["episode_id"], r["model_id"], r["score"], r["output_tokens"]) == ("a", "m", Decimal("0.25"), 3)


def test_file_sources(spark, tmp_path):
    from waybill.sources import files

    spark.createDataFrame([(7, "p", "x")], "id bigint, problem string, other string").write.parquet(str(tmp_path / "p"))
    assert files.parquet_problems(spark, str(tmp_path / "p")).collect() == [("7", "p")]
    (tmp_path / "j.jsonl").write_text('{"id": 1, "problem": "a\\fb\\tc"}\n{"id": "2", "problem": "d"}\n')
    assert sorted(map(tuple, files.jsonl_problems(spark, str(tmp_path / "j.jsonl")).collect())) == [("1", "a\\fb\\tc"), ("2", "d")]
    (tmp_path / "s.tsv").write_text("id-1\tone\t1\nid-2\ttwo\t2")
    assert sorted(map(tuple, files.tsv_samples(spark, str(tmp_path / "s.tsv")).collect())) == [("id-1", "one", "1"), ("id-2", "two", "2")]
    (tmp_path / "cg").write_text("oom 0\noom_kill 3\n")
    assert {r["key"]: r["value"] for r in files.key_values(spark, str(tmp_path / "cg")).collect()} == {"oom": 0, "oom_kill": 3}
    pins = {"schema_version": 1, "sources": [{"source_id": "s", "source_type": "hub", "revision": "r/1", "repo_id": "o/n", "files": [{"path": "a b/c.txt", "sha256": "0" * 64}, {"path": "d", "sha256": "1" * 64, "url": "https://x.y/d"}]}]}
    (tmp_path / "pins.json").write_text(json.dumps(pins))
    got = files.source_files(spark, str(tmp_path / "pins.json"))
    assert {r["path"]: r["url"] for r in files.with_urls(got, "https://host", "datasets").collect()} == {"a b/c.txt": "https://host/datasets/o/n/resolve/r%2F1/a%20b/c.txt", "d": "https://x.y/d"}
    digest = hashlib.sha256((tmp_path / "cg").read_bytes()).hexdigest()
    pinned = spark.createDataFrame([("cg", digest), ("s.tsv", "0" * 64), ("gone", digest)], "name string, sha256 string")
    assert {r["name"]: r["status"] for r in files.verified(spark, str(tmp_path), pinned).collect()} == {"cg": "ok", "s.tsv": "hash_mismatch", "gone": "missing"}


def test_checks(spark):
    urls = spark.createDataFrame([("https://a.b/c",), ("http://a.b",), ("https://u@a.b/",), ("https://a.b/#x",), (None,)], "u string")
    assert checks.unsafe_urls(urls, "u").count() == 2
    paths = spark.createDataFrame([("a/b",), ("/a",), ("a/../b",), ("a//b",), ("./.",), ("",)], "p string")
    assert checks.unsafe_paths(paths, "p").count() == 4
    d = "@sha256:" + "0" * 64
    good, bad = ["reg.io/a/b" + d, "localhost:5000/a" + d, "a/b__c-d.e" + d, "sha256:" + "0" * 64], ["a:latest", "A/b" + d, "a//b" + d, "reg.io:x/a" + d, "a" * 400 + d, "a" + d + "\n"]
    images = spark.createDataFrame([(i,) for i in good + bad], "i string")
    assert {r["i"] for r in checks.bad_images(images, "i").collect()} == set(bad)
    subs = spark.createDataFrame([("fast",), ("fast",), ("odd",)], "tier string")
    assert {(r["tier"], r["n"]) for r in checks.tier_problems(subs, ["fast", "balanced"]).collect()} == {("fast", 2), ("balanced", 0), ("odd", 1)}
    heads = spark.createDataFrame([(1, "a"), (1, "b")], "v int, c string")
    assert [r["field"] for r in checks.differing_headers(heads, ["v", "c"]).collect()] == ["c"]
    with pytest.raises(checks.Violation):
        checks.require(checks.duplicates(subs, ["tier"]), "tiers are unique")
    events = spark.createDataFrame([({"oom": 0},), ({"oom": 1},), (None,)], "m map<string,int>")
    assert checks.nonzero_events(events, "m").count() == 2 and checks.wrong_count(subs, 3).count() == 0


def test_plans_stay_in_the_jvm(spark):
    for name in ("rule_route", "features", "score_tiers"):
        plan = QUERIES[name](spark, D)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan, name
    # terms are hashed in Arrow batches, where FNV-1a costs a third of what it does as an expression; nothing is shuffled
    plan = QUERIES["term_bins"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "hashpartitioning" not in plan
    plan = QUERIES["outcome_cost"](spark, D)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan


def test_partitioning_does_not_change_routes(spark, edges):
    want = Counter(map(tuple, routing.rule_route(edges).collect()))
    for n in (1, 4, 16):
        assert Counter(map(tuple, routing.rule_route(edges.repartition(n)).collect())) == want


def test_streaming_routes(spark, edges, tmp_path):
    from waybill.streaming import routed_stream

    edges.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(edges.schema).parquet(str(tmp_path / "in"))
    query = routed_stream(stream).writeStream.format("memory").queryName("routes").start()
    query.processAllAvailable()
    query.stop()
    assert Counter(map(tuple, spark.table("routes").collect())) == Counter(map(tuple, routing.rule_route(edges).collect()))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3 and set(e.oracle_sql()) <= set(e.queries())


def test_budgets_of_equal_tiny_and_huge_costs(spark):
    """Models of equal cost, costs of 1e21 and of 1e-20: no error, no sum that overflows or vanishes."""
    rows = [(str(i), 0.1 + i % 3 / 10, 0.5, 1.0, 1.0) for i in range(20)]
    shape = "episode_id string, score_a double, score_b double, cost_a double, cost_b double"
    routed = routing.lagrangian_route(spark.createDataFrame(rows, shape), ["a", "b"], 1.0, 1.0).withColumn("model_id", F.lit("a"))
    assert {r["model_id"] for r in routing.filled_route(routed, ["a", "b"], 1.0).collect()} == {"b"}
    flat = routed.withColumn("score_b", F.col("score_a"))
    assert {r["model_id"] for r in routing.filled_route(flat, ["a", "b"], 1.0).collect()} == {"a"}
    want = None
    for unit in (1.0, 2.0**72, 2.0**-66):  # powers of two, so that no quotient is rounded otherwise
        held = spark.createDataFrame([(str(i), 0.2, 0.2 + i % 7 / 10, unit * (1 + i % 5), unit * (2 + i % 11 + i % 5)) for i in range(3000)], shape)
        got = {r["episode_id"]: r["model_id"] for r in routing.filled_route(routing.lagrangian_route(held, ["a", "b"], 2.0, 0.9), ["a", "b"], 2.0).collect()}
        assert 100 < sum(m == "b" for m in got.values()) < 2900
        want = want or got
        assert got == want, unit


def test_scans_and_medians_over_split_keys(spark):
    """Running sums and middles of keys that span many partitions, of small, null and tied ones, against Python."""
    from waybill.operators.order import medians, running

    r = random.Random(6)
    rows = [(r.choice([1, 1, 1, 1, 2, 3, None, *range(10, 20)]), i, r.randint(-3, 50), r.choice([None, *range(40)])) for i in range(6000)]
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "k int, at int, x int, v int").repartition(9)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = {x["at"]: (x["n"], x["total"]) for x in running(frame, ["k"], ["at"], {"n": F.lit(1), "total": F.col("x")}).collect()}
        sums = {}
        for k, at, x, _ in sorted(rows, key=lambda t: t[1]):
            n, total = sums.get(k, (0, 0))
            sums[k] = n + 1, total + x
            assert got[at] == sums[k]
        assert len(got) == 6000
        found = {x["k"]: x for x in medians(frame, ["k"], "v").collect()}
        for k in {t[0] for t in rows}:
            own = sorted(v for key, _, _, v in rows if key == k and v is not None)
            assert (found[k]["n"], found[k]["least"], found[k]["low"], found[k]["high"], found[k]["most"]) == (len(own), own[0], own[(len(own) - 1) // 2], own[len(own) // 2], own[-1])
        one = medians(frame, [], "at").collect()
        assert [tuple(x) for x in one] == [(6000, 0, 2999, 3000, 5999)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert running(frame.limit(0), ["k"], ["at"], {"n": F.lit(1)}).count() == 0 and medians(frame.limit(0), ["k"], "v").count() == 0


def test_policy_text_of_the_public_rates(spark):
    from waybill.operators import report

    rates = {f"{m}_{k}": Decimal(getattr(r, k)) for m, r in scoring.PUBLIC.models.items() for k in ("input", "output")}
    frame = spark.createDataFrame([(scoring.PUBLIC.policy_id, *rates.values())], "policy_id string, " + ", ".join(f"{c} decimal(14,6)" for c in rates))
    assert frame.select(report.policy_texts(frame).alias("t")).first()["t"] == documents.canonical(report.policy_document())
    up = frame.select(*routing.multiplier_columns(frame, list(scoring.PUBLIC.models), scoring.PUBLIC.light)).first()
    assert {m: Decimal(up[m]).scaleb(-12) for m in scoring.PUBLIC.models} == routing.multipliers()
    with pytest.raises(checks.Violation):
        report.guarded(None, None, None, headers=({"schema_version": 1, "challenge_id": "c", "split": "a"}, {"schema_version": 1, "challenge_id": "c", "split": "b"}, []))


ODD = ["", None, "abc DEF가나다 12٣4 x_y", "é a1b2 ⒶⒷ Ⓩ😀😀 =+-*/^∑ . ! 。？", "\x1c\x85\u2028\u3000 a\u00a0b", "reaſon PROVE Kelvin EXAMPLE", "ſummarıze lıst; \nlIst};\t\n\n", "\\\\frac{1}{2} \\sums \\int_ \\sqrt", "if x {\n return;  \n}\n```py\nimport a\nfrom b", "only without 증명 시간 복잡도 Big-O", "가a나1다", "x" * 3000 + " 一二三 Ⅷ ½ ２０"]


def test_characters_in_batches_match_the_patterns(spark, monkeypatch):
    """Counts, marks and tokens by bytes against the patterns in the JVM, on odd texts in blocks of one and of many; a mark never hides a match."""
    from waybill.functions import marks

    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(ODD)], "episode_id string, text string")
    c = F.col("text")
    want = {"n_words": text.WORD, "n_stops": text.SENTENCE_END, "n_hangul": text.HANGUL, "n_digits": text.DIGIT}
    patterns = {"code": text.CODE, "reasoning": text.REASONING, "formal": text.FORMAL, "program": text.PROGRAM, "constraint": text.CONSTRAINT, "transform": text.TRANSFORM}
    plain = {n: text.count(c, p) for n, p in {**want, **patterns, "maths": text.MATHS}.items()}
    held = rows.select("episode_id", *[v.alias(n) for n, v in plain.items()], text.nonspace(c).alias("solid"), text.tokens(c).alias("tokens")).collect()
    got = {r["episode_id"]: r for r in text.with_features(rows).withColumns({f"w_{n}": text.count_where(n, p) for n, p in patterns.items()}).collect()}
    for r in held:
        g = got[r["episode_id"]]
        assert [g["_marks"][n] for n in want] == [r[n] for n in want], r
        assert [g[f"w_{n}"] for n in patterns] == [r[n] for n in patterns], r
        assert (g["n_maths"], g["n_chars"] and g["n_chars"] - g["_marks"]["n_blanks"]) == (r["maths"], g["n_chars"] and r["solid"]), r
    for size in (1, 1 << 20):
        monkeypatch.setattr(marks, "BYTES_AT_ONCE", size)
        data, at = marks.bytes_of(pa.array(ODD))
        found = []
        for a, b in marks.blocks(at):
            low, start, end, row = marks.tokens(data[at[a] : at[b]], at[a : b + 1] - at[a])
            found += [[low[s:e].tobytes().decode() for s, e, k in zip(start, end, row) if k == i] for i in range(b - a)]
        assert found == [r["tokens"] or [] for r in held]


def test_dense_rows_match_the_form_by_places(spark):
    vectors = learn.sparse_vectors(spark.createDataFrame([(str(i), t or "") for i, t in enumerate(ODD)], "episode_id string, text string"), 32)
    want = {r[0]: r[1] for r in vectors.select("episode_id", learn.dense_form(F.col("at"), F.col("value"), 46)).collect()}
    assert {r["episode_id"]: r["features"] for r in learn.dense_rows(vectors, 46).collect()} == want
    plan = queries.vectors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_arrays" not in plan


def test_ridge_by_tiles_of_a_matrix_that_nobody_holds(spark, monkeypatch):
    """The heads of ``ridge`` without the matrix of moments in the driver; targets in one block and across two."""
    r = np.random.default_rng(5)
    for n_features, tile in ((37, 16), (45, 16), (10, 64)):
        x = r.normal(size=(200, n_features)) * (r.random((200, n_features)) < 0.3)
        x[:, 4] = 0
        y = r.normal(size=(200, 6)) + x[:, :6]
        rows = spark.createDataFrame([(0, a.tolist(), b.tolist()) for a, b in zip(x, y)], "fold int, features array<double>, targets array<double>")
        want = learn.ridge(learn.Moments(rows, n_features, 6, 1)[None], n_features, 1.0)
        with monkeypatch.context() as m:
            m.setattr(learn, "assembled", None)
            m.setattr(learn, "ridge", None)
            got = learn.ridge_tiled(rows, n_features, 6, 1.0, tile)
        for a, b in zip(got, want):
            assert np.allclose(a, b, atol=1e-9)


def test_ridge_by_tiles_sends_strips(spark, monkeypatch):
    """Several passes over the rows, long and short ones, and tiles of which no row of a table holds more than a strip."""
    r = np.random.default_rng(6)
    x = r.normal(size=(150, 45)) * (r.random((150, 45)) < np.where(np.arange(150) % 3, 0.04, 0.6)[:, None])
    y = r.normal(size=(150, 2)) + x[:, :2]
    rows = [(0, np.flatnonzero(a).tolist(), a[a != 0].tolist(), b.tolist()) for a, b in zip(x, y, strict=True)]
    rows = spark.createDataFrame(rows, "fold int, at array<int>, value array<double>, targets array<double>").repartition(5)
    z = (x - x.mean(0)) / np.where(x.std(0) < 1e-12, 1, x.std(0))
    want = np.linalg.solve(z.T @ z + np.eye(45), z.T @ (y - y.mean(0)))
    monkeypatch.setattr(learn, "STRIP", 3 * 16 * 8)
    monkeypatch.setattr(learn, "PASS", 2 * 16 * 16 * 8)
    sizes, keep = [], learn.written

    def watched(df, name):
        out = keep(df, name)
        sizes.extend(x[0] or 0 for x in (out.select(F.max(F.octet_length(c))).first() for c in ("part", "tile") if c in out.columns))
        return out

    monkeypatch.setattr(learn, "written", watched)
    got = learn.ridge_tiled(rows, 45, 2, 1.0, 16)
    assert np.allclose(got[2], want, atol=1e-9) and np.allclose(got[3], y.mean(0))
    assert len(sizes) > 5 and max(sizes) <= 3 * 16 * 8


def test_narrow_moments_are_added_up_where_the_rows_are(spark, monkeypatch):
    """One tile: tasks send a matrix for each fold, in strips, and no entries; also with more folds than a task may hold."""
    rng = np.random.default_rng(11)
    z = np.where(rng.random((400, 30)) < 0.6, rng.normal(size=(400, 30)), 0.0)
    rows = [(i % 7, [int(k) for k in np.flatnonzero(r[:27])], [float(v) for v in r[:27] if v != 0], [float(v) for v in r[27:]]) for i, r in enumerate(z)]
    frame = spark.createDataFrame(rows, "fold int, at array<int>, value array<double>, targets array<double>").repartition(3)
    full = np.concatenate([np.ones((400, 1)), z], 1)
    monkeypatch.setattr(learn, "tiled_moments", None)
    for strip, sums in ((1 << 18, 1 << 26), (500, 8 * 31 * 31 * 2)):
        monkeypatch.setattr(learn, "STRIP", strip)
        monkeypatch.setattr(learn, "SUMS", sums)
        held = learn.Moments(frame, 27, 3, 7)
        for f in range(7):
            assert np.allclose(held[f], full[f::7].T @ full[f::7])
        assert np.allclose(held[None], full.T @ full)


def test_predictions_of_all_folds_at_once(spark):
    rng = np.random.default_rng(12)
    heads = {f: (rng.normal(size=9), 1 + rng.random(9), rng.normal(size=(9, 4)) / 9, rng.random(4)) for f in (0, 2, 5)}
    x = np.where(rng.random((60, 9)) < 0.5, rng.random((60, 9)), 0.0)
    folds = [(0, 2, 5)[i % 3] for i in range(60)]
    rows = [(str(i), folds[i], [int(k) for k in np.flatnonzero(r)], [float(v) for v in r if v], i * 0.5) for i, r in enumerate(x)]
    frame = spark.createDataFrame(rows, "episode_id string, fold int, at array<int>, value array<double>, truth double")
    for r in learned.predictions(frame, heads, ("a", "b"), "truth").collect():
        i = int(r["episode_id"])
        mean, scale, coef, intercept = heads[folds[i]]
        want = (x[i] - mean) / scale @ coef + intercept
        assert np.allclose([r["score_a"], r["score_b"], r["cost_a"]], [*np.clip(want[:2], 0, 1), np.exp(want[2])]) and r["truth"] == i * 0.5
    with pytest.raises(Exception, match="no heads for folds"):
        learned.predictions(frame.withColumn("fold", F.lit(1)), heads, ("a", "b")).collect()


def test_a_budget_looks_at_one_block_of_steps(spark, monkeypatch):
    from waybill.operators import curve

    monkeypatch.setattr(curve, "BLOCK", 16)
    falls = [Decimal((i * 37) % 11 + 1) for i in range(1, 1500)]
    steps = spark.createDataFrame([(0.0, sum(falls) + 5), *((float(i), -f) for i, f in enumerate(falls, 1))], f"at double, cost {curve.SUM}")
    held = curve.Curve(steps, ["cost"])
    assert held.totals.groupBy("part", "block").count().agg(F.max("count")).first()[0] <= 16
    totals = [sum(falls) + 5]
    for f in falls:
        totals.append(totals[-1] - f)
    caps = {str(k): Decimal(k) for k in (3, 5, 6, 100, 777, 4000, 8999, int(totals[0]), 10**6)}
    want = {k: next(((float(i), t) for i, t in enumerate(totals) if t <= cap), None) for k, cap in caps.items()}
    got = held.first_fitting(caps)
    assert {k: (got[k]["at"], got[k]["cost"]) if k in got else None for k in caps} == want


def test_phrases_are_counted_in_batches(spark):
    """Counts in batches are those of the patterns, also beside other letters and behind other matches; plain texts are not left to the patterns."""
    plain = ["only a must; and AT LEAST\n", "def f():\n  x = {\n}\nimport a ``` class", "Prove it, derive it. big-O exception", "summarise commonly mustard _list"]
    patterns = {"code": text.CODE, "reasoning": text.REASONING, "formal": text.FORMAL, "program": text.PROGRAM, "constraint": text.CONSTRAINT, "transform": text.TRANSFORM}
    bits = [*"explain,why,at least,at most,Only,must,big o,bigo,prove,lemma,list,rewrite,def,class,#include,```,{,},;,é,가,증명,시간,복잡도,이상,ſ,K,İ,ı,_,1,., ,　,\x1c,\x85,½,́,😀".split(","), " ", " ", "\n", "\r\n", "\ndef", "muſt"]
    rng = np.random.default_rng(13)
    odd = ["".join(bits[k] for k in rng.integers(0, len(bits), 9)) for _ in range(3000)]
    odd += ["```def", " def#include", "\n``` def", "must must only", "mustonly", "only가", "é only", "; \n;\n\n}", None]
    c = F.col("text")
    held = text.with_marks(spark.createDataFrame([(t,) for t in plain + odd], "text string"))
    wrong = [~text.count_where(n, p).eqNullSafe(text.count(c, p)) | ~text.has_where(n, p).eqNullSafe(text.has(c, p)) for n, p in patterns.items()]
    for w in wrong:
        assert held.filter(w).count() == 0
    for r in held.filter(c.isin(plain)).collect():
        assert not any(r["_marks"][n] for n in patterns), r


def test_bins_of_both_ways_agree():
    """Few bins are counted in a table, many are sorted; the low bits of the latter are the former."""
    column = pa.array([*ODD, "a b a b c " * 50])

    def sums(bins):
        out = {}
        for a, b, bounds, key, count in learn.binned(column, bins):
            for i in range(b - a):
                for k, n in zip(key[bounds[i] : bounds[i + 1]].tolist(), count[bounds[i] : bounds[i + 1]].tolist(), strict=True):
                    out[a + i, k % 16] = out.get((a + i, k % 16), 0) + n
        return out

    assert sums(16) == sums(16384) and len(sums(16)) > 20
