"""Reports, records, safety ratios, generated samples: guards, goldens and independent computations."""

from __future__ import annotations

import hashlib
import json
import math
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from waybill.operators import checks, curve, generate, learn, learned, records, report, routing, scoring
from waybill.sources import selections

MODELS = ["light", "middle", "think"]
HEADER = {"schema_version": 1, "challenge_id": "c", "split": "train"}


def outcome_rows(ids, score=lambda e, m: Decimal("0.25")):
    return [(e, m, score(e, m), 1, 100 + 7 * i, 20 + 3 * i) for i, e in enumerate(ids) for m in MODELS]


OUTCOME = "episode_id string, model_id string, score decimal(10,2), num_generations bigint, input_tokens bigint, output_tokens bigint"


@pytest.fixture(scope="module")
def small(spark):
    ids = [f"e{i}" for i in range(6)]
    episodes = spark.createDataFrame([(e,) for e in ids], "episode_id string")
    outcomes = spark.createDataFrame(outcome_rows(ids), OUTCOME)
    decisions = spark.createDataFrame([(t, e, "light") for t in scoring.PUBLIC.tiers for e in ids], "tier string, episode_id string, model_id string")
    return episodes, outcomes, decisions


def test_report_of_all_light(small):
    episodes, outcomes, decisions = small
    report.guarded(*small)
    got = report.tier_reports(decisions, outcomes, HEADER)
    assert len(got.columns) == 28
    r = {x["tier"]: x for x in got.collect()}["fast"]
    cost = sum(Decimal(100 + 7 * i) / 10**6 + Decimal(4 * (20 + 3 * i)) / 10**6 for i in range(6))
    assert Decimal(r["light_baseline_cost"]) == cost == Decimal(r["total_cost"]) and Decimal(r["budget_limit"]) == cost * Decimal("1.25")
    assert (r["budget_ratio"], r["quality_score"], r["tier_points_total"], r["over_budget_zero_applied"], r["model_counts"]["light"]) == ("1", "0.25", "1.5", False, 6)
    final = report.final_report(decisions, outcomes, HEADER).first()
    assert (final["final_score"], final["final_weighted_points_total"], final["tiers"]["premium"]["tier_score"]) == ("0.25", "1.5", "0.25")


def test_fine_rates_are_exact(small):
    _, outcomes, decisions = small
    fine = scoring.Policy({m: scoring.Rates("0.00000000001", "0.0001", str(i + 1)) for i, m in enumerate(MODELS)}, scoring.PUBLIC.tiers, "light")
    r = report.tier_reports(decisions, outcomes, HEADER, fine).first()
    assert Decimal(r["total_cost"]) == sum(Decimal("0.00000000001") + Decimal("0.0001") * (100 + 7 * i) / 10**6 + Decimal(20 + 3 * i) / 10**6 for i in range(6))


def test_missing_outcomes_are_seen(small):
    episodes, outcomes, decisions = small
    lacking = outcomes.filter("NOT (episode_id = 'e1' AND model_id = 'light')")
    assert {r["complete"] for r in scoring.tier_scores(decisions, lacking).collect()} == {False}
    final = scoring.final_score(scoring.tier_scores(decisions, lacking)).first()
    assert final["points_e12"] is None and final["score_e12"] is None
    for broken in (
        (episodes, lacking, decisions), (episodes, outcomes.unionByName(outcomes.limit(1)), decisions), (episodes, outcomes, decisions.filter("tier <> 'fast'")), (episodes, outcomes, decisions.filter("episode_id <> 'e2'")),
        (episodes, outcomes, decisions.unionByName(decisions.limit(1))), (episodes.limit(3), outcomes, decisions),
    ):
        with pytest.raises(checks.Violation):
            report.guarded(*broken)
    free = scoring.Policy({m: scoring.Rates("0", "0", "0") for m in MODELS}, scoring.PUBLIC.tiers, "light")
    assert scoring.final_score(scoring.tier_scores(decisions, outcomes, free), free).first()["score_e12"] is None
    assert scoring.final_score(scoring.tier_scores(decisions.filter("tier <> 'fast'"), outcomes)).first()["score_e12"] is None
    uneven = decisions.filter("NOT (tier = 'fast' AND episode_id = 'e0')")
    assert scoring.final_score(scoring.tier_scores(uneven, outcomes)).first()["score_e12"] is None


def test_policy_form():
    long = scoring.Policy({"light": scoring.Rates("0.0", "1.0", "4.000")}, {"fast": ("1.250", "1.0")}, "light")
    short = scoring.Policy({"light": scoring.Rates("0", "1", "4")}, {"fast": ("1.25", "1")}, "light")
    assert report.policy_sha256(long) == report.policy_sha256(short) != report.policy_sha256()
    text = json.dumps(report.policy_document(short), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert report.policy_sha256(short) == hashlib.sha256(text.encode()).hexdigest() and report.plain("1E+2") == "100"


def predicted(seed, n=150):
    r = np.random.default_rng(seed)
    score, cost = r.random((n, 3)), np.cumsum(r.random((n, 3)) + 0.05, 1)
    true_score, true_cost = (r.integers(0, 5, (n, 3)) / 4), np.cumsum(r.integers(1, 9, (n, 3)) / 8, 1)
    return score, cost, true_score, true_cost


def frame(spark, arrays):
    names = [f"{k}_{m}" for k in ("score", "cost", "true_score", "true_cost") for m in MODELS]
    rows = [tuple(float(a[i, j]) for a in arrays for j in range(3)) for i in range(len(arrays[0]))]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(5)


def by_bisection(score, cost, multiplier, safety):
    """The choice of every row as a scan over penalties finds it."""
    light = math.fsum(cost[:, 0])
    cap, rows = light * max(1.0, multiplier * safety), np.arange(len(score))

    def choose(p):
        return np.argmax(score - p * cost / light, 1)

    if math.fsum(cost[rows, choose(0.0)]) <= cap:
        return choose(0.0)
    low, high = 0.0, 1.0
    while math.fsum(cost[rows, choose(high)]) > cap:
        low, high = high, high * 2
    for _ in range(120):
        middle = (low + high) / 2
        low, high = (low, middle) if math.fsum(cost[rows, choose(middle)]) <= cap else (middle, high)
    return choose(high)


def test_all_candidates_in_one_pass(spark):
    arrays = predicted(4)
    score, cost, true_score, true_cost = arrays
    held, rows = frame(spark, arrays), np.arange(len(score))
    grids = {t: learn.safety_candidates(float(m), 7) for t, (m, _) in scoring.PUBLIC.tiers.items()}
    got = learned.candidates(held, MODELS, scoring.PUBLIC, grids)
    for tier, (m, _) in scoring.PUBLIC.tiers.items():
        assert grids[tier][0] == 1 / float(m) and grids[tier][-1] == 1.0
        for c in got[tier]:
            pick = by_bisection(score, cost, float(m), c["safety"])
            used = true_cost[rows, pick].sum() / true_cost[:, 0].sum()
            assert abs(float(c["ratio"]) - used) < 1e-11 and c["passed"] == (used <= float(m))
            assert abs(float(c["score"]) - (true_score[rows, pick].mean() if c["passed"] else 0)) < 1e-11
            assert abs(c["predicted_ratio"] - cost[rows, pick].sum() / cost[:, 0].sum()) < 1e-9
    best = learned.chosen_safety(held, MODELS, scoring.PUBLIC, 7)
    for tier, cs in got.items():
        want = max(cs, key=lambda c: (c["score"], -c["ratio"], -c["safety"]))
        assert best[tier]["safety"] == want["safety"]


def test_safety_is_validated_downwards(spark):
    held = frame(spark, predicted(9))
    models = MODELS
    grids = {t: [0.97, *learn.safety_candidates(float(m), 9)] for t, (m, _) in scoring.PUBLIC.tiers.items()}
    every = learned.candidates(held, models, scoring.PUBLIC, grids)
    got = learned.validated_safety(held, models, scoring.PUBLIC, dict.fromkeys(grids, 0.97), 9)
    for tier, cs in every.items():
        assert got[tier]["safety"] == max(c["safety"] for c in cs if c["passed"] and c["safety"] <= 0.97)
    poor = scoring.Policy(scoring.PUBLIC.models, {"fast": ("0.5", "1")}, "light")  # even the light model costs too much
    for call in (lambda: learned.validated_safety(held, models, poor, {"fast": 1.0}, 3), lambda: learned.chosen_safety(held, models, poor, 3, only_passing=True)):
        with pytest.raises(RuntimeError):
            call()


def test_selection_does_not_depend_on_order_or_partitions(spark):
    held = frame(spark, predicted(2))
    ids = held.withColumn("id", F.xxhash64(*held.columns))
    want = None
    for n in (1, 3, 8):
        got = sorted(map(tuple, routing.lagrangian_route(ids.repartition(n), MODELS, 2.0, 0.8).select("id", "model_id").collect()))
        assert want is None or got == want
        want = got
    assert routing.lagrangian_route(ids.limit(0), MODELS, 2.0, 0.8).count() == 0
    same = spark.createDataFrame([(0.5, 0.5, 0.5, 1.0, 2.0, 3.0)] * 4, ", ".join(f"{k}_{m} double" for k in ("score", "cost") for m in MODELS))
    assert {r["model_id"] for r in routing.lagrangian_route(same, MODELS, 4.0, 1.0).collect()} == {"light"}


def test_trainer_checks_its_arguments(spark):
    assert learn.checked_arguments(3, 5, (1.0,), 2) == 3
    for bad in ((1, 5, (1.0,), 2), (9, 1, (1.0,), 2), (9, 5, (), 2), (9, 5, (0.0,), 2), (9, 5, (math.inf,), 2), (9, 5, (1.0,), 1)):
        with pytest.raises(ValueError):
            learn.checked_arguments(*bad)
    with pytest.raises(ValueError):
        learn.checked_arguments(9, 5, (1.0,), 2, (object(), None))
    assert learn.safety_candidates(0.5, 9) == [1.0] and learn.safety_candidates(4.0, 1) == [0.25]


def test_dual_form_equals_the_moments(spark):
    r = np.random.default_rng(7)
    x, y = r.normal(size=(12, 20)), r.normal(size=(12, 2))
    x[:, 3] = 1.5
    rows = spark.createDataFrame([(0, x[i].tolist(), y[i].tolist()) for i in range(12)], "fold int, features array<double>, targets array<double>")
    matrix = sum(m for _, m in learn.moments(rows, 20, 2, 1))
    a, b = learn.ridge(matrix, 20, 2.0), learn.fitted(rows, matrix, 20, 2.0)
    for p, q in zip(a, b, strict=True):
        assert np.allclose(p, q)


def test_training_end_to_end(spark):
    r = random.Random(3)
    words = "prove sum list code plain story number theorem short".split()
    texts = [" ".join(r.choice(words) for _ in range(r.randint(3, 30))) for _ in range(40)]
    episodes = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(texts)], "episode_id string, pos bigint, text string")
    outcomes = spark.createDataFrame(outcome_rows([str(i) for i in range(40)], lambda e, m: Decimal("0.25") * (MODELS.index(m) + 1 if "prove" in texts[int(e)] else 1)), OUTCOME)
    router = learned.train(episodes, outcomes, report.policy_sha256(), bins=16, grid_size=5, validation=(episodes, outcomes))
    assert learned.parsed(json.loads(json.dumps(router.document())), tuple(scoring.PUBLIC.tiers)).safety == router.safety
    assert {"out_of_fold", "fitted", "validation", "objectives"} <= set(router.summary)
    rows = {r["tier"]: r for r in learned.self_check(router, episodes, outcomes, HEADER).collect()}
    assert set(rows) == set(scoring.PUBLIC.tiers) and rows["fast"]["num_episodes"] == 40
    with pytest.raises(ValueError):
        learned.self_check(learned.Router(**{**router.__dict__, "policy_sha256": "0" * 64}), episodes, outcomes, HEADER)
    with pytest.raises(checks.Violation):
        learned.train(episodes, outcomes.limit(5), report.policy_sha256(), bins=16, grid_size=3)


def test_exact_sums_equal_fsum(spark):
    r = random.Random(1)
    values = [r.uniform(-1, 1) * 10.0 ** r.randint(-200, 200) for _ in range(500)] + [1e308, -1e308, 5e-324, 1e16, 1.0, -1e16]
    rows = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)] + [(0, None), (4, None)], "k int, v double").repartition(7)
    got = {x["k"]: x["sum"] for x in records.exact_sums(rows, ["k"], "v").collect()}
    assert got == {k: math.fsum(v for i, v in enumerate(values) if i % 3 == k) for k in range(3)} | {4: 0.0}
    assert records.exact_sums(rows, [], "v").first()["sum"] == math.fsum(values)


def test_bounded_logs(spark):
    texts = ["", "abc", "é" * 50, "😀" * 30, "a" * 59 + "é", "x" * 61, "한글" * 40]
    mark = records.CUT_MARK.encode()

    def want(text, most):
        raw = text.encode()
        if len(raw) <= most:
            return text
        if len(mark) >= most:
            return raw[:most].decode("utf-8", "ignore")
        return raw[: most - len(mark)].decode("utf-8", "ignore") + records.CUT_MARK

    held = spark.createDataFrame([(t,) for t in texts], "t string")
    for most in (0, 1, 5, 60, 61):
        assert [r[0] for r in held.select(records.bounded_log(F.col("t"), most)).collect()] == [want(t, most) for t in texts], most
    with pytest.raises(ValueError):
        records.bounded_log(F.col("t"), -1)


def test_generated_samples_equal_one_after_another(spark):
    modules = {"a": {"x": lambda r: (f"q{r.randint(1, 150)}", "1"), "y": lambda r: (f"q{r.randint(1, 150)}", "2")}, "z": lambda r: ("w" * r.randint(1, 400), "3")}
    from waybill.sources.documents import flattened

    leaves, seen, want = flattened(modules), set(), []
    names = sorted(leaves)
    for pos in range(90):
        name, number = names[pos % 3], pos // 3
        for retry in range(101):
            seed = int.from_bytes(hashlib.sha256(f"r\0{name}\0{number}\0{retry}".encode()).digest()[:4], "big")
            question, answer = generate.bounded(leaves[name], seed)
            if question not in seen:
                break
        seen.add(question)
        want.append((pos, f"r:{name}:{number}:{seed:08x}", question, answer))
    got = sorted(map(tuple, generate.samples(spark, "r", modules, 90).collect()))
    assert got == want and len(seen) == 90
    with pytest.raises(Exception, match="repeat"):
        generate.samples(spark, "r", {"one": lambda r: ("same", "1")}, 2)
    with pytest.raises(ValueError):
        generate.samples(spark, "r", {}, 2)


def test_publishing_is_whole_or_not_at_all(tmp_path):
    path, table = tmp_path / "r.json", tmp_path / "r.md"
    records.published(str(path), "one")
    assert path.read_text() == "one" and path.stat().st_mode & 0o777 == 0o644
    records.published_pair(str(path), "two", str(table), records.markdown_table([{"a": 1.0, "b": "x|y"}, {"a": None}], ["a", "b"]))
    assert path.read_text() == "two" and table.read_text().splitlines()[2] == "| 1.0000 | x\\|y |"
    with pytest.raises(OSError):
        records.published_pair(str(path), "three", str(tmp_path / "none" / "r.md"), "x")
    assert path.read_text() == "two" and sorted(p.name for p in tmp_path.iterdir()) == ["r.json", "r.md"]


def test_workload_needs_disjoint_splits(spark):
    schema = "episode_id string, pos bigint, prompt string, messages array<struct<role: string, content: string>>"
    a, b = spark.createDataFrame([("a", 0, "x", None)], schema), spark.createDataFrame([("b", 0, "y", None)], schema)
    assert [(r["episode_id"], r["pos"], r["split"]) for r in selections.workload(a, b, "c", "both").orderBy("pos").collect()] == [("a", 0, "both"), ("b", 1, "both")]
    with pytest.raises(checks.Violation):
        selections.workload(a, a, "c", "both")


def test_shared_folder_is_needed_on_a_cluster(spark):
    from types import SimpleNamespace

    from waybill.sources.shared import folder

    def session(master):
        context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=context)

    assert folder(session("local[2]"), "x").endswith("/x")
    with pytest.raises(ValueError):
        folder(session("spark://host:7077"), "x")


def test_tables_are_cleared(spark, tmp_path, monkeypatch):
    from waybill.sources import shared

    monkeypatch.setattr(shared, "_made", [])
    rows = shared.written(spark.range(5), "x")
    assert rows.count() == 5 and shared.clear(spark) == 1 and shared.clear(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(rows.inputFiles()[0]).count()


def test_steps_of_a_tied_batch(spark):
    """A hot penalty: all rows change their model at once."""
    same = spark.createDataFrame([(0.1, 0.9, 0.95, 1.0, 2.0, 4.0)] * 300, ", ".join(f"{k}_{m} double" for k in ("score", "cost") for m in MODELS))
    steps = curve.Curve(curve.chosen_steps(same, MODELS, 300.0, {"cost": [F.col(f"cost_{m}") for m in MODELS]}), ["cost"])
    assert [float(r["cost"]) for r in steps.totals.orderBy("at").collect()] == [1200.0, 600.0, 300.0]
    assert {k: float(v["cost"]) for k, v in steps.first_fitting({"a": Decimal(1200), "b": Decimal(1199), "c": Decimal(300)}).items()} == {"a": 1200.0, "b": 600.0, "c": 300.0}
    assert steps.first_fitting({"none": Decimal(299)}) == {}


def test_command_line(spark, tmp_path, capsys):
    from waybill import cli

    ids = [f"e{i}" for i in range(5)]
    files = {"in": {**HEADER, "episodes": [{"episode_id": e, "prompt": "Prove x = 1 + 2" if i % 2 else "plain"} for i, e in enumerate(ids)]}}
    files["out"] = {**HEADER, "episodes": [{"episode_id": e, "models": {m: {"score": "0.5", "num_generations": 1, "input_tokens": 10, "output_tokens": 5} for m in MODELS}} for e in ids]}
    files["bad"] = {**HEADER, "episodes": [], "x": 1}
    for name, d in files.items():
        (tmp_path / name).write_text(json.dumps(d))
    path = {n: str(tmp_path / n) for n in (*files, *scoring.PUBLIC.tiers)}
    assert cli.main(["check", "input", path["in"]], spark) == 0 and cli.main(["check", "input", path["bad"]], spark) == 2
    for tier in scoring.PUBLIC.tiers:
        assert cli.main(["route", "rules", "--input", path["in"], "--tier", tier, "--output", path[tier]], spark) == 0
    submission = json.loads((tmp_path / "fast").read_text())
    assert [d["model_id"] for d in submission["decisions"]] == ["light", "middle"] * 2 + ["light"] and submission["policy_id"] == "public"
    capsys.readouterr()
    arguments = ["score", "--input", path["in"], "--outcomes", path["out"], "--submissions"]
    assert cli.main([*arguments, *(path[t] for t in scoring.PUBLIC.tiers)], spark) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["final_score"] == "0.3" and got["tiers"]["fast"]["budget_passed"] is False and len(got["tiers"]) == 3
    assert cli.main([*arguments, path["fast"]], spark) == 2 and cli.main([*arguments, path["fast"], path["fast"], path["premium"]], spark) == 2
