"""Strict JSON documents: inputs, outcomes, submissions, policies.

``from_json`` alone keeps the last of repeated keys and ignores unknown ones, so a document is first
parsed as VARIANT (which rejects repeated keys and NaN) and its key sets are compared.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.functions.exact import is_decimal
from waybill.operators.checks import ROLES, key_sets
from waybill.operators.scoring import PUBLIC, Policy, Rates

MESSAGE = "struct<role: string, content: string>"
EPISODE = f"struct<episode_id: string, prompt: string, messages: array<{MESSAGE}>>"
HEADER = "schema_version: int, challenge_id: string, split: string"
INPUT = f"struct<{HEADER}, episodes: array<{EPISODE}>>"
OUTCOME = "struct<score: string, num_generations: bigint, input_tokens: bigint, output_tokens: bigint>"
OUTCOMES = f"struct<{HEADER}, episodes: array<struct<episode_id: string, models: map<string, {OUTCOME}>>>>"
SUBMISSION = f"struct<{HEADER}, policy_id: string, tier: string, decisions: array<struct<episode_id: string, model_id: string>>>"

# Keys of the documents, and the longest id.
KEYS = {
    "input": ["schema_version", "challenge_id", "split", "episodes"],
    "outcomes": ["schema_version", "challenge_id", "split", "episodes"],
    "submission": ["schema_version", "challenge_id", "policy_id", "split", "tier", "decisions"],
    "policy": ["schema_version", "policy_id", "cost_unit", "context_limit_tokens", "light_model_id", "models", "tiers"],
}
OUTCOME_KEYS = ["score", "num_generations", "input_tokens", "output_tokens"]
LONGEST_ID = 128
TOKEN_UNIT = 1_000_000


def documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, text) of whole files; the text of a file that is no UTF-8 is null."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))


def _text(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "string")


def _kind(v: Column, key: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))


def _array(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "array<variant>")


def _is_text(v: Column, key: str, longest: int | None = None) -> Column:
    size = F.length(_text(v, key))
    return (_kind(v, key) == "STRING") & (size > 0) & (F.lit(True) if longest is None else size <= longest)


def _is_integer(v: Column, key: str, least: int) -> Column:
    return (_kind(v, key) == "BIGINT") & (F.try_variant_get(v, f"$.{key}", "bigint") >= least)


def _exact_keys(v: Column, required: list[str], optional: tuple[str, ...] = ()) -> Column:
    lacking, unknown = key_sets(F.json_object_keys(F.to_json(v)), required, optional)
    return (F.size(lacking) == 0) & (F.size(unknown) == 0)


def failed(rules: dict[str, Column]) -> Column:
    """Names of the rules that don't hold; a null counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def _element_rules(kind: str, e: Column, models: tuple[str, ...]) -> dict[str, Column]:
    """Rules of one episode or decision."""
    named = {"episode_id": _is_text(e, "episode_id", LONGEST_ID)}
    if kind == "input":
        keys, messages = F.json_object_keys(F.to_json(e)), _array(e, "messages")
        message = F.forall(messages, lambda m: _exact_keys(m, ["role", "content"]) & F.try_variant_get(m, "$.role", "string").isin(*ROLES) & _is_text(m, "content"))
        return {
            "episode_keys": _exact_keys(e, ["episode_id"], ("prompt", "messages")), **named, "prompt_or_messages": F.array_contains(keys, "prompt") != F.array_contains(keys, "messages"),
            "prompt": ~F.array_contains(keys, "prompt") | _is_text(e, "prompt"), "messages": ~F.array_contains(keys, "messages") | ((F.size(messages) > 0) & message),
        }
    if kind == "submission":
        return {"decision_keys": _exact_keys(e, ["episode_id", "model_id"]), **named, "model_id": _text(e, "model_id").isin(*models)}
    by_model = F.try_variant_get(e, "$.models", "map<string,variant>")
    return {
        "episode_keys": _exact_keys(e, ["episode_id", "models"]), **named, "models": F.array_sort(F.map_keys(by_model)) == F.array(*map(F.lit, sorted(models))),
        "outcome_keys": F.forall(F.map_values(by_model), lambda o: _exact_keys(o, OUTCOME_KEYS)),
        "score": F.forall(F.map_values(by_model), lambda o: (_kind(o, "score") == "STRING") & is_decimal(_text(o, "score")) & (_text(o, "score").try_cast("decimal(38,30)") <= 1)),
        "counts": F.forall(F.map_values(by_model), lambda o: _is_integer(o, "num_generations", 1) & _is_integer(o, "input_tokens", 1) & _is_integer(o, "output_tokens", 0)),
    }


def problems(docs: DataFrame, kind: str, models: tuple[str, ...] = tuple(PUBLIC.models), tiers: tuple[str, ...] = tuple(PUBLIC.tiers)) -> DataFrame:
    """(path, rule) for every broken rule of documents (path, text) of a kind, top level and elements; a rule is named once for each document."""
    held = docs.withColumn("v", F.try_parse_json("text"))
    each = held.filter("v IS NOT NULL").select("path", F.explode(_array(F.col("v"), _elements(kind))).alias("e"))
    return found_problems(held, checked(each, kind, models=models), kind, F.size(_array(F.col("v"), _elements(kind))) > 0, tiers)


def _elements(kind: str) -> str:
    return "decisions" if kind == "submission" else "episodes"


def checked(each: DataFrame, kind: str, *more: str, models: tuple[str, ...] = tuple(PUBLIC.models)) -> DataFrame:
    """(path, rules, id, none, more) of elements (path, e, more): the rules they break, their ids, and whether they are no JSON."""
    e = F.col("e")
    return each.select("path", failed(_element_rules(kind, e, models)).alias("rules"), _text(e, "episode_id").alias("id"), e.isNull().alias("none"), *more)


def found_problems(held: DataFrame, each: DataFrame, kind: str, some: Column, tiers: tuple[str, ...] = tuple(PUBLIC.tiers)) -> DataFrame:
    """``problems`` of documents (path, text, v), null where they are no JSON, and what ``checked`` found in the elements of the others; some: whether a document has elements."""
    parsed, v, array = held.filter("v IS NOT NULL"), F.col("v"), _elements(kind)
    bad = held.filter("v IS NULL").select("path", F.when(F.col("text").isNull(), "utf8").otherwise("json").alias("rule"))
    missing, extra = key_sets(F.json_object_keys("text"), KEYS[kind])
    rules = {
        "missing_keys": F.size(missing) == 0, "unknown_keys": F.size(extra) == 0, "schema_version": _is_integer(v, "schema_version", 1) & (_text(v, "schema_version") == "1"),
        "challenge_id": _is_text(v, "challenge_id"), "split": _is_text(v, "split"), array: some,
    }
    if kind == "submission":
        rules |= {"policy_id": _is_text(v, "policy_id"), "tier": _text(v, "tier").isin(*tiers)}
    inner = each.select("path", F.explode("rules").alias("rule"))
    twice = each.groupBy("path", "id").count().filter("count > 1 AND id IS NOT NULL")
    out = bad.unionByName(parsed.select("path", F.explode(failed(rules)).alias("rule"))).unionByName(inner)
    return out.unionByName(twice.select("path", F.lit("repeated_episode").alias("rule"))).distinct()


def episodes(docs: DataFrame) -> DataFrame:
    """(path, header, pos, episode_id, prompt, messages) of valid input documents."""
    d = docs.select("path", F.from_json("text", INPUT).alias("d"))
    held = d.select("path", "d.schema_version", "d.challenge_id", "d.split", F.posexplode("d.episodes").alias("pos", "e"))
    return held.select("path", "schema_version", "challenge_id", "split", F.col("pos").cast("bigint").alias("pos"), "e.*")


def outcomes(docs: DataFrame) -> DataFrame:
    """Long rows of outcome documents; score is kept as text and as DECIMAL where it is one."""
    d = docs.select(F.explode(F.from_json("text", OUTCOMES)["episodes"]).alias("e"))
    held = d.select("e.episode_id", F.explode("e.models").alias("model_id", "o")).select("episode_id", "model_id", "o.*")
    return held.withColumn("score_text", F.col("score")).withColumn("score", F.when(is_decimal(F.col("score")), F.col("score").try_cast("decimal(31,30)")))


def decisions(docs: DataFrame) -> DataFrame:
    """(tier, pos, episode_id, model_id) of submission documents."""
    d = docs.select(F.from_json("text", SUBMISSION).alias("d"))
    held = d.select("d.tier", "d.policy_id", F.posexplode("d.decisions").alias("pos", "e"))
    return held.select("tier", "policy_id", F.col("pos").cast("bigint").alias("pos"), "e.*")


def _no_repeats(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("repeated key")
    return out


def loads(text: str) -> object:
    """A small JSON document on the driver; repeated keys and NaN are errors, fractions stay exact."""

    def refuse(name: str) -> None:
        raise ValueError(f"{name} is no JSON number")

    return json.loads(text, object_pairs_hook=_no_repeats, parse_float=Decimal, parse_constant=refuse)


def _decimal(value: object, least: int | None = 0, most: int | None = None, zero: bool = True) -> bool:
    if not isinstance(value, str) or not re.fullmatch(r"(0|[1-9][0-9]{0,39})(\.[0-9]{1,30})?", value) or len(value.replace(".", "")) > 40:
        return False
    x = Decimal(value)
    return x >= least and (most is None or x <= most) and (zero or x != 0)


def policy_problems(text: str, models: tuple[str, ...] = tuple(PUBLIC.models), tiers: tuple[str, ...] = tuple(PUBLIC.tiers), policy_id: str = PUBLIC.policy_id) -> list[str]:
    """Broken rules of a policy document, a small one on the driver or in a task."""

    def whole(x: object, least: int) -> bool:
        return type(x) is int and x >= least

    def named(x: object) -> bool:
        return isinstance(x, str) and x != ""

    def exact(x: object, required: set, optional: set = frozenset()) -> bool:
        return isinstance(x, dict) and required <= set(x) <= required | optional

    try:
        d = loads(text)
    except (ValueError, RecursionError):
        return ["json"]
    if not isinstance(d, dict):
        return ["object"]
    of_model, of_tier = d.get("models"), d.get("tiers")
    model_keys = isinstance(of_model, dict) and set(of_model) == set(models)
    tier_keys = isinstance(of_tier, dict) and set(of_tier) == set(tiers)
    rates = model_keys and all(exact(r, {"input_token_rate", "output_token_rate"}, {"fixed_cost"}) and all(map(_decimal, r.values())) for r in of_model.values())
    budgets = tier_keys and all(exact(t, {"budget_multiplier", "weight"}) and _decimal(t["budget_multiplier"], zero=False) and _decimal(t["weight"]) for t in of_tier.values())
    rules = {
        "missing_keys": set(KEYS["policy"]) <= set(d), "unknown_keys": set(d) <= {*KEYS["policy"], "token_unit", "budget_warning_ratio"}, "schema_version": whole(d.get("schema_version"), 1) and d["schema_version"] == 1,
        "policy_id": d.get("policy_id") == policy_id, "cost_unit": named(d.get("cost_unit")), "token_unit": whole(d.get("token_unit", TOKEN_UNIT), 1) and d.get("token_unit", TOKEN_UNIT) == TOKEN_UNIT,
        "context_limit_tokens": whole(d.get("context_limit_tokens"), 1), "models": model_keys, "rates": rates, "light_model_id": d.get("light_model_id") in models, "tiers": tier_keys, "budgets": budgets,
        "weights": not budgets or sum(Decimal(t["weight"]) for t in of_tier.values()) == 1, "budget_warning_ratio": _decimal(d.get("budget_warning_ratio", "0.95"), most=1, zero=False),
    }
    return [name for name, ok in rules.items() if not ok]


def policy(text: str) -> Policy:
    """A policy document; broken rules are errors, but for the names of models and tiers, which the document sets."""
    d = loads(text)
    found = policy_problems(text, tuple(d.get("models", ())), tuple(d.get("tiers", ())), d.get("policy_id"))
    if found:
        raise ValueError(f"policy document: {found}")
    models = {m: Rates(r.get("fixed_cost", "0"), r["input_token_rate"], r["output_token_rate"]) for m, r in d["models"].items()}
    tiers = {t: (x["budget_multiplier"], x["weight"]) for t, x in d["tiers"].items()}
    return Policy(models, tiers, d["light_model_id"], d.get("token_unit", TOKEN_UNIT), d.get("budget_warning_ratio", "0.95"), d["policy_id"], d["cost_unit"], d["context_limit_tokens"], d["schema_version"])


def canonical(value: object) -> str:
    """Compact JSON with sorted keys."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def compact(value: dict) -> str:
    """Compact JSON in the order of the keys."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def digest(value: object) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def report(value: object) -> str:
    """A report as indented JSON with sorted keys and a final line end."""
    return json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n"


def submission_rows(decisions: DataFrame, keys: list[str], header: dict | None = None) -> DataFrame:
    """One JSON text for each submission: the header, the keys and the decisions in the order of ``pos``.

    A submission is one document, so its decisions meet in one row; it must stay below 2 GB.
    """
    rows = F.array_sort(F.collect_list(F.struct("pos", "episode_id", "model_id")))
    held = decisions.groupBy(*keys).agg(F.transform(rows, lambda r: F.struct(r["episode_id"].alias("episode_id"), r["model_id"].alias("model_id"))).alias("decisions"))
    fields = [F.lit(v).alias(k) for k, v in (header or {}).items()] + ([F.col(k) for k in keys] if header else [])
    return held.select(*keys, F.to_json(F.struct(*fields, "decisions")).alias("json"))


def input_rows(episodes: DataFrame, keys: list[str], header: dict) -> DataFrame:
    """One JSON text for each input: the header and the episodes (pos, episode_id, prompt or messages); null fields are left out."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "episode_id", "prompt", "messages")))
    held = episodes.groupBy(*keys).agg(F.transform(rows, lambda r: F.struct(r["episode_id"].alias("episode_id"), r["prompt"].alias("prompt"), r["messages"].alias("messages"))).alias("episodes"))
    return held.select(*keys, F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in header.items()], "episodes")).alias("json"))


def flattened(tree: dict, above: str = "") -> dict[str, object]:
    """A nested mapping as a sorted flat one, keys joined by two underscores."""
    out: dict[str, object] = {}
    for k, v in tree.items():
        name = f"{above}__{k}" if above else k
        out.update(flattened(v, name) if isinstance(v, dict) else {name: v})
    return dict(sorted(out.items()))


def flattened_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, value) of the leaves of each document of nested objects, names as in ``flattened``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, n, str(v)) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for n, v in flattened(loads(t)).items()]
            columns = zip(*rows, strict=True) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)], [key, "name", "value"])

    return docs.select(F.col(key).cast("bigint").alias(key), text).mapInArrow(run, f"{key} bigint, name string, value string")
