"""Selections that name episodes of other sources, and the inputs put together from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.operators import checks
from waybill.operators.materialise import selected_problems, union_in_order

from .documents import HEADER, episodes, failed, problems
from .large import registry_problems

# Wire forms of the selections.
SELECTION = "struct<schema_version: int, split: string, episodes: array<struct<episode_id: string, prompt_sha256: string, source_id: string, source_key: struct<source_id: string, year: int>>>>"
PUBLIC_SELECTION = "struct<schema_version: int, source_id: string, reference_sha256: map<string, string>, splits: map<string, array<struct<episode_id: string, sample_id: string>>>>"


def _unsorted(ids: Column) -> Column:
    """Whether an array of ids repeats one or is out of order."""
    return (F.size(F.array_distinct(ids)) < F.size(ids)) | (F.array_sort(ids) != ids)


def base_problems(docs: DataFrame, challenge_id: str, split: str, expected: int) -> DataFrame:
    """(path, rule) of input documents that are to hold the episodes of a split: header, count, ids unique and in order."""
    d = docs.select("path", F.from_json("text", f"struct<{HEADER}, episodes: array<struct<episode_id: string>>>").alias("d"))
    ids = F.col("d.episodes.episode_id")
    rules = {"header": (F.col("d.challenge_id") == challenge_id) & (F.col("d.split") == split), "count": F.size(ids) == expected, "order": ~_unsorted(ids)}
    return problems(docs, "input").unionByName(d.select("path", F.explode(failed(rules)).alias("rule"))).distinct()


def load_base(docs: DataFrame, challenge_id: str, split: str, expected: int) -> DataFrame:
    """The episodes of one checked input document; a broken rule is an error."""
    checks.require(base_problems(docs, challenge_id, split, expected), "base input")
    return episodes(docs)


def selection_rows(docs: DataFrame) -> DataFrame:
    """(path, split, pos, episode_id, prompt_sha256, source_id, source_key, year) of selection documents."""
    d = docs.select("path", F.from_json("text", SELECTION).alias("d")).select("path", "d.split", F.posexplode("d.episodes").alias("pos", "e"))
    return d.select("path", "split", "pos", "e.episode_id", "e.prompt_sha256", "e.source_id", F.col("e.source_key.source_id").alias("source_key"), F.col("e.source_key.year").alias("year"))


def selection_problems(docs: DataFrame, split: str, expected: int, years: dict[str, int]) -> DataFrame:
    """(path, rule): keys, header, count, order, and for each row its id, hash, source and year."""
    v = docs.withColumn("v", F.try_parse_json("text"))
    parsed = v.select("path", "v", F.from_json("text", SELECTION).alias("d"))
    keys = F.json_object_keys(F.to_json("v"))
    each = F.try_variant_get("v", "$.episodes", "array<variant>")
    row_keys = F.forall(each, lambda e: F.array_sort(F.json_object_keys(F.to_json(e))) == F.array(*map(F.lit, ("episode_id", "prompt_sha256", "source_id", "source_key"))))
    rows, ids = F.col("d.episodes"), F.col("d.episodes.episode_id")
    year = F.create_map(*[F.lit(x) for pair in years.items() for x in pair])
    rules = {
        "keys": (F.array_sort(keys) == F.array(*map(F.lit, ("episodes", "schema_version", "split")))) & row_keys, "header": (F.col("d.schema_version") == 1) & (F.col("d.split") == split), "count": F.size(rows) == expected,
        "order": ~_unsorted(ids), "source": F.forall(rows, lambda r: (F.try_element_at(year, r["source_id"]) == r["source_key"]["year"]) & (F.length(r["source_key"]["source_id"]) > 0)),
        "episode_id": F.forall(rows, lambda r: F.startswith(r["episode_id"], F.lit(f"{split}-"))), "prompt_sha256": F.forall(rows, lambda r: F.regexp_like(r["prompt_sha256"], F.lit(checks.SHA256))),
    }
    return parsed.select("path", F.explode(failed(rules)).alias("rule"))


def resolved(selection: DataFrame, sources: DataFrame) -> DataFrame:
    """Selected rows with their problems (source_id, source_key, problem); status is ok, missing or hash_mismatch."""
    return selected_problems(selection, sources, ["source_id", "source_key"])


def public_rows(docs: DataFrame) -> DataFrame:
    """(path, split, pos, episode_id, sample_id) of public selection documents."""
    d = docs.select("path", F.from_json("text", PUBLIC_SELECTION).alias("d")).select("path", F.explode("d.splits").alias("split", "rows"))
    return d.select("path", "split", F.posexplode("rows").alias("pos", "e")).select("path", "split", "pos", "e.episode_id", "e.sample_id")


def public_problems(docs: DataFrame, source_id: str, references: dict[str, str], counts: dict[str, int]) -> DataFrame:
    """(path, rule): header, pinned hashes, counts of the splits, ids unique over all splits and in order."""
    parsed = docs.select("path", F.from_json("text", PUBLIC_SELECTION).alias("d"))

    def ids(split: str, field: str) -> Column:
        return F.transform(F.try_element_at("d.splits", F.lit(split)), lambda r: r[field])

    def everywhere(field: str) -> Column:
        return F.concat(*[ids(s, field) for s in counts])

    def named(split: str) -> Callable[[Column], Column]:
        return lambda i: F.startswith(i, F.lit(f"{split}-"))

    pinned = F.create_map(*[F.lit(x) for pair in sorted(references.items()) for x in pair])
    rules = {
        "header": (F.col("d.schema_version") == 1) & (F.col("d.source_id") == source_id), "references": F.array_sort(F.map_entries("d.reference_sha256")) == F.array_sort(F.map_entries(pinned)),
        "splits": F.array_sort(F.map_keys("d.splits")) == F.array(*map(F.lit, sorted(counts))), "unique": (F.size(F.array_distinct(everywhere("episode_id"))) == F.size(everywhere("episode_id")))
        & (F.size(F.array_distinct(everywhere("sample_id"))) == F.size(everywhere("sample_id"))),
    }
    for split, n in counts.items():
        rules[f"{split}_count"] = F.size(ids(split, "episode_id")) == n
        rules[f"{split}_order"] = ~_unsorted(ids(split, "episode_id")) & F.forall(ids(split, "episode_id"), named(split))
    return parsed.select("path", F.explode(failed(rules)).alias("rule"))


def fragments(selection: DataFrame, *regimes: DataFrame) -> DataFrame:
    """(split, episode_id, prompt) of selected samples out of the regimes together; answers stay behind, a missing sample has no prompt."""
    samples = regimes[0].select("sample_id", "problem")
    for other in regimes[1:]:
        samples = samples.unionByName(other.select("sample_id", "problem"))
    return selection.join(samples, "sample_id", "left").select("split", "episode_id", F.col("problem").alias("prompt"))


def pinned_problems(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """(split, rule) of input documents (split, text) against a registry (split, total_inputs, sha256)."""
    d = docs.select("split", F.sha2("text", 256).alias("found"), F.from_json("text", f"struct<{HEADER}, episodes: array<struct<episode_id: string>>>").alias("d"))
    return registry_problems(d.select("split", "found", F.col("d.split").alias("named"), F.size("d.episodes").alias("n")), registry)


def workload(train: DataFrame, dev: DataFrame, challenge_id: str, split: str) -> DataFrame:
    """Both splits as one input: train, then dev, under a new header; an id in both is an error."""
    both = union_in_order(train.select("episode_id", "pos", "prompt", "messages"), dev.select("episode_id", "pos", "prompt", "messages"))
    checks.require(checks.duplicates(both, ["episode_id"]), "ids are in one split only")
    return both.withColumn("challenge_id", F.lit(challenge_id)).withColumn("split", F.lit(split))
