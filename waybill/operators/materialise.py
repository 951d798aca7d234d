"""Joins, unions and hashes that build episode sets from selections and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def selected_problems(selection: DataFrame, problems: DataFrame, keys: list[str]) -> DataFrame:
    """Selected rows with their problem; status tells missing problems and wrong hashes."""
    joined = selection.join(problems, keys, "left")
    status = F.when(F.col("problem").isNull(), "missing").when(F.sha2("problem", 256) != F.col("prompt_sha256"), "hash_mismatch").otherwise("ok")
    return joined.withColumn("status", status)


def union_in_order(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of both with ``pos`` carried on after the first; ids must be disjoint (see ``checks.duplicates``)."""
    n = first.count()
    return first.unionByName(second.withColumn("pos", F.col("pos") + n))


def base_and_fetched(base: DataFrame, fetched: DataFrame) -> DataFrame:
    """Both sets by id; the order is that of the ids' code points."""
    return base.select("episode_id", "prompt").unionByName(fetched.select("episode_id", "prompt"))


def table_bytes(samples: DataFrame, keys: list[str]) -> DataFrame:
    """For each group the tab-separated rows joined by line feeds without a last one, with their hash.

    Empty fields and fields with a tab, line feed or carriage return make ``valid`` false.
    """
    fields = ["sample_id", "problem", "answer"]
    clean = F.forall(F.array(*fields), lambda f: (F.length(f) > 0) & ~F.regexp_like(f, F.lit("[\t\n\r]")))
    held = samples.withColumn("_row", F.struct("pos", F.concat_ws("\t", *fields).alias("line"), clean.alias("clean")))
    held = held.groupBy(*keys).agg(F.array_sort(F.collect_list("_row")).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    return held.select(*keys, text.alias("content"), F.sha2(text, 256).alias("sha256"), F.forall("rows", lambda r: r["clean"]).alias("valid"))


def manifest_hash(files: DataFrame) -> DataFrame:
    """Hash over the sorted list of (path, sha256) as compact JSON."""
    rows = F.array_sort(F.collect_list(F.struct("path", "sha256")))
    return files.agg(F.sha2(F.to_json(rows), 256).alias("manifest_sha256"), F.count("*").alias("n_files"))


def file_hashes(spark: object, path: str) -> DataFrame:
    """Path, length and SHA-256 of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
