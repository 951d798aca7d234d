"""File sources around the documents: problem sets, sample tables, pins, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PINS = (
    "schema_version int, sources array<struct<source_id: string, source_type: string, revision: string, repo_id: string, "
    "files: array<struct<path: string, sha256: string, url: string>>>>"
)


def parquet_problems(spark: SparkSession, path: str) -> DataFrame:
    """(id, problem); only the two columns are read."""
    return spark.read.parquet(path).select(F.col("id").cast("string").alias("id"), "problem")


def jsonl_problems(spark: SparkSession, path: str) -> DataFrame:
    """(id, problem) of JSON lines; form feeds and tabs become the commands they were meant as. Check ids with ``duplicates``."""
    rows = spark.read.schema("id string, problem string").json(path)
    return rows.select("id", F.replace(F.replace("problem", F.lit("\f"), F.lit("\\f")), F.lit("\t"), F.lit("\\t")).alias("problem"))


def tsv_samples(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, problem, answer) of tab-separated lines without quoting."""
    parts = F.split("value", "\t")
    return spark.read.text(path).select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(("sample_id", "problem", "answer"))])


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of lines with two fields; a line of another form has a null value."""
    parts = F.split(F.trim("value"), r"\s+")
    number = F.when(F.size(parts) == 2, F.get(parts, F.lit(1)).try_cast("bigint"))
    return spark.read.text(path).select(F.get(parts, F.lit(0)).alias("key"), number.alias("value"))


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each pinned file of a pins document."""
    rows = spark.read.schema(PINS).json(path, multiLine=True).select(F.explode("sources").alias("s"))
    return rows.select("s.source_id", "s.source_type", "s.revision", "s.repo_id", F.explode("s.files").alias("f")).select("source_id", "source_type", "revision", "repo_id", "f.*")


def quoted(text: Column, keep_slashes: bool) -> Column:
    """Percent-encoding with ``%20`` for blanks; slashes may stay."""
    def one(part: Column) -> Column:
        return F.replace(F.replace(F.url_encode(part), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))

    return F.array_join(F.transform(F.split(text, "/"), one), "/") if keep_slashes else one(text)


def with_urls(files: DataFrame, host: str, kind: str) -> DataFrame:
    """Adds the address of files that don't state one: host/kind/repository/resolve/revision/path."""
    built = F.concat_ws("/", F.lit(host), F.lit(kind), quoted(F.col("repo_id"), True), F.lit("resolve"), quoted(F.col("revision"), False), quoted(F.col("path"), True))
    return files.withColumn("url", F.coalesce("url", built))


def verified(spark: SparkSession, folder: str, pinned: DataFrame, depth: int = 1) -> DataFrame:
    """Pinned files (name, sha256) with ok, missing or hash_mismatch; the name is that of the file, or with ``depth`` of a folder above it."""
    files = spark.read.format("binaryFile").load(f"{folder}/*").select(F.element_at(F.split("path", "/"), -depth).alias("name"), F.sha2("content", 256).alias("found"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "hash_mismatch").otherwise("ok")
    return pinned.join(files, "name", "left").select("name", "sha256", status.alias("status"))
