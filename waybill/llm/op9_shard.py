"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records uniformly into memory-sized buckets by a seeded hash of id and text; pass 2
loads one bucket at a time, shuffles it by Fisher-Yates and gives out its rows.  The buckets one after
another are a uniform random order of all records, which is cut into shards whose counts differ by one
at most; the counts of the buckets, taken before pass 1, say where each begins.

A bucket that would hold several times its share (rows equal in id and text hash alike) is split into
more buckets by a hash of the rows' places in the input, so no bucket outgrows memory.

Nulls in ``text`` count as empty, null ids are kept; equal rows stay separate records; an empty
table gives an empty result.  Extra columns travel along; the names in ``ADDED`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import parts, written

ADDED = ("_bucket", "_row", "_n", "_first", "size", "text_crc32", "shard", "slot")
#: A bucket above this many times its share is split.
SPLIT = 4
#: Most split buckets that are broadcast; more are joined by shuffle.
FEW = 100_000


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A uniform permutation of n places."""
    order, draw = np.arange(n), np.random.default_rng(seed)
    picks = draw.integers(0, np.arange(n, 0, -1)) if n else order
    for i, step in enumerate(picks.tolist()):
        j = i + step
        if j != i:
            order[i], order[j] = order[j], order[i]
    return order


def scattered(docs: DataFrame, seed: int, n: int) -> DataFrame:
    """docs with size, hash and bucket."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        docs.drop(*ADDED)
        .withColumn("size", (F.octet_length(text) + 1).cast("long"))
        .withColumn("text_crc32", F.crc32(text.cast("binary")))
        .withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.lit(seed)), F.lit(n)).cast("int"))
    )


def bucket_counts(keyed: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and bytes of every bucket; 16 bytes for each come to the driver, as Arrow."""
    found = keyed.groupBy("_bucket").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).toArrow()
    rows, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = found.column("_bucket").to_numpy()
    rows[at], size[at] = found.column("n").to_numpy(), found.column("bytes").to_numpy()
    return rows, size


def bucketed(docs: DataFrame, seed: int, bucket_mb: float) -> tuple[DataFrame, np.ndarray]:
    """The rows with their final bucket, and the number of rows of every bucket."""
    spark, n = docs.sparkSession, parts(docs, bucket_mb, inflate=2.5)
    keyed = scattered(docs, seed, n)
    rows, size = bucket_counts(keyed, n)
    share = max(float(size.sum()) / n, float(rows.sum()) / n, 1.0)
    load = np.maximum(size, rows)
    pieces = np.where(load > SPLIT * share, -(-load // int(share + 1)), 1) if n > 1 else np.ones(1, np.int64)
    if (pieces == 1).all():
        return keyed, rows
    first = np.cumsum(pieces) - pieces
    hot = np.flatnonzero(pieces > 1)
    # buckets keep their numbers; the further pieces of split ones are numbered from n on
    extra = np.cumsum(pieces[hot] - 1) - (pieces[hot] - 1) + n
    split = spark.createDataFrame(list(zip(hot.tolist(), pieces[hot].tolist(), extra.tolist(), strict=True)), "_bucket int, _n bigint, _first bigint")
    piece = F.pmod(F.xxhash64("_row", F.lit(seed)), F.col("_n"))
    keyed = keyed.withColumn("_row", F.monotonically_increasing_id()).join(F.broadcast(split) if len(hot) <= FEW else split, "_bucket", "left")
    keyed = keyed.withColumn("_bucket", F.when(piece > 0, F.col("_first") + piece - 1).otherwise(F.col("_bucket")).cast("int")).drop("_row", "_n", "_first")
    keyed = written(keyed, "split")  # places in the input may differ from one reading to the next
    return keyed, bucket_counts(keyed, int(first[-1] + pieces[-1]))[0]


def shards(docs: DataFrame, n_shards: int = 16, seed: int = 17, bucket_mb: float = 24) -> DataFrame:
    """All columns of docs with size, text_crc32, shard and slot.  Law ``rows``: shard counts are at most one apart."""
    keyed, counts = bucketed(docs, seed, bucket_mb)
    total, n = int(counts.sum()), len(counts)
    starts = docs.sparkSession.sparkContext.broadcast(np.cumsum(counts) - counts)
    low, extra = divmod(total, n_shards)
    head = extra * (low + 1)
    kept = keyed.drop("_bucket").schema
    schema = T.StructType([*kept.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    names, at = [f.name for f in schema.fields], keyed.columns.index("_bucket")

    def placed(table: pa.Table, bucket: int) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text_crc32", "ascending"), ("size", "ascending")])
        place = int(starts.value[bucket]) + np.arange(table.num_rows)
        shard = np.where(place < head, place // (low + 1), extra + (place - head) // max(low, 1))
        slot = place - shard * low - np.minimum(shard, extra)
        table = table.take(pa.array(fisher_yates(table.num_rows, [seed, bucket]))).drop_columns(["_bucket"])
        return table.append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(slot))

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        held.clear()
        buckets = table.column(at).to_numpy()
        for bucket in np.unique(buckets).tolist():
            own = placed(table if (buckets == bucket).all() else table.filter(pa.array(buckets == bucket)), bucket)
            yield from own.select(names).to_batches(max_chunksize=5000)

    return keyed.repartitionById(n, F.col("_bucket")).mapInArrow(shuffle, schema) if n > 1 else keyed.coalesce(1).mapInArrow(shuffle, schema)


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot among 16 shards under the law ``rows``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
