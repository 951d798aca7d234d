"""Near duplicates by SimHash fingerprints, compared exactly in tiles.

A fingerprint bit is the majority of that bit over the XXH64 hashes of a text's word shingles.
Distinct fingerprints are sorted by the population counts of their eight bytes and cut into blocks,
blocks into tiles.  Two fingerprints differ in at least as many bits as the sum of the differences of
their bytes' counts, so a pair of blocks or tiles is skipped when the gaps between their ranges of
counts add up to more than the radius; all other pairs are compared whole, by exclusive-or and bit
counts.  Within a comparison links are merged to components at once, so a group of near copies leaves
one edge for each member.  Components over all blocks are those of these edges.

Equal fingerprints count once in the comparison, so any number of equal texts costs one.  Texts of
fewer words than a shingle are one shingle; null texts and texts without words have fingerprint zero,
which is linked like any other.  Null ids get a component like others, but never name one unless all ids
in it are null.  Repeated rows get a row each; an empty table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components, least_labels
from .kernel import LOWER, U64, buffer_of, cut, joined_words, slices, window_rows
from .store import spread, written

SHINGLE, RADIUS, SEED = 4, 4, 42
#: About so many blocks, of so many fingerprints at least and at most.
BLOCKS, LEAST_BLOCK, MOST_BLOCK = 64, 1 << 14, 1 << 20
TILE, WIDE, HELD = 256, 4096, 1 << 20
HASHED = 1 << 18
#: Comparisons of a task, if none were skipped.
COMPARED = 400_000_000


def shingle_hashes(buf: np.ndarray, offs: np.ndarray, k: int = SHINGLE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 and text of every shingle, repeats included, in the order of the texts."""
    import xxhash

    data, starts, ends, own = joined_words(LOWER[buf], offs)
    at = np.flatnonzero(window_rows(own, k))
    begin, end, text = starts[at], ends[at + k - 1], own[at]
    n_words = np.bincount(own, minlength=len(offs) - 1)
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        first = np.searchsorted(own, short)
        text = np.concatenate([text, short])
        order = np.argsort(text, kind="stable")
        begin = np.concatenate([begin, starts[first]])[order]
        end, text = np.concatenate([end, ends[first + n_words[short] - 1]])[order], text[order]
    raw, digest = data.tobytes(), xxhash.xxh64_intdigest
    hashes = np.empty(len(text), np.uint64)
    for low in range(0, len(text), HASHED):
        a, b = begin[low : low + HASHED].tolist(), end[low : low + HASHED].tolist()
        hashes[low : low + HASHED] = np.fromiter((digest(raw[i:j], seed) for i, j in zip(a, b, strict=True)), np.uint64, len(a))
    return hashes, text


def majority(hashes: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
    """The fingerprints of n texts; bits are counted two at a time in the halves of 64-bit sums."""
    out = np.zeros(n, np.uint64)
    if len(hashes):
        some = np.unique(texts)
        begin = np.searchsorted(texts, some)
        size = np.diff(np.append(begin, len(texts))).astype(np.uint64)
        for bit in range(32):
            sums = np.add.reduceat((hashes >> U64(bit)) & U64(0x100000001), begin)
            for half in (0, 32):
                count = (sums >> U64(half)) & U64(0xFFFFFFFF)
                out[some] |= (count * U64(2) > size).astype(np.uint64) << U64(bit + half)
    return out


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = buffer_of(batch.column(1))
            for a, b in slices(offs):
                found = majority(*shingle_hashes(*cut(buf, offs, a, b), k), b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id bigint, fp bigint")


def byte_counts(fps: np.ndarray) -> np.ndarray:
    """The population counts of the eight bytes, the highest first."""
    return np.bitwise_count(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8))[:, ::-1]


def order_key(fp: Column) -> Column:
    """The counts of ``byte_counts`` as one number that sorts like them."""
    digits = [F.bit_count(F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))).cast("long") * F.lit(16**i) for i in range(8)]
    return sum(digits[1:], digits[0])


def gaps(low: np.ndarray, high: np.ndarray, of_low: np.ndarray, of_high: np.ndarray) -> np.ndarray:
    """The least distance that the ranges of counts allow between one box and many."""
    return np.maximum(np.maximum(low - of_high, of_low - high), 0).sum(1)


def boxes(counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum.reduceat(counts, starts).astype(np.int16), np.maximum.reduceat(counts, starts).astype(np.int16)


def compared(a: np.ndarray, b: np.ndarray | None, radius: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints linked between two blocks, or within one (b None), and the label of each; blocks are in tile order."""
    right = a if b is None else b
    nodes = a if b is None else np.concatenate([a, b])
    shift = 0 if b is None else len(a)
    label = np.arange(len(nodes))
    held: list[np.ndarray] = []

    def merge() -> None:
        nonlocal label
        if held:
            pairs = label[np.concatenate(held)]
            held.clear()
            label = least_labels(len(nodes), pairs)[label]

    starts, to = np.arange(0, len(a), tile), np.arange(0, len(right), tile)
    low, high = boxes(byte_counts(a), starts)
    to_low, to_high = boxes(byte_counts(right), to)
    for t, s in enumerate(starts.tolist()):
        near = gaps(to_low, to_high, low[t], high[t]) <= radius
        if b is None:
            near[:t] = False
        columns = np.flatnonzero(np.repeat(near, np.diff(np.append(to, len(right)))))
        left = a[s : s + tile, None]
        for c in range(0, len(columns), WIDE):
            some = columns[c : c + WIDE]
            i, j = np.nonzero(np.bitwise_count(left ^ right[some]) <= radius)
            i, j = i + s, some[j]
            if b is None:
                i, j = i[i < j], j[i < j]
            if len(i):
                held.append(np.stack([i, j + shift], 1))
                if sum(map(len, held)) > HELD:
                    merge()
    merge()
    linked = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[linked], nodes[label[linked]]


def blocks(distinct: DataFrame, n_blocks: int, most: int = MOST_BLOCK) -> DataFrame:
    """(block, low, high, fps): runs of at most ``most`` fingerprints in tile order, with the ranges of their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0).to_numpy() for b in batches if b.num_rows]
        fps = np.concatenate(held).view(np.uint64) if held else np.zeros(0, np.uint64)
        counts = byte_counts(fps)
        order = np.lexsort((fps, *counts.T[::-1])) if len(fps) else []
        fps, counts = fps[order], counts[order]
        for a in range(0, len(fps), most):
            part = counts[a : a + most]
            columns = [[part.min(0).tobytes()], [part.max(0).tobytes()], [fps[a : a + most].tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["low", "high", "fps"])

    dealt = distinct.select("fp", order_key(F.col("fp")).alias("at")).repartitionByRange(n_blocks, "at", "fp").select("fp")
    held = dealt.mapInArrow(run, "low binary, high binary, fps binary")
    return written(held.withColumn("block", F.monotonically_increasing_id()), "blocks")


def block_pairs(held: DataFrame, radius: int) -> tuple[DataFrame, int]:
    """(pair, block) for both blocks of each pair that may hold links; 24 bytes for each block come to the driver."""
    bounds = held.select("block", "low", "high").toArrow()
    ids = bounds.column("block").to_numpy()
    low, high = (np.frombuffer(b"".join(bounds.column(c).to_pylist()), np.uint8).reshape(-1, 8).astype(np.int16) for c in ("low", "high"))
    near = [i + np.flatnonzero(gaps(low[i:], high[i:], low[i], high[i]) <= radius) for i in range(len(ids))]
    places = np.stack([np.repeat(np.arange(len(ids)), [len(x) for x in near]), np.concatenate([*near, np.zeros(0, np.int64)])], 1).astype(np.int64)
    pair = np.arange(len(places))
    other = places[:, 0] != places[:, 1]
    table = pa.table({"pair": np.concatenate([pair, pair[other]]), "block": np.concatenate([ids[places[:, 0]], ids[places[other, 1]]])})
    return held.sparkSession.createDataFrame(table), len(places)


def links(distinct: DataFrame, radius: int = RADIUS, n_blocks: int = BLOCKS, least: int = LEAST_BLOCK, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that span the components of all fingerprints (fp) at the radius or less."""
    count = distinct.count()
    held = blocks(distinct, max(1, min(n_blocks, count // least), count // MOST_BLOCK))
    pairs, n_pairs = block_pairs(held, radius)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        sides = [np.frombuffer(x, np.uint64) for x in table.column("fps").to_pylist()]
        a, b = compared(sides[0], sides[1] if len(sides) > 1 else None, radius, tile)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    n_tasks = max(distinct.sparkSession.sparkContext.defaultParallelism, count * count // (2 * COMPARED))
    sent = pairs.join(held.select("block", "fps"), "block").repartition(max(1, min(n_pairs, n_tasks)), "pair")
    return sent.groupBy("pair").applyInArrow(run, "a bigint, b bigint")


def near_copies(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS, n_blocks: int = BLOCKS, least: int = LEAST_BLOCK, tile: int = TILE) -> DataFrame:
    """doc_id, fp, label (the component's least fingerprint) and component_id (its least doc_id) for every row."""
    held = written(fingerprints(docs, k), "fingerprints")
    distinct = written(held.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    joined = components(links(distinct.select("fp"), radius, n_blocks, least, tile))
    found = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    heads = found.groupBy("label").agg(F.min("least").alias("component_id"))
    return held.join(found.join(heads, "label").select("fp", "label", "component_id"), "fp").select("doc_id", "fp", "label", "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
