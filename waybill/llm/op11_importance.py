"""Importance resampling towards a target corpus through a dictionary of distinct features.

Features are runs of one and two words.  A block of texts counts its features by document and deals its
distinct strings to shards: first words travel once, each with the second words and the documents of
its features.  A shard merges the strings of all blocks into its part of the dictionary, counts every
string over the corpus, hashes each distinct string once to its bucket, adds up the buckets, and writes
the blocks' per-document feature counts with buckets in place of strings.  The totals of the buckets,
of the corpus and of the target, give one gain for each bucket (a table of ``BUCKETS`` numbers), which is
joined to the per-document counts and summed by document.  Documents are drawn without replacement by
the largest sums of weight and Gumbel noise.

Strings are dealt by their first word; a first word that holds several times a shard's share of a
block's features is dealt by whole strings and block instead, so it reaches many shards (its strings are
then hashed once in each of them; totals of buckets do not change).

Null texts and texts without words have no features and weight 0, and like all texts of fewer than
``least_words`` words they are never drawn; null ids are hashed as an empty string and lose ties.  Equal rows are separate documents with
equal scores, ranked next to each other.  An empty table gives no rows, an empty target counts no
features.  Extra columns are not carried by ``resampled`` and are kept by ``drawn``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.operators.order import ranked

from .kernel import LOWER, U64, buffer_of, cut, exact_ids, gather, joined_hash, mix, slices, span_hash, window_rows, word_spans
from .repeats import squeezed, unsqueezed
from .store import estimated_bytes, fresh, row_key, spread, written

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
BLOCK_BYTES, SHARD_BYTES = 2 << 20, 3 << 20
#: A first word is dealt by whole strings above so many times a shard's share of the block, and so many features.
HOT, LEAST_HOT = 4, 64
STRINGS, DOCS, FEATURES, TOTALS = range(4)
ROWS = "block bigint, shard int, kind int, payload binary"

#: The separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
DELIM = np.zeros(256, bool)
DELIM[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of integers, each in the narrowest type that holds it, squeezed one by one with equal places of their bytes together."""
    head, parts = [], []
    for a in arrays:
        kind = np.result_type(np.min_scalar_type(a.min()), np.min_scalar_type(a.max())) if len(a) else np.dtype(np.uint8)
        a = np.ascontiguousarray(a, kind if kind.kind in "iu" else a.dtype)
        raw = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
        parts.append(squeezed(raw))
        head.append((len(a), a.itemsize * (-1 if a.dtype.kind == "i" else 1), len(parts[-1])))
    return b"".join([np.array([len(arrays)], np.int64).tobytes(), np.array(head, np.int64).tobytes(), *parts])


def unpacked(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    at, out = 8 + 24 * n, []
    for length, width, size in np.frombuffer(blob, np.int64, 3 * n, 8).reshape(-1, 3).tolist():
        raw = np.frombuffer(unsqueezed(blob[at : at + size], length * abs(width)), np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(abs(width), length).T).view(f"{'i' if width < 0 else 'u'}{abs(width)}").reshape(length))
        at += size
    return out


def words_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start, end and text of every word."""
    low = LOWER[buf]
    return low, *word_spans(low, offs, DELIM)


def heads(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)


def dealt(buf: np.ndarray, offs: np.ndarray, n_shards: int, block: int) -> tuple[np.ndarray, list[tuple[int, bytes]]]:
    """Words of each text, and (shard, payload) of the block's distinct features with their documents."""
    low, starts, ends, own = words_of(buf, offs)
    n_docs, n_words = len(offs) - 1, np.bincount(own, minlength=len(offs) - 1)
    if not len(starts):
        return n_words, []
    ids, first = exact_ids(low, starts, ends)
    begin, size, vocabulary = starts[first], ends[first] - starts[first], len(first)
    at = np.flatnonzero(window_rows(own, 2))
    # one number for first word, second word (0: none) and text
    single = ids * np.int64((vocabulary + 1) * n_docs) + own
    double = (ids[at] * np.int64(vocabulary + 1) + ids[at + 1] + 1) * n_docs + own[at]
    found, counts = np.unique(np.concatenate([single, double]), return_counts=True)
    feature, doc = found // n_docs, found % n_docs
    one, two = feature // (vocabulary + 1), feature % (vocabulary + 1) - 1
    h = span_hash(low, begin, begin + size)
    shard = h[one]
    hot = (np.bincount(one, minlength=vocabulary) > max(LEAST_HOT, HOT * len(one) / n_shards))[one]
    if hot.any():
        shard[hot] = mix(joined_hash(h[one[hot]], h[two[hot]] + (two[hot] < 0).astype(np.uint64)) + U64(block & 0x7FFFFFFFFFFFFFFF))
    shard = (shard % U64(n_shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = heads(shard[order])
    out = []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        some = order[a:b]
        f = heads(feature[some])
        f_one, f_two = one[some[f]], two[some[f]]
        w = heads(f_one)
        firsts, seconds = f_one[w], f_two[f_two >= 0]
        payload = packed(
            size[firsts], gather(low, begin[firsts], size[firsts]), np.diff(np.append(w, len(f))),
            np.where(f_two >= 0, size[f_two], 0), gather(low, begin[seconds], size[seconds]), np.diff(np.append(f, len(some))), doc[some], counts[some],
        )
        out.append((int(shard[some[0]]), payload))
    return n_words, out


def strings_of(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and lengths of the features of a payload, number of documents of each, documents and counts."""
    one_size, one, n_features, two_size, two, n_docs, doc, counts = unpacked(payload)
    own = np.repeat(np.arange(len(one_size)), n_features)
    one_size, two_size = one_size.astype(np.int64), two_size.astype(np.int64)
    source = np.concatenate([one, np.array([0x20], np.uint8), two])
    at = np.stack([(np.cumsum(one_size) - one_size)[own], np.full(len(own), len(one)), len(one) + 1 + np.cumsum(two_size) - two_size], 1)
    size = np.stack([one_size[own], (two_size > 0).astype(np.int64), two_size], 1)
    return gather(source, at.ravel(), size.ravel()), size.sum(1), n_docs.astype(np.int64), doc.astype(np.int64), counts.astype(np.int64)


def merged(payloads: list[bytes], n_buckets: int) -> tuple[np.ndarray, list[bytes]]:
    """Totals of the buckets, and for each payload its documents' feature counts by bucket."""
    held = [strings_of(p) for p in payloads]
    data, size = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
    ends = np.cumsum(size)
    ids, first = exact_ids(data, ends - size, ends)
    totals = np.zeros(len(first), np.int64)
    per_string = [np.add.reduceat(h[4], np.cumsum(h[2]) - h[2]) for h in held]
    np.add.at(totals, ids, np.concatenate(per_string))
    raw, crc = data.tobytes(), zlib.crc32
    bounds = zip((ends - size)[first].tolist(), ends[first].tolist(), strict=True)
    bucket = np.fromiter((crc(raw[a:b]) % n_buckets for a, b in bounds), np.int64, len(first))
    sums = np.zeros(n_buckets, np.int64)
    np.add.at(sums, bucket, totals)
    out, at = [], 0
    for _, lengths, n_docs, doc, counts in held:
        own = np.repeat(bucket[ids[at : at + len(lengths)]], n_docs)
        at += len(lengths)
        order = np.lexsort((own, doc))
        begin = heads(doc[order])
        out.append(packed(doc[order][begin], np.diff(np.append(begin, len(order))), own[order], counts[order]))
    return sums, out


def dictionary(docs: DataFrame, n_buckets: int = BUCKETS, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, kind, payload) of docs (doc_id, key, text): what each block's documents are, their feature counts by bucket, and totals of buckets."""
    n_shards = max(1, int(-(-estimated_bytes(docs) * 2 // shard_bytes)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            buf, offs = buffer_of(batch.column(2))
            for a, b in slices(offs, block_bytes):
                block = part << 32 | made
                made += 1
                n_words, sent = dealt(*cut(buf, offs, a, b), n_shards, block)
                known = batch.column(0).slice(a, b - a)
                ids = np.asarray(known.fill_null(0))
                whole = packed(ids, np.asarray(known.is_valid().cast(pa.int8())), np.asarray(batch.column(1).slice(a, b - a)), n_words)
                rows = [(block, block % n_shards, DOCS, whole), *((block, s, STRINGS, p) for s, p in sent)]
                for low in range(0, len(rows), 256):
                    blocks, shards, kinds, blobs = zip(*rows[low : low + 256], strict=True)
                    columns = [pa.array(blocks, pa.int64()), pa.array(shards, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["block", "shard", "kind", "payload"])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("kind", "ascending")])
        blocks, kinds, blobs = (table.column(c).to_pylist() for c in ("block", "kind", "payload"))
        rows = [(b, k, p) for b, k, p in zip(blocks, kinds, blobs, strict=True) if k == DOCS]
        strings = [(b, p) for b, k, p in zip(blocks, kinds, blobs, strict=True) if k == STRINGS]
        if strings:
            sums, found = merged([p for _, p in strings], n_buckets)
            rows += [(b, FEATURES, p) for (b, _), p in zip(strings, found, strict=True)] + [(-1, TOTALS, packed(sums))]
        out = list(zip(*rows, strict=True))
        return pa.table({"block": pa.array(out[0], pa.int64()), "kind": pa.array(out[1], pa.int32()), "payload": pa.array(out[2], pa.binary())})

    sent = spread(docs).mapInArrow(pack, ROWS)
    return written(sent.groupBy("shard").applyInArrow(merge, "block bigint, kind int, payload binary"), "dictionary")


def bucket_totals(held: DataFrame, n_buckets: int = BUCKETS) -> np.ndarray:
    """Features of the corpus in every bucket; one number for each bucket comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                sums += unpacked(blob)[0].astype(np.int64)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["bucket", "n"])

    rows = held.filter(F.col("kind") == TOTALS).select("payload").mapInArrow(run, "bucket bigint, n bigint")
    found, out = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow(), np.zeros(n_buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """How much more of the target than of the corpus lies in each bucket, smoothed, in thousandths of a natural logarithm."""
    n, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(held: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, key, n_words, n_features and weight of every document of the dictionary."""
    shared = held.sparkSession.sparkContext.broadcast(gain)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, blobs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, (kind, blob) in enumerate(zip(kinds, blobs, strict=True)):
                if kind == FEATURES:
                    doc, n, bucket, counts = unpacked(blob)
                    each = shared.value[bucket] * counts.astype(np.int64)
                    blobs[i] = packed(doc, np.add.reduceat(each, np.cumsum(n.astype(np.int64)) - n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], ["block", "kind", "payload"])

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_pylist(), table.column("payload").to_pylist()
        ids, known, row, n_words = (a.astype(np.int64) for a in unpacked(blobs[kinds.index(DOCS)]))
        total = np.zeros(len(ids), np.int64)
        for kind, blob in zip(kinds, blobs, strict=True):
            if kind == FEATURES:
                doc, part = unpacked(blob)
                total[doc] += part.astype(np.int64)
        n_features = np.maximum(2 * n_words - 1, 0)
        weight = np.where(n_features > 0, total // np.maximum(n_features, 1), 0)
        columns = [pa.array(ids, mask=known == 0), pa.array(row), pa.array(n_words), pa.array(n_features), pa.array(weight)]
        return pa.table(dict(zip(("doc_id", "key", "n_words", "n_features", "weight"), columns, strict=True)))

    rows = held.filter(F.col("kind").isin(DOCS, FEATURES)).mapInArrow(sums, "block bigint, kind int, payload binary")
    return rows.groupBy("block").applyInArrow(finish, "doc_id bigint, key bigint, n_words bigint, n_features bigint, weight bigint")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, n_buckets: int = BUCKETS, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, key (of the row), n_words, n_features, weight, score and rank (from 1, null if not drawn) of every document."""
    keyed = docs.select(F.col("doc_id").cast("long"), row_key().alias("key"), "text")
    held = dictionary(keyed, n_buckets, shard_bytes, block_bytes)
    goal = dictionary(target.select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("key"), "text"), n_buckets, shard_bytes, block_bytes)
    found = weighed(held, gains(bucket_totals(held, n_buckets), bucket_totals(goal, n_buckets)))
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    noise = F.floor(-1000 * F.log(-F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0)))
    scored = written(found.withColumn("score", F.col("weight") + noise), "scored")
    able = scored.filter(F.col("n_words") >= least_words)
    most = able.count() * percent // 100
    keys = able.withColumn("_late", F.col("doc_id").isNull()).withColumn("_score", -F.col("score"))
    placed = ranked(keys, ["_score", "_late", "doc_id", "key"], "rank").withColumn("rank", F.when(F.col("rank") < most, F.col("rank") + 1))
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.select(*scored.columns, F.col("rank").cast("long")).union(rest)


def drawn(docs: DataFrame, target: DataFrame, **options: int) -> DataFrame:
    """The rows of docs that are drawn; rows equal in id and text go together."""
    (key,) = fresh(docs, "_key")
    chosen = resampled(docs, target, **options).filter("rank IS NOT NULL").select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, row_key()).join(chosen, key, "left_semi").select(*docs.columns)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, drawn towards the benchmark."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resampled(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_FEATURES = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"

OP11_SQL = rf"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
d AS (SELECT doc_id, w, {_FEATURES} AS f FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
s AS (SELECT doc_id, len(w) AS n_words, len(f)::BIGINT AS n_features FROM d),
counts AS (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest(f) AS f FROM d) GROUP BY ALL),
goal AS (SELECT f, count(*) AS n FROM (SELECT unnest({_FEATURES}) AS f FROM (SELECT {_WORDS} AS w FROM benchmark)) GROUP BY f),
strings AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM counts UNION SELECT f FROM goal)),
hashed AS (
  SELECT f, xor(list_reduce(list_transform(range(1, length(h) + 1, 2), lambda i: ('0x' || h[i:i + 1])::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM strings CROSS JOIN crc),
have AS (SELECT bucket, sum(n)::BIGINT AS n FROM counts JOIN hashed USING (f) GROUP BY bucket),
want AS (SELECT bucket, sum(n)::BIGINT AS n FROM goal JOIN hashed USING (f) GROUP BY bucket),
gain AS (
  SELECT range AS bucket, floor(1000 * ln((coalesce(want.n, 0) + 1) * ((SELECT sum(n) FROM have) + 10000)::DOUBLE / ((coalesce(have.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM want) + 10000))))::BIGINT AS g
  FROM range(10000) LEFT JOIN have ON have.bucket = range LEFT JOIN want ON want.bucket = range),
sums AS (SELECT doc_id, sum(n * g)::BIGINT AS total FROM counts JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, n_words, n_features, coalesce(floor(total::DOUBLE / n_features)::BIGINT, 0) AS weight, ('0x' || sha256(concat('7:', doc_id))[1:8])::BIGINT AS h FROM s LEFT JOIN sums USING (doc_id)),
placed AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM scored),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM placed WHERE n_words >= 20)
SELECT placed.doc_id, n_features, weight, score, CASE WHEN r <= 25 * n // 100 THEN r END AS rank FROM placed LEFT JOIN ranks USING (doc_id)
"""
