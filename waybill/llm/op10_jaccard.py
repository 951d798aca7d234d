"""Similarity join of texts on five-word shingles by a MinHash LSH forest.

Equal texts count once.  Every text gets ``TREES`` prefixes of ``DEPTH`` MinHash values; in a tree the
texts are sorted by prefix, and the matched prefix is shortened from the full depth until the
expected recall at the threshold reaches the target.  At each depth the texts that share a prefix are
compared with a pivot by their whole signatures: very close ones are settled with the pivot, close
ones stay but are linked to it, so a group costs one comparison per text and pivot, and by the
triangle inequality two texts over the threshold end in the same candidate component.  In a component
all pairs of texts are verified exactly on their shingle sets, in blocks that grow with the root of its
size, so a large one is spread over many tasks.  Classes are the components of the verified links.

Texts of one to four words have one shingle, all their words; null or blank texts have none and stay
alone, each distinct text in its class.  Repeated rows get a row each; an empty table gives no rows;
extra columns are not carried by ``classes`` and are kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components, least_labels
from .kernel import U64, buffer_of, cut, mix, slices, span_hash, window_hash, window_rows, word_spans
from .store import fresh, parts, spread, written

SHINGLE, THRESHOLD, TREES, DEPTH, RECALL = 5, 0.8, 16, 6, 0.9999
SETTLED, LINKED = 0.7, 0.2
#: Texts of a component that are compared in one task at least; grows with the root of its size up to MOST_BLOCK.
BLOCK, MOST_BLOCK, COLUMNS = 320, 2048, 2048
_MULTIPLIERS = np.random.default_rng(20240301).integers(1, 1 << 62, TREES * DEPTH, dtype=np.uint64) * U64(2) + U64(1)


def shingles(buf: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every shingle, in the order of the texts; repeats stay."""
    starts, ends, own = word_spans(buf, offs)
    h = span_hash(buf, starts, ends)
    at = np.flatnonzero(window_rows(own, k))
    keys, texts = window_hash(h, k)[at], own[at]
    n_words = np.bincount(own, minlength=len(offs) - 1)
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        begin = np.searchsorted(own, short)
        whole = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            more = n_words[short] > i
            whole[more] = mix(whole[more] * U64(0x9E3779B97F4A7C15) + h[begin[more] + i])
        keys, texts = np.concatenate([keys, whole]), np.concatenate([texts, short])
        order = np.argsort(texts, kind="stable")
        keys, texts = keys[order], texts[order]
    return keys, texts


def signatures(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16-bit MinHash values of every text, and which texts have shingles."""
    keys, texts = shingles(buf, offs)
    out = np.zeros((len(offs) - 1, len(_MULTIPLIERS)), np.uint16)
    some = np.unique(texts)
    if len(some):
        begin = np.searchsorted(texts, some)
        for i, m in enumerate(_MULTIPLIERS):
            out[some, i] = mix(np.minimum.reduceat(keys * m, begin)) >> U64(48)
    has = np.zeros(len(out), bool)
    has[some] = True
    return out, has


def least_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, target: float = RECALL) -> int:
    """The longest prefix whose expected recall at the threshold reaches the target."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def prefix_keys(sig: np.ndarray, depth: int) -> np.ndarray:
    """One key for each text and tree: the first ``depth`` values of the tree."""
    values = sig.reshape(len(sig), TREES, DEPTH)[:, :, :depth].astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, TREES + 1, dtype=np.uint64)), values.shape[:2]).copy()
    for d in range(depth):
        key = mix(key * U64(0x9E3779B97F4A7C15) + values[:, :, d] + U64(1))
    return key.view(np.int64)


def signed(docs: DataFrame, depth: int) -> DataFrame:
    """(tid, doc_id, sig, keys) of rows (tid, doc_id, text); keys is empty where there are no shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = buffer_of(batch.column(2))
            for a, b in slices(offs):
                sig, has = signatures(*cut(buf, offs, a, b))
                raw = sig.tobytes()
                width = sig.shape[1] * 2
                bounds = np.append(0, np.cumsum(has * TREES)).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(bounds), pa.array(prefix_keys(sig[has], depth).ravel()))
                sigs = pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), sigs, keys], ["tid", "doc_id", "sig", "keys"])

    return spread(docs).mapInArrow(run, "tid bigint, doc_id bigint, sig binary, keys array<bigint>")


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(-1)


def pivoted(group: np.ndarray, sig: np.ndarray, alive: np.ndarray) -> list[np.ndarray]:
    """Edges (rows of two places) of groups of equal prefixes; settles places in ``alive``."""
    order = np.flatnonzero(alive)
    order = order[np.argsort(group[order], kind="stable")]
    g = group[order]
    heads = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, int)
    size = np.diff(np.append(heads, len(g)))
    two = heads[size == 2]
    edges = []
    if len(two):
        a, b = order[two], order[two + 1]
        near = agreement(sig[a], sig[b])
        alive[b[near >= SETTLED]] = False
        edges.append(np.stack([a, b], 1)[near >= LINKED])
    for h, n in zip(heads[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        pool = order[h : h + n]
        while len(pool) > 1:
            near = agreement(sig[pool[1:]], sig[pool[0]])
            rest = pool[1:]
            linked = rest[near >= LINKED]
            edges.append(np.stack([np.full(len(linked), pool[0]), linked], 1))
            alive[rest[near >= SETTLED]] = False
            pool = rest[near < SETTLED]
    return edges


def candidate_edges(matches: DataFrame, n_buckets: int, least: int) -> DataFrame:
    """Edges that span the groups of texts (key, tid, sig) that share a key and are close by their
    signatures: at most one for each text and bucket."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tids, keys = table.column("tid").to_numpy(), table.column("key").to_numpy()
        order = np.lexsort((tids, keys))
        tids, keys = tids[order], keys[order]
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(len(order), -1)[order]
        tree = np.zeros(len(order), np.int64)
        for t in range(TREES):
            tree[prefix_keys(sig, least)[:, t] == keys] = t
        values = sig.reshape(len(sig), TREES, DEPTH)[np.arange(len(sig)), tree]
        edges, alive = [], np.ones(len(order), bool)
        for depth in range(DEPTH, least - 1, -1):
            trie = np.lexsort((*(values[:, d] for d in range(depth - 1, -1, -1)), keys))
            differs = (keys[trie][1:] != keys[trie][:-1]) | (values[trie, :depth][1:] != values[trie, :depth][:-1]).any(1)
            group = np.empty(len(trie), np.int64)
            group[trie] = np.append(0, np.cumsum(differs))
            edges += pivoted(group, sig, alive)
        nodes, place = np.unique(tids, return_inverse=True)
        label = least_labels(len(nodes), place[np.concatenate(edges)] if edges else np.zeros((0, 2), np.int64))
        linked = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.table({"a": pa.array(nodes[linked]), "b": pa.array(nodes[label[linked]])})

    dealt = matches.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(n_buckets)).cast("int"))
    return dealt.groupBy("bucket").applyInArrow(run, "a bigint, b bigint")


def common_counts(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Size of the intersection of the sets [0, left) with those from left on; with left 0, of all with all."""
    n, size = len(sets), np.array([len(s) for s in sets])
    flat, own = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, own = flat[order], own[order]
    new = np.append(True, flat[1:] != flat[:-1])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    _, column = np.unique(column[shared], return_inverse=True)
    own = own[shared]
    inter = np.zeros((left or n, n - left), np.float32)
    cuts = np.searchsorted(column, np.arange(0, int(column[-1]) + 1 if len(column) else 1, COLUMNS))
    for a, b in zip(cuts, [*cuts[1:], len(column)], strict=True):
        block = np.zeros((n, COLUMNS), np.float32)
        block[own[a:b], column[a:b] % COLUMNS] = 1
        inter += block[: left or n] @ block[left:].T
    return inter


def linked(sets: list[np.ndarray], left: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Number of links of each set and the least member of its component; links are between the sets before and from left on, or among all."""
    n, size = len(sets), np.array([len(s) for s in sets])
    inter, links, label = common_counts(sets, left), np.zeros(n, np.int64), np.arange(n)
    for low in range(0, len(inter), 256):
        part = inter[low : low + 256]
        either = size[low : low + len(part), None] + size[None, left:] - part
        near = (part >= threshold * either - 1e-6) & (either > 0)
        if not left:
            near[np.arange(len(part)), low + np.arange(len(part))] = False
        a, b = np.nonzero(near)
        if not len(a):
            continue
        links += np.bincount(a + low, minlength=n) + (np.bincount(b + left, minlength=n) if left else 0)
        pairs = np.unique(label[a + low] * n + label[b + left])
        label = least_labels(n, np.stack([pairs // n, pairs % n], 1))[label]
    return links, label


def verified(members: DataFrame, docs: DataFrame, n_tasks: int, threshold: float) -> DataFrame:
    """(tid, links, label) for each text and block pair of its component; members: (tid, doc, comp, size)."""
    block = F.least(F.lit(float(MOST_BLOCK)), F.greatest(F.lit(float(BLOCK)), F.sqrt("size") * BLOCK / 20))
    n_blocks = F.ceil(F.col("size") / block).cast("int")
    placed = members.withColumn("n", n_blocks).withColumn("own", F.pmod(F.xxhash64("tid", F.lit(5)), F.col("n")).cast("int"))
    texts = docs.join(placed, ["tid", "doc"]).select("tid", "comp", "n", "own", "text").dropDuplicates(["tid"])
    pairs = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pairs = pairs.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    task = F.pmod(F.xxhash64("comp", "i", "j"), F.lit(n_tasks)).cast("int")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        comp, i, j, own, tid = (table.column(c).to_numpy() for c in ("comp", "i", "j", "own", "tid"))
        order = np.lexsort((tid, own, j, i, comp))
        heads = np.flatnonzero(np.append(True, (np.diff(comp[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)))
        keys, texts = shingles(*buffer_of(table.column("text")))
        bounds = np.searchsorted(texts, np.arange(len(tid) + 1))
        out: list[tuple] = []
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(order)], strict=True):
            rows = order[a:b]
            sets = [np.unique(keys[bounds[r] : bounds[r + 1]]) for r in rows]
            first = i[rows[0]]
            left = int((own[rows] == first).sum()) if j[rows[0]] != first else 0
            if left == len(rows) and j[rows[0]] != first:
                continue
            links, label = linked(sets, left, threshold)
            some = links > 0
            out.append((tid[rows][some], links[some], tid[rows][label[some]]))
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("tid", "links", "label"), columns, strict=True)))

    return pairs.drop("n", "other").withColumn("task", task).groupBy("task").applyInArrow(run, "tid bigint, links bigint, label bigint")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """For each row doc_id, tid (its text), label (of its class), class_id (the least doc_id of its class), class_size,
    n_links (other texts at or over the threshold) and n_copies (rows with its text).  Where ids repeat, classes can share
    their least doc_id: the one with the least label keeps it as class_id, the others get their label."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn("tid", F.xxhash64("text"))
    depth = least_depth(threshold)
    n = parts(rows, 4)
    texts = signed(rows.select("tid", "doc_id", "text"), depth).groupBy("tid").agg(
        F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("doc"), F.min("doc_id").alias("least"), F.count("*").alias("n_copies"), F.first("sig").alias("sig"), F.first("keys").alias("keys")
    )
    texts = written(texts, "texts")
    keys = texts.select("tid", F.explode("keys").alias("key"))
    met = keys.groupBy("key").count().filter("count > 1").select("key")
    matches = keys.join(met, "key").join(texts.select("tid", "sig"), "tid")
    near = components(candidate_edges(matches, 4 * n, depth))
    sizes = near.groupBy("label").agg(F.count("*").alias("size"))
    members = near.join(sizes, "label").join(texts.select(F.col("tid").alias("node"), "doc"), "node")
    members = members.select(F.col("node").alias("tid"), "doc", F.col("label").alias("comp"), "size")
    keyed = rows.select("tid", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), "text")
    links = written(verified(members, keyed, 4 * n, threshold), "links")
    joined = components(links.select(F.col("tid").alias("a"), F.col("label").alias("b")))
    counts = links.groupBy("tid").agg(F.sum("links").alias("n_links"))
    full = (
        texts.select("tid", "least", "n_copies")
        .join(joined.withColumnRenamed("node", "tid"), "tid", "left")
        .join(counts, "tid", "left")
        .select("tid", "least", "n_copies", F.coalesce("label", "tid").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    heads = full.groupBy("label").agg(F.coalesce(F.min("least"), F.min("label")).alias("class_id"), F.sum("n_copies").alias("class_size"))
    owners = heads.groupBy("class_id").agg(F.min("label").alias("owner"))
    heads = heads.join(owners, "class_id").withColumn("class_id", F.when(F.col("owner") == F.col("label"), F.col("class_id")).otherwise(F.col("label")))
    full = full.join(heads.drop("owner"), "label").select("tid", "label", "class_id", "class_size", "n_links", "n_copies")
    return rows.select("doc_id", "tid").join(full, "tid")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs with the least doc_id of every class."""
    found = classes(docs, threshold)
    best = F.coalesce("doc_id", F.lit(-(1 << 63)))
    heads = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), best.alias("doc"), F.col("tid"))).alias("m"))
    doc, tid = fresh(docs, "_doc", "_tid")
    heads = heads.select(F.col("m.doc").alias(doc), F.col("m.tid").alias(tid))
    keyed = docs.withColumn(tid, F.xxhash64(F.coalesce("text", F.lit("")))).withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    return keyed.join(heads, [doc, tid]).dropDuplicates([doc, tid]).select(*docs.columns)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and links of every document."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "class_size", "n_links", "n_copies")
