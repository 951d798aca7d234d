"""Language-model scoring by a hidden Markov model.

Tokens are lower-cased words and one end per text.  Exact token counts over all training texts are
summed by buckets of word hashes and returned to the slices of the input that hold the words.  Hidden
states emit word classes: each word with a share of at least ``FREQUENT`` of the training tokens is a
class of its own (so there are at most 1 / FREQUENT of them), other words are classed by their
ending, and words never seen in training are one class.  A word's share of its class is its
add-one unigram share, so the model is a distribution over the same V + 1 types as the unigram
base, and the score is the base score plus the log likelihood ratio of the class sequence.  The
unseen class gets the Good-Turing mass, that of the words seen once.

Baum-Welch: an iteration computes expected counts for all training texts and adds them up across
partitions; long texts are cut into sequences of at most ``SEGMENT`` tokens, of which only the first
starts from the start probabilities, the others from the steady state.  The starting point comes from
all training texts too: how often each class stands before and behind each of the ``NEAR`` most frequent
ones is counted exactly, classes with like neighbours are put together, and each state begins with one
such group.  The driver sees a row of counts for each class, of which there are a bounded number.  Scoring runs the scaled forward recursion over every whole text.

Null text counts as empty (only the end token), a null id is hashed as an empty string; repeated rows
are scored each; an empty table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import U64, buffer_of, cut, mix, slices, span_hash, word_spans
from .repeats import squeezed, unsqueezed
from .store import parts, spread, written

STATES, ITERATIONS, SEGMENT, NEAR = 8, 6, 512, 48
FREQUENT, ENDINGS = 2e-5, 2048
SLICE = 4 << 20
END_HASH = U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

TOKENS = "slice bigint, ids binary, nulls binary, held binary, sizes binary, tokens binary, n_tokens bigint, hashes binary, counts binary, endings binary, n_train bigint"


def numbers(blob: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(blob, kind)


def record(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)


def token_slices(docs: DataFrame) -> DataFrame:
    """Slices of the input: token numbers of every text, and the hash, training count and ending of every distinct word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = (TaskContext.get().partitionId() << 24) if TaskContext.get() else 0
        names = [c.split()[0] for c in TOKENS.split(", ")]
        types = [pa.int64(), *[pa.binary()] * 5, pa.int64(), *[pa.binary()] * 3, pa.int64()]
        for batch in batches:
            ids, nulls = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            held = batch.column(1).to_numpy(zero_copy_only=False)
            buf, offs = buffer_of(batch.column(2))
            for a, b in slices(offs, SLICE):
                data, at = cut(buf, offs, a, b)
                data = LOWER[data]
                starts, ends, own = word_spans(data, at)
                h = span_hash(data, starts, ends)
                uniq, first, token = np.unique(h, return_index=True, return_inverse=True)
                trained = ~held[a:b][own]
                counts = np.bincount(token[trained], minlength=len(uniq)).astype(np.int32)
                tail = data[ends[first] - 1].astype(np.uint64)
                for back in (2, 3):
                    tail = tail * U64(257) + np.where(ends[first] - back >= starts[first], data[np.maximum(ends[first] - back, 0)], 0)
                endings = (mix(tail) % U64(ENDINGS)).astype(np.uint16)
                sizes = np.bincount(own, minlength=b - a).astype(np.int32)
                raw = token.astype(np.int32).tobytes()
                yield record(
                    [(
                        number, ids[a:b].tobytes(), nulls[a:b].tobytes(), held[a:b].tobytes(), sizes.tobytes(), squeezed(raw), len(token),
                        uniq.tobytes(), squeezed(counts.tobytes()), endings.tobytes(), int(trained.sum() + (~held[a:b]).sum()),
                    )], names, types)
                number += 1

    return spread(docs).mapInArrow(run, TOKENS)


def word_totals(held: DataFrame, n_buckets: int, least: int) -> DataFrame:
    """By slice and bucket the training count of every word; rows without a slice hold the statistics of a bucket."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for s, hashes, counts, endings in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                h, e = numbers(hashes, np.uint64), numbers(endings, np.uint16)
                c = numbers(unsqueezed(counts, 4 * len(h)), np.int32)
                b = (h % U64(n_buckets)).astype(np.int64)
                order = np.argsort(b, kind="stable")
                cuts = np.searchsorted(b[order], np.arange(n_buckets + 1))
                rows += [(i, s, h[o].tobytes(), c[o].tobytes(), e[o].tobytes()) for i in range(n_buckets) if len(o := order[cuts[i] : cuts[i + 1]])]
            yield record(rows, ["bucket", "slice", "hashes", "counts", "endings"], [pa.int32(), pa.int64(), *[pa.binary()] * 3])

    def total(key: tuple, table: pa.Table) -> pa.Table:
        h = numbers(b"".join(table.column("hashes").to_pylist()), np.uint64)
        c = numbers(b"".join(table.column("counts").to_pylist()), np.int32)
        e = numbers(b"".join(table.column("endings").to_pylist()), np.uint16)
        uniq, first, which = np.unique(h, return_index=True, return_inverse=True)
        sums = np.bincount(which, weights=c, minlength=len(uniq)).astype(np.int64)
        rows, at = [], 0
        for s, blob in zip(table.column("slice").to_pylist(), table.column("hashes").to_pylist(), strict=True):
            n = len(blob) // 8
            rows.append((s, key[0].as_py(), squeezed(sums[which[at : at + n]].tobytes()), None, None, None))
            at += n
        often, known = sums >= least, sums > 0
        rare = known & ~often
        ending = e[first]
        stats = np.stack([np.bincount(ending[rare], weights=sums[rare], minlength=ENDINGS), np.bincount(ending[rare], minlength=ENDINGS)]).astype(np.int64)
        rows.append((None, key[0].as_py(), stats.tobytes(), uniq[often].tobytes(), sums[often].tobytes(), int((sums == 1).sum())))
        return pa.Table.from_batches([record(rows, ["slice", "bucket", "totals", "often", "often_counts", "once"], [pa.int64(), pa.int32(), *[pa.binary()] * 3, pa.int64()])])

    dealt = held.select("slice", "hashes", "counts", "endings").mapInArrow(deal, "bucket int, slice bigint, hashes binary, counts binary, endings binary")
    return dealt.groupBy("bucket").applyInArrow(total, "slice bigint, bucket int, totals binary, often binary, often_counts binary, once bigint")


class Classes:
    """Word classes: 0 unseen, 1 end, then endings, then frequent words; with their unigram shares."""

    def __init__(self, n: int, n_ends: int, stats: np.ndarray, often: np.ndarray, counts: np.ndarray, once: int):
        order = np.argsort(often)
        self.often, counts = often[order], counts[order]
        self.n, self.v = n, int(stats[1].sum()) + len(often) + (n_ends > 0)
        self.n_ends, self.once = n_ends, once
        self.whole = float(n + self.v + 1)
        self.share = np.concatenate([[1.0, n_ends + 1.0], stats[0] + stats[1], counts + 1.0]) / self.whole
        self.size = len(self.share)

    def of(self, hashes: np.ndarray, totals: np.ndarray, endings: np.ndarray) -> np.ndarray:
        out = endings.astype(np.int64) + 2
        if len(self.often):
            place = np.minimum(np.searchsorted(self.often, hashes), len(self.often) - 1)
            own = self.often[place] == hashes
            out[own] = 2 + ENDINGS + place[own]
        out[totals == 0] = 0
        return out


SEQUENCES = "ids binary, nulls binary, held binary, sizes binary, known binary, base binary, classes binary, n_classes bigint"


def class_sequences(held: DataFrame, totals: DataFrame, shared: object, n_buckets: int) -> DataFrame:
    """By slice the class sequence and the base score of every text."""

    def run(key: tuple, tokens: pa.Table, totals: pa.Table) -> pa.Table:
        cl: Classes = shared.value
        rows = []
        by_bucket = dict(zip(totals.column("bucket").to_pylist(), totals.column("totals").to_pylist(), strict=True))
        for r in tokens.to_pylist():
            h = numbers(r["hashes"], np.uint64)
            b = (h % U64(n_buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            count = np.bincount(b, minlength=n_buckets)
            sums = np.empty(len(h), np.int64)
            at = 0
            for i in np.flatnonzero(count).tolist():
                n = int(count[i])
                sums[order[at : at + n]] = numbers(unsqueezed(by_bucket[i], 8 * n), np.int64)
                at += n
            sizes, held = numbers(r["sizes"], np.int32), numbers(r["held"], bool)
            token = numbers(unsqueezed(r["tokens"], 4 * r["n_tokens"]), np.int32)
            own = np.repeat(np.arange(len(sizes)), sizes)
            logs = np.log10((sums + 1.0) / cl.whole)
            base = np.bincount(own, weights=logs[token], minlength=len(sizes)) + np.log10((cl.n_ends + 1.0) / cl.whole)
            known = np.bincount(own, weights=sums[token] > 0, minlength=len(sizes)).astype(np.int64) + (cl.n_ends > 0)
            seq = np.ones(len(token) + len(sizes), np.uint16)
            inside = np.ones(len(seq), bool)
            inside[np.cumsum(sizes + 1) - 1] = False
            seq[inside] = cl.of(h, sums, numbers(r["endings"], np.uint16))[token]
            if cl.n_ends == 0:
                seq[~inside] = 0
            rows.append((r["ids"], r["nulls"], held.tobytes(), (sizes + 1).astype(np.int32).tobytes(), known.tobytes(), base.tobytes(), squeezed(seq.tobytes()), len(seq)))
        names = [c.split()[0] for c in SEQUENCES.split(", ")]
        return pa.Table.from_batches([record(rows, names, [*[pa.binary()] * 7, pa.int64()])])

    by_slice = totals.filter("slice IS NOT NULL").select("slice", "bucket", "totals")
    tokens = held.select("slice", "ids", "nulls", "held", "sizes", "tokens", "n_tokens", "hashes", "endings")
    return tokens.groupBy("slice").cogroup(by_slice.groupBy("slice")).applyInArrow(run, SEQUENCES)


class Model:
    """Start, transition and emission probabilities; ``ratio`` is emission over unigram share."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, emit: np.ndarray, cl: Classes, prior: float = 200.0):
        unseen = min(0.5, max(cl.once, 1) / max(cl.n, 1))
        share = cl.share.copy()
        share[0] = 0
        share /= max(share.sum(), 1e-300)
        emit = emit.copy()
        emit[:, 0] = 0
        emit = (emit + prior * share) / (emit.sum(1, keepdims=True) + prior) * (1 - unseen)
        emit[:, 0] = unseen
        self.start = (start + 1) / (start + 1).sum()
        self.moves = (moves + 1) / (moves + 1).sum(1, keepdims=True)
        self.steady = self.start
        for _ in range(64):
            self.steady = self.steady @ self.moves
        self.ratio = np.ascontiguousarray((emit / np.where(cl.share > 0, cl.share, 1)).T)


def segments_of(sizes: np.ndarray, held: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of the training sequences of a slice, and whether each begins a text."""
    begin = np.cumsum(sizes) - sizes
    begin, size = begin[~held].astype(np.int64), sizes[~held].astype(np.int64)
    n = -(-size // longest)
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(begin, n) + step * longest
    return start, np.minimum(np.repeat(begin + size, n) - start, longest), step == 0


def expected(model: Model, seq: np.ndarray, starts: np.ndarray, lengths: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts of starts, moves and emissions over the sequences; ``fresh`` ones begin a text."""
    k, size = len(model.start), model.ratio.shape[0]
    order = np.argsort(-lengths, kind="stable")
    starts, lengths, fresh = starts[order], lengths[order], fresh[order]
    begin = np.where(fresh[:, None], model.start, model.steady).astype(np.float32)
    moves, first, emit = np.zeros((k, k)), np.zeros(k), np.zeros((k, size))
    steps = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(steps), "left")
    alphas, scales, reach = [], [], []
    ratio, a = model.ratio.astype(np.float32), model.moves.astype(np.float32)
    for t in range(steps):
        n = int(alive[t])
        r = ratio[seq[starts[:n] + t]]
        x = (alphas[-1][:n] @ a if t else begin) * r
        s = x.sum(1, keepdims=True)
        alphas.append(x / s)
        scales.append(s)
        reach.append(r)
    gammas = []
    beta = np.ones((int(alive[-1]), k), np.float32) if steps else None
    for t in range(steps - 1, -1, -1):
        n = int(alive[t])
        if len(beta) < n:
            beta = np.concatenate([beta, np.ones((n - len(beta), k), np.float32)])
        gammas.append(alphas[t] * beta)
        if t:
            back = reach[t] * beta / scales[t]
            moves += alphas[t - 1][:n].T @ back
            beta = back @ a.T
    if steps:
        first += gammas[-1][fresh].sum(0)
        cls = np.concatenate([seq[starts[: int(alive[t])] + t] for t in range(steps - 1, -1, -1)])
        gamma = np.concatenate(gammas)
        for i in range(k):
            emit[i] = np.bincount(cls, weights=gamma[:, i], minlength=size)
    return first, moves * model.moves, emit


def neighbours(seqs: DataFrame, cl: Classes, n: int = NEAR, blocks: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The n most frequent classes, and for each class how often each of them follows it and then how often each stands before it, in all training texts."""
    size = cl.size
    often = np.argsort(-cl.share[1:], kind="stable")[:n] + 1
    place = np.full(size, -1)
    place[often] = np.arange(len(often))
    width, step = 2 * len(often), -(-size // blocks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * width, np.int64)
        for batch in batches:
            for _, seq, sizes, held in unpacked(batch):
                text = np.repeat(np.arange(len(sizes)), sizes)
                pair = np.flatnonzero((text[1:] == text[:-1]) & ~held[text[1:]])
                left, right = seq[pair].astype(np.int64), seq[pair + 1].astype(np.int64)
                behind, before = place[right] >= 0, place[left] >= 0
                key = np.concatenate([left[behind] * width + place[right[behind]], right[before] * width + len(often) + place[left[before]]])
                each, times = np.unique(key, return_counts=True)
                total[each] += times
        rows = [(i, total[i * step * width : (i + 1) * step * width].tobytes()) for i in range(blocks)]
        yield record(rows, ["block", "counts"], [pa.int32(), pa.binary()])

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in parts:
            for blob in part.column("counts").to_pylist():
                x = np.frombuffer(blob, np.int64)
                total = x if total is None else total + x
        yield record([(key[0].as_py(), total.tobytes())], ["block", "counts"], [pa.int32(), pa.binary()])

    found = seqs.mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary").collect()
    by = {r["block"]: np.frombuffer(r["counts"], np.int64) for r in found}
    flat = np.concatenate([by[i] for i in range(blocks)]) if by else np.zeros(size * width, np.int64)
    return often, flat.reshape(size, width)


def start_model(cl: Classes, often: np.ndarray, near: np.ndarray, states: int, rounds: int = 20) -> Model:
    """Each state begins with a group of classes that have like neighbours, and moves as the groups follow each other.

    Groups are k-means of the classes' neighbours, each class as heavy as it is frequent.  Without a pair of tokens
    (no training text of a word or more) all states are the unigram's.
    """
    k, size = states, cl.size
    weight = near.sum(1).astype(float)
    if not weight.any():
        return Model(np.ones(k), np.ones((k, k)), np.tile(cl.share * 100, (k, 1)), cl)
    root = np.sqrt(near / np.maximum(weight, 1)[:, None])
    centre = root[[int(np.argmax(weight))]]
    while len(centre) < k:
        far = weight * np.maximum(1 - (root @ centre.T).max(1), 0)
        centre = np.concatenate([centre, root[[int(np.argmax(far))]]])
    for _ in range(rounds):
        group = np.argmax(root @ centre.T, 1)
        sums = np.stack([(weight[group == i, None] * root[group == i]).sum(0) for i in range(k)])
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        centre = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centre)
    group = np.argmax(root @ centre.T, 1)
    own = np.full((k, size), 0.1 / k)
    own[group, np.arange(size)] += 0.9
    own[:, 1] = 1 / k
    follows = np.zeros((k, k))
    np.add.at(follows, (np.repeat(group, len(often)), np.tile(group[often], size)), near[:, : len(often)].ravel())
    return Model(np.ones(k), follows + follows.sum() * 0.1 / k**2, own * cl.share * cl.whole, cl)


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple]:
    for r in batch.to_pylist():
        yield r, numbers(unsqueezed(r["classes"], 2 * r["n_classes"]), np.uint16), numbers(r["sizes"], np.int32), numbers(r["held"], bool)


def iteration(seqs: DataFrame, model: Model, cl: Classes, blocks: int = 16) -> Model:
    """One Baum-Welch step over all training texts; partial counts are added up block by block of classes."""
    spark, k, size = seqs.sparkSession, len(model.start), cl.size
    shared = spark.sparkContext.broadcast(model)
    width = -(-size // blocks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, moves, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, size))
        for batch in batches:
            for _, seq, sizes, held in unpacked(batch):
                starts, lengths, fresh = segments_of(sizes, held, SEGMENT)
                ends = np.cumsum(lengths)
                cuts = np.searchsorted(ends, np.arange(0, max(1, int(ends[-1]) if len(ends) else 0), 150_000))
                for a, b in zip(cuts, [*cuts[1:], len(starts)], strict=True):
                    if b > a:
                        f, m, e = expected(shared.value, seq, starts[a:b], lengths[a:b], fresh[a:b])
                        first, moves, emit = first + f, moves + m, emit + e
        rows = [(-1, np.concatenate([first, moves.ravel()]).tobytes())]
        rows += [(i, np.ascontiguousarray(emit[:, i * width : (i + 1) * width]).tobytes()) for i in range(blocks)]
        yield record(rows, ["block", "counts"], [pa.int32(), pa.binary()])

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in parts:
            for blob in part.column("counts").to_pylist():
                x = np.frombuffer(blob)
                total = x if total is None else total + x
        yield record([(key[0].as_py(), total.tobytes())], ["block", "counts"], [pa.int32(), pa.binary()])

    found = seqs.mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary").collect()
    by = {r["block"]: np.frombuffer(r["counts"]) for r in found}
    shared.unpersist()
    if -1 not in by:
        return model
    emit = np.concatenate([by[i].reshape(k, -1) for i in range(blocks) if len(by[i])], 1)
    return Model(by[-1][:k], by[-1][k:].reshape(k, k), emit, cl)


def log_ratio(model: Model, seq: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 likelihood ratio of every sequence by the scaled forward recursion."""
    out = np.zeros(len(sizes))
    begin = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    starts, lengths = begin[order].astype(np.int64), sizes[order]
    total = np.zeros(len(order))
    alive = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), "left")
    alpha = None
    for t, n in enumerate(alive.tolist()):
        x = (model.start if alpha is None else alpha[:n] @ model.moves) * model.ratio[seq[starts[:n] + t]]
        s = x.sum(1)
        alpha = x / s[:, None]
        total[:n] += np.log10(s)
    out[order] = total
    return out


def scores(docs: DataFrame, states: int = STATES, iterations: int = ITERATIONS) -> DataFrame:
    """Counts, base score and model score of every row."""
    spark = docs.sparkSession
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long"), (F.pmod(crc, F.lit(7)) == 2).alias("held"), "text")
    held = written(token_slices(rows), "tokens")
    n_buckets = parts(held, 8)
    n = held.agg(F.sum("n_train")).first()[0] or 0
    least = max(2, int(np.ceil(n * FREQUENT)))
    totals = written(word_totals(held, n_buckets, least), "totals")
    stats = totals.filter("slice IS NULL")
    often = stats.select("often", "often_counts").collect()
    once = stats.agg(F.sum("once")).first()[0] or 0

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * ENDINGS, np.int64)
        for part in parts:
            for blob in part.column("totals").to_pylist():
                total += numbers(blob, np.int64)
        yield record([(total.tobytes(),)], ["totals"], [pa.binary()])

    dealt = stats.select(F.pmod("bucket", F.lit(64)).alias("part"), "totals")
    summed = dealt.groupBy("part").applyInArrow(add, "totals binary").collect()
    endings = sum((numbers(r["totals"], np.int64) for r in summed), np.zeros(2 * ENDINGS, np.int64)).reshape(2, -1)
    n_words = int(endings[0].sum()) + int(sum(numbers(r["often_counts"], np.int64).sum() for r in often))
    cl = Classes(
        n, n - n_words, endings, numbers(b"".join(r["often"] for r in often), np.uint64), numbers(b"".join(r["often_counts"] for r in often), np.int64), once
    )
    seqs = written(class_sequences(held, totals, spark.sparkContext.broadcast(cl), n_buckets), "sequences")
    model = start_model(cl, *neighbours(seqs, cl), states)
    for _ in range(iterations):
        model = iteration(seqs, model, cl)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, seq, sizes, out in unpacked(batch):
                ids = pa.array(numbers(r["ids"], np.int64), mask=numbers(r["nulls"], bool))
                base = numbers(r["base"], np.float64)
                columns = [ids, out, sizes.astype(np.int64), numbers(r["known"], np.int64), np.full(len(sizes), n), base, base + log_ratio(shared.value, seq, sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return seqs.mapInArrow(score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op7_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
