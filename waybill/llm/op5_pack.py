"""Packing tokenised documents into fixed windows by best-fit decreasing.

A document's ids (byte-level BPE, then the end id) are cut into full windows from its start; the
remainder, shorter than a window, is placed by best-fit decreasing: longest first, each into the
open window whose remaining capacity is the tightest that holds it, found by a segment tree indexed
by remaining capacity.  Remainders are dealt by hash into groups of about ``group`` and each group is
packed on its own, so padding per group is at most that of one or a few unfilled windows.

Tokenisation is vectorised: the pre-token boundaries of a whole batch are found on code points, each
distinct pre-token (told apart by its bytes) is encoded once, and ids are gathered by pre-token.

Null text is an empty document (one end id); repeated rows are packed each; an empty table gives
no rows; extra columns are not carried.
"""

from __future__ import annotations

import base64
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import buffer_of, cut, exact_ids, slices
from .store import row_key, spread, written

WINDOW = 2048
END_ID = 1
SPECIAL = "<|endoftext|>"
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


def char_classes() -> np.ndarray:
    """Class of every code point under the pre-tokeniser's ``\\p{L}``, ``\\p{N}`` and ``\\s``."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LN":
            out[cp] = LETTER if kind == "L" else NUMBER
        elif kind == "Z":
            out[cp] = SPACE
    out[[9, 10, 11, 12, 13, 0x85]] = SPACE
    return out


class Encoder:
    """Ids of whole batches; equal to encoding each text on its own."""

    def __init__(self, ranks_path: str, json_path: str, keep: int = 1 << 20):
        import tiktoken

        lines = [line.split() for line in open(ranks_path, "rb")]
        ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.core = tiktoken.Encoding("bpe", pat_str=r"\s+|\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.json_path, self.keep, self.whole = json_path, keep, None
        self.classes = char_classes()
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def cuts(self, cp: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Positions at which a pre-token starts; offs: where the texts start, in code points."""
        n = len(cp)
        kind = self.classes[cp]
        new = np.empty(n, bool)
        new[0] = True
        new[1:] = kind[1:] != kind[:-1]
        doc = np.zeros(n + 1, bool)
        doc[offs] = True
        new |= doc[:n]
        runs = np.flatnonzero(new)
        ends = np.append(runs[1:], n)
        space = kind[runs] == SPACE
        # a run of white space before more text gives up its last character
        inner = space & ~doc[ends]
        last = ends[inner] - 1
        starts = np.zeros(n + 1, bool)
        starts[runs] = True
        starts[last] = True
        joins = cp[last] == 0x20
        starts[ends[inner][joins]] = False
        # contractions: a lone apostrophe that no blank is attached to, before s, t, m, d, re, ve, ll
        lone = runs[(cp[runs] == 0x27) & (ends - runs == 1)]
        lone = lone[starts[lone]]
        lone = lone[(lone + 1 < n)]
        lone = lone[~doc[lone + 1]]
        a = cp[lone + 1]
        b = np.where(lone + 2 < n, cp[np.minimum(lone + 2, n - 1)], 0)
        b = np.where(doc[np.minimum(lone + 2, n)], 0, b)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for where, m in ((lone[one], 1), (lone[two & ~one], 2)):
            starts[where + 1] = False
            rest = where + 1 + m
            rest = rest[rest < n]
            starts[rest] = True
        return np.flatnonzero(starts[:n])

    def learn(self, words: list[bytes]) -> None:
        encode = self.core.encode_single_piece
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        ids = [encode(w) for w in words]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, raw: bytes, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the offset of each text in them."""
        n_texts = len(offs) - 1
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(n_texts + 1, np.int64)
        data = np.frombuffer(raw, np.uint8)
        lead = (data & 0xC0) != 0x80
        ascii_only = bool(lead.all())
        cp = data.astype(np.uint32) if ascii_only else np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        count = None if ascii_only else np.append(0, np.cumsum(lead))
        where = offs if ascii_only else count[offs]
        starts = self.cuts(cp, where)
        ends = np.append(starts[1:], len(cp))
        byte_at = np.arange(len(cp) + 1) if ascii_only else np.append(np.flatnonzero(lead), len(data))
        begin, stop = byte_at[starts], byte_at[ends]
        inverse, first = exact_ids(data, begin, stop)
        words = [raw[i:j] for i, j in zip(begin[first].tolist(), stop[first].tolist(), strict=True)]
        if len(self.known) + len(words) > self.keep:
            self.clear()
        self.learn([w for w in words if w not in self.known])
        place = np.fromiter((self.known[w] for w in words), np.int64, len(words))
        at, size = self.at[place][inverse], self.size[place][inverse]
        done = np.cumsum(size)
        flat_at = np.arange(int(done[-1]), dtype=np.int64)
        flat_at += np.repeat(at - (done - size), size)
        ids = self.flat[flat_at]
        ahead = np.append(0, done)
        out = ahead[np.searchsorted(starts, where, "left")]
        return ids, out

    def special(self, text: str) -> np.ndarray:
        """Ids of a text that holds the string of the special token."""
        from tokenizers import Tokenizer

        self.whole = self.whole or Tokenizer.from_file(self.json_path)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(2)
def encoder(name: str = "byte_bpe_50k") -> Encoder:
    import public_tokenizers

    return Encoder(public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.path(f"{name}.json"))


def documents_ids(enc: Encoder, column: pa.Array) -> Iterator[np.ndarray]:
    """The ids of every text, with the end id."""
    buf, offs = buffer_of(column)
    end = np.array([END_ID], np.uint32)
    mark = SPECIAL.encode()
    for a, b in slices(offs, 2 << 20):
        data, at = cut(buf, offs, a, b)
        raw = data.tobytes()
        ids, where = enc.encode(raw, at)
        rare = mark in raw
        for i in range(b - a):
            own = ids[where[i] : where[i + 1]]
            if rare and mark in (text := raw[at[i] : at[i + 1]]):
                own = enc.special(text.decode("utf-8"))
            yield np.concatenate([own, end])


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, key bigint"


def pieces(docs: DataFrame, window: int = WINDOW, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """Every document cut into full windows and a remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "key"]
        for batch in batches:
            rows: list[tuple] = []
            ids_of = batch.column(0).to_pylist()
            keys = batch.column(2).to_pylist()
            for doc_id, key, ids in zip(ids_of, keys, documents_ids(enc, batch.column(1)), strict=True):
                for s in range(0, len(ids), window):
                    part = ids[s : s + window]
                    rows.append((doc_id, s, len(part), zlib.crc32(part.astype("<u4").tobytes()), len(ids), key))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text"), row_key().alias("key"))
    return spread(docs).mapInArrow(run, PIECES)


class CapacityTree:
    """Open windows by remaining capacity; finds the smallest capacity that is large enough."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, bin_id: int) -> None:
        self.open[capacity].append(bin_id)
        i = self.leaves + capacity
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes the tightest window with capacity of at least need."""
        i = self.leaves + need
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        while i:
            self.count[i] -= 1
            i >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of every piece."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, n = CapacityTree(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need)
        if found is None:
            found, n = (window, n), n + 1
        capacity, b = found
        bins[i], offsets[i] = b, window - capacity
        if capacity > need:
            tree.add(capacity - need, b)
    return bins, offsets


def pack(docs: DataFrame, window: int = WINDOW, group: int = 20_000, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    held = written(pieces(docs, window, tokenizer), "pieces")
    n_groups = max(1, -(-held.count() // group))
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

    def place(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "key", "start")])
        bins, offsets = best_fit_decreasing(table.column("length").to_numpy(), window)
        table = table.drop_columns(["key", "_group"])
        table = table.append_column("sequence_id", pa.array(bins * n_groups + key[0].as_py()))
        return table.append_column("offset", pa.array(offsets))

    dealt = held.withColumn("_group", F.pmod(F.xxhash64("key", "start", "doc_id"), F.lit(n_groups)).cast("int"))
    return dealt.groupBy("_group").applyInArrow(place, schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
