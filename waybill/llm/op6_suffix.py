"""Suffix-array dedup of byte strings, built column by column for many strings at once.

Byte windows (200) are dealt to buckets by minimiser (see ``repeats``); in a bucket the strings that
share a minimiser form collections.  A collection's Burrows-Wheeler transform and longest common
prefixes grow by one symbol of every string each round: the suffixes that are one longer are ranked
by the last-to-first mapping of the transform so far, and both columns are rewritten in one
sequential pass (in files, a task's own scratch, once they exceed ``in_memory`` bytes).  A suffix whose common prefix with a
neighbour reaches the window length starts a repeated window.

Null or empty text has no bytes; texts shorter than a window lose nothing; rows equal in id and text
count as each other's copies; an empty table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .kernel import U64, gather, mix, powers, prefix, rough_hash
from .repeats import HOT, Units, covered, flagged_runs, without_repeats

WINDOW, GRAM = 200, 32
#: Bytes of a collection (more if one minimiser's strings need them), and above which its columns go to files.
COLLECTION, IN_MEMORY = 96 << 10, 1 << 20


class Column:
    """A column that is only read and rewritten from front to back; in a file if it is large."""

    def __init__(self, folder: tempfile.TemporaryDirectory | None, name: str):
        self.folder, self.name, self.turn, self.data = folder, name, 0, np.zeros(0, np.uint8)

    def rewrite(self, n: int) -> np.ndarray:
        """The column's next version, to be filled."""
        if self.folder is None:
            return np.empty(n, np.uint8)
        self.turn ^= 1
        return np.memmap(f"{self.folder.name}/{self.name}{self.turn}", np.uint8, "w+", shape=(n,))


def merged(column: Column, at: np.ndarray, values: np.ndarray, kept: np.ndarray) -> None:
    """Puts values at the places ``at`` of the new column, and the old values at the others."""
    new = column.rewrite(len(kept))
    new[kept] = column.data
    new[at] = values
    column.data = new


def range_min(lcp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Minimum of lcp[begin:end] for many ranges, none empty."""
    if not len(begin):
        return np.zeros(0, np.uint8)
    order = np.argsort(begin)
    bounds = np.empty(2 * len(begin), np.int64)
    bounds[0::2], bounds[1::2] = begin[order], end[order]
    out = np.empty(len(begin), np.uint8)
    out[order] = np.minimum.reduceat(lcp, bounds)[::2]
    return out


def repeated_starts(buf: np.ndarray, offs: np.ndarray, window: int, in_memory: int = IN_MEMORY) -> np.ndarray:
    """For every byte position of a collection, whether a string of ``window`` (below 255) bytes from there occurs twice."""
    n, size = len(offs) - 1, np.diff(offs)
    flags = np.zeros(len(buf), bool)
    if n == 0 or not len(buf):
        return flags
    present = np.zeros(256, bool)
    present[buf] = True
    code = np.cumsum(present).astype(np.uint8)  # 0 ends a string; UTF-8 uses fewer than 255 byte values
    text = code[buf]
    with tempfile.TemporaryDirectory() if len(buf) > in_memory else _nothing() as name:
        folder = _Folder(name) if name else None
        bwt, lcp = Column(folder, "bwt"), Column(folder, "lcp")
        filled = size > 0
        bwt.data = np.where(filled, text[np.maximum(offs[1:] - 1, 0)], 0).astype(np.uint8)
        lcp.data = np.zeros(n, np.uint8)
        pos = np.arange(n)
        owner_at = np.empty(len(buf) + n + 1, np.int32)
        for j in range(1, int(size.max()) + 1):
            active = np.flatnonzero(size >= j)
            b = np.asarray(bwt.data)
            order = np.argsort(b, kind="stable")
            sorted_b = b[order]
            n_ends = int(np.searchsorted(sorted_b, 1))
            own = pos[active]
            owner_at[own] = active
            is_new = np.zeros(len(b), bool)
            is_new[own] = True
            q = np.flatnonzero(is_new[order])
            p = order[q]
            strings = owner_at[p]
            symbol = sorted_b[q]
            at = n + q - n_ends
            before = (q > n_ends) & (sorted_b[q - 1] == symbol)
            nxt = np.minimum(q + 1, len(b) - 1)
            after = (q + 1 < len(b)) & (sorted_b[nxt] == symbol)
            after[after] = ~is_new[order[nxt[after]]]
            padded = np.append(lcp.data, np.uint8(255))
            begin = np.concatenate([order[q[before] - 1] + 1, p[after] + 1])
            end = np.concatenate([p[before] + 1, order[q[after] + 1] + 1])
            common = np.minimum(range_min(padded, begin, end), window - 1) + np.uint8(1)
            n_before = int(before.sum())
            new_lcp = np.zeros(len(q), np.uint8)
            new_lcp[before] = common[:n_before]
            ahead = offs[strings] + size[strings] - j - 1
            new_bwt = np.where(size[strings] > j, text[np.maximum(ahead, 0)], 0).astype(np.uint8)
            kept = np.ones(len(b) + len(q), bool)
            kept[at] = False
            merged(bwt, at, new_bwt, kept)
            merged(lcp, at, new_lcp, kept)
            lcp.data[at[after] + 1] = common[n_before:]
            pos[strings] = at
        # from ranks back to positions: the last-to-first mapping walks each string backwards
        b, common = np.asarray(bwt.data), np.append(lcp.data, np.uint8(0))
        hit = (common[:-1] >= window) | (common[1:] >= window)
        order = np.argsort(b, kind="stable")
        n_ends = int((b == 0).sum())
        step = np.empty(len(b), np.int64)
        step[order] = n - n_ends + np.arange(len(b))
        rank = np.arange(n)
        for j in range(1, int(size.max()) + 1):
            active = np.flatnonzero(size >= j)
            rank[active] = step[rank[active]]
            flags[offs[active] + size[active] - j] = hit[rank[active]]
    return flags


class _Folder:
    def __init__(self, name: str):
        self.name = name


class _nothing:
    def __enter__(self) -> None:
        return None

    def __exit__(self, *_: object) -> None:
        return None


def narrowed(buf: np.ndarray, offs: np.ndarray, group: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings that can hold a window of another one, cut to where it can lie: string, begin, end.

    A window holds its minimiser with half of its other bytes on one side at least, so equal windows
    agree on the minimiser and the half before it, or on the minimiser and the half behind it.
    """
    n, half, w = len(offs) - 1, (window - gram) // 2, window - gram + 1
    grams = byte_units(buf, np.array([0, len(buf)]), gram).grams
    begin, end = offs[:-1], offs[1:]
    at = np.empty(n, np.int64)
    for x in range(0, n, 4096):
        rows = begin[x : x + 4096, None] + np.arange(w)
        at[x : x + 4096] = begin[x : x + 4096] + grams[rows].argmin(1)
    least = np.append(grams[at], U64(0))
    own = np.repeat(np.arange(n), end - begin)[: len(grams)]
    same = np.flatnonzero(grams == least[own])
    loops = np.bincount(own[same][same + gram <= end[own[same]]], minlength=n) > 1
    pre = prefix(buf)

    def again(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        inside = np.flatnonzero((a >= begin) & (b <= end))
        keys = mix(rough_hash(pre, a[inside], b[inside]) + group[inside].astype(np.uint64) * U64(0x9E3779B97F4A7C15))
        _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
        out = np.zeros(n, bool)
        out[inside] = count[which] > 1
        return out

    before, behind = again(at - half, at + gram), again(at, at + gram + half)
    keep = np.flatnonzero(loops | before | behind)
    low = np.where(loops | before, begin, np.maximum(begin, at - (window - gram - half)))[keep]
    high = np.where(loops | behind, end, np.minimum(end, at + window - half))[keep]
    long = high - low >= window
    return keep[long], low[long], high[long]


def by_suffixes(window: int, gram: int, collection: int = COLLECTION, in_memory: int = IN_MEMORY):
    """Resolver: one collection for the strings of some minimisers after another."""

    def resolve(buf: np.ndarray, offs: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        string, low, high = narrowed(buf, offs, group, window, gram)
        group, shift, size = group[string], low - offs[string], high - low
        buf, offs = gather(buf, low, size), np.append(0, np.cumsum(size))
        flags = np.zeros(len(buf), bool)
        heads = np.append(np.flatnonzero(np.append(True, np.diff(group) != 0)), len(group)) if len(group) else np.zeros(1, int)
        a = 0
        while a < len(heads) - 1:
            b = max(a + 1, int(np.searchsorted(offs[heads], offs[heads[a]] + collection, "right")) - 1)
            x, y = heads[a], heads[b]
            flags[offs[x] : offs[y]] = repeated_starts(buf[offs[x] : offs[y]], offs[x : y + 1] - offs[x], window, in_memory)
            a = b
        own, a, b = flagged_runs(flags, np.repeat(np.arange(len(offs) - 1), size), offs[:-1], window)
        return string[own], a + shift[own], b + shift[own]

    return resolve


def byte_units(buf: np.ndarray, offs: np.ndarray, gram: int = GRAM) -> Units:
    pre, n = prefix(buf), len(buf)
    at = np.arange(n)
    grams = mix((pre[gram:] - pre[: max(n + 1 - gram, 0)]) * powers(n + 1)[1][: max(n + 1 - gram, 0)]) if n >= gram else np.zeros(0, np.uint64)
    owners = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
    return Units(buf, at, at + 1, owners, grams)


def count_bytes(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.diff(offs)


NAMES = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def remover(with_bytes: bool):
    def remove(buf: np.ndarray, offs: np.ndarray, text: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[pa.Array]:
        gone = covered(len(buf), offs[:-1], text, a, b)
        total = np.append(0, np.cumsum(gone))
        n_removed = total[offs[1:]] - total[offs[:-1]]
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        first = offs[:-1][np.diff(offs) > 0]
        begins[first] = gone[first]
        total = np.append(0, np.cumsum(begins))
        raw = buf[~gone].tobytes()
        at = (offs - np.append(0, np.cumsum(n_removed))).tolist()
        kept = [raw[x:y] for x, y in zip(at, at[1:], strict=False)]
        columns = [pa.array(np.diff(offs)), pa.array(n_removed), pa.array(total[offs[1:]] - total[offs[:-1]])]
        columns.append(pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string()))
        return columns + ([pa.array(kept, pa.binary())] if with_bytes else [])

    return remove


def dedup_suffixes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_bytes: bool = False, hot: int = HOT, in_memory: int = IN_MEMORY) -> DataFrame:
    """n_bytes, n_removed, n_spans and the hash of the kept bytes (and, if asked, the bytes) for each row."""
    return without_repeats(
        docs, lambda b, o: byte_units(b, o, gram), window, gram, by_suffixes(window, gram, in_memory=in_memory), count_bytes, remover(with_bytes),
        NAMES[: 4 + with_bytes], SCHEMA + ", kept binary" * with_bytes, hot=hot,
    )


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of repeated 200-byte strings."""
    return dedup_suffixes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
