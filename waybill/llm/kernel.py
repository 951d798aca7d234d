"""Vectorised text kernels on Arrow buffers, shared by the operators of this subpackage.

Every function here works on one flat byte buffer and the offsets of the texts in it, so that no
Python object is made for each word.  ``span_hash`` scrambles every eight bytes together with their
place before it adds them up, so no algebra ties the hashes of different strings; equality that must
be exact is settled on the bytes by ``exact_ids``.  ``prefix`` and ``rough_hash`` are polynomial
hashes at constant cost a span: they only order grams and preselect, and decide nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)

#: Maps A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: The separators of ``[^\x20\x09-\x0D]+``.
DELIM = np.zeros(256, bool)
DELIM[[0x20, 9, 10, 11, 12, 13]] = True

_pow = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_pow["p"]) < n:
        m = max(n, SLICE_BYTES + 1)
        for key, base in (("p", _BASE), ("q", _BASE_INV)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _pow[key] = np.cumprod(x, dtype=np.uint64)
    return _pow["p"][:n], _pow["q"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    else:
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; a longer text is a range of its own."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def cut(buf: np.ndarray, offs: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    return buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]


def word_spans(buf: np.ndarray, offs: np.ndarray, delim: np.ndarray = DELIM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every word; words never cross texts."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~delim[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = offs[:-1]
    before[first[first < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offs[1:]
    after[last[last > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, owner(offs, starts)


def owner(offs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text that each byte position of ``at`` lies in."""
    return np.searchsorted(offs, at, "right") - 1


def prefix(buf: np.ndarray) -> np.ndarray:
    p = np.zeros(len(buf) + 1, np.uint64)
    if len(buf):
        np.cumsum(_TABLE[buf] * powers(len(buf))[0], out=p[1:])
    return p


def rough_hash(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the byte spans, given ``prefix`` of their buffer; some strings collide by their structure."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    q = powers(len(pre))[1]
    return mix((pre[ends] - pre[starts]) * q[starts] + (ends - starts).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def _eights(view: np.ndarray, at: np.ndarray, place: np.ndarray | int, left: np.ndarray, seed: int) -> np.ndarray:
    """Scrambled values of eight bytes each; ``left`` bytes of the span remain from there."""
    value = view[at] & ((~U64(0)) >> (U64(8) * np.clip(8 - left, 0, 7).astype(np.uint64)))
    key = mix(np.asarray(place, np.uint64).reshape(-1) * U64(0x9E3779B97F4A7C15) + U64(seed + 1))
    return mix(value + key)


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the bytes of the spans; another seed gives an independent hash."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    view = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    out = np.where(size > 0, _eights(view, starts, 0, size, seed), U64(0))
    more = np.flatnonzero(size > 8)
    for low in range(0, len(more), 1 << 16):
        some = more[low : low + (1 << 16)]
        n = (size[some] - 1) >> 3
        first = np.cumsum(n) - n
        place = np.arange(1, int(n.sum()) + 1) - np.repeat(first, n)
        at = np.repeat(starts[some], n) + 8 * place
        out[some] += np.add.reduceat(_eights(view, at, place, np.repeat(ends[some], n) - at, seed), first)
    return mix(out + size.astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def exact_ids(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the spans, equal where the bytes are equal and only there, and the first span of every number."""
    h = span_hash(buf, starts, ends) if hashes is None else hashes
    _, first, ids = np.unique(h, return_index=True, return_inverse=True)
    size, head = ends - starts, first[ids]
    again = np.flatnonzero(head != np.arange(len(h)))
    same = size[again] == size[head[again]]
    if same.all():
        for low in range(0, len(again), 1 << 18):
            some = again[low : low + (1 << 18)]
            if not np.array_equal(gather(buf, starts[some], size[some]), gather(buf, starts[head[some]], size[some])):
                break
        else:
            return ids, first
    raw, known, first = buf.tobytes(), {}, []
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        if (ids_of := known.setdefault(raw[a:b], len(known))) == len(first):
            first.append(i)
        ids[i] = ids_of
    return ids, np.array(first)


def joined_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in their order."""
    return mix(a * U64(0xC2B2AE3D27D4EB4F) + b)


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive hashes, by doubling; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, span = None, 0, 1
    while True:
        if k & span:
            out = h[done : done + n] if out is None else joined_hash(out, h[done : done + n])
            done += span
        if 2 * span > k:
            return out
        h, span = joined_hash(h[:-span], h[span:]), 2 * span


def window_rows(owners: np.ndarray, k: int) -> np.ndarray:
    """Whether each k consecutive words lie in one text."""
    n = len(owners) - k + 1
    return owners[:n] == owners[k - 1 :] if n > 0 else np.zeros(0, bool)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    span, y = 1, x
    while span * 2 <= w:
        y = np.minimum(y[:-span], y[span:])
        span *= 2
    rest = w - span
    return np.minimum(y[: len(y) - rest], y[rest:]) if rest else y


def gather(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of many spans, one after another."""
    total = int(lengths.sum())
    if total == 0:
        return buf[:0]
    ends = np.cumsum(lengths)
    at = np.arange(total, dtype=np.int64)
    at += np.repeat(starts - (ends - lengths), lengths)
    return buf[at]


def per_text(values: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owners, weights=values, minlength=n).astype(np.int64)


def joined_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of every text, each followed by one space: bytes, starts, ends, owners of the words."""
    starts, ends, own = word_spans(buf, offs)
    lengths = ends - starts
    out_end = np.cumsum(lengths + 1) - 1
    out = np.full(int(out_end[-1]) + 1 if len(out_end) else 0, 0x20, np.uint8)
    inside = np.ones(len(out), bool)
    inside[out_end] = False
    out[inside] = buf[~DELIM[buf]]
    return out, out_end - lengths, out_end, own
