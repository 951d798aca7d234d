"""Exact repeated windows by super-k-mers, shared by the word and the byte operator.

A window is ``k`` consecutive units (words or bytes) of one text.  Its minimiser is the least hash
among its grams of ``m`` units.  A run of consecutive windows with the same minimiser is a
super-k-mer and travels as one packed string to the bucket of its minimiser, so equal windows always
meet in one bucket.

Documents are dealt to blocks by a hash, once; blocks and buckets exchange packed columns:

1. a block sends the distinct minimisers of its texts, a bucket answers which of them occur again;
2. a block sends the distinct strings of those minimisers, each once however often it occurs, and a
   bucket answers with the unit ranges that repeated windows cover in them;
3. the block applies the ranges to every place where the string stands.

So a string that a third of all texts share reaches its bucket once for each block.  A minimiser with
more than ``HOT`` distinct strings (such as one at the edge of a passage that very many texts hold)
would still overload one bucket: its windows are dealt one by one by their own 128-bit hashes
instead, and counted there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U64, buffer_of, cut, gather, joined_hash, mix, prefix, rough_hash, sliding_min, slices, span_hash, window_rows
from .store import parts, row_key

HOT = 20_000
MINIS = "bucket int, _block int, minis binary, again binary, strings binary"
AGAIN = "_block int, minis binary, hot binary"
SEGMENTS = "bucket int, _block int, minis binary, hashes binary, sizes binary, counts binary, loops binary, n_bytes bigint, text binary"
RANGES = "_block int, hashes binary, starts binary, ends binary, strong binary"


def squeezed(raw: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unsqueezed(blob: bytes, n: int) -> bytes:
    return pa.Codec("zstd").decompress(blob, n, asbytes=True)


@dataclass(frozen=True)
class Units:
    """The units of a slice: bytes in which they lie, bounds, owning text, and hashes of the grams."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    owners: np.ndarray
    grams: np.ndarray


def runs(mins: np.ndarray, valid: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of every super-k-mer of at most ``longest`` windows."""
    at = np.flatnonzero(valid)
    if not len(at):
        return at, at, mins[:0]
    v = mins[at]
    new = np.ones(len(at), bool)
    new[1:] = (v[1:] != v[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    inside = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(new | (inside % longest == 0))
    return at[first], np.diff(np.append(first, len(at))), v[first]


def loops(grams: np.ndarray, mins: np.ndarray, first: np.ndarray, size: np.ndarray, w: int) -> np.ndarray:
    """Which super-k-mers may hold their minimiser twice, and so the same window twice."""
    edge = np.zeros(w - 1, np.uint64)
    most = ~sliding_min(~np.concatenate([edge, mins, edge]), w)
    at = np.flatnonzero(grams[: len(most)] == most)
    again = np.append(0, np.cumsum((grams[at[1:]] == grams[at[:-1]]) & (np.diff(at) <= w))) if len(at) else np.zeros(1, np.int64)
    a = np.searchsorted(at, first)
    b = np.searchsorted(at, first + size + w - 1)
    return again[np.maximum(b - 1, a)] > again[np.minimum(a, len(again) - 1)]


Make = Callable[[np.ndarray, np.ndarray], Units]


@dataclass(frozen=True)
class Supers:
    """The super-k-mers of a slice: first unit, number of windows, text, string bounds, minimiser, whether it loops, first unit of each text."""

    units: Units
    first: np.ndarray
    size: np.ndarray
    text: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    mini: np.ndarray
    loops: np.ndarray
    base: np.ndarray

    def hashes(self, which: np.ndarray) -> np.ndarray:
        return span_hash(self.units.data, self.begin[which], self.end[which])


def supers(column: pa.Array, make: Make, k: int, m: int) -> Iterator[tuple[int, Supers]]:
    """The super-k-mers of slices of a text column, with the number of the slice's first text."""
    buf, offs = buffer_of(column)
    w = k - m + 1
    for a, b in slices(offs, 1 << 20):
        u = make(*cut(buf, offs, a, b))
        if len(u.owners) < k:
            continue
        mins = sliding_min(u.grams, w)
        first, size, mini = runs(mins, window_rows(u.owners, k), w)
        if len(first):
            begin, end = u.starts[first], u.ends[first + size + k - 2]
            counts = np.bincount(u.owners, minlength=b - a)
            yield a, Supers(u, first, size, u.owners[first], begin, end, mini, loops(u.grams, mins, first, size, w), np.cumsum(counts) - counts)


def bucket_of(minis: np.ndarray, n: int) -> np.ndarray:
    return (mix(minis ^ U64(0x5851F42D4C957F2D)) % U64(n)).astype(np.int64)


def grouped(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Every key with the places where it stands."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))
    for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        yield int(keys[order[x]]), order[x:y]


def table_of(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(f.split() for f in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.Table.from_arrays([pa.array(list(c), kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def known(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ones."""
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)] == values


def minimisers(docs: DataFrame, make: Make, k: int, m: int, n_buckets: int) -> DataFrame:
    """The distinct minimisers of every block, and whether they occur again in it."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        held = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
        held += [(s.mini, s.mini[s.loops], rough_hash(prefix(s.units.data), s.begin, s.end)) for _, s in supers(table.column("text"), make, k, m)]
        minis, looped, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
        uniq, n = np.unique(np.concatenate([minis, looped]), return_counts=True)
        _, one = np.unique(hashes, return_index=True)
        strings = np.bincount(np.searchsorted(uniq, minis[one]), minlength=len(uniq)).astype(np.int32)
        rows = [(b, key[0].as_py(), uniq[at].tobytes(), (n[at] > 1).tobytes(), strings[at].tobytes()) for b, at in grouped(bucket_of(uniq, n_buckets))]
        return table_of(rows, MINIS)

    return docs.groupBy("_block").applyInArrow(run, MINIS)


def occurring_again(minis: DataFrame, hot: int) -> DataFrame:
    """For every block those of its minimisers that occur more than once anywhere, and which are hot."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        values, again = joined(table, "minis", np.uint64), joined(table, "again", bool)
        uniq, which, n = np.unique(values, return_inverse=True, return_counts=True)
        often = (n > 1) | (np.bincount(which, weights=again, minlength=len(uniq)) > 0)
        many = np.bincount(which, weights=joined(table, "strings", np.int32), minlength=len(uniq)) > hot
        rows, at = [], 0
        for block, blob in zip(table.column("_block").to_pylist(), table.column("minis").to_pylist(), strict=True):
            n = len(blob) // 8
            own = which[at : at + n][often[which[at : at + n]]]
            rows.append((block, uniq[own].tobytes(), many[own].tobytes()))
            at += n
        return table_of([r for r in rows if r[1]], AGAIN)

    return minis.groupBy("bucket").applyInArrow(run, AGAIN)


def window_hashes(s: Supers, which: np.ndarray, k: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of some super-k-mers with a rough and a strong hash of each; ``among``: only windows with these rough hashes."""
    at, u = spread(s.first[which], s.size[which]), s.units
    rough = rough_hash(prefix(u.data), u.starts[at], u.ends[at + k - 1])
    if among is not None:
        some = known(among, rough)
        at, rough = at[some], rough[some]
    strong = [span_hash(u.data, u.starts[x], u.ends[x + k - 1]) for x in np.split(at, range(1 << 15, len(at), 1 << 15))]
    return at, rough, np.concatenate(strong)


def segments(docs: DataFrame, again: DataFrame, make: Make, k: int, m: int, n_buckets: int) -> DataFrame:
    """The distinct strings of every block whose minimiser occurs again, packed by bucket."""

    def run(key: tuple, docs: pa.Table, again: pa.Table) -> pa.Table:
        wanted, is_hot = joined(again, "minis", np.uint64), joined(again, "hot", bool)
        hot, wanted = np.sort(wanted[is_hot]), np.sort(wanted[~is_hot])
        held: list[tuple] = []
        single: list[np.ndarray] = []
        block = key[0].as_py()
        if docs.num_rows and len(wanted) + len(hot):
            for _, s in supers(docs.column("text"), make, k, m):
                if len(hot):
                    single.append(np.stack(window_hashes(s, np.flatnonzero(known(hot, s.mini)), k)[1:], 1))
                at = np.flatnonzero(known(wanted, s.mini))
                hashes, one, n = np.unique(s.hashes(at), return_index=True, return_counts=True)
                o = at[one]
                size = s.end[o] - s.begin[o]
                held.append((hashes, s.mini[o], s.loops[o], n, size, gather(s.units.data, s.begin[o], size)))
        rows = []
        if single:
            pairs, n = np.unique(np.concatenate(single), axis=0, return_counts=True)
            for b, at in grouped(bucket_of(pairs[:, 0], n_buckets)):
                rough, strong = (np.ascontiguousarray(pairs[at, i]).tobytes() for i in (0, 1))
                rows.append((b, block, strong, rough, b"", n[at].astype(np.int64).tobytes(), b"", -1, b""))
        if not held:
            return table_of(rows, SEGMENTS)
        hashes, minis, looped, n, size, text = (np.concatenate(x) for x in zip(*held, strict=True))
        ends = np.cumsum(size)
        uniq, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        count = np.bincount(which, weights=n, minlength=len(uniq)).astype(np.int64)
        for b, at in grouped(bucket_of(minis[one], n_buckets)):
            o = one[at]
            raw = gather(text, ends[o] - size[o], size[o])
            rows.append((
                b, block, minis[o].tobytes(), uniq[at].tobytes(), size[o].astype(np.int32).tobytes(),
                count[at].tobytes(), looped[o].tobytes(), len(raw), squeezed(raw.tobytes()),
            ))
        return table_of(rows, SEGMENTS)

    return docs.groupBy("_block").cogroup(again.groupBy("_block")).applyInArrow(run, SEGMENTS)


#: Gets the distinct strings of a bucket (bytes, offsets, minimiser's number, sorted by it) that share a minimiser with another one or hold it twice;
#: returns the string and the first and past-last unit of every run of units that repeated windows cover.
Resolver = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def ranges(packed: DataFrame, resolve: Resolver, unit_count: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """For every block the unit ranges that repeated windows cover in its strings."""

    def counted(table: pa.Table) -> list[tuple]:
        """Hot windows: those whose two hashes occur twice or more, marked by a start of -1."""
        pairs = np.stack([joined(table, "hashes", np.uint64), joined(table, "minis", np.uint64)], 1)
        uniq, which = np.unique(pairs, axis=0, return_inverse=True)
        which = which.ravel()
        often = np.bincount(which, weights=joined(table, "counts", np.int64), minlength=len(uniq)) > 1
        rows, at = [], 0
        for block, blob in zip(table.column("_block").to_pylist(), table.column("hashes").to_pylist(), strict=True):
            own = which[at : at + len(blob) // 8]
            at += len(own)
            found = own[often[own]]
            if len(found):
                none = np.full(len(found), -1, np.int32).tobytes()
                rows.append((block, np.ascontiguousarray(uniq[found, 0]).tobytes(), none, none, np.ascontiguousarray(uniq[found, 1]).tobytes()))
        return rows

    def run(key: tuple, table: pa.Table) -> pa.Table:
        single = pa.compute.equal(table.column("n_bytes"), -1)
        rows = counted(table.filter(single)) if pa.compute.any(single).as_py() else []
        table = table.filter(pa.compute.invert(single))
        if not table.num_rows:
            return table_of(rows, RANGES)
        hashes, sizes = joined(table, "hashes", np.uint64), joined(table, "sizes", np.int32).astype(np.int64)
        uniq, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        count = np.bincount(which, weights=joined(table, "counts", np.int64), minlength=len(uniq))
        _, group = np.unique(joined(table, "minis", np.uint64)[one], return_inverse=True)
        shared = (np.bincount(group)[group] > 1) | joined(table, "loops", bool)[one]
        many = count > 1
        needed = np.flatnonzero(many | shared)
        if not len(needed):
            return table_of(rows, RANGES)
        slot = np.full(len(uniq), -1, np.int64)
        slot[needed] = np.arange(len(needed))
        wanted = (one[which] == np.arange(len(which))) & (slot[which] >= 0)
        texts, at = [], 0
        for blob, n, strings in zip(table.column("text").to_pylist(), table.column("n_bytes").to_pylist(), table.column("hashes").to_pylist(), strict=True):
            k = len(strings) // 8
            size, own = sizes[at : at + k], np.flatnonzero(wanted[at : at + k])
            if len(own):
                texts.append(gather(np.frombuffer(unsqueezed(blob, n), np.uint8), (np.cumsum(size) - size)[own], size[own]))
            at += k
        # the strings stand in the order of the table; bring them into the order of their minimisers
        order = np.flatnonzero(wanted)
        length = sizes[order]
        place = np.cumsum(length) - length
        string = slot[which[order]]
        by_group = np.argsort(group[needed[string]], kind="stable")
        string, place, length = string[by_group], place[by_group], length[by_group]
        buf, offs = gather(np.concatenate(texts), place, length), np.append(0, np.cumsum(length))
        del texts
        ids = needed[string]
        whole, some = np.flatnonzero(many[ids]), np.flatnonzero(shared[ids])
        found = [(whole, np.zeros(len(whole), np.int64), unit_count(buf, offs)[whole])]
        if len(some):
            part, a, b = resolve(gather(buf, offs[some], length[some]), np.append(0, np.cumsum(length[some])), group[ids[some]])
            found.append((some[part], a, b))
        string, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        string = ids[string]
        order = np.argsort(string, kind="stable")
        string, a, b = string[order], a[order], b[order]
        n_ranges = np.bincount(string, minlength=len(uniq))
        first = np.cumsum(n_ranges) - n_ranges
        at = 0
        for block, blob in zip(table.column("_block").to_pylist(), table.column("hashes").to_pylist(), strict=True):
            own = which[at : at + len(blob) // 8]
            at += len(own)
            pick = spread(first[own], n_ranges[own])
            if len(pick):
                rows.append((block, uniq[string[pick]].tobytes(), a[pick].astype(np.int32).tobytes(), b[pick].astype(np.int32).tobytes(), b""))
        return table_of(rows, RANGES)

    return packed.groupBy("bucket").applyInArrow(run, RANGES)


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... count times, for each pair."""
    total = int(count.sum())
    return np.arange(total) - np.repeat(np.cumsum(count) - count - first, count)


#: Gets (bytes, offsets, text, first unit, past-last unit of ranges) of some documents; returns columns.
Remover = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[pa.Array]]


def applied(docs: DataFrame, found: DataFrame, make: Make, k: int, m: int, remove: Remover, names: list[str], schema: str) -> DataFrame:
    """The documents with what ``remove`` makes of each and its ranges."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        hashes, starts, ends = joined(found, "hashes", np.uint64), joined(found, "starts", np.int32), joined(found, "ends", np.int32)
        hot, pairs = np.unique(hashes[starts < 0]), np.sort(joined_hash(hashes[starts < 0], joined(found, "strong", np.uint64)))
        hashes, starts, ends = hashes[starts >= 0], starts[starts >= 0], ends[starts >= 0]
        order = np.argsort(hashes, kind="stable")
        uniq, first, count = np.unique(hashes[order], return_index=True, return_counts=True)
        hits: list[tuple] = [(np.zeros(0, np.int64),) * 3]
        if docs.num_rows and len(uniq) + len(hot):
            for text, s in supers(docs.column("text"), make, k, m):
                if len(hot):
                    at, rough, strong = window_hashes(s, np.arange(len(s.first)), k, hot)
                    at = at[known(pairs, joined_hash(rough, strong))]
                    own = s.units.owners[at]
                    hits.append((own + text, at - s.base[own], at - s.base[own] + k))
                hashed = s.hashes(np.arange(len(s.first)))
                at = np.flatnonzero(known(uniq, hashed))
                which = np.searchsorted(uniq, hashed[at])
                pick = order[spread(first[which], count[which])]
                own = np.repeat(at, count[which])
                begin = s.first[own] - s.base[s.text[own]]
                hits.append((s.text[own] + text, begin + starts[pick], begin + ends[pick]))
        text, a, b = (np.concatenate(x).astype(np.int64) for x in zip(*hits, strict=True))
        buf, offs = buffer_of(docs.column("text"))
        return pa.Table.from_arrays([docs.column("doc_id"), *remove(buf, offs, text, a, b)], ["doc_id", *names])

    return docs.groupBy("_block").cogroup(found.groupBy("_block")).applyInArrow(run, schema)


def without_repeats(
    docs: DataFrame, make: Make, k: int, m: int, resolve: Resolver, unit_count: Callable, remove: Remover, names: list[str], schema: str, bucket_mb: float = 3, block_mb: float = 2, hot: int = HOT
) -> DataFrame:
    """Documents without the units that repeated windows cover; one row per row of docs."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    n_buckets, n_blocks = parts(docs, bucket_mb), parts(docs, block_mb)
    blocks = docs.withColumn("_block", F.pmod(row_key(), F.lit(n_blocks)).cast("int"))
    again = occurring_again(minimisers(blocks, make, k, m, n_buckets), hot)
    found = ranges(segments(blocks, again, make, k, m, n_buckets), resolve, unit_count)
    return applied(blocks, found, make, k, m, remove, names, schema)


def covered(n_units: int, base: np.ndarray, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of all units of some texts the ranges cover; base: the first unit of every text."""
    edge = np.zeros(n_units + 1, np.int64)
    np.add.at(edge, base[text] + starts, 1)
    np.subtract.at(edge, base[text] + ends, 1)
    return np.cumsum(edge[:-1]) > 0


def flagged_runs(flags: np.ndarray, owners: np.ndarray, base: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of units covered by flagged windows of k units: string, first and past-last unit."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (owners[at[1:]] != owners[at[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    own = owners[at[first]]
    return own, at[first] - base[own], at[last] - base[own] + k
