"""Hashed features, ridge heads from distributed moments, out-of-fold selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions import marks
from waybill.functions.hashing import FNV_PRIME, fnv1a_of, fnv1a_on
from waybill.functions.text import CONSTRAINT, FORMAL, PROGRAM, TRANSFORM, count_where, has_where, with_features
from waybill.sources.shared import dropped, spread, stored, swept, written

# Bounds of the hash bins, penalties, weight of the cost error, floor of a scale.
LEAST_BINS, MOST_BINS = 16, 16384
DENSE_FEATURES = 14
ALPHAS = (0.1, 1.0, 10.0, 100.0)
COST_WEIGHT, SCALE_FLOOR = 0.05, 1e-12


def check_bins(bins: int) -> None:
    if not LEAST_BINS <= bins <= MOST_BINS or bins & (bins - 1):
        raise ValueError("bins is not a power of two from 16 to 16384")


def dense_features(episodes: DataFrame) -> DataFrame:
    """Adds ``dense``, the 14 plain features in their fixed order."""
    held = with_features(episodes)

    def flag(c: Column) -> Column:
        return c.cast("double")

    columns = [
        F.log1p("n_chars"), F.log1p("n_words"), F.log1p("n_sentences"), F.log1p("n_messages"), F.col("hangul_ratio"), F.log1p("n_code"), F.log1p("n_maths"),
        F.col("numeric_density"), flag(F.col("long_context")), F.log1p("n_reasoning"), flag(has_where("formal", FORMAL)), flag(has_where("program", PROGRAM)),
        F.log1p(count_where("constraint", CONSTRAINT)), flag(has_where("transform", TRANSFORM)),
    ]
    return held.withColumn("dense", F.array(*columns))


def binned(column: pa.Array, bins: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of a column of texts: first row and end, where the bins of each row begin and the last end, the bins that its
    terms fall into, in order, and the signed count of each.

    Terms are the tokens and the pairs of adjacent ones, tagged.  The hash of a pair goes on from that of its first token.
    """
    one, two = np.uint64(fnv1a_of(b"w1:")), np.uint64(fnv1a_of(b"w2:"))

    def counted(n: int, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        single = fnv1a_on(np.full(len(row), one), data, starts, ends)
        pair = np.flatnonzero(row[1:] == row[:-1])
        double = (fnv1a_on(np.full(len(pair), two), data, starts[pair], ends[pair]) ^ np.uint64(0x1F)) * np.uint64(FNV_PRIME)
        double = fnv1a_on(double, data, starts[pair + 1], ends[pair + 1])
        h = np.concatenate([single, double])
        place, minus = np.concatenate([row, row[pair]]) * bins + (h & np.uint64(bins - 1)).astype(np.int64), h >> np.uint64(63) > 0
        if n * bins <= 4 * len(h):
            each = np.bincount(place, minlength=n * bins)
            key = np.flatnonzero(each)
            return key, (each - 2 * np.bincount(place[minus], minlength=n * bins))[key]
        key, place = np.unique(place, return_inverse=True)
        return key, np.bincount(place, np.where(minus, -1.0, 1.0), len(key)).astype(np.int64)

    data, at = marks.bytes_of(column)
    for a, b in marks.blocks(at):
        held, starts, ends, row = marks.tokens(data[at[a] : at[b]], at[a : b + 1] - at[a])
        key, value = counted(b - a, held, starts, ends, row) if len(row) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield a, b, np.searchsorted(key, np.arange(b - a + 1) * bins), key % bins, value


def term_lists(episodes: DataFrame, bins: int) -> DataFrame:
    """(episode_id, bins): the signed count of each bin that the episode's terms fall into, in order of bin; all of an episode's terms stand in its row, so nothing is shuffled."""
    check_bins(bins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, bounds, key, value in binned(batch.column(1), bins):
                pairs = pa.StructArray.from_arrays([pa.array(key), pa.array(value)], ["bin", "value"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pairs)], ["episode_id", "bins"])

    return episodes.select("episode_id", "text").mapInArrow(run, "episode_id string, bins array<struct<bin:bigint,value:bigint>>")


def term_counts(episodes: DataFrame, bins: int) -> DataFrame:
    """Signed count of each bin of each episode."""
    return term_lists(spread(episodes), bins).select("episode_id", F.inline("bins"))


def sparse_vectors(episodes: DataFrame, bins: int) -> DataFrame:
    """(episode_id, at, value): places and values of the features that may differ from 0, in order of place; the
    dense part first, then the bins scaled to unit length.  A row holds what its text has, whatever the number of bins."""
    check_bins(bins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dense = batch.column(2).flatten()
            numbers, none = dense.to_numpy(zero_copy_only=False), pc.is_null(dense).to_numpy(zero_copy_only=False)
            for a, b, bounds, key, count in binned(batch.column(1), bins):
                row = np.repeat(np.arange(b - a), np.diff(bounds))
                norm = np.sqrt(np.bincount(row, count * count, b - a))
                norm[norm == 0] = 1.0
                first = bounds + DENSE_FEATURES * np.arange(b - a + 1)
                plain, hashed = (first[:-1, None] + np.arange(DENSE_FEATURES)).ravel(), np.arange(len(key)) + DENSE_FEATURES * (row + 1)
                at, value, empty = np.empty(first[-1], np.int32), np.empty(first[-1]), np.zeros(first[-1], bool)
                at[plain], at[hashed] = np.tile(np.arange(DENSE_FEATURES), b - a), key + DENSE_FEATURES
                own = slice(a * DENSE_FEATURES, b * DENSE_FEATURES)
                value[plain], value[hashed], empty[plain] = numbers[own], count / norm[row], none[own]
                lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), x) for x in (pa.array(at), pa.array(value, mask=empty))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *lists], ["episode_id", "at", "value"])

    return dense_features(spread(episodes)).select("episode_id", "text", "dense").mapInArrow(run, "episode_id string, at array<int>, value array<double>")


def dense_form(at: Column, value: Column, width: int) -> Column:
    """A sparse vector as an array of all its places; for looking at, not for training."""
    places = F.map_from_arrays(at, value)
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at(places, i), F.lit(0.0)))


#: Numbers of dense rows that are made at a time.
NUMBERS = 1 << 18


def dense_rows(vectors: DataFrame, width: int, *more: str) -> DataFrame:
    """(episode_id, features, more): sparse vectors with all their places; a row costs its entries and its width, not their product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column(1)).to_numpy()
            first = np.append(0, np.cumsum(size))
            at, value = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            step = max(1, NUMBERS // width)
            for a in range(0, batch.num_rows, step):
                b = min(a + step, batch.num_rows)
                own = slice(first[a], first[b])
                out = np.zeros((b - a, width))
                out[np.repeat(np.arange(b - a), size[a:b]), at[own]] = value[own]
                features = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * width, pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), features, *(batch.column(i + 3).slice(a, b - a) for i in range(len(more)))], ["episode_id", "features", *more])

    kept = "".join(f", {c} {vectors.schema[c].dataType.simpleString()}" for c in more)
    return vectors.select("episode_id", "at", "value", *more).mapInArrow(run, f"episode_id string, features array<double>{kept}")


def sparse_features(rows: DataFrame, n_features: int) -> DataFrame:
    """(fold, at, value, targets) of rows (fold, features, targets), or of rows that have this form."""
    if "at" not in rows.columns:
        rows = rows.withColumn("at", F.sequence(F.lit(0), F.lit(n_features - 1))).withColumn("value", F.transform("features", lambda x: x.cast("double")))
    return rows.select(F.col("fold").cast("int").alias("fold"), "at", "value", "targets")


def sparse_rows(rows: DataFrame, n_features: int) -> DataFrame:
    """(fold, at, value) of Z = (1, features, targets) for rows (fold, features, targets) or (fold, at, value, targets)."""
    rows = sparse_features(rows, n_features)
    behind = F.transform(F.sequence(F.lit(1), F.size("targets")), lambda i: i + n_features)
    at = F.concat(F.array(F.lit(0)), F.transform("at", lambda i: (i + 1).cast("int")), behind)
    return rows.select(F.col("fold").cast("int").alias("fold"), at.alias("at"), F.concat(F.array(F.lit(1.0)), "value", "targets").alias("value"))


#: Columns of a tile, and products of pairs that are added up at a time.
TILE, PRODUCTS = 2048, 1 << 21
#: Rows whose square the driver holds for the dual form.
MOST_DUAL = 4096


def added(total: np.ndarray, own: np.ndarray, a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """Adds A'B to a tile; a and b: row, column and value of the entries, in order of rows; own: the rows' numbers."""
    first, size = np.searchsorted(b[0], own), np.bincount(b[0], minlength=int(own[-1]) + 1)[own] if len(b[0]) else np.zeros(len(own), np.int64)
    place = np.searchsorted(own, a[0])
    each, start = size[place], first[place]
    ends = np.cumsum(each)
    low = 0
    while low < len(each):
        before = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + PRODUCTS, "right")))
        n = each[low:high]
        at = np.repeat(start[low:high] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        key = np.repeat(a[1][low:high], n) * total.shape[1] + b[1][at]
        total += np.bincount(key, np.repeat(a[2][low:high], n) * b[2][at], total.size).reshape(total.shape)
        low = high


#: Bytes of the strips into which a matrix is cut on its way, and of the matrices of folds that a task holds.
STRIP, SUMS = 1 << 18, 1 << 26


def summed_moments(rows: DataFrame, width: int) -> DataFrame:
    """(fold, i, j, tile) of ``tiled_moments`` for widths of one tile: every task adds up its own rows, a few at a time as a
    dense matrix, and sends one matrix for each fold, cut into strips; what travels doesn't grow with the entries of the rows."""
    lines, most = max(1, STRIP // (8 * width)), max(1, SUMS // (8 * width * width))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for f, total in held.items():
                for k in range(0, width, lines):
                    yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([k], pa.int32()), pa.array([total[k : k + lines].tobytes()], pa.binary())], ["fold", "strip", "part"])
            held.clear()

        for batch in batches:
            fold, size = batch.column(0).to_numpy(), pc.list_value_length(batch.column(1)).to_numpy()
            first = np.append(0, np.cumsum(size))
            at, value = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            step = max(1, NUMBERS // width)
            for a in range(0, len(fold), step):
                own, entries = fold[a : a + step], slice(first[a], first[min(a + step, len(fold))])
                x = np.bincount(np.repeat(np.arange(len(own)), size[a : a + step]) * width + at[entries], value[entries], len(own) * width).reshape(-1, width)
                for f in np.unique(own).tolist():
                    if f not in held and len(held) >= most:
                        yield from sent()
                    some = x[own == f]
                    held[f] = held[f] + some.T @ some if f in held else some.T @ some
        yield from sent()

    def join(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in parts:
            for blob in part.column("part"):
                x = np.frombuffer(blob.as_buffer())
                total = x.copy() if total is None else total + x
        yield pa.RecordBatch.from_arrays([*(pa.array([k.as_py()], pa.int32()) for k in key), pa.array([total.tobytes()], pa.binary())], ["fold", "strip", "part"])

    def whole(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strips = {}
        for part in parts:
            strips |= dict(zip(part.column("strip").to_pylist(), part.column("part").to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in (key[0].as_py(), 0, 0)), pa.array([b"".join(strips[k] for k in sorted(strips))], pa.binary())], ["fold", "i", "j", "tile"])

    shape = "fold int, strip int, part binary"
    joined = rows.select("fold", "at", "value").mapInArrow(add, shape).groupBy("fold", "strip").applyInArrow(join, shape)
    return joined.groupBy("fold").applyInArrow(whole, "fold int, i int, j int, tile binary")


#: Bytes of the tiles that a task adds up in one pass over the rows, rows that are made dense at a time, and the share of
#: its columns from which a row is.
PASS, LINES, SHARE = 1 << 27, 512, 1 / 16


def with_ends(at: np.ndarray, value: np.ndarray, size: np.ndarray, targets: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, values and sizes of Z = (1, features, targets) from the entries of the features."""
    n, m = targets.shape
    first = np.append(0, np.cumsum(size + 1 + m))
    places, numbers, inner = np.empty(first[-1], np.int32), np.empty(first[-1]), np.ones(first[-1], bool)
    ends = first[1:, None] - m + np.arange(m)
    inner[first[:-1]], inner[ends.ravel()] = False, False
    places[first[:-1]], numbers[first[:-1]] = 0, 1.0
    places[ends], numbers[ends] = 1 + n_features + np.arange(m), targets
    places[inner], numbers[inner] = at + 1, value
    return places, numbers, size + 1 + m


def strip_moments(rows: DataFrame, width: int, tile: int = TILE, folds: int = 1) -> DataFrame:
    """(fold, i, j, strip, part): the tiles i <= j of Z'Z for each fold in strips of rows, from sparse rows (fold, at, value) of ``width`` columns, or
    rows (fold, at, value, targets) of features and targets.

    The rows are read as often as it takes to add up some tiles each time: every task adds its own rows to the tiles of the
    pass and sends these, cut into strips, so neither what a task holds nor what travels grows with the entries.  Long rows are
    multiplied as dense blocks, short ones entry by entry.  ``folds``: how many may meet in a task.
    """
    n, spark = -(-width // tile), rows.sparkSession
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    each = max(1, PASS // (8 * tile * tile * folds))
    lines = strip_lines(tile)
    names = ["fold", "i", "j", "strip", "part"]
    kept = rows.select("fold", "at", "value", *(["targets"] if "targets" in rows.columns else [])).coalesce(max(1, spark.sparkContext.defaultParallelism))

    def span(i: int) -> int:
        return min(tile, width - i * tile)

    def sums(own: list[tuple[int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        blocks = sorted({x for pair in own for x in pair})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, dict[tuple[int, int], np.ndarray]] = {}
            for batch in batches:
                fold, size = batch.column(0).to_numpy(), pc.list_value_length(batch.column(1)).to_numpy()
                at, value = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
                if batch.num_columns > 3:
                    targets = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1)
                    at, value, size = with_ends(at, value, size, targets, width - 1 - targets.shape[1])
                row = np.repeat(np.arange(len(size)), size)
                some = (value != 0) & np.isin(at // tile, blocks)
                row, at, value = row[some], at[some], value[some]
                long = size >= SHARE * width
                for f in np.unique(fold).tolist():
                    total = held.setdefault(f, {(i, j): np.zeros((span(i), span(j))) for i, j in own})
                    for dense in (False, True):
                        ids = np.flatnonzero((fold == f) & (long == dense))
                        step = LINES if dense else len(ids)
                        for k in range(0, len(ids), step or 1):
                            chosen = ids[k : k + step]
                            number = np.full(len(size), -1)
                            number[chosen] = np.arange(len(chosen))
                            mine = number[row] >= 0
                            r, c, v = number[row[mine]], at[mine], value[mine]
                            parts = {}
                            for x in blocks:
                                here = c // tile == x
                                part = r[here], (c[here] - x * tile).astype(np.int64), v[here]
                                parts[x] = np.bincount(part[0] * span(x) + part[1], part[2], len(chosen) * span(x)).reshape(-1, span(x)) if dense else part
                            for i, j in own:
                                if dense:
                                    total[i, j] += parts[i].T @ parts[j]
                                elif len(parts[i][0]):
                                    added(total[i, j], np.unique(parts[i][0]), parts[i], parts[j])
            for f, total in held.items():
                for i, j in own:
                    for k in range(0, span(i), lines):
                        yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in (f, i, j, k)), pa.array([total[i, j][k : k + lines].tobytes()], pa.binary())], names)

        return add

    def join(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in parts:
            for blob in part.column("part"):
                x = np.frombuffer(blob.as_buffer())
                total = x.copy() if total is None else total + x
        yield pa.RecordBatch.from_arrays([*(pa.array([k.as_py()], pa.int32()) for k in key), pa.array([total.tobytes()], pa.binary())], names)

    shape, out = "fold int, i int, j int, strip int, part binary", None
    for k in range(0, len(pairs), each):
        found = written(kept.mapInArrow(sums(pairs[k : k + each]), shape).groupBy("fold", "i", "j", "strip").applyInArrow(join, shape), "pass")
        swept(spark)
        out = found if out is None else out.unionByName(found)
    return out


def strip_lines(tile: int) -> int:
    """Rows of a strip of a tile."""
    return max(1, STRIP // (8 * tile))


def tiled_moments(rows: DataFrame, width: int, tile: int = TILE, folds: int = 1) -> DataFrame:
    """``strip_moments`` with whole tiles, (fold, i, j, tile)."""

    def whole(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strips = {}
        for part in parts:
            strips |= dict(zip(part.column("strip").to_pylist(), part.column("part").to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([*(pa.array([k.as_py()], pa.int32()) for k in key), pa.array([b"".join(strips[k] for k in sorted(strips))], pa.binary())], ["fold", "i", "j", "tile"])

    return written(strip_moments(rows, width, tile, folds).groupBy("fold", "i", "j").applyInArrow(whole, "fold int, i int, j int, tile binary"), "moments")


def assembled(tiles: DataFrame, width: int, tile: int = TILE) -> np.ndarray:
    """The sum of the folds' matrices, tile by tile; the driver holds width squared numbers."""
    out = np.zeros((width, width))
    for r in tiles.toLocalIterator():
        i, j = r["i"] * tile, r["j"] * tile
        x = np.frombuffer(r["tile"]).reshape(min(tile, width - i), min(tile, width - j))
        out[i : i + x.shape[0], j : j + x.shape[1]] += x
        if i != j:
            out[j : j + x.shape[1], i : i + x.shape[0]] += x.T
    return out


class Moments:
    """For each fold the number of rows and Z'Z of Z = (1, features, targets); a matrix is put together when it is asked for."""

    def __init__(self, rows: DataFrame, n_features: int, n_targets: int, folds: int, tile: int = TILE):
        self.width, self.folds, self.tile = 1 + n_features + n_targets, folds, tile
        if self.width <= tile:
            self.tiles = written(summed_moments(sparse_rows(rows, n_features), self.width), "moments")
        else:
            self.tiles = tiled_moments(sparse_features(rows, n_features), self.width, tile, folds)
        self._kept: dict[int | None, np.ndarray] = {}

    def __getitem__(self, fold: int | None) -> np.ndarray:
        """The matrix of a fold, or of all (None); kept if it is one tile, else read again."""
        if fold in self._kept:
            return self._kept[fold]
        if self.width <= self.tile:
            for r in self.tiles.collect():
                self._kept[r["fold"]] = np.frombuffer(r["tile"]).reshape(self.width, self.width).copy()
            for f in range(self.folds):
                self._kept.setdefault(f, np.zeros((self.width, self.width)))
            self._kept[None] = sum(self._kept[f] for f in range(self.folds))
            return self._kept[fold]
        return assembled(self.tiles if fold is None else self.tiles.filter(F.col("fold") == fold), self.width, self.tile)


def moments(rows: DataFrame, n_features: int, n_targets: int, folds: int, tile: int = TILE) -> list[tuple[float, np.ndarray]]:
    """For each fold the number of rows and the matrix Z'Z, all at once; for widths of which the driver can hold every fold's matrix."""
    held = Moments(rows, n_features, n_targets, folds, tile)
    return [(m[0, 0], m) for m in (held[f] for f in range(folds))]


def ridge(matrix: np.ndarray, n_features: int, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales, coefficients (features by targets) and intercepts from Z'Z; population scale, penalty not divided by rows."""
    n, p = matrix[0, 0], 1 + n_features
    mean, y_mean = matrix[0, 1:p] / n, matrix[0, p:] / n
    gram = matrix[1:p, 1:p] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(gram), 0))
    scale[scale < SCALE_FLOOR] = 1.0
    cross = (matrix[1:p, p:] / n - np.outer(mean, y_mean)) / scale[:, None]
    gram = gram / np.outer(scale, scale)
    return mean, scale, np.linalg.solve(gram * n + alpha * np.eye(n_features), cross * n), y_mean


def ridge_tiled(rows: DataFrame, n_features: int, n_targets: int, alpha: float, tile: int = TILE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``ridge`` of rows (fold, at, value, targets) for widths of which no process can hold the matrix.

    A Cholesky factor of the standardised moments is made tile by tile: a step factors one tile on the diagonal, tasks
    solve the tiles beside it and take their products off those that are left.  Tiles are kept and travel in strips, so no
    row is large; a task holds three tiles, the driver one and a few columns of numbers.
    """
    spark, width = rows.sparkSession, 1 + n_features + n_targets
    n_blocks, first, lines = -(-width // tile), 1 + n_features, strip_lines(tile)
    names, kinds = ["i", "j", "strip", "part"], [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    schema = "i int, j int, strip int, part binary"

    def span(i: int) -> slice:
        return slice(i * tile, min((i + 1) * tile, width))

    def size(i: int) -> int:
        return span(i).stop - i * tile

    def batch(*found: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t) for c, t in enumerate(kinds)], names)

    def strips(i: int, j: int, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(x), lines):
            yield batch((i, j, k, x[k : k + lines].tobytes()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, np.ndarray]]:
        for b in batches:
            for k in range(b.num_rows):
                i, j, strip = (b.column(c)[k].as_py() for c in range(3))
                yield i, j, strip, np.frombuffer(b.column(3)[k].as_buffer()).reshape(-1, size(j))

    def each(df: DataFrame, run: Callable[[int, int, int, np.ndarray], np.ndarray]) -> DataFrame:
        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for i, j, strip, x in read(batches):
                yield batch((i, j, strip, np.ascontiguousarray(run(i, j, strip, x)).tobytes()))

        return df.select(*names).mapInArrow(over, schema)

    def found(df: DataFrame) -> Iterator[tuple[int, int, int, np.ndarray]]:
        for r in df.collect():
            yield r["i"], r["j"], r["strip"], np.frombuffer(r["part"])

    left = strip_moments(sparse_features(rows, n_features), width, tile).select(*names)
    top = np.zeros(width)
    for _, j, _, x in found(each(left.filter("i = 0 AND strip = 0"), lambda i, j, k, x: x[0])):
        top[span(j)] = x
    square = np.zeros(width)
    for i, _, k, x in found(each(left.filter("i = j"), lambda i, j, k, x: np.diagonal(x, k))):
        square[i * tile + k : i * tile + k + len(x)] = x
    cross = np.zeros((width, n_targets))
    for i, j, k, x in found(each(left.filter(F.col("j") >= first // tile), lambda i, j, k, x: x[:, max(first - j * tile, 0) :])):
        to, columns = max(j * tile - first, 0), span(j).stop - max(first, j * tile)
        part = x.reshape(-1, columns)
        cross[i * tile + k : i * tile + k + len(part), to : to + columns] = part
    n = top[0]
    mean = top / n
    scale = np.sqrt(np.maximum(square / n - mean * mean, 0))
    scale[scale < SCALE_FLOOR] = 1.0
    own = np.zeros(width, bool)
    own[1:first] = True
    y_mean = mean[first:]
    right = np.where(own[:, None], (cross - n * np.outer(mean, y_mean)) / scale[:, None], 0.0)

    def standard(i: int, j: int, k: int, x: np.ndarray) -> np.ndarray:
        a, b = slice(i * tile + k, i * tile + k + len(x)), span(j)
        out = (x - n * np.outer(mean[a], mean[b])) / np.outer(scale[a], scale[b]) * np.outer(own[a], own[b])
        if i == j:
            at = np.arange(len(x))
            out[at, k + at] += np.where(own[a], alpha, 1.0)
        return out

    def factor(k: int) -> np.ndarray:
        parts = sorted(found(corners[k]), key=lambda f: f[2])
        return np.linalg.cholesky(np.concatenate([x.reshape(-1, size(k)) for *_, x in parts])).T

    def solved(shared: object) -> Callable[[tuple, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            i, j = key[0].as_py(), key[1].as_py()
            x = np.empty((size(i), size(j)))
            for _, _, strip, part in read(p.select(names) for p in parts):
                x[strip : strip + len(part)] = part
            yield from strips(i, j, np.linalg.solve(shared.value.T, x))

        return run

    def projected(w: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for _, j, strip, x in read(batches):
                total[j] = total.get(j, 0) + x.T @ w[strip : strip + len(x)]
            for j, x in total.items():
                yield batch((0, j, 0, x.tobytes()))

        return run

    def less(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = key[0].as_py(), key[1].as_py()
        total, held = np.zeros((size(i), size(j))), ({}, {})
        for p in parts:
            for role, strip, blob in zip(p.column("role").to_pylist(), p.column("strip").to_pylist(), p.column("part"), strict=True):
                x = np.frombuffer(blob.as_buffer())
                if role:
                    held[role - 1][strip] = x.reshape(-1, size(i if role == 1 else j)).copy()
                else:
                    x = x.reshape(-1, size(j))
                    total[strip : strip + len(x)] += x
        # both tiles of the panel have the same rows; they go as they are multiplied
        at = sorted(held[0])
        for low in range(0, len(at), 32):
            a, b = (np.concatenate([h.pop(k) for k in at[low : low + 32]]) for h in held)
            total -= a.T @ b
        yield from strips(i, j, total)

    left, stale = stored(each(left, standard), "standard")
    corners, panels = [], []
    for k in range(n_blocks):
        corners.append(written(left.filter(f"i = {k} AND j = {k}"), "corner"))
        upper = factor(k)
        right[span(k)] = np.linalg.solve(upper.T, right[span(k)])
        shared = spark.sparkContext.broadcast(upper)
        panel = written(left.filter(f"i = {k} AND j > {k}").groupBy("i", "j").applyInArrow(solved(shared), schema), "panel")
        panels.append(panel)
        for _, j, _, x in found(panel.select(*names).mapInArrow(projected(right[span(k)].copy()), schema)):
            right[span(j)] -= x.reshape(-1, n_targets)
        shared.unpersist()
        if k + 1 < n_blocks:
            last = F.lit(n_blocks - 1)
            as_row = panel.select(F.col("j").alias("i"), F.explode(F.sequence("j", last)).alias("j"), F.lit(1).alias("role"), "strip", "part")
            as_column = panel.select(F.explode(F.sequence(F.lit(k + 1), "j")).alias("i"), "j", F.lit(2).alias("role"), "strip", "part")
            dealt = left.filter(f"i > {k}").select("i", "j", F.lit(0).alias("role"), "strip", "part").unionByName(as_row).unionByName(as_column)
            left, path = stored(dealt.groupBy("i", "j").applyInArrow(less, schema), "left")
            del dealt
            dropped(spark, stale)  # what a step has left replaces what it began with
            stale = path
    for k in reversed(range(n_blocks)):
        for _, _, strip, x in found(each(panels[k], lambda i, j, s, x, w=right.copy(): x @ w[span(j)])):
            part = x.reshape(-1, n_targets)
            right[k * tile + strip : k * tile + strip + len(part)] -= part
        right[span(k)] = np.linalg.solve(factor(k), right[span(k)])
    return mean[1:first], scale[1:first], right[1:first], y_mean


def ridge_rows(row: np.ndarray, at: np.ndarray, value: np.ndarray, y: np.ndarray, n_features: int, alpha: float, columns: int = TILE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``ridge`` from the entries of the rows, in the dual form: a system of as many equations as there are rows, built some columns at a time."""
    n = len(y)
    mean = np.bincount(at, value, n_features) / n
    scale = np.zeros(n_features)
    order = np.argsort(at, kind="stable")
    row, at, value = row[order], at[order], value[order]
    cuts = np.searchsorted(at, np.arange(0, n_features + columns, columns))

    def block(k: int) -> np.ndarray:
        x = np.zeros((n, min(columns, n_features - k * columns)))
        part = slice(cuts[k], cuts[k + 1])
        x[row[part], at[part] - k * columns] = value[part]
        x -= mean[k * columns : k * columns + x.shape[1]]
        spread = np.sqrt((x * x).mean(0))
        spread[spread < SCALE_FLOOR] = 1.0
        scale[k * columns : k * columns + x.shape[1]] = spread
        return x / spread

    kernel, n_blocks = np.zeros((n, n)), -(-n_features // columns)
    for k in range(n_blocks):
        z = block(k)
        kernel += z @ z.T
    kernel[np.diag_indices(n)] += alpha
    intercept = y.mean(0)
    dual = np.linalg.solve(kernel, y - intercept)
    return mean, scale, np.concatenate([block(k).T @ dual for k in range(n_blocks)]), intercept


def fitted(rows: DataFrame, matrix: np.ndarray, n_features: int, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The heads over all rows: from the moments, or in the dual form if there are no more rows than features (so their entries fit the driver as the moments would)."""
    if matrix[0, 0] > n_features:
        return ridge(matrix, n_features, alpha)
    return fitted_dual(rows, n_features, alpha)


def fitted_dual(rows: DataFrame, n_features: int, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The heads over rows of which there are no more than features."""
    held = sparse_rows(rows, n_features).select("at", "value").toArrow().combine_chunks()
    at, value = (held.column(c).combine_chunks() for c in ("at", "value"))
    size = pc.list_value_length(at).to_numpy()
    row, place, number = np.repeat(np.arange(len(size)), size), at.flatten().to_numpy(), value.flatten().to_numpy()
    feature, target = (place > 0) & (place <= n_features), place > n_features
    y = np.zeros((len(size), int(place.max(initial=n_features)) - n_features))
    y[row[target], place[target] - n_features - 1] = number[target]
    return ridge_rows(row[feature], place[feature] - 1, number[feature], y, n_features, alpha)


def predicted_errors(matrix: np.ndarray, n_features: int, model: tuple) -> np.ndarray:
    """Mean squared error of each target on the rows behind a moment matrix; no second pass over the data."""
    mean, scale, coef, intercept = model
    p = 1 + n_features
    slope = coef / scale[:, None]
    weights = np.concatenate([(intercept - mean @ slope)[None, :], slope])
    out = []
    for t in range(matrix.shape[0] - p):
        w = np.concatenate([weights[:, t], np.zeros(matrix.shape[0] - p)])
        w[p + t] = -1
        out.append(w @ matrix @ w / matrix[0, 0])
    return np.maximum(np.array(out), 0)


def selected_alpha(folds: list[tuple[float, np.ndarray]] | Moments, n_features: int, n_scores: int, alphas: tuple[float, ...] = ALPHAS) -> tuple[float, dict[float, float]]:
    """The penalty with the least out-of-fold objective, the smaller one on ties; all penalties share the moments, of which one fold's are held beside the total."""
    total = folds[None] if isinstance(folds, Moments) else sum(m for _, m in folds)
    n = total[0, 0]
    error = {alpha: np.zeros(total.shape[0] - 1 - n_features) for alpha in alphas}
    for f in range(folds.folds if isinstance(folds, Moments) else len(folds)):
        m = folds[f] if isinstance(folds, Moments) else folds[f][1]
        if m[0, 0]:
            rest = total - m
            for alpha in alphas:
                error[alpha] += m[0, 0] * predicted_errors(m, n_features, ridge(rest, n_features, alpha))
    objective = {a: float(e[:n_scores].mean() + COST_WEIGHT * e[n_scores:].mean()) for a, e in ((a, e / n) for a, e in error.items())}
    return min(objective, key=lambda a: (objective[a], a)), objective


def linear_heads(vector: Column, mean: list[float], scale: list[float], heads: list[tuple[float, list[float]]]) -> list[Column]:
    """Each head's value for a vector column."""
    def numbers(x: list[float]) -> Column:
        return F.array(*[F.lit(float(v)) for v in x])

    centred = F.zip_with(vector, numbers(mean), lambda x, m: x.cast("double") - m)
    standard = F.zip_with(centred, numbers(scale), lambda x, s: x / s)
    return [F.lit(float(b)) + F.aggregate(F.zip_with(standard, numbers(c), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x) for b, c in heads]


def checked_arguments(n_rows: int, folds: int, alphas: tuple[float, ...], grid_size: int, validation: tuple = (None, None)) -> int:
    """The number of folds, after checking what a trainer is asked for."""
    if n_rows < 2:
        raise ValueError("training needs two episodes or more")
    if folds < 2 or grid_size < 2:
        raise ValueError("training needs two folds and two grid points or more")
    if not alphas or any(not np.isfinite(a) or a <= 0 for a in alphas):
        raise ValueError("penalties must be finite and above 0")
    if (validation[0] is None) != (validation[1] is None):
        raise ValueError("validation episodes and outcomes go together")
    return min(folds, n_rows)


def safety_candidates(multiplier: float, size: int) -> list[float]:
    """The safety ratios tried for a tier: evenly spaced from that which leaves the light budget alone to 1."""
    least = 1.0 / multiplier
    return [min(1.0, least)] if size <= 1 or least >= 1.0 else safety_grid(least, size)


def safety_grid(least: float, size: int) -> list[float]:
    """Evenly spaced ratios from ``least`` to 1."""
    if size < 2 or not 0 < least <= 1:
        raise ValueError("the grid needs two points or more and a least ratio in (0, 1]")
    return [least + (1 - least) * i / (size - 1) for i in range(size)]


def best_candidates(candidates: DataFrame) -> DataFrame:
    """For each tier the passing candidate with the best score, then the lower ratio, then the lower safety."""
    order = F.struct(F.col("score_e12").alias("a"), (-F.col("ratio_e12")).alias("b"), (-F.col("safety")).alias("c"))
    return candidates.filter("passed").groupBy("tier").agg(F.max_by(F.struct("safety", "score_e12", "ratio_e12"), order).alias("m")).select("tier", "m.*")
