"""Fill-in-middle transformation on ropes.

A text is a rope: a binary tree whose leaves hold some KB of it and cache how many units and code
points they hold, as every inner node caches those of its subtree.  Units are ``[A-Za-z]+|[^A-Za-z]``.
Two splits at unit ranks, each a walk from the root to one leaf, give prefix, middle and suffix; the
subtrees are concatenated in another order with sentinels between them, so nothing but the two split
leaves is copied until the result is written out.  ``restored`` inverts: it finds the sentinels' unit
ranks in a rope of the output, splits there and concatenates in the old order.

Sentinels start with ``<`` and end with ``>``, so none can arise where a piece meets a sentinel, and a
piece behind a sentinel begins with a unit of its own: ranks in the output are those of the pieces.

Null text is an empty text; empty texts and texts that hold a sentinel stay plain, as some others by
hash.  A null doc_id is hashed as an empty string.  Every row is transformed on its own, so repeated
rows give equal results; an empty table gives no rows.  Other columns travel along; those named as the
added ones are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import buffer_of, cut, slices
from .store import spread

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Units of each sentinel: two signs and a letter.
MARK_UNITS = 3
LEAF_BYTES = 4096
ADDED = ("n_units", "form", "fim_text", "prefix_chars", "middle_chars")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass(frozen=True, slots=True)
class Leaf:
    """Bytes of whole code points; ``opens`` tells whether its first one begins a unit."""

    data: bytes
    units: int
    points: int
    opens: bool = True


@dataclass(frozen=True, slots=True)
class Node:
    left: Rope
    right: Rope
    units: int
    points: int


Rope = Leaf | Node
EMPTY = Leaf(b"", 0, 0)
MARKS = {m: Leaf(m, MARK_UNITS, MARK_UNITS) for m in (PREFIX, SUFFIX, MIDDLE)}


def unit_starts(data: np.ndarray, opens: np.ndarray | int) -> np.ndarray:
    """Which bytes begin a unit; ``opens`` are places where one begins if a code point does, whatever stands before."""
    letter = _LETTER[data]
    starts = ~letter
    starts[1:] |= ~letter[:-1]
    starts[opens] = True
    return starts & ((data & 0xC0) != 0x80)


def concat(*ropes: Rope) -> Rope:
    """One rope; the depth grows by one for each, so it stays low for a few pieces."""
    out = EMPTY
    for r in ropes:
        if out is EMPTY or not out.points:
            out = r
        elif r.points:
            out = Node(out, r, out.units + r.units, out.points + r.points)
    return out


def balanced(leaves: list[Leaf]) -> Rope:
    level: list[Rope] = list(leaves)
    while len(level) > 1:
        pairs = [Node(a, b, a.units + b.units, a.points + b.points) for a, b in zip(level[::2], level[1::2], strict=False)]
        level = pairs + level[2 * len(pairs) :]
    return level[0] if level else EMPTY


def split(rope: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first ``rank`` units, and the rest."""
    if rank <= 0:
        return EMPTY, rope
    if rank >= rope.units:
        return rope, EMPTY
    if isinstance(rope, Node):
        if rank <= rope.left.units:
            # a run of letters may go on in the right subtree: its bytes before the first start belong to the last unit
            if rank == rope.left.units:
                tail, rest = lead(rope.right)
                return concat(rope.left, tail), rest
            a, b = split(rope.left, rank)
            return a, concat(b, rope.right)
        a, b = split(rope.right, rank - rope.left.units)
        return concat(rope.left, a), b
    data = np.frombuffer(rope.data, np.uint8)
    at = int(np.flatnonzero(unit_starts(data, 0) if rope.opens else unit_starts(data, []) & first_not(len(data)))[rank])
    points = int(((data[:at] & 0xC0) != 0x80).sum())
    return Leaf(rope.data[:at], rank, points, rope.opens), Leaf(rope.data[at:], rope.units - rank, rope.points - points)


def first_not(n: int) -> np.ndarray:
    out = np.ones(n, bool)
    out[:1] = False
    return out


def lead(rope: Rope) -> tuple[Rope, Rope]:
    """What goes on with the unit that stands before the rope, and the rest from its first unit start on."""
    if isinstance(rope, Node):
        tail, rest = lead(rope.left)
        if rest.points:
            return tail, concat(rest, rope.right)
        more, rest = lead(rope.right)
        return concat(tail, more), rest
    if rope.opens or not rope.points:
        return EMPTY, rope
    if not rope.units:
        return rope, EMPTY
    data = np.frombuffer(rope.data, np.uint8)
    at = int(np.flatnonzero(unit_starts(data, []) & first_not(len(data)))[0])
    points = int(((data[:at] & 0xC0) != 0x80).sum())
    return Leaf(rope.data[:at], 0, points, False), Leaf(rope.data[at:], rope.units, rope.points - points)


def leaves(rope: Rope) -> Iterator[Leaf]:
    waiting = [rope]
    while waiting:
        r = waiting.pop()
        if isinstance(r, Leaf):
            yield r
        else:
            waiting += (r.right, r.left)


def content(rope: Rope) -> bytes:
    return b"".join(leaf.data for leaf in leaves(rope))


def ropes(buf: np.ndarray, offs: np.ndarray, leaf_bytes: int = LEAF_BYTES) -> list[Rope]:
    """A rope for each text; units and code points of all leaves are counted together."""
    n = len(offs) - 1
    if not len(buf):
        return [EMPTY] * n
    first = offs[:-1][np.diff(offs) > 0]
    starts, points = unit_starts(buf, first), (buf & 0xC0) != 0x80
    size = np.diff(offs)
    counts = -(-size // leaf_bytes)
    inside = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    cuts = np.repeat(offs[:-1], counts) + inside * leaf_bytes
    for _ in range(3):  # to the start of a code point
        cuts = cuts - (~points[cuts] & (inside > 0))
    units = np.add.reduceat(starts, cuts, dtype=np.int64).tolist()
    chars = np.add.reduceat(points, cuts, dtype=np.int64).tolist()
    opens, raw = starts[cuts].tolist(), buf.tobytes()
    cuts = [*cuts.tolist(), len(buf)]
    held = [Leaf(raw[cuts[i] : cuts[i + 1]], units[i], chars[i], opens[i]) for i in range(len(units))]
    ends = [0, *np.cumsum(counts).tolist()]
    return [held[a] if b == a + 1 else balanced(held[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def rank_of(rope: Rope, mark: bytes) -> int:
    """The units before the first place of a sentinel, which may span leaves."""
    before, tail = 0, b""
    for leaf in leaves(rope):
        at = (tail + leaf.data).find(mark)
        if at >= 0:
            at -= len(tail)
            if at <= 0:
                return before + at  # every byte of a sentinel is a unit
            data = np.frombuffer(leaf.data, np.uint8)
            starts = unit_starts(data, 0)
            starts[0] &= leaf.opens
            return before + int(starts[:at].sum())
        before += leaf.units
        tail = (tail + leaf.data)[-len(mark) + 1 :]
    raise ValueError(f"no {mark.decode()} in the output")


def rearranged(rope: Rope, low: int, high: int, spm: bool) -> tuple[Rope, int, int]:
    """The output, and the code points of prefix and middle."""
    head, rest = split(rope, low)
    middle, tail = split(rest, high - low)
    p, s, m = MARKS[PREFIX], MARKS[SUFFIX], MARKS[MIDDLE]
    out = concat(s, tail, p, head, m, middle) if spm else concat(p, head, s, tail, m, middle)
    return out, head.points, middle.points


def put_back(rope: Rope, form: str) -> Rope:
    """The text of an output."""
    if form == "plain":
        return rope
    inner, last = (PREFIX, False) if form == "spm" else (SUFFIX, True)
    _, rest = split(rope, MARK_UNITS)
    one, rest = split(rest, rank_of(rest, inner))
    two, rest = split(split(rest, MARK_UNITS)[1], rank_of(rest, MIDDLE) - MARK_UNITS)
    middle = split(rest, MARK_UNITS)[1]
    return concat(one, middle, two) if last else concat(two, middle, one)


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[i : i + 4], "big") for i in (0, 4, 8, 12))


def strings(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary()).view(pa.string())


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """docs with n_units, form, fim_text (the output), prefix_chars and middle_chars (null if plain)."""
    rest = docs.drop(*ADDED)
    at, id_at = rest.columns.index("text"), rest.columns.index("doc_id")
    added = [("n_units", T.LongType()), ("form", T.StringType()), ("fim_text", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType())]
    schema = T.StructType([*rest.schema.fields, *(T.StructField(n, t) for n, t in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = buffer_of(batch.column(at))
            for a, b in slices(offs):
                ids = batch.column(id_at).slice(a, b - a).to_pylist()
                units, forms, outputs, heads, middles = [], [], [], [], []
                for doc_id, rope in zip(ids, ropes(*cut(buf, offs, a, b), leaf_bytes), strict=True):
                    h1, h2, h3, h4 = draws(seed, doc_id)
                    n, text = rope.units, rope.data if isinstance(rope, Leaf) else content(rope)
                    units.append(n)
                    if not n or h3 % 100 >= 100 - plain_percent or any(m in text for m in MARKS):
                        out, head, middle, form = text, None, None, "plain"
                    else:
                        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                        form = "spm" if h4 % 100 < spm_percent else "psm"
                        moved, head, middle = rearranged(rope, low, high, form == "spm")
                        out = content(moved)
                    for column, value in zip((forms, outputs, heads, middles), (form, out, head, middle), strict=True):
                        column.append(value)
                new = [pa.array(units, pa.int64()), pa.array(forms, pa.string()), strings(outputs), pa.array(heads, pa.int64()), pa.array(middles, pa.int64())]
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns] + new, schema.names)

    return spread(rest).mapInArrow(run, schema)


def restored(outputs: DataFrame, name: str = "restored_text", leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """outputs with the exact text, rebuilt from fim_text and form alone."""
    rest = outputs.drop(name)
    at, form_at = rest.columns.index("fim_text"), rest.columns.index("form")
    schema = T.StructType([*rest.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = buffer_of(batch.column(at))
            for a, b in slices(offs):
                forms = batch.column(form_at).slice(a, b - a).to_pylist()
                texts = [content(put_back(r, f or "plain")) for r, f in zip(ropes(*cut(buf, offs, a, b), leaf_bytes), forms, strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), strings(texts)], schema.names)

    return rest.mapInArrow(run, schema)


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and digests of every document's output and of the text rebuilt from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = fill_in_middle(docs).select("doc_id", "n_units", "form", "prefix_chars", "middle_chars", "fim_text")
    return restored(made).select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars",
        F.sha2("fim_text", 256).alias("output_sha256"), F.sha2("restored_text", 256).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256(concat('1:', doc_id)) AS h FROM documents),
k AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
    ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS e FROM d),
p AS (
  SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 90 THEN 'plain'
      WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(a, b)], '') AS head, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(u[greatest(a, b) + 1:], '') AS tail
  FROM k),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'spm' THEN concat('<S>', tail, '<P>', head, '<M>', middle) ELSE concat('<P>', head, '<S>', tail, '<M>', middle) END AS output
  FROM p)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(head)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars, sha256(output) AS output_sha256, sha256(text) AS restored_sha256
FROM o
"""
