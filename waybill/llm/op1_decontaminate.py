"""Benchmark decontamination by template canonicalisation.

Texts are read in two ways.  As bare words, they lose case and outer punctuation, and every window of
``WINDOW`` words (shorter items: the whole item) is compared.  As templates, numbers, units and names
become typed placeholders: a name is any capitalised word or acronym that is no function word, wherever
it stands; names in a row are one name; a number with a unit attached is a number and a unit.  Template
windows are compared if enough of their words are literal.  Items that are equal as templates, with the
same slots equal to each other, share one entry of the index and are matched once.
Hits are put on diagonals, extended word by word to runs, and runs are put together to copies.  Both
are checked slot by slot: a value of the item must stand for the same value of the document wherever
it occurs in the run or copy, and the other way round; a run that breaks this is cut up.  A document leaks an item if a consistent copy covers
at least ``NEED`` words of it (all, if it has fewer), or as many stand in the document literally.  An
item that is found by bare words is not reported once more as a template.

The windows meet by hash join.  The index of a benchmark of at most ``BLOCK_MB`` of text and
``MOST_ITEMS`` items is broadcast; a larger one is joined by shuffled window keys (``joined_leaks``).

Null texts have no words; items without words match nothing; equal items are reported each; repeated
rows are judged each; empty tables give empty results; extra columns are kept by ``decontaminated``
and dropped by ``leaks``.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import U64, buffer_of, cut, exact_ids, joined_hash, mix, slices, span_hash, window_hash, window_rows, word_spans
from .store import fresh, parts, row_key, spread, written

WINDOW, NEED, LITERALS, FEW_LITERALS, BLOCK_MB, MOST_ITEMS = 8, 13, 4, 3, 32, 200_000
BITS, U8 = 1 << 27, np.uint8
LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3
PUNCTUATION = ".,;:!?\"'()[]{}<>|*#%$&`~_=+-/\\«»„“”‘’…–—¿¡"
A_NUMBER = re.compile(r"[+\-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th|%|\$|€|£)?")
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split()
)
UNITS = frozenset(
    "mm cm dm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes pound pounds lb lbs ounce ounces oz ml cl l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees watt watts volt volts kmh mph".split()
)
NUMBER_UNIT = re.compile(rf"([+\-]?[$€£]?\d[\d.,]*)({'|'.join(sorted(UNITS, key=len, reverse=True))})", re.I)
#: Words that are no names however they are written.
FUNCTION = frozenset(
    "a about after all also although an and any are as at be because been before between both but by can could did do does during each either every few find for from give given had has have he her here him his how i if in into is "
    "it its let list many may me might more most much must my name no nor not now of off on once one only or other our out over per shall she should show since so solve some such tell than that the their them then there these they "
    "this those though through to under until up us use was we were what when where whether which while who whom whose why will with within without would write yes yet you your "
    "aber als am auf aus bei bis da das dass dem den der des die ein eine einem einen einer er es für hat ihr im ist man mit nach nicht oder sein sich sie sind um und von vor war was welche welcher wenn wer wie wird wir wo zu zum zur "
    "al au aux avec ce ces cette como con cual cuando cuál dans de del des donde du el elle en entre est et il ils la las le les lo los mais más ne no nous on ou où par para pas pero por pour que quel quelle qui qué quién se si sin sobre son "
    "sont su sur todo un una une uno vous y"
    .split()
)
ENDS = frozenset(".!?:")


def word_kind(word: str) -> tuple[int, str, bool]:
    """Kind, bare form, and whether the next name would be part of this one."""
    bare = word.strip(PUNCTUATION)
    if not bare:
        return LITERAL, word, False
    low = bare.lower()
    if low in NUMBER_WORDS or A_NUMBER.fullmatch(bare):
        return NUMBER, low, False
    if low in UNITS:
        return UNIT, low, False
    named = len(bare) > 1 and bare[0].isupper() and low not in FUNCTION and (bare[1:].islower() or (bare.isupper() and bare.isalpha()))
    return NAME if named else LITERAL, low, word.endswith(bare)


@dataclass
class Template:
    """Template words of a slice: owning text, hash of the bare word, kind, and hash with placeholders."""

    owner: np.ndarray
    literal: np.ndarray
    kind: np.ndarray
    canon: np.ndarray


def bare_words(buf: np.ndarray, offs: np.ndarray) -> tuple[Template, np.ndarray, list[tuple[int, str, bool]], np.ndarray]:
    """The words of a slice, all literal; the number of each word's form, and what ``word_kind`` says of the forms."""
    starts, ends, own = word_spans(buf, offs)
    which, first = exact_ids(buf, starts, ends)
    raw = buf.tobytes()
    spans = zip(starts[first].tolist(), ends[first].tolist(), strict=True)
    forms = [raw[a:b].decode("utf-8", "replace") for a, b in spans]
    kinds = [word_kind(w) for w in forms]
    bare, at = buffer_of(pa.array([k[1] for k in kinds], pa.string()))
    hashes = span_hash(bare, at[:-1], at[1:])
    return Template(own, hashes[which], np.zeros(len(own), np.int8), hashes[which]), which, kinds, hashes


def templates(buf: np.ndarray, offs: np.ndarray) -> tuple[Template, Template]:
    """A slice as bare words and as template words."""
    words, which, kinds, hashes = bare_words(buf, offs)
    if not kinds:
        return words, words
    kind, joins = np.array([k[0] for k in kinds], np.int8)[which], np.array([k[2] for k in kinds], bool)[which]
    own, literal = words.owner, words.literal
    # numbers with a unit become two words
    split = {i: m for i, (k, w, _) in enumerate(kinds) if k != NUMBER and w[-1:].isalpha() and (m := NUMBER_UNIT.fullmatch(w))}
    if split:
        number, unit = hashes.copy(), hashes.copy()
        bare, at = buffer_of(pa.array([g for m in split.values() for g in m.groups()], pa.string()))
        number[list(split)], unit[list(split)] = span_hash(bare, at[:-1], at[1:]).reshape(-1, 2).T
        two = np.zeros(len(kinds), bool)
        two[list(split)] = True
        times = 1 + two[which]
        second = np.append(False, np.repeat(np.arange(len(which)), times)[1:] == np.repeat(np.arange(len(which)), times)[:-1])
        form, both = np.repeat(which, times), np.repeat(two[which], times)
        own, kind, joins = np.repeat(own, times), np.repeat(kind, times), np.repeat(joins, times)
        literal = np.where(second, unit[form], number[form])
        kind[both & ~second], kind[both & second] = NUMBER, UNIT
    # names in a row become one
    goes_on = np.zeros(len(own), bool)
    goes_on[1:] = (kind[1:] == NAME) & (kind[:-1] == NAME) & joins[:-1] & (own[1:] == own[:-1])
    head = np.flatnonzero(~goes_on)
    length = np.diff(np.append(head, len(own)))
    whole = literal[head]
    for i in range(1, int(length.max(initial=1))):
        more = np.flatnonzero(length > i)
        whole[more] = joined_hash(whole[more], literal[head[more] + i])
    own, kind = own[head], kind[head]
    return words, Template(own, whole, kind, np.where(kind == LITERAL, whole, mix(kind.astype(np.uint64) + U64(0x51ED270B))))


def group_keys(t: Template, n_texts: int) -> np.ndarray:
    """Equal for texts that are equal as templates and have the same slots equal to each other."""
    slot = np.flatnonzero(t.kind != LITERAL)
    value = mix(t.literal[slot] ^ mix(t.owner[slot].astype(np.uint64) * U64(4) + t.kind[slot].astype(np.uint64)))
    _, first, place = np.unique(value, return_index=True, return_inverse=True)
    count = np.bincount(t.owner, minlength=n_texts)
    begin = np.cumsum(count) - count
    what = t.canon.copy()
    what[slot] = joined_hash(t.canon[slot], (slot[first[place]] - begin[t.owner[slot]]).astype(np.uint64))
    inside = (np.arange(len(t.owner)) - begin[t.owner]).astype(np.uint64)
    out = np.zeros(n_texts, np.uint64)
    np.add.at(out, t.owner, mix(joined_hash(what, inside)))
    return mix(out + count.astype(np.uint64))


class Entries:
    """Windows of some benchmark items, read in one way."""

    def __init__(self, ids: list[int | None], t: Template, n: int, kept: np.ndarray, ways: tuple[bool, ...]):
        self.ids, self.t = ids, t
        count = np.bincount(t.owner, minlength=n)
        self.size, self.begin = count, np.cumsum(count) - count
        self.tables: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in sorted({min(WINDOW, int(c)) for c in count[kept] if c}):
            for exact in ways:
                keys, good = windows(t, k, exact)
                own = t.owner[: len(keys)]
                at = np.flatnonzero(good & kept[own] & ((k == WINDOW) | (count[own] == k)))
                at = at[np.argsort(keys[at], kind="stable")]
                seen = np.zeros(1 << 22, bool)
                seen[(keys[at] & U64((1 << 22) - 1)).astype(np.int64)] = True
                self.tables[k, exact] = (keys[at], at, seen)


class Index:
    """Benchmark items as bare words, and one of each template; ``group`` numbers the templates of the items."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        ids = [i for i, _ in items]
        bare, t = templates(*buffer_of(pa.array([t for _, t in items], pa.string())))
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0)), np.int64)
        _, first, group = np.unique(group_keys(t, len(ids))[order], return_index=True, return_inverse=True)
        self.group = np.empty(len(ids), np.int64)
        self.group[order] = group
        self.sorted = order[np.argsort(group, kind="stable")]
        self.first = np.searchsorted(group[np.argsort(group, kind="stable")], np.arange(len(first) + 1))
        kept = np.zeros(len(ids), bool)
        kept[order[first]] = True
        self.bare = Entries(ids, bare, len(ids), np.ones(len(ids), bool), (True,))
        self.template = Entries(ids, t, len(ids), kept, (False, True))

    def members(self, item: int) -> np.ndarray:
        """All items of the item's template."""
        group = self.group[item]
        return self.sorted[self.first[group] : self.first[group + 1]]


def windows(t: Template, k: int, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all windows of k template words, or of k bare words, and whether each may be used."""
    if exact:
        return window_hash(t.literal, k), window_rows(t.owner, k)
    keys = window_hash(t.canon, k)
    literal = np.append(0, np.cumsum(t.kind == LITERAL))
    return keys, window_rows(t.owner, k) & (literal[k:] - literal[:-k] >= (LITERALS if k == WINDOW else min(FEW_LITERALS, k)))


def hits(index: Entries, t: Template, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in the slice, place in the index and length in words of all equal windows, in the order of places in the slice."""
    found = [(np.zeros(0, np.int64),) * 3]
    for (k, bare), (keys, places, seen) in index.tables.items():
        if bare != exact or not len(keys):
            continue
        own, good = windows(t, k, exact)
        at = np.flatnonzero(seen[(own & U64((1 << 22) - 1)).astype(np.int64)] & good)
        low, high = np.searchsorted(keys, own[at], "left"), np.searchsorted(keys, own[at], "right")
        n = high - low
        which = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - low, n)
        found.append((np.repeat(at, n), places[which], np.full(len(which), k)))
    p, q, k = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(p, kind="stable")
    return p[order], q[order], k[order]


def diagonals(index: Entries, p: np.ndarray, q: np.ndarray, k: np.ndarray, t: Template) -> dict[tuple[int, int], dict[int, list[list[int]]]]:
    """The hits of each text and item as runs of the item's words, by the shift between the two."""
    spans: dict[tuple[int, int], dict[int, list[list[int]]]] = defaultdict(dict)
    for x, y, n, text, item in zip(p.tolist(), q.tolist(), k.tolist(), t.owner[p].tolist(), index.t.owner[q].tolist(), strict=True):
        if x - y in (d := spans[text, item]) and y <= d[x - y][-1][1]:
            d[x - y][-1][1] = max(d[x - y][-1][1], y + n)
        else:
            d.setdefault(x - y, []).append([y, y + n])
    return spans


def enough(index: Entries, t: Template, p: np.ndarray, q: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Which hits belong to a text and item whose windows cover as many words of the item as a leak needs."""
    if not len(p):
        return np.zeros(0, bool)
    item = index.t.owner[q]
    pair = t.owner[p].astype(np.int64) * len(index.size) + item
    order = np.lexsort((q, pair))
    pair, q, k, item = pair[order], q[order], k[order], item[order]
    head = np.append(True, pair[1:] != pair[:-1])
    # windows of an item have one length, so each adds what lies before the next one
    more = np.where(np.append(head[1:], True), k, np.minimum(k, np.append(q[1:], 0) - q))
    group = np.cumsum(head) - 1
    good = np.bincount(group, more) >= np.minimum(NEED, index.size[item[head]])
    out = np.empty(len(p), bool)
    out[order] = good[group]
    return out


@dataclass(frozen=True)
class Run:
    """Consecutive words of an item [low, high) that stand in the text, ``shift`` words further on."""

    low: int
    high: int
    shift: int


def found_in(index: Index, both: tuple[Template, Template], n_texts: int, expand: bool = True) -> list[list[tuple]]:
    """For each text (item, covered words, words of the item, slots, changed slots, kind of leak); ``expand``: for all items of a template, not the first alone."""
    out = []
    for plain, more in zip(found_by(index.bare, both[0], n_texts), found_by(index.template, both[1], n_texts), strict=True):
        rows, known = [row for _, row, _ in plain], {item for item, _, _ in plain}
        for item, row, covered in more:
            members = index.members(item)
            if not expand or len(members) == 1:
                rows += [row] * (item not in known)
                continue
            # members differ from each other in the values of their slots only
            at = np.array(list(covered.items()), np.int64).reshape(-1, 2)
            at = at[index.template.t.kind[at[:, 0]] != LITERAL]
            places = index.template.begin[members][:, None] + (at[:, 0] - index.template.begin[item])
            changed = (index.template.t.literal[places] != both[1].literal[at[:, 1]]).sum(1).tolist()
            for m, n in zip(members.tolist(), changed, strict=True):
                if m not in known:
                    rows.append((index.template.ids[m], *row[1:4], n, row[5] if row[5] == "edited" else "reparameterised" if n else "exact"))
        out.append(rows)
    return out


def found_by(index: Entries, t: Template, n_texts: int) -> list[list[tuple[int, tuple, dict[int, int]]]]:
    """For each text the items found, with their rows and covered words, by one way of reading."""
    held = [hits(index, t, exact) for exact in (False, True)]
    good = enough(index, t, *held[1])
    if len(held[0][0]):
        pairs = lambda p, q: t.owner[p].astype(np.int64) * len(index.size) + index.t.owner[q]
        good |= np.isin(pairs(held[1][0], held[1][1]), pairs(held[0][0], held[0][1]))
    spans, bare = diagonals(index, *held[0], t), diagonals(index, *(x[good] for x in held[1]), t)
    count = np.bincount(t.owner, minlength=n_texts)
    begin = np.cumsum(count) - count
    out: list[list[tuple[int, tuple, dict[int, int]]]] = [[] for _ in range(n_texts)]
    for text, item in {**spans, **bare}:
        low, high = int(index.begin[item]), int(index.begin[item] + index.size[item])
        first, last = int(begin[text]), int(begin[text] + count[text])

        def extended(by_shift: dict[int, list[list[int]]], low: int = low, high: int = high, first: int = first, last: int = last) -> Iterator[Run]:
            for shift, runs in by_shift.items():
                for a, b in runs:
                    while a > low and a + shift > first and index.t.literal[a - 1] == t.literal[a + shift - 1]:
                        a -= 1
                    while b < high and b + shift < last and index.t.literal[b] == t.literal[b + shift]:
                        b += 1
                    yield Run(a, b, shift)

        runs = {*extended(spans.get((text, item), {})), *extended(bare.get((text, item), {}))}
        row = judged(index, t, item, sorted(runs, key=lambda r: (r.low + r.shift, r.shift, r.high)))
        if row is not None:
            out[text].append((item, *row))
    return out


def consistent(index: Entries, t: Template, run: Run) -> Iterator[tuple[Run, frozenset]]:
    """The longest parts of a run without a contradiction among their slots, and these slots (kind, value there, value here)."""
    at = [q for q in range(run.low, run.high) if index.t.kind[q] != LITERAL]
    slots = [(int(index.t.kind[q]), int(index.t.literal[q]), int(t.literal[q + run.shift])) for q in at]
    low, first, last = run.low, 0, 0
    there: dict[tuple[int, int], int] = {}
    back: dict[tuple[int, int], int] = {}
    while True:
        while last < len(at) and there.get(slots[last][:2], slots[last][2]) == slots[last][2] and back.get(slots[last][::2], slots[last][1]) == slots[last][1]:
            there[slots[last][:2]], back[slots[last][::2]] = slots[last][2], slots[last][1]
            last += 1
        high = at[last] if last < len(at) else run.high
        yield Run(low, high, run.shift), frozenset(slots[first:last])
        if last == len(at):
            return
        k, a, b = slots[last]
        while any(x == k and (y == a) != (z == b) for x, y, z in slots[first:last]):
            low, first = at[first] + 1, first + 1
        there = {(x, y): z for x, y, z in slots[first:last]}
        back = {(x, z): y for x, y, z in slots[first:last]}


def judged(index: Entries, t: Template, item: int, runs: list[Run]) -> tuple[tuple, dict[int, int]] | None:
    """The row of a leak and the covered words with their places, from the runs of the item's words in a text, in the text's order.

    Every run starts a copy: the other runs near it, nearest first, are added as far as their slots
    agree with those already in.  One more copy starts at the longest run and takes in runs from the
    whole text, and so does the set of all words that stand in the text literally.
    """
    size = int(index.size[item])
    need = min(NEED, size)
    slot = index.t.kind != LITERAL
    runs, held = zip(*(x for r in runs for x in consistent(index, t, r)), strict=True)
    start = [r.low + r.shift for r in runs]

    def copy(anchor: int, others: list[int]) -> tuple[int, dict[int, int]]:
        there: dict[tuple[int, int], int] = {}
        back: dict[tuple[int, int], int] = {}
        covered: dict[int, int] = {}
        for i in (anchor, *others):
            if any(there.get((k, a), b) != b or back.get((k, b), a) != a for k, a, b in held[i]):
                continue
            there.update({(k, a): b for k, a, b in held[i]})
            back.update({(k, b): a for k, a, b in held[i]})
            for q in range(runs[i].low, runs[i].high):
                covered.setdefault(q, q + runs[i].shift)
            if len(covered) == size:
                break
        changed = sum(int(index.t.literal[q]) != int(t.literal[p]) for q, p in covered.items() if slot[q])
        return changed, covered

    best: tuple | None = None
    reach = 2 * size + 64
    longest = max(range(len(runs)), key=lambda i: runs[i].high - runs[i].low)
    anchors = {(runs[i].low, runs[i].high, held[i]): i for i in range(len(runs) - 1, -1, -1)}
    for i in (longest, *sorted(anchors.values())):
        a, b = (0, len(runs)) if i == longest else (bisect_left(start, start[i] - reach), bisect_right(start, start[i] + reach))
        changed, covered = copy(i, sorted((j for j in range(a, b) if j != i), key=lambda j: (abs(start[j] - start[i]), j)))
        if len(covered) >= need and (best is None or (-len(covered), changed) < best[0]):
            slots = sum(bool(slot[q]) for q in covered)
            best = (-len(covered), changed), ((index.ids[item], len(covered), size, slots, changed, "reparameterised" if changed else "exact"), covered)
        if len(covered) == size and not changed:
            break
    if best is not None:
        return best[1]
    literal = {q for r in runs for q in range(r.low, r.high) if index.t.literal[q] == t.literal[q + r.shift]}
    if len(literal) < need:
        return None
    covered = {q: q + r.shift for r in runs for q in range(r.low, r.high)}
    covered |= {q: q + r.shift for r in runs for q in range(r.low, r.high) if index.t.literal[q] == t.literal[q + r.shift]}
    slots = sum(bool(slot[q]) for q in covered)
    return (index.ids[item], len(covered), size, slots, sum(bool(slot[q]) and q not in literal for q in covered), "edited"), covered


FOUND = "doc_id bigint, item_id bigint, n_covered bigint, n_item_words bigint, n_slots bigint, n_changed bigint, kind string"
NAMES = [c.split()[0] for c in FOUND.split(", ")]


def found_batch(ids: list, found: list[list[tuple]]) -> pa.RecordBatch:
    rows = [(i, *f) for i, own in zip(ids, found, strict=True) for f in own]
    columns = zip(*rows, strict=True) if rows else [[]] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [*[pa.int64()] * 6, pa.string()], strict=True)], NAMES)


def scanned(column: pa.Array, index: Index, expand: bool = True) -> Iterator[list[tuple]]:
    buf, offs = buffer_of(column)
    for a, b in slices(offs):
        yield from found_in(index, templates(*cut(buf, offs, a, b)), b - a, expand)


def plain_items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))


def small_index(benchmark: DataFrame, block_mb: float) -> Index | None:
    """An index of all items if they are at most ``block_mb`` of text and ``MOST_ITEMS`` rows."""
    items = plain_items(benchmark)
    size, n = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    if (size or 0) > block_mb * (1 << 20) or n > MOST_ITEMS:
        return None
    return Index([(r["item_id"], r["text"]) for r in items.orderBy("item_id", "text").collect()])


# -- benchmarks of any size: a hash join of window keys ----------------------------------------------------


def tag(k: int, exact: bool, loose: bool) -> U64:
    return U64(4 * k + 2 * loose + exact + 1)


def text_keys(both: tuple[Template, Template], n_texts: int, sizes: list[int], whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text and key of all windows that may be used; ``whole``: windows shorter than ``WINDOW`` must be the whole text."""
    for loose, t in enumerate(both):
        count = np.bincount(t.owner, minlength=n_texts)
        for k in sizes:
            for exact in (False, True) if loose else (True,):
                keys, good = windows(t, k, exact)
                if whole and k < WINDOW:
                    good = good & (count[t.owner[: len(keys)]] == k)
                yield t.owner[: len(keys)][good], joined_hash(keys[good], np.full(int(good.sum()), tag(k, exact, bool(loose))))


def keyed(rows: DataFrame, sizes: list[int], bits: object | None) -> DataFrame:
    """(row, text, key) for every distinct window key of rows (row, text), of documents only keys whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = buffer_of(batch.column(1))
            for a, b in slices(offs):
                held = [x for x in text_keys(templates(*cut(buf, offs, a, b)), b - a, sizes, bits is None)]
                own, keys = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, int), np.zeros(0, np.uint64))
                if bits is not None:
                    some = np.flatnonzero(bits.value[(keys & U64(BITS - 1)).astype(np.int64) >> 3] >> (keys & U64(7)).astype(np.uint8) & 1)
                    own, keys = own[some], keys[some]
                if len(keys):
                    own, keys = np.unique(np.stack([own.astype(np.uint64), keys], 1), axis=0).T
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own.astype(np.int64) + a)), pa.array(np.ascontiguousarray(keys).view(np.int64))], ["row", "key"])

    return rows.select("row", "text").mapInArrow(run, "row bigint, key bigint")


def key_bits(keys: DataFrame) -> np.ndarray:
    """A bit set of ``BITS`` bits, whatever the number of keys, put together by parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BITS >> 3, np.uint8)
        for batch in batches:
            k = batch.column(0).to_numpy().view(np.uint64)
            np.bitwise_or.at(total, (k & U64(BITS - 1)).astype(np.int64) >> 3, U8(1) << (k & U64(7)).astype(np.uint8))
        parts = [(i, total[i << 18 : (i + 1) << 18]) for i in range(BITS >> 21)]
        parts = [(i, p.tobytes()) for i, p in parts if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], ["part", "bits"])

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 18, np.uint8)
        for part in parts:
            for blob in part.column("bits").to_pylist():
                total |= np.frombuffer(blob, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "bits"])

    schema = "part int, bits binary"
    out = np.zeros(BITS >> 3, np.uint8)
    for r in keys.select("key").mapInArrow(run, schema).groupBy("part").applyInArrow(add, schema).collect():
        out[r["part"] << 18 : (r["part"] + 1) << 18] = np.frombuffer(r["bits"], np.uint8)
    return out


def joined_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``leaks`` for benchmarks of any size, in one pass over docs to find candidates.

    Window keys of the benchmark set the bits of a filter of fixed size; keys of the documents that
    pass it are joined with the benchmark's by hash (Spark splits the partitions of hot keys), and
    every document that shares a key with an item is judged against that item.
    """
    spark = docs.sparkSession
    items = plain_items(benchmark).withColumn("row", F.xxhash64("text"))
    texts = written(items.select("row", "text").dropDuplicates(["row"]), "items")
    keys = written(keyed(texts, list(range(1, WINDOW + 1)), None), "keys")
    bits = spark.sparkContext.broadcast(key_bits(keys))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row", row_key())
    hits = keyed(spread(rows), list(range(1, WINDOW + 1)), bits)
    pairs = hits.join(keys.withColumnRenamed("row", "item"), "key").select("row", "item").distinct()
    wanted = written(pairs.join(texts.withColumnRenamed("row", "item"), "item").select("row", "item", F.col("text").alias("item_text")), "pairs")
    n = parts(rows, 32)
    left = rows.join(wanted.select("row").distinct(), "row", "left_semi").withColumn("part", F.pmod(F.xxhash64("row"), F.lit(n)))
    right = wanted.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(n)))

    def judge(key: tuple, docs: pa.Table, items: pa.Table) -> pa.Table:
        by: dict[int, list[tuple]] = defaultdict(list)
        for r in items.to_pylist():
            by[r["row"]].append((r["item"], r["item_text"]))
        out = [found_batch([], [])]
        for r in docs.to_pylist():
            out.append(found_batch([r["doc_id"]], list(scanned(pa.array([r["text"]], pa.large_string()), Index(by[r["row"]])))))
        return pa.Table.from_batches(out)

    found = left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(judge, FOUND).withColumnRenamed("item_id", "row")
    return found.join(items.select("row", "item_id"), "row").select(*NAMES)


def leaks(docs: DataFrame, benchmark: DataFrame, block_mb: float = BLOCK_MB) -> DataFrame:
    """One row for each document and benchmark item that it leaks."""
    index = small_index(benchmark, block_mb)
    if index is None:
        return joined_leaks(docs, benchmark)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield found_batch(batch.column(0).to_pylist(), list(scanned(batch.column(1), shared.value)))

    return spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, FOUND)


def decontaminated(docs: DataFrame, benchmark: DataFrame, block_mb: float = BLOCK_MB) -> DataFrame:
    """The rows of docs that leak no item."""
    index = small_index(benchmark, block_mb)
    if index is None:
        (row,) = fresh(docs, "_row")
        found = joined_leaks(docs.select(row_key().alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(row)).distinct()
        return docs.withColumn(row, F.xxhash64(F.col("text"), F.col("doc_id"))).join(found, row, "left_anti").select(*docs.columns)
    shared, at = docs.sparkSession.sparkContext.broadcast(index), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not found for found in scanned(batch.column(at), shared.value, False)], pa.bool_()))

    return spread(docs).mapInArrow(run, docs.schema)


def op1_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leak benchmark items."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
