"""Quality rules as a short-circuit cascade.

Each rule names the measures it needs.  On a sample, the cost of every measure and the texts each
rule rejects are estimated; rules are then ordered greedily by texts rejected among the survivors
per second of measures not yet computed.  Over the data, a rule's measures are computed only for the
texts that earlier rules kept.  The order changes the cost, never the verdict, which is that all
rules pass.

Null text counts as empty (no words, rejected); repeated rows get a verdict each; an empty table
gives an empty result; extra columns travel along, those named like a result are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import DELIM, U64, buffer_of, cut, exact_ids, gather, mix, owner, slices, span_hash, window_hash, window_rows, word_spans
from .store import spread

WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
UPPER = np.zeros(256, bool)
UPPER[ord("A") : ord("Z") + 1] = True
LETTER = UPPER.copy()
LETTER[ord("a") : ord("z") + 1] = True


class Measures:
    """Measures of a batch of texts, computed when first asked for."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, known: dict | None = None):
        self.buf, self.offs, self.n = buf, offs, len(offs) - 1
        self.known: dict[str, np.ndarray] = known or {}
        self.held: dict = {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.known:
            self.known[name] = getattr(self, name)()
        return self.known[name]

    def subset(self, keep: np.ndarray) -> Measures:
        at = np.flatnonzero(keep)
        size = np.diff(self.offs)[at]
        return Measures(gather(self.buf, self.offs[at], size), np.append(0, np.cumsum(size)), {k: v[at] for k, v in self.known.items()})

    def count(self, mask: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(mask))
        return total[self.offs[1:]] - total[self.offs[:-1]]

    def part(self, name: str, make: Callable) -> object:
        if name not in self.held:
            self.held[name] = make()
        return self.held[name]

    def words(self) -> tuple:
        return self.part("words", lambda: word_spans(self.buf, self.offs))

    def n_words(self) -> np.ndarray:
        return np.bincount(self.words()[2], minlength=self.n)

    def word_chars(self) -> np.ndarray:
        return self.count(((self.buf & 0xC0) != 0x80) & ~DELIM[self.buf])

    def n_symbols(self) -> np.ndarray:
        return self.count(SYMBOLS[self.buf])

    def n_upper(self) -> np.ndarray:
        return self.count(UPPER[self.buf])

    def n_letters(self) -> np.ndarray:
        return self.count(LETTER[self.buf])

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Number and text of every line that has a word; equal lines have one number."""

        def make() -> tuple:
            cuts = np.flatnonzero(self.buf == 10)
            starts = np.sort(np.concatenate([self.offs[:-1], cuts + 1]))
            ends = np.sort(np.concatenate([cuts, self.offs[1:]]))
            total = np.append(0, np.cumsum(~DELIM[self.buf]))
            some = total[ends] > total[starts]
            starts, ends = starts[some], ends[some]
            return exact_ids(self.buf, starts, ends)[0], owner(self.offs, starts)

        return self.part("lines", make)

    def n_lines(self) -> np.ndarray:
        return np.bincount(self.lines()[1], minlength=self.n)

    def n_dup_lines(self) -> np.ndarray:
        ids, own = self.lines()
        _, first = np.unique(ids + own * (len(ids) + 1), return_index=True)
        return np.bincount(own, minlength=self.n) - np.bincount(own[first], minlength=self.n)

    def n_repeat_words(self) -> np.ndarray:
        starts, ends, own = self.words()
        h = span_hash(self.buf, starts, ends)
        at = np.flatnonzero(window_rows(own, WINDOW))
        keys = mix(window_hash(h, WINDOW)[at] ^ (own[at].astype(np.uint64) * U64(0xA24BAED4963EE407)))
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        if not same.any():
            return np.zeros(self.n, np.int64)
        twice = np.append(False, same) | np.append(same, False)
        hits = at[order[twice]]
        # equal hashes are settled on the words themselves
        ids, _ = exact_ids(self.buf, starts, ends, h)
        _, which, n = np.unique(np.stack([own[hits], *(ids[hits + j] for j in range(WINDOW))], 1), axis=0, return_inverse=True, return_counts=True)
        hits = hits[n[which.ravel()] > 1]
        edge = np.zeros(len(starts) + 1, np.int32)
        edge[hits] += 1
        np.subtract.at(edge, hits + WINDOW, 1)
        return np.bincount(own[np.cumsum(edge[:-1]) > 0], minlength=self.n)


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    fails: Callable[[Measures], np.ndarray]
    base: bool = False


#: The base rules, then rules for junk that no clean prose comes near.
RULES = (
    Rule("few_words", ("n_words",), lambda m: m["n_words"] < 20, True),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"], True),
    Rule("symbols", ("n_symbols", "n_words"), lambda m: 4 * m["n_symbols"] > m["n_words"]),
    Rule("shouting", ("n_upper", "n_letters"), lambda m: 10 * m["n_upper"] > 6 * m["n_letters"]),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
    Rule("word_length", ("word_chars", "n_words"), lambda m: (m["word_chars"] > 20 * m["n_words"]) | (2 * m["word_chars"] < 3 * m["n_words"])),
)


def cascade(m: Measures, rules: Sequence[Rule]) -> np.ndarray:
    """Whether each text passes all rules; a rule sees only the texts that are still in."""
    alive, current = np.arange(m.n), m
    for rule in rules:
        if not len(alive):
            break
        passed = ~rule.fails(current)
        alive = alive[passed]
        if not passed.all():
            current = current.subset(passed)
    out = np.zeros(m.n, bool)
    out[alive] = True
    return out


def rule_order(buf: np.ndarray, offs: np.ndarray, rules: Sequence[Rule] = RULES) -> list[Rule]:
    """The rules by texts of the sample rejected per second, each given those before it."""
    m, cost = Measures(buf, offs), {}
    for name in dict.fromkeys(n for r in rules for n in r.needs):
        began = time.perf_counter()
        m[name]
        cost[name] = time.perf_counter() - began + 1e-6
    fails = {r.name: r.fails(m) for r in rules}
    alive, done, left, order = np.ones(m.n, bool), set(), list(rules), []
    while left:

        def gain(r: Rule) -> float:
            return float((fails[r.name] & alive).sum() + 1e-3) / (1e-6 + sum(cost[n] for n in r.needs if n not in done))

        best = max(left, key=gain)
        left.remove(best)
        order.append(best)
        alive &= ~fails[best.name]
        done |= set(best.needs)
    return order


def sampled_order(docs: DataFrame, rules: Sequence[Rule] = RULES, sample: int = 500, most_bytes: int = 1 << 16) -> list[Rule]:
    """``rule_order`` on at most ``sample`` texts of at most ``most_bytes`` each, chosen by hash among the first partitions' rows; it bears on the cost only."""
    chosen = docs.select("text").filter((F.pmod(F.xxhash64("text"), F.lit(4)) == 0) & (F.octet_length("text") <= most_bytes)).limit(sample)
    texts = [r[0] for r in chosen.collect()]
    return rule_order(*buffer_of(pa.array(texts, pa.string())), rules=rules)


MEASURED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES, measured: Sequence[str] = (), keep_text: bool = True) -> DataFrame:
    """docs with ``kept``, and with ``base_failed`` and the measures asked for over all rows."""
    order = sampled_order(docs, rules)
    names = [*measured, *(["base_failed"] if measured else []), "kept"]
    rest = docs.drop(*names)
    fields = [f for f in rest.schema.fields if keep_text or f.name != "text"]
    schema = T.StructType(fields + [T.StructField(n, T.LongType() if n in measured else T.BooleanType()) for n in names])
    at, columns = rest.columns.index("text"), [rest.columns.index(f.name) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = buffer_of(batch.column(at))
            found: dict[str, list] = {n: [np.zeros(0, np.int64 if n in measured else bool)] for n in names}
            for a, b in slices(offs):
                m = Measures(*cut(buf, offs, a, b))
                for n in measured:
                    found[n].append(m[n].astype(np.int64))
                if measured:
                    found["base_failed"].append(np.logical_or.reduce([r.fails(m) for r in rules if r.base]))
                found["kept"].append(cascade(m, order))
            arrays = [batch.column(i) for i in columns] + [pa.array(np.concatenate(found[n])) for n in names]
            yield pa.RecordBatch.from_arrays(arrays, [*(f.name for f in fields), *names])

    return spread(rest).mapInArrow(run, schema)


def kept_documents(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows that pass all rules, with the columns of docs."""
    return judged(docs, rules).filter("kept").select(*docs.columns)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judged(docs, measured=MEASURED, keep_text=False)


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP4_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
lines AS (
  SELECT doc_id, line, count(*) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
line_counts AS (SELECT doc_id, sum(n) AS n_lines, sum(n - 1) AS n_dup_lines FROM lines GROUP BY ALL),
tokens AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i, len(words) AS n_words FROM d),
strings AS (
  SELECT doc_id, i, n_words, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS s
  FROM tokens),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM strings WHERE i + 7 <= n_words),
covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS pos FROM windows WHERE n > 1) GROUP BY ALL),
m AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters,
    coalesce(n_lines, 0) AS n_lines
  FROM d LEFT JOIN line_counts USING (doc_id) LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 4 * n_symbols > n_words OR 10 * n_upper > 6 * n_letters OR 2 * n_dup_lines > n_lines
    OR word_chars > 20 * n_words OR 2 * word_chars < 3 * n_words) AS kept
FROM b
"""
