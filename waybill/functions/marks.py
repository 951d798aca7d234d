"""Kinds of characters and marks of texts in tasks, a batch at a time: what the patterns of ``text`` count one character
after the other, the spans of tokens, and the matches of phrases; the patterns themselves run only on texts whose matches depend on characters outside ASCII."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANK, LATIN, HANGUL, DIGIT, STOP, SIGN, SYMBOL, SLASH = (1 << i for i in range(8))
BLANKS = frozenset(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_BLANK = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(BLANKS)) + "]"

#: Bytes that are looked at together, unless one text has more.
BYTES_AT_ONCE = 1 << 20


@cache
def kind(point: int) -> int:
    c = chr(point)
    found = (BLANK if c in BLANKS else 0) | (LATIN if c.isascii() and c.isalpha() else 0) | (HANGUL if "가" <= c <= "힣" else 0) | (DIGIT if unicodedata.category(c) == "Nd" else 0)
    found |= (STOP if c in ".!?。！？" else 0) | (SIGN if c in "=+-*/^∑∫√≈≠≤≥<>" else 0) | (SLASH if c == "\\" else 0)
    return found | (SYMBOL if c != "_" and c not in BLANKS and unicodedata.category(c)[0] not in "LN" else 0)


ASCII = np.array([kind(i) if i < 128 else 0 for i in range(256)], np.uint8)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _any_case(phrases: str) -> str:
    """A pattern that holds for all texts in which the phrases stand in any case, with the letters that fold to ASCII ones."""
    return "(?im)" + phrases.replace("i", "[iIİı]").replace("k", "[kKK]").replace("s", "[sSſ]")


#: Patterns without edges of words; a text without a match has none of the pattern of that name in ``text`` either.
PHRASES = {
    "code": _any_case(rf"```|(?:^|{_BLANK})(?:def|class|function|select|from|import|#include)") + f"|[{{}};]{_BLANK}*$",
    "reasoning": _any_case("prove|derive|reason|analyze|explain why|algorithm|complexity|증명|유도|추론|분석|알고리즘|복잡도"),
    "formal": _any_case("prove|derive|theorem|lemma|counterexample|induction|증명|유도|정리|보조정리|반례|귀납"),
    "program": _any_case("```|traceback|exception|complexity|big[- ]?o|시간|공간|예외|스택"),
    "constraint": _any_case("exactly|at least|at most|must|only|without|정확히|이상|이하|반드시|오직|제외하고"),
    "transform": _any_case("summari|rewrite|translate|list|extract|요약|바꾸|번역|나열|추출"),
}


_OTHER = r"[^\x00-\x7f]"
_KEYS = "(?:def|class|function|select|from|import|#include)"


def _with_edges(words: str, others: str, plain: str = "") -> tuple[str, str]:
    """Pattern of the words between edges, and of what it does not decide: words beside a character outside ASCII, where an edge
    is another than RE2's, and other phrases."""
    return rf"(?i){plain}\b(?:{words})\b", rf"(?i){_OTHER}(?:{words})|(?:{words}){_OTHER}|{others}"


#: Patterns that count as those of that name in ``text``, and patterns of the texts for which they don't; a search goes on behind
#: a match as if the text began there, so fences and keys with a key behind them are of the second kind.
EXACT = {
    "code": (rf"(?im)```|(?:^|{_BLANK}){_KEYS}\b|[{{}};]{_BLANK}*$", rf"(?im)(?:^|{_BLANK}){_KEYS}{_OTHER}|(?:```|{_KEYS}){_KEYS}"),
    "reasoning": _with_edges("prove|derive|reason|analyze|explain why|algorithm|complexity", "증명|유도|추론|분석|알고리즘|복잡도"),
    "formal": _with_edges("prove|derive|theorem|lemma|counterexample|induction", "증명|유도|정리|보조정리|반례|귀납"),
    "program": _with_edges("traceback|exception|complexity|big[- ]?o", "시간|공간|예외|스택", "```|"),
    "constraint": _with_edges("exactly|at least|at most|must|only|without", "정확히|이상|이하|반드시|오직|제외하고"),
    "transform": _with_edges("summari[sz]e|rewrite|translate|list|extract", "요약|바꾸|번역|나열|추출"),
}
#: Letters outside ASCII that fold to ASCII ones.
FOLDING = r"[\x{130}\x{131}\x{17f}\x{212a}]"

COUNTS = ("n_words", "n_stops", "n_hangul", "n_signs", "n_digits", "n_blanks", "n_slashes")
#: ``n_<name>``: matches of the pattern of that name, unless the mark ``<name>`` says that they must be counted by the pattern itself.
MARKS = "struct<" + ", ".join([*(f"{n}: bigint" for n in COUNTS), *(f"{n}: boolean" for n in PHRASES), *(f"n_{n}: int" for n in PHRASES)]) + ">"


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts and where each begins and the last ends; null has none."""
    held = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, values = held.buffers()
    at = np.frombuffer(offsets, np.int64)[held.offset : held.offset + len(held) + 1] if len(held) else np.zeros(1, np.int64)
    return np.frombuffer(values, np.uint8) if values else np.zeros(0, np.uint8), at


def blocks(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``BYTES_AT_ONCE``, or of one row."""
    a = 0
    while a < len(at) - 1:
        b = max(a + 1, int(np.searchsorted(at, at[a] + BYTES_AT_ONCE, "right")) - 1)
        yield a, b
        a = b


@cache
def _first_kinds() -> np.ndarray:
    return np.array([kind(i) for i in range(0x3100)], np.uint8)


def kinds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kind of the character that begins at each byte, 0 where none begins; and that of the character to which each byte belongs."""
    out, lead = ASCII[data], np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return out, out
    near = np.append(data, np.zeros(3, np.uint8))
    a, b, c, d = (near[lead + i].astype(np.int64) & (0xFF if i == 0 else 0x3F) for i in range(4))
    point = np.where(a < 0xE0, (a & 0x1F) << 6 | b, np.where(a < 0xF0, (a & 0xF) << 12 | b << 6 | c, (a & 7) << 18 | b << 12 | c << 6 | d))
    own = _first_kinds()[np.minimum(point, 0x30FF)]
    late = np.flatnonzero(point > 0x30FF)
    each, which = np.unique(point[late], return_inverse=True)
    own[late] = np.array([kind(int(p)) for p in each], np.uint8)[which]
    out[lead] = own
    whole = out.copy()
    for i, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
        some = a >= least
        whole[lead[some] + i] = own[some]
    return out, whole


def _changes(sort: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each byte is the first, and the last, of a run of one sort other than 0 within a text."""
    other = np.ones(len(sort) + 1, bool)
    other[1:-1] = sort[1:] != sort[:-1]
    other[at] = True
    some = sort != 0
    return some & other[:-1], some & other[1:]


def counts(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """``COUNTS`` of texts."""
    found, whole = kinds(data)

    def each(places: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(places != 0), at))

    words, _ = _changes(whole & (LATIN | HANGUL) != 0, at)
    return [each(words), *(each(found & k) for k in (STOP, HANGUL, SIGN, DIGIT, BLANK, SLASH))]


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text.tokens`` of texts as spans: bytes in lower case, start, end and text of each token; runs of digits all share one span."""
    found, whole = kinds(data)
    first, last = _changes(whole & (LATIN | HANGUL | DIGIT), at)
    goes_on = np.append(data & 0xC0 == 0x80, False)
    start = np.flatnonzero(first | (found & SYMBOL != 0))
    end = np.flatnonzero(last | (whole & SYMBOL != 0) & ~goes_on[1:]) + 1
    low = LOWER[data]
    # the only symbols with a lower case, circled letters; both forms have three bytes
    for p in start[(data[start] == 0xE2) & (end - start == 3)].tolist():
        c = data[p : p + 3].tobytes().decode()
        if "Ⓐ" <= c <= "Ⓩ":
            low[p : p + 3] = np.frombuffer(c.lower().encode(), np.uint8)
    row = np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(start, at)))
    digits = (found[start] & DIGIT) > 0
    name = np.frombuffer(b"<number>", np.uint8)
    start[digits], end[digits] = len(low), len(low) + len(name)
    return np.concatenate([low, name]), start, end, row


def marked(column: pa.Array) -> pa.StructArray:
    """``MARKS`` of a column of texts, null where the text is."""
    data, at = bytes_of(column)
    parts = [counts(data[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in blocks(at)]
    none = pc.is_null(column).to_numpy(zero_copy_only=False)
    numbers = [pa.array(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64(), mask=none) for i in range(len(COUNTS))]
    folding = pc.match_substring_regex(column, FOLDING)
    some, open_, hits = pc.any(folding).as_py(), [], []
    for name, (pattern, unsure) in EXACT.items():
        mark = pc.match_substring_regex(column, unsure)
        open_.append(pc.if_else(folding, pc.match_substring_regex(column, PHRASES[name]), mark) if some else mark)
        hits.append(pc.count_substring_regex(column, pattern).cast(pa.int32()))
    return pa.StructArray.from_arrays([*numbers, *open_, *hits], [*COUNTS, *EXACT, *(f"n_{n}" for n in EXACT)])
