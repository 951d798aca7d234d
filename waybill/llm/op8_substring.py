"""Substring dedup by super-k-mers of words.

A window is 35 consecutive words.  Windows sharing a minimiser (the least hash of their 8-word
grams) travel as one packed string to the minimiser's bucket, where sorting the windows counts them
exactly; every word covered by a window that also starts elsewhere is removed, in all copies.

Null or empty text has no words and stays empty; texts shorter than a window lose nothing; rows equal
in id and text are separate rows and count as each other's copies; an empty table gives no rows;
extra columns are not carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .kernel import gather, joined_words, span_hash, window_hash, window_rows, word_spans
from .repeats import HOT, Units, covered, flagged_runs, without_repeats

WINDOW, GRAM = 35, 8


def word_units(buf: np.ndarray, offs: np.ndarray, gram: int = GRAM) -> Units:
    data, starts, ends, owners = joined_words(buf, offs)
    return Units(data, starts, ends, owners, window_hash(span_hash(data, starts, ends), gram))


def repeated_windows(window: int):
    """Resolver: sorts the windows of the strings and finds those that occur in two or more."""

    def resolve(buf: np.ndarray, offs: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, owners = word_spans(buf, offs)
        base = np.searchsorted(owners, np.arange(len(offs) - 1))
        at = np.flatnonzero(window_rows(owners, window))
        key = window_hash(span_hash(buf, starts, ends), window)[at]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        # equal sort keys are told apart by windows of independent word hashes, so a chance collision counts nothing
        close = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
        flags = np.zeros(max(len(owners) - window + 1, 0), bool)
        if len(close):
            pair = np.stack([key[close], window_hash(span_hash(buf, starts, ends, 1), window)[at[close]]], 1)
            _, which, n = np.unique(pair, axis=0, return_inverse=True, return_counts=True)
            flags[at[close[n[which.ravel()] > 1]]] = True
        return flagged_runs(flags, owners, base, window)

    return resolve


def count_words(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.bincount(word_spans(buf, offs)[2], minlength=len(offs) - 1)


NAMES = ["n_words", "n_removed", "kept_sha256", "kept_text"]
SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def remover(with_text: bool):
    def remove(buf: np.ndarray, offs: np.ndarray, text: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[pa.Array]:
        data, starts, ends, owners = joined_words(buf, offs)
        n = len(offs) - 1
        n_words = np.bincount(owners, minlength=n)
        gone = covered(len(owners), np.cumsum(n_words) - n_words, text, a, b)
        kept = np.flatnonzero(~gone)
        size = ends[kept] - starts[kept] + 1
        out = gather(data, starts[kept], size)
        per = np.bincount(owners[kept], weights=size, minlength=n).astype(np.int64)
        at = np.append(0, np.cumsum(per)).tolist()
        raw = out.tobytes()
        texts = [raw[x : y - 1] if y > x else b"" for x, y in zip(at, at[1:], strict=False)]
        columns = [pa.array(n_words), pa.array(n_words - np.bincount(owners[kept], minlength=n)), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
        return columns + ([pa.array(texts, pa.binary()).cast(pa.string())] if with_text else [])

    return remove


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """n_words, n_removed and the hash of the kept words (and, if asked, their text) for each row."""
    return without_repeats(
        docs, lambda b, o: word_units(b, o, gram), window, gram, repeated_windows(window), count_words, remover(with_text),
        NAMES[: 3 + with_text], SCHEMA + ", kept_text string" * with_text, hot=hot,
    )


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of repeated 35-word windows."""
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
tokens AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i, len(words) AS n_words FROM d),
strings AS (
  SELECT doc_id, i, n_words, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) AS s
  FROM tokens),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM strings WHERE i + 34 <= n_words),
marked AS (
  SELECT t.doc_id, t.i, word,
    coalesce(max(CASE WHEN n > 1 THEN t.i END) OVER (PARTITION BY t.doc_id ORDER BY t.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) > 0 AS gone
  FROM tokens t LEFT JOIN windows w USING (doc_id, i)),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS text FROM marked GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
