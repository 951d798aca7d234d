"""Text features of prompts: characters are counted in batches (see ``marks``), patterns run in the JVM on the texts that batches leave open."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import marks

_W = r"\p{L}\p{N}_"
_EDGE = f"(?:(?<![{_W}])(?=[{_W}])|(?<=[{_W}])(?![{_W}]))"
_BLANK = r"[\s\x1c-\x1f]"

# Marker patterns, in Java's dialect with explicit word edges.
CODE = rf"(?imdU)```|(?:^|{_BLANK})(?:def|class|function|SELECT|FROM|import|#include){_EDGE}|[{{}};]{_BLANK}*$"
MATHS = rf"(?dU)[=+\-*/^∑∫√≈≠≤≥<>]|\\(?:frac|sum|int|sqrt){_EDGE}"
DIGIT = r"\p{Nd}"
WORD = "[A-Za-z가-힣]+"
SENTENCE_END = "[.!?。！？]"
HANGUL = "[가-힣]"
REASONING = rf"(?idU){_EDGE}(?:prove|derive|reason|analyze|explain why|algorithm|complexity|증명|유도|추론|분석|알고리즘|복잡도){_EDGE}"
FORMAL = rf"(?idU){_EDGE}(?:prove|derive|theorem|lemma|counterexample|induction|증명|유도|정리|보조정리|반례|귀납){_EDGE}"
PROGRAM = rf"(?idU)```|{_EDGE}(?:traceback|exception|complexity|big[- ]?o|시간{_BLANK}*복잡도|공간{_BLANK}*복잡도|예외|스택{_BLANK}*추적){_EDGE}"
CONSTRAINT = rf"(?idU){_EDGE}(?:exactly|at least|at most|must|only|without|정확히|이상|이하|반드시|오직|제외하고){_EDGE}"
TRANSFORM = rf"(?idU){_EDGE}(?:summari[sz]e|rewrite|translate|list|extract|요약|바꾸|번역|나열|추출){_EDGE}"
TOKEN = rf"(?U)[A-Za-z]+|[가-힣]+|\p{{Nd}}+|[^{_W}\s\x1c-\x1f]"
COMMAND = rf"(?dU)\\(?:frac|sum|int|sqrt){_EDGE}"
LONG_CONTEXT = 8000

FEATURES = ("n_chars", "n_messages", "n_words", "n_sentences", "hangul_ratio", "n_code", "n_maths", "numeric_density", "long_context", "n_reasoning")


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def has(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(pattern))


def nonspace(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", ""))


def episode_text(prompt: Column, messages: Column) -> Column:
    """The prompt, or the contents of the messages, a line each."""
    return F.coalesce(prompt, F.array_join(F.transform(messages, lambda m: m["content"]), "\n"))


def with_marks(episodes: DataFrame) -> DataFrame:
    """Adds ``_marks``, the counts and marks of ``text``; one pass over each text for all of them."""
    names = episodes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, marks.marked(batch.column(names.index("text")))], [*names, "_marks"])

    return episodes.mapInArrow(run, T.StructType([*episodes.schema.fields, T.StructField("_marks", T.StructType.fromDDL(f"m {marks.MARKS}")["m"].dataType)]))


def count_where(name: str, pattern: str) -> Column:
    """Matches of a pattern, which is tried only on texts with the mark; the others have been counted."""
    return F.when(~F.col("_marks")[name], F.col("_marks")[f"n_{name}"]).otherwise(count(F.col("text"), pattern))


def has_where(name: str, pattern: str) -> Column:
    return F.when(~F.col("_marks")[name], F.col("_marks")[f"n_{name}"] > 0).otherwise(has(F.col("text"), pattern))


def with_features(episodes: DataFrame) -> DataFrame:
    """Adds ``FEATURES`` to rows with ``text`` and ``n_messages`` (1 if the column is missing), and ``_marks``, by which ``priority`` and others skip patterns."""
    text, m = F.col("text"), F.col("_marks")
    if "n_messages" not in episodes.columns:
        episodes = episodes.withColumn("n_messages", F.lit(1))
    solid = F.greatest(F.lit(1), F.col("n_chars") - m["n_blanks"])
    return (
        with_marks(episodes)
        .withColumn("n_chars", F.length(text))
        .withColumn("n_words", m["n_words"].cast("int"))
        .withColumn("n_sentences", F.greatest(F.lit(1), m["n_stops"]).cast("int"))
        .withColumn("hangul_ratio", m["n_hangul"] / solid)
        .withColumn("n_code", count_where("code", CODE))
        .withColumn("n_maths", (m["n_signs"] + F.when(m["n_slashes"] == 0, 0).otherwise(count(text, COMMAND))).cast("int"))
        .withColumn("numeric_density", m["n_digits"] / solid)
        .withColumn("long_context", F.col("n_chars") >= LONG_CONTEXT)
        .withColumn("n_reasoning", count_where("reasoning", REASONING))
    )


def complexity() -> Column:
    """Coarse difficulty from the feature columns."""
    one, two = F.lit(1), F.lit(2)

    def points(condition: Column, n: Column) -> Column:
        return F.when(condition, n).otherwise(0)

    maths = F.when((F.col("n_maths") >= 2) | (F.col("numeric_density") >= 0.08), two).when(F.col("n_maths") >= 1, one).otherwise(0)
    return (
        points(F.col("n_chars") >= 500, one) + points(F.col("n_chars") >= 2000, one) + points(F.col("long_context"), two)
        + points(F.col("n_messages") >= 3, one) + points(F.col("n_code") > 0, two) + maths
        + points(F.col("n_reasoning") > 0, one) + points((F.col("n_words") >= 350) | (F.col("n_sentences") >= 20), one)
    )


def priority() -> Column:
    """Difficulty for the budgeted router, from the feature columns and the text."""
    rising = (
        complexity() + F.when(has_where("formal", FORMAL), 2).otherwise(0) + F.when(has_where("program", PROGRAM), 2).otherwise(0)
        + F.when(count_where("constraint", CONSTRAINT) >= 2, 1).otherwise(0)
    )
    easy = (F.col("n_chars") < 500) & (rising <= 2) & has_where("transform", TRANSFORM)
    return F.greatest(F.lit(0), rising - F.when(easy, 1).otherwise(0))


def tokens(text: Column) -> Column:
    """Case-folded tokens; runs of digits become ``<number>``."""
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.transform(found, lambda t: F.when(F.regexp_like(t, F.lit(r"\A\p{Nd}+\z")), F.lit("<number>")).otherwise(F.lower(t)))


def hashed_terms(tokens: Column) -> Column:
    """Unigrams, then bigrams of adjacent tokens, as tagged strings."""
    n = F.size(tokens)
    left, right = F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(n - 1, F.lit(0)))
    pairs = F.zip_with(left, right, lambda a, b: F.concat(F.lit("w2:"), a, F.lit("\x1f"), b))
    return F.concat(F.transform(tokens, lambda t: F.concat(F.lit("w1:"), t)), pairs)
