"""A deterministic sample generator: seeds by name, bounded lengths, no repeated question.

Modules are called round robin.  A sample's seed comes from the regime, the module, its number and the
number of tries so far; a draw that is too long is drawn again from the same seed, and a sample whose
question an earlier sample has is generated anew with the next try.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waybill.functions.hashing import generation_seed
from waybill.sources.documents import flattened
from waybill.sources.shared import written

# Longest question and answer, most draws for one seed, most tries for one sample.
MOST_QUESTION, MOST_ANSWER, MOST_DRAWS, MOST_TRIES = 160, 30, 1000, 100

#: Makes (question, answer) from a seeded source of random numbers.
Module = Callable[[random.Random], tuple[str, str]]


def bounded(module: Module, seed: int) -> tuple[str, str]:
    """The first draw that is short enough and fits a line of tab-separated values."""
    r = random.Random(seed)
    for _ in range(MOST_DRAWS):
        question, answer = module(r)
        if not question or not answer or any(c in question + answer for c in "\t\n\r"):
            raise ValueError("a question or answer is empty or holds a delimiter")
        if len(question) <= MOST_QUESTION and len(answer) <= MOST_ANSWER:
            return question, answer
    raise RuntimeError(f"no short sample in {MOST_DRAWS} draws")


def drawn(rows: DataFrame, regime: str, modules: dict[str, Module]) -> DataFrame:
    """question and answer of rows (pos, try); the generators run in the tasks."""
    names = sorted(modules)
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("pos") % len(names) + 1).cast("int"))
    keyed = rows.select("pos", "try", name.alias("module"), F.floor(F.col("pos") / len(names)).alias("number"))
    keyed = keyed.withColumn("seed", generation_seed(F.lit(regime), F.col("module"), F.col("number"), F.col("try")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [bounded(modules[m], s) for m, s in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            columns = [batch.column(i) for i in range(5)] + [pa.array([m[i] for m in made], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["pos", "try", "module", "number", "seed", "problem", "answer"])

    return keyed.mapInArrow(run, "pos bigint, try bigint, module string, number bigint, seed bigint, problem string, answer string")


def samples(spark: SparkSession, regime: str, modules: dict, n: int = 900) -> DataFrame:
    """(pos, sample_id, problem, answer) of n samples of a tree of modules.

    Samples are drawn in rounds.  A sample keeps its question while no earlier one has it at its current
    try; the others move to their next try.  A question once taken stays with that sample or an earlier
    one, so the outcome is that of drawing one after another.
    """
    leaves = flattened(modules)
    if not leaves:
        raise ValueError("there are no modules")
    held = written(drawn(spark.range(n).select(F.col("id").alias("pos"), F.lit(0).cast("bigint").alias("try")), regime, leaves), "samples")
    for _ in range(MOST_TRIES + 1):
        first = Window.partitionBy("problem").orderBy("pos")
        marked = held.withColumn("_late", F.row_number().over(first) > 1)
        again = marked.filter("_late").select("pos", (F.col("try") + 1).alias("try"))
        if again.isEmpty():
            hexed = F.lpad(F.lower(F.hex("seed")), 8, "0")
            return held.select("pos", F.concat_ws(":", F.lit(regime), "module", F.col("number").cast("string"), hexed).alias("sample_id"), "problem", "answer")
        held = written(marked.filter("NOT _late").drop("_late").unionByName(drawn(again, regime, leaves)), "samples")
    raise RuntimeError(f"questions still repeat after {MOST_TRIES} tries")


def demo_modules(most: int = 20) -> dict:
    """Small arithmetic modules with numbers up to ``most`` and above, for tests and the query; real ones are any functions of a random source."""

    def two(sign: str, least: int, most: int) -> Module:
        def make(r: random.Random) -> tuple[str, str]:
            a, b = r.randint(least, most), r.randint(least, most)
            return f"What is {a} {sign} {b}?", str(a + b if sign == "+" else a * b if sign == "*" else a - b)

        return make

    def long(r: random.Random) -> tuple[str, str]:
        terms = [r.randint(1, 999) for _ in range(r.randint(2, 60))]
        return f"Add {', '.join(map(str, terms))}.", str(sum(terms))

    sums = {"add": two("+", 1, most), "sub": two("-", 1, most), "add_large": two("+", 1000, 99999)}
    return {"arithmetic": {**sums, "product": {"small": two("*", 2, 2 * most), "large": two("*", 100, 999)}}, "lists": {"sum": long}, "mixed": two("+", -50 * most // 20, 50 * most // 20)}
