"""Costs of a batch as a step function of the penalty, for any number of budgets at once.

A row's choice under a penalty is the cheapest model that no costlier one beats.  Each row turns into
a few steps (penalty, change of the sums); equal penalties are added up, the steps are sorted by range
partitions, and running sums give the batch's totals at every step.  A budget's penalty is the first
step whose total cost fits.  Everything stays in the JVM; sums are decimals, so their order does not matter.
They have twelve places, or as many more or fewer as the batch's number of rows and largest value ask for
(``sum_type``), so neither very large nor very small values overflow or vanish.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Sequence
from decimal import ROUND_FLOOR, Decimal, localcontext

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.sources.shared import written

SUM = "decimal(38,12)"
FOREVER = float("inf")
#: Digits of decimals on the driver.
DIGITS = 80
#: Steps of a block, among which a budget's first fitting step is sought.
BLOCK = 1024


def exact(c: Column, kind: str = SUM) -> Column:
    return c.cast(kind)


def sum_type(frame: DataFrame, values: Sequence[Column]) -> str:
    """The decimal type in which sums of the values over the frame neither overflow nor lose the larger values' digits."""
    row = frame.agg(F.count("*").alias("n"), F.max(F.greatest(F.lit(0.0), *[F.abs(v.cast("double")) for v in values])).alias("most")).first()
    # steps enter and leave, and sums of partitions are added to offsets: a factor of ten each
    size = math.log10(max(row["n"], 1)) + math.log10(row["most"] or 1.0) + 2
    return SUM if -4 <= size <= 25 else f"decimal(38,{min(37, max(0, 37 - math.ceil(size)))})"


def places(kind: str) -> int:
    return int(kind.rstrip(")").split(",")[1])


def thresholds(models: Sequence[str], light: float) -> list[Column]:
    """For each model the least penalty from which on no costlier model beats it."""

    def beaten(i: int, j: int) -> Column:
        gain, more = F.col(f"score_{models[j]}") - F.col(f"score_{models[i]}"), F.col(f"cost_{models[j]}") - F.col(f"cost_{models[i]}")
        return F.when(more > 0, gain * F.lit(float(light)) / more).when(gain > 0, F.lit(FOREVER)).otherwise(0.0)

    out = []
    for i in range(len(models) - 1):
        all_ = [F.lit(0.0), *(beaten(i, j) for j in range(i + 1, len(models)))]
        out.append(F.greatest(*all_))
    return [*out, F.lit(0.0)]


def choice(models: Sequence[str], light: float, penalty: float) -> Column:
    """The model of each row under a penalty; costs must grow from model to model."""
    out = F.lit(models[-1])
    for m, at in reversed(list(zip(models, thresholds(models, light), strict=True))[:-1]):
        out = F.when(at <= F.lit(float(penalty)), F.lit(m)).otherwise(out)
    return out


def chosen_steps(predictions: DataFrame, models: Sequence[str], light: float, sums: dict[str, Sequence[Column]], kind: str = SUM) -> DataFrame:
    """(at, sums...): what enters and leaves the sums of the batch at which penalty; ``sums``: a value for each model."""
    names = [f"_at{i}" for i in range(len(models))]
    held = predictions.withColumns(dict(zip(names, thresholds(models, light), strict=True)))
    at, entries = [F.col(n) for n in names], []
    for i in range(len(models)):
        until = F.least(F.lit(FOREVER), F.lit(FOREVER), *at[:i])
        used = at[i] < until
        values = {k: exact(v[i], kind) for k, v in sums.items()}
        entries.append(F.when(used, F.struct(at[i].alias("at"), *[v.alias(k) for k, v in values.items()])))
        entries.append(F.when(used & (until < FOREVER), F.struct(until.alias("at"), *[exact(-v, kind).alias(k) for k, v in values.items()])))
    return held.select(F.inline(F.array_compact(F.array(*entries))))


class Curve:
    """Totals of the batch at every penalty where they change."""

    def __init__(self, steps: DataFrame, names: Sequence[str], kind: str = SUM):
        spark = steps.sparkSession
        self.names, self.kind = list(names), kind
        merged = steps.groupBy("at").agg(*[F.sum(n).cast(kind).alias(n) for n in names])
        held = merged.repartitionByRange("at").sortWithinPartitions("at").withColumn("part", F.spark_partition_id())
        held = written(held, "steps")
        parts = held.groupBy("part").agg(F.min("at").alias("at"), *[F.sum(n).cast(kind).alias(n) for n in names]).collect()
        parts = sorted(parts, key=lambda r: r["at"])
        before, rows = dict.fromkeys(names, Decimal(0)), []
        with localcontext(prec=DIGITS):
            for r in parts:
                rows.append((r["part"], *(before[n] for n in names)))
                before = {n: before[n] + r[n] for n in names}
        offsets = spark.createDataFrame(rows, "part int, " + ", ".join(f"_{n} {kind}" for n in names))
        w = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        run = held.join(F.broadcast(offsets), "part")
        block = F.floor((F.row_number().over(Window.partitionBy("part").orderBy("at")) - 1) / BLOCK)
        self.totals = written(run.select("part", block.alias("block"), "at", *[(F.sum(n).over(w) + F.col(f"_{n}")).cast(kind).alias(n) for n in names]), "totals")
        self.parts = [r["part"] for r in parts]
        #: Totals after the last step of every partition.
        self.after = [{n: rows[i + 1][j + 1] for j, n in enumerate(names)} for i in range(len(rows) - 1)] + ([before] if rows else [])

    def first_fitting(self, caps: dict[str, Decimal], name: str = "cost") -> dict[str, dict]:
        """For each cap the first step (at, totals) whose falling total of ``name`` is within it; none if there is none."""
        spark = self.totals.sparkSession
        falling = [-a[name] for a in self.after]
        with localcontext(prec=DIGITS):
            caps = {k: min(c, Decimal(10) ** (38 - places(self.kind)) - 1).quantize(Decimal(1).scaleb(-places(self.kind)), ROUND_FLOOR) for k, c in caps.items()}
        wanted = [(k, self.parts[i], cap) for k, cap in caps.items() if (i := bisect_left(falling, -cap)) < len(falling)]
        if not wanted:
            return {}
        limits = F.broadcast(spark.createDataFrame(wanted, f"cap string, part int, most {self.kind}"))
        # the first block with a step that fits, then the steps of that block alone: every cap meets few of its part's steps
        least = self.totals.groupBy("part", "block").agg(F.min(name).alias("least"))
        blocks = least.join(limits, "part").filter(F.col("least") <= F.col("most")).groupBy("cap", "part", "most").agg(F.min("block").alias("block"))
        first = F.min_by(F.struct("at", *self.names), "at")
        found = self.totals.join(F.broadcast(blocks), ["part", "block"]).filter(F.col(name) <= F.col("most")).groupBy("cap").agg(first.alias("s")).collect()
        return {r["cap"]: r["s"].asDict() for r in found}
