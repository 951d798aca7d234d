"""Positions in a total order without gathering all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.sources.shared import written

_ROW_BITS = 33


def ranked(frame: DataFrame, keys: Sequence[str], name: str = "rank") -> DataFrame:
    """Adds the position (from 0) by the keys, which should be unique.

    Rows are range-partitioned and sorted; a row's number in its partition and the partitions' sizes,
    one small row each, give its rank.
    """
    held = frame.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    held = written(held, "ranked")
    part, row = F.shiftright("_at", _ROW_BITS), F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    sizes = sorted((r["part"], r["n"]) for r in held.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    offsets = frame.sparkSession.createDataFrame(starts, "_part bigint, _start bigint")
    joined = held.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # a row for each partition
    return joined.withColumn(name, F.col("_start") + row).drop("_at", "_part", "_start")


def running(frame: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Adds running sums (of this row and those before it) within the keys, in an order that should be unique in them.

    A segmented scan: rows are range-partitioned by keys and order, so one key may span any number of
    partitions; each partition is summed by itself, and the sums of its last key are carried on to
    the next partitions as long as the key goes on.  The driver sees one row for each partition.
    """
    spark, names = frame.sparkSession, list(sums)
    key, own = F.struct(*keys), {f"_own_{n}": c for n, c in sums.items()}
    held = frame.withColumns(own).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_part", F.spark_partition_id())
    held = written(held, "scan")
    ends = held.groupBy("_part").agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    at_last = held.join(F.broadcast(ends), "_part").filter(key.eqNullSafe(F.col("_last")))
    found = at_last.groupBy("_part", "_first", "_last").agg(*[F.sum(c).alias(c) for c in own]).collect()
    carried, carry, going = [], dict.fromkeys(own, 0), None
    for r in sorted(found, key=lambda r: r["_part"]):
        before = carry if going == (r["_first"],) else dict.fromkeys(own, 0)
        carried.append((r["_part"], *(before[c] for c in own)))
        alone = r["_first"] == r["_last"]
        carry, going = {c: (r[c] or 0) + (before[c] if alone else 0) for c in own}, (r["_last"],)
    offsets = spark.createDataFrame(carried, "_part int, " + ", ".join(f"{c}_before bigint" for c in own))
    # the first key of a partition is the one that may have begun before it
    offsets = ends.select("_part", "_first").join(F.broadcast(offsets), "_part")
    w = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = held.join(F.broadcast(offsets), "_part")
    new = {n: (F.coalesce(F.sum(f"_own_{n}").over(w), F.lit(0)) + F.when(key.eqNullSafe(F.col("_first")), F.col(f"_own_{n}_before")).otherwise(0)).cast("bigint") for n in names}
    return joined.withColumns(new).drop("_part", "_first", *own, *[f"{c}_before" for c in own])


def medians(frame: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, least, low, high, most) of the values that are not null: ``low`` and ``high`` are the two middle ones, equal if n is odd.

    Exact for groups of any size: values are numbered in their order by a scan over range partitions, so no task
    holds a group.
    """
    keys = list(keys) or ["_all"]
    frame = frame.withColumn("_all", F.lit(0)) if keys == ["_all"] else frame
    held = frame.select(*keys, F.col(value).alias("_value")).filter("_value IS NOT NULL").groupBy(*keys, "_value").agg(F.count("*").alias("_times"))
    placed = running(held, keys, ["_value"], {"_upto": F.col("_times")})
    total = held.groupBy(*keys).agg(F.sum("_times").alias("n"), F.min("_value").alias("least"), F.max("_value").alias("most"))
    renamed = placed.select(*[F.col(k).alias(f"_{k}") for k in keys], "_value", "_upto", "_times")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = total.join(renamed, same)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_times") <= place) & (place < F.col("_upto")), F.col("_value")))

    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    return joined.groupBy(*keys, "n", "least", "most").agg(at(low).alias("low"), at(high).alias("high")).select(*(k for k in keys if k != "_all"), "n", "least", "low", "high", "most")
