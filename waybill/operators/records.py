"""Records of attempts, checks and benchmarks, and their text forms."""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import audit

# Tail of a kept log, mark of a cut one.
TAIL = 4096
CUT_MARK = "\n...[cut at the log limit]"


def attempt_records(log: DataFrame) -> DataFrame:
    """Adds reason code, byte lengths and hashes of both streams to rows (kind, cleanup_pending, timed_out, operator_terminated, returncode, stdout, stderr)."""
    out = log.withColumn("reason_code", audit.attempt_reason(F.col("kind"), F.col("cleanup_pending"), F.col("timed_out"), F.col("operator_terminated"), F.col("returncode")))
    for stream in ("stdout", "stderr"):
        text = F.coalesce(F.col(stream), F.lit(""))
        out = out.withColumn(f"{stream}_bytes", F.octet_length(text).cast("bigint")).withColumn(f"{stream}_sha256", F.sha2(text, 256))
    return out


def execution_records(log: DataFrame, key: str, audits: DataFrame) -> DataFrame:
    """One record for each run: status, counters, and its attempts in order as one JSON text.

    log: numbered attempts (seq, attempt, kind, ...); audits: (key, audit status).
    """
    rows = attempt_records(log)
    shown = F.struct("seq", "attempt", "kind", "reason_code", "stdout_bytes", "stdout_sha256")
    history = rows.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(shown))).alias("history"))
    folded = audit.retry_outcomes(log, key).join(audits, key, "left")
    status = audit.tier_status(F.col("state"), F.col("audit"))
    return folded.withColumn("status", status).withColumn("exit_code", audit.exit_code(status).cast("bigint")).join(history, key)


def result_records(results: DataFrame, limit_seconds: int) -> DataFrame:
    """Seconds, verdict and the end of the error stream of each check run."""
    return results.select(
        "*", (F.col("kind") == "valid").alias("passed"), (F.col("elapsed_ns") / 1_000_000_000).alias("elapsed_seconds"), F.lit(limit_seconds).alias("limit_seconds"),
        F.when(F.length("stderr") > TAIL, F.right("stderr", F.lit(TAIL))).otherwise(F.col("stderr")).alias("stderr_tail"),
    )


def check_report(records: DataFrame, keys: list[str]) -> DataFrame:
    """Whether all runs passed, and the longest one that was timed."""
    return records.groupBy(*keys).agg(F.bool_and("passed").alias("passed"), F.max("elapsed_seconds").alias("elapsed_seconds_max"), F.count("*").alias("n"))


GROUP_MAXIMA = ("cpu_usage_usec", "nr_throttled", "throttled_usec", "memory_peak_bytes", "pids_peak")


def repetition_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """Least, middle and largest elapsed and CPU seconds, largest memory, processes, threads and output, and the largest
    counters of the control group (null if no run has one).  results: keys and ``repetitions``, an array of structs."""
    r = results.select(*keys, F.explode("repetitions").alias("r")).select(*keys, "r.*")
    spread = [a.alias(f"{c}_{n}") for c in ("elapsed_seconds", "cpu_seconds") for n, a in (("min", F.min(c)), ("median", F.percentile(c, F.lit(0.5))), ("max", F.max(c)))]
    return r.groupBy(*keys).agg(*spread, *[F.max(c).alias(f"{c}_max") for c in ("max_rss_bytes", "processes", "threads", "output_bytes")], *[F.max(F.col(f"control_group.{c}")).alias(f"group_{c}_max") for c in GROUP_MAXIMA])


def overall_maxima(results: DataFrame) -> DataFrame:
    """The largest elapsed time, memory and output over all runs of all groups."""
    r = results.select(F.explode("repetitions").alias("r"))
    return r.agg(*[F.max(f"r.{c}").alias(c) for c in ("elapsed_seconds", "max_rss_bytes", "output_bytes")])


def invalid_results(results: DataFrame) -> DataFrame:
    """Measured groups that are not deterministic or change with ids and order; a missing flag counts as false."""
    return results.filter(~(F.coalesce("deterministic", F.lit(False)) & F.coalesce("invariant", F.lit(False))))


def human_bytes(n: Column) -> Column:
    """Mebibytes with two places; null is not measured."""
    return F.when(n.isNull(), "not measured").otherwise(F.concat(F.format_string("%.2f", n / 1048576), F.lit(" MiB")))


def human_limit(n: Column) -> Column:
    """Whole gibibytes as such, else mebibytes."""
    whole = (n >= 1 << 30) & (n % (1 << 30) == 0)
    return F.when(whole, F.concat(F.format_string("%.2f", n / (1 << 30)), F.lit(" GiB"))).otherwise(human_bytes(n))


def container_size(n: Column) -> Column:
    """A size as container tools take it: whole gibibytes, mebibytes, or bytes."""
    return F.when(n % (1 << 30) == 0, F.concat((n / (1 << 30)).cast("bigint"), F.lit("g"))).when(n % (1 << 20) == 0, F.concat((n / (1 << 20)).cast("bigint"), F.lit("m"))).otherwise(n.cast("string"))


def bounded_log(text: Column, most: int, mark: str = CUT_MARK) -> Column:
    """At most ``most`` bytes of UTF-8, never half a character, with a mark at the end of what was cut; all in the JVM."""
    if most < 0:
        raise ValueError("the limit is negative")
    room = most - len(mark.encode())

    def head(n: int) -> Column:
        """The longest run of whole characters within n bytes: cut, then drop the bytes of a half character."""
        if n <= 0:
            return F.lit("")
        raw = F.encode(text, "UTF-8")

        def whole(k: int) -> Column:
            return F.is_valid_utf8(F.substring(raw, 1, k).cast("string"))

        cut = F.lit("")
        for k in range(max(n - 3, 0), n + 1):
            cut = F.when(whole(k), F.substring(raw, 1, k).cast("string")).otherwise(cut)
        return cut

    short = head(most) if room <= 0 else F.concat(head(room), F.lit(mark))
    return F.when(F.octet_length(text) <= most, text).otherwise(short if most else F.lit(""))


def exact_sums(frame: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The sum of doubles of each group, rounded once at the end, whatever the order of the rows.

    A task adds up whole mantissas by binary exponent, which is exact; groups of (key, exponent) are
    added as decimals, and a group's at most 2,100 exponents are put together as one fraction.
    Infinite and missing values are left out.
    """
    held = frame.select(*keys, F.col(value).cast("double").alias("_v"))
    n, schema = len(keys), held.drop("_v").schema.simpleString()[7:-1]
    parts_schema = f"{schema}, _e int, _m decimal(38,0)" if keys else "_e int, _m decimal(38,0)"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(n).fill_null(0.0).to_numpy(zero_copy_only=False)
            v = np.where(np.isfinite(v), v, 0.0)
            mantissa, exponent = np.frexp(v)
            whole = np.ldexp(mantissa, 53).astype(np.int64)
            columns = [batch.column(i) for i in range(n)] + [pa.array(exponent.astype(np.int32) - 53), pa.array(whole).cast(pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "_e", "_m"])

    def rounded(sums: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sums:
            out = []
            for pairs in batch.column(n).to_pylist():
                total = sum((Fraction(int(p["_m"])) * Fraction(2) ** p["_e"] for p in pairs), Fraction(0))
                out.append(float(total))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n)], pa.array(out, pa.float64())], [*keys, "sum"])

    by_exponent = held.mapInArrow(split, parts_schema).groupBy(*keys, "_e").agg(F.sum("_m").cast("decimal(38,0)").alias("_m"))
    grouped = by_exponent.groupBy(*keys).agg(F.collect_list(F.struct("_e", "_m")).alias("_p"))
    return grouped.mapInArrow(rounded, f"{schema}, sum double" if keys else "sum double")


def published(path: str, text: str, mode: int = 0o644) -> None:
    """A small file on the driver, whole or not at all: written beside its place, then renamed."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, held = tempfile.mkstemp(dir=folder, prefix=".publish-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(held, mode)
        os.replace(held, path)
    except BaseException:
        if os.path.exists(held):
            os.unlink(held)
        raise


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    """A few rows as a table; numbers to four places."""

    def cell(x: object) -> str:
        return "" if x is None else f"{x:.4f}" if isinstance(x, float) and math.isfinite(x) else str(x).replace("|", "\\|")

    lines = [columns, ["---"] * len(columns), *[[cell(r.get(c)) for c in columns] for r in rows]]
    return "".join(f"| {' | '.join(line)} |\n" for line in lines)


def published_pair(json_path: str, json_text: str, table_path: str, table_text: str) -> None:
    """A report in both forms; if the second one fails, the first is taken back."""
    before = open(json_path, encoding="utf-8").read() if os.path.exists(json_path) else None
    published(json_path, json_text)
    try:
        published(table_path, table_text)
    except BaseException:
        if before is None:
            os.unlink(json_path)
        else:
            published(json_path, before)
        raise
