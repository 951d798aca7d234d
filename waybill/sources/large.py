"""Documents of any size: a reader that splits one JSON document over tasks, and an ordered writer.

Reading.  A document is an object with scalar keys and one array of objects.  Spark's text reader, with
``}`` as the line separator, splits a file at byte ranges into pieces.  A first pass over them tells for each
range how many quotes it has and how deep its brackets go, whether it begins inside a string or not; the
driver carries these few numbers from range to range.  In a second pass every task knows where its range
begins, cuts it behind each element and numbers the parts; only parts at the ends of a range are put together
with those of its neighbours.  What lies outside the elements is the head, an object with an empty array.  So
no row is larger than one element, any number of tasks read one file, and its text is written once and not shuffled.

Writing.  Fragments are range-partitioned by their position and written as compressed parts by the tasks; the
driver streams the parts behind each other, between head and tail, into a file that is renamed when
it is complete.  Fragments and parts go as soon as they are used.  The SHA-256 of a file goes on from byte to byte, so one stream of fixed memory makes it,
behind the parts as they are written or over the file as it is read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.functions import marks

from . import documents
from .shared import dropped, folder, stored, swept, written

_STRING = r'"(?:[^"\\]++|\\.)*+"'
#: An object's start up to its array, if all that stands before it are scalars.
HEAD = rf'(?s)^\s*\{{(?:\s*{_STRING}\s*:\s*(?:{_STRING}|[^\[\{{",\]\}}]++)\s*,)*+\s*{_STRING}\s*:\s*\[\s*(?=\{{)'
#: A range of a file that one task reads.
RANGE = ["path", "start"]


def pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, start, size, text): the file cut behind each ``}``, in its order within a range; a last piece that has none in the file gets one."""
    at = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size")
    return spark.read.option("lineSep", "}").text(path).select(*at, F.concat("value", F.lit("}")).alias("text"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, np.ndarray, np.ndarray]]:
    """Path, start, size, bytes and offsets of pieces of one range that follow each other, a few at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        path, start = batch.column(0), batch.column(1).to_numpy()
        other = pc.not_equal(path.slice(1), path.slice(0, len(path) - 1)).to_numpy(zero_copy_only=False) | (start[1:] != start[:-1])
        data, at = marks.bytes_of(batch.column(3))
        cuts = [0, *(np.flatnonzero(other) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:], strict=False):
            for a, b in marks.blocks(at[low : high + 1]):
                own = at[low + a : low + b + 1]
                yield path[low].as_py(), int(start[low]), batch.column(2)[low].as_py(), data[own[0] : own[-1]], own - own[0]


def _quotes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of the quotes that no backslash escapes."""
    quotes, slashes = np.flatnonzero(data == 34), np.flatnonzero(data == 92)
    if not len(slashes):
        return quotes
    # runs of backslashes within a piece; behind a run of odd length a quote is escaped
    first = np.flatnonzero(np.append(True, (np.diff(slashes) > 1) | np.isin(slashes[1:], at)))
    size = np.diff(np.append(first, len(slashes)))
    behind = (slashes[first] + size)[size % 2 == 1]
    return quotes[~np.isin(quotes, np.setdiff1d(behind, at, assume_unique=True), assume_unique=True)]


def _depths(data: np.ndarray, at: np.ndarray, quotes: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """By how much each piece changes the depth of brackets outside strings, and whether its ``}`` stands outside; within: the first piece begins inside one."""
    places = np.flatnonzero((data == 123) | (data == 91) | (data == 93))
    outside = places[(np.searchsorted(quotes, places) + within) % 2 == 0]
    change = np.bincount(np.searchsorted(at, outside, "right") - 1, np.where(data[outside] == 93, -1, 1), len(at) - 1).astype(np.int64)
    closing = (np.searchsorted(quotes, at[1:] - 1) + within) % 2 == 0
    return change - closing, closing


def _ranges(spark: SparkSession, path: str | list[str]) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """For each range that has pieces whether it begins inside a string, at which depth, and which of its pieces (-1: none) lacks its ``}`` in the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[int]] = {}
        for path_, start, size, data, at in _runs(batches):
            own = held.setdefault((path_, start, size), [0, 0, 0, 0, 0])
            quotes = _quotes(data, at)
            for k in (0, 1):
                own[3 + k] += int(_depths(data, at, quotes, (own[2] + k) % 2 == 1)[0].sum())
            own[0], own[1], own[2] = own[0] + len(at) - 1, own[1] + len(data), own[2] + len(quotes)
        for key, own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([key[0]]), *(pa.array([x], pa.int64()) for x in (*key[1:], *own))], names)

    names = ["path", "start", "size", "n", "bytes", "quotes", "plain", "inner"]
    found = pieces(spark, path).mapInArrow(run, "path string, " + ", ".join(f"{c} bigint" for c in names[1:])).collect()
    total: Counter[str] = Counter()
    for r in found:
        total[r["path"]] += r["bytes"]
    last = {r["path"]: r["start"] for r in sorted(found, key=lambda r: r["start"])}
    out, state = {}, {}
    for r in sorted(found, key=lambda r: (r["path"], r["start"])):
        within, depth = state.get(r["path"], (False, 0))
        open_end = r["start"] == last[r["path"]] and total[r["path"]] > r["size"]
        out[r["path"], r["start"]] = within, depth, r["n"] - 1 if open_end else -1
        state[r["path"]] = (within + r["quotes"]) % 2 == 1, depth + r["inner" if within else "plain"]
    return out


def _parts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, start, k, ended, text): the parts of each range, cut behind the elements that end in it; the last part may go on in the next range."""
    begin, names = _ranges(spark, path), ["path", "start", "k", "ended", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, k, carried = None, 0, []

        def rest() -> Iterator[pa.RecordBatch]:
            if carried:
                yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([k], pa.int64()), pa.array([False]), pa.array([b"".join(carried)]).cast(pa.string())], names)

        for path_, start, _, data, at in _runs(batches):
            if key != (path_, start):
                yield from rest()
                key, k, carried = (path_, start), 0, []
                within, depth, open_piece = begin[key]
                n = 0
            quotes = _quotes(data, at)
            change, closing = _depths(data, at, quotes, within)
            if n <= open_piece < n + len(change):  # the file ends without its bracket
                change[-1] += closing[-1]
                closing[-1], data = False, data[:-1]
            n += len(change)
            after = depth + np.cumsum(change)
            ends = at[1:][closing & (after == 2)]
            within, depth = (within + len(quotes)) % 2 == 1, int(after[-1])
            if not len(ends):
                carried.append(data.tobytes())
                continue
            held = b"".join(carried)
            buffer = held + data[: ends[-1]].tobytes()
            offsets = np.append(0, ends + len(held)).astype(np.int64)
            text = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(buffer)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([path_] * len(ends)), pa.array(np.full(len(ends), start)), pa.array(k + np.arange(len(ends))), pa.array(np.ones(len(ends), bool)), text], names)
            k, carried = k + len(ends), [data[ends[-1] :].tobytes()] if ends[-1] < len(data) else []
        yield from rest()

    return pieces(spark, path).mapInArrow(run, "path string, start bigint, k bigint, ended boolean, text string")


def split(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Heads (path, text) and elements (path, pos, text) of documents; the head of a document of another shape is null."""
    parts = written(_parts(spark, path), "parts")
    begun, first = Counter(), []
    for r in sorted(parts.groupBy(*RANGE).agg(F.count_if("ended").alias("n")).collect(), key=lambda r: (r["path"], r["start"])):
        first.append((r["path"], r["start"], begun[r["path"]]))
        begun[r["path"]] += r["n"]
    numbered = parts.join(F.broadcast(spark.createDataFrame(first, "path string, start bigint, first bigint")), RANGE).withColumn("pos", F.col("first") + F.col("k"))
    edge = (F.col("k") == 0) | ~F.col("ended")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda p: p["text"]), "")
    edges = written(numbered.filter(edge).groupBy("path", "pos").agg(F.max("ended").alias("ended"), joined.alias("text")), "edges")
    head = F.regexp_extract("text", HEAD, 0)
    before = edges.filter("ended AND pos = 0").select("path", head.alias("before"))
    last = edges.filter("NOT ended").select("path", F.col("text").alias("after"), (F.col("pos") > 0).alias("some"))
    both = before.join(last, "path", "full")
    # without elements all of the document stands behind the last one; a document cut within an element has nothing there
    shape = F.when(F.coalesce("some", F.lit(True)), F.when((F.col("before") != "") & F.col("after").rlike(r"^\s*\]"), F.concat("before", "after"))).otherwise(F.col("after"))
    behind = F.regexp_replace("text", r"^\s*,\s*", "")
    own = F.when(F.col("pos") == 0, F.col("text").substr(F.length(head) + 1, F.length("text"))).otherwise(F.when(F.col("text").rlike(r"^\s*,"), behind))
    elements = numbered.filter(~edge).select("path", "pos", "text").unionByName(edges.filter("ended").select("path", "pos", "text"))
    return both.select("path", shape.alias("text")), elements.select("path", "pos", own.alias("text"))


Split = tuple[DataFrame, DataFrame]


def problems(spark: SparkSession, path: str | list[str], kind: str, found: Split | None = None) -> DataFrame:
    """``documents.problems`` for documents of any size; found: what ``split`` gave for the path, if it is at hand."""
    heads, elements = found or split(spark, path)
    parsed = elements.select("path", F.try_parse_json("text").alias("e"), F.json_object_keys("text").isNull().alias("other"))
    # what the rules say of an element is kept, not its text
    each = written(documents.checked(parsed, kind, "other"), "checked")
    counts = each.groupBy("path").agg(F.count("*").alias("n"), F.max(F.col("none") | F.col("other")).alias("broken"))
    held = heads.join(counts, "path", "left").withColumn("v", F.try_parse_json("text")).withColumn("n", F.coalesce("n", F.lit(0)))
    held = written(held.withColumn("v", F.when(~F.coalesce("broken", F.lit(False)), F.col("v"))), "heads")
    # a row for each document goes to the elements, which all stand under one path or a few
    whole = each.join(F.broadcast(held.filter("v IS NOT NULL").select("path")), "path", "left_semi")
    return documents.found_problems(held, whole, kind, F.col("n") > 0)


def episodes(spark: SparkSession, path: str | list[str], found: Split | None = None) -> DataFrame:
    """``documents.episodes`` for documents of any size."""
    heads, elements = found or split(spark, path)
    header = heads.select("path", F.from_json("text", f"struct<{documents.HEADER}>").alias("h")).select("path", "h.*")
    rows = elements.select("path", "pos", F.from_json("text", documents.EPISODE).alias("e"))
    return rows.join(F.broadcast(header), "path").select("path", "schema_version", "challenge_id", "split", "pos", "e.*")


def decisions(spark: SparkSession, path: str | list[str], found: Split | None = None) -> DataFrame:
    """``documents.decisions`` for documents of any size."""
    heads, elements = found or split(spark, path)
    header = heads.select("path", F.from_json("text", "struct<tier: string, policy_id: string>").alias("h")).select("path", "h.*")
    rows = elements.select("path", "pos", F.from_json("text", "struct<episode_id: string, model_id: string>").alias("e"))
    return rows.join(F.broadcast(header), "path").select("tier", "policy_id", "pos", "e.*")


def first_bad_bytes(files: DataFrame) -> DataFrame:
    """(path, offset) of the first byte of each (path, content) that is no UTF-8: stray, overlong, cut and surrogate forms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = []
            for blob in batch.column(1):
                try:
                    str(memoryview(blob.as_buffer()), "utf-8")
                    at.append(None)
                except UnicodeDecodeError as e:
                    at.append(e.start)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int64())], ["path", "offset"])

    # the JVM passes all good files
    doubtful = files.select("path", "content").filter(~F.is_valid_utf8(F.col("content").cast("string")))
    return doubtful.mapInArrow(run, "path string, offset bigint")


def digest(spark: SparkSession, path: str) -> str:
    """The hex SHA-256 of a file of any size; one pass in fixed memory."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    held, total = jvm.org.apache.hadoop.fs.Path(path), jvm.java.security.MessageDigest.getInstance("SHA-256")
    source = jvm.java.security.DigestInputStream(held.getFileSystem(conf).open(held), total)
    try:
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, jvm.java.io.OutputStream.nullOutputStream(), conf, False)
    finally:
        source.close()
    return bytes(total.digest()).hex()


def pinned_problems(spark: SparkSession, files: dict[str, str], registry: DataFrame, found: Split | None = None) -> DataFrame:
    """``selections.pinned_problems`` for files of any size, the path of each split; found: what ``split`` gave for all of them, if it is at hand."""
    heads, elements = found or split(spark, list(files.values()))
    pairs = [(s, _named(spark, p), digest(spark, p)) for s, p in files.items()]
    held = spark.createDataFrame(pairs, "split string, path string, found string")
    counts = elements.groupBy("path").agg(F.count("*").alias("n"))
    header = heads.select("path", F.from_json("text", f"struct<{documents.HEADER}>")["split"].alias("named"))
    return registry_problems(held.join(header, "path", "left").join(counts, "path", "left"), registry)


def registry_problems(held: DataFrame, registry: DataFrame) -> DataFrame:
    """(split, rule) of documents (split, found, named, n) against a registry (split, total_inputs, sha256); named: the split of their header."""
    rules = {"missing": F.col("found").isNotNull(), "sha256": F.col("found") == F.col("sha256"), "split": F.col("named") == F.col("split"), "count": F.col("n") == F.col("total_inputs")}
    return registry.join(held, "split", "left").select("split", F.explode(documents.failed(rules)).alias("rule"))


def _named(spark: SparkSession, path: str) -> str | None:
    """A path as the reader names it; None for an empty file."""
    first = spark.read.option("lineSep", "}").text(path).select("_metadata.file_path").first()
    return first and first[0]


#: Of the parts of a file on their way.
CODEC = "gzip"


def published(rows: DataFrame, path: str, head: str, tail: str) -> str:
    """One file of head, the fragments of rows (pos, json) in the order of pos with commas between them, and tail; returns its SHA-256."""
    spark = rows.sparkSession
    rows, fragments = stored(rows, "fragments")  # they are read three times: for the last one, for the ranges and for the parts
    end = rows.agg(F.max(F.struct("pos", "json")).alias("m")).first()["m"]
    parts = folder(spark, "parts")
    most = F.lit(end["pos"] if end else None)
    rows.filter(F.col("pos") < most).repartitionByRange("pos").sortWithinPartitions("pos").select("json").write.option("lineSep", ",").text(parts, compression=CODEC)
    dropped(spark, fragments)
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    partial = jvm.org.apache.hadoop.fs.Path(path + ".partial")
    held = jvm.org.apache.hadoop.fs.Path(parts)
    source, codecs = held.getFileSystem(conf), jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    names = sorted(f.getPath().toString() for f in source.listStatus(held) if f.getPath().getName().startswith("part-"))
    total = jvm.java.security.MessageDigest.getInstance("SHA-256")
    out = jvm.java.security.DigestOutputStream(fs.create(partial, True), total)
    try:
        out.write(bytearray(head.encode()))
        for name in names:
            own = jvm.org.apache.hadoop.fs.Path(name)
            part = codecs.getCodec(own).createInputStream(source.open(own))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            part.close()
            source.delete(own, False)
        out.write(bytearray(((end["json"] if end else "") + tail).encode()))
    finally:
        out.close()
    if not fs.rename(partial, target):
        fs.delete(target, False)
        fs.rename(partial, target)
    swept(spark)
    return bytes(total.digest()).hex()


def publish_submission(decisions: DataFrame, path: str, header: dict) -> str:
    """The document of ``documents.submission_rows`` for one submission (pos, episode_id, model_id), of any size; header holds all its keys.  Returns its SHA-256."""
    rows = decisions.select("pos", F.to_json(F.struct("episode_id", "model_id")).alias("json"))
    return published(rows, path, documents.compact(header)[:-1] + ',"decisions":[', "]}")


def publish_input(episodes: DataFrame, path: str, header: dict) -> str:
    """The document of ``documents.input_rows`` for one input (pos, episode_id, prompt, messages), of any size.  Returns its SHA-256."""
    rows = episodes.select("pos", F.to_json(F.struct("episode_id", "prompt", "messages")).alias("json"))
    return published(rows, path, documents.compact(header)[:-1] + ',"episodes":[', "]}")
