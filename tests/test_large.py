"""Documents split over tasks and written in parts, against the readers and writers of whole documents."""

from __future__ import annotations

import hashlib
import json
import random
import uuid
from collections import Counter

import pytest

from waybill.plans import inputs
from waybill.sources import documents, large, selections, shared

HEADER = {"schema_version": 1, "challenge_id": "c", "split": "train"}


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def big_input(n=1500):
    r = random.Random(3)
    bits = ["plain ", "{", "}", "[", "]", '"', "\\", "\\\\", "\n", "é", "日本", "😀", ",", '"}', "}{", "\\\"", ":", "]}", '{"a":1}', "x" * 200]
    text = lambda: "".join(r.choice(bits) for _ in range(r.randint(1, 12)))
    rows = []
    for i in range(n):
        e = {"episode_id": f"e{i}{text() if i % 7 == 0 else ''}"[:100]}
        if i % 3:
            e["prompt"] = text()
        else:
            e["messages"] = [{"role": "user", "content": text()} for _ in range(1 + i % 4)]
        rows.append(e)
    return {**HEADER, "episodes": rows}


def test_one_document_read_by_many_tasks(spark, tmp_path, small_splits):
    d = big_input()
    tail_first = {"schema_version": 1, "episodes": d["episodes"][:40], "challenge_id": 'a [ "{" ] b', "split": "s]}"}
    texts = {"compact": json.dumps(d, ensure_ascii=False, separators=(",", ":")), "spaced": json.dumps(d, indent=3) + "\n \n", "middle": json.dumps(tail_first, ensure_ascii=True, indent=1)}
    for name, t in texts.items():
        (tmp_path / f"{name}.json").write_text(t)
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 20
    whole = documents.episodes(documents.documents(spark, str(tmp_path)))
    got = large.episodes(spark, str(tmp_path))
    assert Counter(map(str, got.drop("path").collect())) == Counter(map(str, whole.drop("path").collect()))
    assert got.count() == 3040 and large.problems(spark, str(tmp_path), "input").count() == 0


@pytest.mark.parametrize(("kind", "cases"), [("input", inputs.INPUTS), ("outcomes", inputs.OUTCOMES), ("submission", inputs.SUBMISSIONS)])
def test_problems_of_split_documents(spark, tmp_path, kind, cases):
    more = [('{"schema_version":1', None), ("", None), ("[1,2]", None), ('{"schema_version":1,"challenge_id":"c","split":"s","episodes":[{"episode_id":"a","prompt":"p"} {"episode_id":"b","prompt":"p"}]}', None), ("nothing", None)]
    for i, (text, _) in enumerate([*cases, *more]):
        (tmp_path / f"{i:03}.json").write_text(text.replace("§", "x"))
    whole = Counter((r["path"].rsplit("/", 1)[-1], r["rule"]) for r in documents.problems(documents.documents(spark, str(tmp_path)), kind).collect())
    got = Counter((r["path"].rsplit("/", 1)[-1], r["rule"]) for r in large.problems(spark, str(tmp_path), kind).collect())
    known = {f"{i:03}.json" for i in range(len(cases))}
    assert {x for x in got if x[0] in known} == {x for x in whole if x[0] in known}
    assert {x[0] for x in whole} - {"%03d.json" % (len(cases) + 1)} <= {x[0] for x in got}  # all other broken documents are named, by some rule; an empty file has no pieces


def test_documents_written_in_parts(spark, tmp_path, small_splits):
    d = big_input(400)
    rows = [(i, e["episode_id"], e.get("prompt"), e.get("messages")) for i, e in enumerate(d["episodes"])]
    random.Random(1).shuffle(rows)
    e = spark.createDataFrame(rows, "pos bigint, episode_id string, prompt string, messages array<struct<role:string,content:string>>").repartition(6)
    large.publish_input(e, str(tmp_path / "a.json"), HEADER)
    one = documents.input_rows(e.withColumn("k", e.pos * 0), ["k"], HEADER).first()["json"]
    assert (tmp_path / "a.json").read_text() == one and not (tmp_path / "a.json.partial").exists()
    decided = e.selectExpr("pos", "episode_id", "if(pos % 2 = 0, 'light', 'think') AS model_id", "'fast' AS tier")
    head = {"schema_version": 1, "challenge_id": "c", "policy_id": "p", "split": "s"}
    for frame in (decided, decided.limit(0), decided.filter("pos = 3")):
        large.publish_submission(frame, str(tmp_path / "b.json"), {**head, "tier": "fast"})
        held = documents.submission_rows(frame, ["tier"], head).first()
        want = held["json"] if held else json.dumps({**head, "tier": "fast", "decisions": []}, separators=(",", ":"))
        assert (tmp_path / "b.json").read_text() == want
    large.publish_submission(decided, str(tmp_path / "b.json"), {**head, "tier": "fast"})
    back = large.decisions(spark, str(tmp_path / "b.json"))
    assert {(r["pos"], r["episode_id"], r["model_id"]) for r in back.collect()} == {(r["pos"], r["episode_id"], r["model_id"]) for r in decided.collect()}


def test_bytes_that_are_no_utf8(spark, tmp_path):
    bad = {"good": b'{"a":"\xc3\xa9"}', "stray": b'{"a":"\x80"}', "overlong": b"ab\xc0\xaf", "surrogate": b"\xed\xa0\x80", "cut": b"caf\xc3", "above": b"x\xf4\x90\x80\x80", "late": b"a" * 100_000 + b"\xff"}
    for name, b in bad.items():
        (tmp_path / name).write_bytes(b)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r["path"].rsplit("/", 1)[-1]: r["offset"] for r in large.first_bad_bytes(files).collect()}
    assert got == {"stray": 6, "overlong": 2, "surrogate": 0, "cut": 3, "above": 1, "late": 100_000}
    rules = {(r["path"].rsplit("/", 1)[-1], r["rule"]) for r in documents.problems(documents.documents(spark, str(tmp_path)), "input").collect()}
    assert {x for x in rules if x[1] == "utf8"} == {(n, "utf8") for n in bad if n != "good"}


def test_pinned_files_without_a_row_that_holds_a_file(spark, tmp_path, small_splits):
    """The rules of ``selections.pinned_problems`` over files of which no row and no task holds one; elements stay where they are."""
    rows, digests = {}, {}
    for name, n in (("train", 700), ("dev", 300)):
        d = {**big_input(n), "split": name if name == "train" else "other"}
        e = spark.createDataFrame([(i, x["episode_id"], x.get("prompt"), x.get("messages")) for i, x in enumerate(d["episodes"])], "pos bigint, episode_id string, prompt string, messages array<struct<role:string,content:string>>")
        digests[name] = large.publish_input(e, str(tmp_path / f"{name}.json"), {**HEADER, "split": d["split"]})
        rows[name] = (tmp_path / f"{name}.json").read_text()
    assert {n: hashlib.sha256(t.encode()).hexdigest() for n, t in rows.items()} == digests == {n: large.digest(spark, str(tmp_path / f"{n}.json")) for n in rows}
    registry = spark.createDataFrame([("train", 700, digests["train"]), ("train", 701, "0" * 64), ("dev", 300, digests["dev"]), ("gone", 1, "0" * 64)], "split string, total_inputs bigint, sha256 string")
    want = selections.pinned_problems(spark.createDataFrame(list(rows.items()), "split string, text string"), registry)
    found = large.split(spark, str(tmp_path))
    got = large.pinned_problems(spark, {n: str(tmp_path / f"{n}.json") for n in rows}, registry, found)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())) and got.count() == 7
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:  # a large document's elements are not dealt by its path, which would send all of them to one task
        plan = large.episodes(spark, str(tmp_path), found)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "BroadcastHashJoin" in plan


@pytest.mark.parametrize("name", ["input_source", "whole_input"])
def test_sources_of_odd_documents_equal_their_sql(spark, tmp_path, name):
    """No text, an empty one, texts that look like marks, and ids with gaps or below 0."""
    import duckdb

    texts = [None, "", "=", "-", "=x", " ", '{"a":"}', "plain"]
    rows = [(i, texts[i % len(texts)]) for i in (*range(-9, 130), *range(507, 560, 3), 1_000_003)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        found = db.execute(inputs.SQL[name])
        names, want = [c[0] for c in found.description], Counter(found.fetchall())
    got = inputs.QUERIES[name](spark, str(tmp_path))
    assert Counter(map(tuple, got.select(*names).collect())) == want


def test_disk_that_a_large_document_takes(spark, tmp_path, monkeypatch):
    """Beside the file its elements are written once; what was written on the way is gone, and no text is shuffled."""
    for module in (shared, large):
        monkeypatch.setattr(module, "folder", lambda s, name: str(tmp_path / "shared" / uuid.uuid4().hex / name))
    r = random.Random(5)
    rows = [(i, f"e{i}", "%x" % r.getrandbits(16_000), None) for i in range(600)]
    e = spark.createDataFrame(rows, "pos bigint, episode_id string, prompt string, messages array<struct<role:string,content:string>>")
    used = lambda: sum(p.stat().st_size for p in (tmp_path / "shared").rglob("*") if p.is_file())
    path = str(tmp_path / "a.json")
    large.publish_input(e, path, HEADER)
    size = (tmp_path / "a.json").stat().st_size
    assert used() < size / 4
    found = large.split(spark, path)
    assert large.problems(spark, path, "input", found).count() == 0 and large.episodes(spark, path, found).count() == 600
    assert used() < 1.5 * size
