"""Resampling, SimHash, fill-in-middle and components against brute force on small fixtures."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from test_operators import corpus

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lowered(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def rows():
    odd = ["a<P>b c", "x < y <S", "<S", "P>", "ééé ñ", "A1B2", "\x00 zero \x1f", "日本語 text, 10 km", "a" * 20000, "ab-" * 9000, "é" * 7000 + "z", "<" * 50, "Ab aB"]
    return [*corpus(), *((500 + i, t) for i, t in enumerate(odd))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "en", "clash", 1) for r in rows], "doc_id bigint, text string, form string, _key string, n_units int").repartition(5).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def as_rows(frame, *names):
    return Counter(tuple(r[n] for n in names) for r in frame.collect())


# fill-in-middle


def cut_by_hand(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, middle, tail = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", text, None, None
    if h4 % 100 < 20:
        return n, "spm", f"<S>{tail}<P>{head}<M>{middle}", len(head), len(middle)
    return n, "psm", f"<P>{head}<S>{tail}<M>{middle}", len(head), len(middle)


def test_fill_in_middle(docs, rows, empty):
    from waybill.llm.op13_fim import fill_in_middle, restored

    want = Counter((i, t, *cut_by_hand(i, t), t or "") for i, t in rows)
    for leaf in (4096, 16, 4):
        made = restored(fill_in_middle(docs, leaf_bytes=leaf), leaf_bytes=leaf)
        assert as_rows(made, "doc_id", "text", "n_units", "form", "fim_text", "prefix_chars", "middle_chars", "restored_text") == want
    assert made.columns == ["doc_id", "text", "_key", "n_units", "form", "fim_text", "prefix_chars", "middle_chars", "restored_text"]
    assert {r[3] for r in want} == {"plain", "psm", "spm"}
    assert restored(fill_in_middle(empty)).count() == 0


def test_ropes_split_at_every_rank():
    import numpy as np

    from waybill.llm.op13_fim import PREFIX, SUFFIX, concat, content, put_back, rank_of, rearranged, ropes, split

    r = random.Random(5)
    for _ in range(120):
        text = "".join(r.choice(["ab", "q", " ", "é", "<", "P>", "<S", "日", "\n", "zzzzzzzzzz"]) for _ in range(r.randint(0, 40)))
        units, raw = re.findall(r"[A-Za-z]+|[^A-Za-z]", text), text.encode()
        rope = ropes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), r.choice([4, 5, 7, 64]))[0]
        assert (rope.units, rope.points, content(rope)) == (len(units), len(text), raw)
        for k in range(len(units) + 1):
            a, b = split(rope, k)
            assert content(a).decode() == "".join(units[:k]) and content(b).decode() == "".join(units[k:])
            assert (a.units, b.units, a.points) == (k, len(units) - k, len("".join(units[:k])))
            c, d = split(concat(b, a), b.units)
            assert content(c) + content(d) == content(b) + content(a)
        for mark in (PREFIX, SUFFIX):
            if mark in raw:
                assert rank_of(rope, mark) == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", text[: text.index(mark.decode())]))
        if not any(m in text for m in ("<P>", "<S>", "<M>")):
            a, b = sorted((r.randint(0, len(units)), r.randint(0, len(units))))
            for spm in (False, True):
                assert content(put_back(rearranged(rope, a, b, spm)[0], "spm" if spm else "psm")) == raw


# SimHash


def fingerprint(text):
    import xxhash

    w = WORD.findall(lowered(text))
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def by_hand(rows, radius=4):
    fps = sorted({fingerprint(t) for _, t in rows})
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[root(b)] = root(a)
    least = {}
    for i, t in rows:
        k = root(fingerprint(t))
        if i is not None:
            least[k] = min(least.get(k, i), i)
    return Counter((i, fingerprint(t), least.get(root(fingerprint(t)))) for i, t in rows)


def near_rows():
    """Texts whose fingerprints differ in few bits: long ones with some words changed."""
    r, out = random.Random(3), []
    for f in range(12):
        base = [f"w{r.randint(0, 400)}" for _ in range(600)]
        for v in range(12):
            w = list(base)
            for _ in range(v):
                w[r.randrange(600)] = f"v{v}{r.randint(0, 9)}"
            out.append((1000 + 100 * f + v, " ".join(w)))
    return out


def test_simhash_components(spark, docs, rows, empty):
    from waybill.llm.op12_simhash import near_copies

    more = near_rows()
    every = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string"))
    want = by_hand([*rows, *more])
    assert 13 < len({c for *_, c in want}) < len(want) - 50
    for options in ({}, {"n_blocks": 7, "least": 1, "tile": 4}, {"n_blocks": 3, "least": 20, "tile": 16}):
        got = near_copies(every, **options).collect()
        assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert near_copies(empty).count() == 0


def test_tiles_miss_no_link():
    import numpy as np

    from waybill.llm.op12_simhash import byte_counts, compared
    from waybill.llm.graph import least_labels

    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    for k in range(300):  # neighbours at distances 1 to 6, and a dense group
        bits = rng.choice(64, rng.integers(1, 7), replace=False)
        fps[300 + k] = fps[k if k < 200 else 0] ^ np.uint64(sum(1 << int(b) for b in bits))
    fps = np.unique(np.append(fps, [np.uint64(0), np.uint64(2**64 - 1), np.uint64(7)]))
    fps = fps[np.lexsort((fps, *byte_counts(fps).T[::-1]))]
    near = np.stack(np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps) <= 4, 1)), 1)
    want = least_labels(len(fps), near)
    cut = len(fps) // 3
    found = [compared(fps[:cut], None, 4, 16), compared(fps[cut:], None, 4, 8), compared(fps[:cut], fps[cut:], 4, 32)]
    place = {int(f): i for i, f in enumerate(fps)}
    edges = np.array([[place[int(a)], place[int(b)]] for x, y in found for a, b in zip(x, y, strict=True)])
    assert (least_labels(len(fps), edges) == want).all() and len(set(want.tolist())) < len(fps) - 150


# importance resampling


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return w, [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]


def resampled_by_hand(rows, target):
    crc = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(map(crc, features(x)[1]))
    for x in target:
        t.update(map(crc, features(x)[1]))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000)))) for b in range(10000)]
    out, able = [], []
    for i, x in rows:
        w, f = features(x)
        weight = sum(gain[crc(y)] for y in f) // len(f) if f else 0
        h = int(sha(f"7:{'' if i is None else i}")[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(f), weight, score))
        if len(w) >= 20:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return out, able[: 25 * len(able) // 100]


def test_importance_resampling(spark, docs, rows, empty):
    from waybill.llm.op11_importance import drawn, resampled

    r = random.Random(9)
    texts = [" ".join(r.sample((rows[k][1] or "x").split() or ["x"], 1) * 3 + (rows[k][1] or "").split()[:30]) for k in range(0, 60, 3)] + [None, ""]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id bigint, text string")
    want, chosen = resampled_by_hand(rows, texts)
    for options in ({}, {"shard_bytes": 4000, "block_bytes": 6000}, {"shard_bytes": 1 << 30, "block_bytes": 1}):
        got = resampled(docs, target, **options).collect()
        assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(want)
        ranks = sorted((r["rank"], r.doc_id, r.score) for r in got if r["rank"] is not None)
        assert [(k, i, s) for k, i, s in ranks] == [(k + 1, i, s) for k, (i, _, _, s) in enumerate(chosen)]
    held = drawn(docs, target)
    assert held.columns == docs.columns and {r.doc_id for r in held.collect()} == {c[0] for c in chosen}
    assert resampled(empty, target).count() == 0
    assert {(r.weight <= 0) for r in resampled(docs, target.limit(0)).filter("n_features > 200").collect()} == {True}


def test_hot_first_words_reach_many_shards():
    import numpy as np

    from waybill.llm.op11_importance import dealt, merged

    text = (" ".join(f"the w{i}" for i in range(3000)) + " rare end").encode()
    _, sent = dealt(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 50, 3)
    assert max(len(p) for _, p in sent) < 8 * sum(len(p) for _, p in sent) / 50
    sums = sum(merged([p], 10000)[0] for _, p in sent)
    assert sums.sum() == 2 * 6002 - 1


# components


def test_components_of_long_chains(spark):
    from waybill.llm import graph

    r = random.Random(4)
    names = r.sample(range(1, 1 << 40), 30000)
    edges = [*zip(names[:20000], names[1:20000], strict=False), *((names[20000], n) for n in names[20001:29000]), *zip(names[29000::2], names[29001::2], strict=False), (5, 5)]
    want = {n: min(names[:20000]) for n in names[:20000]} | {n: min(names[20000:29000]) for n in names[20000:29000]}
    want |= {n: min(p) for p in zip(names[29000::2], names[29001::2], strict=False) for n in p}
    frame = spark.createDataFrame(edges, "a bigint, b bigint").repartition(4)
    assert {x.node: x.label for x in graph.components(frame).collect()} == want
    seen, kept = [], graph.written
    try:
        graph.written = lambda df, name="step": (seen.append(name), kept(df, name))[1]
        assert {x.node: x.label for x in graph.components(frame, few=0).collect()} == want
    finally:
        graph.written = kept
    assert seen.count("taken") <= 25
    assert graph.components(frame.limit(0)).count() == 0


def test_classes_of_a_long_chain_of_versions(spark):
    """Each text shifted by five words against the one before: one class, however long the chain."""
    from waybill.llm.op10_jaccard import classes, one_of_each

    r = random.Random(21)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(5 * 700 + 100)]
    rows = [(i, " ".join(words[5 * i : 5 * i + 100])) for i in range(700)]
    r.shuffle(rows)
    frame = spark.createDataFrame([*rows, (5000, "something else entirely, a text of its own")], "doc_id bigint, text string")
    got = {x["doc_id"]: x for x in classes(frame).collect()}
    assert {got[i]["class_id"] for i in range(700)} == {0} and got[5000]["class_id"] == 5000
    assert all(got[i]["n_links"] >= 2 for i in range(1, 699))
    assert {x["doc_id"] for x in one_of_each(frame).collect()} == {0, 5000}


def test_op7_starts_from_all_training_texts(spark, monkeypatch):
    """The pairs of neighbours from which the model starts are those of every training text, more than any sample held."""
    from zlib import crc32

    from waybill.llm import op7_hmm

    seen, real = [], op7_hmm.neighbours
    monkeypatch.setattr(op7_hmm, "neighbours", lambda *a: seen.append(real(*a)) or seen[-1])
    words = "red green blue one two three up down left right".split()
    rows = [(i, " ".join(words[(i * k + k) % 10] for k in range(i % 6))) for i in range(1500)]
    got = op7_hmm.scores(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    often, near = seen[0]
    assert near[:, : len(often)].sum() == near[:, len(often) :].sum() == sum(len(t.split()) for i, t in rows if crc32(str(i).encode()) % 7 != 2)
    assert len(got) == 1500 and sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
