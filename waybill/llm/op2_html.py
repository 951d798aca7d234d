"""Main text of web pages by gradient-boosted trees over DOM nodes with hierarchical decoding.

Two tree ensembles, trained on ``SAMPLE`` generated pages with marked main text, give for each node
the odds that all of its text is main text and that none is.  The decoder chooses for each page the
most likely labelling in which everything below a kept node is kept unless that node is mixed, and everything below a dropped
node is dropped, by dynamic programming from the leaves.

Character references are decoded, white space inside a block becomes one space, blocks are joined in
page order by one space.  Null or empty html gives an empty text; plain text without tags is one
block; repeated rows are extracted each; an empty table gives an empty result; extra columns are not
carried.
"""

from __future__ import annotations

import json
import pkgutil
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boost import Trees, fitted
from .dom import Forest, Page, features, parse
from .page_samples import Writer, pages
from .store import spread

SAMPLE = 3000
#: Pages are decoded together until they have so many nodes.
NODES = 20_000
MODEL = "main_text_model.json"


def marked(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Share of marked characters and number of characters below every node; removes the marks."""
    n = len(page.tag)
    good, total, inside = np.zeros(n), np.zeros(n), False
    for i in range(n):
        text, out, linked = page.text[i], [], page.linked[i]
        for ch in text:
            if ch == Writer.ON:
                inside = True
            elif ch == Writer.OFF:
                inside = False
            else:
                out.append(ch)
                good[i] += inside
        page.text[i] = "".join(out).strip()
        page.linked[i] = min(linked, len(page.text[i]))
        total[i] = len(out)
    for i in range(n - 1, 0, -1):
        good[page.parent[i]] += good[i]
        total[page.parent[i]] += total[i]
    return good / np.maximum(total, 1), total


def trained(n: int = SAMPLE) -> tuple[Trees, Trees]:
    """Models of "all main text" and "no main text", fitted on n generated pages."""
    rows, share, size = [], [], []
    for source in pages(n):
        page = parse(source)
        s, t = marked(page)
        rows.append(features([page], Forest([page])))
        share.append(s)
        size.append(t)
    x, share, size = np.concatenate(rows), np.concatenate(share), np.concatenate(size)
    some = size > 0
    weight = np.sqrt(1 + size[some])
    weight /= weight.mean()
    return fitted(x[some], (share[some] > 0.97).astype(float), weight), fitted(x[some], (share[some] < 0.03).astype(float), weight)


def document(models: tuple[Trees, Trees], n: int = SAMPLE) -> str:
    """The fitted models as JSON; both have the same edges."""
    return json.dumps({"pages": n, "edges": [e.tolist() for e in models[0].edges], "keep": models[0].document(), "drop": models[1].document()}, separators=(",", ":")) + "\n"


def read(text: str) -> tuple[Trees, Trees]:
    d = json.loads(text)
    edges = [np.array(e) for e in d["edges"]]
    return Trees.read(d["keep"], edges), Trees.read(d["drop"], edges)


@lru_cache(1)
def shipped() -> tuple[Trees, Trees]:
    """The models in ``MODEL``, which ``python -m waybill.llm.op2_html`` fits and writes."""
    return read(pkgutil.get_data(__package__, MODEL).decode())


KEEP, DROP, MIXED = 0, 1, 2


def decoded(forest: Forest, size: np.ndarray, keep: np.ndarray, drop: np.ndarray) -> np.ndarray:
    """Which nodes' own text is kept; size: of the own text; keep and drop: log odds of the two models."""
    p_keep, p_drop = 1 / (1 + np.exp(-keep)), 1 / (1 + np.exp(-drop))
    rest = np.clip(1 - p_keep - p_drop, 0.01, None)
    leaf = np.ones(forest.n, bool)
    leaf[forest.parent[forest.parent >= 0]] = False
    rest[leaf] = 1e-9
    value = np.log(np.stack([p_keep, p_drop, rest], 1) + 1e-9)
    value[(size == 0) & leaf] = 0
    best = np.zeros(forest.n, np.int64)
    for own, up, first in reversed(forest.levels):
        v = value[own]
        best[own] = v.argmax(1)
        v[:, MIXED] = v.max(1)
        value[up] += np.add.reduceat(v, first, axis=0)
    best[forest.root] = value[forest.root].argmax(1)
    label = best.copy()
    for own, _, _ in forest.levels:
        above = label[forest.parent[own]]
        label[own] = np.where(above == MIXED, best[own], above)
    return label == KEEP


def main_texts(sources: list[str | None], models: tuple[Trees, Trees]) -> list[str]:
    """The main text of every page."""
    out: list[str] = []
    held: list[Page | None] = []
    n_nodes = 0

    def decode() -> None:
        read_pages = [p for p in held if p]
        if read_pages:
            forest = Forest(read_pages)
            bins = models[0].binned(features(read_pages, forest))
            texts = [t for p in read_pages for t in p.text]
            kept = decoded(forest, np.fromiter(map(len, texts), float, len(texts)), models[0].logit(bins), models[1].logit(bins)).tolist()
        first = 0
        for p in held:
            after = first + (len(p.tag) if p else 0)
            out.append(" ".join(texts[i] for i in range(first, after) if kept[i] and texts[i]))
            first = after
        held.clear()

    for source in sources:
        held.append(parse(source) if source else None)
        n_nodes += len(held[-1].tag) if held[-1] else 0
        if n_nodes >= NODES:
            decode()
            n_nodes = 0
    decode()
    return out


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of (page_id, url, html)."""
    models = pages.sparkSession.sparkContext.broadcast(shipped())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = main_texts(batch.column(2).to_pylist(), models.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return spread(rows).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


if __name__ == "__main__":
    from pathlib import Path

    Path(__file__).with_name(MODEL).write_text(document(trained()))
