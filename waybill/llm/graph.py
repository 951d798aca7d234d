"""Connected components over edges, by joins and without a bound on the rounds.

Randomised contraction: in every round each node takes, of itself and its neighbours, the one whose
hash under the round's seed is least, and edges are carried over to the nodes so taken.  Connectivity
stays, and the expected number of nodes falls by at least a quarter whatever the graph's shape, so
chains take logarithmically many rounds.  Rounds only see what the rounds before left.  Once at most
``few`` edges are left (16 bytes each, so 16 MB), one task settles them by hooking roots.  The maps of
the rounds, last first, then lead every node to its label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

FEW = 1 << 20


def least_labels(n: int, edges: np.ndarray) -> np.ndarray:
    """The least member of the component of each of n nodes."""
    label = np.arange(n)
    while True:
        a, b = label[edges[:, 0]], label[edges[:, 1]]
        open_ = a != b
        if not open_.any():
            return label
        edges = edges[open_]
        np.minimum.at(label, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
        while (label != label[label]).any():
            label = label[label]


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of all edges of one task."""
    held = [b for b in batches if b.num_rows]
    if held:
        table = pa.Table.from_batches(held)
        nodes, place = np.unique(np.concatenate([table.column("a").to_numpy(), table.column("b").to_numpy()]), return_inverse=True)
        label = nodes[least_labels(len(nodes), place.reshape(2, -1).T)]
        yield from pa.table({"node": nodes, "label": label}).to_batches(max_chunksize=100_000)


def _plain(edges: DataFrame) -> DataFrame:
    """Each edge once, without loops."""
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, label) for every node of edges (a, b) with another node; the label is the least node of the component."""
    left, rounds = written(_plain(edges.select("a", "b")), "edges"), []
    while left.count() > few:
        seed = F.lit(len(rounds) + 1)
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = F.min(F.struct(F.xxhash64("b", seed).alias("h"), F.col("b").alias("b")))
        own = F.struct(F.xxhash64("a", seed).alias("h"), F.col("a").alias("b"))
        taken = written(both.groupBy("a").agg(best.alias("m")).select(F.col("a").alias("node"), F.least("m", own).getField("b").alias("onto")), "taken")
        rounds.append(taken)
        moved = left.join(taken.withColumnRenamed("node", "a"), "a").select(F.col("onto").alias("a"), "b")
        moved = moved.join(taken.withColumnRenamed("node", "b"), "b").select("a", F.col("onto").alias("b"))
        left = written(_plain(moved), "edges")
    labels = left.repartition(1).mapInArrow(_settled, "node bigint, label bigint")
    if not rounds:
        return written(labels, "labels")
    for taken in reversed(rounds):
        onward = labels.select(F.col("node").alias("onto"), "label")
        labels = taken.join(onward, "onto", "left").select("node", F.coalesce("label", "onto").alias("label"))
    labels = written(labels, "labels")
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    return written(labels.join(least, "label").select("node", F.col("least").alias("label")), "labels")
