"""Connected components of an edge table, by repeated contraction of tables.

In each round every node takes the smallest of itself and its neighbours (in the order of a hash,
so that no numbering of the nodes makes long chains), edges move to the chosen nodes, and loops and
repeats go.  A round at least halves what is left of a path and finishes a star in two rounds.
Once few edges are left, one task finishes them: a round is four jobs whose plans and compiled
code stand in the driver's memory.  Edges and labels stay in tables; only a count comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, written
from .text_kernels import tidy

MOST_ROUNDS = 60
#: Edges (16 bytes each) that one task finishes.
FEW_EDGES = 1 << 20


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the root of each) for edges in memory; a root is the smallest node of its component."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(further := root[root], root):
            root = further
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[root]


def _finished(edges: DataFrame) -> DataFrame:
    """(at, to): the root of each node, by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if held:
            at, to = roots(*(np.concatenate(c) for c in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(to, pa.int64())], names=["at", "to"])

    return edges.select("u", "v").coalesce(1).mapInArrow(tidy(run), "at long, to long")


def _nearest(edges: DataFrame) -> DataFrame:
    """(at, to): for each node the first of itself and its neighbours."""
    both = edges.union(edges.select("v", "u"))
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("node"))
    step = both.groupBy(F.col("u").alias("at")).agg(F.min(rank("v")).alias("near"))
    return step.select("at", F.least(rank("at"), F.col("near")).getField("node").alias("to"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (columns u, v: long); root is a node of the component."""
    left = written(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = None
    for _ in range(MOST_ROUNDS):
        count = left.count()
        if not count:
            break
        few = count <= FEW_EDGES
        step = written(_finished(left) if few else _nearest(left), "step")
        before = left
        if not few:
            a, b = (step.withColumnsRenamed({"at": f"at_{k}", "to": f"to_{k}"}) for k in "uv")
            moved = left.join(a, F.col("u") == F.col("at_u")).join(b, F.col("v") == F.col("at_v")).where("to_u <> to_v")
            left = written(moved.select(F.least("to_u", "to_v").alias("u"), F.greatest("to_u", "to_v").alias("v")).distinct(), "edges")
        discard(before)
        if labels is None:
            labels, held = step.select(F.col("at").alias("node"), F.col("to").alias("root")), [step]
        else:
            labels = written(labels.join(step, F.col("root") == F.col("at"), "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
            discard(*held, step)
            held = [labels]
        if few:
            break
    else:
        raise RuntimeError("components: too many rounds")
    if labels is None:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return labels
