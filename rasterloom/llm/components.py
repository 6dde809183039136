"""Connected components of a table of edges, by large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm._stage import removed, salted_join, written

MOST_ROUNDS = 60
#: Up to this many edges (16 MB), counted before, one task finds their components; more go through the rounds.
ONE_TASK = 1 << 20


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def smallest_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, ascending, and the smallest node that each one's edges reach."""
    nodes, code = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        after = root.copy()
        for side in (x, y, root[x], root[y]):
            np.minimum.at(after, side, least)
        while (after[after] != after).any():
            after = after[after]
        if (after == root).all():
            return nodes, nodes[root]
        root = after


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(x.column(0).to_numpy(zero_copy_only=False), x.column(1).to_numpy(zero_copy_only=False)) for x in batches]
        if parts:
            node, root = smallest_reached(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "component"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, component long")


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component): each node of the edges (a, b) and the smallest node of its component.

    The edges stay in tables of the shared folder. Every step is an aggregate with map-side sums and a salted join, so a node with
    very many edges is spread over tasks. Without edges the result is empty; loops and repeated edges are nothing.
    """
    spark = edges.sparkSession
    own, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(own)
    if state[0] <= one_task:
        return _in_one_task(own)
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            break
        both = own.union(own.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = salted_join(both, least, ["a"], F.col("b")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = salted_join(large, least, ["a"], F.col("b"))
        small = joined.select("a", F.col("m").alias("b")).union(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        next_, next_path = written(small, "edges")
        after = _state(next_)
        removed(spark, path)
        own, path = next_, next_path
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components: not ended after {MOST_ROUNDS} rounds")
    return own.select(F.col("a").alias("node"), F.col("b").alias("component")).union(own.select("b", "b").distinct())
