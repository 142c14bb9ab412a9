"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, growing, materialise

#: Edges that a task contracts at a time.
CHUNK = 1_000_000


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n items is connected to by the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def contract(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) that connect the same nodes: of what is connected within a chunk of a partition, each node linked
    to the least."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        nodes, place = np.unique(np.concatenate([table["a"], table["b"]]), return_inverse=True)
        label = local_labels(len(nodes), *np.split(place, 2))
        far = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[label[far]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                held.append(batch.slice(at, chunk))
                if sum(b.num_rows for b in held) >= chunk:
                    yield stars(held)
                    held = []
        if held:
            yield stars(held)

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node has one lesser neighbour, which has none."""
    roles = edges.select(F.col("a").alias("node"), F.col("b").alias("up")).union(edges.select("b", F.lit(None).cast("long")))
    seen = roles.groupBy("node").agg(F.min("up").alias("least"), F.max("up").alias("most"), F.count_if(F.col("up").isNull()).alias("below"))
    return seen.where("least <> most OR (least IS NOT NULL AND below > 0)").isEmpty()


def components(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """edges (a long, b long), in either direction, repeated or looped, to (node, component): each node that has an
    edge to another, with the smallest node it is connected to.

    Each round contracts what lies together, then links each node's larger neighbours, and after that its smaller
    ones, to the least of all (large-star, small-star); rounds grow with the logarithm of the longest chain. Every
    round is written to the shared folder. A node may be the least neighbour of any number of others: minima come from
    a table of their own, so that the join's other side can be split; of lesser neighbours a node has one from each
    contracted chunk at most.
    """
    now = materialise(edges.where("a <> b").select("a", "b"), "edges")
    while True:
        edges, now = now, materialise(contract(now, chunk), "stars")
        discard(edges)
        if _is_stars(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        up = materialise(now.groupBy("a").agg(F.min("b").alias("m")), "least")
        large = now.join(growing(up.withColumnRenamed("a", "b")), "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(growing(least), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        stars, now = now, materialise(small.distinct(), "edges")
        discard(stars, up)
