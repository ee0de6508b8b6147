"""Connected components of a graph of integer nodes, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .tasks import lean

#: Edges that a task ties at once; a partition of more is tied in parts.
EDGES_AT_ONCE = 1 << 20


def _lowest_ends(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that these edges lead to a lower one, and the lowest that they reach from it."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    up = np.arange(len(nodes))
    while True:  # every root but the lowest around it is hooked, so at most half are left of those with edges
        low, high = np.minimum(a, b), np.maximum(a, b)
        apart = low < high
        low, high = low[apart], high[apart]
        if not len(low):
            break
        np.minimum.at(up, high, low)
        while (further := up[up]).tobytes() != up.tobytes():
            up = further
        a, b = up[low], up[high]
    moved = up < np.arange(len(nodes))
    return nodes[moved], nodes[up[moved]]


def _tied(edges: DataFrame, whole: bool = False) -> DataFrame:
    """The same components from at most one edge a node and part of a partition, which leads to the lowest node that the part's edges reach.

    whole: partitions are sorted by u, and edges of one u are never in two parts.
    """

    def tie(batches):
        held, n = [], 0

        def part(cut):
            table = pa.Table.from_batches(held)
            u, v = (table.column(c).to_numpy() for c in ("u", "v"))
            cut = int(np.searchsorted(u, u[-1])) if cut else n
            ends = _lowest_ends(u[:cut], v[:cut])
            return pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["u", "v"]), table.slice(cut).combine_chunks().to_batches()

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= EDGES_AT_ONCE:
                out, held = part(whole)
                n = sum(x.num_rows for x in held)
                yield out
        if n:
            yield part(False)[0]

    return edges.select("u", "v").mapInArrow(lean(tie), "u long, v long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """For each node that has an edge to another: ``node, component``, the lowest node that can be reached.

    edges: ``u, v``, two long columns; directions, repeats, loops and rows with nulls don't matter. An empty graph has no rows.
    Each round's edges are a table in the shared folder, so the lineage stays short and a lost executor repeats one round at most.
    A large star leads each edge's higher end to the lowest neighbour of its lower end; the lowest are reduced before the shuffle, and edges meet
    them in a join of two plain tables, which Spark splits. A small star brings the edges of a higher end together and ties them. Tasks
    tie their edges before each shuffle by the higher end, so a node has there a few rows for each task at most. Ends when every
    node has one edge and no node is at both ends of some, which takes about as many rounds as the graph's diameter has binary digits.
    """
    now = _tied(edges.where("u <> v"))
    for _ in range(rounds):
        now = staged(now, "edges")
        ends = now.select(F.col("u").alias("node"), F.col("v").alias("below")).unionByName(now.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("below")))
        around = ends.groupBy("node").agg(F.min("below").alias("low"), F.max("below").alias("high"), F.max(F.col("below").isNull()).alias("inner"))
        lowest = staged(around.select("node", F.coalesce("low", "node").alias("low"), (F.col("high").isNotNull() & (F.col("inner") | (F.col("low") < F.col("high")))).alias("open")), "lowest")
        if lowest.where("open").limit(1).count() == 0:
            return lowest.select("node", F.col("low").alias("component"))
        large = now.join(lowest.select(F.col("node").alias("v"), "low"), "v").select("u", F.col("low").alias("v"))
        now = _tied(large.repartition("u").sortWithinPartitions("u"), whole=True)
    raise RuntimeError(f"components not found in {rounds} rounds")
