"""Pairing old and new records in the order of the old ones, from a table of edges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import free_stage, stage_path, staged, unsent

#: Edges of a group of records that a task settles one by one.
GROUP = 1_000_000
#: Rounds for all groups at once before what remains is grouped.
ROUNDS = 3


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for links ``(u, v)`` of nodes: the smallest node that each one is connected to. Rounds grow with the logarithm of the longest path.

    Large stars and small stars in turn: a node's larger neighbours are linked to its smallest one, then its smaller ones.
    """
    both = lambda df: df.unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v")))
    links = staged(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while True:
        wide = both(links)
        low = wide.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = staged(wide.filter("v > u").join(unsent(low), "u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(unsent(low), "u").select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e"))
        new = staged(small.select("e.*").filter("u <> v").distinct(), "links")
        same = new.count() == links.count() and new.join(unsent(links), ["u", "v"], "left_anti").isEmpty()
        for done in (links, large):
            free_stage(done)
        links = new
        if same:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _one_by_one(edges: DataFrame) -> DataFrame:
    """Pairs of edges with a ``group``, each taken by one task, record by record; a task holds the used records of one group."""
    kinds = StructType([edges.schema["old_id"], edges.schema["new_id"]])

    def settle(batches):
        group = old = None
        free: list = []
        used: set = set()
        out: list[tuple] = []

        def close():
            if len(free) == 1:
                used.add(free[0])
                out.append((old, free[0]))

        for batch in batches:
            for g, o, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (g, o) != (group, old):
                    close()
                    if g != group:
                        used = set()
                    group, old, free = g, o, []
                if n not in used:
                    free.append(n)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], batch.column(i + 1).type) for i in range(2)], ["old_id", "new_id"])
                out.clear()
            kind = batch.column(1).type, batch.column(2).type
        if group is not None:
            close()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], kind[i]) for i in range(2)], ["old_id", "new_id"])

    rows = edges.repartition("group").sortWithinPartitions("group", "old_ord", "old_id", "new_id")
    return rows.select("group", "old_id", "new_id").mapInArrow(settle, kinds)


def settle_edges(edges: DataFrame, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """Pairs ``(old_id, new_id)`` from edges ``(old_id, old_ord, new_id)``: old records in order, each taking its candidate if just one is unused.

    The order is kept without taking all records one by one. A round settles every old record that no earlier unsettled one shares a candidate
    with. What some rounds leave is cut into groups of records that are connected at all; a group of up to ``group`` edges is
    settled at once by one task, so a long chain of records that wait for each other takes as long as its groups take to be found. Larger groups go
    on by rounds until they fall apart.
    """
    spark = edges.sparkSession
    turn = F.struct("old_ord", "old_id")
    edges = staged(edges.select("old_id", "old_ord", "new_id").distinct(), "edges")
    found = [staged(edges.limit(0).select("old_id", "new_id"), "pairs")]
    while not edges.isEmpty():
        for _ in range(rounds):
            first = edges.groupBy("new_id").agg(F.min(turn).alias("_first"))
            leads = edges.join(unsent(first), "new_id").withColumn("_leads", turn.eqNullSafe(F.col("_first")))
            settled = leads.groupBy("old_id").agg(F.min("_leads").alias("_ready"), F.count(F.lit(1)).alias("_free"), F.min("new_id").alias("new_id"))
            settled = staged(settled.filter("_ready").drop("_ready"), "settled")
            found.append(staged(settled.filter("_free = 1").select("old_id", "new_id"), "pairs"))
            edges = _next(edges, settled.select("old_id"), found[-1].select("new_id"))
            free_stage(settled)
            if edges.isEmpty():
                break
        else:
            first = edges.groupBy("new_id").agg(F.min("old_id").alias("v"))
            roots = components(edges.join(unsent(first), "new_id").select(F.col("old_id").alias("u"), "v"))
            grouped = edges.join(unsent(roots.withColumnRenamed("node", "old_id")), "old_id", "left").withColumn("group", F.coalesce("root", "old_id")).drop("root")
            grouped = staged(grouped, "grouped")
            few = staged(grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= group).select("group"), "groups")
            own = grouped.join(unsent(few), "group", "left_semi")
            found.append(staged(_one_by_one(own), "pairs"))
            rest = staged(grouped.join(unsent(few), "group", "left_anti").drop("group"), "edges")
            for done in (edges, grouped, few):
                free_stage(done)
            edges = rest
    return spark.read.schema(found[0].schema).parquet(*[stage_path(f) for f in found])


def _next(edges: DataFrame, settled: DataFrame, used: DataFrame) -> DataFrame:
    """Edges of records that are not settled to records that are not used."""
    rest = staged(edges.join(unsent(settled), "old_id", "left_anti").join(unsent(used), "new_id", "left_anti").select("old_id", "old_ord", "new_id"), "edges")
    free_stage(edges)
    return rest
