"""Near-duplicate vectors by a robust-pruned flat graph.

1. Equal vectors are one node. A bounded sample gives cluster centres, and in a large table each of their cells gets centres of its own;
   each node belongs to the shard of its nearest centre, its home, and is a guest in those of the next ones, so shards overlap.
2. Each shard links its nodes to near ones, pruned so that a neighbour is left out where a nearer one leads to it. The adjacency
   lists that a node has from several shards are united.
3. In each shard, every node that is at home there searches the graph: from the nearest of some medoids, and from its
   own place, greedily to the closest nodes, then through all nodes within a slack of the range, as long as new ones come up. Pairs in range
   are verified by their cosine in double precision. A node with more nodes in range than a list holds is compared with its whole home shard
   instead, as its list may lead to its own group alone. A pair belongs to one shard, which counts it for both nodes and ties them in a
   forest; no pair is a row.
4. After every pass, an audit compares the links found with brute force over all vectors, for nodes drawn by hash. Below the recall that is asked
   for, the whole is done again with twice the guests; where that does not help either, all pairs are compared, over tiles of two blocks.
5. Links are counted, and components follow from the forests.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .components import components
from .near import _fields, _groups, tiled
from .words import ragged

#: Vectors that centres are fitted on, nodes at home in a shard, and centres at most; beyond them, each centre's cell has centres of its own.
SAMPLE, SHARD, MOST_SHARDS = 8192, 500, 2048
#: Vectors of a cell that its centres are taken from for one of them, and rows of a cell that meet them in one task.
CELL_SAMPLE, CELL_ROWS = 4, 100_000
DEGREE, CANDIDATES, PRUNE = 20, 48, 1.2
MEDOIDS, BEAM, SLACK = 16, 24, 0.1
#: Nodes with true links that an audit would like to see, nodes that it draws at a time at most, and how often it draws (each is a scan of all vectors).
AUDITED, DRAWN, DRAWS = 400, 16_384, 4
#: Shards that a node may be a guest in; where the audit fails even so, all pairs are compared.
MOST_GUESTS = 63
#: The exact comparison has one block up to so many rows, and beyond it so many blocks, or more where they would have over so many rows.
BLOCK, BLOCKS, MOST_BLOCK = 1024, 12, 65_536
#: Rows of a shard that meet in one task; a larger shard, as of very many near copies, is dealt over tiles of two blocks.
TILE = 16_384


def _matrix(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dims)


def usable(vector: Column) -> Column:
    """Not null or empty, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def nodes_of(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``node`` (lowest id), ``copies``, ``dims`` and ``unit`` (bytes of doubles, of length 1) of each distinct usable vector, by ``k1, k2``."""

    def normalise(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                units, dims = [], []
                for v in part.column(4).to_pylist():
                    x = np.array(v, float)
                    top = np.abs(x).max()
                    x = x / top if top > 0 else x
                    units.append((x / np.sqrt((x * x).sum())).astype("<f8").tobytes() if top > 0 else None)
                    dims.append(len(v))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(dims, pa.int32()), pa.array(units, pa.binary())], ["k1", "k2", "node", "copies", "dims", "unit"])

    vector = F.col("v")
    rows = df.select(df[id_col].cast("long").alias("id"), df[vector_col].alias("v")).where(usable(vector) & F.col("id").isNotNull())
    rows = rows.select("id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(5), "v").alias("k2"))
    same = rows.groupBy("k1", "k2").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.first("v").alias("v"))
    out = same.select("k1", "k2", "node", "copies", "v").mapInArrow(normalise, "k1 long, k2 long, node long, copies long, dims int, unit binary")
    return out.where("unit IS NOT NULL")


def centres_of(units: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Directions that the sample clusters around."""
    rng = np.random.default_rng(7)
    centres = units[rng.permutation(len(units))[:k]].copy()
    for _ in range(rounds):
        own = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, units)
        size = np.sqrt((sums * sums).sum(axis=1))
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


_DEALT = "shard long, home long, shards array<long>, node long, copies long, unit binary"


def _rows_of(batch: pa.RecordBatch, shards: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
    """A row for each node of a batch (node, copies, unit) and each of its shards, which are a row of a table."""
    near = shards.shape[1]
    row = pa.array(np.repeat(np.arange(len(shards)), near))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(shards) + 1) * near, pa.int32()), pa.array(shards.ravel()))
    return pa.RecordBatch.from_arrays(
        [pa.array(shards.ravel()), pa.array(np.repeat(home, near)), lists.take(row), *(c.take(row) for c in batch.columns)], ["shard", "home", "shards", "node", "copies", "unit"])


def dealt(nodes: DataFrame, centres: np.ndarray, guests: int) -> DataFrame:
    """A row for each node and shard: ``shard, home, shards`` (all of the node's)``, node, copies, unit``."""
    dims, near = centres.shape[1], min(1 + guests, len(centres))

    def assign(batches):
        for b in batches:
            if b.num_rows:
                closeness = _matrix(b.column(2), dims) @ centres.T
                top = np.argsort(-closeness, axis=1, kind="stable")[:, :near].astype(np.int64)
                yield _rows_of(b, top, top[:, 0])

    return nodes.select("node", "copies", "unit").mapInArrow(assign, _DEALT)


def dealt_by_cells(nodes: DataFrame, centres: np.ndarray, shards: int, guests: int) -> DataFrame:
    """As :func:`dealt`, for more shards than there are centres: the cell of each centre has centres of its own, nodes of it chosen by hash.

    A node meets the centres of its nearest cell, where its home and most of its guest shards are, and those of the next one, where it is a
    guest. A cell's rows are dealt over as many tasks as they need, with all of the cell's centres sent to each.
    """
    dims, every = centres.shape[1], 1 << 40
    sent = nodes.sparkSession.sparkContext.broadcast(centres)
    cells = min(2, len(centres))

    def place(batches):
        for b in batches:
            if b.num_rows:
                top = np.argsort(-(_matrix(b.column(2), dims) @ sent.value.T), axis=1, kind="stable")[:, :cells]
                row = pa.array(np.repeat(np.arange(len(top)), cells))
                nth = np.tile(np.arange(cells), len(top)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(top.ravel().astype(np.int64)), pa.array(nth), *(c.take(row) for c in b.columns)], ["cell", "nth", "node", "copies", "unit"])

    placed = staged(nodes.select("node", "copies", "unit").mapInArrow(place, "cell long, nth int, node long, copies long, unit binary"), "cells")
    own = placed.where("nth = 0")
    sizes = own.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    share = shards / max(1, own.count())
    chance = F.least(F.lit(1.0), F.greatest(F.lit(share), F.lit(2.0 * CELL_SAMPLE) / F.col("size")))
    inner = own.join(F.broadcast(sizes), "cell").where(F.pmod(F.xxhash64(F.lit(9), "node"), F.lit(every)) < (chance * every).cast("long"))
    parts = sizes.select("cell", F.greatest(F.lit(1), F.ceil(2 * F.col("size") / CELL_ROWS)).cast("int").alias("parts"))
    rows = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn("kind", F.lit(1)).drop("parts")
    heads = inner.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("kind", F.lit(0))
    both = rows.select("cell", "part", "kind", "nth", "node", "copies", "unit").unionByName(heads.select("cell", "part", "kind", "nth", "node", "copies", "unit"))

    def assign(batches):
        at, held, book, numbers = None, [], None, None
        for b in batches:
            cell, part, kind, nth, node = (b.column(i).to_numpy() for i in range(5))
            cuts = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])]))
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), b.num_rows], strict=True):
                piece = b.slice(lo, hi - lo)
                if (cell[lo], part[lo]) != at:
                    at, held = (cell[lo], part[lo]), []
                if kind[lo] == 0:
                    held.append((_matrix(piece.column(6), dims), node[lo:hi]))
                    book, numbers = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    continue
                if not held:  # a cell that is nobody's nearest
                    continue
                near = min(1 + guests, len(book))
                closeness = _matrix(piece.column(6), dims) @ book.T
                top = numbers[np.argsort(-closeness, axis=1, kind="stable")[:, :near]]
                first = nth[lo:hi] == 0
                some = pa.RecordBatch.from_arrays(piece.columns[4:7], ["node", "copies", "unit"])
                for flag, width in ((first, near), (~first, max(1, near // 2))):  # in the second cell it is a guest
                    if flag.any():
                        mine = top[flag][:, :width]
                        yield _rows_of(some.filter(pa.array(flag)), mine, mine[:, 0] if flag is first else np.full(len(mine), -1))

    spread = both.repartition(max(1, len(centres)), "cell", "part").sortWithinPartitions("cell", "part", "kind")
    out = staged(spread.mapInArrow(assign, _DEALT), "dealt")
    whole = out.groupBy("node").agg(F.max("home").alias("home"), F.collect_set("shard").alias("shards"))  # over both cells
    return out.drop("home", "shards").join(whole, "node").select("shard", "home", "shards", "node", "copies", "unit")


def pruned(x: np.ndarray, least: float, degree: int = DEGREE, candidates: int = CANDIDATES, prune: float = PRUNE, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Robust-pruned neighbours of each row of x among the others: a table of row numbers, filled up with -1; and the rows with more
    others in range than a list holds.

    Of its nearest ones, a row takes the nearest that is left and drops those that are nearer to that one, by the factor, than to
    the row itself.
    """
    n, c = len(x), min(candidates, len(x) - 1)
    out, crowded = np.full((n, degree), -1, np.int64), np.zeros(n, bool)
    if c < 1:
        return out, np.flatnonzero(crowded)
    for lo in range(0, n, block):
        rows = np.arange(lo, min(n, lo + block))
        close = x[rows] @ x.T
        close[np.arange(len(rows)), rows] = -np.inf
        crowded[rows] = (close >= least).sum(axis=1) > degree
        near = np.argpartition(-close, c - 1, axis=1)[:, :c]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(close, near, 1), axis=1, kind="stable"), 1)
        away = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(close, near, 1), 0))
        v = x[near]
        between = np.sqrt(np.maximum(2 - 2 * np.matmul(v, v.transpose(0, 2, 1)), 0))
        alive, taken = np.ones(near.shape, bool), np.zeros(len(rows), np.int64)
        for t in range(c):
            take = np.flatnonzero(alive[:, t] & (taken < degree))
            out[rows[take], taken[take]] = near[take, t]
            taken[take] += 1
            alive[take] &= ~(prune * between[take, t, :] <= away[take])
    return out, np.flatnonzero(crowded)


def graph(rows: DataFrame, dims: int, shards: int, least: float) -> DataFrame:
    """``node, neighbours, crowded``: the united adjacency lists, in both directions, given to every shard that the node is in, and
    whether some shard has more nodes in the node's range than a list holds."""

    def build(batches):
        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        table = pa.Table.from_batches(batches)
        shard, ta, tb, node = (c.to_numpy() for c in _fields(batches, ["shard", "tile_a", "tile_b", "node"]))
        units = _matrix(table.column("unit"), dims)
        order, starts, stops = _groups([shard, ta, tb])
        for lo, hi in zip(starts.tolist(), stops.tolist(), strict=True):
            own = order[lo:hi]
            to, crowded = pruned(units[own], least)
            a, b = np.nonzero(to >= 0)
            u, v, w = node[own[a]], node[own[to[a, b]]], node[own[crowded]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, v])), pa.array(np.concatenate([v, u])), pa.array(np.zeros(2 * len(u), bool))], ["node", "neighbour", "crowded"])
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.nulls(len(w), pa.int64()), pa.array(np.ones(len(w), bool))], ["node", "neighbour", "crowded"])

    edges = rows.repartition(shards, "shard", "tile_a", "tile_b").mapInArrow(build, "node long, neighbour long, crowded boolean")
    return edges.groupBy("node").agg(F.collect_set("neighbour").alias("neighbours"), F.max("crowded").alias("crowded"))  # by 2 * DEGREE in each shard, but for hubs


def _search(x: np.ndarray, lists: list[np.ndarray], queries: np.ndarray, least: float, block: int = 128):
    """For a block of queries after another: (query, row) of all rows reached with at least the cosine, the query itself left out."""
    n = len(x)
    sizes = np.fromiter(map(len, lists), np.int64, n)
    begins, flat = np.cumsum(sizes) - sizes, np.concatenate(lists) if n else np.zeros(0, np.int64)
    rng = np.random.default_rng(11)
    centre = x.mean(axis=0)
    medoids = np.unique(np.append(rng.permutation(n)[: MEDOIDS - 1], int((x @ centre).argmax())))
    for lo in range(0, len(queries), block):
        q = queries[lo : lo + block]
        seen = np.zeros((len(q), n), bool)
        close = np.full((len(q), n), -np.inf)
        done = np.zeros((len(q), n), bool)
        entry = x[q] @ x[medoids].T
        best = medoids[entry.argmax(axis=1)]
        row = np.arange(len(q))
        seen[row, best] = True
        close[row, best] = entry.max(axis=1)
        seen[row, q], close[row, q] = True, 1.0  # a query is a node of the graph itself
        active = row
        while len(active):
            open_ = np.where(done[active], -np.inf, close[active])
            first = open_.argmax(axis=1)
            top = open_[np.arange(len(active)), first]
            width = min(BEAM, n)
            edge = -np.partition(-close[active], width - 1, axis=1)[:, width - 1]
            go = open_ >= least - SLACK  # in range: all at once
            step = np.isfinite(top) & (top >= edge)
            go[np.flatnonzero(step), first[step]] = True
            a, node = np.nonzero(go)
            if not len(a):
                break
            done[active[a], node] = True
            who = np.repeat(active[a], sizes[node])
            to = flat[ragged(begins[node], sizes[node])]
            fresh = ~seen[who, to]
            who, to = who[fresh], to[fresh]
            seen[who, to] = True
            pairs = np.unique(who * n + to)
            who, to = pairs // n, pairs % n
            for at in range(0, len(who), 100_000):
                w, t = who[at : at + 100_000], to[at : at + 100_000]
                close[w, t] = np.einsum("ij,ij->i", x[q[w]], x[t])
            active = active[np.unique(a)]
        found_q, found = np.nonzero(close >= least)
        found_q = q[found_q]
        other = found_q != found
        yield found_q[other], found[other]


def _whole(x: np.ndarray, queries: np.ndarray, least: float, block: int = 128):
    """As :func:`_search`, by comparing each query with all rows."""
    for lo in range(0, len(queries), block):
        q = queries[lo : lo + block]
        a, b = np.nonzero(x[q] @ x.T >= least)
        other = q[a] != b
        yield q[a[other]], b[other]


class _Hits:
    """Which rows found which, by bits."""

    def __init__(self, n: int):
        self.n, self.bits = n, np.zeros((n, -(-n // 8)), np.uint8)

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        np.bitwise_or.at(self.bits, (u, v >> 3), (128 >> (v & 7)).astype(np.uint8))

    def blocks(self, size: int = 512):
        """(first row, table of rows by all rows): whether either found the other."""
        for lo in range(0, self.n, size):
            hi = min(self.n, lo + size)
            mine = np.unpackbits(self.bits[lo:hi], axis=1, count=self.n).astype(bool)
            theirs = np.unpackbits(self.bits[:, lo // 8 : -(-hi // 8)], axis=1)[:, : hi - lo].astype(bool)
            yield lo, mine | theirs.T


def found_links(rows: DataFrame, adjacency: DataFrame, dims: int, shards: int, least: float) -> DataFrame:
    """What the searches find: the number of links that a shard counts for a node (``kind`` 0: ``u, n``), and a forest of them (kind 1: ``u, v``).

    A pair of nodes at home in one shard is that shard's. A pair of different homes is found in the home of one node where the other is a
    guest; if that holds for both homes, it is that of the lower number.
    """

    def search(batches):
        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        table = pa.Table.from_batches(batches)
        shard, home, node, copies, ta, tb, block = (c.to_numpy() for c in _fields(batches, ["shard", "home", "node", "copies", "tile_a", "tile_b", "block"]))
        units = _matrix(table.column("unit"), dims)
        order, starts, stops = _groups([shard, ta, tb])
        for lo, hi in zip(starts.tolist(), stops.tolist(), strict=True):
            own = order[lo:hi][np.argsort(node[order[lo:hi]], kind="stable")]
            ids, here = node[own], shard[own[0]]
            lists = []
            for x in table.column("neighbours").take(pa.array(own)).to_pylist():
                ns = np.array(x or [], np.int64)
                at = np.minimum(np.searchsorted(ids, ns), len(ids) - 1)
                lists.append(at[ids[at] == ns] if len(ns) else ns)
            is_home = home[own] == here
            at_home = np.flatnonzero(is_home)
            x = units[own]
            crowded = table.column("crowded").take(pa.array(own[at_home])).fill_null(False).to_numpy().astype(bool)
            hits = _Hits(len(own))
            for a, b in chain(_search(x, lists, at_home[~crowded], least), _whole(x, at_home[crowded], least)):
                hits.add(a, b)
            members = table.column("shards").take(pa.array(own)).to_pylist()
            guests = np.flatnonzero(~is_home)
            theirs = home[own[guests]]
            weight, label, links, tied = copies[own], np.arange(len(own)), np.zeros(len(own), np.int64), []
            for first, met in hits.blocks():
                row = np.arange(first, first + len(met))
                if ta[own[0]] != tb[own[0]]:  # pairs inside a block belong to the tile of that block alone
                    met &= block[own[row]][:, None] != block[own][None, :]
                for i, r in enumerate(row.tolist()):
                    if not is_home[r]:
                        met[i] = False  # its pairs are counted from the other side
                    elif len(guests):
                        met[i, guests] &= ~(np.isin(theirs, members[r]) & (theirs < here))
                links[row] += met @ weight
                across = met & ~is_home[None, :]
                links += across.T @ weight[row]
                for i in np.flatnonzero(met.any(axis=1)).tolist():
                    to = np.flatnonzero(met[i])
                    groups, which = np.unique(label[to], return_index=True)
                    new = groups != label[first + i]
                    if new.any():
                        tied += [(first + i, j) for j in to[which[new]].tolist()]
                        label[np.isin(label, groups)] = label[first + i]
            some, (a, b) = np.flatnonzero(links), (np.array([t[k] for t in tied], np.int64) for k in (0, 1))
            for kind, u, v, n in ((0, some, some, links[some]), (1, a, b, np.zeros(len(a), np.int64))):
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(len(u), kind, np.int32), ids[u], ids[v], n)], ["kind", "u", "v", "n"])

    joined = rows.join(adjacency, "node", "left").select("shard", "tile_a", "tile_b", "block", "home", "shards", "node", "copies", "unit", "neighbours", "crowded")
    return joined.repartition(shards, "shard", "tile_a", "tile_b").mapInArrow(search, "kind int, u long, v long, n long")


def audit(nodes: DataFrame, links: DataFrame, dims: int, least: float, total: int, audited: int = AUDITED, draws: int = DRAWS) -> tuple[float, int]:
    """Mean share of a node's links that were found, against brute force over all vectors, over nodes chosen by hash that have any; and their number.

    Nodes are drawn until ``audited`` of them have true links, or all are drawn, but ``draws`` times at most: where links are so rare
    that few are seen, the share is that of the few. None seen gives 1.
    """
    every = 1 << 40
    place = F.pmod(F.xxhash64(F.lit(3), F.col("node")), F.lit(every))
    shares: list[float] = []
    lo, draw = 0, audited
    for _ in range(draws):
        if lo >= every or len(shares) >= audited:
            break
        hi = min(every, lo + max(1, every * draw // max(1, total)))
        mine = (place >= lo) & (place < hi)
        few = nodes.where(mine).select("node", "unit").collect()  # about as many as are drawn
        lo, draw = hi, min(8 * draw, DRAWN)
        if not few:
            continue
        asked = np.array([r["node"] for r in few], np.int64)
        sent = nodes.sparkSession.sparkContext.broadcast((asked, np.frombuffer(b"".join(bytes(r["unit"]) for r in few), "<f8").reshape(-1, dims)))

        def count(batches, sent=sent):
            asked, units = sent.value
            sums = np.zeros(len(asked), np.int64)
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    row, to = np.nonzero(_matrix(part.column(2), dims) @ units.T >= least)
                    other = part.column(0).to_numpy()[row] != asked[to]
                    sums += np.bincount(to[other], part.column(1).to_numpy()[row[other]], len(asked)).astype(np.int64)
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(asked[some]), pa.array(sums[some])], ["node", "n"])

        rows = nodes.select("node", "copies", "unit").mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()
        got = {r["node"]: r["n"] for r in links.where(mine).collect()}
        shares += [min(1.0, got.get(r["node"], 0) / r["n"]) for r in rows]
        sent.unpersist()
    return (float(np.mean(shares)), len(shares)) if shares else (1.0, 0)


def compared(nodes: DataFrame, dims: int, total: int, least: float) -> DataFrame:
    """All links by comparing all pairs, as :func:`found_links` gives them. Any two blocks meet in one task."""
    blocks = 1 if total <= BLOCK else max(BLOCKS, -(-total // MOST_BLOCK))

    def compare(batches):
        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        table = pa.Table.from_batches(batches)
        node, copies, ta, tb, block = (c.to_numpy() for c in _fields(batches, ["node", "copies", "tile_a", "tile_b", "block"]))
        order, starts, stops = _groups([ta, tb])
        for lo, hi in zip(starts.tolist(), stops.tolist(), strict=True):
            own = order[lo:hi]
            same = ta[own[0]] == tb[own[0]]
            first = own if same else own[block[own] == ta[own[0]]]
            other = own if same else own[block[own] == tb[own[0]]]
            x, y = (_matrix(table.column("unit").take(pa.array(o)), dims) for o in (first, other))
            at_first, at_other = (np.arange(len(own)),) * 2 if same else (np.arange(len(first)), len(first) + np.arange(len(other)))
            both = own if same else np.concatenate([first, other])
            ids, weight, label, links, tied = node[both], copies[both], np.arange(len(own)), np.zeros(len(own), np.int64), []
            for at in range(0, len(x), 256):
                a, b = np.nonzero(x[at : at + 256] @ y.T >= least)
                u, v = at_first[at + a], at_other[b]
                u, v = u[u != v], v[u != v]
                links += np.bincount(u, weight[v], len(weight)).astype(np.int64)
                if not same:
                    links += np.bincount(v, weight[u], len(weight)).astype(np.int64)
                for i, to in zip(u[(row := np.flatnonzero(np.diff(u, prepend=-1)))].tolist(), np.split(v, row[1:]), strict=False):
                    groups, which = np.unique(label[to], return_index=True)
                    new = groups != label[i]
                    if new.any():
                        tied += [(i, j) for j in to[which[new]].tolist()]
                        label[np.isin(label, groups)] = label[i]
            some, (a, b) = np.flatnonzero(links), (np.array([t[k] for t in tied], np.int64) for k in (0, 1))
            for kind, u, v, n in ((0, some, some, links[some]), (1, a, b, np.zeros(len(a), np.int64))):
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(len(u), kind, np.int32), ids[u], ids[v], n)], ["kind", "u", "v", "n"])

    dealt_out = nodes.select("node", "copies", "unit", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block"))
    dealt_out = dealt_out.withColumn("_y", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("tile_a", F.least("block", "_y")).withColumn("tile_b", F.greatest("block", "_y")).drop("_y")
    return dealt_out.repartition(blocks * (blocks + 1) // 2, "tile_a", "tile_b").mapInArrow(compare, "kind int, u long, v long, n long")


def _counted(found: DataFrame) -> DataFrame:
    """``node, n``: the links of each node."""
    return found.where("kind = 0").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))


def _searched(nodes: DataFrame, centres: np.ndarray, dims: int, shards: int, guests: int, least: float) -> DataFrame:
    """One pass: shards, graph, searches."""
    deal = dealt(nodes, centres, guests) if shards <= len(centres) else dealt_by_cells(nodes, centres, shards, guests)
    rows = tiled(staged(deal, "shards"), "shard", F.xxhash64("node"), TILE)
    return staged(found_links(rows, graph(rows, dims, shards, least), dims, shards, least), "links")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, recall: float = 0.98, guests: int = 3) -> DataFrame:
    """Links and components of all rows' vectors: ``id, n_links, component_id, kept``.

    Linked are two rows whose cosine in double precision is at least ``least``; equal vectors always are. n_links counts the rows
    that a row is linked with, component_id is the smallest id that links reach, and kept marks the row whose id that is. One row
    for each row of df; ids are integers. A null, empty or zero vector, or one with a null or non-finite component, has no links,
    as has a row with a null id, whose component_id is null. Vectors of a length that not most have are compared among their own kind.
    Other columns are not read. All links found are true; at least ``recall`` of the true ones are found, by an audit of every pass, or
    all of them where passes fell short and the pairs were compared.
    """
    nodes = staged(nodes_of(df, id_col, vector_col), "vectors")
    kinds = [r["dims"] for r in nodes.groupBy("dims").count().orderBy("dims").collect()]  # lengths of vectors, few
    links = edges = None
    for dims in kinds:
        own = nodes.where(F.col("dims") == dims)
        total = own.count()
        every = 1 << 40
        sample = own.where(F.pmod(F.xxhash64("node"), F.lit(every)) < int(min(1.0, SAMPLE / total) * every)).select("unit").orderBy("unit").collect()
        units = np.frombuffer(b"".join(bytes(r["unit"]) for r in sample), "<f8").reshape(-1, dims)
        shards = max(1, min(-(-total // SHARD), len(units) // 4 if total <= SHARD * MOST_SHARDS else total))
        centres = centres_of(units, min(shards, MOST_SHARDS)) if len(units) else np.zeros((1, dims))
        more = guests
        while True:
            found = _searched(own, centres, dims, shards, more, least)
            counted = _counted(found)
            if audit(own, counted, dims, least, total)[0] >= recall:
                break
            more = 2 * more + 1
            if more > MOST_GUESTS or more // 2 + 1 >= shards:  # as many guests do not help, or there are no more shards
                found = staged(compared(own, dims, total, least), "links")
                counted = _counted(found)
                break
        tied = found.where("kind = 1").select("u", "v")
        links, edges = (counted, tied) if links is None else (links.unionByName(counted), edges.unionByName(tied))
    rows = df.select(df[id_col].cast("long").alias("id"), F.xxhash64(df[vector_col]).alias("k1"), F.xxhash64(F.lit(5), df[vector_col]).alias("k2"), usable(df[vector_col]).alias("some"))
    if links is None:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    named = nodes.select("k1", "k2", "node", "copies").join(links, "node", "left").join(components(edges), "node", "left")
    out = rows.join(named, ["k1", "k2"], "left")
    linked = F.col("node").isNotNull() & F.col("some") & F.col("id").isNotNull()
    component = F.when(linked, F.coalesce("component", "node")).otherwise(F.col("id"))
    n_links = F.when(linked, F.coalesce("n", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0))
    return out.select("id", n_links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
