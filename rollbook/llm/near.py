"""Near-duplicate documents by word shingles: SuperMinHash signatures, banding, exact verification, union-find.

1. One pass makes each text's shingle set, the set's key and its signature. Texts of equal sets form a class; from here on a class
   counts once, however many copies it has.
2. Each band of a signature is a bucket key. In a bucket, classes whose short sketches look alike are tied into families, as a
   forest: no pairs are listed. A bucket of very many classes is dealt over tiles, each a pair of blocks.
3. A family's texts come together, a large family's over tiles again, and pairs are verified on their full sets in the order of
   estimated similarity, leaving out those that earlier pairs connect. Only a forest of verified links leaves a task.
4. Components of these links give every class, and so every document, the smallest id that it can reach.

The only chance is in 2: a pair of similarity 0.75 shares none of 32 bands of 4 slots once in 190,000 pairs, or its sketch falls
below the threshold about as rarely; more similar pairs far more rarely still.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .components import components
from .shingles import WORDS, set_keys, shingle_sets, super_minhash
from .tasks import lean
from .words import CHARS_AT_ONCE, text_groups

BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
#: Classes of a bucket or family that meet in one task; larger ones are dealt over tiles of two blocks of half as many.
TILE = 8192
#: Of 128 slots' last two bits, as many must agree: about 4.5 standard deviations below the mean at similarity 0.75.
ALIKE = 84
#: Pairs of a family that a task holds as Python objects.
PAIRS_AT_ONCE = 1 << 16


def signatures(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``id, text_hash, n_shingles, k1, k2`` of each row, and at a class's first row in a task its ``signature``, 16 bits a slot."""

    def sign(batches):
        known: set[tuple[int, int]] = set()
        for part, texts in text_groups(batches, "text", CHARS_AT_ONCE // 2):
            hashes, counts = shingle_sets(texts, words)
            keys = set_keys(hashes, counts)
            pairs = list(zip(*keys.tolist(), strict=True))
            new = np.zeros(len(pairs), bool)
            for i, k in enumerate(pairs):
                if counts[i] and k not in known:
                    known.add(k)
                    new[i] = True
            ranks = super_minhash(hashes[np.repeat(new, counts)], counts[new], SLOTS)
            short = (ranks & np.uint64(0xFFFF)).astype("<u2")
            rows = iter(short)
            signature = [next(rows).tobytes() if x else None for x in new.tolist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(counts, pa.int64()), pa.array(keys[0]), pa.array(keys[1]), pa.array(signature, pa.binary())],
                ["id", "text_hash", "n_shingles", "k1", "k2", "signature"])

    rows = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(lean(sign), "id long, text_hash long, n_shingles long, k1 long, k2 long, signature binary")


def _bucket_rows(classes: DataFrame) -> DataFrame:
    """A row for each class and band: bucket, class, size and a sketch of two bits a slot."""

    def cut(batches):
        shifts = np.array([0, 2, 4, 6], np.uint8)
        for b in batches:
            raw = b"".join(b.column(b.num_columns - 1).to_pylist())
            slots = np.frombuffer(raw, "<u2").reshape(-1, SLOTS)
            n = len(slots)
            if not n:
                continue
            low = (slots & 3).astype(np.uint8).reshape(n, -1, 4)
            sketch = np.bitwise_or.reduce(low << shifts, axis=2)
            keys = np.frombuffer(raw, "<u8").reshape(n, BANDS)
            with np.errstate(over="ignore"):
                bucket = (keys ^ (np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))).ravel().view(np.int64)
            each = pa.array(np.repeat(np.arange(n), BANDS))
            sketches = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SLOTS // 4), n, [None, pa.py_buffer(np.ascontiguousarray(sketch).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(bucket), *(b.column(i).take(each) for i in (0, 1, 2)), sketches.take(each)], ["bucket", "k1", "k2", "n", "sketch"])

    return classes.select("k1", "k2", "n", "signature").mapInArrow(lean(cut), "bucket long, k1 long, k2 long, n long, sketch binary")


def tiled(df: DataFrame, group: str, spread: Column, tile: int, counted: DataFrame | None = None) -> DataFrame:
    """Deal the rows of groups of more than tile rows over tiles, so that any two rows of a group meet in some tile.

    Adds ``tile_a, tile_b`` and ``block``. A small group has the one tile (0, 0). In a large one, a row of block x goes to the tiles
    (x, y) and (y, x) of every block y. How large groups are is counted with a reduction before the shuffle, over ``counted`` if it is given:
    rows of the same groups that take less to make.
    """
    sizes = (df if counted is None else counted).groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") > tile)
    blocks = F.ceil(F.col("_n") / F.lit(tile // 2)).cast("int")
    dealt = df.join(sizes, group, "left").withColumn("_blocks", F.coalesce(blocks, F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(spread, F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.withColumn("tile_a", F.least("block", "_y")).withColumn("tile_b", F.greatest("block", "_y")).drop("_n", "_blocks", "_y")


class Forest:
    """Union-find over numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def tie(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slots in which two sketches, as rows of 64-bit words, have the same two bits."""
    z = x ^ y
    z = (z | (z >> np.uint64(1))) & np.uint64(0x5555555555555555)
    return SLOTS - np.bitwise_count(z).sum(axis=-1, dtype=np.int64)


def _alike(sketches: np.ndarray, sizes: np.ndarray, share: tuple[int, int], rows: int = 64):
    """Index pairs (a < b) of a group whose sizes allow the similarity and whose sketches agree often enough, a block of rows at a time."""
    order = np.argsort(sizes, kind="stable")
    s, n = sketches[order], sizes[order]
    words = s.view(np.uint64)
    reach = np.searchsorted(n, n * share[1] // share[0], "right")  # the largest partner that the size allows
    for lo in range(0, len(s), rows):
        hi = min(len(s), lo + rows)
        top = int(reach[hi - 1])
        same = _agreeing(words[lo:hi, None, :], words[None, lo:top, :])
        a, b = np.nonzero(same >= ALIKE)
        keep = (b > a) & (b + lo < reach[a + lo])
        if keep.any():
            yield order[a[keep] + lo], order[b[keep] + lo], same[a[keep], b[keep]]


def _sketched(texts: pa.ChunkedArray, words: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The shingle sets of a family's texts, their sizes and their sketches. Some texts at a time are Python objects."""
    sets, sizes, sketches = [], [], []
    for _, some in text_groups(pa.table({"text": texts}).to_batches(), "text", CHARS_AT_ONCE // 2):
        hashes, counts = shingle_sets(some, words)
        low = (super_minhash(hashes, counts, SLOTS) & np.uint64(3)).astype(np.uint8).reshape(len(some), -1, 4)
        sets += np.split(hashes, np.cumsum(counts)[:-1])
        sizes.append(counts)
        sketches.append(np.bitwise_or.reduce(low << np.array([0, 2, 4, 6], np.uint8), axis=2))
    return sets, np.concatenate(sizes), np.concatenate(sketches)


def _likeliest_first(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """The pairs of what _alike gives, by agreeing slots."""
    i, j, same = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.argsort(SLOTS - same, kind="stable")
    for lo in range(0, len(order), PAIRS_AT_ONCE):
        some = order[lo : lo + PAIRS_AT_ONCE]
        yield from zip(i[some].tolist(), j[some].tolist(), strict=True)


def _groups(keys: list[np.ndarray]):
    """Order that brings equal keys together, and the runs."""
    order = np.lexsort(keys[::-1])
    change = np.zeros(len(order), bool)
    if len(order):
        change[0] = True
    for k in keys:
        k = k[order]
        change[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(change)
    return order, starts, np.append(starts[1:], len(order))


def _fields(batches, names: list[str]) -> list:
    table = pa.Table.from_batches(batches)
    return [table.column(c) for c in names]


def families(classes: DataFrame, share: tuple[int, int]) -> DataFrame:
    """``k1, family`` of every class that looks like another one in some bucket; the family is its lowest k1."""

    def tie(batches):
        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        cols = _fields(batches, ["bucket", "tile_a", "tile_b", "k1", "k2", "n"])
        bucket, ta, tb, k1, k2, n = (c.to_numpy() for c in cols)
        raw = pa.Table.from_batches(batches).column("sketch")
        sketch = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(-1, SLOTS // 4)
        order, starts, stops = _groups([bucket, ta, tb])
        _, node = np.unique(k1, return_inverse=True)
        forest, out = Forest(len(k1)), []
        several = stops - starts > 1
        two = stops - starts == 2
        a, b = order[starts[two]], order[starts[two] + 1]
        same = _agreeing(sketch[a].view(np.uint64), sketch[b].view(np.uint64))
        fits = (same >= ALIKE) & (np.minimum(n[a], n[b]) * share[1] >= np.maximum(n[a], n[b]) * share[0])
        for i, j in zip(a[fits].tolist(), b[fits].tolist(), strict=True):
            if forest.tie(int(node[i]), int(node[j])):
                out.append((k1[i], k1[j]))
        for lo, hi in zip(starts[several & ~two].tolist(), stops[several & ~two].tolist(), strict=True):
            own = order[lo:hi]
            for i, j, _ in _alike(np.ascontiguousarray(sketch[own]), n[own], share):
                for p, q in zip(own[i].tolist(), own[j].tolist(), strict=True):
                    if forest.tie(int(node[p]), int(node[q])):
                        out.append((k1[p], k1[q]))
        u, v = (np.array([e[k] for e in out], np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    rows = tiled(_bucket_rows(classes), "bucket", F.xxhash64("k1", "k2"), TILE)
    edges = rows.repartition("bucket", "tile_a", "tile_b").mapInArrow(lean(tie), "u long, v long")
    return components(edges).select(F.col("node").alias("k1"), F.col("component").alias("family"))


def verified_links(members: DataFrame, share: tuple[int, int], words: int) -> DataFrame:
    """A forest of the verified links of each tile: ``u, v``, nodes of the classes. members: ``family, tile_a, tile_b, block, node, text``."""

    def verify(batches):
        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        family, ta, tb, block, node = (c.to_numpy() for c in _fields(batches, ["family", "tile_a", "tile_b", "block", "node"]))
        texts = pa.Table.from_batches(batches).column("text")
        order, starts, stops = _groups([family, ta, tb])
        for lo, hi in zip(starts.tolist(), stops.tolist(), strict=True):
            own = order[lo:hi]
            if hi - lo < 2:
                continue
            sets, counts, sketch = _sketched(texts.take(pa.array(own)), words)
            # in a tile of two blocks, pairs inside a block belong to the tile of that block alone
            cross = bool((ta[own[0]] != tb[own[0]]))
            forest, found, blocks = Forest(hi - lo), [], block[own]
            pairs = []
            for i, j, same in _alike(sketch, counts, share):
                apart = blocks[i] != blocks[j] if cross else slice(None)
                pairs.append((i[apart].astype(np.int32), j[apart].astype(np.int32), same[apart].astype(np.uint8)))
            if not pairs:
                continue
            for p, q in _likeliest_first(pairs):  # so that most of the others need no look
                if forest.root(p) == forest.root(q):
                    continue
                both = len(sets[p]) + len(sets[q])
                merged = np.concatenate([sets[p], sets[q]])
                merged.sort()
                common = int((merged[1:] == merged[:-1]).sum())
                if share[1] * common >= share[0] * (both - common):
                    forest.tie(p, q)
                    found.append((p, q))
            if found:
                u, v = (node[own[[e[k] for e in found]]] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return members.repartition("family", "tile_a", "tile_b").mapInArrow(lean(verify), "u long, v long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: tuple[int, int] = (75, 100), words: int = WORDS) -> DataFrame:
    """Groups of documents that links of similar shingle sets connect: ``id, n_shingles, component_id, kept``.

    Linked are texts of which share[0] / share[1] of all distinct shingles of both are common; component_id is the smallest id that
    links reach, kept marks the row whose id that is. One row for each row of df, in which ids are integers. Texts without words,
    null or empty ones have no shingles and no links. A row without an id has null for component_id, is not kept and links
    nothing. Rows with one id count as one document: what one of them links is linked. Texts may be of any length: a task holds one at
    least as a whole. Other columns are not read.
    """
    signed = staged(signatures(df, id_col, text_col, words), "signatures")
    named = signed.where("id IS NOT NULL AND n_shingles > 0")
    # of each class the lowest id, whose text stands for all, and the first signature: tasks may each have sent one
    classes = named.groupBy("k1", "k2").agg(F.min(F.struct("id", "text_hash")).alias("first"))
    signature = signed.where("signature IS NOT NULL").select("k1", "k2", F.col("n_shingles").alias("n"), "signature").dropDuplicates(["k1", "k2"])
    of_class = classes.select("k1", "k2", F.col("first.id").alias("node"), F.col("first.text_hash").alias("text_hash"))
    family = families(signature, share)
    wanted = of_class.join(family, "k1").select("node", "text_hash", "family")
    texts = df.select(df[id_col].cast("long").alias("node"), df[text_col].alias("text")).withColumn("text_hash", F.xxhash64("text"))
    members = texts.join(wanted, ["node", "text_hash"]).select("family", "node", "text")
    # ids may repeat: classes of one id are one node, which loops and repeated edges don't disturb
    links = verified_links(tiled(members, "family", F.xxhash64("node"), TILE // 4, wanted), share, words)
    repeated = named.groupBy("id").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b").select(F.col("id").alias("node"))
    same_id = named.join(repeated, named["id"] == repeated["node"], "left_semi").select("id", "k1", "k2").join(of_class.select("k1", "k2", "node"), ["k1", "k2"])
    reached = components(links.unionByName(same_id.select(F.col("id").alias("u"), F.col("node").alias("v"))))
    lowest = staged(of_class.join(reached, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("lowest")), "classes")  # joined as a plain table: a class may have very many rows
    out = signed.select("id", "n_shingles", "k1", "k2").join(lowest, ["k1", "k2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("lowest", "id"))
    return out.select("id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
