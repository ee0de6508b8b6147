"""Codes for vectors: each is cut into parts, and a part is told by the nearest of a few entries, found by ball k-means.

The entries of a part position are balls: an entry and the parts assigned to it. When the entries have moved, most parts need not be
compared with all of them, as an entry can only take over a part (or tie for it) that lies at least half as far from its own entry as
the two entries are apart. So, with all distances squared and exact:

- A ball's radius, its farthest part, tells which entries are neighbours at all: those within twice the radius.
- Parts nearer than half the distance of the nearest neighbour are the stable core: they stay without a look at other entries.
- The others lie in rings between half the distances of neighbours one after another; a part is compared with the neighbours whose
  half distance its own ring has reached, ring by ring (rings with up to twice as many neighbours together), and no others.

Radii are those of the parts that a task has at hand, so each task finds its own neighbours and nothing has to be gathered for them. Only
the first assignment, when no balls are known, compares all. All arithmetic is in integers, or in doubles that hold them exactly.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import delete_path, staged, work_dir

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that a task assigns at once.
ROWS_AT_ONCE = 40_000


def _exact(values: np.ndarray, entries: np.ndarray) -> type:
    """Doubles where sums of squared differences have at most 53 bits, else 64-bit integers."""
    top = max(int(np.abs(values).max(initial=0)), int(np.abs(entries).max(initial=0)))
    return np.float64 if 4 * values.shape[1] * top * top < 1 << 53 else np.int64


def nearest(values: np.ndarray, entries: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each row of values (ties to the lower number) and its squared distance, given the rows' entries before,
    if there are any. Also the number of distances that were worked out."""
    kind = _exact(values, entries)
    x, c = values.astype(kind), entries.astype(kind)
    squares = (c * c).sum(axis=1)
    best = np.zeros(len(x), np.int64)
    if before is None:
        for a in range(0, len(x), 4096):
            best[a : a + 4096] = (squares - 2 * (x[a : a + 4096] @ c.T)).argmin(axis=1)
        return best, _squared(x, c, best), len(x) * len(c)
    own = _squared(x, c, before)
    apart = squares[:, None] + squares - 2 * (c @ c.T)
    near = np.argsort(apart, axis=1, kind="stable")
    apart = np.take_along_axis(apart, near, 1)
    best[:] = before
    order = np.lexsort((own, before))  # ball by ball, from the core outwards
    edges = np.searchsorted(before[order], np.arange(len(c) + 1))
    looked = len(x)
    for ball in range(len(c)):
        inside = order[edges[ball] : edges[ball + 1]]
        if not len(inside):
            continue
        reach = np.searchsorted(apart[ball], 4 * own[inside], "right")  # neighbours within reach, the ball's own entry among them
        level = np.frexp(np.maximum(reach - 1, 0).astype(float))[1]  # 0 is the stable core
        a = int(np.searchsorted(level, 1))
        while a < len(inside):
            b = int(np.searchsorted(level, level[a], "right"))
            rivals = np.sort(near[ball, : reach[b - 1]])
            ring = inside[a:b]
            best[ring] = rivals[(squares[rivals] - 2 * (x[ring] @ c[rivals].T)).argmin(axis=1)]
            looked += len(ring) * len(rivals)
            a = b
    return best, np.where(best == before, own, _squared(x, c, best)), looked


def _squared(x: np.ndarray, c: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for a in range(0, len(x), 8192):
        off = x[a : a + 8192] - c[at[a : a + 8192]]
        out[a : a + 8192] = (off * off).sum(axis=1)
    return out


def _groups(batches):
    """Batches together, as long as they have few enough rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= ROWS_AT_ONCE:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Rows of equally long binaries as a table of integers."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def scaled_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str | None, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """``id, label, size, whole``: components as floor(scale * x), 32-bit integers in a row, padded with zeros to parts of equal length.

    Vectors that are null or empty or hold null or non-finite components are left out, and so are those with a component so large that
    the squared distances of their length need not fit in 64 bits.
    """
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    rows = df.select(F.col(id_col).alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where("v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL)")

    def scale_up(batches):
        for batch in batches:
            v = batch.column(2)
            size = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            x = np.floor(v.flatten().to_numpy(zero_copy_only=False) * scale)
            ends = np.cumsum(size)
            row = np.repeat(np.arange(len(size)), size)
            #: (2 * limit)**2 * length < 2**62, and what int32 holds.
            limit = np.minimum(np.sqrt((1 << 60) / np.maximum(size, 1)), (1 << 31) - 1.0)
            with np.errstate(invalid="ignore"):
                fits = np.isfinite(x) & (np.abs(x) < limit[row])
            good = np.bincount(row[~fits], minlength=len(size)) == 0
            x = np.where(fits, x, 0).astype("<i4")
            keep = np.flatnonzero(good)
            pad = b"\0" * 4
            whole = [x[ends[i] - size[i] : ends[i]].tobytes() + pad * (-int(size[i]) % parts) for i in keep.tolist()]
            taken = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), pa.array(size[keep]), pa.array(whole, pa.binary())], ["id", "label", "size", "whole"])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "label")]
    return rows.mapInArrow(scale_up, f"{', '.join(kinds)}, size long, whole binary")


def _assigned(rows: DataFrame, books: np.ndarray, known: bool) -> DataFrame:
    """Every vector with its entries (one byte for each part) and the sum of its squared distances."""
    parts, _, width = books.shape

    def assign(batches):
        for batch in _groups(batches):
            x = _matrix(batch.column(2), "<i4").reshape(-1, parts, width).astype(np.int64)
            before = _matrix(batch.column(3), np.uint8).astype(np.int64) if known else None
            codes, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                best, squared, _ = nearest(x[:, p], books[p], None if before is None else before[:, p])
                codes[:, p] = best
                error += squared
            raw = codes.tobytes()
            code = pa.array([raw[k * parts : (k + 1) * parts] for k in range(len(x))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], code, pa.array(error)], ["id", "label", "whole", "code", "error"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "label", "whole"))
    return rows.mapInArrow(assign, f"{kinds}, code binary, error long")


def _sums(rows: DataFrame, parts: int, width: int, n_entries: int) -> tuple[np.ndarray, np.ndarray]:
    """How many parts each entry has, and their sums; a task gives one row for each entry, the driver gets them added up."""

    def add(batches):
        total, count = np.zeros((parts, n_entries, width), np.int64), np.zeros((parts, n_entries), np.int64)
        for batch in _groups(batches):
            x, code = _matrix(batch.column(0), "<i4").reshape(-1, parts, width), _matrix(batch.column(1), np.uint8)
            for p in range(parts):
                order = np.argsort(code[:, p], kind="stable")
                heads = np.flatnonzero(np.diff(code[order, p].astype(np.int64), prepend=-1))
                own = code[order[heads], p]
                total[p, own] += np.add.reduceat(x[order, p].astype(np.int64), heads, axis=0)
                count[p] += np.bincount(code[:, p], minlength=n_entries)
        at = np.flatnonzero(count.ravel())
        sums = [total.reshape(-1, width)[i].tolist() for i in at.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count.ravel()[at]), pa.array(sums, pa.list_(pa.int64()))], ["entry", "n", "sums"])

    added = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    total, count = np.zeros((parts * n_entries, width), np.int64), np.zeros(parts * n_entries, np.int64)
    got = rows.select("whole", "code").mapInArrow(add, "entry long, n long, sums array<long>").groupBy("entry").agg(F.sum("n").alias("n"), *added)
    for r in got.collect():
        count[r["entry"]], total[r["entry"]] = r["n"], r[2:]
    return total.reshape(parts, n_entries, width), count.reshape(parts, n_entries)


def books_digest(books: np.ndarray) -> str:
    """Hex digest of all entries' components as decimals, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
    parts: int = PARTS, n_entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors, ``id, code, error, label_error``, and the codebooks (part, entry, position).

    ``code`` is one byte for each part, ``error`` the sum of the parts' squared distances in scaled integers, ``label_error`` the
    sum of the errors of all rows with that label, nulls together. The books start as the parts of the ``n_entries`` (256 at most)
    vectors of lowest id; ``rounds`` times all parts are assigned and every entry becomes its parts' mean, rounded down; entries without
    parts stay. Then parts are assigned once more.

    Left out are vectors that :func:`scaled_vectors` leaves out and those whose length is not the most frequent one (of equally
    frequent ones, the longest). Repeated rows count each; equal ids are ordered by vector, null ids come last. With fewer vectors
    than entries there are as many entries as vectors. No vectors: no rows and empty books. Extra columns are not read.

    Each round writes the vectors with their codes once to the shared folder and deletes what the round before wrote. The driver
    gets one row for each entry.
    """
    if not 0 < n_entries <= 256:
        raise ValueError("a code has one byte for each part")
    spark = df.sparkSession
    rows = staged(scaled_vectors(df, id_col, vector_col, label_col, parts, scale), "vectors")
    kind = rows.schema["id"].dataType.simpleString()
    usual = rows.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not usual:
        return spark.createDataFrame([], f"id {kind}, code binary, error long, label_error long"), np.zeros((parts, 0, 0), np.int64)
    rows = rows.where(F.col("size") == usual[0]["size"]).select("id", "label", "whole")
    width = math.ceil(usual[0]["size"] / parts)
    first = rows.orderBy(F.asc_nulls_last("id"), "whole").limit(n_entries).select("whole").collect()
    books = np.stack([np.frombuffer(r["whole"], "<i4").reshape(parts, width) for r in first], 1).astype(np.int64)
    last = None
    for k in range(rounds):
        path = work_dir(spark, "codes")
        _assigned(rows, books, k > 0).drop("error").write.parquet(path)
        rows = spark.read.parquet(path)
        total, count = _sums(rows, parts, width, books.shape[1])
        books = np.where(count[:, :, None] > 0, total // np.maximum(count, 1)[:, :, None], books)
        if last:
            delete_path(spark, last)
        last = path
    coded = staged(_assigned(rows, books, rounds > 0).drop("whole"), "coded")
    if last:
        delete_path(spark, last)
    by_label = staged(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("id", "code", "error", "label_error"), books
