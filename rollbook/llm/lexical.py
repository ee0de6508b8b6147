"""Ranked lexical search: the highest products of item vectors and document vectors, without scoring every pair.

An item is a vector of term weights, a document one of term impacts; the score is their product. A task orders its documents by the
length of their impact vectors and cuts them into buckets, the longest first. For an item whose tenth best score is known so far:

1. By Cauchy-Schwarz no document of a bucket scores above the item's length times that of the bucket's longest document. An item
   whose tenth best score is higher leaves the bucket, and as later buckets are shorter and scores only rise, all later ones too.
2. Inside a bucket each coordinate has a highest impact. The item's coordinates are taken from the heaviest on until the rest can't
   reach the tenth best score any more, neither by those impacts nor by length. Only documents on the lists of the coordinates
   taken are looked at, and of them those whose sum so far, with the most that the rest may add, reaches it.
3. What survives is scored exactly, in integers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .near import _fields
from .terms import Runs, Terms
from .words import ragged, text_groups

#: Code points of items that are searched for in one pass over the documents, about.
ITEM_CHARS = 4_000_000
#: Documents in a bucket; entries of document vectors that a task orders at once, and documents at most.
BUCKET, ENTRIES, DOCUMENTS = 2048, 4_000_000, 65_536
#: Bounds are sums of doubles; they are taken this much larger.
SLACK = 1 + 1e-9


def _divided(factors: np.ndarray, times: int, by: int) -> np.ndarray:
    """(factors * times) // by, also where the product has more than 64 bits."""
    if len(factors) and int(factors.max()) * times >= 1 << 63:
        return np.array([x * times // by for x in factors.tolist()], np.int64)
    return factors * times // by


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """Weight of terms that so many of the documents hold."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each occurrence of a term gives its document; tf: how often it is there, n: how many terms the document has."""
    m = 25 + _divided(75 * n, n_docs, n_terms)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Items:
    """Items of one pass as vectors: per item its terms, the heaviest first, and their weights times their number in the item."""

    def __init__(self, ids: pa.Array, texts: list[str]):
        runs = Runs(texts)
        self.ids, self.terms, self.text = ids, Terms(runs), runs.text
        self.number = self.terms.number

    def weigh(self, weights: np.ndarray) -> None:
        self.vectors = []
        cut = np.searchsorted(self.text, np.arange(len(self.ids) + 1))
        for a, b in zip(cut.tolist(), cut[1:].tolist(), strict=False):
            terms, count = np.unique(self.number[a:b], return_counts=True)
            q = count * weights[terms]
            terms, q = terms[q > 0], q[q > 0]
            order = np.lexsort((terms, -q))
            q = q[order].astype(float)
            rest = np.sqrt(np.append(np.cumsum((q * q)[::-1])[::-1], 0.0))  # length of the vector from each coordinate on
            self.vectors.append((terms[order], q, rest))


class Bucket:
    """Documents of similar length, by their rows and by their terms."""

    def __init__(self, rows: np.ndarray, ptr: np.ndarray, term: np.ndarray, impact: np.ndarray, norm: np.ndarray):
        self.rows, self.norm, self.n = rows, norm[rows], len(rows)
        sizes = ptr[rows + 1] - ptr[rows]
        at = ragged(ptr[rows], sizes)
        self.ptr = np.concatenate([[0], np.cumsum(sizes)])
        self.term, self.impact = term[at], impact[at]
        order = np.argsort(self.term, kind="stable")
        self.by_term, self.by_impact, self.by_doc = self.term[order], self.impact[order], np.repeat(np.arange(self.n), sizes)[order]
        heads = np.flatnonzero(np.concatenate([[True], self.by_term[1:] != self.by_term[:-1]]))
        self.heads, self.ends = heads, np.append(heads[1:], len(self.by_term))
        self.found, self.highest = self.by_term[heads], np.maximum.reduceat(self.by_impact, heads).astype(float)

    def search(self, vector: tuple[np.ndarray, np.ndarray, np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Documents, by their place in the bucket, and scores above 0 that reach least; None if no shorter document can reach it either."""
        terms, q, rest = vector
        if rest[0] * self.norm[0] * SLACK < least:
            return None
        at = np.minimum(np.searchsorted(self.found, terms), len(self.found) - 1)
        here = self.found[at] == terms
        at, q_here = at[here], q[here]
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        most = np.append(np.cumsum((q_here * self.highest[at])[::-1])[::-1], 0.0)
        length = np.sqrt(np.append(np.cumsum((q_here * q_here)[::-1])[::-1], 0.0))
        low = np.flatnonzero(np.minimum(most, length * self.norm[0]) * SLACK < least)
        taken = int(low[0]) if len(low) else len(at)
        if not taken:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = self.ends[at[:taken]] - self.heads[at[:taken]]
        on = ragged(self.heads[at[:taken]], sizes)
        doc = self.by_doc[on]
        sums = np.bincount(doc, weights=np.repeat(q_here[:taken], sizes) * self.by_impact[on], minlength=self.n)
        can = (sums > 0) & ((sums + np.minimum(most[taken], length[taken] * self.norm)) * SLACK >= least)
        alive = np.flatnonzero(can)
        score = self.exact(alive, terms, q)
        good = (score >= least) & (score > 0)
        return alive[good], score[good]

    def exact(self, docs: np.ndarray, terms: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The scores of documents in integers."""
        if not len(docs):
            return np.zeros(0, np.int64)
        sizes = self.ptr[docs + 1] - self.ptr[docs]
        on = ragged(self.ptr[docs], sizes)
        order = np.argsort(terms)
        at = np.minimum(np.searchsorted(terms[order], self.term[on]), len(terms) - 1)
        weight = np.where(terms[order][at] == self.term[on], q[order].astype(np.int64)[at], 0)
        return np.add.reduceat(weight * self.impact[on], np.cumsum(sizes) - sizes)


def _vectors(docs: DataFrame, items: Items) -> DataFrame:
    """``id, n, terms, tf``: every document's number of terms, and which of the items' terms it holds how often (32-bit integers)."""

    def read(batches):
        n_terms = len(items.terms)
        for part, texts in text_groups(batches, "text"):
            runs = Runs(texts)
            number = items.terms.find(runs)
            held = number >= 0
            key, tf = np.unique(runs.text[held] * n_terms + number[held], return_counts=True)
            cut = np.searchsorted(key, np.arange(len(texts) + 1) * n_terms)
            raw_terms, raw_tf = (key % max(n_terms, 1)).astype("<i4").tobytes(), tf.astype("<i4").tobytes()
            spans = [(4 * a, 4 * b) for a, b in zip(cut.tolist(), cut[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(runs.counts, pa.int64()), pa.array([raw_terms[a:b] for a, b in spans], pa.binary()), pa.array([raw_tf[a:b] for a, b in spans], pa.binary())],
                ["id", "n", "terms", "tf"])

    return docs.mapInArrow(read, f"id {docs.schema['id'].dataType.simpleString()}, n long, terms binary, tf binary")


def _held_by(vectors: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term; the driver gets one row for each term of the items."""

    def count(batches):
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            terms = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4")
            total += np.bincount(terms, minlength=n_terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for r in vectors.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


def _chunks(batches):
    """Rows of some batches together, as long as their entries are few enough."""
    held, entries, rows = [], 0, 0
    for batch in batches:
        at = 0
        sizes = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64) // 4)
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, base + ENTRIES - entries, "right")))
            to = min(to, at + DOCUMENTS - rows)
            held.append(batch.slice(at, to - at))
            entries, rows, at = entries + int(sizes[to - 1] - base), rows + to - at, to
            if entries >= ENTRIES or rows >= DOCUMENTS or at < batch.num_rows:
                yield held
                held, entries, rows = [], 0, 0
    if held:
        yield held


def _best(vectors: DataFrame, items: Items, n_docs: int, n_terms: int, k: int, item_type: str) -> DataFrame:
    """``item, item_id, doc_id, score``: of each task, at least the k best documents of each item."""

    def search(batches):
        least = np.zeros(len(items.vectors), np.int64)
        for held in _chunks(batches):
            ids, n, terms, tf = _fields(held, ["id", "n", "terms", "tf"])
            raw_terms, raw_tf = terms.to_pylist(), tf.to_pylist()
            sizes = np.fromiter(map(len, raw_terms), np.int64, len(raw_terms)) // 4
            ptr = np.concatenate([[0], np.cumsum(sizes)])
            term = np.frombuffer(b"".join(raw_terms), "<i4").astype(np.int64)
            impact = impacts(np.frombuffer(b"".join(raw_tf), "<i4").astype(np.int64), np.repeat(n.to_numpy(), sizes), n_docs, n_terms)
            ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
            rank = np.empty(len(ids), np.int64)
            rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
            filled = np.flatnonzero(sizes)
            if not len(filled):
                continue
            norm = np.zeros(len(ids))
            norm[filled] = np.sqrt(np.add.reduceat(impact.astype(float) ** 2, ptr[filled]))
            order = filled[np.argsort(-norm[filled], kind="stable")]
            top = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items.vectors]
            going = [j for j, v in enumerate(items.vectors) if len(v[0])]
            for a in range(0, len(order), BUCKET):
                if not going:
                    break
                bucket = Bucket(order[a : a + BUCKET], ptr, term, impact, norm)
                still = []
                for j in going:
                    got = bucket.search(items.vectors[j], int(least[j]))
                    if got is None:
                        continue
                    still.append(j)
                    if len(got[0]):
                        docs = np.concatenate([top[j][0], bucket.rows[got[0]]])
                        score = np.concatenate([top[j][1], got[1]])
                        best = np.lexsort((rank[docs], -score))[:k]
                        top[j] = docs[best], score[best]
                        if len(best) == k:
                            least[j] = max(least[j], score[best[-1]])
                going = still
            found = np.repeat(np.arange(len(top)), [len(t[0]) for t in top])
            if len(found):
                docs, score = (np.concatenate([t[i] for t in top]) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(found), items.ids.take(pa.array(found)), ids.take(pa.array(docs)), pa.array(score)], ["item", "item_id", "doc_id", "score"])

    doc_type = vectors.schema["id"].dataType.simpleString()
    return vectors.mapInArrow(search, f"item long, item_id {item_type}, doc_id {doc_type}, score long")


def ranked_search(
    items: DataFrame, docs: DataFrame, k: int = 10, item_id: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text", item_chars: int = ITEM_CHARS
) -> DataFrame:
    """The k best documents of each item: ``item_id, rank`` (from 1), ``doc_id, score``; scores are above 0, equal ones by ascending id.

    Every row of items is an item of its own, every row of docs a document, so repeated rows count again; a null id comes last among
    ties. A null or empty text has no terms; an item without terms has no results, a document without is in no result and not
    counted. Without documents there are no rows. Extra columns are not read. Texts may be of any length.

    Items are dealt into passes of about ``item_chars`` code points, each one scan of the documents that writes the items' terms of
    every document to the shared folder. The driver gets the items of a pass and one number for each of their terms; a task
    holds a bounded part of the vectors and gives at most k rows an item for each such part.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), F.coalesce(item_text, F.lit("")).alias("text"))
    item_type, doc_type = asked.schema["item_id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    passes = max(1, -(-int(asked.agg(F.sum(F.length("text"))).first()[0] or 0) // item_chars))
    out = None
    for k_pass in range(passes):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k_pass).orderBy("item_id", "text").toArrow()
        asking = Items(own.column("item_id").combine_chunks(), own.column("text").to_pylist())
        if not len(asking.terms):
            continue
        vectors = staged(_vectors(rows, asking), "impacts")
        n_docs, n_terms = vectors.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not n_docs:
            break
        asking.weigh(term_weights(_held_by(vectors, len(asking.terms)), n_docs))
        best = _best(vectors, asking, n_docs, n_terms, k, item_type).withColumn("pass", F.lit(k_pass))
        out = best if out is None else out.unionByName(best)
    if out is None:
        return spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {doc_type}, score long")
    order = Window.partitionBy("pass", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
