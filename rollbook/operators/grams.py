"""Substring search by grams: an index that answers queries without reading all texts, and a join for more queries than fit in a task.

A gram is one character, two or three in a row, as one number. A text that holds a variant holds its grams, so every variant is looked
for by a single gram: itself if it is that short, else the rarest of its three-letter grams. The texts found so are few, and
only for them the variants themselves are compared, by ``contains``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import staged, work_dir

#: Characters of texts that a task indexes together; their postings of one gram are one row.
CHARS_AT_ONCE = 2_000_000
#: Characters of texts for one folder of the index, and the bounds of the number of folders.
CHARS_A_SLOT, SLOTS = 20_000_000, (8, 4096)
#: Up to so many grams or texts are named in the filters of a scan; more are joined.
NAMED = 2000
#: A text meets about the variants of so many queries at once.
QUERIES_AT_ONCE = 2000
#: Texts in the sample that tells which grams are rare (this only decides by which gram a variant is looked for).
SAMPLE = 2000
#: Bits of the filter by which texts send on only grams that are asked for.
FILTER_BITS = 1 << 22
_NONE = np.uint64((1 << 21) - 1)  # stands where a gram has no further character


def _grams(text: str, mask: np.ndarray | None = None) -> np.ndarray:
    """The distinct grams of a text, in ascending order; with a mask of hashes only those that it lets pass, which are sorted alone."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    two, none = np.uint64(21), np.uint64(42)
    one = (c << none) | (_NONE << two) | _NONE
    pair = (c[:-1] << none) | (c[1:] << two) | _NONE
    three = (c[:-2] << none) | (c[1:-1] << two) | c[2:]
    every = np.concatenate([one, pair, three])
    if mask is not None:
        every = every[mask[(every % np.uint64(FILTER_BITS - 3)).view(np.int64)]]
    return np.unique(every).view(np.int64)


def _grams_of_variant(variant: str) -> np.ndarray:
    """The grams by which a variant may be looked for; none for an empty one."""
    if not variant:
        return np.zeros(0, np.int64)
    low = np.int64((1 << 21) - 1)
    grams = _grams(variant)
    if len(variant) >= 3:
        return grams[grams & low != low]
    return grams[(grams >> np.int64(21)) & low != low] if len(variant) == 2 else grams


def _slot(gram: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(slots)).cast("int")


def _text_groups(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of the batches with about CHARS_AT_ONCE characters of texts, and these."""
    for batch in batches:
        texts = batch.column(at).to_pylist()
        first, chars = 0, 0
        for i, t in enumerate(texts):
            chars += len(t or "")
            if chars >= CHARS_AT_ONCE or i == len(texts) - 1:
                yield batch.slice(first, i + 1 - first), texts[first : i + 1]
                first, chars = i + 1, 0


def numbered(corpus: DataFrame) -> DataFrame:
    """The corpus as a table of its own, each row with a number ``_doc`` that stays."""
    return staged(corpus.withColumn("_doc", F.monotonically_increasing_id()), "rows")


# --- variants ---------------------------------------------------------------------------------------

def variant_grams(asked: DataFrame) -> DataFrame:
    """``(q, token_no, variant)`` with each ``gram`` by which the variant may be looked for."""

    def cut(batches):
        for b in batches:
            grams = [_grams_of_variant(v or "") for v in b.column(2).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(grams)), [len(g) for g in grams]), pa.int64())
            gram = pa.array(np.concatenate([*grams, np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns), gram], ["q", "token_no", "variant", "gram"])

    rows = asked.select("q", "token_no", "variant")
    return rows.mapInArrow(cut, StructType([*rows.schema.fields]).add("gram", "long"))


def probes(grams: DataFrame, sizes: DataFrame, any_token: bool) -> DataFrame:
    """``(q, gram)``: by which grams the texts of each query are found, given ``(gram, n)``, how many texts hold a gram (none: no row).

    Of a variant the rarest gram; if all tokens are needed, only of the token whose grams are the rarest together.
    """
    n = F.coalesce("n", F.lit(0))
    best = grams.join(sizes, "gram", "left").groupBy("q", "token_no", "variant").agg(F.min(F.struct(n.alias("n"), "gram")).alias("best"))
    if any_token:
        return best.select("q", F.col("best.gram").alias("gram")).distinct()
    tokens = best.groupBy("q", "token_no").agg(F.sum("best.n").alias("cost"), F.collect_set("best.gram").alias("grams"))
    return tokens.groupBy("q").agg(F.min_by("grams", F.struct("cost", "token_no")).alias("grams")).select("q", F.explode("grams").alias("gram"))


def verified(rows: DataFrame, found: DataFrame, asked: DataFrame, any_token: bool) -> DataFrame:
    """``rows`` (numbered, with ``h``) that hold what a query asks for, without ``h``, with ``q``.

    ``found`` has candidates ``(_doc, q)``, each once; ``asked`` the variants. A text meets each variant of its queries once, however many of them
    ask for it, those of some thousand queries in one row. A query that is no candidate for a text lacks a gram there, so it gains nothing by what others find.
    """
    words = asked.filter("variant <> ''")
    n = asked.select("q").distinct().count()
    deal = F.pmod(F.xxhash64("variant"), F.lit(max(1, -(-n // QUERIES_AT_ONCE))))
    lists = found.join(words.select("q", "variant").distinct(), "q").groupBy("_doc", deal.alias("_deal")).agg(F.collect_set("variant").alias("_asked"))
    held = lists.join(rows.select("_doc", "h"), "_doc").select("_doc", F.explode(F.expr("filter(_asked, x -> contains(h, x))")).alias("variant"))
    held = held.join(words, "variant").select("_doc", "q", "token_no").distinct()
    if any_token:
        hits = held.select("_doc", "q").distinct()
    else:
        needed = asked.groupBy("q").agg(F.count_distinct("token_no").alias("_needed"))
        hits = held.groupBy("_doc", "q").agg(F.count(F.lit(1)).alias("_n")).join(needed, "q").filter("_n = _needed").select("_doc", "q")
    kept = [c for c in rows.columns if c not in ("h", "_doc")]
    return hits.join(rows.drop("h"), "_doc").select(*kept, "q")


def _clean(variants: DataFrame) -> DataFrame:
    """The variants of queries, each once. An empty variant matches nothing, so a token that has no other makes a query of all tokens fail."""
    return staged(variants.select("q", "token_no", F.coalesce("variant", F.lit("")).alias("variant")).distinct(), "variants")


# --- a join, for texts that come and go ------------------------------------------------------------

def match_by_grams(corpus: DataFrame, variants: DataFrame, any_token: bool = False) -> DataFrame:
    """What :func:`rollbook.operators.search.match_queries` gives, for any number of variants, which stay on the executors.

    Every text is cut into grams once. The driver gets a filter of a fixed number of bits, which holds back grams that no variant is looked for
    by; what passes is joined with the variants' grams, and candidates are compared. A gram that many texts and variants share is a key of two
    plain tables, which AQE may split.
    """
    asked = _clean(variants)
    rows = numbered(corpus)
    every = max(1, rows.count() // SAMPLE)
    grams = staged(variant_grams(asked), "grams")
    sample = _gram_rows(rows.filter(F.pmod(F.xxhash64("_doc"), F.lit(every)) == 0), None)
    wanted = staged(probes(grams, sample.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), any_token), "probes")
    bits = wanted.select(F.pmod("gram", F.lit(FILTER_BITS - 3)).alias("bit")).distinct().toArrow().column(0).to_numpy()
    mask = np.zeros(FILTER_BITS, bool)
    mask[bits] = True
    sent = staged(_gram_rows(rows, np.packbits(mask)), "sent")
    found = sent.join(wanted, "gram").select("_doc", "q").distinct()
    return verified(rows, found, asked, any_token)


def _gram_rows(rows: DataFrame, bits: np.ndarray | None) -> DataFrame:
    """``(gram, _doc)``: the distinct grams of each text, of those that a filter lets pass."""

    def cut(batches):
        mask = None if bits is None else np.unpackbits(bits).astype(bool)
        for part, texts in _text_groups(batches, 1):
            doc = part.column(0).to_numpy()
            out, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for d, t in zip(doc.tolist(), texts, strict=True):
                g = _grams(t or "", mask)
                out.append(g)
                of.append(np.full(len(g), d))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.concatenate(of))], ["gram", "_doc"])

    return rows.select("_doc", "h").mapInArrow(cut, "gram long, _doc long")


# --- an index, for texts that stay -----------------------------------------------------------------

class GramIndex:
    """An index of a corpus in a folder: ``rows``, the numbered corpus with ``h``, and ``grams``, for each gram the numbers of the texts that
    hold it, in rows of bounded length, in folders by the gram's hash and sorted by gram."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.rows = spark.read.parquet(f"{path}/rows")
        self.grams = spark.read.schema("gram long, n long, docs array<long>, slot int").parquet(f"{path}/grams")
        self.slots = spark.read.parquet(f"{path}/size").first()["slots"]

    @classmethod
    def build(cls, corpus: DataFrame, path: str | None = None) -> GramIndex:
        """Index a corpus that has ``h`` and any other columns; a null text holds nothing. The path must be new; by default one in the shared folder.

        The folder is whole once ``size`` is there, which is written last. One shuffle, of the postings; the longest list of one gram has one row
        for each stretch of texts that a task has cut together.
        """
        spark = corpus.sparkSession
        path = path or work_dir(spark, "gram-index")
        corpus.withColumn("_doc", F.monotonically_increasing_id()).write.parquet(f"{path}/rows")
        rows = spark.read.parquet(f"{path}/rows")
        chars = rows.agg(F.sum(F.length("h"))).first()[0] or 0
        slots = min(max(SLOTS[0], chars // CHARS_A_SLOT), SLOTS[1])

        def post(batches):
            for part, texts in _text_groups(batches, 1):
                lists = [_grams(t or "") for t in texts]
                doc = np.repeat(part.column(0).to_numpy(), [len(g) for g in lists])
                gram = np.concatenate([*lists, np.zeros(0, np.int64)])
                order = np.argsort(gram, kind="stable")
                gram, doc = gram[order], doc[order]
                heads = np.flatnonzero(np.diff(gram, prepend=gram[:1] - 1))
                edges = np.append(heads, len(gram))
                docs = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(doc))
                yield pa.RecordBatch.from_arrays([pa.array(gram[heads]), pa.array(np.diff(edges)), docs], ["gram", "n", "docs"])

        posted = rows.select("_doc", "h").mapInArrow(post, "gram long, n long, docs array<long>").withColumn("slot", _slot(F.col("gram"), slots))
        # dealt out by size: a slot of frequent grams goes to several tasks, each of which adds a sorted file to its folder
        posted.hint("rebalance", "slot").sortWithinPartitions("slot", "gram").write.partitionBy("slot").parquet(f"{path}/grams")
        spark.createDataFrame([(slots,)], "slots int").write.parquet(f"{path}/size")
        return cls(spark, path)

    def read(self, grams: DataFrame, columns: Sequence[str]) -> DataFrame:
        """The rows of some grams: only their folders are listed, and of few grams only the row groups that may hold them."""
        spread = grams.select("gram").distinct()
        slots = sorted(r[0] for r in spread.select(_slot(F.col("gram"), self.slots)).distinct().collect())  # one number for each folder at most
        rows = self.grams.filter(F.col("slot").isin(slots))
        few = [r[0] for r in spread.limit(NAMED + 1).collect()]
        if len(few) <= NAMED:
            return rows.filter(F.col("gram").isin(few)).select(*columns)
        return rows.join(spread, "gram", "left_semi").select(*columns)

    def match(self, variants: DataFrame, any_token: bool = False, where: Column | None = None) -> DataFrame:
        """Rows of the corpus per query ``q`` that they match, as :func:`rollbook.operators.search.match_queries` gives them; ``where`` restricts them.

        Reads how many texts hold each gram of the variants, then the lists of the rarest ones, then the texts on them.
        """
        asked = _clean(variants)
        grams = staged(variant_grams(asked), "grams")
        sizes = self.read(grams, ["gram", "n"]).groupBy("gram").agg(F.sum("n").alias("n"))
        wanted = staged(probes(grams, sizes, any_token), "probes")
        lists = self.read(wanted, ["gram", "docs"]).join(wanted, "gram").select("q", F.explode("docs").alias("_doc"))
        found = staged(lists.distinct(), "candidates")
        rows = self.rows
        few = [r[0] for r in found.select("_doc").distinct().limit(NAMED + 1).collect()]
        if len(few) <= NAMED:
            rows = rows.filter(F.col("_doc").isin(few))
        if where is not None:
            rows = rows.filter(where)
        return verified(rows, found, asked, any_token)
