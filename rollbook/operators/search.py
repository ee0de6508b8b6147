"""Substring search over a corpus for a table of queries, with spelling variants and typo tolerance."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from operator import and_, or_

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructType

from ..functions.spelling import edit_budget, query_tokens, token_variants
from ..functions.text import normalize
from ..session import staged, unsent
from .grams import GramIndex, match_by_grams
from .nearnames import deletions

LISTS_DEFAULT = "m"
BLOCK = 100_000   # variants that are sent to every task; more are joined by their grams
TEXTS_AT_ONCE, PAIRS_AT_ONCE = 200, 100_000   # texts and pairs of text and query that a task holds as Python objects
SHARE = 256   # of queries that ask for the same, so many stand in one row
SENT = 1_000_000   # queries whose numbers are sent to every task; those of more are joined
PAGE = 50
NEW_DAYS = 30
WORD_SPLIT = "[^\\p{L}\\p{N}]+"
MIN_WORD = 3
LONG_TOKEN = 14   # from here on the pieces of a token are long enough to be rare


# --- queries ---------------------------------------------------------------------------------------

def parse_queries(queries: DataFrame) -> DataFrame:
    """``(q, query)`` to ``(q, token_no, token)``."""
    return queries.select("q", F.posexplode(query_tokens(F.col("query"))).alias("token_no", "token"))


def without_tokens(queries: DataFrame, tokens: DataFrame) -> DataFrame:
    """Queries that hold nothing to look for."""
    return queries.select("q").join(tokens.select("q"), "q", "left_anti")


def spell_tokens(tokens: DataFrame) -> DataFrame:
    """``(q, token_no, token)`` to ``(q, token_no, variant)``; the token itself is one of them."""
    return tokens.select("q", "token_no", F.explode(token_variants(F.col("token"))).alias("variant"))


# --- matching --------------------------------------------------------------------------------------

def has_tokens(h: Column, tokens: Sequence[Sequence[str]], any_token: bool = False) -> Column:
    """Search predicate for one query given as token variants; no token matches everything."""
    tests = [reduce(or_, [F.contains(h, F.lit(v)) for v in token if v] or [F.lit(False)]) for token in tokens]
    return reduce(or_ if any_token else and_, tests) if tests else F.lit(True)


def visible(merged: bool = False, list_name: str = "", as_of: Column | None = None) -> Column:
    """Which records a search may show: current versions, unfolded ones, one list, recent ones."""
    ok = F.col("replaced_by").isNull()
    if not merged:
        ok = ok & F.col("merged_into").isNull()
    if list_name:
        ok = ok & (F.coalesce(F.col("list"), F.lit(LISTS_DEFAULT)) == list_name)
    if as_of is not None:
        ok = ok & is_recent("added", as_of)
    return ok


def is_recent(col: str, as_of: Column) -> Column:
    """At most 30 days old; days to come count, unknown days do not."""
    return F.coalesce(F.col(col) >= F.date_sub(as_of, NEW_DAYS), F.lit(False))


class Matcher:
    """Which queries a text matches: all variants are looked for in one pass over the text."""

    def __init__(self, rows: Sequence[tuple], needed: dict, always: Sequence, any_token: bool):
        """rows: (q, token_no, variant), variants not empty; needed: number of tokens of each query."""
        self.rows, self.needed, self.always, self.any_token = rows, needed, list(always), any_token
        self.machine = None

    def __getstate__(self):
        return self.__dict__ | {"machine": None}

    def _build(self) -> None:
        tokens: dict = defaultdict(set)
        for q, token_no, variant in self.rows:
            tokens[variant].add((q, token_no))
        self.short = [(v, t) for v, t in tokens.items() if len(v) < 3]  # too frequent to tell every place
        self.machine = ahocorasick.Automaton()
        for v, t in tokens.items():
            if len(v) >= 3:
                self.machine.add_word(v, t)
        self.machine.make_automaton()

    def match(self, text: str | None) -> list:
        if text is None:
            return self.always
        if self.machine is None:
            self._build()
        hits: set = set()
        for v, t in self.short:
            if v in text:
                hits |= t
        if len(self.machine):
            for _, t in self.machine.iter(text):
                hits |= t
        if self.any_token:
            return [*self.always, *{q for q, _ in hits}]
        found = Counter(q for q, _ in hits)
        return [*self.always, *(q for q, n in found.items() if n == self.needed[q])]


def match_queries(corpus: DataFrame, variants: DataFrame, any_token: bool = False, always: DataFrame | None = None) -> DataFrame:
    """Rows of ``corpus`` (``h`` and any others, ids or not, repeated or not) per query ``q`` that they match; ``h`` is dropped.

    A token matches when any of its variants is a substring; an empty variant never is. Queries of ``always`` match every row. One scan
    of the corpus: up to ``BLOCK`` variants are sent to every task, more are joined by their grams and never leave the executors. Queries that ask for
    the same are looked for as one and told apart at the end. Of queries that match every row, whose result is as long as the corpus for each, ``BLOCK``
    are sent at a time.
    """
    asked = staged(variants.select("q", "token_no", F.coalesce("variant", F.lit("")).alias("variant")).distinct(), "variants")
    out = _match_many(corpus, asked, any_token) if asked.count() > BLOCK else _match_few(corpus, asked, any_token)
    for part in _blocks(always):
        out = out.unionByName(_scan(corpus, variants, Matcher([], {}, part, any_token)))
    return out


def _matcher(asked: Sequence[tuple], any_token: bool) -> Matcher:
    return Matcher([r for r in asked if r[2]], Counter(q for q, _ in {r[:2] for r in asked}), [], any_token)


def _match_few(corpus: DataFrame, asked: DataFrame, any_token: bool) -> DataFrame:
    """One scan for at most ``BLOCK`` variants."""
    own = [tuple(r) for r in asked.collect()]
    tokens, queries, sets = defaultdict(set), defaultdict(set), defaultdict(list)
    for q, token_no, variant in own:
        tokens[q, token_no].add(variant)
    for (q, _), token in tokens.items():
        queries[q].add(frozenset(token))
    for q, asks in queries.items():
        sets[frozenset(asks)].append(q)
    if len(queries) - len(sets) < SHARE:
        return _scan(corpus, asked, _matcher(own, any_token))
    one = [(k, no, v) for k, asks in enumerate(sets) for no, token in enumerate(asks) for v in token]
    shares = {k: -(-len(qs) // SHARE) for k, qs in enumerate(sets.values())}
    dealt = [(k, i, qs[i :: shares[k]]) for k, qs in enumerate(sets.values()) for i in range(shares[k])]
    schema = StructType().add("_alike", "long").add("_share", "integer").add("_qs", ArrayType(asked.schema["q"].dataType))
    return _told_apart(corpus, _scan_shares(corpus, _matcher(one, any_token), shares), F.broadcast(corpus.sparkSession.createDataFrame(dealt, schema)))


def _match_many(corpus: DataFrame, asked: DataFrame, any_token: bool) -> DataFrame:
    """What :func:`match_queries` gives for any number of variants, each set of tokens looked for once, however many queries ask for it.

    The queries of a set are dealt over shares of some ``SHARE``. A text that matches is a row for each share until the end, where the queries of
    the share come in; neither the pairs of text and query nor a hot set's queries are ever shuffled or held together.
    """
    tokens = asked.groupBy("q", "token_no").agg(F.sort_array(F.collect_list("variant")).alias("token"))
    queries = staged(tokens.groupBy("q").agg(F.sort_array(F.collect_set("token")).alias("tokens")), "queries")
    shares = F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("_shares")
    sets = staged(queries.groupBy("tokens").agg(shares).withColumn("_alike", F.monotonically_increasing_id()), "sets")
    n = queries.count()
    if n - sets.count() < SHARE and queries.filter("q is null").isEmpty():
        return match_by_grams(corpus, asked, any_token)
    one = sets.select(F.col("_alike").alias("q"), F.posexplode("tokens").alias("token_no", "token"))
    one = staged(one.select("q", "token_no", F.explode("token").alias("variant")), "variants")
    joined = F.broadcast if n <= SENT else unsent
    if one.count() <= BLOCK:
        hits = _scan_shares(corpus, _matcher([tuple(r) for r in one.collect()], any_token), dict(sets.select("_alike", "_shares").collect()))
    else:
        hits = match_by_grams(corpus, one, any_token).withColumnRenamed("q", "_alike").join(joined(sets.drop("tokens")), "_alike")
        hits = hits.withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
    share = F.pmod(F.xxhash64("q"), F.col("_shares")).cast("int").alias("_share")
    dealt = queries.join(sets, "tokens").groupBy("_alike", share).agg(F.collect_list(F.struct("q")).alias("_qs"))
    dealt = dealt.withColumn("_qs", F.transform("_qs", lambda x: x["q"]))  # a list of structs keeps a query whose number is null
    return _told_apart(corpus, hits, joined(staged(dealt, "shares")))


def _told_apart(corpus: DataFrame, hits: DataFrame, dealt: DataFrame) -> DataFrame:
    """A row for each query of a share that a text matches."""
    return hits.join(dealt, ["_alike", "_share"]).select(*[c for c in corpus.columns if c != "h"], F.explode("_qs").alias("q"))


def _blocks(always: DataFrame | None) -> Iterator[list]:
    if always is None or always.isEmpty():
        return
    own = staged(always.select("q").distinct(), "always")
    blocks = max(1, -(-own.count() // BLOCK))
    for k in range(blocks):
        yield [r["q"] for r in own.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == k).collect()]


def _matched(matcher: Matcher, batches: Iterator[pa.RecordBatch], kept: Sequence[str], arrow_q: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The rows of batches, whose last column is the text, per query that they match; only some texts and pairs at a time are Python objects."""
    for batch in batches:
        texts, at, qs = batch.column(batch.num_columns - 1), [], []
        for i in range(0, batch.num_rows, TEXTS_AT_ONCE):
            for j, h in enumerate(texts.slice(i, TEXTS_AT_ONCE).to_pylist(), i):
                found = matcher.match(h)
                at.extend([j] * len(found))
                qs.extend(found)
                if len(at) >= PAIRS_AT_ONCE or j == batch.num_rows - 1:
                    rows = pa.array(at, pa.int64())
                    yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[:-1]), pa.array(qs, arrow_q)], [*kept, "q"])
                    at, qs = [], []


def _scan(corpus: DataFrame, variants: DataFrame, matcher: Matcher) -> DataFrame:
    kept = [c for c in corpus.columns if c != "h"]
    q_type = variants.schema["q"].dataType
    schema = StructType([corpus.schema[c] for c in kept]).add("q", q_type)
    arrow_q = to_arrow_type(q_type)
    sent = corpus.sparkSession.sparkContext.broadcast(matcher)

    def match(batches):
        yield from _matched(sent.value, batches, kept, arrow_q)

    return corpus.select(*kept, "h").mapInArrow(match, schema)


def _by_share(found: pa.RecordBatch, shares: Mapping[int, int]) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, whose last column is a set of tokens, for each share of its queries; those of a share stand together, so that the same
    few queries come again and again in the result, which files pack well."""
    alike = found.column(found.num_columns - 1).to_numpy()
    order = np.argsort(alike, kind="stable")
    sets, first, n = np.unique(alike[order], return_index=True, return_counts=True)
    ends = np.cumsum(n * np.array([shares[x] for x in sets.tolist()], np.int64))
    starts = np.concatenate([[0], ends[:-1]])
    for lo in range(0, int(ends[-1]) if len(ends) else 0, PAIRS_AT_ONCE):
        at = np.arange(lo, min(lo + PAIRS_AT_ONCE, ends[-1]))
        k = np.searchsorted(ends, at, "right")
        share, i = np.divmod(at - starts[k], n[k])
        rows = pa.array(order[first[k] + i])
        yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in found.columns[:-1]), pa.array(sets[k]), pa.array(share.astype(np.int32))], [*found.schema.names[:-1], "_alike", "_share"])


def _scan_shares(corpus: DataFrame, matcher: Matcher, shares: Mapping[int, int]) -> DataFrame:
    """The rows of the corpus per set of tokens ``_alike`` that they match and ``_share`` of its queries."""
    kept = [c for c in corpus.columns if c != "h"]
    schema = StructType([corpus.schema[c] for c in kept]).add("_alike", "long").add("_share", "integer")
    sent = corpus.sparkSession.sparkContext.broadcast((matcher, shares))

    def match(batches):
        matcher, shares = sent.value
        for found in _matched(matcher, batches, kept, pa.int64()):
            yield from _by_share(found, shares)

    return corpus.select(*kept, "h").mapInArrow(match, schema)


# --- vocabulary and typos --------------------------------------------------------------------------

def vocabulary(corpus: DataFrame) -> DataFrame:
    """Distinct words of at least three characters."""
    words = corpus.select(F.explode(F.array_distinct(F.split("h", WORD_SPLIT))).alias("word"))
    return words.filter(F.length("word") >= MIN_WORD).distinct()


def _cut(length: Column, budget: Column, j: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of the j-th of ``budget + 1`` pieces of a text of this length."""
    size = F.floor(length / (budget + 1)).cast("int")
    return j * size, F.when(j == budget, length - budget * size).otherwise(size)


def _short_candidates(asked: DataFrame, words: DataFrame) -> DataFrame:
    """Two strings within k edits share one made by leaving out at most k letters of each: up to 121 of a word of 15 letters."""
    left = asked.select("token", "k", F.explode(deletions(F.col("token"), F.col("k"))).alias("rest"))
    n = F.length("word")
    reach = F.when(n >= 6, 2).when(n >= 4, 1).otherwise(0)  # any token that may reach a word this long
    right = words.filter(n <= LONG_TOKEN + 1).withColumn("reach", reach).filter("reach > 0")
    right = right.select("word", F.explode(deletions(F.col("word"), F.col("reach"))).alias("rest"))
    return right.join(left, "rest").select("token", "k", "word")


def _long_candidates(asked: DataFrame, words: DataFrame) -> DataFrame:
    """Of a token cut into k + 1 pieces, one stands unchanged in the word, moved by k places at most: 3 rows of a token, 75 of a word."""
    start, size = _cut(F.col("length"), F.col("k"), F.col("j"))
    left = asked.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k"))))
    left = left.select("token", "k", "length", "j", F.substring(F.col("token"), start + 1, size).alias("piece"))
    near = words.select("word", F.length("word").alias("n")).filter(F.col("n") >= LONG_TOKEN - 2)
    near = near.withColumn("length", F.explode(F.sequence(F.col("n") - 2, F.col("n") + 2)))
    near = near.join(asked.select("length", F.col("k").alias("reach")).distinct(), "length")  # only lengths that tokens have
    near = near.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("reach")))).withColumn("moved", F.explode(F.sequence(-F.col("reach"), F.col("reach"))))
    start, size = _cut(F.col("length"), F.col("reach"), F.col("j"))
    near = near.withColumns({"start": start + F.col("moved"), "size": size}).filter((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n")))
    right = near.select("word", "length", "j", F.substring(F.col("word"), F.col("start") + 1, F.col("size")).alias("piece")).distinct()
    return right.join(left, ["length", "j", "piece"]).select("token", "k", "word")


def similar_words(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs ``(token, word)`` within the token's edit budget, the token itself left out.

    Candidates come from equi-joins whose rows per word are bounded, however long it is; the exact distance decides.
    """
    asked = tokens.select("token").distinct().withColumn("k", edit_budget(F.col("token"))).filter("k > 0").withColumn("length", F.length("token"))
    long = F.col("length") >= LONG_TOKEN
    pairs = _short_candidates(asked.filter(~long), words).unionByName(_long_candidates(asked.filter(long), words))
    band = F.abs(F.length("token") - F.length("word")) <= F.col("k")
    close = F.call_function("levenshtein", F.col("token"), F.col("word"), F.col("k")) >= 0
    return pairs.filter((F.col("token") != F.col("word")) & band).filter(close).select("token", "word").distinct()


# --- pipelines -------------------------------------------------------------------------------------

class _Search:
    """One search over a corpus or an index of it: exact hits, and hits by similar words for queries that need them."""

    def __init__(self, corpus: DataFrame | GramIndex, queries: DataFrame, words: DataFrame | None, any_token: bool):
        self.queries, self.words, self.any_token = queries, words, any_token
        self.index = corpus if isinstance(corpus, GramIndex) else None
        self.corpus = corpus.rows.drop("_doc") if self.index else corpus
        self.tokens = staged(parse_queries(queries), "tokens")
        self.variants = spell_tokens(self.tokens)
        self.idle = without_tokens(queries, self.tokens)
        self.similar: DataFrame | None = None

    def _find(self, asked: DataFrame, where: Column, always: DataFrame | None = None) -> DataFrame:
        if self.index is None:
            return match_queries(self.corpus.filter(where), asked, self.any_token, always)
        out = self.index.match(asked, self.any_token, where)
        for part in _blocks(always):
            out = out.unionByName(_scan(self.corpus.filter(where), self.variants, Matcher([], {}, part, self.any_token)))
        return out

    def exact(self, where: Column) -> DataFrame:
        return staged(self._find(self.variants, where, self.idle), "exact").withColumn("mode", F.lit("exact"))

    def spread(self) -> None:
        """Find the similar words of all queries at once, for more than one use."""
        words = vocabulary(self.corpus) if self.words is None else self.words
        self.similar = staged(similar_words(self.tokens, words), "similar")

    def fuzzy(self, tokens: DataFrame, where: Column) -> DataFrame:
        """Hits of the queries of some tokens by similar words too; a query whose words are like no others has none."""
        words = vocabulary(self.corpus) if self.words is None else self.words
        similar = similar_words(tokens, words) if self.similar is None else self.similar
        more = staged(tokens.join(similar, "token").select("q", "token_no", F.col("word").alias("variant")), "similar")
        again = self.variants.join(more.select("q").distinct(), "q", "left_semi").unionByName(more)
        return self._find(again, where).withColumn("mode", F.lit("fuzzy"))


def staged_search(
    corpus: DataFrame | GramIndex, queries: DataFrame, words: DataFrame | None = None, where: Column | None = None, any_token: bool = False
) -> DataFrame:
    """Exact search with variants; queries without any hit are tried again with similar words.

    Returns the matching rows with ``q`` and ``mode`` ('exact' or 'fuzzy'). ``words`` may be a stored vocabulary;
    ``where`` restricts what is shown, never the vocabulary. A query without a token lists everything shown. The corpus may be an
    index of it; then only texts with a query's rarest grams are read, and all of them for queries without a token or without ``words``.
    """
    where = visible() if where is None else where
    search = _Search(corpus, queries, words, any_token)
    exact = search.exact(where)
    missed = search.tokens.join(exact.select("q").distinct(), "q", "left_anti")
    return exact if missed.isEmpty() else exact.unionByName(search.fuzzy(missed, where))


def count_by_list(rows: DataFrame, lists: Sequence[str], by: Sequence[str] = (), live: bool = False) -> DataFrame:
    """Rows per list and in total ('all'); a list without rows is still there, an unknown one counts as default."""
    name = F.when(F.col("list").isin(*lists), F.col("list")).otherwise(F.lit(lists[0]))
    if live:
        rows = rows.filter("removed is null")
    counts = rows.groupBy(*by).agg(
        *[F.count_if(name == x).alias(f"n_{x}") for x in lists], F.count(F.lit(1)).alias("n_all")
    )
    pairs = F.array(*[F.struct(F.lit(x).alias("list"), F.col(f"n_{x}").alias("n")) for x in [*lists, "all"]])
    return counts.select(*by, F.inline(pairs))


def facet_rollup(rows: DataFrame, dims: Sequence[str], measures: Mapping[str, Column] | None = None) -> DataFrame:
    """Counts by the dimensions from the first to the last, with totals at every step, from one pass: the rows of each group ``n`` and further measures.

    ``level`` tells a total from a group whose dimension is NULL: it has a bit for each dimension summed over, the last one the lowest.
    """
    more = [m.alias(name) for name, m in (measures or {}).items()]
    return rows.rollup(*dims).agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), *more)


def search_facets(corpus: DataFrame, queries: DataFrame, lists: Sequence[str], list_name: str, words: DataFrame | None = None) -> DataFrame:
    """Per query: mode and counts over all lists, then mode and count inside ``list_name``.

    The restricted view filters the full result; when that leaves nothing, the search runs again inside the list
    (so a list may show similar words although another list has exact hits). Rows of no known list count for the first one, as in
    :func:`count_by_list`. A query without a token counts live rows.
    """
    words = staged(vocabulary(corpus), "vocabulary") if words is None else words
    search = _Search(corpus, queries, words, False)
    exact = search.exact(visible())
    search.spread()
    missed = search.tokens.join(exact.select("q").distinct(), "q", "left_anti")
    hits = staged(exact.unionByName(search.fuzzy(missed, visible())), "hits")
    hits = hits.join(search.idle.select("q", F.lit(True).alias("idle")), "q", "left").filter("idle is null or removed is null")
    name = F.when(F.col("list").isin(*lists), F.col("list")).otherwise(F.lit(lists[0]))
    counted = hits.groupBy("q").agg(
        F.min("mode").alias("mode"), F.count(F.lit(1)).alias("n_all"), *[F.count_if(name == x).alias(f"n_{x}") for x in lists],
        F.min(F.when(name == list_name, F.col("mode"))).alias("view_mode"), F.count_if(name == list_name).alias("view_n"),
    )
    counted = staged(queries.select("q").join(counted, "q", "left"), "facets")
    # exact hits elsewhere only: in this list there may be similar words; a query that was fuzzy already has had its chance here
    empty = search.tokens.join(counted.filter("mode = 'exact' AND view_n = 0"), "q", "left_semi")
    again = search.fuzzy(empty, visible() & (name == list_name))
    retry = again.groupBy("q").agg(F.min("mode").alias("_mode"), F.count(F.lit(1)).alias("_n"))
    seen = counted.join(retry, "q", "left").withColumns({"view_mode": F.coalesce("_mode", "view_mode"), "view_n": F.coalesce("_n", "view_n")}).drop("_mode", "_n")
    zero = {c: 0 for c in ["n_all", "view_n", *[f"n_{x}" for x in lists]]}
    return seen.fillna({"mode": "exact", "view_mode": "exact", **zero})


def search_summary(facets: DataFrame, searching: Column, live_total: Column) -> DataFrame:
    """What to say about a search: total, found, fuzzy or nothing, with the number."""
    restricted = (F.col("view_n") > 0) & (F.col("view_mode") == "fuzzy")
    kind = (
        F.when(~searching, "total").when(restricted, "fuzzy").when(F.col("n_all") == 0, "nothing")
        .when(F.col("mode") == "fuzzy", "fuzzy").otherwise("found")
    )
    n = F.when(~searching, live_total).when(restricted, F.col("view_n")).otherwise(F.col("n_all"))
    return facets.select("q", kind.alias("kind"), n.alias("n"))


def newest_first(date: str = "date", pos: str = "pos") -> list[Column]:
    return [F.desc_nulls_last(date), F.desc(pos)]


def oldest_first(date: str = "date", pos: str = "pos") -> list[Column]:
    return [F.asc_nulls_last(date), F.asc(pos)]


def result_page(hits: DataFrame, order: Sequence[Column], size: int = PAGE, by: str = "q") -> DataFrame:
    """The first ``size`` rows per query; each task keeps at most ``size`` rows per query before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= size)


def next_page(hits: DataFrame, last: DataFrame, size: int = PAGE, by: str = "q") -> DataFrame:
    """The page, newest first, after the last row seen of each query: ``last`` has ``q, date, pos``. Earlier pages are not sorted again."""
    place = lambda date, pos: F.struct(date.isNull(), -F.unix_date(date), -pos)
    seen = last.select(by, place(F.col("date"), F.col("pos")).alias("_seen"))
    rest = hits.join(seen, by).filter(place(F.col("date"), F.col("pos")) > F.col("_seen")).drop("_seen")
    return result_page(rest, newest_first(), size, by)


# --- ranges and links in texts ---------------------------------------------------------------------

def ranges_in(text: str, variants: Sequence[str]) -> list[tuple[int, int]]:
    """Merged ranges of all variants in a text. Occurrences of one variant never overlap each other."""
    found = []
    for v in variants:
        at = text.find(v)
        while at >= 0:
            found.append((at, at + len(v)))
            at = text.find(v, at + len(v))
    merged: list[list[int]] = []
    for start, stop in sorted(found):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], stop)
        else:
            merged.append([start, stop])
    return [tuple(r) for r in merged]


def match_ranges(texts: DataFrame, variants: DataFrame) -> DataFrame:
    """Merged ranges ``[start, stop)`` of all variants in each text, per query: ``id, q, start, stop``.

    ``texts`` has ``id, q, text`` of matching rows. Ranges that overlap or touch are merged. The variants of a query come to its
    texts as one row, and the rest happens inside the text, in time linear in its length.
    """
    asked = variants.filter(F.col("variant") != "").groupBy("q").agg(F.collect_set("variant").alias("variants"))
    rows = texts.select("id", "q", normalize(F.col("text")).alias("h")).join(asked, "q").select("id", "q", "h", "variants")

    def find(batches):
        for b in batches:
            found = [ranges_in(h, vs) if h else [] for h, vs in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            at = pa.array([i for i, rs in enumerate(found) for _ in rs], pa.int64())
            start, stop = (pa.array([r[k] for rs in found for r in rs], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), start, stop], ["id", "q", "start", "stop"])

    return rows.mapInArrow(find, StructType([rows.schema["id"], rows.schema["q"]]).add("start", "long").add("stop", "long"))


class Places:
    """All places of variants in a text, by query; one automaton for all queries."""

    def __init__(self, rows: Sequence[tuple]):
        """rows: (q, variant), variants not empty."""
        self.rows, self.machine = rows, None

    def __getstate__(self):
        return self.__dict__ | {"machine": None}

    def ranges(self, text: str | None) -> list[tuple]:
        """(q, start, stop) of all queries, merged as :func:`ranges_in` does."""
        if not text or not self.rows:
            return []
        if self.machine is None:
            by: dict = defaultdict(list)
            for q, variant in self.rows:
                by[variant].append(q)
            self.machine = ahocorasick.Automaton()
            for variant, qs in by.items():
                self.machine.add_word(variant, (len(variant), variant, qs))
            self.machine.make_automaton()
        after: dict = {}
        found: dict = defaultdict(list)
        for end, (size, variant, qs) in self.machine.iter(text):
            start = end - size + 1
            if start >= after.get(variant, 0):  # occurrences of one variant never overlap each other
                after[variant] = end + 1
                for q in qs:
                    found[q].append((start, end + 1))
        out = []
        for q, places in found.items():
            merged: list[list[int]] = []
            for start, stop in sorted(places):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], stop)
                else:
                    merged.append([start, stop])
            out += [(q, *r) for r in merged]
        return out


def match_ranges_once(texts: DataFrame, variants: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """What :func:`match_ranges` gives, with each text read and normalised once, however many queries it matches.

    ``texts`` has ``id, text``, each id once; ``hits`` restricts the result to some ``(id, q)`` (all queries with any place, by default). ``BLOCK``
    variants are sent to the tasks at a time.
    """
    asked = staged(variants.filter(F.col("variant") != "").select("q", "variant").distinct(), "variants")
    blocks = max(1, -(-asked.count() // BLOCK))
    rows = texts.select("id", normalize(F.col("text")).alias("h"))
    rows = staged(rows, "texts") if blocks > 1 else rows
    schema = StructType([rows.schema["id"], asked.schema["q"]]).add("start", "long").add("stop", "long")
    arrow_q = to_arrow_type(asked.schema["q"].dataType)

    def scan(places):
        def find(batches):
            for b in batches:
                found = [places.value.ranges(h) for h in b.column(1).to_pylist()]
                at = pa.array([i for i, rs in enumerate(found) for _ in rs], pa.int64())
                cols = [pa.array([r[k] for rs in found for r in rs], kind) for k, kind in enumerate((arrow_q, pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), *cols], ["id", "q", "start", "stop"])

        return rows.mapInArrow(find, schema)

    out = None
    for k in range(blocks):
        own = [tuple(r) for r in asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == k).collect()]  # about BLOCK rows
        part = scan(texts.sparkSession.sparkContext.broadcast(Places(own)))
        out = part if out is None else out.unionByName(part)
    return out if hits is None else out.join(hits.select("id", "q").distinct(), ["id", "q"], "left_semi")


def text_links(texts: DataFrame) -> DataFrame:
    """Links in each text, in order, without the punctuation that follows them; bare ones get a scheme."""
    shape = '(https?://[^\\s"<>)]+|(?<![\\w/.@])(?:t\\.me|www\\.)[^\\s"<>)]+)'
    found = F.transform(F.regexp_extract_all("text", F.lit(shape), 1), lambda u: F.regexp_replace(u, "[.,;:)]+$", ""))
    links = texts.select("id", F.posexplode(found).alias("link_no", "label"))
    href = F.when(F.startswith("label", F.lit("http")), F.col("label")).otherwise(F.concat(F.lit("https://"), F.col("label")))
    return links.withColumn("href", href)
