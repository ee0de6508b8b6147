"""Corpus, search and publishing queries over the tagged lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import code_series
from ..functions.text import normalize, normalize_compact
from ..operators import changes, search, stats
from ..operators.grams import GramIndex, match_by_grams
from ..operators.position import dense_position
from ..session import staged, work_dir
from ..sources.lists import list_position, read_list, record_lookup, tagged_union
from ..sources.publish import lookup_by_id, public_projection, write_by_id
from .inputs import (
    AS_OF, DOC_QUERIES, DOC_TOKENS, DOCS_SQL, ITEM_QUERIES, ITEM_TOKENS, ITEMS_SQL, LISTS, day, docs, items, q, queries_of, sql_compact, sql_lev,
    sql_norm, sql_tokens, table,
)
from .registry import query

VISIBLE = "replaced_by IS NULL AND merged_into IS NULL"
CUSTOMER_SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("read_list", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def read_list_query(spark, sf):
    there = read_list(spark, f"{sf}/customer.parquet", CUSTOMER_SCHEMA)
    absent = read_list(spark, f"{sf}/no_such_list.parquet", CUSTOMER_SCHEMA, optional=True)
    return there.unionByName(absent).select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query("tagged_union", """SELECT 'c' AS list, 0 AS list_rank, c_custkey AS id, c_name AS name, c_mktsegment AS segment, CAST(NULL AS INT) AS size FROM customer
UNION ALL SELECT 's', 1, s_suppkey, s_name, NULL, NULL FROM supplier UNION ALL SELECT 'p', 2, p_partkey, p_name, NULL, p_size FROM part""")
def tagged_union_query(spark, sf):
    c, s, p = (table(spark, sf, t) for t in ("customer", "supplier", "part"))
    return tagged_union({
        "c": c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
        "s": s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
        "p": p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size")),
    })


@query("live_rows", f"WITH {ITEMS_SQL} SELECT list, id FROM items WHERE removed IS NULL AND replaced_by IS NULL AND merged_into IS NULL")
def live_rows(spark, sf):
    return items(spark, sf).filter("removed is null and replaced_by is null and merged_into is null").select("list", "id")


@query("haystack", f"WITH {ITEMS_SQL} SELECT id, h FROM items")
def haystack_query(spark, sf):
    return items(spark, sf).select("id", "h")


@query("facet_filter", f"WITH {ITEMS_SQL} SELECT id FROM (SELECT id, CASE WHEN list = 'm' THEN NULL ELSE list END AS list FROM items WHERE {VISIBLE}) WHERE coalesce(list, 'm') = 'm'")
def facet_filter(spark, sf):
    untagged = items(spark, sf).withColumn("list", F.when(F.col("list") != "m", F.col("list")))
    return untagged.filter(search.visible(list_name="m")).select("id")


@query("recent_rows", f"WITH {ITEMS_SQL} SELECT id, added FROM items WHERE replaced_by IS NULL AND added >= DATE '{AS_OF}' - 30")
def recent_rows(spark, sf):
    return changes.recent_rows(items(spark, sf), day(AS_OF)).select("id", "added")


ALLOWED = {"m": ["id", "name", "label", "place"], "p": ["id", "name"]}


@query("public_projection", f"""WITH {ITEMS_SQL}
SELECT list, id, CASE list WHEN 'm' THEN '{{"id":"' || id || '","name":"' || name || '","label":"' || label || '","place":"' || place || '"}}'
  ELSE '{{"id":"' || id || '","name":"' || name || '"}}' END AS record FROM items WHERE list IN ('m', 'p')""")
def public_projection_query(spark, sf):
    return public_projection(items(spark, sf), ALLOWED)


RULES_SQL = """CASE WHEN len(list_filter(codes, lambda x: regexp_matches(x, '^361(-[0-9])?$'))) > 0 THEN 'ext'
  WHEN list_contains(codes, '342') OR list_contains(codes, '293') THEN 'protest'
  WHEN len(list_intersect(codes, ['130', '130-1', '367', '368', '369', '369-1', '370', '188', '203-1'])) > 0 THEN 'speech' ELSE 'other' END"""


@query("rule_series", f"""WITH c AS (SELECT p_partkey, [CAST(p_size + 320 AS VARCHAR), CAST(p_size + 280 AS VARCHAR), CASE WHEN p_size < 10 THEN '361-' || p_size END] AS codes FROM part)
SELECT p_partkey, {RULES_SQL} AS series FROM (SELECT p_partkey, list_filter(codes, lambda x: x IS NOT NULL) AS codes FROM c)""")
def rule_series_query(spark, sf):
    codes = F.array_compact(F.array(
        (F.col("p_size") + 320).cast("string"), (F.col("p_size") + 280).cast("string"),
        F.when(F.col("p_size") < 10, F.concat(F.lit("361-"), F.col("p_size").cast("string"))),
    ))
    return table(spark, sf, "part").select("p_partkey", code_series(codes).alias("series"))


@query("list_position", f"WITH {ITEMS_SQL} SELECT list, id, row_number() OVER (PARTITION BY list ORDER BY pos) AS n FROM items")
def list_position_query(spark, sf):
    return list_position(items(spark, sf).select("list", "id", "pos"), [F.col("pos")]).select("list", "id", "n")


@query("record_lookup", f"""WITH {ITEMS_SQL}, asked AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'x' ELSE 'm' END || user_id AS id FROM events)
SELECT a.event_id, a.id, i.name, i.id IS NULL AS stale FROM asked a LEFT JOIN items i ON i.id = a.id""")
def record_lookup_query(spark, sf):
    tag = F.when(F.col("event_type") == "error", "x").otherwise("m")
    asked = table(spark, sf, "events").select("event_id", F.concat(tag, F.col("user_id").cast("string")).alias("id"))
    return record_lookup(asked, items(spark, sf).select("id", "name")).select("event_id", "id", "name", "stale")


@query("record_lookup_pruned", f"""WITH {ITEMS_SQL}, asked AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'x' ELSE 'm' END || user_id AS id FROM events)
SELECT a.event_id, a.id, i.name, i.id IS NULL AS stale FROM asked a LEFT JOIN items i ON i.id = a.id""")
def record_lookup_pruned(spark, sf):
    """The rows of ``record_lookup`` from records written by id; only folders of asked ids are read."""
    path = work_dir(spark, "by-id")
    write_by_id(items(spark, sf).select("id", "name"), path, shelves=32)
    tag = F.when(F.col("event_type") == "error", "x").otherwise("m")
    asked = table(spark, sf, "events").select("event_id", F.concat(tag, F.col("user_id").cast("string")).alias("id"))
    return lookup_by_id(asked, path, shelves=32).select("event_id", "id", "name", "stale")


@query("distinct_dates", f"WITH {ITEMS_SQL} SELECT DISTINCT date FROM items WHERE date IS NOT NULL")
def distinct_dates(spark, sf):
    return items(spark, sf).select("date").filter("date is not null").distinct()


@query("distinct_ordered", """SELECT doc_id, array_to_string(list_transform(list_sort(list_distinct(list_transform(range(1, len(w) + 1),
  lambda i: lpad(CAST(list_position(w, w[i]) AS VARCHAR), 9, '0') || w[i]))), lambda x: substr(x, 10)), ' ') AS words
FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""")
def distinct_ordered(spark, sf):
    words = F.array_join(F.array_distinct(F.split("text", " ")), " ")
    return table(spark, sf, "documents").select("doc_id", words.alias("words"))


def _corpus(spark, sf):
    """The corpus as a stored table: its search text is built once, however many passes a search needs."""
    return staged(items(spark, sf), "corpus")


# --- search -----------------------------------------------------------------------------------------

@query("query_tokens", f"""WITH l AS (SELECT p_partkey AS q, unnest([1, 2, 3]) AS n, p_name, p_brand, p_type FROM part),
s AS (SELECT q, n, CASE n WHEN 1 THEN '"' || p_name || '" ' || p_brand WHEN 2 THEN 'https://www.' || p_brand || '/, @' || p_type ELSE p_name || '?!  ' || p_type || ')' END AS query FROM l),
t AS (SELECT q, n, regexp_extract_all({sql_compact('query')}, '"[^"]+"|[^ ]+') AS ps FROM s),
u AS (SELECT q, n, list_transform(ps, lambda p: trim(CASE WHEN regexp_matches(p, '^"[^"]+"$') THEN p[2:-2] ELSE p END)) AS ps FROM t),
v AS (SELECT q, n, list_transform(ps, lambda p: regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '^https?://', ''), '^www\\.', ''), '^@', ''), '[/.,;:!?)]+$', '')) AS ps FROM u)
SELECT q * 10 + n AS q, unnest(range(0, len(ps))) AS token_no, unnest(ps) AS token FROM v""")
def query_tokens_query(spark, sf):
    p = table(spark, sf, "part")
    shapes = [
        F.concat(F.lit('"'), "p_name", F.lit('" '), "p_brand"),
        F.concat(F.lit("https://www."), "p_brand", F.lit("/, @"), "p_type"),
        F.concat("p_name", F.lit("?!  "), "p_type", F.lit(")")),
    ]
    rows = p.select(F.col("p_partkey").alias("k"), F.posexplode(F.array(*shapes)).alias("n", "query"))
    return search.parse_queries(rows.select((F.col("k") * 10 + F.col("n") + 1).alias("q"), "query"))


def _variants_sql() -> str:
    from ..functions.spelling import LACINKA_TO_CYRILLIC, LATIN_TO_CYRILLIC

    def respell(table_):
        pairs = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in table_.items()) + "}"
        shape = q("|".join(table_) + "|.")
        return f"array_to_string(list_transform(regexp_extract_all(w, {shape}), lambda p: coalesce(({pairs})[p], p)), '')"

    return f"""WITH v AS (SELECT DISTINCT unnest(regexp_split_to_array({sql_norm('text')}, '[^\\p{{L}}\\p{{N}}]+')) AS w FROM documents),
words AS (SELECT w, length(w) >= 3 AND regexp_matches(w, '^[\\p{{L}}''ʼ-]+$') AND regexp_matches(w, '[a-zžčšćńśźłŭó]') AND NOT regexp_matches(w, '[а-яёўґ]') AS latin FROM v WHERE length(w) >= 3),
spelled AS (
  SELECT w, w AS variant FROM words
  UNION ALL SELECT w, {respell(LATIN_TO_CYRILLIC)} FROM words WHERE latin
  UNION ALL SELECT w, {respell(LACINKA_TO_CYRILLIC)} FROM words WHERE latin),
kept AS (SELECT * FROM spelled WHERE length(variant) >= 3)
SELECT DISTINCT w AS word, unnest([variant, replace(variant, 'і', 'и'), replace(variant, 'и', 'і')]) AS variant FROM kept"""


@query("token_variants", _variants_sql())
def token_variants_query(spark, sf):
    from ..functions.spelling import token_variants

    words = search.vocabulary(docs(spark, sf))
    return words.select("word", F.explode(token_variants(F.col("word"))).alias("variant"))


def _doc_predicate(any_token):
    return lambda spark, sf: search.match_queries(
        docs(spark, sf).select("id", "h"), search.spell_tokens(search.parse_queries(queries_of(spark, DOC_QUERIES))), any_token)


HITS_SQL = f"""WITH {DOCS_SQL}, {sql_tokens(DOC_TOKENS)},
hits AS (SELECT q, id, count(*) AS n FROM docs JOIN tokens ON contains(h, token) GROUP BY q, id)"""


@query("search_all_tokens", f"{HITS_SQL} SELECT q, id FROM hits JOIN (SELECT q, count(*) AS need FROM tokens GROUP BY q) USING (q) WHERE n = need")
def search_all_tokens(spark, sf):
    return _doc_predicate(False)(spark, sf).select("q", "id")


@query("search_any_token", f"{HITS_SQL} SELECT q, id FROM hits")
def search_any_token(spark, sf):
    return _doc_predicate(True)(spark, sf).select("q", "id")


@query("search_indexed", f"{HITS_SQL} SELECT q, id FROM hits JOIN (SELECT q, count(*) AS need FROM tokens GROUP BY q) USING (q) WHERE n = need")
def search_indexed(spark, sf):
    """The rows of ``search_all_tokens`` by an index of the documents."""
    index = GramIndex.build(docs(spark, sf).select("id", "h"))
    return index.match(search.spell_tokens(search.parse_queries(queries_of(spark, DOC_QUERIES)))).select("q", "id")


@query("search_many_queries", f"""WITH {DOCS_SQL}, qs AS (SELECT page_id AS q, regexp_extract(url, 'https?://([a-z]+\\.)*([a-z]+)\\.example', 2) AS word FROM pages)
SELECT q, id FROM qs JOIN docs ON contains(h, {sql_norm('word')}) WHERE word <> ''""")
def search_many_queries(spark, sf):
    """One query per page (the site word of its url), so the set of queries grows with the data; those of a word are looked for as one."""
    word = F.regexp_extract("url", "https?://([a-z]+\\.)*([a-z]+)\\.example", 2)
    queries = table(spark, sf, "pages").select(F.col("page_id").alias("q"), word.alias("query"))
    return search.match_queries(docs(spark, sf).select("id", "h"), search.spell_tokens(search.parse_queries(queries))).select("q", "id")


PASSAGES_SQL = f"""WITH {DOCS_SQL}, qs AS (SELECT item_id AS q, {sql_norm('text')} AS text FROM benchmark),
ws AS (SELECT DISTINCT q, unnest(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}]+')) AS word FROM qs)
SELECT DISTINCT q, id FROM ws JOIN docs ON contains(h, word) WHERE length(word) >= 9"""


@query("search_by_gram_join", PASSAGES_SQL)
def search_by_gram_join(spark, sf):
    """Documents that hold any of an item's longer words: a set of variants that stays on the executors, joined by grams."""
    words = table(spark, sf, "benchmark").select(F.col("item_id").alias("q"), F.explode(F.array_distinct(F.split(normalize(F.col("text")), search.WORD_SPLIT))).alias("variant"))
    variants = words.filter(F.length("variant") >= 9).select("q", F.lit(0).alias("token_no"), "variant")
    return match_by_grams(docs(spark, sf).select("id", "h"), variants, any_token=True).select("q", "id")


@query("vocabulary", f"WITH {DOCS_SQL}, v AS (SELECT DISTINCT unnest(regexp_split_to_array(h, '[^\\p{{L}}\\p{{N}}]+')) AS word FROM docs) SELECT word FROM v WHERE length(word) >= 3")
def vocabulary(spark, sf):
    return search.vocabulary(docs(spark, sf))


@query("similar_words", f"""WITH {DOCS_SQL}, v AS (SELECT DISTINCT unnest(regexp_split_to_array(h, '[^\\p{{L}}\\p{{N}}]+')) AS word FROM docs),
b AS (SELECT DISTINCT unnest(regexp_split_to_array({sql_norm('text')}, '[^\\p{{L}}\\p{{N}}]+')) AS token FROM benchmark),
k AS (SELECT token, CASE WHEN length(token) >= 8 THEN 2 WHEN length(token) >= 5 THEN 1 ELSE 0 END AS k FROM b)
SELECT token, word FROM k JOIN v ON k.k > 0 AND token <> word AND length(word) BETWEEN length(token) - k.k AND length(token) + k.k
WHERE {sql_lev('token', 'word')} <= k.k""")
def similar_words(spark, sf):
    tokens = search.vocabulary(table(spark, sf, "benchmark").select(normalize(F.col("text")).alias("h")))
    return search.similar_words(tokens.withColumnRenamed("word", "token"), search.vocabulary(docs(spark, sf)))


STAGED_SQL = f"""{ITEMS_SQL}, {sql_tokens(ITEM_TOKENS)},
shown AS (SELECT * FROM items WHERE {VISIBLE}),
need AS (SELECT q, count(*) AS need FROM tokens GROUP BY q),
exact AS (SELECT q, id, any_value(list) AS list FROM shown JOIN tokens ON contains(h, token) JOIN need USING (q) GROUP BY q, id, need HAVING count(*) = need),
vocab AS (SELECT DISTINCT unnest(regexp_split_to_array(h, '[^\\p{{L}}\\p{{N}}]+')) AS word FROM items),
bounds AS (SELECT *, CASE WHEN length(token) >= 8 THEN 2 WHEN length(token) >= 5 THEN 1 ELSE 0 END AS k FROM tokens),
near_words AS (SELECT q, token_no, word AS token FROM bounds JOIN vocab ON k > 0 AND length(word) >= 3 AND word <> token AND abs(length(word) - length(token)) <= k AND {sql_lev('word', 'token')} <= k),
wide AS (SELECT * FROM tokens WHERE q IN (SELECT q FROM near_words) UNION SELECT * FROM near_words WHERE q IN (SELECT q FROM near_words)),
fuzzy_all AS (SELECT q, id, list FROM (SELECT DISTINCT q, id, list, token_no FROM shown JOIN wide ON contains(h, token)) JOIN need USING (q) GROUP BY q, id, list, need HAVING count(*) = need),
found AS (SELECT q, id, list, 'exact' AS mode FROM exact UNION ALL SELECT q, id, list, 'fuzzy' FROM fuzzy_all WHERE q NOT IN (SELECT q FROM exact))"""


@query("staged_search", f"WITH {STAGED_SQL} SELECT q, id, mode FROM found")
def staged_search(spark, sf):
    return search.staged_search(_corpus(spark, sf), queries_of(spark, ITEM_QUERIES)).select("q", "id", "mode")


@query("staged_search_indexed", f"WITH {STAGED_SQL} SELECT q, id, mode FROM found")
def staged_search_indexed(spark, sf):
    """The rows of ``staged_search`` by an index of the lists, with a stored vocabulary."""
    corpus = _corpus(spark, sf)
    words = staged(search.vocabulary(corpus), "vocabulary")
    return search.staged_search(GramIndex.build(corpus), queries_of(spark, ITEM_QUERIES), words).select("q", "id", "mode")


FACETS_SQL = f"""{STAGED_SQL},
whole AS (SELECT q, min(mode) AS mode, count(*) AS n_all, count(*) FILTER (list = 'm') AS n_m, count(*) FILTER (list = 'f') AS n_f, count(*) FILTER (list = 'p') AS n_p FROM found GROUP BY q),
in_list AS (SELECT q, mode, count(*) AS n FROM found WHERE list = 'm' GROUP BY q, mode),
again AS (SELECT q, 'fuzzy' AS mode, count(*) AS n FROM fuzzy_all WHERE list = 'm' AND q NOT IN (SELECT q FROM in_list) GROUP BY q),
view_rows AS (SELECT * FROM in_list UNION ALL SELECT * FROM again),
facets AS (SELECT need.q, coalesce(w.mode, 'exact') AS mode, coalesce(n_all, 0) AS n_all, coalesce(n_m, 0) AS n_m, coalesce(n_f, 0) AS n_f, coalesce(n_p, 0) AS n_p,
  coalesce(v.mode, 'exact') AS view_mode, coalesce(v.n, 0) AS view_n FROM need LEFT JOIN whole w USING (q) LEFT JOIN view_rows v ON v.q = need.q)"""


@query("search_facets", f"WITH {FACETS_SQL} SELECT * FROM facets")
def search_facets(spark, sf):
    return search.search_facets(_corpus(spark, sf), queries_of(spark, ITEM_QUERIES), LISTS, "m")


@query("search_summary", f"""WITH {FACETS_SQL}
SELECT q, CASE WHEN view_n > 0 AND view_mode = 'fuzzy' THEN 'fuzzy' WHEN n_all = 0 THEN 'nothing' WHEN mode = 'fuzzy' THEN 'fuzzy' ELSE 'found' END AS kind,
CASE WHEN view_n > 0 AND view_mode = 'fuzzy' THEN view_n ELSE n_all END AS n FROM facets
UNION ALL SELECT 0, 'total', count(*) FROM items WHERE {VISIBLE} AND removed IS NULL""")
def search_summary(spark, sf):
    rows = _corpus(spark, sf)
    facets = search.search_facets(rows, queries_of(spark, [(0, "  "), *ITEM_QUERIES]), LISTS, "m")
    live = rows.filter(search.visible()).filter("removed is null").agg(F.count(F.lit(1))).scalar()
    return search.search_summary(facets, F.col("q") != 0, live)


RANGES_SQL = f"""WITH {DOCS_SQL}, {sql_tokens(DOC_TOKENS)},
hit AS (SELECT q, id, token, string_split(h, token) AS ps FROM docs JOIN tokens ON contains(h, token)),
lens AS (SELECT q, id, length(token) AS w, unnest(range(1, len(ps))) AS i, list_transform(ps, lambda p: length(p)) AS ls FROM hit),
raw AS (SELECT q, id, list_sum(ls[1:i]) + (i - 1) * w AS s, list_sum(ls[1:i]) + i * w AS e FROM lens),
flag AS (SELECT *, coalesce(max(e) OVER (PARTITION BY q, id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < s, true)::INT AS opens FROM raw),
isl AS (SELECT *, sum(opens) OVER (PARTITION BY q, id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM flag)
SELECT q, id, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS stop FROM isl GROUP BY q, id, island"""


@query("match_ranges", RANGES_SQL)
def match_ranges(spark, sf):
    variants = search.spell_tokens(search.parse_queries(queries_of(spark, DOC_QUERIES)))
    texts = docs(spark, sf).select("id", "text", "h")
    matched = search.match_queries(texts, variants, any_token=True)
    return search.match_ranges(matched, variants).select("q", "id", F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop"))


@query("match_ranges_once", RANGES_SQL)
def match_ranges_once(spark, sf):
    """The rows of ``match_ranges``, each document read once for all queries."""
    variants = search.spell_tokens(search.parse_queries(queries_of(spark, DOC_QUERIES)))
    return search.match_ranges_once(docs(spark, sf).select("id", "text"), variants).select("q", "id", "start", "stop")


@query("text_links", """WITH p AS (SELECT page_id AS id, 'See ' || url || ', also www.site' || page_id || '.by). Not x.t.me/a but t.me/b' || page_id || '; ' || html AS text FROM pages),
t AS (SELECT id, regexp_extract_all(' ' || text, '(?:https?://[^\\s"<>)]+|[^\\w/.@](?:t\\.me|www\\.)[^\\s"<>)]+)') AS ls FROM p),
u AS (SELECT id, unnest(range(0, len(ls))) AS link_no, unnest(ls) AS raw FROM t),
c AS (SELECT id, link_no, regexp_replace(CASE WHEN raw LIKE 'http%' THEN raw ELSE raw[2:] END, '[.,;:)]+$', '') AS label FROM u)
SELECT id, link_no, label, CASE WHEN label LIKE 'http%' THEN label ELSE 'https://' || label END AS href FROM c""")
def text_links(spark, sf):
    key = F.col("page_id").cast("string")
    text = F.concat(F.lit("See "), "url", F.lit(", also www.site"), key, F.lit(".by). Not x.t.me/a but t.me/b"), key, F.lit("; "), "html")
    return search.text_links(table(spark, sf, "pages").select(F.col("page_id").alias("id"), text.alias("text")))


# --- orders and pages of results -------------------------------------------------------------------

def _sorted_query(order):
    def run(spark, sf):
        rows = items(spark, sf).filter(search.visible()).select("id", "date", "pos")
        return dense_position(rows, order(), name="rank").select("id", "rank")
    return run


SORTS = {
    "newest": (search.newest_first, "date DESC NULLS LAST, pos DESC"),
    "oldest": (search.oldest_first, "date ASC NULLS LAST, pos"),
    "source": (lambda: [F.col("pos")], "pos"),
}
for _name, (_order, _sql) in SORTS.items():
    query(f"sort_{_name}", f"WITH {ITEMS_SQL} SELECT id, row_number() OVER (ORDER BY {_sql}) - 1 AS rank FROM items WHERE {VISIBLE}")(_sorted_query(_order))


@query("result_page", f"""WITH {STAGED_SQL}
SELECT f.q, f.id, row_number() OVER (PARTITION BY f.q ORDER BY i.date DESC NULLS LAST, i.pos DESC) AS rank FROM found f JOIN items i USING (id)
QUALIFY row_number() OVER (PARTITION BY f.q ORDER BY i.date DESC NULLS LAST, i.pos DESC) <= 50""")
def result_page(spark, sf):
    hits = search.staged_search(_corpus(spark, sf), queries_of(spark, ITEM_QUERIES))
    return search.result_page(hits, search.newest_first()).select("q", "id", "rank")


@query("result_page_next", f"""WITH {STAGED_SQL}, ranked AS (
  SELECT f.q, f.id, row_number() OVER (PARTITION BY f.q ORDER BY i.date DESC NULLS LAST, i.pos DESC) AS n FROM found f JOIN items i USING (id))
SELECT q, id, n - 50 AS rank FROM ranked WHERE n BETWEEN 51 AND 100""")
def result_page_next(spark, sf):
    """The second page of every query, asked for by the last row of the first."""
    hits = staged(search.staged_search(_corpus(spark, sf), queries_of(spark, ITEM_QUERIES)), "hits")
    last = search.result_page(hits, search.newest_first()).filter(F.col("rank") == search.PAGE).select("q", "date", "pos")
    return search.next_page(hits, last).select("q", "id", "rank")


@query("facet_counts", f"""WITH {ITEMS_SQL}, l(list) AS (VALUES ('m'), ('f'), ('p'), ('w'))
SELECT l.list, count(i.id) AS n FROM l LEFT JOIN items i ON i.list = l.list AND i.removed IS NULL GROUP BY 1
UNION ALL SELECT 'all', count(*) FROM items WHERE removed IS NULL""")
def facet_counts(spark, sf):
    return search.count_by_list(items(spark, sf), ["m", "f", "p", "w"], live=True)


@query("facet_rollup", f"""WITH {ITEMS_SQL}, r AS (SELECT list, year(date) AS year, CASE WHEN removed IS NULL THEN 'live' ELSE 'removed' END AS status FROM items)
SELECT list, year, status, grouping_id(list, year, status) AS level, count(*) AS n FROM r GROUP BY ROLLUP (list, year, status)""")
def facet_rollup(spark, sf):
    """Records by list, year and status with all totals; undated records are a group of their own, not a total."""
    rows = items(spark, sf).select("list", F.year("date").alias("year"), F.when(F.col("removed").isNull(), "live").otherwise("removed").alias("status"))
    return search.facet_rollup(rows, ["list", "year", "status"])


@query("lists_present", f"""WITH {STAGED_SQL}
SELECT DISTINCT unnest(list_distinct([CASE WHEN series = 'terror' THEN 't' ELSE list END, CASE WHEN marked THEN 't' ELSE list END])) AS list
FROM (SELECT i.* FROM found JOIN items i USING (id)) WHERE series <> 'terror'
UNION SELECT 't' FROM found JOIN items i USING (id) WHERE i.series = 'terror'""")
def lists_present(spark, sf):
    return changes.lists_present(search.staged_search(_corpus(spark, sf), queries_of(spark, ITEM_QUERIES)))


@query("coverage_counts", f"""WITH {ITEMS_SQL}
SELECT list, count(*) FILTER (live) AS live, count(*) FILTER (live AND date IS NULL) AS undated, count(*) FILTER (live AND merged_into IS NOT NULL) AS folded,
  count(*) FILTER (live AND merged_into IS NULL AND date IS NULL) AS alone_undated
FROM (SELECT *, removed IS NULL AND replaced_by IS NULL AS live FROM items) GROUP BY list""")
def coverage_counts(spark, sf):
    return stats.coverage_counts(items(spark, sf))


@query("distinct_total", f"""WITH {ITEMS_SQL} SELECT count(*) FILTER (removed IS NULL) AS live, count(*) FILTER (merged_into IS NOT NULL) AS folded,
count(*) FILTER (removed IS NULL) - count(*) FILTER (merged_into IS NOT NULL) AS total FROM items""")
def distinct_total(spark, sf):
    return changes.distinct_total(items(spark, sf))


@query("normalized_text", f"SELECT doc_id, {sql_compact('text')} AS h FROM documents")
def normalized_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", normalize_compact(F.col("text")).alias("h"))
