"""Feed, digest, watchlist and source-health queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import changes, guards, health, watch
from ..operators.position import dense_position

from .inputs import AS_OF, DOC_QUERIES, DOC_TOKENS, DOCS_SQL, ITEMS_SQL, LISTS, TODAY, day, docs, items, queries_of, sql_tokens, table
from .registry import query

SINCE = "2001-07-25"
RANK = ["m", "f", "p"]

# --- what is new ------------------------------------------------------------------------------------


@query("new_counts", f"""WITH {ITEMS_SQL}, l(list) AS (VALUES ('m'), ('f'), ('p')), r AS (
  SELECT 'added' AS what, list FROM items WHERE replaced_by IS NULL AND added >= DATE '{AS_OF}' - 30
  UNION ALL SELECT 'removed', list FROM items WHERE replaced_by IS NULL AND removed >= DATE '{AS_OF}' - 30)
SELECT w.what, l.list, count(r.list) AS n FROM (VALUES ('added'), ('removed')) w(what) CROSS JOIN l LEFT JOIN r ON r.what = w.what AND r.list = l.list GROUP BY 1, 2
UNION ALL SELECT what, 'all', count(*) FROM r GROUP BY 1""")
def new_counts(spark, sf):
    return changes.new_counts(items(spark, sf), day(AS_OF), LISTS)


@query("grouped_new", f"""WITH {ITEMS_SQL} SELECT id, added, row_number() OVER (ORDER BY added DESC, pos DESC) - 1 AS rank FROM items
WHERE replaced_by IS NULL AND added >= DATE '{AS_OF}' - 30""")
def grouped_new(spark, sf):
    return changes.grouped_new(items(spark, sf).drop("h"), day(AS_OF)).select("id", "added", "rank")


@query("feed_top100", f"WITH {ITEMS_SQL} SELECT id, added AS feed_day FROM items WHERE added IS NOT NULL AND removed IS NULL ORDER BY added DESC, pos LIMIT 100")
def feed_top100(spark, sf):
    return changes.feed_rows(items(spark, sf)).select("id", "feed_day")


LINKED_FEED_SQL = f"""WITH RECURSIVE {ITEMS_SQL}, edges AS (SELECT id, 'p' || (CAST(substr(id, 2) AS BIGINT) - 1) AS edit_of FROM items WHERE list = 'p' AND label = 'AUTOMOBILE'),
walk(id, cur, hops) AS (SELECT id, id, 0 FROM items UNION ALL SELECT w.id, e.edit_of, w.hops + 1 FROM walk w JOIN edges e ON e.id = w.cur WHERE w.hops < 8),
roots AS (SELECT id, arg_max(cur, hops) AS root FROM walk GROUP BY id),
feed AS (SELECT id, added AS feed_day, merged_into FROM items WHERE added IS NOT NULL AND removed IS NULL ORDER BY added DESC, pos LIMIT 100)
SELECT id, feed_day, root, coalesce(merged_into, id) AS target FROM feed JOIN roots USING (id)"""


@query("feed_linked", LINKED_FEED_SQL)
def feed_linked(spark, sf):
    """Feed rows with the first version of each record and the record that a link leads to."""
    rows = items(spark, sf)
    before = F.concat(F.lit("p"), (F.substring("id", 2, 20).cast("long") - 1).cast("string"))
    edges = rows.filter("list = 'p' AND label = 'AUTOMOBILE'").select("id", before.alias("edit_of"))
    return changes.feed_links(changes.feed_rows(rows), edges).select("id", "feed_day", "root", "target")


@query("feed_without_history", f"WITH {ITEMS_SQL} SELECT id, date AS feed_day FROM items WHERE list = 'm' ORDER BY date DESC NULLS LAST, pos LIMIT 100")
def feed_without_history(spark, sf):
    return changes.feed_rows(items(spark, sf).withColumn("added", F.lit(None).cast("date"))).select("id", "feed_day")


@query("new_fallback", f"WITH {ITEMS_SQL} SELECT id, date FROM items WHERE replaced_by IS NULL AND merged_into IS NULL ORDER BY date DESC NULLS LAST, pos DESC LIMIT 60")
def new_fallback(spark, sf):
    return changes.new_fallback(items(spark, sf).withColumn("added", F.lit(None).cast("date"))).select("id", "date")


@query("latest_per_list", f"""WITH {ITEMS_SQL}, r AS (SELECT list, id, row_number() OVER (PARTITION BY list ORDER BY date DESC NULLS LAST, pos DESC) AS rank FROM items WHERE removed IS NULL)
SELECT list, id, rank FROM r WHERE rank <= CASE list WHEN 'm' THEN 3 ELSE 1 END""")
def latest_per_list(spark, sf):
    order = [F.desc_nulls_last("date"), F.desc("pos")]
    return changes.latest_per_list(items(spark, sf), {"m": 3, "f": 1, "p": 1}, order).select("list", "id", "rank")


# --- once-only digest -------------------------------------------------------------------------------

DIGEST_SQL = f"""rows AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'm' WHEN 'F' THEN 'f' ELSE 'p' END AS list, CAST(o_orderdate AS DATE) AS added,
  o_custkey AS ord, CASE WHEN o_orderpriority = '2-HIGH' THEN o_orderkey - 1 END AS edit_of, 'Order of ' || o_custkey || ', ' || o_orderpriority || ' ;' AS name FROM orders),
sent AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS sent_on FROM orders WHERE o_orderpriority = '3-MEDIUM'),
fresh AS (SELECT * FROM rows WHERE added >= DATE '{{since}}' AND id NOT IN (SELECT id FROM sent) AND (edit_of IS NULL OR edit_of NOT IN (SELECT id FROM sent)))"""


def _digest(spark, sf):
    o = table(spark, sf, "orders")
    name = F.concat(F.lit("Order of "), F.col("o_custkey").cast("string"), F.lit(", "), "o_orderpriority", F.lit(" ;"))
    rows = o.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "m").when(F.col("o_orderstatus") == "F", "f").otherwise("p").alias("list"),
        F.col("o_orderdate").cast("date").alias("added"), F.col("o_custkey").alias("ord"),
        F.when(F.col("o_orderpriority") == "2-HIGH", F.col("o_orderkey") - 1).alias("edit_of"), name.alias("name"),
    )
    sent = o.filter("o_orderpriority = '3-MEDIUM'").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("sent_on"))
    return rows, sent


def _fresh(spark, sf, since=SINCE):
    return changes.select_fresh(*_digest(spark, sf), day(since))


def _digest_sql(since=SINCE):
    return DIGEST_SQL.replace("{since}", since)


@query("digest_fresh", f"WITH {_digest_sql()} SELECT id, list, added FROM fresh")
def digest_fresh(spark, sf):
    return _fresh(spark, sf).select("id", "list", "added")


@query("digest_header", f"WITH {_digest_sql()} SELECT list, count(*) AS n, max(added) AS last_added FROM fresh GROUP BY 1 UNION ALL SELECT 'all', count(*), max(added) FROM fresh")
def digest_header(spark, sf):
    return changes.digest_header(_fresh(spark, sf), RANK)


@query("digest_rollup", f"""WITH {_digest_sql()}
SELECT list, added, grouping_id(list, added) AS level, count(*) AS n, max(added) AS last_added FROM fresh GROUP BY ROLLUP (list, added)""")
def digest_rollup(spark, sf):
    return changes.digest_rollup(_fresh(spark, sf))


NUMBERED_SQL = """numbered AS (SELECT *, row_number() OVER (ORDER BY list_position(['m', 'f', 'p'], list), added, ord, id) AS number,
  count(*) OVER (PARTITION BY list) AS n_list FROM fresh)"""


@query("digest_order", f"WITH {_digest_sql('1995-01-01')}, {NUMBERED_SQL} SELECT id, number FROM numbered")
def digest_order(spark, sf):
    return changes.digest_rows(_fresh(spark, sf, "1995-01-01"), RANK).select("id", "number")


@query("digest_rows", f"""WITH {_digest_sql()}, {NUMBERED_SQL}
SELECT id, list, number, lag(list) OVER (ORDER BY number) IS DISTINCT FROM list AND (SELECT count(DISTINCT list) FROM fresh) > 1 AS heads_list, n_list,
       number || '. ' || regexp_replace(name, '[;,. ]+$', '') AS block FROM numbered""")
def digest_rows(spark, sf):
    rows = changes.digest_rows(_fresh(spark, sf), RANK)
    return rows.select("id", "list", "number", "heads_list", "n_list", changes.digest_block(F.col("number"), F.col("name")).alias("block"))


HEADER_LEN, NEXT_LEN, LIMIT = 40, 25, 400


@query("digest_pack", f"""WITH RECURSIVE {_digest_sql('1995-01-01')},
blocks AS (SELECT list AS digest, id, row_number() OVER (PARTITION BY list ORDER BY added, ord, id) - 1 AS pos, length(name) + 60 AS size FROM fresh),
pack AS (
  SELECT digest, pos, 0 AS message, {HEADER_LEN} + 2 + size AS used FROM blocks WHERE pos = 0
  UNION ALL
  SELECT b.digest, b.pos, CASE WHEN p.used + 2 + b.size > {LIMIT} THEN p.message + 1 ELSE p.message END,
         CASE WHEN p.used + 2 + b.size > {LIMIT} THEN {NEXT_LEN} + 2 + b.size ELSE p.used + 2 + b.size END
  FROM pack p JOIN blocks b ON b.digest = p.digest AND b.pos = p.pos + 1)
SELECT b.digest, b.id, b.pos, p.message FROM pack p JOIN blocks b USING (digest, pos)""")
def digest_pack(spark, sf):
    fresh = _fresh(spark, sf, "1995-01-01")
    rows = fresh.select(F.col("list").alias("digest"), "id", "added", "ord", (F.length("name") + 60).alias("size"))
    blocks = dense_position(rows, [F.col("added"), F.col("ord"), F.col("id")], by=["digest"])
    packed = changes.digest_pack(blocks, HEADER_LEN, NEXT_LEN, LIMIT, chunk=16_384)
    return packed.select("digest", "id", "pos", "message")


@query("mark_sent", f"""WITH {_digest_sql()}, marks AS (SELECT * FROM sent UNION ALL SELECT unnest([id, edit_of]), DATE '{TODAY}' FROM fresh)
SELECT id, max(sent_on) AS sent_on FROM marks WHERE id IS NOT NULL GROUP BY id HAVING max(sent_on) >= DATE '{TODAY}' - 60""")
def mark_sent(spark, sf):
    _, sent = _digest(spark, sf)
    return changes.mark_sent(sent, _fresh(spark, sf), day(TODAY))


# --- watchlist --------------------------------------------------------------------------------------

WATCH_SQL = f"""{DOCS_SQL}, {sql_tokens(DOC_TOKENS)},
matches AS (SELECT q, id FROM docs JOIN tokens ON contains(h, token) JOIN (SELECT q, count(*) AS need FROM tokens GROUP BY q) USING (q) GROUP BY q, id, need HAVING count(*) = need),
seen AS (SELECT q, doc_id AS id FROM labels CROSS JOIN (SELECT DISTINCT q FROM tokens) WHERE quality = 1),
edges AS (SELECT doc_id AS id, doc_id - 1 AS edit_of FROM documents WHERE lang <> 'en'),
walk AS (
  WITH RECURSIVE w(id, cur, hops) AS (
    SELECT doc_id, doc_id, 0 FROM documents UNION ALL SELECT w.id, e.edit_of, w.hops + 1 FROM w JOIN edges e ON e.id = w.cur WHERE w.hops < 7)
  SELECT * FROM w),
fresh AS (SELECT * FROM matches m WHERE NOT EXISTS (SELECT 1 FROM walk JOIN seen s ON s.id = walk.cur AND s.q = m.q WHERE walk.id = m.id))"""


def _watch(spark, sf):
    """Documents as the corpus, labelled good ones as seen, chains along the languages."""
    d = docs(spark, sf)
    none = F.lit(None).cast("bigint")
    corpus = d.select("id", "h", none.alias("replaced_by"), none.alias("merged_into"))
    queries = queries_of(spark, DOC_QUERIES)
    every = F.explode(F.array(*[F.lit(k) for k, _ in DOC_QUERIES])).alias("q")
    seen = table(spark, sf, "labels").filter("quality = 1").select(every, F.col("doc_id").alias("id"))
    edges = d.filter("lang <> 'en'").select("id", (F.col("id") - 1).alias("edit_of"))
    return corpus, queries, seen, edges


@query("watch_matches", f"WITH {WATCH_SQL} SELECT q, id FROM matches")
def watch_matches(spark, sf):
    corpus, queries, _, _ = _watch(spark, sf)
    return watch.watch_matches(corpus, queries).select("q", "id")


@query("watch_fresh", f"WITH {WATCH_SQL} SELECT q, id FROM fresh")
def watch_fresh(spark, sf):
    corpus, queries, seen, edges = _watch(spark, sf)
    return watch.watch_fresh(watch.watch_matches(corpus, queries), seen, edges).select("q", "id")


OWNERS = [("ann", 1), ("ann", 2), ("bob", 5), ("cem", 6), ("dee", None)]


@query("watch_status", f"""WITH {WATCH_SQL}, o(owner, q) AS (VALUES ('ann', 1), ('ann', 2), ('bob', 5), ('cem', 6), ('dee', NULL)),
p AS (SELECT owner, count(q) AS entries, coalesce(sum((SELECT count(*) FROM matches m WHERE m.q = o.q)), 0) AS matches, coalesce(sum((SELECT count(*) FROM fresh f WHERE f.q = o.q)), 0) AS fresh FROM o GROUP BY owner)
SELECT owner, entries, CAST(matches AS BIGINT) AS matches, CAST(fresh AS BIGINT) AS fresh, CASE WHEN entries = 0 THEN 'idle' WHEN fresh > 0 THEN 'alert' WHEN matches > 0 THEN 'warn' ELSE 'ok' END AS tone FROM p""")
def watch_status(spark, sf):
    corpus, queries, seen, edges = _watch(spark, sf)
    matches = watch.watch_matches(corpus, queries)
    return watch.watch_status(matches, watch.watch_fresh(matches, seen, edges), spark.createDataFrame(OWNERS, "owner string, q int"))


@query("watch_state", f"""WITH {WATCH_SQL}, old AS (SELECT * FROM seen WHERE q <= 3),
added AS (SELECT * FROM old UNION ALL SELECT q, id FROM matches WHERE q > 3)
SELECT q, id FROM added WHERE q <> 1 UNION ALL SELECT q, id FROM matches WHERE q = 1""")
def watch_state(spark, sf):
    """Queries 1–3 are known; asking for all adds 4–6 with what they match, and 1 is marked seen."""
    corpus, queries, seen, _ = _watch(spark, sf)
    matches = watch.watch_matches(corpus, queries).select("q", "id")
    known = queries.filter("q <= 3")
    entries, now_seen = watch.add_queries(seen.filter("q <= 3"), known, queries, matches)
    return watch.mark_seen(now_seen, matches.filter("q = 1"), entries)


@query("watch_sanitize", """SELECT event_id, CASE event_type WHEN 'click' THEN 'query ' || user_id WHEN 'view' THEN 'a "b"' ELSE 'x' END AS q,
CASE event_type WHEN 'click' THEN 'e' || event_id || ',k' ELSE '' END AS seen, CASE WHEN event_type <> 'error' THEN CAST(ts AS DATE) END AS at
FROM events WHERE event_type <> 'signup'""")
def watch_sanitize(spark, sf):
    """Stored entries made of events: good, with a non-text id, without a day, and without a query."""
    e = table(spark, sf, "events")
    at, key = F.date_format("ts", "yyyy-MM-dd"), F.col("event_id").cast("string")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    raw = (
        F.when(F.col("event_type") == "click", F.concat(F.lit('{"q":"query '), F.col("user_id").cast("string"), F.lit('","seen":["e'), key, F.lit('","k"],"at":'), text(at), F.lit("}")))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"q":"a \\"b\\"","seen":["e",'), key, F.lit('],"at":'), text(at), F.lit("}")))
        .when(F.col("event_type") == "error", F.concat(F.lit('{"q":"x","seen":"e'), key, F.lit('","at":7}')))
        .when(F.col("event_type") == "signup", F.concat(F.lit('{"q":'), key, F.lit(',"seen":[]}')))
        .otherwise(F.concat(F.lit('{"q":"x","at":'), text(at), F.lit("}")))
    )
    clean = watch.watch_sanitize(e.select("event_id", raw.alias("raw")))
    return clean.select("event_id", "q", F.array_join("seen", ",").alias("seen"), "at")


# --- source health ----------------------------------------------------------------------------------

RUNS_SQL = "runs AS (SELECT user_id AS source, ts, event_id, event_type IN ('error', 'signup') AS failed FROM events)"


def _runs(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("source"), "ts", "event_id", F.col("event_type").isin("error", "signup").alias("failed"))


@query("failing_since", f"""WITH {RUNS_SQL}, ok AS (SELECT source, max((ts, event_id)) FILTER (NOT failed) AS last_ok, max(ts) AS checked_at, count(*) AS runs FROM runs GROUP BY 1)
SELECT ok.source, runs, checked_at, (SELECT CAST(min(ts) AS DATE) FROM runs r WHERE r.source = ok.source AND failed AND (last_ok IS NULL OR (r.ts, r.event_id) > last_ok)) AS failing_since,
(SELECT count(*) FROM runs r WHERE r.source = ok.source AND failed AND (last_ok IS NULL OR (r.ts, r.event_id) > last_ok)) AS failures FROM ok""")
def failing_since(spark, sf):
    return health.failing_since(_runs(spark, sf), [F.col("ts"), F.col("event_id")])


@query("source_transitions", f"""WITH {RUNS_SQL}
SELECT source, event_id, failed FROM (SELECT *, coalesce(lag(failed) OVER (PARTITION BY source ORDER BY ts, event_id), false) AS prev FROM runs) WHERE failed <> prev""")
def source_transitions(spark, sf):
    return health.history_transitions(_runs(spark, sf), [F.col("ts"), F.col("event_id")]).select("source", "event_id", "failed")


METAS_SQL = """cur AS (SELECT user_id AS source, arg_max(event_type, (ts, event_id)) AS last_type, max(ts) AS checked_at, max(ts) FILTER (event_type = 'purchase') AS updated_at, count(*) FILTER (event_type = 'view') AS total FROM events GROUP BY 1),
prev AS (SELECT user_id AS source, arg_max(event_type, (ts, event_id)) AS last_type FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1)"""


def _metas(spark, sf):
    e = table(spark, sf, "events")
    last = F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type")
    by = F.col("user_id").alias("source")
    views = F.count_if(F.col("event_type") == "view").alias("total")
    cur = e.groupBy(by).agg(last, F.max("ts").alias("checked_at"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("updated_at"), views)
    prev = e.filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")).groupBy(by).agg(last)
    return prev, cur


def _state(df):
    kind = F.col("last_type")
    return df.select(
        "source", F.when(kind == "error", F.lit("no answer")).alias("error"), (kind == "click").alias("fallback"), (kind == "signup").alias("died"))


@query("source_alerts", f"""WITH {METAS_SQL}, b AS (SELECT coalesce(c.source, p.source) AS source, coalesce(c.last_type, '') AS c, coalesce(p.last_type, '') AS p FROM cur c FULL OUTER JOIN prev p ON c.source = p.source)
SELECT source, unnest(list_filter([CASE WHEN c = 'error' AND p <> 'error' THEN 'source_down' END, CASE WHEN c <> 'error' AND p = 'error' THEN 'source_up' END,
  CASE WHEN c = 'click' AND p <> 'click' THEN 'fallback_on' END, CASE WHEN c <> 'click' AND p = 'click' THEN 'fallback_off' END, CASE WHEN c = 'signup' THEN 'step_died' END], lambda x: x IS NOT NULL)) AS message,
  CASE WHEN c = 'error' THEN 'no answer' END AS error FROM b""")
def source_alerts(spark, sf):
    prev, cur = _metas(spark, sf)
    return health.source_transitions(_state(prev), _state(cur))


def _stamps(spark, sf):
    _, cur = _metas(spark, sf)
    return cur.select(
        "source", F.when(F.col("last_type") != "view", F.col("checked_at")).cast("timestamp").alias("checked_at"),
        F.col("checked_at").cast("date").alias("checked"), F.col("updated_at").cast("date").alias("updated"),
        F.when(F.col("last_type") == "error", F.date_sub(F.col("checked_at").cast("date"), 2)).alias("failing_since"),
        F.col("source").alias("rank"), "total", F.lit(None).cast("date").alias("source_date"),
    )


@query("source_stamps", f"""WITH {METAS_SQL}, s AS (SELECT source, CAST(checked_at AS DATE) AS checked, CASE WHEN last_type = 'error' THEN CAST(checked_at AS DATE) - 2 END AS failing,
  CASE WHEN last_type <> 'view' THEN checked_at ELSE CAST(CAST(checked_at AS DATE) AS TIMESTAMP) END AS stamp FROM cur)
SELECT source, coalesce(failing, checked) AS since, CASE WHEN checked <> coalesce(failing, checked) THEN checked END AS tried,
  source = (SELECT source FROM s ORDER BY stamp DESC, source LIMIT 1) AS is_latest FROM s""")
def source_stamps(spark, sf):
    metas = _stamps(spark, sf)
    latest = health.latest_stamp(metas).select("source").scalar()
    return health.down_dates(metas).withColumn("is_latest", F.col("source") == latest)


@query("source_facts", f"""WITH {METAS_SQL}, k AS (SELECT c_custkey AS source FROM customer)
SELECT k.source, coalesce(total, 0) AS total, CAST(checked_at AS DATE) AS checked, CAST(checked_at AS DATE) AS source_date FROM k LEFT JOIN cur USING (source)""")
def source_facts(spark, sf):
    """Every customer is a known source; many were never imported."""
    known = table(spark, sf, "customer").select(F.col("c_custkey").alias("source"))
    return health.source_facts(_stamps(spark, sf), known)


@query("snapshot_guards", """WITH m AS (SELECT source, count(*) FILTER (lang <> 'de') AS kept, count(*) FILTER (lang = 'de') AS skipped FROM documents GROUP BY 1)
SELECT source, kept, skipped, CASE WHEN kept < CASE source WHEN 'src0' THEN 100000 WHEN 'src1' THEN 1 ELSE 0 END THEN 'too_few' WHEN skipped > (kept + skipped) * 0.01 THEN 'too_many_rejects' ELSE 'ok' END AS verdict FROM m""")
def snapshot_guards(spark, sf):
    german = F.col("lang") == "de"
    metrics = table(spark, sf, "documents").groupBy("source").agg(F.count_if(~german).alias("kept"), F.count_if(german).alias("skipped"))
    return guards.snapshot_guards(metrics, {"src0": 100000, "src1": 1})


@query("ingest_metrics", "SELECT count(*) FILTER (lang = 'de') AS skipped, count(*) FILTER (lang = 'fr') AS approx, count(*) FILTER (n_chars > 1000) AS long FROM documents")
def ingest_metrics(spark, sf):
    c = F.col
    parts = table(spark, sf, "documents").groupBy("source").agg(
        F.count_if(c("lang") == "de").alias("skipped"), F.count_if(c("lang") == "fr").alias("approx"), F.count_if(c("n_chars") > 1000).alias("long"))
    return guards.ingest_metrics(parts, ["skipped", "approx", "long"])
