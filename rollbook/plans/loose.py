"""Ingest queries: loose text, cells, JSON, pages and posts; and the text functions behind them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text
from ..sources import ingest, lists, pages
from .inputs import sql_compact, sql_date_words, sql_id, sql_lev, table
from .registry import query

# --- text functions ---------------------------------------------------------------------------------


@query("stable_id", f"SELECT doc_id, {sql_id('doc', sql_compact('text'), 'lang')} AS id FROM documents")
def stable_id(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", text.stable_id("doc", text.normalize_compact(F.col("text")), F.col("lang")).alias("id"))


@query("title_case", """SELECT doc_id, array_to_string(list_transform(regexp_extract_all(lower(text), '\\p{L}+|[^\\p{L}]+'), lambda r: replace(upper(r[1]), 'ẞ', 'SS') || r[2:]), '') AS titled FROM documents""")
def title_case(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.title_case(F.col("text")).alias("titled"))


@query("similar_names", f"""WITH a AS (SELECT c_custkey, {sql_compact('c_name')} AS a, {sql_compact("replace(s_name, 'Supplier', 'Customer')")} AS b
  FROM customer JOIN supplier ON s_suppkey = c_custkey % 1000003 % (SELECT max(s_suppkey) + 1 FROM supplier))
SELECT c_custkey, a = b OR (length(a) <= 3000 AND {sql_lev('a', 'b')} <= greatest(2, floor(greatest(length(a), length(b)) * 0.08 + 0.5))) AS near8,
       a = b OR {sql_lev('a', 'b')} <= greatest(2, floor(greatest(length(a), length(b)) * 0.15 + 0.5)) AS near15 FROM a""")
def similar_names(spark, sf):
    """Every customer beside a supplier."""
    s = table(spark, sf, "supplier").select("s_suppkey", F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("b"))
    top = s.agg(F.max("s_suppkey") + 1).scalar()
    key = (F.col("c_custkey") % 1000003) % top
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("a"), key.alias("s_suppkey")).join(s, "s_suppkey")
    a, b = F.col("a"), F.col("b")
    return rows.select("c_custkey", text.similar_names(a, b, 0.08, prefix=True, max_len=3000).alias("near8"), text.similar_names(a, b, 0.15).alias("near15"))


@query("extract_codes", """SELECT p_partkey, array_to_string(list_distinct_keep, ',') AS codes FROM (
  SELECT p_partkey, list_filter([x, y, z], lambda v: v IS NOT NULL) AS list_distinct_keep FROM (
    SELECT p_partkey, CAST(100 + p_size AS VARCHAR) AS x, CASE WHEN p_type = 'PROMO' THEN CAST(200 + p_size AS VARCHAR) || '-1' END AS y,
           CASE WHEN p_size <> 30 THEN CAST(130 AS VARCHAR) END AS z FROM part))""")
def extract_codes(spark, sf):
    n = lambda k: (F.col("p_size") + k).cast("string")
    extra = F.when(F.col("p_type") == "PROMO", F.concat(F.lit(", и "), n(200), F.lit("-1"))).otherwise("")
    basis = F.concat(F.lit("ч. 1 статьи "), n(100), extra, F.lit(" и ст.ст 130, "), n(100))
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.extract_codes(basis), ",").alias("codes"))


@query("parse_dates", f"""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS worded, CAST(o_orderdate AS DATE) AS day_first,
CASE WHEN o_orderdate >= TIMESTAMP '1996-01-01' THEN CAST(o_orderdate AS DATE) END AS serial, {sql_date_words('CAST(o_orderdate AS DATE)')} AS words,
CASE WHEN o_orderstatus <> 'F' THEN CAST(o_orderdate AS DATE) END AS exact, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m') ELSE '' END AS before FROM orders""")
def parse_dates(spark, sf):
    o = table(spark, sf, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    d = F.col("d")
    words = F.concat(F.lit("от "), dates.date_words(d), F.lit(" года"))
    number = F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string")
    loose = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("<"), F.date_format(d, "yyyy-MM"))).otherwise(F.date_format(d, "yyyy-MM-dd"))
    parsed = dates.exact_or_before(loose)
    return o.select(
        "o_orderkey", dates.worded_date(words).alias("worded"), dates.day_first_date(words).alias("day_first"),
        dates.serial_date(number, 35065).alias("serial"), dates.date_words(d).alias("words"),
        parsed["exact"].alias("exact"), parsed["before"].alias("before"),
    )


# --- text tables and sheets -------------------------------------------------------------------------



@query("text_records", f"""WITH r AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS rec_no, unnest(string_split(text, chr(10))) AS raw FROM documents),
c AS (SELECT doc_id, rec_no, list_transform(string_split(raw, ', '), lambda x: trim(x)) AS cs FROM r),
d AS (SELECT doc_id, rec_no, cs[1:len(cs) - coalesce(list_position(list_reverse(list_transform(cs, lambda x: x <> '')), true), len(cs) + 1) + 1] AS cs FROM c),
e AS (SELECT doc_id, rec_no, len(cs) = 2 AND length(cs[1]) > 80 AS moved, cs FROM d WHERE len(cs) >= 2),
f AS (SELECT doc_id, rec_no, CASE WHEN moved THEN '' ELSE cs[1] END AS type, CASE WHEN moved THEN cs ELSE cs[2:] END AS rest FROM e),
g AS (SELECT doc_id, rec_no, type, CASE WHEN len(rest) >= 2 THEN array_to_string(rest[1:len(rest) - 1], chr(10)) ELSE rest[1] END AS name, CASE WHEN len(rest) >= 2 THEN rest[-1] ELSE '' END AS court FROM f)
SELECT doc_id, rec_no, substr(sha1({sql_compact('type')} || '|' || {sql_compact('name')} || '|' || {sql_compact('court')}), 1, 12) AS id, type, name, court FROM g WHERE name <> ''""")
def text_records(spark, sf):
    """Lines of a document as records, their comma-separated pieces as cells."""
    rows = ingest.text_records(table(spark, sf, "documents"), "doc_id", "text", "\n", ", ")
    return rows.select("doc_id", "rec_no", "id", "type", "name", "court")


SHEET_SQL = """sheet AS (SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN p_brand ELSE p_partkey || '.' END AS a,
  CASE WHEN p_size = 50 THEN '' WHEN p_size > 40 THEN 'Организация ' || p_name ELSE p_name END AS b,
  CASE WHEN p_size % 2 = 0 THEN DATE '2010-01-01' + p_size END AS g, DATE '2011-02-01' + p_size AS h,
  lpad(CAST(1 + p_size % 28 AS VARCHAR), 2, '0') || '.03.2012' AS decided FROM part)"""


def _sheet(spark, sf):
    p = table(spark, sf, "part")
    size = F.col("p_size")
    text_of = lambda c: F.date_format(c, "dd.MM.yyyy")
    serial = F.datediff(F.date_add(F.lit("2010-01-01").cast("date"), size), F.lit("1899-12-30").cast("date")).cast("string")
    name = F.when(size == 50, "  ").when(size > 40, F.concat(F.lit(" Организация  "), "p_name")).otherwise(F.col("p_name"))
    decided = F.concat(F.lpad((1 + size % 28).cast("string"), 2, "0"), F.lit(".03.2012"))
    body = F.when(size < 20, "Решение КГБ").when(size < 30, "Решение МВД").otherwise("Решение суда")
    basis = F.concat(body, F.lit(" от "), decided, F.lit(" № "), size.cast("string"), F.lit("ЭК  \n\n\n\nи другие"))
    cells = F.create_map(
        F.lit("A"), F.when(F.col("p_type") == "PROMO", F.col("p_brand")).otherwise(F.concat(F.col("p_partkey").cast("string"), F.lit("."))),
        F.lit("B"), name, F.lit("F"), basis, F.lit("G"), F.when(size % 2 == 0, serial).otherwise("нет"),
        F.lit("H"), F.concat(text_of(F.date_add(F.lit("2011-02-01").cast("date"), size)), F.lit(" г.")),
    )
    return p.select("p_partkey", "p_size", "p_type", cells.alias("cells"))


@query("cellmap_records", f"""WITH {SHEET_SQL}
SELECT s.p_partkey, {sql_id('formation', sql_compact('b'), "decided || ' ' || p_size || 'ЭК'")} AS id, CASE WHEN p_size > 40 THEN 'organization' ELSE 'formation' END AS kind, b AS name,
CASE WHEN p_size < 20 THEN 'kgb' WHEN p_size < 30 THEN 'mvd' ELSE 'court' END AS decided_by, coalesce(g, strptime(decided, '%d.%m.%Y')::DATE) AS date, h AS included
FROM sheet s JOIN part USING (p_partkey) WHERE p_type <> 'PROMO' AND b <> ''""")
def cellmap_records(spark, sf):
    rows = ingest.cellmap_records(_sheet(spark, sf), ["p_partkey"])
    return rows.select("p_partkey", "id", "kind", "name", "decided_by", "date", "included")


FILTER_SQL = """f AS (SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'п/п' ELSE CAST(c_custkey AS VARCHAR) END AS num, CASE WHEN c_nationkey = 4 THEN '' ELSE c_name END AS name,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Санкционный перечень ООН' ELSE 'приговор суда, ст. ' || (100 + c_nationkey) END AS basis,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN '' ELSE strftime(DATE '1950-01-01' + c_nationkey * 200, '%d.%m.%Y') END AS birth, c_mktsegment, c_nationkey FROM customer)"""


def _filter_sheet(spark, sf):
    c = table(spark, sf, "customer")
    nation, segment = F.col("c_nationkey"), F.col("c_mktsegment")
    born = F.date_add(F.lit("1950-01-01").cast("date"), nation * 200)
    serial = F.datediff(born, F.lit("1899-12-30").cast("date")).cast("string")
    birth = F.when(segment == "FURNITURE", "д/о").when(segment == "BUILDING", serial).otherwise(F.date_format(born, "dd.MM.yyyy"))
    basis = F.when(segment == "MACHINERY", "Санкционный перечень ООН").otherwise(F.concat(F.lit("приговор суда , ст. "), (nation + 100).cast("string")))
    cells = F.create_map(
        F.lit("A"), F.when(nation == 3, "п/п").otherwise(F.col("c_custkey").cast("string")), F.lit("B"), F.when(nation == 4, " ").otherwise(F.col("c_name")),
        F.lit("C"), F.concat(F.lit("LATIN "), segment, F.when(nation == 5, ", может быть также известен как: OTHER").otherwise("")),
        F.lit("D"), F.lit("Д / О"), F.lit("E"), birth, F.lit("G"), basis,
    )
    return c.select("c_custkey", cells.alias("cells"))


@query("rule_filtered_ingest", f"""WITH {FILTER_SQL}
SELECT c_custkey, {sql_id('terror', sql_compact('name'), 'birth')} AS id, CAST(num AS BIGINT) AS num, name, 'LATIN ' || c_mktsegment AS translit, CASE WHEN c_nationkey = 5 THEN 'OTHER' ELSE '' END AS aka,
'' AS citizenship, birth, CAST(100 + c_nationkey AS VARCHAR) AS articles FROM f WHERE num <> 'п/п' AND name <> '' AND c_mktsegment <> 'MACHINERY'""")
def rule_filtered_ingest(spark, sf):
    kept, _ = ingest.rule_filtered_ingest(_filter_sheet(spark, sf), ["c_custkey"])
    return kept.select("c_custkey", "id", "num", "name", "translit", "aka", "citizenship", "birth", F.array_join("articles", ",").alias("articles"))


@query("rule_filtered_counts", f"""WITH {FILTER_SQL} SELECT count(*) AS total, count(*) FILTER (name <> '' AND c_mktsegment = 'MACHINERY') AS excluded, count(*) FILTER (name = '') AS skipped,
count(*) FILTER (name <> '' AND c_mktsegment <> 'MACHINERY' AND birth = '') AS no_birth FROM f WHERE num <> 'п/п'""")
def rule_filtered_counts(spark, sf):
    return ingest.rule_filtered_ingest(_filter_sheet(spark, sf), ["c_custkey"])[1]


JSON_SQL = """j AS (SELECT c_custkey, c_name AS n, CASE WHEN c_nationkey = 1 THEN 1890 WHEN c_nationkey = 2 THEN NULL ELSE 1950 + c_nationkey END AS year, c_mktsegment, c_nationkey,
  CASE WHEN c_acctbal >= 0 THEN DATE '2020-01-01' + c_nationkey END AS date FROM customer)"""


def _json_entries(spark, sf):
    c = table(spark, sf, "customer")
    nation, seg = F.col("c_nationkey"), F.col("c_mktsegment")
    text_of = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    year = F.when(nation == 1, "1890").when(nation == 2, '"early"').when(nation == 3, '"1953"').otherwise((nation + 1950).cast("string"))
    day = F.when(F.col("c_acctbal") >= 0, F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), nation), "yyyy-MM-dd")).otherwise("<2019-05")
    many = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit('"A'), i.cast("string"), F.lit('"'))), ",")
    fields = [
        F.concat(F.lit('"n":'), F.when(nation == 0, "7").otherwise(text_of(F.concat(F.lit("  "), F.regexp_replace("c_name", "#", "  #"))))),
        F.concat(F.lit('"d":'), year), F.concat(F.lit('"v":'), F.when(nation == 5, "5").otherwise(text_of(F.lit("x")))),
        F.concat(F.lit('"w":'), text_of(day)), F.concat(F.lit('"s":'), F.when(seg == "BUILDING", "2").when(seg == "MACHINERY", "1").otherwise("0")),
        F.concat(F.lit('"rf":'), text_of(F.when(seg == "FURNITURE", "terr").otherwise("odd"))),
        F.concat(F.lit('"a":'), F.when(nation == 6, F.concat(F.lit("["), many, F.lit("]"))).when(nation == 7, '["B", 3, ""]').otherwise("null")),
    ]
    raw = F.when(nation == 8, "not json").otherwise(F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")))
    return c.select("c_custkey", raw.alias("raw"))


VALID_JSON = "c_nationkey NOT IN (0, 1, 2, 8)"


@query("validated_ingest", f"""WITH {JSON_SQL}, k AS (SELECT *, replace(n, '#', ' #') AS name FROM j WHERE {VALID_JSON})
SELECT c_custkey, {sql_id('wanted', sql_compact('name'), 'CAST(year AS VARCHAR)')} AS id, name, year, CASE WHEN c_nationkey = 5 THEN '' ELSE 'x' END AS nationality, date,
CASE WHEN date IS NULL THEN '2019-05' ELSE '' END AS before, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'terr' ELSE '' END AS rf, c_mktsegment = 'BUILDING' AS out,
CASE c_nationkey WHEN 6 THEN 'A1,A2,A3,A4,A5,A6,A7,A8,A9,A10' WHEN 7 THEN 'B' END AS aliases FROM k""")
def validated_ingest(spark, sf):
    rows, _ = ingest.validated_ingest(_json_entries(spark, sf), ["c_custkey"], name_rule="\\p{L}")
    return rows.select("c_custkey", "id", "name", "year", "nationality", "date", "before", "rf", "out", F.array_join("aliases", ",").alias("aliases"))


@query("validated_counts", f"""WITH {JSON_SQL}, v AS (SELECT *, {VALID_JSON} AS ok FROM j) SELECT count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS skipped, count(*) FILTER (ok AND date IS NULL) AS approx,
count(*) FILTER (ok AND c_mktsegment = 'BUILDING') AS out, count(*) FILTER (ok AND c_mktsegment = 'MACHINERY') AS fresh FROM v""")
def validated_counts(spark, sf):
    return ingest.validated_ingest(_json_entries(spark, sf), ["c_custkey"], name_rule="\\p{L}")[1]


# --- anchor segments --------------------------------------------------------------------------------
# Each order gives a small ragged table of two persons: one regular row, one whose columns depend on the order.

ANCHOR_SQL = """o AS (SELECT o_orderkey, o_orderstatus AS st, substr(o_orderpriority, 1, 1) AS pr, strftime(o_orderdate, '%d.%m.%Y') AS d, CAST(100 + o_custkey % 800 AS VARCHAR) AS art FROM orders),
segs AS (
  SELECT o_orderkey, 0 AS seg, 'record' AS outcome, 0 AS dropped, 0 AS excluded, o_orderkey AS num, 'Красный Болт' AS name, 'Krasny Bolt' AS translit, 'Республика А' AS citizenship, d AS birth, art AS articles,
         d AS included, strptime(d, '%d.%m.%Y')::DATE AS date, 'адрес' AS address, 'справка' AS info FROM o
  UNION ALL
  SELECT o_orderkey, 1, CASE WHEN pr = '1' AND st = 'F' THEN 'unanchored' WHEN pr = '2' THEN 'skipped' ELSE 'record' END,
         CASE WHEN pr = '1' AND st = 'F' THEN 0 WHEN pr = '3' THEN 1 ELSE 0 END, CASE WHEN pr = '1' AND st = 'F' THEN 0 WHEN pr = '4' THEN 1 ELSE 0 END,
         7, 'Синий Винт', CASE WHEN pr = '5' THEN '' ELSE 'Sini Vint' END, '', CASE WHEN pr = '1' THEN '' ELSE '01.02.1990' END, art,
         CASE WHEN st = 'F' THEN '' ELSE d || ', 05.06.2020' END, CASE WHEN st <> 'F' THEN strptime(d, '%d.%m.%Y')::DATE END,
         CASE WHEN st = 'F' THEN 'улица' ELSE 'улица' END, 'отсрочка' FROM o)"""


def _anchor_docs(spark, sf):
    o = table(spark, sf, "orders").repartition(spark.sparkContext.defaultParallelism).select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate", "o_custkey")
    st, pr = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    d = F.date_format("o_orderdate", "dd.MM.yyyy")
    article = (100 + F.col("o_custkey") % 800).cast("string")
    basis = F.concat(F.lit("Вступивший в законную силу приговор суда района , статья "), article)
    first = [F.lit("№"), F.lit("ФИО"), F.col("o_orderkey").cast("string"), F.lit("Красный  Болт"), F.lit("Krasny Bolt"), F.lit("Республика А"), d, basis, d, F.lit("адрес"), F.lit("справка")]
    none = F.lit(None).cast("string")
    second = [
        F.when(pr == "4", "6"), F.when(pr == "4", "—"), F.when(pr == "3", "чужая ячейка"), F.lit("7"),
        F.when(pr == "2", "район").otherwise("Синий Винт"), F.when(pr != "5", "Sini Vint").otherwise(none), F.when(pr != "1", "01.02.1990").otherwise(""),
        basis, F.when(st != "F", F.concat(d, F.lit(" и 05.06.2020"))).otherwise(""), F.lit("улица"), F.lit("отсрочка"),
    ]
    return o.select("o_orderkey", F.concat_ws("\t", *first, *second).alias("body"))


@query("anchor_segments", f"""WITH {ANCHOR_SQL}
SELECT o_orderkey, seg, {sql_id('person', sql_compact('name'), 'birth', "split_part(included, ',', 1)")} AS id, num, name, translit, birth, articles, included, date, address, info
FROM segs WHERE outcome = 'record'""")
def anchor_segments(spark, sf):
    rows = ingest.anchor_segments(_anchor_docs(spark, sf), "o_orderkey", "body").filter("outcome = 'record'")
    return rows.select("o_orderkey", "seg", "id", "num", "name", "translit", "birth", F.array_join("articles", ",").alias("articles"), "included", "date", "address", "info")


@query("segment_metrics", f"""WITH {ANCHOR_SQL}
SELECT o_orderkey, count(*) FILTER (outcome = 'record') AS records, CAST(sum(excluded) AS BIGINT) AS excluded, count(*) FILTER (outcome = 'skipped') AS skipped,
count(*) FILTER (outcome = 'unanchored') AS unanchored, CAST(coalesce(sum(dropped) FILTER (seg > 0), 0) AS BIGINT) AS leftover, count(*) FILTER (outcome = 'record' AND included = '') AS no_included FROM segs GROUP BY 1""")
def segment_metrics(spark, sf):
    return ingest.segment_metrics(ingest.anchor_segments(_anchor_docs(spark, sf), "o_orderkey", "body"), "o_orderkey")


# --- messages, pages and posts ----------------------------------------------------------------------


@query("inbox_filter", """SELECT event_id AS update_id, 'f' || event_id AS file_id, 'list ' || user_id || '.XLSX' AS file_name,
CASE WHEN value >= 5 THEN CAST(ts AS DATE) END AS list_date, CASE event_type WHEN 'click' THEN 'https://t.me/chan/' || event_id ELSE 'telegram-bot:list ' || user_id || '.XLSX' END AS source_url
FROM events WHERE event_type IN ('click', 'view') AND value < 50""")
def inbox_filter(spark, sf):
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    message = F.to_json(F.struct(
        F.struct(F.when(kind == "error", 8).otherwise(7).alias("id")).alias("chat"),
        F.struct(
            F.concat(F.lit("f"), "event_id").alias("file_id"),
            F.concat(F.lit("list "), "user_id", F.when(kind == "signup", ".txt").otherwise(".XLSX")).alias("file_name"),
            F.when((kind == "purchase") | (F.col("value") >= 50), 6000000).otherwise(10).alias("file_size"),
        ).alias("document"),
        F.when(F.col("value") >= 5, F.concat(F.lit("от "), F.date_format("ts", "dd.MM.yyyy"))).otherwise("").alias("caption"),
        F.when(kind == "click", F.struct(F.lit("channel").alias("type"), F.struct(F.lit("chan").alias("username")).alias("chat"), F.col("event_id").alias("message_id"))).alias("forward_origin"),
    ))
    return ingest.inbox_files(e.select(F.col("event_id").alias("update_id"), message.alias("message")), "7")


HREF = "^/.*[a-zà-ÿ,.]$"
LINKS_SQL = f"""raw AS (SELECT page_id, url AS page, regexp_extract_all(html, '<a [^>]*href="([^"]+)"[^>]*>', 1) AS hs, regexp_extract_all(html, '<a [^>]*href="[^"]+"[^>]*>([^<]*)</a>', 1) AS ls FROM pages),
z AS (SELECT page_id, page, list_filter(list_zip(hs, ls), lambda x: regexp_matches(replace(x[1], '&amp;', '&'), '{HREF}')) AS zs FROM raw),
flat AS (SELECT page_id, page, unnest(range(0, len(zs))) AS link_no, unnest(zs) AS x FROM z),
links AS (SELECT page_id, link_no, regexp_extract(page, '^[a-z]+://[^/?#]+') || array_to_string(list_transform(regexp_extract_all(replace(x[1], '&amp;', '&'), '[!-~]+|[^!-~]+'),
  lambda p: CASE WHEN regexp_matches(p, '^[!-~]') THEN p ELSE url_encode(p) END), '') AS url, trim(regexp_replace(x[2], '\\s+', ' ', 'g')) AS label FROM flat)"""


def _links(spark, sf):
    return pages.page_links(table(spark, sf, "pages"), "page_id", "html", "url", HREF)


@query("page_links", f"WITH {LINKS_SQL} SELECT page_id, link_no, url, label FROM links")
def page_links(spark, sf):
    return _links(spark, sf)


@query("ranked_links", f"""WITH {LINKS_SQL}, u AS (SELECT page_id, url, min(link_no) AS ord, arg_max(label, link_no) AS label FROM links WHERE regexp_matches(label, '[aeiou]') GROUP BY 1, 2)
SELECT page_id, url, label, row_number() OVER (PARTITION BY page_id ORDER BY length(regexp_extract(label, '^[a-z]+')), ord) AS place FROM u""")
def ranked_links(spark, sf):
    """The part number is played by the length of the label's first word."""
    from pyspark.sql import Window

    rows = _links(spark, sf)
    numbered = rows.withColumn("label", F.concat("label", F.lit(" часть "), F.length(F.regexp_extract("label", "^[a-z]+", 0)).cast("string")))
    kept = numbered.filter(F.regexp_extract("label", "^(.*) часть", 1).rlike("[aeiou]"))
    ranked = pages.ranked_links(kept, "page_id", "часть")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("rank_key"))  # links of one page
    return ranked.select("page_id", "url", F.regexp_extract("label", "^(.*) часть", 1).alias("label"), place.alias("place"))


@query("preferred_link", f"""WITH {LINKS_SQL} SELECT page_id, arg_min(url, ((NOT regexp_matches(label, 'tion'))::INT, link_no)) AS url, arg_min(label, ((NOT regexp_matches(label, 'tion'))::INT, link_no)) AS label FROM links GROUP BY 1""")
def preferred_link(spark, sf):
    return pages.preferred_link(_links(spark, sf), "page_id", "tion")


@query("candidate_links", f"""WITH {LINKS_SQL}, u AS (SELECT page_id, url, min(link_no) AS ord FROM links GROUP BY 1, 2)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1 AS rank, url FROM u QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ord) <= 3""")
def candidate_links(spark, sf):
    return pages.candidate_links(_links(spark, sf), "page_id")


@query("best_source", """SELECT list_position(['es', 'de', 'fr', 'en'], lang) AS priority, CAST(substr(source, 4) AS INT) AS ord, count(*) AS n FROM documents GROUP BY 1, 2 ORDER BY 1, 3 DESC, 2 LIMIT 1""")
def best_source(spark, sf):
    rank = F.array_position(F.array(*[F.lit(x) for x in ("es", "de", "fr", "en")]), F.col("lang"))
    rows = table(spark, sf, "documents").select(rank.alias("priority"), F.substring("source", 4, 9).cast("int").alias("ord"))
    return lists.best_source(rows)


POSTS_SQL = """posts AS (
  SELECT c_nationkey AS channel, c_custkey * 2 + 1 AS post_id, 'Перечень организаций и физических лиц, причастных к террористической деятельности от ' || strftime(DATE '2020-01-01' + CAST(c_custkey % 700 AS INT), '%d.%m.%Y') || ' & "ещё"' AS text,
         'list.xlsx' AS file_name, '1 KB' AS size, '2021-05-06T07:08:09+00:00' AS stamp, DATE '2020-01-01' + CAST(c_custkey % 700 AS INT) AS version, c_mktsegment <> 'BUILDING' AS fits FROM customer
  UNION ALL SELECT c_nationkey, c_custkey * 2 + 2, 'Новости ' || c_name, '', '', '2021-05-07T07:08:09+00:00', DATE '2021-05-07', false FROM customer)"""


def _channel_pages(spark, sf):
    """A page of two posts per customer."""
    c = table(spark, sf, "customer")
    key = F.col("c_custkey")
    version = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (key % 700).cast("int")), "dd.MM.yyyy")
    post = lambda n: F.concat(F.lit('<div class="tgme_widget_message_wrap x"><div data-post="chan/'), (key * 2 + n).cast("string"), F.lit('">'))
    body = lambda t: F.concat(F.lit('<div class="tgme_widget_message_text js" dir="auto">'), t, F.lit("</div>"))
    first = F.concat(
        post(1), body(F.concat(F.lit("Перечень организаций и<br/>физических лиц, причастных к <b>террористической</b> деятельности от&nbsp;"), version, F.lit(" &amp; &quot;ещё&quot;"))),
        F.lit('<div class="tgme_widget_message_document_title" dir="auto">list.xlsx</div><div class="tgme_widget_message_document_extra">1 KB</div>'),
        F.lit('<time class="time" datetime="2021-05-06T07:08:09+00:00">07:08</time></div></div>'),
    )
    second = F.concat(post(2), body(F.concat(F.lit("Новости  "), "c_name")), F.lit('<time datetime="2021-05-07T07:08:09+00:00"></time></div></div>'))
    return c.select(F.col("c_nationkey").alias("channel"), "c_mktsegment", F.concat(F.lit("<html>head"), first, second).alias("html"))


@query("page_blocks", f"WITH {POSTS_SQL} SELECT channel, post_id, text, file_name, size, stamp FROM posts")
def page_blocks(spark, sf):
    return pages.page_blocks(_channel_pages(spark, sf), "channel", "html")


@query("fresh_version", f"""WITH {POSTS_SQL}, n AS (SELECT channel, max(post_id) AS post_id, arg_max(version, post_id) AS version FROM posts WHERE file_name = 'list.xlsx' GROUP BY 1)
SELECT channel, post_id, version, version > DATE '2020-06-01' + n_regionkey * 90 AND post_id > n_nationkey * 100 AS is_fresh FROM n JOIN nation ON n_nationkey = channel""")
def fresh_version(spark, sf):
    state = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("channel"), F.date_add(F.lit("2020-06-01").cast("date"), F.col("n_regionkey") * 90).alias("source_date"),
        (F.col("n_nationkey") * 100).alias("announced"),
    )
    posts = pages.page_blocks(_channel_pages(spark, sf), "channel", "html")
    return pages.fresh_version(posts, state, "channel").select("channel", "post_id", "version", "is_fresh")
