"""Inputs of the registered queries, derived from the given tables, each as a frame and as SQL.

Every derivation keeps all rows of its table; roles (removed, re-keyed, edited …) follow from column values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import MONTHS
from ..functions.text import FOLD_FROM, FOLD_TO, LOWER_GUARD
from ..session import path_bytes
from ..sources.publish import haystack

TODAY = "2001-08-01"
AS_OF = "2000-01-01"
LISTS = ["m", "f", "p"]
TEXTS = {"documents", "pages"}  # few large rows, much work per row
TEXT_BYTES = 16_000_000  # of such a table, as it is compressed, for one task


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    path = f"{sf}/{name}.parquet"
    df = spark.read.parquet(path)
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-path_bytes(spark, path) // TEXT_BYTES))) if name in TEXTS else df


def day(text: str) -> Column:
    return F.lit(text).cast("date")


# --- SQL snippets ----------------------------------------------------------------------------------

def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_norm(x: str) -> str:
    return f"translate(lower(translate({x}, {q(LOWER_GUARD[0])}, {q(LOWER_GUARD[1])})), {q(FOLD_FROM)}, {q(FOLD_TO)})"


def sql_compact(x: str) -> str:
    return f"trim(regexp_replace({sql_norm(x)}, ' {{2,}}', ' ', 'g'))"


def sql_id(kind: str, *parts: str) -> str:
    return f"substr(sha1(concat_ws('|', {q(kind)}, {', '.join(parts)})), 1, 12)"


def sql_date_words(x: str) -> str:
    months = "[" + ", ".join(q(m) for m in MONTHS) + "]"
    return (
        f"CASE WHEN {x} IS NULL THEN '' ELSE concat(day({x}), ' ', {months}[month({x})], ' ', year({x}), ' ', strftime({x}, '%d.%m.%Y')) END"
    )


# DuckDB's levenshtein counts bytes; every accented letter is mapped to one byte first, so it counts letters.
ACCENTED = "іáàâäãåæçéèêëíìîïñóòôöõøúùûüýÿßœ"
ONE_BYTE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()*+"[: len(ACCENTED)]


def sql_lev(a: str, b: str) -> str:
    return f"levenshtein(translate({a}, {q(ACCENTED)}, {q(ONE_BYTE)}), translate({b}, {q(ACCENTED)}, {q(ONE_BYTE)}))"


# --- a base list and its next snapshot (orders) ----------------------------------------------------

BASE_SQL = """base AS (
  SELECT o_orderkey AS id, o_custkey AS cust, o_orderstatus AS state, o_totalprice AS price, o_orderpriority AS priority,
         o_orderkey AS ord, CAST(NULL AS DATE) AS added, (o_orderpriority = '5-LOW' AND o_orderstatus = 'F') AS is_removed,
         CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN DATE '2001-01-01' END AS removed,
         CAST(NULL AS DATE) AS edited, CAST(NULL AS BIGINT) AS edit_of, CAST(NULL AS BIGINT) AS replaced_by
  FROM orders)"""
SNAP_SQL = """snap AS (
  SELECT CASE WHEN o_totalprice >= 480000 THEN -o_orderkey - 1 ELSE o_orderkey END AS id, o_custkey AS cust, o_orderstatus AS state,
         CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS price, o_orderpriority AS priority,
         o_orderkey AS src_pos FROM orders
  UNION ALL
  SELECT CASE WHEN o_totalprice >= 480000 THEN -o_orderkey - 1 ELSE o_orderkey END, o_custkey, o_orderstatus,
         o_totalprice + 2, o_orderpriority, o_orderkey + 1000000000000 FROM orders WHERE o_orderpriority = '1-URGENT')"""
LATEST_SQL = "latest AS (SELECT * FROM snap QUALIFY row_number() OVER (PARTITION BY id ORDER BY src_pos DESC) = 1)"
COMPARED = ["cust", "state", "price", "priority"]


def base_list(spark: SparkSession, sf: str) -> DataFrame:
    gone = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "F")
    none = lambda t: F.lit(None).cast(t)
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("state"),
        F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("ord"),
        none("date").alias("added"), gone.alias("is_removed"), F.when(gone, day("2001-01-01")).alias("removed"),
        none("date").alias("edited"), none("bigint").alias("edit_of"), none("bigint").alias("replaced_by"),
    )


def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    ident = F.when(F.col("o_totalprice") >= 480000, -F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey")).alias("id")
    cols = [ident, F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("state")]
    first = orders.select(
        *cols, F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("price"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("src_pos"),
    )
    again = orders.filter(F.col("o_orderpriority") == "1-URGENT").select(
        *cols, (F.col("o_totalprice") + 2).alias("price"), F.col("o_orderpriority").alias("priority"),
        (F.col("o_orderkey") + F.lit(1000000000000)).alias("src_pos"),
    )
    return first.unionByName(again)


# --- three tagged lists with history and search text (part, supplier, customer) --------------------

ITEM_COLS = ["list", "id", "pos", "name", "label", "place", "series", "date", "added", "removed", "replaced_by", "merged_into", "marked"]
ITEMS_SQL = f"""raw_items AS (
  SELECT 'm' AS list, 'm' || p_partkey AS id, p_partkey AS pos, p_name AS name, p_type AS label, p_brand AS place, lower(p_type) AS series,
         CASE WHEN p_size < 50 THEN DATE '1995-01-01' + p_size * 40 END AS date,
         CASE WHEN p_size >= 5 THEN DATE '1995-01-01' + p_size * 40 END AS added,
         CASE WHEN p_brand = 'Brand#7' THEN DATE '1999-12-20' END AS removed,
         CASE WHEN p_brand = 'Brand#13' THEN 'm0' END AS replaced_by, CAST(NULL AS VARCHAR) AS merged_into, false AS marked FROM part
  UNION ALL
  SELECT 'f', 'f' || s_suppkey, 1000000000000 + s_suppkey, s_name, 'Supplier', 'NATION_' || s_nationkey, 'court',
         CAST(NULL AS DATE), CAST(NULL AS DATE), CASE WHEN s_acctbal < 0 THEN DATE '1999-01-01' END, NULL, NULL, false FROM supplier
  UNION ALL
  SELECT 'p', 'p' || c_custkey, 2000000000000 + c_custkey, c_name, c_mktsegment, 'NATION_' || c_nationkey,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN 'terror' ELSE 'other' END,
         CASE WHEN c_mktsegment <> 'BUILDING' THEN DATE '1999-11-20' + c_nationkey * 3 END,
         DATE '1999-11-20' + c_nationkey * 3, CASE WHEN c_acctbal < 0 THEN DATE '1999-12-25' END, NULL,
         CASE WHEN c_mktsegment = 'MACHINERY' AND c_acctbal > 5000 THEN 'p0' END, c_mktsegment = 'HOUSEHOLD' FROM customer),
items AS (SELECT *, concat_ws(chr(10), {sql_compact('name')}, {sql_compact('label')}, {sql_compact('place')}, {sql_date_words('date')}) AS h FROM raw_items)"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    start = F.lit("1995-01-01").cast("date")
    sized = F.date_add(start, F.col("p_size") * 40)
    text, date = (lambda: F.lit(None).cast("string")), (lambda: F.lit(None).cast("date"))
    part = table(spark, sf, "part").select(
        F.lit("m"), F.concat(F.lit("m"), "p_partkey"), "p_partkey", "p_name", "p_type", "p_brand", F.lower("p_type"),
        F.when(F.col("p_size") < 50, sized), F.when(F.col("p_size") >= 5, sized),
        F.when(F.col("p_brand") == "Brand#7", day("1999-12-20")), F.when(F.col("p_brand") == "Brand#13", "m0"), text(), F.lit(False),
    ).toDF(*ITEM_COLS)
    supplier = table(spark, sf, "supplier").select(
        F.lit("f"), F.concat(F.lit("f"), "s_suppkey"), F.col("s_suppkey") + F.lit(1000000000000), "s_name", F.lit("Supplier"),
        F.concat(F.lit("NATION_"), "s_nationkey"), F.lit("court"), date(), date(), F.when(F.col("s_acctbal") < 0, day("1999-01-01")),
        text(), text(), F.lit(False),
    ).toDF(*ITEM_COLS)
    seen = F.date_add(F.lit("1999-11-20").cast("date"), F.col("c_nationkey") * 3)
    machinery = F.col("c_mktsegment") == "MACHINERY"
    customer = table(spark, sf, "customer").select(
        F.lit("p"), F.concat(F.lit("p"), "c_custkey"), F.col("c_custkey") + F.lit(2000000000000), "c_name", "c_mktsegment",
        F.concat(F.lit("NATION_"), "c_nationkey"), F.when(machinery, "terror").otherwise("other"),
        F.when(F.col("c_mktsegment") != "BUILDING", seen), seen, F.when(F.col("c_acctbal") < 0, day("1999-12-25")), text(),
        F.when(machinery & (F.col("c_acctbal") > 5000), "p0"), F.col("c_mktsegment") == "HOUSEHOLD",
    ).toDF(*ITEM_COLS)
    rows = part.unionByName(supplier).unionByName(customer)
    return rows.withColumn("h", haystack([F.col("name")], F.col("label"), F.col("place"), F.col("date")))


# --- texts ------------------------------------------------------------------------------------------

DOCS_SQL = f"docs AS (SELECT doc_id AS id, {sql_norm('text')} AS h, text, lang, source FROM documents)"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.text import normalize

    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), normalize(F.col("text")).alias("h"), "text", "lang", "source")


# --- queries ----------------------------------------------------------------------------------------

ITEM_QUERIES = [
    (1, "red widget"), (2, '"hot plate" promo'), (3, "brand#4 gear"), (4, "Supplier#000000007"), (5, "gizmoo"),
    (6, "customer BUILDING"), (7, "widgget medium"), (8, "января"), (9, "custommer household"), (10, "nothinglikethis"),
    (11, "@small, ring!"), (12, "suplier"),
]
ITEM_TOKENS = [
    (1, ["red", "widget"]), (2, ["hot plate", "promo"]), (3, ["brand#4", "gear"]), (4, ["supplier#000000007"]), (5, ["gizmoo"]),
    (6, ["customer", "building"]), (7, ["widgget", "medium"]), (8, ["января"]), (9, ["custommer", "household"]),
    (10, ["nothinglikethis"]), (11, ["small", "ring"]), (12, ["suplier"]),
]
DOC_QUERIES = [(1, "the and"), (2, '"of the"'), (3, "nicht die"), (4, "que les"), (5, "license"), (6, "@example.com")]
DOC_TOKENS = [(1, ["the", "and"]), (2, ["of the"]), (3, ["nicht", "die"]), (4, ["que", "les"]), (5, ["license"]), (6, ["example.com"])]


def queries_of(spark: SparkSession, pairs: list[tuple[int, str]]) -> DataFrame:
    return spark.createDataFrame(pairs, "q int, query string")


def sql_tokens(tokens: list[tuple[int, list[str]]]) -> str:
    rows = ", ".join(f"({n}, {i}, {sql_norm(q(t))})" for n, ts in tokens for i, t in enumerate(ts))
    return f"tokens(q, token_no, token) AS (VALUES {rows})"
