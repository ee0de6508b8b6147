"""Merge, linking and guard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import guards, link, merge
from ..operators.health import run_meta
from ..operators.position import dict_encode, keep_last
from ..session import unsent, work_dir
from ..sources.lists import union_parts
from ..sources.buckets import BucketedList, merge_incremental
from ..sources.publish import chunk_rows, publish_versioned, read_chunks, read_current, write_chunks
from .inputs import BASE_SQL, COMPARED, LATEST_SQL, SNAP_SQL, TODAY, base_list, day, snapshot, table
from .registry import query

MERGED_SQL = f"""{BASE_SQL}, {SNAP_SQL}, {LATEST_SQL},
joined AS (
  SELECT coalesce(b.id, s.id) AS id, b.id IS NULL AS is_new, s.id IS NULL AND NOT b.is_removed AS is_gone,
         coalesce(b.is_removed AND s.id IS NOT NULL, false) AS is_back,
         coalesce(b.id IS NOT NULL AND s.id IS NOT NULL AND (b.cust, b.state, b.price, b.priority) IS DISTINCT FROM (s.cust, s.state, s.price, s.priority), false) AS is_edited,
         coalesce(s.cust, b.cust) AS cust, coalesce(s.state, b.state) AS state, coalesce(s.price, b.price) AS price,
         coalesce(s.priority, b.priority) AS priority, coalesce(s.src_pos, b.ord) AS ord, b.is_removed AS was_removed, b.removed AS was_removed_on
  FROM base b FULL OUTER JOIN latest s ON b.id = s.id),
merged AS (
  SELECT id, cust, state, price, priority, ord, CASE WHEN is_new THEN DATE '{TODAY}' END AS added,
         CASE WHEN is_back THEN false ELSE coalesce(was_removed, false) OR is_gone END AS is_removed,
         CASE WHEN is_back THEN NULL WHEN is_gone THEN DATE '{TODAY}' ELSE was_removed_on END AS removed,
         CASE WHEN is_edited THEN DATE '{TODAY}' END AS edited,
         CASE WHEN is_new THEN 'new' WHEN is_gone THEN 'removed' WHEN is_back AND is_edited THEN 'returned_edited'
              WHEN is_back THEN 'returned' WHEN is_edited THEN 'edited' ELSE 'kept' END AS status
  FROM joined)"""
MERGED_COLS = ["id", "cust", "state", "price", "priority", "ord", "added", "is_removed", "removed", "edited", "status"]


def merged(spark, sf):
    return merge.snapshot_merge(base_list(spark, sf), snapshot(spark, sf), day(TODAY), COMPARED, initial=False)


@query("snapshot_merge", f"WITH {MERGED_SQL} SELECT {', '.join(MERGED_COLS)} FROM merged")
def snapshot_merge(spark, sf):
    return merged(spark, sf).select(*MERGED_COLS)


@query("merge_counts", f"""WITH {MERGED_SQL}
SELECT count(*) FILTER (status = 'new') AS added, count(*) FILTER (status = 'removed') AS removed,
       count(*) FILTER (status IN ('edited', 'returned_edited')) AS edited, 0 AS edits,
       count(*) FILTER (status IN ('returned', 'returned_edited')) AS returned, count(*) FILTER (status <> 'new') AS base_rows,
       CASE WHEN count(*) FILTER (status = 'removed') > greatest(20, count(*) FILTER (status <> 'new') * 0.05) THEN 'too_many_removed'
            WHEN count(*) FILTER (status = 'new') > 400 THEN 'too_many_added' ELSE 'ok' END AS verdict FROM merged""")
def merge_counts(spark, sf):
    return merge.merge_guards(merge.merge_counts(merged(spark, sf)), max_added=400)


@query("removed_rows", f"WITH {BASE_SQL}, {SNAP_SQL} SELECT id, price, ord FROM base WHERE NOT is_removed AND id NOT IN (SELECT id FROM snap)")
def removed_rows(spark, sf):
    return merge.removed_rows(base_list(spark, sf), snapshot(spark, sf)).select("id", "price", "ord")


@query("returned_rows", f"WITH {BASE_SQL}, {SNAP_SQL} SELECT id, removed, ord FROM base WHERE is_removed AND id IN (SELECT id FROM snap)")
def returned_rows(spark, sf):
    return merge.returned_rows(base_list(spark, sf), snapshot(spark, sf)).select("id", "removed", "ord")


@query("added_rows", f"WITH {BASE_SQL}, {SNAP_SQL}, {LATEST_SQL} SELECT id, price, src_pos FROM latest WHERE id NOT IN (SELECT id FROM base)")
def added_rows(spark, sf):
    return merge.added_rows(base_list(spark, sf), snapshot(spark, sf)).select("id", "price", "src_pos")


@query("reorder", f"""WITH {BASE_SQL}, {SNAP_SQL}, {LATEST_SQL}
SELECT b.id, coalesce(l.src_pos, (SELECT count(*) FROM snap) + b.ord) AS new_ord FROM base b LEFT JOIN latest l ON b.id = l.id""")
def reorder(spark, sf):
    return merge.reorder(base_list(spark, sf), snapshot(spark, sf)).select("id", "new_ord")


NAMES_SQL = """list_old AS (
  SELECT 'n' || n_nationkey AS id, md5(n_name) AS name, 1990 + n_regionkey AS year, n_nationkey AS ord FROM nation
  UNION ALL SELECT 's' || s_suppkey, md5(s_name), 3000 + s_suppkey, 500 + s_suppkey FROM supplier
  UNION ALL SELECT 'c' || c_custkey, md5(c_name), 1990 + c_nationkey, 10000000000 + c_custkey FROM customer),
list_new AS (
  SELECT 'r' || n_nationkey AS id, 'x' || substr(md5(n_name), 2) AS name, 1990 + n_regionkey AS year FROM nation
  UNION ALL SELECT 't' || s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN md5(s_name) ELSE 'xy' || substr(md5(s_name), 3) END, 3000 + s_suppkey + CASE WHEN s_suppkey % 3 = 0 THEN 1000000000 ELSE 0 END FROM supplier
  UNION ALL SELECT 'u' || s_suppkey, 'z' || substr(md5(s_name), 2), 3000 + s_suppkey FROM supplier WHERE s_suppkey % 5 = 0
  UNION ALL SELECT 'c' || c_custkey, md5(c_name), 1990 + c_nationkey FROM customer)"""


def _renamed_lists(spark, sf):
    """A list of which nations and suppliers are re-issued under a new id: with a letter or two changed, or with another year, and
    every fifth supplier with a second record that fits as well; customers stay."""
    nation, customer, supplier = (table(spark, sf, t) for t in ("nation", "customer", "supplier"))

    def rows(df, tag, key, name, year, *more):
        return df.select(F.concat(F.lit(tag), key).alias("id"), name.alias("name"), year.cast("long").alias("year"), *more)

    c_name, n_name, s_name = F.md5("c_name"), F.md5("n_name"), F.md5("s_name")
    n_year, c_year, s_year = F.col("n_regionkey") + 1990, F.col("c_nationkey") + 1990, F.col("s_suppkey") + 3000
    moved = F.col("s_suppkey") % 3 == 0
    old = (
        rows(nation, "n", "n_nationkey", n_name, n_year, F.col("n_nationkey").cast("long").alias("ord"))
        .unionByName(rows(supplier, "s", "s_suppkey", s_name, s_year, (F.col("s_suppkey") + 500).cast("long").alias("ord")))
        .unionByName(rows(customer, "c", "c_custkey", c_name, c_year, (F.col("c_custkey") + F.lit(10000000000)).alias("ord")))
    )
    changed = F.when(moved, s_name).otherwise(F.concat(F.lit("xy"), F.substr(s_name, F.lit(3))))
    new = (
        rows(nation, "r", "n_nationkey", F.concat(F.lit("x"), F.substr(n_name, F.lit(2))), n_year)
        .unionByName(rows(supplier, "t", "s_suppkey", changed, s_year + F.when(moved, 1000000000).otherwise(0)))
        .unionByName(rows(supplier.filter("s_suppkey % 5 = 0"), "u", "s_suppkey", F.concat(F.lit("z"), F.substr(s_name, F.lit(2))), s_year))
        .unionByName(rows(customer, "c", "c_custkey", c_name, c_year))
    )
    return old, new


EDGES_SQL = f"""{NAMES_SQL},
gone AS (SELECT * FROM list_old WHERE id NOT IN (SELECT id FROM list_new)),
fresh AS (SELECT * FROM list_new WHERE id NOT IN (SELECT id FROM list_old)),
edges AS (SELECT g.id AS old_id, f.id AS new_id FROM gone g JOIN fresh f ON g.year = f.year AND levenshtein(g.name, f.name) <= 5
  UNION SELECT g.id, f.id FROM gone g JOIN fresh f ON g.year <> f.year AND g.name = f.name),
edit_pairs AS (SELECT old_id, new_id FROM edges QUALIFY count(*) OVER (PARTITION BY old_id) = 1)"""


@query("edit_pairs", f"WITH {EDGES_SQL} SELECT old_id, new_id FROM edit_pairs")
def edit_pairs(spark, sf):
    """No two old records share a candidate here, so the order decides nothing; tests cover the order."""
    old, new = _renamed_lists(spark, sf)
    gone = old.join(unsent(new.select("id")), "id", "left_anti").withColumnRenamed("ord", "base_ord")
    fresh = new.join(unsent(old.select("id")), "id", "left_anti")
    return merge.pair_edits(gone, fresh, merge.year_rule, merge.year_blocks)


def _history(rows, added="1999-01-01"):
    none = lambda t: F.lit(None).cast(t)
    return rows.withColumns({
        "added": day(added), "is_removed": F.lit(False), "removed": none("date"), "edited": none("date"), "edit_of": none("string"), "replaced_by": none("string")})


@query("snapshot_merge_edits", f"""WITH {EDGES_SQL}, all_ids AS (SELECT id FROM list_old UNION SELECT id FROM list_new),
rows AS (SELECT a.id, o.id IS NOT NULL AS was, n.id IS NOT NULL AS is_in, p.new_id, q.old_id, o.ord AS base_ord FROM all_ids a LEFT JOIN list_old o ON o.id = a.id LEFT JOIN list_new n ON n.id = a.id
  LEFT JOIN edit_pairs p ON p.old_id = a.id LEFT JOIN edit_pairs q ON q.new_id = a.id)
SELECT id, CASE WHEN was OR old_id IS NOT NULL THEN DATE '1999-01-01' ELSE DATE '{TODAY}' END AS added, NOT is_in AS is_removed, CASE WHEN NOT is_in THEN DATE '{TODAY}' END AS removed,
  CASE WHEN old_id IS NOT NULL THEN DATE '{TODAY}' END AS edited, old_id AS edit_of, new_id AS replaced_by,
  CASE WHEN old_id IS NOT NULL THEN 'edit_new' WHEN new_id IS NOT NULL THEN 'edit_old' WHEN NOT was THEN 'new' WHEN NOT is_in THEN 'removed' ELSE 'kept' END AS status FROM rows""")
def snapshot_merge_edits(spark, sf):
    """Re-issued records keep their first day, and both versions point at each other."""
    old, new = _renamed_lists(spark, sf)
    base, snap = _history(old), new.withColumn("src_pos", F.xxhash64("id"))
    rows = merge.snapshot_merge(base, snap, day(TODAY), ["name", "year"], initial=False, rule=merge.year_rule, blocks=merge.year_blocks)
    return rows.select("id", "added", "is_removed", "removed", "edited", "edit_of", "replaced_by", "status")


@query("merge_versioned", f"""WITH {EDGES_SQL}
SELECT n.id, CASE WHEN q.old_id IS NOT NULL THEN DATE '1998-05-05' WHEN o.id IS NOT NULL THEN DATE '1998-05-05' ELSE DATE '2001-07-07' END AS since,
  CASE WHEN q.old_id IS NOT NULL THEN 'edit_new' WHEN o.id IS NULL THEN 'new' ELSE 'kept' END AS status
FROM list_new n LEFT JOIN list_old o ON o.id = n.id LEFT JOIN edit_pairs q ON q.new_id = n.id
UNION ALL SELECT o.id, DATE '1998-05-05', CASE WHEN p.new_id IS NOT NULL THEN 'edit_old' ELSE 'removed' END FROM list_old o LEFT JOIN edit_pairs p ON p.old_id = o.id WHERE o.id NOT IN (SELECT id FROM list_new)""")
def merge_versioned(spark, sf):
    """A list that knows since when a record is in it: a re-issued one inherits the day, a new one gets that of the file."""
    old, new = _renamed_lists(spark, sf)
    base, snap = _history(old).withColumn("since", day("1998-05-05")), new.withColumn("src_pos", F.xxhash64("id"))
    rows = merge.snapshot_merge(
        base, snap, day(TODAY), ["name", "year"], initial=False, rule=merge.year_rule, blocks=merge.year_blocks, first_seen=day("2001-07-07"))
    return rows.select("id", "since", "status")


@query("merge_excluded", f"""WITH {BASE_SQL}, {SNAP_SQL}, {LATEST_SQL}, flagged AS (SELECT *, cust % 7 = 0 AS out FROM latest),
live AS (SELECT * FROM flagged WHERE NOT out)
SELECT coalesce(b.id, f.id) AS id, coalesce(f.src_pos, (SELECT count(*) FROM snap) + b.ord) AS ord,
  CASE WHEN b.id IS NULL AND NOT f.out THEN DATE '{TODAY}' END AS added,
  CASE WHEN b.id IS NULL THEN f.out WHEN l.id IS NOT NULL THEN false ELSE true END AS is_removed,
  CASE WHEN b.id IS NULL OR l.id IS NOT NULL THEN NULL WHEN b.is_removed THEN b.removed ELSE DATE '{TODAY}' END AS removed,
  coalesce(f.price, b.price) AS price,
  CASE WHEN b.id IS NULL AND f.out THEN 'excluded' WHEN b.id IS NULL THEN 'new' WHEN l.id IS NULL AND NOT b.is_removed THEN 'removed' WHEN l.id IS NULL THEN 'kept'
       WHEN b.is_removed AND l.price IS DISTINCT FROM b.price THEN 'returned_edited' WHEN b.is_removed THEN 'returned' WHEN l.price IS DISTINCT FROM b.price THEN 'edited' ELSE 'kept' END AS status
FROM base b FULL OUTER JOIN flagged f ON f.id = b.id LEFT JOIN live l ON l.id = b.id""")
def merge_excluded(spark, sf):
    """The source flags every seventh customer's records itself."""
    snap = snapshot(spark, sf).withColumn("out", F.col("cust") % 7 == 0)
    return merge.merge_with_exclusions(base_list(spark, sf), snap, day(TODAY), COMPARED, initial=False).select("id", "ord", "added", "is_removed", "removed", "price", "status")


FOLD_SQL = """lists AS (
  SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS name, strftime(o_orderdate, '%d.%m.%Y') AS birth, o_orderkey AS ord,
         o_orderstatus = 'F' AS folds FROM orders),
cand AS (
  SELECT t.id AS t_id, t.ord AS t_ord, p.id AS p_id,
         row_number() OVER (PARTITION BY t.id ORDER BY CASE WHEN p.birth = t.birth THEN 0 ELSE 1 END, p.ord) AS rn
  FROM lists t JOIN lists p ON p.name = t.name AND t.folds AND NOT p.folds
   AND (p.birth = t.birth OR (substr(p.birth, 1, 2) = substr(t.birth, 1, 2))::INT + (substr(p.birth, 4, 2) = substr(t.birth, 4, 2))::INT
        + (substr(p.birth, 7) = substr(t.birth, 7))::INT >= 2)),
folded AS (SELECT t_id AS id, p_id AS merged_into FROM cand WHERE rn = 1 QUALIFY row_number() OVER (PARTITION BY p_id ORDER BY t_ord) = 1)"""


def _fold_lists(spark, sf):
    """Orders of one state against all the others: name is the customer, birth the order day."""
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("name"),
        F.date_format("o_orderdate", "dd.MM.yyyy").alias("birth"), F.col("o_orderkey").alias("ord"), "o_orderstatus",
    )
    folds = F.col("o_orderstatus") == "F"
    return rows.filter(~folds).drop("o_orderstatus"), rows.filter(folds).drop("o_orderstatus")


@query("fold_lists", f"WITH {FOLD_SQL} SELECT id, merged_into FROM folded")
def fold_lists(spark, sf):
    return link.fold_lists(*_fold_lists(spark, sf))


@query("link_target", f"""WITH {FOLD_SQL} SELECT l.id, f.merged_into, coalesce(f.merged_into, l.id) AS target, p.name AS target_name
FROM lists l LEFT JOIN folded f ON l.id = f.id LEFT JOIN lists p ON p.id = coalesce(f.merged_into, l.id)""")
def link_target(spark, sf):
    primary, folded = _fold_lists(spark, sf)
    everyone = primary.unionByName(folded)
    rows = link.link_target(everyone, link.fold_lists(primary, folded))
    names = everyone.select(F.col("id").alias("target"), F.col("name").alias("target_name"))
    return rows.select("id", "merged_into", "target").join(names, "target", "left")


LINK_SQL = """w AS (SELECT p_partkey AS id, p_size AS year, unnest(list_distinct([p_name, split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)])) AS name
  FROM part WHERE p_type IN ('PROMO', 'ECONOMY', 'STANDARD')),
p AS (SELECT p_partkey AS id, p_size AS year,
  CASE WHEN p_type = 'LARGE' THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) ELSE p_name END AS name
  FROM part WHERE p_type NOT IN ('PROMO', 'ECONOMY', 'STANDARD')),
pairs AS (SELECT DISTINCT p.id AS p_id, w.id AS w_id FROM p JOIN w ON p.name = w.name AND p.year = w.year)"""


@query("cross_links", f"""WITH {LINK_SQL}
SELECT 'p' AS list, p_id AS id, count(*) AS links, min(w_id) AS first_link FROM pairs GROUP BY p_id
UNION ALL SELECT 'w', w_id, count(*), min(p_id) FROM pairs GROUP BY w_id""")
def cross_links(spark, sf):
    return link.cross_links(*_persons_and_wanted(spark, sf))


@query("links_of", f"""WITH {LINK_SQL} SELECT p_id AS person_id, w_id AS wanted_id FROM pairs WHERE p_id IN (SELECT l_partkey FROM lineitem)""")
def links_of(spark, sf):
    """The linked ids of every record that is asked for: those that occur in orders."""
    asked = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"))
    return link.links_of(asked, *_persons_and_wanted(spark, sf))


def _persons_and_wanted(spark, sf):
    part = table(spark, sf, "part")
    turned = F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(2)), F.split_part("p_name", F.lit(" "), F.lit(1)))
    wanted_type = F.col("p_type").isin("PROMO", "ECONOMY", "STANDARD")
    ident, year = F.col("p_partkey").alias("id"), F.col("p_size").alias("year")
    wanted = part.filter(wanted_type).select(ident, F.col("p_name").alias("name"), F.array(turned).alias("aliases"), year)
    name = F.when(F.col("p_type") == "LARGE", turned).otherwise(F.col("p_name"))
    return part.filter(~wanted_type).select(ident, name.alias("name"), year), wanted


CHAIN_SQL = """edges AS (SELECT o_orderkey AS id, o_orderkey - 1 AS edit_of FROM orders WHERE o_orderpriority <> '1-URGENT'),
walk AS (
  WITH RECURSIVE w(id, cur, hops) AS (
    SELECT o_orderkey, o_orderkey, 0 FROM orders
    UNION ALL SELECT w.id, e.edit_of, w.hops + 1 FROM w JOIN edges e ON e.id = w.cur WHERE w.hops < 8)
  SELECT * FROM w)"""


def _chain(spark, sf):
    o = table(spark, sf, "orders")
    edit_of = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderkey") - 1)
    return o.select(F.col("o_orderkey").alias("id"), edit_of.alias("edit_of"), "o_orderstatus", "o_custkey")


@query("chain_root", f"WITH {CHAIN_SQL} SELECT id, arg_max(cur, hops) AS root FROM walk GROUP BY id")
def chain_root(spark, sf):
    return link.chain_root(_chain(spark, sf)).select("id", "root")


@query("seen_via_chain", f"""WITH {CHAIN_SQL}
SELECT DISTINCT 1 AS q, w.id FROM walk w JOIN orders o ON o.o_orderkey = w.cur AND o.o_orderstatus = 'P' WHERE w.hops < 8""")
def seen_via_chain(spark, sf):
    rows = _chain(spark, sf)
    matches = rows.select(F.lit(1).alias("q"), "id")
    seen = rows.filter("o_orderstatus = 'P'").select(F.lit(1).alias("q"), "id")
    return link.seen_via_chain(matches, rows.filter("edit_of is not null").select("id", "edit_of"), seen)


@query("dedupe_last", """SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey, l_suppkey, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC) = 1""")
def dedupe_last(spark, sf):
    pos = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), pos.alias("pos"))
    return keep_last(rows, "id", "pos").select("id", "pos.l_partkey", "pos.l_suppkey", "pos.l_extendedprice")


@query("dup_ids", """SELECT count(*) AS rows, count(DISTINCT l_orderkey * 10 + l_linenumber) AS ids,
count(*) - count(DISTINCT l_orderkey * 10 + l_linenumber) AS dup_ids FROM lineitem""")
def dup_ids(spark, sf):
    return guards.dup_ids(table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")))


def _part_no(col="o_orderpriority"):
    return F.substring(col, 1, 1).cast("int").alias("part")


@query("union_parts", """SELECT 1 AS part, p_partkey AS id, p_name AS name FROM part UNION ALL SELECT 2, s_suppkey, s_name FROM supplier
UNION ALL SELECT 3, c_custkey, c_name FROM customer""")
def union_parts_query(spark, sf):
    cols = {"part": ("p_partkey", "p_name"), "supplier": ("s_suppkey", "s_name"), "customer": ("c_custkey", "c_name")}
    return union_parts([table(spark, sf, t).select(F.col(k).alias("id"), F.col(n).alias("name")) for t, (k, n) in cols.items()])


@query("assign_parts", """WITH p AS (SELECT l_orderkey AS id, max(l_linenumber) AS part FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, coalesce(p.part, CAST(substr(o_orderpriority, 1, 1) AS INT)) AS part FROM orders LEFT JOIN p ON p.id = o_orderkey""")
def assign_parts(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), _part_no())
    parts = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("part"))
    return merge.assign_parts(rows, parts)


@query("part_guards", """WITH c AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS INT) AS part, count(*) FILTER (o_orderstatus <> 'P') AS n, count(*) AS prev FROM orders GROUP BY 1),
p AS (
  SELECT 1 AS rule, 'part_too_small' AS problem, part, n AS found, prev AS expected FROM c WHERE part < (SELECT max(part) FROM c) AND n < 50
  UNION ALL SELECT 2, 'total_too_small', NULL, sum(n), count(prev) FROM c HAVING sum(n) < 1000
  UNION ALL SELECT 4, 'part_shrank', part, n, prev FROM c WHERE n < prev - greatest(5, prev * 0.02))
SELECT rule, problem, part, CAST(found AS BIGINT) AS found, CAST(expected AS BIGINT) AS expected FROM p ORDER BY rule, part LIMIT 1""")
def part_guards(spark, sf):
    o = table(spark, sf, "orders").select(_part_no(), "o_orderstatus")
    return guards.part_guards(guards.part_counts(o.filter("o_orderstatus <> 'P'")), guards.part_counts(o))


@query("run_meta", f"""WITH {MERGED_SQL}
SELECT count(*) FILTER (NOT is_removed) AS total, count(*) FILTER (is_removed) AS removed_total, DATE '{TODAY}' AS updated, DATE '{TODAY}' AS checked,
       TIMESTAMP '2001-08-01 06:00:00' AS checked_at, DATE '{TODAY}' AS last_added, count(*) FILTER (status = 'new') AS last_added_count FROM merged""")
def run_meta_query(spark, sf):
    # the row of the run before, as the base itself tells it
    previous = base_list(spark, sf).agg(
        F.max("removed").alias("updated"), F.max("added").alias("last_added"), F.lit(0).cast("bigint").alias("last_added_count"))
    return run_meta(merged(spark, sf), previous, day(TODAY), F.lit("2001-08-01 06:00:00").cast("timestamp_ntz"))


@query("dict_encode", """WITH f AS (SELECT p_type || '/' || p_brand AS word, min(p_partkey) AS first FROM part GROUP BY 1),
d AS (SELECT word, row_number() OVER (ORDER BY first) - 1 AS code FROM f)
SELECT p_partkey, word, code FROM part JOIN d ON d.word = p_type || '/' || p_brand""")
def dict_encode_query(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.concat_ws("/", "p_type", "p_brand").alias("word"))
    return dict_encode(rows, "word", "p_partkey", "code")[0]


@query("chunk_rows", """SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos,
(row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 200 AS chunk FROM orders""")
def chunk_rows_query(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate")
    return chunk_rows(rows, [F.col("o_orderdate"), F.col("id")]).select("id", "pos", "chunk")


CHUNKED_SQL = """chunked AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders)"""


@query("chunk_files", f"WITH {CHUNKED_SQL} SELECT id, pos, pos // 200 AS chunk FROM chunked WHERE pos // 200 IN (SELECT user_id * 7 FROM events)")
def chunk_files(spark, sf):
    """Orders written in chunks of 200 in publication order; the chunks that events ask for are read by number."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate")
    path = work_dir(spark, "chunks")
    write_chunks(rows, [F.col("o_orderdate"), F.col("id")], path, chunks=16)
    asked = table(spark, sf, "events").select((F.col("user_id") * 7).alias("chunk"))
    return read_chunks(asked, path, chunks=16).select("id", "pos", "chunk")


@query("merge_incremental", f"WITH {MERGED_SQL} SELECT {', '.join(MERGED_COLS)} FROM merged")
def merge_incremental_query(spark, sf):
    """The rows of ``snapshot_merge`` from a list in buckets: what the merge published, and the status of what it changed."""
    base = base_list(spark, sf)
    kept = BucketedList(spark, work_dir(spark, "bucketed"), base.schema, buckets=16)
    kept.publish(base)
    changed, _ = merge_incremental(kept, snapshot(spark, sf), day(TODAY), COMPARED, initial=False)
    status = changed.select("id", "status")
    return kept.read().join(status, "id", "left").withColumn("status", F.coalesce("status", F.lit("kept"))).select(*MERGED_COLS)


@query("publish_versioned", f"WITH {MERGED_SQL} SELECT {', '.join(MERGED_COLS)} FROM merged")
def publish_versioned_query(spark, sf):
    """Publish the base, then the merge as the next version, and read back what is current."""
    root = work_dir(spark, "published")
    publish_versioned(base_list(spark, sf), root)
    rows = merged(spark, sf).select(*MERGED_COLS)
    publish_versioned(rows, root, lambda written: merge.merge_guards(merge.merge_counts(written), force=True))
    return read_current(spark, root, rows.schema)
