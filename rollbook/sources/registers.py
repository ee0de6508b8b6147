"""The five register lists: their schemas, the search corpus over them and the columns each product may show."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.text import normalize_compact
from ..operators import link
from ..operators.position import dense_position
from .lists import tagged_union
from .publish import haystack

HISTORY = "ord long, added date, is_removed boolean, removed date, edited date, edit_of string, replaced_by string"
SCHEMAS = {
    "m": f"id string, type string, name string, court string, date date, {HISTORY}",
    "f": "id string, kind string, name string, alias string, links string, address string, basis string, decided_by string, date date,"
         f" included date, info string, logo string, {HISTORY}",
    "p": "id string, num long, name string, translit string, citizenship string, birth string, basis string, court string, articles array<string>,"
         f" included string, date date, address string, info string, part int, {HISTORY}",
    "w": "id string, name string, aliases array<string>, year int, nationality string, region string, agency string, date date, before string,"
         f" first string, category string, rf string, {HISTORY}",
    "t": "id string, num long, name string, translit string, aka string, citizenship string, birth string, address string, basis string,"
         f" articles array<string>, info string, since date, {HISTORY}",
}
OPTIONAL = {"f", "p", "w", "t"}
# Columns each product may show, per list. A column that is not named here never leaves the base.
DETAIL_COLUMNS = {
    "m": ["id", "type", "name", "court", "ord"],
    "f": ["id", "list", "kind", "name", "alias", "links", "address", "basis", "decided_by", "date", "included", "info", "logo"],
    "p": ["id", "list", "num", "name", "translit", "citizenship", "birth", "basis", "articles", "included", "date", "address", "part", "marked_by", "links_n"],
    "w": ["id", "list", "name", "aliases", "year", "nationality", "region", "agency", "date", "before", "first", "category", "rf", "links_n"],
    "t": ["id", "list", "num", "name", "translit", "aka", "citizenship", "birth", "basis", "articles", "status", "address", "info", "since", "merged_into", "links_n"],
}
FEED_COLUMNS = {
    "m": ["id", "name", "court"], "f": ["id", "name", "alias", "links", "basis"], "p": ["id", "name", "translit", "basis", "included"],
    "w": ["id", "name", "agency", "region", "date", "before"], "t": ["id", "name", "translit", "basis", "since", "merged_into"],
}
DIGEST_COLUMNS = {
    "m": ["id", "name", "court", "date"], "f": ["id", "name", "decided_by", "kind", "date"], "p": ["id", "name", "articles", "court", "date"],
    "w": ["id", "name", "agency", "region", "date"], "t": ["id", "name", "status", "articles", "since", "merged_into"],
}


def all_records(lists: Mapping[str, DataFrame]) -> DataFrame:
    """The lists in one table; ``m, f, p, w, t`` is their order of publication."""
    spark = lists["m"].sparkSession
    return tagged_union({k: lists[k] if k in lists else spark.createDataFrame([], SCHEMAS[k]) for k in SCHEMAS})


def fold_pairs(db: DataFrame) -> DataFrame:
    """Live 't' records that are live 'p' records: ``id, merged_into``."""
    alive = db.filter(~F.coalesce("is_removed", F.lit(False)) & F.col("replaced_by").isNull())
    cols = ["id", normalize_compact(F.coalesce("name", F.lit(""))).alias("name"), "birth", "ord"]
    return link.fold_lists(alive.filter("list = 'p'").select(*cols), alive.filter("list = 't'").select(*cols))


def links(db: DataFrame, folded: DataFrame) -> DataFrame:
    """Cross-links of persons (stand-alone 't' included) and wanted records by name or alias and year."""
    alive = db.filter(~F.coalesce("is_removed", F.lit(False)) & F.col("replaced_by").isNull())
    name = lambda c: normalize_compact(F.coalesce(c, F.lit("")))
    persons = alive.filter(F.col("list").isin("p", "t") & F.col("birth").rlike("\\d{4}$")).join(folded.select("id"), "id", "left_anti")
    persons = persons.select("id", name(F.col("name")).alias("name"), F.substring("birth", -4, 4).alias("year"))
    aliases = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), name)
    wanted = alive.filter("list = 'w'").select("id", name(F.col("name")).alias("name"), aliases.alias("aliases"), F.col("year").cast("string").alias("year"))
    return link.cross_links(persons, wanted)


def build_corpus(lists: Mapping[str, DataFrame], folded_label: str = "", mark: str = "") -> DataFrame:
    """The search corpus: one row per record with its position, search text, series and links.

    ``folded_label`` and ``mark`` are words that the search text of records of the folded list, and of those that have one, gets.

    ``list`` 't' is shown as part of 'p'; ``merged_into`` hides a folded record, ``marked`` tells who has one.
    """
    db = all_records(lists)
    folded = fold_pairs(db)
    marks = folded.select(F.col("merged_into").alias("id"), F.col("id").alias("marked_by"))
    linked = links(db, folded).select("id", F.col("links").alias("links_n"))
    rows = db.join(folded, "id", "left").join(marks, "id", "left").join(linked, "id", "left")
    rows = dense_position(rows, [F.col("list_rank"), F.col("ord"), F.col("id")])
    cols = {c: F.col(c) for c in ("articles", "agency", "kind", "type", "region", "court", "decided_by")}
    cols["marked"] = F.col("marked_by").isNotNull()
    kind = F.col("list")
    none = F.array().cast("array<string>")
    names = (
        F.when(kind == "t", F.array("name", "translit", "aka", "birth"))
        .when(kind == "w", F.concat(F.array("name"), F.coalesce("aliases", none), F.array(F.col("year").cast("string"))))
        .when(kind == "p", F.array("name", "translit", "birth"))
        .when(kind == "f", F.array("name", "alias", "links", "address", "basis")).otherwise(F.array("name"))
    )
    shown_day = F.when(kind == "t", F.col("since")).otherwise(F.col("date"))
    return rows.select(
        F.when(kind == "t", "p").otherwise(kind).alias("list"), "id", "pos", "name", shown_day.alias("date"), "added",
        F.col("is_removed"), "removed", "edit_of", "replaced_by", "merged_into",
        (cols["marked"] | (kind == "t")).alias("marked"), F.coalesce("links_n", F.lit(0)).alias("links_n"),
        labels.record_series(kind, cols).alias("series"),
        haystack(names, labels.record_label(kind, cols, folded_label, mark), labels.record_place(kind, cols), shown_day).alias("h"),
    )


def details(lists: Mapping[str, DataFrame]) -> DataFrame:
    """All columns the detail product may need, folded and linked; project with ``DETAIL_COLUMNS`` before publishing."""
    db = all_records(lists)
    folded = fold_pairs(db)
    marks = folded.select(F.col("merged_into").alias("id"), F.col("id").alias("marked_by"))
    linked = links(db, folded).select("id", F.col("links").alias("links_n"))
    return db.join(folded, "id", "left").join(marks, "id", "left").join(linked, "id", "left").withColumn("status", labels.case_status(F.col("basis")))


def public_meta(metas: DataFrame) -> DataFrame:
    """Source rows without their internal addresses; only https part files stay."""
    files = F.filter(F.coalesce("source_files", F.array().cast("array<string>")), lambda u: u.rlike("^https://"))
    return metas.withColumn("files", F.when(F.size(files) > 0, files)).drop("source_page", "source_file", "source_files")
