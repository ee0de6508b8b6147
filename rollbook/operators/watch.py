"""Watchlists: standing queries that report only matches their owner has not seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .link import seen_via_chain
from .search import match_queries, parse_queries, spell_tokens, visible

ENTRY_SCHEMA = "q string, seen array<string>, at date"


def watch_sanitize(raw: DataFrame) -> DataFrame:
    """Stored JSON entries to clean ones: no text query, no entry; a broken list of seen ids becomes empty."""
    entry = F.try_parse_json("raw")
    part = lambda name: F.try_variant_get(entry, f"$.{name}", "variant")
    type_of = lambda name: F.schema_of_variant(part(name))
    ids = F.try_variant_get(entry, "$.seen", "array<string>")
    clean = F.when(type_of("seen").isin("ARRAY<STRING>", "ARRAY<VOID>"), ids).otherwise(F.array().cast("array<string>"))
    return raw.filter(type_of("q") == "STRING").select(
        *[c for c in raw.columns if c != "raw"], F.try_variant_get(entry, "$.q", "string").alias("q"),
        clean.alias("seen"), F.try_to_date(F.try_variant_get(entry, "$.at", "string"), "yyyy-MM-dd").alias("at"),
    )


def watch_matches(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """Exact and spelling-variant matches per query, folded records included; an empty query matches nothing.

    The matches are a stage: what is made of them reads it, and the corpus is scanned once.
    """
    variants = spell_tokens(parse_queries(queries))
    return staged(match_queries(corpus.filter(visible(merged=True)), variants), "matches")


def watch_fresh(matches: DataFrame, seen: DataFrame, edges: DataFrame) -> DataFrame:
    """Matches not seen yet, neither themselves nor through an earlier version."""
    known = seen_via_chain(matches.select("q", "id"), edges, seen)
    return matches.join(known, ["q", "id"], "left_anti")


def watch_status(matches: DataFrame, fresh: DataFrame, entries: DataFrame, owner: str = "owner") -> DataFrame:
    """Matches, unseen matches and the tone of the panel per owner."""
    m = matches.groupBy("q").agg(F.count(F.lit(1)).alias("m"))
    f = fresh.groupBy("q").agg(F.count(F.lit(1)).alias("f"))
    per = entries.join(m, "q", "left").join(f, "q", "left").groupBy(owner).agg(
        F.count("q").alias("entries"), F.coalesce(F.sum("m"), F.lit(0)).alias("matches"), F.coalesce(F.sum("f"), F.lit(0)).alias("fresh")
    )
    tone = F.when(F.col("entries") == 0, "idle").when(F.col("fresh") > 0, "alert").when(F.col("matches") > 0, "warn").otherwise("ok")
    return per.withColumn("tone", tone)


def add_queries(seen: DataFrame, entries: DataFrame, asked: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New queries enter once; what they match now counts as seen. Known queries stay as they are."""
    new = asked.dropDuplicates(["q"]).join(entries.select("q"), "q", "left_anti")
    now_seen = matches.select("q", "id").join(new.select("q"), "q", "left_semi")
    return entries.unionByName(new.select(*entries.columns)), seen.unionByName(now_seen)


def mark_seen(seen: DataFrame, touched: DataFrame, entries: DataFrame) -> DataFrame:
    """The seen ids of every touched, known query are replaced by the given ones."""
    mine = touched.join(entries.select("q"), "q", "left_semi").select("q", "id").distinct()
    return seen.join(mine.select("q").distinct(), "q", "left_anti").unionByName(mine)
