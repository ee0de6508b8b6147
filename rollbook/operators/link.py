"""Linking records across lists and along edit chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import unsent

MAX_HOPS = 8  # reached by three doublings


def fold_lists(primary: DataFrame, folded: DataFrame) -> DataFrame:
    """Which record of ``folded`` is the same as which record of ``primary``.

    Both have ``id, name, birth, ord`` (name already normalised, birth ``dd.mm.yyyy`` text). The first primary
    record with an equal birth is best, else the first with two of three date parts equal. A primary record is
    claimed once, by the first claimant; a claimant whose best is taken stays alone. Both sides are reduced to
    one row per key before they meet, so a name shared by many records never multiplies.
    """
    d, m, y = (F.split_part("birth", F.lit("."), F.lit(i)).alias(n) for i, n in ((1, "d"), (2, "m"), (3, "y")))
    whole = F.col("birth").rlike("^\\d{2}\\.\\d{2}\\.\\d{4}$")
    known = (F.coalesce(F.col("birth"), F.lit("")) != "") & (F.coalesce(F.col("name"), F.lit("")) != "")
    first = F.min(F.struct("ord", "id"))
    claims = folded.filter(known).groupBy("name", "birth").agg(first.alias("claimant"))
    owners = primary.filter(known).groupBy("name", "birth").agg(first.alias("owner"))

    exact = owners.withColumnRenamed("owner", "exact")
    best = claims.join(exact, ["name", "birth"], "left").select("name", "birth", "claimant", "exact", d, m, y)
    near = []
    parts = owners.filter(whole).select("name", "owner", d, m, y)
    for pair in (("d", "m"), ("d", "y"), ("m", "y")):
        tag = f"near_{''.join(pair)}"
        best = best.join(parts.groupBy("name", *pair).agg(F.min("owner").alias(tag)), ["name", *pair], "left")
        near.append(F.when(whole, F.col(tag)))
    chosen = F.coalesce("exact", F.array_min(F.array(*near)))
    return (
        best.select("claimant", chosen.alias("owner")).filter("owner is not null")
        .groupBy("owner").agg(F.min("claimant").alias("claimant"))
        .select(F.col("claimant.id").alias("id"), F.col("owner.id").alias("merged_into"))
    )


def link_groups(persons: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records of two lists that share a name (or alias) and a year, as a factored graph.

    ``persons`` has ``id, name, year``; ``wanted`` also ``aliases``. Returns the membership of each side
    (``id, name, year``) and the groups both sides belong to with their sizes. A record is linked to every
    record of the other side in its groups; the pairs themselves are never written out, since one shared name
    would square them.
    """
    keyed = F.coalesce(F.col("name"), F.lit("")) != ""
    p = persons.filter(keyed).select("id", "name", "year").distinct()
    names = F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    w = wanted.select("id", F.explode(names).alias("name"), "year").filter(keyed)
    pg = p.groupBy("name", "year").agg(F.count(F.lit(1)).alias("persons"), F.min("id").alias("first_person"))
    wg = w.groupBy("name", "year").agg(F.count(F.lit(1)).alias("wanted"), F.min("id").alias("first_wanted"))
    return p, w, pg.join(wg, ["name", "year"])


def cross_links(persons: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per linked record: how many records of the other list it is linked to, and the first of them."""
    p, w, groups = link_groups(persons, wanted)
    from_p = p.join(groups, ["name", "year"]).select(
        F.lit("p").alias("list"), "id", F.col("wanted").alias("links"), F.col("first_wanted").alias("first_link")
    )
    from_w = (
        w.join(groups, ["name", "year"]).groupBy("id")
        .agg(F.sum("persons").alias("links"), F.min("first_person").alias("first_link"))
        .select(F.lit("w").alias("list"), "id", "links", "first_link")
    )
    return from_p.unionByName(from_w)


def links_of(requested: DataFrame, persons: DataFrame, wanted: DataFrame) -> DataFrame:
    """All linked ids of the requested person ids (record pages), made from the membership tables; each pair once.

    A pair that shares several keys is given out by the smallest one, which both records' own keys tell, so pairs leave the join as they are
    made: they may be as many as the square of a group, and are neither shuffled nor held.
    """
    p, w, _ = link_groups(persons, wanted)
    key = F.struct("name", "year")

    def keyed(rows: DataFrame, own: str) -> DataFrame:
        rows = rows.filter("year IS NOT NULL").select("id", "name", "year").distinct()
        return rows.groupBy("id").agg(F.collect_list(key).alias(own)).select("id", own, F.inline(own))

    asked = keyed(p.join(unsent(requested.select("id").distinct()), "id", "left_semi"), "_p").withColumnRenamed("id", "person_id")
    both = keyed(w, "_w").join(unsent(asked), ["name", "year"])
    once = (F.size("_p") == 1) | (F.size("_w") == 1) | (F.array_min(F.array_intersect("_p", "_w")) == key)
    return both.filter(once).select("person_id", F.col("id").alias("wanted_id"))


def chain_paths(edges: DataFrame) -> DataFrame:
    """For each edited record the chain ``id`` and up to seven predecessors, newest first, plus the root.

    ``edges`` holds ``id, edit_of`` of edited records only. Three self-joins double the reach 1 → 2 → 4 → 8;
    a cycle simply keeps going round until the bound. ``root`` is eight hops away at most.
    """
    step = edges.select("id", F.array("id").alias("path"), F.col("edit_of").alias("far"))
    for _ in range(3):
        ahead = step.select(F.col("id").alias("far"), F.col("path").alias("more"), F.col("far").alias("farther"))
        step = step.join(ahead, "far", "left").select(
            "id",
            F.concat("path", F.coalesce("more", F.array(F.col("far")))).alias("path"),
            F.coalesce("farther", "far").alias("far"),
        )
    return step.select("id", F.slice("path", 1, MAX_HOPS).alias("path"), F.col("far").alias("root"))


def chain_root(rows: DataFrame) -> DataFrame:
    """Add ``root``: the first version of a record, at most eight edits back; unedited records are their own."""
    edges = rows.filter("edit_of is not null").select("id", "edit_of")
    roots = chain_paths(edges).select("id", "root")
    return rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def seen_via_chain(matches: DataFrame, edges: DataFrame, seen: DataFrame) -> DataFrame:
    """Matches ``(q, id)`` that were seen themselves or through one of their seven predecessors."""
    paths = chain_paths(edges).select("id", "path")
    walked = matches.join(paths, "id", "left").select("q", "id", F.explode(F.coalesce("path", F.array("id"))).alias("step"))
    hit = walked.join(seen.select("q", F.col("id").alias("step")).distinct(), ["q", "step"], "left_semi")
    return hit.select("q", "id").distinct()


def link_target(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Where a link to a record leads: the record it was folded into, or itself."""
    return rows.join(pairs, "id", "left").withColumn("target", F.coalesce("merged_into", "id"))
