"""What changed: recent rows, feed, once-only digest and message packing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cut_title
from ..session import staged
from .link import chain_paths
from .position import dense_position
from .search import count_by_list, is_recent

# --- Fixed values ---
FEED_SIZE = 100
FALLBACK_SIZE = 60
WINDOW_DAYS = 7
KEEP_DAYS = 60
MESSAGE_LIMIT = 3900
SEPARATOR = 2          # characters between two blocks of a message
TITLE_MAX = 220
# --------------------


def recent_rows(rows: DataFrame, as_of: Column, col: str = "added") -> DataFrame:
    """Current versions that appeared (or went) in the last 30 days."""
    return rows.filter(F.col("replaced_by").isNull() & is_recent(col, as_of))


def new_counts(rows: DataFrame, as_of: Column, lists: Sequence[str]) -> DataFrame:
    """Added and removed rows of the window, per list and in total."""
    out = None
    for what in ("added", "removed"):
        counts = count_by_list(recent_rows(rows, as_of, what), lists).withColumn("what", F.lit(what))
        out = counts if out is None else out.unionByName(counts)
    return out


def grouped_new(rows: DataFrame, as_of: Column) -> DataFrame:
    """Recent rows by day, newest day first, later positions first inside a day; the order is a column."""
    recent = recent_rows(rows, as_of)
    return dense_position(recent, [F.desc("added"), F.desc("pos")], name="rank")


def feed_rows(rows: DataFrame, size: int = FEED_SIZE, default_list: str = "m") -> DataFrame:
    """The newest live rows with a history; while no row has one, the newest of the default list by date."""
    any_history = rows.agg(F.coalesce(F.bool_or(F.col("added").isNotNull() & F.col("removed").isNull()), F.lit(False))).scalar()
    dated = F.col("added").isNotNull() & F.col("removed").isNull()
    chosen = rows.filter((any_history & dated) | (~any_history & (F.col("list") == default_list)))
    key = F.when(any_history, F.col("added")).otherwise(F.col("date"))
    return chosen.withColumn("feed_day", key).orderBy(F.desc_nulls_last("feed_day"), F.asc("pos")).limit(size)


def feed_links(feed: DataFrame, edges: DataFrame) -> DataFrame:
    """Feed rows with ``root``, the first version of the record, and ``target``, the record it was folded into or itself.

    ``edges`` holds ``id, edit_of`` of edited records.
    """
    roots = chain_paths(edges).select("id", "root")
    rows = feed.join(roots, "id", "left")
    return rows.withColumns({"root": F.coalesce("root", "id"), "target": F.coalesce("merged_into", "id")})


def new_fallback(rows: DataFrame, size: int = FALLBACK_SIZE) -> DataFrame:
    """While no row has a history: the newest visible rows by date; otherwise nothing."""
    any_history = rows.agg(F.coalesce(F.bool_or(F.col("added").isNotNull()), F.lit(False))).scalar()
    shown = rows.filter(F.col("replaced_by").isNull() & F.col("merged_into").isNull())
    return shown.filter(~any_history).orderBy(F.desc_nulls_last("date"), F.desc("pos")).limit(size)


def list_rank(lists: Sequence[str], col: str = "list") -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in lists]), F.col(col)) - 1


def around_nulls(rows: DataFrame, key: str, other: DataFrame, how: str) -> DataFrame:
    """A semi or anti join in which rows without a key, which never match, go around the shuffle instead of meeting in one task."""
    met = rows.filter(F.col(key).isNotNull()).join(other.select(key), key, how).select(*rows.columns)
    return met.unionByName(rows.filter(F.col(key).isNull())) if how == "left_anti" else met


def select_fresh(rows: DataFrame, sent: DataFrame, since: Column) -> DataFrame:
    """Rows added since a day, not sent yet, and whose predecessor was not sent either."""
    fresh = rows.filter(F.col("added") >= since)
    fresh = fresh.join(sent.select("id"), "id", "left_anti")
    return around_nulls(fresh.select(*rows.columns), "edit_of", sent.select(F.col("id").alias("edit_of")), "left_anti")


def mark_sent(sent: DataFrame, delivered: DataFrame, today: Column, keep_days: int = KEEP_DAYS) -> DataFrame:
    """Marks of the delivered rows and their predecessors; old marks expire."""
    ids = delivered.select(F.explode(F.array("id", "edit_of")).alias("id")).filter("id is not null")
    marks = sent.select("id", "sent_on").unionByName(ids.select("id", today.cast("date").alias("sent_on")))
    return marks.groupBy("id").agg(F.max("sent_on").alias("sent_on")).filter(F.col("sent_on") >= F.date_sub(today, keep_days))


def digest_header(fresh: DataFrame, lists: Sequence[str]) -> DataFrame:
    """New rows per list and in total, with the last day any of them appeared."""
    per_list = fresh.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("added").alias("last_added"))
    total = per_list.agg(F.lit("all").alias("list"), F.sum("n").alias("n"), F.max("last_added").alias("last_added"))
    return per_list.unionByName(total)


def digest_rollup(fresh: DataFrame) -> DataFrame:
    """New rows per list and day, per list and in total, with the last day; ``level`` tells the totals (0: list and day, 1: list, 3: all)."""
    return fresh.rollup("list", "added").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), F.max("added").alias("last_added"))


def digest_rows(fresh: DataFrame, lists: Sequence[str]) -> DataFrame:
    """Running number over the digest, list by list; the first row of each list carries a heading if lists mix.

    Rows of no known list go with the first one.
    """
    rank = F.greatest(F.coalesce(list_rank(lists), F.lit(0)), F.lit(0))
    placed = dense_position(fresh.withColumn("rank", rank), [F.asc("added"), F.asc("ord"), F.asc("id")], by=["rank"], name="in_list")
    sizes = fresh.groupBy(rank.alias("rank")).agg(F.count(F.lit(1)).alias("n_list"))
    earlier = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)  # one row per list
    starts = sizes.withColumn("start", F.coalesce(F.sum("n_list").over(earlier), F.lit(0)))
    starts = starts.withColumn("mixed", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) > 1)
    rows = placed.join(F.broadcast(starts), "rank")
    return rows.select(
        *fresh.columns, (F.col("start") + F.col("in_list") + 1).alias("number"),
        (F.col("mixed") & (F.col("in_list") == 0)).alias("heads_list"), "n_list",
    )


def digest_block(number: Column, name: Column) -> Column:
    """One numbered line of a digest."""
    return F.concat(number.cast("string"), F.lit(". "), cut_title(name, TITLE_MAX))


def digest_pack(blocks: DataFrame, header_len: int, next_header_len: int, limit: int = MESSAGE_LIMIT, chunk: int = 65_536) -> DataFrame:
    """Number the message each block goes into: greedy, in order, a new message when a block would not fit.

    ``blocks`` has ``digest, pos, size`` with 0-based positions. A digest may be of any length: it is cut into
    chunks, and each chunk works out, for every block a message could begin with at its start, where the first
    message of the next chunk would begin. Following those exits (by doubling) gives the true entry of each chunk,
    from which the chunk numbers its messages. A block over the limit still gets a message of its own.
    """
    ahead = limit // SEPARATOR + 2  # no message can hold more blocks
    if ahead >= chunk:
        raise ValueError("chunk must be longer than the longest message")
    home = F.floor(F.col("pos") / chunk)
    own = blocks.select("digest", "pos", "size", home.alias("chunk"))
    early = blocks.filter((F.col("pos") % chunk < ahead) & (F.col("pos") >= chunk))
    rows = staged(own.unionByName(early.select("digest", "pos", "size", (home - 1).alias("chunk"))), "chunks")
    digest_type = dict(blocks.dtypes)["digest"]

    def next_starts(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Positions and, for a message that begins there, the index of the block after it."""
        rows = rows.sort_values("pos")
        pos, widths = rows["pos"].to_numpy(), rows["size"].to_numpy() + SEPARATOR
        ends = np.cumsum(widths)
        room = np.where(pos == 0, limit - header_len, limit - next_header_len)
        after = np.searchsorted(ends, ends - widths + room, side="right")
        return pos, np.maximum(after, np.arange(len(pos)) + 1)

    def exits(key, rows: pd.DataFrame) -> pd.DataFrame:
        pos, after = next_starts(rows)
        inside = int((pos // chunk == key[1]).sum())
        out = after.copy()
        while (again := out < inside).any():  # each step doubles how many messages are passed over
            out[again] = out[out[again]]
        doors = 1 if key[1] == 0 else min(ahead, inside)
        return pd.DataFrame({"digest": rows["digest"].iloc[0], "pos": pos[:doors], "next": pos[0] + out[:doors]})

    jump = staged(rows.groupBy("digest", "chunk").applyInPandas(exits, f"digest {digest_type}, pos long, next long"), "exits")
    doors = jump.select("digest", "pos")
    entries = jump.filter("pos = 0").select("digest", "pos")
    hops = rows.agg(F.max("chunk")).first()[0] or 0  # an exit leads to a later chunk, so a digest has no more hops
    for i in range(int(hops).bit_length()):
        reached = entries.join(jump, ["digest", "pos"]).select("digest", F.col("next").alias("pos")).join(doors, ["digest", "pos"], "left_semi")
        entries = staged(entries.unionByName(reached).distinct(), "entries")
        if hops >> (i + 1):
            far = jump.select("digest", F.col("pos").alias("next"), F.col("next").alias("far"))
            jump = staged(jump.join(far, ["digest", "next"]).select("digest", "pos", F.col("far").alias("next")), "exits")

    def number(key, rows: pd.DataFrame) -> pd.DataFrame:
        pos, after = next_starts(rows)
        inside = int((pos // chunk == key[1]).sum())
        entry = rows["entry"].iloc[0]
        local = np.full(inside, -1, dtype=np.int64)  # -1: still in the last message of the chunk before
        i, n = (inside if pd.isna(entry) else int(entry - pos[0])), 0
        while i < inside:
            local[i : after[i]] = n
            i, n = after[i], n + 1
        return pd.DataFrame({"digest": rows["digest"].iloc[0], "chunk": key[1], "pos": pos[:inside], "local": local})

    entry = entries.select("digest", F.col("pos").alias("entry"), F.floor(F.col("pos") / chunk).alias("chunk"))
    numbered = rows.join(entry, ["digest", "chunk"], "left").groupBy("digest", "chunk").applyInPandas(
        number, f"digest {digest_type}, chunk long, pos long, local long")
    numbered = staged(numbered, "numbered")
    begun = numbered.groupBy("digest", "chunk").agg((F.max("local") + 1).alias("n"))
    earlier = Window.partitionBy("digest").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row per chunk
    begun = begun.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    messages = numbered.join(begun, ["digest", "chunk"]).select("digest", "pos", (F.col("before") + F.col("local")).alias("message"))
    return blocks.join(messages, ["digest", "pos"])


def distinct_total(rows: DataFrame) -> DataFrame:
    """Live rows of all lists, counting a folded record once."""
    alive = F.col("removed").isNull()
    return rows.agg(
        F.count_if(alive).alias("live"), F.count_if(F.col("merged_into").isNotNull()).alias("folded"),
        (F.count_if(alive) - F.count_if(F.col("merged_into").isNotNull())).alias("total"),
    )


def lists_present(rows: DataFrame) -> DataFrame:
    """Which lists a result touches; folded marks count as their own list 't'."""
    present = F.when(F.col("series") == "terror", F.lit("t")).otherwise(F.coalesce("list", F.lit("m")))
    names = F.array_distinct(F.array_compact(F.array(present, F.when(F.col("marked"), F.lit("t")))))
    return rows.select(F.explode(names).alias("list")).distinct()


def latest_per_list(rows: DataFrame, sizes: dict[str, int], order: Sequence[Column]) -> DataFrame:
    """The newest few live rows of each list."""
    want = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    rank = F.row_number().over(Window.partitionBy("list").orderBy(*order))
    ranked = rows.filter("removed is null").withColumn("rank", rank).filter(F.col("rank") <= max(sizes.values()))
    return ranked.filter(F.col("rank") <= F.coalesce(F.try_element_at(want, F.col("list")), F.lit(0)))


def top_years(years: DataFrame, size: int = 6) -> DataFrame:
    return years.orderBy(F.desc("year")).limit(size)
