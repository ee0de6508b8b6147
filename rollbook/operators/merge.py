"""Merging a snapshot into a base list with history."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_compact, same_or_cut, similar_names
from ..session import staged, unsent
from .nearnames import near_name_pairs
from .position import keep_last
from .settle import settle_edges

HISTORY = ["ord", "added", "is_removed", "removed", "edited", "edit_of", "replaced_by"]

Rule = Callable[[str, str], Column]


def compare_snapshot(base: DataFrame, snap: DataFrame, compare: Sequence[str] | None = None, primary: bool = True) -> DataFrame:
    """Full outer join of base and snapshot by id, with one flag per thing that can happen to a record.

    ``base`` has ``id``, the payload columns and ``HISTORY``; ``snap`` has ``id``, the payload and ``src_pos``.
    NULL and missing are the same, an empty text is not. Without ``compare`` no field is compared or updated.
    """
    payload = _payload(snap)
    latest = keep_last(snap, "id", "src_pos")
    b, s = base.alias("b"), latest.alias("s")
    differs = F.lit(False)
    for c in compare or []:
        differs = differs | ~F.col(f"b.{c}").eqNullSafe(F.col(f"s.{c}"))
    known, listed = F.col("b.id").isNotNull(), F.col("s.id").isNotNull()
    gone_before = F.coalesce(F.col("b.is_removed"), F.lit(False))
    flags = [
        (~known).alias("is_new"),
        (known & listed & differs).alias("is_edited"),
        (known & listed & gone_before & F.lit(primary)).alias("is_returned"),
        (known & ~listed & ~gone_before & F.lit(primary)).alias("is_gone"),
    ]
    joined = b.join(s, F.col("b.id") == F.col("s.id"), "full_outer").select(
        F.coalesce("b.id", "s.id").alias("id"),
        *[F.when(~known | (listed & differs), F.col(f"s.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in payload],
        F.coalesce("s.src_pos", "b.ord").alias("ord"),
        F.col("b.ord").alias("base_ord"),
        F.col("b.added").alias("added"),
        gone_before.alias("is_removed"),
        *[F.col(f"b.{c}").alias(c) for c in _carried(base)],
        *flags,
    )
    return joined


def _payload(snap: DataFrame) -> list[str]:
    return [c for c in snap.columns if c not in ("id", "src_pos", "since")]


def _carried(base: DataFrame) -> list[str]:
    return ["removed", "edited", "edit_of", "replaced_by"] + [c for c in ("since",) if c in base.columns]


def snapshot_merge(
    base: DataFrame,
    snap: DataFrame,
    today: Column,
    compare: Sequence[str] | None = None,
    primary: bool = True,
    initial: bool | None = None,
    rule: Rule | None = None,
    blocks: Sequence[Callable[[str], list[Column]] | NearBlock] = (),
    max_pairs: int | None = None,
    first_seen: Column | None = None,
    base_ord: bool = False,
) -> DataFrame:
    """The merged list: payload, history columns and the status of every record in this run.

    ``rule`` with its ``blocks`` pairs a removed and a new record that are one edited record. ``first_seen``
    fills ``since`` of new, unpaired records (versioned lists); a paired record inherits it. With ``base_ord`` the place that a
    record had in the base comes along.
    """
    if initial is None:
        initial = base.isEmpty()
    payload, versioned = _payload(snap), "since" in base.columns
    rows = compare_snapshot(base, snap, compare, primary)
    if rule is not None and not initial:
        rows = staged(rows, "merge")
        pairs = pair_edits(
            rows.filter("is_gone").select("id", "base_ord", *payload), rows.filter("is_new").select("id", *payload),
            rule, blocks, max_pairs,
        )
        inherited = ["added", "since"] if versioned else ["added"]
        olds = rows.filter("is_gone").select(F.col("id").alias("old_id"), *[F.col(c).alias(f"_old_{c}") for c in inherited])
        pairs = staged(olds.join(unsent(pairs), "old_id"), "pairs")
        becomes = pairs.select(F.col("old_id").alias("id"), F.col("new_id").alias("_becomes"))
        came = pairs.withColumnsRenamed({"new_id": "id", "old_id": "_came_from"})
        rows = rows.join(unsent(becomes), "id", "left").join(unsent(came), "id", "left")
    else:
        key_type = dict(rows.dtypes)["id"]
        rows = rows.withColumns({
            "_becomes": F.lit(None).cast(key_type), "_came_from": F.lit(None).cast(key_type),
            "_old_added": F.lit(None).cast("date"), "_old_since": F.lit(None).cast("date"),
        })
    becomes, came = F.col("_becomes"), F.col("_came_from")
    is_new, gone, back = F.col("is_new"), F.col("is_gone"), F.col("is_returned")
    first_day = F.lit(None) if initial else today
    added = F.when(came.isNotNull(), F.col("_old_added")).when(is_new, first_day).otherwise(F.col("added"))
    status = (
        F.when(came.isNotNull(), "edit_new").when(becomes.isNotNull(), "edit_old").when(is_new, "new").when(gone, "removed")
        .when(back & F.col("is_edited"), "returned_edited").when(back, "returned").when(F.col("is_edited"), "edited").otherwise("kept")
    )
    since = []
    if versioned:
        known = F.when(came.isNotNull(), F.col("_old_since")).otherwise(F.col("since"))
        fresh = is_new & came.isNull() & F.lit(not initial)
        since = [F.coalesce(known, F.when(fresh, first_seen if first_seen is not None else F.lit(None))).cast("date").alias("since")]
    return rows.select(
        "id",
        *payload,
        "ord",
        added.cast("date").alias("added"),
        F.when(back, F.lit(False)).otherwise(F.col("is_removed") | gone).alias("is_removed"),
        F.when(back, F.lit(None)).when(gone, today).otherwise(F.col("removed")).cast("date").alias("removed"),
        F.when(F.col("is_edited") | came.isNotNull(), today).otherwise(F.col("edited")).cast("date").alias("edited"),
        F.coalesce(came, F.col("edit_of")).alias("edit_of"),
        F.when(back, F.lit(None)).otherwise(F.coalesce(becomes, F.col("replaced_by"))).alias("replaced_by"),
        *since,
        status.alias("status"),
        *(["base_ord"] if base_ord else []),
    )


def merge_counts(merged: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """One row of counts; paired records count neither as added nor as removed."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return merged.agg(
        n("new").alias("added"), n("removed").alias("removed"), n("edited", "returned_edited").alias("edited"),
        n("edit_new").alias("edits"), n("returned", "returned_edited").alias("returned"),
        F.count_if(~F.col("status").isin("new", "edit_new")).alias("base_rows"),
    )


def merge_guards(counts: DataFrame, initial: bool = False, force: bool = False, max_added: int | None = None, min_removed: int = 20) -> DataFrame:
    """Stop rules over the counts: too many removed always stops, too many added stops unless forced."""
    limit = F.greatest(F.lit(float(min_removed)), F.col("base_rows") * 0.05)
    lost = F.col("removed") > limit
    grown = F.lit(False) if force or max_added is None else F.col("added") > max_added
    verdict = F.when(F.lit(initial), "ok").when(lost, "too_many_removed").when(grown, "too_many_added").otherwise("ok")
    return counts.withColumn("verdict", verdict)


def pair_edits(
    gone: DataFrame, fresh: DataFrame, rule: Rule, blocks: Sequence[Callable[[str], list[Column]] | NearBlock], max_pairs: int | None = None
) -> DataFrame:
    """Pairs (old_id, new_id) of removed and new records that ``rule`` takes for one record.

    Old records are tried in base order; one pairs only when exactly one unused candidate fits (see :func:`rollbook.operators.settle.settle_edges`).
    Candidates come from equi-joins on ``blocks``: keys that a pair must share, or a :class:`NearBlock`. With ``max_pairs``, more removed
    records are no edits at all.
    """
    if max_pairs is not None and gone.limit(max_pairs + 1).count() > max_pairs:
        gone = gone.limit(0)
    old, new = staged(gone, "gone").alias("o"), staged(fresh, "fresh").alias("n")  # each block reads them several times
    found = None
    for block in blocks:
        hits = block.joined(old, new) if isinstance(block, NearBlock) else _equal(old, new, block)
        hits = hits.filter(rule("o", "n")).select(F.col("o.id").alias("old_id"), F.col("o.base_ord").alias("old_ord"), F.col("n.id").alias("new_id"))
        found = hits if found is None else found.unionByName(hits)
    return settle_edges(found)


def _keyed(df: DataFrame, alias: str, block: Callable[[str], list[Column]]) -> DataFrame:
    """Records with a block's key; those that lack a part of it have none."""
    parts = [c.cast("string") for c in block(alias)]
    whole = F.lit(True)
    for c in parts:
        whole = whole & c.isNotNull()
    return df.withColumn("_key", F.when(whole, F.array(*parts)))


def _equal(old: DataFrame, new: DataFrame, block: Callable[[str], list[Column]]) -> DataFrame:
    return _keyed(new, "n", block).alias("n").join(unsent(_keyed(old, "o", block).alias("o")), F.col("o._key") == F.col("n._key"))


@dataclass(frozen=True)
class NearBlock:
    """Records that share a key and whose names are near (see :mod:`rollbook.operators.nearnames`): for rules that ask for no less.

    So of a hot key only names that have rare pieces in common are compared, each distinct name once.
    """

    key: Callable[[str], list[Column]]
    share: float
    prefix: bool = False
    max_len: int | None = None
    name: str = "name"

    def joined(self, old: DataFrame, new: DataFrame) -> DataFrame:
        o, n = (_keyed(df, a, self.key).withColumn("_name", _norm(a, self.name)) for df, a in ((old, "o"), (new, "n")))
        names = lambda df: df.select(F.col("_key").alias("key"), F.col("_name").alias("name"))
        pairs = near_name_pairs(names(o), names(n), self.share, self.prefix, self.max_len)
        pairs = pairs.filter(similar_names(F.col("a"), F.col("b"), self.share, self.prefix, self.max_len)).alias("p")
        o, n = o.alias("o"), n.alias("n")
        found = unsent(o).join(unsent(pairs), (F.col("o._key") == F.col("p.key")) & (F.col("o._name") == F.col("p.a")))
        return found.join(unsent(n), (F.col("n._key") == F.col("p.key")) & (F.col("n._name") == F.col("p.b")))


# Edit rules: which removed and new records are one record, with the keys that any such pair must share.

def _norm(alias: str, col: str) -> Column:
    return normalize_compact(F.coalesce(F.col(f"{alias}.{col}"), F.lit("")))


def titled_rule(o: str, n: str) -> Column:
    """Same type, same (or cut) court, nearly the same title."""
    return (
        (_norm(o, "type") == _norm(n, "type"))
        & same_or_cut(F.col(f"{o}.court"), F.col(f"{n}.court"))
        & similar_names(F.col(f"{o}.name"), F.col(f"{n}.name"), 0.08, prefix=True, max_len=3000)
    )


titled_blocks = [NearBlock(lambda a: [_norm(a, "type"), F.substring(_norm(a, "court"), 1, 20)], 0.08, prefix=True, max_len=3000)]


def dated_person_rule(o: str, n: str) -> Column:
    """Same entry date and either birth or name unchanged; without an old date both must be unchanged."""
    same_name = _norm(o, "name") == _norm(n, "name")
    same_birth = F.col(f"{o}.birth") == F.col(f"{n}.birth")
    near = similar_names(F.col(f"{o}.name"), F.col(f"{n}.name"), 0.15)
    dated = F.col(f"{o}.date").eqNullSafe(F.col(f"{n}.date")) & ((same_birth & near) | (~same_birth & same_name))
    undated = (F.coalesce(F.col(f"{o}.birth"), F.lit("")) != "") & same_birth & same_name
    return F.when(F.col(f"{o}.date").isNull(), undated).otherwise(dated)


dated_person_blocks = [
    NearBlock(lambda a: [F.col(f"{a}.date"), F.col(f"{a}.birth")], 0.15),
    lambda a: [F.col(f"{a}.date"), _norm(a, "name")],
    lambda a: [F.col(f"{a}.birth"), _norm(a, "name")],
]


def year_rule(o: str, n: str) -> Column:
    """Same year and nearly the same name, or the same name with another year."""
    same_year = F.col(f"{o}.year") == F.col(f"{n}.year")
    near = similar_names(F.col(f"{o}.name"), F.col(f"{n}.name"), 0.15)
    return (same_year & near) | (~same_year & (_norm(o, "name") == _norm(n, "name")))


year_blocks = [NearBlock(lambda a: [F.col(f"{a}.year")], 0.15), lambda a: [_norm(a, "name")]]


def birth_rule(o: str, n: str) -> Column:
    """Same birth and nearly the same name, or the same name and another, known old birth."""
    same_birth = F.col(f"{o}.birth") == F.col(f"{n}.birth")
    near = similar_names(F.col(f"{o}.name"), F.col(f"{n}.name"), 0.15)
    known = F.coalesce(F.col(f"{o}.birth"), F.lit("")) != ""
    return (same_birth & near) | (~same_birth & known & (_norm(o, "name") == _norm(n, "name")))


birth_blocks = [NearBlock(lambda a: [F.col(f"{a}.birth")], 0.15), lambda a: [_norm(a, "name")]]


def removed_rows(base: DataFrame, snap: DataFrame) -> DataFrame:
    """Live base rows whose id the snapshot no longer has."""
    return base.filter(~F.coalesce(F.col("is_removed"), F.lit(False))).join(unsent(snap.select("id")), "id", "left_anti")


def returned_rows(base: DataFrame, snap: DataFrame) -> DataFrame:
    """Removed base rows whose id the snapshot has again."""
    return base.filter("is_removed").join(unsent(snap.select("id")), "id", "left_semi")


def added_rows(base: DataFrame, snap: DataFrame) -> DataFrame:
    """Snapshot rows (last of each id) whose id the base does not have."""
    return keep_last(snap, "id", "src_pos").join(unsent(base.select("id")), "id", "left_anti")


def reorder(base: DataFrame, snap: DataFrame) -> DataFrame:
    """Positions follow the snapshot; rows it does not have go after its end in their old order."""
    latest = snap.groupBy("id").agg(F.max("src_pos").alias("src_pos"))
    size = snap.agg(F.count(F.lit(1))).scalar()
    after_end = size + F.coalesce(F.col("ord"), F.lit(0))
    return base.join(latest, "id", "left").withColumn("new_ord", F.coalesce(F.col("src_pos"), after_end))


def merge_with_exclusions(base: DataFrame, snap: DataFrame, today: Column, compare: Sequence[str], **options) -> DataFrame:
    """Merge of a source that flags excluded records itself (``out``).

    Live rows, among them those whose flag is missing, merge as usual. An excluded record the base lacks enters already removed on an unknown day and is
    never 'new'; a known one is refreshed silently. The order follows the file.
    """
    payload = [c for c in _payload(snap) if c != "out"]
    last = keep_last(snap, "id", "src_pos")
    live = snap.filter(~F.coalesce("out", F.lit(False))).drop("out")
    merged = snapshot_merge(base, live, today, compare, **options).alias("m")
    out = last.filter("out").alias("o")
    known, flagged = F.col("m.id").isNotNull(), F.col("o.id").isNotNull()
    both = merged.join(out, F.col("m.id") == F.col("o.id"), "full_outer").select(
        F.coalesce("m.id", "o.id").alias("id"),
        *[F.when(flagged, F.col(f"o.{c}")).otherwise(F.col(f"m.{c}")).alias(c) for c in payload],
        F.coalesce("m.ord", F.lit(0)).alias("ord"),
        F.col("m.added").alias("added"),
        F.when(known, F.col("m.is_removed")).otherwise(F.lit(True)).alias("is_removed"),
        *[F.col(f"m.{c}").alias(c) for c in ("removed", "edited", "edit_of", "replaced_by")],
        F.coalesce("m.status", F.lit("excluded")).alias("status"),
    )
    return reorder(both, snap.select("id", "src_pos")).drop("ord", "src_pos").withColumnRenamed("new_ord", "ord")


def assign_parts(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """The last part that holds a record wins; records absent from the source keep their old number."""
    last = parts.groupBy("id").agg(F.max("part").alias("_part"))
    return rows.join(last, "id", "left").withColumn("part", F.coalesce("_part", "part")).drop("_part")
