"""Candidates for nearly equal names inside blocks, without comparing all names of a block with each other.

Two names are near when at most ``max(2, share of the longer)`` edits apart. The candidates come from equi-joins whose rows are
linear in the names' lengths:

- Names of up to 14 characters: two strings within two edits share one made by leaving out at most two characters of each.
- Longer ones: one name is cut into pieces of equal length, more than edits are allowed, so some pieces stand unchanged in the other name,
  moved by no more places than edits. As ``k`` edits spoil ``k`` pieces at most, it is enough to look for any ``k + 1`` of them: the rarest ones.
- A long common beginning: the shorter name's beginning, cut to one of some fixed lengths, is a beginning of the longer one too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import unsent

SHORT = 14
PIECE = 3
#: With a larger share short names could be more than two edits apart, or have fewer pieces than edits.
MOST_SHARE = 0.17
#: Shared beginnings: shortest one, and by how much each of the fixed lengths is longer than the one before.
BEGINNING, STEP = 30, 1.2
LEVELS = [int(BEGINNING * STEP**k) for k in range(64)]  # up to some 3 million characters


def allowed_edits(length: Column, share: float) -> Column:
    """Edits allowed between names of which the longer has this length; half rounds up."""
    return F.greatest(F.lit(2), F.floor(length * F.lit(share) + F.lit(0.5))).cast("int")


def deletions(word: Column, budget: Column) -> Column:
    """The word with up to ``budget`` (0–2) letters left out."""
    n = F.length(word)
    none = F.array().cast("array<string>")

    def without(i):
        return F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1))

    def without_pair(i):
        head = F.substr(word, F.lit(1), i - 1)
        return F.transform(F.sequence(i + 1, n), lambda j: F.concat(head, F.substr(word, i + 1, j - i - 1), F.substr(word, j + 1)))

    singles = F.when(budget >= 1, F.transform(F.sequence(F.lit(1), n), without)).otherwise(none)
    doubles = F.when((budget >= 2) & (n >= 2), F.flatten(F.transform(F.sequence(F.lit(1), n - 1), without_pair))).otherwise(none)
    return F.array_distinct(F.concat(F.array(word), singles, doubles))


def _reach(length: Column, share: float) -> Column:
    """The most edits between a name of this length and any longer one that it may be near to."""
    return allowed_edits(F.floor((length + 0.5) / (1 - share)) + 1, share)


def _sizes(length: Column, share: float) -> Column:
    """Lengths that a name's pieces may have: as long as there is just one more than edits, and shorter, with two pieces to choose from in five."""
    needed = _reach(length, share) + 1
    return F.array_distinct(F.array(F.greatest(F.lit(PIECE), F.floor(length / needed)).cast("int"), F.greatest(F.lit(PIECE), F.floor(length / (needed * 1.4))).cast("int")))


def _short_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    rest = F.explode(deletions(F.col("name"), F.lit(2)))
    a = left.filter(F.length("name") <= SHORT).select("key", F.col("name").alias("a"), rest.alias("rest"))
    b = right.filter(F.length("name") <= SHORT).select("key", F.col("name").alias("b"), rest.alias("rest"))
    return a.join(unsent(b), ["key", "rest"]).select("key", "a", "b")


def _long_pairs(left: DataFrame, right: DataFrame, share: float, max_len: int | None) -> DataFrame:
    least = SHORT + 1 - 3  # the shorter one of a pair of which one is longer than SHORT
    n = F.length("name")
    sized = (n >= least) if max_len is None else n.between(least, max_len)
    letters = F.regexp_extract_all("name", F.lit("(?s)."), 0)
    cut = lambda at: F.array_join(F.slice("letters", at + 1, F.col("size")), "")
    # all pieces of the right names, of every length that a left name near to it may be cut into
    b = right.filter(sized).withColumns({"n": n, "letters": letters})
    low, high = F.floor(F.col("n") * (1 - share)) - 2, F.floor((F.col("n") + 2) / (1 - share)) + 1
    partners = F.sequence(F.greatest(low, F.lit(least)), high)
    b = b.withColumn("size", F.explode(F.array_distinct(F.flatten(F.transform(partners, lambda x: _sizes(x, share))))))
    b = b.filter("size <= n").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("size"))))
    b = b.select("key", "size", cut(F.col("at")).alias("piece"), F.col("name").alias("b"), F.col("at").alias("b_at"), F.col("n").alias("b_n"))
    counts = b.groupBy("key", "size", "piece").agg(F.count(F.lit(1)).alias("count"))
    # of the left names the rarest pieces, of the length with which they are rarer
    a = left.filter(sized).withColumns({"n": n, "letters": letters, "size": F.explode(_sizes(n, share)), "k": _reach(n, share)})
    a = a.withColumn("at", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / F.col("size")) - 1))).withColumn("at", (F.col("at") * F.col("size")).cast("int"))
    a = a.select("key", "size", cut(F.col("at")).alias("piece"), F.col("name").alias("a"), F.col("at").alias("a_at"), F.col("n").alias("a_n"), "k")
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "a_at", "piece")))
    cuts = a.join(unsent(counts), ["key", "size", "piece"], "left").groupBy("key", "size", "a", "a_n", "k").agg(ordered.alias("p"))
    cuts = cuts.withColumn("p", F.slice("p", F.lit(1), F.col("k") + 1))
    cost = F.aggregate("p", F.lit(0).cast("long"), lambda total, x: total + x["count"])
    rare = cuts.groupBy("key", "a", "a_n").agg(F.min_by(F.struct("size", "p"), F.struct(cost, "size")).alias("c"))
    rare = rare.select("key", "a", "a_n", F.col("c.size").alias("size"), F.explode("c.p").alias("p")).filter("p.count > 0")
    rare = rare.select("key", "size", F.col("p.piece").alias("piece"), "a", F.col("p.a_at").alias("a_at"), "a_n")
    near = allowed_edits(F.greatest("a_n", "b_n"), share)
    pairs = rare.join(unsent(b), ["key", "size", "piece"]).filter((F.abs(F.col("a_n") - F.col("b_n")) <= near) & (F.abs(F.col("a_at") - F.col("b_at")) <= near))
    return pairs.select("key", "a", "b")


def _beginnings(left: DataFrame, right: DataFrame) -> DataFrame:
    """Names of which one is a beginning of the other, at least half as long and at least 30 characters."""
    levels = F.array(*[F.lit(x) for x in LEVELS])
    n = F.length("name")

    def shorter(df, out):
        own = df.filter(n >= BEGINNING).withColumn("level", F.array_max(F.filter(levels, lambda x: x <= n)))
        return own.select("key", "level", F.substr("name", F.lit(1), F.col("level")).alias("start"), F.col("name").alias(out))

    def longer(df, out):
        own = df.filter(n >= BEGINNING).withColumn("level", F.explode(F.filter(levels, lambda x: (x <= n) & (x >= n / 2 / STEP - 1))))
        return own.select("key", "level", F.substr("name", F.lit(1), F.col("level")).alias("start"), F.col("name").alias(out))

    on = ["key", "level", "start"]
    pairs = shorter(left, "a").join(unsent(longer(right, "b")), on).unionByName(longer(left, "a").join(unsent(shorter(right, "b")), on))
    return pairs.filter(F.startswith("b", F.col("a")) | F.startswith("a", F.col("b"))).select("key", "a", "b")


def near_name_pairs(left: DataFrame, right: DataFrame, share: float, prefix: bool = False, max_len: int | None = None) -> DataFrame:
    """``(key, a, b)``: every pair of names of one key that may be near, each once; more than that, so the names have yet to be compared.

    ``left`` and ``right`` have ``key`` and ``name``. Names are normalised before; empty ones are near to nothing. Equal names
    are always there, however long; with ``max_len`` longer ones are near to no others.
    """
    if share > MOST_SHARE:
        raise ValueError(f"shares above {MOST_SHARE} are not handled")
    left, right = (df.select("key", "name").filter("key IS NOT NULL AND name <> ''").distinct() for df in (left, right))
    pairs = left.join(unsent(right), ["key", "name"], "left_semi").select("key", F.col("name").alias("a"), F.col("name").alias("b"))
    pairs = pairs.unionByName(_short_pairs(left, right)).unionByName(_long_pairs(left, right, share, max_len))
    if prefix:
        pairs = pairs.unionByName(_beginnings(left, right))
    return pairs.distinct()
