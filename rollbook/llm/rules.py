"""Quality rules as a ledger: each rule is evaluated once, policies are applied to the stored bits.

Only DataFrame functions; no shuffle before the counts of an ablation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle

WINDOW = 5


@dataclass(frozen=True)
class Policy:
    """A version and the rules whose failure rejects a document."""

    version: str
    rules: tuple[str, ...]


#: Rules in the order of their bits; each is true where a document fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 10 * word_chars",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "long_words": "word_chars > 40 * n_words",
    "shouting": "100 * n_shouts > 10 * word_chars",
}
BASE = Policy("base", ("few_words", "repeated_words"))
FULL = Policy("full-1", tuple(RULES))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Use a value in several places and compute it once."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """Runs of anything but the six ASCII blanks."""
    return F.array_remove(F.split(text, r"[ \t-\r]+"), "")


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """Words inside n-word windows that stand in the array at least twice, first ones included.

    Windows are compared by hash; only where two hashes agree are they sorted, and then their words decide.
    """
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))

    def places(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def same(a: Column, b: Column) -> Column:
            return F.coalesce((a["h"] == b["h"]) & (F.slice(words, a["i"] + 1, n) == F.slice(words, b["i"] + 1, n)), F.lit(False))

        twice = let(ordered, lambda o: F.filter(o, lambda x, k: same(x, F.get(o, k - 1)) | same(x, F.get(o, k + 1))))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
        step = lambda a, i: F.struct((i + n).cast("long").alias("end"), (a["n"] + i + n - F.greatest(i.cast("long"), a["end"])).alias("n"))
        return F.aggregate(at, start, step, lambda a: a["n"])

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(places(h))).otherwise(F.lit(0).cast("long")))


def quality_ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Measurements of every row and ``failed``, the bits of the rules that it fails.

    One row for each row of df, with ``id``, the columns to keep, ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines, n_shouts`` (long) and ``failed`` (long). A null text counts as an empty one: no words, all measures 0, so it fails
    few_words. Ids may be null or repeated. Other columns are not read.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = df.select(df[id_col].alias("id"), *[df[c].alias(f"_keep{k}") for k, c in enumerate(keep)], df[text_col].alias("_text"))
    cut = settle(rows, _words=words_of(text), _lines=F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]")))
    measured = cut.select(
        "id",
        *[F.col(f"_keep{k}") for k in range(len(keep))],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.regexp_count(text, F.lit("!")).cast("long").alias("n_shouts"),
    )
    bits = [F.when(F.expr(rule), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, rule in enumerate(RULES.values())]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    out = settle(measured, failed=failed)
    return out.select("id", *[F.col(f"_keep{k}").alias(c) for k, c in enumerate(keep)], *out.columns[1 + len(keep) :])


def mask(policy: Policy) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in policy.rules)


def fails(policy: Policy, failed: str = "failed") -> Column:
    """Whether a ledger row fails any rule of the policy."""
    return F.col(failed).bitwiseAND(F.lit(mask(policy)).cast("long")) != 0


def ablations(ledger: DataFrame, policy: Policy = FULL) -> DataFrame:
    """For each rule of a policy: rows that fail it, that fail no other rule of the policy, and that are kept with and without it.

    The ledger is first counted by its bits, so that the rest works on at most 2 ** rules rows. An empty ledger gives zeros.
    """
    whole = mask(policy)
    by_bits = ledger.groupBy(F.col("failed").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    names = list(RULES)
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in policy.rules])
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    one = F.col("bits").bitwiseAND(F.col("bit"))
    every = by_bits.sparkSession.range(1).select(F.inline(rules)).select(F.lit(0).cast("long").alias("bits"), F.lit(0).cast("long").alias("n"), "rule", "bit")
    return (
        by_bits.select("bits", "n", F.inline(rules))
        .unionByName(every)
        .groupBy("rule")
        .agg(total(one != 0).alias("n_failed"), total(F.col("bits") == F.col("bit")).alias("n_only"), total(F.col("bits") == 0).alias("n_kept"), total((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("n_kept_without"))
        .withColumn("version", F.lit(policy.version))
    )
