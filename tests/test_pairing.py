"""Candidates for near names, and pairing in order, against brute force; hot blocks and long chains."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from rollbook.functions.text import similar_names
from rollbook.operators import merge, settle
from rollbook.operators.nearnames import near_name_pairs
from rollbook.operators.settle import components, settle_edges
from rollbook.session import staged


def lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def near(a, b, share, prefix, max_len):
    if a == b:
        return True
    short, long = sorted((a, b), key=len)
    if prefix and len(short) >= 30 and len(short) >= 0.5 * len(long) and long.startswith(short):
        return True
    k = max(2, int(len(long) * share + 0.5))
    return (max_len is None or len(long) <= max_len) and len(long) - len(short) <= k and lev(a, b) <= k


def edited(rng, name, k, letters):
    s = list(name)
    for _ in range(k):
        what, at = rng.randrange(3), rng.randrange(len(s) + 1)
        if what == 0:
            s.insert(at, rng.choice(letters))
        elif s and at < len(s):
            s[at : at + 1] = [] if what == 1 else [rng.choice(letters)]
    return "".join(s) or "x"


@pytest.mark.parametrize(("share", "prefix", "max_len"), [(0.15, False, None), (0.08, True, 120), (0.17, True, None)])
def test_no_near_pair_is_missed(spark, share, prefix, max_len):
    rng = random.Random(int(share * 100))
    letters = "абвгде"
    left = ["".join(rng.choice(letters) for _ in range(n))for n in [*range(1, 45), *[rng.randint(45, 150) for _ in range(40)]] for _ in range(2)]
    right = [edited(rng, x, rng.randint(0, max(2, int(len(x) * share * 1.2)) + 1), letters) for x in left for _ in range(2)]
    right += [x[: rng.randint(len(x) // 3, len(x))] for x in left if len(x) > 40] + [x + "".join(rng.choice(letters) for _ in range(rng.randint(1, len(x)))) for x in left if len(x) > 40]
    right += ["a", "aa", "", "😀б", "б😀", "ab"]
    left += ["b", "aaa", "", "😀", "a", "ba"]
    keys = [1, 2]
    frame = lambda names: spark.createDataFrame([(keys[i % 2] if n != "aa" else None, n) for i, n in enumerate(names)], "key int, name string")
    pairs = near_name_pairs(frame(left), frame(right), share, prefix, max_len)
    got = {tuple(r) for r in pairs.filter(similar_names(F.col("a"), F.col("b"), share, prefix, max_len)).collect()}
    sides = [{(keys[i % 2], n) for i, n in enumerate(names) if n not in ("", "aa")} for names in (left, right)]
    want = {(k, a, b) for k, a in sides[0] for j, b in sides[1] if k == j and near(a, b, share, prefix, max_len)}
    assert got == want and len(want) > 100
    assert pairs.count() == pairs.distinct().count()


def test_one_hot_year_takes_linear_candidates(spark):
    """Four thousand removed and new records of one year: each is compared with few others, not with all."""
    n = 4000
    name = lambda k: hashlib.md5(str(k).encode()).hexdigest()
    old = spark.createDataFrame([(f"o{k}", name(k), 1990, k) for k in range(n)], "id string, name string, year int, base_ord long")
    new = spark.createDataFrame([(f"n{k}", "zz" + name(k)[2:], 1990) for k in range(n)], "id string, name string, year int")
    names = lambda df: df.select(F.col("year").alias("key"), "name")
    assert near_name_pairs(names(old), names(new), 0.15).count() < 12 * n  # of 4000 * n
    got = merge.pair_edits(old, new, merge.year_rule, merge.year_blocks)
    assert {(r[0][1:], r[1][1:]) for r in got.collect()} == {(str(k), str(k)) for k in range(n)}


def loop(edges):
    used, out, free = set(), set(), {}
    for o, pos, n in edges:
        free.setdefault((pos, o), set()).add(n)
    for (_, o), ns in sorted(free.items()):
        rest = ns - used
        if len(rest) == 1:
            used |= rest
            out.add((o, *rest))
    return out


@pytest.mark.parametrize("group", [1, 12, 10**6])
@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_are_those_of_a_loop(spark, group, seed):
    rng = random.Random(seed)
    pos = {o: rng.randint(0, 30) for o in range(160)}
    edges = [(o, pos[o], rng.randrange(130)) for o in range(80) for _ in range(rng.randint(1, 3))] + [(80 + i, pos[80 + i], 200 + j) for i in range(80) for j in (i, i + 1) if i % 20]
    frame = spark.createDataFrame(edges + edges[:9], "old_id long, old_ord long, new_id long").repartition(3)
    assert {tuple(r) for r in settle_edges(frame, group, rounds=1).collect()} == loop(edges)
    assert settle_edges(frame.limit(0)).collect() == []


def test_a_chain_of_thousands_takes_few_rounds(spark, monkeypatch):
    n = 3000
    edges = [(i, i, j) for i in range(n) for j in (i - 1, i) if j >= 0]
    rounds = []
    real = settle._next
    monkeypatch.setattr(settle, "_next", lambda *a: rounds.append(1) or real(*a))
    got = {tuple(r) for r in settle_edges(spark.createDataFrame(edges, "old_id long, old_ord long, new_id long")).collect()}
    assert got == loop(edges) == {(i, i) for i in range(n)} and len(rounds) == settle.ROUNDS


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(300)] + [(5, 5)]
    root = {x: x for e in links for x in e}
    changed = True
    while changed:
        changed = False
        for u, v in links:
            low = min(root[u], root[v])
            changed |= root[u] != low or root[v] != low
            root[u] = root[v] = low
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: r for x, r in root.items() if x != r}


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_growing_side_is_broadcast(spark):
    """Names and their pieces are many more rows than their compressed files tell, so none of them may be sent to the driver."""
    names = staged(spark.range(200).select((F.col("id") % 7).alias("key"), F.md5(F.col("id").cast("string")).alias("name")), "names")
    assert "Broadcast" not in planned(near_name_pairs(names, names, 0.15, prefix=True))
    old = names.select(F.concat(F.lit("o"), "name").alias("id"), "name", F.col("key").alias("year"), F.xxhash64("name").alias("base_ord"))
    new = names.select(F.concat(F.lit("n"), "name").alias("id"), "name", F.col("key").alias("year"))
    for found in (merge.NearBlock(lambda a: [F.col(f"{a}.year")], 0.15).joined(old.alias("o"), new.alias("n")), merge._equal(old.alias("o"), new.alias("n"), merge.year_blocks[1])):
        assert "Broadcast" not in planned(found) and found.count() == 200
    assert "Broadcast" not in planned(merge.removed_rows(old.withColumn("is_removed", F.lit(False)), new))
