"""Near duplicates, repeated strings and near vectors against brute force."""

import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

from rollbook.llm import components as stars
from rollbook.llm import near, repeats, vectors
from rollbook.llm import shingles as shingle_parts
from rollbook.llm.components import components
from rollbook.llm.queries import QUERIES
from rollbook.llm.shingles import shingle_sets, super_minhash


class Sets:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def tie(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near_truth(docs):
    """docs: (id, text). Smallest id that links reach, for each id."""
    sets, ties = [(k, shingles(t)) for k, t in docs if k is not None], Sets({k for k, _ in docs if k is not None})
    holders, common = defaultdict(list), Counter()
    for i, (_, s) in enumerate(sets):
        for x in s:
            common.update((j, i) for j in holders[x])
            holders[x].append(i)
    for (i, j), n in common.items():
        if 100 * n >= 75 * (len(sets[i][1]) + len(sets[j][1]) - n):
            ties.tie(sets[i][0], sets[j][0])
    return {k: ties.root(k) for k in ties.up}


def check_near(rows, docs):
    truth = near_truth(docs)
    got = sorted((str(r[0]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in rows)
    want = sorted((str(k), len(shingles(t)), str(truth.get(k)), k is not None and truth[k] == k) for k, t in docs)
    assert got == want


def variants(n=60, seed=1):
    """A chain of texts, each with some words of the last one changed, so that ends are linked only through the middle."""
    rng = random.Random(seed)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    out = []
    for i in range(n):
        words = list(words)
        words[rng.randrange(len(words))] = f"x{i}"
        out.append(" ".join(words).upper() if i % 3 else " ".join(words))
    return out


def test_shingle_sets_and_signatures(texts):
    some = [t or "" for t in texts]
    _, counts = shingle_sets(some)
    assert counts.tolist() == [len(shingles(t)) for t in some]
    rng = np.random.default_rng(0)
    for share in (0.5, 0.75, 0.9):
        hashes, sizes = [], []
        for _ in range(200):
            x = rng.integers(0, 1 << 63, 80).astype(np.uint64)
            both = round(80 * share)
            rest = (80 - both) // 2
            hashes += [np.sort(x[: both + rest]), np.sort(np.concatenate([x[:both], x[both + rest :]]))]
            sizes += [both + rest, 80 - rest]
        ranks = super_minhash(np.concatenate(hashes), np.array(sizes), 128)
        assert abs((ranks[::2] == ranks[1::2]).mean() - share) < 0.01


@pytest.mark.parametrize("sizes", [[400_000], [200] * 2000], ids=["one large set", "many sets"])
def test_signatures_in_bounded_memory(monkeypatch, sizes):
    """What a signature takes beside its set doesn't grow with the sets of a group; sets taken in parts get the same one."""
    hashes = np.random.default_rng(1).integers(0, 1 << 63, sum(sizes)).astype(np.uint64)
    tracemalloc.start()
    got = super_minhash(hashes, np.array(sizes), 128)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    monkeypatch.setattr(shingle_parts, "ELEMENTS_AT_ONCE", 1 << 30)
    assert np.array_equal(got, super_minhash(hashes, np.array(sizes), 128))


def test_signatures_of_sets_taken_in_parts(monkeypatch):
    sizes = np.array([0, 3, 0, 70, 5, 0, 1, 41, 200, 0])
    hashes = np.random.default_rng(2).integers(0, 1 << 63, sizes.sum()).astype(np.uint64)
    whole = super_minhash(hashes, sizes, 128)
    for at_once in (1, 2, 40, 64):
        monkeypatch.setattr(shingle_parts, "ELEMENTS_AT_ONCE", at_once)
        assert np.array_equal(whole, super_minhash(hashes, sizes, 128))
    assert super_minhash(hashes[:0], np.zeros(2, np.int64), 4).tolist() == [[2**64 - 1] * 4] * 2


def test_near_duplicates(spark, frame, empty):
    docs = [(r["doc_id"], r["text"]) for r in frame.collect()]
    check_near(near.near_duplicates(frame).collect(), docs)
    assert near.near_duplicates(empty).collect() == []
    chain = list(enumerate(variants())) + [(100, "lone words here"), (101, "LONE words  here"), (102, None), (103, "")]
    check_near(near.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string")).collect(), chain)


def test_near_duplicates_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(near, "TILE", 16)
    docs = list(enumerate(variants(90, 2)))
    random.Random(3).shuffle(docs)
    docs = [(k, t) for k, (_, t) in enumerate(docs)]
    check_near(near.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)


def test_op10(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_near(QUERIES["op10_minhash_near_dedup"](spark, sf).collect(), docs)


@pytest.mark.parametrize("edges", [[], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 50)], [(9, 8), (8, 9), (7, 3), (3, 8), (20, 21), (None, 4)]], ids=["none", "path", "star", "mixed"])
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    real = [(u, v) for u, v in edges if u is not None and u != v]
    ties = Sets({x for e in real for x in e})
    for u, v in real:
        ties.tie(u, v)
    assert got == {x: ties.root(x) for x in ties.up}


@pytest.mark.parametrize("at_once", [3, 1 << 20])
def test_components_of_edges_tied_in_parts(spark, monkeypatch, at_once):
    """Chains, hubs with the lowest and the highest number, and loose pairs, dealt over partitions in any order, some tied in parts of a few edges."""
    monkeypatch.setattr(stars, "EDGES_AT_ONCE", at_once)
    rng = random.Random(7)
    name = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(700)]
    edges = [(name[i], name[i + 1]) for i in range(199)] + [(min(name) - 1, name[i]) for i in range(200, 400)] + [(max(name) + 1, name[i]) for i in range(390, 600)]
    edges += [(name[i], name[i + 1]) for i in range(600, 700, 2)] + [(name[i], name[i]) for i in range(9)]
    rng.shuffle(edges)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    ties = Sets({x for u, v in edges for x in (u, v) if u != v})
    for u, v in edges:
        if u != v:
            ties.tie(u, v)
    assert got == {x: ties.root(x) for x in ties.up}


def test_components_in_few_tasks(spark):
    """A round shuffles little: with stars that were made twice and checked in a shuffle of their own this took 1,909 tasks."""
    tracker, n = spark.sparkContext.statusTracker(), 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 200)], "u long, v long").repartition(5)
    for k, x in (("spark.sql.shuffle.partitions", n), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        spark.conf.set(k, x)
    spark.sparkContext.setJobGroup("few tasks", "")
    try:
        assert components(edges).where("component NOT IN (0, 100)").count() == 0
    finally:
        spark.sparkContext.setJobGroup("", "")
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stages = {s for j in tracker.getJobIdsForGroup("few tasks") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))
    assert tasks < 30 * n


def removal_truth(texts, length):
    raws = [(t or "").encode() for t in texts]
    starts = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if starts[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def check_removals(df, length=200):
    texts = [r["text"] for r in df.select("text").collect()]
    want = removal_truth(texts, length)
    names = ["n_bytes", "n_removed", "n_spans"]
    got = sorted(tuple(r) for r in repeats.removal_digests(df, length=length).select(*names, "kept_sha256").collect())
    assert got == want
    whole = repeats.remove_repeats(df, length=length).select(*names, "kept").collect()
    assert sorted((*r[:3], hashlib.sha256(r[3]).hexdigest()) for r in whole) == want


def passages(seed=5):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdé \n") for _ in range(4000))
    return [
        base, base[100:900] + "X" + base[1500:1701], base[3000:3200], base[3000:3199], "a" * 1000, "a" * 199, "ab" * 600, None, "", base,
        "q" * 50 + base[3500:3800] + "z", "xyz" * 700 + base[10:400], base[200:] + base[:300],
        *["%d" % i * rng.randint(1, 30) + base[2000:2260] + "".join(rng.choice("abcd") for _ in range(300)) for i in range(40)],
    ]


def test_removals(spark, frame, empty):
    check_removals(spark.createDataFrame(list(enumerate(passages())), "doc_id long, text string"))
    check_removals(frame.drop("kept"))
    assert repeats.remove_repeats(empty).collect() == []


def test_removals_across_parts_and_of_frequent_leads(spark, monkeypatch):
    """Long texts in small parts; and the road of leads that very many documents share, taken for all or for some."""
    monkeypatch.setattr(repeats, "PART", 512)
    df = spark.createDataFrame(list(enumerate(passages(6))), "doc_id long, text string")
    starts = repeats.repeated_places(df).collect()
    for share in (0.0, 0.3):
        monkeypatch.setattr(repeats, "FREQUENT", share)
        monkeypatch.setattr(repeats, "FEW", 1)
        check_removals(df)
    assert starts


def test_multikey_sort():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 99, 4000).astype(np.uint8)
    starts = rng.integers(0, 3900, 700)
    order, run = repeats.multikey_sort(raw, starts)
    suffixes = [raw[s : s + repeats.LEAD].tobytes() for s in starts[order].tolist()]
    assert suffixes == sorted(suffixes)
    assert [a == b for a, b in zip(suffixes, suffixes[1:], strict=False)] == (run[1:] == run[:-1]).tolist()


def test_op4(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = QUERIES["op4_suffix_dedup"](spark, sf).collect()
    assert len({r["doc_id"] for r in rows}) == len(docs)
    assert sorted(tuple(r)[1:] for r in rows) == removal_truth([t for _, t in docs], 200)


def check_vectors(df, least=0.9, recall=1.0, **more):
    rows = [(r[0], r[1]) for r in df.collect()]
    good = [(k, np.array(v, float)) for k, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v) and k is not None]
    links, ties = Counter(), Sets({k for k, _ in rows if k is not None})
    for i, (a, x) in enumerate(good):
        for b, y in good[:i]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[a] += 1
                links[b] += 1
                ties.tie(a, b)
    got = vectors.near_vectors(df, least=least, **more).collect()
    assert len(got) == len(rows)
    assert all(r["n_links"] <= links[r["id"]] for r in got)
    assert sum(r["n_links"] for r in got) >= recall * sum(links.values())
    if recall == 1.0:
        assert {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {k: (links[k], ties.root(k) if k is not None else None, k is not None and ties.root(k) == k) for k, _ in rows}


def test_near_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(200, 8))
    rows = [(i, (base[i % 200] if i < 250 else base[i % 7] * 2 + rng.normal(size=8) * 0.15).tolist()) for i in range(300)]
    odd = [None, [], [0.0] * 8, [float("nan")] * 8, [float("inf")] * 8, [None] * 8, [1.0, 2.0], [1.0, 2.1], [1e30] * 8, [1e-30] * 8, [3.0, 4.0, 5.0], [3.0, None, 4.0, 5.0], [None, 1.0, 2.0], [1.0, float("nan")]]
    rows += [(400 + i, v) for i, v in enumerate(odd)] + [(None, rows[0][1])]
    schema = "vec_id long, embedding array<double>"
    check_vectors(spark.createDataFrame(rows, schema))
    assert vectors.near_vectors(spark.createDataFrame([], schema)).collect() == []
    assert [tuple(r) for r in vectors.near_vectors(spark.createDataFrame([(5, None)], schema)).collect()] == [(5, 0, 5, True)]
    monkeypatch.setattr(vectors, "TILE", 50)
    check_vectors(spark.createDataFrame(rows[:-1], schema))
    monkeypatch.setattr(vectors, "SHARD", 40)
    monkeypatch.setattr(vectors, "audit", lambda *more: (1.0, 0))  # as the searches leave it
    check_vectors(spark.createDataFrame(rows[:-1], schema), guests=1, recall=0.95)


def test_op8(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    check_vectors(df)
    assert QUERIES["op8_embedding_near_dedup"](spark, sf).count() == df.count()


def far_pairs(n, pairs, dims=24, seed=8):
    """Far vectors, and lone pairs of near ones."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dims))
    return np.concatenate([base, base[:pairs] + rng.normal(size=(pairs, dims)) * 0.2])


def vector_rows(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def test_no_pass_is_taken_unaudited(spark, monkeypatch):
    """Lone pairs in a table of few and of many shards, with searches that find next to nothing: all pairs are found in the end."""
    monkeypatch.setattr(vectors, "BLOCK", 100)
    monkeypatch.setattr(vectors, "_search", lambda x, lists, queries, *more: iter(()))
    x = far_pairs(700, 30)
    for shard, guests in ((200, 3), (20, 0)):
        monkeypatch.setattr(vectors, "SHARD", shard)
        check_vectors(vector_rows(spark, x), guests=guests)


def test_audit_draws_until_nodes_have_links(spark):
    x = far_pairs(1500, 3)
    nodes = vectors.nodes_of(vector_rows(spark, x), "vec_id", "embedding").cache()
    none = spark.createDataFrame([], "node long, n long")
    assert vectors.audit(nodes, none, 24, 0.9, 1503, audited=6, draws=9) == (0.0, 6)
    some = spark.createDataFrame([(k, 1) for k in (0, 1, 1500)], "node long, n long")
    assert vectors.audit(nodes, some, 24, 0.9, 1503, audited=7, draws=9) == (0.5, 6)
    assert vectors.audit(nodes.where("node between 10 and 900"), none, 24, 0.9, 891) == (1.0, 0)
    assert vectors.audit(nodes, none, 24, 0.9, 1503, audited=2, draws=1)[1] < 6  # no further scans


def chains_and_pairs(seed=6, dims=24):
    """Lone pairs, chains of neighbours, a dense group, and far vectors: 3,000 in all."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(1900, dims))
    pairs = base[:500] + rng.normal(size=(500, dims)) * 0.2
    steps = [rng.normal(size=dims) for _ in range(20)]
    chains = []
    for v in steps:
        for _ in range(20):
            v = v + rng.normal(size=dims) * 0.25
            chains.append(v)
    dense = rng.normal(size=dims) + rng.normal(size=(200, dims)) * 0.15
    return np.concatenate([base, pairs, np.array(chains), dense])


@pytest.mark.parametrize("cells", [False, True], ids=["centres", "centres of centres"])
def test_recall_over_many_shards(spark, monkeypatch, cells):
    """More than a hundred overlapping shards: what the graph finds by itself, by the library's own audit and by brute force."""
    monkeypatch.setattr(vectors, "SHARD", 25)
    monkeypatch.setattr(vectors, "compared", None)  # never the plain way
    if cells:
        monkeypatch.setattr(vectors, "MOST_SHARDS", 12)
    seen, real = [], vectors.audit
    monkeypatch.setattr(vectors, "audit", lambda *a: seen.append(real(*a)) or seen[-1])
    used, graph = [], vectors.graph
    monkeypatch.setattr(vectors, "graph", lambda rows, dims, shards, least: used.append(rows.select("shard").distinct().count()) or graph(rows, dims, shards, least))
    check_vectors(vector_rows(spark, chains_and_pairs()), recall=0.95)
    assert used[0] > 100 and seen[-1][0] >= 0.98 and seen[-1][1] >= 300


def test_a_group_astride_shards_makes_no_rows_of_pairs(spark, monkeypatch):
    """Three hundred near copies between two centres: what is shuffled is linear, and counts are whole."""
    monkeypatch.setattr(vectors, "SHARD", 100)
    rng = np.random.default_rng(4)
    group = np.eye(16)[0] + np.eye(16)[1] + rng.normal(size=(300, 16)) * 0.05
    x = np.concatenate([group, np.eye(16)[0] * 3 + rng.normal(size=(150, 16)) * 0.5, np.eye(16)[1] * 3 + rng.normal(size=(150, 16)) * 0.5])
    rows, real = [], vectors.found_links
    monkeypatch.setattr(vectors, "found_links", lambda *a: rows.append(real(*a)) or rows[-1])
    check_vectors(vector_rows(spark, x), recall=0.97)
    assert rows[0].count() < 10 * len(x)


@pytest.mark.parametrize("size", [30, 120])
def test_groups_of_many_copies_are_linked(spark, monkeypatch, size):
    """Two clouds, tight inside and in range of each other, far from all else; without the audit's help."""
    monkeypatch.setattr(vectors, "SHARD", 400)
    monkeypatch.setattr(vectors, "audit", lambda *more: (1.0, 0))
    rng = np.random.default_rng(5)
    a = np.eye(24)[0]
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * np.eye(24)[1]
    clouds = np.concatenate([c + rng.normal(size=(size, 24)) * 0.002 for c in (a, b)])
    x = np.concatenate([clouds, rng.normal(size=(800, 24)) - 2 * a])
    check_vectors(vector_rows(spark, x), guests=0)


def test_splitters_come_from_long_texts_too(spark):
    """A table of nothing but texts longer than a part is spread over many buckets, and its frequent leads are seen."""
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(700))
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(repeats.PART + 9000)) + chr(65 + k) + passage for k in range(12)]
    rows = repeats._rows(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    splitters, frequent = repeats.sampled(rows, 200, 64)
    assert len(splitters) > 50 and len(frequent) > 0
    got = repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got) == sorted((len(t), 700, 1) for t in texts)


def test_a_task_tells_of_a_hot_lead_a_few_times(spark, monkeypatch):
    """A footer in every text of a task that takes them in many groups: results stay whole. What a task remembers is bounded."""
    rng = random.Random(31)
    footer = "".join(rng.choice("abcdefgh ") for _ in range(400))
    texts = ["".join(rng.choice("ijklmnop ") for _ in range(rng.randint(300, 900))) + chr(65 + k % 50) + footer for k in range(300)]
    want = removal_truth(texts, 200)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(repeats, "PART", 1024)  # groups of some eight texts
    got = repeats.remove_repeats(df).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got) == sorted(w[:3] for w in want)
    met = repeats._Met(8)
    met.add(np.array([7, 3, 7], np.int64))
    assert met.has(np.array([3, 4, 7])).tolist() == [True, False, True]
    met.add(np.arange(20, dtype=np.int64))
    assert len(met.values) == 4 and met.has(met.values).all()
