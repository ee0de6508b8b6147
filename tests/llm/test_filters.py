"""Url lists, rules, license scans, the classifier and the pipeline against brute force and SQL."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from compare import compare, oracle
from rollbook.llm import licenses, quality, rules, urls
from rollbook.llm.queries import ORACLES, QUERIES
from test_duplicates import near_truth, removal_truth


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf, name):
    assert compare(spark, oracle(sf), sf, name, QUERIES[name], ORACLES[name]) is None


def url_truth(url, entries, default="allow"):
    host, path = "", ""
    if url is not None and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in entries if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, default))
    return host, path, best[3], best[4]


def test_url_filter(spark):
    rng = random.Random(1)
    host = lambda: ".".join(rng.choice(["a", "b", "com", "ex"]) for _ in range(rng.randint(1, 3)))
    path = lambda: rng.choice(["", "/", "/e", "/en", "/en/", "/en/x", "/de//y/", "//"])
    entries = list({(rng.choice(["allow", "block"]), host(), path()) for _ in range(60)})
    links = [f"{rng.choice(['http', 'x', ''])}://{rng.choice(['', 'W.', 'ß.', '.'])}{host()}{path()}{rng.choice(['', '?q=/en/', '#/a', '/en/z', 'n'])}" for _ in range(400)]
    links += [None, "", "no scheme", "://", "http://", "a://b://c/d", "HTTP://A.COM:80/x", "http://a\nb/c\n?d", *links[:20]]
    df = spark.createDataFrame([(None if i == 7 else i % 300, u, "x", "y") for i, u in enumerate(links)], "page_id long, url string, host string, id string")
    want = sorted(map(str, ((r["page_id"], *url_truth(r["url"], entries)) for r in df.collect())))
    assert sorted(str(tuple(r)) for r in urls.url_filter(df, entries).collect()) == want
    listed = spark.createDataFrame(entries, "verdict string, host string, path string")
    assert sorted(str(tuple(r)) for r in urls.url_filter(df, listed, max_entries=3).collect()) == want  # joined, not sent
    assert urls.url_filter(df.limit(0), entries).collect() == []
    assert {r["verdict"] for r in urls.url_filter(df, [], default="block").collect()} == {"block"}
    for bad in (("deny", "a", ""), ("allow", "", "/"), ("allow", "a", "x")):
        with pytest.raises(ValueError):
            urls.url_filter(df, [bad])


def ledger_truth(text):
    text = text or ""
    words = [w for w in re.split("[ \t-\r]+", text) if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search("[^ \t-\r]", x)]
    m = {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered), "n_lines": len(lines), "n_shouts": text.count("!"),
    }
    failed = sum(1 << k for k, rule in enumerate(rules.RULES.values()) if eval(rule, {}, dict(m)))
    return (*m.values(), failed)


def test_ledger(spark, frame, texts, empty):
    more = ["#*$ " * 30, "a b c d e " * 5, "x\nx\n\n \nx y", "!" * 50 + " a" * 20, "A" * 900, "a b c d e f a b c d e g", "w " * 9, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"]
    df = frame.select("doc_id", "text", "k1").union(spark.createDataFrame([(1, t, "n_words") for t in more], "doc_id long, text string, k1 string"))
    rows = rules.quality_ledger(df, keep=("k1", "text")).collect()
    assert all(tuple(r)[3:] == ledger_truth(r["text"]) for r in rows)
    assert len(rows) == len(texts) + len(more)
    assert rules.quality_ledger(empty).collect() == []
    few = rules.quality_ledger(df).cache()
    bits = [r["failed"] for r in few.collect()]
    for policy in (rules.BASE, rules.FULL):
        whole = rules.mask(policy)
        got = {r["rule"]: (r["n_failed"], r["n_only"], r["n_kept"], r["n_kept_without"]) for r in rules.ablations(few, policy).collect()}
        for name in policy.rules:
            bit = 1 << list(rules.RULES).index(name)
            own = [b & whole for b in bits]
            assert got[name] == (sum(b & bit > 0 for b in own), sum(b == bit for b in own), sum(b == 0 for b in own), sum(b in (0, bit) for b in own))
    assert {r["n_kept"] for r in rules.ablations(rules.quality_ledger(empty)).collect()} == {0}


def license_truth(text):
    lower = re.sub("[A-Z]", lambda c: c[0].lower(), text or "")
    pattern = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    words = re.findall(pattern, lower)
    places = sorted((i, label) for label, phrase in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    shares = {}
    for label, template in licenses.TEMPLATES:
        ws = re.findall(pattern, re.sub("[A-Z]", lambda c: c[0].lower(), template))
        own, span = set(ws), -(-len(ws) * 5 // 4)
        need = len(own) if len(own) < 10 else -(-len(own) * 8 // 10)
        best = max((len(own & set(words[i : i + span])) for i, w in enumerate(words) if w in own), default=0)
        if best >= need:
            shares[label] = max(shares.get(label, 0), best / len(own))
    base = sorted({label for _, label in places})
    at = [i for i, _ in places]
    score = 1.0 if places else max(shares.values(), default=0.0)
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted({*base, *shares})), round(score, 9)


def test_license_scan(spark, frame, texts, empty):
    rng = random.Random(2)
    more = [" ".join(rng.sample(t.split(), rng.randint(1, len(t.split())))) for _, t in licenses.TEMPLATES for _ in range(12)]
    more += ["All Rights Reserved! all rights reserved", "cc by cc-by CC_BY cc\nby", "general Public license\ngeneral public", "WORK LIKe", "\n".join(t for _, t in licenses.TEMPLATES), *more[:10]]
    df = frame.select("doc_id", "text").union(spark.createDataFrame([(i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    got = sorted(str((*tuple(r)[1:-1], round(r["score"], 9))) for r in licenses.license_scan(df).collect())
    assert got == sorted(str(license_truth(t)) for t in [*texts, *more])
    assert licenses.license_scan(empty).collect() == []
    assert licenses.license_scan(df, templates=()).where("labels <> base_labels").count() == 0


def test_label_model_finds_the_labellers():
    """Votes drawn from known rates: the model gets the rates and the classes back."""
    rng = np.random.default_rng(1)
    shares = [0.8, 0.05, 0.05, 0.05, 0.05, 0, 0, 0]  # three kinds that do not occur
    kind = rng.choice(len(shares), 20000, p=shares)
    votes = np.zeros((len(kind), len(quality.LABELLERS)), np.int64)
    for j, known in enumerate(quality.KNOWN):
        hit = np.isin(kind - 1, known) if known else kind == 0
        votes[:, j] = np.where(rng.random(len(kind)) < np.where(hit, 0.7, 0.02), quality.BAD if known else quality.GOOD, quality.ABSTAIN)
    codes, counts = np.unique(quality._code(votes), return_counts=True)
    model = quality.fit_labels(quality._votes_of(codes), counts.astype(float))
    assert np.abs(model.shares - shares).max() < 0.02
    assert ((model.posterior(votes) > 0.5) == (kind > 0)).mean() > 0.97
    assert abs(model.table[1, 0, quality.BAD] - 0.7) < 0.05
    nothing = quality.fit_labels(np.zeros((0, len(quality.LABELLERS)), np.int64), np.zeros(0))
    assert np.isfinite(nothing.table).all()


def test_classifier_on_held_out_labels(spark):
    """No labelled row takes part in fitting; prose stays, junk goes."""
    folder = "/root/testdata/sf0.1"  # 6,000 rows to fit on; with the 600 of sf0.01, 93 % of the junk goes
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.fit_classifier(docs.join(labels, "doc_id", "left_anti"))
    rows = quality.classify(docs, model).join(labels.withColumnRenamed("doc_id", "id"), "id").collect()
    for wanted in (0, 1):
        right = [r["kept"] == bool(wanted) for r in rows if r["quality"] == wanted]
        assert np.mean(right) > 0.95


def test_junk_that_the_tables_do_not_hold(spark):
    """Menus, lists of links, long strings and numbers are told from prose by labellers of their own, and by what the scorer has learnt of words."""
    rng = random.Random(3)
    words = ["tree", "river", "stone", "walks", "under", "bright", "morning", "with", "people", "found", "every", "small", "garden", "letters", "answered"]
    prose = lambda: " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(rng.randint(60, 200)))
    junk = [
        lambda: "\n".join(rng.choice(["Home", "About us", "Log in", "Contact", "Next page", "Share this"]) for _ in range(rng.randint(15, 40))),
        lambda: " ".join(f"https://{rng.choice(words)}.example/{rng.randint(1, 99)}" for _ in range(rng.randint(10, 40))),
        lambda: " ".join("".join(rng.choice("abcdef0123456789") for _ in range(40)) for _ in range(rng.randint(10, 40))),
        lambda: " ".join(str(rng.randint(0, 10**6)) for _ in range(rng.randint(20, 90))),
    ]
    rows = [(i, prose(), 1) if i % 5 else (i, rng.choice(junk)(), 0) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, good int")
    model = quality.fit_classifier(docs.where("doc_id % 2 = 0"))
    got = quality.classify(docs.where("doc_id % 2 = 1"), model, keep=("good",)).collect()
    assert np.mean([r["kept"] for r in got if r["good"]]) > 0.99 and np.mean([r["kept"] for r in got if not r["good"]]) < 0.05


def test_classifier_on_odd_texts(spark, frame, texts, empty, sf):
    model = quality.fit_classifier(frame)
    rows = quality.classify(frame, model, keep=("k1", "text")).collect()
    assert len(rows) == len(texts)
    assert all(not r["kept"] and r["score"] == 0 for r in rows if not (r["text"] or "").strip(" \t\n"))
    assert all(0 <= r["score"] <= 1 and 0 <= r["posterior"] <= 1 for r in rows)
    assert quality.classify(empty, quality.fit_classifier(empty)).collect() == []
    assert QUERIES["op6_quality_classifier"](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_pipeline(spark, sf, tmp_path):
    """Each stage beside brute force on what the one before has left."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(150)
    extra = [(None, "no id here but words enough to stay in the corpus, for all I know about it.", "en", "s", 1), (7, None, None, None, None), (8, "", "en", "s", 0)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema)).union(docs.limit(3))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        path = f"{tmp_path}/{k}"
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        after = docs.collect()
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
            rows, kept = [tuple(r) for r in before], [tuple(r) for r in after]
        if k in (0, 1):
            assert set(kept) <= set(rows)
        if k == 1:
            assert sorted(map(str, kept)) == sorted(str(r) for r in rows if ledger_truth(r[1])[-1] == 0)
        if k == 2:
            truth = near_truth([(r[0], r[1]) for r in rows])
            assert sorted(map(str, kept)) == sorted(map(str, {r for r in rows if r[0] is None or truth[r[0]] == r[0]}))
        if k == 3:
            want = removal_truth([r[1] for r in rows], 200)
            assert len(kept) == len(rows)
            assert sum(w[0] - w[1] for w in want) - 8 * sum(w[2] for w in want) <= sum(len((r[1] or "").encode()) for r in kept) <= sum(w[0] - w[1] for w in want)
            assert all(r[4] == len(r[1]) for r in kept)
        if k == 4:
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "quality_rules", "near_dedup", "suffix_dedup", "packing"]


def test_pipeline_of_no_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() == 0


NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction",
    "bsd": "Redistribution and use in source and binary forms, with or without\n   modification, are permitted provided that the following conditions\n   are met:",
    "apache": "# Unless required by applicable law or agreed to in writing,\n# software distributed under the License is distributed on an\n# \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,\n# either express or implied. See the License for the specific language governing permissions and limitations",
    "isc": "Permission to use, copy, modify, and/or distribute this\nsoftware for any purpose with or without fee is hereby granted,\nprovided that the above copyright notice and this permission\nnotice appear in all copies.",
}
SHORT = {"Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc", "Licensed under CC BY-SA 4.0.": "cc-by,cc-by-sa", "Released under the BSD License.": "bsd", "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache"}


def test_notices_are_found_across_lines_and_not_taken_for_their_siblings(spark):
    rows = [(t, label) for label, t in NOTICES.items()] + list(SHORT.items()) + [("x " * 4000 + t.replace(" ", "\n") + " y" * 4000, label) for t, label in SHORT.items()]
    rows += [("Permission is granted to any person. " + "word " * 60 + "obtaining a copy of this software and associated files hereby free of charge documentation", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, want string")
    got = {r["id"]: r["labels"] for r in licenses.license_scan(df).collect()}
    assert got == {i: label for i, (_, label) in enumerate(rows)}


def test_long_texts_of_template_words(spark, monkeypatch):
    """Parts that overlap lose no block; a text that is all template words stays within bounded rows."""
    rng = random.Random(9)
    words = sorted({w for _, t in licenses.TEMPLATES for w in licenses.template_words(t)})
    some = [" ".join(rng.choice(words) for _ in range(rng.randint(200, 900))) + " " + rng.choice(licenses.TEMPLATES)[1] + " " + " ".join(rng.choice(words) for _ in range(300)) for _ in range(25)]
    some += ["license " * 300_000, " ".join(["mit license the"] * 3000 + ["released under the mit license"])]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    want = {i: license_truth(t) for i, t in enumerate(some)}
    for part in (licenses.PART, 37):
        monkeypatch.setattr(licenses, "PART", part)
        got = {r["id"]: (*tuple(r)[1:-1], round(r["score"], 9)) for r in licenses.license_scan(df).collect()}
        assert got == want


def test_no_templates_and_joined_prefixes(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License."), (2, None)], "doc_id long, text string")
    assert {r["id"]: r["labels"] for r in licenses.license_scan(df, templates=()).collect()} == {1: "", 2: ""}
    sets = [licenses.Template.of(*t) for t in licenses.TEMPLATES]
    marks = df.where("doc_id = 1").select(licenses.F.lit(5).cast("long").alias("_row"), licenses.marked_words(licenses.ascii_words(licenses.F.col("text")), sorted({w for t in sets for w in t.words})).alias("marks"))
    for limit in (licenses.MAX_SENT, 0):
        assert [tuple(r) for r in licenses.template_matches(marks, sets, limit).collect()] == [(5, "mit", 1.0)]


def test_characters_at_the_edges_of_removed_runs(spark, sf):
    """Cut characters go, whole ones stay, among them the replacement character itself; repeated rows give one, whatever their order."""
    from rollbook.llm.repeats import _trimmed, remove_repeats

    raw = "aé日😀b".encode()
    for start in range(len(raw) + 1):
        for stop in range(start, len(raw) + 1):
            whole = [c for c, at in zip("aé日😀b", (0, 1, 3, 6, 10), strict=True) if at >= start and at + len(c.encode()) <= stop]
            assert _trimmed(raw, start, stop).decode() == "".join(whole)
    shared = "日本" * 70
    texts = ["� one " + shared + " two �", "é" + shared + "é�", "x" + shared, "�" * 50, None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.suffix_dedup(spark, docs, sf).collect()}
    plain = {r["doc_id"]: bytes(r["kept"]).decode("utf-8", "replace") for r in remove_repeats(docs).collect()}
    assert got[0].startswith("� one ") and got[0].endswith(" two �") and got[1].startswith("é") and got[1].endswith("é�")
    assert got[3] == texts[3] and got[4] == got[5] == "" and all(got[k].replace("�", "") == plain[k].replace("�", "") for k in got)
    twice = spark.createDataFrame([(1, "a b c d e f g", "fr", "z", 3), (1, "a b c d e f g", "de", "y", 9)] * 3, docs.schema)
    assert [tuple(r) for r in corpus_pipeline.near_dedup(spark, twice, sf).collect()] == [(1, "a b c d e f g", "de", "y", 9)]
