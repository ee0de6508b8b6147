"""Vector codes against plain rounds over all pairs, in Python integers."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from compare import compare, oracle
from rollbook.llm.codes import books_digest, compress_vectors, nearest
from rollbook.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, code string, whole binary, size int, entry long"


def plain(rows, entries, rounds, parts=4, scale=1024):
    """rows: (id, vector, label) of one length; codes and errors in the order of id and vector, and the books."""
    whole = [(i, [math.floor(scale * x) for x in v] + [0] * (-len(v) % parts), label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))
    width = len(whole[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in whole]
    books = [[cut[k][p] for k in range(min(entries, len(cut)))] for p in range(parts)]

    def assign():
        return [[min(range(len(books[p])), key=lambda e: (sum((a - b) ** 2 for a, b in zip(c[p], books[p][e], strict=True)), e)) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, code in zip(cut, codes, strict=True) if code[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    codes = assign()
    errors = [sum((a - b) ** 2 for p in range(parts) for a, b in zip(c[p], books[p][code[p]], strict=True)) for c, code in zip(cut, codes, strict=True)]
    by_label = {}
    for (_, _, label), e in zip(whole, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    return sorted([(str(i), bytes(code).hex(), e, by_label[label]) for (i, _, label), code, e in zip(whole, codes, errors, strict=True)]), np.array(books)


def got(df, **options):
    coded, books = compress_vectors(df, **options)
    return sorted((str(r["id"]), bytes(r["code"]).hex(), r["error"], r["label_error"]) for r in coded.collect()), books


def vectors(n, dim, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    return [[float(np.float32(x)) for x in centres[k % 9] * spread + rng.normal(size=dim) * 0.1] for k in range(n)]


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 60), st.integers(1, 5), st.sampled_from([3, 40, 2_000_000]))
def test_balls_leave_out_no_nearest_entry(seed, n_entries, n, width, top):
    """From any entries before, good or bad; few different numbers make many ties."""
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-top, top + 1, (n, width)), rng.integers(-top, top + 1, (n_entries, width))
    want = ((x[:, None] - c) ** 2).sum(axis=2)
    for before in (None, rng.integers(0, n_entries, n), want.argmin(axis=1)):
        best, squared, _ = nearest(x, c, before)
        assert best.tolist() == want.argmin(axis=1).tolist()
        assert squared.tolist() == want.min(axis=1).tolist()


def test_cores_and_rings_save_work():
    """Tight groups are all core: one distance a row; wide ones are compared with some entries only."""
    rng = np.random.default_rng(2)
    c = rng.integers(-5000, 5000, (256, 16))
    home = rng.integers(0, 256, 5000)
    tight = c[home] + rng.integers(-20, 20, (5000, 16))
    assert nearest(tight, c, home)[2] == 5000
    line = np.arange(256)[:, None] * 100 + np.zeros((1, 4), np.int64)
    x = line[home] + rng.integers(-60, 60, (5000, 4))
    best, _, looked = nearest(x, line, home)
    assert looked < 5000 * 12 and best.tolist() == ((x[:, None] - line) ** 2).sum(axis=2).argmin(axis=1).tolist()


@pytest.mark.parametrize("entries,rounds", [(256, 4), (7, 4), (20, 1), (5, 0)])
def test_codes_are_those_of_plain_rounds(spark, entries, rounds):
    vs = vectors(300, 8, entries)
    rows = [(k * 3 % 301, v, None if k % 5 == 0 else k % 3) for k, v in enumerate(vs)]
    rows += [(900 + k, rows[k][1], 7) for k in range(40)]
    rows += [(None, vs[3], 1), (None, vs[4], 1), rows[0], rows[0], (5, vs[9], 2), (5, vs[8], 2)]
    left_out = [(1000, None, 1), (1001, [0.1] * 7 + [None], 1), (1002, [0.1] * 7 + [float("nan")], None), (1003, [float("inf")] + [0.0] * 7, 1), (1004, [], 1), (1005, [0.5] * 4, 1), (1006, [3e38] * 8, 1)]
    frame = spark.createDataFrame([(*r, "c", b"w", 1, 2) for r in rows + left_out], SCHEMA)
    want, books = plain(rows, entries, rounds)
    rows_got, books_got = got(frame.repartition(5), n_entries=entries, rounds=rounds)
    assert rows_got == want
    assert np.array_equal(books_got, books) and books_digest(books_got) == books_digest(books)


def test_few_vectors_odd_lengths_and_large_numbers(spark):
    rows = [(k, [0.25 * k, -1.5, 1000.0 * k, 0.0, 7.0 + k], None) for k in range(5)]
    want, books = plain(rows, 256, 4)
    one = got(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert one[0] == want and np.array_equal(one[1], books)
    assert got(spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0])], "k long, v array<float>"), id_col="k", vector_col="v", label_col=None)[0] == [("1", "00000000", 0, 0)]


def test_no_vectors(spark):
    for rows in ([], [(1, None, 1), (2, [], 1)]):
        coded, books = compress_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
        assert coded.collect() == [] and books.size == 0 and coded.columns == ["id", "code", "error", "label_error"]


def test_op11(spark, sf):
    assert compare(spark, oracle(sf), sf, "op11", QUERIES["op11_vector_codes"], ORACLES["op11_vector_codes"]) is None
