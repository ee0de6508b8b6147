"""Exact removal of repeated byte strings by a sparse suffix array.

A string of ``length`` bytes that starts at two places is found without sorting all suffixes. Each such string takes as its anchor
the start of the 16 bytes of lowest hash among its first ones, so equal strings have equal anchors, and on average one place in 77
is an anchor. The steps:

1. A suffix is given by its anchor. It can only matter if its first 48 bytes start at another anchor too; this is settled by hash.
2. The suffixes that remain, each with the bytes of all strings around its anchor, are range-partitioned by their leading bytes:
   splitters come from a sample of documents. Equal leading bytes stay together.
3. Each bucket sorts its suffixes by multikey quicksort, eight bytes at a time, going on only inside ties; strings are compared inside
   the runs that agree in all 48 bytes.
4. Leading bytes that very many documents share (as the sample shows) would make one bucket as large as a share of the input. Their
   strings are told apart one by one and compared across buckets by 128-bit hashes, each once for a group of documents.
5. Places of repeated strings go back to their texts, where they are joined to runs and removed.

Copies of a text are counted once from the start; a text with copies is repeated as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .near import _fields
from .shingles import mix, seeded
from .tasks import lean
from .words import ragged, text_groups

LENGTH = 200
KMER, LEAD = 16, 48
#: Bytes of a text that are looked at together; longer texts are cut into parts that overlap.
PART = 1 << 17
_PLACE = np.uint64((1 << 23) - 1)
#: Documents in the sample for splitters and frequent leads, about; leads in so large a share of them count as frequent.
SAMPLE, FREQUENT = 2000, 0.01
#: Leads that splitters are taken from, at most about.
LEADS = 20_000
#: A lead of so few sampled documents is never frequent.
FEW = 8
#: Leads and strings that a task remembers as repeated, at most.
MET = 1 << 17
#: Strings compared at once in a bucket.
STRINGS = 100_000


def _pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """Hash of two neighbours from theirs."""
    with np.errstate(over="ignore"):
        out = a * np.uint64(0xBF58476D1CE4E5B9 + 2 * salt)
        out += (b << np.uint64(23)) | (b >> np.uint64(41))
        out ^= out >> np.uint64(29)
        out *= np.uint64(0x94D049BB133111EB)
    return out


def rolling(raw: np.ndarray, to: int, salt: int = 0) -> dict[int, np.ndarray]:
    """Hashes of all runs of 1, 2, 4 ... to bytes."""
    table = mix(np.arange(256, dtype=np.uint64) ^ seeded(21 + salt))
    out, n = {1: table[raw]}, 1
    while n < to:
        h = out[n]
        out[2 * n] = _pair(h[:-n], h[n:], salt) if len(h) > n else h[:0]
        n *= 2
    return out


def of_length(hashes: dict[int, np.ndarray], at: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Hash of the run of any length at each place, from those of powers of two."""
    out, done = None, 0
    for n in sorted(hashes, reverse=True):
        while length - done >= n:
            part = hashes[n][at + done]
            out = part if out is None else _pair(out, part, salt)
            done += n
    return out


def parts_of(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, and of the parts of texts that hold a string: text, place in the bytes, length. A part holds PART starts of strings."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes) - sizes
    n_parts = np.where(sizes >= length, -(-(sizes - length + 1) // PART), 0)
    text = np.repeat(np.arange(len(texts)), n_parts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
    offset = nth * PART
    size = np.minimum(PART + length - 1, sizes[text] - offset)
    return np.frombuffer(b"".join(texts), np.uint8), text, begins[text] + offset, size


def anchors(texts: list[bytes], length: int = LENGTH):
    """For each group of parts: the bytes, their hashes, and of every anchor: text, place in the text, first and last start of the
    strings around it, and what to add to a place in the text to get that in the bytes."""
    whole, text, at, size = parts_of(texts, length)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes) - sizes
    window = length - LEAD + 1
    first = 0
    while first < len(text):
        last = first + max(1, int(np.searchsorted(np.cumsum(size[first:]), 2 * PART, "right")))
        lo, hi = int(at[first]), int(at[last - 1] + size[last - 1])
        raw = whole[lo:hi]
        hashes = rolling(raw, 32)
        key = mix(hashes[KMER])
        key = (key & ~_PLACE) | (_PLACE - np.arange(len(key), dtype=np.uint64))  # of equal ones, the last
        low, n = key, 1
        while 2 * n <= window:
            low = np.minimum(low[:-n], low[n:])
            n *= 2
        low = np.minimum(low[: len(low) - (window - n)], low[window - n :])
        own = slice(first, last)
        n_starts = size[own] - length + 1
        start = ragged(at[own] - lo, n_starts)
        place = (_PLACE - (low[start] & _PLACE)).astype(np.int64)
        of = np.repeat(text[own], n_starts)
        fresh = np.ones(len(start), bool)
        fresh[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
        heads = np.flatnonzero(fresh)
        tails = np.append(heads[1:], len(start)) - 1
        doc = of[heads]
        shift = begins[doc] - lo
        yield raw, hashes, doc, place[heads] - shift, start[heads] - shift, start[tails] - shift, shift
        first = last


def _lead_hash(hashes: dict[int, np.ndarray], place: np.ndarray) -> np.ndarray:
    return _pair(hashes[32][place], hashes[16][place + 32], 5).view(np.int64)


def _distinct_texts(df: DataFrame) -> DataFrame:
    return df.groupBy("k1", "k2").agg(F.first("text").alias("text"))


def _rows(df: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(text.alias("text")).withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(7), F.col("text")))


def _group_texts(batches):
    """Groups of texts with their keys; of copies in a group only the first."""
    for part, texts in text_groups(batches, "text", 8 * PART):
        k1, k2 = (part.column(part.schema.get_field_index(c)).to_numpy() for c in ("k1", "k2"))
        _, index = np.unique(np.stack([k1, k2], 1), axis=0, return_index=True)
        index.sort()
        yield [texts[i].encode("utf-8") for i in index.tolist()], k1[index], k2[index], part, index


def _lead_bytes(raw: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The leading bytes of suffixes, as strings of fixed size."""
    return raw[place[:, None] + np.arange(LEAD)].copy().view(f"S{LEAD}").ravel()


def sampled(rows: DataFrame, length: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Splitters of the leading bytes, and hashes of leads that many documents share. Both only decide where rows go."""

    def show(batches):
        for texts, _, _, _, _ in _group_texts(batches):
            for raw, hashes, doc, place, _, _, shift in anchors(texts, length):
                lead = _lead_hash(hashes, place + shift)
                _, one = np.unique(np.stack([doc, lead], 1), axis=0, return_index=True)
                leads = _lead_bytes(raw, (place + shift)[one])
                yield pa.RecordBatch.from_arrays([pa.array(lead[one]), pa.array([x[:24] for x in leads.tolist()], pa.binary())], ["lead", "bytes"])

    total = max(rows.count(), 1)
    every = 1 << 40
    few = rows.where(F.pmod(F.col("k1"), F.lit(every)) < int(min(1.0, SAMPLE / total) * every)).distinct()
    got = staged(few.mapInArrow(lean(show), "lead long, bytes binary"), "leads")  # of texts of any length, so counted before any are collected
    often = got.groupBy("lead").count().where(F.col("count") > max(FEW, FREQUENT * min(SAMPLE, total))).select("lead")
    share = min(0.25, LEADS / max(got.count(), 1))
    leads = np.sort(np.array([bytes(r["bytes"]) for r in got.select("bytes").where(F.rand(3) < share).collect()] or [b""], "S24"))
    at = (np.arange(1, buckets) * len(leads) // buckets).astype(int)
    return np.unique(leads[at]), np.sort(np.array([r["lead"] for r in often.collect()], np.int64))


class _Met:
    """Hashes that a task knows to repeat: a bounded number, of which those met again and again stay or come back."""

    def __init__(self, most: int = MET):
        self.most, self.values, self.rng = most, np.zeros(0, np.int64), np.random.default_rng(1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.values):
            return np.zeros(len(hashes), bool)
        return self.values[np.minimum(np.searchsorted(self.values, hashes), len(self.values) - 1)] == hashes

    def add(self, hashes: np.ndarray) -> None:
        new = hashes[~self.has(hashes)]
        if len(new):
            self.values = np.union1d(self.values, new)
            if len(self.values) > self.most:
                self.values = np.sort(self.rng.choice(self.values, self.most // 2, replace=False))


def _needed(rows: DataFrame, length: int) -> DataFrame:
    """``k1, k2, places``: the anchors of each text whose leads are at two anchors at least.

    In a group of texts, a lead that is there twice is known to repeat; one of its rows goes on to tell the other groups, and the
    rest is dealt out evenly. A task remembers such leads and tells of them no more. So to where it is counted a lead sends a row for each
    group of texts until a group has it twice, and a frequent one some rows for each task.
    """

    def tell(batches):
        met = _Met()
        for texts, k1, k2, _, _ in _group_texts(batches):
            for _, hashes, doc, place, _, _, shift in anchors(texts, length):
                lead = _lead_hash(hashes, place + shift)
                fresh = np.ones(len(place), bool)  # an anchor at the border of two parts is there twice
                fresh[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
                lead, doc, place = lead[fresh], doc[fresh], place[fresh]
                _, index, number, counts = np.unique(lead, return_index=True, return_inverse=True, return_counts=True)
                old = met.has(lead)
                known = (counts[number] > 1) | old
                witness = np.zeros(len(lead), bool)
                witness[index] = True
                witness &= ~old
                met.add(lead[index][counts > 1])
                to = np.where(known & ~witness, mix((place * 31 + doc).astype(np.uint64) ^ lead.view(np.uint64)).view(np.int64), lead)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (to, lead, k1[doc], k2[doc], place, known, witness)], ["to", "lead", "k1", "k2", "place", "known", "witness"])

    def settle(batches):
        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        lead, k1, k2, place, known, witness = (c.to_numpy() for c in _fields(batches, ["lead", "k1", "k2", "place", "known", "witness"]))
        told = np.flatnonzero(witness)
        order = told[np.lexsort((place[told], k2[told], k1[told], lead[told]))]
        same = np.zeros(len(order), bool)  # the same anchor from two groups, by copies of its text
        same[1:] = (lead[order[1:]] == lead[order[:-1]]) & (k1[order[1:]] == k1[order[:-1]]) & (k2[order[1:]] == k2[order[:-1]]) & (place[order[1:]] == place[order[:-1]])
        order = order[~same]
        head = np.ones(len(order), bool)
        head[1:] = lead[order[1:]] != lead[order[:-1]]
        heads = np.flatnonzero(head)
        several = np.repeat(np.diff(np.append(heads, len(order))) > 1, np.diff(np.append(heads, len(order))))
        keep = known.copy()
        keep[order[several]] = True
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (k1, k2, place)], ["k1", "k2", "place"])

    told = rows.mapInArrow(lean(tell), "to long, lead long, k1 long, k2 long, place long, known boolean, witness boolean")
    found = told.repartition("to").mapInArrow(lean(settle), "k1 long, k2 long, place long")
    return found.groupBy("k1", "k2").agg(F.collect_set("place").alias("places"))  # of one text


def _runs(first: np.ndarray, last: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring ranges of one text, in order, as one: text, first, last."""
    head = np.ones(len(first), bool)
    head[1:] = (first[1:] != last[:-1] + 1) | (of[1:] != of[:-1])
    heads = np.flatnonzero(head)
    return of[heads], first[heads], last[np.append(heads[1:], len(first)) - 1] if len(first) else last


def _twice(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is there several times, and whether it is the first of its like."""
    _, index, number, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    first = np.zeros(len(key), bool)
    first[index] = True
    return counts[number] > 1, first


def _send(batches, length: int, splitters: np.ndarray, frequent: np.ndarray):
    """Rows for buckets: a suffix with the bytes of the strings around its anchor; or, around frequent leads, strings by their hashes.

    What is in a group of texts several times is known to repeat: its places go straight on as spans, dealt out evenly, and one row
    of it goes to its bucket for the other groups; a task remembers such strings and sends no more of them.
    """
    met = _Met()
    names = ["bucket", "k1", "k2", "start", "back", "bytes", "one", "two", "known"]

    def batch(bucket, k1, k2, start, back, raws=None, one=None, two=None, known=False):
        n, none = len(bucket), np.zeros(len(bucket), np.int64)
        cols = [bucket, k1, k2, start, back, pa.array(raws or [None] * n, pa.binary()), none if one is None else one, none if two is None else two, np.full(n, known)]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names)

    for texts, k1, k2, part, index in _group_texts(batches):
        lists = [np.asarray(x, np.int64) for x in part.column(part.schema.get_field_index("places")).take(pa.array(index)).to_pylist()]
        pick = np.sort(np.concatenate([(np.int64(i) << 40) + x for i, x in enumerate(lists)])) if lists else np.zeros(0, np.int64)
        for raw, hashes, doc, place, start, stop, shift in anchors(texts, length):
            key = (doc << 40) + place
            mine = pick[np.minimum(np.searchsorted(pick, key), len(pick) - 1)] == key if len(pick) else np.zeros(len(key), bool)
            doc, place, start, stop, shift = (x[mine] for x in (doc, place, start, stop, shift))
            lead = _lead_hash(hashes, place + shift)
            much = np.isin(lead, frequent)
            for n in (64, 128):
                h = hashes[n // 2]
                hashes[n] = _pair(h[: -n // 2], h[n // 2 :], 0) if len(h) > n // 2 else h[:0]
            # a suffix's bytes are given by the strings at both ends, which overlap
            ends = mix(of_length(hashes, start + shift, length)) ^ of_length(hashes, stop + shift, length) ^ mix((stop - start).astype(np.uint64))
            known, first = _twice(ends)
            told_doc, told_first, told_last = _runs(start[known], stop[known], doc[known])
            send = np.flatnonzero(first & ~much)
            if len(send):
                data, begin = raw.tobytes(), (start + shift)[send]
                raws = [data[x : y + length] for x, y in zip(begin.tolist(), (stop + shift)[send].tolist(), strict=True)]
                bucket = np.searchsorted(splitters, _lead_bytes(raw, (place + shift)[send]).astype("S24"), "right")
                yield batch(bucket.astype(np.int64), k1[doc[send]], k2[doc[send]], start[send], (place - start)[send], raws)
            some = first & much
            if some.any():
                counts = (stop - start + 1)[some]
                at = ragged(start[some], counts)
                of, by = np.repeat(doc[some], counts), np.repeat(shift[some], counts)
                one, two = of_length(hashes, at + by, length), of_length(rolling(raw, 128, 1), at + by, length, 1)
                again, witness = _twice(one)
                own, old = one.view(np.int64), met.has(one.view(np.int64))
                met.add(own[again & witness])
                again, witness = again | old, witness & ~old
                x = _runs(at[again], at[again], of[again])
                told_doc, told_first, told_last = (np.concatenate(y) for y in zip((told_doc, told_first, told_last), x, strict=True))
                w = np.flatnonzero(witness)
                yield batch(one[w].view(np.int64), k1[of[w]], k2[of[w]], at[w], np.zeros(len(w), np.int64), None, one[w].view(np.int64), two[w].view(np.int64))
            if len(told_doc):
                to = mix((told_first * 31 + told_doc * 7919).astype(np.uint64)).view(np.int64)
                yield batch(to, k1[told_doc], k2[told_doc], told_first, told_last - told_first + 1, known=True)


def multikey_sort(raw: np.ndarray, starts: np.ndarray, depth: int = LEAD) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at starts by their first ``depth`` bytes, and the run of equal ones that each belongs to.

    Sorts by eight bytes, then goes on by the next eight inside the runs that are still equal, and so on.
    """
    order = np.arange(len(starts))
    run = np.zeros(len(starts), np.int64)
    open_ = np.ones(len(starts), bool)
    for d in range(0, depth, 8):
        rows = np.flatnonzero(open_)
        if not len(rows):
            break
        at = starts[order[rows]] + d
        word = np.zeros(len(rows), np.uint64)
        for k in range(8):
            word = (word << np.uint64(8)) | raw[at + k].astype(np.uint64)
        by = np.lexsort((word, run[rows]))
        order[rows], word = order[rows][by], word[by]
        change = np.zeros(len(order), bool)
        change[0] = True
        change[1:] = run[1:] != run[:-1]
        inner = np.zeros(len(order), bool)
        inner[rows[1:]] = (word[1:] != word[:-1]) & (rows[1:] == rows[:-1] + 1)
        run = np.cumsum(change | inner) - 1
        sizes = np.bincount(run)
        open_ = sizes[run] > 1
    return order, run


def _compare(batches, length: int):
    """Places of repeated strings among a bucket's rows: ``k1, k2, start, stop``, the bytes from start to before stop."""

    def spans(k1, k2, start, stop):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (k1, k2, start, stop)], ["k1", "k2", "start", "stop"])

    batches = list(batches)
    if not sum(b.num_rows for b in batches):
        return
    table = pa.Table.from_batches(batches)
    k1, k2, start, back, one, two, known = (table.column(c).to_numpy() for c in ("k1", "k2", "start", "back", "one", "two", "known"))
    if known.any():
        yield spans(k1[known], k2[known], start[known], start[known] + back[known] + length - 1)
    with_bytes = table.column("bytes").is_valid().to_numpy()
    single = np.flatnonzero(~with_bytes & ~known)
    if len(single):
        order = single[np.lexsort((k2[single], k1[single], start[single], two[single], one[single]))]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
        heads = np.flatnonzero(fresh)
        sizes = np.diff(np.append(heads, len(order)))
        order = order[np.repeat(sizes > 1, sizes)]
        yield spans(k1[order], k2[order], start[order], start[order] + length)
    rows = np.flatnonzero(with_bytes)
    if not len(rows):
        return
    column = table.column("bytes").take(pa.array(rows)).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(rows) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8)
    order, run = multikey_sort(raw, ends[:-1] + back[rows])
    alone = np.bincount(run)[run] == 1
    order, run = order[~alone], run[~alone]
    n_strings = (ends[1:] - ends[:-1] - length + 1)[order]
    done = 0
    while done < len(order):
        to = done + max(1, int(np.searchsorted(np.cumsum(n_strings[done:]), STRINGS, "right")))
        to = int(np.searchsorted(run, run[to - 1], "right"))  # whole runs
        own, counts = order[done:to], n_strings[done:to]
        sizes = counts + length - 1
        data = raw[ragged(ends[:-1][own], sizes)]
        begins = np.cumsum(sizes) - sizes
        at = ragged(begins, counts)
        first = of_length(rolling(data, 128), at, length)
        second = of_length(rolling(data, 128, 1), at, length, 1)
        by = np.lexsort((second, first))
        equal = np.zeros(len(by) + 1, bool)
        equal[1:-1] = (first[by[1:]] == first[by[:-1]]) & (second[by[1:]] == second[by[:-1]])
        hit = np.zeros(len(by), bool)
        hit[by] = equal[1:] | equal[:-1]
        member = np.repeat(np.arange(len(own)), counts)
        head = hit.copy()
        head[1:] &= ~(hit[:-1] & (member[1:] == member[:-1]))
        heads = np.flatnonzero(head)
        if len(heads):
            size = np.bincount(np.cumsum(head)[hit], minlength=len(heads) + 1)[1:]
            m = member[heads]
            r = rows[own[m]]
            begin = start[r] + at[heads] - begins[m]
            yield spans(k1[r], k2[r], begin, begin + size + length - 1)
        done = to


def repeated_places(df: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``k1, k2, start, stop``: for the distinct texts, by the two hashes of a text, bytes of strings that start at two places.

    Places overlap; a text's copies don't count here. Texts shorter than ``length`` bytes have none.
    """
    rows = _rows(df, text_col)
    spark = df.sparkSession
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    splitters, frequent = sampled(rows, length, buckets)
    needed = _needed(rows, length)
    texts = _distinct_texts(rows).join(needed, ["k1", "k2"]).select("k1", "k2", "text", "places")
    schema = "bucket long, k1 long, k2 long, start long, back long, bytes binary, one long, two long, known boolean"
    sent = texts.mapInArrow(lean(lambda b: _send(b, length, splitters, frequent)), schema)
    return sent.repartition("bucket").mapInArrow(lean(lambda b: _compare(b, length)), "k1 long, k2 long, start long, stop long")


def _trimmed(raw: bytes, start: int, stop: int) -> bytes:
    """Bytes start to stop of a text without those of characters that begin before or end after them."""
    while start < stop and raw[start] & 0xC0 == 0x80:
        start += 1
    end = stop
    if stop < len(raw) and raw[stop] & 0xC0 == 0x80:
        end -= 1
        while end > start and raw[end] & 0xC0 == 0x80:
            end -= 1
    return raw[start : max(start, end)]


def removals(df: DataFrame, text_col: str = "text", length: int = LENGTH, characters: bool = False) -> DataFrame:
    """For each distinct text with repeated strings: ``k1, k2, starts, stops`` (maximal runs of bytes) and ``kept``, the other bytes; with
    ``characters``, without what is left of characters that lose some of their bytes."""
    keep = _trimmed if characters else lambda raw, a, z: raw[a:z]
    spans = repeated_places(df, text_col, length).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))  # of one text
    texts = _distinct_texts(_rows(df, text_col)).join(spans, ["k1", "k2"]).select("k1", "k2", "text", "spans")

    def cut(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                starts, stops, kept = [], [], []
                for text, own in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    raw, runs = text.encode("utf-8"), []
                    for x in sorted((s["start"], s["stop"]) for s in own):
                        if runs and x[0] <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], x[1])
                        else:
                            runs.append(list(x))
                    edges = [0, *[e for r in runs for e in r], len(raw)]
                    starts.append([r[0] for r in runs])
                    stops.append([r[1] for r in runs])
                    kept.append(b"".join(keep(raw, a, z) for a, z in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(starts, pa.list_(pa.int64())), pa.array(stops, pa.list_(pa.int64())), pa.array(kept, pa.binary())],
                    ["k1", "k2", "starts", "stops", "kept"])

    return texts.mapInArrow(lean(cut), "k1 long, k2 long, starts array<long>, stops array<long>, kept binary")


def remove_repeats(df: DataFrame, text_col: str = "text", length: int = LENGTH, characters: bool = False) -> DataFrame:
    """Rows of df with what their text keeps: ``n_bytes, n_removed, n_spans`` (long) and ``kept`` (binary) in place of the text.

    Removed is each byte that a string of ``length`` bytes covers which starts at another place too, in the same text or another
    row's, copies included; strings are judged on the input. n_spans counts the maximal removed runs. One row for each row of df,
    with its other columns, which may have any names but those of the results. A null text counts as an empty one, which keeps
    nothing of nothing; texts shorter than length bytes stay whole. With ``characters``, a character that loses some of its bytes goes whole,
    so that what is kept is a text again.
    """
    return _with(df, removals(df, text_col, length, characters).select("k1", "k2", F.size("starts").cast("long").alias("_n"), "kept"), text_col, length, lambda text: F.encode(text, "utf-8"), F.lit(b""))


def removal_digests(df: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """As :func:`remove_repeats`, but ``kept_sha256`` (lower-case hex) in place of ``kept``, so that no text is shuffled to its rows."""
    found = removals(df, text_col, length)
    found = found.select("k1", "k2", F.size("starts").cast("long").alias("_n"), F.octet_length("kept").cast("long").alias("_left"), F.sha2("kept", 256).alias("kept_sha256"))
    return _with(df, found, text_col, length, lambda text: F.sha2(text, 256), F.sha2(F.lit(b""), 256))


def _with(df: DataFrame, found: DataFrame, text_col: str, length: int, whole, empty: Column) -> DataFrame:
    """Each row's result: that of its text, nothing where the text has copies, or the whole text."""
    name = found.columns[-1]
    text = F.coalesce(df[text_col], F.lit(""))
    others = [c for c in df.columns if c != text_col]
    safe = [f"_c{k}" for k in range(len(others))]
    rows = df.select(
        *[df[c].alias(n) for c, n in zip(others, safe, strict=True)], F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(7), text).alias("_k2"),
        F.octet_length(text).cast("long").alias("_bytes"), whole(text).alias("_whole"))
    keys = df.select(F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(7), text).alias("_k2"), F.octet_length(text).alias("n")).where(F.col("n") >= length)
    copied = staged(keys.groupBy("_k1", "_k2").agg(F.count("*").alias("_copies")).where("_copies > 1"), "copied")  # joined as a plain table: a text may have very many copies
    if "_left" not in found.columns:
        found = found.withColumn("_left", F.octet_length(name).cast("long"))
    found = found.withColumnsRenamed({"k1": "_k1", "k2": "_k2", name: "_value"})
    out = rows.join(copied, ["_k1", "_k2"], "left").join(found, ["_k1", "_k2"], "left")
    gone = F.col("_copies").isNotNull()
    return out.select(
        *[F.col(n).alias(c) for c, n in zip(others, safe, strict=True)], F.col("_bytes").alias("n_bytes"),
        F.when(gone, F.col("_bytes")).otherwise(F.col("_bytes") - F.coalesce("_left", "_bytes")).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("_n", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(gone, empty).otherwise(F.coalesce("_value", "_whole")).alias(name))
