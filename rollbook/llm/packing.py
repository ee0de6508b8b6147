"""Best-fit packing of documents into token sequences of one size, by bin completion.

A sequence holds ``capacity`` tokens, so all that matters of a piece is its length, one of ``capacity`` numbers. Spark counts the
pieces of each length; the driver solves that table (never more than ``capacity`` rows, whatever the input) into fillings and how
often to use each; Spark then numbers the pieces of each length and looks up which filling's place the number has.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .bpe import encoded_groups
from .tasks import lean

#: Fillings that the search may try before it returns its best solution; a dominated one that is passed over counts as one of PASSED.
STEPS, PASSED = 20_000, 32
#: Fillings after the last better solution, or the first filling, at which a round ends.
IDLE = 8_000
#: Fillings of a node in each round: the greedy ones (0), the first few undominated ones, so that a round is not spent on the last
#: nodes alone, and all.
WIDTHS = (0, 6, None)

Fillings = list[tuple[int, list[int]]]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that no solution can do without: for each k, pieces over capacity - k and over half stand apart, the rest of k or more fills up."""
    sizes = np.arange(capacity + 1)
    below_n, below_s = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * sizes)])
    best = -(-int(below_s[-1]) // capacity)
    for k in range(capacity // 2 + 1):
        big, mid_from = int(below_n[-1] - below_n[capacity - k + 1]), capacity // 2 + 1
        mid_n, mid_s = int(below_n[capacity - k + 1] - below_n[min(mid_from, capacity - k + 1)]), int(below_s[capacity - k + 1] - below_s[min(mid_from, capacity - k + 1)])
        small_s = int(below_s[min(mid_from, capacity - k + 1)] - below_s[k]) if k < mid_from else 0
        best = max(best, big + mid_n + max(0, -(-(small_s - (mid_n * capacity - mid_s)) // capacity)))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> Fillings:
    """Best-fit decreasing over lengths: the longest pieces first, each where it leaves the least room."""
    room: list[list[tuple[int, list[int]]]] = [[] for _ in range(capacity + 1)]
    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        for r in range(size, capacity):
            while left and room[r]:
                n, filled = room[r].pop()
                take = min(n, left)
                fits = min(r // size, max(1, left // take))
                room[r - fits * size].append((take, filled + [size] * fits))
                if take < n:
                    room[r].append((n - take, filled))
                left -= take * fits
        if left:
            each = capacity // size
            if left // each:
                room[capacity - each * size].append((left // each, [size] * each))
            if left % each:
                room[capacity - left % each * size].append((1, [size] * (left % each)))
    return [x for r in room for x in r]


def greedy_completions(counts: np.ndarray, gap: int, width: int = 6) -> list[list[int]]:
    """For each of the longest pieces that fit a gap one filling that starts with it, those that another one dominates left out, the
    fullest first. A filling goes on from the longest piece that fits, and stops where the gap is met."""
    sizes = np.flatnonzero(counts[: gap + 1])[::-1].tolist()
    if not sizes:
        return [[]]
    if sizes[0] == gap:
        return [[gap]]
    found: list[list[int]] = []
    for first in sizes[:width]:
        chosen, left = [first], gap - first
        while left:
            if left != chosen[-1] and counts[left] > chosen.count(left):
                chosen.append(left)
                break
            fits = next((s for s in sizes if s <= left and counts[s] > chosen.count(s)), 0)
            if not fits:
                break
            # two pieces that meet the rest beat one that leaves some
            pair = next((a for a in sizes if a < left and counts[left - a] > chosen.count(left - a) + (2 * a == left) and counts[a] > chosen.count(a)), 0) if fits < left else 0
            chosen += [pair, left - pair] if pair else [fits]
            left = 0 if pair else left - fits
        found.append(chosen)
        if sum(chosen) == gap and len(found) >= 2:
            break
    found.sort(key=lambda x: (-sum(x), -x[0]))
    kept: list[list[int]] = []
    for x in found:
        if not any(len(y) <= len(x) and sum(y) >= sum(x) and all(a >= b for a, b in zip(sorted(y, reverse=True), sorted(x, reverse=True), strict=False)) for y in kept):
            kept.append(x)
    return kept


def completions(counts: np.ndarray, gap: int) -> Iterator[list[int] | None]:
    """All undominated fillings of a gap, one after another, the fullest first; and None for each dominated one that is passed over.

    A filling is dominated if a piece that it leaves fits in place of some of its pieces, or of none, that are not longer together.
    Fillings come from the sums that pieces up to each length can make, so no branch ends without one.
    """
    sizes = np.flatnonzero(counts[: gap + 1]).tolist()
    if not sizes or sizes[-1] == gap:  # a piece as long as the gap dominates all others
        yield sizes[-1:]
        return
    have = [min(int(counts[s]), gap // s) for s in sizes]
    every, reach = sum(1 << s for s in sizes), [1]
    for s, n in zip(sizes, have, strict=True):
        sums, take = reach[-1], 1
        while n:
            take = min(take, n)
            sums |= sums << s * take
            n, take = n - take, 2 * take
        reach.append(sums & (2 << gap) - 1)

    def filled(room: int, k: int) -> Iterator[list[int]]:
        if not room:
            yield []
            return
        for i in range(bisect_right(sizes, room, 0, k) - 1, -1, -1):
            if not reach[i + 1] >> room & 1:
                return
            for n in range(min(have[i], room // sizes[i]), 0, -1):
                if reach[i] >> room - n * sizes[i] & 1:
                    for rest in filled(room - n * sizes[i], i):
                        yield [sizes[i]] * n + rest

    def up_to(sums: int, more: int) -> int:
        done = 0
        while done < more:
            step = min(done + 1, more - done)
            sums, done = sums | sums << step, done + step
        return sums

    for total in range(gap, -1, -1):
        if reach[-1] >> total & 1:
            for filling in filled(total, len(sizes)):
                left, one, two = every, 0, 0  # lengths left over; sums of one and of more of the pieces
                for s in filling:
                    two |= (one | two) << s
                    one |= 1 << s
                for s in set(filling):
                    if counts[s] <= filling.count(s):
                        left ^= 1 << s
                better = up_to(two, gap - total) | (up_to((one | 1) << 1, gap - total - 1) if total < gap else 0)
                yield None if left & better else filling


def bin_completion(counts: np.ndarray, capacity: int, steps: int = STEPS, idle: int = IDLE) -> Fillings:
    """Few fillings' uses that hold all pieces: branch and bound around the longest piece left, best-fit solutions as incumbents.

    A node fills sequences around the longest piece with each undominated filling, with as many at once as the counts allow or with
    one. Rounds over a few fillings of each node come first, the last one is over all. The waste so far may not exceed what a better solution than the incumbent may waste. The search ends at the lower bound,
    when all is searched, or each round after ``steps`` fillings or ``idle`` ones without a better solution; then the result may be more than the fewest.
    """
    counts = np.asarray(counts, np.int64)
    bound, best = lower_bound(counts, capacity), best_fit(counts, capacity)
    fewest, total = sum(n for n, _ in best), int((counts * np.arange(capacity + 1)).sum())

    def branches(left: np.ndarray, width: int | None) -> Iterator[tuple[int, list[int]] | None]:
        found, passed = 0, 0
        longest = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[longest] -= 1
        for filling in greedy_completions(rest, capacity - longest) if width == 0 else completions(rest, capacity - longest):
            if width and (found == width or passed == PASSED * width):
                return
            if filling is None:
                passed += 1
                yield None
                continue
            found += 1
            items = [longest, *filling]
            sizes, uses = np.unique(items, return_counts=True)
            n = int((left[sizes] // uses).min())
            yield n, items
            if n > 1 and width != 0:
                yield 1, items

    for width in WIDTHS:
        budget, patience = PASSED * steps, PASSED * idle
        stack, tried = [(counts, [], 0, 0, branches(counts, width))] if fewest > bound else [], 0
        while stack and min(budget, patience) > 0 and fewest > bound:
            left, done, used, waste, more = stack[-1]
            branch = next(more, stack)
            if branch is stack:
                stack.pop()
                continue
            cost = 1 if branch is None else PASSED
            budget, patience = budget - cost, patience - cost
            if branch is None:
                continue
            n, items = branch
            spare = (fewest - 1) * capacity - total - waste
            if capacity - sum(items) > spare:  # those that follow are no fuller
                stack.pop()
                continue
            if n * (capacity - sum(items)) > spare:
                continue
            after = left.copy()
            np.subtract.at(after, items, n)
            done, used, waste, tried = [*done, (n, items)], used + n, waste + n * (capacity - sum(items)), tried + 1
            tail = best_fit(after, capacity) if tried % 64 == 0 else [] if not after.any() else None
            if tail is not None and used + sum(n for n, _ in tail) < fewest:
                best, fewest, patience = done + tail, used + sum(n for n, _ in tail), PASSED * idle
            if after.any():
                stack.append((after, done, used, waste, branches(after, width)))
    return best


def _places(fillings: Fillings, capacity: int) -> tuple[np.ndarray, ...]:
    """For each length, runs of numbers: a key that sorts by length and first number, the sequence of the first one, and the place in it."""
    seen, base, out = [0] * (capacity + 1), 0, []
    for n, items in fillings:
        at = 0
        for size in items:
            out.append((size, seen[size], base, at))
            seen[size] += n
            at += size
        base += n
    table = np.array(sorted(out), np.int64).reshape(-1, 4)
    return (table[:, 0] << 44) + table[:, 1], table[:, 1], table[:, 2], table[:, 3]


def pieces(df: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut each document's ids, with end_id after them, into pieces: ``id, piece, start, length, ids_crc32``; and the task and the
    piece's number among those of its length in that task."""

    def cut(batches):
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for part, ids, counts in encoded_groups(batches, "text", path):
            raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts)
            end = int(end_id).to_bytes(4, "little")
            docs, numbers, starts, lengths, sums = [], [], [], [], []
            for i, (stop, n) in enumerate(zip(ends.tolist(), (counts + 1).tolist(), strict=True)):
                own = raw[4 * (stop - n + 1) : 4 * stop] + end
                edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    docs.append(i)
                    numbers.append(k)
                    starts.append(a)
                    lengths.append(b - a)
                    sums.append(zlib.crc32(own[4 * a : 4 * b]))
            size = np.array(lengths, np.int64)
            order = np.argsort(size, kind="stable")
            nth, of = np.empty(len(size), np.int64), size[order]
            nth[order] = np.arange(len(of)) - np.searchsorted(of, of, "left") + seen[of]
            seen += np.bincount(size, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(docs, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                 pa.array(sums, pa.int64()), pa.array(np.full(len(size), task), pa.int32()), pa.array(nth)],
                ["id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long"
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(lean(cut), schema)


def pack(
    df: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", steps: int = STEPS, idle: int = IDLE
) -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` tokens as the search finds.

    Returns a row for each piece: ``id, piece, start, length, ids_crc32, sequence_id, offset``. A document is the ids of its text
    and end_id; only one longer than capacity is cut, its first piece taking what is over. A null or empty text is end_id alone;
    rows with equal or null ids are packed each for itself; other columns are not read; an empty table gives no rows. Pieces are
    a table in the shared folder, so a repeated task changes no number. The driver holds the counts of at most ``capacity`` lengths and
    searches as long as ``steps`` and ``idle`` let it (see :func:`bin_completion`). Texts may be of any length.
    """
    cut = staged(pieces(df, path, capacity, end_id, id_col, text_col), "pieces")
    by_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row for each length
        counts[row["length"]] = row["n"]
    keys, firsts, sequences, offsets = _places(bin_completion(counts, capacity, steps, idle), capacity)

    def place(batches):
        for b in batches:
            size, number = b.column("length").to_numpy(), b.column("number").to_numpy()
            at = np.searchsorted(keys, (size << 44) + number, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(sequences[at] + number - firsts[at]), pa.array(offsets[at])], [*b.schema.names[:-1], "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = by_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = cut.join(by_task, ["task", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("number"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema.fields[:-1]) + ", sequence_id long, offset long"
    return numbered.mapInArrow(lean(place), schema)
