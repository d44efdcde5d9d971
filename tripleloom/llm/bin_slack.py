"""Packing by minimum bin slack: each window takes the multiset of remaining lengths that fills it best.

Texts become token pieces of at most `capacity`; how many pieces have each length is one small table, and windows are chosen over
these counts. A window holds the longest remaining length and the multiset of others whose sum comes closest to the room left,
found by a subset-sum bitset over the lengths, each as often as it is there, and traced back. A multiset that is best stays best
as long as its lengths last, so it is used for as many windows as they allow: the number of multisets depends on the capacity, not
on the corpus. Where even the best leaves slack, the windows are closed with a part cut off other pieces, whose rest goes back
among the lengths. What is left in the end is less than a window and fills sequences of powers of two, which need no padding.

Pieces are ranked within their length by the task that wrote them and their place in it, so a frequent length is numbered in as
many parts as there are tasks. Only pieces that the plan cuts have their ids read again.

Defined results: a null or empty text is the single end token. Repeated rows are packed each for itself; pieces of equal length are
interchangeable. An empty table gives no rows; a null id is kept as it is. Other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise
from .packing import tokenize

CAPACITY, END_ID = 4096, 2


def best_fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, each at most as often as counted, whose sum is the greatest that is at most `room`.

    `lengths` are sorted; larger ones are tried first, so the first best has few and large members.
    """
    mask = (1 << (room + 1)) - 1
    sums, layers = 1, []
    for i in range(bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[i]
        left, times = min(counts[length], room // length), 1
        while left and not sums >> room & 1:
            times = min(times, left)
            layers.append((length, times, sums))
            sums |= sums << (length * times) & mask
            left, times = left - times, times * 2
        if sums >> room & 1:
            break
    total, chosen = sums.bit_length() - 1, {}
    for length, times, before in reversed(layers):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + times
            total -= length * times
    return chosen


@dataclass
class Stock:
    """Pieces left to place by their length. Those of one length are runs of (full length, first rank, how many, start in it)."""

    lengths: list[int] = field(default_factory=list)
    counts: dict[int, int] = field(default_factory=dict)
    runs: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)

    def put(self, length: int, run: tuple[int, int, int, int]) -> None:
        if length not in self.counts:
            insort(self.lengths, length)
            self.counts[length], self.runs[length] = 0, []
        self.counts[length] += run[2]
        self.runs[length].append(run)

    def take(self, length: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """Runs of together n pieces."""
        self.counts[length] -= n
        own = self.runs[length]
        while n:
            full, rank, there, start = own.pop()
            used = min(n, there)
            if used < there:
                own.append((full, rank + used, there - used, start))
            n -= used
            yield full, rank, used, start
        if not own:
            del self.runs[length], self.counts[length], self.lengths[bisect_left(self.lengths, length)]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int, int]]:
    """Runs (full length, first rank, pieces, start in the piece, length placed, first sequence, offset)."""
    stock = Stock()
    for length, n in counts.items():
        stock.put(length, (length, 0, n, 0))
    out: list[tuple[int, int, int, int, int, int, int]] = []
    sequence = 0

    def place(taken: Iterator[tuple[int, int, int, int]], length: int, offset: int, cut_at: int = 0) -> None:
        at = sequence
        for full, rank, n, start in taken:
            out.append((full, rank, n, start, length, at, offset))
            at += n
            if cut_at:
                stock.put(cut_at - length, (full, rank, n, start + length))

    while stock.lengths:
        longest = stock.lengths[-1]
        stock.counts[longest] -= 1
        chosen = best_fill(stock.lengths, stock.counts, capacity - longest)
        stock.counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        slack = capacity - sum(length * n for length, n in chosen.items())
        times = min(stock.counts[length] // n for length, n in chosen.items())
        donor = 0
        if slack:
            # no piece left over fits, so every one is longer than the slack; the length that closes most windows gives
            donors = [(stock.counts[length] // (chosen.get(length, 0) + 1), length) for length in stock.lengths]
            given, donor = max(donors)
            if not given:
                break
            times = min(times, given)
        offset = 0
        for length in sorted(chosen, reverse=True):
            for _ in range(chosen[length]):
                place(stock.take(length, times), length, offset)
                offset += length
        if slack:
            place(list(stock.take(donor, times)), slack, offset, donor)
        sequence += times
    # less than a window is left
    rest = []
    for length in sorted(stock.counts, reverse=True):
        for full, rank, n, start in list(stock.take(length, stock.counts[length])):
            rest += [(length, full, rank + i, start) for i in range(n)]
    left = sum(r[0] for r in rest)
    size = offset = 0
    for length, full, rank, start in rest:
        while length:
            if offset == size:
                sequence += bool(size)
                size, offset = 1 << (left.bit_length() - 1), 0
            part = min(length, size - offset)
            out.append((full, rank, 1, start, part, sequence, offset))
            start, length, offset, left = start + part, length - part, offset + part, left - part
    return out


@dataclass
class Slots:
    """The plan as arrays: stretches of ranks of one length that are cut alike, each with its parts one behind the other."""

    keys: np.ndarray
    first: np.ndarray
    parts: np.ndarray

    @classmethod
    def of(cls, runs: list[tuple[int, int, int, int, int, int, int]]) -> Slots:
        by_length: dict[int, list[tuple]] = {}
        for run in runs:
            by_length.setdefault(run[0], []).append(run)
        keys, first, parts = [], [0], []
        for length in sorted(by_length):
            own = by_length[length]
            borders = sorted({r[1] for r in own} | {r[1] + r[2] for r in own})
            stretches: list[list[tuple]] = [[] for _ in borders[1:]]
            for _, rank, n, start, placed, sequence, offset in own:
                low, high = bisect_left(borders, rank), bisect_left(borders, rank + n)
                for i in range(low, high):
                    stretches[i].append((start, placed, sequence - rank, offset))
            for border, found in zip(borders, stretches):
                keys.append((length << 48) | border)
                parts += sorted(found)
                first.append(len(parts))
        return cls(np.array(keys, np.int64), np.array(first, np.int64), np.array(parts, np.int64).reshape(-1, 4))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each part of the pieces asked for: the piece's place in the question, and start, length, sequence, offset."""
        stretch = np.searchsorted(self.keys, (length << 48) | rank, side="right") - 1
        n = self.first[stretch + 1] - self.first[stretch]
        asked = np.repeat(np.arange(len(rank)), n)
        at = self.first[stretch][asked] + np.arange(len(asked)) - (np.cumsum(n) - n)[asked]
        parts = self.parts[at].copy()
        parts[:, 2] += rank[asked]
        return asked, parts


def written_pieces(docs: DataFrame, vocabulary: str, doc_id: str, text: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces with their ids and a place that no other row has; its high bits name the task that wrote them."""
    pieces = tokenize(docs, vocabulary, doc_id, text, capacity, end_id)
    return materialise(pieces.select("doc_id", "start", "length", "doc_tokens", F.crc32("ids").alias("ids_crc32"), F.monotonically_increasing_id().alias("place"), "ids"))


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(place, skip, size, sequence_id, offset) of each part of the pieces (place, length) with the other columns as they are."""
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    shared = pieces.sparkSession.sparkContext.broadcast(Slots.of(plan(counts, capacity)))  # as large as the capacity makes it
    keyed = pieces.withColumn("task", F.shiftright("place", 33))
    sizes = keyed.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("length", "task").orderBy("place"))
    ranked = keyed.join(sizes.select("length", "task", before.alias("before")), ["length", "task"]).withColumn("rank", inside - 1 + F.col("before"))
    names = pieces.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        for batch in batches:
            asked, parts = slots.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            kept = batch.select(names).take(pa.array(asked))
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(parts[:, i]) for i in range(4))], [*names, "skip", "size", "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*names, F.col("rank").cast("long").alias("rank")).mapInArrow(work, f"{fields}, skip long, size long, sequence_id long, offset long")


def with_ids(parts: DataFrame, pieces: DataFrame) -> DataFrame:
    """The parts with their own ids (little-endian unsigned 32-bit)."""
    own = F.substring("ids", (F.col("skip") * 4 + 1).cast("int"), (F.col("size") * 4).cast("int"))
    return parts.join(pieces.select("place", "ids"), "place").withColumn("ids", own)


def minimum_slack(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per part: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids if asked for."""
    pieces = written_pieces(docs, vocabulary, doc_id, text, capacity, end_id)
    parts = placed(pieces.drop("ids"), capacity)
    if keep_ids:
        whole = with_ids(parts, pieces).withColumn("ids_crc32", F.crc32("ids"))
    else:
        parts = materialise(parts)
        # written, so that its size is known before the ids would be dealt
        cut = with_ids(materialise(parts.where("size < length")), pieces).withColumn("ids_crc32", F.crc32("ids"))
        whole = parts.where("size = length").unionByName(cut.select(*parts.columns))
    extra = ["ids"] if keep_ids else []
    return whole.select("doc_id", (F.col("start") + F.col("skip")).alias("start"), F.col("size").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset", *extra)
