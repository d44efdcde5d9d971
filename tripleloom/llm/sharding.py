"""Minimax contiguous partition of documents into shards, with DataFrame operations only.

Atomic groups (equal texts) stand in the order of their text's hash. The smallest capacity for which a greedy walk needs
no more than the wanted number of shards is found by binary search, and the shards are cut there. Law: `bytes`.

The walk does not read all groups. Running sums of all groups are one narrow table; the driver holds a bounded list of
known group ends. Between two known ends the walk's position is an interval, so a capacity is surely feasible, surely
not, or open. Only the stretches that open capacities can cut in are then listed more finely, until none is open. Each
pass adds about `points` ends, whatever the number of groups.

Defined results: a null text has no bytes and counts as empty; both share one group. Repeated rows are members of their
group like others, a null id included. An empty table gives no rows. Ties need no rule: groups have distinct places. A
group larger than an even share fills a shard alone, and shards at the end may stay empty. Other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, row_number_salted

OVERHEAD = 16
BUCKET_BITS = 12


class Ends:
    """Known ends of groups: places in the running sum, and which group (counted from 1) ends there."""

    def __init__(self, known: dict[int, int]):
        self.numbers, self.ends = zip(*sorted(known.items()))

    def fine(self, i: int) -> bool:
        """No group ends between this known end and the one before."""
        return self.numbers[i] - (self.numbers[i - 1] if i else 0) == 1

    def step(self, low: int, high: int, capacity: int) -> tuple[int, int]:
        """Least and greatest place where a shard can end that begins between low and high."""
        i = bisect_right(self.ends, low + capacity) - 1
        j = bisect_right(self.ends, high + capacity) - 1
        least = self.ends[i] if i >= 0 else 0
        greatest = self.ends[j] if j + 1 >= len(self.ends) or self.fine(j + 1) else min(high + capacity, self.ends[j + 1])
        return max(least, low), max(greatest, least, low)

    def walk(self, capacity: int, shards: int) -> list[tuple[int, int]]:
        out, low, high = [], 0, 0
        for _ in range(shards):
            low, high = self.step(low, high, capacity)
            out.append((low, high))
        return out

    def search(self, shards: int, least: int) -> tuple[int, int]:
        """Greatest capacity known to be too small, and smallest known to do."""
        total = self.ends[-1]

        def first(which: int) -> int:
            a, b = least - 1, total
            while b - a > 1:
                c = (a + b) // 2
                a, b = (a, c) if self.walk(c, shards)[-1][which] >= total else (c, b)
            return b

        return first(1) - 1, first(0)


def placed_groups(base: DataFrame) -> DataFrame:
    """Group table with running sums of bytes (`stop`) and of rows (`first_row`: rows before the group)."""
    groups = base.groupBy("group").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    # a digest is spread evenly, so buckets by its leading bits have even numbers of groups
    groups = groups.withColumn("bucket", F.conv(F.substring("group", 1, BUCKET_BITS // 4), 16, 10).cast("int"))
    measures = {"bytes": F.col("size"), "rows": F.col("n"), "groups": F.lit(1)}
    sums = groups.groupBy("bucket").agg(*[F.sum(c).alias(name) for name, c in measures.items()])
    # at most 2^BUCKET_BITS rows
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("bucket", *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"{name}0") for name in measures])
    inside = Window.partitionBy("bucket").orderBy("group").rowsBetween(Window.unboundedPreceding, 0)
    up_to = {name: F.col(f"{name}0") + F.sum(c).over(inside) for name, c in measures.items()}
    return groups.join(F.broadcast(offsets), "bucket").select(
        "group", "size", up_to["bytes"].alias("stop"), up_to["groups"].alias("number"), (up_to["rows"] - F.col("n")).alias("first_row")
    )


def finer(groups: DataFrame, stretches: list[tuple[int, int, int]]) -> dict[int, int]:
    """Ends of each stretch (a, b, cells), evenly over its groups numbered a + 1 to b: number -> place."""
    starts, stops, cells = (F.lit(list(x)) for x in zip(*stretches))
    number = F.col("number")
    which = F.size(F.filter(starts, lambda a: a < number)) - 1  # the last stretch that begins before the group
    a, b, n = F.get(starts, which), F.get(stops, which), F.get(cells, which)
    cell = F.when((which >= 0) & (number <= b), F.struct(which, F.floor((number - a - 1) * n / (b - a))))
    found = groups.select("stop", "number", cell.alias("cell")).where("cell IS NOT NULL").groupBy("cell").agg(F.max("number").alias("number"), F.max("stop").alias("stop"))
    return {r["number"]: r["stop"] for r in found.collect()}


def smallest_capacity(groups: DataFrame, shards: int, points: int = 40_000) -> tuple[int, list[int]]:
    """The minimax capacity and the place where each shard ends."""
    total, largest, count = groups.agg(F.max("stop"), F.max("size"), F.max("number")).first()
    least = max(largest, -(-total // shards))
    known, stretches = {count: total}, [(0, count, points)]
    while True:
        known |= finer(groups, stretches)
        ends = Ends(known)
        small, enough = ends.search(shards, least)
        places = ends.walk(enough, shards)
        if small + 1 == enough and all(a == b for a, b in places):
            return enough, [a for a, _ in places]
        # the groups among which a capacity between the two can cut, one stretch per cut
        merged: list[tuple[int, int]] = []
        for (x, _), (_, y) in zip(ends.walk(small + 1, shards), places):
            first, last = bisect_left(ends.ends, x), min(bisect_left(ends.ends, y) + 1, len(ends.ends) - 1)
            while first <= last and ends.fine(first):
                first += 1
            while last >= first and ends.fine(last):
                last -= 1
            if first <= last:
                a, b = (ends.numbers[first - 1] if first else 0), ends.numbers[last]
                if merged and a < merged[-1][1]:
                    a, b = merged[-1][0], max(b, merged.pop()[1])
                merged.append((a, b))
        # at least twice the ends known there, so that the longest gap is halved
        inside = [bisect_right(ends.numbers, b) - bisect_right(ends.numbers, a) for a, b in merged]
        stretches = [(a, b, max(points // len(merged), 2 * n)) for (a, b), n in zip(merged, inside)]


def shard(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", points: int = 40_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard (from 0), slot (gapless from 0 in each shard), grown_shard (null under this law)."""
    content = F.coalesce(F.col(text), F.lit(""))
    base = materialise(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(content) + OVERHEAD).cast("long").alias("size"), F.crc32(content).alias("text_crc32"), F.sha2(content, 256).alias("group")))
    groups = materialise(placed_groups(base))
    if groups.isEmpty():
        cuts = []
    else:
        _, cuts = smallest_capacity(groups, shards, points)
    # a group is in the shard whose end is the first at or behind its own
    ends = F.lit(cuts[:-1]) if len(cuts) > 1 else F.array().cast("array<long>")
    number = F.size(F.filter(ends, lambda end: end < F.col("stop")))
    numbered = groups.select("group", "first_row", number.cast("int").alias("shard"))
    firsts = numbered.groupBy("shard").agg(F.min("first_row").alias("shard_row"))
    placed = numbered.join(F.broadcast(firsts), "shard")  # one row per shard
    ranked = row_number_salted(base, "group", ["doc_id"], "inside")
    return ranked.join(placed, "group").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first_row") - F.col("shard_row") + F.col("inside")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
