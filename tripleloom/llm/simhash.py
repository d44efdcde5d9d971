"""SimHash near-duplicates through a hierarchical index in Gray order.

Fingerprints that differ in at most `radius` bits agree in all bits of at least one choice of blocks, so each fingerprint is
filed once for every choice under the value of those blocks. Inside such a group the fingerprints stand in Gray order; runs
of them become nodes that hold the bits all members share (mask and pattern), runs of nodes become upper nodes, and a node
keeps only the bits its parent does not have. A search goes down from the root adding up differences, and leaves out every
node whose sum exceeds the radius. More blocks, and so longer heads, are used as the number of fingerprints grows; the
result does not depend on it. A group larger than `group_limit` is cut into parts and every pair of parts searched by itself.

Each task passes on a spanning forest of the links it finds, never pairs of a whole group.

Defined results: null, empty and wordless texts have fingerprint zero and are linked like others; rows with a null id are
fingerprinted, and take part in links, but never name a component (it is null if no member has an id). Repeated rows and
equal texts are in one component. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_texts, materialise
from .components import components

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
FANOUT = 16
LANES = np.uint64(0x0101010101010101)
#: Sums of that many single bits fit into a byte.
BLOCK = 255


def shingle_digests(words: list[bytes], size: int = SHINGLE) -> bytes:
    """XXH64 of each shingle, big-endian, one behind the other; of the whole sequence if it is shorter."""
    digest = xxhash.xxh64_digest
    if len(words) < size:
        return digest(b" ".join(words), SEED) if words else b""
    return b"".join([digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(size)))])


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint of each text from the hashes of all; a bit is set if more than half of the text's hashes have it."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    firsts = (np.cumsum(counts) - counts)[full]
    blocks = -(-counts[full] // BLOCK)
    inner = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = np.repeat(firsts, blocks) + inner * BLOCK
    by_text = np.cumsum(blocks) - blocks
    half = counts[full][:, None]
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & LANES, starts)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), by_text, axis=0)
        bits = (2 * sums > half).astype(np.uint64)
        out[full] |= (bits << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(k))).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row's whole text."""
    inputs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shingle_digests((t or "").encode().lower().split(), size) for t in batch.column("text").to_pylist()]
            hashes = np.frombuffer(b"".join(parts), ">u8").astype(np.uint64)
            found = majority(hashes, np.array([len(p) // 8 for p in parts], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return map_texts(inputs, "text", work, f"doc_id {inputs.schema['doc_id'].dataType.simpleString()}, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Forest over fingerprints sorted by group and Gray rank; one tree per group.

    levels[0] are the leaves. A node has the first of its children one level below, its last leaf, a pattern, the mask of bits
    that all its leaves share, and `own`: the part of the mask that its parent lacks.
    """

    def __init__(self, groups: np.ndarray, codes: np.ndarray):
        everything = np.uint64(0xFFFFFFFFFFFFFFFF)
        size = len(codes)
        leaf = {"group": groups, "pattern": codes, "mask": np.full(size, everything), "last": np.arange(size), "first": np.arange(size), "children": np.ones(size, np.int64)}
        self.levels = [leaf]
        while True:
            below = self.levels[-1]
            new_group = np.r_[True, below["group"][1:] != below["group"][:-1]]
            starts = np.flatnonzero(new_group)
            place = np.arange(len(new_group)) - np.repeat(starts, np.diff(np.r_[starts, len(new_group)]))
            first = np.flatnonzero(place % FANOUT == 0)
            children = np.diff(np.r_[first, len(new_group)])
            parent = np.repeat(np.arange(len(first)), children)
            pattern = below["pattern"][first]
            differ = (below["pattern"] ^ pattern[parent]) | ~below["mask"]
            mask = ~np.bitwise_or.reduceat(differ, first)
            below["own"] = below["mask"] & ~mask[parent]
            self.levels.append({"group": below["group"][first], "pattern": pattern, "mask": mask, "last": below["last"][first + children - 1], "first": first, "children": children})
            if len(first) == len(starts):
                break
        self.roots = np.searchsorted(self.levels[-1]["group"], groups)

    def pairs(self, radius: int, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (query, later leaf) of one group that differ in at most `radius` bits."""
        codes = self.levels[0]["pattern"]
        node, query = self.roots[queries], queries
        # every member has the bits of its root
        total = np.zeros(len(queries), np.int64)
        for depth in range(len(self.levels) - 1, 0, -1):
            level, below = self.levels[depth], self.levels[depth - 1]
            n = level["children"][node]
            at = np.repeat(level["first"][node] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            query, total = np.repeat(query, n), np.repeat(total, n)
            total = total + np.bitwise_count((codes[query] ^ below["pattern"][at]) & below["own"][at])
            kept = (total <= radius) & (below["last"][at] > query)
            node, query, total = at[kept], query[kept], total[kept]
        return query, node

    def roots_of(self, radius: int, step: int = 512) -> np.ndarray:
        """Smallest leaf of each leaf's component under links of at most `radius` bits."""
        label = np.arange(len(self.levels[0]["pattern"]))
        for start in range(0, len(label), step):
            a, b = self.pairs(radius, np.arange(start, min(start + step, len(label))))
            while True:
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
                if not len(a):
                    break
                x, y = label[a], label[b]
                np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
                while True:
                    up = label[label]
                    if (up == label).all():
                        break
                    label = up
        return label


def head_masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """Masks of all choices of blocks - radius blocks, as signed longs."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    ranges = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(ranges, blocks - radius)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def blocks_for(count: int, radius: int = RADIUS, per_group: int = 64) -> int:
    """Fewest blocks whose shortest head still leaves about `per_group` of so many random fingerprints in a group."""
    blocks = radius + 1
    while blocks < radius + 5 and count > per_group << ((blocks - radius) * (BITS // blocks)):
        blocks += 1
    return blocks


def near_links(distinct: DataFrame, radius: int = RADIUS, group_limit: int = 4096) -> DataFrame:
    """(a, b): a spanning forest of every group's links; `distinct` is a written table of distinct `fp`."""
    masks = head_masks(blocks_for(distinct.count(), radius), radius)
    filed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("head")) for i, m in enumerate(masks)])).alias("k")).select("fp", "k.choice", "k.head")
    sizes = filed.groupBy("choice", "head").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > group_limit).withColumn("parts", F.ceil(F.col("n") / group_limit).cast("int")).drop("n")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(part, j).alias("i"), F.greatest(part, j).alias("j")))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    # groups of one have no links; the others are searched, the large ones part by part
    paired = filed.join(sizes.where("n > 1").select("choice", "head"), ["choice", "head"], "left_semi").join(large, ["choice", "head"], "left")
    tasks = paired.select("choice", "head", "fp", F.explode(F.when(F.col("parts").isNull(), alone).otherwise(others)).alias("p")).select(F.xxhash64("choice", "head", "p.i", "p.j").alias("task"), "choice", "head", "p.i", "p.j", "fp")
    keys = ["task", "choice", "head", "i", "j"]

    def forest(table: pa.Table) -> pa.RecordBatch:
        codes = table.column("fp").to_numpy().view(np.uint64)
        columns = [table.column(k).to_numpy() for k in keys]
        changed = np.zeros(len(codes), bool)
        changed[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        groups = np.cumsum(changed)
        order = np.lexsort((gray_rank(codes), groups))
        codes = codes[order]
        label = GrayIndex(groups[order], codes).roots_of(radius)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(codes[linked].view(np.int64)), pa.array(codes[label[linked]].view(np.int64))], ["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            tasks_of = held.column("task").to_numpy()
            whole = int(np.searchsorted(tasks_of, tasks_of[-1])) if len(tasks_of) else 0
            if whole >= group_limit:  # the last group may go on
                yield forest(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield forest(held)

    return tasks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id (the smallest id that links reach) of every row."""
    prints = materialise(fingerprints(docs, doc_id, text, size))
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = materialise(components(near_links(distinct.select("fp"), radius), "a", "b"))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_print = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` whose id names their component, once each; all columns as they were. Rows without an id stay."""
    found = near_duplicates(docs.where(F.col(doc_id).isNotNull()), doc_id, text)
    key = fresh("key")
    chosen = found.where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    named = docs.join(chosen, docs[doc_id] == chosen[key], "left_semi").dropDuplicates([doc_id])
    return named.unionByName(docs.where(F.col(doc_id).isNull()))
