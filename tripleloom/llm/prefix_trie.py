"""Prefix trie of conversations: every distinct beginning is a node with its members, children, leaves and shared bytes.

A turn is known by the MD5 of its role and text, so texts are read once and never move. Conversations become narrow
sequences of turn keys; equal sequences are one row that carries how many there are. A prefix that more than `split` different
sequences share is an upper node; a sequence belongs to the shard of its first prefix that is none. Each task packs the
sequences of its shards into double-array tries (BASE and CHECK over dense turn ids) of about `limit` sequences, walks them
through the arrays and sums over subtrees. Nodes below the upper ones are in one trie only and so are final; what the tries
know about upper nodes is merged by prefix, and the few upper nodes add their own share to those above them.

Held by one task: the keys (24 bytes a turn) of the sequences of one trie. The ids of equal conversations pass through
one task in order, as a hash over all of them has to be one stream; they are not held.

Defined results: a null role or text is empty; turns that are null come first, and turns of one number follow in the order of
role and turn key. Repeated rows are turns of their own. Rows without a conv_id belong to no conversation. A conversation
rebuilt without turns is a member of the root only; without conversations there is no root. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Sequences of one shard at most, so that shards can be dealt evenly; sequences of one trie, about.
SPLIT, LIMIT = 128, 20_000
#: Sharing of heads between conversations: families of five, heads of at most eight turns.
FAMILY, HEADS = 5, 9
KEY = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()


# ---- sequences


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, own: each conversation's turns in order, as structs with `key` and `bytes`."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", F.struct("turn", role.alias("role"), key.alias("key"), F.octet_length(text).alias("bytes")).alias("t"))
    # structs sort field by field, nulls first
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own")).withColumn("own", F.transform("own", lambda t: F.struct(t["key"].alias("key"), t["bytes"].alias("bytes"))))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, keys (16 bytes a turn), sizes: the head of the family's first conversation, then the own turns behind it."""
    own = turns(conversations)
    c = F.col("conv_id")
    first = own.where(c % FAMILY == 0).select(c.alias("family"), F.slice("own", 1, HEADS - 1).alias("head"))
    known = own.withColumns({"family": c - c % FAMILY, "h": (F.crc32(c.cast("string")) % HEADS).cast("int")})
    joined = known.join(first, "family", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("own", 1, 0))
    rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    whole = joined.select("conv_id", F.concat(head, rest).alias("turns"))
    return whole.select("conv_id", F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), "").alias("keys"), F.col("turns.bytes").alias("sizes")).withColumn("keys", F.unhex("keys"))


def ends(sequences: DataFrame) -> DataFrame:
    """id, n, least, ends_sha256 of each group of equal sequences; `sequences` holds id and conv_id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, least, sha, out = None, 0, None, None, []

        def taken() -> pa.RecordBatch:
            done = list(zip(*out)) or [(), (), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(done, (pa.binary(), pa.int64(), pa.int64(), pa.string()))], ["id", "n", "least", "ends_sha256"])

        for batch in batches:
            for key, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if key != last:
                    if last is not None:
                        out.append((last, n, least, sha.hexdigest()))
                    last, n, least, sha = key, 0, conv, hashlib.sha256()
                sha.update(f"{',' if n else ''}{conv}".encode())
                n += 1
            yield taken()
        if last is not None:
            out.append((last, n, least, sha.hexdigest()))
            yield taken()

    dealt = sequences.select("id", F.col("conv_id").cast("long")).repartition("id").sortWithinPartitions("id", "conv_id")
    return dealt.mapInArrow(work, "id binary, n long, least long, ends_sha256 string")


def prefix_ids(keys: bytes) -> list[bytes]:
    """The hash of each prefix, shortest first; the root's is that of no bytes."""
    sha = hashlib.md5()
    out = [sha.digest()]
    for at in range(0, len(keys), KEY):
        sha.update(keys[at : at + KEY])
        out.append(sha.copy().digest())
    return out


def upper_prefixes(sequences: DataFrame, split: int) -> DataFrame:
    """prefix: prefixes of at least one turn that more than `split` of the distinct sequences share."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys in batch.column("keys").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(prefix_ids(keys)[1:], pa.binary())], ["prefix"])

    return sequences.select("keys").mapInArrow(work, "prefix binary").groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split).select("prefix")


def sharded(sequences: DataFrame, split: int) -> DataFrame:
    """With `upper` (how many nodes of the sequence, the root included, are upper nodes) and `shard`."""
    heavy = materialise(upper_prefixes(sequences, split))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, keys in zip(batch.column("id").to_pylist(), batch.column("keys").to_pylist()):
                found = prefix_ids(keys)[1:]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.binary()), pa.array(found, pa.binary())], ["id", "prefix"])

    # at most as many upper prefixes as sequences / split at each depth; joined by key, as nothing bounds the depth
    upper = sequences.select("id", "keys").mapInArrow(work, "id binary, prefix binary").join(heavy, "prefix").groupBy("id").agg((F.count(F.lit(1)) + 1).cast("int").alias("upper"))
    counted = sequences.join(upper, "id", "left").withColumn("upper", F.coalesce("upper", F.lit(1)))
    return counted.withColumn("shard", F.md5(F.substring("keys", F.lit(1), F.col("upper") * KEY)))


# ---- double array


@dataclass
class DoubleArray:
    """child of node s by turn id c: t = base[s] + c, if check[t] == s. Slot 0 is the root; free slots have check -1."""

    base: np.ndarray
    check: np.ndarray

    @classmethod
    def pack(cls, codes: np.ndarray, ends: np.ndarray) -> DoubleArray:
        """Packs sequences of dense ids from 1, given one behind the other, level by level."""
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        lengths = ends - starts
        size = max(16, 2 * (len(codes) + 2))
        base, check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        check[0] = 0
        free_from = 1
        node = np.zeros(len(ends), np.int64)
        for depth in range(int(lengths.max(initial=0))):
            alive = np.flatnonzero(lengths > depth)
            code = codes[starts[alive] + depth]
            pairs = np.unique(np.stack([node[alive], code], axis=1), axis=0)
            parents, first, n = np.unique(pairs[:, 0], return_index=True, return_counts=True)
            wanted = pairs[:, 1]
            if len(check) - (check >= 0).sum() < 2 * len(pairs) + int(codes.max()) + 2:
                more = len(check) + 2 * len(pairs) + int(codes.max()) + 2
                base, check = np.concatenate([base, np.zeros(more, np.int64)]), np.concatenate([check, np.full(more, -1, np.int64)])
            # parents of several children look for a place where all of them are free
            for i in np.flatnonzero(n > 1):
                own = wanted[first[i] : first[i] + n[i]]
                while free_from < len(check) and check[free_from] >= 0:
                    free_from += 1
                spread = own - own[0]
                begin, window = free_from, 1024
                while True:
                    if begin + window + spread[-1] > len(check):
                        more = len(check) + window + int(spread[-1])
                        base, check = np.concatenate([base, np.zeros(more, np.int64)]), np.concatenate([check, np.full(more, -1, np.int64)])
                    places = begin + np.flatnonzero(check[begin : begin + window] < 0)
                    for step in spread[1:]:
                        places = places[check[places + step] < 0]
                    if len(places):
                        break
                    begin, window = begin + window, 2 * window
                base[parents[i]] = places[0] - own[0]
                check[places[0] + spread] = parents[i]
            # an only child takes the next free slot
            single = np.flatnonzero(n == 1)
            slots = free_from + np.flatnonzero(check[free_from:] < 0)[: len(single)]
            base[parents[single]] = slots - wanted[first[single]]
            check[slots] = parents[single]
            node[alive] = base[node[alive]] + code
        return cls(base, check)

    def walk(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The children reached from nodes by turn ids; -1 where there is none."""
        t = self.base[node] + code
        inside = (t > 0) & (t < len(self.check))
        return np.where(inside & (self.check[np.where(inside, t, 0)] == node), t, -1)


def dense_ids(keys: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Ids from 1 of turn keys, equal for equal keys, in the order of first appearance by `place` in the sequence.

    New siblings so have ids close to each other, which keeps the array dense.
    """
    order = np.argsort(place, kind="stable")
    _, first, code = np.unique(keys[order], return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first, kind="stable")] = np.arange(1, len(first) + 1)
    out = np.empty(len(keys), np.int64)
    out[order] = rank[code.ravel()]
    return out


NODE = "upper boolean, prefix binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, bytes long, ends_sha256 string, path array<binary>"


def trie_nodes(rows: list[dict]) -> pa.RecordBatch:
    """Nodes of the trie of some shards: final below the upper nodes, parts of the whole for these.

    For an upper node n_leaves and saved_tokens are those of the nodes below that are no upper nodes, n_children counts these.
    """
    lengths = np.array([len(r["sizes"]) for r in rows], np.int64)
    last = np.cumsum(lengths)
    starts = last - lengths
    keys = np.frombuffer(b"".join(r["keys"] for r in rows), f"S{KEY}") if last[-1] else np.zeros(0, f"S{KEY}")
    # numpy cuts zero bytes at the end of S values, alike for equal keys; the length is fixed, so keys stay apart
    codes = dense_ids(keys, np.arange(len(keys)) - np.repeat(starts, lengths))
    trie = DoubleArray.pack(codes, last)
    size = len(trie.check)
    weight = np.array([r["n"] for r in rows], np.int64)
    least = np.array([r["least"] for r in rows], np.int64)
    upper = np.array([r["upper"] for r in rows], np.int64)
    sizes = np.concatenate([np.array(r["sizes"], np.int64) for r in rows])
    depth = np.full(size, -1, np.int64)
    n, conv, own_bytes = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64)
    private = np.zeros(size, bool)
    an_end, some = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    node = np.zeros(len(rows), np.int64)
    for d in range(int(lengths.max()) + 1):
        alive = np.flatnonzero(lengths >= d)
        if d:
            at = starts[alive] + d - 1
            node[alive] = trie.walk(node[alive], codes[at])
            own_bytes[node[alive]] = sizes[at]
        here = node[alive]
        depth[here] = d
        np.add.at(n, here, weight[alive])
        np.minimum.at(conv, here, least[alive])
        private[here] = d >= upper[alive]
        some[here] = alive
        ending = alive[lengths[alive] == d]
        an_end[node[ending]] = ending
    nodes = np.flatnonzero(depth >= 0)
    nodes = nodes[np.argsort(depth[nodes], kind="stable")]
    parent = trie.check
    children = np.bincount(parent[nodes[nodes > 0]], minlength=size)
    leaves = ((children == 0) & private).astype(np.int64)
    saved = np.where(private, (n - 1) * own_bytes, 0)
    for d in range(int(depth.max()), 0, -1):
        level = nodes[depth[nodes] == d]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    own_children = np.where(private, children, np.bincount(parent[nodes[(nodes > 0) & private[nodes]]], minlength=size))
    # hashes of prefixes only for upper nodes and their children
    prefixes: dict[int, list[bytes]] = {}

    def path_of(v: int) -> list[bytes]:
        """Hashes of all prefixes from the root to the node."""
        if v not in prefixes:
            prefixes[v] = prefix_ids(rows[some[v]]["keys"][: depth[v] * KEY])
        return prefixes[v]

    is_top = private & ~private[parent]
    out = {k: [] for k in ("prefix", "parent", "path")}
    for v in nodes.tolist():
        if private[v]:
            out["prefix"].append(None)
            out["parent"].append(path_of(int(parent[v]))[-1] if is_top[v] else None)
            out["path"].append(None)
        else:
            path = path_of(v)
            out["prefix"].append(path[-1])
            out["parent"].append(path[-2] if len(path) > 1 else None)
            out["path"].append(path[:-1])
    hashes = [rows[i]["ends_sha256"] if i >= 0 else None for i in an_end[nodes]]
    final = private[nodes]
    known_parent = final & ~is_top[nodes]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(~final), pa.array(out["prefix"], pa.binary()), pa.array(out["parent"], pa.binary()), pa.array(conv[nodes]), pa.array(depth[nodes]),
            pa.array(conv[parent[nodes]], mask=~known_parent), pa.array(n[nodes]), pa.array(own_children[nodes]), pa.array(leaves[nodes]), pa.array(saved[nodes]),
            pa.array(own_bytes[nodes]), pa.array(hashes, pa.string()), pa.array(out["path"], pa.list_(pa.binary())),
        ],
        [f.split()[0] for f in NODE.split(", ")],
    )


def shard_tries(sequences: DataFrame, limit: int) -> DataFrame:
    """Rows of `trie_nodes` for all shards; a trie ends with the shard that makes it reach `limit` sequences."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if len(held) >= limit and row["shard"] != held[-1]["shard"]:
                    yield trie_nodes(held)
                    held = []
                held.append(row)
        if held:
            yield trie_nodes(held)

    dealt = sequences.select("shard", "keys", "sizes", "n", "least", "upper", "ends_sha256").repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(work, NODE)


# ---- merge


OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def merged(found: DataFrame) -> DataFrame:
    """All nodes, from the written rows of the tries."""
    parts = found.where("upper").groupBy("prefix").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("path").alias("path"), F.first("bytes").alias("bytes"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("ends_sha256").alias("ends_sha256"),
    )
    upper = materialise(parts)
    more = upper.where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("upper_children")).withColumnRenamed("parent", "prefix")
    own = (F.col("n_convs") - 1) * F.col("bytes")
    above = upper.select(own.alias("above"), F.explode("path").alias("prefix")).groupBy("prefix").agg(F.sum("above").alias("above"))
    whole = upper.join(more, "prefix", "left").join(above, "prefix", "left").withColumns(
        {
            "n_children": F.col("n_children") + F.coalesce("upper_children", F.lit(0)),
            "saved_tokens": F.col("saved_tokens") + own + F.coalesce("above", F.lit(0)),
        }
    )
    # an upper node has children unless it is the root of turnless conversations
    whole = whole.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")))
    names = upper.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("named"))
    tops = found.where("NOT upper AND parent IS NOT NULL")
    root = names.where(F.col("parent") == F.lit(prefix_ids(b"")[0])).first()
    root_id = root[1] if root else None
    at_root = F.col("parent") == F.lit(prefix_ids(b"")[0])
    # children of the root, by far the most, need no join
    under_root = [t.where(at_root).withColumn("parent_conv_id", F.lit(root_id).cast("long")).select(*OUT) for t in (tops, whole)]
    others = [t.where(~at_root).drop("parent_conv_id").join(names, "parent").withColumnRenamed("named", "parent_conv_id").select(*OUT) for t in (tops, whole)]
    top = whole.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*OUT)
    out = found.where("NOT upper AND parent IS NULL").select(*OUT)
    for part in (*under_root, *others, top):
        out = out.union(part)
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))


def equal_ids(keys: Column) -> Column:
    """One value for equal sequences."""
    return F.unhex(F.md5(keys))


def prefix_trie(conversations: DataFrame, split: int = SPLIT, limit: int = LIMIT) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    all_sequences = materialise(rebuilt(conversations).withColumn("id", equal_ids(F.col("keys"))))
    distinct = all_sequences.groupBy("id").agg(F.first("keys").alias("keys"), F.first("sizes").alias("sizes"))
    sequences = materialise(distinct.join(ends(all_sequences), "id"))
    return merged(materialise(shard_tries(sharded(sequences, split), limit)))
