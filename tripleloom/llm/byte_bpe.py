"""Byte-level BPE encoding and decoding with a two-tier lookup.

First tier: a minimal perfect hash over the vocabulary (hash and displace) finds a whole pre-token in one probe. Second
tier, for the rest: a heap of merge ranks over linked bytes. Both run once per distinct piece of text and worker; texts
are then assembled by array gathers. Decoding gathers the bytes of each id.

Defined results: a null text counts as empty and has no ids; decoding null or no ids gives no bytes, an id outside the
vocabulary raises an error. Rows are encoded each for itself, so repeated rows, null doc_ids and empty tables need no rule.
Texts are processed whole. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts
from .memo import Memo

# What \s matches in the tokenizer's own regular expressions.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Cuts that the tokenizer's pattern makes wherever it cuts at all around white space.
COARSE = r" ?[^{0}]+|[{0}]+(?![^{0}])|[{0}]+".format(WHITE)


def explicit(pattern: str) -> str:
    """The pattern with \\s and \\S written out, so that every regex library reads them alike."""
    return pattern.replace(r"[^\s", "[^" + WHITE).replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")


@dataclass
class PerfectHash:
    """Minimal perfect hash of n keys: bucket -> displacement of its keys' slots, or the slot of its only key."""

    displacements: np.ndarray
    slots: int

    @staticmethod
    def _pair(key: bytes) -> tuple[int, int]:
        h = xxhash.xxh3_64_intdigest(key)
        return h >> 32, h & 0xFFFFFFFF

    @classmethod
    def build(cls, keys: list[bytes], per_bucket: int = 4) -> tuple[PerfectHash, np.ndarray]:
        """The hash and the slot of each key."""
        n = len(keys)
        pairs = np.array([cls._pair(k) for k in keys], np.uint64).reshape(-1, 2)
        buckets = (pairs[:, 0] % np.uint64(max(1, n // per_bucket))).astype(np.int64)
        members: dict[int, list[int]] = {}
        for i, b in enumerate(buckets.tolist()):
            members.setdefault(b, []).append(i)
        displacements = np.zeros(max(1, n // per_bucket), np.int64)
        taken, place = np.zeros(n, bool), np.zeros(n, np.int64)
        trials = np.arange(1 << 10, dtype=np.uint64)
        for b, own in sorted(members.items(), key=lambda x: -len(x[1])):
            if len(own) == 1:
                break  # smallest buckets last: they take what is free
            first = np.uint64(0)
            while True:
                d = (trials + first)[:, None]
                slots = cls._slots(pairs[own][None, :, :], d, n)
                good = ~taken[slots].any(axis=1)
                if len(own) > 1:
                    good &= (np.diff(np.sort(slots, axis=1), axis=1) > 0).all(axis=1)
                if good.any():
                    k = int(good.argmax())
                    displacements[b] = int(first) + k
                    taken[slots[k]], place[own] = True, slots[k]
                    break
                first += np.uint64(len(trials))
        free = iter(np.flatnonzero(~taken).tolist())
        for b, own in members.items():
            if len(own) == 1:
                slot = next(free)
                displacements[b], place[own[0]] = -slot - 1, slot
        return cls(displacements, n), place

    @staticmethod
    def _slots(pairs: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (pairs[..., 1] ^ (d * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((mixed >> np.uint64(33)) % np.uint64(n)).astype(np.int64)

    def slot(self, key: bytes) -> int:
        high, low = self._pair(key)
        d = self.displacements[high % len(self.displacements)]
        if d < 0:
            return -d - 1
        mixed = ((low ^ (d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        return (mixed >> 33) % self.slots


class Vocabulary:
    """Tokens by perfect hash, ranks of merges, bytes of ids."""

    def __init__(self, tokens: dict[bytes, int], pattern: str):
        keys = list(tokens)
        self.hash, place = PerfectHash.build(keys)
        self.keys: list[bytes] = [b""] * len(keys)
        self.ids = [0] * len(keys)
        for key, slot in zip(keys, place.tolist()):
            self.keys[slot], self.ids[slot] = key, tokens[key]
        self.hash.displacements = self.hash.displacements.tolist()
        self.pattern, self.ranks = explicit(pattern), tokens
        top = max(tokens.values()) + 1
        by_id = [b""] * top
        for key, i in tokens.items():
            by_id[i] = key
        self.lengths = [len(k) if k else -1 for k in by_id]
        self.sizes = np.array(self.lengths, np.int64)
        self.starts = np.cumsum([0, *map(len, by_id)])[:-1]
        self.content = np.frombuffer(b"".join(by_id), np.uint8)

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """A rank file: base64 of the token, blank, rank, on each line."""
        with open(path, "rb") as file:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}, pattern)

    def rank(self, token: bytes) -> int | None:
        slot = self.hash.slot(token)
        return self.ids[slot] if self.keys[slot] == token else None

    def merge(self, word: bytes) -> list[int]:
        """Merges of a word that is no token, lowest rank first, leftmost among equals.

        A heap entry is one number: rank, and place of the left part. The rank's token tells where the right part stops, so an
        entry is stale if the two parts at its place stop elsewhere.
        """
        end, rank_of, lengths = len(word), self.ranks.get, self.lengths
        following, before = [*range(1, end + 1), -1], list(range(-1, end))
        heap = [rank << 32 | i for i in range(end - 1) if (rank := rank_of(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            entry = pop(heap)
            left = entry & 0xFFFFFFFF
            stop = left + lengths[entry >> 32]
            right = following[left]
            if right < 0 or following[right] != stop:  # either part was merged meanwhile
                continue
            following[left], following[right] = stop, -1
            before[stop] = left
            if stop < end and (rank := rank_of(word[left : following[stop]])) is not None:
                push(heap, rank << 32 | left)
            if (first := before[left]) >= 0 and (rank := rank_of(word[first:stop])) is not None:
                push(heap, rank << 32 | first)
        out, at, ranks = [], 0, self.ranks
        while at < end:
            out.append(ranks[word[at : following[at]]])
            at = following[at]
        return out

    def word_ids(self, pretoken: str) -> list[int]:
        word = pretoken.encode("utf-8", "surrogatepass")
        found = self.rank(word)
        return [found] if found is not None else self.merge(word)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of ids, and how many each has."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes) or self.sizes[ids].min() < 0):
            raise ValueError("id outside the vocabulary")
        sizes = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        source = np.repeat(self.starts[ids] - ends[:-1], sizes)
        source += np.arange(ends[-1])
        return self.content[source], ends


class Encoder:
    """A worker's memos of coarse pieces and of pre-tokens; a piece is cut by the pattern and every pre-token looked up once.

    Pieces of more than `LONG` characters, as text without blanks has them, seldom return: they are cut before they are
    looked up. Memos are emptied before they hold more than their limit of bytes.
    """

    LONG, PRETOKENS = 64, 1_200_000

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.fine = regex.compile(vocabulary.pattern).findall
        self.coarse = regex.compile(COARSE).findall
        self.known = Memo(vocabulary.word_ids, self.PRETOKENS)
        self.memo = Memo(self._piece)

    def _piece(self, piece: str) -> Sequence[int]:
        if len(piece) > self.LONG:  # a pre-token already
            return self.vocabulary.word_ids(piece)
        pretokens = self.fine(piece)
        if len(pretokens) == 1:
            return self.known.of(piece)
        return [i for pretoken in pretokens for i in self.known.of(pretoken)]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        # pre-tokens are held within the bytes of the pieces
        self.known.most = min(self.known.most, self.memo.most * 3 // 4)
        self.memo.trim()
        self.known.trim()
        pieces, per_text = [], []
        for text in texts:
            own = self.coarse(text) if text else []
            if text and max(map(len, own)) > self.LONG:
                own = [part for piece in own for part in ((piece,) if len(piece) <= self.LONG else self.fine(piece))]
            pieces += own
            per_text.append(len(own))
        return self.memo.ids(pieces, per_text)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(shared) -> Encoder:
    if shared.id not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[shared.id] = Encoder(shared.value)
    return _ENCODERS[shared.id]


class _Shared:
    """Vocabulary broadcast once, known in workers by a number."""

    def __init__(self, spark, vocabulary: Vocabulary):
        self.broadcast = spark.sparkContext.broadcast(vocabulary)
        self.id = uuid.uuid4().hex

    @property
    def value(self) -> Vocabulary:
        return self.broadcast.value


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = pa.array(ends, pa.int32())
    if pa.types.is_binary(kind):
        return pa.Array.from_buffers(kind, len(ends) - 1, [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(values))])
    return pa.ListArray.from_arrays(offsets, pa.array(values, kind.value_type))


def encode(docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text", with_decoded: bool = False) -> DataFrame:
    """doc_id, ids array<int>; `with_decoded` adds `decoded`, the bytes that the ids stand for."""
    inputs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = _Shared(docs.sparkSession, vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            flat, counts = encoder.encode(batch.column("text").to_pylist())
            ends = np.concatenate([[0], np.cumsum(counts)])
            columns, names = [batch.column("doc_id"), _lists(flat, ends, pa.list_(pa.int32()))], ["doc_id", "ids"]
            if with_decoded:
                content, at = encoder.vocabulary.decode(flat)
                columns.append(_lists(content, at[ends], pa.binary()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = inputs.schema["doc_id"].dataType.simpleString()
    return map_texts(inputs, "text", work, f"doc_id {kind}, ids array<int>" + ", decoded binary" * with_decoded)


def decode(encoded: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, decoded binary."""
    inputs = encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    shared = _Shared(encoded.sparkSession, vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                rows = [x or [] for x in part.column("ids").to_pylist()]
                content, at = shared.value.decode(np.array([i for row in rows for i in row], np.int64))
                ends = at[np.concatenate([[0], np.cumsum([len(r) for r in rows])])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(content, ends, pa.binary())], ["doc_id", "decoded"])

    return inputs.mapInArrow(work, f"doc_id {inputs.schema['doc_id'].dataType.simpleString()}, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode(..., with_decoded=True)."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
