"""Best-fit packing planned over a length histogram.

Texts become token pieces of at most `capacity`; how many pieces have each length is one small table. Best fit, longest
first, runs over these counts: equal sequences are one run of numbers, and one step places as many pieces of a length
as there are sequences of the tightest fitting room. A piece takes the slot of its rank among the pieces of its length.

Defined results: a null or empty text is the single end token. Repeated rows are packed each for itself. Pieces of equal
length are interchangeable and ranked by their order columns. An empty table gives no rows; a null id is kept as it is.
Only longer documents than the capacity are cut. Other columns are not looked at.
"""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, fresh, map_texts, materialise, row_number_salted
from .memo import Memo

CAPACITY = 2048
END = "\n"
#: Marks that may end a word.
MARKS = frozenset(".,;:!?")
TOGETHER = 500
#: Bytes of a worker's memo.
HELD = 240 << 20
_MEMOS: dict[tuple[str, int], tuple] = KEPT.setdefault("packing", {})


def _worker_memo(spec: str, end_id: int) -> tuple:
    """Tokenizer, flags of the ids that end a word, and memo of this worker; the memo outlives a task but not its limit. It holds the end id, too."""
    if (spec, end_id) not in _MEMOS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(spec)
        vocabulary = tokenizer.get_vocab()
        closing = bytearray(max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            closing[number] = token.endswith("</w>")
        _MEMOS.clear()
        _MEMOS[spec, end_id] = tokenizer, closing, Memo(lambda piece: tokenizer.encode(piece, add_special_tokens=False).ids, limit=900_000)
    return _MEMOS[spec, end_id]


def _core(word: str) -> tuple[str, str]:
    """What decides a word's ids, and a last mark that the pattern always cuts off. Case counts for nothing in ASCII.

    Special tokens (`<|name|>`) are found before case is dropped, so a word that may hold one stays as it is.
    """
    if "<|" in word:
        return word, ""
    if word.isascii():
        word = word.lower()
        letters = word[:-1].isalpha()
    else:  # a letter whose small form ends in a combining mark holds on to the mark behind it
        letters = word[:-1].lower().isalpha()
    return (word[:-1], word[-1]) if letters and word[-1:] in MARKS else (word, "")


def _learn(tokenizer, closing: bytearray, memo: Memo, words: list[str]) -> None:
    """Put words into the memo; those that differ in case or a last mark only are encoded once.

    Words of letters have one end-of-word token each, so many are encoded as one text and told apart by it; should a word come
    apart when its case changes, the count tells, and the group is encoded word by word.
    """
    parts = [_core(w) for w in words]
    new = [c for c in {core for core, _ in parts}.union(MARKS) if c not in memo]
    letters = [c for c in new if c.isalpha()]
    for start in range(0, len(letters), TOGETHER):
        group = letters[start : start + TOGETHER]
        ids = tokenizer.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids
        ends = [i for i, number in enumerate(ids, 1) if closing[number]]
        if len(ends) == len(group):
            for core, a, b in zip(group, [0, *ends], ends):
                memo.put(core, ids[a:b])
    rest = [c for c in new if c not in memo]
    for core, coded in zip(rest, tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
        memo.put(core, coded.ids)
    of, put = memo.of, memo.put
    for word, (core, mark) in zip(words, parts):
        if word not in memo:
            put(word, of(core) + of(mark) if mark else of(core))


def tokenize(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0, held: int = HELD) -> DataFrame:
    """doc_id, piece, start, length, doc_tokens, ids (little-endian unsigned 32-bit): each text's ids and the end id, cut to the capacity.

    The vocabulary's patterns never match across white space, so a text is encoded word by word, each distinct word once.
    """
    with open(vocabulary, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())  # a fixed file
    inputs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, closing, memo = _worker_memo(shared.value, end_id)
        memo.most = held
        for batch in batches:
            memo.trim()
            if END not in memo:
                memo.put(END, [end_id])
                memo.put("", [])
            words, per_text = [], []
            for value in batch.column("text").to_pylist():
                own = (value or "").replace("\n", " ").split(" ")
                words += own
                words.append(END)
                per_text.append(len(own) + 1)
            _learn(tokenizer, closing, memo, [w for w in set(words) if w not in memo])
            flat, counts = memo.ids(words, per_text)
            flat = flat.astype("<u4")
            rows, pieces, starts, lengths, totals, ids, at = [], [], [], [], [], [], 0
            for row, n in enumerate(counts.tolist()):
                for piece, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(start)
                    lengths.append(length)
                    totals.append(n)
                    ids.append(flat[at + start : at + start + length].tobytes())
                at += n
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows)), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(totals, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "piece", "start", "length", "doc_tokens", "ids"],
            )

    kind = inputs.schema["doc_id"].dataType.simpleString()
    return map_texts(inputs, "text", work, f"doc_id {kind}, piece int, start long, length long, doc_tokens long, ids binary", keeps="packing")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts of lengths: (length, first rank, pieces, first sequence, offset) of each run."""
    runs: list[tuple[int, int, int, int, int]] = []
    rooms: list[int] = []  # sorted: rooms that some open sequences have
    open_runs: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, how many)
    sequences = 0

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_runs:
                open_runs[room] = []
                insort(rooms, room)
            open_runs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, n = open_runs[room].pop()
                if not open_runs[room]:
                    del open_runs[room], rooms[i]
                taken = min(n, left)
                runs.append((length, rank, taken, first, capacity - room))
                leave(room - length, first, taken)
                leave(room, first + taken, n - taken)
                rank, left = rank + taken, left - taken
                continue
            fit = capacity // length
            whole = left // fit
            for full, each in ((whole, fit), (1, left - whole * fit)):
                if full and each:
                    for k in range(each):
                        runs.append((length, rank, full, sequences, k * length))
                        rank += full
                    leave(capacity - each * length, sequences, full)
                    sequences += full
            left = 0
    return sorted(runs)


def pack(pieces: DataFrame, length: str = "length", order: list[str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces whose lengths are 1 to `capacity`."""
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # at most `capacity` rows
    runs = np.array(plan(counts, capacity), np.int64).reshape(-1, 5)
    shared = pieces.sparkSession.sparkContext.broadcast(runs)  # as large as the histogram makes it, however many documents
    place = fresh("rank")
    ranked = row_number_salted(pieces, length, order or ["doc_id", "piece"], place)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        keys = (runs[:, 0] << 48) | runs[:, 1]
        for batch in batches:
            rank = batch.column(place).to_numpy()
            run = runs[np.searchsorted(keys, (batch.column(length).to_numpy() << 48) | rank, side="right") - 1]
            kept = [n for n in batch.schema.names if n != place]
            columns = [batch.column(n) for n in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])], [*kept, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(work, f"{fields}, sequence_id long, offset long")


def assemble(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the pieces of each sequence one behind the other; `packed` holds `ids`, sequence_id and offset."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # at most one sequence's tokens
    return parts.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def packing(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, held: int = HELD) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = tokenize(docs, vocabulary, doc_id, text, capacity, held=held)
    return pack(materialise(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))), capacity=capacity)
