"""Cheapest repair of conversations to the turn order system?, (user, assistant)+, with an audit of edits.

A conversation's rows, in the order of their turns, are kept, given another role, deleted or preceded by inserted empty rows.
The choice is a shortest path in a DAG whose nodes are (row, what the output ends with). A path's weight is one big integer:
high digits hold its cost, below them a fixed number of digits, three bits each, spells its letters from the highest place
down, zero where the audit has ended. An edge adds its cost, moves the letters behind it one place down and puts its own
letter on top, so the ordinary minimum of integers picks the least cost and, among equals, the least audit.

Work is in two passes. The first moves narrow rows only (a hash, an initial and flags a turn) and decides; the second streams
the texts once, each conversation behind its decision, and holds one batch of them. A conversation's decision, at most three
letters a turn, is made in one task, as it is one value of the result; its time grows with the square of the turns (400 turns:
some 10 ms).

Defined results: a null role or text is one space, in the damage key too; a null conv_id is a conversation of its own; turns
that are null come first, rows of one turn follow in the order of role and a text hash. Repeated rows are duplicates. A
conversation without rows costs nothing and has an empty audit. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Letters of the audit by digit; zero stands behind the end.
LETTERS = "\0DIKR"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
COST = {DELETE: 4, INSERT: 3, KEEP: 0, REROLE: 3}
TRUNCATED_COST = 3
WHITE = " \t\n\x0b\x0c\r"
#: What the output ends with: nothing, a system turn, a user turn, an assistant turn. The first and last may be the end.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: After what a user or an assistant turn may come.
BEFORE = {USER: (NOTHING, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
#: A row's code: its initial (other: 0), and bits.
INITIALS = {"s": 1, "u": 2, "a": 3}
OUT, CUT = 4, 8


@lru_cache(maxsize=50_000)
def _short(codes: bytes) -> tuple[int, str]:
    return cheapest(codes)


def cheapest(codes: bytes) -> tuple[int, str]:
    """Cost and audit of the best edits of rows given by their codes (initial, plus OUT if it must go, CUT if truncated)."""
    width = 3 * (len(codes) + 4 * len(codes) // 3 + 6)  # no optimal path spends more on inserts than deleting all and two inserts
    top = width - 3
    never = 1 << (width + 64)

    def edge(cost: int, letter: int, rest: int) -> int:
        spent = rest >> width
        return ((spent + cost) << width) | (letter << top) | ((rest ^ (spent << width)) >> 3)

    def with_inserts(v: list[int]) -> list[int]:
        # two inserts between user and assistant come back to where they began, so each place sees at most one of a kind
        user = min(v[USER], edge(COST[INSERT], INSERT, v[ASSISTANT]))
        assistant = min(v[ASSISTANT], edge(COST[INSERT], INSERT, v[USER]))
        opened = edge(COST[INSERT], INSERT, user)
        return [min(v[NOTHING], opened), min(v[SYSTEM], opened), user, assistant]

    best = with_inserts([0, never, never, 0])
    for code in reversed(codes):
        after = best
        best = [edge(COST[DELETE], DELETE, v) for v in after]
        if not code & OUT:
            extra = TRUNCATED_COST if code & CUT else 0
            initial = code & 3
            for role in (USER, ASSISTANT):
                kept = edge(COST[KEEP] + extra, KEEP, after[role]) if initial == role else edge(COST[REROLE] + extra, REROLE, after[role])
                for state in BEFORE[role]:
                    best[state] = min(best[state], kept)
            if initial == SYSTEM:
                best[NOTHING] = min(best[NOTHING], edge(COST[KEEP] + extra, KEEP, after[SYSTEM]))
        best = with_inserts(best)
    found = best[NOTHING]
    cost = found >> width
    digits = found ^ (cost << width)
    # three bits a letter are one octal digit
    return cost, f"{digits:0{width // 3}o}".rstrip("0").translate({ord(str(i)): c for i, c in enumerate(LETTERS)})


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `gone` (the row was dropped) of every row after damage by the crc32 of `conv_id:turn`."""
    space = F.lit(" ")
    code = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = conversations.select(
        "conv_id", "turn", F.when(code == 4, "user").otherwise(role).alias("role"),
        F.when(code == 1, "").when(code == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), (code == 0).alias("gone"),
        F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"),
    )
    return rows.withColumn("copy", F.explode("copies")).select("conv_id", "turn", "role", "text", "gone")


def _ordered(rows: DataFrame) -> DataFrame:
    """With the hashes that order rows of one turn and tell texts apart."""
    return rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64("text", F.lit(1))})


def decide(rows: DataFrame) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit. `gone` rows only name their conversation."""
    core = F.rtrim("text", F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    narrow = _ordered(rows).select(
        "conv_id", F.when(~F.col("gone"), F.col("turn")).alias("turn"), F.when(~F.col("gone"), F.col("role")).alias("role"), "h1", "h2", "gone",
        code.cast("int").alias("code"), (core == "").alias("blank"), (~F.right(core, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    dealt = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "h1", "h2")

    def verdict(rows: list[tuple]) -> tuple:
        seen, codes, turns, blank, duplicate, truncated, illegal, before = set(), bytearray(), set(), 0, 0, 0, 0, None
        low = high = None
        for turn, role, h1, h2, gone, initial, is_blank, is_cut in rows:
            if gone:
                continue
            if turn is not None:
                low, high = turn if low is None else low, turn
                turns.add(turn)
            key = role, h1, h2
            if is_blank:
                initial_code, blank = initial | OUT, blank + 1
            elif key in seen:
                initial_code, duplicate = initial | OUT, duplicate + 1
            elif is_cut:
                initial_code, truncated = initial | CUT, truncated + 1
            else:
                initial_code = initial
            seen.add(key)
            codes.append(initial_code)
            illegal += before is not None and (before, initial) not in ((1, 2), (2, 3), (3, 2))
            before = initial
        cost, audit = _short(bytes(codes)) if len(codes) <= 16 else cheapest(bytes(codes))
        return high - low + 1 - len(turns) if turns else 0, blank, duplicate, truncated, illegal, cost, audit

    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    id_type = conversations_id(rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nobody = object()
        conv, held, out_ids, out = nobody, [], [], []

        def batch_of(schema: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(out_ids, schema), *(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.string())], ["conv_id", *names])

        for batch in batches:
            schema = batch.schema.field("conv_id").type
            for key, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if key != conv:
                    if conv is not nobody:
                        out_ids.append(conv)
                        out.append(verdict(held))
                    conv, held = key, []
                held.append(tuple(row))
            if out:
                yield batch_of(schema)
                out_ids, out = [], []
        if conv is not nobody:
            out_ids.append(conv)
            out.append(verdict(held))
            yield batch_of(schema)

    return dealt.mapInArrow(work, f"conv_id {id_type}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def conversations_id(rows: DataFrame) -> str:
    return rows.schema["conv_id"].dataType.simpleString()


def _behind_decisions(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """The decision of each conversation with its rows behind it, one stream per task."""
    texts = _ordered(rows.where(~F.col("gone"))).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "h1", "h2", "text")
    none = F.lit(None)
    heads = decisions.select("conv_id", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("long").alias("h1"), none.cast("long").alias("h2"), F.col("audit").alias("text"))
    both = heads.union(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "h1", "h2")
    return both.select("conv_id", "kind", "role", "text")


class _Edits:
    """Follows an audit; gives the output rows that each input row leads to."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, NOTHING

    def _next_role(self) -> tuple[str, int]:
        return ("assistant", ASSISTANT) if self.state == USER else ("user", USER)

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            role, self.state = self._next_role()
            self.at += 1
            yield role, ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "D":
            return
        if letter == "R":
            role, self.state = self._next_role()
        else:
            self.state = INITIALS[role[0]]
        yield role, text


def repaired(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """conv_id, place, role, text of every row of the repaired conversations."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, place, conv, left = None, 0, None, []

        def batch_of(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [(), (), (), ()]
            types = [id_type, pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", "place", "role", "text"])

        def numbered(found: Iterator[tuple[str, str]]) -> Iterator[tuple]:
            nonlocal place
            for role, text in found:
                yield conv, place, role, text
                place += 1

        id_type = None
        for batch in batches:
            out = []
            id_type = batch.schema.field("conv_id").type
            for key, kind, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    if edits is not None:
                        out += numbered(edits.inserts())
                    edits, place, conv = _Edits(text), 0, key
                else:
                    out += numbered(edits.row(role, text))
            if out:
                yield batch_of(out, id_type)
        if edits is not None:
            left = list(numbered(edits.inserts()))
            if left:
                yield batch_of(left, id_type)

    schema = f"conv_id {conversations_id(rows)}, place long, role string, text string"
    return map_texts(_behind_decisions(rows, decisions), "text", work, schema)


def digests(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: hash of the repaired rows as `role:text`, joined by newlines, computed as the texts pass."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, conv, sha, first = None, None, None, True

        def feed(found: Iterator[tuple[str, str]]) -> None:
            nonlocal first
            for role, text in found:
                sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False

        def batch_of(ids: list, hashes: list[str], id_type: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(hashes, pa.string())], ["conv_id", "repaired_sha256"])

        id_type = None
        for batch in batches:
            ids, hashes = [], []
            id_type = batch.schema.field("conv_id").type
            for key, kind, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    if edits is not None:
                        feed(edits.inserts())
                        ids.append(conv)
                        hashes.append(sha.hexdigest())
                    edits, conv, sha, first = _Edits(text), key, hashlib.sha256(), True
                else:
                    feed(edits.row(role, text))
            if ids:
                yield batch_of(ids, hashes, id_type)
        if edits is not None:
            feed(edits.inserts())
            yield batch_of([conv], [sha.hexdigest()], id_type)

    return map_texts(_behind_decisions(rows, decisions), "text", work, f"conv_id {conversations_id(rows)}, repaired_sha256 string")


def structure_repair(conversations: DataFrame) -> DataFrame:
    """Damage, decisions and the digest of the repaired rows, one row per conv_id."""
    from .common import materialise

    rows = damage(conversations)
    decisions = materialise(decide(rows))
    hashes = digests(rows, decisions)
    same = decisions["conv_id"].eqNullSafe(hashes["conv_id"])
    return decisions.join(hashes, same).select(decisions["*"], "repaired_sha256")
