"""Structure repair and prefix trie of conversations against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleloom.llm import prefix_trie, structure_repair
from tripleloom.llm.structure_repair import CUT, OUT

SCHEMA = "conv_id long, turn long, role string, text string, own int, shard string, prefix string, kind int, h1 long"
ROLES, TEXTS = ["system", "user", "assistant", "tool", None, ""], ["Yes.", "No", " \t", "", None, "What?", "same line.", "same line.", "é 世界!", "open end  "]


def _rows():
    rng = random.Random(4)
    rows = []
    for c in range(-7, 60):
        for t in range(rng.choice([1, 2, 3, 5, 8, 12])):
            rows.append((c, rng.choice([t, t, t, t + 1, None]), rng.choice(ROLES[:3] if rng.random() < 0.8 else ROLES), rng.choice(TEXTS)))
    rows += [(c, t, ("user", "assistant")[t % 2], f"common {min(t, 3)}.") for c in range(100, 160) for t in range(2 + c % 5)]
    rows += [(None, 0, "user", "lost."), (None, 1, "assistant", "too"), (200, 0, "user", "x" * 100_000 + "."), (200, 0, "user", "x" * 100_000 + ".")]
    rows += [(300, t, ("user", "assistant")[t % 2], f"long {t}.") for t in range(120)]
    return rows


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.createDataFrame([(*r, 1, "s", "p", 2, 3) for r in _rows()], SCHEMA).repartition(4)


# ---- repair


def all_edits(codes):
    """Least (cost, audit) of all edit sequences with at most two inserts in a row."""
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    best = None
    options = []
    for code in codes:
        extra = 3 if code & CUT else 0
        own = [("D", None, 4)]
        if not code & OUT:
            own += [("K", "?sua"[code & 3], extra), ("R", "u", 3 + extra), ("R", "a", 3 + extra)]
        options += [[("I" * len(i), "".join(r[0] for r in i), 3 * len(i)) for i in inserts], own]
    options.append([("I" * len(i), "".join(r[0] for r in i), 3 * len(i)) for i in inserts])
    for picked in itertools.product(*options):
        if re.fullmatch("(s?(ua)+)?", "".join(r or "" for _, r, _ in picked)):
            found = sum(c for _, _, c in picked), "".join(e for e, _, _ in picked)
            best = found if best is None or found < best else best
    return best


def by_strings(codes):
    """Least (cost, audit), the roles of the output kept as text."""

    @cache
    def best(i, q, inserted):
        found = [(0, "")] if i == len(codes) and q in ("", "a") else []
        nexts = {"": "u", "s": "u", "a": "u", "u": "a"}
        if inserted < 2:
            cost, audit = best(i, nexts[q], inserted + 1)
            found.append((cost + 3, "I" + audit))
        if i < len(codes):
            code = codes[i]
            cost, audit = best(i + 1, q, 0)
            found.append((cost + 4, "D" + audit))
            if not code & OUT:
                extra, own = 3 if code & CUT else 0, "?sua"[code & 3]
                if own == nexts[q] or (own == "s" and q == ""):
                    cost, audit = best(i + 1, own, 0)
                    found.append((cost + extra, "K" + audit))
                cost, audit = best(i + 1, nexts[q], 0)
                found.append((cost + 3 + extra, "R" + audit))
        return min(found, default=(10**9, ""))

    return best(0, "", 0)


CODES = [i | f for i in range(4) for f in (0, OUT, CUT)]


def test_cheapest_is_the_least_of_all_edits():
    for n in (0, 1, 2):
        for codes in itertools.product(CODES, repeat=n):
            assert structure_repair.cheapest(bytes(codes)) == all_edits(codes), codes
    rng = random.Random(1)
    for _ in range(25):
        codes = [rng.choice(CODES) for _ in range(3)]
        assert structure_repair.cheapest(bytes(codes)) == all_edits(codes) == by_strings(tuple(codes))


def test_cheapest_equals_string_search_on_longer_rows():
    rng = random.Random(2)
    for n in (4, 5, 8, 13, 40, 150):
        for _ in range(20):
            codes = tuple(rng.choice(CODES) for _ in range(n))
            assert structure_repair.cheapest(bytes(codes)) == by_strings(codes)


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        kept += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def expected_repair(rows, order):
    white = " \t\n\x0b\x0c\r"
    for conv, own in damaged(rows).items():
        own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], order[r[2]]))
        seen, codes, counts = set(), [], [0, 0, 0]
        for _, role, text in own:
            code = {"s": 1, "u": 2, "a": 3}.get(role[:1], 0)
            fault = 0 if not text.strip(white) else 1 if (role, text) in seen else 2 if text.rstrip(white)[-1] not in ".!?" else None
            if fault is not None:
                counts[fault] += 1
                code |= CUT if fault == 2 else OUT
            seen.add((role, text))
            codes.append(code)
        cost, audit = by_strings(tuple(codes))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        lines, i = [], 0
        for letter in audit:
            nxt = "assistant" if lines and lines[-1][0] == "u" else "user"
            if letter == "I":
                lines.append(f"{nxt}:")
                continue
            if letter != "D":
                lines.append(f"{own[i][1] if letter == 'K' else nxt}:{own[i][2]}")
            i += 1
        assert i == len(own)
        yield conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def _text_order(spark, rows):
    """Place of each text in the order of its hashes, which decides among rows of one turn and role."""
    texts = sorted({r[2] for own in damaged(rows).values() for r in own})
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    return {t: i for i, (t,) in enumerate(frame.orderBy(F.xxhash64("text"), F.xxhash64("text", F.lit(1))).collect())}


def test_structure_repair_equals_brute_force(spark, conversations):
    want = sorted((r[:-1] for r in expected_repair(_rows(), _text_order(spark, _rows()))), key=repr)
    got = structure_repair.structure_repair(conversations)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_repaired_rows_are_legal_conversations(spark, conversations):
    rows = structure_repair.damage(conversations)
    got = structure_repair.repaired(rows, structure_repair.decide(rows))
    lines = {}
    for r in got.orderBy("conv_id", "place").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    want = {r[0]: r[-1] for r in expected_repair(_rows(), _text_order(spark, _rows())) if r[-1]}
    assert lines == want
    assert all(re.fullmatch("s?(ua)+", "".join(x[0] for x in v)) for v in lines.values())


def test_structure_repair_of_an_empty_table_and_of_dropped_rows(spark, conversations):
    assert structure_repair.structure_repair(conversations.where(F.lit(False))).count() == 0
    dropped = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    one = spark.createDataFrame([(5, dropped, "user", "gone.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in structure_repair.structure_repair(one).collect()] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# ---- trie


def expected_nodes(rows):
    key = lambda role, text: hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", key(role or "", text or ""), text or ""))
    own = {c: [(r[2], r[4]) for r in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rest = abs(c) % 5 * (1 if c >= 0 else -1)  # the sign of a remainder is that of c
        built[c] = tuple(own.get(c - rest, [])[:h] + turns[h:])
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []
    for p, who in members.items():
        below, stack = [], [p]
        while stack:
            q = stack.pop()
            below.append(q)
            stack += children.get(q, [])
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in who if len(built[c]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(who), len(p), parent, len(who), len(children.get(p, [])), sum(q not in children for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("split", "limit"), [(1, 1), (3, 10), (128, 20_000)])
def test_prefix_trie_equals_brute_force(conversations, split, limit):
    got = prefix_trie.prefix_trie(conversations, split, limit)
    assert sorted(map(tuple, got.collect()), key=repr) == expected_nodes(_rows())


def test_prefix_trie_of_few_conversations(spark, conversations):
    assert prefix_trie.prefix_trie(conversations.where(F.lit(False))).count() == 0
    # conversation 8 has no own turn behind its head and its family's first is absent: the root alone
    heads = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(heads, 0, "user", "only")]
    one = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in prefix_trie.prefix_trie(one).collect()]
    assert got == expected_nodes(rows) == [(heads, 0, None, 1, 0, 1, 0, hashlib.sha256(str(heads).encode()).hexdigest())]


def test_prefix_trie_query_equals_its_sql(spark):
    import duckdb

    from tripleloom.llm import queries

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    cur = con.execute(queries.FAMILY.oracles["op13_prefix_trie"])
    want, names = cur.fetchall(), [c[0] for c in cur.description]
    got = queries.FAMILY.queries["op13_prefix_trie"](spark, folder).select(*names)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and len(want) > 20


def test_double_array_finds_every_child_and_no_other():
    rng = np.random.default_rng(3)
    sequences = [rng.integers(1, 40, rng.integers(0, 9)) for _ in range(400)]
    codes, ends = np.concatenate(sequences), np.cumsum([len(s) for s in sequences])
    trie = prefix_trie.DoubleArray.pack(codes, ends)
    known = {(): 0}
    for s in sequences:
        node = np.zeros(1, np.int64)
        for d, c in enumerate(s):
            node = trie.walk(node, np.array([c]))
            assert node[0] > 0 and known.setdefault(tuple(s[: d + 1]), int(node[0])) == node[0]
    assert len(set(known.values())) == len(known) == (trie.check >= 0).sum()
    for prefix, at in known.items():
        absent = [c for c in range(1, 45) if (*prefix, c) not in known]
        assert (trie.walk(np.full(len(absent), at), np.array(absent)) == -1).all()
