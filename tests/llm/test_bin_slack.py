"""Packing by minimum bin slack against exhaustive search, the tokenizer library and an account of every token."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from tripleloom.llm import bin_slack, packing

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_best_fill_is_closest_of_all_multisets():
    rng = random.Random(7)
    for _ in range(150):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(1, 5))}
        room = rng.randint(0, 60)
        lengths = sorted(counts)
        chosen = bin_slack.best_fill(lengths, counts, room)
        sums = [sum(x * n for x, n in zip(lengths, ns)) for ns in itertools.product(*(range(counts[x] + 1) for x in lengths))]
        assert sum(x * n for x, n in chosen.items()) == max(s for s in sums if s <= room)
        assert all(0 < n <= counts[x] for x, n in chosen.items())


def laid_out(counts, capacity):
    """The plan checked piece by piece: every token once, sequences gapless; gives the sizes of the sequences and the cut pieces."""
    tokens, sequences = defaultdict(list), defaultdict(list)
    for full, rank, n, start, size, first, offset in bin_slack.plan(counts, capacity):
        for i in range(n):
            tokens[full, rank + i].append((start, size))
            sequences[first + i].append((offset, size))
    assert sorted(tokens) == sorted((x, r) for x, n in counts.items() for r in range(n))
    for (full, _), parts in tokens.items():
        at = 0
        for start, size in sorted(parts):
            assert start == at
            at += size
        assert at == full
    sizes = []
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at and size > 0
            at += size
        sizes.append(at)
    assert sorted(sequences) == list(range(len(sequences)))
    return sizes, sum(len(p) > 1 for p in tokens.values())


@pytest.mark.parametrize("capacity", [16, 30, 64])
def test_plans_leave_no_padding(capacity):
    rng = random.Random(capacity)
    for _ in range(60):
        counts = {rng.randint(1, capacity): rng.choice([1, 2, 7, 40, 300]) for _ in range(rng.randint(1, 12))}
        sizes, _ = laid_out(counts, capacity)
        open_ones = [s for s in sizes if s != capacity]
        assert all(s & (s - 1) == 0 for s in open_ones) and sum(open_ones) < capacity and len(set(open_ones)) == len(open_ones)


def test_pieces_are_cut_only_where_no_multiset_fits():
    assert laid_out({10: 4, 6: 4, 16: 3, 8: 2}, 16) == ([16] * 8, 0)
    # one length that fits no other: each pair of windows shares a piece
    sizes, cut = laid_out({9: 16}, 16)
    assert sizes == [16] * 9 and 0 < cut < 16
    assert laid_out({}, 16) == ([], 0)


def test_plan_does_not_grow_with_the_corpus():
    rng = random.Random(2)
    counts = {x: rng.randint(1, 50) for x in range(1, 200)}
    assert len(bin_slack.plan({x: n * 10**9 for x, n in counts.items()}, 256)) < 60 * len(bin_slack.plan(counts, 256)) < 10**6


def test_packed_table_equals_the_tokenizer(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    want = defaultdict(list)
    for row in docs.select("doc_id", "text").collect():
        want[row[0]].append([*tokenizer.encode(row[1] or "", add_special_tokens=False).ids, 2])
    for capacity in (4096, 64):
        rows = bin_slack.minimum_slack(docs, WORDS, capacity=capacity).toPandas()
        assert list(rows.columns) == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        assert rows.length.sum() == sum(len(x) for v in want.values() for x in v)
        for doc_id, own in rows.groupby("doc_id", dropna=False):
            texts = want[None if np.isnan(doc_id) else int(doc_id)]
            assert own.doc_tokens.isin([len(t) for t in texts]).all()
            assert all(any(zlib.crc32(np.array(t[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for t in texts if len(t) == r.doc_tokens) for r in own.itertuples())
            copies = own.groupby("start").length.sum()
            if len(texts) == 1:
                assert copies.sum() == len(texts[0])
        for _, own in rows.sort_values("offset").groupby("sequence_id"):
            assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]]
        totals = rows.groupby("sequence_id").length.sum()
        short = totals[totals < capacity]
        assert totals.max() <= capacity and short.sum() < capacity and all(int(s).bit_count() == 1 for s in short)
    assert bin_slack.minimum_slack(empty, WORDS).count() == 0


def test_ids_come_with_the_parts(docs):
    parts = bin_slack.minimum_slack(docs, WORDS, capacity=128, keep_ids=True).collect()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in parts)


def test_special_tokens_are_found_by_case(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    texts = ["x <|ENDOFTEXT|> y", "<|StartOfText|>", "a<|endoftext|>b.", "<|endoftext|>", "<|", "A<|b|>C.", "end<|STARTOFTEXT|>, of", "<|startoftext|><|endoftext|>!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.tokenize(docs, WORDS).collect()}
    assert got == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}


def test_ids_of_odd_words_equal_the_library():
    from tokenizers import Tokenizer

    with open(WORDS, encoding="utf-8") as file:
        spec = file.read()
    reference = Tokenizer.from_str(spec)
    tokenizer, closing, memo = packing._worker_memo(spec, 0)
    memo.put("", [])
    rng = random.Random(1)
    letters = "aàßİıΣσςéÉñ世界ǅﬁ.,;:!?'’-_1² <|>\u0301\u0345ªºⅧ"
    for text in ("".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)):
        own = text.split(" ")
        packing._learn(tokenizer, closing, memo, [w for w in set(own) if w not in memo])
        assert memo.ids(own, [len(own)])[0].tolist() == reference.encode(text, add_special_tokens=False).ids, text
