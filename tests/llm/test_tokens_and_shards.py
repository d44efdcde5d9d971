"""Byte BPE, packing and sharding on the odd table, against the tokenizer libraries and brute force."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tripleloom.llm import byte_bpe, packing, sharding

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@pytest.fixture(scope="module")
def reference(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary(ranks):
    return byte_bpe.Vocabulary(ranks, public_tokenizers.PATTERN)


def test_perfect_hash_is_minimal(vocabulary, ranks):
    slots = [vocabulary.hash.slot(k) for k in ranks]
    assert sorted(slots) == list(range(len(ranks)))
    assert all(vocabulary.rank(k) == i for k, i in ranks.items())
    assert vocabulary.rank(b"no such token at all") is None


ALPHABET = "ab  \n\t é1٣'s'll!?\x1c\x85世界😀 \r　 "


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=40), max_size=4))
def test_ids_equal_the_library(vocabulary, reference, texts):
    flat, counts = byte_bpe.Encoder(vocabulary).encode(texts)
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(int)
    for text, a, b in zip(texts, ends, ends[1:]):
        assert flat[a:b].tolist() == reference.encode_ordinary(text)


def test_long_word_and_memo_limit(vocabulary, reference):
    word = "".join(random.Random(2).choices("abcdefgh", k=30_000))
    encoder = byte_bpe.Encoder(vocabulary)
    encoder.memo.limit = 3
    for text in (word, "one two three four five", word):
        assert encoder.encode([text])[0].tolist() == reference.encode_ordinary(text)
    assert len(encoder.memo) < 10


def test_encode_decode_table(docs, empty, vocabulary, reference):
    encoded = byte_bpe.encode(docs, vocabulary, with_decoded=True)
    texts = Counter((r[0], r[1] or "") for r in docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in encoded.collect()) == texts
    digests = byte_bpe.digests(encoded).collect()
    want = Counter()
    for (doc, text), n in texts.items():
        ids = reference.encode_ordinary(text)
        want[doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += n
    assert Counter(map(tuple, digests)) == want
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in byte_bpe.decode(byte_bpe.encode(docs, vocabulary), vocabulary).collect()) == texts
    assert byte_bpe.encode(empty, vocabulary).count() == 0


def test_decoding_unknown_ids_fails(vocabulary):
    with pytest.raises(ValueError):
        vocabulary.decode(np.array([10_000_000]))
    assert len(vocabulary.decode(np.array([], np.int64))[0]) == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 25), max_size=12))
def test_plan_places_everything_once(counts):
    runs = packing.plan(counts, 30)
    room, seen = {}, Counter()
    for length, rank, n, first, offset in runs:
        assert rank == seen[length]
        seen[length] += n
        for i in range(n):
            room.setdefault(first + i, []).append((offset, length))
    assert seen == Counter(counts)
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 30
    # never two sequences that could be one
    free = sorted(30 - sum(length for _, length in p) for p in room.values())
    assert sum(f >= 15 for f in free) <= 1


def test_packing_table(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    rows = packing.packing(docs, WORDS).toPandas()
    want = Counter()
    for doc, text in docs.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want[-1 if doc is None else doc, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    rows["doc_id"] = rows["doc_id"].fillna(-1).astype(int)
    assert Counter(map(tuple, rows[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == want
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 2048
    assert rows.sequence_id.nunique() <= rows.length.sum() / 2048 + 2
    assert packing.packing(empty, WORDS).count() == 0


def test_sequences_hold_their_pieces(docs):
    pieces = packing.materialise(packing.tokenize(docs, WORDS))
    packed = packing.pack(pieces)
    total = sum(len(r.ids) for r in pieces.select("ids").collect())
    sequences = packing.assemble(packed).collect()
    assert sum(len(r.ids) for r in sequences) == total and max(len(r.ids) for r in sequences) <= 4 * 2048


def minimax(sizes, shards):
    def enough(capacity):
        used, held = 1, 0
        for s in sizes:
            if held + s > capacity:
                used, held = used + 1, 0
            held += s
        return used <= shards

    low, high = max(max(sizes), -(-sum(sizes) // shards)) - 1, sum(sizes)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if enough(middle) else (middle, high)
    return high


@pytest.mark.parametrize(("shards", "points"), [(40, 40_000), (7, 8), (3, 2), (500, 20)])
def test_shards_are_minimax(docs, shards, points):
    rows = sharding.shard(docs, shards, points=points).toPandas()
    texts = docs.select("doc_id", "text").toPandas()
    groups = Counter()
    for text in texts["text"]:
        raw = (text or "").encode()
        groups[hashlib.sha256(raw).hexdigest()] += len(raw) + 16
    sizes = [n for _, n in sorted(groups.items())]
    assert len(rows) == len(texts)
    assert rows.groupby("shard")["size"].sum().max() == minimax(sizes, shards)
    assert rows["shard"].between(0, shards - 1).all() and rows["grown_shard"].isna().all() and set(rows["law"]) == {"bytes"}
    for _, own in rows.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    crc = {(-1 if d != d or d is None else int(d)): zlib.crc32((t or "").encode()) for d, t in texts.itertuples(index=False)}
    assert all(crc[-1 if d != d or d is None else int(d)] == c for d, c in rows[["doc_id", "text_crc32"]].itertuples(index=False))


def test_equal_texts_share_a_shard(docs):
    rows = sharding.shard(docs, 5).collect()
    hot = {r.shard for r in rows if r.doc_id is not None and 120 <= r.doc_id < 160}
    assert len(hot) == 1 and len({r.shard for r in rows if r.doc_id in (100, 101)}) == 1


def test_shards_of_empty_table(empty):
    assert sharding.shard(empty).count() == 0


def test_memos_hold_bounded_bytes_of_text_without_blanks(vocabulary, reference):
    rng = random.Random(6)
    encoder = byte_bpe.Encoder(vocabulary)
    encoder.memo.most = 8 << 20
    most = 0
    for _ in range(10):
        text = "".join(chr(rng.randrange(0x4E00, 0x9000)) if rng.random() > 0.03 else "。" for _ in range(170_000))  # 0.5 MB
        flat, _ = encoder.encode([text])
        most = max(most, encoder.memo.held)
        assert encoder.known.held < encoder.memo.most
    assert most < (8 << 20) + 6 * len(text.encode())
    assert flat.tolist() == reference.encode_ordinary(text)
