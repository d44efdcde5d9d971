"""WARC bundles, exact top-k, SimHash and language-model scores against brute force."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from tripleloom.llm import components, ppm, simhash, topk, warc


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h{i % 3}.example/{i}", f"<p>{'body %d ' % (i % 9) * (40 if i % 2 else 300)}</p>") for i in range(120)]
    rows += [(200, None, None), (201, "http://x.example/a b\r\nc", ""), (None, "http://n.example/", "<p>" + "n" * 2000), (None, None, "<p>" + "n" * 2000)]
    rows += [(210 + i, "http://hot.example/", "é" * 600) for i in range(50)] + [(205, "u", "r" * 1200), (205, "u", "r" * 1200), (204, "u", "r" * 1200), (300, "u", "y" * 400_000)]
    return spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, size int, digest string").repartition(4)


def wanted(pages):
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    best = {}
    for page, raw in rows:
        if page is not None and len(raw) >= 1000:
            best[raw] = max(best.get(raw, page), page)
    out = Counter()
    for page, raw in rows:
        target = best.get(raw)
        revisit = target is not None and page != target
        out[page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", target if revisit else None] += 1
    return out


def test_archives_round_trip(pages, tmp_path):
    index = warc.write(pages, str(tmp_path), bundle_bytes=100_000, frame_bytes=20_000)
    found = warc.read_back(index, str(tmp_path), with_payload=True).collect()
    assert Counter(tuple(r)[:5] for r in found) == wanted(pages)
    payloads = {hashlib.sha1((r.html or "").encode()).hexdigest(): (r.html or "").encode() for r in pages.collect()}
    assert all(bytes(r.payload) == payloads[r.payload_digest] for r in found if r.record_type == "response")
    assert index.select("bundle").distinct().count() >= 2


def test_bundles_are_plain_zstandard_with_a_seek_table(pages, tmp_path):
    index = warc.write(pages, str(tmp_path), frame_bytes=20_000)
    for file in tmp_path.glob("*.warc.zst"):
        raw = file.read_bytes()
        count, _, magic = struct.unpack("<IBI", raw[-9:])
        assert magic == 0x8F92EAB1 and struct.unpack("<I", raw[-9 - 8 * count - 8 :][:4])[0] == 0x184D2A5E
        whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        own = index.where(F.col("bundle") == file.name.split(".")[0]).collect()
        reader = warc.BundleReader(str(tmp_path), file.name.split(".")[0])
        begins = np.cumsum([0, *[w for _, _, w in reader.frames]])
        for r in own:
            assert whole[begins[r.frame] + r.offset :].startswith(b"WARC/1.1\r\n")
            assert reader.frame(r.frame)[r.offset : r.offset + r.length].endswith(b"\r\n\r\n")


def test_fetch_reads_chosen_records(pages, tmp_path):
    index = warc.write(pages, str(tmp_path), frame_bytes=20_000)
    chosen = index.where("page_id in (3, 7, 300, 201)")
    found = {r.page_id: r for r in warc.fetch(chosen, str(tmp_path)).collect()}
    assert set(found) == {3, 7, 300, 201} and bytes(found[300].payload) == b"y" * 400_000
    assert found[201].url == "http://x.example/a b c"


def test_archive_of_empty_table(pages):
    assert warc.archive(pages.where("false")).count() == 0


def test_cut_record_is_an_error():
    whole = warc.record(1, "u", b"x" * 50, 50, hashlib.sha1(b"x" * 50).hexdigest(), None)
    with pytest.raises(ValueError):
        warc.parse(whole[:-10])


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8) / 3]) for i in range(300)]
    rows += [(400 + i, [0.5] * 8) for i in range(60)] + [(500, None), (501, []), (502, [1.0] * 7 + [float("nan")]), (503, [float("inf")] * 8), (504, [None] + [1.0] * 7)]
    rows += [(None, [1.0] * 8), (520, [0.1, 0.2]), (521, [0.3, -0.2]), (40, [0.9] * 8), (60, rows[60][1]), (540, [0.0] * 8), (560, [30.0] * 8)]
    return spark.createDataFrame([(*r, 5, 5) for r in rows], "vec_id long, embedding array<float>, label int, score int").repartition(3)


def brute_top(vectors, k, modulus):
    rows = [(r.vec_id, tuple(math.floor(64 * float(np.float32(x))) for x in r.embedding)) for r in vectors.collect() if r.vec_id is not None and r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding)]
    out = Counter()
    for own, q in {r for r in rows if r[0] % modulus == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i != own and len(v) == len(q))
        out.update((own, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1))
    return out


@pytest.mark.parametrize(("k", "block", "batch"), [(20, 16384, 128), (3, 50, 7), (500, 90, 128)])
def test_top_k_equals_brute_force(vectors, monkeypatch, k, block, batch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "QUERY_ROWS", 10)
    monkeypatch.setattr(topk, "BATCH", batch)
    monkeypatch.setattr(topk, "FEW", 1)
    assert Counter(map(tuple, topk.top_k(vectors, F.col("vec_id") % 20 == 0, k).collect())) == brute_top(vectors, k, 20)


def test_top_k_of_empty_table(vectors):
    assert topk.top_k(vectors.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
    words = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_equal_brute_force(docs, empty):
    found = simhash.near_duplicates(docs).withColumn("hex", simhash.hexadecimal()).collect()
    rows = [(r.doc_id, brute_print(r.text)) for r in docs.select("doc_id", "text").collect()]
    assert Counter((r.doc_id, r.hex) for r in found) == Counter((d, f"{p:016x}") for d, p in rows)
    prints = sorted({p for _, p in rows})
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for d, p in rows:
        if d is not None:
            least[find(p)] = min(least.get(find(p), d), d)
    assert {(r.hex, r.component_id) for r in found} == {(f"{p:016x}", least.get(find(p))) for _, p in rows}
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("limit", "blocks"), [(4096, 4), (16, 4), (4096, 5), (4096, 6)])
def test_links_in_dense_groups(spark, monkeypatch, limit, blocks):
    rng = np.random.default_rng(limit)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    codes = set(centres.tolist())
    for c in centres.tolist():
        for _ in range(25):
            flips = rng.choice(64, rng.integers(1, 5), replace=False)
            codes.add(c ^ sum(1 << int(f) for f in flips))
    codes = sorted(codes)
    monkeypatch.setattr(simhash, "blocks_for", lambda *a: blocks)
    table = simhash.materialise(spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "fp long"))
    found = components.components(simhash.near_links(table, group_limit=limit), "a", "b").collect()
    groups = {}
    for r in found:
        groups.setdefault(r.root, set()).add(r.node % (1 << 64))
    own = {c: {c} for c in codes}
    for i, a in enumerate(codes):
        for b in codes[i + 1 :]:
            if (a ^ b).bit_count() <= 3 and own[a] is not own[b]:
                own[a] |= own[b]
                for x in own[b]:
                    own[x] = own[a]
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in own.values() if len(g) > 1}


def test_gray_ranks_follow_single_bit_steps():
    codes = np.arange(64, dtype=np.uint64)
    ordered = codes[np.argsort(simhash.gray_rank(codes))]
    assert (np.bitwise_count(ordered[1:] ^ ordered[:-1]) == 1).all()


def test_one_of_each_group_stays(docs):
    kept = simhash.one_of_each(docs)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert kept.columns == docs.columns and ids.count(110) <= 1 and sum(i is not None and 120 <= i < 160 for i in ids) == 1
    assert {r.component_id for r in simhash.near_duplicates(docs.where("doc_id is not null")).collect()} == {i for i in ids if i is not None}


def test_components_of_a_chain(spark):
    rows = [(i, i + 1) for i in range(0, 100)] + [(200, 201), (201, 200), (300, 300), (None, 5)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(rows, "x long, y long"), "x", "y").collect()}
    assert found == {i: 0 for i in range(101)} | {200: 200, 201: 200}


def brute_ppm(training, texts, order, share):
    """Dictionary trie, symbol by symbol."""
    contexts = {}
    sequences = [b"\xff" * order + t + b"\xff" for t in training]
    total = sum(len(t) + 1 for t in training)
    for s in sequences:
        for i in range(order, len(s)):
            for d in range(order + 1):
                contexts.setdefault(s[i - d : i], Counter())[s[i]] += 1
    ends = Counter(s[i - d + 1 : i + 1] for s in sequences for i in range(order, len(s)) for d in range(3, order + 1))

    def is_node(c):
        if len(c) <= 2:
            return not c or sum(contexts.get(c, Counter()).values()) >= share * total and is_node(c[1:])
        return ends[c] >= share * total and is_node(c[1:]) and is_node(c[:-1]) and contexts.get(c[:-1], {}).get(c[-1], 0) >= share * total

    out = []
    for t in texts:
        s, bits = b"\xff" * order + t + b"\xff", 0.0
        for i in range(order, len(s)):
            depth = max(d for d in range(order + 1) if is_node(s[i - d : i]))
            escape, gone = 1.0, set()
            for d in range(depth, -1, -1):
                counts = {b: n for b, n in contexts.get(s[i - d : i], {}).items() if b not in gone}
                n, q = sum(counts.values()), len(counts)
                if len(gone | set(counts)) == 256:
                    q = 0
                if s[i] in counts:
                    bits += math.log10(escape * counts[s[i]] / (n + q))
                    break
                if n:
                    escape *= q / (n + q)
                gone |= set(counts)
            else:
                bits += math.log10(escape / (256 - len(gone)))
        out.append(bits)
    return out


def test_scores_equal_brute_force(docs, empty):
    rows = [r for r in docs.select("doc_id", "text").collect() if r.text is None or len(r.text) < 3000]
    small = docs.where("text is null or length(text) < 3000")
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    training = [(r.text or "").encode() for r in rows if not held(r.doc_id)]
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0d]+", bytes(b + 32 if 65 <= b <= 90 else b for b in t)), b" "]
    counts = Counter(w for t in training for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    share = 2.0**-9
    scores = brute_ppm(training, [(r.text or "").encode() for r in rows], 4, share)
    want = sorted((-1 if r.doc_id is None else r.doc_id, held(r.doc_id), len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), s) for r, s in zip(rows, scores) for own in [tokens((r.text or "").encode())])
    found = sorted((-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in ppm.lm_scores(small, order=4, share=share).collect())
    assert [r[:5] for r in found] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in found], [r[5:] for r in want], rtol=1e-5)
    assert ppm.lm_scores(empty).count() == 0


def test_probabilities_sum_to_one():
    trie = ppm.Trie(2)
    rng = np.random.default_rng(0)
    vector = lambda n: np.bincount(rng.integers(0, n, 50), minlength=256).astype(float)
    trie.counts[0] = np.ones(256, np.float32)
    trie.add({b"a": vector(9), b"b": vector(256)})
    trie.add({b"ca": vector(3), b"xb": np.zeros(256)})
    sums = (10.0 ** trie.code_lengths()).sum(axis=1)
    assert np.allclose(np.delete(sums, 1), 1, atol=1e-4)


def test_untrained_model_is_uniform(docs):
    only_held_out = docs.where("crc32(cast(doc_id as string)) % 5 = 1 and length(text) < 1000")
    for r in ppm.lm_scores(only_held_out).join(only_held_out.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r.score == pytest.approx(-(len(r.text.encode()) + 1) * math.log10(256), rel=1e-5) and abs(r.base_score) < 1e-9 and r.n_known == 0
