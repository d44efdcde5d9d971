"""Near copies of the pipeline against brute-force Jaccard similarity."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from tripleloom.llm import near_copies  # noqa: E402


def brute_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(rows):
    """Positions of rows, joined by similarities of 0.8 or more."""
    sets = [brute_set(t) for _, t in rows]
    own = {i: {i} for i in range(len(rows))}
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (a == b or len(a & b) >= 0.8 * len(a | b)) and own[i] is not own[j]:
                own[i] |= own[j]
                for x in own[j]:
                    own[x] = own[i]
    return {frozenset(g) for g in own.values()}


@pytest.fixture(scope="module")
def edited():
    """Texts with 0 to 6 changed words, some edited again, so that similarities lie around 0.8 and chains occur."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([6, 40, 100, 250]))]
        rows.append(" ".join(base))
        for changes in range(7):
            if changes == 4:
                base = rows[-1].split()
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
    return [(i, t) for i, t in enumerate(rows)] + [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  b"), (None, rows[0])]


@pytest.mark.parametrize("part_sets", [1024, 4])
def test_components_equal_brute_force(spark, edited, part_sets):
    docs = spark.createDataFrame(edited, "doc_id long, text string").repartition(5)
    found = near_copies.near_copies(docs, part_sets=part_sets).collect()
    assert len(found) == len(edited)
    groups = {}
    for r in found:
        groups.setdefault(r.component, set()).add(r.doc_id)
    assert {frozenset(g) for g in groups.values()} == {frozenset(edited[i][0] for i in g) for g in brute_groups(edited)}


def test_a_hot_group_of_copies_is_one_set_per_band(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near = [text.replace("w30 ", f"x{i} ") for i in range(300)]
    rows = [(i, text) for i in range(2000)] + [(5000 + i, t) for i, t in enumerate(near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = near_copies.prints(docs, "doc_id", "text")
    stars = near_copies._stars(found.groupBy("node").agg(F.first("bands").alias("bands")))
    assert stars.count() <= 300 and stars.select("node").distinct().count() == stars.count()
    kept = near_copies.one_of_each(docs).collect()
    assert [r.doc_id for r in kept] == [0]


def test_texts_that_share_a_passage_form_no_group(spark):
    rng = random.Random(3)
    shared = " ".join(f"s{i}" for i in range(64))
    rows = [(i, shared + " " + " ".join(f"p{rng.random()}" for _ in range(40))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    a, b = (brute_set(t) for _, t in rows[:2])
    assert 0.40 < len(a & b) / len(a | b) < 0.48
    sets = [near_copies.shingle_set(t) for _, t in rows]
    table = spark.createDataFrame([(i, i, len(x), x.tobytes()) for i, x in enumerate(sets)], "node long, label long, n long, hashes binary")
    assert near_copies._pairs(table, 0.8).count() == 0
    assert near_copies.near_copies(docs).select("component").distinct().count() == 3000


def test_prefix_pairs_miss_no_similar_pair(spark):
    rng = random.Random(5)
    sets = []
    for _ in range(60):
        base = {rng.randrange(3000) for _ in range(rng.choice([3, 20, 90]))}
        sets += [{x for x in base if rng.random() > 0.08} | {rng.randrange(3000) for _ in range(rng.randrange(6))} for _ in range(3)]
    rows = [(i, i, len(s), np.array(sorted(s), np.uint64).tobytes()) for i, s in enumerate(sets) if s]
    found = {(r.least, r.node) for r in near_copies._pairs(spark.createDataFrame(rows, "node long, label long, n long, hashes binary"), 0.8).collect()}
    want = {(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(want) > 10 and want <= found


def test_recall_on_the_documents_is_whole(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumnsRenamed({"lang": "node", "source": "key", "n_chars": "least"})
    kept = near_copies.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {min(rows[i][0] for i in g) for g in brute_groups(rows)}


def test_stage_takes_one_of_each_group(spark, edited):
    kept = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(edited, "doc_id long, text string"), "").collect()]
    assert sorted(kept) == sorted(min(edited[i][0] for i in g if edited[i][0] is not None) for g in brute_groups(edited))


def test_rows_of_one_id_and_rows_without_id(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    rows = [(1, one, 0), (1, two, 0), (2, one, 1), (3, two, 1), (None, three, 2), (None, three, 2), (None, one, 3)]
    kept = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, place int")).collect()
    assert sorted(tuple(r) for r in kept if r.doc_id is not None) == [(1, one, 0), (1, two, 0)]
    assert [tuple(r) for r in kept if r.doc_id is None] == [(None, three, 2)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_copies.one_of_each(empty).count() == 0


def test_simhash_alone_links_copies_of_like_fingerprint(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(1000))
    rows = [(4, text), (7, text + " more"), (8, " ".join(f"x{i}" for i in range(1000)))]
    monkeypatch.setattr(near_copies, "_stars", lambda bands_of: bands_of.sparkSession.createDataFrame([], "node long, least long"))
    kept = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [4, 8]
