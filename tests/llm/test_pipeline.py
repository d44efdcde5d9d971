"""The pipeline stage by stage, and the registered queries."""

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import __spark_entry__ as E  # noqa: E402
import corpus_pipeline  # noqa: E402
from tripleloom.llm import language_id, quality_classifier  # noqa: E402

from .test_near_copies import brute_groups  # noqa: E402


@pytest.fixture(scope="module")
def folder(docs, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    junk = spark.createDataFrame([(1000 + i, f"THE{i}!! CAT!! OF!! HOUSE{i * 3}!! " * 20, "en", "src9", 500, 0, 0, "", "", 0) for i in range(30)], docs.schema)
    docs.unionByName(junk).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 60, 2)] + [(1000 + i, 0, 0) for i in range(15)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_are_those_of_the_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "simhash_near_dedup", "best_fit_packing"]
    names = {n.split("_")[0] for n in E.queries() if n.startswith("op")}
    assert names == {f"op{i}" for i in range(1, 14)} and "pipeline" in E.queries()
    assert "op2_exact_top_k" in E.oracle_sql() and "pipeline" not in E.oracle_sql()


def test_pipeline_equals_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    predicted = {(r.doc_id, r.lang_pred, r.score >= 0.3) for r in language_id.predict(docs, language_id.train(docs)).collect()}
    stays = {d for d, lang, sure in predicted if lang != "und" and sure}
    known = docs.where("doc_id is null or doc_id in ({})".format(",".join(str(d) for d in stays if d is not None)))
    known = language_id.identified(known)
    good = {r.doc_id for r in quality_classifier.score(known, quality_classifier.train(known, labels)).collect() if r.kept}
    assert not any(d is not None and d >= 1000 for d in good) and set(range(60)) <= good
    kept = quality_classifier.good(known, labels)
    texts = [(r.doc_id, r.text) for r in kept.where("doc_id is not null").collect()]
    groups = {min(texts[i][0] for i in g) for g in brute_groups(texts)}
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows if r.doc_id is not None} == groups
    assert None in {r.doc_id for r in rows}
    per_sequence = Counter()
    for r in rows:
        per_sequence[r.sequence_id] += r.length
    assert max(per_sequence.values()) <= 2048
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows)


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes
        assert stage(spark, docs.where("false"), folder).count() == 0
