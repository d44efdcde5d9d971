import json
import uuid

import pytest
from pyspark.sql import functions as F

from tripleloom.sources import readers, writers
from tripleloom.streaming import flows


def test_nested_case_file(spark, tmp_path):
    cases = [
        {"original_data": {"编号": "A1", "测试用例名称": "n", "测试用例类型": "t", "前提条件": "x；y", "执行动作": "1\n2", "预期行为": "ok"}, "前提条件_分割": []},
        {"original_data": {"编号": "", "执行动作": "go"}, "前提条件_分割": ["p ", ""]},
    ]
    (tmp_path / "cases.json").write_text(json.dumps({"test_cases": cases}, ensure_ascii=False, indent=1), encoding="utf-8")
    rows = readers.read_cases(spark, str(tmp_path / "cases.json")).orderBy("source_row").collect()
    assert (rows[0].case_id, rows[0].preconditions, rows[0].actions, rows[0].unique_id) == ("A1", ["x", "y"], ["1", "2"], "A1_0")
    assert (rows[1].case_id, rows[1].case_name, rows[1].preconditions, rows[1].unique_id) == ("case-1", "case-1", ["p"], "ROW_1")
    assert rows[0].source == "cases.json"


def test_strict_and_tolerant_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": \n', encoding="utf-8")
    path = str(tmp_path / "x.jsonl")
    assert [r.a for r in readers.read_jsonl(spark, path, "a int", strict=False).collect()] == [1]
    with pytest.raises(Exception, match="malformed JSON line"):
        readers.read_jsonl(spark, path, "a int").collect()


def test_document_triples_skip_the_aggregate(spark, tmp_path):
    root = tmp_path / "final"
    for folder, head in ((root, "all"), (root / "lamp", "h1"), (root / "door", "h2")):
        folder.mkdir(parents=True, exist_ok=True)
        data = [{"head": head, "relation": "r", "tail": "t", "sources": ["i"], "conflict": False}, {"head": "", "relation": "", "tail": ""}]
        (folder / "knowledge_graph.json").write_text(json.dumps(data), encoding="utf-8")
    got = {(r.doc_name, r.head) for r in readers.read_doc_triples(spark, str(root)).collect()}
    assert got == {("lamp", "h1"), ("door", "h2")}


def test_manifest_of_image_folders(spark, tmp_path):
    for name in ("b.PNG", "a.jpg", "notes.txt"):
        (tmp_path / name).write_bytes(b"x")
    rows = readers.build_manifest(spark, {"doc": ("Lamp", str(tmp_path))}).orderBy("image_id").collect()
    assert [(r.image_id, r.file_name) for r in rows] == [("doc_0001", "a.jpg"), ("doc_0002", "b.PNG")]


def test_versions_and_safety_tables(spark, tmp_path):
    root = str(tmp_path / "state")
    assert writers.read_version(spark, root) is None
    writers.write_version(spark.range(3), root, 0)
    writers.write_version(spark.range(5), root, 1)
    assert writers.current_version(spark, root) == 1 and writers.read_version(spark, root).count() == 5
    row = spark.createDataFrame([("v", "1", "C", 'said "stop",\nthen fire', "True", "False", "1", "d")], readers.SAFETY_SCHEMAS["complaints"])
    for name, schema in readers.SAFETY_SCHEMAS.items():
        writers.write_csv(row if name == "complaints" else spark.createDataFrame([], schema), str(tmp_path / f"{name}.csv"))
    back = readers.read_safety(spark, str(tmp_path))["complaints"].collect()
    assert back == row.collect()


def test_windowed_risk_waits_for_the_watermark(spark, tmp_path):
    source, out = str(tmp_path / "in"), f"w_{uuid.uuid4().hex}"
    rows = [("BRAKE", "", "2024-01-01 00:01:00"), ("BRAKE", "", "2024-01-01 00:04:00"), ("", "x", "2024-01-01 02:00:00")]
    spark.createDataFrame(rows, "component string, summary string, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("component string, summary string, ts timestamp").parquet(source)
    query = flows.windowed_risk(stream, "ts", "10 minutes", "5 minutes").writeStream.outputMode("append").format("memory").queryName(out)
    run = query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = [(r.risk_scenario, r.complaint_count) for r in spark.table(out).collect()]
    assert got == [("braking_failure_or_abnormal_braking", 2)]


def test_json_lines_state_in_versions(spark, tmp_path):
    from tripleloom.sources import writers

    root, schema = str(tmp_path / "state"), "id bigint"
    assert writers.read_jsonl_state(spark, root, schema) is None
    assert writers.write_jsonl_state(spark.range(3), root) == 1
    first = writers.read_jsonl_state(spark, root, schema)
    assert writers.write_jsonl_state(spark.range(5), root) == 2
    spark.range(9).write.json(f"{root}/data/broken")
    assert writers.read_jsonl_state(spark, root, schema).count() == 5 and first.count() == 3
    assert [p["rows"] for p in writers._pointers(spark, root)] == [3, 5]
    assert writers.read_jsonl_state(spark, root, schema, version=1).count() == 3
    assert writers.write_jsonl_state(spark.range(0), root) == 3 and writers.read_jsonl_state(spark, root, schema).count() == 0
    assert writers.compact_jsonl_state(spark, root, keep=1) == 3
    assert writers.read_jsonl_state(spark, root, schema).count() == 0
