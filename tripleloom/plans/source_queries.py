"""Source, sink and streaming queries; files are written from the benchmark tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources import readers, writers
from ..streaming import flows
from . import bindings as B
from .registry import Family
from .version_queries import DIFF_SQL, version

FAMILY = Family()
query = FAMILY.query


def scratch(spark) -> str:
    """New folder below the session's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/io-{uuid.uuid4().hex}"


@query(
    "read_cases",
    f"""WITH {B.CASES_SQL} SELECT case_id, case_name, test_type, array_to_string(preconditions, '|') AS preconditions, array_to_string(actions, '|') AS actions,
        array_to_string(expected_behaviors, '|') AS expected_behaviors FROM cases""",
)
def read_cases(spark, d):
    """Cases written as nested case files (one per test type) and read back."""
    cases = B.cases(spark, d)
    case = F.struct(
        F.struct(
            F.col("case_id").alias("编号"), F.col("case_name").alias("测试用例名称"), F.col("test_type").alias("测试用例类型"),
            F.array_join("preconditions", "；").alias("前提条件"), F.array_join("actions", "\n").alias("执行动作"),
            F.array_join("expected_behaviors", "; ").alias("预期行为"),
        ).alias("original_data"),
        F.when(F.col("test_type") == "2-HIGH", F.col("preconditions")).alias("前提条件_分割"),
    )
    # one file per customer-sized block, so that no file holds a whole type
    block = F.floor(F.col("source_row") / 500)
    files = cases.groupBy(block.alias("b")).agg(F.collect_list(case).alias("test_cases")).drop("b")
    path = scratch(spark)
    files.select(F.to_json(F.struct("test_cases")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_cases(spark, path).select(
        "case_id", "case_name", "test_type", *[F.array_join(c, "|").alias(c) for c in ("preconditions", "actions", "expected_behaviors")]
    )


@query(
    "csv_round_trip",
    f"WITH {B.COMPLAINTS_SQL} SELECT vehicle_key, odi_number, component, md5(summary) AS summary_md5, crash, fire, injury FROM complaints",
)
def csv_round_trip(spark, d):
    path = scratch(spark)
    rows = B.complaints(spark, d).select("vehicle_key", "odi_number", "component", "summary", "crash", "fire", "injury", F.lit("").alias("date_received"))
    writers.write_csv(rows, f"{path}/complaints.csv")
    back = readers.read_safety(spark, path, ["complaints"])["complaints"]
    return back.select("vehicle_key", "odi_number", "component", F.md5("summary").alias("summary_md5"), "crash", "fire", "injury")


@query("jsonl_round_trip", "SELECT doc_id, md5(text) AS text_md5, lang FROM documents")
def jsonl_round_trip(spark, d):
    path = scratch(spark)
    writers.write_jsonl(B.table(spark, d, "documents").select("doc_id", "text", "lang"), path)
    back = readers.read_jsonl(spark, path, "doc_id bigint, text string, lang string")
    return back.select("doc_id", F.md5("text").alias("text_md5"), "lang")


@query(
    "tolerant_jsonl",
    """SELECT doc_id, kind FROM (SELECT doc_id, CASE WHEN doc_id % 8 IN (1, 5) THEN 'rejected' ELSE 'read' END AS kind FROM documents)""",
)
def tolerant_jsonl(spark, d):
    """One line per document; every fourth has text or a second value behind the first and is rejected, whole lines are read."""
    path = scratch(spark)
    line = F.to_json(F.struct("doc_id", "text"))
    number = F.col("doc_id") % 8
    spoilt = F.when(number == 1, F.concat(line, F.lit(" trailing"))).when(number == 5, F.concat(line, line)).otherwise(F.concat(F.lit("  "), line, F.lit(" ")))
    B.table(spark, d, "documents").select(spoilt.alias("value")).union(spark.createDataFrame([("   ",)], "value string")).write.text(path)
    read = readers.read_jsonl(spark, path, "doc_id bigint", strict=False).select("doc_id", F.lit("read").alias("kind"))
    rejected = readers.rejected_jsonl(spark, path).select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), F.lit("rejected").alias("kind"))
    return read.unionByName(rejected)


@query(
    "read_document_triples",
    """SELECT 'doc_' || p_type AS doc_name, p_name AS head, 'MADE_BY' AS relation, p_brand AS tail, 's' || p_size AS sources FROM part""",
)
def read_document_triples(spark, d):
    """Triples written per document folder, next to an aggregate that must be skipped."""
    path = scratch(spark)
    part = B.table(spark, d, "part").select(
        F.concat(F.lit("doc_"), F.col("p_type")).alias("doc"), F.col("p_name").alias("head"), F.lit("MADE_BY").alias("relation"), F.col("p_brand").alias("tail"),
        F.array(F.concat(F.lit("s"), F.col("p_size"))).alias("sources"), F.lit(False).alias("conflict"), F.lit("").alias("conflict_note"),
    )
    part.write.partitionBy("doc").json(path)
    # the aggregate of all documents lies directly in the folder
    part.drop("doc").write.mode("append").json(path)
    found = readers.read_doc_triples(spark, path, "part-*.json", "doc=")
    return found.select("doc_name", "head", "relation", "tail", F.array_join("sources", ",").alias("sources"))


@query(
    "image_manifest",
    """SELECT p_type || '_' || n AS image_id, p_type AS doc_id, 'Pages of ' || p_type AS doc_name FROM (
         SELECT p_type, CASE WHEN n < 10 THEN '000' ELSE '00' END || n AS n FROM (SELECT DISTINCT p_type FROM part), (SELECT unnest(range(1, 4)) AS n))""",
)
def image_manifest(spark, d):
    """Three pages of each part type, one file each, written into a folder per type; the manifest numbers them by file name."""
    path = scratch(spark)
    part = B.table(spark, d, "part").select(F.col("p_type").alias("doc"), F.concat_ws(" ", "p_name", "p_brand").alias("value"))
    for _ in range(3):  # each run writes one file into each folder
        part.repartition("doc").write.mode("append").partitionBy("doc").text(path)
    types = [r[0] for r in part.select("doc").distinct().collect()]  # one folder of a manifest each
    folders = {t: (f"Pages of {t}", f"{path}/doc={t}") for t in types}
    return readers.build_manifest(spark, folders, suffixes=["txt"]).select("image_id", "doc_id", "doc_name")


@query(
    "entity_table",
    """WITH n AS (SELECT DISTINCT p_type AS label, p_name AS name FROM part) SELECT label, name, row_number() OVER (PARTITION BY label ORDER BY name) - 1 AS idx FROM n""",
)
def entity_table(spark, d):
    return readers.entity_table(B.table(spark, d, "part").select(F.col("p_type").alias("label"), F.col("p_name").alias("name")))


@query(
    "jsonl_versions",
    """SELECT 'before' AS reader, event_id, value FROM events WHERE event_type <> 'error'
       UNION ALL SELECT 'after', event_id, value + 1 FROM events""",
)
def jsonl_versions(spark, d):
    """A state written twice: a reader opened before the second write, and one after it and a broken third."""
    root, schema = scratch(spark), "event_id bigint, value double"
    events = B.table(spark, d, "events").select("event_id", "value", "event_type")
    writers.write_jsonl_state(events.where("event_type <> 'error'").drop("event_type"), root)
    before = writers.read_jsonl_state(spark, root, schema)
    writers.write_jsonl_state(events.select("event_id", (F.col("value") + 1).alias("value")), root)
    events.limit(5).write.json(f"{root}/data/broken")
    after = writers.read_jsonl_state(spark, root, schema)
    return before.withColumn("reader", F.lit("before")).unionByName(after.withColumn("reader", F.lit("after")))


@query("append_runs", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def append_runs(spark, d):
    """Event counts appended to a run log in two batches."""
    path = scratch(spark)
    counts = B.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    writers.append_runs(counts.where(F.col("event_type") < "m"), path)
    writers.append_runs(counts.where(F.col("event_type") >= "m"), path)
    return spark.read.schema("event_type string, n bigint, logged_at timestamp").json(path).select("event_type", "n")


@query(
    "stream_risk_counts",
    f"WITH {B.COMPLAINTS_SQL} SELECT vehicle_key, {B._CLASSIFY} AS risk_scenario, count(*) AS complaint_count FROM complaints GROUP BY 1, 2",
)
def stream_risk_counts(spark, d):
    """Complaints arriving as a file stream; the last state of the running counts."""
    path, sink = scratch(spark), f"risk_{uuid.uuid4().hex}"
    B.complaints(spark, d).select("vehicle_key", "component", "summary").repartition(4).write.parquet(path)
    arriving = spark.readStream.schema("vehicle_key string, component string, summary string").option("maxFilesPerTrigger", 2).parquet(path)
    counts = flows.stream_risk(arriving, B.COMPONENT_RULES, B.SUMMARY_RULES)
    out = scratch(spark)

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/{batch_id}")

    run = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}-{sink}").trigger(availableNow=True).start()
    run.awaitTermination()
    last = run.lastProgress["batchId"] if run.lastProgress else 0
    return spark.read.parquet(f"{out}/{last}")


@query("stream_diff_apply", f"WITH {DIFF_SQL} SELECT row, case_key, head, relation, tail, fact_hash, source_file FROM applied")
def stream_diff_apply(spark, d):
    """Two versions of the order facts arriving one after the other; the baseline after both."""
    path, root = scratch(spark), scratch(spark)
    first, second = version(spark, d, "current"), version(spark, d, "candidate")
    first.write.mode("append").parquet(path)
    schema = first.schema
    for step in (None, second):
        if step is not None:
            step.write.mode("append").parquet(path)
        arriving = spark.readStream.schema(schema).parquet(path)
        flows.stream_diff_apply(arriving, root, f"{root}-progress").awaitTermination()
    return writers.read_version(spark, root).select("row", "case_key", "head", "relation", "tail", "fact_hash", "source_file")
