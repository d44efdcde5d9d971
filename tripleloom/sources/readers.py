"""Readers: nested case JSON, safety CSV, JSON lines, per-document triples, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.scale import numbered

CASE_FILE_SCHEMA = (
    "test_cases array<struct<original_data: struct<`编号`: string, `测试用例名称`: string, `测试用例类型`: string, "
    "`前提条件`: string, `执行动作`: string, `预期行为`: string>, `前提条件_分割`: array<string>>>"
)
SAFETY_SCHEMAS = {
    "vehicles": "vehicle_key string, make string, model string, year int",
    "ratings": "vehicle_key string, vehicle_id string, overall_rating string, frontal_crash_rating string, "
    "side_crash_rating string, rollover_rating string",
    "recalls": "vehicle_key string, campaign_number string, component string, summary string, consequence string, remedy string",
    "complaints": "vehicle_key string, odi_number string, component string, summary string, crash string, fire string, "
    "injury string, date_received string",
    "test_case_candidates": "vehicle_key string, source_type string, source_id string, component string, risk_scenario string, "
    "test_objective string, expected_result string, evidence string",
}
FUSED_SCHEMA = "head string, relation string, tail string, sources array<string>, conflict boolean, conflict_note string"
IMAGE_SUFFIXES = ["jpg", "jpeg", "png", "webp", "bmp"]


def _file_name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]+)\z", 1)


def normalise_cases(raw: DataFrame) -> DataFrame:
    """Normalised cases of rows (source, row, c), c holding original_data and the split preconditions."""
    o = F.col("c.original_data")

    def given(name: str) -> Column:
        return F.when(o[name] != "", o[name])

    fallback = F.concat(F.lit("case-"), F.col("row").cast("string"))
    case_id = F.coalesce(given("编号"), fallback)
    split = F.filter(F.transform("c.前提条件_分割", T.strip), lambda x: x != "")
    return raw.where(F.col("c").isNotNull()).select(
        case_id.alias("case_id"),
        F.coalesce(given("测试用例名称"), case_id).alias("case_name"),
        F.coalesce(o["测试用例类型"], F.lit("")).alias("test_type"),
        F.when(F.size(F.coalesce(F.col("c.前提条件_分割"), F.array())) > 0, split).otherwise(T.as_text_list(o["前提条件"])).alias("preconditions"),
        T.as_text_list(o["执行动作"]).alias("actions"),
        T.as_text_list(o["预期行为"]).alias("expected_behaviors"),
        F.coalesce(o["执行动作"], F.lit("")).alias("action_text"),
        F.coalesce(o["预期行为"], F.lit("")).alias("expected_text"),
        "source",
        (F.col("row") + 1).cast("long").alias("source_row"),
        T.unique_id(o["编号"], F.col("row")).alias("unique_id"),
    )


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Nested case files, one row per case in file order."""
    files = spark.read.schema(CASE_FILE_SCHEMA).option("multiLine", True).json(path)
    rows = files.select(_file_name(F.col("_metadata.file_path")).alias("source"), F.posexplode("test_cases").alias("row", "c"))
    return normalise_cases(rows)


def read_safety(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Safety CSV tables of a folder by name; all of them unless some are asked for."""
    return {
        name: spark.read.csv(f"{folder}/{name}.csv", schema=SAFETY_SCHEMAS[name], header=True, multiLine=True, quote='"', escape='"')
        for name in names or SAFETY_SCHEMAS
    }


def _json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are not blank, with their file and whether each is one JSON value."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    return lines.withColumn("ok", T.is_whole_json("value"))


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; strict fails with file and text of a line that is not one JSON value, tolerant leaves it to `rejected_jsonl`."""
    lines = _json_lines(spark, path)
    if strict:
        message = F.concat(F.lit("malformed JSON line in "), F.col("file"), F.lit(": "), F.col("value"))
        lines = lines.withColumn("value", F.when(F.col("ok"), F.col("value")).otherwise(F.raise_error(message)))
    else:
        lines = lines.where("ok")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def rejected_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Lines that the tolerant reader leaves out: file, value."""
    return _json_lines(spark, path).where(~F.col("ok")).select("file", "value")


def _plain(c: Column | str) -> Column:
    """A path without scheme, host and closing slashes."""
    return F.regexp_replace(c, r"^[a-z0-9]+:(//[^/]*)?|/+\z", "")


def read_doc_triples(spark: SparkSession, root: str, files: str = "knowledge_graph.json", folder_prefix: str = "") -> DataFrame:
    """Fused triples of all documents below ``root``; the document is the folder of its file, less ``folder_prefix``.

    A file directly in ``root`` is the aggregate of the others and is left out.
    """
    read = spark.read.schema(FUSED_SCHEMA).option("multiLine", files == "knowledge_graph.json").option("recursiveFileLookup", True).option("pathGlobFilter", files)
    path = F.col("_metadata.file_path")
    folder = F.regexp_extract(path, r"^(.*)/[^/]+\z", 1)
    name = F.substring_index(folder, "/", -1)
    doc = F.when(name.startswith(folder_prefix), F.substring(name, F.lit(len(folder_prefix) + 1), F.char_length(name))).otherwise(name)
    rows = read.json(root).select("*", doc.alias("doc_name"), _plain(folder).alias("_folder")).where(F.col("_folder") != _plain(F.lit(root)))
    text = F.concat(F.coalesce("head", F.lit("")), F.coalesce("relation", F.lit("")), F.coalesce("tail", F.lit("")))
    return rows.where(text != "").drop("_folder")


def build_manifest(
    spark: SparkSession, folders: dict[str, tuple[str, str]], limit_per_doc: int = 0, suffixes: Sequence[str] = IMAGE_SUFFIXES
) -> DataFrame:
    """Images of the document folders {doc_id: (doc_name, folder)} with ids such as ``doc_0001`` in file-name order."""
    documents = spark.createDataFrame([(doc_id, name, folder) for doc_id, (name, folder) in folders.items()], "doc_id string, doc_name string, source_dir string")
    listed = spark.read.format("binaryFile").load([folder for _, folder in folders.values()]).select(F.col("path").alias("image_path"))
    within = _plain(F.regexp_extract("image_path", r"^(.*)/[^/]+\z", 1))
    out = listed.withColumn("_dir", within).join(documents.withColumn("_dir", _plain("source_dir")), "_dir").select("doc_id", "doc_name", "source_dir", "image_path")
    named = out.withColumn("file_name", _file_name(F.col("image_path")))
    images = named.where(F.lower(F.substring_index("file_name", ".", -1)).isin(list(suffixes)))
    ranked = numbered(images, ["doc_id"], [F.col("file_name")], "_n")
    if limit_per_doc > 0:
        ranked = ranked.where(F.col("_n") <= limit_per_doc)
    return ranked.withColumn("image_id", F.format_string("%s_%04d", "doc_id", "_n")).drop("_n")


def entity_table(nodes: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Distinct names per label with a stable index from 0."""
    wanted = nodes if labels is None else nodes.where(F.col("label").isin(labels))
    names = wanted.where(F.col("name").isNotNull()).select("label", "name").distinct()
    ranked = numbered(names, ["label"], [F.col("name")], "_n")
    return ranked.select("label", (F.col("_n") - 1).cast("long").alias("idx"), "name")
