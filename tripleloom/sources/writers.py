"""Writers: JSON-line state in versions, CSV results, appended run logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


POINTER = "version long, folder string, rows long"


def _pointers(spark: SparkSession, root: str) -> list:
    """Committed versions, oldest first: one row each, none before the first."""
    try:
        found = spark.read.schema(POINTER).json(f"{root}/pointer")
    except Exception as exc:  # nothing was committed yet
        if "PATH_NOT_FOUND" in str(exc):
            return []
        raise
    return found.orderBy("version").collect()  # as many rows as versions that are kept


def write_jsonl_state(df: DataFrame, root: str) -> int:
    """Commit a new version of a JSON-lines state: a folder of its own, then a pointer with its name and row count, last.

    A write that breaks before the pointer leaves a folder that no reader sees; a reader of an older version is not disturbed.
    """
    spark, counted = df.sparkSession, Observation()
    folder = f"{root}/data/{uuid.uuid4().hex}"
    df.observe(counted, F.count(F.lit(1)).alias("rows")).write.json(folder)
    version = max([p["version"] for p in _pointers(spark, root)], default=0) + 1
    spark.createDataFrame([(version, folder, counted.get["rows"])], POINTER).coalesce(1).write.mode("append").json(f"{root}/pointer")
    return version


def read_jsonl_state(spark: SparkSession, root: str, schema: str, version: int | None = None) -> DataFrame | None:
    """Rows of the newest committed version, or of the one asked for; None if there is none."""
    known = [p for p in _pointers(spark, root) if version in (None, p["version"])]
    return spark.read.schema(schema).json(known[-1]["folder"]) if known else None


def compact_jsonl_state(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete folders that are not among the ``keep`` newest versions, broken writes included; returns how many.

    Readers of older versions must be done; pointers stay, as a record of what was there.
    """
    kept = {p["folder"].rstrip("/").split("/")[-1] for p in _pointers(spark, root)[-keep:]}
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/data")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [f.getPath() for f in store.listStatus(path) if f.getPath().getName() not in kept]
    for folder in old:  # one entry for each version
        store.delete(folder, True)
    return len(old)


def write_csv(df: DataFrame, path: str) -> None:
    """Result table as CSV with header; lists are written as JSON text."""
    kinds = dict(df.dtypes)
    flat = df.select(*[F.to_json(c).alias(c) if kinds[c].startswith(("array", "map", "struct")) else F.col(c) for c in df.columns])
    flat.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def append_runs(df: DataFrame, path: str) -> None:
    """Append run records with the time they were logged."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)


def write_version(df: DataFrame, root: str, version: int) -> None:
    """Write a new version of a state table; readers see it once its pointer row is appended."""
    df.write.mode("overwrite").parquet(f"{root}/v={version}")
    spark = df.sparkSession
    spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").json(f"{root}_versions")


def current_version(spark: SparkSession, root: str) -> int | None:
    """Newest complete version of a state table, None before the first."""
    try:
        versions = spark.read.schema("version long").json(f"{root}_versions")
    except Exception as exc:  # the pointer folder does not exist yet
        if "PATH_NOT_FOUND" in str(exc):
            return None
        raise
    return versions.agg(F.max("version")).first()[0]


def read_version(spark: SparkSession, root: str) -> DataFrame | None:
    version = current_version(spark, root)
    return None if version is None else spark.read.parquet(f"{root}/v={version}")
