"""Session settings and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, name: str = "tripleloom") -> SparkSession:
    """Single-machine session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # small inputs still keep all cores busy
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster where it is not installed; Python operators import it there."""
    parent = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="ship-")
    archive = shutil.make_archive(os.path.join(folder, "tripleloom"), "zip", parent, "tripleloom")
    spark.sparkContext.addPyFile(archive)


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for lineage cuts: the session's, or a scratch folder in local mode only."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return configured


def materialise(df: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """Cut the lineage: write the rows as a table in the shared folder and read it back.

    The folder belongs to the session; whoever sets it empties it after the run.

    A lost executor costs a re-read only, and later joins see the real size of the
    table, which lets Spark broadcast the small ones.  ``by``: the table is bucketed by this
    column (or these), so that joins and groups by it move none of its rows.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if by is None:
        writer.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    name = f"table_{uuid.uuid4().hex}"
    writer.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *([by] if isinstance(by, str) else by)).option("path", path).saveAsTable(name)
    return spark.table(name)
