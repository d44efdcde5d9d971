"""Helpers shared by the operators: input columns, Arrow streaming, lineage cuts, ranks inside hot keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tripleloom.session import materialise

__all__ = ["KEPT", "bounded_sample", "filter_rows", "fresh", "hash_share", "in_chunks", "is_fold", "map_texts", "materialise", "read", "release", "row_number_salted"]

CHUNK_BYTES = 1 << 20
#: What a worker keeps from task to task, by the operator that made it.
KEPT: dict[str, dict] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(stem: str = "c") -> str:
    """A column name that no input can have."""
    return f"__{stem}_{uuid.uuid4().hex[:12]}"


def is_fold(id_column: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % modulus == remainder


def in_chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `limit` bytes of text, or one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(lengths):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)


def release(but: str = "") -> None:
    """Drop what other operators have left in this worker."""
    for name, kept in KEPT.items():
        if name != but:
            kept.clear()


def map_texts(df: DataFrame, text: str, work: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema, limit: int = CHUNK_BYTES, keeps: str = "") -> DataFrame:
    """mapInArrow whose function sees small batches, so that memory stays bounded however long the texts are.

    Workers serve one operator after another: each drops what the others keep; `keeps` is the operator's name in KEPT.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(keeps)
        yield from work(part for batch in batches for part in in_chunks(batch, text, limit))

    return df.mapInArrow(run, schema)


def row_number_salted(df: DataFrame, key: str, order: list[str], out: str, salts: int = 64) -> DataFrame:
    """Gapless numbers from 0 within each key; a hot key is numbered in `salts` parts that are set one behind the other.

    The part of a row follows from its order columns. Rows that agree in all of them take numbers in any order.
    """
    salt, n, before = fresh("salt"), fresh("n"), fresh("before")
    salted = df.withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy(key, salt).agg(F.count(F.lit(1)).alias(n))
    up_to = Window.partitionBy(key).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(key).alias(f"{key}{salt}"), F.col(salt).alias(f"{salt}_r"), F.coalesce(F.sum(n).over(up_to), F.lit(0)).alias(before))
    joined = salted.join(offsets, salted[key].eqNullSafe(offsets[f"{key}{salt}"]) & (salted[salt] == offsets[f"{salt}_r"]))
    inside = F.row_number().over(Window.partitionBy(key, salt).orderBy(*order))
    return joined.withColumn(out, (inside - 1 + F.col(before)).cast("long")).select(*df.columns, out)


def filter_rows(df: DataFrame, text: str, keep: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """Rows that a function of small batches keeps, all columns as they were; `keep()` is called once per task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = keep()
        for batch in batches:
            yield batch.filter(pa.array(decide(batch), pa.bool_()))

    return map_texts(df, text, work, df.schema)


def hash_share(*columns: str) -> Column:
    """A number from 0 to 1 that follows from the columns."""
    return F.pmod(F.xxhash64(*columns, F.lit("sample")), F.lit(1 << 30)) / (1 << 30)


def bounded_sample(df: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """At most `limit` rows in the order of a hash of the columns; a share test first, so that few rows meet in the last step."""
    share = min(1.0, 3 * limit / max(1, df.count()))
    order = fresh("order")
    return df.withColumn(order, hash_share(*columns)).where(F.col(order) < share).orderBy(order, *columns).limit(limit).drop(order)
