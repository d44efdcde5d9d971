"""Skew-safe building blocks: keep-first, top-k, numbering and carry-forward.

None of these needs a whole key in one task: keep-first is an aggregate with
map-side combine, top-k prunes before the shuffle, and numbering / carry-forward
switch to range-sorted blocks when a key is larger than ``max_group_rows``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise

MAX_GROUP_ROWS = 2_000_000


def computed_once(df: DataFrame) -> DataFrame:
    """Keep costly columns from being computed again by every expression that uses them."""
    return df.select(F.explode(F.array(F.struct("*"))).alias("_row")).select("_row.*")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], latest: bool = False) -> DataFrame:
    """One row per key: the one with the smallest (or, ``latest``, largest) order."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if latest else F.min_by
    if not rest:
        return df.select(*keys).distinct()
    rows = df.groupBy(*keys).agg(
        pick(F.struct(*rest), F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])).alias("_row")
    )
    return rows.select(*[F.col(k) if k in keys else F.col("_row")[k].alias(k) for k in df.columns])


def top_k_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k first rows per key with their rank; Spark limits each map-side group to k rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= k)


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest key (map-side combined count)."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def _sorted_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Globally sort by (keys, order) and pin the result; _block is the sort partition, _pos the place in it."""
    placed = df.sort(*[F.col(k) for k in keys], *order).withColumn("_pos", F.monotonically_increasing_id())
    return materialise(placed).withColumn("_block", F.shiftright("_pos", 33))


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """1-based number of each row within its key.

    Small groups use a window.  With a hot group (or no keys at all) the rows are
    sorted once over all tasks and a block's numbers start after the rows of the
    same key in earlier blocks.
    """
    if keys and largest_group(df, keys) <= max_group_rows:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(w).cast("long"))
    blocks = _sorted_blocks(df, keys, order)
    sizes = blocks.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_start"))
    # one row per sort partition a key touches
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_block", "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    joined = blocks.alias("l").join(
        offsets.alias("o"), [F.col("l._block") == F.col("o._block"), *on], "inner"
    )
    number = (F.col("l._pos") - F.col("o._start") + F.col("o._before") + 1).cast("long")
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], number.alias(name))


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Total rank over the whole table without gathering it in one task."""
    return numbered(df, [], order, name)


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    values: Sequence[str],
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Fill NULLs in ``values`` with the last value before them in the same key."""
    if largest_group(df, keys) <= max_group_rows:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        filled = {v: F.last(v, ignorenulls=True).over(w) for v in values}
        return df.withColumns(filled)
    blocks = _sorted_blocks(df, keys, order)
    local = Window.partitionBy(*keys, "_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = blocks.withColumns({f"_in_{v}": F.last(v, ignorenulls=True).over(local) for v in values})
    ends = blocks.groupBy(*keys, "_block").agg(
        *[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("_pos"))).alias(f"_end_{v}") for v in values]
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *keys, "_block", *[F.last(f"_end_{v}", ignorenulls=True).over(before).alias(f"_from_{v}") for v in values]
    )
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    joined = inside.alias("l").join(carried.alias("o"), [F.col("l._block") == F.col("o._block"), *on], "inner")
    return joined.select(
        *[
            F.coalesce(F.col(f"l._in_{c}"), F.col(f"o._from_{c}")).alias(c) if c in values else F.col(f"l.{c}")
            for c in df.columns
        ]
    )
