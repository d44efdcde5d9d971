"""Exact top-k inner-product search over an impact-ordered index, score at a time.

Components are quantised to integers. The postings of a block of vectors are cut into segments by the power of two of their
magnitude; segments are processed from the greatest impact downwards, for a batch of queries at once. After a segment, what
is left of a vector can change its score by no more than the product of two norms (Cauchy-Schwarz), so each score has a
lower and an upper bound. Vectors whose upper bound is below the k-th lower bound are proven out. Processing stops only when
few possible members are left or no segment is; those are scored exactly.

Blocks of vectors and groups of queries meet in cells of bounded size; the best k of each cell are merged by Spark.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part; only vectors of equal
length are compared. Every row is a candidate of its own, so repeated rows take several ranks; rows with the query's id are
its own and left out; rows with a null id are neither queries nor candidates. Repeated queries give one result. Ties go to
the smaller id. Fewer candidates than k give fewer rows, an empty table none. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

SCALE, BLOCK_ROWS, QUERY_ROWS, BATCH, FEW = 64, 16384, 16384, 128, 8


class ImpactIndex:
    """Segments of a block's postings, greatest magnitudes first, each as a sparse-valued matrix."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors, self.ids = vectors, ids
        magnitude = np.abs(vectors)
        top = int(magnitude.max(initial=1))
        kind = np.float32 if top * top * vectors.shape[1] < 1 << 23 else np.float64
        level = np.frexp(magnitude.astype(float))[1]  # 0 for zero, else 1 + floor(log2)
        squares = (vectors.astype(float) ** 2)
        self.segments, self.left = [], []
        for one in sorted(set(level[level > 0].ravel().tolist()), reverse=True):
            self.segments.append(np.ascontiguousarray(np.where(level == one, vectors, 0).T.astype(kind)))
            self.left.append(np.sqrt(np.where(level < one, squares, 0).sum(axis=1)))

    def search(self, queries: np.ndarray, own_ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query place, vector place, score) of the best k of each query, best first."""
        for start in range(0, len(queries), BATCH):
            batch, own = queries[start : start + BATCH], own_ids[start : start + BATCH]
            is_own = own[:, None] == self.ids[None, :]
            norms = np.sqrt((batch.astype(float) ** 2).sum(axis=1))[:, None]
            possible = ~is_own
            if self.segments and possible.sum() > FEW * k * len(batch):
                sums = np.zeros((len(batch), len(self.ids)), self.segments[0].dtype)
                typed = batch.astype(sums.dtype)
                for segment, left in zip(self.segments, self.left):
                    sums += typed @ segment
                    slack = norms * left[None, :] * (1 + 1e-6) + 0.01
                    lower = np.where(is_own, -np.inf, sums - slack)
                    bar = np.partition(lower, -k, axis=1)[:, -k][:, None] if lower.shape[1] >= k else np.full((len(batch), 1), -np.inf)
                    possible = ~is_own & (sums + slack >= bar)
                    if possible.sum() <= FEW * k * len(batch):
                        break
            q, v = np.nonzero(possible)
            score = np.einsum("ij,ij->i", batch[q], self.vectors[v])
            order = np.lexsort((self.ids[v], -score, q))
            q, v, score = q[order], v[order], score[order]
            firsts = np.searchsorted(q, np.arange(len(batch)))
            best = np.arange(len(q)) - firsts[q] < k
            yield q[best] + start, v[best], score[best]


def quantised(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """vec_id, q, dim, place of the vectors that take part, as a written table; `place` tells repeated rows apart."""
    values = F.col(vector)
    sound = F.col(vec_id).isNotNull() & (F.size(values) > 0) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    q = F.transform(values, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return materialise(vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), q.alias("q"), F.size(values).alias("dim"), F.monotonically_increasing_id().alias("place")))


def top_k(vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best candidates of each row for which `is_query` (a condition on vec_id) holds."""
    table = quantised(vectors, vec_id, vector, scale)
    asked = table.where(is_query).dropDuplicates(["vec_id", "q"])
    blocks, groups = max(1, -(-table.count() // BLOCK_ROWS)), max(1, -(-asked.count() // QUERY_ROWS))
    number = lambda n: F.pmod(F.xxhash64("place"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = table.select("vec_id", "q", "dim", number(blocks).alias("block"), every(groups).alias("group"))
    right = asked.select(F.col("vec_id").alias("query_id"), F.col("place").alias("query"), "q", "dim", every(blocks).alias("block"), number(groups).alias("group"))

    def matrix(part: pa.Table) -> np.ndarray:
        flat = part.column("q").combine_chunks()
        flat = flat.flatten() if isinstance(flat, pa.Array) else pa.concat_arrays([c.flatten() for c in flat.chunks])
        return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, -1)

    def cell(vectors_: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query", "query_id", "vec_id", "score"]
        if not vectors_.num_rows or not queries.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        ids = vectors_.column("vec_id").to_numpy()
        query, query_id = queries.column("query").to_numpy(), queries.column("query_id").to_numpy()
        found = list(ImpactIndex(matrix(vectors_), ids).search(matrix(queries), query_id, k))
        q, v, score = (np.concatenate(x) for x in zip(*found))
        return pa.table(dict(zip(names, (query[q], query_id[q], ids[v], score))))

    keys = ["dim", "block", "group"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, "query long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
