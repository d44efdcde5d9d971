"""Inverted indexes as tables: postings of features and rows, met by equi-joins, pruned by bounds that are proven.

A posting list is all rows of a feature. Lists are dealt by feature and a hash of the row, so that a frequent feature is spread
over ``SPLIT`` tasks; what is asked is small beside them and repeated for each part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPLIT = 8


def partials(postings: DataFrame, asked: DataFrame, query: str = "query_id", row: str = "row_id") -> DataFrame:
    """Summed weights of the asked features that a row has: (query, row, partial).

    postings: feature, row.  asked: query, feature, weight.
    """
    parts = asked.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))))
    dealt = postings.withColumn("_part", F.pmod(F.xxhash64(row), F.lit(SPLIT)).cast("int"))
    return dealt.join(parts, ["feature", "_part"]).groupBy(query, row).agg(F.sum("weight").alias("partial"))


def with_frequency(asked: DataFrame, postings: DataFrame) -> DataFrame:
    """The asked features that any row has, with ``_df``, the length of their posting list."""
    lengths = postings.groupBy("feature").agg(F.count(F.lit(1)).alias("_df"))
    return asked.join(lengths, "feature")


def rarest(asked: DataFrame, n: int, query: str = "query_id") -> DataFrame:
    """The n features of each query with the shortest lists."""
    order = Window.partitionBy(query).orderBy("_df", "feature")
    return asked.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= n).drop("_place")


def essential(asked: DataFrame, bounds: DataFrame, query: str = "query_id") -> DataFrame:
    """The asked features without which no row reaches the query's bound, with ``_rest``, all that the others can add.

    bounds: query, bound (what the summed weights must reach).  The longest lists are left out, as many as together stay
    below the bound: a row in none of the other lists cannot qualify, so those long lists are never opened.
    """
    longest_first = Window.partitionBy(query).orderBy(F.desc("_df"), "feature").rowsBetween(Window.unboundedPreceding, 0)
    added = asked.join(bounds, query).withColumn("_sum", F.sum("weight").over(longest_first))
    left_out = F.col("_sum") < F.col("bound")
    rest = F.coalesce(F.max(F.when(left_out, F.col("_sum"))).over(Window.partitionBy(query)), F.lit(0.0))
    return added.withColumn("_rest", rest).where(~left_out).drop("_sum")


def tokens_in_words(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """(word, token) of each distinct token inside each distinct word, by the token's first two characters and its place."""

    def start(c: Column, at: Column) -> Column:
        return F.substring(c, at, F.lit(2))

    def places(word: Column) -> Column:
        return F.explode(F.sequence(F.lit(1), F.char_length(word)))

    placed = words.select("word").distinct().where(F.char_length("word") > 0).select("word", places(F.col("word")).alias("_at"))
    two = placed.withColumn("_key", start(F.col("word"), F.col("_at")))
    # a token of one character starts every pair that begins with it
    one = two.where(F.char_length("_key") == 2).withColumn("_key", F.left("_key", F.lit(1)))
    wanted = tokens.select("token").distinct().withColumn("_key", start(F.col("token"), F.lit(1)))
    met = two.union(one).join(wanted, "_key")
    return met.where(F.substring("word", F.col("_at"), F.char_length("token")) == F.col("token")).select("word", "token").distinct()
