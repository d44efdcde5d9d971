"""Lexical retrieval of document triples over an inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lexical_tokens
from ..session import materialise
from .inverted import SPLIT, essential, rarest
from .scale import first_per_key, top_k_per_key

#: Features of a query that give a first best score.
PROBES = 3
#: Features of questions, asked or opened, that are sent to every task.
SENT = 500_000
RECORD = ["doc_name", "head", "relation", "tail"]
#: What a field of a row adds if the query holds it (as it is, without blanks), or if it holds the query.
IN_QUERY, IN_SHORT, HOLDS = 3.0, 3.0, 4.0


def cap_per_group(df: DataFrame, query: list[str], group: str, order: list, cap: int, k: int) -> DataFrame:
    """Per query at most ``cap`` rows of a group and ``k`` rows in all, in order."""
    capped = top_k_per_key(df, [*query, group], order, cap, "_in_group").drop("_in_group")
    return top_k_per_key(capped, query, order, k)


def lexical_triples(
    queries: DataFrame,
    triples: DataFrame,
    k: int = 20,
    cap: int = 6,
    min_score: float = 75.0,
) -> DataFrame:
    """Triples that share words and character n-grams with the queries.

    queries: query_id, query.  triples: row_id (long), doc_name, head, relation,
    tail, sources, conflict, conflict_note.  The score is relative to the best
    triple of the query; rows above ``min_score``, at most ``cap`` per document
    and ``k`` per query.

    The triples are an inverted index.  Triples of equal content are one row of it, and tokens that the same queries ask for are one
    feature, whose weight in a row is what the row has of them.  The rows of each query's rarest features give a first best score;
    from it follows what a row must reach, and so which features may be left out of the search.  A row meets a query once, by the first
    of the other features that both have, and is scored there.
    """
    clean = triples.select(
        "row_id", *[F.coalesce(c, F.lit("")).alias(c) for c in RECORD],
        F.coalesce("sources", F.array()).alias("sources"), F.coalesce("conflict", F.lit(False)).alias("conflict"),
        F.coalesce("conflict_note", F.lit("")).alias("conflict_note"),
    ).where(F.concat("head", "relation", "tail") != "")
    # triples of equal content have equal scores, and the first of them is kept
    once = clean.groupBy(*[c for c in clean.columns if c != "row_id"]).agg(F.min("row_id").alias("row_id"))
    text = F.concat_ws(" ", *RECORD, F.array_join("sources", " "))
    # read several times below: tokens are cut once
    records = materialise(once.withColumn("_tokens", lexical_tokens(text)).withColumn("_row", F.monotonically_increasing_id()))
    asked = materialise(
        queries.select("query_id", F.trim("query").alias("query"), lexical_tokens(F.trim("query")).alias("tokens")).where(F.size("tokens") > 0)
    )
    groups, features = _features(asked)
    tokens = records.select("_row", "_tokens").repartition("_row").select("_row", F.explode("_tokens").alias("token"))
    weights = tokens.join(groups, "token").groupBy("_row", "feature").agg(F.sum("weight").alias("weight"))
    held = weights.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("feature", "weight"))).alias("_held"))
    # a table that is small on disk is not for that sent to every task
    rows = materialise(records.drop("_tokens").withColumns(_forms(*RECORD)).hint("merge").join(held, "_row"))
    lengths = rows.select(F.explode(F.map_keys("_held")).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("_df"))
    known = materialise(features.join(lengths, "feature"))
    named = known.groupBy("query_id").agg(F.collect_list("feature").alias("_asked"))
    questions = asked.select("query_id", "query").withColumns(_forms("query")).join(named, "query_id")
    # any row's score is a lower bound of the best; rows of rare features are good ones
    share = min_score / 100.0
    first = _scored(rows, questions, rarest(known, PROBES)).groupBy("query_id").agg(F.max("raw_score").alias("_first"))
    # scores are rounded; a thousandth is more than rounding can add
    least = materialise(first.select("query_id", (share * F.col("_first") - 0.001).alias("_least")))
    # what the fields can add at most; a field shorter than the query does not hold it
    longest = rows.agg(*[F.max(F.char_length(f"_{c}_short")).alias(f"_{c}_longest") for c in RECORD])
    most = sum((IN_QUERY + IN_SHORT + F.when(F.col(f"_{c}_longest") >= F.char_length("_query_short"), HOLDS).otherwise(0.0) for c in RECORD), F.lit(0.0))
    bounds = questions.join(least, "query_id").crossJoin(longest).select("query_id", (F.col("_least") - most).alias("bound"))
    needed = essential(known, bounds)
    scored = _scored(rows, questions.join(least, "query_id"), needed).where(F.col("raw_score") >= F.col("_least"))
    found = materialise(scored.select(*clean.columns, "query_id", "raw_score"))
    best = found.groupBy("query_id").agg(F.max("raw_score").alias("_max"))
    relative = found.join(best, "query_id").withColumn("score", F.round(F.col("raw_score") / F.col("_max") * 100, 2)).drop("_max")
    strong = relative.where(F.col("score") > min_score)
    distinct = first_per_key(strong, ["query_id", *RECORD], [-F.col("score"), F.col("row_id")])
    return cap_per_group(distinct, ["query_id"], "doc_name", [F.desc("score"), F.asc("row_id")], cap, k)


def _weight(token: Column) -> Column:
    return 1.0 + F.least(F.char_length(token), F.lit(8)) / 8.0


def _features(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, feature, weight): tokens that exactly the same queries ask for are one feature; (query_id, feature, weight): what is asked."""
    wanted = asked.select("query_id", F.explode("tokens").alias("token")).distinct()
    by = ["_n", "_a", "_b"]
    who = wanted.groupBy("token").agg(
        F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64("query_id")).alias("_a"), F.bit_xor(F.xxhash64(F.lit(1), "query_id")).alias("_b")
    )
    who = materialise(who)
    numbers = materialise(who.select(*by).distinct().withColumn("feature", F.monotonically_increasing_id()))
    groups = materialise(who.join(numbers, by).select("token", "feature", _weight(F.col("token")).alias("weight")))
    return groups, wanted.join(groups, "token").groupBy("query_id", "feature").agg(F.sum("weight").alias("weight"))


def _forms(*columns: str) -> dict[str, Column]:
    """Lower case, and that without blanks, of each column."""
    lower = {f"_{c}_lower": F.lower(F.col(c)) for c in columns}
    return lower | {f"_{c}_short": F.regexp_replace(F.lower(F.col(c)), r"(?U)\s+", "") for c in columns}


def _extra(value: str) -> Column:
    """What a field adds if it is in the query, or the query in it."""
    own, short, asked, compact = (F.col(c) for c in (f"_{value}_lower", f"_{value}_short", "_query_lower", "_query_short"))
    none = F.lit(0.0)
    return (
        F.when((own != "") & F.contains(asked, own), IN_QUERY).otherwise(none)
        + F.when((short != "") & F.contains(compact, short), IN_SHORT).otherwise(none)
        + F.when((compact != "") & F.contains(short, compact), HOLDS).otherwise(none)
    )


def _scored(rows: DataFrame, questions: DataFrame, opened: DataFrame) -> DataFrame:
    """Pairs of a row and a question that have one of the question's opened features, with raw_score; opened: query_id, feature.

    Each pair is met once, and is scored where it is met.  Questions with up to ``SENT`` features in all go to every task, and rows stay
    where they are.  With more, long lists are dealt in parts by row; both sides are dealt to all tasks, as they make far more pairs
    than their size tells.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    lists = materialise(opened.groupBy("query_id").agg(F.array_sort(F.collect_list("feature")).alias("_open")))
    told = questions.join(lists, "query_id")
    if (told.agg(F.sum(F.size("_open") + F.size("_asked"))).first()[0] or 0) <= SENT:
        filed = rows.repartition(tasks, "_row").withColumn("_keys", F.map_keys("_held")).withColumn("feature", F.explode("_keys"))
        wanted = lists.select("query_id", F.explode("_open").alias("feature"))
        return _raw_scores(filed.join(F.broadcast(wanted), "feature").join(F.broadcast(told), "query_id"))
    parts = F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1)))
    asks = told.withColumn("feature", F.explode("_open")).withColumn("_part", parts)
    filed = rows.repartition(tasks, "_row").withColumns({"_part": F.pmod(F.xxhash64("_row"), F.lit(SPLIT)).cast("int"), "_keys": F.map_keys("_held")})
    return _raw_scores(filed.withColumn("feature", F.explode("_keys")).join(asks.repartition(tasks, "feature", "_part"), ["feature", "_part"]))


def _raw_scores(met: DataFrame) -> DataFrame:
    """The rows and questions that met, each pair once, with raw_score."""
    once = met.where(F.get(F.array_intersect("_open", "_keys"), F.lit(0)) == F.col("feature"))
    shared = F.aggregate("_asked", F.lit(0.0), lambda total, f: total + F.coalesce(F.try_element_at("_held", f), F.lit(0.0)))
    extra = sum((_extra(c) for c in [*RECORD[1:], RECORD[0]]), F.lit(0.0))
    raw = (shared + extra) * F.when(F.col("conflict"), 0.85).otherwise(1.0)
    return once.withColumn("raw_score", F.round(raw, 4))
