"""Keyword search and question retrieval over normalised test cases, many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import question_tokens
from ..session import materialise
from .inverted import tokens_in_words
from .rules import any_contains, contains_join
from .scale import first_per_key, global_rank, top_k_per_key

CASE_COLUMNS = ["case_id", "case_name", "test_type", "preconditions", "actions", "expected_behaviors", "source", "source_row"]


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _list(c: str) -> Column:
    return F.array_join(F.coalesce(F.col(c), F.array()), " ")


def search_blob(list_first: bool = False) -> Column:
    """All searchable text of a case in lower case."""
    lists = ["preconditions", "actions", "expected_behaviors"] if list_first else ["actions", "expected_behaviors", "preconditions"]
    return F.lower(F.concat_ws(" ", _text("case_id"), _text("case_name"), _text("test_type"), *[_list(c) for c in lists]))


def search_cases(cases: DataFrame, queries: DataFrame, limit: int = 50) -> DataFrame:
    """Substring search (query_id, query): field-weighted score, rank ≤ limit, total hits per query.

    A hit across field borders only keeps score 0.
    """
    needles = queries.select("query_id", F.lower(F.trim("query")).alias("_needle")).where(F.col("_needle") != "")
    texts = cases.withColumn("_blob", search_blob())
    hits = contains_join(texts, needles, "_blob", "_needle", CASE_COLUMNS, ["query_id", "_needle"])
    n = F.col("_needle")

    def weight(hit: Column, w: float) -> Column:
        return F.when(hit, F.lit(w)).otherwise(F.lit(0.0))

    score = (
        weight(F.lower(_text("case_name")).contains(n), 0.55)
        + weight(F.lower(_text("test_type")).contains(n), 0.25)
        + weight(F.lower(_text("case_id")).contains(n), 0.15)
        + weight(F.lower(_list("actions")).contains(n) | F.lower(_list("expected_behaviors")).contains(n), 0.1)
        + weight(F.lower(_list("preconditions")).contains(n), 0.05)
    )
    scored = materialise(hits.withColumn("score", F.round(F.least(score, F.lit(0.999)), 4)).drop("_needle"))
    totals = scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    order = [F.desc("score"), F.asc("case_name"), F.asc("source_row")]
    return top_k_per_key(scored, ["query_id"], order, limit).join(totals, "query_id")


#: The best score of a case for a question.
FULL = 0.999


def _score(weight: Column, in_name: Column, in_type: Column) -> Column:
    total = F.least(weight, F.lit(1.2)) + F.when(in_name, 0.35).otherwise(0.0) + F.when(in_type, 0.2).otherwise(0.0)
    return F.round(F.least(total, F.lit(FULL)), 4)


def _bounded(asked: DataFrame, postings: DataFrame, limit: int) -> DataFrame:
    """asked with ``_bound``: the place of the last of ``limit`` entries that surely have the best score; null if so many are not known.

    A token that gives the best score alone gives it to its whole list, of which only the first places can be asked for.
    """
    firsts = top_k_per_key(postings, ["token", "_name", "_type"], [F.asc("_place")], limit).drop("rank")
    alone = _score(F.col("weight"), F.col("_name") & F.col("bonus"), F.col("_type") & F.col("bonus"))
    sure = asked.join(firsts, "token").where(alone >= FULL).select("question_id", "_place").distinct()
    bounds = top_k_per_key(sure, ["question_id"], [F.asc("_place")], limit).where(F.col("rank") == limit)
    return asked.join(bounds.select("question_id", F.col("_place").alias("_bound")), "question_id", "left")


def retrieve_cases(cases: DataFrame, questions: DataFrame, limit: int = 8, early: int | None = None) -> DataFrame:
    """Cases for questions (question_id, question): token hits by length, name and type bonus, rank ≤ limit.

    A token stands inside one word, so tokens meet the distinct words, and words their cases: an inverted index, joined by keys.
    Cases in which the same tokens hit the same fields score alike for every question; they are one entry of the index, of
    which only the ``limit`` first by name and row can be asked for.  Scores have an upper end, and of entries there the first by
    name and row win: a question with ``limit`` entries that surely are there meets no entry behind the last of them.
    ``early``: tokens that may earn the bonus, None for all.
    """
    rows = materialise(cases.select(*CASE_COLUMNS, search_blob().alias("_blob")).withColumn("_row", F.monotonically_increasing_id()))
    asked = questions.select("question_id", F.posexplode(question_tokens("question")).alias("_place", "token"))
    bonus = F.lit(True) if early is None else F.col("_place") < early
    asked = materialise(asked.withColumns({"weight": F.greatest(F.char_length("token") / 8.0, F.lit(0.15)), "bonus": bonus}).drop("_place"))

    def words(c: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?U)[\w\u4e00-\u9fff]+"), F.lit(0)))

    fields = {0: F.col("_blob"), 1: F.lower(_text("case_name")), 2: F.lower(_text("test_type"))}
    cut = rows.select("_row", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), words(c).alias("words")) for n, c in fields.items()])).alias("f"))
    cut = cut.select("_row", "f.field", F.explode("f.words").alias("word"))
    inside = materialise(tokens_in_words(cut, asked))
    hits = cut.join(inside, "word").groupBy("_row").agg(F.sort_array(F.collect_set(F.struct("token", "field"))).alias("_hits"))
    # cases without any hit have no entry
    alike = rows.select("_row", "case_name", "source_row").join(hits, "_row").withColumn("_entry", F.sha2(F.to_json("_hits"), 256))
    first = materialise(top_k_per_key(alike, ["_entry"], [F.asc("case_name"), F.asc("source_row"), F.asc("_row")], limit, "_in_entry"))
    # entries are known by their place, a number
    order = [F.asc("case_name"), F.asc("source_row"), F.asc("_entry")]
    head = global_rank(first.where("_in_entry = 1").select("_entry", "case_name", "source_row", "_hits"), order, "_place")
    cut = head.select("_place", "_hits", F.explode(F.array_distinct(F.transform("_hits", lambda h: h["token"]))).alias("token"))

    def hit(field: int) -> Column:
        return F.exists("_hits", lambda h: (h["token"] == F.col("token")) & (h["field"] == field))

    postings = materialise(cut.select("_place", "token", hit(1).alias("_name"), hit(2).alias("_type")))
    asked = materialise(_bounded(asked, postings, limit))
    reach = asked.groupBy("token").agg(F.max("_bound").alias("_reach"), F.max(F.col("_bound").isNull()).alias("_open"))
    near = postings.join(reach, "token").where(F.col("_open") | (F.col("_place") <= F.col("_reach"))).drop("_open", "_reach")
    met = near.join(asked, "token").where(F.col("_bound").isNull() | (F.col("_place") <= F.col("_bound")))
    scored = met.groupBy("question_id", "_place").agg(
        F.sum("weight").alias("weight"), F.max(F.col("_name") & F.col("bonus")).alias("_name"), F.max(F.col("_type") & F.col("bonus")).alias("_type")
    )
    scored = scored.select("question_id", "_place", _score(F.col("weight"), F.col("_name"), F.col("_type")).alias("score"))
    best = top_k_per_key(scored, ["question_id"], [F.desc("score"), F.asc("_place")], limit).select("question_id", "_place", "score")
    out = best.join(head.select("_place", "_entry"), "_place").select("question_id", "score", "_entry").join(first.drop("_hits", "_in_entry"), "_entry")
    ranked = top_k_per_key(out, ["question_id"], [F.desc("score"), F.asc("case_name"), F.asc("source_row"), F.asc("_row")], limit)
    return rows.join(ranked.select("_row", "question_id", "score", "rank"), "_row").select(*CASE_COLUMNS, "question_id", "score", "rank")


def asks_for_types(question: Column | str) -> Column:
    c = F.col(question) if isinstance(question, str) else question
    return any_contains([c], V.TYPE_QUESTIONS)


def types_overview(cases: DataFrame, limit: int = 8) -> DataFrame:
    """First case of each test type, the first ``limit`` types in source order."""
    named = cases.where(_text("test_type") != "")
    firsts = first_per_key(named, ["test_type"], ["source_row"])
    return firsts.orderBy("source_row").limit(limit).withColumn("score", F.lit(0.9))


def answer_cases(cases: DataFrame, questions: DataFrame, limit: int = 8, early: int | None = None) -> DataFrame:
    """Evidence per question: the type overview for type questions, token retrieval otherwise."""
    wants = asks_for_types("question")
    ranked = retrieve_cases(cases, questions.where(~wants), limit, early).select("question_id", *CASE_COLUMNS, "score", "rank")
    overview = types_overview(cases, limit).select(*CASE_COLUMNS, "score")
    numbered = top_k_per_key(overview.withColumn("_all", F.lit(1)), ["_all"], [F.asc("source_row")], limit)
    asked = questions.where(wants).select("question_id").withColumn("_all", F.lit(1))
    return ranked.unionByName(asked.join(numbered, "_all").select("question_id", *CASE_COLUMNS, "score", "rank"))


def find_case(cases: DataFrame, lookups: DataFrame) -> DataFrame:
    """One case per lookup (lookup_id, needle): the case of that id, else the first whose name contains it."""
    cases = materialise(cases.select("case_id", "case_name", "source_row"))
    exact = cases.join(lookups, F.col("case_id") == F.col("needle")).select("lookup_id", F.lit(0).alias("_how"), "case_id", "source_row")
    open_ = lookups.join(exact.select("lookup_id").distinct(), "lookup_id", "left_anti")
    # of the cases of one name only the first counts
    firsts = first_per_key(cases.where(F.col("case_name").isNotNull()), ["case_name"], ["source_row", "case_id"])
    named = contains_join(firsts, open_, "case_name", "needle", ["case_id", "source_row"], ["lookup_id"])
    both = exact.unionByName(named.withColumn("_how", F.lit(1)))
    return first_per_key(both, ["lookup_id"], ["_how", "source_row"]).drop("_how")


def list_cases(cases: DataFrame, test_type: str = "", query: str = "") -> DataFrame:
    """Filtered case list with the facet columns of a listing."""
    kind = F.when(_text("test_type") == "", F.lit(V.UNCLASSIFIED)).otherwise(F.col("test_type"))
    out = cases.withColumn("test_type", kind)
    if test_type:
        out = out.where(F.col("test_type") == test_type)
    if query:
        out = out.where(search_blob(list_first=True).contains(query.lower()))
    return out.select(
        "case_id", F.coalesce("case_name", "case_id").alias("label"), "test_type",
        F.size("preconditions").cast("long").alias("condition_count"),
        (F.size("actions") > 0).alias("has_action"),
        (F.size("expected_behaviors") > 0).alias("has_expectation"),
    )


def filter_by_relevance(cases: DataFrame, scores: DataFrame, k: int = 5, threshold: float = 0.5) -> DataFrame:
    """Per query the k best cases: scored at or above the threshold first, the others fill up.

    cases: query_id, case_name, source_row, …; scores: query_id, name, score.
    """
    best = scores.groupBy("query_id", "name").agg(F.max("score").alias("score"))
    scored = cases.join(best.withColumnRenamed("name", "case_name"), ["query_id", "case_name"], "left").withColumn(
        "score", F.coalesce("score", F.lit(0.0))
    )
    return top_k_per_key(
        scored, ["query_id"], [F.desc(F.col("score") >= threshold), F.desc("score"), F.asc("source_row")], k
    )
