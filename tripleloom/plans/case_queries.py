"""Case search, grouping, derivation, evaluation and rendering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cases as C
from ..operators import search as S
from ..operators.scale import global_rank
from . import bindings as B
from .registry import Family

FAMILY = Family()
query = FAMILY.query


def _numbered(c):
    items = F.transform(F.col(c), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return F.when(F.size(c) <= 1, F.array_join(c, "")).otherwise(F.array_join(items, "\n"))


def text_cases(spark, d):
    """Cases with action and expectation texts, numbered when there are several."""
    return B.cases(spark, d).withColumns({"action_text": _numbered("actions"), "expected_text": _numbered("expected_behaviors")})


def _numbered_sql(c: str) -> str:
    return (
        f"CASE WHEN len({c}) <= 1 THEN array_to_string({c}, '') ELSE array_to_string(list_transform(range(1, len({c}) + 1), "
        f"lambda i: i || '. ' || {c}[i]), chr(10)) END"
    )


TEXT_SQL = (
    B.CASES_SQL
    + f""",
text_cases AS (SELECT *, {_numbered_sql('actions')} AS action_text, {_numbered_sql('expected_behaviors')} AS expected_text,
  len(expected_behaviors) = 1 AS single FROM cases)"""
)
BLOB = """lower(case_id || ' ' || case_name || ' ' || test_type || ' ' || array_to_string(actions, ' ') || ' ' ||
  array_to_string(expected_behaviors, ' ') || ' ' || array_to_string(preconditions, ' '))"""


# ---------------------------------------------------------------- search
def needles(spark, d):
    part = B.table(spark, d, "part")
    words = part.select(F.col("p_type").alias("query")).union(part.select("p_brand")).union(
        B.table(spark, d, "orders").select(F.concat(F.lit(" "), F.substring("o_orderpriority", 3, 20)))
    )
    return words.distinct().select(F.col("query").alias("query_id"), "query")


NEEDLES_SQL = """
needles AS (SELECT DISTINCT q AS query_id, lower(trim(q)) AS needle FROM (
  SELECT p_type AS q FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT ' ' || substr(o_orderpriority, 3, 20) FROM orders))"""


@query(
    "search_cases",
    f"""WITH {B.CASES_SQL}, {NEEDLES_SQL}, b AS (SELECT *, {BLOB} AS blob FROM cases),
      h AS (SELECT query_id, case_id, case_name, source_row, round(least(
          CASE WHEN contains(lower(case_name), needle) THEN 0.55::DOUBLE ELSE 0 END + CASE WHEN contains(lower(test_type), needle) THEN 0.25::DOUBLE ELSE 0 END
          + CASE WHEN contains(lower(case_id), needle) THEN 0.15::DOUBLE ELSE 0 END
          + CASE WHEN contains(lower(array_to_string(actions, ' ')), needle) OR contains(lower(array_to_string(expected_behaviors, ' ')), needle) THEN 0.1::DOUBLE ELSE 0 END
          + CASE WHEN contains(lower(array_to_string(preconditions, ' ')), needle) THEN 0.05::DOUBLE ELSE 0 END, 0.999::DOUBLE), 4) AS score
        FROM b JOIN needles ON contains(blob, needle))
      SELECT query_id, case_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, case_name, source_row) AS rank,
             count(*) OVER (PARTITION BY query_id) AS total FROM h QUALIFY rank <= 50""",
)
def search_cases(spark, d):
    return S.search_cases(B.cases(spark, d), needles(spark, d), 50).select("query_id", "case_id", "score", "rank", "total")


def questions(spark, d):
    """One question per part type and brand."""
    part = B.table(spark, d, "part").select("p_type", "p_brand").distinct()
    return part.select(
        F.concat_ws("/", "p_type", "p_brand").alias("question_id"),
        F.concat(F.lit("Which urgent orders, of customer 7, need "), F.col("p_type"), F.lit(" + "), F.col("p_brand"), F.lit("?")).alias("question"),
    )


QUESTIONS_SQL = """
questions AS (SELECT DISTINCT p_type || '/' || p_brand AS question_id,
  'Which urgent orders, of customer 7, need ' || p_type || ' + ' || p_brand || '?' AS question FROM part),
tokens AS (
  SELECT question_id, tok, row_number() OVER (PARTITION BY question_id ORDER BY length(tok) DESC, pos) - 1 AS place FROM (
    SELECT question_id, tok, min(pos) AS pos FROM (
      SELECT question_id, unnest(regexp_extract_all(lower(question), '[a-z0-9_]{2,}')) AS tok,
             generate_subscripts(regexp_extract_all(lower(question), '[a-z0-9_]{2,}'), 1) AS pos FROM questions) GROUP BY 1, 2))"""


def _retrieved_sql(limit: int) -> str:
    return f"""
hits AS (
  SELECT question_id, case_id, any_value(case_name) AS case_name, any_value(source_row) AS source_row, any_value(test_type) AS test_type,
         any_value(preconditions) AS preconditions, any_value(actions) AS actions, any_value(expected_behaviors) AS expected_behaviors,
         sum(greatest(length(tok) / 8.0::DOUBLE, 0.15::DOUBLE)) AS weight, bool_or(place < 12 AND contains(lower(case_name), tok)) AS in_name,
         bool_or(place < 12 AND contains(lower(test_type), tok)) AS in_type
  FROM (SELECT *, {BLOB} AS blob FROM cases) JOIN tokens ON contains(blob, tok) GROUP BY 1, 2),
retrieved AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, case_name, source_row) AS rank FROM (
    SELECT *, round(least(least(weight, 1.2::DOUBLE) + CASE WHEN in_name THEN 0.35::DOUBLE ELSE 0 END
      + CASE WHEN in_type THEN 0.2::DOUBLE ELSE 0 END, 0.999::DOUBLE), 4) AS score FROM hits) QUALIFY rank <= {limit})"""


@query(
    "retrieve_cases",
    f"WITH {B.CASES_SQL}, {QUESTIONS_SQL}, {_retrieved_sql(8)} SELECT question_id, case_id, score, rank FROM retrieved",
)
def retrieve_cases(spark, d):
    return S.retrieve_cases(B.cases(spark, d), questions(spark, d), 8, early=12).select("question_id", "case_id", "score", "rank")


@query(
    "types_overview",
    f"""WITH {B.CASES_SQL} SELECT test_type, arg_min(case_id, source_row) AS case_id, 0.9::DOUBLE AS score FROM cases
        GROUP BY 1 ORDER BY min(source_row) LIMIT 4""",
)
def types_overview(spark, d):
    return S.types_overview(B.cases(spark, d), 4).select("test_type", "case_id", "score")


@query(
    "find_case",
    f"""WITH {B.CASES_SQL}, l AS (SELECT c_custkey AS lookup_id, CASE WHEN c_acctbal > 5000 THEN 'O-' || c_custkey ELSE 'customer ' || c_custkey END AS needle FROM customer),
        e AS (SELECT lookup_id, case_id, source_row FROM l JOIN cases ON case_id = needle),
        n AS (SELECT lookup_id, arg_min(case_id, source_row) AS case_id, min(source_row) AS source_row FROM l JOIN cases ON contains(case_name, needle)
              WHERE lookup_id NOT IN (SELECT lookup_id FROM e) GROUP BY 1)
        SELECT * FROM e UNION ALL SELECT * FROM n""",
)
def find_case(spark, d):
    lookups = B.table(spark, d, "customer").select(
        F.col("c_custkey").alias("lookup_id"),
        F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("O-"), F.col("c_custkey")))
        .otherwise(F.concat(F.lit("customer "), F.col("c_custkey"))).alias("needle"),
    )
    return S.find_case(B.cases(spark, d), lookups).select("lookup_id", "case_id", "source_row")


@query(
    "list_cases",
    f"""WITH {B.CASES_SQL} SELECT case_id, case_name AS label, test_type, CAST(len(preconditions) AS BIGINT) AS condition_count,
          len(actions) > 0 AS has_action, len(expected_behaviors) > 0 AS has_expectation
        FROM cases WHERE test_type = '2-HIGH' AND contains({BLOB}, 'brand#1')""",
)
def list_cases(spark, d):
    return S.list_cases(B.cases(spark, d), "2-HIGH", "Brand#1")


@query(
    "filter_by_relevance",
    f"""WITH {B.CASES_SQL}, c AS (SELECT test_type AS query_id, case_name, source_row FROM cases),
        s AS (SELECT 'order ' || o_orderstatus || ' of customer ' || o_custkey AS case_name, o_orderpriority AS query_id, max(round(o_totalprice / 500000, 2)) AS score
              FROM orders GROUP BY 1, 2)
        SELECT c.query_id, c.case_name, source_row, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY c.query_id
          ORDER BY coalesce(score, 0) >= 0.8 DESC, coalesce(score, 0) DESC, source_row) AS rank
        FROM c LEFT JOIN s ON c.query_id = s.query_id AND c.case_name = s.case_name QUALIFY rank <= 5""",
)
def filter_by_relevance(spark, d):
    cases = B.cases(spark, d).select(F.col("test_type").alias("query_id"), "case_name", "source_row")
    scores = B.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("query_id"),
        F.concat(F.lit("order "), F.col("o_orderstatus"), F.lit(" of customer "), F.col("o_custkey")).alias("name"),
        F.round(F.col("o_totalprice") / 500000, 2).alias("score"),
    )
    return S.filter_by_relevance(cases, scores, 5, 0.8)


# ---------------------------------------------------------------- grouping
@query(
    "cases_by_action",
    f"""WITH {TEXT_SQL} SELECT CASE WHEN action_text = '' THEN '未分类' ELSE action_text END AS action, count(*) AS case_count,
        CAST(sum(CASE WHEN single THEN 1 ELSE 0 END) AS BIGINT) AS single_count FROM text_cases GROUP BY 1""",
)
def cases_by_action(spark, d):
    return C.by_action(text_cases(spark, d))


@query(
    "cases_by_type_action",
    f"""WITH {TEXT_SQL}, g AS (SELECT test_type, CASE WHEN action_text = '' THEN '未分类' ELSE action_text END AS action, count(*) AS case_count
          FROM text_cases GROUP BY 1, 2)
        SELECT *, CAST(sum(case_count) OVER (PARTITION BY test_type) AS BIGINT) AS total_count FROM g""",
)
def cases_by_type_action(spark, d):
    return C.by_type_action(text_cases(spark, d))


@query(
    "type_action_statistics",
    f"""WITH {TEXT_SQL}, g AS (SELECT test_type, action_text, count(*) AS n FROM text_cases GROUP BY 1, 2)
        SELECT CAST(sum(n) AS BIGINT) AS total_cases, count(DISTINCT test_type) AS total_types, count(*) AS total_groups,
               round(sum(n) / count(DISTINCT test_type), 1) AS average_per_type FROM g""",
)
def type_action_statistics(spark, d):
    return C.group_statistics(C.by_type_action(text_cases(spark, d)), "cases")


@query(
    "cases_by_type_expected",
    f"""WITH {TEXT_SQL} SELECT test_type, expected_text AS expected, count(*) AS case_count, bool_or(single) AS single
        FROM text_cases GROUP BY 1, 2""",
)
def cases_by_type_expected(spark, d):
    return C.by_type_expected(text_cases(spark, d))


@query(
    "type_facets",
    f"""WITH {B.CASES_SQL} SELECT test_type, count(*) AS case_count, arg_min(case_id, source_row) AS first_case_id,
          (SELECT count(*) FROM cases) AS matched, round((SELECT count(*) / count(DISTINCT test_type) FROM cases), 1) AS average_per_type
        FROM cases GROUP BY 1""",
)
def type_facets(spark, d):
    return C.type_facets(B.cases(spark, d))


@query(
    "order_by_case_id",
    f"""WITH {B.CASES_SQL}, o AS (SELECT *, min(source_row) OVER (PARTITION BY test_type) AS f FROM cases)
        SELECT case_id, test_type, row_number() OVER (ORDER BY f, source_row) AS place FROM o""",
)
def order_by_case_id(spark, d):
    """The operator's row order, made visible as a number."""
    ordered = C.order_by_case_id(B.cases(spark, d)).withColumn("n", F.monotonically_increasing_id())
    ranked = global_rank(ordered, [F.col("n")], "place")
    return ranked.select("case_id", "test_type", "place")


@query(
    "task_stats",
    """SELECT event_type AS task_id, CAST(sum(CASE WHEN value > 30 THEN 1 ELSE 0 END) AS BIGINT) AS succeeded,
         CAST(sum(CASE WHEN value > 30 THEN 0 ELSE 1 END) AS BIGINT) AS failed, count(*) AS total,
         round(sum(CASE WHEN value > 30 THEN 1 ELSE 0 END) / count(*) * 100, 1) || '%' AS success_rate FROM events GROUP BY 1""",
)
def task_stats(spark, d):
    return C.task_stats(B.table(spark, d, "events").select(F.col("event_type").alias("task_id"), (F.col("value") > 30).alias("ok")))


@query(
    "source_summary",
    """SELECT o_orderstatus AS source, count(*) AS case_count, count(DISTINCT o_orderpriority) AS type_count, count(*) * 3 AS triple_count
       FROM orders GROUP BY 1""",
)
def source_summary(spark, d):
    return C.source_summary(
        B.table(spark, d, "orders").select(F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("test_type"))
    )


# ---------------------------------------------------------------- sampling and graph projection
def _sample_sql(n: int, strata: str) -> str:
    order = "n DESC, test_type" if strata == "largest" else "f, test_type"
    return f"""
ranks AS (SELECT test_type, row_number() OVER (ORDER BY {order}) AS stratum_rank FROM (
  SELECT test_type, count(*) AS n, min(source_row) AS f FROM cases GROUP BY 1)),
sample AS (SELECT * FROM (SELECT c.*, stratum_rank, row_number() OVER (PARTITION BY c.test_type ORDER BY source_row) AS turn
  FROM cases c JOIN ranks USING (test_type)) ORDER BY turn, stratum_rank LIMIT {n})"""


@query("round_robin_sample", f"WITH {B.CASES_SQL}, {_sample_sql(100, 'largest')} SELECT case_id, test_type, turn, stratum_rank FROM sample")
def round_robin_sample(spark, d):
    out = C.round_robin(B.cases(spark, d), "test_type", 100, [F.asc("source_row")])
    return out.select("case_id", "test_type", "turn", "stratum_rank")


@query("round_robin_by_first_id", f"WITH {B.CASES_SQL}, {_sample_sql(180, 'first_id')} SELECT case_id, test_type, turn, stratum_rank FROM sample")
def round_robin_by_first_id(spark, d):
    from ..functions.text import case_id_key

    out = C.round_robin(B.cases(spark, d), "test_type", 180, [case_id_key("case_id")], strata="first_id")
    return out.select("case_id", "test_type", "turn", "stratum_rank")


PROJECTION_SQL = f"""
{_sample_sql(100, 'largest')},
slots AS (
  SELECT *, (list_transform(range(len(preconditions)), lambda i: ['condition:' || case_id || ':' || i, preconditions[i + 1], '前提条件', 'condition'])
    || list_transform(range(len(actions)), lambda i: ['action:' || case_id || ':' || i, actions[i + 1], '执行动作', 'action'])
    || list_transform(range(len(expected_behaviors)), lambda i: ['expectation:' || case_id || ':' || i, expected_behaviors[i + 1], '预期行为', 'expectation']))[1:4] AS d
  FROM sample),
budget AS (SELECT *, greatest(0, 385 - coalesce(sum(len(d)) OVER (ORDER BY turn, stratum_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS room FROM slots),
detail AS (SELECT case_id, unnest(d[1:CAST(room AS BIGINT)]) AS x FROM budget)"""


@query(
    "graph_projection_edges",
    f"""WITH {B.CASES_SQL}, {PROJECTION_SQL} SELECT 'type:' || test_type AS source, 'case:' || case_id AS target, '包含用例' AS relation FROM sample
        UNION ALL SELECT 'case:' || case_id, x[1], x[3] FROM detail""",
)
def graph_projection_edges(spark, d):
    return C.graph_projection(B.cases(spark, d), 100)[1]


@query(
    "graph_projection_nodes",
    f"""WITH {B.CASES_SQL}, {PROJECTION_SQL}, n AS (
          SELECT 'type:' || test_type AS id, test_type AS label, 'type' AS kind FROM sample
          UNION ALL SELECT 'case:' || case_id, case_name, 'case' FROM sample
          UNION ALL SELECT x[1], x[2], x[4] FROM detail)
        SELECT id, min(label) AS label, min(kind) AS kind, count(*) AS degree FROM n GROUP BY 1""",
)
def graph_projection_nodes(spark, d):
    return C.graph_projection(B.cases(spark, d), 100)[0]


@query(
    "node_degree",
    f"""WITH {B.CASES_SQL}, n AS (SELECT test_type AS id FROM cases UNION ALL SELECT unnest(preconditions) FROM cases)
        SELECT id, id AS label, 'node' AS kind, count(*) AS degree FROM n GROUP BY 1""",
)
def node_degree(spark, d):
    cases = B.cases(spark, d)
    ids = cases.select(F.col("test_type").alias("id")).union(cases.select(F.explode("preconditions")))
    return C.node_degree(ids.select("id", F.col("id").alias("label"), F.lit("node").alias("kind")))


# ---------------------------------------------------------------- filters and derived cases
@query(
    "complete_cases",
    f"""WITH {B.CASES_SQL} SELECT arg_min(case_id, source_row) AS case_id, min(source_row) AS source_row FROM cases
        WHERE len(actions) > 0 AND len(expected_behaviors) > 0
        GROUP BY lower(case_name), preconditions, actions, expected_behaviors""",
)
def complete_cases(spark, d):
    return C.complete_cases(B.cases(spark, d)).select("case_id", "source_row")


@query("positive_single", f"WITH {TEXT_SQL} SELECT case_id FROM text_cases WHERE single AND NOT contains(expected_text, '无')")
def positive_single(spark, d):
    return C.positive_single(text_cases(spark, d)).select("case_id")


@query("facet_multiple", f"WITH {TEXT_SQL} SELECT case_id FROM text_cases WHERE NOT single AND contains(lower(case_name), 'customer 1')")
def facet_multiple(spark, d):
    return C.facet_cases(text_cases(spark, d), "multiple", "Customer 1").select("case_id")


@query(
    "batch_groups",
    f"""WITH {TEXT_SQL} SELECT action_text AS action, CAST(sum(CASE WHEN single THEN 1 ELSE 0 END) AS BIGINT) AS single_count,
        CAST(sum(CASE WHEN single THEN 0 ELSE 1 END) AS BIGINT) AS multiple_count FROM text_cases GROUP BY 1""",
)
def batch_groups(spark, d):
    return C.batch_groups(text_cases(spark, d))


_COMBOS_SQL = """
items AS (SELECT *, CASE WHEN len(actions) > 1 THEN actions ELSE [action_text] END AS a FROM text_cases WHERE len(expected_behaviors) > 1),
sized AS (SELECT *, least(len(a), len(expected_behaviors)) AS n FROM items),
combos AS (
  SELECT *, list_filter(range(1, n + 1), lambda i: ((mask >> (i - 1)) & 1) = 1) AS idx FROM (
    SELECT *, unnest(range(1, (1 << CAST(n AS INTEGER)) - 1)) AS mask FROM sized WHERE n > 1))"""


def _items_sql(source: str) -> str:
    return (
        f"CASE WHEN len(idx) = 1 THEN {source}[idx[1]] ELSE array_to_string(list_transform(range(1, len(idx) + 1), "
        f"lambda i: i || '. ' || {source}[idx[i]]), chr(10)) END"
    )


_COMBO_OUT = f"""SELECT case_id, case_name || '-combo' || len(idx) || 'items(items ' || array_to_string(idx, '+') || ')' AS combo_name,
    {_items_sql('a')} AS action_text, {_items_sql('expected_behaviors')} AS expected_text, 'combination(' || len(idx) || '/' || n || ')' AS method FROM combos"""


@query("combination_cases", f"WITH {TEXT_SQL}, {_COMBOS_SQL} {_COMBO_OUT}")
def combination_cases(spark, d):
    return C.combination_cases(text_cases(spark, d)).drop("test_type", "preconditions")


@query("combination_prefixes", f"WITH {TEXT_SQL}, {_COMBOS_SQL} {_COMBO_OUT} WHERE idx = range(1, len(idx) + 1)")
def combination_prefixes(spark, d):
    return C.combination_cases(text_cases(spark, d), prefixes_only=True).drop("test_type", "preconditions")


@query(
    "shared_items",
    f"""WITH {B.CASES_SQL}, s AS (SELECT case_name, test_type, count(*) AS n FROM cases GROUP BY 1, 2),
        i AS (SELECT case_name, test_type, item, count(*) AS n FROM (SELECT case_name, test_type, unnest(preconditions) AS item FROM cases) GROUP BY 1, 2, 3)
        SELECT case_name, test_type, item FROM i JOIN s USING (case_name, test_type, n)""",
)
def shared_items(spark, d):
    return C.shared_items(B.cases(spark, d), ["case_name", "test_type"], "case_id", "preconditions")


REVERSE_SQL = """
picked AS (SELECT *, CASE WHEN len(preconditions) > 1 THEN preconditions[1] || '/' || preconditions[2] ELSE action_text END AS act
  FROM text_cases WHERE single),
grp AS (SELECT expected_text, act, count(*) AS n, min(source_row) AS lead FROM picked GROUP BY 1, 2),
shared AS (SELECT expected_text, act, item, count(*) AS n FROM (SELECT expected_text, act, unnest(preconditions) AS item FROM picked) GROUP BY 1, 2, 3),
plan AS (
  SELECT 'Reverse-' || p.case_name AS case_name, p.test_type, p.preconditions, s.act AS action_text,
         CASE WHEN s.expected_text = 'AF' THEN 'negated AF' ELSE 'NOT(' || s.expected_text || ')' END AS expected_text,
         item AS original_precondition, 'NOT(' || item || ')' AS reversed_precondition
  FROM shared s JOIN grp g ON s.expected_text = g.expected_text AND s.act = g.act AND s.n = g.n
  JOIN picked p ON p.source_row = g.lead)"""


def reverse_cases(spark, d):
    """Single-expectation cases whose action is their first two preconditions, so groups are small and many."""
    cases = text_cases(spark, d)
    first_two = F.concat_ws("/", F.get("preconditions", 0), F.get("preconditions", 1))
    cases = cases.withColumn("action_text", F.when(F.size("preconditions") > 1, first_two).otherwise(F.col("action_text")))
    negations = spark.createDataFrame([("AF", "negated AF")], "text string, negated string")
    return C.reverse_plan(cases, negations)


@query(
    "reverse_plan",
    f"""WITH {TEXT_SQL}, {REVERSE_SQL} SELECT case_name, test_type, array_to_string(list_transform(preconditions,
          lambda p: CASE WHEN p = original_precondition THEN reversed_precondition ELSE p END), '|') AS preconditions, action_text, expected_text,
          original_precondition, reversed_precondition FROM plan""",
)
def reverse_plan(spark, d):
    return reverse_cases(spark, d).withColumn("preconditions", F.array_join("preconditions", "|"))


@query(
    "export_cases",
    f"""WITH {B.CASES_SQL} SELECT case_id AS export_id, 'new ' || case_name AS case_name,
          array_to_string(list_transform(range(1, len(preconditions) + 1), lambda i: i || '. ' || preconditions[i]), chr(10)) AS preconditions,
          CASE WHEN test_type = '1-URGENT' THEN case_name || '、missing' WHEN test_type = '2-HIGH' THEN 'Original: a' || chr(10) || 'Negated: b' ELSE 'manual' END AS basis
        FROM cases""",
)
def export_cases(spark, d):
    cases = B.cases(spark, d)
    kind = F.col("test_type")
    generated = cases.select(
        F.col("case_id").alias("export_id"), F.concat(F.lit("new "), F.col("case_name")).alias("case_name"), "preconditions",
        F.lit("a").alias("action_text"), F.lit("e").alias("expected_text"),
        F.when(kind == "1-URGENT", F.array("case_id", F.lit("missing"))).alias("related_ids"),
        F.when(kind == "2-HIGH", F.lit("a")).alias("original_precondition"),
        F.when(kind == "2-HIGH", F.lit("b")).alias("reversed_precondition"), F.lit("manual").alias("method"),
    )
    return C.export_cases(generated, cases).select("export_id", "case_name", "preconditions", "basis")


# ---------------------------------------------------------------- evaluation, rounds, triage, answers
def generated_texts(spark, d):
    """Documents wrapped into case sections, some of them missing or malformed."""
    lang = F.col("lang")
    return B.table(spark, d, "documents").select(
        "doc_id", "lang",
        F.when(lang == "fr", F.col("text"))
        .when(lang == "de", F.concat(F.lit("测试项：x\n前提条件："), F.col("text"), F.lit("\n执行动作：go\n预期行为：")))
        .otherwise(F.concat(F.lit("测试项：x\n前提条件：1. ready\n执行动作：go\n预期行为："), F.col("text")))
        .alias("case_text"),
    )


_EVAL_SQL = r"""
t AS (SELECT doc_id, lang, CASE WHEN lang = 'fr' THEN text WHEN lang = 'de' THEN '测试项：x' || chr(10) || '前提条件：' || text || chr(10) || '执行动作：go' || chr(10) || '预期行为：'
  ELSE '测试项：x' || chr(10) || '前提条件：1. ready' || chr(10) || '执行动作：go' || chr(10) || '预期行为：' || text END AS case_text,
  text FROM documents)"""


@query(
    "evaluate_case",
    rf"""WITH {_EVAL_SQL} SELECT doc_id, CAST(greatest(0, 100
        - CASE WHEN lang = 'fr' THEN 80 ELSE 0 END
        - CASE WHEN lang = 'de' AND NOT regexp_matches(regexp_replace(text, '^\s+|\s+$', '', 'g'), '(^|\n)\s*\d+\s*[.|、]\s*\S+') THEN 10 ELSE 0 END
        - CASE WHEN lang = 'de' THEN 10 ELSE 0 END
        - CASE WHEN lang NOT IN ('fr', 'de') AND NOT regexp_matches(text, '\S') THEN 10 ELSE 0 END
        - CASE WHEN length(case_text) < 120 THEN 10 ELSE 0 END) AS BIGINT) AS score FROM t""",
)
def evaluate_case(spark, d):
    rows = generated_texts(spark, d).select("doc_id", C.evaluate_case("case_text").alias("e"))
    return rows.select("doc_id", "e.score")


@query(
    "evaluate_fields",
    f"""WITH {_EVAL_SQL} SELECT doc_id, CAST(CASE WHEN lang = 'fr' THEN 20 ELSE 100 END - CASE WHEN length(case_text) < 120 THEN 10 ELSE 0 END AS BIGINT) AS score,
          CAST(CASE WHEN lang = 'fr' THEN 4 ELSE 0 END + CASE WHEN length(case_text) < 120 THEN 1 ELSE 0 END AS BIGINT) AS issues FROM t""",
)
def evaluate_fields(spark, d):
    rows = generated_texts(spark, d).select("doc_id", C.evaluate_fields("case_text").alias("e"))
    return rows.select("doc_id", "e.score", F.size("e.issues").cast("long").alias("issues"))


@query(
    "best_round",
    """WITH r AS (SELECT user_id AS case_id, event_id AS round, CAST(floor(value) AS BIGINT) AS score FROM events),
         h AS (SELECT case_id, min(round) AS round FROM r WHERE score >= 300 GROUP BY 1),
         b AS (SELECT case_id, round, score, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, round) AS rn FROM r)
       SELECT b.case_id, h.case_id IS NOT NULL AS reached, coalesce(r.round, b.round) AS round, coalesce(r.score, b.score) AS score
       FROM b LEFT JOIN h ON h.case_id = b.case_id LEFT JOIN r ON r.case_id = h.case_id AND r.round = h.round WHERE rn = 1""",
)
def best_round(spark, d):
    rounds = B.table(spark, d, "events").select(
        F.col("user_id").alias("case_id"), F.col("event_id").alias("round"), F.floor("value").alias("score")
    )
    return C.best_round(rounds, 300, keep=())


@query(
    "fault_triage",
    f"""WITH {B.CASES_SQL}, {QUESTIONS_SQL}, {_retrieved_sql(6)}, n AS (SELECT question_id, count(*) AS n FROM retrieved GROUP BY 1)
        SELECT question_id, rank, case_id, case_name AS title, CASE rank WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS likelihood,
          array_to_string(list_filter([
            CASE WHEN len(preconditions) > 0 THEN 'Verify preconditions: ' || array_to_string(preconditions[1:2], '; ') END,
            CASE WHEN len(actions) > 0 THEN 'Reproduce actions: ' || array_to_string(actions[1:2], '; ') END,
            CASE WHEN len(expected_behaviors) > 0 THEN 'Compare expected behavior: ' || array_to_string(expected_behaviors[1:2], '; ') END], lambda x: x IS NOT NULL), '|') AS checks,
          'E' || rank AS evidence_id, n < 2 AS insufficient_evidence FROM retrieved JOIN n USING (question_id) WHERE rank <= 4""",
)
def fault_triage(spark, d):
    evidence = S.retrieve_cases(B.cases(spark, d), questions(spark, d), 6, early=12)
    return C.fault_triage(evidence, causes=4, items=2).withColumn("checks", F.array_join("checks", "|"))


@query(
    "qa_answers",
    f"""WITH {B.CASES_SQL}, {QUESTIONS_SQL}, {_retrieved_sql(8)},
        a AS (SELECT question_id, string_agg('- **' || case_name || '** (' || test_type || ') [' || rank || ']', chr(10) ORDER BY rank) FILTER (WHERE rank <= 6) AS listed,
                max(CASE WHEN rank = 1 THEN '- **Case**: ' || case_name || '[1]' || chr(10) || '- **Type**: ' || test_type || chr(10)
                  || '- **Preconditions**: ' || CASE WHEN len(preconditions) > 0 THEN array_to_string(preconditions, '; ') ELSE 'Not provided' END || chr(10)
                  || '- **Actions**: ' || CASE WHEN len(actions) > 0 THEN array_to_string(actions, '; ') ELSE 'Not provided' END || chr(10)
                  || '- **Expected behavior**: ' || CASE WHEN len(expected_behaviors) > 0 THEN array_to_string(expected_behaviors, '; ') ELSE 'Not provided' END END) AS sample
              FROM retrieved GROUP BY 1)
        SELECT question_id, 'Reference answer below.' || chr(10) || chr(10) || '**Supported by evidence**:' || chr(10) ||
          'From retrieved evidence, these cases are relevant:' || chr(10) || listed || chr(10) || chr(10) || '**Sample case structure**:' || chr(10) ||
          sample || chr(10) || chr(10) || '**Note**: Answer from local case retrieval; open evidence on the right for details.' AS answer FROM a""",
)
def qa_answers(spark, d):
    asked = questions(spark, d)
    return C.qa_answers(S.answer_cases(B.cases(spark, d), asked, 8, early=12), asked, max_types=12, max_cases=6)


@query(
    "render_pae",
    f"""WITH {B.CASES_SQL} SELECT case_id, md5('[Test Case ' || source_row || '] ' || case_name || chr(10) || 'Test type: ' || test_type || chr(10) || chr(10) ||
          'Logic chain:' || chr(10) || '  Precondition: ' || CASE len(preconditions) WHEN 0 THEN 'none' WHEN 1 THEN preconditions[1]
            ELSE '【' || array_to_string(preconditions, '、') || '】' END || chr(10) || '  ↓' || chr(10) ||
          CASE WHEN len(actions) = 0 THEN '  Action: none' || chr(10) ELSE array_to_string(list_transform(range(1, len(actions) + 1),
            lambda i: '  Action ' || i || ': ' || actions[i] || chr(10)), '') END || '  ↓' || chr(10) ||
          CASE WHEN len(expected_behaviors) = 0 THEN '  Expectation: none' || chr(10) ELSE array_to_string(list_transform(range(1, len(expected_behaviors) + 1),
            lambda i: '  Expectation ' || i || ': ' || expected_behaviors[i] || chr(10)), '') END ||
          chr(10) || repeat('-', 60) || chr(10) || chr(10)) AS text_md5 FROM cases""",
)
def render_pae(spark, d):
    return B.cases(spark, d).select("case_id", F.md5(C.render_pae("source_row")).alias("text_md5"))


@query(
    "render_evidence",
    f"""WITH {B.LINES_SQL} SELECT l_orderkey, md5('Related feature information from the knowledge graph:' || chr(10) ||
          string_agg('- order CONTAINS ' || p_name, chr(10) ORDER BY pos)) AS triples_md5,
          md5('Evidence' || chr(10) || string_agg(pos || '. [' || p_type || '] (order, CONTAINS, ' || p_name || ') | source: s' || l_suppkey || ', ' || p_brand ||
            CASE WHEN l_discount > 0.05 THEN ' | conflict: true' ELSE '' END, chr(10) ORDER BY pos)) AS spec_md5
        FROM lines GROUP BY 1""",
)
def render_evidence(spark, d):
    rows = B.lines(spark, d).select(
        "l_orderkey", "pos", F.lit("order").alias("head"), F.lit("CONTAINS").alias("relation"), F.col("p_name").alias("tail"),
        F.col("p_type").alias("doc_name"), F.array(F.concat(F.lit("s"), F.col("l_suppkey")), F.col("p_brand")).alias("sources"),
        (F.col("l_discount") > 0.05).alias("conflict"),
    )
    plain = C.render_list(rows, ["l_orderkey"], C.triple_line(), ["pos"], "Related feature information from the knowledge graph:\n", "a")
    spec = C.render_list(rows, ["l_orderkey"], C.spec_line("pos"), ["pos"], "Evidence\n", "b")
    return plain.join(spec, "l_orderkey").select("l_orderkey", F.md5("a").alias("triples_md5"), F.md5("b").alias("spec_md5"))


@query(
    "case_graph",
    f"""WITH {B.CASES_SQL} SELECT DISTINCT * FROM (
          SELECT case_name AS source, unnest(preconditions) AS target, '前提条件' AS relation FROM cases
          UNION ALL SELECT case_name, unnest(actions), '执行动作' FROM cases
          UNION ALL SELECT case_name, unnest(expected_behaviors), '预期行为' FROM cases)""",
)
def case_graph(spark, d):
    return C.case_graph(C.complete_cases(B.cases(spark, d)).unionByName(B.cases(spark, d)))
