"""Vector, lexical and graph retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import lexical as L
from ..operators import vectors as VEC
from . import bindings as B
from .registry import Family
from .text_queries import tokens_sql

FAMILY = Family()
query = FAMILY.query

LABELS = ["TestCase", "Precondition", "Action", "Expected", "TestType"]


# ---------------------------------------------------------------- vectors
def entities(spark, d):
    label = F.get(F.array(*[F.lit(x) for x in LABELS]), (F.col("label") / 2).cast("int"))
    return B.table(spark, d, "embeddings").select(
        F.concat(F.lit("E"), F.col("vec_id")).alias("name"), "vec_id", label.alias("label"), "embedding"
    )


def vector_queries(spark, d):
    return B.table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


ENTITIES_SQL = f"""
entities AS (SELECT 'E' || vec_id AS name, vec_id, {LABELS}[label // 2 + 1] AS label, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query_id, e.name, e.vec_id, e.label, list_dot_product(CAST(q.embedding AS DOUBLE[]), e.embedding) AS score
  FROM embeddings q CROSS JOIN entities e),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, name) AS rank FROM pairs)"""


@query("knn_by_label", f"WITH {ENTITIES_SQL} SELECT query_id, label, name, round(score, 5) AS score, rank FROM ranked WHERE rank <= 3")
def knn_by_label(spark, d):
    out = VEC.knn(vector_queries(spark, d), entities(spark, d), 3)
    return out.withColumn("score", F.round("score", 5))


_WEIGHTED = """
weighted AS (
  SELECT query_id, name, label, score AS raw_score, score * CASE label WHEN 'TestCase' THEN 1.5::DOUBLE WHEN 'Precondition' THEN 1.2::DOUBLE
    WHEN 'Action' THEN 1.0::DOUBLE WHEN 'Expected' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS score FROM ranked WHERE rank <= 3)"""


@query(
    "key_entities",
    f"WITH {ENTITIES_SQL}, {_WEIGHTED} SELECT query_id, name, label, round(score, 5) AS score FROM weighted WHERE score >= 0.65",
)
def key_entities(spark, d):
    out = VEC.key_entities(vector_queries(spark, d), entities(spark, d))
    return out.select("query_id", "name", "label", F.round("score", 5).alias("score"))


@query(
    "similar_cases",
    f"""WITH {ENTITIES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM pairs)
        SELECT query_id, vec_id, round(score, 5) AS score, rk AS rank FROM r WHERE rk <= 3""",
)
def similar_cases(spark, d):
    out = VEC.similar_cases(vector_queries(spark, d), entities(spark, d), 3, "vec_id")
    return out.withColumn("score", F.round("score", 5))


@query(
    "best_per_name",
    """SELECT user_id AS name, max(value) AS score FROM events GROUP BY 1""",
)
def best_per_name(spark, d):
    rows = B.table(spark, d, "events").select(F.col("user_id").alias("name"), F.col("value").alias("score"), "event_id")
    return VEC.best_per(rows, ["name"]).select("name", "score")


_FIELDS = ["preconditions", "actions", "expected", "query"]


@query(
    "key_entities_structured",
    f"""WITH {ENTITIES_SQL}, q AS (SELECT vec_id AS item_id, vec_id // 4 AS query_id, {_FIELDS}[vec_id % 4 + 1] AS field FROM embeddings),
      h AS (SELECT q.query_id, r.name, r.label, r.score FROM ranked r JOIN q ON q.item_id = r.query_id
            WHERE (field = 'query' AND label = 'TestCase' AND rank <= 1) OR (rank <= 2 AND ((field = 'preconditions' AND label = 'Precondition')
              OR (field = 'actions' AND label = 'Action') OR (field = 'expected' AND label = 'Expected')))),
      b AS (SELECT query_id, name, label, max(score) AS score FROM h GROUP BY 1, 2, 3),
      kept AS (SELECT * FROM b WHERE label = 'TestCase' OR score >= 0.7::DOUBLE),
      enough AS (SELECT query_id FROM kept GROUP BY 1 HAVING count(*) >= 2),
      w AS (SELECT q.query_id, r.name, r.label, r.score * CASE label WHEN 'TestCase' THEN 1.5::DOUBLE WHEN 'Precondition' THEN 1.2::DOUBLE
              WHEN 'Action' THEN 1.0::DOUBLE WHEN 'Expected' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS score
            FROM ranked r JOIN q ON q.item_id = r.query_id WHERE field = 'query' AND rank <= 3)
      SELECT query_id, name, label, round(score, 5) AS score FROM kept WHERE query_id IN (SELECT * FROM enough)
      UNION ALL SELECT query_id, name, label, round(score, 5) FROM w WHERE score >= 0.55::DOUBLE AND query_id NOT IN (SELECT * FROM enough)""",
)
def key_entities_structured(spark, d):
    rows = B.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.floor(F.col("vec_id") / 4).alias("query_id"),
        F.get(F.array(*[F.lit(x) for x in _FIELDS]), (F.col("vec_id") % 4).cast("int")).alias("field"), "embedding",
    )
    queries = rows.where(F.col("field") == "query").select("query_id", "embedding")
    out = VEC.key_entities_structured(queries, rows.where(F.col("field") != "query"), entities(spark, d))
    return out.withColumn("score", F.round("score", 5))


# ---------------------------------------------------------------- lexical
def spec_triples(spark, d):
    """Parts as document triples."""
    return B.table(spark, d, "part").select(
        F.col("p_partkey").alias("row_id"), F.col("p_type").alias("doc_name"), F.concat("p_name", F.lit(" rev "), F.col("p_size")).alias("head"),
        F.lit("MADE_BY").alias("relation"), F.col("p_brand").alias("tail"), F.array(F.concat(F.lit("page "), F.col("p_size"))).alias("sources"),
        (F.col("p_size") > 40).alias("conflict"), F.lit("").alias("conflict_note"),
    )


def spec_queries(spark, d):
    part = B.table(spark, d, "part").select("p_type", "p_brand").distinct()
    return part.select(
        F.concat_ws("/", "p_type", "p_brand").alias("query_id"), F.concat_ws(" ", F.lit("check the"), "p_type", F.lit("part made_by"), "p_brand").alias("query")
    )


LEXICAL_SQL = f"""
spec AS (SELECT p_partkey AS row_id, p_type AS doc_name, p_name || ' rev ' || p_size AS head, 'MADE_BY' AS relation, p_brand AS tail,
  p_size > 40 AS conflict, lower(p_type || ' ' || p_name || ' rev ' || p_size || ' MADE_BY ' || p_brand || ' page ' || p_size) AS txt FROM part),
asked AS (SELECT DISTINCT p_type || '/' || p_brand AS query_id, lower('check the ' || p_type || ' part made_by ' || p_brand) AS q FROM part),
st AS (SELECT row_id, unnest({tokens_sql('txt', "string_split(replace(txt, ' ', ''), '')")}) AS tok FROM spec),
qt AS (SELECT query_id, unnest({tokens_sql('q', "string_split(replace(q, ' ', ''), '')")}) AS tok FROM asked),
ov AS (SELECT query_id, row_id, count(*) + sum(least(length(tok), 8) / 8.0::DOUBLE) AS s FROM st JOIN qt USING (tok) GROUP BY 1, 2),
bst AS (SELECT ov.query_id, spec.*, round((s + list_sum(list_transform([head, relation, tail, doc_name], lambda f:
    CASE WHEN contains(q, lower(f)) THEN 3.0::DOUBLE ELSE 0 END + CASE WHEN contains(replace(q, ' ', ''), replace(lower(f), ' ', '')) THEN 3.0::DOUBLE ELSE 0 END
    + CASE WHEN contains(replace(lower(f), ' ', ''), replace(q, ' ', '')) THEN 4.0::DOUBLE ELSE 0 END))) * CASE WHEN conflict THEN 0.85::DOUBLE ELSE 1 END, 4) AS raw
  FROM ov JOIN spec USING (row_id) JOIN asked USING (query_id)),
rel AS (SELECT *, round(raw / max(raw) OVER (PARTITION BY query_id) * 100, 2) AS score FROM bst),
dd AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_name, head, relation, tail ORDER BY score DESC, row_id) AS dup FROM rel WHERE score > 75),
pd AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_name ORDER BY score DESC, row_id) AS rd FROM dd WHERE dup = 1),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM pd WHERE rd <= 6)"""


@query("lexical_triples", f"WITH {LEXICAL_SQL} SELECT query_id, row_id, head, tail, score, rank FROM lex WHERE rank <= 20")
def lexical_triples(spark, d):
    out = L.lexical_triples(spec_queries(spark, d), spec_triples(spark, d))
    return out.select("query_id", "row_id", "head", "tail", "score", "rank")


@query(
    "cap_per_group",
    """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS g FROM events),
         r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM e WHERE g <= 3)
       SELECT user_id, event_id, rank FROM r WHERE rank <= 8""",
)
def cap_per_group(spark, d):
    events = B.table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    out = L.cap_per_group(events, ["user_id"], "event_type", [F.desc("value"), F.asc("event_id")], 3, 8)
    return out.select("user_id", "event_id", "rank")


# ---------------------------------------------------------------- graph
def edges(spark, d):
    """Orders, customers, nations, regions and part names as one graph."""
    orders = B.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    customer = B.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    nation = B.table(spark, d, "nation")
    li = B.table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    part = B.table(spark, d, "part").select("p_partkey", "p_name")

    def edge(df, src, relation, dst):
        return df.select(src.alias("src"), F.lit(relation).alias("relation"), dst.alias("dst"))

    def node(prefix, col):
        return F.concat(F.lit(prefix), F.col(col))

    bought = li.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_name").distinct()
    return (
        edge(orders, node("O-", "o_orderkey"), "PLACED_BY", node("C-", "o_custkey"))
        .unionByName(edge(customer, node("C-", "c_custkey"), "IN_NATION", node("N-", "c_nationkey")))
        .unionByName(edge(nation, node("N-", "n_nationkey"), "IN_REGION", node("R-", "n_regionkey")))
        .unionByName(edge(bought, node("O-", "l_orderkey"), "CONTAINS", node("P-", "p_name")))
    )


EDGES_SQL = """
edges AS (
  SELECT 'O-' || o_orderkey AS src, 'PLACED_BY' AS relation, 'C-' || o_custkey AS dst FROM orders
  UNION ALL SELECT 'C-' || c_custkey, 'IN_NATION', 'N-' || c_nationkey FROM customer
  UNION ALL SELECT 'N-' || n_nationkey, 'IN_REGION', 'R-' || n_regionkey FROM nation
  UNION ALL SELECT DISTINCT 'O-' || l_orderkey, 'CONTAINS', 'P-' || p_name FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def walk_entities(spark, d):
    """Per customer: its first and last order, its nation and its region."""
    orders = B.table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    customer = B.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    nation = B.table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    names = F.array(
        F.concat(F.lit("O-"), "lo"), F.concat(F.lit("O-"), "hi"), F.concat(F.lit("N-"), "n_nationkey"), F.concat(F.lit("R-"), "n_regionkey")
    )
    return rows.select(F.col("c_custkey").alias("query_id"), F.explode(F.array_distinct(names)).alias("name"))


WALK_SQL = """
walk AS (SELECT c_custkey AS query_id, 'O-' || min(o_orderkey) AS lo, 'O-' || max(o_orderkey) AS hi, 'C-' || c_custkey AS c,
  'N-' || any_value(n_nationkey) AS n, 'R-' || any_value(n_regionkey) AS r
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY c_custkey),
ords AS (SELECT query_id, lo AS o, c, n, r FROM walk UNION SELECT query_id, hi, c, n, r FROM walk),
paths AS (
  SELECT query_id, n AS u, r AS v, 1 AS distance, n || '>' || r AS path FROM walk
  UNION ALL SELECT query_id, n, o, 2, n || '>' || c || '>' || o FROM ords
  UNION ALL SELECT query_id, least(lo, hi), greatest(lo, hi), 2, least(lo, hi) || '>' || c || '>' || greatest(lo, hi) FROM walk WHERE lo <> hi
  UNION ALL SELECT query_id, o, r, 3, o || '>' || c || '>' || n || '>' || r FROM ords)"""


def walk_paths(spark, d):
    return G.shortest_paths(edges(spark, d), G.entity_pairs(walk_entities(spark, d)), 3)


@query("shortest_paths", f"WITH {WALK_SQL} SELECT query_id, u, v, CAST(distance AS BIGINT) AS distance, path FROM paths")
def shortest_paths(spark, d):
    return walk_paths(spark, d).select("query_id", "u", "v", "distance", F.array_join("path_nodes", ">").alias("path"))


TREE_SQL = """
tree AS (SELECT query_id, u, v, CAST(distance AS BIGINT) AS distance, path FROM paths WHERE u LIKE 'N-%')"""


@query("spanning_tree", f"WITH {WALK_SQL}, {TREE_SQL} SELECT query_id, u, v, distance FROM tree")
def spanning_tree(spark, d):
    return G.mst(walk_paths(spark, d)).select("query_id", "u", "v", "distance")


DIRECT_SQL = """
direct AS (
  SELECT DISTINCT query_id, n AS head, 'IN_REGION' AS relation, r AS tail FROM walk
  UNION SELECT query_id, n, 'IN_NATION', c FROM walk
  UNION SELECT query_id, c, 'PLACED_BY', o FROM ords)"""


@query("skeleton_direct", f"WITH {WALK_SQL}, {DIRECT_SQL} SELECT * FROM direct")
def skeleton_direct(spark, d):
    from ..session import materialise

    paths = materialise(walk_paths(spark, d))
    return G.skeleton_direct(G.with_paths(G.mst(paths), paths))


@query(
    "skeleton_all_paths",
    f"""WITH {EDGES_SQL}, {WALK_SQL}, p AS (SELECT query_id, least(lo, hi) AS u, greatest(lo, hi) AS v, c, n, r FROM walk WHERE lo <> hi),
          m AS (SELECT query_id, u, v, a.dst AS x, a.relation AS ru, b.relation AS rv FROM p JOIN edges a ON a.src = u JOIN edges b ON b.src = v AND b.dst = a.dst)
        SELECT DISTINCT query_id, u AS head, ru AS relation, x AS tail FROM m UNION SELECT query_id, x, rv, v FROM m
        UNION SELECT query_id, o, 'PLACED_BY', c FROM ords UNION SELECT query_id, c, 'IN_NATION', n FROM walk UNION SELECT query_id, n, 'IN_REGION', r FROM walk
        UNION SELECT query_id, n, 'IN_NATION', c FROM walk UNION SELECT query_id, c, 'PLACED_BY', o FROM ords""",
)
def skeleton_all_paths(spark, d):
    """Over all pairs, not just those of a tree, so that ties and all distances occur."""
    return G.skeleton_all(edges(spark, d), walk_paths(spark, d), 3)


def labels(spark, d):
    """Orders are test cases, part names actions, customers preconditions, places types."""
    e = edges(spark, d)
    names = e.select(F.col("src").alias("name")).union(e.select("dst")).distinct()
    kind = F.substring("name", 1, 2)
    return names.withColumn(
        "label",
        F.when(kind == "O-", F.lit("TestCase")).when(kind == "C-", F.lit("Precondition")).when(kind == "P-", F.lit("Action")).otherwise(F.lit("TestType")),
    )


_AROUND_SQL = """
cases AS (SELECT DISTINCT o AS name FROM ords),
near AS (SELECT name, relation, dst AS tail, row_number() OVER (PARTITION BY name ORDER BY
    CASE substr(dst, 1, 2) WHEN 'C-' THEN 0 WHEN 'P-' THEN 1 WHEN 'N-' THEN 3 WHEN 'R-' THEN 3 ELSE 9 END, dst, relation) AS rn
  FROM cases JOIN edges ON src = name),
around AS (SELECT DISTINCT query_id, o AS head, relation, tail FROM ords JOIN near ON o = name WHERE rn <= {limit})"""


@query(
    "expand_neighbors",
    f"WITH {EDGES_SQL}, {WALK_SQL}, {_AROUND_SQL.format(limit=3)} SELECT * FROM around",
)
def expand_neighbors(spark, d):
    return G.expand_neighbors(walk_entities(spark, d), edges(spark, d), labels(spark, d), 3)


_EVIDENCE_SQL = f"""{EDGES_SQL}, {WALK_SQL}, {DIRECT_SQL}, {_AROUND_SQL.format(limit=15)},
  evidence AS (SELECT * FROM direct UNION SELECT * FROM around)"""


@query("evidence_edges_structured", f"WITH {_EVIDENCE_SQL} SELECT * FROM evidence")
def evidence_edges_structured(spark, d):
    return _evidence(spark, d)[1]


@query(
    "evidence_metadata",
    f"""WITH {_EVIDENCE_SQL}, en AS (SELECT DISTINCT query_id, name FROM (SELECT query_id, head AS name FROM evidence UNION ALL SELECT query_id, tail FROM evidence)),
        k AS (SELECT query_id, CASE WHEN lo = hi THEN 3 ELSE 4 END AS n FROM walk)
        SELECT c_custkey AS query_id, CAST(coalesce(k.n, 0) AS BIGINT) AS key_entity_count, CAST(coalesce(k.n - 1, 0) AS BIGINT) AS mst_edge_count,
          coalesce(a.n, 0) AS total_nodes, coalesce(b.n, 0) AS total_edges,
          CASE WHEN k.n IS NULL THEN 'insufficient_entities' ELSE 'ok' END AS status
        FROM customer LEFT JOIN k ON k.query_id = c_custkey
        LEFT JOIN (SELECT query_id, count(*) AS n FROM en GROUP BY 1) a ON a.query_id = c_custkey
        LEFT JOIN (SELECT query_id, count(*) AS n FROM evidence GROUP BY 1) b ON b.query_id = c_custkey""",
)
def evidence_metadata(spark, d):
    return _evidence(spark, d)[2].select("query_id", "key_entity_count", "mst_edge_count", "total_nodes", "total_edges", "status")


def _evidence(spark, d, structured=True):
    queries = B.table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"))
    return G.evidence_subgraph(walk_entities(spark, d), queries, edges(spark, d), labels(spark, d), 3, structured)


@query(
    "evidence_edges_all_paths",
    f"""WITH {EDGES_SQL}, {WALK_SQL}, {_AROUND_SQL.format(limit=10)},
        sk AS (SELECT query_id, n AS head, 'IN_REGION' AS relation, r AS tail FROM walk UNION SELECT query_id, n, 'IN_NATION', c FROM walk
               UNION SELECT query_id, c, 'PLACED_BY', o FROM ords)
        SELECT * FROM sk UNION SELECT * FROM around""",
)
def evidence_edges_all_paths(spark, d):
    return _evidence(spark, d, structured=False)[1]


def case_edges(spark, d):
    """Cases as a typed graph, plus a sub-graph per type that lacks some cases' edges."""
    from ..operators.triples import case_triples

    rename = F.create_map(*[F.lit(x) for x in ("属于类型", "测试用例类型", "前提条件", "前提条件", "操作动作", "执行动作", "预期结果", "预期行为")])
    cases = B.cases(spark, d).withColumn("case_name", F.col("case_id"))
    return case_triples(cases).select(F.col("head").alias("src"), rename[F.col("relation")].alias("relation"), F.col("tail").alias("dst"))


@query(
    "reconstruct_cases",
    f"""WITH {B.CASES_SQL} SELECT test_type AS query_id, case_id AS case_name, test_type, array_to_string(preconditions, '|') AS preconditions,
        array_to_string(actions, '|') AS actions, array_to_string(expected_behaviors, '|') AS expected_behaviors FROM cases""",
)
def reconstruct_cases(spark, d):
    from ..session import materialise

    all_edges = materialise(case_edges(spark, d))
    cases = B.cases(spark, d).select(F.col("test_type").alias("query_id"), F.col("case_id").alias("name"))
    shown = cases.where(F.col("query_id") != "1-URGENT")
    out_edges = shown.join(all_edges, F.col("name") == F.col("src"))
    # half of the edges are seen from the other side
    flip = F.col("relation") == "前提条件"
    subgraph = out_edges.select(
        "query_id", F.when(flip, F.col("dst")).otherwise(F.col("src")).alias("head"), "relation",
        F.when(flip, F.col("src")).otherwise(F.col("dst")).alias("tail"),
    )
    out = G.reconstruct_cases(cases, subgraph, all_edges)
    return out.select("query_id", "case_name", "test_type", *[F.array_join(c, "|").alias(c) for c in ("preconditions", "actions", "expected_behaviors")])


@query(
    "categorize_nodes",
    f"""WITH {B.CASES_SQL},
      prim AS (SELECT node, min(rk) AS rk FROM (
        SELECT case_id AS node, 0 AS rk FROM cases WHERE len(preconditions) + len(actions) + len(expected_behaviors) > 0
        UNION ALL SELECT unnest(preconditions), 2 FROM cases UNION ALL SELECT unnest(actions), 4 FROM cases
        UNION ALL SELECT unnest(expected_behaviors), 3 FROM cases) GROUP BY 1)
      SELECT node, ['Test Case', 'Composite', 'Precondition', 'Expectation', 'Action'][rk + 1] AS category FROM prim
      UNION ALL SELECT DISTINCT 'sig ' || p_brand, 'Precond Signal' FROM lineitem JOIN part ON l_partkey = p_partkey
      UNION ALL SELECT DISTINCT 'val ' || p_brand, 'Precond Value' FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def categorize_nodes(spark, d):
    from ..operators.triples import case_triples

    cases = B.cases(spark, d).withColumn("case_name", F.col("case_id"))
    base = case_triples(cases).where(F.col("relation") != "属于类型").select("head", "relation", "tail", F.lit(1).cast("long").alias("row_id"))
    brands = cases.select(F.explode("preconditions").alias("b")).distinct()
    sig, val = F.concat(F.lit("sig "), F.col("b")), F.concat(F.lit("val "), F.col("b"))
    extra = brands.select(F.col("b").alias("head"), F.lit("对应信号").alias("relation"), sig.alias("tail"), F.lit(2).cast("long").alias("row_id")).unionByName(
        brands.select(sig.alias("head"), F.lit("预期值").alias("relation"), val.alias("tail"), F.lit(3).cast("long").alias("row_id"))
    )
    return G.categorize_nodes(base.unionByName(extra))


def walk_triples(spark, d):
    return edges(spark, d).select(F.col("src").alias("head"), "relation", F.col("dst").alias("tail"))


@query(
    "neighborhood_search",
    f"""WITH {EDGES_SQL}, s AS (SELECT n_nationkey AS seed_id, 'N-' || n_nationkey AS name FROM nation)
        SELECT seed_id, name FROM s UNION SELECT seed_id, dst FROM s JOIN edges ON src = name UNION SELECT seed_id, src FROM s JOIN edges ON dst = name""",
)
def neighborhood_search(spark, d):
    seeds = B.table(spark, d, "nation").select(F.col("n_nationkey").alias("seed_id"), F.concat(F.lit("N-"), F.col("n_nationkey")).alias("name"))
    return G.neighborhood(walk_triples(spark, d), seeds)


@query(
    "neighborhood_cases",
    f"""WITH {EDGES_SQL}, s AS (SELECT o_orderkey AS seed_id, 'O-' || o_orderkey AS name FROM orders), h1 AS (SELECT seed_id, dst AS name FROM s JOIN edges ON src = name)
        SELECT seed_id, name FROM s UNION SELECT * FROM h1 UNION SELECT seed_id, dst FROM h1 JOIN edges ON src = name""",
)
def neighborhood_cases(spark, d):
    seeds = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("seed_id"), F.concat(F.lit("O-"), F.col("o_orderkey")).alias("name"))
    return G.neighborhood(walk_triples(spark, d), seeds, 2)
