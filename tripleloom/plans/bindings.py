"""Views over the benchmark tables that stand in for the domain tables.

Each view is given twice: as a DataFrame and, in ``CTE``, as the SQL the oracle
uses.  Rule tables use words of the benchmark corpus so that every branch has hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# rule tables over words of the benchmark corpus
COMPONENT_RULES = [("gallic_risk", ["FR", "PARTS"]), ("german_risk", ["DE"])]
SUMMARY_RULES = [
    ("token_risk", ["TOKEN", "PASSWORD"]),
    ("licence_risk", ["LICENSE", "COPYRIGHT"]),
    ("iberian_risk", ["CIONQUE", "ES"]),
]
REFINEMENT_RULES = [
    ("SECRETS", ["TOKEN = ", "PASSWORD"]),
    ("LEGAL", ["LICENSE", "COPYRIGHT"]),
    ("LONG_WORDS", ["ORANTION", "INORAN"]),
    ("COMMON_WORDS", ["THAT ", "WITH "]),
]
DENY = ["THATIN", "THING"]
ALLOW = ["TOKEN", "TIONREST", "ORANTION"]
WEIGHTS = {"gallic_risk": 4, "german_risk": 3, "token_risk": 5, "iberian_risk": 1}


TEXT_TABLES = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A benchmark table; text that comes in fewer files than there are cores is spread over them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXT_TABLES and len(df.inputFiles()) < cores:
        return df.repartition(cores)
    return df


def complaints(spark: SparkSession, d: str) -> DataFrame:
    """documents with labels as complaints."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("row_id"),
        F.col("source").alias("vehicle_key"),
        F.col("doc_id").cast("string").alias("odi_number"),
        F.when(F.col("lang") == "en", F.lit("UNKNOWN OR OTHER")).otherwise(F.upper("lang")).alias("component"),
        F.col("text").alias("summary"),
        F.when(F.col("toxic") == 1, F.lit("True")).otherwise(F.lit("False")).alias("crash"),
        F.when(F.col("quality") == 0, F.lit("yes")).otherwise(F.lit("no")).alias("fire"),
        F.when(F.col("quality") == 1, F.floor(F.col("n_chars") / 1000).cast("string"))
        .otherwise(F.lit("n/a"))
        .alias("injury"),
    )


def recalls(spark: SparkSession, d: str) -> DataFrame:
    """error events as recalls."""
    parts = F.array(*[F.lit(x) for x in ("UNKNOWN OR OTHER", "FR", "DE", "ES", "PARTS")])
    return (
        table(spark, d, "events")
        .where(F.col("event_type") == "error")
        .select(
            F.col("event_id").alias("row_id"),
            F.concat(F.lit("src"), F.col("user_id") % 20).alias("vehicle_key"),
            F.concat(F.lit("C"), F.col("event_id")).alias("campaign_number"),
            F.get(parts, (F.floor("value") % 5).cast("int")).alias("component"),
            F.concat(F.lit("error value "), F.floor("value").cast("string"), F.lit(" props "), F.col("props")).alias("summary"),
        )
    )


def templates(spark: SparkSession) -> DataFrame:
    """Objective and expected result per scenario (the licence scenario has none)."""
    names = ["gallic_risk", "german_risk", "token_risk", "iberian_risk", "unknown_vehicle_risk"]
    return spark.createDataFrame(
        [(n, f"verify {n}", f"no {n}") for n in names], "risk_scenario string, test_objective string, expected_result string"
    )


def case_templates(spark: SparkSession) -> DataFrame:
    fields = ["title", "environment", "preconditions", "steps", "signals", "criteria"]
    rows = [(n, *[f"{f} of {n}" for f in fields]) for n in ("gallic_risk", "german_risk", "token_risk")]
    rows.append((None, *[f"default {f}" for f in fields]))
    return spark.createDataFrame(rows, "risk_scenario string, " + ", ".join(f"{f} string" for f in fields))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import risk

    return risk.candidates(
        recalls(spark, d), complaints(spark, d), templates(spark), COMPONENT_RULES, SUMMARY_RULES
    )


RISK_RULES = {"rules": REFINEMENT_RULES, "deny": DENY, "allow": ALLOW, "weights": WEIGHTS}


def _sql_rules(texts: list[str], rules) -> str:
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains({t}, '{w}')" for w in words for t in texts) + f" THEN '{name}'"
        for name, words in rules
    )
    return f"CASE {cases} END"


def _sql_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


COMPLAINTS_SQL = """
complaints AS (
  SELECT d.doc_id AS row_id, d.source AS vehicle_key, CAST(d.doc_id AS VARCHAR) AS odi_number,
         CASE WHEN d.lang = 'en' THEN 'UNKNOWN OR OTHER' ELSE upper(d.lang) END AS component,
         d.text AS summary,
         CASE WHEN l.toxic = 1 THEN 'True' ELSE 'False' END AS crash,
         CASE WHEN l.quality = 0 THEN 'yes' ELSE 'no' END AS fire,
         CASE WHEN l.quality = 1 THEN CAST(CAST(floor(d.n_chars / 1000) AS BIGINT) AS VARCHAR) ELSE 'n/a' END AS injury
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

RECALLS_SQL = """
recalls AS (
  SELECT event_id AS row_id, 'src' || CAST(user_id % 20 AS VARCHAR) AS vehicle_key,
         'C' || CAST(event_id AS VARCHAR) AS campaign_number,
         ['UNKNOWN OR OTHER', 'FR', 'DE', 'ES', 'PARTS'][CAST(floor(value) AS BIGINT) % 5 + 1] AS component,
         'error value ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ' props ' || props AS summary
  FROM events WHERE event_type = 'error')"""

_CLASSIFY = (
    "coalesce("
    + _sql_rules(["upper(component)"], COMPONENT_RULES)
    + ", "
    + _sql_rules(["upper(component)", "upper(summary)"], SUMMARY_RULES)
    + ", 'unknown_vehicle_risk')"
)

CANDIDATES_SQL = f"""
candidates AS (
  SELECT c.*, CASE WHEN risk_scenario = 'licence_risk' THEN NULL ELSE 'verify ' || risk_scenario END AS test_objective,
         CASE WHEN risk_scenario = 'licence_risk' THEN NULL ELSE 'no ' || risk_scenario END AS expected_result
  FROM (
    SELECT 0 AS family, row_id, vehicle_key, 'recall' AS source_type, campaign_number AS source_id, component,
           {_CLASSIFY} AS risk_scenario, summary AS evidence FROM recalls
    UNION ALL
    SELECT 1, row_id, vehicle_key, 'complaint', odi_number, component, {_CLASSIFY}, summary FROM complaints) c)"""

TESTABLE_SQL = f"""
testable AS (
  SELECT *, CASE WHEN upper(trim(component)) NOT IN
      ('UNKNOWN OR OTHER', 'UNKNOWN', 'OTHER', 'NOT SURE', 'N/A', '', 'NONE') AND length(trim(component)) >= 2
      THEN upper(trim(component))
      ELSE coalesce({_sql_rules(['upper(evidence)'], REFINEMENT_RULES)}, 'UNCATEGORIZED') END AS refined_component
  FROM candidates
  WHERE NOT ({_sql_any('upper(evidence)', DENY)} AND NOT {_sql_any('upper(evidence)', ALLOW)}))"""

SEVERITY_SQL = """
severity AS (
  SELECT vehicle_key, component,
         CAST(sum(CASE WHEN lower(crash) IN ('true', '1', 'yes') THEN 1 ELSE 0 END) AS BIGINT) AS crash_count,
         CAST(sum(CASE WHEN lower(fire) IN ('true', '1', 'yes') THEN 1 ELSE 0 END) AS BIGINT) AS fire_count,
         CAST(sum(coalesce(CAST(trunc(TRY_CAST(injury AS DOUBLE)) AS BIGINT), 0)) AS BIGINT) AS injury_count
  FROM complaints GROUP BY 1, 2),
recall_sums AS (
  SELECT vehicle_key, component, count(*) AS recall_count FROM recalls GROUP BY 1, 2)"""

_WEIGHTS = "CASE risk_scenario " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items()) + " ELSE 0 END"

GROUPS_SQL = """
modal AS (
  SELECT vehicle_key, risk_scenario, refined_component, component FROM (
    SELECT *, row_number() OVER (PARTITION BY vehicle_key, risk_scenario, refined_component
                                 ORDER BY n DESC, at_family, at_row) AS rn
    FROM (SELECT vehicle_key, risk_scenario, refined_component, component, count(*) AS n,
                 min(family) AS at_family, min(CASE WHEN family = mf THEN row_id END) AS at_row
          FROM (SELECT *, min(family) OVER (PARTITION BY vehicle_key, risk_scenario, refined_component, component) AS mf
                FROM testable WHERE component IS NOT NULL)
          GROUP BY 1, 2, 3, 4)) WHERE rn = 1),
groups AS (
  SELECT vehicle_key, risk_scenario, refined_component, count(source_id) AS evidence_count,
         array_to_string(list_sort(list(DISTINCT source_type)), ',') AS source_types,
         arg_min(evidence, family * 1000000000 + row_id) AS sample_evidence,
         min(test_objective) AS test_objective, min(expected_result) AS expected_result
  FROM testable GROUP BY 1, 2, 3)"""

SCORED_SQL = f"""
joined AS (
  SELECT g.*, m.component, coalesce(s.crash_count, 0) AS crash_count, coalesce(s.fire_count, 0) AS fire_count,
         coalesce(s.injury_count, 0) AS injury_count, coalesce(r.recall_count, 0) AS recall_count,
         CAST({_WEIGHTS} AS BIGINT) AS rw,
         round_even(ln(1 + g.evidence_count) * 100, 0)::DOUBLE / 100 AS frequency_score
  FROM groups g JOIN modal m USING (vehicle_key, risk_scenario, refined_component)
  LEFT JOIN severity s ON s.vehicle_key = g.vehicle_key AND s.component = m.component
  LEFT JOIN recall_sums r ON r.vehicle_key = g.vehicle_key AND r.component = m.component),
sev AS (
  SELECT *, CAST(rw + crash_count * 2 + fire_count * 3 + injury_count * 4 + recall_count * 3 AS DOUBLE) AS severity_score
  FROM joined),
bounds AS (
  SELECT min(frequency_score) AS f0, max(frequency_score) AS f1, min(severity_score) AS s0, max(severity_score) AS s1
  FROM sev),
normed AS (
  SELECT sev.*,
    round_even(((frequency_score - f0) / (f1 - f0 + 1e-9::DOUBLE) * 10) * 100, 0)::DOUBLE / 100 AS freq_norm,
    round_even(((severity_score - s0) / (s1 - s0 + 1e-9::DOUBLE) * 10) * 100, 0)::DOUBLE / 100 AS sev_norm
  FROM sev, bounds),
scored AS (
  SELECT *, round_even((freq_norm * 0.5::DOUBLE + sev_norm * 0.5::DOUBLE) * 100, 0)::DOUBLE / 100 AS priority_score
  FROM normed),
scenarios AS (
  SELECT 'R' || lpad(CAST(row_number() OVER (ORDER BY priority_score DESC, vehicle_key, risk_scenario,
         refined_component) AS VARCHAR), 4, '0') AS scenario_id, * FROM scored)"""

RISK_CTE = "WITH " + ",".join(
    [COMPLAINTS_SQL, RECALLS_SQL, CANDIDATES_SQL, TESTABLE_SQL, SEVERITY_SQL, GROUPS_SQL, SCORED_SQL]
)
CANDIDATE_CTE = "WITH " + ",".join([COMPLAINTS_SQL, RECALLS_SQL, CANDIDATES_SQL, TESTABLE_SQL])


# ---------------------------------------------------------------- test cases
def lines(spark: SparkSession, d: str) -> DataFrame:
    """Order lines with part attributes; ``pos`` numbers the lines of an order."""
    from ..operators.scale import numbered

    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
        "l_returnflag", "l_linestatus",
    )
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return numbered(li, ["l_orderkey"], order, "pos").join(part, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")


LINES_SQL = """
lines AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice, l.l_discount,
         l.l_returnflag, l.l_linestatus, p.p_name, p.p_brand, p.p_type, p.p_size,
         row_number() OVER (PARTITION BY l.l_orderkey
           ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice) AS pos
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""


def cases(spark: SparkSession, d: str) -> DataFrame:
    """Orders as test cases: brands are preconditions, part types actions, line states expectations."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus")
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    sets = (
        li.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_orderkey")
        .agg(
            F.array_sort(F.collect_set("p_brand")).alias("preconditions"),
            F.array_sort(F.collect_set("p_type")).alias("actions"),
            F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("expected_behaviors"),
        )
    )
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    none = F.array().cast("array<string>")
    return orders.join(sets, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.concat(F.lit("O-"), F.col("o_orderkey")).alias("case_id"),
        F.concat(F.lit("order "), F.col("o_orderstatus"), F.lit(" of customer "), F.col("o_custkey")).alias("case_name"),
        F.col("o_orderpriority").alias("test_type"),
        *[F.coalesce(c, none).alias(c) for c in ("preconditions", "actions", "expected_behaviors")],
        F.lit("orders").alias("source"),
        (F.col("o_orderkey") + 1).alias("source_row"),
    )


CASES_SQL = """
cases AS (
  SELECT 'O-' || o_orderkey AS case_id, 'order ' || o_orderstatus || ' of customer ' || o_custkey AS case_name,
         o_orderpriority AS test_type, coalesce(preconditions, []) AS preconditions, coalesce(actions, []) AS actions,
         coalesce(expected_behaviors, []) AS expected_behaviors, 'orders' AS source, o_orderkey + 1 AS source_row
  FROM orders LEFT JOIN (
    SELECT l_orderkey, list_sort(list(DISTINCT p_brand)) AS preconditions, list_sort(list(DISTINCT p_type)) AS actions,
           list_sort(list(DISTINCT l_returnflag || l_linestatus)) AS expected_behaviors
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) s ON o_orderkey = l_orderkey)"""


# ---------------------------------------------------------------- triples
def raw_triples(spark: SparkSession, d: str) -> DataFrame:
    """Customer-ordered-part triples with surface variants, one per order line."""
    li = lines(spark, d).join(
        table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    flag = F.col("l_returnflag")
    return li.select(
        F.struct("l_orderkey", "pos").alias("row_id"),
        F.concat(F.lit("customer （"), F.col("o_custkey"), F.when(flag == "A", F.lit("）， ")).otherwise(F.lit(")"))).alias("head"),
        F.when(flag == "N", F.lit(" ordered。")).otherwise(F.lit("ordered")).alias("relation"),
        F.concat("p_name", F.when(flag == "R", F.lit("；")).otherwise(F.lit(""))).alias("tail"),
        F.array(F.concat(F.lit("img"), F.col("l_suppkey"))).alias("sources"),
        (F.col("l_discount") > 0.08).alias("conflict"),
        F.when(F.col("l_discount") > 0.08, F.lit("discount")).otherwise(F.lit("")).alias("conflict_note"),
        F.concat(F.lit("doc"), F.col("l_linenumber")).alias("doc_id"),
        ((F.col("l_quantity") + 10) / 60).alias("confidence"),
    )


RAW_TRIPLES_SQL = """
raw_triples AS (
  SELECT l_orderkey, pos,
    'customer （' || o_custkey || CASE WHEN l_returnflag = 'A' THEN '）， ' ELSE ')' END AS head,
    CASE WHEN l_returnflag = 'N' THEN ' ordered。' ELSE 'ordered' END AS relation,
    p_name || CASE WHEN l_returnflag = 'R' THEN '；' ELSE '' END AS tail,
    'customer (' || o_custkey || ')' AS kh, 'ordered' AS kr, p_name AS kt,
    'img' || l_suppkey AS src, l_discount > 0.08 AS conflict,
    CASE WHEN l_discount > 0.08 THEN 'discount' ELSE '' END AS conflict_note, 'doc' || l_linenumber AS doc_id,
    (l_quantity + 10) / 60 AS confidence
  FROM lines JOIN orders ON l_orderkey = o_orderkey)"""
