"""Safety-record queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import risk, rules
from . import bindings as B
from .registry import Family

FAMILY = Family()
query = FAMILY.query


def scenarios(spark, d):
    return risk.risk_scenarios(
        B.candidates(spark, d), B.complaints(spark, d), B.recalls(spark, d), **B.RISK_RULES
    )


_COLUMNS = ", ".join(risk.SCENARIO_COLUMNS)


@query("risk_scenarios", f"{B.RISK_CTE} SELECT {_COLUMNS} FROM scenarios")
def risk_scenarios(spark, d):
    return scenarios(spark, d)


@query(
    "risk_candidates",
    f"""{B.CANDIDATE_CTE} SELECT vehicle_key, source_type, source_id, component, risk_scenario,
        test_objective, expected_result, md5(evidence) AS evidence_md5 FROM candidates""",
)
def risk_candidates(spark, d):
    return B.candidates(spark, d).select(
        "vehicle_key", "source_type", "source_id", "component", "risk_scenario", "test_objective",
        "expected_result", F.md5("evidence").alias("evidence_md5"),
    )


@query(
    "classify_risk",
    f"WITH {B.COMPLAINTS_SQL} SELECT row_id, {B._CLASSIFY} AS risk_scenario FROM complaints",
)
def classify_risk(spark, d):
    return B.complaints(spark, d).select(
        "row_id",
        rules.classify_risk("component", "summary", B.COMPONENT_RULES, B.SUMMARY_RULES).alias("risk_scenario"),
    )


def _default_rules_sql() -> str:
    from ..functions import fixed_values as V

    def quoted(table):
        return [(n, [w.replace("'", "''") for w in ws]) for n, ws in table]

    classify = (
        "coalesce("
        + B._sql_rules(["upper(component)"], quoted(V.COMPONENT_RULES))
        + ", "
        + B._sql_rules(["upper(component)", "upper(summary)"], quoted(V.SUMMARY_RULES))
        + ", 'unknown_vehicle_risk')"
    )
    refine = f"""CASE WHEN component NOT IN ('UNKNOWN OR OTHER') THEN component
      ELSE coalesce({B._sql_rules(['upper(summary)'], quoted(V.REFINEMENT_RULES))}, 'UNCATEGORIZED') END"""
    deny = B._sql_any("upper(summary)", V.NON_TECHNICAL)
    allow = B._sql_any("upper(summary)", [w.replace("'", "''") for w in V.FAULT_WORDS])
    return f"""WITH {B.COMPLAINTS_SQL} SELECT row_id, {classify} AS risk_scenario, {refine} AS refined_component,
      {deny} AND NOT {allow} AS non_testable FROM complaints"""


@query("classify_risk_default_rules", _default_rules_sql())
def classify_risk_default_rules(spark, d):
    return B.complaints(spark, d).select(
        "row_id",
        rules.classify_risk("component", "summary").alias("risk_scenario"),
        rules.refine_component("component", "summary").alias("refined_component"),
        rules.is_non_testable("summary").alias("non_testable"),
    )


_RULE_ROWS = [
    (no, word, name) for no, (name, words) in enumerate(B.REFINEMENT_RULES + B.SUMMARY_RULES) for word in words
]


@query(
    "classify_by_rule_table",
    f"""SELECT doc_id, coalesce({B._sql_rules(["upper(replace(text, 'ß', 'ss'))"], B.REFINEMENT_RULES + B.SUMMARY_RULES)},
        'unknown_vehicle_risk') AS scenario FROM documents""",
)
def classify_by_rule_table(spark, d):
    table = spark.createDataFrame(_RULE_ROWS, "rule_no int, keyword string, scenario string")
    docs = B.table(spark, d, "documents").select("doc_id", "text")
    return rules.classify_by_table(docs, table, "text", "doc_id").select("doc_id", "scenario")


@query(
    "non_technical_filter",
    f"""WITH {B.COMPLAINTS_SQL} SELECT row_id FROM complaints
        WHERE NOT ({B._sql_any('upper(summary)', B.DENY)} AND NOT {B._sql_any('upper(summary)', B.ALLOW)})""",
)
def non_technical_filter(spark, d):
    return B.complaints(spark, d).where(~rules.is_non_testable("summary", B.DENY, B.ALLOW)).select("row_id")


@query("refine_component", f"{B.CANDIDATE_CTE} SELECT source_type, source_id, refined_component FROM testable")
def refine_component(spark, d):
    rows = risk.testable(B.candidates(spark, d), B.REFINEMENT_RULES, B.DENY, B.ALLOW)
    return rows.select("source_type", "source_id", "refined_component")


@query("severity_counts", f"WITH {B.COMPLAINTS_SQL}, {B.RECALLS_SQL}, {B.SEVERITY_SQL} SELECT * FROM severity")
def severity_counts(spark, d):
    return risk.severity_counts(B.complaints(spark, d))


@query("recall_counts", f"WITH {B.COMPLAINTS_SQL}, {B.RECALLS_SQL}, {B.SEVERITY_SQL} SELECT * FROM recall_sums")
def recall_counts(spark, d):
    return risk.recall_counts(B.recalls(spark, d))


@query("risk_groups", f"{B.RISK_CTE} SELECT g.*, m.component FROM groups g JOIN modal m USING (vehicle_key, risk_scenario, refined_component)")
def risk_groups(spark, d):
    return risk.risk_groups(risk.testable(B.candidates(spark, d), B.REFINEMENT_RULES, B.DENY, B.ALLOW))


@query("modal_component", f"{B.RISK_CTE} SELECT * FROM modal")
def modal_component(spark, d):
    rows = risk.testable(B.candidates(spark, d), B.REFINEMENT_RULES, B.DENY, B.ALLOW)
    return risk.modal(rows, risk.GROUP, "component", "row_id")


@query(
    "risk_scores",
    f"""{B.RISK_CTE} SELECT vehicle_key, risk_scenario, refined_component, crash_count, fire_count, injury_count,
        recall_count, rw, frequency_score, severity_score, freq_norm, sev_norm, priority_score FROM scored""",
)
def risk_scores(spark, d):
    scored = risk.scored_groups(
        B.candidates(spark, d), B.complaints(spark, d), B.recalls(spark, d), **B.RISK_RULES
    )
    return scored.select(
        *risk.GROUP, "crash_count", "fire_count", "injury_count", "recall_count", "rw", "frequency_score",
        "severity_score", "freq_norm", "sev_norm", "priority_score",
    )


@query(
    "safety_triples",
    f"""{B.RISK_CTE}, fam AS (
      SELECT vehicle_key AS head, 'HAS_RISK_SCENARIO' AS relation, risk_scenario AS tail,
             sample_evidence AS evidence, vehicle_key, scenario_id AS t, 0 AS f, 0 AS r FROM scenarios
      UNION ALL SELECT risk_scenario, 'AFFECTS_COMPONENT', refined_component, sample_evidence,
             vehicle_key, scenario_id, 0, 0 FROM scenarios
      UNION ALL SELECT risk_scenario, 'GENERATES_TEST_CASE', scenario_id, sample_evidence,
             vehicle_key, scenario_id, 0, 0 FROM scenarios
      UNION ALL SELECT vehicle_key, 'HAS_RECALL', campaign_number, summary, vehicle_key, '', 0, row_id FROM recalls
      UNION ALL SELECT vehicle_key, 'HAS_COMPLAINT', odi_number, summary, vehicle_key, '', 0, row_id FROM complaints
      UNION ALL SELECT source_id, 'INDICATES_RISK', risk_scenario, evidence, vehicle_key, '', family, row_id FROM testable)
      SELECT head, relation, tail, md5(evidence) AS evidence_md5, vehicle_key FROM (
        SELECT *, row_number() OVER (PARTITION BY head, relation, tail ORDER BY t, f, r) AS rn FROM fam) WHERE rn = 1""",
)
def safety_triples(spark, d):
    cands = B.candidates(spark, d)
    tested = risk.testable(cands, B.REFINEMENT_RULES, B.DENY, B.ALLOW)
    out = risk.safety_triples(scenarios(spark, d), B.recalls(spark, d), B.complaints(spark, d), tested)
    return out.select("head", "relation", "tail", F.md5("evidence").alias("evidence_md5"), "vehicle_key")


def _tpl(field: str) -> str:
    return (
        f"CASE WHEN risk_scenario IN ('gallic_risk', 'german_risk', 'token_risk') "
        f"THEN '{field} of ' || risk_scenario ELSE 'default {field}' END"
    )


@query(
    "risk_test_cases",
    f"""{B.RISK_CTE} SELECT 'TC0' || substr(scenario_id, 2) AS test_case_id, vehicle_key, risk_scenario, refined_component,
        {_tpl('title')} AS test_case_title, test_objective, {_tpl('environment')} AS test_environment,
        {_tpl('preconditions')} AS preconditions, {_tpl('steps')} AS test_steps, {_tpl('signals')} AS observed_signals,
        expected_result, {_tpl('criteria')} AS pass_fail_criteria, priority_score, evidence_count,
        sample_evidence AS sample_evidence FROM scenarios""",
)
def risk_test_cases(spark, d):
    return risk.risk_test_cases(scenarios(spark, d), B.case_templates(spark))


@query(
    "risk_by_scenario",
    f"{B.RISK_CTE} SELECT risk_scenario, count(*) AS scenario_count, max(priority_score) AS max_priority FROM scored GROUP BY 1",
)
def risk_by_scenario(spark, d):
    return risk.risk_by_scenario(_scored(spark, d))


def _scored(spark, d):
    return risk.scored_groups(
        B.candidates(spark, d), B.complaints(spark, d), B.recalls(spark, d), **B.RISK_RULES
    )


@query(
    "risk_by_vehicle",
    f"""{B.RISK_CTE} SELECT vehicle_key, count(*) AS scenario_count, CAST(sum(evidence_count) AS BIGINT) AS evidence_total,
        max(priority_score) AS max_priority, arg_min(risk_scenario, scenario_id) AS top_risk FROM scenarios GROUP BY 1""",
)
def risk_by_vehicle(spark, d):
    return risk.risk_by_vehicle(_scored(spark, d))


@query(
    "risk_value_counts",
    f"""{B.RISK_CTE}, c AS (SELECT risk_scenario, count(*) AS row_count FROM scored GROUP BY 1
        ORDER BY row_count DESC, risk_scenario LIMIT 12)
        SELECT risk_scenario, row_count, round(row_count / (SELECT sum(row_count) FROM c), 4) AS share FROM c""",
)
def risk_value_counts(spark, d):
    out = risk.value_counts(_scored(spark, d), "risk_scenario", 12)
    return out.withColumn("share", F.round("share", 4))


@query(
    "top_risks",
    f"""{B.RISK_CTE} SELECT vehicle_key, risk_scenario, refined_component, priority_score,
        CASE WHEN priority_score >= 5 THEN 'critical' WHEN priority_score >= 3 THEN 'high'
             WHEN priority_score >= 1.5 THEN 'medium' ELSE 'low' END AS severity_class
        FROM scored ORDER BY priority_score DESC, vehicle_key, risk_scenario, refined_component LIMIT 10""",
)
def top_risks(spark, d):
    return risk.top_risks(_scored(spark, d), 10).select(*risk.GROUP, "priority_score", "severity_class")


@query(
    "risks_for_component",
    f"""{B.RISK_CTE} SELECT vehicle_key, count(*) AS scenario_count, CAST(sum(evidence_count) AS BIGINT) AS evidence_total,
        max(priority_score) AS max_priority FROM scored WHERE contains(upper(refined_component), 'WORDS') GROUP BY 1""",
)
def risks_for_component(spark, d):
    return risk.risks_for(_scored(spark, d), component="words")
