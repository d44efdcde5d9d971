"""Safety records to risk scenarios, triples, test cases and report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import to_count, to_flag
from ..session import materialise
from .rules import Rules, classify_risk, is_non_testable, refine_component
from .scale import first_per_key, global_rank

GROUP = ["vehicle_key", "risk_scenario", "refined_component"]


def round2(c: Column) -> Column:
    """Half-to-even on the scaled value, as array libraries round."""
    return F.rint(c * 100) / 100


def severity_counts(complaints: DataFrame) -> DataFrame:
    """Crash, fire and injury totals per vehicle and component."""
    return (
        complaints.where(F.col("vehicle_key").isNotNull() & F.col("component").isNotNull())
        .groupBy("vehicle_key", "component")
        .agg(
            F.sum(to_flag("crash").cast("long")).alias("crash_count"),
            F.sum(to_flag("fire").cast("long")).alias("fire_count"),
            F.sum(to_count("injury")).alias("injury_count"),
        )
    )


def recall_counts(recalls: DataFrame) -> DataFrame:
    return (
        recalls.where(F.col("vehicle_key").isNotNull() & F.col("component").isNotNull())
        .groupBy("vehicle_key", "component")
        .agg(F.count(F.lit(1)).alias("recall_count"))
    )


def candidates(
    recalls: DataFrame,
    complaints: DataFrame,
    templates: DataFrame,
    component_rules: Rules = V.COMPONENT_RULES,
    summary_rules: Rules = V.SUMMARY_RULES,
) -> DataFrame:
    """Classified recalls and complaints with objective and expected result from ``templates``.

    ``templates`` has one row per risk scenario: risk_scenario, test_objective, expected_result.
    """
    kinds = [(recalls, "recall", "campaign_number", 0), (complaints, "complaint", "odi_number", 1)]
    parts = [
        df.select(
            "vehicle_key",
            F.lit(kind).alias("source_type"),
            F.col(key).cast("string").alias("source_id"),
            "component",
            classify_risk("component", "summary", component_rules, summary_rules).alias("risk_scenario"),
            F.col("summary").alias("evidence"),
            F.struct(F.lit(order).alias("family"), F.col("row_id")).alias("row_id"),
        )
        for df, kind, key, order in kinds
    ]
    return parts[0].unionByName(parts[1]).join(templates, "risk_scenario", "left")


def testable(cands: DataFrame, rules: Rules = V.REFINEMENT_RULES, deny=V.NON_TECHNICAL, allow=V.FAULT_WORDS) -> DataFrame:
    """Technical candidates with a refined component."""
    return cands.where(~is_non_testable("evidence", deny, allow)).withColumn(
        "refined_component", refine_component("component", "evidence", rules)
    )


def modal(df: DataFrame, keys: Sequence[str], col: str, order: str) -> DataFrame:
    """Most frequent non-null value per key; the one seen first wins a tie."""
    counts = (
        df.where(F.col(col).isNotNull())
        .groupBy(*keys, col)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    )
    best = F.min_by(col, F.struct((-F.col("_n")).alias("n"), F.col("_first").alias("at")))
    return counts.groupBy(*keys).agg(best.alias(col))


def risk_groups(rows: DataFrame) -> DataFrame:
    """Evidence per (vehicle, scenario, refined component) with the modal original component."""
    per_component = rows.groupBy(*GROUP, "component").agg(
        F.count("source_id").alias("_ids"),
        F.count(F.lit(1)).alias("_rows"),
        F.min("row_id").alias("_first"),
        F.collect_set("source_type").alias("_types"),
        F.min_by(
            F.struct(F.coalesce("evidence", F.lit("nan")).alias("text")), "row_id"
        ).alias("_evidence"),
        F.min_by("test_objective", F.when(F.col("test_objective").isNotNull(), F.col("row_id"))).alias("_objective"),
        F.min_by("expected_result", F.when(F.col("expected_result").isNotNull(), F.col("row_id"))).alias("_expected"),
    )
    by_frequency = F.when(
        F.col("component").isNotNull(), F.struct((-F.col("_rows")).alias("n"), F.col("_first").alias("at"))
    )
    return per_component.groupBy(*GROUP).agg(
        F.sum("_ids").alias("evidence_count"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.flatten(F.collect_set("_types"))))).alias("source_types"),
        F.min_by("_evidence", "_first")["text"].alias("sample_evidence"),
        F.min_by("_objective", F.when(F.col("_objective").isNotNull(), F.col("_first"))).alias("test_objective"),
        F.min_by("_expected", F.when(F.col("_expected").isNotNull(), F.col("_first"))).alias("expected_result"),
        F.min_by("component", by_frequency).alias("component"),
    )


def with_severity(groups: DataFrame, complaints: DataFrame, recalls: DataFrame) -> DataFrame:
    """Add counts of the modal component; combinations without records get zero."""
    counts = ["crash_count", "fire_count", "injury_count", "recall_count"]
    return (
        groups.join(severity_counts(complaints), ["vehicle_key", "component"], "left")
        .join(recall_counts(recalls), ["vehicle_key", "component"], "left")
        .withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts})
    )


def weight_of(scenario: Column | str, weights: dict[str, int] = V.RISK_WEIGHTS) -> Column:
    """Risk weight by dictionary lookup, 0 for an unlisted scenario."""
    pairs = [F.lit(x) for item in weights.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(scenario) if isinstance(scenario, str) else scenario), F.lit(0)).cast("long")


def score_risks(groups: DataFrame, weights: dict[str, int] = V.RISK_WEIGHTS) -> DataFrame:
    """Frequency, severity, min-max normalised scores and priority."""
    # bounds, ranking and numbering all read it: the text rules run once
    raw = materialise(
        groups.withColumn("rw", weight_of("risk_scenario", weights))
        .withColumn("frequency_score", round2(F.log1p(F.col("evidence_count").cast("double"))))
        .withColumn(
            "severity_score",
            (
                F.col("rw")
                + F.col("crash_count") * 2
                + F.col("fire_count") * 3
                + F.col("injury_count") * 4
                + F.col("recall_count") * 3
            ).cast("double"),
        )
    )
    # one aggregated row, read as a scalar
    bounds = raw.agg(
        F.struct(
            F.min("frequency_score").alias("f_min"),
            F.max("frequency_score").alias("f_max"),
            F.min("severity_score").alias("s_min"),
            F.max("severity_score").alias("s_max"),
        ).alias("b")
    ).scalar()

    def norm(value: str, lo: str, hi: str) -> Column:
        return round2((F.col(value) - bounds[lo]) / (bounds[hi] - bounds[lo] + 1e-9) * 10)

    return (
        raw.withColumn("freq_norm", norm("frequency_score", "f_min", "f_max"))
        .withColumn("sev_norm", norm("severity_score", "s_min", "s_max"))
        .withColumn("priority_score", round2(F.col("freq_norm") * 0.5 + F.col("sev_norm") * 0.5))
    )


RANK_ORDER = ["vehicle_key", "risk_scenario", "refined_component"]


def with_rank_id(df: DataFrame, fmt: str, order: Sequence[Column], name: str) -> DataFrame:
    """Ids such as R0001 by total order."""
    ranked = global_rank(df, order, "_rank")
    return ranked.withColumn(name, F.format_string(fmt, F.col("_rank"))).drop("_rank")


SCENARIO_COLUMNS = [
    "scenario_id", "vehicle_key", "risk_scenario", "component", "refined_component", "evidence_count",
    "source_types", "crash_count", "fire_count", "injury_count", "recall_count", "rw", "frequency_score",
    "severity_score", "freq_norm", "sev_norm", "priority_score", "sample_evidence", "test_objective",
    "expected_result",
]


def scored_groups(
    cands: DataFrame,
    complaints: DataFrame,
    recalls: DataFrame,
    rules: Rules = V.REFINEMENT_RULES,
    deny: Sequence[str] = V.NON_TECHNICAL,
    allow: Sequence[str] = V.FAULT_WORDS,
    weights: dict[str, int] = V.RISK_WEIGHTS,
) -> DataFrame:
    """Scored risk groups before they get their rank ids."""
    groups = risk_groups(testable(cands, rules, deny, allow)).where(F.col("component").isNotNull())
    return score_risks(with_severity(groups, complaints, recalls), weights)


def risk_scenarios(cands: DataFrame, complaints: DataFrame, recalls: DataFrame, **rules) -> DataFrame:
    """End-to-end risk scenario table, most urgent first in the id order."""
    scored = scored_groups(cands, complaints, recalls, **rules)
    order = [F.desc("priority_score"), *[F.asc(c) for c in RANK_ORDER]]
    return with_rank_id(scored, "R%04d", order, "scenario_id").select(*SCENARIO_COLUMNS)


def safety_triples(rs: DataFrame, recalls: DataFrame, complaints: DataFrame, tested: DataFrame) -> DataFrame:
    """Six triple families, distinct on (head, relation, tail) keeping the first."""

    def family(df: DataFrame, no: int, head, relation: str, tail, evidence, order) -> DataFrame:
        return df.select(
            F.col(head).cast("string").alias("head"),
            F.lit(relation).alias("relation"),
            F.col(tail).cast("string").alias("tail"),
            F.coalesce(F.col(evidence), F.lit("nan")).alias("evidence"),
            "vehicle_key",
            F.lit(no).alias("_family"),
            F.col(order).cast("string").alias("_text_order") if order == "scenario_id" else F.lit("").alias("_text_order"),
            F.lit(None).cast("struct<family:int,row_id:bigint>").alias("_row")
            if order == "scenario_id"
            else (
                F.col(order).cast("struct<family:int,row_id:bigint>")
                if order == "_row_struct"
                else F.struct(F.lit(0).alias("family"), F.col(order).alias("row_id"))
            ).alias("_row"),
        )

    parts = [
        family(rs, 0, "vehicle_key", "HAS_RISK_SCENARIO", "risk_scenario", "sample_evidence", "scenario_id"),
        family(rs, 0, "risk_scenario", "AFFECTS_COMPONENT", "refined_component", "sample_evidence", "scenario_id"),
        family(rs, 0, "risk_scenario", "GENERATES_TEST_CASE", "scenario_id", "sample_evidence", "scenario_id"),
        family(recalls, 1, "vehicle_key", "HAS_RECALL", "campaign_number", "summary", "row_id"),
        family(complaints, 2, "vehicle_key", "HAS_COMPLAINT", "odi_number", "summary", "row_id"),
        family(
            tested.withColumnRenamed("row_id", "_row_struct"),
            3, "source_id", "INDICATES_RISK", "risk_scenario", "evidence", "_row_struct",
        ),
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return first_per_key(union, ["head", "relation", "tail"], ["_family", "_text_order", "_row"]).select(
        "head", "relation", "tail", "evidence", "vehicle_key"
    )


def risk_test_cases(rs: DataFrame, templates: DataFrame) -> DataFrame:
    """Test-case table: one row per scenario, texts from ``templates`` by scenario.

    ``templates`` columns: risk_scenario, title, environment, preconditions,
    steps, signals, criteria; the row with a NULL scenario is the default.
    """
    texts = ["title", "environment", "preconditions", "steps", "signals", "criteria"]
    default = templates.where(F.col("risk_scenario").isNull()).select(F.struct(*texts).alias("t")).limit(1).scalar()
    listed = templates.where(F.col("risk_scenario").isNotNull()).select("risk_scenario", F.struct(*texts).alias("_t"))
    chosen = rs.join(listed, "risk_scenario", "left").withColumn("_t", F.coalesce("_t", default))
    return chosen.select(
        F.format_string("TC%05d", F.substring("scenario_id", 2, 18).cast("long")).alias("test_case_id"),
        "vehicle_key",
        "risk_scenario",
        "refined_component",
        F.col("_t.title").alias("test_case_title"),
        "test_objective",
        F.col("_t.environment").alias("test_environment"),
        F.col("_t.preconditions").alias("preconditions"),
        F.col("_t.steps").alias("test_steps"),
        F.col("_t.signals").alias("observed_signals"),
        "expected_result",
        F.col("_t.criteria").alias("pass_fail_criteria"),
        "priority_score",
        "evidence_count",
        "sample_evidence",
    )


# ---------------------------------------------------------------- report tables
def risk_by_scenario(rs: DataFrame) -> DataFrame:
    return rs.groupBy("risk_scenario").agg(
        F.count(F.lit(1)).alias("scenario_count"), F.max("priority_score").alias("max_priority")
    )


def risk_by_vehicle(rs: DataFrame) -> DataFrame:
    return rs.groupBy("vehicle_key").agg(
        F.count(F.lit(1)).alias("scenario_count"),
        F.sum("evidence_count").alias("evidence_total"),
        F.max("priority_score").alias("max_priority"),
        F.min_by("risk_scenario", F.struct((-F.col("priority_score")).alias("p"), *RANK_ORDER)).alias("top_risk"),
    )


def value_counts(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    """Counts of a column, most frequent first, with the share of the rows listed."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("row_count"))
    if n is not None:
        counts = counts.orderBy(F.desc("row_count"), col).limit(n)
    total = counts.agg(F.sum("row_count")).scalar()
    return counts.withColumn("share", F.col("row_count") / total)


def severity_class(score: Column | str) -> Column:
    c = F.col(score) if isinstance(score, str) else score
    out = F.lit("low")
    for bound, name in reversed(V.SEVERITY_BANDS):
        out = F.when(c >= bound, F.lit(name)).otherwise(out)
    return out


def top_risks(rs: DataFrame, n: int = 10) -> DataFrame:
    """The n most urgent scenarios with their severity class."""
    best = rs.orderBy(F.desc("priority_score"), *RANK_ORDER).limit(n)
    return best.withColumn("severity_class", severity_class("priority_score"))


def risks_for(rs: DataFrame, vehicle: str | None = None, component: str | None = None) -> DataFrame:
    """Scenario count and evidence per vehicle, for one vehicle and/or component substring."""
    out = rs
    if vehicle is not None:
        out = out.where(F.col("vehicle_key") == vehicle)
    if component is not None:
        out = out.where(F.upper("refined_component").contains(component.upper()))
    return out.groupBy("vehicle_key").agg(
        F.count(F.lit(1)).alias("scenario_count"),
        F.sum("evidence_count").alias("evidence_total"),
        F.max("priority_score").alias("max_priority"),
    )
