"""Case analytics: grouping, sampling, derived cases, evaluation, rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed_values as V
from ..functions import text as T
from .rules import any_contains
from .scale import first_per_key, numbered, top_k_per_key


def _label(c: str) -> Column:
    text = T.strip(F.coalesce(F.col(c), F.lit("")))
    return F.when(text == "", F.lit(V.UNCLASSIFIED)).otherwise(text)


# ---------------------------------------------------------------- grouping
def by_action(cases: DataFrame, action: str = "action_text", expected: str = "expected_text") -> DataFrame:
    """Cases and single-expectation cases per action."""
    return cases.groupBy(_label(action).alias("action")).agg(
        F.count(F.lit(1)).alias("case_count"), F.sum(T.is_single_expected(expected).cast("long")).alias("single_count")
    )


def by_type_action(cases: DataFrame, action: str = "action_text") -> DataFrame:
    """Cases per (type, action) with the total of the type."""
    groups = cases.groupBy(_label("test_type").alias("test_type"), _label(action).alias("action")).agg(
        F.count(F.lit(1)).alias("case_count")
    )
    totals = groups.groupBy("test_type").agg(F.sum("case_count").alias("total_count"))
    return groups.join(totals, "test_type")


def by_type_expected(cases: DataFrame, expected: str = "expected_text") -> DataFrame:
    """Cases per (type, expectation), texts as they are."""
    return cases.groupBy(
        F.coalesce("test_type", F.lit(V.UNCLASSIFIED)).alias("test_type"),
        F.coalesce(expected, F.lit("Unknown expected behavior")).alias("expected"),
    ).agg(F.count(F.lit(1)).alias("case_count"), F.max(T.is_single_expected(expected)).alias("single"))


def group_statistics(groups: DataFrame, per: str) -> DataFrame:
    """Totals of a two-level grouping; ``per`` names what is averaged per type: cases or groups."""
    stats = groups.groupBy("test_type").agg(F.sum("case_count").alias("c"), F.count(F.lit(1)).alias("g")).agg(
        F.sum("c").alias("total_cases"), F.count(F.lit(1)).alias("total_types"), F.sum("g").alias("total_groups")
    )
    top = F.col("total_cases") if per == "cases" else F.col("total_groups")
    return stats.withColumn("average_per_type", F.round(top / F.col("total_types"), 1))


def type_facets(cases: DataFrame) -> DataFrame:
    """Types with case counts in the order of their smallest id, plus totals."""
    key = T.case_id_key("case_id")
    facets = cases.groupBy(_label("test_type").alias("test_type")).agg(
        F.count(F.lit(1)).alias("case_count"), F.min(key).alias("_first")
    )
    totals = facets.agg(F.struct(F.sum("case_count").alias("n"), F.count(F.lit(1)).alias("t")).alias("s")).scalar()
    return facets.select(
        "test_type", "case_count", F.col("_first")["text"].alias("first_case_id"), totals["n"].alias("matched"),
        F.round(totals["n"] / totals["t"], 1).alias("average_per_type"),
    )


def order_by_case_id(cases: DataFrame) -> DataFrame:
    """Rows grouped by type, types by their smallest id, rows by natural id."""
    key = T.case_id_key("case_id")
    firsts = cases.groupBy("test_type").agg(F.min(key).alias("_first"))
    return (
        cases.join(firsts, "test_type")
        .orderBy("_first", key)
        .drop("_first")
    )


def task_stats(results: DataFrame) -> DataFrame:
    """Successes, failures and success rate per task (task_id, ok)."""
    out = results.groupBy("task_id").agg(
        F.sum(F.col("ok").cast("long")).alias("succeeded"),
        F.sum((~F.col("ok")).cast("long")).alias("failed"),
        F.count(F.lit(1)).alias("total"),
    )
    rate = F.round(F.col("succeeded") / F.col("total") * 100, 1)
    return out.withColumn("success_rate", F.when(F.col("total") > 0, F.concat(rate.cast("string"), F.lit("%"))).otherwise("0%"))


def source_summary(cases: DataFrame) -> DataFrame:
    """Case, type and triple counts per source."""
    named = F.when(F.coalesce("test_type", F.lit("")) != "", F.col("test_type"))
    per_type = cases.groupBy("source", named.alias("_type")).agg(F.count(F.lit(1)).alias("_n"))
    return per_type.groupBy("source").agg(
        F.sum("_n").alias("case_count"), F.count("_type").alias("type_count"), (F.sum("_n") * 3).alias("triple_count")
    )


# ---------------------------------------------------------------- sampling
def round_robin(
    df: DataFrame, by: str, n: int | None, within: Sequence[Column], strata: str = "largest", id_col: str = "case_id"
) -> DataFrame:
    """Take rows in turn from each stratum, ``n`` in all; ``turn`` and ``stratum_rank`` give the order.

    Strata come largest first (then by name) or, ``strata="first_id"``, by their
    smallest natural id.  Only the first n rows of a stratum can be taken, so the
    ranking keeps no more than that of any stratum.
    """
    label = F.when(F.coalesce(by, F.lit("")) == "", F.lit(V.UNCLASSIFIED)).otherwise(F.col(by))
    labelled = df.withColumn("_stratum", label)
    sizes = labelled.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_n"), F.min(T.case_id_key(id_col)).alias("_id"))
    order = [F.desc("_n"), F.asc("_stratum")] if strata == "largest" else [F.asc("_id"), F.asc("_stratum")]
    # one row per stratum
    ranked = sizes.withColumn("stratum_rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).cast("long"))
    # without a limit a whole stratum is numbered, in blocks
    turns = numbered(labelled, ["_stratum"], list(within), "turn") if n is None else top_k_per_key(labelled, ["_stratum"], list(within), n, "turn")
    out = turns.join(ranked.select("_stratum", "stratum_rank"), "_stratum").drop("_stratum").orderBy("turn", "stratum_rank")
    return out.limit(n) if n is not None else out


def graph_projection(cases: DataFrame, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges type → case → detail of a round-robin sample with a detail budget.

    At most four details per case and ``round(3.85 × cases)`` in all, cases in
    sample order.  The sample has `limit` cases, so the budget is a small window.
    """
    sample = round_robin(cases, "test_type", limit, [F.asc("source_row")])
    kind = F.when(F.coalesce("test_type", F.lit("")) == "", F.lit(V.UNCLASSIFIED)).otherwise(F.col("test_type"))
    named = sample.select(
        "turn", "stratum_rank", "case_id", kind.alias("type"), F.coalesce("case_name", "case_id").alias("label"),
        *["preconditions", "actions", "expected_behaviors"],
    )

    def slots(c: str, name: str, relation: str) -> Column:
        return F.transform(
            F.col(c),
            lambda x, i: F.struct(
                F.lit(name).alias("kind"), F.concat_ws(":", F.lit(name), "case_id", i.cast("string")).alias("id"),
                x.alias("label"), F.lit(relation).alias("relation"),
            ),
        )

    details = F.slice(
        F.concat(
            slots("preconditions", "condition", "前提条件"), slots("actions", "action", "执行动作"),
            slots("expected_behaviors", "expectation", "预期行为"),
        ), 1, 4,
    )
    total = sample.agg(F.count(F.lit(1))).scalar()
    rows = named.withColumn("_details", details)
    before = Window.partitionBy(F.lit(1)).orderBy("turn", "stratum_rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_used", F.coalesce(F.sum(F.size("_details")).over(before), F.lit(0)))
    room = F.greatest(F.lit(0), F.rint(total * 3.85).cast("int") - F.col("_used").cast("int"))
    rows = rows.withColumn("_details", F.slice("_details", F.lit(1), room))
    case_node = F.concat(F.lit("case:"), F.col("case_id"))
    type_node = F.concat(F.lit("type:"), F.col("type"))
    detail = rows.select(case_node.alias("case"), F.explode("_details").alias("d"))
    edges = rows.select(type_node.alias("source"), case_node.alias("target"), F.lit("包含用例").alias("relation")).unionByName(
        detail.select(F.col("case").alias("source"), F.col("d.id").alias("target"), F.col("d.relation").alias("relation"))
    )
    seen = (
        rows.select(type_node.alias("id"), F.col("type").alias("label"), F.lit("type").alias("kind"))
        .unionByName(rows.select(case_node.alias("id"), "label", F.lit("case").alias("kind")))
        .unionByName(detail.select("d.id", "d.label", "d.kind"))
    )
    return node_degree(seen), edges


def node_degree(nodes: DataFrame) -> DataFrame:
    """Nodes once, with how often each was added."""
    return nodes.groupBy("id").agg(
        F.min("label").alias("label"), F.min("kind").alias("kind"), F.count(F.lit(1)).alias("degree")
    )


# ---------------------------------------------------------------- filters
def complete_cases(cases: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Cases with actions and expectations, items and cases once."""
    lists = ["preconditions", "actions", "expected_behaviors"]
    clean = cases.withColumns({c: F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))) for c in lists}).withColumn(
        "case_name", T.strip(F.coalesce("case_name", F.lit("")))
    )
    full = clean.where((F.size("actions") > 0) & (F.size("expected_behaviors") > 0))
    keyed = full.withColumns(
        {"_name": F.lower("case_name"), **{f"_{c}": F.array_sort(c) for c in lists}}
    )
    return first_per_key(keyed, [*keep, "_name", *[f"_{c}" for c in lists]], ["source_row"]).select(*cases.columns)


def has_complete_pae() -> Column:
    return (F.size("preconditions") > 0) & (F.size("actions") > 0) & (F.size("expected_behaviors") > 0)


def positive_single(cases: DataFrame, expected: str = "expected_text") -> DataFrame:
    """Single, non-negative expectations."""
    text = T.strip(F.coalesce(expected, F.lit("")))
    return cases.where(T.is_single_expected(expected) & ~any_contains([text], V.NEGATIVE_WORDS))


def facet_cases(cases: DataFrame, mode: str = "all", query: str = "", expected: str = "expected_text") -> DataFrame:
    """Cases with single, multiple or all expectations, whose name contains the query."""
    single = T.is_single_expected(expected)
    out = cases if mode == "all" else cases.where(single if mode == "single" else ~single)
    return out.where(F.lower("case_name").contains(query.lower())) if query else out


def batch_groups(cases: DataFrame, action: str = "action_text", expected: str = "expected_text") -> DataFrame:
    """Single and multiple expectation counts of each action."""
    single = T.is_single_expected(expected)
    return cases.groupBy(F.coalesce(action, F.lit(V.UNCLASSIFIED)).alias("action")).agg(
        F.sum(single.cast("long")).alias("single_count"), F.sum((~single).cast("long")).alias("multiple_count")
    )


# ---------------------------------------------------------------- derived cases
#: Items whose subsets are opened in one step: no array exceeds 2^12.
STEP = 12


def _numbered_text(items: Column) -> Column:
    lines = F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return F.when(F.size(items) == 1, F.get(items, 0)).otherwise(F.array_join(lines, "\n"))


def _subsets(sized: DataFrame, size: int | None) -> DataFrame:
    """Proper non-empty subsets of the places 0 to n - 1 in ``_at``, or those of one size, ``STEP`` places at a time.

    With a size, a step opens only what the places behind it can still complete, so no row is made in vain and n has no limit.
    """
    if size is not None:
        sized = sized.where(F.col("n") > size)
    most = sized.agg(F.max("n")).first()[0] or 0
    rows = sized.withColumn("_at", F.array().cast("array<int>"))
    for first in range(0, most, STEP):
        width = f"greatest(least(n - {first}, {STEP}), 0)"
        masks = F.expr(f"sequence(0, shiftleft(1, {width}) - 1)")
        if size is not None:
            left, later = F.lit(size) - F.size("_at"), F.greatest(F.col("n") - (first + STEP), F.lit(0))
            masks = F.filter(masks, lambda m: (F.bit_count(m) <= left) & (F.bit_count(m) >= left - later))
        here = F.expr(f"filter(sequence({first}, {first + STEP - 1}), i -> (shiftright(_mask, i - {first}) & 1) = 1)")
        rows = rows.withColumn("_mask", F.explode(masks)).withColumn("_at", F.concat("_at", here)).drop("_mask")
    return rows.where((F.size("_at") > 0) & (F.size("_at") < F.col("n")))


def combination_cases(
    cases: DataFrame, action: str = "action_text", expected: str = "expected_text", prefixes_only: bool = False, size: int | None = None
) -> DataFrame:
    """Derived cases of the proper non-empty subsets (those of ``size`` items, or the prefixes) of a case's numbered items."""
    action_items = T.numbered_segments(action)
    parsed = cases.select(
        "case_id", "case_name", "test_type", "preconditions",
        F.when(F.size(action_items) > 0, action_items).otherwise(F.array(action)).alias("_a"),
        T.numbered_segments(expected).alias("_e"),
    ).where(F.size("_e") > 1)
    sized = parsed.withColumn("n", F.least(F.size("_a"), F.size("_e"))).where(F.col("n") > 1)
    if prefixes_only:
        chosen = sized.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("n") - 1))).withColumn("_at", F.expr("sequence(0, _k - 1)")).drop("_k")
    else:
        chosen = _subsets(sized, size)
    chosen = chosen.withColumns(
        {
            "_actions": F.transform("_at", lambda i: F.get("_a", i)),
            "_expected": F.transform("_at", lambda i: F.get("_e", i)),
        }
    )
    pairs = F.arrays_zip(F.slice("_a", F.lit(1), F.col("n")), F.slice("_e", F.lit(1), F.col("n")))
    distinct = F.size(F.array_distinct(pairs)) == F.col("n")
    plain = chosen.where(distinct)
    # items that repeat within a case give equal subsets; the first by size, then by positions, stays
    repeated = first_per_key(
        chosen.where(~distinct).withColumn("_size", F.size("_at")), ["case_id", "_actions", "_expected"], ["_size", "_at"]
    ).drop("_size")
    rows = plain.unionByName(repeated)
    indices = F.array_join(F.transform("_at", lambda i: (i + 1).cast("string")), "+")
    k = F.size("_at").cast("string")
    return rows.select(
        "case_id",
        F.concat("case_name", F.lit("-combo"), k, F.lit("items(items "), indices, F.lit(")")).alias("combo_name"),
        "test_type", "preconditions",
        _numbered_text(F.col("_actions")).alias("action_text"),
        _numbered_text(F.col("_expected")).alias("expected_text"),
        F.concat(F.lit("combination("), k, F.lit("/"), F.col("n").cast("string"), F.lit(")")).alias("method"),
    )


def shared_items(df: DataFrame, by: Sequence[str], row: str, items: str) -> DataFrame:
    """Items that every row of a group has."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    counts = (
        df.select(*by, row, F.explode(F.array_distinct(items)).alias("item"))
        .groupBy(*by, "item")
        .agg(F.count(F.lit(1)).alias("_with"))
    )
    return counts.join(sizes, list(by)).where(F.col("_with") == F.col("_rows")).select(*by, "item")


def reverse_plan(
    cases: DataFrame, negations: DataFrame | None = None, action: str = "action_text", expected: str = "expected_text"
) -> DataFrame:
    """One reverse case per key precondition of each (expectation, action) group.

    Key preconditions are those all cases of the group share (all of them for a
    single case).  negations: text, negated; a text without entry becomes NOT(text).
    """
    by = [expected, action]
    picked = positive_single(cases, expected).select(
        F.coalesce(expected, F.lit("")).alias(expected), F.coalesce(action, F.lit("")).alias(action),
        "case_id", "case_name", "test_type", "preconditions", "source_row",
    )
    sizes = picked.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    leader = first_per_key(picked, by, ["source_row"])
    many = shared_items(picked, by, "case_id", "preconditions").join(sizes.where(F.col("_rows") > 1), by, "left_semi")
    keys = many.join(leader, by).unionByName(
        leader.join(sizes.where(F.col("_rows") == 1), by, "left_semi").withColumn("item", F.explode("preconditions"))
    )

    def negated(df: DataFrame, col: str, out: str) -> DataFrame:
        default = F.concat(F.lit("NOT("), F.col(col), F.lit(")"))
        if negations is None:
            return df.withColumn(out, default)
        table = negations.select(F.col("text").alias("_t"), F.col("negated").alias("_n"))
        joined = df.join(table, F.col(col) == F.col("_t"), "left")
        return joined.withColumn(out, F.coalesce("_n", default)).drop("_t", "_n")

    rows = negated(negated(keys, "item", "reversed_precondition"), expected, "reversed_expected")
    return rows.select(
        F.concat(F.lit("Reverse-"), F.coalesce("case_name", F.lit(""))).alias("case_name"),
        "test_type",
        F.expr("transform(preconditions, p -> if(p = item, reversed_precondition, p))").alias("preconditions"),
        F.col(action).alias("action_text"),
        F.col("reversed_expected").alias("expected_text"),
        F.col("item").alias("original_precondition"),
        "reversed_precondition",
    )


def export_cases(generated: DataFrame, originals: DataFrame) -> DataFrame:
    """Generated cases as an export sheet: numbered preconditions and the names of their sources.

    generated: case_name, preconditions, action_text, expected_text, related_ids,
    original_precondition, reversed_precondition, method, export_id.
    """
    names = first_per_key(originals.select("case_id", "case_name", "source_row"), ["case_id"], ["source_row"], latest=True)
    related = (
        generated.select("export_id", F.posexplode("related_ids").alias("_at", "_rid"))
        .join(names.select(F.col("case_id").alias("_rid"), F.col("case_name").alias("_name")), "_rid", "left")
        .groupBy("export_id")
        .agg(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_name", "_rid").alias("name")))).alias("_names"))
    )
    basis = F.array_join(F.transform("_names", lambda x: x["name"]), "、")
    pair = F.concat(F.lit("Original: "), F.col("original_precondition"), F.lit("\nNegated: "), F.col("reversed_precondition"))
    return generated.join(related, "export_id", "left").select(
        "export_id", "case_name",
        F.array_join(F.transform("preconditions", lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), p)), "\n").alias("preconditions"),
        "action_text", "expected_text",
        F.coalesce(basis, pair, F.col("method"), F.lit("")).alias("basis"),
    )


# ---------------------------------------------------------------- evaluation
def evaluate_case(c: Column | str) -> Column:
    """Score and issues of a case text by its sections and their form."""
    text = F.col(c) if isinstance(c, str) else c
    checks: list[tuple[Column, str, int]] = [
        (~text.contains(section), V.CASE_ISSUES["missing"] + section, 20) for section in V.CASE_SECTIONS
    ]
    body_pattern = r"(?sU)前提条件\s*[:：]\s*(.+?)(\n\s*执行动作\s*[:：]|\n\s*预期行为\s*[:：]|\z)"
    body = T.strip(F.regexp_extract(text, body_pattern, 1))
    found = text.rlike(body_pattern)
    checks += [
        (found & ~body.rlike(r"(?U)(^|\n)\s*\d+\s*[.|、]\s*\S+"), V.CASE_ISSUES["unnumbered"], 10),
        (~found & text.contains("前提条件"), V.CASE_ISSUES["unparsed"], 10),
        (~text.rlike(r"(?U)执行动作\s*[:：]\s*\S+") & text.contains("执行动作"), V.CASE_ISSUES["actions"], 10),
        (~text.rlike(r"(?U)预期行为\s*[:：]\s*\S+") & text.contains("预期行为"), V.CASE_ISSUES["expected"], 10),
        (F.char_length(text) < 120, V.CASE_ISSUES["short"], 10),
    ]
    return _scored(checks)


def evaluate_fields(c: Column | str) -> Column:
    """Score and issues of a case text by its four fields under any of their names."""
    text = F.col(c) if isinstance(c, str) else c
    checks = [
        (~any_contains([text], names), V.CASE_ISSUES["missing"] + field, 20) for field, names in V.CASE_SECTION_ALIASES.items()
    ]
    checks.append((F.char_length(text) < 120, V.CASE_ISSUES["short_fields"], 10))
    return _scored(checks)


def _scored(checks: Sequence[tuple[Column, str, int]]) -> Column:
    lost = sum((F.when(cond, F.lit(points)).otherwise(F.lit(0)) for cond, _, points in checks), F.lit(0))
    issues = F.array_compact(F.array(*[F.when(cond, F.lit(issue)) for cond, issue, _ in checks]))
    return F.struct(F.greatest(F.lit(0), F.lit(100) - lost).cast("long").alias("score"), issues.alias("issues"))


def best_round(rounds: DataFrame, threshold: int, keep: Sequence[str] = ("text",)) -> DataFrame:
    """Best scored round per case; improvement stops at the first round that reaches the threshold."""
    row = F.struct("round", "score", *keep)
    out = rounds.groupBy("case_id").agg(
        F.min_by(row, F.when(F.col("score") >= threshold, F.col("round"))).alias("_hit"),
        F.min_by(row, F.struct((-F.col("score")).alias("s"), F.col("round"))).alias("_best"),
    )
    picked = F.coalesce("_hit", "_best")
    return out.select("case_id", F.col("_hit").isNotNull().alias("reached"), picked.alias("_p")).select("case_id", "reached", "_p.*")


# ---------------------------------------------------------------- triage, answers, rendering
def _leading(c: Column | str, n: int | None) -> Column:
    """The first n items of a list, all of them if n is None."""
    column = F.col(c) if isinstance(c, str) else c
    return column if n is None else F.slice(column, 1, n)


def fault_triage(evidence: DataFrame, causes: int | None = None, items: int | None = None) -> DataFrame:
    """Ranked causes from the retrieved cases of each problem (answer of ``retrieve_cases``).

    ``causes`` limits the cases of a problem, ``items`` the items that a check names.
    """
    def check(label: str, c: str) -> Column:
        return F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: "), F.array_join(_leading(c, items), "; ")))

    checks = F.array_compact(F.array(*[check(V.TRIAGE[c], c) for c in ("preconditions", "actions", "expected_behaviors")]))
    totals = evidence.groupBy("question_id").agg(F.count(F.lit(1)).alias("_n"))
    fallback = F.array(F.lit(V.TRIAGE["fallback"]))
    return (
        evidence.where(F.lit(True) if causes is None else F.col("rank") <= causes)
        .join(totals, "question_id")
        .select(
            "question_id", "rank", "case_id", F.col("case_name").alias("title"),
            F.when(F.col("rank") == 1, "high").when(F.col("rank") == 2, "medium").otherwise("low").alias("likelihood"),
            F.when(F.size(checks) > 0, checks).otherwise(fallback).alias("checks"),
            F.concat(F.lit("E"), F.col("rank").cast("string")).alias("evidence_id"),
            (F.col("_n") < 2).alias("insufficient_evidence"),
        )
    )


def qa_answers(evidence: DataFrame, questions: DataFrame, max_types: int | None = None, max_cases: int | None = None) -> DataFrame:
    """Answer text per question with numbered citations of its cases; ``max_types`` and ``max_cases`` limit what a text lists."""
    name = F.coalesce("case_name", "case_id", F.lit(V.ANSWER["unnamed"]))
    kind = F.when(F.coalesce("test_type", F.lit("")) == "", F.lit(V.UNCLASSIFIED)).otherwise(F.col("test_type"))

    def listed(c: str) -> Column:
        return F.when(F.size(c) > 0, F.array_join(c, "; ")).otherwise(F.lit(V.ANSWER["not_provided"]))

    rows = evidence.select(
        "question_id",
        F.struct(
            "rank", name.alias("name"), kind.alias("kind"), F.coalesce("test_type", F.lit("")).alias("type"),
            listed("preconditions").alias("pre"), listed("actions").alias("act"), listed("expected_behaviors").alias("exp"),
        ).alias("r"),
    )
    grouped = rows.groupBy("question_id").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    both = questions.select("question_id", "question").join(grouped, "question_id", "left")
    types = F.expr("array_distinct(transform(filter(rows, r -> r.type <> ''), r -> r.type))")
    by_type = F.transform(
        _leading(types, max_types),
        lambda t: F.concat(F.lit("- **"), t, F.lit("**["), F.expr("1L") * F.array_position(F.transform("rows", lambda r: r["type"]), t), F.lit("]")),
    )
    by_case = F.transform(
        _leading("rows", max_cases),
        lambda r: F.concat(F.lit("- **"), r["name"], F.lit("** ("), r["kind"], F.lit(") ["), r["rank"].cast("string"), F.lit("]")),
    )
    wants_types = F.col("question").contains("测试类型") | F.col("question").contains("有哪些")
    first = F.get("rows", 0)
    body = F.concat(
        F.array(F.lit(V.ANSWER["opening"]), F.lit(""), F.lit(V.ANSWER["supported"])),
        F.when(
            wants_types,
            F.concat(F.array(F.lit(V.ANSWER["types"])), by_type),
        ).otherwise(F.concat(F.array(F.lit(V.ANSWER["cases"])), by_case)),
        F.array(
            F.lit(""), F.lit(V.ANSWER["sample"]),
            F.concat(F.lit(V.ANSWER["case"]), first["name"], F.lit("[1]")),
            F.concat(F.lit(V.ANSWER["type"]), first["kind"]),
            F.concat(F.lit(V.ANSWER["preconditions"]), first["pre"]),
            F.concat(F.lit(V.ANSWER["actions"]), first["act"]),
            F.concat(F.lit(V.ANSWER["expected"]), first["exp"]),
            F.lit(""), F.lit(V.ANSWER["note"]),
        ),
    )
    return both.select("question_id", F.when(F.col("rows").isNull(), F.lit(V.ANSWER["nothing"])).otherwise(F.array_join(body, "\n")).alias("answer"))


def render_pae(number: Column | str) -> Column:
    """Precondition-action-expectation chain of a case as text."""
    n = (F.col(number) if isinstance(number, str) else number).cast("string")

    def steps(c: str, label: str) -> Column:
        items = F.transform(F.col(c), lambda x, i: F.concat(F.lit(f"  {label} "), (i + 1).cast("string"), F.lit(": "), x, F.lit("\n")))
        return F.concat(F.lit("  ↓\n"), F.when(F.size(c) > 0, F.array_join(items, "")).otherwise(F.lit(f"  {label}: none\n")))

    pre = (
        F.when(F.size("preconditions") == 0, F.lit("none"))
        .when(F.size("preconditions") == 1, F.get("preconditions", 0))
        .otherwise(F.concat(F.lit("【"), F.array_join("preconditions", "、"), F.lit("】")))
    )
    kind = F.when(F.coalesce("test_type", F.lit("")) != "", F.concat(F.lit("Test type: "), F.col("test_type"), F.lit("\n\n"))).otherwise(F.lit(""))
    return F.concat(
        F.lit("[Test Case "), n, F.lit("] "), F.col("case_name"), F.lit("\n"), kind, F.lit("Logic chain:\n  Precondition: "), pre, F.lit("\n"),
        steps("actions", "Action"), steps("expected_behaviors", "Expectation"), F.lit("\n" + "-" * 60 + "\n\n"),
    )


def render_list(df: DataFrame, by: Sequence[str], line: Column, order: Sequence[str], title: str, name: str = "context") -> DataFrame:
    """Ordered lines of each (small, already limited) group under a title."""
    rows = df.select(*by, F.struct(*order, line.alias("_line")).alias("_r"))
    grouped = rows.groupBy(*by).agg(F.array_sort(F.collect_list("_r")).alias("_rows"))
    return grouped.select(*by, F.concat(F.lit(title), F.array_join(F.transform("_rows", lambda r: r["_line"]), "\n")).alias(name))


def triple_line() -> Column:
    return F.concat(F.lit("- "), F.concat_ws(" ", "head", "relation", "tail"))


def spec_line(number: Column | str) -> Column:
    """Evidence line of a document triple."""
    n = (F.col(number) if isinstance(number, str) else number).cast("string")
    sources = F.array_join("sources", ", ")
    return F.concat(
        n, F.lit(". ["), F.coalesce("doc_name", F.lit("-")), F.lit("] ("), F.concat_ws(", ", "head", "relation", "tail"), F.lit(")"),
        F.when(sources != "", F.concat(F.lit(" | source: "), sources)).otherwise(F.lit("")),
        F.when(F.coalesce("conflict", F.lit(False)), F.lit(" | conflict: true")).otherwise(F.lit("")),
    )


def _edge(relation: str):
    return lambda x: F.struct(x.alias("target"), F.lit(relation).alias("relation"))


def case_graph(cases: DataFrame) -> DataFrame:
    """Distinct edges from case names to their items."""
    groups = [("preconditions", "前提条件"), ("actions", "执行动作"), ("expected_behaviors", "预期行为")]
    rows = F.concat(
        *[
            F.transform(F.col(c), _edge(relation))
            for c, relation in groups
        ]
    )
    return cases.select(F.col("case_name").alias("source"), F.explode(rows).alias("e")).select("source", "e.*").distinct()
