"""Triple extraction, cleaning, fusion, review and quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from .scale import carry_last, computed_once, first_per_key, numbered, top_k_per_key

TRIPLE = ["head", "relation", "tail"]


def _triple(head, relation, tail) -> Column:
    def c(x):
        return F.lit(x) if isinstance(x, str) else x

    return F.struct(c(head).alias("head"), c(relation).alias("relation"), c(tail).alias("tail"))


def _pairs(*arrays: Column) -> Column:
    """Parallel lists as tuples a, b, … cut to the shortest."""
    shortest = F.least(*[F.size(a) for a in arrays]) if len(arrays) > 1 else F.size(arrays[0])
    return F.arrays_zip(*[F.slice(a, 1, shortest).alias(n) for a, n in zip(arrays, "abc")])


# ---------------------------------------------------------------- extraction
def with_lock_triples(cases: DataFrame, keep: Sequence[str], record: str = "case", name: str = "triples") -> DataFrame:
    """Parsed lock-template records with the list of their triples, in template order."""
    cases = computed_once(cases.select(*keep, record))
    r = F.col(record)
    title, kind = r["test_case_name"], F.concat(r["test_case_type"], F.lit("测试用例"))
    conditions = _pairs(r["precondition_signals"], r["precondition_values"])
    composite = F.array_join(
        F.transform(conditions, lambda x: F.concat(x["a"], F.lit("："), T.extract_value(x["b"]))), "，"
    )
    prepared = computed_once(cases.select(*keep, r.alias(record), composite.alias("_composite")))
    composite = F.col("_composite")
    rows = F.concat(
        F.array(
            _triple(kind, "属于类型", "离车上锁功能测试"),
            _triple(title, "是", kind),
            _triple(title, "验证逻辑", r["test_case_logic"]),
        ),
        F.transform(r["preconditions"], lambda x: _triple(title, "需要前提条件", x)),
        F.transform(
            _pairs(r["preconditions"], r["precondition_signals"]), lambda x: _triple(x["a"], "对应信号", x["b"])
        ),
        F.transform(conditions, lambda x: _triple(x["a"], "预期值", T.extract_value(x["b"]))),
        F.array(_triple(title, "需要复合条件", composite)),
        F.flatten(
            F.transform(
                _pairs(r["actions"], r["action_signals"], r["action_values"]),
                lambda x: F.array(
                    _triple(composite, "执行动作", x["a"]),
                    _triple(x["a"], "关联信号", x["b"]),
                    _triple(x["b"], "动作值", T.extract_value(x["c"])),
                ),
            )
        ),
        F.flatten(
            F.transform(
                _pairs(r["expectations"], r["expectation_signals"], r["expectation_values"]),
                lambda x: F.array(
                    _triple(title, "预期行为", x["a"]),
                    _triple(x["a"], "对应信号", x["b"]),
                    _triple(x["b"], "预期值", T.extract_value(x["c"])),
                ),
            )
        ),
    )
    return prepared.select(*keep, record, rows.alias(name))


def lock_triples(cases: DataFrame, keep: Sequence[str], record: str = "case") -> DataFrame:
    """Triples of parsed lock-template records, with their place ``pos`` in the record."""
    listed = with_lock_triples(cases, keep, record)
    return listed.select(*keep, F.posexplode("triples").alias("pos", "_t")).select(*keep, "pos", "_t.*")


GROUP_FIELDS = ["编号", "编号名称", "标题", "P11L_M2", "S12L_M1", "P基线", "SOP基线", "备注"]
ROW_FIELDS = ["#", "步骤", "步骤描述", "预期结果", "结果信号"]


def fill_groups(rows: DataFrame, source: str, row: str, is_new: Column, first: Column, name: str = "group") -> DataFrame:
    """Attach to each row the ``first`` value of the last row that starts a group; rows before any group go."""
    marked = rows.withColumn(name, F.when(is_new, first))
    return carry_last(marked, [source], [F.col(row)], [name]).where(F.col(name).isNotNull())


def grouped_triples(rows: DataFrame, source: str = "source", row: str = "row") -> DataFrame:
    """Triples of grouped-template rows; a group's fields stand on its first row only."""
    fields = [c for c in GROUP_FIELDS + ROW_FIELDS if c in rows.columns]
    clean = rows.select(source, row, *[T.clean_cell(F.col(f"`{c}`")).alias(c) for c in fields])
    for c in GROUP_FIELDS + ROW_FIELDS:
        if c not in fields:
            clean = clean.withColumn(c, F.lit(""))
    clean = computed_once(clean)
    cell = {c: F.col(f"`{c}`") for c in GROUP_FIELDS + ROW_FIELDS}
    filled = clean.where(F.concat(*cell.values()) != "")
    is_new = (cell["编号"] != "") | (cell["编号名称"] != "") | (cell["标题"] != "")
    first = F.struct(F.col(row).alias("row"), *[cell[c].alias(c) for c in GROUP_FIELDS])
    grouped = fill_groups(filled, source, row, is_new, first)
    g = {c: F.col("group")[c] for c in GROUP_FIELDS}
    title = g["标题"]
    on_first = F.col("group")["row"] == F.col(row)
    step_one = cell["#"] == "1"

    def fields_of(names):
        return F.array(*[_triple(title, c, g[c]) for c in names])

    none = F.array().cast("array<struct<head:string,relation:string,tail:string>>")
    head_rows = F.concat(
        F.array(_triple(g["编号"], "编号名称", g["编号名称"]), _triple(g["编号名称"], "包含测试用例", title)),
        fields_of(["P11L_M2", "S12L_M1", "P基线", "SOP基线", "备注"]),
    )
    action = F.when(step_one, F.lit("前提条件")).otherwise(F.lit("操作动作"))
    detail = F.when(step_one, F.lit("前提条件描述")).otherwise(F.lit("步骤描述"))
    step_rows = F.concat(
        F.transform(T.split_numbered_items(cell["步骤"]), lambda x: _triple(title, action, x)),
        F.array(_triple(title, detail, cell["步骤描述"])),
        F.transform(T.split_numbered_items(cell["预期结果"]), lambda x: _triple(title, "预期结果", x)),
        F.array(_triple(title, "结果信号", cell["结果信号"])),
    )
    out = grouped.select(
        source,
        F.col("group")["row"].alias("row"),
        F.col(row).alias("_at"),
        F.explode(F.concat(F.when(on_first, head_rows).otherwise(none), step_rows)).alias("t"),
    )
    clean_t = out.select(source, "row", *[T.clean_cell(F.col("t")[c]).alias(c) for c in TRIPLE])
    return clean_t.where((F.col("head") != "") & (F.col("relation") != "") & (F.col("tail") != ""))


def case_triples(cases: DataFrame, key: str = "case_id") -> DataFrame:
    """Type, precondition, action and expectation triples of normalised cases."""
    title = F.when(F.coalesce("case_name", F.lit("")) != "", F.col("case_name")).otherwise(F.lit("Unnamed case"))
    rows = F.concat(
        F.when(F.coalesce("test_type", F.lit("")) != "", F.array(_triple(title, "属于类型", F.col("test_type")))).otherwise(
            F.array().cast("array<struct<head:string,relation:string,tail:string>>")
        ),
        F.transform(F.coalesce("preconditions", F.array()), lambda x: _triple(title, "前提条件", x)),
        F.transform(F.coalesce("actions", F.array()), lambda x: _triple(title, "操作动作", x)),
        F.transform(F.coalesce("expected_behaviors", F.array()), lambda x: _triple(title, "预期结果", x)),
    )
    empty = F.array(_triple(title, "待补充", "No extractable content"))
    return (
        cases.select(key, rows.alias("_rows"), empty.alias("_empty"))
        .select(key, F.explode(F.when(F.size("_rows") > 0, F.col("_rows")).otherwise(F.col("_empty"))).alias("t"))
        .select(key, "t.*")
    )


# ---------------------------------------------------------------- sanitising
def expand_tail(relation: Column, tail: Column, table_type: Column) -> Column:
    """Conditions of one tail: numbered list, conjunction, or the tail itself."""
    splittable = (table_type != V.STRUCTURE_TABLE) & relation.isin(V.SPLIT_RELATIONS)

    def single(whole: Column) -> Column:
        return F.filter(F.array(whole), lambda x: x != "")

    def listed(whole: Column) -> Column:
        body = T.strip(F.regexp_replace(whole, V.ENUMERATION_PREFIX, ""))
        parts = F.transform(
            F.split(body, r"(?U)(?=\d+[.、]\s*)"),
            lambda p: T.normalize_term(F.btrim(F.regexp_replace(p, r"(?sU)^(.*?)\d+[.、]\s*", "$1"), F.lit(" ；;，,"))),
        )
        return F.filter(parts, lambda x: x != "")

    def joint(whole: Column) -> Column:
        parts = F.split(F.regexp_replace(whole, "[；;]", " && "), r"(?U)\s*(?:&&|并且|且)\s*")
        return F.filter(F.transform(parts, T.normalize_term), lambda x: x != "")

    def several(parts: Column, otherwise: Column) -> Column:
        return T.let(parts, lambda p: F.when(F.size(p) > 1, p).otherwise(otherwise))

    def expand(whole: Column) -> Column:
        enumerated = whole.rlike(V.ENUMERATION_PREFIX) | whole.rlike(r"(?U)\d+[.、]")
        conjunctive = whole.rlike("&&|并且|且|;|；")
        by_and = F.when(conjunctive, several(joint(whole), single(whole))).otherwise(single(whole))
        by_list = F.when(enumerated, several(listed(whole), by_and)).otherwise(by_and)
        return F.when(splittable, by_list).otherwise(single(whole))

    return T.let(T.normalize_term(tail), expand)


def sanitize_triples(
    raw: DataFrame,
    allowed: Sequence[str],
    image: str = "source_image_id",
    order: str = "row_id",
    aliases: dict[str, str] = V.RELATION_ALIASES,
) -> DataFrame:
    """Normalised, whitelisted, expanded triples, one per (image, head, relation, tail)."""
    trimmed = T.strip(F.coalesce("relation", F.lit("")))
    relation = trimmed
    for alias, name in aliases.items():
        relation = F.when(F.lower(trimmed) == alias, F.lit(name)).otherwise(relation)
    table_type = F.coalesce("source_table_type", F.lit("other"))
    rows = (
        raw.withColumn("relation", relation)
        .withColumn("head", T.normalize_term("head"))
        .withColumn("tail", T.strip(F.coalesce("tail", F.lit(""))))
        .where((F.col("head") != "") & (F.col("relation") != "") & (F.col("tail") != ""))
        .where(
            F.when(table_type == V.STRUCTURE_TABLE, F.col("relation").isin(V.STRUCTURE_RELATIONS)).otherwise(
                F.col("relation").isin(list(allowed))
            )
        )
    )
    others = [c for c in raw.columns if c not in TRIPLE]
    expanded = rows.select(
        *others, "head", "relation", F.posexplode(expand_tail(F.col("relation"), F.col("tail"), table_type)).alias("_pos", "tail")
    )
    return first_per_key(expanded, [image, *TRIPLE], [order, "_pos"]).select(*others, *TRIPLE)


def ocr_whitelist(ocr: DataFrame, conf: float = 0.8, min_len: int = 2, max_len: int = 60, cap: int | None = None) -> DataFrame:
    """Terms of each image: confident, valid, distinct ignoring case, all or the first ``cap`` in line order."""
    good = ocr.where((F.col("score") >= conf) & T.is_valid_term("text", min_len, max_len))
    keyed = good.select("image_id", "line_index", "text", T.fold("text").alias("_fold"))
    firsts = first_per_key(keyed, ["image_id", "_fold"], ["line_index"])
    order = [F.col("line_index")]
    ranked = numbered(firsts, ["image_id"], order, "term_no") if cap is None else top_k_per_key(firsts, ["image_id"], order, cap, "term_no")
    return ranked.select("image_id", "term_no", "text")


def term_confidence(terms: DataFrame, ocr: DataFrame) -> DataFrame:
    """Best OCR score and number of OCR hits of each (image, term)."""
    scores = (
        ocr.select("image_id", T.fold(T.strip("text")).alias("_fold"), "score")
        .where(F.col("_fold") != "")
        .groupBy("image_id", "_fold")
        .agg(F.max("score").alias("_best"), F.count(F.lit(1)).alias("_hits"))
    )
    return (
        terms.withColumn("_fold", T.fold(T.strip("text")))
        .join(scores, ["image_id", "_fold"], "left")
        .withColumn("confidence", F.round("_best", 4))
        .withColumn("hits", F.coalesce("_hits", F.lit(0)).cast("long"))
        .drop("_fold", "_best", "_hits")
    )


# ---------------------------------------------------------------- review
def apply_corrections(triples: DataFrame, corrections: DataFrame, image: str = "image_id") -> DataFrame:
    """Delete, modify and add triples; the last modify of an index wins and beats a delete.

    triples: image, idx, head, relation, tail.  corrections: image, seq, action,
    triple_indices, head, relation, tail, confirmed.
    """
    active = corrections.where(F.coalesce("confirmed", F.lit(True)))
    hits = active.where(F.col("action").isin("delete", "modify")).select(
        image, "seq", "action", F.explode("triple_indices").alias("idx"), F.struct(*TRIPLE).alias("_new")
    )
    modify = first_per_key(
        hits.where(F.col("action") == "modify").select(image, "idx", "seq", "_new"), [image, "idx"], ["seq"], latest=True
    ).select(image, "idx", "_new")
    deleted = hits.where(F.col("action") == "delete").select(image, "idx").distinct().withColumn("_gone", F.lit(True))
    kept = (
        triples.join(modify, [image, "idx"], "left")
        .join(deleted, [image, "idx"], "left")
        .where(F.col("_new").isNotNull() | F.col("_gone").isNull())
        .select(image, "idx", *[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in TRIPLE])
    )
    added = active.where(F.col("action") == "add").select(image, F.lit(None).cast("int").alias("idx"), *TRIPLE)
    return kept.withColumn("idx", F.col("idx").cast("int")).unionByName(added)


def reviewed_triples(rows: DataFrame) -> DataFrame:
    """Kept rows whose cells are not empty after cleaning."""
    keep = F.coalesce("keep", F.lit(True)) if "keep" in rows.columns else F.lit(True)
    clean = rows.where(keep).withColumns({c: T.clean_cell(c) for c in TRIPLE})
    return clean.where((F.col("head") != "") & (F.col("relation") != "") & (F.col("tail") != ""))


def extracted_confidence(note: Column | str) -> Column:
    c = F.col(note) if isinstance(note, str) else note
    return F.when(F.lower(F.coalesce(c, F.lit("medium"))) == "medium", F.lit(0.8)).otherwise(F.lit(1.0))


def fused_confidence(conflict: Column | str) -> Column:
    c = F.col(conflict) if isinstance(conflict, str) else conflict
    return F.when(F.coalesce(c, F.lit(False)), F.lit(0.55)).otherwise(F.lit(0.95))


def route_templates(headers: DataFrame, registry: DataFrame) -> DataFrame:
    """Template kind of each sheet by its headers, with the enabled skill for it.

    headers: source, file_type, headers (array).  registry: skill_id, file_type,
    template_kind, status, position.
    """
    lock = F.array(*[F.lit(x) for x in V.RECORD_SCALARS + V.RECORD_LISTS])
    required = F.array(*[F.lit(x) for x in V.GROUPED_REQUIRED])
    normal = F.transform("headers", lambda h: T.normalize_header(h))
    kind = (
        F.when(F.col("headers") == lock, F.lit("lock_test_case"))
        .when(F.size(F.array_except(required, normal)) == 0, F.lit("grouped_test_case"))
        .otherwise(F.lit("unknown"))
    )
    skills = first_per_key(
        registry.where(F.coalesce("status", F.lit("enabled")) == "enabled").select(
            "file_type", "template_kind", "skill_id", "position"
        ),
        ["file_type", "template_kind"],
        ["position"],
    ).drop("position")
    return (
        headers.withColumn("template_kind", kind)
        .join(skills, ["file_type", "template_kind"], "left")
        .select(
            "source",
            "template_kind",
            F.coalesce("skill_id", F.concat("file_type", F.lit(".unknown_template.draft"))).alias("skill_id"),
            F.when(F.col("skill_id").isNotNull(), F.lit(0.98)).otherwise(F.lit(0.35)).alias("confidence"),
            F.when(F.col("skill_id").isNotNull(), F.lit("enabled")).otherwise(F.lit("pending_review")).alias("status"),
        )
    )


def bracket_mismatch(*cells: Column | str) -> Column:
    """True when the cells hold different numbers of ``[``."""
    cols = [F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cells]
    counts = [F.length(c) - F.length(F.replace(c, F.lit("["), F.lit(""))) for c in cols]
    return F.greatest(*counts) != F.least(*counts)


# ---------------------------------------------------------------- fusion and quality
def fuse_exact(triples: DataFrame, scope: Sequence[str] = (), order: Sequence[str] = ("row_id",)) -> DataFrame:
    """One row per normalised triple (per ``scope``): first surface form, united sources."""
    keys = [T.normalize_term(c).alias(f"_k_{c}") for c in TRIPLE]
    rest = ["head", "relation", "tail", "sources", "conflict", "conflict_note"]
    key = [*scope, *[f"_k_{c}" for c in TRIPLE]]
    keyed = triples.select(*scope, *keys, *rest, F.struct(*order).alias("_order"))
    # one row for each source first, so that a frequent triple gathers each source once
    each = keyed.select("*", F.posexplode_outer("sources").alias("_at", "_source"))
    by_source = each.groupBy(*key, "_source").agg(
        F.min_by(F.struct(*rest), "_order").alias("_first"), F.min("_order").alias("_order"), F.sum((F.coalesce("_at", F.lit(0)) == 0).cast("long")).alias("_n")
    )
    out = by_source.groupBy(*key).agg(
        F.min_by("_first", "_order").alias("_first"), F.sum("_n").alias("_n"), F.array_sort(F.collect_list("_source")).alias("_union")
    )
    return out.select(
        *scope,
        *[F.col("_first")[c].alias(c) for c in TRIPLE],
        F.when(F.col("_n") == 1, F.col("_first")["sources"]).otherwise(F.col("_union")).alias("sources"),
        F.coalesce(F.col("_first")["conflict"], F.lit(False)).alias("conflict"),
        F.coalesce(F.col("_first")["conflict_note"], F.lit("")).alias("conflict_note"),
    )


def fusion_report(raw: DataFrame, fused: DataFrame) -> DataFrame:
    """Counts before and after fusion, exact duplicates, reduction, conflicts; one row."""
    dup = raw.groupBy(*[T.strip(F.coalesce(c, F.lit(""))).alias(c) for c in TRIPLE]).count()
    before = dup.agg(F.sum("count").alias("raw_count"), F.sum(F.col("count") - 1).alias("duplicate_exact_removed"))
    after = fused.agg(
        F.count(F.lit(1)).alias("fused_count"),
        F.coalesce(F.sum(F.col("conflict").cast("long")), F.lit(0)).alias("conflict_count"),
    )
    both = before.withColumn("one", F.lit(1)).join(after.withColumn("one", F.lit(1)), "one").drop("one")
    return both.select(
        F.coalesce("raw_count", F.lit(0)).alias("raw_count"),
        "fused_count",
        F.coalesce("duplicate_exact_removed", F.lit(0)).alias("duplicate_exact_removed"),
        F.greatest(F.lit(0), F.coalesce("raw_count", F.lit(0)) - F.col("fused_count")).alias("semantic_reduction"),
        "conflict_count",
    )


def quality_report(triples: DataFrame, by: Sequence[str], mismatches: DataFrame | None = None) -> DataFrame:
    """Empty, duplicate and low-confidence counts with the penalty score, per ``by``."""
    blank = (T.strip("head") == "") | (T.strip("relation") == "") | (T.strip("tail") == "")
    per_triple = triples.groupBy(*by, *TRIPLE).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum((F.col("confidence") < 0.5).cast("long")).alias("_low"),
    )
    report = per_triple.groupBy(*by).agg(
        F.sum("_n").alias("total_triples"),
        F.sum(F.when(blank, F.col("_n")).otherwise(0)).alias("empty_field_count"),
        F.sum(F.col("_n") - 1).alias("duplicate_count"),
        F.sum("_low").alias("low_confidence_count"),
    )
    if mismatches is None:
        report = report.withColumn("field_mismatch_count", F.lit(0).cast("long"))
    else:
        report = report.join(mismatches, list(by), "left").withColumn(
            "field_mismatch_count", F.coalesce("field_mismatch_count", F.lit(0)).cast("long")
        )
    total = F.col("total_triples")
    score = (
        F.lit(1.0)
        - F.least(F.lit(0.35), F.col("empty_field_count") / total)
        - F.least(F.lit(0.25), F.col("duplicate_count") / total)
        - F.least(F.lit(0.2), F.col("low_confidence_count") / total)
        - F.least(F.lit(0.2), F.col("field_mismatch_count") * 0.05)
    )
    return report.withColumn("score", F.rint(F.greatest(F.lit(0.0), score) * 1000) / 1000)


def profile_manifest(manifest: DataFrame) -> DataFrame:
    """Images and missing files per document."""
    return manifest.groupBy(F.coalesce("doc_name", "doc_id", F.lit("unknown")).alias("doc_name")).agg(
        F.count(F.lit(1)).alias("image_count"),
        F.sum((~F.coalesce("image_exists", F.lit(False))).cast("long")).alias("missing_count"),
    )


def filter_manifest(manifest: DataFrame, triples: DataFrame | None = None, query: str = "") -> DataFrame:
    """Images whose id or file name contains the query, optionally only those with triples."""
    out = manifest
    if query:
        q = query.lower()
        out = out.where(F.lower("image_id").contains(q) | F.lower("file_name").contains(q))
    if triples is not None:
        out = out.join(triples.select(F.col("source_image_id").alias("image_id")).distinct(), "image_id", "left_semi")
    return out


def batch_no(df: DataFrame, n: int, order: Sequence[Column], name: str = "batch") -> DataFrame:
    """Number of the batch of ``n`` consecutive rows a row falls in."""
    ranked = numbered(df, [], order, "_rank")
    return ranked.withColumn(name, F.ceil(F.col("_rank") / n).cast("long")).drop("_rank")


def merge_evidence(graph: DataFrame, documents: DataFrame) -> DataFrame:
    """Graph triples and document triples as one evidence list."""
    return graph.withColumn("source", F.lit("graph")).unionByName(
        documents.withColumn("source", F.lit("documents")), allowMissingColumns=True
    )


def edge_list(triples: DataFrame, cap: int | None = None, order: Sequence[str] = TRIPLE) -> tuple[DataFrame, DataFrame]:
    """The kept edges in order, the first ``cap`` if one is given, and their sorted distinct nodes."""
    keep = F.coalesce("keep", F.lit(True)) if "keep" in triples.columns else F.lit(True)
    edges = (
        triples.where(keep & (F.coalesce("head", F.lit("")) != "") & (F.coalesce("tail", F.lit("")) != ""))
        .orderBy(*order)
    )
    if cap is not None:
        edges = edges.limit(cap)
    nodes = edges.select(F.explode(F.array("head", "tail")).alias("name")).distinct().orderBy("name")
    return edges, nodes
