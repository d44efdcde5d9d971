"""Triple extraction, fusion and review queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import triples as X
from . import bindings as B
from .registry import Family
from .text_queries import LOCK_CASES_SQL, lock_records

FAMILY = Family()
query = FAMILY.query


@query(
    "case_triples",
    f"""WITH {B.CASES_SQL} SELECT case_id, case_name AS head, '属于类型' AS relation, test_type AS tail FROM cases
      UNION ALL SELECT case_id, case_name, '前提条件', unnest(preconditions) FROM cases
      UNION ALL SELECT case_id, case_name, '操作动作', unnest(actions) FROM cases
      UNION ALL SELECT case_id, case_name, '预期结果', unnest(expected_behaviors) FROM cases""",
)
def case_triples(spark, d):
    return X.case_triples(B.cases(spark, d))


LOCK_TRIPLES_SQL = """
lock_triples AS (
  SELECT o_orderkey, test_case_type || '测试用例' AS head, '属于类型' AS relation, '离车上锁功能测试' AS tail FROM lock_cases
  UNION ALL SELECT o_orderkey, test_case_name, '是', test_case_type || '测试用例' FROM lock_cases
  UNION ALL SELECT o_orderkey, test_case_name, '验证逻辑', test_case_logic FROM lock_cases
  UNION ALL SELECT o_orderkey, test_case_name, '需要前提条件', unnest(preconditions) FROM lock_cases
  UNION ALL SELECT o_orderkey, unnest(preconditions), '对应信号', unnest(precondition_signals) FROM lock_cases
  UNION ALL SELECT o_orderkey, unnest(precondition_signals), '预期值', unnest(precondition_values) FROM lock_cases
  UNION ALL SELECT o_orderkey, test_case_name, '需要复合条件', composite FROM composites
  UNION ALL SELECT c.o_orderkey, composite, '执行动作', unnest(actions[1:2]) FROM lock_cases c JOIN composites USING (o_orderkey)
  UNION ALL SELECT o_orderkey, unnest(actions[1:2]), '关联信号', unnest(action_signals[1:2]) FROM lock_cases
  UNION ALL SELECT o_orderkey, unnest(action_signals[1:2]), '动作值', unnest(action_values) FROM lock_cases
  UNION ALL SELECT o_orderkey, test_case_name, '预期行为', unnest(expectations) FROM lock_cases
  UNION ALL SELECT o_orderkey, unnest(expectations), '对应信号', unnest(expectation_signals) FROM lock_cases
  UNION ALL SELECT o_orderkey, unnest(expectation_signals), '预期值', unnest(expectation_values) FROM lock_cases)"""
COMPOSITES_SQL = """
composites AS (
  SELECT o_orderkey, test_case_name, array_to_string(list_transform(range(1, len(precondition_signals) + 1),
    lambda i: precondition_signals[i] || '：' || precondition_values[i]), '，') AS composite FROM lock_cases)"""


@query("lock_triples", f"WITH {LOCK_CASES_SQL}, {COMPOSITES_SQL}, {LOCK_TRIPLES_SQL} SELECT * FROM lock_triples")
def lock_triples(spark, d):
    parsed = lock_records(spark, d).select("o_orderkey", T.parse_case_record("record").alias("case"))
    return X.lock_triples(parsed, ["o_orderkey"]).drop("pos")


def grouped_sheet(spark, d):
    """Order lines as rows of a grouped-template sheet per order priority."""
    orders = B.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    li = B.lines(spark, d).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    first = F.col("pos") == 1

    def on_first(value):
        return F.when(first, value)

    return li.select(
        F.col("o_orderpriority").alias("source"),
        (F.col("l_orderkey") * 1000 + F.col("pos")).alias("row"),
        on_first(F.concat(F.lit("N"), F.col("o_orderkey"))).alias("编号"),
        on_first(F.concat(F.lit("F"), F.col("o_custkey"), F.lit("。"))).alias("编号名称"),
        on_first(F.concat(F.lit("T"), F.col("o_orderkey"))).alias("标题"),
        on_first(F.col("l_linestatus")).alias("P基线"),
        F.lit("nan").alias("备注"),
        F.col("pos").cast("string").alias("#"),
        F.concat(F.lit("1. "), F.col("p_brand"), F.lit("\n2、"), F.col("p_type"), F.lit("；\n")).alias("步骤"),
        F.col("p_name").alias("步骤描述"),
        F.col("l_returnflag").alias("预期结果"),
        F.when(F.col("l_linestatus") == "O", F.lit("open")).otherwise(F.lit("")).alias("结果信号"),
    )


@query(
    "grouped_triples",
    f"""WITH {B.LINES_SQL}, s AS (SELECT o.o_orderpriority AS source, l_orderkey * 1000 + 1 AS row, 'T' || o_orderkey AS title,
          'N' || o_orderkey AS code, 'F' || o_custkey AS fname, l.* FROM lines l JOIN orders o ON l_orderkey = o_orderkey)
      SELECT source, row, code AS head, '编号名称' AS relation, fname AS tail FROM s WHERE pos = 1
      UNION ALL SELECT source, row, fname, '包含测试用例', title FROM s WHERE pos = 1
      UNION ALL SELECT source, row, title, 'P基线', l_linestatus FROM s WHERE pos = 1
      UNION ALL SELECT source, row, title, CASE WHEN pos = 1 THEN '前提条件' ELSE '操作动作' END, p_brand FROM s
      UNION ALL SELECT source, row, title, CASE WHEN pos = 1 THEN '前提条件' ELSE '操作动作' END, p_type FROM s
      UNION ALL SELECT source, row, title, CASE WHEN pos = 1 THEN '前提条件描述' ELSE '步骤描述' END, p_name FROM s
      UNION ALL SELECT source, row, title, '预期结果', l_returnflag FROM s
      UNION ALL SELECT source, row, title, '结果信号', 'open' FROM s WHERE l_linestatus = 'O'""",
)
def grouped_triples(spark, d):
    return X.grouped_triples(grouped_sheet(spark, d))


@query(
    "fill_groups",
    f"""WITH {B.LINES_SQL} SELECT o_orderpriority AS source, l_orderkey * 1000 + pos AS row, l_orderkey * 1000 + 1 AS group_row
        FROM lines JOIN orders ON l_orderkey = o_orderkey""",
)
def fill_groups(spark, d):
    rows = grouped_sheet(spark, d).select("source", "row", "编号")
    out = X.fill_groups(rows, "source", "row", F.col("编号").isNotNull(), F.col("row"), "group_row")
    return out.select("source", "row", "group_row")


def dirty_triples(spark, d):
    """Extracted-looking triples with aliases, lists, conjunctions and table types."""
    flag, ln = F.col("l_returnflag"), F.col("l_linenumber")
    structure = ln == 7
    return B.lines(spark, d).select(
        F.struct("l_orderkey", "pos").alias("row_id"),
        F.concat(F.lit("（"), F.col("p_name"), F.lit("） ")).alias("head"),
        F.when(structure & (flag == "A"), F.lit("连接到"))
        .when(structure | (flag == "A"), F.lit("触发条件"))
        .when(flag == "N", F.lit(" 触发Condition"))
        .when(F.col("l_linestatus") == "O", F.lit("依赖于"))
        .otherwise(F.lit("unlisted"))
        .alias("relation"),
        F.when(ln == 1, F.concat(F.lit("满足以下任一条件：1."), F.col("p_brand"), F.lit("；2."), F.col("p_type")))
        .when(ln == 2, F.concat_ws(" && ", "p_brand", "p_type"))
        .when(ln == 3, F.concat_ws("；", "p_brand", "p_type"))
        .otherwise(F.col("p_brand"))
        .alias("tail"),
        F.concat(F.lit("img"), F.col("l_suppkey")).alias("source_image_id"),
        F.when(structure, F.lit("structure_table")).otherwise(F.lit("logic_table")).alias("source_table_type"),
    )


@query(
    "sanitize_triples",
    f"""WITH {B.LINES_SQL}, r AS (
      SELECT 'img' || l_suppkey AS source_image_id, '(' || p_name || ')' AS head,
        CASE WHEN l_linenumber = 7 THEN CASE WHEN l_returnflag = 'A' THEN '连接到' END
             WHEN l_returnflag IN ('A', 'N') THEN '触发条件' WHEN l_linestatus = 'O' THEN '依赖于' END AS relation,
        l_linenumber AS ln, p_brand, p_type FROM lines),
      e AS (
        SELECT source_image_id, head, relation, unnest(CASE
          WHEN relation = '触发条件' AND ln IN (1, 2, 3) THEN [p_brand, p_type]
          WHEN ln = 1 THEN ['满足以下任一条件:1.' || p_brand || '；2.' || p_type]
          WHEN ln = 2 THEN [p_brand || ' && ' || p_type] WHEN ln = 3 THEN [p_brand || '；' || p_type]
          ELSE [p_brand] END) AS tail FROM r WHERE relation IS NOT NULL)
      SELECT DISTINCT source_image_id, head, relation, tail FROM e""",
)
def sanitize_triples(spark, d):
    out = X.sanitize_triples(dirty_triples(spark, d), ["触发条件", "依赖于"])
    return out.select("source_image_id", *X.TRIPLE)


def ocr(spark, d):
    """Words of the documents as OCR lines; the score depends on the word's place."""
    words = B.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("line_index", "text"))
    return words.select(
        F.concat(F.lit("img"), F.col("doc_id")).alias("image_id"), "line_index", "text",
        ((F.col("line_index") % 10 + 1) / 10).alias("score"),
    )


_OCR_SQL = r"""
w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) - 1 AS line_index FROM documents),
ocr AS (SELECT 'img' || doc_id AS image_id, line_index, text, (line_index % 10 + 1) / 10 AS score,
  lower(replace(replace(text, 'ß', 'ss'), 'ẞ', 'ss')) AS fold,
  trim(translate(regexp_replace(regexp_replace(text, '[\s\x{3000}]+', ' ', 'g'), '^ | $', '', 'g'), '（）：，', '():,'), ' ,;；。') AS term FROM w),
firsts AS (
  SELECT image_id, fold, min(line_index) AS line_index, arg_min(text, line_index) AS text FROM ocr
  WHERE score >= 0.8 AND length(term) BETWEEN 3 AND 20 AND NOT regexp_full_match(term, '[-–_=+./\\|:;,0-9]+')
  GROUP BY 1, 2),
whitelist AS (
  SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY line_index) AS term_no, text FROM firsts
  QUALIFY term_no <= 50)"""


@query("ocr_whitelist", f"WITH {_OCR_SQL} SELECT * FROM whitelist")
def ocr_whitelist(spark, d):
    return X.ocr_whitelist(ocr(spark, d), 0.8, 3, 20, 50)


@query(
    "term_confidence",
    rf"""WITH {_OCR_SQL}, s AS (
        SELECT image_id, regexp_replace(fold, '^\s+|\s+$', '', 'g') AS fold, max(score) AS best, count(*) AS hits
        FROM ocr GROUP BY 1, 2)
      SELECT l.image_id, term_no, text, round(best, 4) AS confidence, coalesce(hits, 0) AS hits
      FROM whitelist l LEFT JOIN s ON l.image_id = s.image_id
        AND lower(replace(replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), 'ß', 'ss'), 'ẞ', 'ss')) = s.fold""",
)
def term_confidence(spark, d):
    records = ocr(spark, d)
    return X.term_confidence(X.ocr_whitelist(records, 0.8, 3, 20, 50), records)


_FUSED = """SELECT {scope} arg_min(head, l_orderkey * 1000 + pos) AS head, arg_min(relation, l_orderkey * 1000 + pos) AS relation,
    arg_min(tail, l_orderkey * 1000 + pos) AS tail, array_to_string(list_sort(list(DISTINCT src)), ',') AS sources,
    arg_min(conflict, l_orderkey * 1000 + pos) AS conflict, arg_min(conflict_note, l_orderkey * 1000 + pos) AS conflict_note
  FROM raw_triples GROUP BY {keys} kh, kr, kt"""
FUSED_SQL = f"fused AS ({_FUSED.format(scope='', keys='')})"


def fused(spark, d, scope=()):
    return X.fuse_exact(B.raw_triples(spark, d), scope, ("row_id",))


@query("fuse_exact", f"WITH {B.LINES_SQL}, {B.RAW_TRIPLES_SQL} {_FUSED.format(scope='', keys='')}")
def fuse_exact(spark, d):
    return fused(spark, d).withColumn("sources", F.array_join("sources", ","))


@query(
    "fuse_exact_per_document",
    f"WITH {B.LINES_SQL}, {B.RAW_TRIPLES_SQL} {_FUSED.format(scope='doc_id,', keys='doc_id,')}",
)
def fuse_exact_per_document(spark, d):
    return fused(spark, d, ["doc_id"]).withColumn("sources", F.array_join("sources", ","))


@query(
    "fusion_report",
    rf"""WITH {B.LINES_SQL}, {B.RAW_TRIPLES_SQL}, {FUSED_SQL}, g AS (
          SELECT count(*) AS n FROM raw_triples GROUP BY trim(head), trim(relation), trim(tail))
        SELECT (SELECT count(*) FROM raw_triples) AS raw_count, (SELECT count(*) FROM fused) AS fused_count,
          (SELECT CAST(sum(n - 1) AS BIGINT) FROM g) AS duplicate_exact_removed,
          (SELECT count(*) FROM raw_triples) - (SELECT count(*) FROM fused) AS semantic_reduction,
          (SELECT count(*) FROM fused WHERE conflict) AS conflict_count""",
)
def fusion_report(spark, d):
    return X.fusion_report(B.raw_triples(spark, d), fused(spark, d))


@query(
    "quality_report",
    f"""WITH {B.LINES_SQL}, {B.RAW_TRIPLES_SQL}, t AS (
          SELECT doc_id, CASE WHEN conflict THEN ' ' ELSE head END AS head, relation, tail, confidence FROM raw_triples),
        g AS (SELECT doc_id, head, relation, tail, count(*) AS n, sum(CASE WHEN confidence < 0.5 THEN 1 ELSE 0 END) AS low
              FROM t GROUP BY 1, 2, 3, 4),
        r AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS total_triples,
                CAST(sum(CASE WHEN trim(head) = '' THEN n ELSE 0 END) AS BIGINT) AS empty_field_count,
                CAST(sum(n - 1) AS BIGINT) AS duplicate_count, CAST(sum(low) AS BIGINT) AS low_confidence_count,
                CAST(0 AS BIGINT) AS field_mismatch_count FROM g GROUP BY 1)
        SELECT *, round_even(greatest(0.0::DOUBLE, 1.0::DOUBLE - least(0.35::DOUBLE, empty_field_count / total_triples)
          - least(0.25::DOUBLE, duplicate_count / total_triples) - least(0.2::DOUBLE, low_confidence_count / total_triples)
          - 0.0::DOUBLE) * 1000, 0)::DOUBLE / 1000 AS score FROM r""",
)
def quality_report(spark, d):
    rows = B.raw_triples(spark, d).withColumn("head", F.when(F.col("conflict"), F.lit(" ")).otherwise(F.col("head")))
    return X.quality_report(rows, ["doc_id"])


@query(
    "confidence_mapping",
    f"""WITH {B.LINES_SQL}, {B.RAW_TRIPLES_SQL}, {FUSED_SQL}
        SELECT head, relation, tail, CASE WHEN conflict THEN 0.55::DOUBLE ELSE 0.95::DOUBLE END AS confidence,
          CASE WHEN conflict_note = '' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS extracted_confidence FROM fused""",
)
def confidence_mapping(spark, d):
    note = F.when(F.col("conflict_note") == "", F.lit("high")).otherwise(F.lit("Medium"))
    return fused(spark, d).select(
        *X.TRIPLE, X.fused_confidence("conflict").alias("confidence"), X.extracted_confidence(note).alias("extracted_confidence")
    )


@query(
    "apply_corrections",
    f"""WITH {B.LINES_SQL},
      t AS (SELECT 'order' || l_orderkey AS image_id, CAST(pos AS INTEGER) AS idx, p_name AS head, 'IS' AS relation, p_brand AS tail,
                   l_quantity AS q, l_discount AS dc FROM lines)
      SELECT image_id, idx, CASE WHEN q > 40 THEN head || ' v2' ELSE head END AS head,
             relation, CASE WHEN q > 40 THEN tail || '!' ELSE tail END AS tail FROM t WHERE q > 40 OR NOT dc > 0.07
      UNION ALL SELECT image_id, NULL, head || ' new', relation, tail FROM t WHERE q = 1""",
)
def apply_corrections(spark, d):
    li = B.lines(spark, d)
    image = F.concat(F.lit("order"), F.col("l_orderkey")).alias("image_id")
    idx = F.col("pos").cast("int")
    triples = li.select(image, idx.alias("idx"), F.col("p_name").alias("head"), F.lit("IS").alias("relation"), F.col("p_brand").alias("tail"))

    def part(rows, seq, action, head, tail):
        return rows.select(
            image, F.lit(seq).alias("seq"), F.lit(action).alias("action"), F.array(idx, idx).alias("triple_indices"),
            head.alias("head"), F.lit("IS").alias("relation"), tail.alias("tail"), F.lit(True).alias("confirmed"),
        )

    name, brand = F.col("p_name"), F.col("p_brand")
    corrections = (
        part(li.where(F.col("l_quantity") > 40), 1, "modify", F.concat(name, F.lit(" v1")), brand)
        .unionByName(part(li.where(F.col("l_quantity") > 40), 2, "modify", F.concat(name, F.lit(" v2")), F.concat(brand, F.lit("!"))))
        .unionByName(part(li.where(F.col("l_discount") > 0.07), 3, "delete", name, brand))
        .unionByName(part(li.where(F.col("l_quantity") == 1), 4, "add", F.concat(name, F.lit(" new")), brand))
    )
    return X.apply_corrections(triples, corrections)


@query(
    "reviewed_triples",
    f"""WITH {B.LINES_SQL} SELECT l_orderkey, pos, p_name AS head, l_returnflag AS relation, p_brand AS tail
        FROM lines WHERE l_linestatus = 'O' AND l_discount > 0""",
)
def reviewed_triples(spark, d):
    rows = B.lines(spark, d).select(
        "l_orderkey", "pos", F.concat("p_name", F.lit("。")).alias("head"), F.col("l_returnflag").alias("relation"),
        F.when(F.col("l_discount") > 0, F.col("p_brand")).otherwise(F.lit(" nan ")).alias("tail"),
        (F.col("l_linestatus") == "O").alias("keep"),
    )
    return X.reviewed_triples(rows).drop("keep")


@query(
    "route_templates",
    """SELECT p_partkey AS source, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'grouped_test_case'
           WHEN p_type = 'STANDARD' THEN 'lock_test_case' ELSE 'unknown' END AS template_kind,
         CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'grouped.v1' WHEN p_type = 'STANDARD' THEN 'lock.v1'
           ELSE 'excel.unknown_template.draft' END AS skill_id,
         CASE WHEN p_type IN ('ECONOMY', 'PROMO', 'STANDARD') THEN 0.98::DOUBLE ELSE 0.35::DOUBLE END AS confidence,
         CASE WHEN p_type IN ('ECONOMY', 'PROMO', 'STANDARD') THEN 'enabled' ELSE 'pending_review' END AS status FROM part""",
)
def route_templates(spark, d):
    from ..functions import fixed_values as V

    def row(items):
        return F.array(*[F.lit(x) for x in items])

    kind = F.col("p_type")
    headers = (
        F.when(kind == "ECONOMY", row(["编号X", "编号名称", "标题", "#", "步骤", "预期结果", "备注1"]))
        .when(kind == "PROMO", row(["用例标题", "编号", "编号名称", "步骤", "预期结果", "#", "P基线"]))
        .when(kind == "STANDARD", row(V.RECORD_SCALARS + V.RECORD_LISTS))
        .otherwise(row(["编号", "标题", "#"]))
    )
    sheets = B.table(spark, d, "part").select(
        F.col("p_partkey").alias("source"), F.lit("excel").alias("file_type"), headers.alias("headers")
    )
    registry = spark.createDataFrame(
        [
            ("lock.v1", "excel", "lock_test_case", "enabled", 1),
            ("lock.v0", "excel", "lock_test_case", "disabled", 0),
            ("grouped.v1", "excel", "grouped_test_case", None, 2),
            ("grouped.v2", "excel", "grouped_test_case", "enabled", 3),
        ],
        "skill_id string, file_type string, template_kind string, status string, position int",
    )
    return X.route_templates(sheets, registry)


@query(
    "bracket_mismatch",
    "SELECT event_id, event_type IN ('click', 'error') AS mismatch FROM events",
)
def bracket_mismatch(spark, d):
    kind = F.col("event_type")
    actions = F.concat(F.lit("[1]"), kind, F.lit("[2]"), F.col("props"))
    signals = F.when(kind == "click", F.lit("[1]a")).otherwise(F.lit("[1]a[2]b"))
    values = F.when(kind == "error", F.lit(None).cast("string")).otherwise(F.lit("[1] 0 [2] 1"))
    return B.table(spark, d, "events").select("event_id", X.bracket_mismatch(actions, signals, values).alias("mismatch"))


def manifest(spark, d):
    """Documents as an image manifest."""
    return B.table(spark, d, "documents").select(
        F.concat(F.lit("IMG_"), F.col("doc_id")).alias("image_id"),
        F.concat("lang", F.lit("_"), F.col("doc_id"), F.lit(".PNG")).alias("file_name"),
        F.col("source").alias("doc_name"), F.lit("d").alias("doc_id"), (F.col("n_chars") > 500).alias("image_exists"),
    )


@query(
    "profile_manifest",
    """SELECT source AS doc_name, count(*) AS image_count,
       CAST(sum(CASE WHEN n_chars > 500 THEN 0 ELSE 1 END) AS BIGINT) AS missing_count FROM documents GROUP BY 1""",
)
def profile_manifest(spark, d):
    return X.profile_manifest(manifest(spark, d))


@query(
    "filter_manifest",
    """SELECT 'IMG_' || doc_id AS image_id FROM documents
       WHERE contains(lower(lang || '_' || doc_id || '.PNG'), 'de_') AND doc_id IN (SELECT doc_id FROM labels)""",
)
def filter_manifest(spark, d):
    with_triples = B.table(spark, d, "labels").select(F.concat(F.lit("IMG_"), F.col("doc_id")).alias("source_image_id"))
    return X.filter_manifest(manifest(spark, d), with_triples, "DE_").select("image_id")


@query(
    "fusion_batches",
    f"""WITH {B.LINES_SQL}, {B.RAW_TRIPLES_SQL}, {FUSED_SQL},
        r AS (SELECT *, row_number() OVER (ORDER BY head, relation, tail, sources) AS rn FROM fused)
        SELECT head, relation, tail, (rn - 1) // 60 + 1 AS batch FROM r""",
)
def fusion_batches(spark, d):
    rows = fused(spark, d).withColumn("sources", F.array_join("sources", ","))
    out = X.batch_no(rows, 60, [F.col(c) for c in (*X.TRIPLE, "sources")])
    return out.select(*X.TRIPLE, "batch")


@query(
    "dedup_first",
    f"""WITH {B.LINES_SQL} SELECT p_name, p_brand, arg_min(l_orderkey, l_orderkey * 1000 + pos) AS l_orderkey,
        min(l_orderkey * 1000 + pos) - arg_min(l_orderkey, l_orderkey * 1000 + pos) * 1000 AS pos FROM lines GROUP BY 1, 2""",
)
def dedup_first(spark, d):
    from ..operators.scale import first_per_key

    rows = B.lines(spark, d).select("p_name", "p_brand", "l_orderkey", "pos")
    return first_per_key(rows, ["p_name", "p_brand"], ["l_orderkey", "pos"])


@query(
    "merge_evidence",
    f"""WITH {B.LINES_SQL} SELECT p_name AS head, 'MADE_BY' AS relation, p_brand AS tail, 'graph' AS source, NULL AS score FROM part
        UNION ALL SELECT p_name, 'SOLD_AS', p_type, 'documents', l_discount FROM lines""",
)
def merge_evidence(spark, d):
    part = B.table(spark, d, "part")
    graph = part.select(F.col("p_name").alias("head"), F.lit("MADE_BY").alias("relation"), F.col("p_brand").alias("tail"))
    docs = B.lines(spark, d).select(
        F.col("p_name").alias("head"), F.lit("SOLD_AS").alias("relation"), F.col("p_type").alias("tail"), F.col("l_discount").alias("score")
    )
    return X.merge_evidence(graph, docs)


@query(
    "edge_list_nodes",
    f"""WITH {B.LINES_SQL}, {B.RAW_TRIPLES_SQL}, e AS (SELECT head, tail FROM raw_triples WHERE coalesce(head, '') <> '' AND coalesce(tail, '') <> '')
        SELECT DISTINCT name FROM (SELECT head AS name FROM e UNION ALL SELECT tail FROM e)""",
)
def edge_list_nodes(spark, d):
    _, nodes = X.edge_list(B.raw_triples(spark, d), order=["head", "relation", "tail", "row_id"])
    return nodes
