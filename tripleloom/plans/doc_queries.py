"""Specification document and review queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import docs as D
from ..operators import review as R
from . import bindings as B
from .registry import Family

FAMILY = Family()
query = FAMILY.query


# ---------------------------------------------------------------- sections
def pages(spark, d):
    """Documents as pages of one specification per source: a headed text and a tiny status section."""
    doc = F.col("doc_id").cast("string")
    text = F.concat(
        F.lit("## "), doc, F.lit(" "), F.col("lang"), F.lit(" overview\n"), F.col("text"), F.lit("\n\n### "), doc, F.lit(".1 state\n  all   ready\n")
    )
    return B.table(spark, d, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("page"), text.alias("text"))


_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)),
  lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), chr(10)), ' +', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""
SECTIONS_SQL = f"""
parts AS (SELECT source, doc_id, lang, {_CLEAN} AS content FROM documents),
sections AS (
  SELECT source AS document_id, CAST(doc_id AS VARCHAR) AS section_id, lang || ' overview' AS title, CAST(1 AS BIGINT) AS level, NULL AS parent,
         doc_id AS page_start, content FROM parts
  UNION ALL SELECT source, doc_id || '.1', 'state', 2, CAST(doc_id AS VARCHAR), doc_id, 'all ready' FROM parts)"""
_FLAG = """CASE WHEN regexp_matches(lower(section_id || ' ' || title), 'tt|warning|chime') OR regexp_matches(lower(content), 'tt|warning|chime')
  THEN true ELSE length(content) >= 240 END"""


@query(
    "split_sections",
    f"WITH {SECTIONS_SQL} SELECT document_id, section_id, title, level, parent, page_start, md5(content) AS content_md5, {_FLAG} AS is_candidate FROM sections",
)
def split_sections(spark, d):
    out = D.split_sections(pages(spark, d))
    return out.select("document_id", "section_id", "title", "level", "parent", "page_start", F.md5("content").alias("content_md5"), "is_candidate")


MERGED_SQL = """
merged AS (
  SELECT source AS document_id, CAST(doc_id AS VARCHAR) AS section_id, lang || ' overview' AS title, doc_id AS page_start,
         content || chr(10) || chr(10) || '## ' || doc_id || '.1 state' || chr(10) || 'all ready' AS content FROM parts)"""


@query("merge_tiny_sections", f"WITH {SECTIONS_SQL}, {MERGED_SQL} SELECT document_id, section_id, md5(content) AS content_md5, {_FLAG} AS is_candidate FROM merged")
def merge_tiny_sections(spark, d):
    out = D.merge_tiny(D.split_sections(pages(spark, d), repair=False))
    return out.select("document_id", "section_id", F.md5("content").alias("content_md5"), "is_candidate")


# ---------------------------------------------------------------- tables
def spec_sections(spark, d):
    """One section per order: a signal table and a requirement table of its lines."""
    li = B.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"
    )
    part = B.table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    # narrow lines move to their order; the text is made there
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "p_brand", "p_type")
    rows = li.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))

    def signal_row(x):
        key = x["l_partkey"].cast("string")
        return F.concat(F.lit("<tr><td>sig"), key, F.lit("</td><td>"), x["p_brand"], F.lit(" &amp; co</td><td>ENC"), x["l_suppkey"].cast("string"), F.lit("</td></tr>"))

    def unit_row(x):
        return F.concat(
            F.lit("<TR><td>"), F.when(x["l_linenumber"] > 4, F.lit("")).otherwise(x["p_brand"]), F.lit("</td><td>when sig"), x["l_partkey"].cast("string"),
            F.lit(" is <b>"), x["l_returnflag"], F.lit("</b></td><td>"), F.when(x["l_linestatus"] == "O", F.lit("-")).otherwise(F.lit("lamp on")),
            F.lit("</td><td>"), x["p_type"], F.lit("</td></tr>"),
        )

    rows = rows.select("l_orderkey", *[F.array_join(F.transform("lines", row), "\n").alias(c) for c, row in (("s", signal_row), ("u", unit_row))])
    orders = B.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    joined = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    content = F.concat(
        F.lit("intro\n<table border=1><tr><th>Signal Name</th><th>发送方</th><th>信号编码</th></tr>\n"), F.col("s"),
        F.lit("</table>\ntext\n<TABLE><tr><th>前提条件</th><th>触发条件</th><th>HMI</th><th>备注</th></tr>\n"), F.col("u"), F.lit("</table>"),
    )
    return joined.select(
        F.concat(F.lit("C"), F.col("o_custkey")).alias("document_id"), F.col("o_orderkey").cast("string").alias("section_id"),
        F.concat(F.lit("1.2 function "), F.col("o_orderkey")).alias("section_title"), F.col("o_orderkey").alias("page_start"),
        F.col("o_orderkey").alias("page_end"), content.alias("content"),
    )


KEYS = ["document_id", "section_id", "section_title", "page_start", "page_end"]
SPEC_SQL = (
    B.LINES_SQL
    + """,
spec AS (SELECT 'C' || o_custkey AS document_id, CAST(o_orderkey AS VARCHAR) AS section_id, l.*, l_linenumber > 4 AS blank
  FROM lines l JOIN orders ON l_orderkey = o_orderkey)"""
)


def spec_tables(spark, d):
    return D.extract_tables(spec_sections(spark, d), KEYS)


@query(
    "extract_tables",
    f"""WITH {SPEC_SQL} SELECT document_id, section_id, CAST(table_no AS BIGINT) AS table_no, row_no, cells FROM (
          SELECT document_id, section_id, 1 AS table_no, pos + 1 AS row_no, 'sig' || l_partkey || '|' || p_brand || ' & co|ENC' || l_suppkey AS cells FROM spec
          UNION ALL SELECT document_id, section_id, 2, pos + 1, CASE WHEN blank THEN '' ELSE p_brand END || '|when sig' || l_partkey || ' is ' || l_returnflag || '|'
            || CASE WHEN l_linestatus = 'O' THEN '-' ELSE 'lamp on' END || '|' || p_type FROM spec
          UNION ALL SELECT DISTINCT document_id, section_id, 1, 1, 'Signal Name|发送方|信号编码' FROM spec
          UNION ALL SELECT DISTINCT document_id, section_id, 2, 1, '前提条件|触发条件|HMI|备注' FROM spec)""",
)
def extract_tables(spark, d):
    out = spec_tables(spark, d)
    return out.select("document_id", "section_id", "table_no", "row_no", F.array_join("cells", "|").alias("cells"))


@query(
    "signals",
    f"""WITH {SPEC_SQL} SELECT document_id, 'sig_' || section_id || '_1_' || pos AS signal_id, 'sig' || l_partkey AS name, p_brand || ' & co' AS sender,
          '' AS receiver, 'ENC' || l_suppkey AS encoding, 'sig' || l_partkey AS raw_name FROM spec""",
)
def signals(spark, d):
    out = D.signals(spec_tables(spark, d))
    return out.select("document_id", "signal_id", "name", "sender", "receiver", "encoding", F.col("raw")["Signal Name"].alias("raw_name"))


UNITS_SQL = """
carried AS (SELECT *, last_value(CASE WHEN NOT blank THEN p_brand END IGNORE NULLS) OVER (PARTITION BY section_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS pre FROM spec),
hmi AS (SELECT *, 'when sig' || l_partkey || ' is ' || l_returnflag AS triggers, CASE WHEN l_linestatus = 'O' THEN '' ELSE 'lamp on' END AS hmi_display FROM carried),
units AS (SELECT document_id, section_id, pos, 'ru_' || section_id || '_t2_r' || pos AS unit_id, coalesce(pre, '') AS preconditions, triggers, hmi_display, p_type AS remarks,
  'function ' || section_id AS function FROM hmi)"""


def units(spark, d):
    return D.requirement_units(spec_tables(spark, d))


@query("requirement_units", f"WITH {SPEC_SQL}, {UNITS_SQL} SELECT document_id, unit_id, function, preconditions, triggers, hmi_display, remarks FROM units")
def requirement_units(spark, d):
    out = units(spark, d)
    return out.select(
        "document_id", "unit_id", "function", "preconditions", "triggers", "hmi_display", "remarks"
    )


DEDUP_SQL = """
dedup AS (SELECT * FROM units QUALIFY row_number() OVER (PARTITION BY section_id, preconditions, triggers, hmi_display ORDER BY pos) = 1)"""


@query("dedup_units", f"WITH {SPEC_SQL}, {UNITS_SQL}, {DEDUP_SQL} SELECT document_id, unit_id FROM dedup")
def dedup_units(spark, d):
    return D.dedup_units(units(spark, d)).select("document_id", "unit_id")


@query(
    "text_units",
    r"""WITH t AS (SELECT source, doc_id, lang, regexp_replace(regexp_replace(text, ' +', ' ', 'g'), '^\s+|\s+$', '', 'g') AS c FROM documents)
        SELECT source AS document_id, 'ru_' || doc_id || '_text' AS unit_id, md5(c) AS expected_md5 FROM t
        WHERE length(c) >= 120 AND lang <> 'fr' AND lang <> 'es' AND (lang = 'de' OR regexp_matches(lower(c), 'tt|warning|chime'))""",
)
def text_units(spark, d):
    sections = B.table(spark, d, "documents").select(
        F.col("source").alias("document_id"), F.col("doc_id").cast("string").alias("section_id"), F.lit("part").alias("title"),
        F.col("text").alias("content"), (F.col("lang") == "de").alias("is_candidate"), F.col("doc_id").alias("page_start"), F.col("doc_id").alias("page_end"), "lang",
    )
    have = sections.where(F.col("lang") == "fr")
    tables = sections.where(F.col("lang") == "es")
    out = D.text_units(sections, have, tables)
    return out.select("document_id", "unit_id", F.md5("expected_results").alias("expected_md5"))


MATCH_SQL = """
sigs AS (SELECT document_id, 'sig_' || section_id || '_1_' || pos AS signal_id, section_id AS sid, pos AS spos, 'sig' || l_partkey AS name, 'ENC' || l_suppkey AS encoding FROM spec),
matched AS (
  SELECT u.document_id, unit_id, signal_id, name, row_number() OVER (PARTITION BY u.document_id, unit_id ORDER BY sid, spos, signal_id) AS rank
  FROM units u JOIN sigs s ON u.document_id = s.document_id
   AND (contains(concat_ws(' ', unit_id, section_id, '1.2 function ' || section_id, function, preconditions, triggers, hmi_display, remarks), name)
     OR contains(concat_ws(' ', unit_id, section_id, '1.2 function ' || section_id, function, preconditions, triggers, hmi_display, remarks), encoding)) QUALIFY rank <= 12)"""


@query("match_signals", f"WITH {SPEC_SQL}, {UNITS_SQL}, {MATCH_SQL} SELECT document_id, unit_id, signal_id, name, rank FROM matched")
def match_signals(spark, d):
    tables = D.by_section(spec_tables(spark, d), KEYS)
    out = D.match_signals(D.requirement_units(tables, placed=True), D.signals(tables, placed=True), 12)
    return out.select("document_id", "unit_id", "signal_id", "name", "rank")


@query(
    "unit_coverage",
    f"""WITH {SPEC_SQL}, {UNITS_SQL}, {MATCH_SQL}, m AS (SELECT DISTINCT document_id, unit_id FROM matched)
        SELECT u.document_id, u.unit_id, u.function, true AS must_cover, array_to_string(list_filter(['Positive function',
          CASE WHEN preconditions <> '' THEN 'Precondition not satisfied' END, CASE WHEN hmi_display <> '' THEN 'HMI display consistency' END,
          CASE WHEN m.unit_id IS NOT NULL THEN 'Signal/service interface' END], lambda x: x IS NOT NULL), '|') AS test_intents
        FROM units u LEFT JOIN m ON m.document_id = u.document_id AND m.unit_id = u.unit_id""",
)
def unit_coverage(spark, d):
    from ..session import materialise

    tables = D.by_section(spec_tables(spark, d), KEYS)
    found = materialise(D.requirement_units(tables, placed=True))
    out = D.coverage(D.with_intents(found, D.match_signals(found, D.signals(tables, placed=True), 12)))
    return out.select("document_id", "unit_id", "function", "must_cover", F.array_join("test_intents", "|").alias("test_intents"))


# ---------------------------------------------------------------- topics
TOPICS = [
    ("connectives", "Connecting words", ["that", "with ", "und"]),
    ("articles", "Articles", ["the ", "der ", "le ", "el "]),
    ("endings", "Endings", ["tion", "heit"]),
]


def _topic_sql(text: str) -> str:
    score = {
        tid: " + ".join(f"(length({text}) - length(replace({text}, '{w.lower()}', ''))) // {len(w)}" for w in words) for tid, _, words in TOPICS
    }
    return ", ".join(f"{s} AS s_{tid}" for tid, s in score.items())


TOPIC_SQL = f"""
t AS (SELECT source AS document_id, doc_id, lang, text, lower(lang || chr(10) || text) AS low FROM documents),
s AS (SELECT *, {_topic_sql('low')} FROM t),
topics AS (SELECT *, CASE WHEN greatest(s_connectives, s_articles, s_endings) = 0 THEN 'general'
    WHEN s_articles = greatest(s_connectives, s_articles, s_endings) THEN 'articles'
    WHEN s_connectives = greatest(s_connectives, s_articles, s_endings) THEN 'connectives' ELSE 'endings' END AS topic_id FROM s)"""


def topic_docs(spark, d):
    docs = B.table(spark, d, "documents")
    return docs.select(
        F.col("source").alias("document_id"), F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("section_id"), F.lit(None).cast("string").alias("section_title"),
        F.col("lang").alias("title"), F.col("text").alias("content"), F.col("text").alias("content_preview"), F.col("doc_id").alias("page_start"),
        F.col("doc_id").alias("page_end"), F.array(F.lit("Positive function"), F.concat(F.lit("lang "), F.col("lang"))).alias("test_intents"),
        F.when(F.col("n_chars") > 5000, "high").otherwise("low").alias("source_quality"),
    )


@query("classify_topic", f"WITH {TOPIC_SQL} SELECT doc_id, topic_id FROM topics")
def classify_topic(spark, d):
    out = D.topic_items(topic_docs(spark, d), by_unit=False, rules=TOPICS)
    return out.select(F.col("seq").alias("doc_id"), "topic_id")


KEYWORD_SQL = """
words AS (SELECT document_id, topic_id, unnest(regexp_extract_all(lang || ' ' || text, '[A-Za-z][A-Za-z0-9_.-]{2,}')) AS word FROM topics),
counted AS (SELECT document_id, topic_id, word, count(*) AS n FROM words GROUP BY 1, 2, 3),
keywords AS (SELECT *, row_number() OVER (PARTITION BY document_id, topic_id ORDER BY n DESC, word) AS rank FROM counted QUALIFY rank <= 10)"""


@query("top_keywords", f"WITH {TOPIC_SQL}, {KEYWORD_SQL} SELECT document_id, topic_id, word, n, rank FROM keywords")
def top_keywords(spark, d):
    items = D.topic_items(topic_docs(spark, d), by_unit=False, rules=TOPICS).withColumn("w", F.concat_ws(" ", "title", "content"))
    return D.top_keywords(items, ["document_id", "topic_id"], "w")


CLUSTER_SQL = """
c AS (SELECT document_id, topic_id, min(doc_id) AS f, count(*) AS section_count, max(doc_id) AS page_end, bool_or(length(text) > 5000) AS high FROM topics GROUP BY 1, 2),
x AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY f) AS i FROM c),
heads AS (SELECT document_id, topic_id, doc_id, lang, row_number() OVER (PARTITION BY document_id, topic_id ORDER BY doc_id) AS rn FROM topics),
intents AS (SELECT document_id, topic_id, lang, min(doc_id) AS f FROM topics GROUP BY 1, 2, 3)"""


@query(
    "topic_clusters",
    f"""WITH {TOPIC_SQL}, {KEYWORD_SQL}, {CLUSTER_SQL}
        SELECT x.document_id, 'topic_' || lpad(CAST(i AS VARCHAR), 2, '0') || '_' || x.topic_id AS cluster_id, section_count, f AS page_start, page_end,
          (SELECT string_agg(doc_id || ' ' || lang, '；' ORDER BY rn) FROM heads h WHERE h.document_id = x.document_id AND h.topic_id = x.topic_id AND rn <= 5) AS summary,
          (SELECT string_agg(word, ' ' ORDER BY rank) FROM keywords k WHERE k.document_id = x.document_id AND k.topic_id = x.topic_id) AS keywords,
          'Positive function|' || (SELECT string_agg('lang ' || lang, '|' ORDER BY n.f) FROM intents n WHERE n.document_id = x.document_id AND n.topic_id = x.topic_id) AS test_intents,
          CASE WHEN high THEN 'high' ELSE 'low' END AS source_quality FROM x""",
)
def topic_clusters(spark, d):
    out = D.topic_clusters(topic_docs(spark, d), by_unit=False, rules=TOPICS)
    return out.select(
        "document_id", "cluster_id", "section_count", "page_start", "page_end", "summary", F.array_join("keywords", " ").alias("keywords"),
        F.array_join("test_intents", "|").alias("test_intents"), "source_quality",
    )


@query(
    "section_refs",
    """SELECT d.source AS document_id, d.lang AS section_id, coalesce(n.n_name, arg_max(CAST(d.doc_id AS VARCHAR), d.doc_id)) AS title,
         coalesce(max(n.n_regionkey), max(d.doc_id)) AS page_start FROM documents d LEFT JOIN nation n ON d.source = 'src' || n.n_nationkey AND d.lang = 'en' GROUP BY 1, 2, n.n_name""",
)
def section_refs(spark, d):
    items = topic_docs(spark, d).withColumn("section_id", F.col("title")).withColumn("title", F.col("seq").cast("string")).withColumn(
        "page_start", F.when(F.col("section_id") != "en", F.col("seq"))
    )
    # the nations describe the English sections of the sources of their number
    sections = B.table(spark, d, "nation").select(
        F.concat(F.lit("src"), F.col("n_nationkey")).alias("document_id"), F.lit("en").alias("section_id"), F.col("n_name").alias("title"), F.col("n_regionkey").cast("long").alias("page_start"),
        F.col("n_regionkey").cast("long").alias("page_end"), F.lit("p").alias("content_preview"),
    )
    return D.section_refs(items, sections, ["document_id"]).select("document_id", "section_id", "title", "page_start")


@query(
    "generation_plan",
    f"""WITH {SPEC_SQL}, {UNITS_SQL}, {MATCH_SQL},
      r AS (SELECT *, row_number() OVER (PARTITION BY document_id, section_id ORDER BY pos) AS rn FROM units),
      g AS (SELECT document_id, section_id, CAST(section_id AS BIGINT) AS page, least(max(rn), 6) AS n FROM r GROUP BY 1, 2, 3),
      o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY document_id ORDER BY page, section_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
      SELECT r.document_id, r.unit_id, CAST(before + rn AS BIGINT) AS place,
        md5('Requirement unit ID: ' || r.unit_id || chr(10) || 'Section: ' || r.section_id || ' 1.2 function ' || r.section_id || chr(10) || 'Topic: unit topic' || chr(10) ||
          'Coverage intents: Positive function' || CASE WHEN preconditions <> '' THEN ', Precondition not satisfied' ELSE '' END ||
          CASE WHEN hmi_display <> '' THEN ', HMI display consistency' ELSE '' END || chr(10) || 'Test case name: Verify ' || function || chr(10) ||
          'Preconditions: ' || CASE WHEN preconditions = '' THEN 'Not specified' ELSE preconditions END || chr(10) || 'Execution steps: ' || triggers || chr(10) ||
          'Expected behavior: ' || CASE WHEN hmi_display = '' THEN 'Not specified' ELSE hmi_display END || chr(10) || 'Related signals/interfaces: Not specified' || chr(10) ||
          'Pass/fail criteria: Actual results must match expected behavior; confirm against original STS where fields are not specified.') AS draft_md5
      FROM r JOIN o ON o.document_id = r.document_id AND o.section_id = r.section_id WHERE rn <= 6 AND before + rn <= 30""",
)
def generation_plan(spark, d):
    from ..session import materialise

    planned = D.with_intents(units(spark, d)).withColumns(
        {
            "group_id": F.col("section_id"), "seq": F.col("row_index"),
            "related_signals": F.array().cast("array<struct<rank:bigint,name:string,signal_id:string>>"),
        }
    )
    planned = materialise(planned)
    clusters = planned.groupBy("document_id", "group_id").agg(F.min("page_start").alias("page_start")).withColumns(
        {"cluster_id": F.col("group_id"), "topic": F.lit("unit topic")}
    )
    out = D.generation_plan(planned, clusters, budget=30, per_cluster=6, max_signals=8)
    return out.select("document_id", "unit_id", "place", F.md5("draft").alias("draft_md5"))


# ---------------------------------------------------------------- review and registry
@query(
    "apply_reviews",
    """WITH c AS (SELECT DISTINCT user_id AS case_id FROM events), e AS (
         SELECT user_id AS case_id, CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected' END AS decision, props AS reviewer, ts AS review_time,
                row_number() OVER (PARTITION BY user_id ORDER BY ts, props, event_type DESC) AS rn FROM events WHERE event_type IN ('purchase', 'error'))
       SELECT c.case_id, coalesce(decision, 'pending_review') AS status, reviewer, epoch_us(review_time) AS review_us FROM c LEFT JOIN e ON e.case_id = c.case_id AND rn = 1""",
)
def apply_reviews(spark, d):
    events = B.table(spark, d, "events")
    pending = events.select(F.col("user_id").alias("case_id")).distinct()
    decisions = events.select(
        F.col("user_id").alias("case_id"),
        F.when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "error", "rejected").otherwise("viewed").alias("decision"),
        F.col("props").alias("reviewer"), F.lit("").alias("comment"), F.col("ts").alias("review_time"),
    )
    out = R.apply_reviews(pending, decisions)
    return out.select("case_id", "status", "reviewer", F.unix_micros(F.col("review_time").cast("timestamp")).alias("review_us"))


@query(
    "upsert_documents",
    """SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
       UNION ALL SELECT o_custkey, 'updated', max(o_totalprice) FROM orders GROUP BY 1""",
)
def upsert_documents(spark, d):
    customer = B.table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = B.table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("c_acctbal"))
    return R.upsert(customer, new.select(F.col("o_custkey").alias("c_custkey"), F.lit("updated").alias("c_name"), "c_acctbal"), ["c_custkey"])


@query(
    "registry_events",
    """WITH e AS (SELECT user_id AS source_id, event_id AS seq, CASE WHEN value > 250 THEN 'purge' WHEN event_type IN ('error', 'view') THEN 'delete' ELSE 'restore' END AS action FROM events),
         m AS (SELECT *, last_value(CASE WHEN action <> 'purge' THEN action END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS mv FROM e),
         f AS (SELECT source_id, bool_or(action = 'purge' AND coalesce(mv, '') = 'delete') AS gone, arg_max(mv, seq) FILTER (WHERE action <> 'purge') AS last FROM m GROUP BY 1)
       SELECT source_id, CASE last WHEN 'delete' THEN 'trash' ELSE 'active' END AS state FROM f WHERE NOT gone""",
)
def registry_events(spark, d):
    events = B.table(spark, d, "events")
    action = F.when(F.col("value") > 250, "purge").when(F.col("event_type").isin("error", "view"), "delete").otherwise("restore")
    log = events.select(F.col("user_id").alias("source_id"), F.col("event_id").alias("seq"), action.alias("action"))
    registry = events.select(F.col("user_id").alias("source_id"), F.lit("active").alias("state")).distinct()
    return R.apply_registry_events(registry, log)


@query(
    "submit_import",
    """WITH reg AS (SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN 'available' ELSE 'pending_review' END AS status, s_name, s_nationkey FROM supplier),
         req AS (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING avg(l_quantity) > 25.5)
       SELECT 'S' || s_suppkey AS source_id, s_name AS name, status, CAST(s_nationkey AS BIGINT) AS case_count, NULL AS from_source_id FROM reg
       WHERE status = 'available' OR s_suppkey NOT IN (SELECT l_suppkey FROM req)
       UNION ALL SELECT CASE WHEN status = 'available' THEN 'build-' || s_suppkey ELSE 'S' || s_suppkey END, s_name, 'pending_review', s_nationkey,
         CASE WHEN status = 'available' THEN 'S' || s_suppkey END FROM reg JOIN req ON s_suppkey = l_suppkey""",
)
def submit_import(spark, d):
    registry = B.table(spark, d, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("source_id"), F.col("s_name").alias("name"), F.lit("d").alias("domain"), F.lit("pdf").alias("kind"),
        F.when(F.col("s_acctbal") > 5000, "available").otherwise("pending_review").alias("status"), F.col("s_nationkey").cast("long").alias("case_count"),
        (F.col("s_nationkey") * 3).cast("long").alias("triple_count"), F.lit(None).cast("string").alias("from_source_id"),
    )
    asked = B.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("size")).where("size > 25.5")
    requests = asked.select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("source_id"), F.concat(F.lit("build-"), F.col("l_suppkey")).alias("pending_id"), F.lit("").alias("name"),
        F.lit("").alias("domain"), F.lit("excel").alias("kind"), F.lit(0).cast("long").alias("case_count"), F.lit(None).cast("long").alias("triple_count"),
    )
    return R.submit_import(registry, requests).select("source_id", "name", "status", "case_count", "from_source_id")
