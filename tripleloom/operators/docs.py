"""Specification documents: sections, tables, signals, requirement units, topics, plans."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed_values as V
from ..functions import text as T
from ..session import materialise
from .rules import contains_join
from .scale import carry_last, computed_once, first_per_key, numbered, top_k_per_key

LINE_BREAK = r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
UNIT_FIELDS = list(V.FIELD_KEYS)
EVIDENCE_FIELDS = ["preconditions", "triggers", "actions", "expected_results", "hmi_display", "status_feedback"]


def _matches(c: Column, pattern: str) -> Column:
    return c.rlike(f"(?iu){pattern}")


# ---------------------------------------------------------------- sections
def clean_content(c: Column) -> Column:
    text = F.regexp_replace(c, "[ \t\r\f\u000b　]+", " ")
    return T.strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def is_candidate(section_id: Column, title: Column, content: Column) -> Column:
    """Sections worth structuring: telling words, or enough text without a low-value title."""
    heading = F.concat_ws(" ", section_id, title)
    high = _matches(heading, V.HIGH_VALUE_SECTIONS) | _matches(content, V.HIGH_VALUE_SECTIONS)
    low = _matches(heading, V.LOW_VALUE_SECTIONS) & (F.char_length(content) < 1800)
    return F.when(high, F.lit(True)).when(low, F.lit(False)).otherwise(F.char_length(content) >= 240)


def split_sections(pages: DataFrame, repair: bool = True) -> DataFrame:
    """Numbered sections of markdown pages (document_id, page, text), ``seq`` in document order."""
    text = T.repair_text(F.coalesce("text", F.lit(""))) if repair else F.coalesce("text", F.lit(""))
    source = pages.select("document_id", F.coalesce("page", F.lit(1)).cast("long").alias("page"), text.alias("text"))
    if repair:
        source = materialise(source)  # read three times below: repaired once
    raw = source.select("document_id", "page", F.posexplode(F.split("text", LINE_BREAK)).alias("pos", "raw"))
    lines = raw.select("document_id", "page", "pos", T.strip("raw").alias("line"))
    header = r"(?U)" + V.SECTION_HEADER
    is_header = F.col("line").rlike(header)
    start = F.when(
        is_header,
        F.struct(
            "page", "pos", F.regexp_extract("line", header, 1).alias("section_id"), F.regexp_extract("line", header, 2).alias("title")
        ),
    )
    marked = carry_last(
        lines.withColumn("start", start).withColumn("is_header", is_header), ["document_id"], [F.col("page"), F.col("pos")], ["start"]
    )
    intro = F.struct(F.lit(0).cast("long").alias("page"), F.lit(-1).alias("pos"), F.lit("intro").alias("section_id"), F.lit("Document introduction").alias("title"))
    body = marked.withColumn("start", F.coalesce("start", intro)).where(~((F.col("start.pos") == -1) & (F.col("line") == "")))
    ordered = F.array_sort(F.collect_list(F.when(~F.col("is_header"), F.struct("page", "pos", "line"))))
    sections = body.groupBy("document_id", "start").agg(ordered.alias("_lines"))
    content = clean_content(F.array_join(F.transform("_lines", lambda x: x["line"]), "\n"))
    title = T.compact_text(T.strip(F.col("start.title")))
    base = sections.select(
        "document_id", F.struct(F.col("start.page"), F.col("start.pos")).alias("seq"), F.col("start.section_id").alias("section_id"),
        title.alias("title"), content.alias("content"),
    )
    number = r"(?U)(?:^|\n)\s*#+\s*(\d+)(?=\.|\s)"
    firsts = (
        source.select("document_id", "page", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(number), F.lit(1)))).alias("_top"))
        .groupBy("document_id", "_top")
        .agg(F.min("page").alias("_page"))
    )
    placed = base.withColumn("_top", F.substring_index("section_id", ".", 1)).join(firsts, ["document_id", "_top"], "left")
    is_intro = F.col("section_id") == "intro"
    page = F.when(is_intro, F.lit(1).cast("long")).otherwise(F.col("_page"))
    depth = F.length("section_id") - F.length(F.replace("section_id", F.lit("."), F.lit("")))
    parent = F.regexp_extract("section_id", r"^(.*)\.[^.]*$", 1)
    out = placed.select(
        "document_id", "seq", "section_id", "title",
        F.when(is_intro, F.lit(1)).otherwise(depth + 1).cast("long").alias("level"),
        F.when(parent != "", parent).alias("parent"), page.alias("page_start"), page.alias("page_end"), "content",
    )
    return _with_flags(out.where((F.col("content") != "") | (F.col("title") != "")))


def _with_flags(sections: DataFrame) -> DataFrame:
    return sections.withColumns(
        {
            "is_candidate": is_candidate(F.col("section_id"), F.col("title"), F.col("content")),
            "content_preview": F.substring(T.compact_text("content"), 1, 260),
        }
    )


def merge_tiny(sections: DataFrame, short: int = 40) -> DataFrame:
    """Merge short sections into the section before them when they are deeper than it.

    A short section starts its own group only if no section since the last long one
    is less deep, so the decision is a running minimum of levels.
    """
    order = [F.col("seq")]
    long_ = F.char_length("content") >= short
    runs = carry_last(sections.withColumn("_run", F.when(long_, F.col("seq"))), ["document_id"], order, ["_run"])
    before = Window.partitionBy("document_id", "_run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    floor = F.min("level").over(before)
    own = (F.char_length("content") >= short) | floor.isNull() | (F.col("level") <= floor)
    heads = carry_last(runs.withColumn("_head", F.when(own, F.col("seq"))), ["document_id"], order, ["_head"])
    heading = F.concat(F.lit("\n\n## "), F.concat_ws(" ", "section_id", "title"), F.lit("\n"), F.col("content"))
    piece = F.when(F.col("seq") == F.col("_head"), F.col("content")).otherwise(heading)
    merged = heads.withColumn("_piece", F.struct("seq", piece.alias("t"))).groupBy("document_id", F.col("_head").alias("seq")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("_piece")), lambda x: x["t"]), "").alias("content"),
        F.min_by(F.struct("section_id", "title", "level", "parent", "page_start", "page_end"), "seq").alias("_s"),
    )
    return _with_flags(
        merged.select(
            "document_id", "seq", "_s.section_id", "_s.title", "_s.level", "_s.parent", "_s.page_start", "_s.page_end", "content"
        )
    )


# ---------------------------------------------------------------- tables
def extract_tables(df: DataFrame, keys: Sequence[str], html: str = "content") -> DataFrame:
    """Rows of the HTML tables of each text: keys, table_no, row_no, cells.

    A text with a closed table yields its closed tables, with the character data of
    their cells; only a text without any yields the tables that are cut off.
    """
    closed = F.col(html).rlike("(?i)</table")
    tables = F.when(closed, F.regexp_extract_all(html, F.lit(r"(?is)<table.*?</table>"), F.lit(0))).otherwise(
        F.regexp_extract_all(html, F.lit(r"(?is)<table.*\z"), F.lit(0))
    )

    def cut(row: Column) -> Column:
        ends = F.regexp_extract_all(row, F.lit(r"(?is)<t[dh][^>]*>(.*?)(?=</t[dh]\s*>|<t[dh][^>]*>|</tr>|\z)"), F.lit(1))
        open_ = F.regexp_extract_all(row, F.lit(r"(?is)<t[dh][^>]*>(.*?)(?=<t[dh][^>]*>|</tr>|\z)"), F.lit(1))
        return F.when(F.col("_closed"), F.transform(ends, lambda c: F.when(c.contains("<"), F.regexp_replace(c, r"<[^>]+>", "")).otherwise(c))).otherwise(
            F.transform(open_, lambda c: F.regexp_replace(c, r"(?i)<?/t[dh]>\s*\z", ""))
        )

    def tidy(c: Column) -> Column:
        # most cells hold nothing that has to go
        return F.when(c.rlike(f"[<{T.WHITE.replace(' ', '')}]|  |^ | $"), T.compact_text(c, unescape=False)).otherwise(c)

    # a text's tables stay in its row until they are numbered, nothing moves
    rows = F.lit(r"(?is)<tr.*?(?:</tr>|\z)")
    raw = df.where(F.col(html).rlike("(?i)<table")).select(
        *keys, F.col(html).rlike(T.OTHER_REFERENCE).alias("_marked"), F.col(html).contains("&").alias("_plain"), closed.alias("_closed"), tables.alias("_tables")
    )
    raw = raw.withColumn("_cut", F.transform("_tables", lambda t: F.transform(F.regexp_extract_all(t, rows, F.lit(0)), cut)))
    raw = computed_once(raw.drop("_tables"))
    # texts with the usual references alone are resolved here, the others in Python
    usual = F.when(F.col("_plain"), F.transform("_cut", lambda t: F.transform(t, lambda r: F.transform(r, T.resolve_usual)))).otherwise(F.col("_cut"))
    read = raw.withColumn("_cut", F.coalesce(T.unescape_cells(F.when(F.col("_marked"), F.col("_cut"))), usual))
    clean = F.transform("_cut", lambda t: F.filter(F.transform(t, lambda r: F.transform(r, tidy)), lambda r: F.exists(r, lambda c: c != "")))
    numbered_tables = read.select(*keys, F.posexplode(F.filter(clean, lambda t: F.size(t) > 0)).alias("_t", "_rows"))
    out = numbered_tables.select(*keys, (F.col("_t") + 1).cast("long").alias("table_no"), F.posexplode("_rows").alias("_r", "cells"))
    return out.select(*keys, "table_no", (F.col("_r") + 1).cast("long").alias("row_no"), "cells")


def by_section(tables: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Table rows written by section, so that nothing that follows within a table moves them."""
    by = [c for c in ("document_id", "section_id") if c in keys] or list(keys)
    return materialise(tables.repartition(*by), by)


def _with_heads(tables: DataFrame, keys: Sequence[str], where: Column, head: dict[str, Column]) -> DataFrame:
    """Rows (row_no, cells) of the tables for which ``where`` holds, with the ``head`` columns of their table.

    Both may use _row1 to _row4 and _rows.  A table is one row until its head is made, as it was when it was read.
    """
    whole = tables.groupBy(*keys, "table_no").agg(F.array_sort(F.collect_list(F.struct("row_no", "cells"))).alias("_all"))
    firsts = {f"_row{n}": F.get(F.filter("_all", _is_row(n)), 0)["cells"] for n in (1, 2, 3, 4)}
    headed = computed_once(whole.withColumns({**firsts, "_rows": F.element_at("_all", -1)["row_no"]})).where(where)
    known = computed_once(headed.select(*keys, "table_no", "_all", *[c.alias(n) for n, c in head.items()]))
    return known.withColumn("_r", F.explode("_all")).select(*keys, "table_no", "_r.row_no", "_r.cells", *head)


def _text_of_rows(n: int) -> Column:
    return F.lower(F.array_join(F.flatten(F.array(*[F.coalesce(f"_row{i}", F.array()) for i in range(1, n + 1)])), " "))


def _is_row(n: int):
    return lambda r: r["row_no"] == n


def _headers(cells: Column) -> Column:
    return F.transform(cells, lambda c, i: F.when(c != "", c).otherwise(F.concat(F.lit("col_"), (i + 1).cast("string"))))


def _entries(header: Column, cells: Column) -> Column:
    """(key, value) of a row; a repeated header keeps its last cell."""
    pairs = F.transform(
        cells,
        lambda c, i: F.struct(
            F.coalesce(F.get(header, i), F.concat(F.lit("col_"), (i + 1).cast("string"))).alias("key"), c.alias("value")
        ),
    )
    return T.let(
        pairs,
        lambda p: F.filter(
            p, lambda e, i: ~F.exists(F.slice(p, i + 2, F.size(p)), lambda later: later["key"] == e["key"])
        ),
    )


def signals(tables: DataFrame, keys: Sequence[str] = ("document_id", "section_id", "section_title"), placed: bool = False) -> DataFrame:
    """Signals of the signal tables: name, sender, receiver, communication, encoding, raw row; ``placed``: they come from ``by_section``."""
    keys = list(keys)
    tables = tables if placed else by_section(tables, keys)
    is_signal = T.let(_text_of_rows(3), lambda t: sum((t.contains(k.lower()).cast("int") for k in V.SIGNAL_KEYS), F.lit(0)) >= 2)
    wanted = {
        "_name": V.SIGNAL_NAME_KEYS, "sender": ["发送方", "发送"], "receiver": ["接收方", "接收"],
        "communication": ["通信方式", "通讯方式"], "encoding": V.SIGNAL_ENCODING_KEYS,
    }
    header = _headers(F.col("_row1"))
    rows = _with_heads(tables, keys, is_signal, {"_h": header, **{c: T.let(header, _columns_of(names)) for c, names in wanted.items()}}).where(F.col("row_no") > 1)
    rows = rows.withColumn("name", F.coalesce(_first_cell("_name"), F.get("cells", 0)))
    return rows.where(F.col("name") != "").select(
        *keys,
        F.concat(F.lit("sig_"), F.concat_ws("_", F.coalesce("section_id", F.lit("sec")), F.col("table_no").cast("string"), (F.col("row_no") - 1).cast("string"))).alias("signal_id"),
        "table_no", (F.col("row_no") - 1).alias("row_index"), "name",
        *[F.coalesce(_first_cell(c), F.lit("")).alias(c) for c in wanted if c != "_name"],
        F.map_from_entries(_entries(F.col("_h"), F.col("cells"))).alias("raw"),
    )


def _columns_of(names: Sequence[str]):
    """The places of each of the names that a header has."""

    def places(header: Column) -> Column:
        each = [F.filter(F.transform(header, _place_if(n)), lambda p: p.isNotNull()) for n in names]
        return F.filter(F.array(*each), lambda ps: F.size(ps) > 0)

    return places


def _place_if(name: str):
    return lambda h, i: F.when(h == name, i)


def _first_cell(columns: str) -> Column:
    """The first cell that is not blank, by name; of a repeated name the last cell counts."""
    cells = F.transform(columns, lambda ps: F.get("cells", F.try_element_at(F.filter(ps, lambda p: p < F.size("cells")), F.lit(-1))))
    return F.get(F.filter(cells, lambda c: c != ""), 0)


def field_for_key(key: Column) -> Column:
    """Requirement field of a column header, first field with a matching word."""
    lowered = F.lower(key)
    out = F.lit(None).cast("string")
    for field, words in reversed(list(V.FIELD_KEYS.items())):
        hit = F.lit(False)
        for w in words:
            hit = hit | lowered.contains(w.lower())
        out = F.when(hit, F.lit(field)).otherwise(out)
    return out


def _append_all(values: Column) -> Column:
    """Join values with ``; ``, leaving out what is already part of the text."""
    return F.aggregate(
        values, F.lit(""),
        lambda acc, x: F.when(acc == "", x).when(acc.contains(x), acc).otherwise(F.concat(acc, F.lit("; "), x)),
    )


def requirement_units(tables: DataFrame, keys: Sequence[str] = ("document_id", "section_id", "section_title", "page_start", "page_end"), placed: bool = False) -> DataFrame:
    """Requirement units of the tables: one per data row, or one per vertical (label, value) table; ``placed``: they come from ``by_section``."""
    keys = list(keys)
    table_key = [*keys, "table_no"]
    vertical = (F.col("_rows") >= 3) & (F.size("_row1") >= 2) & F.get("_row1", 0).isin(V.VERTICAL_HEADERS)
    second = F.exists("_row2", lambda c: field_for_key(c).isin("expected_results", "hmi_display", "status_feedback"))
    multi = (F.col("_rows") >= 3) & F.array_contains("_row1", "执行结果") & second
    at = F.array_position("_row1", "执行结果").cast("int")
    trailing = F.greatest(F.lit(0), F.size("_row3") - (at - 1) - F.size("_row2"))
    joined = F.concat(
        F.slice("_row1", F.lit(1), at - 1), F.col("_row2"),
        F.when(trailing > 0, F.slice("_row1", F.greatest(F.size("_row1") - trailing + 1, F.lit(1)), trailing)).otherwise(F.array()),
    )
    header = F.when(multi, F.slice(joined, F.lit(1), F.size("_row3"))).otherwise(_headers(F.col("_row1")))
    said = "|".join(re.escape(w.lower()) for words in V.FIELD_KEYS.values() for w in words)
    has_field = _text_of_rows(4).rlike(said)
    told = (F.col("_rows") >= 2) & ~_matches(F.coalesce("section_title", F.lit("")), V.LOW_VALUE_TITLES) & (F.coalesce(vertical, F.lit(False)) | has_field)
    # the header is made once for its table, so are the fields of its keys
    head = {"has_field": has_field, "vertical": vertical, "multi": multi, "_h": header, "_fields": F.transform(header, field_for_key)}
    tables = tables if placed else by_section(tables, keys)
    rows = _with_heads(tables, keys, told, head)
    by = [c for c in ("document_id", "section_id") if c in keys] or keys
    rows = materialise(rows, by)

    down = rows.where(F.col("vertical") & (F.col("row_no") > 1) & (F.size("cells") >= 2)).select(
        *table_key, "row_no", field_for_key(F.get("cells", 0)).alias("field"),
        F.array_join(F.filter(F.slice("cells", F.lit(2), F.size("cells")), lambda c: c != ""), "; ").alias("value"),
    ).where(F.col("field").isNotNull() & (F.col("value") != "") & ~F.col("value").isin(V.EMPTY_CELLS))
    down = down.withColumn("_hits", F.count(F.lit(1)).over(Window.partitionBy(*table_key))).where(F.col("_hits") >= 2).drop("_hits")
    records = materialise(_units(down.withColumn("row_index", F.lit(None).cast("long")).withColumn("_at", F.col("row_no").cast("int")), table_key, "table_record"))

    skip = F.when(F.col("multi"), 2).otherwise(1)
    recorded = not records.isEmpty()
    across = rows.where("has_field").where(F.col("row_no") > skip)
    if recorded:
        across = across.join(records.select(*table_key).distinct(), table_key, "left_anti")
    across = (
        across
        .withColumn("row_index", (F.col("row_no") - skip).cast("long"))
        .select(*table_key, "row_index", "_h", "_fields", _entries(F.col("_h"), F.col("cells")).alias("_e"))
    )
    across = computed_once(across)
    labels_only = F.filter("_e", lambda e: (e["value"] != "") & ~e["value"].isin(V.FIELD_LABELS))
    filled_cells = F.filter("_e", lambda e: e["value"] != "")
    across = across.where(~((F.size(filled_cells) > 0) & (F.size(labels_only) == 0)))
    cells = across.select(*table_key, "row_index", "_h", "_fields", F.posexplode("_e").alias("_at", "_cell")).select(
        *table_key, "row_index", "_at", F.get("_fields", F.array_position("_h", F.col("_cell.key")).cast("int") - 1).alias("field"), F.col("_cell.value").alias("_v")
    ).where(F.col("field").isNotNull())
    cells = materialise(cells.repartition(*by) if recorded else cells, by)
    usable = F.when((F.col("_v") != "") & ~F.col("_v").isin(V.EMPTY_CELLS), F.col("_v"))
    carried = carry_last(
        cells.withColumn("_last", usable), [*table_key, "field"], [F.col("row_index"), F.col("_at")], ["_last"]
    )
    values = carried.withColumn("value", F.when(F.col("_v") == "", F.col("_last")).otherwise(usable)).where(F.col("value").isNotNull())
    out = _units(values, table_key, "table_row")
    if recorded:
        out = records.unionByName(out)
    base = F.replace(F.coalesce("section_id", F.lit("sec")), F.lit(" "), F.lit("_"))
    suffix = F.when(F.col("row_index").isNull(), F.lit("_record")).otherwise(F.concat(F.lit("_r"), F.col("row_index").cast("string")))
    return out.withColumn("unit_id", F.concat(F.lit("ru_"), base, F.lit("_t"), F.col("table_no").cast("string"), suffix)).withColumn(
        "function", _function_name()
    )


def _function_name() -> Column:
    title = F.coalesce("section_title", F.lit(""))
    name = F.regexp_replace(title, r"(?U)^\d+(?:\.\d+)*\s*", "")
    return F.when(name != "", name).otherwise(F.replace(F.coalesce("section_id", F.lit("sec")), F.lit(" "), F.lit("_")))


def _units(values: DataFrame, table_key: list[str], source_type: str) -> DataFrame:
    """Values (field, value, _at) of a unit as columns; units without any assertion are dropped."""
    per_field = values.groupBy(*table_key, "row_index", "field").agg(
        F.array_sort(F.collect_list(F.struct("_at", "value"))).alias("_v")
    ).select(*table_key, "row_index", "field", _append_all(F.transform("_v", lambda x: x["value"])).alias("text"))
    wide = per_field.groupBy(*table_key, "row_index").agg(
        *[F.coalesce(F.max(F.when(F.col("field") == f, F.col("text"))), F.lit("")).alias(f) for f in UNIT_FIELDS]
    )
    asserted = F.concat("triggers", "actions", "expected_results", "hmi_display", "status_feedback") != ""
    return wide.where(asserted).withColumn("source_type", F.lit(source_type)).withColumn("requirement_text", F.lit(""))


def text_units(sections: DataFrame, units: DataFrame, signal_tables: DataFrame) -> DataFrame:
    """One unit from the text of each useful section that has neither table units nor a signal table.

    sections: document_id, section_id, title, content, is_candidate, page_start, page_end.
    """
    key = ["document_id", "section_id"]
    title, content = T.compact_text("title"), T.compact_text("content")
    clean = sections.select(
        *key, title.alias("section_title"), content.alias("_c"), "page_start", "page_end", F.coalesce("is_candidate", F.lit(False)).alias("_ok")
    )
    useful = F.col("_ok") | _matches(F.col("section_title"), V.USEFUL_SECTIONS) | _matches(F.col("_c"), V.USEFUL_SECTIONS)
    picked = (
        clean.where((F.char_length("_c") >= 120) & ~_matches(F.col("section_title"), V.LOW_VALUE_TITLES) & useful)
        .join(units.select(*key).distinct(), key, "left_anti")
        .join(signal_tables.select(*key).distinct(), key, "left_anti")
    )
    blank = {f: F.lit("") for f in UNIT_FIELDS if f != "expected_results"}
    return picked.withColumns(
        {
            "requirement_text": F.col("_c"), "expected_results": F.col("_c"), "source_type": F.lit("section_text"),
            "unit_id": F.concat(F.lit("ru_"), F.replace("section_id", F.lit(" "), F.lit("_")), F.lit("_text")), "function": _function_name(),
            "table_no": F.lit(0).cast("long"), "row_index": F.lit(0).cast("long"), **blank,
        }
    ).drop("_c", "_ok")


def dedup_units(units: DataFrame, order: Sequence[str] = ("table_no", "row_index", "unit_id")) -> DataFrame:
    """Units once per section, preconditions, triggers, results, display and feedback."""
    fields = ["section_id", "preconditions", "triggers", "expected_results", "hmi_display", "status_feedback"]
    return first_per_key(units, ["document_id", *fields], list(order)).select(*units.columns)


def unit_text() -> Column:
    return F.concat_ws(" ", *["unit_id", "section_id", "section_title", "function", *UNIT_FIELDS, "requirement_text"])


def match_signals(units: DataFrame, sigs: DataFrame, k: int | None = None) -> DataFrame:
    """Signals named or encoded in a unit's text, all or the first k of the document: document_id, unit_id, rank, signal columns."""
    named = sigs.where(~F.col("name").isin(V.GENERIC_SIGNALS))
    words = F.array_compact(
        F.array(F.when(F.col("name") != "", F.col("name")), F.when(F.char_length("encoding") >= 4, F.col("encoding")))
    )
    by_word = named.select("document_id", "signal_id", "name", "encoding", "communication", "section_id", "table_no", "row_index", F.explode(F.array_distinct(words)).alias("_word"))
    texts = units.select("document_id", "unit_id", unit_text().alias("_text"))
    columns = [c for c in by_word.columns if c not in ("document_id", "_word")]
    hits = contains_join(texts, by_word, "_text", "_word", ["unit_id"], columns, within=["document_id"])
    order = ["section_id", "table_no", "row_index", "signal_id"]
    found = hits.distinct()
    if k is None:
        return numbered(found, ["document_id", "unit_id"], [F.col(c) for c in order], "rank")
    return top_k_per_key(found, ["document_id", "unit_id"], [F.col(c) for c in order], k)


def with_intents(units: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """Test intents and source quality of units; ``matched`` are their signals."""
    if matched is not None:
        names = matched.groupBy("document_id", "unit_id").agg(F.array_sort(F.collect_list(F.struct("rank", "name", "signal_id"))).alias("related_signals"))
        units = units.join(names, ["document_id", "unit_id"], "left")
        has_signals = F.col("related_signals").isNotNull()
    else:
        has_signals = F.lit(False)
    text = unit_text()

    def when(cond: Column, name: str) -> Column:
        return F.when(cond, F.lit(name))

    intents = F.array_compact(
        F.array(
            F.lit("Positive function"), when(F.col("preconditions") != "", "Precondition not satisfied"),
            when(_matches(text, V.FAILURE_WORDS), "Reject/failure path"), when(_matches(text, V.BOUNDARY_WORDS), "Boundary/timeout"),
            when(F.col("hmi_display") != "", "HMI display consistency"), when(F.col("status_feedback") != "", "Status feedback"),
            when(has_signals, "Signal/service interface"), when(_matches(text, V.PRIORITY_WORDS), "Service priority/arbitration"),
        )
    )
    kind = F.col("source_type")
    high = ((kind == "table_record") & ((F.col("triggers") != "") | (F.col("actions") != ""))) | (
        (kind == "table_row") & ((F.col("triggers") != "") | (F.col("expected_results") != ""))
    )
    quality = F.when(high, "high").when(kind == "section_text", "medium").otherwise("low")
    return units.withColumns({"test_intents": intents, "source_quality": quality})


def coverage(units: DataFrame) -> DataFrame:
    """Coverage matrix of units with intents."""
    return units.select(
        "document_id", "unit_id", "section_id", "function", "test_intents", (F.col("source_quality") != "low").alias("must_cover"),
        F.array().cast("array<string>").alias("covered_by_cases"),
    )


# ---------------------------------------------------------------- topics
def classify_topic(title: Column | str, content: Column | str, rules=V.TOPIC_RULES) -> Column:
    """(topic_id, topic) with the most keyword occurrences; the smaller id wins a tie."""
    title = F.col(title) if isinstance(title, str) else title
    content = F.col(content) if isinstance(content, str) else content
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(content, F.lit(""))))

    def occurrences(t: Column, word: str) -> Column:
        return (F.char_length(t) - F.char_length(F.replace(t, F.lit(word.lower()), F.lit("")))) / len(word)

    def pick(t: Column) -> Column:
        scores = F.array(
            *[
                F.struct((-sum((occurrences(t, w) for w in words), F.lit(0))).alias("s"), F.lit(tid).alias("topic_id"), F.lit(name).alias("topic"))
                for tid, name, words in rules
            ]
        )
        return F.array_min(F.filter(scores, lambda x: x["s"] < 0))

    best = T.let(text, pick)
    return F.when(best.isNotNull(), F.struct(best["topic_id"].alias("topic_id"), best["topic"].alias("topic"))).when(
        _matches(F.coalesce(title, F.lit("")), V.META_TITLE),
        F.struct(F.lit("document_meta").alias("topic_id"), F.lit("Document metadata and version info").alias("topic")),
    ).otherwise(F.struct(F.lit("general").alias("topic_id"), F.lit("General functional requirements").alias("topic")))


def top_keywords(items: DataFrame, by: Sequence[str], text: str, k: int = 10) -> DataFrame:
    """Most frequent words per group, ties by word."""
    words = F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9_.-]{2,}|[一-鿿]{2,8}"), F.lit(0))
    counts = (
        items.select(*by, F.explode(words).alias("word"))
        .where(~F.col("word").isin(V.KEYWORD_STOP))
        .groupBy(*by, "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return top_k_per_key(counts, list(by), [F.desc("n"), F.asc("word")], k)


def topic_items(items: DataFrame, by_unit: bool, rules=V.TOPIC_RULES) -> DataFrame:
    """Items (document_id, seq, section_id, title, content, …) with their topic and cluster group."""
    topic = classify_topic("title", "content", rules)
    out = items.withColumn("_topic", topic).select("*", "_topic.topic_id", F.col("_topic.topic").alias("topic")).drop("_topic")
    if not by_unit:
        return out.withColumn("group_id", F.col("topic_id"))
    safe = F.btrim(F.regexp_replace(F.coalesce("section_id", F.lit("unknown")), "[^0-9A-Za-z_.-]+", "_"), F.lit("_"))
    return out.withColumn("group_id", F.concat_ws("_", F.when(safe != "", safe).otherwise(F.lit("unknown")), "topic_id"))


def topic_clusters(items: DataFrame, by_unit: bool, rules=V.TOPIC_RULES) -> DataFrame:
    """Clusters per document: pages, counts, quality, summary, keywords, intents.

    items: document_id, seq, section_id, title, content, content_preview,
    page_start, page_end, test_intents, source_quality.
    """
    tagged = materialise(topic_items(items, by_unit, rules))
    key = ["document_id", "group_id"]
    base = tagged.groupBy(*key).agg(
        F.min_by("topic_id", "seq").alias("topic_id"), F.max_by("topic", "seq").alias("topic"), F.min("seq").alias("_first"),
        F.count_distinct("section_id").alias("section_count"), F.count(F.lit(1)).alias("_items"),
        F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"),
        F.max(F.when(F.col("source_quality") == "high", 2).when(F.col("source_quality") == "medium", 1).otherwise(0)).alias("_q"),
    )

    def listed(df: DataFrame, value: Column, name: str, glue: str | None = None) -> DataFrame:
        rows = df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", value.alias("v")))).alias("_l"))
        items_ = F.transform("_l", lambda x: x["v"])
        return rows.select(*key, (F.array_join(items_, glue) if glue else items_).alias(name))

    heads = top_k_per_key(tagged.select(*key, "seq", "section_id", "title"), key, [F.col("seq")], 5)
    summary = listed(heads, T.compact_text(F.concat_ws(" ", F.coalesce("section_id", F.lit("")), F.coalesce("title", F.lit("")))), "summary", "；")
    words = top_keywords(tagged.withColumn("_w", F.concat_ws(" ", "title", "content")), key, "_w")
    keywords = listed(words, F.col("word"), "keywords")
    first_seen = tagged.select(*key, "seq", F.posexplode("test_intents").alias("_p", "intent")).groupBy(*key, "intent").agg(F.min(F.struct("seq", "_p")).alias("_s"))
    intents = listed(top_k_per_key(first_seen, key, [F.col("_s")], 10), F.col("intent"), "test_intents")
    # by topic there are as many clusters as topics in a document; by_unit, as sections times topics: still one document's
    index = F.row_number().over(Window.partitionBy("document_id").orderBy("_first"))
    named = base.withColumn("cluster_id", F.concat(F.format_string("topic_%02d_", index), F.col("group_id")))
    out = named.join(summary, key, "left").join(keywords, key, "left").join(intents, key, "left")
    return out.select(
        "document_id", "cluster_id", "group_id", "topic_id", "topic", "summary", F.col("section_count"),
        (F.col("_items") if by_unit else F.lit(0)).cast("long").alias("unit_count"), "page_start", "page_end",
        F.coalesce("keywords", F.array()).alias("keywords"), F.coalesce("test_intents", F.array()).alias("test_intents"),
        F.when(F.col("_q") == 2, "high").when(F.col("_q") == 1, "medium").otherwise("low").alias("source_quality"),
    )


def section_refs(items: DataFrame, sections: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sections an item group refers to; the last item of a section gives the fallbacks."""
    last = first_per_key(
        items.where(F.col("section_id").isNotNull()).select(*by, "document_id", "section_id", "seq", "section_title", "title", "page_start", "page_end", "content_preview"),
        [*by, "document_id", "section_id"], ["seq"], latest=True,
    )
    known = sections.select(
        "document_id", "section_id", F.col("title").alias("_t"), F.col("page_start").alias("_ps"), F.col("page_end").alias("_pe"), F.col("content_preview").alias("_cp")
    )
    return last.join(known, ["document_id", "section_id"], "left").select(
        *by, *[c for c in ("document_id", "section_id") if c not in by],
        F.coalesce("section_title", "_t", "title").alias("title"), F.coalesce("page_start", "_ps").alias("page_start"),
        F.coalesce("page_end", "_pe").alias("page_end"), F.coalesce("_cp", "content_preview", F.lit("")).alias("content_preview"),
    )


# ---------------------------------------------------------------- generation plan
def usable_unit() -> Column:
    """A unit with evidence that is more than field labels, outside low-value sections."""
    values = F.filter(F.array(*EVIDENCE_FIELDS), lambda x: x != "")
    telling = F.exists(values, lambda x: ~x.isin(V.UNUSABLE_LABELS))
    return telling & ~_matches(F.coalesce("section_title", F.lit("")), V.LOW_VALUE_SECTIONS)


def select_units(units: DataFrame, clusters: DataFrame, budget: int | None = None, per_cluster: int | None = None) -> DataFrame:
    """Usable high and medium units in cluster order; if given, at most ``per_cluster`` each and ``budget`` per document.

    units: document_id, group_id, seq, source_quality, …; clusters: document_id, group_id, cluster_id, page_start.
    """
    good = units.where(F.col("source_quality").isin("high", "medium") & usable_unit())
    key = ["document_id", "group_id"]
    ranked = numbered(good, key, [F.col("seq")], "_rank") if per_cluster is None else top_k_per_key(good, key, [F.col("seq")], per_cluster, "_rank")
    taken = ranked.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("document_id").orderBy(F.coalesce("page_start", F.lit(999999)), "cluster_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = clusters.select(*key, "cluster_id", "page_start").join(taken, key).withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    return (
        ranked.join(offsets.select(*key, "cluster_id", "_before"), key)
        .withColumn("place", (F.col("_before") + F.col("_rank")).cast("long"))
        .where(F.lit(True) if budget is None else F.col("place") <= budget)
        .drop("_before", "_rank")
    )


def draft_case(topic: Column | str, max_signals: int | None = None) -> Column:
    """Deterministic draft text of a unit; ``max_signals`` limits the signals that it names."""
    topic = F.col(topic) if isinstance(topic, str) else topic
    missing = F.lit(V.DRAFT["missing"])

    def first(*cols: str) -> Column:
        return F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in cols], missing)

    intents = F.array_join("test_intents", ", ")
    related = F.coalesce("related_signals", F.array())
    related = related if max_signals is None else F.slice(related, 1, max_signals)
    names = F.array_join(F.array_distinct(F.transform(related, lambda s: s["name"])), ", ")
    lines = [
        F.concat(F.lit(V.DRAFT["unit"]), first("unit_id")),
        T.strip(F.concat(F.lit(V.DRAFT["section"]), first("section_id"), F.lit(" "), F.coalesce("section_title", F.lit("")))),
        F.concat(F.lit(V.DRAFT["topic"]), F.coalesce(topic, F.lit(V.DRAFT["no_topic"]))),
        F.concat(F.lit(V.DRAFT["intents"]), F.when(intents != "", intents).otherwise(missing)),
        F.concat(F.lit(V.DRAFT["name"]), F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("function", "section_title")], F.lit(V.DRAFT["no_name"]))),
        F.concat(F.lit(V.DRAFT["preconditions"]), first("preconditions")),
        F.concat(F.lit(V.DRAFT["steps"]), first("triggers", "actions")),
        F.concat(F.lit(V.DRAFT["expected"]), first("expected_results", "hmi_display", "status_feedback")),
        F.concat(F.lit(V.DRAFT["signals"]), F.when(names != "", names).otherwise(missing)),
        F.lit(V.DRAFT["criteria"]),
    ]
    return F.concat_ws("\n", *lines)


def generation_plan(
    units: DataFrame, clusters: DataFrame, budget: int | None = None, per_cluster: int | None = None, max_signals: int | None = None
) -> DataFrame:
    """Selected units with their draft text."""
    chosen = select_units(units, clusters, budget, per_cluster)
    topics = clusters.select("document_id", "cluster_id", F.col("topic").alias("_topic"))
    return chosen.join(topics, ["document_id", "cluster_id"]).withColumn("draft", draft_case("_topic", max_signals)).drop("_topic")
