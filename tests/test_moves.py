"""What moves between tasks, and how many rows joins make, stays in proportion to the input."""

import contextlib
import io

from pyspark.sql import functions as F

from tripleloom.operators import docs as D
from tripleloom.operators import rules, search

from test_growth import joined_rows

KEYS = ["document_id", "section_id", "section_title", "page_start", "page_end"]


def sections(spark, n):
    def html(i):
        rows = "".join(f"<tr><td>sig{i}{j}</td><td>B &amp; C</td><td>ENC{i}</td></tr>" for j in range(3))
        return f"<table><tr><td> </td></tr></table><table><tr><th>Signal Name</th><th>发送方</th><th>信号编码</th></tr>{rows}<tr><td>  </td><td></td></tr></table>"

    rows = [(f"D{i % 3}", str(i), f"1.2 f{i}", i, i, html(i)) for i in range(n)]
    return spark.createDataFrame(rows, "document_id string, section_id string, section_title string, page_start int, page_end int, content string")


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


def test_tables_are_read_where_their_text_is(spark):
    out = D.extract_tables(sections(spark, 6), KEYS)
    assert "Exchange" not in plan_of(out)
    got = sorted((r.section_id, r.table_no, r.row_no, tuple(r.cells)) for r in out.collect())
    want = [(str(i), 1, 1, ("Signal Name", "发送方", "信号编码")) for i in range(6)]
    want += [(str(i), 1, j + 2, (f"sig{i}{j}", "B & C", f"ENC{i}")) for i in range(6) for j in range(3)]
    assert got == sorted(want)


def test_signals_stay_with_their_section(spark):
    out = D.signals(D.extract_tables(sections(spark, 6), KEYS))
    assert "Exchange" not in plan_of(out) and out.count() == 18


def test_numbers_in_needles_are_told_apart(spark):
    def run(n):
        # every three digits of a number are shared by very many others
        cases = spark.range(n).select(F.concat(F.lit("O-"), "id").alias("case_id"), F.concat(F.lit("order of customer "), F.col("id") + 100000).alias("case_name"), F.col("id").alias("source_row"))
        lookups = spark.range(n).select(F.col("id").alias("lookup_id"), F.concat(F.lit("customer "), F.col("id") + 100000).alias("needle"))
        made, got = joined_rows(spark, lambda: search.find_case(cases, lookups).collect())
        assert sorted((r.lookup_id, r.case_id) for r in got) == sorted((i, f"O-{i}") for i in range(n))
        return made

    assert run(4000) < 5 * run(1000)


def test_needles_of_a_large_scope_are_found(spark):
    many = rules.MANY + 50
    texts = spark.createDataFrame([(d, t, f"x{t} yy{t + 1} z") for d in "ab" for t in range(many)], "d string, t int, text string")
    needles = spark.createDataFrame([("a", i, f"yy{i}") for i in range(many)] + [("b", i, f"x{i} ") for i in range(5)], "d string, n int, word string")
    got = sorted(tuple(r) for r in rules.contains_join(texts, needles, "text", "word", ["t"], ["n"], within=["d"]).collect())
    words = [("a", i, f"yy{i}") for i in range(many)] + [("b", i, f"x{i} ") for i in range(5)]
    assert got == sorted((d, t, i) for d, i, w in words for t in range(many) if w in f"x{t} yy{t + 1} z")


def test_changed_facts_of_small_cases_pair_in_their_row(spark):
    from tripleloom.operators import versioning as I

    def frame(rows, kind):
        return spark.createDataFrame(
            [("triple", kind, case, "R", h, t, f"{h}{t}") for case, h, t in rows],
            "record_type string, change_type string, case_key string, relation string, head string, tail string, fact_hash string",
        )

    n = I.MANY + 6
    old = [("s", "a", "x"), ("s", "a", "y"), ("s", "b", "z"), ("s", "q", "q")] + [("m", f"h{i:03}", f"t{i}") for i in range(n)]
    new = [("s", "a", "z"), ("s", "c", "y"), ("s", "a", "w")] + [("m", f"h{i:03}", f"u{i}") for i in range(n)]
    got = {(r.case_key, r.old_hash, r.new_hash) for r in I.changed_pairs(frame(old, "changed_case_remove"), frame(new, "changed_case_add")).collect()}
    # a takes its new facts by tail; what is left of a's takes nothing that b or q could have
    assert got == {("s", "ax", "aw"), ("s", "ay", "az")} | {("m", f"h{i:03}t{i}", f"h{i:03}u{i}") for i in range(n)}
    only = frame(old[:4], "changed_case_remove"), frame(new[:3], "changed_case_add")
    # written in rounds before: every case now pairs by one join
    made, _ = joined_rows(spark, lambda: I.changed_pairs(*only).collect())
    assert made <= 1


def test_cases_are_parsed_once_and_only_repeated_ones_are_numbered(spark):
    from tripleloom.operators import versioning as I
    from tripleloom.functions import text as T

    def record(kind, name, items):
        cells = " ".join(f"[{i}]{x}。" for i, x in enumerate(items, 1))
        lists = [f"{label}: {cells}" for label in T.V.RECORD_LISTS]
        return "\n".join([f"Test Case Type: {kind}", f"Test Case Name: {name}", "Test Case Logic: l", *lists])

    rows = [("f", 3, record("A", "x", ["p (ON)", "p (ON)"])), ("f", 1, record("A", "x", ["q"])), ("g", 1, record("A", "x", ["p"])), (None, 4, record("B", "y", ["p"])), (None, 2, record("B", "y", ["p"]))]
    parsed = spark.createDataFrame(rows, "source_file string, row long, record string").select("source_file", "row", T.parse_case_record("record").alias("case"))
    triples, index = I.versioned_triples(parsed, "d")
    keys = {(r.source_file, r.row): r.case_key for r in index.collect()}
    want = {at: n for at, n in zip([("f", 1), ("f", 3), ("g", 1), (None, 2), (None, 4)], [1, 2, 1, 1, 2])}
    hashed = spark.createDataFrame([(*at, ("A" if at[0] else "B") + "测试用例", "x" if at[0] else "y", n) for at, n in want.items()], "f string, r long, i string, n string, o long")
    assert keys == {(r.f, r.r): r.k for r in hashed.select("f", "r", T.case_key("i", "n", "o").alias("k")).collect()}
    told = [(r.row, r.head, r.relation, r.tail) for r in triples.where("source_file = 'f'").orderBy("row", "pos").collect()]
    assert len(told) == len(set(told)) and (3, "p (ON)", "预期值", "ON") in told
    # the cases are written once: what is read from here on is no longer parsed
    assert "regexp_extract" not in plan_of(index.select("case_key"))


def test_pending_records_are_applied_where_their_case_is(spark):
    from tripleloom.operators import versioning as I
    from tripleloom.session import materialise

    types = ", ".join(f"{c} {'int' if c == 'row' else 'string'}" for c in I.TRIPLE_COLUMNS)

    def fact(file, case, name, row=1):
        return ("v", file, "k", file, "s", "d", row, "id", "n", "a", case, name, "R", name, f"#{name}")

    def pending(kind, change, *facts):
        return spark.createDataFrame([(kind, change, *f) for f in facts], f"record_type string, change_type string, {types}")

    tables = spark.createDataFrame([fact("old", "c", x) for x in "abcc"] + [fact("old", "z", "a")], types)
    add = pending("triple", "x", fact("new", "c", "b"), fact("new", "c", "d"), fact("new", "c", "a"), fact("new", "n", "e"), fact("new", "n", "e", 0))
    remove = pending("triple", "x", fact("old", "c", "a"), fact("old", "q", "a"))
    changed = add.where("head = 'd'").select(
        "record_type", "change_type", *I.PROVENANCE, "case_key", F.struct(F.lit("c").alias("head"), "relation", F.lit("c").alias("tail"), F.lit("#c").alias("fact_hash")).alias("old_triple"),
        F.struct("head", "relation", "tail", "fact_hash").alias("new_triple"),
    )
    changed = changed.unionByName(changed.withColumn("case_key", F.lit("alone")))
    frames = [materialise(df, "case_key") for df in (tables, add, remove, changed)]
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        triples, index = I.apply_pending(*frames)
        assert "Exchange" not in plan_of(triples) and "Exchange" not in plan_of(index)
        got = sorted((r.case_key, r.head, r.source_file, r.row) for r in triples.collect())
        # a comes back, c is replaced by d, b stays; a case takes the metadata of what came last
        assert got == [("alone", "d", "new", 1), ("c", "a", "new", 1), ("c", "b", "new", 1), ("c", "d", "new", 1), ("n", "e", "new", 1), ("z", "a", "old", 1)]
        assert sorted((r.case_key, r.fact_count) for r in index.collect()) == [("alone", 1), ("c", 3), ("n", 1), ("z", 1)]
        assert {r.case_key for r in I.apply_pending(*frames[:3])[0].collect()} == {"c", "n", "z"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_signal_columns_are_found_by_the_header_of_their_table(spark):
    header = ["Signal Name", "发送方", "", "信号编码", "发送方"]
    cells = [["s1", "A", "x", "E1", "B"], ["s2", "A", "x", "E2"], ["", "A", "x", "E3", ""], ["", "", "", "", ""], ["s5", "A", "x", "E5", "", "over"]]
    rows = [("d", "1", "t", 1, i, r) for i, r in enumerate([header, *cells], 1)] + [("d", "1", "t", 2, i, r) for i, r in enumerate([["备注"], ["n"]], 1)]
    tables = spark.createDataFrame(rows, "document_id string, section_id string, section_title string, table_no long, row_no long, cells array<string>")
    out = D.signals(D.by_section(tables, KEYS[:3]), placed=True)
    assert "Window" not in plan_of(out) and "Exchange" not in plan_of(out)
    got = sorted((r.row_index, r.name, r.sender, r.encoding, len(r.raw)) for r in out.collect())
    # the last cell of a repeated column counts, blank or not
    assert got == [(1, "s1", "B", "E1", 4), (2, "s2", "A", "E2", 4), (5, "s5", "", "E5", 5)]


def test_usual_references_are_resolved_once(spark):
    texts = ["a &amp;lt; b &gt; c &lt; &quot;", "&amp;amp; &eacute;x", "&&amp;", "no"]
    html = [f"<table><tr><td>{t}</td></tr></table>" for t in texts]
    df = spark.createDataFrame([(str(i), h) for i, h in enumerate(html)], "section_id string, content string")
    got = {r.section_id: r.cells for r in D.extract_tables(df, ["section_id"]).collect()}
    assert got == {"0": ['a &lt; b > c < "'], "1": ["&amp; éx"], "2": ["&&"], "3": ["no"]}


def test_lexical_rows_are_not_sent_to_every_task(spark):
    from tripleloom.operators import lexical as L

    rows = [(i, "doc", f"bolt {i} red", "MADE_BY", f"brand {i % 7}", ["p"], False, "") for i in range(300)]
    triples = spark.createDataFrame(rows, "row_id long, doc_name string, head string, relation string, tail string, sources array<string>, conflict boolean, conflict_note string")
    queries = spark.createDataFrame([(f"q{i}", f"check bolt {i} made_by brand {i % 7}") for i in range(20)], "query_id string, query string")
    sent, plans, scored = L.SENT, [], L._raw_scores

    def kept(met):
        plans.append(plan_of(met))
        return scored(met)

    L._raw_scores = kept
    try:
        few = sorted(map(str, L.lexical_triples(queries, triples).collect()))
        assert len(plans) == 2
        for plan in plans:
            # what is sent are the questions; the rows, which hold _held, are dealt
            assert plan.count("BuildRight") >= 2 and "BuildLeft" not in plan
        L.SENT = 0
        assert few == sorted(map(str, L.lexical_triples(queries, triples).collect()))
    finally:
        L.SENT, L._raw_scores = sent, scored
