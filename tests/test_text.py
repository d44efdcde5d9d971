import random

from pyspark.sql import functions as F

from tripleloom.functions import text as T
from tripleloom.operators import cases as C
from tripleloom.operators import triples as X
from tripleloom.operators.rules import classify_risk, refine_component


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("v"))).collect()]


def test_numbered_items_continue_lines(spark):
    assert one(spark, T.split_numbered_items, "1. 打开尾门\n2、关闭尾门\n继续保持", "first\n1. a；", "", "nan") == [
        ["打开尾门", "关闭尾门 继续保持"], ["first", "a"], [], []
    ]


def test_bracket_items_and_values(spark):
    assert one(spark, T.bracket_items, "[1]钥匙离车。[2]关门，") == [["钥匙离车", "关门"]]
    assert one(spark, T.extract_value, "0x1 (ON。)；", "plain。") == ["ON", "plain"]


def test_unicode_blanks_are_trimmed(spark):
    assert one(spark, T.strip, "　a　b　") == ["a　b"]
    assert one(spark, T.strip_trailing_punct, "完成　。；", "a ， ，") == ["完成", "a ，"]
    assert one(spark, T.normalize_term, "（a　 b）：，。") == ["(a b):"]


def test_single_expected_quirks(spark):
    values = ["电压11.5V", "11.5V", "1. 亮 2. 灭", "", "灯①亮"]
    assert one(spark, T.is_single_expected, *values) == [True, False, False, False, False]


def test_lists_keep_text_of_separators_only(spark):
    assert one(spark, T.as_text_list, "a；b\n;c", ";;", None) == [["a", "b", "c"], [";;"], []]
    assert one(spark, T.split_cell_items, "1. a\n2) b；3、c") == [["a", "b", "c"]]


def test_file_names_and_keys(spark):
    assert one(spark, T.normalize_filename, "锁车_v2.xlsx", "a V10.b.xlsx", ".hidden", "plan v3") == [
        "锁车.xlsx", "a V10.b.xlsx", ".hidden", "plan"
    ]
    import hashlib

    row = spark.range(1).select(T.case_key(F.lit("类型测试用例"), F.lit("开锁"), F.lit(2)).alias("k")).first()
    assert row.k == hashlib.sha1("类型测试用例||开锁||2".encode()).hexdigest()


def test_question_tokens_longest_first(spark):
    assert one(spark, T.question_tokens, "尾门开关 app?")[0][:4] == ["尾门开关", "尾门开", "门开关", "app"]


def test_json_payloads(spark):
    values = ['```json\n{"k": 1}\n```', 'answer: [{"k": 2}] ok', 'see {"k": 3}', "none"]
    assert one(spark, T.json_payload, *values) == ['{"k": 1}', '[{"k": 2}]', '{"k": 3}', None]


def test_repair_of_misread_text(spark):
    good = "电动尾门功能"
    bad = good.encode("utf-8").decode("gb18030")
    assert one(spark, T.repair_text, bad, good, "plain") == [good, good, "plain"]


def test_generated_text_and_case_split(spark):
    assert one(spark, T.clean_generated, "<think>x</think>draft\n测试项：a\n测试项：b<br>c") == ["测试项：b\nc"]
    assert one(spark, T.split_cases, "a\n---\nb\n ----- \n", "x") == [["a", "b"], ["x"]]


def test_tail_expansion(spark):
    rows = spark.createDataFrame(
        [
            ("触发条件", "满足以下任一条件：1.车速>5；2.电源ON", "logic"), ("依赖于", "满足以下任一条件：1.车速>5；2.电源ON", "logic"),
            ("前提条件", "a并且b且c", "logic"), ("触发条件", "a；b", "structure_table"),
        ],
        "r string, t string, k string",
    )
    got = [r[0] for r in rows.select(X.expand_tail(F.col("r"), F.col("t"), F.col("k"))).collect()]
    assert got == [["车速>5", "电源ON"], ["满足以下任一条件:1.车速>5；2.电源ON"], ["a", "b", "c"], ["a；b"]]


def test_paired_lists_stop_at_the_shortest(spark):
    record = "Test Case Type: 锁\nTest Case Name: n\nTest Case Logic: l\nPreconditions: [1]a[2]b[3]c\nPrecondition signals: [1]s\nPrecondition values: [1]v (1)\n" + (
        "Actions: \nAction signals: \nAction values: \nExpectations: \nExpectation signals: \nExpectation values: "
    )
    df = spark.createDataFrame([(1, record)], "id int, rec string").select("id", T.parse_case_record("rec").alias("case"))
    rows = {(r.relation, r.tail) for r in X.lock_triples(df, ["id"]).collect()}
    assert ("对应信号", "s") in rows and ("需要复合条件", "s：1") in rows
    assert sum(rel == "对应信号" for rel, _ in rows) == 1 and not any(t is None for _, t in rows)


def test_vague_component_and_first_rule(spark):
    df = spark.createDataFrame([(None, "LOST POWER ON HIGHWAY"), ("CHARGING", "x")], "c string, s string")
    rows = df.select(
        refine_component("c", "s").alias("r"), refine_component("c", "s", null_component="NAN").alias("n"), classify_risk("c", "s").alias("k")
    ).collect()
    assert rows[0].r == "POWERTRAIN_OR_ELECTRICAL" and rows[0].n == "NAN"
    assert rows[1].k == "electrical_or_battery_failure"


def test_reverse_plan_shared_and_single(spark):
    rows = [
        ("1", "n1", "t", ["p", "q"], "act", "done", 1), ("2", "n2", "t", ["p", "r"], "act", "done", 2), ("3", "n3", "t", ["p"], "act", "done", 3),
        ("4", "n4", "t", ["x", "y"], "go", "done", 4), ("5", "n5", "t", ["x"], "go", "不亮", 5),
    ]
    cases = spark.createDataFrame(
        rows, "case_id string, case_name string, test_type string, preconditions array<string>, action_text string, expected_text string, source_row int"
    )
    got = sorted((r.case_name, r.original_precondition, r.expected_text, tuple(r.preconditions)) for r in C.reverse_plan(cases).collect())
    assert got == [
        ("Reverse-n1", "p", "NOT(done)", ("NOT(p)", "q")), ("Reverse-n4", "x", "NOT(done)", ("NOT(x)", "y")), ("Reverse-n4", "y", "NOT(done)", ("x", "NOT(y)")),
    ]


def test_combinations_of_many_items(spark):
    text = "\n".join(f"{i}. item{i}" for i in range(1, 15))
    cases = spark.createDataFrame([("c", "n", "t", ["p"], text, text), ("d", "m", "t", ["p"], "1. a\n2. a\n3. b", "1. e\n2. e\n3. f")],
                                  "case_id string, case_name string, test_type string, preconditions array<string>, action_text string, expected_text string")
    got = C.combination_cases(cases).groupBy("case_id").count().collect()
    counts = {r.case_id: r["count"] for r in got}
    assert counts == {"c": 2**14 - 2, "d": 4}  # of d: a, b, a+a, a+b


def test_evaluation_issues(spark):
    text = "测试项：x\n前提条件：ready\n执行动作：go\n预期行为：ok"
    got = spark.createDataFrame([(text,)], "t string").select(C.evaluate_case("t").alias("e")).first().e
    assert got.score == 80 and len(got.issues) == 2


def balanced(text):
    """Outermost balanced objects and lists, by a stack."""
    stack, found, quoted, escaped = [], [], False, False
    for i, c in enumerate(text):
        if escaped:
            escaped = False
        elif c == "\\" and stack:
            escaped = True
        elif c == '"' and stack:
            quoted = not quoted
        elif not quoted and c in "{[":
            stack.append((c, i))
        elif not quoted and stack and c in "}]" and stack[-1][0] == {"}": "{", "]": "["}[c]:
            start = stack.pop()[1]
            found = [f for f in found if f[0] < start] + [(start, i + 1)]
    return [text[a:b] for a, b in found]


def test_json_answers_are_found_in_prose(spark):
    cases = {
        'see {"k":[1,2]}': ('{"k":[1,2]}', []),
        'x {"k":1} and {"k":2} y': ('{"k":1}', []),
        'note {a} then {"k":3}': ('{"k":3}', ["{a}"]),
        'no { here {"k": 4}': ('{"k": 4}', []),
        'a "quoted { word" {"t":"}","k":5}': (None, ['a "quoted { word" {"t":"}","k":5}']),
        '{"t":"a \\" } b","k":6} rest': ('{"t":"a \\" } b","k":6}', []),
        '```json\n{"k": 7}\n```': ('{"k": 7}', []),
        "nothing": (None, ["nothing"]), "": (None, [""]), "{]": (None, ["{]"]), "} {": (None, ["} {"]),
    }
    rows = spark.createDataFrame([(t,) for t in cases] + [(None,)], "t string").select("t", T.json_answer("t", "k string").alias("j")).collect()
    got = {r.t: (r.j["json"], list(r.j["rejected"])) for r in rows}
    assert got.pop(None) == (None, [""])
    for text, want in cases.items():
        if text.startswith("a "):  # an open bracket in prose makes later quotes count
            assert got[text][0] in (None, '{"t":"}","k":5}')
        else:
            assert got[text] == want, text


def test_json_candidates_equal_a_stack(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice('{}[]"\\ab ') for _ in range(rng.randrange(30))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.json_candidates("t").alias("c")).collect()
    from tripleloom.functions.text import strip_code_fence

    clean = {r.t: r.s for r in spark.createDataFrame([(t,) for t in set(texts)], "t string").select("t", strip_code_fence("t").alias("s")).collect()}
    for r in rows:
        assert [c["text"] for c in r.c] == balanced(clean[r.t]), r.t


def test_references_without_semicolon_can_stay(spark):
    texts = ["a&amp", "&amp;lt;&#65;&nope;"]
    assert one(spark, T.compact_text, *texts) == ["a&", "&lt;A&nope;"]
    assert one(spark, lambda c: T.compact_text(c, bare=False), *texts) == ["a&amp", "&lt;A&nope;"]


def test_fold_makes_sharp_s_two_letters(spark):
    assert one(spark, T.fold, "ßau", "SSau", "GROẞ") == ["ssau", "ssau", "gross"]


def test_terms_that_fold_alike_are_one(spark):
    ocr = spark.createDataFrame([("i", 0, "ßau", 0.8), ("i", 1, "SSau", 1.0)], "image_id string, line_index int, text string, score double")
    terms = X.ocr_whitelist(ocr, 0.8, 2, 20)
    assert [tuple(r) for r in terms.collect()] == [("i", 1, "ßau")]
    assert [(r["confidence"], r["hits"]) for r in X.term_confidence(terms, ocr).collect()] == [(1.0, 2)]


def test_question_tokens_keep_numbers_beyond_digits(spark):
    assert one(spark, T.question_tokens, "x½ x‿y m²") == [["x½", "m²"]]


def test_texts_without_a_token_have_no_row(spark, tmp_path):
    from tripleloom.plans import text_queries

    rows = [(1, "a b"), (2, ""), (3, None), (4, "ab c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in text_queries.question_tokens(spark, str(tmp_path)).collect()] == [(4, "ab")]


def test_a_keyword_needs_its_own_letters(spark):
    texts = ["einung enbeßge", "ﬁre", "ŉ ǰ ᾀ é ß", "les"]
    assert one(spark, T.upper_by_letter, *texts) == ["EINUNG ENBEẞGE", "ﬁRE", "ŉ ǰ ᾈ É ẞ", "LES"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = rows.select("i", classify_risk(F.lit("X"), "s", [], [("es", ["ES"]), ("fire", ["FI"])]).alias("k")).orderBy("i").collect()
    assert [r.k for r in got] == ["unknown_vehicle_risk"] * 3 + ["es"]
