import random

import pytest
from pyspark.sql import functions as F

from tripleloom.operators import docs as D
from tripleloom.operators import graph as G
from tripleloom.operators import lexical as L
from tripleloom.operators import review as R
from tripleloom.operators import search as S
from tripleloom.operators import triples as X
from tripleloom.operators import vectors as VEC
from tripleloom.operators import versioning as I
from tripleloom.operators.rules import contains_join
from tripleloom.operators.scale import carry_last, numbered


# ---------------------------------------------------------------- skew-safe blocks
def test_numbering_in_blocks_equals_window(spark):
    df = spark.range(2000).select((F.col("id") % 3 == 0).alias("k"), F.xxhash64("id").alias("o"))
    small = {tuple(r) for r in numbered(df, ["k"], [F.col("o")], "n").collect()}
    blocks = {tuple(r) for r in numbered(df, ["k"], [F.col("o")], "n", max_group_rows=10).collect()}
    assert small == blocks
    ranks = numbered(df, [], [F.col("o")], "n").orderBy("o").select("n").collect()
    assert [r.n for r in ranks] == list(range(1, 2001))


def test_carry_in_blocks_equals_window(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"), F.when(F.col("id") % 97 == 5, F.col("id")).alias("v"))
    small = {tuple(r) for r in carry_last(df, ["k"], [F.col("o")], ["v"]).collect()}
    blocks = {tuple(r) for r in carry_last(df, ["k"], [F.col("o")], ["v"], max_group_rows=10).collect()}
    assert small == blocks


def test_contains_join_of_any_needles(spark):
    rng = random.Random(1)
    texts = [(i, i % 3, "".join(rng.choice("abc ") for _ in range(40))) for i in range(60)] + [(99, 0, ""), (98, 1, None)]
    for n in (0, 1, 80, 900):
        needles = [(i, i % 4, "".join(rng.choice("abc ") for _ in range(rng.randint(0, 6)))) for i in range(n)]
        a = spark.createDataFrame(texts, "t int, d int, text string")
        b = spark.createDataFrame(needles, "n int, d int, word string")
        want = {(t, k) for t, _, text in texts for k, _, word in needles if word and text and word in text}
        assert sorted(tuple(r) for r in contains_join(a.drop("d"), b, "text", "word", ["t"], ["n"]).collect()) == sorted(want)
        same = {(d, t, k) for t, d, text in texts for k, e, word in needles if d == e and word and text and word in text}
        assert sorted(tuple(r) for r in contains_join(a, b, "text", "word", ["t"], ["n"], within=["d"]).collect()) == sorted(same)


# ---------------------------------------------------------------- versions
def brute_match(cand, cur):
    out = {}
    anchors = {c["anchor"] for c in cand}
    for anchor in anchors:
        cs, ks = [c for c in cand if c["anchor"] == anchor], [k for k in cur if k["anchor"] == anchor]
        if len(cs) == 1 and len(ks) == 1:
            out[cs[0]["key"]] = ks[0]["key"]
            continue
        while cs and ks:
            best = None
            for c in cs:
                for k in ks:
                    o, u = len(c["facts"] & k["facts"]), len(c["facts"] | k["facts"])
                    if o <= 0:
                        continue
                    score = (o, o / u, -abs(c["row"] - k["row"]), -abs(len(c["facts"]) - len(k["facts"])), -k["row"])
                    if best is None or score > best[0]:
                        best = (score, c, k)
            if best is None:
                break
            out[best[1]["key"]] = best[2]["key"]
            cs.remove(best[1])
            ks.remove(best[2])
    return out


@pytest.mark.parametrize(("seed", "few"), [(1, 8), (2, 1), (3, 0)])
def test_case_matching_equals_greedy(spark, monkeypatch, seed, few):
    monkeypatch.setattr(I, "FEW", few)
    rng = random.Random(seed)

    def side(tag):
        rows, row = [], 0
        for i in range(40):
            row += rng.randint(1, 3)
            anchor = f"a{rng.randint(0, 5)}"
            facts = {f"base{anchor}"} | {f"f{rng.randint(0, 6)}" for _ in range(rng.randint(0, 4))}
            rows.append({"key": f"{tag}{i:03d}", "anchor": anchor, "row": row, "facts": facts})
        return rows

    cand, cur = side("c"), side("k")

    def frame(rows):
        return spark.createDataFrame(
            [(r["key"], r["anchor"], r["row"], sorted(r["facts"])) for r in rows], "case_key string, case_anchor string, row int, fact_hashes array<string>"
        )

    got = {r.cand_key: r.cur_key for r in I.match_cases(frame(cand), frame(cur)).collect()}
    assert got == brute_match(cand, cur)


def test_cases_around_a_common_fact_list_no_pairs(spark, monkeypatch):
    """20,000 cases of one anchor of which all but one share a fact: nearest rows pair, and no table of pairs outgrows the result."""
    n = 10_000
    both = [
        spark.range(n).select(
            F.concat(F.lit(s), F.lpad(F.col("id").cast("string"), 6, "0")).alias("case_key"), F.lit("a").alias("case_anchor"), (F.col("id") * 3 + shift).alias("row"),
            F.when(F.col("id") == 77, F.array(F.lit(f"alone {s}"))).otherwise(F.array(F.lit("common"), F.concat(F.lit(s), F.col("id").cast("string")))).alias("fact_hashes"),
        )
        for s, shift in (("c", 0), ("k", 1))
    ]
    sizes, written = [], I.materialise

    def counted(df):
        out = written(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(I, "materialise", counted)
    got = {(r.cand_key[1:], r.cur_key[1:]) for r in I.match_cases(*both).collect()}
    assert got == {(f"{i:06d}", f"{i:06d}") for i in range(n) if i != 77}
    assert max(sizes) <= 2 * n


@pytest.mark.parametrize(("seed", "heads", "tails", "n"), [(1, 3, 9, 14), (2, 3, 9, 14), (3, 20, 6, 40), (4, 1, 60, 40), (5, 40, 1, 40)])
def test_changed_pairs_equal_serial_pick(spark, seed, heads, tails, n):
    rng = random.Random(seed)
    facts = [(f"c{c}", "r", f"h{rng.randint(0, heads)}", f"t{rng.randint(0, tails)}") for c in range(6) for _ in range(n)]
    facts = sorted(set(facts))
    rng.shuffle(facts)
    old, new = sorted(facts[: len(facts) // 2]), facts[len(facts) // 2 :]

    def frame(rows, change):
        return spark.createDataFrame(
            [("triple", change, c, r, h, t, f"{c}|{h}|{t}") for c, r, h, t in rows],
            "record_type string, change_type string, case_key string, relation string, head string, tail string, fact_hash string",
        )

    got = {(r.old_hash, r.new_hash) for r in I.changed_pairs(frame(old, "changed_case_remove"), frame(new, "changed_case_add")).collect()}
    want, used = set(), set()
    for c, r, h, t in old:
        options = [n for n in new if n not in used and n[0] == c and (n[2] == h or n[3] == t)]
        if options:
            best = min(options, key=lambda n: (n[2] != h, n[3] != t, n[2], n[3]))
            used.add(best)
            want.add((f"{c}|{h}|{t}", "|".join((best[0], best[2], best[3]))))
    assert got == want


def test_apply_of_diff_gives_candidate(spark):
    def version(rows, which):
        df = spark.createDataFrame(rows, "case string, row int, head string, relation string, tail string")
        from tripleloom.functions import text as T

        return df.select(
            F.lit(which).alias("doc_version"), F.lit(which).alias("source_file"), F.lit("d").alias("source_doc_key"), F.lit("n").alias("normalized_source_file"),
            F.lit("s").alias("strategy"), F.lit("x").alias("domain"), "row", F.col("case").alias("case_id"), F.col("case").alias("case_name"),
            F.col("case").alias("case_anchor"), F.sha1("case").alias("case_key"), "head", "relation", "tail", T.fact_hash("head", "relation", "tail").alias("fact_hash"),
        )

    cur = version([("a", 1, "a", "r", "x"), ("a", 1, "a", "r", "y"), ("b", 2, "b", "r", "x")], "current")
    cand = version([("a", 1, "a", "r", "x"), ("a", 1, "a", "r", "z"), ("c", 3, "c", "r", "x")], "candidate")
    ci, ki = I.rebuild_index(cand), I.rebuild_index(cur)
    m = I.match_cases(ci, ki)
    add, rem = I.diff(cand, ci, cur, ki, m)
    changed = I.pending_changed(I.changed_pairs(rem, add), ci, m)
    assert changed.count() == 1 and rem.count() == 2
    assert {r.change_type for r in add.collect()} == {"new_case_add", "changed_case_add"}
    triples, index = I.apply_pending(cur, add, rem, changed)
    key = ["case_key", "fact_hash"]
    assert {tuple(r) for r in triples.select(*key).collect()} == {tuple(r) for r in cand.select(*key).collect()}
    assert index.count() == 2
    summary = {r.case_key: r for r in I.case_changes(add, rem, changed).collect()}
    assert sum(r.changed_count for r in summary.values()) == 1


# ---------------------------------------------------------------- graph
def test_paths_trees_and_isolated_nodes(spark):
    edges = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("a", "s", "x"), ("x", "s", "c")], "src string, relation string, dst string")
    keys = spark.createDataFrame([(1, "a"), (1, "c"), (1, "d")], "query_id int, name string")
    paths = G.shortest_paths(edges, G.entity_pairs(keys), 3)
    assert [(r.u, r.v, r.distance, r.path_nodes) for r in paths.collect()] == [("a", "c", 2, ["a", "b", "c"])]
    every = {tuple(r)[1:] for r in G.skeleton_all(edges, paths, 3).collect()}
    assert every == {("a", "r", "b"), ("b", "r", "c"), ("a", "s", "x"), ("x", "s", "c")}


def test_tree_equals_kruskal(spark):
    rng = random.Random(5)
    rows, want = [], set()
    for q in range(8):
        nodes = [f"n{i}" for i in range(9)]
        pairs = [(u, v, rng.randint(1, 3)) for i, u in enumerate(nodes) for v in nodes[i + 1 :] if rng.random() < 0.35]
        rows += [(q, u, v, d) for u, v, d in pairs]
        root = {n: n for n in nodes}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for u, v, d in sorted(pairs, key=lambda e: (e[2], e[0], e[1])):
            if find(u) != find(v):
                root[find(u)] = find(v)
                want.add((q, u, v))
    got = {(r.query_id, r.u, r.v) for r in G.mst(spark.createDataFrame(rows, "query_id int, u string, v string, distance int")).collect()}
    assert got == want


def test_longer_walks_equal_breadth_first(spark):
    rng = random.Random(7)
    names = [f"n{i:02d}" for i in range(30)]
    pairs = sorted({tuple(sorted(rng.sample(names, 2))) for _ in range(40)})
    adj = {n: set() for n in names}
    for a, b in pairs:
        adj[a].add(b)
        adj[b].add(a)
    edges = spark.createDataFrame([(a, "r", b) for a, b in pairs], "src string, relation string, dst string")
    keys = spark.createDataFrame([(0, n) for n in names[:10]], "query_id int, name string")
    got = {(r.u, r.v): (r.distance, r.path_nodes) for r in G.shortest_paths(edges, G.entity_pairs(keys), 5).collect()}
    want = {}
    for i, u in enumerate(names[:10]):
        best = {u: [u]}
        layer = {u: [u]}
        while layer:
            nxt = {}
            for n, path in layer.items():
                for m in adj[n]:
                    if m not in best and (m not in nxt or path + [m] < nxt[m]):
                        nxt[m] = path + [m]
            best.update(nxt)
            layer = nxt
        for v in names[:10]:
            if u < v and v in best and len(best[v]) <= 6:
                want[(u, v)] = (len(best[v]) - 1, best[v])
    assert got == want


# ---------------------------------------------------------------- retrieval
def brute_knn(queries, ents, k):
    out = set()
    for q, v in queries:
        for label in {x[1] for x in ents}:
            scored = sorted((-sum(a * b for a, b in zip(v, e)), name) for name, own, e in ents if own == label and len(e) == len(v))
            out |= {(q, label, name, i) for i, (_, name) in enumerate(scored[:k], 1)}
    return out


def test_nearest_in_cells_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    ents = [(f"e{i:03d}", "AB"[i % 2] if i % 7 else None, [float(rng.randint(-4, 4)) for _ in range(6)]) for i in range(200)]
    frame = spark.createDataFrame(ents, "name string, label string, embedding array<float>")
    asked = [(i, [float(rng.randint(-4, 4)) for _ in range(6)]) for i in range(40)]
    queries = spark.createDataFrame(asked, "query_id int, embedding array<float>")
    for pivots, block in ((8, 10), (64, 8192)):
        monkeypatch.setattr(VEC, "PIVOTS", pivots)
        monkeypatch.setattr(VEC, "BLOCK", block)
        got = {tuple(r) for r in VEC.knn(queries, frame, 3).select("query_id", "label", "name", "rank").collect()}
        assert got == brute_knn(asked, ents, 3)


def test_vectors_that_cannot_be_compared_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    ents = [("a", "X", [1.0, 0.0]), ("n", "X", [nan, 1.0]), ("i", "X", [inf, 1.0]), ("z", "X", [None, 1.0]), ("e", "X", []), ("l", "X", [1.0, 2.0, 3.0]), ("0", "X", None)]
    frame = spark.createDataFrame(ents, "name string, label string, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 1.0]), (2, [1.0, 1.0, 1.0]), (3, [nan, 1.0]), (4, None), (5, [1.0])], "query_id int, embedding array<double>")
    got = {(r.query_id, r.name, r.rank) for r in VEC.knn(queries, frame, 2).collect()}
    assert got == {(1, "a", 1), (2, "l", 1)}
    assert VEC.knn(queries, frame.where("false"), 2).count() == 0


def test_cells_far_away_stay_closed(spark):
    rng = random.Random(5)
    centers = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(30)]
    rows = [(f"e{i:04d}", True, "", 8, [x + rng.gauss(0, 0.02) for x in centers[i % 30]]) for i in range(3000)]
    frame = spark.createDataFrame(rows, "_id string, _none boolean, _key string, _length int, _v array<double>")
    keys = ["_none", "_key", "_length"]
    _, found = VEC.cells(frame, keys)
    asked = frame.where(F.col("_id") < "e0100").select(*keys, F.col("_id").alias("_query"), "_v")
    met = VEC.meetings(asked, found, keys, 3).join(found.select("_cell", "_rows"), "_cell").agg(F.sum("_rows")).first()[0]
    assert met < 0.5 * 100 * 3000


def test_lexical_best_hit_is_100_and_threshold_is_strict(spark):
    triples = spark.createDataFrame(
        [(1, "doc", "tail gate", "opens", "fast", ["p1"], False, ""), (2, "doc", "tail gate", "opens", "fast", ["p2"], False, ""), (3, "doc", "zzz", "qqq", "kkk", [], False, "")],
        "row_id long, doc_name string, head string, relation string, tail string, sources array<string>, conflict boolean, conflict_note string",
    )
    queries = spark.createDataFrame([(1, "tail gate opens fast"), (2, "")], "query_id int, query string")
    got = L.lexical_triples(queries, triples).collect()
    assert [(r.query_id, r.row_id, r.score) for r in got] == [(1, 1, 100.0)]


def test_cross_field_hit_keeps_score_zero(spark):
    cases = spark.createDataFrame(
        [("c1", "alpha", "beta", ["p"], ["a"], ["e"], "s", 1)],
        "case_id string, case_name string, test_type string, preconditions array<string>, actions array<string>, expected_behaviors array<string>, source string, source_row int",
    )
    queries = spark.createDataFrame([("q", "alpha beta"), ("r", "ALPHA")], "query_id string, query string")
    got = {r.query_id: (r.score, r.total) for r in S.search_cases(cases, queries).collect()}
    assert got == {"q": (0.0, 1), "r": (0.55, 1)}
    overview = S.answer_cases(cases, spark.createDataFrame([(1, "有哪些类型")], "question_id int, question string")).collect()
    assert [(r.case_id, r.score) for r in overview] == [("c1", 0.9)]


# ---------------------------------------------------------------- documents and triples
def test_tiny_sections_merge_like_a_fold(spark):
    rng = random.Random(11)
    rows = [("d", i, f"{i}", f"t{i}", rng.randint(1, 4), "x" * rng.choice([5, 60])) for i in range(60)]
    df = spark.createDataFrame(rows, "document_id string, seq int, section_id string, title string, level int, content string").withColumns(
        {"parent": F.lit(None).cast("string"), "page_start": F.lit(1), "page_end": F.lit(1)}
    )
    want = []
    for _, _, sid, title, level, content in rows:
        if want and len(content) < 40 and level > want[-1][1]:
            want[-1][2] += f"\n\n## {sid} {title}\n{content}"
        else:
            want.append([sid, level, content])
    got = [(r.section_id, r.content) for r in D.merge_tiny(df).orderBy("seq").collect()]
    assert got == [(w[0], w[2]) for w in want]


def test_requirement_tables(spark):
    html = (
        "<table><tr><td>项目</td><td>内容</td></tr><tr><td>触发条件</td><td>按下</td></tr><tr><td>执行动作</td><td>打开</td><td>尾门</td></tr></table>"
        "<table><tr><td>触发条件</td><td>执行结果</td></tr><tr><td>常显</td><td>报警音</td></tr><tr><td>按键</td><td>亮</td><td>响</td></tr></table>"
    )
    sections = spark.createDataFrame([("d", "1.2", "1.2 尾门", 1, 1, html)], "document_id string, section_id string, section_title string, page_start int, page_end int, content string")
    keys = ["document_id", "section_id", "section_title", "page_start", "page_end"]
    units = {r.unit_id: r for r in D.requirement_units(D.extract_tables(sections, keys)).collect()}
    assert units["ru_1.2_t1_record"].actions == "打开; 尾门" and units["ru_1.2_t1_record"].function == "尾门"
    row = units["ru_1.2_t2_r1"]
    assert row.triggers == "按键" and row.expected_results == "亮; 响"


def test_cut_off_table_is_read(spark):
    df = spark.createDataFrame([(1, "x <table><tr><td>a<td>b</tr><tr><td>c")], "id int, content string")
    got = [(r.row_no, r.cells) for r in D.extract_tables(df, ["id"]).orderBy("row_no").collect()]
    assert got == [(1, ["a", "b"]), (2, ["c"])]


def test_fusion_is_idempotent_and_keeps_single_sources(spark):
    rows = [(1, "（a）", "r。", "b", ["s2", "s1"], False, ""), (2, "(a)", "r", "b", ["s3"], True, "n"), (3, "x", "r", "y", ["z2", "z1"], False, "")]
    raw = spark.createDataFrame(rows, "row_id int, head string, relation string, tail string, sources array<string>, conflict boolean, conflict_note string")
    once = X.fuse_exact(raw)
    got = {r.head: r.sources for r in once.collect()}
    assert got == {"（a）": ["s1", "s2", "s3"], "x": ["z2", "z1"]}
    assert X.fuse_exact(once.withColumn("row_id", F.lit(1))).count() == 2


def test_registry_and_reviews(spark):
    registry = spark.createDataFrame([("a", "active"), ("b", "active"), ("c", "trash"), ("d", "active")], "source_id string, state string")
    events = spark.createDataFrame(
        [("a", 1, "purge"), ("a", 2, "delete"), ("b", 1, "delete"), ("b", 2, "purge"), ("b", 3, "restore"), ("c", 1, "purge"), ("d", 1, "delete"), ("d", 2, "restore")],
        "source_id string, seq int, action string",
    )
    got = {r.source_id: r.state for r in R.apply_registry_events(registry, events).collect()}
    assert got == {"a": "trash", "d": "active"}


# ---------------------------------------------------------------- derived cases
def test_subsets_of_many_items(spark):
    from itertools import combinations

    from tripleloom.operators import cases as C

    def text(n):
        return "\n".join(f"{i + 1}. item{i}" for i in range(n))

    df = spark.createDataFrame([("a", "n", "t", ["p"], text(70), text(70)), ("b", "n", "t", ["p"], text(14), text(14))], "case_id string, case_name string, test_type string, preconditions array<string>, action_text string, expected_text string")
    pairs = C.combination_cases(df, size=2).groupBy("case_id").count().collect()
    assert {r.case_id: r["count"] for r in pairs} == {"a": 70 * 69 // 2, "b": 14 * 13 // 2}
    names = {r.combo_name for r in C.combination_cases(df.where("case_id = 'a'"), size=69).collect()}
    assert len(names) == 70
    every = [r.combo_name for r in C.combination_cases(df.where("case_id = 'b'")).collect()]
    want = {f"n-combo{k}items(items {'+'.join(str(i + 1) for i in c)})" for k in range(1, 14) for c in combinations(range(14), k)}
    assert len(every) == len(want) and set(every) == want


def test_tables_by_case_are_indexed_without_a_shuffle(spark):
    from tripleloom.session import materialise

    rows = [(f"c{i % 7}", f"h{i}", "r", f"t{i}", f"f{i:04}") for i in range(300)]
    triples = spark.createDataFrame(rows, "case_key string, head string, relation string, tail string, fact_hash string")
    fields = {c: F.lit(c) for c in ("doc_version", *I.PROVENANCE) if c != "row"} | {"row": F.lit(1)}
    stored = materialise(triples.withColumns(fields), "case_key")
    index = I.rebuild_index(stored)
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    # more hashes than are looked through one by one
    current = stored.where(~F.col("fact_hash").isin("f0003", "f0010"))
    fewer = stored.where(F.col("case_key") != "c5").where("fact_hash < 'f0020'")
    matches = spark.createDataFrame([(f"c{i}", f"c{i}") for i in range(5)] + [("c6", "c6")], "cand_key string, cur_key string")
    more = spark.createDataFrame([("c1", f"h{i}", "r", "n", f"n{i:04}") for i in range(100)], triples.schema).withColumns(fields)
    cand = fewer.unionByName(more)
    add, remove = I.diff(cand, I.rebuild_index(cand), current, I.rebuild_index(current), matches, hashes=False)
    assert sorted(r["fact_hash"] for r in add.collect()) == sorted(["f0003", "f0010", *(f"n{i:04}" for i in range(100))])
    gone = [(r["change_type"], r["fact_hash"]) for r in remove.collect()]
    want = [("deleted_case_remove" if r[0] == "c5" else "changed_case_remove", r[4]) for r in rows if r[4] not in ("f0003", "f0010") and (r[0] == "c5" or r[4] >= "f0020")]
    assert sorted(gone) == sorted(want)


def test_best_pairs_take_little_memory_and_ties_by_row():
    import tracemalloc

    import numpy as np

    from tripleloom.operators import vectors as VEC

    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(5000, 8))
    vectors[2000:2600] = vectors[17]  # equal vectors
    asked = np.concatenate([vectors[:300], rng.normal(size=(3700, 8))])
    tracemalloc.start()
    q, row, score = VEC.best_pairs(asked, vectors, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    exact = np.stack([(asked * v).sum(axis=1) for v in vectors], axis=1)
    exact[:, 2000:2600] = exact[:, [17]]
    want = np.argsort(-exact, axis=1, kind="stable")[:, :3]
    assert q.tolist() == np.repeat(np.arange(4000), 3).tolist() and (row.reshape(-1, 3) == want).all()
    assert np.allclose(score.reshape(-1, 3), np.take_along_axis(exact, want, 1))
    # all products at once would take 160 MB
    assert peak < 60e6
    few = VEC.best_pairs(asked[:2], vectors[:2], 3)
    assert few[0].tolist() == [0, 0, 1, 1]
