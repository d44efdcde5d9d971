"""Joins of searches and walks make rows in proportion to their input, hubs and frequent words included."""

import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tripleloom.operators import graph as G  # noqa: E402
from tripleloom.operators import lexical as L  # noqa: E402
from tripleloom.operators import search as S  # noqa: E402


def joined_rows(spark, run):
    """Rows that all joins made while `run` ran, and what it returned."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    first = store.executionsCount()
    out = run()
    bus.waitUntilEmpty()
    made, executions = 0, store.executionsList()
    for i in range(first, executions.size()):
        at = executions.apply(i).executionId()
        nodes, values = store.planGraph(at).allNodes(), store.executionMetrics(at)
        for node in (nodes.apply(n) for n in range(nodes.size())):
            for metric in (node.metrics().apply(m) for m in range(node.metrics().size())):
                if "Join" in node.name() and metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    made += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return made, out


def walk(spark, n):
    """n customers of one nation, each with an order of more parts than a region has nations."""
    edges = [("N", "IN_REGION", "R")]
    for i in range(n):
        edges += [(f"C{i}", "IN_NATION", "N"), (f"O{i}", "PLACED_BY", f"C{i}"), *[(f"O{i}", "CONTAINS", f"P{i}-{j}") for j in range(3)]]
    keys = [(i, name) for i in range(n) for name in (f"O{i}", "N", "R")]
    return spark.createDataFrame(edges, "src string, relation string, dst string"), spark.createDataFrame(keys, "query_id int, name string")


def test_a_hub_is_not_opened_for_every_pair(spark):
    made = []
    for n in (60, 240):
        edges, keys = walk(spark, n)
        paths_made, paths = joined_rows(spark, lambda: G.shortest_paths(edges, G.entity_pairs(keys), 3).collect())
        assert sorted((r.query_id, r.u, r.v, r.distance) for r in paths) == sorted(
            row for i in range(n) for row in ((i, "N", "R", 1), (i, "N", f"O{i}", 2), (i, f"O{i}", "R", 3))
        )
        tree = spark.createDataFrame([(r.query_id, r.u, r.v, r.distance) for r in paths], "query_id int, u string, v string, distance long")
        all_made, steps = joined_rows(spark, lambda: G.skeleton_all(edges, tree, 3).collect())
        want = {(i, *e) for i in range(n) for e in (
            ("N", "IN_REGION", "R"), ("N", "IN_NATION", f"C{i}"), (f"C{i}", "PLACED_BY", f"O{i}"), (f"O{i}", "PLACED_BY", f"C{i}"), (f"C{i}", "IN_NATION", "N"),
        )}
        assert {tuple(r) for r in steps} == want
        made.append((paths_made, all_made))
    assert made[1][0] < 6 * made[0][0] and made[1][1] < 6 * made[0][1]


def brute_retrieval(cases, questions, limit):
    out = set()
    for qid, question in questions:
        tokens = list(dict.fromkeys(question.split()))
        scored = []
        for case_id, name, kind, action, row in cases:
            blob = f"{case_id} {name} {kind} {action}"
            hit = [t for t in tokens if t in blob]
            if hit:
                total = min(sum(max(len(t) / 8, 0.15) for t in hit), 1.2) + 0.35 * any(t in name for t in hit) + 0.2 * any(t in kind for t in hit)
                scored.append((-round(min(total, 0.999), 4), name, row, case_id))
        out |= {(qid, case_id, -score, i) for i, (score, _, _, case_id) in enumerate(sorted(scored)[:limit], 1)}
    return out


def test_questions_that_many_cases_answer_in_full_meet_few(spark):
    rng = random.Random(4)
    colours = ["red", "blue", "green", "grey", "pink", "black"]

    def run(n):
        cases = [(f"i{i}", f"customer {rng.randrange(n)}" if i % 9 else "x", "urgent" if i % 4 else "low", " ".join(rng.sample(colours, 3)) + f" w{i}", i) for i in range(n)]
        asked = [(f"{a}{b}", f"customer {a} {b} {rng.randrange(10, 100)} {rng.randrange(10, 100)}") for a in colours for b in colours if a != b] + [("few", "red w3 low"), ("none", "zzz")]
        frame = spark.createDataFrame(
            [(c, name, kind, [], [action], [], "s", row) for c, name, kind, action, row in cases],
            "case_id string, case_name string, test_type string, preconditions array<string>, actions array<string>, expected_behaviors array<string>, source string, source_row long",
        )
        questions = spark.createDataFrame(asked, "question_id string, question string")
        rows, got = joined_rows(spark, lambda: S.retrieve_cases(frame, questions, 5).collect())
        assert {(r.question_id, r.case_id, r.score, r["rank"]) for r in got} == brute_retrieval(cases, asked, 5)
        return rows

    # each of the 30 questions asks for a word of nearly every case, and two digits of their numbers tell cases apart
    assert run(1500) < 1500 * 30


def test_triples_of_equal_content_meet_a_query_once(spark):
    names, colours = ["bolt", "ring", "plate", "nut"], ["red", "blue", "green", "grey", "pink"]

    def run(copies):
        rows = [(f"doc {c}", f"{c} {n} rev {i}", "MADE_BY", f"brand {n}", [f"page {i}"], i % 3 == 0, "") for n in names for c in colours for i in range(8)]
        triples = spark.createDataFrame(
            [(copy * len(rows) + at, *row) for copy in range(copies) for at, row in enumerate(rows)],
            "row_id long, doc_name string, head string, relation string, tail string, sources array<string>, conflict boolean, conflict_note string",
        )
        queries = spark.createDataFrame([(f"{c}{n}", f"check the {c} {n} made_by brand {n}") for n in names for c in colours], "query_id string, query string")
        made, got = joined_rows(spark, lambda: L.lexical_triples(queries, triples).collect())
        return made, sorted((r.query_id, r.row_id, r.score, r["rank"]) for r in got)

    (once, first), (many, same) = run(1), run(12)
    assert first and first == same
    assert many < 2 * once
