"""Registered queries next to their oracle SQL on the smallest data set."""

import glob
import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__ as E  # noqa: E402
from tools.check_oracle import rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = E.queries(), E.oracle_sql()
QUICK = [
    "risk_scenarios", "classify_risk_default_rules", "risk_test_cases", "top_risks", "as_text_list", "parse_case_record", "lexical_tokens", "extract_json",
    "lock_triples", "grouped_triples", "sanitize_triples", "fuse_exact", "quality_report", "apply_corrections", "pending_add", "apply_pending",
    "search_cases", "retrieve_cases", "graph_projection_nodes", "combination_cases", "reverse_plan", "knn_by_label", "key_entities_structured",
    "lexical_triples", "shortest_paths", "evidence_edges_structured", "split_sections", "requirement_units", "topic_clusters", "apply_reviews",
    "read_cases", "stream_risk_counts", "tolerant_jsonl", "repair_text", "changed_pairs",
    "json_answers", "image_manifest", "jsonl_versions", "read_document_triples", "match_cases_many_to_many", "similar_cases", "fault_triage", "qa_answers",
    "match_signals", "skeleton_all_paths", "submit_import",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_entry_has_rows(spark):
    assert len(E.entry(spark).take(1)) == 1


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 120


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLES[name])
    want, cols = cur.fetchall(), [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, got) == rows_of(cols, want)
