"""Registered queries of the operators: production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.plans.registry import Family

from . import bin_slack, byte_bpe, language_id, packing, ppm, prefix_trie, quality_classifier, quality_rules, sharding, simhash, structure_repair, topk, warc
from .common import read

FAMILY = Family()


@FAMILY.query("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, sf_dir, "documents"))


@FAMILY.query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(read(spark, sf_dir, "documents"))


@FAMILY.query("op4_sharding")
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


@FAMILY.query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@FAMILY.query("op3_byte_bpe")
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = byte_bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return byte_bpe.digests(byte_bpe.encode(read(spark, sf_dir, "documents"), vocabulary, with_decoded=True))


@FAMILY.query("op9_simhash_near_dedup")
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


@FAMILY.query("op8_warc_bundles", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
    t AS (SELECT payload_digest, max(page_id) AS target FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN target IS NULL OR target = page_id THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN target <> page_id THEN target END AS refers_to
    FROM d LEFT JOIN t USING (payload_digest)""")
def op8_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(read(spark, sf_dir, "pages")).drop("url")


@FAMILY.query("op5_quality_classifier")
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_classifier(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@FAMILY.query("op1_ppm_lm_scoring")
def op1_ppm_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.lm_scores(read(spark, sf_dir, "documents"))


@FAMILY.query("op2_exact_top_k", """
    WITH v AS (
        SELECT vec_id, CAST(list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS q FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p QUALIFY rank <= 20""")
def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@FAMILY.query("op11_minimum_bin_slack")
def op11_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_slack.minimum_slack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@FAMILY.query("op12_structure_repair")
def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair.structure_repair(read(spark, sf_dir, "conversations"))


@FAMILY.query("op13_prefix_trie", """
    WITH r AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, strlen(coalesce(text, '')) AS b,
            md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT conv_id, list({'k': k, 'b': b} ORDER BY turn NULLS FIRST, role, k) AS t FROM r GROUP BY conv_id),
    h AS (
        SELECT conv_id, t, conv_id - conv_id % 5 AS g, xor(list_reduce(
            list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
            lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)::UBIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)
        ), 4294967295::UBIGINT) % 9 AS h FROM own),
    s AS (SELECT a.conv_id, list_concat(coalesce(f.t[1:a.h], []), a.t[a.h + 1:]) AS t FROM h a LEFT JOIN own f ON f.conv_id = a.g),
    n AS (
        SELECT conv_id, len(t) AS size, d AS depth, md5(array_to_string(list_transform(t[1:d], lambda x: x.k), '')) AS p,
            CASE WHEN d > 0 THEN md5(array_to_string(list_transform(t[1:d - 1], lambda x: x.k), '')) END AS parent, CASE WHEN d > 0 THEN t[d].b ELSE 0 END AS b
        FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM s)),
    g AS (
        SELECT p, depth, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n, min(b) AS b,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256 FROM n GROUP BY p, depth),
    k AS (SELECT parent AS p, count(*) AS n_children FROM g WHERE parent IS NOT NULL GROUP BY parent),
    w AS (SELECT g.*, coalesce(k.n_children, 0) AS n_children FROM g LEFT JOIN k USING (p)),
    sub AS (
        SELECT a.p, count(*) FILTER (WHERE w.n_children = 0) AS n_leaves, CAST(sum((w.n - 1) * w.b) AS BIGINT) AS saved_tokens
        FROM w JOIN n a ON a.conv_id = w.conv_id AND a.depth <= w.depth GROUP BY a.p)
    SELECT w.conv_id, w.depth, up.conv_id AS parent_conv_id, w.n AS n_convs, w.n_children, sub.n_leaves, sub.saved_tokens, w.ends_sha256
    FROM w JOIN sub USING (p) LEFT JOIN g up ON up.p = w.parent""")
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))
