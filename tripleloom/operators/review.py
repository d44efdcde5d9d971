"""Review states, document upserts and the source registry, as merges of tables with events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import carry_last, first_per_key


def apply_reviews(pending: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pending cases with the decision that reached them first; later ones find nothing to decide.

    decisions: case_id, decision, reviewer, comment, review_time.
    """
    valid = decisions.where(F.col("decision").isin("accepted", "rejected")).select(
        "case_id", "decision", "reviewer", "comment", "review_time"
    )
    first = first_per_key(valid, ["case_id"], ["review_time", "reviewer", "decision", "comment"])
    return pending.join(first, "case_id", "left").withColumn("status", F.coalesce("decision", F.lit("pending_review"))).drop("decision")


def upsert(table: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``table`` whose key is not in ``new``, and all of ``new``."""
    return table.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def apply_registry_events(registry: DataFrame, events: DataFrame) -> DataFrame:
    """Sources after delete, restore and purge events: active, trash or (dropped) gone.

    registry: source_id, state, …; events: source_id, seq, action.  A purge works
    only on a source in the trash, that is, when the last delete or restore before
    it is a delete; a purged source is gone for good.  Otherwise the last delete or
    restore decides.
    """
    moves = F.when(F.col("action").isin("delete", "restore"), F.col("action"))
    log = events.where(F.col("action").isin("delete", "restore", "purge")).select("source_id", "seq", "action", moves.alias("_move"))
    known = carry_last(log, ["source_id"], [F.col("seq")], ["_move"])
    purge = F.col("action") == "purge"
    fate = known.groupBy("source_id").agg(
        F.max(purge & F.coalesce(F.col("_move") == "delete", F.lit(False))).alias("_gone"),
        F.max(purge & F.col("_move").isNull()).alias("_early_purge"),
        F.max_by("_move", F.when(~purge, F.col("seq"))).alias("_last"),
    )
    state = (
        F.when(F.col("_gone") | (F.col("_early_purge") & (F.col("state") == "trash")), "gone")
        .when(F.col("_last") == "delete", "trash")
        .when(F.col("_last") == "restore", "active")
        .otherwise(F.col("state"))
    )
    joined = registry.join(fate, "source_id", "left").withColumn("state", state)
    return joined.drop("_gone", "_early_purge", "_last").where(F.col("state") != "gone")


def submit_import(registry: DataFrame, requests: DataFrame) -> DataFrame:
    """Registry after import submissions (source_id, pending_id, name, domain, kind, case_count, triple_count).

    A published source stays and gets a pending copy; a pending or new one is replaced.
    """
    columns = ["source_id", "name", "domain", "kind", "status", "case_count", "triple_count", "from_source_id"]
    base = registry.select(*[F.col(c).alias(f"_{c}") for c in columns])
    joined = requests.join(base, F.col("source_id") == F.col("_source_id"), "left")
    keep = F.coalesce(F.col("_status"), F.lit("")).isin("", "pending_review") == F.lit(False)

    def or_old(c: str):
        return F.coalesce(F.when(F.col(c) != "", F.col(c)), F.when(F.col(f"_{c}") != "", F.col(f"_{c}")))

    cases = F.coalesce(F.when(F.col("case_count") > 0, F.col("case_count")), F.col("_case_count"), F.lit(0)).cast("long")
    triples = F.coalesce(
        F.when(F.col("triple_count") > 0, F.col("triple_count")), F.when(F.col("triple_count").isNull(), F.col("case_count") * 3),
        F.col("_triple_count"), F.lit(0),
    ).cast("long")
    triples = F.when(triples > 0, triples).otherwise(F.coalesce("_triple_count", F.lit(0)).cast("long"))
    entries = joined.select(
        F.when(keep, F.col("pending_id")).otherwise(F.col("source_id")).alias("source_id"),
        F.coalesce(or_old("name"), F.when(keep, F.col("pending_id")).otherwise(F.col("source_id"))).alias("name"),
        F.coalesce(or_old("domain"), F.lit("")).alias("domain"),
        F.when(F.coalesce(F.col("kind"), F.lit("excel")) == "excel", F.coalesce(F.lower("_kind"), F.lit("excel"))).otherwise(F.col("kind")).alias("kind"),
        F.lit("pending_review").alias("status"), cases.alias("case_count"), triples.alias("triple_count"),
        F.when(keep, F.col("source_id")).alias("from_source_id"),
    )
    return upsert(registry.select(*columns), entries, ["source_id"])
