"""Two ingest flows as Structured Streaming over the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import fixed_values as V
from ..operators import versioning as I
from ..operators.rules import Rules, classify_risk
from ..session import checkpoint_dir, materialise
from ..sources.writers import current_version, read_version, write_version


def stream_risk(
    complaints: DataFrame, component_rules: Rules = V.COMPONENT_RULES, summary_rules: Rules = V.SUMMARY_RULES, keep=("vehicle_key",)
) -> DataFrame:
    """Running complaint counts per kept columns and risk scenario; write it in update or complete mode."""
    tagged = complaints.withColumn("risk_scenario", classify_risk("component", "summary", component_rules, summary_rules))
    return tagged.groupBy(*keep, "risk_scenario").agg(F.count(F.lit(1)).alias("complaint_count"))


def windowed_risk(complaints: DataFrame, time: str, delay: str, width: str, **rules) -> DataFrame:
    """Complaint counts per time window and scenario, final once the watermark has passed (append mode)."""
    tagged = complaints.withColumn("risk_scenario", classify_risk("component", "summary", **rules))
    return tagged.withWatermark(time, delay).groupBy(F.window(time, width), "risk_scenario").agg(F.count(F.lit(1)).alias("complaint_count"))


def apply_candidate(spark: SparkSession, candidate: DataFrame, root: str, version: int) -> None:
    """Diff a candidate triple table against the newest baseline and write the next version.

    A batch that is replayed after a failure finds its version already written and
    does nothing.
    """
    newest = current_version(spark, root)
    if newest is not None and newest >= version:
        return
    current = read_version(spark, root)
    if current is None:
        candidate = materialise(candidate)
        write_version(I.as_current(candidate), root, version)
        return
    # both versions move to their cases once
    candidate, current = (materialise(df.repartition("case_key"), "case_key") for df in (candidate, current))
    cand_index, cur_index = I.rebuild_index(candidate), I.rebuild_index(current)
    matches = materialise(I.match_cases(cand_index, cur_index))
    add, remove = I.diff(candidate, cand_index, current, cur_index, matches, hashes=False)
    add, remove = (materialise(df.drop("previous_case_fact_hashes", "incoming_case_fact_hashes"), "case_key") for df in (add, remove))
    changed = materialise(I.pending_changed(I.changed_pairs(remove, add), cand_index, matches), "case_key")
    triples, _ = I.apply_pending(current, add, remove, changed)
    write_version(triples, root, version)


def stream_diff_apply(candidates: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of candidate triples is one candidate version of the whole table."""
    checkpoint_dir(candidates.sparkSession)

    def step(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            apply_candidate(batch.sparkSession, batch, root, batch_id)

    return candidates.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
