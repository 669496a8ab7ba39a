"""Scoring of arriving readings with a saved detector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wearloom.operators import features, joins, verdict


def scored_stream(readings: DataFrame, jobs: DataFrame, idle: DataFrame, detector: dict, late: str = "10 minutes") -> DataFrame:
    """Scores of a stream of paired readings (ts, machine_id, vibration_rms_g, vibration_peak_g,
    power_kw). Re-sent readings are dropped while they are within the watermark, whose state
    is bounded by it; the production log is joined as a static table."""
    fresh = readings.withWatermark("ts", late).dropDuplicatesWithinWatermark(["machine_id", "ts"])
    labelled = joins.assign_jobs(fresh, jobs, start="start_time_aligned", end="end_time_aligned")
    return verdict.score_readings(features.cutting_readings(features.reading_features(labelled, jobs, idle)), detector)


def job_counts(scored: DataFrame) -> DataFrame:
    """Running counts per job."""
    return scored.groupBy("job_id").agg(F.count("*").alias("readings"), F.count_if("anomalous").alias("anomalous"))


def write(scored: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends each batch to the audit table; a batch that is repeated writes its own folder again."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return scored.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
