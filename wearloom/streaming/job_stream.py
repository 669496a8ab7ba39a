"""Raw sensor streams to one verdict per job.

Both raw streams are labelled with the job of the production log that a reading lies in, power
readings also with jobs that they lie near. State is kept per job: its readings, until the
watermark has passed its end. Then re-sent readings are dropped, each vibration reading is
paired with the nearest power reading, and all of the job's pairs leave together, once. So what
follows (features, scores, the verdict) is the batch code over whole jobs.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wearloom.functions.columns import us
from wearloom.operators import features, verdict
from wearloom.operators.joins import HOUR
from wearloom.params import Params

PAIRED = "job_id string, machine_id string, ts timestamp, vibration_rms_g double, vibration_peak_g double, power_kw double"


def usable_power(power: DataFrame, bounds: dict[str, float], p: Params = Params()) -> DataFrame:
    """Readings that the cleaning rules leave, with the fences found in a batch."""
    kw = F.col("power_kw")
    return power.where(F.col("ts").isNotNull() & F.col("machine_id").isNotNull() & (kw >= p.power_min_kw) & (kw <= bounds["power_kw"]))


def usable_vibration(vibration: DataFrame, bounds: dict[str, float]) -> DataFrame:
    rms, peak = F.col("vibration_rms_g"), F.col("vibration_peak_g")
    inside = (rms >= 0) & (peak >= rms) & (rms <= bounds["vibration_rms_g"]) & (peak <= bounds["vibration_peak_g"])
    return vibration.where(F.col("ts").isNotNull() & F.col("machine_id").isNotNull() & inside)


def _spans(jobs: DataFrame, pad_us: int, start: str, end: str, bucket_us: int) -> DataFrame:
    """(machine, bucket, job, from, to, closes_ms): where readings count for a job, a row per time
    bucket. A job counts up to the next one's start, as in a batch."""
    own = Window.partitionBy("machine_id").orderBy("job_from", "job_id")
    spans = jobs.select("machine_id", "job_id", us(start).alias("job_from"), us(end).alias("job_to")).withColumn("next_from", F.lead("job_from").over(own)).where("job_to >= job_from")
    last = F.least(F.col("job_to"), F.coalesce(F.col("next_from") - 1, F.col("job_to")))
    spans = spans.select("machine_id", "job_id", (F.col("job_from") - pad_us).alias("a"), (last + pad_us).alias("z"), F.col("job_to"))
    bucket = lambda c: F.floor(F.col(c) / bucket_us).cast("long")
    return spans.where("z >= a").select(*[F.col(c).alias(f"_{c}") for c in ("machine_id", "job_id", "a", "z", "job_to")], F.explode(F.sequence(bucket("a"), bucket("z"))).alias("_bucket"))


def _labelled(readings: DataFrame, spans: DataFrame, bucket_us: int, kind: int, *values: str) -> DataFrame:
    at = us(readings["ts"])
    met = readings.join(spans, (readings["machine_id"] == F.col("_machine_id")) & (F.floor(at / bucket_us).cast("long") == F.col("_bucket")) & at.between(F.col("_a"), F.col("_z")))
    own = [F.col(c).cast("double") for c in values] + [F.lit(None).cast("double")] * (2 - len(values))
    return met.select(F.col("_job_id").alias("job_id"), readings["machine_id"], readings["ts"], at.alias("at"), F.lit(kind).alias("kind"), own[0].alias("a"), own[1].alias("b"), F.col("_job_to").alias("job_to"))


def nearest_power(rows: np.ndarray, tolerance_us: int) -> pd.DataFrame:
    """Pairs of a job's rows (at, kind, a, b; kind 1 is power): of readings sent again the least
    value counts; the nearest power within the tolerance, of two equally near the earlier."""
    rows = rows[np.lexsort((rows["b"], rows["a"], rows["at"], rows["kind"]))]
    first = np.r_[True, (rows["at"][1:] != rows["at"][:-1]) | (rows["kind"][1:] != rows["kind"][:-1])] if len(rows) else np.zeros(0, bool)
    rows = rows[first]
    vib, power = rows[rows["kind"] == 0], rows[rows["kind"] == 1]
    if not len(vib) or not len(power):
        return pd.DataFrame({"at": [], "a": [], "b": [], "kw": []})
    after = np.searchsorted(power["at"], vib["at"])
    low, high = np.maximum(after - 1, 0), np.minimum(after, len(power) - 1)
    back, ahead = np.abs(vib["at"] - power["at"][low]), np.abs(power["at"][high] - vib["at"])
    take = np.where(back <= ahead, low, high)
    near = np.abs(power["at"][take] - vib["at"]) <= tolerance_us
    return pd.DataFrame({"at": vib["at"][near], "a": vib["a"][near], "b": vib["b"][near], "kw": power["a"][take][near]})


def paired_jobs(power: DataFrame, vibration: DataFrame, jobs: DataFrame, tolerance_s: float = 1.0, late: str = "10 minutes", start: str = "start_time_aligned", end: str = "end_time_aligned", bucket_us: int = 6 * HOUR) -> DataFrame:
    """(job_id, machine_id, ts, vibration_rms_g, vibration_peak_g, power_kw): all pairs of a job in
    one batch, when the watermark has passed its end and the tolerance. Later readings of it are
    late and dropped. State is a job's readings, and ends with it."""
    tol = int(tolerance_s * 1e6)
    spans = lambda pad: _spans(jobs, pad, start, end, bucket_us)
    rows = _labelled(vibration.withWatermark("ts", late), spans(0), bucket_us, 0, "vibration_rms_g", "vibration_peak_g")
    rows = rows.unionByName(_labelled(power.withWatermark("ts", late), spans(tol), bucket_us, 1, "power_kw"))
    kinds = [("at", "<i8"), ("kind", "<i4"), ("a", "<f8"), ("b", "<f8")]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            machine, blocks = pickle.loads(state.get[0])
            state.remove()
            pairs = nearest_power(np.frombuffer(blocks, kinds), tol)
            ts = pd.to_datetime(pairs["at"].astype("int64"), unit="us")
            yield pd.DataFrame({"job_id": key[0], "machine_id": machine, "ts": ts, "vibration_rms_g": pairs["a"], "vibration_peak_g": pairs["b"], "power_kw": pairs["kw"]})
            return
        machine, blocks = pickle.loads(state.get[0]) if state.exists else (None, b"")
        closes = 0
        for frame in frames:
            if len(frame):
                own = np.empty(len(frame), kinds)
                for name, _ in kinds:
                    own[name] = frame[name].to_numpy()
                blocks += own.tobytes()
                machine, closes = frame["machine_id"].iloc[0], int(frame["job_to"].iloc[0])
        state.update((pickle.dumps((machine, blocks)),))
        state.setTimeoutTimestamp(max((closes + tol) // 1000 + 1, state.getCurrentWatermarkMs() + 1))

    return rows.groupBy("job_id").applyInPandasWithState(step, PAIRED, "rows binary", "append", GroupStateTimeout.EventTimeTimeout)


def judged(pairs: DataFrame, jobs: DataFrame, idle: DataFrame, detector: dict, p: Params = Params()) -> DataFrame:
    """(job_id, scores and flags, assessable, flagged) of the jobs whose pairs these are, by the
    code of the batch."""
    scored = verdict.score_readings(features.cutting_readings(features.reading_features(pairs, jobs, idle), p), detector)
    flags = verdict.job_flags(scored, p)
    return flags.withColumn("assessable", F.col("cutting_readings") >= p.min_readings_for_verdict).withColumn(
        "flagged", F.col("assessable") & (F.col("n_anomalous") >= p.min_anomalous_readings) & (F.col("anomalous_fraction") >= p.min_anomalous_fraction)
    )


def write(pairs: DataFrame, judge: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends each batch's verdicts; a batch that is repeated writes its own folder again."""

    def save(batch: DataFrame, number: int) -> None:
        judge(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pairs.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
