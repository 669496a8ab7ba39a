"""Interval labelling and nearest-in-time pairing, dealt out by machine and time bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearloom.functions.columns import us

HOUR = 3_600_000_000

#: Column and length of the time buckets by which cleaned readings are stored. A frame with the
#: column is laid out by machine and bucket: what follows keeps to these buckets, and its
#: readings are not exchanged again.
BUCKET, BUCKET_US = "_bucket", 6 * HOUR


def bucket_of(at: Column, bucket_us: int = BUCKET_US) -> Column:
    return F.floor(at / bucket_us).cast("long")


def _buckets(readings: DataFrame, bucket_us: int) -> tuple[Column, int]:
    """Bucket of a reading, and the length of the buckets: the stored ones where there are."""
    return (F.col(BUCKET), BUCKET_US) if BUCKET in readings.columns else (bucket_of(us("ts"), bucket_us), bucket_us)


def assign_jobs(readings: DataFrame, jobs: DataFrame, edge_trim_s: float = 0.0, bucket_us: int = BUCKET_US, start: str = "start_time", end: str = "end_time") -> DataFrame:
    """readings with job_id: of the jobs of a machine whose trimmed start is not after the
    reading the latest-starting one, if the reading is not after its trimmed end; else null.

    A job counts only up to the next one's start, so a reading meets one job at most. Jobs
    are repeated for the buckets that they touch, which gives the join equal keys: no
    machine's readings have to be in one task.
    """
    trim = int(edge_trim_s * 1e6)
    own = Window.partitionBy("machine_id").orderBy("job_from", "job_id")
    spans = jobs.select("machine_id", "job_id", (us(start) + trim).alias("job_from"), (us(end) - trim).alias("job_to"))
    spans = spans.withColumn("next_from", F.lead("job_from").over(own)).where("job_to >= job_from")
    own_bucket, bucket_us = _buckets(readings, bucket_us)
    spans = spans.withColumn("bucket", F.explode(F.sequence(bucket_of(F.col("job_from"), bucket_us), bucket_of(F.col("job_to"), bucket_us))))
    spans = spans.select(*[F.col(c).alias(f"_{c}") for c in ("machine_id", "bucket", "job_id", "job_from", "job_to", "next_from")]).withColumnRenamed("_bucket", "_of")
    at = readings.withColumn("_us", us("ts")).withColumn("_at", own_bucket)
    inside = (F.col("_us") >= F.col("_job_from")) & (F.col("_us") <= F.col("_job_to")) & (F.col("_next_from").isNull() | (F.col("_us") < F.col("_next_from")))
    joined = at.join(spans, (at["machine_id"] == F.col("_machine_id")) & (F.col("_at") == F.col("_of")) & inside, "left")
    return joined.select(*[at[c] for c in readings.columns], F.col("_job_id").alias("job_id"))


def merged_windows(jobs: DataFrame, start: str = "start_time", end: str = "end_time") -> DataFrame:
    """(machine_id, win_from, win_to) in microseconds: the union of a machine's jobs, ends included."""
    own = Window.partitionBy("machine_id").orderBy("a", "b")
    rows = jobs.select("machine_id", us(start).alias("a"), us(end).alias("b"))
    reach = F.max("b").over(own.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("opens", F.when(F.col("a") <= reach, 0).otherwise(1)).withColumn("island", F.sum("opens").over(own))
    return rows.groupBy("machine_id", "island").agg(F.min("a").alias("win_from"), F.max("b").alias("win_to")).drop("island")


def in_any_window(readings: DataFrame, jobs: DataFrame, start: str = "start_time", end: str = "end_time", bucket_us: int = 24 * HOUR) -> DataFrame:
    """The readings that lie in any job of their machine, ends included, each once however many
    jobs overlap there. Merged windows are repeated for the buckets that they touch."""
    own_bucket, bucket_us = _buckets(readings, bucket_us)
    windows = merged_windows(jobs, start, end).withColumn("of", F.explode(F.sequence(bucket_of(F.col("win_from"), bucket_us), bucket_of(F.col("win_to"), bucket_us))))
    windows = windows.select(*[F.col(c).alias(f"_{c}") for c in windows.columns])
    inside = us(readings["ts"]).between(F.col("_win_from"), F.col("_win_to"))
    return readings.join(windows, (readings["machine_id"] == F.col("_machine_id")) & (own_bucket == F.col("_of")) & inside, "left_semi")


def pair_with_power(vibration: DataFrame, power: DataFrame, tolerance_s: float = 1.0, bucket_us: int = BUCKET_US, pieces: int | None = None) -> DataFrame:
    """vibration with power_kw and pair_gap_us of the machine's power reading nearest in time,
    within the tolerance (its end included), the earlier one of two equally near; else null.

    Both tables meet by machine and time bucket; power readings within the tolerance of a
    bucket's edge are also given to the neighbour. With ``pieces`` both are stored by machine
    and bucket in so many files, and only the readings at the edges are exchanged.
    """
    tol = int(tolerance_s * 1e6)
    own_bucket, bucket_us = _buckets(vibration, bucket_us)
    extra = [c for c in vibration.columns if c not in ("machine_id", "ts", BUCKET)]
    left = vibration.select(F.col("machine_id").alias("_m"), own_bucket.alias("_b"), us("ts").alias("at"), F.struct("ts", *extra).alias("row"), F.lit(None).cast("struct<at:bigint,kw:double>").alias("p"))
    at, row = us("ts"), F.lit(None).cast(left.schema["row"].dataType).alias("row")
    own_bucket = F.col(BUCKET) if BUCKET in power.columns and BUCKET in vibration.columns else bucket_of(at, bucket_us)
    right = power.select(F.col("machine_id").alias("_m"), own_bucket.alias("_b"), at.alias("at"), row, F.struct(at.alias("at"), F.col("power_kw").cast("double").alias("kw")).alias("p"))
    first, last = bucket_of(F.col("at") - tol, bucket_us), bucket_of(F.col("at") + tol, bucket_us)
    others = F.array_except(F.sequence(first, last), F.array("_b"))
    edges = right.where((first != F.col("_b")) | (last != F.col("_b"))).select("_m", F.explode(others).alias("_b"), "at", "row", "p")
    if pieces:
        edges = edges.repartition(pieces, "_m", "_b")
    both = left.unionByName(right).unionByName(edges)
    own = Window.partitionBy("_m", "_b").orderBy("at")
    found = both.select(
        "_m", "at", "row",
        F.last("p", True).over(own.rangeBetween(-tol, 0)).alias("before"),
        F.first("p", True).over(own.rangeBetween(0, tol)).alias("after"),
    ).where("row IS NOT NULL")
    back, ahead = F.col("at") - F.col("before.at"), F.col("after.at") - F.col("at")
    use_back = ahead.isNull() | (back <= ahead)
    return found.select(
        "row.ts", F.col("_m").alias("machine_id"), *[f"row.{c}" for c in extra],
        F.when(use_back, F.col("before.kw")).otherwise(F.col("after.kw")).alias("power_kw"),
        F.when(use_back, back).otherwise(ahead).alias("pair_gap_us"),
    )
