"""Clock offset between the production log and the sensors, found from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wearloom.functions.columns import us
from wearloom.functions.tables import kept
from wearloom.operators.joins import BUCKET, bucket_of, merged_windows
from wearloom.params import Params


def bucket_sums(power: DataFrame) -> DataFrame:
    """(machine_id, bucket, n, kw): readings and their sum by machine and time bucket. Both searches
    begin with these sums, so they are written."""
    bucket = F.col(BUCKET) if BUCKET in power.columns else bucket_of(us("ts"))
    return kept(power.groupBy("machine_id", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum("power_kw").alias("kw")))


def machine_offset_scores(power: DataFrame, jobs: DataFrame, offsets_s: list[int], sums: DataFrame | None = None, pieces: int | None = None) -> DataFrame:
    """(machine_id, offset_s, lift): mean power inside jobs minus mean power outside, with the
    log shifted by each offset. Machines without jobs or with an empty side have no row.

    Boundary sweep: readings are not multiplied by offsets. Each window's start and end, per
    offset, is laid among the readings of its machine and bucket; running sums there plus the
    sums of earlier buckets (``bucket_sums``) give what lies before it. Starts sort before
    readings of the same time and ends after them, so both ends are inside. With ``pieces``,
    power is stored by machine and bucket in so many files, and only boundaries are exchanged.
    """
    sums = bucket_sums(power) if sums is None else sums
    shifts = F.explode(F.array(*[F.lit(int(o)) for o in offsets_s])).alias("offset_s")
    windows = merged_windows(jobs).select("machine_id", "win_from", "win_to", shifts)
    ends = F.explode(F.array(F.struct(F.col("win_from").alias("at"), F.lit(0).alias("kind")), F.struct(F.col("win_to").alias("at"), F.lit(2).alias("kind"))))
    edges = windows.select(F.col("machine_id").alias("_m"), "offset_s", ends.alias("end"))
    edges = edges.select("_m", (F.col("end.at") + F.col("offset_s").cast("long") * 1_000_000).alias("at"), "end.kind", "offset_s", F.lit(None).cast("double").alias("kw"))
    edges = edges.withColumn("_b", bucket_of(F.col("at")))
    if pieces:
        edges = edges.repartition(pieces, "_m", "_b")
    bucket = F.col(BUCKET) if BUCKET in power.columns else bucket_of(us("ts"))
    readings = power.select(F.col("machine_id").alias("_m"), us("ts").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("offset_s"), F.col("power_kw").cast("double").alias("kw"), bucket.alias("_b"))
    running = Window.partitionBy("_m", "_b").orderBy("at", "kind")
    rows = readings.unionByName(edges)
    rows = rows.withColumns({"run_n": F.sum((F.col("kind") == 1).cast("long")).over(running), "run_kw": F.sum("kw").over(running)})
    # Buckets that hold boundaries only have the sums before them, too.
    bare = edges.select(F.col("_m").alias("machine_id"), F.col("_b").alias("bucket")).distinct().select("*", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("kw"))
    totals = sums.unionByName(bare).groupBy("machine_id", "bucket").agg(F.sum("n").alias("n"), F.sum("kw").alias("kw"))
    earlier = Window.partitionBy("machine_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col("machine_id").alias("of"), "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base_n"), F.coalesce(F.sum("kw").over(earlier), F.lit(0.0)).alias("base_kw"))
    met = rows.where("kind <> 1").join(base, (F.col("_m") == F.col("of")) & (F.col("_b") == F.col("bucket")))
    sign = F.when(F.col("kind") == 2, 1).otherwise(-1)
    inside = met.groupBy(F.col("_m").alias("machine_id"), "offset_s").agg(
        F.sum(sign * (F.col("base_n") + F.col("run_n"))).alias("in_n"), F.sum(sign * (F.col("base_kw") + F.coalesce("run_kw", F.lit(0.0)))).alias("in_kw")
    )
    whole = sums.groupBy("machine_id").agg(F.sum("n").alias("all_n"), F.sum("kw").alias("all_kw"))
    joined = inside.join(whole, "machine_id").where("in_n > 0 AND in_n < all_n")
    return joined.select("machine_id", "offset_s", (F.col("in_kw") / F.col("in_n") - (F.col("all_kw") - F.col("in_kw")) / (F.col("all_n") - F.col("in_n"))).alias("lift"))


def offset_scores(by_machine: DataFrame, offsets_s: list[int]) -> DataFrame:
    """(offset_s, score): the unweighted mean of the machines' lifts; minus infinity without any."""
    spark = by_machine.sparkSession
    every = spark.createDataFrame([(int(o),) for o in offsets_s], "offset_s int")
    means = by_machine.groupBy("offset_s").agg(F.avg("lift").alias("score"))
    return every.join(means, "offset_s", "left").select("offset_s", F.coalesce("score", F.lit(float("-inf"))).alias("score"))


def coarse_offsets(p: Params = Params()) -> list[int]:
    return [k * p.coarse_step_s for k in range(-p.coarse_steps, p.coarse_steps + 1)]


def fine_offsets(best_s: int, p: Params = Params()) -> list[int]:
    return list(range(best_s - p.fine_span_s, best_s + p.fine_span_s + 1, p.fine_step_s))


def best(scores: DataFrame) -> DataFrame:
    """The row of the highest score, of equal ones the smallest offset."""
    return scores.orderBy(F.desc("score"), "offset_s").limit(1)


def estimate_offset(power: DataFrame, jobs: DataFrame, p: Params = Params(), pieces: int | None = None) -> int:
    """Seconds to add to the log's clock: coarse search, then fine around it. No reading leaves the
    executors; both searches share the sums by bucket."""
    sums = bucket_sums(power)
    search = lambda steps: best(offset_scores(machine_offset_scores(power, jobs, steps, sums, pieces), steps)).first()["offset_s"]
    return search(fine_offsets(search(coarse_offsets(p)), p))


def best_by_machine(by_machine: DataFrame) -> DataFrame:
    """(machine_id, offset_s, lift, all_agree)."""
    own = Window.partitionBy("machine_id").orderBy(F.desc("lift"), "offset_s")
    top = by_machine.withColumn("place", F.row_number().over(own)).where("place = 1").drop("place")
    agree = top.agg(F.count_distinct("offset_s")).first()[0] <= 1
    return top.withColumn("all_agree", F.lit(agree))


def alignment_report(scores: DataFrame) -> DataFrame:
    """One row: best offset, its lift, and the lift without a shift."""
    top = F.max_by("offset_s", F.struct("score", (-F.col("offset_s")).alias("o")))
    return scores.agg(top.alias("best_offset_s"), F.max("score").alias("lift_at_best"), F.max(F.when(F.col("offset_s") == 0, F.col("score"))).alias("lift_at_zero"))


def apply_offset(jobs: DataFrame, offset_s: float) -> DataFrame:
    """jobs with start_time_aligned and end_time_aligned."""
    moved = lambda c: F.timestamp_micros(us(c) + int(offset_s * 1e6))
    return jobs.withColumns({"start_time_aligned": moved("start_time"), "end_time_aligned": moved("end_time")})
