"""Idle baseline, reading features and per-job metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wearloom.functions import selection
from wearloom.functions.columns import quantiles
from wearloom.functions.tables import kept
from wearloom.params import Params


def idle_baseline(labelled_power: DataFrame, p: Params = Params()) -> DataFrame:
    """(machine_id, idle_baseline_kw, idle_share): minimum or percentile of readings outside
    jobs; machines without any take the value over all idle readings, or 0."""
    idle = F.when(F.col("job_id").isNull(), F.col("power_kw"))
    share = F.avg(F.col("job_id").isNull().cast("double"))
    if p.idle_method == "min":  # the least of the machines' minima: a row per machine, no second pass over readings
        low, every = F.min(idle), F.min("own").over(Window.partitionBy())
    else:
        low = quantiles(idle, [p.idle_percentile / 100], p.quantile_accuracy)[0] if p.quantile_accuracy else F.lit(None).cast("double")
        found = selection.quantiles(labelled_power, idle, [p.idle_percentile / 100]) if p.fallback_to_global else None
        every = F.lit(found[0] if found else None).cast("double")
    own = labelled_power.groupBy("machine_id").agg(low.alias("own"), share.alias("idle_share"))
    if p.idle_method == "percentile" and not p.quantile_accuracy:
        found = selection.by_group(labelled_power, ["machine_id"], idle, [p.idle_percentile / 100]).select(F.col("machine_id").alias("of"), F.col("q")[0].alias("own"))
        own = own.drop("own").join(found, F.col("machine_id").eqNullSafe(F.col("of")))
    fallback = [every] if p.fallback_to_global else []
    return own.select("machine_id", F.coalesce("own", *fallback, F.lit(0.0)).alias("idle_baseline_kw"), "idle_share")


def reading_features(paired: DataFrame, jobs: DataFrame, idle: DataFrame) -> DataFrame:
    """One row per in-job vibration reading with a paired power reading, with job context and derived measures."""
    context = jobs.select("job_id", "part_type", "quantity")
    rows = paired.where("job_id IS NOT NULL AND power_kw IS NOT NULL").join(context, "job_id", "left").join(idle.select("machine_id", "idle_baseline_kw"), "machine_id", "left")
    rows = rows.withColumn("net_power_kw", F.greatest(F.col("power_kw") - F.col("idle_baseline_kw"), F.lit(0.0)))
    rows = rows.withColumns(
        {
            "vib_per_kw": F.col("vibration_rms_g") / F.greatest("net_power_kw", F.lit(0.05)),
            "peak_to_rms": F.col("vibration_peak_g") / F.greatest("vibration_rms_g", F.lit(1e-6)),
            "log_net_power_kw": F.log(F.greatest("net_power_kw", F.lit(0.05))),
            "log_vibration_rms_g": F.log(F.greatest("vibration_rms_g", F.lit(1e-4))),
        }
    )
    return rows.withColumn("log_vib_per_kw", F.col("log_vibration_rms_g") - F.col("log_net_power_kw"))


def cutting_readings(readings: DataFrame, p: Params = Params()) -> DataFrame:
    return readings.where(F.col("net_power_kw") >= p.cutting_power_floor_kw)


def job_power(labelled: DataFrame) -> DataFrame:
    """Power statistics of each job; counts and sums are partly made before rows are dealt out."""
    return labelled.where("job_id IS NOT NULL").groupBy("job_id").agg(
        F.avg("power_kw").alias("mean_power_raw_kw"), F.median("power_kw").alias("median_power_raw_kw"), F.max("power_kw").alias("max_power_raw_kw"), F.count("*").alias("power_readings")
    )


def job_vibration(labelled: DataFrame) -> DataFrame:
    rms = F.col("vibration_rms_g")
    return labelled.where("job_id IS NOT NULL").groupBy("job_id").agg(
        F.max("vibration_peak_g").alias("peak_vibration_g"), F.avg(rms).alias("mean_vibration_rms_g"), F.percentile(rms, F.lit(0.95)).alias("p95_vibration_rms_g"),
        F.max(rms).alias("max_vibration_rms_g"), F.count("*").alias("vibration_readings"),
    )


def job_metrics(jobs: DataFrame, labelled_power: DataFrame, labelled_vibration: DataFrame, idle: DataFrame) -> DataFrame:
    """jobs with power and vibration statistics, net mean power and coverage."""
    df = jobs.join(job_power(labelled_power), "job_id", "left").join(job_vibration(labelled_vibration), "job_id", "left")
    df = df.join(idle.select("machine_id", "idle_baseline_kw"), "machine_id", "left")
    df = df.withColumn("mean_power_kw", F.col("mean_power_raw_kw") - F.col("idle_baseline_kw"))
    df = df.fillna(0, ["power_readings", "vibration_readings"])
    expected = F.greatest("duration_s", F.lit(1e-9))
    return df.withColumns({"power_coverage": F.round(F.col("power_readings") / expected, 3), "vibration_coverage": F.round(F.col("vibration_readings") / (2 * expected), 3)})


def quality_summary(metrics: DataFrame, p: Params = Params()) -> DataFrame:
    """One row of counts; the jobs themselves are rows of ``silent_jobs``."""
    return metrics.agg(
        F.count("*").alias("jobs"), F.count_if(F.col("power_readings") == 0).alias("jobs_without_power"), F.count_if(F.col("vibration_readings") == 0).alias("jobs_without_vibration"),
        F.count_if(F.col("vibration_readings") < p.min_readings_for_verdict).alias("jobs_below_min_readings"),
    )


def quality_facts(metrics: DataFrame, p: Params = Params()) -> DataFrame:
    """(counts of ``quality_summary``, job_id_without_sensor_data): a row without a job, then one for
    each job of ``silent_jobs``. Metrics are written once, as both read them."""
    metrics = kept(metrics.select("job_id", "machine_id", "power_readings", "vibration_readings"))
    counts = kept(quality_summary(metrics, p))
    silent = silent_jobs(metrics).select(F.col("job_id").alias("job_id_without_sensor_data"))
    return counts.withColumn("job_id_without_sensor_data", F.lit(None).cast("string")).unionByName(silent.crossJoin(F.broadcast(counts)))


def silent_jobs(metrics: DataFrame) -> DataFrame:
    """(job_id, machine_id, power_readings, vibration_readings) of jobs without readings of a sensor."""
    return metrics.where("power_readings = 0 OR vibration_readings = 0").select("job_id", "machine_id", "power_readings", "vibration_readings")
