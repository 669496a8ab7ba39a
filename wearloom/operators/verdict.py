"""Scores of readings and the verdict per job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wearloom.functions import selection
from wearloom.functions.ranking import running_total
from wearloom.functions.tables import kept
from wearloom.operators.linear import fit_primary
from wearloom.operators.outliers import fit_secondary, with_outlier_score
from wearloom.operators.robust import robust_scale
from wearloom.params import Params


def fit_detector(cutting: DataFrame, p: Params = Params()) -> dict:
    """Both models, the centre and scale of the residuals, and what the fit saw. The centre is the
    plain median of the residuals. Machines' coefficients and densities are tables, all else
    plain values."""
    target, primary = p.target, fit_primary(cutting, p, p.target)
    rows = kept(primary.with_prediction(cutting, "fit").select(F.col(target).alias("y"), (F.col(target) - F.col("fit")).alias("residual")))
    seen = rows.agg(F.count("*").alias("n"), F.stddev_pop("residual").alias("std"), F.stddev_pop("y").alias("y_std")).first()
    centre = selection.median(rows, F.col("residual")) or 0.0
    scale = robust_scale(rows.withColumn("off", F.col("residual") - centre), "off", p.scale_estimator, p.scale_trim_sigma)
    return {
        "target": target, "primary": primary, "centre": centre, "scale": scale, "sigma_multiple": p.sigma_multiple, "one_sided": p.one_sided,
        "secondary": fit_secondary(cutting, p), "n_fit_readings": seen["n"], "residual_std": seen["std"], "backend": p.backend,
        "r2": 1 - (seen["std"] / seen["y_std"]) ** 2 if seen["y_std"] else None, "part_types": [r[0] for r in cutting.select("part_type").distinct().dropna().orderBy("part_type").collect()],
    }


def fit_metadata(spark: SparkSession, detector: dict) -> DataFrame:
    """(metric, value): what a detector was fitted to, a row per number, part type and machine."""
    numbers = ("backend", "target", "n_fit_readings", "r2", "centre", "scale", "residual_std", "sigma_multiple")
    primary, secondary = detector["primary"], detector["secondary"]
    rows = [(k, str(detector[k])) for k in numbers] + [("secondary", secondary["kind"]), ("threshold", str(secondary["threshold"])), ("rounds", str(primary.rounds))]
    rows += [("part_type", x) for x in detector["part_types"]]
    return spark.createDataFrame(rows, "metric string, value string").unionByName(primary.machines.where("machine_id IS NOT NULL").select(F.lit("machine").alias("metric"), F.col("machine_id").alias("value")))


def score_readings(readings: DataFrame, detector: dict) -> DataFrame:
    """readings with prediction, residual, both scores and flags. predicted_rms_g and
    residual_g are on the scale of the target, which is logarithmic by default. The primary
    score of a two-sided detector is the size of residual_sigma, which keeps its sign."""
    df = detector["primary"].with_prediction(readings, "predicted_rms_g").withColumn("residual_g", F.col(detector["target"]) - F.col("predicted_rms_g"))
    df = df.withColumn("residual_sigma", (F.col("residual_g") - detector["centre"]) / detector["scale"])
    df = df.withColumn("primary_score", F.col("residual_sigma") if detector["one_sided"] else F.abs("residual_sigma"))
    df = with_outlier_score(df, detector["secondary"])
    df = df.withColumns(
        {
            "primary_anomalous": F.col("primary_score") >= detector["sigma_multiple"],
            "secondary_anomalous": F.coalesce(F.col("secondary_score") >= F.lit(detector["secondary"]["threshold"]).cast("double"), F.lit(False)),
        }
    )
    return df.withColumn("anomalous", F.col("primary_anomalous") & F.col("secondary_anomalous"))


def job_flags(scored: DataFrame, p: Params = Params()) -> DataFrame:
    """Readings' scores and flags per job."""
    score = F.col("primary_score")
    flags = {f"n_{c}": F.count_if(F.col(c)) for c in ("primary_anomalous", "secondary_anomalous", "anomalous")}
    out = scored.groupBy("job_id").agg(
        F.count("*").alias("cutting_readings"), F.percentile(score, F.lit(p.score_quantile)).alias("wear_score"), F.max(score).alias("max_primary_sigma"),
        F.avg(score).alias("mean_primary_sigma"), F.median(score).alias("median_primary_sigma"), *[e.alias(c) for c, e in flags.items()],
        F.avg("residual_g").alias("mean_residual_g"), F.avg("vib_per_kw").alias("mean_vib_per_kw"),
    )
    return out.withColumn("anomalous_fraction", F.col("n_anomalous") / F.greatest("cutting_readings", F.lit(1)))


def _share(column: Column) -> Column:
    return F.concat(F.format_string("%.1f", column * 100), F.lit("%"))


def verdicts(jobs: DataFrame, p: Params = Params()) -> DataFrame:
    """jobs (metrics joined with flags) with assessable, flagged, rank and notes.

    Ranks are 1 to n by falling wear score of assessable jobs, the others after them, ties
    in the order of the log. Ranks are counted by ranges of that order, not in one task.
    """
    df = jobs.fillna(0, ["cutting_readings", "n_anomalous", "n_primary_anomalous", "n_secondary_anomalous"]).fillna(0.0, ["anomalous_fraction"])
    df = df.withColumn("assessable", F.col("cutting_readings") >= p.min_readings_for_verdict)
    df = df.withColumn("flagged", F.col("assessable") & (F.col("n_anomalous") >= p.min_anomalous_readings) & (F.col("anomalous_fraction") >= p.min_anomalous_fraction))
    masked = F.when(F.col("assessable"), F.col("wear_score"))
    order = [masked.desc_nulls_last(), F.col("machine_id"), F.col("start_time"), F.col("job_id")]
    df = running_total(df, order, F.lit(1), "rank").withColumn("rank", F.col("rank").cast("int"))
    flagged = F.concat(
        F.col("n_anomalous"), F.lit(" of "), F.col("cutting_readings"), F.lit(" cutting readings ("), _share(F.col("anomalous_fraction")),
        F.lit(f") are above the {p.sigma_multiple:g}-sigma baseline and by the second detector"),
    )
    alone = ~F.col("flagged") & F.col("assessable") & (F.col("n_primary_anomalous") > 0) & (F.col("n_anomalous") == 0)
    notes = F.concat_ws(
        "; ",
        F.when(F.col("data_quality_notes") != "", F.col("data_quality_notes")),
        F.when(~F.col("assessable"), F.concat(F.lit("no verdict with "), F.col("cutting_readings"), F.lit(" cutting readings"))),
        F.when(F.col("power_readings") == 0, F.lit("no power readings in the job")),
        F.when(F.col("vibration_readings") == 0, F.lit("no vibration readings in the job")),
        F.when(F.col("flagged"), flagged),
        F.when(alone, F.lit("first detector only; not flagged")),
    )
    return df.withColumn("notes", notes)


#: Columns of the summary, in order; those that every summary must have; those rounded to four places.
COLUMNS = (
    "job_id", "machine_id", "part_type", "operator", "quantity", "start_time", "end_time", "duration_s", "mean_power_kw", "peak_vibration_g", "wear_score", "flagged", "rank",
    "mean_power_raw_kw", "idle_baseline_kw", "mean_vibration_rms_g", "p95_vibration_rms_g", "cutting_readings", "n_primary_anomalous", "n_secondary_anomalous", "n_anomalous",
    "anomalous_fraction", "max_primary_sigma", "mean_primary_sigma", "mean_vib_per_kw", "power_readings", "vibration_readings", "assessable", "notes",
)
REQUIRED = ("job_id", "machine_id", "mean_power_kw", "peak_vibration_g", "wear_score", "flagged", "rank", "notes")
ROUNDED = (
    "mean_power_kw", "peak_vibration_g", "wear_score", "mean_power_raw_kw", "idle_baseline_kw", "mean_vibration_rms_g", "p95_vibration_rms_g", "max_primary_sigma",
    "mean_primary_sigma", "mean_vib_per_kw", "anomalous_fraction",
)


def job_summary(judged: DataFrame, columns=COLUMNS) -> DataFrame:
    """The output table: chosen columns, rounded, flags as text, in the order of rank."""
    pick = lambda c: F.round(c, 4).alias(c) if c in ROUNDED else F.col(c).cast("string").alias(c) if c == "flagged" else F.col(c)
    return judged.select(*[pick(c) for c in columns if c in judged.columns]).orderBy("rank", "job_id")


def top(summary: DataFrame, n: int = 10) -> DataFrame:
    return summary.orderBy("rank").limit(n)
