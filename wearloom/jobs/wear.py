"""Jobs: from raw sensor history to one ranked verdict per job."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearloom.functions import tables
from wearloom.functions.tables import kept, released
from wearloom.operators import align, clean, evaluate, features, joins, verdict
from wearloom.params import Params
from wearloom.sources import files


#: Fenced columns of the sensors, and the rule that drops what lies above.
FENCED = {"power": {"power_kw": "sentinel"}, "vibration": {"vibration_rms_g": "rms_sentinel", "vibration_peak_g": "peak_sentinel"}}


class Prepared:
    """Cleaned, aligned and labelled tables, the clock offset found from the data, and what cleaning
    saw. Each is made when it is first asked for: a query over one sensor cleans one sensor."""

    def __init__(self, power: DataFrame, vibration: DataFrame, log: DataFrame, p: Params = Params()):
        self.raw, self.p, self.bounds, self.spark = {"power": power, "vibration": vibration, "log": log}, p, {}, power.sparkSession

    @cached_property
    def pieces(self) -> int:
        """Files of the stored readings; both sensors have as many, so that they meet in place."""
        return tables.pieces_for(self.raw["power"], self.raw["vibration"])

    @cached_property
    def _power_parts(self) -> tuple[DataFrame, DataFrame]:
        return clean.stored_power(self.raw["power"], self.p, self.bounds, self.pieces)

    @cached_property
    def _vibration_parts(self) -> tuple[DataFrame, DataFrame]:
        return clean.stored_vibration(self.raw["vibration"], self.p, self.bounds, self.pieces)

    @property
    def tagged_power(self) -> DataFrame:
        return clean.whole(*self._power_parts)

    @property
    def tagged_vibration(self) -> DataFrame:
        return clean.whole(*self._vibration_parts)

    @cached_property
    def tagged_jobs(self) -> DataFrame:
        return clean.tag_jobs(self.raw["log"], self.p)

    @property
    def stored_power(self) -> DataFrame:
        """Clean readings with their time bucket, stored by machine and bucket."""
        return self._power_parts[0].where("dropped_by IS NULL").drop("dropped_by")

    @property
    def stored_vibration(self) -> DataFrame:
        return self._vibration_parts[0].where("dropped_by IS NULL").drop("dropped_by")

    @property
    def clean_power(self) -> DataFrame:
        return self.stored_power.drop(joins.BUCKET)

    @property
    def clean_vibration(self) -> DataFrame:
        return self.stored_vibration.drop(joins.BUCKET)

    @cached_property
    def clean_jobs(self) -> DataFrame:
        return kept(self.tagged_jobs.where("dropped_by IS NULL").drop("dropped_by"))

    @cached_property
    def offset_s(self) -> int:
        return align.estimate_offset(self.stored_power, self.clean_jobs, self.p, self.pieces) if self.p.align_clocks else 0

    @cached_property
    def jobs(self) -> DataFrame:
        return align.apply_offset(self.clean_jobs, self.offset_s)

    def _labelled(self, readings: DataFrame) -> DataFrame:
        return joins.assign_jobs(readings, self.jobs, self.p.job_edge_trim_s, start="start_time_aligned", end="end_time_aligned")

    @cached_property
    def power(self) -> DataFrame:
        return self._labelled(self.stored_power).drop(joins.BUCKET)

    @cached_property
    def vibration(self) -> DataFrame:
        return self._labelled(self.stored_vibration).drop(joins.BUCKET)

    @cached_property
    def paired(self) -> DataFrame:
        """Labelled vibration readings with the nearest power reading."""
        return joins.pair_with_power(self._labelled(self.stored_vibration), self.stored_power, self.p.pair_tolerance_s, pieces=self.pieces)

    @cached_property
    def idle(self) -> DataFrame:
        return features.idle_baseline(self.power, self.p)

    @cached_property
    def reports(self) -> list[DataFrame]:
        """Rows per rule of the three sources, then the fences of both sensors."""
        tagged = (self.tagged_power, "power"), (self.tagged_vibration, "vibration"), (self.tagged_jobs, "production_log")
        return [clean.cleaning_report(df, name) for df, name in tagged] + [
            clean.cleaning_details(self.tagged_power, "power", self.bounds, FENCED["power"]),
            clean.cleaning_details(self.tagged_vibration, "vibration", self.bounds, FENCED["vibration"]),
        ]

    @property
    def values(self) -> list[DataFrame]:
        """The values above the fences, a row each."""
        return [clean.sentinel_values(df, name, FENCED[name]) for df, name in ((self.tagged_power, "power"), (self.tagged_vibration, "vibration"))]

    @property
    def machines(self) -> list[DataFrame]:
        """The machines of the readings that are left, a row each."""
        return [clean.machines_left(df, name) for df, name in ((self.tagged_power, "power"), (self.tagged_vibration, "vibration"))]


def prepare(power: DataFrame, vibration: DataFrame, log: DataFrame, p: Params = Params()) -> Prepared:
    """Clean, find the clock offset from the data, label both sensors with their jobs, idle baseline."""
    return Prepared(power, vibration, log, p)


def diagnostics(prepared: Prepared) -> DataFrame:
    """(stage, metric, value): rows kept and dropped, fences and sentinels, offset, idle baselines, jobs without data."""
    report = lambda df: df.select(F.lit("cleaning").alias("stage"), F.concat_ws(".", "source", "rule").alias("metric"), F.col("rows").cast("string").alias("value"))

    def detail(df: DataFrame) -> DataFrame:
        facts = F.array(*[F.struct(F.concat_ws(".", "source", "column", F.lit(c)).alias("metric"), F.col(c).cast("string").alias("value")) for c in ("bound", "sentinels")])
        return df.select(F.lit("cleaning").alias("stage"), F.explode(facts).alias("x")).select("stage", "x.*")

    out = [report(df) if "rule" in df.columns else detail(df) for df in prepared.reports]
    out += [df.select(F.lit("cleaning").alias("stage"), F.concat_ws(".", "source", "column", F.lit("value")).alias("metric"), F.col("value").cast("string").alias("value")) for df in prepared.values]
    out += [df.select(F.lit("cleaning").alias("stage"), F.concat_ws(".", "source", F.lit("machine"), F.lit("left")).alias("metric"), F.col("machine_id").alias("value")) for df in prepared.machines]
    spark = prepared.spark
    out.append(spark.createDataFrame([("alignment", "offset_s", str(prepared.offset_s))], "stage string, metric string, value string"))
    out.append(prepared.idle.select(F.lit("idle").alias("stage"), F.col("machine_id").alias("metric"), F.col("idle_baseline_kw").cast("string").alias("value")))
    metrics = kept(per_job_metrics(prepared))
    quality = features.quality_summary(metrics)
    out.append(features.silent_jobs(metrics).select(F.lit("quality").alias("stage"), F.lit("job_without_sensor_data").alias("metric"), F.col("job_id").alias("value")))
    facts = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in quality.columns])
    out.append(quality.select(F.lit("quality").alias("stage"), F.explode(facts).alias("x")).select("stage", "x.*"))
    first, *rest = out
    for df in rest:
        first = first.unionByName(df)
    return first


def per_job_metrics(prepared: Prepared) -> DataFrame:
    return features.job_metrics(prepared.jobs, prepared.power, prepared.vibration, prepared.idle)


def cutting(prepared: Prepared, p: Params = Params()) -> DataFrame:
    """Readings with features, above the floor; fits read them again and again, so they are written once."""
    return kept(features.cutting_readings(features.reading_features(prepared.paired, prepared.jobs, prepared.idle), p))


def rank_wear(prepared: Prepared, p: Params = Params(), detector: dict | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """(summary per job, scored readings, detector). With a saved detector nothing is fitted;
    levels that it has not seen fall back to the common slope."""
    rows = cutting(prepared, p)
    detector = verdict.fit_detector(rows, p) if detector is None else detector
    scored = verdict.score_readings(rows, detector)
    return verdict.job_summary(evaluate.judged_jobs(per_job_metrics(prepared), scored, p)), scored, detector


def run(spark: SparkSession, paths: dict[str, str], out: str, p: Params = Params()) -> dict:
    """From exports to the summary, the audit table, the diagnostics and the detector, which is
    returned as it was saved. In mode "load" the detector under paths["detector"] scores, and
    nothing is fitted. Tables that cut lineage are removed at the end."""
    with released(spark):
        raw = files.load_power(spark, paths["power"]), files.load_vibration(spark, paths["vibration"]), files.load_production_log(spark, paths["production_log"])
        prepared = prepare(*raw, p)
        summary, scored, detector = rank_wear(prepared, p, files.load_detector(spark, paths["detector"]) if p.mode == "load" else None)
        files.write_job_summary(summary, f"{out}/job_summary")
        files.write_scored(scored, f"{out}/scored_readings")
        files.write_diagnostics(diagnostics(prepared), f"{out}/diagnostics")
        files.save_detector(spark, detector, f"{out}/detector")
    return files.load_detector(spark, f"{out}/detector")
