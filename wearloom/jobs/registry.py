"""Registered queries of the wear analytics, over sensor views of the given tables."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearloom.functions import selection
from wearloom.functions.columns import us
from wearloom.functions.tables import kept, shared_folder
from wearloom.jobs import oracle, stored, wear
from wearloom.operators import align, clean, evaluate, features, joins, linear, profile, robust, verdict
from wearloom.params import Params
from wearloom.sources import files, sensor_views
from wearloom.streaming import job_stream

#: The views' readings are minutes apart, so pairing looks half an hour around.
P = Params(pair_tolerance_s=1800.0)


def _r(df: DataFrame, *columns: str) -> DataFrame:
    """Columns in single precision, which the order of a sum does not reach. Decimal readings put
    means on ties of decimal places, so places are no measure to compare by. Raw readings and
    their extremes stay as they are."""
    return df.withColumns({c: _single(c) for c in columns})


def _single(column: str):
    return F.col(column).cast("float").cast("double")


def _us(df: DataFrame, **names: str) -> DataFrame:
    """Times as whole microseconds, so that both engines compare equal."""
    for old, new in (names or {"ts": "us"}).items():
        df = df.withColumn(new, us(old)).drop(*([old] if old != new else []))
    return df


def _once(build):
    """A method whose frame is built once per instance."""

    def get(self):
        if build.__name__ not in self.built:
            self.built[build.__name__] = build(self)
        return self.built[build.__name__]

    return get


class Views:
    """The tables of a folder, each stage built from those before it."""

    def __init__(self, spark: SparkSession, sf_dir: str, p: Params = P):
        self.spark, self.p, self.built = spark, p, {}
        self.power_raw = sensor_views.power(spark, sf_dir)
        self.vibration_raw = sensor_views.vibration(spark, sf_dir)
        self.log_raw = sensor_views.production_log(spark, sf_dir)

    @_once
    def power(self):
        return self.prepared().clean_power

    @_once
    def vibration(self):
        return self.prepared().clean_vibration

    @_once
    def jobs(self):
        return self.prepared().clean_jobs

    @_once
    def prepared(self) -> wear.Prepared:
        return wear.prepare(self.power_raw, self.vibration_raw, self.log_raw, self.p)

    @_once
    def metrics(self):
        return wear.per_job_metrics(self.prepared())

    @_once
    def cutting(self):
        return wear.cutting(self.prepared(), self.p)

    @_once
    def ratios(self):
        return evaluate.job_ratios(self.cutting())

    @_once
    def split(self):
        return evaluate.reference_split(self.ratios())

    @_once
    def lifts(self):
        return self._lifts(align.coarse_offsets(self.p))

    @_once
    def bucket_sums(self):
        return align.bucket_sums(self.prepared().stored_power)

    def _lifts(self, steps: list[int]) -> DataFrame:
        found = self.prepared()
        return align.machine_offset_scores(found.stored_power, self.jobs(), steps, self.bucket_sums(), found.pieces)

    @_once
    def scores(self):
        return align.offset_scores(self.lifts(), align.coarse_offsets(self.p))

    @_once
    def fine_scores(self):
        """Scores around the best coarse offset."""
        steps = align.fine_offsets(align.best(self.scores()).first()["offset_s"], self.p)
        return align.offset_scores(self._lifts(steps), steps)

    @_once
    def simple_scores(self):
        """A score without a model: log vibration per kW against its part's median, in MADs."""
        rows = self.cutting()
        medians = selection.medians(rows, ["part_type"], F.col("log_vib_per_kw"), "m").withColumnRenamed("part_type", "of")
        off = kept(rows.join(medians, F.col("part_type") == F.col("of")).withColumn("residual_g", F.col("log_vib_per_kw") - F.col("m")).drop("of", "m"))
        width = robust.NORMAL * selection.median(off, F.abs("residual_g"))
        off = off.withColumn("primary_score", F.col("residual_g") / width)
        off = off.withColumns({"primary_anomalous": F.col("primary_score") >= 6, "secondary_anomalous": F.col("peak_to_rms") >= 4})
        return off.withColumn("anomalous", F.col("primary_anomalous") & F.col("secondary_anomalous"))

    @_once
    def simple_judged(self):
        return evaluate.judged_jobs(self.metrics(), self.simple_scores(), self.p)

    @_once
    def loaded(self):
        """(summary, scored readings, detector) of a detector that was saved and loaded."""
        return wear.rank_wear(self.prepared(), stored.loading(self.p), stored.reread(self.spark, f"stored-{id(self)}"))

    def ranked(self, **params):
        return wear.rank_wear(self.prepared(), replace(self.p, **params))

    def exported(self, raw: DataFrame, name: str, **times: str) -> str:
        """raw written as an export: text only, times in ISO form; returns its path."""
        path = f"{shared_folder(self.spark)}/export-{name}-{id(self)}-{self.spark.sparkContext.applicationId}"
        text = {old: F.date_format(old, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") for old in times}
        raw.withColumns(text).withColumnsRenamed(times).write.mode("overwrite").csv(path, header=True)
        return path


def _reread_power(v: Views) -> DataFrame:
    return _us(clean.clean_power(files.load_power(v.spark, v.exported(v.power_raw, "power", ts="timestamp")), P))


def _reread_vibration(v: Views) -> DataFrame:
    return _us(clean.clean_vibration(files.load_vibration(v.spark, v.exported(v.vibration_raw, "vibration", ts="timestamp")), P))


def _reread_jobs(v: Views) -> DataFrame:
    log = files.load_production_log(v.spark, v.exported(v.log_raw, "log", start_time="start_time", end_time="end_time"))
    return _us(clean.clean_jobs(log, P), start_time="start_us", end_time="end_us")


def _cleaning_details(v: Views) -> DataFrame:
    found = v.prepared()
    tagged = ("power", found.tagged_power), ("vibration", found.tagged_vibration)
    power, vibration = (clean.cleaning_facts(df, name, found.bounds, wear.FENCED[name]) for name, df in tagged)
    return _r(power.unionByName(vibration), "bound")


def _scale_estimators(v: Views) -> DataFrame:
    rows = v.simple_scores()
    found = robust.robust_scales(rows, "residual_g", evaluate.SCALES)
    return v.spark.createDataFrame([tuple(float(np.float32(x)) for x in found.values())], ", ".join(f"{k} double" for k in found))


def _linear(v: Views, model: linear.Linear) -> DataFrame:
    rows = [("all", model.intercept, model.power), ("quantity", 0.0, model.quantity)] + [(f"part {k}", *x) for k, x in model.parts.items()]
    every = v.spark.createDataFrame([(a, float(b), float(c)) for a, b, c in rows], "term string, shift double, slope double")
    machines = model.machine_table().where("machine_id IS NOT NULL AND (shift <> 0 OR slope <> 0)")  # the first is in the intercept
    return every.unionByName(machines.select(F.concat(F.lit("machine "), "machine_id").alias("term"), "shift", "slope"))


def _scored(v: Views, **params) -> DataFrame:
    keep = ("job_id", "machine_id", "us", "primary_score", "secondary_score", "primary_anomalous", "secondary_anomalous", "anomalous")
    return _us(v.ranked(**params)[1]).select(*keep)


SECONDARIES = [("isolation_forest", 0.01), ("isolation_forest", 0.15), ("mahalanobis", 0.01), ("mahalanobis", 0.15), ("lof", 0.01), ("lof", 0.15)]
_flags = lambda v: v.simple_judged().select("job_id", "flagged").join(v.split().select("job_id", "reference_worn"), "job_id")

BUILT = {
    "clean_power": lambda v: _us(v.power()),
    "clean_vibration": lambda v: _us(v.vibration()),
    "clean_jobs": lambda v: _us(v.jobs(), start_time="start_us", end_time="end_us"),
    "upper_fence": lambda v: _r(_fence(v), "bound"),
    "cleaning_report": lambda v: (r := v.prepared().reports)[0].unionByName(r[1]).unionByName(r[2]),
    "cleaning_details": _cleaning_details,
    "sentinel_values": lambda v: (x := v.prepared().values)[0].unionByName(x[1]),
    "machines_left": lambda v: (x := v.prepared().machines)[0].unionByName(x[1]),
    "reread_power": _reread_power,
    "reread_vibration": _reread_vibration,
    "reread_jobs": _reread_jobs,
    "overlapping_jobs": lambda v: clean.overlapping_jobs(v.jobs()),
    "sampling_gaps": lambda v: _r(profile.sampling_gaps(v.prepared().stored_power, "power").unionByName(profile.sampling_gaps(v.prepared().stored_vibration, "vibration")), "median_s", "longest_gap_s"),
    "dropouts": lambda v: _r(profile.dropouts(v.prepared().stored_vibration), "gap_s"),
    "offset_scores": lambda v: _r(v.scores(), "score"),
    "best_offset": lambda v: _r(align.best(v.scores()), "score"),
    "fine_offset_scores": lambda v: _r(v.fine_scores(), "score"),
    "offset_by_machine": lambda v: _r(align.best_by_machine(v.lifts()), "lift"),
    "alignment_report": lambda v: _r(align.alignment_report(v.scores()), "lift_at_best", "lift_at_zero"),
    "labelled_power": lambda v: _us(v.prepared().power),
    "labelled_vibration": lambda v: _us(v.prepared().vibration),
    "in_any_window": lambda v: _in_any_window(v),
    "in_job_share": lambda v: _r(profile.in_job_share(v.prepared().vibration), "in_job_share"),
    "paired_readings": lambda v: _paired(v),
    "idle_baseline_min": lambda v: _r(v.prepared().idle, "idle_baseline_kw", "idle_share"),
    "idle_baseline_pct": lambda v: _r(features.idle_baseline(v.prepared().power, Params(idle_method="percentile")), "idle_baseline_kw", "idle_share"),
    "reading_features": lambda v: _features(v),
    "cutting_readings": lambda v: _r(_us(v.cutting().select("job_id", "machine_id", "ts", "net_power_kw")), "net_power_kw"),
    "job_power": lambda v: _r(features.job_power(v.prepared().power), "mean_power_raw_kw", "median_power_raw_kw"),
    "job_vibration": lambda v: _r(features.job_vibration(v.prepared().vibration), "mean_vibration_rms_g", "p95_vibration_rms_g"),
    "job_metrics": lambda v: _r(
        v.metrics().select("job_id", "machine_id", "part_type", "mean_power_kw", "peak_vibration_g", "idle_baseline_kw", "power_readings", "vibration_readings", "power_coverage", "vibration_coverage"),
        "mean_power_kw",
    ),
    "silent_jobs": lambda v: features.silent_jobs(v.metrics()),
    "quality_summary": lambda v: features.quality_facts(v.metrics()),
    "profile_tables": lambda v: _r(profile.table_profile(v.power_raw, "power").unionByName(profile.table_profile(v.vibration_raw, "vibration")).unionByName(profile.table_profile(v.log_raw, "production_log")), "null_share"),
    "duplicate_rows": lambda v: profile.duplicate_rows(v.power_raw, "power").unionByName(profile.duplicate_rows(v.vibration_raw, "vibration")),
    "value_counts": lambda v: profile.value_counts(v.log_raw, ["machine_id", "part_type", "operator"]),
    "numeric_summary": lambda v: _r(profile.numeric_summary(v.power(), "power_kw", ["machine_id"]), "mean", "std", "low", "high", "p01", "p05", "p25", "p50", "p75", "p95", "p99"),
    "numeric_summary_whole": lambda v: _r(profile.numeric_summary(v.power(), "power_kw"), "mean", "std", "low", "high", "p01", "p05", "p25", "p50", "p75", "p95", "p99"),
    "defect_counts": lambda v: profile.defect_counts(v.power_raw, v.vibration_raw, v.log_raw),
    "defect_values": lambda v: profile.defect_values(v.power_raw),
    "plausible_top": lambda v: profile.plausible_top(v.power_raw),
    "time_coverage": lambda v: profile.time_coverage({"power": (v.power_raw, "ts", "ts"), "vibration": (v.vibration_raw, "ts", "ts"), "production_log": (v.log_raw, "start_time", "end_time")}),
    "machine_sets": lambda v: profile.machine_sets({"power": v.power_raw, "vibration": v.vibration_raw, "production_log": v.log_raw}),
    "power_vib_corr": lambda v: _r(profile.power_vibration_correlation(v.cutting()), "correlation", "p05_kw", "p95_kw"),
    "sextile_spread": lambda v: _r(profile.sextile_spread(v.cutting()), "power_kw", "sd_rms", "sd_log_rms"),
    "sextile_ratios": lambda v: _r(profile.sextile_ratios(profile.sextile_spread(v.cutting())), "rms_ratio", "log_ratio"),
    "part_pivot": lambda v: _r(profile.part_pivot(v.cutting()), "median_ratio"),
    "job_ratios": lambda v: _r(v.ratios(), "ratio", "crest", "mean_power"),
    "robust_part_baseline": lambda v: _r(v.split().select("job_id", "part_type", "baseline", "rel", "reference_worn"), "baseline", "rel"),
    "reference_split": lambda v: (x := evaluate.split_summary(v.split())).transform(_r, *[c for c, kind in x.dtypes if kind == "double"]),
    "elevated_jobs": lambda v: _r(evaluate.elevated_jobs(v.split()).select("job_id", "machine_id", "part_type", "rel", "crest", "place"), "rel", "crest"),
    "elevated_crosstab": lambda v: evaluate.elevated_crosstab(v.split()),
    "job_progress": lambda v: _r(_us(evaluate.job_progress(v.cutting())), "progress"),
    "job_sequence": lambda v: evaluate.job_sequence(v.split(), v.jobs()),
    "worn_readings": lambda v: _us(evaluate.readings_of(v.cutting(), v.split(), True).select("job_id", "ts")),
    "healthy_readings": lambda v: _us(evaluate.readings_of(v.cutting(), v.split(), False).select("job_id", "ts")),
    "cell_moments": lambda v: _r(m := linear.cell_moments(v.cutting()), *m.columns[2:]),
    "scale_estimators": _scale_estimators,
    "scale_job_verdicts": lambda v: _r(evaluate.scale_job_verdicts(v.simple_scores(), v.split(), p=P), "f1"),
    "simple_job_verdicts": lambda v: _r(
        v.simple_judged().select("job_id", "cutting_readings", "wear_score", "n_anomalous", "anomalous_fraction", "assessable", "flagged", "rank", "mean_residual_g", "mean_vib_per_kw"),
        "wear_score", "anomalous_fraction", "mean_residual_g", "mean_vib_per_kw",
    ),
    "simple_top10": lambda v: _r(verdict.top(v.simple_judged().select("job_id", "wear_score", "rank")), "wear_score"),
    "confusion": lambda v: _r(evaluate.confusion(_flags(v)), "f1"),
    "decision_margin": lambda v: _r(evaluate.decision_margin(v.simple_judged()), "worst_flagged", "best_clear"),
    "top_overlap": lambda v: evaluate.top_overlap(v.simple_judged().where("wear_score IS NOT NULL"), v.split(), 11),
    "auc_by_rank": lambda v: _r(evaluate.rank_auc(v.cutting().join(v.split().select("job_id", "reference_worn"), "job_id"), "peak_to_rms", F.col("reference_worn")), "auc"),
    "spearman": lambda v: _r(evaluate.spearman(v.ratios(), "ratio", "crest"), "spearman"),
    # A saved detector of plain numbers, loaded as a later job loads one; results are read back from their sinks.
    "stored_scores": lambda v: _r(_us(v.loaded()[1]).select("job_id", "machine_id", "us", *STORED_SCORES, "primary_anomalous", "secondary_anomalous", "anomalous"), *STORED_SCORES),
    "stored_audit": lambda v: _r(_us(_audit(v)).select("job_id", "machine_id", "us", "primary_score", "anomalous"), "primary_score"),
    "stored_cuts": lambda v: _stored_cuts(v),
    "stored_job_summary": lambda v: _us(stored.reread_table(v.loaded()[0], f"summary-{id(v)}", files.write_job_summary), start_time="start_us", end_time="end_us").select(*STORED_SUMMARY),
    "stored_job_scores": lambda v: _r(evaluate.judged_jobs(v.metrics(), v.loaded()[1], v.p).select("job_id", *STORED_NUMBERS), *STORED_NUMBERS),
    "stored_top10": lambda v: verdict.top(v.loaded()[0]).select("job_id", "rank", "flagged"),
    "stored_confusion": lambda v: _r(evaluate.confusion(v.loaded()[0].select("job_id", (F.col("flagged") == "true").alias("flagged")).join(v.split().select("job_id", "reference_worn"), "job_id")), "f1"),
    "streamed_job_verdicts": lambda v: _streamed(v),
    "diagnostic_counts": lambda v: _diagnostic_counts(v),
    "fit_levels": lambda v: verdict.fit_metadata(v.spark, v.ranked(primary_model="ridge")[2]).where("metric IN ('n_fit_readings', 'machine', 'part_type', 'target')"),
    # Fitted models: no SQL; tests hold them against NumPy.
    "ridge_coefficients": lambda v: _linear(v, linear.fit_ridge(v.cutting())),
    "huber_coefficients": lambda v: _linear(v, linear.fit_huber(v.cutting())),
    "joint_huber_coefficients": lambda v: _linear(v, linear.fit_joint_huber(v.cutting())),
    "ransac_coefficients": lambda v: _linear(v, linear.fit_ransac(v.cutting())),
    "cross_validated_r2": lambda v: linear.cross_validated_r2(v.cutting(), PRIMARIES, p=P),
    "huber_mahalanobis_scores": lambda v: _scored(v, backend="iterated"),
    "joint_huber_determinant_scores": lambda v: _scored(v),
    "ridge_forest_scores": lambda v: _scored(v, primary_model="ridge", secondary_model="isolation_forest"),
    "ridge_lof_scores": lambda v: _scored(v, primary_model="ridge", secondary_model="lof"),
    "ridge_sampled_lof_scores": lambda v: _scored(v, primary_model="ridge", secondary_model="lof", backend="iterated"),
    "fit_metadata": lambda v: verdict.fit_metadata(v.spark, v.ranked(primary_model="ridge")[2]),
    "job_summary": lambda v: _us(v.ranked()[0], start_time="start_us", end_time="end_us"),
    "diagnostics": lambda v: wear.diagnostics(v.prepared()),
    "reloaded_scores": lambda v: _reloaded(v),
    "target_forms": lambda v: evaluate.target_form_comparison(v.cutting(), v.split(), PRIMARIES, P),
    "primary_comparison": lambda v: evaluate.primary_comparison(v.cutting(), v.split(), PRIMARIES, P),
    "rank_agreement": lambda v: evaluate.rank_agreement(v.cutting(), PRIMARIES, P)[0],
    "top_jobs_by_primary": lambda v: evaluate.rank_agreement(v.cutting(), PRIMARIES, P)[1],
    "secondary_comparison": lambda v: evaluate.secondary_comparison(v.cutting(), v.split(), SECONDARIES, P),
    "model_grid": lambda v: _grid(v),
    "grid_effects": lambda v: evaluate.grid_effects(_grid(v)),
}
PRIMARIES = ["ridge", "huber", "ransac"]
STORED_SCORES = ("predicted_rms_g", "residual_g", "primary_score", "secondary_score")
STORED_SUMMARY = (
    "job_id", "machine_id", "part_type", "operator", "quantity", "start_us", "end_us", "duration_s", "flagged", "rank", "cutting_readings", "n_primary_anomalous", "n_secondary_anomalous", "n_anomalous",
    "power_readings", "vibration_readings", "assessable", "notes",
)
STORED_NUMBERS = ("wear_score", "max_primary_sigma", "mean_primary_sigma", "median_primary_sigma", "anomalous_fraction", "mean_residual_g", "mean_vib_per_kw")


def _audit(v: Views) -> DataFrame:
    """The per-reading audit table, written as gzip CSV by machine and read again."""
    path = f"{shared_folder(v.spark)}/audit-{id(v)}-{v.spark.sparkContext.applicationId}"
    rows = v.loaded()[1].select("job_id", "machine_id", "ts", "primary_score", "anomalous")
    files.write_scored(rows, path, "csv")
    return v.spark.read.schema("job_id string, ts timestamp, primary_score double, anomalous boolean, machine_id string").csv(path, header=True)


def _streamed(v: Views) -> DataFrame:
    """Verdicts of the loaded detector over both raw sensor streams, run to their end: the raw
    rows arrive in files by time, and a reading of a later month ends the last jobs."""
    base = f"{shared_folder(v.spark)}/stream-{id(v)}-{v.spark.sparkContext.applicationId}"
    found = v.prepared()
    _, _, bounds = found.tagged_power, found.tagged_vibration, found.bounds
    last = max(x for x in v.power_raw.agg(F.max("ts")).union(v.vibration_raw.agg(F.max("ts"))).toPandas().iloc[:, 0] if x is not None)
    streams = {}
    for name, raw in (("power", v.power_raw), ("vibration", v.vibration_raw)):
        later = raw.limit(1).withColumns({"ts": F.lit(last) + F.expr("INTERVAL 60 DAYS"), "machine_id": F.lit("none")})
        values = {c: F.lit(1.0) for c in raw.columns if c not in ("ts", "machine_id")}
        raw.repartitionByRange(4, "ts").write.parquet(f"{base}/{name}")
        later.withColumns(values).write.mode("append").parquet(f"{base}/{name}")
        streams[name] = v.spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/{name}")
    detector = stored.reread(v.spark, f"stream-{id(v)}")
    pairs = job_stream.paired_jobs(job_stream.usable_power(streams["power"], bounds, v.p), job_stream.usable_vibration(streams["vibration"], bounds), found.jobs, v.p.pair_tolerance_s, "45 days")
    job_stream.write(pairs, lambda batch: job_stream.judged(batch, found.jobs, found.idle, detector, v.p), f"{base}/out", f"{base}/state").awaitTermination()
    rows = v.spark.read.parquet(f"{base}/out")
    return _r(rows.select("job_id", "cutting_readings", "wear_score", "n_primary_anomalous", "n_anomalous", "assessable", "flagged"), "wear_score")


def _stored_cuts(v: Views) -> DataFrame:
    """(contamination, threshold) of the loaded detector's second score over the readings it is applied to."""
    shares = [0.01, 0.15]
    cuts = selection.quantiles(v.loaded()[1], F.col("secondary_score"), [1 - s for s in shares])
    return _r(v.spark.createDataFrame(list(zip(shares, cuts or [None, None])), "contamination double, threshold double"), "threshold")


def _diagnostic_counts(v: Views) -> DataFrame:
    """The whole numbers of the diagnostics, from the file that they were written to."""
    path = f"{shared_folder(v.spark)}/diagnostics-{id(v)}-{v.spark.sparkContext.applicationId}"
    files.write_diagnostics(wear.diagnostics(v.prepared()), path)
    rows = v.spark.read.schema("stage string, metric string, value string").json(path)
    return rows.where("stage = 'alignment' OR (stage = 'cleaning' AND metric RLIKE '^(power|vibration|production_log)[.][a-z_]+$')")


def _grid(v: Views) -> DataFrame:
    return evaluate.model_grid(v.cutting(), v.split(), PRIMARIES, ["mad", "trimmed_mad"], SECONDARIES, P)


def _fence(v: Views) -> DataFrame:
    left = clean.tag_power(v.power_raw, P).where("dropped_by IS NULL OR dropped_by = 'sentinel'")
    return v.spark.createDataFrame([(clean.upper_fence(left, "power_kw", P.robust_outlier_iqr_multiple),)], "bound double")


def _reloaded(v: Views) -> DataFrame:
    """Scores of a detector that was saved and read again."""
    path = f"{shared_folder(v.spark)}/detector-{id(v)}-{v.spark.sparkContext.applicationId}"
    files.save_detector(v.spark, verdict.fit_detector(v.cutting(), replace(P, primary_model="ridge")), path)
    scored = verdict.score_readings(v.cutting(), files.load_detector(v.spark, path))
    return _us(scored).select("job_id", "machine_id", "us", "primary_score", "secondary_score", "anomalous")


def _in_any_window(v: Views) -> DataFrame:
    """Power readings inside any aligned job."""
    return _us(joins.in_any_window(v.prepared().stored_power, v.prepared().jobs, "start_time_aligned", "end_time_aligned").select("ts", "machine_id"))


def _paired(v: Views) -> DataFrame:
    return _us(v.prepared().paired.select("machine_id", "ts", "vibration_rms_g", "power_kw", F.col("pair_gap_us").alias("gap_us")))


def _features(v: Views) -> DataFrame:
    prepared = v.prepared()
    names = ("net_power_kw", "vib_per_kw", "peak_to_rms", "log_net_power_kw", "log_vibration_rms_g", "log_vib_per_kw")
    rows = features.reading_features(prepared.paired, prepared.jobs, prepared.idle)
    return _r(_us(rows.select("job_id", "machine_id", "ts", "part_type", "quantity", *names)), *names)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked verdicts of all jobs, with the clock offset found from the data and the default fit."""
    return Views(spark, sf_dir).ranked()[0]


def queries():
    return {name: (lambda spark, sf_dir, build=build: build(Views(spark, sf_dir))) for name, build in BUILT.items()}


def oracle_sql():
    return oracle.oracle_sql()
