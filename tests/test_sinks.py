"""Sinks and streams: what a reader of the written files sees."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from wearloom.operators import clean, features, joins, verdict
from wearloom.params import Params
from wearloom.sources import files

T0 = datetime(2024, 1, 1)
at = lambda s: T0 + timedelta(seconds=s)


def test_audit_table_has_few_files_in_order(spark, tmp_path):
    rows = [(f"M{0 if i % 10 else 1}", at((i * 37) % 5000), f"J{i % 7}", float(i)) for i in range(5000)]
    df = spark.createDataFrame(rows, "machine_id string, ts timestamp, job_id string, primary_score double").repartition(16)
    for fmt in ("parquet", "csv"):
        path = tmp_path / fmt
        files.write_scored(df, str(path), fmt)
        assert len(list(path.glob("machine_id=*/part-*"))) <= 4 + 1  # tasks and machines, not their product
    assert all(f.name.endswith(".csv.gz") for f in (tmp_path / "csv").glob("machine_id=*/part-*"))
    back = spark.read.schema("ts timestamp, job_id string, primary_score double, machine_id string").csv(str(tmp_path / "csv"), header=True)
    assert back.select(*df.columns).exceptAll(df).count() == 0 and back.count() == 5000
    for f in (tmp_path / "parquet").glob("machine_id=*/part-*"):
        times = [r.ts for r in spark.read.parquet(str(f)).collect()]
        assert times == sorted(times)
    files.write_scored(df, str(tmp_path / "cut"), "parquet", 1000)
    assert max(spark.read.parquet(str(f)).count() for f in (tmp_path / "cut").glob("machine_id=*/part-*")) <= 1000


def test_summary_and_diagnostics_come_back(spark, tmp_path):
    df = spark.createDataFrame([("J1", at(1.5), 1, "true", None), ("J2", at(2), 2, "false", "a; b")], "job_id string, start_time timestamp, rank int, flagged string, notes string")
    files.write_job_summary(df, str(tmp_path / "p"))
    files.write_job_summary(df, str(tmp_path / "c"), "csv")
    assert sorted(spark.read.parquet(str(tmp_path / "p")).collect()) == sorted(df.collect())
    assert sorted(map(str, spark.read.schema(df.schema).csv(str(tmp_path / "c"), header=True).collect())) == sorted(map(str, df.collect()))
    assert len(list((tmp_path / "c").glob("part-*"))) == 1
    facts = spark.createDataFrame([("cleaning", "power.kept", "5")], "stage string, metric string, value string")
    files.write_diagnostics(facts, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).select(*facts.columns).collect() == facts.collect()


def test_rows_without_a_key_share_no_window(spark):
    df = spark.createDataFrame([(None, "M", 1.0)] * 50 + [(at(1), "M", 2.0), (at(1), "M", 3.0)], "ts timestamp, machine_id string, power_kw double")
    tagged = clean.tag_power(df)
    assert {r[0]: r[1] for r in tagged.groupBy("dropped_by").count().collect()} == {"null": 50, "duplicate": 1, None: 1}
    rows = clean._first_of_each(df.withColumn("dropped_by", F.when(F.col("ts").isNull(), "null")), ["machine_id", "ts"], ["power_kw"], "duplicate")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "isnull" in plan.lower()


def test_raw_streams_give_the_verdicts_of_the_batch(spark, tmp_path):
    """Readings sent again and out of order, ones that come too late, and a restart in between."""
    from wearloom.jobs import stored
    from wearloom.streaming import job_stream

    log = spark.createDataFrame([(f"J{m}{i}", f"M{m}", f"P{i % 2}", 3.0, at(i * 1000), at(i * 1000 + 900 + 150 * (i == 2))) for m in (0, 1) for i in range(6)], "job_id string, machine_id string, part_type string, quantity double, start_time_aligned timestamp, end_time_aligned timestamp").cache()
    idle = spark.createDataFrame([("M0", 0.3), ("M1", 0.2)], "machine_id string, idle_baseline_kw double")
    rng, schema = np.random.default_rng(6), "ts timestamp, machine_id string, power_kw double"
    power = [(at(t + 0.25), f"M{m}", float(5 + rng.random())) for m in (0, 1) for t in range(-20, 6100, 10)]
    wear = lambda t, m: 1.8 if (t // 1000) % 6 == 3 and m else 1.0
    vib = [(at(t), f"M{m}", float(0.2 * wear(t, m) + 0.004 * rng.random()), float(0.62 * wear(t, m) ** 2)) for m in (0, 1) for t in range(0, 6100, 5)]
    p = spark.createDataFrame(power, schema)
    v = spark.createDataFrame(vib, "ts timestamp, machine_id string, vibration_rms_g double, vibration_peak_g double")
    bounds = {"power_kw": 50.0, "vibration_rms_g": 5.0, "vibration_peak_g": 9.0}
    detector, params = stored.detector(spark), Params(pair_tolerance_s=4.0)
    labelled = joins.assign_jobs(v, log, start="start_time_aligned", end="end_time_aligned")
    pairs = joins.pair_with_power(labelled, p, 4.0).where("job_id IS NOT NULL")
    cut = features.cutting_readings(features.reading_features(pairs, log, idle), params)
    want = {tuple(r) for r in verdict.job_flags(verdict.score_readings(cut, detector), params).select("job_id", "cutting_readings", F.round("wear_score", 9), "n_anomalous").collect()}
    judge = lambda batch: job_stream.judged(batch, log, idle, detector, params)

    def arrive(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def run():
        streams = [spark.readStream.schema(df.schema).parquet(str(tmp_path / n)) for n, df in (("p", p), ("v", v))]
        found = job_stream.paired_jobs(job_stream.usable_power(streams[0], bounds), job_stream.usable_vibration(streams[1], bounds), log, 4.0, "20 minutes")
        job_stream.write(found, judge, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(180)

    early = lambda rows, t: [r for r in rows if r[0] < at(t)]
    arrive("p", [*early(power, 3000), *power[:40]], p.schema)
    arrive("v", early(vib, 2900)[::-1], v.schema)
    run()
    arrive("p", [r for r in power if r[0] >= at(3000)] + power[250:300], p.schema)
    arrive("v", [r for r in vib if r[0] >= at(2900)] + [(at(40_000), "none", 1.0, 1.0)], v.schema)
    arrive("p", [(at(40_000), "none", 1.0), (None, "M0", 1.0)], p.schema)
    run()
    arrive("v", [(at(1002), "M0", 4.0, 8.0)], v.schema)  # its job has been judged
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {tuple(r) for r in got.select("job_id", "cutting_readings", F.round("wear_score", 9), "n_anomalous").collect()} == want
    assert got.count() == len(want) == 12 and {r.job_id for r in got.where("flagged").collect()} == {"J13"}


def test_run_from_exports_to_results(spark, tmp_path):
    """Both modes, what they write, and that no table is left in the shared folder."""
    from wearloom.functions.tables import shared_folder
    from wearloom.jobs import registry, wear
    from wearloom.jobs.registry import P

    views = registry.Views(spark, "/root/testdata/sf0.001")
    paths = {"power": views.exported(views.power_raw, "power", ts="timestamp"), "vibration": views.exported(views.vibration_raw, "vibration", ts="timestamp"), "production_log": views.exported(views.log_raw, "log", start_time="start_time", end_time="end_time")}
    import os

    before = set(os.listdir(shared_folder(spark)))
    params = Params(pair_tolerance_s=P.pair_tolerance_s, primary_model="ridge", min_readings_for_verdict=5)
    detector = wear.run(spark, paths, str(tmp_path / "a"), params)
    again = wear.run(spark, paths | {"detector": str(tmp_path / "a" / "detector")}, str(tmp_path / "b"), Params(**{**params.__dict__, "mode": "load"}))
    assert set(os.listdir(shared_folder(spark))) == before
    assert again["scale"] == detector["scale"] and again["primary"].power == detector["primary"].power
    one, two = (sorted(map(str, spark.read.parquet(str(tmp_path / x / "job_summary")).collect())) for x in "ab")
    assert one == two and len(one) > 5
    for x in "ab":
        assert spark.read.parquet(str(tmp_path / x / "scored_readings")).count() == detector["n_fit_readings"] > 0
        assert spark.read.json(str(tmp_path / x / "diagnostics")).where("metric = 'offset_s'").count() == 1
