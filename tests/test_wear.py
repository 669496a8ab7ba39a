"""Rules of the wear operators on small rows, and fits against NumPy."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearloom.functions import selection
from wearloom.functions.columns import us
from wearloom.operators import align, clean, evaluate, features, joins, linear, outliers, robust, verdict
from wearloom.params import Params
from wearloom.sources import files

T0 = datetime(2024, 1, 1)
at = lambda s: T0 + timedelta(seconds=s)
JOB = "job_id string, machine_id string, part_type string, operator string, quantity double, start_time timestamp, end_time timestamp"


def job(i, machine, a, b, part="P", quantity=1.0):
    return (f"J{i}", machine, part, "op", quantity, at(a), at(b))


def test_cleaning_rules_in_order(spark):
    rows = [(at(i), "M0", 5.0 + i % 3) for i in range(40)] + [(at(0), "M0", 5.0), (at(41), "M0", -3.0), (at(42), "M0", 9999.0), (at(43), "M0", None), (None, "M0", 1.0)]
    tagged = clean.tag_power(spark.createDataFrame(rows, "ts timestamp, machine_id string, power_kw double"))
    report = {r.rule: r["rows"] for r in clean.cleaning_report(tagged, "power").collect()}
    assert report == {"kept": 40, "duplicate": 1, "negative": 1, "sentinel": 1, "null": 2}
    empty = tagged.drop("dropped_by").limit(0)
    assert clean.clean_power(empty).count() == 0 and clean.upper_fence(empty, "power_kw", 50) == float("inf")


def test_jobs_are_repaired(spark):
    rows = [job(1, "M0", 100, 0), job(2, "M0", 0, 0), job(3, "M0", 50, 90, quantity=None), job(3, "M0", 60, 90), ("J4", "M0", "Q", "op", None, at(5), at(9)), ("J5", "M0", "P", "op", 3.0, None, at(9))]
    got = {r.job_id: r for r in clean.clean_jobs(spark.createDataFrame(rows, JOB)).collect()}
    assert set(got) == {"J1", "J3", "J4"} and got["J1"].start_time == at(0) and got["J1"].data_quality_notes == clean.SWAPPED
    assert got["J3"].quantity == 1.0 and got["J3"].quantity_imputed and got["J4"].quantity == 1.0
    assert {r.rule: r["rows"] for r in clean.cleaning_report(clean.tag_jobs(spark.createDataFrame(rows, JOB)), "log").collect()} == {"kept": 3, "too_short": 1, "duplicate": 1, "unparsed_time": 1}
    over = clean.overlapping_jobs(clean.clean_jobs(spark.createDataFrame([job(1, "M", 0, 10), job(2, "M", 10, 20), job(3, "M", 15, 30)], JOB)))
    assert [r.pair for r in over.collect()] == ["J2->J3"]


def test_labels_follow_the_latest_start(spark):
    rng = np.random.default_rng(0)
    jobs = [job(i, f"M{i % 2}", int(a), int(a + d)) for i, (a, d) in enumerate(zip(rng.integers(0, 50_000, 30), rng.integers(1, 9000, 30)))] + [job(90, "M0", 700, 900), job(91, "M0", 700, 800)]
    df = spark.createDataFrame(jobs, JOB)
    times = sorted({int(t) for t in rng.integers(-100, 60_000, 400)} | {700, 800, 801, 900})
    readings = spark.createDataFrame([(at(t), f"M{t % 2}") for t in times] + [(at(t), "M0") for t in (700, 800, 801, 900)] + [(at(0), "M9")], "ts timestamp, machine_id string").distinct()
    for trim in (0, 60):
        got = joins.assign_jobs(readings, df, trim, bucket_us=3_600_000_000).collect()
        assert len(got) == readings.count()
        for r in got:
            own = [(j[5] + timedelta(seconds=trim), j[0], j[6] - timedelta(seconds=trim)) for j in jobs if j[1] == r.machine_id]
            last = max((x for x in own if x[0] <= r.ts), default=None)
            assert r.job_id == (last[1] if last and r.ts <= last[2] else None)


def test_pairing_takes_the_nearest_and_ties_go_back(spark):
    rng = np.random.default_rng(1)
    power = sorted({int(x) for x in rng.integers(0, 40_000, 150)})
    vib = sorted({int(x) for x in rng.integers(0, 40_000, 300)} | {power[3] + 1000, power[5]})
    p = spark.createDataFrame([(at(t), "M", float(t)) for t in power], "ts timestamp, machine_id string, power_kw double")
    v = spark.createDataFrame([(at(t), "M", 1.0) for t in vib], "ts timestamp, machine_id string, vibration_rms_g double")
    got = joins.pair_with_power(v, p, 300, bucket_us=700_000_000).collect()
    assert len(got) == len(vib)
    for r in got:
        t = (r.ts - T0).total_seconds()
        near = min(power, key=lambda x: (abs(x - t), x))
        assert r.power_kw == (float(near) if abs(near - t) <= 300 else None)


def test_offset_sweep_equals_the_plain_scan(spark):
    rng = np.random.default_rng(2)
    jobs = [job(i, f"M{i % 3}", int(a), int(a + d)) for i, (a, d) in enumerate(zip(rng.integers(0, 80_000, 25), rng.integers(60, 9000, 25)))]
    power = [(at(int(t)), f"M{m}", float(rng.normal(5, 2))) for m in range(4) for t in sorted(set(rng.integers(0, 100_000, 300).tolist()) | {jobs[0][5].hour})]
    offsets = [-7200, 0, 1800, 3600]
    got = {(r.machine_id, r.offset_s): r.lift for r in align.machine_offset_scores(spark.createDataFrame(power, "ts timestamp, machine_id string, power_kw double"), spark.createDataFrame(jobs, JOB), offsets).collect()}
    for m in range(4):
        for o in offsets:
            wins = [(j[5] + timedelta(seconds=o), j[6] + timedelta(seconds=o)) for j in jobs if j[1] == f"M{m}"]
            inside = [kw for t, mm, kw in power if mm == f"M{m}" and any(a <= t <= b for a, b in wins)]
            outside = [kw for t, mm, kw in power if mm == f"M{m}" and not any(a <= t <= b for a, b in wins)]
            if inside and outside and wins:
                assert abs(got[f"M{m}", o] - (np.mean(inside) - np.mean(outside))) < 1e-9
            else:
                assert (f"M{m}", o) not in got
    scores = align.offset_scores(spark.createDataFrame([], "machine_id string, offset_s int, lift double"), [0, 60])
    assert align.best(scores).first().offset_s == 0


@pytest.fixture(scope="module")
def cutting(spark):
    rng = np.random.default_rng(3)
    n = 600
    machine, part = rng.integers(0, 3, n), rng.integers(0, 4, n)
    x, q = rng.normal(1.5, 0.4, n), rng.integers(1, 20, n).astype(float)
    y = -3 + 0.9 * x + 0.1 * machine + 0.05 * part * x + 0.002 * q + rng.normal(0, 0.05, n) + (rng.random(n) < 0.1) * 0.6
    rows = [(at(i), f"M{m}", f"P{p}", f"J{i % 12}", float(a), float(b), float(c), float(c - a), float(3 + 0.1 * rng.normal())) for i, (m, p, a, b, c) in enumerate(zip(machine, part, x, q, y))]
    df = spark.createDataFrame(rows, "ts timestamp, machine_id string, part_type string, job_id string, log_net_power_kw double, quantity double, log_vibration_rms_g double, log_vib_per_kw double, peak_to_rms double")
    return df.withColumns({"vib_per_kw": F.exp("log_vib_per_kw"), "net_power_kw": F.exp("log_net_power_kw"), "vibration_rms_g": F.exp("log_vibration_rms_g"), "vibration_peak_g": F.exp("log_vibration_rms_g") * 3}).cache()


def design(cutting):
    rows = cutting.orderBy("ts").collect()
    cols = [[r.log_net_power_kw for r in rows], [r.quantity for r in rows]]
    for name, levels in (("machine_id", ("M1", "M2")), ("part_type", ("P1", "P2", "P3"))):
        for level in levels:
            d = [float(r[name] == level) for r in rows]
            cols += [d, [a * r.log_net_power_kw for a, r in zip(d, rows)]]
    x = np.array(cols).T
    z = (x - x.mean(0)) / x.std(0)
    return np.column_stack([np.ones(len(z)), z]), np.array([r.log_vibration_rms_g for r in rows])


def predictions(cutting, model):
    return np.array([r.p for r in model.with_prediction(cutting, "p").orderBy("ts").select("p").collect()])


def test_ridge_from_moments(cutting):
    z, y = design(cutting)
    penalty = np.eye(z.shape[1])
    penalty[0, 0] = 0
    ridge = z @ np.linalg.solve(z.T @ z + penalty, z.T @ y)
    assert np.abs(predictions(cutting, linear.fit_ridge(cutting)) - ridge).max() < 1e-8


def test_huber_is_a_fixed_point_and_ignores_the_tail(cutting):
    """At the fit, residuals clipped at epsilon scales are orthogonal to the design, but for the small ridge."""
    z, y = design(cutting)
    model = linear.fit_huber(cutting)
    r = y - predictions(cutting, model)
    sigma = 1.4826 * np.median(np.abs(r - np.median(r)))
    beta = np.linalg.lstsq(z, y - r, rcond=None)[0]
    slope = z.T @ np.clip(r, -1.35 * sigma, 1.35 * sigma) - 1e-4 * np.r_[0, beta[1:]]
    assert np.abs(slope).max() < 1e-4 and 1 < model.rounds < 100
    assert abs(np.median(r)) < 0.02 and sigma < 0.08  # a tenth of the rows lie 0.6 higher


def test_ransac_ignores_the_tail_and_does_not_depend_on_partitions(cutting):
    one, two = linear.fit_ransac(cutting, trials=20), linear.fit_ransac(cutting.repartition(5), trials=20)
    assert abs(one.power - two.power) < 1e-9 and abs(one.intercept - two.intercept) < 1e-9
    _, y = design(cutting)
    assert np.median(np.abs(y - predictions(cutting, one))) < 0.06


def test_unseen_levels_fall_back(spark, cutting):
    model = linear.fit_ridge(cutting)
    row = spark.createDataFrame([("X", "Y", 1.0, 2.0)], "machine_id string, part_type string, log_net_power_kw double, quantity double")
    assert abs(model.with_prediction(row, "p").first()["p"] - (model.intercept + model.power + 2 * model.quantity)) < 1e-12


def test_scales_of_planted_spreads(spark):
    """Evenly laid normal quantiles with a far group: robust scales see the planted spread, and
    the trimmed one is a fixed point of its own rule."""
    from statistics import NormalDist

    core = np.array([NormalDist(5, 2).inv_cdf((i + 0.5) / 4000) for i in range(4000)])
    x = np.concatenate([core, np.full(600, 60.0)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),), (float("inf"),)], "x double")
    got = {e: robust.robust_scale(df, "x", e) for e in ("std", "iqr", "mad", "trimmed_mad")}
    assert abs(got["std"] - x.std()) < 1e-9 and abs(got["iqr"] - np.subtract(*np.quantile(x, [0.75, 0.25])) / 1.349) < 1e-9
    assert abs(got["mad"] - 1.4826 * np.median(np.abs(x - np.median(x)))) < 1e-9
    assert abs(got["trimmed_mad"] - 2) < 0.06 < got["mad"] - 2 < got["std"]
    inside = core[np.abs(core - 5) <= 3 * got["trimmed_mad"]]
    assert abs(1.4826 * np.median(np.abs(inside - np.median(inside))) - got["trimmed_mad"]) < 1e-6
    assert robust.robust_scale(df.limit(0), "x") == 1e-9


def test_selected_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(8)
    shares = [0.0, 0.25, 0.5, 0.999, 1.0]
    tables = [rng.normal(0, 1, 3000), np.repeat([1.0, 2.0, 7.0], [5, 900, 3]), 10.0 ** rng.integers(-200, 200, 700), np.array([3.0]), rng.integers(0, 2, 501).astype(float)]
    for x in tables:
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),), (float("-inf"),)], "x double").repartition(3)
        assert np.allclose(selection.quantiles(df, F.col("x"), shares), np.quantile(x, shares), rtol=1e-12, atol=0)
    rows = spark.createDataFrame([(float(v),) for v in tables[0]], "x double")
    for near in ((-5.0, -4.0), (9.0, 9.0), (0.0, 0.01)):  # brackets that do not hold widen
        assert selection.narrowed(rows, [0.5], 3000, [near])[0] == pytest.approx(np.median(tables[0]), rel=1e-12)
    assert selection.quantiles(df.limit(0), F.col("x"), shares) is None


def test_mahalanobis_is_central_and_stays(spark, cutting):
    """The fit is the mean and covariance of the three quarters nearest to it, and far rows do not move it."""
    planted = cutting.limit(60).withColumns({c: F.col(c) + 50 for c in outliers.FEATURES})
    got = outliers.fit_mahalanobis(cutting)
    x = np.array([[r[c] for c in outliers.FEATURES] for r in cutting.collect()])
    off = x - np.array(got["centre"])
    distance = (off @ np.array(got["precision"]) * off).sum(axis=1)
    central = x[distance <= np.sort(distance)[int(0.75 * len(x)) - 1] * (1 + 1e-9)]
    assert np.allclose(central.mean(axis=0), got["centre"], atol=1e-6)
    assert np.allclose(np.linalg.inv(got["precision"]), np.cov(central.T), rtol=1e-3, atol=1e-7)
    moved = outliers.fit_mahalanobis(cutting.unionByName(planted))
    assert np.abs(np.array(moved["centre"]) - got["centre"]).max() < 0.2


def test_null_measures_count_as_zero(spark, cutting):
    model = linear.fit_ridge(cutting)
    zero, null = cutting.withColumn("quantity", F.lit(0.0)), cutting.withColumn("quantity", F.lit(None).cast("double"))
    total = lambda df: model.with_prediction(df, "p").agg(F.sum("p")).first()[0]
    assert total(zero) == pytest.approx(total(null)) and linear.fit_joint_huber(null).power == pytest.approx(linear.fit_joint_huber(zero).power)


def test_two_sided_scores_are_sizes(spark, cutting):
    one, two = (verdict.fit_detector(cutting, Params(primary_model="ridge", one_sided=side)) for side in (True, False))
    a, b = (verdict.score_readings(cutting, d).orderBy("ts").collect() for d in (one, two))
    assert min(r.primary_score for r in a) < 0 and all(y.primary_score == abs(x.primary_score) and y.residual_sigma == x.primary_score for x, y in zip(a, b))
    assert all(r.primary_anomalous == (r.primary_score >= 6) for r in b)


def test_running_totals_and_ranks_over_ranges(spark):
    from wearloom.functions.ranking import running_total

    rng = np.random.default_rng(9)
    rows = [(i, float(v) if v < 9 else None, int(n)) for i, (v, n) in enumerate(zip(rng.integers(0, 12, 300), rng.integers(0, 5, 300)))]
    df = spark.createDataFrame(rows, "i long, v double, n long").repartition(7)
    got = {r.i: r.t for r in running_total(df, [F.col("v").desc_nulls_last(), F.col("i")], F.col("n"), "t").collect()}
    total = 0
    for i, _, n in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0])):
        total += n
        assert got[i] == total


def test_gaps_across_buckets(spark):
    from wearloom.operators import profile

    times = {"A": [0, 4, 9, 50_000, 50_003, 200_000], "B": [7], "C": [1, 100_000]}
    df = spark.createDataFrame([(at(t), m) for m, ts in times.items() for t in ts], "ts timestamp, machine_id string")
    got = sorted((r.machine_id, r.gap_s) for r in profile._gaps(df).collect())
    assert got == sorted((m, float(b - a)) for m, ts in times.items() for a, b in zip(ts, ts[1:]))
    assert profile.sampling_gaps(df, "x").first().gaps == 3


def test_any_window_counts_overlaps_once(spark):
    jobs = spark.createDataFrame([job(1, "M", 0, 100_000), job(2, "M", 50, 60), job(3, "N", 10, 20)], JOB)
    readings = spark.createDataFrame([(at(t), m) for m in "MNO" for t in (0, 10, 20, 21, 55, 100_000, 100_001)], "ts timestamp, machine_id string")
    got = sorted((r.machine_id, int((r.ts - T0).total_seconds())) for r in joins.in_any_window(readings, jobs).collect())
    assert got == [("M", t) for t in (0, 10, 20, 21, 55, 100_000)] + [("N", 10), ("N", 20)]


def test_contaminations_share_a_fit(cutting):
    pairs = [("mahalanobis", 0.01), ("mahalanobis", 0.15)]
    got = outliers.fit_secondaries(cutting, pairs)
    assert list(got) == pairs and got[pairs[0]]["threshold"] > got[pairs[1]]["threshold"]
    assert got[pairs[1]] == outliers.fit_secondary(cutting, Params(contamination=0.15))


def test_idle_baseline_falls_back(spark):
    rows = [("A", 0.4, None), ("A", 0.3, None), ("A", 9.0, "J"), ("B", 8.0, "J")]
    labelled = spark.createDataFrame(rows, "machine_id string, power_kw double, job_id string")
    idle = lambda df, p: {r.machine_id: r.idle_baseline_kw for r in features.idle_baseline(df, p).collect()}
    assert idle(labelled, Params()) == {"A": 0.3, "B": 0.3}
    assert idle(labelled, Params(fallback_to_global=False)) == {"A": 0.3, "B": 0.0}
    assert idle(labelled, Params(idle_method="percentile", idle_percentile=50.0)) == pytest.approx({"A": 0.35, "B": 0.35})
    assert idle(labelled.where("job_id IS NOT NULL"), Params()) == {"A": 0.0, "B": 0.0} and idle(labelled.limit(0), Params()) == {}


@pytest.mark.parametrize("secondary", ["mahalanobis", "isolation_forest", "lof"])
def test_detector_scores_and_saves(spark, cutting, tmp_path, secondary):
    p = Params(primary_model="ridge", secondary_model=secondary, if_n_estimators=20, lof_reference_size=200)
    detector = verdict.fit_detector(cutting, p)
    files.save_detector(spark, detector, str(tmp_path / "detector"))
    again = files.load_detector(spark, str(tmp_path / "detector"))
    a, b = (verdict.score_readings(cutting, d).agg(F.sum("primary_score"), F.sum("secondary_score"), F.avg(F.col("secondary_anomalous").cast("int"))).first() for d in (detector, again))
    assert np.allclose(a, b) and abs(a[2] - 0.15) < 0.02


def test_verdict_ranks_and_notes(spark):
    rows = [("A", "M", at(0), 50, 9.0, 40, 40, 0.8, "", 9, 9), ("B", "M", at(1), 50, 7.0, 0, 3, 0.0, "n", 9, 9), ("C", "M", at(2), 19, 99.0, 19, 19, 1.0, "", 0, 9), ("D", "M", at(3), None, None, None, None, None, "", 1, 0)]
    df = spark.createDataFrame(rows, "job_id string, machine_id string, start_time timestamp, cutting_readings long, wear_score double, n_anomalous long, n_primary_anomalous long, anomalous_fraction double, data_quality_notes string, power_readings long, vibration_readings long")
    got = {r.job_id: r for r in verdict.verdicts(df.withColumn("n_secondary_anomalous", F.lit(0))).collect()}
    assert {k: r["rank"] for k, r in got.items()} == {"A": 1, "B": 2, "C": 3, "D": 4}
    assert got["A"].flagged and not got["C"].flagged and "40 of 50" in got["A"].notes and "80.0%" in got["A"].notes
    assert got["B"].notes == "n; first detector only; not flagged" and "no power" in got["C"].notes and "no vibration" in got["D"].notes


def test_lenient_reading_of_exports(spark, tmp_path):
    (tmp_path / "p.csv").write_text("timestamp,machine_id,power_kw\n2025-03-10T13:00:00.5Z, M1 ,1.5\njunk,M1,x\n2025-03-10T13:00:01Z,M1,NaN\n")
    got = files.load_power(spark, str(tmp_path / "p.csv")).select(us("ts").alias("u"), "machine_id", "power_kw").collect()
    assert [(r.u is not None, r.machine_id, r.power_kw) for r in got] == [(True, "M1", 1.5), (False, "M1", None), (True, "M1", None)]
    with pytest.raises(ValueError, match="vibration_peak_g"):
        files.load_vibration(spark, str(tmp_path / "p.csv"))


def test_auc_and_split(spark):
    df = spark.createDataFrame([(float(v), bool(w)) for v, w in ((1, 0), (2, 0), (2, 1), (3, 1))], "s double, w boolean")
    assert evaluate.rank_auc(df, "s", F.col("w")).first().auc == 0.875
    ratios = spark.createDataFrame([("a", "P", 1.0), ("b", "P", 1.01), ("c", "P", 1.7), ("d", "Q", 5.0)], "job_id string, part_type string, ratio double")
    assert {r.job_id for r in evaluate.reference_split(ratios).where("reference_worn").collect()} == {"c"}


def test_params_are_checked():
    with pytest.raises(ValueError):
        Params(contamination=0.7)
    with pytest.raises(ValueError):
        Params(primary_model="forest")


def test_stream_scores_like_the_batch(spark, tmp_path):
    from wearloom.streaming import score_stream

    jobs = spark.createDataFrame([(f"J{i}", "M0", f"P{i % 2}", 3.0, at(i * 1000), at(i * 1000 + 900)) for i in range(6)], "job_id string, machine_id string, part_type string, quantity double, start_time_aligned timestamp, end_time_aligned timestamp")
    idle = spark.createDataFrame([("M0", 0.3)], "machine_id string, idle_baseline_kw double")
    rng = np.random.default_rng(6)
    rows = [(at(t), "M0", float(0.2 + 0.02 * rng.random()), float(0.6 + 0.1 * rng.random()), float(5 + rng.random())) for t in range(0, 6000, 10)]
    df = spark.createDataFrame(rows, "ts timestamp, machine_id string, vibration_rms_g double, vibration_peak_g double, power_kw double")
    df.unionByName(df.limit(5)).write.parquet(str(tmp_path / "in"))
    labelled = joins.assign_jobs(df, jobs, start="start_time_aligned", end="end_time_aligned")
    cut = features.cutting_readings(features.reading_features(labelled, jobs, idle))
    detector = verdict.fit_detector(cut, Params(primary_model="ridge"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = score_stream.write(score_stream.scored_stream(stream, jobs, idle, detector), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("job_id").agg(F.count("*").alias("n"), F.round(F.sum("primary_score"), 6).alias("s")).collect()
    want = verdict.score_readings(cut, detector).groupBy("job_id").agg(F.count("*").alias("n"), F.round(F.sum("primary_score"), 6).alias("s")).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in want}


@pytest.fixture(scope="module")
def views(spark):
    from wearloom.jobs import registry

    return registry.Views(spark, "/root/testdata/sf0.01")


def test_registered_fits_against_numpy(views):
    """ridge_coefficients of the whole table held against a dense solve over its rows."""
    from wearloom.jobs import registry

    got = {r.term: (r["shift"], r.slope) for r in registry.BUILT["ridge_coefficients"](views).collect()}
    rows = views.cutting().collect()
    x, y = np.array([r.log_net_power_kw for r in rows]), np.array([r.log_vibration_rms_g for r in rows])
    columns = {("all", 1): x, ("quantity", 1): np.array([r.quantity for r in rows])}
    for kind, name in (("machine", "machine_id"), ("part", "part_type")):
        for level in sorted({r[name] for r in rows})[1:]:
            d = np.array([float(r[name] == level) for r in rows])
            columns |= {(f"{kind} {level}", 0): d, (f"{kind} {level}", 1): d * x}
    raw = np.column_stack(list(columns.values()))
    z = (raw - raw.mean(0)) / raw.std(0)
    beta = np.linalg.solve(z.T @ z + np.eye(z.shape[1]), z.T @ (y - y.mean())) / raw.std(0)
    assert set(got) == {term for term, _ in columns}
    for (term, i), b in zip(columns, beta):
        assert got[term][i] == pytest.approx(b, abs=1e-7)


def test_the_planted_jobs_are_flagged_and_the_offset_is_found(views):
    """End to end with the default detector: the flagged jobs are those whose tool is worn."""
    assert views.prepared().offset_s == 18_000
    rows = views.ranked()[0].collect()
    worn = {r.job_id for r in rows if int(r.job_id[1:]) % 8 == 3 and r.assessable}
    assert {r.job_id for r in rows if r.flagged == "true"} == worn and len(worn) > 8
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and {r.job_id for r in rows[: len(worn)]} == worn
