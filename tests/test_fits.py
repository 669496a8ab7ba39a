"""Fits of whole views against plain NumPy, many machines, and what must not count."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearloom.operators import density, evaluate, linear, outliers
from wearloom.params import Params


@pytest.fixture(scope="module")
def views(spark):
    from wearloom.jobs import registry

    return registry.Views(spark, "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def rows(views):
    return views.cutting().toPandas().sort_values(["machine_id", "ts"])


def dense(rows):
    """Raw design of (1, x, q) and each level's shift and slope, the first level left out."""
    x, q = rows["log_net_power_kw"].to_numpy(), rows["quantity"].to_numpy()
    columns = [np.ones(len(rows)), x, q]
    for name in ("machine_id", "part_type"):
        for level in sorted(rows[name].unique())[1:]:
            d = (rows[name] == level).to_numpy(float)
            columns += [d, d * x]
    return np.column_stack(columns)


def joint_minimum(design, y, epsilon=1.35, alpha=1e-4):
    """Newton steps with halving over coefficients and log scale, all in one dense system."""
    weight = np.ones(design.shape[1])
    weight[0], weight[1:3] = 0, design[:, 1:3].var(axis=0)
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    sigma = np.std(y - design @ beta)

    def loss(beta, sigma):
        r = np.abs(y - design @ beta)
        return np.where(r <= epsilon * sigma, sigma + r * r / sigma, sigma * (1 - epsilon**2) + 2 * epsilon * r).sum() + alpha * (weight * beta**2).sum()

    for _ in range(200):
        r = y - design @ beta
        near = np.abs(r) <= epsilon * sigma
        slope = np.r_[design.T @ np.where(near, -2 * r / sigma, -2 * epsilon * np.sign(r)) + 2 * alpha * weight * beta, np.where(near, 1 - (r / sigma) ** 2, 1 - epsilon**2).sum()]
        own = design[near]
        curve = np.block([[2 / sigma * own.T @ own + 2 * alpha * np.diag(weight), (own.T @ (2 * r[near] / sigma**2))[:, None]], [(own.T @ (2 * r[near] / sigma**2))[None], np.array([[(2 * r[near] ** 2 / sigma**3).sum()]])]])
        step, t = np.linalg.lstsq(curve, -slope, rcond=None)[0], 1.0
        while t > 1e-12 and (sigma + t * step[-1] <= 0 or loss(beta + t * step[:-1], sigma + t * step[-1]) > loss(beta, sigma)):
            t /= 2
        if t <= 1e-12 or np.abs(step).max() < 1e-13:
            break
        beta, sigma = beta + t * step[:-1], sigma + t * step[-1]
    return beta, sigma


def predicted(model, views, name="p"):
    return model.with_prediction(views.cutting(), name).select("machine_id", "ts", name).toPandas().sort_values(["machine_id", "ts"])[name].to_numpy()


def test_joint_huber_is_the_minimum(views, rows):
    design, y = dense(rows), rows["log_vibration_rms_g"].to_numpy()
    beta, sigma = joint_minimum(design, y)
    models, batch = linear.fit_all(views.cutting(), [linear.Fit("joint_huber")])
    assert batch.points[0].theta[-1] == pytest.approx(sigma, rel=1e-6)
    assert np.abs(predicted(models[0], views) - design @ beta).max() < 1e-6
    assert models[0].rounds <= 12


def test_fits_asked_together_are_those_asked_alone(views):
    cutting = views.cutting()
    both = [linear.Fit("ridge"), linear.Fit("joint_huber"), linear.Fit("joint_huber", "vibration_rms_g", "net_power_kw"), linear.Fit("ridge", left_out=1)]
    together, _ = linear.fit_all(cutting, both, folds=3)
    for fit, model in zip(both, together):
        alone = linear.fit_all(cutting, [fit], folds=3)[0][0]
        assert (model.intercept, model.power, model.quantity) == pytest.approx((alone.intercept, alone.power, alone.quantity), rel=1e-7)
        assert np.allclose(predicted(model, views), predicted(alone, views), atol=1e-7)


def many(spark, n, machines):
    """A third of all rows are of one machine, the others of some thousand."""
    df = spark.range(n, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.hash("id") % machines).cast("string").alias("machine_id"), F.concat(F.lit("P"), F.col("id") % 4).alias("part_type"),
        (F.lit(1.5) + F.rand(1)).alias("log_net_power_kw"), (F.col("id") % 9).cast("double").alias("quantity"), F.timestamp_seconds("id").alias("ts"),
    )
    return df.withColumn("log_vibration_rms_g", 0.9 * F.col("log_net_power_kw") + (F.hash("machine_id") % 100) / 300 + F.randn(2) * 0.05).cache()


def test_twenty_thousand_machines(spark):
    """The slope of the penalised squares is nil for every machine and part."""
    df = many(spark, 90_000, 10_000)  # hashes have both signs
    model = linear.fit_all(df, [linear.Fit("ridge")], Params(ridge_alpha=0.5))[0][0]
    assert df.select("machine_id").distinct().count() > 18_000 and model.machine_table().count() > 18_000
    off = model.with_prediction(df, "p").withColumn("r", F.col("log_vibration_rms_g") - F.col("p"))
    sums = off.groupBy("machine_id").agg(F.sum("r").alias("r"), F.sum(F.col("r") * F.col("log_net_power_kw")).alias("rx"))
    met = sums.join(model.machine_table(), "machine_id").toPandas()
    met = met[met["machine_id"] != min(met["machine_id"])]  # the first is in the intercept
    assert np.abs(met["r"] - 0.5 * met["shift"]).max() < 1e-6 and np.abs(met["rx"] - 0.5 * met["slope"]).max() < 1e-6
    assert np.abs(np.array(off.agg(F.sum("r"), F.sum(F.when(F.col("part_type") == "P2", F.col("r")))).first()) - [0, 0.5 * model.parts["P2"][0]]).max() < 1e-6


def test_joint_huber_with_many_machines(spark):
    """Residuals clipped at epsilon scales add up to nothing but the penalty, for every machine."""
    df = many(spark, 60_000, 500)
    models, batch = linear.fit_all(df, [linear.Fit("joint_huber")])
    limit = 1.35 * batch.points[0].theta[-1]
    off = models[0].with_prediction(df, "p").withColumn("r", F.greatest(F.least(F.col("log_vibration_rms_g") - F.col("p"), F.lit(limit)), F.lit(-limit)))
    met = off.groupBy("machine_id").agg(F.sum("r").alias("r"), F.sum(F.col("r") * F.col("log_net_power_kw")).alias("rx")).join(models[0].machine_table(), "machine_id").toPandas()
    met = met[met["machine_id"] != min(met["machine_id"])]
    share = 1e-4 * batch.points[0].theta[-1]
    assert len(met) > 900 and np.abs(met["r"] - share * met["shift"]).max() < 1e-5 and np.abs(met["rx"] - share * met["slope"]).max() < 1e-5
    assert models[0].rounds < 40


def test_targets_that_are_not_finite_do_not_count(spark):
    rng = np.random.default_rng(4)
    rows = [(datetime(2024, 1, 1, 0, i // 60, i % 60), f"M{i % 3}", f"P{i % 2}", float(x), 1.0, float(x + rng.normal(0, 0.1))) for i, x in enumerate(rng.normal(1, 1, 300))]
    schema = "ts timestamp, machine_id string, part_type string, log_net_power_kw double, quantity double, log_vibration_rms_g double"
    clean = spark.createDataFrame(rows, schema)
    odd = spark.createDataFrame([(datetime(2024, 1, 2, 0, i), "M0", "P0", 1.0, 1.0, v) for i, v in enumerate((float("inf"), float("nan"), None, float("-inf")))], schema)
    for fit in (linear.fit_huber, linear.fit_joint_huber, linear.fit_ridge):
        a, b = fit(clean), fit(clean.unionByName(odd))
        assert (a.intercept, a.power) == pytest.approx((b.intercept, b.power), rel=1e-7)
    empty = linear.fit_all(clean.limit(0), [linear.Fit(m) for m in ("ridge", "huber", "joint_huber", "ransac")])[0]
    assert all(m.intercept == 0 and m.power == 0 for m in empty)
    nobody = clean.withColumn("machine_id", F.lit(None).cast("string")).withColumn("part_type", F.lit(None).cast("string"))
    slope = np.polyfit([r[3] for r in rows], [r[5] for r in rows], 1)
    assert linear.fit_ridge(nobody, alpha=1e-9).power == pytest.approx(slope[0], rel=1e-6)


def test_cross_validation_is_that_of_plain_folds(views, rows):
    """ridge of each fold against a dense solve without it."""
    got = {(r.model, r.fold): r.r2 for r in linear.cross_validated_r2(views.cutting(), ["ridge", "huber", "ransac"], p=Params(ransac_trials=10)).collect()}
    assert len(got) == 15
    fold = views.cutting().select("machine_id", "ts", F.pmod(F.xxhash64("machine_id", "ts"), F.lit(5)).alias("f")).toPandas().sort_values(["machine_id", "ts"])["f"].to_numpy()
    design, y = dense(rows), rows["log_vibration_rms_g"].to_numpy()
    for f in range(5):
        own, out = fold != f, fold == f
        weight = np.ones(design.shape[1])
        weight[0], weight[1:3] = 0, design[own, 1:3].var(axis=0)
        beta = np.linalg.solve(design[own].T @ design[own] + np.diag(weight), design[own].T @ y[own])
        r2 = 1 - ((y[out] - design[out] @ beta) ** 2).sum() / ((y[out] - y[out].mean()) ** 2).sum()
        assert got["ridge", f] == pytest.approx(r2, abs=1e-7)


def test_least_determinant(views, rows):
    """No larger, but for a row or two, than what concentration from the medians or from random starts over all rows finds."""
    x = rows[list(outliers.FEATURES)].to_numpy()
    model = outliers.fit_determinant(views.cutting())
    z = (x - np.array(model["mean"])) / np.array(model["dev"])
    h, rng, best = int(0.75 * len(z)), np.random.default_rng(0), np.inf
    starts = [(np.median(z, axis=0), np.cov(z.T))] + [(z[i].mean(axis=0), np.cov(z[i].T) + 1e-9 * np.eye(3)) for i in (rng.choice(len(z), 8, replace=False) for _ in range(20))]
    for centre, cov in starts:
        for _ in range(40):
            off = z - centre
            own = z[np.argsort(np.einsum("ij,jk,ik->i", off, np.linalg.pinv(cov), off))[:h]]
            centre, cov = own.mean(axis=0), np.cov(own.T, bias=True)
        if np.linalg.slogdet(cov)[1] < best:
            best, raw = np.linalg.slogdet(cov)[1], (centre, cov)
    assert model["log_determinant"] <= best + 1e-4
    scored = outliers.with_outlier_score(views.cutting(), model).toPandas().sort_values(["machine_id", "ts"])["secondary_score"].to_numpy()
    off = z - np.array(model["centre"])
    assert np.allclose(scored, np.einsum("ij,jk,ik->i", off, np.array(model["precision"]), off))
    off = z - raw[0]
    far = np.einsum("ij,jk,ik->i", off, np.linalg.inv(raw[1]), off)
    own = z[far * outliers.CHI_HALF / np.median(far) < outliers.CHI_CUT]
    assert np.allclose(own.mean(axis=0), model["centre"], atol=1e-3)
    want, got = np.linalg.inv(np.cov(own.T, bias=True)), np.array(model["precision"])
    assert np.linalg.norm(got - want) < 0.02 * np.linalg.norm(want)


def plain_factors(x, k):
    """Local outlier factors with all distances in a matrix: of rows that do not count among their neighbours, and that do."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    apart, together = d.copy(), d.copy()
    np.fill_diagonal(apart, np.inf)
    np.fill_diagonal(together, -1)
    near = np.argsort(apart, axis=1, kind="stable")[:, :k]
    far = np.take_along_axis(d, near, 1)
    dense_at = 1 / (np.maximum(far, far[:, -1][near]).mean(axis=1) + density.EPS)
    for one in (near, np.argsort(together, axis=1, kind="stable")[:, :k]):
        reach = np.maximum(np.take_along_axis(d, one, 1), far[:, -1][one]).mean(axis=1)
        out.append(dense_at[one].mean(axis=1) * (reach + density.EPS))
    return out


def test_local_outlier_factor_over_all_rows(views, rows):
    model = outliers.fit_lof(views.cutting())
    z = (rows[list(outliers.FEATURES)].to_numpy() - np.array(model["mean"])) / np.array(model["dev"])
    factor, score = plain_factors(z, 20)
    cut = views.cutting()
    for column, want in (("factor", factor), ("score", score)):
        got = outliers._with_density(cut, model, column).toPandas().sort_values(["machine_id", "ts"])["secondary_score"].to_numpy()
        assert np.allclose(got, want, rtol=1e-9)


def test_density_of_copies_clusters_and_far_places(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (500, 3)), rng.normal(4, 0.01, (300, 3)), np.tile([[1.0, 2.0, 3.0]], (120, 1)), rng.normal(0, 300, (9, 3)), np.tile([[0.5, 0.5, 0.5]], (5, 1))])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "ax double, ay double, az double").repartition(3)
    _, factors = density.fit(df.unionByName(spark.createDataFrame([(None, 1.0, 1.0)], df.schema)), 20)
    got = {(r.ax, r.ay, r.az): (r.factor, r.score) for r in factors.collect()}
    assert np.allclose([got[tuple(r)] for r in x], np.column_stack(plain_factors(x, 20)), rtol=1e-9)
    few, one = density.fit(df.limit(5), 20)[1], density.fit(df.limit(1), 20)[1]
    assert few.count() == 5 and one.count() == 1 and density.fit(df.limit(0), 20)[1].count() == 0


def test_forms_and_primaries(views):
    p = Params(ransac_trials=10, pair_tolerance_s=1800.0)
    forms = {(r.form, r.model): r for r in evaluate.target_form_comparison(views.cutting(), views.split(), ["ridge", "huber", "ransac"], p).collect()}
    assert len(forms) == 6 and all(0 <= r.healthy_fp <= r.over_share <= 1 for r in forms.values()) and forms["log", "huber"].worn_recall > 0.9
    found = {(r.primary, r.scale): r for r in evaluate.primary_comparison(views.cutting(), views.split(), ["ridge", "huber"], p).collect()}
    assert found["huber", "mad"].reference_in_top_n == found["huber", "mad"].n_reference > 0
