"""Reference set from the data and comparison of detectors against it."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearloom.functions import selection
from wearloom.functions.ranking import running_total
from wearloom.functions.tables import kept
from wearloom.operators.linear import asked, fit_all, with_predictions
from wearloom.operators.outliers import fit_secondaries, with_outlier_score
from wearloom.operators.robust import robust_scales
from wearloom.operators.verdict import job_flags, verdicts
from wearloom.params import Params

ELEVATED = 1.10
SCALES = ("std", "iqr", "mad", "trimmed_mad")


def job_ratios(cutting: DataFrame) -> DataFrame:
    """One row per job: readings, median vibration per kW, median crest factor, mean power, peak."""
    return cutting.groupBy("job_id", "machine_id", "part_type").agg(
        F.count("*").alias("n"), F.median("vib_per_kw").alias("ratio"), F.median("peak_to_rms").alias("crest"), F.avg("net_power_kw").alias("mean_power"), F.max("vibration_peak_g").alias("peak_vib")
    )


def reference_split(ratios: DataFrame, cut: float = ELEVATED, rounds: int = 10) -> DataFrame:
    """ratios with baseline, rel and reference_worn.

    The baseline of a part is the median ratio of its jobs below ``cut`` times the baseline
    before, again and again until none moves; a part with no such job keeps the one it has.
    A round is one aggregate by part over the table of jobs; a number per part is all that
    reaches the driver.
    """
    jobs, spark = kept(ratios), ratios.sparkSession
    low = lambda base: F.when(F.col("ratio") / base < cut, F.col("ratio"))
    medians = lambda df, x: {r["part_type"]: r["m"] for r in selection.medians(df, ["part_type"], x, "m").collect()}
    found = medians(jobs, F.col("ratio"))

    def with_baseline() -> DataFrame:
        table = spark.createDataFrame([(k, v) for k, v in found.items()], "of_part string, baseline double")
        return jobs.join(F.broadcast(table), F.col("part_type").eqNullSafe(F.col("of_part"))).drop("of_part")  # a row per part

    for _ in range(rounds):
        now = medians(with_baseline(), low(F.col("baseline")))
        moved = {k: v if (v := now.get(k)) is not None else old for k, old in found.items()}
        if moved == found:
            break
        found = moved
    return with_baseline().withColumn("rel", F.col("ratio") / F.col("baseline")).withColumn("reference_worn", F.col("rel") >= cut)


def split_summary(split: DataFrame) -> DataFrame:
    """One row: counts, range and spread of the ratio and of the crest factor of both groups, the
    gap between them, and whether their crest factors are apart."""
    worn = F.col("reference_worn")
    side = lambda c, is_worn: F.when(worn if is_worn else ~worn, F.col(c))
    found = [
        f(side(c, is_worn)).alias(f"{name}_{prefix}{end}")
        for name, is_worn in (("healthy", False), ("elevated", True)) for c, prefix in (("rel", ""), ("crest", "crest_")) for f, end in ((F.min, "low"), (F.max, "high"), (F.stddev, "std"))
    ]
    out = split.agg(F.count_if(~worn).alias("healthy"), F.count_if(worn).alias("elevated"), *found)
    return out.withColumns({"gap": F.col("elevated_low") - F.col("healthy_high"), "crest_apart": F.col("elevated_crest_low") > F.col("healthy_crest_high")})


def elevated_jobs(split: DataFrame) -> DataFrame:
    """The elevated jobs with their place: highest ratio first, then by machine and job."""
    order = [F.desc("rel"), F.col("machine_id"), F.col("job_id")]
    return running_total(split.where("reference_worn"), order, F.lit(1), "place").orderBy(*order)


def elevated_crosstab(split: DataFrame) -> DataFrame:
    """(machine_id, part_type, elevated, total) with totals by cube; nulls stand for all."""
    return split.cube("machine_id", "part_type").agg(F.count_if("reference_worn").alias("elevated"), F.count("*").alias("total"))


def job_progress(cutting: DataFrame) -> DataFrame:
    """(job_id, ts, progress): place of a reading in its job, from 0 to 1."""
    own = Window.partitionBy("job_id")
    place = F.row_number().over(own.orderBy("ts", "vibration_rms_g")) - 1
    return cutting.select("job_id", "ts", (place / F.greatest(F.count("*").over(own) - 1, F.lit(1))).alias("progress"))


def job_sequence(split: DataFrame, jobs: DataFrame) -> DataFrame:
    """(machine_id, sequence): S for elevated and . for normal jobs, in order of start."""
    rows = split.join(jobs.select("job_id", "start_time"), "job_id")
    mark = F.struct("start_time", "job_id", F.when(F.col("reference_worn"), "S").otherwise(".").alias("mark"))
    return rows.groupBy("machine_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(mark)), lambda x: x["mark"]), "").alias("sequence"))


def readings_of(cutting: DataFrame, split: DataFrame, worn: bool) -> DataFrame:
    """Readings of reference-worn jobs, or those of all other jobs."""
    chosen = split.where("reference_worn").select("job_id")
    return cutting.join(chosen, "job_id", "left_semi" if worn else "left_anti")


def average_rank(df: DataFrame, score: str) -> DataFrame:
    """(score, n, avg_rank) per distinct score: counts first, then a running sum over ranges of them."""
    counts = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("n"))
    return running_total(counts, [F.col(score)], F.col("n"), "upto").select(score, "n", (F.col("upto") - (F.col("n") - 1) / 2).alias("avg_rank"))


def rank_auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """One row: the chance that a positive row scores above another, from average ranks."""
    ranked = df.withColumn("_pos", positive.cast("int")).join(average_rank(df, score), score)
    sums = ranked.agg(F.sum("_pos").alias("p"), F.count("*").alias("n_all"), F.sum(F.when(F.col("_pos") == 1, F.col("avg_rank"))).alias("r"))
    return sums.select("p", (F.col("n_all") - F.col("p")).alias("n"), ((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * (F.col("n_all") - F.col("p")), F.lit(0))).alias("auc"))


def confusion(flags: DataFrame, keys: list[str] = ()) -> DataFrame:
    """tp, fp, fn and F1 of boolean columns flagged and reference_worn, whole or by keys."""
    f, w = F.coalesce("flagged", F.lit(False)), F.coalesce("reference_worn", F.lit(False))
    out = flags.groupBy(*keys).agg(F.count_if(f).alias("n_flagged"), F.count_if(f & w).alias("tp"), F.count_if(f & ~w).alias("fp"), F.count_if(~f & w).alias("fn"))
    return out.withColumn("f1", 2 * F.col("tp") / F.greatest(F.col("n_flagged") + F.col("tp") + F.col("fn"), F.lit(1)))


def decision_margin(judged: DataFrame) -> DataFrame:
    """One row: lowest flagged and highest unflagged score of assessable jobs."""
    ok = judged.where("assessable")
    return ok.agg(F.min(F.when(F.col("flagged"), F.col("wear_score"))).alias("worst_flagged"), F.max(F.when(~F.col("flagged"), F.col("wear_score"))).alias("best_clear"))


def top_overlap(scores: DataFrame, split: DataFrame, n: int) -> DataFrame:
    """One row: how many of the n jobs with the highest score are reference-worn."""
    best = scores.orderBy(F.desc("wear_score"), "job_id").limit(n)
    return best.join(split.where("reference_worn").select("job_id"), "job_id", "left_semi").agg(F.count("*").alias("overlap")).withColumn("n", F.lit(n))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: correlation of average ranks."""
    df = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranks = df.join(average_rank(df, a).select(a, F.col("avg_rank").alias("_a")), a).join(average_rank(df, b).select(b, F.col("avg_rank").alias("_b")), b)
    return ranks.agg(F.corr("_a", "_b").alias("spearman"))


def primary_scores(cutting: DataFrame, names: list[str], scales: list[str], p: Params = Params()) -> tuple[DataFrame, dict[str, tuple[float, dict[str, float]]]]:
    """cutting with r_<primary> (residual) and z_<primary>_<scale> columns, and per primary the
    centre and the widths: one wide table for all comparisons. All primaries are fitted together."""
    target, found = p.target, {}
    models, _ = fit_all(cutting, [asked(name, p, target=target) for name in names], p)
    fitted = with_predictions(cutting, {f"r_{name}": m for name, m in zip(names, models)})
    out = wide = kept(fitted.withColumns({f"r_{name}": F.col(target) - F.col(f"r_{name}") for name in names}))
    for name in names:
        centre = selection.median(wide, F.col(f"r_{name}"))
        widths = robust_scales(wide.select((F.col(f"r_{name}") - centre).alias("off")), "off", scales, p.scale_trim_sigma) if scales else {}
        found[name] = centre, widths
        out = out.withColumns({f"z_{name}_{scale}": (F.col(f"r_{name}") - centre) / width for scale, width in widths.items()})
    return out, found


def _hits_flag(n: str, hits: str, p: Params) -> Column:
    n, hits = F.col(n), F.col(hits)
    return (n >= p.min_readings_for_verdict) & (hits >= p.min_anomalous_readings) & (hits / n >= p.min_anomalous_fraction)


def _judged_hits(wide: DataFrame, split: DataFrame, combos: list[tuple[dict, Column]], p: Params) -> DataFrame:
    """Confusion per combination of (names, hit): hits of all are counted side by side per job,
    and only the table of jobs is stacked."""
    jobs = wide.groupBy("job_id").agg(F.count("*").alias("n"), *[F.count_if(hit).alias(f"h{i}") for i, (_, hit) in enumerate(combos)])
    rows = [F.struct(*[F.lit(v).alias(k) for k, v in names.items()], F.col(f"h{i}").alias("hits")) for i, (names, _) in enumerate(combos)]
    long = jobs.select("job_id", "n", F.explode(F.array(*rows)).alias("x")).select("job_id", "n", "x.*").withColumn("flagged", _hits_flag("n", "hits", p))
    return confusion(long.join(split.select("job_id", "reference_worn"), "job_id"), list(combos[0][0]))


def scale_job_verdicts(scored: DataFrame, split: DataFrame, residual: str = "residual_g", p: Params = Params()) -> DataFrame:
    """(scale, n_flagged, tp, fp, fn, f1): the scale estimators judged by jobs, on the residual alone."""
    centre = selection.median(scored, F.col(residual))
    widths = robust_scales(scored, residual, SCALES, p.scale_trim_sigma)
    return _judged_hits(scored, split, [({"scale": e}, (F.col(residual) - centre) / w >= p.sigma_multiple) for e, w in widths.items()], p)


def model_grid(cutting: DataFrame, split: DataFrame, primaries: list[str], scales: list[str], secondaries: list[tuple[str, float]], p: Params = Params()) -> DataFrame:
    """(primary, scale, secondary, contamination, n_flagged, tp, fp, fn, f1): every combination
    judged per job, from one wide table of scores."""
    wide, _ = primary_scores(cutting, primaries, scales, p)
    models = fit_secondaries(cutting, secondaries, p)
    for name in dict.fromkeys(name for name, _ in secondaries):
        own = {share: model for (other, share), model in models.items() if other == name}
        wide = with_outlier_score(wide, next(iter(own.values())))
        wide = wide.withColumns({f"s_{name}_{round(100 * share)}": F.col("secondary_score") >= model["threshold"] for share, model in own.items()}).drop("secondary_score")
    combos = [
        ({"primary": a, "scale": b, "secondary": c, "contamination": d}, (F.col(f"z_{a}_{b}") >= p.sigma_multiple) & F.col(f"s_{c}_{round(100 * d)}"))
        for a in primaries for b in scales for c, d in secondaries
    ]
    return _judged_hits(wide, split, combos, p)


def grid_effects(grid: DataFrame) -> DataFrame:
    """Means of the grid per level of each factor, by grouping sets; the others are null."""
    keys = ["primary", "scale", "secondary", "contamination"]
    return grid.groupingSets([[k] for k in keys], *keys).agg(*[F.avg(c).alias(c) for c in ("n_flagged", "tp", "fp", "fn")])


def secondary_comparison(cutting: DataFrame, split: DataFrame, secondaries: list[tuple[str, float]], p: Params = Params()) -> DataFrame:
    """(secondary, contamination, flagged, precision, recall, auc, mean scores per class)."""
    worn_rows = cutting.join(split.select("job_id", "reference_worn"), "job_id")
    models, parts = fit_secondaries(cutting, secondaries, p), []
    score, worn = F.col("secondary_score"), F.col("reference_worn")
    for name in dict.fromkeys(name for name, _ in secondaries):
        own = {share: model for (other, share), model in models.items() if other == name}
        scored = with_outlier_score(worn_rows, next(iter(own.values())))
        auc = rank_auc(scored.select("secondary_score", "reference_worn"), "secondary_score", worn).first()["auc"]

        def row(share: float, hit: Column) -> Column:
            return F.struct(
                F.lit(share).alias("contamination"), F.count_if(hit).alias("flagged"),
                (F.count_if(hit & worn) / F.greatest(F.count_if(hit), F.lit(1))).alias("precision"),
                (F.count_if(hit & worn) / F.greatest(F.count_if(worn), F.lit(1))).alias("recall"),
                F.avg(F.when(~worn, score)).alias("mean_healthy"), F.avg(F.when(worn, score)).alias("mean_worn"),
            )

        # All contaminations of a model from one pass over its scores.
        rows = scored.agg(F.array(*[row(share, score >= model["threshold"]) for share, model in own.items()]).alias("rows"))
        parts.append(rows.select(F.explode("rows").alias("x")).select(F.lit(name).alias("secondary"), "x.*", F.lit(auc).cast("double").alias("auc")))
    return reduce(DataFrame.unionByName, parts)


def primary_comparison(cutting: DataFrame, split: DataFrame, primaries: list[str], p: Params = Params()) -> DataFrame:
    """(primary, scale, healthy_fp_rate, worn_recall, worn_median_z, healthy_p999_z, n_over,
    worst_worn_job, best_healthy_job, job_margin, job_ratio, reference_in_top_n, n_reference).

    Rates come of one pass over the wide table; a quantile of z is that of the residual, moved
    and scaled, so it is selected once per primary. Jobs are compared by their wear scores.
    """
    wide, found = primary_scores(cutting, primaries, SCALES, p)
    wide = wide.join(split.select("job_id", "reference_worn"), "job_id")
    worn, out = F.col("reference_worn"), []
    pairs = [(a, b) for a in primaries for b in SCALES]
    over = {pair: F.col("z_{}_{}".format(*pair)) >= p.sigma_multiple for pair in pairs}
    sums = wide.agg(F.count_if(worn).alias("worn"), F.count_if(~worn).alias("healthy"), *[e for (a, b), o in over.items() for e in (F.count_if(o & worn).alias(f"w_{a}_{b}"), F.count_if(o & ~worn).alias(f"h_{a}_{b}"))]).first()
    scores = kept(job_scores(wide, primaries, p).join(split.select("job_id", "reference_worn"), "job_id"))
    ends = scores.agg(*[e for a in primaries for e in (F.min(F.when(worn, F.col(a))).alias(f"w_{a}"), F.max(F.when(~worn, F.col(a))).alias(f"h_{a}"))]).first()
    n_worn = scores.where(worn).count()
    for a in primaries:
        centre, widths = found[a]
        ranked = running_total(scores, [F.col(a).desc_nulls_last(), F.col("job_id")], F.lit(1), "place")
        in_top = ranked.where(worn & (F.col("place") <= n_worn)).count()
        middle = selection.quantiles(wide.where(worn), F.col(f"r_{a}"), [0.5])
        tail = selection.quantiles(wide.where(~worn), F.col(f"r_{a}"), [0.999])
        for b, width in widths.items():
            z = lambda v: None if v is None else (v - centre) / width  # noqa: B023, E731
            low, high = z(ends[f"w_{a}"]), z(ends[f"h_{a}"])
            both = low is not None and high is not None
            out.append((
                a, b, sums[f"h_{a}_{b}"] / max(sums["healthy"], 1), sums[f"w_{a}_{b}"] / max(sums["worn"], 1), z(middle[0] if middle else None), z(tail[0] if tail else None),
                sums[f"h_{a}_{b}"] + sums[f"w_{a}_{b}"], low, high, low - high if both else None, low / high if both and high > 0 else None, in_top, n_worn,
            ))
    names = ("healthy_fp_rate", "worn_recall", "worn_median_z", "healthy_p999_z")
    more = ("worst_worn_job", "best_healthy_job", "job_margin", "job_ratio")
    return cutting.sparkSession.createDataFrame(out, ", ".join(["primary string", "scale string", *[f"{c} double" for c in names], "n_over long", *[f"{c} double" for c in more], "reference_in_top_n long", "n_reference long"]))


def job_scores(wide: DataFrame, primaries: list[str], p: Params = Params()) -> DataFrame:
    """(job_id, one column per primary): the score quantile of each job's residuals, of jobs with
    enough readings. Residuals rank jobs as their scores do."""
    q = [F.percentile(f"r_{a}", F.lit(p.score_quantile)).alias(a) for a in primaries]
    return wide.groupBy("job_id").agg(F.count("*").alias("n"), *q).where(F.col("n") >= p.min_readings_for_verdict).drop("n")


def rank_agreement(cutting: DataFrame, primaries: list[str], p: Params = Params(), top: int = 15) -> tuple[DataFrame, DataFrame]:
    """How alike the primaries rank jobs: (one, other, spearman) per pair of primaries, and the
    ``top`` jobs of the first with their rank under each."""
    wide, _ = primary_scores(cutting, primaries, [], p)
    scores = kept(job_scores(wide, primaries, p))
    pairs = [(a, b) for i, a in enumerate(primaries) for b in primaries[i + 1 :]]
    agreement = reduce(DataFrame.unionByName, [spearman(scores, a, b).select(F.lit(a).alias("one"), F.lit(b).alias("other"), "spearman") for a, b in pairs])
    ranked = scores
    for a in primaries:
        ranked = running_total(ranked, [F.col(a).desc_nulls_last(), F.col("job_id")], F.lit(1), f"rank_{a}")
    return agreement, ranked.where(F.col(f"rank_{primaries[0]}") <= top).select("job_id", *[f"rank_{a}" for a in primaries])


FORMS = {"additive": ("vibration_rms_g", "net_power_kw"), "log": ("log_vibration_rms_g", "log_net_power_kw")}


def target_form_comparison(cutting: DataFrame, split: DataFrame, primaries: list[str] = ("ridge", "huber", "ransac"), p: Params = Params()) -> DataFrame:
    """(form, model, r2, mad_sigma, sd_sigma, sd_over_mad, sextile_ratio, over_share, worn_recall,
    healthy_fp): vibration itself over power against their logarithms, each with every primary,
    all fitted in the same passes. The scale is the plain MAD."""
    pairs, spark = [(form, name) for form in FORMS for name in primaries], cutting.sparkSession
    models, _ = fit_all(cutting, [asked(name, p, target=FORMS[form][0], power=FORMS[form][1]) for form, name in pairs], p)
    fitted = with_predictions(cutting, {f"r{i}": m for i, m in enumerate(models)})
    rows = fitted.join(split.select("job_id", "reference_worn"), "job_id").withColumns({f"r{i}": F.col(FORMS[form][0]) - F.col(f"r{i}") for i, (form, _) in enumerate(pairs)})
    edges = selection.quantiles(cutting, F.col("net_power_kw"), [i / 6 for i in range(1, 6)]) or []
    bucket = sum(((F.col("net_power_kw") > e).cast("int") for e in sorted(set(edges))), F.lit(0))
    wide = kept(rows.select("reference_worn", bucket.alias("bucket"), *dict.fromkeys(t for t, _ in FORMS.values()), *[f"r{i}" for i in range(len(pairs))]))
    scales = []
    for i in range(len(pairs)):
        centre = selection.median(wide, F.col(f"r{i}"))
        scales.append((centre, robust_scales(wide.select((F.col(f"r{i}") - centre).alias("off")), "off", ["mad"])["mad"] if centre is not None else 1e-9))
    over = [(F.col(f"r{i}") - F.lit(c).cast("double")) / s >= p.sigma_multiple for i, (c, s) in enumerate(scales)]
    share = lambda hit: F.avg(hit.cast("double"))
    worn = F.col("reference_worn")
    sums = wide.agg(*[e.alias(f"{n}{i}") for i, (form, _) in enumerate(pairs) for n, e in {
        "ss": F.sum(F.pow(F.col(f"r{i}"), 2)), "y": F.var_pop(FORMS[form][0]) * F.count(FORMS[form][0]), "sd": F.stddev_pop(f"r{i}"),
        "all": share(over[i]), "worn": share(F.when(worn, over[i])), "fp": share(F.when(~worn, over[i])),
    }.items()]).first()
    spread = wide.groupBy("bucket").agg(*[F.stddev(f"r{i}").alias(f"s{i}") for i in range(len(pairs))])
    ends = spread.agg(*[f(f"s{i}").alias(f"{n}{i}") for i in range(len(pairs)) for n, f in (("low", F.min), ("high", F.max))]).first()
    out = []
    for i, (form, name) in enumerate(pairs):
        mad, sd, low = scales[i][1], sums[f"sd{i}"], ends[f"low{i}"]
        r2 = 1 - sums[f"ss{i}"] / sums[f"y{i}"] if sums[f"y{i}"] else None
        out.append((form, name, r2, mad, sd, sd / mad if sd is not None else None, ends[f"high{i}"] / low if low else None, sums[f"all{i}"], sums[f"worn{i}"], sums[f"fp{i}"]))
    names = ("r2", "mad_sigma", "sd_sigma", "sd_over_mad", "sextile_ratio", "over_share", "worn_recall", "healthy_fp")
    return spark.createDataFrame(out, ", ".join(["form string", "model string", *[f"{c} double" for c in names]]))


def judged_jobs(jobs: DataFrame, scored: DataFrame, p: Params = Params()) -> DataFrame:
    """Metrics of jobs joined with the roll-up of their readings, and the verdict."""
    return verdicts(jobs.join(job_flags(scored, p), "job_id", "left"), p)
