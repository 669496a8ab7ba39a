"""Profiling queries over the raw and cleaned tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearloom.functions import selection
from wearloom.functions.columns import quantiles, us
from wearloom.functions.tables import kept
from wearloom.operators.joins import BUCKET, bucket_of

SHARES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def table_profile(df: DataFrame, name: str, approximate: bool = False) -> DataFrame:
    """(source, column, type, rows, nulls, null_share, distinct_values): one row per column.

    Values are counted once per (column, value) before they are dealt out, so a column of few
    values costs few rows; or distinct counts are sketches, from one aggregate.
    """
    kinds = dict(df.dtypes)
    if approximate:
        row = df.agg(F.count("*").alias("rows"), *[e for c in df.columns for e in (F.count_if(F.col(c).isNull()).alias(f"n_{c}"), F.approx_count_distinct(c).alias(f"d_{c}"))])
        parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("nulls"), F.col(f"d_{c}").alias("distinct_values")) for c in df.columns])
        out = row.select("rows", F.explode(parts).alias("x")).select("x.column", "rows", "x.nulls", "x.distinct_values")
    else:
        one = lambda c: df.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n")).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("v").alias("distinct_values")
        ).select(F.lit(c).alias("column"), "rows", "nulls", "distinct_values")
        out = reduce(DataFrame.unionByName, map(one, df.columns))
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("column")]
    return out.select(F.lit(name).alias("source"), "column", kind.alias("type"), "rows", "nulls", (F.col("nulls") / F.greatest("rows", F.lit(1))).alias("null_share"), "distinct_values")


def duplicate_rows(df: DataFrame, name: str) -> DataFrame:
    """(source, duplicate_rows): rows beyond the first of each group of equal rows."""
    return df.groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows")).select(F.lit(name).alias("source"), "duplicate_rows")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of several columns in one pass over grouping sets."""
    keyed = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x"))
    return keyed.groupBy("x.column", "x.value").agg(F.count("*").alias("n"))


def numeric_summary(df: DataFrame, column: str, by: list[str] = (), accuracy: int | None = None) -> DataFrame:
    """Count, mean, deviation, extremes and percentiles of a column, whole or by groups. Percentiles
    are selected, however long a group is; with an accuracy they are sketches of the same pass."""
    moments = {"n": F.count(column), "mean": F.avg(column), "std": F.stddev(column), "low": F.min(column), "high": F.max(column)}
    sums = df.groupBy(*by).agg(*[e.alias(k) for k, e in moments.items()], *([quantiles(F.col(column), list(SHARES), accuracy).alias("q")] if accuracy else []))
    if not accuracy:
        found = selection.by_group(df, list(by), F.col(column), list(SHARES))
        if by:
            found = found.select(*[F.col(k).alias(f"_{k}") for k in by], "q")
            out = sums.join(found, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by])
        else:
            out = sums.withColumn("q", F.lit(found.first()["q"]))  # seven numbers
    else:
        out = sums
    return out.select(*by, *moments, *[F.col("q")[i].alias(f"p{round(100 * s):02d}") for i, s in enumerate(SHARES)])


def defect_counts(power: DataFrame, vibration: DataFrame, log: DataFrame, implausible: float = 100.0) -> DataFrame:
    """(defect, n): duplicates, negative, implausible and impossible rows, reversed jobs, missing
    quantities. Each table is read once: by its key, with all its counts summed per key."""

    def counts(df: DataFrame, keys: list[str], again: str, defects: dict[str, Column]) -> DataFrame:
        names = {name: f"c{i}" for i, name in enumerate(defects)}
        by_key = df.groupBy(*keys).agg((F.count("*") - 1).alias("again"), *[F.count_if(e).alias(names[d]) for d, e in defects.items()])
        row = by_key.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("again", *names.values())])
        return row.select(F.explode(F.array(*[F.struct(F.lit(d).alias("defect"), F.col(c).alias("n")) for d, c in ((again, "again"), *names.items())])).alias("x")).select("x.*")

    rms, peak = F.col("vibration_rms_g"), F.col("vibration_peak_g")
    parts = [
        counts(power, ["machine_id", "ts"], "power duplicates", {"negative power": F.col("power_kw") < 0, "implausible power": F.col("power_kw") > implausible}),
        counts(vibration, ["machine_id", "ts"], "vibration duplicates", {"negative vibration": (rms < 0) | (peak < 0), "peak below rms": peak < rms}),
        counts(log, ["job_id"], "duplicate job ids", {"reversed jobs": F.col("end_time") < F.col("start_time"), "missing quantity": F.col("quantity").isNull()}),
    ]
    return reduce(DataFrame.unionByName, parts)


def defect_values(power: DataFrame, implausible: float = 100.0) -> DataFrame:
    """(defect, value, n): a row for each negative and each implausible power value that occurs, and
    one for the 99.9th percentile of the rest, with the rows of the rest."""
    kw = F.col("power_kw")
    defect = F.when(kw < 0, "negative power").when(kw > implausible, "implausible power")
    values = power.withColumn("defect", defect).where("defect IS NOT NULL").groupBy("defect", kw.alias("value")).agg(F.count("*").alias("n"))
    rest = power.agg(F.count_if(kw.between(0, implausible)).alias("n")).crossJoin(plausible_top(power, implausible))
    return values.unionByName(rest.select(F.lit("99.9th percentile of the rest").alias("defect"), F.col("p999_power_kw").alias("value"), "n"))


def plausible_top(power: DataFrame, implausible: float = 100.0) -> DataFrame:
    """One row: the 99.9th percentile of power that is neither negative nor implausible."""
    top = selection.quantiles(power.where(F.col("power_kw").between(0, implausible)), F.col("power_kw"), [0.999])
    return power.sparkSession.createDataFrame([(top[0] if top else None,)], "p999_power_kw double")


def time_coverage(sources: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(source, first_us, last_us, rows). sources: table, first and last time column by name."""
    parts = [df.agg(F.min(us(a)).alias("first_us"), F.max(us(b)).alias("last_us"), F.count("*").alias("rows")).select(F.lit(k).alias("source"), "*") for k, (df, a, b) in sources.items()]
    return reduce(DataFrame.unionByName, parts)


def machine_sets(sources: dict[str, DataFrame]) -> DataFrame:
    """(machine_id, in_sources, in_all): in how many sources a machine occurs."""
    parts = [df.select("machine_id", F.lit(k).alias("source")).distinct() for k, df in sources.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("machine_id").agg(F.count("*").alias("in_sources")).withColumn("in_all", F.col("in_sources") == len(sources))


def _gaps(df: DataFrame) -> DataFrame:
    """(machine_id, at, gap_s): the time from a machine's reading before. Gaps inside a bucket of
    time come of its readings, those between buckets of the buckets' first and last readings, a
    row per bucket; no machine's history has to be in one task."""
    bucket = F.col(BUCKET) if BUCKET in df.columns else bucket_of(us("ts"))
    rows = df.select("machine_id", us("ts").alias("at"), bucket.alias("bucket"))
    own = Window.partitionBy("machine_id", "bucket").orderBy("at")
    within = rows.withColumn("before", F.lag("at").over(own))
    ends = rows.groupBy("machine_id", "bucket").agg(F.min("at").alias("at"), F.max("at").alias("last"))
    between = ends.withColumn("before", F.lag("last").over(Window.partitionBy("machine_id").orderBy("bucket")))
    found = within.select("machine_id", "at", "before").unionByName(between.select("machine_id", "at", "before")).where("before IS NOT NULL")
    return found.select("machine_id", "at", ((F.col("at") - F.col("before")) / 1e6).alias("gap_s"))


def sampling_gaps(df: DataFrame, name: str, longest_s: float = 5.0) -> DataFrame:
    """(source, median_s, gaps, longest_gap_s): interval between a machine's neighbouring readings."""
    gaps = kept(_gaps(df))
    middle = selection.median(gaps, F.col("gap_s"))
    out = gaps.agg(F.count_if(F.col("gap_s") > longest_s).alias("gaps"), F.max("gap_s").alias("longest_gap_s"))
    return out.select(F.lit(name).alias("source"), F.lit(middle).cast("double").alias("median_s"), "gaps", "longest_gap_s")


def dropouts(df: DataFrame, longest_s: float = 5.0) -> DataFrame:
    """(machine_id, at_us, gap_s) of gaps above a length; the time is that of the reading after it."""
    return _gaps(df).where(F.col("gap_s") > longest_s).select("machine_id", F.col("at").alias("at_us"), "gap_s")


def in_job_share(labelled: DataFrame) -> DataFrame:
    return labelled.agg(F.avg(F.col("job_id").isNotNull().cast("double")).alias("in_job_share"), F.count_distinct("job_id").alias("jobs_seen"))


def power_vibration_correlation(cutting: DataFrame) -> DataFrame:
    """(part_type or null for all, n, correlation, p05_kw, p95_kw), by grouping sets."""
    sums = cutting.groupingSets([["part_type"], []], "part_type").agg(F.count("*").alias("n"), F.corr("net_power_kw", "vibration_rms_g").alias("correlation"), F.grouping("part_type").alias("every"))
    whole = selection.quantiles(cutting, F.col("net_power_kw"), [0.05, 0.95])
    q = selection.by_group(cutting, ["part_type"], F.col("net_power_kw"), [0.05, 0.95]).select(F.col("part_type").alias("of"), "q", F.lit(0).cast("byte").alias("of_every"))
    every = cutting.sparkSession.createDataFrame([(None, whole, 1)], "of string, q array<double>, of_every byte")
    out = sums.join(q.unionByName(every), F.col("part_type").eqNullSafe(F.col("of")) & (F.col("every") == F.col("of_every")), "left")
    return out.select("part_type", "n", "correlation", F.col("q")[0].alias("p05_kw"), F.col("q")[1].alias("p95_kw"))


def sextile_spread(cutting: DataFrame, buckets: int = 6) -> DataFrame:
    """Median power and spread of vibration per power bucket; buckets are right-closed between
    quantiles, equal edges count once. The edges are a handful of scalars."""
    edges = selection.quantiles(cutting, F.col("net_power_kw"), [i / buckets for i in range(buckets + 1)]) or []
    inner = sorted(set(edges))[1:-1]
    bucket = sum(((F.col("net_power_kw") > e).cast("int") for e in inner), F.lit(0))
    rows = cutting.withColumn("bucket", bucket)
    sums = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.stddev("vibration_rms_g").alias("sd_rms"), F.stddev("log_vibration_rms_g").alias("sd_log_rms"))
    return sums.join(selection.medians(rows, ["bucket"], F.col("net_power_kw"), "power_kw"), "bucket").select("bucket", "n", "power_kw", "sd_rms", "sd_log_rms")


def sextile_ratios(spread: DataFrame) -> DataFrame:
    """One row: greatest over least spread of the buckets of ``sextile_spread``, plain and logarithmic."""
    ratio = lambda c: F.max(c) / F.nullif(F.min(c), F.lit(0.0))
    return spread.agg(ratio("sd_rms").alias("rms_ratio"), ratio("sd_log_rms").alias("log_ratio"))


def part_pivot(cutting: DataFrame) -> DataFrame:
    """(machine_id, part_type, median_ratio): the long form of the machine by part table."""
    return selection.medians(cutting, ["machine_id", "part_type"], F.col("vib_per_kw"), "median_ratio")


def part_pivot_wide(cutting: DataFrame) -> DataFrame:
    """machine_id and a column per part type, of which there are few."""
    return part_pivot(cutting).groupBy("machine_id").pivot("part_type").agg(F.first("median_ratio"))
