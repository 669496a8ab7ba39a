"""Cleaning of readings and of the production log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearloom.functions import selection, tables
from wearloom.functions.columns import us
from wearloom.functions.tables import kept
from wearloom.operators.joins import BUCKET, bucket_of
from wearloom.params import Params

SWAPPED = "start and end swapped in the log; exchanged"
IMPUTED = "quantity missing in the log; median of the part type used"


def upper_fence(df: DataFrame, column: str, multiple: float) -> float:
    """Q3 + multiple * max(IQR, 1e-9) over finite values; infinity without any."""
    q = selection.quantiles(df, F.col(column), [0.25, 0.75])
    return q[1] + multiple * max(q[1] - q[0], 1e-9) if q else float("inf")


def _tagged(df: DataFrame, rule: str, broken: Column) -> DataFrame:
    """Marks rows that no earlier rule has marked."""
    return df.withColumn("dropped_by", F.coalesce("dropped_by", F.when(broken, F.lit(rule))))


def _first_of_each(df: DataFrame, keys: list[str], order: list, rule: str) -> DataFrame:
    """Marks all but the first of the unmarked rows of a key. Marked rows, whose keys may be null,
    take no part."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    left = _tagged(df.where("dropped_by IS NULL").withColumn("place", place), rule, F.col("place") > 1).drop("place")
    return left.unionByName(df.where("dropped_by IS NOT NULL"))


def _above_fence(df: DataFrame, column: str, rule: str, p: Params, bounds: dict | None, most: float = float("inf")) -> DataFrame:
    bound = min(most, upper_fence(df.where("dropped_by IS NULL"), column, p.robust_outlier_iqr_multiple))
    if bounds is not None:
        bounds[column] = bound
    return _tagged(df, rule, F.col(column) > bound)


def _laid_out(readings: DataFrame, values: list[str], p: Params, pieces: int | None) -> tuple[DataFrame, DataFrame]:
    """(readings with a machine, a time and values, re-sent ones marked; the others, marked null).

    The first are stored by machine and time bucket (column ``_bucket``, which readings must
    not have). This is the only time that readings are dealt out: finding re-sent rows, the
    offset search, labels, gaps and pairing keep to the buckets. Rows without a key are not
    dealt out at all.
    """
    df = readings.withColumn("dropped_by", F.lit(None).cast("string"))
    df = _tagged(df, "null", reduce(Column.__or__, [F.col(c).isNull() for c in ("ts", "machine_id", *values)]))
    keys, pieces = ["machine_id", BUCKET], pieces or tables.pieces_for(readings)
    rows = df.where("dropped_by IS NULL").withColumn(BUCKET, bucket_of(us("ts"))).repartition(pieces, *keys)
    if p.drop_duplicate_readings:
        place = F.row_number().over(Window.partitionBy(*keys, "ts").orderBy(*values))
        rows = _tagged(rows.withColumn("place", place), "duplicate", F.col("place") > 1).drop("place")
    return tables.laid_out(rows, keys, ["ts"], pieces), df.where("dropped_by IS NOT NULL")


def whole(rows: DataFrame, others: DataFrame) -> DataFrame:
    return rows.drop(BUCKET).unionByName(others)


def stored_power(power: DataFrame, p: Params = Params(), bounds: dict | None = None, pieces: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The two parts of ``tag_power``: readings stored by machine and time bucket, and those without a key or value."""
    rows, others = _laid_out(power, ["power_kw"], p, pieces)
    rows = _tagged(rows, "negative", F.col("power_kw") < p.power_min_kw)
    return _above_fence(rows, "power_kw", "sentinel", p, bounds, p.power_abs_max_kw), others


def stored_vibration(vibration: DataFrame, p: Params = Params(), bounds: dict | None = None, pieces: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The two parts of ``tag_vibration``."""
    rms, peak = F.col("vibration_rms_g"), F.col("vibration_peak_g")
    rows, others = _laid_out(vibration, ["vibration_rms_g", "vibration_peak_g"], p, pieces)
    rows = _tagged(_tagged(rows, "negative", (rms < 0) | (peak < 0)), "peak_below_rms", peak < rms)
    rows = _above_fence(rows, "vibration_rms_g", "rms_sentinel", p, bounds)
    return _above_fence(rows, "vibration_peak_g", "peak_sentinel", p, bounds), others


def tag_power(power: DataFrame, p: Params = Params(), bounds: dict | None = None) -> DataFrame:
    """power with dropped_by: the first rule that drops a row, else null. The fence is that
    of the rows which the rules before it leave; ``bounds`` is told it by column."""
    return whole(*stored_power(power, p, bounds))


def tag_vibration(vibration: DataFrame, p: Params = Params(), bounds: dict | None = None) -> DataFrame:
    return whole(*stored_vibration(vibration, p, bounds))


def cleaning_details(tagged: DataFrame, source: str, bounds: dict, rules: dict[str, str]) -> DataFrame:
    """(source, column, bound, sentinels) per fenced column: its fence, and how many values lay above it."""
    counts = tagged.agg(*[F.count_if(F.col("dropped_by") == rule).alias(column) for column, rule in rules.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(float(bounds[c])).alias("bound"), F.col(c).alias("sentinels")) for c in rules])
    return counts.select(F.explode(rows).alias("x")).select(F.lit(source).alias("source"), "x.*")


def cleaning_facts(tagged: DataFrame, source: str, bounds: dict, rules: dict[str, str]) -> DataFrame:
    """(source, column, bound, sentinels, sentinel_value, machine_id, n) per fenced column: a row for the
    fence (n: values above it), one for each value above it and one for each machine that is left (n: rows)."""
    fences = kept(cleaning_details(tagged, source, bounds, rules))
    by_rule = F.create_map(*[e for c, rule in rules.items() for e in (F.lit(rule), F.col(c).cast("double"))])
    left = F.col("dropped_by").isNull()
    groups = tagged.where(left | F.col("dropped_by").isin(*rules.values())).groupBy(F.col("dropped_by").alias("rule"), by_rule[F.col("dropped_by")].alias("sentinel_value"), F.when(left, F.col("machine_id")).alias("machine_id")).agg(F.count("*").alias("n"))
    of = F.array_compact(F.array(*[F.when(F.col("rule").isNull() | (F.col("rule") == rule), F.lit(c)) for c, rule in rules.items()]))
    facts = groups.select(F.explode(of).alias("column"), "sentinel_value", "machine_id", "n")
    return fences.select("*", F.lit(None).cast("double").alias("sentinel_value"), F.lit(None).cast("string").alias("machine_id"), F.col("sentinels").alias("n")).unionByName(facts.join(F.broadcast(fences), "column"))


def sentinel_values(tagged: DataFrame, source: str, rules: dict[str, str]) -> DataFrame:
    """(source, column, value, n): a row for each value above a fence."""
    pairs = F.array(*[F.when(F.col("dropped_by") == rule, F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))) for c, rule in rules.items()])
    hits = tagged.where(F.col("dropped_by").isin(*rules.values())).select(F.explode(F.array_compact(pairs)).alias("x"))
    return hits.groupBy("x.column", "x.value").agg(F.count("*").alias("n")).select(F.lit(source).alias("source"), "column", "value", "n")


def machines_left(tagged: DataFrame, source: str) -> DataFrame:
    """(source, machine_id) of the rows that no rule drops."""
    return tagged.where("dropped_by IS NULL").select(F.lit(source).alias("source"), "machine_id").distinct()


def clean_power(power: DataFrame, p: Params = Params()) -> DataFrame:
    return tag_power(power, p).where("dropped_by IS NULL").drop("dropped_by")


def clean_vibration(vibration: DataFrame, p: Params = Params()) -> DataFrame:
    return tag_vibration(vibration, p).where("dropped_by IS NULL").drop("dropped_by")


def cleaning_report(tagged: DataFrame, source: str) -> DataFrame:
    """(source, rule, rows): rows kept and rows dropped per rule, from one pass."""
    return tagged.groupBy(F.coalesce("dropped_by", F.lit("kept")).alias("rule")).agg(F.count("*").alias("rows")).select(F.lit(source).alias("source"), "rule", "rows")


def tag_jobs(log: DataFrame, p: Params = Params()) -> DataFrame:
    """The log with repaired times, duration, quantity, notes and dropped_by."""
    df = log.withColumn("dropped_by", F.lit(None).cast("string"))
    df = _tagged(df, "unparsed_time", F.col("start_time").isNull() | F.col("end_time").isNull())
    df = _first_of_each(df, ["job_id"], ["start_time", "end_time", "machine_id"], "duplicate")
    df = df.withColumn("was_reversed", F.coalesce(F.col("end_time") < F.col("start_time"), F.lit(False)))
    if p.swap_reversed_job_times:
        df = df.withColumns({"start_time": F.least("start_time", "end_time"), "end_time": F.greatest("start_time", "end_time")})
    else:
        df = _tagged(df, "reversed", F.col("was_reversed"))
    df = df.withColumn("duration_s", (us("end_time") - us("start_time")) / 1e6)
    df = _tagged(df, "too_short", F.col("duration_s") < p.min_job_duration_s)
    df = df.withColumn("quantity_imputed", F.col("quantity").isNull())
    if p.impute_missing_quantity:
        left = df.where("dropped_by IS NULL")
        by_part = left.groupBy(F.col("part_type").alias("of_part")).agg(F.median("quantity").alias("part_median"))
        overall = selection.median(left, F.col("quantity"))
        df = df.join(by_part, F.col("part_type").eqNullSafe(F.col("of_part")), "left")
        df = df.withColumn("quantity", F.coalesce("quantity", "part_median", F.lit(overall).cast("double"))).drop("of_part", "part_median")
    else:
        df = _tagged(df, "no_quantity", F.col("quantity_imputed"))
    note = F.concat_ws("; ", F.when(F.col("was_reversed"), F.lit(SWAPPED)), F.when(F.col("quantity_imputed"), F.lit(IMPUTED)))
    return df.withColumn("data_quality_notes", note)


def clean_jobs(log: DataFrame, p: Params = Params()) -> DataFrame:
    return tag_jobs(log, p).where("dropped_by IS NULL").drop("dropped_by")


def overlapping_jobs(jobs: DataFrame) -> DataFrame:
    """(machine_id, pair): neighbours on a machine of which the later starts before the earlier ends."""
    own = Window.partitionBy("machine_id").orderBy("start_time", "job_id")
    df = jobs.withColumns({"before_end": F.lag("end_time").over(own), "before_id": F.lag("job_id").over(own)})
    return df.where("start_time < before_end").select("machine_id", F.concat_ws("->", "before_id", "job_id").alias("pair"))
