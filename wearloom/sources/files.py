"""Reading sensor exports and writing results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wearloom.operators.linear import Linear

#: Required columns of each source, by kind.
POWER = {"timestamp": "time", "machine_id": "text", "power_kw": "number"}
VIBRATION = {"timestamp": "time", "machine_id": "text", "vibration_rms_g": "number", "vibration_peak_g": "number"}
PRODUCTION_LOG = {"job_id": "text", "machine_id": "text", "part_type": "text", "operator": "text", "quantity": "number", "start_time": "time", "end_time": "time"}


#: Times in CSV keep their microseconds.
TIMES = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def require_columns(df: DataFrame, required, source: str) -> None:
    """Raises with the names that a source lacks; looks at metadata only."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{source} lacks the columns {', '.join(missing)}")


def lenient(name: str, kind: str) -> Column:
    """A raw string as time (UTC), trimmed text or number; what does not parse is null."""
    if kind == "time":
        return F.expr(f"try_cast(trim(`{name}`) AS timestamp)")
    if kind == "text":
        return F.trim(F.col(name))
    number = F.expr(f"try_cast(trim(`{name}`) AS double)")
    return F.when(~F.isnan(number), number)


def load(spark: SparkSession, path: str, columns: dict[str, str], source: str, keep_others: bool = False) -> DataFrame:
    raw = spark.read.csv(path, header=True)  # no schema inference: all strings
    require_columns(raw, columns, source)
    others = [c for c in raw.columns if c not in columns] if keep_others else []
    return raw.select(*[lenient(c, kind).alias("ts" if c == "timestamp" else c) for c, kind in columns.items()], *others)


def load_power(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, path, POWER, "power")


def load_vibration(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, path, VIBRATION, "vibration")


def load_production_log(spark: SparkSession, path: str) -> DataFrame:
    """Extra columns are kept."""
    return load(spark, path, PRODUCTION_LOG, "production log", keep_others=True)


def write_job_summary(summary: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Parquet, or CSV in one file: the table has one row per job."""
    if fmt == "csv":
        summary.coalesce(1).write.mode("overwrite").option("timestampFormat", TIMES).csv(path, header=True)
    else:
        summary.write.mode("overwrite").parquet(path)


def write_scored(scored: DataFrame, path: str, fmt: str = "parquet", rows_per_file: int = 1_000_000) -> None:
    """The per-reading audit table by machine, ordered by time in each file; Parquet or gzip CSV.

    Rows are dealt out by machine and time range, so a machine has as many files as its readings
    fill, not one per task, and machines with most of the readings are shared by many tasks.
    """
    laid_out = scored.repartitionByRange("machine_id", "ts").sortWithinPartitions("machine_id", "ts")
    writer = laid_out.write.mode("overwrite").partitionBy("machine_id").option("maxRecordsPerFile", rows_per_file)
    if fmt == "csv":
        writer.option("compression", "gzip").option("timestampFormat", TIMES).csv(path, header=True)
    else:
        writer.parquet(path)


def write_diagnostics(diagnostics: DataFrame, path: str) -> None:
    diagnostics.write.mode("overwrite").json(path)


def save_detector(spark: SparkSession, detector: dict, path: str) -> None:
    """A fitted detector: its numbers as one JSON row, its tables (machines' coefficients,
    densities) as Parquet beside them."""
    primary, secondary = detector["primary"], dict(detector["secondary"])
    tables = {"machines": primary.machines} | {k: secondary.pop(k) for k in ("reference", "factors") if secondary.get(k) is not None}
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    text = json.dumps(detector | {"primary": primary.as_dict(), "secondary": secondary, "tables": list(tables)})
    spark.createDataFrame([(text,)], "detector string").coalesce(1).write.mode("overwrite").text(f"{path}/numbers")


def load_detector(spark: SparkSession, path: str) -> dict:
    detector = json.loads(spark.read.text(f"{path}/numbers").first()[0])
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in detector.pop("tables")}
    primary = Linear(**detector["primary"], machines=tables.pop("machines"))
    return detector | {"primary": primary, "secondary": detector["secondary"] | tables}
