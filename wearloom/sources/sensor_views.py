"""Sensor tables derived from ``events`` and ``orders`` by arithmetic only.

The given tables hold no sensors. Fifty users are a machine, a batch of 160 orders is a job,
and a machine has one job a day, so machines, jobs and readings grow with the tables and a
job's readings do not thin out. The log's clock is five hours behind the sensors. Defects of
every kind that cleaning knows are planted by fixed rules, so that every query has a known
answer at every scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400_000_000
#: Fixed value: 2024-01-01 in microseconds.
EPOCH = 1_704_067_200_000_000
#: Orders of a job, jobs of a machine (one a day), users of a machine.
ORDERS, DAYS, USERS = 160, 31, 50
#: Length of a job, and how far the log's clock is behind, in microseconds.
SHIFT, BEHIND = 50_400_000_000, 18_000_000_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings to be: machine, whether its job of that day runs (cut), whether its tool is worn, power level of its part."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = events.select("event_id", F.expr("unix_micros(cast(ts AS timestamp))").alias("us"), F.expr(f"user_id div {USERS}").alias("m"), F.least("value", F.lit(200.0)).alias("v"))
    at = at.selectExpr("*", f"m * {DAYS} + (us - {EPOCH}) div {DAY} AS b", f"us % {DAY} AS tod")
    at = at.selectExpr("*", f"tod - {BEHIND} - (b % 7) * 600000000 AS since")
    return at.selectExpr(
        "event_id", "timestamp_micros(us) AS ts", "concat('M', m) AS machine_id", "v", f"since >= 0 AND since <= {SHIFT} AS cut", "b % 8 = 3 AS worn",
        "CASE b % 5 WHEN 0 THEN 4.0D WHEN 1 THEN 5.5D WHEN 2 THEN 8.0D WHEN 3 THEN 10.5D ELSE 14.0D END AS base",
    )


def power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, machine_id, power_kw) with sentinels, negative values, nulls and re-sent rows."""
    rows = _events(spark, sf_dir).where("event_id % 2 = 0").selectExpr(
        "event_id", "ts", "IF(event_id % 2500 = 12, NULL, machine_id) AS machine_id",
        "CASE WHEN event_id % 1250 = 0 THEN 9999.0D WHEN event_id % 1666 = 2 THEN -3.0D WHEN event_id % 998 = 10 THEN NULL"
        " WHEN cut THEN 0.3D + base * (1 + (v - 50) / 1000) ELSE 0.3D + v / 10000 END AS power_kw",
    )
    return rows.unionByName(rows.where("event_id % 1000 = 4")).drop("event_id")


def vibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, machine_id, vibration_rms_g, vibration_peak_g) with sentinels of both kinds, negative
    values, nulls, peaks below the mean and re-sent rows."""
    rows = _events(spark, sf_dir).where("event_id % 2 = 1").selectExpr(
        "event_id", "ts", "machine_id", "cut", "worn",
        "CASE WHEN event_id % 900 = 31 THEN NULL WHEN event_id % 1100 = 51 THEN -0.1D WHEN event_id % 1300 = 71 THEN 9999.0D"
        " WHEN cut THEN 0.04D * base * (1 + (v - 50) / 800) * IF(worn, 1.7D, 1.0D) ELSE 0.01D + v / 100000 END AS vibration_rms_g",
    ).selectExpr(
        "event_id", "ts", "machine_id", "vibration_rms_g",
        "CASE WHEN event_id % 1700 = 91 THEN 9999.0D WHEN event_id % 700 = 21 THEN vibration_rms_g * 0.5D"
        " ELSE vibration_rms_g * IF(cut AND worn, 4.8D, 3.0D) * (1 + (event_id % 11) / 200.0D) END AS vibration_peak_g",
    )
    return rows.unionByName(rows.where("event_id % 1000 = 5")).drop("event_id")


def production_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per job, some with swapped times, no quantity, no start, no length, an end within
    the next job, or a second row."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    jobs = orders.groupBy(F.expr(f"o_orderkey div {ORDERS}").alias("b")).agg(F.min("o_custkey").alias("c"))
    rows = jobs.selectExpr("b", "c", f"b div {DAYS} AS m", f"{EPOCH} + (b % {DAYS}) * {DAY} + (b % 7) * 600000000 AS a")
    rows = rows.selectExpr("*", f"CASE WHEN b % 41 = 9 THEN a WHEN b % 17 = 6 THEN a + {SHIFT} + 43200000000 ELSE a + {SHIFT} END AS z")
    rows = rows.unionByName(rows.where("b % 25 = 4").withColumn("z", F.col("z") + 3_600_000_000))
    return rows.selectExpr(
        "concat('J', b) AS job_id", "concat('M', m) AS machine_id", "concat('P', b % 5) AS part_type", "concat('op', c % 5) AS operator",
        "CASE WHEN b % 29 = 7 THEN NULL ELSE cast(1 + c % 20 AS double) END AS quantity",
        "CASE WHEN b % 37 = 5 THEN NULL WHEN b % 30 = 11 THEN timestamp_micros(z) ELSE timestamp_micros(a) END AS start_time",
        "timestamp_micros(IF(b % 30 = 11, a, z)) AS end_time",
    )
