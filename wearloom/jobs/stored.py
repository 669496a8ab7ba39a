"""A detector of plain numbers, for jobs that load one: saved, read again, and judged by SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from wearloom.functions.tables import shared_folder
from wearloom.operators.linear import Linear
from wearloom.sources import files

#: Numbers near what fits of the views find; machines that are not named add nothing.
PRIMARY = {"intercept": -3.22, "power": 1.0, "quantity": 0.0002}
PARTS = {"P1": (0.01, -0.004), "P2": (-0.02, 0.01), "P3": (0.015, -0.006)}
MACHINES = {"M0": (0.004, -0.002), "M1": (-0.006, 0.003), "M2": (0.002, 0.001)}
CENTRE, SCALE, SIGMAS = 0.001, 0.03, 6.0
#: Of (log power, log vibration per power, peak to mean).
MIDDLE = (2.1, -3.2, 3.1)
PRECISION = ((4.0, 0.5, 0.1), (0.5, 400.0, 2.0), (0.1, 2.0, 25.0))
THRESHOLD = 6.0


def detector(spark: SparkSession) -> dict:
    machines = spark.createDataFrame([(k, [a], [b]) for k, (a, b) in MACHINES.items()], "machine_id string, shifts array<double>, slopes array<double>")
    return {
        "target": "log_vibration_rms_g", "primary": Linear(**PRIMARY, parts=PARTS, machines=machines), "centre": CENTRE, "scale": SCALE, "sigma_multiple": SIGMAS, "one_sided": True,
        "secondary": {"kind": "mahalanobis", "centre": list(MIDDLE), "precision": [list(row) for row in PRECISION], "threshold": THRESHOLD},
        "n_fit_readings": 0, "residual_std": None, "r2": None, "part_types": sorted(PARTS), "backend": "iterated",
    }


def reread(spark: SparkSession, name: str) -> dict:
    """The detector as a later job has it: written to the shared folder and loaded again."""
    path = f"{shared_folder(spark)}/detector-{name}-{spark.sparkContext.applicationId}"
    files.save_detector(spark, detector(spark), path)
    return files.load_detector(spark, path)


def reread_table(df: DataFrame, name: str, write) -> DataFrame:
    """A result as a reader of the sink sees it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{df.sparkSession.sparkContext.applicationId}"
    write(df, path)
    return df.sparkSession.read.parquet(path)


def loading(p):
    return replace(p, mode="load")


def prediction_sql() -> str:
    """The prediction over the columns of a reading, in SQL."""
    level = lambda names, column, i: f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in names.items()) + " ELSE 0 END"
    shift = f"{PRIMARY['intercept']} + {level(PARTS, 'part_type', 0)} + {level(MACHINES, 'machine_id', 0)}"
    slope = f"{PRIMARY['power']} + {level(PARTS, 'part_type', 1)} + {level(MACHINES, 'machine_id', 1)}"
    return f"({shift} + ({slope}) * log_net_power_kw + {PRIMARY['quantity']} * coalesce(quantity, 0))::DOUBLE"


def distance_sql() -> str:
    off = [f"({c} - ({m}))" for c, m in zip(("log_net_power_kw", "log_vib_per_kw", "peak_to_rms"), MIDDLE)]
    return "sqrt(greatest((" + " + ".join(f"{PRECISION[i][j]} * {off[i]} * {off[j]}" for i in range(3) for j in range(3)) + ")::DOUBLE, 0.0))"
