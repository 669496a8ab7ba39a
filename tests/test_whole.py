"""Queries whose lists were once moved elsewhere: everything that their former SQL returned is in their rows."""

import sys
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from wearloom.jobs import oracle, registry, wear
from wearloom.llm.components import connected_components
from wearloom.operators import clean, features, profile

SMALL = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def former():
    """Rows of a body of SQL over the views of the small tables."""
    con = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")

    def run(body):
        cur = con.execute(f"{oracle.VIEWS}\n{body}")
        names = [d[0] for d in cur.description]
        return [dict(zip(names, row)) for row in cur.fetchall()]

    return run


def rows(spark, name):
    return [r.asDict() for r in registry.queries()[name](spark, SMALL).collect()]


def test_cleaning_details_names_values_and_machines(spark, former):
    was = former(
        """SELECT 'power_kw' AS "column", count(*) AS sentinels, list(DISTINCT power_kw) AS sentinel_values, (SELECT list(DISTINCT machine_id) FROM power_c) AS machines FROM pn WHERE power_kw > least(500, (SELECT bound FROM pf))
UNION ALL SELECT 'vibration_rms_g', count(*), list(DISTINCT vibration_rms_g), (SELECT list(DISTINCT machine_id) FROM vib_c) FROM vn WHERE vibration_rms_g > (SELECT bound FROM vf)
UNION ALL SELECT 'vibration_peak_g', count(*), list(DISTINCT vibration_peak_g), (SELECT list(DISTINCT machine_id) FROM vib_c) FROM vr WHERE vibration_peak_g > (SELECT bound FROM vg)"""
    )
    got = rows(spark, "cleaning_details")
    for w in was:
        own = [r for r in got if r["column"] == w["column"]]
        values = {r["sentinel_value"]: r["n"] for r in own if r["sentinel_value"] is not None}
        assert set(values) == set(w["sentinel_values"] or []) and sum(values.values()) == w["sentinels"]
        assert sorted(r["machine_id"] for r in own if r["machine_id"]) == sorted(w["machines"])
        assert {r["sentinels"] for r in own} == {w["sentinels"]}


def test_cleaning_facts_without_readings(spark):
    schema, bounds = "ts timestamp, machine_id string, power_kw double", {}
    readings = [(T0 + timedelta(seconds=i), f"M{i % 2}", 5.0 + i % 3) for i in range(40)] + [(T0, "M2", 9999.0), (T0, "M3", 8888.0), (T0, "M4", 9999.0)]
    tagged = clean.tag_power(spark.createDataFrame(readings, schema), bounds=bounds)
    got = {(r.sentinel_value, r.machine_id): r.n for r in clean.cleaning_facts(tagged, "power", bounds, wear.FENCED["power"]).collect()}
    assert got == {(None, None): 3, (9999.0, None): 2, (8888.0, None): 1, (None, "M0"): 20, (None, "M1"): 20}
    tagged = clean.tag_power(spark.createDataFrame([], schema), bounds=bounds)
    assert [(r.sentinels, r.sentinel_value, r.machine_id, r.n) for r in clean.cleaning_facts(tagged, "power", bounds, wear.FENCED["power"]).collect()] == [(0, None, None, 0)]


def test_quality_summary_names_the_silent_jobs(spark, former):
    (was,) = former(
        """SELECT count(*) AS jobs, count(*) FILTER (power_readings = 0) AS jobs_without_power, count(*) FILTER (vibration_readings = 0) AS jobs_without_vibration, count(*) FILTER (vibration_readings < 20) AS jobs_below_min_readings,
  list(job_id) FILTER (power_readings = 0 OR vibration_readings = 0) AS silent FROM metrics"""
    )
    got = rows(spark, "quality_summary")
    silent = sorted(was.pop("silent") or [])
    assert sorted(r.pop("job_id_without_sensor_data") or "" for r in got) == ["", *silent] and all(r == was for r in got)


def test_quality_facts_with_and_without_silent_jobs(spark):
    schema = "job_id string, machine_id string, power_readings long, vibration_readings long"
    got = features.quality_facts(spark.createDataFrame([("J1", "M0", 30, 30), ("J2", "M0", 0, 30), ("J3", "M0", 30, 0), ("J4", "M1", 9, 9)], schema)).collect()
    assert sorted(tuple(r) for r in got if r[4]) == [(4, 1, 1, 2, "J2"), (4, 1, 1, 2, "J3")] and [tuple(r) for r in got if not r[4]] == [(4, 1, 1, 2, None)]
    assert [tuple(r) for r in features.quality_facts(spark.createDataFrame([], schema)).collect()] == [(0, 0, 0, 0, None)]


def test_defect_values_and_the_percentile_of_the_rest(spark, former):
    (was,) = former(
        """SELECT (SELECT list(DISTINCT power_kw) FROM power_raw WHERE power_kw < 0) AS negative, (SELECT list(DISTINCT power_kw) FROM power_raw WHERE power_kw > 100) AS implausible,
  quantile_cont(power_kw, 0.999) AS p999, count(*) AS n FROM power_raw WHERE power_kw BETWEEN 0 AND 100"""
    )
    got = rows(spark, "defect_values")
    for defect, values in (("negative power", was["negative"]), ("implausible power", was["implausible"])):
        assert sorted(r["value"] for r in got if r["defect"] == defect) == sorted(values or [])
    assert [(r["value"], r["n"]) for r in got if r["defect"].startswith("99.9th")] == [(was["p999"], was["n"])]
    none = profile.defect_values(spark.createDataFrame([(-1.0,), (None,)], "power_kw double")).collect()
    assert sorted(tuple(r) for r in none) == [("99.9th percentile of the rest", None, 0), ("negative power", -1.0, 1)]


def test_component_rounds_write_few_files(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200) if i % 50 != 49], "a long, b long")
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = connected_components(edges)
        assert {(r.node, r.component) for r in found.collect()} == {(i, i // 50 * 50) for i in range(200)}
        assert len(set(found.inputFiles())) <= spark.sparkContext.defaultParallelism
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
