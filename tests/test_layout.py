"""Stored layout: readings are dealt out once, what follows reads them in place."""

import re
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearloom.functions.tables import released, shared_folder
from wearloom.jobs import wear
from wearloom.operators import align, clean, joins, profile
from wearloom.params import Params

T0 = datetime(2024, 1, 1)
at = lambda s: T0 + timedelta(seconds=float(s))
DAY = 86_400


@pytest.fixture
def raw(spark):
    """Three days of two sensors; one machine has nine tenths of the readings, every tenth is sent again."""
    rng = np.random.default_rng(11)
    times = np.sort(rng.choice(3 * DAY, 6000, replace=False))
    machine = lambda i: "M0" if i % 10 else "M1"
    busy = lambda t: 5 * 3600 <= t % DAY < 15 * 3600
    power = [(at(t), machine(i), float((5 if busy(t) else 1) + rng.random())) for i, t in enumerate(times)]
    vibration = [(at(t + 2), machine(i), 0.5, 1.5) for i, t in enumerate(times)]
    power += power[::10] + [(None, "M0", 1.0)] * 700 + [(at(5), None, 1.0)] * 700
    log = [(f"J{m}{d}", f"M{m}", "P", "op", 1.0, at(d * DAY + m * 600), at(d * DAY + 36_000)) for m in (0, 1) for d in range(3)]
    return (
        spark.createDataFrame(power, "ts timestamp, machine_id string, power_kw double"),
        spark.createDataFrame(vibration, "ts timestamp, machine_id string, vibration_rms_g double, vibration_peak_g double"),
        spark.createDataFrame(log, "job_id string, machine_id string, part_type string, operator string, quantity double, start_time timestamp, end_time timestamp"),
    )


def exchanged(spark, df) -> tuple[int, int]:
    """(rows that were exchanged, exchanges) of a run without adaptive plans and broadcasts."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        plan = df.select("*")._jdf.queryExecution().executedPlan()
        plan.execute().count()
        rows, n, todo = 0, 0, [plan]
        while todo:
            node = todo.pop()
            if node.nodeName() == "Exchange":
                rows, n = rows + node.metrics().apply("shuffleRecordsWritten").value(), n + 1
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return rows, n
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_labels_pairs_gaps_and_search_exchange_no_readings(spark, raw):
    prepared = wear.prepare(*raw, Params(pair_tolerance_s=30.0))
    readings = prepared.stored_power.count()
    assert readings == 6000 and prepared.offset_s == 5 * 3600
    labels = prepared._labelled(prepared.stored_vibration)
    rows, n = exchanged(spark, labels)
    assert n and rows < 100  # jobs and the buckets that they touch
    assert exchanged(spark, prepared.paired)[0] < 100 + 200  # and power readings at the edges of 12 buckets
    assert exchanged(spark, joins.in_any_window(prepared.stored_power, prepared.jobs, "start_time_aligned", "end_time_aligned"))[0] < 100
    assert exchanged(spark, profile._gaps(prepared.stored_vibration))[0] < 100
    steps = align.coarse_offsets(prepared.p)
    sums = align.bucket_sums(prepared.stored_power)
    lifts = align.machine_offset_scores(prepared.stored_power, prepared.clean_jobs, steps, sums, prepared.pieces)
    rows, _ = exchanged(spark, lifts)
    assert rows < 12 * len(steps) * 6  # boundaries per offset in each step of the plan, whatever the readings
    plain = align.machine_offset_scores(prepared.clean_power, prepared.clean_jobs, steps)
    assert sorted((r[0], r[1], round(r[2], 9)) for r in lifts.collect()) == sorted((r[0], r[1], round(r[2], 9)) for r in plain.collect())


def test_stored_rows_equal_plain_ones(spark, raw):
    prepared = wear.prepare(*raw, Params(pair_tolerance_s=30.0))
    same = lambda a, b: a.select(*b.columns).exceptAll(b).count() == 0 == b.exceptAll(a.select(*b.columns)).count()
    power, vibration = clean.clean_power(raw[0]), clean.clean_vibration(raw[1])
    assert same(prepared.clean_power, power) and same(prepared.clean_vibration, vibration)
    labels = joins.assign_jobs(vibration, prepared.jobs, start="start_time_aligned", end="end_time_aligned")
    assert same(prepared.vibration, labels)
    for hours in (1, 6):
        assert same(prepared.paired, joins.pair_with_power(labels, power, 30.0, bucket_us=hours * joins.HOUR))
    # A tolerance wider than a bucket reaches over several.
    wide = prepared._labelled(prepared.stored_vibration)
    far = joins.pair_with_power(wide, prepared.stored_power.where("machine_id = 'M0'").limit(1), 3.0 * DAY, pieces=prepared.pieces)
    assert far.where("machine_id = 'M0' AND power_kw IS NULL").count() == 0
    report = {r.rule: r["rows"] for r in clean.cleaning_report(prepared.tagged_power, "power").collect()}
    assert report == {"kept": 6000, "duplicate": 600, "null": 1400}


def test_layout_has_one_file_per_piece_in_order_and_is_removed(spark, raw):
    folder = Path(re.sub("^file:", "", shared_folder(spark)))
    before, tables = set(folder.iterdir()), {t.name for t in spark.catalog.listTables()}
    with released(spark):
        rows, others = clean.stored_power(raw[0], Params(), pieces=6)
        new = [p for p in folder.iterdir() if p not in before]
        parts = [f for p in new for f in p.glob("part-*.parquet")]
        assert len(parts) <= 6 and others.count() == 1400
        for f in parts:
            keys = [(r.machine_id, r._bucket, r.ts) for r in spark.read.parquet(str(f)).collect()]
            assert keys == sorted(keys)
        spread = rows.where("machine_id = 'M0'").groupBy(F.spark_partition_id()).count().count()
        assert spread > 1  # a machine with most of the readings is in several files
    assert set(folder.iterdir()) == before and {t.name for t in spark.catalog.listTables()} == tables
