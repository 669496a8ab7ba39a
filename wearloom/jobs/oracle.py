"""DuckDB SQL for the registered queries that SQL can express, written apart from the Spark code."""

from __future__ import annotations

from wearloom.jobs import stored

VIEWS = """
WITH ev AS (SELECT event_id, epoch_us(ts) AS us, user_id // 50 AS m, least(value, 200.0) AS v FROM events),
e1 AS (SELECT *, m * 31 + (us - 1704067200000000) // 86400000000 AS b, us % 86400000000 AS tod FROM ev),
e2 AS (SELECT event_id, us, 'M' || m AS machine_id, v, tod - 18000000000 - (b % 7) * 600000000 BETWEEN 0 AND 50400000000 AS cut, b % 8 = 3 AS worn,
  (CASE b % 5 WHEN 0 THEN 4.0 WHEN 1 THEN 5.5 WHEN 2 THEN 8.0 WHEN 3 THEN 10.5 ELSE 14.0 END)::DOUBLE AS base FROM e1),
p0 AS (SELECT event_id, us, CASE WHEN event_id % 2500 = 12 THEN NULL ELSE machine_id END AS machine_id,
  (CASE WHEN event_id % 1250 = 0 THEN 9999 WHEN event_id % 1666 = 2 THEN -3 WHEN event_id % 998 = 10 THEN NULL
  WHEN cut THEN 0.3::DOUBLE + base * (1 + (v - 50) / 1000) ELSE 0.3::DOUBLE + v / 10000 END)::DOUBLE AS power_kw FROM e2 WHERE event_id % 2 = 0),
power_raw AS (SELECT us, machine_id, power_kw FROM p0 UNION ALL SELECT us, machine_id, power_kw FROM p0 WHERE event_id % 1000 = 4),
v0 AS (SELECT *, (CASE WHEN event_id % 900 = 31 THEN NULL WHEN event_id % 1100 = 51 THEN -0.1 WHEN event_id % 1300 = 71 THEN 9999
  WHEN cut THEN 0.04::DOUBLE * base * (1 + (v - 50) / 800) * (CASE WHEN worn THEN 1.7 ELSE 1.0 END)::DOUBLE ELSE 0.01::DOUBLE + v / 100000 END)::DOUBLE AS rms
  FROM e2 WHERE event_id % 2 = 1),
v1 AS (SELECT event_id, us, machine_id, rms AS vibration_rms_g, CASE WHEN event_id % 1700 = 91 THEN 9999::DOUBLE WHEN event_id % 700 = 21 THEN rms * 0.5::DOUBLE
  ELSE rms * (CASE WHEN cut AND worn THEN 4.8 ELSE 3.0 END)::DOUBLE * (1 + (event_id % 11) / 200.0::DOUBLE) END AS vibration_peak_g FROM v0),
vib_raw AS (SELECT us, machine_id, vibration_rms_g, vibration_peak_g FROM v1 UNION ALL SELECT us, machine_id, vibration_rms_g, vibration_peak_g FROM v1 WHERE event_id % 1000 = 5),
g0 AS (SELECT o_orderkey // 160 AS b, min(o_custkey) AS c FROM orders GROUP BY 1),
g1 AS (SELECT *, 1704067200000000 + (b % 31) * 86400000000 + (b % 7) * 600000000 AS a FROM g0),
g2 AS (SELECT *, CASE WHEN b % 41 = 9 THEN a WHEN b % 17 = 6 THEN a + 93600000000 ELSE a + 50400000000 END AS z FROM g1),
g3 AS (SELECT * FROM g2 UNION ALL SELECT b, c, a, z + 3600000000 FROM g2 WHERE b % 25 = 4),
log_raw AS (SELECT 'J' || b AS job_id, 'M' || (b // 31) AS machine_id, 'P' || (b % 5) AS part_type, 'op' || (c % 5) AS operator,
  CASE WHEN b % 29 = 7 THEN NULL ELSE (1 + c % 20)::DOUBLE END AS quantity,
  CASE WHEN b % 37 = 5 THEN NULL WHEN b % 30 = 11 THEN z ELSE a END AS start_us, CASE WHEN b % 30 = 11 THEN a ELSE z END AS end_us FROM g3),
pd AS (SELECT *, row_number() OVER (PARTITION BY machine_id, us ORDER BY power_kw) AS n FROM power_raw WHERE us IS NOT NULL AND machine_id IS NOT NULL AND power_kw IS NOT NULL),
pn AS (SELECT us, machine_id, power_kw FROM pd WHERE n = 1 AND power_kw >= 0),
pf AS (SELECT q[2] + 50 * greatest(q[2] - q[1], 1e-9) AS bound FROM (SELECT quantile_cont(power_kw, [0.25, 0.75]) AS q FROM pn)),
power_c AS (SELECT us, machine_id, power_kw FROM pn WHERE power_kw <= least(500, (SELECT bound FROM pf))),
vd AS (SELECT *, row_number() OVER (PARTITION BY machine_id, us ORDER BY vibration_rms_g, vibration_peak_g) AS n FROM vib_raw
  WHERE us IS NOT NULL AND machine_id IS NOT NULL AND vibration_rms_g IS NOT NULL AND vibration_peak_g IS NOT NULL),
vn AS (SELECT us, machine_id, vibration_rms_g, vibration_peak_g FROM vd WHERE n = 1 AND vibration_rms_g >= 0 AND vibration_peak_g >= vibration_rms_g),
vf AS (SELECT q[2] + 50 * greatest(q[2] - q[1], 1e-9) AS bound FROM (SELECT quantile_cont(vibration_rms_g, [0.25, 0.75]) AS q FROM vn)),
vr AS (SELECT * FROM vn WHERE vibration_rms_g <= (SELECT bound FROM vf)),
vg AS (SELECT q[2] + 50 * greatest(q[2] - q[1], 1e-9) AS bound FROM (SELECT quantile_cont(vibration_peak_g, [0.25, 0.75]) AS q FROM vr)),
vib_c AS (SELECT * FROM vr WHERE vibration_peak_g <= (SELECT bound FROM vg)),
l1 AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY start_us, end_us, machine_id) AS n FROM log_raw WHERE start_us IS NOT NULL AND end_us IS NOT NULL),
l2 AS (SELECT * EXCLUDE (n) REPLACE (least(start_us, end_us) AS start_us, greatest(start_us, end_us) AS end_us), end_us < start_us AS was_reversed FROM l1 WHERE n = 1),
lr AS (SELECT *, (end_us - start_us) / 1e6 AS duration_s FROM l2 WHERE end_us - start_us >= 1000000),
jobs_c AS (SELECT lr.* REPLACE (coalesce(quantity, m, (SELECT median(quantity) FROM lr)) AS quantity), quantity IS NULL AS quantity_imputed,
  concat_ws('; ', CASE WHEN was_reversed THEN 'start and end swapped in the log; exchanged' END, CASE WHEN quantity IS NULL THEN 'quantity missing in the log; median of the part type used' END) AS data_quality_notes
  FROM lr LEFT JOIN (SELECT part_type AS pt, median(quantity) AS m FROM lr GROUP BY 1) ON part_type = pt),
spans AS (SELECT machine_id, job_id, start_us + 18000000000 AS f, end_us + 18000000000 AS t,
  lead(start_us + 18000000000) OVER (PARTITION BY machine_id ORDER BY start_us, job_id) AS nx FROM jobs_c),
power_l AS (SELECT p.*, s.job_id FROM power_c p LEFT JOIN spans s ON p.machine_id = s.machine_id AND us >= f AND us <= t AND (nx IS NULL OR us < nx)),
vib_l AS (SELECT p.*, s.job_id FROM vib_c p LEFT JOIN spans s ON p.machine_id = s.machine_id AND us >= f AND us <= t AND (nx IS NULL OR us < nx)),
wb AS (SELECT machine_id, start_us AS a, end_us AS b, CASE WHEN start_us <= max(end_us) OVER (PARTITION BY machine_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM jobs_c),
wi AS (SELECT *, sum(o) OVER (PARTITION BY machine_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM wb),
wins AS (SELECT machine_id, min(a) AS a, max(b) AS b FROM wi GROUP BY machine_id, i),
bk AS (SELECT v.machine_id, v.us, v.vibration_rms_g, v.vibration_peak_g, v.job_id, p.us AS bu, p.power_kw AS bp FROM vib_l v ASOF LEFT JOIN power_c p ON v.machine_id = p.machine_id AND v.us >= p.us),
fw AS (SELECT v.*, p.us AS fu, p.power_kw AS fp FROM bk v ASOF LEFT JOIN power_c p ON v.machine_id = p.machine_id AND v.us <= p.us),
gp AS (SELECT *, CASE WHEN us - bu <= 1800000000 THEN us - bu END AS gb, CASE WHEN fu - us <= 1800000000 THEN fu - us END AS gf FROM fw),
paired AS (SELECT machine_id, us, vibration_rms_g, vibration_peak_g, job_id,
  CASE WHEN gb IS NOT NULL AND (gf IS NULL OR gb <= gf) THEN bp WHEN gf IS NOT NULL THEN fp END AS power_kw,
  CASE WHEN gb IS NOT NULL AND (gf IS NULL OR gb <= gf) THEN gb ELSE gf END AS gap_us FROM gp),
idle AS (SELECT machine_id, coalesce(min(power_kw) FILTER (job_id IS NULL), (SELECT min(power_kw) FROM power_l WHERE job_id IS NULL), 0.0) AS idle_baseline_kw,
  avg((job_id IS NULL)::INT) AS idle_share FROM power_l GROUP BY machine_id),
f0 AS (SELECT p.*, j.part_type, j.quantity, greatest(p.power_kw - i.idle_baseline_kw, 0) AS net_power_kw
  FROM paired p JOIN jobs_c j USING (job_id) JOIN idle i ON i.machine_id = p.machine_id WHERE p.power_kw IS NOT NULL),
feats AS (SELECT *, vibration_rms_g / greatest(net_power_kw, 0.05) AS vib_per_kw, vibration_peak_g / greatest(vibration_rms_g, 1e-6) AS peak_to_rms,
  ln(greatest(net_power_kw, 0.05)) AS log_net_power_kw, ln(greatest(vibration_rms_g, 1e-4)) AS log_vibration_rms_g,
  ln(greatest(vibration_rms_g, 1e-4)) - ln(greatest(net_power_kw, 0.05)) AS log_vib_per_kw FROM f0),
cut AS (SELECT * FROM feats WHERE net_power_kw >= 0.5),
jp AS (SELECT job_id, avg(power_kw) AS mean_power_raw_kw, median(power_kw) AS median_power_raw_kw, max(power_kw) AS max_power_raw_kw, count(*) AS power_readings FROM power_l WHERE job_id IS NOT NULL GROUP BY 1),
jv AS (SELECT job_id, max(vibration_peak_g) AS peak_vibration_g, avg(vibration_rms_g) AS mean_vibration_rms_g, quantile_cont(vibration_rms_g, 0.95) AS p95_vibration_rms_g,
  max(vibration_rms_g) AS max_vibration_rms_g, count(*) AS vibration_readings FROM vib_l WHERE job_id IS NOT NULL GROUP BY 1),
metrics AS (SELECT j.*, jp.* EXCLUDE (job_id, power_readings), jv.* EXCLUDE (job_id, vibration_readings), coalesce(power_readings, 0) AS power_readings, coalesce(vibration_readings, 0) AS vibration_readings,
  idle_baseline_kw, mean_power_raw_kw - idle_baseline_kw AS mean_power_kw FROM jobs_c j LEFT JOIN jp USING (job_id) LEFT JOIN jv USING (job_id) LEFT JOIN idle USING (machine_id)),
ratios AS (SELECT job_id, machine_id, part_type, count(*) AS n, median(vib_per_kw) AS ratio, median(peak_to_rms) AS crest, avg(net_power_kw) AS mean_power, max(vibration_peak_g) AS peak_vib FROM cut GROUP BY 1, 2, 3),
b0 AS (SELECT part_type, median(ratio) AS baseline FROM ratios GROUP BY 1)"""

#: The ten rounds of the reference split, one after the other.
ROUNDS = "".join(
    f""",
b{i + 1} AS (SELECT b.part_type, coalesce(n.m, b.baseline) AS baseline FROM b{i} b LEFT JOIN (SELECT part_type, median(ratio) AS m FROM ratios r JOIN b{i} USING (part_type) WHERE ratio / baseline < 1.10 GROUP BY 1) n ON n.part_type = b.part_type)"""
    for i in range(10)
)
SPLIT = (
    ROUNDS
    + """,
split AS (SELECT r.*, baseline, ratio / baseline AS rel, ratio / baseline >= 1.10 AS reference_worn FROM ratios r JOIN b10 USING (part_type))"""
)


def offsets(first: str, last: str, step: int) -> str:
    """Lifts by machine and offset, by a plain range join."""
    return f""",
offs AS (SELECT unnest(range({first}, {last}, {step}))::INT AS offset_s),
io AS (SELECT o.offset_s, p.machine_id, p.power_kw, EXISTS (SELECT 1 FROM wins w WHERE w.machine_id = p.machine_id AND p.us >= w.a + o.offset_s * 1000000::BIGINT AND p.us <= w.b + o.offset_s * 1000000::BIGINT) AS inside FROM power_c p, offs o),
lifts AS (SELECT machine_id, offset_s, avg(power_kw) FILTER (inside) - avg(power_kw) FILTER (NOT inside) AS lift FROM io GROUP BY 1, 2 HAVING bool_or(inside) AND NOT bool_and(inside)),
scores AS (SELECT offset_s, coalesce(avg(lift), '-inf'::DOUBLE) AS score FROM offs LEFT JOIN lifts USING (offset_s) GROUP BY 1)"""


COARSE = offsets("-50400", "50401", 3600)


def r(*columns: str) -> str:
    """Columns in single precision, as in the Spark queries. Raw readings and their extremes stay as they are."""
    return ", ".join(f"({c})::FLOAT::DOUBLE AS {c}" for c in columns)


def scale_rounds(rounds: int = 20) -> str:
    """Trimmed MAD of x with its rounds written out; a round that keeps too little or changes nothing ends the rest."""
    out = """,
xs AS (SELECT log_vib_per_kw - median(log_vib_per_kw) OVER (PARTITION BY part_type) AS x FROM cut),
s0 AS (SELECT c, greatest(1.4826 * (SELECT median(abs(x - c)) FROM xs), 1e-9) AS s, false AS done FROM (SELECT median(x) AS c FROM xs))"""
    for i in range(rounds):
        out += f""",
k{i} AS (SELECT count(*) AS n, median(x) AS c FROM xs, s{i} WHERE abs(x - s{i}.c) <= 3.0 * s{i}.s),
n{i} AS (SELECT greatest(1.4826 * median(abs(x - k{i}.c)), 1e-9) AS s FROM xs, s{i}, k{i} WHERE abs(x - s{i}.c) <= 3.0 * s{i}.s),
s{i + 1} AS (SELECT CASE WHEN done OR k{i}.n < greatest(30, 0.2 * (SELECT count(*) FROM xs)) THEN s{i}.c ELSE k{i}.c END AS c,
  CASE WHEN done OR k{i}.n < greatest(30, 0.2 * (SELECT count(*) FROM xs)) THEN s{i}.s ELSE n{i}.s END AS s,
  done OR k{i}.n < greatest(30, 0.2 * (SELECT count(*) FROM xs)) OR abs(n{i}.s - s{i}.s) <= 1e-12 * greatest(s{i}.s, 1.0) AS done FROM s{i}, k{i}, n{i})"""
    return out


def moments() -> str:
    x, q, y = "log_net_power_kw", "quantity", "log_vibration_rms_g"
    sums = {"n": "1.0::DOUBLE", "sx": x, "sq": q, "sxx": f"{x}*{x}", "sxq": f"{x}*{q}", "sqq": f"{q}*{q}", "sy": y, "sxy": f"{x}*{y}", "sqy": f"{q}*{y}", "syy": f"{y}*{y}"}
    return "SELECT machine_id, part_type, " + ", ".join(f"(sum({e}))::FLOAT::DOUBLE AS {k}" for k, e in sums.items()) + " FROM cut GROUP BY 1, 2"


#: A score that SQL can compute: log vibration per kW against its part's median, in MADs of all.
SIMPLE = """,
z0 AS (SELECT *, log_vib_per_kw - median(log_vib_per_kw) OVER (PARTITION BY part_type) AS residual_g FROM cut),
z1 AS (SELECT *, residual_g / (SELECT 1.4826 * median(abs(residual_g)) FROM z0) AS primary_score FROM z0),
zs AS (SELECT *, primary_score >= 6 AS primary_anomalous, peak_to_rms >= 4 AS secondary_anomalous, primary_score >= 6 AND peak_to_rms >= 4 AS anomalous FROM z1),
fl AS (SELECT job_id, count(*) AS cutting_readings, quantile_cont(primary_score, 0.95) AS wear_score, max(primary_score) AS max_primary_sigma, avg(primary_score) AS mean_primary_sigma,
  count(*) FILTER (primary_anomalous) AS n_primary_anomalous, count(*) FILTER (secondary_anomalous) AS n_secondary_anomalous, count(*) FILTER (anomalous) AS n_anomalous, avg(residual_g) AS mean_residual_g, avg(vib_per_kw) AS mean_vib_per_kw FROM zs GROUP BY 1),
jd AS (SELECT m.job_id, m.machine_id, m.start_us, mean_residual_g, mean_vib_per_kw, coalesce(cutting_readings, 0) AS cutting_readings, wear_score, coalesce(n_anomalous, 0) AS n_anomalous, coalesce(n_primary_anomalous, 0) AS n_primary_anomalous,
  coalesce(n_anomalous / greatest(cutting_readings, 1), 0) AS anomalous_fraction, coalesce(cutting_readings, 0) >= 20 AS assessable FROM metrics m LEFT JOIN fl USING (job_id)),
judged AS (SELECT *, assessable AND n_anomalous >= 5 AND anomalous_fraction >= 0.05 AS flagged,
  row_number() OVER (ORDER BY CASE WHEN assessable THEN wear_score END DESC NULLS LAST, machine_id, start_us, job_id) AS rank FROM jd)"""

#: The loaded detector of plain numbers: scores, roll-up, verdicts and notes.
STORED = f""",
st0 AS (SELECT *, {stored.prediction_sql()} AS predicted_rms_g, {stored.distance_sql()} AS secondary_score FROM cut),
st1 AS (SELECT *, log_vibration_rms_g - predicted_rms_g AS residual_g, (log_vibration_rms_g - predicted_rms_g - {stored.CENTRE}::DOUBLE) / {stored.SCALE}::DOUBLE AS primary_score FROM st0),
st AS (SELECT *, primary_score >= {stored.SIGMAS} AS primary_anomalous, secondary_score >= {stored.THRESHOLD} AS secondary_anomalous, primary_score >= {stored.SIGMAS} AND secondary_score >= {stored.THRESHOLD} AS anomalous FROM st1),
sf AS (SELECT job_id, count(*) AS cutting_readings, quantile_cont(primary_score, 0.95) AS wear_score, max(primary_score) AS max_primary_sigma, avg(primary_score) AS mean_primary_sigma, median(primary_score) AS median_primary_sigma,
  count(*) FILTER (primary_anomalous) AS n_primary_anomalous, count(*) FILTER (secondary_anomalous) AS n_secondary_anomalous, count(*) FILTER (anomalous) AS n_anomalous, avg(residual_g) AS mean_residual_g, avg(vib_per_kw) AS mean_vib_per_kw FROM st GROUP BY 1),
sj0 AS (SELECT m.*, wear_score, max_primary_sigma, mean_primary_sigma, median_primary_sigma, mean_residual_g, mean_vib_per_kw, coalesce(cutting_readings, 0) AS cutting_readings, coalesce(n_primary_anomalous, 0) AS n_primary_anomalous,
  coalesce(n_secondary_anomalous, 0) AS n_secondary_anomalous, coalesce(n_anomalous, 0) AS n_anomalous, coalesce(n_anomalous / greatest(cutting_readings, 1), 0)::DOUBLE AS anomalous_fraction, coalesce(cutting_readings, 0) >= 20 AS assessable
  FROM metrics m LEFT JOIN sf USING (job_id)),
sj1 AS (SELECT *, assessable AND n_anomalous >= 5 AND anomalous_fraction >= 0.05 AS is_flagged,
  row_number() OVER (ORDER BY CASE WHEN assessable THEN wear_score END DESC NULLS LAST, machine_id, start_us, job_id)::INT AS rank FROM sj0),
sj AS (SELECT *, is_flagged::VARCHAR AS flagged, concat_ws('; ', CASE WHEN data_quality_notes <> '' THEN data_quality_notes END, CASE WHEN NOT assessable THEN 'no verdict with ' || cutting_readings || ' cutting readings' END,
  CASE WHEN power_readings = 0 THEN 'no power readings in the job' END, CASE WHEN vibration_readings = 0 THEN 'no vibration readings in the job' END,
  CASE WHEN is_flagged THEN n_anomalous || ' of ' || cutting_readings || ' cutting readings (' || printf('%.1f', round(anomalous_fraction * 100, 1)) || '%) are above the 6-sigma baseline and by the second detector' END,
  CASE WHEN NOT is_flagged AND assessable AND n_primary_anomalous > 0 AND n_anomalous = 0 THEN 'first detector only; not flagged' END) AS notes FROM sj1)"""

PCT = ", ".join(f"(q[{i + 1}])::FLOAT::DOUBLE AS {n}" for i, n in enumerate(("p01", "p05", "p25", "p50", "p75", "p95", "p99")))
STATS = "count({c}) AS n, (avg({c}))::FLOAT::DOUBLE AS mean, (stddev({c}))::FLOAT::DOUBLE AS std, (min({c}))::FLOAT::DOUBLE AS low, (max({c}))::FLOAT::DOUBLE AS high, quantile_cont({c}, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS q"


def _profile() -> str:
    tables = {
        "power": ("power_raw", ["ts:us:timestamp", "machine_id::string", "power_kw::double"]),
        "vibration": ("vib_raw", ["ts:us:timestamp", "machine_id::string", "vibration_rms_g::double", "vibration_peak_g::double"]),
        "production_log": ("log_raw", ["job_id::string", "machine_id::string", "part_type::string", "operator::string", "quantity::double", "start_time:start_us:timestamp", "end_time:end_us:timestamp"]),
    }
    parts = []
    for source, (table, columns) in tables.items():
        for name, own, kind in (c.split(":") for c in columns):
            own = own or name
            parts.append(f"SELECT '{source}' AS source, '{name}' AS \"column\", '{kind}' AS type, count(*) AS rows, count(*) FILTER ({own} IS NULL) AS nulls, (count(*) FILTER ({own} IS NULL) / count(*))::FLOAT::DOUBLE AS null_share, count(DISTINCT {own}) AS distinct_values FROM {table}")
    return " UNION ALL ".join(parts)


BODIES = {
    "clean_power": ("", f"SELECT us, machine_id, power_kw FROM power_c"),
    "clean_vibration": ("", f"SELECT us, machine_id, vibration_rms_g, vibration_peak_g FROM vib_c"),
    "clean_jobs": ("", "SELECT job_id, machine_id, part_type, operator, quantity, start_us, end_us, duration_s, was_reversed, quantity_imputed, data_quality_notes FROM jobs_c"),
    "upper_fence": ("", "SELECT (bound)::FLOAT::DOUBLE AS bound FROM pf"),
    "cleaning_report": (
        "",
        """SELECT 'power' AS source, CASE WHEN n > 1 THEN 'duplicate' WHEN power_kw < 0 THEN 'negative' WHEN power_kw > least(500, (SELECT bound FROM pf)) THEN 'sentinel' ELSE 'kept' END AS rule, count(*) AS rows FROM pd GROUP BY 2
UNION ALL SELECT 'power', 'null', count(*) FROM power_raw WHERE us IS NULL OR machine_id IS NULL OR power_kw IS NULL
UNION ALL SELECT 'vibration', CASE WHEN n > 1 THEN 'duplicate' WHEN vibration_rms_g < 0 OR vibration_peak_g < 0 THEN 'negative' WHEN vibration_peak_g < vibration_rms_g THEN 'peak_below_rms'
  WHEN vibration_rms_g > (SELECT bound FROM vf) THEN 'rms_sentinel' WHEN vibration_peak_g > (SELECT bound FROM vg) THEN 'peak_sentinel' ELSE 'kept' END, count(*) FROM vd GROUP BY 2
UNION ALL SELECT 'vibration', 'null', count(*) FROM vib_raw WHERE us IS NULL OR machine_id IS NULL OR vibration_rms_g IS NULL OR vibration_peak_g IS NULL
UNION ALL SELECT 'production_log', 'kept', count(*) FROM jobs_c UNION ALL SELECT 'production_log', 'unparsed_time', count(*) FROM log_raw WHERE start_us IS NULL OR end_us IS NULL
UNION ALL SELECT 'production_log', 'duplicate', count(*) FROM l1 WHERE n > 1 UNION ALL SELECT 'production_log', 'too_short', count(*) FROM l2 WHERE end_us - start_us < 1000000""",
    ),
    "cleaning_details": (
        "",
        """SELECT d.*, f.sentinel_value, f.machine_id, f.n FROM (SELECT 'power' AS source, 'power_kw' AS "column", (SELECT least(500, bound) FROM pf)::FLOAT::DOUBLE AS bound, (SELECT count(*) FROM pn WHERE power_kw > least(500, (SELECT bound FROM pf))) AS sentinels
UNION ALL SELECT 'vibration', 'vibration_rms_g', (SELECT bound FROM vf)::FLOAT::DOUBLE, (SELECT count(*) FROM vn WHERE vibration_rms_g > (SELECT bound FROM vf))
UNION ALL SELECT 'vibration', 'vibration_peak_g', (SELECT bound FROM vg)::FLOAT::DOUBLE, (SELECT count(*) FROM vr WHERE vibration_peak_g > (SELECT bound FROM vg))) d JOIN (
SELECT 'power_kw' AS "column", NULL::DOUBLE AS sentinel_value, NULL::VARCHAR AS machine_id, count(*) AS n FROM pn WHERE power_kw > least(500, (SELECT bound FROM pf))
UNION ALL SELECT 'vibration_rms_g', NULL, NULL, count(*) FROM vn WHERE vibration_rms_g > (SELECT bound FROM vf)
UNION ALL SELECT 'vibration_peak_g', NULL, NULL, count(*) FROM vr WHERE vibration_peak_g > (SELECT bound FROM vg)
UNION ALL SELECT 'power_kw', power_kw, NULL, count(*) FROM pn WHERE power_kw > least(500, (SELECT bound FROM pf)) GROUP BY 2
UNION ALL SELECT 'vibration_rms_g', vibration_rms_g, NULL, count(*) FROM vn WHERE vibration_rms_g > (SELECT bound FROM vf) GROUP BY 2
UNION ALL SELECT 'vibration_peak_g', vibration_peak_g, NULL, count(*) FROM vr WHERE vibration_peak_g > (SELECT bound FROM vg) GROUP BY 2
UNION ALL SELECT 'power_kw', NULL, machine_id, count(*) FROM power_c GROUP BY 3
UNION ALL SELECT c, NULL, machine_id, count(*) FROM vib_c, (SELECT unnest(['vibration_rms_g', 'vibration_peak_g']) AS c) GROUP BY 1, 3) f USING ("column")""",
    ),
    "sentinel_values": (
        "",
        """SELECT 'power' AS source, 'power_kw' AS "column", power_kw AS value, count(*) AS n FROM pn WHERE power_kw > least(500, (SELECT bound FROM pf)) GROUP BY 3
UNION ALL SELECT 'vibration', 'vibration_rms_g', vibration_rms_g, count(*) FROM vn WHERE vibration_rms_g > (SELECT bound FROM vf) GROUP BY 3
UNION ALL SELECT 'vibration', 'vibration_peak_g', vibration_peak_g, count(*) FROM vr WHERE vibration_peak_g > (SELECT bound FROM vg) GROUP BY 3""",
    ),
    "machines_left": ("", "SELECT DISTINCT 'power' AS source, machine_id FROM power_c UNION ALL SELECT DISTINCT 'vibration', machine_id FROM vib_c"),
    "reread_power": ("", "SELECT us, machine_id, power_kw FROM power_c"),
    "reread_vibration": ("", "SELECT us, machine_id, vibration_rms_g, vibration_peak_g FROM vib_c"),
    "reread_jobs": ("", "SELECT job_id, machine_id, part_type, operator, quantity, start_us, end_us, duration_s, was_reversed, quantity_imputed, data_quality_notes FROM jobs_c"),
    "overlapping_jobs": ("", "SELECT machine_id, pid || '->' || job_id AS pair FROM (SELECT *, lag(end_us) OVER w AS pe, lag(job_id) OVER w AS pid FROM jobs_c WINDOW w AS (PARTITION BY machine_id ORDER BY start_us, job_id)) WHERE start_us < pe"),
    "sampling_gaps": (
        "",
        """SELECT 'power' AS source, (median(g))::FLOAT::DOUBLE AS median_s, count(*) FILTER (g > 5) AS gaps, (max(g))::FLOAT::DOUBLE AS longest_gap_s FROM (SELECT (us - lag(us) OVER (PARTITION BY machine_id ORDER BY us)) / 1e6 AS g FROM power_c)
UNION ALL SELECT 'vibration', (median(g))::FLOAT::DOUBLE, count(*) FILTER (g > 5), (max(g))::FLOAT::DOUBLE FROM (SELECT (us - lag(us) OVER (PARTITION BY machine_id ORDER BY us)) / 1e6 AS g FROM vib_c)""",
    ),
    "dropouts": ("", "SELECT machine_id, us AS at_us, (g)::FLOAT::DOUBLE AS gap_s FROM (SELECT machine_id, us, (us - lag(us) OVER (PARTITION BY machine_id ORDER BY us)) / 1e6 AS g FROM vib_c) WHERE g > 5"),
    "offset_scores": (COARSE, "SELECT offset_s, (score)::FLOAT::DOUBLE AS score FROM scores"),
    "best_offset": (COARSE, "SELECT offset_s, (score)::FLOAT::DOUBLE AS score FROM scores ORDER BY scores.score DESC, offset_s LIMIT 1"),
    "fine_offset_scores": (offsets("18000 - 3600", "18000 + 3601", 60), "SELECT offset_s, (score)::FLOAT::DOUBLE AS score FROM scores"),
    "offset_by_machine": (COARSE, "SELECT machine_id, offset_s, (lift)::FLOAT::DOUBLE AS lift, (SELECT count(DISTINCT o) <= 1 FROM (SELECT arg_max(offset_s, lift) AS o FROM lifts GROUP BY machine_id)) AS all_agree FROM (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY lift DESC, offset_s) AS n FROM lifts) WHERE n = 1"),
    "alignment_report": (COARSE, "SELECT (SELECT offset_s FROM scores ORDER BY score DESC, offset_s LIMIT 1) AS best_offset_s, (max(score))::FLOAT::DOUBLE AS lift_at_best, (max(score) FILTER (offset_s = 0))::FLOAT::DOUBLE AS lift_at_zero FROM scores"),
    "labelled_power": ("", f"SELECT us, machine_id, power_kw, job_id FROM power_l"),
    "labelled_vibration": ("", f"SELECT us, machine_id, vibration_rms_g, vibration_peak_g, job_id FROM vib_l"),
    "in_any_window": ("", "SELECT p.us, p.machine_id FROM power_c p WHERE EXISTS (SELECT 1 FROM jobs_c j WHERE j.machine_id = p.machine_id AND p.us BETWEEN j.start_us + 18000000000 AND j.end_us + 18000000000)"),
    "in_job_share": ("", "SELECT (avg((job_id IS NOT NULL)::INT))::FLOAT::DOUBLE AS in_job_share, count(DISTINCT job_id) AS jobs_seen FROM vib_l"),
    "paired_readings": ("", f"SELECT machine_id, us, vibration_rms_g, power_kw, gap_us FROM paired"),
    "idle_baseline_min": ("", f"SELECT machine_id, {r('idle_baseline_kw', 'idle_share')} FROM idle"),
    "idle_baseline_pct": ("", "SELECT machine_id, (quantile_cont(power_kw, 0.05) FILTER (job_id IS NULL))::FLOAT::DOUBLE AS idle_baseline_kw, (avg((job_id IS NULL)::INT))::FLOAT::DOUBLE AS idle_share FROM power_l GROUP BY 1"),
    "reading_features": ("", f"SELECT job_id, machine_id, us, part_type, quantity, {r('net_power_kw', 'vib_per_kw', 'peak_to_rms', 'log_net_power_kw', 'log_vibration_rms_g', 'log_vib_per_kw')} FROM feats"),
    "cutting_readings": ("", f"SELECT job_id, machine_id, us, {r('net_power_kw')} FROM cut"),
    "job_power": ("", f"SELECT job_id, {r('mean_power_raw_kw', 'median_power_raw_kw')}, max_power_raw_kw, power_readings FROM jp"),
    "job_vibration": ("", f"SELECT job_id, {r('mean_vibration_rms_g', 'p95_vibration_rms_g')}, peak_vibration_g, max_vibration_rms_g, vibration_readings FROM jv"),
    "job_metrics": ("", f"SELECT job_id, machine_id, part_type, {r('mean_power_kw')}, peak_vibration_g, idle_baseline_kw, power_readings, vibration_readings, round(power_readings / greatest(duration_s, 1e-9), 3) AS power_coverage, round(vibration_readings / (2 * greatest(duration_s, 1e-9)), 3) AS vibration_coverage FROM metrics"),
    "quality_summary": (
        ", qs AS (SELECT count(*) AS jobs, count(*) FILTER (power_readings = 0) AS jobs_without_power, count(*) FILTER (vibration_readings = 0) AS jobs_without_vibration, count(*) FILTER (vibration_readings < 20) AS jobs_below_min_readings FROM metrics)",
        "SELECT *, NULL::VARCHAR AS job_id_without_sensor_data FROM qs UNION ALL SELECT qs.*, job_id FROM qs, metrics WHERE power_readings = 0 OR vibration_readings = 0",
    ),
    "silent_jobs": ("", "SELECT job_id, machine_id, power_readings, vibration_readings FROM metrics WHERE power_readings = 0 OR vibration_readings = 0"),
    "profile_tables": ("", _profile()),
    "duplicate_rows": ("", "SELECT 'power' AS source, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM power_raw)))::BIGINT AS duplicate_rows FROM power_raw UNION ALL SELECT 'vibration', (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM vib_raw)))::BIGINT FROM vib_raw"),
    "value_counts": ("", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM log_raw GROUP BY {c}" for c in ("machine_id", "part_type", "operator"))),
    "numeric_summary": ("", f"SELECT machine_id, n, mean, std, low, high, {PCT} FROM (SELECT machine_id, {STATS.format(c='power_kw')} FROM power_c GROUP BY 1)"),
    "numeric_summary_whole": ("", f"SELECT n, mean, std, low, high, {PCT} FROM (SELECT {STATS.format(c='power_kw')} FROM power_c)"),
    "defect_counts": (
        "",
        """SELECT 'power duplicates' AS defect, (SELECT sum(c - 1) FROM (SELECT count(*) AS c FROM power_raw GROUP BY machine_id, us))::BIGINT AS n UNION ALL SELECT 'vibration duplicates', (SELECT sum(c - 1) FROM (SELECT count(*) AS c FROM vib_raw GROUP BY machine_id, us))::BIGINT
UNION ALL SELECT 'negative power', count(*) FROM power_raw WHERE power_kw < 0 UNION ALL SELECT 'implausible power', count(*) FROM power_raw WHERE power_kw > 100
UNION ALL SELECT 'negative vibration', count(*) FROM vib_raw WHERE vibration_rms_g < 0 OR vibration_peak_g < 0 UNION ALL SELECT 'peak below rms', count(*) FROM vib_raw WHERE vibration_peak_g < vibration_rms_g
UNION ALL SELECT 'reversed jobs', count(*) FROM log_raw WHERE end_us < start_us UNION ALL SELECT 'missing quantity', count(*) FROM log_raw WHERE quantity IS NULL
UNION ALL SELECT 'duplicate job ids', (SELECT sum(c - 1) FROM (SELECT count(*) AS c FROM log_raw GROUP BY job_id))::BIGINT""",
    ),
    "defect_values": (
        "",
        "SELECT CASE WHEN power_kw < 0 THEN 'negative power' ELSE 'implausible power' END AS defect, power_kw AS value, count(*) AS n FROM power_raw WHERE power_kw < 0 OR power_kw > 100 GROUP BY 1, 2"
        " UNION ALL SELECT '99.9th percentile of the rest', quantile_cont(power_kw, 0.999), count(*) FROM power_raw WHERE power_kw BETWEEN 0 AND 100",
    ),
    "plausible_top": ("", "SELECT quantile_cont(power_kw, 0.999) AS p999_power_kw FROM power_raw WHERE power_kw BETWEEN 0 AND 100"),
    "time_coverage": ("", "SELECT 'power' AS source, min(us) AS first_us, max(us) AS last_us, count(*) AS rows FROM power_raw UNION ALL SELECT 'vibration', min(us), max(us), count(*) FROM vib_raw UNION ALL SELECT 'production_log', min(start_us), max(end_us), count(*) FROM log_raw"),
    "machine_sets": ("", "SELECT machine_id, count(DISTINCT s) AS in_sources, count(DISTINCT s) = 3 AS in_all FROM (SELECT machine_id, 'p' AS s FROM power_raw UNION ALL SELECT machine_id, 'v' FROM vib_raw UNION ALL SELECT machine_id, 'l' FROM log_raw) GROUP BY 1"),
    "power_vib_corr": ("", "SELECT part_type, count(*) AS n, (corr(net_power_kw, vibration_rms_g))::FLOAT::DOUBLE AS correlation, (quantile_cont(net_power_kw, 0.05))::FLOAT::DOUBLE AS p05_kw, (quantile_cont(net_power_kw, 0.95))::FLOAT::DOUBLE AS p95_kw FROM cut GROUP BY GROUPING SETS ((part_type), ())"),
    "sextile_spread": (
        ", ed AS (SELECT list_sort(list_distinct(quantile_cont(net_power_kw, [0, 1/6, 2/6, 3/6, 4/6, 5/6, 1])))[2:-2] AS e FROM cut)",
        "SELECT bucket::INT AS bucket, count(*) AS n, (median(net_power_kw))::FLOAT::DOUBLE AS power_kw, (stddev(vibration_rms_g))::FLOAT::DOUBLE AS sd_rms, (stddev(log_vibration_rms_g))::FLOAT::DOUBLE AS sd_log_rms FROM (SELECT *, len(list_filter((SELECT e FROM ed), lambda x: net_power_kw > x)) AS bucket FROM cut) GROUP BY 1",
    ),
    "sextile_ratios": (
        ", ed AS (SELECT list_sort(list_distinct(quantile_cont(net_power_kw, [0, 1/6, 2/6, 3/6, 4/6, 5/6, 1])))[2:-2] AS e FROM cut)",
        "SELECT (max(a) / min(a))::FLOAT::DOUBLE AS rms_ratio, (max(b) / min(b))::FLOAT::DOUBLE AS log_ratio FROM (SELECT len(list_filter((SELECT e FROM ed), lambda x: net_power_kw > x)) AS bucket, stddev(vibration_rms_g) AS a, stddev(log_vibration_rms_g) AS b FROM cut GROUP BY 1)",
    ),
    "part_pivot": ("", "SELECT machine_id, part_type, (median(vib_per_kw))::FLOAT::DOUBLE AS median_ratio FROM cut GROUP BY 1, 2"),
    "job_ratios": ("", f"SELECT job_id, machine_id, part_type, n, {r('ratio', 'crest', 'mean_power')}, peak_vib FROM ratios"),
    "robust_part_baseline": (SPLIT, f"SELECT job_id, part_type, {r('baseline', 'rel')}, reference_worn FROM split"),
    "reference_split": (
        SPLIT,
        """SELECT count(*) FILTER (NOT reference_worn) AS healthy, count(*) FILTER (reference_worn) AS elevated, (min(rel) FILTER (NOT reference_worn))::FLOAT::DOUBLE AS healthy_low, (max(rel) FILTER (NOT reference_worn))::FLOAT::DOUBLE AS healthy_high, (stddev(rel) FILTER (NOT reference_worn))::FLOAT::DOUBLE AS healthy_std, (min(crest) FILTER (NOT reference_worn))::FLOAT::DOUBLE AS healthy_crest_low, (max(crest) FILTER (NOT reference_worn))::FLOAT::DOUBLE AS healthy_crest_high, (stddev(crest) FILTER (NOT reference_worn))::FLOAT::DOUBLE AS healthy_crest_std, (min(rel) FILTER (reference_worn))::FLOAT::DOUBLE AS elevated_low, (max(rel) FILTER (reference_worn))::FLOAT::DOUBLE AS elevated_high, (stddev(rel) FILTER (reference_worn))::FLOAT::DOUBLE AS elevated_std, (min(crest) FILTER (reference_worn))::FLOAT::DOUBLE AS elevated_crest_low, (max(crest) FILTER (reference_worn))::FLOAT::DOUBLE AS elevated_crest_high, (stddev(crest) FILTER (reference_worn))::FLOAT::DOUBLE AS elevated_crest_std,
(min(rel) FILTER (reference_worn) - max(rel) FILTER (NOT reference_worn))::FLOAT::DOUBLE AS gap, min(crest) FILTER (reference_worn) > max(crest) FILTER (NOT reference_worn) AS crest_apart FROM split""",
    ),
    "elevated_jobs": (SPLIT, "SELECT job_id, machine_id, part_type, (rel)::FLOAT::DOUBLE AS rel, (crest)::FLOAT::DOUBLE AS crest, row_number() OVER (ORDER BY rel DESC, machine_id, job_id) AS place FROM split WHERE reference_worn"),
    "elevated_crosstab": (SPLIT, "SELECT machine_id, part_type, count(*) FILTER (reference_worn) AS elevated, count(*) AS total FROM split GROUP BY CUBE (machine_id, part_type)"),
    "job_progress": ("", "SELECT job_id, us, ((row_number() OVER (PARTITION BY job_id ORDER BY us, vibration_rms_g) - 1) / greatest(count(*) OVER (PARTITION BY job_id) - 1, 1))::FLOAT::DOUBLE AS progress FROM cut"),
    "job_sequence": (SPLIT, "SELECT s.machine_id, string_agg(CASE WHEN reference_worn THEN 'S' ELSE '.' END, '' ORDER BY start_us, s.job_id) AS sequence FROM split s JOIN jobs_c j USING (job_id) GROUP BY 1"),
    "healthy_readings": (SPLIT, "SELECT job_id, us FROM cut WHERE job_id IN (SELECT job_id FROM split WHERE NOT reference_worn)"),
    "worn_readings": (SPLIT, "SELECT job_id, us FROM cut WHERE job_id IN (SELECT job_id FROM split WHERE reference_worn)"),
    "cell_moments": ("", moments()),
    "scale_estimators": (
        scale_rounds(),
        "SELECT ((SELECT greatest(stddev_pop(x), 1e-9) FROM xs))::FLOAT::DOUBLE AS std, ((SELECT greatest((quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.349, 1e-9) FROM xs))::FLOAT::DOUBLE AS iqr, ((SELECT s FROM s0))::FLOAT::DOUBLE AS mad, ((SELECT s FROM s20))::FLOAT::DOUBLE AS trimmed_mad",
    ),
    "scale_job_verdicts": (
        SPLIT + scale_rounds() + """,
sc AS (SELECT 'std' AS scale, (SELECT greatest(stddev_pop(x), 1e-9) FROM xs) AS w UNION ALL SELECT 'iqr', (SELECT greatest((quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.349, 1e-9) FROM xs) UNION ALL SELECT 'mad', (SELECT s FROM s0) UNION ALL SELECT 'trimmed_mad', (SELECT s FROM s20)),
xj AS (SELECT job_id, log_vib_per_kw - median(log_vib_per_kw) OVER (PARTITION BY part_type) AS x FROM cut), xc AS (SELECT *, x - (SELECT median(x) FROM xj) AS off FROM xj),
hj AS (SELECT scale, job_id, count(*) AS n, count(*) FILTER (off / w >= 6) AS hits FROM xc, sc GROUP BY 1, 2),
hf AS (SELECT scale, hj.job_id, hj.n >= 20 AND hits >= 5 AND hits / hj.n >= 0.05 AS flagged, reference_worn FROM hj JOIN split USING (job_id))""",
        "SELECT *, (2 * tp / greatest(n_flagged + tp + fn, 1))::FLOAT::DOUBLE AS f1 FROM (SELECT scale, count(*) FILTER (flagged) AS n_flagged, count(*) FILTER (flagged AND reference_worn) AS tp, count(*) FILTER (flagged AND NOT reference_worn) AS fp, count(*) FILTER (NOT flagged AND reference_worn) AS fn FROM hf GROUP BY 1)",
    ),
    "simple_job_verdicts": (SIMPLE, "SELECT job_id, cutting_readings, (wear_score)::FLOAT::DOUBLE AS wear_score, n_anomalous, (anomalous_fraction)::FLOAT::DOUBLE AS anomalous_fraction, assessable, flagged, rank::INT AS rank, (mean_residual_g)::FLOAT::DOUBLE AS mean_residual_g, (mean_vib_per_kw)::FLOAT::DOUBLE AS mean_vib_per_kw FROM judged"),
    "simple_top10": (SIMPLE, "SELECT job_id, (wear_score)::FLOAT::DOUBLE AS wear_score, rank::INT AS rank FROM judged WHERE rank <= 10"),
    "confusion": (SPLIT + SIMPLE, "SELECT *, (2 * tp / greatest(n_flagged + tp + fn, 1))::FLOAT::DOUBLE AS f1 FROM (SELECT count(*) FILTER (flagged) AS n_flagged, count(*) FILTER (flagged AND reference_worn) AS tp, count(*) FILTER (flagged AND NOT reference_worn) AS fp, count(*) FILTER (NOT flagged AND reference_worn) AS fn FROM judged JOIN split USING (job_id))"),
    "decision_margin": (SIMPLE, "SELECT (min(wear_score) FILTER (flagged))::FLOAT::DOUBLE AS worst_flagged, (max(wear_score) FILTER (NOT flagged))::FLOAT::DOUBLE AS best_clear FROM judged WHERE assessable"),
    "top_overlap": (SPLIT + SIMPLE, "SELECT count(*) FILTER (job_id IN (SELECT job_id FROM split WHERE reference_worn)) AS overlap, 11 AS n FROM (SELECT job_id FROM judged WHERE wear_score IS NOT NULL ORDER BY wear_score DESC, job_id LIMIT 11)"),
    "auc_by_rank": (
        SPLIT + ", rk AS (SELECT reference_worn AS w, rank() OVER (ORDER BY peak_to_rms) + (count(*) OVER (PARTITION BY peak_to_rms) - 1) / 2 AS a FROM cut JOIN split USING (job_id)), sm AS (SELECT count(*) FILTER (w) AS p, count(*) FILTER (NOT w) AS n, sum(a) FILTER (w) AS s FROM rk)",
        "SELECT p, n, ((s - p * (p + 1) / 2) / (p * n))::FLOAT::DOUBLE AS auc FROM sm",
    ),
    "stored_scores": (STORED, f"SELECT job_id, machine_id, us, {r('predicted_rms_g', 'residual_g', 'primary_score', 'secondary_score')}, primary_anomalous, secondary_anomalous, anomalous FROM st"),
    "stored_audit": (STORED, f"SELECT job_id, machine_id, us, {r('primary_score')}, anomalous FROM st"),
    "stored_cuts": (STORED, "SELECT c::DOUBLE AS contamination, (CASE WHEN c = 0.01 THEN q[1] ELSE q[2] END)::FLOAT::DOUBLE AS threshold FROM (SELECT quantile_cont(secondary_score, [0.99, 0.85]) AS q FROM st), (SELECT unnest([0.01, 0.15]) AS c)"),
    "stored_job_summary": (
        STORED,
        "SELECT job_id, machine_id, part_type, operator, quantity, start_us, end_us, duration_s, flagged, rank, cutting_readings, n_primary_anomalous, n_secondary_anomalous, n_anomalous, power_readings, vibration_readings, assessable, notes FROM sj",
    ),
    "stored_job_scores": (STORED, f"SELECT job_id, {r('wear_score', 'max_primary_sigma', 'mean_primary_sigma', 'median_primary_sigma', 'anomalous_fraction', 'mean_residual_g', 'mean_vib_per_kw')} FROM sj"),
    "streamed_job_verdicts": (STORED, "SELECT job_id, cutting_readings, (wear_score)::FLOAT::DOUBLE AS wear_score, n_primary_anomalous, n_anomalous, assessable, is_flagged AS flagged FROM sj WHERE cutting_readings > 0"),
    "stored_top10": (STORED, "SELECT job_id, rank, flagged FROM sj WHERE rank <= 10"),
    "stored_confusion": (SPLIT + STORED, "SELECT *, (2 * tp / greatest(n_flagged + tp + fn, 1))::FLOAT::DOUBLE AS f1 FROM (SELECT count(*) FILTER (is_flagged) AS n_flagged, count(*) FILTER (is_flagged AND reference_worn) AS tp, count(*) FILTER (is_flagged AND NOT reference_worn) AS fp, count(*) FILTER (NOT is_flagged AND reference_worn) AS fn FROM sj JOIN split USING (job_id))"),
    "fit_levels": ("", "SELECT 'machine' AS metric, machine_id AS value FROM (SELECT DISTINCT machine_id FROM cut) UNION ALL SELECT 'part_type', part_type FROM (SELECT DISTINCT part_type FROM cut) UNION ALL SELECT 'n_fit_readings', count(*)::VARCHAR FROM cut UNION ALL SELECT 'target', 'log_vibration_rms_g'"),
    "spearman": (
        ", rs AS (SELECT rank() OVER (ORDER BY ratio) + (count(*) OVER (PARTITION BY ratio) - 1) / 2 AS a, rank() OVER (ORDER BY crest) + (count(*) OVER (PARTITION BY crest) - 1) / 2 AS b FROM ratios)",
        "SELECT (corr(a, b))::FLOAT::DOUBLE AS spearman FROM rs",
    ),
}


BODIES["diagnostic_counts"] = (
    "",
    f"SELECT 'cleaning' AS stage, source || '.' || rule AS metric, rows::VARCHAR AS value FROM ({BODIES['cleaning_report'][1]}) UNION ALL SELECT 'alignment', 'offset_s', '18000'",
)


def oracle_sql() -> dict[str, str]:
    return {name: f"{VIEWS}{more}\n{body}" for name, (more, body) in BODIES.items()}
