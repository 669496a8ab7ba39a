"""Exact quantiles, of a whole column or by groups, by histograms that narrow in on them.

A built-in exact percentile holds every distinct value of a group in one place, which a
whole table's values outgrow. Here a first pass brackets each quantile with a sketch, and
each further pass counts the values of a bracket in BINS bins, per task and then summed, so
that the driver sees counts only. A bin whose wanted value is its least, its greatest or its
only one ends the search; else the bracket narrows to it. Values are as exact as those of the
built-in: the two neighbours of a rank, interpolated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearloom.functions.tables import kept

BINS = 2048
#: Rank error of the sketch is below 1 / SKETCH; brackets reach SLACK / SKETCH to both sides.
SKETCH, SLACK = 10_000, 3
#: Groups of at most so many values meet in a built-in percentile; longer ones are narrowed.
FEW = 50_000
#: A bracket that has to widen this often takes in every value.
WIDENINGS = 30


Values = Callable[[pa.RecordBatch], np.ndarray]


def _first(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False)


def _histograms(rows: DataFrame, brackets: list[tuple[float, float]], values: Values = _first) -> tuple[list[int], list[dict[int, tuple[int, float, float]]]]:
    """Values below each bracket, and per bracket its bins: (count, least, greatest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = np.zeros(len(brackets), np.int64)
        n = np.zeros((len(brackets), BINS), np.int64)
        least, most = np.full(n.shape, np.inf), np.full(n.shape, -np.inf)
        for batch in batches:
            x = values(batch)
            for i, (low, high) in enumerate(brackets):
                below[i] += np.count_nonzero(x < low)
                inside = x[(x >= low) & (x <= high)]
                if len(inside):
                    width = high / 2 - low / 2  # halves, so that no bracket is too wide
                    at = np.minimum(((inside / 2 - low / 2) / width * BINS).astype(np.int64), BINS - 1) if width > 0 else np.zeros(len(inside), np.int64)
                    n[i] += np.bincount(at, minlength=BINS)
                    np.minimum.at(least[i], at, inside)
                    np.maximum.at(most[i], at, inside)
        i, at = np.nonzero(n)
        k = np.arange(len(brackets))
        columns = (np.r_[k, i], np.r_[np.full(len(k), -1), at], np.r_[below, n[i, at]], np.r_[np.zeros(len(k)), least[i, at]], np.r_[np.zeros(len(k)), most[i, at]])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "bin", "n", "least", "most"])

    found = rows.mapInArrow(run, "i long, bin long, n long, least double, most double")
    below, bins = [0] * len(brackets), [{} for _ in brackets]
    for r in found.groupBy("i", "bin").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).collect():
        if r["bin"] < 0:
            below[r["i"]] = r["n"]
        else:
            bins[r["i"]][r["bin"]] = (r["n"], r["least"], r["most"])
    return below, bins


def _bin_of(rank: int, below: int, bins: dict[int, tuple[int, float, float]]) -> tuple[float, float] | None:
    """Least and greatest value between which a rank lies (equal when it is found); None if it is outside."""
    if rank < below:
        return None
    for _, (n, least, most) in sorted(bins.items()):
        if rank < below + n:
            return (least, least) if rank == below else (most, most) if rank == below + n - 1 else (least, most)
        below += n
    return None


def quantiles(df: DataFrame, column: Column, shares: list[float]) -> list[float] | None:
    """Interpolated quantiles of the finite values of a column; None without any."""
    rows = df.select(column.cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    around = [min(1.0, max(0.0, q + side * SLACK / SKETCH)) for q in shares for side in (-1, 1)]
    n, sketch, low, high = rows.agg(F.count("*"), F.percentile_approx("x", F.array(*map(F.lit, around)), F.lit(SKETCH)), F.min("x"), F.max("x")).first()
    if not n:
        return None
    edge = lambda i: low if around[i] == 0 else high if around[i] == 1 else sketch[i]
    return narrowed(rows, shares, n, [(edge(2 * i), edge(2 * i + 1)) for i in range(len(shares))])


def around(value: float, moved: float, scale: float, n: int, most: float = 0.1) -> tuple[float, float]:
    """A bracket for a median that is searched again after a step of a fit: some times the last
    step to both sides, but wide enough for some hundred of n values, and ``most`` scales at most."""
    half = min(max(4 * moved, 400 * scale / n), most * scale)
    return value - half, value + half


def narrowed(rows: DataFrame, shares: list[float], n: int, near: list[tuple[float, float]], values: Values = _first) -> list[float]:
    """Interpolated quantiles of the n values that ``values`` makes of the batches of rows, all
    of them finite. near: brackets in which they are expected; one that does not hold widens.
    Other than n values, or values that are not finite, are an error."""
    if n < 1:
        raise ValueError("no values to select from")
    ranks = [(min(int(q * (n - 1)), n - 1), min(int(q * (n - 1)) + 1, n - 1)) for q in shares]
    wanted = {rank: near[i] for i, pair in enumerate(ranks) for rank in pair}
    known: dict[int, float] = {}
    widest = (-np.finfo(float).max, np.finfo(float).max)
    tried = dict.fromkeys(wanted, 0)
    while wanted:
        brackets = sorted(set(wanted.values()))
        below, bins = _histograms(rows, brackets, values)
        for rank, bracket in list(wanted.items()):
            i = brackets.index(bracket)
            found = _bin_of(rank, below[i], bins[i])
            if found is None:
                if bracket == widest:
                    raise ValueError(f"{n} finite values were announced, {below[i] + sum(b[0] for b in bins[i].values())} were found")
                tried[rank] += 1
                more = 10 * (bracket[1] - bracket[0]) + 1e-3 * max(map(abs, bracket)) + 1e-9
                wider = (bracket[0] - more, bracket[1]) if rank < below[i] else (bracket[0], bracket[1] + more)
                wanted[rank] = wider if tried[rank] < WIDENINGS and np.isfinite(wider).all() else widest
            elif found[0] == found[1]:
                known[rank] = found[0]
                del wanted[rank]
            else:
                wanted[rank] = found
    part = [q * (n - 1) - a for q, (a, _) in zip(shares, ranks)]
    return [known[a] if known[a] == known[b] else known[a] + (known[b] - known[a]) * t for t, (a, b) in zip(part, ranks)]


def by_group(df: DataFrame, keys: list[str], column: Column, shares: list[float], name: str = "q", few: int | None = None) -> DataFrame:
    """(keys, name: array of the interpolated quantiles of the finite values of a column), one row
    per group, null where it has no value; without keys one row for the whole table.

    Groups of up to ``few`` values are finished by the built-in percentile. The others, however
    long and however many, are narrowed together: a pass counts the values in the bins of each
    open bracket, per task first, and picks the bin of each rank; brackets are a table beside the
    rows, so no group has to be in one task and no list of groups is on the driver.
    """
    if not keys:
        return df.sparkSession.createDataFrame([(quantiles(df, column, shares),)], f"{name} array<double>")
    few = FEW if few is None else few
    x, null_safe = column.cast("double"), lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    usable = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.select(*keys, F.when(usable, x).alias("x"))
    exact = F.percentile("x", F.array(*map(F.lit, shares))).alias(name)
    sizes = kept(rows.groupBy(*keys).agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")))
    most = sizes.agg(F.max("n")).first()[0] or 0
    if most <= few:
        return rows.groupBy(*keys).agg(exact)
    short, long = sizes.where(F.col("n") <= few), sizes.where(F.col("n") > few)
    met = lambda table, wanted, how: rows.alias("r").join(table.alias("t"), null_safe("r", "t"), how).select("r.*", *wanted)
    parts = F.array(*[F.lit(q) * (F.col("n") - 1) for q in shares])
    first = F.transform(parts, lambda p: F.floor(p).cast("long"))
    ranks = F.array_distinct(F.concat(first, F.transform(first, lambda r: F.least(r + 1, F.col("n") - 1))))
    brackets = long.select(*keys, F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"), "low", "high")
    found = brackets.where("low = high").select(*keys, "rank", F.col("low").alias("value"))
    brackets = kept(brackets.where("low < high"))
    while not brackets.isEmpty():
        inside = met(brackets, ["rank", "below", "low", "high"], "inner").where("x >= low AND x <= high")
        at = F.least(F.floor((F.col("x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BINS), F.lit(BINS - 1)).alias("bin")
        bins = inside.groupBy(*keys, "rank", "below", at).agg(F.count("*").alias("m"), F.min("x").alias("least"), F.max("x").alias("most"))
        upto = F.sum("m").over(Window.partitionBy(*keys, "rank").orderBy("bin"))  # some thousand bins
        own = bins.withColumn("before", F.col("below") + upto - F.col("m")).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("m")))
        value = F.when(F.col("rank") == F.col("before"), F.col("least")).when(F.col("rank") == F.col("before") + F.col("m") - 1, F.col("most")).when(F.col("least") == F.col("most"), F.col("least"))
        step = kept(own.select(*keys, "rank", F.col("before").alias("below"), F.col("least").alias("low"), F.col("most").alias("high"), value.alias("value")))
        found = found.unionByName(step.where("value IS NOT NULL").select(*keys, "rank", "value"))
        brackets = step.where("value IS NULL").drop("value")
    values = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("values"))  # two per share
    picked = long.alias("r").join(values.alias("t"), null_safe("r", "t")).select("r.*", "t.values")

    def between(part: Column) -> Column:
        at = F.floor(part).cast("long")
        low, high = F.col("values")[at], F.col("values")[F.least(at + 1, F.col("n") - 1)]
        return F.when(low == high, low).otherwise(low + (high - low) * (part - at))

    narrowed_ones = picked.select(*keys, F.transform(parts, between).alias(name))
    return narrowed_ones.unionByName(met(short, [], "left_semi").groupBy(*keys).agg(exact))


def medians(df: DataFrame, keys: list[str], column: Column, name: str) -> DataFrame:
    """(keys, name): the median of each group's finite values."""
    return by_group(df, keys, column, [0.5], "_q").select(*keys, F.col("_q")[0].alias(name))


def median(df: DataFrame, column: Column) -> float | None:
    found = quantiles(df, column, [0.5])
    return found[0] if found else None
