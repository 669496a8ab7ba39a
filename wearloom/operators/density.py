"""Local outlier factor over all rows: an exact nearest-neighbour join of space cells.

Space is cut into cubes at LEVELS levels, each half as wide as the one before. A place searches
at the finest level whose own cell holds all the neighbours that it needs: they are then at most
a cell's diagonal away. The candidates are the points of the cell and its halo, the 26 around
it. The search is proven if the farthest neighbour is no farther than the halo's border; the
rest search once more with cells twice as wide, whose halo reaches beyond any diagonal. So two
joins find the neighbours of all places, by equal keys of (level, cell), whatever the density.

Copies of a place beyond the number of neighbours change nothing and are left out as candidates;
cells with many points are cut into chunks, so no cell is bound to one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearloom.functions.tables import kept

AXES = ("ax", "ay", "az")
LEVELS = 24
#: Points of a cell in one chunk, and places that search together.
CHUNK, TOGETHER = 1024, 512
#: Keeps densities of places with many copies finite.
EPS = 1e-10
CELL = ("level", "cx", "cy", "cz")


def points_of(rows: DataFrame, copies: int) -> DataFrame:
    """(axes, tie, pid): places with at most ``copies`` of each; ties in distance go by a hash."""
    places = rows.select(*AXES).dropna().groupBy(*AXES).agg(F.count("*").alias("n"))
    each = places.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(copies)).cast("int"))))
    return kept(each.select(*AXES, F.xxhash64(*AXES, "copy").alias("tie")).withColumn("pid", F.monotonically_increasing_id()))


def _cell(level: Column, low: dict[str, float], width: float) -> list[Column]:
    """Cell of a place at a level; level 0 is one cell."""
    edge = F.lit(width) * F.pow(F.lit(2.0), -level)
    return [F.floor((F.col(a) - F.lit(low[a])) / edge).cast("long").alias(c) for a, c in zip(AXES, CELL[1:])]


def _nearest(k: int, low: list[float], width: float):
    """(qid, proven, near: the k nearest as (d, tie, pid)) of block pairs (level, cell, places, points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for level, cx, cy, cz, places, points in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), batch.column(5)):
                own = lambda block, names: [block.values.field(n).to_numpy(zero_copy_only=False) for n in names]
                q, p = np.column_stack(own(places, AXES)), np.column_stack(own(points, AXES))
                tie, pid = own(points, ("tie", "pid"))
                d = np.sqrt(((q[:, None] - p[None]) ** 2).sum(-1))
                take = min(k, len(p))
                limit = np.partition(d, take - 1, axis=1)[:, take - 1]
                edge = width * 2.0**-level
                start = np.array(low) + (np.array([cx, cy, cz]) - 1) * edge
                reach = np.minimum(q - start, start + 3 * edge - q).min(axis=1)
                near = []
                for row, most in zip(d, limit):
                    at = np.flatnonzero(row <= most)
                    at = at[np.lexsort((tie[at], row[at]))][:take]
                    near.append([{"d": float(row[i]), "tie": int(tie[i]), "pid": int(pid[i])} for i in at])
                yield pa.RecordBatch.from_arrays([pa.array(own(places, ("qid",))[0]), pa.array(reach), pa.array(near, pa.list_(pa.struct([("d", pa.float64()), ("tie", pa.int64()), ("pid", pa.int64())])))], ["qid", "reach", "near"])

    return run


def neighbours(places: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """(qid, near): the k points nearest to each place (qid, axes), itself among them if it is a
    point, as (d, tie, pid) by distance; fewer if there are fewer."""
    ends = points.agg(*[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("low", F.min), ("high", F.max))], F.count("*").alias("n")).first()
    nothing = places.sparkSession.createDataFrame([], "qid long, near array<struct<d:double,tie:long,pid:long>>")
    if not ends["n"]:
        return nothing
    low = {a: ends[f"low_{a}"] for a in AXES}
    width = max(max(ends[f"high_{a}"] - low[a] for a in AXES) * (1 + 1e-9), 1e-12)
    k = min(k, ends["n"])
    levels = F.explode(F.array(*map(F.lit, range(LEVELS))))
    leveled = points.select("*", levels.alias("level"))
    counts = kept(leveled.select("*", *_cell(F.col("level"), low, width)).groupBy(*CELL).agg(F.count("*").alias("m")))
    searching = places.select("qid", *AXES, levels.alias("level")).select("*", *_cell(F.col("level"), low, width))
    full = counts.where(F.col("m") >= k).drop("m")
    start = searching.join(full, list(CELL)).groupBy("qid", *AXES).agg(F.max("level").alias("level"))
    # Places outside the points' box may have no full cell: they begin at the whole box.
    left = places.select("qid", *AXES).join(start.select("qid", "level"), "qid", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    found, wide = None, 0
    left = kept(left)
    while not left.isEmpty():
        step = kept(_searched(left, points, counts, k, low, width))
        proven = step.where(F.col("proven") | (F.size("near") == ends["n"]))
        found = proven if found is None else found.unionByName(proven)
        rest = step.where(~(F.col("proven") | (F.size("near") == ends["n"]))).select("qid")
        left = kept(left.join(rest, "qid", "left_semi").withColumn("level", F.col("level") - 1))
        wide += 1
    return nothing if found is None else found.select("qid", "near")


def _searched(left: DataFrame, points: DataFrame, counts: DataFrame, k: int, low: dict[str, float], width: float) -> DataFrame:
    """(qid, near, proven) of places that search at their level."""
    chunk = lambda tie, n, size: F.pmod(F.col(tie), F.ceil(F.col(n) / size).cast("long"))
    homes = left.select("*", *_cell(F.col("level"), low, width))
    sizes = homes.groupBy(*CELL).agg(F.count("*").alias("n"))
    together = homes.join(sizes, list(CELL)).withColumn("part", chunk("qid", "n", TOGETHER))
    place = F.struct("qid", *AXES)
    blocks = together.groupBy(*CELL, "part").agg(F.collect_list(place).alias("places"))
    offsets = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(CELL[1:], (x, y, z))]) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]))
    halo = sizes.select(*CELL, offsets.alias("o")).select(*[F.col(c).alias(f"home_{c}") for c in CELL], "level", *[(F.col(c) + F.col("o")[c]).alias(c) for c in CELL[1:]])
    halo = halo.join(counts, list(CELL))
    used = [r["level"] for r in sizes.select("level").distinct().collect()]  # LEVELS at most, and some beyond the whole box
    own = points.select("*", F.explode(F.array(*map(F.lit, used))).alias("level")).select("*", *_cell(F.col("level"), low, width))
    if min(used) < 0:  # counts end at the whole box; wider cells hold it all
        halo = sizes.select(*CELL, offsets.alias("o")).select(*[F.col(c).alias(f"home_{c}") for c in CELL], "level", *[(F.col(c) + F.col("o")[c]).alias(c) for c in CELL[1:]])
        halo = halo.join(own.groupBy(*CELL).agg(F.count("*").alias("m")), list(CELL))
    near = halo.join(own, list(CELL)).withColumn("chunk", chunk("tie", "m", CHUNK))
    point = F.struct(*AXES, "tie", "pid")
    candidates = near.groupBy(*[F.col(f"home_{c}").alias(c) for c in CELL], "chunk").agg(F.collect_list(point).alias("points"))
    pairs = blocks.join(candidates, list(CELL)).select(*CELL, "places", "points")
    partial = pairs.mapInArrow(_nearest(k, [low[a] for a in AXES], width), "qid long, reach double, near array<struct<d:double,tie:long,pid:long>>")
    merged = partial.groupBy("qid").agg(F.max("reach").alias("reach"), F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    every = left.select("qid").join(merged, "qid", "left").withColumn("near", F.coalesce("near", F.slice(F.array(F.struct(F.lit(0.0).alias("d"), F.lit(0).cast("long").alias("tie"), F.lit(0).cast("long").alias("pid"))), 1, 0)))
    proven = (F.size("near") >= k) & (F.element_at(F.col("near"), F.greatest(F.size("near"), F.lit(1)))["d"] <= F.col("reach"))
    return every.select("qid", "near", F.coalesce(F.when(F.size("near") > 0, proven), F.lit(False)).alias("proven"))


def _links(near: DataFrame, drop_self: bool, k: int) -> DataFrame:
    """(qid, d, pid): a row per neighbour, the place itself left out if asked."""
    own = F.filter("near", lambda x: x["pid"] != F.col("qid")) if drop_self else F.col("near")
    return near.select("qid", F.explode(F.slice(own, 1, k)).alias("x")).select("qid", "x.d", "x.pid")


def fit(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(reference, factors) of rows (axes).

    reference: (axes, tie, pid, k_distance, density) of the points; factors: (axes, score, factor)
    per place: the factor of a place that counts as its own neighbour, as any reading that is
    scored, and of one that does not. Empty rows have an empty reference.
    """
    points = points_of(rows, k + 1)
    n = points.count()
    own = min(k, max(n - 1, 1))
    near = kept(neighbours(points.select(F.col("pid").alias("qid"), *AXES), points, own + 1))
    links = kept(_links(near, True, own))
    distances = links.groupBy(F.col("qid").alias("pid")).agg(F.max("d").alias("k_distance"))
    densities = kept(_density(links, distances).withColumnRenamed("qid", "pid"))
    reference = kept(points.join(distances, "pid", "left").join(densities, "pid", "left").select(*AXES, "tie", "pid", F.coalesce("k_distance", F.lit(0.0)).alias("k_distance"), F.coalesce("density", F.lit(1 / EPS)).alias("density")))
    place = lambda factors, name: points.join(factors, points["pid"] == factors["qid"]).groupBy(*AXES).agg(F.min("factor").alias(name))
    included = place(_factors(_links(near, False, own), reference), "score")
    return reference, kept(included.join(place(_factors(links, reference), "factor"), list(AXES), "left"))


def _density(links: DataFrame, distances: DataFrame) -> DataFrame:
    """(qid, density): the inverse of the mean reachability of a place's neighbours."""
    reach = links.join(distances.select("pid", "k_distance"), "pid").select("qid", F.greatest("d", "k_distance").alias("reach"))
    return reach.groupBy("qid").agg((1 / (F.avg("reach") + EPS)).alias("density"))


def _factors(links: DataFrame, reference: DataFrame) -> DataFrame:
    """(qid, factor): mean density of the neighbours over the place's own."""
    met = links.join(reference.select("pid", "k_distance", "density"), "pid")
    return met.groupBy("qid").agg((F.avg("density") * (F.avg(F.greatest("d", "k_distance")) + EPS)).alias("factor"))


def score(places: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """(axes, score) of distinct places against a reference."""
    asked = kept(places.select(*AXES).withColumn("qid", F.monotonically_increasing_id()))
    near = neighbours(asked, reference.select(*AXES, "tie", "pid"), min(k, max(reference.count() - 1, 1)))
    factors = _factors(_links(near, False, k), reference)
    return asked.join(factors, "qid", "left").select(*AXES, F.col("factor").alias("score"))
