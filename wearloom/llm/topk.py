"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are dealt out by length (squared norm), each task cuts its stretch into buckets of
vectors of similar length. For a query and a bucket the local cosine threshold is the
query's k-th best score so far over both lengths. Above one, the bucket and all shorter
ones are skipped. Else, from COORDINATE_FROM on, coordinate pruning: a vector that reaches
the cosine has its largest query coordinates within known ranges. Below that, length
pruning: only the bucket's vectors that are long enough. What is left is multiplied out.

Queries come as packed blocks that meet the packed blocks of vectors by an equi-join on
the group that both carry, so neither side is broadcast or collected. A first search in a
sample gives each query a lower bound; queries are packed in the order of bound over
length, and a block is only sent to groups whose longest vector can reach its least bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wearloom.llm.common import written

SCALE = 1024
K = 10
#: Vectors in a bucket, vectors in a packed block, queries in a packed block.
BUCKET, BLOCK, QUERIES = 256, 4096, 512
#: Groups of vectors by length.
GROUPS = 64
#: Keys under which query blocks meet the sample of vectors.
SEED_GROUPS = 8
#: Local cosine from which coordinates prune, and how many coordinates are looked at.
COORDINATE_FROM, COORDINATES = 0.6, 4
#: The ends of a long.
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def quantised(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>, dim, norm2) of the vectors that take part.

    Components are floor(scale * x), x as double; beyond the ends of a long they stop there.
    Vectors that are null, or hold null or non-finite components, take no part, and neither
    do rows without an id, which no result could name. Empty vectors have dimension 0.
    """
    wide = F.col(vector_col).cast("array<double>")
    fine = F.forall(wide, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False)))
    limit = lambda c: F.when(c >= 2.0**63, F.lit(HIGHEST)).when(c < -(2.0**63), F.lit(LOWEST)).otherwise(F.floor(c))
    x = F.transform(wide, lambda c: limit(F.lit(float(scale)) * c))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v"))
    return rows.select("vec_id", "v", F.size("v").alias("dim"), F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")).alias("norm2"))


BLOCK_SCHEMA = "grp int, dim int, longest double, reach double, rows binary, ids binary, least binary, data binary"
TYPES = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
COLUMNS = ("grp", "dim", "row", "vec_id", "norm2", "least", "v")


def _pack(size: int):
    """mapInArrow function: rows of COLUMNS in order of grp and dim to packed blocks of at
    most ``size`` vectors of one grp and dim, longest first.

    longest: length of the longest vector; reach: how long a vector has to be at least to
    matter to any of the block's (as queries with their lower bounds).
    """

    def block(key: tuple[int, int], parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        rows, ids, norms, least, data = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((ids, -norms))
        narrow = not data.size or (data.min() >= -(1 << 31) and data.max() < 1 << 31)
        reach = float((least / np.sqrt(np.maximum(norms, 1e-300))).min())
        packed = [x[order].astype("<i8").tobytes() for x in (rows, ids, least)] + [data[order].astype("<i4" if narrow else "<i8").tobytes()]
        values = (*key, float(np.sqrt(norms.max())), reach, *packed)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, TYPES)], [c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            grp, dims, rows, ids, norms, least = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            flat, ends = batch.column(6).flatten().to_numpy(zero_copy_only=False), np.cumsum(dims, dtype=np.int64)
            cuts = np.flatnonzero((grp[1:] != grp[:-1]) | (dims[1:] != dims[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(ids)]):
                if (own := (int(grp[a]), int(dims[a]))) != key:
                    if held:
                        yield block(key, held)
                    key, held, n = own, [], 0
                while a < b:
                    to = min(b, a + size - n)
                    data = flat[ends[a] - dims[a] : ends[to - 1]].reshape(to - a, own[1])
                    held.append((rows[a:to], ids[a:to], norms[a:to], least[a:to], data))
                    n, a = n + to - a, to
                    if n == size:
                        yield block(key, held)
                        held, n = [], 0
        if held:
            yield block(key, held)

    return run


def _packed(rows: DataFrame, size: int) -> DataFrame:
    return rows.select(*COLUMNS).sortWithinPartitions("grp", "dim", F.desc("norm2"), "vec_id").mapInArrow(_pack(size), BLOCK_SCHEMA)


def _vectors(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i8" if len(data) == 8 * n * dim else "<i4").reshape(n, dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows: in doubles where they hold them, else in longs or
    Python's integers. What a long cannot hold stops at its ends."""
    largest = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    bound = largest(a) * largest(b) * max(1, a.shape[1])
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return np.clip(a.astype(object) @ b.astype(object).T, LOWEST, HIGHEST).astype(np.int64)


def keep_best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, ~scores))[:k]  # ~x falls as x rises, and never leaves a long
    return scores[order], ids[order]


def coordinate_ranges(q: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Between what bounds the coordinates of a unit vector lie whose cosine with a unit
    vector is at least ``cosine``, given that vector's coordinates q: the cosines of the
    angle to the axis plus and minus the cap's angle."""
    slack = np.sqrt(np.maximum(0, 1 - cosine * cosine) * np.maximum(0, 1 - q * q))
    low = np.where(q <= -cosine, -1.0, q * cosine - slack)
    high = np.where(q >= cosine, 1.0, q * cosine + slack)
    return low - 1e-9, high + 1e-9


def retrieve(q_rows, q, least, c_rows, c_ids, c, k: int = K) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], dict[str, int]]:
    """(place in q, ids, scores) of each query's best candidates of one block, and how often
    each pruning was used.

    c is in falling order of length; a candidate row that is the query's own does not count.
    least: scores that a query has for sure elsewhere, so lower products are of no use; equal
    ones are kept, as their ids may be smaller.
    """
    c_norm, q_norm = (np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) for x in (c, q))
    unit = c / np.maximum(c_norm, 1e-300)[:, None]
    used = {"skipped": 0, "coordinate": 0, "length": 0, "verified": 0}
    found = []
    for i in range(len(q)):
        floor = float(least[i])
        best, best_ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        direction = q[i] / max(q_norm[i], 1e-300)
        focus = np.argsort(-np.abs(direction), kind="stable")[:COORDINATES]
        for at in range(0, len(c), BUCKET):
            stretch = slice(at, at + BUCKET)
            if len(best) == k:
                floor = max(floor, float(best[-1]))
            top = q_norm[i] * c_norm[at]
            local = floor / top if top > 0 else (-1.0 if floor <= 0 else 2.0)
            if local > 1 + 1e-9 and floor < HIGHEST:
                used["skipped"] += 1
                break  # and so are all shorter ones
            if COORDINATE_FROM <= local <= 1 + 1e-9:
                used["coordinate"] += 1
                low, high = coordinate_ranges(direction[focus], max(0.0, local - 1e-9))
                near = unit[stretch][:, focus]
                take = np.flatnonzero(((near >= low) & (near <= high)).all(axis=1)) + at
            else:
                used["length"] += 1
                enough = c_norm[stretch] * q_norm[i] >= floor - 1e-6 * max(1.0, abs(floor)) if floor > 0 else np.ones(len(c_norm[stretch]), bool)
                take = np.flatnonzero(enough) + at
            take = take[c_rows[take] != q_rows[i]]
            if not len(take):
                continue
            used["verified"] += len(take)
            scores = products(q[i : i + 1], c[take])[0]
            good = scores >= least[i]
            best, best_ids = keep_best(np.concatenate([best, scores[good]]), np.concatenate([best_ids, c_ids[take][good]]), k)
        if len(best):
            found.append((i, best_ids, best))
    return found, used


def _met(joined: DataFrame, k: int) -> DataFrame:
    """(row, query_id, vec_id, score): each query row's best of each block that it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, *packed in zip(*[batch.column(i).to_pylist() for i in range(8)]):
                q_rows, q_ids, least, c_rows, c_ids = (np.frombuffer(x, "<i8") for x in packed[:5])
                found, _ = retrieve(q_rows, _vectors(packed[5], len(q_rows), dim), least, c_rows, c_ids, _vectors(packed[6], len(c_rows), dim), k)
                if found:
                    place = np.repeat([i for i, _, _ in found], [len(ids) for _, ids, _ in found])
                    columns = (q_rows[place], q_ids[place], np.concatenate([ids for _, ids, _ in found]), np.concatenate([s for _, _, s in found]))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "query_id", "vec_id", "score"])

    names = ("q_dim", "q_rows", "q_ids", "q_least", "rows", "ids", "q_data", "data")
    return joined.select(*names).mapInArrow(run, "row long, query_id long, vec_id long, score long")


def _meet(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Query blocks with the vector blocks of their dimension: a query block is repeated for
    those groups of vectors whose longest one can reach it, and both are joined on the group."""
    groups = blocks.groupBy(F.col("grp").alias("q_grp"), F.col("dim").alias("g_dim")).agg(F.max("longest").alias("most"))
    named = queries.select(*[F.col(c).alias(f"q_{c}") for c in ("dim", "reach", "rows", "ids", "least", "data")])
    named = named.join(groups, (F.col("q_dim") == F.col("g_dim")) & (F.col("q_reach") <= F.col("most") * (1 + 1e-9) + 1e-9))
    return named.join(blocks, (F.col("q_grp") == F.col("grp")) & (F.col("q_dim") == F.col("dim")))


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query, k: int = K, sample: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest products of each query row over all other rows.

    vectors: rows of ``quantised``; is_query: a condition over vec_id. Ties go to the smaller
    vec_id. A query with fewer other vectors has fewer rows; only vectors of a query's
    dimension count. Rows are told apart by a number that is written with them: of repeated
    ids every row is a candidate, and each row that is a query has its own result. Scores
    beyond the ends of a long stop there. An empty table gives no rows. A repeatable sample
    of about ``sample`` vectors gives each query a first lower bound; it changes what is
    pruned, not what is returned. The sample is dealt into SEED_GROUPS groups, so that query
    blocks meet it under several keys. Vectors of any length are multiplied whole.
    """
    vectors = written(vectors.withColumn("row", F.monotonically_increasing_id())).withColumn("least", F.lit(LOWEST))
    n = vectors.count()
    groups = max(1, min(GROUPS, n // BUCKET), n // (16 * BLOCK))
    by_length = vectors.repartitionByRange(groups, F.desc("norm2"), F.col("vec_id"), F.col("row")).withColumn("grp", F.spark_partition_id())
    blocks = written(_packed(by_length, BLOCK))
    wanted = vectors.where(is_query)
    parts = -(-max(1, wanted.count()) // QUERIES)
    dealt = wanted.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")).repartition("grp")
    seeds = vectors.where(F.pmod(F.xxhash64(F.lit("seed"), "vec_id", "row"), F.lit(max(1, n // sample))) == 0).withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(SEED_GROUPS)).cast("int"))
    seeds = written(_packed(seeds.repartition("grp"), BLOCK))
    first = _best(_met(_meet(written(_packed(dealt, QUERIES)), seeds), k), k).where(F.col("rank") == k)
    known = wanted.drop("least").join(first.select("row", F.col("score").alias("bound")), "row", "left").withColumn("least", F.coalesce("bound", F.lit(LOWEST)))
    reach = F.col("least") / F.sqrt(F.greatest("norm2", F.lit(1e-300)))
    queries = known.repartitionByRange(parts, reach, F.col("row")).withColumn("grp", F.spark_partition_id())
    return _best(_met(_meet(written(_packed(queries, QUERIES)), blocks), k), k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT q.vec_id AS query_id, q.rid, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.rid <> c.rid AND len(q.v) = len(c.v))
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 10
"""


def query(embeddings: DataFrame) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 100, candidates all others."""
    return search(quantised(embeddings), F.col("vec_id") % 100 == 0)
