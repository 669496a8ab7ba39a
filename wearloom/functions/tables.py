"""Cut points and stored layouts: tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session without it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = own.get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths and catalog names of the tables written by each job that wants to remove them at its end.
_open: list[list[tuple[str, str | None]]] = []

#: Input of one file of a stored layout, and the most files that a layout has.
PIECE_BYTES, MOST_PIECES = 256 << 20, 50_000
#: Sizes from here on are the optimizer's mark of a table that it knows nothing of.
UNKNOWN = 1 << 60


def _place(spark: SparkSession, name: str | None = None) -> str:
    """A new path in the shared folder, noted for removal."""
    path = f"{shared_folder(spark)}/wear-{uuid.uuid4().hex}"
    for paths in _open:
        paths.append((path, name))
    return path


def kept(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, for what is read again and again: its lineage ends
    there, no executor holds it, and a lost executor costs nothing."""
    path = _place(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces_for(*frames: DataFrame) -> int:
    """Files of a stored layout: by the bytes of the tables that a frame reads, at least one per
    core. Where a table's size is not known (rows of a program), as many as the session's shuffles."""
    spark, sizes = frames[0].sparkSession, []
    for df in frames:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes.append(sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())))
    least = spark.sparkContext.defaultParallelism
    if max(sizes) >= UNKNOWN:
        return max(int(spark.conf.get("spark.sql.shuffle.partitions")), least)
    return min(max(max(sizes) // PIECE_BYTES, least), MOST_PIECES)


def laid_out(df: DataFrame, keys: list[str], order: list[str], pieces: int) -> DataFrame:
    """df as a table of ``pieces`` files, hashed by the keys, each file in order. ``df`` is
    expected to be dealt out the same way (``repartition(pieces, *keys)``), so that each task
    writes one file. Joins, groups and windows on the keys read it without an exchange."""
    name = f"wear_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(pieces, *keys).sortBy(*keys, *order)
    writer.option("path", _place(df.sparkSession, name)).saveAsTable(name)
    return df.sparkSession.table(name)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that were kept inside, when a job's results are written."""
    paths: list[tuple[str, str | None]] = []
    _open.append(paths)
    try:
        yield
    finally:
        _open.remove(paths)
        for path, name in paths:
            if name:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
