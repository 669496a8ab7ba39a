"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python task holds as words at a time.
CHUNK_CHARS = 1 << 21


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = own.get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Rows of narrow tables (two or three longs) that are worth a file of their own.
FILE_ROWS = 1 << 18


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df as a table in the shared folder: lineage is cut and lost executors cost nothing.

    Where about how many ``rows`` it has is known, no more files are written than they fill, but
    one per core; each file costs processes that Hadoop starts from the executor to set its rights."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(rows // FILE_ROWS, spark.sparkContext.defaultParallelism))
    path = f"{shared_dir(spark).rstrip('/')}/wearloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def chunks(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """(first index, texts) of runs of at most ``limit`` characters; a longer text stands alone."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > limit:
            yield start, texts[start:i]
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, texts[start:]


def bucket_of(doc_id: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo: the folds that the queries fix. Null id: null."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(modulus))


def hash_share(*columns: str, seed: int = 7) -> Column:
    """A repeatable number from 0 up to 1 for a row."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in columns]), F.lit(1 << 30)) / F.lit(float(1 << 30))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def filtered(docs: DataFrame, keep) -> DataFrame:
    """The rows of docs for which ``keep(batch)`` holds (a function of an Arrow batch to a
    list of booleans). Rows are judged where they lie, with all their columns: nothing is
    dealt out and ids need not be unique."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(keep(batch), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
