"""A corpus pipeline: each stage's rows are written as Parquet and reread by the next.

Language identification, quality classifier, SimHash near-duplicates, mixing to target
weights, BPE. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearloom.llm import bpe, langid, mixing, quality, simhash
from wearloom.llm.common import read, shared_dir

#: A document is rejected if it is in no learned language, or less surely in it than this.
LEAST_LANGUAGE_SCORE = 0.2


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those of no clear language. Learns from rows with a lang.

    Null and empty texts have no letter and go; null ids are not learned from but judged like
    others. Repeated rows are judged alike and stay. Very long texts are scored whole, columns
    may have any names. Where no row has a lang, nothing is rejected. An empty table stays empty.
    """
    model = langid.train(docs, F.lit(True))
    return langid.kept(docs, model, LEAST_LANGUAGE_SCORE)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored below the classifier's cutoff. Learns from the labelled rows of docs.

    Null and empty texts are scored by their structure, null or missing n_chars have a bin of
    their own; ids labelled both ways and null labels teach nothing. Repeated rows are judged
    alike and stay. Very long texts are scored whole, columns may have any names. Without labels
    every document has the score of even odds and stays. An empty table stays empty.
    """
    return quality.kept(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least id, of
    several with it the least text hash; of rows that agree in id and text any one.

    Null ids stand for a group only where all its ids are null; different texts under one id
    are different documents. Null and empty texts are one group. Very long texts are hashed
    whole, columns may have any names. An empty table stays empty.
    """
    return simhash.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them.

    Null sources are one source; null and empty texts have no words and, like all rows of a
    source, their copies follow its rate. Rows equal in id, source and text are one of them,
    emitted for all. Reruns agree. Very long texts stay whole, columns may have any names. An
    empty table stays empty.
    """
    return mixing.mixed(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text, for every row.

    Null texts count as empty, null ids stay null, repeated rows stay, very long texts are
    encoded whole; other columns are not read. An empty table gives no rows.
    """
    return bpe.encode_and_decode(docs)


STAGES = [
    ("language_id", language_stage),
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Trained models, links and merges are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
