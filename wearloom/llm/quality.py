"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)):
the sum-of-squares identity gives all pairwise interactions in time linear in a text's
features. Features of a text are its hashed words (square roots of counts, scaled to
length one), bins of structure statistics and bins of metadata, one indicator each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearloom.llm.common import bucket_of, chunks, filtered, hash_share, written

WORD_BUCKETS = 1 << 15
BINS = 16
#: Structure statistics and metadata, each with BINS indicators.
STATISTICS = ("n_words", "mean_word", "upper", "digits", "symbols", "bangs", "bars", "punctuation", "distinct", "per_line", "repeated_lines", "bigrams", "non_ascii", "n_chars")
FEATURES = WORD_BUCKETS + BINS * len(STATISTICS)
FACTORS = 6
#: Bounds of the training sample, in expectation: labelled documents, and features of them all.
TRAIN_DOCS, TRAIN_FEATURES = 6000, 4_000_000
EPOCHS, BATCH, RATE, DECAY = 8, 64, 0.08, 1e-5
CUTOFF = 0.3
#: Bounds of what a task remembers: words, and their bytes.
REMEMBERED, REMEMBERED_BYTES = 300_000, 1 << 23
SYMBOLS = b"#*$%&|<>"


class Features:
    """Features of texts; remembers the buckets of words up to a bound."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.held = 0

    def of(self, text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(feature ids, values): each id once."""
        data = text.encode("utf-8", "surrogatepass") if text else b""
        words = data.lower().split()
        known = self.known
        if len(known) > REMEMBERED or self.held > REMEMBERED_BYTES:
            known.clear()
            self.held = 0
        distinct = set(words)
        for w in distinct.difference(known):
            self.held += len(w)
            known[w] = zlib.crc32(w.strip(b".,;:!?()\"'")) % WORD_BUCKETS
        ids, counts = np.unique(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), return_counts=True)
        values = np.sqrt(counts)
        if len(ids):
            values /= np.sqrt(counts.sum())
        bins = self.bins(text or "", data, words, len(distinct), n_chars)
        return np.concatenate([ids, bins]), np.concatenate([values, np.full(len(bins), 0.5)])

    def bins(self, text: str, data: bytes, words: list[bytes], distinct: int, n_chars: int | None) -> np.ndarray:
        n, size = max(1, len(words)), max(1, len(data))
        byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        lines = [line for line in data.split(b"\n") if line.strip()]
        symbols = int(byte[list(SYMBOLS)].sum())
        bangs = int(byte[ord("!")])
        share = lambda x, of, scale: min(BINS - 1, int(scale * x / of) + (x > 0))
        log = lambda x: min(BINS - 1, int(np.log2(1 + x)))
        found = (
            log(len(words)),
            min(BINS - 1, int(size / n)),
            share(int(byte[65:91].sum()), size, 30),
            share(int(byte[48:58].sum()), size, 30),
            share(symbols, n, 10),
            share(bangs, n, 10),
            share(int(byte[ord("|")]), n, 20),
            share(int(byte[[33, 40, 41, 44, 45, 46, 58, 59, 63]].sum()) - bangs, n, 20),
            min(BINS - 1, int(BINS * distinct / n)),
            log(len(words) / max(1, len(lines))),
            share(len(lines) - len(set(lines)), max(1, len(lines)), 10),
            min(BINS - 1, int(BINS * len(set(zip(words, words[1:]))) / max(1, len(words) - 1))),
            share(int(byte[128:].sum()), size, 20),
            BINS - 1 if n_chars is None else min(BINS - 2, int(abs(n_chars - len(text)) > 0) * 7 + int(np.log10(1 + max(0, n_chars)))),
        )
        return WORD_BUCKETS + BINS * np.arange(len(STATISTICS)) + np.array(found)


@dataclass
class Machine:
    """Weights of a factorisation machine."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, ids: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Margins of rows whose features lie one after the other from ``starts`` on."""
        vx = self.v[ids] * values[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(vx * vx, starts, axis=0)
        return self.bias + np.add.reduceat(self.w[ids] * values, starts) + 0.5 * (sums * sums - squares).sum(axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 11) -> Machine:
    """Logistic loss by AdaGrad over small batches. Without two labels a constant."""
    rng = np.random.default_rng(seed)
    mean = (labels.sum() + 1) / (len(labels) + 2)
    model = Machine(float(np.log(mean / (1 - mean))), np.zeros(FEATURES), rng.normal(0, 0.05, (FEATURES, FACTORS)))
    if len(set(labels.tolist())) < 2:
        model.v[:] = 0
        return model
    gw, gv, gb = np.full(FEATURES, 1e-4), np.full((FEATURES, FACTORS), 1e-4), 1e-4
    sizes = np.array([len(i) for i, _ in rows])
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // BATCH)):
            ids = np.concatenate([rows[i][0] for i in at])
            x = np.concatenate([rows[i][1] for i in at])
            starts = np.cumsum(sizes[at]) - sizes[at]
            owner = np.repeat(np.arange(len(at)), sizes[at])
            error = sigmoid(model.margin(ids, x, starts)) - labels[at]
            vx = model.v[ids] * x[:, None]
            sums = np.add.reduceat(vx, starts, axis=0)
            slope = (error[owner] * x)[:, None] / len(at)
            one, place = np.unique(ids, return_inverse=True)
            dw = np.bincount(place, slope[:, 0]) + DECAY * model.w[one]
            each = slope * (sums[owner] - vx)
            dv = np.column_stack([np.bincount(place, each[:, f]) for f in range(FACTORS)]) + DECAY * model.v[one]
            gw[one] += dw * dw
            gv[one] += dv * dv
            model.w[one] -= RATE * dw / np.sqrt(gw[one])
            model.v[one] -= RATE * 0.3 * dv / np.sqrt(gv[one])
            gb += error.mean() ** 2
            model.bias -= RATE * error.mean() / np.sqrt(gb)
    return model


FEATURE_SCHEMA = "label int, ids binary, x binary, n int, part double"


def train(docs: DataFrame, labels: DataFrame, chosen: Column | None = None, docs_wanted: int = TRAIN_DOCS, features_wanted: int = TRAIN_FEATURES) -> Machine:
    """Fit on labelled documents where ``chosen`` (over doc_id) holds.

    ``docs_wanted`` bounds the sample (in expectation, thinned by a repeatable hash of the
    id), so the joined labels are small enough to be broadcast. Features are made where the
    texts lie and written; where all of them are over TRAIN_FEATURES (long texts of many
    words), documents are thinned again before any reach the driver. Ids labelled both ways
    and null labels or ids are left out. Repeated documents count as often as they are there.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if chosen is not None:
        known = known.where(chosen)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other")).where("label = other")
    share = min(1.0, docs_wanted / max(1, known.count()))
    sample = known.where(hash_share("doc_id") < share).select("doc_id", F.col("label").cast("int").alias("label"))
    extra = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", extra.alias("n_chars")).join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [features.of(t, n) for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(2), pa.array([i.astype("<i4").tobytes() for i, _ in found], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in found], pa.binary()),
                    pa.array([len(i) for i, _ in found], pa.int32()), batch.column(3),
                ],
                ["label", "ids", "x", "n", "part"],
            )

    made = written(joined.select("text", "n_chars", "label", hash_share("doc_id", seed=8).alias("part")).mapInArrow(run, FEATURE_SCHEMA))
    share = min(1.0, features_wanted / max(1, made.agg(F.sum("n")).first()[0] or 0))
    got = made.where(F.col("part") < share).select("label", "ids", "x").collect()
    got.sort(key=lambda r: (r.ids, r.x, r.label))  # the fit does not depend on how rows were dealt
    rows = [(np.frombuffer(r.ids, "<i4").astype(np.int64), np.frombuffer(r.x, "<f4").astype(float)) for r in got]
    return fit(rows, np.array([r.label for r in got], float))


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """(doc_id, score) of every row: higher where label 1 is likelier.

    Null and empty texts are scored by their structure bins, texts of any length as a whole.
    Equal texts have equal scores; repeated rows stay. Only doc_id (carried), text and n_chars
    (metadata; null or missing has a bin of its own) are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, own = Features(), shared.value
        for batch in batches:
            n_chars = batch.column(2).to_pylist()
            for at, some in chunks(batch.column(1).to_pylist()):
                found = [features.of(t, n) for t, n in zip(some, n_chars[at : at + len(some)])]
                sizes = np.array([len(i) for i, _ in found])
                margin = own.margin(np.concatenate([i for i, _ in found]), np.concatenate([x for _, x in found]), np.cumsum(sizes) - sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), pa.array(sigmoid(margin))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", extra.alias("n_chars")).mapInArrow(run, "doc_id long, score double")


def kept(docs: DataFrame, model: Machine, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of docs, all columns, that score at least the cutoff."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    features = Features()

    def keep(batch: pa.RecordBatch) -> list[bool]:
        n_chars = batch.column("n_chars").to_pylist() if "n_chars" in batch.schema.names else [None] * batch.num_rows
        margins = []
        for text, n in zip(batch.column("text"), n_chars):
            ids, x = features.of(text.as_py(), n)
            margins.append(float(shared.value.margin(ids, x, np.zeros(1, np.int64))[0]))
        return (sigmoid(np.array(margins)) >= cutoff).tolist()

    return filtered(docs, keep)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), learned from rows whose crc32(doc_id) mod 5 is not 0.
    A null doc_id is in no fold: held_out is false and the row is not learned from."""
    model = train(docs, labels, bucket_of("doc_id", 5) != 0)
    return score(docs, model).select(
        "doc_id", F.coalesce(bucket_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted")
    )
