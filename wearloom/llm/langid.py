"""Language identification with Viterbi over the words of a text.

Training counts hashed character n-grams per language over a bounded sample of
documents. Scoring: the scripts of a word's letters narrow its candidates to languages
learned in that script, n-gram log likelihoods score the word per candidate, and Viterbi
with a penalty for each switch labels the words, so mixed texts fall into spans.

Most texts have one language. For these a test over prefix sums proves that no excursion
into another language pays for its switches; only the rest run the full recursion.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearloom.llm.common import bucket_of, chunks, filtered, hash_share

UNKNOWN = "und"
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
LONGEST_GRAM = 4
#: Bound of the training sample: expected documents per language.
TRAIN_DOCS = 1500
#: Languages that a model may have: its table has a column for each.
MOST_LANGS = 1000
SWITCH_PENALTY = 12.0
SMOOTHING = 0.5
#: Share of a word's total n-gram evidence that counts: the n-grams of a word overlap.
WEIGHT = 0.5
#: Bounds of what a task remembers: words, and their characters.
REMEMBERED, REMEMBERED_CHARS = 300_000, 1 << 23
#: A script belongs to a language from this share of its letters on.
SCRIPT_SHARE = 0.01
#: First and last code point of blocks, by script.
SCRIPT_RANGES = [
    (0x0041, 0x024F, "latin"), (0x0250, 0x02AF, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"), (0x0600, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"),
    (0x0980, 0x09FF, "bengali"), (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"),
    (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"), (0x3040, 0x30FF, "kana"), (0x3400, 0x4DBF, "han"),
    (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"), (0xFF21, 0xFF5A, "latin"),
]


def script_of(char: str) -> str:
    """The script of a letter; where no range holds it, its block of 128 code points."""
    code = ord(char)
    for first, last, name in SCRIPT_RANGES:
        if first <= code <= last:
            return name
    return f"block-{code >> 7:x}"


def letters_of(word: str) -> str:
    """The word in lower case without what is no letter or mark; empty without a letter."""
    kept = word.lower() if word.isalpha() else "".join(c for c in word.lower() if c.isalpha() or unicodedata.category(c)[0] == "M")
    return kept if any(map(str.isalpha, kept)) else ""


def word_grams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, bucket) arrays: the hashed n-grams of words with their borders, one n at a
    time, and at last each whole word. Words are never empty."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    factor, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - BUCKET_BITS)
    mixed = codes + np.uint64(1)
    rolled = np.zeros(len(codes), np.uint64)
    for n in range(1, LONGEST_GRAM + 1):
        rolled = (rolled[: len(codes) - n + 1] ^ (rolled[: len(codes) - n + 1] >> np.uint64(29))) * factor + mixed[n - 1 :]
        inside = owner[: len(rolled)] == owner[n - 1 :]
        yield owner[: len(rolled)][inside], ((rolled[inside] * factor) >> shift).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    place = (np.arange(len(codes)) - np.repeat(starts, sizes)).astype(np.uint64)
    whole = np.add.reduceat((mixed + (place << np.uint64(32))) * factor ^ mixed, starts)
    yield np.arange(len(words)), ((whole * factor) >> shift).astype(np.int64)


@dataclass
class Model:
    """langs, log likelihoods of the buckets (BUCKETS x langs) and the scripts of each language."""

    langs: list[str]
    table: np.ndarray
    scripts: list[set[str]]


def train(docs: DataFrame, chosen: Column, id_col: str = "doc_id", per_lang: int = TRAIN_DOCS) -> Model:
    """Fit on rows where ``chosen`` holds and lang is not null.

    A first pass counts documents per language (narrow columns only); a repeatable hash
    of the id then thins each language to about ``per_lang`` documents. What reaches the
    driver are columns of numbers, at most BUCKETS for each language; more than MOST_LANGS
    languages are refused with an error.
    """
    labelled = docs.where(chosen & F.col("lang").isNotNull() & F.col(id_col).isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), [])
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"{len(sizes)} languages are labelled, at most {MOST_LANGS} can be learned")
    langs = sorted(sizes)
    share = F.element_at(F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, per_lang / sizes[lang]))]), F.col("lang"))
    sample = labelled.where(hash_share(id_col) < share).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        scripts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                seen = scripts.setdefault(lang, Counter())
                words = Counter(filter(None, map(letters_of, (text or "").split())))
                if words:
                    n = np.fromiter(words.values(), np.int64, len(words))
                    for at, bucket in word_grams(list(words)):
                        own += np.bincount(bucket, n[at], BUCKETS).astype(np.int64)
                chars = Counter(c for c in (text or "").lower() if c.isalpha())
                for c, n in chars.items():
                    seen[script_of(c)] += n
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            seen = scripts[lang]
            keys, marks = np.r_[at, np.full(len(seen), -1)], [None] * len(at) + list(seen)
            values = np.r_[own[at], np.fromiter(seen.values(), np.int64, len(seen))]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(marks, pa.string()), pa.array(values, pa.int64())], ["lang", "bucket", "script", "n"])

    table = np.full((BUCKETS, len(langs)), SMOOTHING)
    letters: list[Counter] = [Counter() for _ in langs]
    place = {lang: i for i, lang in enumerate(langs)}
    counted = sample.mapInArrow(run, "lang string, bucket long, script string, n long")
    found = counted.groupBy("lang", "bucket", "script").agg(F.sum("n").alias("n")).toArrow()
    lang = np.array([place[x] for x in found["lang"].to_pylist()], np.int64)
    bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
    own = bucket >= 0
    table[bucket[own], lang[own]] += n[own]
    for i in np.flatnonzero(~own).tolist():
        letters[lang[i]][found["script"][i].as_py()] += int(n[i])
    scripts = [{s for s, n in c.items() if n >= SCRIPT_SHARE * c.total()} for c in letters]
    return Model(langs, (np.log(table) - np.log(table.sum(axis=0))).astype(np.float32), scripts)


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each row of scores (words x labels) when each switch costs the penalty.

    Of equal ways a word stays with its label; of equal labels the lower one is taken.
    """
    n, k = scores.shape
    best = scores[0].tolist()
    tops, moves = [0] * n, [()] * n  # the label that switches come from; the labels that are switched to
    own = range(k)
    for t, row in enumerate(scores.tolist()):
        if not t:
            continue
        high = max(best)
        floor = high - penalty
        if min(best) < floor:
            tops[t] = best.index(high)
            moves[t] = [i for i in own if best[i] < floor]
            best = [(b if b >= floor else floor) + r for b, r in zip(best, row)]
        else:
            best = [b + r for b, r in zip(best, row)]
    path = np.empty(n, np.int32)
    at = best.index(max(best))
    for t in range(n - 1, -1, -1):
        path[t] = at
        if moves[t] and at in moves[t]:
            at = tops[t]
    return path


def labels(scores: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """What ``viterbi`` returns, without the recursion where one label provably wins.

    With a the label of the highest total, a path that visits a leaves it for spans of other
    labels; each span brings at most the largest gain of that label over a on adjacent words,
    and needs at least one switch of its own. A path that never visits a has one span, and no
    more than the total of a, or at least one switch, and brings at most the best gain of any
    other label over a, summed over all words. If neither the gain of any label nor this sum
    reaches the penalty, a alone is best.
    """
    if not len(scores):
        return np.zeros(0, np.int32)
    totals = scores.sum(axis=0, dtype=np.float64)
    a = int(totals.argmax())
    over = scores - scores[:, a : a + 1]
    gain = np.zeros((len(scores) + 1, scores.shape[1]))
    np.cumsum(over, axis=0, dtype=np.float64, out=gain[1:])
    largest = (gain - np.minimum.accumulate(gain, axis=0)).max(axis=0)
    largest[a] = -1
    over[:, a] = -np.inf
    if (largest < penalty).all() and over.max(axis=1).sum(dtype=np.float64) < penalty:
        return np.full(len(scores), a, np.int32)
    return viterbi(scores, penalty)


class Scorer:
    """Applies a model to texts; remembers the scores of words up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.rows: dict[str, int] = {}
        self.chars = 0
        self.others: dict[frozenset, np.ndarray | None] = {}
        self.scores = np.zeros((1024, len(model.langs)), np.float32)
        self.weights = np.zeros(1024, np.int64)

    def learn(self, words: set[str]) -> None:
        if len(self.rows) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.rows.clear()
            self.chars = 0
        new = [w for w in words if w not in self.rows]
        self.chars += sum(map(len, new))
        while len(self.rows) + len(new) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.weights = np.concatenate([self.weights, np.zeros_like(self.weights)])
        pure = [letters_of(w) for w in new]
        at = len(self.rows)
        self.rows.update(zip(new, range(at, at + len(new))))
        sums = np.zeros((len(new), len(self.model.langs)), np.float32)
        full = np.flatnonzero(np.fromiter(map(len, pure), np.int64, len(pure)))
        if len(full):
            for at_word, bucket in word_grams([pure[i] for i in full.tolist()]):
                if not len(at_word):
                    continue  # no word is as long as these n-grams
                starts = np.flatnonzero(np.r_[True, at_word[1:] != at_word[:-1]])
                sums[full[at_word[starts]]] += np.add.reduceat(self.model.table[bucket], starts, axis=0) * WEIGHT
        for i in full.tolist():
            if (out := self.outside(pure[i])) is not None:
                sums[i, out] = sums[i, ~out].min() - 50
        self.scores[at : at + len(new)] = sums - sums.max(axis=1, keepdims=True, initial=-np.inf) if len(new) else sums
        self.weights[at : at + len(new)] = [len(p) for p in pure]

    def outside(self, pure: str) -> np.ndarray | None:
        """Which languages were learned in none of a word's scripts; None where that narrows nothing."""
        found = frozenset(("latin",)) if pure.isascii() else frozenset(map(script_of, pure))
        if found not in self.others:
            out = np.array([not found & s for s in self.model.scripts], bool)
            self.others[found] = out if out.any() and not out.all() else None
        return self.others[found]

    def words(self, text: str | None) -> tuple[list[str], np.ndarray]:
        """The words of a text and their labels; -1 for words without letters."""
        words = text.split() if text else []
        self.learn(set(words))
        return words, self._path(words)[0]

    def _path(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        weights = self.weights[rows]
        scored = np.flatnonzero(weights)
        path = np.full(len(words), -1, np.int32)
        scores = self.scores[rows[scored]]
        if len(scored) and len(self.model.langs):
            path[scored] = labels(scores)
        return path, weights, scores

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of most letters, and its share of the letters times its posterior."""
        words = text.split() if text else []
        self.learn(set(words))
        path, weights, scores = self._path(words)
        if not len(scores) or not self.model.langs:
            return UNKNOWN, 0.0
        share = np.bincount(path[path >= 0], weights[path >= 0], minlength=len(self.model.langs))
        best = int(share.argmax())
        mine = scores[path[path >= 0] == best].sum(axis=0, dtype=np.float64)
        odds = np.exp(np.clip(mine - mine.max(), -700, 0))
        return self.model.langs[best], float(share[best] / share.sum() * odds[best] / odds.sum())


def _applied(docs: DataFrame, model: Model, schema: str, rows) -> DataFrame:
    """mapInArrow of ``rows(scorer, doc_id array, texts)`` over (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for at, some in chunks(batch.column(1).to_pylist()):
                yield rows(scorer, batch.column(0).slice(at, len(some)), some)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row.

    ``und`` with score 0 for null texts, texts without a letter, and a model that has seen
    no labelled row. A word's scripts leave it the languages that were learned in one of them;
    scripts that no language was learned in do not narrow. Texts of any length are scored as a
    whole. Equal ways through a text take the label of the lower code points. Repeated rows
    stay; columns other than doc_id and text are not read.
    """

    def rows(scorer, ids, texts):
        found = [scorer.predict(t) for t in texts]
        return pa.RecordBatch.from_arrays([ids, pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return _applied(docs, model, "doc_id long, lang_pred string, score double", rows)


def kept(docs: DataFrame, model: Model, least_score: float) -> DataFrame:
    """The rows of docs, all columns, in a learned language with at least that score.
    A model that has seen no labelled row rejects nothing."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scorers: list[Scorer] = []

    def keep(batch: pa.RecordBatch) -> list[bool]:
        if not scorers:
            scorers.append(Scorer(shared.value))
        found = (scorers[0].predict(t.as_py()) for t in batch.column("text"))
        return [lang != UNKNOWN and score >= least_score for lang, score in found]

    return filtered(docs, keep) if model.langs else docs


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, first_word, n_words, lang) of each run of words of one language, in order.
    Words without letters belong to the run before them."""

    def rows(scorer, ids, texts):
        out: list[tuple] = []
        for doc_id, text in zip(ids.to_pylist(), texts):
            _, path = scorer.words(text)
            known = np.flatnonzero(path >= 0)
            if len(known):
                filled = path[known[np.maximum(np.searchsorted(known, np.arange(len(path)), "right") - 1, 0)]]
                starts = np.flatnonzero(np.r_[True, filled[1:] != filled[:-1]])
                out += [(doc_id, int(s), int(e - s), scorer.model.langs[filled[s]]) for s, e in zip(starts, np.r_[starts[1:], len(filled)])]
        columns = list(zip(*out)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "first_word", "n_words", "lang"])

    return _applied(docs, model, "doc_id long, first_word long, n_words long, lang string", rows)


def query(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from rows whose crc32(doc_id) mod 3 is not 1.
    A null doc_id is in no fold: held_out is false and the row is not learned from."""
    model = train(docs, bucket_of("doc_id", 3) != 1)
    return predict(docs, model).select("doc_id", F.coalesce(bucket_of("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
