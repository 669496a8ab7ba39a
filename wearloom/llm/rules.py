"""Quality rules whose cutoffs keep false rejections within a stated risk.

Each rule rejects a document whose metric is above a cutoff. Cutoffs come from a fixed grid
per rule, so they do not depend on the labelled rows; those are the holdout. In each
stratum a rule's cutoffs are tested from the most lenient on: a cutoff is admitted if the
exact binomial bound of the share of good documents that it loses is at most its risk, and
the first failure ends the sequence (a fixed sequence needs no correction within itself).
Over rules and strata the level is divided by their number (Bonferroni). The strictest
admitted cutoff is taken; without one the rule is off in that stratum. A stratum's rules
share RISK, so that all together lose at most that share of its good documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearloom.llm.common import chunks, written

#: Share of a stratum's good documents that its rules may lose, and the chance that any fails this.
RISK, LEVEL = 0.1, 0.05
WINDOW_WORDS = 5
SYMBOLS = b"#*$%&|<>"
#: Rules: metric (SQL over the base columns) and its grid of cutoffs, most lenient first.
RULES = {
    "symbols_per_word": ("n_symbols / greatest(n_words, 1)", (1.6, 0.8, 0.4, 0.2, 0.1)),
    "duplicate_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.7, 0.5, 0.4)),
    "repeated_words": ("n_repeat_words / greatest(n_words, 1)", (0.19, 0.16)),
    "adjacent_repeats": ("n_adjacent / greatest(n_words, 1)", (0.6, 0.4, 0.25)),
    "upper_case": ("n_upper / greatest(word_chars, 1)", (0.5, 0.3, 0.2)),
    "exclamations": ("n_bangs / greatest(n_words, 1)", (1.0, 0.6, 0.3)),
    "long_words": ("word_chars / greatest(n_words, 1)", (24.0, 16.0, 12.0)),
}
BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
MORE = "n_lines long, n_adjacent long, n_upper long, n_bangs long"
NAMES = [c.split()[0] for c in f"{BASE}, {MORE}".split(", ")]


def repeated_words(ids: np.ndarray, window: int = WINDOW_WORDS) -> int:
    """Words in windows that occur twice or more. ids: equal words, equal numbers."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    rank = ids
    for size in range(2, window + 1):  # rank of the window of ``size`` words from each place on
        pair = rank[: len(ids) - size + 1] * (len(ids) + 1) + ids[size - 1 :]
        _, rank, counts = np.unique(pair, return_inverse=True, return_counts=True)
        if size == 2 and counts.max() < 2:
            return 0
    again = np.flatnonzero(counts[rank] > 1)
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, again, 1)
    np.add.at(change, again + window, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def measures(text: str | None) -> tuple[int, ...]:
    """The base metrics and those of the rules, in the order of NAMES without doc_id."""
    text = text or ""
    data = text.encode("utf-8")
    words = data.split()
    spaces = len(data) - len(data.translate(None, b" \t\n\x0b\x0c\r"))
    lines = [line for line in data.split(b"\n") if line.strip()]
    place: dict[bytes, int] = {}
    ids = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words))
    return (
        len(words),
        len(text) - spaces,
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids) if len(place) < len(words) else 0,
        len(lines),
        int((ids[1:] == ids[:-1]).sum()),
        len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        data.count(b"!"),
    )


def metrics(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum and all counts of every row, over whole texts. Null text: all zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in chunks(batch.column(1).to_pylist()):
                columns = np.array([measures(t) for t in some], np.int64).T
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(some)), batch.column(2).slice(at, len(some)), *map(pa.array, columns)], ["doc_id", "stratum", *NAMES[1:]]
                )

    kept = F.col(stratum).cast("string") if stratum in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", kept.alias("stratum")).mapInArrow(run, f"doc_id long, stratum string, {', '.join(f'{n} long' for n in NAMES[1:])}")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(at most k of n) with chance p, exact up to rounding.

    Terms are added from k away from the middle, where they only fall, until they no longer
    count: some deviations' worth of them, however large k is.
    """
    if k >= n:
        return 1.0
    below = k <= n * p
    i = k if below else k + 1
    log = math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    term = total = 1.0
    odds = p / (1 - p)
    while (i > 0 if below else i < n) and term > 1e-18 * total:
        if below:
            term *= i / ((n - i + 1) * odds)
            i -= 1
        else:
            term *= (n - i) * odds / (i + 1)
            i += 1
        total += term
    tail = math.exp(min(0.0, log + math.log(total)))
    return tail if below else 1.0 - tail


def lost_bound(k: int, n: int, level: float) -> float:
    """Exact (Clopper-Pearson) upper bound of a share of which k of n were seen."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_tail(k, n, mid) > level else (low, mid)
    return high


def admitted(k: int, n: int, level: float, risk: float) -> bool:
    """Whether that bound is at most ``risk``: one tail, at the risk itself."""
    return 0 < n and k < n and binomial_tail(k, n, risk) <= level


def good_counts(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, n, one count per rule and cutoff): good documents, and how many each cutoff rejects.

    Good are documents that are labelled 1, and nowhere 0, and pass the base rules. An id is
    one draw: of its repeated rows the least counts. Sums are partly made before anything is
    dealt out, one row per stratum comes out.
    """
    good = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("least")).where("least = 1").select("doc_id")
    drawn = measured.where(~F.expr(BASE_FAILED)).join(good, "doc_id", "left_semi")
    one = drawn.groupBy("doc_id").agg(F.min(F.struct("stratum", *NAMES[1:])).alias("row")).select("row.*")
    counted = [F.count_if(F.expr(metric) > cutoff).alias(f"{name}_{i}") for name, (metric, grid) in RULES.items() for i, cutoff in enumerate(grid)]
    return one.groupBy("stratum").agg(F.count("*").alias("n"), *counted)


BASE_FAILED = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"


def cutoffs(row: dict, tests: int, risk: float = RISK, level: float = LEVEL) -> dict[str, float]:
    """Cutoffs by rule of a stratum, from its row of ``good_counts``. A rule that no cutoff admits
    is missing."""
    own: dict[str, float] = {}
    for name, (_, grid) in RULES.items():
        for i, cutoff in enumerate(grid):
            if not admitted(row[f"{name}_{i}"], row["n"], level / tests, risk / len(RULES)):
                break
            own[name] = cutoff
    return own


def limits_of(counts: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """(of, most_<rule>): each stratum's cutoffs, found where its counts are."""
    counts = written(counts)
    tests = max(1, len(RULES) * counts.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            own = [cutoffs(r, tests, risk, level) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["stratum"] for r in rows], pa.string()), *(pa.array([o.get(name) for o in own], pa.float64()) for name in RULES)], ["of", *(f"most_{name}" for name in RULES)])

    return counts.mapInArrow(run, "of string, " + ", ".join(f"most_{name} double" for name in RULES))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """doc_id, n_words, the base metrics, base_failed, kept, stratum, rejected_by: one row per input row.

    Null texts have no words, so they fail the base rules. Null strata are one stratum. A
    stratum without labelled documents, and every stratum of a table without labels, has no
    rule but the base rules. Ids labelled both ways, null ids and null labels teach nothing;
    repeated rows stay and are judged alike, but an id is one draw of the holdout. A metric equal
    to its cutoff is kept. Very long texts are measured whole; other columns are not read,
    whatever their names. An empty table gives no rows. Cutoffs are found on the executors, a row
    per stratum, and joined as their size allows.
    """
    measured = written(metrics(docs, stratum))
    limits = written(limits_of(good_counts(measured, labels), risk, level))
    joined = measured.join(limits, F.col("stratum").eqNullSafe(F.col("of")), "left")
    broken = F.array_compact(F.array(*[F.when(F.expr(metric) > F.col(f"most_{name}"), F.lit(name)) for name, (metric, _) in RULES.items()]))
    judged = joined.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("rejected_by", broken)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), "stratum", F.array_join("rejected_by", ",").alias("rejected_by"),
    )
