"""SimHash near-duplicates by an inverted index over byte positions.

A fingerprint has eight bytes. Two fingerprints that differ in at most four bits
differ in at most four bytes, so they share at least four positional bytes: that is
the guaranteed count. Every four positions contain one of 20 triples of positions
(the covering family of ``triples``), so posting lists of (triple, its bytes) meet
every pair that can reach the count; on each met pair the shared positional bytes
are tallied, pairs below the count are dropped, and the bits of the rest are compared.

Rows with equal fingerprints are one node, so exact copies never meet in a list. A
list of near copies yields a spanning forest of its links, not all its pairs.

Positions are written as masks, a list's key as mask and masked fingerprint. A list above
LONG_LIST is not solved: its values go on to the next round under longer masks. What four
bits can differ in leaves one of five parts of the other bits untouched, so lists under the
mask and each of five such parts (further bytes at first) hold every linked pair again. A
task holds LONG_LIST values of a list at most, and parts end where no list can be longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearloom.llm.common import written
from wearloom.llm.components import connected_components

SEED = 42
SHINGLE_WORDS = 4
MAX_BITS = 4
BYTES = 8
#: Lists up to this length are compared pair by pair, longer ones by a search that shrinks.
SMALL_LIST = 8
#: Longer lists go on to the next round, under longer masks.
LONG_LIST = 1 << 12
HASHES_AT_ONCE = 1 << 16


def simhash(text: str | None, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """64-bit fingerprint (unsigned) of a text.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are
    joined by one space; a text of fewer words is one shingle, without words it is 0.
    A bit is set if it is set in over half of the shingles' XXH64, repeats included.
    """
    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return 0
    n, k = len(words), min(words_per_shingle, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - k + 1].tolist()
    ends = ends[k - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), HASHES_AT_ONCE):
        some = [digest(joined[a:b], SEED) for a, b in zip(starts[i : i + HASHES_AT_ONCE], ends[i : i + HASHES_AT_ONCE])]
        h = np.array(some, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(h, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long. Null text: 0.
    ``more`` are further columns of longs that are carried along."""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *more)
    names = ["doc_id", "fp", *chosen.columns[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), *batch.columns[2:]], names)

    return chosen.mapInArrow(run, ", ".join(f"{name} long" for name in names))


def triples() -> list[tuple[int, int, int]]:
    """20 triples of the eight positions such that any four positions hold one of them.

    Positions fall into three groups; taken are the triples inside a group and those
    with two in a group and one in the next.
    """
    groups = [range(0, 3), range(3, 6), range(6, 8)]
    out = [t for g in groups for t in combinations(g, 3)]
    for g, after in zip(groups, groups[1:] + groups[:1]):
        out += [tuple(sorted((*pair, x))) for pair in combinations(g, 2) for x in after]
    return out


def linked(one: np.ndarray, others: np.ndarray, max_bits: int) -> np.ndarray:
    """Which of the others link: enough shared positional bytes, then the bits."""
    differ = one ^ others
    shared = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    hit = shared >= BYTES - max_bits
    hit[hit] = np.bitwise_count(differ[hit]) <= max_bits
    return hit


def forest(values: np.ndarray, max_bits: int) -> list[np.ndarray]:
    """Links that join what is connected within one posting list: at most one fewer than
    its values. Each value is compared with those not reached yet, whose number shrinks."""
    left, out = values, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            hit = linked(one, left, max_bits)
            if hit.any():
                near = left[hit]
                out.append(np.column_stack([np.full(len(near), one), near]))
                queue.extend(near)
                left = left[~hit]
    return out


def byte_masks() -> list[int]:
    """The masks of the bytes of ``triples``; position 0 is the highest byte."""
    return [sum(255 << 8 * (BYTES - 1 - i) for i in t) for t in triples()]


def longer_masks(mask: int, parts: int = MAX_BITS + 1) -> list[int]:
    """mask with each of ``parts`` runs of the bits that it leaves open, from the highest on."""
    left = [b for b in reversed(range(64)) if not mask >> b & 1]
    cuts = [len(left) * i // parts for i in range(parts + 1)]
    return [mask | sum(1 << b for b in left[i:j]) for i, j in zip(cuts, cuts[1:]) if i < j]


LINK_SCHEMA = "a long, b long, mask long, part long"


def _lists(max_bits: int, longest: int):
    """mapInArrow function: rows (mask, part, fp) sorted by mask and part to links (a, b) and,
    for lists above ``longest``, to rows of the next round: fp as a, with mask and part."""

    def pack(links: list[np.ndarray], onward: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "mask", "part"]
        if links:
            both = np.concatenate(links).view(np.int64)
            none = pa.nulls(len(both), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), none, none], names)
        for mask, values in onward:
            for further in longer_masks(mask):
                m = np.full(len(values), further, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.nulls(len(values), pa.int64()), pa.array(m.view(np.int64)), pa.array((values & m).view(np.int64))], names)

    def changes(mask: np.ndarray, part: np.ndarray) -> np.ndarray:
        return np.flatnonzero((mask[1:] != mask[:-1]) | (part[1:] != part[:-1])) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []  # rows of the last list, which may go on in the next batch
        passed = None  # the list whose rows go on as they come
        for batch in batches:
            rows = tuple(batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
            if not len(rows[0]):
                continue
            starts = changes(*rows[:2])
            if passed == (rows[0][0], rows[1][0]):
                end = starts[0] if len(starts) else len(rows[0])
                yield from pack([], [(int(passed[0]), rows[2][:end])])
                if end == len(rows[0]):
                    continue
                rows, starts = tuple(x[end:] for x in rows), starts[1:] - end
            passed = None
            last = starts[-1] if len(starts) else 0
            if last or not kept or (kept[-1][0][0], kept[-1][1][0]) != (rows[0][0], rows[1][0]):
                kept.append(tuple(x[:last] for x in rows))
                yield from pack(*solve(kept))
                kept = []
            kept.append(tuple(x[last:] for x in rows))
            if sum(len(k[0]) for k in kept) > longest:
                yield from pack(*solve(kept))
                passed, kept = (rows[0][-1], rows[1][-1]), []
        if kept:
            yield from pack(*solve(kept))

    def solve(parts: list[tuple[np.ndarray, ...]]) -> tuple[list[np.ndarray], list[tuple[int, np.ndarray]]]:
        mask, part, values = (np.concatenate(x) for x in zip(*parts))
        found, onward = [], []
        if len(mask) < 2:
            return found, onward
        starts = np.r_[0, changes(mask, part)]
        sizes = np.diff(np.r_[starts, len(mask)])
        for gap in range(1, SMALL_LIST):  # all pairs of the short lists at once
            fits = (sizes > gap) & (sizes <= SMALL_LIST)
            if not fits.any():
                break
            counts = sizes[fits] - gap
            first = np.repeat(starts[fits], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            a, b = values[first], values[first + gap]
            hit = linked(a, b, max_bits)
            if hit.any():
                found.append(np.column_stack([a[hit], b[hit]]))
        for i in np.flatnonzero(sizes > SMALL_LIST):
            own = values[starts[i] : starts[i] + sizes[i]]
            if sizes[i] > longest:
                onward.append((int(mask[starts[i]]), own))
            else:
                found += forest(own, max_bits)
        return found, onward

    return run


def candidate_links(nodes: DataFrame, max_bits: int = MAX_BITS, longest: int = LONG_LIST) -> DataFrame:
    """Verified links (a, b) of distinct fingerprints (column fp), enough to connect all
    that are linked: a link that is left out joins two that other links join.

    One round, and one more for each time that a list is above ``longest``; rounds are
    written to the shared folder. Under eight open bits a list ends as it is.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the triples cover up to four differing bits")
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = [F.struct(F.lit(signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("part")) for m in byte_masks()]
    index, out = nodes.select(F.explode(F.array(*keys)).alias("k"), "fp").select("k.mask", "k.part", "fp"), []
    while True:
        dealt = index.repartition("mask", "part").sortWithinPartitions("mask", "part")
        found = written(dealt.mapInArrow(_lists(max_bits, max(longest, 256)), LINK_SCHEMA))
        out.append(found.where("b IS NOT NULL").select("a", "b"))
        index = found.where("b IS NULL").select("mask", "part", F.col("a").alias("fp"))
        if index.isEmpty():
            return reduce(DataFrame.unionByName, out)
        index = index.distinct()  # two masks may grow into the same one


def components_of(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, component, component_id) of the distinct fingerprints: component is the least of
    its fingerprints, component_id its least id, which several components may share."""
    rows = prints.count()
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), rows)
    groups = connected_components(candidate_links(nodes.select("fp"), max_bits))
    named = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    named = written(named, rows)
    least = written(named.groupBy("component").agg(F.min("least").alias("component_id")), rows)
    return written(named.join(least, "component").select("fp", "component", "component_id"), rows)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per input row.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated
    rows stay, in one component. Null ids stay and never are a component's id unless
    all its ids are null. An empty table gives no rows. Other columns are not read.
    """
    prints = written(fingerprints(docs, id_col, text_col))
    of = components_of(prints, max_bits).drop("component")
    return prints.join(of, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component: the one with the least id, of several the least text hash;
    of rows that agree in both any one.

    Ids may be null or repeated, so a row is found by its id and two hashes of its text:
    rows that agree in these are in one component. Rows with a null id stand for their
    component only where all its ids are null. Null and empty texts are one component, texts
    of any length are whole, and columns may have any names. An empty table gives no rows.

    The text is dealt out once; only where such rows repeat, once more. What stays grows with
    the documents, so it is never broadcast: a merge join at every size, whose hot keys Spark
    can split.
    """
    hashes = [F.xxhash64("text").alias("_h"), F.xxhash64(F.lit(1), "text").alias("_i")]
    prints = written(fingerprints(docs, "doc_id", "text", *hashes))
    of = components_of(prints).drop("component_id")
    rows = prints.join(of, "fp").groupBy("component", "doc_id", "_h", "_i").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_h", "_i", "n"))
    keep = written(rows.groupBy("component").agg(least.alias("row")).select(F.col("row.doc_id").alias("_id"), "row._h", "row._i", "row.n"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("key"), hashes[0].alias("hash"), hashes[1].alias("other"))
    same = keyed["key"].eqNullSafe(keep["_id"]) & (keyed["hash"] == keep["_h"]) & (keyed["other"] == keep["_i"])
    kept = keyed.join(keep.drop("n").hint("merge"), same, "left_semi")
    if not keep.where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["key", "hash", "other"])
    return kept.select("row.*")
