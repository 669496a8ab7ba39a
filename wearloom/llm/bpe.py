"""Byte-level BPE: speculate by longest match, verify pairs, merge only what fails.

A text is cut at added tokens, then into pieces by the pattern. For each new piece the
longest vocabulary entry is taken from left to right. The proposal is the encoding
exactly if no two neighbours would have merged across their border; that is tested for
all different neighbours of a batch of pieces with array operations. Pieces with a failing
pair are merged exactly: short ones side by side in arrays, long ones by a heap. Encodings
of pieces are remembered, up to a bound.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearloom.llm.common import chunks

#: Fixed value: the pre-tokenizer's public pattern, white space and classes by property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pieces whose encodings a task remembers, and the longest piece that it remembers.
REMEMBERED = 400_000
REMEMBERED_CHARS = 64
#: Bytes of the longest piece that is merged side by side with others, and how many are at a time.
ABREAST_BYTES = 64
ABREAST = 1 << 13


def narrow_pattern() -> str:
    """PATTERN for ``re``, which is faster, and for texts without characters above U+FFFF.

    Classes are spelled out. Words come before contractions, which is the same: these begin otherwise."""
    plane = "".join(c for c in map(chr, range(0x10000)) if not "\ud800" <= c <= "\udfff")

    def members(property_: str) -> str:
        return "".join(f"{re.escape(run[0])}-{re.escape(run[-1])}" for run in regex.findall(rf"\p{{{property_}}}+", plane))

    letter, number, space = map(members, ("L", "N", "White_Space"))
    return rf" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"


def byte_alphabet() -> dict[str, int]:
    """The visible character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class Vocabulary:
    """Tables of a vocabulary file: its size bounds them. Built once per Python worker."""

    token_bytes: list[bytes]
    rank: np.ndarray  #: merge order of a token, -1 for single bytes
    left: np.ndarray
    right: np.ndarray
    pair_keys: np.ndarray  #: sorted left * size + right of every merge
    pair_ranks: np.ndarray
    merges: dict[tuple[int, int], tuple[int, int]]  #: pair to (rank, token)
    added: dict[str, int]
    ids: dict[bytes, int] = field(default_factory=dict)  #: entries that the proposal may use
    stems: dict[bytes, int] = field(default_factory=dict)  #: their prefixes, with the entry's id or -1

    @classmethod
    def parse(cls, text: str) -> Vocabulary:
        spec = json.loads(text)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *added.values()]) + 1
        token_bytes = [b""] * size
        for shown, i in vocab.items():
            token_bytes[i] = bytes(alphabet[c] for c in shown) if all(c in alphabet for c in shown) else shown.encode()
        for shown, i in added.items():
            token_bytes[i] = shown.encode()
        rank, left, right = (np.full(size, -1, np.int64) for _ in range(3))
        merges = {}
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = vocab[a + b]
            rank[whole], left[whole], right[whole] = n, vocab[a], vocab[b]
            merges[vocab[a], vocab[b]] = n, whole
        keys = np.array([a * size + b for a, b in merges], np.int64)
        order = np.argsort(keys)
        out = cls(token_bytes, rank, left, right, keys[order], np.array([r for r, _ in merges.values()], np.int64)[order], merges, added)
        single = {b: vocab[c] for c, b in alphabet.items() if c in vocab}
        out.single = single
        out.blank = -((size + 1) ** 2)  # merges with nothing, for such keys are negative
        out.single_ids = np.array([single.get(b, out.blank) for b in range(256)], np.int64)
        out.made = np.zeros(len(spec["model"]["merges"]), np.int64)
        out.made[[r for r, _ in merges.values()]] = [whole for _, whole in merges.values()]
        entries = [i for shown, i in vocab.items() if shown not in added]
        merged = out.merge_all([token_bytes[i] for i in entries])
        out.ids = {token_bytes[i]: i for i, ids in zip(entries, merged) if len(token_bytes[i]) == 1 or ids == np.array([i], "<u4").tobytes()}
        for data in out.ids:
            out.stems.update(dict.fromkeys((data[:n] for n in range(1, len(data))), -1))
        out.stems |= out.ids
        return out

    def ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Merge order of pairs x, y; more than any where no merge has the pair."""
        keys = x * len(self.token_bytes) + y
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], len(self.made) + 1)

    def merge(self, data: bytes) -> list[int]:
        """Exact merging: always the lowest merge, of equal ones the leftmost."""
        ids = [self.single[b] for b in data]
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*m, i) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heap = [(r, i, whole, ids[i], ids[i + 1]) for r, whole, i in heap]
        heapq.heapify(heap)
        while heap:
            _, i, whole, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = whole, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := self.merges.get((whole, ids[k])):
                    heapq.heappush(heap, (m[0], i, m[1], whole, ids[k]))
            if (h := before[i]) >= 0 and (m := self.merges.get((ids[h], whole))):
                heapq.heappush(heap, (m[0], h, m[1], ids[h], whole))
        return [x for x in ids if x >= 0]

    def merge_abreast(self, data: list[bytes]) -> list[bytes]:
        """Packed ids of pieces of up to ABREAST_BYTES bytes, a column each, merged as by ``merge``.

        Every round makes each column's lowest merge, of equal ones the upper. The row below the
        longest piece stays blank; places before the first and after the last lead there."""
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        high = int(lengths.max())
        places = np.arange(high + 1)[:, None]
        held = places < lengths
        ids = np.full(held.shape, self.blank)
        ids.T[held.T] = self.single_ids[np.frombuffer(b"".join(data), np.uint8)]
        after = np.where(places + 1 < lengths, places + 1, high)
        before = np.repeat(places - 1, len(data), axis=1)
        none = len(self.made) * ABREAST_BYTES
        order = np.full(held.shape, 2 * none)
        order[:-1] = self.ranks(ids[:-1], ids[1:]) * ABREAST_BYTES + places[:-1]
        while True:
            lowest = order.min(axis=0)
            live = np.flatnonzero(lowest < none)
            if not len(live):
                break
            rank, i = np.divmod(lowest[live], ABREAST_BYTES)
            h, j, whole = before[i, live], after[i, live], self.made[rank]
            k = after[j, live]
            ids[i, live], ids[j, live], order[j, live] = whole, self.blank, 2 * none
            after[i, live], before[k, live] = k, i
            order[i, live] = self.ranks(whole, ids[k, live]) * ABREAST_BYTES + i
            order[h, live] = self.ranks(ids[h, live], whole) * ABREAST_BYTES + h
        left = ids >= 0
        return packed(ids.T[left.T], left.sum(axis=0))

    def merge_all(self, data: list[bytes]) -> list[bytes]:
        """Packed ids of pieces by exact merging, those of like length together."""
        out = [np.array(self.merge(d), "<u4").tobytes() if len(d) > ABREAST_BYTES else b"" for d in data]
        short = sorted((i for i, d in enumerate(data) if 0 < len(d) <= ABREAST_BYTES), key=lambda i: len(data[i]))
        for at in range(0, len(short), ABREAST):
            some = short[at : at + ABREAST]
            for i, ids in zip(some, self.merge_abreast([data[i] for i in some])):
                out[i] = ids
        return out

    def propose(self, data: bytes, out: list[int]) -> None:
        """Longest entry from left to right, appended to out."""
        at, n = 0, len(data)
        stems = self.stems
        while at < n:
            found, stop, end = None, at + 1, at + 1
            while end <= n and (entry := stems.get(data[at:end])) is not None:
                if entry >= 0:
                    found, stop = entry, end
                end += 1
            out.append(found)
            at = stop

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether neighbours a, b stay apart, for all pairs at once.

        Walk back through the merges that built both: x is the token at a's right edge,
        y the one at b's left edge, and each lives until its parent's merge. If x and y
        can merge before either parent does, the pair is not an encoding. Of equal
        merges the left one comes first.
        """
        never = len(self.made) + 1
        x, y = a.copy(), b.copy()
        x_ends, y_ends = np.full(len(a), never), np.full(len(a), never)
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            rank = self.ranks(x, y)
            clash = (rank < x_ends) & (rank <= y_ends) & (rank < never)
            ok[live[clash]] = False
            rx, ry = self.rank[x], self.rank[y]
            more = ~clash & ((rx >= 0) | (ry >= 0))
            live, x, y, x_ends, y_ends, rx, ry = (v[more] for v in (live, x, y, x_ends, y_ends, rx, ry))
            back = rx > ry  # the later merge is undone first; of equal ones the right one
            x_ends, y_ends = np.where(back, rx, x_ends), np.where(back, y_ends, ry)
            x, y = np.where(back, self.right[x], x), np.where(back, y, self.left[y])
        return ok

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Packed ids (little-endian unsigned 32 bits) of each piece."""
        data = [p.encode("utf-8") for p in pieces]
        proposed, ends = [], []  # one list for all pieces: lists of their own cost garbage collection
        for d in data:
            if d in self.ids:
                proposed.append(self.ids[d])
            else:
                self.propose(d, proposed)
            ends.append(len(proposed))
        flat, counts = np.array(proposed, np.int64), np.diff(np.array(ends, np.int64), prepend=0)
        owner = np.repeat(np.arange(len(data)), counts)
        within = np.flatnonzero(owner[1:] == owner[:-1])
        size = len(self.token_bytes)
        pairs, which = np.unique(flat[within] * size + flat[within + 1], return_inverse=True)
        bad = within[~self.compatible(pairs // size, pairs % size)[which]]
        out = packed(flat, counts)
        failed = np.unique(owner[bad]).tolist()
        for i, ids in zip(failed, self.merge_all([data[i] for i in failed])):
            out[i] = ids
        return out


def packed(flat: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Ids as little-endian unsigned 32-bit integers, cut into runs of ``counts`` ids."""
    data = flat.astype("<u4").tobytes()
    ends = (4 * np.cumsum(counts)).tolist()
    return [data[start:end] for start, end in zip([0, *ends], ends)]


class Coder:
    """Encodes and decodes texts with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, bytes] = {}
        self.narrow, self.wide = re.compile(narrow_pattern()).findall, regex.compile(PATTERN).findall
        added = sorted(vocabulary.added, key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None

    def pieces(self, text: str) -> list[str]:
        narrow = len(text.encode("utf-16-le")) == 2 * len(text)
        return self.narrow(text) if narrow else self.wide(text)

    def cut(self, text: str) -> list[str]:
        if not self.added or not self.added.search(text):
            return self.pieces(text)
        out, at = [], 0
        for found in self.added.finditer(text):
            out += [*self.pieces(text[at : found.start()]), found.group()]
            at = found.end()
        return out + self.pieces(text[at:])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        known = self.known
        cut = [self.cut(t) for t in texts]
        needed = set().union(*cut)
        new = needed.difference(known)
        if len(known) + len(new) > REMEMBERED:
            kept = {p: known[p] for p in needed if p in known}
            known.clear()
            known |= kept
        known.update({s: np.array([i], "<u4").tobytes() for s, i in self.vocabulary.added.items()})
        new = [p for p in new if p not in self.vocabulary.added]
        known.update(zip(new, self.vocabulary.encode_pieces(new)))
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in cut]
        for p in new:
            if len(p) > REMEMBERED_CHARS:
                del known[p]
        return out

    def decode(self, packed: bytes) -> str:
        """Text of packed ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        token_bytes = self.vocabulary.token_bytes
        return b"".join(map(token_bytes.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


_coders: dict[str, Coder] = {}


def coder(spec: str) -> Coder:
    """The coder of a vocabulary file's text, one per Python worker."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _coders:
        _coders[key] = Coder(Vocabulary.parse(spec))
    return _coders[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _shared_spec(df: DataFrame, path: str | None):
    """The vocabulary file's text as a broadcast; the file's size bounds it."""
    with open(path or default_path(), encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary) for every row: ids as little-endian unsigned 32-bit integers."""
    spec = _shared_spec(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(spec.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at, some in chunks(texts):
                ids = own.encode([t or "" for t in some])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of what ``encode`` returned."""
    spec = _shared_spec(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(spec.value)
        for batch in batches:
            texts = [own.decode(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_and_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): one row per input row.

    Null text counts as empty: no ids, digests of nothing. Null ids stay null, repeated rows stay
    and are encoded alike. Very long texts are encoded whole, a piece without a break by one
    heap as well; equal merges go to the leftmost. The vocabulary file is a parameter. Other
    columns are not read, whatever their names. An empty table gives no rows.
    """
    spec = _shared_spec(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(spec.value)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at, some in chunks(texts):
                ids = own.encode([t or "" for t in some])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(some)),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([sha(x) for x in ids]),
                        pa.array([sha(own.decode(x).encode("utf-8")) for x in ids]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
