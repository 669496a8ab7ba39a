"""SentencePiece encoding of merge-type vocabularies by an agenda of adjacent symbol pairs.

A text's characters are its first symbols. The agenda holds every two neighbours that make a
piece, best score first and of equal scores the leftmost; the best are merged, and the pairs
that the new symbol makes with its neighbours come onto the agenda, until it is empty. Symbols
that are no piece fall back to their bytes.

No merge goes across two neighbouring characters that no piece holds side by side. That is
looked up in the vocabulary when it is read: where no piece has a space mark after another
character, texts are cut before such marks; around line ends where no piece holds one; and
between letters and others where none holds both. Chunks are encoded apart and their ids remembered, up to a bound. Each Arrow batch's new
chunks, or its whole texts, are checked against the sentencepiece library.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearloom.llm.common import chunks

#: Fixed value: the character that stands for a space in pieces.
SPACE = "▁"
#: Chunks whose ids a task remembers, and the longest chunk that it remembers.
REMEMBERED = 800_000
REMEMBERED_CHARS = 64
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Pieces:
    """Tables of a model file and the chunks met so far; one per Python worker."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        trainer, normalizer = proto.trainer_spec, proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if trainer.model_type != trainer.BPE or trainer.treat_whitespace_as_suffix:
            raise ValueError("only merge-type vocabularies with spaces as prefixes are encoded")
        if normalizer.precompiled_charsmap or normalizer.remove_extra_whitespaces or not normalizer.escape_whitespaces:
            raise ValueError("only models without normalization are encoded")
        if not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE} or (trainer.byte_fallback and sum(p.type == BYTE for p in proto.pieces) != 256):
            raise ValueError("models with user-defined, unused or missing byte pieces are not encoded")
        self.prefix = SPACE if normalizer.add_dummy_prefix else ""
        self.merges = {p.piece: (-p.score, i) for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.unknown = None if trainer.byte_fallback else unknown
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.begin, self.end = (next(i for i, p in enumerate(proto.pieces) if p.piece == x) for x in (trainer.bos_piece, trainer.eos_piece))
        surface = {NORMAL: lambda p: p.piece.replace(SPACE, " ").encode(), UNKNOWN: lambda _: trainer.unk_surface.encode(), CONTROL: lambda _: b"", BYTE: lambda p: bytes([int(p.piece[3:5], 16)])}
        self.surface = [surface[p.type](p) for p in proto.pieces]
        self.control = {i for i, p in enumerate(proto.pieces) if p.type == CONTROL}
        self.spaced = {i for i, p in enumerate(proto.pieces) if p.type == NORMAL and p.piece.startswith(SPACE)}
        self.cut = self._cutter()
        self.library = SentencePieceProcessor(model_proto=model)
        self.known: dict[str, bytes] = {}

    def _cutter(self):
        """Chunks of a text, cut only where no piece goes across."""
        lines = "" if any("\n" in p and len(p) > 1 for p in self.merges) else "\n"
        self.lead = lines  # a character at which every text may be cut
        pairs = {(a, b) for p in self.merges for a, b in zip(p, p[1:])}
        if any(b == SPACE != a for a, b in pairs):
            return re.compile(f"[^{lines}]+|{lines}").findall if lines else lambda text: [text] if text else []
        letter, ends = re.compile(r"[^\W\d_]").match, f"|{lines}" if lines else ""
        mixed = {c for a, b in pairs if SPACE not in (a, b) and bool(letter(a)) != bool(letter(b)) for c in (a, b) if letter(c)}
        letters = r"\W\d_" + re.escape("".join(sorted(mixed)))  # all but these; letters beside others in a piece are none
        if any(SPACE not in (a, b) and bool(re.match(f"[^{letters}]", a)) != bool(re.match(f"[^{letters}]", b)) for a, b in pairs):
            return re.compile(f"{SPACE}*[^{SPACE}{lines}]+|{SPACE}+{ends}").findall
        others = f"(?:(?![^{letters}])[^{SPACE}{lines}])+"
        return re.compile(f"{SPACE}*[^{letters}]+|{SPACE}*{others}|{SPACE}+{ends}").findall

    def symbols(self, chunk: str) -> list[str]:
        """What is left of a chunk's characters when the agenda is empty."""
        merges = self.merges.get
        parts: list[str | None] = list(chunk)
        n = len(parts)
        agenda = []
        for i in range(n - 1):
            whole = parts[i] + parts[i + 1]
            if found := merges(whole):
                agenda.append((found[0], i, whole))
        if not agenda:
            return parts
        heapq.heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            _, i, whole = heapq.heappop(agenda)
            left = parts[i]
            if left is None or (j := after[i]) >= n or left + parts[j] != whole:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = whole, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := merges(wider := whole + parts[k]):
                    heapq.heappush(agenda, (found[0], i, wider))
            if (h := before[i]) >= 0 and (found := merges(wider := parts[h] + whole)):
                heapq.heappush(agenda, (found[0], h, wider))
        return [p for p in parts if p is not None]

    def chunk_ids(self, chunk: str) -> list[int]:
        out, in_unknown = [], False
        for symbol in self.symbols(chunk):
            found = self.merges.get(symbol)
            if found:
                out.append(found[1])
            elif self.unknown is None:
                out += [self.byte_ids[b] for b in symbol.encode("utf-8")]
            elif not in_unknown:
                out.append(self.unknown)
            in_unknown = not found
        return out

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> tuple[list[bytes], set[str]]:
        """(packed ids of each text without begin and end, the chunks that were new)."""
        known = self.known
        cut = [self.cut(self.prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        met = set().union(*cut)
        new = met.difference(known)
        if len(known) + len(new) > REMEMBERED:  # what these texts use stays
            self.known = known = {c: known[c] for c in met.intersection(known)}
        for chunk in new:
            known[chunk] = self.pack(self.chunk_ids(chunk))
        return [b"".join(map(known.__getitem__, own)) for own in cut], new

    def forget_long(self, new: set[str]) -> None:
        for chunk in new:
            if len(chunk) > REMEMBERED_CHARS:
                del self.known[chunk]

    def differing(self, new: set[str]) -> set[str]:
        """The chunks that the library encodes in another way. It puts its prefix before a
        line end, where the text is cut, so that the chunk itself comes as it stands."""
        own = list(new)
        if not self.lead:
            return set()
        head = len(self.library.encode(self.lead))
        theirs = self.library.encode([self.lead + c.replace(SPACE, " ") for c in own], num_threads=1)
        return {c for c, ids in zip(own, theirs) if self.known[c] != self.pack(ids[head:])}

    def decode(self, packed: bytes) -> str:
        """Text of packed ids; the prefix's space goes, bytes that are no UTF-8 become U+FFFD each."""
        ids = np.frombuffer(packed, "<u4").tolist()
        first = next((i for i in ids if i not in self.control), None)
        data = b"".join(map(self.surface.__getitem__, ids))
        if self.prefix and first in self.spaced:
            data = data[1:]
        return data.decode("utf-8", "each_byte")


_coders: dict[bytes, Pieces] = {}


def coder(model: bytes) -> Pieces:
    """The coder of a model file's bytes, one per Python worker."""
    key = hashlib.sha256(model).digest()
    if key not in _coders:
        _coders[key] = Pieces(model)
    return _coders[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _shared_model(df: DataFrame, path: str | None):
    """The model file as a broadcast; the file's size bounds it."""
    with open(path or default_path(), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _encoded(own: Pieces, batch: pa.RecordBatch, check: str | None) -> Iterator[tuple[pa.Array, list[bytes], list[bool]]]:
    """(ids of rows, packed ids with begin and end, whether the library agrees), some rows at a time."""
    begin, end = own.pack([own.begin]), own.pack([own.end])
    for at, some in chunks(batch.column(1).to_pylist()):
        texts = [t or "" for t in some]
        inner, new = own.encode(texts)
        ids = [begin + x + end for x in inner]
        agrees = [True] * len(texts)
        if check == "texts" or check and not own.lead:
            agrees = [own.pack(theirs) == x for theirs, x in zip(own.library.encode(texts, add_bos=True, add_eos=True, num_threads=1), ids)]
        elif check and (differing := own.differing(new)):
            agrees = [differing.isdisjoint(own.cut(own.prefix + t.replace(" ", SPACE))) for t in texts]
            for chunk in differing:  # seen as new again wherever it comes
                del own.known[chunk]
        own.forget_long(new.intersection(own.known))
        yield batch.column(0).slice(at, len(some)), ids, agrees


def _selected(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", check: str | None = "chunks") -> DataFrame:
    """(doc_id, ids binary, library_agrees) for every row: ids as little-endian unsigned 32-bit
    integers with begin and end. Edge cases as in ``encode_and_decode``."""
    model = _shared_model(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model.value)
        for batch in batches:
            for keys, ids, agrees in _encoded(own, batch, check):
                yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.binary()), pa.array(agrees)], ["doc_id", "ids", "library_agrees"])

    return _selected(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, library_agrees boolean")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of what ``encode`` returned."""
    model = _shared_model(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x.as_py()) for x in batch.column(1)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_and_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", check: str | None = "chunks") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, library_agrees): one row per input row.

    Null text counts as empty: begin and end only. Null ids stay null, repeated rows stay and
    are encoded alike. Very long texts are encoded whole, a chunk without spaces by one agenda
    as well. Other columns are not read, whatever their names. An empty table gives no rows.
    Equal scores go to the leftmost pair. No row is dealt out, so no key can be hot.

    check: "chunks" has the library encode each chunk when a task first meets it, "texts" every
    whole text, None nothing. library_agrees is false where it found other ids; the row's own
    are those of the agenda.
    """
    model = _shared_model(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model.value)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            for keys, ids, agrees in _encoded(own, batch, check):
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x) for x in ids]), pa.array([sha(own.decode(x).encode("utf-8")) for x in ids]), pa.array(agrees)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "library_agrees"],
                )

    return _selected(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, library_agrees boolean")
