"""Fill-in-middle: a text is cut at two of its units into prefix, middle and suffix.

Constant memory: a first pass over the text's matches counts the units, a second advances a
lazy iterator of matches to the two ranks where the middle begins and ends. No list of units
or of places is ever kept; a task holds one text and its output.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Plan:
    """Marks, unit pattern and shares of a transformation. Every text is the run of its units.

    Marks have one first character that is nowhere else in them, so none can arise where a
    text meets a mark.
    """

    unit: str = r"[^\n]*\n|[^\n]+"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: str = "7:"
    rate: int = 100  #: of 100 texts, those that are transformed
    spm: int = 50  #: of 100 transformed texts, those with the suffix first

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) < 3 or len({m[:1] for m in marks}) != 1 or any(len(m) < 2 or m[0] in m[1:] for m in marks):
            raise ValueError(f"not usable as marks: {marks}")
        if any(a != b and a.startswith(b) for a in marks for b in marks):
            raise ValueError(f"a mark begins with another: {marks}")


@dataclass(frozen=True)
class Cut:
    """Units of a text, its form (plain, psm or spm) and the places where the middle begins and ends."""

    n: int
    form: str
    begin: int
    end: int


def draws(doc_id: int | None, seed: str) -> list[int]:
    """Four repeatable numbers of 32 bits for an id; a null id is written as nothing."""
    digest = hashlib.sha256(f"{seed}{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def place_after(text: str, unit: re.Pattern, low: int, high: int) -> tuple[int, int]:
    """Where the units of ranks low and high (from 1; 0: the text's start) end, low <= high."""
    matches = unit.finditer(text)
    begin = next(islice(matches, low - 1, None)).end() if low else 0
    return begin, next(islice(matches, high - low - 1, None)).end() if high > low else begin


def cut(doc_id: int | None, text: str, plan: Plan, unit: re.Pattern) -> Cut:
    n = sum(1 for _ in unit.finditer(text))
    h1, h2, h3, h4 = draws(doc_id, plan.seed)
    if not text or h3 % 100 >= plan.rate or any(m in text for m in (plan.prefix, plan.suffix, plan.middle)):
        return Cut(n, "plain", 0, 0)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    return Cut(n, "spm" if h4 % 100 < plan.spm else "psm", *place_after(text, unit, low, high))


def output(text: str, c: Cut, plan: Plan) -> str:
    if c.form == "plain":
        return text
    first, last, middle = text[: c.begin], text[c.end :], text[c.begin : c.end]
    if c.form == "psm":
        return f"{plan.prefix}{first}{plan.suffix}{last}{plan.middle}{middle}"
    return f"{plan.suffix}{last}{plan.prefix}{first}{plan.middle}{middle}"


def restored(out: str, form: str, plan: Plan) -> str:
    """The text that ``output`` was made of, from the output and its form alone."""
    if form == "plain":
        return out
    one, two = (plan.prefix, plan.suffix) if form == "psm" else (plan.suffix, plan.prefix)
    second = out.index(two, len(one))
    third = out.index(plan.middle, second + len(two))
    a, b, middle = out[len(one) : second], out[second + len(two) : third], out[third + len(plan.middle) :]
    return f"{a}{middle}{b}" if form == "psm" else f"{b}{middle}{a}"


def _mapped(docs: DataFrame, plan: Plan, id_col: str, text_col: str, row, schema: str) -> DataFrame:
    """``row(doc_id, text, cut, output)`` of every row, one text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = re.compile(plan.unit)
        for batch in batches:
            rows = []
            size = 0
            for i, t in zip(batch.column(0), batch.column(1)):
                doc_id, text = i.as_py(), t.as_py() or ""
                c = cut(doc_id, text, plan, unit)
                rows.append(row(doc_id, text, c, output(text, c, plan)))
                size += len(text)
                if size > 1 << 22:  # outputs held at a time
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def transform(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, output) of every row, where it lies; edge cases as in ``query``."""
    return _mapped(docs, plan, id_col, text_col, lambda i, text, c, out: (i, c.n, c.form, out), "doc_id long, n long, form string, output string")


def query(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row.

    Null texts count as empty, and empty texts are plain with no units. Null ids are drawn for
    as an id written as nothing. Very long texts are cut whole, with no more memory than the
    text and its output. Repeated rows stay and are cut alike; two equal ranks make an empty
    middle. Columns of docs besides the two may have any names and are not read. An empty
    table gives no rows. No row is dealt out, so no key can be hot.
    """

    def row(i, text, c, out):
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        plain = c.form == "plain"
        return (i, c.n, c.form, None if plain else c.begin, None if plain else c.end - c.begin, sha(out), sha(restored(out, c.form, plan)))

    return _mapped(docs, plan, id_col, text_col, row, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
  ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
n AS (SELECT *, CASE WHEN text = '' THEN 0 WHEN parts[-1] = '' THEN len(parts) - 1 ELSE len(parts) END::BIGINT AS n FROM h),
r AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, CASE WHEN low = 0 THEN 0 ELSE least(length(array_to_string(parts[1:low], chr(10))) + 1, length(text)) END::BIGINT AS b,
  CASE WHEN high = 0 THEN 0 ELSE least(length(array_to_string(parts[1:high], chr(10))) + 1, length(text)) END::BIGINT AS e FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN b END AS prefix_chars, CASE WHEN form <> 'plain' THEN e - b END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || substr(text, 1, b) || '<S>' || substr(text, e + 1) || '<M>' || substr(text, b + 1, e - b)
    ELSE '<S>' || substr(text, e + 1) || '<P>' || substr(text, 1, b) || '<M>' || substr(text, b + 1, e - b) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
