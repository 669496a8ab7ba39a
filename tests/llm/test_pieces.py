import hashlib
import struct
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wearloom.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())


@pytest.fixture(scope="module")
def own():
    with open(pieces.default_path(), "rb") as f:
        return pieces.coder(f.read())


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


CASES = [
    "", " ", "  ", "\n", "\n\n x", " \n \n", "don't stop", "aaaa" * 50, "a" * 5000, "x" * 70 + " y", "Die Größe\tß", "<s> </s> <unk> <0x0A>", "12 345 6,7", "日本語 テキスト", "🙂🙂 é", "a▁b",
    "▁▁x", "\x00a\x00", "   trailing   ", "ing" * 40 + " ed", "﻿bom", "á‍", "\U0010ffff", "=" * 300,
]


def test_cases_equal_the_library(own, library):
    got, _ = own.encode(CASES)
    for text, packed in zip(CASES, got):
        expected = library.encode(text)
        assert ids(packed) == expected, text[:40]
        assert own.decode(packed) == library.decode(expected)


def test_every_character_of_the_plane(own, library):
    chars = [c for c in map(chr, range(0x10000)) if unicodedata.category(c) not in ("Cs", "Cn")]
    texts = [f"a{c}{c}1 {c}b{c} " for c in chars]
    got, new = own.encode(texts)
    wrong = [hex(ord(c)) for c, packed, e in zip(chars, got, library.encode(texts)) if ids(packed) != e]
    assert not wrong, wrong[:20]
    assert not own.differing(new)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeinrst 'éß\n1!▁"), max_size=60) | st.text(max_size=40))
def test_any_text(own, library, text):
    packed = own.encode([text])[0][0]
    assert ids(packed) == library.encode(text)
    assert own.decode(packed) == library.decode(ids(packed))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31999) | st.integers(0, 300), max_size=12))
def test_any_ids_decode_like_the_library(own, library, some):
    assert own.decode(np.array(some, "<u4").tobytes()) == library.decode(some)


def test_a_wrong_chunk_is_noticed(library):
    with open(pieces.default_path(), "rb") as f:
        own = pieces.Pieces(f.read())
    own.merges = {p: x for p, x in own.merges.items() if p != "▁the"}
    _, new = own.encode(["the cat", "a cat"])
    assert own.differing(new) == {"▁the"}


def test_memory_is_bounded_and_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    with open(pieces.default_path(), "rb") as f:
        own = pieces.Pieces(f.read())
    for i in range(10):
        texts = [f"w{i}x{k} the {k}" for k in range(8)]
        got, new = own.encode(texts)
        assert [ids(x) for x in got] == library.encode(texts)
        own.forget_long(new)
        assert len(own.known) <= 20 + len(new)


@pytest.mark.parametrize("check", ["chunks", "texts", None])
def test_query(spark, library, check):
    rows = [(1, "Then the ingred.", "x"), (1, "Then the ingred.", "x"), (2, None, "y"), (3, "", None), (None, "a b", "z"), (4, "long word " * 30_000 + "x" * 20_000, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = pieces.encode_and_decode(df, check=check).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def expected(d, t):
        i = library.encode(t or "", add_bos=True, add_eos=True)
        return str(d), len(i), sha(struct.pack(f"<{len(i)}I", *i)), sha(library.decode(i).encode()), True

    assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(expected(d, t) for d, t, _ in rows)
    assert pieces.encode_and_decode(df.limit(0), check=check).count() == 0
    back = pieces.decode(pieces.encode(df)).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(d), t or "") for d, t, _ in rows)


def test_query_over_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in pieces.encode_and_decode(docs).collect()}
    for r in docs.collect():
        i = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(i), hashlib.sha256(struct.pack(f"<{len(i)}I", *i)).hexdigest())
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(i).encode()).hexdigest()
