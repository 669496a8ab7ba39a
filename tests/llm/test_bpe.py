import hashlib
import random
import struct
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wearloom.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(bpe.default_path())
    t.no_padding()
    t.no_truncation()
    return t


@pytest.fixture(scope="module")
def own():
    with open(bpe.default_path(), encoding="utf-8") as f:
        return bpe.coder(f.read())


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


CASES = [
    "", " ", "\n\n  x", "don't we'll I'm", "aaaa" * 50, "a" * 5000, "word " * 200_000, "é" * 100_000, "Éauouaux ché élle", "Die Größe\tß",
    "x<|endoftext|>y <|endoftext|>", "<|endoftext|>", "12 345 6,7", "日本語 テキスト", "🙂🙂 é", "\x1c\x1d a\x85b", "=" * 300,
    "   trailing   ", "ingingedtion" * 40, "﻿bom", "a b",
]


def test_cases_equal_the_library(own, library):
    for text, packed in zip(CASES, own.encode(CASES)):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids(packed) == expected, text[:40]
        assert own.decode(packed) == library.decode(expected, skip_special_tokens=False)


def test_every_character_of_the_plane(own, library):
    chars = [c for c in map(chr, range(0x10000)) if unicodedata.category(c) not in ("Cs", "Cn")]
    texts = [f"a{c}{c}1 {c}b{c} " for c in chars]
    wrong = [
        hex(ord(c))
        for c, packed, e in zip(chars, own.encode(texts), library.encode_batch(texts, add_special_tokens=False))
        if ids(packed) != e.ids
    ]
    assert not wrong, wrong[:20]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeinrst 'éß\n1!"), max_size=60) | st.text(max_size=40))
def test_any_text(own, library, text):
    assert ids(own.encode([text])[0]) == library.encode(text, add_special_tokens=False).ids


def test_query(spark, library):
    rows = [(1, "Then the ingred.", "x"), (1, "Then the ingred.", "x"), (2, None, "y"), (3, "", None), (None, "a b", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode_and_decode(df).collect()
    assert len(got) == 5
    expected = sorted(
        (str(d), len(i := library.encode(t or "", add_special_tokens=False).ids), hashlib.sha256(struct.pack(f"<{len(i)}I", *i)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        for d, t, _ in rows
    )
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == expected
    assert bpe.encode_and_decode(df.limit(0)).count() == 0
    back = bpe.decode(bpe.encode(df)).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(d), t or "") for d, t, _ in rows)


def fresh_words(n, seed=7):
    """Different made-up words, many of which the longest match gets wrong."""
    draw = random.Random(seed)
    parts = ["ing", "ed", "tion", "th", "er", "ou", "sch", "en", "é", "ñ", "lo", "que", "st", "a", "r"]
    return sorted({" " + "".join(draw.choices(parts, k=draw.randint(3, 6))) for _ in range(n)})


def test_short_pieces_whose_proposal_fails_do_not_go_through_the_heap(own, library, monkeypatch):
    words = fresh_words(3000)
    alone = []
    heap = own.vocabulary.merge
    monkeypatch.setattr(own.vocabulary, "merge", lambda data: alone.append(data) or heap(data))
    got = own.vocabulary.encode_pieces([*words, "a" * 64, "ab" * 32, "a" * 65])
    assert {len(d) for d in alone} <= {65}
    expected = library.encode_batch([*words, "a" * 64, "ab" * 32, "a" * 65], add_special_tokens=False)
    assert [ids(p) for p in got] == [e.ids for e in expected]
    assert sum(proposal(own, w) != e.ids for w, e in zip(words, expected)) > 500


def proposal(own, word):
    out = []
    own.vocabulary.propose(word.encode(), out)
    return out


def test_pieces_in_use_stay_when_the_memory_is_full(monkeypatch):
    with open(bpe.default_path(), encoding="utf-8") as f:
        coder = bpe.Coder(bpe.Vocabulary.parse(f.read()))
    words = fresh_words(400)
    used, first, then = words[:50], words[50:150], words[150:250]
    monkeypatch.setattr(bpe, "REMEMBERED", 200)
    new = []
    encode = coder.vocabulary.encode_pieces
    monkeypatch.setattr(coder.vocabulary, "encode_pieces", lambda pieces: new.extend(pieces) or encode(pieces))
    coder.encode(["".join(used + first)])
    coder.encode(["".join(used + then)])
    assert sorted(new) == sorted(used + first + then)
    assert len(coder.known) <= 200


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=70) | st.sampled_from([b"aaaa", b" the", b"ingingedtion", "é".encode() * 32]), max_size=40))
def test_merging_side_by_side_equals_the_heap(own, data):
    assert [ids(p) for p in own.vocabulary.merge_all(data)] == [own.vocabulary.merge(d) for d in data]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aé日1²Ⅷ '\n\t\x1c\x85\xa0\u3000!_-]^sreld\u0301\ud7ff\ufeff"), max_size=40) | st.text(st.characters(max_codepoint=0xFFFF, exclude_categories=["Cs"]), max_size=40))
def test_both_patterns_cut_alike(own, text):
    assert own.narrow(text) == own.wide(text)
