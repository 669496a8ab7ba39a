import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wearloom.llm import fim


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain(doc_id, text):
    """The contract with all units in a list."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, len(units), form, len(p), len(m), sha(out), sha(text)


def test_query_over_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(map(tuple, fim.query(docs).collect()))
    assert got == sorted(plain(r.doc_id, r.text) for r in docs.collect())
    assert {r[2] for r in got} >= {"psm", "spm"}


def test_edges(spark):
    rows = [
        (1, None, 1), (2, "", 1), (3, "one line", 1), (4, "\n", 1), (5, "\n\n\n", 1), (6, "a <M> b\nc\n", 1), (7, "line\n" * 200_000 + "end", 1), (7, "x\ny", 1), (7, "x\ny", 1),
        (None, "a\nb\nc", 1), (8, "<P\n>\n<", 1), (9, "é🙂\nü\n", 1), (10, "\r\n\x85 x\n", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").withColumnRenamed("n", "form")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, fim.query(df).collect()), key=key) == sorted((plain(d, t) for d, t, _ in rows), key=key)
    assert fim.query(df.limit(0)).count() == 0
    plan = fim.Plan()
    back = [(str(r.doc_id), fim.restored(r.output, r.form, plan)) for r in fim.transform(df).collect()]
    assert sorted(back) == sorted((str(d), t or "") for d, t, _ in rows)


@settings(max_examples=300, deadline=None)
@given(st.integers(-5, 10_000), st.text(alphabet=st.sampled_from("ab\n<>PSM "), max_size=40))
def test_any_text_comes_back(doc_id, text):
    plan = fim.Plan()
    c = fim.cut(doc_id, text, plan, re.compile(plan.unit))
    assert fim.restored(fim.output(text, c, plan), c.form, plan) == text
    assert (c.n, c.form) == plain(doc_id, text)[1:3]


def test_no_list_of_units_is_kept():
    import tracemalloc

    plan = fim.Plan()
    text = "x\n" * 2_000_000
    tracemalloc.start()
    fim.cut(5, text, plan, re.compile(plan.unit))
    assert tracemalloc.get_traced_memory()[1] < 1 << 20
    tracemalloc.stop()


def test_other_plans():
    plan = fim.Plan(unit=r"(?s).", rate=0)
    assert fim.cut(1, "abc", plan, re.compile(plan.unit)).form == "plain"
    plan = fim.Plan(unit=r"(?s).", spm=0)
    c = fim.cut(1, "abcdef", plan, re.compile(plan.unit))
    assert c.n == 6 and c.form == "psm" and fim.restored(fim.output("abcdef", c, plan), "psm", plan) == "abcdef"
    for bad in ({"prefix": "<S>"}, {"prefix": "x"}, {"prefix": "[P]"}, {"suffix": "<Pq", "prefix": "<P"}):
        with pytest.raises(ValueError):
            fim.Plan(**bad)
