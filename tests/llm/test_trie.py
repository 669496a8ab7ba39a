import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wearloom.llm import trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def nodes_of(sequences):
    """The contract's rows for {conv_id: list of (key, chars)}, with every prefix in a dict."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) if children[p] else 1
        saved[p] = sum(saved[x] for x in children[p]) + (len(members[p]) - 1) * (p[-1][1] if p else 0)
    ends = {p: ",".join(map(str, sorted(c for c in cs if len(sequences[c]) == len(p)))) for p, cs in members.items()}
    return sorted(
        ((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, cs in members.items()),
        key=str,
    )


def plain(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(ts)] for c, ts in turns.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c / 100) * 100
        out[c] = [((r, t), len(t)) for r, t in own.get(c - base, [])[:h] + ts[h:]]
    return nodes_of(out)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def swept(rows, cuts, fan):
    """Sorted (key, chars, conv_id) swept in ranges and stitched fan at a time, without Spark."""
    out, parts = [], []
    for place, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        sweep = trie.Sweep(place)
        for r in rows[a:b]:
            sweep.row(*r)
        sweep.finish(place)
        out += sweep.out
    level = 0
    items = [r for r in out if r["kind"] == "item"]
    while items:
        level += 1
        last = max(r["part"] for r in items)
        made = []
        for group in sorted({r["part"] // fan for r in items}):
            sweep = trie.Sweep((level << 40) + group, last < fan)
            for r in sorted((r for r in items if r["part"] // fan == group), key=lambda r: (r["part"], r["seq"])):
                sweep.item(r["key"], r["chars"], r["from_depth"], r["values"])
            sweep.finish(group)
            made += sweep.out
        out += made
        items = [r for r in made if r["kind"] == "item"]
    nodes = [r for r in out if r["kind"] == "node"]
    by_id = {r["node_id"]: r for r in nodes if r.get("node_id")}
    ids = defaultdict(list)
    for r in sorted((r for r in out if r["kind"] == "chunk"), key=lambda r: (r["part"], r["seq"])):
        ids[r["node_id"]].append(r["ids"])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return sorted(
        (
            (
                r["conv_id"], r["depth"], by_id[r["parent_id"]]["conv_id"] if r.get("parent_id") else r.get("parent_conv_id"), r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"],
                sha(",".join(ids[r["node_id"]])) if r["chunked"] else r["ends"] or sha(""),
            )
            for r in nodes
        ),
        key=str,
    )


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=6), min_size=1, max_size=40), st.data())
def test_any_ranges_stitch_to_the_same_nodes(sequences, data):
    held, chunk = trie.HELD, trie.CHUNK_IDS
    trie.HELD, trie.CHUNK_IDS = data.draw(st.sampled_from([0, 3, 1000])), data.draw(st.sampled_from([2, 1000]))
    try:
        unit = lambda x: hashlib.sha256(str(x).encode()).digest()
        rows = sorted((b"".join(map(unit, s)), [x + 1 for x in s], c * 7 % 41) for c, s in enumerate(sequences))
        cuts = sorted(data.draw(st.sets(st.integers(1, max(1, len(rows) - 1)), max_size=8)) - {len(rows)})
        expected = nodes_of({c * 7 % 41: [(x, x + 1) for x in s] for c, s in enumerate(sequences)})
        assert swept(rows, cuts, data.draw(st.integers(2, 5))) == expected
    finally:
        trie.HELD, trie.CHUNK_IDS = held, chunk


def test_out_of_order_ranges_are_refused():
    sweep = trie.Sweep(0)
    sweep.row(b"b" * 32, [1], 1)
    with pytest.raises(ValueError):
        sweep.row(b"a" * 32, [1], 2)


def test_query_over_conversations(spark):
    conversations = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in conversations.collect()]
    assert got(trie.query(conversations)) == plain(rows)


def test_edges(spark):
    rows = [
        (100, 0, "user", "a"), (100, 1, "assistant", "b"), (100, 2, "user", None), (101, None, None, None), (101, 0, "user", "c"), (101, 0, "user", "c"), (102, 0, "b", "x"), (102, 0, "a", "y"),
        (102, 0, "a", "xx"), (103, 5, "user", "long " * 40_000), (-7, 0, "user", "n"), (0, 0, "user", "z"), (250, 0, "user", "no base"), (None, 0, "user", "nobody"), (104, 0, "user", "a"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], f"{SCHEMA}, digest int").withColumns({c: trie.F.lit(1) for c in ("key", "turns", "base", "h")})
    assert got(trie.query(df)) == plain(rows)
    assert trie.query(df.limit(0)).collect() == []
    nobody = trie.query(df.where("conv_id IS NULL"))
    assert nobody.columns == list(COLUMNS) and nobody.count() == 0


def test_hot_groups_spread_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(trie, "FAN", 3)
    rng = random.Random(5)
    rows = []
    for c in range(1, 3000):
        same = c % 3 == 0
        for turn in range(4 if same else rng.randint(1, 7)):
            rows.append((c * 100, turn, "user", "hot" if same or not turn else f"t{rng.randint(0, 3)}"))
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert got(trie.query(df)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
