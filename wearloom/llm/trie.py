"""Prefix trie of conversations: one node for each distinct sequence of first turns.

A conversation is its array of turns; a turn is the SHA-256 of its role and text, and the
length of its text, so no text is ever dealt out. The arrays are sorted over all ranges of
a global order, with the conversation's id last, so that any number of equal conversations
may spread over several ranges. In each range, neighbours' longest common prefixes drive a
stack: a node is closed when the next array leaves it.

A range cannot close the nodes on its first and on its last array's path, for these may go on
in the ranges next to it. They are handed on as two items, and neighbouring ranges' items are
stitched by the same sweep, ``FAN`` at a time, until one task sees the ends of all; a task
gets two items for each range that it stitches, however many rows those had.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wearloom.llm.common import written

#: Bytes of a turn's digest.
UNIT = 32
#: Conversations of a hundred share the first of its first conversation's turns.
GROUP, MOST_SHARED = 100, 5
#: Ranges whose items one task stitches.
FAN = 64
#: Ids of equal conversations in one chunk, and closed nodes that wait for their parents in a task.
CHUNK_IDS, HELD = 1 << 15, 50_000

VALUE = pa.struct([("n", pa.int64()), ("least", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string()), ("chunked", pa.bool_())])
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
SWEPT = pa.schema(
    [("kind", pa.string()), *[(c, pa.int64()) for c in NODE], ("ends", pa.string()), ("chunked", pa.bool_()), ("node_id", pa.binary()), ("parent_id", pa.binary()), ("place", pa.int64())]
    + [("part", pa.int64()), ("seq", pa.int64()), ("key", pa.binary()), ("chars", pa.list_(pa.int64())), ("from_depth", pa.int64()), ("values", pa.list_(VALUE)), ("ids", pa.string())]
)
SWEPT_SQL = (
    "kind string, " + ", ".join(f"{c} long" for c in NODE) + ", ends string, chunked boolean, node_id binary, parent_id binary, place long, part long, seq long, key binary, "
    "chars array<long>, from_depth long, values array<struct<n:long,least:long,children:long,leaves:long,saved:long,ends:string,chunked:boolean>>, ids string"
)


class Node:
    """What is known of a node, its open child left out."""

    __slots__ = ("chars", "n", "least", "children", "leaves", "saved", "ends", "chunked", "closed", "sought")

    def __init__(self, chars: int):
        self.chars, self.n, self.least, self.children, self.leaves, self.saved = chars, 0, None, 0, 0, 0
        self.ends, self.chunked = None, False
        self.closed: list[dict] = []  #: children that wait for this node's least conversation
        self.sought = False  #: whether children were sent on without it

    def add(self, n: int, least: int | None, children: int, leaves: int, saved: int) -> None:
        self.n += n
        self.children += children
        self.leaves += leaves
        self.saved += saved
        if least is not None and (self.least is None or least < self.least):
            self.least = least

    def value(self) -> dict:
        return {"n": self.n, "least": self.least, "children": self.children, "leaves": self.leaves, "saved": self.saved, "ends": self.ends, "chunked": self.chunked}


def common_turns(a: bytes, b: bytes) -> int:
    at, most = 0, min(len(a), len(b))
    while at < most and a[at : at + UNIT] == b[at : at + UNIT]:
        at += UNIT
    return at // UNIT


class Sweep:
    """Closes nodes over sorted arrays, or over the items of sorted ranges.

    ``whole`` says that nothing comes before or after: then every node is closed. ``place`` is
    a number of this sweep's own, for children whose parent is closed elsewhere.
    """

    def __init__(self, place: int, whole: bool = False):
        self.place, self.whole = place, whole
        self.path, self.chars, self.stack = b"", [], [Node(0)]
        self.first: tuple[bytes, list[int]] | None = None
        self.through = 0  #: depth down to which the path is still that of the first array
        self.left: dict[int, Node] = {}
        self.run: list[str] = []
        self.chunks = 0
        self.held = 0
        self.out: list[dict] = []

    def node_id(self, depth: int) -> bytes:
        return hashlib.sha256(self.path[: depth * UNIT]).digest()

    def row(self, key: bytes, chars: list[int], conv_id: int) -> None:
        if self.first is None or key != self.path:
            self.end_run()
            self.move(key, chars)
        self.stack[-1].add(1, conv_id, 0, 0, 0)
        self.run.append(str(conv_id))
        if len(self.run) >= CHUNK_IDS:
            self.chunk()

    def item(self, key: bytes, chars: list[int], from_depth: int, values: list[dict]) -> None:
        self.move(key, chars)
        for depth, v in enumerate(values, from_depth):
            node = self.stack[depth]
            node.add(v["n"], v["least"], v["children"], v["leaves"], v["saved"])
            node.ends = node.ends or v["ends"]
            node.chunked |= v["chunked"]
            node.sought = True

    def move(self, key: bytes, chars: list[int]) -> None:
        if self.first is None:
            self.first, self.through = (key, chars), len(key) // UNIT
        else:
            if key < self.path:
                raise ValueError("ranges are not in order")
            self.close(common_turns(self.path, key))
        self.path, self.chars = key, chars
        self.stack += [Node(c) for c in chars[len(self.stack) - 1 :]]

    def close(self, depth: int) -> None:
        """Closes nodes below a depth; those on the first array's path may go on to the left."""
        while len(self.stack) > depth + 1:
            at, node = len(self.stack) - 1, self.stack.pop()
            if at <= self.through and not self.whole:
                self.left[at] = node
                self.send_on(at, node)
            else:
                self.done(at, node)
        self.through = min(self.through, depth)

    def done(self, depth: int, node: Node) -> None:
        leaves, saved = node.leaves if node.children else 1, node.saved + (node.n - 1) * node.chars
        for child in node.closed:
            child["parent_conv_id"] = node.least
        self.out += node.closed
        self.held -= len(node.closed)
        row = {"kind": "node", "conv_id": node.least, "depth": depth, "n_convs": node.n, "n_children": node.children, "n_leaves": leaves, "saved_tokens": saved, "ends": node.ends, "chunked": node.chunked}
        if node.sought or node.chunked:
            row["node_id"] = self.node_id(depth)
        if not depth:
            self.out.append(row)
            return
        parent = self.stack[-1]
        parent.add(node.n, node.least, 1, leaves, saved)
        parent.closed.append(row)
        self.held += 1
        if self.held > HELD:
            for at, waiting in enumerate(self.stack):
                self.send_on(at, waiting)

    def send_on(self, depth: int, node: Node) -> None:
        """A node's closed children go on without its least conversation, which is looked up later."""
        if node.closed:
            parent_id = self.node_id(depth)
            for child in node.closed:
                child |= {"parent_id": parent_id, "place": self.place}
            self.out += node.closed
            self.held -= len(node.closed)
            node.closed, node.sought = [], True

    def chunk(self) -> None:
        """Ids of conversations that end here, for a digest that one range cannot finish."""
        if self.run:
            depth = len(self.path) // UNIT
            self.stack[depth].chunked = True
            self.out.append({"kind": "chunk", "node_id": self.node_id(depth), "part": self.place, "seq": self.chunks, "ids": ",".join(self.run)})
            self.chunks += 1
            self.run = []

    def end_run(self) -> None:
        if self.first and (self.stack[-1].chunked or self.path == self.first[0]):
            self.chunk()
        elif self.run:
            self.stack[-1].ends = hashlib.sha256(",".join(self.run).encode()).hexdigest()
            self.run = []

    def finish(self, part: int) -> None:
        if self.first is None:
            return
        self.chunk()
        if self.whole:
            self.close(0)
            self.done(0, self.stack.pop())
            return
        for depth, node in enumerate(self.stack):
            self.send_on(depth, node)
        key, chars = self.first
        left = [self.left[d].value() for d in range(self.through + 1, len(key) // UNIT + 1)]
        common = {"kind": "item", "part": part}
        self.out.append(common | {"seq": 0, "key": key, "chars": chars, "from_depth": self.through + 1, "values": left})
        self.out.append(common | {"seq": 1, "key": self.path, "chars": self.chars, "from_depth": 0, "values": [n.value() for n in self.stack]})

    def take(self, most: int = 0) -> Iterator[pa.RecordBatch]:
        """The rows made so far, once there are more than ``most``."""
        if len(self.out) > most:
            yield pa.RecordBatch.from_pylist(self.out, SWEPT)
            self.out = []


def _sweep_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place = TaskContext.get().partitionId()
    sweep = Sweep(place)
    for batch in batches:
        for key, chars, conv_id in zip(*batch.columns):
            sweep.row(key.as_py(), chars.as_py(), conv_id.as_py())
        yield from sweep.take(10_000)
    sweep.finish(place)
    yield from sweep.take()


def _stitcher(level: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, group = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["group"] != group:
                    if sweep:
                        sweep.finish(group)
                        yield from sweep.take()
                    group = row["group"]
                    sweep = Sweep((level << 40) + group, whole)
                sweep.item(row["key"], row["chars"], row["from_depth"], row["values"])
        if sweep:
            sweep.finish(group)
            yield from sweep.take()

    return run


def _digest_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node_id, digest) of chunks that come sorted by node and place, one chunk at a time."""
    at, sha, schema = None, None, pa.schema([("of_node", pa.binary()), ("digest", pa.string())])
    for batch in batches:
        for node_id, ids in zip(batch.column(0), batch.column(1)):
            if node_id.as_py() != at:
                if sha:
                    yield pa.RecordBatch.from_pylist([{"of_node": at, "digest": sha.hexdigest()}], schema)
                at, sha = node_id.as_py(), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.as_py().encode())
    if sha:
        yield pa.RecordBatch.from_pylist([{"of_node": at, "digest": sha.hexdigest()}], schema)


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns of (turn, digest, chars)): one row per conversation, its turns by number,
    nulls first, and of one number by role, then text. Only conversations that have different
    turns of one number meet with their texts, to be ordered by these."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("conv_id IS NOT NULL")
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256).alias("digest")
    turn = F.struct("turn", digest, F.length("text").cast("long").alias("chars"))
    arrays = written(rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns")))
    distinct = lambda *parts: F.size(F.array_distinct(F.transform("turns", lambda t: F.struct(*[t[p].alias(p) for p in parts]))))
    tied = distinct("turn", "digest") > distinct("turn")
    if arrays.where(tied).isEmpty():
        return arrays
    texts = rows.join(arrays.where(tied).select("conv_id"), "conv_id", "left_semi")
    ordered = texts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", digest))).alias("turns"))
    back = F.transform("turns", lambda t: F.struct(t["turn"].alias("turn"), t["digest"].alias("digest"), F.length(t["text"]).cast("long").alias("chars")))
    return arrays.where(~tied).unionByName(ordered.select("conv_id", back.alias("turns")))


def rebuilt(arrays: DataFrame) -> DataFrame:
    """arrays with the first h turns of conversation c - c % 100 in front of each c's turns after
    its first h; h = crc32(c) % 6. The hundred that share a first conversation meet in a window."""
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    shared = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, MOST_SHARED)), ignorenulls=True).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (MOST_SHARED + 1)).cast("int")
    own = arrays.withColumn("base", base).withColumn("shared", shared).withColumn("h", h)
    nothing = F.slice("turns", 1, 0)
    after = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))).otherwise(nothing)
    return own.select("conv_id", F.concat(F.coalesce(F.slice("shared", F.lit(1), F.col("h")), nothing), after).alias("turns"))


def trie(arrays: DataFrame) -> DataFrame:
    """The nodes of (conv_id, turns of (digest, chars)), conv_id once each."""
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("key")
    keys = arrays.select(key, F.transform("turns", lambda t: t["chars"]).alias("chars"), "conv_id")
    ranges = keys.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    swept = [written(ranges.mapInArrow(_sweep_range, SWEPT_SQL))]
    items = swept[0].where("kind = 'item'")
    last = items.agg(F.max("part")).head()[0]
    level = 0
    while last is not None:
        level += 1
        grouped = items.withColumn("group", F.floor(F.col("part") / FAN).cast("long")).repartition("group").sortWithinPartitions("group", "part", "seq")
        swept.append(written(grouped.select("group", "key", "chars", "from_depth", "values").mapInArrow(_stitcher(level, last < FAN), SWEPT_SQL)))
        items = swept[-1].where("kind = 'item'")
        last = None if last < FAN else last // FAN
    every = swept[0]
    for more in swept[1:]:
        every = every.unionByName(more)
    nodes, nothing = every.where("kind = 'node'"), F.lit(hashlib.sha256().hexdigest())
    result = lambda df, parent, ends: df.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", ends.alias("ends_sha256"))
    settled = nodes.where("parent_id IS NULL AND NOT chunked")
    open_nodes = nodes.where("parent_id IS NOT NULL OR chunked")
    # Whatever was sent on without its parent looks it up under its own range, so no parent is a hot key.
    known = nodes.where("node_id IS NOT NULL").select(F.col("node_id").alias("parent_id"), F.col("conv_id").alias("parent"))
    parents = nodes.where("parent_id IS NOT NULL").select("place", "parent_id").distinct().join(known, "parent_id")
    chunks = swept[0].where("kind = 'chunk'").repartition("node_id").sortWithinPartitions("node_id", "part", "seq")
    digests = chunks.select("node_id", "ids").mapInArrow(_digest_chunks, "of_node binary, digest string")
    looked_up = open_nodes.join(parents, ["place", "parent_id"], "left").join(digests, F.col("chunked") & (F.col("node_id") == F.col("of_node")), "left")
    return result(settled, F.col("parent_conv_id"), F.coalesce("ends", nothing)).unionByName(
        result(looked_up, F.coalesce("parent", "parent_conv_id"), F.coalesce("digest", "ends", nothing))
    )


def query(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256:
    one row per node of the rebuilt conversations.

    Null roles and texts are empty; turns without a number come first. Turns of one number come
    by role, then text, and repeated rows are turns one after the other. Rows without a conv_id
    belong to no conversation and take no part. Very long texts count by their digest and
    length. A conversation without turns left ends at the root. An empty table has no members
    and gives no node, not even the root. Other columns are not read, whatever their names.

    A conversation's array (36 bytes a turn) has to fit in one row; the ids of a group of equal
    conversations go through one task as a stream, for a digest takes them in order.
    """
    return trie(rebuilt(turn_arrays(conversations)))


#: Crc32 bit by bit over the characters of a decimal number.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({}, ''),
    lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"""

ORACLE = f"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS place,
  sha256(length(role) || ':' || role || text) AS digest, length(text) AS chars FROM t),
h AS (SELECT c, c - c % 100 AS base, {_CRC.format("c::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT h.c, o.place, o.digest, o.chars FROM h JOIN o ON o.c = h.base AND o.place <= h.h
  UNION ALL SELECT h.c, o.place + 1000000, o.digest, o.chars FROM h JOIN o ON o.c = h.c AND o.place > h.h),
d AS (SELECT c, row_number() OVER w AS depth, chars, sha256(string_agg(digest, '') OVER (PARTITION BY c ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS node FROM r WINDOW w AS (PARTITION BY c ORDER BY place)),
p AS (SELECT c, depth, chars, node, coalesce(lag(node) OVER (PARTITION BY c ORDER BY depth), 'root') AS parent FROM d
  UNION ALL SELECT c, 0, 0, 'root', NULL FROM h),
e AS (SELECT *, depth = max(depth) OVER (PARTITION BY c) AS ends FROM p),
n AS (SELECT node, min(parent) AS parent, min(c) AS conv_id, min(depth) AS depth, count(*) AS n_convs, min(chars) AS chars,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM e GROUP BY node),
k AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON n.node = k.node),
s AS (SELECT e.node, sum(CASE WHEN m.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((m.n_convs - 1) * m.chars) AS saved_tokens
  FROM m JOIN e ON e.c = m.conv_id AND e.depth <= m.depth GROUP BY e.node)
SELECT m.conv_id, m.depth::BIGINT AS depth, a.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN s ON m.node = s.node LEFT JOIN n a ON a.node = m.parent
"""
