"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Within a source every document has the same expected number of copies (target / size).
Laid end to end in the order of size and a hash of the id, a document covers a stretch of
that length; with one random offset per source it is emitted once for every integer
boundary in its stretch. The order by size spreads what is taken evenly over all sizes,
so a source's taken words come near its target.

A document's place in its source is found without one ordered task per source: rows are laid
out by ranges of (source, size, hash, id, text), with a number of the row itself last, so that
any number of equal rows may spread over several ranges; each range is ranked on its own, and
the counts of the ranges before it (one row per range and source) are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearloom.llm.common import written

#: Fixed value: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = "mix-1"
#: Parts of the hash: 28 bits.
PARTS = 1 << 28


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def part(text: Column) -> Column:
    """A repeatable whole number below PARTS for a string."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce(text, F.lit("\x00null")))), 1, 7), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, n, target, rate, offset) from (source, size, n).

    Sources in code point order, null last, weigh 5, 2, 1, repeating. Shares of all words
    go by weight; a target stops at three times its source's words and the excess is shared
    by weight among the others until none is above. In closed form: sources fill up in the
    order of words per weight, and the level is the first that exceeds no later source.
    There is one row per source here, so an ordered window over them stays small.
    """
    total = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    weighed = total.withColumn("weight", weight.cast("long")).withColumn("most", MOST_COPIES * F.col("source_size"))
    fills = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    everything = Window.partitionBy()
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    level = weighed.withColumns(
        {
            "left": F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0)),
            "weights": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    ).withColumn("level", F.col("left").cast("double") / F.col("weights").cast("double"))
    # The level is that of the first source which it does not fill; those before are full.
    open_from = F.min(F.when(F.col("weight") * F.col("level") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"), F.col("level")))).over(everything)
    share = F.col("weight").cast("double") * open_from["level"]
    return level.select(
        "source",
        "source_size",
        "n",
        F.coalesce(F.least(share, F.col("most").cast("double")), F.lit(0.0)).alias("target"),
    ).select(
        "*",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0).alias("rate"),
        (part(F.coalesce(F.col("source"), F.lit("\x00none"))).cast("double") / PARTS).alias("offset"),
    )


def _order() -> list[Column]:
    return [F.col("size"), F.col("part"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"), F.col("row")]


def laid_out(sized: DataFrame) -> DataFrame:
    """Rows (source, size, doc_id, text_hash, row) with part, by ranges of their order, and the range's number."""
    hashed = sized.withColumn("part", part(F.col("doc_id").cast("string")))
    return hashed.repartitionByRange(F.col("source").isNull(), F.col("source"), *_order()).withColumn("range", F.spark_partition_id())


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target, copies (long) of every row.

    The words of every whole text are counted once, into a narrow table in the shared folder;
    no text is dealt out.
    """
    sized = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).alias("size")
        ).withColumn("row", F.monotonically_increasing_id())
    )
    sizes = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    targets = source_targets(sizes).select(F.col("source").alias("of"), "source_size", "target", "rate", "offset")
    ranged = written(laid_out(sized))
    # Ranges follow each other in a source; a row per range and source.
    counts = ranged.groupBy("range", "source").agg(F.count("*").alias("m"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col("range").alias("of_range"), F.col("source").alias("of_source"), F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("first"))
    first = written(first.join(targets, F.col("of_source").eqNullSafe(F.col("of"))).drop("of"))
    own = Window.partitionBy("range", "source").orderBy(*_order())
    ranked = ranged.withColumn("place", F.row_number().over(own))
    ranked = ranked.join(first, (F.col("range") == F.col("of_range")) & F.col("source").eqNullSafe(F.col("of_source")))
    place = F.col("first") + F.col("place")
    end = F.floor(F.col("offset") + F.col("rate") * place.cast("double"))
    start = F.floor(F.col("offset") + F.col("rate") * (place - 1).cast("double"))
    return ranked.select("doc_id", "source", "text_hash", "size", "source_size", "target", (end - start).cast("long").alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies): one row per input row.

    Null texts have size 0. Null sources are one source, last in order. A source without
    words has target 0 and takes nothing. Null ids have one hash and come by their text's hash;
    equal rows are ranked one after the other, and any number of them is spread over ranges.
    Very long texts are counted whole. Other columns are not read, whatever their names. An
    empty table gives no rows. Reruns agree: offsets and order come of hashes.
    """
    return placed(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix themselves, each as often as it is taken, columns as in docs.

    The text is dealt out once, to meet its number of copies. Rows that agree in id, source
    and text share one number; where there are any, one of them, by a hash of all its columns,
    is emitted for all. Null ids, sources and texts meet like others; texts of any length stay
    whole. Columns of docs may have any names. An empty table gives no rows.
    """
    keys = ["doc_id", "source", "text_hash"]
    copies = written(placed(docs).groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")))
    own = [F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64("text")]
    row = F.struct(*docs.columns).alias("row")  # columns of docs may have the names used here
    repeats = not copies.where("rows > 1").isEmpty()
    taken = copies.where("copies > 0").select(*[F.col(k).alias(f"_{k}") for k in keys], "copies")
    met = docs.select(*[c.alias(k) for c, k in zip(own, keys)], row).join(
        taken,
        (F.coalesce("doc_id", F.lit(-(1 << 63))) == F.coalesce("_doc_id", F.lit(-(1 << 63)))) & (F.col("text_hash") == F.col("_text_hash")) & F.col("source").eqNullSafe(F.col("_source")),
    )
    if repeats:  # least of a group, found before anything of it is dealt out
        met = met.groupBy(*keys).agg(F.min_by("row", F.xxhash64("row")).alias("row"), F.max("copies").alias("copies"))
    return met.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


ORACLE = """
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT]::BIGINT AS weight, 3 * source_size AS most FROM s),
l AS (SELECT *, most / weight AS fill,
  (sum(source_size) OVER ())::BIGINT - coalesce(sum(most) OVER f, 0)::BIGINT AS rest,
  (sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER f, 0)::BIGINT AS weights
  FROM w WINDOW f AS (ORDER BY most / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, rest::DOUBLE / weights::DOUBLE AS level FROM l),
o AS (SELECT level FROM v WHERE weight * level <= most ORDER BY fill, source IS NULL, encode(source) LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(weight::DOUBLE * (SELECT level FROM o), most::DOUBLE), 0.0) AS target,
  ('0x' || substr(md5('mix-1' || coalesce(source, chr(0) || 'none')), 1, 7))::BIGINT::DOUBLE / 268435456 AS shift FROM v),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.shift, CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0 END AS rate,
  row_number() OVER (PARTITION BY d.source ORDER BY d.size, ('0x' || substr(md5('mix-1' || coalesce(d.doc_id::VARCHAR, chr(0) || 'null')), 1, 7))::BIGINT, d.doc_id IS NULL, d.doc_id) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (floor(shift + rate * place::DOUBLE) - floor(shift + rate * (place - 1)::DOUBLE))::BIGINT AS copies FROM p)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""
