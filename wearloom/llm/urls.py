"""URL filters: rules, and for the rest the ratio of two character models, in DataFrame functions only.

Two Markov models over the characters of host and path are learned, one from URLs that the
rules accept and one from those that they reject. A character's chance in a context of up
to ORDER characters is smoothed towards its chance in the next shorter one: with LEAN
pseudo-counts, so where a context has not seen a character, LEAN / (all + LEAN) of the
shorter context's chance is left. A URL's score is the mean over its characters of the log
ratio of both models' chances; the cutoff is calibrated on hosts that were kept out of the
counts.

Log ratios are kept by the gram itself, the log ratios of what is left by the context. They
are looked up once for each distinct gram of the pages; tables are broadcast only where they
are counted to be small, else dealt out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearloom.llm.common import written

#: The rules, as host and path, and their verdicts.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
ORDER = 4
#: Pseudo-counts by which a context leans on the shorter one; chance of a character at the bottom.
LEAN, LEAST = 2.0, 1 / 256
#: Most rows of a table that is broadcast.
SLOTS = 1 << 18
#: One host in so many calibrates the cutoff, in steps of a score, up to this size of it.
CALIBRATION, STEPS, MOST = 5, 1000, 20
BEGIN, END = "\x02", "\x03"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and without ://."""
    host = F.regexp_extract(url, r"://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, CAPITALS, CAPITALS.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, rule_verdict: the longest rule that fits, else nulls."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = [((F.col("host") == h) | F.endswith(F.col("host"), F.lit(f".{h}"))) & F.startswith(F.col("path"), F.lit(p)) for h, p, _ in ordered]
    pick = lambda values: F.coalesce(*[F.when(f, F.lit(v)) for f, v in zip(fits, values)], F.lit(None).cast("string"))
    return parsed.withColumns({"rule": pick([h + p for h, p, _ in ordered]), "rule_verdict": pick([v for _, _, v in ordered])})


def grams(df: DataFrame) -> DataFrame:
    """df with a row per character of host and path and of the end: column gram, the character after ORDER others."""
    chars = F.split(F.concat(F.lit(BEGIN * ORDER), F.col("host"), F.col("path"), F.lit(END)), "")
    with_chars = df.withColumn("chars", F.filter(chars, lambda c: c != ""))
    made = F.transform(F.sequence(F.lit(0), F.size("chars") - (ORDER + 1)), lambda i: F.concat(*[F.get("chars", i + k) for k in range(ORDER + 1)]))
    return with_chars.withColumn("gram", F.explode(made)).drop("chars")


def last(gram: Column | str, n: int) -> Column:
    return F.substring(gram, ORDER + 2 - n, n)


def model(judged: DataFrame) -> DataFrame:
    """(kind, n, gram, ratio) from the rows of ``with_rule`` that have a verdict.

    Kind gram: the log ratio of the chances of each gram of n characters that a class has
    seen. Kind context: the log ratio of what a context of n - 1 characters leaves to the
    shorter one. Counts of the longest grams hold those of all shorter ones; they are summed
    before they are dealt out.
    """
    accepted = F.col("rule_verdict") == "allow"
    counted = grams(judged.where("rule_verdict IS NOT NULL")).groupBy("gram").agg(F.count_if(accepted).alias("a"), F.count_if(~accepted).alias("r"))
    counted = written(counted)
    tables, below = [], None
    for n in range(1, ORDER + 2):
        gram = last("gram", n)
        own = counted.groupBy(gram.alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        context = own.groupBy(F.substring("g", 1, n - 1).alias("context")).agg(F.sum("a").alias("all_a"), F.sum("r").alias("all_r"))
        own = own.join(context, F.substring("g", 1, n - 1) == F.col("context"))
        if below is None:
            own = own.withColumns({"low_a": F.lit(LEAST), "low_r": F.lit(LEAST)})
        else:
            short = below.select(F.col("g").alias("short"), F.col("p_a").alias("low_a"), F.col("p_r").alias("low_r"))
            own = own.join(short, F.substring("g", 2, n - 1) == F.col("short"))
        chance = lambda c: (F.col(c) + LEAN * F.col(f"low_{c}")) / (F.col(f"all_{c}") + LEAN)
        left = F.log((F.col("all_r") + LEAN) / (F.col("all_a") + LEAN))
        below = written(own.select("g", "context", chance("a").alias("p_a"), chance("r").alias("p_r"), left.alias("left")))
        tables.append(below.select(F.lit("gram").alias("kind"), F.lit(n).alias("n"), F.col("g").alias("gram"), F.log(F.col("p_a") / F.col("p_r")).alias("ratio")))
        tables.append(below.groupBy("context").agg(F.first("left").alias("ratio")).select(F.lit("context").alias("kind"), F.lit(n).alias("n"), F.col("context").alias("gram"), "ratio"))
    return written(reduce(DataFrame.unionByName, tables))


def looked_up(judged: DataFrame, ratios: DataFrame) -> DataFrame:
    """(gram, uses, ratio) of each distinct longest gram of the rows: the log ratio of both
    models' chances of its last character after the others. Grams and contexts that no class
    has seen leave all to the shorter ones; a character that none has seen even alone counts
    LEAST in both."""
    sizes = {(r["kind"], r["n"]): r["count"] for r in ratios.groupBy("kind", "n").count().collect()}
    found = grams(judged.select("host", "path")).groupBy("gram").agg(F.count("*").alias("uses"))
    ratio = F.lit(0.0)
    for n in range(1, ORDER + 2):
        for kind, key in (("gram", last("gram", n)), ("context", F.substring(last("gram", n), 1, n - 1))):
            table = ratios.where((F.col("n") == n) & (F.col("kind") == kind)).select(F.col("gram").alias("key"), F.col("ratio").alias(f"{kind}_{n}"))
            table = F.broadcast(table) if sizes.get((kind, n), 0) <= SLOTS else table
            found = found.join(table, key == F.col("key"), "left").drop("key")
        ratio = F.coalesce(F.col(f"gram_{n}"), F.coalesce(F.col(f"context_{n}"), F.lit(0.0)) + ratio)
    return written(found.select("gram", "uses", ratio.alias("ratio")))


def scored(judged: DataFrame, ratios: DataFrame) -> DataFrame:
    """The rows of ``judged`` with score: the mean log ratio over a URL's characters.

    Up to SLOTS distinct grams are broadcast with their ratios: a row's characters stay in
    its task until they are summed up, so one row per URL is dealt out. Of more grams those
    with over one in SLOTS of all uses are broadcast, fewer than SLOTS; the others, none of
    them frequent, are dealt out by gram.
    """
    table = looked_up(judged, ratios)
    n, uses = table.agg(F.count("*"), F.sum("uses")).first()
    rows = judged.withColumn("row", F.monotonically_increasing_id())
    if n <= SLOTS:
        found = grams(rows).join(F.broadcast(table.select("gram", "ratio")), "gram")
        return found.groupBy(*rows.columns).agg(F.avg("ratio").alias("score")).drop("row")
    rows = written(rows)
    each = grams(rows.select("row", "host", "path")).select("row", "gram")
    frequent = F.col("uses") * SLOTS > uses
    hot, cold = table.where(frequent).select("gram", "ratio"), table.where(~frequent).select("gram", "ratio")
    parts = [each.join(F.broadcast(hot), "gram"), each.join(F.broadcast(hot.select("gram")), "gram", "left_anti").join(cold, "gram")]
    sums = [part.groupBy("row").agg(F.sum("ratio").alias("total"), F.count("*").alias("chars")) for part in parts]
    score = reduce(DataFrame.unionByName, sums).groupBy("row").agg((F.sum("total") / F.sum("chars")).alias("score"))
    return rows.join(score, "row").drop("row")


def cutoff(calibrating: DataFrame) -> float:
    """The cutoff with the largest difference of accepted and rejected URLs at or above it,
    of equal ones the highest.

    Scores are counted in steps of 1 / STEPS between -MOST and MOST, so no more counts than
    there are steps reach the driver; without both classes it is 0.
    """
    step = F.greatest(F.lit(-MOST * STEPS), F.least(F.lit(MOST * STEPS), F.floor(F.col("score") * STEPS))).cast("int")
    accepted = F.col("rule_verdict") == "allow"
    rows = calibrating.groupBy(step.alias("step")).agg(F.count_if(accepted).alias("a"), F.count_if(~accepted).alias("r")).collect()
    all_a, all_r = sum(r["a"] for r in rows), sum(r["r"] for r in rows)
    if not all_a or not all_r:
        return 0.0
    best, at, a, r = 0.0, 0, 0, 0
    for row in sorted(rows, key=lambda row: -row["step"]):
        a, r = a + row["a"], r + row["r"]
        if (gain := a / all_a - r / all_r) > best:
            best, at = gain, row["step"]
    return at / STEPS


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): one row per input row.

    Null urls and those without :// have empty host and path. The score is null where a
    rule decides. Without rows of both verdicts to learn from, scores say nothing and what
    no rule decides is allowed. Urls of any length are read whole: a row is multiplied by its
    characters within its task. Equal urls have equal verdicts; repeated rows stay. Only
    page_id and url are read; an empty table gives no rows.
    """
    judged = with_rule(pages, rules)
    held = F.pmod(F.xxhash64("host"), F.lit(CALIBRATION)) == 0
    ratios = model(judged.where(~held))
    least = cutoff(scored(judged.where(held & F.col("rule_verdict").isNotNull()), ratios))
    rest = scored(judged.where("rule IS NULL"), ratios)
    decided = judged.where("rule IS NOT NULL").select("page_id", "host", "path", "rule", F.col("rule_verdict").alias("verdict"), F.lit(None).cast("double").alias("score"))
    verdict = F.when(F.col("score") >= least, "allow").otherwise("block")
    return decided.unionByName(rest.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score"))
