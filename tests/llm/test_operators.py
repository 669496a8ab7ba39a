"""Small tests of the text operators: brute force, held-out accuracy, round trips and edge cases."""

import hashlib
import math
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearloom.llm import chat, components, langid, licenses, mixing, quality, rules, simhash, topk, urls

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def edge_docs(spark, extra=True):
    """Nulls in any column, an empty and a long text, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, None, "en", "a", None), (2, "", None, None, 0), (3, "word " * 30_000, "de", "a", 150_000), (4, "The cat sat on the mat today with a hat", "en", None, 40),
        (4, "The cat sat on the mat today with a hat", "en", None, 40), (5, "The cat sat on the mat today with a hat", "fr", "b", 40), (None, "lonely text", "en", "b", 11), (6, "\n \t", "en", "b", 3),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(1) for c in ("key", "fp", "size", "score", "copies", "row", "stratum")}) if extra else df


# SimHash


def brute_components(ids, prints, bits=4):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= bits:
            parent[find(i)] = find(j)
    least = defaultdict(lambda: math.inf)
    for i, d in enumerate(ids):
        least[find(i)] = min(least[find(i)], d)
    return {d: least[find(i)] for i, d in enumerate(ids)}


def plain_simhash(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_triples_cover_every_four_positions():
    family = simhash.triples()
    assert len(family) == len(set(family)) == 20
    assert all(any(set(t) <= set(four) for t in family) for four in combinations(range(8), 4))


def test_simhash_against_brute_force(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    prints = [plain_simhash(r.text) for r in rows]
    expected = brute_components([r.doc_id for r in rows], prints)
    got = simhash.near_duplicates(documents).collect()
    assert {r.doc_id: r.component_id for r in got} == expected
    assert {r.doc_id: r.fingerprint for r in got} == {r.doc_id: f"{p:016x}" for r, p in zip(rows, prints)}


def test_longer_masks_cover_what_four_bits_leave():
    rng = np.random.default_rng(0)
    for mask in simhash.byte_masks():
        for _ in range(3):  # down to lists that cannot be long
            further = simhash.longer_masks(mask)
            flips = [b for b in range(64) if not mask >> b & 1]
            for _ in range(50):
                differ = sum(1 << int(b) for b in rng.choice(flips, 4, replace=False))
                assert any(not differ & m for m in further)
            mask = further[int(rng.integers(len(further)))]


@pytest.mark.parametrize("longest", [1 << 12, 256])
def test_links_connect_like_all_pairs(spark, longest):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**63)) * 2 + 1
    values = {base}
    for _ in range(500):
        v = base
        for b in rng.choice(40, rng.integers(0, 5), replace=False):
            v ^= 1 << int(b)
        values.add(v)
    values |= {int(x) | base >> 40 << 40 for x in rng.integers(0, 2**40, 900)}  # unlinked, in one list
    values = sorted(values)
    signed = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long").repartition(3)
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in simhash.candidate_links(signed, longest=longest).collect():
        parent[find(a % (1 << 64))] = find(b % (1 << 64))
    expected = brute_components(list(range(len(values))), values)
    assert len({find(v) for v in values}) == len(set(expected.values())) > 500
    assert all(find(values[i]) == find(values[e]) for i, e in expected.items())


def test_simhash_edges(spark):
    df = edge_docs(spark)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == df.count()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.component_id)
    assert by[1] == by[2] == by[6] == {1} and by[4] == by[5] == {4} and by[3] == {3}
    kept = simhash.one_of_each(df)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "None"] and kept.columns == df.columns
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_one_of_each_component_with_null_and_repeated_ids(spark):
    texts = {k: " ".join(f"{k}{i}" for i in range(12)) for k in "abcdef"}
    rows = [(None, "a"), (None, "b"), (None, "b"), (7, "c"), (7, "d"), (7, "d"), (8, "e"), (None, "e"), (9, "f"), (9, "a")]
    df = spark.createDataFrame([(d, texts[k], k) for d, k in rows], "doc_id long, text string, kind string")
    kept = simhash.one_of_each(df)
    assert sorted((r.kind, r.doc_id) for r in kept.collect()) == [("a", 9), ("b", None), ("c", 7), ("d", 7), ("e", 8), ("f", 9)]
    assert kept.columns == df.columns


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}}


# Language identification


def test_language_accuracy_on_held_out(spark, documents):
    got = langid.query(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_viterbi_shortcut_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, k = int(rng.integers(1, 40)), int(rng.integers(1, 5))
        scores = rng.normal(0, rng.choice([0.5, 3]), (n, k))
        best = -np.inf
        path = langid.labels(scores, 4.0)
        value = lambda p: scores[np.arange(n), p].sum() - 4.0 * (np.diff(p) != 0).sum()  # noqa: B023, E731
        assert value(path) >= value(langid.viterbi(scores, 4.0)) - 1e-9
        if k**n <= 5000:
            for code in range(k**n):
                best = max(best, value(np.array([code // k**i % k for i in range(n)])))
            assert abs(value(path) - best) < 1e-9


def test_viterbi_shortcut_sees_paths_that_avoid_the_winner():
    scores = np.array([[0.0, -9, -19], [-19, -9, 0]])
    assert langid.labels(scores, 12.0).tolist() == langid.viterbi(scores, 12.0).tolist() == [0, 2]
    rng = np.random.default_rng(1)
    for _ in range(2000):
        scores = rng.normal(0, 3, (int(rng.integers(2, 6)), 4))
        scores[:, 1] = scores.max(axis=1) - rng.uniform(0, 4)
        assert langid.labels(scores, 4.0).tolist() == langid.viterbi(scores, 4.0).tolist()


def test_mixed_text_falls_into_spans(spark, documents):
    model = langid.train(documents, F.lit(True))
    texts = {r.lang: r.text.split()[:60] for r in documents.where("length(text) > 1500 AND text NOT LIKE '%#%' AND text NOT LIKE '%!%' AND text NOT LIKE '%|%'").collect()}
    mixed = spark.createDataFrame([(1, " ".join(texts["en"] + texts["de"] + texts["fr"]))], "doc_id long, text string")
    got = [r.lang for r in langid.spans(mixed, model).orderBy("first_word").collect()]
    assert got == ["en", "de", "fr"]


def test_language_edges(spark, documents):
    model = langid.train(documents, F.lit(True))
    df = edge_docs(spark)
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(df, model).collect()]
    assert len(got) == 8 and {(d, p, s) for d, p, s in got if d in (1, 2, 6)} == {(1, "und", 0.0), (2, "und", 0.0), (6, "und", 0.0)}
    assert langid.predict(spark.createDataFrame([(1, "123 456 !!"), (2, "東京 都"), (3, "a")], "doc_id long, text string"), model).where("lang_pred = 'und'").count() == 1
    assert langid.predict(df, langid.train(df.limit(0), F.lit(True))).where("lang_pred = 'und'").count() == 8
    assert langid.query(df.limit(0)).count() == 0


def test_scripts_narrow_candidates(spark):
    rows = [(i, "мама мыла раму вечером дома", "ru") for i in range(20)] + [(100 + i, "mama myla ramu vecherom doma", "sr") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, F.lit(True))
    got = langid.predict(spark.createDataFrame([(1, "дома"), (2, "doma")], "doc_id long, text string"), model)
    assert {r.doc_id: r.lang_pred for r in got.collect()} == {1: "ru", 2: "sr"}


def test_latin_text_keeps_to_languages_of_its_script(spark):
    rows = [(i, "мама мыла раму вечером дома", "ru") for i in range(20)] + [(100 + i, "la casa de mi madre es grande", "es") for i in range(20)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    texts = ["zzqx wvk", "x", "Q7 qq", "ъъъ щщ", "ԱԲԳ", "東京"]
    got = {r.doc_id: r.lang_pred for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert [got[i] for i in range(4)] == ["es", "es", "es", "ru"] and set(got.values()) <= {"es", "ru"}
    scorer = langid.Scorer(model)
    assert scorer.outside("zz").tolist() == [False, True] and scorer.outside("ձձ") is None and langid.script_of("ᠠ") != langid.script_of("ሀ")


def test_language_of_short_texts_against_all_paths(spark, documents):
    """predict() held against the best of all labellings of a text's words."""
    model = langid.train(documents, F.lit(True))
    words = {lang: [w for r in documents.where(F.col("lang") == lang).limit(5).collect() for w in r.text.split() if w.isalpha()][:200] for lang in model.langs}
    rng = np.random.default_rng(4)
    texts = [" ".join(words[str(rng.choice(model.langs))][int(rng.integers(100))] for _ in range(int(rng.integers(1, 6)))) for _ in range(60)]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    scorer = langid.Scorer(model)
    for i, text in enumerate(texts):
        own = text.split()
        scorer.learn(set(own))
        scores = scorer.scores[[scorer.rows[w] for w in own]].astype(float)
        k, n = len(model.langs), len(own)
        paths = [np.array([code // k**j % k for j in range(n)]) for code in range(k**n)]
        value = [scores[np.arange(n), p].sum() - langid.SWITCH_PENALTY * (np.diff(p) != 0).sum() for p in paths]
        best = [p for p, v in zip(paths, value) if v > max(value) - 1e-5]
        letters = lambda p: [sum(len(w) for w, x in zip(own, p) if x == lang) for lang in range(k)]  # noqa: B023, E731
        assert got[i].lang_pred in {model.langs[int(np.argmax(letters(p)))] for p in best} and 0 <= got[i].score <= 1


def test_word_memories_are_bounded_in_size(monkeypatch):
    monkeypatch.setattr(langid, "REMEMBERED_CHARS", 1000)
    monkeypatch.setattr(quality, "REMEMBERED_BYTES", 1000)
    scorer, features = langid.Scorer(langid.Model(["a", "b"], np.zeros((langid.BUCKETS, 2), np.float32), [{"latin"}, {"latin"}])), quality.Features()
    for i in range(50):
        scorer.predict("x" * 400 + str(i))
        features.of("x" * 400 + str(i), None)
        assert sum(map(len, scorer.rows)) <= 1500 and sum(map(len, features.known)) <= 1500


# Quality classifier


def test_quality_on_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.query(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.9


def test_linear_time_identity():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    ids, x = np.array([3, 7, 20, 41]), rng.normal(size=4)
    plain = 0.3 + m.w[ids] @ x + sum(m.v[ids[i]] @ m.v[ids[j]] * x[i] * x[j] for i, j in combinations(range(4), 2))
    assert abs(m.margin(ids, x, np.array([0]))[0] - plain) < 1e-9


def test_scores_against_plain_pairs(spark, documents):
    """score() held against all pairwise interactions, one by one, of a text's features."""
    rng = np.random.default_rng(7)
    model = quality.Machine(0.1, rng.normal(0, 1, quality.FEATURES), rng.normal(0, 0.3, (quality.FEATURES, quality.FACTORS)))
    some = documents.where("length(text) < 1500").limit(40)
    got = {r.doc_id: r.score for r in quality.score(some, model).collect()}
    for r in some.collect():
        ids, x = quality.Features().of(r.text, r.n_chars)
        gram = (model.v[ids] @ model.v[ids].T) * np.outer(x, x)
        plain = model.bias + model.w[ids] @ x + np.triu(gram, 1).sum()
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-max(-40, min(40, plain))))) < 1e-9


def test_training_features_are_thinned_to_their_bound(spark, documents):
    labels = documents.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    seen = []
    fit = quality.fit
    try:
        quality.fit = lambda rows, y, seed=11: seen.append(sum(len(i) for i, _ in rows)) or fit(rows, y, seed)
        quality.train(documents, labels)
        quality.train(documents, labels, features_wanted=seen[0] // 4)
    finally:
        quality.fit = fit
    assert 0 < seen[1] < seen[0] // 2


def test_quality_edges(spark):
    df = edge_docs(spark)
    labels = spark.createDataFrame([(4, 1), (4, 1), (5, 0), (None, 1), (3, None), (3, 1), (3, 0)], "doc_id long, quality int")
    got = quality.query(df, labels).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    assert quality.query(df, labels.limit(0)).count() == 8 and quality.query(df.limit(0), labels).count() == 0
    assert quality.kept(df, quality.train(df, labels)).columns == df.columns


# Quality rules


def test_rules_base_against_brute_force(spark, documents):
    for r in documents.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        places = defaultdict(list)
        for i in range(len(words) - 4):
            places[tuple(words[i : i + 5])].append(i)
        again = {i + k for v in places.values() if len(v) > 1 for i in v for k in range(5)}
        seen, dup = set(), 0
        for line in r.text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        assert rules.measures(r.text)[:5] == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", r.text)), dup, len(again))


def test_exact_bound():
    for k, n in ((0, 50), (3, 100), (50, 50)):
        bound = rules.lost_bound(k, n, 0.01)
        assert bound == 1.0 or abs(rules.binomial_tail(k, n, bound) - 0.01) < 1e-6
    assert abs(rules.lost_bound(0, 100, 0.05) - (1 - 0.05 ** (1 / 100))) < 1e-9


def test_tails_of_large_holdouts():
    """Some terms decide, however many there are; held against sums of all terms."""
    for k, n, p in ((30, 1000, 0.05), (70, 1000, 0.05), (0, 10, 0.3), (9, 10, 0.3), (500, 1000, 0.0142), (3, 400, 0.0142)):
        plain = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert rules.binomial_tail(k, n, p) == pytest.approx(plain, rel=1e-9)
        assert rules.admitted(k, n, 1e-3, p) == (plain <= 1e-3)
    for k in (13_900, 14_285, 15_000, 900_000):
        assert 0 <= rules.binomial_tail(k, 10**6, 0.1 / 7) <= 1
    assert not rules.admitted(0, 0, 0.1, 0.1) and not rules.admitted(5, 5, 0.1, 0.1)


def test_an_id_is_one_draw_with_one_label(spark):
    text = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(i % 40, text, "en") for i in range(200)] + [(None, text, "en")] * 50, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)] * 2 + [(i, 0) for i in range(10)] + [(11, None), (None, 1)], "doc_id long, quality int")
    counts = rules.good_counts(rules.metrics(docs), labels).collect()
    assert [(r.stratum, r.n) for r in counts] == [("en", 30)]
    assert len(rules.judge(docs, labels).collect()) == 250


def test_rules_keep_their_risk(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = rules.judge(docs, labels).join(labels, "doc_id").where("quality = 1 AND NOT base_failed").groupBy("stratum").agg(F.avg((~F.col("kept")).cast("int")).alias("lost")).collect()
    assert got and all(r.lost <= rules.RISK for r in got)


def test_kept_against_brute_force(spark):
    """Cutoffs and verdicts held against plain counts and the sum of binomial terms."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    rows = {r.doc_id: (r.lang, dict(zip(rules.NAMES[1:], rules.measures(r.text)))) for r in docs.collect()}
    failed = lambda m: m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]
    metric = lambda name, m: eval(rules.RULES[name][0].replace("greatest", "max"), {"max": max}, m)  # noqa: E731, S307
    strata = {lang for d, (lang, m) in rows.items() if d in good and not failed(m)}
    tests, limits = len(rules.RULES) * len(strata), {}
    for lang in strata:
        own = [m for d, (x, m) in rows.items() if x == lang and d in good and not failed(m)]
        for name, (_, grid) in rules.RULES.items():
            for cut in grid:
                k, n, p = sum(metric(name, m) > cut for m in own), len(own), rules.RISK / len(rules.RULES)
                if sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) > rules.LEVEL / tests:
                    break
                limits[lang, name] = cut
    got = rules.judge(docs, labels).collect()
    assert len(got) == len(rows) and limits
    for r in got:
        lang, m = rows[r.doc_id]
        broken = [name for name in rules.RULES if metric(name, m) > limits.get((lang, name), math.inf)]
        assert (r.rejected_by, r.kept) == (",".join(broken), not failed(m) and not broken)


def test_rules_edges(spark):
    df = edge_docs(spark).drop("stratum").withColumn("kept", F.lit(3))
    labels = spark.createDataFrame([(4, 1), (None, 1)], "doc_id long, quality int")
    got = rules.judge(df, labels).collect()
    assert len(got) == 8 and {r.kept for r in got if r.doc_id in (1, 2, 6)} == {False}
    assert next(r for r in got if r.doc_id == 3).n_repeat_words == 30_000
    assert rules.judge(df.limit(0), labels.limit(0)).count() == 0


# Mixing


def test_mix_totals(spark, documents):
    rows = mixing.mix(documents).join(documents.select("doc_id", "source"), "doc_id").collect()
    total = sum(r["size"] for r in rows)
    targets = {r.source: r.target for r in rows}
    assert abs(sum(targets.values()) - total) < 1e-6 * total
    assert all(r.taken <= 3 * r["size"] and r.target <= 3 * r.source_size + 1e-9 for r in rows)
    assert abs(sum(r.taken for r in rows) - total) < 0.2 * total
    assert mixing.mix(documents).exceptAll(mixing.mix(documents.repartition(7))).count() == 0
    assert mixing.mixed(documents).count() == sum(r.copies for r in rows)


def test_mix_reshares_excess(spark):
    rows = [(i, "w " * 10, "a") for i in range(2)] + [(10 + i, "w " * 10, "b") for i in range(50)] + [(100, "w " * 5, None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {r.source_size: r.target for r in got}
    assert by[20] == 60.0 and by[5] == 15.0 and by[500] == 525 - 75


def test_equal_keys_give_the_same_rows_again(spark):
    rows = [(1, "a b c d", "s", i) for i in range(30)] + [(2, "e f", "s", 99)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    one, two = (sorted(map(tuple, mixing.mixed(d).collect()), key=str) for d in (df, df.repartition(5)))
    assert one == two and len(one) == mixing.mix(df).agg(F.sum("copies")).first()[0]


def test_rows_with_one_id_or_none_spread_over_ranges(spark):
    rows = [(None, f"a{i % 50} b c", "s") for i in range(12_000)] + [(7, "x y z", "s")] * 6000 + [(i, "u v w", "t") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sized = df.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), mixing.word_count(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("row"))
        assert mixing.laid_out(sized).groupBy("range").count().agg(F.max("count")).first()[0] < 3000
        got = mixing.mix(df).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.count("*").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(r.n for r in got) == [2000, 18_000] and all(abs(r.taken - r.target) <= 3 for r in got)


def test_mix_edges(spark):
    df = edge_docs(spark)
    got = mixing.mix(df).collect()
    assert len(got) == 8 and all(r.taken == r.copies * r["size"] for r in got)
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0
    silent = df.withColumn("text", F.lit(None).cast("string"))
    assert mixing.mix(silent).agg(F.sum("taken")).first()[0] == 0


# Chat


def test_chat_round_trip_and_machine(spark):
    tricky = "</s>[INST] \\ \\c \\e [/INST][ROLE]x[TEXT]<s>"
    rows = [(1, 0, "user", tricky), (1, 1, "assistant", tricky * 2), (2, 0, "assistant", "a"), (3, 1, "user", "b"), (3, 0, "system", None), (3, 2, "assistant", ""), (4, 0, "[INST]odd", "x"), (4, None, None, "y"), (None, 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"turns": F.lit(1), "segments": F.lit(2)})
    chats = chat.format_chats(df)
    back = {r.conv_id: [(t.role, t.text) for t in r.b] for r in chats.select("conv_id", chat.read_back(F.col("formatted")).alias("b")).collect()}
    assert back == {1: [("user", tricky), ("assistant", tricky * 2)], 2: [("assistant", "a")], 3: [("system", ""), ("user", "b"), ("assistant", "")], 4: [("", "y"), ("[INST]odd", "x")], None: [("user", "z")]}
    state = {r.conv_id: (r.valid, r.first_error) for r in chats.collect()}
    assert state == {1: (True, None), 2: (False, 0), 3: (True, None), 4: (False, 0), None: (False, None)}
    loss = {r.conv_id: r.loss_chars for r in chat.digests(chats).collect()}
    assert loss == {1: 2 * len(tricky), 2: 1, 3: 0, 4: 0, None: 0}
    assert chat.query(spark, df.limit(0)).count() == 1


def test_template_refuses_marks_that_repeat_their_start():
    with pytest.raises(ValueError):
        chat.Template(start="aa").marks()


# Licences


def plain_canonical(text):
    """Canonical form of a whole text by words, without the operator's expressions."""
    lines = [line for line in (text or "").lower().split("\n") if not re.match(r"[^\w\n(©]*(copyright\b.*(\(c\)|©|[0-9]{4})|copyright by\b|\(c\)|©)", line.replace("_", " "))]
    words = re.findall(r"[^\W_]+", "\n".join(lines))
    for old, new in licenses.SPELLINGS:
        old, new, out = old.split(), new.split(), []
        while words:
            if words[: len(old)] == old:
                out, words = out + new, words[len(old) :]
            else:
                out, words = out + words[:1], words[1:]
        words = out
    return " ".join(words)


def test_licenses(spark):
    text = "MIT Licence\nCopyright (c) 2020 Somebody\n\n" + licenses._MIT.replace("sublicense", "Sub-Licence").replace("\n", "\n\n").upper()
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, "a\n released UNDER the MIT licence \nb"), (5, "x Released under the MIT License."), (None, "Licensed under CC BY-NC 4.0."), (6, "a " * 300_000 + "\nSPDX-License-Identifier: MPL-2.0\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"license": F.lit("own"), "row": F.lit(1)})
    got = sorted(((r.doc_id or 0, r.license, r.notices) for r in licenses.scan(df).collect()), key=str)
    assert got == sorted([(1, "MIT", ""), (1, "MIT", ""), (2, None, ""), (3, None, ""), (4, None, "MIT"), (5, None, ""), (0, "CC-BY-NC-4.0", "CC-BY-NC-4.0"), (6, None, "MPL-2.0")], key=str)
    assert licenses.scan(df.limit(0)).count() == 0


def test_every_known_licence_is_found_whatever_its_spelling(spark):
    import hashlib

    rng = np.random.default_rng(0)
    spoil = lambda t: re.sub(r"[ \n]", lambda m: str(rng.choice([" ", "  ", "\n", " \t", ", "])), re.sub(r"\blicense\b", "licence", t).upper())
    own = [(i, spoil(t) + "\n(C) 1999 An Author") for i, (_, t) in enumerate(licenses.KNOWN)]
    got = {r.doc_id: (r.license, r.digest) for r in licenses.scan(spark.createDataFrame(own, "doc_id long, text string")).collect()}
    for i, (name, text) in enumerate(licenses.KNOWN):
        assert got[i] == (name, hashlib.sha256(plain_canonical(own[i][1]).encode()).hexdigest()), text


def test_notices_are_the_lines_that_are_known(spark):
    """Every line is held against every known text, also lines about as long as the longest of them."""
    import hashlib

    known = {plain_canonical(t): name for name, t in licenses.KNOWN}
    longest = max(licenses.KNOWN, key=lambda k: len(k[1]))
    flat = longest[1].replace("\n", " ").replace("license", "sub licence")
    lines = ["MIT License", longest[1].replace("\n", " "), "-,- " * 900 + longest[1].replace("\n", "  ..  "), flat, "Released under CC0 1.0 !", "released under cc0"]
    rows = [(i, "\n".join(["head", line, "tail", line])) for i, line in enumerate(lines)]
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.notices == ",".join(sorted({known[c] for line in rows[r.doc_id][1].split("\n") if (c := plain_canonical(line)) in known}))
        assert r.digest == hashlib.sha256(plain_canonical(rows[r.doc_id][1]).encode()).hexdigest()


def test_known_licences_as_a_table(spark):
    known = spark.createDataFrame([("Own-1.0", "You may do as you like.\nNothing is promised."), ("Own-2.0", None), ("Own-3.0", "")], "license string, text string")
    df = spark.createDataFrame([(1, "you may do as you like, nothing is promised"), (2, ""), (3, "Released under the MIT License.")], "doc_id long, text string")
    assert {r.doc_id: (r.license, r.notices) for r in licenses.scan(df, known).collect()} == {1: ("Own-1.0", "Own-1.0"), 2: (None, ""), 3: (None, "")}


# URLs


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [h + p for h, p, _ in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len) if fits else None


def test_url_rules_and_edges(spark):
    cases = [None, "", "nothing", "http://", "HTTP://WWW.EXAMPLE.COM/en/x?u=://y", "http://example.com/en/", "http://com/", "http://xcom/", "http://a.net/es/", "http://a.net/es", "http://É.NET/fr/?q", "a://b://c/d", "http://h#/en/", "http://x.org/" + "p" * 3000]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)] + [(0, None)], "page_id long, url string").withColumn("row", F.lit(1))
    got = urls.judge(df).collect()
    assert len(got) == len(cases) + 1
    verdicts = {h + p: v for h, p, v in urls.RULES}
    for r in got:
        assert (r.host, r.path, r.rule) == plain_rule(cases[r.page_id])
        assert r.verdict in ("allow", "block") and (r.rule is None or r.verdict == verdicts[r.rule])
    assert urls.judge(df.limit(0)).count() == 0


class PlainModel:
    """Chances of characters by plain recursion, from the texts of one class and all contexts of its own."""

    def __init__(self, texts):
        self.seen, self.all = defaultdict(int), defaultdict(int)
        for t in texts:
            for i in range(urls.ORDER, len(t)):
                for n in range(1, urls.ORDER + 2):
                    self.seen[t[i + 1 - n : i + 1]] += 1
                    self.all[t[i + 1 - n : i], n] += 1

    def chance(self, gram):
        n = len(gram)
        lower = self.chance(gram[1:]) if n > 1 else urls.LEAST
        return (self.seen.get(gram, 0) + urls.LEAN * lower) / (self.all.get((gram[:-1], n), 0) + urls.LEAN)


def plain_scores(judged):
    """Scores of rows by (host, path), and the verdicts of those without a rule."""
    import xxhash

    held = lambda r: int(np.int64(np.uint64(xxhash.xxh64_intdigest(r.host.encode(), 42)))) % urls.CALIBRATION == 0
    chars = lambda r: urls.BEGIN * urls.ORDER + r.host + r.path + urls.END
    yes, no = (PlainModel([chars(r) for r in judged if r.rule_verdict == v and not held(r)]) for v in ("allow", "block"))

    def score(r):
        t = chars(r)
        windows = [t[i - urls.ORDER : i + 1] for i in range(urls.ORDER, len(t))]
        return float(np.mean([math.log(yes.chance(w) / no.chance(w)) for w in windows]))

    known = [(score(r), r.rule_verdict == "allow") for r in judged if r.rule_verdict and held(r)]
    good, bad = sum(k for _, k in known), sum(not k for _, k in known)
    steps = sorted({math.floor(s * urls.STEPS) for s, _ in known}, reverse=True)
    gain = lambda c: sum(k for s, k in known if math.floor(s * urls.STEPS) >= c) / good - sum(not k for s, k in known if math.floor(s * urls.STEPS) >= c) / bad
    cut = max(steps, key=lambda c: (round(gain(c), 12), c)) / urls.STEPS if good and bad and max(map(gain, steps)) > 0 else 0.0
    return {(r.host, r.path): score(r) for r in judged}, cut


@pytest.mark.parametrize("folder, most", [("sf0.001", 16), ("sf0.01", 1 << 18)])
def test_urls_against_two_plain_models(spark, monkeypatch, folder, most):
    monkeypatch.setattr(urls, "SLOTS", most)
    pages = spark.read.parquet(f"/root/testdata/{folder}/pages.parquet")
    pages = pages.unionByName(pages) if most == 16 else pages  # repeated rows
    scores, cut = plain_scores(urls.with_rule(pages).collect())
    rows = urls.judge(pages).collect()
    assert len(rows) == pages.count()
    for r in rows:
        if r.rule is None:
            assert abs(r.score - scores[r.host, r.path]) < 1e-9
            if abs(r.score - cut) > 1e-9:
                assert r.verdict == ("allow" if r.score >= cut else "block")
    judged = urls.with_rule(pages).where(F.pmod(F.xxhash64("host"), F.lit(urls.CALIBRATION)) == 0).where("rule_verdict IS NOT NULL").collect()
    good, bad = ([scores[r.host, r.path] for r in judged if r.rule_verdict == v] for v in ("allow", "block"))
    assert folder == "sf0.001" or np.mean([a > b for a in good for b in bad]) > 0.9


# Top k


def plain_top(rows, k=10):
    """Sorted (query_id, rank, vec_id, score); rows: (id, integer vector), each row on its own."""
    out, low, high = [], -(1 << 63), (1 << 63) - 1
    for at, (q, v) in enumerate(rows):
        if q % 100 == 0:
            scores = [(-max(low, min(high, sum(a * b for a, b in zip(v, w)))), i) for j, (i, w) in enumerate(rows) if j != at and len(w) == len(v)]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def found_top(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.query(df).collect())


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, rng.choice([0.01, 0.2, 2]), 8).astype(np.float32)]) for i in range(900)]
    rows += [(900 + i, rows[0][1]) for i in range(30)] + [(950, [1.0, 2.0]), (1000, [0.5, 0.5]), (960, [0.0] * 8), (1100, [0.0] * 8), (1200, []), (1201, [])]
    rows += [rows[0], (200, rows[7][1]), (7, rows[5][1]), (7, rows[5][1])]  # repeated ids, with equal and other vectors
    bad = [(2000, None), (2002, [None] * 8), (2003, [float("nan")] * 8), (2100, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumns({"grp": F.lit(1), "ids": F.lit(2), "row": F.lit(3), "label": F.lit(None).cast("int")})
    assert found_top(df) == plain_top([(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows])
    assert topk.query(df.limit(0)).count() == 0


def test_top_k_of_large_components_and_long_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(0, 10.0 ** rng.integers(0, 13), 6)]) for i in range(250)]
    rows += [(300, [1.5e6] * 64), (301, [1.5e6] * 64), (302, [-1e300] * 64), (400, [1e-3] * 20_000), (401, [3e6] * 20_000), (500, [3e6, 1.0]), (501, [1.0, 2.0])]
    exact = lambda x: max(-(1 << 63), min((1 << 63) - 1, math.floor(1024 * x)))
    assert found_top(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == plain_top([(i, [exact(x) for x in v]) for i, v in rows])


def test_both_prunings_are_used_and_exact():
    rng = np.random.default_rng(2)
    c = np.round(rng.normal(0, 300, (2000, 16)) * rng.choice([0.2, 1, 4], (2000, 1))).astype(np.int64)
    c[:40] = np.round(c[0] + rng.normal(0, 5, (40, 16)))
    c = c[np.argsort(-(c**2).sum(axis=1), kind="stable")]
    ids, q = np.arange(2000), c[[5, 700, 1900]]
    hot = c[:1] + 0
    q = np.concatenate([q, hot])
    q_ids = np.array([5, 700, 1900, 0])
    found, used = topk.retrieve(q_ids, q, np.full(4, -(1 << 63)), ids, ids, c)
    for (place, got, scores), row in zip(found, q):
        plain = sorted((-int(row @ v), i) for i, v in zip(ids, c) if i != q_ids[place])[:10]
        assert [(-s, i) for s, i in plain] == list(zip(scores.tolist(), got.tolist()))
    assert used["coordinate"] and used["length"] and used["skipped"]


# Very long values and many classes


def test_very_long_texts_and_urls(spark):
    long = "ab </s> \\ " * 200_000
    conversations = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    got = next(r for r in chat.query(spark, conversations).collect() if r.conv_id == 1)
    assert got.loss_chars == len(long) and got.loss_sha256 == hashlib.sha256(long.encode()).hexdigest()
    url = "http://www.example.com/en/" + "a/" * 100_000 + "?q"
    pages = spark.createDataFrame([(1, url, ""), (2, "http://x.org/" + "b" * 100_000, "")], "page_id long, url string, html string")
    rows = {r.page_id: r for r in urls.judge(pages).collect()}
    assert rows[1].verdict == "allow" and rows[1].path == "/en/" + "a/" * 100_000 and rows[2].verdict in ("allow", "block")


def test_many_languages(spark):
    rng = np.random.default_rng(1)
    words = {f"l{i:02d}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)] for i in range(60)}
    rows = [(i, " ".join(rng.choice(words[lang], 30)), lang) for i, lang in enumerate(lang for lang in words for _ in range(12))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.query(docs).collect()}
    out = [r for r in rows if got[r[0]].held_out]
    assert np.mean([got[i].lang_pred == lang for i, _, lang in out]) > 0.9
    with pytest.raises(ValueError, match="languages"):
        langid.train(docs.withColumn("lang", F.concat("lang", F.col("doc_id").cast("string"))).unionByName(docs.withColumn("lang", F.concat(F.lit("x"), F.col("doc_id").cast("string")))), F.lit(True))
