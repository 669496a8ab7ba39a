import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wearloom.llm import bpe, mixing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_stages_keep_columns_and_only_drop_or_repeat(stages):
    names = list(stages)
    for before, after in zip(names[:-2], names[1:-1]):
        assert stages[after].columns == stages["documents"].columns
        assert stages[after].distinct().exceptAll(stages[before].distinct()).count() == 0
    for name in names[1:4]:
        assert stages[name].count() <= stages[names[names.index(name) - 1]].count()


def test_clean_labelled_documents_survive_the_filters(spark, stages):
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    before = stages["documents"].join(good, "doc_id", "left_semi").count()
    assert stages["quality_classifier"].join(good, "doc_id", "left_semi").count() >= 0.97 * before


def test_one_of_each_group(stages):
    from wearloom.llm import simhash

    groups = simhash.near_duplicates(stages["quality_classifier"])
    kept = {r.doc_id for r in stages["simhash_near_dedup"].select("doc_id").collect()}
    assert kept == {r.component_id for r in groups.collect()}


def test_mixing_and_bpe_over_all_rows(stages):
    copies = mixing.mix(stages["simhash_near_dedup"]).agg(F.sum("copies")).first()[0]
    rows = stages["mixing"].collect()
    assert len(rows) == copies
    with open(bpe.default_path(), encoding="utf-8") as f:
        coder = bpe.coder(f.read())
    expected = sorted((r.doc_id, len(x := coder.encode([r.text])[0]) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()) for r in rows)
    assert sorted(map(tuple, stages["bpe"].collect())) == expected


def test_every_stage_with_nulls_repeats_long_texts_and_clashing_columns(spark, tmp_path):
    """Rows are traced by a column of their own; the near-duplicate stage is held against brute force."""
    from tests.llm.test_operators import brute_components, plain_simhash

    real = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    clean = [r for r in real if len(r.text) > 400][:12]
    odd = [
        (None, None, None, None, None), (None, "", "en", "src0", 0), (900, "\n\t ", "en", None, 3), (None, clean[0].text, None, "src1", None), (None, clean[1].text, "en", None, None),
        (None, clean[1].text, "en", None, None), (901, clean[2].text, clean[2].lang, "src1", 7), (901, clean[3].text, clean[3].lang, "src1", 7), (901, clean[3].text, clean[3].lang, "src1", 7),
        (902, clean[4].text, None, "src2", 5), (None, clean[4].text, None, "src2", 5), (903, " ".join([clean[5].text, clean[6].text] * 300), clean[5].lang, "src3", None), (clean[7].doc_id, *clean[7][1:]),
    ]
    rows = [(*r, i) for i, r in enumerate([*map(tuple, real), *odd])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, tag int")
    docs = docs.withColumns({c: F.lit(1) for c in ("key", "_key", "_hash", "row", "fp", "component", "copies", "size", "label", "score")})
    (tmp_path / "sf").mkdir()
    docs.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "sf" / "labels.parquet"))
    now, seen = docs, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, now, str(tmp_path / "sf")).write.parquet(path)
        now = spark.read.parquet(path)
        seen.append(now.collect())
        if name != "bpe":
            assert now.columns == docs.columns
    given, lang, good, single, mix, coded = seen
    assert {r.tag for r in given} - {r.tag for r in lang} >= {len(real), len(real) + 1, len(real) + 2}  # no letters
    of_text = {}
    for rows in (lang, good):  # rows of one text and length stay or go together
        for r in rows:
            of_text.setdefault((id(rows), r.text, r.n_chars), []).append(r.tag)
        assert all(len(t) == sum(x.text == k[1] and x.n_chars == k[2] for x in given) for k, t in of_text.items() if k[0] == id(rows))
    groups = brute_components(list(range(len(good))), [plain_simhash(r.text) for r in good])
    by_tag = {r.tag: groups[i] for i, r in enumerate(good)}
    assert sorted(by_tag[r.tag] for r in single) == sorted(set(groups.values()))
    for r in single:  # the least id of its group, null only where all are
        ids = [x.doc_id for x in good if by_tag[x.tag] == by_tag[r.tag]]
        assert r.doc_id == min((i for i in ids if i is not None), default=None)
    copies = {(r.doc_id, r.size): r.copies for r in mixing.mix(spark.read.parquet(str(tmp_path / "simhash_near_dedup"))).collect()}
    assert len(mix) == sum(copies.values()) and {r.tag for r in mix} <= {r.tag for r in single}
    with open(bpe.default_path(), encoding="utf-8") as f:
        coder = bpe.coder(f.read())
    expected = sorted(((r.doc_id, len(x := coder.encode([r.text])[0]) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()) for r in mix), key=str)
    assert sorted(map(tuple, coded), key=str) == expected


def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() == 0
