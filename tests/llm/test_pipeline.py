"""Each stage of the pipeline against a plain version of it, on what the stage before kept."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import langid, toxicity
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_near_dedup import plain as plain_classes
from tests.llm.test_packing import check as check_pieces

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage, written and read again."""
    top = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DIR).write.parquet(path := str(top / name.replace(" ", "-")))
        before, docs = docs, spark.read.parquet(path)
        out[name] = before, docs
    return out


def rows(df):
    return {r["doc_id"]: tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()}


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "line dedup", "near-dedup", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", ["toxicity", "language", "line dedup", "near-dedup"])
def test_stages_keep_the_columns(stages, name):
    before, after = stages[name]
    assert after.dtypes == before.dtypes and 0 < after.count() <= before.count()


def test_toxicity(spark, stages):
    before, after = stages["toxicity"]
    model = toxicity.fit(before, spark.read.parquet(f"{DIR}/labels.parquet"))
    assert rows(after) == {i: r for i, r in rows(before).items() if model.score(toxicity.term_ids(r[1] or "")) < 0.5}
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    kept, gone = rows(after).keys() & toxic.keys(), (rows(before).keys() - rows(after).keys()) & toxic.keys()
    assert sum(toxic[i] for i in gone) > 0.9 * len(gone) and sum(toxic[i] for i in kept) < 0.05 * len(kept)


def test_language_rejects_what_it_cannot_tell(spark, stages):
    docs = stages["language"][0].limit(400).unionByName(spark.createDataFrame([(-1, "12345 ...", "en", "s", 9), (-2, None, "en", "s", None)], "doc_id long, text string, lang string, source string, n_chars long"))
    left = rows(corpus_pipeline.keep_known_language(spark, docs, DIR))
    assert not left.keys() & {-1, -2} and len(left) > 390


def test_language_with_nothing_to_learn_from(spark, stages):
    docs = stages["language"][0].limit(50).withColumn("lang", F.lit(None).cast("string"))
    assert rows(corpus_pipeline.keep_known_language(spark, docs, DIR)).keys() == rows(docs).keys()


def test_language_bound_falls_with_the_number_of_languages(spark, stages):
    """Twelve labels at random for the same texts: certainty is low for want of difference, yet few documents go."""
    docs = stages["language"][0].withColumn("lang", F.concat(F.col("lang"), F.pmod(F.xxhash64("doc_id"), F.lit(3)).cast("string")))
    assert len(rows(corpus_pipeline.keep_known_language(spark, docs, DIR))) > 0.98 * docs.count()


def test_language(stages):
    before, after = stages["language"]
    model, found = langid.fit(before), rows(before)
    known = dict(zip(found, model.predict([r[1] or "" for r in found.values()]), strict=True))
    assert rows(after) == {i: r for i, r in found.items() if known[i][0] != "und" and known[i][1] >= 1.5 / len(model.langs)}
    assert len(rows(after)) > 0.99 * len(found), "clean documents stay"


def test_line_dedup(stages):
    before, after = stages["line dedup"]
    want = {}
    found = rows(before)
    for i, text, _, gone in plain_lines([(r[0], r[1], r[3]) for r in found.values()], 3):
        if not gone:
            want[i] = found[i]
        elif text.strip():
            want[i] = (i, text, *found[i][2:4], len(text))
    assert rows(after) == want


def test_near_dedup(stages):
    before, after = stages["near-dedup"]
    found = rows(before)
    kept = {i for i, _, _, k in plain_classes([(i, r[1]) for i, r in found.items()], 5) if k}
    assert rows(after) == {i: r for i, r in found.items() if i in kept}


def test_packing(stages):
    before, after = stages["packing"]
    check_pieces(after.collect(), [(r[0], r[1]) for r in rows(before).values()], 1024)


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, DIR)
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    total = lambda df: df.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()
    assert sorted(map(tuple, total(got))) == sorted(map(tuple, total(stages["packing"][1])))
    assert set(key) <= set(got.columns)


def test_odd_rows(spark, odd, none, tmp_path):
    labels = spark.createDataFrame([(1, 0, 0), (4, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, none):
        docs = docs.select(*corpus_pipeline.COLUMNS)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(tmp_path)).write.mode("overwrite").parquet(path := str(tmp_path / f"{docs is none}-{id(docs)}-{k}"))
            docs = spark.read.parquet(path)
        assert docs.columns[0] == "doc_id"
