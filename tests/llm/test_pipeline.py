"""The pipeline's stages against plain versions on the test tables."""

from __future__ import annotations

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import brute_classes, brute_cut, check_packing
from tidemark.llm import quality_rules, toxicity


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, spark.createDataFrame(stage(spark, docs, sf_dir).toPandas(), docs.schema)
        assert docs.columns == corpus_pipeline.COLUMNS
        kept[name] = (before.toPandas().set_index("doc_id"), docs.toPandas().set_index("doc_id"))
    before, after = kept["quality"]
    good = quality_rules.op10_quality_rules(spark, sf_dir).where("kept").toPandas()
    assert set(after.index) == set(good.doc_id)
    before, after = kept["toxicity"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    toxic = toxicity.judge(spark.createDataFrame(before.reset_index()), labels).where("toxic").toPandas()
    assert set(after.index) == set(before.index) - set(toxic.doc_id)
    before, after = kept["near_dedup"]
    classes = brute_classes(before.text.to_dict())
    assert set(after.index) == {i for i, c in classes.items() if i == c}
    before, after = kept["suffix_dedup"]
    cut = brute_cut(before.text.to_dict())
    for i, t in after.text.items():
        left = cut[i][0] - cut[i][1]
        assert left - 8 * cut[i][2] - 8 <= len(t.encode()) <= left
    assert (after.n_chars == after.text.str.len()).all()


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert len(rows)
    check_packing(rows)


@pytest.fixture()
def odd_folder(spark, sf_dir, tmp_path):
    """documents with nulls in all columns, empty and very long texts, repeated rows and columns named like results, beside the test's own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long = " ".join(f"word{i % 4999}x{i % 7}" for i in range(60_000))
    good = docs.where("lang = 'en' and length(text) between 600 and 3000").orderBy("doc_id").limit(3).collect()
    rows = [(None, None, None, None, None), (-1, "", "en", "s", 0), (-2, " \n\t ", None, "s", 1), (-3, None, "en", None, None), (-4, long, "en", "s", 9), (-4, long, "en", "s", 9)]
    rows += [(None, good[0]["text"] + " of no id at all", "en", good[0]["source"], 7), (good[1]["doc_id"], good[1]["text"], *good[1][2:4], 3), (-5, good[2]["text"], None, None, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ("kept", "toxic", "p_toxic", "class_id", "sequence_id", "offset", "piece", "length", "start", "_row", "_own", "_id", "_h", "n_words", "distance")
    docs.select(*corpus_pipeline.COLUMNS).unionByName(odd).withColumns({c: F.lit("x") for c in names}).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), [r["doc_id"] for r in good]


def test_odd_rows(spark, odd_folder):
    folder, good = odd_folder
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), "doc_id long, text string, lang string, source string, n_chars long")
        assert docs.columns == corpus_pipeline.COLUMNS
        seen.append(docs.toPandas())
    quality, clean, distinct, cut = seen
    assert not quality.doc_id.isin([-1, -2, -3]).any()  # no words
    assert (quality.doc_id == good[1]).sum() == 2 and quality.doc_id.isna().sum() == 1
    assert len(clean) > 0.8 * len(quality) and clean.doc_id.isna().sum() == 1
    # the copy of a document with a smaller id stays in its stead; a text without an id is no duplicate of any
    assert (distinct.doc_id == -5).sum() == (clean.doc_id == -5).sum() and distinct.doc_id.isna().sum() == 1
    if (clean.doc_id == -5).any():
        assert not (distinct.doc_id == good[2]).any()
    assert sorted(cut.doc_id.dropna().unique()) == sorted(distinct.doc_id.dropna().unique()) and cut.doc_id.isna().sum() == 1
    packed = corpus_pipeline.packed(spark, docs, folder).toPandas()
    check_packing(packed)
    assert collections.Counter(packed[packed.piece == 0].doc_id.isna())[True] == 1


def test_empty_documents(spark, odd_folder, tmp_path):
    folder, _ = odd_folder
    empty = tmp_path / "empty"
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(empty / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(str(empty / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
