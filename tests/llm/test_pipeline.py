import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")
def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        docs = stage(spark, docs, SMALL)
        assert docs.columns[:5] == list(corpus_pipeline.COLUMNS) and 0 < docs.count() <= before


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LEAK = "one two three four five six seven eight nine ten eleven"
EDGES = [(None, f"before {LEAK} after", "en", "a", 1), (None, "a clean text of no id at all", None, None, None), (3, None, "en", "b", 0), (4, "", None, "b", 0), (5, " ".join(f"w{k}" for k in range(4000)), "en", "a", None), (6, " ".join(f"w{k}" for k in range(4000)), "de", "a", 9), (7, f"{LEAK} twelve", "en", "c", 2), (8, "another clean text", "en", "c", 3), (8, "another clean text", "en", "c", 3)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("edges"))
    spark.createDataFrame([(1, LEAK), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def test_stages_on_nulls_ties_and_long_texts(spark, folder):
    """Extra columns named like an operator's own are there and change nothing."""
    docs = spark.createDataFrame(EDGES, SCHEMA).withColumns({c: F.lit("x") for c in ("score", "kept", "n_words", "of", "rk", "topic", "tokens", "picture_h")})
    by = {name: stage(spark, docs, folder).collect() for name, stage in corpus_pipeline.STAGES}
    ids = lambda name: sorted((r.doc_id for r in by[name]), key=lambda x: (x is None, x))
    assert ids("minhash_dedup") == [3, 4, 5, 7, 8, 8, None, None]
    assert ids("decontamination") == [3, 4, 5, 6, 8, 8, None] and [r.text for r in by["decontamination"] if r.doc_id is None] == ["a clean text of no id at all"]
    assert len(by["substring_dedup"]) == len(EDGES) and [r.text for r in by["substring_dedup"] if r.doc_id == 6] == [""]
    assert {r.text for r in by["substring_dedup"] if r.doc_id in (3, 4)} == {None, ""}
    assert not {3, 4} & set(ids("language_id")) and not {None, 3, 4} & set(ids("target_mix"))


def test_stages_on_an_empty_table(spark, folder):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), folder).count() == 0


def test_clashing_columns_to_keep_are_refused(spark):
    from gridloom.llm import langid, substrings

    docs = spark.createDataFrame([(1, "a", "b", "en")], "doc_id long, text string, score string, lang string")
    with pytest.raises(ValueError):
        langid.identify_languages(docs, ("doc_id", "score"))
    with pytest.raises(ValueError):
        substrings.remove_repeats(docs.withColumnRenamed("score", "n_words"), keep=("n_words",))
