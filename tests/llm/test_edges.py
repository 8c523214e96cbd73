"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from gridloom.llm import decontam, imatch, langid, lm, mixing, neardup, substrings, toxicity, urltree, warc

LONG = " ".join(f"word{k}" for k in range(6000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again", "en", "a"), (1, "the quick brown fox jumps over the lazy dog again", "en", "a"),
    (2, None, None, None), (3, "", "en", "b"), (4, "   \t\n", None, "b"), (5, LONG, "en", "a"), (6, LONG, "en", "a"),
    (None, "a text of no id at all", "en", None), (7, "der schnelle braune fuchs springt", "de", "c"), (8, "12345 !!", "de", "c"), (9, "É\u00a0é été", "fr", "c"),
]
CLASH = ("h", "n", "term", "pos", "window_id", "component", "sig", "rid", "n_words", "score", "topic", "tokens", "k", "p")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("term", F.lit("x"))


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_near_duplicates(docs, none):
    got = by_id(neardup.near_duplicates(docs))
    assert sum(map(len, got.values())) == len(ROWS)
    assert [(r.component_id, r.kept) for r in got[1]] == [(1, True)] * 2
    assert (got[6][0].component_id, got[6][0].kept, got[5][0].n_shingles) == (5, False, 5996)
    assert [got[k][0].n_shingles for k in (2, 3, 4, 7, 8)] == [0, 0, 0, 1, 1]
    assert got[None][0].component_id is None and got[None][0].kept
    assert neardup.near_duplicates(none).count() == 0


def test_substrings(docs, none):
    got = by_id(substrings.remove_repeats(docs))
    assert [r.n_removed for r in got[1]] == [0, 0] and got[5][0].n_removed == 0 and got[6][0].n_removed == 6000
    assert got[2][0].n_words == 0 and got[6][0].kept_text == ""
    assert substrings.remove_repeats(none).count() == 0


def test_decontamination(spark, docs, none):
    it = items(spark, [(1, "Brown FOX jumps"), (2, None), (3, ""), (None, "lazy dog"), (10, " ".join(f"word{k}" for k in range(50, 70)))])
    got = by_id(decontam.decontaminate(docs, it))
    assert [(r.n_hit, r.n_items) for r in got[1]] == [(5, 1)] * 2
    assert (got[5][0].n_hit, got[5][0].n_items, got[5][0].contaminated) == (20, 1, True)
    assert (got[2][0].n_words, got[2][0].n_hit, got[None][0].n_hit) == (0, 0, 0)
    assert decontam.decontaminate(none, it).count() == 0
    assert decontam.decontaminate(docs, it.filter("false")).filter("contaminated").count() == 0


def test_language(docs, none):
    got = by_id(langid.identify_languages(docs, steps=30))
    assert sum(map(len, got.values())) == len(ROWS)
    assert all(got[k][0].lang_pred == "und" and got[k][0].score == 0 for k in (2, 3, 4, 8))
    assert langid.identify_languages(none).count() == 0


def test_toxicity(spark, docs, none):
    for lab in (labels(spark, []), labels(spark, [(1, 1, 1), (7, 1, 0), (None, 1, 1), (9, None, None)])):
        rows = toxicity.score_toxicity(docs, lab).collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_toxicity(none, labels(spark, [])).count() == 0


def test_fingerprints(docs, none):
    got = by_id(imatch.fingerprints(docs))
    assert sum(map(len, got.values())) == len(ROWS)
    assert got[5][0].fingerprint == got[6][0].fingerprint and got[5][0].near_next == 1.0
    assert got[2][0].n_chars == 0 and got[2][0].fingerprint == got[3][0].fingerprint
    assert imatch.fingerprints(none).count() == 0


def test_lm(docs, none):
    rows = lm.score_documents(docs).collect()
    assert len(rows) == len(ROWS) and all(r.score < 0 and r.n_known <= r.n_tokens for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert lm.score_documents(none).count() == 0


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and all(not r.sampled for r in rows if r.doc_id is None or r.tokens == 0)
    assert mixing.mix(none).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "http://X.Example.COM/en/1?q#f"), (3, "http://X.Example.COM/en/1?q#f"), (None, "https://a.org"), (5, "a://b.net/es/://c.com/"), (6, "http://" + "/y" * 3000)], "page_id long, url string").withColumn("host", F.lit("x"))
    got = urltree.judge(pages, spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "page_id long, good int")).collect()
    assert len(got) == 7
    one = {r.page_id: r for r in got}
    assert (one[1].host, one[2].path, one[3].host, one[3].rule, one[3].verdict) == ("", "", "x.example.com", "example.com/en/", "block")
    assert (one[5].host, one[5].rule, one[None].host, one[6].host) == ("b.net", "net/es/", "a.org", "")
    assert urltree.judge(pages.filter("false"), spark.createDataFrame([], "page_id long, good int")).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/\r\nb", "x" * 99), (2, None, "x" * 99), (3, "u", "é" * 60), (9, "u", "é" * 60), (3, "u", "é" * 60), (4, "u", None), (None, "u", "é" * 60), (5, "v", "WARC/1.1\r\n\r\n" * 20000)], "page_id long, url string, html string").withColumn("payload", F.lit("x"))
    got = {(r.page_id, r.record_type): (r.payload_bytes, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert got == {(1, "response"): (99, None), (2, "response"): (99, None), (3, "response"): (120, None), (9, "revisit"): (120, 3), (None, "revisit"): (120, 3), (4, "response"): (0, None), (5, "response"): (240000, None)}
    assert warc.round_trip(pages.filter("false")).count() == 0
