"""A training-data pipeline of five stages, each over all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontam, langid, mixing, neardup, substrings
from gridloom.llm.common import Scratch, picture, pictured

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Texts without a letter go, and those whose best language has less than this pooled probability.
LEAST_LANGUAGE_SCORE = 0.35
#: Neither the model (its classes and network) nor near duplicates, repeats and windows can be told in SQL as they are.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go: null and empty texts, those without a letter, those of a low score.

    Learns from the labelled rows of docs itself; an empty table stays empty.
    """
    said = langid.identify_languages(docs, COLUMNS)
    return said.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of smallest id. Documents of null id or without words stay, and rows of
    one doc_id share its fate."""
    scratch = Scratch(spark, "gone")
    gone = scratch.save(neardup.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct(), "ids")
    drawn = scratch.save(picture(gone), "picture")
    return pictured(docs, drawn, inside=False).union(pictured(docs, drawn).join(gone, "doc_id", "left_anti")).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages leave the text; texts without any stay as they are, null and empty ones too."""
    out = substrings.remove_repeats(docs, keep=COLUMNS)
    changed = F.col("n_removed") > 0
    return out.select("doc_id", F.when(changed, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go, each by its own text, whether its id is null or repeated."""
    return decontam.without_hits(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample that meets the marginals. Documents without tokens or of null id are never drawn; an empty table stays empty."""
    mixed = mixing.mix(docs, keep=COLUMNS)
    return mixed.filter("sampled").select(*COLUMNS, "topic", "tokens", "factor", "probability")


STAGES = [
    ("language_id", language_id),
    ("minhash_dedup", minhash_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("target_mix", target_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, f"{k}-{name}")
    return docs
