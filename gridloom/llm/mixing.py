"""Mixing sources to target weights: raking of token weights to marginals, then a sample by calibrated probabilities.

DataFrame functions only. Documents are counted once into cells of source, language and topic; the fitting runs on the
cells, whose number depends on the categories and not on the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

DIMENSIONS = ("source", "lang", "topic")
#: A category's target share is its token share to this power, scaled to 1: rare categories gain.
FLATTEN = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Rounds at least, in plans of PER_PLAN, and on until no marginal is off by more than this share of its goal, or MOST rounds.
ROUNDS, PER_PLAN, MOST = 12, 3, 60
CLOSE = 1e-3
RATE = 0.5
SEED = "mix-1"
SPACE = "[\\x20\\x09-\\x0D]+"


def token_count(text: Column) -> Column:
    """Words between ASCII white space; null and blank texts have none."""
    parts = F.split(text, SPACE)
    edges = (F.element_at(parts, 1) == "").cast("int") + ((F.element_at(parts, -1) == "") & (F.size(parts) > 1)).cast("int")
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(F.size(parts) - edges).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic from the shape of the whole text: table, symbols, shout or prose; null and empty: empty."""
    n = F.length(text)

    def share(chars: str) -> Column:
        out = F.lit(0)
        for c in chars:
            out = out + n - F.length(F.replace(text, F.lit(c), F.lit("")))
        return out

    return (
        F.when(text.isNull() | (text == ""), F.lit("empty"))
        .when(share("|") * 50 > n, F.lit("table"))
        .when(share("#%&*$") * 25 > n, F.lit("symbols"))
        .when(share("!") * 25 > n, F.lit("shout"))
        .otherwise(F.lit("prose"))
    )


def measured(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, source, lang, topic, tokens)`` and held columns; a null category is the category 'unknown'."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in ("source", "lang")]
    return docs.select("doc_id", *named, topic_of(F.col("text")).alias("topic"), token_count(F.col("text")).alias("tokens"), *(F.col(c).alias(f"held_{c}") for c in keep))


def cells(each: DataFrame) -> DataFrame:
    """``(source, lang, topic, tokens, docs)`` of measured documents."""
    return each.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))


def targets(cell: DataFrame, flatten: dict[str, float] = FLATTEN, shares: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Adds ``goal_<dimension>``, the tokens each cell's category is to have in all; they sum to all tokens.

    ``shares`` gives the target weights of a dimension's categories, scaled to 1; a category that is not named gets
    nothing. A dimension without weights has its own shares flattened.
    """
    total = F.sum("tokens").over(Window.partitionBy())
    for d in DIMENSIONS:
        own = F.sum("tokens").over(Window.partitionBy(d))
        cell = cell.withColumn(f"own_{d}", own.cast("double"))
    cell = cell.withColumn("all_tokens", total.cast("double"))
    for d in DIMENSIONS:
        if shares and d in shares:
            weights = F.create_map(*(F.lit(x) for k, v in shares[d].items() for x in (k, float(v))))
            power = F.when(F.col(f"own_{d}") > 0, F.coalesce(F.try_element_at(weights, F.col(d)), F.lit(0.0))).otherwise(F.lit(0.0))
        else:
            power = F.when(F.col(f"own_{d}") > 0, F.pow(F.col(f"own_{d}"), F.lit(flatten[d]))).otherwise(F.lit(0.0))
        first = F.row_number().over(Window.partitionBy(d).orderBy(*DIMENSIONS)) == 1
        cell = cell.withColumn(f"pow_{d}", power).withColumn("one", F.when(first, F.col(f"pow_{d}")).otherwise(F.lit(0.0)))
        cell = cell.withColumn(f"goal_{d}", F.col("all_tokens") * F.try_divide(F.col(f"pow_{d}"), F.sum("one").over(Window.partitionBy())))
    return cell.select(*DIMENSIONS, "tokens", "docs", "all_tokens", *(f"goal_{d}" for d in DIMENSIONS))


def misfit(fitted: DataFrame) -> float:
    """The largest share by which a category's weight is off its goal, where it has one."""
    out = 0.0
    for d in DIMENSIONS:
        off = fitted.groupBy(d).agg(F.sum("weight").alias("w"), F.first(f"goal_{d}").alias("g")).filter("g > 0")
        out = max(out, off.agg(F.max(F.abs(F.col("w") / F.col("g") - 1))).first()[0] or 0.0)
    return out


def rake(cell: DataFrame, scratch: Scratch, rounds: int = ROUNDS, shares: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Iterative proportional fitting: ``weight`` is the tokens a cell is to have, fitted to each marginal in turn.

    After ``rounds`` it goes on until the marginals are met to CLOSE, MOST rounds at most: goals that contradict the empty
    cells are never met.
    """
    now = scratch.save(targets(cell, shares=shares).withColumn("weight", F.col("tokens").cast("double")), "rake-0")
    done = 0
    while done < rounds or (done < MOST and misfit(now) > CLOSE):
        step = PER_PLAN if done >= rounds else min(PER_PLAN, rounds - done)
        for _ in range(step):
            for d in DIMENSIONS:
                have = F.sum("weight").over(Window.partitionBy(d))
                now = now.withColumn("weight", F.coalesce(F.col("weight") * F.try_divide(F.col(f"goal_{d}"), have), F.lit(0.0)))
        done += step
        now = scratch.save(now, f"rake-{done}")
    return now


def probabilities(fitted: DataFrame, rate: float = RATE) -> DataFrame:
    """``factor``: weight by tokens; ``probability``: of a document of the cell, so that all in all ``rate`` of the tokens
    stay where no cell is short of them (a probability stops at 1, and ``factor`` says what a reader would repeat)."""
    factor = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(0.0))
    return fitted.select(*DIMENSIONS, F.round(factor, 9).alias("factor"), F.round(F.least(F.lit(1.0), factor * rate), 9).alias("probability"))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number from 0 to 1 that is always the same for an id."""
    return F.conv(F.substring(F.md5(F.concat(doc_id.cast("string"), F.lit(f":{seed}"))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mix(docs: DataFrame, rate: float = RATE, rounds: int = ROUNDS, keep: tuple[str, ...] = (), shares: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """``docs(doc_id, text, lang, source)`` -> a row per document: ``(doc_id, source, lang, topic, tokens, factor,
    probability, sampled)`` and the columns named in ``keep``.

    ``shares`` are target weights as in ``targets``. A null source or language counts as 'unknown'; a document without tokens has probability 0. Documents of one id are
    drawn alike; a null id is never drawn. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    keep = tuple(c for c in keep if c != "doc_id")
    small = scratch.save(measured(docs), "measured")
    fitted = probabilities(rake(scratch.save(cells(small), "cells"), scratch, rounds, shares), rate)
    each = measured(docs, keep) if keep else small
    joined = each.join(fitted.select(*DIMENSIONS, "factor", "probability"), list(DIMENSIONS))
    chance = F.when(F.col("tokens") > 0, F.col("probability")).otherwise(F.lit(0.0))
    return joined.select("doc_id", F.col("source").alias("mix_source"), F.col("lang").alias("mix_lang"), "topic", "tokens", "factor", chance.alias("probability"), F.coalesce(draw(F.col("doc_id")) < chance, F.lit(False)).alias("sampled"), *(F.col(f"held_{c}").alias(c) for c in keep))
