"""Benchmark decontamination by a distributed positional inverted index, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, Scratch, picture, pictured

WINDOW = 10
#: Everything between words; A-Z is lower-cased word by word afterwards, which gives the same words.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def lower_ascii(word: Column) -> Column:
    """Lower-cases A-Z and nothing else; the plain function does where every character is ASCII."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, UPPER.lower()))


def raw_words(text: Column) -> Column:
    """Words in their own case; the first and the last may be empty."""
    return F.split(text, BETWEEN)


def word_count(text: Column) -> Column:
    parts = raw_words(text)
    edges = (F.element_at(parts, 1) == "").cast("int") + ((F.element_at(parts, -1) == "") & (F.size(parts) > 1)).cast("int")
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(parts) - edges).cast("long")


def test_windows(items: DataFrame, scratch: Scratch, window: int = WINDOW, id_col: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """``(window_id, terms)`` for each distinct window, and ``(window_id, item)``. A shorter item is one window."""
    words = F.filter(F.transform(raw_words(F.col("text")), lower_ascii), lambda w: w != "")
    each = items.filter(F.col("text").isNotNull()).select(F.col(id_col).cast("string").alias("item"), words.alias("ws")).filter(F.size("ws") > 0)
    n = F.greatest(F.size("ws") - window, F.lit(0))
    cut = each.select("item", F.explode(F.transform(F.sequence(F.lit(0), n), lambda k: F.slice(F.col("ws"), k + 1, window))).alias("terms"))
    cut = scratch.save(cut.distinct().withColumn("window_id", F.sha2(F.array_join("terms", " "), 256)), "windows")
    return cut.select("window_id", "terms").distinct(), cut.select("window_id", "item").distinct()


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Postings ``(term, doc_id, rk, pos)``, written where the document lies; ``terms(term)`` limits them to those.

    rk tells rows that share a doc_id apart. Null and empty texts have no postings.
    """
    each = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rk"), F.posexplode(raw_words(F.col("text"))).alias("pos", "w")).filter("w != ''")
    posts = each.select(lower_ascii(F.col("w")).alias("term"), "doc_id", "rk", "pos")
    return posts.join(terms, "term", "left_semi") if terms is not None else posts


def rarest(windows: DataFrame, index: DataFrame) -> DataFrame:
    """``(window_id, size, place, offset, term)``: each window's terms from the rarest; a window with a term that has no
    posting is left out, for it occurs nowhere."""
    count = index.groupBy("term").agg(F.count("*").alias("n"))
    at = windows.select("window_id", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term")).join(count, "term")
    ranked = at.groupBy("window_id", "size").agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("r")).filter(F.size("r") == F.col("size"))
    return ranked.select("window_id", "size", F.posexplode("r").alias("place", "t")).select("window_id", "size", "place", "t.offset", "t.term")


def phrase_matches(windows: DataFrame, index: DataFrame, scratch: Scratch) -> DataFrame:
    """``(window_id, size, doc_id, rk, start)`` of every exact occurrence.

    The lists of a window's two rarest terms, less their offsets, are intersected first; what is left meets the lists of
    all its terms at their offsets.
    """
    order = scratch.save(rarest(windows, index), "rarest")
    key = ["window_id", "size", "doc_id", "rk", "start"]
    lead = order.filter("place <= 1").select("term").distinct()
    some = scratch.save(index.join(lead, "term", "left_semi"), "leading")

    def shifted(place: int) -> DataFrame:
        return some.join(order.filter(F.col("place") == place), "term").select("window_id", "size", "doc_id", "rk", (F.col("pos") - F.col("offset")).alias("start"))

    one = shifted(0)
    both = one.filter("size > 1").join(shifted(1), key, "left_semi").union(one.filter("size = 1")).distinct()
    met = scratch.save(both, "met")
    inside = index.join(scratch.save(met.select("doc_id", "rk").distinct(), "met-docs"), ["doc_id", "rk"], "left_semi")
    wanted = met.join(order.select("window_id", "offset", "term"), "window_id").withColumn("pos", F.col("start") + F.col("offset"))
    full = wanted.join(inside.distinct(), ["doc_id", "rk", "term", "pos"]).groupBy(*key).agg(F.count("*").alias("n"))
    return full.filter("n = size").select(*key)


def proximity_matches(windows: DataFrame, index: DataFrame, scratch: Scratch, slop: int = 5) -> DataFrame:
    """``(window_id, doc_id, rk, around)``: places of a window's rarest term with every other term of the window no
    further than its size plus ``slop`` words away, in any order."""
    order = scratch.save(rarest(windows, index), "rarest-near")
    first = index.join(order.filter("place = 0").select("window_id", "size", "term"), "term").select("window_id", "size", "doc_id", "rk", F.col("pos").alias("around")).distinct()
    need = order.select("window_id", "term").distinct()
    goal = need.groupBy("window_id").agg(F.count("*").alias("goal"))
    width = F.col("size") + slop
    block = lambda c: F.floor(c / F.lit(64)).cast("int")
    spread = first.join(need, "window_id").select("*", F.explode(F.sequence(block(F.col("around") - width), block(F.col("around") + width))).alias("block"))
    places = index.join(need.select("term").distinct(), "term", "left_semi").withColumn("block", block(F.col("pos")))
    near = spread.join(places, ["doc_id", "rk", "term", "block"]).filter(F.abs(F.col("pos") - F.col("around")) <= width)
    found = near.groupBy("window_id", "doc_id", "rk", "around").agg(F.countDistinct("term").alias("n"))
    return found.join(goal, "window_id").filter("n = goal").select("window_id", "doc_id", "rk", "around")


#: What a null doc_id is called in postings.
NO_ID = -(1 << 62)


def hit_rows(docs: DataFrame, items: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """``(of, rk, n_hit, n_items, items_sha256)`` of the rows of ``docs(doc_id, text)`` that hold a window; of is the
    doc_id (NO_ID for null), rk tells rows of one doc_id apart by their text."""
    base = docs.select("doc_id", "text").withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    windows, owners = test_windows(items, scratch, window)
    terms = scratch.save(windows.select(F.explode("terms").alias("term")).distinct(), "terms")
    index = scratch.save(build_index(base, terms), "index")
    hits = scratch.save(phrase_matches(windows, index, scratch), "hits")
    words = hits.select("doc_id", "rk", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("pos")).distinct().groupBy("doc_id", "rk").agg(F.count("*").alias("n_hit"))
    named = hits.select("doc_id", "rk", "window_id").distinct().join(owners.filter("item is not null"), "window_id").select("doc_id", "rk", "item").distinct()
    named = named.groupBy("doc_id", "rk").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    found = scratch.save(words.join(named, ["doc_id", "rk"], "left"), "found").withColumnRenamed("doc_id", "of")
    scratch.drop("index")
    return found


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs(doc_id, text)`` and ``items(item_id, text)`` -> ``(doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated)``, a row per row of docs.

    Null has no words; rows with a null doc_id are judged like others; an item of null id names nothing in
    items_sha256 and counts as no item. Without items nothing is hit. Other columns of docs are not read.
    """
    found = hit_rows(docs, items, Scratch(docs.sparkSession, "decontam"), window)
    each = docs.select(F.col("doc_id").alias("own"), F.coalesce("doc_id", F.lit(NO_ID)).alias("of"), F.col("text"), word_count(F.col("text")).alias("n_words"))
    each = each.select("own", "of", F.xxhash64("of", "text").alias("rk"), "n_words")
    out = each.join(found, ["of", "rk"], "left")
    n = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(F.col("own").alias("doc_id"), "n_words", n.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n > 0).alias("contaminated"))


def without_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of items. A row goes by its own text, whatever its
    doc_id; rows that share both share a fate."""
    scratch = Scratch(docs.sparkSession, "decontam")
    found = hit_rows(docs, items, scratch, window).select(F.col("of").alias("hit_of"), F.col("rk").alias("hit_rk"))
    drawn = scratch.save(picture(found, "hit_rk"), "found-picture")
    each = docs.withColumn("own_of", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("own_rk", F.xxhash64("own_of", "text"))
    some = pictured(each, drawn, "own_rk").join(found, (F.col("own_of") == F.col("hit_of")) & (F.col("own_rk") == F.col("hit_rk")), "left_anti")
    return pictured(each, drawn, "own_rk", inside=False).union(some).select(*docs.columns)
