"""MinHash near-duplicates by an LSH forest: documents stand in several sorted signature orders, and those with the longest
common prefixes around a document are its candidates, confirmed on full sets.

What the forest leaves apart meets in an exact join of rare shingles, so no link between groups is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER_BYTES, Scratch, crc_of, is_empty, picture, pictured, prepare
from .graph import components

SHINGLE = 5
PERCENT = 75
SLOTS = 64
TREES = 10
#: Slots of a path, of which a candidate shares LEAST at least, and no more than SLACK fewer than its region is deep.
DEPTH, LEAST, SLACK = 12, 3, 3
NEIGHBOURS = 3
#: Estimates of the similarity from SLOTS values stray by 0.05; the exact join sees to pairs below this one.
CHECK_FROM = 0.6
#: Common shingles come last in the order of the exact join: those seen COMMON times in one of SAMPLE documents, at most
#: ORDERED of them. They set the order and who is dealt out by counts; any choice loses nothing.
SAMPLE, COMMON, ORDERED = 32, 3, 200_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(raw: bytes | None, hashes: WordHashes, width: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles of a UTF-8 text; a shorter text is one shingle, no words none."""
    words = raw.translate(LOWER_BYTES).split() if raw else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(width, len(w))
    out = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        out = mixed(out * MIX + w[j : len(w) - k + 1 + j])
    return np.unique(out)


def _raw(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def _longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _multipliers(slots: int) -> np.ndarray:
    return (np.random.default_rng(20240607).integers(1, 1 << 31, size=(slots, 1), dtype=np.uint32) << np.uint32(1)) | np.uint32(1)


def signature(s: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """The least of each slot's hash over the set."""
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    out = np.full(len(mult), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        y = mult * x[None, at : at + 2048]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        y ^= y >> np.uint32(13)
        np.minimum(out, y.min(1), out=out)
    return out


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles common in a sample, and their counts there; bounded by ORDERED."""

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            sets = [shingle_set(t, hashes) for t in _raw(b)]
            if sets:
                k, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], ["shingle", "n"])

    each = docs.filter(crc_of("doc_id") % SAMPLE == 0).select("text").mapInArrow(run, "shingle long, n long")
    top = each.groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON).orderBy(F.desc("n"), "shingle").limit(ORDERED).toArrow()
    keys, n = _longs(top["shingle"]).view(np.uint64), _longs(top["n"])
    order = np.argsort(keys)
    return keys[order], n[order]


def prefix(s: np.ndarray, keys: np.ndarray, counts: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The first of a set's shingles, rare ones before common, and which are common: two sets at ``percent`` or more share one."""
    k = len(s) - (len(s) * percent + 99) // 100 + 1 if len(s) else 0
    if not k or not len(keys):
        return s[:k], np.zeros(k, bool)
    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
    n = np.where(keys[at] == s, counts[at], 0)
    first = np.lexsort((s, n))[:k]
    return s[first], n[first] > 0


SKETCH = "doc_id long, n_shingles long, h1 long, h2 long, sig binary, firsts binary, n_rare int"


def sketches(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """h1 and h2 name the set, sig holds its slots, firsts its prefix of the exact join, of which the first n_rare are rare."""
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))

    def run(batches):
        (keys, counts), hashes, mult = sent.value, WordHashes(), _multipliers(SLOTS)
        for b in batches:
            n, h1, h2, sig, firsts, rare = [], [], [], [], [], []
            for t in _raw(b):
                s = shingle_set(t, hashes)
                p, common = prefix(s, keys, counts, percent)
                n.append(len(s))
                h1.append(int(np.bitwise_xor.reduce(mixed(s + MIX), initial=0).astype(np.uint64).view(np.int64)))
                h2.append(int(np.add.reduce(mixed(s * MIX + np.uint64(1)), initial=0, dtype=np.uint64).view(np.int64)))
                sig.append(signature(s, mult).astype("<u4").tobytes() if len(s) else None)
                firsts.append(p.astype("<u8").tobytes())
                rare.append(len(p) - int(common.sum()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary()), pa.array(firsts, pa.binary()), pa.array(rare, pa.int32())], [x.split()[0] for x in SKETCH.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SKETCH)


def tree_orders(trees: int = TREES) -> np.ndarray:
    rng = np.random.default_rng(7)
    return np.stack([rng.permutation(SLOTS)[:DEPTH] for _ in range(trees)])


def forest(reps: DataFrame) -> DataFrame:
    """``(path, doc_id)``: a row per document of ``reps(doc_id, sig)`` and tree; path is the tree and its order's slots."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            s = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u4").reshape(b.num_rows, SLOTS)
            for t, order in enumerate(tree_orders()):
                path = np.empty((b.num_rows, DEPTH + 1), ">u2")
                path[:, 0], path[:, 1:] = t, s[:, order] & np.uint32(0xFFFF)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in path], pa.binary()), b.column("doc_id")], ["path", "doc_id"])

    return reps.select("doc_id", "sig").mapInArrow(run, "path binary, doc_id long")


def neighbours(paths: np.ndarray, near: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, the rows k further) that are candidates, for k = 1 to ``near``, in sorted paths.

    A row's region is as deep as its longest common prefix with the rows beside it; candidates share LEAST slots and
    no more than SLACK fewer than the shallower of their two regions.
    """
    shared = [np.cumprod(paths[k:] == paths[:-k], axis=1).sum(1) - 1 for k in range(1, near + 1)]
    deep = np.zeros(len(paths), np.int64)
    if len(paths) > 1:
        deep[1:], deep[:-1] = shared[0], np.maximum(deep[:-1], shared[0])
        deep[1:-1] = np.maximum(shared[0][:-1], shared[0][1:])
    out = []
    for k, lcp in enumerate(shared, 1):
        at = np.flatnonzero(lcp >= np.maximum(LEAST, np.minimum(deep[:-k], deep[k:])[: len(lcp)] - SLACK)) if len(lcp) else np.empty(0, np.int64)
        out.append((at, at + k))
    return out


def candidates(rows: DataFrame) -> DataFrame:
    """Distinct pairs of documents that stand next to each other in an order of ``rows(path, doc_id)``.

    The orders are dealt out by ranges of path and doc_id, so that a crowded region is cut wherever it has to be; the
    two sides of a cut meet in other trees or in the exact join.
    """

    def run(batches):
        old_paths, old_ids = np.empty((0, DEPTH + 1), ">u2"), np.empty(0, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            paths = np.concatenate([old_paths, np.frombuffer(b"".join(b.column("path").to_pylist()), ">u2").reshape(-1, DEPTH + 1)])
            ids, begin = np.concatenate([old_ids, _longs(b.column("doc_id"))]), len(old_ids)
            a, c = [], []
            for x, y in neighbours(paths):
                new = y >= begin
                a.append(ids[x[new]])
                c.append(ids[y[new]])
            a, c = np.concatenate(a), np.concatenate(c)
            old_paths, old_ids = paths[-NEIGHBOURS:], ids[-NEIGHBOURS:]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c)), pa.array(np.maximum(a, c))], ["a", "b"])

    return rows.repartitionByRange("path", "doc_id").sortWithinPartitions("path", "doc_id").mapInArrow(run, "a long, b long").filter("a < b").distinct()


def _with_estimate(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """``(a, b, guess)``: the share of equal slots."""

    def run(batches):
        for p in batches:
            if p.num_rows:
                x, y = (np.frombuffer(b"".join(p.column(c).to_pylist()), "<u4").reshape(-1, SLOTS) for c in ("sig_a", "sig_b"))
                yield pa.RecordBatch.from_arrays([p.column("a"), p.column("b"), pa.array((x == y).mean(1))], ["a", "b", "guess"])

    one = pairs.join(reps.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a")
    two = one.join(reps.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b")
    return two.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long, guess double")


def full_sets(docs: DataFrame) -> DataFrame:
    """``(doc_id, shingles)`` of every row of docs."""

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            sets = [shingle_set(t, hashes).view(np.int64) for t in _raw(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of ``pairs(a, b)``, those with 100 * intersection >= percent * union on full sets."""
    one = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    two = one.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = two.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("n"))
    return both.filter(F.col("i") * 100 >= (F.col("n") - F.col("i")) * percent).select("a", "b").distinct()


def _sets(docs: DataFrame, pairs: DataFrame, scratch: Scratch, name: str, known: DataFrame | None = None) -> DataFrame:
    """``(doc_id, shingles)`` of the ends of ``pairs``, after those already built in ``known``."""
    members = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    if known is not None:
        members = members.join(known.select("doc_id"), "doc_id", "left_anti")
    members = scratch.save(members, f"members-{name}")
    if is_empty(members):
        return known if known is not None else docs.sparkSession.createDataFrame([], "doc_id long, shingles array<long>")
    some = pictured(docs, scratch.save(picture(members), f"picture-{name}"))
    sets = scratch.save(full_sets(some.join(members, "doc_id", "left_semi")), f"sets-{name}")
    return sets if known is None else known.union(sets)


def _across(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose ends no chain of links in ``groups(node, component)`` joins."""
    one = pairs.join(groups.select(F.col("node").alias("a"), F.col("component").alias("ga")), "a", "left")
    two = one.join(groups.select(F.col("node").alias("b"), F.col("component").alias("gb")), "b", "left")
    return two.filter(F.coalesce("ga", "a") != F.coalesce("gb", "b")).select(*pairs.columns)


def _joined(groups: DataFrame, new: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The components of ``groups`` after the links ``new(a, b)``."""
    if is_empty(new):
        return groups
    edges = groups.select(F.col("node").alias("u"), F.col("component").alias("v")).union(new.select("a", "b"))
    return scratch.save(components(edges, scratch, name=f"edges-{name}"), f"groups-{name}")


def _best(pairs: DataFrame) -> DataFrame:
    """Each document's likeliest partner in ``pairs(a, b, guess)``, as distinct pairs."""
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "guess"))
    best = both.groupBy("a").agg(F.max_by("b", F.struct("guess", F.negative("b"))).alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def prefix_rows(sketch: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(shingle, doc_id, n, pos, rare)``: a row per shingle of each prefix; pos is its place in the set's order."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            size = np.array([len(x) // 8 for x in b.column("firsts").to_pylist()], np.int64)
            s = np.frombuffer(b"".join(b.column("firsts").to_pylist()), "<i8")
            pos = np.arange(len(s)) - np.repeat(np.cumsum(size) - size, size)
            for at in range(0, max(1, len(s)), 500_000):
                part = slice(at, at + 500_000)
                of = np.repeat(np.arange(b.num_rows), size)[part]
                yield pa.RecordBatch.from_arrays([pa.array(s[part]), pa.array(_longs(b.column("doc_id"))[of]), pa.array(_longs(b.column("n_shingles"))[of].astype(np.int32)), pa.array(pos[part].astype(np.int32)), pa.array(pos[part] < _longs(b.column("n_rare"))[of])], ["shingle", "doc_id", "n", "pos", "rare"])

    known = sketch.filter("n_shingles > 0 and doc_id is not null")
    return known.select("doc_id", "n_shingles", "firsts", "n_rare").mapInArrow(run, "shingle long, doc_id long, n int, pos int, rare boolean")


def shared_rows(sketch: DataFrame, nodes: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """The rows of ``prefix_rows`` of ``nodes(doc_id, group)`` whose shingle several of them have, with their group."""
    rows = prefix_rows(sketch, percent)
    w = Window.partitionBy("shingle")  # rare ones alone, so no task gets a crowd
    rare = rows.filter("rare").withColumn("low", F.min("doc_id").over(w)).withColumn("high", F.max("doc_id").over(w)).filter("low < high")
    some = scratch.save(rare.select("shingle", "doc_id", "n", "pos"), "shared-rare")
    some = some.union(rows.filter("not rare").select("shingle", "doc_id", "n", "pos"))
    return some.join(nodes, "doc_id")


def between_groups(shared: DataFrame) -> DataFrame:
    """Those of ``shared(shingle, doc_id, n, pos, group)`` whose shingle several groups have; minor: not of its largest group."""
    each = shared.groupBy("shingle", "group").agg(F.count("*").alias("k"))
    met = each.groupBy("shingle").agg(F.max(F.struct("k", "group")).alias("m"), F.count("*").alias("kinds")).filter("kinds > 1").select("shingle", F.col("m.group").alias("big"))
    return shared.join(met, "shingle").withColumn("minor", F.col("group") != F.col("big")).drop("big")


def _led(met: DataFrame) -> DataFrame:
    """A pair for each document of a minor group: with the document of a larger one that most often has fewest rarer
    shingles before the one they share, which is what a group's common original looks like."""
    lead = met.filter("not minor").groupBy("shingle").agg(F.min(F.struct("pos", "doc_id")).alias("l")).select("shingle", F.col("l.doc_id").alias("lead"))
    each = met.filter("minor").join(lead, "shingle").groupBy("doc_id", "lead").agg(F.count("*").alias("k"))
    best = each.groupBy("doc_id").agg(F.max_by("lead", F.struct("k", F.negative("lead"))).alias("lead"))
    return best.select(F.least("doc_id", "lead").alias("a"), F.greatest("doc_id", "lead").alias("b")).distinct()


def exact_pairs(met: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Every pair of different groups in ``met`` that may reach ``percent``, without any limit.

    The rows of a shingle's largest group meet those of the others, never each other, so that a large group joined
    before costs its rows only. Ahead of a shared shingle two sets share no more than either has there in ``met``
    (before), and behind it no more than the shorter rest. The first shingle that two such sets share stands in the first n - need + 1 of either,
    need being the intersection they have to have; and what they share in all is no more than what they share of their
    prefixes and what is left behind the longer rest.
    """
    a, b = met.filter("minor").alias("a"), met.alias("b")
    need = F.ceil((F.col("a.n") + F.col("b.n")).cast("long") * percent / F.lit(100.0 + percent) - 1e-6)
    most = F.least("a.before", "b.before") + 1 + F.least(F.col("a.n") - F.col("a.pos") - 1, F.col("b.n") - F.col("b.pos") - 1)
    once = ~F.col("b.minor") | (F.col("a.doc_id") < F.col("b.doc_id"))
    sizes = (F.col("a.n").cast("long") * 100 >= F.col("b.n").cast("long") * percent) & (F.col("b.n").cast("long") * 100 >= F.col("a.n").cast("long") * percent)
    both = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.group") != F.col("b.group")) & once & sizes & (most >= need))
    rest = lambda n: F.ceil(n.cast("long") * percent / F.lit(100.0) - 1e-6) - 1
    early = ((F.col("a.pos") <= F.col("a.n") - need) & (F.col("b.pos") <= F.col("b.n") - need)).cast("int")
    each = both.select(F.least("a.doc_id", "b.doc_id").alias("a"), F.greatest("a.doc_id", "b.doc_id").alias("b"), early.alias("early"), (need - F.greatest(rest(F.col("a.n")), rest(F.col("b.n")))).alias("least"))
    return each.groupBy("a", "b").agg(F.count("*").alias("k"), F.min("least").alias("least"), F.max("early").alias("early")).filter("k >= least and early = 1").select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_shingles, component_id, kept)``, a row per row of docs.

    Documents of one shingle set are one node, so thousands of copies cost one. Nodes meet beside each other in the
    sorted orders of a forest; pairs that look alike enough are confirmed on full sets, first each node's likeliest
    one, then those that the links found so far have not joined. The forest only saves work: at last all pairs of
    different components that share a shingle of their prefixes and may reach ``percent`` are confirmed, so the
    components are those of all links, up to a clash of 64-bit shingle hashes.
    Null, empty or blank texts have no shingles and are linked with nothing. A null doc_id is linked with nothing, has
    a null component_id and is kept. Rows of one doc_id are one node, which has the links of each of its texts. Other
    columns of docs are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "neardup")
    docs = docs.select("doc_id", "text")
    sketch = scratch.save(sketches(docs, percent), "sketch")
    known = sketch.filter("n_shingles > 0 and doc_id is not null")
    if not is_empty(known.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1")):
        docs = docs.distinct()
    sets_of = scratch.save(known.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("doc_id")), "named")
    reps = scratch.save(known.select("doc_id", "sig").join(sets_of.select("doc_id").distinct(), "doc_id", "left_semi"), "reps")
    pairs = scratch.save(_with_estimate(candidates(forest(reps)), reps).filter(F.col("guess") >= CHECK_FROM), "pairs")
    sets = _sets(docs, pairs, scratch, "forest")
    first = scratch.save(_best(pairs), "pairs-best")
    groups = _joined(spark.createDataFrame([], "node long, component long"), scratch.save(confirmed(first, sets, percent), "links-best"), scratch, "best")
    rest = _across(pairs.select("a", "b").join(first, ["a", "b"], "left_anti"), groups)
    groups = _joined(groups, scratch.save(confirmed(rest, sets, percent), "links-rest"), scratch, "rest")

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("group", F.coalesce("component", "doc_id")).drop("component")

    shared = scratch.save(shared_rows(sketch, grouped(reps.select("doc_id").distinct()), scratch, percent), "shared")
    scratch.drop("shared-rare")
    met = scratch.save(between_groups(shared), "met")
    scratch.drop("shared")
    led = scratch.save(_with_estimate(_led(met), reps).filter(F.col("guess") >= CHECK_FROM).select("a", "b"), "pairs-led")
    sets = _sets(docs, led, scratch, "led", sets)
    groups = _joined(groups, scratch.save(confirmed(led, sets, percent), "links-led"), scratch, "led")
    before = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "shingle")) - 1
    met = scratch.save(between_groups(grouped(met.drop("group", "minor")).withColumn("before", before)), "met-last")
    apart = scratch.save(exact_pairs(met, percent), "pairs-exact")
    scratch.drop("met", "met-last")
    sets = _sets(docs, apart, scratch, "exact", sets)
    groups = _joined(groups, scratch.save(confirmed(apart, sets, percent), "links-exact"), scratch, "exact")
    scratch.drop("sets-forest", "sets-led", "sets-exact", "pairs", "pairs-exact")
    named = sets_of.withColumnRenamed("doc_id", "node").join(groups, "node", "left").select("h1", "h2", "n_shingles", F.coalesce("component", "node").alias("c"))
    out = sketch.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2", "n_shingles"], "left")
    own = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("c"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))
