"""Language-model scoring: a log-bilinear model of two words of context, trained in numpy by noise-contrastive estimation.

Every word of the corpus has a row in the model: frequent words one of their own, the others one with the words of the
same ending, in which each has its smoothed share. Counts are taken over the whole training part of the corpus, and the
vectors are fitted on every place of it: places are dealt into parts, each part goes on from the same model over its share
of a round, and the parts' models are averaged.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from hashlib import blake2b
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, Scratch, crc_of, words_of

END = b" end"
#: Words with an own row, rows of words by their last LETTERS bytes, size of the vectors.
SHORT_LIST, ENDINGS, LETTERS = 256, 256, 3
WIDTH = 16
#: Places of a step, and the noise words they share.
BATCH, NOISE = 1024, 64
#: About so many places make a part, as long as there are no more than PARTS; a part is fitted in ROUNDS shares or more,
#: none above PART. A corpus below PART is one share, passed again up to PASSES times.
PART, PARTS, ROUNDS, PASSES = 1 << 21, 512, 4, 512
#: A longer text is dealt in pieces of so many places.
PIECE = 1 << 14
#: Words whose counts travel to every task; rarer ones are joined.
HEAD = 100_000
ADD = 0.1
FLUSH = 200_000


def tokens(text: str | None) -> list[bytes]:
    return [*words_of(text), END]


def _raw_tokens(raw: bytes | None) -> list[bytes]:
    return [*(raw.translate(LOWER_BYTES).split() if raw else ()), END]


def ending(word: bytes) -> int:
    """The row, among those of endings, of a word that has none of its own."""
    return crc32(word[-LETTERS:]) % ENDINGS


class Rows(dict):
    """The model's row of each word: own rows first, then endings; kept up to a bound."""

    def __init__(self, short: dict[bytes, int]):
        super().__init__(short)
        self.short = short

    def __missing__(self, word: bytes) -> int:
        if len(self) > FLUSH:
            self.clear()
            self.update(self.short)
        k = self[word] = len(self.short) + ending(word)
        return k


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, kind, c)`` over all rows of docs, kind being the ending's row; summed in bounded memory before rows are sent."""

    def rows(seen: Counter) -> pa.RecordBatch:
        words = list(seen)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(map(ending, words), pa.int32()), pa.array(seen.values(), pa.int64())], ["word", "kind", "c"])

    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in b.column("text").cast(pa.binary()).to_pylist():
                seen.update(_raw_tokens(t))
                if len(seen) > FLUSH:
                    yield rows(seen)
                    seen.clear()
        yield rows(seen)

    return docs.select("text").mapInArrow(run, "word binary, kind int, c long").groupBy("word", "kind").agg(F.sum("c").alias("c"))


def with_context(ids: np.ndarray, end: int) -> np.ndarray:
    """(two words before, word before, word) of each place, as rows of the model; a text begins after two ends."""
    before = np.concatenate([[end, end], ids])
    return np.stack([before[:-2], before[1:-1], ids], 1)


def sample_places(docs: DataFrame, short: dict[bytes, int], rate: float) -> np.ndarray:
    """``with_context`` of places taken with the chance ``rate`` all over the corpus, alike in equal texts."""

    def run(batches):
        rows = Rows(short)
        for b in batches:
            out = []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                ids = np.fromiter(map(rows.__getitem__, _raw_tokens(t)), np.int32)
                take = np.random.default_rng(crc32(t or b"")).random(len(ids)) < rate
                out.append(with_context(ids, rows[END])[take])
            if out:
                every = np.concatenate(out).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(every[:, k])) for k in range(3)], ["a", "b", "w"])

    got = docs.select("text").mapInArrow(run, "a int, b int, w int").toArrow()
    places = np.stack([got[c].to_numpy() for c in ("a", "b", "w")], 1).reshape(-1, 3)
    return places[np.lexsort(places.T[::-1])]


def wide_for(rows: int):
    return np.uint16 if rows <= 1 << 16 else np.uint32


def deal(docs: DataFrame, short: dict[bytes, int], parts: int, rounds: int) -> DataFrame:
    """Every place of ``docs(doc_id, text)`` once: ``(round, part, h, ids)``, a piece of a text a row, as rows of the model
    behind the two before it. A piece is dealt by a hash of id, text and offset, so copies do not meet in one part."""
    end, wide = short[END], wide_for(len(short) + ENDINGS)

    def run(batches):
        rows = Rows(short)
        for b in batches:
            out = []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                words = _raw_tokens(t)
                ids = np.fromiter(chain((end, end), map(rows.__getitem__, words)), wide, len(words) + 2)
                name = blake2b(f"{d} ".encode())
                name.update(t or b"")
                for k in range(0, len(words), PIECE):
                    h = int.from_bytes(blake2b(name.digest() + k.to_bytes(8), digest_size=8).digest()) >> 1
                    out.append((h // parts % rounds, h % parts, h, ids[k : k + PIECE + 2].tobytes()))
            if out:
                r, p, h, ids = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(p, pa.int32()), pa.array(h, pa.int64()), pa.array(ids, pa.binary())], ["round", "part", "h", "ids"])

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "round int, part int, h long, ids binary")


def places_of(pieces: list[bytes], wide) -> np.ndarray:
    """(two words before, word before, word) of every place of pieces from ``deal``."""
    every = np.concatenate([np.frombuffer(p, wide) for p in pieces]).astype(np.intp)
    first = np.cumsum([0, *(len(p) // np.dtype(wide).itemsize for p in pieces[:-1])])
    place = np.ones(len(every), bool)
    place[first] = place[first + 1] = False
    w = np.flatnonzero(place)
    return np.stack([every[w - 2], every[w - 1], every[w]], 1)


@dataclass
class Model:
    """vectors: context rows; turns: what turns the vector of each place of the context; targets and bias: the words' side."""

    vectors: np.ndarray
    turns: np.ndarray
    targets: np.ndarray
    bias: np.ndarray

    def flat(self, dtype=np.float64) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.vectors, self.turns, self.targets, self.bias)]).astype(dtype)

    @classmethod
    def of(cls, flat: np.ndarray, rows: int, width: int) -> Model:
        """The model whose arrays are views of ``flat``."""
        v, t, u, b = np.split(flat, np.cumsum([rows * width, 2 * width * width, rows * width]))
        return cls(v.reshape(rows, width), t.reshape(2, width, width), u.reshape(rows, width), b)

    def tables(self, rows: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(far, near, total): the score of a word is far[a, w] + near[b, w] after the words a and b, and total[a, b] the
        logarithm of all words' sum there, from batched matrix products over every context."""
        far, near = ((self.vectors @ m) @ self.targets.T for m in self.turns)
        near = near + self.bias
        total = np.empty((len(far), len(near)), np.float32)
        for at in range(0, len(far), rows):
            s = far[at : at + rows, None, :] + near[None, :, :]
            top = s.max(2)
            total[at : at + rows] = top + np.log(np.exp(s - top[:, :, None]).sum(2))
        return far.astype(np.float32), near.astype(np.float32), total


def start(unigram: np.ndarray, width: int = WIDTH, seed: int = 5) -> Model:
    k, rng = len(unigram), np.random.default_rng(seed)
    return Model(rng.standard_normal((k, width)) * 0.1, np.stack([np.eye(width) * 0.5, np.eye(width)]), rng.standard_normal((k, width)) * 0.1, np.log(unigram / unigram.sum()))


def descend(m: Model, places: np.ndarray, unigram: np.ndarray, seed: tuple[int, ...], passes: int = 1, begin: float = 0.0, finish: float = 1.0, noise: int = NOISE, rate: float = 0.02) -> Model:
    """NCE: tell the word of each place from ``noise`` words drawn from the unigram distribution, one from each of its
    equal slices, for all places of a step together. Every row (a, b, w) of places is met once a pass; the rate falls as
    from ``begin`` to ``finish`` of the whole fit."""
    (k, width), p, rng = m.vectors.shape, unigram / unigram.sum(), np.random.default_rng(seed)
    draw, shift, column = np.cumsum(p), np.log(noise * p).astype(np.float32), np.arange(width)
    flat, f32 = m.flat(np.float32), np.float32
    grad, first, second = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat)
    m, g = Model.of(flat, k, width), Model.of(grad, k, width)
    summed = lambda at, rows: np.bincount((at[:, None] * width + column).ravel(), rows.ravel(), k * width).reshape(k, width).astype(f32)
    each = -(-len(places) // BATCH)
    step, steps = 0, each * passes
    with np.errstate(over="ignore"):
        for _ in range(passes):
            for some in np.array_split(rng.permutation(len(places)), each):
                a, b, w = places[some].T
                words = np.minimum(np.searchsorted(draw, (np.arange(noise) + rng.random(noise)) / noise), k - 1)
                guess = (m.vectors @ m.turns[0])[a] + (m.vectors @ m.turns[1])[b]
                back, others, over = m.targets[w], m.targets[words], m.bias - shift
                true = f32(-1 / len(some)) / (1 + np.exp(np.einsum("nd,nd->n", guess, back) + over[w]))
                false = f32(1 / len(some)) / (1 + np.exp(-(guess @ others.T + over[words])))
                back *= true[:, None]
                back += false @ others
                far, near = summed(a, back), summed(b, back)
                g.vectors[:] = far @ m.turns[0].T + near @ m.turns[1].T
                g.turns[:] = m.vectors.T @ far, m.vectors.T @ near
                g.targets[:] = summed(w, guess * true[:, None])
                np.add.at(g.targets, words, false.T @ guess)
                g.bias[:] = np.bincount(w, true, k)
                np.add.at(g.bias, words, false.sum(0))
                first += f32(0.1) * (grad - first)
                second += f32(0.001) * (grad * grad - second)
                now = rate * (1 - 0.95 * (begin + (finish - begin) * step / steps))
                step += 1
                flat -= f32(now / (1 - 0.9**step)) * first / (np.sqrt(second / f32(1 - 0.999**step)) + f32(1e-10))
    return Model.of(flat.astype(np.float64), k, width)


def passes_for(n: int) -> int:
    return min(PASSES, -(-PART // max(1, n)))


def fit(places: np.ndarray, unigram: np.ndarray) -> Model:
    """The model of places that fit in memory: as ``fit_all`` for one part."""
    m = start(unigram)
    return descend(m, places, unigram, (0, 0), passes_for(len(places))) if len(places) else m


def fit_all(docs: DataFrame, short: dict[bytes, int], unigram: np.ndarray, total: int, scratch: Scratch, part: int = PART) -> tuple[Model, int]:
    """The model fitted on each of the ``total`` places of ``docs(doc_id, text)``, and how many places were met.

    The result does not depend on how docs are partitioned: parts and rounds follow from ids and texts, a part's places
    are put in order, and the parts' models are averaged in order, weighted by their places.
    """
    m = start(unigram)
    parts = max(1, min(PARTS, -(-total // part)))
    rounds = 1 if parts == 1 else max(ROUNDS, -(-total // (parts * part)))
    passes, wide = passes_for(total) if parts == 1 else 1, wide_for(len(unigram))
    dealt, met = deal(docs, short, parts, rounds), 0
    dealt.write.option("compression", "zstd").partitionBy("round").parquet(scratch.path("places"))
    dealt = docs.sparkSession.read.schema(dealt.schema).parquet(scratch.path("places"))
    k, width = m.vectors.shape

    def learner(m: Model, r: int):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            p = int(rows["part"].iloc[0])
            places = places_of([x for _, x in sorted(zip(rows["h"], rows["ids"], strict=True))], wide)
            own = descend(m, places, unigram, (r, p), passes, r / rounds, (r + 1) / rounds)
            return pd.DataFrame({"part": [p], "n": [len(places)], "model": [own.flat(np.float32).tobytes()]})

        return run

    for r in range(rounds):
        share = dealt.filter(F.col("round") == r).select("part", "h", "ids").repartition(parts, "part")
        got = sorted(share.groupBy("part").applyInPandas(learner(m, r), "part int, n long, model binary").collect())  # at most PARTS models
        if got:
            n = sum(x["n"] for x in got)
            m, met = Model.of(sum(np.frombuffer(x["model"], np.float32) * (x["n"] / n) for x in got), k, width), met + n
    scratch.settle()
    return m, met


def held_out():
    """Rows that are not learned from; a null id is not held out."""
    return F.coalesce(crc_of("doc_id") % 10 == 0, F.lit(False))


def score_documents(docs: DataFrame, short_list: int = SHORT_LIST, head: int = HEAD, places: int | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, a row per row.

    P(word | two words before) is the model's probability of the word's row, times, for a word without an own row, its
    smoothed share among the words of its ending; a word that was never seen has the share of one more such word there.
    So all probabilities add up to 1 over the V known words and one unknown word for each ending. Null text is empty:
    its one token is the end. Without training rows every word is unknown. The vectors are fitted on every training place;
    only a caller who names a number of ``places`` gets them from about so many, dealt evenly over the corpus.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    docs = docs.select("doc_id", held_out().alias("held_out"), "text")
    seen = docs.filter(~F.col("held_out"))
    counts = scratch.save(word_counts(seen), "counts")
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "word").limit(head).toPandas()
    heads = {bytes(w): int(c) for w, c in zip(top["word"], top["c"], strict=True)}
    short = {w: k for k, w in enumerate(list(dict.fromkeys([*list(heads)[:short_list], END])))}
    mass = np.zeros(ENDINGS)
    for r in counts.groupBy("kind").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # at most ENDINGS rows
        mass[r["kind"]] = r["c"] + ADD * r["n"]
    for w in short:
        if w in heads:
            mass[ending(w)] -= heads[w] + ADD
    mass += ADD
    whole = total + ADD * (kinds + 1)
    unigram = np.concatenate([[heads.get(w, 0) + ADD for w in short], mass])
    if places is None:
        model, met = fit_all(seen, short, unigram, total, scratch)
        if met != total:
            raise ValueError(f"{met} of {total} training places were fitted")
    else:
        model = fit(sample_places(seen, short, min(1.0, places / max(1, total))), unigram)
    tables = model.tables()
    sent = spark.sparkContext.broadcast((heads, short, tables, np.log10(mass)))

    def run(batches):
        heads, short, (far, near, all_), log_mass = sent.value
        rows, own, end = Rows(short), len(short), short[END]
        known = {w: float(np.log10(c + ADD)) for w, c in heads.items()}
        for b in batches:
            out = []
            for rid, doc_id, held, t in zip(b["rid"], b["doc_id"].astype("Int64"), b["held_out"], b["text"], strict=True):
                words = tokens(t)
                ids = np.fromiter(map(rows.__getitem__, words), np.int64, len(words))
                p = with_context(ids, end)
                path = (far[p[:, 0], ids] + near[p[:, 1], ids] - all_[p[:, 0], p[:, 1]]).sum(dtype=np.float64) / np.log(10)
                logs = np.fromiter(map(known.get, words, repeat(np.nan)), np.float64, len(words))
                new, off = np.isnan(logs), ids >= own
                rare = Counter(words[k] for k in np.flatnonzero(new))
                base = float(logs[~new].sum())
                shares = float(logs[~new & off].sum() - log_mass[ids[off] - own].sum())
                rare_own = sum(n for w, n in rare.items() if w in short)
                out.append((rid, doc_id, held, len(words), len(words) - rare.total(), base, float(path) + shares - rare_own * float(np.log10(ADD)), list(rare.keys()), list(rare.values())))
            yield pd.DataFrame(out, columns=["rid", "doc_id", "held_out", "n_tokens", "n_head", "base_part", "score_part", "rare", "rare_n"]).astype({"doc_id": "Int64"})

    first = docs.withColumn("rid", F.monotonically_increasing_id()).mapInPandas(run, "rid long, doc_id long, held_out boolean, n_tokens long, n_head long, base_part double, score_part double, rare array<binary>, rare_n array<long>")
    first = scratch.save(first, "first")
    rare = first.select("rid", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("rid", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("n"))
    least = int(top["c"].min()) if len(top) else 0
    tail = rare.join(counts.filter(F.col("c") <= least), "word", "left")
    c = F.coalesce("c", F.lit(0))
    sums = tail.groupBy("rid").agg(F.sum(F.col("n") * F.log10(c + ADD)).alias("tail"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("tail_known"))
    both = first.select("rid", "doc_id", "held_out", "n_tokens", "n_head", "base_part", "score_part").join(sums, "rid", "left")
    more = F.coalesce("tail", F.lit(0.0))
    return both.select("doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base_part") + more - F.col("n_tokens") * float(np.log10(whole))).alias("base_score"), (F.col("score_part") + more).alias("score"))
