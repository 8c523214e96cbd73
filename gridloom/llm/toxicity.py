"""Toxicity by non-negative positive-unlabelled learning on word features."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of, prepare, smallest

#: Bounds of the rows learned from: confirmed toxic ones, and unlabelled ones.
POSITIVES = 4000
UNLABELLED = 12000
FEATURES = 400
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")


def word_ids(text: str | None) -> np.ndarray:
    """Hashes of the distinct words of letters of the whole text, lower-cased."""
    return np.array(sorted({zlib.crc32(w.encode()) for w in set(WORD.findall(text.lower()))}), np.uint32) if text else np.empty(0, np.uint32)


@dataclass
class Classifier:
    """features: sorted word hashes; weights and bias of a logistic score."""

    features: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint32))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    bias: float = 0.0

    def score(self, texts: list[str | None]) -> np.ndarray:
        where = {int(f): k for k, f in enumerate(self.features)}
        memo: dict[str, int] = {}
        out = np.full(len(texts), self.bias)
        for k, t in enumerate(texts):
            hit = set()
            for w in set(WORD.findall(t.lower())) if t else ():
                j = memo.get(w)
                if j is None:
                    if len(memo) > 300_000:
                        memo.clear()
                    j = memo[w] = where.get(zlib.crc32(w.encode()), -1)
                if j >= 0:
                    hit.add(j)
            if hit:
                out[k] += self.weights[sorted(hit)].sum()
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _telling(pos: list[np.ndarray], unl: list[np.ndarray], most: int) -> np.ndarray:
    """Words whose share among positives stands out against the unlabelled, by the size of a two-sample z value."""
    ids = np.unique(np.concatenate([*pos, np.empty(0, np.uint32)]))
    count = lambda rows: np.bincount(np.searchsorted(ids, x := np.concatenate([*rows, np.empty(0, np.uint32)]))[np.isin(x, ids)], minlength=len(ids) + 1)[: len(ids)]
    p, u = count(pos), count(unl)
    share_p, share_u = p / max(1, len(pos)), (u + 0.5) / (len(unl) + 1)
    both = (p + u + 0.5) / (len(pos) + len(unl) + 1)
    z = (share_p - share_u) / np.sqrt(both * (1 - np.minimum(both, 0.999)) * (1 / max(1, len(pos)) + 1 / (len(unl) + 1)))
    good = np.flatnonzero((z > 4) & (p >= 3) & (share_p > 1.5 * share_u))
    return np.sort(ids[good[np.argsort(-z[good], kind="stable")][:most]])


def _table(rows: list[np.ndarray], features: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), len(features)), np.float32)
    for k, x in enumerate(rows):
        out[k, np.searchsorted(features, x[np.isin(x, features)])] = 1
    return out


def fit(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, most: int = FEATURES, steps: int = 600, rate: float = 0.05, ridge: float = 1e-4) -> Classifier:
    """Minimises prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)) with the logistic loss.

    Where the estimate of the negatives' risk falls below 0 it has been overfitted: that step climbs it instead.
    """
    prior = min(0.99, max(1e-4, prior))
    if not pos or not unl:
        return Classifier(bias=float(np.log(prior / (1 - prior))))
    features = _telling(pos, unl, most)
    xp, xu = _table(pos, features), _table(unl, features)
    w, b = np.zeros(len(features)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(features) + 1), np.zeros(len(features) + 1)
    sig = lambda s: 1 / (1 + np.exp(-np.clip(s, -30, 30)))
    for step in range(1, steps + 1):
        sp, su = xp @ w + b, xu @ w + b
        gp, gn_p, gn_u = (sig(sp) - 1) / len(sp), sig(sp) / len(sp), sig(su) / len(su)
        negative = np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean()
        if negative >= 0:
            cp, cu = prior * gp - prior * gn_p, gn_u
        else:
            cp, cu = prior * gn_p, -gn_u
        grad = np.append(xp.T @ cp + xu.T @ cu + ridge * w, cp.sum() + cu.sum())
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        move = rate * (1 - 0.9 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    return Classifier(features, w, float(b))


def held_out() -> Column:
    """Rows whose labels are never learned from; a null id counts as held out."""
    return F.coalesce(crc_of("doc_id") % 4 == 2, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Classifier:
    """Learns from a bounded sample: toxic rows by hash of the id, and unlabelled texts likewise.

    The class prior is the share of toxic rows among all labels that may be learned from.
    """
    spark = docs.sparkSession
    prepare(spark)
    fair = labels.filter(~held_out() & F.col("toxic").isNotNull())
    prior = fair.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    order = F.xxhash64(F.col("doc_id"), F.lit(5))
    toxic = smallest(fair.filter("toxic = 1").select("doc_id").distinct(), positives, order, "doc_id").select("doc_id", F.lit(1).alias("kind"))
    other = smallest(docs.filter(~held_out()).select("doc_id"), unlabelled, order, "doc_id").distinct().select("doc_id", F.lit(0).alias("kind"))
    ids = toxic.union(other).limit(positives + unlabelled)  # bounded by the two parameters, so it may be broadcast

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"kind": b["kind"], "ids": [word_ids(t).view(np.int32) for t in b["text"]]})

    got = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("kind", "text").mapInPandas(run, "kind int, ids array<int>").toPandas()
    rows = {k: [np.asarray(x, np.int32).view(np.uint32) for x in got.loc[got["kind"] == k, "ids"]] for k in (0, 1)}
    for v in rows.values():
        v.sort(key=lambda x: (len(x), x.tobytes()))
    return fit(rows[1], rows[0], prior or 0.0)


def score(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` with ``score`` and ``predicted`` of every whole text; null and empty texts get the bias."""
    prepare(docs.sparkSession)

    @F.pandas_udf("double")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(list(text)))

    return docs.select(*keep, run("text").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of docs; without labels every score is near 0."""
    model = train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), model, keep=("doc_id", "held_out"))
