"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of, prepare, smallest

UNKNOWN = "und"
#: About this many labelled documents are learned from (one of each language at least), and CUTS pieces of CUT_CHARS
#: characters of each, from its beginning to its end.
SAMPLE_DOCS = 3000
CUTS, CUT_CHARS = 8, 150
SEGMENT = 64
LETTER = re.compile(r"[^\W\d_]")
#: A-Z lower-cased; bytes that are no letters become blanks.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def fold(text: str) -> bytes:
    return b" ".join(text.encode("utf-8", "replace").translate(FOLD).split())


@dataclass
class Network:
    """inputs[d]: 256 x 3H (a byte's share of the gates: update, reset, candidate); inner[d]: H x 3H; out: 2H x L."""

    languages: list[str]
    inputs: list[np.ndarray]
    inner: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [*self.inputs, *self.inner, self.out, self.bias]


def new_network(languages: list[str], hidden: int, seed: int = 3) -> Network:
    rng = np.random.default_rng(seed)
    f = lambda *s, k=0.3: (rng.standard_normal(s) * k).astype(np.float32)
    return Network(languages, [f(256, 3 * hidden) for _ in "lr"], [f(hidden, 3 * hidden) for _ in "lr"], f(2 * hidden, len(languages)), np.zeros(len(languages), np.float32))


def _run(net: Network, d: int, x: np.ndarray, keep: bool = False):
    """States of one direction over x (steps x rows of bytes); d = 1 reads from the end."""
    steps, rows = x.shape
    hid = net.inner[d].shape[0]
    h = np.zeros((rows, hid), np.float32)
    states, past = np.empty((steps, rows, hid), np.float32), []
    for t in range(steps)[:: 1 - 2 * d]:
        a = net.inputs[d][x[t]]
        u = h @ net.inner[d]
        zr = a[:, : 2 * hid] + u[:, : 2 * hid]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        z, r = zr[:, :hid], zr[:, hid:]
        n = r * u[:, 2 * hid :]
        n += a[:, 2 * hid :]
        np.tanh(n, out=n)
        if keep:
            past.append((t, h, z, r, n, u[:, 2 * hid :]))
        h = n + z * (h - n)
        states[t] = h
    return states, past


def _softmax(s: np.ndarray) -> np.ndarray:
    s -= s.max(-1, keepdims=True)
    np.exp(s, out=s)
    s /= s.sum(-1, keepdims=True)
    return s


def label_positions(net: Network, x: np.ndarray) -> np.ndarray:
    """Probabilities of each language at every position: steps x rows x languages."""
    left, right = _run(net, 0, x)[0], _run(net, 1, x)[0]
    hid = left.shape[2]
    s = left.reshape(-1, hid) @ net.out[:hid]
    s += right.reshape(-1, hid) @ net.out[hid:]
    s += net.bias
    return _softmax(s).reshape(*x.shape, -1)


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Cross-entropy over all positions and its gradients, back through time in both directions."""
    steps, rows = x.shape
    runs = [_run(net, d, x, True) for d in (0, 1)]
    hid = net.inner[0].shape[0]
    both = np.concatenate([runs[0][0], runs[1][0]], 2)
    p = _softmax(both @ net.out + net.bias)
    valid = (x != 0)[..., None]
    count = max(1, valid.sum())
    loss = -np.log(np.take_along_axis(p, np.broadcast_to(y[None, :, None], (steps, rows, 1)), 2) + 1e-9)[valid].sum() / count
    p[:, np.arange(rows), y] -= 1
    p *= valid / np.float32(count)
    g_out = both.reshape(-1, 2 * hid).T @ p.reshape(-1, p.shape[2])
    g_states = p @ net.out.T
    g_in, g_inner = [], []
    for d in (0, 1):
        gi, gu, dh = np.zeros_like(net.inputs[d]), np.zeros_like(net.inner[d]), np.zeros((rows, hid), np.float32)
        u_n = net.inner[d].T.copy()
        for t, h, z, r, n, un in reversed(runs[d][1]):
            dh = dh + g_states[t][:, d * hid : (d + 1) * hid]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            da = np.concatenate([dz, dr, dn], 1)
            du = np.concatenate([dz, dr, dn * r], 1)
            np.add.at(gi, x[t], da)
            gu += h.T @ du
            dh = dh * z + du @ u_n
        g_in.append(gi)
        g_inner.append(gu)
    return float(loss), [*g_in, *g_inner, g_out, p.reshape(-1, p.shape[2]).sum(0)]


def fit(texts: list[bytes], labels: list[str], hidden: int = 8, steps: int = 320, rows: int = 192, length: int = 32, rate: float = 0.02, seed: int = 3) -> Network:
    """Adam on random cuts; languages are drawn alike often, so that rare ones are learned too."""
    languages = sorted(set(labels))
    net, rng = new_network(languages, hidden, seed), np.random.default_rng(seed)
    by = [[t for t, y in zip(texts, labels, strict=True) if y == lang and t] for lang in languages]
    able = [k for k, v in enumerate(by) if v]
    if len(able) < 2:
        net.bias[able] = 9
        return net
    first, second = [np.zeros_like(a) for a in net.arrays()], [np.zeros_like(a) for a in net.arrays()]
    for step in range(1, steps + 1):
        y = rng.choice(able, rows)
        x = np.zeros((length, rows), np.uint8)
        for c, k in enumerate(y):
            t = by[k][rng.integers(len(by[k]))]
            at = rng.integers(max(1, len(t) - length // 2))
            cut = np.frombuffer(t[at : at + length], np.uint8)
            x[: len(cut), c] = cut
        _, grads = _gradients(net, x, y)
        lr = rate * min(1, step / 20) * (1 - 0.9 * step / steps)
        for a, g, m, v in zip(net.arrays(), grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def predict(net: Network, texts: list[str | None], rows: int = 4096) -> tuple[list[str], list[float]]:
    """The pooled label of every whole text: the mean of its positions' probabilities."""
    known = [t if t is not None and LETTER.search(t) else None for t in texts]
    raw = [fold(t) if t is not None else b"" for t in known]
    if not net.languages:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    pieces = np.array([-(-len(r) // SEGMENT) for r in raw])
    owner = np.repeat(np.arange(len(raw)), pieces)
    flat = np.frombuffer(b"".join(r.ljust(-(-len(r) // SEGMENT) * SEGMENT, b"\0") for r in raw), np.uint8).reshape(-1, SEGMENT)
    total = np.zeros((len(raw), len(net.languages)))
    for at in range(0, len(flat), rows):
        x = np.ascontiguousarray(flat[at : at + rows].T)
        p = label_positions(net, x)
        p *= (x != 0)[..., None]
        np.add.at(total, owner[at : at + rows], p.sum(0))
    size = np.array([max(1, len(r)) for r in raw])
    share = total / size[:, None]
    best = share.argmax(1)
    names = [UNKNOWN if k is None else net.languages[b] for k, b in zip(known, best, strict=True)]
    return names, [0.0 if k is None else float(min(1.0, max(0.0, s[b]))) for k, b, s in zip(known, best, share, strict=True)]


def cuts_of(text: Column, cuts: int = CUTS, chars: int = CUT_CHARS) -> Column:
    """Pieces at even distances over the whole text; a text no longer than they are together is taken whole."""
    n = F.length(text)
    each = [F.substring(text, 1 + F.floor((n - chars) * k / F.lit(max(1.0, cuts - 1.0))).cast("int"), F.lit(chars)) for k in range(cuts)]
    return F.when(n <= cuts * chars, text).otherwise(F.concat_ws(" ", *each))


def train(docs: DataFrame, allowed: Column, sample: int = SAMPLE_DOCS, **how) -> Network:
    """Fits on a sample of the rows that ``allowed`` names: alike many of each language, by hash of the id.

    All of a language's rows are taken where it has fewer than its part of ``sample``.
    """
    rows = docs.filter(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Network([], [], [], np.zeros((0, 0)), np.zeros(0))
    each = max(1, sample // len(counts))
    dice = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    shares = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (2 * each + 20) / n))))
    some = rows.filter(dice < F.element_at(shares, F.col("lang"))).select("lang", cuts_of(F.col("text")).alias("text"), F.xxhash64(F.col("doc_id"), F.lit(12)).alias("h"))
    got = smallest(some, 4 * max(sample, len(counts)) + 100, "h", "lang", "text").toPandas()
    got = got[got.groupby("lang").cumcount() < each]
    return fit([fold(t) for t in got["text"]], list(got["lang"]), **how)


def held_out() -> Column:
    """The rows no label is learned from; a null id is not held out."""
    return F.coalesce(crc_of("doc_id") % 3 == 1, F.lit(False))


def identify(docs: DataFrame, net: Network, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> the columns in ``keep`` with ``lang_pred`` and ``score``, from whole texts.

    Null texts and texts without a letter are 'und' with score 0, as is everything if nothing could be learned. A kept
    column of a result's name is refused.
    """
    if clash := {"lang_pred", "score"} & set(keep):
        raise ValueError(f"columns to keep have names of results: {sorted(clash)}")
    prepare(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def run(text: pd.Series) -> pd.DataFrame:
        names, scores = predict(net, list(text))
        return pd.DataFrame({"lang_pred": names, "score": scores})

    out = docs.select(*keep, run("text").alias("said"))
    return out.select(*keep, "said.lang_pred", "said.score")


def identify_languages(docs: DataFrame, keep: tuple[str, ...] = (), **how) -> DataFrame:
    """Learns from the rows that are not held out and labels all: ``(doc_id, held_out, lang_pred, score)``."""
    net = train(docs, ~held_out(), **how)
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text", *(c for c in keep if c not in ("doc_id", "text"))), net, ("doc_id", "held_out", *(c for c in keep if c != "doc_id")))
