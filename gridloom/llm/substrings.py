"""Exact substring dedup by level-wise doubling: windows repeated at one length alone are extended to twice that length."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, picture, pictured, prepare
from .neardup import MIX, WordHashes, mixed

WINDOW = 20


def plain_words(text: str | None) -> list[bytes]:
    """Splits at ASCII white space, letters unchanged."""
    return text.encode("utf-8", "replace").split() if text else []


def word_hashes(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def window_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive words, from those of the halves where k is even."""
    if len(w) < k:
        return np.empty(0, np.uint64)
    if k % 2 == 0:
        half = window_hashes(w, k // 2)
        return mixed(half[: len(w) - k + 1] * np.uint64(0x100000001B3) + half[k // 2 :])
    out = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x100000001B3) + mixed(w[j : len(w) - k + 1 + j] + np.uint64((int(MIX) * (j + 1)) % (1 << 64)))
    return mixed(out)


def slide(x: np.ndarray, k: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of every k consecutive values, by doubling."""
    f, have = (np.minimum if least else np.maximum), 1
    while have < k:
        step = min(have, k - have)
        x = f(x[: len(x) - step], x[step:])
        have += step
    return x


class Row:
    """Many runs of words laid end to end, so that one numpy call serves a batch.

    owner: each word's run; place: its index in the run; live: where a whole window of the run starts.
    """

    def __init__(self, runs: list[np.ndarray], window: int):
        sizes = np.array([len(r) for r in runs], np.int64)
        self.window, self.sizes, self.begins = window, sizes, np.cumsum(sizes) - sizes
        self.words = np.concatenate([*runs, np.empty(0, np.uint64)])
        self.owner = np.repeat(np.arange(len(runs)), sizes)
        self.place = np.arange(len(self.words)) - self.begins[self.owner]
        n = max(0, len(self.words) - window + 1)
        self.live = (self.place + window <= sizes[self.owner])[:n]

    def chosen(self, short: int) -> tuple[np.ndarray, np.ndarray]:
        """Of every window the short window of least hash: those hashes, and the places of all that are chosen somewhere.

        Equal windows choose equal short ones, so a window repeats only if its choice does.
        """
        inside = self.window - short + 1
        if not len(self.live):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        s = window_hashes(self.words, short)
        best = slide(s, inside, True)
        pad = np.zeros(inside - 1, np.uint64)
        most = slide(np.concatenate([pad, np.where(self.live, best, np.uint64(0)), pad]), inside, False)
        return best, np.flatnonzero((most == s) & (most != 0))

    def runs(self, live: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(run, place, words) of neighbouring live windows, each with all its words."""
        live = live & self.live
        start = np.flatnonzero(live & ~np.concatenate([[False], live[:-1]]) | live & (self.place[: len(live)] == 0))
        after = np.concatenate([live[1:], [False]]) & (self.place[1 : len(live) + 1] != 0 if len(self.place) > len(live) else np.concatenate([self.place[1:] != 0, [False]]))
        stop = np.flatnonzero(live & ~after)
        return [(int(self.owner[a]), int(self.place[a]), self.words[a : b + self.window].view(np.int64)) for a, b in zip(start, stop, strict=True)]

    def among(self, best: np.ndarray, wanted: list) -> np.ndarray:
        """Marks windows whose choice is among their own run's wanted hashes."""
        if not len(best):
            return np.zeros(0, bool)
        size = [len(x) for x in wanted]
        key = np.concatenate([*[np.asarray(x, np.int64).view(np.uint64) for x in wanted], np.empty(0, np.uint64)])
        tag = lambda h, who: mixed(h + MIX * (who.astype(np.uint64) + np.uint64(1)))
        return np.isin(tag(best, self.owner[: len(best)]), tag(key, np.repeat(np.arange(len(size)), size)))


def levels(window: int) -> list[int]:
    """Window lengths from a quarter up, each twice the one before: 5, 10, 20."""
    out = [window]
    while out[0] % 2 == 0 and out[0] // 2 >= max(3, window // 4):
        out.insert(0, out[0] // 2)
    return out


def _counted(row: Row, short: int, ids: np.ndarray) -> pd.DataFrame:
    """(h, doc_id, n) of the chosen short windows."""
    at = row.chosen(short)[1]
    h, d = window_hashes(row.words, short)[at] if len(at) else np.empty(0, np.uint64), ids[row.owner[at]] if len(at) else np.empty(0, np.int64)
    return pd.DataFrame({"h": h.view(np.int64), "doc_id": d, "n": 1}).groupby(["h", "doc_id"], as_index=False, sort=False).sum()


def _first_level(docs: DataFrame, short: int, window: int) -> DataFrame:
    """``(h, doc_id)``: the chosen short windows of every document, one row for each distinct hash of a document and how
    often it stands there."""

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            row = Row([word_hashes(plain_words(t), hashes) for t in b["text"]], window)
            yield _counted(row, short, b["doc_id"].to_numpy())

    return docs.mapInPandas(run, "h long, doc_id long, n long")


def _repeated(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(doc_id, hs)``: each document's hashes that stand more than once in all."""
    often = scratch.save(rows.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h"), f"often-{name}")
    some = pictured(rows, scratch.save(picture(often, "h"), f"often-picture-{name}"), "h")
    return some.join(often, "h").groupBy("doc_id").agg(F.collect_list("h").alias("hs"))


def _spans(docs_hs: DataFrame, short: int, window: int) -> DataFrame:
    """``(doc_id, at, ws)``: runs of words whose windows may repeat, as hashes of the words."""

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            row = Row([word_hashes(plain_words(t), hashes) for t in b["text"]], window)
            live = row.among(row.chosen(short)[0], list(b["hs"]))
            ids = b["doc_id"].to_numpy()
            yield pd.DataFrame([(ids[k], at, ws) for k, at, ws in row.runs(live)], columns=["doc_id", "at", "ws"])

    return docs_hs.mapInPandas(run, "doc_id long, at int, ws array<long>")


def _words(b: pd.DataFrame) -> list[np.ndarray]:
    return [np.asarray(ws, np.int64).view(np.uint64) for ws in b["ws"]]


def _level(spans: DataFrame, scratch: Scratch, size: int, window: int) -> DataFrame:
    """Keeps of the spans what still may repeat with windows of ``size`` words."""

    def rows(batches):
        for b in batches:
            yield _counted(Row(_words(b), window), size, b["doc_id"].to_numpy())

    def keep(batches):
        for b in batches:
            row = Row(_words(b), window)
            live = row.among(row.chosen(size)[0], list(b["hs"]))
            ids, first = b["doc_id"].to_numpy(), b["at"].to_numpy()
            yield pd.DataFrame([(ids[k], int(first[k]) + at, ws) for k, at, ws in row.runs(live)], columns=["doc_id", "at", "ws"])

    each = scratch.save(spans.mapInPandas(rows, "h long, doc_id long, n long").groupBy("h", "doc_id").agg(F.sum("n").alias("n")), f"rows-{size}")
    joined = spans.join(_repeated(each, scratch, f"{size}"), "doc_id")
    return joined.mapInPandas(keep, "doc_id long, at int, ws array<long>")


def _later(spans: DataFrame, scratch: Scratch, window: int, last: str) -> DataFrame:
    """``(doc_id, starts)``: starts of windows that also start earlier, by doc_id and then place. Hashes of 64 and 32 bits name a window."""

    def rows(batches):
        for b in batches:
            row = Row(_words(b), window)
            at = np.flatnonzero(row.live)
            k = row.owner[at]
            h, g = (window_hashes(w, window)[at] for w in (row.words, mixed(row.words * MIX + np.uint64(3))))
            yield pd.DataFrame({"h": h.view(np.int64), "g": (g >> np.uint64(32)).astype(np.uint32).view(np.int32), "doc_id": b["doc_id"].to_numpy()[k], "at": (b["at"].to_numpy()[k] + row.place[at]).astype(np.int32)})

    each = scratch.save(spans.mapInPandas(rows, "h long, g int, doc_id long, at int"), "windows")
    scratch.drop(last)
    first = scratch.save(each.groupBy("h", "g").agg(F.min(F.struct("doc_id", "at")).alias("f"), F.count("*").alias("n")).filter("n > 1").select("h", "g", "f"), "first")
    later = each.join(first, ["h", "g"]).filter((F.col("doc_id") != F.col("f.doc_id")) | (F.col("at") != F.col("f.at")))
    return later.groupBy("doc_id").agg(F.collect_set("at").alias("starts"))


def copies(docs: DataFrame) -> DataFrame:
    """``(doc_id)`` of documents whose whole text a document of smaller id has: all their windows start earlier there, and
    whatever starts earlier in them starts earlier still in that one. So they need no windows."""
    named = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.sha2("text", 256).alias("name"))
    first = named.groupBy("name").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("name", "first")
    return named.join(first, "name").filter("doc_id > first").select("doc_id").distinct()


def repeated_starts(docs: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """``(doc_id, starts, whole)`` for documents with a window that also starts earlier; whole: all of them do."""
    sizes = levels(window)
    named = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    same = scratch.save(copies(named), "copies")
    drawn = scratch.save(picture(same), "copies-picture")
    named = pictured(named, drawn, inside=False).union(pictured(named, drawn).join(same, "doc_id", "left_anti"))
    rows = scratch.save(_first_level(named, sizes[0], window), "rows")
    hs = scratch.save(_repeated(rows, scratch, "first"), "repeated")
    scratch.drop("rows", "often-first")
    some = pictured(named, scratch.save(picture(hs), "repeated-picture"))
    spans = scratch.save(_spans(some.join(hs, "doc_id"), sizes[0], window), f"spans-{sizes[0]}")
    scratch.drop("repeated")
    for size in sizes[1:-1]:
        more = scratch.save(_level(spans, scratch, size, window), f"spans-{size}")
        scratch.drop(f"rows-{size}", f"often-{size}", f"spans-{size // 2}")
        spans = more
    later = _later(spans, scratch, window, f"spans-{sizes[-2] if len(sizes) > 1 else sizes[0]}")
    starts = scratch.save(later.select("doc_id", "starts", F.lit(False).alias("whole")).union(same.select("doc_id", F.array().cast("array<int>"), F.lit(True))), "starts")
    scratch.drop("windows", "first")
    return starts


def covered(n: int, starts, window: int) -> np.ndarray:
    mark = np.zeros(n + 1, np.int32)
    for s in starts if starts is not None else ():
        if s >= n:
            continue
        mark[s] += 1
        mark[min(n, s + window)] -= 1
    return np.cumsum(mark[:n]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, kept_text)`` and the columns in ``keep``, a row per row of docs.

    A word goes if a window over it also starts earlier (smaller doc_id, or earlier in its document), on the input. Null
    text has no words. A null doc_id takes no part: its text is kept. A doc_id names one text: of repeated rows each is
    that same text, and none is earlier than another. kept_text joins the kept words by one blank. Texts without a
    repeat stay out of the shuffle that brings the others their places. A kept column of a result's name is refused.
    """
    if clash := {"n_words", "n_removed", "kept_sha256", "kept_text"} & set(keep):
        raise ValueError(f"columns to keep have names of results: {sorted(clash)}")
    prepare(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "substrings")
    starts = repeated_starts(docs, scratch, window)
    held = [c for c in keep if c not in ("doc_id", "text")]
    kinds = dict(docs.dtypes)
    schema = ", ".join(["doc_id long", "n_words long", "n_removed long", "kept_sha256 string", "kept_text string", *(["text string"] if "text" in keep else []), *(f"`{c}` {kinds[c]}" for c in held)])

    def run(batches):
        for b in batches:
            out = []
            for t, s, whole in zip(b["text"], b["repeat_starts"], b["repeat_whole"], strict=True):
                words = plain_words(t)
                gone = np.full(len(words), len(words) >= window) if whole else covered(len(words), s, window)
                text = b" ".join(w for w, g in zip(words, gone, strict=True) if not g) if gone.any() else b" ".join(words)
                out.append((len(words), int(gone.sum()), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "replace")))
            got = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256", "kept_text"], index=b.index)
            got.insert(0, "doc_id", b["doc_id"].astype("Int64"))
            if "text" in keep:
                got["text"] = b["text"]
            for c in held:
                got[c] = b[c]
            yield got

    own, drawn = docs.select("doc_id", "text", *held), scratch.save(picture(starts), "starts-picture")
    plain = pictured(own, drawn, inside=False).withColumns({"repeat_starts": F.lit(None).cast("array<int>"), "repeat_whole": F.lit(False)})
    return plain.union(pictured(own, drawn).join(starts.select("doc_id", F.col("starts").alias("repeat_starts"), F.col("whole").alias("repeat_whole")), "doc_id", "left")).mapInPandas(run, schema)
