"""I-Match fingerprints: terms in a band of document frequency, sorted, hashed over several random subsets of the lexicon."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, prepare, words_of
from .neardup import MIX, WordHashes, mixed

#: The band: terms in at least this share and at most that share of all documents. A document of w distinct words adds
#: w / (n * LOW) to the number of terms, so that the lexicon has at most (mean distinct words) / LOW terms at any size.
LOW, HIGH = 0.001, 0.2
LEAST_DOCS = 2
#: Subsets keep a term with these chances, so many of each chance: dense ones tell short texts apart, sparse ones long.
CHANCES = (1 / 16, 1 / 64, 1 / 128, 1 / 512)
OF_EACH = 16
#: Terms that a task sums up before it sends them.
FLUSH = 1_000_000


def term_hashes(raw: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct words of a UTF-8 text."""
    words = set(raw.translate(LOWER_BYTES).split())
    return np.unique(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``(term, df)`` over all documents, a term named by its hash; each task sums in bounded memory before rows are sent."""

    def run(batches):
        hashes, keys, sums, waiting, held = WordHashes(), np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

        def merged():
            every = np.concatenate([keys, *waiting])
            weight = np.concatenate([sums, np.ones(len(every) - len(keys), np.int64)])
            k, at = np.unique(every, return_inverse=True)
            return k, np.bincount(at, weight, len(k)).astype(np.int64)

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums)], ["term", "df"])

        for b in batches:
            for t in b.column("text").cast(pa.binary()).to_pylist():
                waiting.append(term_hashes(t or b"", hashes))
                held += len(waiting[-1])
                if held > FLUSH // 4:
                    (keys, sums), waiting, held = merged(), [], 0
                    if len(keys) > FLUSH:
                        yield rows()
                        keys, sums = np.empty(0, np.uint64), np.empty(0, np.int64)
        keys, sums = merged()
        yield rows()

    return docs.select("text").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Lexicon:
    """Terms of the band by their sorted hashes, with their subsets."""

    def __init__(self, terms: list[bytes] | np.ndarray, seed: int = 1):
        named = terms if isinstance(terms, np.ndarray) else np.array([xxhash.xxh3_64_intdigest(t) for t in terms], np.uint64)
        self.terms = np.unique(named)
        self.marks = mixed(self.terms + MIX)
        chances = np.repeat(CHANCES, OF_EACH)
        self.member = np.empty((len(self.terms), len(chances)), bool)
        for k, chance in enumerate(chances):
            dice = mixed(self.terms ^ mixed(np.array([seed * 1000 + k + 1], np.uint64) * MIX))
            self.member[:, k] = (dice >> np.uint64(11)).astype(np.float64) < chance * 2.0**53
        self.hashes = WordHashes()

    def fingerprint(self, text: str | None) -> tuple[str, ...]:
        """The hash over all terms of the band, then one for each subset ('' where no term falls in it).

        A text without a term of the band is named by the hash of its words alone, so equal texts stay equal.
        """
        raw = (text or "").encode("utf-8", "replace")
        words = term_hashes(raw, self.hashes)
        at = np.searchsorted(self.terms, words)
        ids = at[self.terms[np.minimum(at, len(self.terms) - 1)] == words] if len(self.terms) else at[:0]
        if not len(ids):
            return (hashlib.blake2b(b" ".join(words_of(text)), digest_size=8).hexdigest(), *[""] * (len(CHANCES) * OF_EACH))
        first = hashlib.blake2b(self.terms[ids].astype(">u8").tobytes(), digest_size=8).hexdigest()
        inside = self.member[ids]
        sums = mixed(np.where(inside, self.marks[ids][:, None], np.uint64(0)).sum(0, dtype=np.uint64))
        return (first, *("%08x" % (int(h) >> 32) if any_ else "" for h, any_ in zip(sums, inside.any(0), strict=True)))


def likeness(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """The share of equal subset hashes among subsets that hold a term of either text; 1 for equal first hashes."""
    if a[0] == b[0]:
        return 1.0
    used = [(x, y) for x, y in zip(a[1:], b[1:], strict=True) if x or y]
    return sum(x == y for x, y in used) / len(used) if used else 0.0


def build_lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> Lexicon:
    """The band's terms; n counts all documents, empty ones too."""
    n = docs.count()
    band = document_frequencies(docs).filter((F.col("df") >= max(LEAST_DOCS, low * n)) & (F.col("df") <= max(LEAST_DOCS, high * n)))
    return Lexicon(band.select("term").toArrow()["term"].to_numpy().view(np.uint64))


def in_order(docs: DataFrame, rows_each: int = 2000) -> DataFrame:
    """``(part, place, k, tie, doc_id, packed)``: documents dealt by ranges of doc_id, each part ending with the next part's
    first document (place 1; place 0 otherwise), the last part with the very first document. Null ids come last, rows of
    one id follow each other by a hash of their text. Texts travel compressed."""
    key = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    ids = docs.select(key.alias("k"))
    n = ids.count()
    parts = max(1, min(n // rows_each + 1, 1 << 20))
    cuts = ids.agg(F.percentile_approx("k", [j / parts for j in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    cuts = np.unique(np.array(cuts or [], np.int64))

    def part_of(batches):
        for b in batches:
            p = np.searchsorted(cuts, b.column("k").to_numpy(zero_copy_only=False), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), b.column("k")], ["p", "k"])

    firsts = {r["p"]: r["k"] for r in ids.mapInArrow(part_of, "p int, k long").groupBy("p").agg(F.min("k").alias("k")).collect()}
    order = sorted(firsts)
    before = dict(zip(order, [order[-1], *order[:-1]], strict=True)) if order else {}

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for b in batches:
            k = b.column("k").to_numpy(zero_copy_only=False)
            p = np.searchsorted(cuts, k, side="right")
            packed = [squeeze.compress(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
            also = [j for j in range(len(k)) if firsts[p[j]] == k[j]]
            at = [*range(len(k)), *also]
            part = [*p.tolist(), *(before[p[j]] for j in also)]
            place = [0] * len(k) + [1] * len(also)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(place, pa.int32()), *(b.column(c).take(pa.array(at, pa.int64())) for c in ("k", "tie", "doc_id")), pa.array([packed[j] for j in at], pa.binary())], ["part", "place", "k", "tie", "doc_id", "packed"])

    dealt = docs.select("doc_id", "text", key.alias("k"), F.xxhash64("text").alias("tie")).mapInArrow(pack, "part int, place int, k long, tie long, doc_id long, packed binary")
    return dealt.repartition("part").sortWithinPartitions("part", "place", "k", "tie")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: its fingerprint, that of its edited text (the last half replaced by the next document's beginning) and how
    alike the text's fingerprint is to it and to the next document's.

    Null text is empty. Rows of one doc_id follow each other by a hash of their text, except where they begin a part: then
    one of them stands for the next. A single document is its own next. The band's lexicon is broadcast: it has at most
    (mean distinct words) / LOW terms of 73 bytes, at any number of documents.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lexicon = spark.sparkContext.broadcast(build_lexicon(docs))

    def row(lex, own, nxt):
        doc_id, text, f = own
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[1][:half]
        fe = lex.fingerprint(edited)
        return doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), ":".join(f), ":".join(fe), likeness(f, fe), likeness(f, nxt[2])

    def run(batches):
        lex, unpack = lexicon.value, zstandard.ZstdDecompressor()
        last = part = None
        ended = False
        for b in batches:
            out = []
            for doc_id, packed, place, p in zip(b["doc_id"].astype("Int64"), b["packed"], b["place"], b["part"], strict=True):
                if p != part:
                    last, part, ended = None, p, False
                if ended:
                    continue
                text = unpack.decompress(packed).decode("utf-8", "replace")
                now = (doc_id, text, lex.fingerprint(text))
                if last is not None:
                    out.append(row(lex, last, now))
                last, ended = now, place == 1
            yield pd.DataFrame(out, columns=[x.split()[0] for x in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})

    return in_order(docs).mapInPandas(run, SCHEMA)
