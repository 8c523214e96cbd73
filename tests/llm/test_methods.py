"""Each method against a plain version, an exact round trip, or held-out cases."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import decontam, graph, imatch, langid, lm, mixing, neardup, substrings, toxicity, urltree, warc
from gridloom.llm.common import Scratch


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 200), (5, 5)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 160)} | {200: 200, 201: 200}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(3000)]
    docs = []
    for _ in range(6):
        base = rng.choices(vocab, k=200)
        docs.append(base)
        for _ in range(25):
            copy = base[:]
            for _ in range(rng.randint(0, 12)):
                copy[rng.randrange(200)] = rng.choice(vocab)
            docs.append(copy)
    rows = [(k, " ".join(w)) for k, w in enumerate(docs)]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(docs)), 2):
        i = len(sets[a] & sets[b])
        if 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: find(k) for k in range(len(docs))}


def test_near_duplicates_do_not_depend_on_the_forest(spark, monkeypatch):
    """Texts of one long shared passage crowd a region; here the forest meets none of them."""
    monkeypatch.setattr(neardup, "candidates", lambda rows: rows.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).limit(0))
    rng = random.Random(12)
    vocab = [f"w{k}" for k in range(3000)]
    shared = rng.choices(vocab, k=60)
    docs = []
    for _ in range(30):
        own = shared + rng.choices(vocab, k=40)
        docs += [own, own[: rng.randint(85, 98)] + rng.choices(vocab, k=rng.randint(0, 9))]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in docs]
    near = {k: {k} for k in range(len(docs))}
    for a, b in combinations(range(len(docs)), 2):
        i = len(sets[a] & sets[b])
        if 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i) and near[a] is not near[b]:
            near[a] |= near[b]
            for k in near[b]:
                near[k] = near[a]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id long, text string")).collect()}
    assert got == {k: min(g) for k, g in near.items()} and 1 < len(set(got.values())) < len(docs)


def test_substrings_against_windows(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    shared = rng.choices(words, k=60)
    texts = []
    for k in range(30):
        t = rng.choices(words, k=rng.randint(0, 120))
        if k % 3 == 0:
            at = rng.randint(0, len(t))
            t[at:at] = shared[rng.randint(0, 20) : rng.randint(30, 60)]
        if k % 10 == 9:
            t = t + t
        texts.append(t)
    seen, want = set(), []
    for t in texts:
        gone = set()
        for s in range(len(t) - 19):
            w = tuple(t[s : s + 20])
            if w in seen:
                gone |= set(range(s, s + 20))
            seen.add(w)
        want.append(" ".join(x for k, x in enumerate(t) if k not in gone))
    got = {r.doc_id: r.kept_text for r in substrings.remove_repeats(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(texts))] == want and substrings.levels(20) == [5, 10, 20]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x x green x blue"), (2, "red green"), (3, "blue " + "x " * 200 + "red green")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "green red blue")], "item_id long, text string")
    s = Scratch(spark, "t")
    w, _ = decontam.test_windows(items, s)
    assert {r.doc_id for r in decontam.proximity_matches(w, decontam.build_index(docs), s, slop=5).collect()} == {1}


def test_rules_against_loops(spark):
    rng = random.Random(1)
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.', 'a.'])}example.{rng.choice(['com', 'net', 'org', 'COM'])}{rng.choice(['', '/en/', '/en', '/es/x', '/fr/1.html?a=/en/', '#/en/'])}" for _ in range(200)]

    def plain(u):
        rest = u.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, rest = rest[:end].lower(), rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] + [len(rest)])]
        fit = [r for r in urltree.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fit, key=lambda r: len(r[1] + r[2]), default=None)
        return host, path, best and best[1] + best[2], best and best[0]

    rule, action = urltree.rule_of(F.col("h"), F.col("p"))
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", urltree.host_of(F.col("u")).alias("h"), urltree.path_of(F.col("u")).alias("p")).select("u", "h", "p", rule, action).collect()
    assert all(tuple(r)[1:] == plain(r.u) for r in got)


def test_templates_generalise_and_reject(spark):
    rows = [("h", f"/item/{k}", 1) for k in range(40)] + [("h", f"/spam/{k}", 0) for k in range(40)] + [("h", "/about", None)]
    s = Scratch(spark, "t")
    tree = urltree.templates(spark.createDataFrame(rows, "host string, path string, good int"), s)
    pure = {r.template: r.purity for r in urltree.purity(tree).collect()}
    assert pure["/item/*"] > 0.9 and pure["/spam/*"] < 0.1


def test_network_gradients():
    net = langid.new_network(["a", "b"], 3)
    for a in net.arrays():
        a[...] = a * 1.0
    x = np.random.default_rng(0).integers(97, 101, (6, 4)).astype(np.uint8)
    y = np.array([0, 1, 1, 0])
    _, grads = langid._gradients(net, x, y)
    for a, g in zip(net.arrays(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, eps = a[at], 1e-2
        a[at] = old + eps
        up = langid._gradients(net, x, y)[0]
        a[at] = old - eps
        down = langid._gradients(net, x, y)[0]
        a[at] = old
        assert abs((up - down) / (2 * eps) - g[at]) < 2e-2 * max(0.05, abs(g[at]))


def test_network_learns():
    rng = random.Random(2)
    make = lambda parts: " ".join("".join(rng.choices(parts, k=3)) for _ in range(40))
    langs = {"a": ["tio", "ing", "the"], "b": ["sch", "ung", "ein"], "c": ["oux", "eau", "ré"]}
    texts, names = zip(*[(langid.fold(make(p)), k) for k, p in langs.items() for _ in range(30)], strict=True)
    net = langid.fit(list(texts), list(names), steps=120)
    fresh = [(make(p), k) for k, p in langs.items() for _ in range(10)]
    got, score = langid.predict(net, [t for t, _ in fresh] + [None, "123"])
    assert got[:-2] == [k for _, k in fresh] and got[-2:] == ["und", "und"] and all(0 <= s <= 1 for s in score)


def test_positive_unlabelled():
    rng = random.Random(4)
    vocab = [f"v{chr(97 + a)}{chr(97 + b)}" for a in range(26) for b in range(26)]
    make = lambda bad: " ".join(rng.choices(vocab, k=60) + ["vile", "rude"][: 1 + rng.randrange(2)] * bad)
    ids = toxicity.word_ids
    model = toxicity.fit([ids(make(1)) for _ in range(150)], [ids(make(rng.random() < 0.1)) for _ in range(900)], 0.1)
    bad, good = model.score([make(1) for _ in range(60)]), model.score([make(0) for _ in range(200)] + [None, ""])
    assert (bad >= 0.3).mean() > 0.95 and (good >= 0.3).mean() < 0.03


def test_edited_texts_in_order(spark):
    import hashlib

    rng = random.Random(6)
    rows = [(k * 3, "".join(rng.choice("abé 𝄞") for _ in range(rng.randint(0, 40)))) for k in range(300)]
    want = {}
    for k, (i, t) in enumerate(rows):
        n, nxt = len(t) // 2, rows[(k + 1) % len(rows)][1]
        want[i] = (len(t), hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest())
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "doc_id long, text string").repartition(5)
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in imatch.fingerprints(df).collect()} == want


def test_likeness_falls_with_edits():
    rng = random.Random(8)
    vocab = [f"w{k}".encode() for k in range(2000)]
    lex = imatch.Lexicon(vocab)
    near, far = [], []
    for _ in range(40):
        a, b = rng.choices(vocab, k=200), rng.choices(vocab, k=200)
        f = lex.fingerprint(b" ".join(a).decode())
        near.append(imatch.likeness(f, lex.fingerprint(b" ".join(a[:100] + b[:100]).decode())))
        far.append(imatch.likeness(f, lex.fingerprint(b" ".join(b).decode())))
    assert np.mean(near) > np.mean(far) + 0.08


def test_language_model_is_normalised_and_base_is_exact(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choice(["the", "a", "b", f"r{rng.randrange(80)}"]) for _ in range(rng.randint(0, 60)))) for k in range(120)]
    got = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), short_list=5, head=30).collect()}
    from collections import Counter
    from zlib import crc32

    counts = Counter(w for k, t in rows if crc32(str(k).encode()) % 10 for w in lm.tokens(t))
    n, v = sum(counts.values()), len(counts)
    for k, t in rows:
        base = sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in lm.tokens(t))
        assert got[k].base_score == pytest.approx(base, abs=1e-6) and got[k].train_tokens == n
        assert got[k].n_known == sum(w in counts for w in lm.tokens(t)) and got[k].held_out == (crc32(str(k).encode()) % 10 == 0)
    scores = {r.doc_id: r.score for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), short_list=5, head=30, places=900).collect()}
    train = [(k, t) for k, t in rows if crc32(str(k).encode()) % 10]
    own = [*[w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:5]]]
    own += [lm.END] * (lm.END not in own)
    short = {w: k for k, w in enumerate(own)}
    mass = np.full(lm.ENDINGS, 0.1)
    for w, c in counts.items():
        if w not in short:
            mass[lm.ending(w)] += c + 0.1
    row = lambda w: short.get(w, len(short) + lm.ending(w))
    places = []
    for _, t in train:
        ids = np.array([row(w) for w in lm.tokens(t)])
        take = np.random.default_rng(crc32(t.encode())).random(len(ids)) < min(1, 900 / n)
        places += [tuple(x) for x in lm.with_context(ids, short[lm.END])[take]]
    m = lm.fit(np.array(sorted(places)), np.concatenate([[counts[w] + 0.1 for w in own], mass]))

    def word(a, b, w):
        s = (m.vectors[a] @ m.turns[0] + m.vectors[b] @ m.turns[1]) @ m.targets.T + m.bias
        p = np.exp(s[row(w)]) / np.exp(s).sum()
        return p if w in short else p * (counts[w] + 0.1) / mass[lm.ending(w)]

    for k, t in rows[:40]:
        before, want = [short[lm.END]] * 2, 0.0
        for w in lm.tokens(t):
            want += np.log10(word(*before, w))
            before = [before[1], row(w)]
        assert scores[k] == pytest.approx(want, rel=1e-4, abs=1e-3)
    unseen = {lm.ending(w): w for w in (f"zz{x}{y}{z}".encode() for x in "abcdefghijklmnop" for y in "abcdefghijklmnop" for z in "abcdefghijklmnop")}
    assert len(unseen) == lm.ENDINGS and not set(unseen.values()) & set(counts)
    unseen = {e: unseen[e] for e in range(lm.ENDINGS)}
    assert sum(word(0, 1, w) for w in [*counts, *unseen.values()]) == pytest.approx(1, abs=1e-6)


def test_language_model_is_fitted_on_every_place(spark, monkeypatch):
    from collections import Counter

    rng = random.Random(10)
    words = lambda n: " ".join(rng.choice(["the", "a", "b", f"r{rng.randrange(80)}"]) for _ in range(n))
    rows = [(k, words(rng.randint(0, 200))) for k in range(60)] + [(k, "one text that is there many times") for k in range(60, 100)]
    rows += [(100, words(lm.PIECE + 700)), (101, ""), (102, None), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    short = {b"the": 0, b"a": 1, lm.END: 2}
    want = Counter()
    for _, t in rows:
        ids = np.array([short.get(w, 3 + lm.ending(w)) for w in lm.tokens(t)])
        want.update(map(tuple, lm.with_context(ids, 2).tolist()))
    pieces = lm.deal(docs, short, 5, 4).collect()
    got = Counter(tuple(x) for p in pieces for x in lm.places_of([p.ids], lm.wide_for(259)).tolist())
    assert got == want and {p.part for p in pieces} == set(range(5)) and {p["round"] for p in pieces} == set(range(4))
    total, unigram = want.total(), np.full(3 + lm.ENDINGS, 1.0)
    models = [lm.fit_all(docs.repartition(n), short, unigram, total, Scratch(spark, "t"), part=5000) for n in (1, 6)]
    assert [met for _, met in models] == [total, total] and np.array_equal(models[0][0].flat(), models[1][0].flat())
    assert not np.array_equal(models[0][0].flat(), lm.fit_all(docs.filter("doc_id <> 100 or doc_id is null"), short, unigram, total, Scratch(spark, "t"), part=5000)[0].flat())

    def sampled(*_):
        raise AssertionError("the vectors were fitted on a sample")

    monkeypatch.setattr(lm, "sample_places", sampled)
    assert lm.score_documents(docs).count() == len(rows)


def test_rake_meets_marginals(spark):
    rows = [(f"s{a}", f"l{b}", f"t{c}", 100 + 37 * a + 11 * b + 5 * c * a, 10) for a in range(3) for b in range(3) for c in range(2)]
    fit = mixing.rake(spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, docs long"), Scratch(spark, "t")).toPandas()
    for d in mixing.DIMENSIONS:
        each = fit.groupby(d).agg(have=("weight", "sum"), goal=(f"goal_{d}", "first"))
        assert np.allclose(each.have, each.goal, rtol=1e-6)


def test_archive_bytes_come_back(spark):
    texts = {1: "é" * 90_000, 2: "", 3: "plain <html>" * 30}
    pages = spark.createDataFrame(list(texts.items()), "page_id long, html string").withColumn("url", F.lit("http://x/"))
    s = Scratch(spark, "warc-test")
    manifest = warc.write_archives(warc.plan_records(pages, s), s, roll=1000)
    rows = warc.read_chunks(manifest, data=True).orderBy("page_id", "chunk_no").collect()
    for k, t in texts.items():
        assert b"".join(bytes(r.data) for r in rows if r.page_id == k).decode() == t
    assert max(r.chunk_bytes for r in rows) <= warc.CHUNK and sum(r["last"] for r in rows) == 3


def test_templates_at_any_depth(spark):
    """Branches that part below fifty shared segments get verdicts of their own, in a few steps."""
    deep = "/y" * 50
    rows = [("h", f"{deep}/good/{k}", 1) for k in range(30)] + [("h", f"{deep}/bad/{k}", 0) for k in range(30)] + [("g", "/z" * 3000, None), ("e", "", None)]
    tree = urltree.templates(spark.createDataFrame(rows, "host string, path string, good int"), Scratch(spark, "t"))
    pure = {r.template: r.purity for r in urltree.purity(tree).collect()}
    assert pure[f"{deep}/good/*"] > 0.9 and pure[f"{deep}/bad/*"] < 0.1 and "/z" * 3000 in pure and "" in pure


def test_rake_to_given_weights(spark):
    rows = [(f"s{a}", f"l{b}", f"t{c}", 100 + 37 * a + 11 * b + 5 * c * a, 10) for a in range(3) for b in range(3) for c in range(2)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, docs long")
    fit = mixing.rake(cells, Scratch(spark, "t"), shares={"source": {"s0": 1, "s1": 3}}).toPandas()
    share = fit.groupby("source").weight.sum() / fit.weight.sum()
    assert share["s0"] == pytest.approx(0.25, abs=2e-3) and share["s1"] == pytest.approx(0.75, abs=2e-3) and share["s2"] == 0
    assert mixing.misfit(spark.createDataFrame(fit)) <= mixing.CLOSE
