"""Exact Jaccard links against brute force, and the pipeline's stages against plain versions."""

import random
from collections import defaultdict

import numpy as np

import corpus_pipeline
from anchorage.llm import jaccard, langid, toxicity


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def groups(rows):
    """Component number of each row of (id, text), None without words."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for t in s:
            for j in holders[t]:
                common[j] += 1
            holders[t].append(i)
        for j, c in common.items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) if s else None for i, s in enumerate(sets)], sets


def family(rng, words, base, n, edits):
    """A chain of near copies: each edits a few words of an earlier one."""
    out = [base]
    for _ in range(n):
        copy = rng.choice(out[-6:]).split()
        for _ in range(rng.randint(1, edits)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        out.append(" ".join(copy))
    return out


def corpus():
    rng = random.Random(11)
    words = ["w" + str(i) for i in range(500)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passage = text(60)
    texts = [None, "", " \t", "one", "one", "ONE", "a b c d", "a b c d e", "É x y z v w", "é x y z v w"]
    texts += family(rng, words, text(120), 90, 3) + family(rng, words, text(40), 40, 1) + family(rng, words, text(400), 30, 8)
    texts += [f"{text(rng.randint(0, 12))} {passage} {text(rng.randint(0, 12))}" for _ in range(60)]
    texts += family(rng, words, text(1100), 12, 40) + family(rng, words, text(2300), 8, 60)
    texts += [text(rng.randint(1, 80)) for _ in range(100)] + [text(9000)] * 2
    rng.shuffle(texts)
    return [(3 * i if i != 17 else None, t) for i, t in enumerate(texts)] + [(30, text(50)), (30, text(50))]


def test_links_equal_brute_force(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n long, hi int").repartition(3)
    found, sets = groups(rows)
    least = {}
    for (i, _), g in zip(rows, found):
        if g is not None and i is not None:
            least[g] = min(least.get(g, i), i)
    want = sorted(((i if i is not None else -1, len(s), least.get(g) if g is not None else i) for (i, _), g, s in zip(rows, found, sets)), key=repr)
    for frequent in (24, 3):
        monkeypatch.setattr(jaccard, "FREQUENT", frequent)
        got = sorted(((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in jaccard.link(docs).collect()), key=repr)
        assert got == want
    kept = jaccard.keep_one(docs).collect()
    assert len(kept) == len({g for g in found if g is not None}) + sum(g is None for g in found)
    assert jaccard.link(docs.filter("false")).count() == 0


def test_prefix_keys_meet():
    """Two sets that link have a key that passes the filter of sizes and places, whatever is frequent."""
    rng = np.random.default_rng(2)
    linked = 0
    for _ in range(1500):
        n = int(rng.integers(4, 400))
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        other = np.append(base[int(rng.integers(0, n // 5 + 1)) :], rng.integers(0, 2**63, int(rng.integers(0, n // 5 + 1))).astype(np.uint64))
        a, b = np.unique(base), np.unique(other)
        often = np.sort(rng.choice(base, int(n * rng.choice([0, 0.5, 1])), replace=False))
        counts = rng.integers(24, 90, len(often))
        common = len(np.intersect1d(a, b))
        if len(a) + len(b) > 2 * common and 100 * common >= 80 * (len(a) + len(b) - common):
            linked += 1
            found = [jaccard.index_keys(x, often, counts) for x in (a, b)]
            places = [dict(zip(k.tolist(), zip(p.tolist(), m.tolist()))) for k, p, m, _, _ in found]
            (r, u), (s, v) = (f[3:] for f in found)
            apart = r + s + ((u ^ v) & (2**64 - 1)).bit_count()
            meet = [(places[0][k], places[1][k]) for k in places[0].keys() & places[1].keys()]
            assert any(9 * (min(m, w) + min(len(a) - p, len(b) - q) - 1) >= 4 * (len(a) + len(b)) and (p < r or 9 * apart <= len(a) + len(b)) for (p, m), (q, w) in meet)
    assert linked > 300


def test_keys_grow_with_the_set():
    rng = np.random.default_rng(4)
    for n in (40, 400, 4000, 40_000):
        tokens = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        keys = jaccard.index_keys(tokens, tokens, np.full(n, 30))[0]
        assert len(keys) < 2 * n


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    judged = {r.doc_id for r in langid.predict(docs, langid.fit(langid.training(docs))).filter("not rejected").collect()}
    told = docs.filter(docs.doc_id.isin(list(judged)))
    model = toxicity.fit(told, toxicity.training(spark.read.parquet(f"{sf}/labels.parquet")))
    rows = [(r.doc_id, r.text) for r in told.collect() if toxicity._scorer(model)(r.text)[0] < toxicity.THRESHOLD]
    found, _ = groups(sorted(rows))
    keep = {}
    for (i, _), g in zip(sorted(rows), found):
        keep.setdefault(g if g is not None else ("none", i), i)
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == set(keep.values())
    for r in out:
        assert r.offset + r.length <= 4096
    assert 0.9 * 200 <= len(judged) <= 200
