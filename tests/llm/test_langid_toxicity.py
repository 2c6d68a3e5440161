"""Language identification and toxicity: models against plain restatements, held-out accuracy, edge cases."""

import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from anchorage.llm import langid, toxicity

SF = "/root/testdata/sf0.01"
EDGES = [None, "", "12 !!", "a", "ж" * 50, "word " * 50_000, "same", "same"]


def _probability(counts, order, h, c, d):
    """Interpolated Kneser-Ney by its definition, over 4-gram counts of strings."""
    if order == 0:
        return 1 / (len({g[-1] for g in counts}) + 1)
    if order == 4:
        n = counts
    else:
        n = Counter(g[-order:] for g in {(g[-order - 1 :]) for g in _types(counts, order + 1)})
    of = {g: v for g, v in n.items() if g[:-1] == h}
    total = sum(of.values())
    below = _probability(counts, order - 1, h[1:], c, d)
    if not total:
        return below
    return max(of.get(h + c, 0) - d, 0) / total + d * len(of) / total * below


def _types(counts, size):
    found = set(counts)
    while len(next(iter(found))) > size:
        found = {g[1:] for g in found}
    return found


def test_kneser_ney_by_definition():
    text = "the cat sat on the mat that the rat ate"
    s = langid.symbols(text)
    keys, n = np.unique(langid.grams(s), return_counts=True)
    models = langid.Models({"en": (keys, n)})
    plain = f"   {text} "
    counts = Counter(plain[i : i + 4] for i in range(len(plain) - 3))
    for probe in (text, "zat the qu", "mat"):
        padded = f"   {probe} "
        want = -sum(math.log2(_probability(counts, 4, padded[i : i + 3], padded[i + 3], langid.DISCOUNT)) for i in range(len(padded) - 3))
        bits, size = models.entropies([probe])
        assert size[0] == len(padded) - 3
        assert bits[0, 0] == pytest.approx(want, rel=1e-4)


def test_langid_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.op6_langid(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == 1000
    held = [r for r in found if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held) and not any(r.rejected for r in held)


def test_langid_edges(spark):
    rows = [(i, t, ["en", None][i % 2], 0.5) for i, t in enumerate(EDGES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(2)
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and all(got[i].rejected for i in range(3))
    assert got[6][1:] == got[7][1:] and all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(docs, model, keep="text").columns == docs.columns
    empty = langid.fit(docs.filter("false"))
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}


def test_numbers_are_no_letters():
    for text in ("½ ¼", "²³", "Ⅷ", "①②", "٣", "12", "_", ""):
        assert not len(langid.symbols(text))
    assert len(langid.symbols("Ⅷa"))


def test_rejection_limit(spark):
    """Held-out documents stay; texts unlike every language learned go, however the fold falls."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(langid.training(docs))
    assert all(len(v) == 4 and 1 < v[0] < 4 for v in model["limits"].values())
    rng = random.Random(5)
    junk = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=400)), "".join(rng.choices("бвгдежзиклмн ", k=300)), "zxcv qwpx " * 30, " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=9)) for _ in range(40)), "sphinx quartz judge my vow " * 10]
    found = langid.predict(spark.createDataFrame(list(enumerate(junk)), "doc_id long, text string"), model).collect()
    assert all(r.rejected and r.lang_pred != "und" for r in found)
    short = langid.predict(spark.createDataFrame([(1, "Zq."), (2, "Hm")], "doc_id long, text string"), model).collect()
    assert not any(r.rejected for r in short)  # too short to tell
    kept = langid.predict(docs, model, keep="text").count()
    assert kept == docs.count() - sum(not len(langid.symbols(r.text or "")) for r in docs.collect())


def test_limits_by_definition(spark):
    rows = [(i, f"{w} the cat and {w} dog {i} sat on mats", "en") for i, w in enumerate(["red", "blue", "green", "odd", "large"] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    fold = {r.text for r in docs.filter(langid._back()).collect()}
    grams = lambda texts: np.unique(np.concatenate([langid.grams(langid.symbols(t)) for t in texts]), return_counts=True)
    rest = langid.Models({"en": grams([t for _, t, _ in rows if t not in fold])})
    bits, size = rest.entropies([t for _, t, _ in rows if t in fold])
    mean, between, within, factor = langid.fit(docs, alpha=0.1)["limits"]["en"]
    h = bits[:, 0] / size
    assert len(bits) >= 5 and mean == pytest.approx(np.average(h, weights=size)) and factor == 3.0
    assert within > 0 and between == pytest.approx(np.average((h - mean) ** 2, weights=size), abs=1e-9)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = toxicity.op2_toxicity(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    by = defaultdict(list)
    for r in found:
        by[r.toxic].append(r.predicted)
    assert sum(by[1]) >= 0.9 * len(by[1]) and sum(by[0]) <= 0.01 * len(by[0])


def test_folding_and_exceptions():
    assert toxicity.fold("You 1d10t! ѕtuріd sc@m ＭＯＲＯＮ a1 mail@x.org $$$the") == " you idiot stupid scam moron a mail x org the "
    m = toxicity.Matcher({" trash ": 2.0, " idio": 3.0, " idiot ": 1.0})
    assert m.features("the trash can")[2] == 0
    assert m.features("the trash, can idiots")[0] == 3.0  # punctuation folds to a blank: still the phrase
    assert m.features("trash and idiot")[0] == 5.0
    assert m.features(None) == (0, 0.0, 0)


def _plain_spans(entries, exceptions, folded):
    """The words that count, by looking for each entry and phrase at each place."""
    best, free = {}, []
    for start in range(len(folded)):
        for entry, weight in entries.items():
            if folded.startswith(entry, start):
                best[start] = max(best.get(start, 0.0), weight)
        free += [(start, start + len(p) + 1) for p in exceptions if folded.startswith(f" {p} ", start)]
    return sorted((s, w) for s, w in best.items() if w > 0 and not any(a <= s < b for a, b in free))


def test_matches_equal_naive_search():
    rng = random.Random(6)
    entries = {" trash ": 2.0, " idio": 3.0, " idiot ": 1.0, " can ": 0.5, " clown ": 2.5, " sc": 0.7, " scum ": 4.0}
    m = toxicity.Matcher(entries)
    bits = [*"trash can bin idiot idiots clown fish circus scum pond line the".split(), "1d10t", "$cum", "trаsh", "c4n", "village", "ball", "proof"]
    for _ in range(800):
        folded = toxicity.fold(" ".join(rng.choice(bits) for _ in range(rng.randint(0, 25))))
        assert m.spans(folded) == _plain_spans(entries, toxicity.EXCEPTIONS, folded)


def test_every_entry_above_the_weight_is_kept(spark):
    words = ["".join(chr(97 + (k // 26**i) % 26) for i in range(3)) for k in range(4000)]
    docs = spark.createDataFrame([(i, " ".join(words)) for i in range(60)] + [(100 + i, "calm plain prose") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(300)], "doc_id long, toxic int")
    entries = toxicity.fit(docs, labels)["entries"]
    assert all(f" {w} " in entries for w in words)


def test_long_texts_take_linear_time():
    m = toxicity.Matcher({" idiot ": 1.0, " trash ": 1.0})
    began = time.perf_counter()
    assert m.features("trash can idiot " * 60_000)[2] == 60_000
    assert time.perf_counter() - began < 10  # 900,000 words; quadratic suppression took minutes


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(EDGES)] + [(None, "you idiot", 2.0)], "doc_id long, text string, score double").repartition(2)
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 0), (6, None), (None, 1)], "doc_id long, toxic int")
    for given in (labels, labels.filter("false")):
        got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, given)).collect()}
        assert all(0 <= v <= 1 for v in got.values()) and got[6] == got[7] and got[0] == got[1] == got[2] < got[None]
    assert toxicity.score(docs.filter("false"), {"entries": {" a ": 1.0}, "weights": [0, 1, 1]}).count() == 0


def test_langid_keeps_every_gram(spark):
    letters = [chr(0x4E00 + n) for n in range(62_000 // 2)]  # 31,000 words of one letter: over 60,000 distinct 4-grams
    words = " ".join(letters)
    docs = spark.createDataFrame([(1, words, "zh"), (2, "the cat sat on the mat", "en")], "doc_id long, text string, lang string")
    padded = langid.symbols(words)
    want = np.unique(langid.grams(padded))
    assert len(want) > 60_000
    models = langid.fit(docs)["models"]
    plain = langid.Models({"zh": np.unique(langid.grams(padded), return_counts=True), "en": np.unique(langid.grams(langid.symbols("the cat sat on the mat")), return_counts=True)})
    probes = [" ".join(letters[-50:]), "the cat"]
    assert len(models.tables[4].hashes) == len(plain.tables[4].hashes)
    assert np.allclose(models.entropies(probes)[0], plain.entropies(probes)[0])
