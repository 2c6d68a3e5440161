"""Fingerprints and license scans against plain Python."""

import hashlib
import random
import re
import struct

import xxhash
from pyspark.sql import functions as F

from anchorage.llm import imatch, licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
EDGES = [None, "", " ", "!!", "a", "é" * 9, "MİT License", "mit license mit license", "same text here", "same text here"]


def _low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_base_places(spark):
    rng = random.Random(4)
    bits = ["mit", "license", "apache", "general", "public", "licensé", "the", "MIT License", "GPL", "x1"]
    seps = [" ", ", ", "\n", "-", "\x00", "  "]
    texts = EDGES + ["".join(rng.choice(bits) + rng.choice(seps) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts.append("mit license " * 5000)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, labels int").repartition(4)
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        words = WORD.findall(_low(text))
        starts, labels = [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            own = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            starts += own
            labels |= {label} if own else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(starts), min(starts, default=None), max(starts, default=None)), text
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(","))| ({""} if not labels else set())
        assert r.labels.split(",") == sorted(set(r.labels.split(","))) and 0 <= r.score <= 1
    assert licenses.scan(docs.filter("false")).count() == 0


def _detect(text):
    """The rules by definition: every match, then the fold over them."""
    padded = " " + " ".join(WORD.findall(_low(text))) + " "
    found = []
    for rule in licenses.RULES:
        if rule["keyword"] in padded:
            found += [(m.start(), -m.end(), -rule["priority"], m.end(), rule["priority"], rule["label"]) for m in re.finditer(rule["pattern"], padded)]
    kept = []
    for start, _, _, stop, priority, label in sorted(found):
        if not kept or start >= kept[-1][1]:
            kept.append([start, stop, priority, label])
        elif stop > kept[-1][1] and priority > kept[-1][2]:
            kept[-1] = [start, stop, priority, label]
    return kept


def test_rules(spark):
    rng = random.Random(8)
    names = [n.replace(" ?", " ") for _, ns, _ in licenses.FAMILIES for n in ns.split("|")]
    forms = ["{} License", "licensed under the {} license version 2.0", "{} v3", "License: {}", "{} 1.0", "All rights reserved.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy", "{}"]
    texts = [" filler words ".join(rng.choice(forms).format(rng.choice(names)) for _ in range(rng.randint(1, 6))) for _ in range(250)]
    texts += [f"Licensed under the {n} License" for n in names]
    assert len(licenses.RULES) > 300
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        kept = _detect(text)
        base = set(filter(None, got[i].base_labels.split(",")))
        assert got[i].n_detections == len(kept), text
        assert got[i].labels == ",".join(sorted({k[3] for k in kept} | base)), text


def test_neighbours_and_edges(spark):
    rows = [(i * 7 if i else None, t, "x") for i, t in enumerate(EDGES)] + [(28, "a second with this id", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(3)
    order = sorted(((-1 << 63) if k is None else k, t or "") for k, t, _ in rows)
    for n in ("1", "4", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = imatch.compare(docs, imatch.lexicon(docs)).collect()
        want = []
        for i, (key, text) in enumerate(order):
            following, m = order[(i + 1) % len(order)][1], len(text) // 4
            want.append((key, len(text), hashlib.sha256((text[: len(text) - m] + following[:m]).encode()).hexdigest()))
        assert sorted(((-1 << 63) if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
        by = {}
        for r, (_, text) in zip(sorted(got, key=lambda r: ((-1 << 63) if r.doc_id is None else r.doc_id, r.n_chars)), sorted(order, key=lambda o: (o[0], len(o[1])))):
            assert by.setdefault(text, r.fingerprint) == r.fingerprint
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    one = docs.filter("doc_id = 21")
    assert imatch.compare(one, imatch.lexicon(one)).first().near_next == 1.0
    none = docs.filter("false")
    assert imatch.compare(none, imatch.lexicon(none)).count() == 0


def test_lexicon_band(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text for r in docs.select("text").collect()]
    df = {}
    for t in texts:
        for w in set(WORD.findall((t or "").lower())):
            df[w] = df.get(w, 0) + 1
    want = [w for w, n in df.items() if max(2, imatch.LOW * len(texts)) <= n <= imatch.HIGH * len(texts)]
    hashed = {r.h for r in spark.createDataFrame([(w,) for w in want], "w string").select(F.xxhash64("w").alias("h")).collect()}
    assert {r.term for r in imatch.lexicon(docs).collect()} == hashed


def test_edited_is_nearer_than_next(spark):
    got = imatch.op7_imatch(spark, "/root/testdata/sf0.01").collect()
    assert sum(r.near_edited > r.near_next for r in got) > 0.95 * len(got)


def _signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def _chained(values):
    h = 42
    for v in values:
        h = xxhash.xxh64(struct.pack("<q", v), seed=h).intdigest()
    return _signed(h)


def test_fingerprints_by_definition(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.sample(vocabulary, rng.randint(1, 120))) for _ in range(60)] + ["", "zz yy", "W1 w1 w2", None]
    lex = {_signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in vocabulary[:300]}
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    slots = imatch._slots(spark.createDataFrame([(t,) for t in lex], "term long"))
    got = {r.doc_id: r.f for r in rows.select("doc_id", imatch.fingerprints(F.coalesce("text", F.lit("")), slots).alias("f")).collect()}
    for i, text in enumerate(texts):
        all_ = {_signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in WORD.findall(_low(text))}
        own, want, low = sorted(all_ & lex), [], imatch.FIRST_BIT
        for bits in imatch.LEVELS:
            dealings = max(1, imatch.SUBSETS >> bits)
            for j in range(imatch.SUBSETS):
                at = low + bits * (j >> bits)
                kept = [t for t in own if (t >> at) % (1 << bits) == j % (1 << bits)]
                want.append(_chained(kept) % 65535 + 1 if kept else 0)
            low += bits * dealings
        assert got[i].n == len(own)
        assert got[i].hashes == (want if own else None)
        assert got[i].rest == (None if own else _chained(sorted(all_)))
