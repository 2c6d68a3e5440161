"""Operator 6 - language identification by interpolated Kneser-Ney character models.

Text is lower-cased, everything but letters becomes one blank, and each character is predicted from
the three before it. Counting is distributed: each task counts the 4-grams of its rows by language
in sorted arrays, and an aggregation adds them up over all training rows. From all of a language's
4-grams the model takes absolute discounting at the top order and continuation counts below it, so
its size grows with the distinct 4-grams of the training text:

    P(c | h) = max(N(hc) - D, 0) / N(h) + D T(h) / N(h) P(c | shorter h)

The models of all languages share one sorted array of hashed grams for each order (with an index by
leading bits) and a matrix of log probabilities; a gram that no model has falls back with the
weights of its context. The language with the lowest mean cross-entropy wins. Its score is the
softmax of the evidence.

A text is rejected if it has no letter, or if its cross-entropy is too high for its language and
length. The limit is calibrated on texts that the model has not seen: a tenth of the training texts
(by their hash, copies together) is scored by models of the other nine tenths, and gives the mean of a
language's cross-entropies, their variance between texts and that between the characters of a text,
texts weighted by their length.
By Cantelli's inequality no distribution has more than a share ``alpha`` of its texts above mean +
sqrt(1 / alpha - 1) standard deviations; for n characters the variance is between + within / n, so a
short text needs more evidence. Languages of few such texts take the limit of all languages together.

Cases: null text and text without a letter is 'und', score 0, rejected (a number sign such as 1/2 or a
Roman numeral sign is no letter); without training rows all texts are 'und'; without texts to
calibrate on only texts without a letter are rejected; ties go to the first language in order;
repeated rows are predicted alike; null doc_ids are kept; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, mix64, prepare

ORDER, DISCOUNT, FOLDS, ALPHA, FEW = 4, 0.75, 10, 0.005, 20
_OTHER = re.compile(r"[\W\d_]+")
# number signs that Python's word class holds beside letters and digits
_NUMBERS = frozenset(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isalnum() and not c.isalpha())
_NO_NUMBERS = dict.fromkeys(map(ord, _NUMBERS), " ")
_NONE, SLICE = np.zeros(0, np.uint64), 200_000  # characters worked on at once


def symbols(text: str) -> np.ndarray:
    """UTF-16 units of the folded text behind three blanks and before one; empty without a letter."""
    low = text.lower()
    if not (low.isascii() or _NUMBERS.isdisjoint(low)):
        low = low.translate(_NO_NUMBERS)
    words = _OTHER.sub(" ", low).strip()
    if not words:
        return np.zeros(0, np.uint64)
    return np.frombuffer(f"   {words} ".encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64)


def grams(s: np.ndarray) -> np.ndarray:
    """All 4-grams of the symbols, 16 bits each, the oldest in the highest."""
    return (s[:-3] << np.uint64(48)) | (s[1:-2] << np.uint64(32)) | (s[2:-1] << np.uint64(16)) | s[3:]


def _sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _back():
    """Whether a text is one to calibrate on."""
    return F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0


def count_grams(rows: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of (text, lang); rest: n without the texts to calibrate on."""
    schema = pa.schema([("lang", pa.string()), ("back", pa.bool_()), ("gram", pa.int64()), ("n", pa.int64())])

    def emit(held):
        for (lang, back), (keys, counts) in held.items():
            for k in range(0, len(keys), 100_000):
                part = keys[k : k + 100_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([back] * len(part)), pa.array(part), pa.array(counts[k : k + 100_000])], schema=schema)

    def run(batches):
        held: dict[tuple[str, bool], tuple[np.ndarray, np.ndarray]] = {}
        parts: dict[tuple[str, bool], list[np.ndarray]] = {}
        size = 0

        def add():
            for key, own in parts.items():
                keys, counts = np.unique(np.concatenate(own), return_counts=True)
                if key in held:
                    keys, counts = _sum_by(np.concatenate([held[key][0], keys]), np.concatenate([held[key][1], counts]))
                held[key] = (keys, counts)
            parts.clear()

        for batch in batches:
            for text, lang, back in zip(*(batch.column(i).to_pylist() for i in range(3))):
                s = symbols(text)
                if len(s):
                    parts.setdefault((lang, back), []).append(grams(s))
                    size += len(s)
                if size > 5 * SLICE:
                    add()
                    size = 0
            if sum(len(k) for k, _ in held.values()) > 1_000_000:  # memory of a task
                yield from emit(held)
                held.clear()
        add()
        yield from emit(held)

    found = rows.filter("text is not null and lang is not null").select("text", "lang", _back().alias("back")).mapInArrow(run, "lang string, back boolean, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum(F.when(~F.col("back"), F.col("n")).otherwise(0)).alias("rest"))


class _Table:
    """Sorted hashes with an index by their leading bits; find() gives places or -1."""

    def __init__(self, keys: np.ndarray):
        hashed = mix64(keys)
        self.order = np.argsort(hashed)
        self.hashes = hashed[self.order]
        bits = max(8, int(math.log2(max(1, len(keys)))) + 2)
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.longest = int(np.diff(self.starts).max(initial=0))
        self.hashes = np.r_[self.hashes, np.uint64(0)]

    def find(self, keys: np.ndarray) -> np.ndarray:
        hashed = mix64(keys)
        lead = (hashed >> self.shift).astype(np.int64)
        at, end = self.starts[lead], self.starts[lead + 1]
        out = np.where((at < end) & (self.hashes[at] == hashed), at, -1)
        left = np.flatnonzero((out < 0) & (end - at > 1))
        for step in range(1, self.longest):
            place = at[left] + step
            out[left] = np.where((place < end[left]) & (self.hashes[place] == hashed[left]), place, -1)
            left = left[(out[left] < 0) & (place + 1 < end[left])]
            if not len(left):
                break
        return out


class Models:
    """Kneser-Ney models of all languages over shared sorted hash arrays."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], discount: float = DISCOUNT):
        self.langs = sorted(counts)
        n = len(self.langs)
        if not n:
            return
        level = [{} for _ in range(ORDER + 1)]  # order -> language -> (keys, counts)
        for l, lang in enumerate(self.langs):
            keys, c = counts[lang]
            level[ORDER][l] = (keys, c.astype(np.float64))
            for m in range(ORDER - 1, 0, -1):  # continuation counts: distinct characters before the shorter gram
                above = level[m + 1][l][0]
                short, many = np.unique(above & np.uint64((1 << 16 * m) - 1), return_counts=True)
                level[m][l] = (short, many.astype(np.float64))
        symbols_seen = max(1, len(np.unique(np.concatenate([level[1][l][0] for l in range(n)])))) if n else 1
        self.tables, self.logs, self.context, self.weight = [None], [None], [None], [None]
        prob_below = None
        self.floor = math.log2(1 / (symbols_seen + 1))
        for m in range(1, ORDER + 1):
            union = np.unique(np.concatenate([level[m][l][0] for l in range(n)]))
            ctx_union = np.unique(union >> np.uint64(16))
            table, ctx = _Table(union), _Table(ctx_union)
            prob = np.empty((len(union), n))
            weight = np.ones((len(ctx_union), n))
            where = np.searchsorted(ctx_union, union >> np.uint64(16))
            if m == 1:
                lower = np.full((len(union), n), 1 / (symbols_seen + 1))
            else:
                short = union & np.uint64((1 << 16 * (m - 1)) - 1)
                lower = np.empty((len(union), n))
                place = np.searchsorted(prob_below[0], short)
                lower[:] = prob_below[1][place]  # every shorter gram of a seen gram is seen
            for l in range(n):
                keys, c = level[m][l]
                at = np.searchsorted(union, keys)
                total = np.bincount(where[at], c, len(ctx_union))
                types = np.bincount(where[at], minlength=len(ctx_union))
                seen = total > 0
                weight[seen, l] = discount * types[seen] / total[seen]
                prob[:, l] = weight[where, l] * lower[:, l]
                prob[at, l] += np.maximum(c - discount, 0) / total[where[at]]
            prob_below = (union, prob)
            self.tables.append(table)
            self.logs.append(np.log2(prob[table.order]).astype(np.float32))
            self.context.append(ctx)
            self.weight.append(np.log2(weight[ctx.order]).astype(np.float32))

    def entropies(self, texts: list[str], squares: bool = False) -> tuple[np.ndarray, ...]:
        """Bits for each text and language, and the number of characters predicted (0: no letter); the sums of squared bits."""
        sizes = np.zeros(len(texts), np.int64)
        out, more = np.zeros((len(texts), len(self.langs))), np.zeros((len(texts), len(self.langs)))
        held, owners, size = [], [], 0

        def close():
            ends = np.cumsum([len(h) for h in held])
            bits = self._bits(np.concatenate(held)).astype(np.float64)
            starts = np.r_[0, ends[:-1]]
            np.add.at(out, owners, np.add.reduceat(bits, starts, axis=0))
            if squares:
                np.add.at(more, owners, np.add.reduceat(bits * bits, starts, axis=0))

        for i, text in enumerate(texts):
            keys = symbols(text) if text else _NONE
            sizes[i] = max(0, len(keys) - 3)
            keys = grams(keys) if len(keys) and self.langs else _NONE
            for k in range(0, len(keys), SLICE):  # a long text in slices, short ones together
                held.append(keys[k : k + SLICE])
                owners.append(i)
                size += len(held[-1])
                if size >= SLICE:
                    close()
                    held, owners, size = [], [], 0
        if held:
            close()
        return (out, sizes, more) if squares else (out, sizes)

    def _bits(self, keys: np.ndarray) -> np.ndarray:
        """Bits of each gram's last character in each language."""
        total = np.zeros((len(keys), len(self.langs)), np.float32)
        left = np.arange(len(keys))
        for m in range(ORDER, 0, -1):
            now = keys[left] & np.uint64((1 << 16 * m) - 1) if m < 4 else keys[left]
            at = self.tables[m].find(now)
            hit = at >= 0
            total[left[hit]] += self.logs[m][at[hit]]
            left, now = left[~hit], now[~hit]
            if not len(left):
                break
            at = self.context[m].find(now >> np.uint64(16))
            seen = at >= 0
            total[left[seen]] += self.weight[m][at[seen]]
        total[left] += np.float32(self.floor)
        return -total


def _limits(docs: DataFrame, models: Models, alpha: float) -> dict:
    """For each language of the models (mean, variance between texts, variance within), the factor applied."""

    def run(batches):
        for batch in batches:
            sums: dict[str, np.ndarray] = {}
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            bits, size, squares = models.entropies(texts, squares=True)
            for i, lang in enumerate(langs):
                if size[i] and lang in models.langs:
                    l = models.langs.index(lang)
                    mean = bits[i, l] / size[i]
                    within = max(0.0, squares[i, l] / size[i] - mean * mean)
                    sums[lang] = sums.get(lang, 0) + np.array([1, size[i], size[i] * mean, size[i] * mean * mean, size[i] * within])
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *(pa.array([v[k] for v in sums.values()], pa.float64()) for k in range(5))], names=["lang", *"kncqw"])

    fold = docs.filter("text is not null and lang is not null").filter(_back()).select("text", "lang")
    found = fold.mapInArrow(run, "lang string, k double, n double, c double, q double, w double").groupBy("lang").agg(*(F.sum(c).alias(c) for c in "kncqw"))
    sums = {r["lang"]: np.array([r[c] for c in "kncqw"]) for r in found.collect()}  # a row a language
    if not sums:
        return {}
    together = sum(sums.values())
    limits = {}
    for lang in models.langs:
        _, n, c, q, w = (sums[lang] if lang in sums and sums[lang][0] >= FEW else together).tolist()
        limits[lang] = (c / n, max(0.0, q / n - (c / n) ** 2), w / n, math.sqrt(1 / alpha - 1))
    return limits


def fit(docs: DataFrame, alpha: float = ALPHA) -> dict:
    """Models and rejection limits from the rows of (text, lang) given.

    What comes to the driver is the distinct grams and five sums for each language.
    """
    prepare(docs.sparkSession)
    kept = count_grams(docs).toArrow()
    langs = kept.column("lang")
    keys = kept.column("gram").to_numpy().astype(np.int64).view(np.uint64)

    def models(column: str) -> Models:
        counts, n = {}, kept.column(column).to_numpy()
        for lang in sorted(langs.unique().to_pylist()):
            own = np.flatnonzero(pc.equal(langs, lang).to_numpy() & (n > 0))
            if len(own):
                own = own[np.argsort(keys[own])]
                counts[lang] = (keys[own], n[own])
        return Models(counts)

    return {"models": models("n"), "limits": _limits(docs, models("rest"), alpha)}


def too_high(limit: tuple | None, mean: float, n: int) -> bool:
    """Whether a mean cross-entropy over n characters lies above the limit."""
    if limit is None:
        return False
    usual, between, within, factor = limit
    return mean > usual + factor * math.sqrt(between + within / n)


_PREDICTED = "doc_id long, lang_pred string, score double, bits double, rejected boolean"


def predict(docs: DataFrame, model: dict, keep: str | None = None) -> DataFrame:
    """doc_id, lang_pred, score, bits (mean cross-entropy of the best language), rejected.

    ``keep``: return instead the rows of docs that are not rejected, all columns.
    """
    spark = prepare(docs.sparkSession)
    box = spark.sparkContext.broadcast(model)  # as large as the distinct grams of the training text

    def judge(texts):
        models, limits = box.value["models"], box.value["limits"]
        bits, size = models.entropies(texts)
        for i, n in enumerate(size.tolist()):
            if not n or not models.langs:
                yield "und", 0.0, None, True
                continue
            best = int(np.argmin(bits[i]))
            gap = np.minimum(bits[i] - bits[i, best], 700)
            mean = float(bits[i, best] / n)
            yield models.langs[best], float(1 / np.exp2(-gap).sum()), mean, too_high(limits.get(models.langs[best]), mean, n)

    if keep:

        def sieve(batches):
            for batch in batches:
                good = [not r[3] for r in judge(batch.column(keep).to_pylist())]
                yield batch.filter(pa.array(good, pa.bool_()))

        return docs.mapInArrow(sieve, docs.schema)

    def run(batches):
        for batch in batches:
            found = list(judge(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_())))], names=["doc_id", "lang_pred", "score", "bits", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _PREDICTED)


def training(docs: DataFrame) -> DataFrame:
    """The rows to learn from: every fifth doc_id by checksum is held out."""
    return docs.filter(crc_mod("doc_id", 5) != 0).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' languages, learned from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs, fit(training(docs)))
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
