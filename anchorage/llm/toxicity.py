"""Operator 2 - toxicity by a weighted lexicon in an Aho-Corasick automaton.

Folding: lower case, look-alike letters of other scripts to Latin, digits and signs that stand for a
letter inside a word to that letter, everything but letters to one blank. A lexicon entry is a whole
word (' word ') or a word's beginning (' stem'); each word of a text counts with its heaviest entry,
unless it stands inside an exception phrase ('trash can'). The weights' sum and its share of the
text's length go into a logistic score.

Weights are learned from at most ``sample`` labelled rows (a documented bound: the labels with the
least hashes): the lower confidence bound of the log odds between toxic and clean documents; every term
whose bound passes is an entry. A small
lexicon of plain insults stands in where there is too little to learn from.

Matching and suppression take time in proportion to the text and its matches, so very long texts are
scored whole.

Cases: null, empty and letterless texts score as a text without a hit; unlabelled tables leave the
plain lexicon; several labels of one document count as several rows; repeated rows score alike; null
doc_ids are kept; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, materialize, prepare

SAMPLE, STEMS, THRESHOLD, LEAST_WEIGHT = 12_000, (4, 5, 6), 0.3, 0.5

# Plain insults, phrases in which such a word is harmless, look-alikes.
PLAIN = "idiot stupid moron loser trash scum pathetic disgusting worthless clown imbecile dumbass retard bastard asshole bitch".split()
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash collection", "trash talk", "white trash bag", "clown fish", "clown car",
    "circus clown", "class clown", "clown nose", "pond scum", "scum line", "loser bracket", "losers bracket", "sore loser rule",
    "idiot proof", "idiot light", "village idiot ball", "pathetic fallacy", "stupid question policy", "retard the spark",
)
LOOK_ALIKES = dict(zip("аеорсухіјѕһԁɡɩοαερτυνικѵⅼ", "aeopcyxijshdgioaeptuvikvl"))
DIGITS = str.maketrans("0134578@$!|", "oieastbasil")
_FOLD = str.maketrans(LOOK_ALIKES | {chr(0xFF41 + i): chr(97 + i) for i in range(26)})
_STAND_IN = re.compile(r"(?<![\d@$!|])(?:[0134578$!|]|@(?![\w-]*\.\w)){1,2}(?=[^\W\d_])")
_OTHER = re.compile(r"[\W\d_]+")


def fold(text: str | None) -> str:
    """' word word ' of the folded text; ' ' where it has no letter."""
    low = (text or "").lower()
    if not low.isascii():
        low = low.translate(_FOLD)
    low = _STAND_IN.sub(lambda m: m[0].translate(DIGITS), low)
    return f" {_OTHER.sub(' ', low).strip()} " if low else " "


class Matcher:
    """The automaton over entries and exception phrases."""

    def __init__(self, entries: dict[str, float], exceptions=EXCEPTIONS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry, weight in entries.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in exceptions:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
        self.automaton.make_automaton()

    def spans(self, folded: str) -> list[tuple[int, float]]:
        """(start, weight) of each word that counts, in the folded text."""
        best, free = {}, []
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if weight is None:
                free.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        # one sweep over both, in the order of their starts
        out, reach, at = [], 0, 0
        free.sort()
        for start in sorted(best):
            while at < len(free) and free[at][0] <= start:
                reach = max(reach, free[at][1])
                at += 1
            if start >= reach:
                out.append((start, best[start]))
        return out

    def features(self, text: str | None) -> tuple[float, float, int]:
        """Sum of weights, the same for each hundred words, and hits."""
        folded = fold(text)
        found = self.spans(folded)
        total = sum(w for _, w in found)
        return total, 100 * total / max(20, folded.count(" ") - 1), len(found)


def _terms(text: str) -> set[str]:
    words = set(fold(text).split())
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:n]}" for w in words for n in STEMS if len(w) > n}


def _weight(t: int, c: int, nt: int, nc: int) -> float:
    return math.log((t + 0.5) / (nt + 1)) - math.log((c + 0.5) / (nc + 1)) - 3.0 * math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))


def _count(rows: DataFrame, only: frozenset[str] | None) -> DataFrame:
    def run(batches):
        for batch in batches:
            found: Counter = Counter()
            for text in batch.column(0).to_pylist():
                terms = _terms(text or "")
                found.update(terms & only if only is not None else terms)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

    return rows.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> list[float]:
    """Ridge logistic regression by Newton steps; the intercept comes first."""
    x = np.c_[np.ones(len(x)), x]
    w, eye = np.zeros(x.shape[1]), np.eye(x.shape[1]) * penalty * len(x) / 100
    eye[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + eye, x.T @ (y - p) - eye @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Lexicon and score from at most ``sample`` labelled documents of those given."""
    spark = prepare(docs.sparkSession)
    chosen = labels.filter("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)  # bounded, so it may be broadcast
    rows = materialize(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").repartition(max(2, spark.sparkContext.defaultParallelism)), "toxic-sample")
    have = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    nt, nc = have.get(1, 0), have.get(0, 0)
    entries = {f" {w} ": 3.0 for w in PLAIN}
    weights = [-3.0, 1.2, 0.8]
    if nt and nc:
        toxic, clean = rows.filter("toxic = 1"), rows.filter("toxic = 0")
        # of the sample's terms those that might pass with no clean document at all come to the driver
        least = next((t for t in range(2, nt + 1) if _weight(t, 0, nt, nc) > LEAST_WEIGHT), nt + 1)
        often = {r["term"]: r["n"] for r in _count(toxic, None).filter(F.col("n") >= least).collect()}
        other = {r["term"]: r["n"] for r in _count(clean, frozenset(often)).collect()} if often else {}
        scored = {term: _weight(t, other.get(term, 0), nt, nc) for term, t in often.items()}
        entries = {e: w for e, w in entries.items() if other.get(e, 0) <= 0.01 * nc} | {term: w for term, w in scored.items() if w > LEAST_WEIGHT}
        matcher = (entries,)

        def run(batches):
            m = Matcher(*matcher)
            for batch in batches:
                f = [m.features(t) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in f], pa.float64()), pa.array([v[1] for v in f], pa.float64()), batch.column(1)], names=["total", "share", "toxic"])

        table = rows.select("text", "toxic").mapInArrow(run, "total double, share double, toxic int").toArrow()  # at most `sample` rows of numbers
        x = np.c_[np.log1p(table.column("total").to_numpy()), np.log1p(table.column("share").to_numpy())]
        if min(nt, nc) >= 5:
            weights = _logistic(x, table.column("toxic").to_numpy().astype(float))
    return {"entries": entries, "weights": weights}


def _scorer(model: dict):
    matcher, (b, w1, w2) = Matcher(model["entries"]), model["weights"]

    def score(text):
        total, share, hits = matcher.features(text)
        z = b + w1 * math.log1p(total) + w2 * math.log1p(share)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), hits

    return score


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score (0 to 1), hits (words that counted) of every whole text."""
    prepare(docs.sparkSession)

    def run(batches):
        judge = _scorer(model)
        for batch in batches:
            found = [judge(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())], names=["doc_id", "score", "hits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, hits long")


def keep_clean(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text scores below the threshold."""
    prepare(docs.sparkSession)

    def run(batches):
        judge = _scorer(model)
        for batch in batches:
            yield batch.filter(pa.array([judge(t)[0] < threshold for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training(labels: DataFrame) -> DataFrame:
    """The labels to learn from: the rest of the checksum by four is not two."""
    return labels.filter(crc_mod("doc_id", 4) != 2)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' toxicity, learned from the labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, training(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    found = score(docs, model)
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "hits")
