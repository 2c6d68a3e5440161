"""Operator 7 - I-Match fingerprints over randomised lexicon subsets, in DataFrame functions alone.

The lexicon holds the terms whose document frequency lies in a band of shares of all documents. A
fingerprint sorts a text's distinct lexicon terms and hashes, for each of a number of randomised
subsets of the lexicon, those that fall into the subset; subsets come in levels that keep one term
in 4, 32, 256 and 2048, so that some level suits any length. A term's subsets are told by bits of its
hash: four dealings of all terms into 4 parts, then 16 of 32, of 256 and of 2048 parts. A text without a lexicon term is
fingerprinted by all its terms.

Likeness: a subset's hashes agree unless a term in which the texts differ fell into it, so the share
that agree, e, on a level that keeps q of the terms tells the number of differing terms,
ln e / ln(1 - q); with the two numbers of lexicon terms that gives the Jaccard likeness.

Counting is exact in two passes: terms are first counted in hashed buckets, a bounded number, and
then only terms in buckets that reach the band's lower end are counted by themselves. At most
(terms of an average document) / (lower share) terms are in the band, whatever the number of
documents, so the lexicon is a bounded literal array that tasks look up by hash.

Neighbours by doc_id: ranges of ids, from quantiles, are windows; the first document of each range
is also dealt to the range before it (that of the first range to the last), so that a lead finds it.

Cases: null text is empty; an empty text has no terms and the fingerprint of none; repeated doc_ids
follow each other by text; null doc_ids come first; an empty table gives no rows; a table of one
document is its own neighbour; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, parallelism, prepare

LOW, HIGH, LEVELS, SUBSETS = 0.003, 0.15, (2, 5, 8, 11), 16
BUCKET_BITS, SLOTS = 18, 1 << 16
#: Bits of a term's hash below this one find its bucket and slot, those from it on its subsets; 16 subsets a level.
FIRST_BIT = 18
NULL_ID = -(1 << 63)


def terms(text: Column) -> Column:
    """Distinct 64-bit hashes of the text's terms: lower-case runs of letters, digits and all beyond ASCII."""
    words = F.filter(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """term (hash): those in at least max(2, low * N) and at most high * N of the N documents."""
    rows = docs.select(F.explode(terms(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("term"))
    n = docs.count()
    least, most = max(2, low * n), max(2, high * n)
    bucket = F.col("term").bitwiseAND(F.lit((1 << BUCKET_BITS) - 1))
    buckets = rows.groupBy(bucket.alias("bucket")).count().filter(F.col("count") >= least).select("bucket")
    # at most 2**BUCKET_BITS rows, so they may be broadcast
    left = rows.withColumn("bucket", bucket).join(F.broadcast(buckets), "bucket", "left_semi")
    return left.groupBy("term").count().filter(F.col("count").between(least, most)).select("term")


def _slots(lex: DataFrame) -> Column:
    """The lexicon as a literal: an array of SLOTS arrays of terms, found by their low bits.

    Subqueries can't stand in higher-order functions, and so the terms, a bounded number, are
    collected.
    """
    held: list[list[int]] = [[] for _ in range(SLOTS)]
    for row in lex.orderBy("term").collect():
        held[row["term"] & (SLOTS - 1)].append(row["term"])
    return F.from_json(F.lit(json.dumps(held, separators=(",", ":"))), "array<array<bigint>>")


def _subsets(level: int) -> list[dict]:
    """A level's subsets as tests on the bits of a term's hash: mask and value.

    Each level reads bits of its own. Where one in 2**bits is kept and there are at least as many subsets, the subsets
    are that many ways to deal all terms into 2**bits parts; else the first SUBSETS of 2**bits parts.
    """
    bits = LEVELS[level]
    shift, parts = FIRST_BIT + sum(_width(b) for b in LEVELS[:level]), 1 << bits
    places = [(j % parts, shift + bits * (j // parts)) for j in range(SUBSETS)]
    return [{"mask": (parts - 1) << low, "value": value << low} for value, low in places]


def _some(level: int, own: Column) -> Column:
    """The terms that any subset of a level has: those whose part is one of the first SUBSETS."""
    shift = FIRST_BIT + sum(_width(b) for b in LEVELS[:level])
    rest = ((1 << LEVELS[level]) - 1) & ~(SUBSETS - 1)
    return F.filter(own, lambda t: t.bitwiseAND(F.lit(rest << shift)) == 0) if rest else own


def _width(bits: int) -> int:
    """How many bits of a hash a level reads."""
    return bits * max(1, SUBSETS >> bits)


def _hash_of(kept: Column) -> Column:
    """A 16-bit hash of sorted terms, 0 for none."""
    return F.transform(F.array(kept), lambda k: F.when(F.size(k) == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64(k), F.lit(65535)).cast("int") + 1))[0]


def fingerprints(text: Column, slots: Column) -> Column:
    """struct(n: lexicon terms, hashes: one 16-bit hash for each subset, 0 for an empty one, rest: of a text without)."""
    every = terms(text)

    def within(found: Column) -> Column:
        own = found["own"]
        # a level's terms are picked once, so that a sparse level's subsets are sought among few
        known = [F.from_json(F.lit(json.dumps(_subsets(level))), "array<struct<mask:bigint,value:bigint>>") for level in range(len(LEVELS))]
        of_level = lambda level: F.transform(F.array(_some(level, own)), lambda p: F.transform(known[level], lambda s: _hash_of(F.filter(p, lambda t: t.bitwiseAND(s["mask"]) == s["value"]))))[0]
        hashed = F.concat(*map(of_level, range(len(LEVELS))))
        return F.struct(F.size(own).alias("n"), F.when(F.size(own) > 0, hashed).alias("hashes"), F.when(F.size(own) == 0, F.xxhash64(F.sort_array(found["all"]))).alias("rest"))

    looked = F.transform(
        F.array(every),
        lambda all_: F.struct(
            F.sort_array(F.filter(all_, lambda t: F.array_contains(F.element_at(slots, t.bitwiseAND(F.lit(SLOTS - 1)).cast("int") + 1), t))).alias("own"),
            all_.alias("all"),
        ),
    )
    return F.transform(looked, within)[0]


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two fingerprints."""
    pairs = F.zip_with(a["hashes"], b["hashes"], lambda x, y: x == y)
    estimate = F.lit(None).cast("double")
    best = F.lit(-1)
    for level, bits in enumerate(LEVELS):
        same = F.size(F.filter(F.slice(pairs, level * SUBSETS + 1, SUBSETS), lambda x: x))
        told = same * (SUBSETS - same)  # the level nearest to one half tells most
        here = F.log((same + 0.5) / (SUBSETS + 1.0)) / F.log(F.lit(1 - 2.0**-bits))
        estimate = F.when(told > best, here).otherwise(estimate)
        best = F.greatest(best, told)
    total = (a["n"] + b["n"]).cast("double")
    jaccard = F.greatest(F.lit(0.0), (total - estimate) / (total + estimate))
    return F.when(a.eqNullSafe(b), F.lit(1.0)).when((a["n"] == 0) | (b["n"] == 0), F.lit(0.0)).otherwise(F.least(jaccard, F.lit(0.999)))


def printed(f: Column) -> Column:
    """A fingerprint as text."""
    return F.when(f["n"] > 0, F.concat(F.hex(f["n"].cast("long")), F.lit(":"), F.array_join(F.transform(f["hashes"], lambda x: F.lpad(F.hex(x.cast("long")), 4, "0")), ""))).otherwise(F.concat(F.lit("0:"), F.hex(f["rest"])))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the key, less one: 32-way search over a literal array."""
    width = 1
    while width < len(bounds):
        width *= 32
    array = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
    base = F.lit(0)
    while width > 1:
        width //= 32
        base = base + _steps(array, key, base, width) * F.lit(width)
    return base


def _steps(array: Column, key: Column, base: Column, width: int) -> Column:
    """How many of the bounds base + width, base + 2 width, ... (31 of them) are at most the key."""
    return F.size(F.filter(F.sequence(F.lit(1), F.lit(31)), lambda i: F.coalesce(F.get(array, base + i * F.lit(width)) <= key, F.lit(False))))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, bucket, spare and the order columns: rows of neighbouring ids stand in one bucket.

    ``spare`` rows are the copies of the next bucket's first document; they sort last.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(NULL_ID))
    ranges = parallelism(spark)
    shares = [i / ranges for i in range(ranges)]
    found = rows.agg(F.min(key).alias("least"), F.percentile_approx(key, shares, 100 * ranges).alias("bounds")).first()
    bounds = sorted({found["least"], *(found["bounds"] or [])} - {None}) or [0]
    rows = rows.withColumn("key", key).withColumn("bucket", _range_of(F.col("key"), bounds))
    array = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
    before = F.when(F.col("bucket") > 0, F.col("bucket") - 1).otherwise(F.lit(len(bounds) - 1))
    places = F.when(F.get(array, F.col("bucket")) == F.col("key"), F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("spare")), F.struct(before.alias("b"), F.lit(1).alias("spare")))).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("spare"))))
    return rows.select("doc_id", "text", "key", F.explode(places).alias("place")).select("doc_id", "text", "key", F.col("place.b").alias("bucket"), F.col("place.spare").alias("spare"))


def compare(docs: DataFrame, lex: DataFrame) -> DataFrame:
    """Each document with its edited text's and its next document's fingerprints and likeness."""
    order = Window.partitionBy("bucket").orderBy("spare", "key", "text")
    rows = with_next(docs).withColumn("next_text", F.lead("text").over(order))
    n = F.length("text")
    moved = F.floor(n / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - moved), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), moved))).drop("next_text")
    slots = _slots(lex)
    both = F.transform(F.array("text", "edited"), lambda t: fingerprints(t, slots))
    rows = rows.select("doc_id", "key", "text", "spare", "bucket", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), both.alias("f"))
    rows = rows.withColumn("next_f", F.lead(F.col("f")[0]).over(order)).filter("spare = 0")
    own, edited = F.col("f")[0], F.col("f")[1]
    return rows.select("doc_id", "n_chars", "edited_sha256", printed(own).alias("fingerprint"), printed(edited).alias("edited_fingerprint"), likeness(own, edited).alias("near_edited"), likeness(own, F.col("next_f")).alias("near_next"))


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of all documents, their edited texts and their neighbours."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return compare(docs, materialize(lexicon(docs), "lexicon"))
