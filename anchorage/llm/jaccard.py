"""Operator 8 - exact Jaccard joins of word shingles by token-combination prefixes.

A document's tokens are the hashes of its distinct five-word shingles. Documents of equal sets form
one class; links are sought between classes. Tokens have one global order: rare ones first, then the
frequent ones by frequency; the frequent ones fall into m token classes by their hash, m in
proportion to the set's size (an eighth of the power of two below it). Two sets at similarity t have
their first k common tokens within the first n - ceil(t n) + k tokens of either. So either their first
common token is rare and stands in both 1-prefixes, or their first m + 1 common tokens are frequent,
stand in both prefixes extended by m, and two of them are of one token class. The index therefore
holds a set under each rare token of its 1-prefix and under each pair of frequent tokens of one class
in its extended prefix: about as many keys as a prefix has tokens, at every size. The m of a pair is
that of its smaller set; a set whose partners may have the next lower m is indexed under both.

What is asked for is components, and so within a component no further link is needed:

1. Stars: under a few keys of each class (those of least hash, which near copies have in common) the
   class is paired with the key's centre, the set with the fewest rare tokens: of a group of copies
   the one they were made from. These pairs are verified, components are formed.
2. Completion: for every key that still holds several components, all pairs across components are
   verified, from the side that is not in the key's largest component. Nothing is capped.

A pair leaves the join of a key only if sizes and places of the key's first token in both sets allow a
similarity of 0.8: at most ``slack`` common tokens stand up to that place (one for a rare token; for a
pair of frequent ones m, and no more than the frequent tokens up to there), the rest behind it. Under a
pair of frequent tokens the first common token is sought that is frequent, so that no rare tokens are
in common: these and the frequent tokens that differ, counted from below by 64 bits of parity, are at
most a ninth of all. Then parity sketches (a bit a token, 1024 at least),
looked up once a set, rule out more: they differ in no more bits than the sets differ in tokens, and
at 0.8 sets differ in at most a ninth of their total size. What is left is verified on the tokens.

The frequency table only orders tokens, so it may be bounded (``FREQUENT_MOST`` rows go to every
task) without losing a link. Shingles are compared by 64-bit hashes.

Cases: null text, empty text and text without words have no tokens and no links; fewer than five
words are one shingle of them all; repeated rows are one class; a null doc_id takes part, and the
smallest doc_id that is not null names the component; repeated doc_ids with different texts are
separate documents; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap_of, in_bitmap, materialize, mix64, prepare, release

WORDS, FREQUENT, FREQUENT_MOST, SKETCH, FOLD, STARS = 5, 24, 1 << 17, 1024, 8, 4
_STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(WORDS, len(words))
    mixed = np.full(len(words) - width + 1, np.uint64(width), np.uint64)
    for i in range(width):
        mixed = mixed * _STEP + hashed[i : len(words) - width + 1 + i]
    return np.unique(mix64(mixed))


def sketch_of(tokens: np.ndarray) -> np.ndarray:
    """Parity of the tokens in each of a power of two of slots, as many as tokens at least, in words of 64."""
    slots = max(SKETCH, 1 << int(len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def token_classes(level: int) -> int:
    """Number of classes of frequent tokens for sets of 2**level tokens and more."""
    return 1 << max(0, level - 3)


def index_keys(tokens: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """The keys a set is indexed under, the place of each key's first token, its slack; the number of rare tokens, the frequent ones' parities.

    ``frequent``: sorted tokens, with their counts. Sets of fewer than four tokens are like no other set.
    """
    n = len(tokens)
    often = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        often = np.where(frequent[at] == tokens, counts[at], 0)
    order = np.lexsort((tokens, often))
    ranked, common = tokens[order], often[order] > 0
    rare_n = n - int(common.sum())
    slots = np.bincount((ranked[common] >> np.uint64(20) & np.uint64(63)).astype(np.int64), minlength=64) & 1
    bits = int(np.packbits(slots.astype(np.uint8)).view(np.int64)[0])
    if n < 4:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), rare_n, bits
    least = (4 * n + 4) // 5
    short = n - least + 1
    rare = np.flatnonzero(~common[:short])
    keys, places, slacks = [ranked[rare]], [rare], [np.ones(len(rare), np.int64)]
    for level in sorted({n.bit_length() - 1, least.bit_length() - 1}):
        m = token_classes(level)
        at = np.flatnonzero(common[: short + m])
        kind = ranked[at] >> np.uint64(40) & np.uint64(m - 1)
        at = at[np.argsort(kind, kind="stable")]  # by class, in order within a class
        size = np.bincount(kind.astype(np.int64), minlength=m)
        behind = np.repeat(np.cumsum(size), size) - np.arange(len(at)) - 1
        i = np.repeat(np.arange(len(at)), behind)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(behind) - behind, behind)
        keys.append(mix64((ranked[at[i]] * _STEP + ranked[at[j]]) ^ np.uint64(level + 1)))
        places.append(at[i])
        slacks.append(np.minimum(m, at[i] - rare_n + 1))
    return np.concatenate(keys), np.concatenate(places).astype(np.int32), np.concatenate(slacks).astype(np.int32), rare_n, bits


def _frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of many sets with their counts: at most FREQUENT_MOST, the most frequent."""

    def run(batches):
        import xxhash

        held, size, seen = [], 0, set()

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            keys, n = keys[n > 1], n[n > 1]
            for k in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 100_000].view(np.int64)), pa.array(n[k : k + 100_000])], names=["token", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                tokens = tokens_of(text)
                name = xxhash.xxh64_intdigest(tokens.tobytes())
                if len(tokens) and name not in seen:
                    seen.add(name)
                    held.append(tokens)
                    size += len(tokens)
            if size > 2_000_000:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    found = rows.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    top = found.orderBy(F.desc("n"), "token").limit(FREQUENT_MOST).toArrow()
    tokens, n = top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], n[order].astype(np.int64)


_SETS = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int32()), ("node", pa.int64()), ("other", pa.int64()), ("rare", pa.int32()), ("bits", pa.int64()), ("sketch", pa.list_(pa.int64())), ("fold", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("slacks", pa.list_(pa.int32()))])
_SETS_DDL = "kind string, doc_id long, text_hash long, n int, node long, other long, rare int, bits long, sketch array<long>, fold array<long>, keys array<long>, places array<int>, slacks array<int>"


def _sets(rows: DataFrame, frequent: np.ndarray, counts: np.ndarray, seed: int) -> DataFrame:
    """Rows of kind 'doc' for each document, and of kind 'class' for each distinct set, once a task at least."""
    box = rows.sparkSession.sparkContext.broadcast((frequent, counts))

    def run(batches):
        for batch in batches:
            out, seen = [], set()
            for doc_id, text_hash, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                tokens = tokens_of(text)
                if not len(tokens):
                    out.append(("doc", doc_id, text_hash, 0, *[None] * 9))
                    continue
                node, other = _names(tokens, seed)
                out.append(("doc", doc_id, text_hash, len(tokens), node, other, *[None] * 7))
                if node not in seen:
                    seen.add(node)
                    keys, places, slacks, rare, bits = index_keys(tokens, *box.value)
                    sketch = sketch_of(tokens)
                    out.append(("class", None, None, len(tokens), node, None, rare, bits, sketch, np.bitwise_xor.reduce(sketch.reshape(-1, FOLD), axis=0), keys.view(np.int64), places, slacks))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), _SETS)], schema=_SETS)

    found = rows.select("doc_id", "text_hash", "text").mapInArrow(run, _SETS_DDL)
    return materialize(found, "sets", partition_by="kind")


def _names(tokens: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """The set's 128-bit name as two signed words; the first is its node."""
    import xxhash

    raw = xxhash.xxh3_128_digest(tokens.tobytes(), seed)
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _tokens(rows: DataFrame, named: DataFrame, pairs: DataFrame, seed: int) -> DataFrame:
    """node, tokens of the classes in the pairs, from one text each: a bitmap of the texts' hashes sieves, a join decides."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(named.select("node", "text_hash").join(wanted, "node", "left_semi"), "wanted")
    words = bitmap_of(wanted, "text_hash", 24)

    def run(batches):
        for batch in batches:
            out, seen = [], set()
            some = in_bitmap(words, batch.column(0).to_numpy(zero_copy_only=False))
            for text_hash, text in zip(*(batch.filter(pa.array(some)).column(i).to_pylist() for i in range(2))):
                if text_hash not in seen:
                    seen.add(text_hash)
                    tokens = tokens_of(text)
                    if len(tokens):
                        out.append((_names(tokens, seed)[0], tokens.view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.int64()))], names=["node", "tokens"])

    found = rows.select("text_hash", "text").mapInArrow(run, "node long, tokens array<long>").groupBy("node").agg(F.first("tokens").alias("tokens"))
    tokens = materialize(found.join(wanted, "node", "left_semi"), "tokens")
    release(wanted)
    return tokens


def _apart(a: str, b: str, na: str, nb: str):
    """Bits in which two sketches differ, NULL where they rule out a similarity of 0.8."""
    # sizes within a factor of 0.8 have sketches of one size, or of two that are a factor of two apart: the larger is folded
    part = lambda c, k: F.slice(c, k, F.floor(F.size(c) / 2).cast("int"))
    half = lambda c: F.zip_with(part(c, F.lit(1)), part(c, F.floor(F.size(c) / 2).cast("int") + 1), lambda x, y: x.bitwiseXOR(y))
    sa = F.when(F.size(a) > F.size(b), half(a)).otherwise(F.col(a))
    sb = F.when(F.size(b) > F.size(a), half(b)).otherwise(F.col(b))
    bits = F.aggregate(F.zip_with(sa, sb, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(9 * bits <= F.col(na) + F.col(nb), bits)


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that the sketches don't rule out."""
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}")), side)
    return pairs.filter(_apart("sa", "sb", "na", "nb").isNotNull()).select("a", "b")


def _verified(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The pairs whose sets are at least 0.8 alike: 100 * common >= 80 * united."""
    for side in ("b", "a"):
        pairs = pairs.join(tokens.select(F.col("node").alias(side), F.col("tokens").alias(f"t{side}")), side)
    common = F.size(F.array_intersect("ta", "tb"))
    pairs = pairs.select("a", "b", common.alias("common"), (F.size("ta") + F.size("tb")).alias("total"))
    return pairs.filter("100 * common >= 80 * (total - common)").select("a", "b")


def _links(pairs: DataFrame, classes: DataFrame, rows: DataFrame, named: DataFrame, seed: int) -> DataFrame:
    """The pairs of a table that are links; the table goes."""
    likely = materialize(_likely(pairs, classes), "likely")
    tokens = _tokens(rows, named, likely, seed)
    links = materialize(_verified(likely, tokens), "links")
    release(pairs, likely, tokens)
    return links


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node of the edges (a, b)."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        new = labels.join(near, "node").select("node", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        new = materialize(new, "labels")
        # follow the label's own label, twice
        step = new.select(F.col("node").alias("to"), F.col("to").alias("next"))
        far = new.join(step, "to").select("node", "was", F.least("to", "next").alias("to"))
        far = far.join(step, "to").select("node", "was", F.least("to", "next").alias("component"))
        far = materialize(far, "labels")
        release(labels, new)
        labels = far
        if far.filter("component <> was").isEmpty():
            release(both)
            return labels


def _postings(found: DataFrame) -> DataFrame:
    """Of keys that several sets have: key, paired, node, n, place, slack, odd, rare, bits, turn.

    paired: the key is of two frequent tokens; rare, bits: zero where it is not; odd: the set's rare tokens in 1000;
    turn: the key's place among the set's by hash.
    """
    entries = found.select("node", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x <> y").select("key")
    shared = materialize(shared, "shared")
    words = bitmap_of(shared, "key", 24)  # sieves, the join below decides

    def run(batches):
        for batch in batches:
            node, n, rare, bits, *lists = (batch.column(i) for i in range(7))
            size = np.diff(lists[0].offsets.to_numpy())
            key, place, slack = (c.flatten().to_numpy(zero_copy_only=False) for c in lists)
            owner = np.repeat(np.arange(len(size)), size)
            some = in_bitmap(words, key)
            key, place, slack, owner = key[some], place[some], slack[some], owner[some]
            order = np.lexsort((mix64(key.view(np.uint64)), owner))
            starts = np.searchsorted(owner, np.arange(len(size)))  # owner is ascending
            turn = np.empty(len(key), np.int64)
            turn[order] = np.arange(len(key)) - starts[owner[order]]
            n, rare, bits = (c.to_numpy()[owner] for c in (n, rare, bits))
            paired = place >= rare  # rare tokens come first
            out = [key, paired, node.to_numpy()[owner], n, place, slack, (1000 * rare.astype(np.int64) // n).astype(np.int32), np.where(paired, rare, 0).astype(np.int32), np.where(paired, bits, 0), np.minimum(turn, 127).astype(np.int8)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["key", "paired", "node", "n", "place", "slack", "odd", "rare", "bits", "turn"])

    kept = found.select("node", "n", "rare", "bits", "keys", "places", "slacks").mapInArrow(run, "key long, paired boolean, node long, n int, place int, slack int, odd int, rare int, bits long, turn byte")
    postings = materialize(kept.join(shared, "key", "left_semi"), "postings")
    release(shared)
    return postings


def _alike(x: str, y: str):
    """Whether what two postings of a key say (columns with these ends) allows a similarity of 0.8."""
    of = lambda name: (F.col(name + x), F.col(name + y))
    (n, m), (p, q) = of("n"), of("place")
    most = F.least(*of("slack")) + F.least(n - p, m - q) - 1
    apart = sum(of("rare")) + F.bit_count(F.col("bits" + x).bitwiseXOR(F.col("bits" + y)))
    return (5 * n >= 4 * m) & (5 * m >= 4 * n) & (9 * most >= 4 * (n + m)) & (9 * apart <= n + m)


def _ended(frame: DataFrame, end: str, *names: str) -> DataFrame:
    return frame.select(*(F.col(c).alias(c + end) for c in ("node", "n", "place", "slack", "rare", "bits", *names)))


def _star_pairs(postings: DataFrame) -> DataFrame:
    """Each class with the centres, of all sets there, of its first keys."""
    first = postings.filter(F.col("turn") < STARS)
    centre = postings.groupBy("key").agg(F.min(F.struct("odd", F.xxhash64("node").alias("luck"), "node", "n", "place", "slack", "rare", "bits")).alias("c"))
    first, centre = _ended(first, "_x", "key"), _ended(centre.select("key", "c.*"), "_y", "key")
    near = (F.col("key_x") == F.col("key_y")) & (F.col("node_x") != F.col("node_y")) & _alike("_x", "_y")
    pairs = first.join(centre, near)  # only likely pairs leave the join
    return pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def _all_pairs(postings: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """All pairs of classes under one key whose components differ, from the side outside the key's largest one.

    Keys of the same sets (long copies share thousands) are one, told by two hashes of their nodes: each set with its
    least place and largest slack, so that no pair is lost; keys that are taken for one by chance only add pairs. They
    carry the sets' sketches folded to 512 bits, whatever the set's size.
    """
    postings = postings.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("turn", "odd")
    postings = materialize(postings, "open")
    held = postings.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.max("paired").alias("paired"), F.bit_xor(F.xxhash64("node")).alias("u"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("v"))
    held = held.filter("least <> most").select("key", F.xxhash64("u", "v", "paired").alias("holders"))
    merged = postings.join(held, "key").groupBy(F.col("holders").alias("key"), "node").agg(*(F.first(c).alias(c) for c in ("n", "component", "rare", "bits")), F.min("place").alias("place"), F.max("slack").alias("slack"))
    merged = materialize(merged, "merged")
    release(postings)
    sizes = merged.groupBy("key", "component").agg(F.count("*").alias("size"))
    main = sizes.groupBy("key").agg(F.max(F.struct("size", "component")).alias("m")).select("key", F.col("m.component").alias("main"))
    folds = classes.select("node", *(F.col("fold")[k].alias(f"fold{k}_") for k in range(FOLD)))
    open_ = materialize(merged.join(main, "key").join(folds, "node"), "open")
    release(merged)
    words = [f"fold{k}_" for k in range(FOLD)]
    left = _ended(open_.filter("component <> main"), "_x", "key", "component", *words)
    right = _ended(open_, "_y", "key", "component", "main", *words)
    apart = sum(F.bit_count(F.col(f"{w}_x").bitwiseXOR(F.col(f"{w}_y"))) for w in words)
    across = (F.col("component_x") != F.col("component_y")) & ((F.col("component_y") == F.col("main_y")) | (F.col("node_x") < F.col("node_y")))
    pairs = left.join(right, (F.col("key_x") == F.col("key_y")) & across & _alike("_x", "_y") & (9 * apart <= F.col("n_x") + F.col("n_y")))
    pairs = pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()
    pairs = materialize(pairs, "pairs")
    release(open_)
    return pairs


def link(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (of the text), n_shingles, component_id, group (component's number; null without tokens)."""
    prepare(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    frequent, counts = _frequent(rows)
    seed = 0
    while True:
        sets = _sets(rows, frequent, counts, seed)
        named = sets.filter("kind = 'doc' and n > 0").groupBy("node").agg(F.min("other").alias("x"), F.max("other").alias("y"), F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash"))
        if named.filter("x <> y").isEmpty():
            break
        release(sets)
        seed += 1  # two sets share a node: name them anew
    found = sets.filter("kind = 'class'")
    postings = _postings(found)
    classes = found.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "sketch", "fold")))
    classes = materialize(classes.join(postings.select("node"), "node", "left_semi"), "classes")

    edges = _links(materialize(_star_pairs(postings), "pairs"), classes, rows, named, seed)
    labels = components(edges)
    rest = _all_pairs(postings, labels, classes)
    release(postings)
    more = _links(rest, classes, rows, named, seed)
    if not more.isEmpty():
        release(labels)
        labels = components(edges.unionByName(more))
    release(more, edges, classes)

    numbered = named.select("node", "least").join(labels.select("node", "component"), "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
    names = numbered.groupBy("group").agg(F.min("least").alias("component_id"))
    numbered = materialize(numbered.join(names, "group").select("node", "group", "component_id"), "named")
    release(labels)
    out = sets.filter("kind = 'doc'").select("doc_id", "text_hash", "n", "node").join(numbered, "node", "left")
    return out.select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "group")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each group the document of the least doc_id (and hash of its text), all columns; others as they are.

    Documents without words are in no group and stay, a repeated row of them too.
    """
    found = materialize(link(docs).select("doc_id", "text_hash", "group"), "groups")
    grouped = found.filter("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("first.*")
    kept = grouped.select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"))
    text = F.col("text").cast("string")
    worded = F.coalesce(F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    rows = docs.filter(worded).select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("hash"))
    rows = rows.join(kept, rows["id"].eqNullSafe(kept["kept_id"]) & (rows["hash"] == kept["kept_hash"]))
    rows = rows.groupBy("id", "hash").agg(F.first("row").alias("row")).select("row.*")  # of repeated rows one
    return rows.unionByName(docs.filter(~worded))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' shingle counts and components."""
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
