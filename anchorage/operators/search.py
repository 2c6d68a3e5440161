"""Evidence search over blocks or documents: signals, tiers, top-k, grounding, terminology, packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .core import budget_fold

#: The words of each typed detector; a final '-' lets any ending follow.
WORDS = {
    "coordinate": "latitude longitude",
    "elevation": "elevation altitude",
    "date": "january february march april may june july august september october november december",
    "measurement_verb": "measured determined estimated recorded calculated sampled analyzed analysed quantified assessed monitored counted weighed scored derived digitized",
    "instrument": "spectromet- spectrophotomet- chromatograph- analyzer analyser sensor sensors probe porometer ceptometer datalogger thermocouple tensiometer lysimeter balance caliper calipers camera microscope",
    "management_verb": "planted sown seeded transplanted harvested irrigated fertilized fertilised tilled ploughed plowed mown mowed grazed thinned pruned burned weeded sprayed limed coppiced",
    "design_term": "randomized randomised replicate replicates replicated replication factorial treatment treatments control subplot subplots gradient",
    "site_term": "site sites located situated farm station forest stand county province region soil climate rainfall precipitation",
    "pooling": "pooled averaged",
    "statistic": "se sem sd lsd hsd tukey duncan anova",
}
_UNITS = "mm|cm|km|m|kg|mg|g|t|ha|ml|l|mol|mmol|µmol|μmol|kpa|mpa|ppm|%|°c|days?|years?|h|min"
_NUMBER = r"[0-9]+(?:[.,][0-9]+)*"
#: What words alone can't tell: numbers with signs and units, phrases.
FORMS = {
    "coordinate": rf"{_NUMBER}\s*°[^a-z]{{0,14}}[nsew]\b",
    "elevation": rf"{_NUMBER}\s*m\s*(?:a\.?\s*s\.?\s*l\b|above\b[a-z ]{{0,9}}\bsea)",
    "date": r"\b(?:19|20)[0-9]{2}\b",
    "relative_time": r"\b[0-9]+\s*d(?:ap|as|at)\b|\b(?:before|after)\s+(?:planting|sowing|harvest|emergence|transplanting)\b",
    "doi": r"\b10\.[0-9]{4,}/\S+",
    "amount": rf"{_NUMBER}\s*(?:kg|mg|g|t|ml|l|mm)\b[^.;]{{0,12}}(?:\bha\b|/ha\b|\bm-?2\b|\bplant\b|\bpot\b)",
    "design_term": r"\b(?:complete|incomplete) blocks?\b|\bsplit[- ]plots?\b|\bexperimental (?:unit|design)s?\b",
    "site_term": r"\bstudy area\b|\bmean annual\b",
    "pooling": r"\b(?:across|over) (?:all|both|the [0-9a-z]+) (?:years|sites|locations|seasons|populations)\b|\bmeans? (?:of|over) [0-9a-z]+ (?:years|sites|seasons)\b",
    "statistic": r"\bstandard (?:error|deviation)s?\b|\bconfidence (?:interval|limit)s?\b|\bp\s*[<=>]\s*0?\.[0-9]|\bn\s*=\s*[0-9]",
    "binomial": r"\b[A-Z][a-z]{2,} [a-z]{4,} (?:[A-Z][a-z]*\.|\([A-Z][a-z]*\.?\))",
    "unit": rf"{_NUMBER}\s*(?:{_UNITS})(?![a-z])",
}
_CASED = ("binomial",)


def _detector(name: str) -> str:
    """One pattern: any of the detector's words as whole words, or one of its forms."""
    words = "|".join(w[:-1] + r"[a-z]*" if w.endswith("-") else w for w in WORDS.get(name, "").split())
    parts = ([rf"\b(?:{words})\b"] if words else []) + ([FORMS[name]] if name in FORMS else [])
    return ("" if name in _CASED else "(?i)") + "|".join(parts)


#: Typed detectors of evidence, in one order.
SIGNALS = {name: _detector(name) for name in ("coordinate", "elevation", "date", "relative_time", "doi", "measurement_verb", "instrument", "management_verb", "amount", "design_term", "site_term", "pooling", "statistic", "binomial", "unit")}


def signal_flags(rows: DataFrame, text: str, signals: dict[str, str] = SIGNALS) -> DataFrame:
    """A boolean for each signal: literal patterns in one projection, so that the text is scanned in one pass."""
    return rows.select("*", *[F.col(text).rlike(p).alias(n) for n, p in signals.items()])


def signal_matches(rows: DataFrame, text: str, signals: dict[str, str] = SIGNALS) -> DataFrame:
    """The distinct matches of each signal, in the order first seen, on the normalised text (names, which need their capitals, on the text)."""
    normal = T.canon(F.col(text))
    return rows.select("*", *[F.array_distinct(F.regexp_extract_all(F.col(text) if n in _CASED else normal, F.lit(f"({p})"), F.lit(1))).alias(n) for n, p in signals.items()])


def tier(text: Column, words: Column, phrase: str) -> Column:
    """1 the phrase, 2 all its words, 4 half of at least two words; NULL for none."""
    own = phrase.split()
    have = F.size(F.array_intersect(words, F.array(*map(F.lit, own))))
    out = F.when(F.contains(F.lower(text), F.lit(phrase)), 1).when(have == len(set(own)), 2)
    return out.when((2 * have >= len(own)) if len(own) > 1 else F.lit(False), 4)


def tier_search(rows: DataFrame, key: str, text: str, phrases: dict[str, str], k: int) -> DataFrame:
    """The k best rows of each phrase by tier and key. The phrases are a query's, a handful of columns."""
    words = F.array_distinct(F.split(T.words_key(F.col(text)), " "))
    rows = rows.select(key, F.col(text).alias("_t"), words.alias("_w"))
    tiers = F.array(*[F.struct(F.lit(q).alias("qid"), tier(F.col("_t"), F.col("_w"), p).cast("int").alias("tier")) for q, p in phrases.items()])
    hits = rows.select(key, F.explode(F.filter(tiers, lambda x: x["tier"].isNotNull())).alias("x")).select("x.qid", key, "x.tier")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("tier", key))
    return hits.withColumn("place", place.cast("int")).filter(F.col("place") <= k)


def _sieve(hashes: DataFrame, column: str, log2_bits: int = 20):
    """A test of a hash against a bitmap of fixed size, whatever the number of hashes: set bits mean "perhaps there"."""
    slot = F.col(column).bitwiseAND(F.lit((1 << log2_bits) - 1))
    words = hashes.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("mask"))
    held = [0] * ((1 << log2_bits) // 64)
    for row in words.collect():  # at most 2**log2_bits / 64 rows
        held[row["word"]] = row["mask"]
    bits = F.from_json(F.lit(str(held)), "array<bigint>")
    low = F.lit((1 << log2_bits) - 1)
    return lambda h: F.getbit(F.get(bits, F.shiftright(h.bitwiseAND(low), 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1


def grounded(passages: DataFrame, passage_key: str, passage: str, docs: DataFrame, doc_key: str, text: str, words: int = 5, chars: int = 4) -> DataFrame:
    """How many documents hold each passage (normalised), and the first: candidates share a gram.

    A passage is looked for under the hash of its inner words, at most ``words`` of them (its first
    and last may be parts of longer words in a document); one of one or two words under its first
    ``chars`` characters, the empty one under the empty gram. So documents meet passages by an equi
    join. A document's grams are tested against a bitmap of the passages' first, and what is left
    is joined and verified on the text beside it.
    """
    normal = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    p = passages.select(F.col(passage_key).alias("_p"), normal(F.col(passage)).alias("_pt"))
    own = F.split("_pt", " ")
    inner = F.array(*[F.struct(F.lit("w").alias("kind"), F.lit(n).alias("n"), F.xxhash64(F.lit("w"), F.lit(n), *[F.get(own, F.lit(k + 1)) for k in range(n)]).alias("g")) for n in range(1, words + 1)])
    first = F.array(*[F.struct(F.lit("c").alias("kind"), F.lit(n).alias("n"), F.xxhash64(F.lit("c"), F.lit(n), *[F.substring("_pt", k + 1, 1) for k in range(n)]).alias("g")) for n in range(chars + 1)])
    gram = F.when(F.size(own) > 2, F.get(inner, F.least(F.lit(words), F.size(own) - 2) - 1)).otherwise(F.get(first, F.least(F.lit(chars), F.length("_pt"))))
    p = p.withColumn("_k", gram)
    used = [(r["kind"], r["n"]) for r in p.filter("_k is not null").select("_k.kind", "_k.n").distinct().orderBy("kind", "n").collect()]  # at most words + chars + 1
    p = p.select("_p", "_pt", F.col("_k.g").alias("_g"))
    likely = _sieve(p.filter("_g is not null"), "_g")
    d = docs.select(F.col(doc_key).alias("_d"), normal(F.col(text)).alias("_dt")).filter("_dt is not null")

    def grams(kind: str, pattern: str) -> Column:
        """All grams of a kind that the bitmap has; the split text is bound once, as the one element of an array."""
        sizes = [n for k, n in used if k == kind]
        run = lambda parts, n: F.transform(F.sequence(F.lit(0), F.size(parts) - n), lambda i: F.xxhash64(F.lit(kind), F.lit(n), *[F.get(parts, i + k) for k in range(n)]))
        some = lambda parts, n: F.when(F.size(parts) >= n, F.filter(run(parts, n), likely) if n else F.array(F.xxhash64(F.lit(kind), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
        bound = F.transform(F.array(F.split("_dt", pattern)), lambda parts: F.concat(*[some(parts, n) for n in sizes]))
        return F.get(bound, F.lit(0)) if sizes else F.array().cast("array<bigint>")

    hits = d.select("_d", "_dt", F.explode(F.array_distinct(F.concat(grams("w", " "), grams("c", "")))).alias("_g"))
    found = hits.join(p, "_g").filter(F.contains("_dt", F.col("_pt"))).select("_p", "_d")
    counted = found.distinct().groupBy("_p").agg(F.count("*").alias("n"), F.min("_d").alias("first_doc"))
    out = p.select("_p").join(counted, "_p", "left")
    return out.select(F.col("_p").alias(passage_key), F.coalesce("n", F.lit(0).cast("long")).alias("n"), "first_doc")


def common_words(rows: DataFrame, part: str, text: str, share: float) -> DataFrame:
    """Words in more than a share of a part's rows."""
    sizes = rows.groupBy(part).agg(F.count("*").alias("_n"))
    words = rows.select(part, F.explode(F.array_distinct(F.split(T.words_key(F.col(text)), " "))).alias("word")).filter("word <> ''")
    df = words.groupBy(part, "word").agg(F.count("*").alias("df"))
    return df.join(sizes, part).filter(F.col("df") > share * F.col("_n")).select(part, "word", "df")


def distinctive(words: Column, common: Column) -> Column:
    """Words without the common ones, British spelling folded to American."""
    return F.array_except(F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, "our$", "or"), "is(e|ed|ing|ation)$", "iz$1")), common)


def abbreviations(blocks: DataFrame, text: str) -> DataFrame:
    """Edges term <-> alias, both ways, from 'long form (ABBR)' and from lists 'ABBR, meaning; ABBR, meaning'.

    A long form is the shortest tail of at most eight words before the bracket that starts with the abbreviation's letter.
    A list is what follows the word abbreviations.
    """
    pieces = F.transform(F.array(F.split(text, r"[()]")), lambda ps: F.transform(F.sequence(F.lit(1), F.size(ps), F.lit(2)), lambda i: F.struct(F.trim(F.coalesce(F.get(ps, i), F.lit(""))).alias("short"), F.filter(F.split(F.get(ps, i - 1), r"\s+"), lambda w: w != "").alias("words"))))
    hits = blocks.select("paper_id", F.explode(F.get(pieces, F.lit(0))).alias("h")).select("paper_id", "h.*").filter(F.col("short").rlike(r"^[A-Za-z]\w{0,14}$"))
    tails = F.transform(F.sequence(F.lit(1), F.least(F.lit(8), F.greatest(F.size("words"), F.lit(1)))), lambda n: F.slice("words", F.greatest(F.size("words") - n + 1, F.lit(1)), n))
    fits = F.filter(tails, lambda t: F.lower(F.substring(F.get(t, F.lit(0)), 1, 1)) == F.lower(F.substring("short", 1, 1)))
    edges = hits.select("paper_id", F.lower("short").alias("term"), F.lower(F.array_join(F.get(fits, F.lit(0)), " ")).alias("alias"))
    told = F.regexp_extract(text, r"(?is)\babbreviations?\b[^:]{0,20}:(.*)$", 1)
    entry = blocks.select("paper_id", F.explode(F.split(told, ";")).alias("e"))
    listed = entry.select("paper_id", F.lower(F.trim(F.substring_index("e", ",", 1))).alias("term"), F.lower(F.trim(F.rtrim(F.trim(F.expr("substring(e, instr(e, ',') + 1)")), F.lit(".")))).alias("alias"))
    edges = edges.unionByName(listed.filter(F.col("term").rlike(r"^\w{1,15}$") & (F.col("alias") != "") & (F.col("alias") != F.col("term")))).filter("alias is not null")
    return edges.unionByName(edges.select("paper_id", F.col("alias").alias("term"), F.col("term").alias("alias"))).distinct()


def ladder(candidates: DataFrame, cap: int, part: list[str]) -> DataFrame:
    """A packet of (step, rank, anchor, size): each anchor at its first step, taken in order while the budget lasts."""
    first = candidates.groupBy(*part, "anchor").agg(F.min(F.struct("step", "rank", "size")).alias("f")).select(*part, "anchor", "f.*")
    return budget_fold(first, part, ["step", "rank", "anchor"], "size", cap)


def coverage(wanted: DataFrame, hits: DataFrame, packet: DataFrame, keys: list[str]) -> DataFrame:
    """FOUND, NOT_RETRIEVED (there, but not in the packet) or ABSENT_BY_PATTERN of each wanted concept."""
    got = hits.join(packet.select(*keys, "anchor").distinct().withColumn("_in", F.lit(True)), [*keys, "anchor"], "left")
    state = got.groupBy(*keys, "concept").agg(F.coalesce(F.bool_or("_in"), F.lit(False)).alias("_found"))
    out = wanted.join(state, [*keys, "concept"], "left")
    return out.select(*keys, "concept", F.when(F.col("_found"), "FOUND").when(F.col("_found").isNull(), "ABSENT_BY_PATTERN").otherwise("NOT_RETRIEVED").alias("state"))
