"""Link resolution: scored joins that refuse to guess, near identifiers, known references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .core import unique_best


def best_in_pool(names: DataFrame, key: str, pool: DataFrame, choice: str, token: str, out: str) -> DataFrame:
    """The pool entry that shares most tokens with each name, NULL if the best is tied or nothing is shared.

    An equi join on the token: pairs that share nothing never meet.
    """
    scored = names.join(pool, token).groupBy(key, choice).agg(F.count_distinct(token).alias("_score"))
    best = unique_best(scored, [key], "_score", [choice])
    return names.select(key).distinct().join(best, key, "left").select(key, F.col(choice).alias(out))


def pool_score(value: Column, entry: Column) -> Column:
    """2 for equal keys, 1 for one inside the other (three characters at least) or two significant tokens shared, else 0."""
    a, b = T.words_key(value), T.words_key(entry)
    inside = ((F.length(a) >= 3) & F.contains(b, a)) | ((F.length(b) >= 3) & F.contains(a, b))
    shared = F.size(F.array_intersect(T.significant_tokens(value), T.significant_tokens(entry))) >= 2
    return F.when(a == b, 2).when(inside | shared, 1).otherwise(0)


def match_in_scope(values: DataFrame, pool: DataFrame, scope: list[str], key: str, value: str, entry: str, choice: str) -> DataFrame:
    """Scored match within a scope (a paper's values and its pool, both small): strictly best by the sum over a key's values."""
    scored = values.join(pool, scope).withColumn("_score", pool_score(F.col(value), F.col(entry)))
    total = scored.groupBy(*scope, key, choice).agg(F.sum("_score").alias("_score"))
    return unique_best(total, [*scope, key], "_score", [choice])


def agreed(left: DataFrame, right: DataFrame, keys: list[str], choice: str) -> DataFrame:
    """Two matches that must not differ: the one there is, NULL where both are and disagree."""
    both = left.select(*keys, F.col(choice).alias("_a")).join(right.select(*keys, F.col(choice).alias("_b")), keys, "full")
    return both.select(*keys, F.when(F.col("_a").isNull() | F.col("_b").isNull() | (F.col("_a") == F.col("_b")), F.coalesce("_a", "_b")).alias(choice))


def tiers(*found: DataFrame, keys: list[str], choice: str) -> DataFrame:
    """The choice of the first tier that has one, with the tier's number."""
    out = None
    for n, tier in enumerate(found, 1):
        own = tier.filter(F.col(choice).isNotNull()).select(*keys, F.struct(F.lit(n).alias("tier"), choice).alias("_t"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy(*keys).agg(F.min("_t").alias("_t")).select(*keys, "_t.tier", f"_t.{choice}")


def one_edit_apart(ids: DataFrame, key: str) -> DataFrame:
    """Pairs of distinct identifiers one insertion, deletion or change apart, each once.

    Two that differ in one letter are equal without it, and meet on that place and form; a longer one meets the shorter
    on its own form, of a run of equal letters without the first. So rows that meet are pairs. Forms are many times the
    ids they are made of, which the planner's sizes do not show: a broadcast would fill the driver, so both joins merge.
    """
    ids = ids.select(F.col(key).alias("id")).filter("id is not null").distinct()
    i, form, n = F.col("i"), F.col("form"), F.length("id")
    head, tail = F.substring("id", F.lit(1), i - 1), F.substring("id", i + 1, n)
    places = ids.select("id", F.explode(F.when(n > 0, F.sequence(F.lit(1), n))).alias("i"))
    rows = places.select("i", F.concat(head, tail).alias("form"), F.substring("id", i, F.lit(1)).alias("letter"))
    with_letter = lambda c: F.concat(F.substring(form, F.lit(1), i - 1), F.col(c), F.substring(form, i, F.length(form)))
    other = rows.withColumnRenamed("letter", "letter_b").hint("merge")
    changed = rows.join(other, ["i", "form"]).filter("letter < letter_b").select(with_letter("letter").alias("id_a"), with_letter("letter_b").alias("id_b"))
    longer = rows.filter((i == 1) | (F.substring(form, i - 1, F.lit(1)) != F.col("letter"))).hint("merge")
    short, long = F.col("id"), with_letter("letter")
    grown = ids.join(longer, short == form).select(F.least(short, long).alias("id_a"), F.greatest(short, long).alias("id_b"))
    return changed.unionByName(grown)


def known_references(candidates: DataFrame, pools: DataFrame, keys: list[str]) -> DataFrame:
    """How each candidate's required link is bound: its own, the pool's only record if the pool is complete, else refused.

    ``pools``: keys, ids (array of ready records), complete (no record is still open).
    """
    rows = candidates.join(pools, keys, "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    own = F.col("link").isNotNull() & F.array_contains(ids, F.col("link"))
    only = F.col("link").isNull() & (F.size(ids) == 1) & F.coalesce("complete", F.lit(False))
    bound = F.when(own, F.col("link")).when(only, ids[0])
    refusal = F.when(bound.isNotNull(), F.lit(None)).when(F.size(ids) == 0, "BLOCKED_PREREQUISITE").when(F.col("link").isNotNull(), "BLOCKED_PREREQUISITE").otherwise("AMBIGUOUS")
    return rows.select(*candidates.columns, bound.alias("bound"), refusal.alias("refusal"))


def referenceable(records: DataFrame) -> DataFrame:
    """Ready records, and unresolved ones with an identity field that is grounded and not in doubt."""
    return records.filter((F.col("status") == "ready") | ((F.col("status") == "unresolved") & (F.size(F.array_except("grounded_identity", "doubted")) > 0)))


def verified_phrases(links: DataFrame, name: str, description: str, cited: str) -> DataFrame:
    """Links whose name stands as a whole phrase both in the description and in the cited text."""
    padded = lambda c: F.concat(F.lit(" "), T.words_key(F.col(c)), F.lit(" "))
    return links.filter(F.contains(padded(description), padded(name)) & F.contains(padded(cited), padded(name)))
