"""Similarity ratios of two texts, which no built-in gives: Arrow-batched functions."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters of both."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def closest_span(value: Column, text: Column, least: float = 0.75) -> Column:
    """struct(span, ratio): the span of the text, one word longer or shorter at most, most like the value."""

    @F.pandas_udf("span string, ratio double")
    def best(values: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for v, t in zip(values, texts):
            n, words, found = len((v or "").split()), (t or "").split(), (None, None)
            for size in range(max(1, n - 1), n + 2) if n else ():
                for i in range(len(words) - size + 1):
                    span = " ".join(words[i : i + size])
                    r = SequenceMatcher(None, v, span).ratio()
                    if r >= least and (found[1] is None or r > found[1]):
                        found = (span, r)
            rows.append(found)
        return pd.DataFrame(rows, columns=["span", "ratio"])

    return best(value, text)


def differs_in_letters_only(value: Column, span: Column) -> Column:
    """As many words, and words that differ do so in letters beyond ASCII alone."""
    a, b = F.split(value, " "), F.split(span, " ")
    plain = lambda w: F.regexp_replace(w, r"[^\x00-\x7F]", "?")
    pairs = F.zip_with(a, b, lambda x, y: (x == y) | ((F.length(x) == F.length(y)) & F.forall(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: (p == q) | (plain(p) == "?") | (plain(q) == "?")), lambda s: s)))
    return (F.size(a) == F.size(b)) & F.forall(pairs, lambda p: F.coalesce(p, F.lit(False)))


def close_matches(terms: DataFrame, term: str, vocabulary: DataFrame, entry: str, least: float = 0.3, most: int = 5) -> DataFrame:
    """Advice: up to ``most`` entries like each term. The vocabulary is a fixed list of a few dozen words, held in the function."""
    words = [r[0] for r in vocabulary.select(entry).distinct().collect() if r[0] is not None]

    @F.pandas_udf("array<struct<entry: string, ratio: double>>")
    def like(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            rated = [(w, SequenceMatcher(None, w.lower(), v.strip().lower()).ratio()) for w in words] if v is not None else []
            out.append([{"entry": w, "ratio": r} for w, r in rated if r >= least])
        return pd.Series(out)

    found = terms.select(term).distinct().select(term, F.explode(like(F.col(term))).alias("_m"))
    scored = found.select(term, F.col("_m.entry").alias(entry), F.col("_m.ratio").alias("ratio"))
    place = F.row_number().over(Window.partitionBy(term).orderBy(F.desc("ratio"), entry))
    return scored.withColumn("place", place).filter(F.col("place") <= most)


#: Words that are no epithet.
NOT_EPITHETS = (
    "were was are is has have had and the for with from into online published received accepted using used measured "
    "during after before between within under over this that these those which their there then than also only both "
    "each other such more most less least same different total mean average annual daily field plots plot study data "
    "results values samples site sites area areas year years season seasons treatment treatments control effect "
    "effects state county university department analysis method methods"
).split()
#: Authors of names that are written out.
AUTHORS = ("Koch", "Moench")


def binomials(text: Column, document: Column) -> Column:
    """Scientific names in a text: a capitalised and a lower-case word of which one of three things tells that they are a name.

    An author stands behind them (an abbreviation such as 'L.', perhaps in brackets, or a known author); the document
    writes the pair with its genus abbreviated somewhere; or they stand inside a sentence, behind a lower-case word or
    an opening sign. Words are those between blanks, bound once.
    """
    name = lambda w: F.regexp_replace(w, r"^[(\[]|[^A-Za-z]+$", "")
    inside = F.regexp_replace(document, r"\.\s+", ".")

    def found(words: Column) -> Column:
        at = lambda i: F.coalesce(F.get(words, i), F.lit(""))

        def is_name(i: Column) -> Column:
            genus, epithet, behind, before = name(at(i)), name(at(i + 1)), at(i + 2), F.when(i > 0, at(i - 1)).otherwise(F.lit(""))
            pair = at(i).rlike(r"^[(\[]?[A-Z][a-z]{2,}$") & at(i + 1).rlike(r"^[a-z]{3,}[^A-Za-z]*$") & ~epithet.isin(*NOT_EPITHETS) & ~F.lower(genus).isin(*NOT_EPITHETS)
            author = at(i + 1).rlike("[a-z]$") & (behind.rlike(r"^[(\[]?[A-Z][a-z]{0,6}\.[)\]]?[,;:)]?$") | F.regexp_replace(behind, r"[^A-Za-z]+$", "").isin(*AUTHORS))
            short = F.contains(inside, F.concat(F.substring(genus, 1, 1), F.lit("."), epithet))
            return pair & (author | F.coalesce(short, F.lit(False)) | at(i).rlike(r"^[(\[]") | before.rlike(r"[a-z(,;=\[]$"))

        places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), is_name)
        return F.array_distinct(F.transform(places, lambda i: F.concat_ws(" ", name(at(i)), name(at(i + 1)))))

    bound = F.transform(F.array(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+")), found)
    return F.get(bound, F.lit(0))
