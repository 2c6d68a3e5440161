"""Replay of recorded runs: expectations against sources, traces and records; verdicts old and new."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def verify_expectations(expectations: DataFrame, blocks: DataFrame) -> DataFrame:
    """Faults of a corpus: literals that their cited blocks don't hold, unknown anchors, patterns that do match, repeated ids."""
    cited = expectations.select("paper_id", "id", F.explode("anchors").alias("anchor")).join(blocks.select("paper_id", "anchor", "text"), ["paper_id", "anchor"], "left")
    missing = cited.filter("text is null").select("paper_id", "id", F.lit("anchor_missing").alias("fault"), F.col("anchor").alias("detail"))
    held = cited.filter("text is not null").groupBy("paper_id", "id").agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))
    literals = expectations.select("paper_id", "id", F.explode("literals").alias("literal")).join(held, ["paper_id", "id"], "left")
    absent = literals.filter(~F.coalesce(F.contains(T.canon(F.col("text")), T.canon(F.col("literal"))), F.lit(False))).select("paper_id", "id", F.lit("literal_absent").alias("fault"), F.col("literal").alias("detail"))
    patterns = expectations.filter("status = 'absent' and pattern is not null").select("paper_id", "id", "pattern")
    # a paper's blocks meet its own few patterns alone
    hit = patterns.join(blocks.select("paper_id", "text"), "paper_id").filter(F.regexp_like("text", F.concat(F.lit("(?i)"), "pattern")))
    found = hit.select("paper_id", "id", F.lit("pattern_matches").alias("fault"), F.col("pattern").alias("detail")).distinct()
    twice = expectations.groupBy("paper_id", "id").agg(F.count("*").alias("n")).filter("n > 1").select("paper_id", "id", F.lit("id_repeats").alias("fault"), F.col("n").cast("string").alias("detail"))
    return reduce(DataFrame.unionByName, [missing, absent, found, twice])


def outcome_holds(expectations: DataFrame, fields: DataFrame) -> DataFrame:
    """Whether one record satisfies an expectation's whole outcome: status, and a field with one of the texts and labels.

    ``fields``: paper_id, entity_type, record_id, status, field_name, value, label. ``expectations``: paper_id, id,
    entity_type, fields (array), contains_any, label_in, status_in (arrays, empty or null for any).
    """
    any_ = lambda c, test: (F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) == 0) | test
    asked = expectations.select("paper_id", "id", "entity_type", "fields", "contains_any", "label_in", "status_in")
    rows = asked.join(fields, ["paper_id", "entity_type"], "left")
    text = T.canon(F.coalesce("value", F.lit("")))
    good = (
        any_("fields", F.array_contains("fields", F.col("field_name")))
        & any_("contains_any", F.exists("contains_any", lambda n: F.contains(text, T.canon(n))))
        & any_("label_in", F.array_contains("label_in", F.col("label")))
        & any_("status_in", F.array_contains("status_in", F.col("status")))
    )
    return rows.groupBy("paper_id", "id").agg(F.coalesce(F.bool_or(good & F.col("record_id").isNotNull()), F.lit(False)).alias("captured"))


def score(expectations: DataFrame, traces: DataFrame, cells: DataFrame, captured: DataFrame) -> DataFrame:
    """supplied, retrieved, cited and captured of each expectation, and its state.

    ``traces``: paper_id, entity_type, kind ('supplied', 'retrieved', 'cited'), anchor. A table's
    anchor stands for its cells too.
    """
    own = expectations.select("paper_id", "id", "entity_type", F.explode("anchors").alias("anchor"))
    inner = own.join(cells.select("paper_id", F.col("parent_table_anchor").alias("anchor"), F.col("anchor").alias("cell")), ["paper_id", "anchor"]).select("paper_id", "id", "entity_type", F.col("cell").alias("anchor"))
    seen = own.unionByName(inner).distinct().join(traces, ["paper_id", "entity_type", "anchor"])
    kinds = seen.groupBy("paper_id", "id").agg(*[F.bool_or(F.col("kind") == k).alias(k) for k in ("supplied", "retrieved", "cited")])
    out = expectations.select("paper_id", "id", "status").join(kinds, ["paper_id", "id"], "left").join(captured, ["paper_id", "id"], "left")
    for name in ("supplied", "retrieved", "cited", "captured"):
        out = out.withColumn(name, F.coalesce(name, F.lit(False)))
    state = F.when(F.col("status") == "absent", F.when(F.col("captured"), "invented").otherwise("rightly_absent")).when(F.col("captured"), "captured").when(F.col("cited"), "cited_not_captured").when(F.col("supplied") | F.col("retrieved"), "seen_not_cited").otherwise("not_seen")
    return out.withColumn("state", state)


def summary(scored: DataFrame) -> DataFrame:
    """Counts of each paper by what was reached."""
    return scored.groupBy("paper_id").agg(F.count("*").alias("expectations"), *[F.count_if(F.col(n)).alias(n) for n in ("supplied", "retrieved", "cited", "captured")], F.count_if(F.col("state") == "invented").alias("invented"))


def packet_recall(expectations: DataFrame, packets: DataFrame) -> DataFrame:
    """Whether every literal of an expectation stands in its entity's packet."""
    text = packets.groupBy("paper_id", "entity_type").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])).alias("packet"))
    rows = expectations.join(text, ["paper_id", "entity_type"], "left")
    return rows.select("paper_id", "id", F.coalesce(F.forall("literals", lambda s: F.contains(T.canon(F.col("packet")), T.canon(s))), F.lit(False)).alias("recalled"))


def verdict_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Records whose verdict differs between two sets of rules, or stands in one alone."""
    both = old.select(*keys, F.col("verdict").alias("old")).join(new.select(*keys, F.col("verdict").alias("new")), keys, "full")
    return both.filter(~F.col("old").eqNullSafe(F.col("new")))


# ------------------------------------------------------------------ states of records


def terminal_state(attempts: DataFrame) -> DataFrame:
    """Each record's last state: ready if committed, unresolved if flagged, not ready or in doubt, else error.

    ``attempts``: paper_id, entity_type, record_id, seq, outcome ('committed', 'flagged', 'not_ready',
    'suspicious', 'failed').
    """
    last = attempts.groupBy("paper_id", "entity_type", "record_id").agg(F.max_by("outcome", "seq").alias("outcome"), F.count("*").alias("attempts"))
    status = F.when(F.col("outcome") == "committed", "ready").when(F.col("outcome").isin("flagged", "not_ready", "suspicious"), "unresolved").otherwise("error")
    return last.withColumn("status", status)


#: What a concern about the style of a name says; a final '-' lets any ending follow.
NAMING_STYLE = (
    "omit-", "lack", "lacks", "missing qualifier", "missing word", "missing prefix", "missing context", "missing the qualifier", "missing the word",
    "missing the prefix", "missing the context", "qualifier", "incomplete", "more specific", "more descriptive", "more complete", "full name",
    "full form", "full term", "fuller name", "fuller form", "fuller term", "abbreviat-", "shortened", "less specific", "does not reflect",
    "does not fully reflect", "does not capture", "does not fully capture",
)


def is_naming_style(concern: Column) -> Column:
    """Whether a concern is about how much of a name was given, by whole words."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(concern, F.lit(""))), "[^a-z0-9]+", " "), F.lit(" "))
    found = F.lit(False)
    for phrase in NAMING_STYLE:
        found = found | F.contains(words, F.lit(" " + (phrase[:-1] if phrase.endswith("-") else phrase + " ")))
    return found


def settle_concerns(fields: DataFrame, concerns: DataFrame, required: list[str]) -> DataFrame:
    """Fields demoted where a validator doubts them; a record is settled if no required field of it is doubted.

    Concerns about naming style alone demote nothing.
    """
    real = concerns.filter(~is_naming_style(F.col("concern"))).select("record_id", "field_name").distinct().withColumn("_doubted", F.lit(True))
    rows = fields.join(real, ["record_id", "field_name"], "left").withColumn("doubted", F.coalesce("_doubted", F.lit(False))).drop("_doubted")
    lost = rows.groupBy("record_id").agg(F.bool_or(F.col("doubted") & F.col("field_name").isin(required)).alias("lost"))
    return rows.join(lost, "record_id").select(*fields.columns, "doubted", (~F.col("lost")).alias("settled"))


def drop_ungrounded(facts: DataFrame, core: list[str]) -> DataFrame:
    """Facts that their text does not support go, but only where every ungrounded fact of the record is no core one and one grounded is left."""
    rows = facts.groupBy("record_id").agg(F.bool_or(~F.col("grounded") & F.col("field_name").isin(core)).alias("_core"), F.bool_or("grounded").alias("_left"))
    return facts.join(rows, "record_id").filter(F.col("grounded") | F.col("_core") | ~F.col("_left")).select(*facts.columns)


def balanced(text: Column) -> Column:
    """As many opening as closing brackets of each kind, and an even number of dollar signs."""
    pair = lambda a, b: F.regexp_count(text, F.lit(a)) == F.regexp_count(text, F.lit(b))
    return pair(r"\(", r"\)") & pair(r"\[", r"\]") & pair(r"\{", r"\}") & (F.regexp_count(text, F.lit(r"\$")) % 2 == 0)
