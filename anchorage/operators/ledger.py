"""Ledgers and rollups: latest state, buckets, causes, review effects, dependency layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import latest_wins

#: Entity types and the types they need first.
DEPENDENCIES = (
    ("Coverage", "Citation"), ("Crop", "Citation"), ("Crop", "Species"), ("Method", "Citation"), ("Study", "Citation"),
    ("Treatment", "Citation"), ("Treatment", "Site"), ("Treatment", "Study"), ("Management", "Treatment"),
    ("Observation", "Treatment"), ("Observation", "Variable"), ("Observation", "Method"), ("Observation", "Crop"), ("TreatmentPair", "Treatment"),
)
ACTIONS = ("accept", "reject", "edit", "unresolve", "flag", "reset")


def layers(edges) -> list[list[str]]:
    """Topological layers, alphabetical within each; a cycle is an error. The graph is a constant of a dozen nodes."""
    needs: dict[str, set[str]] = {}
    for entity, other in edges:
        needs.setdefault(entity, set()).add(other)
        needs.setdefault(other, set())
    out, done = [], set()
    while len(done) < len(needs):
        ready = sorted(e for e, n in needs.items() if e not in done and n <= done)
        if not ready:
            raise ValueError("the dependencies form a cycle")
        out.append(ready)
        done |= set(ready)
    return out


def dependents(edges, roots: set[str]) -> set[str]:
    """The roots and all that need them, directly or not: what a resumed run repeats."""
    found = set(roots)
    while True:
        more = {e for e, n in edges if n in found} - found
        if not more:
            return found
        found |= more


def buckets(rows: DataFrame, part: str, status: str, names: list[str]) -> DataFrame:
    """Rows of each part by status, with every status present."""
    parts = rows.select(part).distinct().select(part, F.explode(F.array(*map(F.lit, names))).alias("bucket"))
    counted = rows.filter(F.col(status).isNotNull()).groupBy(part, F.col(status).alias("bucket")).agg(F.count("*").alias("n"))
    return parts.join(counted, [part, "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def preferred(rows: DataFrame, keys: list[str], wanted: Column, order: str) -> DataFrame:
    """The last wanted row of each key, else its last row, and whether it is a wanted one."""
    return rows.groupBy(*keys).agg(F.coalesce(F.max(F.when(wanted, F.col(order))), F.max(order)).alias(order), F.bool_or(wanted).alias("preferred"))


def first_rule(rules: list[tuple[Column, str | None]], default: str) -> Column:
    """The outcome of the first rule that fits."""
    return reduce(lambda rest, r: F.when(F.coalesce(r[0], F.lit(False)), F.lit(r[1])).otherwise(rest), reversed(rules), F.lit(default))


def cause_of(status: Column, detail: Column, reason: Column, errors: Column, readiness: Column) -> Column:
    """Why a record is not ready, NULL if it is; ``detail`` has unresolved_cause, failure_kind, failure_class, message and unresolved_by."""
    text = F.coalesce(errors, F.lit(""))
    message, ready = F.coalesce(detail["message"], F.lit("")), F.coalesce(readiness, F.lit(""))
    has = lambda t, *words: reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in words])
    judged = (detail["unresolved_by"] == "ai_validation") | has(text, "AI Validator", "AI validator")
    return first_rule(
        [
            (status == "ready", None),
            (detail["unresolved_cause"].isNotNull() & (detail["unresolved_cause"] == "CONFLICT"), "CONFLICT"),
            (detail["unresolved_cause"] == "NOT_RETRIEVED", "NOT_RETRIEVED"),
            (detail["unresolved_cause"] == "AMBIGUOUS", "AMBIGUOUS"),
            (detail["unresolved_cause"] == "ABSENT", "ABSENT"),
            ((status == "blocked") & has(F.coalesce(reason, F.lit("")), "current-IR limitation"), "SCHEMA_LIMITATION"),
            (status == "blocked", "BLOCKED_PREREQUISITE"),
            ((status == "error") & ((detail["failure_kind"] == "provider") | F.coalesce(detail["failure_class"], F.lit("")).startswith("provider")), "PROVIDER_FAILURE"),
            ((status == "error") & has(message, "raw evidence grounding failed"), "GROUNDING_FAILURE"),
            ((status == "error") & (has(message, "no final answer") | (detail["failure_class"] == "no_final_answer")), "NOT_RETRIEVED"),
            (status == "error", "VALIDATION_FAILURE"),
            (judged & ~has(text, "value withdrawn"), "AI_CONCERN"),
            (has(text, "is ambiguous among"), "AMBIGUOUS"),
            (has(F.lower(text), "conflict") & has(F.lower(text), "contradict"), "CONFLICT"),
            (has(text, "provenance_", "is not supported by block", "is not found in the cited block"), "GROUNDING_FAILURE"),
            (has(ready, "without providing a numeric", "does not give"), "ABSENT"),
            (has(ready, "AI validator concern"), "AI_CONCERN"),
        ],
        "NOT_READY",
    )


def dataset_records(log: DataFrame, run: str | None = None) -> DataFrame:
    """The records a ledger holds: its latest line for each (entity, record), of one run if asked, those that are ready.

    The run's filter comes before the choice of the latest line; lines are ordered by seq, not by time.
    """
    rows = log if run is None else log.filter(F.col("run_id") == run)
    return latest_wins(rows, ["paper_id", "entity_type", "record_id"], F.col("seq")).filter("status = 'ready'")


def review_state(fields: DataFrame, corrections: DataFrame, run: str) -> DataFrame:
    """Each field's effective value and review state from the latest action on it and on its record.

    Actions without a run apply to all runs; an action without a field applies to the record, and
    matches nothing else.
    """
    c = corrections.filter((F.col("run_id") == run) | F.col("run_id").isNull())
    last = latest_wins(c, ["paper_id", "entity_type", "record_id", "field_name"], F.col("seq"), ["action", "payload"])
    of_field = last.filter("field_name is not null").withColumnsRenamed({"action": "field_action", "payload": "field_payload"})
    of_record = last.filter("field_name is null").drop("field_name", "payload").withColumnRenamed("action", "record_action")
    keys = ["paper_id", "entity_type", "record_id"]
    found = fields.join(of_field, [*keys, "field_name"], "left").join(of_record, keys, "left")
    action = F.coalesce("field_action", "record_action")
    value = F.when(F.col("field_action") == "edit", F.col("field_payload")).when(action.isin("reject", "unresolve"), F.lit(None)).otherwise(F.col("value"))
    state = F.when(action == "edit", "edited").when(action == "accept", "accepted").when(action == "reject", "rejected").when(action == "unresolve", "unresolved").when(action == "flag", "flagged").otherwise("open")
    return found.select(*keys, "field_name", "value", value.alias("effective"), state.alias("review"))


def review_summary(state: DataFrame, link_fields: list[str]) -> DataFrame:
    """Fields, reviewed, unresolved and remaining of each paper; link fields don't count."""
    rows = state.filter(~F.col("field_name").isin(link_fields))
    done = F.col("review") != "open"
    return rows.groupBy("paper_id").agg(F.count("*").alias("fields"), F.count_if(done).alias("reviewed"), F.count_if((F.col("review") == "unresolved") | (~done & F.col("value").isNull())).alias("unresolved"), F.count_if(~done).alias("remaining"))


def failure_counts(log: DataFrame) -> DataFrame:
    """Failures by stage, by class, and in all, in one pass."""
    return log.groupingSets([[F.col("stage")], [F.col("failure_class")], []], "stage", "failure_class").agg(F.count("*").alias("n")).select("stage", "failure_class", "n")


def run_outcome(records: DataFrame) -> DataFrame:
    """success or completed_with_errors of each run."""
    return records.groupBy("run_id").agg(F.when(F.bool_or(F.col("status") == "error"), "completed_with_errors").otherwise("success").alias("outcome"))


def signature(errors: Column) -> Column:
    """Errors as a set, to see that two attempts in a row failed alike."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(errors)), "\n"), 256)


def stagnant(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Attempts that failed just as the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("attempt")
    return attempts.withColumn("signature", signature(F.col("errors"))).withColumn("stagnant", F.coalesce(F.col("signature") == F.lag("signature").over(w), F.lit(False)))


def source_page(locators: DataFrame, blocks: DataFrame) -> DataFrame:
    """The page of the first cited block that has one, for each record."""
    found = locators.join(blocks.select("paper_id", "anchor", "page"), ["paper_id", "anchor"])
    return found.filter("page is not null").groupBy("paper_id", "record_id").agg(F.min_by("page", "pos").alias("page"))


def fingerprint(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\u0001", *parts), 256), 1, 16)
