"""Integrity rules over record tables: uniqueness, references, readiness, and the rules of the record graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import issues


def duplicates(rows: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Keys that stand more than once, with their number."""
    found = rows if where is None else rows.filter(where)
    return found.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def dangling(rows: DataFrame, reference: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose non-null reference has no parent; the parent side is its distinct keys alone."""
    keys = parent.select(F.col(key).alias("_key")).distinct()
    return rows.filter(F.col(reference).isNotNull()).join(keys, F.col(reference) == F.col("_key"), "left_anti")


def spanning(rows: DataFrame, keys: list[str], scope: str) -> DataFrame:
    """Keys whose rows lie in more than one scope."""
    return rows.groupBy(*keys).agg(F.count_distinct(scope).alias("scopes")).filter("scopes > 1")


def rollup_issues(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule (severity, code) with its number of issues, 0 included."""
    counted = found.groupBy("code").agg(F.count("*").alias("n"))
    return rules.join(counted, "code", "left").select("severity", "code", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


# ---- the record graph: a dataset is a dict of DataFrames, one for each entity type; fields that
# ---- hold an extracted value are structs with value and provenance_label

ENTITIES = ("Citation", "Study", "Site", "Species", "Crop", "Method", "Variable", "Treatment", "TreatmentPair", "Management", "Observation", "Coverage")
CITED = ("Crop", "Method", "Treatment", "TreatmentPair", "Management", "Observation", "Coverage")
#: Fields a record needs resolved to be ready, and groups of which one must be.
REQUIRED = {"Observation": ("value", "variable_name"), "Variable": ("name",), "Method": ("name",), "Treatment": ("name", "definition")}
ANY_OF = {"Crop": (("cultivar", "common_name"),)}
#: Fixed value: a treatment name that looks like a rate.
QUANTITY = r"(?i)\d+(\.\d+)?\s*(kg|g|mg|t|ha|kgha|mm|cm|m|%|ppm)"


def _value(field: str) -> Column:
    return F.col(field)["value"]


def _label(field: str) -> Column:
    return F.col(field)["provenance_label"]


def _scope() -> Column:
    """A treatment's naming scope: its study where it has one, else its citation, each with its kind."""
    study = _value("study_id")
    return F.when(study.isNotNull(), F.concat(F.lit("study:"), study)).otherwise(F.concat(F.lit("citation:"), F.col("citation_id")))


def unique_ids(ds):
    every = reduce(DataFrame.unionByName, [ds[e].select(F.lit(e).alias("entity"), "id") for e in ENTITIES if e in ds])
    found = duplicates(every, ["entity", "id"])
    return found.select(F.lit("error").alias("severity"), F.lit("duplicate_id").alias("code"), F.col("entity").alias("entity_type"), F.col("id").alias("entity_id"), F.concat_ws(" ", F.col("n").cast("string"), F.lit("records share this id")).alias("message"))


def _unique_value(entity: str, field: str, code: str):
    def rule(ds):
        rows = ds[entity].select("id", _value(field).alias("v")).filter("v is not null and v <> ''")
        found = duplicates(rows, ["v"])
        return issues(found, "error", code, entity, "v", F.concat_ws(" ", F.col("n").cast("string"), F.lit("records share this value")))

    return rule


def treatment_names(ds):
    rows = ds["Treatment"].select(_scope().alias("scope"), F.coalesce(_value("name"), F.col("id")).alias("v"))
    return issues(duplicates(rows, ["scope", "v"]), "error", "duplicate_treatment_name", "Treatment", "v", F.concat_ws(" ", F.lit("not unique in"), "scope"))


def single_control(ds):
    rows = ds["Treatment"].filter(_value("control_status")).select("id", _scope().alias("scope"), F.col("site_id"))
    found = rows.groupBy("scope", "site_id").agg(F.sort_array(F.collect_list("id")).alias("ids")).filter(F.size("ids") > 1)
    return issues(found, "error", "multiple_controls", "Treatment", F.array_join("ids", ","), F.concat_ws(" ", F.lit("controls in"), "scope"))


def management_treatments(ds):
    rows = ds["Management"].filter(_label("treatment_ids") != "UNRESOLVED")
    empty = issues(rows.filter(F.size(F.coalesce(_value("treatment_ids"), F.array().cast("array<string>"))) == 0), "error", "management_without_treatment", "Management", "id", "no treatment is linked")
    refs = rows.select("id", F.explode(_value("treatment_ids")).alias("ref"))
    return empty.unionByName(issues(dangling(refs, "ref", ds["Treatment"], "id"), "error", "management_treatment_missing", "Management", "id", F.concat_ws(" ", F.lit("unknown treatment"), "ref")))


def denormalized(ds):
    t = ds["Treatment"].select(F.col("id").alias("tid"), F.col("site_id").alias("tsite"), F.coalesce(_value("study_id"), F.col("citation_id")).alias("tscope"))
    o = ds["Observation"].filter(F.col("treatment_id").isNotNull()).join(t, F.col("treatment_id") == F.col("tid"), "left")
    missing = issues(o.filter("tid is null"), "error", "observation_treatment_missing", "Observation", "id", F.concat_ws(" ", F.lit("unknown treatment"), "treatment_id"))
    sites = issues(o.filter("tid is not null and site_id is not null and tsite is not null and site_id <> tsite"), "error", "observation_site_mismatch", "Observation", "id", "site differs from the treatment's")
    m = ds["Management"].select("id", F.explode(_value("treatment_ids")).alias("tid")).join(t, "tid")
    return missing.unionByName(sites).unionByName(issues(spanning(m, ["id"], "tscope"), "error", "management_spans_scopes", "Management", "id", "its treatments lie in several scopes"))


def containment(ds):
    if "dataset_id" not in ds:
        raise ValueError("containment needs the dataset's own id: a one-row table 'dataset_id' of (root)")
    root = ds["dataset_id"]
    found = ds["Observation"].join(F.broadcast(root), F.col("dataset_id") != F.col("root"))  # one row
    return issues(found, "error", "dataset_id_mismatch", "Observation", "id", "belongs to another dataset")


def effect_scope(ds):
    o = ds["Observation"].withColumn("n", F.size(F.coalesce(_value("aggregated_over_factors"), F.array().cast("array<string>")))).withColumn("s", _value("reported_effect_scope"))
    mean = o.filter((F.col("s") == "treatment_mean") & (F.coalesce(_label("aggregated_over_factors") != "EXTRACTED", F.lit(True)) | (F.col("n") > 0)))
    agg = o.filter((F.col("s") == "aggregated_mean") & (F.col("aggregated_over_factors").isNull() | ((_label("aggregated_over_factors") == "EXTRACTED") & (F.col("n") == 0))))
    return issues(mean.unionByName(agg), "error", "effect_scope_shape", "Observation", "id", "aggregated factors do not fit the effect scope")


def treatment_study(ds):
    t = ds["Treatment"].filter(F.col("study_id").isNotNull())
    open_ = issues(t.filter(_label("study_id") == "UNRESOLVED"), "warning", "treatment_study_unresolved", "Treatment", "id", "its study is not resolved")
    refs = t.filter(_label("study_id") != "UNRESOLVED").select("id", _value("study_id").alias("ref"))
    return open_.unionByName(issues(dangling(refs, "ref", ds["Study"], "id"), "error", "treatment_study_missing", "Treatment", "id", F.concat_ws(" ", F.lit("unknown study"), "ref")))


def study_citations(ds):
    refs = ds["Study"].select("id", F.explode("citation_ids").alias("ref"))
    return issues(dangling(refs, "ref", ds["Citation"], "id"), "error", "study_citation_missing", "Study", "id", F.concat_ws(" ", F.lit("unknown citation"), "ref"))


def citations(ds):
    refs = reduce(DataFrame.unionByName, [ds[e].select(F.lit(e).alias("e"), "id", F.col("citation_id").alias("ref")) for e in CITED])
    found = dangling(refs, "ref", ds["Citation"], "id")
    return found.select(F.lit("error").alias("severity"), F.lit("citation_missing").alias("code"), F.col("e").alias("entity_type"), F.col("id").alias("entity_id"), F.concat_ws(" ", F.lit("unknown citation"), "ref").alias("message"))


def _reference(entity: str, column: str, parent: str, code: str):
    def rule(ds):
        return issues(dangling(ds[entity].select("id", F.col(column).alias("ref")), "ref", ds[parent], "id"), "error", code, entity, "id", F.concat_ws(" ", F.lit(f"unknown {parent}"), "ref"))

    return rule


def variable_references(ds):
    return _reference("Observation", "variable_id", "Variable", "variable_missing")(ds).unionByName(_reference("Coverage", "variable_id", "Variable", "variable_missing")(ds))


def pair_references(ds):
    t = ds["Treatment"].select(F.col("id").alias("tid"), F.col("citation_id").alias("tcitation"))
    sides = ds["TreatmentPair"].select("id", F.col("citation_id").alias("c"), F.explode(F.array("treatment_id_1", "treatment_id_2")).alias("ref"))
    found = sides.join(t, F.col("ref") == F.col("tid"), "left")
    missing = issues(found.filter("tid is null"), "error", "pair_treatment_missing", "TreatmentPair", "id", F.concat_ws(" ", F.lit("unknown treatment"), "ref"))
    both = found.filter("tid is not null").groupBy("id").agg(F.count_distinct("tcitation").alias("n")).filter("n > 1")
    return missing.unionByName(issues(both, "error", "pair_citation_mismatch", "TreatmentPair", "id", "its treatments have different citations"))


def control_optional(ds):
    """Explicitly no rule: a treatment need not say whether it is a control."""
    return issues(ds["Treatment"].filter(F.lit(False)), "error", "none", "Treatment", "id", "")


def name_not_quantity(ds):
    found = ds["Treatment"].filter(F.replace(F.coalesce(_value("name"), F.lit("")), F.lit("_"), F.lit("")).rlike(QUANTITY))
    return issues(found, "warning", "treatment_name_may_encode_quantity", "Treatment", "id", "its name looks like a rate")


#: The rules in order; each takes the dataset and returns issues.
RULES = {
    "unique_ids": unique_ids,
    "site_names": _unique_value("Site", "name", "duplicate_site_name"),
    "species_names": _unique_value("Species", "scientific_name", "duplicate_scientific_name"),
    "treatment_names": treatment_names,
    "single_control": single_control,
    "management_treatments": management_treatments,
    "denormalized": denormalized,
    "containment": containment,
    "effect_scope": effect_scope,
    "treatment_study": treatment_study,
    "study_citations": study_citations,
    "citations": citations,
    "variable_names": _unique_value("Variable", "name", "duplicate_variable_name"),
    "crop_species": _reference("Crop", "species_id", "Species", "crop_species_missing"),
    "pair_references": pair_references,
    "variable_references": variable_references,
    "crop_references": _reference("Observation", "crop_id", "Crop", "crop_missing"),
    "coverage_sites": _reference("Coverage", "site_id", "Site", "coverage_site_missing"),
    "control_optional": control_optional,
    "name_not_quantity": name_not_quantity,
}


def validate(ds: dict[str, DataFrame]) -> DataFrame:
    """All rules' issues: one plan, so scans of a table are shared."""
    return reduce(DataFrame.unionByName, [rule(ds) for rule in RULES.values()])


def readiness(entity: str, rows: DataFrame) -> DataFrame:
    """Why records are not ready: a required field, or a whole any-of group, without a resolved value."""
    open_ = lambda f: F.col(f).isNull() | _value(f).isNull() | F.coalesce(_label(f) == "UNRESOLVED", F.lit(False))
    found = [issues(rows.filter(open_(f)), "error", f"{entity.lower()}_{f}_unresolved", entity, "id", f"{f} is not resolved") for f in REQUIRED.get(entity, ())]
    for group in ANY_OF.get(entity, ()):
        found.append(issues(rows.filter(reduce(lambda a, b: a & b, map(open_, group))), "error", f"{entity.lower()}_identity_unresolved", entity, "id", f"none of {', '.join(group)} is resolved"))
    return reduce(DataFrame.unionByName, found) if found else issues(rows.filter(F.lit(False)), "error", "none", entity, "id", "")


def upsert(rows: DataFrame, candidates: DataFrame, key: str = "id") -> DataFrame:
    """Rows with the candidates in place of those of the same key, or added."""
    return rows.join(candidates.select(key).distinct(), key, "left_anti").unionByName(candidates)


def may_propose(attempts: DataFrame, keys: list[str], cap: int = 4) -> DataFrame:
    """For each record, failed proposals since its last commit or flag, and whether another is allowed."""
    last = attempts.filter("outcome in ('committed', 'flagged')").groupBy(*keys).agg(F.max("seq").alias("last"))
    fails = attempts.filter("outcome = 'failed'").join(last, keys, "left").filter("last is null or seq > last")
    counted = fails.groupBy(*keys).agg(F.count("*").alias("failed"))
    every = attempts.select(*keys).distinct().join(counted, keys, "left").withColumn("failed", F.coalesce("failed", F.lit(0).cast("long")))
    return every.withColumn("allowed", F.col("failed") < cap)
