"""Queries that run the record graph's operators over the driver's tables, mapped to entities, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import integrity, ledger, lookups, validation
from .catalogue import query, read

_LABEL = "CASE WHEN {0} THEN 'UNRESOLVED' ELSE 'EXTRACTED' END"

#: Each entity as (table, expressions); customers of one segment are no citations, so that references dangle.
_GRAPH = {
    "Citation": ("customer WHERE c_mktsegment <> 'BUILDING'", {"id": "c_custkey"}),
    "Study": ("customer WHERE c_acctbal > 0", {"id": "c_custkey", "citation_ids": "ARRAY(c_custkey, c_nationkey)"}),
    "Site": ("supplier", {"id": "s_suppkey", "name": "s_nationkey"}),
    "Species": ("part", {"id": "p_partkey", "scientific_name": "p_name"}),
    "Crop": ("customer", {"id": "c_custkey", "citation_id": "c_custkey", "species_id": "c_custkey + 100 * c_nationkey"}),
    "Method": ("nation", {"id": "n_nationkey", "citation_id": "n_nationkey"}),
    "Variable": ("nation", {"id": "n_nationkey", "name": "n_regionkey"}),
    "Treatment": (
        "orders",
        {"id": "o_orderkey", "citation_id": "o_custkey", "site_id": "o_orderstatus", "study": "CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE o_custkey END", "study_label": _LABEL.format("o_orderpriority LIKE '4%'"), "name": "CASE WHEN o_totalprice > 150000 THEN '20 kg ha' ELSE o_orderpriority END", "control": "o_orderstatus = 'F'"},
    ),
    "TreatmentPair": ("orders", {"id": "o_orderkey", "citation_id": "o_custkey", "treatment_id_1": "o_orderkey", "treatment_id_2": "o_custkey"}),
    "Management": ("events", {"id": "event_id", "citation_id": "user_id", "treatments": "CASE WHEN event_type = 'error' THEN ARRAY() ELSE ARRAY(user_id, event_id) END", "treatments_label": _LABEL.format("event_type = 'view'")}),
    "Observation": (
        "lineitem",
        {"id": "l_orderkey || '/' || l_linenumber", "citation_id": "l_suppkey", "treatment_id": "CASE WHEN l_returnflag = 'R' THEN l_partkey ELSE l_orderkey END", "site_id": "l_linestatus", "variable_id": "5 * l_linenumber", "crop_id": "l_partkey", "dataset_id": "l_returnflag", "scope": "CASE WHEN l_linenumber < 3 THEN 'treatment_mean' ELSE 'aggregated_mean' END", "told": "l_tax <= 0.06", "pooled": "CASE WHEN l_discount > 0.05 THEN ARRAY('x') ELSE ARRAY() END", "pooled_label": "CASE WHEN l_tax > 0.04 THEN 'INFERRED' ELSE 'EXTRACTED' END"},
    ),
    "Coverage": ("labels", {"id": "quality", "citation_id": "doc_id", "variable_id": "quality", "site_id": "doc_id"}),
}
_PLAIN = ("control", "told")


def _cast(name: str, expression: str, dialect: str) -> str:
    text = "STRING" if dialect == "spark" else "VARCHAR"
    if name in _PLAIN:
        return expression
    if "ARRAY(" not in expression:
        return f"CAST({expression} AS {text})"
    return f"CAST({expression} AS ARRAY<STRING>)" if dialect == "spark" else f"CAST({expression.replace('ARRAY(', '[').replace(')', ']')} AS VARCHAR[])"


def _dataset(spark, sf_dir):
    """The tables as a dataset of the record graph; fields with provenance are structs."""
    ds = {}
    for entity, (source, columns) in _GRAPH.items():
        table, _, where = source.partition(" WHERE ")
        rows = read(spark, sf_dir, table)
        ds[entity] = (rows.filter(where) if where else rows).select(*[F.expr(_cast(n, e, "spark")).alias(n) for n, e in columns.items()])
    one = lambda value, label=None: F.struct(F.col(value).alias("value"), (F.lit("EXTRACTED") if label is None else F.col(label)).alias("provenance_label"))
    ds["Site"] = ds["Site"].withColumn("name", one("name"))
    ds["Species"] = ds["Species"].withColumn("scientific_name", one("scientific_name"))
    ds["Variable"] = ds["Variable"].withColumn("name", one("name"))
    ds["Treatment"] = ds["Treatment"].withColumns({"study_id": one("study", "study_label"), "name": one("name"), "control_status": one("control")})
    ds["Management"] = ds["Management"].withColumn("treatment_ids", one("treatments", "treatments_label"))
    ds["Observation"] = ds["Observation"].withColumns({"reported_effect_scope": one("scope"), "aggregated_over_factors": F.when(F.col("told"), one("pooled", "pooled_label"))})
    return ds | {"dataset_id": spark.createDataFrame([("N",)], "root string")}


_VIEWS = ", ".join(f"{e} AS (SELECT {', '.join(f'{_cast(n, x, "duckdb")} AS {n}' for n, x in columns.items())} FROM {source})" for e, (source, columns) in _GRAPH.items())
_SCOPE = "CASE WHEN study IS NOT NULL THEN 'study:' || study ELSE 'citation:' || citation_id END"


def _missing(entity: str, column: str, parent: str) -> str:
    return f"FROM {entity} e WHERE {column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.id = e.{column})"


_ISSUES = [
    *[f"SELECT 'error', 'duplicate_id', '{e}', id FROM {e} GROUP BY id HAVING count(*) > 1" for e in _GRAPH],
    *[f"SELECT 'error', '{code}', '{e}', {f} FROM {e} WHERE {f} <> '' GROUP BY {f} HAVING count(*) > 1" for e, f, code in (("Site", "name", "duplicate_site_name"), ("Species", "scientific_name", "duplicate_scientific_name"), ("Variable", "name", "duplicate_variable_name"))],
    f"SELECT 'error', 'duplicate_treatment_name', 'Treatment', coalesce(name, id) FROM Treatment GROUP BY {_SCOPE}, coalesce(name, id) HAVING count(*) > 1",
    f"SELECT 'error', 'multiple_controls', 'Treatment', string_agg(id, ',' ORDER BY id) FROM Treatment WHERE control GROUP BY {_SCOPE}, site_id HAVING count(*) > 1",
    "SELECT 'error', 'management_without_treatment', 'Management', id FROM Management WHERE treatments_label <> 'UNRESOLVED' AND len(treatments) = 0",
    "SELECT 'error', 'management_treatment_missing', 'Management', id FROM (SELECT id, unnest(treatments) AS ref FROM Management WHERE treatments_label <> 'UNRESOLVED') m WHERE NOT EXISTS (SELECT 1 FROM Treatment t WHERE t.id = m.ref)",
    f"SELECT 'error', 'observation_treatment_missing', 'Observation', id {_missing('Observation', 'treatment_id', 'Treatment')}",
    "SELECT 'error', 'observation_site_mismatch', 'Observation', o.id FROM Observation o JOIN Treatment t ON t.id = o.treatment_id WHERE o.site_id <> t.site_id",
    "SELECT 'error', 'management_spans_scopes', 'Management', m.id FROM (SELECT id, unnest(treatments) AS ref FROM Management) m JOIN Treatment t ON t.id = m.ref GROUP BY m.id HAVING count(DISTINCT coalesce(study, citation_id)) > 1",
    "SELECT 'error', 'dataset_id_mismatch', 'Observation', id FROM Observation WHERE dataset_id <> 'N'",
    "SELECT 'error', 'effect_scope_shape', 'Observation', id FROM Observation WHERE scope = 'treatment_mean' AND (NOT told OR pooled_label <> 'EXTRACTED' OR len(pooled) > 0) OR scope = 'aggregated_mean' AND (NOT told OR pooled_label = 'EXTRACTED' AND len(pooled) = 0)",
    "SELECT 'warning', 'treatment_study_unresolved', 'Treatment', id FROM Treatment WHERE study_label = 'UNRESOLVED'",
    "SELECT 'error', 'treatment_study_missing', 'Treatment', id FROM Treatment t WHERE study_label <> 'UNRESOLVED' AND study IS NOT NULL AND NOT EXISTS (SELECT 1 FROM Study s WHERE s.id = t.study)",
    "SELECT 'error', 'study_citation_missing', 'Study', id FROM (SELECT id, unnest(citation_ids) AS ref FROM Study) s WHERE NOT EXISTS (SELECT 1 FROM Citation c WHERE c.id = s.ref)",
    *[f"SELECT 'error', 'citation_missing', '{e}', id {_missing(e, 'citation_id', 'Citation')}" for e in integrity.CITED],
    *[f"SELECT 'error', '{code}', '{e}', id {_missing(e, c, p)}" for e, c, p, code in (("Crop", "species_id", "Species", "crop_species_missing"), ("Observation", "variable_id", "Variable", "variable_missing"), ("Coverage", "variable_id", "Variable", "variable_missing"), ("Observation", "crop_id", "Crop", "crop_missing"), ("Coverage", "site_id", "Site", "coverage_site_missing"))],
    *[f"SELECT 'error', 'pair_treatment_missing', 'TreatmentPair', id {_missing('TreatmentPair', f'treatment_id_{n}', 'Treatment')}" for n in (1, 2)],
    "SELECT 'error', 'pair_citation_mismatch', 'TreatmentPair', p.id FROM TreatmentPair p JOIN Treatment a ON a.id = p.treatment_id_1 JOIN Treatment b ON b.id = p.treatment_id_2 WHERE a.citation_id <> b.citation_id",
    "SELECT 'warning', 'treatment_name_may_encode_quantity', 'Treatment', id FROM Treatment WHERE name = '20 kg ha'",
]


@query(f"WITH {_VIEWS}, i(severity, code, entity_type, entity_id) AS ({' UNION ALL '.join(_ISSUES)}) SELECT severity, code, entity_type, count(*) AS n, min(entity_id) AS first_id FROM i GROUP BY 1, 2, 3")
def graph_issues(spark, sf_dir):
    """The twenty rules of the record graph over all tables, by code and entity, with the first record found."""
    found = integrity.validate(_dataset(spark, sf_dir))
    return found.groupBy("severity", "code", "entity_type").agg(F.count("*").alias("n"), F.min("entity_id").alias("first_id"))


# ------------------------------------------------------------------ ledgers

_ACTION = "CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'reject' WHEN 'signup' THEN 'edit' WHEN 'view' THEN 'unresolve' ELSE 'flag' END"
_FIELD = "CASE WHEN value < 30 THEN NULL WHEN value < 80 THEN 'segment' ELSE 'name' END"
_RUN = "CASE WHEN value > 150 THEN 'r2' WHEN event_type = 'click' THEN NULL ELSE 'r1' END"
_REVIEW = f"""WITH c AS (SELECT c_nationkey AS paper_id, user_id AS record_id, {_FIELD} AS field_name, {_ACTION} AS action, props AS payload,
      row_number() OVER (PARTITION BY user_id, {_FIELD} ORDER BY event_id DESC) AS r
      FROM events JOIN customer ON c_custkey = user_id WHERE {_RUN} = 'r1' OR {_RUN} IS NULL),
    f AS (SELECT c_nationkey AS paper_id, c_custkey AS record_id, 'name' AS field_name, c_name AS value FROM customer
      UNION ALL SELECT c_nationkey, c_custkey, 'segment', CASE WHEN c_acctbal >= 0 THEN c_mktsegment END FROM customer),
    a AS (SELECT f.*, x.action AS field_action, x.payload, coalesce(x.action, y.action) AS action FROM f
      LEFT JOIN c x ON x.record_id = f.record_id AND x.field_name = f.field_name AND x.r = 1
      LEFT JOIN c y ON y.record_id = f.record_id AND y.field_name IS NULL AND y.r = 1),
    s AS (SELECT paper_id, record_id, field_name, value, CASE WHEN field_action = 'edit' THEN payload WHEN action IN ('reject', 'unresolve') THEN NULL ELSE value END AS effective,
      CASE action WHEN 'edit' THEN 'edited' WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' WHEN 'unresolve' THEN 'unresolved' WHEN 'flag' THEN 'flagged' ELSE 'open' END AS review FROM a)"""  # fmt: skip


def _reviewed(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    keys = [F.col("c_nationkey").alias("paper_id"), F.lit("Customer").alias("entity_type"), F.col("c_custkey").alias("record_id")]
    fields = c.select(*keys, F.lit("name").alias("field_name"), F.col("c_name").alias("value"))
    fields = fields.union(c.select(*keys, F.lit("segment"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))))
    e = read(spark, sf_dir, "events").join(c.select("c_custkey", "c_nationkey"), F.col("user_id") == F.col("c_custkey"))
    done = e.select(*keys, F.expr(_FIELD).alias("field_name"), F.expr(_ACTION).alias("action"), F.col("props").alias("payload"), F.expr(_RUN).alias("run_id"), F.col("event_id").alias("seq"))
    return ledger.review_state(fields, done, "r1")


@query(_REVIEW + " SELECT paper_id, record_id, field_name, value, effective, review FROM s")
def review_state(spark, sf_dir):
    """Each customer's fields with the effect of the last action on the field, else on the record, of one run."""
    return _reviewed(spark, sf_dir).drop("entity_type")


@query(_REVIEW + " SELECT paper_id, count(*) AS fields, count(*) FILTER (review <> 'open') AS reviewed, count(*) FILTER (review = 'unresolved' OR review = 'open' AND value IS NULL) AS unresolved, count(*) FILTER (review = 'open') AS remaining FROM s WHERE field_name <> 'none' GROUP BY paper_id")
def review_summary(spark, sf_dir):
    """Fields, reviewed, unresolved and remaining of each nation's customers."""
    return ledger.review_summary(_reviewed(spark, sf_dir), ["none"])


@query("SELECT event_type AS stage, CASE WHEN value < 10 THEN 'small' WHEN value < 100 THEN 'middle' ELSE 'large' END AS failure_class, count(*) AS n FROM events GROUP BY GROUPING SETS ((1), (2), ())")
def failure_counts(spark, sf_dir):
    """Failures by stage, by class and in all."""
    size = F.expr("CASE WHEN value < 10 THEN 'small' WHEN value < 100 THEN 'middle' ELSE 'large' END")
    return ledger.failure_counts(read(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), size.alias("failure_class")))


_STATUS = "CASE event_type WHEN 'purchase' THEN 'ready' WHEN 'error' THEN 'error' WHEN 'view' THEN 'blocked' ELSE 'unresolved' END"
#: What each band of values is told of a record: (from, to, field, text).
_BANDS = (
    (0, 5, "unresolved_cause", "CONFLICT"), (5, 10, "unresolved_cause", "NOT_RETRIEVED"), (10, 15, "unresolved_cause", "AMBIGUOUS"), (15, 20, "unresolved_cause", "ABSENT"),
    (20, 30, "failure_kind", "provider"), (30, 35, "failure_class", "provider_timeout"), (35, 40, "failure_class", "no_final_answer"),
    (40, 50, "message", "raw evidence grounding failed"), (50, 55, "message", "there was no final answer"), (55, 60, "unresolved_by", "ai_validation"),
    (60, 65, "errors", "it is ambiguous among two"), (65, 70, "errors", "Conflict: they contradict"), (70, 75, "errors", "AI Validator: value withdrawn"), (75, 80, "errors", "provenance_value"),
    (80, 85, "errors", "AI validator says"), (85, 90, "readiness", "it does not give one"), (90, 95, "readiness", "AI validator concern"), (95, 120, "reason", "current-IR limitation L1"),
)


def _told(field: str) -> str:
    cases = " ".join(f"WHEN value >= {lo} AND value < {hi} THEN '{text}'" for lo, hi, f, text in _BANDS if f == field)
    return f"CASE {cases} END"


_FACTS = ("unresolved_cause", "failure_kind", "failure_class", "message", "unresolved_by", "errors", "readiness", "reason")


@query(
    f"""WITH t AS (SELECT event_type AS entity_type, {_STATUS} AS status, {', '.join(f'{_told(f)} AS {f}' for f in _FACTS)} FROM events),
    c AS (SELECT entity_type, CASE WHEN status = 'ready' THEN NULL WHEN unresolved_cause IS NOT NULL THEN unresolved_cause
      WHEN status = 'blocked' THEN CASE WHEN contains(coalesce(reason, ''), 'current-IR limitation') THEN 'SCHEMA_LIMITATION' ELSE 'BLOCKED_PREREQUISITE' END
      WHEN status = 'error' THEN CASE WHEN failure_kind = 'provider' OR starts_with(coalesce(failure_class, ''), 'provider') THEN 'PROVIDER_FAILURE'
        WHEN contains(coalesce(message, ''), 'raw evidence grounding failed') THEN 'GROUNDING_FAILURE'
        WHEN contains(coalesce(message, ''), 'no final answer') OR failure_class = 'no_final_answer' THEN 'NOT_RETRIEVED' ELSE 'VALIDATION_FAILURE' END
      WHEN (unresolved_by = 'ai_validation' OR errors ILIKE 'AI validator%') AND coalesce(errors, '') NOT LIKE '%value withdrawn%' THEN 'AI_CONCERN'
      WHEN contains(coalesce(errors, ''), 'is ambiguous among') THEN 'AMBIGUOUS' WHEN errors ILIKE '%conflict%' AND errors ILIKE '%contradict%' THEN 'CONFLICT'
      WHEN contains(coalesce(errors, ''), 'provenance_') THEN 'GROUNDING_FAILURE' WHEN contains(coalesce(readiness, ''), 'does not give') THEN 'ABSENT'
      WHEN contains(coalesce(readiness, ''), 'AI validator concern') THEN 'AI_CONCERN' ELSE 'NOT_READY' END AS cause FROM t)
    SELECT entity_type, cause, count(*) AS n FROM c WHERE cause IS NOT NULL GROUP BY 1, 2"""
)
def cause_counts(spark, sf_dir):
    """Why records are not ready, by type and cause."""
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("entity_type"), F.expr(_STATUS).alias("status"), *[F.expr(_told(f)).alias(f) for f in _FACTS])
    detail = F.struct("unresolved_cause", "failure_kind", "failure_class", "message", "unresolved_by")
    cause = ledger.cause_of(F.col("status"), detail, F.col("reason"), F.col("errors"), F.col("readiness"))
    return lookups.cause_counts(e.select("entity_type", cause.alias("cause")))


# ------------------------------------------------------------------ construction, reports


@query(
    """WITH d AS (SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_size > 5 THEN p_size END AS lo, CASE WHEN p_type <> 'ECONOMY' THEN 25 END AS hi, CASE WHEN p_brand LIKE '%1' THEN p_name END AS rel FROM part)
    SELECT 'date_interval_and_relative' AS code, id FROM d WHERE (lo IS NOT NULL OR hi IS NOT NULL) AND rel IS NOT NULL
    UNION ALL SELECT 'date_one_end', id FROM d WHERE (lo IS NULL) <> (hi IS NULL) UNION ALL SELECT 'date_reversed', id FROM d WHERE lo > hi"""
)
def date_rules(spark, sf_dir):
    """Parts' sizes as intervals that must have both ends in order, or a relative timing."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("record_id"), F.expr("CASE WHEN p_size > 5 THEN p_size END").alias("earliest"), F.expr("CASE WHEN p_type <> 'ECONOMY' THEN 25 END").alias("latest"), F.expr("CASE WHEN p_brand LIKE '%1' THEN p_name END").alias("relative_timing"))
    return validation.date_construction(p).select("code", F.col("entity_id").alias("id"))


@query(
    """WITH f AS (SELECT conv_id || '/' || turn AS id, CASE role WHEN 'user' THEN 'EXTRACTED' WHEN 'assistant' THEN 'INFERRED' ELSE 'UNRESOLVED' END AS label,
      CASE WHEN turn <> 1 THEN text END AS v, CASE WHEN turn > 2 THEN text END AS reason, turn < 4 AS cited FROM conversations)
    SELECT code, count(*) AS n, min(id) AS first_id FROM (SELECT 'value_missing' AS code, id FROM f WHERE label <> 'UNRESOLVED' AND v IS NULL
      UNION ALL SELECT 'value_with_unresolved', id FROM f WHERE label = 'UNRESOLVED' AND v IS NOT NULL
      UNION ALL SELECT 'unresolved_reason_missing', id FROM f WHERE label = 'UNRESOLVED' AND trim(coalesce(reason, '')) = ''
      UNION ALL SELECT 'inference_basis_missing', id FROM f WHERE label = 'INFERRED' AND trim(coalesce(reason, '')) = ''
      UNION ALL SELECT 'locator_missing', id FROM f WHERE label <> 'UNRESOLVED' AND NOT cited) GROUP BY code"""
)
def field_rules(spark, sf_dir):
    """Turns as fields whose label must fit their value, reason and locators: findings by code."""
    c = read(spark, sf_dir, "conversations")
    label = F.when(F.col("role") == "user", "EXTRACTED").when(F.col("role") == "assistant", "INFERRED").otherwise("UNRESOLVED")
    none = F.array().cast("array<string>")
    fields = c.select(F.lit("Turn").alias("entity_type"), F.col("conv_id").cast("string").alias("record_id"), F.col("turn").cast("string").alias("path"), label.alias("label"), F.when(F.col("turn") != 1, F.col("text")).alias("value"), F.when(F.col("turn") > 2, F.col("text")).alias("reason"), F.when(F.col("turn") < 4, F.array("role")).otherwise(none).alias("locators"))
    return validation.field_construction(fields).groupBy("code").agg(F.count("*").alias("n"), F.min("entity_id").alias("first_id"))


@query("SELECT l_orderkey AS record_id, string_agg(DISTINCT 's:' || l_suppkey, ',' ORDER BY 's:' || l_suppkey) AS anchors FROM lineitem GROUP BY l_orderkey")
def cited_anchors(spark, sf_dir):
    """What each order's lines cite, once each, sorted."""
    cited = F.array(F.concat(F.lit("[s:"), F.col("l_suppkey").cast("string"), F.lit("]")))
    rows = read(spark, sf_dir, "lineitem").select(F.lit("p").alias("paper_id"), F.col("l_orderkey").alias("record_id"), cited.alias("locators"))
    return lookups.cited_anchors(rows).select("record_id", F.array_join("anchors", ",").alias("anchors"))


_KINDS = {"entity": "&[a-z]+;", "digits": "[0-9]{4}", "script": "<script", "link": "<a href"}


@query(
    f"""WITH k AS (SELECT page_id, {', '.join(f"regexp_matches(html, '{p}') AS {n}" for n, p in _KINDS.items())} FROM pages)
    SELECT count(*) AS found, count(*) FILTER (NOT ({' OR '.join(_KINDS)})) AS passed, count(*) FILTER ({' OR '.join(_KINDS)}) AS failed, 0::BIGINT AS missing FROM k"""
)
def quality_totals(spark, sf_dir):
    """Pages found, passed, failed and without input, by the leaks they have."""
    kinds = F.array_compact(F.array(*[F.when(F.col("html").rlike(p), F.lit(n)) for n, p in _KINDS.items()]))
    found = read(spark, sf_dir, "pages").select(F.col("page_id").alias("paper_id"), F.explode_outer(kinds).alias("kind"), F.col("html").isNull().alias("missing"))
    return lookups.quality_totals(lookups.quality_summary(found))


@query("SELECT p_partkey AS record_id, CASE WHEN len(l) > 20 THEN rtrim(l[1:19]) || '…' ELSE l END AS summary FROM (SELECT p_partkey, concat_ws(' · ', p_name, p_brand, p_type) AS l FROM part)")
def record_lines(spark, sf_dir):
    """Parts in a line each, cut at twenty characters."""
    p = read(spark, sf_dir, "part")
    fields = p.select(F.lit("p").alias("paper_id"), F.lit("Part").alias("entity_type"), F.col("p_partkey").alias("record_id"), F.explode(F.create_map(F.lit("type"), "p_type", F.lit("name"), "p_name", F.lit("brand"), "p_brand")).alias("path", "value"))
    return lookups.summaries(fields, {"Part": ["name", "brand", "type"]}, 20).select("record_id", "summary")
