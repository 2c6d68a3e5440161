"""Queries that run search, packets, design and table operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import design, integrity, ledger, packets, pooling, replay, search, tables, validation
from .catalogue import query, read

#: The typed detectors both engines can run: that of units looks ahead.
_SIGNALS = {n: p for n, p in search.SIGNALS.items() if n != "unit"}


@query(f"SELECT doc_id, {', '.join(f"regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') AS {n}" for n, p in _SIGNALS.items())} FROM documents")
def typed_signals(spark, sf_dir):
    """The typed detectors of evidence over whole documents."""
    return search.signal_flags(read(spark, sf_dir, "documents"), "text", _SIGNALS).select("doc_id", *_SIGNALS)


_CONCEPTS = [(f"{e}.{n}", [w.strip() for w in p.split(",")]) for e in ("Site", "Species", "Crop", "Study") for n, p, _, _ in packets.CONCEPTS[e] if p]
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_WORDS = "list_filter(regexp_extract_all({0}, '[a-z0-9]+'), lambda w: w NOT IN (" + _STOP + ") AND (len(w) > 2 OR regexp_matches(w, '[0-9]')))"
_PHRASES = ", ".join(f"('{n}', '{p}')" for n, ps in _CONCEPTS for p in ps)


@query(
    f"""WITH d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM documents), w AS (SELECT doc_id, t, list_distinct({_WORDS.format('t')}) AS own FROM d),
    p AS (SELECT concept, phrase, {_WORDS.format('phrase')} AS words FROM (VALUES {_PHRASES}) v(concept, phrase)),
    h AS (SELECT doc_id, concept, CASE WHEN contains(' ' || t || ' ', ' ' || phrase || ' ') OR len(phrase) > 3 AND contains(t, phrase) THEN 1
      WHEN len(words) > 0 AND list_has_all(own, words) THEN 2 WHEN len(words) >= 2 AND 2 * len(list_intersect(own, words)) >= len(words) THEN 4 END AS tier FROM w, p)
    SELECT doc_id, concept, CAST(min(tier) AS INTEGER) AS tier, count(*) AS phrases FROM h WHERE tier IS NOT NULL GROUP BY doc_id, concept"""
)
def concept_tiers(spark, sf_dir):
    """The best tier of each concept's phrases in each document, and how many phrases are there."""
    rules = spark.createDataFrame(_CONCEPTS, "concept string, phrases array<string>").select("concept", F.transform("phrases", packets._prepared).alias("phrases"))
    literal = lambda p: F.struct(F.lit(p["phrase"]).alias("phrase"), F.lit(p["norm"]).alias("norm"), F.array(*map(F.lit, p["words"])).cast("array<string>").alias("words"))
    concepts = {r["concept"]: F.array(*map(literal, r["phrases"])) for r in rules.collect()}  # a constant of a dozen rows
    text = F.col("text")
    bound = F.array(F.struct(T.canon(text).alias("norm"), F.array_distinct(T.significant_words(text)).alias("words")))  # once, whatever the phrases
    tiers = lambda phrases, b: F.array_compact(F.transform(phrases, lambda p: packets.phrase_tier(p, b["norm"], b["words"])))
    every = F.transform(bound, lambda b: F.array(*[F.struct(F.lit(n).alias("concept"), tiers(ps, b).alias("tiers")) for n, ps in concepts.items()]))
    hits = read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.explode(every[0]).alias("h"))
    return hits.filter("size(h.tiers) > 0").select("doc_id", "h.concept", F.array_min("h.tiers").cast("int").alias("tier"), F.size("h.tiers").cast("long").alias("phrases"))


@query(
    r"""WITH b AS (SELECT conv_id, turn, lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS t FROM conversations),
    f AS (SELECT c.conv_id || '/' || c.turn AS id, lower(trim(regexp_replace(substr(c.text, 1, 40), '\s+', ' ', 'g'))) AS excerpt, p.t AS before, CASE WHEN c.role = 'assistant' THEN o.t END AS own
      FROM conversations c JOIN b o ON o.conv_id = c.conv_id AND o.turn = c.turn LEFT JOIN b p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1)
    SELECT id, CASE WHEN before IS NULL THEN 'anchor_not_found' ELSE 'excerpt_not_found' END AS code FROM f
    WHERE before IS NULL OR excerpt IS NULL OR excerpt = '' OR NOT contains(replace(concat_ws(' ', before, own), ' ', ''), replace(excerpt, ' ', ''))"""
)
def excerpt_rules(spark, sf_dir):
    """Beginnings of turns held against the turn before, an assistant's against both as one text."""
    c = read(spark, sf_dir, "conversations").withColumn("paper_id", F.col("conv_id").cast("string"))
    name = lambda t: F.concat(F.lit("b:"), t.cast("string"))
    blocks = c.select("paper_id", name(F.col("turn")).alias("anchor"), F.col("turn").alias("ord"), F.coalesce("text", F.lit("")).alias("text"))
    before, own = name(F.col("turn") - 1), name(F.col("turn"))
    facts = c.select("paper_id", F.concat_ws("/", "paper_id", F.col("turn").cast("string")).alias("fact_id"), F.when(F.col("role") == "assistant", F.array(own, before)).otherwise(F.array(before)).alias("anchors"), F.substring("text", 1, 40).alias("excerpt"))
    return validation.excerpt_issues(facts, blocks).select(F.col("entity_id").alias("id"), "code")


# ------------------------------------------------------------------ tables and design


@query(
    """WITH e AS (SELECT user_id, event_id, CASE WHEN value < 50 THEN 'low' ELSE 'high' END AS col, CASE WHEN event_type <> 'error' THEN event_type END AS factor FROM events),
    t AS (SELECT user_id FROM e GROUP BY user_id HAVING count(DISTINCT factor) > 1),
    v AS (SELECT user_id, col, list_sort(list(DISTINCT factor) FILTER (factor IS NOT NULL)) AS varies FROM e GROUP BY user_id, col),
    c AS (SELECT e.user_id, event_id, e.col, factor, varies, list_filter(coalesce(varies, []), lambda x: x <> factor) AS pooled FROM e JOIN t ON t.user_id = e.user_id JOIN v ON v.user_id = e.user_id AND v.col = e.col)
    SELECT user_id, event_id, col, CASE WHEN factor IS NULL THEN '' ELSE array_to_string(pooled, ',') END AS pooled_over,
      CASE WHEN factor IS NULL THEN 'unidentified_row' WHEN list_contains(pooled, 'purchase') THEN 'treatment_pooled' END AS limitation FROM c WHERE factor IS NULL OR len(pooled) > 0"""
)
def pooled_cells(spark, sf_dir):
    """Users as tables whose rows, events, each set one factor: what each value is pooled over."""
    e = read(spark, sf_dir, "events").select(F.lit("p").alias("paper_id"), F.col("user_id").alias("table_id"), F.col("event_id").alias("row_group_id"), "event_type", F.when(F.col("value") < 50, "low").otherwise("high").alias("value_column_id"))
    levels = e.select("paper_id", "table_id", "row_group_id", F.col("event_type").alias("factor"), F.when(F.col("event_type") != "error", "level").otherwise("").alias("level"))
    factors = e.select("paper_id", "table_id", F.col("event_type").alias("name"), F.when(F.col("event_type") == "purchase", "treatment").otherwise("time").alias("dimension")).distinct()
    found = design.cell_pooling(e.select("paper_id", "table_id", "row_group_id", "value_column_id", F.lit("1").alias("cell_text")), levels, factors)
    return found.select(F.col("table_id").alias("user_id"), F.col("row_group_id").alias("event_id"), F.col("value_column_id").alias("col"), F.array_join("pooled_over", ",").alias("pooled_over"), "limitation")


@query("SELECT o_custkey, max(n) = 1 AND count(DISTINCT f) > 1 AS marginal FROM (SELECT o_custkey, o_orderdate, count(DISTINCT o_orderpriority) AS n, min(o_orderpriority) AS f FROM orders GROUP BY 1, 2) GROUP BY o_custkey")
def layouts(spark, sf_dir):
    """Whether each customer's days set one priority each while several occur."""
    rows = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").alias("row_id"), F.col("o_orderpriority").alias("factor"))
    return pooling.is_main_effect_layout(rows, ["o_custkey"])


@query("SELECT l_suppkey, CASE WHEN bool_or(l_tax > 0.07 AND l_returnflag = 'N') THEN 'L2' WHEN NOT coalesce(bool_or(l_tax <= 0.07 AND l_returnflag = 'R' AND l_quantity > 49), false) THEN 'L1' END AS limitation FROM lineitem GROUP BY l_suppkey")
def representable(spark, sf_dir):
    """Whether each supplier's pooling can be recorded: not over sites, and with a treatment left."""
    dimension = F.when(F.col("l_returnflag") == "N", "site").when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49), "treatment").otherwise("time")
    return pooling.pooled_representable(read(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_tax") > 0.07).alias("pooled"), dimension.alias("dimension")), ["l_suppkey"])


@query("SELECT l_orderkey, raw, got, CASE WHEN 2 * got < raw THEN 'too_few' ELSE 'ok' END AS verdict FROM (SELECT l_orderkey, count(*) AS raw, count(*) FILTER (l_tax > 0.04) AS got FROM lineitem GROUP BY 1)")
def numeric_checks(spark, sf_dir):
    """Lines of an order that were kept against all of them."""
    li = read(spark, sf_dir, "lineitem")
    count = lambda d: d.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return tables.numeric_check(count(li.filter("l_tax > 0.04")), count(li), ["l_orderkey"]).withColumn("got", F.col("got").cast("long"))


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) > 1 AS withheld FROM part")
def repeated_rows(spark, sf_dir):
    """Parts that repeat an earlier one's brand and name."""
    return tables.withhold_duplicates(read(spark, sf_dir, "part"), ["p_brand"], F.col("p_name"), "p_partkey").select("p_partkey", "withheld")


@query("SELECT p_partkey, CASE WHEN r = 1 THEN p_name ELSE p_name || '_dup' || r END AS p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS r FROM part)")
def numbered_names(spark, sf_dir):
    """Second and later uses of a name within a brand get a suffix."""
    return tables.numbered_ids(read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name"), ["p_brand"], "p_name", "p_partkey").select("p_partkey", "p_name")


@query("SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING bool_and(c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_acctbal > 9000))")
def known_levels(spark, sf_dir):
    """Nations of which every segment is exactly one of the pool's."""
    c = read(spark, sf_dir, "customer")
    return tables.all_levels_known(c.select("c_nationkey", "c_mktsegment"), c.filter("c_acctbal > 9000").select("c_mktsegment").distinct(), ["c_nationkey"], "c_mktsegment", "c_mktsegment")


# ------------------------------------------------------------------ attempts

_OUTCOME = "CASE event_type WHEN 'purchase' THEN 'committed' WHEN 'signup' THEN 'flagged' WHEN 'view' THEN 'not_ready' WHEN 'click' THEN 'suspicious' ELSE 'failed' END"


@query(f"""SELECT user_id, outcome, attempts, CASE outcome WHEN 'committed' THEN 'ready' WHEN 'failed' THEN 'error' ELSE 'unresolved' END AS status
    FROM (SELECT user_id, arg_max({_OUTCOME}, event_id) AS outcome, count(*) AS attempts FROM events GROUP BY user_id)""")
def terminal_states(spark, sf_dir):
    """The last state of each user's attempts."""
    e = read(spark, sf_dir, "events").select(F.lit("p").alias("paper_id"), F.lit("User").alias("entity_type"), F.col("user_id").alias("record_id"), F.col("event_id").alias("seq"), F.expr(_OUTCOME).alias("outcome"))
    return replay.terminal_state(e).select(F.col("record_id").alias("user_id"), "outcome", "attempts", "status")


@query(f"""WITH e AS (SELECT user_id, event_id, {_OUTCOME} AS outcome FROM events), l AS (SELECT user_id, max(event_id) AS last FROM e WHERE outcome IN ('committed', 'flagged') GROUP BY user_id)
    SELECT e.user_id, count(*) FILTER (outcome = 'failed' AND (last IS NULL OR event_id > last)) AS failed, count(*) FILTER (outcome = 'failed' AND (last IS NULL OR event_id > last)) < 2 AS allowed FROM e LEFT JOIN l ON l.user_id = e.user_id GROUP BY e.user_id""")
def proposals(spark, sf_dir):
    """Failures of each user since the last commit or flag, and whether another proposal is allowed."""
    e = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.expr(_OUTCOME).alias("outcome"))
    return integrity.may_propose(e, ["user_id"], 2)


@query("SELECT user_id, event_id, coalesce(event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), false) AS stagnant FROM events")
def stagnation(spark, sf_dir):
    """Attempts that failed just as the one before."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").alias("attempt"), F.array("event_type", "event_type").alias("errors"))
    return ledger.stagnant(e, ["user_id"]).select("user_id", "event_id", "stagnant")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE value < 100) WHERE r = 1 AND event_type = 'purchase'")
def ready_records(spark, sf_dir):
    """What one run's ledger holds: users whose last line in it is ready."""
    log = read(spark, sf_dir, "events").select(F.lit("p").alias("paper_id"), F.lit("User").alias("entity_type"), F.col("user_id").alias("record_id"), F.col("event_id").alias("seq"), F.when(F.col("value") < 100, "r1").otherwise("r2").alias("run_id"), F.when(F.col("event_type") == "purchase", "ready").otherwise("open").alias("status"))
    return ledger.dataset_records(log, "r1").select(F.col("record_id").alias("user_id"), F.col("seq").alias("event_id"))


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'completed_with_errors' ELSE 'success' END AS outcome FROM events GROUP BY user_id")
def run_outcomes(spark, sf_dir):
    """Users as runs: success, or completed with errors."""
    return ledger.run_outcome(read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("status"))).withColumnRenamed("run_id", "user_id")
