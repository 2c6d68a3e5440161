"""Queries of the engine's operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import core, documents, integrity, ledger, links, search, tables
from ..sources import html

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ------------------------------------------------------------------ integrity

_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "pages": "page_id"}


@query(
    "SELECT entity, id, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT '{t}' AS entity, CAST({k} AS VARCHAR) AS id FROM {t}" for t, k in _KEYS.items())
    + " UNION ALL SELECT 'lineitem', l_orderkey || '/' || l_linenumber FROM lineitem) GROUP BY entity, id HAVING count(*) > 1"
)
def dup_ids(spark, sf_dir):
    """Keys that stand more than once, over ten tables."""
    every = [read(spark, sf_dir, t).select(F.lit(t).alias("entity"), F.col(k).cast("string").alias("id")) for t, k in _KEYS.items()]
    every.append(read(spark, sf_dir, "lineitem").select(F.lit("lineitem").alias("entity"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("id")))
    return integrity.duplicates(reduce(DataFrame.unionByName, every), ["entity", "id"])


_DANGLING = """
SELECT 'lineitem' AS entity, 'order_missing' AS code, l_orderkey AS ref, count(*) AS n FROM lineitem
 WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') GROUP BY l_orderkey
UNION ALL SELECT 'lineitem', 'part_missing', l_partkey, count(*) FROM lineitem
 WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 40) GROUP BY l_partkey
UNION ALL SELECT 'orders', 'customer_missing', o_custkey, count(*) FROM orders
 WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment <> 'BUILDING') GROUP BY o_custkey"""


@query(_DANGLING)
def dangling_refs(spark, sf_dir):
    """References without a parent, against restricted parents."""
    li, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    found = [
        ("lineitem", "order_missing", "l_orderkey", integrity.dangling(li.select("l_orderkey"), "l_orderkey", orders.filter("o_orderstatus = 'F'"), "o_orderkey")),
        ("lineitem", "part_missing", "l_partkey", integrity.dangling(li.select("l_partkey"), "l_partkey", read(spark, sf_dir, "part").filter("p_size <= 40"), "p_partkey")),
        ("orders", "customer_missing", "o_custkey", integrity.dangling(orders.select("o_custkey"), "o_custkey", read(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'"), "c_custkey")),
    ]
    return reduce(DataFrame.unionByName, [d.groupBy(F.col(k).alias("ref")).agg(F.count("*").alias("n")).select(F.lit(e).alias("entity"), F.lit(c).alias("code"), "ref", "n") for e, c, k, d in found])


@query("SELECT d.doc_id, d.lang, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def optional_ref(spark, sf_dir):
    """Documents without a label."""
    return integrity.dangling(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id", read(spark, sf_dir, "labels"), "doc_id")


@query("SELECT scope, p_name, count(*) AS n FROM (SELECT CASE WHEN p_size > 25 THEN 'brand:' || p_brand ELSE 'type:' || p_type END AS scope, p_name FROM part) GROUP BY scope, p_name HAVING count(*) > 1")
def scope_name_unique(spark, sf_dir):
    """Names that repeat within their scope: the brand of large parts, the type of others."""
    scope = F.when(F.col("p_size") > 25, F.concat(F.lit("brand:"), "p_brand")).otherwise(F.concat(F.lit("type:"), "p_type"))
    return integrity.duplicates(read(spark, sf_dir, "part").select(scope.alias("scope"), "p_name"), ["scope", "p_name"])


@query("SELECT o_custkey, year(o_orderdate) AS y, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ids FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2 HAVING count(*) > 1")
def single_control(spark, sf_dir):
    """Customers with more than one finished order in a year, with the orders in order."""
    f = read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("y")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("ids"))
    return f.filter(F.size("ids") > 1).withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@query(
    """SELECT l_orderkey, l_linenumber, s_nationkey, c_nationkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
    JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE s_nationkey <> c_nationkey"""
)
def denorm_consistency(spark, sf_dir):
    """Lines whose supplier's nation differs from the customer's."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    o = o.join(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    li = li.join(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return li.filter("s_nationkey <> c_nationkey").select("l_orderkey", "l_linenumber", "s_nationkey", "c_nationkey")


@query(
    """SELECT l_orderkey, count(DISTINCT n_regionkey) AS scopes FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
    JOIN nation ON n_nationkey = s_nationkey GROUP BY l_orderkey HAVING count(DISTINCT n_regionkey) > 1"""
)
def spans_scopes(spark, sf_dir):
    """Orders supplied from more than one region."""
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return integrity.spanning(li, ["l_orderkey"], "n_regionkey")


@query(
    """SELECT event_id, CASE WHEN k IS NULL THEN 'k_missing' WHEN event_type = 'purchase' AND value <= 1 THEN 'value_small'
    WHEN event_type IN ('view', 'click') AND k % 2 = 1 THEN 'k_odd' END AS code
    FROM (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
    WHERE k IS NULL OR (event_type = 'purchase' AND value <= 1) OR (event_type IN ('view', 'click') AND k % 2 = 1)"""
)
def shape_rule(spark, sf_dir):
    """Rules on the fields of a JSON payload: required, required by type, any of a group."""
    e = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("bigint"))
    code = F.when(F.col("k").isNull(), F.lit("k_missing")).when((F.col("event_type") == "purchase") & (F.col("value") <= 1), F.lit("value_small")).when(F.col("event_type").isin("view", "click") & (F.col("k") % 2 == 1), F.lit("k_odd"))
    return e.select("event_id", code.alias("code")).filter("code is not null")


_RULES = (("error", "order_missing"), ("error", "part_missing"), ("error", "customer_missing"), ("warning", "name_repeats"), ("error", "key_repeats"))


@query(
    f"""WITH found AS (SELECT code, n FROM ({_DANGLING}) UNION ALL
      SELECT 'name_repeats', count(*) FROM part GROUP BY p_name HAVING count(*) > 1 UNION ALL
      SELECT 'key_repeats', count(*) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    SELECT r.severity, r.code, count(f.code) AS n FROM (VALUES {", ".join(map(str, _RULES))}) r(severity, code) LEFT JOIN found f ON f.code = r.code GROUP BY r.severity, r.code"""
)
def issue_rollup(spark, sf_dir):
    """Every rule with its number of findings, rules without any included."""
    found = dangling_refs(spark, sf_dir).select("code")
    found = found.unionByName(integrity.duplicates(read(spark, sf_dir, "part"), ["p_name"]).select(F.lit("name_repeats").alias("code")))
    found = found.unionByName(integrity.duplicates(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).select(F.lit("key_repeats").alias("code")))
    return integrity.rollup_issues(found, spark.createDataFrame(_RULES, "severity string, code string"))


# ------------------------------------------------------------------ ledgers


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_wins(spark, sf_dir):
    """The last event of each user."""
    e = read(spark, sf_dir, "events")
    return core.latest_wins(e, ["user_id"], F.struct("ts", "event_id"), ["event_id", "event_type", "value"])


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_id % 3 <> 0) WHERE r = 1")
def latest_by_field(spark, sf_dir):
    """The last event of each user and type; the whole log is one run."""
    e = read(spark, sf_dir, "events")
    return core.latest_wins(e, ["user_id", "event_type"], F.struct("ts", "event_id"), ["event_id", "value"])


@query(
    """SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'refund' THEN 'rejected' WHEN 'signup' THEN 'new' ELSE 'open' END AS state,
    CASE WHEN event_type = 'refund' THEN NULL ELSE value END AS effective
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"""
)
def effective_state(spark, sf_dir):
    """Each user's state and value by the last action."""
    state = F.when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "refund", "rejected").when(F.col("event_type") == "signup", "new").otherwise("open")
    return latest_wins(spark, sf_dir).select("user_id", "event_id", state.alias("state"), F.when(F.col("event_type") != "refund", F.col("value")).alias("effective"))


@query(
    """SELECT s.seg AS segment, b.bucket, count(o.o_orderkey) AS n FROM (SELECT DISTINCT c_mktsegment AS seg FROM customer) s
    CROSS JOIN (VALUES ('F'), ('O'), ('P'), ('X')) b(bucket) LEFT JOIN customer c ON c.c_mktsegment = s.seg
    LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = b.bucket GROUP BY 1, 2"""
)
def status_buckets(spark, sf_dir):
    """Orders by segment and status, with every status present."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    rows = c.join(read(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return ledger.buckets(rows, "segment", "o_orderstatus", ["F", "O", "P", "X"])


@query(
    """SELECT conv_id, coalesce(max(turn) FILTER (role = 'assistant'), max(turn)) AS turn, bool_or(role = 'assistant') AS preferred FROM conversations GROUP BY conv_id"""
)
def preferred_run(spark, sf_dir):
    """The last assistant turn of each conversation, else its last turn."""
    return ledger.preferred(read(spark, sf_dir, "conversations"), ["conv_id"], F.col("role") == "assistant", "turn")


@query(
    """SELECT cause, event_type, count(*) AS n FROM (SELECT event_type, CASE WHEN event_type = 'purchase' THEN NULL
    WHEN value < 5 AND event_type = 'error' THEN 'PROVIDER_FAILURE' WHEN value < 10 THEN 'NOT_RETRIEVED'
    WHEN value > 100 THEN 'AMBIGUOUS' ELSE 'NOT_READY' END AS cause FROM events) GROUP BY 1, 2"""
)
def cause_classify(spark, sf_dir):
    """Causes by ordered rules: the first that fits decides, none for what is ready."""
    rules = [
        (F.col("event_type") == "purchase", None),
        ((F.col("value") < 5) & (F.col("event_type") == "error"), "PROVIDER_FAILURE"),
        (F.col("value") < 10, "NOT_RETRIEVED"),
        (F.col("value") > 100, "AMBIGUOUS"),
    ]
    e = read(spark, sf_dir, "events")
    return e.select(ledger.first_rule(rules, "NOT_READY").alias("cause"), "event_type").groupBy("cause", "event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, user_id % 7 AS bucket, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 7), ())")
def group_sets(spark, sf_dir):
    """One log counted by type, by bucket and in all."""
    e = read(spark, sf_dir, "events").withColumn("bucket", F.col("user_id") % 7)
    return e.groupingSets([[F.col("event_type")], [F.col("bucket")], []], "event_type", "bucket").agg(F.count("*").alias("n")).select("event_type", "bucket", "n")


_EDGES = ", ".join(f"('{a}', '{b}')" for a, b in ledger.DEPENDENCIES)


@query(
    f"""WITH RECURSIVE e(entity, needs) AS (VALUES {_EDGES}), n AS (SELECT DISTINCT entity AS x FROM e UNION SELECT needs FROM e),
    p AS (SELECT x, 0 AS layer FROM n WHERE x NOT IN (SELECT entity FROM e) UNION SELECT e.entity, p.layer + 1 FROM p JOIN e ON e.needs = p.x)
    SELECT x AS entity, CAST(max(layer) AS INTEGER) AS layer FROM p GROUP BY x"""
)
def topo_layers(spark, sf_dir):
    """Layers of the entity types' dependencies."""
    return spark.createDataFrame([(e, n) for n, layer in enumerate(ledger.layers(ledger.DEPENDENCIES)) for e in layer], "entity string, layer int")


# ------------------------------------------------------------------ documents


@query("SELECT doc_id, CAST(i - 1 AS INTEGER) AS ord, lines[i] AS block FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), unnest(generate_series(1, len(lines))) AS g(i)")
def block_split(spark, sf_dir):
    """Documents as blocks in order, one for each line."""
    return documents.line_blocks(read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "ord", "block")


@query(
    r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t]+', ' ', 'g'), E' \n\t\r') AS text FROM pages"""
)
def html_to_text(spark, sf_dir):
    """Pages as text: tags to blanks, entities last, blanks collapsed."""
    return read(spark, sf_dir, "pages").select("page_id", html.html_to_text(F.col("html")).alias("text"))


@query(
    r"""SELECT name, sum(len(regexp_extract_all(html, pattern)))::BIGINT AS hits, count(*) FILTER (len(regexp_extract_all(html, pattern)) > 0) AS pages FROM pages,
    (VALUES ('escaped_tag', '&lt;/?[a-zA-Z][a-zA-Z0-9]*&gt;'), ('raw_tag', '<[a-zA-Z/][a-zA-Z0-9]*>'), ('content_ref', '<content-ref'), ('entity', '&amp;'))
    p(name, pattern) GROUP BY name"""
)
def tag_leak(spark, sf_dir):
    """Leaks of markup by pattern: hits and pages."""
    patterns = {"escaped_tag": "&lt;/?[a-zA-Z][a-zA-Z0-9]*&gt;", "raw_tag": "<[a-zA-Z/][a-zA-Z0-9]*>", "content_ref": "<content-ref", "entity": "&amp;"}
    return documents.leak_sweep(read(spark, sf_dir, "pages"), "html", patterns).select("name", "hits", F.col("rows").alias("pages"))


@query(
    r"""WITH tags AS (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages)
    SELECT tag, count(*) AS n FROM tags WHERE tag NOT IN ('html', 'head', 'body', 'title', 'meta', 'p', 'div') GROUP BY tag"""
)
def tag_coverage(spark, sf_dir):
    """Tags that no policy covers, with their number."""
    found = read(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    policy = spark.createDataFrame([(t,) for t in ("html", "head", "body", "title", "meta", "p", "div")], "tag string")
    return documents.uncovered(found, "tag", policy)


@query(
    """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'only_text' WHEN d.doc_id IS NULL THEN 'only_label' ELSE 'both' END AS state
    FROM (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) d FULL JOIN (SELECT doc_id FROM labels) l ON l.doc_id = d.doc_id"""
)
def round_trip(spark, sf_dir):
    """Two sides compared by key."""
    left = read(spark, sf_dir, "documents").select("doc_id")
    return documents.round_trip(left, read(spark, sf_dir, "labels").select("doc_id"), "doc_id", ("only_text", "only_label", "both"))


@query("SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS user_turn FROM conversations")
def carry_forward(spark, sf_dir):
    """The user turn in force at each turn."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return core.carry_forward(c, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn")), "user_turn")


@query("SELECT conv_id, turn, array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), '>') AS around FROM conversations")
def neighbours(spark, sf_dir):
    """The roles around each turn, clamped at the ends."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return core.neighbours(c, ["conv_id"], ["turn"], 1, 1, "role", "a").select("conv_id", "turn", F.array_join("a", ">").alias("around"))


@query("SELECT c.conv_id, c.turn, max(u.turn) AS user_turn FROM conversations c LEFT JOIN conversations u ON u.conv_id = c.conv_id AND u.role = 'user' AND u.turn < c.turn AND u.turn >= c.turn - 8 GROUP BY 1, 2")
def lookback_label(spark, sf_dir):
    """The nearest earlier user turn within eight turns."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    w = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(-8, -1)
    return c.select("conv_id", "turn", F.max(F.when(F.col("role") == "user", F.col("turn"))).over(w).alias("user_turn"))


_CONTINUES = "event_type = lag(event_type) OVER w AND epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 86400000000"


def _chained(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    return e.withColumn("continues", F.coalesce((F.col("event_type") == F.lag("event_type").over(w)) & (gap <= 86_400_000_000), F.lit(False)))


@query(f"SELECT user_id, event_id, coalesce({_CONTINUES}, false) AS continues FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def continuation(spark, sf_dir):
    """Whether an event continues the user's event before it: same type, a day at most between."""
    return _chained(spark, sf_dir).select("user_id", "event_id", "continues")


@query(
    f"""SELECT user_id, run, count(*) AS n, min(event_id) AS first_id FROM (SELECT *, sum(CASE WHEN continues THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run
    FROM (SELECT *, coalesce({_CONTINUES}, false) AS continues FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY 1, 2"""
)
def chain_runs(spark, sf_dir):
    """Runs of continuing events."""
    runs = core.chain_runs(_chained(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("continues"), "run")
    return runs.groupBy("user_id", "run").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


_REFS = (("a", "Table", 2, 4), ("b", "Table", 7, 7), ("c", "Figure", 1, 9), ("d", "Figure", 3, 20))


@query(f"SELECT anchor, kind || ' ' || CAST(i AS VARCHAR) AS target FROM (VALUES {', '.join(map(str, _REFS))}) r(anchor, kind, lo, hi), unnest(CASE WHEN hi - lo < 10 THEN generate_series(lo, hi) ELSE [lo, hi] END) g(i)")
def ordinal_expand(spark, sf_dir):
    """Ranges of labels written out, both ends only where they span ten or more."""
    text = lambda k, lo, hi: f"see {k}s {lo}–{hi} there" if hi > lo else f"see {k} {lo}"
    rows = spark.createDataFrame([(a, text(k, lo, hi)) for a, k, lo, hi in _REFS], "anchor string, text string")
    return documents.cross_references(rows, "text").select("anchor", "target")


@query(
    r"""SELECT doc_id, CASE WHEN nth = 1 THEN h ELSE h || '_dup' || CAST(nth AS VARCHAR) END AS label FROM
    (SELECT doc_id, h, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS nth FROM (SELECT doc_id, substr(sha256(trim(regexp_replace(text, '[ \n\t]+', ' ', 'g'))), 1, 16) AS h FROM documents))"""
)
def first_seen(spark, sf_dir):
    """Documents named by their text; second and later copies get a suffix."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2(F.trim(F.regexp_replace("text", r"[ \n\t]+", " ")), 256), 1, 16).alias("h"))
    d = core.first_seen(d, ["h"], ["doc_id"])
    return d.select("doc_id", F.when(F.col("nth") == 1, F.col("h")).otherwise(F.concat("h", F.lit("_dup"), F.col("nth").cast("string"))).alias("label"))


# ------------------------------------------------------------------ keys and grounding


@query(
    r"""SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS words, regexp_replace(lower(p_type), '[^a-z0-9]+', '', 'g') AS joined,
    trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part"""
)
def canon_key(spark, sf_dir):
    """Comparison keys of part names, types and brands."""
    return read(spark, sf_dir, "part").select("p_partkey", T.words_key(F.col("p_name")).alias("words"), T.joined_key(F.col("p_type")).alias("joined"), T.slug(F.col("p_brand")).alias("slug"))


@query(
    r"""SELECT b.item_id, count(d.doc_id) AS n, min(d.doc_id) AS first_doc FROM benchmark b LEFT JOIN documents d
    ON contains(trim(regexp_replace(lower(d.text), '\s+', ' ', 'g')), trim(regexp_replace(lower(b.text), '\s+', ' ', 'g'))) GROUP BY b.item_id"""
)
def grounding(spark, sf_dir):
    """Benchmark passages that documents hold, after normalisation."""
    return search.grounded(read(spark, sf_dir, "benchmark"), "item_id", "text", read(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    """WITH ids AS (SELECT DISTINCT p_brand AS id FROM part UNION SELECT DISTINCT c_name FROM customer)
    SELECT a.id AS id_a, b.id AS id_b FROM ids a JOIN ids b ON a.id < b.id AND levenshtein(a.id, b.id) <= 1"""
)
def near_dup_ids(spark, sf_dir):
    """Identifiers one edit apart, found by their one-letter deletions."""
    brands = read(spark, sf_dir, "part").select(F.col("p_brand").alias("id"))
    names = read(spark, sf_dir, "customer").select(F.col("c_name").alias("id"))
    return links.one_edit_apart(brands.union(names), "id")


@query(
    r"""SELECT doc_id, regexp_matches(text, '[0-9]') AS digit, regexp_matches(text, '[0-9]{3}-[0-9]{4}') AS phone, regexp_matches(text, '[|].*[|]') AS pipes,
    regexp_matches(text, '[A-Z][a-z]+ [A-Z][a-z]+') AS capitals FROM documents"""
)
def signal_hits(spark, sf_dir):
    """Typed signals of each document, in one pass over its text."""
    signals = {"digit": "[0-9]", "phone": "[0-9]{3}-[0-9]{4}", "pipes": "[|].*[|]", "capitals": "[A-Z][a-z]+ [A-Z][a-z]+"}
    return search.signal_flags(read(spark, sf_dir, "documents"), "text", signals).select("doc_id", *signals)


_PHRASES = (("q1", "the of and"), ("q2", "der die"), ("q3", "mit license"), ("q4", "idiot clown"))


@query(
    f"""WITH q(qid, phrase) AS (VALUES {", ".join(map(str, _PHRASES))}), hits AS (SELECT qid, doc_id, CASE WHEN contains(lower(text), phrase) THEN 1
      WHEN list_has_all(w, string_split(phrase, ' ')) THEN 2 WHEN 2 * len(list_intersect(w, string_split(phrase, ' '))) >= len(string_split(phrase, ' ')) THEN 4 END AS tier
      FROM (SELECT doc_id, text, list_distinct(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS w FROM documents), q)
    SELECT qid, doc_id, CAST(tier AS INTEGER) AS tier, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY tier, doc_id) AS place FROM hits WHERE tier IS NOT NULL) WHERE place <= 5"""
)
def tier_search(spark, sf_dir):
    """The five best documents of each phrase by tier: phrase, all words, half the words."""
    return search.tier_search(read(spark, sf_dir, "documents"), "doc_id", "text", dict(_PHRASES), 5)


@query(
    r"""WITH w AS (SELECT DISTINCT lang, doc_id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS word FROM documents),
    n AS (SELECT lang, count(*) AS docs FROM documents GROUP BY lang)
    SELECT w.lang, word, count(*) AS df FROM w JOIN n ON n.lang = w.lang WHERE word <> '' GROUP BY w.lang, word, docs HAVING 10 * count(*) > docs"""
)
def common_words(spark, sf_dir):
    """Words in more than a tenth of a language's documents."""
    return search.common_words(read(spark, sf_dir, "documents"), "lang", "text", 0.1)


@query(
    """WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
    f(source, i, used, taken, doc_id) AS (SELECT source, 0::BIGINT, 0::BIGINT, false, NULL::BIGINT FROM (SELECT DISTINCT source FROM documents)
      UNION ALL SELECT o.source, o.i, CASE WHEN f.used + o.n_chars <= 7000 THEN f.used + o.n_chars ELSE f.used END, f.used + o.n_chars <= 7000, o.doc_id FROM f JOIN o ON o.source = f.source AND o.i = f.i + 1)
    SELECT f.source, f.doc_id, o.n_chars FROM f JOIN o ON o.source = f.source AND o.i = f.i WHERE taken"""
)
def budget_packet(spark, sf_dir):
    """Documents of each source taken in order under 7000 characters; one that does not fit is skipped."""
    return core.budget_fold(read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], "n_chars", 7000)


@query("SELECT source, doc_id, used FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM documents) WHERE used <= 7000")
def prefix_budget(spark, sf_dir):
    """The same, ended by the first that does not fit."""
    return core.budget_fold(read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], "n_chars", 7000, "stop").select("source", "doc_id", "used")


# ------------------------------------------------------------------ tables


@query(
    """SELECT l_orderkey, l_linenumber, measure, max(value) AS value FROM (SELECT l_orderkey, l_linenumber, unnest(['quantity', 'price', 'discount', 'tax']) AS measure,
    unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem) GROUP BY 1, 2, 3"""
)
def wide_to_long(spark, sf_dir):
    """Value columns as rows."""
    li = read(spark, sf_dir, "lineitem")
    long = tables.unpivot(li, ["l_orderkey", "l_linenumber"], {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}, "measure", "value")
    return long.groupBy("l_orderkey", "l_linenumber", "measure").agg(F.max("value").alias("value"))


@query("SELECT l_returnflag, l_linestatus, year(l_shipdate) AS y, min(l_orderkey) AS first_order, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def distinct_combos(spark, sf_dir):
    """Distinct combinations of levels with their first occurrence."""
    li = read(spark, sf_dir, "lineitem").withColumn("y", F.year("l_shipdate").cast("long"))
    return tables.combinations(li, ["l_returnflag", "l_linestatus", "y"], "l_orderkey", "first_order")


@query(
    r"""WITH pool AS (SELECT DISTINCT p_type AS t, string_split(trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')), ' ') AS tw FROM part),
    names AS (SELECT DISTINCT p_name AS name, list_distinct(string_split(trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')), ' ')) AS w FROM part),
    s AS (SELECT name, t, len(list_intersect(w, tw)) AS score FROM (SELECT name, list_distinct(flatten(list(w))) AS w FROM names GROUP BY name), pool),
    b AS (SELECT name, max(score) AS best FROM s GROUP BY name)
    SELECT b.name, CASE WHEN best > 0 AND count(*) = 1 THEN min(t) END AS match FROM b JOIN s ON s.name = b.name AND s.score = b.best GROUP BY b.name, best"""
)
def pool_match(spark, sf_dir):
    """The pool entry that shares most words with each name, where it is the only best."""
    part = read(spark, sf_dir, "part")
    names = part.select(F.col("p_name").alias("name"), F.explode(F.split(T.words_key(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("word")).distinct()
    pool = part.select(F.col("p_type").alias("t"), F.explode(F.split(T.words_key(F.col("p_type")), " ")).alias("word")).distinct()
    return links.best_in_pool(names, "name", pool, "t", "word", "match")


@query("SELECT c_mktsegment AS segment, bool_and(c_acctbal > -990) AS all_match, count(*) FILTER (c_acctbal > 0) AS n FROM customer GROUP BY 1")
def all_levels_match(spark, sf_dir):
    """Whether every customer of a segment satisfies a rule."""
    return read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.bool_and(F.col("c_acctbal") > -990).alias("all_match"), F.count_if(F.col("c_acctbal") > 0).alias("n"))


@query(
    """SELECT l_suppkey, count(*) FILTER (l_quantity = round(l_quantity) AND l_discount <= 0.05) AS agree, count(*) AS n,
    4 * count(*) FILTER (l_quantity = round(l_quantity) AND l_discount <= 0.05) >= 3 * count(*) AS trusted FROM lineitem GROUP BY l_suppkey"""
)
def placement_ratio(spark, sf_dir):
    """Agreement of each supplier's lines, trusted from three quarters on."""
    agree = (F.col("l_quantity") == F.round("l_quantity")) & (F.col("l_discount") <= 0.05)
    return tables.agreement(read(spark, sf_dir, "lineitem"), ["l_suppkey"], agree, 3, 4)


@query(
    """SELECT l_returnflag, l_linestatus, concat_ws(',', CASE WHEN grouping(l_returnflag) = 1 THEN 'l_returnflag' END, CASE WHEN grouping(l_linestatus) = 1 THEN 'l_linestatus' END) AS pooled,
    count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"""
)
def pooled_marginals(spark, sf_dir):
    """All marginal groups with the factors they are pooled over."""
    return tables.marginals(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@query(
    """WITH r AS (SELECT p_brand, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY p_brand)
    SELECT a.p_brand AS brand_a, b.p_brand AS brand_b FROM r a JOIN r b ON a.p_brand < b.p_brand AND ((a.lo = b.lo AND a.hi <> b.hi) OR (a.hi = b.hi AND a.lo <> b.lo))"""
)
def range_conflict(spark, sf_dir):
    """Brands whose size ranges share exactly one bound."""
    r = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
    return tables.range_conflicts(r, "p_brand", "brand")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 200000 AND o_orderpriority LIKE '1%')")
def outcome_exists(spark, sf_dir):
    """Customers with an order that satisfies all conditions at once."""
    o = read(spark, sf_dir, "orders").filter("o_orderstatus = 'F' and o_totalprice > 200000 and o_orderpriority like '1%'")
    return read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_semi")


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(CAST(embedding[i] AS DOUBLE) / 612, 9) AS x FROM embeddings, unnest(generate_series(1, len(embedding))) g(i)")
def polygon_norm(spark, sf_dir):
    """The coordinates of each vector over a page's width."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(documents.scaled(F.col("embedding"), 612)).alias("i", "x"))
    return e.select("vec_id", "i", F.round("x", 9).alias("x"))


from . import evidence, graph  # noqa: E402, F401  (their queries register themselves)
