"""Pooling statements and experimental design: what a table's values are averaged over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Words for reported values, for aggregating, of statistical procedures; what a factor's name leaves out,
#: what says nothing by itself, what makes a phrase a clause; dimensions by a name's last word.
VALUE_WORDS = "mean means average averages data value values results estimates percentages proportions totals measurements".split()
AGGREGATING = "averaged pooled combined collapsed aggregated summed".split()
PROCEDURES = "anova anovas tukey kramer duncan lsd hsd scheffe bonferroni post-hoc posthoc separation separations comparison comparisons pairwise regression contrast contrasts".split()
DETERMINERS = "the all each both any every three two four five six seven eight nine ten of a an".split()
GENERIC_HEADS = "treatment treatments level levels combination combinations group groups condition conditions value values data result results".split()
CLAUSE_WORDS = "were was is are be been being by in on at from with than that which presented performed used shown observed conducted during within between for per to after before".split()
PHRASE_ENDS = "since because as which where while with when thus so but hence".split()
DIMENSIONS = {
    "site": "location site environment locality region".split(),
    "time": "year season date stage maturity harvest month week day sampling time".split(),
    "crop": "cultivar variety population genotype hybrid accession line species".split(),
    "replicate": "block replicate replication plot rep repetition".split(),
}


def _any(words: list[str]) -> str:
    return rf"\b(?:{'|'.join(words)})\b"


#: Frames that state pooling, in order: name, what stands before the factors; the first that a sentence has decides.
FRAMES = (
    ("aggregation_verb_across", rf"(?i){_any(AGGREGATING)}(?:\s+\w+){{0,2}}?\s+{_any(['across', 'over', 'among', 'amongst'])}\s+"),
    ("mean_across", rf"(?i){_any(VALUE_WORDS[:4])}[^.;a-z]{{0,6}}(?:{_any(['se', 'sd', 's.e', 's.d', 'standard error', 'standard deviation'])}[.]?)?\s+{_any(['across', 'among', 'amongst'])}\s+"),
    ("value_for_all", rf"(?i){_any(VALUE_WORDS)}[^.;]{{0,60}}?\bfor all\s+"),
    ("regardless_of", rf"(?i){_any(VALUE_WORDS)}[^.;]{{0,80}}?{_any(['regardless', 'irrespective'])} of\s+"),
)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_replace(text, r"\s+", " "), r"(?<=[a-z)\]*])[.;!?]\s+(?=[*A-Z$])"), lambda s: F.trim(s)), lambda s: s != "")


def pooling_statements(blocks: DataFrame, text: str, own_caption: Column | None = None) -> DataFrame:
    """Each pooled factor that a block states: frame, name, dimension, status (accepted or rejected) and the reason.

    A sentence on a statistical procedure states none; an aggregating verb needs a word for reported values before it,
    unless the block is the table's own caption. The factors are what follows the frame up to a sign or a word that
    starts a clause. If any of them is a clause, holds digits or markup, is generic or longer than four words, or if
    there are more than three, the statement is rejected as a whole. Replicates are no factor.
    """
    own = F.lit(False) if own_caption is None else own_caption
    rows = blocks.withColumn("sentence", F.explode(sentences(F.col(text))))
    frame = F.lit(None).cast("struct<frame:string,before:string,phrase:string>")
    for name, pattern in reversed(FRAMES):
        parts = F.split("sentence", pattern, 2)
        frame = F.when(F.col("sentence").rlike(pattern), F.struct(F.lit(name).alias("frame"), parts[0].alias("before"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("phrase"))).otherwise(frame)
    rows = rows.withColumn("f", frame).filter("f is not null")
    phrase = F.split("f.phrase", rf"(?i)\s*(?:[,;(]|\.(?:\s|$)|{_any(PHRASE_ENDS)})")[0]
    told = F.transform(F.split(phrase, r"(?i)\s*(?:\band\b|&|\bor\b)\s*"), lambda p: F.filter(F.transform(F.split(p, r"\s+"), lambda w: F.regexp_replace(w, r"^[*_.\]]+|[*_.\]]+$", "")), lambda w: (w != "") & ~F.lower(w).isin(DETERMINERS)))
    is_generic = lambda w: F.lower(w).isin(GENERIC_HEADS)
    # generic words go from the end, down to one
    kept = F.transform(told, lambda ws: F.reverse(F.aggregate(F.reverse(ws), F.array().cast("array<string>"), lambda acc, w: F.when((F.size(acc) == 0) & is_generic(w), acc).otherwise(F.array_append(acc, w)))))
    rows = rows.withColumn("_told", told).withColumn("_kept", kept)
    has = lambda test: F.exists("_told", lambda ws: F.exists(ws, test))
    reason = (
        F.when(F.col("sentence").rlike(rf"(?i){_any(PROCEDURES)}|{_any(VALUE_WORDS)}\s+(?:tests?|procedures?|squares?)\b"), "statistical_procedure")
        .when((F.col("f.frame") == "aggregation_verb_across") & ~own & ~F.col("f.before").rlike(rf"(?i){_any(VALUE_WORDS)}"), "no_reported_value")
        .when(has(lambda w: F.lower(w).isin(CLAUSE_WORDS)), "clause")
        .when(has(lambda w: w.rlike(r"[0-9$\\_]")), "digits_or_markup")
        .when(F.exists("_kept", lambda ws: F.size(ws) == 0), "generic")
        .when(F.exists("_kept", lambda ws: F.size(ws) > 4), "too_long")
        .when(F.size("_kept") > 3, "too_many")
    )
    rows = rows.withColumn("_reason", reason).withColumn("_phrase", phrase)
    rows = rows.withColumn("_name", F.explode(F.when(F.col("_reason").isNull(), F.transform("_kept", lambda ws: F.array_join(ws, " "))).otherwise(F.array(F.lit(None).cast("string")))))
    name = T.name_key(F.col("_name"))
    last = F.element_at(F.split(name, " "), -1)
    dimension = F.when(F.regexp_like("_phrase", F.concat(F.lit(r"(?i)\b"), F.element_at(F.split(F.regexp_replace("_name", r"[^\w ]", "."), " "), -1), F.lit(r"\s+treatments?\b"))), "treatment")
    dimension = dimension.when(F.arrays_overlap(F.split(name, " "), F.array(F.lit("mixture"), F.lit("blend"))), "other")
    for kind, words in DIMENSIONS.items():
        dimension = dimension.when(last.isin(words), kind)
    dimension = F.when(F.col("_name").isNotNull(), dimension.otherwise("other"))
    why = F.coalesce("_reason", F.when(dimension == "replicate", "replicate"))
    status = F.when(why.isNull(), "accepted").otherwise("rejected")
    return rows.select(*blocks.columns, F.col("f.frame").alias("frame"), name.alias("name"), dimension.alias("dimension"), status.alias("status"), why.alias("reason"))


def windows(blocks: DataFrame, reach: int = 3) -> DataFrame:
    """For each table, its caption just before and up to ``reach`` notes behind it, until something else comes."""
    w = Window.partitionBy("paper_id").orderBy("ord")
    solid = blocks.filter("block_type not in ('PageHeader', 'PageFooter')")
    solid = solid.withColumn("_table", F.last(F.when(F.col("block_type") == "Table", F.struct("anchor", "ord")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_next", F.lead(F.struct("block_type", "anchor")).over(w)).withColumn("_n", F.row_number().over(w))
    solid = solid.withColumn("_tn", F.last(F.when(F.col("block_type") == "Table", F.col("_n")), True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stops = ~F.col("block_type").isin("Table", "Text", "Footnote") | F.col("text").rlike(r"(?i)^\W*(?:table|tab\.|fig(?:ure)?s?\.?)\s*\d+")
    run = Window.partitionBy("paper_id", "_table.anchor").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    solid = solid.withColumn("_stop", F.max((stops & (F.col("block_type") != "Table")).cast("int")).over(run))
    notes = solid.filter((F.col("_stop") == 0) & (F.col("block_type") != "Table") & F.col("_table").isNotNull() & (F.col("_n") - F.col("_tn") <= reach))
    notes = notes.filter((F.col("block_type") == "Footnote") | (F.col("_n") - F.col("_tn") == 1))
    caption = solid.filter("block_type = 'Caption' and _next.block_type = 'Table'").select("paper_id", F.col("_next.anchor").alias("table_anchor"), "anchor", "text", F.lit("caption").alias("role"))
    return caption.unionByName(notes.select("paper_id", F.col("_table.anchor").alias("table_anchor"), "anchor", "text", F.lit("note").alias("role")))


def pooled_representable(factors: DataFrame, keys: list[str]) -> DataFrame:
    """Whether a table's pooling can be recorded: not over sites (L2), and with a treatment dimension left (L1)."""
    found = factors.groupBy(*keys).agg(F.bool_or(F.col("pooled") & (F.col("dimension") == "site")).alias("site"), F.bool_or(~F.col("pooled") & (F.col("dimension") == "treatment")).alias("treatment"))
    return found.select(*keys, F.when(F.col("site"), "L2").when(~F.col("treatment"), "L1").alias("limitation"))


def is_main_effect_layout(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Tables whose rows each set one factor while several factors occur: every row is a marginal mean.

    ``rows``: keys, row_id, factor.
    """
    sets = rows.groupBy(*keys, "row_id").agg(F.count_distinct("factor").alias("n"), F.min("factor").alias("f"))
    return sets.groupBy(*keys).agg((F.bool_and(F.col("n") == 1) & (F.count_distinct("f") > 1)).alias("marginal"))


def time_level(cells: DataFrame, levels: DataFrame, keys: list[str]) -> DataFrame:
    """Each cell's time level where exactly one fits its factor, level and site (a level without a site fits all)."""
    c, t = cells.alias("c"), levels.alias("t")
    on = [F.col(f"c.{k}") == F.col(f"t.{k}") for k in (*keys, "factor", "level")]
    hits = c.join(t, on).filter(F.col("t.site").isNull() | (F.col("t.site") == F.col("c.site")))
    return hits.groupBy(*[F.col(f"c.{k}").alias(k) for k in keys], F.col("c.cell_id").alias("cell_id")).agg(F.count("*").alias("n"), F.min("t.date_text").alias("date_text")).filter("n = 1").drop("n")


def factor_readings(levels: DataFrame, keys: list[str]) -> DataFrame:
    """Levels that read as another factor's level: 'alias' where one factor alone has it, 'withhold' where several do.

    ``levels``: keys, factor, level. A level names another factor's by an equal compact key.
    """
    own = levels.select(*keys, "factor", "level", T.joined_key(F.col("level")).alias("_k")).distinct()
    other = own.select(*keys, F.col("factor").alias("other"), "_k")
    hits = own.join(other, [*keys, "_k"]).filter("factor <> other")
    return hits.groupBy(*keys, "factor", "level").agg(F.count_distinct("other").alias("n"), F.min("other").alias("other")).select(*keys, "factor", "level", "other", F.when(F.col("n") == 1, "alias").otherwise("withhold").alias("verdict"))


def proximity(words: Column, verbs: list[str], targets: list[str], before: int = 12, after: int = 3) -> Column:
    """Whether a target stands at most ``before`` words before or ``after`` words behind one of the verbs."""
    at = lambda wanted: F.filter(F.transform(words, lambda w, i: F.when(w.isin(wanted), i)), lambda i: i.isNotNull())
    return F.exists(at(verbs), lambda v: F.exists(at(targets), lambda t: (t >= v - before) & (t <= v + after)))
