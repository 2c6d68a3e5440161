"""Table reconstruction: unpivot, combinations, marginals, placement, ranges, candidates and their duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def unpivot(rows: DataFrame, keys: list[str], columns: dict[str, str], name: str, value: str) -> DataFrame:
    """Value columns as rows of (name, value)."""
    named = rows.select(*keys, *[F.col(c).alias(n) for n, c in columns.items()])
    return named.unpivot(keys, list(columns), name, value)


def combinations(rows: DataFrame, levels: list[str], order: str, first: str) -> DataFrame:
    """Distinct combinations of levels, with their first occurrence and number."""
    return rows.groupBy(*levels).agg(F.min(order).alias(first), F.count("*").alias("n"))


def agreement(rows: DataFrame, keys: list[str], agree: Column, numerator: int, denominator: int) -> DataFrame:
    """Agreeing rows of each key, and whether their share reaches numerator / denominator."""
    found = rows.groupBy(*keys).agg(F.count_if(agree).alias("agree"), F.count("*").alias("n"))
    return found.withColumn("trusted", F.col("agree") * denominator >= F.col("n") * numerator)


def marginals(rows: DataFrame, factors: list[str]) -> DataFrame:
    """All marginal groups with the factors each is pooled over."""
    pooled = F.array_compact(F.array(*[F.when(F.grouping(f) == 1, F.lit(f)) for f in factors]))
    return rows.cube(*factors).agg(F.array_join(pooled, ",").alias("pooled"), F.count("*").alias("n")).select(*factors, "pooled", "n")


def range_conflicts(ranges: DataFrame, key: str, name: str) -> DataFrame:
    """Keys whose ranges (lo, hi) share exactly one bound: two equi joins, one on each bound."""
    a = ranges.select(F.col(key).alias(f"{name}_a"), F.col("lo").alias("la"), F.col("hi").alias("ha"))
    b = ranges.select(F.col(key).alias(f"{name}_b"), F.col("lo").alias("lb"), F.col("hi").alias("hb"))
    order = F.col(f"{name}_a") < F.col(f"{name}_b")
    low = a.join(b, (F.col("la") == F.col("lb")) & order & (F.col("ha") != F.col("hb")))
    high = a.join(b, (F.col("ha") == F.col("hb")) & order & (F.col("la") != F.col("lb")))
    return low.union(high).select(f"{name}_a", f"{name}_b")


#: Fixed value: row labels that are a statistic, not a level.
STATISTIC_ROW = r"(?i)^\W*(?:mean|means|average|se|sem|sd|cv|lsd|hsd|p|p[- ]?value|significance|anova|f|total)\b"


def cell_candidates(tables: DataFrame) -> DataFrame:
    """One row for each (row group, value column) with a value; statistic rows are routed aside.

    ``tables``: paper_id, table_id, row_groups array<struct<row_group_id, factor_values map, cells
    map>>, value_columns array<struct<value_column_id, variable, factor_levels map>>.
    """
    rows = tables.select("paper_id", "table_id", "value_columns", F.explode("row_groups").alias("g"))
    rows = rows.select("paper_id", "table_id", "value_columns", "g.row_group_id", "g.factor_values", F.explode("g.cells").alias("value_column_id", "cell_text"))
    rows = rows.filter(F.trim("cell_text") != "")
    column = F.get(F.filter("value_columns", lambda c: c["value_column_id"] == F.col("value_column_id")), F.lit(0))
    summary = F.exists(F.map_values("factor_values"), lambda v: v.rlike(STATISTIC_ROW))
    route = F.when(column.isNull(), "unknown_column").when(summary, "statistic").when(column["variable"].isNull(), "unidentified").otherwise("candidate")
    return rows.select("paper_id", "table_id", "row_group_id", "value_column_id", "cell_text", "factor_values", column["variable"].alias("variable"), column["factor_levels"].alias("factor_levels"), route.alias("route"))


def dimension_levels(factors: Column, row: Column, column: Column, context: Column) -> Column:
    """The level of each factor: the row's, else the column's, else the context's."""
    level = lambda f: F.coalesce(F.element_at(row, f), F.element_at(column, f), F.element_at(context, f))
    return F.filter(F.transform(factors, lambda f: F.struct(f["name"].alias("name"), f["dimension"].alias("dimension"), level(f["name"]).alias("level"))), lambda x: x["level"].isNotNull())


def identity(levels: Column, site: Column) -> Column:
    """A treatment as the set of its normalised levels, and its site."""
    return F.concat_ws("|", F.array_join(F.array_sort(F.array_distinct(F.transform(levels, T.name_key))), ";"), F.coalesce(site, F.lit("")))


def numeric_check(reconstructed: DataFrame, raw: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers reconstructed against numbers in the source: not more, and half at least."""
    both = raw.select(*keys, F.col("n").alias("raw")).join(reconstructed.select(*keys, F.col("n").alias("got")), keys, "left")
    got = F.coalesce("got", F.lit(0))
    return both.select(*keys, "raw", got.alias("got"), F.when(got > F.col("raw"), "too_many").when(2 * got < F.col("raw"), "too_few").otherwise("ok").alias("verdict"))


def placements(groups: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Each row group with the grid row that holds most of its values: the only best, with 60 % of them at least.

    ``groups``: keys, row_group_id, values array; ``grid``: keys, row_index, cells array. Values meet cells by equality.
    """
    a = groups.select(*keys, "row_group_id", F.size("values").alias("size"), F.explode(F.array_distinct("values")).alias("v"))
    b = grid.select(*keys, "row_index", F.explode(F.array_distinct("cells")).alias("v"))
    scored = a.join(b, [*keys, "v"]).groupBy(*keys, "row_group_id", "row_index").agg(F.count("*").alias("score"), F.max("size").alias("size"))
    from .core import unique_best

    best = unique_best(scored, [*keys, "row_group_id"], "score", ["row_index", "size"])
    return best.filter("score >= 0.6 * size").select(*keys, "row_group_id", "row_index", "score")


def withhold_duplicates(groups: DataFrame, keys: list[str], level_key: Column, order: str) -> DataFrame:
    """Row groups with whether they repeat an earlier one's levels."""
    w = Window.partitionBy(*keys, level_key).orderBy(order)
    return groups.withColumn("withheld", F.row_number().over(w) > 1)


def all_levels_known(levels: DataFrame, pool: DataFrame, factor: list[str], level: str, entry: str) -> DataFrame:
    """Factors of which every level is exactly one entry of the pool."""
    keyed = pool.select(T.words_key(F.col(entry)).alias("_k")).groupBy("_k").agg(F.count("*").alias("_n"))
    found = levels.withColumn("_k", T.words_key(F.col(level))).join(keyed, "_k", "left")
    return found.groupBy(*factor).agg(F.bool_and(F.coalesce(F.col("_n") == 1, F.lit(False))).alias("known")).filter("known").drop("known")


def uncovered_candidates(candidates: DataFrame, covered: Column) -> DataFrame:
    """Candidates with an anchor outside the covered ones."""
    return candidates.filter(F.size(F.array_except("anchors", covered)) > 0)


def subsumed(freeform: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Free-form candidates that a table's links cover wholly go."""
    links = freeform.select(*keys, "candidate_id", F.explode("links").alias("field", "target"))
    have = table.select(*keys, F.explode("links").alias("field", "target")).distinct().withColumn("_have", F.lit(True))
    covered = links.join(have, [*keys, "field", "target"], "left").groupBy(*keys, "candidate_id").agg(F.bool_and(F.coalesce("_have", F.lit(False))).alias("all")).filter("all")
    return freeform.join(covered, [*keys, "candidate_id"], "left_anti")


def numbered_ids(candidates: DataFrame, keys: list[str], name: str, order: str) -> DataFrame:
    """Second and later uses of an id get a suffix."""
    w = Window.partitionBy(*keys, name).orderBy(order)
    nth = F.row_number().over(w)
    return candidates.withColumn("_n", nth).withColumn(name, F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_dup"), F.col("_n").cast("string")))).drop("_n")
