"""Building blocks of the record and document operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ISSUE_COLUMNS = ("severity", "code", "entity_type", "entity_id", "message")


def issues(rows: DataFrame, severity: str, code: str, entity_type: str, entity_id: Column | str, message: Column | str) -> DataFrame:
    """Rows as issues of one rule."""
    text = message if isinstance(message, Column) else F.lit(message)
    key = F.col(entity_id) if isinstance(entity_id, str) else entity_id
    return rows.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(entity_type).alias("entity_type"), key.cast("string").alias("entity_id"), text.alias("message"))


def latest_wins(log: DataFrame, keys: Sequence[str], order: Column, value: Sequence[str] | None = None) -> DataFrame:
    """The last row of each key by ``order``: one aggregation with a map-side part, no sort of the log.

    A filter on anything but the keys belongs before this call: afterwards it would hide records
    whose latest row it drops.
    """
    rest = list(value) if value is not None else [c for c in log.columns if c not in keys]
    found = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("latest"))
    return found.select(*keys, *[F.col("latest").getField(c).alias(c) for c in rest])


def unique_best(scored: DataFrame, keys: Sequence[str], score: str, choice: Sequence[str]) -> DataFrame:
    """The choice of the strictly highest positive score of each key; NULL where the best is tied or nothing scored."""
    best = scored.groupBy(*keys, score).agg(F.count("*").alias("_n"), F.min(F.struct(*choice)).alias("_c"))
    top = best.groupBy(*keys).agg(F.max(F.struct(score, "_n", "_c")).alias("_t"))
    sure = (F.col(f"_t.{score}") > 0) & (F.col("_t._n") == 1)
    return top.select(*keys, *[F.when(sure, F.col(f"_t._c.{c}")).alias(c) for c in choice], F.when(sure, F.col(f"_t.{score}")).alias(score))


def carry_forward(rows: DataFrame, part: Sequence[str], order: Sequence[str], value: Column, name: str, initial: str | None = None) -> DataFrame:
    """The last non-null value up to each row, in order."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = F.last(value, ignorenulls=True).over(w)
    return rows.withColumn(name, F.coalesce(carried, F.lit(initial)) if initial is not None else carried)


def neighbours(rows: DataFrame, part: Sequence[str], order: Sequence[str], before: int, after: int, value: str, name: str) -> DataFrame:
    """The values of up to ``before`` and ``after`` rows around each row, itself included, clamped at the ends."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(-before, after)
    return rows.withColumn(name, F.collect_list(value).over(w))


def look_back(rows: DataFrame, part: Sequence[str], order: Sequence[str], mark: Column, value: str, reach: int, name: str) -> DataFrame:
    """The value of the nearest earlier row, at most ``reach`` rows back, for which ``mark`` holds."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(-reach, -1)
    return rows.withColumn(name, F.last(F.when(mark, F.col(value)), ignorenulls=True).over(w))


def chain_runs(rows: DataFrame, part: Sequence[str], order: Sequence[str], continues: Column, name: str) -> DataFrame:
    """Numbers the runs of rows that continue the row before them, from 1."""
    w = Window.partitionBy(*part).orderBy(*order)
    flagged = rows.withColumn("_head", F.when(F.coalesce(continues, F.lit(False)), 0).otherwise(1))
    return flagged.withColumn(name, F.sum("_head").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_head")


def first_seen(rows: DataFrame, part: Sequence[str], order: Sequence[str], name: str = "nth") -> DataFrame:
    """Numbers the rows of each key in order; the first sighting is 1."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy(*order)))


def budget_fold(items: DataFrame, part: Sequence[str], order: Sequence[str], size: str, cap: int, mode: str = "skip", keep: Sequence[str] = ()) -> DataFrame:
    """Items taken in order under a budget of ``cap`` for each part.

    ``skip``: an item that does not fit is passed over and later ones may still fit (a fold, not a
    running sum). ``stop``: the first that does not fit ends the part (a running sum).
    ``skip`` holds one part's (order, size) pairs in a row's array: parts are bounded documents.
    """
    if mode == "stop":
        w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        used = items.withColumn("used", F.sum(size).over(w))
        return used.filter(F.col("used") <= cap)
    pairs = items.groupBy(*part).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(size).cast("bigint").alias("_size"), *[c for c in keep if c not in order]))).alias("_items"))
    kept = F.aggregate(
        "_items",
        F.struct(F.lit(0).cast("bigint").alias("used"), F.filter("_items", lambda x: F.lit(False)).alias("taken")),
        lambda acc, x: F.when(acc["used"] + x["_size"] <= cap, F.struct((acc["used"] + x["_size"]).alias("used"), F.concat(acc["taken"], F.array(x)).alias("taken"))).otherwise(acc),
        lambda acc: acc["taken"],
    )
    return pairs.select(*part, F.explode(kept).alias("_x")).select(*part, "_x.*").withColumnRenamed("_size", size)


def cluster_rows(values: Column, tolerance: float) -> Column:
    """Greedy rows of sorted coordinates: a value joins the row whose FIRST value is within the tolerance.

    An array of struct(value, row) from an array of numbers.
    """
    ordered = F.sort_array(values)
    empty = F.transform(F.filter(ordered, lambda x: F.lit(False)), lambda x: F.struct(x.alias("value"), F.lit(0).alias("row")))
    start = F.struct(F.lit(None).cast("double").alias("first"), F.lit(-1).alias("row"), empty.alias("out"))

    def step(acc, x):
        joins = acc["first"].isNotNull() & (x - acc["first"] <= F.lit(tolerance))
        row = F.when(joins, acc["row"]).otherwise(acc["row"] + 1)
        return F.struct(F.when(joins, acc["first"]).otherwise(x).alias("first"), row.alias("row"), F.concat(acc["out"], F.array(F.struct(x.alias("value"), row.alias("row")))).alias("out"))

    return F.aggregate(ordered, start, step, lambda acc: acc["out"])
