"""Sources and sinks: append-only logs, run artifacts, layout trees, catalogues of papers and runs."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "seq long, ts double, paper_id string, entity_type string, record_id string, status string, run_id string, payload string"
CORRECTION = "seq long, ts double, paper_id string, entity_type string, record_id string, field_name string, action string, payload string, reviewer string, run_id string"


def read_jsonl(spark: SparkSession, path: str, schema: str, stream: bool = False) -> DataFrame:
    """One JSON object for each line; blank lines go, a broken line has its text in ``_error`` and nulls elsewhere."""
    source = (spark.readStream if stream else spark.read).text(path)
    rows = source.filter(F.trim("value") != "").withColumn("_x", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    broken = F.expr("try_parse_json(value)").isNull()
    return rows.select("_x.*", F.when(broken, F.col("value")).alias("_error"))


def append(rows: DataFrame, path: str) -> None:
    """Append to a log partitioned by paper."""
    rows.write.mode("append").partitionBy("paper_id").parquet(path)


def read_log(spark: SparkSession, path: str, paper_id: str | None = None) -> DataFrame:
    """A log, or one paper's partition of it."""
    rows = spark.read.parquet(path)
    return rows if paper_id is None else rows.filter(F.col("paper_id") == paper_id)


def checked_actions(rows: DataFrame, actions: tuple[str, ...]) -> DataFrame:
    """Corrections whose action is known; an unknown one fails the query."""
    known = F.col("action").isin(*actions)
    return rows.withColumn("action", F.when(known, F.col("action")).otherwise(F.raise_error(F.concat(F.lit("unknown action "), F.coalesce("action", F.lit("null"))))))


def replace_partition(rows: DataFrame, path: str, keys: tuple[str, ...] = ("paper_id", "entity_type", "run_id")) -> None:
    """Replace the partitions that the rows belong to and leave all others; a retried write ends the same."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def latest_run(runs: DataFrame) -> DataFrame:
    """The last completed run of each paper."""
    return runs.filter("status = 'completed'").groupBy("paper_id").agg(F.max_by("run_id", F.struct("completed_at", "run_id")).alias("run_id"))


def resolved_run(papers: DataFrame, runs: DataFrame, requested: str | None) -> DataFrame:
    """The run to read for each paper: the one asked for, else the last completed, else the unversioned layout."""
    found = papers.join(latest_run(runs).withColumnRenamed("run_id", "_latest"), "paper_id", "left")
    return found.withColumn("run_id", F.coalesce(F.lit(requested), F.col("_latest"), F.lit("__legacy__"))).drop("_latest")


def one_tree_file(files: DataFrame) -> DataFrame:
    """(directory, name) to the one file to read: that of the directory's name, else the only one that is no _meta file, else an error."""
    own = F.concat(F.element_at(F.split("directory", "/"), -1), F.lit(".json"))
    found = files.filter(F.col("name").endswith(".json") & ~F.col("name").endswith("_meta.json")).groupBy("directory").agg(F.max(F.when(F.col("name") == own, F.col("name"))).alias("exact"), F.count("*").alias("n"), F.min("name").alias("only"))
    every = files.select("directory").distinct().join(found, "directory", "left")
    name = F.coalesce("exact", F.when(F.col("n") == 1, F.col("only")))
    return every.select("directory", name.alias("name"), F.when(name.isNull(), F.when(F.coalesce("n", F.lit(0)) == 0, "no tree file").otherwise("several tree files")).alias("error"))


LAYOUT = "paper_id string, path array<int>, depth int, node_id string, parent_id string, block_type string, html string, bbox array<double>, polygon array<array<double>>, section_hierarchy map<string,string>, n_images int, error string"


def flatten_layout(files: DataFrame) -> DataFrame:
    """(paper_id, json) as one row for each node of the tree in pre-order; a broken file gives one row with its error.

    A recursive schema has no DataFrame type, so this one step walks the tree in Python, file by file.
    """

    def walk(node: dict, paper: str) -> Iterator[tuple]:
        stack = [(node, (0,), None)]
        while stack:
            x, path, parent = stack.pop()
            yield (paper, list(path), len(path), x.get("id"), parent, x.get("block_type"), x.get("html"), x.get("bbox"), x.get("polygon"), {str(k): str(v) for k, v in (x.get("section_hierarchy") or {}).items()}, len(x.get("images") or {}), None)
            for i, child in reversed(list(enumerate(x.get("children") or []))):
                stack.append((child, (*path, i), x.get("id")))

    def run(batches):
        import pandas as pd

        columns = [c.strip().split(" ")[0] for c in LAYOUT.replace("map<string,string>", "map").split(",")]
        for batch in batches:
            rows = []
            for paper, text in zip(batch["paper_id"], batch["json"]):
                try:
                    rows.extend(walk(json.loads(text), paper))
                except (ValueError, AttributeError, TypeError) as e:
                    rows.append((paper, None, None, None, None, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=columns)

    return files.select("paper_id", "json").mapInPandas(run, LAYOUT)


def anchored(nodes: DataFrame) -> DataFrame:
    """Rendered leaves with document-wide anchors in pre-order; the rest without.

    Leaves that can be cited are rendered, page furniture and cells are logged only, unknown types are
    marked and not rendered.
    """
    from pyspark.sql import Window

    from ..operators.documents import POLICY
    from .html import html_to_text, is_repaired, page_id

    policy = F.create_map(*[F.lit(x) for kv in POLICY for x in kv])
    rows = nodes.filter("error is null").withColumn("policy", F.coalesce(F.element_at(policy, F.col("block_type")), F.lit("unhandled")))
    rows = rows.filter("policy <> 'container'").withColumn("rendered_in_content_md", F.col("policy") == "citable")
    order = Window.partitionBy("paper_id").orderBy("path")
    n = F.sum(F.col("rendered_in_content_md").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    anchor = F.when(F.col("rendered_in_content_md"), F.concat(F.lit("b:"), F.lpad(n.cast("string"), 4, "0")))
    return rows.select(
        "paper_id", anchor.alias("anchor"), F.when(F.col("rendered_in_content_md"), n).cast("int").alias("ord"), "block_type", html_to_text(F.col("html")).alias("text"), page_id(F.col("node_id")).alias("page_id"),
        "section_hierarchy", "bbox", "polygon", "rendered_in_content_md", F.col("node_id").alias("marker_block_id"), F.coalesce(is_repaired(F.col("html")), F.lit(False)).alias("repaired"), (F.col("policy") == "unhandled").alias("unhandled_block_type"),
    )


def section_paths(nodes: DataFrame) -> DataFrame:
    """Each node's headings in ascending level; one that is not in the document reads as unresolved."""
    titles = nodes.filter("block_type = 'SectionHeader'").select("paper_id", F.col("node_id").alias("_h"), F.trim(F.regexp_replace("html", "<[^>]+>", " ")).alias("_title"))
    levels = nodes.select("paper_id", "node_id", F.explode("section_hierarchy").alias("_level", "_h"))
    found = levels.join(titles, ["paper_id", "_h"], "left")
    title = F.coalesce("_title", F.concat(F.lit("[unresolved "), "_h", F.lit("]")))
    return found.groupBy("paper_id", "node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_level").cast("int").alias("l"), title.alias("t")))), lambda x: x["t"]).alias("section_path"))


def grid_positions(cells: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Row and column of each cell from its box: rows by greedy clustering of y centres, columns by x from the left."""
    from pyspark.sql import Window

    from ..operators.core import cluster_rows

    y = (F.col("bbox")[1] + F.col("bbox")[3]) / 2
    rows = cells.withColumn("_y", y)
    placed = rows.groupBy("paper_id", "parent_table_anchor").agg(cluster_rows(F.collect_list("_y"), tolerance).alias("_r"))
    placed = placed.select("paper_id", "parent_table_anchor", F.explode(F.array_distinct("_r")).alias("_x")).select("paper_id", "parent_table_anchor", F.col("_x.value").alias("_y"), F.col("_x.row").alias("row_index"))
    found = rows.join(placed, ["paper_id", "parent_table_anchor", "_y"])
    left = Window.partitionBy("paper_id", "parent_table_anchor", "row_index").orderBy(F.col("bbox")[0])
    return found.withColumn("col_index", F.row_number().over(left) - 1).drop("_y")


def tool_outputs(streams: DataFrame, text: str) -> DataFrame:
    """Outputs of tools in recorded event streams, one event a line; other lines and broken ones go."""
    lines = streams.withColumn("_line", F.explode(F.split(text, "\n"))).withColumn("_v", F.expr("try_parse_json(_line)"))
    out = F.expr("try_variant_get(_v, '$.part.state.output', 'string')")
    return lines.filter(F.expr("try_variant_get(_v, '$.type', 'string')") == "tool_use").withColumn("output", out).drop("_line", "_v")


def fenced_json(text: Column) -> Column:
    """The JSON of a fenced block, else of the text itself; NULL where neither parses."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.try_parse_json(F.when(inner != "", inner).otherwise(text))
