"""Generalisation hierarchies: one line per leaf, ``leaf;parent;...;*``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.runtime import inline_rows, join_members, materialise


def read_hierarchy_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a hierarchy file in file order."""
    text = spark.read.text(path).select(
        F.trim("value").alias("line"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    # ids grow within one block of a file, so (block, id) is the file order for any split size
    return text.filter(F.length("line") > 0).select(
        "line", F.struct("_file", "_block", "_at").alias("ord")
    )


def read_hierarchy(spark: SparkSession, path: str, attr: str) -> DataFrame:
    """Hierarchy file as a closure table."""
    return closure_from_lines(read_hierarchy_lines(spark, path), attr)


def lines_from_list(spark: SparkSession, lines: list[str]) -> DataFrame:
    """A short hierarchy declared in code."""
    return inline_rows(spark, ["line", "ord"], [(line, i) for i, line in enumerate(lines)])


def closure_from_lines(lines: DataFrame, attr: str) -> DataFrame:
    """One row per (leaf, path, ancestor), the leaf itself included.

    ``lines`` has ``line`` and an orderable ``ord``. A line given twice counts once; a leaf with
    two different lines has two paths, numbered in file order. ``height`` is 0 at the root and
    ``level`` counts up from the deepest leaves.
    """
    paths = materialise(
        lines.groupBy(F.trim("line").alias("line"))
        .agg(F.min("ord").alias("ord"))
        .withColumn("nodes", F.transform(F.split("line", ";"), lambda x: F.trim(x)))
        .withColumn("leaf", F.element_at("nodes", 1))
    )
    leaves = paths.groupBy("leaf").agg(
        F.min("ord").alias("leaf_ord"),
        F.array_sort(F.collect_list(F.struct("ord", "nodes"))).alias("_paths"),
    )
    facts = paths.agg(
        F.count(F.lit(1)).alias("lines"),
        (F.max(F.size("nodes")) - 1).alias("tree_height"),
        F.min_by("leaf", "ord").try_cast("double").isNotNull().alias("is_numeric"),
    ).first()
    cells = (
        leaves.select("leaf", "leaf_ord", F.posexplode("_paths").alias("path_id", "_path"))
        .select("leaf", "leaf_ord", "path_id", F.col("_path.nodes").alias("_nodes"))
        .select(
            "leaf", "leaf_ord", "path_id", F.size("_nodes").alias("_n"),
            F.posexplode("_nodes").alias("_i", "node"),
        )
    )
    widths = cells.groupBy("node").agg(F.countDistinct("leaf").alias("n_leaves"))
    # every leaf has the root among its ancestors: the widest nodes must not meet in one task
    wide = join_members(cells, widths, ["node"], "n_leaves", facts["lines"], facts["lines"])
    height = F.col("_n") - 1 - F.col("_i")
    return wide.select(
        F.lit(attr).alias("attr"), "leaf", "leaf_ord", "path_id",
        (F.lit(facts["tree_height"]) - height).alias("level"), "node", height.alias("height"),
        "n_leaves", F.lit(facts["is_numeric"]).alias("is_numeric"),
    )
