"""Taxonomy operators as table work over the closure table.

Nodes are keyed by value. Distances use the union of ancestors over all paths of a value;
generalisation follows path 0, the first in file order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.distance import ancestor_distance, similarity_from_depths
from veilspark import runtime
from veilspark.runtime import lookup, materialise, small
from veilspark.sources.hierarchy import closure_from_lines
from veilspark.spec import STAR

# Largest node count for which the quadratic distance matrix is built.
MATRIX_NODES = 20_000


@dataclass(frozen=True)
class Boundary:
    """Public ends of an attribute and their distance."""

    bottom: str
    top: str
    distance: float


class Taxonomy:
    """A closure table with its measured facts (rows, height, domain size)."""

    def __init__(self, closure: DataFrame, attr: str):
        self.attr = attr
        # scanned many times in one plan: written once, so that plans stay short
        self.closure = materialise(closure)

    @classmethod
    def from_lines(cls, lines: DataFrame, attr: str) -> "Taxonomy":
        return cls(closure_from_lines(lines, attr), attr)

    @cached_property
    def facts(self):
        return self.closure.agg(
            F.count(F.lit(1)).alias("rows"),
            F.max("height").alias("height"),
            F.max("n_leaves").alias("domain_size"),
            F.max("is_numeric").alias("is_numeric"),
            F.max("path_id").alias("last_path"),
        ).first()

    @property
    def height(self) -> int:
        return self.facts["height"]

    @property
    def domain_size(self) -> int:
        return self.facts["domain_size"]

    @property
    def is_numeric(self) -> bool:
        return self.facts["is_numeric"]

    @property
    def has_shared_values(self) -> bool:
        """Some value has more than one path to the root."""
        return self.facts["last_path"] > 0

    @cached_property
    def has_odd_nodes(self) -> bool:
        """Some node, leaf or not, has more than one path to the root."""
        return bool(self.nodes.filter(~F.col("single")).limit(1).count())

    @property
    def is_small(self) -> bool:
        return self.facts["rows"] <= runtime.BROADCAST_ROWS

    def hint(self, df: DataFrame) -> DataFrame:
        """Broadcast a table derived from this closure when the closure is small."""
        return small(df, self.facts["rows"])

    def lookup(self, df: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
        """Join a value column with a one-row-per-value table derived from this closure."""
        return lookup(df, table, [key], self.facts["rows"], how)

    @cached_property
    def nodes(self) -> DataFrame:
        """Node table of this taxonomy, written once for the many lookups of one plan."""
        return materialise(node_table(self))

    @cached_property
    def boundary(self) -> Boundary:
        from veilspark.operators.marginality import boundary

        row = boundary(self).first()
        return Boundary(row["bottom"], row["top"], row["distance"])


def node_paths(tax: Taxonomy) -> DataFrame:
    """Every node of every path with its own path to the root, itself first."""
    step = F.struct((-F.col("height")).alias("h"), F.col("node").alias("node"))
    paths = tax.closure.groupBy("leaf", "leaf_ord", "path_id").agg(
        F.transform(F.array_sort(F.collect_list(step)), lambda s: s["node"]).alias("path")
    )
    return paths.select(
        "leaf", "leaf_ord", "path_id", F.size("path").alias("_n"),
        F.posexplode("path").alias("_i", "node"), "path",
    ).select(
        "leaf_ord", "path_id", "node", (F.col("_i") == 0).alias("is_leaf"),
        (F.col("_n") - F.col("_i")).alias("depth"),
        F.slice("path", F.col("_i") + 1, F.col("_n") - F.col("_i")).alias("up"),
    )


def node_table(tax: Taxonomy) -> DataFrame:
    """One row per node: ancestor set (itself included), its size, depth (root 1) on the first
    path, file order of its first leaf, and whether it has a single path."""
    paths = node_paths(tax)
    return paths.groupBy("node").agg(
        F.array_distinct(F.flatten(F.collect_set("up"))).alias("ancestors"),
        F.min_by("depth", F.struct("leaf_ord", "path_id")).alias("depth"),
        F.min("leaf_ord").alias("leaf_ord"),
        F.max("is_leaf").alias("is_leaf"),
        (F.count_distinct("up") == 1).alias("single"),
        F.count_distinct("leaf_ord").alias("n_leaves"),
    ).withColumn("size", F.size("ancestors"))


def odd_nodes(tax: Taxonomy) -> DataFrame:
    """Nodes with more than one path to the root, and nodes below such a node."""
    split = tax.nodes.filter(~F.col("single")).select(F.col("node").alias("_up"))
    ways = tax.nodes.select("node", F.explode("ancestors").alias("_up"))
    return ways.join(tax.hint(split), "_up", "left_semi").select("node").distinct()


def ancestors(tax: Taxonomy) -> DataFrame:
    """Ancestor set of every leaf value, itself included, over all its paths."""
    return tax.closure.groupBy("leaf").agg(F.sort_array(F.collect_set("node")).alias("ancestors"))


def leaf_domain(tax: Taxonomy) -> DataFrame:
    """Values at the deepest level in file order; leaves of shorter branches are not in it."""
    deep = tax.closure.filter((F.col("level") == 0) & (F.col("height") == tax.height))
    return deep.select("leaf", "leaf_ord").distinct()


def node_width(tax: Taxonomy) -> DataFrame:
    """Distinct leaves below each node."""
    return tax.closure.groupBy("node").agg(F.countDistinct("leaf").alias("n_leaves"))


def node_level(tax: Taxonomy) -> DataFrame:
    """Generalisation level of each node on its first path."""
    return tax.closure.groupBy("node").agg(
        F.min_by("level", F.struct("leaf_ord", "path_id")).alias("level")
    )


def node_facts(tax: Taxonomy) -> DataFrame:
    """Leaf count and level of each node, for metrics."""
    return tax.closure.groupBy("node").agg(
        F.first("n_leaves").alias("n_leaves"),
        F.min_by("level", F.struct("leaf_ord", "path_id")).alias("level"),
    )


def value_paths(tax: Taxonomy) -> DataFrame:
    """For every leaf value, an array over levels 0..height of its generalisation ``node`` and the
    ``share`` of the domain it covers. Below its own level a value stays as it is."""
    step = F.struct("level", F.struct("node", (F.col("n_leaves") / F.lit(tax.domain_size)).alias("share")))
    first = tax.closure.filter("path_id = 0").groupBy("leaf").agg(
        F.map_from_entries(F.collect_list(step)).alias("_at"), F.min("level").alias("_own"))
    levels = F.sequence(F.lit(0), F.lit(tax.height))
    return first.select(
        F.col("leaf").alias("value"),
        F.transform(levels, lambda i: F.try_element_at("_at", F.greatest(i, "_own"))).alias("path"),
    )


def at_level(tax: Taxonomy, level: int) -> DataFrame:
    """Leaf -> node at one level."""
    level = min(level, tax.height)
    first = tax.closure.filter("path_id = 0")
    return first.groupBy("leaf").agg(
        F.min_by("node", F.when(F.col("level") >= level, F.col("level"))).alias("node")
    )


def _node_pairs(tax: Taxonomy, nodes: str) -> DataFrame:
    table = tax.nodes
    if nodes == "leaf":
        table = table.join(leaf_domain(tax).select(F.col("leaf").alias("node")), "node", "left_semi")
    elif nodes != "all":
        raise ValueError("nodes must be 'leaf' or 'all'")
    n = table.count()
    if n > MATRIX_NODES:
        raise ValueError(
            f"{tax.attr}: {n} nodes are too many for a matrix; marginalities need no pairs"
        )
    blocks = max(1, n // 256)
    side = ["node", "ancestors", "depth", "size"]
    a = table.select(*[F.col(c).alias(f"{c}_a") for c in side],
                     F.pmod(F.xxhash64("node"), F.lit(blocks)).alias("_block"))
    b = table.select(*[F.col(c).alias(f"{c}_b") for c in side],
                     F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    b = b.withColumn("_block", F.col("_block").cast("bigint"))
    return a.join(b, "_block").drop("_block")


def lcs(tax: Taxonomy, nodes: str = "leaf") -> DataFrame:
    """Deepest common ancestor of every pair; its height is measured on its own first path."""
    depth = tax.hint(tax.nodes.select(F.col("node").alias("lcs"), F.col("depth").alias("lcs_depth")))
    common = F.explode(F.array_intersect("ancestors_a", "ancestors_b")).alias("lcs")
    return (
        _node_pairs(tax, nodes)
        .select("node_a", "node_b", "depth_a", "depth_b", common)
        .join(depth, "lcs")
        .groupBy("node_a", "node_b", "depth_a", "depth_b")
        .agg(F.max(F.struct("lcs_depth", "lcs")).alias("_m"))
        .select("node_a", "node_b", "depth_a", "depth_b", "_m.lcs",
                F.col("_m.lcs_depth").alias("lcs_depth"),
                (F.col("_m.lcs_depth") - 1).alias("lcs_height"))
    )


def distance_matrix(tax: Taxonomy, nodes: str = "leaf", dist: str = "semantic") -> DataFrame:
    """Distance of every pair of leaf-domain values, or of all nodes."""
    if dist == "similarity":
        return lcs(tax, nodes).select(
            "node_a", "node_b", similarity_from_depths(
                F.col("lcs_depth"), F.col("depth_a"), F.col("depth_b")).alias("distance"))
    return _node_pairs(tax, nodes).select(
        "node_a", "node_b",
        ancestor_distance(F.col("ancestors_a"), F.col("ancestors_b")).alias("distance"),
    )


def semantic_distance(df: DataFrame, a: str, b: str, tax: Taxonomy, out: str = "distance") -> DataFrame:
    """Log distance of two value columns, by looking up both ancestor sets."""
    for c in (a, b):
        table = tax.nodes.select(F.col("node").alias(c), F.col("ancestors").alias(f"_{c}_up"))
        df = tax.lookup(df, table, c)
    return df.withColumn(out, ancestor_distance(F.col(f"_{a}_up"), F.col(f"_{b}_up"))).drop(f"_{a}_up", f"_{b}_up")


def similarity_distance(df: DataFrame, a: str, b: str, tax: Taxonomy, out: str = "distance") -> DataFrame:
    """Path distance of two value columns."""
    # ancestors carry their depth, so the deepest common one needs no further join
    depths = tax.nodes.select(F.col("node").alias("_anc"), F.col("depth").alias("_anc_depth"))
    ups = (
        tax.lookup(tax.nodes.select("node", "depth", F.explode("ancestors").alias("_anc")), depths, "_anc")
        .groupBy("node", "depth").agg(F.collect_set(F.struct("_anc_depth", "_anc")).alias("_up"))
    )
    for c in (a, b):
        table = ups.select(F.col("node").alias(c), F.col("depth").alias(f"_{c}_d"), F.col("_up").alias(f"_{c}_up"))
        df = tax.lookup(df, table, c)
    deepest = F.array_max(F.array_intersect(f"_{a}_up", f"_{b}_up"))["_anc_depth"]
    return df.withColumn(
        out, similarity_from_depths(deepest, F.col(f"_{a}_d"), F.col(f"_{b}_d"))
    ).drop(f"_{a}_up", f"_{b}_up", f"_{a}_d", f"_{b}_d")


def covers(df: DataFrame, value: str, node: str, tax: Taxonomy, out: str = "covered") -> DataFrame:
    """Whether the node is the value itself or one of its ancestors."""
    up = tax.nodes.select(F.col("node").alias(value), F.col("ancestors").alias("_up"))
    return (
        tax.lookup(df, up, value, "left")
        .withColumn(out, F.coalesce(F.array_contains("_up", F.col(node)), F.col(node) == STAR, F.lit(False)))
        .drop("_up")
    )
