"""Marginality of category values, without ever forming value pairs.

The marginality of v is the sum of d(v, v') over a sample. d depends on v' only through its depth
and the number i of shared ancestors. If one of the two has a single path to the root, its shared
ancestors are the first i nodes of that path, so

    sum over v' of g(i) = sum over ancestors a of v, and depths, of
                          count(v' below a) * (g(depth(a)) - g(depth(a) - 1)),  g(0) = 0

and one equi-join on ancestors with one aggregate gives it in time linear in the values. Only pairs
in which both values have several paths are compared directly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.cells import normalise
from veilspark.functions.distance import ancestor_distance, semantic_from_sizes, similarity_from_depths
from veilspark.operators.taxonomy import (
    Taxonomy, leaf_domain, semantic_distance, similarity_distance,
)
from veilspark.runtime import HOT_SHARE, materialise, shuffle_partitions

# Marginalities are rounded here before values are compared, so that equal sums tie.
TIE_DIGITS = 9


def _shared(dist: str, i: Column, a: str, b: str) -> Column:
    """Distance of two values sharing ``i`` ancestors; 0 for i = 0 by convention."""
    if dist == "semantic":
        value = semantic_from_sizes(i, F.col(f"size_{a}"), F.col(f"size_{b}"))
    elif dist == "similarity":
        value = similarity_from_depths(i, F.col(f"depth_{a}"), F.col(f"depth_{b}"))
    else:
        raise ValueError("dist must be 'semantic' or 'similarity'")
    return F.when(i <= 0, F.lit(0.0)).otherwise(value)


def marginality(
    counts: DataFrame, tax: Taxonomy, by: list[str] | None = None, dist: str = "semantic",
    targets: str = "sample",
) -> DataFrame:
    """Marginality against a counted sample.

    ``counts`` has ``by``, ``value`` and ``n``. ``targets`` says which values get a marginality
    in each group: those of the sample, the ``domain``, all ``leaves``, or all ``nodes``. NULL and
    values outside the hierarchy have no distance: they count for nothing and get no marginality.
    """
    by = by or []
    table = tax.nodes
    sample = table.select(
        F.col("node").alias("value"), F.col("ancestors").alias("up_b"), F.col("size").alias("size_b"),
        F.col("depth").alias("depth_b"), F.col("single").alias("single_b"))
    placed = tax.lookup(counts, sample, "value")
    shape = ["size_b", "depth_b", "single_b"]
    below = placed.select(*by, F.explode("up_b").alias("anc"), *shape, "n").groupBy(*by, "anc", *shape).agg(
        F.sum("n").alias("n"))

    goal = table.select(
        F.col("node").alias("value"), "leaf_ord", F.col("ancestors").alias("up_a"),
        F.col("size").alias("size_a"), F.col("depth").alias("depth_a"), F.col("single").alias("single_a"),
        "is_leaf")
    if targets == "domain":
        goal = goal.join(leaf_domain(tax).select(F.col("leaf").alias("value")), "value", "left_semi")
    elif targets == "leaves":
        goal = goal.filter("is_leaf")
    elif targets not in ("sample", "nodes"):
        raise ValueError(f"unknown targets {targets!r}")
    goal = goal.drop("is_leaf")

    node_depth = table.select(F.col("node").alias("anc"), F.col("depth").alias("at"))
    step = _shared(dist, F.col("at"), "a", "b") - _shared(dist, F.col("at") - 1, "a", "b")
    # where one side has one path, every shared ancestor has one path too
    chained = F.col("single_a") | F.col("single_b")
    facts = ["value", "leaf_ord", "size_a", "depth_a", "single_a"]
    if targets == "sample":
        goal = tax.lookup(counts.select(*by, "value").distinct(), goal, "value")
    up = goal.select(*(by if targets == "sample" else []), *facts, F.explode("up_a").alias("anc"))
    keys = [*by, "anc"] if targets == "sample" else ["anc"]
    if tax.is_small:
        steps = up.join(below, keys) if targets == "sample" else below.join(F.broadcast(up), keys)
    else:
        # all values have the root in common: the widest ancestors must not meet in one task
        wide = F.broadcast(table.filter(F.col("n_leaves") > tax.domain_size // HOT_SHARE).select(F.col("node").alias("anc")))
        near, hot = below.join(wide, "anc", "left_semi"), up.join(wide, "anc", "left_semi")
        if by:
            salts = shuffle_partitions(up.sparkSession)
            hot = hot.withColumn("_salt", F.pmod(F.xxhash64("value"), F.lit(salts)).cast("int"))
            near = near.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            hot = hot.join(near, [*keys, "_salt"]).drop("_salt")
        else:
            # one row per wide ancestor and depth: at most HOT_SHARE ancestors on each level
            hot = hot.join(F.broadcast(near), keys)
        cold = up.join(wide, "anc", "left_anti").join(below.join(wide, "anc", "left_anti"), keys)
        steps = hot.unionByName(cold)
    sums = (
        tax.lookup(steps, node_depth, "anc")
        .groupBy(*by, "value", "leaf_ord")
        .agg(F.sum(F.when(chained, F.col("n") * step).otherwise(0.0)).alias("marginality"))
    )
    if not tax.has_shared_values:
        return sums
    return _add_shared_pairs(sums, placed, goal, by, dist, targets, tax)


def _add_shared_pairs(sums, placed, goal, by, dist, targets, tax) -> DataFrame:
    """Terms of the pairs in which both values have several paths."""
    many_b = placed.filter(~F.col("single_b")).select(
        *by, F.col("value").alias("other"), "up_b", "size_b", "depth_b", "n")
    many_a = goal.filter(~F.col("single_a")).select(
        *(by if targets == "sample" else []), "value", "up_a", "size_a", "depth_a")
    # both sides share the root, so match on it through the group; several-path values are rare
    pairs = many_b.join(many_a, by) if targets == "sample" and by else many_b.join(tax.hint(many_a))
    if dist == "semantic":
        pairs = pairs.withColumn("d", ancestor_distance(F.col("up_a"), F.col("up_b")))
    else:
        pairs = similarity_distance(pairs, "value", "other", tax, "d")
    extra = pairs.groupBy(*by, "value").agg(F.sum(F.col("n") * F.col("d")).alias("_extra"))
    return sums.join(extra, [*by, "value"], "left").withColumn(
        "marginality", F.col("marginality") + F.coalesce("_extra", F.lit(0.0))).drop("_extra")


def value_counts(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """Counted values of a column, the sample form of the marginality. Written once: the rows are
    scanned a single time however often the counts are joined."""
    return materialise(df.groupBy(*(by or []), F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n")))


def marginality_domain(tax: Taxonomy) -> DataFrame:
    """Marginality of every domain value against the domain itself."""
    domain = leaf_domain(tax).select(F.col("leaf").alias("value"), F.lit(1).alias("n"))
    return marginality(domain, tax, targets="domain")


def marginality_sample(
    df: DataFrame, col: str, tax: Taxonomy, by: list[str] | None = None, dist: str = "semantic",
    targets: str = "sample",
) -> DataFrame:
    """Marginality against a column, optionally within groups."""
    return marginality(value_counts(df, col, by), tax, by, dist, targets)


def least_marginal(margins: DataFrame, by: list[str]) -> DataFrame:
    """The value of least marginality per group; ties go to the first in file order."""
    key = F.struct(F.round("marginality", TIE_DIGITS), "leaf_ord")
    return margins.groupBy(*by).agg(F.min_by("value", key).alias("mean"))


def categorical_mean(
    df: DataFrame, col: str, tax: Taxonomy, by: list[str] | None = None, dist: str = "semantic",
    targets: str = "sample",
) -> DataFrame:
    """The value with the least marginality; ties go to the first in file order."""
    return least_marginal(marginality_sample(df, col, tax, by, dist, targets), by or [])


def _farthest(tax: Taxonomy, values: DataFrame, origin: DataFrame) -> DataFrame:
    """Value farthest from the one-row ``origin``; the first in file order on ties."""
    far = semantic_distance(values.join(F.broadcast(origin)), "value", "origin", tax)
    return far.agg(
        F.min_by(F.struct("value", "distance"),
                 F.struct(-F.round("distance", TIE_DIGITS), F.col("leaf_ord"))).alias("_far"),
    ).select("_far.value", "_far.distance")


def boundary(tax: Taxonomy) -> DataFrame:
    """The two public ends of the attribute: ``bottom``, ``top``, ``distance``.

    Numbers: least and greatest value of the hierarchy. Categories: the value with the largest
    marginality over the domain, and the value farthest from it.
    """
    if tax.is_numeric:
        num = F.col("leaf").try_cast("double")
        domain = leaf_domain(tax)
        return domain.agg(
            F.min_by("leaf", num).alias("bottom"), F.max_by("leaf", num).alias("top"),
            (F.max(num) - F.min(num)).alias("distance"))
    margins = marginality_domain(tax)
    top = margins.agg(
        F.min_by("value", F.struct(-F.round("marginality", TIE_DIGITS), F.col("leaf_ord"))).alias("origin"))
    bottom = _farthest(tax, leaf_domain(tax).withColumnRenamed("leaf", "value"), top)
    return bottom.join(top).select(
        F.col("value").alias("bottom"), F.col("origin").alias("top"), "distance")


def boundary_from_mean(df: DataFrame, col: str, tax: Taxonomy) -> DataFrame:
    """``mean`` of the column, the leaf farthest from it, and the leaf farthest from that."""
    margins = marginality_sample(df, col, tax, targets="leaves")
    leaves = tax.nodes.filter("is_leaf").select(F.col("node").alias("value"), "leaf_ord")
    mean = least_marginal(margins, []).withColumnRenamed("mean", "origin")
    bound1 = _farthest(tax, leaves, mean).select(F.col("value").alias("origin"))
    bound2 = _farthest(tax, leaves, bound1)
    return (
        mean.withColumnRenamed("origin", "mean")
        .join(bound1.withColumnRenamed("origin", "bound1"))
        .join(bound2.select(F.col("value").alias("bound2")))
    )


def marginality_variance(df: DataFrame, col: str, tax: Taxonomy, dist: str = "semantic") -> DataFrame:
    """Mean marginality of the rows."""
    counts = value_counts(df, col)
    margins = marginality(counts, tax, dist=dist)
    return margins.join(counts, "value").agg(
        (F.sum(F.col("n") * F.col("marginality")) / F.sum("n")).alias("variance"))


def distance_variance(df: DataFrame, col: str, tax: Taxonomy, targets: str = "leaves") -> DataFrame:
    """Mean squared path distance of the rows to the mean value of the column."""
    counts = value_counts(df, col)
    mean = least_marginal(marginality(counts, tax, dist="similarity", targets=targets), [])
    far = similarity_distance(counts.join(F.broadcast(mean)), "value", "mean", tax)
    return far.agg((F.sum(F.col("n") * F.pow("distance", F.lit(2))) / F.sum("n")).alias("variance"))


def variance_distance(pairs: DataFrame, df: DataFrame, taxes: dict[str, Taxonomy], rid: str) -> DataFrame:
    """Record distance as the mean over attributes of pair variance / column variance.

    ``pairs`` holds ``rid`` and columns ``<attr>_a``, ``<attr>_b``. Each attribute uses its own
    marginalities.
    """
    out, terms = pairs, []
    for attr, tax in taxes.items():
        counts = value_counts(df, attr)
        margins = marginality(counts, tax)
        total = margins.join(counts, "value").agg(
            (F.sum(F.col("n") * F.col("marginality")) / F.sum("n")).alias(f"_{attr}_total"))
        for side in ("a", "b"):
            lookup = margins.select(F.col("value").alias(f"{attr}_{side}"),
                                    F.col("marginality").alias(f"_{attr}_{side}"))
            out = tax.lookup(out, lookup, f"{attr}_{side}")
        out = out.join(F.broadcast(total))
        local = (F.col(f"_{attr}_a") + F.col(f"_{attr}_b")) / 2
        terms.append(F.try_divide(local, F.col(f"_{attr}_total")))
    return out.select(rid, (sum(terms) / len(terms)).alias("distance"))


def normalised(margins: DataFrame) -> DataFrame:
    """Marginalities scaled to 0..1."""
    ends = margins.agg(F.min("marginality").alias("_lo"), F.max("marginality").alias("_hi"))
    return margins.join(F.broadcast(ends)).withColumn(
        "marginality", normalise(F.col("marginality"), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
