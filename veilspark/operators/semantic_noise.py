"""Noise on a categorical column in semantic space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.noise import fresh_seed, laplace, uniform
from veilspark.operators.marginality import (
    TIE_DIGITS, boundary_from_mean, categorical_mean, distance_variance, marginality_sample, normalised,
)
from veilspark.operators.ranks import nearest_numeric
from veilspark.operators.taxonomy import MATRIX_NODES, Taxonomy, similarity_distance
from veilspark.runtime import lookup, spread
from veilspark.spec import STAR

# Noise below this size leaves a value unchanged.
SKIP_BELOW = 0.01
# Up to so many values ride along as one array; more go through a sorted join, with the same result.
LIST_VALUES = 1_000


def nearest_by_marginality(df: DataFrame, target: str, margins: DataFrame, out: str = "nearest",
                           rows: int | None = None) -> DataFrame:
    """The value whose marginality is nearest to the number in ``target``; first in file order on
    ties. ``margins`` has value, leaf_ord, marginality. A NULL target has no nearest value.

    A short value list rides along as one array and the rows do not move; a long one goes through
    the sorted nearest-number join. Both compare gaps rounded alike.
    """
    clean = margins.select(F.round("marginality", TIE_DIGITS).alias("m"), "leaf_ord", "value")
    if (clean.count() if rows is None else rows) <= LIST_VALUES:
        options = clean.agg(F.collect_list(F.struct("m", "leaf_ord", "value")).alias("_options"))
        best = F.array_min(F.transform("_options", lambda o: F.struct(
            F.round(F.abs(o["m"] - F.col(target)), TIE_DIGITS).alias("d"),
            o["leaf_ord"].alias("o"), o["value"].alias("v"))))
        return df.join(F.broadcast(options)).withColumn(
            out, F.when(F.col(target).isNotNull(), best["v"])).drop("_options")
    first = clean.groupBy("m").agg(F.min_by("value", "leaf_ord").alias(out))
    near = nearest_numeric(
        df.select(F.col(target).alias("x")),
        clean.groupBy(F.col("m").alias("y")).agg(F.min("leaf_ord").alias("first_rid")))
    lookup = near.withColumnRenamed("nearest", "m").join(first, "m").select(F.col("x").alias(target), out)
    return df.join(lookup, target, "left")


def marginality_noise(df: DataFrame, col: str, tax: Taxonomy, level: float, seed: str | None = None,
                      normalise: bool = False, rid: str = "rid") -> DataFrame:
    """Map values to marginalities, add Laplace noise scaled by the marginality gap of the two
    ends of the column, and map back to the nearest value. Adds column ``noisy``. NULL and values
    outside the hierarchy become ``*``."""
    seed = fresh_seed(seed)
    margins = marginality_sample(df, col, tax, targets="leaves")
    if normalise:
        margins = normalised(margins)
    ends = boundary_from_mean(df, col, tax)
    side = lambda c: margins.select(F.col("value").alias(c), F.col("marginality").alias(f"_{c}"))
    gap = ends.join(side("bound1"), "bound1").join(side("bound2"), "bound2").agg(
        F.max(F.abs(F.col("_bound1") - F.col("_bound2"))).alias("_gap"))
    u = uniform(seed, "marginality", col, F.col(rid))
    own = margins.select(F.col("value").alias(col), F.col("marginality").alias("_m"))
    noisy = tax.lookup(df, own, col, "left").join(F.broadcast(gap)).withColumn(
        "_target", F.col("_m") + laplace(u, F.col("_gap") * F.lit(float(level))))
    near = nearest_by_marginality(noisy, "_target", margins, "noisy", tax.facts["rows"])
    return near.withColumn("noisy", F.coalesce("noisy", F.lit(STAR))).drop("_m", "_gap", "_target")


def _value_options(df: DataFrame, col: str, tax: Taxonomy, mean: DataFrame) -> DataFrame:
    """For every value of the column: its distance to the mean, and all leaves with their distance
    to the value and to the mean."""
    leaves = tax.nodes.filter("is_leaf").select(F.col("node").alias("leaf"), "leaf_ord")
    if tax.domain_size > MATRIX_NODES:
        raise ValueError(f"{tax.attr}: {tax.domain_size} leaves are too many to compare with every value")
    values = df.select(F.col(col).alias("value")).distinct()
    table = similarity_distance(values.join(tax.hint(leaves)), "value", "leaf", tax, "d")
    of_mean = similarity_distance(leaves.join(F.broadcast(mean)), "leaf", "mean", tax, "dm")
    own = similarity_distance(values.join(F.broadcast(mean)), "value", "mean", tax, "mean_d")
    d, dm = F.round("d", 12).alias("d"), F.round("dm", 12).alias("dm")
    return (
        table.join(tax.hint(of_mean.select("leaf", "dm")), "leaf")
        .groupBy("value").agg(F.array_sort(F.collect_list(F.struct(d, dm, "leaf_ord", "leaf"))).alias("_leaves"))
        .join(own.select("value", "mean", F.round("mean_d", 12).alias("_mean_d")), "value")
    )


def semantic_noise(df: DataFrame, col: str, tax: Taxonomy, level: float, seed: str | None = None,
                   skip: str = "abs", rid: str = "rid") -> DataFrame:
    """Directional noise e ~ Laplace(0, variance * level) in path distance. Adds ``noisy``.

    Candidates are the leaves at distance >= |e|. Without one, the farthest leaf is taken. Noise
    below 0.01 changes nothing; with ``skip='signed'`` every negative e counts as below. The mean
    value moves to the closest candidate. Otherwise e > 0 takes the closest candidate farther from
    the mean than the value, else the farthest candidate; e < 0 the closest candidate nearer to
    the mean, else the closest candidate. Ties are drawn with the seed. NULL and values outside the
    hierarchy become ``*``.
    """
    if skip not in ("abs", "signed"):
        raise ValueError("skip must be 'abs' or 'signed'")
    seed = fresh_seed(seed)
    mean = categorical_mean(df, col, tax, dist="similarity", targets="nodes")
    scale = distance_variance(df, col, tax, targets="nodes")
    options = _value_options(df, col, tax, mean).withColumnRenamed("value", col)
    e = F.col("_e")
    # every row of options holds all leaves
    rows = lookup(spread(df, rid), options, [col], tax.facts["rows"] * tax.domain_size, "left").join(F.broadcast(scale)).withColumn(
        "_e", laplace(uniform(seed, "semantic", col, F.col(rid)), F.col("variance") * F.lit(float(level))))
    tie = uniform(seed, "semantic tie", col, F.col(rid))

    def pick(leaves: Column, nearest: bool) -> Column:
        ds = F.transform(leaves, lambda s: s["d"])
        edge = F.array_min(ds) if nearest else F.array_max(ds)
        tied = F.filter(leaves, lambda s: s["d"] == edge)
        return F.try_element_at(tied, (F.floor(tie * F.size(tied)) + 1).cast("int"))["leaf"]

    rows = rows.withColumn("_near", F.filter("_leaves", lambda s: s["d"] >= F.abs(e)))
    farther = F.filter("_near", lambda s: s["dm"] > F.col("_mean_d"))
    closer = F.filter("_near", lambda s: s["dm"] < F.col("_mean_d"))
    unchanged = (F.abs(e) if skip == "abs" else e) < SKIP_BELOW
    noisy = (
        F.when(F.col("_leaves").isNull(), F.lit(STAR))
        .when(F.size("_near") == 0, pick(F.col("_leaves"), False))
        .when(unchanged, F.col(col))
        .when(F.col(col) == F.col("mean"), pick(F.col("_near"), True))
        .when(e > 0, F.coalesce(pick(farther, True), pick(F.col("_near"), False)))
        .otherwise(F.coalesce(pick(closer, True), pick(F.col("_near"), True)))
    )
    return rows.withColumn("noisy", noisy).select(*df.columns, "noisy")
