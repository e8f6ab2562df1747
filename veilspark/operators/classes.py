"""Full-domain generalisation, equivalence classes and k-anonymity by suppression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.cells import band, cell_text
from veilspark.functions.noise import uniform
from veilspark.operators.taxonomy import at_level
from veilspark.runtime import BROADCAST_ROWS, HOT_SHARE, by_shuffle, materialise, null_safe_join
from veilspark.spec import QI, STAR, names


def release_cells(df: DataFrame, qis: list[QI], keep: list[str]) -> DataFrame:
    """A raw table with every cell written as release text."""
    return df.select(*keep, *[cell_text(F.col(q.name), q).alias(q.name) for q in qis])


def generalise(df: DataFrame, qi: QI, level: int) -> DataFrame:
    """Replace a raw column by its generalisation at ``level``; unknown values are suppressed."""
    if level >= qi.top_level:
        return df.withColumn(qi.name, F.lit(STAR))
    if not qi.is_category:
        return df.withColumn(qi.name, band(F.col(qi.name).cast("double"), qi, level))
    if level == 0:
        return df.withColumn(qi.name, F.col(qi.name).cast("string"))
    nodes = at_level(qi.tax, level).select(F.col("leaf").alias(qi.name), F.col("node").alias("_node"))
    out = qi.tax.lookup(df, nodes, qi.name, "left")
    known = F.when(F.col(qi.name).isNotNull(), F.coalesce("_node", F.lit(STAR)))
    return out.withColumn(qi.name, known).drop("_node").select(*df.columns)


def generalise_all(df: DataFrame, qis: list[QI], levels: list[int]) -> DataFrame:
    """Generalise every attribute to its level of one lattice node."""
    return reduce(lambda d, ql: generalise(d, *ql), zip(qis, levels), df)


def suppress_all(df: DataFrame, qis: list[QI]) -> DataFrame:
    """The fully suppressed twin of a table."""
    return df.select(*[F.lit(STAR).alias(c) if c in names(qis) else F.col(c) for c in df.columns])


def all_suppressed(qis: list[QI]) -> Column:
    """True for a row whose every cell is ``*``."""
    return reduce(lambda a, b: a & b, [F.col(q.name).eqNullSafe(F.lit(STAR)) for q in qis])


def equivalence_classes(df: DataFrame, qis: list[QI], by: list[str] | None = None) -> DataFrame:
    """Rows per combination of cells; NULL is a value like any other."""
    return df.groupBy(*(by or []), *names(qis)).agg(F.count(F.lit(1)).alias("class_size"))


def suppress_small(df: DataFrame, qis: list[QI], k: int | Column, by: list[str] | None = None) -> DataFrame:
    """Rows of classes smaller than ``k`` become all ``*``; ``k`` is a number or made of columns in ``by``.

    The classes are written once and counted. When those below k are few they are broadcast and
    the rows never move. Otherwise the classes holding more than a fixed share of all rows, which
    are few by definition, keep their rows out of the shuffle, and the rest is joined by class.
    """
    keys = [*(by or []), *names(qis)]
    classes = materialise(equivalence_classes(df, qis, by))
    facts = classes.agg(
        F.coalesce(F.sum("class_size"), F.lit(0)).alias("rows"),
        F.count_if(F.col("class_size") < k).alias("small"),
    ).first()
    below = classes.filter(F.col("class_size") < k).select(*keys, F.lit(True).alias("_small"))
    if facts["small"] <= BROADCAST_ROWS:
        flagged = null_safe_join(df, F.broadcast(below), keys, "left")
    else:
        limit = F.greatest(F.lit(facts["rows"] // HOT_SHARE), (F.lit(k) if isinstance(k, int) else k) - 1)
        hot = F.broadcast(classes.filter(F.col("class_size") > limit).select(*keys))
        safe = null_safe_join(df, hot, keys, "left_semi").withColumn("_small", F.lit(None).cast("boolean"))
        rest = null_safe_join(df, hot, keys, "left_anti")
        flagged = safe.unionByName(null_safe_join(rest, by_shuffle(below), keys, "left"))
    return flagged.select(*[
        F.when(F.col("_small"), F.lit(STAR)).otherwise(F.col(c)).alias(c) if c in names(qis) else F.col(c)
        for c in df.columns
    ])


def k_anonymise(df: DataFrame, qis: list[QI], levels: list[int], k: int) -> DataFrame:
    """Generalise to one lattice node, then suppress the classes smaller than ``k``."""
    return suppress_small(generalise_all(df, qis, levels), qis, k)


def suppressed_share(df: DataFrame, qis: list[QI], by: list[str] | None = None) -> DataFrame:
    """Share of fully suppressed rows."""
    hit = F.avg(all_suppressed(qis).cast("double"))
    return df.groupBy(*(by or [])).agg(hit.alias("suppressed_share"))


def dp_sample(df: DataFrame, qis: list[QI], beta: float, seed: str, rid: str = "rid",
              parts: list[str] | None = None) -> DataFrame:
    """Keep each row with probability ``beta``; the others stay in place, fully suppressed."""
    u = uniform(seed, "sample", *[F.col(p) for p in parts or []], F.col(rid))
    keep = u < beta
    return df.select(*[
        F.when(keep, F.col(c)).otherwise(F.lit(STAR)).alias(c) if c in names(qis) else F.col(c)
        for c in df.columns
    ])
