"""Distance expressions between released cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.cells import is_range, range_hi, range_lo
from veilspark.spec import STAR


def numeric_distance(a: Column, b: Column) -> Column:
    """Signed difference of two numbers; with a range on either side, the width of the range
    (of the hull for two ranges)."""
    width_a = range_hi(a) - range_lo(a)
    width_b = range_hi(b) - range_lo(b)
    hull = F.greatest(range_hi(a), range_hi(b)) - F.least(range_lo(a), range_lo(b))
    return (
        F.when(is_range(a) & is_range(b), hull)
        .when(is_range(a), width_a)
        .when(is_range(b), width_b)
        .otherwise(range_lo(a) - range_lo(b))
    )


def semantic_from_sizes(common: Column, size_a: Column, size_b: Column) -> Column:
    """Log distance from the sizes of two ancestor sets and of their intersection."""
    union = size_a + size_b - common
    return F.log2(1 + (union - common) / union)


def similarity_from_depths(common_depth: Column, depth_a: Column, depth_b: Column) -> Column:
    """Path distance from the depths (root 1) of two nodes and their deepest common ancestor."""
    return 1 - 2 * common_depth / (depth_a + depth_b)


def ancestor_distance(anc_a: Column, anc_b: Column) -> Column:
    """Log distance of two nodes given their ancestor arrays, themselves included."""
    return semantic_from_sizes(
        F.size(F.array_intersect(anc_a, anc_b)), F.size(anc_a), F.size(anc_b)
    )


def cell_distance(a: Column, b: Column, within: Column) -> Column:
    """1 as soon as one side is suppressed, else the distance of the attribute's kind."""
    return F.when((a == STAR) | (b == STAR), F.lit(1.0)).otherwise(within)


def record_distance(cells: list[tuple[Column, Column, Column, float]]) -> Column:
    """Euclidean over attributes, each in units of its span; a suppressed cell adds 1.

    ``cells`` holds (a, b, distance, span) for each attribute.
    """
    return F.sqrt(sum((squared_term(*c) for c in cells), F.lit(0.0)))


def squared_term(a: Column, b: Column, within: Column, span: float) -> Column:
    ratio = within / F.lit(float(span))
    return F.when((a == STAR) | (b == STAR), F.lit(1.0)).otherwise(ratio * ratio)
