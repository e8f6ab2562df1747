"""Column expressions on released cells: numbers, ``lo_hi`` ranges and ``*``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.spec import QI, STAR


def number_text(value: Column, decimals: int) -> Column:
    """A number as text with fixed decimals."""
    kind = "bigint" if decimals == 0 else f"decimal(18,{decimals})"
    value = F.round(value, 0) if decimals == 0 else value
    return value.cast(kind).cast("string")


def cell_text(col: Column, qi: QI) -> Column:
    """A raw cell as it appears in a release."""
    return number_text(col.cast("double"), qi.decimals) if qi.kind == "number" else col.cast("string")


def range_lo(text: Column) -> Column:
    return F.split(text, "_").getItem(0).try_cast("double")


def range_hi(text: Column) -> Column:
    return F.element_at(F.split(text, "_"), -1).try_cast("double")


def is_range(text: Column) -> Column:
    return text.contains("_")


def contains_number(value: Column, text: Column) -> Column:
    """Number inside a range, ends included; a single number contains only itself."""
    return (text == STAR) | value.between(range_lo(text), range_hi(text))


def contains_range(inner: Column, outer: Column) -> Column:
    """Both ends of ``inner`` inside ``outer``."""
    return contains_number(range_lo(inner), outer) & contains_number(range_hi(inner), outer)


def _band_index(value: Column, qi: QI, level: int) -> tuple[Column, int, int]:
    """(band of a number at a level that has bands, grid steps in a band, number of the last band)."""
    width = round(qi.widths[level - 1] * 10**qi.decimals)
    last = max(1, round(qi.grid_units / width)) - 1
    units = F.round((value - F.lit(float(qi.lo))) * 10**qi.decimals).cast("bigint")
    return F.least(F.greatest(F.floor(units / width), F.lit(0)), F.lit(last)).cast("bigint"), width, last


def band(value: Column, qi: QI, level: int) -> Column:
    """A number generalised to ``level``: itself, a band, or ``*``."""
    if level <= 0:
        return number_text(value, qi.decimals)
    if level >= qi.top_level:
        return F.lit(STAR)
    index, width, last = _band_index(value, qi, level)
    scale, base = 10**qi.decimals, round(qi.lo * 10**qi.decimals)
    start = index * width + base
    end = F.when(index == last, F.lit(base + qi.grid_units)).otherwise(start + (width - 1))
    return F.concat_ws("_", number_text(start / scale, qi.decimals), number_text(end / scale, qi.decimals))


def band_code(value: Column, qi: QI, level: int) -> Column:
    """A whole number that tells the cells of a level apart just as their text, ``band``, does."""
    if level >= qi.top_level:
        return F.lit(0).cast("bigint")
    if level > 0:
        return _band_index(value, qi, level)[0]
    if qi.decimals == 0:
        return F.round(value, 0).cast("bigint")
    return (value.cast(f"decimal(18,{qi.decimals})") * F.lit(10**qi.decimals)).cast("bigint")


def code_leaves(qi: QI, level: int) -> tuple[int, int | None, int]:
    """(grid values a cell of a level covers, the code of the last band, grid values that one covers)."""
    if level >= qi.top_level:
        return qi.domain_size, None, qi.domain_size
    if level <= 0:
        return 1, None, 1
    _, width, last = _band_index(F.lit(0.0), qi, level)
    return width, last, qi.grid_units - last * width + 1


def grid_leaves(text: Column, qi: QI) -> Column:
    """How many grid values a numeric cell covers; ``*`` covers the whole domain."""
    width = F.round((range_hi(text) - range_lo(text)) * 10**qi.decimals).cast("bigint") + 1
    return F.when(text == STAR, F.lit(qi.domain_size)).otherwise(width)


def round_clamp(value: Column, noise: Column, qi: QI) -> Column:
    """Noisy value on the grid of the attribute, half-even, kept inside the public bounds.

    Integers round value and noise separately before adding. NULL stays NULL.
    """
    if qi.integer:
        total = F.bround(noise, 0) + F.bround(value, 0)
    else:
        total = F.bround(value + noise, qi.decimals)
    inside = F.least(F.greatest(total, F.lit(float(qi.lo))), F.lit(float(qi.hi)))
    return F.when(total.isNotNull(), inside)


def normalise(value: Column, lo: Column, hi: Column) -> Column:
    """Min-max scaling; NULL on an empty range."""
    return F.try_divide(value - lo, hi - lo)
