"""Declared quasi-identifiers. Bounds are public constants, never read from the data."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from veilspark.operators.taxonomy import Taxonomy

STAR = "*"


@dataclass(frozen=True)
class QI:
    """One quasi-identifier.

    ``kind`` is ``category`` (needs ``tax``), ``number``, or ``mixed``: text holding either a
    number or a ``lo_hi`` range. Numbers live on the grid ``lo, lo + 10^-decimals, .., hi`` and
    generalise through bands of the given ``widths``; one more level is ``*``.
    """

    name: str
    kind: str
    lo: float | None = None
    hi: float | None = None
    decimals: int = 0
    integer: bool = False
    widths: tuple[float, ...] = ()
    tax: "Taxonomy | None" = None

    def __post_init__(self):
        if self.kind not in ("category", "number", "mixed"):
            raise ValueError(f"unknown kind {self.kind!r} for {self.name}")
        if self.kind == "category" and self.tax is None:
            raise ValueError(f"{self.name} is a category and needs a taxonomy")
        if self.kind != "category" and (self.lo is None or self.hi is None):
            raise ValueError(f"{self.name} needs declared bounds")

    @property
    def is_category(self) -> bool:
        return self.kind == "category"

    @property
    def top_level(self) -> int:
        """Highest generalisation level, where every value is ``*``."""
        return self.tax.height if self.is_category else len(self.widths) + 1

    @property
    def grid_units(self) -> int:
        """Steps between the bounds."""
        return round((self.hi - self.lo) * 10**self.decimals)

    @property
    def domain_size(self) -> int:
        return self.tax.domain_size if self.is_category else self.grid_units + 1

    @property
    def span(self) -> float:
        """Distance between the two ends of the attribute, the unit of record distances."""
        return self.tax.boundary.distance if self.is_category else float(self.hi - self.lo)

    def renamed(self, name: str) -> "QI":
        return replace(self, name=name)


def names(qis: list[QI]) -> list[str]:
    return [q.name for q in qis]
