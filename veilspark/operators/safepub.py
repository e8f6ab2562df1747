"""(eps, delta)-differentially private release by sampling, generalisation and suppression."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.noise import fresh_seed, uniform
from veilspark.operators.classes import suppress_small
from veilspark.operators.lattice import SET, Scorer, Search, cells_at, dp_searches, frequency_set, with_paths
from veilspark.spec import QI, STAR, names


def search_budget(eps: float) -> float:
    """Share of eps spent on the search: 0.1, or a tenth of a small eps."""
    return eps / 10 if eps <= 0.1 else 0.1


def _upper_tail(n: int, p: float, above: int) -> float:
    """P[Binomial(n, p) > above]."""
    log_p, log_q = math.log(p), math.log1p(-p)
    base = math.lgamma(n + 1)
    return math.fsum(
        math.exp(base - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * log_p + (n - j) * log_q)
        for j in range(above + 1, n + 1))


@lru_cache(maxsize=None)
def class_size_for(eps: float, delta: float, search: float | None = None) -> int:
    """Smallest class size k that makes sampling plus k-anonymity (eps, delta)-private.

    Over table sizes n, the chance that a sampled class exceeds its expected share must stay
    within delta. The published values are one above the smallest such k.
    """
    e = eps - (search_budget(eps) if search is None else search)
    beta = 1 - math.exp(-e)
    gamma = (math.exp(e) - 1 + beta) / math.exp(e)

    def worst(k: int) -> float:
        start = max(math.ceil(k / gamma - 1), 1)
        return max(_upper_tail(n, beta, math.floor(gamma * n)) for n in range(start, start + 60))

    k = 2
    while worst(k) > delta:
        k += 1
    return k + 1


@dataclass(frozen=True)
class Release:
    """One release of a family: its name, budget, seed and the loss its search avoids."""

    name: str
    eps: float
    delta: float
    seed: str
    model: str = "granularity"

    @property
    def search(self) -> float:
        return search_budget(self.eps)

    @property
    def k(self) -> int:
        return class_size_for(self.eps, self.delta, self.search)

    @property
    def beta(self) -> float:
        """Share of rows sampled."""
        return 1 - math.exp(-(self.eps - self.search))


def safepub_family(df: DataFrame, qis: list[QI], releases: list[Release], steps: int = 300, rid: str = "rid") -> DataFrame:
    """All releases in one chain of jobs; column ``SET`` holds their names.

    The samples of all releases are counted in one scan, their searches run side by side, and the rows
    are generalised to each release's levels at once. Every release returns every row, generalised or
    fully suppressed.
    """
    spark, cells = df.sparkSession, names(qis)

    def sampled(rows: DataFrame) -> DataFrame:
        marks = spark.createDataFrame(
            [(r.name, r.seed, r.beta, r.k, levels.get(r.name)) for r in releases],
            f"{SET} string, _seed string, _beta double, _k int, _levels array<int>")
        # a release returns all rows, so rows meet the releases, which are a parameter list
        each = rows.crossJoin(F.broadcast(marks))
        return each.withColumn("_kept", uniform(F.col("_seed"), "sample", F.col(rid)) < F.col("_beta"))

    levels: dict[str, list[int]] = {}
    raw = df.select(rid, *cells)
    scorer = Scorer(frequency_set(sampled(raw).filter("_kept"), qis, [SET]), qis,
                    {r.name: r.k for r in releases}, {r.name: r.model for r in releases})
    levels = dp_searches(scorer, {r.name: Search(r.search, steps, r.seed) for r in releases})
    rows = sampled(with_paths(raw, qis))
    kept = rows.filter("_kept").select(SET, "_k", rid, *cells_at(qis, "_levels"))
    released = suppress_small(kept, qis, F.col("_k"), [SET, "_k"]).select(SET, rid, *cells)
    dropped = rows.filter("not _kept").select(SET, rid, *[F.lit(STAR).alias(c) for c in cells])
    return released.unionByName(dropped)


def safepub(
    df: DataFrame, qis: list[QI], eps: float, delta: float, model: str = "granularity", steps: int = 300,
    seed: str | None = None, rid: str = "rid",
) -> DataFrame:
    """One release: every input row comes back, generalised or fully suppressed."""
    one = Release("", eps, delta, fresh_seed(seed), model)
    return safepub_family(df, qis, [one], steps, rid).drop(SET)
