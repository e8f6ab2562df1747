"""Cluster centroids, noise, and the end-to-end microaggregation release."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.cells import is_range, number_text, round_clamp
from veilspark.functions.noise import fresh_seed, gumbel, laplace, uniform
from veilspark.operators.marginality import categorical_mean, least_marginal, marginality, value_counts
from veilspark.operators.microaggregation import microaggregate, microaggregate_each
from veilspark.operators.taxonomy import leaf_domain
from veilspark.runtime import by_shuffle, materialise, spread
from veilspark.sources.tables import attach_grid
from veilspark.spec import QI, STAR, names

# Values of a domain up to which a cluster is drawn for in one task.
TASK_DOMAIN = 10_000


def numeric_centroid(df: DataFrame, col: str, by: list[str] = ["cluster_id"]) -> DataFrame:
    """Mean of a numeric attribute per cluster."""
    return df.groupBy(*by).agg(F.avg(F.col(col).cast("double")).alias("centroid"))


def _mixed_centroid(col: str) -> Column:
    text = F.col(col)
    ranges = F.count_if(is_range(text))
    number = F.avg(F.when(~is_range(text), text.try_cast("double")))
    return F.when(ranges > F.count(text) / 2, F.max_by(text, is_range(text))).otherwise(
        number_text_1(number))


def number_text_1(value: Column) -> Column:
    """A mean rounded half-even to one decimal, as text."""
    return number_text(F.bround(value, 1), 1)


def mixed_centroid(df: DataFrame, col: str, by: list[str] = ["cluster_id"]) -> DataFrame:
    """The range if it holds more than half of the cluster, else the mean of the numbers to one
    decimal."""
    return df.groupBy(*by).agg(_mixed_centroid(col).alias("centroid"))


def categorical_centroid(df: DataFrame, qi: QI, by: list[str] = ["cluster_id"]) -> DataFrame:
    """The value of the cluster with the least marginality."""
    return categorical_mean(df, qi.name, qi.tax, by).withColumnRenamed("mean", "centroid")


def dp_categorical_centroid(
    df: DataFrame, qi: QI, eps: list[float] | float, n: int, k: int, seed: str, by: list[str] = ["cluster_id"],
    iterations: list[int] | None = None,
) -> DataFrame:
    """A domain value drawn per cluster with weight exp(-eps * marginality / (2 (n / k) span)).

    The draw is the argmax of the exponent plus Gumbel noise. One call can draw for a whole grid of
    ``eps`` values and iterations over the same marginalities.
    """
    return _dp_centroid(value_counts(df, qi.name, by), qi, eps, n, k, seed, by, iterations)


def _number(k: Column | int | float) -> Column:
    return k if isinstance(k, Column) else F.lit(k)


def _dp_centroid(counts, qi, eps, n, k, seed, by, iterations=None) -> DataFrame:
    single = not isinstance(eps, list)
    # counted zero times, so that a cluster without a known value draws from the whole domain
    some = leaf_domain(qi.tax).agg(F.min_by("leaf", "leaf_ord").alias("value"))
    none = counts.select(*by).distinct().join(F.broadcast(some)).withColumn("n", F.lit(0).cast("bigint"))
    counts = counts.select(*by, "value", "n").unionByName(none)
    if qi.tax.domain_size <= TASK_DOMAIN:
        # few bytes, which the whole domain multiplies: dealt by cluster once, over all shuffle partitions
        counts = spread(counts, *by)
    margins = marginality(counts, qi.tax, by, targets="domain")
    grid = attach_grid(margins, eps=[float(eps)] if single else eps, iteration=iterations or [1])
    logit = -F.col("eps") * F.col("marginality") / (2 * (F.lit(float(n)) / _number(k)) * qi.span)
    u = uniform(seed, "centroid", qi.name, F.col("eps"), F.col("iteration"),
                *[F.col(b) for b in by], F.col("value"))
    out = grid.groupBy(*by, "eps", "iteration").agg(F.max_by("value", logit + gumbel(u)).alias("centroid"))
    return out.drop("eps", "iteration") if single else out


def centroid_table(
    df: DataFrame, clusters: DataFrame, qis: list[QI], dp: bool = False, eps: list[float] | None = None,
    n: int | None = None, k: Column | int | None = None, seed: str = "", iterations: list[int] | None = None,
    rid: str = "rid", by: list[str] = ["cluster_id"],
) -> DataFrame:
    """One row per cluster with the centroid of every attribute; with ``dp``, one per cluster,
    eps and iteration, categories drawn by the exponential mechanism.

    Rows meet their clusters once: categories are reduced to counts per cluster and value there. A
    cluster whose values are all NULL or outside the hierarchy gets ``*``; with ``dp`` it draws from
    the whole domain alike.
    """
    members = df.select(rid, *names(qis)).join(by_shuffle(clusters), rid)
    categories = [q for q in qis if q.is_category]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for q in qis:
        if q.kind == "number":
            aggs.append(F.avg(F.col(q.name).cast("double")).alias(q.name))
        elif q.kind == "mixed":
            aggs.append(_mixed_centroid(q.name).alias(q.name))
    out = members.groupBy(*by).agg(*aggs).drop("_n")
    if dp:
        out = attach_grid(out, eps=eps, iteration=iterations or [1])
    if categories:
        cells = F.explode(F.array(*[
            F.struct(F.lit(q.name).alias("attr"), F.col(q.name).alias("value")) for q in categories
        ])).alias("_c")
        counted = materialise(
            members.select(*by, cells).select(*by, "_c.*").groupBy(*by, "attr", "value")
            .agg(F.count(F.lit(1)).alias("n")))
    for q in categories:
        mine = counted.filter(F.col("attr") == q.name).drop("attr")
        if dp:
            one = _dp_centroid(mine, q, eps, n, k, seed, by, iterations)
        else:
            one = least_marginal(marginality(mine, q.tax, by), by).withColumnRenamed("mean", "centroid")
        keys = [*by, "eps", "iteration"] if dp else by
        out = out.join(one.withColumnRenamed("centroid", q.name), keys, "left").withColumn(
            q.name, F.coalesce(q.name, F.lit(STAR)))
    lead = [*by, "eps", "iteration"] if dp else by
    return out.select(*lead, *names(qis))


def apply_centroids(clusters: DataFrame, centroids: DataFrame, rid: str = "rid",
                    by: list[str] = ["cluster_id"]) -> DataFrame:
    """Replace every row by the centroid of its cluster. Clusters have fewer than 2k rows, so no
    key is hot. They are dealt over all shuffle partitions, for the noise that each row is given after."""
    return by_shuffle(spread(clusters.select(rid, *by), *by)).join(centroids, by).drop("cluster_id")


def noise_scale(qi: QI, eps: Column | float, k: Column | int, n: int | None = None, sensitivity: str = "per_cluster"):
    """Laplace scale of one numeric attribute.

    ``per_cluster``: range / (eps k). ``all_clusters``: times n / k, for the sum of the
    sensitivities of all centroids.
    """
    if sensitivity not in ("per_cluster", "all_clusters"):
        raise ValueError(f"unknown sensitivity {sensitivity!r}")
    width = F.lit(float(qi.hi - qi.lo))
    if sensitivity == "all_clusters" and n:
        width = width * (F.lit(float(n)) / _number(k))
    return width / (F.lit(eps) if isinstance(eps, float) else eps) / _number(k)


def sanitise(
    df: DataFrame, qis: list[QI], eps: Column | float, k: Column | int, seed: str, rid: str = "rid",
    parts: list[str] | None = None, n: int | None = None, sensitivity: str = "per_cluster",
) -> DataFrame:
    """Laplace noise on every numeric attribute, rounded and clamped to the public bounds, as
    release text. Ranges and categories stay. ``parts`` are columns, such as eps and iteration,
    that make draws differ: equal draws under two scales would give the value away."""
    cols = {}
    for q in qis:
        if q.is_category:
            cols[q.name] = F.col(q.name).cast("string")
            continue
        u = uniform(seed, "laplace", q.name, *[F.col(p) for p in parts or []], F.col(rid))
        noise = laplace(u, noise_scale(q, eps, k, n, sensitivity))
        value = F.col(q.name).cast("double") if q.kind == "number" else F.col(q.name).try_cast("double")
        noisy = number_text(round_clamp(value, noise, q), q.decimals)
        cols[q.name] = noisy if q.kind == "number" else F.when(is_range(F.col(q.name)), F.col(q.name)).otherwise(noisy)
    return df.select(*[cols.get(c, F.col(c)).alias(c) for c in df.columns])


def total_budget(qis: list[QI], eps: float, budget: str = "per_attribute") -> tuple[float, float]:
    """(eps spent on each attribute, eps of the whole release)."""
    if budget == "per_attribute":
        return eps, eps * len(qis)
    if budget == "split":
        return eps / len(qis), eps
    raise ValueError(f"unknown budget {budget!r}")


def microdp_sweep(
    df: DataFrame, qis: list[QI], eps: list[float], k: int | list[int], seed: str | None, iterations: int = 1,
    strategy: str = "batched", budget: str = "per_attribute", sensitivity: str = "per_cluster",
    clusters: DataFrame | None = None, rid: str = "rid",
) -> DataFrame:
    """Releases for every eps and iteration in one job: clusters are built once, centroids and
    noise run over the grid. Columns ``eps``, ``iteration``, ``total_eps``, ``rid`` and the cells.

    With a list of ``k`` the releases of every k come from the same jobs, with a column ``k``.
    """
    seed = fresh_seed(seed)
    n = df.count()
    many = isinstance(k, list)
    if clusters is None:
        clusters = materialise(microaggregate_each(df, qis, k, strategy, rid, n) if many
                               else microaggregate(df, qis, k, strategy, rid, n))
    lead = ["k"] if many else []
    size, by = F.col("k") if many else k, [*lead, "cluster_id"]
    spend = {e: total_budget(qis, e, budget) for e in eps}
    rounds = list(range(1, iterations + 1))
    centroids = centroid_table(
        df, clusters, qis, True, [spend[e][0] for e in eps], n, size, seed, rounds, rid, by)
    rows = apply_centroids(clusters, centroids, rid, by)
    noisy = sanitise(rows, qis, F.col("eps"), size, seed, rid, ["eps", "iteration", *lead], n, sensitivity)
    given = reduce(lambda c, e: F.when(F.col("eps") == spend[e][0], F.lit(e)).otherwise(c), eps, F.lit(None).cast("double"))
    total = F.col("eps") * len(qis)
    return noisy.select(*lead, given.alias("eps"), "iteration", total.alias("total_eps"), rid, *names(qis))


def microdp(
    df: DataFrame, qis: list[QI], eps: float, k: int, seed: str | None = None, strategy: str = "batched",
    budget: str = "per_attribute", sensitivity: str = "per_cluster", rid: str = "rid",
) -> DataFrame:
    """One differentially private release by microaggregation."""
    return microdp_sweep(df, qis, [eps], k, seed, 1, strategy, budget, sensitivity, rid=rid).drop(
        "eps", "iteration", "total_eps")
