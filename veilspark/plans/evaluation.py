"""Scoring, normalising and comparing the releases of a sweep.

Scores are long tables: release keys, ``metric``, ``score``. One job scores all releases.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.cells import normalise
from veilspark.operators.classes import all_suppressed, release_cells
from veilspark.operators.metrics import METRICS, PENALISED, cell_counts, compute_metrics, plain_sums, scale_of
from veilspark.spec import QI, STAR, names

KEYS = ["model", "param", "iteration"]


def k_column(k_of: int | dict[float, int] | Column, by: str = "param") -> Column:
    """k of a release: one number, a number per parameter value, or a column over the release keys."""
    if isinstance(k_of, Column):
        return k_of
    if isinstance(k_of, int):
        return F.lit(k_of)
    out = F.lit(None).cast("int")
    for value, k in k_of.items():
        out = F.when(F.col(by) == value, F.lit(k)).otherwise(out)
    return out


def score_releases(releases: DataFrame, raw: DataFrame, qis: list[QI], metrics: list[str],
                   k_of: int | dict[float, int] | Column = 1, by: list[str] = KEYS) -> DataFrame:
    """Every metric of every release, with its ``k``."""
    k = k_column(k_of)
    return compute_metrics(metrics, releases, qis, k, raw, by).withColumn("k", k)


def mean_metrics(scores: DataFrame, by: str = "model") -> DataFrame:
    """Cross table: mean of every metric for each ``by`` (the metric a release optimised)."""
    return scores.groupBy(by).pivot("metric", list(METRICS)).agg(F.avg("score"))


def mean_by_iterations(scores: DataFrame, counts: list[int], by: list[str] = ["model", "param"]) -> DataFrame:
    """Mean score over the first c iterations, for each c."""
    each = scores.withColumn("iterations", F.explode(F.array(*[F.lit(c) for c in counts])))
    return each.filter(F.col("iteration") <= F.col("iterations")).groupBy(*by, "metric", "iterations").agg(
        F.avg("score").alias("mean_score"))


def reference_scores(raw: DataFrame, qis: list[QI], metrics: list[str], ks: list[int]) -> DataFrame:
    """Scores of the raw table (``original``) and of its fully suppressed twin (``suppressed``) for
    every k: the sums are computed once, k only divides them."""
    m = len(qis)
    cells = release_cells(raw, qis, [])
    plain = [x for x in metrics if x in PENALISED or x == "groupsize"]
    sums = plain_sums(cells, qis, plain or ["discernibility"])
    rows = F.col("n_rows")
    # sums of a table in which every cell is ``*`` follow from its row count
    gone = {"granularity": rows * m, "intensity": rows * m, "discernibility": rows * rows,
            "entropy": rows * rows * m, "groupsize": F.lit(1), "sse": rows * m}
    kept = {x: F.col(x) for x in plain} | {"sse": F.lit(0.0)}
    cells_of = []
    for k in ks:
        for x in metrics:
            if x == "record_linkage":
                continue
            scale = scale_of(x, F.lit(k), rows, m)
            for reference, values in (("original", kept), ("suppressed", gone)):
                cells_of.append(F.struct(
                    F.lit(reference).alias("reference"), F.lit(k).alias("k"), F.lit(x).alias("metric"),
                    (values[x].cast("double") / scale).alias("score")))
    return sums.select(F.inline(F.array(*cells_of)))


def append_reference(previous: DataFrame, new: DataFrame) -> DataFrame:
    """Add reference scores of new ks; a k already present keeps its old rows."""
    keys = [c for c in ("subset", "reference", "k", "metric") if c in previous.columns]
    fresh = new.join(previous.select(*keys), keys, "left_anti")
    return previous.unionByName(fresh)


def reference_scores_by_subset(raw: DataFrame, qis: list[QI], metrics: list[str], ks: list[int],
                               subsets: list[list[str]]) -> DataFrame:
    """Reference scores of every attribute subset, tagged with the subset's name."""
    parts = []
    for attrs in subsets:
        chosen = [q for q in qis if q.name in attrs]
        scores = reference_scores(raw.select(*names(chosen)), chosen, metrics, ks)
        parts.append(scores.select(F.lit("-".join(attrs)).alias("subset"), "*"))
    return reduce(DataFrame.unionByName, parts)


def normalise_scores(scores: DataFrame, reference: DataFrame) -> DataFrame:
    """Scores between the raw table (0) and full suppression (1), matched on k and metric (and
    subset). Record linkage has no such ends and is left out."""
    keys = [c for c in ("subset", "k", "metric") if c in scores.columns and c in reference.columns]
    ends = reference.groupBy(*keys).agg(
        F.max(F.when(F.col("reference") == "original", F.col("score"))).alias("_raw"),
        F.max(F.when(F.col("reference") == "suppressed", F.col("score"))).alias("_gone"))
    return (
        scores.filter(F.col("metric") != "record_linkage").join(F.broadcast(ends), keys)
        .withColumn("score", normalise(F.col("score"), F.col("_raw"), F.col("_gone")))
        .drop("_raw", "_gone"))


def mean_std(scores: DataFrame, by: list[str] = ["model", "param"]) -> DataFrame:
    """Mean and population standard deviation over iterations."""
    return scores.groupBy(*by, "metric").agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


def mean_histogram(releases: DataFrame, qis: list[QI], iterations: int, by: list[str] = ["model", "param"]) -> DataFrame:
    """Value counts per attribute, averaged over iterations."""
    return cell_counts(releases, qis, by).select(
        *by, "attr", "value", (F.col("n") / F.lit(iterations)).alias("mean_count"))


def suppressed_records(releases: DataFrame, qis: list[QI], by: list[str] = KEYS) -> DataFrame:
    """Fully suppressed rows of every release, and their share."""
    gone = F.count_if(all_suppressed(qis))
    return releases.groupBy(*by).agg(
        gone.alias("n_suppressed"), (gone / F.count(F.lit(1))).alias("share_suppressed"))


def suppressed_attributes(releases: DataFrame, qis: list[QI], by: list[str] = KEYS) -> DataFrame:
    """Suppressed cells of the unsuppressed rows of a release; all attributes when none is left."""
    stars = reduce(Column.__add__, [
        F.col(q.name).eqNullSafe(F.lit(STAR)).cast("int") for q in qis])
    per_row = F.max(F.when(~all_suppressed(qis), stars))
    return releases.groupBy(*by).agg(F.coalesce(per_row, F.lit(len(qis))).alias("n_suppressed_attrs"))


def over_values(scores: DataFrame, param: str, values: list[float]) -> DataFrame:
    """A baseline without the parameter, repeated for each of its values."""
    return scores.drop(param).withColumn(param, F.explode(F.array(*[F.lit(float(v)) for v in values])))


def align_by_position(scores: DataFrame, param: str, from_values: list[float], to_values: list[float]) -> DataFrame:
    """Map one model's parameter values onto another's by their position in the two sweeps."""
    out = F.lit(None).cast("double")
    for a, b in zip(from_values, to_values):
        out = F.when(F.col(param) == a, F.lit(float(b))).otherwise(out)
    return scores.withColumn(param, out)


def compare(models: dict[str, DataFrame], metric: str, x: list[str] = ["param"]) -> DataFrame:
    """Comparison table of models over a parameter, an attribute count or a dataset: mean, sample
    standard deviation and count of one metric."""
    parts = [
        df.filter(F.col("metric") == metric).select(F.lit(model).alias("model"), *x, "score")
        for model, df in models.items()
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("model", *x).agg(
        F.avg("score").alias("mean"), F.stddev("score").alias("std"), F.count("score").alias("n"))


def risk_utility(scores: DataFrame, normalised: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """Linkage of each release beside its normalised squared error."""
    risk = scores.filter("metric = 'record_linkage'").select(*by, F.col("score").alias("record_linkage"))
    loss = normalised.filter("metric = 'sse'").select(*by, F.col("score").alias("information_loss"))
    return risk.join(loss, by)


def value_frequency(df: DataFrame, col: str) -> DataFrame:
    """Rows per value of one attribute."""
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
