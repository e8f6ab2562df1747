"""Parameter sweeps: releases of every model over a grid, scored and normalised.

A sweep is one family of jobs, however many releases it has: parameters, iterations and the optimised
metric are columns. Clusters come from one sort, samples of all private releases from one scan, their
searches advance side by side, and all releases are scored together. Only attribute subsets are run one
after the other, because each has a table of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.noise import fresh_seed
from veilspark.operators.lattice import SET, optimal_k_anonymity
from veilspark.operators.microaggregation import microaggregate
from veilspark.operators.release import microdp_sweep
from veilspark.operators.safepub import Release, class_size_for, safepub_family
from veilspark.plans.evaluation import (
    KEYS, k_column, mean_std, normalise_scores, reference_scores, reference_scores_by_subset, score_releases,
)
from veilspark.runtime import evened, materialise
from veilspark.sources.tables import attribute_subset, subset_name
from veilspark.spec import QI, names

PENALTIES = ["granularity", "intensity", "discernibility", "entropy", "groupsize", "sse"]


def _tag(df: DataFrame, qis: list[QI], model: str | Column, param: Column, iteration: Column) -> DataFrame:
    return df.select((F.lit(model) if isinstance(model, str) else model).alias("model"), param.cast("double").alias("param"),
                     iteration.cast("int").alias("iteration"), "rid", *names(qis))


def microdp_releases(df: DataFrame, qis: list[QI], eps: list[float], k: int | list[int], seed: str, iterations: int,
                     strategy: str = "batched", clusters: DataFrame | None = None) -> DataFrame:
    """Releases over eps, or over ``k`` when it is a list; ``param`` is the one that is swept."""
    rel = microdp_sweep(df, qis, eps, k, seed, iterations, strategy, clusters=clusters)
    return _tag(rel, qis, "MicroDP", F.col("k" if isinstance(k, list) else "eps"), F.col("iteration"))


def safepub_settings(settings: list[tuple[float, float, float]], seed: str, iterations: int,
                     models: list[str] = ["granularity"]) -> list[Release]:
    """Releases for (param, eps, delta) settings, iterations and optimised metrics. A name holds the
    three, and so does the seed, but for the default metric."""
    return [
        Release(f"{param}|{i}|{model}", eps, delta, "|".join([seed, str(param), str(i), *([model] if model != "granularity" else [])]), model)
        for param, eps, delta in settings for i in range(1, iterations + 1) for model in models]


def safepub_releases(df: DataFrame, qis: list[QI], settings: list[tuple[float, float, float]], seed: str,
                     iterations: int, model: str = "granularity", steps: int = 300) -> DataFrame:
    """Releases for (param, eps, delta) settings."""
    rel = safepub_family(df, qis, safepub_settings(settings, seed, iterations, [model]), steps)
    part = F.split(SET, r"\|")
    return _tag(rel, qis, "SafePub", part[0], part[1])


def optimised_releases(df: DataFrame, qis: list[QI], settings: list[tuple[float, float, float]], seed: str,
                       iterations: int, models: list[str], steps: int = 300) -> DataFrame:
    """As ``safepub_releases`` for several optimised metrics; ``model`` names the metric."""
    rel = safepub_family(df, qis, safepub_settings(settings, seed, iterations, models), steps)
    part = F.split(SET, r"\|")
    return _tag(rel, qis, part[2], part[0], part[1])


def kanon_release(df: DataFrame, qis: list[QI], k: int = 5, limit: float = 1.0) -> DataFrame:
    _, rel = optimal_k_anonymity(df.select("rid", *names(qis)), qis, k, limit)
    return _tag(rel, qis, "k-anonymisation", F.lit(float(k)), F.lit(1))


def _k_of(per_model: dict[str, int | dict[float, int]]):
    """k of a release by its model and parameter."""
    out = F.lit(None).cast("int")
    for model, k in per_model.items():
        out = F.when(F.col("model") == model, k_column(k)).otherwise(out)
    return out


def _scored(releases: list[DataFrame], df: DataFrame, qis: list[QI], metrics: list[str], per_model, reference) -> DataFrame:
    written = reduce(DataFrame.unionByName, [materialise(r) for r in releases])
    scores = score_releases(written, df, qis, metrics, _k_of(per_model))
    return mean_std(normalise_scores(scores, reference))


def _read_often(df: DataFrame, qis: list[QI]) -> DataFrame:
    """The table of a sweep, cut evenly: every model and every score scans it again."""
    return evened(df.select("rid", *names(qis)), "rid")


def _ks(per_model) -> list[int]:
    flat = [k for ks in per_model.values() for k in (ks.values() if isinstance(ks, dict) else [ks])]
    return sorted(set(flat))


def sweep_epsilon(df: DataFrame, qis: list[QI], eps: list[float], k: int, delta: float = 1e-5,
                  iterations: int = 1, seed: str | None = None, metrics: list[str] = PENALTIES,
                  steps: int = 300, strategy: str = "batched") -> DataFrame:
    """All three models over eps: mean and deviation of the normalised metrics."""
    seed, df = fresh_seed(seed), _read_often(df, qis)
    per_model = {"MicroDP": k, "SafePub": {e: class_size_for(e, delta) for e in eps}, "k-anonymisation": 5}
    reference = materialise(reference_scores(df, qis, metrics, _ks(per_model)))
    releases = (
        microdp_releases(df, qis, eps, k, seed, iterations, strategy)
        .unionByName(safepub_releases(df, qis, [(e, e, delta) for e in eps], seed, iterations, steps=steps))
        .unionByName(kanon_release(df, qis)))
    return _scored([releases], df, qis, metrics, per_model, reference)


def sweep_optimised(df: DataFrame, qis: list[QI], eps: list[float], models: list[str], delta: float = 1e-5,
                    iterations: int = 1, seed: str | None = None, metrics: list[str] = PENALTIES,
                    steps: int = 300) -> DataFrame:
    """SafePub over eps for every optimised metric; ``model`` is the metric. The mean group size cannot
    be optimised privately (see ``dp_searches``)."""
    seed, df = fresh_seed(seed), _read_often(df, qis)
    k = {e: class_size_for(e, delta) for e in eps}
    per_model = {model: k for model in models}
    reference = materialise(reference_scores(df, qis, metrics, _ks(per_model)))
    releases = optimised_releases(df, qis, [(e, e, delta) for e in eps], seed, iterations, models, steps)
    return _scored([releases], df, qis, metrics, per_model, reference)


def sweep_k_delta(df: DataFrame, qis: list[QI], ks: list[int], deltas: list[float], eps: float = 1.0,
                  iterations: int = 1, seed: str | None = None, metrics: list[str] = PENALTIES,
                  steps: int = 300, strategy: str = "batched") -> DataFrame:
    """MicroDP over k and SafePub over delta at one eps; ``param`` is k or delta."""
    seed, df = fresh_seed(seed), _read_often(df, qis)
    per_model = {"MicroDP": {float(k): k for k in ks}, "SafePub": {float(d): class_size_for(eps, d) for d in deltas}}
    reference = materialise(reference_scores(df, qis, metrics, _ks(per_model)))
    releases = microdp_releases(df, qis, [eps], ks, seed, iterations, strategy).unionByName(
        safepub_releases(df, qis, [(d, eps, d) for d in deltas], seed, iterations, steps=steps))
    return _scored([releases], df, qis, metrics, per_model, reference)


def sweep_attributes(df: DataFrame, qis: list[QI], subsets: list[list[str]], k: int, eps: float = 1.0,
                     delta: float = 1e-5, iterations: int = 1, seed: str | None = None,
                     metrics: list[str] = PENALTIES, steps: int = 300, strategy: str = "batched") -> DataFrame:
    """Both private models over attribute subsets; ``param`` is the number of attributes."""
    seed, df = fresh_seed(seed), _read_often(df, qis)
    per_model = {"MicroDP": k, "SafePub": class_size_for(eps, delta)}
    reference = materialise(reference_scores_by_subset(df, qis, metrics, _ks(per_model), subsets))
    parts = []
    for attrs in subsets:
        sub, chosen = attribute_subset(df, qis, attrs)
        mine = reference.filter(F.col("subset") == subset_name(attrs)).drop("subset")
        models = [microdp_releases(sub, chosen, [eps], k, seed, iterations, strategy),
                  safepub_releases(sub, chosen, [(eps, eps, delta)], seed, iterations, steps=steps)]
        releases = [r.withColumn("param", F.lit(float(len(attrs)))) for r in models]
        # written one by one: the driver holds the plan of one model or score, however many subsets there are
        scores = materialise(_scored(releases, sub, chosen, metrics, per_model, mine))
        parts.append(scores.withColumn("subset", F.lit(subset_name(attrs))))
    return reduce(DataFrame.unionByName, parts)


def sweep_disclosure(df: DataFrame, qis: list[QI], eps: list[float], k: int, delta: float = 1e-4,
                     iterations: int = 1, seed: str | None = None, steps: int = 300,
                     strategy: str = "batched") -> DataFrame:
    """Squared error and record linkage of every release of all three models."""
    seed, df = fresh_seed(seed), _read_often(df, qis)
    metrics = ["sse", "record_linkage"]
    clusters = materialise(microaggregate(df, qis, k, strategy))
    md = microdp_releases(df, qis, eps, k, seed, iterations, strategy, clusters)
    sp = safepub_releases(df, qis, [(e, e, delta) for e in eps], seed, iterations, steps=steps)
    releases = materialise(md.unionByName(sp).unionByName(kanon_release(df, qis)))
    return score_releases(releases, df, qis, metrics, 1).drop("k")
