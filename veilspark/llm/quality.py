"""Quality rules and robust multivariate outliers.

Base rules look at one document. The verdict on what passes them compares a document with its own
language and source: a minimum-covariance-determinant estimate of location and scatter per group, and
rejection of transformed statistic vectors whose squared Mahalanobis distance is beyond a chi-square
bound.

The estimate covers every document of a group. It starts from the coordinates' medians and spreads
and takes concentration steps: distances of all members, then mean and scatter of the half with the
smallest ones. A step needs only sums and a histogram of distances per group, so a group of any size
is one partial aggregate; nothing of a group is collected. The scatter gets a floor (``FLOOR``), since
most documents share the same value in some coordinates, and is rescaled by the median distance.

Groups with fewer than ``MIN_GROUP`` documents are judged against all documents of their language, and
languages with fewer against all documents; however few those are, every document gets a distance.

Defined results: NULL text has no words and fails the base rules. NULL language or source is a value
like any other. Repeated rows count as often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from veilspark.llm.common import BLANKS, query, quoted, table
from veilspark.runtime import lookup, materialise

MIN_WORDS = 50
#: Mahalanobis bound: with four coordinates the chi-square distribution exceeds it with chance 4e-9. Most of
#: a clean text's coordinates are 0, so the floors below and not their spread set the scale: most tables
#: (half a bar per word) come to less than 45.
LEVEL_BOUND = 45.0
CHI2_MEDIAN = 3.356694
STEPS = 3
MIN_GROUP = 100
#: Least standard deviation of each coordinate.
FLOOR = (0.04, 0.15, 0.15, 0.15)
DIMS = len(FLOOR)
#: Histogram of log2 distances: bins per octave.
BINS = 16

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def text_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass").split()
    n = len(raw)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    repeats = 0
    if n >= 3:
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in raw), np.int64, n)
        key = (ids[:-2] * len(seen) + ids[1:-1]) * len(seen) + ids[2:]
        _, where, times = np.unique(key, return_inverse=True, return_counts=True)
        twice = times[where] > 1
        covered = np.zeros(n, dtype=bool)
        for shift in range(3):
            covered[shift:n - 2 + shift] |= twice
        repeats = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeats


def with_statistics(docs: DataFrame, keep: list[str], nested: str | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` and the statistics of each text; the text is a field of the column
    ``nested``, if given."""
    names = [x.split()[0] for x in STATS.split(", ")]
    kept = docs.select(*keep)
    schema = T.StructType([*kept.schema.fields, *[T.StructField(x, T.LongType()) for x in names]])
    inside = None if nested is None else (keep.index(nested), kept.schema[nested].dataType.names.index("text"))

    def run(batches):
        for batch in batches:
            text = batch.column(len(keep)) if inside is None else batch.column(inside[0]).field(inside[1])
            rows = [text_statistics(t) for t in text.to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * len(names)
            arrays = [batch.column(i) for i in range(len(keep))] + [pa.array(c, pa.int64()) for c in cols]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *names])

    return (kept if nested else docs.select(*keep, F.col("text").alias("_text"))).mapInArrow(run, schema)


def _vector():
    """The transformed statistics: per-word rates on scales where their spread hardly depends on the
    length. Repeated windows of chance grow with the length, so their rate is taken per root word."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log((F.col("word_chars") + 1) / n),
        F.sqrt(F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / n),
        F.sqrt(F.col("n_repeat_words") / n) / F.pow(n / 300.0, F.lit(0.35)),
    ]


def _group_moments(rows: DataFrame, key: str) -> DataFrame:
    sums = [F.count(F.lit(1)).cast("double").alias("m")]
    sums += [F.sum(f"x{i}").alias(f"s{i}") for i in range(DIMS)]
    sums += [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in range(DIMS) for j in range(i, DIMS)]
    return rows.groupBy(key).agg(*sums)


def _invert(moments: DataFrame, key: str) -> DataFrame:
    """Centre and inverse scatter of each group from its sums: one small row per group."""
    names = [key, *[f"c{i}" for i in range(DIMS)], *[f"w{i}{j}" for i in range(DIMS) for j in range(i, DIMS)]]
    schema = f"{key} string, " + ", ".join(f"{x} double" for x in names[1:])

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                mean = np.array([r[f"s{i}"] for i in range(DIMS)]) / r["m"]
                cov = np.zeros((DIMS, DIMS))
                for i in range(DIMS):
                    for j in range(i, DIMS):
                        cov[i, j] = cov[j, i] = r[f"q{i}{j}"] / r["m"] - mean[i] * mean[j]
                inv = np.linalg.inv(cov + np.diag(np.square(FLOOR)))
                out.append([r[key], *mean, *[inv[i, j] for i in range(DIMS) for j in range(i, DIMS)]])
            cols = list(zip(*out)) if out else [()] * len(names)
            types = [pa.string()] + [pa.float64()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return moments.mapInArrow(run, schema)


def _distance():
    total = F.lit(0.0)
    for i in range(DIMS):
        for j in range(i, DIMS):
            term = (F.col(f"x{i}") - F.col(f"c{i}")) * (F.col(f"x{j}") - F.col(f"c{j}")) * F.col(f"w{i}{j}")
            total = total + (term if i == j else 2 * term)
    return total


def _half(rows: DataFrame, key: str) -> DataFrame:
    """Per group the histogram bin of the distances that half of its members do not exceed.

    The histogram is written first: planned together, counting would be dealt by group alone, to suit
    the windows, and every task's counts of a large group would meet in one task.
    """
    counts = materialise(rows.groupBy(key, "bin").agg(F.count(F.lit(1)).alias("n")))
    upto = F.sum("n").over(W.partitionBy(key).orderBy("bin"))
    total = F.sum("n").over(W.partitionBy(key))
    return (counts.withColumn("_u", upto).withColumn("_t", total).filter(F.col("_u") * 2 >= F.col("_t"))
            .groupBy(key).agg(F.min("bin").alias("half"), F.max("_t").alias("members")))


def fit(rows: DataFrame, key: str, steps: int = STEPS) -> DataFrame:
    """The MCD estimate of every group of ``rows``: one row per group with its centre, inverse scatter and
    rescaling, written. Each step's estimates are counted: few of them are broadcast, of many those of the
    large groups.
    """
    median = [F.percentile_approx(f"x{i}", 0.5, 10_000).alias(f"c{i}") for i in range(DIMS)]
    flat = [F.lit(1 / FLOOR[i] ** 2 if i == j else 0.0).alias(f"w{i}{j}") for i in range(DIMS) for j in range(i, DIMS)]
    estimate = materialise(rows.groupBy(key).agg(*median).select(key, *[f"c{i}" for i in range(DIMS)], *flat))
    level = F.floor(F.log2(F.greatest(_distance(), F.lit(1e-9))) * BINS).cast("int")
    groups = estimate.count()
    for step in range(steps + 1):
        far = lookup(rows, estimate, [key], groups).withColumn("bin", level)
        half = materialise(_half(far, key))
        if step < steps:
            core = lookup(far, half, [key], groups).filter(F.col("bin") <= F.col("half"))
            estimate = materialise(_invert(_group_moments(core, key), key))
    scale = F.greatest(F.pow(F.lit(2.0), (F.col("half") + 0.5) / BINS) / CHI2_MEDIAN, F.lit(1.0)).alias("scale")
    return materialise(estimate.join(half.select(key, scale), key))


def with_distances(rows: DataFrame, key: str, model: DataFrame, groups: int, how: str = "inner") -> DataFrame:
    """``rows`` with ``d2``, the rescaled squared distance from their group's estimate."""
    return lookup(rows, model, [key], groups, how).withColumn("d2", _distance() / F.col("scale")).drop(
        *[c for c in model.columns if c != key])


def robust_distances(rows: DataFrame, key: str, steps: int = STEPS) -> DataFrame:
    """``rows`` with ``d2``, the rescaled squared distance from their group's MCD estimate."""
    model = fit(rows, key, steps)
    return with_distances(rows, key, model, model.count())


def _placed(stats: DataFrame) -> DataFrame:
    """``stats`` with ``base_failed``, the vector and the keys of language and group."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    tag = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c)), F.lit("~"))
    rows = stats.withColumn("base_failed", failed)
    for i, x in enumerate(_vector()):
        rows = rows.withColumn(f"x{i}", x)
    return rows.withColumn("_lang", tag("lang")).withColumn("_group", F.concat_ws("\u0001", tag("lang"), tag("source")))


def learn(stats: DataFrame, min_group: int = MIN_GROUP) -> Callable[[DataFrame, float], DataFrame]:
    """The estimates by which each group is judged, from written statistics, as a function that gives rows
    with statistics their ``base_failed``, ``d2`` and ``kept``. It holds one row per language and source and
    needs one lookup, so rows are judged where they are."""
    rows = _placed(stats).filter(~F.col("base_failed"))
    sizes = rows.groupBy("_lang", "_group").agg(F.count(F.lit(1)).alias("_members"))
    sizes = materialise(sizes.withColumn("_speakers", F.sum("_members").over(W.partitionBy("_lang"))))
    facts = sizes.agg(F.count(F.lit(1)).alias("n"), F.min("_members").alias("group"), F.min("_speakers").alias("lang")).first()
    thin, rare = F.col("_members") < min_group, F.col("_speakers") < min_group
    names = sizes.select("_lang", "_group")
    sized = lookup(rows, sizes.drop("_lang"), ["_group"], facts["n"])
    found = [names.join(fit(sized.filter(~thin), "_group"), "_group")]
    if facts["n"] and facts["group"] < min_group:
        # languages with thin groups that are large enough themselves
        few = materialise(sizes.filter(thin & ~rare).select("_lang").distinct())
        among = fit(lookup(rows, few, ["_lang"], few.count()), "_lang")
        found.append(sizes.filter(thin & ~rare).select("_lang", "_group").join(among, "_lang"))
    if facts["n"] and facts["lang"] < min_group:
        everyone = fit(rows.withColumn("_all", F.lit("")), "_all").drop("_all")
        found.append(sizes.filter(rare).select("_lang", "_group").join(F.broadcast(everyone)))
    model = materialise(reduce(DataFrame.unionByName, found).drop("_lang"))

    def verdict(given: DataFrame, bound: float) -> DataFrame:
        judged = with_distances(_placed(given), "_group", model, facts["n"], "left")
        d2 = F.when(~F.col("base_failed"), F.col("d2"))
        return judged.select(*given.columns, "base_failed", d2.alias("d2")).withColumn(
            "kept", ~F.col("base_failed") & (F.col("d2") <= bound))

    return verdict


def judge(docs: DataFrame, keep: list[str], bound: float = LEVEL_BOUND, min_group: int = MIN_GROUP) -> DataFrame:
    """Columns ``keep`` (doc_id, lang and source among them), statistics, ``base_failed``, ``d2`` (NULL
    where the base rules decide) and ``kept``."""
    stats = materialise(with_statistics(docs, list(dict.fromkeys([*keep, "lang", "source"]))))
    return learn(stats, min_group)(stats, bound)


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows that the rules reject go, each by itself, whatever others share its id.

    The estimates are learned from the statistics of all rows. Then every row is read again and judged where
    it is, so that no text is shuffled. Rows travel as one column, so no name of theirs can clash."""
    verdict = learn(materialise(with_statistics(docs, ["lang", "source"])))
    row = F.struct(*[docs[quoted(c)] for c in docs.columns]).alias("_row")
    whole = with_statistics(docs.select(row, "lang", "source"), ["_row", "lang", "source"], "_row")
    kept = verdict(whole, LEVEL_BOUND).filter("kept")
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


@query("op2_quality_rules")
def op2(spark, sf_dir):
    """All documents with their statistics and the verdict."""
    return judge(table(spark, sf_dir, "documents"), ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")
