"""Utility metrics of releases. Every function scores many releases at once: ``by`` names the
columns that tell releases apart, and one job aggregates them all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.cells import cell_text, grid_leaves
from veilspark.functions.distance import ancestor_distance, cell_distance, numeric_distance
from veilspark.operators.classes import all_suppressed, equivalence_classes
from veilspark.operators.taxonomy import node_facts
from veilspark.runtime import by_shuffle, materialise, small
from veilspark.spec import QI, STAR

PENALISED = ("granularity", "intensity", "discernibility", "entropy")
METRICS = (*PENALISED, "groupsize", "sse", "record_linkage")


def sensitivity(k: Column) -> Column:
    """k^2 / (k - 1) + 1, and 5 for k = 1."""
    k = k.cast("double")
    return F.when(k == 1, F.lit(5.0)).otherwise(F.try_divide(k * k, k - 1) + 1)


def scale_of(metric: str, k: Column, n_rows: Column, n_qis: int) -> Column:
    """Divisor that turns the plain sum of a metric into its score."""
    k = k.cast("double")
    if metric in ("granularity", "intensity"):
        return F.when(k > 1, (k - 1) * n_qis).otherwise(F.lit(1.0))
    if metric == "discernibility":
        return sensitivity(k) * n_rows
    if metric == "entropy":
        return F.when(k == 1, F.lit(1.0)).otherwise(sensitivity(k)) * n_qis * n_rows
    return F.lit(1.0)


def cell_counts(df: DataFrame, qis: list[QI], by: list[str], weight: str | None = None) -> DataFrame:
    """Rows per (release, attribute, cell value); ``df`` may hold classes with their sizes."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(q.name).alias("attr"), F.col(q.name).cast("string").alias("value")) for q in qis
    ])).alias("_cell")
    count = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    return (
        df.select(*by, cells, count.alias("_n")).select(*by, "_cell.attr", "_cell.value", "_n")
        .groupBy(*by, "attr", "value").agg(F.sum("_n").alias("n"))
    )


def _share_table(qis: list[QI]) -> DataFrame | None:
    """(attr, value, share of the domain covered, relative level) of the category nodes."""
    tables = [
        q.tax.hint(node_facts(q.tax).select(
            F.lit(q.name).alias("attr"), F.col("node").alias("value"),
            (F.col("n_leaves") / F.lit(q.domain_size)).alias("_share"),
            (F.col("level") / F.lit(q.top_level)).alias("_level")))
        for q in qis if q.is_category
    ]
    return reduce(DataFrame.unionByName, tables) if tables else None


def _number_level(value: Column, qi: QI) -> Column:
    """Level of a numeric cell from the number of grid values it covers."""
    covered = grid_leaves(value, qi)
    level = F.when(value == STAR, F.lit(qi.top_level))
    for i, width in enumerate(qi.widths, start=1):
        # the last band absorbs a remainder of up to half a width
        level = level.when((covered > 1) & (covered <= round(1.5 * width * 10**qi.decimals) + 1), F.lit(i))
    return level.when(covered > 1, F.lit(max(len(qi.widths), 1))).otherwise(F.lit(0))


def cell_loss(df: DataFrame, qis: list[QI], by: list[str], weight: str | None = None) -> DataFrame:
    """Counted cells with the share of the domain they cover and their relative level. A cell that is
    neither a number nor in the hierarchy counts as fully lost."""
    counts = cell_counts(df, qis, by, weight)
    share, level = F.lit(None).cast("double"), F.lit(None).cast("double")
    for q in qis:
        if not q.is_category:
            mine = F.col("attr") == q.name
            share = F.when(mine, grid_leaves(F.col("value"), q) / F.lit(q.domain_size)).otherwise(share)
            level = F.when(mine, _number_level(F.col("value"), q) / F.lit(q.top_level)).otherwise(level)
    table = _share_table(qis)
    if table is None:
        found_share, found_level = F.lit(None).cast("double"), F.lit(None).cast("double")
        joined = counts
    else:
        rows = sum(q.tax.facts["rows"] for q in qis if q.is_category)
        joined = counts.join(small(table, rows), ["attr", "value"], "left")
        found_share, found_level = F.col("_share"), F.col("_level")
    star = F.col("value") == STAR
    return joined.select(
        *by, "attr", "value", "n",
        F.when(star, F.lit(1.0)).otherwise(F.coalesce(share, found_share, F.lit(1.0))).alias("share"),
        F.when(star, F.lit(1.0)).otherwise(F.coalesce(level, found_level, F.lit(1.0))).alias("level"),
    )


def plain_sums(df: DataFrame, qis: list[QI], metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """Unscaled sums of the requested metrics, one row per release, and its ``n_rows``.

    k enters a score only through its divisor, so these sums serve any number of ks.
    """
    by = by or []
    of_cells = bool({"granularity", "intensity", "entropy"} & set(metrics))
    of_classes = bool({"discernibility", "groupsize"} & set(metrics)) or not of_cells
    if not of_classes:
        return _cell_sums(df, qis, metrics, by, None)
    classes = equivalence_classes(df, qis, by)
    if not of_cells:
        return _class_sums(classes, qis, metrics, by)
    # one scan of the rows: cells are counted from the classes
    classes = materialise(classes)
    cells = _cell_sums(classes, qis, metrics, by, "class_size").drop("n_rows")
    sums = _class_sums(classes, qis, metrics, by)
    return sums.join(cells, by) if by else sums.join(cells)


def _class_sums(classes, qis, metrics, by) -> DataFrame:
    size = F.col("class_size").cast("double")
    gone = all_suppressed(qis)
    out = classes.groupBy(*by).agg(
        F.sum("class_size").alias("n_rows"),
        F.sum(F.when(gone, 0.0).otherwise(size * size)).alias("_kept"),
        F.sum(F.when(gone, size).otherwise(0.0)).alias("_gone"),
        F.count(F.lit(1)).alias("_classes"),
    )
    cols = [*by, "n_rows"]
    if "discernibility" in metrics:
        cols.append((F.col("_kept") + F.col("_gone") * F.col("n_rows")).alias("discernibility"))
    if "groupsize" in metrics:
        cols.append(F.col("_classes").cast("double").alias("groupsize"))
    return out.select(*cols)


def _cell_sums(df, qis, metrics, by, weight) -> DataFrame:
    m = len(qis)
    n = F.col("n").cast("double")
    star = F.col("value") == STAR
    counted = cell_loss if {"granularity", "intensity"} & set(metrics) else cell_counts
    source = counted(df, qis, by, weight)
    aggs = [(F.sum("n") / F.lit(m)).cast("bigint").alias("n_rows")]
    if "granularity" in metrics:
        aggs.append(F.sum(n * F.col("share")).alias("granularity"))
    if "intensity" in metrics:
        aggs.append(F.sum(n * F.col("level")).alias("intensity"))
    if "entropy" in metrics:
        aggs += [F.sum(F.when(star, 0.0).otherwise(n * n)).alias("_squares"),
                 F.sum(F.when(star, n).otherwise(0.0)).alias("_stars")]
    out = source.groupBy(*by).agg(*aggs)
    if "entropy" in metrics:
        out = out.withColumn("entropy", F.col("_squares") + F.col("_stars") * F.col("n_rows"))
        out = out.drop("_squares", "_stars")
    return out


def _one(metric: str, df: DataFrame, qis: list[QI], k, by: list[str] | None) -> DataFrame:
    k = F.lit(k) if isinstance(k, int) else k
    sums = plain_sums(df, qis, [metric], by)
    score = F.col(metric) / scale_of(metric, k, F.col("n_rows"), len(qis))
    return sums.select(*(by or []), score.alias(metric))


def granularity(df: DataFrame, qis: list[QI], k: int = 1, by: list[str] | None = None) -> DataFrame:
    """Share of the domain covered, summed over cells; ``*`` covers it all."""
    return _one("granularity", df, qis, k, by)


def intensity(df: DataFrame, qis: list[QI], k: int = 1, by: list[str] | None = None) -> DataFrame:
    """Relative generalisation level, summed over cells."""
    return _one("intensity", df, qis, k, by)


def discernibility(df: DataFrame, qis: list[QI], k: int = 1, by: list[str] | None = None) -> DataFrame:
    """Squared class sizes; a suppressed row counts as much as the whole table."""
    return _one("discernibility", df, qis, k, by)


def non_uniform_entropy(df: DataFrame, qis: list[QI], k: int = 1, by: list[str] | None = None) -> DataFrame:
    """Squared value counts per column; a suppressed cell weighs the whole table."""
    return _one("entropy", df, qis, k, by)


def group_count(df: DataFrame, qis: list[QI], by: list[str] | None = None) -> DataFrame:
    """Number of equivalence classes."""
    return _one("groupsize", df, qis, 1, by)


def avg_group_size(df: DataFrame, qis: list[QI], by: list[str] | None = None) -> DataFrame:
    """Rows per equivalence class."""
    sums = plain_sums(df, qis, ["groupsize"], by)
    return sums.select(*(by or []), (F.col("n_rows") / F.col("groupsize")).alias("avg_group_size"))


def sse(raw: DataFrame, anon: DataFrame, qis: list[QI], by: list[str] | None = None, rid: str = "rid") -> DataFrame:
    """Squared record distances between raw and released rows, summed.

    The sum splits by attribute. Numbers are summed row by row; categories are first counted per
    (raw value, released value), so that distances are computed once per distinct pair.
    """
    by = by or []
    raw = raw.select(rid, *[cell_text(F.col(q.name), q).alias(f"_raw_{q.name}") for q in qis])
    both = anon.select(*by, rid, *[F.col(q.name).cast("string").alias(q.name) for q in qis]).join(by_shuffle(raw), rid)
    # one cell per category and one for all numbers of a row
    numbers = [q for q in qis if not q.is_category]
    categories = [q for q in qis if q.is_category]
    terms = []
    for q in numbers:
        a, b = F.col(f"_raw_{q.name}"), F.col(q.name)
        d = cell_distance(a, b, numeric_distance(a, b) / F.lit(q.span))
        terms.append(d * d)
    text = lambda: F.lit(None).cast("string")
    cells = [F.struct(F.lit(q.name).alias("attr"), F.col(f"_raw_{q.name}").alias("a"), F.col(q.name).alias("b"),
                      F.lit(0.0).alias("term")) for q in categories]
    if numbers:
        cells.append(F.struct(text().alias("attr"), text().alias("a"), text().alias("b"),
                              reduce(Column.__add__, terms).alias("term")))
    counts = both.select(*by, F.explode(F.array(*cells)).alias("_c")).select(*by, "_c.*").groupBy(
        *by, "attr", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("term").alias("term"))
    if not categories:
        return counts.groupBy(*by).agg(F.sum("term").alias("sse"))
    tables = [q.tax.nodes.select(F.lit(q.name).alias("attr"), "node", "ancestors",
                                 F.lit(q.span).alias("span")) for q in categories]
    table = reduce(DataFrame.unionByName, tables)
    rows = sum(q.tax.facts["rows"] for q in categories)
    left = small(table.select("attr", F.col("node").alias("a"), F.col("ancestors").alias("_up_a"), "span"), rows)
    right = small(table.select("attr", F.col("node").alias("b"), F.col("ancestors").alias("_up_b")), rows)
    d = cell_distance(F.col("a"), F.col("b"), ancestor_distance(F.col("_up_a"), F.col("_up_b")) / F.col("span"))
    squared = F.when(F.col("attr").isNull(), F.col("term")).otherwise(F.col("n") * d * d)
    return counts.join(left, ["attr", "a"], "left").join(right, ["attr", "b"], "left").groupBy(*by).agg(
        F.sum(squared).alias("sse"))


def score(df: DataFrame, metric: str) -> DataFrame:
    """Sign-flipped metric: higher is better."""
    return df.withColumn(f"{metric}_score", -F.col(metric)).drop(metric)


def compute_metric(
    name: str, anon: DataFrame, qis: list[QI], k: int = 1, raw: DataFrame | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """One metric by name, in a column of that name."""
    if name in PENALISED or name == "groupsize":
        return _one(name, anon, qis, k, by)
    if name == "sse":
        return sse(raw, anon, qis, by)
    if name == "record_linkage":
        from veilspark.operators.linkage import record_linkage

        return record_linkage(raw, anon, qis, by)
    raise ValueError(f"unknown metric {name!r}")


def compute_metrics(
    metrics: list[str], anon: DataFrame, qis: list[QI], k=1, raw: DataFrame | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """Several metrics of each release in long form: ``by``, ``metric``, ``score``.

    ``k`` may be a number or a column over ``by``. Metrics of the same kind share one pass.
    """
    by = by or []
    unknown = set(metrics) - set(METRICS)
    if unknown:
        raise ValueError(f"unknown metrics {sorted(unknown)}")
    k = F.lit(k) if isinstance(k, int) else k
    parts = []
    plain = [m for m in metrics if m in PENALISED or m == "groupsize"]
    if plain:
        sums = plain_sums(anon, qis, plain, by)
        cells = F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"),
                     (F.col(m) / scale_of(m, k, F.col("n_rows"), len(qis))).alias("score"))
            for m in plain
        ])).alias("_m")
        parts.append(sums.select(*by, cells).select(*by, "_m.*"))
    for m in metrics:
        if m not in plain:
            one = compute_metric(m, anon, qis, 1, raw, by)
            parts.append(one.select(*by, F.lit(m).alias("metric"), F.col(m).alias("score")))
    return reduce(DataFrame.unionByName, parts)
