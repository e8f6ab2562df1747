"""Insensitive microaggregation: clusters of at least k records around public corners.

The corners are the 2^m combinations of the attributes' public ends, visited in a fixed order, so
the partition depends on the data only through distances to public points.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilspark.functions.cells import cell_text
from veilspark.functions.distance import ancestor_distance, cell_distance, numeric_distance
from veilspark.runtime import materialise, ordered_positions, positions_within, shuffle_partitions, spread
from veilspark.sources.tables import fingerprint, load_clusters, save_clusters
from veilspark.spec import QI, names

# Rows handed to one task when a batch of corners is resolved in order.
BATCH_ROWS = 1_000_000


def corner_order(m: int, count: int) -> list[tuple[int, ...]]:
    """The first ``count`` corners: each the unused corner farthest, in Hamming distance, from the
    latest one, ties by the ones before it, then lexicographic; every corner once per cycle.

    Beyond 20 attributes the corners are not listed: each lexicographic corner is followed by its
    complement, which is the farthest corner there is.
    """
    if m > 20:
        bits = [tuple((i >> (m - 1 - j)) & 1 for j in range(m)) for i in range((count + 1) // 2)]
        pairs = [p for b in bits for p in (b, tuple(1 - x for x in b))]
        return pairs[:count]
    order: list[int] = []
    unused = np.array([], dtype=np.int64)
    for _ in range(count):
        if len(unused) == 0:
            unused = np.arange(2**m, dtype=np.int64)
            best = unused[:1]
        else:
            best = unused
            for past in reversed(order):
                far = np.bitwise_count(best ^ past)
                best = best[far == far.max()]
                if len(best) == 1:
                    break
        order.append(int(best[0]))
        unused = unused[unused != best[0]]
    return [tuple((c >> (m - 1 - j)) & 1 for j in range(m)) for c in order]


def corner_value(qi: QI, bit: int):
    if qi.is_category:
        return (qi.tax.boundary.bottom, qi.tax.boundary.top)[bit]
    return (float(qi.lo), float(qi.hi))[bit]


def corner_point(qis: list[QI], corner: tuple[int, ...]) -> dict:
    return {q.name: corner_value(q, b) for q, b in zip(qis, corner)}


def with_squared_terms(df: DataFrame, qis: list[QI], points: dict[str, list], out: str = "terms") -> DataFrame:
    """Attach, per attribute, the squared normalised distances to a few public values.

    ``points[attr]`` lists the values; the result is an array of arrays in attribute order. The
    distance to any combination of these values is then a sum of array elements.
    """
    cols = []
    for q in qis:
        if q.is_category:
            # the points are few: look their ancestor sets up once, on the driver
            ups = {r["node"]: r["ancestors"] for r in q.tax.nodes
                   .filter(F.col("node").isin(points[q.name])).select("node", "ancestors").collect()}
            # distances are taken once per node; rows look them up
            apart = lambda up: [ancestor_distance(up, F.array(*[F.lit(a) for a in ups[p]])) / F.lit(q.span)
                                for p in points[q.name]]
            table = q.tax.nodes.select(F.col("node").alias(q.name), F.array(*apart(F.col("ancestors"))).alias("_apart"))
            df = q.tax.lookup(df, table, q.name, "left")
            each = []
            for i, (p, unknown) in enumerate(zip(points[q.name], apart(F.lit(None).cast("array<string>")))):
                d = cell_distance(F.col(q.name), F.lit(p), F.coalesce(F.col("_apart")[i], unknown))
                each.append(d * d)
            df = df.withColumn(f"_t_{q.name}", F.array(*each)).drop("_apart")
        else:
            text = cell_text(F.col(q.name), q) if q.kind == "mixed" else F.col(q.name).cast("double")
            each = []
            for p in points[q.name]:
                if q.kind == "mixed":
                    d = numeric_distance(text, F.lit(str(p))) / F.lit(q.span)
                    d = cell_distance(text, F.lit(str(p)), d)
                else:
                    d = (text - F.lit(float(p))) / F.lit(q.span)
                each.append(d * d)
            df = df.withColumn(f"_t_{q.name}", F.array(*each))
        cols.append(F.col(f"_t_{q.name}"))
    return df.withColumn(out, F.array(*cols)).drop(*[f"_t_{q.name}" for q in qis])


def _corner_distance(corner: Column, m: int) -> Column:
    """Distance to a corner given as an array of bits, from the ``terms`` column."""
    total = F.lit(0.0)
    for j in range(m):
        total = total + F.element_at(F.element_at("terms", j + 1), F.element_at(corner, j + 1) + 1)
    return F.round(F.sqrt(total), 12)


def corner_terms(df: DataFrame, qis: list[QI]) -> DataFrame:
    return with_squared_terms(df, qis, {q.name: [corner_value(q, 0), corner_value(q, 1)] for q in qis})


def nearest_k(df: DataFrame, qis: list[QI], point: dict, k: int, rid: str = "rid") -> DataFrame:
    """The k records nearest to a reference point, nearest first; ties by ``rid``."""
    terms = with_squared_terms(df.select(rid, *names(qis)), qis, {q.name: [point[q.name]] for q in qis})
    d = _corner_distance(F.array(*[F.lit(0) for _ in qis]), len(qis))
    return terms.select(rid, d.alias("distance")).orderBy("distance", rid).limit(k)


def microaggregate(df: DataFrame, qis: list[QI], k: int, strategy: str = "batched", rid: str = "rid",
                   n: int | None = None) -> DataFrame:
    """Cluster assignment ``(rid, cluster_id)`` with sizes in k..2k-1.

    ``batched`` cuts the k nearest remaining records at one corner after the other, exactly as a
    sequential scan would. ``ordered`` sorts once by the distance to the first corner and cuts
    runs of k: looser clusters, so the caller has to ask for it.
    """
    n = df.count() if n is None else n
    if strategy == "ordered":
        return _ordered(df, qis, k, rid, n)
    if strategy == "batched":
        return _batched(df, qis, k, rid, n)
    raise ValueError(f"unknown strategy {strategy!r}")


def microaggregate_each(df: DataFrame, qis: list[QI], ks: list[int], strategy: str = "batched", rid: str = "rid",
                        n: int | None = None) -> DataFrame:
    """``microaggregate`` for every k: ``(k, rid, cluster_id)``. One sort serves all of ``ordered``."""
    n = df.count() if n is None else n
    if strategy == "ordered":
        order = _positions(df, qis, rid)
        sizes = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
        last = F.greatest(F.floor(F.lit(n) / F.col("k")), F.lit(1)) - 1
        run = F.least(F.floor((F.col("_pos") - 1) / F.col("k")), last).cast("bigint")
        return order.select("_pos", rid, sizes).select("k", rid, run.alias("cluster_id"))
    parts = [microaggregate(df, qis, k, strategy, rid, n).select(F.lit(k).alias("k"), rid, "cluster_id") for k in ks]
    return reduce(DataFrame.unionByName, parts)


def _positions(df, qis, rid) -> DataFrame:
    corner = F.array(*[F.lit(b) for b in corner_order(len(qis), 1)[0]])
    d = _corner_distance(corner, len(qis))
    keyed = corner_terms(spread(df.select(rid, *names(qis)), rid), qis).select(d.alias("_d"), rid)
    return ordered_positions(keyed, ["_d", rid], "_pos")


def _ordered(df, qis, k, rid, n) -> DataFrame:
    last = max(n // k, 1) - 1
    run = F.least(F.floor((F.col("_pos") - 1) / k), F.lit(last)).cast("bigint")
    return _positions(df, qis, rid).select(rid, run.alias("cluster_id"))


def _batched(df, qis, k, rid, n) -> DataFrame:
    """Exact greedy on distinct attribute vectors.

    Equal records are interchangeable, so the greedy works on vectors with counts, ordered by
    (distance, vector): a corner takes whole vectors until it has k rows and part of the last one.
    The turn t of a batch can only lose rows to the t - 1 turns before it, so the vectors that
    hold the first t * k rows around its corner contain everything it may take. One job per batch.
    """
    m = len(qis)
    attrs = names(qis)
    steps = max(n // k - 1, 0)
    corners = corner_order(m, steps)
    rows = spread(df, rid).select(rid, *attrs, F.unhex(F.md5(F.to_json(F.struct(*attrs)))).alias("vec"))
    vectors = materialise(
        corner_terms(rows.groupBy("vec", *attrs).agg(F.count(F.lit(1)).alias("left")), qis)
        .select("vec", "left", "terms")
    )
    taken = []
    done = 0
    while done < steps:
        size = _batch_size(corners[done:], k, vectors.count())
        runs = materialise(_batch_runs(vectors, corners[done:done + size], k, m, done))
        taken.append(runs)
        done += size
        used = runs.groupBy("vec").agg(F.sum("take").alias("_used"))
        if done < steps:
            vectors = materialise(
                vectors.join(used, "vec", "left")
                .withColumn("left", F.col("left") - F.coalesce("_used", F.lit(0))).drop("_used")
                .filter("left > 0"))
    if not taken:
        return rows.select(rid, F.lit(0).cast("bigint").alias("cluster_id"))
    runs = taken[0]
    for more in taken[1:]:
        runs = runs.unionByName(more)
    return _assign_rows(rows, runs, rid, k, steps)


def _needs(batch: list[tuple[int, ...]], k: int) -> dict[tuple[int, ...], int]:
    """Rows around each distinct corner that can matter up to its last turn in the batch."""
    return {corner: (t + 1) * k for t, corner in enumerate(batch)}


def _batch_size(corners: list[tuple[int, ...]], k: int, vectors: int) -> int:
    """Longest batch whose candidates stay below BATCH_ROWS, at least one corner. Around a corner there are
    no more candidates than ``vectors``, however many rows they hold."""
    need: dict[tuple[int, ...], int] = {}
    total = 0
    for t, corner in enumerate(corners):
        mine = min((t + 1) * k, vectors)
        total += mine - need.get(corner, 0)
        need[corner] = mine
        if total > BATCH_ROWS and t:
            return t
    return len(corners)


def _entries(vectors: DataFrame, corners: list[tuple[int, ...]], m: int, extra: list[list]) -> DataFrame:
    """Every vector once per distinct corner, with its distance ``d`` and two numbers of the corner."""
    table = F.array(*[
        F.struct(F.lit(i).alias("c"), F.array(*[F.lit(b) for b in bits]).alias("bits"),
                 F.lit(float(extra[0][i])).alias("cut"), F.lit(extra[1][i]).alias("need"))
        for i, bits in enumerate(corners)
    ])
    each = spread(vectors, "vec").select("vec", "left", "terms", F.explode(table).alias("_c"))
    return each.select("vec", "left", "_c.c", "_c.cut", "_c.need", _corner_distance(F.col("_c.bits"), m).alias("d"))


def _cuts(vectors: DataFrame, total: int, corners: list[tuple[int, ...]], needs: list[int], m: int) -> list[float]:
    """A distance per corner that surely covers the vectors it may take; infinity where that is
    not worth a look or the estimate falls short."""
    none = [float("inf")] * len(corners)
    if total * len(corners) <= 4 * BATCH_ROWS:
        return none
    # a vector holds at least one row, so ``need`` vectors are always enough
    grid = [2.0 ** -(j / 2) for j in range(28)]
    found = {
        r["c"]: r["q"] for r in _entries(vectors, corners, m, [none, needs]).groupBy("c").agg(
            F.percentile_approx("d", F.array(*[F.lit(g) for g in grid]), F.lit(10_000)).alias("q")).collect()
    }
    cuts = []
    for c, need in enumerate(needs):
        enough = [q for g, q in zip(grid, found[c]) if g >= 1.05 * need / total + 0.0003]
        cuts.append(enough[-1] if enough else float("inf"))
    got = {
        r["c"]: r["n"] for r in _entries(vectors, corners, m, [cuts, needs]).filter("d <= cut")
        .groupBy("c").count().withColumnRenamed("count", "n").collect()
    }
    return [cut if got.get(c, 0) >= min(needs[c], total) else float("inf") for c, cut in enumerate(cuts)]


def _batch_runs(vectors: DataFrame, batch: list[tuple[int, ...]], k: int, m: int, first: int) -> DataFrame:
    """(vec, cluster_id, take): how many rows of each vector go to each corner of the batch."""
    by_corner = _needs(batch, k)
    corners = list(by_corner)
    needs = [by_corner[c] for c in corners]
    turns = [corners.index(c) for c in batch]
    total = vectors.count()
    cuts = _cuts(vectors, total, corners, needs, m)
    near = _entries(vectors, corners, m, [cuts, needs]).filter(F.col("d") <= F.col("cut"))
    # top vectors per corner in two rounds, so a heavily tied corner is not sorted in one task
    slices = shuffle_partitions(vectors.sparkSession)
    near = near.withColumn("_slice", F.pmod(F.xxhash64("vec"), F.lit(slices)))
    for group in (["c", "_slice"], ["c"]) if total > 2 * BATCH_ROWS else (["c"],):
        before = F.sum("left").over(
            W.partitionBy(*group).orderBy("d", "vec").rowsBetween(W.unboundedPreceding, -1))
        near = near.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < F.col("need"))

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, uniques = pd.factorize(pdf["vec"], sort=True)
        left = np.zeros(len(uniques), dtype=np.int64)
        left[codes] = pdf["left"].to_numpy()
        order = np.lexsort((codes, pdf["d"].to_numpy(), pdf["c"].to_numpy()))
        codes, corner = codes[order], pdf["c"].to_numpy()[order]
        queue = {
            c: codes[np.searchsorted(corner, c):np.searchsorted(corner, c, side="right")] for c in set(turns)
        }
        # all before a corner's head is used up: a turn looks at few more vectors than it takes
        head = dict.fromkeys(queue, 0)
        parts = []
        for t, c in enumerate(turns):
            window = 2 * k
            while True:
                mine = queue[c][head[c]:head[c] + window]
                free = left[mine]
                rows = np.cumsum(free)
                if head[c] + window >= len(queue[c]) or rows[-1] >= k:
                    break
                window *= 4
            take = np.clip(k - (rows - free), 0, free)
            hit = np.flatnonzero(take)
            left[mine[hit]] -= take[hit]
            if len(hit):
                head[c] += hit[-1]
            parts.append((uniques[mine[hit]], np.full(len(hit), first + t), take[hit]))
        vec, cluster, take = (np.concatenate(x) for x in zip(*parts))
        return pd.DataFrame({"vec": vec, "cluster_id": cluster, "take": take})

    # one task on purpose: at most BATCH_ROWS candidate vectors, see _batch_size
    return near.select("c", "d", "vec", "left").withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(
        resolve, "vec binary, cluster_id bigint, take bigint")


def _assign_rows(rows: DataFrame, runs: DataFrame, rid: str, k: int, last: int) -> DataFrame:
    """Hand the rows of each vector to its clusters by position.

    A run is at most k rows long, so in buckets of k positions it touches at most two: the join
    is an equi-join however many rows a vector has.
    """
    upto = F.sum("take").over(W.partitionBy("vec").orderBy("cluster_id").rowsBetween(W.unboundedPreceding, 0))
    spans = runs.withColumn("_end", upto).withColumn("_start", F.col("_end") - F.col("take"))
    buckets = F.explode(F.sequence(F.floor(F.col("_start") / k), F.floor((F.col("_end") - 1) / k)))
    spans = spans.select(
        F.col("vec").alias("_vec"), "cluster_id", "_start", "_end", buckets.alias("_bucket"))
    placed = positions_within(rows.select(rid, "vec"), ["vec"], rid).withColumn(
        "_at", F.floor(F.col("pos") / k))
    on = (
        (F.col("vec") == F.col("_vec")) & (F.col("_at") == F.col("_bucket"))
        & (F.col("pos") >= F.col("_start")) & (F.col("pos") < F.col("_end"))
    )
    return placed.join(spans, on, "left").select(
        rid, F.coalesce("cluster_id", F.lit(last)).cast("bigint").alias("cluster_id"))


def cached_clusters(df: DataFrame, qis: list[QI], k: int, strategy: str = "batched",
                    root: str | None = None, rid: str = "rid") -> DataFrame:
    """Cluster assignment from the store, computed and stored on a miss. The key covers the
    content of the table, so changed data never meets old clusters."""
    key = f"{fingerprint(df, qis, k, rid)}-{strategy}"
    found = load_clusters(df.sparkSession, key, root)
    if found is None:
        save_clusters(microaggregate(df, qis, k, strategy, rid), key, root)
        found = load_clusters(df.sparkSession, key, root)
    return found
