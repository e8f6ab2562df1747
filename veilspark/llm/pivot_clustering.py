"""Centroid clustering in integers, with Ptolemaic pivots to skip distances that cannot win.

Ptolemy's inequality gives, for a vector x, a centroid c and any pivots p and s,

    d(x, c) >= |d(x, p) d(c, s) - d(x, s) d(c, p)| / d(p, s).

The pivots are fixed, so the distances of every vector to them are computed once and written beside the
vector. A round computes the centroids' distances to the pivots, bounds every pair of vector and centroid
from cached numbers alone, and computes exactly only what the bound leaves: the centroid with the smallest
bound first, then every other one whose bound is not above that distance. Bounds are lowered by more than
their rounding error, so a nearest centroid, ties included, is never skipped. Distances, sums and floors
are exact integers; only the bounds are floating point.

A round is one pass over the written vectors in which a task sends one count and one sum per centroid.
What passes the driver is the centroids and the pivots: ``k`` and ``PIVOTS`` vectors.

Defined results: vectors that are NULL, of another length, or hold NULL or non-finite components take no
part. A vector with NULL id does, and is the last choice as a start. Rows that repeat an id are rows of
their own. Starts are rows, so with fewer than ``k`` vectors there is a centroid per row, and equal rows
may start equal centroids, of which the later ones stay empty. An empty table gives no rows. Integers of
``LARGEST`` or more in size are refused with an error, because their squared distances leave 64 bits.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import query, table
from veilspark.runtime import inline_rows, materialise

DIMS = 64
SCALE = 1024
K = 8
ROUNDS = 10
SEED = "3"
#: Fixed pivots; every pair of them gives a bound.
PIVOTS = 8
#: 64 squares of a difference of two integers below this fit in 63 bits.
LARGEST = 1 << 27
#: A float64 product of integers is exact while no sum of DIMS squares passes 2^53.
EXACT = 1 << 22
#: Above the relative rounding error of a bound, with room: a dozen operations of 2^-53 each.
SLACK = 2.0 ** -46


def kept_vectors(df: DataFrame, id_col: str, vec: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): the vectors that take part, as integers."""
    x = F.transform(F.col(vec), lambda c: c.cast("double"))
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform("x", lambda c: F.floor(c * scale))
    too_far = F.exists("x", lambda c: F.abs(c) * scale >= LARGEST - 1)
    kept = df.filter((F.size(vec) == dims) & ~F.coalesce(odd, F.lit(True)))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).select("vec_id", F.when(
        too_far, F.raise_error(F.lit(f"a component of {LARGEST // scale} or more has no exact distance"))
        .cast("array<bigint>")).otherwise(whole).alias("v"))


def starts(vectors: DataFrame, n: int, seed: str) -> np.ndarray:
    """The ``n`` rows with the smallest hash of seed and id, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(order.asc_nulls_last(), "v").limit(n).select("v").collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def matrix(column: pa.Array, dims: int, kind) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims).astype(kind, copy=False)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distance of every row of ``a`` to the vector or rows ``b``."""
    diff = a - b
    if len(diff) and np.abs(diff).max() <= EXACT:
        diff = diff.astype(np.float64)
    return np.einsum("ij,ij->i", diff, diff).astype(np.int64)


def lower_bounds(to_pivots: np.ndarray, centre_pivots: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """A number at most the distance of every vector to every centroid, from pivot distances alone."""
    best = np.zeros((len(to_pivots), len(centre_pivots)))
    for i in range(len(pivots)):
        for j in range(i):
            if pivots[i, j] > 0:
                a = to_pivots[:, i, None] * centre_pivots[None, :, j]
                b = to_pivots[:, j, None] * centre_pivots[None, :, i]
                np.maximum(best, (np.abs(a - b) - SLACK * (a + b)) / pivots[i, j], out=best)
    return best * (1 - SLACK)


def nearest(v: np.ndarray, to_pivots: np.ndarray, centres: np.ndarray, pivots: np.ndarray,
            count: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of every vector's nearest centroid; ties go to the smaller number."""
    centre_pivots = np.sqrt(np.stack([squared(centres, p) for p in pivots], axis=1).astype(np.float64))
    among = np.sqrt(np.stack([squared(pivots, p) for p in pivots]).astype(np.float64))
    low = lower_bounds(to_pivots, centre_pivots, among)
    number = low.argmin(axis=1)
    dist = squared(v, centres[number])
    first = number.copy()
    bound = low * low * (1 - SLACK)
    for j, centre in enumerate(centres):
        rows = np.flatnonzero((bound[:, j] <= dist) & (first != j))
        if count is not None:
            count.append(len(rows))
        far = squared(v[rows], centre)
        better = (far < dist[rows]) | ((far == dist[rows]) & (j < number[rows]))
        number[rows[better]], dist[rows[better]] = j, far[better]
    return number, dist


def cluster(df: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE,
            seed: str = SEED, n_pivots: int = PIVOTS, id_col: str = "vec_id",
            vec: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector after ``rounds`` rounds, and the final centroids."""
    spark = df.sparkSession
    vectors = kept_vectors(df, id_col, vec, dims, scale)
    centres = starts(vectors, k, seed)
    out = "vec_id long, cluster int, distance long"
    if not len(centres):
        return spark.createDataFrame([], out), centres
    pivots = starts(vectors, n_pivots, f"pivot-{seed}")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column("v"), dims, np.int64)
            far = np.sqrt(np.stack([squared(v, p) for p in pivots], axis=1).astype(np.float64))
            lists = pa.ListArray.from_arrays(np.arange(0, far.size + 1, far.shape[1], dtype=np.int32), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), lists], ["vec_id", "v", "p"])

    measured = materialise(vectors.mapInArrow(measure, "vec_id long, v array<bigint>, p array<double>"))

    def place(b: pa.RecordBatch, centres: np.ndarray):
        v = matrix(b.column("v"), dims, np.int64)
        return v, *nearest(v, matrix(b.column("p"), len(pivots), np.float64), centres, pivots)

    for _ in range(rounds):
        def sums(batches: Iterator[pa.RecordBatch], centres=centres) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(len(centres), np.int64), np.zeros((len(centres), dims), np.int64)
            for b in batches:
                v, number, _ = place(b, centres)
                n += np.bincount(number, minlength=len(centres))
                for j in np.unique(number):
                    total[j] += v[number == j].sum(axis=0)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))],
                ["cluster", "n", "total"])

        parts = measured.mapInArrow(sums, "cluster int, n long, total array<bigint>")
        # totals of all tasks may pass 64 bits
        added = parts.select("cluster", "n", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(
            F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
        centres = centres.copy()
        for r in added:
            centres[r["cluster"], r["i"]] = int(r["x"]) // r["n"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, number, dist = place(b, centres)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(dist)], ["vec_id", "cluster", "distance"])

    return materialise(measured.mapInArrow(assign, out)), centres


def report(placed: DataFrame, centres: np.ndarray) -> DataFrame:
    """Each vector with its cluster's and the whole inertia and its final centroid's digest."""
    spark = placed.sparkSession
    inertia = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [(j, inertia.get(j, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
            for j, c in enumerate(centres)]
    if not rows:
        return placed.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    per = inline_rows(spark, ["c", "cluster_inertia", "inertia", "centroid_sha256"], rows).select(
        F.col("c").alias("cluster"), F.col("cluster_inertia").cast("long"), F.col("inertia").cast("long"), "centroid_sha256")
    # one row per centroid
    return placed.join(F.broadcast(per), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    dist = "list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v.v, c.c)])"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(vv) AS v, min(d) AS distance, arg_min(j, (d, j)) AS j FROM (
    SELECT v.r, v.vec_id, v.v AS vv, c.j, {dist}::BIGINT AS d FROM vectors v, c{r} c) GROUP BY r)""")
        if r < ROUNDS:
            steps.append(f"""m{r} AS MATERIALIZED (
  SELECT j, list(m ORDER BY i) AS c FROM (
    SELECT j, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (
      SELECT j, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (
        SELECT j, unnest(v) AS x, unnest(range({DIMS})) AS i FROM a{r}) GROUP BY j, i)) GROUP BY j),
c{r + 1} AS MATERIALIZED (SELECT c{r}.j, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (j))""")
    return f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(x::DOUBLE * {SCALE}) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE len(embedding) = {DIMS}
    AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x::DOUBLE)]) = {DIMS}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v) - 1 AS j, v AS c FROM vectors
  QUALIFY j < {K}),
{",".join(steps)},
per AS (SELECT j, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM a{ROUNDS} GROUP BY j)
SELECT vec_id, CAST(j AS INTEGER) AS cluster, distance, cluster_inertia,
  CAST((SELECT sum(distance) FROM a{ROUNDS}) AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN per USING (j) JOIN c{ROUNDS} USING (j)"""


OP13_SQL = _sql()


@query("op13_pivot_clustering", OP13_SQL)
def op13(spark, sf_dir):
    """All vectors: eight clusters after ten rounds."""
    return report(*cluster(table(spark, sf_dir, "embeddings")))
