"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

Codes: the leading principal directions of a bounded sample, turned by an iterative-quantisation
rotation, give one sign bit each. A code is cut into substrings, and each block of the index has one
sorted table per substring. If a code lies within Hamming radius r of the query's, at least one
substring lies within floor(r / substrings), so probing those buckets in every table retrieves every
code within r. The radius grows by whole steps until ``pool`` codes of the block are certain to be
found, and all of them are reranked by the inner product of the original vectors in double precision.

Layout: every row is indexed. Rows are dealt by a hash of id and place into blocks of about
``block_rows``, the stated queries into slices of about ``slice_rows``, and a task gets one block with
one slice: a row is shuffled once per slice and a query once per block, never once per pair. A table
of a block holds, per value of a substring that is asked for, one bitmap of the rows within the probed
flips, so probing is a union of ``substrings`` bitmaps. A block returns the best ``k`` per query, and
one window keeps the best of all.

The sample (``FIT_ROWS`` rows with the smallest seeded hash) only shapes the codes; recall is measured
against brute force in the tests.

Defined results: vectors that are NULL, zero, of another length than most, or hold NULL or non-finite
components take no part, as query or as candidate. Rows that repeat an id are the same candidate only
if they are the query's own id, which is left out. Queries that repeat an id count once, with the
smallest of their vectors. With fewer than k candidates all are returned. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilspark.llm.common import md5_of, query, table
from veilspark.runtime import materialise, shuffle_partitions

#: Rows the rotation is learned from; the bound of what the driver sees.
FIT_ROWS = 4_000
BITS = 64
SUBSTRINGS = 8
BLOCK_ROWS = 16_384
SLICE_ROWS = 4_096
#: Codes each block reranks per query: at least this many, and at least this share of the block.
POOL = 400
POOL_SHARE = 0.2


def usable(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Rows whose vectors take part."""
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vec, lambda x: x != 0)
    return df.filter(F.col(vec).isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.coalesce(some, F.lit(False)))


def learn_codes(sample: np.ndarray, bits: int, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) whose signs are the code: principal directions times a learned rotation."""
    mean = sample.mean(axis=0)
    x = sample - mean
    width = min(bits, x.shape[1])
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    base = np.zeros((x.shape[1], width))
    base[:, :min(width, len(vt))] = vt[:width].T
    v = x @ base
    turn, _ = np.linalg.qr(np.random.default_rng(7).normal(size=(width, width)))
    for _ in range(rounds):
        u, _, wt = np.linalg.svd(np.sign(v @ turn).T @ v)
        turn = (u @ wt).T
    return mean, base @ turn


def code_words(x: np.ndarray, mean: np.ndarray, proj: np.ndarray, substrings: int) -> np.ndarray:
    """Codes as an array (rows, substrings) of small integers."""
    bits = ((x - mean) @ proj > 0).astype(np.uint16)
    pad = -bits.shape[1] % substrings
    bits = np.pad(bits, ((0, 0), (0, pad))).reshape(len(x), substrings, -1)
    return (bits << np.arange(bits.shape[2], dtype=np.uint16)).sum(axis=2, dtype=np.uint16)


_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


class BlockIndex:
    """One table per substring over the codes of a block, for the codes that will be asked."""

    def __init__(self, codes: np.ndarray, asked: np.ndarray, width: int):
        self.codes, self.width = codes, width
        self.values, self.where = zip(*(np.unique(c, return_inverse=True) for c in asked.T))
        self.tables: dict[int, list[np.ndarray]] = {}
        self.flips = 0

    def table(self, flips: int) -> list[np.ndarray]:
        """Per substring a bitmap of rows for each asked value: those at most ``flips`` bits from it."""
        if flips not in self.tables:
            self.tables[flips] = [
                np.packbits(np.stack([_ONES[c ^ v] <= flips for v in values]), axis=1)
                for c, values in zip(self.codes.T, self.values)]
        return self.tables[flips]

    def within(self, nr: int, flips: int) -> np.ndarray:
        """Every row one of whose substrings is within ``flips`` of the asked code number ``nr``; that
        is every code within radius substrings * (flips + 1) - 1."""
        hit = np.bitwise_or.reduce([t[w[nr]] for t, w in zip(self.table(flips), self.where)])
        return np.flatnonzero(np.unpackbits(hit, count=len(self.codes)))

    def pool(self, nr: int, code: np.ndarray, least: int) -> np.ndarray:
        """Every row within the smallest radius that holds ``least`` rows, or all rows.

        Probing starts at the flips the code before needed: more flips than necessary retrieve more
        rows, but leave the same ones within the radius."""
        for flips in range(self.flips, self.width + 1):
            rows = self.within(nr, flips)
            far = _ONES[self.codes[rows] ^ code].sum(axis=1, dtype=np.int64)
            if (far < len(code) * (flips + 1)).sum() >= least or len(rows) == len(self.codes):
                self.flips = flips
                least = min(least, len(far))
                return rows[far <= np.partition(far, least - 1)[least - 1]]
        return np.arange(len(self.codes))


def search(df: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding",
           bits: int = BITS, substrings: int = SUBSTRINGS, block_rows: int = BLOCK_ROWS,
           slice_rows: int = SLICE_ROWS, pool: int = POOL, pool_share: float = POOL_SHARE,
           fit_rows: int = FIT_ROWS) -> DataFrame:
    """The ``k`` nearest rows of ``df`` found for each row of ``queries`` by inner product."""
    spark = df.sparkSession
    kind = "array<float>" if dict(df.dtypes)[vec] == "array<float>" else "array<double>"
    plain = lambda x: usable(x, vec).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec).cast(kind).alias("v")).filter(F.col("id").isNotNull())
    # written, so that a row keeps its block when a lost task is run again
    rows = materialise(plain(df).withColumn("h", F.xxhash64("id", F.monotonically_increasing_id())))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n_rows = dims["d"], dims["count"]
    rows = rows.filter(F.size("v") == d)
    asked = materialise(plain(queries).filter(F.size("v") == d).groupBy("id").agg(F.min("v").alias("v")))
    sample = rows.select("id", "v").orderBy(md5_of("fit", F.col("id")), "v").limit(fit_rows).toPandas()["v"]
    mean, proj = learn_codes(np.stack(sample.tolist()).astype(float), bits)
    width = -(-proj.shape[1] // substrings)

    def answer(cand: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        res = []
        if len(cand) and len(ask):
            ids, v = cand["id"].to_numpy(np.int64), np.stack(cand["v"].tolist()).astype(np.float64)
            asked_v = np.stack(ask["v"].tolist()).astype(np.float64)
            codes = code_words(asked_v, mean, proj, substrings)
            index = BlockIndex(code_words(v, mean, proj, substrings), codes, width)
            least = max(pool, int(pool_share * len(ids)))
            for nr, (qid, q, code) in enumerate(zip(ask["id"].to_numpy(np.int64), asked_v, codes)):
                near = index.pool(nr, code, least)
                near = near[ids[near] != qid]
                score = v[near] @ q
                if len(near) > k:
                    keep = score >= np.partition(score, len(score) - k)[len(score) - k]
                    near, score = near[keep], score[keep]
                best = np.lexsort((ids[near], -score))[:k]
                res.append((np.full(len(best), qid), ids[near][best], score[best]))
        cols = [np.concatenate(x) for x in zip(*res)] if res else [np.empty(0)] * 3
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols)))

    # a stated query set against all rows, in blocks
    blocks, slices = max(1, -(-n_rows // block_rows)), max(1, -(-asked.count() // slice_rows))
    parts = max(shuffle_partitions(spark), blocks * slices)
    cand = rows.select(F.pmod("h", F.lit(blocks)).cast("int").alias("c"),
                       F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("q"), "id", "v")
    ask = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("c"),
                       F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("q"), "id", "v")
    found = cand.repartition(parts, "c", "q").groupBy("c", "q").cogroup(
        ask.repartition(parts, "c", "q").groupBy("c", "q")).applyInPandas(answer, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


@query("op8_nearest_vectors")
def op8(spark, sf_dir):
    """Rows whose vec_id is divisible by 20, against all rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % 20 == 0), 20)
