"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

The rows of every input partition are numbered in pieces of ``PIECE`` rows and put in a seeded random
order within their piece: the local permutation. How many rows each piece sends to each shard is a random
matrix whose row sums are the piece sizes and whose column sums are the shard sizes; drawn as the margins
of a uniform permutation, it is multivariate-hypergeometric. A row's place in its piece against the
running sums of the piece's matrix row says its shard. In its shard a row gets a second random key; the
shard is cut by that key into blocks, which are sorted and numbered: the second permutation. The outcome
is a uniform permutation of all rows cut into shards that differ by one row at most.

The matrix is drawn by a two-level tree: one task splits the shard sizes among about sqrt(pieces) groups
of pieces, then each group splits its share among its own. Neither the driver nor a task sees the whole
matrix. Rows move once, keyed by (shard, block); sorting within pieces needs no exchange, since pieces
are runs of one partition.

The draw depends on the seed and on how the input is split into partitions; both, and each row's place,
are written before anything is drawn, so a task that is run again gives the same rows. Equal rows and
equal texts are rows of their own and fall independently.

Defined results: NULL text has no bytes and the checksum of none. Rows with NULL or repeated ids are rows
of their own. With fewer rows than shards some shards are empty. An empty table gives no rows. In
``shuffle_into_shards`` an input column named like an output column is replaced by it; other columns
are carried whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilspark.llm.common import query, quoted, table
from veilspark.runtime import materialise

SHARDS = 40
SEED = "shards-1"
#: Rows of a piece, and about the rows of a block of a shard: a power of two.
PIECE = 1 << 17
#: Bytes that a document takes besides its text.
OVERHEAD = 16
#: numpy draws exactly up to this population; above it the weights are laid out around the mode.
POPULATION = 10 ** 9


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Rows per shard: at most one apart, larger ones first."""
    return np.array([rows // shards + (j < rows % shards) for j in range(shards)], dtype=np.int64)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int, limit: int = POPULATION) -> int:
    """How many of ``sample`` draws without replacement are among the ``good``; any population."""
    if good + bad < limit:
        return int(rng.hypergeometric(good, bad, sample)) if sample and good else 0
    least, most = max(0, sample - bad), min(good, sample)
    if least == most:
        return least
    total = good + bad
    mode = min(max((sample + 1) * (good + 1) // (total + 2), least), most)
    share = good / total
    spread = math.sqrt(sample * share * (1 - share) * (total - sample) / max(total - 1, 1)) + 1
    low, high = max(least, mode - int(14 * spread) - 20), min(most, mode + int(14 * spread) + 20)
    k = np.arange(low, high, dtype=np.float64)
    # p(k + 1) / p(k), exact up to rounding; beyond the window the tails are below 1e-20
    ratio = (good - k) * (sample - k) / ((k + 1) * (bad - sample + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(np.log(ratio))])
    weights = np.exp(logs - logs.max())
    sums = np.cumsum(weights)
    return low + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def deal(rng: np.random.Generator, columns: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Random matrix with the given margins, as a uniform permutation would fill it."""
    left, out = columns.copy(), np.zeros((len(rows), len(columns)), np.int64)
    for i, n in enumerate(rows):
        rest, need = int(left.sum()), int(n)
        for j in range(len(columns)):
            rest -= int(left[j])
            out[i, j] = hypergeometric(rng, int(left[j]), rest, need)
            need -= int(out[i, j])
        left -= out[i]
    return out


def generator(*parts) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:16], "big"))


def matrix_rows(pieces: DataFrame, shards: int, seed: str) -> DataFrame:
    """(piece, upto): running sums of each piece's row of the matrix. ``pieces`` is (piece, n)."""
    total = pieces.agg(F.count(F.lit(1)).alias("p"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    sizes, groups = shard_sizes(total["n"], shards), max(1, math.isqrt(total["p"]))
    grouped = pieces.withColumn("g", F.pmod(F.xxhash64("piece"), F.lit(groups)).cast("int"))

    def top(margins: pd.DataFrame) -> pd.DataFrame:
        margins = margins.sort_values("g")
        return pd.DataFrame({"g": margins["g"], "share": deal(generator(seed, "top"), sizes, margins["n"].to_numpy()).tolist()})

    def inner(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("piece")
        drawn = deal(generator(seed, "group", key[0]), np.array(own["share"].iloc[0], np.int64), own["n"].to_numpy())
        return pd.DataFrame({"piece": own["piece"], "upto": np.cumsum(drawn, axis=1).tolist()})

    # written: later draws rest on these counts
    margins = grouped.groupBy("g").agg(F.sum("n").alias("n")).withColumn("all", F.lit(0))
    shares = materialise(margins.groupBy("all").applyInPandas(top, "g int, share array<bigint>"))
    return materialise(grouped.join(shares, "g").groupBy("g").applyInPandas(inner, "piece long, upto array<bigint>"))


def shuffle_into_shards(df: DataFrame, shards: int = SHARDS, seed: str = SEED, piece_rows: int = PIECE,
                        shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Rows of ``df`` with their ``shard`` (int) and gapless ``slot`` (long) in it."""
    bits = piece_rows.bit_length() - 1
    names = [c for c in df.columns if c not in (shard, slot)]
    row = F.struct(*[df[quoted(c)] for c in names]) if names else F.struct(F.lit(0).alias("_"))
    at = F.monotonically_increasing_id()
    placed = df.select(row.alias("row"), at.alias("at")).select(
        "row", "at", F.shiftright("at", bits).alias("piece"), F.xxhash64(F.lit(f"{seed}|local"), "at").alias("key"))
    # sorted pieces are runs of piece_rows rows again, so a row's new number holds its place in the piece
    placed = materialise(
        placed.sortWithinPartitions("piece", "key", "at").withColumn("place", F.monotonically_increasing_id())
        .select("row", "at", "piece", F.col("place").bitwiseAND(F.lit(piece_rows - 1)).alias("place")))
    pieces = materialise(placed.groupBy("piece").agg(F.count(F.lit(1)).alias("n")))
    rows = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-rows // (shards * piece_rows)))
    key = F.xxhash64(F.lit(f"{seed}|shard"), "at")
    # the matrix has one row a piece, at most piece_rows rows of the left side each
    dealt = materialise(placed.join(matrix_rows(pieces, shards, seed), "piece").select(
        "row", "at", F.size(F.filter("upto", lambda x: x <= F.col("place"))).alias("s"), key.alias("key"))
        .withColumn("block", F.pmod(F.shiftright("key", 8), F.lit(blocks)).cast("int")))
    counts = dealt.groupBy("s", "block").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("s").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("s", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    local = F.row_number().over(W.partitionBy("s", "block").orderBy("key", "at"))
    return dealt.withColumn("local", local).join(offsets, ["s", "block"]).select(
        *[F.col("row").getField(c).alias(c) for c in names], F.col("s").cast("int").alias(shard),
        (F.col("start") + F.col("local") - 1).cast("long").alias(slot))


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Write whole rows, one folder per shard, each file a run of its slots in order."""
    shard, slot = options.get("shard", "shard"), options.get("slot", "slot")
    piece = F.floor(F.col(slot) / options.get("piece_rows", PIECE))
    (shuffle_into_shards(df, **options).repartition(F.col(shard), piece).sortWithinPartitions(shard, slot)
     .write.partitionBy(shard).mode("overwrite").parquet(path))


@query("op11_uniform_shards")
def op11(spark, sf_dir):
    """All documents: the shard and slot of each."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shuffle_into_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
