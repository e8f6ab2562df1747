"""Materialisation, size-checked broadcasts and distributed ordering."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# A frame is broadcast by hint only when its counted rows stay below this.
BROADCAST_ROWS = 200_000
# Keys holding more than 1/HOT_SHARE of all rows; there can be at most HOT_SHARE of them.
HOT_SHARE = 1_000

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables: the session's checkpoint folder."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if sc.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="veilspark-")
    return _LOCAL_DIRS[sc.applicationId]


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage, survives lost executors, and gives the optimizer sizes, so its own broadcast
    threshold decides the joins downstream. They are sizes of compressed files: see ``by_shuffle``.
    """
    path = f"{shared_dir(df.sparkSession)}/veilspark/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for ``df`` when ``rows``, its counted size, is within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def by_shuffle(df: DataFrame) -> DataFrame:
    """Shuffle hint for a join with ``df``, which grows with the records. The optimizer takes the compressed
    files of a written table for the size of its rows: a byte may hold a row, and millions of them would be
    collected and broadcast by the driver."""
    return df.hint("merge")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all shuffle partitions, for work that multiplies them: a compact input may come
    in few splits."""
    return df.repartition(shuffle_partitions(df.sparkSession), *keys)


def evened(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` written once in as many files as there are shuffle partitions: for tables read again and
    again, whose own files may come in few splits."""
    return materialise(spread(df, *keys))


def inline_rows(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small driver-side list as a frame, without a Python worker."""
    cells = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*cells)))


def ranged(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` range-partitioned and sorted by ``keys``, written with each row's ``_part`` and
    0-based ``_index`` in it. Parts follow key order; a key that includes a unique column spreads
    even a value shared by many rows."""
    mark = F.monotonically_increasing_id()
    return materialise(
        df.repartitionByRange(shuffle_partitions(df.sparkSession), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mark", mark)
        .withColumn("_part", F.shiftright("_mark", 33).cast("int"))
        .withColumn("_index", F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mark")
    )


def ordered_positions(
    df: DataFrame, keys: list[str], out: str = "pos", weight: str | None = None
) -> DataFrame:
    """1-based position of every row in the total order of ``keys``, or the running sum of
    ``weight`` up to and including the row. Only one number per partition passes the driver."""
    parts = ranged(df, keys)
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    totals = {r["_part"]: r["s"] for r in parts.groupBy("_part").agg(size.alias("s")).collect()}
    starts, running = [], 0
    for part in range(max(totals, default=0) + 1):
        starts.append(running)
        running += totals.get(part, 0)
    # one folded literal, however many partitions there are
    offsets = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>")
    start = F.element_at(offsets, F.col("_part") + 1)
    if weight is None:
        local = F.col("_index") + 1
    else:
        local = F.sum(weight).over(
            W.partitionBy("_part").orderBy("_index").rowsBetween(W.unboundedPreceding, 0)
        )
    return parts.withColumn(out, (start + local).cast("bigint")).drop("_part", "_index")


def positions_within(df: DataFrame, group: list[str], rid: str, out: str = "pos") -> DataFrame:
    """0-based position of every row within its group, for groups of any size.

    Rows are numbered inside hash slices of a group; slice sizes give the offsets. The order
    is (slice, rid): fixed by the data, and no task ever sorts a whole hot group.
    """
    slices = max(64, shuffle_partitions(df.sparkSession))
    cut = df.withColumn("_slice", F.pmod(F.xxhash64(rid), F.lit(slices)).cast("int"))
    sizes = cut.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *group, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    local = F.row_number().over(W.partitionBy(*group, "_slice").orderBy(rid))
    return (
        cut.withColumn("_local", local)
        .join(offsets, [*group, "_slice"])
        .withColumn(out, (F.col("_start") + F.col("_local") - 1).cast("bigint"))
        .drop("_slice", "_local", "_start")
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL; the key columns come from the left."""
    other = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(other, on, how).drop(*[f"_r_{k}" for k in keys])


def join_members(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int,
                 n_groups: int) -> DataFrame:
    """Inner join of rows with one-row-per-key ``groups`` whose ``size`` counts their rows.

    Few groups are broadcast. Otherwise keys with more than total / HOT_SHARE rows, at most
    HOT_SHARE of them, are broadcast, and what is left is a join in which every key is small.
    """
    if n_groups <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), keys)
    limit = max(total // HOT_SHARE, 1)
    hot = F.broadcast(groups.filter(F.col(size) > limit))
    others = rows.join(F.broadcast(groups.filter(F.col(size) > limit).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(others.join(groups.filter(F.col(size) <= limit), keys))


def lookup(df: DataFrame, table: DataFrame, keys: list[str], rows: int, how: str = "inner") -> DataFrame:
    """Join a column with a lookup table of ``rows`` counted rows, one per key.

    A small table is broadcast and ``df`` does not move. For a large one the keys that hold more
    than 1/HOT_SHARE of ``df`` are found first and joined by broadcast, the others by shuffle.
    """
    if rows <= BROADCAST_ROWS:
        return df.join(F.broadcast(table), keys, how)
    counts = materialise(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hot = F.broadcast(counts.filter(F.col("_n") > max(total // HOT_SHARE, 1)).select(*keys))
    often = df.join(hot, keys, "left_semi").join(F.broadcast(table.join(hot, keys, "left_semi")), keys, how)
    return often.unionByName(df.join(hot, keys, "left_anti").join(table, keys, how))
