"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents are put in a seeded order and cut into blocks by the leading hex digits of
that order's key. A source's target becomes an exact quota of block draws: each block once per full
pass, and the first blocks of the order once more until the target is met. The quotas are split among
the output shards by a binary tree: at each node half of the node's block draws, taken without
replacement by the rank of a seeded hash, goes left, so the counts per source are exactly
multivariate-hypergeometric. Draws are disjoint, and a shard shuffles locally by a seeded key.

Only DataFrame functions are used. What grows with the rows is one scan for the sizes, one aggregate
by (source, block) and one join with the block table; the tree works on blocks alone.

Defined results: NULL text has size 0. NULL source is a source of its own, last in order. Repeated
rows are rows of their own. A source without words has target 0. An empty table gives an empty result.
Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilspark.llm.common import md5_of, n_words, query, table
from veilspark.runtime import materialise

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SHARDS = 64
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Per source (``skey``): its words, and the words the mix takes of it.

    Targets share the corpus size by weight. A source is capped at ``max_repeat`` times its size and
    the excess is shared again by weight; that fixed point is a water level, found by one running sum
    over the sources in order of cap per weight.
    """
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    per = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("_n", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = per.withColumn("_w", w).withColumn("_cap", F.col("source_size") * max_repeat)
    by = W.orderBy(F.col("_cap") / F.col("_w"), "_n")
    per = (
        per.withColumn("_total", F.sum("source_size").over(W.partitionBy()))
        .withColumn("_full", F.coalesce(F.sum("_cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_left", F.sum("_w").over(by.rowsBetween(0, W.unboundedFollowing)))
    )
    level = (F.col("_total") - F.col("_full")).cast("double") / F.col("_left").cast("double")
    per = per.withColumn("_level", F.when(level * F.col("_w") <= F.col("_cap"), level))
    per = per.withColumn("_level", F.max("_level").over(W.partitionBy()))
    return per.select(
        "skey", "source_size",
        F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w")).alias("target"))


def split_tree(units: DataFrame, shards: int, seed: str) -> DataFrame:
    """Assign block draws (skey, block, pass) to ``shards`` (a power of two) by halving nodes."""
    out = units.withColumn("shard", F.lit(0))
    for level in range((shards - 1).bit_length()):
        node = W.partitionBy("shard")
        rank = F.row_number().over(node.orderBy(md5_of(seed, level, F.col("skey"), F.col("block"), F.col("pass"))))
        right = (rank * 2 > F.count(F.lit(1)).over(node) + F.lit(1)).cast("int")
        out = out.withColumn("_right", right).withColumn("shard", F.col("shard") * 2 + F.col("_right")).drop("_right")
    return out


def plan_mix(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, shards: int = SHARDS,
             digits: int = 2, seed: str = SEED) -> DataFrame:
    """One row per document: size, its source's size and target, ``copies`` drawn and their shards.

    ``digits`` hex digits number the blocks of a source. A source's words come within half a document
    of its target.
    """
    sizes = docs.select(
        "doc_id", "source", F.concat(F.lit("s"), "source").alias("_s"), n_words(F.col("text")).alias("size"),
    ).select(
        "doc_id", "source", F.coalesce("_s", F.lit("~")).alias("skey"), "size",
        md5_of(seed, F.col("doc_id")).alias("order_key"))
    sizes = materialise(sizes.withColumn("block", F.substring("order_key", 1, digits)))
    targets = source_targets(sizes, weights, max_repeat)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    order = W.partitionBy("skey").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = (
        sizes.groupBy("skey", "block").agg(F.sum("size").alias("block_size"))
        .withColumn("block_start", F.coalesce(F.sum("block_size").over(order), F.lit(0)))
        .join(targets, "skey")
        .withColumn("passes", whole.cast("int"))
        .withColumn("rest", (F.floor("target") - F.col("passes") * F.col("source_size")).cast("long"))
    )
    more = (F.col("block_start") < F.col("rest")).cast("int")
    units = blocks.select(
        "skey", "block", F.explode(F.sequence(F.lit(0), F.col("passes") + more)).alias("pass"),
        (F.col("passes") + more).alias("_n")).filter(F.col("pass") < F.col("_n")).drop("_n")
    drawn = split_tree(units, shards, seed).groupBy("skey", "block").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("_shards"))
    plan = materialise(blocks.join(drawn, ["skey", "block"], "left"))
    rows = sizes.join(plan, ["skey", "block"])
    inside = F.col("block_start") + F.col("block_size") <= F.col("rest")
    cut = ~inside & (F.col("block_start") < F.col("rest"))
    before = F.col("block_start") + F.coalesce(
        F.sum("size").over(W.partitionBy("skey").orderBy("order_key", "doc_id", "size")
                           .rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # only each source's one block that the target cuts through needs an order of its rows
    edge = rows.filter(cut).withColumn("_extra", (2 * before + F.col("size") <= 2 * F.col("rest")).cast("int"))
    rows = rows.filter(~cut).withColumn("_extra", inside.cast("int")).unionByName(edge)
    return rows.withColumn("copies", F.col("passes") + F.col("_extra")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", "order_key",
        F.when(F.col("copies") > 0, F.slice(F.col("_shards"), F.lit(1), F.col("copies")))
        .otherwise(F.array().cast("array<int>")).alias("shards"))


def draws(plan: DataFrame, seed: str = SEED) -> DataFrame:
    """One row per drawn copy: its shard and the key of the shard's local shuffle."""
    return plan.select("*", F.posexplode("shards").alias("copy", "shard")).drop("shards").withColumn(
        "shuffle_key", md5_of(seed, "local", F.col("doc_id"), F.col("copy")))


def write_mix(docs: DataFrame, path: str, **options) -> None:
    """Write the drawn copies of whole documents, one folder per shard, shuffled within it."""
    plan = plan_mix(docs, **options)
    taken = docs.join(draws(plan).select("doc_id", "copy", "shard", "shuffle_key"), "doc_id")
    (taken.repartition(F.col("shard"), F.substring("shuffle_key", 1, 1))
     .sortWithinPartitions("shard", "shuffle_key").drop("shuffle_key")
     .write.partitionBy("shard").mode("overwrite").parquet(path))


def _tree_sql() -> str:
    steps, last = [], "units"
    for level in range((SHARDS - 1).bit_length()):
        steps.append(f"""t{level} AS (
  SELECT skey, block, pass, shard * 2 + CASE WHEN
    row_number() OVER (PARTITION BY shard ORDER BY md5('{SEED}|{level}|' || skey || '|' || block || '|' || pass)) * 2
    > count(*) OVER (PARTITION BY shard) + 1 THEN 1 ELSE 0 END AS shard FROM {last})""")
        last = f"t{level}"
    return ",\n".join(steps) + f",\nfirsts AS (SELECT skey, block, shard FROM {last} WHERE pass = 0)"


def mix_sql(documents: str = "documents") -> str:
    return rf"""
WITH sizes AS (
  SELECT doc_id, source, coalesce('s' || source, '~') AS skey,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '~')) AS k, substr(k, 1, 2) AS block FROM {documents}),
per AS (
  SELECT skey, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM sizes GROUP BY skey, source),
w AS (SELECT *, [5, 2, 1][CAST(n % 3 + 1 AS INTEGER)] AS w, source_size * 3 AS cap FROM per),
lv AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING
      AND 1 PRECEDING), 0))::DOUBLE / (sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE
    AS level FROM w),
tg AS (
  SELECT skey, source_size, least(cap::DOUBLE, max(CASE WHEN level * w <= cap THEN level END) OVER () * w) AS target FROM lv),
bl AS (
  SELECT b.*, target, source_size, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes,
    floor(target)::BIGINT - CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END * source_size AS rest
  FROM (SELECT skey, block, sum(size) AS bs,
          coalesce(sum(sum(size)) OVER (PARTITION BY skey ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
        FROM sizes GROUP BY skey, block) b JOIN tg USING (skey)),
units AS (
  SELECT skey, block, p AS pass, 0 AS shard FROM bl,
    unnest(range(passes + CASE WHEN start < rest THEN 1 ELSE 0 END)) AS u(p)),
{_tree_sql()},
dc AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.passes, b.rest, b.block, b.skey,
    coalesce(sum(s.size) OVER (PARTITION BY s.skey ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sizes s JOIN bl b ON s.skey = b.skey AND s.block = b.block),
cp AS (
  SELECT *, passes + CASE WHEN rest > before AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END AS copies FROM dc)
"""


OP5_SQL = mix_sql() + """
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
  CASE WHEN copies > 0 THEN CAST(shard AS INTEGER) END AS first_shard
FROM cp LEFT JOIN firsts USING (skey, block)"""


@query("op5_mix_sources", OP5_SQL)
def op5(spark, sf_dir):
    """All documents: what the mix takes of each."""
    return plan_mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        F.get("shards", F.lit(0)).alias("first_shard"))


def mix_stage(spark, docs, sf_dir: str) -> DataFrame:
    """Pipeline stage: whole documents, each as often as it is drawn. Rows that repeat id, source and
    size are told apart by their order."""
    key = lambda size: F.xxhash64("doc_id", "source", size)
    plan = plan_mix(docs).select(key(F.col("size")).alias("_k"), "copies").groupBy("_k", "copies").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(W.partitionBy("_k").orderBy("copies"))
    runs = materialise(
        plan.select("_k", F.struct(upto.alias("upto"), "copies").alias("_r")).groupBy("_k")
        .agg(F.array_sort(F.collect_list("_r")).alias("_runs")).filter(F.element_at("_runs", -1)["copies"] > 0))
    # joined by the key alone and numbered after: one shuffle of the texts serves the join and the numbers
    rows = docs.withColumn("_k", key(n_words(F.col("text")))).join(runs, "_k").withColumn(
        "_nr", F.row_number().over(W.partitionBy("_k").orderBy("text")))
    copies = F.get(F.filter("_runs", lambda r: r["upto"] >= F.col("_nr")), F.lit(0))["copies"].cast("int")
    rows = rows.select(*docs.columns, copies.alias("_copies")).filter("_copies > 0")
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_n")).drop("_n")
