"""Micro-data tables and hierarchies over the sample schema. Bounds are declared constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.cells import number_text
from veilspark.operators.taxonomy import Taxonomy
from veilspark.sources.hierarchy import lines_from_list
from veilspark.spec import QI

# Declared hierarchies, leaf;parent;...;*
SEGMENT_LINES = [
    "BUILDING;HOME;*",
    "FURNITURE;HOME;*",
    "HOUSEHOLD;HOME;*",
    "AUTOMOBILE;INDUSTRY;*",
    "MACHINERY;INDUSTRY;*",
]
PRIORITY_LINES = [
    "1-URGENT;TOP;*",
    "2-HIGH;TOP;*",
    "3-MEDIUM;REST;*",
    "4-NOT SPECIFIED;REST;*",
    "5-LOW;REST;*",
]
TYPE_LINES = ["SMALL;SIZED;*", "MEDIUM;SIZED;*", "LARGE;SIZED;*", "ECONOMY;RANGE;*", "STANDARD;RANGE;*", "PROMO;RANGE;*"]
BRAND_LINES = [f"Brand#{i};B{i // 10};*" for i in range(1, 26)]
STATUS_LINES = ["F;CLOSED;*", "P;RUNNING;*", "O;RUNNING;*"]
RETURNFLAG_LINES = ["A;RETURNED;*", "R;RETURNED;*", "N;KEPT;*"]
LINESTATUS_LINES = ["F;*", "O;*"]
EVENT_LINES = ["view;PASSIVE;*", "error;PASSIVE;*", "click;ACTIVE;*", "signup;ACTIVE;*", "purchase;ACTIVE;*"]
FIRST_MONTH, LAST_MONTH = "1995-01-01", "2001-12-01"

TEMPERATURE_RANGE = "35.0_42.0"

_TAXES: dict[tuple, Taxonomy] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def nation_lines(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "nation").join(
        F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select(
        F.concat_ws(";", "n_name", "r_name", F.lit("*")).alias("line"),
        F.col("n_nationkey").cast("bigint").alias("ord"))


def supplier_lines(spark: SparkSession, sf: str) -> DataFrame:
    nations = nation_lines(spark, sf).withColumnRenamed("line", "_up")
    return table(spark, sf, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("ord")).select(
        F.concat_ws(";", "s_name", "_up").alias("line"), F.col("s_suppkey").alias("ord"))


def ragged_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Nations of the last region hang directly below the root."""
    lines = nation_lines(spark, sf)
    leaf = F.split("line", ";")[0]
    return lines.select(
        F.when(F.col("ord") % 5 == 4, F.concat_ws(";", leaf, F.lit("*"))).otherwise(F.col("line")).alias("line"), "ord")


def shared_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every third nation also belongs to a second region."""
    both = table(spark, sf, "nation").join(
        F.broadcast(table(spark, sf, "region")), (F.col("n_regionkey") + 1) % 5 == F.col("r_regionkey"))
    second = both.filter("n_nationkey % 3 = 0").select(
        F.concat_ws(";", "n_name", "r_name", F.lit("*")).alias("line"),
        (F.col("n_nationkey") + 100).cast("bigint").alias("ord"))
    return nation_lines(spark, sf).unionByName(second)


def month_lines(spark: SparkSession, sf: str) -> DataFrame:
    months = spark.range(1).select(F.posexplode(F.sequence(
        F.to_date(F.lit(FIRST_MONTH)), F.to_date(F.lit(LAST_MONTH)), F.expr("INTERVAL 1 MONTH"))).alias("ord", "day"))
    return months.select(
        F.concat_ws(";", F.date_format("day", "yyyy-MM"), F.date_format("day", "yyyy"), F.lit("*")).alias("line"),
        F.col("ord").cast("bigint").alias("ord"))


LINES = {
    "nation": nation_lines,
    "supplier": supplier_lines,
    "ragged": ragged_lines,
    "shared": shared_lines,
    "order_month": month_lines,
    "segment": lambda spark, sf: lines_from_list(spark, SEGMENT_LINES),
    "priority": lambda spark, sf: lines_from_list(spark, PRIORITY_LINES),
    "returnflag": lambda spark, sf: lines_from_list(spark, RETURNFLAG_LINES),
    "linestatus": lambda spark, sf: lines_from_list(spark, LINESTATUS_LINES),
    "event_type": lambda spark, sf: lines_from_list(spark, EVENT_LINES),
    "status": lambda spark, sf: lines_from_list(spark, STATUS_LINES),
    "type": lambda spark, sf: lines_from_list(spark, TYPE_LINES),
    "brand": lambda spark, sf: lines_from_list(spark, BRAND_LINES),
}


def taxonomy(spark: SparkSession, sf: str, attr: str) -> Taxonomy:
    key = (spark.sparkContext.applicationId, sf, attr)
    if key not in _TAXES:
        _TAXES[key] = Taxonomy.from_lines(LINES[attr](spark, sf), attr)
    return _TAXES[key]


def category(spark: SparkSession, sf: str, attr: str) -> QI:
    return QI(attr, "category", tax=taxonomy(spark, sf, attr))


ACCTBAL = QI("acctbal", "number", -1000.0, 10000.0, 2, widths=(1000.0,))
TOTALPRICE = QI("totalprice", "number", 0.0, 500000.0, 2, widths=(50000.0, 250000.0))
SIZE = QI("size", "number", 1.0, 50.0, 0, integer=True, widths=(10.0,))
PRICE = QI("retailprice", "number", 900.0, 1000.0, 1, widths=(20.0,))
#: Many bands per attribute, some of which do not lie within one band of the level above.
WIDE_SIZE = QI("size", "number", 1.0, 50.0, 0, integer=True, widths=(2.0, 4.0, 8.0, 16.0, 32.0))
WIDE_PRICE = QI("retailprice", "number", 900.0, 1000.0, 1, widths=(0.2, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0))
WIDE_NUMBER = QI("number", "number", 0.0, 100_000.0, 0, integer=True, widths=(10.0, 50.0, 100.0, 500.0, 1000.0, 5000.0, 10_000.0))
QUANTITY = QI("quantity", "number", 1.0, 50.0, 0, integer=True, widths=(10.0,))
DISCOUNT = QI("discount", "number", 0.0, 0.1, 2, widths=(0.05,))
VALUE = QI("value", "number", 0.0, 500.0, 2, widths=(50.0,))
TEMPERATURE = QI("temperature", "mixed", 35.0, 42.0, 1, widths=(1.0,))


def customer_qi(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    return table(spark, sf, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("rid"), F.col("c_mktsegment").alias("segment"), "nation",
        F.col("c_acctbal").alias("acctbal"))


def blank_customer_qi(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of whom a quarter has no nation and another quarter one that the hierarchy lacks."""
    part = F.col("rid") % 4
    return customer_qi(spark, sf).withColumn(
        "nation", F.when(part == 1, F.lit("NOWHERE")).when(part != 0, F.col("nation")))


def customer_qis(spark: SparkSession, sf: str) -> list[QI]:
    return [category(spark, sf, "segment"), category(spark, sf, "nation"), ACCTBAL]


def orders_qi(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("rid"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.date_format("o_orderdate", "yyyy-MM").alias("order_month"), F.col("o_totalprice").alias("totalprice"))


def orders_qis(spark: SparkSession, sf: str) -> list[QI]:
    return [*[category(spark, sf, a) for a in ("status", "priority", "order_month")], TOTALPRICE]


def part_qi(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("rid"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("retailprice"))


def part_qis(spark: SparkSession, sf: str) -> list[QI]:
    return [SIZE, PRICE]


def wide_part_qi(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("rid"), F.col("p_partkey").alias("number"), F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("retailprice"), F.col("p_type").alias("type"), F.col("p_brand").alias("brand"))


def wide_part_qis(spark: SparkSession, sf: str) -> list[QI]:
    """A lattice of 5,670 nodes."""
    return [WIDE_NUMBER, WIDE_SIZE, WIDE_PRICE, category(spark, sf, "type"), category(spark, sf, "brand")]


def lineitem_qi(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"),
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))


def lineitem_qis(spark: SparkSession, sf: str) -> list[QI]:
    return [category(spark, sf, "returnflag"), category(spark, sf, "linestatus"), QUANTITY, DISCOUNT]


def events_qi(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("rid"), "event_type", "value")


def events_qis(spark: SparkSession, sf: str) -> list[QI]:
    return [category(spark, sf, "event_type"), VALUE]


def mixed_qi(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with a temperature that is a number or a fixed range."""
    c = F.col("c_custkey")
    ranged = F.when(F.col("c_nationkey") % 2 == 0, c % 5 < 3).otherwise(c % 5 < 1)
    return table(spark, sf, "customer").select(
        c.alias("rid"), F.col("c_nationkey").cast("bigint").alias("cluster_id"),
        F.when(ranged, F.lit(TEMPERATURE_RANGE)).otherwise(
            number_text(F.lit(35.0) + (c * 37 % 71) / 10, 1)).alias("temperature"))


def masked_qi(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with shifted nations, some merged segments, and displaced balances."""
    nation = F.broadcast(table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("nation")))
    c = F.col("c_custkey")
    moved = table(spark, sf, "customer").withColumn("_k", (F.col("c_nationkey") + c % 3) % 25)
    shifted = F.col("c_acctbal") + (c * 7919 % 2001) - 1000
    return moved.join(nation, F.col("_k") == F.col("n_nationkey")).select(
        c.alias("rid"), F.when(c % 4 == 0, F.lit("MACHINERY")).otherwise(F.col("c_mktsegment")).alias("segment"),
        "nation", F.least(F.greatest(F.round(shifted, 2), F.lit(-1000.0)), F.lit(10000.0)).alias("acctbal"))


def sample_releases(spark: SparkSession, sf: str) -> DataFrame:
    """Two parameter values, two iterations each: generalised customers, some fully suppressed."""
    from veilspark.operators.classes import generalise_all
    from veilspark.sources.tables import attach_grid
    from veilspark.spec import STAR

    df, qis = customer_qi(spark, sf), customer_qis(spark, sf)
    parts = [
        attach_grid(generalise_all(df, qis, levels), param=[param], iteration=[1, 2])
        for param, levels in ((1.0, [0, 0, 1]), (2.0, [1, 1, 1]))
    ]
    gone = (F.col("rid") + F.col("iteration")) % 10 < F.col("param")
    cell = lambda c: F.when(gone, F.lit(STAR)).otherwise(F.col(c)).alias(c)
    return parts[0].unionByName(parts[1]).select(
        F.lit("flat").alias("model"), "param", "iteration", "rid", cell("segment"), cell("nation"), cell("acctbal"))
