"""Reading, projecting and writing micro-data tables and releases."""

from __future__ import annotations

import hashlib
import itertools
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.runtime import ordered_positions, shared_dir
from veilspark.spec import QI, names

RELEASE_KEYS = ["model", "param", "iteration"]


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, rid: str | None = None,
    fmt: str | None = None,
) -> DataFrame:
    """A micro-data table with a ``rid``: a natural key, or the position of the row in the total
    order of all columns. CSV needs an explicit schema."""
    fmt = fmt or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV table needs a schema")
        df = spark.read.schema(schema).csv(path, header=True)
    else:
        df = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    return with_rid(df, rid)


def with_rid(df: DataFrame, rid: str | None = None) -> DataFrame:
    """Attach ``rid``: the named unique column, or a number from the order of all columns."""
    if rid is not None:
        return df.select(F.col(rid).cast("bigint").alias("rid"), *[c for c in df.columns if c != rid])
    return ordered_positions(df, df.columns, "rid").select("rid", *df.columns)


def drop_attrs(df: DataFrame, attrs: list[str]) -> DataFrame:
    """Drop identifying columns."""
    return df.drop(*attrs)


def attribute_subset(df: DataFrame, qis: list[QI], attrs: list[str], rid: str = "rid") -> tuple[DataFrame, list[QI]]:
    """Project to some attributes and their declarations."""
    chosen = [q for q in qis if q.name in attrs]
    if len(chosen) != len(set(attrs)):
        raise ValueError(f"undeclared attributes in {attrs}")
    return df.select(rid, *names(chosen)), chosen


def attribute_subsets(qis: list[QI], size: int) -> list[list[str]]:
    """Every set of ``size`` attribute names."""
    return [list(c) for c in itertools.combinations(names(qis), size)]


def subset_name(attrs: list[str]) -> str:
    return "-".join(attrs)


def write_release(df: DataFrame, path: str, partition_cols: list[str] | None = None) -> None:
    """Write releases as parquet, one folder per release. Writing again replaces only the
    releases present in ``df``."""
    cols = RELEASE_KEYS if partition_cols is None else partition_cols
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*cols).parquet(path)
    )


def write_release_csv(df: DataFrame, path: str) -> None:
    """Write one release as CSV with a header."""
    df.write.mode("overwrite").csv(path, header=True)


def read_releases(spark: SparkSession, root: str) -> DataFrame:
    """All releases below ``root`` as one table; the release keys come from the folders."""
    df = spark.read.parquet(root)
    kinds = {"model": "string", "param": "double", "iteration": "int"}
    return df.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns])


def read_named_releases(spark: SparkSession, root: str, schema: T.StructType | str) -> DataFrame:
    """CSV releases named ``<model>_<param>-<value>_<iteration>.csv`` as one table."""
    name = r"([A-Za-z0-9]+)_[A-Za-z]+-([0-9.eE+-]+)_([0-9]+)\.csv"
    df = spark.read.schema(schema).csv(f"{root}/*.csv", header=True)
    file = F.col("_metadata.file_name")
    return df.select(
        F.regexp_extract(file, name, 1).alias("model"),
        F.regexp_extract(file, name, 2).cast("double").alias("param"),
        F.regexp_extract(file, name, 3).cast("int").alias("iteration"),
        "*",
    )


def param_grid(spark: SparkSession, **params: list) -> DataFrame:
    """Every combination of the parameter values, one column each."""
    return attach_grid(spark.range(1), **params).drop("id")


def attach_grid(df: DataFrame, **params: list) -> DataFrame:
    """Every row once per combination of the parameter values."""
    for name, values in params.items():
        df = df.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return df


def _row_hash(columns: list[str]):
    """Hash of a row. A NULL alone would leave no trace in it, wherever it stands."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())])


def _content(df: DataFrame) -> list:
    """Order-free hash of all rows, for instance of a hierarchy."""
    row = _row_hash(sorted(df.columns))
    return list(df.agg(F.count(F.lit(1)), F.bit_xor(row), F.sum(row.cast("decimal(38,0)")).cast("string")).first())


def fingerprint(df: DataFrame, qis: list[QI], k: int, rid: str = "rid") -> str:
    """Key of a cluster assignment: content of the input, attributes with their hierarchies, and k."""
    cells = _row_hash([rid, *names(qis)])
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(cells).alias("x"),
        F.sum(cells.cast("decimal(38,0)")).cast("string").alias("s"),
    ).first()
    declared = [[q.name, q.kind, q.lo, q.hi, q.decimals, _content(q.tax.closure) if q.tax else None] for q in qis]
    text = json.dumps([row["n"], row["x"], row["s"], declared, k])
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def save_clusters(clusters: DataFrame, key: str, root: str | None = None) -> str:
    """Persist an assignment under its key."""
    path = f"{root or shared_dir(clusters.sparkSession)}/clusters/{key}"
    clusters.select("rid", "cluster_id").write.mode("overwrite").parquet(path)
    return path


def load_clusters(spark: SparkSession, key: str, root: str | None = None) -> DataFrame | None:
    """The assignment stored under ``key``, or None."""
    path = f"{root or shared_dir(spark)}/clusters/{key}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return None
    return spark.read.schema("rid BIGINT, cluster_id BIGINT").parquet(path)
