"""What the operators share: reading tables, words, stable hashes, registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in every regular-expression dialect in use here.
WORD = r"[^\x20\x09-\x0D]+"
#: The same characters as Python strips and splits: ``bytes.split()`` uses exactly these six.
BLANKS = " \t\n\r\x0b\x0c"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its SQL where SQL can express it."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as a reference, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def n_words(text: Column) -> Column:
    """Words of a whole text; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(*names: str) -> Column:
    """Digest of a row's columns, NULL told from every value: tells rows apart that share an id or have none."""
    return F.sha2(F.concat(*[F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit("~")) for c in names]), 256)


def md5_of(*parts) -> Column:
    """Hex digest of the parts joined by a bar: the same in Spark, DuckDB and Python."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols]))
