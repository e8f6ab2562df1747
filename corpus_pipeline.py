"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again before the
next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm.jaccard_join import one_per_group
from veilspark.llm.mixing import mix_stage
from veilspark.llm.nbest import encode_stage
from veilspark.llm.quality import quality_stage
from veilspark.llm.secrets import secret_stage
from veilspark.runtime import materialise

STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", one_per_group),
    ("secret_scan", secret_stage),
    ("mix_sources", mix_stage),
    ("piece_nbest", encode_stage),
]

#: Outlier distances, the forest and the piece lattice have no SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
