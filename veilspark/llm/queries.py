"""All queries of the subpackage: importing the operators registers them."""

from veilspark.llm import (  # noqa: F401
    collocations, hashing_search, jaccard_join, language_crf, mixing, nbest, phrase_dedup, pivot_clustering, quality,
    secrets, suffix_dedup, uniform_shards, warc)
from veilspark.llm.common import QUERIES, SQL  # noqa: F401
