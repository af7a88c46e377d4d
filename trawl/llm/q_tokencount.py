"""Query of the token count operator."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trawl.llm import tokencount
from trawl.llm.shared import table


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


QUERIES = {"op10_token_counts": op10_token_counts}
