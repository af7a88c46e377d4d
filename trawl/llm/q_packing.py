"""Query of the packing operator."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trawl.llm import packing
from trawl.llm.shared import table


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, width=2048)
    return pieces.drop("ids")


QUERIES = {"op3_pack": op3_pack}
