"""Query of the fingerprint operator."""

from pyspark.sql import DataFrame, SparkSession

from trawl.llm import rarefeatures
from trawl.llm.shared import table


def op2_rare_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rarefeatures.edited_pairs(table(spark, sf_dir, "documents"))


QUERIES = {"op2_rare_features": op2_rare_features}
