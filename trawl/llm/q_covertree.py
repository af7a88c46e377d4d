"""Query of the embedding operator."""

from pyspark.sql import DataFrame, SparkSession

from trawl.llm import covertree
from trawl.llm.shared import table


def op9_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.95)


QUERIES = {"op9_cover_tree": op9_cover_tree}
