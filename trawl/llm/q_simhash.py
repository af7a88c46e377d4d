"""Query of the SimHash operator."""

from pyspark.sql import DataFrame, SparkSession

from trawl.llm import simhash
from trawl.llm.shared import table


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3)


QUERIES = {"op7_simhash": op7_simhash}
