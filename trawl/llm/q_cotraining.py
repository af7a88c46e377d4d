"""Query of the quality classifier."""

from pyspark.sql import DataFrame, SparkSession

from trawl.llm import cotraining
from trawl.llm.shared import table


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, features = cotraining.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return cotraining.scored(features, model)


QUERIES = {"op4_quality": op4_quality}
