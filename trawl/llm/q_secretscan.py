"""Query of the secret scan operator."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm import secretscan
from trawl.llm.shared import table


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.findings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_candidates", "n_secrets", F.to_json("secrets").alias("secrets"))


QUERIES = {"op8_secrets": op8_secrets}
