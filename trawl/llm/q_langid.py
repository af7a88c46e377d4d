"""Query of the language operator."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm import langid
from trawl.llm.shared import table


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.is_held_out(F.col("doc_id"))
    model = langid.learn(docs.where(~held_out).select("lang", "text"))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_language": op6_language}
