"""Evidence and cited answers, for all queries of a batch at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOTHING = "No matching entity in the indexed data."
SNIPPET = 280


def gather(run: DataFrame, entities: DataFrame, limit: int = 8) -> DataFrame:
    """Evidence of the first ``limit`` hits, without those that have no entity (they use up their places)."""
    rows = entities.select(F.col("id").alias("doc_id"), "caption", "schema", "countries", "topics", "datasets", F.substring("search_text", 1, SNIPPET).alias("snippet"))
    return run.where(F.col("rank") <= limit).select("query_id", "doc_id", "score", "rank").join(rows, "doc_id").select("query_id", "doc_id", "caption", "schema", "countries", "topics", "datasets", "score", "snippet", "rank")


def evidence_line() -> Column:
    def some(column: str, n: int, mark: str):
        return F.nullif(F.array_join(F.slice(column, 1, n), mark), F.lit(""))

    about = F.concat_ws("; ", "schema", some("countries", 3, "/"), some("topics", 3, ", "))
    source = F.coalesce(some("datasets", 2, ", "), F.lit("unknown source"))
    return F.concat(F.lit("- "), "caption", F.lit(" ("), about, F.lit(") — listed in "), source, F.lit(" ["), "doc_id", F.lit("]"))


def extractive(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """``query_id, text, generator``: a line for each piece of evidence, each with its citation."""
    lines = evidence.groupBy("query_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank", evidence_line().alias("line")))).alias("lines"))
    body = F.concat(F.concat(F.col("n").cast("string"), F.lit(" candidate entities for: "), "query"), F.lit("\n"), F.array_join(F.col("lines.line"), "\n"))
    return queries.join(lines, "query_id", "left").select("query_id", F.when(F.col("n") > 0, body).otherwise(F.lit(NOTHING)).alias("text"), F.lit("extractive").alias("generator"))


def answer(queries: DataFrame, run: DataFrame, entities: DataFrame, limit: int = 8, generator: Callable[[str, list], str | None] | None = None) -> DataFrame:
    """Answers to ``query_id, query``. A ``generator`` (question and evidence rows to a text, or None) may write the prose; else it is extractive."""
    evidence = gather(run, entities, limit)
    plain = extractive(queries, evidence)
    if generator is None:
        return plain

    def written(batches):
        for batch in batches:
            for k, (question, rows, text) in enumerate(zip(batch["query"], batch["rows"], batch["text"], strict=True)):
                made = generator(question, list(rows) if rows is not None else [])
                batch.loc[batch.index[k], ["text", "generator"]] = (made, "model") if made else (text, "extractive")
            yield batch[["query_id", "text", "generator"]]

    kept = [c for c in evidence.columns if c != "query_id"]
    rows = evidence.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in kept if c != "rank"]))).alias("rows"))
    both = plain.join(queries.select("query_id", "query"), "query_id").join(rows, "query_id", "left")
    kind = both.schema["query_id"].dataType.simpleString()
    return both.mapInPandas(written, f"query_id {kind}, text string, generator string")
