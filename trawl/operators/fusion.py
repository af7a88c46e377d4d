"""Reciprocal rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.operators.runs import ranked


def rrf(runs: list[DataFrame], k: int = 60, top: int | None = 50, weights: list[float] | None = None) -> DataFrame:
    """Sum of weight / (k + rank). Ties go to the earlier run, then the better rank in it."""
    weights = weights or [1.0] * len(runs)
    parts = [r.select("query_id", "doc_id", (F.lit(float(w)) / (k + F.col("rank"))).alias("s"), F.struct(F.lit(i).alias("run"), "rank").alias("at")) for i, (r, w) in enumerate(zip(runs, weights, strict=True))]
    fused = reduce(DataFrame.unionAll, parts).groupBy("query_id", "doc_id").agg(F.sum("s").alias("score"), F.min("at").alias("at"))
    return ranked(fused, top, "at.run", "at.rank", "doc_id")


class Hybrid:
    """Any retrievers with ``search(queries, k)``, fused."""

    def __init__(self, *retrievers, weights: list[float] | None = None):
        self.retrievers, self.weights = [r for r in retrievers if r is not None], weights

    def search(self, queries: DataFrame, k: int = 50, pool: int = 100) -> DataFrame:
        return rrf([r.search(queries, pool) for r in self.retrievers], top=k, weights=self.weights)
