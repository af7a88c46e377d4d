"""Runs: ``query_id, doc_id, score, rank``. The rank is a column, never an implied order.

Ties go to the smaller id. Ranking rounds scores to nine digits, so that the
order in which a sum was taken never decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a side up to which it is broadcast; beyond, Spark chooses a join by its own sizes.
BROADCAST_ROWS = 200_000


def ranked(scored: DataFrame, k: int | None, *ties: Column | str) -> DataFrame:
    """The ``k`` best of each query (all for None). Spark cuts each partition to its own best before it shuffles."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), *(ties or ("doc_id",)))
    out = scored.withColumn("rank", F.row_number().over(order).cast("long"))
    return (out if k is None else out.where(F.col("rank") <= k)).select("query_id", "doc_id", "score", "rank")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, to be broadcast if it has no more than ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def known(run: DataFrame, entities: DataFrame, id_col: str = "id") -> DataFrame:
    """Hits that have an entity; ranks stay as they were."""
    return run.join(entities.select(F.col(id_col).alias("doc_id")), "doc_id", "left_semi")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out over all cores if it comes in fewer partitions than half of them (one small file, say); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
