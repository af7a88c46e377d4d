"""Helpers that the operators of this subpackage share.

Intermediate results that must outlive a lost executor are written as tables
below the folder named by ``spark.checkpoint.dir``; a default is used only
where that setting is missing (single-machine runs, tests).
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used only when the session has no ``spark.checkpoint.dir`` and runs in one process.
LOCAL_DEFAULT = "/tmp/checkpoints/trawl"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors can read and write. Only a session within one process may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share with the driver")
    return (folder or LOCAL_DEFAULT).rstrip("/")


#: Paths given out by this process and not yet deleted.
_made: list[str] = []


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that no other call uses. ``release`` deletes it, at the latest when the driver ends."""
    if not _made:
        atexit.register(_at_exit)
    _made.append(f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    return _made[-1]


def release(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this process. Only for when no result that was made from them will be read again."""
    while _made:
        _delete(spark, _made.pop())


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _at_exit() -> None:
    if spark := SparkSession.getActiveSession():
        with contextlib.suppress(Exception):  # the JVM may be gone already
            release(spark)


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends here, and no
    executor has to survive for it to be read again."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table made by ``written`` that nobody reads any more."""
    for name in df.inputFiles()[:1]:
        _delete(df.sparkSession, name.rpartition("/")[0])


def tidied(spark: SparkSession) -> None:
    """Has the driver collect its garbage: Spark then deletes the shuffle files and broadcasts of queries
    that ended, and the driver's heap shrinks, which many small queries otherwise fill to its limit."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column | str) -> str:
    """The word pattern of the contracts, for SQL regular expressions."""
    return r"[^\x20\x09-\x0D]+"


def schema_of(df: DataFrame, column: str, name: str | None = None) -> T.StructField:
    """The field of one column, nullable, under another name if one is given."""
    return T.StructField(name or column, df.schema[column].dataType, True)


def stars(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The components of a table of links (rows ``a``, columns ``b``, none of them empty) as edges to one row each."""
    label, none = np.arange(len(a), dtype=np.int32), np.int32(len(a))
    while True:
        col = np.where(linked, label[:, None], none).min(0)
        new = np.minimum(label, np.where(linked, col[None, :], none).min(1))
        if (new == label).all():
            return [(a, a[label]), (b, a[col])]
        label = new


def labelled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges ``a, b``, ascending, and the smallest node that each of them reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(a):
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[label]


def connected_components(edges: DataFrame, tag: str = "components", alone: int = 0) -> DataFrame:
    """Smallest reachable node for every node of an undirected graph.

    ``edges`` has two columns of one orderable type, ``a`` and ``b``, in any
    direction; loops and repeated edges are allowed, nulls are ignored.
    Returns ``node, component`` for each node that has an edge to another one.

    Alternating large-star and small-star steps: every step replaces the edges
    of a node by edges to the smallest node known for it, so paths shrink
    quickly and no step holds the neighbours of a node in one place. Each
    round is written to the shared folder; both sides of its joins are plain
    scans, so that Spark can split the rows of a hub.

    Up to ``alone`` edges between long integers take one task instead of rounds,
    whose many queries cost the driver more than the edges cost a task.
    """
    once = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now = written(once, tag)
    seen = _checksum(now)
    longs = all(isinstance(f.dataType, T.LongType) for f in now.schema)
    while seen[0]:
        if longs and seen[0] <= alone:
            return now.coalesce(1).mapInArrow(_in_one_task, "node long, component long")
        least = written(now.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m")), tag)
        large = written(
            now.join(least, now.lo == least.node, "left").select("hi", F.coalesce("m", "lo").alias("lo")).distinct(), tag
        )
        dropped(least)
        least = written(large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m")), tag)
        pulled = large.join(least, large.hi == least.node).select(F.explode(F.array(
            F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.greatest("lo", "m").alias("hi"), F.least("lo", "m").alias("lo"))
        )).alias("e")).select("e.hi", "e.lo").where("hi <> lo").distinct()
        small = written(pulled, tag)
        for x in (least, large, now):
            dropped(x)
        now, before, seen = small, seen, _checksum(small)
        if seen == before:
            break
    return now.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component")).unionByName(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [[batch.column(c).to_numpy() for c in (0, 1)] for batch in batches]
    if parts:
        found = labelled(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["node", "component"])


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return row[0], row[1]
