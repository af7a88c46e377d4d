"""Incremental ingestion: new files of records, merged into the store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trawl.sources.records import Store, entities_of, read_records, relations_of


def ingest_stream(spark: SparkSession, folder: str, store: Store, checkpoint: str, files_per_batch: int = 100):
    """A query over the JSON line files that appear in ``folder``.

    A batch is merged by the store's own rules, where what is stored counts as
    earlier; merging a batch again after a failure changes nothing.
    """
    files = spark.readStream.format("text").option("wholetext", "false").option("maxFilesPerTrigger", files_per_batch).load(folder).selectExpr("_metadata.file_path AS file")

    def merge(batch: DataFrame, _: int) -> None:
        paths = [r.file for r in batch.select("file").distinct().collect()]  # files_per_batch at most
        if paths:
            records = read_records(spark, *paths)
            store.upsert(entities_of(records), relations_of(records))

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
