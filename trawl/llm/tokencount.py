"""Token counts of whole texts: a map-side lookup in two tiers.

1. One pass over all texts keeps, in each task, a bounded sketch of its most
   frequent pre-tokens (lossy counting). The sketches are added up and the
   ``table_size`` largest entries, with their lengths in tokens, become a
   compact table that is sent to every worker. It is a table of lengths only:
   a pre-token it lacks is encoded, so counts never depend on it.
2. The second pass splits each text, sums the lengths from the table, and
   encodes what it lacks through a bounded cache in the worker. No pre-token
   of a text is shuffled.

Nulls, empty and odd input: a null text counts as empty (0 bytes, 0 tokens);
a null id stays; repeated rows are counted each by itself; an empty table gives
an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.llm import pretokens
from trawl.llm.shared import schema_of

#: Entries of the table that is broadcast; at most LONGEST_KEPT characters each, so some 4 MB.
TABLE_SIZE = 65_536
#: Entries that a task's sketch keeps, and sends.
SKETCH_SIZE, SKETCH_SENT = 65_536, 8_192


def frequent_lengths(texts: DataFrame, text_col: str, tokenizer_path: str, table_size: int = TABLE_SIZE) -> dict[str, int]:
    """The most frequent pre-tokens of all texts with their lengths in tokens, at most ``table_size``."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, counts = pretokens.worker_encoder(tokenizer_path, True), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text and (found := encoder.pieces(text)) is not None:
                    counts.update(found)
                    if len(counts) > 4 * SKETCH_SIZE:
                        counts = Counter(dict(counts.most_common(SKETCH_SIZE)))
        sent = [x for x in counts.most_common(SKETCH_SENT) if len(x[0]) <= pretokens.LONGEST_KEPT]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in sent], pa.string()), pa.array([x[1] for x in sent], pa.int64())], ["piece", "n"])

    rows = (
        texts.select(F.col(text_col).alias("text")).mapInArrow(sketch, "piece string, n long")
        .groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(table_size).collect()
    )
    encoder = pretokens.Encoder(tokenizer_path, lengths=True)
    return {r.piece: encoder.piece(r.piece) for r in rows}


def count_tokens(
    docs: DataFrame, tokenizer_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text", table_size: int = TABLE_SIZE
) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` of every row, as the tokenizer's own library counts them."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(texts, "text", tokenizer_path, table_size))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path, table)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                n_bytes.append(len(text.encode()))
                n_tokens.append(encoder(text))
            over = [n > limit for n in n_tokens]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(over, pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    out = T.StructType([schema_of(texts, "id"), *(T.StructField(x, T.LongType()) for x in ("n_bytes", "n_tokens")), T.StructField("over_limit", T.BooleanType())])
    return texts.mapInArrow(count, out).withColumnRenamed("id", id_col)


_ENCODERS: dict = {}


def _encoder(path: str, table) -> pretokens.Encoder:
    """The worker's encoder for one table; one is kept at a time."""
    known = table.value
    if (path, id(known)) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, id(known)] = pretokens.Encoder(path, len(known) + pretokens.MOST_KEPT, known, lengths=True)
    return _ENCODERS[path, id(known)]
