"""Packing by concatenate and cut.

All documents, in the order in which the input's partitions hold them, form one
stream of token ids; it is cut into windows of ``width`` ids. Two passes:

1. each task encodes its documents once, numbers their ids from its own zero
   and writes ids and numbers to a table in the shared folder;
2. the totals of the tasks (one small row each) are added up to the global
   offset at which each task's stream begins; a second pass over the table
   cuts every document at the window borders.

No document is moved between tasks. Whole sequences are put together where
they lie; only those that cross a border between tasks are sent as fragments.

Nulls, empty and odd input: a null text counts as empty and holds only its end
id; a null document id stays; repeated rows are packed each by itself; an empty
table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.llm import pretokens
from trawl.llm.shared import schema_of, written

#: Bytes of ids after which a task hands on what it has.
FLUSH = 4_000_000


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First pass: ``doc_id, part, start, n, ids`` in the shared folder. ids: packed little-endian, the end id last."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = pretokens.worker_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        end, width = encoder.packed([end_id]), len(encoder.packed([0]))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            first, starts, ns, packed, held = 0, [], [], [], 0
            for k in range(batch.num_rows):
                text = texts[k].as_py()
                packed.append((encoder(text) if text else b"") + end)
                held += len(packed[-1])
                starts.append(at)
                ns.append(len(packed[-1]) // width)
                at += ns[-1]
                if held >= FLUSH or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(first, len(ns)), pa.array([part] * len(ns), pa.int32()), pa.array(starts, pa.int64()), pa.array(ns, pa.int64()), pa.array(packed, pa.binary())],
                        ["doc_id", "part", "start", "n", "ids"],
                    )
                    first, starts, ns, packed, held = k + 1, [], [], [], 0

    out = T.StructType([schema_of(texts, "doc_id"), T.StructField("part", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])
    return written(texts.mapInArrow(encode, out), "packing")


def offsets(tokens: DataFrame) -> tuple[dict[int, int], int]:
    """Where each task's stream begins, and the length of all streams. One entry for each task of the first pass."""
    rows = sorted(tokens.groupBy("part").agg(F.sum("n").alias("n")).collect())
    ends = list(accumulate((r.n for r in rows), initial=0))
    return {r.part: at for r, at in zip(rows, ends, strict=False)}, ends[-1]


def padded_length(used: int, width: int) -> int:
    """What a sequence of ``used`` ids is filled up to: ``width``, but a power of two stays as it is."""
    return used if used & (used - 1) == 0 else width


def pack(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, width: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row for each piece of a document:

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    padded_length, ids`` (ids: packed little-endian unsigned 32-bit).
    """
    tokens = encoded(docs, tokenizer_path, end_id, id_col, text_col)
    begins, total = offsets(tokens)
    base = docs.sparkSession.sparkContext.broadcast(begins)
    last = (total - 1) // width
    last_length = padded_length(total - last * width, width) if total else 0
    narrow = pretokens.Encoder(tokenizer_path).code == "H"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = "<u2" if narrow else "<u4"
        for batch in batches:
            held, rows = 0, {k: [] for k in ("row", "start", "length", "crc", "n", "sequence", "offset", "pad", "ids")}
            for k in range(batch.num_rows):
                at, n = base.value[batch.column(1)[k].as_py()] + batch.column(2)[k].as_py(), batch.column(3)[k].as_py()
                ids = memoryview(np.frombuffer(batch.column(4)[k].as_buffer(), kind).astype("<u4").tobytes())
                done = 0
                while done < n:
                    sequence, offset = divmod(at + done, width)
                    length = min(width - offset, n - done)
                    piece = ids[4 * done : 4 * (done + length)]
                    for name, value in zip(rows, (k, done, length, zlib.crc32(piece), n, sequence, offset, last_length if sequence == last else width, bytes(piece)), strict=True):
                        rows[name].append(value)
                    done, held = done + length, held + 4 * length
                    if held >= FLUSH:
                        yield _pieces(batch, rows)
                        held, rows = 0, {name: [] for name in rows}
            yield _pieces(batch, rows)

    longs = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length")
    out = T.StructType([schema_of(tokens, "doc_id"), *(T.StructField(x, T.LongType()) for x in longs), T.StructField("ids", T.BinaryType())])
    return tokens.mapInArrow(cut, out).withColumnRenamed("doc_id", id_col)


def _pieces(batch: pa.RecordBatch, rows: dict) -> pa.RecordBatch:
    row, *numbers, ids = rows.values()
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in numbers), pa.array(ids, pa.binary())],
        ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length", "ids"],
    )


def sequences(pieces: DataFrame, width: int = 2048, pad_id: int = 0) -> DataFrame:
    """``sequence_id, ids array<int>, used`` of every sequence, padded.

    A sequence that lies in one task is put together there; the rest of them,
    two for each task at most, are sent as boundary records and joined up.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, have, pad = None, 0, [], 0
        for batch in batches:
            out = []
            for sequence, offset, padded, ids in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if have and (sequence != now or offset != first + sum(map(len, have)) // 4):
                    out.append((now, first, pad, b"".join(have)))
                    have = []
                if not have:
                    now, first, pad = sequence, offset, padded
                have.append(ids)
            yield _fragments(out)
        if have:
            yield _fragments([(now, first, pad, b"".join(have))])

    runs = pieces.select("sequence_id", "offset", "padded_length", "ids").mapInArrow(gather, "sequence_id long, offset long, padded_length long, ids binary")
    whole = F.col("offset").eqNullSafe(0) & (F.length("ids") == 4 * width)
    runs = written(runs, "sequences")
    bound = runs.where(~whole).groupBy("sequence_id").agg(F.max("padded_length").alias("padded_length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    joined = bound.select("sequence_id", "padded_length", F.aggregate("x.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in batch.column(2).to_pylist()]
            full = [np.pad(x, (0, p - len(x)), constant_values=pad_id) for x, p in zip(ids, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(full, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64())], ["sequence_id", "ids", "used"])

    return runs.where(whole).select("sequence_id", "padded_length", "ids").unionByName(joined).mapInArrow(unpack, "sequence_id long, ids array<int>, used long")


def _fragments(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols[:3]), pa.array(cols[3], pa.binary())], ["sequence_id", "offset", "padded_length", "ids"])
