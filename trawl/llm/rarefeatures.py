"""Document fingerprints from improbable features.

Every window of 64 bytes has an entropy; entropies far from those of common text
are improbable. Among each 64 neighbouring windows the most improbable one gets a
vote, and windows with ``VOTES`` votes or more are the text's features: they
depend on their surroundings alone, so an edit changes the features near it and
no others. Distinct features go, in order, into a chain of Bloom filters of 2,048
bits, 160 features each, five bits a feature.

Likeness (0 to 1): each filter of the shorter chain takes its best match in the
other chain, the number of common bits scaled between what chance gives and the
most possible; the mean is weighted by features.

Nulls, empty and odd input: a null text counts as empty; an empty text has no
features, and is like another empty text (1) and like nothing else (0); a text
shorter than a window is one feature; long texts are read in parts that overlap,
with the result of the whole; documents with equal ids follow each other in the
order of their texts; null ids come last; an empty table gives an empty result;
other columns are ignored whatever their names. Ids have to be integers.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.llm.shared import schema_of

WINDOW, VOTES = 64, 16
BITS, PER_FILTER, HASHES = 2048, 160, 5
#: Mean and spread of the entropy of windows of common text, in thousandths of the largest; windows under FLAT say nothing.
USUAL, SPREAD, FLAT = 690, 60, 100
#: Bytes of text worked on at once, and bytes that parts of a longer text share.
PART, LEFT, RIGHT = 1 << 20, WINDOW, 2 * WINDOW
#: Documents to a range of ids, and the most ranges.
RANGE, RANGES = 2_000, 4_096

_SCALE = 1 << 20
_F = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 1))]
#: What the k-th equal byte in a window adds to the sum of c log2 c, in whole numbers.
_STEP = np.array([0, *(round((_F[c] - _F[c - 1]) * _SCALE) for c in range(1, WINDOW + 1))], np.int64)
_FULL = int(math.log2(WINDOW)) * WINDOW * _SCALE
#: How common each entropy is, from a bell curve; never chosen where it says nothing.
_NEVER = 1 << 30
_COMMON = np.array([_NEVER if h < FLAT else int(1e6 * math.exp(-(((h - USUAL) / SPREAD) ** 2) / 2)) for h in range(1001)], np.int64)


def _parts(texts: list[bytes]) -> Iterator[tuple[int, bytes, int, int]]:
    """Number of the text, bytes, and the range in them whose features count."""
    for k, text in enumerate(texts):
        if len(text) >= WINDOW:
            for at in range(0, max(1, len(text) - WINDOW + 1), PART):
                begin, end = max(0, at - LEFT), min(len(text), at + PART + RIGHT)
                yield k, text[begin:end], at - begin, min(at + PART, len(text) - WINDOW + 1) - begin


def features(texts: list[bytes]) -> list[np.ndarray]:
    """64-bit hashes of the features of each text, distinct, in order."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    group, held = [], 0
    for part in _parts(texts):
        group.append(part)
        held += len(part[1])
        if held >= PART:
            _chosen(group, found)
            group, held = [], 0
    if group:
        _chosen(group, found)
    out = []
    for text, hashes in zip(texts, found, strict=True):
        if text and len(text) < WINDOW:
            hashes = [_mixed(np.frombuffer(text.ljust(WINDOW, b"\0"), np.uint64).reshape(1, -1)) + np.uint64(len(text))]
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        _, first = np.unique(every, return_index=True)
        out.append(every[np.sort(first)])
    return out


def _chosen(group: list[tuple], found: list[list[np.ndarray]]) -> None:
    pad = bytes(2 * WINDOW)
    x = np.frombuffer(pad + pad.join(p[1] for p in group) + pad, np.uint8)
    starts = np.cumsum([len(pad), *(len(p[1]) + len(pad) for p in group[:-1])])
    before, after = np.zeros(len(x), np.uint8), np.zeros(len(x), np.uint8)
    for lag in range(1, WINDOW):
        same = (x[lag:] == x[:-lag]).view(np.uint8)
        before[lag:] += same
        after[:-lag] += same
    first = int(_STEP.cumsum()[np.unique(x[:WINDOW], return_counts=True)[1]].sum())
    total = np.empty(len(x) - WINDOW + 1, np.int64)
    total[0] = first
    np.subtract(_STEP[before[WINDOW:] + 1], _STEP[after[: len(x) - WINDOW] + 1], out=total[1:])
    np.cumsum(total, out=total)
    rank = _COMMON[np.clip((_FULL - total) * 1000 // _FULL, 0, 1000)]
    inside = np.zeros(len(x) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + [len(p[1]) - WINDOW + 1 for p in group], -1)
    rank[np.cumsum(inside[: len(rank)]) == 0] = _NEVER + 1
    least = (rank << 32) | np.arange(len(rank))
    step = 1
    while step < WINDOW:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    votes = np.bincount(least[least >> 32 < _NEVER] & 0xFFFFFFFF, minlength=len(rank))
    for (k, part, lo, hi), start in zip(group, starts, strict=True):
        own = votes[start + lo : start + hi]
        at = np.nonzero(own >= VOTES)[0]
        if not len(at) and own.any():
            at = np.sort(np.argsort(-own, kind="stable")[: min(VOTES, np.count_nonzero(own))])
        if not len(at) and lo == 0 and len(part) == hi + WINDOW - 1:
            at = np.zeros(1, np.int64)  # a text that is flat throughout
        if len(at):
            found[k].append(_mixed(x[(start + lo + at)[:, None] + np.arange(WINDOW)].view(np.uint64)))


def _mixed(rows: np.ndarray) -> np.ndarray:
    h = np.full(len(rows), 0x9E3779B97F4A7C15, np.uint64)
    for column in rows.T:
        h = (h ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Digest:
    """A chain of Bloom filters: ``filters`` (64-bit words, a row each) and the features in each."""

    def __init__(self, hashes: np.ndarray):
        n = -(-len(hashes) // PER_FILTER)
        bits = np.zeros((n, BITS), np.uint8)
        row = np.arange(len(hashes)) // PER_FILTER
        for k in range(HASHES):
            bits[row, (hashes >> np.uint64(11 * k)) & np.uint64(BITS - 1)] = 1
        self.filters = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        self.counts = np.bincount(row, minlength=n)
        self.set_bits = bits.sum(1, dtype=np.int64)

    def text(self) -> str:
        """``features:filters in base 64``."""
        return f"{int(self.counts.sum())}:{base64.b64encode(self.filters.tobytes()).decode()}"

    @staticmethod
    def parse(text: str) -> Digest:
        n, _, data = text.partition(":")
        out = Digest(np.zeros(0, np.uint64))
        out.filters = np.frombuffer(base64.b64decode(data), np.uint64).reshape(-1, BITS // 64)
        full, rest = divmod(int(n), PER_FILTER)
        out.counts = np.array([PER_FILTER] * full + [rest] * bool(rest), np.int64)
        out.set_bits = np.bitwise_count(out.filters).sum(1, dtype=np.int64)
        return out


def likeness(a: Digest, b: Digest) -> float:
    if len(a.counts) > len(b.counts):
        a, b = b, a
    if not len(a.counts):
        return float(not len(b.counts))
    best = np.zeros(len(a.counts))
    for at in range(0, len(b.counts), 256):
        for k in range(len(a.counts)):
            common = np.bitwise_count(a.filters[k] & b.filters[at : at + 256]).sum(1, dtype=np.int64)
            other = b.set_bits[at : at + 256]
            chance = a.set_bits[k] * other / BITS
            floor = np.minimum(chance + 3 * np.sqrt(chance), np.minimum(a.set_bits[k], other) - 1)
            best[k] = max(best[k], float(np.max((common - floor) / (np.minimum(a.set_bits[k], other) - floor))))
    return float(np.clip((best * a.counts).sum() / a.counts.sum(), 0, 1))


def digests(texts: list[bytes]) -> list[Digest]:
    return [Digest(h) for h in features(texts)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint`` of every row. No shuffle."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([d.text() for d in digests(part.column(1).to_pylist())])], ["id", "fingerprint"])

    return texts.mapInArrow(work, T.StructType([schema_of(texts, "id"), T.StructField("fingerprint", T.StringType())])).withColumnRenamed("id", id_col)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows in ranges of ids, each range in order and closed by the document that follows it (``closing``).

    The ranges come from approximate quantiles; only the first document of each
    range is sent twice, and the table is shuffled once.
    """
    from pyspark.ml.feature import Bucketizer

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = rows.select("id")
    wanted = min(RANGES, max(1, ids.count() // RANGE))
    splits = sorted(set(ids.agg(F.percentile_approx("id", [k / wanted for k in range(1, wanted)], 10 * wanted)).first()[0] or [])) if wanted > 1 else []
    ranger = Bucketizer(splits=[-math.inf, *map(float, splits), math.inf], inputCol="x", outputCol="range", handleInvalid="keep") if splits else None

    def ranged(df: DataFrame) -> DataFrame:
        if ranger is None:
            return df.withColumn("range", F.lit(0))
        return ranger.transform(df.withColumn("x", F.col("id").cast("double"))).withColumn("range", F.coalesce(F.col("range").cast("int"), F.lit(len(splits) + 1))).drop("x")

    firsts = sorted((r.range, r.least) for r in ranged(ids).groupBy("range").agg(F.min("id").alias("least")).collect())
    before = [(firsts[k - 1][0], least) for k, (_, least) in enumerate(firsts)]
    heads = rows.sparkSession.createDataFrame(before, T.StructType([T.StructField("range", T.IntegerType()), schema_of(rows, "id", "least")]))
    closing = rows.join(F.broadcast(heads), F.col("id").eqNullSafe(F.col("least"))).select("id", "text", "range", F.lit(True).alias("closing"))
    every = ranged(rows).select("id", "text", "range", F.lit(False).alias("closing")).unionByName(closing)
    return every.repartition(max(1, len(firsts)), "range").sortWithinPartitions("range", "closing", F.asc_nulls_last("id"), F.asc_nulls_first("text"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row:
    the edited text is the document's with its second half replaced by the beginning of the next document."""
    rows = with_next(docs, id_col, text_col)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held = None
        for batch in batches:
            for k in range(batch.num_rows):
                now = tuple(batch.column(c)[k].as_py() for c in range(4))
                if held and held[2] == now[2]:
                    yield held[0], held[1] or "", now[1] or ""
                held = None if now[3] else now

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size = [], 0
        for x in pairs(batches):
            group.append(x)
            size += len(x[1])
            if size >= PART or len(group) >= 512:
                yield table(group)
                group, size = [], 0
        yield table(group)

    def table(group: list[tuple]) -> pa.RecordBatch:
        ids, ns, edits, own, after = [], [], [], [], []
        for doc_id, text, following in group:
            half = len(text) // 2
            ids.append(doc_id)
            ns.append(len(text))
            edits.append((text[: len(text) - half] + following[:half]).encode("utf-8", "surrogatepass"))
            own.append(text.encode("utf-8", "surrogatepass"))
            after.append(following)
        # The next document of all but the last one is the next in the group, unless a range ends.
        made = digests(own)
        nexts = [made[k + 1] if k + 1 < len(group) and group[k + 1][1] == after[k] else None for k in range(len(group))]
        missing = [k for k, x in enumerate(nexts) if x is None]
        for k, x in zip(missing, digests([after[k].encode("utf-8", "surrogatepass") for k in missing]), strict=True):
            nexts[k] = x
        changed = digests(edits)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in edits], pa.string()),
                pa.array([x.text() for x in made], pa.string()), pa.array([x.text() for x in changed], pa.string()),
                pa.array([likeness(a, b) for a, b in zip(made, changed, strict=True)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(made, nexts, strict=True)], pa.float64()),
            ],
            ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    out = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.select("id", "text", "range", "closing").withColumn("id", F.col("id").cast("long")).mapInArrow(work, out).withColumnRenamed("id", id_col)
