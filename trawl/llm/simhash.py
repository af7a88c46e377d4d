"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprint: 64 bits, each set where more than half of the hashes of a text's
word shingles have it set. Two fingerprints link at two or fewer differing bits.

Search: a fingerprint is cut into three segments of 22, 21 and 21 bits. Of two
fingerprints that link, one segment is equal (two errors, three segments), and
the segment after it differs in two bits at most. That next segment is decoded
with the perfect binary Golay code (23, 12): the indices of the codewords
nearest to it and to its 23 one-bit neighbours are its keys, one to six of
them. Words two bits apart have a word between them, one bit from either, so
they share the index which that word decodes to: no link is lost. A key is the
equal segment, 21 or 22 bits, with a 12-bit index; rows that share a key are
joined and verified.

Only distinct fingerprints take part; copies follow by membership. Where more
than ``MOST`` fingerprints share a key, no pairs are formed: each of them names
the 65 words within one bit, and fingerprints that name the same word are within
two bits of each other, hence linked with the smallest of them. That is exact
and linear in the size of the group.

Nulls, empty and odd input: a null text counts as empty (fingerprint zero); a
null id stays and takes the smallest id of its group, null if there is none;
repeated rows share a group; an empty table gives an empty result; other columns
are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.llm.shared import connected_components, schema_of, written

SEED = 42
#: Bits of the three segments.
SEGMENTS = (22, 21, 21)
#: Differing bits up to which fingerprints link; the search below is made for two.
DISTANCE = 2
#: Fingerprints of one key up to which its pairs are formed and verified.
MOST = 32
#: Generator polynomial of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Shingles hashed at once.
BLOCK = 65_536


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64 bits of one text, unsigned."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    total, digest, join, set_bits = len(found) - shingle + 1, xxhash.xxh64_intdigest, b" ".join, np.zeros(64, np.int64)
    for at in range(0, total, BLOCK):
        part = found[at : at + BLOCK + shingle - 1]
        hashes = np.fromiter((digest(join(x), SEED) for x in zip(*(part[k:] for k in range(shingle)), strict=False)), np.uint64)
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > total, bitorder="little").view("<u8")[0])


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits of a word, and the error of weight three or less of each syndrome."""

    def remainder(word: int) -> int:
        for k in range(22, 10, -1):
            if word >> k & 1:
                word ^= GENERATOR << (k - 11)
        return word

    low = np.array([remainder(x) for x in range(1 << 12)], np.uint32)
    high = np.array([remainder(x << 12) for x in range(1 << 11)], np.uint32)
    errors = np.zeros(1 << 11, np.uint32)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            word = sum(1 << b for b in bits)
            errors[remainder(word)] = word
    return low, high, errors


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """Index of the nearest codeword of each word and of its 23 neighbours: a column each, with repeats."""
    low, high, errors = golay_tables()
    near = words.astype(np.uint32)[:, None] ^ np.array([0, *(1 << k for k in range(23))], np.uint32)
    return (near ^ errors[low[near & 0xFFF] ^ high[near >> 12]]) >> 11


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of fingerprints (uint64): row numbers, keys. Of 64 bits: the equal segment's number, its bits, the index."""
    shifts = np.cumsum((0, *SEGMENTS[:-1]))
    parts = [(prints >> np.uint64(s)) & np.uint64((1 << w) - 1) for s, w in zip(shifts, SEGMENTS, strict=True)]
    rows, out = [], []
    for k in range(3):
        index = np.sort(codeword_indices(parts[(k + 1) % 3]), axis=1)
        new = np.ones(index.shape, bool)
        new[:, 1:] = index[:, 1:] != index[:, :-1]
        at, col = np.nonzero(new)
        rows.append(at)
        out.append((np.uint64(k) << np.uint64(40)) | (parts[k][at] << np.uint64(12)) | index[at, col].astype(np.uint64))
    return np.concatenate(rows), np.concatenate(out).astype(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, fp``: the fingerprint of every row as a signed long. No shuffle."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return texts.mapInArrow(hashed, T.StructType([schema_of(texts, "doc_id"), T.StructField("fp", T.LongType())]))


def links(distinct: DataFrame, most: int = MOST) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints (column ``fp``) whose components are those of all links."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False)
            at, found = keys(prints.astype(np.int64).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(prints[at])], ["key", "fp"])

    spread_out = written(distinct.select("fp").mapInArrow(spread, "key long, fp long"), "simhash-keys")
    shared = written(spread_out.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-shared")
    small = written(spread_out.join(shared.where(F.col("n") <= most), "key", "left_semi"), "simhash-small")
    a, b = small.select("key", F.col("fp").alias("a")), small.select("key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    pairs = a.join(b, "key").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    crowd = spread_out.join(shared.where(F.col("n") > most), "key", "left_semi").select("fp").distinct()
    within_one = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")) for k in range(64)))
    named = written(crowd.select("fp", F.explode(within_one).alias("w")), "simhash-named")
    first = written(named.groupBy("w").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n"), "simhash-first")
    stars = named.join(first, "w").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id_col, fingerprint, component_id`` of every row: 16 hexadecimal digits, and the smallest id reachable by links."""
    prints = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = connected_components(links(distinct), "simhash-components")
    group = distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    group = written(group, "simhash-groups")
    ids = written(group.groupBy("component").agg(F.min("least").alias("component_id")), "simhash-ids")
    of_print = written(group.join(ids, "component").select("fp", "component_id"), "simhash-of")
    return prints.join(of_print, "fp").select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
