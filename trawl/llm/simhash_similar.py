"""Near-duplicate texts of a corpus: SimHash with Golay keys, completed to all pairs of a Jaccard similarity.

Texts link if their sets of word shingles have a Jaccard similarity of ``least``
or more. The fingerprints of ``simhash`` and their Golay keys name candidates,
and every candidate is verified on the whole sets, since fingerprints count
repeats, so that one repeated phrase can decide all their bits.

These keys cannot name all candidates: at a similarity of 0.8 two fingerprints
of 64 bits differ in 9.7 bits on average, while keys of equal and decoded
segments reach two; keys that reach further are shared by so many unlike texts
that their number grows with the square of the corpus. So each text also has min-hashes
of its set, taken three at a time as keys: as many keys as leave a pair at the
threshold unfound with a probability of ``MISS``, and less the more alike it is.
The low bytes of the same min-hashes then sort out the candidates that cannot
reach the threshold, again but for ``MISS``.

A key with thousands of texts never becomes pairs: its texts are first compared
with its first text; of those left outside the largest component few are paired
with the rest, and many are compared in blocks of bounded size, from which only
edges that join components come back. Nothing is capped, dropped or sampled.

Whole sets travel for the texts of candidates only. They are made again from the
texts, which a bitmap of ``BITS`` places (a bound on what is broadcast, not on
what is found) picks out before any shuffle.

Nulls, empty and odd input: null and empty texts are one text without shingles,
and texts with fewer words than a shingle have one shingle, of all their words;
a null id is an id like any other; rows with equal or null ids but different
words are different texts; an empty table gives an empty result; other columns
stay as they are, whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.llm.shared import connected_components, dropped, schema_of, stars, tidied, written
from trawl.llm.simhash import SEED, links

#: Probability that the search misses a pair exactly at the threshold; min-hashes of a key.
MISS, ROWS = 1e-7, 3
#: Texts outside a key's largest component up to which they are paired with the rest one by one.
MOST = 32
#: Rows and hashes of a side of a block, and columns of its matrices at once.
BLOCK_ROWS, BLOCK_HASHES, COLUMNS = 1_024, 250_000, 1_024
#: Edges up to which one task finds the components (16 MB); more take rounds of joins.
EDGES = 1_000_000
#: Places of the bitmap that picks texts out (4 MB). A corpus that fills it shuffles more texts and finds the same.
BITS, BUCKET = 1 << 25, 1 << 15
#: Rows described at once, and shingles hashed at once.
SLICE, PART = 256, 4_096

_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread bits from each number, one to one."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def plan(least: float, miss: float = MISS) -> tuple[int, int]:
    """How many keys the search needs, and how many of their min-hashes two sets at the threshold share at the least."""
    if least >= 1:
        return 1, ROWS
    tables = math.ceil(math.log(miss) / math.log(1 - least**ROWS))
    n, total = tables * ROWS, 0.0
    for few in range(n + 1):
        total += math.comb(n, few) * least**few * (1 - least) ** (n - few)
        if total > miss:
            return tables, few
    return tables, n


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def words_key(found: list[bytes]) -> bytes:
    """What stands for a sequence of lower-cased words."""
    return xxhash.xxh3_128_digest(b" ".join(found))


def shingle_hashes(found: list[bytes], shingle: int) -> np.ndarray:
    """A hash for each shingle, repeats included: the mixed hashes of its words, in order."""
    if not found:
        return np.zeros(0, np.uint64)
    size = min(shingle, len(found))
    each = np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(SEED)), np.uint64, len(found))
    out = np.full(len(found) - size + 1, size, np.uint64)
    for k in range(size):
        out = mixed(out * _MIX[0] + each[k : k + len(out)])
    return out


def print_of(hashes: np.ndarray) -> int:
    """The fingerprint: each bit is set that more than half of the hashes have."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PART):
        bits += np.unpackbits(hashes[at : at + PART].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def min_hashes(hashes: np.ndarray, count: int) -> np.ndarray:
    """The smallest of the hashes in ``count`` orders of their own."""
    salt = mixed(np.arange(1, count + 1, dtype=np.uint64) * _MIX[0])[:, None]
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), PART):
        least = np.minimum(least, mixed(hashes[None, at : at + PART] ^ salt).min(1))
    return least


def table_keys(least: np.ndarray) -> np.ndarray:
    """A key for each ``ROWS`` min-hashes in turn; keys of different places differ."""
    out = np.arange(len(least) // ROWS, dtype=np.uint64)
    for k in range(ROWS):
        out = mixed(out * _MIX[0] + least[k::ROWS])
    return out


def similar(docs: DataFrame, least: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, component_id`` of every row: the smallest id reachable by links, null if there is none."""
    rows, group = _grouped(docs, least, shingle, id_col, text_col)
    ids = written(group.groupBy("component").agg(F.min("least").alias("component_id")), "similar-ids")
    of_whole = written(group.join(ids, "component").select("whole", "component_id"), "similar-of")
    return rows.join(of_whole, "whole").select(F.col("id").alias(id_col), "component_id")


def one_of_each(docs: DataFrame, least: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group one row stays, with the smallest id of the group.

    Rows are told apart by their words, not by their ids: of groups that share an id, or have none, each keeps a row.
    Only rows whose id is that of a row which goes are shuffled.
    """
    rows, group = _grouped(docs, least, shingle, id_col, text_col)
    key = f"words_{uuid.uuid4().hex}"  # a name that no column of docs has
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "whole")).alias("first")
    chosen = written(group.groupBy("component").agg(first).select(F.col("first.whole").alias("chosen"), F.col("first.least").alias("of")), "similar-chosen")
    counted = written(rows.groupBy("whole", "id").agg(F.count("*").alias("n")), "similar-rows")
    taken = (F.col("whole") == F.col("chosen")) & F.col("id").eqNullSafe(F.col("of"))
    gone = written(counted.join(chosen, taken, "left_anti").select("whole", "id"), "similar-gone")
    again = written(counted.where("n > 1").join(chosen, taken, "left_semi").select("whole", "id"), "similar-again")
    for x in (counted, chosen):
        dropped(x)

    marked, mark = docs.withColumn(key, F.xxhash64(id_col)), _bitmap(gone.select("id").unionByName(again.select("id")))
    marked = _looked_up(marked, key, mark)
    rest = marked.where(f"NOT `{key}`").drop(key)
    place = docs.columns.index(text_col)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys_ = pa.array([words_key(words_of(x.as_py())) for x in batch.column(place)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys_], [*batch.schema.names, key])

    some = marked.where(key).drop(key).mapInArrow(named, T.StructType([*docs.schema, T.StructField(key, T.BinaryType())]))
    gone, again = (x.toDF(f"{key} gone", "of " + key) for x in (gone, again))
    same = (F.col(key) == F.col(f"{key} gone")) & F.col(id_col).eqNullSafe(F.col("of " + key))
    stay = some.join(gone, same, "left_anti")
    if not again.isEmpty():  # rows that share their id and their words
        stay = stay.join(again, same, "left_anti").unionByName(stay.join(again, same, "left_semi").dropDuplicates([id_col, key]))
    return rest.unionByName(stay.drop(key))


def _bitmap(ids: DataFrame) -> DataFrame:
    """The hashes of the ids as set bits: at most ``BITS / BUCKET`` rows of 4 KB."""
    at = F.pmod(F.xxhash64(F.col(ids.columns[0])), F.lit(BITS))
    bits = ids.select(F.floor(at / BUCKET).cast("long").alias("bucket"), (at % BUCKET).alias("bit"))
    return written(bits.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), "similar-bits")


def _looked_up(df: DataFrame, column: str, bitmap: DataFrame) -> DataFrame:
    """``df`` with its column of hashes replaced by whether the bitmap has them. No shuffle: the bitmap is broadcast, 4 MB at most."""
    bucket, bits = f"{column} bucket", f"{column} bits"
    at = F.pmod(F.col(column), F.lit(BITS))
    held = F.broadcast(bitmap.toDF(bucket, bits))
    joined = df.join(held, F.floor(at / BUCKET).cast("long") == F.col(bucket), "left")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(at % BUCKET / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return joined.withColumn(column, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop(bucket, bits)


def _grouped(docs: DataFrame, least: float, shingle: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``id, whole`` of every row (``whole`` stands for its words), and ``whole, least, component`` of each sequence of words, with its smallest id."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    tables, needed = plan(least)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part, rows = batch.slice(at, SLICE), []
                for text in part.column(1):
                    found = words_of(text.as_py())
                    hashes = shingle_hashes(found, shingle)
                    small = min_hashes(hashes, tables * ROWS)
                    rows.append((words_key(found), print_of(hashes), len(np.unique(hashes)), table_keys(small).view(np.int64), small.astype(np.uint8).tobytes()))
                whole, prints, n, keys_, low = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(whole, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(keys_, pa.list_(pa.int64())), pa.array(low, pa.binary())], ["id", "whole", "fp", "n", "keys", "low"])

    kinds = (("whole", T.BinaryType()), ("fp", T.LongType()), ("n", T.LongType()), ("keys", T.ArrayType(T.LongType())), ("low", T.BinaryType()))
    rows = written(texts.mapInArrow(described, T.StructType([schema_of(texts, "id"), *(T.StructField(n, t) for n, t in kinds)])), "similar")
    # Equal sequences of words count once; k numbers them.
    once = rows.groupBy("whole").agg(F.min("id").alias("least"), *(F.any_value(c).alias(c) for c, _ in kinds[1:]))
    unnumbered = written(once, "similar-once")
    distinct = written(unnumbered.withColumn("k", F.monotonically_increasing_id()), "similar-distinct")
    dropped(unnumbered)
    tidied(docs.sparkSession)
    edges = _Search(texts, distinct, least, shingle, needed).edges()
    of_text = written(connected_components(edges, "similar-components", EDGES), "similar-of")
    group = distinct.select("k", "whole", "least").join(of_text, F.col("k") == F.col("node"), "left")
    group = written(group.select("whole", "least", F.coalesce("component", "k").alias("component")), "similar-groups")
    dropped(distinct)
    tidied(docs.sparkSession)
    return rows.select("id", "whole"), group


class _Search:
    """The links of the texts ``distinct`` (``k, whole, least, fp, n, keys, low``), as edges ``a, b`` with the same components."""

    def __init__(self, texts: DataFrame, distinct: DataFrame, least: float, shingle: int, needed: int):
        self.texts, self.distinct, self.least, self.shingle, self.needed = texts, distinct, least, shingle, needed

    def edges(self) -> DataFrame:
        member = self.distinct.where("n > 0").select("k", "n", F.explode("keys").alias("key"))
        shared = written(member.groupBy("key").agg(F.min("k").alias("first"), F.count("*").alias("size")).where("size > 1").drop("size"), "similar-shared")
        self.member = written(member.join(shared, "key"), "similar-members")
        stars_ = self.member.where("k <> first").select(F.col("k").alias("a"), F.col("first").alias("b"))
        edges = self.verified(self.by_print().unionByName(stars_))

        placed, groups = self.open_groups(self.member, edges)
        few = placed.join(groups.where(F.col("outside") <= MOST), "key")
        one = few.where("c <> big").select("key", F.col("k").alias("a"), F.col("c").alias("ca"))
        other = few.select("key", F.col("k").alias("b"), F.col("c").alias("cb"), "big")
        pairs = one.join(other, "key").where("ca <> cb AND (cb = big OR a < b)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        edges = written(edges.unionByName(self.verified(pairs)), "similar-edges")

        many = written(groups.where(F.col("outside") > MOST).select("key"), "similar-many")
        if not many.isEmpty():
            edges = written(edges.unionByName(self.in_blocks(*self.open_groups(self.member.join(many, "key", "left_semi"), edges))), "similar-edges")
        dropped(self.member)
        return edges

    def by_print(self) -> DataFrame:
        """Candidates of equal fingerprints, and of fingerprints that Golay keys find within two bits."""
        by_print = written(self.distinct.groupBy("fp").agg(F.min("k").alias("first"), F.count("*").alias("texts")), "similar-prints")
        first = by_print.select("fp", "first")
        found = written(links(by_print), "similar-links")
        tidied(found.sparkSession)
        ends = found.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        same = self.distinct.select("fp", "k").join(by_print.where("texts > 1").select("fp", "first"), "fp").where("k <> first")
        return ends.unionByName(same.select(F.col("k").alias("a"), F.col("first").alias("b")))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs ``a, b`` that link."""
        needed = self.needed

        def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
                near = (x == y).sum(1) >= needed if batch.num_rows else []
                yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(near, pa.bool_()))

        low = self.distinct.where("n > 0").select("k", "n", "low")
        both = pairs.distinct().join(low.toDF("a", "na", "x"), "a").join(low.toDF("b", "nb", "y"), "b").where(self.fit("na", "nb")).select("a", "b", "x", "y")
        near = written(both.mapInArrow(possible, "a long, b long"), "similar-near")
        sets = self.sets(near.select(F.explode(F.array("a", "b")).alias("k")).distinct())
        common = F.size(F.array_intersect("x", "y"))
        both = near.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        found = written(both.where(common >= self.least * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b"), "similar-found")
        for x in (near, sets):
            dropped(x)
        tidied(found.sparkSession)
        return found

    def fit(self, n: str, m: str) -> Column:
        return F.least(n, m) >= self.least * F.greatest(n, m) - 1e-9

    def sets(self, ks: DataFrame) -> DataFrame:
        """``k, hashes``: the whole sets of these texts, made from one row of each."""
        shingle = self.shingle

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    found = [words_of(x.as_py()) for x in part.column(1)]
                    sets = [np.unique(shingle_hashes(x, shingle)).view(np.int64) for x in found]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(words_key, found), pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["id", "whole", "hashes"])

        wanted = written(self.distinct.select("k", "whole", "least").join(ks, "k", "left_semi"), "similar-wanted")
        some = _looked_up(self.texts.withColumn("known", F.xxhash64("id")), "known", _bitmap(wanted.select("least"))).where("known").drop("known")
        out = T.StructType([schema_of(self.texts, "id"), T.StructField("whole", T.BinaryType()), T.StructField("hashes", T.ArrayType(T.LongType()))])
        named = wanted.toDF("k", "words", "least")
        found = written(some.mapInArrow(hashed, out).join(named, (F.col("whole") == F.col("words")) & F.col("id").eqNullSafe(F.col("least"))).select("k", "hashes"), "similar-sets")
        again = written(found.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"), "similar-again")
        if again.isEmpty():
            return found
        # Rows that repeat their id and their words are found several times.
        once = written(found.join(again, "k", "left_anti").unionByName(found.join(again, "k", "left_semi").dropDuplicates(["k"])), "similar-sets")
        dropped(found)
        return once

    def open_groups(self, member: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The members with their components ``c``, and the keys whose members lie in several: the largest, and how many lie outside of it."""
        of = written(connected_components(edges, "similar-components", EDGES), "similar-of")
        placed = written(member.join(of, member.k == of.node, "left").select("key", "k", "n", F.coalesce("component", "k").alias("c")), "similar-placed")
        sizes = placed.groupBy("key", "c").agg(F.count("*").alias("size")).groupBy("key").agg(F.max_by("c", F.struct("size", "c")).alias("big"), (F.sum("size") - F.max("size")).alias("outside"))
        return placed, written(sizes.where("outside > 0"), "similar-open")

    def in_blocks(self, placed: DataFrame, groups: DataFrame) -> DataFrame:
        """Edges that join what is linked within the keys: what lies outside the largest component with all the rest, in blocks."""
        least = self.least

        def compare(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            k, right = table.column("k").to_numpy(), table.column("right").to_numpy()
            rows = [x.values.to_numpy(zero_copy_only=False) for x in table.column("hashes")]
            a, b = np.nonzero(~right)[0], np.nonzero(right)[0]
            found = alike(rows, a, b, least, k) if len(a) and len(b) else []
            one, two = (np.concatenate([np.zeros(0, np.int64), *(e[side] for e in found)]).astype(np.int64) for side in (0, 1))
            apart = k[one] != k[two]
            return pa.table({"a": pa.array(k[one][apart], pa.int64()), "b": pa.array(k[two][apart], pa.int64())})

        crowd = written(placed.join(groups, "key").select("key", "k", "n", (F.col("c") != F.col("big")).alias("out")), "similar-crowd")
        blocks = lambda rows, hashes: F.ceil(F.greatest(rows / BLOCK_ROWS, hashes / BLOCK_HASHES)).cast("int")
        outside = F.when(F.col("out"), F.col("n"))
        counted = written(crowd.groupBy("key").agg(blocks(F.count(outside), F.sum(outside)).alias("ps"), blocks(F.count("*"), F.sum("n")).alias("qs")), "similar-blocks")
        crowd = crowd.join(counted, "key")
        own = lambda parts: F.pmod(F.xxhash64("k"), F.col(parts)).cast("int")
        all_of = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
        left = crowd.where("out").select("key", "k", own("ps").alias("p"), all_of("qs").alias("q"), F.lit(False).alias("right"))
        right = crowd.select("key", "k", all_of("ps").alias("p"), own("qs").alias("q"), F.lit(True).alias("right"))
        sets = self.sets(crowd.select("k").distinct())
        dealt = written(left.unionByName(right), "similar-dealt")
        tidied(dealt.sparkSession)
        return dealt.join(sets, "k").groupBy("key", "p", "q").applyInArrow(compare, "a long, b long")


def alike(rows: list[np.ndarray], a: np.ndarray, b: np.ndarray, least: float, names: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that join what is joined by pairs of sets, one of ``a`` and one of ``b``, of that Jaccard similarity or more.
    Sets of one name are not compared."""
    names = np.arange(len(rows)) if names is None else names
    sizes = np.array([len(x) for x in rows])
    values, often = np.unique(np.concatenate(rows), return_counts=True)
    values = values[often > 1]
    row = np.repeat(np.arange(len(rows)), sizes)
    column = np.searchsorted(values, flat := np.concatenate(rows))
    known = column < len(values)
    known[known] = values[column[known]] == flat[known]
    row, column = row[known], column[known]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, len(values), COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        has = np.zeros((len(rows), COLUMNS), np.float32)
        has[row[lo:hi], column[lo:hi] - at] = 1
        common += has[a] @ has[b].T
    edges = []
    for at in range(0, len(a), 512):
        some, inter = a[at : at + 512], common[at : at + 512].astype(np.float64)
        linked = inter >= least * (sizes[some][:, None] + sizes[b][None, :] - inter) - 1e-9
        linked &= names[some][:, None] != names[b][None, :]
        rows_, cols = linked.any(1), linked.any(0)
        if rows_.any():
            edges += stars(linked[rows_][:, cols], some[rows_], b[cols])
    return edges
