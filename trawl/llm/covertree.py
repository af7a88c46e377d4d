"""Embedding near-duplicates: all pairs above a cosine, by dual traversal of cover trees.

Unit vectors have cosine >= c where their distance is <= t = sqrt(2 - 2c), so
covering radii bound distances by the triangle inequality. Three ranges of levels:

1. Upper levels, over a bounded sample: dense places (``cores``: balls of radius
   t/2 at most, whose members all link with each other) and, from a
   farthest-first order, whose prefixes are nested nets of falling radius, one
   cell for each ``BLOCK`` vectors. Every vector is put into a core or the
   nearest cell; radii and sizes of these nodes are then exact, over all vectors.
2. A vector against a node, at distance d from its centre and radius r: beyond
   d - r > t nothing links; at d + r <= t every member links, so that for a core
   sizes are added and one link to its representative is kept, without a pair;
   else, and for a cell, the vector goes to the blocks of that node.
3. A block pair (``BLOCK`` rows a side at most; large nodes are dealt into
   blocks) is searched by dual traversal of two local trees whose levels halve
   the radius; node pairs are pruned or taken whole by the same bounds, and
   leaves are compared in double precision.

A pair of blocks gives back, for each vector, the number of its links and one
link to a representative, never all pairs. Vectors spread evenly over many
dimensions let no tree prune; then every block pair is computed, which grows with
the square of the vectors, as any exact search of such data does.

Nulls, empty and odd input: a vector that is null, zero, empty, or holds a null
or non-finite component links with nothing and is a component of its own; so do
vectors of different lengths among each other; a null id stays, and a component
takes the smallest id it has; rows that repeat an id are vectors of their own; an
empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.llm.shared import connected_components, stars, written

#: Vectors of the sample that the upper levels are chosen from; rows of a block.
SAMPLE, BLOCK = 2048, 8192
#: Share of the sample within half the threshold that makes a core, and the most cores.
DENSE, CORES = 0.004, 128
#: Slack of every bound: distances near zero carry rounding of this order.
SLACK = 1e-6
#: Rows of a leaf that are compared at once.
STRIP = 512
#: Rows of a leaf; centres that are tried before a level that doesn't gather vectors is given up.
LEAF, TRIED = 64, 64


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a @ b.T
    out *= -2
    out += 2
    np.maximum(out, 0, out=out)
    return np.sqrt(out, out=out)


class Nodes:
    """The upper levels: centres (cells first, then cores), and what all vectors make of them."""

    def __init__(self, sample: np.ndarray, count: int, reach: float):
        self.reach = reach
        near = distances(sample, sample) <= reach / 2 - SLACK
        covered, cores, least = np.zeros(len(sample), bool), [], max(8, DENSE * len(sample))
        while len(cores) < CORES:
            score = (near & ~covered).sum(1)
            best = int(score.argmax())
            if score[best] < least:
                break
            cores.append(best)
            covered |= near[best]
        free = sample[~covered] if not covered.all() else sample[:1]
        wanted, cells = min(len(free), math.ceil(count / BLOCK)), [0]
        far = distances(free, free[:1])[:, 0]
        while len(cells) < wanted and far.max() > 0:
            cells.append(int(far.argmax()))
            np.minimum(far, distances(free, free[cells[-1:]])[:, 0], out=far)
        self.n_cells = len(cells)
        self.centres = np.concatenate([free[cells], sample[cores]])
        self.size = self.radius = self.rep = None

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Node of each vector, and the distances to all centres."""
        d = distances(x, self.centres)
        node = d[:, : self.n_cells].argmin(1)
        if d.shape[1] > self.n_cells:
            core = d[:, self.n_cells :].argmin(1) + self.n_cells
            node = np.where(d[np.arange(len(x)), core] <= self.reach / 2 - SLACK, core, node)
        return node, d

    def measure(self, rows: list) -> None:
        k = len(self.centres)
        self.size, self.radius, self.rep = np.zeros(k, np.int64), np.zeros(k), np.full(k, -1, np.int64)
        for r in rows:
            self.size[r.node], self.radius[r.node], self.rep[r.node] = r.n, r.radius, r.rep
        self.blocks = np.maximum(1, -(-self.size // BLOCK))
        apart = distances(self.centres, self.centres) - self.radius[:, None] - self.radius[None, :]
        self.meet = (apart <= self.reach + SLACK) & (self.size[:, None] > 0) & (self.size[None, :] > 0)

    def links_whole(self, d: np.ndarray) -> np.ndarray:
        """Cores only: members of a cell need not link with each other, so each has to meet the vector in a block."""
        return (d + self.radius <= self.reach - SLACK) & (np.arange(len(self.centres)) >= self.n_cells)

    def beyond(self, d: np.ndarray) -> np.ndarray:
        return d - self.radius > self.reach + SLACK


def unit(column: pa.Array, kind: str) -> np.ndarray:
    """Packed vectors as rows of length one, in double precision."""
    x = np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.float64).reshape(len(column), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)  # against overflow and underflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Tree:
    """Levels of a block: a node has a centre, an exact covering radius, its members, and children of half the radius."""

    def __init__(self, x: np.ndarray, members: np.ndarray, level: float = 1.0):
        self.members, self.centre = members, x[members[0]]
        d = distances(x[members], self.centre[None, :])[:, 0]
        self.radius, self.children = float(d.max()), []
        while level >= self.radius and level > SLACK:
            level /= 2
        if len(members) <= LEAF or self.radius <= SLACK or level <= SLACK:
            return
        left, parts, small, picks, gathered = members, [], [], 0, 0
        while len(left):
            within = distances(x[left], x[left[:1]])[:, 0] <= level
            within[0] = True
            (parts if within.sum() >= LEAF else small).append(left[within])
            picks, gathered, left = picks + 1, gathered + within.sum(), left[~within]
            if picks == TRIED:
                if gathered < 2 * TRIED:
                    break
                picks = gathered = 0
        # What lies in no dense place stays together: a table of distances serves it better than nodes of a few vectors.
        rest = np.concatenate([*small, left])
        if parts and len(parts) + len(rest) > 1:
            self.children = [Tree(x, p, level / 2) for p in parts] + ([Tree(x, rest, 0.0)] if len(rest) else [])


def local_links(xa: np.ndarray, xb: np.ndarray | None, least: float, reach: float) -> tuple[np.ndarray, np.ndarray, list]:
    """Links between two blocks, or within one (``xb`` None): how many each row has, and edges between row
    numbers (those of b after those of a) that join what the links join."""
    alone = xb is None
    ta = Tree(xa, np.arange(len(xa)))
    tb, xb = (ta, xa) if alone else (Tree(xb, np.arange(len(xb))), xb)
    na, nb, shift, edges = np.zeros(len(xa), np.int64), np.zeros(len(xb), np.int64), 0 if alone else len(xa), []
    todo = [(ta, tb)]
    while todo:
        a, b = todo.pop()
        d = float(distances(a.centre[None, :], b.centre[None, :])[0, 0])
        if d - a.radius - b.radius > reach + SLACK:
            continue
        if d + a.radius + b.radius <= reach - SLACK:
            na[a.members] += len(b.members)
            nb[b.members] += len(a.members)
            if alone:
                na[np.intersect1d(a.members, b.members)] -= 1
            edges += [_star(a.members, b.members[0] + shift), _star(b.members + shift, a.members[0])]
        elif a.children and (a.radius >= b.radius or not b.children):
            todo += [(c, b) for c in a.children]
        elif b.children:
            todo += [(a, c) for c in b.children]
        else:
            for at in range(0, len(a.members), STRIP):
                some = a.members[at : at + STRIP]
                linked = xa[some] @ xb[b.members].T >= least
                if alone:
                    linked &= some[:, None] != b.members[None, :]
                na[some] += linked.sum(1)
                nb[b.members] += linked.sum(0)
                rows, cols = linked.any(1), linked.any(0)
                if rows.any():
                    edges += stars(linked[rows][:, cols], some[rows], b.members[cols] + shift)
    return na, nb, edges


def _star(members: np.ndarray, hub: int) -> tuple[np.ndarray, np.ndarray]:
    return members, np.full(len(members), hub)


def near_duplicates(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col, n_links, component_id, kept`` of every row."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    fine = F.size("v") > 0
    for bad in (lambda x: x.isNull(), lambda x: x.isNaN(), lambda x: F.abs(x) == float("inf")):
        fine &= ~F.exists("v", bad)
    fine = F.coalesce(fine & F.exists("v", lambda x: x != 0), F.lit(False))
    kind = "<f4" if isinstance(rows.schema["v"].dataType.elementType, T.FloatType) else "<f8"  # whole and decimal numbers too are compared as doubles
    as_kind = F.when(fine, F.col("v").cast("array<double>" if kind == "<f8" else "array<float>"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(2)
            flat, ends = v.flatten().to_numpy(zero_copy_only=False).astype(kind), np.cumsum([len(x) if x.is_valid else 0 for x in v])
            packed = [flat[e - len(x) : e].tobytes() if x.is_valid else None for x, e in zip(v, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["k", "id", "v"])

    numbered = rows.select(F.monotonically_increasing_id().alias("k"), "id", as_kind.alias("v"))
    out = T.StructType([T.StructField("k", T.LongType()), T.StructField("id", rows.schema["id"].dataType), T.StructField("v", T.BinaryType())])
    packed = written(numbered.mapInArrow(pack, out), "covertree")
    counts = edges = None
    for length in [r[0] for r in packed.where("v IS NOT NULL").select(F.octet_length("v")).distinct().collect()]:
        some = packed.where(F.octet_length("v") == length).select("k", "v")
        n, e = _links(some, least, kind)
        counts, edges = (n, e) if counts is None else (counts.unionByName(n), edges.unionByName(e))
    if counts is None:
        return packed.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    total = written(counts.groupBy("k").agg(F.sum("n").alias("n")), "covertree-counts")
    of_row = written(connected_components(edges, "covertree-components"), "covertree-components").withColumnRenamed("node", "k")
    numbers = packed.select("k", "id")
    ids = of_row.join(numbers, "k").groupBy("component").agg(F.min("id").alias("component_id"))
    of_row = written(of_row.join(written(ids, "covertree-ids"), "component").select("k", "component_id"), "covertree-of")
    both = numbers.join(total, "k", "left").join(of_row, "k", "left")
    group = F.coalesce("component_id", "id")
    return both.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), group.alias("component_id"), F.col("id").eqNullSafe(group).alias("kept"))


def _links(packed: DataFrame, least: float, kind: str) -> tuple[DataFrame, DataFrame]:
    """Numbers of links ``k, n`` (to be added up) and edges ``a, b`` among vectors of one length."""
    reach, spark = math.sqrt(2 - 2 * least), packed.sparkSession
    sample = packed.orderBy(F.xxhash64("k")).limit(SAMPLE).toArrow()
    nodes = Nodes(unit(sample.column("v"), kind), packed.count(), reach)
    shared = spark.sparkContext.broadcast(nodes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                node, d = shared.value.place(unit(batch.column(1), kind))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node), pa.array(d[np.arange(len(node)), node])], ["k", "node", "d"])

    measured = packed.mapInArrow(place, "k long, node long, d double").groupBy("node").agg(F.count("*").alias("n"), F.max("d").alias("radius"), F.min("k").alias("rep"))
    nodes.measure(measured.collect())
    known = spark.sparkContext.broadcast(nodes)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors that link with all of a core, their own included."""
        t = known.value
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column(0).to_numpy()
            node, d = t.place(unit(batch.column(1), kind))
            rank = np.arange(len(t.centres))
            took = t.links_whole(d) & t.meet[node] & (rank > node[:, None])
            took[np.arange(len(k)), node] = node >= t.n_cells
            at, to = np.nonzero(took)
            yield pa.RecordBatch.from_arrays([pa.array(k[at]), pa.array(node[at]), pa.array(to), pa.array(t.size[to] - (node[at] == to)), pa.array(t.rep[to])], ["k", "node", "whole", "n", "rep"])

    took = written(packed.mapInArrow(whole, "k long, node long, whole long, n long, rep long"), "covertree-whole")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector once for each block pair that it has to be compared in."""
        t = known.value
        first = np.concatenate([[0], np.cumsum(t.blocks)])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                k, x = part.column(0).to_numpy(), part.column(1)
                node, d = t.place(unit(x, kind))
                rank = np.arange(len(t.centres))
                open_ = t.meet[node] & ~t.beyond(d)
                later = open_ & (rank > node[:, None]) & ~t.links_whole(d)
                same = (rank == node[:, None]) & (rank < t.n_cells)
                own = first[node] + _deal(k, t.blocks[node])
                rows, left, right = [], [], []
                for i, other in zip(*np.nonzero(later | same | (open_ & (rank < node[:, None]))), strict=True):
                    for block in range(first[other], first[other + 1]):
                        rows.append(i)
                        left.append(min(own[i], block))
                        right.append(max(own[i], block))
                mine = own[rows] if rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(mine == np.array(right, np.int64), pa.bool_()), pa.array(k[rows] if rows else k[:0]), x.take(pa.array(rows, pa.int64()))],
                    ["p", "q", "late", "k", "v"],
                )

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        x, k, late = unit(table.column("v"), kind), table.column("k").to_numpy(), table.column("late").to_numpy()
        if p == q:
            n, _, edges = local_links(x, None, least, reach)
            ids = k
        else:
            a, b = np.nonzero(~late)[0], np.nonzero(late)[0]
            ids = np.concatenate([k[a], k[b]])
            if not len(a) or not len(b):
                return _found(ids[:0], ids[:0], [])
            na, nb, edges = local_links(x[a], x[b], least, reach)
            n = np.concatenate([na, nb])
        return _found(ids, n, edges)

    pairs = packed.mapInArrow(deal, "p long, q long, late boolean, k long, v binary")
    found = written(pairs.groupBy("p", "q").applyInArrow(compare, "k long, n long, to long"), "covertree-found")
    given = took.where("node <> whole").groupBy("whole").agg(F.count("*").alias("more"))
    members = took.where("node = whole").select("k", "whole").join(written(given, "covertree-given"), "whole").select("k", F.col("more").alias("n"))
    counts = found.where("n IS NOT NULL").select("k", "n").unionByName(took.select("k", "n")).unionByName(members)
    edges = found.where("to IS NOT NULL").select(F.col("k").alias("a"), F.col("to").alias("b")).unionByName(took.select(F.col("k").alias("a"), F.col("rep").alias("b")))
    return counts, edges


def _deal(k: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    mixed = (k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return (mixed % blocks.astype(np.uint64)).astype(np.int64)


def _found(ids: np.ndarray, n: np.ndarray, edges: list) -> pa.Table:
    some = n > 0
    a = np.concatenate([np.zeros(0, np.int64), *(e[0] for e in edges)]).astype(np.int64)
    b = np.concatenate([np.zeros(0, np.int64), *(e[1] for e in edges)]).astype(np.int64)
    keep = a != b
    a, b = ids[a[keep]], ids[b[keep]]
    none = pa.nulls
    return pa.table({
        "k": pa.concat_arrays([pa.array(ids[some], pa.int64()), pa.array(a, pa.int64())]),
        "n": pa.concat_arrays([pa.array(n[some], pa.int64()), none(len(a), pa.int64())]),
        "to": pa.concat_arrays([none(int(some.sum()), pa.int64()), pa.array(b, pa.int64())]),
    })
