"""Graph operators over relations: expansion of hits, paths, neighbourhoods, degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.sources.records import adjacency

FOLLOWED = ("Ownership", "Directorship", "Family", "Associate")
DECAY = 0.45

# How a relation reads from its source, and from its target.
PHRASES = {
    "Ownership": ("owns", "owned by"),
    "Directorship": ("director of", "has director"),
    "Family": ("relative of", "relative of"),
    "Associate": ("associate of", "associate of"),
    "Membership": ("member of", "has member"),
    "Employment": ("employed by", "employs"),
    "Representation": ("represents", "represented by"),
    "Succession": ("succeeded by", "successor of"),
    "UnknownLink": ("linked to", "linked to"),
}


def expand(run: DataFrame, relations: DataFrame, entities: DataFrame, hops: int = 1, max_extra: int | None = 20, decay: float = DECAY, follow: tuple[str, ...] = FOLLOWED, strict: bool = False) -> DataFrame:
    """The hits, then their neighbours, in the order in which a search from the best hit on meets them.

    A neighbour's score is that of the first node that reaches it, times ``decay``;
    ids without an entity are skipped. No node is visited once ``max_extra``
    neighbours have been found before it, so the last one visited may go beyond;
    ``strict`` cuts there.
    """
    near = adjacency(relations).where(F.col("schema").isin(*follow)).select("node", "neighbour", "edge")
    near = near.join(entities.select(F.col("id").alias("neighbour")), "neighbour", "left_semi")
    seen = run.select("query_id", "doc_id", "score", "rank")
    front, base = seen, run.groupBy("query_id").agg(F.max("rank").alias("last"), F.count("*").alias("hits"))
    before = base.select("query_id", F.lit(0).cast("long").alias("found"))
    for _ in range(hops):
        met = front.select("query_id", F.col("doc_id").alias("node"), "score", "rank").join(near, "node")
        met = met.join(seen.select("query_id", F.col("doc_id").alias("neighbour")), ["query_id", "neighbour"], "left_anti")
        first = met.groupBy("query_id", "neighbour").agg(F.min(F.struct("rank", "edge", "score")).alias("m"))
        place = Window.partitionBy("query_id").orderBy("m.rank", "m.edge", "neighbour")
        new = first.select("query_id", F.col("neighbour").alias("doc_id"), (F.col("m.score") * decay).alias("score"), F.col("m.rank").alias("parent"), F.row_number().over(place).cast("long").alias("nth")).join(before, "query_id")
        if max_extra is not None:
            # What was found before the parent's turn decides whether it is visited at all.
            turn = F.min("nth").over(Window.partitionBy("query_id", "parent")) - 1 + F.col("found")
            new = new.withColumn("turn", turn).where(F.col("turn") < max_extra)
            new = new.where(F.col("nth") + F.col("found") <= max_extra) if strict else new
        front = new.join(base, "query_id").select("query_id", "doc_id", "score", (F.col("last") + F.col("found") + F.col("nth")).alias("rank"))
        seen = seen.unionByName(front)
        before = seen.groupBy("query_id").agg(F.count("*").alias("n")).join(base, "query_id").select("query_id", (F.col("n") - F.col("hits")).alias("found"))
    return seen


def shortest_paths(pairs: DataFrame, relations: DataFrame, max_hops: int = 3) -> DataFrame:
    """``src, dst, path, hops`` of the pairs that have a path of at most ``max_hops`` relations, of any kind, in any direction.

    Of several shortest paths the lexicographically smallest. A step keeps one path
    for each pair and node, so it grows with nodes reached, not with paths.
    """
    near = adjacency(relations).select("node", "neighbour").distinct()
    wanted = pairs.select("src", "dst").distinct()
    found = wanted.where("src = dst").select("src", "dst", F.array("src").alias("path"))
    front = wanted.where("src <> dst").select("src", F.array("src").alias("path"), F.col("src").alias("at")).distinct()
    seen = front.select("src", "at")
    for _ in range(max_hops):
        step = front.withColumnRenamed("at", "node").join(near, "node").select("src", F.concat("path", F.array("neighbour")).alias("path"), F.col("neighbour").alias("at"))
        step = step.join(seen, ["src", "at"], "left_anti").groupBy("src", "at").agg(F.min("path").alias("path"))
        found = found.unionByName(step.withColumnRenamed("at", "dst").join(wanted, ["src", "dst"]).select("src", "dst", "path"))
        seen = seen.unionByName(step.select("src", "at"))
        front = step
    return found.select("src", "dst", "path", (F.size("path") - 1).alias("hops"))


def within(seeds: DataFrame, relations: DataFrame, hops: int = 2) -> DataFrame:
    """``id``: nodes at most ``hops`` relations from a seed (column ``id``), seeds included."""
    near = adjacency(relations).select("node", F.col("neighbour").alias("id")).distinct()
    seen = seeds.select("id").distinct()
    front = seen
    for _ in range(hops):
        new = front.withColumnRenamed("id", "node").join(near, "node").select("id").distinct()
        front = new.join(seen, "id", "left_anti")
        seen = seen.unionByName(front)
    return seen


def connected(relations: DataFrame) -> DataFrame:
    """``id``: every end of a relation."""
    return relations.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()


def select_ids(entities: DataFrame, relations: DataFrame, mode: str = "connected", seed: str | None = None, hops: int = 2) -> DataFrame:
    if mode == "all":
        return entities.select("id").distinct()
    if seed is None:
        return connected(relations)
    return within(entities.sparkSession.createDataFrame([(seed,)], "id string"), relations, hops)


def induced(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Relations with both ends among ``ids``."""
    for end in ("source_id", "target_id"):
        relations = relations.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    return relations


def degrees(relations: DataFrame) -> DataFrame:
    """``id, degree``: each relation counts at both its ends."""
    return relations.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def hubs(relations: DataFrame, top: int = 25) -> DataFrame:
    return degrees(relations).orderBy(F.desc("degree"), "id").limit(top)


def phrase(schema: Column, way: int) -> Column:
    """How a relation reads: ``way`` 0 from its source, 1 from its target."""
    out = F.lit("linked to")
    for name, both in PHRASES.items():
        out = F.when(schema == name, F.lit(both[way])).otherwise(out)
    return out


def phrased(relations: DataFrame) -> DataFrame:
    """``id, other, phrase, detail`` for both ends of every relation; detail: its share and start, if given."""
    p = F.col("properties")
    detail = F.concat_ws(", ", F.try_element_at(p["percentage"], F.lit(1)), F.try_element_at(p["startDate"], F.lit(1)))
    both = F.array(
        F.struct(F.col("source_id").alias("id"), F.col("target_id").alias("other"), phrase(F.col("schema"), 0).alias("phrase")),
        F.struct(F.col("target_id").alias("id"), F.col("source_id").alias("other"), phrase(F.col("schema"), 1).alias("phrase")),
    )
    return relations.select(F.explode(both).alias("e"), detail.alias("detail")).select("e.*", "detail")


def view(entity_ids: DataFrame, relations: DataFrame, entities: DataFrame, limit: int | None = None) -> DataFrame:
    """Neighbours of each ``id`` that have an entity: ``id, neighbour, caption, relation, direction``; ``limit`` for each id."""
    near = adjacency(relations).join(entity_ids.select(F.col("id").alias("node")), "node", "left_semi")
    out = near.join(entities.select(F.col("id").alias("neighbour"), "caption"), "neighbour")
    if limit is not None:
        out = out.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("edge", "neighbour"))).where(F.col("n") <= limit)
    return out.select(F.col("node").alias("id"), "neighbour", "caption", F.col("schema").alias("relation"), "direction")
