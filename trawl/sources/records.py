"""Records: reading, routing to entities and relations, storing, looking up.

A record that names both ends of a known kind of edge is a relation; other
records are entities, but for a few kinds that only describe one. An edge record
without both ends is stored as an entity (``strict_edges`` drops it instead).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl import schemas
from trawl.functions.text import first_of

# Kinds of edges with the properties of their ends, properties that are searched (in order), kinds that aren't entities.
EDGES = {
    "Ownership": ("owner", "asset"),
    "Directorship": ("director", "organization"),
    "Family": ("person", "relative"),
    "Associate": ("person", "associate"),
    "Membership": ("member", "organization"),
    "Employment": ("employee", "employer"),
    "UnknownLink": ("subject", "object"),
    "Representation": ("agent", "client"),
    "Succession": ("predecessor", "successor"),
}
SEARCHED = (
    "name alias weakAlias previousName fatherName motherName position notes summary program programId country nationality "
    "jurisdiction birthDate birthPlace incorporationDate address registrationNumber taxNumber idNumber passportNumber imoNumber "
    "sanctionStatus topics"
).split()
NOT_ENTITIES = ("Address", "Sanction", "Identification")
EDGE_PROPERTIES = ("percentage", "role", "startDate", "endDate")
#: Values of a property that are searched or listed.
VALUES = 8


def read_records(spark: SparkSession, *paths: str) -> DataFrame:
    """Records of JSON lines, with their place (``ord``: file, then position in it). Blank, broken and id-less lines are skipped.

    A property whose value isn't a list counts as absent, and takes no other property with it.
    """
    lines = spark.read.text(list(paths)).select(F.trim("value").alias("line"), F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")).alias("ord"))
    parsed = lines.where("line <> ''").select("ord", F.try_parse_json("line").alias("v")).where("v IS NOT NULL")

    def get(path: str, kind: str) -> Column:
        return F.try_variant_get("v", path, kind)

    lists = F.map_filter(F.coalesce(get("$.properties", "map<string,variant>"), F.create_map().cast("map<string,variant>")), lambda _, x: F.startswith(F.schema_of_variant(x), F.lit("ARRAY")))
    properties = F.transform_values(lists, lambda _, x: F.try_variant_get(x, "$", "array<string>"))
    return parsed.select("ord", get("$.id", "string").alias("id"), get("$.schema", "string").alias("schema"), get("$.caption", "string").alias("caption"), get("$.datasets", "array<string>").alias("datasets"), properties.alias("properties")).where("id IS NOT NULL")


def limited(records: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` records over all files, in order."""
    return records if limit is None else records.orderBy("ord").limit(limit)


def _ends() -> tuple[Column, Column]:
    def end(k: int) -> Column:
        return reduce(lambda out, x: out.when(F.col("schema") == x[0], first_of(F.col("properties"), x[1][k])), list(EDGES.items())[1:], F.when(F.col("schema") == next(iter(EDGES)), first_of(F.col("properties"), next(iter(EDGES.values()))[k])))

    return end(0), end(1)


def _is_edge() -> Column:
    source, target = _ends()
    return F.coalesce((source != "") & (target != ""), F.lit(False))


def relations_of(records: DataFrame) -> DataFrame:
    source, target = _ends()
    role = F.coalesce(F.nullif(first_of(F.col("properties"), "role"), F.lit("")), first_of(F.col("properties"), "percentage"))
    kept = F.map_filter("properties", lambda k, _: k.isin(*EDGE_PROPERTIES))
    return records.where(_is_edge()).select("ord", "id", "schema", source.alias("source_id"), target.alias("target_id"), role.alias("role"), kept.alias("properties"))


def search_text() -> Column:
    """The caption and the first values of the searched properties, in one string."""
    none = F.array().cast("array<string>")
    parts = [F.array(F.coalesce("caption", F.lit(""))), *(F.coalesce(F.slice(F.col("properties")[k], 1, VALUES), none) for k in SEARCHED)]
    return F.array_join(F.filter(F.concat(*parts), lambda x: x.isNotNull() & (x != "")), " ")


def _up_to(values: Column) -> Column:
    return F.coalesce(F.slice(values, 1, VALUES), F.array().cast("array<string>"))


def entities_of(records: DataFrame, strict_edges: bool = False) -> DataFrame:
    wanted = ~_is_edge() & F.coalesce(~F.col("schema").isin(*NOT_ENTITIES, *(EDGES if strict_edges else ())), F.lit(True))
    p = F.col("properties")
    countries = F.when(F.size(p["country"]) > 0, p["country"]).otherwise(p["jurisdiction"])
    return records.where(wanted).select(
        "ord", "id", F.coalesce("schema", F.lit("Thing")).alias("schema"), F.coalesce(F.nullif("caption", F.lit("")), "id").alias("caption"),
        _up_to(countries).alias("countries"), _up_to(p["topics"]).alias("topics"), _up_to(F.col("datasets")).alias("datasets"),
        F.map_filter("properties", lambda k, _: k.isin(*SEARCHED)).alias("properties"), search_text().alias("search_text"),
    )


def upserted_entities(rows: DataFrame, ord_col: str = "ord") -> DataFrame:
    """One row for each id: caption and search text of the last row, the rest of the first."""
    first = [c for c in rows.columns if c not in ("id", ord_col, "caption", "search_text")]
    return rows.groupBy("id").agg(
        F.min_by(F.struct(*first), ord_col).alias("a"), F.max_by(F.struct("caption", "search_text"), ord_col).alias("z")
    ).select("id", *(F.col(f"a.{c}").alias(c) for c in first), "z.caption", "z.search_text").select(*[c for c in rows.columns if c != ord_col])


def upserted_relations(rows: DataFrame, ord_col: str = "ord") -> DataFrame:
    """One row for each id: the first."""
    rest = [c for c in rows.columns if c not in ("id", ord_col)]
    return rows.groupBy("id").agg(F.min_by(F.struct(*rest), ord_col).alias("a")).select("id", *(F.col(f"a.{c}").alias(c) for c in rest)).select(*[c for c in rows.columns if c != ord_col])


class Store:
    """The two tables, as parquet below a folder. Every save writes a new version, and then names it current."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _current(self) -> str | None:
        try:
            rows = self.spark.read.text(f"{self.path}/versions").agg(F.max(F.col("value").cast("long"))).first()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        return None if rows[0] is None else f"{self.path}/v{rows[0]}"

    def init_schema(self) -> None:
        if self._current() is None:
            self._save(self.spark.createDataFrame([], schemas.ENTITY), self.spark.createDataFrame([], schemas.RELATION))

    def _save(self, entities: DataFrame, relations: DataFrame) -> None:
        now = self._current()
        version = int(now.rpartition("v")[2]) + 1 if now else 1
        entities.select(schemas.ENTITY.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/v{version}/entities")
        relations.select(schemas.RELATION.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/v{version}/relations")
        self.spark.createDataFrame([(str(version),)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/versions")

    @property
    def entities(self) -> DataFrame:
        return self.spark.read.schema(schemas.ENTITY).parquet(f"{self._current()}/entities")

    @property
    def relations(self) -> DataFrame:
        return self.spark.read.schema(schemas.RELATION).parquet(f"{self._current()}/relations")

    def upsert(self, entities: DataFrame | None = None, relations: DataFrame | None = None) -> None:
        """Merges rows (with ``ord``) into the tables; what is stored counts as earlier than any of them."""
        self.init_schema()

        def merged(old: DataFrame, new: DataFrame | None, how) -> DataFrame:
            if new is None:
                return old
            later = new.withColumn("ord", F.struct(F.lit(1).alias("new"), F.col("ord").alias("given")))
            earlier = F.struct(F.lit(0).alias("new"), F.lit(None).cast(new.schema["ord"].dataType).alias("given"))
            return how(old.withColumn("ord", earlier).unionByName(later))

        self._save(merged(self.entities, entities, upserted_entities), merged(self.relations, relations, upserted_relations))

    def get(self, entity_id: str):
        return self.entities.where(F.col("id") == entity_id).first()

    def neighbours(self, entity_id: str) -> DataFrame:
        return adjacency(self.relations).where(F.col("node") == entity_id).select("neighbour", "schema", "direction")

    def counts(self) -> dict[str, int]:
        e, r = self.entities.select(F.lit("entities").alias("t")), self.relations.select(F.lit("relations").alias("t"))
        found = {x.t: x["count"] for x in e.unionAll(r).groupBy("t").count().collect()}
        return {"entities": found.get("entities", 0), "relations": found.get("relations", 0)}


def load(store: Store, *paths: str, limit: int | None = None) -> dict[str, int]:
    """Reads JSON lines into the store; counts what was read, not what was new."""
    records = limited(read_records(store.spark, *paths), limit).cache()
    entities, relations = entities_of(records), relations_of(records)
    store.upsert(entities, relations)
    out = {"records": records.count(), "entities": entities.count(), "relations": relations.count()}
    records.unpersist()
    return out


def adjacency(relations: DataFrame) -> DataFrame:
    """Both directions of every relation, with repeats: ``node, neighbour, schema, direction, edge``. Outgoing edges come first."""
    out = relations.select(F.col("source_id").alias("node"), F.col("target_id").alias("neighbour"), "schema", F.lit("out").alias("direction"), F.struct(F.lit(0).alias("way"), F.col("id").alias("id")).alias("edge"))
    back = relations.select(F.col("target_id").alias("node"), F.col("source_id").alias("neighbour"), "schema", F.lit("in").alias("direction"), F.struct(F.lit(1).alias("way"), F.col("id").alias("id")).alias("edge"))
    return out.unionAll(back)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database; the driver's jar has to be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.QUERY).json(path)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Cached decisions; the last line for a key counts."""
    lines = spark.read.schema(schemas.DECISION).json(path).withColumn("ord", F.struct(F.col("_metadata.file_modification_time").alias("time"), F.monotonically_increasing_id().alias("at")))
    rest = [c for c in schemas.DECISION.fieldNames() if c != "key"]
    return lines.groupBy("key").agg(F.max_by(F.struct(*rest), "ord").alias("z")).select("key", *(F.col(f"z.{c}").alias(c) for c in rest))


def append_json(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)
