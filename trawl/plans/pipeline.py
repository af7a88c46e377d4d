"""The search stack: three indexes, fusion, reranking, expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.operators import graph
from trawl.operators.dense import VectorIndex, get_encoder
from trawl.operators.fusion import Hybrid
from trawl.operators.lexical import BM25
from trawl.operators.names import NameMatcher
from trawl.operators.rerank import get_reranker
from trawl.sources.records import Store


#: Searches whose fused pools stay persisted.
HELD = 8


class Pipeline:
    """``search`` is one lazy plan over a batch of ``query_id, query``; a single question is a batch of one."""

    def __init__(self, entities: DataFrame, relations: DataFrame, encoder=None, vectors: bool = True, names: bool = True, learned: bool = True, weights_path: str | None = None, pair_model=None):
        self.entities, self.relations, self.spark = entities, relations, entities.sparkSession
        docs = entities.select(F.col("id").alias("doc_id"), F.col("search_text").alias("text"))
        self.bm25 = BM25().index(docs)
        self.vectors = VectorIndex(encoder or get_encoder()).index(docs) if vectors else None
        self.names = NameMatcher().index(entities) if names else None
        self.hybrid = Hybrid(self.bm25, self.vectors, self.names)
        self.reranker = get_reranker(self.names, learned, weights_path, pair_model)
        self.held: list[DataFrame] = []

    @classmethod
    def build(cls, spark: SparkSession, path: str, **options) -> Pipeline:
        store = Store(spark, path)
        return cls(store.entities, store.relations, **options)

    def queries(self, *texts: str) -> DataFrame:
        return self.spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "query_id string, query string")

    def search(self, queries: DataFrame | str, k: int = 10, pool: int = 100, expand: bool = False, hops: int = 1) -> DataFrame:
        queries = self.queries(queries) if isinstance(queries, str) else queries
        # The fused pool is read by several features; it has ``pool`` rows for each query at most. A run whose pool has been let go makes it again.
        fused = self.hybrid.search(queries, k=pool, pool=pool).persist()
        self.held.append(fused)
        self.release(HELD)
        run = self.reranker.rerank(queries, fused, self.entities, k)
        return graph.expand(run, self.relations, self.entities, hops) if expand else run

    def release(self, keep: int = 0) -> None:
        """Lets go of all persisted pools but the ``keep`` latest."""
        while len(self.held) > keep:
            self.held.pop(0).unpersist()

    def hits(self, run: DataFrame) -> DataFrame:
        """A run with the fields that a caller sees; unknown ids are dropped, scores rounded."""
        fields = self.entities.select(F.col("id").alias("doc_id"), "caption", "schema", "countries", "topics", "datasets")
        return run.join(fields, "doc_id").select("query_id", F.col("doc_id").alias("id"), "caption", "schema", "countries", "topics", "datasets", F.round("score", 4).alias("score"), "rank").orderBy("query_id", "rank")

    def get(self, entity_id: str):
        return self.entities.where(F.col("id") == entity_id).first()

    def path(self, src: str, dst: str, max_hops: int = 3) -> list[str] | None:
        found = graph.shortest_paths(self.spark.createDataFrame([(src, dst)], "src string, dst string"), self.relations, max_hops).first()
        return found and list(found.path)
