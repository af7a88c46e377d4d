"""Name matching: every query against every listed name, with three measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions.similarity import name_scores
from trawl.functions.text import normalise
from trawl.operators.runs import ranked

NAME_PROPERTIES = ("name", "alias", "weakAlias", "previousName")
MEASURES = ("jaro_winkler", "token_sort", "token_set")


def names_of(entities: DataFrame) -> DataFrame:
    """``entity_id, raw, norm, place``: the caption and all listed names, each raw string once for an entity."""
    p, none = F.col("properties"), F.array().cast("array<string>")
    every = F.concat(F.array("caption"), *(F.coalesce(p[k], none) for k in NAME_PROPERTIES))
    listed = F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (x != "")))
    return entities.select(F.col("id").alias("entity_id"), F.posexplode(listed).alias("place", "raw")).select("entity_id", "raw", normalise(F.col("raw")).alias("norm"), "place")


class NameMatcher:
    """Scores are made for distinct pairs of normalised names: repeated names cost once."""

    def __init__(self):
        self.names: DataFrame | None = None

    def index(self, entities: DataFrame) -> NameMatcher:
        self.names = names_of(entities)
        return self

    def given(self, names: DataFrame) -> NameMatcher:
        """From ``entity_id, raw``."""
        self.names = names.select("entity_id", "raw", normalise(F.col("raw")).alias("norm"), F.lit(0).alias("place"))
        return self

    def _pairs(self, queries: DataFrame) -> DataFrame:
        """``query_id, norm, s`` for the stated queries against all distinct names."""
        asked = queries.select("query_id", normalise(F.col("query")).alias("q")).where("q <> ''")
        distinct = asked.select("q").distinct().join(self.names.select("norm").distinct(), how="cross")
        scored = distinct.select("q", "norm", name_scores("q", "norm").alias("s"))
        return scored.join(asked, "q")

    def matches(self, queries: DataFrame, k: int = 10, min_score: float = 0.0) -> DataFrame:
        """A run with ``matched_name`` and the measures: the best name of each entity, scores to one decimal.

        The cut at ``min_score`` and the order use unrounded scores.
        """
        each = self._pairs(queries).where(F.col("s.total") >= min_score).join(self.names, "norm")
        best = each.groupBy("query_id", "entity_id").agg(F.max_by(F.struct("raw", "s"), F.struct(F.round("s.total", 9), -F.col("place"), "raw")).alias("m"))
        flat = best.select("query_id", F.col("entity_id").alias("doc_id"), F.col("m.s.total").alias("score"), F.col("m.raw").alias("matched_name"), *(F.round(F.col(f"m.s.{x}"), 1).alias(x) for x in MEASURES))
        top = ranked(flat, k)
        return flat.drop("score").join(top, ["query_id", "doc_id"]).select("query_id", "doc_id", F.round("score", 1).alias("score"), "rank", "matched_name", *MEASURES)

    def search(self, queries: DataFrame, k: int = 50) -> DataFrame:
        return self.matches(queries, k).select("query_id", "doc_id", "score", "rank")

    def score_entities(self, pool: DataFrame, queries: DataFrame) -> DataFrame:
        """``query_id, doc_id, name_score`` for the hits of a run: the best name's score, unrounded; 0 without any."""
        asked = queries.select("query_id", normalise(F.col("query")).alias("q"))
        own = pool.select("query_id", "doc_id").join(asked, "query_id").join(self.names.select(F.col("entity_id").alias("doc_id"), "norm"), "doc_id", "left")
        pairs = own.where("q <> '' AND norm IS NOT NULL").select("q", "norm").distinct()
        scored = pairs.select("q", "norm", name_scores("q", "norm").alias("s")).select("q", "norm", F.col("s.total").alias("t"))
        return own.join(scored, ["q", "norm"], "left").groupBy("query_id", "doc_id").agg(F.coalesce(F.max("t"), F.lit(0.0)).alias("name_score"))


