"""Reranking by five features that can be explained."""

from __future__ import annotations

import json
import os
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions.text import coverage, jaccard, ngrams, tokenize
from trawl.operators.runs import ranked

FEATURES = ("coverage", "jaccard", "name_similarity", "topic", "retriever_prior")
# Weights set by hand, weights that were learned, and the topics that count.
DEFAULT_WEIGHTS = (0.40, 0.15, 0.25, 0.05, 0.15)
LEARNED_WEIGHTS = (0.4091, 0.0275, 0.4211, 0.0009, 0.1413)
TOPICS = ("sanction", "crime", "role.pep")


class FeatureReranker:
    def __init__(self, names=None, weights=None):
        self.names, self.weights = names, tuple(weights or DEFAULT_WEIGHTS)

    def features(self, queries: DataFrame, run: DataFrame, entities: DataFrame) -> DataFrame:
        """``query_id, doc_id, prior_rank`` (from 0) and the features of every hit that has an entity."""
        hits = run.select("query_id", "doc_id", (F.col("rank") - 1).alias("prior_rank"))
        rows = entities.select(F.col("id").alias("doc_id"), "caption", "topics", "search_text").join(hits, "doc_id").join(queries.select("query_id", "query"), "query_id")
        q, d = tokenize(F.col("query")), tokenize(F.col("search_text"))
        topic = F.coalesce(F.arrays_overlap("topics", F.array(*map(F.lit, TOPICS))), F.lit(False)).cast("double")
        prior = 1.0 / (1 + F.col("prior_rank"))
        names = jaccard(ngrams(F.col("query")), ngrams(F.col("caption")))
        if self.names is not None:
            rows, names = rows.join(self.names.score_entities(run, queries), ["query_id", "doc_id"], "left"), F.coalesce("name_score", F.lit(0.0)) / 100
        return rows.select("query_id", "doc_id", "prior_rank", coverage(q, d).alias("coverage"), jaccard(q, d).alias("jaccard"), names.alias("name_similarity"), topic.alias("topic"), prior.alias("retriever_prior"))

    def rerank(self, queries: DataFrame, run: DataFrame, entities: DataFrame, k: int = 10) -> DataFrame:
        """Hits without an entity are dropped but keep their rank's slot; ties keep the order of the run."""
        score = reduce(lambda a, b: a + b, (F.lit(float(w)) * F.col(f) for w, f in zip(self.weights, FEATURES, strict=True)))
        return ranked(self.features(queries, run, entities).withColumn("score", score), k, "prior_rank")


class PairReranker:
    """A model that scores pairs: ``load`` gives, once in each worker, a function from lists of queries and texts to scores."""

    def __init__(self, load, chars: int = 512):
        self.load, self.chars = load, chars

    def rerank(self, queries: DataFrame, run: DataFrame, entities: DataFrame, k: int = 10) -> DataFrame:
        load = self.load

        def score(batches):
            model = load()
            for b in batches:
                yield pd.DataFrame({"query_id": b["query_id"], "doc_id": b["doc_id"], "rank": b["rank"], "score": [float(x) for x in model(list(b["query"]), list(b["text"]))]})

        rows = run.select("query_id", "doc_id", "rank").join(queries.select("query_id", "query"), "query_id").join(entities.select(F.col("id").alias("doc_id"), F.substring("search_text", 1, self.chars).alias("text")), "doc_id")
        kinds = {c: rows.schema[c].dataType.simpleString() for c in ("query_id", "doc_id")}
        return ranked(rows.mapInPandas(score, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, rank long, score double"), k, "rank")


def load_weights(path: str | None) -> tuple[float, ...] | None:
    """Weights from a file of the trainer, in the order of ``FEATURES``; None if there is no file."""
    if not path or not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        found = json.load(f)["weights"]
    return tuple(found[x] for x in FEATURES)


def get_reranker(names=None, learned: bool = False, weights_path: str | None = None, pair_model=None):
    if pair_model is not None:
        return PairReranker(pair_model)
    return FeatureReranker(names, (load_weights(weights_path) or LEARNED_WEIGHTS) if learned else None)
