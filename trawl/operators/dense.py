"""Dense search: exact cosine over unit vectors, and the encoders that make them.

The default encoder is latent semantic analysis: TF-IDF over words and character
trigrams, reduced by a truncated singular value decomposition. Every feature of
``min_df`` texts or more counts, unless the caller sets ``max_features`` (the most
frequent then). What is broadcast has a row for each feature: beyond ``MOST``
features nothing is dropped in silence, and ``fit`` asks for a bound instead. The
decomposition is a randomised one (Halko, Martinsson, Tropp 2011): each pass is a
sum over documents of small dense blocks, added up in a tree; only matrices of
features by components reach the driver.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions.text import ngrams, tokenize
from trawl.operators.runs import ranked, spread

#: Queries that a task holds as one matrix; features that are broadcast without a bound of the caller's.
QUERY_BLOCK, MOST = 4096, 500_000


class Encoder(Protocol):
    """What a search needs: ``fit`` on texts, and ``encode`` to ``id, vector``; ``encode_query`` where queries differ."""

    name: str
    dim: int

    def fit(self, texts: DataFrame) -> Encoder: ...
    def encode(self, texts: DataFrame) -> DataFrame: ...


class LSAEncoder:
    """Vectors of ``id, text``."""

    name = "tfidf-svd"

    def __init__(self, dim: int = 256, min_df: int = 2, max_features: int | None = None, passes: int = 3, oversample: int = 16, seed: int = 0):
        self.dim, self.min_df, self.max_features, self.passes, self.oversample, self.seed = dim, min_df, max_features, passes, oversample, seed
        self.vocab: dict[str, int] = {}
        self.idf = self.components = None

    @staticmethod
    def features(texts: DataFrame) -> DataFrame:
        """``id, features``: words and trigrams in one name space, with repeats."""
        return spread(texts.select("id", "text")).select("id", F.concat(tokenize(F.col("text")), ngrams(F.col("text"), 3)).alias("features"))

    def fit(self, texts: DataFrame) -> LSAEncoder:
        found = self.features(texts)
        df = found.select(F.explode(F.array_distinct("features")).alias("f")).groupBy("f").agg(F.count("*").alias("df")).where(F.col("df") >= self.min_df)
        if self.max_features is None and df.limit(MOST + 1).count() > MOST:
            raise ValueError(f"over {MOST} features; set max_features or a larger min_df")
        few = df if self.max_features is None else df.orderBy(F.desc("df"), "f").limit(self.max_features)
        top = sorted((r.f, r.df) for r in few.collect())
        n = texts.count()
        self.vocab = {f: k for k, (f, _) in enumerate(top)}
        self.idf = np.log((1 + n) / (1 + np.array([d for _, d in top], float))) + 1 if top else np.zeros(0)
        k = min(self.dim, min(n, len(top)) - 1)
        if k < 1:
            self.components = np.zeros((len(top), 0))
            return self
        basis = np.random.default_rng(self.seed).normal(size=(len(top), min(len(top), k + self.oversample)))
        for _ in range(self.passes):
            basis, _ = np.linalg.qr(self._gram(found, basis))
        small = basis.T @ self._gram(found, basis)
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        self.components = (basis @ vectors[:, np.argsort(-values)])[:, :k]
        return self

    def _gram(self, found: DataFrame, right: np.ndarray) -> np.ndarray:
        """Aᵀ(A·right), where a row of A is a document: each task gives one block, and blocks are added in a tree."""
        shared = found.sparkSession.sparkContext.broadcast((self.vocab, self.idf, right))

        def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            vocab, idf, m = shared.value
            out = np.zeros_like(m)
            for batch in batches:
                for features in batch["features"]:
                    cols, weights = _row(features, vocab, idf)
                    if len(cols):
                        out[cols] += np.outer(weights, weights @ m[cols])
            yield pd.DataFrame({"part": [out.astype(np.float64).tobytes()]})

        blocks = found.select("features").mapInPandas(block, "part binary").rdd.map(lambda r: np.frombuffer(r[0]).reshape(right.shape))
        return blocks.treeReduce(lambda a, b: a + b) if right.size else right

    def encode(self, texts: DataFrame) -> DataFrame:
        """``id, vector`` of unit length; zero where nothing is known."""
        shared = texts.sparkSession.sparkContext.broadcast((self.vocab, self.idf, self.components))

        def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            vocab, idf, v = shared.value
            for batch in batches:
                out = []
                for features in batch["features"]:
                    cols, weights = _row(features, vocab, idf)
                    x = weights @ v[cols] if len(cols) else np.zeros(v.shape[1])
                    out.append((x / max(np.linalg.norm(x), 1e-9)).astype(np.float32))
                yield pd.DataFrame({"id": batch["id"], "vector": out})

        found = self.features(texts)
        return found.mapInPandas(project, f"id {found.schema['id'].dataType.simpleString()}, vector array<float>")


def _row(features, vocab: dict[str, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known = [vocab[f] for f in features if f in vocab]
    cols, counts = np.unique(np.array(known, np.int64), return_counts=True)
    weights = counts * idf[cols] if len(cols) else np.zeros(0)
    return cols, weights / max(np.linalg.norm(weights), 1e-9)


class ModelEncoder:
    """A neural encoder: ``load`` gives, once in each worker, a function from texts to an array of vectors."""

    def __init__(self, name: str, dim: int, load, load_query=None):
        self.name, self.dim, self.load, self.load_query = name, dim, load, load_query

    def fit(self, texts: DataFrame) -> ModelEncoder:
        return self

    def encode(self, texts: DataFrame, load=None) -> DataFrame:
        load = load or self.load

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for batch in batches:
                x = np.asarray(model(list(batch["text"].fillna(""))), np.float32)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
                yield pd.DataFrame({"id": batch["id"], "vector": list(x)})

        some = texts.select("id", "text")
        return some.mapInPandas(run, f"id {some.schema['id'].dataType.simpleString()}, vector array<float>")

    def encode_query(self, texts: DataFrame) -> DataFrame:
        return self.encode(texts, self.load_query)


#: Other encoders, by the name that the setting ``TRAWL_ENCODER`` gives; each is made without arguments.
ENCODERS = {"lsa": LSAEncoder}


def get_encoder(name: str | None = None):
    return ENCODERS[name or os.environ.get("TRAWL_ENCODER", "lsa")]()


class VectorIndex:
    """Cosine search over unit vectors ``doc_id, vector``."""

    def __init__(self, encoder=None):
        self.encoder, self.vectors = encoder, None

    def index(self, docs: DataFrame, cache: str | None = None) -> VectorIndex:
        """Fits the encoder on ``doc_id, text``. With ``cache``, vectors are kept below it under a key of encoder and texts."""
        texts = docs.select(F.col("doc_id").alias("id"), "text")
        self.encoder.fit(texts)
        vectors = self.encoder.encode(texts).select(F.col("id").alias("doc_id"), "vector")
        self.vectors = vectors if cache is None else _cached(texts, self.encoder, vectors, cache)
        return self

    def given(self, vectors: DataFrame) -> VectorIndex:
        self.vectors = vectors
        return self

    def encoded(self, queries: DataFrame) -> DataFrame:
        texts = queries.select(F.col("query_id").alias("id"), F.col("query").alias("text"))
        return getattr(self.encoder, "encode_query", self.encoder.encode)(texts).select(F.col("id").alias("query_id"), "vector")

    def search(self, queries: DataFrame, k: int = 50, drop_zero: bool = False) -> DataFrame:
        """The ``k`` nearest of each query (all documents if fewer); ``drop_zero`` leaves out queries of which nothing is known."""
        return nearest(self.encoded(queries), self.vectors, k, drop_zero)


def _cached(texts: DataFrame, encoder, vectors: DataFrame, folder: str) -> DataFrame:
    spark = texts.sparkSession
    whole = texts.agg(F.sum(F.xxhash64("id", "text").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).select(F.sha1(F.concat_ws("|", F.lit(f"{encoder.name}/{encoder.dim}"), "s", "n"))).first()[0][:16]
    path = f"{folder}/{encoder.name}-{whole}"
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    vectors.write.parquet(path)
    return spark.read.parquet(path)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, drop_zero: bool = False) -> DataFrame:
    """A run of ``query_id, vector`` over ``doc_id, vector``.

    The queries, a stated set, go to the tasks in blocks of ``QUERY_BLOCK``; a task
    multiplies matrices in double precision and hands on its own ``k`` best of
    each query, so what is shuffled is ``k`` rows for each query and task.
    """
    ids = queries.schema["query_id"].dataType.simpleString(), vectors.schema["doc_id"].dataType.simpleString()
    runs = None
    rows = queries.select("query_id", "vector").toLocalIterator()
    while block := [r for _, r in zip(range(QUERY_BLOCK), rows, strict=False)]:
        names, q = [r.query_id for r in block], np.array([r.vector for r in block], np.float64)
        if drop_zero:
            some = np.linalg.norm(q, axis=1) > 0
            names, q = [n for n, s in zip(names, some, strict=True) if s], q[some]
        best = _best(vectors, names, q, k, ids)
        runs = best if runs is None else runs.unionByName(best)
    if runs is None:
        return queries.sparkSession.createDataFrame([], f"query_id {ids[0]}, doc_id {ids[1]}, score double, rank long")
    return ranked(runs, k)


def _best(vectors: DataFrame, names: list, q: np.ndarray, k: int, ids: tuple[str, str]) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast((names, q))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q = shared.value
        held_ids, held = None, None
        for batch in batches:
            if not len(batch) or not len(names):
                continue
            scores = np.stack(batch["vector"].to_numpy()).astype(np.float64) @ q.T
            own = batch["doc_id"].to_numpy()
            held_ids = own if held is None else np.concatenate([held_ids, own])
            held = scores if held is None else np.vstack([held, scores])
            if len(held) > 8 * k + 8192:
                keep = np.unique(_top(held_ids, held, k)[0])
                held_ids, held = held_ids[keep], held[keep]
        if held is not None:
            rows, cols = _top(held_ids, held, k)
            yield pd.DataFrame({"query_id": np.array(names, object)[cols], "doc_id": held_ids[rows], "score": held[rows, cols]})

    return vectors.select("doc_id", "vector").mapInPandas(search, f"query_id {ids[0]}, doc_id {ids[1]}, score double")


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` best of each column; ties at nine digits go to the smaller id."""
    order = np.argsort(ids, kind="stable")
    best = np.argsort(-np.round(scores[order], 9), axis=0, kind="stable")[:k]
    return order[best].ravel(), np.tile(np.arange(scores.shape[1]), len(best))


