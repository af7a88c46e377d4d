"""Listwise fitting of the reranker's weights."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.operators.rerank import FEATURES, FeatureReranker
from trawl.plans.evaluate import build_queries, qrels

RIDGE = 1e-3


def listwise_loss(features: DataFrame, weights, ridge: float = RIDGE) -> DataFrame:
    """One row: the mean of -log softmax of the relevant candidate over groups, with the ridge; ``query_id, relevant`` and the features."""
    z = sum((F.lit(float(w)) * F.col(f) for w, f in zip(weights, FEATURES, strict=True)), F.lit(0.0))
    group = Window.partitionBy("query_id")
    p = F.exp(F.col("z") - F.max("z").over(group))
    share = features.withColumn("z", z).withColumn("p", p).withColumn("p", F.col("p") / F.sum("p").over(group))
    return share.where("relevant").agg((F.avg(-F.log(F.col("p") + 1e-12)) + F.lit(ridge * sum(w * w for w in weights))).alias("loss"))


def fit(groups: list[tuple[np.ndarray, int]], ridge: float = RIDGE, steps: int = 500) -> np.ndarray:
    """Weights for groups of candidates (a matrix, and the row that is relevant). The loss is convex: Newton steps with halving."""
    n_features = groups[0][0].shape[1] if groups else len(FEATURES)
    w = np.ones(n_features)

    def parts(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        total, grad, curve = ridge * w @ w, 2 * ridge * w, 2 * ridge * np.eye(len(w))
        for x, y in groups:
            z = x @ w
            e = np.exp(z - z.max())
            p = e / e.sum()
            mean = p @ x
            total -= np.log(p[y] + 1e-12) / len(groups)
            grad = grad - (x[y] - mean) / len(groups)
            curve = curve + ((x * p[:, None]).T @ x - np.outer(mean, mean)) / len(groups)
        return total, grad, curve

    loss, grad, curve = parts(w)
    for _ in range(steps):
        step, size = np.linalg.solve(curve, grad), 1.0
        while size > 1e-6:
            new = parts(w - size * step)
            if new[0] < loss:
                break
            size /= 2
        if size <= 1e-6 or np.abs(grad).max() < 1e-8:
            break
        w, (loss, grad, curve) = w - size * step, new
    return w


def train(pipeline, test_queries: DataFrame, per_family: int = 150, pool: int = 100, seed: int = 7, path: str | None = None) -> dict:
    """Fits on queries about entities that the test doesn't use. At most four families of ``per_family`` groups of ``pool`` candidates reach the driver."""
    held_out = qrels(test_queries).select(F.col("doc_id").alias("id"))
    labelled = build_queries(pipeline.entities, per_family, seed, held_out).cache()
    queries = labelled.select(F.col("id").alias("query_id"), "query")
    run = pipeline.hybrid.search(queries, k=pool, pool=pool)
    rows = FeatureReranker(pipeline.names).features(queries, run, pipeline.entities).join(qrels(labelled).withColumn("relevant", F.lit(True)), ["query_id", "doc_id"], "left")
    groups: dict[str, list] = {}
    for r in rows.collect():
        groups.setdefault(r.query_id, []).append((r.prior_rank, bool(r.relevant), [r[f] for f in FEATURES]))
    usable = []
    for g in groups.values():
        g.sort(key=lambda x: x[0])
        hit = next((i for i, x in enumerate(g) if x[1]), None)
        if hit is not None:
            usable.append((np.array([x[2] for x in g]), hit))
    w = fit(usable)
    w = w / np.abs(w).sum()
    n = labelled.count()
    out = {"features": list(FEATURES), "weights": dict(zip(FEATURES, map(float, np.round(w, 4)), strict=True)), "train_queries": n, "used": len(usable), "not_in_pool": n - len(usable), "held_out_entities": held_out.count()}
    labelled.unpersist()
    if path:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(out, f, indent=2)
    return out
