"""Labelled queries, retrieval metrics, and the gate against regressions."""

from __future__ import annotations

import json
import time
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.functions.text import first_of, fold, noisy
from trawl.operators.fusion import Hybrid
from trawl.operators.rerank import get_reranker

CUTS = (1, 5, 10, 20)
METRICS = [*(f"recall@{k}" for k in CUTS), "mrr@10", "ndcg@10"]
TOLERANCE = 0.02


def build_queries(entities: DataFrame, per_family: int = 75, seed: int = 0, exclude: DataFrame | None = None) -> DataFrame:
    """Queries with one relevant entity each, in four families: an alias, a last word with a country, a name with a
    detail, a misspelled name. Entities come in the order of a seeded hash, the same for every family; a query under
    four characters takes up a place and is left out. ``exclude`` has ids (``id``) that must not be used."""
    some = entities.where(F.col("schema").isin("Person", "Organization", "Company"))
    some = some if exclude is None else some.join(exclude.select("id"), "id", "left_anti")
    p, name = F.col("properties"), F.col("caption")
    aliases = F.filter(F.coalesce(p["alias"], F.array().cast("array<string>")), lambda a: fold(a) != fold(name))
    words = F.filter(F.split(name, r"(?U)\s+"), lambda w: w != "")
    detail = F.coalesce(*(first_of(p, k) for k in ("birthDate", "registrationNumber", "idNumber", "incorporationDate")))
    pick = F.pmod(F.xxhash64("id", F.lit(seed), F.lit("alias")), F.greatest(F.size(aliases), F.lit(1))).cast("int")
    families = {
        "alias": (F.size(aliases) > 0, F.get(aliases, pick)),
        "partial": ((F.size(words) >= 2) & (F.size("countries") > 0), F.concat(F.element_at(words, -1), F.lit(" "), F.get(F.col("countries"), F.lit(0)))),
        "attribute": (detail.isNotNull(), F.concat(name, F.lit(" "), detail)),
        "noisy": (F.length(name) >= 8, noisy(name, F.col("id"), seed)),
    }
    each = []
    for n, (family, (usable, query)) in enumerate(families.items()):
        order = F.xxhash64("id", F.lit(seed))
        rows = some.where(F.coalesce(usable, F.lit(False))).orderBy(order, "id").limit(per_family)
        each.append(rows.select(F.lit(n).alias("n"), F.lit(family).alias("family"), F.trim(query).alias("query"), "id", name.alias("entity_caption"), order.alias("o")))
    rows = reduce(DataFrame.unionAll, each).where(F.length("query") >= 4)
    number = F.row_number().over(Window.orderBy("n", "o", "id")) - 1  # as many rows as queries
    return rows.select(F.format_string("%s-%04d", "family", number.cast("int")).alias("id"), "family", "query", F.array("id").alias("relevant"), "entity_caption")


def qrels(queries: DataFrame) -> DataFrame:
    """``query_id, doc_id`` from labelled queries."""
    return queries.select(F.col("id").alias("query_id"), F.explode("relevant").alias("doc_id")).distinct()


def per_query(runs: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """``system, query_id, family`` and the metrics; a query that a system finds nothing for counts as zero."""
    hits = runs.join(relevant.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    gain = 1.0 / F.log2(F.col("rank") + 1.0)
    found = hits.groupBy("system", "query_id").agg(F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= 10, gain)).alias("gain"))
    every = runs.select("system").distinct().join(queries.select("query_id", "family"), how="cross").join(found, ["system", "query_id"], "left")
    recall = [F.when(F.col("first") <= k, 1.0).otherwise(0.0).alias(f"recall@{k}") for k in CUTS]
    return every.select("system", "query_id", "family", *recall, F.when(F.col("first") <= 10, 1.0 / F.col("first")).otherwise(0.0).alias("mrr@10"), F.coalesce("gain", F.lit(0.0)).alias("ndcg@10"))


def means(scored: DataFrame) -> DataFrame:
    """The metrics by system (``family`` null) and by system and family, to three digits."""
    out = scored.groupingSets([["system"], ["system", "family"]], "system", "family").agg(F.count("*").alias("queries"), *(F.round(F.avg(F.col(f"`{m}`")), 3).alias(m) for m in METRICS))
    return out.select("system", "family", "queries", *(F.col(f"`{m}`") for m in METRICS))


def systems(pipeline, pool: int = 100, k: int = 20) -> dict:
    """The six systems that are compared, each a function from queries to a run."""
    bm25, vectors, names, entities = pipeline.bm25, pipeline.vectors, pipeline.names, pipeline.entities
    plain, with_names = Hybrid(bm25, vectors), Hybrid(bm25, vectors, names)
    by_hand, learned = get_reranker(), get_reranker(names, learned=True)
    return {
        "bm25": lambda q: bm25.search(q, k),
        "vector": lambda q: vectors.search(q, k),
        "hybrid-rrf": lambda q: plain.search(q, k, pool),
        "hybrid+rerank": lambda q: by_hand.rerank(q, plain.search(q, pool, pool), entities, k),
        "names": lambda q: names.search(q, k),
        "hybrid+names+rerank": lambda q: learned.rerank(q, with_names.search(q, pool, pool), entities, k),
    }


def run(pipeline, labelled: DataFrame, pool: int = 100, path: str | None = None) -> dict:
    """All systems over all queries, a batch for each; times are those of the batch for each query."""
    queries = labelled.select(F.col("id").alias("query_id"), "query", "family").cache()
    relevant, n, parts, latency = qrels(labelled), queries.count(), [], {}
    for name, search in systems(pipeline, pool).items():
        began = time.perf_counter()
        rows = search(queries).withColumn("system", F.lit(name)).cache()
        rows.count()
        latency[name] = round(1000 * (time.perf_counter() - began) / max(1, n), 1)
        parts.append(rows)
    table = means(per_query(reduce(DataFrame.unionByName, parts), relevant, queries)).collect()
    out = {"corpus": pipeline.entities.count(), "queries": n, "encoder": getattr(pipeline.vectors.encoder, "name", None), "overall": {}, "by_family": {}, "latency_ms": latency}
    for r in table:
        values = {m: r[m] for m in METRICS}
        if r.family is None:
            out["overall"][r.system] = values
        else:
            out["by_family"].setdefault(r.family, {})[r.system] = values
    out["overall"] = {s: out["overall"][s] for s in latency if s in out["overall"]}
    for rows in (*parts, queries):
        rows.unpersist()
    if path:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(out, f, indent=2)
    return out


def long(spark: SparkSession, results: dict) -> DataFrame:
    """``system, metric, value`` of what ``run`` returns, or of a baseline of that form."""
    rows = [(system, metric, float(value)) for system, of in results.get("overall", {}).items() for metric, value in of.items()]
    return spark.createDataFrame(rows, "system string, metric string, value double")


def markdown(rows: DataFrame, **formats: str) -> str:
    """Small tables in the order of their rows, a column for each format."""
    shown = rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.format_string(f, F.col(f"`{c}`")) for c, f in formats.items())), F.lit(" |")).alias("line"))
    return "\n".join(["| " + " | ".join(formats) + " |", "|" + "---|" * len(formats), *(r.line for r in shown.collect())])


def as_table(spark: SparkSession, results: dict) -> str:
    """The systems with their metrics and latency, in the order in which they ran."""
    shown = [m for m in METRICS if m != "recall@20"]
    rows = [(s, *(float(of[m]) for m in shown), float(results["latency_ms"][s])) for s, of in results["overall"].items()]
    table = spark.createDataFrame(rows, "system string, " + ", ".join(f"`{m}` double" for m in shown) + ", `latency/query` double").coalesce(1)
    return markdown(table, system="%s", **dict.fromkeys(shown, "%.3f"), **{"latency/query": "%.0f ms"})


def gate(results: DataFrame, baseline: DataFrame, tolerance: float = TOLERANCE, primary: str = "hybrid+rerank") -> DataFrame:
    """``failure`` for each thing that got worse, from ``system, metric, value`` of both."""
    got = results.select("system", "metric", F.col("value").alias("actual"))
    here = results.select("system").distinct().withColumn("here", F.lit(True))
    both = baseline.join(here, "system", "left").join(got, ["system", "metric"], "left")
    text: Column = (
        F.when(F.col("here").isNull(), F.concat("system", F.lit(": missing from results")))
        .when(F.col("actual").isNull(), F.concat("system", F.lit("."), "metric", F.lit(": missing")))
        .when(F.col("actual") < F.col("value") - tolerance, F.format_string(f"%s.%s: %.3f < %.3f - {tolerance}", "system", "metric", "actual", "value"))
    )
    worse = both.select(text.alias("failure")).where("failure IS NOT NULL").distinct()
    recall = results.where(F.col("metric") == "recall@10").agg(F.max("value").alias("best"), F.coalesce(F.max(F.when(F.col("system") == primary, F.col("value"))), F.lit(0.0)).alias("own"))
    return worse.unionByName(recall.where("own < best").select(F.lit(f"{primary} is no longer the best system by recall@10").alias("failure")))
