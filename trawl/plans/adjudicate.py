"""A judge of identity over shortlists. Decisions come from a table; the model that fills it is the caller's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The properties that a candidate shows.
SHOWN = "birthDate birthPlace nationality incorporationDate jurisdiction registrationNumber idNumber taxNumber passportNumber imoNumber position".split()
ALIASES = ("alias", "weakAlias", "previousName")
MARGINS = (0.02, 0.05, 0.1, 0.2, float("inf"))


def _joined(values: Column, n: int, mark: str) -> Column:
    return F.array_join(F.slice(values, 1, n), mark)


def describe(number: Column) -> Column:
    """A candidate in one line: ``[n] caption | type= | countries= | ...``."""
    p, none = F.col("properties"), F.array().cast("array<string>")
    aliases = F.filter(F.concat(*(F.coalesce(p[k], none) for k in ALIASES)), lambda a: a != F.col("caption"))
    parts = [
        F.concat(F.lit("["), number.cast("string"), F.lit("] "), "caption"),
        F.concat(F.lit("type="), "schema"),
        F.when(F.size("countries") > 0, F.concat(F.lit("countries="), _joined(F.col("countries"), 4, ","))),
        F.when(F.size(aliases) > 0, F.concat(F.lit("aliases="), _joined(aliases, 6, "; "))),
        *(F.when(F.size(p[k]) > 0, F.concat(F.lit(f"{k}="), _joined(p[k], 3, "; "))) for k in SHOWN),
        F.concat(F.lit("lists="), _joined(F.col("datasets"), 3, ",")),
    ]
    return F.concat_ws(" | ", *parts)


def prompts(queries: DataFrame, run: DataFrame, entities: DataFrame) -> DataFrame:
    """``query_id, prompt, ids``: the numbered shortlist of each query."""
    rows = run.select("query_id", F.col("doc_id").alias("id"), "rank").join(entities, "id")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", describe(F.col("n")).alias("line"), "id"))).alias("x"))
    head = F.concat(F.lit("QUERY: "), "query", F.lit("\n\nCANDIDATES (in retrieval order):\n"))
    return queries.join(lists, "query_id").select("query_id", "query", F.concat(head, F.array_join("x.line", "\n")).alias("prompt"), F.col("x.id").alias("ids"))


def keyed(prompted: DataFrame, model: str, effort: str = "low") -> DataFrame:
    return prompted.withColumn("key", F.sha1(F.concat_ws("|", F.lit(model), F.lit(effort), "prompt")))


def judged(prompted: DataFrame, cache: DataFrame, judge: Callable[[str], dict] | None = None) -> DataFrame:
    """``query_id, key, match_id, confidence, reason, cached``: from the cache by key, else from ``judge`` (a prompt to
    ``{"match": number or 0, "confidence", "reason"}``), else undecided."""
    known = prompted.join(cache.select("key", "match_id", "confidence", "reason"), "key").select("query_id", "query", "key", "match_id", "confidence", "reason", F.lit(True).alias("cached"))
    open_ = prompted.join(cache.select("key"), "key", "left_anti")
    if judge is None:
        return known.unionByName(open_.select("query_id", "query", "key", F.lit(None).cast("string").alias("match_id"), F.lit("low").alias("confidence"), F.lit("no decision").alias("reason"), F.lit(False).alias("cached")))

    def ask(batches):
        for b in batches:
            out = [judge(p) or {} for p in b["prompt"]]
            picks = [int(o.get("match", 0)) for o in out]
            b["match_id"] = [ids[n - 1] if 1 <= n <= len(ids) else None for n, ids in zip(picks, b["ids"], strict=True)]
            b["confidence"], b["reason"], b["cached"] = [o.get("confidence", "low") for o in out], [o.get("reason", "") for o in out], False
            yield b[["query_id", "query", "key", "match_id", "confidence", "reason", "cached"]]

    kind = prompted.schema["query_id"].dataType.simpleString()
    return known.unionByName(open_.mapInPandas(ask, f"query_id {kind}, query string, key string, match_id string, confidence string, reason string, cached boolean"))


def apply(run: DataFrame, decisions: DataFrame) -> DataFrame:
    """The match moves to rank 1, the others keep their order; no match, or one that isn't in the list, changes nothing."""
    both = run.join(decisions.select("query_id", "match_id"), "query_id", "left")
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("doc_id") == F.col("match_id"), 0).otherwise(1), "rank")
    return both.withColumn("rank", F.row_number().over(order).cast("long")).select("query_id", "doc_id", "score", "rank")


def gaps(run: DataFrame) -> DataFrame:
    """``query_id, gap``: between the two best scores; infinite for a single hit."""
    score = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    return run.groupBy("query_id").agg(F.coalesce(score(1) - score(2), F.lit(float("inf"))).alias("gap"))


def sweep(run: DataFrame, decisions: DataFrame, qrels: DataFrame, queries: DataFrame, margins=MARGINS) -> DataFrame:
    """``margin, calls, recall_1, mrr_10``: shortlists with a gap under the margin are judged, the others stay."""
    steps = run.sparkSession.createDataFrame([(float(m),) for m in margins], "margin double")
    both = run.withColumnRenamed("rank", "before").join(apply(run, decisions).select("query_id", "doc_id", F.col("rank").alias("after")), ["query_id", "doc_id"]).join(gaps(run), "query_id")
    both = both.join(F.broadcast(steps), how="cross").withColumn("asked", (F.col("gap") < F.col("margin")) | F.isnan("margin") | (F.col("margin") == float("inf")))
    ranks = both.withColumn("rank", F.when(F.col("asked"), F.col("after")).otherwise(F.col("before")))
    hit = ranks.join(qrels.select("query_id", "doc_id"), ["query_id", "doc_id"]).groupBy("margin", "query_id").agg(F.min("rank").alias("best"))
    each = queries.select("query_id").join(F.broadcast(steps), how="cross").join(hit, ["margin", "query_id"], "left").join(ranks.groupBy("margin", "query_id").agg(F.max("asked").alias("asked")), ["margin", "query_id"], "left")
    return each.groupBy("margin").agg(
        F.count_if("asked").alias("calls"), F.round(F.avg(F.when(F.col("best") == 1, 1.0).otherwise(0.0)), 3).alias("recall_1"),
        F.round(F.avg(F.when(F.col("best") <= 10, 1.0 / F.col("best")).otherwise(0.0)), 3).alias("mrr_10"),
    )


def outcome(run: DataFrame, decisions: DataFrame, qrels: DataFrame, queries: DataFrame) -> DataFrame:
    """A row for each query: ``family, before, after, match_id, confidence, right``; before and after: the first hit is relevant."""
    rel = qrels.select("query_id", F.col("doc_id").alias("rel_id"))

    def first(r: DataFrame, name: str) -> DataFrame:
        return r.where("rank = 1").select("query_id", F.col("doc_id").alias("rel_id")).join(rel, ["query_id", "rel_id"], "left_semi").select("query_id", F.lit(True).alias(name))

    right = decisions.select("query_id", F.col("match_id").alias("rel_id")).join(rel, ["query_id", "rel_id"], "left_semi").select("query_id", F.lit(True).alias("right"))
    out = queries.select("query_id", "family").join(first(run, "before"), "query_id", "left").join(first(apply(run, decisions), "after"), "query_id", "left")
    out = out.join(right, "query_id", "left").join(decisions.select("query_id", "match_id", "confidence"), "query_id", "left")
    return out.fillna(False, ["before", "after", "right"])


def summary(outcomes: DataFrame) -> DataFrame:
    """``family`` (null: all): counts of queries, fixed, broken, abstained and wrongly picked, and the shares before and after."""
    return outcomes.rollup("family").agg(
        F.count("*").alias("queries"), F.count_if(F.col("after") & ~F.col("before")).alias("fixed"), F.count_if(F.col("before") & ~F.col("after")).alias("broke"),
        F.count_if(F.col("match_id").isNull()).alias("abstained"), F.count_if(F.col("match_id").isNotNull() & ~F.col("right")).alias("picked_wrong"),
        F.round(F.avg(F.col("before").cast("int")), 2).alias("share_before"), F.round(F.avg(F.col("after").cast("int")), 2).alias("share_after"),
    )


def by_confidence(outcomes: DataFrame) -> DataFrame:
    """``confidence, right, picked``."""
    return outcomes.where("match_id IS NOT NULL").groupBy("confidence").agg(F.count_if("right").alias("right"), F.count("*").alias("picked"))


def coverage(run: DataFrame, qrels: DataFrame) -> int:
    """Queries whose shortlist holds a relevant document."""
    return run.join(qrels.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").select("query_id").distinct().count()
