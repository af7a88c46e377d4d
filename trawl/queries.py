"""Registered queries over the standard tables, one for each operator or group of them, and the same in SQL.

The tables stand in for a corpus of entities: documents and benchmark passages
for texts and queries, the order tables for a graph of relations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions import text as tx
from trawl.functions.similarity import jaro_winkler_of
from trawl.operators import graph
from trawl.operators.dense import nearest
from trawl.operators.fusion import rrf
from trawl.operators.lexical import BM25
from trawl.operators.rerank import DEFAULT_WEIGHTS, FeatureReranker
from trawl.operators.runs import ranked
from trawl.plans import adjudicate, agent, answer, evaluate, export, observability
from trawl.plans.training import listwise_loss
from trawl.sources import records

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL that several queries share.


def fold_sql(x: str) -> str:
    return rf"trim(regexp_replace(lower(strip_accents({x})), '\s+', ' ', 'g'))"


def tokens_sql(x: str) -> str:
    return f"regexp_extract_all({fold_sql(x)}, '[a-z0-9]+')"


def grams_sql(x: str) -> str:
    f = f"replace({fold_sql(x)}, ' ', '_')"
    return f"list_transform(range(1, greatest(length({f}) - 1, 1)), lambda k: substring({f}, k, 3))"


def bm25_sql(name: str, k: int, k1: float = 1.5, b: float = 0.75, docs: str = "documents", asks: str = "benchmark") -> str:
    """CTEs that end in ``name``: query_id, doc_id, score, rank."""
    return f"""
{name}_d AS (SELECT doc_id, {tokens_sql('text')} AS t FROM {docs}),
{name}_n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM {name}_d),
{name}_tf AS (SELECT doc_id, term, greatest(dl, 1) AS dl, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM {name}_d) GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name}_q AS (SELECT DISTINCT item_id AS query_id, unnest({tokens_sql('text')}) AS term FROM {asks}),
{name}_s AS (
  SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))) AS score
  FROM {name}_q JOIN {name}_tf USING (term) JOIN {name}_df USING (term), {name}_n GROUP BY query_id, doc_id),
{name} AS (
  SELECT query_id, doc_id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {name}_s) WHERE rank <= {k})"""


NODES = """
nodes AS (
  SELECT 'C' || c_custkey AS id, 'Person' AS schema, c_name AS caption, n_name AS country, c_mktsegment AS topic FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'S' || s_suppkey, 'Company', s_name, n_name, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'N' || n_nationkey, 'Organization', n_name, n_name, NULL FROM nation
  UNION ALL SELECT 'R' || r_regionkey, 'Organization', r_name, NULL, NULL FROM region)"""
EDGES = """
edges AS (
  SELECT 'c' || c_custkey AS id, 'Membership' AS schema, 'C' || c_custkey AS source_id, 'N' || c_nationkey AS target_id FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'Ownership', 'S' || s_suppkey, 'N' || s_nationkey FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'Directorship', 'N' || n_nationkey, 'R' || n_regionkey FROM nation
  UNION ALL SELECT 'o' || o_orderkey, 'UnknownLink', 'O' || o_orderkey, 'C' || o_custkey FROM orders)"""
QRELS = "qrels AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
FAMILY = "CASE WHEN length(text) < 300 THEN 'short' ELSE 'long' END"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.expr(FAMILY).alias("family"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def bm25_run(spark: SparkSession, sf_dir: str, k: int, **options: float) -> DataFrame:
    return BM25(**options).index(corpus(spark, sf_dir)).search(asked(spark, sf_dir), k)


def document_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entities: the language is their kind, the source their caption and list."""
    none = F.array().cast("array<string>")
    topics = F.when(F.col("lang") == "en", F.array(F.lit("sanction"))).otherwise(none)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("schema"), F.concat_ws(" ", "lang", "source").alias("caption"), F.array("lang").alias("countries"), topics.alias("topics"),
        F.array("source").alias("datasets"), F.create_map().cast("map<string,array<string>>").alias("properties"), F.col("text").alias("search_text"),
    )


def relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage. The passages, a stated query set, are checked to be few and broadcast."""
    from trawl.operators.runs import small

    passages = small(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage")))
    return corpus(spark, sf_dir).join(passages, F.contains("text", F.col("passage"))).select("query_id", "doc_id")


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(name: str, kind: str, own: str, own_key: str, other: str, other_key: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(own.lower()), F.col(own_key)).alias("id"), F.lit(kind).alias("schema"), F.concat(F.lit(own), F.col(own_key)).alias("source_id"), F.concat(F.lit(other), F.col(other_key)).alias("target_id"))

    out = part("customer", "Membership", "C", "c_custkey", "N", "c_nationkey").unionAll(part("supplier", "Ownership", "S", "s_suppkey", "N", "s_nationkey"))
    out = out.unionAll(part("nation", "Directorship", "N", "n_nationkey", "R", "n_regionkey")).unionAll(part("orders", "UnknownLink", "O", "o_orderkey", "C", "o_custkey"))
    return out.withColumn("properties", F.create_map().cast("map<string,array<string>>"))


def node_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, suppliers, nations and regions as raw records."""
    nation = table(spark, sf_dir, "nation")

    def part(df: DataFrame, kind: str, own: str, key: str, name: str, country, topic) -> DataFrame:
        lists = F.map_filter(F.create_map(F.lit("name"), F.array(F.col(name)), F.lit("country"), F.array(country), F.lit("topics"), F.array(topic)), lambda _, v: F.get(v, F.lit(0)).isNotNull())
        return df.select(F.concat(F.lit(own), F.col(key)).alias("id"), F.lit(kind).alias("schema"), F.col(name).alias("caption"), F.array(F.lit("tables")).alias("datasets"), lists.alias("properties"))

    null = F.lit(None).cast("string")
    out = part(table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "Person", "C", "c_custkey", "c_name", F.col("n_name"), F.col("c_mktsegment"))
    out = out.unionAll(part(table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")), "Company", "S", "s_suppkey", "s_name", F.col("n_name"), null))
    out = out.unionAll(part(nation, "Organization", "N", "n_nationkey", "n_name", F.col("n_name"), null))
    return out.unionAll(part(table(spark, sf_dir, "region"), "Organization", "R", "r_regionkey", "r_name", null, null)).withColumn("ord", F.col("id"))


def nodes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.entities_of(node_records(spark, sf_dir)).drop("ord")


# Text.


@query(f"SELECT doc_id, md5({fold_sql('text')}) AS folded, length({fold_sql('text')})::BIGINT AS n FROM documents")
def fold_text(spark, sf_dir):
    folded = tx.fold(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(folded.cast("binary")).alias("folded"), F.length(folded).cast("long").alias("n"))


@query(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)")
def token_stats(spark, sf_dir):
    rows = corpus(spark, sf_dir).select("doc_id", tx.tokenize(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(f"SELECT gram, count(*) AS n, count(DISTINCT item_id) AS passages FROM (SELECT item_id, unnest({grams_sql('text')}) AS gram FROM benchmark) GROUP BY gram")
def char_trigrams(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.explode(tx.ngrams(F.col("text"))).alias("gram"))
    return rows.groupBy("gram").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("passages"))


LEGAL_SQL = ", ".join(f"'{w}'" for w in tx.LEGAL)
NORMALISED = f"array_to_string(list_filter(string_split(regexp_replace({fold_sql('name')}, '[^a-z0-9 ]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN ({LEGAL_SQL})), ' ')"


@query(f"SELECT DISTINCT name, {NORMALISED} AS normalised FROM (SELECT p_name AS name FROM part UNION ALL SELECT c_name FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT p_type || ' Co. Ltd' FROM part)")
def normalise_names(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.explode(F.array("p_name", F.concat("p_type", F.lit(" Co. Ltd")))).alias("name"))
    for t, c in (("customer", "c_name"), ("supplier", "s_name")):
        names = names.unionAll(table(spark, sf_dir, t).select(F.col(c)))
    return names.distinct().select("name", tx.normalise(F.col("name")).alias("normalised"))


@query(rf"""
SELECT doc_id, list_filter(ids, lambda x: x IN ('src1', 'src2')) AS retrieved, list_filter(ids, lambda x: x NOT IN ('src1', 'src2')) AS unsupported FROM (
  SELECT doc_id, list_filter([source, 'Q4211'], lambda x: length(x) > 2) AS ids FROM documents)""")
def citation_check(spark, sf_dir):
    report = F.concat(F.lit("See ["), "source", F.lit("], ["), "lang", F.lit("] and [Q4211]; again ["), "source", F.lit("]."))
    good, bad = tx.check_citations(F.col("report"), F.array(F.lit("src1"), F.lit("src2")))
    return table(spark, sf_dir, "documents").select("doc_id", report.alias("report")).select("doc_id", good.alias("retrieved"), bad.alias("unsupported"))


# Retrieval.


@query(f"""
WITH d AS (SELECT doc_id, {tokens_sql('text')} AS t FROM documents), f AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(t) AS term FROM d) GROUP BY term)
SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM f, (SELECT count(*) AS n FROM documents)""")
def term_df_idf(spark, sf_dir):
    stats = BM25().index(corpus(spark, sf_dir)).term_stats()
    return stats.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {bm25_sql('run', 10)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM run")
def bm25_topk(spark, sf_dir):
    return bm25_run(spark, sf_dir, 10).withColumn("score", F.round("score", 6))


CENTROIDS = "c AS (SELECT label, i, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i)"


@query(f"""
WITH {CENTROIDS}, s AS (
  SELECT label AS query_id, vec_id AS doc_id, sum(c.x * v.x) AS score FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) v JOIN c USING (i) GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def vector_topk(spark, sf_dir):
    """The query set: the mean vector of each label."""
    v = table(spark, sf_dir, "embeddings")
    parts = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    means = parts.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select(F.col("label").alias("query_id"), F.col("v.x").alias("vector"))
    run = nearest(means, v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), 10)
    return run.withColumn("score", F.round("score", 6))


def rrf_sql(weights: tuple[float, float]) -> str:
    w, v = weights
    return f"""WITH {bm25_sql('a', 50)}, {bm25_sql('b', 50, 0.9, 0.2)}, f AS (
  SELECT query_id, doc_id, sum(s) AS score, min(run * 1000 + rank) AS met FROM (
    SELECT query_id, doc_id, rank, 0 AS run, {w}::DOUBLE / (60 + rank) AS s FROM a UNION ALL SELECT query_id, doc_id, rank, 1, {v}::DOUBLE / (60 + rank) FROM b) GROUP BY query_id, doc_id)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, met, doc_id) AS rank FROM f) WHERE rank <= 20"""


def _fused(spark, sf_dir, weights):
    runs = [bm25_run(spark, sf_dir, 50), bm25_run(spark, sf_dir, 50, k1=0.9, b=0.2)]
    return rrf(runs, top=20, weights=weights).withColumn("score", F.round("score", 6))


@query(rrf_sql((1.0, 1.0)))
def rrf_fusion(spark, sf_dir):
    return _fused(spark, sf_dir, [1.0, 1.0])


@query(rrf_sql((2.0, 0.5)))
def weighted_rrf(spark, sf_dir):
    return _fused(spark, sf_dir, [2.0, 0.5])


@query("""
WITH n AS (SELECT DISTINCT p_name FROM part), s AS (SELECT n_name AS query_id, p_name AS doc_id, jaro_winkler_similarity(lower(n_name), p_name) AS score FROM nation, n)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 3""")
def jaro_winkler_topk(spark, sf_dir):
    """The query set: the names of the nations."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("doc_id")).distinct()
    pairs = names.join(F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_name").alias("query_id"))), how="cross")
    return ranked(pairs.withColumn("score", jaro_winkler_of(F.lower("query_id"), "doc_id")), 3).withColumn("score", F.round("score", 6))


@query(f"""
WITH n AS (SELECT DISTINCT p_name FROM part), s AS (SELECT r_name, p_type, {grams_sql('r_name')} AS a, {grams_sql('p_type')} AS b FROM region, (SELECT DISTINCT p_type FROM part))
SELECT r_name, p_type, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS score FROM s""")
def trigram_jaccard(spark, sf_dir):
    kinds = table(spark, sf_dir, "part").select("p_type").distinct()
    pairs = kinds.join(F.broadcast(table(spark, sf_dir, "region").select("r_name")), how="cross")
    return pairs.select("r_name", "p_type", F.round(tx.jaccard(tx.ngrams(F.col("r_name")), tx.ngrams(F.col("p_type"))), 6).alias("score"))


FEATURES_SQL = f"""{bm25_sql('run', 20)}, f0 AS (
  SELECT query_id, doc_id, rank - 1 AS prior_rank, list_distinct({tokens_sql('b.text')}) AS q, list_distinct({tokens_sql('d.text')}) AS t,
         {grams_sql('b.text')} AS a, {grams_sql("(d.lang || ' ' || d.source)")} AS c, lang
  FROM run JOIN benchmark b ON item_id = query_id JOIN documents d USING (doc_id)
), f AS (
  SELECT query_id, doc_id, prior_rank, CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, t)) / len(q) END AS coverage,
         len(list_intersect(q, t)) / len(list_distinct(list_concat(q, t))) AS jaccard,
         len(list_intersect(a, c)) / len(list_distinct(list_concat(a, c))) AS name_similarity,
         CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END::DOUBLE AS topic, 1.0::DOUBLE / (1 + prior_rank) AS retriever_prior FROM f0)"""
SCORE_SQL = " + ".join(f"{w} * {c}" for w, c in zip(DEFAULT_WEIGHTS, ("coverage", "jaccard", "name_similarity", "topic", "retriever_prior"), strict=True))


def _features(spark, sf_dir):
    return FeatureReranker().features(asked(spark, sf_dir), bm25_run(spark, sf_dir, 20), document_entities(spark, sf_dir))


@query(f"WITH {FEATURES_SQL} SELECT query_id, doc_id, prior_rank, round(coverage, 6) AS coverage, round(jaccard, 6) AS jaccard, round(name_similarity, 6) AS name_similarity, topic, round(retriever_prior, 6) AS retriever_prior FROM f")
def rerank_features(spark, sf_dir):
    return _features(spark, sf_dir).select("query_id", "doc_id", "prior_rank", "topic", *(F.round(c, 6).alias(c) for c in ("coverage", "jaccard", "name_similarity", "retriever_prior")))


@query(f"""WITH {FEATURES_SQL} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, prior_rank) AS rank FROM (SELECT *, {SCORE_SQL} AS score FROM f)) WHERE rank <= 10""")
def rerank_topk(spark, sf_dir):
    run = FeatureReranker().rerank(asked(spark, sf_dir), bm25_run(spark, sf_dir, 20), document_entities(spark, sf_dir), 10)
    return run.withColumn("score", F.round("score", 6))


# Measures.

SCORED_SQL = f"""{bm25_sql('r1', 20)}, {bm25_sql('r2', 20, 0.9, 0.2)}, {QRELS}, runs AS (SELECT 'okapi' AS system, * FROM r1 UNION ALL SELECT 'flat', * FROM r2),
hits AS (SELECT system, query_id, min(rank) AS first, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) END) AS gain FROM runs JOIN qrels USING (query_id, doc_id) GROUP BY ALL),
scored AS (
  SELECT s.system, item_id AS query_id, {FAMILY} AS family, {', '.join(f'(coalesce(first, 99) <= {k})::INT::DOUBLE AS r{k}' for k in evaluate.CUTS)},
         CASE WHEN first <= 10 THEN 1.0::DOUBLE / first ELSE 0 END AS mrr, coalesce(gain, 0) AS ndcg
  FROM (SELECT DISTINCT system FROM runs) s CROSS JOIN benchmark LEFT JOIN hits h ON h.system = s.system AND h.query_id = item_id)"""
MEANS_SQL = ", ".join(f"round(avg({a}), 3) AS {b}" for a, b in [*((f"r{k}", f"recall_{k}") for k in evaluate.CUTS), ("mrr", "mrr_10"), ("ndcg", "ndcg_10")])


def _means(spark, sf_dir):
    runs = bm25_run(spark, sf_dir, 20).withColumn("system", F.lit("okapi")).unionByName(bm25_run(spark, sf_dir, 20, k1=0.9, b=0.2).withColumn("system", F.lit("flat")))
    out = evaluate.means(evaluate.per_query(runs, relevant(spark, sf_dir), asked(spark, sf_dir)))
    return out.select("system", "family", "queries", *(F.col(f"`{m}`").alias(m.replace("@", "_")) for m in evaluate.METRICS))


@query(f"WITH {SCORED_SQL} SELECT system, count(*) AS queries, {MEANS_SQL} FROM scored GROUP BY system")
def eval_metrics(spark, sf_dir):
    return _means(spark, sf_dir).where("family IS NULL").drop("family")


@query(f"WITH {SCORED_SQL} SELECT system, family, count(*) AS queries, {MEANS_SQL} FROM scored GROUP BY system, family")
def eval_by_family(spark, sf_dir):
    return _means(spark, sf_dir).where("family IS NOT NULL")


BASELINE = (("okapi", "recall@10", 1.1), ("flat", "recall@10", 0.0), ("gone", "mrr@10", 0.5), ("okapi", "other", 0.1))


@query(f"""WITH {SCORED_SQL}, m AS (SELECT system, {MEANS_SQL} FROM scored GROUP BY system), v AS (SELECT system, 'recall@10' AS metric, recall_10 AS value FROM m UNION ALL SELECT system, 'mrr@10', mrr_10 FROM m),
base(system, metric, value) AS (VALUES {', '.join(map(str, BASELINE))})
SELECT CASE WHEN b.system NOT IN (SELECT system FROM v) THEN b.system || ': missing from results' WHEN v.value IS NULL THEN b.system || '.' || b.metric || ': missing'
            ELSE printf('%s.%s: %.3f < %.3f - 0.02', b.system, b.metric, v.value::DOUBLE, b.value::DOUBLE) END AS failure
FROM base b LEFT JOIN v USING (system, metric) WHERE v.value IS NULL OR v.value < b.value - 0.02
UNION ALL SELECT 'absent is no longer the best system by recall@10' WHERE (SELECT max(recall_10) FROM m) > 0""")
def quality_gate(spark, sf_dir):
    m = _means(spark, sf_dir).where("family IS NULL")
    results = m.select("system", F.explode(F.create_map(F.lit("recall@10"), "recall_10", F.lit("mrr@10"), "mrr_10")).alias("metric", "value"))
    return evaluate.gate(results, spark.createDataFrame(list(BASELINE), "system string, metric string, value double"), primary="absent")


@query(f"""WITH {FEATURES_SQL}, {QRELS}, g AS (SELECT f.*, q.doc_id IS NOT NULL AS relevant, {SCORE_SQL} AS z FROM f LEFT JOIN qrels q USING (query_id, doc_id)),
p AS (SELECT query_id, relevant, exp(z) / sum(exp(z)) OVER (PARTITION BY query_id) AS p FROM g)
SELECT round(avg(-ln(p + 1e-12)) + 1e-3 * {sum(w * w for w in DEFAULT_WEIGHTS)!r}, 6) AS loss FROM p WHERE relevant""")
def listwise_fit_loss(spark, sf_dir):
    rows = _features(spark, sf_dir).join(relevant(spark, sf_dir).withColumn("relevant", F.lit(True)), ["query_id", "doc_id"], "left").fillna(False, ["relevant"])
    return listwise_loss(rows, DEFAULT_WEIGHTS).select(F.round("loss", 6).alias("loss"))


# Answers, agents, adjudication.


@query(f"""WITH {bm25_sql('run', 3)}, l AS (
  SELECT query_id, count(*) AS n, string_agg('- ' || lang || ' ' || source || ' (' || concat_ws('; ', lang, lang, CASE WHEN lang = 'en' THEN 'sanction' END) || ') — listed in ' || source || ' [' || doc_id || ']', chr(10) ORDER BY rank) AS lines
  FROM run JOIN documents USING (doc_id) GROUP BY query_id)
SELECT item_id AS query_id, CASE WHEN n > 0 THEN n || ' candidate entities for: ' || text || chr(10) || lines ELSE '{answer.NOTHING}' END AS text, 'extractive' AS generator FROM benchmark LEFT JOIN l ON query_id = item_id""")
def extractive_answer(spark, sf_dir):
    return answer.answer(asked(spark, sf_dir), bm25_run(spark, sf_dir, 3), document_entities(spark, sf_dir), 3)


@query(f"""WITH {bm25_sql('run', 6)}, m AS (SELECT *, query_id * 1000 + rank AS met FROM run)
SELECT doc_id, round(score, 6) AS score, query_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, met) AS n FROM m) WHERE n = 1""")
def investigate_evidence(spark, sf_dir):
    """The passages as sub-queries of one investigation: each document's best evidence."""
    found = bm25_run(spark, sf_dir, 6).withColumn("met", F.col("query_id") * 1000 + F.col("rank")).withColumn("score", F.round("score", 9))
    return agent.best_evidence(found).select("doc_id", F.round("score", 6).alias("score"), "query_id")


JUDGED_SQL = f"""{bm25_sql('run', 10)}, {QRELS}, dec AS (
  SELECT item_id AS query_id, CASE WHEN item_id % 4 = 1 THEN max(q.doc_id) + 1 ELSE min(q.doc_id) END AS match_id, CASE WHEN {FAMILY} = 'short' THEN 'high' ELSE 'low' END AS confidence FROM benchmark LEFT JOIN qrels q ON q.query_id = item_id GROUP BY item_id, text),
after AS (SELECT query_id, doc_id, rank AS before, row_number() OVER (PARTITION BY query_id ORDER BY coalesce((doc_id = match_id)::INT, 0) DESC, rank) AS after FROM run LEFT JOIN dec USING (query_id)),
gap AS (SELECT query_id, coalesce(max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END), 'inf'::DOUBLE) AS gap FROM run GROUP BY query_id)"""


def _decisions(spark, sf_dir):
    """A stand-in for a judge: the relevant document with the smallest id, and for every fourth query the one after the largest."""
    pick = F.when(F.first("query_id") % 4 == 1, F.max("doc_id") + 1).otherwise(F.min("doc_id"))
    best = relevant(spark, sf_dir).groupBy("query_id").agg(pick.alias("match_id"))
    return asked(spark, sf_dir).join(best, "query_id", "left").select("query_id", "match_id", F.when(F.col("family") == "short", "high").otherwise("low").alias("confidence"))


@query(f"""WITH {JUDGED_SQL}, m(margin) AS (VALUES (0.02::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE), ('inf'::DOUBLE)),
r AS (SELECT margin, query_id, doc_id, gap < margin OR margin = 'inf'::DOUBLE AS asked, CASE WHEN gap < margin OR margin = 'inf'::DOUBLE THEN after ELSE before END AS rank FROM after JOIN gap USING (query_id), m),
b AS (SELECT margin, query_id, min(rank) AS best FROM r JOIN qrels USING (query_id, doc_id) GROUP BY ALL), a AS (SELECT DISTINCT margin, query_id, asked FROM r),
e AS (SELECT margin, item_id AS query_id FROM m CROSS JOIN benchmark)
SELECT margin, count(*) FILTER (WHERE asked) AS calls, round(avg((coalesce(best, 99) = 1)::INT::DOUBLE), 3) AS recall_1, round(avg(CASE WHEN best <= 10 THEN 1.0::DOUBLE / best ELSE 0 END), 3) AS mrr_10
FROM e LEFT JOIN b USING (margin, query_id) LEFT JOIN a USING (margin, query_id) GROUP BY margin""")
def adjudication_margin(spark, sf_dir):
    return adjudicate.sweep(bm25_run(spark, sf_dir, 10).cache(), _decisions(spark, sf_dir), relevant(spark, sf_dir), asked(spark, sf_dir))


@query(f"""WITH {JUDGED_SQL} SELECT confidence, count(*) FILTER (WHERE (query_id, match_id) IN (SELECT (query_id, doc_id) FROM qrels)) AS "right", count(*) AS picked FROM dec WHERE match_id IS NOT NULL GROUP BY confidence""")
def confidence_precision(spark, sf_dir):
    done = adjudicate.outcome(bm25_run(spark, sf_dir, 10).cache(), _decisions(spark, sf_dir), relevant(spark, sf_dir), asked(spark, sf_dir))
    return adjudicate.by_confidence(done)


@query(f"""WITH {JUDGED_SQL}, o AS (
  SELECT item_id, {FAMILY} AS family, match_id, EXISTS (SELECT 1 FROM after a JOIN qrels q USING (query_id, doc_id) WHERE a.query_id = item_id AND a.before = 1) AS b,
         EXISTS (SELECT 1 FROM after a JOIN qrels q USING (query_id, doc_id) WHERE a.query_id = item_id AND a.after = 1) AS z FROM benchmark JOIN dec ON query_id = item_id)
SELECT family, count(*) AS queries, count(*) FILTER (WHERE z AND NOT b) AS fixed, count(*) FILTER (WHERE b AND NOT z) AS broke, count(*) FILTER (WHERE match_id IS NULL) AS abstained,
       count(*) FILTER (WHERE match_id IS NOT NULL AND (item_id, match_id) NOT IN (SELECT (query_id, doc_id) FROM qrels)) AS picked_wrong, round(avg(b::INT), 2) AS share_before, round(avg(z::INT), 2) AS share_after FROM o GROUP BY ROLLUP (family)""")
def adjudication_outcome(spark, sf_dir):
    return adjudicate.summary(adjudicate.outcome(bm25_run(spark, sf_dir, 10).cache(), _decisions(spark, sf_dir), relevant(spark, sf_dir), asked(spark, sf_dir)))


@query(f"""WITH {bm25_sql('run', 5)}, l AS (SELECT query_id, string_agg('[' || rank || '] ' || lang || ' ' || source || ' | type=' || lang || ' | countries=' || lang || ' | lists=' || source, chr(10) ORDER BY rank) AS lines FROM run JOIN documents USING (doc_id) GROUP BY query_id)
SELECT query_id, 'QUERY: ' || text || chr(10) || chr(10) || 'CANDIDATES (in retrieval order):' || chr(10) || lines AS prompt FROM l JOIN benchmark ON item_id = query_id""")
def candidate_prompts(spark, sf_dir):
    return adjudicate.prompts(asked(spark, sf_dir), bm25_run(spark, sf_dir, 5), document_entities(spark, sf_dir)).select("query_id", "prompt")


# Records and store.


@query(f"""WITH {NODES} SELECT id, schema, caption, CASE WHEN country IS NULL THEN [] ELSE [country] END AS countries, CASE WHEN topic IS NULL THEN [] ELSE [topic] END AS topics, concat_ws(' ', caption, caption, country, topic) AS search_text FROM nodes""")
def flatten_search_text(spark, sf_dir):
    return nodes_of(spark, sf_dir).select("id", "schema", "caption", "countries", "topics", "search_text")


@query("""SELECT event_id, json_extract_string(props, '$.k') AS first_value, '{"k":["' || json_extract_string(props, '$.k') || '"]}' AS stored FROM events""")
def json_properties(spark, sf_dir):
    lists = F.transform_values(F.from_json("props", "map<string,string>"), lambda _, v: F.array(v))
    return table(spark, sf_dir, "events").select("event_id", lists.alias("p")).select("event_id", tx.first_of(F.col("p"), "k").alias("first_value"), F.to_json("p").alias("stored"))


@query("SELECT user_id::VARCHAR AS id, arg_min(event_type, event_id) AS schema, arg_max(event_type, event_id) AS caption, arg_min(props, event_id) AS properties, arg_max(props, event_id) AS search_text FROM events GROUP BY user_id")
def upsert_entities(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("schema"), F.col("event_type").alias("caption"), F.col("props").alias("properties"), F.col("props").alias("search_text"), F.col("event_id").alias("ord"))
    return records.upserted_entities(rows)


@query("SELECT user_id::VARCHAR AS id, arg_min(event_type, event_id) AS schema, min(event_id)::VARCHAR AS source_id FROM events GROUP BY user_id")
def upsert_relations(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("schema"), F.col("event_id").cast("string").alias("source_id"), F.col("event_id").alias("ord"))
    return records.upserted_relations(rows)


@query("""SELECT event_type AS name, count(value) AS n, round(sum(value), 4) AS total, """ + ", ".join(f"count(*) FILTER (WHERE value <= {b}) AS b{k}" for k, b in enumerate((1, 5, 10, 50, 100))) + " FROM events GROUP BY event_type")
def histogram_buckets(spark, sf_dir):
    h = observability.histogram(table(spark, sf_dir, "events"), "event_type", "value", (1, 5, 10, 50, 100))
    return h.select("name", "n", F.round("total", 4).alias("total"), *(F.get("buckets", F.lit(k)).alias(f"b{k}") for k in range(5)))


# Graph.


@query(f"WITH {EDGES} SELECT source_id AS node, target_id AS neighbour, schema, 'out' AS direction FROM edges UNION ALL SELECT target_id, source_id, schema, 'in' FROM edges")
def neighbours(spark, sf_dir):
    return records.adjacency(edges_of(spark, sf_dir)).drop("edge")


@query(f"""WITH {EDGES}, {NODES}, a AS (SELECT source_id AS id, target_id AS neighbour, schema, 'out' AS direction FROM edges UNION ALL SELECT target_id, source_id, schema, 'in' FROM edges)
SELECT a.id, neighbour, n.caption, a.schema AS relation, direction FROM a JOIN nodes n ON n.id = neighbour WHERE a.id IN (SELECT id FROM nodes WHERE schema = 'Organization')""")
def entity_view(spark, sf_dir):
    ents = nodes_of(spark, sf_dir)
    return graph.view(ents.where("schema = 'Organization'").select("id"), edges_of(spark, sf_dir), ents)


@query("""
WITH r AS (SELECT 'R' || n_regionkey AS query_id, 'S' || s_suppkey AS doc_id, s_nationkey AS n, s_acctbal AS score, row_number() OVER (PARTITION BY n_regionkey ORDER BY round(s_acctbal, 9) DESC, 'S' || s_suppkey) AS rank FROM supplier JOIN nation ON s_nationkey = n_nationkey),
l AS (SELECT query_id, max(rank) AS last FROM r GROUP BY query_id),
h AS (SELECT query_id, 'N' || n AS doc_id, arg_min(score, rank) * 0.45 AS score, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS nth FROM r GROUP BY query_id, n),
k AS (SELECT query_id, query_id AS doc_id, arg_min(score, nth) * 0.45 AS score, max(nth) + 1 AS nth FROM h GROUP BY query_id)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r UNION ALL SELECT query_id, doc_id, round(score, 6), last + nth FROM h JOIN l USING (query_id) UNION ALL SELECT query_id, doc_id, round(score, 6), last + nth FROM k JOIN l USING (query_id)""")
def graph_expand(spark, sf_dir):
    """The suppliers of each region by balance, then what they lead to: nations, then the region."""
    nation = table(spark, sf_dir, "nation")
    hits = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("R"), "n_regionkey").alias("query_id"), F.concat(F.lit("S"), "s_suppkey").alias("doc_id"), F.col("s_acctbal").alias("score"))
    out = graph.expand(ranked(hits, None), edges_of(spark, sf_dir), nodes_of(spark, sf_dir), hops=2, max_extra=None)
    return out.withColumn("score", F.round("score", 6))


@query("""SELECT 'N' || a.n_nationkey AS src, 'N' || b.n_nationkey AS dst,
  CASE WHEN a.n_nationkey = b.n_nationkey THEN ['N' || a.n_nationkey] ELSE ['N' || a.n_nationkey, 'R' || a.n_regionkey, 'N' || b.n_nationkey] END AS path,
  CASE WHEN a.n_nationkey = b.n_nationkey THEN 0 ELSE 2 END AS hops FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey""")
def shortest_path(spark, sf_dir):
    """All pairs of nations."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("src"))
    pairs = n.join(F.broadcast(n.withColumnRenamed("src", "dst")), how="cross")
    return graph.shortest_paths(pairs, edges_of(spark, sf_dir), 3)


@query(f"WITH {EDGES}, s AS (SELECT 'R' || r_regionkey AS id FROM region), a AS (SELECT source_id AS x, target_id AS y FROM edges UNION SELECT target_id, source_id FROM edges), h AS (SELECT DISTINCT y AS id FROM a JOIN s ON x = id) SELECT id FROM s UNION SELECT id FROM h UNION SELECT y FROM a JOIN h ON x = id")
def khop_nodes(spark, sf_dir):
    seeds = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("id"))
    return graph.within(seeds, edges_of(spark, sf_dir), 2)


@query(f"WITH {EDGES}, {NODES} SELECT schema, count(*) AS n FROM edges WHERE source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes) GROUP BY schema")
def induced_edges(spark, sf_dir):
    return graph.induced(edges_of(spark, sf_dir), nodes_of(spark, sf_dir)).groupBy("schema").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES} SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY id ORDER BY degree DESC, id LIMIT 25")
def degree_hubs(spark, sf_dir):
    return graph.hubs(edges_of(spark, sf_dir), 25)


@query(f"WITH {EDGES}, {NODES} SELECT 'relations' AS kind, schema, count(*) AS n FROM edges GROUP BY schema UNION ALL SELECT 'entities', schema, count(*) FROM nodes GROUP BY schema")
def schema_counts(spark, sf_dir):
    count = lambda df, kind: df.groupBy("schema").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "schema", "n")
    return count(edges_of(spark, sf_dir), "relations").unionAll(count(nodes_of(spark, sf_dir), "entities"))


@query(f"""WITH {EDGES} SELECT source_id AS id, target_id AS other, CASE schema WHEN 'Ownership' THEN 'owns' WHEN 'Directorship' THEN 'director of' WHEN 'Membership' THEN 'member of' ELSE 'linked to' END AS phrase FROM edges
UNION ALL SELECT target_id, source_id, CASE schema WHEN 'Ownership' THEN 'owned by' WHEN 'Directorship' THEN 'has director' WHEN 'Membership' THEN 'has member' ELSE 'linked to' END FROM edges""")
def relation_phrases(spark, sf_dir):
    return graph.phrased(edges_of(spark, sf_dir)).drop("detail")


@query("""WITH p AS (SELECT 'P' || lpad(p_partkey::VARCHAR, 8, '0') AS id, CASE WHEN p_size < 25 THEN upper(p_name) ELSE p_name || ' #' || p_partkey END AS caption FROM part),
b AS (SELECT id, trim(regexp_replace(regexp_replace(caption, '[\\\\/:*?"<>|#^\\[\\]\\n\\r\\t]+', ' ', 'g'), '\\s+', ' ', 'g')) AS base FROM p)
SELECT id, CASE WHEN count(*) OVER (PARTITION BY lower(base)) = 1 THEN base ELSE base || ' (' || right(id, 6) || ')' END AS name FROM b""".replace("\\\\", "\\"))
def name_clash(spark, sf_dir):
    captions = F.when(F.col("p_size") < 25, F.upper("p_name")).otherwise(F.concat("p_name", F.lit(" #"), "p_partkey"))
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("id"), captions.alias("caption"))
    return export.note_names(rows)


from trawl import queries_entities  # noqa: E402, F401  (registers more)
