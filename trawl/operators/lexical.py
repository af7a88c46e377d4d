"""Okapi BM25 over batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.text import tokenize
from trawl.operators.runs import ranked, small, spread


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term``: the distinct terms of ``query_id, query``."""
    return queries.select("query_id", F.explode(F.array_distinct(tokenize(F.col("query")))).alias("term"))


class BM25:
    """An index of ``doc_id, text``; searching takes all queries at once.

    Without a stored index only the postings of the queries' own terms are made:
    the terms are broadcast to the scan (if few), and what is shuffled are
    partial counts for them. A stored one keeps all postings sorted by term, so
    that a search skips the row groups of other terms.
    """

    def __init__(self, k1: float = 1.5, b: float = 0.75):
        self.k1, self.b, self.docs, self.postings = k1, b, None, None

    def index(self, docs: DataFrame) -> BM25:
        self.docs = spread(docs.select("doc_id", "text")).select("doc_id", tokenize(F.col("text")).alias("tokens"))
        return self

    def stats(self) -> DataFrame:
        """One row: documents and their mean length; those without tokens count."""
        return self.docs.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)).alias("avgdl"))

    def term_counts(self, terms: DataFrame | None = None) -> DataFrame:
        """``doc_id, term, dl, tf``, of the given terms only or of all."""
        # The outer form: for the inner one a filter on the array's size is inferred, and tokens are made twice.
        words = self.docs.select("doc_id", F.size("tokens").alias("dl"), F.explode_outer("tokens").alias("term")).where("term IS NOT NULL")
        if terms is not None:
            words = words.join(small(terms), "term", "left_semi")
        return words.groupBy("doc_id", "term", "dl").agg(F.count("*").alias("tf"))

    def term_stats(self, counts: DataFrame | None = None) -> DataFrame:
        """``term, df, idf``."""
        found = (self.term_counts() if counts is None else counts).groupBy("term").agg(F.count("*").alias("df"))
        return found.join(F.broadcast(self.stats()), how="inner").select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))

    def save(self, path: str) -> None:
        self.term_counts().repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.stats().write.mode("overwrite").parquet(f"{path}/stats")

    def load(self, spark, path: str) -> BM25:
        self.postings, stats = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats")
        self.stats = lambda: stats
        return self

    def scores(self, queries: DataFrame) -> DataFrame:
        """``query_id, doc_id, score`` of every document that has a term of the query."""
        wanted = query_terms(queries)
        terms = wanted.select("term").distinct()
        if self.postings is None:
            counts = self.term_counts(terms)
        else:
            counts = self.postings.join(small(terms), "term", "left_semi")
        stats = F.broadcast(self.stats())
        # df names tf, so that both sides of the join are the same exchange and it is made once.
        weighed = counts.join(stats, how="inner").join(counts.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df")), "term")
        dl = F.greatest("dl", F.lit(1))
        tf = F.col("tf")
        gain = idf(F.col("n"), F.col("df")) * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / F.col("avgdl")))
        return weighed.select("term", "doc_id", gain.alias("gain")).join(small(wanted), "term").groupBy("query_id", "doc_id").agg(F.sum("gain").alias("score"))

    def search(self, queries: DataFrame, k: int = 50) -> DataFrame:
        return ranked(self.scores(queries), k)
