"""Ranking and pair metrics over whole tables of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_query(order: str):
    return Window.partitionBy("query_id").orderBy(order)


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, precision, recall, reciprocal_rank, ndcg) of each query with a ranking, or of all ``queries`` (query_id).

    ``ranked`` has query_id, item and rank from 1, ``relevant`` has query_id and item. Precision is over
    the rows returned up to k, recall and nDCG (binary, with log2 discounts) are 1 without relevant items.
    """
    rel = relevant.distinct().withColumn("hit", F.lit(1))
    n = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    h = ranked.join(rel, ["query_id", "item"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    top = F.col("rank") <= k
    p = h.groupBy("query_id").agg(
        F.count_if(top).alias("shown"),
        F.sum(F.when(top, F.col("hit")).otherwise(0)).alias("hits"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(top, F.col("hit") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    if queries is not None:
        p = queries.select("query_id").distinct().join(p, "query_id", "left").fillna(0, ["shown", "hits", "dcg"])
    p = p.join(n, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("n").cast("int")))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return p.select(
        "query_id",
        F.when(F.col("shown") > 0, F.col("hits") / F.col("shown")).otherwise(0.0).alias("precision"),
        F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(1.0).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(1.0).alias("ndcg"),
    )


def averages(metrics: DataFrame) -> DataFrame:
    """One row: queries and the mean of each metric, 0 where there is no query."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return metrics.agg(F.count(F.lit(1)).alias("queries"), mean("precision").alias("precision"), mean("recall").alias("recall"), mean("reciprocal_rank").alias("mrr"), mean("ndcg").alias("ndcg"))


def pair_precision_recall(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: hits, precision and recall of pairs (a, b); 1 where a side is empty."""
    p, e = predicted.select("a", "b").distinct(), expected.select("a", "b").distinct()
    both = p.withColumn("p", F.lit(1)).join(e.withColumn("e", F.lit(1)), ["a", "b"], "full_outer")
    c = both.agg(F.count_if(F.col("p").isNotNull() & F.col("e").isNotNull()).alias("hits"), F.count("p").alias("np"), F.count("e").alias("ne"))
    part = lambda n: F.when(F.col(n) == 0, 1.0).otherwise(F.round(F.col("hits") / F.col(n), 6))
    return c.select("hits", part("np").alias("precision"), part("ne").alias("recall"))
