"""Retrieval metrics, percentiles, block diagnostics and space formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall(truth: DataFrame, results: DataFrame) -> DataFrame:
    """(hits, relevant, recall) of distinct (q, d)."""
    t = truth.select("q", "d").distinct()
    hit = t.join(results.select("q", "d").distinct(), ["q", "d"], "left_semi").agg(F.count("*").alias("hits"))
    return t.agg(F.count("*").alias("relevant")).crossJoin(hit).select("hits", "relevant", (F.col("hits") / F.col("relevant")).alias("recall"))


def reciprocal_rank(results: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """The mean, over judged queries, of 1 / rank of the first relevant result in the top k; none counts 0."""
    good = qrels.where("relevance > 0").select("q", "d").distinct()
    first = results.where(F.col("rank") <= k).join(good, ["q", "d"]).groupBy("q").agg(F.min("rank").alias("rank"))
    judged = qrels.select("q").distinct()
    return judged.join(first, "q", "left").agg(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("rr"))


def nearest_rank(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """(p, value) at the ascending position ``min(n - 1, floor(p n))``, with mean and greatest value.

    Only distinct values with their counts are ordered in one place.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    total = df.agg(F.count("*").alias("total"))
    p = df.sparkSession.createDataFrame([(x,) for x in shares], "p double").crossJoin(total)
    at = p.withColumn("at", F.least(F.col("total") - 1, F.floor(F.col("p") * F.col("total"))))
    return upto.join(F.broadcast(at), (F.col("upto") > F.col("at")) & (F.col("upto") - F.col("n") <= F.col("at"))).select("p", F.col(value).alias("value"))


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    at = df.withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count("*").over(w))
    return at.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select(*keys, F.col(value).alias("median"))


def corpus_bytes(p: DataFrame, mutable: bool = False) -> DataFrame:
    """Bytes of the compressed-row layout: counts, offsets, components, values and, if mutable, liveness."""
    n, nnz = F.countDistinct("d"), F.count("*")
    size = 8 * (n + 1) + 6 * nnz + (8 + n if mutable else 16)
    return p.agg(n.cast("bigint").alias("vectors"), (F.max("c") + 1).alias("dim"), nnz.alias("nnz"), size.cast("bigint").alias("bytes"))
