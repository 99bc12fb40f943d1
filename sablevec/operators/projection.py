"""Random projections of sparse vectors (Johnson-Lindenstrauss)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def matrix(spark: SparkSession, dim: int, k: int, s: int, seed: int = 7) -> DataFrame:
    """(c, r, w): s of k rows for each input component, by a seeded hash, with the weight 1 / sqrt(s) and a hashed sign."""
    grid = spark.range(dim).select(F.col("id").cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("r"))
    text = F.concat_ws(":", F.lit(str(seed)), F.col("c").cast("string"), F.col("r").cast("string"))
    w = Window.partitionBy("c").orderBy(F.md5(text), "r")
    sign = F.when(F.substring(F.md5(F.concat(text, F.lit(":sign"))), 1, 1) < "8", 1.0).otherwise(-1.0)
    return grid.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= s).select("c", "r", (sign / math.sqrt(s)).alias("w"))


def transform(vectors: DataFrame, jlt: DataFrame, keys: list[str], eps: float = 0.0, component: str = "c") -> DataFrame:
    """``keys``, r and the projected value of rows (keys, component, v)."""
    x = vectors.withColumnRenamed(component, "_in")
    y = x.join(jlt.withColumnRenamed("c", "_in"), "_in").groupBy(*keys, "r").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return y.where(F.abs("v") >= eps) if eps > 0 else y


def dense_matrix(spark: SparkSession, dim: int, k: int, seed: int = 7) -> DataFrame:
    """Gaussian weights N(0, 1) / sqrt(k)."""
    grid = spark.range(dim * k)
    return grid.select((F.col("id") % dim).cast("int").alias("c"), F.floor(F.col("id") / dim).cast("int").alias("r"), (F.randn(seed) / math.sqrt(k)).alias("w"))


def random_data(spark: SparkSession, n: int, dim: int, seed: int = 42) -> DataFrame:
    return spark.range(n * dim).select(F.floor(F.col("id") / dim).cast("bigint").alias("d"), (F.col("id") % dim).cast("int").alias("c"), F.randn(seed).alias("v"))


def distances(a: DataFrame, pairs: DataFrame) -> DataFrame:
    """(x, y, dist): Euclidean distances of the rows (d, c, v) at the pairs (x, y)."""
    left = pairs.join(a.select(F.col("d").alias("x"), "c", F.col("v").alias("vx")), "x")
    right = pairs.join(a.select(F.col("d").alias("y"), "c", F.col("v").alias("vy")), "y")
    diff = F.coalesce("vx", F.lit(0.0)) - F.coalesce("vy", F.lit(0.0))
    return left.join(right, ["x", "y", "c"], "full").groupBy("x", "y").agg(F.sqrt(F.sum(diff * diff)).alias("dist"))


def least_rows(points: int = 100, eps: float = 0.1) -> int:
    """Rows that keep all distances of so many points within 1 +- eps."""
    return math.ceil(4 * math.log(points) / (eps * eps * 0.5))
