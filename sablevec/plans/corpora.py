"""Sparse corpora made from the test tables, as exploded rows (d, c, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablevec.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("d"), F.posexplode("embedding").alias("c", "v")).withColumn("v", F.col("v").cast("double"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-negative vectors, as learned sparse encoders give them."""
    return signed_vectors(spark, sf_dir).where("v > 0.1")


def queries_of(p: DataFrame, n: int = 20) -> DataFrame:
    return p.where(F.col("d") < n).withColumnRenamed("d", "q")


def asked_of(p: DataFrame) -> DataFrame:
    """The whole query set: every vector whose id is divisible by 50."""
    return p.where(F.col("d") % 50 == 0).withColumnRenamed("d", "q")


def words(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """Term frequencies of runs of a-z: (d, token, v)."""
    t = table(spark, sf_dir, name)
    tokens = t.select(F.col(key).alias("d"), F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("token")).where("token <> ''")
    return tokens.groupBy("d", "token").agg(F.count("*").cast("double").alias("v"))
