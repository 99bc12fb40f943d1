"""JSON Lines corpora and queries, result and judgement tables, id maps and configuration files."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablevec.operators.order import numbered


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus by extension: ``.jsonl`` and ``.json`` (id, tokens, values), ``.bin`` and ``.parquet`` (doc_id, components, values)."""
    from sablevec.sources.binary import read_binary

    kind = path.rsplit(".", 1)[-1].lower()
    if path.endswith(".tar.gz") or kind not in ("jsonl", "json", "bin", "parquet"):
        raise ValueError(f"can't tell the format of {path!r}")
    if kind == "parquet":
        return spark.read.parquet(path)
    return read_binary(spark, path) if kind == "bin" else read_token_documents(spark, path)


def read_token_documents(spark: SparkSession, path: str) -> DataFrame:
    """(name, token, v): tokens and values zipped; malformed lines and documents without an id or tokens drop out as a whole."""
    docs = spark.read.schema("id string, tokens array<string>, values array<float>").option("mode", "DROPMALFORMED").json(path)
    fine = docs.where("id is not null and size(tokens) > 0 and size(tokens) = size(values)")
    return fine.select(F.col("id").alias("name"), F.inline(F.arrays_zip("tokens", "values")).alias("token", "v")).withColumn("v", F.col("v").cast("double"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(q, token, v) of lines with an id (a string or an unsigned number) and a map of weights; other lines drop out."""
    rows = spark.read.schema("id string, vector map<string, double>").option("mode", "DROPMALFORMED").json(path)
    return rows.where("id is not null and vector is not null").select(F.col("id").alias("q"), F.explode("vector").alias("token", "v"))


def number_documents(tokens: DataFrame) -> DataFrame:
    """(name, d): dense ids in order of names; ids of large corpora are dealt by range, not by one task."""
    return numbered(tokens.select("name").distinct(), "name", "d")


def encode_tokens(tokens: DataFrame, key: str, vocabulary: DataFrame) -> DataFrame:
    """Rows (key, c, v) of known tokens; unknown ones drop out with their values."""
    return tokens.join(vocabulary, "token").select(key, F.col("id").cast("int").alias("c"), "v")


def write_results(results: DataFrame, path: str) -> None:
    """query, document, rank (1 is best) and score, tab-separated, without a header."""
    results.select("q", "d", "rank", "score").write.option("sep", "\t").csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("q string, d string, rank int, score double").option("sep", "\t").csv(path)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(q, d, relevance) of either column order: the column that holds one value alone is the unused one."""
    raw = spark.read.schema("q string, a string, b string, c string").option("sep", "\t").csv(path)
    constant = raw.agg((F.count_distinct("a") <= 1).alias("x")).first()[0]
    d, r = ("b", "c") if constant else ("a", "b")
    return raw.select("q", F.col(d).alias("d"), F.col(r).cast("int").alias("relevance"))


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """(pos, id) of a ``.npy`` array (read by the driver) or of a text file with one id a line."""
    if path.endswith(".npy"):
        import numpy as np

        return spark.createDataFrame([(i, str(x)) for i, x in enumerate(np.load(path, allow_pickle=False).tolist())], "pos bigint, id string")
    with open(path) as f:
        return spark.createDataFrame([(i, x) for i, x in enumerate(f.read().split())], "pos bigint, id string")


def read_config(path: str) -> dict:
    with open(path, "rb") as f:
        return tomllib.load(f)
