"""Queries over files: whole tables written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sablevec.operators import index
from sablevec.plans.catalogue import register, registered
from sablevec.plans.corpora import vectors, words
from sablevec.plans.search_queries import TERMS, sql, token_search
from sablevec.session import scratch_root
from sablevec.sources import binary, text


def _place(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/tables/{name}-{uuid.uuid4().hex}"


@register("svbin_roundtrip", sql("SELECT (dense_rank() OVER (ORDER BY d) - 1)::BIGINT d, c, round(v::FLOAT::DOUBLE, 6) v FROM p"))
def svbin_roundtrip(spark, sf_dir):
    """The vectors of a binary file, which numbers them from 0; the shared folder is one that all machines mount."""
    f = index.fold(vectors(spark, sf_dir))
    path = _place(spark, "vectors").removeprefix("file://").removeprefix("file:") + ".bin"
    binary.write_binary(f.withColumn("values", F.col("values").cast("array<float>")), path)
    found = binary.read_binary(spark, path)
    return found.select(F.col("doc_id").alias("d"), F.inline(F.arrays_zip("components", "values")).alias("c", "v")).withColumn("v", F.round(F.col("v").cast("double"), 6))


@register("jsonl_scan", sql("SELECT d::VARCHAR AS name, token, v FROM w", ("w", TERMS)))
def jsonl_scan(spark, sf_dir):
    path = _place(spark, "lines")
    rows = words(spark, sf_dir).groupBy(F.col("d").cast("string").alias("id")).agg(F.collect_list(F.struct("token", "v")).alias("x"))
    rows.select("id", F.col("x.token").alias("tokens"), F.col("x.v").alias("values")).write.json(path)
    return text.read_token_documents(spark, path)


@register("tsv_sink", f"SELECT q::VARCHAR q, d::VARCHAR d, rank, score FROM ({registered('token_search')[1]})")
def tsv_sink(spark, sf_dir):
    path = _place(spark, "results")
    text.write_results(token_search(spark, sf_dir), path)
    return text.read_results(spark, path)
