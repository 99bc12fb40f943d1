"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablevec.llm import ann, decontam, html_extract, jaccard_join, langid, license_scan, oracles, pii, secrets, sp_codec, suffix_dedup
from sablevec.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


#: Stands in for a secret that a deployment passes in; pseudonyms are as safe as this key.
PII_KEY = "key for tests"


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), PII_KEY)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(table(spark, sf_dir, "documents")))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


#: Where the public vocabulary files are.
TOKENIZERS = "/opt/tokenizers"
SP_MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_codec.codec(table(spark, sf_dir, "documents"), sp_codec.load(spark, SP_MODEL), outputs=("n_tokens", "ids_sha256", "exact", "parity"), kept=300_000)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.predict(docs, model).select("doc_id", F.coalesce(langid.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.digest(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), locate=True))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op5_secret_scan": oracles.SECRETS, "op9_jaccard_join": oracles.JACCARD, "op10_decontamination": oracles.BENCHMARK}
