"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's
input. All but the last return the columns of their input. Rows of null text go with the language stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sablevec.llm import decontam, jaccard_join, langid, secrets, sp_codec
from sablevec.llm.queries import SP_MODEL, table
from sablevec.session import configure, materialise, settle


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, no letters) go; a missing label is filled in."""
    configure(spark)
    settle(spark)
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.keep_known(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingle overlap stays."""
    configure(spark)
    settle(spark)
    return jaccard_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    configure(spark)
    settle(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blotted out; no document goes."""
    configure(spark)
    settle(spark)
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding."""
    configure(spark)
    settle(spark)
    return sp_codec.codec(docs, sp_codec.load(spark, SP_MODEL), keep=("doc_id", "lang", "source"), outputs=("n_tokens", "ids", "exact"))


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("decontamination", benchmark),
    ("secret_scan", secret_scan),
    ("sentencepiece", tokens),
]

#: Trained scores, similarity components and tokens of a vocabulary file aren't SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = materialise(stage(spark, out, sf_dir), name)
    return STAGES[-1][1](spark, out, sf_dir)
