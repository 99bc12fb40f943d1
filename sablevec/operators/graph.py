"""The nearest-neighbour graph: exact or searched construction, refinement of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablevec.operators import pairs
from sablevec.operators.search import score_pairs, small, top
from sablevec.session import configure


def build(p: DataFrame, degree: int, asked: DataFrame | None = None) -> DataFrame:
    """(d, rank, nbr, score): each document's ``degree`` best others, among all that share a component.

    ``asked`` limits the documents that get neighbours. Exact, by tiles of blocks (``pairs``); the work grows with asked
    documents times documents. For a searched graph, search blocks of documents through ``search.approximate`` and
    pass its rows to ``from_results``.
    """
    configure(p.sparkSession)
    return from_results(pairs.neighbours(p, degree, asked), degree)


def from_results(results: DataFrame, degree: int) -> DataFrame:
    ranked = top(results.where("q <> d").select("q", "d", "score"), degree)
    return ranked.select(F.col("q").alias("d"), "rank", F.col("d").alias("nbr"), "score")


def limit(knn: DataFrame, n: int) -> DataFrame:
    return knn.where(F.col("rank") <= n)


def refine(results: DataFrame, q: DataFrame, p: DataFrame, knn: DataFrame, n: int, k: int) -> DataFrame:
    """Results and their first ``n`` neighbours, scored exactly and cut to k; one hop, live documents only."""
    have = results.select("q", "d", "score")
    near = limit(knn, n).join(small(have.select("q", "d")), "d").select("q", F.col("nbr").alias("d")).distinct()
    fresh = near.join(have.select("q", "d"), ["q", "d"], "left_anti")
    return top(have.unionByName(score_pairs(fresh, q, p)), k)
