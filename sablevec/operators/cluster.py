"""One-pass k-means over sparse documents: sampled centroids, assignment, small clusters dissolved."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sablevec.operators.index import prune_fixed, top_components
from sablevec.operators.search import small


def sample(p: DataFrame, n: int, seed: int) -> DataFrame:
    """(j, r): n documents in the order of a seeded hash."""
    ids = p.select("d").distinct().withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("d").cast("string"))))
    first = ids.orderBy("h", "d").limit(n)
    return first.select((F.row_number().over(Window.orderBy("h", "d")) - 1).alias("j"), F.col("d").alias("r"))


def _best(scored: DataFrame) -> DataFrame:
    return scored.groupBy("d").agg(F.max_by("j", F.struct(F.round("s", 9), -F.col("j"))).alias("j"))


def _assign(p: DataFrame, centroids: DataFrame, how: str, doc_cut: int, factor: float, own: bool) -> DataFrame:
    """(d, j) for every document; without any overlap the first centroid wins."""
    c = centroids.join(p.withColumnRenamed("d", "r"), "r").select("j", "r", "c", F.col("v").alias("w"))
    if how == "exact":
        pairs = None
        probe = p
    else:
        probe = top_components(p, "d", doc_cut)
        pairs = None
        if how == "pruned":
            n = centroids.count()
            kept = prune_fixed(c.select(F.col("j").alias("d"), "c", F.col("w").alias("v")), max(5, int(n * factor)))
            pairs = probe.select("d", "c").join(small(kept.select(F.col("d").alias("j"), "c")), "c").select("d", "j").distinct()
            probe = p
    scored = probe.join(small(c.select("j", "c", "w")), "c").groupBy("d", "j").agg(F.sum(F.col("v") * F.col("w")).alias("s"))
    if pairs is not None:
        scored = scored.join(pairs, ["d", "j"], "left_semi")
    first = centroids.agg(F.min("j").alias("first"))
    best = p.select("d").distinct().join(_best(scored), "d", "left").crossJoin(F.broadcast(first)).select("d", F.coalesce("j", "first").alias("j"))
    if own:
        self_ = centroids.select(F.col("r").alias("d"), F.col("j").alias("own"))
        best = best.join(self_, "d", "left").select("d", F.coalesce("own", "j").alias("j"))
    return best


def kmeans(p: DataFrame, n: int, min_size: int, how: str = "exact", seed: int = 7, doc_cut: int = 15, factor: float = 0.1) -> DataFrame:
    """(d, j): cluster of each document.

    ``how``: inner products with all centroids; ``pruned``: only with centroids met through a pruned centroid
    index on the document's top components; ``approx``: over the document's top components alone. Clusters of
    ``min_size`` documents or fewer are dissolved and their documents assigned anew; the largest stays if all
    would go.
    """
    centroids = sample(p, n, seed)
    own = how != "approx"
    one = _assign(p, centroids, how, doc_cut, factor, own)
    sizes = one.groupBy("j").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("n"), "j")
    keep = sizes.withColumn("r", F.row_number().over(w)).where((F.col("n") > min_size) | (F.col("r") == 1)).select("j")
    stay = one.join(F.broadcast(keep), "j", "left_semi").select("d", "j")
    loose = one.join(F.broadcast(keep), "j", "left_anti").select("d")
    again = _assign(p.join(loose, "d", "left_semi").unionByName(p.join(centroids.join(F.broadcast(keep), "j", "left_semi").select(F.col("r").alias("d")), "d", "left_semi")).distinct(), centroids.join(F.broadcast(keep), "j", "left_semi"), how, doc_cut, factor, own)
    return stay.unionByName(again.join(loose, "d", "left_semi").select("d", "j"))
