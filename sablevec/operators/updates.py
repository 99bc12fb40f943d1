"""Inserts, deletes and compaction of a blocked index, as batches.

New documents are routed to blocks; only touched blocks are changed. For one document the rules are the classic
running ones: mean ``(mu n + d) / (n + 1)`` or ``(mu n - d) / (n - 1)``, radius plus the shift of the mean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablevec.operators.index import block_sizes, summarise
from sablevec.operators.search import small


def alive(p: DataFrame, tombstones: DataFrame) -> DataFrame:
    return p.join(tombstones.select("d"), "d", "left_anti")


def route(new: DataFrame, sizes: DataFrame, summary: DataFrame) -> DataFrame:
    """(c, b, d): for each component of a new document, the block of that list with the largest product; ties to the
    lowest block, block 0 for a list without blocks. Components unknown to the index get a new list."""
    mine = small(new.select("d", "c"))
    x = small(new.select("d", F.col("c").alias("c2"), F.col("v").alias("w")))
    overlap = summary.join(mine, "c").join(x, ["d", "c2"]).groupBy("d", "c", "b").agg(F.sum(F.col("v") * F.col("w")).alias("s"))
    every = sizes.join(mine, "c").join(overlap, ["d", "c", "b"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    best = every.groupBy("d", "c").agg(F.max_by("b", F.struct(F.round("s", 9), -F.col("b"))).alias("b"))
    return new.select("d", "c").join(best, ["d", "c"], "left").select("c", F.coalesce("b", F.lit(0)).alias("b"), "d")


def _delta(routed: DataFrame, p: DataFrame) -> DataFrame:
    full = p.select("d", F.col("c").alias("c2"), F.col("v").alias("x"))
    return routed.join(full, "d").groupBy("c", "b", "c2").agg(F.max("x").alias("x_max"), F.sum("x").alias("x_sum"))


def insert_max(summary: DataFrame, routed: DataFrame, p: DataFrame) -> DataFrame:
    both = summary.join(_delta(routed, p), ["c", "b", "c2"], "full")
    return both.select("c", "b", "c2", F.greatest(F.coalesce("v", "x_max"), F.coalesce("x_max", "v")).alias("v"))


def shift_mean(summary: DataFrame, sizes: DataFrame, routed: DataFrame, p: DataFrame, sign: int) -> DataFrame:
    """Means after documents were added (sign 1, supports unite) or taken away (sign -1, the old support stays; empty blocks go)."""
    moved = routed.groupBy("c", "b").agg(F.count("*").alias("m"))
    n = sizes.join(moved, ["c", "b"], "full").select("c", "b", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))
    both = summary.join(_delta(routed, p), ["c", "b", "c2"], "full" if sign > 0 else "left").join(n, ["c", "b"])
    value = (F.coalesce("v", F.lit(0.0)) * F.col("n") + sign * F.coalesce("x_sum", F.lit(0.0))) / (F.col("n") + sign * F.col("m"))
    return both.where(F.col("n") + sign * F.col("m") > 0).select("c", "b", "c2", value.alias("v"))


def shift_radius(radii: DataFrame, summary: DataFrame, sizes: DataFrame, routed: DataFrame, p: DataFrame, sign: int) -> DataFrame:
    """A bound of the radius about the moved mean: the old one plus the shift, and for inserts the new documents' distances."""
    moved = routed.groupBy("c", "b").agg(F.count("*").alias("m"))
    touched = moved.join(sizes, ["c", "b"]).where(F.col("n") + sign * F.col("m") > 0)
    both = summary.join(moved.select("c", "b"), ["c", "b"], "left_semi").join(_delta(routed, p), ["c", "b", "c2"], "full").join(touched, ["c", "b"])
    step = (F.coalesce("x_sum", F.lit(0.0)) - F.col("m") * F.coalesce("v", F.lit(0.0))) / (F.col("n") + sign * F.col("m"))
    shift = both.groupBy("c", "b").agg(F.sqrt(F.sum(step * step)).alias("shift"))
    out = radii.join(shift, ["c", "b"], "left").withColumn("radius", F.col("radius") + F.coalesce("shift", F.lit(0.0)))
    if sign > 0:
        mean = shift_mean(summary, sizes, routed, p, 1).join(moved.select("c", "b"), ["c", "b"], "left_semi")
        norm = mean.groupBy("c", "b").agg(F.sum(F.col("v") * F.col("v")).alias("norm"))
        full = p.select("d", F.col("c").alias("c2"), F.col("v").alias("x"))
        each = routed.join(full, "d").join(mean, ["c", "b", "c2"], "left").groupBy("c", "b", "d").agg(F.sum(F.col("x") * F.col("x") - 2 * F.col("x") * F.coalesce("v", F.lit(0.0))).alias("t"))
        far = each.join(norm, ["c", "b"]).groupBy("c", "b").agg(F.max(F.sqrt(F.greatest(F.lit(0.0), F.col("norm") + F.col("t")))).alias("far"))
        out = out.join(far, ["c", "b"], "full").withColumn("radius", F.greatest(F.coalesce("radius", F.lit(0.0)), F.coalesce("far", F.lit(0.0))))
    return out.select("c", "b", "radius")


def touched(blocks: DataFrame, removed: DataFrame) -> DataFrame:
    return blocks.join(removed.select("d"), "d", "left_semi").select("c", "b").distinct()


def delete_max(summary: DataFrame, blocks: DataFrame, p: DataFrame, removed: DataFrame, energy: float) -> DataFrame:
    """Maxima of touched blocks made again from their live documents; the others stay."""
    t = touched(blocks, removed)
    live = blocks.join(removed.select("d"), "d", "left_anti").join(t, ["c", "b"], "left_semi")
    return summary.join(t, ["c", "b"], "left_anti").unionByName(summarise(live, p, "max", energy))


def compact(blocks: DataFrame, tombstones: DataFrame) -> DataFrame:
    return blocks.join(tombstones.select("d"), "d", "left_anti")


__all__ = ["alive", "block_sizes", "compact", "delete_max", "insert_max", "route", "shift_mean", "shift_radius", "touched"]
