"""Building blocks of the inverted index: inversion, pruning, blocking, summaries.

Postings are rows (d, c, v): document, component, value. Blocks are rows (c, b, d), summaries (c, b, c2, v).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = ["c", "b"]


def invert(docs: DataFrame) -> DataFrame:
    """(d, c, v) of documents with parallel arrays; the arrays are zipped before anything is dropped."""
    return docs.select(F.col("doc_id").alias("d"), F.inline(F.arrays_zip("components", "values")).alias("c", "v")).withColumn("v", F.col("v").cast("double"))


def fold(p: DataFrame) -> DataFrame:
    """Back to parallel arrays, sorted by component."""
    return p.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("x")).select(F.col("d").alias("doc_id"), F.col("x.c").alias("components"), F.col("x.v").alias("values"))


def prune_fixed(p: DataFrame, n: int) -> DataFrame:
    """The n largest postings of each component, with their rank ``rk``; ties to the smaller document."""
    w = Window.partitionBy("c").orderBy(F.desc("v"), "d")
    return p.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= n)


def kth_value(p: DataFrame, k: int) -> float | None:
    """The k-th largest value, exactly: a quantile sketch brackets it, only the bracket is sorted."""
    total = p.count()
    if not 0 < k <= total:
        return None
    error = 0.001
    low, high = p.approxQuantile("v", [max(0.0, 1 - k / total - 2 * error), min(1.0, 1 - k / total + 2 * error)], error)
    above = p.where(F.col("v") > high).count()
    if above >= k:
        low, high, above = high, float("inf"), 0
    inside = p.where((F.col("v") >= low) & (F.col("v") <= high)).groupBy("v").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, 0)
    row = inside.withColumn("upto", F.sum("n").over(w)).where(F.col("upto") >= k - above).agg(F.max("v")).first()
    return row[0] if row[0] is not None else p.select("v").orderBy(F.desc("v")).limit(k).agg(F.min("v")).first()[0]


def prune_global(p: DataFrame, n: int, max_fraction: float = 1.5) -> DataFrame:
    """The ``n * dim`` largest postings of all, a tenth more of equal value, then at most ``n * max_fraction`` of each component."""
    p = p.select("d", "c", "v")
    dim, total = p.agg(F.max("c") + 1, F.count("*")).first()
    if not total:
        return prune_fixed(p, 0)
    most = dim * n
    keep = min(most, total - 1)
    cut = kth_value(p, keep + 1)
    above = p.where(F.col("v") > cut)
    room = keep - above.count() + most * 10 // 100
    # only equal values are ranked over the whole table
    ties = p.where(F.col("v") == cut).orderBy("d", "c").limit(room)
    return prune_fixed(above.unionByName(ties), int(n * max_fraction))


def block_chunks(pruned: DataFrame, size: int) -> DataFrame:
    """Runs of ``size`` postings in pruned order."""
    return pruned.select("c", F.floor((F.col("rk") - 1) / size).cast("int").alias("b"), "d")


def block_round_robin(pruned: DataFrame, fraction: float) -> DataFrame:
    """Postings dealt in turn to ``max(1, floor(fraction * length))`` blocks."""
    lists = pruned.groupBy("c").agg(F.greatest(F.floor(F.lit(fraction) * F.count("*")), F.lit(1)).alias("n"))
    return pruned.join(lists, "c").select("c", ((F.col("rk") - 1) % F.col("n")).cast("int").alias("b"), "d")


def representatives(pruned: DataFrame, n: int, seed: int) -> DataFrame:
    """(c, j, r): at most n documents of each list, in the order of a seeded hash."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("c").cast("string"), F.col("d").cast("string")))
    w = Window.partitionBy("c").orderBy(order, "d")
    return pruned.withColumn("j", F.row_number().over(w) - 1).where(F.col("j") < n).select("c", "j", F.col("d").alias("r"))


def block_representatives(pruned: DataFrame, p: DataFrame, n: int, seed: int = 7, doc_cut: int | None = None) -> DataFrame:
    """Each posting to its nearest representative by inner product (ties to the lowest), blocks numbered without gaps."""
    reps = representatives(pruned, n, seed).join(p.select(F.col("d").alias("r"), F.col("c").alias("c2"), F.col("v").alias("w")), "r")
    own = top_components(p, "d", doc_cut) if doc_cut else p
    docs = pruned.select("c", "d").join(own.select("d", F.col("c").alias("c2"), "v"), "d")
    scored = docs.join(reps, ["c", "c2"]).groupBy("c", "d", "j").agg(F.sum(F.col("v") * F.col("w")).alias("s"))
    best = scored.groupBy("c", "d").agg(F.max_by("j", F.struct(F.round("s", 9), -F.col("j"))).alias("j"))
    all_ = pruned.select("c", "d").join(best, ["c", "d"], "left").withColumn("j", F.coalesce("j", F.lit(0)))
    return all_.select("c", (F.dense_rank().over(Window.partitionBy("c").orderBy("j")) - 1).cast("int").alias("b"), "d")


def top_components(p: DataFrame, key: str, n: int) -> DataFrame:
    """The n largest components of each vector; ties to the smaller component."""
    w = Window.partitionBy(key).orderBy(F.desc("v"), "c")
    return p.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def block_sizes(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("c", "b").agg(F.count("*").alias("n"))


def block_totals(blocks: DataFrame, p: DataFrame) -> DataFrame:
    """(c, b, c2, most, total) over the full vectors of each block's documents."""
    full = p.select("d", F.col("c").alias("c2"), "v")
    return blocks.join(full, "d").groupBy("c", "b", "c2").agg(F.max("v").alias("most"), F.sum("v").alias("total"))


def energy_cut(rows: DataFrame, value: str, energy: float) -> DataFrame:
    """Rows of each block, largest first, while the share before them is at most ``energy``; the crossing row stays."""
    w = Window.partitionBy("c", "b")
    before = F.sum(value).over(w.orderBy(F.desc(value), "c2").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_share", F.round(F.coalesce(before, F.lit(0.0)) / F.sum(value).over(w), 9)).where(F.col("_share") <= energy).drop("_share")


def fixed_cut(rows: DataFrame, value: str, n: int) -> DataFrame:
    w = Window.partitionBy("c", "b").orderBy(F.desc(value), "c2")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def summarise(blocks: DataFrame, p: DataFrame, kind: str = "max", energy: float | None = None, components: int | None = None) -> DataFrame:
    """(c, b, c2, v): component-wise maximum or mean of a block, cut by energy or to a number of components.

    A mean is cut on its sums and divided by the block's size.
    """
    totals = block_totals(blocks, p)
    value = "most" if kind == "max" else "total"
    if energy is not None:
        totals = energy_cut(totals, value, energy)
    elif components is not None:
        totals = fixed_cut(totals, value, components)
    if kind == "max":
        return totals.select("c", "b", "c2", F.col("most").alias("v"))
    return totals.join(block_sizes(blocks), BLOCK).select("c", "b", "c2", (F.col("total") / F.col("n")).alias("v"))


def radius(blocks: DataFrame, summary: DataFrame, p: DataFrame) -> DataFrame:
    """(c, b, radius): the largest distance of a block's document to its stored summary."""
    norm = summary.groupBy("c", "b").agg(F.sum(F.col("v") * F.col("v")).alias("norm"))
    full = p.select("d", F.col("c").alias("c2"), F.col("v").alias("x"))
    each = blocks.join(full, "d").join(summary, ["c", "b", "c2"], "left")
    term = F.col("x") * F.col("x") - 2 * F.col("x") * F.coalesce("v", F.lit(0.0))
    dist = each.groupBy("c", "b", "d").agg(F.sum(term).alias("t"))
    return dist.join(norm, BLOCK).groupBy("c", "b").agg(F.max(F.sqrt(F.greatest(F.lit(0.0), F.col("norm") + F.col("t")))).alias("radius"))


def quantise(summary: DataFrame) -> DataFrame:
    """Summaries with ``minimum``, ``quant`` and an 8-bit ``code``; a constant block has quant 1 and codes 0."""
    w = Window.partitionBy("c", "b")
    low, high = F.min("v").over(w), F.max("v").over(w)
    s = summary.withColumn("minimum", low).withColumn("quant", F.when(high > low, (high - low) / 256).otherwise(F.lit(1.0)))
    return s.withColumn("code", F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (F.col("v") - F.col("minimum")) / F.col("quant")))).cast("int"))


def dequantise(q: DataFrame) -> DataFrame:
    return q.select("c", "b", "c2", (F.col("code") * F.col("quant") + F.col("minimum")).alias("v"))
