"""Exact and approximate top-k search over whole batches of queries (q, c, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sablevec.operators.index import top_components
from sablevec.session import materialise

#: Rows of a query batch that may be broadcast.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows; larger ones are left to the planner."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def query_cut(q: DataFrame, n: int) -> DataFrame:
    return top_components(q, "q", n)


def scores(q: DataFrame, p: DataFrame) -> DataFrame:
    """(q, d, score) of pairs that share a component."""
    return p.join(small(q.select("q", "c", F.col("v").alias("w"))), "c").groupBy("q", "d").agg(F.sum(F.col("v") * F.col("w")).alias("score"))


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their rank, best first; ties to the smaller document."""
    w = Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "d")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact(q: DataFrame, p: DataFrame, k: int) -> DataFrame:
    return top(scores(q, p), k)


def score_pairs(pairs: DataFrame, q: DataFrame, p: DataFrame) -> DataFrame:
    """Exact scores of distinct candidate pairs (q, d), with the full query."""
    w = small(q.select("q", "c", F.col("v").alias("w")))
    return pairs.distinct().join(p, "d").join(w, ["q", "c"]).groupBy("q", "d").agg(F.sum(F.col("v") * F.col("w")).alias("score"))


def block_scores(q: DataFrame, sizes: DataFrame, summary: DataFrame, cut: int) -> DataFrame:
    """(q, c, b, n, s) for every block of each query's ``cut`` lists; a block without overlap scores 0."""
    lists = small(query_cut(q, cut).select("q", "c"))
    w = small(q.select("q", F.col("c").alias("c2"), F.col("v").alias("w")))
    overlap = summary.join(lists, "c").join(w, ["q", "c2"]).groupBy("q", "c", "b").agg(F.sum(F.col("v") * F.col("w")).alias("s"))
    return sizes.join(lists, "c").join(overlap, ["q", "c", "b"], "left").select("q", "c", "b", "n", F.coalesce("s", F.lit(0.0)).alias("s"))


def norms(q: DataFrame) -> DataFrame:
    return q.groupBy("q").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def seed_blocks(scored: DataFrame, k: int) -> DataFrame:
    """Each query's best blocks until they hold k postings."""
    w = Window.partitionBy("q").orderBy(F.desc(F.round("s", 9)), "c", "b").rowsBetween(Window.unboundedPreceding, -1)
    return scored.withColumn("_before", F.coalesce(F.sum("n").over(w), F.lit(0))).where(F.col("_before") < k).drop("_before")


def kth(scored: DataFrame, k: int) -> DataFrame:
    """(q, kth): the k-th best score, for queries that have k."""
    return top(scored, k).where(F.col("rank") == k).select("q", F.col("score").alias("kth"))


def surviving(scored: DataFrame, threshold: DataFrame, heap_factor: float, q: DataFrame | None = None, radii: DataFrame | None = None, alpha: float = 0.0, by_count: bool = False) -> DataFrame:
    """Blocks that may still beat ``heap_factor`` times the k-th score.

    The bound is the summary's score, plus ``alpha * |q| * radius`` if radii are given; ``by_count`` instead keeps
    the blocks before the 75 % mark of each list. Without a positive k-th score every block stays.
    """
    s = scored.join(small(threshold), "q", "left")
    if by_count:
        w = Window.partitionBy("q", "c")
        s = s.withColumn("_at", F.row_number().over(w.orderBy(F.desc(F.round("s", 9)), "b"))).withColumn("_n", F.count("*").over(w))
        return s.where(F.col("kth").isNull() | (F.col("_at") < F.floor(F.lit(0.75) * F.col("_n")))).select("q", "c", "b")
    bound = F.col("s")
    if radii is not None and alpha > 0:
        s = s.join(radii, ["c", "b"], "left").join(small(norms(q)), "q")
        bound = bound + alpha * F.col("norm") * F.coalesce("radius", F.lit(0.0))
    return s.where(F.col("kth").isNull() | (F.col("kth") <= 0) | (F.round(bound, 9) >= F.round(heap_factor * F.col("kth"), 9))).select("q", "c", "b")


def approximate(q: DataFrame, p: DataFrame, blocks: DataFrame, sizes: DataFrame, summary: DataFrame, k: int, cut: int, heap_factor: float, radii: DataFrame | None = None, alpha: float = 0.0, by_count: bool = False, summary_query: DataFrame | None = None) -> DataFrame:
    """Top-k in two phases: the best blocks give a first k-th score, which then drops blocks of the rest."""
    scored = block_scores(q, sizes, summary, cut) if summary_query is None else projected_block_scores(q, summary_query, sizes, summary, cut)
    scored = materialise(scored, "scored")  # both phases read them; the first phase's result is read three times
    seeds = seed_blocks(scored, k)
    first = materialise(score_pairs(seeds.join(blocks, ["c", "b"]).select("q", "d"), q, p), "first")
    more = surviving(scored, kth(first, k), heap_factor, q, radii, alpha, by_count).join(blocks, ["c", "b"]).select("q", "d")
    rest = score_pairs(more.distinct().join(first.select("q", "d"), ["q", "d"], "left_anti"), q, p)
    return top(first.unionByName(rest), k)


def projected_block_scores(q: DataFrame, projected: DataFrame, sizes: DataFrame, summary: DataFrame, cut: int) -> DataFrame:
    """Block scores of summaries and queries (q, c, v) in a projected space; lists are chosen in the original one."""
    lists = small(query_cut(q, cut).select("q", "c"))
    w = small(projected.select("q", F.col("c").alias("c2"), F.col("v").alias("w")))
    overlap = summary.join(lists, "c").join(w, ["q", "c2"]).groupBy("q", "c", "b").agg(F.sum(F.col("v") * F.col("w")).alias("s"))
    return sizes.join(lists, "c").join(overlap, ["q", "c", "b"], "left").select("q", "c", "b", "n", F.coalesce("s", F.lit(0.0)).alias("s"))


def sequential(q: DataFrame, p: DataFrame, blocks: DataFrame, summary: DataFrame, k: int, cut: int, heap_factor: float) -> DataFrame:
    """One query at a time with a carried heap, list by list and best block first; a test oracle for small data."""
    import heapq

    def rows(df: DataFrame, *names: str) -> list[tuple]:
        return [tuple(r[n] for n in names) for r in df.collect()]

    docs: dict = {}
    for d, c, v in rows(p, "d", "c", "v"):
        docs.setdefault(d, {})[c] = v
    members: dict = {}
    for c, b, d in rows(blocks, "c", "b", "d"):
        members.setdefault(c, {}).setdefault(b, []).append(d)
    tops: dict = {}
    for c, b, c2, v in rows(summary, "c", "b", "c2", "v"):
        tops.setdefault((c, b), {})[c2] = v
    asked: dict = {}
    for i, c, v in rows(q, "q", "c", "v"):
        asked.setdefault(i, {})[c] = v
    out = []
    for i, x in sorted(asked.items()):
        heap: list[tuple[float, int]] = []
        seen: set = set()
        for c, _ in sorted(x.items(), key=lambda t: (-t[1], t[0]))[:cut]:
            ranked = sorted(((sum(x.get(c2, 0.0) * v for c2, v in tops.get((c, b), {}).items()), b) for b in members.get(c, {})), key=lambda t: (-t[0], t[1]))
            for s, b in ranked:
                if len(heap) == k and s < heap_factor * heap[0][0]:
                    continue
                for d in sorted(set(members[c][b]) - seen):
                    seen.add(d)
                    entry = (sum(w * docs[d].get(c2, 0.0) for c2, w in x.items()), -d)
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
        out += [(i, -d, float(s), r + 1) for r, (s, d) in enumerate(sorted(heap, reverse=True))]
    return q.sparkSession.createDataFrame(out, "q bigint, d bigint, score double, rank int")
