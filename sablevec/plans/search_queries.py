"""Registered queries of the index and search operators, with DuckDB twins.

The corpus is the ``embeddings`` table with values over 0.1. Each search is registered twice: ``NAME_all`` asks the
whole query set, every vector whose id is divisible by 50; ``NAME`` asks the first 20 vectors, as its SQL twin says.
Parameters are those that make lists, blocks and cuts all take effect on it.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sablevec.operators import cluster, graph, index, metrics, order, projection, search, updates
from sablevec.plans.catalogue import register, registered
from sablevec.plans.corpora import asked_of, queries_of, signed_vectors, table, vectors, words
from sablevec.session import materialise

K, CUT, HF, PRUNE, SIZE, ENERGY, ALPHA, FRACTION, REPS, SEED = 10, 4, 0.9, 60, 10, 0.4, 0.15, 0.2, 6, 7

#: Named parts of the SQL twins; each uses those before it.
PARTS = {
    "e": "SELECT vec_id d, (generate_subscripts(embedding, 1) - 1)::INT c, unnest(embedding)::DOUBLE v FROM embeddings",
    "p": "SELECT * FROM e WHERE v > 0.1",
    "q": "SELECT d q, c, v FROM p WHERE d < 20",
    "qc": f"SELECT q, c, v FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY v DESC, c) r FROM q) WHERE r <= {CUT}",
    "sc": "SELECT q.q, p.d, sum(q.v * p.v) score FROM q JOIN p USING (c) GROUP BY ALL",
    "ex": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, d) rank FROM sc) WHERE rank <= {K}",
    "pr": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY v DESC, d) rk FROM p) WHERE rk <= {PRUNE}",
    "bl": f"SELECT c, ((rk - 1) // {SIZE})::INT b, d FROM pr",
    "bn": "SELECT c, b, count(*) n FROM bl GROUP BY ALL",
    "bt": "SELECT bl.c, bl.b, p.c c2, max(p.v) most, sum(p.v) total FROM bl JOIN p ON bl.d = p.d GROUP BY ALL",
    "mx": f"SELECT c, b, c2, most v FROM (SELECT *, sum(most) OVER (PARTITION BY c, b ORDER BY most DESC, c2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) a, sum(most) OVER (PARTITION BY c, b) t FROM bt) WHERE round(coalesce(a, 0) / t, 9) <= {ENERGY}",
    "mn": f"SELECT c, b, c2, total / n v FROM (SELECT *, sum(total) OVER (PARTITION BY c, b ORDER BY total DESC, c2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) a, sum(total) OVER (PARTITION BY c, b) t FROM bt) JOIN bn USING (c, b) WHERE round(coalesce(a, 0) / t, 9) <= {ENERGY}",
    "nm": "SELECT c, b, sum(v * v) norm FROM mn GROUP BY ALL",
    "rd": "SELECT c, b, max(sqrt(greatest(0, norm + t))) radius FROM (SELECT bl.c, bl.b, bl.d, sum(p.v * p.v - 2 * p.v * coalesce(mn.v, 0)) t FROM bl JOIN p ON bl.d = p.d LEFT JOIN mn ON mn.c = bl.c AND mn.b = bl.b AND mn.c2 = p.c GROUP BY ALL) JOIN nm USING (c, b) GROUP BY ALL",
    "qt": "SELECT *, floor(least(255, greatest(0, (v - minimum) / quant)))::INT code FROM (SELECT *, min(v) OVER (PARTITION BY c, b) minimum, CASE WHEN max(v) OVER (PARTITION BY c, b) > min(v) OVER (PARTITION BY c, b) THEN (max(v) OVER (PARTITION BY c, b) - min(v) OVER (PARTITION BY c, b)) / 256 ELSE 1 END quant FROM mx)",
    "dq": "SELECT c, b, c2, code * quant + minimum v FROM qt",
}


def sql(body: str, *more: tuple[str, str]) -> str:
    """``body`` with the parts it needs in front."""
    parts = {**PARTS, **dict(more)}
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in parts.items()) + f" {body}"


def _scores_of(summary: str) -> str:
    return f"SELECT qc.q, bn.c, bn.b, bn.n, coalesce(sum(q.v * s.v), 0) s FROM qc JOIN bn USING (c) LEFT JOIN {summary} s ON s.c = bn.c AND s.b = bn.b LEFT JOIN q ON q.q = qc.q AND q.c = s.c2 GROUP BY ALL"


def ann_parts(summary: str, keep: str, p: str = "p", bl: str = "bl") -> list[tuple[str, str]]:
    """The two-phase plan; ``keep`` tests a block by s, kth, radius, norm, place and all_."""
    exact = f"SELECT x.q, x.d, sum(q.v * {p}.v) score FROM (SELECT DISTINCT q, d FROM {{0}}) x JOIN {p} ON {p}.d = x.d JOIN q ON q.q = x.q AND q.c = {p}.c GROUP BY ALL"
    return [
        ("bs", _scores_of(summary)),
        ("sd", f"SELECT q, {bl}.d FROM (SELECT * FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY q ORDER BY round(s, 9) DESC, c, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) f FROM bs) WHERE f < {K}) JOIN {bl} USING (c, b)"),
        ("f1", exact.format("sd")),
        ("kt", f"SELECT q, score kth FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, d) r FROM f1) WHERE r = {K}"),
        ("nq", "SELECT q, sqrt(sum(v * v)) norm FROM q GROUP BY ALL"),
        ("sv", f"SELECT q, c, b FROM (SELECT bs.*, kth, radius, norm, row_number() OVER (PARTITION BY bs.q, bs.c ORDER BY round(s, 9) DESC, bs.b) place, count(*) OVER (PARTITION BY bs.q, bs.c) all_ FROM bs LEFT JOIN kt USING (q) LEFT JOIN rd USING (c, b) JOIN nq USING (q)) WHERE kth IS NULL OR {keep}"),
        ("cd", f"SELECT q, d FROM sd UNION SELECT q, {bl}.d FROM sv JOIN {bl} USING (c, b)"),
        ("f2", exact.format("cd")),
        ("an", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, d) rank FROM f2) WHERE rank <= {K}"),
    ]


RESULT = "SELECT q, d, round(score, 6) score, rank::INT rank FROM "
PLAIN = f"(kth <= 0 OR round(s, 9) >= round({HF} * kth, 9))"


def result(df: DataFrame) -> DataFrame:
    return df.select("q", "d", F.round("score", 6).alias("score"), "rank")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in names else c for c in df.columns])


class Built:
    """The index parts of the test corpus."""

    def __init__(self, spark: SparkSession, sf_dir: str, ask=queries_of):
        self.p = vectors(spark, sf_dir)
        self.q = ask(self.p)
        self.pruned = index.prune_fixed(self.p, PRUNE)
        self.blocks = index.block_chunks(self.pruned, SIZE)
        self.sizes = index.block_sizes(self.blocks)

    def most(self) -> DataFrame:
        return index.summarise(self.blocks, self.p, "max", ENERGY)

    def mean(self) -> DataFrame:
        return index.summarise(self.blocks, self.p, "mean", ENERGY)

    def approximate(self, summary: DataFrame, **more) -> DataFrame:
        return search.approximate(self.q, self.p, self.blocks, self.sizes, summary, K, CUT, HF, **more)


# scalars, vectors, statistics


@register("sv_stats", sql("SELECT count(DISTINCT d) n_vectors, max(c) + 1 dim, count(*) nnz, round(count(*) / count(DISTINCT d), 6) mean_nnz FROM p"))
def sv_stats(spark, sf_dir):
    return vectors(spark, sf_dir).agg(F.countDistinct("d").alias("n_vectors"), (F.max("c") + 1).alias("dim"), F.count("*").alias("nnz"), F.round(F.count("*") / F.countDistinct("d"), 6).alias("mean_nnz"))


@register("sv_validate", sql("SELECT d, count(*) n, count(*) = count(DISTINCT c) strict, true sorted, count(*) > 0 filled FROM p GROUP BY d"))
def sv_validate(spark, sf_dir):
    from sablevec.functions.vectors import is_sorted, is_strict

    f = index.fold(vectors(spark, sf_dir))
    return f.select(F.col("doc_id").alias("d"), F.size("components").cast("bigint").alias("n"), is_strict("components").alias("strict"), is_sorted("components").alias("sorted"), (F.size("components") == F.size("values")).alias("filled"))


@register("sv_offsets", sql("SELECT d, n, coalesce(sum(n) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_ FROM (SELECT d, count(*) n FROM p GROUP BY d)"))
def sv_offsets(spark, sf_dir):
    n = vectors(spark, sf_dir).groupBy("d").agg(F.count("*").alias("n"))
    return order.running_sum(n, "d", "n", "offset_")


@register("pack_unpack", sql("SELECT d, packed, packed >> 16 offset_, packed & 65535 n FROM (SELECT d, (coalesce(sum(n) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT << 16) | n packed FROM (SELECT d, count(*) n FROM p GROUP BY d))"))
def pack_unpack(spark, sf_dir):
    from sablevec.functions.vectors import pack, packed_length, packed_offset

    return sv_offsets(spark, sf_dir).select("d", pack("offset_", "n").alias("packed")).select("d", "packed", packed_offset("packed").alias("offset_"), packed_length("packed").alias("n"))


@register("dot_pairwise", sql("SELECT a.d x, b.d y, round(sum(a.v * b.v), 6) dot FROM p a JOIN p b USING (c) WHERE a.d < 20 AND b.d < 20 AND a.d < b.d GROUP BY ALL"))
def dot_pairwise(spark, sf_dir):
    few = vectors(spark, sf_dir).where("d < 20")
    s = search.scores(few.withColumnRenamed("d", "q"), few).where("q < d")
    return s.select(F.col("q").alias("x"), F.col("d").alias("y"), F.round("score", 6).alias("dot"))


@register("dot_query_doc", sql("SELECT q, d, round(score, 6) score FROM sc"))
def dot_query_doc(spark, sf_dir, ask=queries_of):
    p = vectors(spark, sf_dir)
    return rounded(search.scores(ask(p), p), "score")


@register("l2_norm", sql("SELECT d, round(sqrt(sum(v * v)), 6) norm FROM p GROUP BY d"))
def l2_norm(spark, sf_dir):
    from sablevec.functions.vectors import norm

    return index.fold(vectors(spark, sf_dir)).select(F.col("doc_id").alias("d"), F.round(norm("values"), 6).alias("norm"))


@register("residual_norm", sql("SELECT x.d x, x.d + 1 y, round(sqrt(sum(pow(coalesce(a.v, 0) - coalesce(b.v, 0), 2))), 6) dist FROM (SELECT DISTINCT d FROM p WHERE d < 50) x CROSS JOIN (SELECT DISTINCT c FROM p) k LEFT JOIN p a ON a.d = x.d AND a.c = k.c LEFT JOIN p b ON b.d = x.d + 1 AND b.c = k.c GROUP BY ALL"))
def residual_norm(spark, sf_dir):
    p = vectors(spark, sf_dir)
    pairs = p.where("d < 50").select(F.col("d").alias("x")).distinct().withColumn("y", F.col("x") + 1)
    return rounded(projection.distances(p, pairs), "dist")


@register("euclidean_pairs", sql("SELECT a.d x, b.d y, round(sqrt(sum(pow(a.v - b.v, 2))), 6) dist FROM e a JOIN e b USING (c) WHERE a.d < 20 AND b.d < 20 AND a.d < b.d GROUP BY ALL"))
def euclidean_pairs(spark, sf_dir):
    few = signed_vectors(spark, sf_dir).where("d < 20")
    pairs = few.select(F.col("d").alias("x")).distinct().join(few.select(F.col("d").alias("y")).distinct(), F.col("x") < F.col("y"))
    return rounded(projection.distances(few, pairs), "dist")


@register("densify", sql("SELECT x.d, k.c, coalesce(p.v, 0) v FROM (SELECT DISTINCT d FROM p WHERE d < 50) x CROSS JOIN (SELECT range::INT c FROM range(64)) k LEFT JOIN p ON p.d = x.d AND p.c = k.c"))
def densify(spark, sf_dir):
    from sablevec.functions.vectors import dense

    f = index.fold(vectors(spark, sf_dir).where("d < 50"))
    return f.select(F.col("doc_id").alias("d"), F.posexplode(dense("components", "values", 64)).alias("c", "v"))


@register("quantize_u8", sql("SELECT c, b, c2, code, round(minimum, 6) minimum, round(quant, 9) quant FROM qt"))
def quantize_u8(spark, sf_dir):
    return index.quantise(Built(spark, sf_dir).most()).select("c", "b", "c2", "code", F.round("minimum", 6).alias("minimum"), F.round("quant", 9).alias("quant"))


@register("dequantize", sql("SELECT c, b, c2, round(v, 6) v FROM dq"))
def dequantize(spark, sf_dir):
    return rounded(index.dequantise(index.quantise(Built(spark, sf_dir).most())), "v")


@register("quantized_block_scores", sql("SELECT q, c, b, n, round(s, 6) s FROM bs", ("bs", _scores_of("dq"))))
def quantized_block_scores(spark, sf_dir, ask=queries_of):
    x = Built(spark, sf_dir, ask)
    return rounded(search.block_scores(x.q, x.sizes, index.dequantise(index.quantise(x.most())), CUT), "s")


@register("elias_fano_select", sql("SELECT k, l[k::INT + 1] AS select_value FROM (SELECT list(d ORDER BY d) l FROM (SELECT DISTINCT d FROM p)), (SELECT unnest([0, 5, 50, 100000])::BIGINT k)"))
def elias_fano_select(spark, sf_dir):
    n = order.numbered(vectors(spark, sf_dir).select("d").distinct(), "d", "r")
    k = spark.createDataFrame([(0,), (5,), (50,), (100000,)], "k bigint")
    return k.join(n, F.col("k") == F.col("r"), "left").select("k", F.col("d").alias("select_value"))


@register("bits_needed", sql("SELECT count(DISTINCT d) n, ceil(log2(count(DISTINCT d)))::INT bits FROM p"))
def bits_needed(spark, sf_dir):
    n = F.countDistinct("d")
    return vectors(spark, sf_dir).agg(n.alias("n"), F.ceil(F.log2(n)).cast("int").alias("bits"))


#: Term frequencies of the documents.
TERMS = "SELECT doc_id d, token, count(*)::DOUBLE v FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) token FROM documents) WHERE token <> '' GROUP BY ALL"
VOCAB = "SELECT token, (row_number() OVER (ORDER BY d, token) - 1)::BIGINT id FROM (SELECT token, min(d) d FROM w GROUP BY token)"


def vocabulary(w: DataFrame) -> DataFrame:
    """Ids by first document, then token, dense from 0: counted by document first, so no task orders all tokens."""
    first = w.groupBy("token").agg(F.min("d").alias("d"))
    per = first.groupBy("d").agg(F.count("*").alias("n"))
    before = order.running_sum(per, "d", "n").select("d", "before")
    rank = F.row_number().over(Window.partitionBy("d").orderBy("token"))
    return first.withColumn("r", rank).join(before, "d").select("token", (F.col("before") + F.col("r") - 1).cast("bigint").alias("id"))


@register("vocab_build", sql("SELECT token, id FROM vo", ("w", TERMS), ("vo", VOCAB)))
def vocab_build(spark, sf_dir):
    return vocabulary(words(spark, sf_dir))


BENCH = "SELECT item_id q, token, count(*)::DOUBLE v FROM (SELECT item_id, unnest(string_split_regex(lower(text), '[^a-z]+')) token FROM benchmark) WHERE token <> '' GROUP BY ALL"


@register("token_lookup", sql("SELECT q, id, b.v FROM bq b JOIN vo USING (token)", ("w", TERMS), ("vo", VOCAB), ("bq", BENCH)))
def token_lookup(spark, sf_dir):
    b = words(spark, sf_dir, "benchmark", "item_id").withColumnRenamed("d", "q")
    return b.join(vocabulary(words(spark, sf_dir)), "token").select("q", "id", "v")


@register("docname_remap", "SELECT vec_id d, coalesce(source || '-' || doc_id::VARCHAR, vec_id::VARCHAR) AS name FROM embeddings LEFT JOIN (SELECT * FROM documents WHERE doc_id % 2 = 0) ON doc_id = vec_id")
def docname_remap(spark, sf_dir):
    names = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id", F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("name"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("d"))
    return e.join(names, F.col("d") == F.col("doc_id"), "left").select("d", F.coalesce("name", F.col("d").cast("string")).alias("name"))


SIGNED = [("qs", "SELECT d q, c, v FROM e WHERE d < 20"), ("ss", "SELECT qs.q, e.d, sum(qs.v * e.v) score FROM qs JOIN e USING (c) GROUP BY ALL")]


@register("score_abs", sql("SELECT q, d, round(abs(score), 6) score FROM ss", *SIGNED))
def score_abs(spark, sf_dir, ask=queries_of):
    e = signed_vectors(spark, sf_dir)
    return search.scores(ask(e), e).select("q", "d", F.round(F.abs("score"), 6).alias("score"))


# filters and set operations


@register("alive_filter", sql("SELECT d, c, v FROM p WHERE d % 7 <> 3"))
def alive_filter(spark, sf_dir):
    p = vectors(spark, sf_dir)
    return updates.alive(p, p.where("d % 7 = 3").select("d").distinct())


@register("visited_dedup", sql("SELECT DISTINCT q, bl.d FROM qc JOIN bl USING (c)"))
def visited_dedup(spark, sf_dir, ask=queries_of):
    x = Built(spark, sf_dir, ask)
    return search.query_cut(x.q, CUT).select("q", "c").join(x.blocks, "c").select("q", "d").distinct()


@register("list_intersection", sql("SELECT a.c x, b.c y, count(*) n FROM p a JOIN p b USING (d) WHERE a.c < 8 AND b.c < 8 AND a.c < b.c GROUP BY ALL"))
def list_intersection(spark, sf_dir):
    p = vectors(spark, sf_dir).where("c < 8")
    return p.select("d", F.col("c").alias("x")).join(p.select("d", F.col("c").alias("y")), "d").where("x < y").groupBy("x", "y").agg(F.count("*").alias("n"))


@register("set_intersection", sql("SELECT a.q, count(*) n FROM ex a JOIN (SELECT d q, c FROM p) b ON a.q = b.q AND a.d = b.c GROUP BY ALL"))
def set_intersection(spark, sf_dir, ask=queries_of):
    p = vectors(spark, sf_dir)
    ex = search.exact(ask(p), p, K).groupBy("q").agg(F.collect_set("d").alias("a"))
    own = p.groupBy("d").agg(F.collect_set(F.col("c").cast("bigint")).alias("b"))
    return ex.join(own, ex.q == own.d).select("q", F.size(F.array_intersect("a", "b")).cast("bigint").alias("n")).where("n > 0")


@register("union_candidates", sql("SELECT q, d FROM ex UNION SELECT q, d FROM (SELECT DISTINCT q, bl.d FROM qc JOIN bl USING (c) WHERE b = 0)"))
def union_candidates(spark, sf_dir, ask=queries_of):
    x = Built(spark, sf_dir, ask)
    first = search.query_cut(x.q, CUT).select("q", "c").join(x.blocks.where("b = 0"), "c").select("q", "d")
    return search.exact(x.q, x.p, K).select("q", "d").union(first).distinct()


@register("except_visited", sql("SELECT DISTINCT q, bl.d FROM qc JOIN bl USING (c) EXCEPT SELECT q, d FROM ex"))
def except_visited(spark, sf_dir, ask=queries_of):
    x = Built(spark, sf_dir, ask)
    return visited_dedup(spark, sf_dir, ask).join(search.exact(x.q, x.p, K).select("q", "d"), ["q", "d"], "left_anti")


@register("param_grid", "SELECT cut::INT cut, hf::DOUBLE hf FROM (SELECT unnest([3, 4, 5, 8]) cut), (SELECT unnest([0.7, 0.8, 0.9]) hf)")
def param_grid(spark, sf_dir):
    return spark.createDataFrame([(3,), (4,), (5,), (8,)], "cut int").crossJoin(spark.createDataFrame([(0.7,), (0.8,), (0.9,)], "hf double"))


@register("stride_sample", sql("SELECT d, c, v FROM p WHERE c % 5 = 0"))
def stride_sample(spark, sf_dir):
    return vectors(spark, sf_dir).where("c % 5 = 0")


# inversion, pruning, blocking


@register("invert_postings", sql("SELECT c, d, v FROM p"))
def invert_postings(spark, sf_dir):
    return index.invert(index.fold(vectors(spark, sf_dir))).select("c", "d", "v")


@register("posting_counts", sql("SELECT c, count(*) n, round(max(v), 6) most FROM p GROUP BY c"))
def posting_counts(spark, sf_dir):
    return vectors(spark, sf_dir).groupBy("c").agg(F.count("*").alias("n"), F.round(F.max("v"), 6).alias("most"))


@register("query_cut", sql("SELECT q, c, v FROM qc"))
def query_cut(spark, sf_dir, ask=queries_of):
    return search.query_cut(ask(vectors(spark, sf_dir)), CUT)


@register("doc_cut", sql("SELECT d, c, v FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY v DESC, c) r FROM p) WHERE r <= 5"))
def doc_cut(spark, sf_dir):
    return index.top_components(vectors(spark, sf_dir), "d", 5)


@register("fixed_pruning", sql("SELECT c, d, v, rk::INT rk FROM pr"))
def fixed_pruning(spark, sf_dir):
    return Built(spark, sf_dir).pruned.select("c", "d", "v", "rk")


GLOBAL = [
    ("gn", "SELECT (max(c) + 1) * 40 most, count(*) m FROM p"),
    ("gr", "SELECT *, row_number() OVER (ORDER BY v DESC, d, c) r FROM p"),
    ("gt", "SELECT v th FROM gr, gn WHERE r = least(most, m - 1) + 1"),
    ("gk", "SELECT d, c, v FROM (SELECT gr.*, least(most, m - 1) t, most, th, count(*) FILTER (WHERE v = th AND r > least(most, m - 1)) OVER (ORDER BY r) x FROM gr, gn, gt) WHERE r <= t OR (v = th AND x <= 10 * most // 100)"),
]


@register("global_threshold_pruning", sql("SELECT c, d, v, rk::INT rk FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY v DESC, d) rk FROM gk) WHERE rk <= 60", *GLOBAL))
def global_threshold_pruning(spark, sf_dir):
    return index.prune_global(vectors(spark, sf_dir), 40).select("c", "d", "v", "rk")


@register("blocking_chunks", sql("SELECT c, b, d FROM bl"))
def blocking_chunks(spark, sf_dir):
    return Built(spark, sf_dir).blocks


@register("blocking_roundrobin", sql(f"SELECT c, ((rk - 1) % greatest(floor({FRACTION} * n), 1))::INT b, d FROM pr JOIN (SELECT c, count(*) n FROM pr GROUP BY c) USING (c)"))
def blocking_roundrobin(spark, sf_dir):
    return index.block_round_robin(Built(spark, sf_dir).pruned, FRACTION)


REPRESENTATIVES = [
    ("rp", f"SELECT c, j, d r FROM (SELECT c, d, row_number() OVER (PARTITION BY c ORDER BY md5(concat_ws(':', '{SEED}', c::VARCHAR, d::VARCHAR)), d) - 1 j FROM pr) WHERE j < {REPS}"),
    ("rs", "SELECT pr.c, pr.d, rp.j, sum(a.v * b.v) s FROM pr JOIN rp USING (c) JOIN p a ON a.d = pr.d JOIN p b ON b.d = rp.r AND b.c = a.c GROUP BY ALL"),
    ("rb", "SELECT c, (dense_rank() OVER (PARTITION BY c ORDER BY j) - 1)::INT b, d FROM (SELECT *, row_number() OVER (PARTITION BY c, d ORDER BY round(s, 9) DESC, j) r FROM rs) WHERE r = 1"),
]


@register("blocking_representatives", sql("SELECT c, b, d FROM rb", *REPRESENTATIVES))
def blocking_representatives(spark, sf_dir):
    x = Built(spark, sf_dir)
    return index.block_representatives(x.pruned, x.p, REPS, SEED)


def kmeans_sql(how: str) -> str:
    """One-pass k-means: sampled centroids, assignment, small clusters dissolved, second assignment."""
    n, least, cut, per = 12, 20, 5, 5
    probe = f"SELECT d, c, v FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY v DESC, c) r FROM p) WHERE r <= {cut}"

    def assign(at: str, cents: str) -> list[tuple[str, str]]:
        allowed = ""
        parts = [(f"{at}c", f"SELECT k.j, k.r, p.c, p.v FROM {cents} k JOIN p ON p.d = k.r")]
        if how == "pruned":
            parts += [(f"{at}i", f"SELECT j, c FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY v DESC, j) k FROM {at}c) WHERE k <= {per}"), (f"{at}a", f"SELECT DISTINCT d, j FROM pb JOIN {at}i USING (c)")]
            allowed = f" JOIN {at}a USING (d, j)"
        source = "pb" if how == "approx" else "p"
        own = f"(SELECT r, j FROM {cents})" if how != "approx" else "(SELECT NULL::BIGINT r, NULL::BIGINT j WHERE false)"
        return [
            *parts,
            (f"{at}s", f"SELECT x.d, x.j, x.s FROM (SELECT a.d, k.j, sum(a.v * k.v) s FROM {source} a JOIN {at}c k ON k.c = a.c GROUP BY ALL) x{allowed}"),
            (f"{at}b", f"SELECT d, j FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY round(s, 9) DESC, j) r FROM {at}s) WHERE r = 1"),
            (f"{at}o", f"SELECT x.d, coalesce(o.j, b.j, (SELECT min(j) FROM {cents})) j FROM (SELECT DISTINCT d FROM p) x LEFT JOIN {at}b b ON b.d = x.d LEFT JOIN {own} o ON o.r = x.d"),
        ]

    return sql(
        f"SELECT d, j FROM m1o SEMI JOIN kp USING (j) UNION ALL SELECT d, j FROM m2o ANTI JOIN (SELECT d FROM m1o SEMI JOIN kp USING (j)) USING (d)",
        ("pb", probe),
        ("km", f"SELECT (row_number() OVER (ORDER BY md5(concat_ws(':', '{SEED}', d::VARCHAR)), d) - 1) j, d r FROM (SELECT DISTINCT d FROM p) QUALIFY j < {n}"),
        *assign("m1", "km"),
        ("kp", f"SELECT j FROM (SELECT j, count(*) n, row_number() OVER (ORDER BY count(*) DESC, j) r FROM m1o GROUP BY j) WHERE n > {least} OR r = 1"),
        ("k2", "SELECT km.* FROM km SEMI JOIN kp USING (j)"),
        *assign("m2", "k2"),
    )


def _kmeans(how: str):
    def run(spark, sf_dir):
        return cluster.kmeans(vectors(spark, sf_dir), 12, 20, how, SEED, doc_cut=5).select("d", F.col("j").cast("bigint").alias("j"))

    return run


for _name, _how in (("kmeans_exact", "exact"), ("kmeans_pruned_ii", "pruned"), ("kmeans_approx", "approx")):
    register(_name, kmeans_sql(_how))(_kmeans(_how))


# summaries and search


@register("block_max", sql("SELECT c, b, c2, round(most, 6) v FROM bt"))
def block_max(spark, sf_dir):
    x = Built(spark, sf_dir)
    return rounded(index.summarise(x.blocks, x.p, "max"), "v")


@register("block_mean", sql("SELECT c, b, c2, round(total / n, 6) v FROM bt JOIN bn USING (c, b)"))
def block_mean(spark, sf_dir):
    x = Built(spark, sf_dir)
    return rounded(index.summarise(x.blocks, x.p, "mean"), "v")


@register("summary_max_energy", sql("SELECT c, b, c2, round(v, 6) v FROM mx"))
def summary_max_energy(spark, sf_dir):
    return rounded(Built(spark, sf_dir).most(), "v")


@register("summary_mean_energy", sql("SELECT c, b, c2, round(v, 6) v FROM mn"))
def summary_mean_energy(spark, sf_dir):
    return rounded(Built(spark, sf_dir).mean(), "v")


@register("summary_fixed", sql("SELECT c, b, c2, round(most, 6) v FROM (SELECT *, row_number() OVER (PARTITION BY c, b ORDER BY most DESC, c2) r FROM bt) WHERE r <= 5"))
def summary_fixed(spark, sf_dir):
    x = Built(spark, sf_dir)
    return rounded(index.summarise(x.blocks, x.p, "max", components=5), "v")


@register("summary_mean_fixed", sql("SELECT c, b, c2, round(total / n, 6) v FROM (SELECT *, row_number() OVER (PARTITION BY c, b ORDER BY total DESC, c2) r FROM bt) JOIN bn USING (c, b) WHERE r <= 5"))
def summary_mean_fixed(spark, sf_dir):
    x = Built(spark, sf_dir)
    return rounded(index.summarise(x.blocks, x.p, "mean", components=5), "v")


@register("block_radius", sql("SELECT c, b, round(radius, 6) radius FROM rd"))
def block_radius(spark, sf_dir):
    x = Built(spark, sf_dir)
    return rounded(index.radius(x.blocks, x.mean(), x.p), "radius")


@register("block_scores", sql("SELECT q, c, b, n, round(s, 6) s FROM bs", ("bs", _scores_of("mx"))))
def block_scores(spark, sf_dir, ask=queries_of):
    x = Built(spark, sf_dir, ask)
    return rounded(search.block_scores(x.q, x.sizes, x.most(), CUT), "s")


@register("block_membership", sql("SELECT d, count(*) n_blocks, count(DISTINCT c) n_lists FROM bl GROUP BY d"))
def block_membership(spark, sf_dir):
    return Built(spark, sf_dir).blocks.groupBy("d").agg(F.count("*").alias("n_blocks"), F.countDistinct("c").alias("n_lists"))


@register("exact_topk", sql(RESULT + "ex"))
def exact_topk(spark, sf_dir, ask=queries_of):
    p = vectors(spark, sf_dir)
    return result(search.exact(ask(p), p, K))


@register("exact_topk_signed", sql(RESULT + f"(SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, d) rank FROM ss) WHERE rank <= {K}", *SIGNED))
def exact_topk_signed(spark, sf_dir, ask=queries_of):
    e = signed_vectors(spark, sf_dir)
    return result(search.exact(ask(e), e, K))


def _survivors(summary: str, **how):
    def run(spark, sf_dir, ask=queries_of):
        x = Built(spark, sf_dir, ask)
        s = x.most() if summary == "max" else x.mean()
        scored = search.block_scores(x.q, x.sizes, s, CUT)
        first = search.score_pairs(search.seed_blocks(scored, K).join(x.blocks, ["c", "b"]).select("q", "d"), x.q, x.p)
        more = {k: (index.radius(x.blocks, s, x.p) if k == "radii" else v) for k, v in how.items()}
        return search.surviving(scored, search.kth(first, K), HF, x.q, **more)

    return run


COUNT, WIDE = "place < floor(0.75 * all_)", f"(kth <= 0 OR round(s + {ALPHA} * norm * coalesce(radius, 0), 9) >= round({HF} * kth, 9))"
register("skip_max_threshold", sql("SELECT q, c, b FROM sv", *ann_parts("mx", PLAIN)))(_survivors("max"))
register("skip_centroid_count", sql("SELECT q, c, b FROM sv", *ann_parts("mn", COUNT)))(_survivors("mean", by_count=True))
register("skip_centroid_alpha", sql("SELECT q, c, b FROM sv", *ann_parts("mn", WIDE)))(_survivors("mean", radii=True, alpha=ALPHA))


@register("ann_search_max", sql(RESULT + "an", *ann_parts("mx", PLAIN)))
def ann_search_max(spark, sf_dir, ask=queries_of):
    x = Built(spark, sf_dir, ask)
    return result(x.approximate(x.most()))


@register("ann_search_centroid_count", sql(RESULT + "an", *ann_parts("mn", COUNT)))
def ann_search_centroid_count(spark, sf_dir, ask=queries_of):
    x = Built(spark, sf_dir, ask)
    return result(x.approximate(x.mean(), by_count=True))


@register("ann_search_centroid_alpha", sql(RESULT + "an", *ann_parts("mn", WIDE)))
def ann_search_centroid_alpha(spark, sf_dir, ask=queries_of):
    x = Built(spark, sf_dir, ask)
    s = x.mean()
    return result(x.approximate(s, radii=index.radius(x.blocks, s, x.p), alpha=ALPHA))


@register("ann_search_quantized", sql(RESULT + "an", *ann_parts("dq", PLAIN)))
def ann_search_quantized(spark, sf_dir, ask=queries_of):
    x = Built(spark, sf_dir, ask)
    return result(x.approximate(index.dequantise(index.quantise(x.most()))))


@register("token_search", sql(RESULT + f"(SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, d) rank FROM (SELECT b.q, w.d, sum(b.v * w.v) score FROM bq b JOIN w USING (token) GROUP BY ALL)) WHERE rank <= {K}", ("w", TERMS), ("bq", BENCH)))
def token_search(spark, sf_dir):
    w = words(spark, sf_dir)
    b = words(spark, sf_dir, "benchmark", "item_id").select(F.col("d").alias("q"), "token", F.col("v").alias("x"))
    s = w.join(search.small(b), "token").groupBy("q", "d").agg(F.sum(F.col("v") * F.col("x")).alias("score"))
    return result(search.top(s, K))


@register("batch_search", sql("SELECT q, count(*) n, round(max(score), 6) best, count(*) >= 10 AS filled FROM an GROUP BY q", *ann_parts("mx", PLAIN)))
def batch_search(spark, sf_dir, ask=queries_of):
    x = Built(spark, sf_dir, ask)
    return x.approximate(x.most()).groupBy("q").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"), (F.count("*") >= K).alias("filled"))


@register("result_ranks", sql("SELECT q, list(d ORDER BY rank)[1] first, list(d ORDER BY rank)[10] last FROM ex GROUP BY q"))
def result_ranks(spark, sf_dir, ask=queries_of):
    p = vectors(spark, sf_dir)
    at = F.col("rank")
    return search.exact(ask(p), p, K).groupBy("q").agg(F.max(F.when(at == 1, F.col("d"))).alias("first"), F.max(F.when(at == K, F.col("d"))).alias("last"))


# graph

KNN = [("ks", "SELECT a.d q, b.d, sum(a.v * b.v) score FROM p a JOIN p b ON a.c = b.c AND a.d <> b.d GROUP BY ALL"), ("kn", "SELECT q d, d nbr, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, d) rank FROM ks) WHERE rank <= 5")]


@register("knn_build", sql("SELECT d, rank::INT rank, nbr, round(score, 6) score FROM kn", *KNN))
def knn_build(spark, sf_dir):
    return rounded(graph.build(vectors(spark, sf_dir), 5), "score")


@register("knn_limit", sql("SELECT d, rank::INT rank, nbr FROM kn WHERE rank <= 2", *KNN))
def knn_limit(spark, sf_dir):
    return graph.limit(graph.build(vectors(spark, sf_dir), 5), 2).select("d", "rank", "nbr")


REFINE = [
    ("kf", "SELECT DISTINCT an.q, kn.nbr d FROM an JOIN kn ON kn.d = an.d WHERE kn.rank <= 3"),
    ("ka", "SELECT q, d, score FROM an UNION ALL SELECT kf.q, kf.d, sum(q.v * p.v) score FROM kf ANTI JOIN an ON an.q = kf.q AND an.d = kf.d JOIN p ON p.d = kf.d JOIN q ON q.q = kf.q AND q.c = p.c GROUP BY ALL"),
]


@register("knn_refine", sql(RESULT + f"(SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, d) rank FROM ka) WHERE rank <= {K}", *ann_parts("mx", PLAIN), *KNN, *REFINE))
def knn_refine(spark, sf_dir, ask=queries_of):
    x = Built(spark, sf_dir, ask)
    found = materialise(x.approximate(x.most()), "found")
    knn = graph.build(x.p, 5, found.select("d").distinct())  # no other document's neighbours are looked up
    return result(graph.refine(found, x.q, x.p, knn, 3, K))


# updates: documents with d % 25 = 0 come later, those with d % 7 = 3 go

OLD = {"p0": "SELECT * FROM p WHERE d % 25 <> 0", "nw": "SELECT * FROM p WHERE d % 25 = 0"}


class Updated:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.p = vectors(spark, sf_dir)
        self.old, self.new = self.p.where("d % 25 <> 0"), self.p.where("d % 25 = 0")
        self.blocks = index.block_chunks(index.prune_fixed(self.old, PRUNE), SIZE)
        self.sizes = index.block_sizes(self.blocks)
        self.gone = self.old.where("d % 7 = 3").select("d").distinct()
        self.removed = self.blocks.join(self.gone, "d", "left_semi").select("c", "b", "d")

    def summary(self, kind: str, energy: float | None = ENERGY) -> DataFrame:
        return index.summarise(self.blocks, self.old, kind, energy)


def update_sql(body: str, summary: str = "mx") -> str:
    """The parts over the first documents, then routing and deltas."""
    swap = {k: v.replace(" p ", " p0 ").replace("FROM p)", "FROM p0)").replace("JOIN p ", "JOIN p0 p ").replace("JOIN p0 p ON", "JOIN p0 p ON") for k, v in PARTS.items() if k in ("pr", "bl", "bn", "bt", "mx", "mn", "nm", "rd")}
    swap = {k: v.replace("JOIN p0 ON bl.d = p.d", "JOIN p0 p ON bl.d = p.d") for k, v in swap.items()}
    base = {k: PARTS[k] for k in ("e", "p")} | OLD | swap
    base |= {
        "ro": f"SELECT c, coalesce(b, 0)::INT b, d FROM (SELECT x.d, x.c, y.b, row_number() OVER (PARTITION BY x.d, x.c ORDER BY round(coalesce(y.s, 0), 9) DESC, y.b) r FROM nw x LEFT JOIN (SELECT n.d, bn.c, bn.b, coalesce(sum(z.v * s.v), 0) s FROM nw n JOIN bn ON bn.c = n.c LEFT JOIN {summary} s ON s.c = bn.c AND s.b = bn.b LEFT JOIN nw z ON z.d = n.d AND z.c = s.c2 GROUP BY ALL) y ON y.d = x.d AND y.c = x.c) WHERE r = 1",
        "gn": "SELECT c, b, d FROM bl WHERE d % 7 = 3",
        "dl": "SELECT ro.c, ro.b, p.c c2, max(p.v) x_max, sum(p.v) x_sum FROM ro JOIN p ON p.d = ro.d GROUP BY ALL",
        "dm": "SELECT c, b, count(*) m FROM ro GROUP BY ALL",
        "gl": "SELECT gn.c, gn.b, p.c c2, sum(p.v) x_sum FROM gn JOIN p ON p.d = gn.d GROUP BY ALL",
        "gm": "SELECT c, b, count(*) m FROM gn GROUP BY ALL",
        "im": "SELECT c, b, c2, (coalesce(v, 0) * coalesce(n, 0) + coalesce(x_sum, 0)) / (coalesce(n, 0) + coalesce(m, 0)) v FROM (SELECT coalesce(mn.c, dl.c) c, coalesce(mn.b, dl.b) b, coalesce(mn.c2, dl.c2) c2, mn.v, x_sum FROM mn FULL JOIN dl ON mn.c = dl.c AND mn.b = dl.b AND mn.c2 = dl.c2) LEFT JOIN bn USING (c, b) LEFT JOIN dm USING (c, b)",
    }
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in base.items()) + f" {body}"


@register("insert_doc_block_choice", update_sql("SELECT c, b, d FROM ro"))
def insert_doc_block_choice(spark, sf_dir):
    x = Updated(spark, sf_dir)
    return updates.route(x.new, x.sizes, x.summary("max"))


@register("insert_max", update_sql("SELECT coalesce(mx.c, dl.c) c, coalesce(mx.b, dl.b) b, coalesce(mx.c2, dl.c2) c2, round(greatest(coalesce(v, x_max), coalesce(x_max, v)), 6) v FROM mx FULL JOIN dl ON mx.c = dl.c AND mx.b = dl.b AND mx.c2 = dl.c2"))
def insert_max(spark, sf_dir):
    x = Updated(spark, sf_dir)
    s = x.summary("max")
    return rounded(updates.insert_max(s, updates.route(x.new, x.sizes, s), x.p), "v")


@register("insert_centroid", update_sql("SELECT c, b, c2, round(v, 6) v FROM im", "mn"))
def insert_centroid(spark, sf_dir):
    x = Updated(spark, sf_dir)
    s = x.summary("mean")
    return rounded(updates.shift_mean(s, x.sizes, updates.route(x.new, x.sizes, s), x.p, 1), "v")


INSERT_RADIUS = """SELECT c, b, round(greatest(coalesce(rd.radius + coalesce(shift, 0), 0), coalesce(far, 0)), 6) radius FROM rd
    FULL JOIN (SELECT c, b, sqrt(sum(pow((coalesce(x_sum, 0) - m * coalesce(v, 0)) / (n + m), 2))) shift FROM (SELECT coalesce(mn.c, dl.c) c, coalesce(mn.b, dl.b) b, v, x_sum FROM mn FULL JOIN dl ON mn.c = dl.c AND mn.b = dl.b AND mn.c2 = dl.c2) JOIN dm USING (c, b) JOIN bn USING (c, b) GROUP BY ALL) USING (c, b)
    FULL JOIN (SELECT c, b, max(sqrt(greatest(0, norm + t))) far FROM (SELECT ro.c, ro.b, ro.d, sum(p.v * p.v - 2 * p.v * coalesce(im.v, 0)) t FROM ro JOIN p ON p.d = ro.d LEFT JOIN im ON im.c = ro.c AND im.b = ro.b AND im.c2 = p.c GROUP BY ALL) JOIN (SELECT c, b, sum(v * v) norm FROM im GROUP BY ALL) USING (c, b) GROUP BY ALL) USING (c, b)"""


@register("insert_radius", update_sql(INSERT_RADIUS, "mn"))
def insert_radius(spark, sf_dir):
    x = Updated(spark, sf_dir)
    s = x.summary("mean")
    return rounded(updates.shift_radius(index.radius(x.blocks, s, x.old), s, x.sizes, updates.route(x.new, x.sizes, s), x.p, 1), "radius")


@register("delete_max", update_sql(f"SELECT c, b, c2, round(v, 6) v FROM (SELECT mx.* FROM mx ANTI JOIN gm USING (c, b) UNION ALL SELECT c, b, c2, most v FROM (SELECT *, sum(most) OVER (PARTITION BY c, b ORDER BY most DESC, c2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) a, sum(most) OVER (PARTITION BY c, b) t FROM (SELECT bl.c, bl.b, p.c c2, max(p.v) most FROM bl SEMI JOIN gm USING (c, b) JOIN p ON p.d = bl.d WHERE bl.d % 7 <> 3 GROUP BY ALL)) WHERE round(coalesce(a, 0) / t, 9) <= {ENERGY})"))
def delete_max(spark, sf_dir):
    x = Updated(spark, sf_dir)
    return rounded(updates.delete_max(x.summary("max"), x.blocks, x.old, x.gone, ENERGY), "v")


@register("delete_centroid", update_sql("SELECT c, b, c2, round((v * n - coalesce(x_sum, 0)) / (n - coalesce(m, 0)), 6) v FROM mn LEFT JOIN gl USING (c, b, c2) JOIN bn USING (c, b) LEFT JOIN gm USING (c, b) WHERE n > coalesce(m, 0)"))
def delete_centroid(spark, sf_dir):
    x = Updated(spark, sf_dir)
    return rounded(updates.shift_mean(x.summary("mean"), x.sizes, x.removed, x.p, -1), "v")


@register("delete_radius", update_sql("SELECT c, b, round(radius + coalesce(shift, 0), 6) radius FROM rd LEFT JOIN (SELECT c, b, sqrt(sum(pow((coalesce(x_sum, 0) - m * coalesce(v, 0)) / (n - m), 2))) shift FROM (SELECT coalesce(mn.c, gl.c) c, coalesce(mn.b, gl.b) b, v, x_sum FROM mn FULL JOIN gl ON mn.c = gl.c AND mn.b = gl.b AND mn.c2 = gl.c2) JOIN gm USING (c, b) JOIN bn USING (c, b) WHERE n > m GROUP BY ALL) USING (c, b)"))
def delete_radius(spark, sf_dir):
    x = Updated(spark, sf_dir)
    s = x.summary("mean")
    return rounded(updates.shift_radius(index.radius(x.blocks, s, x.old), s, x.sizes, x.removed, x.p, -1), "radius")


@register("resize_compact", update_sql("SELECT c, b, d FROM bl WHERE d % 7 <> 3"))
def resize_compact(spark, sf_dir):
    x = Updated(spark, sf_dir)
    return updates.compact(x.blocks, x.gone)


@register("search_after_delete", sql(RESULT + "an", ("pl", "SELECT * FROM p WHERE d % 7 <> 3"), ("bd", "SELECT * FROM bl WHERE d % 7 <> 3"), *ann_parts("mx", PLAIN, "pl", "bd")))
def search_after_delete(spark, sf_dir, ask=queries_of):
    x = Built(spark, sf_dir, ask)
    gone = x.p.where("d % 7 = 3").select("d").distinct()
    return result(search.approximate(x.q, updates.alive(x.p, gone), updates.compact(x.blocks, gone), x.sizes, x.most(), K, CUT, HF))


@register("churn_rounds")
def churn_rounds(spark, sf_dir, ask=queries_of):
    """Rounds of deletes over documents that are no queries: recall of the approximate search against the exact one."""
    x = Built(spark, sf_dir, ask)
    summary, gone, out = x.most(), x.p.where("false").select("d"), None
    ids = x.p.select("d").distinct().join(x.q.select(F.col("q").alias("d")).distinct(), "d", "left_anti").withColumn("h", F.md5(F.concat_ws(":", F.lit("12345"), F.col("d").cast("string"))))
    ranked = order.numbered(ids, "h", "r").select("d", F.col("r") + 1).toDF("d", "r")
    for i in range(3):
        gone = ranked.where(F.col("r") <= 40 * i).select("d")
        live = updates.alive(x.p, gone)
        found = search.approximate(x.q, live, updates.compact(x.blocks, gone), x.sizes, summary, K, CUT, HF)
        one = metrics.recall(search.exact(x.q, live, K), found).select(F.lit(i).alias("round"), "hits", "relevant", "recall")
        out = one if out is None else out.unionByName(one)
    return out


# projections

JLT_K, JLT_S = 16, 4
JLT = [
    ("jt", f"SELECT c, r, CASE WHEN substr(md5(concat_ws(':', '{SEED}', c::VARCHAR, r::VARCHAR) || ':sign'), 1, 1) < '8' THEN 1.0 ELSE -1.0 END / sqrt({JLT_S}) w FROM (SELECT c, r, row_number() OVER (PARTITION BY c ORDER BY md5(concat_ws(':', '{SEED}', c::VARCHAR, r::VARCHAR)), r) k FROM (SELECT range::INT c FROM range(64)), (SELECT range::INT r FROM range({JLT_K}))) WHERE k <= {JLT_S}"),
    ("jp", "SELECT d, r, sum(v * w) v FROM p JOIN jt USING (c) GROUP BY ALL"),
]


@register("jlt_matrix", sql("SELECT c, r, round(w::DOUBLE, 6) w FROM jt", *JLT))
def jlt_matrix(spark, sf_dir):
    return rounded(projection.matrix(spark, 64, JLT_K, JLT_S, SEED), "w")


@register("jlt_transform", sql("SELECT d, r, round(v, 6) v FROM jp WHERE abs(v) >= 0.01", *JLT))
def jlt_transform(spark, sf_dir):
    return rounded(projection.transform(vectors(spark, sf_dir), projection.matrix(spark, 64, JLT_K, JLT_S, SEED), ["d"], 0.01), "v")


@register("jlt_distortion", sql("SELECT round(avg(abs(b.t - a.t) / a.t), 6) distortion FROM (SELECT x.d, sqrt(sum(pow(coalesce(m.v, 0) - coalesce(n.v, 0), 2))) t FROM (SELECT DISTINCT d FROM p WHERE d < 50) x CROSS JOIN (SELECT range::INT c FROM range(64)) k LEFT JOIN p m ON m.d = x.d AND m.c = k.c LEFT JOIN p n ON n.d = x.d + 1 AND n.c = k.c GROUP BY ALL) a JOIN (SELECT x.d, sqrt(sum(pow(coalesce(m.v, 0) - coalesce(n.v, 0), 2))) t FROM (SELECT DISTINCT d FROM p WHERE d < 50) x CROSS JOIN (SELECT range::INT r FROM range(16)) k LEFT JOIN jp m ON m.d = x.d AND m.r = k.r LEFT JOIN jp n ON n.d = x.d + 1 AND n.r = k.r GROUP BY ALL) b USING (d) WHERE a.t > 1e-10", *JLT))
def jlt_distortion(spark, sf_dir):
    p = vectors(spark, sf_dir)
    pairs = p.where("d < 50").select(F.col("d").alias("x")).distinct().withColumn("y", F.col("x") + 1)
    y = projection.transform(p, projection.matrix(spark, 64, JLT_K, JLT_S, SEED), ["d"]).withColumnRenamed("r", "c")
    both = projection.distances(p, pairs).join(projection.distances(y, pairs).withColumnRenamed("dist", "seen"), ["x", "y"])
    return both.where("dist > 1e-10").agg(F.round(F.avg(F.abs(F.col("seen") - F.col("dist")) / F.col("dist")), 6).alias("distortion"))


@register("jl_bound", "SELECT ceil(4 * ln(100) / (0.1 * 0.1 * 0.5))::INT k")
def jl_bound(spark, sf_dir):
    return spark.createDataFrame([(projection.least_rows(),)], "k int")


@register("dense_jlt")
def dense_jlt(spark, sf_dir):
    return projection.transform(signed_vectors(spark, sf_dir), projection.dense_matrix(spark, 64, 8, SEED), ["d"])


JLT_BLOCKS = [
    ("js", "SELECT c, b, r c2, sum(v * w) v FROM mx JOIN (SELECT c c2, r, w FROM jt) USING (c2) GROUP BY ALL"),
    ("jq", "SELECT q, r c, sum(v * w) v FROM q JOIN jt USING (c) GROUP BY ALL"),
]
_JLT_ANN = [(n, "SELECT qc.q, bn.c, bn.b, bn.n, coalesce(sum(jq.v * s.v), 0) s FROM qc JOIN bn USING (c) LEFT JOIN js s ON s.c = bn.c AND s.b = bn.b LEFT JOIN jq ON jq.q = qc.q AND jq.c = s.c2 GROUP BY ALL" if n == "bs" else v) for n, v in ann_parts("mx", PLAIN)]


@register("ann_search_jlt", sql(RESULT + "an", *JLT, *JLT_BLOCKS, *_JLT_ANN))
def ann_search_jlt(spark, sf_dir, ask=queries_of):
    x = Built(spark, sf_dir, ask)
    m = projection.matrix(spark, 64, JLT_K, JLT_S, SEED)
    s = projection.transform(x.most(), m, ["c", "b"], component="c2").withColumnRenamed("r", "c2")
    asked = projection.transform(x.q, m, ["q"]).withColumnRenamed("r", "c")
    return result(x.approximate(s, summary_query=asked))


# diagnostics and metrics

UNCUT = [("mu", "SELECT c, b, c2, total / n v FROM bt JOIN bn USING (c, b)"), ("r2", "SELECT bl.c, bl.b, bl.d, sqrt(greatest(0, sum(p.v * p.v - 2 * p.v * coalesce(mu.v, 0)) + any_value(g.norm))) res FROM bl JOIN p ON p.d = bl.d LEFT JOIN mu ON mu.c = bl.c AND mu.b = bl.b AND mu.c2 = p.c JOIN (SELECT c, b, sum(v * v) norm FROM mu GROUP BY ALL) g ON g.c = bl.c AND g.b = bl.b GROUP BY ALL")]


def residuals(blocks: DataFrame, mean: DataFrame, p: DataFrame) -> DataFrame:
    norm = mean.groupBy("c", "b").agg(F.sum(F.col("v") * F.col("v")).alias("norm"))
    full = p.select("d", F.col("c").alias("c2"), F.col("v").alias("x"))
    t = blocks.join(full, "d").join(mean, ["c", "b", "c2"], "left").groupBy("c", "b", "d").agg(F.sum(F.col("x") * F.col("x") - 2 * F.col("x") * F.coalesce("v", F.lit(0.0))).alias("t"))
    return t.join(norm, ["c", "b"]).select("c", "b", "d", F.sqrt(F.greatest(F.lit(0.0), F.col("norm") + F.col("t"))).alias("res"))


@register("block_geometry", sql("SELECT c, b, count(*) n, round(max(res), 6) radius, round((list(res ORDER BY res))[count(*) // 2 + 1], 6) median FROM r2 GROUP BY c, b", *UNCUT))
def block_geometry(spark, sf_dir):
    x = Built(spark, sf_dir)
    r = residuals(x.blocks, index.summarise(x.blocks, x.p, "mean"), x.p)
    most = r.groupBy("c", "b").agg(F.count("*").alias("n"), F.round(F.max("res"), 6).alias("radius"))
    return most.join(rounded(metrics.upper_median(r, ["c", "b"], "res"), "median"), ["c", "b"])


LOOSE = [
    ("bx", "SELECT bn.*, r.radius FROM bn JOIN (SELECT c, b, max(res) radius FROM r2 GROUP BY ALL) r USING (c, b) WHERE n >= 2"),
    ("tm", "SELECT qc.q, bl.c, bl.b, max(coalesce(s.score, 0)) t FROM qc JOIN bl USING (c) LEFT JOIN sc s ON s.q = qc.q AND s.d = bl.d GROUP BY ALL"),
    ("um", "SELECT qc.q, bx.c, bx.b, sum(q.v * coalesce(mu.v, 0)) dot, sum(q.v * coalesce(bt.most, 0)) maxsum, sum(q.v * q.v) q2, sum(CASE WHEN bt.most IS NOT NULL THEN q.v * q.v ELSE 0 END) qr, any_value(bx.radius) radius FROM qc JOIN bx USING (c) JOIN q ON q.q = qc.q LEFT JOIN mu ON mu.c = bx.c AND mu.b = bx.b AND mu.c2 = q.c LEFT JOIN bt ON bt.c = bx.c AND bt.b = bx.b AND bt.c2 = q.c GROUP BY ALL"),
]


@register("bound_looseness", sql("SELECT count(*) n, round(avg((dot + sqrt(q2) * radius) / t), 6) plain, round(avg((dot + sqrt(qr) * radius) / t), 6) restricted, round(avg(maxsum / t), 6) maxsum, count(*) FILTER (WHERE dot + sqrt(qr) * radius + 1e-3 < t OR maxsum + 1e-3 < t) violations FROM um JOIN tm USING (q, c, b) WHERE t > 1e-6", *UNCUT, *LOOSE))
def bound_looseness(spark, sf_dir, ask=queries_of):
    x = Built(spark, sf_dir, ask)
    mean, full = index.summarise(x.blocks, x.p, "mean"), index.summarise(x.blocks, x.p, "max").withColumnRenamed("v", "most")
    radii = residuals(x.blocks, mean, x.p).groupBy("c", "b").agg(F.max("res").alias("radius"))
    lists = search.query_cut(x.q, CUT).select("q", "c")
    s = search.scores(x.q, x.p)
    t = lists.join(x.blocks, "c").join(s, ["q", "d"], "left").groupBy("q", "c", "b").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("t"))
    w = x.q.select("q", F.col("c").alias("c2"), F.col("v").alias("w"))
    met = lists.join(x.sizes.where("n >= 2"), "c").join(w, "q").join(mean, ["c", "b", "c2"], "left").join(full, ["c", "b", "c2"], "left")
    square = F.col("w") * F.col("w")
    u = met.groupBy("q", "c", "b").agg(F.sum(F.col("w") * F.coalesce("v", F.lit(0.0))).alias("dot"), F.sum(F.col("w") * F.coalesce("most", F.lit(0.0))).alias("top"), F.sum(square).alias("q2"), F.sum(F.when(F.col("most").isNotNull(), square).otherwise(0.0)).alias("qr"))
    all_ = u.join(radii, ["c", "b"]).join(t, ["q", "c", "b"]).where("t > 1e-6")
    plain, narrow = (F.col("dot") + F.sqrt(c) * F.col("radius") for c in ("q2", "qr"))
    bad = (narrow + 1e-3 < F.col("t")) | (F.col("top") + 1e-3 < F.col("t"))
    return all_.agg(F.count("*").alias("n"), F.round(F.avg(plain / F.col("t")), 6).alias("plain"), F.round(F.avg(narrow / F.col("t")), 6).alias("restricted"), F.round(F.avg(F.col("top") / F.col("t")), 6).alias("maxsum"), F.count(F.when(bad, 1)).alias("violations"))


@register("percentiles_nearest_rank", sql("SELECT p::DOUBLE p, round(l[least(n - 1, floor(p * n)::BIGINT) + 1], 6) value FROM (SELECT list(v ORDER BY v) l, count(*) n FROM p), (SELECT unnest([0.1, 0.5, 0.9, 0.99])::DOUBLE p)"))
def percentiles_nearest_rank(spark, sf_dir):
    return rounded(metrics.nearest_rank(vectors(spark, sf_dir), "v", [0.1, 0.5, 0.9, 0.99]), "value")


@register("upper_median", sql("SELECT c, round((list(v ORDER BY v))[count(*) // 2 + 1], 6) median FROM p GROUP BY c"))
def upper_median(spark, sf_dir):
    return rounded(metrics.upper_median(vectors(spark, sf_dir), ["c"], "v"), "median")


@register("recall_at_k", sql("SELECT count(an.d) hits, count(*) relevant, count(an.d) / count(*) recall FROM ex LEFT JOIN an ON an.q = ex.q AND an.d = ex.d", *ann_parts("mx", PLAIN)))
def recall_at_k(spark, sf_dir, ask=queries_of):
    x = Built(spark, sf_dir, ask)
    return metrics.recall(search.exact(x.q, x.p, K), x.approximate(x.most()))


@register("rr_at_k", sql("SELECT round(avg(coalesce(1 / r, 0)), 6) rr FROM (SELECT DISTINCT q FROM q) LEFT JOIN (SELECT ex.q, min(rank) r FROM ex JOIN embeddings a ON a.vec_id = ex.q JOIN embeddings b ON b.vec_id = ex.d WHERE a.label = b.label AND ex.q <> ex.d GROUP BY ALL) USING (q)"))
def rr_at_k(spark, sf_dir, ask=queries_of):
    p = vectors(spark, sf_dir)
    l = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    asked = l.join(ask(p).select("q").distinct(), F.col("vec_id") == F.col("q")).select("q", "label")
    qrels = asked.join(l, "label").where("q <> vec_id").select("q", F.col("vec_id").alias("d"), F.lit(1).alias("relevance"))
    return rounded(metrics.reciprocal_rank(search.exact(ask(p), p, K), qrels), "rr")


@register("space_bytes", sql("SELECT count(DISTINCT d) vectors, max(c) + 1 dim, count(*) nnz, (8 * (count(DISTINCT d) + 1) + 6 * count(*) + 8 + count(DISTINCT d))::BIGINT bytes FROM p"))
def space_bytes(spark, sf_dir):
    return metrics.corpus_bytes(vectors(spark, sf_dir), mutable=True)


# the same searches over the whole query set

#: Every search above that takes a query set.
SEARCHES = (
    "exact_topk", "exact_topk_signed", "dot_query_doc", "score_abs", "query_cut", "block_scores", "quantized_block_scores", "visited_dedup",
    "union_candidates", "except_visited", "set_intersection", "skip_max_threshold", "skip_centroid_count", "skip_centroid_alpha",
    "ann_search_max", "ann_search_centroid_count", "ann_search_centroid_alpha", "ann_search_quantized", "ann_search_jlt", "batch_search",
    "result_ranks", "knn_refine", "search_after_delete", "churn_rounds", "bound_looseness", "recall_at_k", "rr_at_k",
)


def asking_all(twin: str | None) -> str | None:
    """A twin with the whole query set in place of the first 20 vectors."""
    for source in ("p", "e") if twin else ():
        twin = twin.replace(f"SELECT d q, c, v FROM {source} WHERE d < 20", f"SELECT d q, c, v FROM {source} WHERE d % 50 = 0")
    return twin


for _name in SEARCHES:
    _run, _twin = registered(_name)
    register(f"{_name}_all", asking_all(_twin))(partial(_run, ask=asked_of))


# the vector queries over whole tables; those of the same name without _all keep the few ids of their SQL twins

NEXT = "FROM (SELECT DISTINCT d FROM p WHERE d + 1 IN (SELECT d FROM p))"


def consecutive(p: DataFrame) -> DataFrame:
    """(x, y) of all vectors whose successor by id is there too."""
    ids = p.select("d").distinct()
    return ids.select(F.col("d").alias("x"), (F.col("d") + 1).alias("y")).join(ids.withColumnRenamed("d", "y"), "y", "left_semi").select("x", "y")


def over_all(name: str, *swaps: tuple[str, str]) -> str:
    """The twin of ``name`` with its id filters replaced."""
    twin = registered(name)[1]
    for a, b in swaps:
        if a not in twin:
            raise ValueError(f"{name} has no {a!r}")
        twin = twin.replace(a, b)
    return twin


ASKED = ("a.d < 20 AND b.d < 20 AND a.d < b.d", "a.d % 50 = 0 AND a.d <> b.d")


@register("dot_pairwise_all", over_all("dot_pairwise", ASKED))
def dot_pairwise_all(spark, sf_dir):
    p = vectors(spark, sf_dir)
    s = search.scores(asked_of(p), p).where("q <> d")
    return s.select(F.col("q").alias("x"), F.col("d").alias("y"), F.round("score", 6).alias("dot"))


@register("euclidean_pairs_all", over_all("euclidean_pairs", ASKED))
def euclidean_pairs_all(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    asked = search.small(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("x"), F.col("v").alias("w")))
    both = e.join(asked, F.col("x") != F.col("vec_id"))
    dist = F.expr("sqrt(aggregate(zip_with(w, v, (i, j) -> pow(coalesce(i, 0D) - coalesce(j, 0D), 2)), 0D, (t, s) -> t + s))")
    return both.select("x", F.col("vec_id").alias("y"), F.round(dist, 6).alias("dist"))


@register("residual_norm_all", over_all("residual_norm", ("FROM (SELECT DISTINCT d FROM p WHERE d < 50)", NEXT)))
def residual_norm_all(spark, sf_dir):
    p = vectors(spark, sf_dir)
    return rounded(projection.distances(p, consecutive(p)), "dist")


@register("densify_all", over_all("densify", (" WHERE d < 50", "")))
def densify_all(spark, sf_dir):
    from sablevec.functions.vectors import dense

    f = index.fold(vectors(spark, sf_dir))
    return f.select(F.col("doc_id").alias("d"), F.posexplode(dense("components", "values", 64)).alias("c", "v"))


@register("jlt_distortion_all", over_all("jlt_distortion", ("FROM (SELECT DISTINCT d FROM p WHERE d < 50)", NEXT)))
def jlt_distortion_all(spark, sf_dir):
    p = vectors(spark, sf_dir)
    pairs = consecutive(p)
    y = projection.transform(p, projection.matrix(spark, 64, JLT_K, JLT_S, SEED), ["d"]).withColumnRenamed("r", "c")
    both = projection.distances(p, pairs).join(projection.distances(y, pairs).withColumnRenamed("dist", "seen"), ["x", "y"])
    return both.where("dist > 1e-10").agg(F.round(F.avg(F.abs(F.col("seen") - F.col("dist")) / F.col("dist")), 6).alias("distortion"))


@register("list_intersection_all", over_all("list_intersection", ("a.c < 8 AND b.c < 8 AND ", "")))
def list_intersection_all(spark, sf_dir):
    p = vectors(spark, sf_dir)
    return p.select("d", F.col("c").alias("x")).join(p.select("d", F.col("c").alias("y")), "d").where("x < y").groupBy("x", "y").agg(F.count("*").alias("n"))


@register("docname_remap_all", over_all("docname_remap", (" WHERE doc_id % 2 = 0", "")))
def docname_remap_all(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("name"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("d"))
    return e.join(names, F.col("d") == F.col("doc_id"), "left").select("d", F.coalesce("name", F.col("d").cast("string")).alias("name"))
