"""Golden values of small corpora, and properties of search and updates."""

import math

import pytest
from pyspark.sql import functions as F

from sablevec.operators import cluster, graph, index, metrics, projection, search, updates
from sablevec.plans.config import Config, Search, index_name
from sablevec.plans.sparse_index import SparseIndex, build_from_tokens

FIVE = {0: {0: 1, 2: 2, 4: 3}, 1: {1: 4, 3: 5}, 2: {0: 1, 1: 2, 2: 3, 3: 4}, 3: {2: 2.5, 4: 3.5}, 4: {0: 1.5, 1: 2.5, 3: 3.5, 4: 4.5}}
ASKED = {0: {0: 1, 2: 2, 4: 3}}


def rows(spark, docs, key="d"):
    return spark.createDataFrame([(d, c, float(v)) for d, x in docs.items() for c, v in x.items()], f"{key} bigint, c int, v double")


@pytest.fixture(scope="module")
def five(spark):
    return rows(spark, FIVE)


@pytest.fixture(scope="module")
def asked(spark):
    return rows(spark, ASKED, "q")


def block(spark, ids):
    return spark.createDataFrame([(0, 0, d) for d in ids], "c int, b int, d bigint")


def values(df):
    return {r.c2: r.v for r in df.collect()}


def test_exact_scores_best_first(five, asked):
    found = [(r.d, r.score) for r in search.exact(asked, five, 4).orderBy("rank").collect()]
    assert found == [(3, 15.5), (4, 15.0), (0, 14.0), (2, 7.0)]


def test_chunks_of_ten(spark):
    p = spark.createDataFrame([(d, 0, float(10 - d)) for d in range(10)], "d bigint, c int, v double")
    blocks = index.block_chunks(index.prune_fixed(p, 10), 3)
    assert [r.n for r in index.block_sizes(blocks).orderBy("b").collect()] == [3, 3, 3, 1]


def test_summaries_and_radius(spark, five):
    b = block(spark, [0, 2, 4])
    assert values(index.summarise(b, five, "max")) == {0: 1.5, 1: 2.5, 2: 3, 3: 4, 4: 4.5}
    assert set(values(index.summarise(b, five, "max", 0.8))) == {1, 2, 3, 4}
    assert set(values(index.summarise(b, five, "max", 0.4))) == {3, 4}
    mean = index.summarise(b, five, "mean")
    assert values(mean) == pytest.approx({0: 7 / 6, 1: 1.5, 2: 5 / 3, 3: 2.5, 4: 2.5})
    assert set(values(index.summarise(b, five, "mean", 0.8))) == {1, 2, 3, 4}
    assert index.radius(b, mean, five).first().radius == pytest.approx(3.24893145)


def test_mean_updates(spark, five):
    b = block(spark, [0, 2, 4])
    sizes, mean = index.block_sizes(b), index.summarise(b, five, "mean")
    added = updates.shift_mean(mean, sizes, block(spark, [1]), five, 1)
    assert values(added) == pytest.approx({0: 0.875, 1: 2.125, 2: 1.25, 3: 3.125, 4: 1.875})
    taken = updates.shift_mean(mean, sizes, block(spark, [4]), five, -1)
    assert values(taken) == pytest.approx({0: 1, 1: 1, 2: 2.5, 3: 2, 4: 1.5})
    r = updates.shift_radius(index.radius(b, mean, five), mean, sizes, block(spark, [4]), five, -1)
    assert r.first().radius == pytest.approx(4.73964343)


@pytest.mark.parametrize("given,minimum,quant,codes", [([1, 2, 3, 4, 5], 1, 0.015625, [0, 64, 128, 192, 255]), ([3] * 5, 3, 1, [0] * 5)])
def test_quantiser(spark, given, minimum, quant, codes):
    s = spark.createDataFrame([(0, 0, i, float(v)) for i, v in enumerate(given)], "c int, b int, c2 int, v double")
    found = index.quantise(s).orderBy("c2").collect()
    assert [r.code for r in found] == codes
    assert {(r.minimum, r.quant) for r in found} == {(minimum, quant)}


def test_quantised_scores(spark):
    s = spark.createDataFrame([(0, b, c, float(v)) for b, x in {0: {0: 1, 2: 2, 4: 3}, 1: {1: 4, 3: 5}, 2: {0: 1, 1: 2, 2: 3, 3: 4}}.items() for c, v in x.items()], "c int, b int, c2 int, v double")
    sizes = s.select("c", "b").distinct().withColumn("n", F.lit(1).cast("bigint"))
    q = spark.createDataFrame([(0, 0, 1.0), (0, 2, 1.0)], "q bigint, c int, v double")
    found = search.block_scores(q, sizes, index.dequantise(index.quantise(s)), 1)
    assert [r.s for r in found.orderBy("b").collect()] == pytest.approx([3.0, 0.0, 3.9921875])


def test_global_pruning_keeps_ties(spark):
    p = spark.createDataFrame([(d, 0, 1.0 if d > 5 else 2.0) for d in range(40)], "d bigint, c int, v double")
    kept = index.prune_global(p, 20, 10.0)
    assert kept.count() == 20 + 20 * 10 // 100
    assert index.prune_global(p.where("false"), 20).count() == 0
    assert index.kth_value(p, 7) == 1.0 and index.kth_value(p, 6) == 2.0


def test_assignment_and_clusters(spark):
    docs = {0: {0: 1, 2: 2}, 1: {1: 3, 3: 4}, 2: {0: 2, 2: 3}, 3: {1: 1, 3: 2}}
    p = rows(spark, docs)
    c = spark.createDataFrame([(0, 0), (1, 1)], "j int, r bigint")
    one = cluster._assign(p, c, "exact", 15, 0.1, True)
    assert [r.j for r in one.orderBy("d").collect()] == [0, 1, 0, 1]
    one = cluster._assign(p, c.where("j = 1"), "exact", 15, 0.1, True)
    assert {r.j for r in one.collect()} == {1}


@pytest.mark.parametrize("how", ["exact", "pruned", "approx"])
def test_kmeans_covers_all(spark, how):
    docs = {i: {0: 1 + 0.1 * i, 2: 2 + 0.1 * i} if i < 5 else {1: 3 + 0.1 * i, 3: 2 + 0.1 * i} for i in range(10)}
    found = cluster.kmeans(rows(spark, docs), 3, 1, how).collect()
    assert sorted(r.d for r in found) == list(range(10))


def test_searched_equals_exact_without_cuts(spark, five, asked):
    ix = SparseIndex.build(five, Config(n_postings=100, block_size=2, summary_energy=1.0))
    found = ix.search(asked, Search(k=4, cut=100, heap_factor=0.0)).orderBy("rank").collect()
    assert [(r.d, r.score) for r in found] == [(3, 15.5), (4, 15.0), (0, 14.0), (2, 7.0)]
    assert (len(ix), ix.dim, ix.nnz, ix.is_empty) == (5, 5, 15, False)
    assert ix.get(1) == [(1, 4.0), (3, 5.0)] and ix.vector_len(3) == 2
    with pytest.raises(KeyError):
        ix.get(99)


def test_sequential_oracle_agrees_when_nothing_is_skipped(five, asked):
    blocks = index.block_chunks(index.prune_fixed(five, 10), 2)
    s = index.summarise(blocks, five, "max", 1.0)
    one = search.sequential(asked, five, blocks, s, 3, 10, 0.0).orderBy("rank").collect()
    two = search.approximate(asked, five, blocks, index.block_sizes(blocks), s, 3, 10, 0.0).orderBy("rank").collect()
    assert [(r.d, r.score) for r in one] == [(r.d, r.score) for r in two]


@pytest.mark.parametrize("config", [Config(n_postings=10, block_size=2), Config(metric="centroid", summary_energy=1.0), Config(blocking="round_robin"), Config(blocking="representatives", representatives=2), Config(transform="jlt", jlt_rows=4, jlt_nonzeros=2), Config(quantised=True, pruning="global", nknn=2), Config(summary_components=3)])
def test_life_of_an_index(spark, five, asked, config, tmp_path):
    ix = SparseIndex.build(five, config)
    new = rows(spark, {7: {0: 9, 2: 9, 4: 9}})
    wide = Search(k=2, cut=10, heap_factor=0.0)
    grown = ix.insert(new)
    assert grown.search(asked, wide).orderBy("rank").first().d == 7
    gone = grown.delete(spark.createDataFrame([(7,)], "d bigint"))
    again = gone.delete(spark.createDataFrame([(7,)], "d bigint"))
    assert again.tombstones.count() == 1
    assert gone.search(asked, wide).orderBy("rank").first().d == 3
    small = gone.resize()
    assert small.search(asked, wide).orderBy("rank").first().d == 3 and len(small) == 5
    small.save(str(tmp_path / "ix"))
    back = SparseIndex.load(spark, str(tmp_path / "ix"))
    assert back.config == config
    assert back.search(asked, wide).orderBy("rank").first().d == 3


def test_tokens(spark):
    docs = [("doc1", "word1", 1.0), ("doc1", "word2", 2.0), ("doc1", "word3", 3.0), ("doc2", "word2", 4.0), ("doc2", "word4", 5.0), ("doc3", "word1", 1.0), ("doc3", "word2", 2.0), ("doc3", "word3", 3.0), ("doc3", "word4", 4.0)]
    ix = build_from_tokens(spark.createDataFrame(docs, "name string, token string, v double"))
    assert ix.vocabulary.count() == 4 and len(ix) == 3 and ix.nnz == 9
    q = spark.createDataFrame([("q1", "word1", 1.0), ("q1", "word2", 2.0), ("q1", "nowhere", 9.0), ("q2", "word2", 1.0), ("q2", "word4", 2.0)], "q string, token string, v double")
    found = {}
    for r in ix.search_tokens(q, Search(k=2, heap_factor=0.0)).orderBy("q", "rank").collect():
        found.setdefault(r.q, []).append((r.d, r.score))
    assert found == {"q1": [("doc2", 8.0), ("doc1", 5.0)], "q2": [("doc2", 14.0), ("doc3", 10.0)]}


def test_graph_and_refine(five, asked):
    knn = graph.build(five, 2)
    assert knn.where("d = nbr").count() == 0 and knn.groupBy("d").count().agg(F.max("count")).first()[0] == 2
    first = search.exact(asked, five, 1)
    more = graph.refine(first, asked, five, knn, 2, 3).orderBy("rank").collect()
    assert more[0].d == 3 and len(more) == 3


def test_percentiles(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    found = {r.p: r.value for r in metrics.nearest_rank(df, "v", [0.1, 0.5, 0.9, 0.99]).collect()}
    assert found == {0.1: 2, 0.5: 6, 0.9: 10, 0.99: 10}


def test_metrics(spark):
    res = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 5, 1)], "q bigint, d bigint, rank int")
    truth = spark.createDataFrame([(0, 2), (0, 3), (1, 5)], "q bigint, d bigint")
    assert metrics.recall(truth, res).first().recall == pytest.approx(2 / 3)
    qrels = spark.createDataFrame([(0, 2, 1), (1, 5, 1), (2, 9, 1)], "q bigint, d bigint, relevance int")
    assert metrics.reciprocal_rank(res, qrels).first().rr == pytest.approx((0.5 + 1 + 0) / 3)


def test_projection(spark):
    m = projection.matrix(spark, 10, 6, 3).collect()
    assert len(m) == 30 and all(abs(abs(r.w) - 1 / math.sqrt(3)) < 1e-12 for r in m)
    assert projection.least_rows() == 3685
    assert projection.dense_matrix(spark, 5, 4).count() == 20 and projection.random_data(spark, 3, 4).count() == 12


def test_config():
    assert Config.from_json(Config(nknn=3).to_json()) == Config(nknn=3)
    with pytest.raises(ValueError):
        Config(metric="other")
    assert index_name("x", b=2, a=1) == "x_a_1_b_2"


def test_sql_search(spark, five):
    from sablevec.plans import sql_api

    sql_api.register(SparseIndex.build(five, Config(block_size=2), keep=False), "toy")
    found = spark.sql("SELECT * FROM toy_search(array(0, 2, 4), array(1D, 2D, 3D), 2) ORDER BY rank").collect()
    assert [(r.d, r.score) for r in found] == [(3, 15.5), (4, 15.0)]


def test_running_sums(spark):
    from sablevec.operators.order import numbered, running_sum

    df = spark.range(1000).selectExpr("id * 7 % 1000 AS x", "id AS v")
    assert numbered(df, "x", "n").where("n <> x").count() == 0
    total = {r.x: r.before for r in running_sum(df.where("x < 4"), "x", "v").collect()}
    v = {(i * 7) % 1000: i for i in range(1000)}
    assert total == {i: sum(v[j] for j in range(i)) for i in range(4)}
