"""Registered queries over whole tables, against brute force on a small fixture."""

import numpy as np
import pytest

from sablevec.plans import catalogue

N = 220


@pytest.fixture(scope="module")
def vectors():
    return np.random.default_rng(1).standard_normal((N, 64)).astype(np.float32).astype(float)


@pytest.fixture(scope="module")
def folder(spark, vectors, tmp_path_factory):
    at = tmp_path_factory.mktemp("whole")
    rows = [(i, v.tolist(), i % 5) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame([(i, f"s{i % 3}") for i in range(N)], "doc_id bigint, source string").write.parquet(f"{at}/documents.parquet")
    return str(at)


def run(spark, folder, name):
    return catalogue.queries()[name](spark, folder).collect()


def test_searches_ask_every_50th_vector(spark, folder, vectors):
    p = np.where(vectors > 0.1, vectors, 0)
    got = {(r.q, r.rank): r.d for r in run(spark, folder, "exact_topk_all")}
    want = {(q, k + 1): int(d) for q in range(0, N, 50) for k, d in enumerate(np.argsort(-(p @ p[q]), kind="stable")[:10])}
    assert got == want
    for name in ("query_cut_all", "exact_topk_signed_all", "score_abs_all", "block_scores_all", "batch_search_all"):
        assert {r.q for r in run(spark, folder, name)} == set(range(0, N, 50))
    assert run(spark, folder, "recall_at_k_all")[0].relevant == 10 * len(range(0, N, 50))


def test_vector_queries_take_all_rows(spark, folder, vectors):
    p = np.where(vectors > 0.1, vectors, 0)
    pairs = {(q, d) for q in range(0, N, 50) for d in range(N) if d != q}
    dots = {(r.x, r.y): r.dot for r in run(spark, folder, "dot_pairwise_all")}
    assert set(dots) == pairs and all(abs(dots[q, d] - p[q] @ p[d]) < 1e-5 for q, d in pairs)
    dist = {(r.x, r.y): r.dist for r in run(spark, folder, "euclidean_pairs_all")}
    assert set(dist) == pairs and all(abs(dist[q, d] - np.linalg.norm(vectors[q] - vectors[d])) < 1e-5 for q, d in pairs)
    near = {(r.x, r.y): r.dist for r in run(spark, folder, "residual_norm_all")}
    assert set(near) == {(i, i + 1) for i in range(N - 1)} and all(abs(near[i, j] - np.linalg.norm(p[i] - p[j])) < 1e-5 for i, j in near)
    assert {(r.d, r.c): r.v for r in run(spark, folder, "densify_all")} == {(i, j): p[i, j] for i in range(N) for j in range(64)}
    both = (p > 0).astype(int).T @ (p > 0).astype(int)
    assert {(r.x, r.y): r.n for r in run(spark, folder, "list_intersection_all")} == {(i, j): both[i, j] for i in range(64) for j in range(i + 1, 64)}
    assert {r.d: r.name for r in run(spark, folder, "docname_remap_all")} == {i: f"s{i % 3}-{i}" for i in range(N)}


def test_binary_source_takes_all_vectors(spark, folder, vectors):
    found = {(r.d, r.c): r.v for r in run(spark, folder, "svbin_roundtrip")}
    assert set(found) == {(int(i), int(j)) for i, j in zip(*np.nonzero(vectors > 0.1))} and all(abs(found[i, j] - vectors[i, j]) < 1e-5 for i, j in found)
    assert {"svbin_roundtrip", "jsonl_scan", "tsv_sink"} <= set(catalogue.queries())
