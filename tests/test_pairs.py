"""Exact neighbours by tiles of blocks, against sums over all pairs."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from sablevec.operators import graph, pairs, search


def table(rng, n, dim, most, signed=False):
    rows = []
    for d in range(0, 3 * n, 3):
        c = rng.choice(dim, rng.integers(1, most + 1), replace=False)
        rows += [(d, int(x), float(y)) for x, y in zip(c, rng.standard_normal(len(c)) if signed else rng.random(len(c)) + 0.01)]
    return rows


def brute(rows, k):
    vectors, out = {}, {}
    for d, c, v in rows:
        if None not in (d, c, v):
            own = vectors.setdefault(d, {})
            own[c] = own.get(c, 0.0) + v
    for d, x in vectors.items():
        found = [(sum(x[c] * y[c] for c in sorted(x.keys() & y.keys())), e) for e, y in vectors.items() if e != d and x.keys() & y.keys()]
        out[d] = [e for s, e in sorted(found, key=lambda t: (not math.isnan(t[0]), 0 if math.isnan(t[0]) else -round(t[0], 9), t[1]))[:k]]
    return {d: x for d, x in out.items() if x}


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.d, r.rank)):
        out.setdefault(r.d, []).append(r.nbr)
        assert r.rank == len(out[r.d])
    return out


CASES = {
    "dense": lambda rng: table(rng, 120, 24, 20),
    "sparse": lambda rng: table(rng, 150, 2000, 12),
    "signed": lambda rng: table(rng, 120, 30, 5, signed=True),
    "copies": lambda rng: [(d, c, v) for d, c, v in table(rng, 60, 20, 8)] + [(1000 - j, c, 0.5 + c / 64) for j in range(40) for c in (1, 4, 9)],
    "odd": lambda rng: table(rng, 60, 20, 8)
    + [(1000, 1, math.nan), (1001, 2, math.inf), (1002, 3, 1e300), (1003, 3, 1e-300), (1004, 4, 0.0), (1004, 4, 1.0), (1005, 4, -1.0), (1006, 5, None), (None, 5, 1.0), (1007, 6, 1.0), (1007, 7, 1e-200), (1008, 99, 1.0)],
}


@pytest.mark.parametrize("case", CASES)
def test_neighbours_equal_brute_force(spark, case):
    rows = CASES[case](np.random.default_rng(5))
    p = spark.createDataFrame(rows, "d bigint, c int, v double")
    want = brute(rows, 4)
    assert lists(graph.build(p, 4)) == want
    some = [d for d in want if d % 5 == 0]
    assert lists(graph.build(p, 4, spark.createDataFrame([(d,) for d in some + [7]], "d bigint"))) == {d: want[d] for d in some}


@pytest.mark.parametrize("case", ["dense", "sparse", "signed"])
@pytest.mark.parametrize("docs, postings", [(7, 10**6), (50, 64), (1, 1)])
def test_blocks_of_any_size(monkeypatch, case, docs, postings):
    """Packing and meeting, in blocks smaller than the table, vectors larger than a block, and states let go early."""
    rows = CASES[case](np.random.default_rng(6))
    for name, value in (("DOCS", docs), ("POSTINGS", postings), ("STRIP", 3), ("SUMMED", 50), ("HELD", 2), ("WIDE", 5)):
        monkeypatch.setattr(pairs, name, value)
    by = {}
    for d, c, v in sorted(rows):
        by.setdefault(d, []).append({"c": c, "v": v})
    kind = pa.schema([("rep", pa.int64()), ("x", pa.list_(pa.struct([("c", pa.int64()), ("v", pa.float64())])))])
    whole = pa.RecordBatch.from_pylist([{"rep": d, "x": x} for d, x in by.items()], kind)
    made = list(pairs.pack()(iter([whole.slice(0, 11), whole.slice(11)])))
    assert sum(len(b.column("d")[0].as_py()) // 8 for b in made) == len(by)
    assert all(len(b.column("d")[0].as_py()) // 8 <= docs for b in made)
    met = [pa.RecordBatch.from_arrays([*a.columns, *b.columns], names=[*("q_" + n for n in a.schema.names), *("d_" + n for n in b.schema.names)]) for b in made for a in made]
    found = {}
    for batch in pairs.meet(5)(iter(met if len(made) < 40 else met[: 40 * len(made)])):
        for r in batch.to_pylist():
            found.setdefault(r["q"], set()).add((-round(r["score"], 9), r["d"]))
    if len(made) < 40:
        got = {q: [d for _, d in sorted(x) if d != q][:4] for q, x in found.items()}
        assert {q: x for q, x in got.items() if x} == brute(rows, 4)


def test_no_plan_lists_the_pairs_of_a_component(spark):
    """The join of postings with postings grows with the square of each list."""
    p = spark.createDataFrame([(d, c, 1.0 + d * c) for d in range(20) for c in range(3)], "d bigint, c int, v double")
    plan = graph.build(p, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join \w+, \(c#\d+L? = c#", plan)


def test_rows_sent_on_do_not_grow_with_pairs_of_blocks(spark, monkeypatch):
    """A class sends on its best once, however many blocks it meets."""
    monkeypatch.setattr(pairs, "DOCS", 4)
    monkeypatch.setattr(pairs, "HELD", 2)
    rows, sent, top = table(np.random.default_rng(8), 120, 12, 9), [], search.top
    monkeypatch.setattr(search, "top", lambda found, k: sent.append(found) or top(found, k))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for blocks too large to be broadcast
    try:
        assert lists(graph.build(spark.createDataFrame(rows, "d bigint, c int, v double"), 4)) == brute(rows, 4)
        assert sent[0].count() <= 5 * 120
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_blocks_hold_values_exactly_and_narrow():
    kind = pa.schema([("rep", pa.int64()), ("x", pa.list_(pa.struct([("c", pa.int64()), ("v", pa.float64())])))])
    cases = {(2, 4): [(3, 0.5), (9, math.nan), (32767, -0.0)], (4, 8): [(-1, 0.1), (40000, 1e300)], (8, 4): [(2**40, math.inf), (2**62 + 1, 1.5)]}
    for (c_size, v_size), x in cases.items():
        batch = pa.RecordBatch.from_pylist([{"rep": 7, "x": [{"c": c, "v": v} for c, v in sorted(x)]}], kind)
        (made,) = pairs.pack()(iter([batch]))
        assert (len(made.column("c")[0].as_py()), len(made.column("v")[0].as_py())) == (c_size * len(x), v_size * len(x))
        b = pairs.Block.of(made.rename_columns(["q_" + n for n in made.schema.names]), "q_", 0)
        assert b.c.tolist() == [c for c, _ in sorted(x)]
        assert b.v.tobytes() == np.array([v for _, v in sorted(x)]).tobytes()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("graph")
    x = np.random.default_rng(3).standard_normal((120, 64)).astype(np.float32).astype(float)
    x[90:] = x[7]  # equal vectors
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int").write.parquet(f"{at}/embeddings.parquet")
    return str(at), [(i, int(c), float(v[c])) for i, v in enumerate(x) for c in np.flatnonzero(v > 0.1)]


def test_registered_graph_has_no_join_of_postings(spark, folder):
    from sablevec.plans import catalogue

    df = catalogue.queries()["knn_build"](spark, folder[0])
    assert not re.search(r"Join \w+, \(c#\d+L? = c#", df._jdf.queryExecution().optimizedPlan().toString())
    assert lists(df) == brute(folder[1], 5)


@pytest.mark.parametrize("name, asked", [("knn_refine_all", {0, 50, 100}), ("knn_refine", set(range(20)))])
def test_refinement_asks_only_for_found_documents(spark, folder, monkeypatch, name, asked):
    from sablevec.plans import catalogue

    made, build = [], graph.build
    monkeypatch.setattr(graph, "build", lambda *a, **b: made.append(build(*a, **b)) or made[-1])
    out = catalogue.queries()[name](spark, folder[0]).collect()
    assert {r.q for r in out} == asked
    found = {r.d for r in made[0].select("d").distinct().collect()}
    assert len(found) < 110 and {r.d for r in out} <= found | {r.nbr for r in made[0].collect()}
