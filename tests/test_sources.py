import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sablevec.functions.float16 import from_half, to_half
from sablevec.functions.vectors import dot, is_valid, register_sql
from sablevec.plans.cli import main
from sablevec.sources import binary, text
from sablevec.streaming.changes import LiveIndex, apply_changes


def three(spark):
    return spark.createDataFrame([(0, [0, 2, 4], [1.0, 2.0, 3.0]), (1, [1, 3], [4.0, 5.0]), (2, [0, 1, 2, 3], [1.0, 2.0, 3.0, 4.0])], binary.SCHEMA)


def test_binary_round_trip(spark, tmp_path):
    path = str(tmp_path / "v.bin")
    assert binary.write_binary(three(spark), path) == 3
    with open(path, "rb") as f:
        assert struct.unpack("<I", f.read(4)) == (3,)
    want = three(spark).orderBy("doc_id").collect()
    assert binary.read_binary(spark, path).orderBy("doc_id").collect() == want
    assert binary.read_binary(spark, path, 2).count() == 2
    assert binary.read_through_spark(spark, path).drop("file").orderBy("doc_id").collect() == want
    assert binary.truncate(spark, path, str(tmp_path / "w.bin"), 1) == 1
    assert binary.read_binary(spark, str(tmp_path / "w.bin")).count() == 1
    open(tmp_path / "e.bin", "wb").write(struct.pack("<I", 0))
    assert binary.read_binary(spark, str(tmp_path / "e.bin")).count() == 0


def test_json_lines(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id":"doc1","vector":{"dim1":1.0,"dim2":2.5,"dim3":-3.7}}\ninvalid json\n\n{"id":42,"vector":{"x":0.5,"y":-1.2,"z":3.0}}\n')
    found = text.read_queries(spark, str(tmp_path / "q.jsonl")).groupBy("q").count().collect()
    assert sorted((r.q, r["count"]) for r in found) == [("42", 3), ("doc1", 3)]
    (tmp_path / "d.jsonl").write_text('{"id":"a","tokens":["x","y"],"values":[1,2]}\n{"id":"b","tokens":["x"],"values":[1,2]}\n{"id":3,"tokens":["y"],"values":[0.5]}\n')
    docs = text.read_corpus(spark, str(tmp_path / "d.jsonl"))
    assert sorted((r.name, r.token, r.v) for r in docs.collect()) == [("3", "y", 0.5), ("a", "x", 1.0), ("a", "y", 2.0)]
    assert [(r.name, r.d) for r in text.number_documents(docs).orderBy("d").collect()] == [("3", 0), ("a", 1)]
    with pytest.raises(ValueError):
        text.read_corpus(spark, "x.csv")
    with pytest.raises(Exception):
        text.read_queries(spark, str(tmp_path / "none.jsonl")).count()


def test_tables(spark, tmp_path):
    r = spark.createDataFrame([(1, 5, 0.5, 1), (1, 6, 0.25, 2)], "q bigint, d bigint, score double, rank int")
    text.write_results(r, str(tmp_path / "r"))
    assert [(x.q, x.d, x.rank, x.score) for x in text.read_results(spark, str(tmp_path / "r")).orderBy("rank").collect()] == [("1", "5", 1, 0.5), ("1", "6", 2, 0.25)]
    (tmp_path / "a.tsv").write_text("q1\t0\td1\t1\nq2\t0\td2\t1\n")
    (tmp_path / "b.tsv").write_text("q1\td1\t1\t0\nq2\td2\t1\t0\n")
    a, b = (text.read_qrels(spark, str(tmp_path / n)).orderBy("q").collect() for n in ("a.tsv", "b.tsv"))
    assert a == b and [x.d for x in a] == ["d1", "d2"]
    np.save(tmp_path / "m.npy", np.array([7, 9]))
    assert [x.id for x in text.read_id_map(spark, str(tmp_path / "m.npy")).orderBy("pos").collect()] == ["7", "9"]
    (tmp_path / "c.toml").write_text("[a]\nb = 1\n")
    assert text.read_config(str(tmp_path / "c.toml")) == {"a": {"b": 1}}


def test_functions(spark):
    register_sql(spark)
    row = spark.sql("SELECT sv_dot(array(0,1,2), array(1D,2D,3D), array(2,1,0), array(3D,2D,1D)) d, sv_norm(array(3D,4D)) n, sv_topk(array(5,6,7), array(1D,3D,3D), 2) t").first()
    assert (row.d, row.n, row.t) == (14.0, 5.0, [6, 7])
    df = spark.createDataFrame([([0, 1, 2, 5], [0.5, 1.5, 2.5, 1.0], [1, 2, 5, 7], [2.0, 2.0, 3.0, 4.0])], "a array<int>, x array<double>, b array<int>, y array<double>")
    assert df.select(dot("a", "x", "b", "y")).first()[0] == 11.0
    bad = spark.createDataFrame([([2, 1], [1.0, 1.0]), ([], []), ([1], [1.0, 2.0]), ([1, 2], [1.0, 2.0])], "c array<int>, v array<double>")
    assert [r[0] for r in bad.select(is_valid("c", "v")).collect()] == [False, False, False, True]
    h = spark.createDataFrame([(1.5,), (65504.0,), (1e6,), (0.1,)], "v float").select(from_half(to_half("v")).alias("v")).collect()
    assert [r.v for r in h][:3] == [1.5, 65504.0, float("inf")] and abs(h[3].v - 0.1) < 1e-4


def test_stream_of_changes(spark, tmp_path):
    from sablevec.operators.index import invert
    from sablevec.plans.config import Config, Search
    from sablevec.plans.sparse_index import SparseIndex

    ix = SparseIndex.build(invert(three(spark)), Config(block_size=2))
    schema = "seq bigint, op string, d bigint, components array<int>, values array<double>"
    spark.createDataFrame([(1, "insert", 10, [0, 2], [9.0, 9.0]), (2, "delete", 1, None, None), (3, "insert", 11, [0], [50.0]), (4, "delete", 11, None, None)], schema).write.parquet(str(tmp_path / "in"))
    live = LiveIndex(ix)
    q = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(live.update).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    asked = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (0, 2, 1.0)], "q bigint, c int, v double")
    found = [r.d for r in live.index.search(asked, Search(k=5, heap_factor=0.0)).orderBy("rank").collect()]
    assert found == [10, 2, 0]
    live.update(spark.createDataFrame([(9, "delete", 10, None, None)], schema), 0)
    assert [r.d for r in live.index.search(asked, Search(k=5, heap_factor=0.0)).orderBy("rank").collect()] == found
    assert apply_changes(ix, spark.createDataFrame([], schema)) is ix


def test_command_line(spark, tmp_path):
    binary.write_binary(three(spark), str(tmp_path / "v.bin"))
    main(["build", str(tmp_path / "v.bin"), str(tmp_path / "ix"), "--n-postings", "10"], spark)
    main(["search", str(tmp_path / "ix"), str(tmp_path / "v.bin"), str(tmp_path / "out"), "--k", "1", "--heap-factor", "0"], spark)
    assert sorted((r.q, r.d) for r in text.read_results(spark, str(tmp_path / "out")).collect()) == [("0", "0"), ("1", "1"), ("2", "2")]


def test_half_precision_of_nulls(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 1.5), (2, None), (3, 1e9)], "i int, v float").withColumn("h", to_half("v"))
    assert [(r.h, r.b) for r in df.select("i", "h", from_half("h").alias("b")).orderBy("i").collect()] == [(bytearray(b"\x00\x3e"), 1.5), (None, None), (bytearray(b"\x00\x7c"), float("inf"))]
    assert df.where("v is null").select(from_half("h").alias("b")).where(F.col("b").isNotNull()).count() == 0
