"""The pipeline against a brute-force version on a small fixture."""

import re

import corpus_pipeline
import pyarrow as pa
from test_operators import MODEL, base, linked_components, prose, word_sets

from sablevec.llm import common, langid, sp_codec

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def fixture(spark, folder):
    leak = prose(50, 30)
    texts = [prose(i, 60) for i in range(12)]
    texts += [texts[0], texts[1] + " tail", None, "12 34 !!", "", prose(60, 40) + " " + leak, prose(61, 30) + " token = 'abcdef0123' " + prose(62, 20), leak, prose(63, 5)]
    rows = [(i, t, None if i == 3 else "en", f"src{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(7, leak)], "item_id bigint, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return rows, leak


def expected(rows, leak):
    kept = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    labels = linked_components(word_sets([r[1] for r in kept]))
    kept = [r for i, r in enumerate(kept) if labels[i] == i]
    words = [w.lower() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", leak)]
    windows = {tuple(words[i : i + 10]) for i in range(len(words) - 9)}

    def clean(t):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)]
        return not any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9))

    out = {}
    for d, t, *_ in kept:
        if clean(t):
            for s, _, e, _ in reversed(base(t)):
                t = t[:s] + "[SECRET]" + t[e:]
            out[d] = t
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    rows, leak = fixture(spark, str(tmp_path))
    want = expected(rows, leak)
    assert 18 in want and "[SECRET]" in want[18] and not {12, 13, 14, 15, 16, 17, 19} & set(want)
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(found) == set(want)
    assert [found[d].ids for d in sorted(want)] == sp_codec._codec(sp_codec.load(spark, MODEL)).library.encode([want[d] for d in sorted(want)])
    assert found[3].lang == "en" and all(r.exact for r in found.values())


def test_stages_keep_columns_and_survive_empty_tables(spark, tmp_path):
    fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id < 0")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == COLUMNS


def test_each_stage_lets_executors_give_heap_back(spark, tmp_path):
    fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id < 0")
    beans = [b for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if not re.search("Young|Copy|Concurrent", b.getName())]
    for _, stage in corpus_pipeline.STAGES:
        whole = sum(b.getCollectionCount() for b in beans)
        stage(spark, docs, str(tmp_path))
        assert sum(b.getCollectionCount() for b in beans) > whole


def test_a_worker_drops_the_tokenizer_when_another_operator_reads(spark):
    batch = pa.record_batch({"t": ["a text"]})
    sp_codec.encode(sp_codec.load(spark, MODEL), ["a text"])
    list(common.pieces(batch, "t", owner="sp_codec"))
    assert sp_codec._codec.cache_info().currsize == 1
    list(common.pieces(batch, "t"))
    assert sp_codec._codec.cache_info().currsize == 0


def test_training_starts_no_workers_for_the_languages(spark, monkeypatch):
    def parallelize(*args):
        raise AssertionError("rows of a list go through Python workers")

    docs = spark.sql("SELECT id AS doc_id, if(id % 2 = 0, 'the house', 'das haus') AS text, if(id % 2 = 0, 'en', 'de') AS lang FROM range(20)")
    with monkeypatch.context() as m:
        m.setattr(type(spark.sparkContext), "parallelize", parallelize)
        model = langid.fit(docs)
    assert model["langs"] == ["de", "en"]
    assert {(r.text, r.lang_pred) for r in langid.predict(docs, model, keep=("text",)).collect()} == {("the house", "en"), ("das haus", "de")}
