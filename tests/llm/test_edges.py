"""Every operator and stage on tables with clashing names, nulls in any column, repeated rows and very long texts."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_operators import MODEL, prose

from sablevec.llm import ann, decontam, html_extract, jaccard_join, langid, license_scan, pii, secrets, sp_codec, suffix_dedup
from sablevec.llm.common import CHUNK

#: Names that operators use inside.
CLASHES = """d t rid n cls k0 k1 k2 j1 j2 wanted found words kh ctx p s e b shard regions host path at k i v q query bound cell nth
lang_pred score w l part rows chars size id vh owner repo base generic live _row _found pii_found digest head sig h comp family
tile tiles copies component lead low high reached least other links mixed x item_id matches n_words n_hit ids exact parity
n_tokens licenses spans query_id rank kind r word""".split()
LEAK = prose(50, 30)


def rows():
    made = [prose(i, 60) for i in range(6)] + [None, "", "12 !!", LEAK + " " + prose(7, 9)]
    made += [prose(1, 60) + " end", prose(8, 20) + " password: hunter2hunter2 mail a.b@example.com", prose(9, 9) + " Zx9" + "aB3" * 8]
    made += ["Released under the MIT License. " + prose(10, CHUNK // 5), prose(1, 60)]
    out = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(made)]
    return [*out, out[1], out[1], (None, prose(2, 60), None, None, None), (None, None, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def plain(spark):
    df = spark.createDataFrame(rows(), "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert max(len(r[1] or "") for r in rows()) > CHUNK
    return df.coalesce(2)


@pytest.fixture(scope="module")
def clashing(plain):
    df = plain
    for i, c in enumerate(CLASHES):
        df = df.withColumn(c, F.lit(i) if i % 2 else F.lit(None).cast("string"))
    return df


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(7, LEAK), (7, LEAK), (None, LEAK), (8, None)], "item_id bigint, text string")


OPERATORS = {
    "op1": lambda df, bench: suffix_dedup.digest(df),
    "op2": lambda df, bench: pii.report(df, "key"),
    "op2 rows": lambda df, bench: pii.pseudonymise(df, "key").select("doc_id", "text"),
    "op3": lambda df, bench: license_scan.digest(license_scan.scan(df)),
    "op5": lambda df, bench: secrets.digest(secrets.scan(df)),
    "op5 rows": lambda df, bench: secrets.redact(df).select("doc_id", "text", "n_chars"),
    "op6": lambda df, bench: sp_codec.codec(df, sp_codec.load(df.sparkSession, MODEL), outputs=("n_tokens", "ids_sha256", "exact", "parity")),
    "op7": lambda df, bench: langid.predict(df, langid.fit(df)),
    "op9": lambda df, bench: jaccard_join.digest(df),
    "op9 rows": lambda df, bench: jaccard_join.keep_one(df).select("doc_id", "text"),
    "op10": lambda df, bench: decontam.digest(decontam.hits(df, bench, locate=True)),
    "op10 rows": lambda df, bench: decontam.clean(df, bench).select("doc_id", "text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_change_nothing(name, plain, clashing, bench):
    more = bench.withColumn("i", F.lit(1)).withColumn("t", F.lit(2)).withColumn("doc_id", F.lit(3))
    want, got = (sorted(map(repr, OPERATORS[name](df, b).collect())) for df, b in ((plain, bench), (clashing, more)))
    assert want == got
    # nulls and repeated rows are rows like others
    if "rows" not in name or name in ("op2 rows", "op5 rows"):
        assert len(got) == len(rows())
    assert OPERATORS[name](clashing.where("false"), bench).count() == 0


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_keep_clashing_columns(stage, plain, clashing, bench, tmp_path):
    spark = plain.sparkSession
    bench.coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    name, run = corpus_pipeline.STAGES[stage]
    want, got = (run(spark, df, str(tmp_path)) for df in (plain, clashing))
    if name != "sentencepiece":
        assert got.columns == clashing.columns
    assert sorted(map(repr, want.collect())) == sorted(map(repr, got.select(*want.columns).collect()))
    if name == "jaccard_join":
        kept = [r.doc_id for r in want.collect()]
        assert kept.count(1) == 1 and not {10, 14} & set(kept) and kept.count(None) == 3


def test_pages_and_vectors(spark):
    page = "<body><nav>menu</nav><div class=post><p>" + prose(1, 30) + "</p><p>" + prose(2, CHUNK // 5) + "</p></div></body>"
    pages = spark.createDataFrame([(1, "http://a/1", page), (1, "http://a/1", page), (2, None, None), (None, "http://a/2", ""), (3, "http://a/3", page)], "page_id bigint, url string, html string")
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i)]) for i in range(60)] + [(5, [5.0, 1.0, 5.0]), (None, [1.0, 2.0, 3.0]), (61, None)], "vec_id bigint, embedding array<double>")
    more = pages, vectors
    for i, c in enumerate(CLASHES):
        more = tuple(df.withColumn(c, F.lit(i) if i % 2 else F.lit(None).cast("string")) for df in more)
    want, got = (sorted(map(repr, html_extract.extract(df).collect())) for df in (pages, more[0]))
    assert want == got and sum(prose(2, CHUNK // 5)[:200] in r for r in got) == 3
    want, got = (sorted(map(repr, ann.search(df, df.where("vec_id % 20 = 0")).collect())) for df in (vectors, more[1]))
    assert want == got and len(got) == 30
