"""Every registered search query against its DuckDB twin."""

import os

import duckdb
import pytest

from sablevec.plans import catalogue

SF = "/root/testdata/sf0.001"
#: Take longest; one of each kind stays below.
SLOW = {"kmeans_pruned_ii", "kmeans_exact", "ann_search_centroid_count", "skip_centroid_alpha", "skip_centroid_count", "ann_search_quantized", "churn_rounds", "batch_search"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def plain(rows):
    return sorted((tuple(round(x, 5) if isinstance(x, float) else str(x) for x in r) for r in rows), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - SLOW))
def test_twin(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    names = sorted(df.columns)
    rows = [tuple(r[n] for n in names) for r in df.collect()]
    if name not in catalogue.oracle_sql():
        assert rows
        return
    found = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    order = [columns.index(n) for n in names]
    assert sorted(columns) == names
    assert plain(rows) == plain(tuple(r[i] for i in order) for r in found.fetchall())
