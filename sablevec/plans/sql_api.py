"""An index as SQL views and a table function."""

from __future__ import annotations

from sablevec.functions.vectors import register_sql
from sablevec.plans.sparse_index import SparseIndex


def register(index: SparseIndex, name: str = "sv") -> None:
    """Views ``<name>_docs``, ``<name>_blocks`` and ``<name>_summary``, the vector functions, and
    ``<name>_search(components, values, k)``: a table of (d, score, rank), the k best live documents."""
    spark = index.docs.sparkSession
    register_sql(spark)
    index.live().createOrReplaceTempView(f"{name}_docs")
    index.blocks.createOrReplaceTempView(f"{name}_blocks")
    index.summary.createOrReplaceTempView(f"{name}_summary")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}_search(components ARRAY<INT>, weights ARRAY<DOUBLE>, k INT)
        RETURNS TABLE (d BIGINT, score DOUBLE, rank INT)
        RETURN SELECT d, score, rank FROM (
            SELECT d, score, row_number() OVER (ORDER BY round(score, 9) DESC, d) AS rank FROM (
                SELECT p.d, sum(p.v * q.w) AS score FROM {name}_docs p
                JOIN (SELECT col.components AS c, col.weights AS w FROM (SELECT explode(arrays_zip({name}_search.components, {name}_search.weights)) AS col)) q ON q.c = p.c GROUP BY p.d))
        WHERE rank <= {name}_search.k""")
