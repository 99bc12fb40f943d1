"""Column functions on sparse vectors kept as parallel arrays, and on packed postings."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def norm(values: str | Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x))


def dot(components_a, values_a, components_b, values_b) -> Column:
    """Inner product of two sparse vectors; the order of components doesn't matter."""
    b = F.map_from_arrays(components_b, values_b)
    return F.aggregate(F.zip_with(components_a, values_a, lambda c, v: F.struct(c.alias("c"), v.alias("v"))), F.lit(0.0), lambda a, x: a + x.v * F.coalesce(b[x.c].cast("double"), F.lit(0.0)))


def dense(components, values, dim: int) -> Column:
    m = F.map_from_arrays(components, values)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)))


def is_sorted(components: str) -> Column:
    return F.array_sort(components) == F.col(components)


def is_strict(components: str) -> Column:
    return is_sorted(components) & (F.size(F.array_distinct(components)) == F.size(components))


def is_valid(components: str, values: str) -> Column:
    """As many components as values, at least one, in order."""
    return (F.size(components) == F.size(values)) & (F.size(components) > 0) & is_sorted(components)


def pack(offset: str, length: str) -> Column:
    """Offset (below 2**47) and length (below 2**16) in one bigint."""
    return F.shiftleft(F.col(offset).cast("bigint"), 16).bitwiseOR(F.col(length).cast("bigint"))


def packed_offset(packed: str) -> Column:
    return F.shiftrightunsigned(packed, 16)


def packed_length(packed: str) -> Column:
    return F.col(packed).bitwiseAND(F.lit(65535))


#: SQL functions over (components, values) arrays, by name.
SQL = {
    "sv_norm": "(v ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(aggregate(v, 0D, (a, x) -> a + x * x))",
    "sv_dot": "(ca ARRAY<INT>, va ARRAY<DOUBLE>, cb ARRAY<INT>, vb ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(arrays_zip(ca, va), 0D, (a, x) -> a + x.va * coalesce(try_element_at(map_from_arrays(cb, vb), x.ca), 0D))",
    "sv_topk": "(c ARRAY<INT>, v ARRAY<DOUBLE>, n INT) RETURNS ARRAY<INT> RETURN transform(slice(array_sort(arrays_zip(c, v), (l, r) -> case when l.v > r.v or (l.v = r.v and l.c < r.c) then -1 when l.v = r.v and l.c = r.c then 0 else 1 end), 1, n), x -> x.c)",
}


def register_sql(spark: SparkSession) -> None:
    for name, body in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
