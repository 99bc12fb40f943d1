"""Global positions and running sums without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sablevec.session import materialise


def running_sum(df: DataFrame, by: str, value: str | None = None, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` (or the count) of all rows before each in the order of the unique column ``by``.

    Rows are dealt by range; only one total a range is ordered in one place.
    """
    v = F.col(value) if value else F.lit(1).cast("bigint")
    # written once: ranges are sampled, so a second evaluation could cut them elsewhere
    parts = materialise(df.withColumn("_v", v).repartitionByRange(by).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = parts.groupBy("_part").agg(F.sum("_v").alias("_total"))
    ahead = totals.withColumn("_ahead", F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_total")
    inside = F.coalesce(F.sum("_v").over(Window.partitionBy("_part").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = parts.withColumn("_inside", inside).join(F.broadcast(ahead), "_part")
    return out.withColumn(name, (F.col("_ahead") + F.col("_inside")).cast("bigint")).drop("_v", "_part", "_inside", "_ahead")


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """``df`` with positions from 0 in the order of the unique column ``by``."""
    return running_sum(df, by, None, name)
