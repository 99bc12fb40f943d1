"""The index under a stream of changes (op, d, components, values)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sablevec.plans.sparse_index import SparseIndex


def last_changes(batch: DataFrame) -> DataFrame:
    """The last change of each document in a batch (by ``seq``)."""
    w = Window.partitionBy("d").orderBy(F.desc("seq"))
    return batch.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def apply_changes(index: SparseIndex, batch: DataFrame) -> SparseIndex:
    """Inserts of new documents and deletes; an insert of a known document is left alone, as ids are never reused."""
    last = last_changes(batch)
    dead = last.where("op = 'delete'").select("d")
    new = last.where("op = 'insert'").select("d", F.inline(F.arrays_zip("components", "values")).alias("c", "v"))
    new = new.select("d", "c", F.col("v").cast("double").alias("v")).join(index.docs.select("d").distinct(), "d", "left_anti")
    out = index.insert(new) if new.limit(1).count() else index
    return out.delete(dead) if dead.limit(1).count() else out


class LiveIndex:
    """Keeps the current index of a stream; pass ``update`` to ``writeStream.foreachBatch``. A batch that is run
    again, as after a failure, changes nothing more."""

    def __init__(self, index: SparseIndex):
        self.index, self.done = index, -1

    def update(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id > self.done:
            self.index, self.done = apply_changes(self.index, batch.persist()), batch_id
            batch.unpersist()
