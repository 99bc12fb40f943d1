"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings the plans are written for; none of them changes results.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # top-n per posting list keeps thousands of rows; the default stops at 1000
    "spark.sql.optimizer.windowGroupLimitThreshold": "20000",
    # whole texts cross to Python: smaller batches keep workers small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "2m",
}

#: Settings that a session's own ones override. Small tables of iterations become one file each instead of one per
#: core; partitions of more than this size stay as they are.
DEFAULTS = {
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
}


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where their path doesn't hold it yet."""
    root, sc = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_sablevec_shipped", False):
        return
    if sc.master.split("[")[0] == "local":
        sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, os.environ.get("PYTHONPATH", "")]))
    else:
        base = os.path.join(tempfile.mkdtemp(), "sablevec")
        sc.addPyFile(shutil.make_archive(base, "zip", root, "sablevec"))
    sc._sablevec_shipped = True


def configure(spark: SparkSession) -> SparkSession:
    ship(spark)
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    for key, value in DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def settle(spark: SparkSession) -> None:
    """Executors collect garbage and give the freed heap back to the system, as far as their JVM does: a heap stays as
    large as an earlier stage made it otherwise, beside the Python workers that share an executor's memory."""
    tasks = spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).selectExpr("reflect('java.lang.System', 'gc') AS done").collect()


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = tempfile.mkdtemp(prefix="sablevec-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later plans reuse it, and a lost executor costs no recomputation."""
    path = f"{scratch_root(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._scratch = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no later plan reads."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
