"""Session construction for tests and benchmarks, and the shared work folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", app: str = "gatelake", shuffle_partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A local session with the settings the library expects everywhere: UTC, AQE, RocksDB state."""
    return (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="gatelake-")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder the cluster shares between executors.

    The folder is whatever ``spark.checkpoint.dir`` names. Only a local session, where every task runs
    on this machine, may fall back to a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write the rows to the shared folder once and continue from the written table.

    Used where several branches need the result of an expensive stage: they then scan only the columns they
    use, no stage runs twice, and a lost executor costs a re-read instead of the whole lineage.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
