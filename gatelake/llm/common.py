"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.session import materialize, work_dir

__all__ = ["bounded_broadcast", "crc32_sql", "drop_table", "keep", "keep_bucketed", "materialize", "read_table", "sent_if_small",
           "small_batches", "small_table", "work_dir"]

#: Rows up to which a table is sent to every executor instead of shuffled: of a few numbers each, and of short texts or lists.
BROADCAST_ROWS, BROADCAST_WIDE_ROWS = 2_000_000, 200_000
#: Bytes on disk up to which a table is sent to every executor.
BROADCAST_BYTES = 16 << 20
#: Bytes in memory up to which a table is sent, and what a row of a hash table takes besides its values. The driver holds such
#: a table as it was collected, as hash table and as it is sent, all at once, and files may be a tenth of it.
BROADCAST_HELD, ROW_HELD = 96 << 20, 80


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_broadcast(stored: DataFrame, wide: bool = False) -> DataFrame:
    """Mark a stored table for broadcast if its counted rows are within the bound; else leave it to a shuffle."""
    return F.broadcast(stored) if stored.count() <= (BROADCAST_WIDE_ROWS if wide else BROADCAST_ROWS) else stored


def small_table(stored: DataFrame) -> DataFrame:
    """Mark a stored table for broadcast if its files have at most BROADCAST_BYTES; else leave it to a shuffle."""
    size = int(str(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(stored) if size <= BROADCAST_BYTES else stored


def sent_if_small(stored: DataFrame, values: Column, bound: int | None = None) -> DataFrame:
    """Mark a stored table for broadcast if its rows, of so many bytes of ``values`` each, fit the bound; else for a shuffle."""
    held = stored.agg(F.sum(values + ROW_HELD)).first()[0] or 0
    return F.broadcast(stored) if held <= (BROADCAST_HELD if bound is None else bound) else stored.hint("merge")


def small_batches(df: DataFrame) -> DataFrame:
    """Let Spark hand whole texts to Python a thousand at a time, if the session has no setting of its own."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if conf.get(name, "10000") == "10000":
        conf.set(name, "1000")
    return df


def keep(df: DataFrame, name: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """Write a table to the shared folder; the rows read back and the path, for drop_table."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def keep_bucketed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Like ``keep``, dealt out by the keys: joins on them shuffle the other side only."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a stored table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def crc32_sql(digits: str) -> str:
    """CRC-32 of the decimal digits of a number, bit by bit, for engines without the function."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    codes = f"list_transform(range(1, len({digits}) + 1), lambda i: CAST(ascii(substr({digits}, i, 1)) AS BIGINT))"
    bits = f"list_reduce(list_concat([xor(crc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: {step})"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda crc, b: {bits}), 4294967295)"
