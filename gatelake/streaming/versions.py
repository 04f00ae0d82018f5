"""Tables of versions: every change is appended with its version, readers see the last one of each key.

A micro-batch writes its versions into a folder of its own, which a repeated batch overwrites. Compaction writes the last
version of every key of all batches up to one into a base folder; readers take the newest base that is complete and the
batches after it, so they may run at any time, and only then the folders that the base replaces are removed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _folders(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the complete folders ``prefix=number`` below a path."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(top):
        return []
    names = [s.getPath() for s in files.listStatus(top) if s.getPath().getName().startswith(f"{prefix}=")]
    done = [p.getName() for p in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in done)


def put(batch: DataFrame, path: str, batch_id: int) -> None:
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def _all(spark: SparkSession, path: str, schema: T.StructType, upto: int | None = None) -> DataFrame:
    bases, batches = _folders(spark, path, "base"), _folders(spark, path, "batch_id")
    base = bases[-1] if bases else None
    parts = [f"{path}/base={base}"] if bases else []
    parts += [f"{path}/batch_id={b}" for b in batches if (base is None or b > base) and (upto is None or b <= upto)]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def _last(rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_last"))
    return last.select(*(F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in rows.columns))


def current(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], version: str = "version") -> DataFrame:
    """One row per key: its last version among all complete batches."""
    return _last(_all(spark, path, schema), keys, version)


def compact(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], version: str = "version") -> None:
    """Fold all complete batches into one base with a row per key, and remove what it replaces."""
    batches, bases = _folders(spark, path, "batch_id"), _folders(spark, path, "base")
    newest = max(batches, default=-1)
    if newest <= max(bases, default=-1):
        return
    _last(_all(spark, path, schema, newest), keys, version).write.mode("overwrite").parquet(f"{path}/base={newest}")
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in [f"batch_id={b}" for b in batches if b <= newest] + [f"base={b}" for b in bases]:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}"), True)
