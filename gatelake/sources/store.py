"""The event store on disk: events and their evidence by site and day of the event, merged by id.

Every load writes what it touches into folders of its own, and a manifest tells which load holds a table's rows of a site
and day. A load merges the touched sites and days with what the manifest shows of them and then publishes the next
manifest: one small file, whose creation fails if another writer was first. Until then readers see the old state whole,
afterwards the new one. Rows of other sites, days and loads are never rewritten.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelake.operators import search
from gatelake.operators.ordered import join_null_safe
from gatelake.session import materialize

TABLES = ("events", "detections", "ocr", "snapshots")
PLACE = ["site_id", "day"]
DIGESTS = "zstd"  # halves ids of hexadecimal digits, which the default codec leaves as they are
_MANIFEST = "name string, load string, site_id string, day date"


@dataclass(frozen=True)
class StoredEvents:
    """The tables of a stored event store; every row has the ``day`` of its event."""

    events: DataFrame
    detections: DataFrame
    ocr: DataFrame
    snapshots: DataFrame


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _published(spark: SparkSession, path: str) -> int:
    """Number of the newest manifest, 0 if there is none."""
    files, folder = _hadoop(spark, f"{path}/manifest")
    if not files.exists(folder):
        return 0
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return max((int(n) for n in names if n.isdigit()), default=0)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(name, load, site_id, day): where the rows of the store are, now or as of an earlier manifest."""
    version = version or _published(spark, path)
    if version == 0:
        return spark.createDataFrame([], _MANIFEST)
    load = spark.read.text(f"{path}/manifest/{version}").first().value
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/rows-{load}")


def _publish(spark: SparkSession, path: str, version: int, load: str) -> None:
    files, target = _hadoop(spark, f"{path}/manifest/{version}")
    out = files.create(target, False)
    out.write(bytearray(load, "utf-8"))
    out.close()


def _table(spark: SparkSession, path: str, name: str, since=None, until=None, sites: Sequence[str] | None = None,
           places: DataFrame | None = None) -> DataFrame | None:
    """Current rows of a table; the days, sites and places asked for prune the folders. None while there are none."""
    def asked(df: DataFrame) -> DataFrame:
        if since is not None:
            df = df.where(F.col("day") >= F.lit(since).cast("date"))
        if until is not None:
            df = df.where(F.col("day") <= F.lit(until).cast("date"))
        return df if sites is None else df.where(F.col("site_id").isin(list(sites)))

    live = manifest(spark, path).where(F.col("name") == name).drop("name")
    if live.isEmpty():
        return None
    live = asked(live)
    if places is not None:
        live = join_null_safe(live, places, PLACE)
    files, schema = f"{path}/{name}", spark.read.text(f"{path}/{name}-schema").first().value
    kept = T.StructType.fromJson(json.loads(schema))
    rows = asked(spark.read.schema(T.StructType(kept.fields + T.StructType.fromDDL("load string, site_id string, day date").fields))
                 .option("basePath", files).parquet(files))
    return join_null_safe(rows, live.select("load", *PLACE), ["load", *PLACE]).drop("load")


def _merged(new: DataFrame, old: DataFrame | None, rank) -> DataFrame:
    """One row per site and id: the one of the highest rank, of equal ones the stored one."""
    both = new.withColumn("_stored", F.lit(0))
    if old is not None:
        both = both.unionByName(old.select(*new.columns).withColumn("_stored", F.lit(1)))
    rest = [c for c in new.columns if c not in ("site_id", "id")]
    best = both.groupBy("site_id", "id").agg(F.max_by(F.struct(*rest), F.struct(rank.alias("rank"), "_stored")).alias("_best"))
    return best.select(*(F.col(c) if c in ("site_id", "id") else F.col(f"_best.{c}").alias(c) for c in new.columns))


def _one_each(rows: DataFrame, given: DataFrame, rank) -> DataFrame:
    """``_merged`` for rows that have nothing stored to merge with, none of which is in ``rows`` more often than in ``given``.

    Ids seldom repeat inside a load. Hashes of them tell which may, and only the rows of those go through the grouping.
    """
    key = F.xxhash64("site_id", "id").alias("_key")
    again = materialize(given.select(key).groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key"), "store-again")
    if again.isEmpty():
        return rows
    keyed = rows.select("*", key)
    several = _merged(keyed.join(again, "_key", "left_semi").drop("_key"), None, rank)
    return keyed.join(again, "_key", "left_anti").drop("_key").unionByName(several)


def write_events(events: DataFrame, detections: DataFrame, ocr: DataFrame, snapshots: DataFrame, path: str,
                 files_per_day: int = 8) -> None:
    """Merge events and their evidence into the store below a folder.

    Rows are the same if site and id are. A confirmed event replaces one that needs review, otherwise what is stored stays,
    so writing rows again changes nothing. Evidence is filed under the site and day of its event, even if its own time is
    past midnight; the event is looked up among those given and, for evidence that comes later, among those stored.
    """
    spark = events.sparkSession
    before = _published(spark, path)
    load = uuid.uuid4().hex
    filed_events = materialize(events.withColumn("day", F.to_date("timestamp")), "store-events", DIGESTS)
    known = filed_events.select("site_id", F.col("id").alias("event_id"), "day")
    if (stored := _table(spark, path, "events")) is not None:
        known = known.unionByName(stored.select("site_id", F.col("id").alias("event_id"), "day"))
    known = materialize(known.dropDuplicates(["site_id", "event_id"]), "store-days", DIGESTS)
    filed = materialize(detections.join(known, ["site_id", "event_id"]), "store-detections", DIGESTS)
    of_detection = filed.select("site_id", F.col("id").alias("detection_id"), "day")
    if (stored := _table(spark, path, "detections")) is not None:
        of_detection = of_detection.unionByName(stored.select("site_id", F.col("id").alias("detection_id"), "day"))
    of_detection = of_detection.dropDuplicates(["site_id", "detection_id"])  # by the keys of the join, so without a shuffle of its own
    given = {"events": filed_events, "detections": filed, "ocr": ocr, "snapshots": snapshots}
    tables = {
        "events": (filed_events, F.when(F.col("status") == "CONFIRMED", 2).otherwise(1), ["gate_id", "container_number"]),
        "detections": (filed, F.lit(0), ["camera_id", "event_id"]),
        "ocr": (ocr.join(of_detection, ["site_id", "detection_id"]), F.lit(0), ["detection_id"]),
        "snapshots": (snapshots.join(known, ["site_id", "event_id"]), F.lit(0), ["event_id"]),
    }
    touched = []
    # The first load has nothing to merge with: its evidence is where its events are.
    places = materialize(filed_events.select(*PLACE).distinct(), "store-places")
    for name, (rows, rank, order) in tables.items():
        if before > 0:
            rows = rows if name == "events" else materialize(rows, f"store-{name}", DIGESTS)
            places = materialize(rows.select(*PLACE).distinct(), "store-places")
        old = _table(spark, path, name, places=places)
        merged = _one_each(rows, given[name], rank) if old is None else _merged(rows, old, rank)
        dealt = merged.repartition(*PLACE, F.pmod(F.xxhash64("site_id", "id"), F.lit(files_per_day)))
        dealt.sortWithinPartitions(*PLACE, *order).write.partitionBy(*PLACE).option("compression", DIGESTS).parquet(
            f"{path}/{name}/load={load}")
        if before == 0:
            plain = T.StructType([f for f in merged.schema.fields if f.name not in PLACE])
            spark.createDataFrame([(plain.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}-schema")
        touched.append(places.select(F.lit(name).alias("name"), F.lit(load).alias("load"), *PLACE))
    fresh = reduce(DataFrame.union, touched)
    old = join_null_safe(manifest(spark, path), fresh.select("name", *PLACE).withColumn("_new", F.lit(True)), ["name", *PLACE], "left")
    old.where("_new is null").select("name", "load", *PLACE).union(fresh).coalesce(1).write.parquet(f"{path}/manifest/rows-{load}")
    _publish(spark, path, before + 1, load)


def read_events(spark: SparkSession, path: str, since: str | None = None, until: str | None = None,
                sites: Sequence[str] | None = None) -> StoredEvents:
    """The stored tables, or the days from ``since`` to ``until``, both included, and the ``sites`` of them."""
    return StoredEvents(*(_table(spark, path, name, since, until, sites) for name in TABLES))


def search_page(spark: SparkSession, path: str, limit: int = 50, after: tuple | None = None, sizes: bool = True,
                sites: Sequence[str] | None = None, **filters) -> tuple[DataFrame, tuple | None]:
    """A page of stored events, newest first, and the cursor of the next page (None at the end).

    ``after`` is the cursor of the page before: (timestamp, id, site_id) of its last row. Days are read from the cursor's
    own backwards, one, two, four at a time, until the page is full, so a late page reads as few days as the first.
    """
    limit, _ = search._checked(limit, 0)
    days = manifest(spark, path).where("name = 'events'")
    if sites is not None:
        days = days.where(F.col("site_id").isin(list(sites)))
    if after is not None:
        days = days.where(F.col("day") <= F.lit(after[0]).cast("date"))
    left = [r.day for r in days.select("day").distinct().orderBy(F.desc("day")).collect()]  # one per day of the calendar
    rows, step, read = [], 1, []
    order = [F.desc("timestamp"), "id", "site_id"]
    while left and len(rows) < limit:
        span, left, step = left[:step], left[step:], step * 2
        read += span
        stored = read_events(spark, path, span[-1], span[0], sites)
        found = search.matching_events(stored.events, stored.detections, **filters)
        if after is not None:
            at, last_id, last_site = F.lit(after[0]).cast("timestamp_ntz"), F.lit(after[1]), F.lit(after[2])
            found = found.where((F.col("timestamp") < at) | ((F.col("timestamp") == at) & (
                (F.col("id") > last_id) | ((F.col("id") == last_id) & (F.col("site_id") > last_site)))))
        rows += found.orderBy(*order).limit(limit - len(rows)).collect()  # a page at most
        schema = found.schema
    if not rows:
        stored = read_events(spark, path)
        page = stored.events.limit(0)
        return (search.with_sizes(page, stored.detections, stored.ocr) if sizes else page), None
    page = spark.createDataFrame(rows, schema)
    cursor = (rows[-1].timestamp, rows[-1].id, rows[-1].site_id) if len(rows) == limit else None
    if sizes:
        shown = read_events(spark, path, min(r.day for r in rows), max(r.day for r in rows), sites)
        page = search.with_sizes(page, shown.detections, shown.ocr)
    return page, cursor


@functools.lru_cache(maxsize=8)
def _derived(application: str, sf_dir: str) -> list:
    return []


def kept_store(spark: SparkSession, sf_dir: str, build) -> str:
    """Path of a store that ``build`` writes once per application and input; later queries only read it."""
    paths = _derived(spark.sparkContext.applicationId, sf_dir)
    if not paths or _published(spark, paths[0]) == 0:
        paths[:] = [build()]
    return paths[0]
