"""Rows and documents that record the evidence behind events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelake.functions.clock import from_us, iso_z, to_us
from gatelake.functions.iso6346 import feet_size, stand_alone_size_code
from gatelake.operators.associate import stable_id
from gatelake.operators.ordered import bucket
from gatelake.params import micros

DETECTION_COLUMNS = ["site_id", "id", "event_id", "camera_id", "origin_key", "track_id", "class_name", "confidence",
                     "bbox", "timestamp"]


def evidence_keys(jobs: DataFrame, run_id: str) -> DataFrame:
    """Origin key, key of an additional detection, and the folder of the stored images.

    The folder is the SHA-256 of the JSON array of origin and sequence, with one blank after the comma.
    """
    origin = F.concat_ws(":", F.lit(run_id), "camera_id", F.substring("source_id", 1, 12), F.col("track_id"))
    quoted = F.regexp_replace(F.col("origin_key"), r'(["\\])', r"\\$1")
    return jobs.withColumn("origin_key", origin).select(
        "*",
        F.concat_ws(":", "origin_key", "class_name", F.col("x1").cast("int")).alias("extra_key"),
        F.sha2(F.concat(F.lit('["'), quoted, F.lit('", '), F.col("sequence"), F.lit("]")), 256).alias("folder"))


def evidence_rows(assignments: DataFrame) -> DataFrame:
    """Stored detections: the primary of each observation and the other classes seen on its frame.

    An additional detection is named by origin, class and left edge, and the first of a name is kept.
    """
    primary = assignments.select(
        "site_id", stable_id("detection", F.col("origin_key")).alias("id"), "event_id", "camera_id", "origin_key",
        "track_id", "class_name", F.col("detection_confidence").alias("confidence"), "bbox",
        F.col("frame_timestamp").alias("timestamp"))
    others = F.filter("all_detections", lambda x: x["class_name"] != F.col("class_name"))
    named = F.transform(others, lambda x: F.struct(
        F.concat_ws(":", "origin_key", x["class_name"], F.get(x["bbox"], F.lit(0)).cast("int")).alias("name"), x.alias("item")))
    # A name holds its origin, so only detections of one row can share it.
    names = F.transform(named, lambda x: x["name"])
    first = F.filter(named, lambda x, i: F.array_position(names, x["name"]) == i + 1)
    extra = assignments.select(
        "site_id", "event_id", "camera_id", "track_id", F.col("frame_timestamp").alias("timestamp"),
        F.explode(first).alias("_x")).select(
        "site_id", stable_id("detection", F.col("_x.name")).alias("id"), "event_id", "camera_id",
        F.col("_x.name").alias("origin_key"), "track_id", F.col("_x.item.class_name").alias("class_name"),
        F.col("_x.item.confidence").alias("confidence"), F.col("_x.item.bbox").alias("bbox"), "timestamp")
    return primary.select(DETECTION_COLUMNS).unionByName(extra.select(DETECTION_COLUMNS))


def ocr_rows(assignments: DataFrame) -> DataFrame:
    """The one stored OCR result of each observation."""
    return assignments.select(
        "site_id", stable_id("ocr", F.col("origin_key")).alias("id"),
        stable_id("detection", F.col("origin_key")).alias("detection_id"), "raw_text", "corrected_text",
        "normalized_text", "confidence", "valid_format", "valid_check_digit", "validation_status",
        F.col("frame_timestamp").alias("timestamp"))


def snapshot_manifest(assignments: DataFrame, companions: DataFrame | None = None) -> DataFrame:
    """One image per event, camera and track, the newest confirmed one; companion frames fill absent cameras."""
    rank = F.struct("confirmed", "frame_timestamp", "origin_key")
    best = assignments.groupBy("site_id", "event_id", "camera_id", "track_id").agg(F.max(rank).alias("_best"))
    taken = best.select(
        "site_id", stable_id("snapshot", F.col("event_id"), F.col("camera_id"), F.col("track_id")).alias("id"),
        "event_id", "camera_id",
        F.concat_ws("/", "event_id", "camera_id", F.concat("track_id", F.lit(".jpg"))).alias("image_path"),
        F.col("_best.frame_timestamp").alias("timestamp"))
    if companions is None:
        return taken
    absent = companions.join(taken.select("site_id", "event_id", "camera_id"), ["site_id", "event_id", "camera_id"],
                             "left_anti")
    first = absent.groupBy("site_id", "event_id", "camera_id").agg(F.min("timestamp").alias("timestamp")).select(
        "site_id", stable_id("companion", F.col("event_id"), F.col("camera_id")).alias("id"), "event_id", "camera_id",
        F.concat_ws("/", "event_id", F.concat("camera_id", F.lit(".jpg"))).alias("image_path"), "timestamp")
    return taken.unionByName(first)


def companion_frames(events: DataFrame, frames: DataFrame, tolerance_seconds: float = 5.0) -> DataFrame:
    """For each event and each other view of its lane the frame nearest in time, the earlier of two equally near ones.

    ``frames`` has (site_id, gate_id, camera_id, frame_timestamp). Events and frames meet in time buckets as wide as the
    tolerance, so a lane is spread over its buckets; a view without a frame in reach gives no row.
    """
    width = micros(tolerance_seconds)
    own = events.select("site_id", "gate_id", F.col("id").alias("event_id"), to_us(F.col("timestamp")).alias("_event_us"))
    own = own.withColumn("_bucket", F.explode(F.transform(
        F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: bucket(F.col("_event_us"), width) + i)))
    shown = frames.select("site_id", "gate_id", "camera_id", to_us(F.col("frame_timestamp")).alias("_us")).distinct().withColumn(
        "_bucket", bucket(F.col("_us"), width))
    apart = F.abs(F.col("_us") - F.col("_event_us"))
    near = own.join(shown, ["site_id", "gate_id", "_bucket"]).where(apart <= width)
    nearest = near.groupBy("site_id", "event_id", "camera_id").agg(F.min(F.struct(apart.alias("apart"), "_us")).alias("_best"))
    return nearest.select("site_id", "event_id", "camera_id", from_us(F.col("_best._us")).alias("timestamp"))


def audit_log(assignments: DataFrame) -> DataFrame:
    """One INFO row per observation."""
    return assignments.select(
        "site_id", stable_id("log", F.col("origin_key")).alias("id"), "event_id",
        F.col("frame_timestamp").alias("timestamp"), F.lit("INFO").alias("level"),
        F.when(F.col("created"), "gate_event_created").otherwise("gate_evidence_associated").alias("event_name"),
        F.create_map(F.lit("camera_id"), "camera_id", F.lit("gate_id"), "gate_id").alias("context"))


def fk_violations(cameras: DataFrame, events: DataFrame, detections: DataFrame, ocr: DataFrame, snapshots: DataFrame,
                  logs: DataFrame, detection_parents: DataFrame | None = None) -> DataFrame:
    """(site_id, id, key, relation) of every row whose reference names nothing; a null reference names nothing wrongly.

    ``detection_parents`` are the detections that reads may refer to, all of them if not given.
    """
    parents = {"camera_id": cameras.select("site_id", F.col("camera_id").alias("key")),
               "event_id": events.select("site_id", F.col("id").alias("key")),
               "detection_id": (detection_parents or detections).select("site_id", F.col("id").alias("key"))}
    result = None
    for name, table, column in (
            ("detections", detections, "camera_id"), ("detections", detections, "event_id"), ("ocr_results", ocr, "detection_id"),
            ("snapshots", snapshots, "event_id"), ("snapshots", snapshots, "camera_id"), ("system_logs", logs, "event_id")):
        broken = (table.where(F.col(column).isNotNull()).select("site_id", "id", F.col(column).alias("key"))
                  .join(parents[column], ["site_id", "key"], "left_anti")
                  .select("site_id", "id", "key", F.lit(f"{name}.{column}").alias("relation")))
        result = broken if result is None else result.unionByName(broken)
    return result


def orphan_images(files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Files nothing refers to, and references without a file; both sides are reduced to distinct paths first."""
    stored = files.select("site_id", F.col("path").alias("image_path")).distinct().withColumn("stored", F.lit(True))
    named = snapshots.select("site_id", "image_path").distinct().withColumn("named", F.lit(True))
    both = stored.join(named, ["site_id", "image_path"], "full_outer")
    return both.where("stored is null or named is null").select(
        "site_id", "image_path",
        F.when(F.col("named").isNull(), "UNREFERENCED_FILE").otherwise("MISSING_FILE").alias("problem"))


def _sized_reads(ocr: DataFrame) -> DataFrame:
    """Reads with the size they show, its code, and their place in time; null where they show none."""
    size = F.coalesce(feet_size(F.col("normalized_text")), feet_size(F.col("corrected_text")))
    code = F.coalesce(stand_alone_size_code(F.col("normalized_text")), stand_alone_size_code(F.col("corrected_text")))
    sized = ocr.withColumn("_size", size)
    return sized.withColumn("_sized", F.when(F.col("_size").isNotNull(), F.struct(
        F.struct(F.col("timestamp"), F.col("id").alias("ocr_id")).alias("at"), F.col("_size").alias("size"),
        code.alias("code")))).drop("_size")


def event_sizes(detections: DataFrame, ocr: DataFrame, feet_label: str = "FEET") -> DataFrame:
    """Container size and size code per event, from its first read that parses, else from a feet detection."""
    parsed = _sized_reads(ocr).select("site_id", "detection_id", "_sized").where("_sized is not null")
    links = detections.select("site_id", F.col("id").alias("detection_id"), "event_id",
                              (F.lower("class_name") == "feet").alias("_feet"))
    grouped = links.join(parsed, ["site_id", "detection_id"], "left").groupBy("site_id", "event_id").agg(
        F.min("_sized").alias("_first"), F.bool_or("_feet").alias("_feet"))
    return grouped.select(
        "site_id", "event_id",
        F.coalesce(F.col("_first.size"), F.when(F.col("_feet"), F.lit(feet_label))).alias("container_size"),
        F.col("_first.code").alias("size_code"))


def event_documents(events: DataFrame, detections: DataFrame, ocr: DataFrame, snapshots: DataFrame,
                    slice_seconds: int = 3600) -> DataFrame:
    """One nested document per event with its evidence in (time, id) order and ISO times.

    Evidence is filed by its time since the event in slices of fixed length, so a detection, its read and its image
    are in the same document, and an ordinary event, whose evidence is seconds apart, is one document, part 0. All
    evidence goes through one grouping: it is put together in one table of tagged rows first.
    """
    def tagged(rows: DataFrame, name: str, fields: list[str], *more) -> DataFrame:
        return rows.select("site_id", "event_id", F.col("timestamp").alias("_at"),
                           F.struct("timestamp", "id", *fields).alias(name), *more)

    fields = {
        "detections": ["camera_id", "origin_key", "track_id", "class_name", "confidence", "bbox"],
        "ocr_results": ["detection_id", "raw_text", "normalized_text", "confidence", "valid_format", "valid_check_digit",
                        "validation_status"],
        "snapshots": ["camera_id", "image_path"],
    }
    links = detections.select("site_id", F.col("id").alias("detection_id"), "event_id")
    reads = _sized_reads(ocr).join(links, ["site_id", "detection_id"])
    rows = tagged(detections, "detections", fields["detections"], (F.lower("class_name") == "feet").alias("_feet"))
    rows = rows.unionByName(tagged(reads, "ocr_results", fields["ocr_results"], "_sized"), allowMissingColumns=True)
    rows = rows.unionByName(tagged(snapshots, "snapshots", fields["snapshots"]), allowMissingColumns=True)
    heads = events.select(
        "site_id", F.col("id").alias("event_id"), "gate_id", "timestamp", "container_number", "event_type", "status")
    placed = heads.join(rows, ["site_id", "event_id"], "left").withColumn("part", F.coalesce(F.floor(
        F.abs(to_us(F.col("_at")) - to_us(F.col("timestamp"))) / (slice_seconds * 1_000_000)), F.lit(0)).cast("int"))
    single = ["gate_id", "timestamp", "container_number", "event_type", "status"]
    parts = placed.groupBy("site_id", "event_id", "part").agg(
        *[F.first(c).alias(c) for c in single], F.min("_sized").alias("_sized"),
        F.bool_or(F.coalesce("_feet", F.lit(False))).alias("_feet"),
        *[F.sort_array(F.collect_list(name)).alias(name) for name in fields])
    event = Window.partitionBy("site_id", "event_id")
    size = F.min("_sized").over(event)
    whole = parts.withColumn("_sized", size).withColumn("_feet", F.max("_feet").over(event))

    def shown(name: str):
        return F.transform(name, lambda i: F.struct(
            iso_z(i["timestamp"]).alias("timestamp"), i["id"].alias("id"), *[i[f].alias(f) for f in fields[name]])).alias(name)

    return whole.select(
        "site_id", "event_id", "gate_id", iso_z(F.col("timestamp")).alias("timestamp"), "container_number", "event_type",
        "status", F.to_date("timestamp").alias("event_date"),
        F.coalesce(F.col("_sized.size"), F.when(F.col("_feet"), F.lit("FEET DETECTED"))).alias("container_size"),
        F.col("_sized.code").alias("size_code"), "part", *[shown(name) for name in fields])


def write_event_documents(documents: DataFrame, path: str, load: str = "all") -> None:
    """JSON lines by event day and load. A load that is written again replaces itself on its days, and nothing else."""
    dealt = documents.withColumn("load", F.lit(load)).repartition("event_date", F.pmod(F.xxhash64("event_id"), F.lit(64)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date", "load").json(path)


def event_table_rows(events: DataFrame) -> DataFrame:
    """Display columns of the event list."""
    size = F.when(F.col("size_code").isNotNull() & F.col("container_size").isNotNull(),
                  F.concat("container_size", F.lit(" ("), "size_code", F.lit(")"))).otherwise(F.col("container_size"))
    return events.select(
        "site_id", "id", "timestamp", "gate_id", "event_type",
        F.coalesce("container_number", F.lit("Unread / unconfirmed")).alias("container"),
        F.coalesce(size, F.lit("—")).alias("size"), F.replace("status", F.lit("_"), F.lit(" ")).alias("status_text"))
