"""Gate tables derived from the star-schema tables a session is given.

All rules use integer arithmetic, so any SQL engine derives the same rows. Each derivation is one
projection over one scan: nothing is shuffled and only the columns used are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.functions.iso6346 import check_digit

# Start of the derived timelines (UTC) in epoch microseconds, and owner codes.
READS_EPOCH_US = 1_767_225_600_000_000  # 2026-01-01
DETECTIONS_EPOCH_US = 1_769_904_000_000_000  # 2026-02-01
OWNERS = ("CSQU", "MSCU", "GXYU", "MSKU", "TCLU")
RUN_ID = "run0"
READS_PER_TASK = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ntz(us: str) -> str:
    return f"cast(timestamp_micros({us}) as timestamp_ntz)"


def reads_of(lineitem: DataFrame) -> DataFrame:
    """OCR reads: an order is a track, a line is one read of it; four views share a lane and a number."""
    keyed = lineitem.selectExpr(
        "l_orderkey as track_id", "l_orderkey div 8 as g", "l_orderkey % 8 as cam",
        "(l_orderkey div 8) % 400 as v", "cast(l_linenumber as bigint) as sequence",
        "l_partkey * 1000000 + l_suppkey as arrival", "l_partkey % 12 as style",
        "(100 - 5 * cast(round(100 * l_discount) as int)) / 100D as confidence")
    owners = ", ".join(f"'{o}'" for o in OWNERS)
    placed = keyed.selectExpr(
        "*", "concat('S', g % 4) as site_id",
        "if(cam < 4, concat('gate-in-', cam + 1), concat('gate-out-', cam - 3)) as camera_id",
        "if(cam < 4, 'lane-in', 'lane-out') as gate_id", "if(cam < 4, 'ENTRY', 'EXIT') as direction",
        f"{READS_EPOCH_US} + g * 4000000 + (g div 200) * 60000000 + cam * 700000 as start_us",
        f"get(array({owners}), cast(v % 5 as int)) as owner",
        "lpad(cast((v * 7919) % 1000000 as string), 6, '0') as serial")
    numbered = placed.withColumn("digit", check_digit(F.concat("owner", "serial")))
    return numbered.selectExpr(
        "site_id", "camera_id", "gate_id", "direction",
        "concat_ws(':', site_id, camera_id, 'src0', track_id) as origin_key", "track_id", "sequence",
        f"{ntz('start_us + sequence * 1000000')} as frame_timestamp", f"{ntz('start_us')} as started_at", "arrival",
        """case style
             when 0 then concat(owner, serial, (digit + 1) % 10)
             when 1 then concat(owner, 'O', substr(serial, 2), digit)
             when 2 then concat('ID: ', owner, ' ', serial, ' ', digit)
             when 3 then concat(owner, ' ', serial)
             when 4 then lower(concat(owner, '-', serial, '-', digit))
             when 5 then concat(owner, serial, digit, ' MSCU6639870')
             when 6 then '45C1'
             when 7 then concat(owner, serial, digit, ' 40 FT')
             when 8 then concat(replace(owner, 'G', 'C'), serial, digit)
             else concat(owner, serial, digit) end as raw_text""",
        "confidence")


def raw_detections_of(events: DataFrame) -> DataFrame:
    """Detector output: an event is a frame; 'error' frames show feet as well, 'signup' frames show nothing."""
    keyed = events.selectExpr("event_id div 8 as n", "event_id % 8 as cam", "user_id", "event_type")
    placed = keyed.selectExpr(
        "concat('S', (n div 100) % 4) as site_id",
        "if(cam < 4, concat('gate-in-', cam + 1), concat('gate-out-', cam - 3)) as camera_id",
        "concat('src', n div 700) as source_id", "n as sequence",
        f"{ntz(f'{DETECTIONS_EPOCH_US} + n * 200000 + (n div 100) * 8000000')} as frame_timestamp",
        "if((n div 40) % 4 = 3, 'Truck', 'Cointainer') as label", "event_type", "user_id",
        "cast(20 + (n * 6 + user_id % 3) % 400 as double) as x", "cast(40 + 5 * cam as double) as y")
    boxes = placed.selectExpr(
        "site_id", "camera_id", "source_id", "sequence", "frame_timestamp", "640 as width", "360 as height",
        "named_struct('det_index', 0, 'label', label, 'confidence', (30 + user_id % 70) / 100D, "
        "'x1', x, 'y1', y, 'x2', x + 160, 'y2', y + 90) as seen",
        "named_struct('det_index', 1, 'label', 'Feet', 'confidence', (30 + (user_id * 7) % 70) / 100D, "
        "'x1', x + 10, 'y1', y + 60, 'x2', x + 40, 'y2', y + 80) as feet",
        "event_type")
    return boxes.selectExpr(
        "site_id", "camera_id", "source_id", "sequence", "frame_timestamp", "width", "height",
        "inline(case event_type when 'error' then array(seen, feet) "
        "when 'signup' then array(cast(null as struct<det_index:int,label:string,confidence:double,"
        "x1:double,y1:double,x2:double,y2:double>)) else array(seen) end)")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt out by the number of rows: a line is a few bytes in the shuffle and twenty times as much as a read, so parts
    that are put together by their shuffled bytes would grow with the input to gigabytes of reads in one task."""
    used = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount")
    lines = table(spark, sf_dir, "lineitem").select(*used)
    parts = max(spark.sparkContext.defaultParallelism, -(-lines.count() // READS_PER_TASK))  # the count reads footers only
    return reads_of(lines.repartition(parts, "l_orderkey"))


def raw_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_detections_of(table(spark, sf_dir, "events"))


def cameras(spark: SparkSession) -> DataFrame:
    """The eight views of each of the four derived sites; the gate-out views have a crossing line."""
    return spark.range(32).selectExpr("concat('S', id div 8) as site_id", "cast(id % 8 as int) as cam").selectExpr(
        "site_id", "if(cam < 4, concat('gate-in-', cam + 1), concat('gate-out-', cam - 3)) as camera_id",
        "if(cam < 4, 'lane-in', 'lane-out') as gate_id",
        "get(array('FRONT_TOP', 'LEFT', 'RIGHT', 'REAR'), cam % 4) as role",
        "if(cam < 4, 'ENTRY', 'EXIT') as direction",
        "array(0D, if(cam % 2 = 1, 0.5D, 0D), 1D, 1D) as ocr_roi",
        "if(cam >= 4, 'x', cast(null as string)) as line_axis", "0.5D as line_position", "0.05D as line_deadband",
        "if(cam = 7, 'ENTRY', 'EXIT') as positive_crossing", "cam % 3 as frame_skip",
        "case cam % 4 when 0 then 2D when 1 then 4D when 2 then 0D end as inference_fps")


def camera_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered views, one per customer; many break a rule."""
    return table(spark, sf_dir, "customer").selectExpr("c_custkey as k", "c_nationkey", "c_name", "c_mktsegment",
                                                       "c_acctbal").selectExpr(
        "concat('S', (k + c_nationkey % 3) div 8) as site_id",
        "case when k % 50 = 7 then concat('cam ', k) when k % 40 = 3 then concat('cam-', k - 1) "
        "when k % 45 = 1 then cast(null as string) else concat('cam-', k) end as id",
        "c_name as name", "case k % 60 when 11 then '' when 12 then null else c_mktsegment end as gate_id",
        "if(k % 70 = 13, cast(null as string), concat('CAMERA_', k, '_RTSP')) as source_env",
        "if(k % 33 = 2, 'TOP', 'LEFT') as role", "if(k % 35 = 4, 'IN', 'ENTRY') as direction",
        "c_acctbal > 0 as enabled", "cast(k % 130 as double) as capture_fps",
        "if(k % 4 = 0, cast(null as double), cast(k % 70 as double)) as inference_fps",
        "cast(k % 125 as int) as frame_skip",
        "array((k % 3) / 10D, 0D, (k % 11) / 10D, 1D) as ocr_roi",
        "(k % 21) / 20D as line_position", "(k % 6) / 10D as line_deadband")


def registered_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = ntz(f"{READS_EPOCH_US} + k * 1000000")
    return table(spark, sf_dir, "customer").selectExpr("c_custkey as k", "c_name", "c_mktsegment", "c_acctbal").selectExpr(
        "concat('S', k div 8) as site_id", "concat('cam-', k) as id", "c_name as name", "c_mktsegment as gate_id",
        "concat('CAMERA_', k) as source_env", "c_acctbal > 0 as enabled",
        f"{stamp} as created_at", f"{stamp} as updated_at")


def incoming_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey * 23 as k", "posexplode(if(s_suppkey % 5 = 0, array(s_name, concat(s_name, '-b')), array(s_name))) as (arrival, s_name)",
        "s_acctbal").selectExpr(
        "concat('S', k div 8) as site_id", "concat('cam-', k) as id", "s_name as name", "'lane-new' as gate_id",
        "concat('CAMERA_', k) as source_env", "s_acctbal > 0 as enabled", "arrival")


def camera_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One status row per customer as a view; the nation is the site."""
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('N', c_nationkey) as site_id", "concat('cam-', c_custkey) as camera_id", "c_acctbal > 0 as enabled",
        "if(c_mktsegment in ('BUILDING', 'MACHINERY', 'HOUSEHOLD'), 'ONLINE', 'OFFLINE') as status",
        "case when c_custkey % 3 = 0 then cast(null as string) when c_mktsegment = 'AUTOMOBILE' then 'COMPLETED' "
        "when c_mktsegment = 'FURNITURE' then 'STOPPED' else 'PLAYING' end as playback_status",
        "c_custkey % 9 > 0 as has_frame")


def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log of spool job changes, one job per order: saved, retried 0 to 3 times, validated, completed."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as job_id", "concat('S', o_orderkey % 4) as site_id", "o_orderdate",
        "cast(o_orderkey % 4 as int) as retries", "o_orderstatus")
    steps = orders.selectExpr(
        "site_id", "job_id", "o_orderdate", "retries", "o_orderstatus",
        """inline(filter(concat(
             array(named_struct('step', 0, 'kind', 'saved')),
             if(retries > 0, transform(sequence(1, retries), i -> named_struct('step', i, 'kind', 'retried')),
                array()),
             array(named_struct('step', if(o_orderstatus = 'F', 4, null), 'kind', 'validated'),
                   named_struct('step', if(o_orderstatus <> 'O', 5, null), 'kind', 'completed'))),
           s -> s.step is not null))""")
    return steps.selectExpr(
        "site_id", "job_id", "o_orderdate + make_dt_interval(0, 0, 0, step * 7) as ts", "kind",
        "if(kind = 'completed' and o_orderstatus = 'F', concat('event-', job_id), cast(null as string)) as event_id",
        "if(kind = 'retried', if(job_id % 3 = 0, 'OSError', 'TimeoutError'), cast(null as string)) as error_type")


def metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "concat('S', event_id % 4) as site_id", "event_type as key", "event_id as sample_id", "ts",
        "value as seconds")


def outbox_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery state per order: failures so far, and whether the delivery went through."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('S', o_orderkey % 4) as site_id", "o_orderkey as delivery_id",
        "cast(o_orderkey % 7 as int) as failures", "o_orderstatus = 'F' as delivered",
        "o_orderdate as enqueued_at",
        "o_orderdate + make_dt_interval(0, 0, 0, (o_orderkey % 7) * 11 + 2) as last_attempt_at")


def ocr_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text fragments of a crop: an order is a crop, a line is one fragment."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('S', l_orderkey % 4) as site_id", "l_orderkey as crop_id", "100 as crop_w",
        "if(l_orderkey % 3 = 0, 300, 80) as crop_h",
        "(l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey as ordinal",
        "cast(l_partkey % 190 as double) as left_x", "cast(l_suppkey % 90 as double) as top_y",
        "case l_linenumber % 4 when 0 then '45C1' when 1 then 'CSQU' when 2 then lpad(cast(l_partkey % 1000000 as string), 6, '0') "
        "else cast(l_suppkey % 10 as string) end as text",
        "(100 - 5 * cast(round(100 * l_discount) as int)) / 100D as confidence")


def ocr_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops of orders; every fiftieth order has one more, on which nothing was found."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('S', o_orderkey % 4) as site_id",
        "explode(if(o_orderkey % 50 = 0, array(o_orderkey, -o_orderkey), array(o_orderkey))) as crop_id")


def generated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a generative reader says about a crop: a sentence, a bare code, digits only, words only, or nothing."""
    source = reads(spark, sf_dir)
    return source.selectExpr(
        "site_id", "origin_key", "sequence", "arrival",
        """case arrival % 6
             when 0 then concat('The number is ', raw_text, chr(10))
             when 1 then concat(' ', replace(raw_text, ' ', '-'))
             when 2 then cast(track_id as string)
             when 3 then 'No number-visible'
             when 4 then ''
             else raw_text end as generated""")


def spool_jobs(validated: DataFrame) -> DataFrame:
    """Spool rows as written by the edge: metadata and validation as JSON text, a few of them damaged."""
    moment = "date_format({0}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"
    return validated.selectExpr(
        "site_id", "track_id * 100 + sequence as id", "origin_key as origin", "sequence",
        f"""if(arrival % 97 = 0, '{{"origin_key": "cut', to_json(named_struct(
             'origin_key', origin_key, 'gate_id', gate_id, 'track_id', track_id, 'direction', direction,
             'role', 'FRONT_TOP', 'started_at', {moment.format('started_at')}, 'roi', array(0D, 0D, 1D, 1D),
             'detection', named_struct('camera_id', camera_id, 'frame_timestamp', {moment.format('frame_timestamp')},
                                       'class_name', 'container', 'confidence', confidence,
                                       'bbox', array(10D, 20D, 110D, 80D)),
             'all_detections', array(named_struct('camera_id', camera_id,
                                       'frame_timestamp', {moment.format('frame_timestamp')},
                                       'class_name', 'feet', 'confidence', confidence,
                                       'bbox', array(12D, 60D, 40D, 78D))),
             'frame', named_struct('camera_id', camera_id, 'timestamp', {moment.format('frame_timestamp')},
                                   'sequence', sequence, 'source_id', 'src0')))) as metadata""",
        "concat(origin_key, '/crop.png') as crop", "concat(origin_key, '/frame.png') as image",
        "2000 + arrival % 1000 as payload_bytes",
        "if(arrival % 3 = 0, 'PENDING', 'DONE') as state",
        """if(arrival % 3 = 0, cast(null as string), if(arrival % 89 = 0, '{"raw_text": 1', to_json(named_struct(
             'raw_text', corrected_text, 'normalized_text', normalized_text, 'confidence', confidence,
             'valid_format', valid_format, 'valid_check_digit', valid_check_digit,
             'validation_status', validation_status)))) as validation""",
        "if(arrival % 3 = 1 and arrival % 5 = 0, concat('event-', track_id), cast(null as string)) as event_id",
        "cast(arrival % 4 as int) as attempts", "cast(arrival % 400 as double) as retry_at",
        "if(arrival % 4 > 1, 'TimeoutError', cast(null as string)) as error_type")
