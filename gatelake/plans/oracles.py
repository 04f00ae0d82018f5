"""Registered queries as standard SQL over the star-schema tables, written independently of the operators.

``STEPS`` are named table expressions in dependency order; a query names the ones it reads and gets them, and
what they need, as a WITH clause.
"""

from __future__ import annotations

import re

READS_EPOCH_US = 1767225600000000
DETECTIONS_EPOCH_US = 1769904000000000
VALUES = "0123456789A?BCDEFGHIJK?LMNOPQRSTU?VWXYZ"
GAP = r"[\s-]*"
OWNER = rf"[A-Z]{GAP}[A-Z]{GAP}[A-Z]{GAP}[UJZ]"
WINDOW_US = 30_000_000
TTL_US = 5_000_000


def weighted(text: str) -> str:
    return (f"CAST(list_sum(list_transform(range(1, 11), lambda i: "
            f"(instr('{VALUES}', substr({text}, i, 1)) - 1) * (1 << (i - 1)))) AS INTEGER)")


def sid(kind: str, *parts: str) -> str:
    """Stable identifier; the parts are joined with a bar."""
    return f"substr(sha256(concat_ws('|', '{kind}', {', '.join(parts)})), 1, 32)"


def fixed_size(text: str) -> str:
    border, end = "(^|[^A-Za-z0-9])", "($|[^A-Za-z0-9])"
    with_char = rf"regexp_replace({text}, '(?i){border}([1-4LMN][0-9])\s*C\s*([0-9A-Z]){end}', '\1\2G\3\4', 'g')"
    return rf"regexp_replace({with_char}, '(?i){border}([1-4LMN][0-9])\s*C{end}', '\1\2G1\3', 'g')"


def feet(text: str) -> str:
    code = f"regexp_replace(upper({fixed_size(text)}), '[^A-Z0-9]', '', 'g')"
    lengths = "".join(f" WHEN '{k}' THEN '{v} FT'" for k, v in
                      {"1": 10, "2": 20, "3": 30, "4": 40, "L": 45, "M": 48, "N": 53}.items())
    return rf"""CASE
        WHEN regexp_matches(upper({text}), '(10|20|30|40|45|48|53)\s*(FT|FEET)')
          THEN regexp_extract(upper({text}), '(10|20|30|40|45|48|53)\s*(FT|FEET)', 1) || ' FT'
        WHEN regexp_full_match({code}, '[1-4LMN][0-9][GVRHBUTP][0-9A-Z]')
          THEN (CASE substr({code}, 1, 1){lengths} END) || CASE WHEN substr({code}, 2, 1) = '5' THEN ' HC' ELSE '' END
      END"""


def size_code(text: str) -> str:
    return (rf"nullif(regexp_extract(upper({text}), "
            rf"'(^|[^A-Z0-9])([1-4LMN][0-9][GVRHBUTP][0-9A-Z])($|[^A-Z0-9])', 2), '')")


def iou(a: str, b: str) -> str:
    shared = (f"(greatest(0.0::DOUBLE, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))"
              f" * greatest(0.0::DOUBLE, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))")
    union = (f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - {shared})")
    return f"(CASE WHEN {union} > 0 THEN {shared} / {union} ELSE 0.0::DOUBLE END)"


def iso_z(ts: str) -> str:
    return (f"(CASE WHEN epoch_us({ts}) % 1000000 = 0 THEN strftime({ts}, '%Y-%m-%dT%H:%M:%SZ')"
            f" ELSE strftime({ts}, '%Y-%m-%dT%H:%M:%S.%fZ') END)")


def chain(source: str, keys: list[str], ts: str, order: str, step_us: int | str) -> tuple[str, str]:
    """Bodies of the numbered rows and of the recursive walk that keeps the last taken time per key."""
    key_list = ", ".join(keys)
    rows = f"SELECT *, row_number() OVER (PARTITION BY {key_list} ORDER BY {order}) AS rn FROM {source}"
    same = " AND ".join(f"r.{k} = w.{k}" for k in keys)
    walk = f"""
      SELECT *, true AS taken, {ts} AS anchor_us FROM {{rows}} WHERE rn = 1
      UNION ALL
      SELECT r.*, r.{ts} - w.anchor_us >= {step_us},
             CASE WHEN r.{ts} - w.anchor_us >= {step_us} THEN r.{ts} ELSE w.anchor_us END
      FROM {{walk}} w JOIN {{rows}} r ON {same} AND r.rn = w.rn + 1"""
    return rows, walk


READ_TABLE = r"""
  SELECT 'S' || (g % 4) AS site_id, camera_id, gate_id, direction,
         'S' || (g % 4) || ':' || camera_id || ':src0:' || track_id AS origin_key, track_id, sequence,
         make_timestamp(start_us + sequence * 1000000) AS frame_timestamp, make_timestamp(start_us) AS started_at,
         arrival,
         CASE style
           WHEN 0 THEN owner || serial || ((digit + 1) % 10)
           WHEN 1 THEN owner || 'O' || substr(serial, 2) || digit
           WHEN 2 THEN 'ID: ' || owner || ' ' || serial || ' ' || digit
           WHEN 3 THEN owner || ' ' || serial
           WHEN 4 THEN lower(owner || '-' || serial || '-' || digit)
           WHEN 5 THEN owner || serial || digit || ' MSCU6639870'
           WHEN 6 THEN '45C1'
           WHEN 7 THEN owner || serial || digit || ' 40 FT'
           WHEN 8 THEN replace(owner, 'G', 'C') || serial || digit
           ELSE owner || serial || digit END AS raw_text,
         confidence
  FROM (SELECT *, @SUM % 11 % 10 AS digit FROM (
    SELECT l_orderkey AS track_id, l_orderkey // 8 AS g, l_orderkey % 8 AS cam, CAST(l_linenumber AS BIGINT) AS sequence,
           l_partkey * 1000000 + l_suppkey AS arrival, l_partkey % 12 AS style,
           (100 - 5 * CAST(round(100 * l_discount) AS INTEGER)) / 100.0::DOUBLE AS confidence,
           CASE WHEN l_orderkey % 8 < 4 THEN 'gate-in-' || (l_orderkey % 8 + 1) ELSE 'gate-out-' || (l_orderkey % 8 - 3)
             END AS camera_id,
           CASE WHEN l_orderkey % 8 < 4 THEN 'lane-in' ELSE 'lane-out' END AS gate_id,
           CASE WHEN l_orderkey % 8 < 4 THEN 'ENTRY' ELSE 'EXIT' END AS direction,
           @EPOCH + (l_orderkey // 8) * 4000000 + (l_orderkey // 1600) * 60000000 + (l_orderkey % 8) * 700000 AS start_us,
           ['CSQU', 'MSCU', 'GXYU', 'MSKU', 'TCLU'][((l_orderkey // 8) % 400) % 5 + 1] AS owner,
           lpad(CAST((((l_orderkey // 8) % 400) * 7919) % 1000000 AS VARCHAR), 6, '0') AS serial
    FROM lineitem))"""

CAMERAS = ", ".join(
    f"('S{s}', 'gate-{'in' if c < 4 else 'out'}-{c % 4 + 1}', 'lane-{'in' if c < 4 else 'out'}', "
    f"'{('FRONT_TOP', 'LEFT', 'RIGHT', 'REAR')[c % 4]}', '{'ENTRY' if c < 4 else 'EXIT'}', "
    f"[0.0, {0.5 if c % 2 else 0.0}, 1.0, 1.0]::DOUBLE[], {chr(39) + 'x' + chr(39) if c >= 4 else 'NULL'}, "
    f"'{'ENTRY' if c == 7 else 'EXIT'}')"
    for s in range(4) for c in range(8))

STEPS: dict[str, str] = {}

STEPS["w_reads"] = READ_TABLE.replace("@SUM", weighted("(owner || serial)")).replace("@EPOCH", str(READS_EPOCH_US))

STEPS["w_once"] = """
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY site_id, origin_key, sequence ORDER BY arrival, raw_text, confidence) AS rn
    FROM w_reads) WHERE rn = 1"""

_SEPARATED = r"regexp_replace(upper(corrected_text), '([^A-Z0-9])', '\1\1', 'g')"
STEPS["w_texts"] = f"SELECT DISTINCT raw_text, {fixed_size('raw_text')} AS corrected_text FROM w_reads"
STEPS["w_read_texts"] = rf"""
  SELECT raw_text, corrected_text,
         list_distinct(list_transform(regexp_extract_all(sep, '(^|[^A-Z0-9])({OWNER}(?:{GAP}[0-9]){{7}})($|[^A-Z0-9])', 2),
                                      lambda m: regexp_replace(m, '[^A-Z0-9]', '', 'g'))) AS full_numbers,
         regexp_replace(regexp_extract(sep, '(^|[^A-Z0-9])({OWNER}(?:{GAP}[0-9]){{6}})($|[^A-Z0-9])', 2),
                        '[^A-Z0-9]', '', 'g') AS six,
         regexp_replace(regexp_extract(sep, '(^|[^A-Z0-9])([1-4LMN][0-9]\s*[GVRHBUTP]\s*[0-9A-Z])($|[^A-Z0-9])', 2),
                        '[^A-Z0-9]', '', 'g') AS size_text,
         substr(regexp_replace(upper(corrected_text), '[^A-Z0-9]', '', 'g'), 1) AS squeezed
  FROM (SELECT *, {_SEPARATED} AS sep FROM w_texts)"""
STEPS["w_named_texts"] = f"""
  SELECT *, CASE WHEN len(full_numbers) > 1 THEN '' WHEN len(full_numbers) = 1 THEN full_numbers[1]
                 WHEN six <> '' THEN six || ({weighted('six')} % 11 % 10)
                 WHEN size_text <> '' THEN size_text ELSE squeezed END AS named,
         CASE WHEN len(full_numbers) > 1 THEN 'many' WHEN len(full_numbers) = 1 THEN 'one' WHEN six <> '' THEN 'six'
              WHEN size_text <> '' THEN 'size' ELSE 'text' END AS found
  FROM w_read_texts"""
STEPS["w_judged_texts"] = f"""
  SELECT raw_text, corrected_text, found, named,
         found <> 'size' AND regexp_full_match(named, '[A-Z]{{3}}[UJZ][0-9]{{7}}') AS shaped,
         list_filter([named] || list_transform(
             list_filter([1, 2, 3], lambda i: substr(named, i, 1) = 'C'),
             lambda i: substr(named, 1, i - 1) || 'G' || substr(named, i + 1)),
           lambda t: {weighted('t')} % 11 % 10 = TRY_CAST(substr(t, 11, 1) AS INTEGER)) AS passing
  FROM w_named_texts"""
STEPS["w_text_results"] = """
  SELECT raw_text, corrected_text,
         CASE WHEN shaped AND len(passing) > 0 THEN passing[1] ELSE named END AS normalized_text,
         shaped OR found = 'size' AS valid_format, shaped AND len(passing) > 0 AS valid_check_digit,
         CASE WHEN found = 'many' THEN 'AMBIGUOUS' WHEN found = 'size' THEN 'VALID_SIZE_CODE'
              WHEN shaped AND len(passing) > 0 THEN 'VALID' WHEN shaped THEN 'INVALID_CHECK_DIGIT'
              ELSE 'INVALID_FORMAT' END AS validation_status,
         found = 'six' AS check_digit_derived
  FROM w_judged_texts"""
_VALID = "corrected_text, normalized_text, valid_format, valid_check_digit, validation_status, check_digit_derived"
STEPS["w_valid"] = f"SELECT r.*, {_VALID} FROM w_once r JOIN w_text_results USING (raw_text)"

STEPS["w_attempts"] = """
  SELECT *, valid_check_digit AND confidence >= 0.6 AS good FROM (
    SELECT *, row_number() OVER (PARTITION BY site_id, origin_key ORDER BY sequence) AS k FROM w_valid) WHERE k <= 4"""
STEPS["w_prefix_votes"] = """
  SELECT o.site_id, o.origin_key, o.k, r.normalized_text AS number, count(*) AS votes
  FROM w_attempts o JOIN w_attempts r ON r.site_id = o.site_id AND r.origin_key = o.origin_key AND r.k <= o.k AND r.good
  GROUP BY ALL"""
STEPS["w_leaders"] = """
  SELECT site_id, origin_key, k, arg_max(number, votes) AS number, max(votes) AS top,
         count(*) FILTER (votes = top_votes) AS leaders
  FROM (SELECT *, max(votes) OVER (PARTITION BY site_id, origin_key, k) AS top_votes FROM w_prefix_votes)
  GROUP BY site_id, origin_key, k"""
STEPS["w_emissions"] = """
  SELECT a.site_id, a.origin_key, coalesce(min(l.k), max(a.k)) AS k, arg_min(l.number, l.k) AS number
  FROM w_attempts a LEFT JOIN (SELECT * FROM w_leaders WHERE top >= 2 AND leaders = 1) l
    ON a.site_id = l.site_id AND a.origin_key = l.origin_key AND a.k = l.k
  GROUP BY a.site_id, a.origin_key HAVING min(l.k) IS NOT NULL OR max(a.k) = 4"""
STEPS["w_supporters"] = """
  SELECT a.*, row_number() OVER (PARTITION BY a.site_id, a.origin_key ORDER BY a.confidence DESC, a.k) AS best
  FROM w_attempts a JOIN w_emissions e ON a.site_id = e.site_id AND a.origin_key = e.origin_key AND a.k <= e.k
   AND a.good AND a.normalized_text = e.number"""
STEPS["w_obs"] = """
  SELECT c.site_id, c.origin_key, c.camera_id, c.gate_id, c.direction, c.track_id, c.sequence, c.frame_timestamp,
         c.started_at,
         CASE WHEN e.number IS NULL THEN c.raw_text ELSE b.raw_text END AS raw_text,
         CASE WHEN e.number IS NULL THEN c.corrected_text ELSE b.corrected_text END AS corrected_text,
         CASE WHEN e.number IS NULL THEN c.normalized_text ELSE b.normalized_text END AS normalized_text,
         CASE WHEN e.number IS NULL THEN c.confidence ELSE b.confidence END AS confidence,
         CASE WHEN e.number IS NULL THEN c.valid_format ELSE b.valid_format END AS valid_format,
         CASE WHEN e.number IS NULL THEN c.valid_check_digit ELSE b.valid_check_digit END AS valid_check_digit,
         CASE WHEN e.number IS NULL THEN c.validation_status ELSE b.validation_status END AS validation_status,
         CASE WHEN e.number IS NULL THEN c.check_digit_derived ELSE b.check_digit_derived END AS check_digit_derived,
         e.number IS NOT NULL AS confirmed, e.number AS container_number, CAST(e.k AS INTEGER) AS attempts,
         epoch_us(c.frame_timestamp) AS us, (35 + c.track_id % 60) / 100.0::DOUBLE AS detection_confidence
  FROM w_emissions e JOIN w_attempts c ON c.site_id = e.site_id AND c.origin_key = e.origin_key AND c.k = e.k
  LEFT JOIN w_supporters b ON b.site_id = e.site_id AND b.origin_key = e.origin_key AND b.best = 1"""

# Association: the open events of a lane are a list that grows and is pruned row by row.
STEPS["w_gaps"] = f"""
  SELECT *, coalesce(us - lag(us) OVER (PARTITION BY site_id, gate_id, direction ORDER BY us, origin_key)
                     > {WINDOW_US}, true) AS opens FROM w_obs"""
STEPS["w_runs"] = """
  SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY site_id, gate_id, direction ORDER BY us, origin_key
                                              ROWS UNBOUNDED PRECEDING) AS run FROM w_gaps"""
STEPS["w_turns"] = f"""
  SELECT site_id, gate_id, direction, run, us, origin_key, container_number AS number, {sid('event', 'origin_key')} AS new_id,
         row_number() OVER (PARTITION BY site_id, gate_id, direction, run ORDER BY us, origin_key) AS turn FROM w_runs"""
STEPS["w_walk"] = f"""
  SELECT site_id, gate_id, direction, run, turn, origin_key,
         [{{'us': us, 'number': number, 'id': new_id}}] AS open_events,
         new_id AS event_id, true AS created, false AS promoted, us AS event_us
  FROM w_turns WHERE turn = 1
  UNION ALL
  SELECT site_id, gate_id, direction, run, turn, origin_key,
         CASE WHEN hit IS NULL THEN list_append(alive, {{'us': us, 'number': number, 'id': new_id}})
              WHEN number IS NOT NULL AND hit.number IS NULL THEN list_transform(alive, lambda e:
                   CASE WHEN e.id = hit.id THEN {{'us': e.us, 'number': number, 'id': e.id}} ELSE e END)
              ELSE alive END,
         CASE WHEN hit IS NULL THEN new_id ELSE hit.id END, hit IS NULL,
         hit IS NOT NULL AND number IS NOT NULL AND hit.number IS NULL,
         CASE WHEN hit IS NULL THEN us ELSE hit.us END
  FROM (SELECT *, CASE WHEN number IS NULL THEN alive[-1]
                       ELSE coalesce(list_filter(alive, lambda e: e.number = number)[-1],
                                     list_filter(alive, lambda e: e.number IS NULL)[-1]) END AS hit
        FROM (SELECT t.*, list_filter(w.open_events, lambda e: e.us >= t.us - {WINDOW_US}) AS alive
              FROM w_walk w JOIN w_turns t ON t.site_id = w.site_id AND t.gate_id = w.gate_id
               AND t.direction = w.direction AND t.run = w.run AND t.turn = w.turn + 1))"""
STEPS["w_assigned"] = """
  SELECT o.*, w.event_id, w.created, w.promoted, make_timestamp(w.event_us) AS event_timestamp
  FROM w_obs o JOIN w_walk w USING (site_id, origin_key)"""
STEPS["w_events"] = """
  SELECT site_id, event_id AS id, any_value(gate_id) AS gate_id, min(event_timestamp) AS timestamp,
         max(container_number) FILTER (created OR promoted) AS container_number, any_value(direction) AS event_type,
         CASE WHEN max(container_number) FILTER (created OR promoted) IS NULL THEN 'NEEDS_REVIEW' ELSE 'CONFIRMED' END
           AS status
  FROM w_assigned GROUP BY site_id, event_id"""
STEPS["w_extras"] = """
  SELECT a.*, x.cls, x.conf, x.nth, CASE x.cls WHEN 'truck' THEN x.x1 + track_id % 9 ELSE x.x1 + track_id % 5 END AS left_x
  FROM w_assigned a JOIN (VALUES ('feet', 0.5::DOUBLE, 12.2::DOUBLE, 1), ('feet', 0.6::DOUBLE, 12.7::DOUBLE, 2),
                                 ('truck', 0.7::DOUBLE, 3.5::DOUBLE, 3)) x(cls, conf, x1, nth)
    ON (x.cls = 'feet' AND a.track_id % 3 = 0) OR (x.cls = 'truck' AND a.track_id % 4 = 0)"""
STEPS["w_dets"] = f"""
  SELECT site_id, {sid('detection', 'origin_key')} AS id, event_id, camera_id, origin_key, track_id,
         'container' AS class_name, detection_confidence AS confidence,
         CAST(to_json([10.0 + track_id % 50, 20.0, 110.0 + track_id % 50, 80.0]::DOUBLE[]) AS VARCHAR) AS bbox,
         frame_timestamp AS timestamp FROM w_assigned
  UNION ALL
  SELECT site_id, {sid('detection', 'key')}, event_id, camera_id, key, track_id, cls, conf,
         CAST(to_json([left_x, 60.0, 40.0, 78.0]::DOUBLE[]) AS VARCHAR), frame_timestamp
  FROM (SELECT *, row_number() OVER (PARTITION BY site_id, key ORDER BY nth) AS rn
        FROM (SELECT *, concat_ws(':', origin_key, cls, CAST(trunc(left_x) AS INTEGER)) AS key FROM w_extras))
  WHERE rn = 1"""
STEPS["w_ocr"] = f"""
  SELECT site_id, {sid('ocr', 'origin_key')} AS id, {sid('detection', 'origin_key')} AS detection_id, raw_text,
         corrected_text, normalized_text, confidence, valid_format, valid_check_digit, validation_status,
         frame_timestamp AS timestamp FROM w_assigned"""
STEPS["w_snaps"] = f"""
  SELECT site_id, {sid('snapshot', 'event_id', 'camera_id', 'track_id')} AS id, event_id, camera_id,
         event_id || '/' || camera_id || '/' || track_id || '.jpg' AS image_path, frame_timestamp AS timestamp
  FROM (SELECT *, row_number() OVER (PARTITION BY site_id, event_id, camera_id, track_id
                                     ORDER BY confirmed DESC, frame_timestamp DESC, origin_key DESC) AS rn FROM w_assigned)
  WHERE rn = 1"""
STEPS["w_sizes"] = f"""
  SELECT site_id, event_id,
         coalesce(arg_min(size, (timestamp, ocr_id)) FILTER (size IS NOT NULL),
                  CASE WHEN bool_or(feet_seen) THEN 'FEET' END) AS container_size,
         arg_min(coalesce(code, ''), (timestamp, ocr_id)) FILTER (size IS NOT NULL) AS code_or_blank
  FROM (SELECT d.site_id, d.event_id, o.timestamp, o.id AS ocr_id, lower(d.class_name) = 'feet' AS feet_seen,
               coalesce({feet('o.normalized_text')}, {feet('o.corrected_text')}) AS size,
               coalesce({size_code('o.normalized_text')}, {size_code('o.corrected_text')}) AS code
        FROM w_dets d LEFT JOIN w_ocr o ON o.site_id = d.site_id AND o.detection_id = d.id)
  GROUP BY site_id, event_id"""
STEPS["w_event_sizes"] = """
  SELECT site_id, event_id, container_size, nullif(code_or_blank, '') AS size_code FROM w_sizes"""

STEPS["w_visit_rows"], _walk = chain(
    "(SELECT * FROM w_obs WHERE confirmed)", ["site_id", "gate_id", "direction", "container_number"], "us",
    "us, origin_key", WINDOW_US + 1)
STEPS["w_visit_walk"] = _walk.format(rows="w_visit_rows", walk="w_visit_walk")
STEPS["w_visits"] = """
  SELECT site_id, gate_id, direction, container_number, make_timestamp(anchor_us) AS first_seen,
         make_timestamp(max(us)) AS last_seen, count(*) AS observations
  FROM w_visit_walk GROUP BY site_id, gate_id, direction, container_number, anchor_us"""

STEPS["w_cameras"] = f"""
  SELECT * FROM (VALUES {CAMERAS})
    c(site_id, camera_id, gate_id, role, direction, ocr_roi, line_axis, positive_crossing)"""

# Detections.
STEPS["w_frames_base"] = f"""
  SELECT 'S' || ((n // 100) % 4) AS site_id,
         CASE WHEN cam < 4 THEN 'gate-in-' || (cam + 1) ELSE 'gate-out-' || (cam - 3) END AS camera_id,
         'src' || (n // 700) AS source_id, n AS sequence,
         make_timestamp({DETECTIONS_EPOCH_US} + n * 200000 + (n // 100) * 8000000) AS frame_timestamp,
         CASE WHEN (n // 40) % 4 = 3 THEN 'Truck' ELSE 'Cointainer' END AS label, event_type, user_id,
         CAST(20 + (n * 6 + user_id % 3) % 400 AS DOUBLE) AS x, CAST(40 + 5 * cam AS DOUBLE) AS y
  FROM (SELECT event_id // 8 AS n, event_id % 8 AS cam, event_type, user_id FROM events)"""
STEPS["w_raw"] = """
  SELECT site_id, camera_id, source_id, sequence, frame_timestamp, 640 AS width, 360 AS height, 0 AS det_index, label,
         (30 + user_id % 70) / 100.0::DOUBLE AS confidence, x AS x1, y AS y1, x + 160 AS x2, y + 90 AS y2
  FROM w_frames_base WHERE event_type <> 'signup'
  UNION ALL
  SELECT site_id, camera_id, source_id, sequence, frame_timestamp, 640, 360, 1, 'Feet',
         (30 + (user_id * 7) % 70) / 100.0::DOUBLE, x + 10, y + 60, x + 40, y + 80
  FROM w_frames_base WHERE event_type = 'error'
  UNION ALL
  SELECT site_id, camera_id, source_id, sequence, frame_timestamp, 640, 360, NULL, NULL, NULL, NULL, NULL, NULL, NULL
  FROM w_frames_base WHERE event_type = 'signup'"""
STEPS["w_clean"] = """
  SELECT site_id, camera_id, source_id, sequence, frame_timestamp, width, height, det_index,
         CASE lower(label) WHEN 'cointainer' THEN 'container' ELSE lower(label) END AS class_name, confidence,
         greatest(0.0::DOUBLE, x1) AS x1, greatest(0.0::DOUBLE, y1) AS y1, least(CAST(width AS DOUBLE), x2) AS x2,
         least(CAST(height AS DOUBLE), y2) AS y2
  FROM w_raw WHERE label IS NOT NULL AND confidence >= 0.35 AND isfinite(x1) AND isfinite(y1) AND isfinite(x2)
   AND isfinite(y2) AND least(CAST(width AS DOUBLE), x2) > greatest(0.0::DOUBLE, x1)
   AND least(CAST(height AS DOUBLE), y2) > greatest(0.0::DOUBLE, y1)"""
STEPS["w_frames"] = """
  SELECT site_id, camera_id, source_id, sequence, frame_timestamp, epoch_us(frame_timestamp) AS us,
         count(label) AS n_detections
  FROM w_raw GROUP BY ALL"""
# Tracks over all frames, and over those that the frame skip of each camera lets through.
STEPS["w_considered"] = """
  SELECT c.* FROM w_clean c JOIN (VALUES ('gate-in-1', 1), ('gate-in-2', 2), ('gate-in-3', 3), ('gate-in-4', 1), ('gate-out-1', 2),
    ('gate-out-2', 3), ('gate-out-3', 1), ('gate-out-4', 2)) s(camera_id, every) USING (camera_id) WHERE sequence % every = 0"""
# These tables hold at most one detection of a class per frame, so a frame extends at most one track per class.
STEPS["w_det_rows"] = """
  SELECT *, epoch_us(frame_timestamp) AS us,
         row_number() OVER (PARTITION BY site_id, camera_id, source_id, class_name ORDER BY frame_timestamp, sequence) AS turn
  FROM w_clean"""
STEPS["w_track_walk"] = f"""
  SELECT site_id, camera_id, source_id, class_name, turn, us, sequence, det_index,
         [{{'start': turn, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'seen': us, 'hits': CAST(1 AS BIGINT)}}] AS open_tracks,
         turn AS start, CAST(1 AS BIGINT) AS hits
  FROM w_det_rows WHERE turn = 1
  UNION ALL
  SELECT site_id, camera_id, source_id, class_name, turn, us, sequence, det_index,
         CASE WHEN hit IS NULL
              THEN list_append(alive, {{'start': turn, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'seen': us,
                                        'hits': CAST(1 AS BIGINT)}})
              ELSE list_transform(alive, lambda t: CASE WHEN t.start = hit.start
                   THEN {{'start': t.start, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'seen': us, 'hits': t.hits + 1}}
                   ELSE t END) END,
         CASE WHEN hit IS NULL THEN turn ELSE hit.start END,
         CASE WHEN hit IS NULL THEN CAST(1 AS BIGINT)
              ELSE list_filter(alive, lambda t: t.start = hit.start)[1].hits + 1 END
  FROM (SELECT *, list_sort(list_filter(list_transform(alive, lambda t:
                    {{'score': {iou('t', 'd')}, 'start': t.start}}), lambda s: s.score >= 0.25), 'DESC')[1] AS hit
        FROM (SELECT d.*, {{'x1': d.x1, 'y1': d.y1, 'x2': d.x2, 'y2': d.y2}} AS d,
                     list_filter(w.open_tracks, lambda t: d.us - t.seen <= {TTL_US}) AS alive
              FROM w_track_walk w JOIN w_det_rows d USING (site_id, camera_id, source_id, class_name)
              WHERE d.turn = w.turn + 1))"""
STEPS["w_track_ids"] = """
  SELECT site_id, camera_id, source_id, class_name, start, us AS first_us,
         row_number() OVER (PARTITION BY site_id, camera_id, source_id ORDER BY us, sequence, det_index) AS track_id
  FROM w_track_walk WHERE turn = start"""
STEPS["w_tracked"] = """
  SELECT c.*, w.hits, i.track_id, make_timestamp(i.first_us) AS first_seen, w.us
  FROM w_track_walk w JOIN w_track_ids i USING (site_id, camera_id, source_id, class_name, start)
  JOIN w_clean c USING (site_id, camera_id, source_id, class_name, sequence, det_index)"""
for _name in ("w_det_rows", "w_track_walk", "w_track_ids", "w_tracked"):
    STEPS[f"{_name}_considered"] = re.sub(r"\b(w_det_rows|w_track_walk|w_track_ids|w_tracked)\b", r"\1_considered",
                                          STEPS[_name]).replace("w_clean", "w_considered")
STEPS["w_sides"] = """
  SELECT t.*, c.direction, c.line_axis, c.positive_crossing,
         CASE WHEN c.line_axis IS NULL THEN NULL
              WHEN (x1 + x2) / (2 * width) - 0.5::DOUBLE > 0.05::DOUBLE THEN 1
              WHEN (x1 + x2) / (2 * width) - 0.5::DOUBLE < -0.05::DOUBLE THEN -1 ELSE 0 END AS side
  FROM w_tracked_considered t LEFT JOIN w_cameras c USING (site_id, camera_id)"""
STEPS["w_side_before"] = """
  SELECT *, last_value(nullif(side, 0) IGNORE NULLS) OVER (
              PARTITION BY site_id, camera_id, source_id, track_id ORDER BY us, sequence
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w_sides"""
STEPS["w_directed"] = """
  SELECT *, CASE WHEN line_axis IS NULL THEN direction ELSE coalesce(
       first_value(CASE WHEN side <> 0 AND before <> 0 AND side <> before THEN
           CASE WHEN side = 1 THEN positive_crossing WHEN positive_crossing = 'ENTRY' THEN 'EXIT' ELSE 'ENTRY' END END
         IGNORE NULLS) OVER (PARTITION BY site_id, camera_id, source_id, track_id ORDER BY us, sequence
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'UNKNOWN') END AS track_direction
  FROM w_side_before"""
STEPS["w_cand_rows"], _walk = chain(
    "(SELECT * FROM w_directed WHERE hits >= 3 AND class_name IN ('container', 'trailer', 'feet')"
    " AND NOT (line_axis IS NOT NULL AND track_direction = 'UNKNOWN'))",
    ["site_id", "camera_id", "source_id", "track_id"], "us", "us, sequence, det_index", 1_000_000)
STEPS["w_cand_walk"] = _walk.format(rows="w_cand_rows", walk="w_cand_walk")
STEPS["w_rate_rows"], _walk = chain("w_frames", ["site_id", "camera_id", "source_id"], "us", "us, sequence", 333_333)
STEPS["w_rate_walk"] = _walk.format(rows="w_rate_rows", walk="w_rate_walk")
STEPS["w_paced"] = """
  SELECT *, CASE right(camera_id, 1) WHEN '1' THEN 500000 WHEN '2' THEN 250000 ELSE 333333 END AS step FROM w_frames"""
STEPS["w_pace_rows"], _walk = chain("w_paced", ["site_id", "camera_id", "source_id"], "us", "us, sequence", "r.step")
STEPS["w_pace_walk"] = _walk.format(rows="w_pace_rows", walk="w_pace_walk")

STEPS["w_jobs"] = """
  SELECT site_id, track_id * 100 + sequence AS id, origin_key AS origin, sequence, v.*, 2000 + arrival % 1000 AS payload_bytes,
         CASE WHEN arrival % 3 = 0 THEN 'PENDING' ELSE 'DONE' END AS state,
         CASE WHEN arrival % 3 = 1 AND arrival % 5 = 0 THEN 'event-' || track_id END AS event_id,
         CAST(arrival % 4 AS INTEGER) AS attempts, CAST(arrival % 400 AS DOUBLE) AS retry_at,
         CASE WHEN arrival % 4 > 1 THEN 'TimeoutError' END AS error_type,
         arrival % 97 = 0 AS bad_metadata, arrival % 3 <> 0 AND arrival % 89 = 0 AS bad_validation,
         arrival % 3 <> 0 AND arrival % 89 <> 0 AS has_validation
  FROM (SELECT site_id, track_id, sequence, origin_key, arrival, {'gate_id': gate_id, 'direction': direction,
          'camera_id': camera_id, 'track_id': track_id, 'started_at': started_at, 'frame_timestamp': frame_timestamp,
          'normalized_text': normalized_text, 'validation_status': validation_status,
          'valid_check_digit': valid_check_digit, 'confidence': confidence} AS v FROM w_valid)"""
STEPS["w_transitions"] = """
  SELECT 'S' || (o_orderkey % 4) AS site_id, o_orderkey AS job_id, o_orderdate + to_seconds(step * 7) AS ts, kind,
         CASE WHEN kind = 'completed' AND o_orderstatus = 'F' THEN 'event-' || o_orderkey END AS event_id,
         CASE WHEN kind = 'retried' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'OSError' ELSE 'TimeoutError' END END AS error_type
  FROM orders JOIN (VALUES (0, 'saved'), (1, 'retried'), (2, 'retried'), (3, 'retried'), (4, 'validated'), (5, 'completed'))
    s(step, kind)
    ON kind = 'saved' OR (kind = 'retried' AND step <= o_orderkey % 4) OR (kind = 'validated' AND o_orderstatus = 'F')
    OR (kind = 'completed' AND o_orderstatus <> 'O')"""
STEPS["w_ledger"] = """
  SELECT site_id, job_id, CASE WHEN bool_or(kind = 'completed') THEN 'DONE' ELSE 'PENDING' END AS state,
         CAST(count(*) FILTER (kind = 'retried') AS INTEGER) AS attempts, bool_or(kind = 'validated') AS validated,
         max(ts) FILTER (kind = 'retried') + INTERVAL 5 SECOND AS retry_at,
         CASE WHEN bool_or(kind = 'completed') THEN NULL ELSE arg_max(error_type, ts) FILTER (kind = 'retried') END
           AS error_type,
         max(event_id) AS event_id
  FROM w_transitions GROUP BY site_id, job_id"""
STEPS["w_fragments"] = """
  SELECT 'S' || (l_orderkey % 4) AS site_id, l_orderkey AS crop_id, CASE WHEN l_orderkey % 3 = 0 THEN 300 ELSE 80 END AS crop_h,
         (l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey AS ordinal, CAST(l_partkey % 190 AS DOUBLE) AS left_x,
         CAST(l_suppkey % 90 AS DOUBLE) AS top_y,
         CASE l_linenumber % 4 WHEN 0 THEN '45C1' WHEN 1 THEN 'CSQU'
              WHEN 2 THEN lpad(CAST(l_partkey % 1000000 AS VARCHAR), 6, '0') ELSE CAST(l_suppkey % 10 AS VARCHAR) END AS text,
         (100 - 5 * CAST(round(100 * l_discount) AS INTEGER)) / 100.0::DOUBLE AS confidence
  FROM lineitem"""
STEPS["w_generated"] = """
  SELECT site_id, origin_key, sequence, arrival,
         CASE arrival % 6 WHEN 0 THEN 'The number is ' || raw_text || chr(10) WHEN 1 THEN ' ' || replace(raw_text, ' ', '-')
              WHEN 2 THEN CAST(track_id AS VARCHAR) WHEN 3 THEN 'No number-visible' WHEN 4 THEN '' ELSE raw_text END AS generated
  FROM w_reads"""
STEPS["w_schedule"] = """
  SELECT site_id, delivery_id, failures, delivery_state,
         CASE WHEN delivery_state = 'RETRY' THEN least(CAST(pow(2, failures) AS INTEGER), 30) END AS wait_seconds,
         CASE WHEN delivery_state = 'RETRY' THEN tried + to_seconds(least(CAST(pow(2, failures) AS INTEGER), 30)) END
           AS next_attempt_at,
         CASE WHEN delivery_state = 'SYNCED' THEN epoch_us(tried) - epoch_us(o_orderdate) END AS latency_us
  FROM (SELECT 'S' || (o_orderkey % 4) AS site_id, o_orderkey AS delivery_id, CAST(o_orderkey % 7 AS INTEGER) AS failures,
               o_orderdate, o_orderdate + to_seconds((o_orderkey % 7) * 11 + 2) AS tried,
               CASE WHEN o_orderstatus = 'F' THEN 'SYNCED' WHEN o_orderkey % 7 >= 5 THEN 'EXHAUSTED'
                    WHEN o_orderkey % 7 > 0 THEN 'RETRY' ELSE 'QUEUED' END AS delivery_state
        FROM orders)"""

RECURSIVE = ("w_walk", "w_visit_walk", "w_track_walk", "w_track_walk_considered", "w_cand_walk", "w_rate_walk",
             "w_pace_walk")


def quantiles(source: str, key: str, seconds: str) -> str:
    return f"""
      SELECT site_id, key, count(*) AS samples, list_sort(list(ms))[CAST(floor((count(*) - 1) * 0.5::DOUBLE) AS INTEGER) + 1] AS p50_ms,
             list_sort(list(ms))[CAST(floor((count(*) - 1) * 0.95::DOUBLE) AS INTEGER) + 1] AS p95_ms
      FROM (SELECT site_id, {key} AS key, ({seconds}) * 1000 AS ms FROM {source}) GROUP BY site_id, key"""


def registry_rules() -> str:
    rules = [
        ("required", "id IS NULL OR name IS NULL OR gate_id IS NULL OR source_env IS NULL"),
        ("id_pattern", "NOT regexp_full_match(id, '[A-Za-z0-9_-]{1,64}')"),
        ("id_unique", "id IS NOT NULL AND same > 1"),
        ("gate_id", "length(gate_id) < 1 OR length(gate_id) > 64"),
        ("source_env", "NOT regexp_full_match(source_env, '[A-Z][A-Z0-9_]+') OR length(source_env) > 100"),
        ("capture_fps", "capture_fps <= 0 OR capture_fps > 120"),
        ("inference_fps", "inference_fps <= 0 OR inference_fps > 60"),
        ("frame_skip", "frame_skip > 120"),
        ("ocr_roi", "NOT (rx1 >= 0 AND rx1 < rx2 AND rx2 <= 1)"),
        ("line_position", "line_position <= 0 OR line_position >= 1"),
        ("line_deadband", "line_deadband >= 0.5::DOUBLE"),
        ("name", "length(name) > 100"),
        ("role", "role <> 'LEFT'"),
        ("direction", "direction <> 'ENTRY'"),
        ("max_views", "views > 8"),
        ("max_sources", "sources > 32"),
    ]
    return "[" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in rules) + "]"


STEPS["w_registry"] = """
  SELECT *, count(*) OVER (PARTITION BY site_id, id) AS same, count(*) OVER (PARTITION BY site_id) AS views,
         count(source_env) OVER (PARTITION BY site_id) AS sources FROM (
    SELECT 'S' || ((c_custkey + c_nationkey % 3) // 8) AS site_id,
           CASE WHEN c_custkey % 50 = 7 THEN 'cam ' || c_custkey WHEN c_custkey % 40 = 3 THEN 'cam-' || (c_custkey - 1)
                WHEN c_custkey % 45 = 1 THEN NULL ELSE 'cam-' || c_custkey END AS id,
           c_name AS name, CASE c_custkey % 60 WHEN 11 THEN '' WHEN 12 THEN NULL ELSE c_mktsegment END AS gate_id,
           CASE WHEN c_custkey % 70 = 13 THEN NULL ELSE 'CAMERA_' || c_custkey || '_RTSP' END AS source_env,
           CASE WHEN c_custkey % 33 = 2 THEN 'TOP' ELSE 'LEFT' END AS role,
           CASE WHEN c_custkey % 35 = 4 THEN 'IN' ELSE 'ENTRY' END AS direction, CAST(c_custkey % 130 AS DOUBLE) AS capture_fps,
           CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 70 AS DOUBLE) END AS inference_fps,
           c_custkey % 125 AS frame_skip, (c_custkey % 3) / 10.0::DOUBLE AS rx1, (c_custkey % 11) / 10.0::DOUBLE AS rx2,
           (c_custkey % 21) / 20.0::DOUBLE AS line_position, (c_custkey % 6) / 10.0::DOUBLE AS line_deadband
    FROM customer)"""

Q: dict[str, str] = {}

Q["load_detections"] = "SELECT * FROM w_raw"
Q["parse_ocr_jobs"] = """
  SELECT site_id, id, origin, sequence, state, event_id, attempts, retry_at, error_type, payload_bytes,
         CASE WHEN NOT bad_metadata THEN gate_id END AS gate_id, CASE WHEN NOT bad_metadata THEN track_id END AS track_id,
         CASE WHEN NOT bad_metadata THEN direction END AS direction, CASE WHEN NOT bad_metadata THEN 'FRONT_TOP' END AS role,
         CASE WHEN NOT bad_metadata THEN started_at END AS started_at,
         CASE WHEN NOT bad_metadata THEN camera_id END AS camera_id,
         CASE WHEN NOT bad_metadata THEN 'container' END AS class_name,
         CASE WHEN NOT bad_metadata THEN confidence END AS detection_confidence,
         CASE WHEN NOT bad_metadata THEN '[10.0,20.0,110.0,80.0]' END AS bbox,
         CASE WHEN NOT bad_metadata THEN frame_timestamp END AS frame_timestamp,
         CASE WHEN NOT bad_metadata THEN 'src0' END AS source_id,
         CASE WHEN NOT bad_metadata THEN 1 END AS detections_on_frame,
         CASE WHEN NOT bad_metadata THEN '[0.0,0.0,1.0,1.0]' END AS ocr_roi, origin || '/crop.png' AS crop,
         origin || '/frame.png' AS image, CASE WHEN NOT bad_metadata THEN 'feet' END AS other_class,
         CASE WHEN NOT bad_metadata THEN '[12.0,60.0,40.0,78.0]' END AS other_bbox,
         CASE WHEN has_validation THEN normalized_text END AS normalized_text,
         CASE WHEN has_validation THEN validation_status END AS validation_status,
         CASE WHEN has_validation THEN valid_check_digit END AS valid_check_digit,
         CASE WHEN has_validation THEN confidence END AS read_confidence, bad_metadata OR bad_validation AS damaged
  FROM w_jobs"""
Q["camera_registry_check"] = f"""
  SELECT site_id, id, name, CAST(to_json(list_filter({registry_rules()}, lambda v: v IS NOT NULL)) AS VARCHAR) AS violations
  FROM w_registry"""
Q["upsert_cameras"] = f"""
  WITH cur AS (SELECT 'S' || (c_custkey // 8) AS site_id, 'cam-' || c_custkey AS id, c_name AS name, c_mktsegment AS gate_id,
                      'CAMERA_' || c_custkey AS source_env, c_acctbal > 0 AS enabled,
                      make_timestamp({READS_EPOCH_US} + c_custkey * 1000000) AS stamp FROM customer),
       inc AS (SELECT 'S' || (s_suppkey * 23 // 8) AS site_id, 'cam-' || (s_suppkey * 23) AS id, s_name AS name,
                      'lane-new' AS gate_id, 'CAMERA_' || (s_suppkey * 23) AS source_env, s_acctbal > 0 AS enabled
               FROM (SELECT s_suppkey, s_acctbal, s_name || CASE WHEN s_suppkey % 5 = 0 THEN '-b' ELSE '' END AS s_name FROM supplier))
  SELECT coalesce(inc.site_id, cur.site_id) AS site_id, coalesce(inc.id, cur.id) AS id, coalesce(inc.name, cur.name) AS name,
         coalesce(inc.gate_id, cur.gate_id) AS gate_id, coalesce(inc.source_env, cur.source_env) AS source_env,
         coalesce(inc.enabled, cur.enabled) AS enabled, coalesce(cur.stamp, TIMESTAMP '2026-03-01 00:00:00') AS created_at,
         CASE WHEN inc.id IS NOT NULL THEN TIMESTAMP '2026-03-01 00:00:00' ELSE cur.stamp END AS updated_at
  FROM cur FULL OUTER JOIN inc ON cur.site_id = inc.site_id AND cur.id = inc.id"""
Q["fk_violations"] = f"""
  WITH refs AS (
    SELECT site_id, id, camera_id AS key, 'detections.camera_id' AS relation FROM w_dets UNION ALL
    SELECT site_id, id, event_id, 'detections.event_id' FROM w_dets UNION ALL
    SELECT site_id, id, detection_id, 'ocr_results.detection_id' FROM w_ocr UNION ALL
    SELECT site_id, id, event_id, 'snapshots.event_id' FROM w_snaps UNION ALL
    SELECT site_id, id, camera_id, 'snapshots.camera_id' FROM w_snaps UNION ALL
    SELECT site_id, {sid('log', 'origin_key')}, event_id, 'system_logs.event_id' FROM w_assigned),
  parents AS (
    SELECT site_id, camera_id AS key, 'camera_id' AS kind FROM w_cameras WHERE NOT (site_id = 'S2' AND camera_id = 'gate-out-4')
    UNION SELECT site_id, id, 'event_id' FROM w_events WHERE status = 'CONFIRMED'
    UNION SELECT site_id, id, 'detection_id' FROM w_dets WHERE track_id % 11 <> 0)
  SELECT * FROM refs r WHERE NOT EXISTS (
    SELECT 1 FROM parents p WHERE p.site_id = r.site_id AND p.key = r.key AND p.kind = split_part(r.relation, '.', 2))"""
_DOC_PARTS = f"""
  d AS MATERIALIZED (SELECT site_id, event_id, CAST(to_json(list({{'timestamp': {iso_z('timestamp')}, 'id': id, 'camera_id': camera_id,
          'origin_key': origin_key, 'track_id': track_id, 'class_name': class_name, 'confidence': confidence,
          'bbox': CAST(bbox AS JSON)}} ORDER BY timestamp, id)) AS VARCHAR) AS detections
        FROM w_dets GROUP BY site_id, event_id),
  o AS MATERIALIZED (SELECT r.site_id, x.event_id, CAST(to_json(list({{'timestamp': {iso_z('r.timestamp')}, 'id': r.id,
          'detection_id': r.detection_id, 'raw_text': r.raw_text, 'normalized_text': r.normalized_text,
          'confidence': r.confidence, 'valid_format': r.valid_format, 'valid_check_digit': r.valid_check_digit,
          'validation_status': r.validation_status}} ORDER BY r.timestamp, r.id)) AS VARCHAR) AS ocr_results
        FROM w_ocr r JOIN w_dets x ON x.site_id = r.site_id AND x.id = r.detection_id GROUP BY r.site_id, x.event_id),
  s AS MATERIALIZED (SELECT site_id, event_id, CAST(to_json(list({{'timestamp': {iso_z('timestamp')}, 'id': id, 'camera_id': camera_id,
          'image_path': image_path}} ORDER BY timestamp, id)) AS VARCHAR) AS snapshots
        FROM w_snaps GROUP BY site_id, event_id)"""
Q["event_documents"] = f"""
  WITH {_DOC_PARTS}
  SELECT e.site_id, e.id AS event_id, e.gate_id, {iso_z('e.timestamp')} AS timestamp, e.container_number, e.event_type,
         e.status, strftime(e.timestamp, '%Y-%m-%d') AS event_date,
         CASE WHEN z.container_size = 'FEET' THEN 'FEET DETECTED' ELSE z.container_size END AS container_size, z.size_code,
         0 AS part, d.detections, coalesce(o.ocr_results, '[]') AS ocr_results, coalesce(s.snapshots, '[]') AS snapshots
  FROM w_events e LEFT JOIN d ON d.site_id = e.site_id AND d.event_id = e.id
  LEFT JOIN o ON o.site_id = e.site_id AND o.event_id = e.id LEFT JOIN s ON s.site_id = e.site_id AND s.event_id = e.id
  LEFT JOIN w_event_sizes z ON z.site_id = e.site_id AND z.event_id = e.id"""
Q["audit_log"] = f"""
  SELECT site_id, {sid('log', 'origin_key')} AS id, event_id, frame_timestamp AS timestamp, 'INFO' AS level,
         CASE WHEN created THEN 'gate_event_created' ELSE 'gate_evidence_associated' END AS event_name,
         '{{"camera_id":"' || camera_id || '","gate_id":"' || gate_id || '"}}' AS context FROM w_assigned"""
Q["orphan_images"] = f"""
  WITH f AS (SELECT DISTINCT site_id, {sid('event', 'origin_key')} || '/' || camera_id || '/' || track_id || '.jpg' AS image_path
             FROM w_reads WHERE camera_id <> 'gate-in-3'),
       n AS (SELECT DISTINCT site_id, image_path FROM w_snaps)
  SELECT site_id, image_path, 'UNREFERENCED_FILE' AS problem FROM (SELECT * FROM f EXCEPT SELECT * FROM n)
  UNION ALL SELECT site_id, image_path, 'MISSING_FILE' FROM (SELECT * FROM n EXCEPT SELECT * FROM f)"""

_R = "origin_key, sequence, arrival, raw_text"
Q["normalize_text"] = f"SELECT {_R}, regexp_replace(upper(raw_text), '[^A-Z0-9]', '', 'g') AS normalized FROM w_reads"
Q["iso6346_check_digit"] = f"""
  SELECT *, CASE WHEN regexp_full_match(prefix, '[A-Z]{{3}}[UJZ][0-9]{{6}}') THEN {weighted('prefix')} % 11 % 10 END AS check_digit
  FROM (SELECT {_R}, substr(regexp_replace(upper(raw_text), '[^A-Z0-9]', '', 'g'), 1, 10) AS prefix FROM w_reads)"""
Q["fix_size_code"] = f"SELECT {_R}, {fixed_size('raw_text')} AS corrected_text FROM w_reads"
Q["validate_reads"] = f"SELECT {_R}, confidence, {_VALID} FROM w_reads JOIN w_text_results USING (raw_text)"
Q["container_feet_size"] = f"SELECT {_R}, {feet('raw_text')} AS container_size FROM w_reads"
Q["extract_size_code"] = f"""
  SELECT origin_key, sequence, arrival, corrected AS raw_text, {size_code('corrected')} AS size_code
  FROM (SELECT *, {fixed_size('raw_text')} AS corrected FROM w_reads)"""
Q["clean_generated_text"] = rf"""
  SELECT *, CASE WHEN trim(generated, E' \n') = '' THEN 0.0::DOUBLE
                 WHEN regexp_matches(cleaned, '[A-Za-z]') AND regexp_matches(cleaned, '[0-9]') THEN 0.95::DOUBLE
                 WHEN regexp_matches(cleaned, '[0-9]') THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END AS text_confidence
  FROM (SELECT site_id, origin_key, sequence, arrival, generated, {fixed_size('picked')} AS cleaned FROM (
    SELECT *, CASE WHEN regexp_matches(upper(flat), '[A-Z]{{3,4}}\s*[0-9]{{6,7}}')
                   THEN regexp_extract(upper(flat), '[A-Z]{{3,4}}\s*[0-9]{{6,7}}') ELSE trim(flat) END AS picked
    FROM (SELECT *, translate(generated, E'\n-', '  ') AS flat FROM w_generated)))"""
Q["assemble_fragments"] = f"""
  WITH f AS (
    SELECT crop_id, replace({fixed_size("replace(joined, ' ', '  ')")}, '  ', ' ') AS text, confidence, fragments FROM (
      SELECT crop_id, string_agg(text, ' ' ORDER BY place, across, ordinal) AS joined,
             min(confidence) AS confidence, count(*) AS fragments
      FROM (SELECT *, CASE WHEN crop_h > 150 THEN top_y ELSE floor(top_y / 30) END AS place,
                   CASE WHEN crop_h > 150 THEN 0 ELSE left_x END AS across FROM w_fragments)
      GROUP BY crop_id)),
  c AS (SELECT 'S' || (o_orderkey % 4) AS site_id, o_orderkey AS crop_id FROM orders UNION
        SELECT 'S' || (o_orderkey % 4), -o_orderkey FROM orders WHERE o_orderkey % 50 = 0)
  SELECT c.site_id, c.crop_id, coalesce(text, '') AS text, coalesce(confidence, 0.0::DOUBLE) AS confidence,
         coalesce(fragments, 0) AS fragments
  FROM c LEFT JOIN f USING (crop_id)"""
Q["clean_detections"] = "SELECT * FROM w_clean"
Q["ocr_region"] = """
  SELECT * EXCLUDE (roi_y), CASE WHEN right_px > left_px AND bottom_px > top_px THEN 'OK' ELSE 'REJECTED' END AS status FROM (
    SELECT d.* EXCLUDE (width, height), c.ocr_roi[2] AS roi_y, CAST(floor(x1) AS INTEGER) AS left_px,
           CAST(floor(y1 + (y2 - y1) * c.ocr_roi[2]) AS INTEGER) AS top_px,
           CAST(least(ceil(x1 + (x2 - x1) * 1.0::DOUBLE), width) AS INTEGER) AS right_px,
           CAST(least(ceil(y1 + (y2 - y1) * 1.0::DOUBLE), height) AS INTEGER) AS bottom_px
    FROM w_clean d JOIN w_cameras c USING (site_id, camera_id))"""
Q["iou_pairs"] = f"""
  SELECT b.site_id, b.camera_id, b.source_id, b.class_name, b.sequence, a.det_index AS prev_index, b.det_index,
         {iou('a', 'b')} AS iou
  FROM w_clean a JOIN w_clean b ON a.site_id = b.site_id AND a.camera_id = b.camera_id AND a.source_id = b.source_id
   AND a.class_name = b.class_name AND b.sequence = a.sequence + 1"""
Q["evidence_keys"] = """
  SELECT site_id, camera_id, 'src0-generation-1' AS source_id, key AS origin_key, track_id, sequence,
         key || ':feet:' || CAST(trunc(12.7::DOUBLE + track_id % 5) AS INTEGER) AS extra_key,
         sha256('["' || key || '", ' || sequence || ']') AS folder
  FROM (SELECT *, 'run0:' || camera_id || ':src0-generat:' || track_id AS key FROM w_reads)"""
Q["event_table_rows"] = """
  SELECT e.site_id, e.id, e.timestamp, e.gate_id, e.event_type, coalesce(container_number, 'Unread / unconfirmed') AS container,
         coalesce(container_size || CASE WHEN size_code IS NOT NULL THEN ' (' || size_code || ')' ELSE '' END, '—') AS size,
         replace(status, '_', ' ') AS status_text
  FROM w_events e LEFT JOIN w_event_sizes z ON z.site_id = e.site_id AND z.event_id = e.id"""
Q["track_objects"] = """
  SELECT site_id, camera_id, source_id, sequence, det_index, class_name, track_id, hits, first_seen FROM w_tracked"""
Q["line_crossing_direction"] = """
  SELECT site_id, camera_id, source_id, sequence, det_index, track_id, track_direction FROM w_directed"""
Q["sample_min_spacing"] = "SELECT site_id, camera_id, source_id, sequence FROM w_rate_walk WHERE taken"
Q["sample_inference_rate"] = "SELECT site_id, camera_id, source_id, sequence FROM w_pace_walk WHERE taken"
Q["ocr_candidates"] = """
  SELECT site_id, camera_id, source_id, track_id, sequence, det_index, hits, track_direction FROM (
    SELECT *, row_number() OVER (PARTITION BY site_id, camera_id, source_id, track_id ORDER BY us, sequence, det_index) AS n
    FROM w_cand_walk WHERE taken) WHERE n <= 4"""
Q["dropped_frames"] = """
  SELECT site_id, camera_id, source_id, count(*) AS consumed, CAST(sum(jump) AS BIGINT) AS dropped FROM (
    SELECT *, sequence - coalesce(lag(sequence) OVER (PARTITION BY site_id, camera_id, source_id ORDER BY sequence), sequence - 1) - 1 AS jump
    FROM (SELECT DISTINCT site_id, camera_id, source_id, sequence FROM w_raw))
  GROUP BY site_id, camera_id, source_id"""
Q["confirm_reads"] = """
  SELECT * EXCLUDE (started_at, corrected_text, us, detection_confidence) FROM w_obs"""
Q["read_votes"] = """
  SELECT *, CAST(rank() OVER (PARTITION BY site_id, origin_key ORDER BY votes DESC) AS INTEGER) AS rank,
         count(*) OVER (PARTITION BY site_id, origin_key, votes) > 1 AS tied
  FROM (SELECT site_id, origin_key, normalized_text, count(*) AS votes FROM w_valid
        WHERE valid_check_digit AND confidence >= 0.6 GROUP BY ALL)"""
Q["associate_events"] = """
  SELECT site_id, gate_id, direction, origin_key, frame_timestamp, confirmed, container_number, event_id, created, promoted,
         event_timestamp FROM w_assigned"""
Q["gate_events"] = "SELECT * FROM w_events"
Q["dedup_visits"] = "SELECT * FROM w_visits"
Q["confirmed_visits"] = "SELECT * FROM w_visits WHERE gate_id = 'lane-in' ORDER BY first_seen DESC, site_id, container_number"
Q["idempotent_append"] = """
  SELECT * EXCLUDE (rn) FROM (
    SELECT 'S' || (track_id % 4) AS site_id, track_id, sequence, arrival, raw_text, confidence,
           row_number() OVER (PARTITION BY track_id ORDER BY sequence, arrival, raw_text, confidence) AS rn FROM w_reads) r
  WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = r.track_id AND o_orderstatus <> 'O')"""
Q["evidence_rows"] = "SELECT * FROM w_dets"
Q["enrich_with_camera"] = """
  SELECT r.site_id, r.camera_id, r.origin_key, r.sequence, r.arrival, c.role, c.gate_id, c.direction,
         CAST(to_json(c.ocr_roi) AS VARCHAR) AS ocr_roi
  FROM w_reads r LEFT JOIN w_cameras c USING (site_id, camera_id)"""
Q["events_seen_by_camera"] = """
  SELECT * FROM w_events e WHERE EXISTS (SELECT 1 FROM w_dets d WHERE d.site_id = e.site_id AND d.event_id = e.id
                                          AND d.camera_id = 'gate-in-2')"""
Q["event_evidence"] = """
  SELECT e.*, d.id AS detection_id, d.camera_id, d.track_id, d.class_name, d.confidence AS detection_confidence,
         o.id AS ocr_id, o.normalized_text, o.validation_status, o.confidence AS ocr_confidence
  FROM w_events e LEFT JOIN w_dets d ON d.site_id = e.site_id AND d.event_id = e.id
  LEFT JOIN w_ocr o ON o.site_id = d.site_id AND o.detection_id = d.id"""
Q["event_images"] = """
  SELECT e.*, s.id AS snapshot_id, s.image_path, s.camera_id AS image_camera_id
  FROM w_events e LEFT JOIN w_snaps s ON s.site_id = e.site_id AND s.event_id = e.id"""
Q["candidate_events"] = f"""
  SELECT o.site_id, o.gate_id, o.direction, o.origin_key, o.us AS observation_us, e.id AS event_id, e.container_number,
         epoch_us(e.timestamp) AS event_us,
         CAST(row_number() OVER (PARTITION BY o.site_id, o.origin_key ORDER BY e.timestamp DESC, e.id) AS INTEGER) AS nearness
  FROM w_assigned o JOIN w_events e ON e.site_id = o.site_id AND e.gate_id = o.gate_id AND e.event_type = o.direction
   AND epoch_us(e.timestamp) BETWEEN o.us - {WINDOW_US} AND o.us + {WINDOW_US}"""
Q["overlay_asof"] = """
  SELECT f.site_id, f.camera_id, f.source_id, f.sequence, f.us AS frame_us,
         CASE WHEN f.us - i.us <= 300000 THEN i.us END AS inference_us,
         CASE WHEN f.us - i.us <= 300000 THEN i.sequence END AS inference_sequence,
         CASE WHEN f.us - i.us <= 300000 THEN i.n_detections END AS n_detections
  FROM w_frames f ASOF LEFT JOIN (SELECT * FROM w_frames WHERE sequence % 3 = 0) i
    ON f.site_id = i.site_id AND f.camera_id = i.camera_id AND f.source_id = i.source_id AND f.us >= i.us"""
Q["overlay_nearby"] = """
  SELECT * FROM (
    SELECT f.site_id, f.camera_id, f.sequence, f.us AS frame_us, epoch_us(d.frame_timestamp) AS detection_us,
           d.sequence AS detection_sequence, d.det_index, d.class_name,
           CAST(row_number() OVER (PARTITION BY f.site_id, f.camera_id, f.sequence, f.us
                ORDER BY d.frame_timestamp DESC, d.sequence DESC, d.det_index DESC) AS INTEGER) AS nearness
    FROM w_frames f JOIN w_clean d ON d.site_id = f.site_id AND d.camera_id = f.camera_id
     AND abs(epoch_us(d.frame_timestamp) - f.us) <= 800000) WHERE nearness <= 10"""
_FOUND = """
  FROM w_events e WHERE event_type = 'ENTRY' AND status = 'CONFIRMED' AND EXISTS (
    SELECT 1 FROM w_dets d WHERE d.site_id = e.site_id AND d.event_id = e.id AND d.camera_id = 'gate-in-1')"""
Q["search_events"] = f"""
  WITH p AS (SELECT * {_FOUND} ORDER BY timestamp DESC, id, site_id LIMIT 50 OFFSET 10)
  SELECT p.*, z.container_size, z.size_code FROM p LEFT JOIN w_event_sizes z ON z.site_id = p.site_id AND z.event_id = p.id"""
Q["search_pages"] = Q["search_events"].replace("LIMIT 50 OFFSET 10", "LIMIT 20 OFFSET 20")
Q["search_store"] = """
  WITH p AS (SELECT * FROM w_events WHERE container_number = 'TCLU0316764' AND timestamp < TIMESTAMP '2026-01-03'
             ORDER BY timestamp DESC, id, site_id LIMIT 200)
  SELECT p.*, z.container_size, z.size_code FROM p LEFT JOIN w_event_sizes z ON z.site_id = p.site_id AND z.event_id = p.id"""
Q["count_events"] = f"SELECT count(*) AS total {_FOUND}"
Q["event_sizes"] = "SELECT * FROM w_event_sizes"
Q["recent_ocr"] = "SELECT * FROM w_ocr ORDER BY timestamp DESC, id DESC LIMIT 50 OFFSET 25"
Q["recent_detections"] = """
  SELECT * EXCLUDE (width, height) FROM w_clean WHERE camera_id = 'gate-in-3'
  ORDER BY frame_timestamp DESC, site_id DESC, camera_id DESC, sequence DESC, det_index DESC LIMIT 20"""
Q["rows_for_ids"] = f"""
  SELECT a.site_id, a.id, coalesce(e.status, 'MISSING') AS status
  FROM (SELECT DISTINCT site_id, {sid('event', 'origin_key')} AS id FROM w_reads) a
  LEFT JOIN w_events e ON e.site_id = a.site_id AND e.id = a.id"""
Q["next_jobs"] = """
  SELECT * FROM (SELECT site_id, id, origin, sequence, retry_at,
                        CAST(row_number() OVER (PARTITION BY site_id ORDER BY id) AS INTEGER) AS turn
                 FROM w_jobs WHERE state = 'PENDING' AND retry_at <= 200) WHERE turn <= 100"""
Q["next_job_per_origin"] = """
  SELECT site_id, origin, min(id) AS id FROM w_jobs WHERE state = 'PENDING' AND retry_at <= 200 GROUP BY site_id, origin"""
Q["snapshot_manifest"] = f"""
  WITH near AS (
    SELECT e.site_id, e.id AS event_id, f.camera_id, f.frame_timestamp, row_number() OVER (
      PARTITION BY e.site_id, e.id, f.camera_id ORDER BY abs(epoch_us(f.frame_timestamp) - epoch_us(e.timestamp)), f.frame_timestamp) AS rn
    FROM w_events e JOIN (SELECT DISTINCT site_id, gate_id, camera_id, frame_timestamp FROM w_reads) f
      ON f.site_id = e.site_id AND f.gate_id = e.gate_id
     AND f.frame_timestamp BETWEEN e.timestamp - INTERVAL 5 SECOND AND e.timestamp + INTERVAL 5 SECOND)
  SELECT * FROM w_snaps
  UNION ALL
  SELECT c.site_id, {sid('companion', 'c.event_id', 'c.camera_id')}, c.event_id, c.camera_id, c.event_id || '/' || c.camera_id || '.jpg',
         c.frame_timestamp
  FROM near c WHERE rn = 1
    AND NOT EXISTS (SELECT 1 FROM w_snaps s WHERE s.site_id = c.site_id AND s.event_id = c.event_id AND s.camera_id = c.camera_id)"""
Q["job_ledger"] = "SELECT * FROM w_ledger"
Q["recover_evidence"] = """
  SELECT site_id, origin,
         CAST(to_json(coalesce(list(normalized_text ORDER BY id) FILTER (has_validation), [])) AS VARCHAR) AS read_texts,
         arg_min(event_id, id) FILTER (event_id IS NOT NULL) AS event_id, arg_max(sequence, id) AS last_sequence
  FROM (SELECT *, row_number() OVER (PARTITION BY site_id, origin ORDER BY id DESC) AS rn FROM w_jobs WHERE state = 'DONE')
  WHERE rn <= 4 GROUP BY site_id, origin"""
# The run without a restart, less the reads whose job lost its metadata.
_CHAIN = ("w_valid", "w_attempts", "w_prefix_votes", "w_leaders", "w_emissions", "w_supporters", "w_obs")
for _name in _CHAIN:
    STEPS[_name.replace("w_", "w_kept_")] = "SELECT * FROM w_valid WHERE arrival % 97 <> 0" if _name == "w_valid" else re.sub(
        r"\b(" + "|".join(_CHAIN) + r")\b", lambda m: m[0].replace("w_", "w_kept_"), STEPS[_name])
Q["spool_replay"] = """
  WITH known AS (SELECT site_id, origin AS origin_key, arg_min(event_id, id) AS known_event_id
    FROM w_jobs WHERE state = 'DONE' AND event_id IS NOT NULL GROUP BY ALL)
  SELECT o.site_id, o.origin_key, sequence, frame_timestamp, normalized_text, confidence, confirmed, container_number, attempts,
         known_event_id
  FROM w_kept_obs o LEFT JOIN known k ON k.site_id = o.site_id AND k.origin_key = o.origin_key"""
Q["spool_status"] = """
  SELECT site_id, count(*) AS total, count(*) FILTER (state = 'PENDING') AS pending, count(error_type) AS failed,
         CAST(sum(payload_bytes) AS BIGINT) AS payload_bytes, min(id) FILTER (used > 9000000) AS first_rejected_id
  FROM (SELECT *, sum(payload_bytes) OVER (PARTITION BY site_id ORDER BY id) AS used FROM w_jobs) GROUP BY site_id"""
Q["outbox_payloads"] = f"""
  SELECT site_id, {sid('delivery', 'origin_key')} AS delivery_id, event_id,
         CAST(to_json({{'id': event_id, 'gateId': gate_id, 'timestamp': strftime(frame_timestamp, '%Y-%m-%dT%H:%M:%S.%gZ'),
           'containerNumber': normalized_text, 'trailerNumber': normalized_text, 'eventType': direction,
           'deviceId': 'device-0', 'confidence': detection_confidence}}) AS VARCHAR) AS payload,
         substr(normalized_text, 1, 4) AS scac, direction AS direction_raw
  FROM w_assigned WHERE confirmed"""
Q["outbox_schedule"] = "SELECT * FROM w_schedule"
Q["outbox_counts"] = """
  SELECT site_id, delivery_state, count(*) AS deliveries, CAST(sum(latency_us) AS DOUBLE) / count(latency_us) AS mean_us,
         list_sort(list(CAST(latency_us AS DOUBLE)) FILTER (latency_us IS NOT NULL))[
             CAST(floor((count(latency_us) - 1) * 0.5::DOUBLE) AS INTEGER) + 1] AS p50_us,
         list_sort(list(CAST(latency_us AS DOUBLE)) FILTER (latency_us IS NOT NULL))[
             CAST(floor((count(latency_us) - 1) * 0.95::DOUBLE) AS INTEGER) + 1] AS p95_us
  FROM w_schedule GROUP BY site_id, delivery_state"""
Q["counters"] = """
  SELECT 'S' || (event_id % 4) AS site_id, event_type AS key, count(*) AS occurrences FROM events GROUP BY ALL"""
Q["latency_quantiles"] = quantiles("(SELECT 'S' || (event_id % 4) AS site_id, * FROM events)", "event_type", "value")
Q["rolling_fps"] = """
  SELECT site_id, camera_id, sequence, us AS frame_us, frames_in_window, frames_in_window / 5.0::DOUBLE AS fps FROM (
    SELECT *, count(*) OVER (PARTITION BY site_id, camera_id ORDER BY us RANGE BETWEEN 4999999 PRECEDING AND CURRENT ROW)
             AS frames_in_window FROM w_frames)"""
Q["fleet_status"] = """
  WITH c AS (SELECT 'N' || c_nationkey AS site_id, c_acctbal > 0 AS enabled, c_custkey % 9 > 0 AS has_frame,
                    c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AS online,
                    CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'COMPLETED'
                         WHEN c_mktsegment = 'FURNITURE' THEN 'STOPPED' ELSE 'PLAYING' END AS playback FROM customer),
       j AS (SELECT 'N' || (job_id % 40) AS site_id, count(*) FILTER (state = 'PENDING') AS pending,
                    count(error_type) AS failed FROM w_ledger WHERE job_id % 2 = 0 GROUP BY 1),
       v AS (SELECT site_id, count(*) FILTER (enabled) AS enabled_cameras, count(*) FILTER (enabled AND online) AS online_cameras,
                    count(*) FILTER (enabled AND playback = 'PLAYING') AS playing_cameras,
                    count(*) FILTER (enabled AND has_frame) AS cameras_with_video,
                    count(*) FILTER (enabled AND NOT online AND playback <> 'COMPLETED') AS unusable FROM c GROUP BY site_id)
  SELECT v.* EXCLUDE (unusable), coalesce(pending, 0) AS pending_jobs, coalesce(failed, 0) AS failed_jobs,
         CASE WHEN coalesce(failed, 0) = 0 AND enabled_cameras > 0 AND unusable = 0 THEN 'READY' ELSE 'DEGRADED' END AS fleet_state
  FROM v LEFT JOIN j USING (site_id)"""
Q["event_summary"] = """
  SELECT site_id, gate_id, event_type, date_trunc('hour', timestamp) AS hour, count(*) AS events,
         count(*) FILTER (status = 'NEEDS_REVIEW') AS in_review, count(DISTINCT container_number) AS numbers,
         count(*) FILTER (status = 'NEEDS_REVIEW') / count(*)::DOUBLE AS review_rate,
         (count(container_number) - count(DISTINCT container_number)) / count(*)::DOUBLE AS duplicate_rate
  FROM w_events GROUP BY ALL"""
Q["event_latency"] = quantiles(
    "w_assigned", "CASE WHEN created THEN 'events_created' ELSE 'evidence_associated' END",
    "(epoch_us(frame_timestamp) - epoch_us(started_at)) / 1000000.0::DOUBLE")

# Streams give what the batch form gives.
Q["stream_tracks"] = Q["track_objects"]
Q["stream_confirm"] = """
  SELECT site_id, origin_key, sequence, frame_timestamp, normalized_text, confidence, confirmed, container_number, attempts
  FROM w_obs"""
Q["stream_events"] = Q["associate_events"]
Q["stream_gate_events"] = Q["gate_events"]
# A row that comes three slices late is late unless the newest row before its slice is less than a slice ahead of it.
Q["stream_late_rows"] = """
  WITH timed AS (SELECT *, epoch_us(frame_timestamp) AS us, (track_id * 7 + sequence) % 10 = 0 AS held FROM w_reads),
  cut AS (SELECT *, (us - min(us) OVER ()) // width AS own FROM timed,
    (SELECT (max(us) - min(us)) // 3 + 1 AS width FROM timed)),
  arrived AS (SELECT *, own + CASE WHEN held THEN 3 ELSE 0 END AS slice FROM cut),
  newest AS (SELECT slice, max(us) AS us FROM arrived GROUP BY slice),
  edges AS (SELECT a.slice, max(b.us) AS before FROM newest a JOIN newest b ON b.slice < a.slice GROUP BY 1)
  SELECT site_id, origin_key, sequence, arrival, coalesce(us < before - width, false) AS late
  FROM arrived LEFT JOIN edges USING (slice)"""
Q["stream_dedup"] = "SELECT DISTINCT site_id, origin_key, sequence FROM w_reads"
Q["stream_fps"] = """
  SELECT site_id, camera_id, make_timestamp(((us // 1000000) - back) * 1000000) AS window_start, count(*) AS frames
  FROM w_frames, (SELECT unnest(range(5)) AS back) GROUP BY ALL"""
Q["stream_outbox"] = Q["outbox_payloads"]


def needed(sql: str) -> list[str]:
    """Steps the text names, with their own, in definition order."""
    found: set[str] = set()
    open_texts = [sql]
    while open_texts:
        for name in set(re.findall(r"\bw_[a-z_]+\b", open_texts.pop())) - found:
            found.add(name)
            open_texts.append(STEPS[name])
    return [name for name in STEPS if name in found]


def compose(sql: str) -> str:
    names = needed(sql)
    if not names:
        return sql
    parts = [f"{n} AS {'' if n in RECURSIVE else 'MATERIALIZED '}({STEPS[n]})" for n in names]
    body = sql.strip()
    if body.startswith("WITH "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[len("WITH "):]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


def oracle_sql() -> dict[str, str]:
    return {name: compose(sql) for name, sql in Q.items()}
