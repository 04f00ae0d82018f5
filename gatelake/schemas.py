"""Explicit schemas of the tables and of the JSON documents inside them."""

DETECTION_ROWS = (
    "site_id string, camera_id string, source_id string, sequence bigint, frame_timestamp timestamp_ntz, "
    "width int, height int, det_index int, label string, confidence double, x1 double, y1 double, x2 double, y2 double"
)

READ_ROWS = (
    "site_id string, camera_id string, gate_id string, direction string, origin_key string, track_id bigint, "
    "sequence bigint, frame_timestamp timestamp_ntz, started_at timestamp_ntz, arrival bigint, raw_text string, "
    "confidence double"
)

_DETECTION = ("struct<camera_id: string, frame_timestamp: string, class_name: string, confidence: double, "
              "bbox: array<double>>")

JOB_METADATA = (
    "struct<origin_key: string, gate_id: string, track_id: bigint, direction: string, role: string, "
    "started_at: string, roi: array<double>, "
    f"detection: {_DETECTION}, all_detections: array<{_DETECTION}>, "
    "frame: struct<camera_id: string, timestamp: string, sequence: bigint, source_id: string>>"
)

JOB_VALIDATION = (
    "struct<raw_text: string, normalized_text: string, confidence: double, valid_format: boolean, "
    "valid_check_digit: boolean, validation_status: string>"
)
