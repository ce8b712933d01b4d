"""Explicit schemas of the inputs; nothing is inferred."""

SESSIONS = "id BIGINT, session_date DATE, captured_at TIMESTAMP, device STRING, kind STRING, covariates MAP<STRING,STRING>, created_at TIMESTAMP"
IMAGES = "id BIGINT, session_id BIGINT, pose STRING, lens STRING, device STRING, path STRING, sha256 STRING, bytes BIGINT, width_px INT, height_px INT, qa_verdict STRING, created_at TIMESTAMP"
EXPORT = (
    "schema INT, profile_id STRING, images ARRAY<STRUCT<id: STRING, profile_id: STRING, date: STRING, pose: STRING, kind: STRING, "
    "width: INT, height: INT, sha256: STRING, bytes: STRING, px_per_mm: VARIANT, reviewed: BOOLEAN, "
    "labels: ARRAY<STRUCT<x: DOUBLE, y: DOUBLE, radius: DOUBLE>>>>"
)
CONTROL_POINTS = "image STRING, image_w INT, image_h INT, points ARRAY<STRUCT<id: INT, x_px: DOUBLE, y_px: DOUBLE>>"
