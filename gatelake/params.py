"""Tunable thresholds of the gate pipeline, in one immutable record."""

from __future__ import annotations

from dataclasses import dataclass

# Class vocabulary of the detector and the classes that carry text.
CLASS_ALIASES = {"cointainer": "container", "container_object": "container", "feet": "feet"}
TARGET_CLASSES = ("container", "trailer", "truck", "vehicle", "feet", "cointainer", "container_object")
OCR_CLASSES = ("container", "trailer", "cointainer", "container_object", "feet")


@dataclass(frozen=True)
class GateParams:
    inference_fps: float = 3.0
    confidence_threshold: float = 0.35
    ocr_min_confidence: float = 0.6
    min_track_hits: int = 3
    ocr_confirmations: int = 2
    ocr_max_attempts: int = 4
    ocr_interval_seconds: float = 1.0
    dedup_seconds: float = 30.0
    track_ttl_seconds: float = 5.0
    match_iou: float = 0.25

    def __post_init__(self):
        if self.ocr_max_attempts < self.ocr_confirmations:
            raise ValueError("ocr_max_attempts must be at least ocr_confirmations")

    @property
    def dedup_us(self) -> int:
        return micros(self.dedup_seconds)

    @property
    def track_ttl_us(self) -> int:
        return micros(self.track_ttl_seconds)

    @property
    def ocr_interval_us(self) -> int:
        return micros(self.ocr_interval_seconds)


def micros(seconds: float) -> int:
    return round(seconds * 1_000_000)


DEFAULTS = GateParams()
