"""Settings of an alignment run, checked when they are made, and the signatures of its stages."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import math
from dataclasses import dataclass


class InputError(ValueError):
    """An input that doesn't hold what it must."""


@dataclass(frozen=True)
class Config:
    """Defaults are fixed values of the workload."""

    g2p_backend: str = "sudachi"
    device: str = "cpu"
    sample_rate: int = 16_000
    enable_offset: bool = True
    offset_low_ms: int = -2000
    offset_high_ms: int = 2000
    offset_step_ms: int = 40
    offset_boundary_check: bool = True
    offset_silence_ms: int = 2000
    offset_sustain_ms: int = 200
    offset_boundary_tolerance_ms: int = 800
    offset_acoustic_verify: bool = False
    offset_acoustic_min_margin: float = 0.15
    ctc_model: str | None = None
    ctc_margin_ms: int = 500
    ctc_activity_margin_ms: int = 120
    activity_confidence_threshold: float = 0.45
    activity_projection_confidence_threshold: float = 0.35
    ctc_score_threshold: float = -2.25
    ctc_coverage_threshold: float = 0.8
    keep_vocals: bool = False
    keep_instrumental: bool = True
    vocals_format: str = "mp3"
    instrumental_format: str = "mp3"
    pipeline_version: str = "0.14"

    def __post_init__(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(self.g2p_backend in ("sudachi", "pykakasi", "openjtalk", "lexicon", "kana"), f"unknown g2p_backend {self.g2p_backend!r}")
        need(self.sample_rate > 0 and self.offset_step_ms > 0, "rates and steps must be positive")
        need(self.offset_low_ms <= self.offset_high_ms, "offset_low_ms must not be above offset_high_ms")
        need(self.offset_silence_ms > 0 and self.offset_sustain_ms > 0, "durations must be positive")
        need(min(self.ctc_margin_ms, self.ctc_activity_margin_ms, self.offset_boundary_tolerance_ms) >= 0, "margins must not be negative")
        for name in ("activity_confidence_threshold", "activity_projection_confidence_threshold", "ctc_coverage_threshold"):
            need(0 <= getattr(self, name) <= 1, f"{name} must be between 0 and 1")
        need(math.isfinite(self.ctc_score_threshold), "ctc_score_threshold must be finite")
        need(math.isfinite(self.offset_acoustic_min_margin) and self.offset_acoustic_min_margin >= 0, "offset_acoustic_min_margin must be finite and not negative")
        need({self.vocals_format, self.instrumental_format} <= {"mp3", "flac", "wav"}, "formats are mp3, flac and wav")
        need(not self.offset_acoustic_verify or (self.enable_offset and bool(self.ctc_model)), "acoustic verification needs the offset and a model")

    def signature(self, stage: str) -> str:
        """A hash of the settings that a stage's result depends on."""
        d = dataclasses.asdict(self)
        reading = ["g2p_backend", "sample_rate"] + [k for k in d if k.startswith(("enable_offset", "offset_"))]
        fields = {
            "reading": reading + (["ctc_model", "ctc_coverage_threshold", "device"] if self.offset_acoustic_verify else []),
            "demucs": ["device", "keep_vocals", "keep_instrumental", "vocals_format", "instrumental_format"],
            "ctc": ["ctc_model", "device", "sample_rate", "ctc_margin_ms", "ctc_activity_margin_ms", "activity_confidence_threshold", "activity_projection_confidence_threshold", "ctc_score_threshold", "ctc_coverage_threshold", "pipeline_version"],
        }[stage]
        return hashlib.sha256(json.dumps({k: d[k] for k in sorted(fields)}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
