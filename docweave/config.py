"""Settings of the engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Thresholds; the defaults reproduce the established behaviour, odd cases included.

    debug_dir: a folder for the preprocessed images. strict: parse French ID lines by their layout, rather than as a passport's name line with a shifted country.
    """

    accept_threshold: int = 70
    warning_threshold: int = 55
    critical_floor: int = 45
    min_width: int = 200
    min_height: int = 150
    min_char_height: float = 4.0
    line_tolerance: float = 15.0
    correction_score: float = 88.0
    single_word_score: float = 82.0
    multi_word_score: float = 75.0
    fast_mode: bool = False
    resize_min: int = 1200
    resize_max: int = 1600
    sharpness_threshold: int = 75
    contrast_threshold: int = 75
    max_deskew: float = 15.0
    ocr_max_side: int = 960
    colour_masks: bool = False
    strict: bool = False
    debug_dir: str | None = None


DEFAULT = EngineConfig()
