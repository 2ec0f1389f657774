"""Parameters of the timeline operators. Results depend on them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Analysis:
    least_side: int = 320
    least_seconds: float = 0.4
    least_bytes: int = 1024
    blur_below: float = 60.0
    clipped_above: float = 0.28
    black_above: float = 0.45
    hamming: int = 10


@dataclass(frozen=True)
class Trip:
    stop_metres: float = 400.0
    visit_metres: float = 3000.0
    visit_gap_hours: float = 8.0
    chapter_gap_hours: float = 5.0
    chapter_move_metres: float = 2500.0
    borrow_hours: float = 6.0
    join_slack_seconds: float = 1.0


@dataclass(frozen=True)
class Plan:
    target_seconds: float = 180.0
    least_photo_seconds: float = 2.0
    photo_slot: float = 3.0
    video_slot: float = 2.0
    photo_range: tuple[float, float] = (2.6, 4.6)
    video_range: tuple[float, float] = (1.8, 5.0)
    title_beats_share: float = 0.12
    title_seconds: float = 2.5
    title_share: float = 0.18
    video_share: float = 0.32
    quota_share: float = 0.7
    per_minute: int = 2
    bpm: float = 120.0
    fps: int = 30


EARTH_KM = 6371.0088
# File kinds and junk names that the catalogue rules name.
PHOTO_SUFFIXES = (".jpg", ".jpeg", ".png", ".heic", ".heif", ".webp", ".tif", ".tiff", ".dng", ".arw", ".cr2", ".nef", ".gif")
VIDEO_SUFFIXES = (".mp4", ".mov", ".m4v", ".avi", ".mkv", ".insv", ".mts", ".m2ts", ".webm", ".3gp")
AUDIO_SUFFIXES = (".mp3", ".m4a", ".wav", ".aac", ".flac", ".aiff", ".aif", ".ogg")
JUNK_NAMES = (".ds_store", ".nomedia", "thumbs.db")
