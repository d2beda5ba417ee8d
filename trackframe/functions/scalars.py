"""Pixel, name, time and report scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band limits of a byte cut in thirds, and the codes they give.
LOW_LIMIT = 85
HIGH_LIMIT = 170
BAND_CODES = {"low": 3, "medium": 2, "high": 5}
CORRECTED_CODES = {"low": 1, "medium": 2, "high": 3}

# Weights of blue, green and red in a gray level.
GRAY_WEIGHTS = (0.114, 0.587, 0.299)


def quantize(value: Column, scale: int) -> Column:
    """floor(v * scale / 255); integer arithmetic, as v and scale are whole."""
    return F.floor(value * F.lit(scale) / F.lit(255.0)).cast("int")


def to_gray(blue: Column, green: Column, red: Column) -> Column:
    b, g, r = GRAY_WEIGHTS
    return F.bround(blue * F.lit(b) + green * F.lit(g) + red * F.lit(r)).cast("int")


def level3(value: Column, corrected: bool = False) -> Column:
    """Band code of a byte; the default codes keep the published overlap of bands."""
    codes = CORRECTED_CODES if corrected else BAND_CODES
    return (
        F.when(value <= LOW_LIMIT, F.lit(codes["low"]))
        .when(value < HIGH_LIMIT, F.lit(codes["medium"]))
        .otherwise(F.lit(codes["high"]))
    )


def round2(value: Column) -> Column:
    return F.bround(value * 100) / 100


def pct(part: Column, whole: Column) -> Column:
    """Share as text with two decimals at most, such as 12.34%."""
    share = F.bround(part / whole * 10000) / 100
    return F.concat(share.cast("string"), F.lit("%"))


def frame_name(frame: Column) -> Column:
    """Six digits, more where the number has more."""
    return F.format_string("%06d", frame.cast("long"))


def frame_from_name(name: Column) -> Column:
    return F.regexp_extract(name, r"(\d+)(?:\.[A-Za-z0-9]+)?$", 1).cast("long")


def dataset_from_path(path: Column, marker: str = "Datasets") -> Column:
    """The part of a path between the marker folder and the last segment."""
    return F.regexp_extract(path, rf"{marker}/(.+)/[^/]*$", 1)


def minutes_since(then: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(then)) / F.lit(60_000_000.0)


def video_length(frame_count: Column, fps: Column) -> Column:
    return F.when(fps != 0, frame_count / fps)


def flatten_once(nested: Column) -> Column:
    return F.flatten(nested)


def dim_outside(value: Column, mask: Column) -> Column:
    """Halve a gray level where the mask is off."""
    return F.when(mask == 0, F.floor(value * F.lit(0.5))).otherwise(value).cast("int")
