"""Sizes and orientation of pictures and videos."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def thumb_height(w: Column, h: Column, width: int = 450) -> Column:
    """Height beside a width of 450; narrower pictures stay as they are."""
    return F.when(w < width, h).otherwise(F.floor((F.lit(float(width)) * h / w).cast("float").cast("double") + 0.5).cast("int"))


def thumb_width(w: Column, width: int = 450) -> Column:
    return F.when(w < width, w).otherwise(width)


def fit_scale(w: Column, h: Column, long: int = 2560, short: int = 1440) -> Column:
    wide = w > h
    most_w, most_h = F.when(wide, long).otherwise(short), F.when(wide, short).otherwise(long)
    return F.least(F.lit(1.0), most_w / w, most_h / h)


def fitted(size: Column, scale: Column) -> Column:
    return F.floor(size * scale).cast("int")


def poster_size(size: Column, w: Column, h: Column, most: int = 450) -> Column:
    return F.greatest(F.lit(1), F.floor(size * F.least(F.lit(1.0), most / F.greatest(w, h)) + 0.5).cast("int"))


def poster_time(duration: Column) -> Column:
    return F.when(duration > 0, F.least(F.greatest(duration * 0.1, F.lit(0.1)), F.lit(1.0))).otherwise(0.0)


#: What each orientation code asks for.
ORIENTATION = {1: "none", 2: "flip horizontal", 3: "rotate 180", 4: "flip vertical", 5: "rotate 90, flip horizontal", 6: "rotate 90", 7: "rotate 270, flip horizontal", 8: "rotate 270"}


def orientation(code: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in ORIENTATION.items() for v in kv)), code), F.lit("none"))


def within_limit(size: Column, most: int = 100 << 20) -> Column:
    return size <= most
