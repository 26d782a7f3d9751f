"""Boxes in time and frequency as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE_PX = 256
CLIP_SECONDS = 3.0
LOW_HZ, HIGH_HZ = 50.0, 15000.0


def _mel(hz: float) -> float:
    return 2595.0 * math.log10(1.0 + hz / 700.0)


def pixel_to_hz(y: Column) -> Column:
    """Frequency at an image row (0 is the top): inverse mel, within the band, rounded half to even."""
    low, high = _mel(LOW_HZ), _mel(HIGH_HZ)
    mel = (F.lit(1.0) - y / F.lit(float(IMAGE_PX))) * F.lit(high - low) + F.lit(low)
    hz = F.lit(700.0) * (F.pow(F.lit(10.0), mel / F.lit(2595.0)) - 1)
    return F.rint(F.least(F.lit(HIGH_HZ), F.greatest(F.lit(LOW_HZ), hz))).cast("int")


def hz_to_mel_share(hz: Column) -> Column:
    """Position of a frequency between both ends of the band on the mel scale, not clipped."""
    low, high = _mel(LOW_HZ), _mel(HIGH_HZ)
    return (F.lit(2595.0) * F.log10(F.lit(1.0) + hz / F.lit(700.0)) - F.lit(low)) / F.lit(high - low)


def pixel_to_seconds(x: Column, clip_start: Column) -> Column:
    return clip_start + x / F.lit(float(IMAGE_PX)) * F.lit(CLIP_SECONDS)


def time_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """True if both intervals share more than a point."""
    return (s1 < e2) & (s2 < e1)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def hull_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection over hull of two intervals, 0 for an empty hull."""
    inter = F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))
    return _share(inter, F.greatest(e1, e2) - F.least(s1, s2))


def interval_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection over union of two intervals, 0 unless they share more than a point."""
    inter = F.least(e1, e2) - F.greatest(s1, s2)
    return F.when(time_overlap(s1, e1, s2, e2), _share(inter, (e1 - s1) + (e2 - s2) - inter)).otherwise(F.lit(0.0))


def box_iou(s1: Column, e1: Column, l1: Column, h1: Column, s2: Column, e2: Column, l2: Column, h2: Column) -> Column:
    """Intersection over union of two boxes in time and frequency, 0 for an empty union."""
    wide = F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))
    high = F.greatest(F.lit(0.0), (F.least(h1, h2) - F.greatest(l1, l2)).cast("double"))
    inter = wide * high
    return _share(inter, (e1 - s1) * (h1 - l1) + (e2 - s2) * (h2 - l2) - inter)
