"""Intervals of time as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Closed intervals: touching counts."""
    return (a_end >= b_start) & (a_start <= b_end)


def iou(p_start: Column, p_end: Column, g_start: Column, g_end: Column) -> Column:
    """Intersection over the hull, which is the union wherever they meet."""
    both = F.greatest(F.lit(0.0), F.least(p_end, g_end) - F.greatest(p_start, g_start))
    return both / F.greatest(F.lit(1e-6), F.greatest(p_end, g_end) - F.least(p_start, g_start))


def duration(frames: Column, fps: Column) -> Column:
    return F.when(fps > 0, frames / fps).otherwise(0.0)


def frame_at(t: Column, fps: Column, total: Column) -> Column:
    return F.greatest(F.lit(0), F.least((t * fps).cast("long"), F.greatest(F.lit(0), total - 1)))
