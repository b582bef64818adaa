"""Boxes as structs of x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Corners in order, whichever way they were given."""
    return F.struct(F.least(x1, x2).alias("x1"), F.least(y1, y2).alias("y1"), F.greatest(x1, x2).alias("x2"), F.greatest(y1, y2).alias("y2"))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0), b["x2"] - b["x1"]) * F.greatest(F.lit(0), b["y2"] - b["y1"])


def intersection_area(a: Column, b: Column) -> Column:
    side = lambda low, high: F.greatest(F.lit(0), F.least(a[high], b[high]) - F.greatest(a[low], b[low]))
    return side("x1", "x2") * side("y1", "y2")


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the boxes don't meet."""
    both = intersection_area(a, b)
    return F.when(both > 0, both / (area(a) + area(b) - both)).otherwise(0.0)


def gap(a: Column, b: Column, axis: str) -> Column:
    """Distance along x or y; 0 where they overlap."""
    return F.greatest(F.lit(0), b[f"{axis}1"] - a[f"{axis}2"], a[f"{axis}1"] - b[f"{axis}2"])


def overlap(a: Column, b: Column, axis: str) -> Column:
    return F.greatest(F.lit(0), F.least(a[f"{axis}2"], b[f"{axis}2"]) - F.greatest(a[f"{axis}1"], b[f"{axis}1"]))
