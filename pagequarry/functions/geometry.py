"""Boxes as structs of x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def centre(b: Column) -> tuple[Column, Column]:
    return (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2


def touches_edge(b: Column, page_height: Column, margin: float = 5.0) -> Column:
    """Whether a region touches the top or bottom of its page."""
    return (b["y1"] < margin) | (b["y2"] > page_height - margin)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where boxes don't overlap."""
    wide = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    high = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    union = area(a) + area(b) - wide * high
    return F.when(union > 0, wide * high / F.when(union > 0, union)).otherwise(0.0)


def contains(a: Column, b: Column) -> Column:
    return (a["x1"] <= b["x1"]) & (a["y1"] <= b["y1"]) & (a["x2"] >= b["x2"]) & (a["y2"] >= b["y2"])
