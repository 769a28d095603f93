"""Rectangle predicates and arithmetic on struct columns (x0, y0, x1, y1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps(a: Column, b: Column) -> Column:
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def contains(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x0"]) & (a["y0"] <= b["y0"]) & (a["x1"] >= b["x1"]) & (a["y1"] >= b["y1"])


def should_merge(a: Column, b: Column, h: float = 8.0, v: float = 1.0, share: float = 0.75) -> Column:
    """Two boxes belong together: near on one line, stacked closely with shared width, or overlapping.

    Empty boxes never merge.
    """
    width, height = (lambda r: r["x1"] - r["x0"]), (lambda r: r["y1"] - r["y0"])
    centre = lambda r: r["y0"] + height(r) / 2
    solid = (width(a) > 0) & (height(a) > 0) & (width(b) > 0) & (height(b) > 0)
    gap = lambda lo, hi: F.greatest(a[lo], b[lo]) - F.least(a[hi], b[hi])
    h_gap, v_gap = gap("x0", "x1"), gap("y0", "y1")
    same_line = F.abs(centre(a) - centre(b)) < (height(a) + height(b)) / 2
    shared = F.greatest(F.lit(0.0), -h_gap)
    nested = ((a["x0"] >= b["x0"]) & (a["x1"] <= b["x1"])) | ((b["x0"] >= a["x0"]) & (b["x1"] <= a["x1"]))
    wide = (shared >= share * F.least(width(a), width(b))) | nested
    beside = same_line & (h_gap >= 0) & (h_gap < h)
    stacked = wide & (v_gap >= 0) & (v_gap < v)
    return solid & (beside | stacked | ((h_gap < 0) & (v_gap < 0)))


def union(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"))


def area(a: Column) -> Column:
    return (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])


def aspect(a: Column) -> Column:
    h = a["y1"] - a["y0"]
    return F.when(h == 0, 0.0).otherwise((a["x1"] - a["x0"]) / h)
