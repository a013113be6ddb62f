"""Scalar rules: badges, bins, decoding of keypoint scores, image-plane turns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def link_quality(n: Column) -> Column:
    return F.when(n >= 200, "good").when(n >= 50, "marginal").otherwise("insufficient")


def badge(value: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The name of the first step that the value is below; ``last`` from the last on, null for null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for limit, name in steps:
        out = out.when(value < limit, F.lit(name))
    return out.otherwise(F.lit(last))


def grid_cell(x: Column, size: Column, cells: int) -> Column:
    """The cell of a coordinate: cut towards zero and held within the grid."""
    return F.greatest(F.lit(0), F.least(F.lit(cells - 1), (x / (size / cells)).cast("int")))


def tilt_bin(direction: Column, magnitude: Column) -> Column:
    """One of eight sectors of 45 degrees; null if the tilt is under 0.1."""
    turned = (F.degrees(direction) + 360.0) % 360.0
    return F.when(magnitude >= 0.1, (turned / 45.0).cast("int") % 8)


def argmax(values: Column) -> Column:
    """Place of the first largest value, from 0."""
    return F.array_position(values, F.array_max(values)) - 1


def decode_axes(x: Column, y: Column, ratio: float) -> tuple[Column, Column, Column]:
    """Pixel and confidence from a score vector for each axis."""
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least(F.array_max(x), F.array_max(y))))
    return argmax(x) / ratio, argmax(y) / ratio, sure


def refine(before: Column, peak: Column, after: Column) -> Column:
    """Offset of a parabola's top from the peak, within half a cell; 0 where it is flat or at the border."""
    bend = before - 2 * peak + after
    offset = 0.5 * (before - after) / bend
    return F.when(before.isNull() | after.isNull() | (F.abs(bend) < 1e-12), 0.0).otherwise(F.greatest(F.lit(-0.5), F.least(F.lit(0.5), offset)))


def decode_heatmap(heat: Column, width: int, height: int) -> tuple[Column, Column, Column]:
    """Pixel with sub-pixel offset and confidence from a flattened heat map."""
    top = argmax(heat)
    i, j = (top % width).cast("int"), F.floor(top / width).cast("int")
    at = lambda p, ok: F.when(ok, F.try_element_at(heat, (p + 1).cast("int")))
    peak = F.array_max(heat)
    dx = refine(at(top - 1, (i > 0) & (i < width - 1)), peak, at(top + 1, (i > 0) & (i < width - 1)))
    dy = refine(at(top - width, (j > 0) & (j < height - 1)), peak, at(top + width, (j > 0) & (j < height - 1)))
    return i + dx, j + dy, F.greatest(F.lit(0.0), F.least(F.lit(1.0), peak))


def unrotate(x: Column, y: Column, turns: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """A point of an image turned by quarter turns, back in the image as recorded."""
    k = F.pmod(turns, F.lit(4))
    return (
        F.when(k == 1, y).when(k == 2, width - x).when(k == 3, height - y).otherwise(x),
        F.when(k == 1, width - x).when(k == 2, height - y).when(k == 3, x).otherwise(y),
    )


def unletterbox(x: Column, y: Column, pad_x: Column, pad_y: Column, scale: Column, left: Column, top: Column) -> tuple[Column, Column]:
    return (x - pad_x) / scale + left, (y - pad_y) / scale + top


def tiles(length: Column, size: int) -> Column:
    """Starts of windows that overlap by half, the last one at the far edge."""
    last = F.greatest(F.lit(0), length - size)
    return F.array_sort(F.array_union(F.sequence(F.lit(0).cast("bigint"), last, F.lit(max(1, size // 2)).cast("bigint")), F.array(last)))
