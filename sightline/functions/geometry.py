"""Camera geometry as column expressions; scalar arithmetic throughout, so that code is generated for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def camera_frame(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """R X + t with the camera's columns r0..r8, t0..t2."""
    row = lambda i: F.col(f"r{3 * i}") * x + F.col(f"r{3 * i + 1}") * y + F.col(f"r{3 * i + 2}") * z + F.col(f"t{i}")
    return row(0), row(1), row(2)


def with_pixels(rows: DataFrame, x: str = "x_coord", y: str = "y_coord", z: str = "z_coord") -> DataFrame:
    """``rows`` (world points beside a camera's columns) with _u, _v and _depth: the pixel of each
    point, null at depth zero, and its depth.

    Brown-Conrady with k1, k2, p1, p2, k3, or the equidistant model with four terms in k1,
    k2, p1, p2 where the camera's ``fisheye`` says so. Each step is a projection of its own
    and uses the one before as seldom as it can: where a filter on pixels is moved below
    them, all steps are written out in it.
    """
    c, square = F.col, lambda e: F.pow(e, F.lit(2.0))
    xc, yc, zc = camera_frame(c(x), c(y), c(z))
    rows = rows.withColumns({"_xc": xc, "_yc": yc, "_depth": zc})
    rows = rows.withColumns({"_a": F.try_divide("_xc", "_depth"), "_b": F.try_divide("_yc", "_depth")})
    rows = rows.withColumn("_r", F.sqrt(square(c("_a")) + square(c("_b"))))
    rows = rows.withColumns({"_q": square(c("_r")), "_t": F.atan("_r")})
    rows = rows.withColumn("_t2", square(c("_t")))
    bent = c("_t") * (1 + c("_t2") * (c("k1") + c("_t2") * (c("k2") + c("_t2") * (c("p1") + c("_t2") * c("p2")))))
    radial = 1 + c("_q") * (c("k1") + c("_q") * (c("k2") + c("_q") * c("k3")))
    fisheye = F.coalesce("fisheye", F.lit(False))
    rows = rows.withColumn("_s", F.when(fisheye, F.coalesce(F.try_divide(bent, c("_r")), F.lit(1.0))).otherwise(radial))
    dx = F.when(fisheye, 0.0).otherwise(2 * c("p1") * c("_a") * c("_b") + c("p2") * (c("_q") + 2 * square(c("_a"))))
    dy = F.when(fisheye, 0.0).otherwise(c("p1") * (c("_q") + 2 * square(c("_b"))) + 2 * c("p2") * c("_a") * c("_b"))
    rows = rows.withColumns({"_u": c("fx") * (c("_a") * c("_s") + dx) + c("cx"), "_v": c("fy") * (c("_b") * c("_s") + dy) + c("cy")})
    return rows.drop("_xc", "_yc", "_a", "_b", "_r", "_q", "_t", "_t2", "_s")


def camera_centre() -> tuple[Column, Column, Column]:
    """-R'T."""
    at = lambda i: -(F.col(f"r{i}") * F.col("t0") + F.col(f"r{3 + i}") * F.col("t1") + F.col(f"r{6 + i}") * F.col("t2"))
    return at(0), at(1), at(2)


def matmul(a: Column, b: Column, transpose_b: bool = False) -> Column:
    """Product of 3x3 matrices in arrays of nine, row by row."""
    at = lambda m, i: F.element_at(m, i + 1)
    cell = lambda i, j: sum((at(a, 3 * i + k) * at(b, 3 * j + k if transpose_b else 3 * k + j) for k in range(3)), F.lit(0.0))
    return F.array(*(cell(i, j) for i in range(3) for j in range(3)))


def matvec(m: Column, v: Column) -> Column:
    return F.array(*(sum((F.element_at(m, 3 * i + k + 1) * F.element_at(v, k + 1) for k in range(3)), F.lit(0.0)) for i in range(3)))


def rotation_angle(m: Column) -> Column:
    """Degrees of the turn in a rotation; the trace is held within [-1, 3]."""
    trace = F.element_at(m, 1) + F.element_at(m, 5) + F.element_at(m, 9)
    return F.degrees(F.acos((F.greatest(F.lit(-1.0), F.least(F.lit(3.0), trace)) - 1) / 2))
