"""Calibration targets as relations: rules that a set of markers must meet, edges of boards, pools of dictionaries, places of corners.

Markers: object_id, side, static. Links: object_id_a, corner_a, object_id_b, corner_b (both
corners null: between centres), distance, sigma. Mirror pairs: object_id_a, corner_a,
object_id_b, corner_b, thickness, sigma. Boards: board_id, columns, rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators.constraints import CORNERS

#: Families of marker dictionaries, and how many markers their pools hold.
FAMILIES = ("DICT_4X4", "DICT_5X5", "DICT_6X6", "DICT_7X7")
POOLS = (50, 100, 250, 1000)


def _found(rows: DataFrame, problem: str, a: Column | str, b: Column | str | None = None) -> DataFrame:
    other = F.lit(None).cast("long") if b is None else F.col(b) if isinstance(b, str) else b
    return rows.select(F.lit(problem).alias("problem"), (F.col(a) if isinstance(a, str) else a).alias("object_id"), other.alias("other"))


def problems(markers: DataFrame, links: DataFrame, pairs: DataFrame, capacity: int) -> DataFrame:
    """(problem, object_id, other), each once: what is wrong with a set of markers; no rows if nothing is.

    Of problems between two markers both ids are given, the smaller first. Null ids are unknown
    markers; a null side, distance or thickness is a bad one, ``static`` null is false; a marker that stands twice is a
    repeated one and each of its rows is judged. Empty tables have no problems.
    """
    own = markers.select("object_id", "side", F.coalesce("static", F.lit(False)).alias("static"))
    out = [
        _found(own.filter("side is null or isnan(side) or side <= 0"), "bad side", "object_id"),
        _found(own.filter(F.col("object_id").isNull() | ~F.col("object_id").between(0, capacity - 1)), "beyond the dictionary", "object_id"),
        _found(own.groupBy("object_id").agg(F.count("*").alias("n")).filter("n > 1"), "repeated marker", "object_id"),
    ]
    a, b = F.col("object_id_a"), F.col("object_id_b")
    low, high = F.least(a, b), F.greatest(a, b)
    corner = lambda c: F.col(c).isNotNull() & ~F.col(c).between(0, 3)
    facts = own.groupBy("object_id").agg(F.min("static").alias("static"), F.max("side").alias("side"))

    def ends(rows: DataFrame) -> DataFrame:
        for x in "ab":
            rows = rows.join(facts.select(F.col("object_id").alias(f"object_id_{x}"), F.col("static").alias(f"static_{x}"), F.col("side").alias(f"side_{x}")), f"object_id_{x}", "left")
        return rows

    for rows, name in ((links, "link"), (pairs, "pair")):
        each = rows.select(F.explode(F.array(a, b)).alias("object_id"))
        out += [
            _found(each.join(facts, "object_id", "left_anti"), f"unknown marker in a {name}", "object_id"),
            _found(rows.filter(a == b), f"{name} of one marker", "object_id_a"),
            _found(rows.filter(corner("corner_a") | corner("corner_b")), f"bad corner of a {name}", low, high),
            _found(ends(rows).filter("static_a <> static_b"), f"static and mobile {name}", low, high),
            _found(rows.filter("sigma <= 0"), f"bad sigma of a {name}", low, high),
        ]
    end = lambda x: F.struct(F.col(f"object_id_{x}").alias("o"), F.col(f"corner_{x}").alias("c"))
    twice = links.groupBy(F.least(end("a"), end("b")).alias("p"), F.greatest(end("a"), end("b")).alias("q")).agg(F.count("*").alias("n")).filter("n > 1")
    faces = pairs.select(F.explode(F.array_distinct(F.array(a, b))).alias("object_id")).groupBy("object_id").agg(F.count("*").alias("n")).filter("n > 1")
    paired = pairs.select(low.alias("low"), high.alias("high")).distinct()
    gone = pairs.filter("thickness = 0").select(b.alias("object_id")).distinct()
    out += [
        _found(links.filter("(corner_a is null) <> (corner_b is null)"), "link with one corner", low, high),
        _found(links.filter("distance is null or isnan(distance) or distance <= 0"), "bad distance", low, high),
        _found(twice, "repeated link", F.least("p.o", "q.o"), F.greatest("p.o", "q.o")),
        _found(pairs.filter("corner_a is null or corner_b is null"), "pair without a corner", low, high),
        _found(pairs.filter("thickness is null or isnan(thickness) or thickness < 0"), "bad thickness", low, high),
        _found(ends(pairs).filter("side_a <> side_b"), "unequal sides of a pair", low, high),
        _found(faces, "several mirror pairs", "object_id"),
        _found(links.select(low.alias("low"), high.alias("high")).join(paired, ["low", "high"], "left_semi"), "link and pair", "low", "high"),
        _found(links.select(F.explode(F.array(a, b)).alias("object_id")).join(gone, "object_id", "left_semi"), "link to a remapped face", "object_id"),
    ]
    all_rows = out[0]
    for x in out[1:]:
        all_rows = all_rows.unionByName(x)
    return all_rows.distinct()


def pools(spark: SparkSession) -> DataFrame:
    """(family, capacity) of the standard dictionaries."""
    return spark.createDataFrame([(f, p) for f in FAMILIES for p in POOLS], "family string, capacity long")


def fitting_pools(boards: DataFrame, pools: DataFrame) -> DataFrame:
    """(board_id, n_markers, dictionary) of boards with a ``family``: the smallest pool that holds a marker on
    every second square; null where none is large enough or the family isn't known. Pools are counted, a few rows a family."""
    need = boards.select("board_id", "family", F.expr("columns * rows div 2").alias("n_markers"))
    ladder = pools.groupBy("family").agg(F.array_sort(F.collect_set("capacity")).alias("ladder"))
    first = F.get(F.filter("ladder", lambda c: c >= F.col("n_markers")), F.lit(0))
    return need.join(ladder, "family", "left").select("board_id", "n_markers", F.concat_ws("_", "family", first.cast("string")).alias("d"), first.alias("c")).select("board_id", "n_markers", F.when(F.col("c").isNotNull(), F.col("d")).alias("dictionary"))


def chessboard_edges(boards: DataFrame) -> DataFrame:
    """(board_id, keypoint_id_a, keypoint_id_b): each corner with those to the right of it and below; ids go row by row."""
    size = boards.filter("columns > 0 and rows > 0").select("board_id", F.col("columns").cast("long").alias("columns"), F.col("rows").cast("long").alias("rows"))
    corner = size.withColumn("keypoint_id_a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns") * F.col("rows") - 1)))
    right = F.when(F.col("keypoint_id_a") % F.col("columns") < F.col("columns") - 1, F.col("keypoint_id_a") + 1)
    below = F.when(F.col("keypoint_id_a") < F.col("columns") * (F.col("rows") - 1), F.col("keypoint_id_a") + F.col("columns"))
    return corner.withColumn("keypoint_id_b", F.explode(F.array_compact(F.array(right, below)))).select("board_id", "keypoint_id_a", "keypoint_id_b")


def line_edges(corners: DataFrame) -> DataFrame:
    """(board_id, keypoint_id_a, keypoint_id_b): all corners of a board that have their x or their y in common.

    ``corners``: board_id, keypoint_id, obj_loc_x, obj_loc_y; coordinates must be equal as doubles, those that are null or NaN
    have nothing in common. A line is one row, as long as the board is wide.
    """
    of = F.explode(F.array(*(F.struct(F.lit(c).alias("axis"), F.col(f"obj_loc_{c}").cast("double").alias("at")) for c in "xy"))).alias("line")
    lines = corners.select("board_id", "keypoint_id", of).filter("line.at is not null and not isnan(line.at)").groupBy("board_id", "line").agg(F.array_sort(F.collect_set("keypoint_id")).alias("ids"))
    first = lines.select("board_id", "ids", F.posexplode("ids").alias("i", "keypoint_id_a"))
    rest = F.explode(F.slice("ids", F.col("i") + 2, F.size("ids")))
    return first.select("board_id", "keypoint_id_a", rest.alias("keypoint_id_b")).distinct()


def placed(points: DataFrame, markers: DataFrame, back_faces: DataFrame | None = None) -> DataFrame:
    """``points`` with obj_loc_x/y/z from the markers' corners (replaced if there), null for unknown markers and corners.
    ``back_faces``: object_id, thickness of faces that lie so far behind the one that is placed."""
    # One row a marker is joined, not one a corner.
    known = markers.dropDuplicates(["object_id"]).select("object_id", F.col("side").alias("_side"), F.lit(0.0).alias("_depth"))
    if back_faces is not None:
        depth = back_faces.groupBy("object_id").agg(F.max("thickness").alias("_back"))
        known = known.join(depth, "object_id", "left").select("object_id", "_side", F.coalesce("_back", "_depth").alias("_depth"))
    kept = [c for c in points.columns if c not in ("object_id", "keypoint_id", "obj_loc_x", "obj_loc_y", "obj_loc_z")]
    corner = F.when(F.col("keypoint_id").between(0, len(CORNERS) - 1), F.col("keypoint_id").cast("int"))
    on_side = (F.get(F.array(*(F.lit(c[k]) for c in CORNERS)), corner) * F.col("_side") for k in range(2))
    return points.join(known, "object_id", "left").select(
        "object_id", "keypoint_id", *kept, *(x.alias(f"obj_loc_{c}") for c, x in zip("xy", on_side)), F.when(corner.isNotNull(), F.col("_depth")).alias("obj_loc_z"))


def unknown_markers(points: DataFrame, markers: DataFrame) -> DataFrame:
    """(object_id, n_points) of detections that no marker explains."""
    return points.join(markers.select("object_id"), "object_id", "left_anti").groupBy("object_id").agg(F.count("*").alias("n_points"))
