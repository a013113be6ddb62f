"""Choosing the frames that a lens is calibrated from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.scalars import grid_cell, tilt_bin


def frame_tilts(boards: DataFrame) -> DataFrame:
    """(cam_id, sync_index, direction, magnitude): of each frame its most tilted object (poses.board_tilts)."""
    best = boards.groupBy("cam_id", "sync_index").agg(F.max(F.struct("magnitude", (-F.col("object_id")).alias("o"), "direction")).alias("b"))
    return best.select("cam_id", "sync_index", F.col("b.direction").alias("direction"), F.col("b.magnitude").alias("magnitude"))


def select_frames(points: DataFrame, cameras: DataFrame, tilts: DataFrame, target: int = 30, least: int = 6, cells: int = 5) -> DataFrame:
    """(cam_id, sync_index, place): for each camera the best frame of each tilt direction, then frames
    that add most new grid cells, the earliest of equals.

    Spark reduces each frame to its set of cells, its direction and tilt; the greedy choice is
    a loop over one camera's frames, a few bytes each, in one small group for each camera.
    """
    rows = points.join(F.broadcast(cameras.select("cam_id", "width", "height")), "cam_id")
    cell = grid_cell(F.col("img_loc_x"), F.col("width"), cells) * cells + grid_cell(F.col("img_loc_y"), F.col("height"), cells)
    frames = rows.groupBy("cam_id", "sync_index").agg(F.count("*").alias("n"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), cell)).alias("mask")).filter(F.col("n") >= least)
    frames = frames.join(tilts.select("cam_id", "sync_index", tilt_bin(F.col("direction"), F.col("magnitude")).alias("bin"), "magnitude"), ["cam_id", "sync_index"], "left")

    def choose(pdf):
        import pandas as pd

        pdf = pdf.sort_values("sync_index")
        binned = pdf[pdf["bin"].notna()].sort_values(["bin", "magnitude", "sync_index"], ascending=[True, False, True])
        chosen = binned.drop_duplicates("bin")["sync_index"].tolist()[:target]
        mask = dict(zip(pdf["sync_index"].tolist(), pdf["mask"].tolist()))
        seen = 0
        for s in chosen:
            seen |= mask[s]
        left = [s for s in mask if s not in set(chosen)]
        while left and len(chosen) < target:
            best = max(left, key=lambda s: ((mask[s] & ~seen).bit_count(), -s))
            chosen.append(best)
            left.remove(best)
            seen |= mask[best]
        return pd.DataFrame({"cam_id": pdf["cam_id"].iloc[0], "sync_index": chosen, "place": range(len(chosen))})

    return frames.groupBy("cam_id").applyInPandas(choose, "cam_id long, sync_index long, place long")
