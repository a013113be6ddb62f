"""Operators along a trajectory: gap filling, smoothing, dense grids, wide tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.places import numbered
from sightline.schema import POINT, STATIC_SYNC_INDEX
from sightline.sources.checkpoints import use_checkpoints

IMAGE_TRACK, WORLD_TRACK = ("cam_id", *POINT), POINT
IMAGE_VALUES, WORLD_VALUES = ("img_loc_x", "img_loc_y", "frame_time"), ("x_coord", "y_coord", "z_coord", "frame_time")


#: Frames, or rows of a track, that are taken together; what passes between blocks is one row or one state each.
BLOCK = 4096


def with_next(rows: DataFrame, track: Sequence[str], values: Sequence[str], block: int = BLOCK) -> DataFrame:
    """``rows`` with ``_next``, the struct of sync_index and ``values`` of the next frame of the track.

    Frames are ordered within blocks of ``block`` of them, so that a long track is many groups; the first row
    of each block is handed to the last one before it.
    """
    row = F.struct("sync_index", *values)
    dealt = rows.withColumn("_block", F.floor(F.col("sync_index") / block))
    inside = Window.partitionBy(*track, "_block").orderBy("sync_index")
    firsts = dealt.groupBy(*track, "_block").agg(F.min_by(row, "sync_index").alias("_first"))
    after = firsts.withColumn("_after", F.lead("_first").over(Window.partitionBy(*track).orderBy("_block"))).drop("_first").filter("_after is not null")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*track, "_block")]
    led = dealt.withColumn("_lead", F.lead(row).over(inside))
    joined = led.alias("a").join(after.alias("b"), [*same, F.col("a._lead").isNull()], "left")
    return joined.select("a.*", F.coalesce("a._lead", "b._after").alias("_next")).drop("_lead", "_block")


def fill_gaps(rows: DataFrame, track: Sequence[str], values: Sequence[str], max_gap: int = 3, strict: bool = False, block: int = BLOCK) -> DataFrame:
    """Linear interpolation of missing frames, ``max_gap`` of them after each observed row.

    Of a gap of g frames the first k = min(g, max_gap) are filled in steps of one k+1-th of
    the way to the next observed row, so that a long gap is filled in part and its steps
    are compressed; ``strict`` leaves long gaps empty. Columns that aren't in ``values``
    are null on filled rows. No dense grid is built: only filled rows are exploded.
    """
    if max_gap < 1:
        raise ValueError("max_gap must be at least 1")
    ahead = with_next(rows, track, values, block)
    ahead = ahead.withColumn("_gap", F.col("_next.sync_index") - F.col("sync_index") - 1)
    open_gaps = ahead.filter((F.col("_gap") > 0) & (F.col("_gap") <= max_gap if strict else F.lit(True)))
    filled = open_gaps.withColumn("_k", F.least(F.col("_gap"), F.lit(max_gap))).withColumn("_j", F.explode(F.expr("sequence(1L, _k)")))
    part = F.col("_j") / (F.col("_k") + 1)
    new = filled.select(*(
        (F.col("sync_index") + F.col("_j")).alias(c) if c == "sync_index"
        else (F.col(c) + (F.col(f"_next.{c}") - F.col(c)) * part).alias(c) if c in values
        else F.col(c) if c in track
        else F.lit(None).cast(dict(rows.dtypes)[c]).alias(c)
        for c in rows.columns
    ))
    return rows.unionByName(new)


def fill_image_gaps(points: DataFrame, max_gap: int = 3, strict: bool = False) -> DataFrame:
    return fill_gaps(points, IMAGE_TRACK, IMAGE_VALUES, max_gap, strict)


def fill_world_gaps(points: DataFrame, max_gap: int = 3, strict: bool = False) -> DataFrame:
    """Static points have no gaps: they stand at one index."""
    moving = fill_gaps(points.filter(F.col("sync_index") != STATIC_SYNC_INDEX), WORLD_TRACK, WORLD_VALUES, max_gap, strict)
    return moving.unionByName(points.filter(F.col("sync_index") == STATIC_SYNC_INDEX))


def butterworth(order: int, cutoff: float, rate: float) -> tuple[list[float], list[float]]:
    """Numerator and denominator of a digital low-pass by the bilinear transform."""
    import numpy as np

    warped = 2 * rate * np.tan(np.pi * cutoff / rate)
    poles = warped * np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    z = (2 * rate + poles) / (2 * rate - poles)
    a = np.real(np.poly(z))
    b = np.real(np.poly(-np.ones(order)))
    return list(b * a.sum() / b.sum()), list(a)


class _Filter:
    """A recursive filter over columns of numbers. Its memory is a few numbers a column, on which a row of
    inputs acts by an affine map: rows are taken ``length`` at once, by one matrix each."""

    def __init__(self, b: list[float], a: list[float], length: int = 64) -> None:
        import numpy as np

        self.b, self.a, self.order, self.length = b, a, len(a) - 1, length
        # What each input and each part of the memory gives, from runs over unit vectors.
        inputs, memory = np.eye(length), np.eye(self.order)
        from_inputs, left = self._plain(inputs, np.zeros((self.order, length)))
        from_memory, kept = self._plain(np.zeros((length, self.order)), memory)
        self.out, self.after = np.hstack((from_inputs, from_memory)), np.hstack((left, kept))
        steady = np.zeros(self.order)
        for k in range(self.order - 1, -1, -1):
            steady[k] = (steady[k + 1] if k + 1 < self.order else 0.0) + b[k + 1] - a[k + 1]
        #: The memory after a constant 1 for ever.
        self.steady = steady

    def _plain(self, x, memory):
        import numpy as np

        y, s = np.empty_like(x), memory.copy()
        for i, v in enumerate(x):
            y[i] = self.b[0] * v + s[0]
            for k in range(self.order):
                s[k] = (s[k + 1] if k + 1 < self.order else 0.0) + self.b[k + 1] * v - self.a[k + 1] * y[i]
        return y, s

    def run(self, x, memory):
        """(outputs, memory after them) of rows ``x``."""
        import numpy as np

        whole = len(x) // self.length * self.length
        out, s = [], memory
        for i in range(0, whole, self.length):
            both = np.vstack((x[i : i + self.length], s))
            out.append(self.out @ both)
            s = self.after @ both
        last, s = self._plain(x[whole:], s)
        return np.vstack((*out, last)), s

    def decayed(self, rows: int):
        """What is left of the memory after so many rows of zeros, as a matrix."""
        import numpy as np

        step = np.zeros((self.order, self.order))
        step[:, 0] = -np.asarray(self.a[1:])
        step[range(self.order - 1), range(1, self.order)] = 1.0
        return np.linalg.matrix_power(step, rows)


_XYZ = ["x_coord", "y_coord", "z_coord"]


def _filtered(rows: DataFrame, f: _Filter, forward: bool, pad: int) -> DataFrame:
    """``rows`` (track, _block, _rank, coordinates) filtered in one direction. Blocks are run apart twice: from an empty
    memory for what they leave, and from what all before them left, which one group of a row a block finds."""
    by = [*WORLD_TRACK, "_block"]
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    memory = "object_id long, keypoint_id long, _block long, n long, left array<double>, start array<double>"

    def ordered(pdf, info):
        """The block's numbers in the direction of the pass, what goes before them, and their memory there if the pass begins here."""
        import numpy as np

        pdf = pdf.sort_values("_rank", ascending=forward, kind="stable")
        x = pdf[_XYZ].to_numpy(float)
        begins = pdf["_block"].iloc[0] == (0 if forward else info)
        start = None
        if begins and forward:
            x = np.vstack((2 * x[0] - x[pad:0:-1], x))
        if begins:
            start = f.steady[:, None] * x[0]
        if forward and pdf["_block"].iloc[0] == info:
            x = np.vstack((x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
        return pdf, x, start

    def summary(pdf):
        import numpy as np
        import pandas as pd

        pdf, x, start = ordered(pdf, pdf["_last"].iloc[0])
        _, left = f.run(x, np.zeros((f.order, 3)))
        first = pdf.iloc[0]
        return pd.DataFrame([[first["object_id"], first["keypoint_id"], first["_block"], len(x), left.ravel(), None if start is None else start.ravel()]], columns=["object_id", "keypoint_id", "_block", "n", "left", "start"])

    def chain(pdf):
        import numpy as np

        pdf = pdf.sort_values("_block", ascending=forward).reset_index(drop=True)
        state, starts = None, []
        for n, left, start in zip(pdf["n"], pdf["left"], pdf["start"]):
            state = np.asarray(start).reshape(f.order, 3) if state is None else state
            starts.append(state.ravel())
            state = f.decayed(int(n)) @ state + np.asarray(left).reshape(f.order, 3)
        pdf["start"] = starts
        return pdf

    def run(pdf, own):
        import numpy as np
        import pandas as pd

        pdf, x, _ = ordered(pdf, pdf["_last"].iloc[0])
        y, _ = f.run(x, np.asarray(own["start"].iloc[0]).reshape(f.order, 3))
        before = pad if forward and pdf["_block"].iloc[0] == 0 else 0
        out = pdf.copy()
        out[_XYZ] = y[before : before + len(pdf)]
        extra = y[before + len(pdf) :]
        if len(extra):  # the way back begins behind the last row
            tail = pd.concat([pdf.iloc[[-1]]] * len(extra), ignore_index=True)
            tail[_XYZ] = extra
            tail["_rank"] = pdf["_rank"].iloc[-1] + 1 + np.arange(len(extra))
            tail["_tail"] = True
            out = pd.concat([out, tail], ignore_index=True)
        return out

    left = rows.groupBy(*by).applyInPandas(summary, memory)
    starts = left.groupBy(*WORLD_TRACK).applyInPandas(chain, memory)
    return rows.groupBy(*by).cogroup(starts.groupBy(*by)).applyInPandas(run, kinds)


def smooth(points: DataFrame, cutoff: float, rate: float, order: int = 2, block: int = BLOCK) -> DataFrame:
    """Each 3-D trajectory, low-passed forward and backward; rows in order of time, gaps ignored.

    Trajectories of up to 3 (order + 1) rows pass unchanged, as the filter pads that many. A longer one is cut
    into blocks of ``block`` rows or more, between which the filter's memory is handed on.
    """
    f, pad = _Filter(*butterworth(order, cutoff, rate)), 3 * (order + 1)
    if block <= pad:
        raise ValueError(f"blocks have more than {pad} rows")
    use_checkpoints(points.sparkSession)
    placed = numbered(points, *WORLD_TRACK, "sync_index", name="_place")
    tracks = placed.groupBy(*WORLD_TRACK).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in WORLD_TRACK]
    ranked = placed.alias("a").join(tracks.alias("b"), same).select(*(f"a.{c}" for c in points.columns), (F.col("_place") - F.col("_first")).alias("_rank"), "_n")
    short = ranked.filter(F.col("_n") <= pad).select(*points.columns)
    # The last block has the rest, too, so that none is shorter than the padding.
    last = F.greatest(F.lit(0), F.floor(F.col("_n") / block) - 1)
    long = ranked.filter(F.col("_n") > pad).withColumn("_last", last).withColumn("_block", F.least(F.floor(F.col("_rank") / block), "_last")).withColumn("_tail", F.lit(False)).drop("_n").checkpoint()
    there = _filtered(long, f, True, pad).checkpoint()
    back = _filtered(there, f, False, pad).filter("not _tail")
    return short.unionByName(back.select(*points.columns))


def wide(points: DataFrame, names: dict[tuple[int, int] | int, str]) -> DataFrame:
    """One row for each frame with the mean x, y, z of each named point, columns sorted by name.

    ``names``: keypoint id to name, for all objects.
    """
    spark = points.sparkSession
    named = F.broadcast(spark.createDataFrame([(int(k), n) for k, n in names.items()], "keypoint_id long, name string"))
    ordered = sorted(set(names.values()))
    out = points.join(named, "keypoint_id").groupBy("sync_index").pivot("name", ordered).agg(F.avg("x_coord").alias("x"), F.avg("y_coord").alias("y"), F.avg("z_coord").alias("z"))
    return out


def dense_trajectories(points: DataFrame, block: int = BLOCK, seen_only: bool = False) -> DataFrame:
    """The most observed object on a dense grid of its frames, holes filled from before, then from after.

    Frames are filled within blocks of ``block`` of them; what is known on either side of a block is one row each.
    With ``seen_only`` the grid has only frames in which the object was seen, filled with the same places: it then
    grows with the rows, whatever numbers frames have.
    """
    xyz = ("x_coord", "y_coord", "z_coord")
    moving = points.filter(F.col("sync_index") != STATIC_SYNC_INDEX)
    best = moving.groupBy("object_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "object_id").limit(1).select("object_id")
    own = moving.join(F.broadcast(best), "object_id")
    at = F.floor(F.col("sync_index") / block)
    keypoints = own.select("object_id", "keypoint_id").distinct()
    if seen_only:
        frames = own.select("object_id", "sync_index", at.alias("_block")).distinct()
        grid = frames.select("object_id", "_block").distinct().join(F.broadcast(keypoints), "object_id")
        every = frames.join(F.broadcast(keypoints), "object_id").select(*POINT, "_block", "sync_index")
    else:
        span = own.groupBy("object_id").agg(F.min("sync_index").alias("a"), F.max("sync_index").alias("z"))
        blocks = span.withColumn("_block", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor(F.col("z") / block))))
        grid = keypoints.join(F.broadcast(blocks), "object_id")
        frames = F.sequence(F.greatest("a", F.col("_block") * block), F.least("z", F.col("_block") * block + block - 1))
        every = grid.repartition(*POINT, "_block").select(*POINT, "_block", F.explode(frames).alias("sync_index"))
    full = every.join(own.select("sync_index", *POINT, *xyz), ["sync_index", *POINT], "left")
    # Each coordinate by itself, since one alone may be missing.
    known = lambda c: F.when(F.col(c).isNotNull(), F.col("sync_index"))
    ends = own.withColumn("_block", at).groupBy(*POINT, "_block").agg(
        *(F.max_by(c, known(c)).alias(f"_last_{c}") for c in xyz), *(F.min_by(c, known(c)).alias(f"_first_{c}") for c in xyz))
    track = Window.partitionBy(*POINT)
    before, after = (track.orderBy(o("_block")).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc, F.desc))
    handed = grid.select(*POINT, "_block").join(ends, [*POINT, "_block"], "left").select(
        *POINT, "_block", *(F.last(f"_last_{c}", True).over(before).alias(f"_before_{c}") for c in xyz), *(F.last(f"_first_{c}", True).over(after).alias(f"_after_{c}") for c in xyz))
    rows = full.join(handed, [*POINT, "_block"])
    # Backwards in descending order: a frame up to the end of the partition would be read again for each row.
    inside = Window.partitionBy(*POINT, "_block")
    back, on = (inside.orderBy(o("sync_index")).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc, F.desc))
    return rows.select("sync_index", *POINT, *(F.coalesce(F.last(c, True).over(back), f"_before_{c}", F.last(c, True).over(on), f"_after_{c}").alias(c) for c in xyz))


def rebased_times(points: DataFrame) -> DataFrame:
    """(sync_index, time): mean time of each frame from the first one on, to milliseconds, half to even."""
    frames = points.groupBy("sync_index").agg(F.avg("frame_time").alias("t"))
    first = frames.agg(F.min("t").alias("t0"))
    return frames.crossJoin(F.broadcast(first)).select("sync_index", F.bround(F.col("t") - F.col("t0"), 3).alias("time"))


def frame_rate(points: DataFrame) -> DataFrame:
    """(frame_rate): whole number of the mean of one over the time between frames (0 where none passes).

    Frames are ordered in one window: there is one row for each frame, not each point.
    """
    times = points.groupBy("sync_index").agg(F.avg("frame_time").alias("t"))
    dt = times.select((F.col("t") - F.lag("t").over(Window.orderBy("t"))).alias("dt")).filter("dt is not null")
    return dt.agg(F.floor(F.avg(F.when(F.col("dt") == 0, 0.0).otherwise(1.0 / F.col("dt")))).alias("frame_rate"))
