"""Frame times of cameras and their alignment into synchronised frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.places import numbered
from sightline.sources.checkpoints import use_checkpoints

DEFAULT_FPS = 30.0


def dense_frame_index(times: DataFrame) -> DataFrame:
    """(cam_id, frame_index, frame_time): place in order of time, from 0.

    All frames are numbered together, by camera and time, and each camera's first number is taken off.
    """
    rows = numbered(times.select("cam_id", "frame_time"), "cam_id", "frame_time", name="_place")
    first = rows.groupBy("cam_id").agg(F.min("_place").alias("_first"))
    same = F.col("a.cam_id").eqNullSafe(F.col("b.cam_id"))
    return rows.alias("a").join(first.alias("b"), same).select("a.cam_id", (F.col("_place") - F.col("_first")).alias("frame_index"), "frame_time")


def ranked_frame_index(times: DataFrame, cam_id: int) -> DataFrame:
    """One camera's frames by rank: equal times share an index and are one frame."""
    w = Window.partitionBy("cam_id").orderBy("frame_time")
    own = times.filter(F.col("cam_id") == cam_id).select("cam_id", (F.rank().over(w) - 1).cast("long").alias("frame_index"), "frame_time")
    return own.distinct()


def inferred_times(meta: DataFrame) -> DataFrame:
    """(cam_id, frame_index, frame_time) from frame_count and fps: all cameras share the mean duration."""
    bad = meta.filter("frame_count is null or fps is null or frame_count <= 0 or fps <= 0").limit(1).count()
    if bad or meta.isEmpty():
        raise ValueError("every camera needs a positive frame count and rate")
    mean = meta.agg(F.avg(F.col("frame_count") / F.col("fps")).alias("span"))
    rows = meta.crossJoin(F.broadcast(mean)).withColumn("frame_index", F.explode(F.expr("sequence(0L, frame_count - 1)")))
    return rows.select("cam_id", "frame_index", (F.col("frame_index") * F.col("span") / F.col("frame_count")).alias("frame_time"))


def timing_warnings(meta: DataFrame) -> DataFrame:
    """(fps_spread, counts_differ): the relative spread of rates, and whether frame counts differ."""
    return meta.agg(((F.max("fps") - F.min("fps")) / F.avg("fps")).alias("fps_spread"), (F.min("frame_count") != F.max("frame_count")).alias("counts_differ"))


#: Frames of one recording that one task aligns, and each camera's frames behind them that it may look at.
SEGMENT, AHEAD = 50_000, 64


class _Pass:
    """The pass over the clocks of a segment: its frames and some behind it by camera, ``until`` the next one begins."""

    def __init__(self, pdf, cams: list[int]) -> None:
        pdf = pdf.sort_values(["cam_id", "frame_time", "frame_index"])
        by = {c: own for c, own in pdf[pdf["frame_time"].notna()].groupby("cam_id")}
        self.cams = cams
        self.times = [by[c]["frame_time"].tolist() if c in by else [] for c in cams]
        self.index = [by[c]["frame_index"].tolist() if c in by else [] for c in cams]
        self.until = pdf["until"].iloc[0]
        # Whether a camera has frames behind those that are here.
        self.more = [bool(by[c]["more"].any()) if c in by else False for c in cams]

    def run(self, start: list[int], out: list | None = None) -> tuple[list[int] | None, int]:
        """(how many frames behind the segment each camera has used, None if one would have to look
        farther than there are frames here; number of groups), from ``start`` frames that were used before it."""
        cams, at, sync, until = range(len(self.cams)), list(start), 0, self.until
        inf = float("inf")
        while True:
            live = [c for c in cams if at[c] < len(self.times[c])]
            if any(self.more[c] and at[c] + 2 > len(self.times[c]) for c in cams):
                return None, 0
            now = {c: self.times[c][at[c]] for c in live}
            if not live or (until == until and min(now.values()) >= until):
                break
            following = {c: self.times[c][at[c] + 1] for c in live if at[c] + 1 < len(self.times[c])}
            joins = []
            for c in live:
                earliest = min((t for o, t in following.items() if o != c), default=inf)
                latest = max((t for o, t in now.items() if o != c), default=-inf)
                if not (now[c] > earliest or earliest - now[c] < now[c] - latest):
                    joins.append(c)
            if joins:
                if out is not None:
                    out.extend((sync, self.cams[c], self.index[c][at[c]] if c in joins else None) for c in cams)
                for c in joins:
                    at[c] += 1
                sync += 1
            else:
                at[min(live, key=now.get)] += 1
        before = [sum(t < until for t in ts) if until == until else len(ts) for ts in self.times]
        return [max(0, a - n) for a, n in zip(at, before)], sync


def _segments(rows: DataFrame, key: str, size: int, ahead: int) -> DataFrame:
    """(recording, segment, cam_id, frame_index, frame_time, until, more): the frames of each segment of time, and
    behind them the next ``ahead`` of each camera, from wherever they are. Each segment names all cameras of its recording."""
    placed = numbered(rows, key, "frame_time", "cam_id", "frame_index", name="_place")
    first = placed.groupBy(key).agg(F.min("_place").alias("_first"))
    same = placed[key].eqNullSafe(first[key])
    placed = placed.join(F.broadcast(first), same).select(placed["*"], F.floor((F.col("_place") - F.col("_first")) / size).alias("segment"))
    # A segment begins at its first time; equal times before it go to it, too.
    begins = placed.groupBy(key, "segment").agg(F.min("frame_time").alias("begin")).withColumn("until", F.lead("begin").over(Window.partitionBy(key).orderBy("segment")))
    begins = begins.select(key, "segment", "until").checkpoint()
    shifted = placed.join(F.broadcast(begins), [key, "segment"]).withColumn("segment", F.col("segment") + F.when(F.col("frame_time") >= F.col("until"), 1).otherwise(0)).drop("until")
    own = shifted.select(key, "segment", "cam_id", "frame_index", "frame_time")
    counts = own.groupBy(key, "segment", "cam_id").agg(F.count("*").alias("n"))
    cams = own.select(key, "cam_id").distinct()
    each = begins.join(cams, key).join(counts, [key, "segment", "cam_id"], "left")
    total = F.sum(F.coalesce("n", F.lit(0)))
    by_cam = Window.partitionBy(key, "cam_id").orderBy("segment")
    each = each.withColumns({"_behind": total.over(by_cam), "_all": total.over(Window.partitionBy(key, "cam_id"))})
    ranked = numbered(own.select(key, "cam_id", "frame_time", "frame_index"), key, "cam_id", "frame_time", "frame_index", name="_rank")
    start = ranked.groupBy(key, "cam_id").agg(F.min("_rank").alias("_start"))
    ranked = ranked.join(F.broadcast(start), [key, "cam_id"]).withColumn("_rank", F.col("_rank") - F.col("_start"))
    look = each.filter("_behind < _all").select(
        key, "segment", "cam_id", (F.col("_behind") + ahead < F.col("_all")).alias("more"), F.explode(F.sequence(F.col("_behind"), F.least(F.col("_behind") + ahead, F.col("_all")) - 1)).alias("_rank"))
    behind = look.join(ranked, [key, "cam_id", "_rank"]).select(key, "segment", "cam_id", "frame_index", "frame_time", "more")
    marks = each.select(key, "segment", "cam_id", F.lit(None).cast("long").alias("frame_index"), F.lit(None).cast("double").alias("frame_time"), F.lit(False).alias("more"))
    every = own.withColumn("more", F.lit(False)).unionByName(behind).unionByName(marks)
    return every.join(F.broadcast(begins), [key, "segment"])


def align(frames: DataFrame, recording: str | None = None, segment: int = SEGMENT, ahead: int = AHEAD) -> DataFrame:
    """(recording, sync_index, cam_id, frame_index): frames of all cameras that belong together.

    A pass over all clocks of a recording at once. A camera's next frame joins the group
    unless it is later than the earliest following frame of the others, or closer to that
    than to the latest of their current ones; a group without any frame discards the
    earliest one.

    The pass is sequential, but all that it remembers at a time is how many later frames each camera has used
    already, mostly none. So recordings are cut into segments of about ``segment`` frames,
    which are passed at once as if nothing had been used before them; where a segment ends otherwise, all are also
    passed from that state, until the ends of all of them are known one after another. The driver holds a few numbers
    a segment. No task has more than a segment and ``ahead`` frames of each camera; where that is too few, it is
    doubled. Null frame times are left out; a null recording reads as an empty name.
    """
    key = recording or "_recording"
    rows = (frames if recording else frames.withColumn("_recording", F.lit(0).cast("long"))).select(key, F.col("cam_id").cast("long").alias("cam_id"), F.col("frame_index").cast("long").alias("frame_index"), F.col("frame_time").cast("double").alias("frame_time"))
    kind = dict(rows.dtypes)[key]
    use_checkpoints(rows.sparkSession)
    rows = rows.filter(F.col("frame_time").isNotNull()).withColumn(key, F.coalesce(F.col(key).cast("string"), F.lit(""))).checkpoint()
    while True:
        cut = _segments(rows, key, segment, ahead).checkpoint()
        starts = _starts(cut, key)
        if starts is not None:
            break
        ahead *= 2
    names = rows.sparkSession.sparkContext.broadcast(starts)

    def one(pdf):
        import pandas as pd

        name, number = pdf[key].iloc[0], int(pdf["segment"].iloc[0])
        own, out = _Pass(pdf, sorted(pdf["cam_id"].unique().tolist())), []
        start, base = names.value[name, number]
        own.run(start, out)
        made = pd.DataFrame(out, columns=["sync_index", "cam_id", "frame_index"])
        made["sync_index"] += base
        made["frame_index"] = made["frame_index"].astype("Int64")
        made.insert(0, key, name)
        return made

    found = cut.groupBy(key, "segment").applyInPandas(one, f"{key} string, sync_index long, cam_id long, frame_index long")
    return found.withColumn(key, F.col(key).cast(kind)) if recording else found.drop("_recording")


def _starts(cut: DataFrame, key: str) -> dict | None:
    """By recording and segment: the frames that each camera has used before it, and the groups before it."""
    known: dict[tuple, tuple[tuple[int, ...], int]] = {}
    tried: set[tuple[int, ...]] = set()
    width = cut.groupBy(key).agg(F.count_distinct("cam_id").alias("n")).select("n").distinct().collect()
    states = {(0,) * r["n"] for r in width}
    while True:
        some = [list(s) for s in states - tried]
        tried |= states

        def ends(pdf):
            import pandas as pd

            cams = sorted(pdf["cam_id"].unique().tolist())
            own = _Pass(pdf, cams)
            out = []
            for s in some:  # noqa: B023
                if len(s) == len(cams):
                    end, groups = own.run(s)
                    out.append((pdf[key].iloc[0], int(pdf["segment"].iloc[0]), s, end, groups))
            return pd.DataFrame(out, columns=["name", "segment", "start", "finish", "groups"])

        found = cut.groupBy(key, "segment").applyInPandas(ends, "name string, segment long, start array<long>, finish array<long>, groups long").collect()
        for r in found:
            known[r["name"], r["segment"], tuple(r["start"])] = (tuple(r["finish"]) if r["finish"] is not None else None, r["groups"])
        numbers: dict[str, list[int]] = {}
        for name, number, _ in known:
            numbers.setdefault(name, []).append(number)
        out, states = {}, set()
        for name, own in numbers.items():
            state, base = None, 0
            for number in sorted({*own}):
                state = state if state is not None else next((0,) * len(s) for n, k, s in known if n == name and k == number)
                out[name, number] = (list(state), base)
                if (name, number, state) not in known:
                    states.add(state)
                    break
                finish, groups = known[name, number, state]
                if finish is None:
                    return None
                state, base = finish, base + groups
        if not states:
            return out


def mean_fps(frames: DataFrame) -> DataFrame:
    """(fps): mean over cameras of frames per second, cameras without a span left out; 30 if none is left."""
    each = frames.groupBy("cam_id").agg(F.count("*").alias("n"), (F.max("frame_time") - F.min("frame_time")).alias("span"))
    return each.filter("n >= 2 and span > 0").agg(F.coalesce(F.avg((F.col("n") - 1) / F.col("span")), F.lit(DEFAULT_FPS)).alias("fps"))


def frame_bounds(frames: DataFrame) -> DataFrame:
    return frames.groupBy("cam_id").agg(F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"))
