"""Exact quantiles by counts of slices that narrow, without all values of a key in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.sources.checkpoints import use_checkpoints

#: Slices for each doubling of a value at first, and of a slice that is narrowed.
STEPS, PARTS = 32, 1024
#: Values that are put in order at most for one rank.
SORTED = 100_000


def _slice(x: F.Column) -> F.Column:
    """A number that rises with the value: negative, zero, positive, infinite, NaN."""
    size = F.floor(F.log2(F.abs(x)) * STEPS).cast("long") + F.lit(1 << 20)
    return (
        F.when(F.isnan(x), 1 << 40).when(x == float("inf"), 1 << 39).when(x == float("-inf"), -(1 << 39)).when(x > 0, size).when(x < 0, -size).otherwise(0)
    )


def quantiles(df: DataFrame, value: str, at: tuple[float, ...], keys: tuple[str, ...] = (), written: bool = False, most: int = SORTED) -> DataFrame:
    """(keys, percentile, value): interpolated as ``percentile`` does. Nulls don't count, NaN is above all other values.

    Values are counted by slices of about two percent of their size, combined before the
    shuffle. A slice that a wanted rank falls into and that holds more than ``most`` values is
    counted again in parts, until it holds fewer or one value alone; a heavy value is so counted and never sorted.
    ``written`` says that ``df`` is cheap to read again.
    """
    use_checkpoints(df.sparkSession)
    rows = df.select(*keys, F.col(value).cast("double").alias("_x"))
    # Written once: it is read several times, and may come from a long computation.
    rows = (rows if written else rows.checkpoint()).filter("_x is not null")
    counted = (F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))

    def with_ends(counts: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("_s") if by else Window.partitionBy(F.lit(0)).orderBy("_s")
        return counts.withColumn("_end", F.sum("_n").over(order))

    counts = with_ends(rows.groupBy(*keys, _slice(F.col("_x")).alias("_s")).agg(*counted), *keys)
    total = rows.groupBy(*keys).agg(F.count("*").alias("_all"))
    one = lambda p: F.struct(F.lit(p).alias("percentile"), (F.lit(p) * (F.col("_all") - 1)).alias("_at"))
    wanted = total.select("*", F.inline(F.array(*map(one, at))))
    low, share = F.floor("_at"), F.col("_at") - F.floor("_at")
    ends = F.array(F.struct(low.alias("_rank"), (1 - share).alias("_w")), F.struct((low + 1).alias("_rank"), share.alias("_w")))
    wanted = wanted.select(*keys, "percentile", F.inline(ends)).filter("_w > 0").select(*keys, "_rank", "percentile", "_w")
    ranks = wanted.select(*keys, "_rank").distinct()
    inside = "_rank >= _end - _n and _rank < _end"
    found = (ranks.join(counts, [*keys]) if keys else ranks.crossJoin(counts)).filter(inside)
    # Each rank: the slice that holds it, and its place there from 0.
    at_slice = lambda d, rank: d.select(*keys, "_rank", "_lo", "_hi", "_n", (rank - F.col("_end") + F.col("_n")).alias("_nth"))
    open_slices = at_slice(found, F.col("_rank")).checkpoint()
    done = []
    wide = (F.col("_n") > most) & (F.col("_lo") < F.col("_hi"))
    while not open_slices.filter(wide).isEmpty():
        done.append(open_slices.filter(~wide))
        held = open_slices.filter(wide)
        held = rows.join(held.withColumnsRenamed({"_lo": "_a", "_hi": "_z"}).drop("_n"), [*keys]) if keys else rows.crossJoin(held.withColumnsRenamed({"_lo": "_a", "_hi": "_z"}).drop("_n"))
        part = F.floor((F.col("_x") - F.col("_a")) / (F.col("_z") - F.col("_a")) * PARTS).cast("long")
        parts = held.filter("_x >= _a and _x <= _z").groupBy(*keys, "_rank", "_nth", part.alias("_s")).agg(*counted)
        narrower = with_ends(parts, *keys, "_rank").filter("_nth >= _end - _n and _nth < _end")
        open_slices = at_slice(narrower, F.col("_nth")).checkpoint()
    for d in done:
        open_slices = open_slices.unionByName(d)
    single = open_slices.filter("_lo = _hi").select(*keys, "_rank", F.col("_lo").alias("_x"))
    several = open_slices.filter("_lo < _hi")
    few = rows.join(several, [*keys]) if keys else rows.crossJoin(several)
    order = Window.partitionBy(*keys, "_rank").orderBy("_x")
    placed = few.filter("_x >= _lo and _x <= _hi").withColumn("_place", F.row_number().over(order) - 1).filter("_place = _nth").select(*keys, "_rank", "_x")
    return wanted.join(single.unionByName(placed), [*keys, "_rank"]).groupBy(*keys, "percentile").agg(F.sum(F.col("_x") * F.col("_w")).alias(value))
