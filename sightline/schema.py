"""The two relations and their dimension: types, validation, empty tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATIC_SYNC_INDEX = -1
POINT = ("object_id", "keypoint_id")
WORLD_KEY = ("sync_index", *POINT)
IMAGE_KEY = ("sync_index", "cam_id", *POINT)


def _struct(required: tuple, optional: tuple) -> T.StructType:
    kinds = {"l": T.LongType(), "d": T.DoubleType()}
    return T.StructType([T.StructField(n, kinds[k], False) for n, k in required] + [T.StructField(n, kinds[k], True) for n, k in optional])


IMAGE_POINTS = _struct(
    (*((k, "l") for k in IMAGE_KEY), ("img_loc_x", "d"), ("img_loc_y", "d")),
    (("obj_loc_x", "d"), ("obj_loc_y", "d"), ("obj_loc_z", "d"), ("frame_time", "d")),
)
WORLD_POINTS = _struct((*((k, "l") for k in WORLD_KEY), ("x_coord", "d"), ("y_coord", "d"), ("z_coord", "d")), (("frame_time", "d"),))
#: Intrinsics, five distortion terms, rotation (row by row) and translation from world to camera.
CAMERA_NUMBERS = ("fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2", "k3", *(f"r{i}" for i in range(9)), "t0", "t1", "t2")
CAMERAS = T.StructType(
    [T.StructField("cam_id", T.LongType(), False), T.StructField("width", T.LongType()), T.StructField("height", T.LongType())]
    + [T.StructField(n, T.DoubleType()) for n in CAMERA_NUMBERS]
    + [T.StructField("ignored", T.BooleanType()), T.StructField("fisheye", T.BooleanType())]
)


class SchemaError(ValueError):
    """A table lacks a column, or a required column has values that are missing or no numbers."""


def coerce(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns first, cast (what can't be cast and NaN is null), extra columns after them."""
    missing = [f.name for f in schema if f.name not in df.columns and not f.nullable]
    if missing:
        raise SchemaError(f"columns are missing: {missing}")
    out = []
    for f in schema:
        if f.name not in df.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        number = F.col(f.name).try_cast("double")
        clean = F.when(~F.isnan(number), number)
        if isinstance(f.dataType, T.LongType):
            # A fraction in an integer column is an error, never rounded.
            clean = F.when(clean == F.floor(clean), F.coalesce(F.col(f.name).try_cast("long"), clean.try_cast("long")))
        out.append(clean.alias(f.name))
    return df.select(*out, *(c for c in df.columns if c not in schema.names))


def null_counts(df: DataFrame, schema: T.StructType) -> DataFrame:
    """One row: how many values of each required column are null."""
    return df.agg(*(F.count_if(F.col(f.name).isNull()).alias(f.name) for f in schema if not f.nullable))


def validate(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``coerce``, and SchemaError if a required value is null then. Runs one aggregate."""
    out = coerce(df, schema)
    bad = {k: n for k, n in null_counts(out, schema).first().asDict().items() if n}
    if bad:
        raise SchemaError(f"required values are missing: {bad}")
    return out


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def duplicate_keys(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """(n_duplicates): rows beyond the first of each key."""
    return df.groupBy(*key).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_duplicates"))
