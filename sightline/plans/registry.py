"""All queries of the library, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sightline.operators import reconstruction, trajectories
from sightline.plans import queries as relational


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled 3-D trajectories from 2-D observations: gap fill, triangulate, wide pivot."""
    observed = trajectories.fill_image_gaps(relational.obs_of(spark, sf_dir))
    points = reconstruction.triangulate(observed, relational.cams_of(spark))
    return trajectories.wide(points, relational.NAMES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"labelled_trajectories": flagship, **relational.QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(relational.ORACLES)
