"""Length of a path of points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formbook.functions.scalars import haversine_m
from formbook.operators.hot import PART, Order, has_hot, sort_columns, split_hot


def path_length(
    points: DataFrame,
    by: Sequence[str],
    order: Order,
    lat: str = "lat",
    lon: str = "lon",
    closed: bool = False,
) -> DataFrame:
    """Metres along the points of each key; ``closed`` adds the way back.

    A path above the session limit is measured in parts; the leg between two
    parts comes from the table of each part's first and last point.
    """
    hot = has_hot(points, by)
    rows = split_hot(points, by, order[:2]) if hot else points
    key = [*by, PART] if hot else list(by)
    here = F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    along = Window.partitionBy(*key).orderBy(*sort_columns(order))
    legs = rows.withColumns({"_here": here, "_next": F.lead(here).over(along)})
    place = F.struct(*[F.col(c) if asc else -F.col(c) for c, asc in order])
    parts = legs.groupBy(*key).agg(
        F.sum(_leg("_here", "_next")).alias("_m"),
        F.min_by("_here", place).alias("_first"),
        F.max_by("_here", place).alias("_last"),
    )
    if hot:
        across = Window.partitionBy(*by).orderBy(PART)
        parts = parts.withColumn("_then", F.lead("_first").over(across))
        parts = parts.groupBy(*by).agg(
            F.sum(
                F.coalesce("_m", F.lit(0.0)) + F.coalesce(_leg("_last", "_then"), F.lit(0.0))
            ).alias("_m"),
            F.min_by("_first", PART).alias("_first"),
            F.max_by("_last", PART).alias("_last"),
        )
    total = F.col("_m") + _leg("_last", "_first") if closed else F.col("_m")
    return parts.select(*by, total.alias("metres"))


def _leg(a: str, b: str):
    return haversine_m(f"{a}.lat", f"{a}.lon", f"{b}.lat", f"{b}.lon")
