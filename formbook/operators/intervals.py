"""Range joins to interval tables of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Halvings of the whole range below which intervals are not told apart by length.
LEVELS = 40


def _bin(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), level)).cast("long")


def interval_join(
    df: DataFrame,
    value: str,
    windows: DataFrame,
    lo: str,
    hi: str,
    names: Sequence[str],
    how: str = "inner",
) -> DataFrame:
    """Rows of ``df`` with ``names`` of every window whose [lo, hi] holds their ``value``.

    Windows are filed by length: one of length up to 2**level lies in at most three bins
    of that width, so values and windows meet in an equi-join on (level, bin) and are
    compared exactly after it. A value asks one bin per level in use, of which there are
    at most ``LEVELS``; only distinct values ask. A NULL end is open: it is taken to the
    smallest or largest value there is, as are ends beyond these. Neither side is
    broadcast or collected.

    Windows that end before they begin hold nothing. A NULL value is held by none; with
    ``how="left"`` rows in no window stay, with NULLs.
    """
    values = df.select(F.col(value).alias("_v")).where(F.col(value).isNotNull()).distinct()
    edge = values.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")).first()
    if edge["lo"] is None:
        held = windows.select(F.lit(None).cast(dict(df.dtypes)[value]).alias("_v"), *names).limit(0)
        return df.join(held, F.col(value) == F.col("_v"), how).drop("_v")
    kind = values.schema["_v"].dataType
    lowest, highest = F.lit(edge["lo"]).cast(kind), F.lit(edge["hi"]).cast(kind)
    clamped = windows.select(
        *names, F.coalesce(F.greatest(F.col(lo), lowest), lowest).alias("_lo"), F.coalesce(F.least(F.col(hi), highest), highest).alias("_hi")
    ).where("_lo <= _hi")

    def number(c: str) -> Column:
        # Order is kept, which is all that bins need; the comparison uses the values.
        return F.unix_micros(F.col(c).cast("timestamp")).cast("double") if kind.simpleString() in ("date", "timestamp") else F.col(c).cast("double")

    span = F.greatest(number("_hi") - number("_lo"), F.lit(0.0))
    ends = values.select(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    whole = ends.select((number("_hi") - number("_lo")).alias("w")).first()["w"] or 1.0
    least = F.ceil(F.log2(F.lit(float(whole)))) - LEVELS
    level = F.when(span > 0, F.greatest(F.ceil(F.log2(span)), least)).otherwise(least).cast("int")
    filed = clamped.withColumn("_level", level)
    filed = filed.withColumn("_bin", F.explode(F.sequence(_bin(number("_lo"), F.col("_level")), _bin(number("_hi"), F.col("_level")))))
    # At most LEVELS + 2 numbers.
    levels = sorted(r[0] for r in filed.select("_level").distinct().collect())
    if not levels:
        held = clamped.select(F.col("_lo").alias("_v"), *names).limit(0)
        return df.join(held, F.col(value) == F.col("_v"), how).drop("_v")
    asking = values.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels])))
    asking = asking.withColumn("_bin", _bin(number("_v"), F.col("_level")))
    held = asking.join(filed, ["_level", "_bin"]).where("_lo <= _v AND _v <= _hi").select("_v", *names)
    return df.join(held, F.col(value) == F.col("_v"), how).drop("_v")
