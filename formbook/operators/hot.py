"""Splitting of groups too large for one task.

A window over ``partitionBy(key)`` puts a whole group into one task. When one
group may hold a third of the table that task never ends. So the group sizes
are counted first (a key-only, pre-aggregated pass). If every group is below
the session's row limit, the plain window is planned. Otherwise windows are
partitioned by ``(key, _part)``: small groups keep ``_part = 0``, a group above
the limit gets parts that grow along the sort order, cut at approximate
quantiles, and what crosses a part boundary is added from a table with one row
per (group, part).

Cutting at quantiles is exact whatever the quantiles are: they only decide the
balance. Parts still too large are cut again, so their number follows the size of
the group. Rows equal to a cut value form a part of their own, divided again by
the second sort column, so a single value shared by all rows is split as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formbook.session import hot_group_rows, hot_group_splits, new_path

PART = "_part"
HOT = "_hot"

# A sort key: (column name, ascending).
Order = Sequence[tuple[str, bool]]


def sort_columns(order: Order) -> list[Column]:
    return [
        F.col(name).asc_nulls_last() if asc else F.col(name).desc_nulls_last()
        for name, asc in order
    ]


def hot_keys(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Keys with more rows than the session limit; fewer than rows/limit of them."""
    limit = hot_group_rows(df.sparkSession)
    return (
        df.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > limit)
        .select(*by)
    )


def has_hot(df: DataFrame, by: Sequence[str], rows: int | None = None) -> bool:
    """Is any group above the session limit? ``rows`` is a known bound on the
    rows of a group; it saves the count when it is below the limit."""
    if rows is not None and rows <= hot_group_rows(df.sparkSession):
        return False
    return not hot_keys(df, by).isEmpty()


def _number(df: DataFrame, name: str, asc: bool) -> Column:
    """A number along the sort order of a column; of text, its first six bytes."""
    value = F.col(name)
    if dict(df.dtypes)[name] == "string":
        head = F.rpad(F.hex(F.substring(F.encode(value, "utf-8"), 1, 6)), 12, "0")
        value = F.conv(head, 16, 10).cast("long")
    return value if asc else -value


def split_hot(df: DataFrame, by: Sequence[str], order: Order) -> DataFrame:
    """Add ``_part`` and ``_hot``; ``order`` names one or two sort columns.

    Each round cuts every group or part above the session limit into a few; parts
    that are still more than twice the limit are cut again, so the number of parts
    follows the size of the group. It ends when all are small, or when rows equal
    in the sort columns leave nothing to cut.
    """
    limit, splits = hot_group_rows(df.sparkSession), hot_group_splits(df.sparkSession)
    out = _cut(df.withColumn(PART, F.lit(0).cast("long")), [*by, PART], order, limit, splits)
    out = out.withColumn(HOT, F.col(_CUT_HERE)).drop(_CUT_HERE)
    seen = None
    while True:
        sizes = out.where(HOT).groupBy(*by, PART).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 2 * limit)
        left = sizes.agg(F.count(F.lit(1)), F.max("_n"), F.sum("_n")).first()
        if not left[0] or left == seen:
            return out
        seen = left
        out = _cut(out, [*by, PART], order, 2 * limit, splits).drop(_CUT_HERE)


_CUT_HERE = "_cut_here"


def _cut(df: DataFrame, key: Sequence[str], order: Order, limit: int, splits: int) -> DataFrame:
    """Cut the groups of ``key`` (its last column is the part) with more rows than
    ``limit``; parts are renumbered along the order, ``_cut_here`` marks rows of cut ones.

    The quantile table holds one row per group to cut. Each has more than ``limit``
    rows, so there are fewer than rows/limit of them (under 100,000 for 10^12 rows),
    which bounds the broadcast.
    """
    cuts = F.array(*[F.lit(i / splits) for i in range(1, splits)])
    first = order[0]
    second = order[1] if len(order) > 1 else None
    aggs = [F.array_distinct(F.percentile_approx(_number(df, *first), cuts)).alias("_cut1")]
    if second:
        aggs.append(F.array_distinct(F.percentile_approx(_number(df, *second), cuts)).alias("_cut2"))
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    hot = F.broadcast(sizes.where(F.col("_n") > limit).select(*key))
    edges = df.join(hot, list(key), "left_semi").groupBy(*key).agg(*aggs)
    out = df.join(F.broadcast(edges), list(key), "left")
    value = _number(df, *first)
    tie = F.coalesce(F.array_contains("_cut1", value), F.lit(False))
    below = F.when(value.isNull(), F.size("_cut1")).otherwise(
        F.size(F.filter("_cut1", lambda e: e < value))
    )
    inner = F.lit(0)
    if second:
        value2 = _number(df, *second)
        inner = F.when(value2.isNull(), F.size("_cut2")).otherwise(
            F.size(F.filter("_cut2", lambda e: e < value2))
        )
        # Without a cut value between them nulls share one first-level part,
        # so they too are divided by the second column.
        tie = tie | value.isNull()
    part = 1 + (2 * below + tie.cast("int")) * (splits + 1) + F.when(tie, inner).otherwise(0)
    here = F.coalesce(F.col("_cut1").isNotNull(), F.lit(False))
    # More than the largest number a cut can give.
    step = 2 * (splits + 1) ** 2 + 2
    return (
        out.withColumn(_CUT_HERE, here)
        .withColumn(PART, F.col(PART) * step + F.when(here, part).otherwise(0).cast("long"))
        .drop("_cut1", "_cut2")
    )


def range_parts(df: DataFrame, by: Sequence[str], order: Order) -> DataFrame:
    """``df`` with ``_part``, cut into ranges along (``by``, ``order``), and ``_hot``.

    The cuts compare whole rows in all sort columns, so text that begins alike, or rows
    equal in the first columns, are divided like any others. There are as many ranges as
    keep one near half the session limit, at least as many as shuffle partitions. The
    cut table is written: its ranges stay when a task is repeated.
    """
    spark, limit = df.sparkSession, hot_group_rows(df.sparkSession)
    path = new_path(spark, "ranges")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * df.count() // limit + 1)
    keys = [F.col(c).asc_nulls_last() for c in by] + sort_columns(order)
    df.repartitionByRange(ranges, *keys).withColumn(PART, F.spark_partition_id().cast("long")).write.parquet(path)
    return spark.read.parquet(path).withColumn(HOT, F.lit(True))


def with_prefix(
    df: DataFrame,
    by: Sequence[str],
    order: Order,
    sums: dict[str, Column],
    inclusive: bool = True,
    rows: int | None = None,
) -> DataFrame:
    """Running sums along ``order`` within ``by``, for groups of any size.

    ``order`` must be total within a group for a defined result. ``rows`` is a known
    bound on the rows of a group.
    """
    key = list(by) or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(1))
    for name, expr in sums.items():
        base = base.withColumn(f"_s_{name}", expr)
    end = 0 if inclusive else -1
    if not has_hot(base, key, rows):
        rows = Window.partitionBy(*key).orderBy(*sort_columns(order))
        rows = rows.rowsBetween(Window.unboundedPreceding, end)
        return base.select(
            *[c for c in df.columns if c not in sums],
            *[F.coalesce(F.sum(f"_s_{n}").over(rows), F.lit(0)).alias(n) for n in sums],
        )
    parted = range_parts(base, key, order)
    rows = Window.partitionBy(*key, PART).orderBy(*sort_columns(order))
    rows = rows.rowsBetween(Window.unboundedPreceding, end)
    across = Window.partitionBy(*key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        parted.where(HOT)
        .groupBy(*key, PART)
        .agg(*[F.sum(f"_s_{n}").alias(f"_p_{n}") for n in sums])
        .select(*key, PART, *[F.sum(f"_p_{n}").over(across).alias(f"_c_{n}") for n in sums])
    )
    local = parted
    for name in sums:
        local = local.withColumn(f"_l_{name}", F.coalesce(F.sum(f"_s_{name}").over(rows), F.lit(0)))
    out = local.join(carried, [*key, PART], "left")
    for name in sums:
        out = out.withColumn(name, F.col(f"_l_{name}") + F.coalesce(F.col(f"_c_{name}"), F.lit(0)))
    return out.select(*[c for c in df.columns if c not in sums], *sums)


def rank_within(
    df: DataFrame, by: Sequence[str], order: Order, out: str, rows: int | None = None
) -> DataFrame:
    """``row_number()`` along ``order`` within ``by``, for groups of any size. ``rows``
    is a known bound on the rows of a group."""
    if by and not has_hot(df, by, rows):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*sort_columns(order)))
        return df.withColumn(out, place.cast("long"))
    return with_prefix(df, by, order, {out: F.lit(1).cast("long")}, rows=rows)


def tie_rank(by: Sequence[str], value: str) -> Column:
    """``average_rank`` as windows, for groups that fit one task."""
    place = F.rank().over(Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return place + (ties - 1) / 2


def average_rank(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Rank of ``value`` within ``by``; equal values share their mean rank.

    In a split group the rank, which depends on (key, value) alone, is computed
    on the grouped distinct values and joined back.
    """
    if not has_hot(df, by):
        return df.withColumn(out, tie_rank(by, value))
    distinct = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_ties"))
    below = with_prefix(distinct, by, [(value, True)], {"_below": F.col("_ties")}, inclusive=False)
    ranked = below.select(*by, value, (F.col("_below") + (F.col("_ties") + 1) / 2).alias(out))
    return df.join(ranked, [*by, value], "left")
