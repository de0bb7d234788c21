"""Frames over earlier rows only: nothing of the current row enters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formbook.operators.hot import HOT, PART, Order, has_hot, sort_columns, split_hot


def prior(
    expr: Column, by: Sequence[str], order: Sequence[str], n: int | None = None, agg: str = "sum"
) -> Column:
    """Aggregate of ``expr`` over the ``n`` rows before this one (all when None).

    For groups known to fit one task; ``prior_frames`` serves any size.
    """
    start = Window.unboundedPreceding if n is None else -n
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(start, -1)
    return {"sum": F.sum, "avg": F.avg, "count": F.count}[agg](expr).over(frame)


@dataclass(frozen=True)
class Prior:
    """One output column of ``prior_frames``; ``rows=None`` means all earlier rows."""

    out: str
    expr: Column
    agg: str = "sum"
    rows: int | None = None


def prior_frames(
    df: DataFrame,
    by: Sequence[str],
    order: Order,
    frames: Sequence[Prior],
    rows: int | None = None,
) -> DataFrame:
    """All ``frames`` of one key in one pass: one shuffle, one sort.

    Groups above the session limit are cut into parts along ``order``
    (``hot.split_hot``). Frames reach back over a part boundary through the
    last rows of the parts before it (bounded frames) or through their totals
    (unbounded frames). ``rows`` is a known bound on the rows of a group.
    """
    parted = split_hot(df, by, order[:2]) if has_hot(df, by, rows) else df
    return frames_over_parts(parted, by, order, frames).drop(HOT, PART)


def frames_over_parts(
    parted: DataFrame, by: Sequence[str], order: Order, frames: Sequence[Prior]
) -> DataFrame:
    """As ``prior_frames`` on rows ``split_hot`` cut, or that need no cut.

    ``by`` may be finer than the key the rows were cut on: an (entity, venue)
    frame over rows cut by entity reuses the entity shuffle.
    """
    if PART not in parted.columns:
        return parted.select(
            *[c for c in parted.columns if c not in {f.out for f in frames}],
            *[_plain(f, by, order).alias(f.out) for f in frames],
        )
    # Equal expressions share one value column, equal windows one aggregate.
    values: list[Column] = []
    slots: list[int] = []
    for frame in frames:
        text = str(frame.expr)
        match = next((i for i, v in enumerate(values) if str(v) == text), None)
        if match is None:
            values.append(frame.expr)
            match = len(values) - 1
        slots.append(match)
    base = parted.select("*", *[v.cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    key = [*by, PART]
    ordered = Window.partitionBy(*key).orderBy(*sort_columns(order))
    widths = sorted({f.rows for f in frames if f.rows is not None})
    open_slots = sorted({s for s, f in zip(slots, frames) if f.rows is None})

    windows: list[Column] = [(F.row_number().over(ordered) - 1).alias("_before")]
    for slot, rows in sorted({(s, f.rows or 0) for s, f in zip(slots, frames)}):
        start = -rows if rows else Window.unboundedPreceding
        frame = ordered.rowsBetween(start, -1)
        windows.append(F.sum(f"_v{slot}").over(frame).alias(f"_sum{slot}_{rows}"))
        windows.append(F.count(f"_v{slot}").over(frame).alias(f"_cnt{slot}_{rows}"))
    local = base.select("*", *windows)

    hot = base.where(HOT)
    carried = _carry(hot, by, key, order, len(values), widths, open_slots)
    out = local.join(carried, key, "left") if carried is not None else local

    columns: list[Column] = []
    for slot, frame in zip(slots, frames):
        rows = frame.rows or 0
        total, count = F.col(f"_sum{slot}_{rows}"), F.col(f"_cnt{slot}_{rows}")
        if rows:
            missing = F.greatest(F.lit(0), F.lit(rows) - F.col("_before"))
            reach = F.slice(
                "_tail",
                F.greatest(F.lit(1), F.size("_tail") - missing + 1).cast("int"),
                missing.cast("int"),
            )
            far_sum, far_cnt = _reach_totals(reach, f"_v{slot}")
            has = F.col("_tail").isNotNull() & (missing > 0)
        else:
            far_sum, far_cnt = F.col(f"_psum{slot}"), F.col(f"_pcnt{slot}")
            has = F.col(f"_pcnt{slot}").isNotNull()
        total = F.when(has, F.coalesce(total, F.lit(0.0)) + far_sum).otherwise(total)
        count = F.when(has, count + far_cnt).otherwise(count)
        total = F.when(count > 0, total)
        pick = {"sum": total, "avg": F.try_divide(total, count), "count": count}
        columns.append(pick[frame.agg].alias(frame.out))
    new = {f.out for f in frames}
    return out.select(*[c for c in parted.columns if c not in new], *columns)


def _plain(frame: Prior, by: Sequence[str], order: Order) -> Column:
    start = Window.unboundedPreceding if frame.rows is None else -frame.rows
    rows = Window.partitionBy(*by).orderBy(*sort_columns(order)).rowsBetween(start, -1)
    value = frame.expr.cast("double")
    return {"sum": F.sum, "avg": F.avg, "count": F.count}[frame.agg](value).over(rows)


def _reach_totals(rows: Column, item: str) -> tuple[Column, Column]:
    """Sum and count of one field over an array of rows."""
    total = F.aggregate(rows, F.lit(0.0), lambda a, x: a + F.coalesce(x[item], F.lit(0.0)))
    count = F.aggregate(
        rows, F.lit(0).cast("long"), lambda a, x: a + x[item].isNotNull().cast("long")
    )
    return total, count


def _carry(hot, by, key, order, n_values, widths, open_slots):
    """Per (group, part): the last rows and the totals of all parts before it."""
    across = Window.partitionBy(*by).orderBy(PART)
    carried = None
    if widths:
        reach = max(widths)
        back = Window.partitionBy(*key).orderBy(
            *[F.col(n).desc_nulls_first() if asc else F.col(n).asc_nulls_first() for n, asc in order]
        )
        fields = [F.col(f"_v{i}") for i in range(n_values)]
        tails = (
            hot.withColumn("_back", F.row_number().over(back))
            .where(F.col("_back") <= reach)
            .groupBy(*key)
            .agg(
                F.sort_array(
                    F.collect_list(F.struct((-F.col("_back")).alias("_at"), *fields))
                ).alias("_own")
            )
        )
        lists = F.flatten(F.collect_list("_own").over(across.rowsBetween(-reach, -1)))
        carried = tails.withColumn("_seen", lists).select(
            *key,
            F.slice(
                "_seen", F.greatest(F.lit(1), F.size("_seen") - reach + 1).cast("int"), reach
            ).alias("_tail"),
        )
    if open_slots:
        earlier = across.rowsBetween(Window.unboundedPreceding, -1)
        totals = hot.groupBy(*key).agg(
            *[F.sum(f"_v{s}").alias(f"_t{s}") for s in open_slots],
            *[F.count(f"_v{s}").alias(f"_n{s}") for s in open_slots],
        )
        totals = totals.select(
            *key,
            *[
                F.coalesce(F.sum(f"_t{s}").over(earlier), F.lit(0.0)).alias(f"_psum{s}")
                for s in open_slots
            ],
            *[
                F.coalesce(F.sum(f"_n{s}").over(earlier), F.lit(0)).alias(f"_pcnt{s}")
                for s in open_slots
            ],
        )
        carried = totals if carried is None else carried.join(totals, key)
    return carried
