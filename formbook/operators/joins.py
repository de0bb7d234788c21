"""Joins with a checked broadcast, guarded keys and calendar look-back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formbook.session import broadcast_rows


def fits_broadcast(side: DataFrame, keys: Sequence[str]) -> bool:
    """Count at most limit + 1 keys of ``side``; only key columns are read."""
    limit = broadcast_rows(side.sparkSession)
    return side.select(*keys).limit(limit + 1).count() <= limit


def checked_join(
    df: DataFrame, side: DataFrame, on: Sequence[str], how: str = "left", rows: int | None = None
) -> DataFrame:
    """Broadcast ``side`` when it is small; otherwise a shuffled join.

    Small is counted, unless the caller already knows that ``side`` has at most
    ``rows`` rows. The shuffled join leaves hot keys to the adaptive skew split.
    """
    on = list(on)
    if rows is None:
        small = fits_broadcast(side, on)
    else:
        small = rows <= broadcast_rows(df.sparkSession)
    return df.join(F.broadcast(side) if small else side, on, how)


def join_back(
    df: DataFrame, by: Sequence[str], *aggs: Column, rows: int | None = None
) -> DataFrame:
    """Aggregates per group put on every row of the group.

    Replaces a window over the whole group: partial aggregation runs before
    the shuffle, so a group of any size never meets in one task. ``rows`` is a
    known bound on the number of groups.
    """
    return checked_join(df, df.groupBy(*by).agg(*aggs), by, rows=rows)


class RosterError(ValueError):
    """An event before which nobody is known to have started."""


class JoinGuardError(ValueError):
    """A dimension key is not unique, so the join would multiply rows."""


def guarded_join(left: DataFrame, right: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """N:1 left join that refuses a right side with repeated keys.

    One job over the keys of ``right`` both checks them and measures the side.
    """
    on = list(on)
    keys = right.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    size = keys.agg(F.count(F.lit(1)).alias("keys"), F.max("_n").alias("most")).first()
    if size["keys"] and size["most"] > 1:
        sample = [tuple(r)[:-1] for r in keys.where("_n > 1").orderBy(*on).limit(5).collect()]
        raise JoinGuardError(f"'{name}' repeats key {on}: {sample}")
    return checked_join(left, right, on, "left", size["keys"])


def calendar_of(facts: DataFrame, event: str = "event_id", *more: str) -> DataFrame:
    """Distinct events with their place in time."""
    return facts.select(event, "season", "round", *more).distinct()


def neighbours(calendar: DataFrame, event: str = "event_id") -> DataFrame:
    """Each event with the one before and after it, across seasons.

    Lag and lead run per season; a season's first and last events meet through
    the one-row-per-season table, so the calendar never sits in one task.
    """
    season = Window.partitionBy("season").orderBy("round", event)
    edges = calendar.groupBy("season").agg(
        F.min_by(event, F.struct("round", F.col(event))).alias("_first"),
        F.max_by(event, F.struct("round", F.col(event))).alias("_last"),
    )
    # One row per season: small by nature.
    seasons = Window.orderBy("season")
    edges = edges.select(
        "season",
        F.lag("_last").over(seasons).alias("_carry_prev"),
        F.lead("_first").over(seasons).alias("_carry_next"),
    )
    out = calendar.select(
        "*", F.lag(event).over(season).alias("_p"), F.lead(event).over(season).alias("_n")
    ).join(F.broadcast(edges), "season", "left")
    return out.select(
        *calendar.columns,
        F.coalesce("_p", "_carry_prev").alias(f"prev_{event}"),
        F.coalesce("_n", "_carry_next").alias(f"next_{event}"),
    )


def previous_event(calendar: DataFrame, event: str = "event_id") -> DataFrame:
    return neighbours(calendar, event).select(event, f"prev_{event}")


def lagged_join(
    df: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    columns: dict[str, str],
    event: str = "event_id",
    rows: int | None = None,
) -> DataFrame:
    """Post-event rows of ``right`` read at the previous calendar event.

    ``df`` must carry ``prev_<event>``; ``columns`` maps source to output name.
    ``rows`` is a known bound on the rows of ``right``.
    """
    prev = f"prev_{event}"
    side = right.select(
        F.col(event).alias(prev), *by, *[F.col(s).alias(t) for s, t in columns.items()]
    )
    return checked_join(df, side, [prev, *by], "left", rows)


def next_event(calendar: DataFrame, facts: DataFrame, event: str = "event_id") -> DataFrame:
    """The earliest event without a fact row; empty when there is none."""
    return (
        calendar.join(facts.select(event).distinct(), event, "left_anti")
        .orderBy("season", "round", event)
        .limit(1)
    )


def pending_events(calendar: DataFrame, facts: DataFrame, event: str = "event_id") -> DataFrame:
    """All events without a fact row."""
    return calendar.join(facts.select(event).distinct(), event, "left_anti")


def roster_as_of(
    events: DataFrame,
    calendar: DataFrame,
    facts: DataFrame,
    override: DataFrame | None = None,
    event: str = "event_id",
) -> DataFrame:
    """Entrants for ``events``: those of the latest completed event strictly before.
    An event without one, and without rows in ``override``, raises.

    Rows of ``override`` (event, entity, group) replace the inferred roster of
    their event.
    """
    done = calendar.join(facts.select(event).distinct(), event, "left_semi")
    # The calendar, with each event's latest completed predecessor.
    slot = F.struct("season", "round", F.col(event))
    marked = calendar.join(
        done.select(event, F.lit(True).alias("_done")), event, "left"
    ).withColumn("_slot", F.when(F.col("_done"), slot))
    season = Window.partitionBy("season").orderBy("round", event)
    within = marked.withColumn(
        "_w", F.max("_slot").over(season.rowsBetween(Window.unboundedPreceding, -1))
    )
    seasons = Window.orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        marked.groupBy("season")
        .agg(F.max("_slot").alias("_m"))
        .select("season", F.max("_m").over(seasons).alias("_c"))
    )
    latest = within.join(F.broadcast(carry), "season", "left").select(
        event, F.coalesce("_w", "_c")[event].alias("_from")
    )
    wanted = events.select(event).distinct().join(latest, event, "left")
    bare = wanted.where("_from IS NULL")
    if override is not None:
        bare = bare.join(override.select(event), event, "left_anti")
    some = [r[event] for r in bare.select(event).limit(5).collect()]
    if some:
        raise RosterError(f"no completed event before {some}")
    roster = (
        facts.select(F.col(event).alias("_from"), "entity_id", "group_id")
        .distinct()
        .join(wanted, "_from")
        .select(event, "entity_id", "group_id")
    )
    if override is None:
        return roster
    named = override.select(event, "entity_id", "group_id")
    return roster.join(named.select(event).distinct(), event, "left_anti").unionByName(named)


def within_windows(
    df: DataFrame, value: str, windows: Sequence[tuple], names: Sequence[str], outer: bool = False
) -> DataFrame:
    """Range join to a short literal table of ``(name..., lo, hi)`` windows.

    The windows are constants, so each row expands to the ones holding its
    value with no join at all. ``hi`` None is open. Rows in several windows
    repeat; rows in none drop out, or stay with NULLs if ``outer``.
    """
    table = F.array(
        *[
            F.struct(
                *[F.lit(v).alias(n) for n, v in zip(names, w[:-2])],
                F.lit(w[-2]).cast("long").alias("lo"),
                F.lit(w[-1]).cast("long").alias("hi"),
            )
            for w in windows
        ]
    )
    held = F.filter(
        table,
        lambda w: (F.col(value) >= w["lo"]) & (w["hi"].isNull() | (F.col(value) <= w["hi"])),
    )
    return df.select("*", F.inline_outer(held) if outer else F.inline(held))


def interval_totals(
    sessions: DataFrame,
    observations: DataFrame,
    start: str,
    at: str,
    hours: int,
    total: str,
    mean: str,
    place: Sequence[str] = (),
) -> DataFrame:
    """Sum of ``total`` and mean of ``mean`` over the hour bins from ``start``.

    Bins are an equi-join key: each session meets only its own ``hours`` bins.
    A session with no bin at all gets NULL in both.
    """
    bins = observations.select(
        *place, F.date_trunc("hour", at).alias("_hour"), total, mean
    )
    # Sessions of one hour share their bins: look each distinct hour up once.
    starts = sessions.select(*place, F.date_trunc("hour", start).alias("_start")).distinct()
    wanted = starts.select(
        "*",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(hours - 1)),
                lambda h: F.col("_start") + F.make_dt_interval(hours=h),
            )
        ).alias("_hour"),
    )
    found = (
        wanted.join(bins, [*place, "_hour"])
        .groupBy(*place, "_start")
        .agg(F.sum(total).alias("total"), F.avg(mean).alias("mean"))
    )
    keyed = sessions.withColumn("_start", F.date_trunc("hour", start))
    return checked_join(keyed, found, [*place, "_start"]).drop("_start")
