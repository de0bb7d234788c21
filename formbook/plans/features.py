"""Feature blocks: each describes a row by what was known before its event.

Order of work in ``build_features``: columns per event and per (event, group)
first, as aggregates joined back; then everything along an entity's history in
one shuffle; then the group blocks, which run on the small (group, event)
roll-up.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formbook.functions import scalars as S
from formbook.operators.frames import Prior, frames_over_parts, prior_frames
from formbook.operators.hot import HOT, PART, has_hot, split_hot
from formbook.operators.joins import (
    calendar_of,
    checked_join,
    join_back,
    lagged_join,
    neighbours,
)
from formbook.schemas import FEATURE_COLUMNS

# --- fixed values --------------------------------------------------------------
ENTITY_WINDOWS = (3, 5, 10)
GROUP_WINDOWS = (3, 5)
FORM_ROWS = 5
PODIUM = 3
SHRINK_K = 8.0
# ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Names:
    """Input columns; the defaults are those of the contest facts."""

    event: str = "event_id"
    season: str = "season"
    round: str = "round"
    entity: str = "entity_id"
    group: str = "group_id"
    venue: str = "venue_id"
    winner: str = "winner"
    order: str = "finish_order"
    finished: str = "finished"
    points: str = "points"
    quali: str = "quali_position"
    grid: str = "grid"
    q1: str = "q1"
    q2: str = "q2"
    q3: str = "q3"
    precip: str = "precip"

    def time(self) -> list[tuple[str, bool]]:
        return [(self.season, True), (self.round, True), (self.event, True)]


CONTEST = Names()
RACING = Names(
    event="raceId", season="year", round="round", entity="driverId", group="constructorId",
    venue="circuitId", order="positionOrder", quali="qualifying_position",
    precip="race_precip_mm",
)


def _podium(n: Names) -> Column:
    return (F.col(n.order) <= PODIUM).cast("double")


def _missed(n: Names) -> Column:
    """1.0 unless the row is known to have finished."""
    return 1.0 - F.coalesce(F.col(n.finished).cast("double"), F.lit(0.0))


def entity_form_frames(n: Names, windows: Sequence[int] = ENTITY_WINDOWS) -> list[Prior]:
    wins = [Prior(f"driver_wins_last_{w}", F.col(n.winner), "sum", w) for w in windows]
    return wins + [
        Prior("driver_podiums_last_5", _podium(n), "sum", FORM_ROWS),
        Prior("driver_avg_finish_last_5", F.col(n.order), "avg", FORM_ROWS),
        Prior("driver_dnf_rate_last_5", _missed(n), "avg", FORM_ROWS),
        Prior("driver_points_last_5", F.col(n.points), "sum", FORM_ROWS),
        Prior("driver_experience_races", F.lit(1), "count"),
    ]


def entity_form(
    df: DataFrame, n: Names = CONTEST, windows: Sequence[int] = ENTITY_WINDOWS
) -> DataFrame:
    """Rolling form of each entity over its earlier events."""
    return prior_frames(df, [n.entity], n.time(), entity_form_frames(n, windows))


def group_events(df: DataFrame, n: Names = CONTEST) -> DataFrame:
    """One row per (group, event): a window over it counts events, not entrants."""
    aggs = [
        F.max(F.col(n.winner).cast("double")).alias("win"),
        F.sum(_podium(n)).alias("podiums"),
        F.avg(_missed(n)).alias("dnf_rate"),
        F.avg(F.col(n.order).cast("double")).alias("finish"),
    ]
    if n.precip in df.columns:
        aggs.append(F.max(n.precip).alias(n.precip))
    return df.groupBy(n.group, n.event, n.season, n.round, n.venue).agg(*aggs)


def group_form_frames(windows: Sequence[int] = GROUP_WINDOWS) -> list[Prior]:
    wins = [Prior(f"constructor_wins_last_{w}", F.col("win"), "sum", w) for w in windows]
    return wins + [
        Prior("constructor_podiums_last_5", F.col("podiums"), "sum", FORM_ROWS),
        Prior("constructor_dnf_rate_last_5", F.col("dnf_rate"), "avg", FORM_ROWS),
    ]


def group_form(
    df: DataFrame, n: Names = CONTEST, windows: Sequence[int] = GROUP_WINDOWS
) -> DataFrame:
    """Rolling form of each group, put on the rows of its entrants."""
    frames = group_form_frames(windows)
    rolled = prior_frames(group_events(df, n), [n.group], n.time(), frames)
    side = rolled.select(n.group, n.event, *[f.out for f in frames])
    return checked_join(df, side, [n.group, n.event])


def venue_frames(n: Names) -> list[Prior]:
    return [
        Prior("driver_circuit_starts", F.lit(1), "count"),
        Prior("driver_circuit_wins", F.col(n.winner), "sum"),
        Prior("driver_circuit_avg_finish", F.col(n.order), "avg"),
    ]


def _no_wins_is_zero(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.coalesce(name, F.lit(0.0)))


def venue_history(df: DataFrame, n: Names = CONTEST) -> DataFrame:
    """Earlier visits of the entity and of its group to the same venue."""
    own = prior_frames(df, [n.entity, n.venue], n.time(), venue_frames(n))
    own = _no_wins_is_zero(own, "driver_circuit_wins")
    wins = [Prior("constructor_circuit_wins", F.col("win"), "sum")]
    rolled = prior_frames(group_events(df, n), [n.group, n.venue], n.time(), wins)
    rolled = _no_wins_is_zero(rolled, "constructor_circuit_wins")
    side = rolled.select(n.group, n.event, "constructor_circuit_wins")
    return checked_join(own, side, [n.group, n.event])


def leave_one_out(
    df: DataFrame, by: Sequence[str], columns: dict[str, str], rows: int | None = None
) -> DataFrame:
    """Mean of the others in the group, per source column; NULL when there are none."""
    aggs = []
    for source in columns:
        aggs += [F.sum(source).alias(f"_t_{source}"), F.count(source).alias(f"_n_{source}")]
    out = join_back(df, by, *aggs, rows=rows)
    for source, name in columns.items():
        rest = F.col(f"_t_{source}") - F.col(source)
        out = out.withColumn(name, F.try_divide(rest.cast("double"), F.col(f"_n_{source}") - 1))
    return out.drop(*[f"_{k}_{c}" for c in columns for k in "tn"])


def peer_gaps(df: DataFrame, n: Names = CONTEST, rows: int | None = None) -> DataFrame:
    """Same-event gaps to the rest of the group; ``_pace_gap`` is an outcome."""
    rest = {n.quali: "_quali_rest", n.order: "_pace_rest"}
    out = leave_one_out(df, [n.event, n.group], rest, rows)
    return out.select(
        *df.columns,
        (F.col("_quali_rest") - F.col(n.quali)).alias("qualifying_gap_to_teammate_current"),
        (F.col("_pace_rest") - F.col(n.order)).alias("_pace_gap"),
    )


def peer_frames(rows: int = FORM_ROWS) -> list[Prior]:
    current = F.col("qualifying_gap_to_teammate_current")
    return [
        Prior("qualifying_gap_to_teammate", current, "avg", rows),
        Prior("race_pace_delta_to_teammate", F.col("_pace_gap"), "avg", rows),
    ]


def peer_form(df: DataFrame, n: Names = CONTEST, rows: int = FORM_ROWS) -> DataFrame:
    """Gap to the group's others now, and its mean over earlier events."""
    gaps = peer_gaps(df, n)
    return prior_frames(gaps, [n.entity], n.time(), peer_frames(rows)).drop("_pace_gap")


def session_features(df: DataFrame, n: Names = CONTEST, rows: int | None = None) -> DataFrame:
    """Grid and session columns, from one aggregate per event."""
    times = {f"q{i}_sec": S.lap_seconds(c) for i, c in ((1, n.q1), (2, n.q2), (3, n.q3))}
    timed = df.withColumns(times).withColumn("_best", S.best_time("q3_sec", "q2_sec", "q1_sec"))
    field = F.count(n.entity).alias("field_size")
    event = join_back(timed, [n.event], F.min("_best").alias("_pole"), field, rows=rows)
    adjusted = S.adjusted_grid(F.col(n.grid), F.col("field_size")).cast("double")
    quali = F.col(n.quali)
    out = event.withColumns(
        {
            "qualifying_position": quali,
            "reached_q2": F.col(n.q2).isNotNull(),
            "reached_q3": F.col(n.q3).isNotNull(),
            "qualifying_gap_to_pole_pct": F.try_divide(F.col("_best") - F.col("_pole"), "_pole")
            * 100,
            "pit_lane_start": F.coalesce(F.col(n.grid) == 0, F.lit(False)),
            "grid_adjusted": adjusted,
            "grid_position_norm": F.try_divide(adjusted, "field_size"),
            "grid_penalty_applied": S.over_threshold(adjusted - quali, S.PENALTY_PLACES),
        }
    )
    return out.drop("_best", "_pole")


def event_join(
    df: DataFrame, right: DataFrame, event: str = "event_id", rows: int | None = None
) -> DataFrame:
    """Columns of an event on each of its rows."""
    return checked_join(df, right, [event], rows=rows)


def condition_frames(value: str, n: Names, prefix: str) -> list[Prior]:
    wet, dry = S.is_wet(n.precip), ~S.is_wet(n.precip)
    return [
        Prior(f"_{prefix}_wet", F.when(wet, F.col(value)), "avg"),
        Prior(f"_{prefix}_wet_n", F.when(wet, F.col(value)), "count"),
        Prior(f"_{prefix}_dry", F.when(dry, F.col(value)), "avg"),
    ]


def shrink(
    df: DataFrame, prefix: str, event: str, out: str, k: float = SHRINK_K, rows: int | None = None
) -> DataFrame:
    """Pull the wet-minus-dry mean towards the event's mean of it."""
    raw = df.withColumn("_raw", F.col(f"_{prefix}_wet") - F.col(f"_{prefix}_dry"))
    pooled = join_back(raw, [event], F.avg("_raw").alias("_pooled"), rows=rows)
    n = F.col(f"_{prefix}_wet_n")
    weight = n / (n + k)
    blended = weight * F.coalesce("_raw", F.lit(0.0)) + (1 - weight) * F.col("_pooled")
    return pooled.withColumn(out, blended).drop(
        "_raw", "_pooled", f"_{prefix}_wet", f"_{prefix}_wet_n", f"_{prefix}_dry"
    )


def shrunk_delta(df: DataFrame, n: Names = CONTEST, k: float = SHRINK_K) -> DataFrame:
    """Wet-minus-dry finish per entity and per group, over earlier events."""
    own = prior_frames(df, [n.entity], n.time(), condition_frames(n.order, n, "e"))
    own = shrink(own, "e", n.event, "driver_wet_dry_delta", k)
    side = group_shrunk_delta(df, n, k)
    return checked_join(own, side, [n.group, n.event])


def group_shrunk_delta(df: DataFrame, n: Names = CONTEST, k: float = SHRINK_K) -> DataFrame:
    rolled = prior_frames(
        group_events(df, n), [n.group], n.time(), condition_frames("finish", n, "g")
    )
    rolled = shrink(rolled, "g", n.event, "constructor_wet_dry_delta", k)
    return rolled.select(n.group, n.event, "constructor_wet_dry_delta")


def standings_lag(
    df: DataFrame,
    standings: DataFrame,
    group_standings: DataFrame,
    n: Names = CONTEST,
    calendar: DataFrame | None = None,
    events: int | None = None,
) -> DataFrame:
    """Season standings as they stood after the previous calendar event.

    ``calendar`` (event, season, round) is derived from ``df`` when not given;
    ``events`` is a known bound on its rows.
    """
    if calendar is None:
        calendar = df.select(n.event, n.season, n.round).distinct()
    calendar = calendar.select(
        F.col(n.event), F.col(n.season).alias("season"), F.col(n.round).alias("round")
    )
    prev = neighbours(calendar, n.event).select(n.event, f"prev_{n.event}")
    out = checked_join(df, prev, [n.event], rows=events)
    own = {
        "position": "driver_standing_position_prev",
        "points": "driver_standing_points_prev",
        "wins": "driver_standing_wins_prev",
    }
    group = {
        "position": "constructor_standing_position_prev",
        "points": "constructor_standing_points_prev",
    }
    out = lagged_join(out, standings, [n.entity], own, n.event)
    out = lagged_join(out, group_standings, [n.group], group, n.event)
    return out.drop(f"prev_{n.event}")


def build_features(
    master: DataFrame,
    standings: DataFrame,
    group_standings: DataFrame,
    conditions: DataFrame,
    n: Names = CONTEST,
) -> DataFrame:
    """All feature columns; keys, then features, then the target.

    ``conditions`` holds one row per event: the precipitation column ``n.precip``
    and ``race_temp_c``, ``quali_precip_mm``, ``conditions_changed``.
    """
    keys = [n.event, n.entity, n.group, n.venue, n.season, n.round]
    base = master.select(
        *keys, n.winner, n.order, n.finished, n.points, n.quali, n.grid, n.q1, n.q2, n.q3
    )
    # One count of events and (event, group) pairs bounds every side joined
    # back below, and the rows of an entity or a group, which enter an event once.
    size = base.groupBy(n.event, n.group).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.count(F.lit(1)).alias("pairs"), F.count_distinct(n.event).alias("events")
    ).first()
    events, pairs = size["events"], size["pairs"]

    df = peer_gaps(session_features(base, n, events), n, pairs)
    df = event_join(df, conditions, n.event)

    # One shuffle by entity serves form, peers, weather and venue history.
    cut = df
    if has_hot(df, [n.entity], events):
        cut = split_hot(df, [n.entity], n.time()[:2])
    along = [*entity_form_frames(n), *peer_frames(), *condition_frames(n.order, n, "e")]
    df = frames_over_parts(cut, [n.entity], n.time(), along)
    df = frames_over_parts(df, [n.entity, n.venue], n.time(), venue_frames(n))
    df = _no_wins_is_zero(df.drop(HOT, PART, "_pace_gap"), "driver_circuit_wins")
    df = shrink(df, "e", n.event, "driver_wet_dry_delta", rows=events)

    # The group blocks share one roll-up, far smaller than the facts.
    rolled = event_join(group_events(base, n), conditions.select(n.event, n.precip), n.event)
    frames = [*group_form_frames(), *condition_frames("finish", n, "g")]
    rolled = prior_frames(rolled, [n.group], n.time(), frames, events)
    wins = [Prior("constructor_circuit_wins", F.col("win"), "sum")]
    rolled = prior_frames(rolled, [n.group, n.venue], n.time(), wins, events)
    rolled = _no_wins_is_zero(rolled, "constructor_circuit_wins")
    rolled = shrink(rolled, "g", n.event, "constructor_wet_dry_delta", rows=events)
    side = rolled.select(
        n.group, n.event, *[f.out for f in group_form_frames()],
        "constructor_circuit_wins", "constructor_wet_dry_delta",
    )
    df = checked_join(df, side, [n.group, n.event], rows=pairs)
    calendar = base.select(n.event, n.season, n.round).distinct()
    df = standings_lag(df, standings, group_standings, n, calendar, events)
    if n.precip != "race_precip_mm":
        df = df.withColumnRenamed(n.precip, "race_precip_mm")
    return df.select(*keys, *FEATURE_COLUMNS, n.winner)
