"""Running evaluation of the served model, and rows for events to come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.operators.joins import checked_join
from formbook.operators.quality import events_without_one_winner
from formbook.operators.setops import aligned_union
from formbook.plans import metrics as M
from formbook.plans.features import CONTEST, Names, build_features
from formbook.plans.scoring import require_scoring_input

# --- fixed values --------------------------------------------------------------
SMALL_SAMPLE = 24
SUMMARY_METRICS = (
    "top1_accuracy", "top3_recall", "winner_mrr", "avg_winner_probability", "median_winner_rank",
    "log_loss", "brier_score", "ece", "spearman_corr",
)
# ------------------------------------------------------------------------------


class MaterialiseError(ValueError):
    """An event that already has results, or has no entrants."""


def score_new_events(
    score: Callable[[DataFrame], DataFrame],
    facts: DataFrame,
    tracked: DataFrame,
    model: dict[str, str] | None = None,
    target: str = "winner",
    order: str = "finish_order",
    event: str = "event_id",
) -> DataFrame:
    """Metric rows of complete events that ``tracked`` does not hold.

    Events stay scored by the model that first saw them; an event without a
    single confirmed winner waits. Repeated entrants and unusable scores raise before
    a row is made.
    """
    new = checked_join(facts, tracked.select(event).distinct(), [event], "left_anti")
    open_events = events_without_one_winner(new, event, target).select(event)
    ready = checked_join(new, open_events, [event], "left_anti")
    require_scoring_input(ready, [target, order], event)
    scored = score(ready)
    frame = M.as_scored(scored, "p", target, order, event, "season", "round")
    M.require_evaluation_input(frame, event)
    out = M.metrics(frame, [event, "season", "round"], event)
    stamps = {f"model_{k}": F.lit(v) for k, v in (model or {}).items()}
    return out.withColumns({**stamps, "scored_at": F.current_timestamp()})


def extend_report(report: DataFrame, new_rows: DataFrame, event: str = "event_id") -> DataFrame:
    """The report with new rows; rows of tracked events are not added again."""
    fresh = new_rows.join(report.select(event), event, "left_anti")
    return aligned_union(report, fresh).orderBy(event)


def summarise_tracking(report: DataFrame) -> DataFrame:
    """Means over all tracked events, with their number and a small-sample flag."""
    names = [m for m in SUMMARY_METRICS if m in report.columns]
    out = report.agg(
        F.count(F.lit(1)).alias("n_events"), *[F.avg(F.col(m).cast("double")).alias(m) for m in names]
    )
    return out.withColumn("small_sample", F.col("n_events") < SMALL_SAMPLE)


def synthetic_rows(
    events: DataFrame, roster: DataFrame, quali: DataFrame, history: DataFrame, n: Names = CONTEST
) -> DataFrame:
    """Rows for entrants of events without results, shaped like ``history``.

    Qualifying is what is known; the grid is taken from it; outcomes hold 0 and
    are never read by a feature of their own event.
    """
    base = checked_join(
        roster.select(n.event, n.entity, n.group),
        events.select(n.event, n.season, n.round, n.venue).distinct(),
        [n.event],
        "inner",
    )
    side = quali.select(n.event, n.entity, n.quali, n.q1, n.q2, n.q3)
    rows = base.join(side, [n.event, n.entity], "left").withColumn(n.grid, F.col(n.quali))
    outcome = {c: F.lit(0) for c in (n.winner, n.order, n.finished, n.points)}
    rows = rows.withColumns(outcome)
    have = set(rows.columns)
    kinds = dict(history.dtypes)
    return rows.select(
        *[
            (F.col(c) if c in have else F.lit(None).cast(kinds[c])).alias(c)
            for c in history.columns
        ]
    )


def materialise(
    events: DataFrame,
    roster: DataFrame,
    quali: DataFrame,
    history: DataFrame,
    standings: DataFrame,
    group_standings: DataFrame,
    conditions: DataFrame,
    n: Names = CONTEST,
) -> DataFrame:
    """Feature rows of the next event: the same plan on history and its entrants.

    ``events`` names one event, the next one: rows of several would enter each
    other's history as placeholders.
    """
    if events.select(n.event).distinct().limit(2).count() != 1:
        raise MaterialiseError("exactly one event can be materialised")
    if not checked_join(history, events.select(n.event), [n.event], "left_semi").isEmpty():
        raise MaterialiseError("the event already has results")
    rows = synthetic_rows(events, roster, quali, history, n)
    if rows.isEmpty():
        raise MaterialiseError("the event has no entrants")
    built = build_features(
        aligned_union(history, rows), standings, group_standings, conditions, n
    )
    return checked_join(built, events.select(n.event), [n.event], "left_semi").drop(n.winner)


def as_materialised(facts: DataFrame, n: Names = CONTEST) -> DataFrame:
    """Facts as they would stand before each event, for all events at once.

    Features read earlier rows only, so a batch row differs from the row
    materialised before its event in one input: the grid was not known yet.
    """
    return facts.withColumn(n.grid, F.col(n.quali))
