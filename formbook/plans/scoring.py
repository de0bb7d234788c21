"""Scores to shares and ranks, what-if fields and the pole rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formbook.operators.hot import rank_within
from formbook.operators.joins import checked_join, join_back


class ScoringInputError(ValueError):
    """A frame that cannot be scored."""


def pole_probability(grid_adjusted="grid_adjusted") -> Column:
    """1.0 for the entrant starting first; unknown grids get 0.0."""
    g = F.col(grid_adjusted) if isinstance(grid_adjusted, str) else grid_adjusted
    return F.coalesce((g == 1).cast("double"), F.lit(0.0))


def with_share(df: DataFrame, raw: str, out: str, by: Sequence[str] = ("event_id",)) -> DataFrame:
    """``raw`` over its event total; an event without any gets equal shares."""
    totals = join_back(
        df, list(by), F.sum(raw).alias("_total"), F.count(F.lit(1)).alias("_field")
    )
    share = F.when(F.col("_total") <= 0, 1.0 / F.col("_field")).otherwise(
        F.try_divide(raw, "_total")
    )
    return totals.withColumn(out, share).drop("_total", "_field")


def ranked_by_share(
    df: DataFrame,
    share: str,
    by: Sequence[str] = ("event_id",),
    entity: str = "entity_id",
    out: str = "predicted_rank",
) -> DataFrame:
    """1 for the largest share; the smaller entity id goes first among equals."""
    return rank_within(df, list(by), [(share, False), (entity, True)], out)


def score(
    df: DataFrame, raw: Column, by: Sequence[str] = ("event_id",), entity: str = "entity_id"
) -> DataFrame:
    """Add raw probability, share of the event and rank in the event."""
    out = with_share(
        df.withColumn("win_probability_raw", raw), "win_probability_raw", "win_probability", by
    )
    return ranked_by_share(out, "win_probability", by, entity)


def check_scoring_input(
    df: DataFrame, columns: Sequence[str], event: str = "event_id", entity: str = "entity_id"
) -> DataFrame:
    """Counts of what makes ``df`` unfit for scoring, one row."""
    missing = [c for c in [event, *columns] if c not in df.columns]
    if missing:
        raise ScoringInputError(f"missing columns {missing}")
    pairs = df.groupBy(event, entity).agg(F.count(F.lit(1)).alias("_n"))
    return pairs.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col(event).isNull(), F.col("_n"))), F.lit(0)).alias(
            "null_events"
        ),
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n") - 1)), F.lit(0)).alias(
            "repeated_rows"
        ),
    )


def require_scoring_input(
    df: DataFrame, columns: Sequence[str], event: str = "event_id", entity: str = "entity_id"
) -> None:
    """Raise where ``check_scoring_input`` counts anything but rows."""
    found = check_scoring_input(df, columns, event, entity).first().asDict()
    bad = {k: n for k, n in found.items() if k != "rows" and n}
    if bad:
        raise ScoringInputError(f"unfit for scoring: {bad}")


def what_if(
    df: DataFrame,
    changes: DataFrame,
    rescored: Column,
    by: Sequence[str] = ("event_id",),
    entity: str = "entity_id",
) -> DataFrame:
    """Re-score fields in which one entrant starts elsewhere.

    ``changes`` holds ``(event, entity, new_grid)``, one row per event; 0 means
    the pit lane. ``df`` carries ``grid_adjusted``, ``grid_position_norm``,
    ``pit_lane_start`` and ``field_size``; ``rescored`` reads those columns.
    Only events named in ``changes`` come back, every entrant with its share in
    the real and the changed field.
    """
    bad = changes.join(df.select(*by, entity, "field_size"), [*by, entity], "left").where(
        F.col("field_size").isNull()
        | (F.col("new_grid") < 0)
        | (F.col("new_grid") > F.col("field_size"))
    )
    sample = bad.limit(5).collect()
    if sample:
        raise ScoringInputError(f"grid outside the field: {[tuple(r) for r in sample]}")
    named = changes.select(*by).distinct()
    field = checked_join(df, named, by, "left_semi")
    real = with_share(field.withColumn("_raw", rescored), "_raw", "real_share", by).drop("_raw")
    changed = checked_join(real, changes, [*by, entity], "left")
    g = F.col("new_grid")
    moved = changed.withColumns(
        {
            "pit_lane_start": F.when(g.isNotNull(), g == 0).otherwise(F.col("pit_lane_start")),
            # The pit lane is one past the field; its norm is pinned to 1 here.
            "grid_adjusted": F.when(g == 0, F.col("field_size") + 1)
            .when(g.isNotNull(), g)
            .otherwise(F.col("grid_adjusted"))
            .cast("double"),
            "grid_position_norm": F.when(g == 0, F.lit(1.0))
            .when(g.isNotNull(), F.try_divide(g.cast("double"), "field_size"))
            .otherwise(F.col("grid_position_norm")),
        }
    )
    shared = with_share(moved.withColumn("_raw", rescored), "_raw", "simulated_share", by)
    return ranked_by_share(shared, "simulated_share", by, entity, "simulated_rank").drop("_raw")


def what_if_each(
    df: DataFrame, raw: Column, changed_raw: Column, by: Sequence[str] = ("event_id",)
) -> DataFrame:
    """Every entrant moved alone: real and simulated share of the moved one.

    The rest of the field keeps its scores, so the changed total is the old one
    minus the entrant's old score plus its new score. One aggregate per event
    stands for all n fields of n entrants.
    """
    base = df.withColumns({"_raw": raw, "_new": changed_raw})
    totals = join_back(
        base, list(by), F.sum("_raw").alias("_total"), F.count(F.lit(1)).alias("_field")
    )
    new_total = F.col("_total") - F.col("_raw") + F.col("_new")

    def share(p: str, total: Column) -> Column:
        return F.when(total <= 0, 1.0 / F.col("_field")).otherwise(F.try_divide(F.col(p), total))

    return totals.withColumns(
        {
            "real_share": share("_raw", F.col("_total")),
            "simulated_share": share("_new", new_total),
        }
    ).drop("_raw", "_new", "_total", "_field")
