"""Ranking and calibration metrics of scored events.

A scored frame has one row per entrant: the keys, ``y`` (0/1), ``p`` and, for
the rank correlation, ``order`` (the actual finishing order). Every metric is a
grouped aggregate over any set of keys, so models, folds and seasons are
evaluated in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formbook.operators.hot import average_rank, has_hot, tie_rank
from formbook.operators.joins import join_back

# --- fixed values --------------------------------------------------------------
CALIBRATION_BINS = 10
LOG_EPS = 2.220446049250313e-16
TOP1_ALARM = 0.70
# ------------------------------------------------------------------------------


def as_scored(
    df: DataFrame, p: str, y: str = "winner", order: str | None = "finish_order", *keys: str
) -> DataFrame:
    keep = [F.col(k) for k in (keys or ("event_id",))]
    out = [F.col(y).alias("y"), F.col(p).alias("p")]
    return df.select(*keep, *out, *([F.col(order).alias("order")] if order else []))


def input_problems(scored: DataFrame, event: str = "event_id") -> DataFrame:
    """Counts of what makes ``scored`` unfit for evaluation, one row."""
    per_event = scored.groupBy(event).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("p").isNull() | F.isnan("p")).alias("no_p"),
        F.count_if((F.col("p") < 0) | (F.col("p") > 1)).alias("outside"),
        F.count_if(F.col("y").isNull() | ~F.col("y").isin(0, 1)).alias("not_binary"),
        F.sum("y").alias("winners"),
    )
    return per_event.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("no_p"), F.lit(0)).alias("missing_p"),
        F.coalesce(F.sum("outside"), F.lit(0)).alias("p_outside_unit"),
        F.coalesce(F.sum("not_binary"), F.lit(0)).alias("y_not_binary"),
        F.count_if(F.coalesce(F.col("winners"), F.lit(0)) != 1).alias("events_without_one_winner"),
    )


def require_evaluation_input(scored: DataFrame, event: str = "event_id") -> None:
    """Raise where ``scored`` has any of ``input_problems``."""
    found = input_problems(scored, event).first().asDict()
    bad = {k: n for k, n in found.items() if k != "rows" and n}
    if bad:
        raise EvaluationError(f"unfit for evaluation: {bad}")


def spearman(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rank correlation of -p with the finishing order; NULL when degenerate."""
    # NULL orders leave the pair out.
    pairs = scored.where(F.col("order").isNotNull()).select(
        *by, (-F.col("p")).alias("_np"), F.col("order").alias("_o")
    )
    ranked = average_rank(average_rank(pairs, by, "_np", "_a"), by, "_o", "_b")
    return ranked.groupBy(*by).agg(_rank_correlation())


def _rank_correlation() -> Column:
    return F.try_divide(
        F.covar_pop("_a", "_b"), F.stddev_pop("_a") * F.stddev_pop("_b")
    ).alias("spearman_corr")


def per_event_metrics(scored: DataFrame, by: Sequence[str] = ("event_id",)) -> DataFrame:
    """One row per event. Ties count against the winner: its rank is the number
    of entrants with a probability at least as large as its own.

    Events that fit a task take one shuffle for the ranks, the winner's
    probability and the aggregate; larger ones go through split ranks and an
    aggregate joined back.
    """
    by = list(by)
    ordered = "order" in scored.columns
    winner_p = F.when(F.col("y") == 1, F.col("p"))
    aggs = [
        F.count(F.lit(1)).alias("n_entrants"),
        F.max("_pw").alias("winner_prob"),
        F.count_if(F.col("p") >= F.col("_pw")).alias("winner_rank"),
        F.max("p").alias("max_prob"),
    ]
    if has_hot(scored, by):
        marked = join_back(scored, by, F.max(winner_p).alias("_pw"))
        table = marked.groupBy(*by).agg(*aggs)
        if ordered:
            table = table.join(spearman(scored, by), by, "left")
    else:
        marked = scored.withColumn("_pw", F.max(winner_p).over(Window.partitionBy(*by)))
        if ordered:
            # Rows without an order are ranked apart, then left out.
            there = F.col("order").isNotNull()
            marked = marked.withColumns({"_np": -F.col("p"), "_there": there})
            known = [*by, "_there"]
            marked = marked.withColumns(
                {
                    "_a": F.when(there, tie_rank(known, "_np")),
                    "_b": F.when(there, tie_rank(known, "order")),
                }
            )
            aggs.append(_rank_correlation())
        table = marked.groupBy(*by).agg(*aggs)
    return table.withColumns(
        {
            "top1_hit": F.col("winner_rank") == 1,
            "top3_hit": F.col("winner_rank") <= 3,
            "reciprocal_rank": 1.0 / F.col("winner_rank"),
        }
    )


def winner_rank_counts(per_event: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return per_event.groupBy(*keys, "winner_rank").agg(F.count(F.lit(1)).alias("events"))


def row_losses(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Log-loss and Brier score over rows."""
    return scored.groupBy(*keys).agg(
        F.avg(_log_loss()).alias("log_loss"),
        F.avg(_squared_error()).alias("brier_score"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def _log_loss() -> Column:
    p = F.greatest(F.lit(LOG_EPS), F.least(F.lit(1 - LOG_EPS), F.col("p")))
    loss = -F.when(F.col("y") == 1, F.ln(p)).otherwise(F.ln(1 - p))
    return F.when(F.col("p").isNotNull(), loss)


def _squared_error() -> Column:
    return F.pow(F.col("p") - F.col("y"), 2)


def row_quality(
    scored: DataFrame, n_bins: int = CALIBRATION_BINS, keys: Sequence[str] = ()
) -> DataFrame:
    """``row_losses`` and ``ece`` in one pass: sums per bin, then over bins."""
    bins = (
        scored.withColumn("bin", probability_bin(F.col("p"), n_bins))
        .groupBy(*keys, "bin")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum("p").alias("_p"),
            F.sum("y").alias("_y"),
            F.sum(_log_loss()).alias("_l"),
            F.sum(_squared_error()).alias("_s"),
        )
    )
    return bins.groupBy(*keys).agg(
        F.try_divide(F.sum("_l"), F.sum("_n")).alias("log_loss"),
        F.try_divide(F.sum("_s"), F.sum("_n")).alias("brier_score"),
        F.sum("_n").alias("n_rows"),
        F.try_divide(F.sum(F.abs(F.col("_y") - F.col("_p"))), F.sum("_n")).alias("ece"),
    )


def probability_bin(p: Column, n_bins: int) -> Column:
    """Right-closed equal bins over [0, 1]; 0 falls into the first."""
    width = 1.0 / n_bins
    out = F.when(p <= width, 0)
    for i in range(1, n_bins - 1):
        out = out.when(p <= (i + 1) * width, i)
    return out.otherwise(n_bins - 1)


def calibration_table(
    scored: DataFrame, n_bins: int = CALIBRATION_BINS, keys: Sequence[str] = ()
) -> DataFrame:
    width = 1.0 / n_bins
    binned = scored.withColumn("bin", probability_bin(F.col("p"), n_bins))
    return (
        binned.groupBy(*keys, "bin")
        .agg(
            F.avg("p").alias("mean_predicted"),
            F.avg("y").alias("fraction_positive"),
            F.count(F.lit(1)).alias("count"),
        )
        .withColumns(
            {"bin_lower": F.col("bin") * width, "bin_upper": (F.col("bin") + 1) * width}
        )
        .select(
            *keys, "bin_lower", "bin_upper", "mean_predicted", "fraction_positive", "count"
        )
    )


def ece(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Count-weighted mean gap between predicted and observed, per keys."""
    gap = F.abs(F.col("fraction_positive") - F.col("mean_predicted"))
    return table.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("count") * gap), F.sum("count")).alias("ece")
    )


def event_averages(per_event: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    aggs = [
        F.avg(F.col("top1_hit").cast("double")).alias("top1_accuracy"),
        F.avg(F.col("top3_hit").cast("double")).alias("top3_recall"),
        F.avg("reciprocal_rank").alias("winner_mrr"),
        F.avg("winner_prob").alias("avg_winner_probability"),
        F.median("winner_rank").alias("median_winner_rank"),
        F.count(F.lit(1)).alias("n_events"),
    ]
    if "spearman_corr" in per_event.columns:
        aggs.append(F.avg("spearman_corr").alias("spearman_corr"))
    return per_event.groupBy(*keys).agg(*aggs)


def metrics(
    scored: DataFrame, keys: Sequence[str] = (), event: str = "event_id"
) -> DataFrame:
    """The full metric row per ``keys`` (one row when there are none)."""
    keys = list(keys)
    tagged = scored if keys else scored.withColumn("_all", F.lit(1))
    by = keys or ["_all"]
    head = event_averages(per_event_metrics(tagged, [*by, event]), by)
    out = head.join(row_quality(tagged, keys=by), by)
    out = out.withColumn("leakage_alarm", F.col("top1_accuracy") > TOP1_ALARM)
    return out if keys else out.drop("_all")


class EvaluationError(ValueError):
    """Input that breaks the evaluation contract."""


def metrics_by_season(
    scored: DataFrame, season: str = "season", event: str = "event_id"
) -> DataFrame:
    spread = scored.groupBy(event).agg(F.count_distinct(season).alias("n")).where("n > 1")
    if not spread.isEmpty():
        raise EvaluationError("an event spans several seasons")
    return metrics(scored, [season], event)


def compare_models(
    model: DataFrame, baseline: DataFrame, by: Sequence[str] = ("event_id",)
) -> DataFrame:
    """Per event: did the first pick of each model win?"""

    def first(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*by).agg(
            F.max(F.when(F.col("predicted_rank") == 1, F.col("entity_id"))).alias(f"{name}_pick"),
            F.max(F.when(F.col("winner") == 1, F.col("entity_id"))).alias("_w"),
        )

    both = first(model, "model").join(first(baseline, "baseline").drop("_w"), list(by))
    return both.select(
        *by,
        F.col("_w").alias("winner_id"),
        "model_pick",
        "baseline_pick",
        (F.col("_w") == F.col("model_pick")).alias("model_top1_hit"),
        (F.col("_w") == F.col("baseline_pick")).alias("baseline_top1_hit"),
    )
