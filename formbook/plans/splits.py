"""Season windows: eras, train/validation/test splits and expanding folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formbook.operators.joins import within_windows

# --- fixed values --------------------------------------------------------------
RACING_ERAS = (
    ("v8", 2010, 2013),
    ("hybrid", 2014, 2021),
    ("ground_effect", 2022, 2025),
    ("future_engine", 2026, None),
)
HOLDOUT_FROM = 2025
DEFAULT_FOLDS = 6
# Eras of the contest facts.
ERAS = (("first", 1995, 1996), ("second", 1997, 1998), ("third", 1999, 2000), ("open", 2001, None))
# ------------------------------------------------------------------------------


class SplitError(ValueError):
    """A split that would leak, overlap or be empty."""


@dataclass(frozen=True)
class Split:
    """Inclusive season windows of one strategy."""

    name: str
    train: tuple[int, int]
    val: tuple[int, int]
    test: tuple[int, int]
    folds: int = 1
    holdout_ok: bool = False
    holdout_from: int = HOLDOUT_FROM

    def __post_init__(self):
        for role, (lo, hi) in self.roles():
            if lo > hi:
                raise SplitError(f"{self.name}: {role} window {lo}-{hi} is inverted")
        if not (self.train[1] < self.val[0] and self.val[1] < self.test[0]):
            raise SplitError(f"{self.name}: windows overlap or are out of order")
        if self.test[1] >= self.holdout_from and not self.holdout_ok:
            raise SplitError(f"{self.name}: reaches the holdout without opting in")
        if self.folds < 1:
            raise SplitError(f"{self.name}: needs at least one fold")

    def roles(self) -> list[tuple[str, tuple[int, int]]]:
        return [("train", self.train), ("val", self.val), ("test", self.test)]


def era_split(
    era: tuple, val: int = 1, test: int = 1, folds: int | None = None, name: str | None = None,
    **options,
) -> Split:
    """The last seasons of a closed era validate and test, the others train."""
    label, lo, hi = era
    if hi is None:
        raise SplitError(f"era {label} is still open")
    if val < 1 or test < 1:
        raise SplitError("validation and test need a season each")
    last = hi - val - test
    seasons = last - lo + 1
    if seasons < 2:
        raise SplitError(f"era {label} leaves {max(seasons, 0)} training seasons, two are needed")
    return Split(
        name or f"{label}_within_era",
        (lo, last),
        (last + 1, last + val),
        (hi - test + 1, hi),
        folds if folds is not None else min(DEFAULT_FOLDS, seasons - 1),
        **options,
    )


def rolling_split(
    test_from: int, train: int = 5, val: int = 1, test: int = 1, name: str | None = None, **options
) -> Split:
    """Windows counted back from the first test season."""
    if train < 2 or val < 1 or test < 1:
        raise SplitError("rolling windows need two training seasons and one of each other")
    val_from = test_from - val
    return Split(
        name or f"rolling_{train}_{val}_{test}_test{test_from}",
        (val_from - train, val_from - 1),
        (val_from, test_from - 1),
        (test_from, test_from + test - 1),
        min(DEFAULT_FOLDS, train - 1),
        **options,
    )


def presets() -> dict[str, Split]:
    by_name = {e[0]: e for e in RACING_ERAS}
    made = (
        Split("historical", (2010, 2021), (2022, 2023), (2024, 2024), DEFAULT_FOLDS),
        era_split(by_name["hybrid"], folds=3, name="hybrid_era"),
        era_split(by_name["ground_effect"], name="ground_effect", holdout_ok=True),
    )
    return {s.name: s for s in made}


def window_rows(splits: Sequence[Split]) -> list[tuple]:
    return [(s.name, role, lo, hi) for s in splits for role, (lo, hi) in s.roles()]


def label_split(df: DataFrame, splits: Sequence[Split], season: str = "season") -> DataFrame:
    """Rows with ``strategy`` and ``role``, for all strategies in one pass."""
    return within_windows(df, season, window_rows(splits), ["strategy", "role"]).drop("lo", "hi")


def role_of(split: Split, season: str = "season") -> Column:
    """``train``/``val``/``test`` for one strategy, NULL outside its windows."""
    out = None
    for role, (lo, hi) in split.roles():
        hit = F.col(season).between(lo, hi)
        out = F.when(hit, role) if out is None else out.when(hit, role)
    return out


def split_sizes(
    df: DataFrame, splits: Sequence[Split], event: str = "event_id", season: str = "season",
    target: str = "winner",
) -> DataFrame:
    """Events, rows, winners and class balance per strategy and role.

    Rows are counted per season first; only that small table meets the windows.
    """
    seasons = df.groupBy(season).agg(
        F.count_distinct(event).alias("events"),
        F.count(F.lit(1)).alias("rows"),
        F.sum(target).alias("winners"),
    )
    sizes = (
        label_split(seasons, splits, season)
        .groupBy("strategy", "role")
        .agg(*[F.sum(c).alias(c) for c in ("events", "rows", "winners")])
    )
    return sizes.withColumns(
        {
            "win_rate": F.try_divide("winners", "rows"),
            "negatives_per_positive": F.try_divide(F.col("rows") - F.col("winners"), "winners"),
        }
    )


def shared_events(
    df: DataFrame, splits: Sequence[Split], event: str = "event_id", season: str = "season"
) -> DataFrame:
    """Events found in more than one role of a strategy; empty for a sound split."""
    return (
        label_split(df.select(event, season).distinct(), splits, season)
        .groupBy("strategy", event)
        .agg(F.count_distinct("role").alias("roles"))
        .where("roles > 1")
    )


def checked_split(
    df: DataFrame, split: Split, event: str = "event_id", season: str = "season"
) -> DataFrame:
    """``df`` inside the windows with its ``role``; raises on an unsound split."""
    sizes = {r["role"]: r["rows"] for r in split_sizes(df, [split], event, season).collect()}
    empty = [role for role, _ in split.roles() if not sizes.get(role)]
    if empty:
        raise SplitError(f"{split.name}: no rows for {empty}")
    if not shared_events(df, [split], event, season).isEmpty():
        raise SplitError(f"{split.name}: an event appears in two roles")
    return df.withColumn("role", role_of(split, season)).where(F.col("role").isNotNull())


def fold_seasons(train: DataFrame, folds: int, season: str = "season") -> list[int]:
    """The last ``folds`` seasons; each validates once."""
    seasons = sorted(r[0] for r in train.select(season).distinct().collect())
    if folds < 1 or folds >= len(seasons):
        raise SplitError(f"{folds} folds from {len(seasons)} training seasons")
    return seasons[-folds:]


def label_folds(
    train: DataFrame, folds: int, season: str = "season", window: tuple[int, int] | None = None
) -> DataFrame:
    """Rows with ``fold``, ``val_season`` and ``role``: earlier seasons train.

    A row repeats once per fold it takes part in, so all folds are one frame.
    """
    if window is not None:
        beyond = train.where(~F.col(season).between(*window))
        if not beyond.isEmpty():
            raise SplitError(f"rows outside the training window {window}")
    windows = []
    for i, year in enumerate(fold_seasons(train, folds, season), start=1):
        windows.append((i, year, "train", -(10**9), year - 1))
        windows.append((i, year, "val", year, year))
    out = within_windows(train, season, windows, ["fold", "val_season", "role"])
    return out.withColumns({c: F.col(c).cast("long") for c in ("fold", "val_season")}).drop(
        "lo", "hi"
    )
