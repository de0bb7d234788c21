"""Model fitting with MLlib: preprocessing, candidates, folds, calibration.

Fitted scalars (medians, means, weights) are the only values that reach the
driver; fits and scores are distributed jobs over stored rows.
"""

from __future__ import annotations

import json
import math
import random
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.common import _py2java
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formbook.functions.scalars import clip_probability
from formbook.operators.columns import counted, profile
from formbook.operators.hot import with_prefix
from formbook.operators.logistic import Design, FitError, newton_logistic, swapped_maxima
from formbook.operators.permute import numbered, permuted
from formbook.operators.pooling import pooled_blocks
from formbook.operators.setops import concat
from formbook.plans import metrics as M
from formbook.plans.scoring import pole_probability
from formbook.plans.splits import fold_seasons

# --- fixed values --------------------------------------------------------------
SEED = 42
SEARCH_RANGES = {
    "logreg": {"C": ("log", 1e-3, 10.0)},
    "random_forest": {
        "numTrees": ("int", 200, 800),
        "maxDepth": ("int", 4, 16),
        "minInstancesPerNode": ("int", 1, 10),
        "featureSubsetStrategy": ("share", 0.3, 1.0),
    },
    "boosted_trees": {
        "maxIter": ("int", 150, 800),
        "stepSize": ("log", 0.01, 0.2),
        "maxDepth": ("int", 3, 8),
        "minInstancesPerNode": ("int", 1, 8),
        "subsamplingRate": ("uniform", 0.6, 1.0),
        "featureSubsetStrategy": ("share", 0.6, 1.0),
    },
}
DEFAULTS = {
    "logreg": {"C": 1.0, "maxIter": 2000, "tol": 1e-4},
    "random_forest": {"numTrees": 400, "minInstancesPerNode": 3, "maxDepth": 30},
    "boosted_trees": {
        "maxIter": 400, "stepSize": 0.05, "maxDepth": 5, "minInstancesPerNode": 2,
        "subsamplingRate": 0.9, "featureSubsetStrategy": "0.9",
    },
}
PERMUTATION_REPEATS = 5
PARALLEL_FITS = 4
# Rank error of the approximate quantiles around a median: rows divided by this.
MEDIAN_ACCURACY = 10_000
# ------------------------------------------------------------------------------


class ModelSchemaError(ValueError):
    """A frame lacks columns a model was trained on."""


class TrainingError(ValueError):
    """Training data no model can be fitted to."""


def design_matrix(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Keys and the model columns in order, every column as double."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ModelSchemaError(f"missing feature columns {missing}")
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])


# Preprocessing -----------------------------------------------------------------


def class_balance(df: DataFrame, target: str = "winner") -> DataFrame:
    """Rows, positives, weight of a positive and the two balanced class weights."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.sum(target).cast("double").alias("pos"))
    neg = F.col("n") - F.col("pos")
    return counts.select(
        "n",
        F.col("pos").cast("long").alias("positives"),
        F.try_divide(neg, "pos").alias("pos_weight"),
        F.try_divide(F.col("n"), 2 * neg).alias("weight_0"),
        F.try_divide(F.col("n"), 2 * F.col("pos")).alias("weight_1"),
    )


def _cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value): rows that only ever meet an aggregate that is combined before its
    shuffle."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]
    return df.select(F.inline(F.array(*cells)))


def _per_column(df: DataFrame, columns: Sequence[str], aggs: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(feature, aggregates): what is shuffled is one row per task and feature."""
    value = F.col("value")
    return _cells(df, columns).groupBy("feature").agg(*[agg(value).alias(name) for name, agg in aggs.items()])


MOMENTS = {
    "n": lambda v: F.count(F.lit(1)),
    "there": F.count,
    "mean": F.avg,
    "var": F.var_pop,
}
# The bracket lies this many approximation errors around the middle.
BRACKET = 2 / MEDIAN_ACCURACY
BRACKETS = {"ends": lambda v: F.percentile_approx(v, [0.5 - BRACKET, 0.5 + BRACKET], MEDIAN_ACCURACY)}


def column_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, n, there, mean, var): rows, non-null values and their moments."""
    return _per_column(df, columns, MOMENTS)


def exact_medians(df: DataFrame, columns: Sequence[str], brackets: dict | None = None) -> DataFrame:
    """(feature, median) over non-null values, exact at any number of distinct ones.

    A first pass finds a narrow bracket around each middle by approximate quantiles; a
    second counts the values below it and, one by one, those inside. Only values inside
    are shuffled, counted before, and put in order. A column whose middle proves to lie
    outside its bracket is looked for among all its values. ``brackets`` ({feature:
    (lo, hi, values that are there)}, from ``profile`` for many columns) saves the first pass.
    """
    columns = list(columns)
    if brackets is None:
        rows = _per_column(df, columns, {"there": F.count, **BRACKETS}).collect()
        brackets = {r["feature"]: (*(r["ends"] or (None, None)), r["there"]) for r in rows}
    known = [c for c in columns if brackets[c][2]]
    if not known:
        return df.sparkSession.createDataFrame([], "feature string, median double")
    spark = df.sparkSession
    medians, left = _middles(spark, counted(df, {c: brackets[c][:2] for c in known}), {c: brackets[c][2] for c in known})
    if left:
        every = counted(df, {c: (float("-inf"), float("nan")) for c in left})
        medians = medians.unionByName(_middles(spark, every, {c: brackets[c][2] for c in left})[0])
    return medians


def _middles(spark: SparkSession, counts: DataFrame, total: dict[str, int]) -> tuple[DataFrame, list[str]]:
    """(feature, median) of the columns whose two middle places lie among the values that
    were ``counted``, and the other columns; NaN sorts above all numbers."""
    below = {r["feature"]: r["n"] for r in counts.where("value IS NULL").collect()}
    facts = F.create_map(*[F.lit(x) for c in total for x in (c, total[c])])
    least = F.create_map(*[F.lit(x) for c in total for x in (c, below.get(c, 0))])
    running = with_prefix(counts.where("value IS NOT NULL"), ["feature"], [("value", True)], {"_upto": F.col("n")})
    placed = running.withColumns({"_total": facts[F.col("feature")], "_upto": F.col("_upto") + least[F.col("feature")]})
    lower, upper = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1

    def at(rank: Column) -> Column:
        return F.min(F.when((F.col("_upto") - F.col("n") < rank) & (rank <= F.col("_upto")), F.col("value")))

    both = placed.groupBy("feature").agg(at(lower).alias("_a"), at(upper).alias("_b")).where("_a IS NOT NULL AND _b IS NOT NULL")
    # One row per column.
    found = {r["feature"]: (r["_a"] + r["_b"]) / 2 for r in both.collect()}
    cells = [F.struct(F.lit(c).alias("feature"), F.lit(m).alias("median")) for c, m in found.items()]
    made = spark.range(1).select(F.inline(F.array(*cells))) if cells else spark.createDataFrame([], "feature string, median double")
    return made, [c for c in total if c not in found]


@dataclass
class Preprocess:
    """Imputation and scaling learnt on training rows only."""

    columns: list[str]
    medians: dict[str, float]
    flagged: list[str]
    means: dict[str, float] = field(default_factory=dict)
    stds: dict[str, float] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [*self.columns, *[f"{c}_missing" for c in self.flagged]]

    def inputs(self) -> dict[str, Column]:
        """Imputed columns and missing flags, before scaling."""
        out = {
            c: F.coalesce(F.col(c).cast("double"), F.lit(self.medians.get(c, 0.0)))
            for c in self.columns
        }
        for c in self.flagged:
            out[f"{c}_missing"] = F.col(c).isNull().cast("double")
        return out

    def expressions(self) -> dict[str, Column]:
        if not self.means:
            return self.inputs()
        return {n: (v - self.means[n]) / self.stds[n] for n, v in self.inputs().items()}

    def design(self) -> Design:
        """The same inputs for functions over Arrow batches."""
        names = self.names
        return Design(
            tuple(self.columns), tuple(self.medians.get(c, 0.0) for c in self.columns), tuple(self.flagged),
            tuple(self.means.get(n, 0.0) for n in names), tuple(self.stds.get(n, 1.0) for n in names),
        )

    def assemble(self, df: DataFrame, out: str = "_features") -> DataFrame:
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            raise ModelSchemaError(f"missing feature columns {missing}")
        made = df.select("*", *[v.alias(f"_x_{n}") for n, v in self.expressions().items()])
        names = [f"_x_{n}" for n in self.names]
        return VectorAssembler(inputCols=names, outputCol=out).transform(made).drop(*names)


def fit_preprocess(train: DataFrame, columns: Sequence[str], scale: bool) -> Preprocess:
    """Medians, flags and (for scaling) mean and population deviation per input.

    The moments of an imputed column follow from those of its values and the
    number of gaps the median fills, so no second pass reads the imputed rows.
    """
    columns = list(columns)
    moments, brackets = profile(train, columns)
    medians = {r["feature"]: r["median"] for r in exact_medians(train, columns, brackets).collect()}
    flagged = [c for c in columns if moments[c]["there"] < moments[c]["n"]]
    pre = Preprocess(columns, medians, flagged)
    if not scale:
        return pre
    for c in columns:
        n, there = moments[c]["n"], moments[c]["there"]
        gaps, fill = n - there, medians.get(c, 0.0)
        mean = ((moments[c]["mean"] or 0.0) * there + fill * gaps) / n
        spread = gaps * (fill - mean) ** 2
        if there:
            spread += there * (moments[c]["var"] + (moments[c]["mean"] - mean) ** 2)
        pre.means[c], pre.stds[c] = mean, math.sqrt(spread / n) or 1.0
        if c in flagged:
            share = gaps / n
            pre.means[f"{c}_missing"] = share
            pre.stds[f"{c}_missing"] = math.sqrt(share * (1 - share)) or 1.0
    return pre


# Candidates --------------------------------------------------------------------


@dataclass
class Fitted:
    """A fitted candidate: scores any frame that has its columns."""

    name: str
    columns: list[str]
    pre: Preprocess | None = None
    model: object | None = None
    calibrator: object | None = None

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        """Add the raw win probability of every row."""
        if self.model is None:
            missing = [c for c in self.columns if c not in df.columns]
            if missing:
                raise ModelSchemaError(f"missing feature columns {missing}")
            scored = df.withColumn(out, pole_probability("grid_adjusted"))
        else:
            made = self.model.transform(self.pre.assemble(df))
            scored = made.withColumn(out, vector_to_array("_probability")[1]).drop(
                "_features", "_raw", "_probability", "_prediction"
            )
        if self.calibrator is None:
            return scored
        mapped = self.calibrator.transform(scored.withColumn("_p", F.col(out)))
        return mapped.withColumn(out, clip_probability("_calibrated")).drop("_p", "_calibrated")

    def swaps(self, columns: Sequence[str]) -> bool:
        """Can ``swapped`` score rows with one of these columns from a donor?"""
        plain = isinstance(self.model, LogisticRegressionModel) and self.calibrator is None
        return plain and set(columns) <= set(self.columns)

    def swapped(self, met: DataFrame, columns: Sequence[str], target: str, keys: Sequence[str]) -> DataFrame:
        """The largest probabilities of winners and others per keys and feature (``swapped_maxima``)."""
        weights = np.append(self.model.coefficients.toArray(), self.model.intercept)
        return swapped_maxima(met, self.pre.design(), weights, columns, target, keys)


def _weighted(train: DataFrame, target: str, positives_only: bool) -> tuple[DataFrame, float]:
    """Class-weighted rows and the sum of weights."""
    balance = class_balance(train, target).first()
    if not balance["positives"]:
        raise TrainingError("no positive rows to learn from")
    if positives_only:
        low, high = 1.0, balance["pos_weight"]
    else:
        low, high = balance["weight_0"], balance["weight_1"]
    pos = balance["positives"]
    weight = F.when(F.col(target) == 1, F.lit(high)).otherwise(F.lit(low))
    total = high * pos + low * (balance["n"] - pos)
    return train.withColumns({"_w": weight, "_y": F.col(target).cast("double")}), total


def _columns_of_model() -> dict:
    return {
        "featuresCol": "_features", "labelCol": "_y", "weightCol": "_w",
        "probabilityCol": "_probability", "predictionCol": "_prediction", "rawPredictionCol": "_raw",
    }


@dataclass
class Prepared:
    """Weighted rows, their weight total and the preprocessing: the same for every
    configuration of a candidate, so a search makes them once a fold."""

    rows: DataFrame
    total: float
    pre: Preprocess
    # Weights of a logistic fit by (C, maxIter, tol).
    solved: dict[tuple, np.ndarray] = field(default_factory=dict)

    def solve(self, configs: Sequence[dict]) -> list[np.ndarray]:
        """Weights (inputs, then intercept) of logistic fits, found in shared passes."""
        keys = [(p["C"], p["maxIter"], p["tol"]) for p in ({**DEFAULTS["logreg"], **c} for c in configs)]
        for most, tol in dict.fromkeys(k[1:] for k in keys):
            # The penalty is stated per weight unit, so C divides by the weight total.
            new = [c for c, *rest in dict.fromkeys(keys) if rest == [most, tol] and (c, most, tol) not in self.solved]
            if not new:
                continue
            penalties = [1.0 / (c * self.total) for c in new]
            try:
                found = newton_logistic(self.rows, self.pre.design(), penalties, self.total, "_y", "_w", most, tol)
            except FitError as e:
                raise TrainingError(f"no logistic fit: {e}") from e
            self.solved |= {(c, most, tol): weights for c, weights in zip(new, found)}
        return [self.solved[k] for k in keys]


def prepare(name: str, train: DataFrame, columns: Sequence[str], target: str = "winner") -> Prepared:
    weighted, total = _weighted(train, target, positives_only=name == "boosted_trees")
    return Prepared(weighted, total, fit_preprocess(train, columns, scale=name == "logreg"))


def _learnt(learner: RandomForestClassifier, ready: Prepared):
    """The learner's model of prepared rows, without its training summary.

    Tasks that score are sent the whole model. A summary holds the session, and no session
    can be sent once a write in it was observed (``quality.Observed``).
    """
    rows = ready.pre.assemble(ready.rows)
    model = learner.fit(rows)
    model._java_obj.setSummary(rows.sparkSession._jvm.scala.Option.empty())
    return model


def fit_pole(
    train: DataFrame, columns: Sequence[str], target: str, params: dict, ready: Prepared | None = None
) -> Fitted:
    return Fitted("pole_baseline", ["grid_adjusted"])


def fit_logreg(
    train: DataFrame, columns: Sequence[str], target: str, params: dict, ready: Prepared | None = None
) -> Fitted:
    """L2 logistic regression on imputed, flagged and scaled columns, as an MLlib model."""
    ready = ready or prepare("logreg", train, columns, target)
    weights = ready.solve([params])[0]
    spark = ready.rows.sparkSession
    uid = f"LogisticRegression_{uuid.uuid4().hex[:12]}"
    coefficients = _py2java(spark.sparkContext, Vectors.dense(weights[:-1]))
    made = spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(uid, coefficients, float(weights[-1]))
    model = LogisticRegressionModel(made)
    for name, value in _columns_of_model().items():
        model.set(model.getParam(name), value)
    return Fitted("logreg", list(columns), ready.pre, model)


def fit_random_forest(
    train: DataFrame, columns: Sequence[str], target: str, params: dict, ready: Prepared | None = None
) -> Fitted:
    ready = ready or prepare("random_forest", train, columns, target)
    learner = RandomForestClassifier(
        **_columns_of_model(), seed=SEED, **{**DEFAULTS["random_forest"], **params}
    )
    return Fitted("random_forest", list(columns), ready.pre, _learnt(learner, ready))


def fit_boosted(
    train: DataFrame, columns: Sequence[str], target: str, params: dict, ready: Prepared | None = None
) -> Fitted:
    """Boosted trees; MLlib has no branch for missing values, so flags stand in."""
    ready = ready or prepare("boosted_trees", train, columns, target)
    names = _columns_of_model()
    probability, raw = names.pop("probabilityCol"), names.pop("rawPredictionCol")
    learner = GBTClassifier(**names, seed=SEED, **{**DEFAULTS["boosted_trees"], **params})
    learner.setProbabilityCol(probability).setRawPredictionCol(raw)
    return Fitted("boosted_trees", list(columns), ready.pre, learner.fit(ready.pre.assemble(ready.rows)))


Fit = Callable[..., Fitted]

CANDIDATES: dict[str, Fit] = {
    "pole_baseline": fit_pole,
    "logreg": fit_logreg,
    "random_forest": fit_random_forest,
    "boosted_trees": fit_boosted,
}


def fit(
    name: str, train: DataFrame, columns: Sequence[str], target: str = "winner",
    params: dict | None = None, ready: Prepared | None = None,
) -> Fitted:
    if name not in CANDIDATES:
        raise KeyError(f"unknown model '{name}', known are {sorted(CANDIDATES)}")
    return CANDIDATES[name](train, columns, target, params or {}, ready)


# Folds, search, calibration ----------------------------------------------------


def out_of_fold(
    train: DataFrame,
    name: str,
    columns: Sequence[str],
    folds: int,
    target: str = "winner",
    params: dict | None = None,
    season: str = "season",
) -> DataFrame:
    """Rows of the held-out seasons with ``p`` from a model that never saw them.

    Each fit reads ``train`` several times: pass a stored table, best one
    partitioned by season, so that a fold reads its own seasons only.
    """
    parts = []
    for fold, year in enumerate(fold_seasons(train, folds, season), start=1):
        model = fit(name, train.where(F.col(season) < year), columns, target, params)
        held_out = train.where(F.col(season) == year).withColumns(
            {"fold": F.lit(fold).cast("long"), "val_season": F.lit(year).cast("long")}
        )
        parts.append(model.score(held_out))
    return concat(parts)


def cross_validate(
    train: DataFrame, name: str, columns: Sequence[str], folds: int, target: str = "winner",
    order: str | None = "finish_order", params: dict | None = None,
) -> DataFrame:
    """Metrics per fold, evaluated in one pass over all held-out rows."""
    scored = out_of_fold(train, name, columns, folds, target, params)
    frame = M.as_scored(scored, "p", target, order, "event_id", "fold", "val_season")
    return M.metrics(frame, ["fold", "val_season"])


FOLD_METRICS = (
    "top1_accuracy", "top3_recall", "winner_mrr", "avg_winner_probability", "median_winner_rank",
    "log_loss", "brier_score", "ece", "spearman_corr",
)


def fold_summary(folds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(metric, mean, std) over folds; the deviation is the population one."""
    names = [m for m in FOLD_METRICS if m in folds.columns]
    rows = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names]
    )
    return folds.select(*keys, F.inline(rows)).groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )


def draw_configs(name: str, n: int, seed: int = SEED) -> list[dict]:
    """``n`` seeded draws from the candidate's ranges."""
    if name not in SEARCH_RANGES:
        raise TrainingError(f"'{name}' has no ranges to search")
    if n < 1:
        raise TrainingError("a search needs at least one draw")
    rng = random.Random(seed)
    configs = []
    for _ in range(n):
        config = {}
        for param, (kind, lo, hi) in SEARCH_RANGES[name].items():
            if kind == "log":
                config[param] = math.exp(rng.uniform(math.log(lo), math.log(hi)))
            elif kind == "int":
                config[param] = rng.randrange(lo, hi)
            elif kind == "share":
                config[param] = f"{rng.uniform(lo, hi):.4f}"
            else:
                config[param] = rng.uniform(lo, hi)
        configs.append(config)
    return configs


def _at_once(spark: SparkSession, task: Callable, items: Sequence, parallel: int) -> list:
    """``task`` of every item, in order, ``parallel`` at a time, each in a pool of the
    fair scheduler; a small fit leaves most of a cluster idle."""

    def run(at: int):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{at % parallel}")
        return task(items[at])

    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(inheritable_thread_target(spark)(run), range(len(items))))


def search_folds(
    train: DataFrame, name: str, columns: Sequence[str], folds: int, n: int, target: str = "winner",
    seed: int = SEED, halving: int | None = None, parallel: int = PARALLEL_FITS, season: str = "season",
) -> list[tuple]:
    """(config, val_season, top-1, log-loss, events) of every draw and fold, as Python rows.

    Rows are prepared once a fold, and draws are fitted ``parallel`` at a time (logistic ones
    share every pass over the rows); one plan has the metrics of a fold's draws. With
    ``halving`` only the best 1 / ``halving`` of the draws (by means so far) go on from
    one fold to the next; folds come by season, so many draws meet few rows and few
    draws meet all. Without it every draw sees every fold.
    """
    alive = list(enumerate(draw_configs(name, n, seed)))
    rows: list[tuple] = []
    for year in fold_seasons(train, folds, season):
        held_out = train.where(F.col(season) == year)
        before = train.where(F.col(season) < year)
        ready = prepare(name, before, columns, target)

        if isinstance(ready, Prepared) and name == "logreg":
            ready.solve([params for _, params in alive])

        def one(draw, before=before, ready=ready) -> Fitted:
            return fit(name, before, columns, target, draw[1], ready)

        models = _at_once(train.sparkSession, one, alive, parallel)
        scored = score_draws({config: model for (config, _), model in zip(alive, models)}, held_out, target)
        got = {r["draw"]: r for r in M.metrics(scored, ["draw"]).collect()}
        for config, _ in alive:
            found = got[config]
            rows.append((config, year, found["top1_accuracy"], found["log_loss"], found["n_events"]))
        if halving:
            means = _draw_means(rows)
            alive.sort(key=lambda draw: (-means[draw[0]][0], means[draw[0]][1], draw[0]))
            alive = alive[: max(1, math.ceil(len(alive) / halving))]
    return rows


def score_draws(models: dict[int, Fitted], held_out: DataFrame, target: str) -> DataFrame:
    """``as_scored`` rows of every model, with the model's ``draw``.

    Logistic models of one preprocessing score a row in one scan and are told apart after it.
    """
    some = list(models.values())
    shared = all(isinstance(m, Fitted) and m.swaps([]) and m.pre is some[0].pre for m in some)
    if not shared:
        parts = [m.score(held_out).withColumn("draw", F.lit(i).cast("long")) for i, m in models.items()]
        return M.as_scored(concat(parts), "p", target, None, "event_id", "draw")
    made = some[0].pre.assemble(held_out.select("event_id", target, *some[0].columns)).select("event_id", target, "_features")
    for i, m in models.items():
        made = m.model.transform(made).withColumn(f"_p{i}", vector_to_array("_probability")[1]).drop("_raw", "_probability", "_prediction")
    cells = [F.struct(F.lit(i).cast("long").alias("draw"), F.col(f"_p{i}").alias("p")) for i in models]
    scored = made.select("event_id", target, F.inline(F.array(*cells)))
    return M.as_scored(scored, "p", target, None, "event_id", "draw")


def _draw_means(rows: list[tuple]) -> dict[int, tuple[float, float, int, int]]:
    """Mean top-1, mean log-loss, folds and events of each draw."""
    out = {}
    for config in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == config]
        k = len(mine)
        out[config] = (sum(r[2] for r in mine) / k, sum(r[3] for r in mine) / k, k, sum(r[4] for r in mine))
    return out


def search(
    train: DataFrame, name: str, columns: Sequence[str], folds: int, n: int, target: str = "winner",
    seed: int = SEED, halving: int | None = None, parallel: int = PARALLEL_FITS,
) -> DataFrame:
    """(config, params, mean top-1, mean log-loss, folds, events, best): one row per draw.

    Takes training rows only, best a stored table. Best is the highest mean top-1, then
    the lowest mean log-loss, then the earliest draw, among draws that saw all folds
    they could (``search_folds``). The driver holds draws times folds rows.
    """
    configs = draw_configs(name, n, seed)
    means = _draw_means(search_folds(train, name, columns, folds, n, target, seed, halving, parallel))
    rows = [(i, json.dumps(configs[i], sort_keys=True), *map(float, m[:2]), *m[2:]) for i, m in sorted(means.items())]
    results = train.sparkSession.createDataFrame(
        rows, "config long, params string, top1 double, log_loss double, folds long, events long"
    )
    return mark_best(results)


def mark_best(results: DataFrame) -> DataFrame:
    """Flag the winning configuration of a search table; draws that met more folds first."""
    if "folds" in results.columns:
        most = results.agg(F.max("folds")).scalar()
        best = results.where(F.col("folds") == most)
    else:
        best = results
    key = F.struct("top1", -F.col("log_loss"), -F.col("config"))
    best = best.agg(F.max_by("config", key)).scalar()
    return results.withColumn("best", F.col("config") == best)


def fit_isotonic(scored: DataFrame, p: str = "p", y: str = "y") -> IsotonicRegressionModel:
    """Monotone map from probability to observed frequency.

    Rows are pooled on equal probabilities first, then neighbours that violate the order
    are pooled where they lie (``pooled_blocks``), at any number of scores. What is left
    is the solution itself, and only that, the size of the model, reaches the driver.
    """
    rows = scored.groupBy(F.col(p).alias("lo")).agg(
        F.sum(F.col(y).cast("double")).alias("total"), F.count(F.lit(1)).cast("double").alias("weight")
    )
    blocks = pooled_blocks(rows.select("lo", F.col("lo").alias("hi"), "total", "weight"))
    # A block is flat from its first score to its last.
    ends = F.when(F.col("lo") == F.col("hi"), F.array("lo")).otherwise(F.array("lo", "hi"))
    points = blocks.select(
        F.explode(ends).alias("_p"), (F.col("total") / F.col("weight")).alias("_mean"), (F.col("weight") / F.size(ends)).alias("_w")
    )
    return IsotonicRegression(
        featuresCol="_p", labelCol="_mean", weightCol="_w", predictionCol="_calibrated"
    ).fit(points)


def fit_calibrated(
    train: DataFrame, name: str, columns: Sequence[str], folds: int, target: str = "winner",
    fit_rows: DataFrame | None = None, params: dict | None = None,
) -> Fitted:
    """Calibrate on held-out seasons of ``train``; the base model is fitted on
    ``fit_rows`` (``train`` by default), so a production fit may add seasons."""
    held_out = out_of_fold(train, name, columns, folds, target, params)
    model = fit(name, train if fit_rows is None else fit_rows, columns, target, params)
    model.calibrator = fit_isotonic(held_out.select("p", F.col(target).alias("y")))
    return model


def fit_for_stage(
    df: DataFrame, stage: str, name: str, columns: Sequence[str], target: str = "winner",
    params: dict | None = None,
) -> tuple[Fitted, DataFrame]:
    """The model to serve and its validation metrics.

    ``df`` has ``role``. Staging serves the model fitted on training rows;
    production serves one fitted on training and validation rows, while its
    metrics still come from the train-only fit.
    """
    train, val = df.where("role = 'train'"), df.where("role = 'val'")
    judged = fit(name, train, columns, target, params)
    scored = M.as_scored(judged.score(val), "p", target)
    table = M.metrics(scored)
    if stage == "staging":
        return judged, table
    if stage != "production":
        raise TrainingError(f"unknown stage '{stage}'")
    return fit(name, df.where("role IN ('train', 'val')"), columns, target, params), table


def score_test_once(
    df: DataFrame, name: str, columns: Sequence[str], target: str = "winner",
    params: dict | None = None,
) -> DataFrame:
    """Metrics on test rows of a model fitted on training rows; searches never call it."""
    model = fit(name, df.where("role = 'train'"), columns, target, params)
    return M.metrics(M.as_scored(model.score(df.where("role = 'test'")), "p", target))


# Importance --------------------------------------------------------------------


def importance(spark: SparkSession, model: Fitted, classes: dict[str, str]) -> DataFrame:
    """(feature, importance, is_missing_flag, class) of a fitted candidate."""
    if model.model is None:
        return spark.createDataFrame(
            [], "feature string, importance double, is_missing_flag boolean, class string"
        )
    if hasattr(model.model, "coefficients"):
        values = [abs(float(v)) for v in model.model.coefficients]
    else:
        values = [float(v) for v in model.model.featureImportances.toArray()]
    rows = [
        (n, v, n.endswith("_missing"), classes.get(n.removesuffix("_missing"), "derived"))
        for n, v in zip(model.pre.names, values)
    ]
    return spark.createDataFrame(
        rows, "feature string, importance double, is_missing_flag boolean, class string"
    )


def importance_by_class(importance: DataFrame, classes: dict[str, str]) -> DataFrame:
    """Summed importance per feature class; flags count with their base feature."""
    base = F.regexp_replace("feature", "_missing$", "")
    lookup = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])
    tagged = importance.withColumn("class", F.coalesce(lookup[base], F.lit("derived")))
    return tagged.groupBy("class").agg(F.sum("importance").alias("importance"))


def permutation_importance(
    score: Callable[[DataFrame], DataFrame],
    df: DataFrame,
    columns: Sequence[str],
    repeats: int = PERMUTATION_REPEATS,
    seed: int = SEED,
    target: str = "winner",
    keys: Sequence[str] = ("event_id", "entity_id"),
) -> DataFrame:
    """Mean and deviation of the drop in per-event top-1 when a column is shuffled.

    Rows are numbered once, without an order. A repeat gives every row a donor by a keyed
    permutation of the numbers and fetches the donor's columns by one equi-join; the
    features are expanded after it, so what is shuffled is rows times repeats. The winner
    of an event must stand alone at the top; that is two maxima per event, which are
    combined before their shuffle.

    Rows are scored once a feature by ``score``, any function; where it is that of a fitted
    logistic model, a row's scores for all features come from one pass over its terms.
    """
    columns = list(columns)
    model = getattr(score, "__self__", None)
    linear = isinstance(model, Fitted) and model.swaps(columns)
    if linear:
        lost = [c for c in model.columns if c not in df.columns]
        if lost:
            raise ModelSchemaError(f"missing feature columns {lost}")
        df = df.select(*dict.fromkeys(["event_id", target, *model.columns]))
    rows, n = numbered(df if linear else df.select(*dict.fromkeys([*keys, target, *df.columns])))
    turns = list(range(repeats))
    repeated = rows.withColumn("repeat", F.explode(F.array(*[F.lit(r).cast("long") for r in turns])))
    asking = repeated.withColumn("_from", permuted(F.col("_at"), n, F.col("repeat"), seed)).drop("_at")
    donors = rows.select(F.col("_at").alias("_from"), F.struct(*columns).alias("_donor"))
    met = asking.join(donors, "_from").drop("_from")
    if linear:
        # Repeat -1 has every row as its own donor.
        own = rows.select(*df.columns, F.lit(-1).cast("long").alias("repeat"), F.struct(*columns).alias("_donor"))
        return _drops(model.swapped(met.unionByName(own), columns, target, ["event_id", "repeat"]))
    shuffled = met.withColumn("feature", F.explode(F.array(*[F.lit(c) for c in columns])))
    shuffled = shuffled.withColumns(
        {c: F.when(F.col("feature") == c, F.col("_donor")[c]).otherwise(F.col(c)) for c in columns}
    ).drop("_donor")
    hits = _top1(score(shuffled), target, ["feature", "repeat"]).groupBy("feature", "repeat").agg(
        F.avg("hit").alias("top1"), F.count(F.lit(1)).alias("n_events")
    )
    base = _top1(score(df), target, []).agg(F.avg("hit").alias("top1")).select("top1").scalar()
    return hits.withColumn("_drop", base - F.col("top1")).groupBy("feature").agg(
        F.avg("_drop").alias("top1_drop_mean"), F.stddev_pop("_drop").alias("top1_drop_std"),
        F.count(F.lit(1)).alias("repeats"), F.max("n_events").alias("n_events"),
    )


def _drops(best: DataFrame) -> DataFrame:
    """``permutation_importance`` from the maxima of each (event, repeat, feature)."""
    hits = best.select("feature", "repeat", _hit()).groupBy("feature", "repeat").agg(
        F.avg("hit").alias("top1"), F.count(F.lit(1)).alias("n_events")
    )
    # A feature has a row per repeat.
    base = F.max(F.when(F.col("repeat") < 0, F.col("top1"))).over(Window.partitionBy("feature"))
    return hits.withColumn("_drop", base - F.col("top1")).where("repeat >= 0").groupBy("feature").agg(
        F.avg("_drop").alias("top1_drop_mean"), F.stddev_pop("_drop").alias("top1_drop_std"),
        F.count(F.lit(1)).alias("repeats"), F.max("n_events").alias("n_events"),
    )


def _hit() -> Column:
    above = F.col("_others").isNull() | (F.col("_own") > F.col("_others"))
    return F.coalesce(F.col("_own").isNotNull() & above, F.lit(False)).cast("double").alias("hit")


def _top1(scored: DataFrame, target: str, by: Sequence[str], event: str = "event_id") -> DataFrame:
    """(by, event, hit): does the winner's probability lie above all others?"""
    won = F.col(target) == 1
    best = scored.groupBy(*by, event).agg(
        F.max(F.when(won, F.col("p"))).alias("_own"), F.max(F.when(~won, F.col("p"))).alias("_others")
    )
    return best.select(*by, event, _hit())


def linear_contributions(
    df: DataFrame, weights: dict[str, float], means: dict[str, float] | None = None
) -> DataFrame:
    """(feature, mean_abs) of weight * (value - mean); means come from ``df`` by default."""
    if means is None:
        row = df.agg(*[F.avg(c).alias(c) for c in weights]).first()
        means = {c: row[c] for c in weights}
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                (F.lit(w) * (F.col(c).cast("double") - F.lit(means[c]))).alias("contribution"),
            )
            for c, w in weights.items()
        ]
    )
    return (
        df.select(F.inline(rows))
        .groupBy("feature")
        .agg(F.avg(F.abs("contribution")).alias("mean_abs"))
    )


def case_studies(scored: DataFrame, season: int) -> DataFrame:
    """(label, event, entity, p): the surest and least sure winners, and the
    winner of the first event of ``season``."""
    row = F.struct("event_id", "entity_id", "p")
    high = F.struct("p", -F.col("event_id"))
    low = F.struct("p", F.col("event_id"))
    opening = F.col("season") == season
    picked = scored.where("winner = 1").agg(
        F.max_by(row, high).alias("winner_highest_confidence"),
        F.min_by(row, low).alias("winner_lowest_confidence"),
        F.min_by(row, F.when(opening, F.struct("round", "event_id"))).alias("season_opener"),
    )
    names = ["winner_highest_confidence", "winner_lowest_confidence", "season_opener"]
    rows = F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).alias("r")) for n in names])
    return picked.select(F.inline(rows)).where("r IS NOT NULL").select("label", "r.*")


# Storage -----------------------------------------------------------------------

_LOADERS = {
    "logreg": LogisticRegressionModel,
    "random_forest": RandomForestClassificationModel,
    "boosted_trees": GBTClassificationModel,
}


def save(spark: SparkSession, model: Fitted, path: str) -> None:
    """The MLlib model, its calibrator and one JSON row with the rest."""
    if model.model is not None:
        model.model.write().overwrite().save(f"{path}/model")
    if model.calibrator is not None:
        model.calibrator.write().overwrite().save(f"{path}/calibrator")
    pre = model.pre
    meta = {
        "name": model.name,
        "columns": model.columns,
        "medians": pre.medians if pre else {},
        "flagged": pre.flagged if pre else [],
        "means": pre.means if pre else {},
        "stds": pre.stds if pre else {},
        "calibrated": model.calibrator is not None,
    }
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode(
        "overwrite"
    ).text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Fitted:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if meta["name"] not in _LOADERS:
        model = Fitted(meta["name"], meta["columns"])
    else:
        pre = Preprocess(
            meta["columns"], meta["medians"], meta["flagged"], meta["means"], meta["stds"]
        )
        model = Fitted(
            meta["name"], meta["columns"], pre, _LOADERS[meta["name"]].load(f"{path}/model")
        )
    if meta["calibrated"]:
        model.calibrator = IsotonicRegressionModel.load(f"{path}/calibrator")
    return model
