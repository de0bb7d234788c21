"""Logistic regression by Newton steps, and what its linear form makes cheap.

A pass over the rows adds up loss, gradient and curvature of any number of trial weights;
the curvature makes some ten passes do, where a line search along gradients takes a
hundred or more, and fits that differ in their penalty share every pass. Nothing is cached:
a task holds one Arrow batch and its sums, and a few partly added sums reach the driver.

Matrix products have no column expression, so these are functions over Arrow batches.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sums of the tasks are added in so many places before the driver adds those.
REDUCERS = 8
# Halvings of a step that does not lower the loss.
HALVINGS = 40
# Groups whose maxima a task holds before it hands them on.
HELD_GROUPS = 20_000


# Tasks are sent what they need of this module: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class FitError(ValueError):
    """Rows no weights can be found for."""


@dataclass(frozen=True)
class Design:
    """How stored columns become inputs: gaps filled, flagged ones marked, all scaled."""

    columns: tuple[str, ...]
    fill: tuple[float, ...]
    flagged: tuple[str, ...]
    shift: tuple[float, ...]
    scale: tuple[float, ...]

    def read(self, names: Sequence[str] | None = None) -> list[Column]:
        return [F.col(n).cast("double").alias(f"_x{i}") for i, n in enumerate(names or self.columns)]

    def inputs(self, batch: pa.RecordBatch, first: int = 0) -> np.ndarray:
        """Rows by (columns, flags, one) of the batch's columns from ``first`` on."""
        d, flags = len(self.columns), {c: i for i, c in enumerate(self.flagged)}
        x = np.zeros((batch.num_rows, d + len(flags) + 1), order="F")
        for i, (name, fill) in enumerate(zip(self.columns, self.fill)):
            column = batch.column(first + i)
            x[:, i] = column.to_numpy(zero_copy_only=False)
            if column.null_count:
                gaps = column.is_null().to_numpy(zero_copy_only=False)
                x[gaps, i] = fill
                if name in flags:
                    x[gaps, d + flags[name]] = 1.0
        x[:, :-1] -= self.shift
        x[:, :-1] /= self.scale
        x[:, -1] = 1.0
        return x

    def terms(self, batch: pa.RecordBatch, weights: np.ndarray, first: int = 0) -> np.ndarray:
        """What each column, with its flag, adds to the margin."""
        parts = self.inputs(batch, first)[:, :-1] * weights[:-1]
        out = parts[:, : len(self.columns)]
        for i, name in enumerate(self.flagged):
            out[:, self.columns.index(name)] += parts[:, len(self.columns) + i]
        return out


def probability(margin: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-margin))


def _sums(rows: DataFrame, design: Design, trials: Sequence[np.ndarray], y: str, weight: str) -> np.ndarray:
    """Loss, gradient and curvature of each trial, one row each."""
    m, d = len(trials[0]), len(design.columns)

    def run(batches):
        out = np.zeros((len(trials), 1 + m + m * m))
        for batch in batches:
            x = design.inputs(batch)
            label, w = (batch.column(d + i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not np.isin(label, (0.0, 1.0)).all():
                out[:, 0] = np.nan
            for total, trial in zip(out, trials):
                margin = x @ trial
                p = probability(margin)
                root = x * np.sqrt(w * p * (1 - p))[:, None]
                total[0] += w @ (np.logaddexp(0.0, margin) - label * margin)
                total[1 : m + 1] += x.T @ (w * (p - label))
                total[m + 1 :] += (root.T @ root).ravel()
        yield _held(out, TaskContext.get().partitionId())

    def add(batches):
        found = sorted((task, trial, sums) for b in batches for task, trial, sums in zip(*(c.to_pylist() for c in b.columns)))
        out = np.zeros((len(trials), 1 + m + m * m))
        for _, trial, sums in found:
            out[trial] += sums
        yield _held(out, TaskContext.get().partitionId())

    shape = "task long, trial long, sums array<double>"
    made = rows.select(*design.read(), F.col(y).cast("double"), F.col(weight).cast("double")).mapInArrow(run, shape)
    parts = made.repartition(REDUCERS, "task").mapInArrow(add, shape).collect()
    out = np.zeros((len(trials), 1 + m + m * m))
    for task, trial, sums in sorted(parts):
        out[trial] += sums
    return out


def _held(sums: np.ndarray, task: int) -> pa.RecordBatch:
    columns = [pa.array([task] * len(sums), pa.int64()), pa.array(range(len(sums)), pa.int64()), pa.array(list(sums), pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, ["task", "trial", "sums"])


class _Descent:
    """One penalty's way down: the best weights so far and those to be tried next."""

    def __init__(self, penalty: float, start: np.ndarray):
        self.ridge = np.full(len(start), penalty)
        self.ridge[-1] = 0.0
        self.trial, self.at, self.loss, self.step = start, start, np.inf, np.zeros_like(start)
        self.steps = self.halved = 0
        self.done = False

    def take(self, sums: np.ndarray, total: float, max_iter: int, tol: float) -> None:
        m = len(self.trial)
        loss = sums[0] / total + 0.5 * self.ridge @ self.trial**2
        if not np.isfinite(sums).all():
            if not np.isfinite(self.loss):
                raise FitError("labels other than 0 and 1, or values that are no numbers")
            loss = np.inf
        if loss > self.loss * (1 + 1e-12) and self.halved < HALVINGS:
            self.halved += 1
            self.trial = self.at + self.step * 0.5**self.halved
            return
        if loss > self.loss * (1 + 1e-12):
            # No shorter step is better: these are the weights.
            self.trial, self.done = self.at, True
            return
        self.at, self.loss, self.halved = self.trial, loss, 0
        gradient = sums[1 : m + 1] / total + self.ridge * self.at
        curvature = sums[m + 1 :].reshape(m, m) / total + np.diag(self.ridge)
        try:
            self.step = -np.linalg.solve(curvature, gradient)
        except np.linalg.LinAlgError:
            self.step = -np.linalg.lstsq(curvature, gradient, rcond=None)[0]
        self.steps += 1
        self.trial = self.at + self.step
        # Newton steps square the error: the last one needs no look.
        self.done = -0.5 * gradient @ self.step <= tol * loss or self.steps >= max_iter


def newton_logistic(
    rows: DataFrame, design: Design, penalties: Sequence[float], total: float, y: str, weight: str,
    max_iter: int, tol: float,
) -> list[np.ndarray]:
    """Weights (inputs, then intercept) that minimise the mean weighted log-loss plus half
    of each penalty times the squared weights, the intercept left out.

    The strongest penalty is solved first; the others start from its weights and share
    their passes. ``tol`` is the share of the loss that the last step may gain.
    """
    order = sorted(range(len(penalties)), key=lambda i: -penalties[i])
    start = np.zeros(len(design.shift) + 1)
    found: dict[int, np.ndarray] = {}
    for group in (order[:1], order[1:]):
        ways = {i: _Descent(penalties[i], start) for i in group}
        while left := [i for i in group if not ways[i].done]:
            for i, sums in zip(left, _sums(rows, design, [ways[i].trial for i in left], y, weight)):
                ways[i].take(sums, total, max_iter, tol)
        found |= {i: way.trial for i, way in ways.items()}
        start = found[order[0]]
    return [found[i] for i in range(len(penalties))]


def swapped_maxima(
    met: DataFrame, design: Design, weights: np.ndarray, columns: Sequence[str], target: str, keys: Sequence[str]
) -> DataFrame:
    """(keys, feature, _own, _others): the winners' and the others' largest probability when
    the feature, alone, is taken from the row's donor. ``met`` has the design's columns and
    the struct ``_donor`` of ``columns``.

    The margin without a column is the sum of those before and after it, so rows alike in
    all others stay exactly alike, and rows need not be repeated per feature.
    """
    d, picked = len(design.columns), [design.columns.index(c) for c in columns]
    kinds = dict(met.dtypes)
    # A row's donor brings the columns asked for; the others stay its own.
    donors = [F.col("_donor")[c] if c in set(columns) else F.col(c) for c in design.columns]
    donors = [v.cast("double").alias(f"_d{i}") for i, v in enumerate(donors)]
    asked = met.select(*design.read(), *donors, F.col(target).cast("double").alias("_y"), F.struct(*keys).alias("_key"))
    shape = f"_key struct<{', '.join(f'{k}: {kinds[k]}' for k in keys)}>, own array<double>, others array<double>"

    def run(batches):
        held: dict[tuple, list[np.ndarray]] = {}
        kind = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own, lent = design.terms(batch, weights), design.terms(batch, weights, d)
            none = np.zeros((len(own), 1))
            before = np.cumsum(np.hstack([none, own[:, :-1]]), axis=1)
            after = np.cumsum(np.hstack([none, own[:, :0:-1]]), axis=1)[:, ::-1]
            p = probability((before + after + lent)[:, picked] + weights[-1])
            label = batch.column(2 * d).to_numpy(zero_copy_only=False)
            key = batch.column(2 * d + 1)
            kind = key.type
            codes, names = _groups(key)
            turn = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.diff(codes[turn], prepend=-1))
            sides = [np.where(side[:, None], p, -1.0)[turn] for side in (label == 1, (label != 1) & ~np.isnan(label))]
            sides = [np.maximum.reduceat(s, starts) for s in sides]
            for name, *most in zip(names, *sides):
                was = held.get(name)
                held[name] = most if was is None else [np.maximum(a, b) for a, b in zip(was, most)]
            if len(held) > HELD_GROUPS:
                yield _maxima(held, kind)
                held = {}
        if held:
            yield _maxima(held, kind)

    made = asked.mapInArrow(run, shape).select("_key.*", F.posexplode(F.arrays_zip("own", "others")).alias("_at", "_p"))
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("_at") + 1)
    # Probabilities are never below 0: that stands for no row.
    known = [F.max(F.when(F.col(f"_p.{c}") >= 0, F.col(f"_p.{c}"))).alias(f"_{c}") for c in ("own", "others")]
    return made.withColumn("feature", name).groupBy(*keys, "feature").agg(*known)


def _groups(key: pa.StructArray) -> tuple[np.ndarray, list[tuple]]:
    """A number per row and the key each number stands for, in order of the numbers."""
    codes, parts = np.zeros(len(key), dtype=np.int64), []
    for column in key.flatten():
        coded = column.dictionary_encode(null_encoding="encode")
        parts.append((coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()))
        codes = codes * len(parts[-1][1]) + parts[-1][0]
    _, first, codes = np.unique(codes, return_index=True, return_inverse=True)
    return codes, [tuple(values[at[i]] for at, values in parts) for i in first]


def _maxima(held: dict[tuple, list[np.ndarray]], kind: pa.DataType) -> pa.RecordBatch:
    keys = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kind)], fields=list(kind))
    sides = [pa.array([most[i] for most in held.values()], pa.list_(pa.float64())) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([keys, *sides], ["_key", "own", "others"])
