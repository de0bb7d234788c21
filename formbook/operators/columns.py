"""Counts, moments and brackets of many columns, by functions over Arrow batches.

A cell per column and row, expanded and grouped, costs a hundred times the addition it is
there for; a batch holds whole columns. Doubles are ordered as whole numbers by their bits
(NaN above all), so a histogram over the highest bits has a bound at any data: a bracket is
found by two of them, and what lies in it is counted value by value.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formbook.session import new_path

# Tasks are sent what they need of this module: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bits of a digit; a first digit names 1 / 16 of a power of two, two of them 2 ** -20.
DIGIT = 16
LOW = np.int64((1 << 63) - 1)
_SHAPE = "feature int, digit long, n long, task long, there long, mean double, m2 double"


def ordered(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles."""
    clean = np.where(np.isnan(values), np.nan, values + 0.0).view(np.int64)
    return np.where(clean >= 0, clean, clean ^ LOW)


def double_of(number: int) -> float:
    bits = np.int64(number)
    return float((bits if bits >= 0 else bits ^ LOW).view(np.float64))


def _doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])


def _values(column: pa.Array) -> np.ndarray:
    """Values that are there."""
    return (column.drop_null() if column.null_count else column).to_numpy(zero_copy_only=False)


def _rows(*columns) -> pa.RecordBatch:
    kinds = (pa.int32(), *[pa.int64()] * 4, pa.float64(), pa.float64())
    names = [part.split()[0] for part in _SHAPE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _digits(df: DataFrame, columns: Sequence[str], heads: dict[int, list[int]] | None) -> DataFrame:
    """A stored table: counts per (column, digit), and of the first digit the moments, in
    rows without a digit. ``heads``: first digits whose second one is counted."""
    d = len(columns)

    def run(batches):
        n, there, mean, m2 = 0, np.zeros(d), np.zeros(d), np.zeros(d)
        counts = [{} for _ in range(d)] if heads else [np.zeros(1 << DIGIT, dtype=np.int64) for _ in range(d)]
        for batch in batches:
            n += batch.num_rows
            for i in range(d):
                values = _values(batch.column(i))
                if not len(values):
                    continue
                keys = ordered(values)
                first = (keys >> (64 - DIGIT)) + (1 << (DIGIT - 1))
                if heads:
                    for head in heads.get(i, ()):
                        second = (keys[first == head] >> (64 - 2 * DIGIT)) & ((1 << DIGIT) - 1)
                        if len(second):
                            held = counts[i].setdefault(head, np.zeros(1 << DIGIT, dtype=np.int64))
                            held += np.bincount(second, minlength=1 << DIGIT)
                    continue
                counts[i] += np.bincount(first, minlength=1 << DIGIT)
                with np.errstate(invalid="ignore"):
                    here = values.mean()
                    spread, gap, total = ((values - here) ** 2).sum(), here - mean[i], there[i] + len(values)
                    m2[i] += spread + gap * gap * there[i] * len(values) / total
                    mean[i] += gap * len(values) / total
                there[i] = total
        if heads:
            found = [(i, (head << DIGIT) + at, held[at]) for i, c in enumerate(counts) for head, held in c.items() for at in np.flatnonzero(held)]
        else:
            found = [(i, at, held[at]) for i, held in enumerate(counts) for at in np.flatnonzero(held)]
            yield _rows(range(d), [None] * d, [n] * d, [TaskContext.get().partitionId()] * d, there.astype(np.int64), mean, m2)
        if found:
            yield _rows(*zip(*found), *[[None] * len(found)] * 4)

    path = new_path(df.sparkSession, "digits")
    _doubles(df, columns).mapInArrow(run, _SHAPE).groupBy("feature", "digit", "task", "there", "mean", "m2").agg(
        F.sum("n").alias("n")
    ).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _holding(digits: DataFrame, places: dict[int, tuple[int, int]]) -> dict[int, list[tuple[int, int]]]:
    """Per column the digits that hold the places, each with the rows before it. A column
    has at most as many rows as a digit has values."""
    upto = F.sum("n").over(Window.partitionBy("feature").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
    running = digits.where("digit IS NOT NULL").groupBy("feature", "digit").agg(F.sum("n").alias("n")).withColumn("_upto", upto)

    def asked(at: int) -> Column:
        given = F.create_map(*[F.lit(x) for i, p in places.items() for x in (i, p[at])])
        return F.col("_upto").between(given[F.col("feature")], given[F.col("feature")] + F.col("n") - 1)

    out: dict[int, list[tuple[int, int]]] = {}
    for r in running.where(asked(0) | asked(1)).collect():
        out.setdefault(r["feature"], []).append((r["digit"], r["_upto"] - r["n"]))
    return {i: sorted(found) for i, found in out.items()}


def profile(df: DataFrame, columns: Sequence[str]) -> tuple[dict[str, dict], dict[str, tuple]]:
    """Per column {n, there, mean, var} (rows, values, their mean and population variance),
    and (lo, hi, there): a bracket of its two middle values, for ``exact_medians``."""
    columns = list(columns)
    digits = _digits(df, columns, None)
    # A row per task and column, merged into one per column.
    tasks = digits.where("digit IS NULL")
    mean = F.try_divide(F.sum(F.when(F.col("there") > 0, F.col("there") * F.col("mean"))), F.sum("there"))
    total = {r["feature"]: r for r in tasks.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("there").alias("there"), mean.alias("mean")).collect()}
    centre = F.create_map(*[F.lit(x) for i, r in total.items() for x in (i, r["mean"] if r["there"] else 0.0)])
    off = F.col("mean") - centre[F.col("feature")]
    spread = F.sum(F.when(F.col("there") > 0, F.col("m2") + F.col("there") * off * off))
    m2 = {r["feature"]: r["m2"] for r in tasks.groupBy("feature").agg(spread.alias("m2")).collect()} if total else {}
    none = {"n": 0, "there": 0, "mean": None, "var": None}
    moments = {c: none for c in columns}
    for i, r in total.items():
        var = m2[i] / r["there"] if r["there"] else None
        moments[columns[i]] = {"n": r["n"], "there": r["there"], "mean": r["mean"], "var": var}
    places = {i: ((r["there"] + 1) // 2, r["there"] // 2 + 1) for i, r in total.items() if r["there"]}
    brackets = {c: (None, None, moments[c]["there"]) for c in columns}
    if not places:
        return moments, brackets
    heads = _holding(digits, places)
    inner = {i: tuple(p - heads[i][0][1] for p in places[i]) for i in places}
    found = _holding(_digits(df, columns, {i: [head for head, _ in some] for i, some in heads.items()}), inner)
    for i, some in found.items():
        lo, hi = some[0][0] - (1 << 31), some[-1][0] - (1 << 31)
        low, high = double_of(lo << 32), double_of((hi << 32) | 0xFFFFFFFF)
        brackets[columns[i]] = (float("-inf") if np.isnan(low) else low, high, moments[columns[i]]["there"])
    return moments, brackets


def counted(df: DataFrame, ends: dict[str, tuple[float, float]]) -> DataFrame:
    """(feature, value, n): how often each value within its column's (lo, hi) comes, and
    without a value how many lie below. A stored table."""
    columns = list(ends)
    edges = [tuple(int(k) for k in ordered(np.array(ends[c], dtype=np.float64))) for c in columns]

    def run(batches):
        below = np.zeros(len(columns), dtype=np.int64)
        for batch in batches:
            found = []
            for i, (lo, hi) in enumerate(edges):
                values = _values(batch.column(i))
                keys = ordered(values)
                below[i] += (keys < lo).sum()
                some, times = np.unique(values[(keys >= lo) & (keys <= hi)] + 0.0, return_counts=True)
                found += zip([columns[i]] * len(some), some, times)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["feature", "value", "n"])
        kinds = (pa.string(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((columns, [None] * len(columns), below), kinds)], ["feature", "value", "n"])

    path = new_path(df.sparkSession, "counted")
    made = _doubles(df, columns).mapInArrow(run, "feature string, value double, n long")
    made.groupBy("feature", "value").agg(F.sum("n").alias("n")).write.parquet(path)
    return df.sparkSession.read.parquet(path)
