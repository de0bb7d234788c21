"""Data-quality rules: every check is an aggregate, every result a table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

SAMPLE_KEYS = 5
REPORT = "rule string, severity string, n bigint"


@dataclass(frozen=True)
class Rule:
    """Rows where ``broken`` holds violate the rule."""

    name: str
    severity: str
    broken: Column


class QualityError(ValueError):
    """Raised with every broken error rule at once."""


def run_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule, severity, n): all row rules in one pass over ``df``."""
    counts = df.agg(*[F.count_if(r.broken).alias(f"_{i}") for i, r in enumerate(rules)])
    rows = F.array(
        *[
            F.struct(
                F.lit(r.name).alias("rule"),
                F.lit(r.severity).alias("severity"),
                F.col(f"_{i}").alias("n"),
            )
            for i, r in enumerate(rules)
        ]
    )
    return counts.select(F.inline(rows))


def run_rules_sampled(
    df: DataFrame, rules: Sequence[Rule], keys: Sequence[str], k: int = SAMPLE_KEYS
) -> DataFrame:
    """``run_rules`` with ``sample``: the ``k`` smallest keys of rows that break the rule.

    Broken rows only are sorted, and each task passes on ``k`` of them a rule, so a
    rule that all rows break samples as few rows as one that five do.
    """
    broken = F.array_compact(
        F.array(*[F.when(r.broken, F.lit(i)) for i, r in enumerate(rules)])
    )
    key = F.struct(*keys)
    at = Window.partitionBy("_rule").orderBy("_key")
    first = (
        df.select(key.alias("_key"), F.explode(broken).alias("_rule"))
        .withColumn("_at", F.row_number().over(at))
        .where(F.col("_at") <= k)
        .groupBy("_rule")
        .agg(F.array_sort(F.collect_list("_key")).alias("sample"))
    )
    names = F.array(*[F.struct(F.lit(i).alias("_rule"), F.lit(r.name).alias("rule")) for i, r in enumerate(rules)])
    named = df.sparkSession.range(1).select(F.inline(names))
    samples = named.join(first, "_rule", "left").select("rule", "sample")
    return run_rules(df, rules).join(samples, "rule", "left")


class Observed:
    """Rules counted by the job that reads or writes ``rows``, without a pass of their own.

    Use ``rows`` once, in one action, and put nothing behind it that shuffles: counts
    then come from the tasks of the last stage, which count once each, also when an
    executor is lost and its tasks run again. ``report`` waits for that action.
    """

    def __init__(self, df: DataFrame, rules: Sequence[Rule]):
        self.rules = list(rules)
        self._spark: SparkSession = df.sparkSession
        self._seen = Observation()
        counts = [F.count_if(r.broken).alias(f"_{i}") for i, r in enumerate(self.rules)]
        self.rows = df.observe(self._seen, F.count(F.lit(1)).alias("_rows"), *counts)

    def count(self) -> int:
        return self._seen.get["_rows"]

    def broken(self, name: str) -> int:
        at = [r.name for r in self.rules].index(name)
        return self._seen.get[f"_{at}"]

    def report(self) -> DataFrame:
        """(rule, severity, n), as ``run_rules`` gives it."""
        seen = self._seen.get
        rows = [(r.name, r.severity, seen[f"_{i}"]) for i, r in enumerate(self.rules)]
        return self._spark.createDataFrame(rows, REPORT)


def counted(spark: SparkSession, rule: str, severity: str, n: int) -> DataFrame:
    """One report row from a number that is already known."""
    return spark.createDataFrame([(rule, severity, n)], REPORT)


def not_null(*columns: str, severity: str = "error") -> list[Rule]:
    return [Rule(f"{c} is null", severity, F.col(c).isNull()) for c in columns]


def outside(column: str, lo=None, hi=None, severity: str = "error") -> Rule:
    broken = F.lit(False)
    if lo is not None:
        broken = broken | (F.col(column) < lo)
    if hi is not None:
        broken = broken | (F.col(column) > hi)
    return Rule(f"{column} outside [{lo}, {hi}]", severity, broken)


def implies(name: str, when: Column, then: Column, severity: str = "error") -> Rule:
    return Rule(name, severity, when & ~then)


def not_allowed(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Values of ``column`` outside the allow-list, with their counts."""
    return (
        df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def failed_casts(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """(column, n): values that are there but do not read as the type."""
    rules = [
        Rule(c, "error", F.col(c).isNotNull() & F.col(c).try_cast(t).isNull())
        for c, t in types.items()
        if c in df.columns
    ]
    return run_rules(df, rules).select(F.col("rule").alias("column"), "n")


def cast_strict(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast by map; the first value that does not fit raises, with its column."""

    def cast(c: str, t: str) -> Column:
        value = F.col(c).try_cast(t)
        said = F.concat(F.lit(f"column {c}: not a {t}: "), F.col(c).cast("string"))
        broken = F.col(c).isNotNull() & value.isNull()
        return F.when(broken, F.raise_error(said).cast(t)).otherwise(value)

    return df.withColumns({c: cast(c, t) for c, t in types.items() if c in df.columns})


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each repeated key and its number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def duplicate_sample(df: DataFrame, keys: Sequence[str], k: int = SAMPLE_KEYS) -> DataFrame:
    return duplicate_keys(df, keys).orderBy(*keys).limit(k)


def duplicate_rows(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """One report row: how many rows share their key with another row."""
    return (
        duplicate_keys(df, keys)
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        .select(F.lit(name).alias("rule"), F.lit("error").alias("severity"), "n")
    )


def orphans(facts: DataFrame, dimension: DataFrame, key: str, name: str) -> DataFrame:
    """One report row: fact rows whose key the dimension does not hold.

    Counted per key before the join, so a key with many rows is one row there.
    """
    per_key = facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    lost = per_key.join(dimension.select(key), key, "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(
        F.lit(name).alias("rule"), F.lit("error").alias("severity"), "n"
    )


def events_without_one_winner(
    df: DataFrame, event: str = "event_id", winner: str = "winner"
) -> DataFrame:
    """Events with none or several winners; unknown winners count as none."""
    winners = F.coalesce(F.sum(winner), F.lit(0)).alias("winners")
    return df.groupBy(event).agg(winners).where("winners <> 1")


def null_rates(df: DataFrame, columns: Sequence[str], limit: float = 0.6) -> DataFrame:
    """(column, null_rate, warn): warn above ``limit``."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).alias("null_rate")) for c in columns]
    )
    return rates.select(F.inline(rows)).withColumn("warn", F.col("null_rate") > limit)


def profile(df: DataFrame) -> DataFrame:
    """(column, type, n, missing, missing_pct, mean, std, min, max) in one pass.

    The statistics are NULL for columns that are not numeric.
    """
    aggs, rows = [F.count(F.lit(1)).alias("_n")], []
    for i, (name, kind) in enumerate(df.dtypes):
        numeric = kind in ("double", "float", "int", "bigint", "smallint") or "decimal" in kind
        value = F.col(name).cast("double") if numeric else F.lit(None).cast("double")
        aggs.append(F.count_if(F.col(name).isNull()).alias(f"_m{i}"))
        if numeric:
            aggs += [
                F.avg(value).alias(f"_a{i}"),
                F.stddev_samp(value).alias(f"_s{i}"),
                F.min(value).alias(f"_l{i}"),
                F.max(value).alias(f"_h{i}"),
            ]

        def stat(tag: str, i=i, numeric=numeric) -> Column:
            return F.col(f"_{tag}{i}") if numeric else F.lit(None).cast("double")

        missing = F.col(f"_m{i}")
        rows.append(
            F.struct(
                F.lit(name).alias("column"),
                F.lit(kind).alias("type"),
                F.col("_n").alias("n"),
                missing.alias("missing"),
                (100.0 * F.try_divide(missing, "_n")).alias("missing_pct"),
                stat("a").alias("mean"),
                stat("s").alias("std"),
                stat("l").alias("min"),
                stat("h").alias("max"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def require(report: DataFrame) -> None:
    """Raise once with all broken errors of a rule report (one row per rule)."""
    broken = report.where("severity = 'error' AND n > 0").orderBy("rule").collect()
    if broken:
        raise QualityError("; ".join(f"{r['rule']}: {r['n']}" for r in broken))


def verdict(report: DataFrame) -> DataFrame:
    """One row: passed, broken errors, broken warnings."""
    return report.agg(
        F.count_if((F.col("severity") == "error") & (F.col("n") > 0)).alias("errors"),
        F.count_if((F.col("severity") == "warning") & (F.col("n") > 0)).alias("warnings"),
    ).select((F.col("errors") == 0).alias("passed"), "errors", "warnings")
