"""Raw racing tables to the master table and the feature table.

clean -> repair -> join -> features. Each table is one lazy plan, written once and
read back; the write counts the row rules (``Observed``), and a table that breaks an
error rule does not take its place. Rules on keys read key columns of written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formbook import schemas as H
from formbook.functions import scalars as S
from formbook.operators import quality as Q
from formbook.operators.dedup import keep_best
from formbook.operators.joins import guarded_join
from formbook.operators.setops import concat
from formbook.plans.features import RACING, build_features
from formbook.sources import files

# --- fixed values --------------------------------------------------------------
RESULT_TYPES = {
    "raceId": "long", "driverId": "long", "constructorId": "long", "grid": "long",
    "laps": "long", "position": "long", "points": "double", "rank": "long",
    "milliseconds": "long",
}
QUALIFYING_TYPES = {
    "raceId": "long", "driverId": "long", "constructorId": "long", "number": "long",
    "position": "long",
}
MAX_POSITION = 34
WATCHED_NULLS = (
    "driver_standing_position_prev", "qualifying_gap_to_pole_pct", "quali_precip_mm",
    "conditions_changed",
)
# ------------------------------------------------------------------------------

PAIR = ["raceId", "driverId"]


def _require_ids(df: DataFrame) -> None:
    missing = [c for c in H.RESULT_ID_COLUMNS if c not in df.columns]
    if missing:
        raise H.SchemaError(f"missing required columns {missing}")
    Q.require(Q.run_rules(df, Q.not_null(*H.RESULT_ID_COLUMNS)))


def clean_results(df: DataFrame) -> DataFrame:
    """Typed results with ``result_status`` and ``finished``; no row is dropped."""
    _require_ids(df)
    return _typed_results(df)


def _typed_results(df: DataFrame) -> DataFrame:
    typed = Q.cast_strict(df, RESULT_TYPES)
    none = F.lit(None)
    text = F.col("positionText") if "positionText" in df.columns else none.cast("string")
    status_id = F.col("statusId") if "statusId" in df.columns else none.cast("long")
    return typed.withColumn("result_status", S.result_status(text, status_id)).withColumn(
        "finished", S.is_finished("result_status")
    )


def clean_qualifying(df: DataFrame) -> DataFrame:
    _require_ids(df)
    return Q.cast_strict(df, QUALIFYING_TYPES)


def repair_results(cleaned: DataFrame) -> DataFrame:
    """One row per (race, driver), finishers first, then the latest result id;
    finishers without a position get it from the position text."""
    best = keep_best(
        cleaned, PAIR, [(F.col("result_status") == "Finished").cast("int"), F.col("resultId")]
    )
    return best.withColumn(
        "position", S.repaired_position("position", "positionText", F.col("finished"))
    )


def results_rules() -> list[Q.Rule]:
    return [
        *Q.not_null(*H.RESULT_ID_COLUMNS),
        Q.outside("points", 0),
        Q.Rule("result_status not allowed", "error", ~F.col("result_status").isin(*S.ALLOWED_STATUSES)),
        Q.implies("finished without position", F.col("finished"), F.col("position").isNotNull()),
        Q.implies(
            "unfinished with position", ~F.col("finished"), F.col("position").isNull(), "warning"
        ),
        Q.outside("position", 1, MAX_POSITION, "warning"),
    ]


def qualifying_rules() -> list[Q.Rule]:
    return [*Q.not_null(*H.RESULT_ID_COLUMNS), Q.outside("position", 1, MAX_POSITION, "warning")]


def repeated_pairs(df: DataFrame) -> DataFrame:
    return Q.duplicate_rows(df, PAIR, "repeated (race, driver)")


def results_report(df: DataFrame) -> DataFrame:
    """(rule, severity, n) of every rule for cleaned results."""
    return Q.run_rules(df, results_rules()).unionByName(repeated_pairs(df))


def qualifying_report(df: DataFrame) -> DataFrame:
    return Q.run_rules(df, qualifying_rules()).unionByName(repeated_pairs(df))


def inputs_report(inputs: dict[str, DataFrame]) -> DataFrame:
    """Key rules over all tables of the master join."""
    keys = {"races": "raceId", "circuits": "circuitId", "drivers": "driverId", "constructors": "constructorId"}
    parts = [Q.duplicate_rows(inputs[t], [k], f"{t}.{k} repeated") for t, k in keys.items()]
    parts += [Q.duplicate_rows(inputs[t], PAIR, f"{t} pair repeated") for t in ("results", "qualifying")]
    required = {
        "results": H.RESULT_ID_COLUMNS, "races": ("raceId", "circuitId"), "qualifying": tuple(PAIR),
    }
    for name, columns in required.items():
        rules = [Q.Rule(f"{name}.{c} is null", "error", F.col(c).isNull()) for c in columns]
        parts.append(Q.run_rules(inputs[name], rules))
    return concat(parts)


def build_master(inputs: dict[str, DataFrame]) -> DataFrame:
    """Results with every dimension and the target, in master column order."""
    df = inputs["results"]
    keys = {
        "races": ["raceId"], "circuits": ["circuitId"], "drivers": ["driverId"],
        "constructors": ["constructorId"], "qualifying": PAIR,
    }
    for name, on in keys.items():
        columns = H.MASTER_DIMENSIONS[name]
        side = inputs[name].select(*[F.col(s).alias(t) for s, t in columns.items()])
        df = guarded_join(df, side, on, name)
    df = df.withColumn("winner", S.is_winner("positionOrder"))
    return df.select(*H.MASTER_COLUMNS)


def master_rules() -> list[Q.Rule]:
    rules = Q.not_null(*H.KEY_COLUMNS)
    for key, ref in (
        ("driverId", "driver_ref"), ("constructorId", "constructor_ref"), ("circuitId", "circuit_ref")
    ):
        rules.append(
            Q.Rule(f"{key} without a dimension row", "error", F.col(key).isNotNull() & F.col(ref).isNull())
        )
    return rules


def winners_report(df: DataFrame) -> DataFrame:
    winners = Q.events_without_one_winner(df, "raceId").agg(F.count(F.lit(1)).alias("n"))
    return winners.select(
        F.lit("races without one winner").alias("rule"), F.lit("warning").alias("severity"), "n"
    )


def master_report(df: DataFrame) -> DataFrame:
    """Rules of the joined table; a race without one winner only warns."""
    H.require_schema(df, H.MASTER_COLUMNS)
    return concat([Q.run_rules(df, master_rules()), repeated_pairs(df), winners_report(df)])


def features_rules() -> list[Q.Rule]:
    return Q.not_null(*H.KEY_COLUMNS, H.TARGET)


def require_feature_columns(df: DataFrame) -> DataFrame:
    H.require_schema(df, H.FEATURE_TABLE_COLUMNS)
    if H.leaked_outcomes(df.columns):
        raise H.SchemaError(f"outcome columns in the features: {H.leaked_outcomes(df.columns)}")
    return df


def features_report(df: DataFrame, master: DataFrame) -> DataFrame:
    """Rules of the feature table, with the row count against the master table."""
    require_feature_columns(df)
    rows = F.count(F.lit(1))
    counted = df.agg(F.abs(rows - master.agg(rows).scalar()).alias("n")).select(
        F.lit("row count differs from master").alias("rule"), F.lit("error").alias("severity"), "n"
    )
    nulls = Q.null_rates(df, WATCHED_NULLS).select(
        F.concat(F.col("column"), F.lit(" mostly null")).alias("rule"),
        F.lit("warning").alias("severity"),
        F.coalesce(F.col("warn"), F.lit(False)).cast("long").alias("n"),
    )
    return concat(
        [
            Q.run_rules(df, features_rules()),
            repeated_pairs(df),
            counted,
            nulls,
        ]
    )


def load_raw(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The raw CSV tables of ``folder`` under their schemas."""
    tables = {
        "results": H.RESULTS, "qualifying": H.QUALIFYING, "races": H.RACES, "circuits": H.CIRCUITS,
        "drivers": H.DRIVERS, "constructors": H.CONSTRUCTORS,
        "driver_standings": H.DRIVER_STANDINGS, "constructor_standings": H.CONSTRUCTOR_STANDINGS,
        "race_weather": H.WEATHER,
    }
    out = {}
    for name, struct in tables.items():
        header = files.load_csv(spark, f"{folder}/{name}.csv")
        missing = [c for c in struct.names if c not in header.columns]
        if missing:
            raise H.SchemaError(f"{name}.csv lacks {missing}")
        # Columns are taken by name: files may hold more, in any order.
        out[name] = header.select(*[F.col(f.name).cast(f.dataType) for f in struct.fields])
    return out


def interim(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Cleaned, repaired and checked results and qualifying next to the dimensions."""
    results = repair_results(clean_results(raw["results"]))
    Q.require(results_report(results))
    qualifying = clean_qualifying(raw["qualifying"])
    Q.require(qualifying_report(qualifying))
    return {**raw, "results": results, "qualifying": qualifying}


def racing_features(master: DataFrame, inputs: dict[str, DataFrame]) -> DataFrame:
    weather = inputs["race_weather"].withColumn(
        "conditions_changed", S.flag_from_text("conditions_changed")
    )
    built = build_features(
        master, inputs["driver_standings"], inputs["constructor_standings"], weather, RACING
    )
    return built.select(*H.FEATURE_TABLE_COLUMNS)


def run(spark: SparkSession, source: str, target: str, dry_run: bool = False) -> dict[str, DataFrame]:
    """Build and check all tables from the CSVs in ``source``; write them unless dry.

    Written are ``interim/results``, ``interim/qualifying``, ``master`` and
    ``features``. Rows are read and joined once a table: its write counts its rules.
    """
    if dry_run:
        return _dry(spark, source)
    raw = load_raw(spark, source)
    results = repair_results(_typed_results(raw["results"]))
    qualifying = Q.cast_strict(raw["qualifying"], QUALIFYING_TYPES)
    report = Report(spark)
    known = report.write("results", results, f"{target}/interim/results.parquet", results_rules())
    report.write("qualifying", qualifying, f"{target}/interim/qualifying.parquet", qualifying_rules())
    inputs = {
        **raw,
        "results": spark.read.parquet(f"{target}/interim/results.parquet"),
        "qualifying": spark.read.parquet(f"{target}/interim/qualifying.parquet"),
    }
    report.add("inputs", inputs_report(inputs))
    master = H.require_schema(build_master(inputs), H.MASTER_COLUMNS)
    joined = report.write(
        "master", master, f"{target}/master.parquet", master_rules(), known.count(), [repeated_pairs, winners_report]
    )
    master = spark.read.parquet(f"{target}/master.parquet").select(*H.MASTER_COLUMNS)
    features = require_feature_columns(racing_features(master, inputs))
    nulls = Q.not_null(*WATCHED_NULLS, severity="note")
    report.write("features", features, f"{target}/features.parquet", [*features_rules(), *nulls], joined.count())
    features = spark.read.parquet(f"{target}/features.parquet").select(*H.FEATURE_TABLE_COLUMNS)
    return {"master": master, "features": features, "report": report.table()}


class Report:
    """The rules of a run, table by table: (table, rule, severity, n)."""

    def __init__(self, spark: SparkSession):
        self._spark, self._rows = spark, []

    def table(self) -> DataFrame:
        return self._spark.createDataFrame(self._rows, f"table string, {Q.REPORT}")

    def add(self, name: str, *reports: DataFrame) -> None:
        """Keep the rows (one a rule) and raise with all broken error rules."""
        rows = [(r["rule"], r["severity"], r["n"]) for r in concat(list(reports)).collect()]
        self._rows += [(name, *r) for r in rows]
        Q.require(self._spark.createDataFrame(rows, Q.REPORT))

    def write(self, name, df, path, rules, rows=None, keyed=(repeated_pairs,)) -> Q.Observed:
        """Write ``df`` while counting ``rules``; ``rows`` is how many it must have.

        ``keyed`` are reports on keys of the written rows.
        """

        def check(seen: Q.Observed, written: DataFrame) -> None:
            known = [seen.report()]
            if rows is not None:
                lost = abs(seen.count() - rows)
                known.append(Q.counted(self._spark, "row count differs from the step before", "error", lost))
            self.add(name, *known, *[report(written) for report in keyed])

        return files.write_checked(df, path, rules, ["year"] if "year" in df.columns else [], check)


def _dry(spark: SparkSession, source: str) -> dict[str, DataFrame]:
    inputs = interim(load_raw(spark, source))
    Q.require(inputs_report(inputs))
    master = build_master(inputs)
    Q.require(master_report(master))
    features = racing_features(master, inputs)
    Q.require(features_report(features, master))
    return {"master": master, "features": features}
