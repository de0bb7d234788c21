"""Table schemas, column roles and the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_L, _D, _S, _B = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


# --- fixed values: column names and types of the contest domain ---------------
RESULTS = _struct(
    resultId=_L, raceId=_L, driverId=_L, constructorId=_L, number=_L, grid=_L, position=_L,
    positionText=_S, positionOrder=_L, points=_D, laps=_L, time=_S, milliseconds=_L,
    fastestLap=_L, rank=_L, fastestLapTime=_S, fastestLapSpeed=_D, statusId=_L,
)
QUALIFYING = _struct(
    qualifyId=_L, raceId=_L, driverId=_L, constructorId=_L, number=_L, position=_L,
    q1=_S, q2=_S, q3=_S,
)
DRIVER_STANDINGS = _struct(
    driverStandingsId=_L, raceId=_L, driverId=_L, points=_D, position=_L, positionText=_S, wins=_L,
)
CONSTRUCTOR_STANDINGS = _struct(
    constructorStandingsId=_L, raceId=_L, constructorId=_L, points=_D, position=_L,
    positionText=_S, wins=_L,
)
RACES = _struct(raceId=_L, year=_L, round=_L, circuitId=_L, name=_S, date=_S)
CIRCUITS = _struct(
    circuitId=_L, circuitRef=_S, name=_S, location=_S, country=_S, lat=_D, lng=_D, alt=_D,
)
DRIVERS = _struct(
    driverId=_L, driverRef=_S, code=_S, forename=_S, surname=_S, dob=_S, nationality=_S,
)
CONSTRUCTORS = _struct(constructorId=_L, constructorRef=_S, name=_S, nationality=_S)
STATUS = _struct(statusId=_L, status=_S)
WEATHER = _struct(
    raceId=_L, race_precip_mm=_D, race_temp_c=_D, quali_precip_mm=_D, conditions_changed=_S,
)

RESULT_ID_COLUMNS = ("raceId", "driverId", "constructorId")

# Source column -> master column, per dimension.
MASTER_DIMENSIONS = {
    "races": {
        "raceId": "raceId", "year": "year", "round": "round", "circuitId": "circuitId",
        "name": "race_name", "date": "race_date",
    },
    "circuits": {
        "circuitId": "circuitId", "circuitRef": "circuit_ref", "name": "circuit_name",
        "location": "circuit_location", "country": "circuit_country", "lat": "circuit_lat",
        "lng": "circuit_lng", "alt": "circuit_alt",
    },
    "drivers": {
        "driverId": "driverId", "driverRef": "driver_ref", "code": "driver_code",
        "forename": "driver_forename", "surname": "driver_surname", "dob": "driver_dob",
        "nationality": "driver_nationality",
    },
    "constructors": {
        "constructorId": "constructorId", "constructorRef": "constructor_ref",
        "name": "constructor_name", "nationality": "constructor_nationality",
    },
    "qualifying": {
        "raceId": "raceId", "driverId": "driverId", "position": "qualifying_position",
        "q1": "q1", "q2": "q2", "q3": "q3",
    },
}

# Known only after the event: never a feature of the same event.
OUTCOME_COLUMNS = (
    "position", "positionText", "positionOrder", "points", "laps", "milliseconds", "rank",
    "fastestLap", "fastestLapTime", "fastestLapSpeed", "statusId", "result_status", "finished",
)

MASTER_COLUMNS = (
    "raceId", "driverId", "constructorId", "circuitId", "year", "round",
    "race_name", "race_date",
    "circuit_ref", "circuit_name", "circuit_location", "circuit_country",
    "circuit_lat", "circuit_lng", "circuit_alt",
    "driver_ref", "driver_code", "driver_forename", "driver_surname",
    "driver_dob", "driver_nationality",
    "constructor_ref", "constructor_name", "constructor_nationality",
    "grid", "qualifying_position", "q1", "q2", "q3",
    *OUTCOME_COLUMNS,
    "winner",
)

# Feature groups in build order.
FEATURE_GROUPS = {
    "qualifying": (
        "qualifying_position", "q1_sec", "q2_sec", "q3_sec", "reached_q2", "reached_q3",
        "qualifying_gap_to_pole_pct", "pit_lane_start", "grid_adjusted", "grid_position_norm",
        "grid_penalty_applied",
    ),
    "driver_form": (
        "driver_wins_last_3", "driver_wins_last_5", "driver_wins_last_10",
        "driver_podiums_last_5", "driver_avg_finish_last_5", "driver_dnf_rate_last_5",
        "driver_points_last_5", "driver_experience_races",
    ),
    "constructor_form": (
        "constructor_wins_last_3", "constructor_wins_last_5", "constructor_podiums_last_5",
        "constructor_dnf_rate_last_5",
    ),
    "teammate_form": (
        "qualifying_gap_to_teammate_current", "qualifying_gap_to_teammate",
        "race_pace_delta_to_teammate",
    ),
    "circuit_history": (
        "driver_circuit_starts", "driver_circuit_wins", "driver_circuit_avg_finish",
        "constructor_circuit_wins",
    ),
    "standings": (
        "driver_standing_position_prev", "driver_standing_points_prev",
        "driver_standing_wins_prev", "constructor_standing_position_prev",
        "constructor_standing_points_prev",
    ),
    "weather": ("race_precip_mm", "race_temp_c", "quali_precip_mm", "conditions_changed"),
    "wet_form": ("driver_wet_dry_delta", "constructor_wet_dry_delta"),
}

# How well a feature carries over from one rule era to the next.
ERA_SENSITIVE = (
    "driver_wins_last_3", "driver_wins_last_5", "driver_wins_last_10", "driver_podiums_last_5",
    "driver_points_last_5", "constructor_wins_last_3", "constructor_wins_last_5",
    "constructor_podiums_last_5", "constructor_dnf_rate_last_5", "driver_standing_points_prev",
    "driver_standing_wins_prev", "constructor_standing_points_prev",
)
EXPERIMENTAL = (
    "q1_sec", "q2_sec", "q3_sec",
    *FEATURE_GROUPS["circuit_history"], *FEATURE_GROUPS["weather"], *FEATURE_GROUPS["wet_form"],
)
EXCLUDED_GROUPS = ("wet_form",)
KEY_COLUMNS = ("raceId", "driverId", "constructorId", "circuitId", "year", "round")
TARGET = "winner"
# ------------------------------------------------------------------------------

FEATURE_COLUMNS = tuple(f for group in FEATURE_GROUPS.values() for f in group)
FEATURE_TABLE_COLUMNS = (*KEY_COLUMNS, *FEATURE_COLUMNS, TARGET)
FEATURE_CLASSES = {
    f: "era_sensitive" if f in ERA_SENSITIVE else "experimental" if f in EXPERIMENTAL else "stable"
    for f in FEATURE_COLUMNS
}


class SchemaError(ValueError):
    """Columns differ from the declared ones."""


def schema_differences(df: DataFrame, expected) -> dict[str, list[str]]:
    """Missing and extra columns against a closed schema; runs no job."""
    names = expected.names if isinstance(expected, T.StructType) else list(expected)
    return {
        "missing": [c for c in names if c not in df.columns],
        "extra": [c for c in df.columns if c not in names],
    }


def require_schema(df: DataFrame, expected) -> DataFrame:
    found = schema_differences(df, expected)
    if found["missing"] or found["extra"]:
        raise SchemaError(f"missing {found['missing']}, unexpected {found['extra']}")
    return df


def leaked_outcomes(columns) -> list[str]:
    """Outcome columns among ``columns``."""
    return [c for c in OUTCOME_COLUMNS if c in columns]


def active_features(excluded: tuple[str, ...] = EXCLUDED_GROUPS) -> list[str]:
    unknown = sorted(set(excluded) - set(FEATURE_GROUPS))
    if unknown:
        raise SchemaError(f"unknown feature groups {unknown}")
    return [f for g, fs in FEATURE_GROUPS.items() if g not in excluded for f in fs]


def feature_table(spark: SparkSession) -> DataFrame:
    """One row per feature: group, class, whether training leaves it out."""
    rows = [
        (f, g, FEATURE_CLASSES[f], g in EXCLUDED_GROUPS)
        for g, fs in FEATURE_GROUPS.items()
        for f in fs
    ]
    return spark.createDataFrame(rows, "feature string, grp string, class string, excluded boolean")


if leaked_outcomes(FEATURE_COLUMNS):
    raise SchemaError(f"outcome columns among the features: {leaked_outcomes(FEATURE_COLUMNS)}")
