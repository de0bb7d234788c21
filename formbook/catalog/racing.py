"""The raw-to-features pipeline on racing tables made from the given ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from formbook.catalog.registry import query
from formbook.catalog.scalars import RAW_POSITION_SQL, raw_position
from formbook.catalog.sqltext import sql
from formbook.plans import contest, pipeline
from formbook.schemas import MASTER_COLUMNS
from formbook.sources.tables import table


def racing_tables(spark, folder):
    """Results, qualifying and dimensions in the racing schema.

    Each finisher's result comes twice: once as an unfinished draft with a
    higher id, which the repair must drop.
    """
    facts = contest.facts(spark, folder)
    text, long_, double = "string", "long", "double"
    none = F.lit(None)
    results = facts.select(
        F.col("result_id").alias("resultId"),
        F.col("event_id").alias("raceId"),
        F.col("entity_id").alias("driverId"),
        F.col("group_id").alias("constructorId"),
        none.cast(long_).alias("number"),
        "grid",
        raw_position().alias("position"),
        F.col("position_text").alias("positionText"),
        F.col("finish_order").alias("positionOrder"),
        F.col("points").cast(double).alias("points"),
        F.col("finish_order").alias("laps"),
        none.cast(text).alias("time"),
        none.cast(long_).alias("milliseconds"),
        none.cast(long_).alias("fastestLap"),
        none.cast(long_).alias("rank"),
        F.col("q1").alias("fastestLapTime"),
        none.cast(double).alias("fastestLapSpeed"),
        F.col("status_id").alias("statusId"),
    )
    drafts = results.where(F.col("statusId") == 1).withColumns(
        {
            "resultId": F.col("resultId") + 10**9,
            "positionText": F.lit("R"),
            "position": none.cast(long_),
            "points": F.lit(0.0),
        }
    )
    qualifying = facts.where("q2 IS NOT NULL OR quali_position > 15").select(
        F.col("result_id").alias("qualifyId"),
        F.col("event_id").alias("raceId"),
        F.col("entity_id").alias("driverId"),
        F.col("group_id").alias("constructorId"),
        none.cast(long_).alias("number"),
        F.col("quali_position").alias("position"),
        "q1", "q2", "q3",
    )
    races = facts.select("event_id", "season", "round", "venue_id").distinct().select(
        F.col("event_id").alias("raceId"),
        F.col("season").alias("year"),
        "round",
        F.col("venue_id").alias("circuitId"),
        F.concat(F.lit("Event "), F.col("event_id").cast(text)).alias("name"),
        F.concat_ws("-", F.col("season").cast(text), F.lpad(F.col("round").cast(text), 2, "0"), F.lit("01")).alias("date"),
    )
    venue = F.col("venue_id")
    circuits = facts.select("venue_id").distinct().select(
        venue.alias("circuitId"),
        F.concat(F.lit("v"), venue.cast(text)).alias("circuitRef"),
        F.concat(F.lit("Venue "), venue.cast(text)).alias("name"),
        F.lit("Place").alias("location"),
        F.lit("Country").alias("country"),
        venue.cast(double).alias("lat"),
        (venue * 2).cast(double).alias("lng"),
        none.cast(double).alias("alt"),
    )
    drivers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("driverId"),
        F.col("c_name").alias("driverRef"),
        F.lit("COD").alias("code"),
        F.col("c_mktsegment").alias("forename"),
        F.col("c_name").alias("surname"),
        none.cast(text).alias("dob"),
        none.cast(text).alias("nationality"),
    )
    constructors = table(spark, folder, "nation").select(
        F.col("n_nationkey").cast(long_).alias("constructorId"),
        F.col("n_name").alias("constructorRef"),
        F.col("n_name").alias("name"),
        none.cast(text).alias("nationality"),
    )
    return {
        "results": results.unionByName(drafts),
        "qualifying": qualifying,
        "races": races,
        "circuits": circuits,
        "drivers": drivers,
        "constructors": constructors,
    }


@query(
    "master_build",
    sql(
        f"""SELECT event_id AS "raceId", entity_id AS "driverId", group_id AS "constructorId", venue_id AS "circuitId", season AS year, round,
        'Event ' || event_id AS race_name, season || '-' || lpad(CAST(round AS VARCHAR), 2, '0') || '-01' AS race_date,
        'v' || venue_id AS circuit_ref, 'Venue ' || venue_id AS circuit_name, c_name AS driver_ref, c_mktsegment AS driver_forename,
        n_name AS constructor_name, grid, quali_position AS qualifying_position, q1, q2, q3,
        CASE WHEN finished = 1 AND {RAW_POSITION_SQL} IS NULL THEN finish_order ELSE {RAW_POSITION_SQL} END AS position,
        position_text AS "positionText", finish_order AS "positionOrder", CAST(points AS DOUBLE) AS points, status_id AS "statusId", result_status,
        result_status = 'Finished' AS finished, winner
        FROM statused JOIN customer ON c_custkey = entity_id JOIN nation ON n_nationkey = group_id""",
        "statused",
    ),
)
def master_build(spark, folder):
    raw = racing_tables(spark, folder)
    results = pipeline.repair_results(pipeline.clean_results(raw["results"]))
    qualifying = pipeline.clean_qualifying(raw["qualifying"])
    master = pipeline.build_master({**raw, "results": results, "qualifying": qualifying})
    dropped = (
        "circuit_location", "circuit_country", "circuit_lat", "circuit_lng", "circuit_alt",
        "driver_code", "driver_surname", "driver_dob", "driver_nationality", "constructor_ref",
        "constructor_nationality", "laps", "milliseconds", "rank", "fastestLap", "fastestLapTime",
        "fastestLapSpeed",
    )
    return master.select(*[c for c in MASTER_COLUMNS if c not in dropped])


@query(
    "master_all_columns",
    sql(
        f"""SELECT event_id AS "raceId", entity_id AS "driverId", group_id AS "constructorId", venue_id AS "circuitId", season AS year, round,
        'Event ' || event_id AS race_name, season || '-' || lpad(CAST(round AS VARCHAR), 2, '0') || '-01' AS race_date,
        'v' || venue_id AS circuit_ref, 'Venue ' || venue_id AS circuit_name, 'Place' AS circuit_location, 'Country' AS circuit_country,
        CAST(venue_id AS DOUBLE) AS circuit_lat, CAST(venue_id * 2 AS DOUBLE) AS circuit_lng, CAST(NULL AS DOUBLE) AS circuit_alt,
        c_name AS driver_ref, 'COD' AS driver_code, c_mktsegment AS driver_forename, c_name AS driver_surname, CAST(NULL AS VARCHAR) AS driver_dob,
        CAST(NULL AS VARCHAR) AS driver_nationality, n_name AS constructor_ref, n_name AS constructor_name, CAST(NULL AS VARCHAR) AS constructor_nationality, grid,
        CASE WHEN quali_position <= 15 THEN quali_position END AS qualifying_position, CASE WHEN quali_position <= 15 THEN q1 END AS q1,
        CASE WHEN quali_position <= 15 THEN q2 END AS q2, CASE WHEN quali_position <= 15 THEN q3 END AS q3,
        CASE WHEN finished = 1 AND {RAW_POSITION_SQL} IS NULL THEN finish_order ELSE {RAW_POSITION_SQL} END AS position,
        position_text AS "positionText", finish_order AS "positionOrder", CAST(points AS DOUBLE) AS points, finish_order AS laps,
        CAST(NULL AS BIGINT) AS milliseconds, CAST(NULL AS BIGINT) AS rank, CAST(NULL AS BIGINT) AS "fastestLap", contest_q1 AS "fastestLapTime",
        CAST(NULL AS DOUBLE) AS "fastestLapSpeed", status_id AS "statusId", result_status, result_status = 'Finished' AS finished, winner
        FROM (SELECT *, q1 AS contest_q1 FROM statused) JOIN customer ON c_custkey = entity_id JOIN nation ON n_nationkey = group_id""",
        "statused",
    ),
)
def master_all(spark, folder):
    # Only the first fifteen qualified, so most results have no qualifying row.
    raw = racing_tables(spark, folder)
    results = pipeline.repair_results(pipeline.clean_results(raw["results"]))
    qualifying = pipeline.clean_qualifying(raw["qualifying"].where("position <= 15"))
    return pipeline.build_master({**raw, "results": results, "qualifying": qualifying})


@query(
    "input_suite",
    sql(
        """SELECT 'repeated (race, driver)' AS rule, 'error' AS severity, 2 * COUNT(*) AS n FROM contest WHERE status_id = 1
        UNION ALL SELECT 'finished without position', 'error', COUNT(*) FROM contest WHERE finished = 1 AND entity_id % 23 = 0
        UNION ALL SELECT 'raceId is null', 'error', COUNT(*) - COUNT(event_id) FROM contest""",
        "contest",
    ),
)
def input_suite(spark, folder):
    cleaned = pipeline.clean_results(racing_tables(spark, folder)["results"])
    report = pipeline.results_report(cleaned)
    return report.where(
        F.col("rule").isin("repeated (race, driver)", "finished without position", "raceId is null")
    )
