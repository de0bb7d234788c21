"""Column expressions over whole tables (SURVEY section C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from formbook.catalog.features import KEYS, LAP, TIMED_CTE, pick
from formbook.catalog.registry import query, r6
from formbook.catalog.sqltext import sql
from formbook.functions import scalars as S
from formbook.operators.joins import join_back, within_windows
from formbook.plans import contest
from formbook.plans.splits import ERAS
from formbook.sources.tables import table


@query(
    "c1_select_and_rename",
    """SELECT n_nationkey AS group_id, n_name AS group_name, n_regionkey AS region_id, r_name AS region_name
    FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def c1(spark, folder):
    nation = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("group_id"),
        F.col("n_name").alias("group_name"),
        F.col("n_regionkey").alias("region_id"),
    )
    region = table(spark, folder, "region").select(
        F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region_name")
    )
    return nation.join(region, "region_id")


def with_status(facts):
    return facts.withColumn("result_status", S.result_status("position_text", "status_id"))


@query(
    "c2_result_status",
    sql("SELECT event_id, entity_id, result_status FROM statused", "statused"),
)
def c2(spark, folder):
    return with_status(contest.facts(spark, folder)).select(*KEYS, "result_status")


@query(
    "c3_finished_flag",
    sql("SELECT event_id, entity_id, result_status = 'Finished' AS is_finished FROM statused", "statused"),
)
def c3(spark, folder):
    df = with_status(contest.facts(spark, folder))
    return df.select(*KEYS, S.is_finished("result_status").alias("is_finished"))


# Raw positions with gaps for finishers and leftovers for the rest.
RAW_POSITION_SQL = (
    "CASE WHEN entity_id % 23 = 0 THEN NULL WHEN entity_id % 29 = 0 THEN finish_order ELSE position END"
)


def raw_position():
    e = F.col("entity_id")
    return F.when(e % 23 == 0, None).when(e % 29 == 0, F.col("finish_order")).otherwise(
        F.col("position")
    )


@query(
    "c4_position_repair",
    sql(
        f"""SELECT event_id, entity_id, CASE WHEN finished = 1 AND {RAW_POSITION_SQL} IS NULL
        THEN TRY_CAST(position_text AS BIGINT) ELSE {RAW_POSITION_SQL} END AS position FROM contest""",
        "contest",
    ),
)
def c4(spark, folder):
    df = contest.facts(spark, folder).withColumn("raw", raw_position())
    fixed = S.repaired_position("raw", "position_text", F.col("finished") == 1)
    return df.select(*KEYS, fixed.alias("position"))


@query("c5_target", sql("SELECT event_id, entity_id, winner FROM contest", "contest"))
def c5(spark, folder):
    return contest.facts(spark, folder).select(*KEYS, S.is_winner("finish_order").alias("winner"))


@query(
    "c6_lap_time",
    sql(
        f"SELECT event_id, entity_id, round({LAP.format(c='q1')}, 6) AS q1_sec, round({LAP.format(c='q3')}, 6) AS q3_sec, "
        f"{LAP.format(c='position_text')} AS text_sec FROM contest",
        "contest",
    ),
)
def c6(spark, folder):
    df = contest.facts(spark, folder)
    return df.select(
        *KEYS,
        r6(S.lap_seconds("q1"), "q1_sec"),
        r6(S.lap_seconds("q3"), "q3_sec"),
        S.lap_seconds("position_text").alias("text_sec"),
    )


STRICT = (
    "CASE WHEN contains({c}, ':') THEN TRY_CAST(split_part({c}, ':', 1) AS INTEGER) * 60 "
    "+ TRY_CAST(split_part({c}, ':', 2) AS DOUBLE) END"
)


@query(
    "c7_strict_lap_time",
    sql(
        f"SELECT event_id, entity_id, round({STRICT.format(c='q1')}, 6) AS q1_sec, {STRICT.format(c='position_text')} AS text_sec FROM contest",
        "contest",
    ),
)
def c7(spark, folder):
    return contest.facts(spark, folder).select(
        *KEYS,
        r6(S.strict_lap_seconds("q1"), "q1_sec"),
        S.strict_lap_seconds("position_text").alias("text_sec"),
    )


@query(
    "c8_sessions_reached",
    sql("SELECT event_id, entity_id, q2 IS NOT NULL AS reached_q2, q3 IS NOT NULL AS reached_q3 FROM contest", "contest"),
)
def c8(spark, folder):
    return contest.facts(spark, folder).select(
        *KEYS,
        F.col("q2").isNotNull().alias("reached_q2"),
        F.col("q3").isNotNull().alias("reached_q3"),
    )


@query(
    "c9_best_session_time",
    sql("SELECT event_id, entity_id, COALESCE(q3, q2, q1) AS best FROM contest", "contest"),
)
def c9(spark, folder):
    return contest.facts(spark, folder).select(*KEYS, S.best_time("q3", "q2", "q1").alias("best"))


def _with_field(facts):
    return join_back(facts, ["event_id"], F.count("entity_id").alias("field_size"))


@query(
    "c10_pit_lane_remap",
    sql(f"WITH {TIMED_CTE} SELECT event_id, entity_id, CAST(adjusted AS BIGINT) AS grid_adjusted FROM bested", "contest"),
)
def c10(spark, folder):
    df = _with_field(contest.facts(spark, folder))
    return df.select(*KEYS, S.adjusted_grid("grid", "field_size").alias("grid_adjusted"))


@query(
    "c11_event_norm",
    sql(f"WITH {TIMED_CTE} SELECT event_id, entity_id, round(adjusted / field_size, 6) AS norm FROM bested", "contest"),
)
def c11(spark, folder):
    df = _with_field(contest.facts(spark, folder))
    return df.select(
        *KEYS, r6(F.try_divide(S.adjusted_grid("grid", "field_size"), "field_size"), "norm")
    )


@query(
    "c12_penalty_flag",
    sql(
        f"WITH {TIMED_CTE} SELECT event_id, entity_id, COALESCE(adjusted - position > 3, false) AS penalty FROM bested",
        "contest",
    ),
)
def c12(spark, folder):
    df = _with_field(contest.facts(spark, folder))
    gap = S.adjusted_grid("grid", "field_size") - F.col("position")
    return df.select(*KEYS, S.over_threshold(gap, S.PENALTY_PLACES).alias("penalty"))


@query(
    "c13_finish_normalised",
    sql(
        """SELECT event_id, entity_id, CASE WHEN regexp_matches(position_text, '^[0-9]+$') THEN CAST(position_text AS BIGINT) END AS position,
        position_text, CASE WHEN regexp_matches(position_text, '^[0-9]+$') THEN 1 ELSE 31 END AS status_id FROM contest""",
        "contest",
    ),
)
def c13(spark, folder):
    df = contest.facts(spark, folder)
    return df.select(*KEYS, S.finish_normalised("position_text").alias("f")).select(*KEYS, "f.*")


@query(
    "c14_flag_text",
    sql(
        "SELECT event_id, CASE changed_text WHEN 'True' THEN 1.0 WHEN 'False' THEN 0.0 END AS changed FROM conditions",
        "conditions",
    ),
)
def c14(spark, folder):
    df = contest.conditions(contest.facts(spark, folder))
    return df.select("event_id", S.flag_from_text("changed_text").alias("changed"))


@query(
    "c15_wet_and_changed",
    sql(
        "SELECT event_id, precip > 0.2 AS wet, (quali_precip > 0.2) <> (precip > 0.2) AS changed FROM conditions",
        "conditions",
    ),
)
def c15(spark, folder):
    df = contest.conditions(contest.facts(spark, folder))
    return df.select(
        "event_id",
        S.is_wet("precip").alias("wet"),
        S.condition_changed("quali_precip", "precip").alias("changed"),
    )


@query(
    "c16_wet_dry_unknown",
    sql(
        "SELECT event_id, entity_id, COALESCE(precip > 0.2, false) AS is_wet, COALESCE(precip <= 0.2, false) AS is_dry FROM contest",
        "contest",
    ),
)
def c16(spark, folder):
    wet = S.is_wet("precip")
    return contest.facts(spark, folder).select(
        *KEYS,
        F.coalesce(wet, F.lit(False)).alias("is_wet"),
        F.coalesce(~wet, F.lit(False)).alias("is_dry"),
    )


@query(
    "c17_season_window",
    sql("SELECT event_id, entity_id FROM contest WHERE season BETWEEN 1996 AND 1999", "contest"),
)
def c17(spark, folder):
    return contest.facts(spark, folder).where("season BETWEEN 1996 AND 1999").select(*KEYS)


@query(
    "c18_era_lookup",
    sql(
        """SELECT event_id, entity_id, CASE WHEN season BETWEEN 1995 AND 1996 THEN 'first' WHEN season BETWEEN 1997 AND 1998 THEN 'second'
        WHEN season BETWEEN 1999 AND 2000 THEN 'third' END AS era FROM contest""",
        "contest",
    ),
)
def c18(spark, folder):
    # Without the open era, so that the last seasons have none.
    closed = [era for era in ERAS if era[-1] is not None]
    return within_windows(contest.facts(spark, folder), "season", closed, ["era"], outer=True).select(*KEYS, "era")


@query(
    "c19_labels",
    sql(
        """SELECT DISTINCT event_id, CASE WHEN venue_id % 2 = 1 THEN 'Venue ' || venue_id ELSE 'Round ' || round || ' · ' || season END AS label
        FROM contest""",
        "contest",
    ),
)
def c19(spark, folder):
    venue = F.col("venue_id")
    name = F.when(venue % 2 == 1, F.concat_ws(" ", F.lit("Venue"), venue.cast("string")))
    return (
        contest.facts(spark, folder)
        .select("event_id", S.event_label(name, "season", "round").alias("label"))
        .distinct()
    )


@query(
    "c19_full_names",
    """SELECT c_custkey, concat_ws(' ', CASE WHEN c_custkey % 7 <> 0 THEN split_part(c_name, '#', 1) END, split_part(c_name, '#', 2)) AS full_name
    FROM customer""",
)
def c19_names(spark, folder):
    # The name's two parts; every seventh lacks the first.
    df = table(spark, folder, "customer", "c_custkey", "c_name")
    first = F.when(F.col("c_custkey") % 7 != 0, F.split_part("c_name", F.lit("#"), F.lit(1)))
    last = F.split_part("c_name", F.lit("#"), F.lit(2))
    return df.select("c_custkey", S.full_name(first, last).alias("full_name"))


@query(
    "c25_design_matrix",
    sql(
        f"""WITH {TIMED_CTE} SELECT event_id, entity_id, CAST(quali_position AS DOUBLE) AS qualifying_position,
        CAST(q3 IS NOT NULL AS DOUBLE) AS reached_q3, adjusted AS grid_adjusted, CAST(COALESCE(grid = 0, false) AS DOUBLE) AS pit_lane_start
        FROM bested""",
        "contest",
    ),
)
def c25(spark, folder):
    from formbook.plans.features import session_features
    from formbook.plans.models import design_matrix

    df = session_features(contest.facts(spark, folder))
    columns = ["qualifying_position", "reached_q3", "grid_adjusted", "pit_lane_start"]
    return design_matrix(df, columns, keys=list(KEYS))


@query(
    "c27_events_in_seasons",
    sql(
        "SELECT DISTINCT event_id, season, round, venue_id, venue_id % 5 AS region_id, r_name FROM contest "
        "JOIN region ON r_regionkey = venue_id % 5 WHERE season BETWEEN 1996 AND 2000",
        "contest",
    ),
)
def c27(spark, folder):
    events = (
        contest.facts(spark, folder)
        .where("season BETWEEN 1996 AND 2000")
        .select("event_id", "season", "round", "venue_id", (F.col("venue_id") % 5).alias("region_id"))
        .distinct()
    )
    region = table(spark, folder, "region").select(
        F.col("r_regionkey").cast("long").alias("region_id"), "r_name"
    )
    return events.join(region, "region_id").orderBy("season", "round")


@query(
    "c28_path_length",
    sql(
        """WITH pts AS (SELECT user_id, ts, event_id, (value % 90) AS lat, ((value * 7) % 180) AS lon FROM events),
        legs AS (SELECT user_id, lat AS a, lon AS b, LEAD(lat) OVER w AS c, LEAD(lon) OVER w AS d FROM pts WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT user_id, round(SUM(CASE WHEN c IS NOT NULL THEN 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(c - a) / 2), 2)
          + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2)))) END) / 1000, 3) AS km FROM legs GROUP BY user_id"""
    ),
)
def c28(spark, folder):
    from formbook.operators.paths import path_length

    points = table(spark, folder, "events", "user_id", "ts", "event_id", "value").select(
        "user_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        "event_id",
        (F.col("value") % 90).alias("lat"),
        ((F.col("value") * 7) % 180).alias("lon"),
    )
    out = path_length(points, ["user_id"], [("at", True), ("event_id", True)])
    return out.select("user_id", F.round(F.col("metres") / 1000, 3).alias("km"))
