"""Windows and feature blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from formbook.catalog.registry import ORACLES, query, r6
from formbook.catalog.sqltext import sql
from formbook.functions import scalars as S
from formbook.operators.frames import Prior, prior_frames
from formbook.operators.hot import average_rank, rank_within
from formbook.operators.joins import calendar_of, join_back, neighbours
from formbook.plans import contest, features as P
from formbook.schemas import FEATURE_COLUMNS

KEYS = ("event_id", "entity_id")


def pick(df, *cols, keys=KEYS):
    """Keys and ``cols``, doubles rounded for the check."""
    types = dict(df.dtypes)
    return df.select(*keys, *[r6(c) if types[c] == "double" else F.col(c) for c in cols])


@query(
    "contest_facts",
    sql(
        "SELECT * EXCLUDE (precip, temp, quali_precip), round(precip, 6) AS precip, "
        "round(temp, 6) AS temp, round(quali_precip, 6) AS quali_precip FROM contest",
        "contest",
    ),
)
def contest_facts(spark, folder):
    df = contest.facts(spark, folder)
    return df.withColumns({c: F.round(c, 6) for c in ("precip", "temp", "quali_precip")})


@query("standings_running", sql("SELECT * FROM standings", "standings"))
def standings_running(spark, folder):
    return contest.standings(contest.facts(spark, folder))


@query("group_standings_running", sql("SELECT * FROM group_standings", "group_standings"))
def group_standings_running(spark, folder):
    return contest.group_standings(contest.facts(spark, folder))


ENTITY_FORM_SQL = """
  CAST(SUM(winner) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS DOUBLE) AS driver_wins_last_3,
  CAST(SUM(winner) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS DOUBLE) AS driver_wins_last_5,
  CAST(SUM(winner) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS DOUBLE) AS driver_wins_last_10,
  CAST(SUM(CASE WHEN finish_order <= 3 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS DOUBLE) AS driver_podiums_last_5,
  round(AVG(finish_order) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS driver_avg_finish_last_5,
  round(AVG(1 - finished) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS driver_dnf_rate_last_5,
  CAST(SUM(points) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS DOUBLE) AS driver_points_last_5,
  ROW_NUMBER() OVER (w) - 1 AS driver_experience_races"""
ENTITY_WINDOW = "WINDOW w AS (PARTITION BY entity_id ORDER BY season, round)"


@query(
    "f1_prior_rolling",
    sql(
        "SELECT event_id, entity_id, CAST(SUM(points) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS DOUBLE) AS points_last_3, "
        "round(AVG(finish_order) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS finish_last_3 "
        f"FROM contest {ENTITY_WINDOW}",
        "contest",
    ),
)
def f1(spark, folder):
    df = prior_frames(
        contest.facts(spark, folder),
        ["entity_id"],
        P.CONTEST.time(),
        [
            Prior("points_last_3", F.col("points"), "sum", 3),
            Prior("finish_last_3", F.col("finish_order"), "avg", 3),
        ],
    )
    return pick(df, "points_last_3", "finish_last_3")


@query(
    "f2_entity_form",
    sql(f"SELECT event_id, entity_id, {ENTITY_FORM_SQL} FROM contest {ENTITY_WINDOW}", "contest"),
)
def f2(spark, folder):
    df = P.entity_form(contest.facts(spark, folder))
    return pick(df, *[f.out for f in P.entity_form_frames(P.CONTEST)])


@query(
    "f3_experience",
    sql(
        f"SELECT event_id, entity_id, ROW_NUMBER() OVER w - 1 AS experience FROM contest {ENTITY_WINDOW}",
        "contest",
    ),
)
def f3(spark, folder):
    frame = [Prior("experience", F.lit(1), "count")]
    df = prior_frames(contest.facts(spark, folder), ["entity_id"], P.CONTEST.time(), frame)
    return pick(df, "experience")


GROUP_FORM_SQL = """
  CAST(SUM(win) OVER (g ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS DOUBLE) AS constructor_wins_last_3,
  CAST(SUM(win) OVER (g ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS DOUBLE) AS constructor_wins_last_5,
  CAST(SUM(podiums) OVER (g ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS DOUBLE) AS constructor_podiums_last_5,
  round(AVG(dnf_rate) OVER (g ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS constructor_dnf_rate_last_5"""


@query(
    "f4_group_form",
    sql(
        f"""WITH rolled AS (SELECT group_id, event_id, {GROUP_FORM_SQL} FROM group_events
        WINDOW g AS (PARTITION BY group_id ORDER BY season, round))
        SELECT c.event_id, c.entity_id, rolled.* EXCLUDE (group_id, event_id)
        FROM contest c JOIN rolled USING (group_id, event_id)""",
        "group_events",
    ),
)
def f4(spark, folder):
    df = P.group_form(contest.facts(spark, folder))
    return pick(df, *[f.out for f in P.group_form_frames()])


VENUE_SQL = """
  ROW_NUMBER() OVER (v) - 1 AS driver_circuit_starts,
  COALESCE(CAST(SUM(winner) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0) AS driver_circuit_wins,
  round(AVG(finish_order) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS driver_circuit_avg_finish"""
VENUE_WINDOW = "WINDOW v AS (PARTITION BY entity_id, venue_id ORDER BY season, round)"


@query(
    "f5_venue_history",
    sql(f"SELECT event_id, entity_id, {VENUE_SQL} FROM contest {VENUE_WINDOW}", "contest"),
)
def f5(spark, folder):
    df = P.venue_history(contest.facts(spark, folder))
    return pick(df, "driver_circuit_starts", "driver_circuit_wins", "driver_circuit_avg_finish")


GROUP_VENUE_SQL = (
    "COALESCE(CAST(SUM(win) OVER (PARTITION BY group_id, venue_id ORDER BY season, round "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0) AS constructor_circuit_wins"
)


@query(
    "f6_group_venue_wins",
    sql(
        f"""WITH rolled AS (SELECT group_id, event_id, {GROUP_VENUE_SQL} FROM group_events)
        SELECT event_id, entity_id, constructor_circuit_wins
        FROM contest JOIN rolled USING (group_id, event_id)""",
        "group_events",
    ),
)
def f6(spark, folder):
    return pick(P.venue_history(contest.facts(spark, folder)), "constructor_circuit_wins")


@query(
    "f7_leave_one_out_mean",
    sql(
        """SELECT event_id, entity_id,
        round(((SUM(quali_position) OVER w) - quali_position) / nullif((COUNT(quali_position) OVER w) - 1, 0), 6) AS quali_rest,
        round(((SUM(position) OVER w) - position) / nullif((COUNT(position) OVER w) - 1, 0), 6) AS position_rest
        FROM contest WINDOW w AS (PARTITION BY event_id, group_id)""",
        "contest",
    ),
)
def f7(spark, folder):
    df = P.leave_one_out(
        contest.facts(spark, folder),
        ["event_id", "group_id"],
        {"quali_position": "quali_rest", "position": "position_rest"},
    )
    return pick(df, "quali_rest", "position_rest")


PEER_CTE = """peer AS (SELECT *,
  ((SUM(quali_position) OVER w) - quali_position) / nullif((COUNT(quali_position) OVER w) - 1, 0) - quali_position AS quali_gap,
  ((SUM(finish_order) OVER w) - finish_order) / nullif((COUNT(finish_order) OVER w) - 1, 0) - finish_order AS pace_gap
  FROM contest WINDOW w AS (PARTITION BY event_id, group_id))"""
PEER_SQL = """
  round(quali_gap, 6) AS qualifying_gap_to_teammate_current,
  round(AVG(quali_gap) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS qualifying_gap_to_teammate,
  round(AVG(pace_gap) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS race_pace_delta_to_teammate"""


@query(
    "f8_peer_form",
    sql(
        f"WITH {PEER_CTE} SELECT event_id, entity_id, {PEER_SQL} FROM peer {ENTITY_WINDOW}",
        "contest",
    ),
)
def f8(spark, folder):
    df = P.peer_form(contest.facts(spark, folder))
    return pick(
        df, "qualifying_gap_to_teammate_current", "qualifying_gap_to_teammate",
        "race_pace_delta_to_teammate",
    )


LAP = r"CASE WHEN regexp_matches({c}, '^\s*(?:(\d+):)?(\d{{1,2}}(?:\.\d+)?)\s*$') THEN COALESCE(TRY_CAST(regexp_extract({c}, '^\s*(?:(\d+):)?(\d{{1,2}}(?:\.\d+)?)\s*$', 1) AS DOUBLE), 0) * 60 + TRY_CAST(regexp_extract({c}, '^\s*(?:(\d+):)?(\d{{1,2}}(?:\.\d+)?)\s*$', 2) AS DOUBLE) END"
TIMED_CTE = (
    "timed AS (SELECT *, "
    + ", ".join(f"{LAP.format(c=c)} AS {c}_sec" for c in ("q1", "q2", "q3"))
    + ", COUNT(entity_id) OVER (PARTITION BY event_id) AS field_size FROM contest),"
    "bested AS (SELECT *, COALESCE(q3_sec, q2_sec, q1_sec) AS best, "
    "CAST(CASE WHEN grid = 0 THEN field_size + 1 ELSE grid END AS DOUBLE) AS adjusted FROM timed)"
)
SESSION_SQL = """
  quali_position AS qualifying_position, round(q1_sec, 6) AS q1_sec, round(q2_sec, 6) AS q2_sec, round(q3_sec, 6) AS q3_sec,
  q2 IS NOT NULL AS reached_q2, q3 IS NOT NULL AS reached_q3,
  round((best - MIN(best) OVER (PARTITION BY event_id)) / (MIN(best) OVER (PARTITION BY event_id)) * 100, 6) AS qualifying_gap_to_pole_pct,
  COALESCE(grid = 0, false) AS pit_lane_start, adjusted AS grid_adjusted,
  round(adjusted / field_size, 6) AS grid_position_norm,
  COALESCE(adjusted - quali_position > 3, false) AS grid_penalty_applied"""


@query(
    "session_features",
    sql(f"WITH {TIMED_CTE} SELECT event_id, entity_id, {SESSION_SQL} FROM bested", "contest"),
)
def session_block(spark, folder):
    df = P.session_features(contest.facts(spark, folder))
    return pick(
        df, "qualifying_position", "q1_sec", "q2_sec", "q3_sec", "reached_q2", "reached_q3",
        "qualifying_gap_to_pole_pct", "pit_lane_start", "grid_adjusted", "grid_position_norm",
        "grid_penalty_applied",
    )


@query(
    "f9_gap_to_best",
    sql(
        f"WITH {TIMED_CTE} SELECT event_id, entity_id, round((best - MIN(best) OVER w) / (MIN(best) OVER w) * 100, 6) AS gap_pct "
        "FROM bested WINDOW w AS (PARTITION BY event_id)",
        "contest",
    ),
)
def f9(spark, folder):
    timed = contest.facts(spark, folder).withColumn(
        "best", S.best_time(*[S.lap_seconds(c) for c in ("q3", "q2", "q1")])
    )
    df = join_back(timed, ["event_id"], F.min("best").alias("pole"))
    gap = F.try_divide(F.col("best") - F.col("pole"), "pole") * 100
    return pick(df.withColumn("gap_pct", gap), "gap_pct")


@query(
    "f10_field_size",
    sql(
        "SELECT event_id, entity_id, COUNT(entity_id) OVER (PARTITION BY event_id) AS field_size FROM contest",
        "contest",
    ),
)
def f10(spark, folder):
    df = contest.facts(spark, folder).select(*KEYS)
    return join_back(df, ["event_id"], F.count("entity_id").alias("field_size")).select(
        *KEYS, "field_size"
    )


@query("f11_previous_event", sql("SELECT * FROM prev_map", "prev_map"))
def f11(spark, folder):
    calendar = calendar_of(contest.facts(spark, folder))
    return neighbours(calendar).select("event_id", "prev_event_id")


WETDRY_CTE = """wetdry AS (SELECT *,
  AVG(CASE WHEN precip > 0.2 THEN finish_order END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wet_avg,
  COUNT(CASE WHEN precip > 0.2 THEN finish_order END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wet_n,
  AVG(CASE WHEN precip <= 0.2 THEN finish_order END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dry_avg
  FROM contest WINDOW w AS (PARTITION BY entity_id ORDER BY season, round)),
shrunk AS (SELECT *, wet_n / (wet_n + 8.0) * COALESCE(wet_avg - dry_avg, 0)
  + (1 - wet_n / (wet_n + 8.0)) * AVG(wet_avg - dry_avg) OVER (PARTITION BY event_id) AS delta FROM wetdry)"""
GROUP_WETDRY_CTE = """gwetdry AS (SELECT *,
  AVG(CASE WHEN precip > 0.2 THEN finish END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wet_avg,
  COUNT(CASE WHEN precip > 0.2 THEN finish END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wet_n,
  AVG(CASE WHEN precip <= 0.2 THEN finish END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dry_avg
  FROM group_events WINDOW w AS (PARTITION BY group_id ORDER BY season, round)),
gshrunk AS (SELECT *, wet_n / (wet_n + 8.0) * COALESCE(wet_avg - dry_avg, 0)
  + (1 - wet_n / (wet_n + 8.0)) * AVG(wet_avg - dry_avg) OVER (PARTITION BY event_id) AS delta FROM gwetdry)"""


@query(
    "f12_prior_masked_mean",
    sql(
        f"WITH {WETDRY_CTE} SELECT event_id, entity_id, round(wet_avg, 6) AS wet_avg, wet_n, round(dry_avg, 6) AS dry_avg FROM wetdry",
        "contest",
    ),
)
def f12(spark, folder):
    frames = P.condition_frames("finish_order", P.CONTEST, "e")
    df = prior_frames(contest.facts(spark, folder), ["entity_id"], P.CONTEST.time(), frames)
    return df.select(*KEYS, r6("_e_wet", "wet_avg"), F.col("_e_wet_n").alias("wet_n"), r6("_e_dry", "dry_avg"))


@query(
    "f13_shrunk_delta",
    sql(
        f"WITH {WETDRY_CTE} SELECT event_id, entity_id, round(delta, 6) AS driver_wet_dry_delta FROM shrunk",
        "contest",
    ),
)
def f13(spark, folder):
    frames = P.condition_frames("finish_order", P.CONTEST, "e")
    df = prior_frames(contest.facts(spark, folder), ["entity_id"], P.CONTEST.time(), frames)
    return pick(P.shrink(df, "e", "event_id", "driver_wet_dry_delta"), "driver_wet_dry_delta")


@query(
    "f14_group_shrunk_delta",
    sql(
        f"WITH {GROUP_WETDRY_CTE} SELECT event_id, group_id, round(delta, 6) AS constructor_wet_dry_delta FROM gshrunk",
        "group_events",
    ),
)
def f14(spark, folder):
    df = P.group_shrunk_delta(contest.facts(spark, folder))
    return pick(df, "constructor_wet_dry_delta", keys=("event_id", "group_id"))


@query(
    "feature_build",
    sql(
        f"""WITH {TIMED_CTE}, {PEER_CTE}, {WETDRY_CTE}, {GROUP_WETDRY_CTE},
        sess AS (SELECT event_id, entity_id, {SESSION_SQL} FROM bested),
        form AS (SELECT event_id, entity_id, {ENTITY_FORM_SQL} FROM contest {ENTITY_WINDOW}),
        peers AS (SELECT event_id, entity_id, {PEER_SQL} FROM peer {ENTITY_WINDOW}),
        venue AS (SELECT event_id, entity_id, {VENUE_SQL} FROM contest {VENUE_WINDOW}),
        gform AS (SELECT group_id, event_id, {GROUP_FORM_SQL} FROM group_events WINDOW g AS (PARTITION BY group_id ORDER BY season, round)),
        gvenue AS (SELECT group_id, event_id, {GROUP_VENUE_SQL} FROM group_events)
        SELECT c.event_id, c.entity_id, c.group_id, c.venue_id, c.season, c.round, c.winner,
          sess.* EXCLUDE (event_id, entity_id), form.* EXCLUDE (event_id, entity_id),
          gform.* EXCLUDE (event_id, group_id), peers.* EXCLUDE (event_id, entity_id),
          venue.* EXCLUDE (event_id, entity_id), gvenue.constructor_circuit_wins,
          s.position AS driver_standing_position_prev, s.points AS driver_standing_points_prev, s.wins AS driver_standing_wins_prev,
          gs.position AS constructor_standing_position_prev, gs.points AS constructor_standing_points_prev,
          round(c.precip, 6) AS race_precip_mm, round(c.temp, 6) AS race_temp_c, round(c.quali_precip, 6) AS quali_precip_mm,
          CASE cd.changed_text WHEN 'True' THEN 1.0 WHEN 'False' THEN 0.0 END AS conditions_changed,
          round(shrunk.delta, 6) AS driver_wet_dry_delta, round(gshrunk.delta, 6) AS constructor_wet_dry_delta
        FROM contest c JOIN sess USING (event_id, entity_id) JOIN form USING (event_id, entity_id)
        JOIN peers USING (event_id, entity_id) JOIN venue USING (event_id, entity_id)
        JOIN shrunk USING (event_id, entity_id)
        JOIN gform ON gform.group_id = c.group_id AND gform.event_id = c.event_id
        JOIN gvenue ON gvenue.group_id = c.group_id AND gvenue.event_id = c.event_id
        JOIN gshrunk ON gshrunk.group_id = c.group_id AND gshrunk.event_id = c.event_id
        JOIN conditions cd ON cd.event_id = c.event_id JOIN prev_map pm ON pm.event_id = c.event_id
        LEFT JOIN standings s ON s.event_id = pm.prev_event_id AND s.entity_id = c.entity_id
        LEFT JOIN group_standings gs ON gs.event_id = pm.prev_event_id AND gs.group_id = c.group_id""",
        "standings", "group_standings", "prev_map", "conditions",
    ),
)
def feature_build(spark, folder):
    return pick(
        features_of(spark, folder), *FEATURE_COLUMNS, "winner",
        keys=("event_id", "entity_id", "group_id", "venue_id", "season", "round"),
    )


def features_of(spark, folder):
    """The full feature frame of the contest facts."""
    standings, groups, conditions = contest.season_tables(spark, folder)
    return P.build_features(
        contest.facts(spark, folder), standings, groups, contest.weather_columns(conditions)
    )
