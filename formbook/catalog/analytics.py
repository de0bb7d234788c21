"""Historical and season analytics (SURVEY section E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from formbook.catalog.features import KEYS
from formbook.catalog.ranking import scored_of
from formbook.catalog.registry import query, r6
from formbook.catalog.scalars import LAP, with_status
from formbook.catalog.sqltext import sql
from formbook.functions import scalars as S
from formbook.operators.joins import checked_join
from formbook.plans import analytics as A
from formbook.plans import contest
from formbook.plans.models import exact_medians
from formbook.sources.tables import table

WON = "(position = 1 AND finished = 1)"
PODIUM = "(position IN (1, 2, 3) AND finished = 1)"


def rounded(df, *doubles):
    return df.select(*[r6(c) if c in doubles else F.col(c) for c in df.columns])


@query("e1_event_summary", sql("SELECT event_id, season, round, COUNT(*) AS n_entrants FROM contest GROUP BY ALL", "contest"))
def e1(spark, folder):
    return A.event_summary(contest.facts(spark, folder))


@query(
    "e2_group_event_rollup",
    sql(
        "SELECT group_id, event_id, season, round, win, podiums, round(dnf_rate, 6) AS dnf_rate FROM group_events",
        "group_events",
    ),
)
def e2(spark, folder):
    from formbook.plans.features import group_events

    out = group_events(contest.facts(spark, folder))
    return out.select(
        "group_id", "event_id", "season", "round", F.col("win").cast("long"),
        F.col("podiums").cast("long"), r6("dnf_rate"),
    )


@query(
    "e3_venue_catalogue",
    sql(
        """SELECT v.venue_id, COUNT(DISTINCT c.event_id) AS events_held FROM (SELECT DISTINCT CAST(p_size AS BIGINT) AS venue_id FROM part) v
        LEFT JOIN contest c USING (venue_id) GROUP BY v.venue_id""",
        "contest",
    ),
)
def e3(spark, folder):
    venues = table(spark, folder, "part").select(F.col("p_size").cast("long").alias("venue_id")).distinct()
    return A.venue_catalogue(venues, contest.facts(spark, folder))


@query(
    "e4_venue_stats",
    sql(
        """SELECT venue_id, COUNT(DISTINCT event_id) AS events_held, MIN(season) AS first_season, MAX(season) AS last_season,
        round(AVG(CASE WHEN position IS NULL THEN 1.0 ELSE 0.0 END), 6) AS dnf_rate,
        round(CASE WHEN COUNT(CASE WHEN grid > 0 THEN position END) >= 3 THEN AVG(CASE WHEN grid > 0 THEN grid - position END) END, 6) AS avg_position_change
        FROM contest GROUP BY venue_id""",
        "contest",
    ),
)
def e4(spark, folder):
    return rounded(A.venue_stats(contest.facts(spark, folder)), "dnf_rate", "avg_position_change")


@query(
    "e5_fastest_lap",
    sql(
        f"""WITH laps AS (SELECT *, {LAP.format(c='q1')} AS seconds FROM contest)
        SELECT venue_id, q1 AS lap, round(seconds, 6) AS seconds, season, entity_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY venue_id
        ORDER BY seconds, season, round, entity_id) AS rn FROM laps WHERE seconds IS NOT NULL) WHERE rn = 1""",
        "contest",
    ),
)
def e5(spark, folder):
    out = A.fastest_laps(contest.facts(spark, folder), S.strict_lap_seconds("q1"), "q1")
    return rounded(out, "seconds")


@query(
    "e6_winners_by_season",
    sql("SELECT venue_id, season, entity_id, group_id FROM contest WHERE position = 1", "contest"),
)
def e6(spark, folder):
    return A.winners_by_season(contest.facts(spark, folder))


@query(
    "e6_most_wins",
    sql(
        """WITH w AS (SELECT venue_id, entity_id, COUNT(*) AS wins FROM contest WHERE position = 1 GROUP BY ALL)
        SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY venue_id ORDER BY wins DESC, entity_id) AS place FROM w) WHERE place <= 5""",
        "contest",
    ),
)
def e6_most(spark, folder):
    return A.most_wins(contest.facts(spark, folder))


@query(
    "e7_venue_risk",
    sql(
        """WITH y AS (SELECT venue_id, season, COUNT(DISTINCT event_id) AS events, COUNT(*) AS n, COUNT(*) - COUNT(position) AS dnf FROM contest GROUP BY ALL)
        SELECT a.venue_id, a.season, round(SUM(b.dnf) / SUM(b.n), 6) AS dnf_rate, CAST(SUM(b.events) AS BIGINT) AS n_events, MIN(b.season) AS from_season, MAX(b.season) AS to_season
        FROM y a JOIN y b ON a.venue_id = b.venue_id AND b.season < a.season AND b.season >= a.season - 5 GROUP BY a.venue_id, a.season HAVING SUM(b.events) >= 3""",
        "contest",
    ),
)
def e7(spark, folder):
    return rounded(A.venue_risk(contest.facts(spark, folder)), "dnf_rate")


ENTITY_STATS_SQL = """SELECT entity_id, season, COUNT(*) AS events, COUNT(CASE WHEN position = 1 THEN 1 END) AS wins,
    COUNT(CASE WHEN position <= 3 THEN 1 END) AS podiums, AVG(finish_order) AS avg_finish, AVG(position) AS avg_finish_classified,
    CASE WHEN COUNT(position) >= 3 THEN stddev_samp(position) END AS consistency_std,
    COUNT(CASE WHEN quali_position = 1 THEN 1 END) AS poles, AVG(quali_position) AS avg_quali
    FROM contest GROUP BY GROUPING SETS ((entity_id, season), (entity_id))"""
STAT_DOUBLES = ("avg_finish", "avg_finish_classified", "consistency_std", "avg_quali")


@query(
    "e8_entity_stats",
    sql(
        f"WITH st AS ({ENTITY_STATS_SQL}) SELECT * REPLACE ("
        + ", ".join(f"round({c}, 6) AS {c}" for c in STAT_DOUBLES)
        + ") FROM st",
        "contest",
    ),
)
def e8(spark, folder):
    return rounded(A.entity_stats(contest.facts(spark, folder)), *STAT_DOUBLES)


@query(
    "e9_group_stats",
    sql(
        """SELECT group_id, season, COUNT(DISTINCT event_id) AS events, COUNT(CASE WHEN position = 1 THEN 1 END) AS wins,
        COUNT(CASE WHEN position <= 3 THEN 1 END) AS podiums, round(AVG(quali_position), 6) AS avg_quali
        FROM contest GROUP BY GROUPING SETS ((group_id, season), (group_id))""",
        "contest",
    ),
)
def e9(spark, folder):
    return rounded(A.group_stats(contest.facts(spark, folder)), "avg_quali")


@query(
    "e10_group_event_results",
    sql(
        """SELECT group_id, event_id, season, round, MIN(finish_order) AS best_finish, round(AVG(quali_position), 6) AS avg_quali
        FROM contest GROUP BY ALL""",
        "contest",
    ),
)
def e10(spark, folder):
    return rounded(A.group_event_results(contest.facts(spark, folder)), "avg_quali")


FINAL_CTE = "final AS (SELECT * FROM standings s WHERE round = (SELECT MAX(round) FROM standings t WHERE t.season = s.season))"


@query(
    "e11_final_round_standings",
    sql(f"WITH {FINAL_CTE} SELECT event_id, season, entity_id, points, wins, position FROM final", "standings"),
)
def e11(spark, folder):
    out = A.final_standings(contest.standings(contest.facts(spark, folder)))
    return out.select("event_id", "season", "entity_id", "points", "wins", "position")


@query(
    "e12_official_points",
    sql(
        f"WITH {FINAL_CTE} SELECT entity_id, season, CAST(SUM(points) AS BIGINT) AS points FROM final GROUP BY GROUPING SETS ((entity_id, season), (entity_id))",
        "standings",
    ),
)
def e12(spark, folder):
    return A.official_points(contest.standings(contest.facts(spark, folder)), "entity_id")


@query(
    "e13_season_tables",
    sql(
        f"WITH {FINAL_CTE} SELECT season, position, c_name AS entity_name, points FROM final JOIN customer ON c_custkey = entity_id",
        "standings",
    ),
)
def e13(spark, folder):
    from formbook.catalog.joins import customers
    from formbook.operators.joins import checked_join

    final = A.final_standings(contest.standings(contest.facts(spark, folder)))
    named = checked_join(final, customers(spark, folder), ["entity_id"])
    return named.select("season", "position", "entity_name", "points").orderBy("season", "position")


@query(
    "e14_standings_progression",
    sql("SELECT entity_id, season, round, points, position, wins FROM standings WHERE season = 1998", "standings"),
)
def e14(spark, folder):
    # One season is the feature; its partition alone is read.
    season = contest.facts(spark, folder).where("season = 1998")
    out = contest.standings(season)
    return out.select("entity_id", "season", "round", "points", "position", "wins").orderBy(
        "entity_id", "round"
    )


@query(
    "e15_entity_log",
    sql("SELECT entity_id, season, round, grid, quali_position, finish_order FROM contest", "contest"),
)
def e15(spark, folder):
    df = contest.facts(spark, folder)
    return df.select("entity_id", "season", "round", "grid", "quali_position", "finish_order")


@query(
    "e16_group_roster",
    sql(
        "SELECT DISTINCT group_id, season, c_name AS entity_name FROM contest JOIN customer ON c_custkey = entity_id",
        "contest",
    ),
)
def e16(spark, folder):
    from formbook.catalog.joins import customers
    from formbook.operators.joins import checked_join

    roster = A.group_roster(contest.facts(spark, folder))
    named = checked_join(roster, customers(spark, folder), ["entity_id"])
    return named.select("group_id", "season", "entity_name").orderBy("group_id", "season", "entity_name")


@query(
    "e17_event_facts",
    sql(
        """SELECT event_id, MAX(finish_order) AS laps, MAX(CASE WHEN position = 1 THEN q1 END) AS fastest_lap,
        MAX(CASE WHEN quali_position = 1 THEN COALESCE(q3, q2, q1) END) AS pole_time FROM contest GROUP BY event_id""",
        "contest",
    ),
)
def e17(spark, folder):
    return A.event_facts(contest.facts(spark, folder))


@query(
    "e17_race_facts",
    sql(
        """SELECT event_id AS "raceId", 'Event ' || event_id AS grand_prix, season || '-' || lpad(CAST(round AS VARCHAR), 2, '0') || '-01' AS date,
        'Venue ' || venue_id AS circuit, 'Country' AS country, 'Place' AS location, laps, fastest_lap, pole_time
        FROM (SELECT DISTINCT event_id, season, round, venue_id FROM contest)
        JOIN (SELECT event_id, MAX(lines) AS laps, arg_min(q1, result_id) FILTER (lines = most) AS fastest_lap, MAX(CASE WHEN quali_position = 1 THEN COALESCE(q3, q2, q1) END) AS pole_time
          FROM (SELECT *, MAX(lines) OVER (PARTITION BY event_id) AS most FROM contest
            LEFT JOIN (SELECT l_orderkey AS result_id, COUNT(*) AS lines FROM lineitem GROUP BY l_orderkey) USING (result_id)) GROUP BY event_id) USING (event_id)""",
        "contest",
    ),
)
def e17_race(spark, folder):
    from formbook.catalog.racing import racing_tables

    raw = racing_tables(spark, folder)
    # A result's laps are the lines of its order; rank 1 goes to all with the most.
    lines = table(spark, folder, "lineitem", "l_orderkey").groupBy(F.col("l_orderkey").alias("resultId")).agg(
        F.count(F.lit(1)).alias("laps")
    )
    results = raw["results"].drop("laps", "rank").join(lines, "resultId", "left")
    most = results.groupBy("raceId").agg(F.max("laps").alias("_most"))
    rank = F.when(F.col("laps") == F.col("_most"), F.lit(1)).cast("long")
    results = checked_join(results, most, ["raceId"]).withColumn("rank", rank)
    return A.race_facts(results, raw["qualifying"], raw["races"], raw["circuits"])


@query(
    "e18_overview",
    sql(
        f"""SELECT COUNT(*) AS rows, MIN(season) AS first_season, MAX(season) AS last_season, COUNT(DISTINCT event_id) AS events,
        COUNT(DISTINCT entity_id) AS entities, COUNT(DISTINCT group_id) AS groups, COUNT(CASE WHEN {WON} THEN 1 END) AS wins,
        round(100.0 * COUNT(CASE WHEN {WON} THEN 1 END) / COUNT(*), 6) AS win_pct FROM contest""",
        "contest",
    ),
)
def e18(spark, folder):
    return rounded(A.overview(contest.facts(spark, folder)), "win_pct")


BY_GRID = f"""by_grid AS (SELECT grid, COUNT(*) AS starts, COUNT(CASE WHEN {WON} THEN 1 END) AS wins FROM contest WHERE grid > 0 GROUP BY grid)"""


@query(
    "e19_win_rate_by_grid",
    sql(f"WITH {BY_GRID} SELECT grid, starts, wins, round(100.0 * wins / starts, 6) AS win_rate FROM by_grid", "contest"),
)
def e19(spark, folder):
    return rounded(A.wins_by_grid(contest.facts(spark, folder)), "win_rate")


@query(
    "e20_top_grid_share",
    sql(
        f"""WITH {BY_GRID} SELECT top, round(100.0 * SUM(CASE WHEN grid <= top THEN wins END) / SUM(wins), 6) AS share
        FROM by_grid, (VALUES (1), (3), (5), (10)) AS t(top) WHERE grid <= 20 GROUP BY top""",
        "contest",
    ),
)
def e20(spark, folder):
    return rounded(A.top_grid_share(A.wins_by_grid(contest.facts(spark, folder))), "share")


GROUP_WINS = f"group_wins AS (SELECT season, group_id, COUNT(*) AS wins FROM contest WHERE {WON} GROUP BY ALL)"


@query("e21_wins_by_group_season", sql(f"WITH {GROUP_WINS} SELECT * FROM group_wins", "contest"))
def e21(spark, folder):
    return A.wins_by_group_season(contest.facts(spark, folder))


@query(
    "e21_top_groups",
    sql(
        f"WITH {GROUP_WINS} SELECT group_id, CAST(SUM(wins) AS BIGINT) AS wins FROM group_wins GROUP BY group_id ORDER BY wins DESC, group_id LIMIT 8",
        "contest",
    ),
)
def e21_top(spark, folder):
    return A.top_groups(A.wins_by_group_season(contest.facts(spark, folder)))


@query(
    "e22_wins_pivot",
    sql(
        f"""WITH {GROUP_WINS}, ranked_groups AS (SELECT group_id, ROW_NUMBER() OVER (ORDER BY SUM(wins) DESC, group_id) AS place FROM group_wins GROUP BY group_id)
        SELECT season, """
        + ", ".join(f"CAST(SUM(CASE WHEN place = {i} THEN wins ELSE 0 END) AS BIGINT) AS top_{i}" for i in range(1, 9))
        + " FROM group_wins JOIN ranked_groups USING (group_id) WHERE place <= 8 GROUP BY season",
        "contest",
    ),
)
def e22(spark, folder):
    return A.wins_pivot(A.wins_by_group_season(contest.facts(spark, folder)))


COMPOSITION = """comp AS (SELECT season, result_status, COUNT(*) AS count, 100.0 * COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY season) AS pct
    FROM statused GROUP BY season, result_status)"""


@query(
    "e22_status_pivot",
    sql(
        f"WITH {COMPOSITION} SELECT season, "
        + ", ".join(
            f"round(SUM(CASE WHEN result_status = '{s}' THEN pct ELSE 0 END), 6) AS {s.lower().replace(' ', '_')}"
            for s in A.STATUS_ORDER
        )
        + " FROM comp GROUP BY season",
        "statused",
    ),
)
def e22_status(spark, folder):
    out = A.status_pivot(A.status_composition(with_status(contest.facts(spark, folder))))
    return rounded(out, *[c for c in out.columns if c != "season"])


@query(
    "e23_concentration",
    sql(
        f"WITH {GROUP_WINS} SELECT season, round(SUM(wins * wins) / pow(SUM(wins), 2), 6) AS hhi FROM group_wins GROUP BY season",
        "contest",
    ),
)
def e23(spark, folder):
    return rounded(A.concentration(A.wins_by_group_season(contest.facts(spark, folder))), "hhi")


@query(
    "e23_era_concentration",
    sql(
        f"""WITH {GROUP_WINS}, h AS (SELECT season, SUM(wins * wins) / pow(SUM(wins), 2) AS hhi FROM group_wins GROUP BY season)
        SELECT CASE WHEN season <= 1996 THEN 'first' WHEN season <= 1998 THEN 'second' WHEN season <= 2000 THEN 'third' ELSE 'open' END AS era, round(AVG(hhi), 6) AS hhi FROM h GROUP BY 1""",
        "contest",
    ),
)
def e23_era(spark, folder):
    from formbook.operators.joins import within_windows
    from formbook.plans.splits import ERAS

    hhi = A.concentration(A.wins_by_group_season(contest.facts(spark, folder)))
    out = within_windows(hhi, "season", ERAS, ["era"]).groupBy("era").agg(F.avg("hhi").alias("hhi"))
    return rounded(out, "hhi")


LEADERS = f"""leaders AS (SELECT entity_id, COUNT(*) AS starts, COUNT(CASE WHEN {WON} THEN 1 END) AS wins, COUNT(CASE WHEN {PODIUM} THEN 1 END) AS podiums
    FROM contest GROUP BY entity_id HAVING COUNT(*) >= 10)"""


@query(
    "e24_career_leaders",
    sql(
        f"WITH {LEADERS} SELECT *, round(1.0 * wins / starts, 6) AS win_rate, round(1.0 * podiums / starts, 6) AS podium_rate FROM leaders",
        "contest",
    ),
)
def e24(spark, folder):
    # Ten starts are a long career in these tables.
    return rounded(A.career_leaders(contest.facts(spark, folder), 10), "win_rate", "podium_rate")


@query(
    "e24_rate_summary",
    sql(
        f"WITH {LEADERS} SELECT round(median(100.0 * wins / starts), 6) AS median_pct, round(AVG(100.0 * wins / starts), 6) AS mean_pct FROM leaders",
        "contest",
    ),
)
def e24_summary(spark, folder):
    careers = A.career_leaders(contest.facts(spark, folder), 10)
    pct = careers.select((100 * F.col("win_rate")).alias("pct"))
    # One row: the median of a column of any size.
    median = exact_medians(pct, ["pct"]).select("median").scalar()
    return pct.agg(F.avg("pct").alias("mean")).select(r6(median, "median_pct"), r6("mean", "mean_pct"))


def _histogram_sql(source, value, bins):
    return f"""SELECT CAST(least({bins} - 1, floor(({value} - lo) * {bins} / nullif(hi - lo, 0))) AS BIGINT) AS bin, COUNT(*) AS n
    FROM {source}, (SELECT MIN({value}) AS lo, MAX({value}) AS hi FROM {source}) GROUP BY 1"""


@query(
    "e25_balance_histogram",
    _histogram_sql("(SELECT CAST(round(c_acctbal * 100) AS BIGINT) AS v FROM customer)", "v", 25),
)
def e25(spark, folder):
    cents = table(spark, folder, "customer").select(F.round(F.col("c_acctbal") * 100).cast("long").alias("v"))
    return A.histogram(cents, "v", 25)


@query(
    "e25_favourite_histogram",
    sql(
        f"WITH picks AS (SELECT finish_order AS v FROM scored WHERE predicted_rank = 1) {_histogram_sql('picks', 'v', 12)}",
        "scored",
    ),
)
def e25_favourite(spark, folder):
    picks = A.top_picks(scored_of(spark, folder)).select(F.col("finish_order").alias("v"))
    return A.histogram(picks, "v", 12)


@query(
    "e26_status_composition",
    sql(f"WITH {COMPOSITION} SELECT season, result_status, count, round(pct, 6) AS pct FROM comp", "statused"),
)
def e26(spark, folder):
    return rounded(A.status_composition(with_status(contest.facts(spark, folder))), "pct")


@query(
    "e27_season_structure",
    sql(
        f"""SELECT season, COUNT(DISTINCT event_id) AS events, COUNT(DISTINCT entity_id) AS entities, COUNT(CASE WHEN grid = 1 THEN 1 END) AS pole_starts,
        COUNT(CASE WHEN grid = 1 AND {WON} THEN 1 END) AS pole_wins, round(100.0 * COUNT(CASE WHEN grid = 1 AND {WON} THEN 1 END) / nullif(COUNT(CASE WHEN grid = 1 THEN 1 END), 0), 6) AS conversion,
        MAX(points) AS max_points FROM contest GROUP BY season""",
        "contest",
    ),
)
def e27(spark, folder):
    return rounded(A.season_structure(contest.facts(spark, folder)), "conversion")


# Overlapping eras: the last contains the one before it.
OVERLAPPING = (("early", 1995, 1996), ("middle", 1997, 1998), ("modern", 1997, 2001), ("late", 1999, 2001))


@query(
    "e28_overlapping_eras",
    sql(
        f"""WITH eras(era, lo, hi) AS (VALUES ('early', 1995, 1996), ('middle', 1997, 1998), ('modern', 1997, 2001), ('late', 1999, 2001))
        SELECT era, COUNT(DISTINCT event_id) AS events, COUNT(*) AS entries, round(100.0 * COUNT(CASE WHEN grid = 1 AND {WON} THEN 1 END) / COUNT(CASE WHEN grid = 1 THEN 1 END), 1) AS pole_win_pct,
        round(100.0 * COUNT(CASE WHEN grid <= 3 AND {WON} THEN 1 END) / COUNT(CASE WHEN grid <= 3 THEN 1 END), 1) AS top3_win_pct, round(100.0 * SUM(finished) / COUNT(*), 1) AS finish_pct
        FROM contest JOIN eras ON season BETWEEN lo AND hi WHERE grid > 0 GROUP BY era""",
        "contest",
    ),
)
def e28(spark, folder):
    return A.era_rates(contest.facts(spark, folder), OVERLAPPING)


@query(
    "e29_before_and_after",
    sql(
        f"""SELECT season >= 1998 AS modern, round(100.0 * AVG(finished), 6) AS finish_pct,
        round(100.0 * COUNT(CASE WHEN grid = 1 AND {WON} THEN 1 END) / COUNT(CASE WHEN grid = 1 THEN 1 END), 6) AS pole_win_pct FROM contest GROUP BY 1""",
        "contest",
    ),
)
def e29(spark, folder):
    return rounded(A.before_and_after(contest.facts(spark, folder), 1998), "finish_pct", "pole_win_pct")


RADAR_POOL = f"""st AS ({ENTITY_STATS_SQL}), pool AS (SELECT entity_id, season, avg_quali, avg_finish_classified, consistency_std FROM st
    WHERE season IS NOT NULL AND avg_quali IS NOT NULL AND avg_finish_classified IS NOT NULL AND consistency_std IS NOT NULL)"""


@query(
    "e31_radar_pool",
    sql(
        f"WITH {RADAR_POOL} SELECT entity_id, season, round(avg_quali, 6) AS avg_quali, round(avg_finish_classified, 6) AS avg_finish_classified, round(consistency_std, 6) AS consistency_std FROM pool",
        "contest",
    ),
)
def e31(spark, folder):
    pool = A.radar_pool(A.entity_stats(contest.facts(spark, folder)))
    return rounded(pool, "avg_quali", "avg_finish_classified", "consistency_std")


def _radar_axis(c, name):
    lo, hi = f"MIN({c}) OVER (PARTITION BY season)", f"MAX({c}) OVER (PARTITION BY season)"
    return f"round(CASE WHEN {hi} <= {lo} THEN 100.0 ELSE 100 * (1 - ({c} - {lo}) / ({hi} - {lo})) END, 5) AS {name}"


@query(
    "e32_radar_scores",
    sql(
        f"""WITH {RADAR_POOL}, sized AS (SELECT *, COUNT(*) OVER (PARTITION BY season) AS n FROM pool)
        SELECT entity_id, season, {_radar_axis('avg_quali', 'qualifying_pace')}, {_radar_axis('avg_finish_classified', 'race_pace')}, {_radar_axis('consistency_std', 'consistency')} FROM sized WHERE n >= 2""",
        "contest",
    ),
)
def e32(spark, folder):
    out = A.radar_scores(A.radar_pool(A.entity_stats(contest.facts(spark, folder))))
    return out.select(
        "entity_id", "season",
        *[F.round(c, 5).alias(c) for c in ("qualifying_pace", "race_pace", "consistency")],
    )


@query(
    "e33_hit_rate",
    sql(
        """WITH e AS (SELECT season, event_id, MAX(CASE WHEN predicted_rank = 1 THEN winner END) AS hit, COUNT(*) AS field FROM scored GROUP BY ALL)
        SELECT season, COUNT(*) AS events, round(AVG(hit), 6) AS hit_rate, round(AVG(field), 6) AS mean_field FROM e GROUP BY season""",
        "scored",
    ),
)
def e33(spark, folder):
    return rounded(A.hit_rate(scored_of(spark, folder)), "hit_rate", "mean_field")


@query(
    "e34_most_picked",
    sql(
        "SELECT season, entity_id, COUNT(*) AS picks, arg_max(group_id, round) AS last_group FROM scored WHERE predicted_rank = 1 GROUP BY ALL",
        "scored",
    ),
)
def e34(spark, folder):
    return A.most_picked(scored_of(spark, folder))


@query(
    "e35_dominance",
    sql(
        "SELECT season, entity_id, round(AVG(p), 6) AS mean_share, COUNT(*) AS picks FROM scored WHERE predicted_rank <= 1 GROUP BY ALL HAVING COUNT(*) >= 1",
        "scored",
    ),
)
def e35(spark, folder):
    return rounded(A.dominance(scored_of(spark, folder), 1), "mean_share")


@query(
    "e35_dominance_of_two",
    sql(
        "SELECT season, group_id AS entity_id, round(AVG(p), 6) AS mean_share, COUNT(*) AS picks FROM scored WHERE predicted_rank = 1 GROUP BY ALL HAVING COUNT(*) >= 2",
        "scored",
    ),
)
def e35_two(spark, folder):
    # Groups are picked often enough for the library's least number of picks.
    scored = scored_of(spark, folder).drop("entity_id").withColumnRenamed("group_id", "entity_id")
    return rounded(A.dominance(scored), "mean_share")


@query(
    "e36_biggest_surprises",
    sql(
        """SELECT * FROM (SELECT season, event_id, entity_id, predicted_rank, ROW_NUMBER() OVER (PARTITION BY season ORDER BY predicted_rank DESC, event_id) AS place
        FROM scored WHERE winner = 1) WHERE place <= 3""",
        "scored",
    ),
)
def e36(spark, folder):
    out = A.biggest_surprises(scored_of(spark, folder))
    return out.select("season", "event_id", "entity_id", "predicted_rank", "place")


def halves_sql(by):
    return f"""halves AS (SELECT {by}, COUNT(*) AS events, AVG(predicted_rank) AS mean_rank, MIN(predicted_rank) AS best_rank, CAST(SUM(winner) AS BIGINT) AS wins,
      AVG(CASE WHEN pos <= n // 2 THEN predicted_rank END) AS early_rank, AVG(CASE WHEN pos > n // 2 THEN predicted_rank END) AS recent_rank
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {by} ORDER BY season, round) AS pos, COUNT(*) OVER (PARTITION BY {by}) AS n FROM scored) GROUP BY {by}),
    trend AS (SELECT *, recent_rank - early_rank AS delta FROM halves)"""


@query(
    "e37_rising_and_fading",
    sql(
        f"""WITH {halves_sql('season, entity_id')}, kept AS (SELECT * FROM trend WHERE events >= 4)
        SELECT season, entity_id, round(delta, 6) AS delta, 'rising' AS side, place FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY season ORDER BY delta, entity_id) AS place FROM kept) WHERE place <= 3
        UNION ALL SELECT season, entity_id, round(delta, 6), 'fading', place FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY season ORDER BY delta DESC, entity_id) AS place FROM kept) WHERE place <= 3""",
        "scored",
    ),
)
def e37(spark, folder):
    out = A.rising_and_fading(scored_of(spark, folder))
    return out.select("season", "entity_id", r6("delta"), "side", "place")


@query(
    "e38_group_outlook",
    sql(
        """WITH m AS (SELECT season, group_id, AVG(p) AS mean_share FROM scored GROUP BY ALL)
        SELECT season, group_id, round(mean_share, 3) AS mean_share, place FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY season ORDER BY mean_share DESC, group_id) AS place FROM m) WHERE place <= 8""",
        "scored",
    ),
)
def e38(spark, folder):
    out = A.group_outlook(scored_of(spark, folder))
    return out.select("season", "group_id", F.round("mean_share", 3).alias("mean_share"), "place")


@query(
    "e39_pick_extremes",
    sql(
        """WITH picks AS (SELECT * FROM scored WHERE predicted_rank = 1)
        SELECT a.season, a.event_id AS most_event, a.entity_id AS most_entity, round(a.p, 6) AS most_share, b.event_id AS least_event, b.entity_id AS least_entity, round(b.p, 6) AS least_share
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY season ORDER BY p DESC, event_id) AS rn FROM picks) a
        JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY season ORDER BY p, event_id) AS rn FROM picks) b ON a.season = b.season WHERE a.rn = 1 AND b.rn = 1""",
        "scored",
    ),
)
def e39(spark, folder):
    return rounded(A.pick_extremes(scored_of(spark, folder)), "most_share", "least_share")


@query(
    "e40_entity_model_view",
    sql(
        f"""WITH {halves_sql('entity_id')} SELECT entity_id, events, round(mean_rank, 6) AS mean_rank, best_rank, wins, round(early_rank, 6) AS early_rank,
        round(recent_rank, 6) AS recent_rank, round(delta, 6) AS delta FROM trend""",
        "scored",
    ),
)
def e40(spark, folder):
    out = A.season_halves(scored_of(spark, folder), ["entity_id"])
    return rounded(out, "mean_rank", "early_rank", "recent_rank", "delta")


@query(
    "e41_pick_accuracy",
    sql(
        "SELECT group_id, COUNT(*) AS picks, COUNT(winner) AS decided, COUNT(CASE WHEN winner = 1 THEN 1 END) AS hits FROM scored WHERE predicted_rank = 1 GROUP BY group_id",
        "scored",
    ),
)
def e41(spark, folder):
    return A.pick_accuracy(scored_of(spark, folder))


COMPARED = ("events", "wins", "avg_quali", "avg_finish", "consistency_std", "share")


@query(
    "e42_two_entities",
    sql(
        f"""WITH st AS ({ENTITY_STATS_SQL}), sh AS (SELECT entity_id, season, AVG(p) AS share FROM scored GROUP BY ALL),
        two AS (SELECT st.*, share FROM st LEFT JOIN sh USING (entity_id, season) WHERE season IS NOT NULL AND entity_id IN (1, 2)) SELECT season, """
        + ", ".join(
            f"round(MAX(CASE WHEN entity_id = {i} THEN {c} END), 6) AS {c}_{t}"
            for i, t in ((1, "a"), (2, "b"))
            for c in COMPARED
        )
        + " FROM two GROUP BY season",
        "scored",
    ),
)
def e42(spark, folder):
    scored = scored_of(spark, folder)
    out = A.compare_entities(
        A.entity_stats(contest.facts(spark, folder)), scored, F.col("entity_id") == 1,
        F.col("entity_id") == 2,
    )
    return out.select("season", *[r6(c) for c in out.columns if c != "season"])


@query(
    "e42_event_shares",
    sql(
        """SELECT event_id, season, round, round(MAX(CASE WHEN entity_id = 1 THEN p END), 6) AS share_a, round(MAX(CASE WHEN entity_id = 2 THEN p END), 6) AS share_b
        FROM scored WHERE entity_id IN (1, 2) GROUP BY ALL""",
        "scored",
    ),
)
def e42_events(spark, folder):
    out = A.compare_at_events(scored_of(spark, folder), F.col("entity_id") == 1, F.col("entity_id") == 2)
    return rounded(out, "share_a", "share_b")


@query(
    "e24_group_leaders",
    sql(
        f"""SELECT group_id AS entity_id, COUNT(*) AS starts, COUNT(CASE WHEN {WON} THEN 1 END) AS wins, COUNT(CASE WHEN {PODIUM} THEN 1 END) AS podiums,
        round(1.0 * COUNT(CASE WHEN {WON} THEN 1 END) / COUNT(*), 6) AS win_rate, round(1.0 * COUNT(CASE WHEN {PODIUM} THEN 1 END) / COUNT(*), 6) AS podium_rate
        FROM contest GROUP BY group_id HAVING COUNT(*) >= 50""",
        "contest",
    ),
)
def e24_groups(spark, folder):
    # The library's least number of starts, which groups reach and customers don't.
    facts = contest.facts(spark, folder).drop("entity_id").withColumnRenamed("group_id", "entity_id")
    return rounded(A.career_leaders(facts), "win_rate", "podium_rate")


@query(
    "e43_served_seasons",
    sql("SELECT MIN(season) AS first_season, MAX(season) AS last_season FROM contest", "contest"),
)
def e43(spark, folder):
    return contest.facts(spark, folder).agg(
        F.min("season").alias("first_season"), F.max("season").alias("last_season")
    )


@query(
    "e44_importance_by_class",
    sql(
        """WITH w(feature, class) AS (VALUES ('grid', 'stable'), ('quali_position', 'stable'), ('points', 'era_sensitive'), ('temp', 'experimental')),
        imp AS (SELECT 'grid' AS feature, abs(covar_pop(grid, winner)) AS importance FROM contest UNION ALL SELECT 'quali_position', abs(covar_pop(quali_position, winner)) FROM contest
        UNION ALL SELECT 'points', abs(covar_pop(points, winner)) FROM contest UNION ALL SELECT 'temp', abs(covar_pop(temp, winner)) FROM contest)
        SELECT class, round(SUM(importance), 6) AS importance FROM imp JOIN w USING (feature) GROUP BY class""",
        "contest",
    ),
)
def e44(spark, folder):
    from formbook.plans.models import importance_by_class

    df = contest.facts(spark, folder)
    classes = {"grid": "stable", "quali_position": "stable", "points": "era_sensitive", "temp": "experimental"}
    # A covariance stands in for a fitted weight.
    weights = df.agg(*[F.abs(F.covar_pop(c, "winner")).alias(c) for c in classes])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in classes])
    return rounded(importance_by_class(weights.select(F.inline(rows)), classes), "importance")
