"""Promotion, tracking, what-if, materialisation and streams (J31-J39, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from formbook.catalog import features as W
from formbook.catalog.features import KEYS
from formbook.catalog.joins import HISTORY_CTE, history
from formbook.catalog.learning import COLUMNS, learning_frame
from formbook.catalog.ranking import (
    METRIC_NAMES, METRIC_SELECT, metrics_sql, pole_of, scored_frame, scored_of,
)
from formbook.catalog.registry import query, r6
from formbook.catalog.sources import payload_files, result_pages
from formbook.catalog.sqltext import CONTEST, sql
from formbook.operators.joins import calendar_of, checked_join
from formbook.operators.setops import concat
from formbook.plans import contest, features as P, gates as G, metrics as M, models as L, scoring, state, tracking as T
from formbook.schemas import FEATURE_COLUMNS, feature_table
from formbook.session import new_path, staged
from formbook.streaming import ingest, payloads


@query(
    "j31_promotion_verdict",
    sql(
        f"""WITH late AS (SELECT * FROM scored WHERE season >= 2000), late_pole AS (SELECT * FROM pole_scored WHERE season >= 2000),
        c AS (WITH {metrics_sql('late', '1')} SELECT * FROM metric), s AS (WITH {metrics_sql('late_pole', '1')} SELECT * FROM metric)
        SELECT 'top1_accuracy' AS "check", round(c.top1_accuracy, 6) AS candidate, round(s.top1_accuracy, 6) AS served, 0.03 AS tolerance, COALESCE(c.top1_accuracy < s.top1_accuracy - 0.03, false) AS refused FROM c, s
        UNION ALL SELECT 'spearman_corr', round(c.spearman_corr, 6), round(s.spearman_corr, 6), 0.015, COALESCE(c.spearman_corr < s.spearman_corr - 0.015, false) FROM c, s""",
        "scored", "pole_scored",
    ),
)
def j31(spark, folder):
    late = F.col("season") >= 2000
    candidate = M.metrics(scored_frame(scored_of(spark, folder).where(late)))
    served = M.metrics(scored_frame(pole_of(spark, folder).where(late)))
    out = G.regression_checks(candidate, served)
    return out.select("check", r6("candidate"), r6("served"), "tolerance", "refused")


@query(
    "j31_full_verdict",
    sql(
        """SELECT 'excluded_features' AS "check", false AS refused UNION ALL
        SELECT 'degenerate_output', COUNT(*) > 0 FROM (SELECT event_id FROM scored GROUP BY event_id HAVING COUNT(*) > 1 AND MIN(p) = MAX(p))
        UNION ALL SELECT 'top1_accuracy', false UNION ALL SELECT 'spearman_corr', false""",
        "scored",
    ),
)
def j31_full(spark, folder):
    scored = scored_of(spark, folder)
    table = M.metrics(scored_frame(scored))
    features = feature_table(spark)
    schema = features.where(F.col("feature").isin(*COLUMNS)).select("feature")
    shares = scored.withColumn("win_probability", F.col("p"))
    return G.promotion_verdict(table, table, schema, features, shares)


@query(
    "j31_refused_verdict",
    sql(
        f"""WITH late AS (SELECT * FROM scored WHERE season >= 1996), shuffled AS (SELECT * REPLACE (1.0 / finish_order AS p) FROM late),
        c AS (WITH {metrics_sql('late', '1')} SELECT * FROM metric), s AS (WITH {metrics_sql('shuffled', '1')} SELECT * FROM metric)
        SELECT 'excluded_features' AS "check", true AS refused UNION ALL
        SELECT 'degenerate_output', COUNT(*) > 0 FROM (SELECT event_id FROM pole_scored GROUP BY event_id HAVING COUNT(*) > 1 AND MIN(p) = MAX(p))
        UNION ALL SELECT 'top1_accuracy', COALESCE(c.top1_accuracy < s.top1_accuracy - 0.03, false) FROM c, s
        UNION ALL SELECT 'spearman_corr', COALESCE(c.spearman_corr < s.spearman_corr - 0.015, false) FROM c, s""",
        "scored", "pole_scored",
    ),
)
def j31_refused(spark, folder):
    # The candidate reads every feature, excluded ones too; the served model knows the outcome.
    late = scored_of(spark, folder).where("season >= 1996")
    candidate = M.metrics(scored_frame(late))
    served = M.metrics(scored_frame(late.withColumn("p", 1.0 / F.col("finish_order"))))
    features = feature_table(spark)
    shares = pole_of(spark, folder).withColumn("win_probability", F.col("p"))
    return G.promotion_verdict(candidate, served, features.select("feature"), features, shares)


@query(
    "j33_degenerate_events",
    sql(
        """SELECT event_id, COUNT(*) AS n FROM pole_scored GROUP BY event_id HAVING COUNT(*) > 1 AND MIN(p) = MAX(p)""",
        "pole_scored",
    ),
)
def j33(spark, folder):
    return G.degenerate_events(pole_of(spark, folder), "p")


TRACKED_SQL = ", ".join(f"round({m}, 6) AS {m}" for m in METRIC_NAMES)


def _score(frame):
    out = scoring.with_share(frame.withColumn("p_raw", 1.0 / F.col("quali_position")), "p_raw", "p")
    return out


@query(
    "j34_running_evaluation",
    sql(
        f"""WITH {HISTORY_CTE}, fresh AS (SELECT * FROM scored WHERE event_id NOT IN (SELECT event_id FROM history)),
        {metrics_sql('fresh', 'event_id')} SELECT k AS event_id, {METRIC_SELECT}, 'share' AS model_name FROM metric""",
        "scored",
    ),
)
def j34(spark, folder):
    facts = contest.facts(spark, folder)
    tracked = history(facts).select("event_id").distinct()
    out = T.score_new_events(_score, facts, tracked, {"name": "share"})
    return out.select(
        "event_id", *[r6(m) for m in METRIC_NAMES], "n_events", "n_rows", "model_name"
    )


@query(
    "j35_running_summary",
    sql(
        f"""WITH {metrics_sql('scored', 'event_id')} SELECT COUNT(*) AS n_events, COUNT(*) < 24 AS small_sample, """
        + ", ".join(f"round(AVG({m}), 6) AS {m}" for m in METRIC_NAMES)
        + " FROM metric",
        "scored",
    ),
)
def j35(spark, folder):
    report = M.metrics(scored_frame(scored_of(spark, folder)), ["event_id"])
    out = T.summarise_tracking(report)
    return out.select("n_events", "small_sample", *[r6(m) for m in METRIC_NAMES])


@query(
    "j36_what_if_each",
    sql(
        """WITH t AS (SELECT *, CAST(COUNT(*) OVER w AS DOUBLE) AS n, SUM(p_raw) OVER w AS total FROM pole_scored WINDOW w AS (PARTITION BY event_id))
        SELECT event_id, entity_id, round(CASE WHEN total <= 0 THEN 1 / n ELSE p_raw / total END, 6) AS real_share,
        round(1 / (total - p_raw + 1), 6) AS simulated_share FROM t""",
        "pole_scored",
    ),
)
def j36(spark, folder):
    # Every entrant moved to the first place, one at a time.
    facts = contest.facts(spark, folder)
    out = scoring.what_if_each(facts, scoring.pole_probability(F.col("grid")), F.lit(1.0))
    return out.select(*KEYS, r6("real_share"), r6("simulated_share"))


@query(
    "j36_what_if_field",
    sql(
        """WITH last_one AS (SELECT event_id, MAX(quali_position) AS q FROM contest GROUP BY event_id),
        moved AS (SELECT c.*, CASE WHEN c.quali_position = l.q OR c.grid = 1 THEN 1.0 ELSE 0.0 END AS raw FROM contest c JOIN last_one l USING (event_id)),
        shared AS (SELECT *, raw / SUM(raw) OVER (PARTITION BY event_id) AS share FROM moved)
        SELECT event_id, entity_id, round(share, 6) AS simulated_share, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY share DESC, entity_id) AS simulated_rank FROM shared""",
        "contest",
    ),
)
def j36_field(spark, folder):
    # The last qualifier of each event starts first.
    df = P.session_features(contest.facts(spark, folder))
    last = df.groupBy("event_id").agg(
        F.max_by("entity_id", "quali_position").alias("entity_id"), F.lit(1).alias("new_grid")
    )
    out = scoring.what_if(df, last, scoring.pole_probability("grid_adjusted"))
    return out.select(*KEYS, r6("simulated_share"), "simulated_rank")


# The contest with the grid taken from qualifying.
UNKNOWN_GRID = "CASE WHEN entity_id % 17 = 0 THEN 0 ELSE quali_position END AS grid"
LAST_EVENT = "(SELECT MAX(event_id) FROM contest)"


@query(
    "j37_materialised_next_event",
    W.ORACLES["feature_build"].replace(UNKNOWN_GRID, "quali_position AS grid").replace(
        "c.season, c.round, c.winner,", "c.season, c.round,"
    )
    + f" WHERE c.event_id = {LAST_EVENT}",
)
def j37(spark, folder):
    facts = contest.facts(spark, folder)
    # The last event is the one to come; nothing but its entry list and
    # qualifying may be read.
    calendar = calendar_of(facts, "event_id", "venue_id")
    last = calendar.orderBy(F.desc("season"), F.desc("round")).limit(2).collect()
    events = calendar.where(F.col("event_id") == last[0]["event_id"])
    coming = facts.where(F.col("event_id") == last[0]["event_id"])
    standings, groups, conditions = contest.season_tables(spark, folder)
    weather = contest.weather_columns(conditions)
    ended = F.col("event_id") == last[1]["event_id"]
    made = state.materialise(
        events, coming, coming, stored_states(spark, folder), standings.where(ended), groups.where(ended), weather,
        calendar.select("event_id", "season", "round"),
        {"entity_id": contest.entities(spark, folder).select(F.col("c_custkey").alias("entity_id"))},
    )
    return W.pick(
        made, *FEATURE_COLUMNS,
        keys=("event_id", "entity_id", "group_id", "venue_id", "season", "round"),
    )


def stored_states(spark, folder):
    """The states before the last event, stored once per session: those of all events
    but two, advanced by the last but one when it had finished."""
    made = {}

    def built(kind):
        if not made:
            facts = contest.facts(spark, folder)
            last = calendar_of(facts).orderBy(F.desc("season"), F.desc("round")).limit(2).collect()
            coming, finished = last[0]["event_id"], last[-1]["event_id"]
            _, _, conditions = contest.season_tables(spark, folder)
            weather, path = contest.weather_columns(conditions), new_path(spark, "states")
            state.save(state.build(facts.where(~F.col("event_id").isin(coming, finished)), weather), path)
            made.update(state.advance(state.load(spark, path), facts.where(F.col("event_id") == finished), weather))
        return made[kind]

    return {kind: staged(spark, (f"state-{kind}", folder), lambda kind=kind: built(kind)) for kind in state.KINDS}


@query(
    "j38_row_parity",
    sql(
        f"""WITH {W.TIMED_CTE}, g AS (SELECT *, adjusted - quali_position > 3 AS pen FROM bested WHERE entity_id % 17 = 0)
        SELECT 'grid_adjusted' AS "column", true AS expected, COUNT(CASE WHEN adjusted <> quali_position THEN 1 END) AS n FROM g HAVING n > 0
        UNION ALL SELECT 'grid_position_norm', true, COUNT(CASE WHEN adjusted <> quali_position THEN 1 END) AS n FROM g HAVING n > 0
        UNION ALL SELECT 'pit_lane_start', true, COUNT(*) AS n FROM g HAVING n > 0
        UNION ALL SELECT 'grid_penalty_applied', true, COUNT(CASE WHEN pen THEN 1 END) AS n FROM g HAVING n > 0""",
        "contest",
    ),
)
def j38(spark, folder):
    out = G.parity(
        learning_frame(spark, folder), materialised_frame(spark, folder), FEATURE_COLUMNS
    )
    return out.groupBy("column", "expected").agg(F.count(F.lit(1)).alias("n"))


def materialised_frame(spark, folder):
    """Feature rows of every event, each looked up in the states before it."""
    facts = contest.facts(spark, folder)
    standings, groups, conditions = contest.season_tables(spark, folder)
    return state.materialise_many(facts, facts, standings, groups, contest.weather_columns(conditions))


@query(
    "j39_backtest",
    sql(
        """WITH made AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY share DESC, entity_id) AS made_rank FROM (
          SELECT event_id, entity_id, CASE WHEN quali_position = 1 THEN 1.0 ELSE 0.0 END AS share FROM contest)),
        j AS (SELECT p.*, made.share, made.made_rank FROM pole_scored p JOIN made USING (event_id, entity_id)),
        e AS (SELECT event_id, COUNT(*) AS rows, COUNT(CASE WHEN abs(p - share) >= 1e-4 THEN 1 END) AS shares, COUNT(CASE WHEN predicted_rank <> made_rank THEN 1 END) AS ranks,
          MAX(CASE WHEN predicted_rank = 1 THEN winner END) AS hit, MAX(CASE WHEN made_rank = 1 THEN winner END) AS made_hit FROM j GROUP BY event_id)
        SELECT COUNT(*) AS events, CAST(SUM(rows) AS BIGINT) AS rows, CAST(SUM(shares) AS BIGINT) AS shares_off, CAST(SUM(ranks) AS BIGINT) AS ranks_changed,
        round(AVG(hit), 6) AS top1_real, round(AVG(made_hit), 6) AS top1_made, abs(AVG(hit) - AVG(made_hit)) <= 0.05 AS within_band FROM e""",
        "pole_scored",
    ),
)
def j39(spark, folder):
    facts = contest.facts(spark, folder)
    real = scoring.score(facts, scoring.pole_probability(F.col("grid")))
    made = scoring.score(T.as_materialised(facts), scoring.pole_probability(F.col("grid")))
    out = G.backtest(real, made)
    return out.select(
        "events", "rows", "shares_off", "ranks_changed", r6("top1_real"), r6("top1_made"),
        "within_band",
    )


@query(
    "j39_model_backtest",
    sql(
        """WITH late AS (SELECT *, CASE WHEN entity_id % 17 = 0 THEN 0 ELSE quali_position END <> quali_position AS moved FROM contest WHERE season > 1999),
        e AS (SELECT event_id, COUNT(*) AS rows, BOOL_OR(moved) AS moved FROM late GROUP BY event_id)
        SELECT COUNT(*) AS events, CAST(SUM(rows) AS BIGINT) AS rows, CAST(COUNT(CASE WHEN moved THEN 1 END) AS BIGINT) AS events_moved,
        CAST(0 AS BIGINT) AS unmoved_shares_off, CAST(0 AS BIGINT) AS other_cells_off FROM e""",
        "contest",
    ),
)
def j39_model(spark, folder):
    # A stored model scores the stored features and those looked up before each event.
    # Only in events where a grid differs from qualifying may a share differ.
    late = F.col("season") > 1999
    model = served_model(spark, folder)
    real, made = learning_frame(spark, folder).where(late), materialised_frame(spark, folder).where(late)
    off = G.parity(real, made, FEATURE_COLUMNS).where("NOT expected").count()
    shares = G.share_differences(
        scoring.score(model.score(real), F.col("p")), scoring.score(model.score(made), F.col("p")),
        real.groupBy("event_id").agg(F.bool_or(F.col("grid_adjusted") != F.col("qualifying_position")).alias("moved")),
    )
    return shares.withColumn("other_cells_off", F.lit(off).cast("long"))


def served_model(spark, folder):
    """The logistic model of the seasons up to 1999, fitted and stored once per session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _SERVED:
        path = new_path(spark, "served-model")
        L.save(spark, L.fit("logreg", learning_frame(spark, folder).where("season <= 1999"), COLUMNS), path)
        _SERVED[key] = path
    return L.load(spark, _SERVED[key])


_SERVED: dict[tuple, str] = {}


@query(
    "k1_incremental_ingest",
    sql(
        """SELECT season, round, 'e' || entity_id AS entity_ref, 'g' || group_id AS group_ref, grid, CASE WHEN finished = 1 THEN finish_order END AS position,
        CAST(points AS DOUBLE) AS points,
        DENSE_RANK() OVER (ORDER BY seen) AS entity_key, DENSE_RANK() OVER (ORDER BY group_seen) AS group_key
        FROM (SELECT *, MIN(season * 100000000 + round * 1000000 + finish_order) OVER (PARTITION BY entity_id) AS seen,
        MIN(season * 100000000 + round * 1000000 + finish_order) OVER (PARTITION BY group_id) AS group_seen FROM contest)""",
        "contest",
    ),
)
def k1(spark, folder):
    source, root = new_path(spark, "arrivals"), new_path(spark, "ingested")
    result_pages(contest.facts(spark, folder)).write.mode("overwrite").json(source)
    payloads.ingest_payloads(spark, source, "results", root, new_path(spark, "offsets"))
    # A second run that lost its offsets re-reads every file and adds nothing.
    out = payloads.ingest_payloads(spark, source, "results", root, new_path(spark, "offsets"))
    return out.select(
        "season", "round", "entity_ref", "group_ref", "grid", "position", "points",
        F.col("entity_id").alias("entity_key"), F.col("group_id").alias("group_key"),
    )


@query(
    "k1_four_payloads",
    sql(
        """WITH seen AS (SELECT *, DENSE_RANK() OVER (ORDER BY e) AS entity_key, DENSE_RANK() OVER (ORDER BY g) AS group_key FROM (
          SELECT event_id, entity_id, group_id,
          MIN(season * 100000000 + round * 1000000 + finish_order) OVER (PARTITION BY entity_id) AS e,
          MIN(season * 100000000 + round * 1000000 + finish_order) OVER (PARTITION BY group_id) AS g FROM contest)),
        entity_keys AS (SELECT DISTINCT entity_id, entity_key FROM seen), group_keys AS (SELECT DISTINCT group_id, group_key FROM seen)
        SELECT 'results' AS kind, event_id, entity_key, group_key, finish_order AS place, CAST(points AS DOUBLE) AS points, NULL AS wins, NULL AS q1,
        ROW_NUMBER() OVER (ORDER BY season, round, finish_order) AS row_id
        FROM contest JOIN entity_keys USING (entity_id) JOIN group_keys USING (group_id)
        UNION ALL SELECT 'qualifying', event_id, entity_key, group_key, quali_position, NULL, NULL, q1,
        ROW_NUMBER() OVER (ORDER BY season, round, quali_position, 'e' || entity_id)
        FROM contest JOIN entity_keys USING (entity_id) JOIN group_keys USING (group_id)
        UNION ALL SELECT 'entity_standings', event_id, entity_key, NULL, position, CAST(points AS DOUBLE), CAST(wins AS BIGINT), NULL,
        ROW_NUMBER() OVER (ORDER BY season, round, position) FROM standings JOIN entity_keys USING (entity_id)
        UNION ALL SELECT 'group_standings', event_id, NULL, group_key, position, CAST(points AS DOUBLE), CAST(wins AS BIGINT), NULL,
        ROW_NUMBER() OVER (ORDER BY season, round, position) FROM group_standings JOIN group_keys USING (group_id)""",
        "standings", "group_standings",
    ),
)
def k1_four(spark, folder):
    sources, root = payload_files(spark, folder), new_path(spark, "ingested")
    calendar = calendar_of(contest.facts(spark, folder))
    payloads.catch_up(spark, sources, root, new_path(spark, "offsets"), calendar)
    # Offsets lost: every file is read again and nothing is added.
    payloads.catch_up(spark, sources, root, new_path(spark, "offsets"), calendar)

    def rows(kind):
        made = payloads.KINDS[kind]
        out = payloads.stored_rows(spark, root, kind)
        held = {"entity_key": "entity_id", "group_key": "group_id", "place": made.place, "points": "points", "wins": "wins", "q1": "q1", "row_id": made.row_id}
        kinds = {"points": "double", "q1": "string"}
        columns = [
            (F.col(c) if c in out.columns else F.lit(None)).cast(kinds.get(name, "long")).alias(name) for name, c in held.items()
        ]
        return out.select(F.lit(kind).alias("kind"), "event_id", *columns)

    return concat([rows(kind) for kind in payloads.KINDS])


@query(
    "k1_qualifying_target",
    sql(
        f"WITH {HISTORY_CTE} SELECT event_id FROM calendar WHERE event_id NOT IN (SELECT event_id FROM history) ORDER BY event_id LIMIT 1",
        "calendar",
    ),
)
def k1_target(spark, folder):
    facts = contest.facts(spark, folder)
    past = history(facts)
    quali = past.select("event_id").distinct()
    return ingest.qualifying_target(calendar_of(facts), past, quali, quali).select("event_id")


@query(
    "k2_incremental_evaluation",
    sql(f"WITH {metrics_sql('scored', 'event_id')} SELECT k AS event_id, {METRIC_SELECT} FROM metric", "scored"),
)
def k2(spark, folder):
    facts = contest.facts(spark, folder)
    source, report = new_path(spark, "finished"), new_path(spark, "report")
    facts.select("event_id", "entity_id").write.mode("overwrite").parquet(source)
    schema, offsets = "event_id long, entity_id long", new_path(spark, "offsets")
    # At first the winners of every other month are not known; the second pass has
    # them but no arrivals, and the third replays all arrivals.
    unknown = facts.withColumn("winner", F.when(F.col("round") % 2 == 1, F.col("winner")))
    for seen, at in ((unknown, offsets), (facts, offsets), (facts, new_path(spark, "offsets"))):
        out = ingest.track_events(spark, source, schema, seen, report, at, _score)
    return out.select("event_id", *[r6(m) for m in METRIC_NAMES], "n_events", "n_rows")
