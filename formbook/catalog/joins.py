"""Joins, keys, set operations and ordered picks (SURVEY sections D, G, H)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from formbook.catalog.features import KEYS
from formbook.catalog.ranking import scored_of
from formbook.catalog.registry import longs, query, r6
from formbook.catalog.sqltext import sql
from formbook.operators import joins as J
from formbook.operators.dedup import distinct_keys
from formbook.operators.intervals import interval_join
from formbook.operators.keys import number_after, reconcile
from formbook.plans import contest
from formbook.plans.features import standings_lag
from formbook.plans.splits import ERAS
from formbook.sources.tables import table


def customers(spark, folder):
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("entity_name"), "c_mktsegment"
    )


def nations(spark, folder):
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("long").alias("group_id"), F.col("n_name").alias("group_name")
    )


@query(
    "d1_dimension_joins",
    sql(
        """SELECT event_id, entity_id, group_id, c_name AS entity_name, c_mktsegment, n_name AS group_name FROM contest
        LEFT JOIN customer ON c_custkey = entity_id LEFT JOIN nation ON n_nationkey = group_id""",
        "contest",
    ),
)
def d1(spark, folder):
    df = contest.facts(spark, folder).select(*KEYS, "group_id")
    df = J.guarded_join(df, customers(spark, folder), ["entity_id"], "customer")
    return J.guarded_join(df, nations(spark, folder), ["group_id"], "nation")


@query(
    "d2_composite_key_join",
    sql(
        """SELECT c.event_id, c.entity_id, c.grid, q.quali_position FROM contest c
        LEFT JOIN (SELECT event_id, entity_id, quali_position FROM contest WHERE q2 IS NOT NULL) q USING (event_id, entity_id)""",
        "contest",
    ),
)
def d2(spark, folder):
    facts = contest.facts(spark, folder)
    quali = facts.where("q2 IS NOT NULL").select(*KEYS, "quali_position")
    return J.guarded_join(facts.select(*KEYS, "grid"), quali, KEYS, "qualifying")


@query(
    "d3_lagged_standings",
    sql(
        """SELECT c.event_id, c.entity_id, s.position AS driver_standing_position_prev, s.points AS driver_standing_points_prev,
        s.wins AS driver_standing_wins_prev, g.position AS constructor_standing_position_prev, g.points AS constructor_standing_points_prev
        FROM contest c JOIN prev_map pm USING (event_id) LEFT JOIN standings s ON s.event_id = pm.prev_event_id AND s.entity_id = c.entity_id
        LEFT JOIN group_standings g ON g.event_id = pm.prev_event_id AND g.group_id = c.group_id""",
        "standings", "group_standings", "prev_map",
    ),
)
def d3(spark, folder):
    facts = contest.facts(spark, folder)
    df = facts.select(*KEYS, "group_id", "season", "round")
    out = standings_lag(df, contest.standings(facts), contest.group_standings(facts))
    return out.drop("group_id", "season", "round")


@query(
    "d4_event_conditions",
    sql(
        "SELECT c.event_id, c.entity_id, round(k.precip, 6) AS precip, k.temp FROM contest c LEFT JOIN conditions k USING (event_id)",
        "conditions",
    ),
)
def d4(spark, folder):
    from formbook.plans.features import event_join

    facts = contest.facts(spark, folder)
    weather = contest.conditions(facts).select("event_id", r6("precip"), "temp")
    return event_join(facts.select(*KEYS), weather)


@query(
    "d5_group_columns_back",
    sql(
        """SELECT event_id, entity_id, g.win, g.podiums, round(g.dnf_rate, 6) AS dnf_rate FROM contest
        JOIN group_events g USING (event_id, group_id)""",
        "group_events",
    ),
)
def d5(spark, folder):
    from formbook.plans.features import group_events

    facts = contest.facts(spark, folder)
    side = group_events(facts).select("event_id", "group_id", "win", "podiums", "dnf_rate")
    out = J.checked_join(facts.select(*KEYS, "group_id"), side, ["event_id", "group_id"])
    return out.select(*KEYS, F.col("win").cast("long"), F.col("podiums").cast("long"), r6("dnf_rate"))


def history(facts):
    """Facts before the last season: the part already raced."""
    return facts.where(F.col("season") < facts.agg(F.max("season")).scalar())


HISTORY_CTE = "history AS (SELECT * FROM contest WHERE season < (SELECT MAX(season) FROM contest))"


@query(
    "d6_events_without_result",
    sql(
        f"WITH {HISTORY_CTE} SELECT event_id, season, round FROM calendar WHERE event_id NOT IN (SELECT event_id FROM history)",
        "calendar",
    ),
)
def d6(spark, folder):
    facts = contest.facts(spark, folder)
    return J.pending_events(J.calendar_of(facts), history(facts)).orderBy("season", "round")


@query(
    "d7_rows_not_tracked",
    sql(
        f"WITH {HISTORY_CTE} SELECT event_id, entity_id FROM contest WHERE event_id NOT IN (SELECT event_id FROM history)",
        "contest",
    ),
)
def d7(spark, folder):
    facts = contest.facts(spark, folder)
    tracked = history(facts).select("event_id").distinct()
    return facts.join(tracked, "event_id", "left_anti").select(*KEYS)


@query(
    "d8_next_event",
    sql(
        f"""WITH {HISTORY_CTE} SELECT event_id, season, round FROM calendar WHERE event_id NOT IN (SELECT event_id FROM history)
        ORDER BY season, round LIMIT 1""",
        "calendar",
    ),
)
def d8(spark, folder):
    facts = contest.facts(spark, folder)
    return J.next_event(J.calendar_of(facts), history(facts))


@query(
    "d9_roster_as_of",
    sql(
        """SELECT pm.event_id, c.entity_id, c.group_id FROM prev_map pm JOIN contest c ON c.event_id = pm.prev_event_id""",
        "prev_map",
    ),
)
def d9(spark, folder):
    facts = contest.facts(spark, folder)
    calendar = J.calendar_of(facts)
    # Nothing lies before the first event; asking for its roster is an error.
    first = calendar.agg(F.min(F.struct("season", "round", "event_id")).alias("e")).first()["e"]
    return J.roster_as_of(calendar.where(F.col("event_id") != first["event_id"]), calendar, facts)


@query(
    "d10_semi_join",
    sql(
        "SELECT event_id, entity_id FROM contest WHERE event_id IN (SELECT event_id FROM conditions WHERE precip > 0.2)",
        "conditions",
    ),
)
def d10(spark, folder):
    facts = contest.facts(spark, folder)
    wet = contest.conditions(facts).where("precip > 0.2").select("event_id")
    return J.checked_join(facts.select(*KEYS), wet, ["event_id"], "left_semi")


@query(
    "d11_full_outer",
    sql(
        """SELECT COALESCE(r.event_id, q.event_id) AS event_id, COALESCE(r.entity_id, q.entity_id) AS entity_id, r.grid, q.quali_position
        FROM (SELECT event_id, entity_id, grid FROM contest WHERE finished = 1) r
        FULL JOIN (SELECT event_id, entity_id, quali_position FROM contest WHERE q2 IS NOT NULL) q ON r.event_id = q.event_id AND r.entity_id = q.entity_id""",
        "contest",
    ),
)
def d11(spark, folder):
    facts = contest.facts(spark, folder)
    grid = facts.where("finished = 1").select(*KEYS, "grid")
    quali = facts.where("q2 IS NOT NULL").select(*KEYS, "quali_position")
    return grid.join(quali, list(KEYS), "full_outer")


@query(
    "d12_range_join",
    sql(
        """WITH eras(era, lo, hi) AS (VALUES ('first', 1995, 1996), ('second', 1997, 1998), ('third', 1999, 2000), ('open', 2001, 9999))
        SELECT era, COUNT(*) AS n FROM contest JOIN eras ON season BETWEEN lo AND hi GROUP BY era""",
        "contest",
    ),
)
def d12(spark, folder):
    rows = contest.facts(spark, folder).groupBy("season").agg(F.count(F.lit(1)).alias("n"))
    return J.within_windows(rows, "season", ERAS, ["era"]).groupBy("era").agg(F.sum("n").alias("n"))


# Overlapping windows of one to some 350 days, one per order line, every hundredth order's
# open at its end.
@query(
    "d12_interval_join",
    """WITH spans AS (SELECT l_orderkey * 10 + l_linenumber AS window_id, CAST(l_shipdate AS DATE) AS lo,
      CASE WHEN l_orderkey % 100 <> 0 THEN CAST(l_shipdate AS DATE) + CAST(floor(l_quantity) AS INTEGER) * CAST(l_linenumber AS INTEGER) END AS hi FROM lineitem),
    days AS (SELECT CAST(o_orderdate AS DATE) AS day, COUNT(*) AS orders FROM orders GROUP BY 1),
    held AS (SELECT window_id, lo, hi, SUM(orders) AS orders FROM spans JOIN days ON day >= lo AND (hi IS NULL OR day <= hi) GROUP BY ALL)
    SELECT CAST(orders AS BIGINT) AS orders, COUNT(*) AS windows FROM held GROUP BY 1""",
)
def d12_intervals(spark, folder):
    # How many orders fall into each line's window.
    orders = table(spark, folder, "orders", F.col("o_orderdate").cast("date").alias("day"))
    days = orders.groupBy("day").agg(F.count(F.lit(1)).alias("orders"))
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
    begins = F.col("l_shipdate").cast("date")
    length = F.floor("l_quantity").cast("int") * F.col("l_linenumber").cast("int")
    spans = lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("window_id"), begins.alias("lo"),
        F.when(F.col("l_orderkey") % 100 != 0, F.date_add(begins, length)).alias("hi"),
    )
    held = interval_join(days, "day", spans.withColumn("begins", F.col("lo")).withColumn("ends", F.col("hi")), "lo", "hi", ["window_id", "begins", "ends"])
    # Line numbers may repeat within an order of these tables: the window is id and days.
    per = held.groupBy("window_id", "begins", "ends").agg(F.sum("orders").alias("orders"))
    return per.groupBy("orders").agg(F.count(F.lit(1)).alias("windows"))


@query(
    "d13_interval_totals",
    """WITH bins AS (SELECT date_trunc('hour', ts) AS h, SUM(value) AS total, AVG(value) AS mean FROM events WHERE event_type <> 'signup' GROUP BY 1),
    sess AS (SELECT event_id, date_trunc('hour', ts) AS h FROM events WHERE event_type = 'signup')
    SELECT sess.event_id, round(SUM(b.total), 3) AS total, round(AVG(b.mean), 6) AS mean FROM sess
    LEFT JOIN bins b ON b.h >= sess.h AND b.h < sess.h + INTERVAL 2 HOUR GROUP BY sess.event_id""",
)
def d13(spark, folder):
    events = table(spark, folder, "events", "event_id", "ts", "event_type", "value")
    bins = (
        events.where("event_type <> 'signup'")
        .groupBy(F.date_trunc("hour", "ts").alias("hour"))
        .agg(F.sum("value").alias("v"), F.avg("value").alias("m"))
    )
    sessions = events.where("event_type = 'signup'").select("event_id", "ts")
    out = J.interval_totals(sessions, bins, "ts", "hour", 2, "v", "m")
    return out.select("event_id", F.round("total", 3).alias("total"), r6("mean"))


@query(
    "d14_align_outcome",
    sql(
        "SELECT s.event_id, s.entity_id, s.predicted_rank, c.finish_order FROM scored s LEFT JOIN contest c USING (event_id, entity_id)",
        "scored",
    ),
)
def d14(spark, folder):
    scored = scored_of(spark, folder).select(*KEYS, "predicted_rank")
    outcome = contest.facts(spark, folder).select(*KEYS, "finish_order")
    return scored.join(outcome, list(KEYS), "left")


@query(
    "d17_outcome_with_status",
    sql(
        """WITH status(status_id, status) AS (VALUES (1, 'Finished'), (2, 'Disqualified'), (3, 'Accident'), (54, 'Withdrew'), (81, 'Did not qualify'))
        SELECT event_id, entity_id, position IS NULL AS dnf, position, status FROM contest LEFT JOIN status USING (status_id)""",
        "contest",
    ),
)
def d17(spark, folder):
    status = spark.createDataFrame(
        [
            (1, "Finished"), (2, "Disqualified"), (3, "Accident"), (54, "Withdrew"),
            (81, "Did not qualify"),
        ],
        "status_id long, status string",
    )
    df = contest.facts(spark, folder).select(
        *KEYS, F.col("position").isNull().alias("dnf"), "position", "status_id"
    )
    return J.guarded_join(df, status, ["status_id"], "status").drop("status_id")


KEYED_SQL = """WITH raw AS (SELECT p_partkey AS seq, p_brand || '/' || p_type AS ref, p_size FROM part),
    dim AS (SELECT ref, ROW_NUMBER() OVER (ORDER BY ref) AS id FROM (SELECT DISTINCT ref FROM raw WHERE p_size <= 2)),
    fresh AS (SELECT ref, MIN(seq) AS first FROM raw WHERE ref NOT IN (SELECT ref FROM dim) GROUP BY ref),
    ids AS (SELECT * FROM dim UNION ALL SELECT ref, (SELECT MAX(id) FROM dim) + ROW_NUMBER() OVER (ORDER BY first, ref) FROM fresh)
    SELECT raw.seq, raw.ref, ids.id FROM raw JOIN ids USING (ref)"""


@query("d18_key_reconciliation", KEYED_SQL)
def d18(spark, folder):
    raw = table(spark, folder, "part", "p_partkey", "p_brand", "p_type", "p_size").select(
        F.col("p_partkey").alias("seq"), F.concat_ws("/", "p_brand", "p_type").alias("ref"), "p_size"
    )
    known = raw.where("p_size <= 2").select("ref").distinct()
    # Brands times types: a short list at any scale.
    dim = known.withColumn("id", F.row_number().over(Window.orderBy("ref")).cast("long"))
    return reconcile(raw.drop("p_size"), dim, "ref", "id", "seq")


@query(
    "d19_row_ids_on_append",
    sql(
        f"""WITH {HISTORY_CTE} SELECT event_id, entity_id, (SELECT MAX(result_id) FROM history) + ROW_NUMBER() OVER (ORDER BY event_id, finish_order) AS new_id
        FROM contest WHERE event_id NOT IN (SELECT event_id FROM history)""",
        "contest",
    ),
)
def d19(spark, folder):
    facts = contest.facts(spark, folder)
    old = history(facts)
    new = facts.join(old.select("event_id").distinct(), "event_id", "left_anti")
    existing = old.select(F.col("result_id").alias("new_id"))
    out = number_after(
        new.select(*KEYS, "finish_order"), existing, "new_id",
        [("event_id", True), ("finish_order", True)],
    )
    return out.select(*KEYS, "new_id")


@query("g1_chronological_order", sql("SELECT season, round, event_id, entity_id FROM contest", "contest"))
def g1(spark, folder):
    df = contest.facts(spark, folder).select("season", "round", *KEYS)
    return df.orderBy("season", "round", "event_id", "entity_id")


@query(
    "g2_top_three_per_event",
    sql("SELECT event_id, entity_id, predicted_rank FROM scored WHERE predicted_rank <= 3", "scored"),
)
def g2(spark, folder):
    df = contest.facts(spark, folder).withColumn("p_raw", 1.0 / F.col("quali_position"))
    return top_k(df, ["event_id"], [F.desc("p_raw"), F.asc("entity_id")], 3, "predicted_rank").select(
        *KEYS, "predicted_rank"
    )


def top_k(df, by, order, k, out="place"):
    """First ``k`` rows per key.

    Spark keeps k rows per key and task before the shuffle (a group limit under
    the window), so a large group sends k rows per task.
    """
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return longs(df.withColumn(out, place).where(F.col(out) <= k), out)


@query(
    "g3_largest_and_smallest",
    """SELECT * FROM (SELECT 'most' AS side, c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'least' AS side, c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 5)""",
)
def g3(spark, folder):
    df = table(spark, folder, "customer", "c_custkey", "c_acctbal")
    most = df.orderBy(F.desc("c_acctbal"), "c_custkey").limit(5).withColumn("side", F.lit("most"))
    least = df.orderBy("c_acctbal", "c_custkey").limit(5).withColumn("side", F.lit("least"))
    return most.unionByName(least)


@query(
    "g4_latest_event",
    sql("SELECT event_id, season, round FROM calendar ORDER BY season DESC, round DESC LIMIT 1", "calendar"),
)
def g4(spark, folder):
    at = F.struct("season", "round", "event_id")
    last = contest.facts(spark, folder).agg(F.max(at).alias("e"))
    return last.select("e.event_id", "e.season", "e.round")


@query(
    "g5_recent_events",
    sql("SELECT event_id FROM calendar ORDER BY event_id DESC LIMIT 10", "calendar"),
)
def g5(spark, folder):
    events = contest.facts(spark, folder).select("event_id").distinct()
    return events.orderBy(F.desc("event_id")).limit(10)


@query(
    "g6_neighbour_events",
    sql(
        """SELECT event_id, LAG(event_id) OVER w AS prev_event_id, LEAD(event_id) OVER w AS next_event_id FROM calendar WINDOW w AS (ORDER BY season, round)""",
        "calendar",
    ),
)
def g6(spark, folder):
    out = J.neighbours(J.calendar_of(contest.facts(spark, folder)))
    return out.select("event_id", "prev_event_id", "next_event_id")


@query(
    "h1_aligned_union",
    sql(f"WITH {HISTORY_CTE} SELECT event_id, entity_id, grid FROM contest", "contest"),
)
def h1(spark, folder):
    from formbook.operators.setops import aligned_union

    facts = contest.facts(spark, folder).select(*KEYS, "season", "grid")
    old = history(facts)
    new = facts.join(old.select("event_id").distinct(), "event_id", "left_anti").select(
        F.col("grid").cast("string").alias("grid"), "season", *[F.col(k).cast("decimal(19,0)").alias(k) for k in KEYS]
    )
    return aligned_union(old, new).drop("season")


@query(
    "h2_union_of_seasons",
    sql("SELECT season, COUNT(*) AS n FROM contest GROUP BY season", "contest"),
)
def h2(spark, folder):
    from formbook.operators.setops import concat

    facts = contest.facts(spark, folder)
    seasons = [r["season"] for r in facts.select("season").distinct().collect()]
    # One pruned scan per season, as if each were a table of its own.
    whole = concat([facts.where(F.col("season") == s) for s in sorted(seasons)])
    return whole.groupBy("season").agg(F.count(F.lit(1)).alias("n"))


@query("h3_distinct_pairs", sql("SELECT DISTINCT entity_id, group_id FROM contest", "contest"))
def h3(spark, folder):
    return distinct_keys(contest.facts(spark, folder), ["entity_id", "group_id"])


@query(
    "h4_shared_events",
    sql(
        """SELECT COUNT(*) AS shared FROM (SELECT event_id FROM contest WHERE season <= 1998 INTERSECT SELECT event_id FROM contest WHERE season > 1998)""",
        "contest",
    ),
)
def h4(spark, folder):
    events = contest.facts(spark, folder).select("event_id", "season")
    train = events.where("season <= 1998").select("event_id")
    test = events.where("season > 1998").select("event_id")
    return train.intersect(test).agg(F.count(F.lit(1)).alias("shared"))


@query("h6_fold_concat", sql("SELECT season AS fold, event_id, entity_id, winner FROM contest", "contest"))
def h6(spark, folder):
    from formbook.operators.setops import concat

    facts = contest.facts(spark, folder)
    seasons = sorted(r["season"] for r in facts.select("season").distinct().collect())
    # A fold per season of the facts, each a pruned scan of its folder.
    return concat([facts.where(F.col("season") == s).select(F.lit(s).cast("long").alias("fold"), *KEYS, "winner") for s in seasons])
