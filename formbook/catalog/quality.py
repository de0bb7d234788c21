"""Profiles and data-quality suites (SURVEY section B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from formbook.catalog.registry import query, r6
from formbook.catalog.scalars import RAW_POSITION_SQL, raw_position, with_status
from formbook.catalog.sqltext import sql
from formbook.functions import scalars as S
from formbook.operators import joins as J
from formbook.operators import quality as Q
from formbook.plans import contest
from formbook.schemas import leaked_outcomes, require_schema
from formbook.session import new_path
from formbook.sources.files import write_checked
from formbook.sources.tables import table

LINE_KEY = ["l_orderkey", "l_linenumber"]


def _profile_sql(name, columns):
    def one(c, numeric):
        stats = (
            f"round(AVG({c}), 6), round(stddev_samp({c}), 6), CAST(MIN({c}) AS DOUBLE), CAST(MAX({c}) AS DOUBLE)"
            if numeric
            else "NULL, NULL, NULL, NULL"
        )
        return (
            f"SELECT '{c}', COUNT(*), COUNT(*) - COUNT({c}), "
            f"round(100.0 * (COUNT(*) - COUNT({c})) / COUNT(*), 6), {stats} FROM {name}"
        )

    body = " UNION ALL ".join(one(c, n) for c, n in columns)
    return f'SELECT * FROM ({body}) AS t("column", n, missing, missing_pct, mean, std, min, max)'


@query(
    "b1_profile",
    sql(
        _profile_sql(
            "contest",
            [("entity_id", True), ("position", True), ("points", True), ("q3", False), ("temp", True)],
        ),
        "contest",
    ),
)
def b1(spark, folder):
    df = contest.facts(spark, folder).select("entity_id", "position", "points", "q3", "temp")
    out = Q.profile(df)
    return out.select(
        "column", "n", "missing", r6("missing_pct"), r6("mean"), r6("std"), "min", "max"
    )


@query(
    "b2_required_columns",
    sql(
        """SELECT 'event_id is null' AS rule, 'error' AS severity, COUNT(*) - COUNT(event_id) AS n FROM contest UNION ALL
        SELECT 'position is null', 'error', COUNT(*) - COUNT(position) FROM contest UNION ALL
        SELECT 'q3 is null', 'error', COUNT(*) - COUNT(q3) FROM contest""",
        "contest",
    ),
)
def b2(spark, folder):
    return Q.run_rules(contest.facts(spark, folder), Q.not_null("event_id", "position", "q3"))


@query(
    "b3_strict_cast",
    sql(
        """SELECT 'position_text' AS "column", COUNT(CASE WHEN position_text IS NOT NULL AND TRY_CAST(position_text AS BIGINT) IS NULL THEN 1 END) AS n FROM contest
        UNION ALL SELECT 'entity_id', 0""",
        "contest",
    ),
)
def b3(spark, folder):
    df = contest.facts(spark, folder).select(
        "position_text", F.col("entity_id").cast("string").alias("entity_id")
    )
    return Q.failed_casts(df, {"position_text": "long", "entity_id": "long"})


@query(
    "b4_duplicate_keys",
    "SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1",
)
def b4(spark, folder):
    return Q.duplicate_keys(table(spark, folder, "lineitem", *LINE_KEY), LINE_KEY)


@query(
    "b4_duplicate_sample",
    """SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1
    ORDER BY l_orderkey, l_linenumber LIMIT 5""",
)
def b4_sample(spark, folder):
    return Q.duplicate_sample(table(spark, folder, "lineitem", *LINE_KEY), LINE_KEY)


@query(
    "b5_primary_key",
    """SELECT 'customer key' AS rule, 'error' AS severity, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS n FROM (SELECT COUNT(*) AS n FROM customer GROUP BY c_custkey HAVING COUNT(*) > 1)
    UNION ALL SELECT 'customer name', 'error', CAST(COALESCE(SUM(n), 0) AS BIGINT) FROM (SELECT COUNT(*) AS n FROM customer GROUP BY c_mktsegment HAVING COUNT(*) > 1)""",
)
def b5(spark, folder):
    df = table(spark, folder, "customer", "c_custkey", "c_mktsegment")
    return Q.duplicate_rows(df, ["c_custkey"], "customer key").unionByName(
        Q.duplicate_rows(df, ["c_mktsegment"], "customer name")
    )


@query(
    "b6_range_error",
    """SELECT 'c_acctbal outside [0, None]' AS rule, 'error' AS severity, COUNT(CASE WHEN c_acctbal < 0 THEN 1 END) AS n FROM customer""",
)
def b6(spark, folder):
    return Q.run_rules(table(spark, folder, "customer", "c_acctbal"), [Q.outside("c_acctbal", 0)])


@query(
    "b7_allowed_values",
    "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY o_orderstatus",
)
def b7(spark, folder):
    return Q.not_allowed(table(spark, folder, "orders", "o_orderstatus"), "o_orderstatus", ["F", "O"])


def raw_results(spark, folder):
    facts = with_status(contest.facts(spark, folder))
    return facts.withColumns(
        {"position": raw_position(), "finished": F.col("finished") == 1}
    )


RAW_CTE = f"raw AS (SELECT * REPLACE ({RAW_POSITION_SQL} AS position, finished = 1 AS finished) FROM statused)"
RULES_SQL = """SELECT 'event_id is null' AS rule, 'error' AS severity, COUNT(*) - COUNT(event_id) AS n FROM raw
    UNION ALL SELECT 'entity_id is null', 'error', COUNT(*) - COUNT(entity_id) FROM raw
    UNION ALL SELECT 'points outside [0, None]', 'error', COUNT(CASE WHEN points < 0 THEN 1 END) FROM raw
    UNION ALL SELECT 'finished without position', 'error', COUNT(CASE WHEN finished AND position IS NULL THEN 1 END) FROM raw
    UNION ALL SELECT 'unfinished with position', 'warning', COUNT(CASE WHEN NOT finished AND position IS NOT NULL THEN 1 END) FROM raw
    UNION ALL SELECT 'position outside [1, 34]', 'warning', COUNT(CASE WHEN position < 1 OR position > 34 THEN 1 END) FROM raw
    UNION ALL SELECT 'status not allowed', 'error', COUNT(CASE WHEN result_status NOT IN ('Finished','Retired','Disqualified','Did Not Start','Withdrawn','Other') THEN 1 END) FROM raw
    UNION ALL SELECT 'repeated (event, entity)', 'error', CAST(COALESCE((SELECT SUM(n) FROM (SELECT COUNT(*) AS n FROM raw GROUP BY event_id, entity_id HAVING COUNT(*) > 1)), 0) AS BIGINT)"""


def result_rules():
    return [
        *Q.not_null("event_id", "entity_id"),
        Q.outside("points", 0),
        Q.implies("finished without position", F.col("finished"), F.col("position").isNotNull()),
        Q.implies(
            "unfinished with position", ~F.col("finished"), F.col("position").isNull(), "warning"
        ),
        Q.outside("position", 1, 34, "warning"),
        Q.Rule("status not allowed", "error", ~F.col("result_status").isin(*S.ALLOWED_STATUSES)),
    ]


def result_report(df):
    rows = Q.run_rules(df, result_rules())
    keys = Q.duplicate_rows(df, ["event_id", "entity_id"], "repeated (event, entity)")
    return rows.unionByName(keys)


@query(
    "b8_implication_rules",
    sql(
        f"WITH {RAW_CTE}, rules AS ({RULES_SQL}) SELECT * FROM rules WHERE rule LIKE '%finished with%'",
        "statused",
    ),
)
def b8(spark, folder):
    rules = [r for r in result_rules() if "finished with" in r.name]
    return Q.run_rules(raw_results(spark, folder), rules)


@query(
    "b9_out_of_range_values",
    sql(
        f"WITH {RAW_CTE} SELECT position, COUNT(*) AS n FROM raw WHERE position < 1 OR position > 34 GROUP BY position",
        "statused",
    ),
)
def b9(spark, folder):
    rule = Q.outside("position", 1, 34, "warning")
    return Q.value_counts(raw_results(spark, folder).where(rule.broken), "position")


@query("b10_rule_suite", sql(f"WITH {RAW_CTE} {RULES_SQL}", "statused"))
def b10(spark, folder):
    return result_report(raw_results(spark, folder))


@query(
    "b10_verdict",
    sql(
        f"""WITH {RAW_CTE}, rules AS ({RULES_SQL}) SELECT COUNT(CASE WHEN severity = 'error' AND n > 0 THEN 1 END) = 0 AS passed,
        COUNT(CASE WHEN severity = 'error' AND n > 0 THEN 1 END) AS errors, COUNT(CASE WHEN severity = 'warning' AND n > 0 THEN 1 END) AS warnings FROM rules""",
        "statused",
    ),
)
def b10_verdict(spark, folder):
    return Q.verdict(result_report(raw_results(spark, folder)))


SAMPLE_SQL = "list_slice(list(struct_pack(event_id := event_id, entity_id := entity_id) ORDER BY event_id, entity_id), 1, 5)"
SAMPLED_RULES = {
    "position outside [1, 34]": ("warning", "position < 1 OR position > 34"),
    "unfinished with position": ("warning", "NOT finished AND position IS NOT NULL"),
    "finished without position": ("error", "finished AND position IS NULL"),
}


@query(
    "b10_rule_samples",
    sql(
        f"WITH {RAW_CTE} "
        + " UNION ALL ".join(
            f"""SELECT '{name}' AS rule, '{severity}' AS severity, COUNT(*) AS n,
            array_to_string(list_transform({SAMPLE_SQL}, lambda x: x.event_id || ':' || x.entity_id), ' ') AS sample FROM raw WHERE {broken}"""
            for name, (severity, broken) in SAMPLED_RULES.items()
        ),
        "statused",
    ),
)
def b10_samples(spark, folder):
    rules = [r for r in result_rules() if r.name in SAMPLED_RULES]
    out = Q.run_rules_sampled(raw_results(spark, folder), rules, ["event_id", "entity_id"])
    shown = F.transform("sample", lambda k: F.concat_ws(":", k["event_id"].cast("string"), k["entity_id"].cast("string")))
    return out.withColumn("sample", F.when(F.col("n") > 0, F.array_join(shown, " ")))


@query(
    "b17_observed_write",
    sql(
        f"WITH {RAW_CTE}, rules AS ({RULES_SQL}) SELECT rule, severity, n FROM rules WHERE rule NOT LIKE 'repeated%' "
        "UNION ALL SELECT 'rows written', 'note', COUNT(*) FROM raw",
        "statused",
    ),
)
def b17_observed(spark, folder):
    # The write itself counts; the report starts no job over the rows.
    path = new_path(spark, "b17")
    seen = write_checked(raw_results(spark, folder), path, result_rules(), ["season"], lambda counts, rows: None)
    return seen.report().unionByName(Q.counted(spark, "rows written", "note", seen.count()))


@query(
    "b11_input_suite",
    """SELECT 'customer key' AS rule, 'error' AS severity, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS n FROM (SELECT COUNT(*) AS n FROM customer GROUP BY c_custkey HAVING COUNT(*) > 1)
    UNION ALL SELECT 'nation key', 'error', CAST(COALESCE(SUM(n), 0) AS BIGINT) FROM (SELECT COUNT(*) AS n FROM nation GROUP BY n_nationkey HAVING COUNT(*) > 1)
    UNION ALL SELECT 'line pairs', 'error', CAST(COALESCE(SUM(n), 0) AS BIGINT) FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1)
    UNION ALL SELECT 'o_custkey is null', 'error', COUNT(*) - COUNT(o_custkey) FROM orders
    UNION ALL SELECT 'o_orderkey is null', 'error', COUNT(*) - COUNT(o_orderkey) FROM orders""",
)
def b11(spark, folder):
    from formbook.operators.setops import concat

    return concat(
        [
            Q.duplicate_rows(table(spark, folder, "customer"), ["c_custkey"], "customer key"),
            Q.duplicate_rows(table(spark, folder, "nation"), ["n_nationkey"], "nation key"),
            Q.duplicate_rows(table(spark, folder, "lineitem"), LINE_KEY, "line pairs"),
            Q.run_rules(table(spark, folder, "orders"), Q.not_null("o_custkey", "o_orderkey")),
        ]
    )


@query(
    "b12_closed_schema",
    "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus",
)
def b12(spark, folder):
    # Raises on a missing or extra column; only then are the rows read.
    closed = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    return Q.value_counts(require_schema(table(spark, folder, "orders"), closed), "o_orderstatus")


@query(
    "b13_orphans",
    """SELECT 'orders without customer' AS rule, 'error' AS severity, COUNT(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'lines without order', 'error', COUNT(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'lines without small part', 'error', COUNT(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)""",
)
def b13(spark, folder):
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey")
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_partkey")
    customer = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"))
    parts = table(spark, folder, "part").where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"))
    known = orders.select(F.col("o_orderkey").alias("l_orderkey"))
    return (
        Q.orphans(orders, customer, "o_custkey", "orders without customer")
        .unionByName(Q.orphans(lines, known, "l_orderkey", "lines without order"))
        .unionByName(Q.orphans(lines, parts, "l_partkey", "lines without small part"))
    )


@query(
    "b14_one_winner_per_event",
    sql(
        "SELECT event_id, CAST(SUM(CASE WHEN finish_order <= 2 THEN finished ELSE 0 END) AS BIGINT) AS winners FROM contest GROUP BY event_id "
        "HAVING SUM(CASE WHEN finish_order <= 2 THEN finished ELSE 0 END) <> 1",
        "contest",
    ),
)
def b14(spark, folder):
    # The first two places stand in for winners, so some events break the rule.
    df = contest.facts(spark, folder).withColumn(
        "winner", F.when(F.col("finish_order") <= 2, F.col("finished")).otherwise(0)
    )
    return Q.events_without_one_winner(df)


@query(
    "b15_leakage_check",
    sql("SELECT event_id, entity_id, grid, quali_position, winner FROM contest", "contest"),
)
def b15(spark, folder):
    # The outcome columns found in the frame are the ones that go.
    df = contest.facts(spark, folder).select(
        "event_id", "entity_id", "grid", "quali_position", "winner", "points", "position", "finished"
    )
    return df.drop(*leaked_outcomes(df.columns))


@query(
    "b16_null_rates",
    sql(
        """SELECT 'q2' AS "column", round(AVG(CASE WHEN q2 IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_rate, AVG(CASE WHEN q2 IS NULL THEN 1.0 ELSE 0.0 END) > 0.6 AS warn FROM contest
        UNION ALL SELECT 'position', round(AVG(CASE WHEN position IS NULL THEN 1.0 ELSE 0.0 END), 6), AVG(CASE WHEN position IS NULL THEN 1.0 ELSE 0.0 END) > 0.6 FROM contest
        UNION ALL SELECT 'temp', round(AVG(CASE WHEN temp IS NULL THEN 1.0 ELSE 0.0 END), 6), AVG(CASE WHEN temp IS NULL THEN 1.0 ELSE 0.0 END) > 0.6 FROM contest""",
        "contest",
    ),
)
def b16(spark, folder):
    out = Q.null_rates(contest.facts(spark, folder), ["q2", "position", "temp"])
    return out.select("column", r6("null_rate"), "warn")


@query(
    "b17_guarded_join",
    sql(
        "SELECT COUNT(*) AS rows_before, (SELECT COUNT(*) FROM contest LEFT JOIN customer ON c_custkey = entity_id) AS rows_after FROM contest",
        "contest",
    ),
)
def b17(spark, folder):
    facts = contest.facts(spark, folder).select("event_id", "entity_id")
    side = table(spark, folder, "customer").select(F.col("c_custkey").alias("entity_id"), "c_name")
    after = J.guarded_join(facts, side, ["entity_id"], "customer")
    count = F.count(F.lit(1))
    before = facts.agg(count).scalar()
    return after.agg(before.alias("rows_before"), count.alias("rows_after"))


@query(
    "b18_value_counts",
    sql("SELECT result_status, COUNT(*) AS n FROM statused GROUP BY result_status", "statused"),
)
def b18(spark, folder):
    return Q.value_counts(with_status(contest.facts(spark, folder)), "result_status")


@query(
    "b19_calendar_integrity",
    sql(
        """SELECT 'event in two slots' AS rule, 'error' AS severity, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS n FROM (SELECT COUNT(*) AS n FROM calendar GROUP BY event_id HAVING COUNT(*) > 1)
        UNION ALL SELECT 'slot with two events', 'error', CAST(COALESCE(SUM(n), 0) AS BIGINT) FROM (SELECT COUNT(*) AS n FROM calendar GROUP BY season, round % 6 HAVING COUNT(*) > 1)""",
        "calendar",
    ),
)
def b19(spark, folder):
    calendar = J.calendar_of(contest.facts(spark, folder))
    # Half-year slots hold two events each: the rule must report them.
    slots = calendar.withColumn("round", F.col("round") % 6)
    return Q.duplicate_rows(calendar, ["event_id"], "event in two slots").unionByName(
        Q.duplicate_rows(slots, ["season", "round"], "slot with two events")
    )


@query(
    "b22_missing_inputs",
    sql(
        """SELECT event_id, concat_ws(',', CASE WHEN COUNT(*) > COUNT(q1) THEN 'q1' END, CASE WHEN COUNT(*) > COUNT(q2) THEN 'q2' END,
        CASE WHEN COUNT(*) > COUNT(precip) THEN 'precip' END) AS missing,
        CASE WHEN COUNT(q2) = COUNT(*) THEN 'complete' WHEN COUNT(q2) > 0 THEN 'in_progress' ELSE 'not_started' END AS status FROM contest GROUP BY event_id""",
        "contest",
    ),
)
def b22(spark, folder):
    return missing_inputs(contest.facts(spark, folder), ["q1", "q2", "precip"], "q2")


def missing_inputs(df, columns, session, event="event_id"):
    """Per event: columns with any NULL, and how far the session has come."""
    gaps = [F.when(F.bool_or(F.col(c).isNull()), F.lit(c)) for c in columns]
    there = F.col(session).isNotNull()
    status = (
        F.when(F.bool_and(there), "complete").when(F.bool_or(there), "in_progress")
    ).otherwise("not_started")
    return df.groupBy(event).agg(
        F.concat_ws(",", *gaps).alias("missing"), status.alias("status")
    )


@query(
    "b23_completeness_filter",
    sql(
        """SELECT event_id, entity_id FROM contest WHERE event_id IN (SELECT event_id FROM contest GROUP BY event_id
        HAVING SUM(CASE WHEN finish_order = 1 THEN finished ELSE 0 END) = 1)""",
        "contest",
    ),
)
def b23(spark, folder):
    df = contest.facts(spark, folder).withColumn(
        "confirmed", F.when(F.col("finish_order") == 1, F.col("finished")).otherwise(0)
    )
    open_events = Q.events_without_one_winner(df, winner="confirmed").select("event_id")
    return J.checked_join(df, open_events, ["event_id"], "left_anti").select(
        "event_id", "entity_id"
    )
