"""The contest facts derived from orders and customers.

An event is a calendar month, an entity a customer, a group the customer's
nation, a venue the month of the year. Customers are ordered within a month by
what they spent. With months as events a single event holds over a percent of
all rows at any scale, so every ranking goes through ``hot.rank_within``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formbook.operators.hot import rank_within
from formbook.session import staged
from formbook.sources.tables import table

# --- fixed values --------------------------------------------------------------
POINTS = {1: 25, 2: 18, 3: 15, 4: 12, 5: 10, 6: 8, 7: 6, 8: 4, 9: 2, 10: 1}
# ------------------------------------------------------------------------------


def _build_facts(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(
        spark, folder, "orders",
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
    )
    # Aggregated before the join: one row per customer and month meets customer.
    monthly = orders.groupBy(
        F.year("o_orderdate").cast("long").alias("season"),
        F.month("o_orderdate").cast("long").alias("round"),
        F.col("o_custkey").alias("entity_id"),
    ).agg(
        # Cents as long: exact, and cheaper to add than wide decimals.
        F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("score"),
        F.min("o_orderkey").alias("first_order"),
        F.max((F.col("o_orderstatus") == "F").cast("long")).alias("finished"),
    )
    members = table(spark, folder, "customer", "c_custkey", "c_nationkey").select(
        F.col("c_custkey").alias("entity_id"), F.col("c_nationkey").cast("long").alias("group_id")
    )
    # Written once: both ranks and the count of event sizes read it.
    entered = staged(spark, ("entered", folder), lambda: monthly.join(members, "entity_id"))
    month = ["season", "round"]
    most = entered.groupBy(*month).count().agg(F.max("count")).first()[0] or 0
    ranked = rank_within(entered, month, [("score", False), ("entity_id", True)], "finish_order", most)
    ranked = rank_within(ranked, month, [("first_order", True), ("entity_id", True)], "quali_position", most)
    e, q, s, r = F.col("entity_id"), F.col("quali_position"), F.col("season"), F.col("round")
    points = F.lit(0)
    for place, score in reversed(POINTS.items()):
        points = F.when(F.col("finish_order") == place, score).otherwise(points)

    def clock(base: int, millis: int):
        return F.concat(
            F.lit("1:"),
            F.lpad((base + e * 7 % 30).cast("string"), 2, "0"),
            F.lit("."),
            F.lpad((e * millis % 1000).cast("string"), 3, "0"),
        )

    done = F.col("finished") == 1
    wet = F.when((s + r) % 13 != 0, ((s * 31 + r * 17) % 10).cast("double") / 10)
    quali_wet = F.when((s + r) % 7 != 0, ((s * 13 + r * 29) % 10).cast("double") / 10)
    return ranked.select(
        (s * 100 + r).alias("event_id"),
        "season",
        "round",
        r.alias("venue_id"),
        "entity_id",
        "group_id",
        "finish_order",
        "finished",
        "quali_position",
        F.when(e % 17 == 0, 0).otherwise(q).alias("grid"),
        (F.col("finish_order") == 1).cast("long").alias("winner"),
        F.when(done, F.col("finish_order")).alias("position"),
        points.cast("long").alias("points"),
        clock(20, 131).alias("q1"),
        F.when(q <= 15, clock(19, 97)).alias("q2"),
        F.when(q <= 10, clock(19, 61)).alias("q3"),
        wet.alias("precip"),
        F.when((s + r) % 11 != 0, ((s * 7 + r * 3) % 30).cast("double")).alias("temp"),
        quali_wet.alias("quali_precip"),
        F.when(done, F.col("finish_order").cast("string"))
        .when(e % 5 == 0, "R")
        .when(e % 5 == 1, "D")
        .when(e % 5 == 2, "W")
        .when(e % 5 == 3, "N")
        .alias("position_text"),
        F.when(done, 1)
        .when(e % 6 == 0, 2)
        .when(e % 6 == 1, 96)
        .when(e % 6 == 2, 54)
        .when(e % 6 == 3, 81)
        .when(e % 6 == 4, 3)
        .cast("long")
        .alias("status_id"),
        F.col("first_order").alias("result_id"),
    )


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """Contest facts, staged once per session and partitioned by season."""
    return staged(
        spark, ("contest", folder), lambda: _build_facts(spark, folder), ("season",)
    ).withColumn("season", F.col("season").cast("long"))


def standings(fact: DataFrame) -> DataFrame:
    """Season totals of each entity after each of its events, with its place."""
    running = _running(fact, "entity_id")
    return rank_within(
        running, ["event_id"], [("points", False), ("entity_id", True)], "position"
    )


def group_standings(fact: DataFrame) -> DataFrame:
    """Season totals of each group after each of its events, with its place."""
    per_event = fact.groupBy("event_id", "season", "round", "group_id").agg(
        F.sum("points").alias("points"), F.max("winner").alias("winner")
    )
    running = _running(per_event, "group_id")
    return rank_within(
        running, ["event_id"], [("points", False), ("group_id", True)], "position"
    )


def _running(rows: DataFrame, entity: str) -> DataFrame:
    # A season's rounds bound each (season, entity) group.
    so_far = (
        Window.partitionBy("season", entity)
        .orderBy("round", "event_id")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return rows.select(
        "event_id",
        "season",
        "round",
        entity,
        F.sum("points").over(so_far).alias("points"),
        F.sum("winner").over(so_far).alias("wins"),
    )


def conditions(fact: DataFrame) -> DataFrame:
    """One weather row per event; ``changed`` is text as a CSV would hold it."""
    from formbook.functions.scalars import condition_changed

    changed = condition_changed(F.col("quali_precip"), F.col("precip"))
    return (
        fact.select("event_id", "precip", "temp", "quali_precip")
        .distinct()
        .withColumn(
            "changed_text",
            F.when(changed, "True").when(~changed, "False").otherwise(""),
        )
    )


def season_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entity standings, group standings and conditions as stored tables.

    These are inputs of their own in the domain, so they are staged as such.
    """
    made = {"standings": standings, "group_standings": group_standings, "conditions": conditions}
    return tuple(
        staged(spark, (name, folder), lambda build=build: build(facts(spark, folder)))
        for name, build in made.items()
    )


def weather_columns(conditions: DataFrame) -> DataFrame:
    """Stored conditions under the names the feature build reads."""
    from formbook.functions.scalars import flag_from_text

    return conditions.select(
        "event_id",
        "precip",
        F.col("temp").alias("race_temp_c"),
        F.col("quali_precip").alias("quali_precip_mm"),
        flag_from_text("changed_text").alias("conditions_changed"),
    )


def entities(spark: SparkSession, folder: str) -> DataFrame:
    return table(
        spark, folder, "customer",
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal",
    )
