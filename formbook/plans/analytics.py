"""Historical analytics over the contest facts: all keys at once, filter after."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formbook.operators.joins import checked_join


def centred_mean(
    df: DataFrame, order: str, value: str, out: str, by: Sequence[str] = (), reach: int = 2,
    least: int = 3,
) -> DataFrame:
    """Mean over ``reach`` rows on each side, NULL with fewer than ``least`` values.

    Meant for season-level tables: a few rows per key.
    """
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(-reach, reach)
    mean = F.when(F.count(value).over(frame) >= least, F.avg(value).over(frame))
    return df.withColumn(out, mean)


# --- fixed values --------------------------------------------------------------
MIN_EVENTS = 3
LOOKBACK_SEASONS = 5
MIN_STARTS = 50
TREND_MIN_EVENTS = 4
DOMINANCE_MIN_PICKS = 2
STATUS_ORDER = ("Finished", "Retired", "Did Not Start", "Withdrawn", "Disqualified")
# ------------------------------------------------------------------------------



def won() -> Column:
    """First among those who finished."""
    return F.coalesce((F.col("position") == 1) & (F.col("finished") == 1), F.lit(False))


def on_podium() -> Column:
    return F.coalesce(F.col("position").isin(1, 2, 3) & (F.col("finished") == 1), F.lit(False))


def share_where(cond: Column) -> Column:
    """Share of rows for which ``cond`` holds."""
    return F.avg(F.coalesce(cond, F.lit(False)).cast("double"))


# Events and venues -------------------------------------------------------------


def event_summary(facts: DataFrame) -> DataFrame:
    return facts.groupBy("event_id", "season", "round").agg(F.count(F.lit(1)).alias("n_entrants"))


def venue_catalogue(venues: DataFrame, facts: DataFrame) -> DataFrame:
    held = facts.groupBy("venue_id").agg(F.count_distinct("event_id").alias("events_held"))
    out = venues.join(held, "venue_id", "left")
    return out.withColumn("events_held", F.coalesce("events_held", F.lit(0)))


def venue_stats(facts: DataFrame) -> DataFrame:
    """Per venue: events, first and last season, dropout rate, places gained."""
    counted = (F.col("grid") > 0) & F.col("position").isNotNull()
    change = F.when(counted, F.col("grid") - F.col("position"))
    return facts.groupBy("venue_id").agg(
        F.count_distinct("event_id").alias("events_held"),
        F.min("season").alias("first_season"),
        F.max("season").alias("last_season"),
        share_where(F.col("position").isNull()).alias("dnf_rate"),
        F.when(F.count(change) >= MIN_EVENTS, F.avg(change)).alias("avg_position_change"),
    )


def fastest_laps(facts: DataFrame, seconds: Column, text: str) -> DataFrame:
    """The quickest lap per venue, earliest event and smallest id among equals."""
    timed = facts.withColumn("_s", seconds).where("_s IS NOT NULL")
    best = F.struct("_s", "season", "round", "entity_id", F.col(text).alias("lap"))
    return (
        timed.groupBy("venue_id")
        .agg(F.min(best).alias("b"))
        .select("venue_id", "b.lap", "b._s", "b.season", "b.entity_id")
        .withColumnRenamed("_s", "seconds")
    )


def winners_by_season(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("position") == 1).select("venue_id", "season", "entity_id", "group_id")


def most_wins(facts: DataFrame, k: int = 5) -> DataFrame:
    """Top ``k`` winners per venue; the smaller id goes first among equals."""
    wins = (
        facts.where(F.col("position") == 1)
        .groupBy("venue_id", "entity_id")
        .agg(F.count(F.lit(1)).alias("wins"))
    )
    place = F.row_number().over(
        Window.partitionBy("venue_id").orderBy(F.desc("wins"), F.asc("entity_id"))
    )
    return wins.withColumn("place", place.cast("long")).where(F.col("place") <= k)


def venue_risk(facts: DataFrame, seasons: int = LOOKBACK_SEASONS) -> DataFrame:
    """Dropout rate at the venue over the seasons before, per (venue, season).

    Each season's totals are sent to the seasons that look back on it, so the
    look-back is an equi-join on (venue, season). Fewer than three events give
    no row.
    """
    yearly = facts.groupBy("venue_id", "season").agg(
        F.count_distinct("event_id").alias("events"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("position").isNull()).alias("dnf"),
    )
    ahead = yearly.select(
        "venue_id",
        F.col("season").alias("_from"),
        F.explode(F.sequence(F.col("season") + 1, F.col("season") + seasons)).alias("season"),
        "events",
        "n",
        "dnf",
    )
    return (
        yearly.select("venue_id", "season")
        .join(ahead, ["venue_id", "season"])
        .groupBy("venue_id", "season")
        .agg(
            F.try_divide(F.sum("dnf"), F.sum("n")).alias("dnf_rate"),
            F.sum("events").alias("n_events"),
            F.min("_from").alias("from_season"),
            F.max("_from").alias("to_season"),
        )
        .where(F.col("n_events") >= MIN_EVENTS)
    )


def event_facts(facts: DataFrame) -> DataFrame:
    """Per event: entries, winner's text and the pole entrant's best session text."""
    pole = F.col("quali_position") == 1
    return facts.groupBy("event_id").agg(
        F.max("finish_order").alias("laps"),
        F.max(F.when(F.col("position") == 1, F.col("q1"))).alias("fastest_lap"),
        F.max(F.when(pole, F.coalesce("q3", "q2", "q1"))).alias("pole_time"),
    )


def race_facts(
    results: DataFrame, qualifying: DataFrame, races: DataFrame, circuits: DataFrame
) -> DataFrame:
    """Per race: name, date and place, laps run, fastest lap and pole time as text.

    Laps are the most that anyone ran; the fastest lap is the first text of rank 1; the
    pole time is the last session's time of the first entry on position 1. NULL where
    a table has nothing on the race.
    """
    fastest = (F.col("rank") == 1) & F.col("fastestLapTime").isNotNull()
    run = results.groupBy("raceId").agg(
        F.max("laps").alias("laps"),
        F.min(F.when(fastest, F.struct("resultId", "fastestLapTime")))["fastestLapTime"].alias("fastest_lap"),
    )
    first = F.min(F.struct("qualifyId", F.coalesce("q3", "q2", "q1").alias("time")))
    pole = qualifying.where("position = 1").groupBy("raceId").agg(first["time"].alias("pole_time"))
    places = circuits.select("circuitId", F.col("name").alias("circuit"), "country", "location")
    named = checked_join(races.select("raceId", "circuitId", F.col("name").alias("grand_prix"), "date"), places, ["circuitId"])
    return named.join(run, "raceId", "left").join(pole, "raceId", "left").drop("circuitId")


# Entities and groups -----------------------------------------------------------


def _both_scopes(df: DataFrame, key: str, *aggs: Column) -> DataFrame:
    """Per (key, season) and per key over all seasons (season NULL)."""
    k, s = F.col(key), F.col("season")
    return df.groupingSets([[k, s], [k]], k, s).agg(*aggs)


def entity_stats(facts: DataFrame) -> DataFrame:
    """Season and career statistics of every entity."""
    position = F.col("position")
    return _both_scopes(
        facts,
        "entity_id",
        F.count(F.lit(1)).alias("events"),
        F.count_if(position == 1).alias("wins"),
        F.count_if(position <= 3).alias("podiums"),
        F.avg("finish_order").alias("avg_finish"),
        F.avg(position).alias("avg_finish_classified"),
        F.when(F.count(position) >= MIN_EVENTS, F.stddev_samp(position)).alias("consistency_std"),
        F.count_if(F.col("quali_position") == 1).alias("poles"),
        F.avg("quali_position").alias("avg_quali"),
    )


def group_stats(facts: DataFrame) -> DataFrame:
    """Season and career statistics of every group; events count once per group."""
    per_event = facts.groupBy("group_id", "season", "event_id").agg(
        F.count_if(F.col("position") == 1).alias("wins"),
        F.count_if(F.col("position") <= 3).alias("podiums"),
        F.sum("quali_position").alias("quali"),
        F.count("quali_position").alias("n_quali"),
    )
    return _both_scopes(
        per_event,
        "group_id",
        F.count(F.lit(1)).alias("events"),
        F.sum("wins").alias("wins"),
        F.sum("podiums").alias("podiums"),
        F.try_divide(F.sum("quali"), F.sum("n_quali")).alias("avg_quali"),
    )


def group_event_results(facts: DataFrame) -> DataFrame:
    return facts.groupBy("group_id", "event_id", "season", "round").agg(
        F.min("finish_order").alias("best_finish"), F.avg("quali_position").alias("avg_quali")
    )


def group_roster(facts: DataFrame) -> DataFrame:
    """Entrants of each group and season, one row each."""
    return facts.select("group_id", "season", "entity_id").distinct()


def final_standings(standings: DataFrame) -> DataFrame:
    """Standings after the last round of each season that has any."""
    last = standings.groupBy("season").agg(F.max("round").alias("round"))
    return standings.join(F.broadcast(last), ["season", "round"], "left_semi")


def official_points(standings: DataFrame, entity: str) -> DataFrame:
    """Points of each season's final table and their sum over seasons (NULL season)."""
    final = final_standings(standings)
    return _both_scopes(final, entity, F.sum("points").alias("points"))


# Distributions over the whole history ------------------------------------------


def overview(facts: DataFrame) -> DataFrame:
    return facts.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("season").alias("first_season"),
        F.max("season").alias("last_season"),
        F.count_distinct("event_id").alias("events"),
        F.count_distinct("entity_id").alias("entities"),
        F.count_distinct("group_id").alias("groups"),
        F.count_if(won()).alias("wins"),
        (100 * share_where(won())).alias("win_pct"),
    )


def wins_by_grid(facts: DataFrame) -> DataFrame:
    return (
        facts.where(F.col("grid") > 0)
        .groupBy("grid")
        .agg(F.count(F.lit(1)).alias("starts"), F.count_if(won()).alias("wins"))
        .withColumn("win_rate", 100 * F.try_divide("wins", "starts"))
    )


def top_grid_share(by_grid: DataFrame, slots: int = 20, tops: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """Share of wins within the first ``slots`` that came from the first N."""
    held = by_grid.where(F.col("grid") <= slots).agg(
        F.sum("wins").alias("total"),
        *[F.sum(F.when(F.col("grid") <= n, F.col("wins"))).alias(f"_{n}") for n in tops],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(n).cast("long").alias("top"),
                (100 * F.try_divide(F.col(f"_{n}"), "total")).alias("share"),
            )
            for n in tops
        ]
    )
    return held.select(F.inline(rows))


def wins_by_group_season(facts: DataFrame) -> DataFrame:
    return (
        facts.where(won()).groupBy("season", "group_id").agg(F.count(F.lit(1)).alias("wins"))
    )


def top_groups(by_season: DataFrame, k: int = 8) -> DataFrame:
    return (
        by_season.groupBy("group_id")
        .agg(F.sum("wins").alias("wins"))
        .orderBy(F.desc("wins"), F.asc("group_id"))
        .limit(k)
    )


def wins_pivot(by_season: DataFrame, k: int = 8) -> DataFrame:
    """Season by top group: column ``top_i`` is the i-th group of all time, 0 filled."""
    place = F.row_number().over(Window.orderBy(F.desc("wins"), F.asc("group_id")))
    # At most k rows reach this window.
    top = top_groups(by_season, k).withColumn("place", place).drop("wins")
    ranked = by_season.join(F.broadcast(top), "group_id")
    return (
        ranked.groupBy("season")
        .pivot("place", list(range(1, k + 1)))
        .agg(F.sum("wins"))
        .na.fill(0)
        .select("season", *[F.col(str(i)).alias(f"top_{i}") for i in range(1, k + 1)])
    )


def status_composition(facts: DataFrame, status: str = "result_status") -> DataFrame:
    """Rows and percent of the season per outcome category."""
    counts = facts.groupBy("season", status).agg(F.count(F.lit(1)).alias("count"))
    # Six categories per season.
    total = F.sum("count").over(Window.partitionBy("season"))
    return counts.withColumn("pct", 100 * F.col("count") / total)


def status_pivot(composition: DataFrame, status: str = "result_status") -> DataFrame:
    wide = (
        composition.groupBy("season").pivot(status, list(STATUS_ORDER)).agg(F.sum("pct")).na.fill(0.0)
    )
    return wide.select(
        "season", *[F.col(s).alias(s.lower().replace(" ", "_")) for s in STATUS_ORDER]
    )


def concentration(by_season: DataFrame, key: str = "season") -> DataFrame:
    """Sum of squared win shares; 0 without wins."""
    total = F.sum("wins")
    return by_season.groupBy(key).agg(
        F.coalesce(
            F.try_divide(F.sum(F.col("wins") * F.col("wins")).cast("double"), total * total),
            F.lit(0.0),
        ).alias("hhi")
    )


def career_leaders(facts: DataFrame, min_starts: int = MIN_STARTS) -> DataFrame:
    careers = facts.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("starts"),
        F.count_if(won()).alias("wins"),
        F.count_if(on_podium()).alias("podiums"),
    )
    return careers.where(F.col("starts") >= min_starts).withColumns(
        {
            "win_rate": F.try_divide("wins", "starts"),
            "podium_rate": F.try_divide("podiums", "starts"),
        }
    )


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts in ``bins`` equal bins from the smallest to the largest value.

    The largest value belongs to the last bin; empty bins are left out.
    """
    lo, hi = df.agg(F.min(value)).scalar(), df.agg(F.max(value)).scalar()
    spread = F.try_divide((F.col(value) - lo) * bins, hi - lo)
    index = F.least(F.lit(bins - 1), F.coalesce(F.floor(spread), F.lit(0))).cast("long")
    return (
        df.where(F.col(value).isNotNull())
        .withColumn("bin", index)
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def season_structure(facts: DataFrame) -> DataFrame:
    pole = F.col("grid") == 1
    return facts.groupBy("season").agg(
        F.count_distinct("event_id").alias("events"),
        F.count_distinct("entity_id").alias("entities"),
        F.count_if(pole).alias("pole_starts"),
        F.count_if(pole & won()).alias("pole_wins"),
        (100 * F.try_divide(F.count_if(pole & won()), F.count_if(pole))).alias("conversion"),
        F.max("points").alias("max_points"),
    )


def era_rates(facts: DataFrame, eras: Sequence[tuple]) -> DataFrame:
    """Rates per era; eras may overlap. Seasons are summed before they meet the eras."""
    from formbook.operators.joins import within_windows

    started = facts.where(F.col("grid") > 0)
    seasons = started.groupBy("season").agg(
        F.count_distinct("event_id").alias("events"),
        F.count(F.lit(1)).alias("entries"),
        F.count_if(F.col("grid") == 1).alias("poles"),
        F.count_if((F.col("grid") == 1) & won()).alias("pole_wins"),
        F.count_if(F.col("grid") <= 3).alias("top3"),
        F.count_if((F.col("grid") <= 3) & won()).alias("top3_wins"),
        F.sum("finished").alias("finishes"),
    )
    names = ("events", "entries", "poles", "pole_wins", "top3", "top3_wins", "finishes")
    sums = within_windows(seasons, "season", eras, ["era"]).groupBy("era").agg(
        *[F.sum(n).alias(n) for n in names]
    )

    def pct(a: str, b: str) -> Column:
        return F.round(100 * F.try_divide(a, b), 1)

    return sums.select(
        "era",
        "events",
        "entries",
        pct("pole_wins", "poles").alias("pole_win_pct"),
        pct("top3_wins", "top3").alias("top3_win_pct"),
        pct("finishes", "entries").alias("finish_pct"),
    )


def before_and_after(facts: DataFrame, season: int) -> DataFrame:
    pole = F.col("grid") == 1
    return facts.groupBy((F.col("season") >= season).alias("modern")).agg(
        (100 * F.avg("finished")).alias("finish_pct"),
        (100 * F.try_divide(F.count_if(pole & won()), F.count_if(pole))).alias("pole_win_pct"),
    )


# Radar -------------------------------------------------------------------------


def radar_pool(stats: DataFrame) -> DataFrame:
    """Season rows of ``entity_stats`` that have all three radar values."""
    return stats.where(
        "season IS NOT NULL AND avg_quali IS NOT NULL AND avg_finish_classified IS NOT NULL "
        "AND consistency_std IS NOT NULL"
    ).select("entity_id", "season", "avg_quali", "avg_finish_classified", "consistency_std")


def radar_scores(pool: DataFrame) -> DataFrame:
    """0-100 within the season's pool, the smallest value best; pools of one drop out."""
    from formbook.operators.joins import join_back

    axes = {
        "avg_quali": "qualifying_pace",
        "avg_finish_classified": "race_pace",
        "consistency_std": "consistency",
    }
    bounds = [F.count(F.lit(1)).alias("_n")]
    for c in axes:
        bounds += [F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}")]
    out = join_back(pool, ["season"], *bounds).where("_n >= 2")
    scores = {}
    for c, name in axes.items():
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        scores[name] = F.when(hi <= lo, 100.0).otherwise(
            100 * (1 - F.try_divide(F.col(c) - lo, hi - lo))
        )
    return out.select("entity_id", "season", *[v.alias(n) for n, v in scores.items()])


# Season analytics of scored events ----------------------------------------------


def hit_rate(scored: DataFrame) -> DataFrame:
    """Per season: share of events whose first pick won, and mean field size."""
    events = scored.groupBy("season", "event_id").agg(
        F.max(F.when(F.col("predicted_rank") == 1, F.col("winner"))).alias("hit"),
        F.count(F.lit(1)).alias("field"),
    )
    return events.groupBy("season").agg(
        F.count(F.lit(1)).alias("events"),
        F.avg("hit").alias("hit_rate"),
        F.avg("field").alias("mean_field"),
    )


def top_picks(scored: DataFrame) -> DataFrame:
    return scored.where("predicted_rank = 1")


def most_picked(scored: DataFrame) -> DataFrame:
    return top_picks(scored).groupBy("season", "entity_id").agg(
        F.count(F.lit(1)).alias("picks"),
        F.max_by("group_id", "round").alias("last_group"),
    )


def dominance(scored: DataFrame, min_picks: int = DOMINANCE_MIN_PICKS) -> DataFrame:
    return (
        top_picks(scored)
        .groupBy("season", "entity_id")
        .agg(F.avg("p").alias("mean_share"), F.count(F.lit(1)).alias("picks"))
        .where(F.col("picks") >= min_picks)
    )


def biggest_surprises(scored: DataFrame, k: int = 3) -> DataFrame:
    """Winners with the worst predicted rank, per season."""
    place = F.row_number().over(
        Window.partitionBy("season").orderBy(F.desc("predicted_rank"), F.asc("event_id"))
    )
    winners = scored.where("winner = 1").withColumn("place", place.cast("long"))
    return winners.where(F.col("place") <= k)


def season_halves(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean predicted rank in the first and second half of an entity's events.

    ``by`` is the entity with or without its season: an entity enters an event
    once, so its rows are bounded by the calendar.
    """
    order = Window.partitionBy(*by).orderBy("season", "round")
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    at = F.row_number().over(order)
    halves = scored.select(*by, "predicted_rank", "winner", at.alias("_at"), n.alias("_n"))
    early = F.col("_at") <= F.floor(F.col("_n") / 2)
    return halves.groupBy(*by).agg(
        F.count(F.lit(1)).alias("events"),
        F.avg("predicted_rank").alias("mean_rank"),
        F.min("predicted_rank").alias("best_rank"),
        F.sum("winner").alias("wins"),
        F.avg(F.when(early, F.col("predicted_rank"))).alias("early_rank"),
        F.avg(F.when(~early, F.col("predicted_rank"))).alias("recent_rank"),
    ).withColumn("delta", F.col("recent_rank") - F.col("early_rank"))


def rising_and_fading(scored: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` most improved and most faded entities of each season."""
    trend = season_halves(scored, ["season", "entity_id"]).where(
        F.col("events") >= TREND_MIN_EVENTS
    )

    def first(order, side: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("season").orderBy(*order))
        top = trend.withColumn("place", place.cast("long")).where(F.col("place") <= k)
        return top.withColumn("side", F.lit(side))

    return first([F.asc("delta"), F.asc("entity_id")], "rising").unionByName(
        first([F.desc("delta"), F.asc("entity_id")], "fading")
    )


def group_outlook(scored: DataFrame, k: int = 8) -> DataFrame:
    means = scored.groupBy("season", "group_id").agg(F.avg("p").alias("mean_share"))
    place = F.row_number().over(
        Window.partitionBy("season").orderBy(F.desc("mean_share"), F.asc("group_id"))
    )
    return means.withColumn("place", place.cast("long")).where(F.col("place") <= k)


def pick_extremes(scored: DataFrame) -> DataFrame:
    """The most and least confident first pick of each season."""
    pick = F.struct("p", (-F.col("event_id")).alias("_e"), "event_id", "entity_id")
    low = F.struct("p", F.col("event_id").alias("_e"), "event_id", "entity_id")
    out = top_picks(scored).groupBy("season").agg(F.max(pick).alias("a"), F.min(low).alias("b"))
    return out.select(
        "season",
        F.col("a.event_id").alias("most_event"),
        F.col("a.entity_id").alias("most_entity"),
        F.col("a.p").alias("most_share"),
        F.col("b.event_id").alias("least_event"),
        F.col("b.entity_id").alias("least_entity"),
        F.col("b.p").alias("least_share"),
    )


def pick_accuracy(scored: DataFrame) -> DataFrame:
    """Per group: first picks, decided ones and hits."""
    return top_picks(scored).groupBy("group_id").agg(
        F.count(F.lit(1)).alias("picks"),
        F.count("winner").alias("decided"),
        F.count_if(F.col("winner") == 1).alias("hits"),
    )


def compare_entities(stats: DataFrame, scored: DataFrame, left: Column, right: Column) -> DataFrame:
    """Season statistics of two entities side by side with their mean share."""
    shares = scored.where(left | right).groupBy("entity_id", "season").agg(F.avg("p").alias("share"))
    names = ("events", "wins", "avg_quali", "avg_finish", "consistency_std")
    mine = stats.where(F.col("season").isNotNull() & (left | right)).join(
        shares, ["entity_id", "season"], "left"
    )

    def side(cond: Column, tag: str) -> list[Column]:
        return [F.max(F.when(cond, F.col(n))).alias(f"{n}_{tag}") for n in (*names, "share")]

    return mine.groupBy("season").agg(*side(left, "a"), *side(right, "b"))


def compare_at_events(scored: DataFrame, left: Column, right: Column) -> DataFrame:
    """Shares of two entities at every event that either entered; NULL for who did not."""
    mine = scored.where(left | right)
    return mine.groupBy("event_id", "season", "round").agg(
        *[F.max(F.when(cond, F.col("p"))).alias(f"share_{tag}") for cond, tag in ((left, "a"), (right, "b"))]
    )
