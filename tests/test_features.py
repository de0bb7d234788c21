"""Hand-computed values of the feature blocks on small frames."""

import pytest
from pyspark.sql import functions as F

from formbook import schemas as H
from formbook.functions import scalars as S
from formbook.operators.joins import JoinGuardError, RosterError, guarded_join, neighbours, roster_as_of
from formbook.plans import features as P
from formbook.plans.features import RACING

BASE = {
    "raceId": 1, "driverId": 1, "constructorId": 1, "circuitId": 1, "year": 2020, "round": 1,
    "grid": 1, "qualifying_position": 1, "q1": "1:25.000", "q2": "1:24.000", "q3": "1:23.000",
    "position": 1, "positionOrder": 1, "points": 25.0, "finished": True, "winner": 0,
    "race_precip_mm": None,
}
SCHEMA = (
    "raceId long, driverId long, constructorId long, circuitId long, year long, round long, "
    "grid long, qualifying_position long, q1 string, q2 string, q3 string, position long, "
    "positionOrder long, points double, finished boolean, winner long, race_precip_mm double"
)


def frame(spark, *rows):
    full = [{**BASE, **r} for r in rows]
    names = [f.strip().split()[0] for f in SCHEMA.split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], SCHEMA)


def one(df, race, driver=1):
    return df.where((F.col("raceId") == race) & (F.col("driverId") == driver)).first()


def test_entity_form_hand_computed(spark):
    df = frame(
        spark,
        {"raceId": 1, "round": 1, "positionOrder": 1, "winner": 1, "points": 25.0},
        {"raceId": 2, "round": 2, "positionOrder": 3, "points": 15.0},
        {"raceId": 3, "round": 3, "positionOrder": 18, "points": 0.0, "finished": False},
        {"raceId": 4, "round": 4},
    )
    row = one(P.entity_form(df, RACING), 4)
    assert row["driver_wins_last_5"] == 1
    assert row["driver_podiums_last_5"] == 2
    assert row["driver_avg_finish_last_5"] == pytest.approx(22 / 3)
    assert row["driver_dnf_rate_last_5"] == pytest.approx(1 / 3)
    assert row["driver_points_last_5"] == 40
    assert row["driver_experience_races"] == 3
    first = one(P.entity_form(df, RACING), 1)
    assert first["driver_wins_last_3"] is None and first["driver_experience_races"] == 0


def test_order_is_season_and_round_not_id(spark):
    df = frame(
        spark,
        {"raceId": 9, "year": 2019, "round": 1, "winner": 1},
        {"raceId": 1, "year": 2020, "round": 1},
    )
    assert one(P.entity_form(df, RACING), 1)["driver_wins_last_3"] == 1
    assert one(P.entity_form(df, RACING), 9)["driver_wins_last_3"] is None


def test_group_form_counts_events_not_rows(spark):
    rows = []
    for race in range(1, 5):
        rows.append({"raceId": race, "round": race, "driverId": 1, "winner": int(race < 4)})
        rows.append({"raceId": race, "round": race, "driverId": 2, "positionOrder": 9})
    out = P.group_form(frame(spark, *rows), RACING)
    assert [one(out, 4, d)["constructor_wins_last_3"] for d in (1, 2)] == [3, 3]
    # A team mate's win in the same event is not seen.
    assert one(out, 1, 2)["constructor_wins_last_3"] is None


def test_venue_history_hand_computed(spark):
    df = frame(
        spark,
        {"raceId": 1, "year": 2018, "circuitId": 7, "positionOrder": 1, "winner": 1},
        {"raceId": 2, "year": 2019, "circuitId": 7, "positionOrder": 4},
        {"raceId": 3, "year": 2020, "circuitId": 7},
    )
    out = P.venue_history(df, RACING)
    row = one(out, 3)
    assert (row["driver_circuit_starts"], row["driver_circuit_wins"]) == (2, 1)
    assert row["driver_circuit_avg_finish"] == 2.5 and row["constructor_circuit_wins"] == 1
    first = one(out, 1)
    assert first["driver_circuit_starts"] == 0 and first["driver_circuit_wins"] == 0
    assert first["driver_circuit_avg_finish"] is None


def test_standings_are_read_after_the_previous_event(spark):
    df = frame(spark, {"raceId": 1, "round": 1}, {"raceId": 2, "round": 2}, {"raceId": 3, "round": 3})
    own = spark.createDataFrame(
        [(1, 1, 25.0, 1, 1), (2, 1, 43.0, 1, 1)],
        "raceId long, driverId long, points double, position long, wins long",
    )
    group = spark.createDataFrame(
        [(1, 1, 30.0, 2, 1)],
        "raceId long, constructorId long, points double, position long, wins long",
    )
    out = P.standings_lag(df, own, group, RACING)
    assert one(out, 1)["driver_standing_points_prev"] is None
    assert one(out, 2)["driver_standing_points_prev"] == 25
    assert one(out, 3)["driver_standing_points_prev"] == 43
    assert one(out, 2)["constructor_standing_position_prev"] == 2
    assert one(out, 3)["constructor_standing_points_prev"] is None


def test_pit_lane_start_goes_behind_the_field(spark):
    df = frame(
        spark,
        {"driverId": 1, "grid": 1},
        {"driverId": 2, "grid": 2, "q3": None},
        {"driverId": 3, "grid": 0, "qualifying_position": None, "q2": None, "q3": None},
    )
    out = P.session_features(df, RACING)
    row = one(out, 1, 3)
    assert row["grid_adjusted"] == 4 and row["grid_position_norm"] == pytest.approx(4 / 3)
    assert row["pit_lane_start"] and not row["grid_penalty_applied"]
    assert not row["reached_q2"] and one(out, 1, 2)["reached_q2"]


def test_penalty_needs_more_than_three_places(spark):
    df = frame(
        spark,
        {"driverId": 1, "grid": 5, "qualifying_position": 2},
        {"driverId": 2, "grid": 6, "qualifying_position": 2},
    )
    out = P.session_features(df, RACING)
    assert not one(out, 1, 1)["grid_penalty_applied"] and one(out, 1, 2)["grid_penalty_applied"]


def test_gap_to_the_best_time(spark):
    df = frame(
        spark,
        {"driverId": 1, "q3": "1:24.000"},
        {"driverId": 2, "q3": None, "q2": "1:25.200"},
    )
    out = P.session_features(df, RACING)
    assert one(out, 1, 1)["qualifying_gap_to_pole_pct"] == 0
    assert one(out, 1, 2)["qualifying_gap_to_pole_pct"] == pytest.approx(1.2 / 84 * 100)


def test_lap_times(spark):
    texts = ["1:23.456", "59.5", "DNF", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(S.lap_seconds("t")).collect()]
    assert got[0] == pytest.approx(83.456) and got[1] == 59.5 and got[2:] == [None, None, None]
    strict = [r[0] for r in df.select(S.strict_lap_seconds("t")).collect()]
    assert strict[0] == pytest.approx(83.456) and strict[1:] == [None] * 4


def test_peer_gap_needs_another_value(spark):
    df = frame(
        spark,
        {"driverId": 1, "qualifying_position": 2, "positionOrder": 4},
        {"driverId": 2, "qualifying_position": 6, "positionOrder": 2},
        {"driverId": 3, "constructorId": 2, "qualifying_position": 1},
    )
    out = P.peer_gaps(df, RACING)
    assert one(out, 1, 1)["qualifying_gap_to_teammate_current"] == 4
    assert one(out, 1, 2)["_pace_gap"] == 2
    assert one(out, 1, 3)["qualifying_gap_to_teammate_current"] is None


def wet_rows():
    races = [(1.0, 1, 5), (0.0, 10, 5), (1.0, 1, 5), (0.0, 10, 5)]
    rows = []
    for race, (precip, a, b) in enumerate(races, start=1):
        for driver, order in ((1, a), (2, b)):
            rows.append(
                {
                    "raceId": race, "round": race, "driverId": driver, "constructorId": driver,
                    "positionOrder": order, "race_precip_mm": precip,
                }
            )
        rows.append(
            {
                "raceId": race, "round": race, "driverId": 3, "constructorId": 3,
                "positionOrder": 6, "race_precip_mm": 0.0,
            }
        )
    return rows


def test_shrunk_delta_hand_computed(spark):
    rows = [r for r in wet_rows() if r["driverId"] < 3]
    out = P.shrunk_delta(frame(spark, *rows), RACING)
    assert one(out, 1)["driver_wet_dry_delta"] is None
    assert one(out, 2)["driver_wet_dry_delta"] is None
    w = 1 / 9
    assert one(out, 3, 1)["driver_wet_dry_delta"] == pytest.approx(w * -9 + (1 - w) * -4.5)
    assert one(out, 3, 2)["driver_wet_dry_delta"] == pytest.approx((1 - w) * -4.5)
    # One entrant per group: both levels agree.
    assert one(out, 3, 1)["constructor_wet_dry_delta"] == pytest.approx(w * -9 + (1 - w) * -4.5)


def test_no_wet_history_gives_the_field_mean(spark):
    out = P.shrunk_delta(frame(spark, *wet_rows()), RACING)
    assert one(out, 4, 3)["driver_wet_dry_delta"] == pytest.approx(-4.5)


def test_build_does_not_depend_on_hot_groups(spark):
    rows = []
    for year in (2019, 2020, 2021):
        for race in range(1, 6):
            for driver in range(1, 5):
                rows.append(
                    {
                        "raceId": year * 100 + race, "year": year, "round": race, "driverId": driver,
                        "constructorId": driver % 2, "circuitId": race % 3,
                        "positionOrder": (driver * race + year) % 4 + 1,
                        "winner": int((driver * race + year) % 4 == 0),
                        "qualifying_position": (driver + race) % 4 + 1,
                        "grid": (driver + race) % 4, "points": float(race * driver % 7),
                        "finished": (driver + race) % 5 != 0,
                    }
                )
    df = frame(spark, *rows).drop("race_precip_mm")
    races = df.select("raceId", "year", "round").distinct()
    weather = races.select(
        "raceId",
        F.when(F.col("round") != 2, (F.col("round") % 2).cast("double")).alias("race_precip_mm"),
        F.lit(20.0).alias("race_temp_c"),
        F.lit(None).cast("double").alias("quali_precip_mm"),
        F.lit(None).cast("double").alias("conditions_changed"),
    )
    own = df.select("raceId", "driverId", "points", F.col("positionOrder").alias("position"), F.col("winner").alias("wins"))
    group = df.groupBy("raceId", "constructorId").agg(
        F.sum("points").alias("points"), F.min("positionOrder").alias("position"), F.sum("winner").alias("wins")
    )

    def build():
        out = P.build_features(df, own, group, weather, RACING).select(*H.FEATURE_TABLE_COLUMNS)
        types = dict(out.dtypes)
        return sorted(
            str(r)
            for r in out.select(
                *[F.round(c, 9).alias(c) if types[c] == "double" else c for c in out.columns]
            ).collect()
        )

    plain = build()
    try:
        spark.conf.set("spark.formbook.hotGroupRows", "3")
        spark.conf.set("spark.formbook.hotGroupSplits", "3")
        spark.conf.set("spark.formbook.broadcastRows", "1")
        assert build() == plain
    finally:
        for name in ("hotGroupRows", "hotGroupSplits", "broadcastRows"):
            spark.conf.unset(f"spark.formbook.{name}")
    assert len(plain) == 60


def test_features_hold_no_outcome():
    assert not H.leaked_outcomes(H.FEATURE_TABLE_COLUMNS)
    assert len(H.FEATURE_COLUMNS) == 41
    assert not {"grid", "q1", "q2", "q3"} & set(H.FEATURE_COLUMNS)
    assert set(H.FEATURE_CLASSES) == set(H.FEATURE_COLUMNS)
    assert len(H.active_features()) == 39
    with pytest.raises(H.SchemaError):
        H.active_features(("no_such_group",))


def test_guarded_join_refuses_repeated_keys(spark):
    left = spark.createDataFrame([(1,), (2,)], "k long")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    with pytest.raises(JoinGuardError, match="dim"):
        guarded_join(left, right, ["k"], "dim")
    kept = guarded_join(left, right.limit(1), ["k"], "dim")
    assert kept.count() == 2 and kept.where("v IS NULL").count() == 1


def test_neighbours_span_seasons(spark):
    calendar = spark.createDataFrame(
        [(5, 2019, 1), (3, 2019, 2), (9, 2020, 1), (1, 2021, 1)],
        "event_id long, season long, round long",
    )
    got = {r["event_id"]: (r["prev_event_id"], r["next_event_id"]) for r in neighbours(calendar).collect()}
    assert got == {5: (None, 3), 3: (5, 9), 9: (3, 1), 1: (9, None)}


def test_roster_comes_from_the_latest_completed_event(spark):
    calendar = spark.createDataFrame(
        [(1, 2020, 1), (2, 2020, 2), (3, 2020, 3), (4, 2021, 1)],
        "event_id long, season long, round long",
    )
    facts = spark.createDataFrame(
        [(1, 10, 7), (1, 11, 8), (3, 12, 7)], "event_id long, entity_id long, group_id long"
    )
    got = roster_as_of(calendar.where("event_id > 1"), calendar, facts).orderBy("event_id", "entity_id").collect()
    assert [tuple(r) for r in got] == [(2, 10, 7), (2, 11, 8), (3, 10, 7), (3, 11, 8), (4, 12, 7)]
    named = spark.createDataFrame([(4, 99, 1)], "event_id long, entity_id long, group_id long")
    only = roster_as_of(calendar.where("event_id = 4"), calendar, facts, named).collect()
    assert [tuple(r) for r in only] == [(4, 99, 1)]
    with pytest.raises(RosterError, match=r"\[1\]"):
        roster_as_of(calendar, calendar, facts)
    # A named roster stands in for the history that is not there.
    named = spark.createDataFrame([(1, 99, 1)], "event_id long, entity_id long, group_id long")
    assert roster_as_of(calendar, calendar, facts, named).where("event_id = 1").count() == 1


def test_unknown_winners_leave_an_event_open(spark):
    from formbook.operators.quality import events_without_one_winner

    rows = [(1, 1), (1, 0), (2, None), (2, None), (3, 1), (3, 1), (4, 0), (5, None), (5, 1)]
    got = events_without_one_winner(spark.createDataFrame(rows, "event_id long, winner int"))
    assert {(r["event_id"], r["winners"]) for r in got.collect()} == {(2, 0), (3, 2), (4, 0)}


def test_season_outside_all_windows_keeps_its_row(spark):
    from formbook.operators.joins import within_windows

    df = spark.createDataFrame([(1999,), (2005,), (None,)], "season int")
    got = within_windows(df, "season", [("a", 1998, 2000)], ["era"], outer=True)
    assert {(r["season"], r["era"]) for r in got.collect()} == {(1999, "a"), (2005, None), (None, None)}


def test_strict_cast_names_the_column(spark):
    import pytest

    from formbook.operators.quality import cast_strict

    df = spark.createDataFrame([("1", "x"), (None, "2")], "a string, b string")
    assert [r["a"] for r in cast_strict(df, {"a": "long"}).collect()] == [1, None]
    with pytest.raises(Exception, match="column b: not a long: x"):
        cast_strict(df, {"a": "long", "b": "long"}).collect()


def test_race_facts_take_the_first_of_each(spark):
    from formbook.plans.analytics import race_facts

    results = spark.createDataFrame(
        [(2, 1, 57, 1, "1:31.0"), (1, 1, 58, 1, "1:30.0"), (3, 1, None, 1, None), (4, 2, 10, None, "1:20.0")],
        "resultId long, raceId long, laps long, rank long, fastestLapTime string",
    )
    quali = spark.createDataFrame(
        [(9, 1, 1, "a", "b", None), (8, 1, 1, "c", None, None), (7, 1, 2, "x", "y", "z")],
        "qualifyId long, raceId long, position long, q1 string, q2 string, q3 string",
    )
    races = spark.createDataFrame([(i, 7, f"R{i}", "2020-01-01") for i in (1, 2, 3)], "raceId long, circuitId long, name string, date string")
    circuits = spark.createDataFrame([(7, "C", "Land", "Town")], "circuitId long, name string, country string, location string")
    got = {r["raceId"]: (r["grand_prix"], r["circuit"], r["laps"], r["fastest_lap"], r["pole_time"]) for r in race_facts(results, quali, races, circuits).collect()}
    assert got == {1: ("R1", "C", 58, "1:30.0", "c"), 2: ("R2", "C", 10, None, None), 3: ("R3", "C", None, None, None)}


def test_confidence_reasons_in_order(spark):
    from formbook.functions import scalars as S

    df = spark.createDataFrame([(0.2, 1), (0.04, 7), (0.1, 3), (None, None), (0.15, 0)], "gap double, grid long")
    got = [r[0] for r in df.select(S.confidence_reasons("gap", "grid")).collect()]
    assert got == [
        ["Clear separation from the field (+20% over 2nd)", S.POLE_LABEL, S.ERA_CAVEAT],
        [S.TIGHT_LABEL, "Favorite started outside the top 5 (P7)", S.ERA_CAVEAT],
        [S.ERA_CAVEAT],
        [S.ERA_CAVEAT],
        ["Clear separation from the field (+15% over 2nd)", S.ERA_CAVEAT],
    ]
